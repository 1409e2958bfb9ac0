"""A rate limiter with keyed state on a stream: denied calls don't count."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Limiter(StatefulProcessor):
    """At most ``most`` granted calls of a key in any ``seconds``; the times of these are the whole state of a key."""

    def __init__(self, most: int, seconds: float):
        self.most, self.seconds = most, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.granted = handle.getListState("granted", "at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        granted = [x[0] for x in self.granted.get()] if self.granted.exists() else []
        calls = pd.concat(list(rows)).sort_values(["at", "id"])
        out = []
        for at in calls["at"]:
            granted = [x for x in granted if at - x < self.seconds]
            out.append(len(granted) < self.most)
            if out[-1]:
                granted.append(at)
        self.granted.clear()
        if granted:
            self.granted.put([(x,) for x in granted])
        yield pd.DataFrame({"id": calls["id"].to_numpy(), "user_id": key[0], "granted": out})

    def close(self) -> None:
        pass


def limited(stream: DataFrame, most: int, seconds: float) -> DataFrame:
    """(id, user_id, granted) of a stream of calls (id, user_id, at in seconds); needs the RocksDB state store."""
    return stream.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=Limiter(most, seconds), outputStructType="id bigint, user_id bigint, granted boolean", outputMode="Append", timeMode="None"
    )
