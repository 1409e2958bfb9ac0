"""Rules in which each row of a key depends on how the rows before it came out."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame


def in_order(rows: DataFrame, key: str, order: list[str], make: Callable[[], Callable[[dict], bool]], out: str) -> DataFrame:
    """(id, key, out): a boolean of each row from a rule that sees the rows of its key in order.

    Rows are dealt by key and sorted; a task streams them, and holds the state of one key at a time, however many rows it has.
    """

    def each(batches: Iterator) -> Iterator:
        import pandas as pd

        now, rule = object(), None
        for batch in batches:
            told = []
            for row in batch.to_dict("records"):
                if row[key] != now:
                    now, rule = row[key], make()
                told.append(rule(row))
            yield pd.DataFrame({"id": batch["id"], key: batch[key], out: told})

    dealt = rows.where(f"{key} is not null").repartition(key).sortWithinPartitions(key, *order)
    return dealt.mapInPandas(each, f"id bigint, {key} bigint, {out} boolean")


def circuit_breaker(calls: DataFrame, key: str, limit: int, cooldown: float) -> DataFrame:
    """(id, key, passed) of calls(id, key, at, failed): ``limit`` failures open the circuit of a key for ``cooldown`` seconds from the last; a success resets it."""

    def make():
        failures, last = 0, 0.0

        def rule(row: dict) -> bool:
            nonlocal failures, last
            if failures >= limit and row["at"] - last < cooldown:
                return False
            failures, last = (failures + 1, row["at"]) if row["failed"] else (0, last)
            return True

        return rule

    return in_order(calls, key, ["at", "id"], make, "passed")


def rate_limit(calls: DataFrame, key: str, most: int, seconds: float) -> DataFrame:
    """(id, key, granted) of calls(id, key, at): at most ``most`` granted calls of a key in any ``seconds``; denied ones don't count."""

    def make():
        granted: deque[float] = deque()

        def rule(row: dict) -> bool:
            while granted and row["at"] - granted[0] >= seconds:
                granted.popleft()
            if len(granted) >= most:
                return False
            granted.append(row["at"])
            return True

        return rule

    return in_order(calls, key, ["at", "id"], make, "granted")
