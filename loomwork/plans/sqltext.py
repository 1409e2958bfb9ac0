"""SQL text of the rounding and means that the operators use."""

from __future__ import annotations


def rounded(x: str, digits: int = 4) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(30,8)), {digits}) AS DOUBLE)"


def exact_sum(x: str, where: str = "") -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(30,6)))" + (f" FILTER ({where})" if where else "") + " AS DOUBLE)"


def mean(x: str, digits: int = 4, where: str = "") -> str:
    some = f" FILTER ({where})" if where else ""
    return rounded(f"({exact_sum(x, where)} / count({x}){some})", digits)


_STOP = "['the','and','for','what','how','with','from','that','this','are','is','of','in','to','a','an']"


def tokens(x: str) -> str:
    """Search tokens (Latin) of a text as a list; order doesn't matter to its users."""
    s = r"regexp_replace(t, '[.+/_-]+$', '')"
    part = rf"list_filter(regexp_split_to_array({s}, '[.+/_-]+'), lambda p: p <> '' AND NOT list_contains({_STOP}, p))"
    more = f"CASE WHEN len({part}) > 1 THEN list_concat({part}, [array_to_string({part}, '')]) ELSE [] END"
    return rf"flatten(list_transform(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9][a-z0-9.+/_-]*'), lambda t: CASE WHEN list_contains({_STOP}, {s}) THEN CAST([] AS VARCHAR[]) ELSE list_distinct(list_concat([{s}], {more})) END))"


def squeezed(x: str) -> str:
    return rf"lower(trim(regexp_replace({x}, '\s+', ' ', 'g')))"


BM25 = "tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * len / {average}))"
IDF = "ln(1 + (n - df + 0.5e0) / (df + 0.5e0))"


def postings(source: str, keys: str, text: str, average: str = "256.0e0") -> str:
    """Common table expressions tf, len, df, n and w(keys, term, tf, len, df, w)."""
    return f"""tf AS (SELECT {keys}, term, count(*) AS tf FROM (SELECT {keys}, unnest({tokens(text)}) AS term FROM {source}) GROUP BY ALL),
    len AS (SELECT {keys}, CAST(sum(tf) AS BIGINT) AS len FROM tf GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(*) AS n, CAST(sum(len) AS DOUBLE) / count(*) AS avg_len FROM len),
    w AS (SELECT {keys}, term, tf, len, df, {BM25.format(average=average)} * {IDF} AS w FROM tf JOIN len USING ({keys}) JOIN df USING (term), n)"""


def lexical(keys: str, most: int, asked: str = "q") -> str:
    """Common table expression lex(question, keys, score, rank) from w and the terms of ``asked``."""
    return f"""lex AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, {keys}) AS rank FROM (SELECT question, {keys}, {rounded("sum(CAST(w AS DECIMAL(30,10)))")} AS score
    FROM w JOIN {asked} USING (term) GROUP BY ALL) QUALIFY rank <= {most})"""


def nearest(asked: str, most: int) -> str:
    """Common table expression dense(question, vec_id, score, rank)."""
    return f"""dense AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS question, e.vec_id AS vec_id,
    {rounded("list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))")} AS score FROM embeddings e, ({asked}) q) QUALIFY rank <= {most})"""


def raw_tokens(x: str) -> str:
    """Words (Latin) of a text as a list, in lower case."""
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9][a-z0-9.+/_-]*')"


def packs(rows: str, joint: int = 1, nested: bool = False) -> str:
    """WITH clause of ``packed`` (k, o, n, pack): rows(k, o, size, budget) packed greedily, walked one row a step; ``nested``: inside another WITH RECURSIVE."""
    fits = f"p.used + {joint} + r.size <= r.budget"
    return f"""{'' if nested else 'WITH RECURSIVE '}ordered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o) - 1 AS n FROM ({rows})),
    packed AS (SELECT k, o, n, size AS used, CAST(0 AS BIGINT) AS pack FROM ordered WHERE n = 0 UNION ALL
    SELECT r.k, r.o, r.n, CASE WHEN {fits} THEN p.used + {joint} + r.size ELSE r.size END, CASE WHEN {fits} THEN p.pack ELSE p.pack + 1 END FROM packed AS p JOIN ordered AS r ON r.k = p.k AND r.n = p.n + 1)"""
