"""Personal data spans in DataFrame expressions: exact base patterns, and boosted trees over high-recall candidates."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The base kinds in their order. Possessive repeats and look-behinds only spare the matcher useless restarts:
# the spans are those of the plain patterns.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++"
BASE = {
    "email": _LOCAL + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Candidates: written-out or bracketed addresses, numbers without a plus, cards with other separators, colon addresses.
CANDIDATES = {
    "email": _LOCAL + r"\x20?(?:\(at\)|\[at\]|@|\x20at\x20|\x20AT\x20)\x20?[A-Za-z0-9-]++\x20?(?:\(dot\)|\[dot\]|\.|\x20dot\x20|\x20DOT\x20)\x20?[A-Za-z]{2,12}",
    "ip": r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{0,4}+){2,7}+",
    "card": r"[0-9](?:[\x20./-]{0,2}[0-9])++",
    "phone": r"\(?[0-9][\x20().0-9-]{8,}[0-9]",
}
_CUES = {
    "email": r"(?i)(e-?mail|mail|contact|write|reach|address)\W*(\w+\W+){0,2}$",
    "ip": r"(?i)(ip|host|address|server|from)\W*(\w+\W+){0,1}$",
    "card": r"(?i)(card|visa|credit|account|pay)\W*(\w+\W+){0,2}$",
    "phone": r"(?i)(tel|phone|call|mobile|fax|cell|dial)\W*(\w+\W+){0,2}$",
}
FEATURES = ("kind", "digits", "length", "groups", "brackets", "luhn", "cue", "joined", "written", "doubled", "hexes")
CONTEXT = 24


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    return F.call_function("luhn_check", x)


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(steps: Column) -> Column:
    """Sums of all earlier elements of an array of bigint. Blocks of about the root of its size are summed first and then each block within, so that
    a text of very many matches takes size * root(size) steps at most."""

    def sums(xs: Column, start: Column) -> Column:
        none = F.array().cast("array<bigint>")
        return F.aggregate(xs, F.struct(start.alias("p"), none.alias("o")), lambda a, x: F.struct((a["p"] + x).alias("p"), F.concat(a["o"], F.array(a["p"])).alias("o")), lambda a: a["o"])

    def blocks(xs: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(xs))).cast("int")
        cut = _let(size, lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / n).cast("int")), lambda i: F.slice(xs, i * n + 1, n)))

        def within(parts: Column) -> Column:
            totals = F.transform(parts, lambda part: F.aggregate(part, F.lit(0).cast("bigint"), lambda a, x: a + x))
            return F.flatten(F.zip_with(parts, sums(totals, F.lit(0).cast("bigint")), sums))

        return F.when(F.size(xs) > 0, _let(cut, within)).otherwise(F.array().cast("array<bigint>"))

    return _let(steps, blocks)


def found(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m, before, after>>: start and end in code points, the match, and the text from the match before it and to the
    next, of all leftmost non-overlapping matches.

    The text between matches (split) and the matches give the places; both run the same matcher over the whole text.
    """

    def placed(x: Column) -> Column:
        gaps, hits = x["gaps"], x["hits"]
        steps = F.transform(hits, lambda m, i: (F.length(F.get(gaps, i)) + F.length(m)).cast("bigint"))
        at = lambda first: F.transform(hits, lambda m, i: _let(F.get(first, i) + F.length(F.get(gaps, i)), lambda s: F.struct(
            s.cast("int").alias("s"), (s + F.length(m)).cast("int").alias("e"), m.alias("m"), F.get(gaps, i).alias("before"), F.get(gaps, i + 1).alias("after"))))
        return _let(running(steps), at)

    return _let(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")), placed)


def _passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    n = F.length(_digits(m))
    if kind == "card":
        return n.between(14, 19) & _luhn(_digits(m))
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<s, k, e>> by start and kind, with k the place in KINDS."""
    each = [
        F.transform(
            F.filter(found(text, BASE[kind]), lambda x: _passes(kind, x["m"])),
            lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")),
        )
        for k, kind in enumerate(KINDS)
    ]
    return F.array_sort(F.concat(*each))


def candidates(text: Column) -> Column:
    """array<struct<s, k, e, f array<int>>>: proposed spans with FEATURES of their form and of the text around them: up to CONTEXT characters
    before, back to the match before, and the one after."""

    def features(k: int, kind: str, x: Column) -> Column:
        m, digits = x["m"], F.length(_digits(x["m"]))
        before, after = F.right(x["before"], F.lit(CONTEXT)), F.left(x["after"], F.lit(1))
        yes = lambda c: F.coalesce(c.cast("int"), F.lit(0))
        values = {
            "kind": F.lit(k), "digits": digits, "length": F.length(m),
            "groups": F.size(F.split(m, "[^0-9A-Za-z]+")), "brackets": yes(m.rlike(r"[(\[]")),
            "luhn": yes(digits.between(13, 19) & _luhn(_digits(m))), "cue": yes(before.rlike(_CUES[kind])),
            "joined": yes(before.rlike(r"[0-9A-Za-z_/.-]$")) + yes(after.rlike("[0-9A-Za-z_/-]")),
            "written": yes(m.rlike(r"(?i)[( \[]at[) \]].*[( \[]dot[) \]]")), "doubled": yes(m.rlike(r"[\x20.)(-]{3,}|::")),
            "hexes": yes(m.rlike("[A-Fa-f]")),
        }
        return F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), F.array(*[values[f].cast("int") for f in FEATURES]).alias("f"))

    fits = {
        "email": lambda m: ~m.rlike("^" + BASE["email"][len(r"(?:\G|(?<![A-Za-z0-9._%+-]))") :] + "$"),
        "ip": lambda m: F.length(m) >= 8,
        "card": lambda m: F.length(_digits(m)).between(13, 19),
        "phone": lambda m: F.length(_digits(m)).between(10, 15),
    }
    each = []
    for k, kind in enumerate(KINDS):
        some = F.filter(found(text, CANDIDATES[kind]), lambda x: fits[kind](x["m"]))
        each.append(F.transform(some, lambda x: features(k, kind, x)))
    return F.concat(*each)


# --- the model ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Trees:
    """Boosted trees of two levels over FEATURES: (feature, threshold, (low: feature, threshold, values), (high: ...))."""

    trees: tuple
    limits: tuple  # of each kind: the score from which a candidate is taken

    def score(self, f: Column) -> Column:
        def leaf(node) -> Column:
            return F.when(f[node[0]] <= node[1], F.lit(node[2])).otherwise(F.lit(node[3]))

        return sum((F.when(f[i] <= t, leaf(low)).otherwise(leaf(high)) for i, t, low, high in self.trees), F.lit(0.0))

    def plain_score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for i, t, low, high in self.trees:
            side = x[:, i] <= t
            for own, (j, u, a, b) in ((side, low), (~side, high)):
                total += own * np.where(x[:, j] <= u, a, b)
        return total


def _stump(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray) -> tuple[int, int, float, float, float]:
    best = (0, 0, 0.0, 0.0, -1.0)
    for i in range(x.shape[1]):
        for t in np.unique(x[rows, i])[:-1].tolist() or [0]:
            low = rows & (x[:, i] <= t)
            high = rows & ~low
            gain = g[low].sum() ** 2 / (h[low].sum() + 1) + g[high].sum() ** 2 / (h[high].sum() + 1)
            if gain > best[4] + 1e-12:
                best = (i, int(t), float(g[low].sum() / (h[low].sum() + 1)), float(g[high].sum() / (h[high].sum() + 1)), float(gain))
    return best


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 24, rate: float = 0.4) -> Trees:
    """Newton boosting of logistic loss; limits at even odds until ``calibrated``."""
    total, trees = np.zeros(len(x)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        i, t, *_ = _stump(x, g, h, np.ones(len(x), bool))
        side, halves = x[:, i] <= t, []
        for own in (side, ~side):
            j, u, a, b, _ = _stump(x, g, h, own)
            halves.append((j, u, round(rate * a, 6), round(rate * b, 6)))
        trees.append((i, t, *halves))
        total = Trees(tuple(trees), ()).plain_score(x)
    return Trees(tuple(trees), (0.0,) * len(KINDS))


def calibrated(model: Trees, x: np.ndarray, y: np.ndarray, precision: float = 0.95) -> Trees:
    """Limits on candidates that the trees were not fitted on: for each kind the lowest score at which ``precision`` of those taken are right, counting
    one wrong one more than there were. A limit is never under even odds; a kind without a right candidate takes none."""
    score, limits = model.plain_score(x), []
    for k in range(len(KINDS)):
        s, right = score[x[:, 0] == k], y[x[:, 0] == k]
        good = [v for v in np.unique(s[right == 1]) if right[s >= v].sum() / ((s >= v).sum() + 1) >= precision]
        limits.append(max(0.0, float(min(good)) - 1e-9) if good else float("inf"))
    return Trees(model.trees, tuple(limits))


def labelled(spark: SparkSession, rows: int) -> DataFrame:
    """(id, text, kind, form, fit): ``rows`` invented sentences, made by expressions from the row number; kind -1 where no span is right.
    Forms that are ``fit`` are for the trees, the others for the limits."""
    num = lambda salt, n: F.lpad(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(10**n)).cast("string"), n, "0")
    hexa = lambda salt: F.lower(F.substring(F.hex(F.xxhash64("id", F.lit(salt))), 1, 4))
    pick = lambda salt, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(xs))).cast("int") + 1)
    word = lambda salt: pick(salt, "anna", "marsh", "river", "tom", "stone", "olive", "grant", "nine", "lee", "copper")
    stem = F.concat(num(1, 5), num(2, 5), num(3, 5))
    digits = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: d.cast("string"))
    valid = F.concat(stem, F.element_at(F.filter(digits, lambda d: _luhn(F.concat(stem, d))), 1))
    wrong = F.concat(stem, F.element_at(F.filter(digits, lambda d: ~_luhn(F.concat(stem, d))), 1))
    four = lambda x, sep: F.concat_ws(sep, *[F.substring(x, i, 4) for i in (1, 5, 9, 13)])
    tld, mail = pick(4, "com", "org", "net", "edu"), pick(5, "write to", "contact", "mail", "reach us by e-mail:", "", "the address")
    host, card, call = pick(9, "host", "address", "from ip", "server", "", "seen at"), pick(14, "card", "visa", "credit card no", "account", "pay with"), pick(15, "call", "tel", "phone:", "mobile", "fax", "dial")
    other = pick(21, "order", "id", "part", "see", "ticket", "invoice")
    both = lambda kind, *forms: [(kind, F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in f])) for f in forms]
    # Forms in turn are for the trees and for the limits.
    forms = [
        *both(0, (mail, " ", word(6), " (at) ", word(7), " (dot) ", tld), (mail, " ", word(6), ".", word(8), "(at)", word(7), "(dot)", tld),
              (mail, " ", word(6), "[at]", word(7), "[dot]", tld), (mail, " ", word(6), " [at] ", word(7), " [dot] ", tld),
              (pick(5, "write to", "contact", "mail me"), " ", word(6), " at ", word(7), " dot ", tld), (pick(5, "e-mail:", "address"), " ", word(6), "_", num(17, 2), " AT ", word(7), " DOT ", tld)),
        *both(1, (host, " 2001:db8:", hexa(10), "::", hexa(11)), (host, " 2001:db8::", hexa(10), ":", hexa(11)),
              (host, " fe80:", hexa(10), ":", hexa(11), ":", hexa(12), ":", hexa(13), "::1"), (host, " fd00:", hexa(10), ":", hexa(11), ":", hexa(12), ":", hexa(13), ":", hexa(22), ":", hexa(23), ":1")),
        *both(2, (card, " ", four(valid, "."), " due"), (card, " ", four(valid, " . "), " expires soon"), (card, " ", four(valid, "/"), " due"), (card, " ", four(valid, "--"), " and thanks")),
        *both(3, (call, " ", num(16, 3), "-", num(17, 3), "-", num(18, 4), " now"), (call, " ", num(16, 3), ".", num(17, 3), ".", num(18, 4), " now"),
              (call, " (", num(16, 3), ") ", num(17, 3), "-", num(18, 4)), (call, " 0", num(16, 3), " ", num(17, 3), " ", num(18, 4), " today")),
        *both(-1, (pick(19, "look", "sat", "met", "stood"), " at ", word(6), ". ", pick(20, "Then", "The", "And", "It"), " went"), (pick(19, "looked", "worked", "arrived"), " at ", word(7), ". ", pick(20, "Later", "She"), " slept"),
              (word(6), " at ", word(7), ". ", pick(20, "They", "So", "He", "As"), " came home"), (word(6), " AT ", word(7), ". ", pick(20, "NOW", "ALL"), " WENT"),
              (other, " ", num(16, 5), "-", num(17, 5), " of"), (other, " no ", num(16, 6), "-", num(17, 4), "-", num(18, 2), " was sent"),
              (other, " ", num(16, 12)), (other, " ", num(16, 5), num(17, 8), " again"),
              ("between 2021-01-", num(22, 2), " 2022-03-", num(23, 2)), ("from 1999-12-", num(22, 2), " 1", num(23, 1), " 30 rows"),
              ("isbn 978-", num(22, 1), "-", num(16, 4), "-", num(17, 4), "-", num(23, 1)), ("isbn 979 ", num(22, 2), " ", num(16, 5), " ", num(17, 2), " ", num(23, 1)),
              (pick(21, "version", "table", "row"), " ", num(16, 4), ".", num(17, 4), ".", num(18, 4), ".", num(24, 4)), (other, " ", four(wrong, "/"), " rows"),
              ("at ", num(22, 2), ":", num(23, 2), ":", num(25, 2), " and 1:2:3:4:5"), ("took ", num(22, 2), ":", num(23, 2), ":", num(25, 2), ":", num(26, 2), " in all"),
              (pick(21, "sum", "", "total"), " ", num(16, 3), " ", num(17, 3), " ", num(18, 4)), ("values ", num(16, 2), " ", num(17, 2), " ", num(18, 2), " ", num(24, 2), " ", num(25, 2), " ", num(26, 2)),
              ("mac 00:", F.substring(hexa(10), 1, 2), ":", F.substring(hexa(11), 1, 2), ":", F.substring(hexa(12), 1, 2), ":", F.substring(hexa(13), 1, 2), ":1f"), ("mac ", F.concat_ws(":", *[F.substring(hexa(i), 1, 2) for i in (10, 11, 12, 13, 22, 23)])),
              ("measured ", num(16, 4), ".", num(17, 4), " - ", num(18, 4), ".", num(24, 2)), ("coordinates ", num(22, 2), ".", num(16, 5), ", ", num(23, 2), ".", num(17, 5), " ", num(24, 3))),
    ]
    which = F.pmod(F.col("id"), F.lit(len(forms)))
    text, kind = F.lit(""), F.lit(-1)
    for i, (k, x) in enumerate(forms):
        text, kind = F.when(which == i, F.concat(F.lit("We and they. "), x, F.lit(" of it."))).otherwise(text), F.when(which == i, F.lit(k)).otherwise(kind)
    return spark.range(rows).select("id", text.alias("text"), kind.alias("kind"), which.alias("form"), (which % 2 == 0).alias("fit"))


def train(spark: SparkSession, rows: int = 1840) -> Trees:
    """Trees from the candidates of half of the forms of ``rows`` invented sentences, limits from the other half (a few thousand short rows at most reach the driver)."""
    made = labelled(spark, rows).withColumn("c", F.explode(candidates(F.col("text"))))
    got = made.select("id", "fit", (F.col("c.k") == F.col("kind")).cast("int").alias("y"), "c.s", "c.k", "c.f").orderBy("id", "s", "k").collect()
    x, y, fit = np.array([r["f"] for r in got]), np.array([r["y"] for r in got]), np.array([r["fit"] for r in got])
    return calibrated(fit_trees(x[fit], y[fit]), x[~fit], y[~fit])


def settled(spans: DataFrame) -> DataFrame:
    """The rows of spans(row, s, k, e, score) that stay: all base spans (null score); a candidate that overlaps no base span and, of a chain of
    candidates that overlap one another, has the highest score (ties: the first). Only windows over sorted rows: a text of very many spans costs no more a span."""
    own = Window.partitionBy("row")
    forth, back = own.orderBy("s", "k", "e"), own.orderBy(F.desc("s"), F.desc("k"), F.desc("e"))
    base = F.col("score").isNull()
    before = F.max(F.when(base, F.col("e"))).over(forth.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("s"))).over(back.rowsBetween(Window.unboundedPreceding, -1))
    free = spans.withColumn("_before", before).withColumn("_after", after)
    free = free.where(base | ((F.coalesce("_before", F.lit(0)) <= F.col("s")) & F.coalesce(F.col("_after") >= F.col("e"), F.lit(True))))
    # A base span begins a chain of its own, and so does the candidate after it.
    reach = F.max("e").over(forth.rowsBetween(Window.unboundedPreceding, -1))
    chain = F.sum(F.coalesce((reach <= F.col("s")).cast("int"), F.lit(1))).over(forth.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    chains = free.withColumn("_reach", reach).withColumn("_chain", F.when(~base, chain))
    best = F.max(F.struct("score", -F.col("s"), -F.col("k"))).over(Window.partitionBy("row", "_chain"))
    return chains.withColumn("_best", best).where(base | (F.struct("score", -F.col("s"), -F.col("k")) == F.col("_best"))).drop("_before", "_after", "_reach", "_chain", "_best")


def find_pii(docs: DataFrame, model: Trees | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row of documents.

    Base spans are kept as they are and counted; candidates that the trees accept join them in ``spans`` where ``settled`` lets them. Spans are
    kind:start:end in code points. A null or empty text has none. Repeated rows and null doc_ids are rows of their own; other columns are ignored.
    Texts stay where they are read; only spans and doc_ids are dealt, by row.
    """
    model = model or train(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    limit = F.array(*[F.lit(x) for x in model.limits])
    score = lambda c: model.score(c["f"])
    scored = F.transform(candidates(text), lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"), score(c).alias("score")))
    good = F.filter(scored, lambda c: c["score"] >= F.get(limit, c["k"]))
    sure = F.transform(base_spans(text), lambda b: F.struct(b["s"].alias("s"), b["k"].alias("k"), b["e"].alias("e"), F.lit(None).cast("double").alias("score")))
    rows = docs.select(F.col("doc_id").cast("bigint"), F.monotonically_increasing_id().alias("row"), F.concat(sure, good).alias("all"))
    rows = rows.select("row", "doc_id", F.explode_outer("all").alias("x")).select("row", "doc_id", "x.*")
    kept = settled(rows)
    names = F.array(*[F.lit(k) for k in KINDS])
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
    span = F.struct("s", "k", "e")
    real = F.col("s").isNotNull()
    counts = [F.count(F.when(real & F.col("score").isNull() & (F.col("k") == k), 1)).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    base = F.array_sort(F.collect_list(F.when(real & F.col("score").isNull(), span)))
    out = kept.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *counts, base.alias("base"), F.array_sort(F.collect_list(F.when(real, span))).alias("every"))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(F.col("every")).alias("spans"))
