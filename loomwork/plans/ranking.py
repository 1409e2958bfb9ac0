"""Queries that rank documents, chunks and vectors. Questions are every document or vector whose id is divisible by 50."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions import text as x
from loomwork.operators import retrieval as r
from loomwork.operators.common import mean, place, rounded, share
from loomwork.operators.storage import saved
from loomwork.plans import sqltext as sql
from loomwork.plans.registry import query

_DOC = ["doc_id"]
_CHUNK = ["doc_id", "idx"]
_Q = f"q AS (SELECT doc_id AS question, unnest(list_distinct({sql.tokens('title')})) AS term FROM document WHERE doc_id % 50 = 0)"
_ASKED = "SELECT * FROM embeddings WHERE vec_id % 50 = 0"


def doc_questions(t) -> DataFrame:
    return r.questions(t.document.where("doc_id % 50 = 0"), "doc_id", "title")


def doc_ranking(t, most: int, scopes: DataFrame | None = None) -> DataFrame:
    return r.lexical(t["documents"], doc_questions(t), _DOC, most, scopes=scopes)


def chunk_ranking(t, most: int, average: float | None = x.AVERAGE) -> DataFrame:
    return r.lexical(t.chunk, doc_questions(t), _CHUNK, most, "body", average)


def vector_questions(t) -> DataFrame:
    return t["embeddings"].where("vec_id % 50 = 0").select(F.col("vec_id").alias("question"), F.col("embedding").alias("vector"))


@query(f"SELECT doc_id, len(list_distinct({sql.tokens('text')})) AS n_distinct, len({sql.tokens('text')}) AS n_tokens, md5(array_to_string(list_sort(list_distinct({sql.tokens('text')})), ' ')) AS digest FROM documents")
def fn_tokens(t):
    d = t["documents"].select("doc_id", x.tokens("text").alias("t"))
    return d.select("doc_id", F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"), F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join(F.array_sort(F.array_distinct("t")), " ")).alias("digest"))


@query(f"SELECT item_id, array_to_string(list_sort(list_distinct({sql.tokens('text')})), ' ') AS terms FROM item")
def fn_query_terms(t):
    return t.item.select("item_id", F.array_join(F.array_sort(x.query_terms("text")), " ").alias("terms"))


@query(f"""WITH w1 AS (SELECT doc_id, unnest(list_concat({sql.tokens('text')}, {sql.tokens('title')}, {sql.tokens('title')})) AS term FROM document), tf AS (SELECT doc_id, term, count(*) AS tf FROM w1 GROUP BY ALL),
    len AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY ALL) SELECT doc_id, count(*) AS n_terms, CAST(any_value(len) AS BIGINT) AS len, {sql.rounded("sum(CAST(" + sql.BM25.format(average="256.0e0") + " AS DECIMAL(30,10)))")} AS weight FROM tf JOIN len USING (doc_id) GROUP BY doc_id""")
def fn_bm25_weight(t):
    """Term weights with the title counted twice, summed for each document."""
    p = r.postings(t.document, _DOC, "text", "title")
    return p.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.max("len").alias("len"), rounded(r.exact(r.bm25(F.col("tf"), F.col("len")))).alias("weight"))


@query(f"WITH {sql.postings('documents', 'doc_id', 'text')} SELECT term, df, {sql.rounded(sql.IDF, 6)} AS idf FROM df, n")
def fn_idf(t):
    p = saved(r.postings(t["documents"], _DOC))
    n = p.select("doc_id").distinct().agg(F.count("*").alias("n"))
    return r.document_frequencies(p).join(F.broadcast(n)).select("term", "df", rounded(r.idf(F.col("df"), F.col("n")), 6).alias("idf"))


@query(f"WITH {_Q}, {sql.postings('chunk', 'doc_id, idx', 'body', 'avg_len')}, {sql.lexical('doc_id, idx', 10)} SELECT * FROM lex")
def q_bm25_exact(t):
    """The ten best chunks of each question by BM25 with the real average length."""
    return chunk_ranking(t, 10, None)


@query(f"WITH {sql.nearest(_ASKED, 20)} SELECT * FROM dense")
def topk_vector(t):
    return r.nearest(t["embeddings"], vector_questions(t), 20)


@query(f"WITH {_Q}, {sql.postings('documents', 'doc_id', 'text')}, {sql.lexical('doc_id', 50)} SELECT * FROM lex")
def win_rank_ties(t):
    """Ranks by score at four decimals, ties by id."""
    return doc_ranking(t, 50)


_LEX_DENSE = f"{_Q}, {sql.postings('documents', 'doc_id', 'text')}, {sql.lexical('doc_id', 100)}, {sql.nearest(_ASKED, 100)}, dense_d AS (SELECT question, vec_id AS doc_id, rank FROM dense WHERE vec_id IN (SELECT doc_id FROM documents) AND question IN (SELECT doc_id FROM documents))"
_FUSED = """fused AS (SELECT question, doc_id, CAST(sum(CAST(1.0e0 / (60 + rank) AS DECIMAL(30,10))) AS DOUBLE) AS score, array_to_string(list_sort(list(DISTINCT by_)), '+') AS matched_by
    FROM (SELECT question, doc_id, rank, 'words' AS by_ FROM lex UNION ALL SELECT question, doc_id, rank, 'vector' FROM dense_d) GROUP BY question, doc_id)"""


def both_rankings(t, most: int = 100):
    ids = t["documents"].select("doc_id")
    dense = r.nearest(t["embeddings"], vector_questions(t), most).withColumnRenamed("vec_id", "doc_id")
    dense = dense.join(ids, "doc_id", "left_semi").join(ids.select(F.col("doc_id").alias("question")), "question", "left_semi")
    return doc_ranking(t, most), dense


@query(f"WITH {_LEX_DENSE}, {_FUSED} SELECT question, doc_id, {sql.rounded('score', 8)} AS score, matched_by FROM fused")
def win_rrf(t):
    words, dense = both_rankings(t)
    return r.fused([("words", words, 1), ("vector", dense, 1)], _DOC).withColumn("score", rounded(F.col("score"), 8))


_WEIGHED = f"""weighed AS (SELECT question, f.doc_id, matched_by, d.publisher, d.text, {sql.rounded("score * CASE WHEN contains(d.text, ' | ') THEN 0.7e0 ELSE 1.0e0 END * CASE WHEN d.family = o.family THEN 1.3e0 ELSE 1.0e0 END", 8)} AS score
    FROM fused f JOIN document d ON f.doc_id = d.doc_id JOIN document o ON f.question = o.doc_id), ordered AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, doc_id) AS rank FROM weighed)"""


def weighed(t) -> DataFrame:
    """Fused candidates: tables weigh 0.7, documents of the family that the question names 1.3; ranked."""
    words, dense = both_rankings(t)
    f = r.fused([("words", words, 1), ("vector", dense, 1)], _DOC)
    copy = F.sha2(x.squeezed("text"), 256).alias("copy")  # texts stay where they are
    d = t.document.select("doc_id", "publisher", "family", F.contains("text", F.lit(" | ")).alias("table"), copy)
    own = t.document.where("doc_id % 50 = 0").select(F.col("doc_id").alias("question"), F.col("family").alias("own"))
    out = f.join(d, "doc_id").join(own, "question")
    weight = F.when(F.col("table"), 0.7).otherwise(1.0) * F.when(F.col("family") == F.col("own"), 1.3).otherwise(1.0)
    out = out.withColumn("score", rounded(F.col("score") * weight, 8))
    return out.select("question", "doc_id", "matched_by", "publisher", "copy", "score", place(["question"], F.desc("score"), "doc_id").alias("rank"))


_COPIES = f"uncopied AS (SELECT * FROM ordered QUALIFY row_number() OVER (PARTITION BY question, {sql.squeezed('text')} ORDER BY rank) = 1)"
_CAPPED = "capped AS (SELECT * FROM uncopied QUALIFY row_number() OVER (PARTITION BY question, publisher ORDER BY rank) <= 3)"


@query(f"WITH {_LEX_DENSE}, {_FUSED}, {_WEIGHED}, {_COPIES} SELECT question, doc_id, rank FROM uncopied")
def win_duplicate_hide(t):
    return r.hide_copies(weighed(t), "copy").select("question", "doc_id", "rank")


@query(f"WITH {_LEX_DENSE}, {_FUSED}, {_WEIGHED}, {_COPIES}, {_CAPPED} SELECT question, doc_id, publisher, rank FROM capped")
def win_per_document_cap(t):
    return r.cap(r.hide_copies(weighed(t), "copy"), ["publisher"], 3).select("question", "doc_id", "publisher", "rank")


@query(f"WITH {_LEX_DENSE}, {_FUSED}, {_WEIGHED}, {_COPIES}, {_CAPPED} SELECT question, doc_id, publisher, score, matched_by, row_number() OVER (PARTITION BY question ORDER BY rank) AS place FROM capped QUALIFY place <= 8")
def q_hybrid_search(t):
    """Words and vectors fused by reciprocal rank, weighted, copies hidden, at most three of a publisher, the best eight."""
    out = r.cap(r.hide_copies(weighed(t), "copy"), ["publisher"], 3).withColumn("place", place(["question"], "rank")).where("place <= 8")
    return out.select("question", "doc_id", "publisher", "score", "matched_by", "place")


@query()
def q_hybrid_search_greedy(t):
    """As q_hybrid_search, with the cap and the hiding of copies interleaved down the list."""
    return r.greedy_cap(weighed(t), "publisher", "copy", 3, 8).select("question", "doc_id", "publisher", "score", "matched_by", "rank")


@query()
def topk_spread(t):
    """Eight documents of each question, at least two of each of its first four publishers."""
    return r.spread(weighed(t).drop("copy"), "publisher", 8, 2).select("question", "doc_id", "publisher", "rank")


@query(f"WITH {_LEX_DENSE}, {_FUSED}, {_WEIGHED} SELECT question, doc_id, publisher, rank FROM ordered QUALIFY row_number() OVER (PARTITION BY question, publisher ORDER BY rank) <= CASE WHEN count(*) OVER (PARTITION BY question) > 100 THEN 2 ELSE 4 END")
def topk_diversify(t):
    """Two of each publisher where many documents match, else four."""
    from pyspark.sql import Window

    rows = weighed(t).withColumn("_all", F.count("*").over(Window.partitionBy("question"))).withColumn("_n", place(["question", "publisher"], "rank"))
    return rows.where(F.col("_n") <= F.when(F.col("_all") > 100, 2).otherwise(4)).select("question", "doc_id", "publisher", "rank")


_CHUNK_FUSED = f"""{_Q}, {sql.postings('chunk', 'doc_id, idx', 'body')}, {sql.lexical('doc_id, idx', 200)}, {sql.nearest(_ASKED, 100)}, first_chunk AS (SELECT doc_id, min(idx) AS idx FROM chunk GROUP BY doc_id),
    fused AS (SELECT question, doc_id, idx, CAST(sum(CAST(1.0e0 / (60 + rank) AS DECIMAL(30,10))) AS DOUBLE) AS score, bool_or(by_ = 'words') AS words
    FROM (SELECT question, doc_id, idx, rank, 'words' AS by_ FROM lex UNION ALL SELECT question, doc_id, idx, rank, 'vector' FROM dense JOIN first_chunk ON vec_id = doc_id WHERE question IN (SELECT question FROM q)) GROUP BY question, doc_id, idx),
    scored AS (SELECT question, doc_id, {sql.rounded("CAST(sum(CAST(CASE WHEN n <= 3 THEN score ELSE 0.0 END AS DECIMAL(30,10))) AS DOUBLE) + CAST(sum(CAST(words AS INT)) AS BIGINT) * 0.003e0")} AS score, CAST(sum(CAST(words AS INT)) AS BIGINT) AS matching, count(*) AS candidates
    FROM (SELECT *, row_number() OVER (PARTITION BY question, doc_id ORDER BY score DESC, idx) AS n FROM fused) GROUP BY question, doc_id)"""


def chunk_candidates(t) -> DataFrame:
    words = chunk_ranking(t, 200)
    first = t.chunk.groupBy("doc_id").agg(F.min("idx").alias("idx"))
    dense = r.nearest(t["embeddings"], vector_questions(t), 100).withColumnRenamed("vec_id", "doc_id").join(first, "doc_id")
    dense = dense.join(doc_questions(t).select("question").distinct(), "question", "left_semi")
    return r.fused([("words", words, 1), ("vector", dense, 1)], _CHUNK)


@query(f"WITH {_CHUNK_FUSED} SELECT * FROM scored")
def win_top3_sum(t):
    return r.document_scores(chunk_candidates(t), "doc_id")


@query(f"WITH {_CHUNK_FUSED} SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, doc_id) AS place FROM scored QUALIFY place <= 15")
def q_find_documents(t):
    """The fifteen best documents of each question, by their best chunks and by how many chunks match."""
    return r.document_scores(chunk_candidates(t), "doc_id").withColumn("place", place(["question"], F.desc("score"), "doc_id")).where("place <= 15")


@query(f"WITH {_CHUNK_FUSED} SELECT question, doc_id, matching, matching >= greatest(3.0e0, 0.05e0 * max(matching) OVER (PARTITION BY question)) AS discusses FROM scored")
def q_find_documents_tool(t):
    """Whether a document discusses the question: three matching chunks at least, and a twentieth of the most."""
    from pyspark.sql import Window

    s = r.document_scores(chunk_candidates(t), "doc_id")
    return s.select("question", "doc_id", "matching", (F.col("matching") >= F.greatest(F.lit(3.0), 0.05 * F.max("matching").over(Window.partitionBy("question")))).alias("discusses"))


_SOURCES = (("src0", 1.0), ("src1", 0.8), ("src2", 0.6))


@query(f"WITH {_Q}, {sql.postings('documents', 'doc_id', 'text')}, {sql.lexical('doc_id', 1000000000)}, s AS (SELECT question, doc_id, source, row_number() OVER (PARTITION BY question, source ORDER BY score DESC, doc_id) AS rank FROM lex JOIN documents USING (doc_id) WHERE source IN ('src0', 'src1', 'src2')), "
       f"f AS (SELECT question, doc_id, source, rank, {sql.rounded('CASE source WHEN ' + chr(39) + 'src0' + chr(39) + ' THEN 1.0e0 WHEN ' + chr(39) + 'src1' + chr(39) + ' THEN 0.8e0 ELSE 0.6e0 END / (60 + rank)', 8)} AS score FROM s WHERE rank <= 20) SELECT question, doc_id, source, rank, score, row_number() OVER (PARTITION BY question ORDER BY score DESC, source, rank) AS place FROM f QUALIFY place <= 20")  # fmt: skip
def q_cross_source(t):
    """Rankings of three sources, each of its own, fused with weights; ties by source and rank."""
    names = [s for s, _ in _SOURCES]
    d = t["documents"].where(F.col("source").isin(names))
    own = doc_ranking(t, 20, d.select("doc_id", "source"))
    weight = F.when(F.col("source") == "src0", 1.0).when(F.col("source") == "src1", 0.8).otherwise(0.6)
    own = own.withColumn("score", rounded(weight / (60 + F.col("rank")), 8))
    out = own.withColumn("place", place(["question"], F.desc("score"), "source", "rank")).where("place <= 20")
    return out.select("question", "doc_id", "source", "rank", "score", "place")


@query(f"""WITH {_LEX_DENSE}, {_FUSED}, grp AS (SELECT question, family, {sql.rounded('max(score)', 8)} AS score FROM fused JOIN document USING (doc_id) GROUP BY ALL), g1 AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, family) AS rank FROM grp),
    g2 AS (SELECT question, family, row_number() OVER (PARTITION BY question ORDER BY best, family) AS rank FROM (SELECT question, family, min(rank) AS best FROM lex JOIN document USING (doc_id) GROUP BY ALL)),
    b AS (SELECT question, family, {sql.rounded('CAST(sum(CAST(1.0e0 / (60 + rank) AS DECIMAL(30,10))) AS DOUBLE)', 8)} AS score FROM (SELECT question, family, rank FROM g1 UNION ALL SELECT question, family, rank FROM g2) GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, family) AS place FROM b QUALIFY place <= 10""")
def q_legacy_hybrid(t):
    """Groups of documents ranked by fusion and again by words alone, the two rankings fused."""
    words, dense = both_rankings(t)
    family = t.document.select("doc_id", "family")
    f = r.fused([("words", words, 1), ("vector", dense, 1)], _DOC).join(family, "doc_id").groupBy("question", "family").agg(rounded(F.max("score"), 8).alias("score"))
    g1 = f.withColumn("rank", place(["question"], F.desc("score"), "family"))
    g2 = words.join(family, "doc_id").groupBy("question", "family").agg(F.min("rank").alias("best")).withColumn("rank", place(["question"], "best", "family"))
    out = r.fused([("a", g1, 1), ("b", g2, 1)], ["family"]).withColumn("score", rounded(F.col("score"), 8))
    return out.select("question", "family", "score").withColumn("place", place(["question"], F.desc("score"), "family")).where("place <= 10")


@query("""SELECT doc_id, idx, score FROM (SELECT doc_id, idx, CAST((length(lower(body)) - length(replace(lower(body), 'tion', ''))) // 4 + (length(lower(body)) - length(replace(lower(body), 'eau', ''))) // 3 AS BIGINT) AS score FROM chunk)
    WHERE score > 0 ORDER BY score DESC, idx, doc_id LIMIT 100""")
def topk_keyword_count(t):
    """The hundred chunks with most occurrences of two words, ties by place."""
    score = x.occurrences(F.lower("body"), F.lit("tion")) + x.occurrences(F.lower("body"), F.lit("eau"))
    return t.chunk.select("doc_id", "idx", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "idx", "doc_id").limit(100)


_BOOST = "CASE WHEN contains(title, 'the') THEN 200 ELSE 0 END + CASE WHEN contains(text, ' | ') THEN 400 ELSE 0 END + 250 + 40 * least(len(topics), 5) + CASE WHEN length(text) < 500 THEN -50 WHEN length(text) > 5000 THEN 120 ELSE 0 END"


@query(f"SELECT doc_id, publisher, CAST({_BOOST} AS BIGINT) AS score FROM document QUALIFY row_number() OVER (PARTITION BY publisher ORDER BY {_BOOST} DESC, doc_id) <= 5")
def topk_rank_boosts(t):
    """The five best of each publisher by fixed boosts for name, table, topics and size."""
    score = (
        F.when(F.contains("title", F.lit("the")), 200).otherwise(0) + F.when(F.contains("text", F.lit(" | ")), 400).otherwise(0) + 250 + 40 * F.least(F.size("topics"), F.lit(5))
        + F.when(F.length("text") < 500, -50).when(F.length("text") > 5000, 120).otherwise(0)
    )
    d = t.document.select("doc_id", "publisher", score.cast("bigint").alias("score"))
    return d.withColumn("_n", place(["publisher"], F.desc("score"), "doc_id")).where("_n <= 5").drop("_n")


_JUDGED = f"""{_LEX_DENSE}, {_FUSED}, hybrid AS (SELECT question, doc_id, row_number() OVER (PARTITION BY question ORDER BY {sql.rounded('score', 8)} DESC, doc_id) AS rank FROM fused),
    ranked AS (SELECT 'words' AS mode, question, doc_id, rank FROM lex UNION ALL SELECT 'vector', question, doc_id, rank FROM dense_d UNION ALL SELECT 'hybrid', question, doc_id, rank FROM hybrid),
    judged AS (SELECT mode, question, r.doc_id, rank, a.label = b.label AS good FROM ranked r JOIN embeddings a ON r.doc_id = a.vec_id JOIN embeddings b ON r.question = b.vec_id WHERE r.doc_id <> r.question),
    k AS (SELECT *, row_number() OVER (PARTITION BY mode, question ORDER BY rank, doc_id) AS nth FROM judged), asked AS (SELECT DISTINCT question FROM q WHERE question IN (SELECT vec_id FROM embeddings)),
    scored AS (SELECT m.mode, a.question, min(nth) FILTER (good AND nth <= 10) AS rank FROM asked a CROSS JOIN (VALUES ('words'), ('vector'), ('hybrid')) m(mode) LEFT JOIN k ON k.mode = m.mode AND k.question = a.question GROUP BY ALL)"""


def judged(t) -> dict[str, DataFrame]:
    """Retrieval scores by words, by vectors and by both; a document is right if its vector has the label of the question's."""
    words, dense = both_rankings(t)
    f = r.fused([("words", words, 1), ("vector", dense, 1)], _DOC)
    hybrid = f.withColumn("rank", place(["question"], F.desc(rounded(F.col("score"), 8)), "doc_id"))
    label = t["embeddings"].select(F.col("vec_id").alias("doc_id"), "label")
    own = label.select(F.col("doc_id").alias("question"), F.col("label").alias("own"))
    asked = doc_questions(t).select("question").distinct().join(own, "question", "left_semi")

    def score(ranked: DataFrame) -> DataFrame:
        rows = ranked.where("doc_id <> question").join(label, "doc_id").join(own, "question").withColumn("good", F.col("label") == F.col("own"))
        return r.retrieval_score(rows, asked)

    return {"words": score(words), "vector": score(dense), "hybrid": score(hybrid)}


@query(f"WITH {_JUDGED} SELECT question, rank IS NOT NULL AS hit, rank, {sql.rounded('coalesce(1.0e0 / rank, 0.0e0)', 6)} AS mrr FROM scored WHERE mode = 'hybrid'")
def q_score_retrieval(t):
    return judged(t)["hybrid"]


@query(f"WITH {_JUDGED} SELECT mode, count(*) AS cases, {sql.rounded('count(rank) / count(*)')} AS hit_at_10, {sql.mean(sql.rounded('coalesce(1.0e0 / rank, 0.0e0)', 6))} AS mrr FROM scored GROUP BY mode")
def agg_ablation(t):
    """hit@10 and MRR by words alone, vectors alone and both."""
    rows = None
    for name, df in judged(t).items():
        one = df.withColumn("mode", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("mode").agg(F.count("*").alias("cases"), share(F.count_if("hit"), F.count("*")).alias("hit_at_10"), mean("mrr").alias("mrr"))


@query(f"WITH {_JUDGED} SELECT question, max(mode) AS missed_by FROM scored WHERE rank IS NULL AND mode IN ('words', 'vector') GROUP BY question HAVING count(*) = 1")
def set_symdiff_misses(t):
    """Questions that exactly one of the two retrievers misses."""
    s = judged(t)
    a, b = (s[k].where("not hit").select("question") for k in ("words", "vector"))
    return a.join(b, "question", "left_anti").withColumn("missed_by", F.lit("words")).unionByName(b.join(a, "question", "left_anti").withColumn("missed_by", F.lit("vector")))


@query(f"WITH {_JUDGED}, c AS (SELECT s.*, d.role AS category FROM scored s JOIN document d ON s.question = d.doc_id WHERE mode = 'hybrid') SELECT coalesce(category, 'all') AS category, count(*) AS cases, {sql.rounded('count(rank) / count(*)')} AS hit_at_k, {sql.mean(sql.rounded('coalesce(1.0e0 / rank, 0.0e0)', 6))} AS mrr FROM c GROUP BY GROUPING SETS ((category), ())")
def agg_eval_summary(t):
    """Retrieval scores overall and by category in one pass."""
    c = judged(t)["hybrid"].join(t["documents"].select(F.col("doc_id").alias("question"), F.col("lang").alias("category")), "question")
    out = c.groupingSets([[F.col("category")], []], F.col("category")).agg(F.count("*").alias("cases"), share(F.count_if("hit"), F.count("*")).alias("hit_at_k"), mean("mrr").alias("mrr"))
    return out.select(F.coalesce("category", F.lit("all")).alias("category"), "cases", "hit_at_k", "mrr")


@query(f"WITH {_LEX_DENSE} SELECT question, doc_id, rank FROM lex WHERE doc_id IN (SELECT doc_id FROM document WHERE eligible AND current) UNION ALL SELECT question, doc_id, rank FROM lex WHERE question NOT IN (SELECT question FROM lex WHERE doc_id IN (SELECT doc_id FROM document WHERE eligible AND current))")
def join_semi_published(t):
    """Hits in current documents; questions that have none keep all their hits."""
    words = doc_ranking(t, 100).select("question", "doc_id", "rank")
    some = words.join(t.document.where("eligible and current").select("doc_id"), "doc_id", "left_semi")
    return some.unionByName(words.join(some.select("question").distinct(), "question", "left_anti"))


@query(f"WITH {_LEX_DENSE} SELECT question, doc_id, score, score >= 0.3e0 * max(score) OVER (PARTITION BY question) AS kept FROM lex")
def flt_similarity(t):
    from pyspark.sql import Window

    words = doc_ranking(t, 100)
    return words.select("question", "doc_id", "score", (F.col("score") >= 0.3 * F.max("score").over(Window.partitionBy("question"))).alias("kept"))


@query(f"WITH {_Q}, {sql.postings('chunk', 'doc_id, idx', 'body')}, {sql.lexical('doc_id, idx', 30)}, p AS (SELECT question, doc_id, idx, rank FROM lex QUALIFY row_number() OVER (PARTITION BY question, doc_id ORDER BY rank) <= 2) SELECT question, doc_id, idx, 'S' || row_number() OVER (PARTITION BY question ORDER BY rank) AS passage FROM p QUALIFY row_number() OVER (PARTITION BY question ORDER BY rank) <= 12")
def q_numbered_passages(t):
    """Two passages of each document hit, up to twelve, numbered S1, S2, ..."""
    hits = r.cap(chunk_ranking(t, 30), ["doc_id"], 2).withColumn("_n", place(["question"], "rank")).where("_n <= 12")
    return hits.select("question", "doc_id", "idx", F.concat(F.lit("S"), F.col("_n").cast("string")).alias("passage"))


@query(f"WITH {_Q}, {sql.postings('chunk', 'doc_id, idx', 'body')}, {sql.lexical('doc_id, idx', 8)}, m AS (SELECT question, doc_id, section, max(idx) AS last FROM lex JOIN chunk USING (doc_id, idx) GROUP BY ALL) SELECT question, m.doc_id, m.section, last, min(c.idx) AS following FROM m LEFT JOIN chunk c ON c.doc_id = m.doc_id AND c.section = m.section AND c.idx > last GROUP BY ALL")
def join_adjacent_chunk(t):
    """The first chunk after the last one chosen in the same section."""
    hits = chunk_ranking(t, 8).join(t.chunk.select("doc_id", "idx", "section"), _CHUNK)
    last = hits.groupBy("question", "doc_id", "section").agg(F.max("idx").alias("last"))
    after = t.chunk.select("doc_id", "section", F.col("idx").alias("i"))
    both = last.join(after, ["doc_id", "section"], "left")
    return both.groupBy("question", "doc_id", "section", "last").agg(F.min(F.when(F.col("i") > F.col("last"), F.col("i"))).alias("following"))
