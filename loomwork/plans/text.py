"""Queries of text functions, line operators and text filters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwork.functions import text as x
from loomwork.operators import lines as ln
from loomwork.operators import packing as pk
from loomwork.operators import names as nm
from loomwork.operators.common import distinct_listed, place, rounded
from loomwork.plans import sqltext as sql
from loomwork.plans.registry import query

_W = "regexp_extract_all(lower(text), '[a-z]+')"


@query(f"SELECT doc_id, md5({sql.squeezed('text')}) AS squeezed, md5(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS plain FROM documents")
def fn_norm_text(t):
    return t["documents"].select("doc_id", F.md5(x.squeezed("text")).alias("squeezed"), F.md5(x.alnum_only("text")).alias("plain"))


_SING = "list_transform(regexp_extract_all(lower(p_name || ' ' || p_type || ' keys series'), '[0-9a-z]+'), lambda w: CASE WHEN w LIKE '%ies' AND length(w) > 4 THEN left(w, length(w) - 3) || 'y' WHEN w LIKE '%s' AND length(w) >= 5 AND NOT (w LIKE '%ss' OR w LIKE '%us' OR w LIKE '%is') THEN left(w, length(w) - 1) ELSE w END)"


@query(f"""SELECT p_partkey, array_to_string(CASE WHEN k[-1] = 'key' THEN k[1:len(k)-1] ELSE k END, '') AS key, array_to_string(s, '') AS full_key FROM
    (SELECT p_partkey, s, CASE WHEN s[-1] = 'sery' THEN s[1:len(s)-1] ELSE s END AS k FROM (SELECT p_partkey, {_SING} AS s FROM part))""")
def fn_concept_key(t):
    """Names as keys: singular words run together, the last words "key" and "sery" dropped."""
    name = F.concat_ws(" ", "p_name", "p_type", F.lit("keys series"))
    return t["part"].select("p_partkey", x.concept_key(name, ["sery", "key"]).alias("key"), x.concept_key(name).alias("full_key"))


@query("""SELECT p_partkey, upper(array_to_string(list_transform(list_filter(regexp_split_to_array(regexp_replace(p_name || ' (' || p_brand || ') ' || p_type, '\\([^)]*\\)', ' ', 'g'), '[\\s-]+'), lambda w: w <> ''), lambda w: left(w, 1)), '')) AS acronym FROM part""")
def fn_acronym(t):
    return t["part"].select("p_partkey", x.acronym(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(") "), "p_type")).alias("acronym"))


@query("""WITH n AS (SELECT DISTINCT lower(p_name) || ' ' || lower(p_type) AS name FROM part) SELECT a.name AS a, b.name AS b, CAST(levenshtein(a.name, b.name) AS BIGINT) AS distance FROM n a JOIN n b ON a.name < b.name
    WHERE 1 - levenshtein(a.name, b.name) / CAST(greatest(length(a.name), length(b.name)) AS DOUBLE) >= 0.7e0""")
def join_entity_pairs(t):
    """Pairs of distinct names whose edit distance leaves a ratio of 0.7 or more."""
    names = t["part"].select(F.concat_ws(" ", F.lower("p_name"), F.lower("p_type")).alias("name")).distinct()
    return nm.similar_names(names, 0.7).select("a", "b", "distance")


@query()
def join_concept_pairs(t):
    """Candidate duplicates of concept names: alike letters (ratio 0.88 or more by matching blocks) or one the acronym of the other."""
    names = t["part"].select(F.concat_ws(" ", F.lower("p_name"), F.lower("p_type")).alias("name")).distinct()
    return nm.concept_pairs(names, 0.88)


@query("""WITH u AS (SELECT conv_id, turn, lower(trim(text)) AS q, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS w, lag(lower(trim(text))) OVER (PARTITION BY conv_id ORDER BY turn, text) AS p,
    lag(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]+')))) OVER (PARTITION BY conv_id ORDER BY turn, text) AS pw FROM turn WHERE role = 'user')
    SELECT conv_id, turn, """ + sql.rounded("CASE WHEN q = p THEN 1.0e0 WHEN contains(q, p) OR contains(p, q) THEN 0.8e0 ELSE len(list_intersect(w, pw)) / CAST(greatest(len(w), len(pw), 1) AS DOUBLE) END") + " AS similarity FROM u WHERE p IS NOT NULL")  # fmt: skip
def fn_question_similarity(t):
    """Each question of a conversation against the one before: equal 1, contained 0.8, else shared words over the longer."""
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    u = t.turn.where("role = 'user'").select("conv_id", "turn", F.lower(F.trim("text")).alias("q"), F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"))).alias("w"), "text")
    u = u.withColumn("p", F.lag("q").over(w)).withColumn("pw", F.lag("w").over(w)).where("p is not null")
    return u.select("conv_id", "turn", rounded(nm.question_similarity(F.col("q"), F.col("p"), F.col("w"), F.col("pw"))).alias("similarity"))


_QA = "0.4e0 * len(list_intersect(w, pw)) / CAST(greatest(len(w), 1) AS DOUBLE) + CASE WHEN q = p THEN 0.3e0 WHEN contains(q, p) OR contains(p, q) THEN 0.2e0 ELSE 0.0e0 END + 0.3e0 * len(list_filter(w, lambda k: contains(p, k))) / CAST(greatest(len(w), 1) AS DOUBLE)"


@query("WITH u AS (SELECT conv_id, turn, lower(trim(text)) AS q, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w, lag(lower(trim(text))) OVER o AS p, lag(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) OVER o AS pw FROM turn WINDOW o AS (PARTITION BY conv_id ORDER BY turn, text)) "
       f"SELECT conv_id, turn, {sql.rounded(_QA)} AS similarity FROM u WHERE p IS NOT NULL")  # fmt: skip
def fn_qa_similarity(t):
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    u = t.turn.select("conv_id", "turn", F.lower(F.trim("text")).alias("q"), F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"))).alias("w"), "text")
    u = u.withColumn("p", F.lag("q").over(w)).withColumn("pw", F.lag("w").over(w)).where("p is not null")
    return u.select("conv_id", "turn", rounded(nm.qa_similarity(F.col("q"), F.col("p"), F.col("w"), F.col("pw"))).alias("similarity"))


@query("SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '[.;\\n]'), lambda s: trim(s)), lambda s: length(s) > 10)[1:5], ' / ') AS points FROM documents")
def fn_qa_key_points(t):
    parts = F.filter(F.transform(F.split("text", r"[.;\n]"), lambda s: F.trim(s)), lambda s: F.length(s) > 10)
    return t["documents"].select("doc_id", F.array_join(F.slice(parts, 1, 5), " / ").alias("points"))


@query("SELECT doc_id, list_filter(string_split(text, chr(10)), lambda s: length(trim(s)) > 20 AND left(trim(s), 1) NOT IN ('#', '|', '>', '-'))[1] AS summary FROM documents")
def fn_summary_line(t):
    """The first long line that isn't markup."""
    good = F.filter(F.split("text", "\n"), lambda s: (F.length(F.trim(s)) > 20) & ~F.substring(F.trim(s), 1, 1).isin("#", "|", ">", "-"))
    return t["documents"].select("doc_id", F.try_element_at(good, F.lit(1)).alias("summary"))


@query(f"WITH w AS (SELECT doc_id, unnest({_W}) AS w, unnest(range(len({_W}))) AS k FROM documents), u AS (SELECT doc_id, w, min(k) AS k FROM w GROUP BY doc_id, w), f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k) <= 5) SELECT d.doc_id AS doc_id, coalesce(string_agg(w, ' ' ORDER BY k), '') AS keywords FROM documents d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id")
def fn_extract_keywords(t):
    """The first five distinct words of each document."""
    return t["documents"].select("doc_id", F.array_join(F.slice(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"))), 1, 5), " ").alias("keywords"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[^A-Za-z0-9 .,:;!?/-]', '', 'g'), ' +', ' ', 'g')) AS clean FROM pages")
def fn_sanitize(t):
    y = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), "[^A-Za-z0-9 .,:;!?/-]", ""), " +", " ")
    return t["pages"].select("page_id", F.trim(y).alias("clean"))


_HINT = "p_brand || ' case ' || (p_size % 10) || '-' || (p_size % 10 + 3)"


@query(f"SELECT p_partkey, CAST(unnest(range(CAST(regexp_extract({_HINT}, 'case ([0-9]+)-([0-9]+)', 1) AS BIGINT), CAST(regexp_extract({_HINT}, 'case ([0-9]+)-([0-9]+)', 2) AS BIGINT) + 1)) AS BIGINT) AS case_no FROM part")
def fn_case_hints(t):
    """A range of cases in a text as one row for each case."""
    text = F.concat("p_brand", F.lit(" case "), (F.col("p_size") % 10).cast("string"), F.lit("-"), (F.col("p_size") % 10 + 3).cast("string"))
    of = lambda k: F.regexp_extract(text, "case ([0-9]+)-([0-9]+)", k).cast("bigint")
    return t["part"].select("p_partkey", F.explode(F.sequence(of(1), of(2))).alias("case_no"))


@query("SELECT DISTINCT case_id, CAST(regexp_extract(case_id, '([0-9]+)', 1) AS INTEGER) AS number FROM measurement")
def fn_case_number(t):
    return t.measurement.select("case_id").distinct().withColumn("number", F.regexp_extract("case_id", "([0-9]+)", 1).cast("int"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(s, '[A-Z]{2,5}[0-9]{1,3}'), lambda c: lower(c)))), ',') AS codes FROM (SELECT p_partkey, upper(left(p_type, 3)) || p_size || ' and ' || p_name || ' ' || replace(upper(p_brand), '#', '') AS s FROM part)")
def fn_title_codes(t):
    s = F.concat(F.upper(F.substring("p_type", 1, 3)), F.col("p_size").cast("string"), F.lit(" and "), "p_name", F.lit(" "), F.replace(F.upper("p_brand"), F.lit("#"), F.lit("")))
    return t["part"].select("p_partkey", F.array_join(x.title_codes(s), ",").alias("codes"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs'), '<(br|/p|/h[1-6]|/li|/div|/tr)[^>]*>', chr(10), 'gi'), '<[^>]*>', ' ', 'g'),
    '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t]+', ' ', 'g'), ' ?\n[\s]*', chr(10), 'g')) AS body FROM pages""")
def fn_clean_markup(t):
    return t["pages"].select("page_id", x.strip_tags("html").alias("body"))


@query("SELECT page_id, regexp_replace(html, 'data:image/[a-z]+;base64,[A-Za-z0-9+/=]+', '', 'gi') = html AS untouched, length(regexp_replace(html, '<img[^>]*>', '', 'gi')) AS size FROM pages")
def fn_strip_base64(t):
    bare = F.regexp_replace("html", r"(?i)data:image/[a-z]+;base64,[A-Za-z0-9+/=]+", "")
    return t["pages"].select("page_id", (bare == F.col("html")).alias("untouched"), F.length(F.regexp_replace("html", "(?i)<img[^>]*>", "")).cast("bigint").alias("size"))


@query("SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1))), ' ') AS refs FROM pages")
def fn_image_refs(t):
    """References of a page, each once."""
    return t["pages"].select("page_id", F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))), " ").alias("refs"))


_CELLS = "list_transform(string_split(body, '|'), lambda c: trim(c))"


@query(f"SELECT doc_id, idx, len({_CELLS}) AS width, '| ' || array_to_string(list_concat({_CELLS}, list_transform(range(greatest(12 - len({_CELLS}), 0)), lambda i: '')), ' | ') || ' |' AS line FROM chunk WHERE contains(body, ' | ')")
def fn_markdown_table(t):
    """Lines with cells as rows of a table of twelve or more columns."""
    rows = t.chunk.where(F.contains("body", F.lit(" | ")))
    return rows.select("doc_id", "idx", F.size(x.table_cells("body")).cast("bigint").alias("width"), x.markdown_row(x.table_cells("body"), F.lit(12)).alias("line"))


@query(f"""WITH c AS (SELECT doc_id, idx, unnest({_CELLS}) AS cell, unnest(range(len({_CELLS}))) AS k FROM chunk WHERE contains(body, ' | '))
    SELECT doc_id, k, count(*) AS n_rows, count(*) FILTER (cell NOT IN ('', 'NaN', 'Unnamed')) AS filled FROM c GROUP BY doc_id, k HAVING count(*) FILTER (cell NOT IN ('', 'NaN', 'Unnamed')) > 0""")
def fn_clean_table_md(t):
    """Columns of each document's table lines that hold anything, with their filled cells."""
    c = t.chunk.where(F.contains("body", F.lit(" | "))).select("doc_id", F.posexplode(x.table_cells("body")).alias("k", "cell"))
    good = ~F.col("cell").isin("", "NaN", "Unnamed")
    return c.groupBy("doc_id", F.col("k").cast("bigint").alias("k")).agg(F.count("*").alias("n_rows"), F.count_if(good).alias("filled")).where("filled > 0")


@query("SELECT doc_id, count(*) AS table_lines, max(len(string_split(body, '|'))) AS most_cells, count(*) FILTER (regexp_matches(body, '[0-9]')) AS with_numbers FROM chunk WHERE contains(body, '|') GROUP BY doc_id")
def fn_table_rows(t):
    rows = t.chunk.where(F.contains("body", F.lit("|")))
    return rows.groupBy("doc_id").agg(F.count("*").alias("table_lines"), F.max(F.size(F.split("body", r"\|"))).cast("bigint").alias("most_cells"), F.count_if(F.col("body").rlike("[0-9]")).alias("with_numbers"))


@query("SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) < 20 THEN NULL ELSE 'en' END AS guess, lang FROM documents")
def fn_detect_language(t):
    """The rough rule for Han and Latin text (these documents hold no Han characters)."""
    return t["documents"].select("doc_id", x.language_guess("text").alias("guess"), "lang")


_RUNS = rf"list_transform(regexp_extract_all(regexp_replace(text, '{x.SPACED_UNIT}', '\1\2_\3', 'g'), '{x.VALUE_RUN}'), lambda v: regexp_replace(v, '^[.-]+|[.-]+$', '', 'g'))"
_VALUES = f"list_transform({_RUNS}, lambda v: CASE WHEN regexp_matches(v, '{x.JOINED_UNIT}') THEN replace(v, '_', ' ') ELSE v END)"
_STATED = f"list_filter({_VALUES}, lambda v: regexp_matches(v, '[0-9]') AND NOT regexp_matches(v, '{x.ORDINAL}') AND (NOT regexp_matches(v, '^[0-9]+$') OR length(v) >= 3))"


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct({_STATED})), ' ') AS stated FROM documents")
def fn_extract_values(t):
    return t["documents"].select("doc_id", F.array_join(F.array_sort(x.stated_values("text")), " ").alias("stated"))


_ROUTES = (("radio", ("the", "than", "thion")), ("network", ("der", "und", "nicht")), ("power", ("que", "dans", "eau")))
_SCORE = {zone: " + ".join(f"CASE WHEN regexp_matches(lower(text), '(^|[^A-Za-z0-9]){w}([^A-Za-z0-9]|$)') THEN {len(w)} ELSE 0 END" for w in words) for zone, words in _ROUTES}


@query(f"SELECT doc_id, CAST({_SCORE['radio']} AS INTEGER) AS radio, CAST({_SCORE['network']} AS INTEGER) AS network, CAST({_SCORE['power']} AS INTEGER) AS power FROM documents")
def fn_keyword_route(t):
    """Score of each zone: the letters of its keywords that stand in the text as whole words."""
    low = F.lower("text")
    score = lambda words: sum((F.when(x.whole_word(low, w), len(w)).otherwise(0) for w in words), F.lit(0))
    return t["documents"].select("doc_id", *[score(words).alias(zone) for zone, words in _ROUTES])


@query("SELECT doc_id, CASE WHEN lang = 'fr' OR contains(text, 'eau') THEN 'west' WHEN contains(text, 'sch') OR contains(text, 'und') THEN 'middle' WHEN contains(text, 'th') THEN 'north' ELSE 'other' END AS zone FROM documents")
def fn_resolve_zone(t):
    rest = x.ordered_rules(F.col("text"), [("west", ["eau"]), ("middle", ["sch", "und"]), ("north", ["th"])], "other")
    return t["documents"].select("doc_id", F.when(F.col("lang") == "fr", "west").otherwise(rest).alias("zone"))


@query(f"WITH d AS (SELECT doc_id, list_distinct({_W}) AS w FROM documents) SELECT a.doc_id AS doc_id, len(list_intersect(a.w, b.w)) AS shared FROM d a JOIN d b ON b.doc_id = a.doc_id - 1")
def fn_grams(t):
    """Distinct words that a document shares with the one before it."""
    d = t["documents"].select("doc_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"))).alias("w"))
    b = d.select((F.col("doc_id") + 1).alias("doc_id"), F.col("w").alias("v"))
    return d.join(b, "doc_id").select("doc_id", F.size(F.array_intersect("w", "v")).cast("bigint").alias("shared"))


@query("SELECT doc_id, sha256(doc_id || chr(10) || source) AS package_id, md5(text) AS text_md5, doc_id || '@' || source || '::chunk::0::' || left(sha256(text), 16) AS chunk_id FROM documents")
def fn_hash_ids(t):
    chunk = F.concat(F.col("doc_id").cast("string"), F.lit("@"), "source", F.lit("::chunk::0::"), F.substring(F.sha2("text", 256), 1, 16))
    return t["documents"].select("doc_id", F.sha2(F.concat_ws("\n", F.col("doc_id").cast("string"), "source"), 256).alias("package_id"), F.md5("text").alias("text_md5"), chunk.alias("chunk_id"))


_SYNONYMS = (("small", ("mini", "little")), ("large", ("big",)), ("widget", ("gadget",)), ("bolt", ("screw", "pin")))


@query("""WITH s AS (SELECT * FROM (VALUES ('small', 'mini'), ('small', 'little'), ('large', 'big'), ('widget', 'gadget'), ('bolt', 'screw'), ('bolt', 'pin')) v(word, other)), k AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS keyword FROM part)
    SELECT p_partkey, array_to_string(list_sort(list(DISTINCT term)), ' ') AS terms FROM (SELECT p_partkey, unnest([keyword, lower(keyword), upper(keyword)]) AS term FROM k UNION ALL SELECT p_partkey, other FROM k JOIN s ON contains(word, keyword) OR contains(keyword, word)) GROUP BY p_partkey""")
def fn_expand_synonyms(t):
    """Words of a name with their other cases and synonyms (a key in a word, or a word in a key)."""
    k = t["part"].select("p_partkey", F.explode(F.split("p_name", " ")).alias("k"))
    own = F.array("k", F.lower("k"), F.upper("k"))
    more = [F.when(F.contains(F.lit(word), F.col("k")) | F.contains(F.col("k"), F.lit(word)), F.array(*map(F.lit, others))).otherwise(F.array().cast("array<string>")) for word, others in _SYNONYMS]
    return k.select("p_partkey", F.explode(F.concat(own, *more)).alias("term")).groupBy("p_partkey").agg(distinct_listed(F.col("term"), " ").alias("terms"))


_RULES = ((("mandatory", "than"), ("required", "must")), (("survey", "der"), ("poll",)), (("reh", "que"), ("period", "time")))


@query(f"SELECT item_id, array_to_string(list_sort(list_distinct(list_concat({sql.tokens('text')}, " + ", ".join("CASE WHEN " + " OR ".join(f"regexp_matches(lower(text), '(^|[^A-Za-z0-9]){w}([^A-Za-z0-9]|$)')" for w in when) + f" THEN {list(add)} ELSE [] END" for when, add in _RULES) + "))), ' ') AS terms FROM item")
def fn_query_expansion(t):
    """Query terms and those that rules add where one of their words occurs."""
    low = F.lower("text")
    more = []
    for when, add in _RULES:
        hit = x.whole_word(low, when[0])
        for w in when[1:]:
            hit = hit | x.whole_word(low, w)
        more.append(F.when(hit, F.array(*map(F.lit, add))).otherwise(F.array().cast("array<string>")))
    return t.item.select("item_id", F.array_join(F.array_sort(F.array_distinct(F.concat(x.tokens("text"), *more))), " ").alias("terms"))


_FIGURE = ("figure", "diagram", "chart", "table", "tion th")


@query("SELECT item_id, " + " OR ".join(f"contains(lower(text), '{w}')" for w in _FIGURE) + " AS figure FROM item")
def fn_figure_intent(t):
    return t.item.select("item_id", x.any_of(F.lower("text"), _FIGURE).alias("figure"))


_INTENTS = (("compare", ("than", "versus", "er ")), ("lookup", ("what", "the ", "is ")), ("list", ("all", "and", ",")))


@query("WITH v AS (SELECT item_id, " + ", ".join("(" + " + ".join(f"CAST(regexp_matches(lower(text), '{w}') AS INT)" for w in words) + f") AS {k}" for k, words in _INTENTS) + f" FROM item) SELECT item_id, CASE WHEN greatest(compare, lookup, list) = 0 THEN 'general' WHEN compare = greatest(compare, lookup, list) THEN 'compare' WHEN lookup = greatest(compare, lookup, list) THEN 'lookup' ELSE 'list' END AS intent, {sql.rounded('least(greatest(compare, lookup, list) / 3.0e0, 1.0e0)')} AS confidence FROM v")
def fn_classify_intent(t):
    """Votes of patterns for each intent; the first with the most wins, confidence a third for each vote."""
    low = F.lower("text")
    v = t.item.select("item_id", *[sum((low.rlike(w).cast("int") for w in words), F.lit(0)).alias(k) for k, words in _INTENTS])
    best = F.greatest(*[F.col(k) for k, _ in _INTENTS])
    name = F.when(best == 0, "general")
    for k, _ in _INTENTS:
        name = name.when(F.col(k) == best, k)
    return v.select("item_id", name.alias("intent"), rounded(F.least(best / 3, F.lit(1.0))).alias("confidence"))


@query("""SELECT conv_id, turn, CASE WHEN contains(lower(text), ' vs ') OR contains(lower(text), 'versus') THEN 'compare' WHEN contains(lower(text), 'how') THEN 'procedure' WHEN contains(lower(text), 'the') THEN 'lookup' ELSE 'general' END AS intent,
    CASE WHEN length(text) > 400 OR length(text) - length(replace(text, '?', '')) > 1 THEN 'high' WHEN length(text) > 120 THEN 'medium' ELSE 'low' END AS complexity,
    CASE WHEN length(text) > 400 THEN 'deep' WHEN contains(lower(text), 'the') THEN 'hybrid' WHEN length(text) > 120 THEN 'vector' ELSE 'basic' END AS mode FROM turn WHERE role = 'user'""")
def fn_query_intent(t):
    """Intent, complexity and retrieval mode of each question by ordered rules."""
    low, size = F.lower("text"), F.length("text")
    marks = size - F.length(F.replace("text", F.lit("?"), F.lit("")))
    return t.turn.where("role = 'user'").select(
        "conv_id", "turn", x.ordered_rules(low, [("compare", [" vs ", "versus"]), ("procedure", ["how"]), ("lookup", ["the"])], "general").alias("intent"),
        F.when((size > 400) | (marks > 1), "high").when(size > 120, "medium").otherwise("low").alias("complexity"),
        F.when(size > 400, "deep").when(F.contains(low, F.lit("the")), "hybrid").when(size > 120, "vector").otherwise("basic").alias("mode"),
    )


@query("SELECT conv_id, turn, regexp_matches(text, '[0-9]') AS numeric_, regexp_matches(lower(text), 'report|test|tion') AS report_like, regexp_matches(lower(text), 'speed|rate|perf') AS performance, regexp_matches(lower(text), 'summary|all|the') AS summary, regexp_matches(lower(text), ' vs |than|compare') AS compare_like FROM turn")
def q_query_type_flags(t):
    low = F.lower("text")
    return t.turn.select(
        "conv_id", "turn", F.col("text").rlike("[0-9]").alias("numeric_"), low.rlike("report|test|tion").alias("report_like"), low.rlike("speed|rate|perf").alias("performance"),
        low.rlike("summary|all|the").alias("summary"), low.rlike(" vs |than|compare").alias("compare_like"),
    )


@query("SELECT conv_id, turn FROM turn WHERE regexp_matches(lower(trim(text)), '^(hi|hello|thanks|ok|bye)[!. ]*$') OR regexp_matches(trim(text), '^[A-Za-z0-9]{1,10}$') OR trim(text) = ''")
def flt_irrelevant(t):
    """Turns that are no questions: greetings and one to ten letters or digits."""
    y = F.trim("text")
    return t.turn.where(F.lower(y).rlike("^(hi|hello|thanks|ok|bye)[!. ]*$") | y.rlike("^[A-Za-z0-9]{1,10}$") | (y == "")).select("conv_id", "turn")


@query("SELECT doc_id, idx FROM chunk WHERE contains(lower(body), 'tionth') OR contains(lower(body), 'eauer') OR contains(lower(body), 'schen')")
def flt_any_keyword(t):
    return t.chunk.where(x.any_of(F.lower("body"), ["tionth", "eauer", "schen"])).select("doc_id", "idx")


@query("SELECT doc_id FROM document WHERE list_bool_and(list_transform(['th', 'src', 'en'], lambda w: contains(lower(title || ' ' || publisher || ' ' || role), w)))")
def flt_all_terms(t):
    hay = F.lower(F.concat_ws(" ", "title", "publisher", "role"))
    return t.document.where(F.forall(F.split(F.lit("th src en"), " "), lambda w: F.contains(hay, w))).select("doc_id")


@query("SELECT p_partkey FROM part WHERE contains(replace(replace(lower(p_brand || '-' || p_name), '-', ''), '_', ''), 'brand#1red') OR list_contains(string_split(p_name, ' '), 'blue')")
def flt_doc_tokens(t):
    """A name without its dashes and underscores, or one of its words."""
    bare = F.replace(F.replace(F.lower(F.concat_ws("-", "p_brand", "p_name")), F.lit("-"), F.lit("")), F.lit("_"), F.lit(""))
    return t["part"].where(F.contains(bare, F.lit("brand#1red")) | F.exists(F.split("p_name", " "), lambda w: w == "blue")).select("p_partkey")


@query("SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www\\.', '') AS host, regexp_replace(url, '#.*$', '') AS link FROM pages WHERE url LIKE 'https://%' AND (regexp_extract(url, '^https?://([^/?#]+)', 1) LIKE '%example.com' OR regexp_extract(url, '^https?://([^/?#]+)', 1) LIKE '%example.org')")
def flt_safe_link(t):
    """Links by https to the own sites, without their fragment."""
    host = F.parse_url("url", F.lit("HOST"))
    rows = t["pages"].where(F.startswith("url", F.lit("https://")) & (F.endswith(host, F.lit("example.com")) | F.endswith(host, F.lit("example.org"))))
    return rows.select("page_id", F.parse_url("url", F.lit("PROTOCOL")).alias("scheme"), F.regexp_replace(host, r"^www\.", "").alias("host"), F.regexp_replace("url", "#.*$", "").alias("link"))


@query("SELECT page_id, regexp_matches(lower(url), '/(tmp|cache|node_modules|25)(/|#|$)') AS noise, regexp_matches(lower(url), '(^|[^a-z0-9])(pay|hr|id)([^a-z0-9]|$)|password') AS sensitive FROM pages")
def flt_noise_path(t):
    """Paths to leave out, and sensitive ones; short terms count only as whole words."""
    low = F.lower("url")
    return t["pages"].select("page_id", low.rlike("/(tmp|cache|node_modules|25)(/|#|$)").alias("noise"), low.rlike("(^|[^a-z0-9])(pay|hr|id)([^a-z0-9]|$)|password").alias("sensitive"))


@query("SELECT page_id FROM pages WHERE regexp_matches(lower(regexp_extract(html, '<title>([^<]*)', 1)), '(^|[^a-z0-9])(that|und|que)([^a-z0-9]|$)')")
def flt_feed_relevant(t):
    title = F.lower(F.regexp_extract("html", "<title>([^<]*)", 1))
    return t["pages"].where(title.rlike("(^|[^a-z0-9])(that|und|que)([^a-z0-9]|$)")).select("page_id")


_DENSE = "len(regexp_extract_all(lower(text), 'tion|eau|sch')) / CAST(greatest(length(text), 1) AS DOUBLE) * 1000"


@query(f"SELECT doc_id, {sql.rounded(_DENSE)} AS density, {_DENSE} >= 20 OR contains(title, 'the') AS relevant FROM document")
def flt_window_relevant(t):
    """Words of the field for each thousand characters, or one in the title."""
    density = F.regexp_count(F.lower("text"), F.lit("tion|eau|sch")) / F.greatest(F.length("text"), F.lit(1)) * 1000
    return t.document.select("doc_id", rounded(density).alias("density"), ((density >= 20) | F.contains("title", F.lit("the"))).alias("relevant"))


@query("""WITH o AS (SELECT doc_id, text, unnest(string_split(title, ' ')) AS offered, unnest(range(len(string_split(title, ' ')))) AS k FROM document), u AS (SELECT doc_id, offered, min(k) AS k FROM o WHERE contains(lower(text), lower(offered)) AND length(offered) >= 3 GROUP BY ALL)
    SELECT doc_id, offered FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k) <= 3""")
def flt_semantic_grounded(t):
    """Offered words that stand in the text, each once, at most three of a document."""
    o = t.document.select("doc_id", "text", F.posexplode(F.split("title", " ")).alias("k", "offered"))
    o = o.where(F.contains(F.lower("text"), F.lower("offered")) & (F.length("offered") >= 3)).groupBy("doc_id", "offered").agg(F.min("k").alias("k"))
    return o.withColumn("_n", place(["doc_id"], "k")).where("_n <= 3").select("doc_id", "offered")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'sheet ' || p_type || ' row ' || p_size WHEN p_size % 3 = 1 THEN 'page ' || p_size ELSE '' END AS label FROM part")
def fn_location_label(t):
    k, n = F.col("p_size") % 3, F.col("p_size").cast("string")
    return t["part"].select("p_partkey", F.when(k == 0, F.concat(F.lit("sheet "), "p_type", F.lit(" row "), n)).when(k == 1, F.concat(F.lit("page "), n)).otherwise("").alias("label"))


@query("SELECT p_partkey, CASE WHEN p_type LIKE 'ECO%' THEN 'economy' WHEN p_type LIKE 'SM%' OR p_type LIKE 'MED%' THEN 'standard' ELSE 'other' END AS report_type, regexp_extract(p_brand, '#([0-9]+)', 1) AS project_code, CASE WHEN regexp_matches(p_name, 'red|blue') THEN 'colour' END AS band FROM part")
def fn_report_type(t):
    kind = F.when(F.col("p_type").like("ECO%"), "economy").when(F.col("p_type").like("SM%") | F.col("p_type").like("MED%"), "standard").otherwise("other")
    return t["part"].select("p_partkey", kind.alias("report_type"), F.regexp_extract("p_brand", "#([0-9]+)", 1).alias("project_code"), F.when(F.col("p_name").rlike("red|blue"), "colour").alias("band"))


@query("SELECT o_orderkey, CAST(isoyear(o_orderdate) AS VARCHAR) || '-W' || lpad(CAST(weekofyear(o_orderdate) AS VARCHAR), 2, '0') AS week FROM orders")
def fn_iso_week(t):
    return t["orders"].select("o_orderkey", F.concat(F.extract(F.lit("YEAROFWEEK"), "o_orderdate").cast("string"), F.lit("-W"), F.lpad(F.weekofyear("o_orderdate").cast("string"), 2, "0")).alias("week"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + sql.rounded("CASE l_linenumber % 4 WHEN 0 THEN l_quantity * 1e-6 WHEN 1 THEN l_quantity * 1e-3 WHEN 2 THEN l_quantity * 1.0e0 ELSE l_quantity * 1e3 END", 6) + " AS mbps FROM lineitem")
def fn_si_units(t):
    """Rates written with any prefix, as Mbps."""
    unit = F.element_at(F.array(*map(F.lit, ("bps", "kbps", "Mbps", "Gbps"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    written = F.concat_ws(" ", F.col("l_quantity").cast("string"), unit)
    return t["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rounded(x.megabits(written), 6).alias("mbps"))


@query("SELECT p_partkey, " + sql.rounded("10 * log10(p_retailprice)", 6) + " AS db, " + sql.rounded("pow(10, p_size / 10.0e0)", 6) + " AS ratio, " + sql.rounded("(p_retailprice - 1000) / 1000 * 100", 6) + " AS change_pct, CAST(CASE WHEN p_size < 10 THEN p_size * 1000 WHEN p_size >= 40 THEN p_size // 40 ELSE p_size END AS BIGINT) AS centre FROM part")
def fn_calculator(t):
    """Decibels, their ratio, change in percent, and a frequency scaled by its size."""
    p, n = F.col("p_retailprice"), F.col("p_size")
    return t["part"].select(
        "p_partkey", rounded(10 * F.log10(p), 6).alias("db"), rounded(F.pow(F.lit(10.0), n / 10), 6).alias("ratio"), rounded((p - 1000) / 1000 * 100, 6).alias("change_pct"),
        F.when(n < 10, n * 1000).when(n >= 40, F.floor(n / 40)).otherwise(n).cast("bigint").alias("centre"),
    )


@query("SELECT doc_id, idx, body, level, CASE level WHEN 1 THEN min(CASE WHEN level <= 1 THEN idx END) OVER w ELSE min(CASE WHEN level <= 2 THEN idx END) OVER w END AS until FROM (SELECT doc_id, idx, md5(body) AS body, CASE WHEN idx % 7 = 0 THEN 1 WHEN idx % 3 = 0 THEN 2 END AS level FROM chunk) WHERE level IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)")
def fn_markdown_sections(t):
    """Heading blocks that end at the next heading of the same or a higher level."""
    rows = t.chunk.withColumn("level", F.when(F.col("idx") % 7 == 0, 1).when(F.col("idx") % 3 == 0, 2)).withColumn("body", F.md5("body"))
    return ln.sections(rows.select("doc_id", "idx", "body", "level"), "doc_id", "level", 2)


@query("SELECT doc_id, CASE WHEN instr(text, 'the ') > 0 THEN CASE WHEN instr(substr(text, instr(text, 'the ') + 4), '. ') > 0 THEN left(substr(text, instr(text, 'the ') + 4), CAST(instr(substr(text, instr(text, 'the ') + 4), '. ') - 1 AS BIGINT)) ELSE substr(text, instr(text, 'the ') + 4) END END AS block FROM documents")
def fn_block_between(t):
    return t["documents"].select("doc_id", ln.between(F.col("text"), "the ", ". ").alias("block"))


@query("""WITH r AS (SELECT doc_id, idx, row_number() OVER w AS n, count(*) OVER (PARTITION BY doc_id) AS total, max(CAST(contains(body, '|') AS INT)) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1 AS near FROM chunk WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
    k AS (SELECT * FROM r WHERE n <= 3 OR n > total - 2 OR near) SELECT doc_id, idx, coalesce(n - lag(n) OVER (PARTITION BY doc_id ORDER BY idx) > 1, n > 1) AS gap FROM k""")
def fn_compact_block(t):
    return ln.compact(t.chunk, "doc_id", 3, 2, F.contains("body", F.lit("|"))).select("doc_id", "idx", "gap")


@query("""SELECT doc_id, idx, last_value(CASE WHEN contains(body, ', ') THEN idx END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS head FROM chunk""")
def fn_case_sections(t):
    """Each line with the last line before it that begins a part."""
    return ln.carried(t.chunk, ["doc_id"], "idx", F.when(F.contains("body", F.lit(", ")), F.col("idx")), "head").select("doc_id", "idx", "head")


_FILLED = "last_value(nullif(regexp_extract(body, '([0-9]+)', 1), '') IGNORE NULLS) OVER (PARTITION BY doc_id, section ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query(f"SELECT doc_id, idx, section, {_FILLED} AS number FROM chunk")
def join_case_forward_fill(t):
    """A chunk without a number takes the last one before it in its section."""
    return ln.carried(t.chunk, ["doc_id", "section"], "idx", F.nullif(F.regexp_extract("body", "([0-9]+)", 1), F.lit("")), "number").select("doc_id", "idx", "section", "number")


@query(f"SELECT doc_id, number, count(*) AS n FROM (SELECT doc_id, CAST({_FILLED} AS BIGINT) AS number FROM chunk WHERE length(regexp_extract(body, '([0-9]+)', 1)) < 10) WHERE number IS NOT NULL GROUP BY doc_id, number QUALIFY dense_rank() OVER (PARTITION BY doc_id ORDER BY number DESC) <= 4")
def win_top_cases(t):
    """Chunks of the four highest numbers of each document."""
    short = t.chunk.where(F.length(F.regexp_extract("body", "([0-9]+)", 1)) < 10)
    rows = ln.carried(short, ["doc_id", "section"], "idx", F.nullif(F.regexp_extract("body", "([0-9]+)", 1), F.lit("")), "number")
    rows = rows.select("doc_id", F.col("number").cast("bigint").alias("number")).where("number is not null").groupBy("doc_id", "number").agg(F.count("*").alias("n"))
    return rows.withColumn("_r", F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.desc("number")))).where("_r <= 4").drop("_r")


@query("SELECT doc_id, array_to_string(list_transform(list_sort(list_filter([{'p': instr(text, 'the'), 'w': 'the'}, {'p': instr(text, 'und'), 'w': 'und'}, {'p': instr(text, 'que'), 'w': 'que'}], lambda b: b.p > 0)), lambda b: b.w), ',') AS bands FROM documents")
def fn_band_targets(t):
    """Marks in the order in which a text first names them."""
    each = F.array(*[F.struct(F.locate(w, F.col("text")).alias("p"), F.lit(w).alias("w")) for w in ("the", "und", "que")])
    return t["documents"].select("doc_id", F.array_join(F.transform(F.array_sort(F.filter(each, lambda b: b["p"] > 0)), lambda b: b["w"]), ",").alias("bands"))


@query("SELECT doc_id, min(idx) AS idx, md5(body) AS line FROM chunk GROUP BY doc_id, body")
def q_merge_distinct_lines(t):
    """Lines of a document, each where it first stands."""
    return ln.distinct_lines(t.chunk, ["doc_id"]).select("doc_id", "idx", F.md5("body").alias("line"))


@query("SELECT c_custkey, array_to_string(list_filter(['**name**: ' || c_name, CASE WHEN c_acctbal > 0 THEN '**balance**: ' || CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) END, '**segment**: ' || c_mktsegment], lambda s: s IS NOT NULL), chr(10)) AS card FROM customer")
def q_card_text(t):
    """Fields that aren't blank as lines of a card."""
    balance = F.when(F.col("c_acctbal") > 0, F.concat(F.lit("**balance**: "), F.floor("c_acctbal").cast("string")))
    return t["customer"].select("c_custkey", F.array_join(F.array_compact(F.array(F.concat(F.lit("**name**: "), "c_name"), balance, F.concat(F.lit("**segment**: "), "c_mktsegment"))), "\n").alias("card"))


@query("SELECT doc_id, idx, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS ordinal, row_number() OVER (PARTITION BY doc_id, sha256(body) ORDER BY idx) - 1 AS occurrence, sha256(doc_id || '/' || sha256(body) || '/' || (row_number() OVER (PARTITION BY doc_id, sha256(body) ORDER BY idx) - 1)) AS point_id FROM chunk")
def win_chunk_ordinal(t):
    return ln.occurrence(t.chunk).select("doc_id", "idx", "ordinal", "occurrence", "point_id")


@query()
def q_chunk_paragraphs(t):
    """Paragraphs packed up to 500 characters."""
    return ln.packed(t["documents"], "doc_id", ln.by_paragraphs, "content string").select("doc_id", "part", F.length("content").cast("bigint").alias("size"), F.md5("content").alias("digest"))


@query()
def q_chunk_headers(t):
    """Lines packed under headings up to 500 characters."""
    return ln.packed(t["documents"], "doc_id", ln.by_headings, "heading string, content string").select("doc_id", "part", "heading", F.length("content").cast("bigint").alias("size"), F.md5("content").alias("digest"))


@query(f"{sql.packs('SELECT doc_id AS k, idx AS o, length(body) AS size, 1200 AS budget FROM chunk')} SELECT k AS doc_id, o AS idx, n, pack FROM packed")
def win_running_pack(t):
    """Lines of a document with the pack of up to 1200 characters into which they fall."""
    return pk.packs(t.chunk.select("doc_id", "idx", "body"), ["doc_id"], ["idx"], F.length("body"), 1200).select("doc_id", "idx", "n", "pack")


_PLACED = """SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT doc_id, idx, section, trim(body) AS body, CASE WHEN section IS NOT DISTINCT FROM lag(section) OVER (PARTITION BY doc_id ORDER BY idx) THEN 0 ELSE 1 END AS new FROM chunk WHERE trim(body) <> '')"""


@query(f"""WITH RECURSIVE placed AS MATERIALIZED ({_PLACED}), {sql.packs("SELECT doc_id * 100000 + run AS k, idx AS o, length(body) AS size, 1200 AS budget FROM placed", nested=True)},
    made AS (SELECT doc_id, run, pack, min(idx) AS first_idx, arg_min(section, idx) AS section, string_agg(body, chr(10) ORDER BY idx) AS content, bool_or(contains(body, '|')) AS tabular, count(*) AS n_segments FROM placed JOIN packed ON k = doc_id * 100000 + run AND o = idx GROUP BY doc_id, run, pack)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first_idx) AS ordinal, section, n_segments, length(content) AS size, md5(content) AS digest, tabular AND pack > 0 AS continued FROM made""")
def q_chunk_segments(t):
    """Segments of one place packed up to 1200 characters; a longer one stays whole. ``continued`` tells that a table goes on, so that its header is shown again."""
    return pk.segment_chunks(t.chunk.select("doc_id", "idx", "section", "body"), "doc_id", "idx", "section", "body", 1200).select(
        "doc_id", "ordinal", "section", "n_segments", F.length("content").cast("bigint").alias("size"), F.md5("content").alias("digest"), "continued"
    )


@query("SELECT doc_id, part, length(substr(text, CAST(part * 800 + 1 AS BIGINT), 1000)) AS size, md5(substr(text, CAST(part * 800 + 1 AS BIGINT), 1000)) AS digest FROM (SELECT doc_id, text, unnest(range(CAST(CASE WHEN length(text) = 0 THEN 0 ELSE ceil(greatest(length(text) - 200, 1) / 800.0e0) END AS BIGINT))) AS part FROM documents)")
def q_chunk_fixed(t):
    """Pieces of 1000 characters, 200 of them shared with the last, cut by substring."""
    n = F.when(F.length("text") == 0, 0).otherwise(F.ceil(F.greatest(F.length("text") - 200, F.lit(1)) / 800)).cast("int")
    d = t["documents"].where(F.length("text") > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("part"))
    piece = F.substring("text", F.col("part") * 800 + 1, F.lit(1000))
    return d.select("doc_id", F.col("part").cast("bigint").alias("part"), F.length(piece).cast("bigint").alias("size"), F.md5(piece).alias("digest"))


@query()
def fn_split_claims(t):
    """Claims of the assistant's answers with their references."""
    turns = t.turn.where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return ln.packed(turns, "doc_id", ln.claims, "claim string, refs string")


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '(^|\\n)#{1,6} ') THEN 'headings' WHEN contains(text, chr(10)) THEN 'paragraphs' ELSE 'whole' END AS chunker FROM documents")
def q_chunk_dispatch(t):
    return t["documents"].select("doc_id", F.when(F.col("text").rlike("(^|\n)#{1,6} "), "headings").when(F.contains("text", F.lit("\n")), "paragraphs").otherwise("whole").alias("chunker"))
