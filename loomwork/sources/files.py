"""Readers of packages, tables of cells, log lines, feeds and texts of unknown encoding."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import islice
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "doc_id bigint, title string, publisher string"
SEGMENT = "segment_id string, doc_id bigint, ordinal bigint, text string"


def read_jsonl(spark: SparkSession, path: str, schema: str, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of JSON lines: a line that is broken or lacks a required field is rejected with the reason."""
    rows = spark.read.schema(f"{schema}, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
    reason = F.when(F.col("_broken").isNotNull(), "broken")
    for c in required:
        reason = reason.when(F.col(c).isNull(), f"no {c}")
    marked = rows.withColumn("reason", reason)
    names = [c.split()[0] for c in schema.split(", ")]
    return marked.where("reason is null").select(names), marked.where("reason is not null").select(*names, "reason")


def read_package(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, segments, problems) of a package: required fields, repeated documents, and segments of unknown documents."""
    docs, bad_docs = read_jsonl(spark, f"{folder}/documents", DOCUMENT, ["doc_id", "title"])
    segments, bad_segments = read_jsonl(spark, f"{folder}/segments", SEGMENT, ["segment_id", "doc_id"])
    known = docs.select("doc_id").distinct()
    orphans = segments.join(known, "doc_id", "left_anti").select("doc_id", F.lit("orphan segment").alias("reason"))
    repeated = docs.groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit("repeated document").alias("reason"))
    problems = bad_docs.select("doc_id", "reason").unionAll(bad_segments.select("doc_id", "reason")).unionAll(orphans).unionAll(repeated)
    return docs, segments.join(known, "doc_id", "left_semi"), problems


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, sha256) of the files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def read_cells(spark: SparkSession, path: str, most: int = 1000) -> DataFrame:
    """(line, n_cells, cells) of CSV lines; lines of more than ``most`` cells are left out."""
    rows = spark.read.option("header", "true").csv(path)
    cells = F.array(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.select(cells.alias("cells")).where(F.size("cells") <= most)


def read_log(spark: SparkSession, path: str, prefix: str, schema: str) -> DataFrame:
    """The JSON records that stand after ``prefix`` in the lines of a log; other and broken lines are left out."""
    lines = spark.read.text(path).where(F.contains("value", F.lit(prefix)))
    body = F.substring_index("value", prefix, -1)
    return lines.select(F.from_json(body, schema, {"mode": "PERMISSIVE"}).alias("r"), body.alias("b")).where(F.startswith(F.trim("b"), F.lit("{")) & F.endswith(F.trim("b"), F.lit("}"))).select("r.*")


def feed_items(feeds: DataFrame, host: str) -> DataFrame:
    """(title, link, published) of the items of RSS texts feeds(value) whose link is on ``host``; times are RFC 822 or ISO."""
    one = feeds.select(F.explode(F.regexp_extract_all("value", F.lit("(?s)(<item[ >].*?</item>)"), F.lit(1))).alias("item"))
    items = one.select(F.from_xml("item", "title string, link string, pubDate string").alias("i")).select("i.*")
    when = F.coalesce(F.try_to_timestamp(F.regexp_replace("pubDate", "^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss Z")), F.try_to_timestamp("pubDate"))
    return items.where(F.regexp_replace(F.parse_url("link", F.lit("HOST")), r"^www\.", "") == host).select("title", "link", when.alias("published"))


def read_feeds(spark: SparkSession, path: str, host: str, one_a_line: bool = False) -> DataFrame:
    """Items of RSS files, each a file of its own or one a line."""
    return feed_items(spark.read.text(path, wholetext=not one_a_line), host)


def decoded(files: DataFrame, encodings: Sequence[str] = ("utf-8-sig", "big5", "cp950", "utf-16")) -> DataFrame:
    """(path, encoding, text) of files(path, content): the first encoding that reads the whole content."""

    def each(batches: Iterator) -> Iterator:
        import pandas as pd

        def one(raw: bytes) -> tuple[str | None, str | None]:
            for name in encodings:
                try:
                    return name, raw.decode(name)
                except UnicodeDecodeError:
                    continue
            return None, None

        for b in batches:
            got = [one(bytes(x)) for x in b["content"]]
            yield pd.DataFrame({"path": b["path"], "encoding": [g[0] for g in got], "text": [g[1] for g in got]})

    return files.select("path", "content").mapInPandas(each, "path string, encoding string, text string")


def file_kind(files: DataFrame) -> DataFrame:
    """(path, by_content, by_name, agrees): the kind of a file from its first bytes and from its extension."""
    head, end = F.hex(F.substring("content", 1, 4)), F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    content = F.when(head == "504B0304", "zip").when(head == "25504446", "pdf").when(head.like("89504E47%"), "image").when(head.like("FFD8FF%"), "image").otherwise("text")
    name = F.when(end.isin("docx", "xlsx", "pptx", "zip"), "zip").when(end == "pdf", "pdf").when(end.isin("png", "jpg", "jpeg"), "image").otherwise("text")
    return files.select("path", content.alias("by_content"), name.alias("by_name"), (content == name).alias("agrees"))


def wide_to_long(cells: DataFrame, sheet: str = "sheet") -> DataFrame:
    """Measurements of a table of cells(sheet, row, col, value): labels of column 0 carried down, headings of row 0 carried to their columns."""
    from pyspark.sql import Window

    down = Window.partitionBy(sheet).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    labels = cells.where("col = 0 and row > 0").select(sheet, "row", F.last(F.nullif(F.col("value"), F.lit("")), ignorenulls=True).over(down).alias("label"))
    heads = cells.where("row = 0 and col > 0").select(sheet, "col", F.col("value").alias("heading"))
    body = cells.where("row > 0 and col > 0").join(labels, [sheet, "row"]).join(heads, [sheet, "col"])
    return body.select(sheet, "row", "label", "heading", F.expr("try_cast(value as double)").alias("value")).where("value is not null")


def workbook_cells(files: DataFrame, most_bytes: int = 20 << 20, most_cells: int = 200_000) -> DataFrame:
    """(path, sheet, row, col, value) of the cells of workbooks(path, content), as spark.read.format("binaryFile") gives them; rows and columns count from 0.

    Sheets are zipped XML. A file that is larger than ``most_bytes``, packed or unpacked, has over ``most_cells`` cells or can't be read gives one row with a null sheet and
    the reason as value, so one bad file ends no job and no task holds more than a file of that size.
    """

    def cells(content: bytes):
        spaces = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            if sum(x.file_size for x in z.infolist()) > most_bytes:
                raise ValueError("too large")
            tree = lambda name: ElementTree.fromstring(z.read(name))
            shared = ["".join(t.text or "" for t in x.iter(f"{{{spaces['m']}}}t")) for x in tree("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in z.namelist() else []
            office = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
            rels = "xl/_rels/workbook.xml.rels"
            parts = {x.get("Id"): x.get("Target") for x in tree(rels)} if rels in z.namelist() else {}
            for k, x in enumerate(tree("xl/workbook.xml").iterfind(".//m:sheet", spaces), 1):
                # A sheet's part is the one its relationship names; workbooks without relationships have them by number.
                name, part = x.get("name"), parts.get(x.get(office), f"worksheets/sheet{k}.xml")
                part = part.lstrip("/") if part.startswith("/") else posixpath.normpath(f"xl/{part}")
                for c in tree(part).iterfind(".//m:c", spaces):
                    letters, number = re.fullmatch("([A-Z]+)([0-9]+)", c.get("r")).groups()
                    col = reduce(lambda n, x: 26 * n + ord(x) - 64, letters, 0) - 1
                    value = "".join(t.text or "" for t in c.iter(f"{{{spaces['m']}}}t")) if c.get("t") == "inlineStr" else c.findtext("m:v", None, spaces)
                    if value is not None:
                        yield name, int(number) - 1, col, shared[int(value)] if c.get("t") == "s" else value

    def each(batches):
        import pandas as pd

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    if len(content) > most_bytes:
                        raise ValueError("too large")
                    found = list(islice(cells(content), most_cells + 1))
                    if len(found) > most_cells:
                        raise ValueError("too many cells")
                except (ValueError, KeyError, IndexError, AttributeError, TypeError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    found = [(None, None, None, str(e) or type(e).__name__)]
                yield pd.DataFrame([(path, *x) for x in found], columns=["path", "sheet", "row", "col", "value"]).astype({"row": "Int64", "col": "Int64"})

    return files.select("path", "content").mapInPandas(each, "path string, sheet string, row bigint, col bigint, value string")
