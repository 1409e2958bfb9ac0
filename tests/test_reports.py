import io
import zipfile

from pyspark.sql import functions as F

from loomwork.operators import reports as rp
from loomwork.operators import retrieval as r
from loomwork.sources import files

T = [rp.Template("a", ("case", "band"), (("rate", "rate", "Mbps"),)), rp.Template("b", ("case",), (("delay", "delay", "ms"), ("loss", "loss", "%")))]


def test_templates_among_cells(spark):
    sheet = [["Title"], [" CASE", "Band", "x", "Rate "], ["c1", "5G", "q", "10.5"], ["c2", "", None, "n/a"], [None, None, None, "7"], ["case", "delay", "loss"], ["c3", "-4", " 0.5 "], ["no", "heading"]]
    cells = [("f", i, j, v) for i, row in enumerate(sheet) for j, v in enumerate(row) if v is not None] + [("f", 6, 1, "5"), ("g", 0, 0, "case")]
    got = rp.template_rows(spark.createDataFrame(cells, "s string, row bigint, col bigint, value string"), T, ["s"]).collect()
    assert sorted((x["template"], x["row"], str(sorted(x["about"].items())), x["metric"], x["value"], x["cell"]) for x in got) == [
        ("a", 2, "[('band', '5G'), ('case', 'c1')]", "rate", 10.5, "D3"), ("b", 6, "[('case', 'c3')]", "delay", -4.0, "B7"), ("b", 6, "[('case', 'c3')]", "loss", 0.5, "C7"),
    ]
    assert [spark.range(1).select(rp.a1(F.lit(0), F.lit(c))).first()[0] for c in (0, 25, 26, 52, 701, 702, 18277, 18278)] == ["A1", "Z1", "AA1", "BA1", "ZZ1", "AAA1", "ZZZ1", "AAAA1"]


def test_cases_side_by_side(spark):
    rows = [("c1", "p", 1.0), ("c1", "p", 2.0), ("c1", "q", 4.0), ("c2", "q", 1.0), ("c2", None, 9.0), ("c3", "z", 1.0), (None, "p", None)]
    got = rp.case_table(spark.createDataFrame(rows, "case string, project string, value double"), ["case"], "project", "value", ["p", "q"]).collect()
    assert sorted(map(tuple, got)) == [("c1", 2, 1.5, 4.0, 2.5), ("c2", 1, None, 1.0, None)]


def test_workbooks_good_and_bad(spark):
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {space}><sheets><sheet name="one"/><sheet name="two"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {space}><si><t>a</t></si><si><r><t>b</t></r><r><t>c</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {space}><sheetData><row><c r="AB3" t="s"><v>1</v></c><c r="A1"/></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {space}><sheetData><row><c r="B2"><v>4.5</v></c></row></sheetData></worksheet>')
    rows = [("good", bytearray(out.getvalue())), ("bad", bytearray(b"no zip")), ("null", None)]
    got = files.workbook_cells(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert {(x["path"], x["sheet"], x["row"], x["col"]) for x in got} == {("good", "one", 2, 27), ("good", "two", 1, 1), ("bad", None, None, None), ("null", None, None, None)}
    assert {x["value"] for x in got if x["path"] == "good"} == {"bc", "4.5"}
    assert files.workbook_cells(spark.createDataFrame(rows[:1], "path string, content binary"), most_bytes=50).first()["value"] == "too large"
    assert files.workbook_cells(spark.createDataFrame(rows[:1], "path string, content binary"), most_cells=1).first()["value"] == "too many cells"


def test_sheets_by_relationship(spark):
    """Sheets that were moved or deleted: parts are named by relationship, not by order."""
    space, office = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    sheet = lambda v: f'<worksheet {space}><sheetData><row><c r="A1"><v>{v}</v></c></row></sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {space} {office}><sheets><sheet name="last" sheetId="7" r:id="rId9"/><sheet name="first" sheetId="2" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet2.xml"/><Relationship Id="rId9" Target="/xl/worksheets/sheet5.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet2.xml", sheet(2)), z.writestr("xl/worksheets/sheet5.xml", sheet(5))
    got = files.workbook_cells(spark.createDataFrame([("w", bytearray(out.getvalue()))], "path string, content binary")).collect()
    assert {(x["sheet"], x["value"]) for x in got} == {("last", "5"), ("first", "2")}


def test_nearest_equals_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 8)).round(1)
    rows = [(i, [float(y) for y in x], "ab"[i % 2]) for i, x in enumerate(v)] + [(900, None, "a"), (901, [0.0] * 8, "a"), (902, [1.0], "b"), (903, rows_0 := [float(y) for y in v[0]], "a")]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, zone string").repartition(4)
    asked = [(q, [float(y) for y in rng.normal(size=8).round(1)], "ab"[q % 2]) for q in range(9)] + [(50, rows_0, "a"), (51, None, "a")]
    frame = spark.createDataFrame(asked, "question bigint, vector array<double>, zone string")
    known = [(i, np.array(x), z) for i, x, z in rows if x and any(x) and len(x) == 8]

    def want(zones):
        out = {}
        for q, x, zone in asked:
            if x:
                x = np.array(x)
                sims = sorted((-round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 4), i) for i, y, z in known if not zones or z == zone)
                out |= {(q, n): i for n, (_, i) in enumerate(sims[:5], 1)}
        return out

    for zones, block in ((None, 2000), ("zone", 3)):
        got = {(x["question"], x["rank"]): x["vec_id"] for x in r.nearest(vectors, frame, 5, block, zones).collect()}
        assert got == want(zones)


def test_records_modes_and_routes(spark):
    recs = spark.createDataFrame([(1, "red Pen"), (2, "blue pen box"), (3, None), (4, "red box")], "i int, t string")
    asked = spark.createDataFrame([(1, "The RED box"), (2, "?"), (3, "green the a"), (4, None)], "question int, text string")
    got = r.matched_records(recs, asked, F.col("t"), "i", 3, stop=["the"]).select("question", "rank", "i", "score").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 4, 2), (1, 2, 1, 1), (1, 3, 2, 1), *[(q, n, n, 0) for q in (2, 4) for n in (1, 2, 3)]]
    assert [(x["i"], x["content"]) for x in r.summaries(recs, ["PEN"], "t", F.col("t"), [F.lit("")], "i", 9, cut=3).collect()] == [(1, "red"), (2, "blu")]
    said = spark.createDataFrame([("a vs b now here", None), ('say "x y" to me', None), ("How is it done", None), ("two words", None), ("some three words", None), ("x", "vector"), ("x", "user")], "q string, m string")
    assert [x[0] for x in said.select(r.search_mode(F.col("q"), F.col("m"))).collect()] == ["report", "exact", "vector", "keyword", "hybrid", "vector", "keyword"]
