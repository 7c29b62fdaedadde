import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from passagework.operators import catalog as cat
from passagework.sources import files as src
from passagework.streaming import jobs


def test_latest_merge_and_purge(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), (None, 1, "n")], "k string, v int, w string")
    assert {(r.k, r.w) for r in cat.latest(df, "k", F.desc("v")).collect()} == {("a", "y"), ("b", "z"), (None, "n")}
    old = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "id int, p int")
    new = spark.createDataFrame([(2, 7), (3, None), (4, 1)], "id int, p int")
    assert {(r.id, r.p, r.active, r.change) for r in cat.merged(old, new, ["id"], ["p"]).collect()} == {(1, 5, False, "deactivated"), (2, 7, True, "updated"), (3, None, True, "kept"), (4, 1, True, "inserted")}
    kept, counts = cat.purge({"t": df.withColumnRenamed("k", "resource_id")}, spark.createDataFrame([("a",), ("a",)], "resource_id string"))
    assert kept["t"].count() == 2 and counts.first().removed == 2


def test_search_paging_and_permissions(spark):
    people = spark.createDataFrame([("Ann Marie", "Lee"), ("Ann", "Ray"), (None, "Lee")], "first string, last string")
    assert cat.search_people(people, "lee", "first", "last").count() == 2
    assert cat.search_people(people, "ann ray", "first", "last").count() == 1
    assert cat.search_people(people, "ann marie lee", "first", "last").count() == 1 and cat.search_people(people, " ", "first", "last").count() == 3
    assert [r.last for r in cat.paged(people, F.desc("last"), offset=1, limit=1).collect()] == ["Lee"] and cat.clamped_limit(0) == 1 and cat.clamped_limit(900) == 100
    with pytest.raises(ValueError, match="can't sort"):
        cat.paged(people, allowed=("last",), sort_by="first; drop")
    ur = spark.createDataFrame([("u", "r")], "user string, role string")
    rp = spark.createDataFrame([("r", "p"), ("r", "q2"), ("r", "q1")], "role string, permission string")
    implies = spark.createDataFrame([("p", "p1"), ("q", "q1"), ("q", "q2")], "permission string, implied string")
    assert {r.permission for r in cat.effective_permissions(ur, rp, implies).collect()} == {"p", "p1", "q1", "q2", "q"}


def docx(text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        body = "".join(f"<w:p><w:r><w:t>{t}</w:t><w:tab/><w:t>end</w:t></w:r></w:p>" for t in text)
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}<w:p/></w:body></w:document>')
    return out.getvalue()


def xlsx():
    s, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets><sheet name="Two" r:id="b"/><sheet name="One" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{s}"><si><t>shared</t><rPh><t>no</t></rPh></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{s}"><sheetData><row r="3"><c t="s"><v>0</v></c><c><v>4.5</v></c><c t="b"><v>1</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{s}"><sheetData><row r="1"><c t="inlineStr"><is><t>inline</t></is></c><c/></row></sheetData></worksheet>')
    return out.getvalue()


def test_documents_from_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿Good title here\nbody \xff".encode() + b"\xff")
    (tmp_path / "b.csv").write_text("name,size,\nvalve,3,x\n,,\n")
    (tmp_path / "c.docx").write_bytes(docx(["One", "Two"]))
    (tmp_path / "d.xlsx").write_bytes(xlsx())
    (tmp_path / "e.docx").write_bytes(b"not a zip")
    (tmp_path / "f.png").write_bytes(b"\x89PNG")
    (tmp_path / "g.txt").write_bytes(b"")
    rows = {r.file_name: r for r in src.read_documents(spark, str(tmp_path)).collect()}
    assert rows["a.txt"].title == "Good title here" and rows["a.txt"].text.startswith("Good title here\nbody")
    assert rows["b.csv"].text == "Row 1: name: valve; size: 3" and rows["b.csv"].modality == "table"
    assert rows["c.docx"].text == "One\tend\n\nTwo\tend"
    assert rows["d.xlsx"].text == "Sheet: Two\nRow 1: inline\nSheet: One\nRow 3: shared; 4.5; TRUE"
    assert rows["e.docx"].text == "" and rows["e.docx"].notice.startswith("unreadable") and rows["f.png"].notice == "not read" and "g.txt" not in rows


def test_nothing_binary_is_text_and_long_tables_say_so():
    for name, modality in (("a.pdf", "pdf"), ("a.xls", "table"), ("a.doc", "text"), ("a.pptx", "text"), ("a.bin", "text"), ("a.png", "image")):
        text, notice = src.extract(name, modality, b"%PDF-1.7 \x00\x01 secret")
        assert "secret" not in text and notice == "not read"
    assert src.extract("noext", "text", b"a\0b")[1] == "not read" and src.extract("noext", "text", b"ab") == ("ab", None)
    text, notice = src.extract("a.csv", "table", b"k\n" + b"v\n" * 301)
    assert text.count("Row") == 300 and notice == "stopped after 300 rows"
    assert src.extract("a.csv", "table", b"k\n" + b"v\n" * 300)[1] is None and src.extract("b.csv", "table", b"only\n") == ("only\n", None)
    text, notice = src.sheet_text(xlsx(), most=1)
    assert "Row 1" in text and "Row 3" not in text and notice == "stopped after 1 rows" and src.sheet_text(xlsx(), most=2)[1] is None


def test_late_rows_of_many_files_count(spark, tmp_path):
    rows = spark.range(300).selectExpr("timestampadd(MINUTE, (id * 7919) % 100000, timestamp'2024-01-01') AS ts", "concat('k', id % 3) AS event_type", "1.0D AS value")
    rows.repartition(12).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    source = jobs.read_stream(spark, str(tmp_path / "in"), rows.schema, files=1)
    jobs.run_batches(jobs.windowed_counts(source, "30 days"), out, lambda b: b, mode="update")
    last = jobs.last_state(jobs.results(spark, out), "window_start", "kind")
    assert last.agg(F.sum("n")).first()[0] == 300 and jobs.results(spark, out).select("batch").distinct().count() == 12


def test_archive_bomb():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", b"0" * 4_000_000)
    assert src.extract("x.docx", "text", out.getvalue()) == ("", "unreadable: Unreadable")


def test_json_sources(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({" DB ": ["Database ", ""], "x": []}))
    (tmp_path / "bad.json").write_text("{oops")
    assert [tuple(r) for r in src.read_dictionary(spark, str(tmp_path / "d.json")).collect()] == [("db", "database")]
    assert src.read_dictionary(spark, str(tmp_path / "bad.json")).count() == 0
    bench = {"resource_name": "r", "chunks": [{"id": "c1", "file_id": "f", "chunk_index": 0, "content": "x"}], "cases": [{"query": "q", "expected_chunks": ["c1"], "expected_documents": ["f"], "expected_chunk_groups": [["c2", "c3"]]}]}
    (tmp_path / "b.json").write_text(json.dumps(bench))
    chunks, qrels = src.read_benchmark(spark, str(tmp_path / "b.json"))
    assert chunks.count() == 1 and {(r.group_id, r.item) for r in qrels.collect()} == {(0, "c1"), (1, "c2"), (1, "c3")}


def test_stream_survives_repeated_batches(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), "r", "queued", 1, i % 2, i == 3) for i in range(10)], "id string, resource_id string, status string, total_documents int, processed_documents int, cancel_requested boolean").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows.repartition(3).write.parquet(landing)
    for _ in range(2):  # the second run finds nothing new
        jobs.run_batches(jobs.read_stream(spark, landing, rows.schema, files=1), out, jobs.job_states)
    assert jobs.results(spark, out).count() == 10
    rows.limit(1).withColumn("id", F.lit("new")).write.mode("append").parquet(landing)
    jobs.run_batches(jobs.read_stream(spark, landing, rows.schema, files=1), out, jobs.job_states)
    got = {r.job_id: r.state for r in jobs.results(spark, out).collect()}
    assert len(got) == 11 and got["3"] == "cancelled"
