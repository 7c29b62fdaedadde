"""Documents from files: plain text, CSV and TSV, DOCX, XLSX, and page texts; and JSON tables of dictionaries and benchmarks.

Files are read as one row per file with Spark's binary source and decoded inside Arrow batches with the standard library.
PDF needs a reader that isn't part of the standard library, so pages come in as rows (see ``operators.chunking.page_spans``).
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.functions.text import modality_of, title_of

#: Rows of a sheet or table that are read, size of an archive member and its expansion at most.
ROWS, MEMBER_BYTES, EXPANSION = 300, 32 * 2**20, 200

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


class Unreadable(ValueError):
    """The file isn't what its name says."""


def member(archive: zipfile.ZipFile, name: str) -> bytes:
    """Bytes of an archive's member, unless it is or claims to be far too large."""
    info = archive.getinfo(name)
    if info.file_size > MEMBER_BYTES or info.file_size > EXPANSION * max(info.compress_size, 1):
        raise Unreadable(f"{name} is too large")
    with archive.open(info) as f:
        data = f.read(MEMBER_BYTES + 1)
    if len(data) > MEMBER_BYTES:
        raise Unreadable(f"{name} is too large")
    return data


def plain_text(data: bytes) -> str:
    return data.decode("utf-8", errors="ignore").lstrip("﻿")


def stopped(rows: int) -> str:
    return f"stopped after {rows} rows"


def table_text(data: bytes, delimiter: str = ",", most: int = ROWS) -> tuple[str, str | None]:
    """``Row n: key: value; ...`` of the first ``most`` rows, and a notice if there are more; keys and values that are empty are
    left out. The text as it is if no row has any."""
    text, notice = plain_text(data), None
    try:
        lines = []
        for n, row in enumerate(csv.DictReader(io.StringIO(text), delimiter=delimiter), 1):
            if n > most:
                notice = stopped(most)
                break
            cells = [f"{k.strip()}: {v.strip()}" for k, v in row.items() if isinstance(k, str) and isinstance(v, str) and k.strip() and v.strip()]
            if cells:
                lines.append(f"Row {n}: {'; '.join(cells)}")
    except csv.Error:
        return text, None
    return "\n".join(lines) if lines else text, notice


def word_text(data: bytes) -> str:
    """Paragraphs of a DOCX file, a blank line between them; tabs and line breaks inside are kept."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(member(z, "word/document.xml"))
    inner = {id(p) for outer in root.iter(f"{_W}p") for p in outer.iter(f"{_W}p") if p is not outer}
    out = []
    for p in root.iter(f"{_W}p"):
        if id(p) in inner:
            continue  # a text box inside a paragraph comes with that paragraph
        marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
        text = "".join(e.text or "" if e.tag == f"{_W}t" else marks.get(e.tag, "") for e in p.iter())
        if text.strip():
            out.append(text.strip())
    return "\n\n".join(out)


def sheet_text(data: bytes, most: int = ROWS) -> tuple[str, str | None]:
    """Sheets of an XLSX file in the order of the workbook: ``Sheet: name``, then ``Row r: a; b`` lines. Of all sheets together
    ``most`` rows are looked at, empty ones too; a notice says so if there are more."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(member(z, "xl/sharedStrings.xml")).findall(f"{_S}si"):
                phonetic = {id(t) for r in item.iter(f"{_S}rPh") for t in r.iter(f"{_S}t")}
                shared.append("".join(t.text or "" for t in item.iter(f"{_S}t") if id(t) not in phonetic))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(member(z, "xl/_rels/workbook.xml.rels"))}
        lines, left, notice = [], most, None
        for sheet in ElementTree.fromstring(member(z, "xl/workbook.xml")).iter(f"{_S}sheet"):
            path = "xl/" + re.sub(r"^/?(xl/)?", "", targets.get(sheet.get(f"{_R}id")) or "")
            if path not in names:
                continue
            lines.append(f"Sheet: {sheet.get('name')}")
            for row in ElementTree.fromstring(member(z, path)).iter(f"{_S}row"):
                if left == 0:
                    notice = stopped(most)
                    break
                left -= 1
                cells = [c for c in (cell_text(c, shared).strip() for c in row.iter(f"{_S}c")) if c]
                if cells:
                    lines.append(f"Row {row.get('r')}: {'; '.join(cells)}")
    return "\n".join(lines), notice


def cell_text(cell: ElementTree.Element, shared: list[str]) -> str:
    kind, value = cell.get("t"), cell.findtext(f"{_S}v") or ""
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_S}t"))
    if kind == "s":
        return shared[int(value)] if value.isdigit() and int(value) < len(shared) else ""
    if kind == "b":
        return {"1": "TRUE", "0": "FALSE"}.get(value, value)
    return value


def unmarked(read: Callable[[bytes], str]) -> Callable[[bytes], tuple[str, str | None]]:
    return lambda data: (read(data), None)


#: Suffixes of files that are plain text; a file without suffix is one too, unless it has a zero byte.
TEXT_SUFFIXES = ("", "txt", "md", "markdown", "rst", "log", "json", "jsonl", "xml", "yaml", "yml", "html", "htm", "ini", "toml", "cfg", "sql", "py", "js", "ts", "java", "c", "cpp", "h", "sh", "tex", "srt", "vtt")
READERS = {**{end: unmarked(plain_text) for end in TEXT_SUFFIXES}, "csv": table_text, "tsv": lambda d: table_text(d, "\t"), "docx": unmarked(word_text), "xlsx": sheet_text}
#: What stands for the content of files that can't be read as text, by modality and by suffix.
NOTES = {
    "image": "Image file; its content has not been read.",
    "audio": "Audio file; its content has not been read.",
    "pdf": "PDF file; its content has not been read. Its pages can be given as rows.",
    "xls": "Workbook of an old format; its content has not been read. Saved as XLSX it can be.",
    "doc": "Document of an old format; its content has not been read. Saved as DOCX it can be.",
    "ppt": "Slides; their content has not been read.",
    "pptx": "Slides; their content has not been read.",
}
BINARY = "File of an unknown kind; its content has not been read."


def extract(name: str, modality: str, data: bytes) -> tuple[str, str | None]:
    """(text, notice) of one file; a file that can't be read has no text and a notice that says why. Nothing binary is taken for text."""
    end = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    note = NOTES.get(modality) or NOTES.get(end)
    if note is None and (end not in READERS or (READERS[end] is READERS[""] and b"\0" in data[:4096])):
        note = BINARY
    if note:
        return note, "not read"
    try:
        return READERS[end](data)
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, Unreadable, csv.Error) as e:
        return "", f"unreadable: {type(e).__name__}"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, file_name, modality, title, text, notice of every file under ``path`` that isn't empty."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.substring_index(F.col("path"), "/", -1)
    typed = rows.select("path", name.alias("file_name"), modality_of(name, F.lit(None).cast("string")).alias("modality"), "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pairs = [extract(n, m, bytes(c or b"")) for n, m, c in zip(b["file_name"], b["modality"], b["content"], strict=True)]
            yield b[["path", "file_name", "modality"]].assign(text=[t for t, _ in pairs], notice=[n for _, n in pairs])

    out = typed.mapInPandas(decode, "path string, file_name string, modality string, text string, notice string")
    return out.withColumn("title", title_of(F.col("text"), F.col("file_name")))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """term, alias from lines or a document of JSON ``{term: [alias, ...]}``; what can't be read gives no rows."""
    text = spark.read.text(path, wholetext=True)
    table = text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("term", "aliases"))
    rows = table.select(F.lower(F.trim("term")).alias("term"), F.explode("aliases").alias("alias"))
    return rows.select("term", F.lower(F.trim("alias")).alias("alias")).where("alias != ''").distinct()


def read_benchmark(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(chunks, qrels) of a benchmark document: chunk_id, file_id, chunk_index, source_name, modality, title, content; and
    query_id, question, group_id, item. Every expected chunk is a group of its own; expected groups come after them."""
    chunk = "array<struct<id:string,file_id:string,chunk_index:int,source_name:string,modality:string,title:string,page_start:int,content:string>>"
    case = "array<struct<query:string,expected_chunks:array<string>,expected_documents:array<string>,expected_chunk_groups:array<array<string>>>>"
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", f"resource_name string, chunks {chunk}, cases {case}").alias("d"))
    chunks = doc.select(F.explode("d.chunks").alias("c")).select(F.col("c.id").alias("chunk_id"), "c.file_id", "c.chunk_index", "c.source_name", "c.modality", "c.title", "c.page_start", "c.content")
    cases = doc.select(F.posexplode("d.cases").alias("query_id", "k"))
    single = F.transform(F.coalesce("k.expected_chunks", F.array().cast("array<string>")), lambda c: F.array(c))
    groups = F.concat(single, F.coalesce("k.expected_chunk_groups", F.array().cast("array<array<string>>")))
    qrels = cases.select("query_id", F.col("k.query").alias("question"), F.posexplode(groups).alias("group_id", "items"))
    return chunks, qrels.select("query_id", "question", "group_id", F.explode("items").alias("item"))
