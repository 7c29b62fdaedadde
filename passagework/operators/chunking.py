"""Cutting documents into passages: by characters, sentences, paragraphs or pages.

Texts are normalised first; spans are half-open offsets into the normalised text, so a passage is always
``text[start:end]``. Cutting is sequential within one text, so it runs as a small function per text inside
Arrow batches; everything around it is columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.functions.text import squeeze

#: Bounds and defaults of the settings, and the strategies.
SMALLEST, LARGEST, DEFAULT_SIZE, DEFAULT_OVERLAP = 200, 4000, 1200, 180
STRATEGIES = ("character", "sentence", "paragraph", "page")
_PASSAGES = "doc_id string, chunk_index int, start int, end int, content string"
_STOP = re.compile(r"[.!?]+(?=\s|$)\s*")

Span = tuple[int, int]


def settings(size: Column, overlap: Column, strategy: Column) -> tuple[Column, Column, Column]:
    """Settings within their bounds: size, overlap of at most half the size, a known strategy (else character)."""
    s = F.greatest(F.lit(SMALLEST), F.least(F.lit(LARGEST), F.coalesce(size.cast("int"), F.lit(DEFAULT_SIZE))))
    o = F.greatest(F.lit(0), F.least(F.coalesce(overlap.cast("int"), F.lit(DEFAULT_OVERLAP)), F.floor(s / 2).cast("int")))
    known = F.lower(F.trim(strategy))
    return s, o, F.when(known.isin(*STRATEGIES), known).otherwise("character")


def trimmed(text: str, start: int, end: int) -> Span | None:
    """The span without white space at its ends; None if nothing is left."""
    piece = text[start:end]
    lead = len(piece) - len(piece.lstrip())
    return (start + lead, start + lead + len(piece.strip())) if piece.strip() else None


def by_characters(text: str, size: int, overlap: int, at: int = 0, to: int | None = None) -> list[Span]:
    """Windows of ``size``; one ends behind the last full stop of its second half, if there is one there."""
    to = len(text) if to is None else to
    if to - at <= size:
        return [(at, to)]
    spans: list[Span | None] = []
    while True:
        end = min(at + size, to)
        if end < to:
            stop = text.rfind(". ", at, end)
            end = stop + 1 if stop - at > size // 2 else end
        spans.append(trimmed(text, at, end))
        if end >= to:
            return [s for s in spans if s]
        at = end - overlap if end > overlap else 0


def sentence_units(text: str) -> list[Span]:
    """Sentences; each unit ends with its stop, the white space after it belongs to none."""
    units, at = [], 0
    for stop in _STOP.finditer(text):
        units.append((at, at + len(text[at : stop.end()].rstrip())))
        at = stop.end()
    return units + [(at, len(text))] * (at < len(text))


def units_between(text: str, marks: list[int]) -> list[Span]:
    """Units between the marks that lie inside the text; none without such marks."""
    inner = sorted({m for m in marks if 0 < m < len(text)})
    return list(pairwise([0, *inner, len(text)])) if inner else []


def packed(text: str, units: list[Span], size: int, overlap: int) -> list[Span]:
    """As many whole units as fit into ``size``; the next passage steps back over whole units until the overlap is covered."""
    spans: list[Span] = []
    first = 0
    while first < len(units):
        begin, last = units[first][0], first
        while last + 1 < len(units) and units[last + 1][1] - begin <= size:
            last += 1
        whole = trimmed(text, begin, units[last][1])
        if whole:
            spans += [whole] if whole[1] - whole[0] <= size else by_characters(text, size, overlap, *whole)
        if last + 1 == len(units):
            break
        following = last + 1
        covered = 0
        while covered < overlap and following > first + 1:
            following -= 1
            covered = units[last][1] - units[following][0]
        first = max(following, first + 1)
    return spans


def passages(text: str, strategy: str, size: int, overlap: int, breaks: list[int] | None = None, pages: list[Span] | None = None) -> list[Span]:
    """Spans of one normalised text. Pages without page spans are cut by characters, paragraphs without marks by sentences."""
    if not text:
        return []
    if strategy == "page" and pages:
        spans = []
        for a, b in pages:
            whole = trimmed(text, a, b)
            if whole:
                spans += by_characters(text, size, overlap, *whole)
        return spans
    if strategy == "paragraph":
        units = units_between(text, [*(breaks or []), *(p[0] for p in pages or [])])
        return packed(text, units or sentence_units(text), size, overlap)
    if strategy == "sentence":
        return packed(text, sentence_units(text), size, overlap)
    return by_characters(text, size, overlap)


def with_marks(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``normal`` (the normalised text) and ``breaks`` (offsets in it at which paragraphs begin)."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), r"(?:\r?\n[ \t]*){2,}"), squeeze), lambda p: p != "")
    ends = F.aggregate("__parts", F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.char_length(p) + 1)))
    marked = df.withColumn("__parts", parts)
    return marked.withColumn("normal", F.array_join("__parts", " ")).withColumn("breaks", F.slice(ends, 2, F.greatest(F.size("__parts") - 1, F.lit(0)))).drop("__parts")


def page_spans(pages: DataFrame) -> DataFrame:
    """doc_id, text, spans (page, start, end) from page rows doc_id, page, text: pages are normalised and joined by one
    space; empty pages are left out."""
    rows = pages.select("doc_id", "page", squeeze(F.coalesce("text", F.lit(""))).alias("t")).where("t != ''").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "t"))).alias("ps"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<page:int,start:int,end:int>>").alias("spans"))
    walk = F.aggregate(
        "ps",
        start,
        lambda acc, p: F.struct((acc["at"] + F.char_length(p["t"]) + 1).alias("at"), F.concat(acc["spans"], F.array(F.struct(p["page"].cast("int").alias("page"), acc["at"].alias("start"), (acc["at"] + F.char_length(p["t"])).alias("end")))).alias("spans")),
    )
    return rows.select("doc_id", F.array_join(F.transform("ps", lambda p: p["t"]), " ").alias("text"), walk["spans"].alias("spans"))


def pages_of(spans: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """First and last page that a span touches; null if none."""
    hit = F.transform(F.filter(spans, lambda s: (s["start"] < end) & (s["end"] > start)), lambda s: s["page"])
    return F.array_min(hit), F.array_max(hit)


def cut(df: DataFrame, strategy: str = "character", size: int = DEFAULT_SIZE, overlap: int = DEFAULT_OVERLAP, id_col: str = "doc_id", text_col: str = "text", spans_col: str | None = None) -> DataFrame:
    """doc_id, chunk_index, start, end, content of the passages of every text. Null, empty and blank texts have none.
    ``spans_col``: page spans (page, start, end) of a text that is normalised already, as ``page_spans`` gives them."""
    spans = F.col(spans_col) if spans_col else F.array().cast("array<struct<page:int,start:int,end:int>>")
    marked = with_marks(df.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"), spans.alias("spans"))).where("normal != ''").select("doc_id", "normal", "breaks", "spans")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text, breaks, pages in zip(batch["doc_id"], batch["normal"], batch["breaks"], batch["spans"], strict=True):
                spans = passages(text, strategy, size, overlap, [int(b) for b in breaks], [(int(p["start"]), int(p["end"])) for p in pages])
                rows += [(doc, i, a, b, text[a:b]) for i, (a, b) in enumerate(spans)]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "start", "end", "content"])

    return marked.mapInPandas(run, _PASSAGES)
