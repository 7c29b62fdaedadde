"""Splitting oversized texts at natural boundaries, with an exact overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.functions.keys import norm_key
from passagework.session import salted_lookup

#: Bounds and defaults of a piece's size and of the overlap, in code points.
SMALLEST, LARGEST, DEFAULT_SIZE, DEFAULT_OVERLAP = 200, 4000, 1200, 180

#: Separators from coarse to fine; a cut lies at the end of a match. Sections start with a heading or page break.
SEPARATORS = (
    re.compile(r"\n+(?=#{1,6} )|\f+|\n(?:[-=_*]{3,})\n+"),
    re.compile(r"(?:\r?\n[ \t]*){2,}"),
    re.compile(r"[.!?…]+[\"'»”’)\]]*\s+|[。！？]+|\n+"),
    re.compile(r"\s+"),
)

_PIECES = "id string, piece_no int, n_pieces int, start_pos int, end_pos int, piece string"


def _atoms(text: str, start: int, end: int, room: int, level: int = 0) -> Iterator[int]:
    """Ends of stretches of at most ``room`` that together make up text[start:end]."""
    if end - start <= room:
        yield end
        return
    if level == len(SEPARATORS):
        yield from range(start + room, end, room)
        yield end
        return
    at = start
    for m in SEPARATORS[level].finditer(text, start, end):
        if m.end() < end:
            yield from _atoms(text, at, m.end(), room, level + 1)
            at = m.end()
    yield from _atoms(text, at, end, room, level + 1)


def split_text(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of the pieces of one text: each within ``size``, each after the first beginning exactly
    ``overlap`` before the end of the one before. Stretches between separators are packed greedily."""
    if len(text) <= size:
        return [(0, len(text))] if text else []
    spans, start, end = [], 0, 0
    for stop in _atoms(text, 0, len(text), size - overlap):
        if stop - start > size:
            spans.append((start, end))
            start = end - overlap
        end = stop
    spans.append((start, end))
    return spans


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in _PIECES.split(", ")]
    for batch in batches:
        out, held = [], 0
        for row in zip(batch["id"], batch["text"], batch["size"], batch["overlap"], strict=True):
            spans = split_text(row[1], int(row[2]), int(row[3]))
            out += [(row[0], i, len(spans), a, b, row[1][a:b]) for i, (a, b) in enumerate(spans)]
            held += len(row[1])
            if held > 4_000_000:
                yield pd.DataFrame(out, columns=columns)
                out, held = [], 0
        yield pd.DataFrame(out, columns=columns)


def limits_of_files(files: DataFrame) -> DataFrame:
    """file, size, overlap: the chunk settings of the version of each file that holds (latest updated_at),
    within the allowed range; null settings give the defaults."""
    held = files.select(norm_key(F.col("id")).alias("file"), F.struct("updated_at", "chunk_size", "chunk_overlap").alias("s")).where("file <> ''").groupBy("file").agg(F.max("s").alias("s"))
    # the default first: least and greatest skip nulls, so a null size would become the smallest one
    size = F.least(F.greatest(F.coalesce(F.col("s.chunk_size"), F.lit(DEFAULT_SIZE)), F.lit(SMALLEST)), F.lit(LARGEST))
    return held.select("file", size.cast("int").alias("size"), F.col("s.chunk_overlap").cast("int").alias("overlap"))


def split_oversized(chunks: DataFrame, files: DataFrame, id_col: str = "id", text_col: str = "content", file_col: str = "file_id") -> DataFrame:
    """Pieces of every text with more code points than its file allows: chunk_id, piece_no (from 0),
    n_pieces, start_pos, end_pos, piece. Texts within their limit give no rows.

    Cuts lie at sections, else paragraphs, else sentences, else words, else between characters. Pieces
    without their overlap, put together, are the text again. The overlap is kept between 0 and half the size.
    Null and empty texts give no rows; texts whose file is null, blank or unknown are cut at 1200.
    Repeated rows count once. A file that holds a third of all texts is spread over many tasks.
    """
    # nothing shorter than the smallest limit can be oversized, so most texts never meet the join
    long = chunks.select(F.col(id_col).cast("string").alias("id"), norm_key(F.col(file_col)).alias("file"), F.col(text_col).alias("text")).where(F.char_length("text") > SMALLEST)
    known = salted_lookup(long, limits_of_files(files), "file", "id")
    size = F.coalesce(F.col("size"), F.lit(DEFAULT_SIZE))
    overlap = F.greatest(F.lit(0), F.least(F.coalesce(F.col("overlap"), F.lit(DEFAULT_OVERLAP)), F.floor(size / 2).cast("int")))
    over = known.select("id", "text", size.alias("size"), overlap.alias("overlap")).where(F.char_length("text") > F.col("size")).dropDuplicates(["id"])
    return over.mapInPandas(_split, _PIECES).withColumnRenamed("id", "chunk_id")
