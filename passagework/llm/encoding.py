"""Encoding of texts with a public byte-level tokenizer.

Long texts are cut where the tokenizer's own pattern splits them, and the stretches are
encoded in parallel. A stretch that the pattern doesn't split (a long word, a run of signs)
is cut into halves, again and again, until it is short enough; halves are encoded on their
own and put together again by re-encoding a window around each join, which grows until its
first token is one of the left side's and its last one of the right side's. From there on
both sides agree, so the result is exactly the encoding of the whole.
"""

from __future__ import annotations

import base64
import importlib.util
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path
from typing import TYPE_CHECKING

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import tiktoken

#: Where the vocabulary files of the public tokenizers lie, and the one that is taken by default.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: Texts longer than this are cut and encoded in parallel.
STRETCH_CHARS = 8192

_IDS = "doc_id {key}, ids array<int>"


def pattern_of(folder: str) -> str:
    """The splitting pattern that belongs to the vocabulary files."""
    spec = importlib.util.spec_from_file_location("vocabulary_files", Path(folder) / "__init__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.PATTERN


@lru_cache(maxsize=4)
def tokenizer(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> tiktoken.Encoding:
    """Loaded once per Python worker."""
    import tiktoken

    ranks = {}
    with open(Path(folder) / vocabulary, "rb") as lines:
        for line in lines:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding(vocabulary, pat_str=pattern_of(folder), mergeable_ranks=ranks, special_tokens={})


def stretches(text: str, folder: str, limit: int) -> Iterator[tuple[str, bool, bool]]:
    """(part, joined, unsplit) of a text. Parts end where the pattern splits the text, and not after white
    space, whose splitting looks ahead. ``unsplit`` parts are encoded as one piece; ``joined`` ones go on
    inside the piece of the part before."""
    import regex

    start = end = 0
    since: list[str] = []  # pieces of white space after ``end``
    for m in regex.finditer(pattern_of(folder), text):
        if m.end() - m.start() > limit:
            if end > start:
                yield text[start:end], False, False
            yield from ((space, False, True) for space in since)
            yield from halves(m.group(), limit)
            start = end = m.end()
            since = []
            continue
        if m.end() - start > limit and end > start:
            yield text[start:end], False, False
            start = end
        if m.group()[-1].isspace():
            since.append(m.group())
        else:
            end, since = m.end(), []
    if start < len(text):
        yield text[start:], False, False


def halves(piece: str, limit: int, joined: bool = False) -> Iterator[tuple[str, bool, bool]]:
    if len(piece) <= limit:
        yield piece, joined, True
        return
    middle = len(piece) // 2
    yield from halves(piece[:middle], limit, joined)
    yield from halves(piece[middle:], limit, True)


def join_pieces(left: list[int], right: list[int], enc: tiktoken.Encoding) -> list[int]:
    """Encoding of the bytes of two adjoining halves of one unsplit piece."""
    if not left or not right:
        return left + right
    width = 4
    while True:
        a, b = left[-width:], right[:width]
        window = enc._encode_single_piece(enc.decode_bytes(a + b))
        whole_left, whole_right = width >= len(left), width >= len(right)
        if (whole_left or window[0] == a[0]) and (whole_right or window[-1] == b[-1]):
            return left[: len(left) - len(a)] + window + right[len(b) :]
        width *= 2


def put_together(parts: list[tuple[bool, list[int]]], enc: tiktoken.Encoding) -> list[int]:
    """(joined, ids) of all parts in order; the halves of a piece are joined pairwise, level by level."""
    ids: list[int] = []
    run: list[list[int]] = []
    for joined, some in [*parts, (False, [])]:
        if not joined:
            while len(run) > 1:
                run = [join_pieces(*run[i : i + 2], enc) if i + 1 < len(run) else run[i] for i in range(0, len(run), 2)]
            ids += run[0] if run else []
            run = []
        run.append(some)
    return ids


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, limit: int = STRETCH_CHARS) -> DataFrame:
    """doc_id, ids: the token ids of every text, without special tokens; their strings inside a text are
    ordinary text. Null and empty texts have an empty list. One row per row of df; a text above ``limit``
    code points is encoded in stretches by several tasks."""
    key = df.schema[id_col].dataType.simpleString()
    schema = pa.schema([("doc_id", pa.int64() if key == "bigint" else pa.int32() if key == "int" else pa.string()), ("ids", pa.list_(pa.int32()))])
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer(folder, vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                ids = [enc.encode_ordinary(t) if t else [] for t in some["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([some["doc_id"], pa.array(ids, pa.list_(pa.int32()))], schema=schema)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, text in zip(batch["row"], batch["text"], strict=True):
                parts = list(stretches(text, folder, limit))
                yield pd.DataFrame({"row": doc, "no": range(len(parts)), "joined": [x[1] for x in parts], "unsplit": [x[2] for x in parts], "part": [x[0] for x in parts]})

    def encode_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = tokenizer(folder, vocabulary)
        for batch in batches:
            ids = [enc._encode_single_piece(p.encode()) if unsplit else enc.encode_ordinary(p) for p, unsplit in zip(batch["part"], batch["unsplit"], strict=True)]
            yield batch[["row", "no", "joined"]].assign(ids=ids)

    def together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = tokenizer(folder, vocabulary)
        for batch in batches:
            out = [put_together([(bool(p["joined"]), list(p["ids"])) for p in parts], enc) for parts in batch["parts"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": out})

    short = rows.where(F.coalesce(F.char_length("text"), F.lit(0)) <= limit).mapInArrow(whole, _IDS.format(key=key))
    # rows are told apart by a number of their own, so repeated ids stay separate rows
    long = rows.where(F.char_length("text") > limit).withColumn("row", F.struct(F.col("doc_id"), F.xxhash64("text").alias("code"), F.monotonically_increasing_id().alias("no")))
    long = long.select(F.to_json("row", {"ignoreNullFields": "false"}).alias("row"), "text")
    parts = long.mapInPandas(cut, "row string, no int, joined boolean, unsplit boolean, part string").repartition("row", "no")
    encoded = parts.mapInPandas(encode_parts, "row string, no int, joined boolean, ids array<int>")
    gathered = encoded.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("no", "joined", "ids"))).alias("parts"))
    named = gathered.select(F.from_json("row", f"doc_id {key}")["doc_id"].alias("doc_id"), "parts")
    return short.unionByName(named.mapInPandas(together, _IDS.format(key=key)))


def count_tokens(df: DataFrame, text_col: str = "text", name: str = "n_tokens", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """df without its text, with the number of tokens of the text (0 for null and empty ones)."""
    kept = [f for f in df.schema if f.name != text_col]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = tokenizer(folder, vocabulary)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch[text_col]]
            yield batch.drop(columns=[text_col]).assign(**{name: n})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return df.mapInPandas(count, f"{schema}, `{name}` long")

