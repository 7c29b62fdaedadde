"""Conversations from message rows.

The rows of a chat are sorted by a range partitioning over (chat, time), so even one chat
that holds a third of all rows is spread over many tasks. Each task cuts its stretch into
fragments of bounded length; as in overlapping exports, a fragment repeats the last message
of the one before it. ``merge_fragments`` then works on message hashes alone: a suffix of one
fragment that equals a prefix of another is an overlap, overlaps form a graph, and only its
unambiguous paths are merged. A chat whose fragments don't form one path has a gap.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions.keys import is_blank, micros, norm_key, strip
from passagework.session import cut_lineage, parallelism, spread_lookup

#: Messages in a fragment at most, its repeated first message included.
FRAGMENT_MESSAGES = 32
#: Primes and bases of the two rolling hashes of a stretch of messages.
ROLLING = ((2_147_483_647, 911_382_323), (2_147_483_629, 972_663_749))

_FRAGMENTS = (
    "conversation string, fragment long, pos int, carried boolean, id string, speaker string, hash long, "
    "next_id string, next_speaker string, continues boolean"
)


def current_rows(chat: DataFrame) -> DataFrame:
    """One row per id: of several states of a row, one with a non-blank bot_response holds.

    Repeated rows count once. Rows without an id are kept, one per distinct content. Columns:
    id, chat_id (trimmed, null if blank), conversation (its normalised key), user_id,
    user_query, bot_response, citations_json, at (microseconds), has_user, has_bot.
    """
    cols = ["chat_id", "user_id", "user_query", "bot_response", "citations_json", "timestamp"]
    state = F.struct((~is_blank(F.col("bot_response"))).alias("answered"), *cols)
    row = F.coalesce(F.col("id"), F.concat(F.lit("\0"), F.xxhash64(*cols).cast("string")))
    held = chat.select(row.alias("row"), F.col("id"), state.alias("s")).groupBy("row").agg(F.first("id").alias("id"), F.max("s").alias("s"))
    trimmed = strip(F.col("s.chat_id"))
    named = F.when(~is_blank(trimmed), trimmed)
    return held.select(
        "id",
        named.alias("chat_id"),
        norm_key(named).alias("conversation"),
        F.when(~is_blank(F.col("s.user_id")), norm_key(F.col("s.user_id"))).alias("user_id"),
        F.col("s.user_query").alias("user_query"),
        F.col("s.bot_response").alias("bot_response"),
        F.col("s.citations_json").alias("citations_json"),
        micros(F.col("s.timestamp")).alias("at"),
        (~is_blank(F.col("s.user_query"))).alias("has_user"),
        (~is_blank(F.col("s.bot_response"))).alias("has_bot"),
    )


def _cut(length: int, tails: dict, heads: dict):
    """Cuts the sorted messages of one partition into fragments; streams, holding one fragment."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _FRAGMENTS.split(", ")]
        out: list[tuple] = []
        held: list[tuple] = []  # (id, speaker, hash, carried)
        chat, part, number = None, 0, 0

        def flush(continues: bool) -> None:
            nonlocal number
            number += 1
            for i, (mid, speaker, code, carried) in enumerate(held):
                after = held[i + 1] if i + 1 < len(held) else (None, None)
                out.append((chat, part * 2**33 + number, i, carried, mid, speaker, code, after[0], after[1], continues and i + 1 == len(held)))

        for batch in batches:
            for part_, conversation, mid, speaker, code in zip(*(batch[c].tolist() for c in ("part", "conversation", "id", "speaker", "hash")), strict=True):
                if conversation != chat or not held:
                    if held:
                        flush(False)
                    held, chat, part = [], conversation, part_
                    before = tails.get(part) if number == 0 else None
                    if before and before[0] == chat:
                        held.append((before[1], before[2], before[3], True))
                if len(held) >= length:
                    flush(True)
                    last = held[-1]
                    held = [(last[0], last[1], last[2], True)]
                held.append((mid, speaker, code, False))
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=names)
                out.clear()
        if held:
            flush(heads.get(part) == chat)
        if out:
            yield pd.DataFrame(out, columns=names)

    return cut


def fragments(rows: DataFrame, length: int = FRAGMENT_MESSAGES) -> DataFrame:
    """Messages of ``current_rows`` in order, cut into overlapping fragments of bounded length.

    Rows without chat or time have no place in a conversation and are left out, as are blank
    texts. Order: time, then rows with a user message first, then id; within a row the user
    message comes first. Each row says which message follows (next_id, next_speaker), and
    whether the conversation goes on in another fragment (``continues``).
    """
    spark = rows.sparkSession
    parts = parallelism(spark)
    message = F.explode(F.filter(F.array(F.when(F.col("has_user"), F.lit("user")), F.when(F.col("has_bot"), F.lit("assistant"))), lambda x: x.isNotNull()))
    placed = rows.where(F.col("conversation").isNotNull() & F.col("at").isNotNull()).select("conversation", "at", (~F.col("has_user")).alias("late"), "id", message.alias("speaker"))
    order = ["conversation", "at", "late", "id", (F.col("speaker") != "user").alias("second")]
    ordered = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    coded = ordered.select(F.spark_partition_id().alias("part"), "conversation", "id", "speaker", F.xxhash64("conversation", "at", "id", "speaker").alias("hash"), F.monotonically_increasing_id().alias("__at"))
    # the partitioning must not be computed anew between here and its use below
    stretch = cut_lineage(coded)
    # one row per partition, so at most `parts` rows reach the driver
    ends = stretch.groupBy("part").agg(
        F.min_by(F.col("conversation"), F.col("__at")).alias("head"), F.max_by(F.struct("conversation", "id", "speaker", "hash"), F.col("__at")).alias("tail")
    ).orderBy("part").collect()
    tails = {b["part"]: tuple(a["tail"]) for a, b in zip(ends, ends[1:], strict=False)}
    heads = {a["part"]: b["head"] for a, b in zip(ends, ends[1:], strict=False)}
    return stretch.mapInPandas(_cut(length, tails, heads), _FRAGMENTS)


def _power(base: int, exponent: str, prime: int) -> Column:
    """base ** exponent modulo prime for exponents below 2^28, from tables for every seven bits of the exponent."""
    out = "1L"
    for bit in range(0, 28, 7):
        table = ", ".join(f"{pow(base, i << bit, prime)}L" for i in range(128))
        out = f"({out} * array({table})[shiftright({exponent}, {bit}) & 127]) % {prime}L"
    return F.expr(out)


def _stretches(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rolling hashes of all suffixes (conversation, from, overlap, code) and all prefixes (..., to, ...) of fragments: equal
    stretches of messages have equal codes wherever they lie. One row per message, so the overlaps of a long
    fragment aren't compared one by one."""
    of_fragment = Window.partitionBy("conversation", "fragment")
    so_far = of_fragment.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    at = F.col("__at")
    rows = messages.withColumn("__at", F.col("pos").cast("int"))
    for i, (prime, base) in enumerate(ROLLING):
        rows = rows.withColumn(f"term{i}", F.pmod("hash", F.lit(prime)) * _power(base, "__at", prime) % prime)
        rows = rows.withColumn(f"head{i}", F.sum(f"term{i}").over(so_far) % prime).withColumn(f"all{i}", F.sum(f"term{i}").over(of_fragment) % prime)
    rows = rows.withColumn("n", F.count("*").over(of_fragment).cast("int"))
    head = [F.col(f"head{i}") for i in range(len(ROLLING))]
    tail = [
        F.pmod(F.col(f"all{i}") - F.col(f"head{i}") + F.col(f"term{i}"), F.lit(prime)) * _power(pow(base, -1, prime), "__at", prime) % prime
        for i, (prime, base) in enumerate(ROLLING)
    ]
    prefixes = rows.select("conversation", F.col("fragment").alias("to"), (at + 1).alias("overlap"), F.struct(*head).alias("code"))
    suffixes = rows.select("conversation", F.col("fragment").alias("from"), (F.col("n") - at).alias("overlap"), F.struct(*(t.alias(f"head{i}") for i, t in enumerate(tail))).alias("code"))
    return suffixes, prefixes


def merge_fragments(messages: DataFrame) -> DataFrame:
    """Merges overlapping fragments along unambiguous paths.

    messages: conversation, fragment (unique over all conversations), pos (0, 1, ... within the
    fragment), hash. Result: one row per fragment with its ``offset`` (position of its pos 0 in the
    merged path), ``path`` (first fragment of its path), ``paths`` (paths of its conversation) and
    ``last`` (nothing follows it). A conversation with more than one path has a gap or an
    ambiguous overlap. An overlap is the longest suffix of one fragment that is a prefix of another of the
    same conversation, of any length; if two fragments compete for the same place, neither is merged
    there. Fragments that are equal as a whole count once each and compete, so they are best removed
    first. Fragments whose overlaps form a ring have no beginning: each is a path of its own.
    """
    ends = cut_lineage(messages.groupBy("conversation", "fragment").agg((F.max("pos") + 1).cast("long").alias("n")))
    # only conversations of several fragments have anything to merge; of the others nothing is hashed
    many = ends.groupBy("conversation").count().where("count > 1")
    most = many.agg(F.max("count")).first()[0] or 1
    suffixes, prefixes = _stretches(messages.join(many.select("conversation"), "conversation", "left_semi"))
    pairs = suffixes.join(prefixes, ["conversation", "overlap", "code"]).where("from != to").groupBy("conversation", "from", "to").agg(F.max("overlap").alias("overlap"))

    def sole(df: DataFrame, side: str) -> DataFrame:
        """Edges that are the one longest of their ``side``."""
        best = df.groupBy(side).agg(F.max("overlap").alias("__best"))
        top = df.join(best, side).where("overlap = __best").drop("__best")
        return top.join(top.groupBy(side).count().where("count = 1").select(side), side, "left_semi")

    edges = sole(sole(cut_lineage(pairs), "from"), "to").select("from", "to", "overlap")
    lengths_of = ends.select(F.col("fragment").alias("from"), "n")
    step = cut_lineage(edges.join(lengths_of, "from").select(F.col("to").alias("fragment"), F.col("from").alias("up"), (F.col("n") - F.col("overlap")).alias("offset")))
    followed = step.select(F.col("up").alias("fragment"), F.lit(False).alias("last"))
    # pointer doubling: after r rounds a pointer spans 2^r fragments, so what isn't at a beginning by then is in a ring
    for _ in range((most - 1).bit_length() + 1):
        above = step.select(F.col("fragment").alias("up"), F.col("up").alias("__up"), F.col("offset").alias("__offset"))
        jump = cut_lineage(step.join(above, "up", "left"))
        if jump.where("__up is not null").isEmpty():
            break
        step = cut_lineage(jump.select("fragment", F.coalesce("__up", "up").alias("up"), (F.col("offset") + F.coalesce("__offset", F.lit(0))).alias("offset")))
    ring = step.join(step.select(F.col("fragment").alias("up")), "up", "left_semi").select("fragment")
    placed = ends.join(step.join(ring, "fragment", "left_anti"), "fragment", "left").join(followed.withColumnRenamed("fragment", "__f"), F.col("fragment") == F.col("__f"), "left")
    placed = placed.select("conversation", "fragment", "n", F.coalesce("up", "fragment").alias("path"), F.coalesce("offset", F.lit(0)).alias("offset"), F.coalesce("last", F.lit(True)).alias("last"))
    paths = placed.groupBy("conversation").agg(F.sum((F.col("path") == F.col("fragment")).cast("int")).alias("paths"))
    return spread_lookup(placed, paths, "conversation", "fragment")


def conversations(chat: DataFrame, length: int = FRAGMENT_MESSAGES) -> DataFrame:
    """Every message of every complete conversation: chat_id, msg_no, speaker, id.

    A conversation is kept if it has messages, none of its rows lacks a timestamp, its rows name
    at most one user_id (nulls aside), and its messages alternate from ``user`` to ``assistant``.
    Blank texts are no messages; rows with a blank chat_id belong to no conversation. Chat ids
    that differ in case or surrounding space are one chat, spelled as its smallest trimmed form.
    Empty input gives no rows.
    """
    rows = cut_lineage(current_rows(chat).select("id", "chat_id", "conversation", "user_id", "at", "has_user", "has_bot"))
    spelled = F.min("chat_id").alias("chat_id")
    sound = (
        rows.where("conversation is not null")
        .groupBy("conversation")
        .agg(spelled, F.count_if(F.col("at").isNull()).alias("untimed"), F.min("user_id").alias("a"), F.max("user_id").alias("b"))
        .where("untimed = 0 and (a is null or a = b)")
        .select("conversation", "chat_id")
    )
    pieces = cut_lineage(fragments(rows, length))
    merged = merge_fragments(pieces.select("conversation", "fragment", "pos", "hash"))
    turns = pieces.groupBy("fragment").agg(
        F.count_if(F.col("speaker") == F.col("next_speaker")).alias("repeats"), F.min_by("speaker", "pos").alias("first"), F.max_by("speaker", "pos").alias("final")
    )
    judged = cut_lineage(merged.join(turns, "fragment"))
    whole = (
        judged.groupBy("conversation")
        .agg(
            F.max("paths").alias("paths"),
            F.sum("repeats").alias("repeats"),
            F.count_if((F.col("path") == F.col("fragment")) & (F.col("first") != "user")).alias("headless"),
            F.count_if(F.col("last") & (F.col("final") != "assistant")).alias("unanswered"),
        )
        .where("paths = 1 and repeats = 0 and headless = 0 and unanswered = 0")
        .join(sound, "conversation")
        .select("conversation", "chat_id")
    )
    # joined per fragment, of bounded length, and a hot chat's fragments are spread over many tasks
    kept = spread_lookup(judged, whole, "conversation", "fragment").where("chat_id is not null").select("fragment", "chat_id", "offset")
    numbered = pieces.where(~F.col("carried")).join(kept, "fragment")
    return numbered.select("chat_id", (F.col("offset") + F.col("pos")).cast("int").alias("msg_no"), "speaker", "id")


def pair_rows(chat: DataFrame, length: int = FRAGMENT_MESSAGES) -> DataFrame:
    """``replies`` of a table of message rows."""
    return replies(cut_lineage(current_rows(chat).select("id", "conversation", "at", "has_user", "has_bot")), length)


def replies(rows: DataFrame, length: int = FRAGMENT_MESSAGES) -> DataFrame:
    """The reply to every user message of ``current_rows``: id (row of the user message), reply_id (row of the reply, or
    null). The reply is the next message of the conversation, kept or not, if that is of the
    assistant; for rows without time or chat it is the bot_response of the same row."""
    ordered = fragments(rows, length).where("speaker = 'user' and not continues").select("id", F.when(F.col("next_speaker") == "assistant", F.col("next_id")).alias("reply_id"))
    alone = rows.where("has_user and (conversation is null or at is null)").select("id", F.when(F.col("has_bot"), F.col("id")).alias("reply_id"))
    return ordered.unionByName(alone)
