"""Term statistics, lexical scores and BM25 for a whole table of questions at once.

Chunks are a table with chunk_id, content, contextual, title, modality, source_name, file_id, chunk_index.
Question terms are few and are broadcast (``MOST_TERMS`` bounds them); the passages are scanned
once, only the terms that are asked for leave the scan, and corpus statistics are aggregated before any join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions.text import INTENTS, tokens
from passagework.session import cut_lineage, parallelism, spread_lookup

#: Most question terms that are broadcast to the scan; more are joined by shuffle.
MOST_TERMS = 100_000
#: Most question terms that are written into the plan itself.
LISTED_TERMS = 2000
#: Passages and questions of a scope that meet in one block at most, about; rows of a group of blocks; scores held at once.
BLOCK_PASSAGES, BLOCK_QUESTIONS, GROUP_ROWS, CELLS = 16_384, 8192, 8000, 1_000_000
#: Saturation and length normalisation of BM25, weights of the lexical score.
K1, B = 1.2, 0.75
COVERAGE, EXACT, TITLE = 3.0, 2.0, 0.5


def small(df: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """df to be broadcast if it has at most ``most`` rows, else df as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def chunks_of(df: DataFrame, distinct: bool = True) -> DataFrame:
    """Passages with the columns the operators here use; repeated rows count once. Without ``distinct`` repeated rows stay: the
    operators of this module drop them after the scan, so that no text goes through a shuffle."""
    return (df.dropDuplicates(["id"]) if distinct else df).select(
        F.col("id").alias("chunk_id"), "resource_id", "file_id", "chunk_index", "source_name", "modality", "title", "content", F.col("contextual_content").alias("contextual"), "page_start", "page_end"
    )


def question_terms(questions: DataFrame) -> DataFrame:
    """query_id, term, qtf: terms of the questions (query_id, question) with their counts."""
    return questions.select("query_id", F.explode(tokens(F.col("question"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def words_of(chunks: DataFrame) -> Column:
    """Tokens of a passage: those of ``words``, joined by spaces, if the passages come with them, so that texts are cut only once."""
    if "words" not in chunks.columns:
        return tokens(F.col("contextual"))
    return F.when(F.col("words") == "", F.array().cast("array<string>")).otherwise(F.split("words", " "))


def found_terms(chunks: DataFrame, terms: DataFrame | None, *columns: str) -> DataFrame:
    """chunk_id, columns, length (number of tokens), term: a row per token, with ``terms`` only for these (query terms).

    A few asked terms are filtered inside the token array, so the other tokens never become rows. Repeated rows of a passage
    are dropped here, when only tokens are left."""
    words = words_of(chunks)
    many, kept = None, words
    if terms is not None:
        asked = terms.select("term").distinct()
        listed = [r["term"] for r in asked.limit(LISTED_TERMS + 1).collect()]
        if len(listed) > LISTED_TERMS:
            many = asked
        else:
            kept = F.filter(words, lambda t: t.isin(*listed)) if listed else F.array().cast("array<string>")
    rows = chunks.select("chunk_id", *columns, F.size(words).alias("length"), kept.alias("__found")).where(F.size("__found") > 0).dropDuplicates(["chunk_id"])
    rows = rows.select("chunk_id", *columns, "length", F.explode("__found").alias("term"))
    return rows.join(small(many), "term", "left_semi") if many is not None else rows


def postings(chunks: DataFrame, terms: DataFrame | None = None, length: bool = False) -> DataFrame:
    """chunk_id, term, tf (and ``length``, the number of tokens of the passage); with ``terms`` only for these."""
    return found_terms(chunks, terms).groupBy("chunk_id", *(["length"] if length else []), "term").agg(F.count("*").alias("tf"))


def term_stats(chunks: DataFrame) -> DataFrame:
    """term, df, cf, idf over all passages."""
    n = chunks.select("chunk_id").distinct().count()
    return postings(chunks).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).withColumn("idf", idf(F.col("df"), F.lit(n)))


def idf(df: Column, n: Column) -> Column:
    return F.greatest(F.lit(0.0), F.log(1 + (n - df + 0.5) / (df + 0.5)))


def lengths(chunks: DataFrame) -> DataFrame:
    """chunk_id, length: number of tokens of every passage, each once."""
    return chunks.select("chunk_id", F.size(words_of(chunks)).alias("length")).dropDuplicates(["chunk_id"])


def corpus_size(chunks: DataFrame) -> tuple[int, float]:
    """Number of passages, and their mean length (passages without terms count)."""
    row = lengths(chunks).agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    return row["n"], row["mean"] or 0.0


def bm25(chunks: DataFrame, terms: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, chunk_id, typed, expanded: the two halves of the BM25 score.

    terms: query_id, term, weight, typed (boolean: the user wrote it). Terms that no passage has, and an empty
    corpus, give no rows.
    """
    n, mean = corpus_size(chunks)
    # only the asked terms, so this is small beside the corpus; it is used twice
    found = cut_lineage(postings(chunks, terms, length=True))
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    asked = terms.join(df, "term").select("query_id", "term", "weight", "typed", idf(F.col("df"), F.lit(n)).alias("idf"))
    norm = F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(mean if mean > 0 else 1.0))
    part = F.col("weight") * F.col("idf") * F.col("tf") * (k1 + 1) / norm
    return (
        found.join(small(asked), "term")
        .groupBy("query_id", "chunk_id")
        .agg(F.sum(F.when(F.col("typed"), part).otherwise(0.0)).alias("typed"), F.sum(F.when(F.col("typed"), 0.0).otherwise(part)).alias("expanded"))
    )


def capped(scores: DataFrame, fraction: float = 0.35) -> DataFrame:
    """query_id, chunk_id, score: the expanded half counts up to a fraction of the best typed half of the question
    (without limit if nothing typed was found)."""
    rows = cut_lineage(scores)
    # aggregated before the shuffle and joined back: a window would put all passages of a question in one task
    best = rows.groupBy("query_id").agg(F.max("typed").alias("best"))
    half = F.when(F.col("best") > 0, F.least(F.col("expanded"), F.col("best") * fraction)).otherwise(F.col("expanded"))
    return rows.join(small(best), "query_id").select("query_id", "chunk_id", (F.col("typed") + half).alias("score")).where("score > 0")


def ranked(scores: DataFrame, k: int, *ties: str, by: tuple[str, ...] = ("query_id",), digits: int = 9) -> DataFrame:
    """The first k rows of every question with their rank; scores that agree in ``digits`` places are ties."""
    order = [F.desc(F.round("score", digits)), *(ties or ("chunk_id",))]
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def lexical(chunks: DataFrame, questions: DataFrame, counted: bool = True, boost: bool = False) -> DataFrame:
    """query_id, chunk_id, chunk_index, score, overlap: term products over the root of the length, plus bonuses for
    coverage, for the question as a whole in the passage, and for a term in the title. Passages without a
    common term have no row. ``counted``: terms of the question count as often as they occur.
    ``boost``: kinds of content that the question asks for count more."""
    terms = question_terms(questions)
    many = terms.groupBy("query_id").agg(F.count("*").alias("wanted"), F.collect_set("term").alias("asked"))
    features = ["chunk_id", "chunk_index", "title", "modality", "length"]
    found = found_terms(chunks, terms, "chunk_index", "title", "modality").groupBy(*features, "term").agg(F.count("*").alias("tf"))
    hits = found.join(small(terms), "term").groupBy("query_id", *features).agg(F.sum(F.col("tf") * (F.col("qtf") if counted else F.lit(1))).alias("product"), F.collect_set("term").alias("common"))
    rows = cut_lineage(hits.join(small(questions.join(many, "query_id")), "query_id"))
    # only a passage with all inner terms of a question can hold it as a whole, so few texts are looked at
    overlap = F.size("common")
    likely = rows.where(overlap >= F.col("wanted") - 2).select("query_id", "chunk_id", "question")
    whole = likely.join(chunks.select("chunk_id", "contextual"), "chunk_id").where(F.contains(F.lower("contextual"), F.lower("question"))).select("query_id", "chunk_id").distinct()
    rows = rows.join(whole.withColumn("whole", F.lit(True)), ["query_id", "chunk_id"], "left")
    title = F.lower(F.coalesce("title", F.lit("")))
    score = (
        F.col("product") / F.sqrt(F.greatest(F.col("length"), F.lit(1)))
        + COVERAGE * overlap / F.col("wanted")
        + F.when(F.col("whole"), EXACT).otherwise(0.0)
        + F.when(F.exists("common", lambda t: F.contains(title, t)), TITLE).otherwise(0.0)
    )
    if boost:
        wants = {k: F.arrays_overlap("asked", F.array(*map(F.lit, words))) for k, words in INTENTS.items()}
        match = F.lit(False)
        for kind, wanted in wants.items():
            match = match | (wanted & (F.col("modality") == kind))
        score = score * F.when(match, 1.8).when(F.col("modality").isin("pdf", "text"), 1.1).otherwise(1.0)
    return rows.select("query_id", "chunk_id", "chunk_index", score.alias("score"), overlap.alias("overlap"), "wanted")


def query_variants(questions: DataFrame) -> DataFrame:
    """query_id, variant_no, variant: the question, its terms, the terms in reverse, and the first three (the last two
    only with more than two terms); equal ones once, in this order."""
    terms = F.array_distinct(tokens(F.col("question")))
    more = F.array(F.array_join(F.reverse(terms), " "), F.array_join(F.slice(terms, 1, 3), " "))
    listed = F.concat(F.array(F.col("question"), F.array_join(terms, " ")), F.when(F.size(terms) > 2, more).otherwise(F.array().cast("array<string>")))
    return questions.select("query_id", F.posexplode(F.array_distinct(F.filter(listed, lambda v: v != ""))).alias("variant_no", "variant"))


def rrf(lists: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists: query_id, chunk_id, rank -> query_id, chunk_id, score."""
    return lists.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def coverage(chunks: DataFrame, questions: DataFrame, results: DataFrame, top: int) -> DataFrame:
    """query_id, best, covered: the best score, and the share of the question's terms that its first results contain."""
    terms = question_terms(questions)
    wanted = terms.groupBy("query_id").agg(F.count("*").alias("wanted"))
    first = results.where(F.col("rank") <= top)
    texts = first.select("query_id", "chunk_id").join(postings(chunks.join(first.select("chunk_id").distinct(), "chunk_id", "left_semi"), terms), "chunk_id")
    found = texts.join(terms.select("query_id", "term"), ["query_id", "term"]).groupBy("query_id").agg(F.countDistinct("term").alias("found"))
    best = results.groupBy("query_id").agg(F.max("score").alias("best"))
    rows = questions.select("query_id").join(wanted, "query_id", "left").join(found, "query_id", "left").join(best, "query_id", "left")
    return rows.select("query_id", F.coalesce("best", F.lit(0.0)).alias("best"), F.coalesce(F.try_divide(F.coalesce("found", F.lit(0)), F.col("wanted")), F.lit(0.0)).alias("covered"))


def sufficient(cover: DataFrame, least: float = 0.35, similar: DataFrame | None = None) -> DataFrame:
    """Gate on the first three results: enough terms covered and something scored; or, with ``similar`` (query_id, similarity,
    floor: of the results of a vector search, and what counts as evidence for its model), one similar enough."""
    enough = (F.col("covered") >= least) & (F.col("best") > 0)
    if similar is None:
        return cover.withColumn("sufficient", enough)
    near = similar.groupBy("query_id").agg(F.bool_or(F.col("similarity") >= F.col("floor")).alias("near"))
    return cover.join(near, "query_id", "left").withColumn("sufficient", enough | F.coalesce("near", F.lit(False))).drop("near")


def scoped_bm25(chunks: DataFrame, questions: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, chunk_id, score, rank: the first ``k`` passages for every question (query_id, scope, question), asked of the
    passages of its scope, with the statistics of that scope: number of passages, their mean length, and document frequencies.

    chunks: chunk_id, scope, contextual. Every question meets every passage of its scope that has a term of it, but these
    pairs never become rows: passages and questions of a scope meet in blocks, and of a block only the first ``k`` passages of a
    question leave the task. Questions of a scope with the same terms are scored once.
    """
    spark = chunks.sparkSession
    words = F.flatten(F.collect_set(F.array_distinct(tokens(F.col("question")))))
    asked = questions.groupBy("query_id", "scope").agg(F.array_join(F.array_sort(F.array_distinct(words)), " ").alias("words")).where("words != ''")
    asked = cut_lineage(asked.select("query_id", F.concat("words", F.lit("\n"), "scope").alias("key")))
    # a scope may have line breaks, terms have none
    sets = cut_lineage(asked.select("key").distinct())
    sets = sets.select("key", F.substring_index("key", "\n", 1).alias("words"), F.expr("substring(key, instr(key, '\n') + 1)").alias("scope"))
    n, m = chunks.count(), sets.count()
    stored = chunks.where("scope is not null").groupBy("scope").agg(F.ceil(F.count("*") / BLOCK_PASSAGES).cast("int").alias("pieces")).where("pieces > 1")
    many = sets.groupBy("scope").agg(F.ceil(F.count("*") / BLOCK_QUESTIONS).cast("int").alias("turns")).where("turns > 1")
    # few scopes are larger than a block
    large = cut_lineage(stored.join(many, "scope", "full").select("scope", F.coalesce("pieces", F.lit(1)).alias("pieces"), F.coalesce("turns", F.lit(1)).alias("turns")))
    units = large.agg(F.coalesce(F.sum(F.col("pieces") * F.col("turns")), F.lit(0))).first()[0]
    groups = max(parallelism(spark), (n + m) // GROUP_ROWS + units)

    def cut(df: DataFrame) -> DataFrame:
        return df.join(small(large), "scope", "left").withColumns({"pieces": F.coalesce("pieces", F.lit(1)), "turns": F.coalesce("turns", F.lit(1))})

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    def grouped(df: DataFrame, *parts: str):
        """df by group; a unit is a block of passages, and of questions, of a scope, and a group holds several."""
        unit = F.concat_ws("\n", *(F.col(c).cast("string") for c in parts), "scope")
        return df.withColumn("unit", unit).withColumn("group", F.pmod(F.xxhash64("unit"), F.lit(groups))).groupBy("group")

    # passages with the numbers of the asked terms they have; text goes through the shuffle as its tokens only
    terms = tokens(F.col("contextual"))
    rows = chunks.where("scope is not null").select("chunk_id", "scope", F.array_join(terms, " ").alias("words")).dropDuplicates(["chunk_id"])
    vocabulary = sets.select("scope", F.explode(F.split("words", " ")).alias("term")).distinct().groupBy("scope").agg(F.array_join(F.array_sort(F.collect_list("term")), " ").alias("words"))
    vocabulary = cut_lineage(vocabulary)
    if vocabulary.count() <= MOST_TERMS:  # else the groups leave out the passages of other scopes
        rows = rows.join(F.broadcast(vocabulary.select("scope")), "scope", "left_semi")
    pieces = cut(rows).withColumn("piece", F.pmod(F.xxhash64("chunk_id"), F.col("pieces")).cast("int"))
    known = cut(vocabulary).withColumn("piece", every("pieces"))
    coded = grouped(pieces.select("chunk_id", "scope", "piece", "turns", "words"), "piece").cogroup(grouped(known.select("scope", "piece", "words"), "piece"))
    coded = cut_lineage(coded.applyInArrow(_numbered, "chunk_id string, scope string, piece int, turns int, length int, terms array<int>, tf array<int>"))
    sizes = coded.groupBy("scope").agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    df = coded.select("scope", F.explode("terms").alias("term")).groupBy("scope", "term").agg(F.count("*").alias("df"))
    weights = df.join(sizes, "scope").select("scope", "mean", "term", idf(F.col("df"), F.col("n")).alias("idf"))
    weights = weights.groupBy("scope").agg(F.first("mean").alias("mean"), F.collect_list("term").alias("terms"), F.collect_list("idf").alias("idf"))
    blank = {"key": "string", "mean": "double", "terms": "array<int>", "idf": "array<double>"}
    stats = vocabulary.join(weights, "scope").withColumn("key", F.lit(None).cast("string"))
    right = cut(stats.unionByName(sets.withColumns({c: F.lit(None).cast(t) for c, t in blank.items() if c != "key"})))
    turn = F.when(F.col("key").isNull(), F.sequence(F.lit(0), F.col("turns") - 1)).otherwise(F.array(F.pmod(F.xxhash64("key"), F.col("turns")).cast("int")))
    right = right.withColumn("turn", F.explode(turn)).withColumn("piece", every("pieces")).select("scope", "piece", "turn", *blank, "words")
    left = coded.where(F.size("terms") > 0).withColumn("turn", every("turns")).select("chunk_id", "scope", "piece", "turn", "length", "terms", "tf")

    def score(passages: pa.Table, asked: pa.Table) -> pa.Table:
        return _first_of_units(passages, asked, k, k1, b)

    best = grouped(left, "piece", "turn").cogroup(grouped(right, "piece", "turn")).applyInArrow(score, "key string, found array<struct<chunk_id:string,score:double>>")
    order = F.transform(F.flatten(F.collect_list("found")), lambda x: F.struct((-F.round(x["score"], 9)).alias("worse"), x["chunk_id"].alias("chunk_id"), x["score"].alias("score")))
    best = best.groupBy("key").agg(F.slice(F.array_sort(order), 1, k).alias("found"))
    pairs = spread_lookup(asked, best, "key", "query_id").select("query_id", F.explode("found").alias("f"))
    return ranked(pairs.select("query_id", "f.chunk_id", "f.score"), k)


def _numbered(passages: pa.Table, known: pa.Table) -> pa.Table:
    """Passages (of units whose terms are known) with the asked terms they have, by their numbers in the unit's sorted list."""
    numbers = {u: {t: i for i, t in enumerate(w.split(" "))} for u, w in zip(known["unit"].to_pylist(), known["words"].to_pylist(), strict=True)}
    kept, length, terms, tf = [], [], [], []
    for i, (unit, words) in enumerate(zip(passages["unit"].to_pylist(), passages["words"].to_pylist(), strict=True)):
        number = numbers.get(unit)
        if number is None:
            continue
        listed = words.split(" ") if words else []
        counts = Counter(number[t] for t in listed if t in number)
        kept.append(i)
        length.append(len(listed))
        terms.append(list(counts))
        tf.append(list(counts.values()))
    some = passages.select(["chunk_id", "scope", "piece", "turns"]).take(pa.array(kept, pa.int64()))
    ints = pa.list_(pa.int32())
    return pa.table([*some.columns, pa.array(length, pa.int32()), pa.array(terms, ints), pa.array(tf, ints)], names=[*some.column_names, "length", "terms", "tf"])


def _runs(units: pa.ChunkedArray) -> dict[str, tuple[int, int]]:
    """First row and end of every unit in rows sorted by it."""
    runs = pc.run_end_encode(units.combine_chunks())
    ends = runs.run_ends.to_pylist()
    return dict(zip(runs.values.to_pylist(), zip([0, *ends[:-1]], ends, strict=True), strict=True)) if ends else {}


def _first_of_units(passages: pa.Table, asked: pa.Table, k: int, k1: float, b: float) -> pa.Table:
    """key, found: the first ``k`` passages of every unit for every set of terms of it that has any. Rows of ``asked`` without a key hold
    the unit's terms and their weights."""
    passages = passages.sort_by([("unit", "ascending"), ("chunk_id", "ascending")]).combine_chunks()
    asked = asked.sort_by([("unit", "ascending"), ("key", "ascending")]).combine_chunks()
    length = passages["length"].to_numpy()
    sizes = pc.list_value_length(passages["terms"]).to_numpy()
    at = np.concatenate([[0], np.cumsum(sizes)])
    terms, tf = pc.list_flatten(passages["terms"]).to_numpy(), pc.list_flatten(passages["tf"]).to_numpy()
    keys, listed, inside = asked["key"].to_pylist(), asked["words"].to_pylist(), _runs(asked["unit"])
    which, chosen, scores, ns = [], [], [], []
    for unit, (first, end) in _runs(passages["unit"]).items():
        low, high = inside.get(unit, (0, 0))
        if high - low < 2:
            continue
        # the row without a key is the last of its unit
        number = {t: i for i, t in enumerate(listed[high - 1].split(" "))}
        weight = np.zeros(len(number))
        weight[np.array(asked["terms"][high - 1].as_py())] = asked["idf"][high - 1].as_py()
        mean = max(asked["mean"][high - 1].as_py(), 1e-9)
        own, freq = terms[at[first] : at[end]], tf[at[first] : at[end]]
        holder = np.repeat(np.arange(end - first), sizes[first:end])
        part = weight[own] * freq * (k1 + 1) / (freq + k1 * (1 - b + b * length[first:end][holder] / mean))
        order = np.argsort(own, kind="stable")
        holder, part = holder[order], part[order]
        df = np.bincount(own, minlength=len(number))
        start = np.cumsum(df) - df
        sets = [[number[t] for t in w.split(" ")] for w in listed[low : high - 1]]
        n, step = end - first, max(1, CELLS // (end - first))
        for i in range(0, len(sets), step):
            some = sets[i : i + step]
            term = np.fromiter((t for s in some for t in s), "int64")
            row = np.repeat(np.arange(len(some)), [len(s) for s in some])
            count = df[term]
            post = np.arange(count.sum()) + np.repeat(start[term] - (np.cumsum(count) - count), count)
            table = np.bincount(np.repeat(row * n, count) + holder[post], weights=part[post], minlength=len(some) * n).reshape(len(some), n)
            # of rounded scores that tie the first in the order of ids count, so all that may tie stay here
            floor = np.partition(table, n - k, axis=1)[:, n - k, None] - 2e-9 if n > k else -1.0
            r, c = np.nonzero((table > 0) & (table >= floor))
            value = table[r, c]
            order = np.lexsort((c, -np.round(value, 9), r))
            r, c, value = r[order], c[order], value[order]
            each = np.bincount(r, minlength=len(some))
            place = np.arange(len(r)) - np.repeat(np.cumsum(each) - each, each)
            kept = place < k
            each = np.minimum(each, k)
            which += [keys[low + i + j] for j in np.flatnonzero(each)]
            ns.append(each[each > 0])
            chosen.append(first + c[kept])
            scores.append(value[kept])
    none = np.zeros(0, "int64")
    ids = passages["chunk_id"].take(pa.array(np.concatenate([none, *chosen]))).combine_chunks()
    found = pa.StructArray.from_arrays([ids, pa.array(np.concatenate([np.zeros(0), *scores]))], names=["chunk_id", "score"])
    ends = pa.array(np.concatenate([[0], np.cumsum(np.concatenate([none, *ns]))]).astype("int32"))
    return pa.table([pa.array(which, pa.string()), pa.ListArray.from_arrays(ends, found)], names=["key", "found"])


def graded(cover: DataFrame) -> DataFrame:
    """Grade on the first five results."""
    return cover.withColumn("grade", F.when((F.col("covered") >= 0.65) & (F.col("best") >= 1.0), "strong").when(F.col("covered") >= 0.35, "moderate").otherwise("weak"))


def vocabulary_gap(questions: DataFrame, chunks: DataFrame, most: int = 6) -> DataFrame:
    """query_id, term, place: terms of questions that no passage has, in order, the first ``most`` of each question."""
    asked = questions.select("query_id", F.posexplode(F.array_distinct(tokens(F.col("question")))).alias("pos", "term"))
    known = chunks.select(F.explode(F.array_distinct(tokens(F.col("contextual")))).alias("term")).distinct()
    missing = asked.join(known, "term", "left_anti")
    return missing.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).where(F.col("place") <= most).select("query_id", "term", "place")


def vocabulary_hint(missing: DataFrame) -> DataFrame:
    """query_id, hint: a sentence that names the words of a question (query_id, term, place, as ``vocabulary_gap`` gives them)
    that no passage has. Questions whose words all occur have no row."""
    words = missing.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "term"))).alias("ws"))
    listed = F.array_join(F.transform("ws", lambda w: F.concat(F.lit("**"), w["term"], F.lit("**"))), ", ")
    verb = F.when(F.size("ws") == 1, "does not appear").otherwise("do not appear")
    return words.select("query_id", F.concat(F.lit(" "), listed, F.lit(" "), verb, F.lit(" anywhere in this document.")).alias("hint"))


def by_mode(questions: DataFrame, rankers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """query_id, mode, chunk_id, rank, score: every question (query_id, question, mode) ranked in its mode.

    A ranker gets the questions of its mode as query_id, question, and gives query_id, chunk_id, rank, score. The modes are
    those of ``functions.text.MODES``; questions whose mode has no ranker have no rows."""
    rows = [
        rank(questions.where(F.col("mode") == mode).select("query_id", "question")).select("query_id", F.lit(mode).alias("mode"), "chunk_id", "rank", "score")
        for mode, rank in rankers.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def _shortened(term: Column) -> Column:
    """The term and the term without one of its characters: two terms within one edit share one of these."""
    cut = F.transform(F.sequence(F.lit(1), F.char_length(term)), lambda i: F.concat(F.substring(term, F.lit(1), i - 1), F.substring(term, i + 1, F.lit(10_000))))
    return F.array_distinct(F.concat(F.array(term), cut))


def spelling(terms: DataFrame, stats: DataFrame, shortest: int = 5) -> DataFrame:
    """term, correction: for terms that no passage has, the one vocabulary term within one edit that occurs at least
    twice; none if there are several. Candidates meet on shortened forms, an equi-join, instead of pair by pair."""
    unknown = terms.select("term").distinct().where(F.char_length("term") >= shortest).join(stats.select("term"), "term", "left_anti")
    known = stats.where("cf >= 2").select(F.col("term").alias("correction"))
    left = unknown.select("term", F.explode(_shortened(F.col("term"))).alias("form"))
    right = known.where(F.char_length("correction") >= shortest - 1).select("correction", F.explode(_shortened(F.col("correction"))).alias("form"))
    near = left.join(right, "form").select("term", "correction").distinct().where(F.levenshtein("term", "correction") <= 1)
    return near.groupBy("term").agg(F.count("*").alias("n"), F.min("correction").alias("correction")).where("n = 1").select("term", "correction")


def feedback_terms(chunks: DataFrame, results: DataFrame, questions: DataFrame, docs: int = 5, most: int = 6, shortest: int = 3) -> DataFrame:
    """query_id, term, weight, place: terms of the first results that tell them apart from the corpus
    (frequency within the passage times idf), without the question's own terms."""
    n = chunks.select("chunk_id").distinct().count()
    first = results.where(F.col("rank") <= docs).select("query_id", "chunk_id")
    texts = chunks.join(first.select("chunk_id").distinct(), "chunk_id", "left_semi")
    inside = cut_lineage(postings(texts, length=True).where(F.char_length("term") >= shortest).join(first, "chunk_id"))
    df = postings(chunks, inside).groupBy("term").agg(F.count("*").alias("df"))
    own = question_terms(questions).select("query_id", "term")
    scored = inside.join(own, ["query_id", "term"], "left_anti").join(df, "term").groupBy("query_id", "term").agg(F.sum(F.col("tf") / F.col("length") * idf(F.col("df"), F.lit(n))).alias("score"))
    return ranked(scored.where("score > 0"), most, "term").select("query_id", "term", F.col("score").alias("weight"), F.col("rank").alias("place"))
