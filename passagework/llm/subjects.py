"""Subject areas of documents.

1. Terms (words and pairs of words) are hashed; how many documents have a term is counted in two tables of a fixed number
   of slots, of which the smaller count holds. Documents become normalised tf-idf vectors, randomly projected to a fixed number of dimensions. Bisecting k-means is fitted on all documents,
   and every document goes to its nearest leaf.
2. Terms that stand out among the hand-labelled documents of a subject point to it. A leaf is named by its discriminative
   terms, those more frequent in it than in the corpus: what they point to, added up, is the leaf's mixture of subjects.
   The terms of all documents then take over the mixtures of their leaves; wrong labels are outvoted there.
3. Every sentence is given the subject that its terms, and in doubt the rest of the document and the mixture of its
   leaf, point to; terms are weighed anew by the sentences they occur in, for some rounds, over all documents.
4. A document has the subjects of at least a fifth of its sentences.

Counts are kept and added up as tables of Spark; what reaches the driver and the tasks is one short row per slot.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, StorageLevel
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.functions.keys import strip
from passagework.session import cut_lineage, parallelism

#: Leaves of the clustering, iterations of a bisection, rounds in which terms are weighed anew.
LEAVES, ITERATIONS, ROUNDS = 96, 6, 3
#: How clear a term's shares must be to point to a subject (first by leaves, later by sentences), and how sure its surest term makes a sentence.
CLEAR, SURE = (0.15, 0.3), (0.18, 0.3)
#: Dimensions of the projected document vectors, and dimensions that one term adds to.
DIMENSIONS, SPOKES = 96, 4
#: Slots of a table of terms: of fixed number, so tables are bounded. Terms that share a slot of the first table count as one.
SLOTS = 2**20
#: Documents that must have a term for it to say anything (whatever the corpus), and the share of documents up to which it does.
LEAST_DOCS, COMMONEST = 3, 0.25
#: What every subject is given besides a term's counts, so that a few occurrences don't make a term clear.
DOUBT = 0.1
#: Weight of the leaf's mixture beside the scores of the document's own sentences.
PRIOR = 0.02
#: Share of the sentences from which a subject counts.
SHARE = 0.2

_WORD = re.compile(r"[^\W\d_]{2,}(?:['’-][^\W\d_]+)*|[぀-ヿ一-鿿가-힯]{2}")
_BREAK = re.compile(r"(?<=[.!?…])[\"'”»)]*\s+(?=[^\W\d_]|[¿¡\"“«(#-])|(?<=[。！？])|[\r\n  \x0b\x0c]+|\s[•·▪]\s")
_ABBREVIATION = re.compile(r"(?:^|\s)(?:no|nr|n|bzw|z\.b|e\.g|i\.e|vgl|ca|approx|fig|st|dr|mr|ms|mrs)\.$", re.I)
_HEADING = re.compile(r"^\s*(?:#{1,6}\s|(?:page|seite|página)\s\d+\s(?:of|von|de|sur|/)\s\d+\s*$)", re.I)


def sentences(text: str) -> list[list[str]]:
    """Terms of every sentence: lower-case words and pairs of neighbouring words. Headings and page marks are none."""
    out = []
    for part in _BREAK.split(text):
        if not part or _HEADING.match(part):
            continue
        words = [w.lower() for w in _WORD.findall(part)]
        if not words or (len(words) < 4 and part.rstrip()[-1:] not in ".!?…:;。！？"):
            continue
        out.append(words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)])
    return out


def _flat(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Some hundred documents at a time: their rows, ids of all sentences, ids per sentence, sentences per document."""
    for at in range(0, batch.num_rows, 1000):
        some = batch.slice(at, 1000)
        ids, lengths = some.column("ids"), some.column("lengths")
        yield some, ids.flatten().to_numpy(zero_copy_only=False), lengths.flatten().to_numpy(zero_copy_only=False), np.diff(lengths.offsets.to_numpy())


def _once(ids: np.ndarray, lengths: np.ndarray, docs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, id, number of sentences) of every term of every document, each once."""
    owner = np.repeat(np.repeat(np.arange(len(docs)), docs), lengths)
    cells, counts = np.unique(owner * width + ids, return_counts=True)
    return cells // width, cells % width, counts


def _lists(values: list[np.ndarray], sizes: list[np.ndarray], kind: str = "int32") -> pa.Array:
    offsets = np.concatenate([[0], *sizes]).cumsum().astype("int32")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, kind), *values]).astype(kind)))


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, labels, ids, lengths: the hashes of the terms of every sentence, each once, behind a -1 that stands for
    the sentence itself; and the number of ids of every sentence. Documents without sentences have no row."""
    codes: dict[str, int] = {}

    def code(term: str) -> int:
        if (found := codes.get(term)) is None:
            if len(codes) > 300_000:
                codes.clear()
            found = codes[term] = zlib.crc32(term.encode("utf-8", "replace"))
        return found

    for batch in batches:
        kept, ids, lengths, per_doc = [], [], [], []
        for i, text in enumerate(batch.column("text")):
            rows = [[-1, *{code(t) for t in terms}] for terms in sentences(text.as_py())]
            if rows:
                kept.append(i)
                lengths.append(np.array([len(r) for r in rows]))
                ids.append(np.concatenate([np.array(r) for r in rows]) if len(rows) < 50 else np.fromiter((x for r in rows for x in r), "int64"))
                per_doc.append((int(lengths[-1].sum()), len(rows)))
        sizes = np.array(per_doc, dtype="int64").reshape(-1, 2)
        at = pa.array(kept, pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("labels").take(at), _lists(ids, [sizes[:, 0]], "int64"), _lists(lengths, [sizes[:, 1]])], names=["doc_id", "labels", "ids", "lengths"])


def _slots(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A term's slots in the two tables: the low and the high bits of its hash."""
    return ids & (SLOTS - 1), (ids >> 12) & (SLOTS - 1)


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(2 * SLOTS, dtype="int64")
    for batch in batches:
        for _, ids, lengths, docs in _flat(batch):
            terms = _once(ids + 1, lengths, docs, 2**33)[1] - 1
            low, high = _slots(terms[terms >= 0])
            seen += np.bincount(np.concatenate([low, high + SLOTS]), minlength=len(seen))
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype("int32")), pa.array(seen[at])], names=["slot", "n"])


def vocabulary(coded: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of every slot of the first table, 0 if it isn't used; whether a slot of the second is used; share of the documents
    by number). Slots are used if their terms are neither in fewer than ``LEAST_DOCS`` documents nor too common; a rare term
    is only taken for another if it shares both its slots. At most two times ``SLOTS`` short rows reach the driver."""
    counts = coded.select("ids", "lengths").mapInArrow(_document_frequencies, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    kept = counts.where((F.col("n") >= LEAST_DOCS) & (F.col("n") <= max(LEAST_DOCS, n * COMMONEST))).toArrow()
    slot, n_docs = kept.column("slot").to_numpy(), kept.column("n").to_numpy()
    df = np.zeros(2 * SLOTS, dtype="int64")
    df[slot] = n_docs
    first = df[:SLOTS]
    used = np.flatnonzero(first)
    number = np.zeros(SLOTS, dtype="int32")
    number[used] = np.arange(1, len(used) + 1)
    return number, df[SLOTS:] > 0, np.concatenate([[1.0], first[used] / n]).astype("float32")


def _points(ids: np.ndarray, lengths: np.ndarray, docs: np.ndarray, share: np.ndarray, seed: int = 5) -> np.ndarray:
    """Projected tf-idf vectors of length 1. A term adds to a few dimensions, drawn from its number, so they are the same in every task."""
    rng = np.random.default_rng(seed)
    spokes, signs = rng.integers(0, DIMENSIONS, (len(share), SPOKES), dtype="int16"), rng.integers(0, 2, (len(share), SPOKES), dtype="int8") * 2 - 1
    doc, term, counts = _once(ids, lengths, docs, len(share))
    weight = np.where(term > 0, np.log1p(counts) * -np.log(np.maximum(share[term], 1e-12)), 0.0)
    points = sum(np.bincount(doc * DIMENSIONS + spokes[term, j], weights=weight * signs[term, j], minlength=len(docs) * DIMENSIONS) for j in range(SPOKES)).reshape(-1, DIMENSIONS)
    return points / np.maximum(np.sqrt((points * points).sum(axis=1, keepdims=True)), 1e-9)


def _used(ids: np.ndarray, lengths: np.ndarray, number: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids and lengths without terms that aren't used, by their numbers; 0 for the sentence itself."""
    low, high = _slots(ids)
    new = np.where((ids >= 0) & second[high], number[low], 0)
    keep = (new > 0) | (ids < 0)
    return new[keep], np.add.reduceat(keep.astype("int32"), np.cumsum(lengths) - lengths) if len(lengths) else lengths


def leaf_centres(coded: DataFrame, shared: Broadcast, leaves: int, seed: int = 11) -> np.ndarray:
    """Centres of the leaves of a bisecting k-means over all documents."""

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, second, share = shared.value
        for batch in batches:
            for _, ids, lengths, docs in _flat(batch):
                points = _points(*_used(ids, lengths, number, second), docs, share)
                yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(points.ravel()), DIMENSIONS).cast(pa.list_(pa.float64()))], names=["point"])

    points = coded.select("ids", "lengths").mapInArrow(projected, "point array<double>").select(array_to_vector("point").alias("features")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = BisectingKMeans(k=leaves, maxIter=ITERATIONS, seed=seed, minDivisibleClusterSize=8.0, featuresCol="features", predictionCol="leaf").fit(points)
        return np.array(model.clusterCenters())
    finally:
        points.unpersist()


def _counts(terms: np.ndarray, subjects: np.ndarray, n: np.ndarray, size: int, width: int) -> pa.RecordBatch:
    """term, c0, c1, ...: n added up by term and subject, for the terms that occur."""
    table = np.bincount(terms.astype("int64") * width + subjects, weights=n, minlength=size * width).reshape(size, width)
    at = np.flatnonzero(table.any(axis=1))
    return pa.RecordBatch.from_arrays([pa.array(at.astype("int32")), *(pa.array(table[at, i]) for i in range(width))], names=["term", *(f"c{i}" for i in range(width))])


def _weigh(counts: DataFrame, size: int, width: int, least: float) -> np.ndarray:
    """Per term: how far each subject stands out (its share of the term's sentences, relative to the corpus, weighed by
    how clear the shares are), and last the share of its sentences that have no subject. counts: term, c0, c1, ... by subject and,
    last, without one; several rows of a term are added up. Terms whose shares are less clear than ``least`` point to nothing."""
    columns = [f"c{i}" for i in range(width)]
    whole = cut_lineage(counts.groupBy("term").agg(*(F.sum(c).alias(c) for c in columns)))
    base = np.array([x or 0.0 for x in whole.agg(*(F.sum(c) for c in columns[:-1])).first()]) + 1.0
    usual = base / base.mean()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.column_stack([batch.column(c).to_numpy() for c in columns])
            lifted = table[:, :-1] / usual
            about, neutral = lifted.sum(axis=1, keepdims=True), table[:, -1:]
            share = (lifted + DOUBT) / (about + DOUBT * lifted.shape[1])
            clear = np.clip(1 + (share * np.log(share + 1e-12)).sum(axis=1, keepdims=True) / np.log(max(2, share.shape[1])), 0, None)
            towards = np.where((clear >= least) & (about > 0), share * clear * about / (about + neutral + 1.5), 0)
            rows = np.hstack([towards, neutral / np.maximum(about + neutral, 1e-9)]).astype("<f4")
            yield pa.RecordBatch.from_arrays([batch.column("term"), pa.array([r.tobytes() for r in rows], pa.binary())], names=["term", "w"])

    found = whole.where("term > 0").mapInArrow(weigh, "term int, w binary").toArrow()
    weights = np.zeros((size, width), dtype="float32")
    weights[found.column("term").to_numpy()] = np.frombuffer(b"".join(found.column("w").to_pylist()), "<f4").reshape(-1, width)
    return weights


def clean_labels(labels: DataFrame, areas: DataFrame) -> DataFrame:
    """doc_id, subject: the labels that name a subject area, however spelled; repeated ones count once."""

    def spelled(c: str) -> F.Column:
        return F.regexp_replace(F.lower(strip(F.col(c))), r"[\s_-]+", "_")

    names = areas.select(F.col("subject").alias("named"), spelled("subject").alias("key")).where("key is not null")
    return labels.select("doc_id", spelled("subject").alias("key")).join(F.broadcast(names), "key").select("doc_id", F.col("named").alias("subject")).distinct()


def judge(ids: np.ndarray, lengths: np.ndarray, docs: np.ndarray, weights: np.ndarray, mixtures: np.ndarray, least: float) -> np.ndarray:
    """Subject of every sentence, -1 for none. ids: terms of all sentences, one after another; lengths: ids per sentence;
    docs: sentences per document; mixtures: of the leaf of every document. A sentence needs a term that is sure of a subject, or
    terms that lean to the subject of most of the document and its leaf; and its terms must not be those of sentences without subject."""
    if not len(lengths):
        return np.zeros(0, dtype="int64")
    starts = np.cumsum(lengths) - lengths
    table = weights[ids]
    scores, surest = np.add.reduceat(table[:, :-1], starts), np.maximum.reduceat(table[:, :-1], starts)
    neutral = np.where(lengths > 1, np.add.reduceat(table[:, -1], starts) / np.maximum(lengths - 1, 1), 1.0)
    sure = (surest.max(axis=1) >= least) & (neutral < 0.5)
    of_doc = np.add.reduceat(scores * sure[:, None], np.cumsum(docs) - docs) + PRIOR * mixtures
    around = np.repeat(of_doc / np.maximum(of_doc.sum(axis=1, keepdims=True), 1e-9), docs, axis=0)
    leaning = scores * (0.4 + around)
    top, rows = leaning.argmax(axis=1), np.arange(len(lengths))
    leans = (scores[rows, top] >= least / 2) & (around[rows, top] >= 0.5) & (neutral < 0.4)
    return np.where(sure | leans, top, -1)


def subjects_of(docs: DataFrame, labels: DataFrame, areas: DataFrame, leaves: int = LEAVES, share: float = SHARE) -> DataFrame:
    """doc_id, subject, n_sentences (of the document), n_about: every subject of every document.

    docs: doc_id, text. labels: doc_id, subject (noisy, of some documents). areas: subject.
    Null, empty and blank texts have no subjects. Rows with a repeated doc_id are separate documents.
    Without labels, or without documents, there are no rows.
    """
    spark = docs.sparkSession
    key = docs.schema["doc_id"].dataType.simpleString()
    # the subject areas are a small fixed list
    names = sorted({r["subject"] for r in areas.select("subject").collect() if r["subject"]})
    empty = spark.createDataFrame([], f"doc_id {key}, subject string, n_sentences int, n_about int")
    if not names:
        return empty
    number_of = F.create_map(*(x for i, s in enumerate(names) for x in (F.lit(s), F.lit(i))))
    known = clean_labels(labels, areas).groupBy("doc_id").agg(F.array_sort(F.collect_set(number_of[F.col("subject")])).alias("labels"))
    # partitioned by id for the labels; the number of partitions is given, so the Python-bound scan keeps all cores busy
    texts = docs.select("doc_id", "text").where("text is not null and trim(text) != ''").repartition(parallelism(spark), "doc_id")
    labelled = texts.join(known.hint("merge"), "doc_id", "left").select("doc_id", "text", F.coalesce("labels", F.array().cast("array<int>")).alias("labels"))
    coded = cut_lineage(labelled.mapInArrow(_code, f"doc_id {key}, labels array<int>, ids array<long>, lengths array<int>"))
    n, votes = coded.agg(F.count("*"), F.coalesce(F.sum(F.size("labels")), F.lit(0))).first()
    if not votes:
        return empty
    number, second, frequency = vocabulary(coded, n)
    size, width = len(frequency), len(names) + 1
    shared = spark.sparkContext.broadcast((number, second, frequency))
    centres = leaf_centres(coded, shared, leaves)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, second, frequency = shared.value
        for batch in batches:
            for some, ids, lengths, docs in _flat(batch):
                ids, lengths = _used(ids, lengths, number, second)
                leaf = (_points(ids, lengths, docs, frequency) @ centres.T - (centres * centres).sum(axis=1) / 2).argmax(axis=1)
                per_doc = np.add.reduceat(lengths, np.cumsum(docs) - docs) if len(docs) else docs
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("labels"), pa.array(leaf.astype("int32")), _lists([ids], [per_doc]), _lists([lengths], [docs])], names=["doc_id", "labels", "leaf", "ids", "lengths"])

    placed = cut_lineage(coded.mapInArrow(place, f"doc_id {key}, labels array<int>, leaf int, ids array<int>, lengths array<int>"))
    shared.destroy()
    table = ", ".join(["term int", *(f"c{i} double" for i in range(width))])
    rate = votes / n

    def by_label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Terms of the labelled documents by label; they speak as loud as all documents would."""
        for batch in batches:
            for some, ids, lengths, docs in _flat(batch):
                doc, term, _ = _once(ids, lengths, docs, size)
                listed, each = some.column("labels").flatten().to_numpy(zero_copy_only=False), np.diff(some.column("labels").offsets.to_numpy())
                again = each[doc]
                inside = np.arange(again.sum()) - np.repeat(np.cumsum(again) - again, again) + np.repeat((np.cumsum(each) - each)[doc], again)
                yield _counts(np.repeat(term, again), listed[inside], np.full(len(inside), 1 / rate), size, width)

    direct = cut_lineage(placed.where(F.size("labels") > 0).mapInArrow(by_label, table))

    def by_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents by leaf and term, added up within a task as far as memory allows."""
        cells, counts, held = [], [], 0

        def flush() -> pa.RecordBatch:
            cell, at = np.unique(np.concatenate([np.zeros(0, "int64"), *cells]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([np.zeros(0), *counts]), minlength=len(cell))
            return pa.RecordBatch.from_arrays([pa.array((cell // size).astype("int32")), pa.array((cell % size).astype("int32")), pa.array(n)], names=["leaf", "term", "n"])

        for batch in batches:
            for some, ids, lengths, docs in _flat(batch):
                doc, term, _ = _once(ids, lengths, docs, size)
                cell, n = np.unique(some.column("leaf").to_numpy()[doc].astype("int64") * size + term, return_counts=True)
                cells.append(cell)
                counts.append(n)
                held += len(cell)
                if held > 4_000_000:
                    yield flush()
                    cells, counts, held = [], [], 0
        yield flush()

    in_leaves = cut_lineage(placed.select("leaf", "ids", "lengths").mapInArrow(by_leaf, "leaf int, term int, n double").groupBy("leaf", "term").agg(F.sum("n").alias("n")))
    sizes = np.zeros(len(centres))
    voted = np.zeros(len(centres))
    for r in placed.groupBy("leaf").agg(F.count("*").alias("n"), F.sum(F.size("labels")).alias("votes")).collect():
        sizes[r["leaf"]], voted[r["leaf"]] = r["n"], r["votes"]
    first = spark.sparkContext.broadcast((_weigh(direct, size, width, CLEAR[0]), frequency))

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """What the discriminative terms of the leaves point to."""
        weights, frequency = first.value
        for b in batches:
            leaf, term = b["leaf"].to_numpy(), b["term"].to_numpy()
            lift = b["n"].to_numpy() / np.maximum(sizes[leaf], 1) / frequency[term]
            gain = np.where((lift > 1.5) & (term > 0), b["n"].to_numpy() * np.log(np.maximum(lift, 1)), 0)
            scores = weights[term, :-1] * gain[:, None]
            yield pd.DataFrame({"leaf": np.arange(len(sizes)), **{f"s{i}": np.bincount(leaf, weights=scores[:, i], minlength=len(sizes)) for i in range(width - 1)}})

    mixtures = np.zeros((len(centres), width))
    pointed = in_leaves.mapInPandas(named, ", ".join(["leaf int", *(f"s{i} double" for i in range(width - 1))])).groupBy("leaf").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(width - 1)))
    for r in pointed.collect():
        scores = np.square(np.array(r[1:]))
        # a leaf with less than half of the usual labels holds documents about nothing; labels there are mistakes
        about = min(1.0, 2 * voted[r["leaf"]] / max(rate * sizes[r["leaf"]], 1e-9)) if scores.sum() > 0 else 0.0
        mixtures[r["leaf"]] = [*(about * scores / max(scores.sum(), 1e-9)), 1 - about]
    first.destroy()

    def mixed(batches: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf, term, n = b.column("leaf").to_numpy(), b.column("term").to_numpy(), b.column("n").to_numpy()
            yield _counts(np.repeat(term, width), np.tile(np.arange(width), len(term)), (mixtures[leaf] * n[:, None]).ravel(), size, width)

    weights = _weigh(direct.unionByName(in_leaves.mapInArrow(mixed, table)), size, width, CLEAR[0])

    def reweigh(held: Broadcast, least: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = np.zeros(size * width, dtype="int64")
            for batch in batches:
                for some, ids, lengths, docs in _flat(batch):
                    about = judge(ids, lengths, docs, held.value, mixtures[some.column("leaf").to_numpy(), :-1], least)
                    # a term counts once per document and subject, so that no single long document outweighs the others
                    cell = ids.astype("int64") * width + np.repeat(np.where(about < 0, width - 1, about), lengths)
                    seen += np.bincount(_once(cell, np.ones(len(cell), "int64"), np.add.reduceat(lengths, np.cumsum(docs) - docs), len(seen))[1], minlength=len(seen))
            at = np.flatnonzero(seen)
            yield _counts(at // width, at % width, seen[at], size, width)

        return run

    for turn in range(ROUNDS):
        held = spark.sparkContext.broadcast(weights)
        weights = _weigh(placed.select("leaf", "ids", "lengths").mapInArrow(reweigh(held, SURE[turn + 1 == ROUNDS]), table), size, width, CLEAR[1])
        held.destroy()
    final = spark.sparkContext.broadcast(weights)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, ids, lengths, docs in _flat(batch):
                about = judge(ids, lengths, docs, final.value, mixtures[some.column("leaf").to_numpy(), :-1], SURE[1])
                owner = np.repeat(np.arange(len(docs)), docs)
                counts = np.bincount(owner * width + np.where(about < 0, width - 1, about), minlength=len(docs) * width).reshape(-1, width)
                d, s = np.nonzero((counts[:, :-1] > 0) & (counts[:, :-1] >= share * docs[:, None]))
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id").take(pa.array(d)), pa.array([names[i] for i in s], pa.string()), pa.array(docs[d].astype("int32")), pa.array(counts[d, s].astype("int32"))], names=["doc_id", "subject", "n_sentences", "n_about"]
                )

    found = cut_lineage(placed.select("doc_id", "leaf", "ids", "lengths").mapInArrow(assign, f"doc_id {key}, subject string, n_sentences int, n_about int"))
    final.destroy()
    return found
