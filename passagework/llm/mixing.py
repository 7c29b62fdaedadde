"""Mixing sources to target weights by weighted fair queueing.

Within a source the documents are shuffled by a hash of their id; a document's virtual
finish time is the number of the source's tokens up to it, divided by the source's weight.
Repeats of a source follow one another. The draws of all sources, sorted by finish time and
cut at the total budget, give every source its share. Running totals are taken in two steps
(bucket sums, then within the bucket), so neither a large source nor the whole order meets
one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions.keys import norm_key
from passagework.session import cut_lineage, parallelism

#: Buckets of a source's shuffled order.
BUCKETS = 512


def _sources(totals: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source of the targets: its weight, tokens and most tokens it can give."""
    wanted = targets.where("target_share > 0").groupBy(norm_key(F.col("source")).alias("key")).agg(F.sum("target_share").alias("weight"), F.max(F.greatest(F.col("max_repeats"), F.lit(1))).alias("max_repeats"))
    return wanted.join(totals, "key", "left").withColumn("total", F.coalesce("total", F.lit(0)))


def draw_mix(docs: DataFrame, targets: DataFrame, budget: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Draws of documents: doc_id, source, repeat_no (from 0), n_tokens, finish, running (tokens drawn so far).

    docs: doc_id, source, n_tokens. targets: source, target_share, max_repeats.
    budget: total tokens; by default the largest total at which no source runs out of repeats, so
    that every source that has documents gets its share (shares of sources without documents fall
    to the others in proportion). With a larger budget the sources that run out fall short.
    Documents without tokens, of no source or of a source without target are never drawn. Equal
    finish times are ordered by document id, so every run draws the same. Repeated doc_ids are
    separate documents. No documents or no targets: no draws.
    """
    sized = docs.select("doc_id", "source", norm_key(F.col("source")).alias("key"), F.col("n_tokens").cast("long").alias("n_tokens")).where("n_tokens > 0 and key is not null")
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit(17))
    placed = cut_lineage(sized.withColumn("order", order).withColumn("bucket", F.pmod(F.shiftright("order", 40), F.lit(buckets)).cast("int")))
    sums = placed.groupBy("key", "bucket").agg(F.sum("n_tokens").alias("tokens"))
    sources = cut_lineage(_sources(sums.groupBy("key").agg(F.sum("tokens").alias("total")), targets))
    if budget is None:
        # one row: weights of the sources that have documents, and the total at which the first one runs out
        end = sources.where("total > 0").select(F.sum("weight").alias("weight"), F.min(F.col("total") * F.col("max_repeats") / F.col("weight")).alias("most")).first()
        budget = int((end["most"] or 0) * (end["weight"] or 0))
    # a source may be served further than its share once others have run out, so all its repeats may be needed
    short = sources.where((F.col("total") > 0) & (F.col("total") * F.col("max_repeats") < F.lit(budget) * F.col("weight"))).limit(1).count() > 0
    weights = sources.where("total > 0").agg(F.sum("weight").alias("w")).first()["w"] or 1.0
    share = F.ceil(F.lit(budget) * F.col("weight") / F.lit(weights) / F.col("total")) + 1
    rounds = F.col("max_repeats") if short else F.least(F.col("max_repeats"), share)
    before = F.sum("tokens").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.withColumn("before", F.coalesce(before, F.lit(0))).join(sources.where("total > 0"), "key").select("key", "bucket", "before", "weight", "total", rounds.cast("int").alias("rounds"))
    within = Window.partitionBy("key", "bucket").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    queued = placed.join(starts, ["key", "bucket"]).withColumn("upto", F.sum("n_tokens").over(within) + F.col("before"))
    draws = queued.withColumn("repeat_no", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)))
    finish = (F.col("repeat_no") * F.col("total") + F.col("upto")) / F.col("weight")
    timed = draws.select("doc_id", "source", "repeat_no", "n_tokens", finish.alias("finish"))
    line = ["finish", "doc_id", "repeat_no"]
    ranged = timed.repartitionByRange(parallelism(docs.sparkSession), *line).sortWithinPartitions(*line)
    sorted_ = cut_lineage(ranged.withColumn("part", F.spark_partition_id()))
    # one row per partition
    parts = sorted_.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    heads = parts.select("part", F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("head"))
    needed = sorted_.join(F.broadcast(heads.where(F.col("head") < budget)), "part")
    running = F.sum("n_tokens").over(Window.partitionBy("part").orderBy(*line).rowsBetween(Window.unboundedPreceding, 0)) + F.col("head")
    return needed.withColumn("running", running).where(F.col("running") <= budget).select("doc_id", "source", "repeat_no", "n_tokens", "finish", "running")


def mix_report(draws: DataFrame, docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of the targets: source, target_share, reached_share, tokens_drawn, draws, docs_drawn, tokens_held, max_repeats, most_repeats."""
    drawn = draws.groupBy(norm_key(F.col("source")).alias("key")).agg(F.sum("n_tokens").alias("tokens_drawn"), F.count("*").alias("draws"), F.countDistinct("doc_id").alias("docs_drawn"), (F.max("repeat_no") + 1).alias("most_repeats"))
    held = docs.groupBy(norm_key(F.col("source")).alias("key")).agg(F.sum("n_tokens").alias("tokens_held"))
    total = drawn.agg(F.sum("tokens_drawn").alias("n")).first()["n"] or 0
    rows = targets.withColumn("key", norm_key(F.col("source"))).join(drawn, "key", "left").join(held, "key", "left")
    zero = F.lit(0)
    return rows.select(
        "source",
        "target_share",
        F.coalesce(F.try_divide(F.col("tokens_drawn"), F.lit(total)), F.lit(0.0)).alias("reached_share"),
        *(F.coalesce(F.col(c), zero).cast("long").alias(c) for c in ("tokens_drawn", "draws", "docs_drawn", "tokens_held")),
        F.col("max_repeats").cast("int").alias("max_repeats"),
        F.coalesce("most_repeats", zero).cast("int").alias("most_repeats"),
    )
