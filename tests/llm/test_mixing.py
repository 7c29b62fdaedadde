import random

import pytest

from passagework.llm.mixing import draw_mix, mix_report


def docs(spark, n=600):
    rnd = random.Random(2)
    sources = ["big"] * 6 + ["small"] + ["mid"] * 2
    rows = [(i, rnd.choice(sources), rnd.randrange(1, 40), "x") for i in range(n)] + [(9001, None, 5, "x"), (9002, "big", 0, "x"), (9003, "other", 7, "x"), (9004, "big", None, "x")]
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, weight string")


TARGETS = [("big", 0.4, 1), ("small", 0.3, 3), ("mid", 0.2, 2), ("none", 0.1, 4)]


def brute(rows, targets, budget):
    """Serves, again and again, the source whose next document would finish first."""
    draws = []
    for source, share, repeats in targets:
        mine = [r for r in rows if r[1] == source and r[2]]
        total, at = sum(r[2] for r in mine), 0
        for k in range(repeats):
            for doc, _, n in mine:
                at += n
                draws.append((at / share, doc, k, n))
        assert at == total * repeats
    out, running = set(), 0
    for _, doc, k, n in sorted(draws):
        running += n
        if running > budget:
            break
        out.add((doc, k))
    return out


@pytest.mark.parametrize("budget", [500, 4000, 30_000])
def test_agrees_with_serial_queueing(spark, budget):
    df = docs(spark)
    t = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    out = draw_mix(df, t, budget=budget, buckets=8).collect()
    # the shuffled order within a source is the operator's own: read it from its first round
    full = draw_mix(df, t, budget=10**9, buckets=8).where("repeat_no = 0").orderBy("finish").collect()
    rows = [(r.doc_id, r.source, r.n_tokens) for r in full]
    assert {(r.doc_id, r.repeat_no) for r in out} == brute(rows, TARGETS, budget)
    assert sum(r.n_tokens for r in out) == max(r.running for r in out) <= budget


def test_default_budget_reaches_the_shares(spark):
    df, t = docs(spark, 4000), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    draws = draw_mix(df, t)
    report = {r.source: r for r in mix_report(draws, df, t).collect()}
    for source, share, repeats in TARGETS[:3]:
        assert abs(report[source].reached_share - share / 0.9) < 0.01
        assert report[source].most_repeats <= repeats
    assert report["none"].draws == 0 and set(report) == {"big", "small", "mid", "none"}
    drawn = draws.groupBy("doc_id").count().collect()
    assert max(r["count"] for r in drawn) <= 3


def test_empty(spark):
    df, t = docs(spark), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    assert draw_mix(df.limit(0), t).count() == 0
    assert draw_mix(df, t.limit(0)).count() == 0
    assert [r.reached_share for r in mix_report(draw_mix(df.limit(0), t), df.limit(0), t).collect()] == [0.0] * 4
