import math
import random

import numpy as np
from pyspark.sql import functions as F

from passagework.functions import text
from passagework.operators import dense, evaluation, graph, precision
from passagework.operators import lexical as lex
from passagework.operators.precision import ABLATION, Settings, around, closeness, cross_score, diverse, likeness, retrieve, trace, without_duplicates
from passagework.operators.questions import expanded, forms, normal, terms_in, unhyphened, widened

COLUMNS = "id string, resource_id string, file_id string, chunk_index int, source_name string, modality string, title string, content string, contextual_content string, page_start int, page_end int, score double, rank int"


def frame(spark, texts):
    return lex.chunks_of(spark.createDataFrame([(f"c{i}", "r", f"f{i // 3}", i, f"doc{i}.pdf", "text", "Valve notes" if i == 1 else None, x, x, None, None, 0.0, 1) for i, x in enumerate(texts)], COLUMNS))


TEXTS = ["valve pump valve", "pump axle", "valve", "", None, "the gasket seals the valve and the pump", "valve " * 3000]


def test_bm25_agrees_with_the_formula(spark):
    q = spark.createDataFrame([(1, "Valve pump?"), (2, "unseen"), (3, None)], "query_id int, question string")
    terms = lex.question_terms(q).select("query_id", "term", F.lit(1.0).alias("weight"), F.lit(True).alias("typed"))
    got = {r.chunk_id: r.typed for r in lex.bm25(frame(spark, TEXTS), terms).collect()}
    docs = [terms_in(x or "") for x in TEXTS]
    mean = sum(map(len, docs)) / len(docs)
    for i, d in enumerate(docs):
        want = 0.0
        for t in ("valve", "pump"):
            df = sum(t in x for x in docs)
            tf = d.count(t)
            if tf:
                want += max(0, math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
        assert math.isclose(got.get(f"c{i}", 0.0), want, abs_tol=1e-9)


def test_empty_corpus_and_questions(spark):
    q = spark.createDataFrame([(1, "valve")], "query_id int, question string")
    terms = lex.question_terms(q).select("query_id", "term", F.lit(1.0).alias("weight"), F.lit(True).alias("typed"))
    none = frame(spark, TEXTS).limit(0)
    assert lex.bm25(none, terms).count() == 0 and lex.lexical(none, q).count() == 0
    assert lex.lexical(frame(spark, TEXTS), q.limit(0)).count() == 0


def written(plan):
    """Most rows that one shuffle of a plan that ran has written."""
    name = plan.getClass().getSimpleName()
    inner = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    own = plan.metrics().get("shuffleRecordsWritten").get().value() if name == "ShuffleExchangeExec" else 0
    return max([own, *map(written, inner)])


def test_scoped_bm25_in_blocks(spark, monkeypatch):
    for name, size in (("BLOCK_PASSAGES", 40), ("BLOCK_QUESTIONS", 30), ("GROUP_ROWS", 50), ("CELLS", 100)):
        monkeypatch.setattr(lex, name, size, raising=False)
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    docs = [(f"c{i:03}", "big" if i < 200 else f"s{i % 7}\n", " ".join(rnd.choices(words, k=rnd.randrange(9)))) for i in range(260)]
    # asked twice, once with a term more; of two scopes; without terms; of no scope
    asked = [(f"q{i:03}", "big", " ".join(rnd.choices(words, k=3))) for i in range(150)] + [(f"t{i}", f"s{i % 7}\n", " ".join(rnd.choices(words, k=3))) for i in range(14)]
    asked += [("u", "big", "w1 w2"), ("u", "big", "w2 w3"), ("v", "big", "w4"), ("v", "s1\n", "w5 w5"), ("x", "big", "the"), ("y", "none", "w1")]
    chunks, questions = spark.createDataFrame(docs + docs[:30], "chunk_id string, scope string, contextual string"), spark.createDataFrame(asked, "query_id string, scope string, question string")
    terms, inside = {}, {}
    for q, scope, text_ in asked:
        terms.setdefault((q, scope), set()).update(terms_in(text_))
    for c, scope, text_ in docs:
        inside.setdefault(scope, {})[c] = terms_in(text_)
    scores = {}
    for (q, scope), wanted in terms.items():
        own = inside.get(scope, {})
        for c, d in own.items():
            for t in wanted & set(d):
                df, mean = sum(t in x for x in own.values()), sum(map(len, own.values())) / len(own)
                scores.setdefault(q, {}).setdefault(c, []).append(math.log(1 + (len(own) - df + 0.5) / (df + 0.5)) * d.count(t) * 2.2 / (d.count(t) + 1.2 * (0.25 + 0.75 * len(d) / mean)))
    want = {(q, c, i + 1) for q, of in scores.items() for i, c in enumerate(sorted(of, key=lambda c: (-round(math.fsum(of[c]), 9), c))[:5])}
    found = lex.scoped_bm25(chunks, questions, 5)
    assert {(r.query_id, r.chunk_id, r.rank) for r in found.collect()} == want
    # 150 questions of "big" meet some 130 passages each: these pairs go through no shuffle
    assert written(found._jdf.queryExecution().executedPlan()) < 5000
    assert lex.scoped_bm25(chunks.limit(0), questions, 5).count() == 0 and lex.scoped_bm25(chunks, questions.limit(0), 5).count() == 0


def test_variants_and_fusion(spark):
    q = spark.createDataFrame([(1, "the valve opens a pump"), (2, "valve"), (3, "")], "query_id int, question string")
    got = {}
    for r in lex.query_variants(q).orderBy("query_id", "variant_no").collect():
        got.setdefault(r.query_id, []).append(r.variant)
    assert got == {1: ["the valve opens a pump", "valve opens pump", "pump opens valve"], 2: ["valve"]}
    lists = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "b", 1)], "query_id int, chunk_id string, rank int")
    assert {r.chunk_id: round(r.score, 9) for r in lex.rrf(lists).collect()} == {"a": round(1 / 61, 9), "b": round(1 / 61 + 1 / 62, 9)}


def test_spelling_needs_one_frequent_neighbour(spark):
    stats = spark.createDataFrame([("valve", 3), ("value", 5), ("gasket", 2), ("rarity", 1)], "term string, cf long")
    asked = spark.createDataFrame([("valvx",), ("gaskets",), ("gsket",), ("rarit",), ("valve",), ("gas",)], "term string")
    assert {(r.term, r.correction) for r in lex.spelling(asked, stats).collect()} == {("gaskets", "gasket"), ("gsket", "gasket"), ("valvx", "valve")}


def test_questions():
    assert normal('The Engine’s "size" — v1.0.3, OK.') == "the engine size v1.0.3 ok"
    assert forms("policies") == ["policy"] and forms("planning") == ["plann", "plan"] and forms("cats") == [] and forms("valve") == ["valves"] and forms("a-b") == []
    assert unhyphened("state-of-the-art") == ["stateoftheart", "state", "art"]
    out = dict((t, (w, o)) for t, w, o in widened(["db", "error", "pool", "size"], {}, {"poolsize"}))
    assert out["db"] == (1.0, "typed") and out["database"] == (0.45, "canonical") and out["poolsize"] == (0.85, "compound") and len(out) <= 16


def test_expansion_frame(spark):
    q = spark.createDataFrame([(1, "Fix the pol size"), (2, "the"), (3, None)], "query_id int, question string")
    fixes = spark.createDataFrame([("pol", "pool")], "term string, correction string")
    got = {(r.term, r.origin) for r in expanded(q, fixes, spark.createDataFrame([("fix-pol",), ("other",)], "term string")).collect()}
    assert {("fix", "typed"), ("pool", "correction"), ("repair", "synonym"), ("fix-pol", "compound")} <= got and ("other", "compound") not in got


def test_expansion_by_entities(spark):
    q = spark.createDataFrame([(1, "what of the gemera"), (2, "pool size"), (3, None)], "query_id int, question string")
    aliases = graph.question_aliases(frame(spark, ["by Koenigsegg Gemera here", "a Gemera Hybrid too"]))
    got = [(r.query_id, r.term) for r in sorted(expanded(q, aliases=aliases).where("origin = 'alias'").collect(), key=lambda r: r.place)]
    assert got == [(1, "koenigsegg"), (1, "hybrid")]


def test_graph(spark):
    found = graph.chunk_entities(frame(spark, ["Ann Lee met Bob Ray and Cid Poe.", "ANN LEE saw Bob Ray."]))
    assert {r.key: r.weight for r in graph.nodes(found).collect()}["bob ray"] == 2
    assert {(r.source, r.target): r.weight for r in graph.edges(found).collect()}[("ann lee", "bob ray")] == 2
    base = spark.createDataFrame([(1, "x", 2.0)], "query_id int, chunk_id string, score double")
    q = spark.createDataFrame([(1, "what of Ann")], "query_id int, question string")
    refs = spark.createDataFrame([("e1", "Ann Lee", 3, "y"), ("e1", "Ann Lee", 3, "x"), ("e2", "Bob", 9, "z")], "entity string, name string, weight int, chunk_id string")
    got = {r.chunk_id: r.score for r in graph.graph_boost(base, q, refs).collect()}
    a = 1.3
    assert math.isclose(got["y"], 0.35 * 2 * a / (a + 3)) and math.isclose(got["x"], 2 + got["y"]) and "z" not in got


def test_metrics_agree_with_the_formula(spark):
    results = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "a", 3), (1, "c", 4), (2, "x", 1)], "query_id int, item string, rank int")
    qrels = spark.createDataFrame([(1, "b"), (1, "c"), (2, "y"), (3, "z")], "query_id int, item string")
    m = {r.query_id: r for r in evaluation.per_query(results, qrels).collect()}
    assert (m[1].mrr, m[1].recall_5, m[1].precision_5, m[1].hit_1) == (0.5, 1.0, 0.4, 0)
    assert math.isclose(m[1].ndcg_5, (1 / math.log2(3) + 1 / math.log2(4)) / (1 + 1 / math.log2(3)))
    assert m[2].mrr == 0 and m[3].recall_10 == 0
    groups = spark.createDataFrame([(1, 0, "b"), (1, 0, "a"), (1, 1, "c")], "query_id int, group_id int, item string")
    assert {(r.group_id, r["rank"]) for r in evaluation.group_hits(results, groups).collect()} == {(0, 1), (1, 4)}
    v = spark.createDataFrame([(float(i),) for i in range(8)], "ms double")
    assert evaluation.nearest_rank(v, "ms", 0.5).first().value == 4.0  # 3.5 rounds to the even place


def test_dense_agrees_with_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, [0.0] * 8), (901, [1.0]), (902, None), (903, [float("nan")] * 8)]
    df = spark.createDataFrame(rows, "item int, v array<double>")
    got = {}
    for r in dense.dense_topk(df, df.where("item % 20 = 0").withColumnRenamed("item", "query_id"), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.item)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 300, 20):
        s = unit @ unit[q]
        s[q] = -2
        assert got[q] == list(np.argsort(-s)[:5])
    assert 900 not in got


def test_greedy_stages():
    a, b, c = {"x", "y"}, {"x", "y"}, {"z"}
    assert likeness(a, b) == (1.0, 1.0) and likeness(a, set()) == (0.0, 0.0) and likeness({"x"}, a) == (0.5, 1.0)
    assert without_duplicates([0, 1, 2], [a, b, c], 0.9) == [0, 2] and without_duplicates([0, 1], [set(), set()], 0.9) == [0, 1]
    assert diverse([0, 1, 2], [3.0, 2.9, 1.0], [a, b, c], 0.3, 3) == [0, 2, 1] and diverse([0, 1, 2], [1.0, 3.0, 2.0], [a, b, c], 1.0, 2) == [1, 2]
    assert closeness([]) == 0 and closeness([(3, "a")]) == 0.35 and closeness([(0, "a"), (1, "b")]) == 1.0


def test_proximity_is_the_narrowest_window():
    rnd = random.Random(6)
    for _ in range(100):
        events = sorted({(rnd.randrange(60), rnd.choice("abc")) for _ in range(rnd.randrange(2, 14))})
        present = {t for _, t in events}
        if len(present) > 1:
            width = min(events[j][0] - events[i][0] for i in range(len(events)) for j in range(i, len(events)) if {t for _, t in events[i : j + 1]} == present)
            assert math.isclose(closeness(events), 1 / (1 + math.log(1 + max(width - len(present) + 1, 0) / 3)))


def test_cross_score_and_context():
    w = {"valve": 1.0, "pump": 1.0}
    assert cross_score(["valve", "pump"], w, "valve pump", "valve pump test", None) > cross_score(["valve", "pump"], w, "valve pump", "pump far far far far valve", None) > cross_score(["valve", "pump"], w, "valve pump", "nothing", None) == 0
    family = [(0, "aaaa"), (1, "bb"), (2, "cccc")]
    assert around(1, family, 100) == "aaaa bb cccc" and around(1, family, 8) == "aaaa bb cc" and around(1, family, 4) == "aa bb" and around(1, family[1:2], 9) is None and around(1, family, 1) is None


def test_pipeline_contract(spark):
    rnd = random.Random(1)
    words = "valve pump axle gasket rotor bench clutch seal".split()
    texts = [" ".join(rnd.choices(words, k=12)) for _ in range(60)] + ["valve pump " * 6] * 3
    q = spark.createDataFrame([(1, "valve pump"), (2, "unseen words"), (3, "")], "query_id int, question string")
    rows = retrieve(frame(spark, texts), q, settings=Settings(results=5)).collect()
    assert {r.query_id for r in rows} == {1} and sorted(r.place for r in rows) == [1, 2, 3, 4, 5]
    assert all(r.n_pool >= r.n_reranked >= r.n_distinct >= len(rows) for r in rows)
    kept = {r.stage: r.kept for r in trace(retrieve(frame(spark, texts), q)).collect()}
    assert kept["fusion"] >= kept["rerank"] >= kept["dedup"] >= kept["diversity"]


def test_vector_codec(spark):
    from passagework.sources import vectors

    df = spark.createDataFrame([("[1, 2.5]",), ("[1, null]",), ('{"a": 1}',), ("[1, 2",), (None,), ("[]",)], "t string")
    got = [r.v for r in df.select(vectors.from_text(F.col("t")).alias("v")).collect()]
    assert got == [[1.0, 2.5], None, None, None, None, []]
    back = df.select(vectors.unpack(vectors.pack(vectors.from_text(F.col("t")))).alias("v")).collect()
    assert [r.v for r in back] == got
    assert spark.createDataFrame([(b"123",)], "b binary").select(vectors.unpack(F.col("b")).alias("v")).first().v is None


def test_group_metrics(spark):
    results = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id int, item string, rank int")
    groups = spark.createDataFrame([(1, 0, "b"), (1, 0, "a"), (1, 1, "c"), (1, 2, "z")], "query_id int, group_id int, item string")
    m = evaluation.per_query_groups(results, groups).first()
    assert m.mrr == 1.0 and math.isclose(m.recall_5, 2 / 3) and math.isclose(m.ndcg_5, (1 + 1 / 2) / (1 + 1 / math.log2(3) + 1 / 2))


def test_modes_and_their_rankers(spark):
    spelled = ["Rag-Fusion", " corrective\n", "", None, "what", "HIGH_PRECISION"]
    got = [r.m for r in spark.createDataFrame([(i, s) for i, s in enumerate(spelled)], "i int, s string").select("i", text.mode_of(F.col("s")).alias("m")).orderBy("i").collect()]
    assert got == ["rag_fusion", "corrective", "contextual_hybrid", "contextual_hybrid", "contextual_hybrid", "high_precision"]
    asked = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "z")], "query_id int, question string, mode string")
    ranker = lambda score: lambda qs: qs.select("query_id", F.col("question").alias("chunk_id"), F.lit(1).alias("rank"), F.lit(score).alias("score"))
    rows = lex.by_mode(asked, {"x": ranker(0.5), "y": ranker(0.25)}).collect()
    assert sorted(map(tuple, rows)) == [(1, "x", "a", 1, 0.5), (2, "y", "b", 1, 0.25)]


def test_hint_names_missing_words(spark):
    gap = spark.createDataFrame([(1, "ring", 2), (1, "piston", 1), (2, "size", 1)], "query_id int, term string, place int")
    rows = dict(map(tuple, lex.vocabulary_hint(gap).collect()))
    assert rows == {1: " **piston**, **ring** do not appear anywhere in this document.", 2: " **size** does not appear anywhere in this document."}


def test_stages_can_be_left_out(spark):
    rng = random.Random(5)
    rows = frame(spark, [" ".join(rng.choice(["valve", "pump", "seal", "ring", "stock", "crane", "bolt"]) for _ in range(rng.randint(4, 14))) for _ in range(30)])
    q = spark.createDataFrame([(1, "valve seal pump"), (2, "crane ring")], "query_id int, question string")
    bare = {(r.query_id, r.place): r.chunk_id for r in retrieve(rows, q, settings=ABLATION["bm25"]).collect()}
    terms = lex.question_terms(q).select("query_id", "term", F.lit(1.0).alias("weight"), F.lit(True).alias("typed"))
    plain = {(r.query_id, r["rank"]): r.chunk_id for r in lex.ranked(lex.capped(lex.bm25(rows, terms)), 10).collect()}
    assert bare == plain and len(bare) == 20
    kept = {r.stage: r.kept for r in trace(retrieve(rows, q, settings=ABLATION["bm25_rerank"]).where("query_id = 1")).collect()}
    assert kept["dedup"] == kept["rerank"] == 20 and kept["diversity"] == 10


def test_rankings_share_one_pass_over_the_texts(spark, monkeypatch):
    """Repeated rows of passages count once, and a second ranking cuts no text again."""
    calls = []
    own = precision.with_metadata
    monkeypatch.setattr(precision, "with_metadata", lambda *a: calls.append(1) or own(*a))
    rows = frame(spark, TEXTS)
    q = spark.createDataFrame([(1, "valve pump axle")], "query_id int, question string")
    corpus = precision.corpus_of(rows.union(rows))
    shared = {name: sorted(retrieve(corpus, q, settings=ABLATION[name]).collect()) for name in ("bm25", "full")}
    assert len(calls) == 1 and corpus.marked.count() == len(TEXTS)
    assert shared["full"] == sorted(retrieve(rows, q, settings=ABLATION["full"]).collect()) and shared["bm25"]
