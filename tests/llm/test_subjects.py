import random

from passagework.llm import subjects
from passagework.llm.subjects import sentences, subjects_of

NOUNS = {"law": "court judge appeal verdict clause witness".split(), "sport": "match coach goal racket stadium sprint".split(), "food": "broth flour yeast oven skillet roux".split()}
NEUTRAL = ["Please read the notes below.", "This page was last checked in May.", "Copies older than a year can be thrown away.", "The table of contents is short."]
AREAS = "subject string, description string"


def corpus(n=500):
    rnd = random.Random(4)
    docs, truth, labels = [], set(), []
    for i in range(n):
        topics = rnd.sample(sorted(NOUNS), rnd.choice([0, 1, 1, 1, 2]))
        lines = rnd.choices(NEUTRAL, k=rnd.randrange(1, 4))
        for t in topics:
            for _ in range(4):
                a, b = rnd.sample(NOUNS[t], 2)
                lines.append(rnd.choice(["Keep the {} and the {} together.", "Before each {}, check that the {} is new.", "The {} matters because of the {}."]).format(a, b))
            truth.add((i, t))
        rnd.shuffle(lines)
        docs.append((i, " ".join(lines), "x"))
        if rnd.random() < 0.3:
            labels += [(i, (t.upper() + " ") if rnd.random() < 0.3 else t, "a") for t in (topics if rnd.random() > 0.1 else [rnd.choice(sorted(NOUNS))])]
    return docs, labels + labels[:5] + [(None, "law", "a"), (1, "no such", "a"), (2, None, "a")], truth


def frames(spark, docs, labels):
    areas = spark.createDataFrame([(s, "") for s in NOUNS], AREAS)
    return spark.createDataFrame(docs, "doc_id long, text string, subject string"), spark.createDataFrame(labels, "doc_id long, subject string, annotator string"), areas


def test_accuracy_with_noisy_labels(spark):
    docs, labels, truth = corpus()
    extra = [(9001, None, "x"), (9002, "", "x"), (9003, " \n ", "x"), (9004, "😀" * 50, "x"), (9005, "Before each court, check that the judge is new. " * 5000, "x")]
    got = {(r.doc_id, r.subject) for r in subjects_of(*frames(spark, [*docs, *extra], labels), leaves=12).collect()}
    assert not {d for d, _ in got} & {9001, 9002, 9003, 9004} and (9005, "law") in got
    got = {x for x in got if x[0] < 9000}
    assert len(got & truth) / len(truth) > 0.9 and len(got & truth) / len(got) > 0.9


def test_without_labels_or_documents(spark):
    docs, labels, _ = corpus(20)
    d, lab, areas = frames(spark, docs, labels)
    assert subjects_of(d, lab.limit(0), areas).count() == 0
    assert subjects_of(d.limit(0), lab, areas).count() == 0


def test_sentences():
    assert len(sentences("Notes\n\n- The court is new.\n- Version 2.5 is out. See page 3.\nPage 1 of 2")) == 3
    assert sentences("") == []


def test_all_documents_shape_the_leaves(spark, monkeypatch):
    fitted = []

    class Recorded(subjects.BisectingKMeans):
        def fit(self, points):
            fitted.append(points.count())
            return super().fit(points)

    monkeypatch.setattr(subjects, "BisectingKMeans", Recorded)
    monkeypatch.setattr(subjects, "FIT_ROWS", 50, raising=False)
    docs, labels, _ = corpus(200)
    subjects_of(*frames(spark, docs, labels), leaves=4)
    assert fitted == [200]
