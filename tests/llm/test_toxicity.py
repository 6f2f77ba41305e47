import random
import zlib

import pytest

from tidelog.llm import toxicity


def corpus(n, seed=1):
    r = random.Random(seed)
    plain = ["".join(r.choices(["the", "er", "tion", "ing", "an", "re"], k=r.randint(1, 3))) for _ in range(600)]
    rude = ["idiot", "scumbag", "worthless", "moronic", "pathetic"]
    docs, labels = [], []
    for i in range(n):
        toxic = r.random() < 0.3
        words = r.choices(plain, k=r.randint(20, 120))
        if toxic:
            for _ in range(r.randint(3, 8)):
                words[r.randrange(len(words))] = r.choice(rude)
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_split(spark):
    docs, labels = corpus(900)
    d, y = spark.createDataFrame([(i, t, "x", 0.5) for i, t in docs], "doc_id long, text string, lang string, score double"), spark.createDataFrame([(i, v, 1) for i, v in labels], "doc_id long, toxic int, quality int")
    model = toxicity.fit(d, y)
    got = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    truth = dict(labels)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in truth)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    held = [i for i in truth if got[i].held_out]
    assert sum(got[i].predicted == truth[i] for i in held) / len(held) > 0.93
    kept = toxicity.reject(d, model).collect()
    assert {r.doc_id for r in kept} == {i for i in truth if not got[i].predicted} and kept[0].lang == "x"
    flipped = y.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    assert toxicity.fit(d, flipped) == model, "held-out labels must not matter"


def test_odd_rows(spark):
    docs, labels = corpus(300)
    model = toxicity.train([t for (_, t), (_, y) in zip(docs, labels, strict=True) if y], [t for (_, t), (_, y) in zip(docs, labels, strict=True) if not y])
    rows = [(None, None), (None, "x"), (1, ""), (1, ""), (2, None), (3, "a" * 200_000), (4, "idiot scumbag worthless moronic pathetic " * 10_000), (5, "퟿ 𝄞 é")]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert len(got) == len(rows) and all(r.score is not None for r in got)
    by = {r.doc_id: r for r in got}
    assert by[4].predicted == 1 and by[2].score == by[1].score and by[1].predicted == 0 and by[None].held_out is False
    assert toxicity.score(spark.createDataFrame([], "doc_id long, text string"), model).collect() == []


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(None, 1), (2, None)]])
def test_too_few_labels(spark, labels):
    d = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    model = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert [r.score for r in toxicity.score(d, model).collect()] == [0.0, 0.0]


def test_fitting_gives_the_sample_back(spark, monkeypatch):
    docs, labels = corpus(60)
    given = []
    monkeypatch.setattr(toxicity.workers, "give_back", lambda f=toxicity.workers.give_back: given.append(f()))
    assert toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).known
    assert given
