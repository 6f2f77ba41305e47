import random
import zlib
from collections import defaultdict

import pytest

import __spark_entry__
import corpus_pipeline
from tests.llm.test_decontaminate import brute as brute_matches
from tests.llm.test_lines_packing import brute_lines, check_sequences
from tests.llm.test_minhash import brute as brute_groups
from tidelog.llm import packing, toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r, d = random.Random(11), tmp_path_factory.mktemp("sf")
    plain = ["".join(r.choices(["the", "er", "tion", "ing", "an", "re"], k=r.randint(1, 3))) for _ in range(500)]
    rude = ["idiot", "scumbag", "worthless", "moronic", "pathetic"]
    items = [(i, " ".join(r.choices(plain, k=30))) for i in range(5)]
    rows, labels = [], []
    for i in range(500):
        words = r.choices(plain, k=r.randint(10, 60))
        toxic = r.random() < 0.25
        if toxic:
            for _ in range(r.randint(3, 8)):
                words[r.randrange(len(words))] = r.choice(rude)
        if r.random() < 0.1:
            words[3:3] = r.choice(items)[1].split(" ")
        text = " ".join(words)
        if r.random() < 0.15 and rows:
            text = r.choice(rows)[1].split("\n")[0]
            if r.random() < 0.5:
                text += " tail"
        if r.random() < 0.5:
            text += "\nsubscribe to our news"
        rows.append((i, text, "en", r.choice(["a", "a", "b", None]), len(text)))
        labels.append((i, 1, int(sum(w in rude for w in text.split()) > 2)))
    rows += [(900, None, "en", "a", None), (901, "", None, "b", 0), (902, " ".join(r.choices(plain, k=9000)), "en", "a", 1)]
    write = lambda name, x, schema: spark.createDataFrame(x, schema).repartition(3).write.parquet(f"{d}/{name}.parquet")
    write("documents", rows, COLUMNS)
    write("labels", labels, "doc_id long, quality int, toxic int")
    write("benchmark", items, "item_id long, text string")
    return str(d), rows, labels, items


def test_stages_equal_brute_force(spark, tables, tmp_path):
    d, rows, labels, items = tables
    docs, given = spark.read.parquet(f"{d}/documents.parquet"), {x[0]: x for x in rows}
    model = toxicity.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    bad = {x.doc_id for x in toxicity.score(docs, model).collect() if x.predicted}
    assert 60 < len(bad) < 200
    truth = {i for i, _, t in labels if t and zlib.crc32(str(i).encode()) % 3 == 1}
    assert len(bad & truth) > 0.8 * len(truth)
    want = {i: x[1] for i, x in given.items() if i not in bad}
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "line dedup":
            want = dict(brute_lines([(i, given[i][3], t) for i, t in want.items()], 0.05, 2))
        elif name == "near dedup":
            want = {i: want[i] for i, _, _, first in brute_groups(list(want.items()), 5, 80, 100) if first}
        elif name == "decontamination":
            leaks = {i for i, *_ in brute_matches(list(want.items()), items)}
            assert leaks
            want = {i: t for i, t in want.items() if i not in leaks}
        if name != "packing":
            assert docs.columns == list(given and [c.split()[0] for c in COLUMNS.split(", ")])
            assert {x.doc_id: x.text for x in docs.collect()} == want, name
            assert all(x.n_chars == (len(x.text) if x.text is not None else None) for x in docs.collect() if k and x.text is not None)
        kept.append(len(want))
    assert kept[0] > kept[2] > kept[3]
    found = check_sequences(docs.collect(), packing.CAPACITIES)
    assert sum(map(len, found.values())) == len(found)
    texts = defaultdict(bytes)
    for i, piece in sorted(found):
        texts[i] += found[i, piece][0]
    assert texts == {i: (t or "").encode() + packing.END for i, t in want.items()}


def test_run_is_registered_and_equals_the_stages(spark, tables):
    d, *_ = tables
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run and len(corpus_pipeline.STAGES) == 5
    got = corpus_pipeline.run(spark, d).collect()
    assert sum(len(x.doc_ids) for x in got) > 100 and all(x.n_tokens <= x.capacity for x in got)


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", COLUMNS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
