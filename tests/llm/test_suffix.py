import random
from collections import Counter

import numpy as np
import pytest

from tidelog.llm import exchange, suffix


def brute(rows, least):
    texts = [(t or "").encode() for _, t in rows]
    counts = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for (key, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - least + 1):
            if counts[t[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        spans, at = [], 0
        while at < len(t):
            end = at
            while end < len(t) and gone[end] == gone[at]:
                end += 1
            if gone[at]:
                spans.append((at, end))
            at = end
        out.append((key, len(t), spans, bytes(c for c, g in zip(t, gone, strict=True) if not g)))
    return sorted(out, key=str)


def corpus(seed, n=140):
    r = random.Random(seed)
    letters = "abcdefghij é"
    shared = ["".join(r.choices(letters, k=k)) for k in (60, 99, 100, 101, 150, 400)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(0, 5)):
            parts.append(r.choice(shared) if r.random() < 0.5 else "".join(r.choices(letters, k=r.randint(1, 120))))
        text = "".join(parts)
        if r.random() < 0.3 and len(text) > 10:
            at = r.randrange(len(text))
            text = text[:at] + "#" + text[at + 1 :]
        rows.append((i, text))
    line = "".join(r.choices(letters, k=70))
    rows += [(2000 + i, f"{r.random()}{r.random()}{line}{r.random()}{r.random()}") for i in range(40)]
    rows += [(900, None), (901, ""), (902, "z" * 99), (903, "z" * 100), (904, "y" * 101), (905, "ab" * 3000), (None, rows[3][1]), (None, rows[4][1]), (5, rows[5][1]), (5, rows[5][1])]
    return rows


@pytest.mark.parametrize("mode", ["plain", "small", "hot"])
def test_removal_equals_brute_force(spark, monkeypatch, mode):
    if mode != "plain":
        monkeypatch.setattr(exchange, "BLOCK_BYTES", 4000)
        monkeypatch.setattr(suffix, "SAMPLES_A_BUCKET", 300)
        monkeypatch.setattr(suffix, "CONTEXT_BYTES_A_BUCKET", 5000)
    if mode == "hot":
        monkeypatch.setattr(suffix, "MOST_CONTEXTS", 3)
        monkeypatch.setattr(suffix, "MOST_IN_BLOCK", 2)
        monkeypatch.setattr(suffix, "_CHUNK", 700)
    rows = corpus(4)
    df = spark.createDataFrame([(*x, 1, b"x") for x in rows], "doc_id long, text string, block int, kept binary").repartition(5)
    got = suffix.remove_repeats(df, least=100).collect()
    assert sorted(((x.doc_id, x.n_bytes, [tuple(s) for s in x.spans], bytes(x.kept)) for x in got), key=str) == brute(rows, 100)


def test_lone_window_of_a_gram_dealt_out_elsewhere(spark, monkeypatch):
    monkeypatch.setattr(suffix, "SAMPLES_A_BUCKET", 1)
    monkeypatch.setattr(suffix, "MOST_IN_BLOCK", 3)
    r = random.Random(3)
    text = lambda n: "".join(r.choices("abcdefghij", k=n))
    shared = [text(110) for _ in range(3)]
    long = lambda: "".join(text(90) + x for x in shared) + text(90)
    many, lone = [(i, long()) for i in range(5)], (5000, long())
    monkeypatch.setattr(exchange, "BLOCK_BYTES", sum(len(x[1]) for x in many))  # two blocks
    df = spark.createDataFrame([*many, lone], "doc_id long, text string").coalesce(1)
    got = suffix.remove_repeats(df, least=100).collect()
    assert sorted(((x.doc_id, x.n_bytes, [tuple(s) for s in x.spans], bytes(x.kept)) for x in got), key=str) == brute([*many, lone], 100)


def test_empty_table(spark):
    assert suffix.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    short = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert sorted((x.doc_id, bytes(x.kept)) for x in suffix.remove_repeats(short).collect()) == [(1, b"a"), (2, b"")]


def test_family_knows_what_comes_again_and_keeps_few_levels():
    r, family, seen, first = random.Random(1), suffix.Family(40_000), Counter(), {}
    for batch in range(60):
        keys = sorted({(r.randrange(400), r.randrange(9)) for _ in range(50)})
        ids = family.add(np.array([k[0] for k in keys], np.uint64), np.array([k[1] for k in keys], np.uint64), batch)
        for k, i in zip(keys, ids.tolist(), strict=True):
            seen[k] += 1
            assert first.setdefault(k, i) == i
        assert len(family.levels) <= 12
    by_gram = Counter(g for g, _ in seen)
    for k, i in first.items():
        assert family.again[i] == (seen[k] > 1) and family.shared[i] == (by_gram[k[0]] > 1)
