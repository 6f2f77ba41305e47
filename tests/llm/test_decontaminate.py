import random
import re
from collections import Counter

import pytest

from tidelog.llm import decontaminate


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]


def shingles(w, k):
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(rows, items, num=80, den=100):
    out = []
    for key, text in rows:
        w = words(text)
        for item, item_text in items:
            v = words(item_text)
            k = min(5, len(v))
            if not v or item is None or len(w) < k:
                continue
            own, best = shingles(v, k), None
            last = max(len(w) - len(v), 0)
            for s in range(last + 1):
                if s < last and tuple(w[s : s + k]) not in own:
                    continue
                window = shingles(w[s : s + len(v)], k)
                common = sum((own & window).values())
                union = sum((own | window).values())
                if common * den >= union * num and (best is None or common > best[3]):
                    best = (item, s, min(len(v), len(w)), common, union)
            if best:
                out.append((key, *best))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randint(8, 60)))) for i in range(25)]
    items += [(100, "one two three"), (101, "solo"), (102, ""), (103, None), (104, "x y x y x y x y x y x y x y"), (None, "no id here at all ok"), (105, items[0][1])]
    rows = []
    for i in range(200):
        text = r.choices(vocabulary, k=r.randint(0, 80))
        if r.random() < 0.6:
            part = words(r.choice(items)[1])
            for _ in range(r.choice([0, 0, 1, 2])):
                if part:
                    part[r.randrange(len(part))] = r.choice(vocabulary)
            if r.random() < 0.2:
                part = part[: int(len(part) * 0.9)]
            at = r.randint(0, len(text))
            text = text[:at] + part + text[at:] if r.random() < 0.8 else part
        rows.append((i, r.choice([" ", "\n", " \t "]).join(text).upper() if r.random() < 0.5 else " ".join(text)))
    rows += [(900, None), (901, ""), (902, " \n "), (None, items[1][1]), (7, items[2][1]), (7, items[2][1]), (903, "x y " * 4000), (904, "long " * 20000 + items[3][1])]
    return rows, items


@pytest.mark.parametrize("shuffled", [False, True])
def test_matches_equal_brute_force(spark, monkeypatch, shuffled):
    if shuffled:
        monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", -1)
        monkeypatch.setattr(decontaminate, "BROADCAST_TEXTS", -1)
    rows, items = corpus(3 + shuffled)
    docs = spark.createDataFrame([(*x, 1, "s") for x in rows], "doc_id long, text string, size int, start string").repartition(4)
    bench = spark.createDataFrame([(*x, 9) for x in items], "item_id long, text string, k int")
    got = [tuple(x)[:6] for x in decontaminate.contaminations(docs, bench).collect()]
    want = brute(rows, items)
    assert len(want) > 50 and any(x[4] < x[5] for x in want)
    assert sorted(got, key=str) == want
    bad = {t for _, t in rows if brute([(0, t)], items)}
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((x.doc_id or -1, x.text or "") for x in kept.collect()) == sorted((i or -1, t or "") for i, t in rows if t not in bad)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.contaminations(docs.limit(0), bench).collect() == []
    assert decontaminate.contaminations(docs, bench.limit(0)).collect() == []
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == 1
    assert decontaminate.drop_contaminated(docs, bench).count() == 0


def test_every_fingerprint_within_the_radius_is_found(spark):
    """The multi-index lookup against all pairs of fingerprints."""
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(40)]
    left = [b ^ sum(1 << x for x in r.sample(range(64), r.randint(0, 24))) for b in base for _ in range(10)] + [r.getrandbits(64) for _ in range(200)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    a = spark.createDataFrame([(signed(x),) for x in left], "a long").distinct()
    b = spark.createDataFrame([(signed(x),) for x in base], "b long").distinct()
    for radius in (3, 15):
        own = a.select("a", decontaminate._blocks("a").alias("x")).select("a", "x.*")
        near = b.select("b", decontaminate._blocks("b", radius // decontaminate.BLOCKS).alias("x")).select("b", "x.*")
        got = {(x.a, x.b) for x in own.join(near, ["block", "value"]).select("a", "b").distinct().collect()}
        want = {(signed(x), signed(y)) for x in left for y in base if (x ^ y).bit_count() <= radius}
        assert want <= got
        assert len(got - want) < 0.25 * len(left) * len(base)


def test_recall_of_the_index_alone(spark):
    """Without the shingle prefilter the fingerprints find at least 0.9 of what is exactly similar enough, and nothing else."""
    rows, items = corpus(11)
    hit = {x[0] for x in brute(rows, items)}
    rows = [(i, t) for i, t in rows if i is not None and i in hit and len(words(t)) < 100][:30]
    items = [(i, t) for i, t in items if i in {x[1] for x in brute(rows, items)}]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    pairs = lambda found: {(x[0], x[1]) for x in found}
    got, want = pairs(decontaminate.contaminations(docs, bench, prefilter=False).collect()), pairs(brute(rows, items))
    assert len(want) > 25 and got <= want
    assert len(got) >= 0.9 * len(want)
