import random
import zlib

import numpy as np
import pytest

from tidelog.llm import store
from tidelog.llm.token_file import EliasFano, Encoder, open_block, pack_block, read_token_file, token_file, write_token_file

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [7] * 200, sorted(random.Random(1).choices(range(10**6), k=3000))])
def test_elias_fano_round_trip(values):
    ef = EliasFano.encode(np.array(values))
    assert list(ef.decode()) == values
    assert [ef.select(i) for i in range(len(values))] == values
    if len(values) > 1000:
        assert len(ef.low) + len(ef.high) < len(values) * 12 / 8


def test_block_round_trip():
    ids = [np.array(x, "<u4").tobytes() for x in ([1, 2, 0], [0], [9] * 70 + [0])]
    keys, ef, data = open_block(pack_block([None, -3, 7], ids))
    assert keys == [None, -3, 7] and list(ef.decode()) == [3, 4, 75] and bytes(data) == b"".join(ids)


def test_encoder_equals_whole_text_encoding():
    r, own, plain = random.Random(3), Encoder(PATH, most_bytes=4000), tokenizers.Tokenizer.from_file(PATH)
    alphabet = ["a", "b", " ", "  ", "\n", "\t", "'s", "<|endoftext|>", "é", " ", "1", ".", "​", "　", "\x1c", "\x85"]
    texts = ["".join(r.choices(alphabet, k=r.randint(0, 9))) for _ in range(3000)]
    for at in range(0, 3000, 100):
        part = texts[at : at + 100]
        assert own.encode(part) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in part]


def test_runs_with_punctuation_are_cut_here(monkeypatch):
    own, plain = Encoder(PATH), tokenizers.Tokenizer.from_file(PATH)
    monkeypatch.setattr(own, "_joined", lambda runs: pytest.fail(f"through the whole tokenizer: {runs}"))
    texts = ["a thing, thing. (thing) it's 'tis 12% of\nThings.\n\nthe\x1cend été!", "a thing; Things", "a "]
    assert own.encode(texts) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


@pytest.mark.parametrize("first", range(0, 0x540, 0x70))
def test_every_character_is_cut_as_the_tokenizer_cuts_it(first):
    own, plain = Encoder(PATH), tokenizers.Tokenizer.from_file(PATH)
    texts = [x for c in map(chr, range(first, first + 0x70)) for x in (f"a{c}b {c}", f"x {c}{c}a{c}\n{c}1", f"x .{c}1{c}'s 're{c}<|endoftext|>{c}", c)]
    assert own.encode(texts) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


@pytest.mark.parametrize(("letters", "options"), [("Ġabcd,.", {}), ("ĠabcdÀ,.", {}), ("ĠabcdÀ,.", {"ignore_merges": True}), ("ĠabcÀ,.", {"unk_token": "d", "fuse_unk": True})])
def test_other_vocabularies(tmp_path, letters, options):
    names = [*dict.fromkeys([*letters, "d", "ab", "Ġab", "abcd", "cÀ"])]
    model = tokenizers.models.BPE({x: i for i, x in enumerate(names)}, [("a", "b"), ("Ġ", "ab")], **options)
    plain = tokenizers.Tokenizer(model)
    plain.pre_tokenizer = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False)
    plain.save(str(tmp_path / "own.json"))
    r = random.Random(4)
    texts = ["".join(r.choices("abcd ,.\n1", k=r.randint(0, 30))) for _ in range(300)] + ["ab abcd, ab", " abcd"]
    assert Encoder(str(tmp_path / "own.json")).encode(texts) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def expected(rows):
    plain, at, out = tokenizers.Tokenizer.from_file(PATH), 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_file_equals_brute_force(spark):
    rows = [(i * 7 % 101, None if i == 5 else "" if i == 6 else "word  x " * 4000 if i == 8 else f"Text {i} of the\n lot") for i in range(60)] + [(None, "no id"), (500, "same"), (500, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS shard", "'x' AS payload").repartition(5)
    got = token_file(df, PATH, shards=4, block_tokens=500)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == expected(rows)


def test_file_order_and_empty_table(spark):
    path = store.scratch(spark, "tokens-test")
    write_token_file(spark.createDataFrame([(i, f"t {i}") for i in range(100)], "doc_id long, text string").repartition(7), path, PATH, shards=3, block_tokens=40)
    blocks = spark.read.parquet(path).orderBy("shard", "seq").collect()
    assert [k for b in blocks for k in open_block(bytes(b.payload))[0]] == list(range(100))
    assert token_file(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
    assert read_token_file(spark, path).count() == 100
