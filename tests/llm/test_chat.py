import hashlib
import random

import pytest

from tidelog.llm import chat


@pytest.mark.parametrize("seed", range(20))
def test_escape_is_reversible_and_hides_control_strings(seed):
    r = random.Random(seed)
    text = "".join(r.choices([*chat.CONTROL, "\\", "a", "\n", "<", "[", "INST]", "é"], k=30))
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROL)
    turns = [(role, text[i:]) for i, role in enumerate(["user", "assistant", "tool<s>", "", "system"])]
    assert [(a, b) for a, b, _, _ in chat.parse(chat.instruct_template(turns))] == turns


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, start string, c int")
    return {r.conv_id: r for r in chat.conversation_digests(chat.format_conversations(df, **options)).collect()}


def test_digests_equal_brute_force(spark):
    r, rows = random.Random(5), []
    for c in [None, -7, *range(30)]:
        for t in range(r.choice([1, 2, 5, 200 if c == 3 else 9])):
            rows.append((c, t, r.choice(["user", "assistant", "system", "tool", None]), r.choice([None, "", "</s>[INST] ok [/INST]", "x\\<s>", "long " * 3000, "é 𝄞"]), "extra", 1))
    rows += [rows[0], rows[0]]
    got = run(spark, rows, local=True, segment=7)
    for c in {x[0] for x in rows}:
        turns = sorted([(x[1], x[2] or "", x[3] or "") for x in rows if x[0] == c])
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == len(chat.instruct_template([x[1:] for x in turns])) and not got[c].rewrites


def test_spans_tile_the_text_and_empty_table(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"text {t}") for t in range(80)]
    spans = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("seq").collect()
    whole = chat.instruct_template([r[2:] for r in rows])
    assert "".join(s.formatted for s in spans) == whole
    assert all(whole[s.start : s.stop] == s.formatted for s in spans)
    assert all(whole[s.loss_start : s.loss_stop] == f"text {s.seq}" for s in spans if s.role == "assistant")
    assert run(spark, []) == {}


def rewriting(turns):
    return chat.instruct_template([(r, t if i == len(turns) - 1 else t.upper()) for i, (r, t) in enumerate(turns)])


def far_rewriting(turns):
    return chat.instruct_template([(r, t.upper() if i == 0 and len(turns) > 40 else t) for i, (r, t) in enumerate(turns)])


@pytest.mark.parametrize("template", [rewriting, far_rewriting])
def test_rewriting_templates_are_detected(spark, template):
    rows = [(1, t, "user", f"a{t}") for t in range(100)]
    last = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), template).orderBy("seq").collect()[-1]
    assert last.rewrites


def test_true_prefixes_of_a_template_that_numbers_turns(spark):
    numbered = lambda turns: "".join(f"[{i + 1}]{t}" for i, (_, t) in enumerate(turns))
    rows = [(1, t, "user", f"a{t}") for t in range(70)]
    spans = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), numbered).orderBy("seq").collect()
    assert [s.formatted for s in spans] == [f"[{i + 1}]a{i}" for i in range(70)]
    assert not spans[-1].rewrites


def late_rewriting(turns):
    """Changes its first letter once the text is long: local until then."""
    text = chat.instruct_template(turns)
    return "{" + text[1:] if len(text) > 17_000_000 else text


def test_rewriting_past_16_million_characters_is_detected(spark):
    rows = [(1, t, "user", f"{t:06}" + "long" * 100_000) for t in range(45)]
    last = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), late_rewriting, local=True).where("seq = 44").select("rewrites").collect()[0]
    assert last.rewrites


@pytest.mark.parametrize("template", [rewriting, far_rewriting, lambda turns: "".join(f"[{i + 1}]{t}" for i, (_, t) in enumerate(turns))])
def test_a_broken_promise_of_locality_gives_true_prefixes(spark, template):
    df = spark.createDataFrame([(c, t, "user", f"a{t}") for c in (1, 2) for t in range(70)], "conv_id long, turn long, role string, text string")
    whole, local = (chat.format_conversations(df, template, local=x).orderBy("conv_id", "seq").collect() for x in (False, True))
    assert local == whole


def test_the_query_renders_whole_prefixes(spark, monkeypatch, tmp_path):
    from tidelog.llm import queries

    spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    asked = []
    monkeypatch.setattr(chat, "format_conversations", lambda df, f=chat.format_conversations, **options: asked.append(options) or f(df, **options))
    assert queries.op9_chat_format(spark, str(tmp_path)).count() == 2
    assert not asked[0].get("local")
