import hashlib
import re

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from roleweave.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_states(roles):
    """The machine of the template, one role after the other."""
    after = {"start": {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user", "tool"}, "tool": {"tool", "assistant"}, "broken": set()}
    state, out = "start", []
    for r in roles:
        state = r if r in after[state] else "broken"
        out.append(state)
    return out


def by_brute_force(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t, r or "", x or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        states = plain_states([r for *_, r, _ in turns])
        out[c] = (
            len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest(),
            len(loss), hashlib.sha256(loss.encode()).hexdigest(), states[-1] == "assistant",
        )
    return out


def digests(spark, rows, extra=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        df = df.withColumns({c: F.lit("extra") for c in ("seq", "state", "segments", "formatted", "valid", "kind", "part")})
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.valid) for r in chat.digests(chat.format_turns(df)).collect()}


AWKWARD = [
    (1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", None), (1, 3, "user", ""), (1, 4, "assistant", "a\n</turn>\n### User: b\\"),
    (2, 0, "assistant", "first"), (2, 1, "user", "x"),  # does not fit, is formatted all the same
    (3, None, "user", "no turn"), (3, 0, "assistant", "y"), (3, 0, "assistant", "y"), (3, 0, "assistant", "x"),  # ties and repeats
    (None, 0, "user", "null id"), (None, 1, "assistant", "one conversation"),
    (4, 0, None, "no role"), (4, 1, "", "empty role"), (4, 2, "Cri: tic\\ ###", "a role of its own"), (4, 3, "=User", "z"), (4, 4, "User", "z"),
    (5, 0, "user", "x" * 200_000), (5, 1, "assistant", "#" * 50_000 + "\\" * 1000),
    (6, 0, "user", "q"), (6, 1, "assistant", "call"), (6, 2, "tool", "1"), (6, 3, "tool", "2"), (6, 4, "assistant", "done"),
]


def test_digests_are_those_of_a_plain_walk_and_extra_columns_do_not_matter(spark):
    assert digests(spark, AWKWARD, extra=True) == by_brute_force(AWKWARD)


def test_a_long_conversation_is_spread_over_tasks_and_keeps_its_state(spark):
    turns = [(9, t, ("user", "assistant")[t % 2], f"turn {t} " * (t % 5)) for t in range(4000)]
    turns += [(c, t, ("user", "assistant")[t % 2], "hi") for c in (8, 10) for t in range(40)]
    broken = [(11, t, ("user", "assistant")[t % 2] if t != 1500 else "system", "x") for t in range(3000)]
    least = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    spark.conf.set(least, "1b")
    try:
        made = chat.format_turns(spark.createDataFrame(turns + broken, SCHEMA)).cache()
        tasks = made.where("conv_id = 9").select(F.spark_partition_id()).distinct().count()
        states = [r.state for r in made.where("conv_id = 11").orderBy("seq").collect()]
        assert tasks > 2
        assert states == plain_states([r for c, _, r, _ in broken])
        assert set(r.state for r in made.where("conv_id = 9").collect()) == {"user", "assistant"}
        assert digests(spark, turns + broken) == by_brute_force(turns + broken)
        made.unpersist()
    finally:
        spark.conf.unset(least)


def test_segments_join_to_the_formatted_text_and_only_the_answer_is_under_the_loss(spark):
    rows = chat.format_turns(spark.createDataFrame(AWKWARD, SCHEMA)).orderBy("conv_id", "seq").collect()
    for r in rows:
        assert "".join(s.text for s in r.segments) == r.formatted
        assert [s.loss for s in r.segments] == [False, r.role == "assistant", False]
        assert "###" not in r.segments[1].text and "</turn>" not in r.segments[1].text
    one = "".join(r.formatted for r in rows if r.conv_id == 6)
    assert chat.read_back(one) == [("user", "q"), ("assistant", "call"), ("tool", "1"), ("tool", "2"), ("assistant", "done")]
    assert one.startswith("### User: q</turn>\n### Assistant: call</turn>\n### Tool: 1</turn>\n")


def test_a_template_is_data(spark):
    mine = chat.Template(opening="<|", colon="|>", end="<|end|>", loss_roles=("assistant", "user"), labels=(("user", "U"), ("assistant", "A")),
                         order=(("start", "assistant", "assistant"), ("assistant", "user", "user")), final=("user",))
    rows = [(1, 0, "assistant", "hello"), (1, 1, "user", "there")]
    made = chat.format_turns(spark.createDataFrame(rows, SCHEMA), mine).orderBy("seq").collect()
    assert "".join(r.formatted for r in made) == "<|A|>hello<|end|><|U|>there<|end|>"
    assert [r.state for r in made] == ["assistant", "user"]


def test_an_empty_table(spark):
    assert chat.digests(chat.format_turns(spark.createDataFrame([], SCHEMA))).collect() == []


def plain_escape(text):
    return re.sub("<(?=/turn>)", r"<\\", re.sub("#(?=##)", r"#\\", text.replace("\\", "\\\\")))


@given(st.text(alphabet="#\\</turn>: aé", max_size=40))
def test_escaping_is_reversible_and_hides_control_strings(text):
    made = plain_escape(text)
    assert chat.unescaped(made) == text and "###" not in made and "</turn>" not in made
    assert chat.read_back(f"### User: {made}</turn>\n### Tool: </turn>\n") == [("user", text), ("tool", "")]


def test_the_expression_escapes_like_the_plain_rule(spark):
    import random

    rng = random.Random(5)
    texts = ["".join(rng.choices("#\\</turn> x", k=rng.randint(0, 30))) for _ in range(500)] + ["####", "</turn></turn>", "\\</turn>", "<</turn>"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e")).collect()
    assert all(r.e == plain_escape(r.t) for r in rows)


def test_text_that_is_not_formatted_is_refused():
    import pytest

    for bad in ("hello", "### User: no end", "### User: a</turn>\n rest"):
        with pytest.raises(ValueError):
            chat.read_back(bad)
