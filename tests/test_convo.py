import random

import pytest
from pyspark.sql import functions as F

from steerframe.functions import chat as ch
from steerframe.operators import convo as cn
from steerframe.plans.prompts import build_prompts, first_builder

BARE = {
    (template, role): ch.RoleFormat("", "")
    for template in (ch.CHAT, ch.INSTRUCT)
    for role in ch.ROLES
}

SPEC_SCHEMA = (
    "spec_id long, char_text string, inst_text string, user_input string, mode string,"
    " name1 string, name2 string, command string, max_len int, is_continue boolean,"
    " impersonate boolean"
)


def spec(spec_id=1, **changes):
    row = dict(
        spec_id=spec_id, char_text="", inst_text="", user_input="", mode="chat", name1="N1",
        name2="N2", command="", max_len=1000, is_continue=False, impersonate=False,
    )
    row.update(changes)
    return tuple(row.values())


def frames(spark, specs, messages):
    return (
        spark.createDataFrame(specs, SPEC_SCHEMA),
        spark.createDataFrame(messages, "spec_id long, turn long, role string, text string"),
    )


@pytest.mark.parametrize(
    "budget,expected",
    [(14, "sys55555444422"), (10, "sys444422"), (5, "sys22"), (4, "sys"), (3, "sys"), (2, "")],
)
def test_budget_golden(spark, budget, expected):
    texts = ["55555", "4444", "22"]
    specs, messages = frames(
        spark,
        [spec(char_text="sys", max_len=budget)],
        [(1, i, "user", t) for i, t in enumerate(texts)],
    )
    out = cn.truncate_to_budget(specs, messages, ["spec_id"], formats=BARE, block=2)
    assert "".join(m.text for m in out.first().messages) == expected


def test_against_pop_loop(spark):
    """Random conversations against dropping messages one at a time."""
    rng = random.Random(5)
    specs, messages, expected = [], [], {}
    for i in range(300):
        system = rng.choice(["", "s" * rng.randint(1, 6)])
        texts = ["m" * rng.randint(1, 7) for _ in range(rng.randint(0, 9))]
        user = rng.choice(["", "u" * rng.randint(1, 5)])
        budget = rng.randint(0, 30)
        specs.append(spec(i, char_text=system, user_input=user, max_len=budget))
        messages += [(i, t, rng.choice(["user", "assistant"]), x) for t, x in enumerate(texts)]
        left = [("system", system)] * bool(system)
        left += [("history", t) for t in texts] + [("user", user)] * bool(user)
        while left and sum(len(t) for _, t in left) > budget:
            keep_first = len(left) > 1 and left[0][0] == "system"
            left.pop(1 if keep_first else 0)
        expected[i] = [t for _, t in left]
    specs_df, messages_df = frames(spark, specs, messages)
    out = cn.truncate_to_budget(specs_df, messages_df, ["spec_id"], formats=BARE, block=3)
    assert {r.spec_id: [m.text for m in r.messages] for r in out.collect()} == expected
    kept = cn.kept_rows(specs_df, messages_df, ["spec_id"], formats=BARE, block=3).collect()
    assert len(kept) == sum(map(len, expected.values()))


def test_hidden_history_is_kept(spark):
    specs, messages = frames(
        spark,
        [spec(mode="chat-instruct", command="c <|prompt|>", user_input="x <|nochat|>")],
        [(1, i, "user", "hello") for i in range(50)],
    )
    fitted = cn.truncate_to_budget(specs, messages, ["spec_id"], block=10).first()
    assert [m.text for m in fitted.messages] == ["hello"] * 50 + ["x <|nochat|>"]
    assert cn.kept_rows(specs, messages, ["spec_id"], block=10).count() == 51


def test_sentinel_only_for_user(spark):
    df = spark.createDataFrame(
        [("user", " <|BEGIN-VISIBLE-CHAT|> "), ("assistant", "<|BEGIN-VISIBLE-CHAT|>"),
         ("user", "  \n"), ("user", " a ")],
        "role string, text string",
    )
    assert [(r.role, r.text) for r in cn.clean_turns(df).collect()] == [
        ("assistant", "<|BEGIN-VISIBLE-CHAT|>"),
        ("user", "a"),
    ]


def test_render_forms(spark):
    history = [(i, 0, "user", "hi") for i in range(1, 5)] + [
        (i, 1, "assistant", "yo") for i in range(1, 5)
    ]
    specs, messages = frames(
        spark,
        [
            spec(1, char_text="S", user_input="q"),
            spec(2, char_text="S", user_input="q", is_continue=True),
            spec(3, char_text="S", user_input="q", impersonate=True),
            spec(
                4, char_text="S", inst_text="I", user_input="q", mode="chat-instruct",
                command="As <|character|>:<|prompt|>!", is_continue=True,
            ),
        ],
        history,
    )
    out = cn.render_prompt(cn.truncate_to_budget(specs, messages, ["spec_id"]))
    assert {r.spec_id: r.prompt for r in out.collect()} == {
        1: "S\n\nN1: hi\nN2: yo\nN1: q\nN2:",
        2: "S\n\nN1: hi\nN2: yo",
        3: "S\n\nN1: hi\nN2: yo\nN1:",
        4: "I\n\n### Instruction:\nAs N2:S\n\nN1: hi\n!\n\n### Response:\nN2: yo",
    }


def test_hot_conversation_in_pieces(spark):
    specs, messages = frames(
        spark, [spec(1), spec(2)], [(1, t, "user", f"m{t}") for t in range(500)]
    )
    out = cn.assemble_messages(specs, messages, ["spec_id"])
    assert out.filter("spec_id = 1").select("turn").distinct().count() == 500


def test_first_builder(spark):
    def mine(specs, messages):
        return specs

    assert first_builder(["a", "b"], {"b": mine}) is mine
    assert first_builder(["a"], {}) is build_prompts


def test_cost_is_pluggable(spark):
    specs, messages = frames(
        spark,
        [spec(max_len=3)],
        [(1, 0, "user", "one two"), (1, 1, "user", "three four"), (1, 2, "user", "five")],
    )

    def words(text):
        return F.size(F.array_remove(F.split(text, " "), ""))

    out = cn.truncate_to_budget(specs, messages, ["spec_id"], formats=BARE, cost=words)
    assert [m.text for m in out.first().messages] == ["three four", "five"]
