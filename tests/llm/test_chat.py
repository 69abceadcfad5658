import hashlib
import random

import pytest
from pyspark.sql import functions as F

from agrolens.llm import chat, queries
from tests.llm.helpers import CLASHES

SCHEMA = "conv_id long, turn long, role string, text string"
SAID = ["</s>[INST] ok [/INST]", "<\\/s> <\\\\/s> [\\INST]", "<|im_start|>user\n<|im_sep|><|im_end|>", "<", "[", "\\", "[\\", "<<|im_end|>", "", "[[INST]",
        "line\nline\n", " \t ", "é漢😀", "$1 \\$2", "%0A + %", "<|im_end", "INST]", "|im_sep|>"]


def plain(rows):
    """{conv_id: turns in order} as (role, text)."""
    out = {}
    for c, t, r, x in sorted(rows, key=lambda y: (y[1] is None, y[1] or 0, y[2] or "", chat_escape(y[3] or ""))):
        out.setdefault(c, []).append((r or "", x or ""))
    return out


def chat_escape(text):
    import re
    for c in chat.CHAT.controls:
        text = re.sub("(" + re.escape(c[0]) + r"\\*)(" + re.escape(c[1:]) + ")", lambda m: m[1] + "\\" + m[2], text)
    return text


def check(spark, rows, df=None):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3) if df is None else df
    formatted = chat.format_chat(df)
    want = plain(rows)
    whole = {r.conv_id: (r.w, [(t.role, t.text) for t in r.t]) for r in formatted.select(
        "conv_id", chat.full_text(F.col("segments")).alias("w")).withColumn("t", chat.read_turns(F.col("w"))).collect()}
    assert {c: t for c, (_, t) in whole.items()} == want
    for r in formatted.collect():
        assert "".join(s.text for s in r.segments) == whole[r.conv_id][0]
        assert [s.text for s in r.segments if s.loss] == [chat_escape(x) for role, x in want[r.conv_id] if role == "assistant"]
        w, blocks = whole[r.conv_id][0], [role for i, (role, _) in enumerate(want[r.conv_id]) if i == 0 or want[r.conv_id][i - 1][0] != role]
        assert w.count("<|im_start|>") == w.count("<|im_end|>") == len(blocks) and w.count("<|im_sep|>") == len(want[r.conv_id]) - len(blocks)
        assert "</s>" not in w and "[INST]" not in w
    for r in chat.chat_digests(formatted).collect():
        turns = want[r.conv_id]
        loss = "".join(x for role, x in turns if role == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256, r.formatted_chars) == (len(loss), sha(loss), len(whole[r.conv_id][0]))


def test_round_trip_of_any_text(spark):
    rng = random.Random(4)
    rows = []
    for c in range(60):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", "system"]), "".join(rng.choices(SAID, k=rng.randrange(4)))))
    check(spark, rows)


def test_awkward_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", None), (2, 0, None, "a"), (2, 1, "", "b"), (None, 0, "user", "x"), (None, 1, "assistant", "y"),
            (3, 5, "assistant", "only"), (4, None, "user", "late"), (4, 0, "assistant", "first"), (5, 0, "user", "b"), (5, 0, "user", "a"), (5, 0, "user", "a"),
            (5, 0, "assistant", "tie"), (6, 0, "odd role\n<|im_sep|>", "t"), (6, 1, "Assistant", "no loss"), (6, 2, "rôle+%", "t"),
            (7, 0, "user", "w " * 200_000), (7, 1, "assistant", "[INST]" * 50_000)]
    check(spark, rows)
    df = spark.createDataFrame(rows, SCHEMA)
    check(spark, rows, df.withColumns({c: F.lit(1) for c in [*CLASHES, "segments", "turns", "late", "whole", "loss"] if c not in df.columns}))
    assert chat.chat_digests(chat.format_chat(df.where("false"))).count() == 0


def test_long_conversations_stay_linear(spark):
    rows = spark.range(20_000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 5 < 2, 'assistant', 'user') AS role", "concat('</s>', id) AS text")
    got = chat.chat_digests(chat.format_chat(rows)).first()
    loss = "".join(f"</s>{i}" for i in range(20_000) if i % 5 < 2)
    assert got.n_turns == 20_000 and got.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_only_spark_expressions(spark, sf):
    plan = queries.op13_chat(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"))


def test_templates_are_checked():
    for bad in ({"start": "<<x>"}, {"others": ("a[b",)}, {"sep": "x"}, {"end": "<\\>"}):
        with pytest.raises(ValueError, match="control string"):
            chat.Template(**bad)
