"""Prefix-target expansion against a plain formatter and parser, and the round trip of texts that imitate the template."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from marketloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, alone string, pieces int, `a.b` int"
MARKS = ["</s>", "<s>", "[INST] ", " [/INST]", "[OUT]", "[SYS]", "[ROLE] ", "[TEXT] ", "<\\/s>", "[\\\\/OUT]", "[", "<", "\\", "漢", "\n", "x", "$1", "s>", "/INST]"]


def rows(seed=3):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(MARKS) for _ in range(rng.randrange(12)))
    out = [(c, t, rng.choice(["user", "assistant", "assistant", "system", "tool", text()]), text()) for c in range(40) for t in range(rng.randrange(1, 9))]
    out += [(100, 0, None, None), (101, 0, "assistant", None), (101, 1, "user", ""), (102, 0, "user", "no reply"), (103, None, "assistant", "first"), (103, 0, "user", "second")]
    out += [(104, 1, "user", "tie b"), (104, 1, "user", "tie a"), (104, 1, "assistant", "tie"), (104, 1, "assistant", "tie")]
    out += [(None, 0, "user", "alone"), (None, 1, "assistant", "alone too"), (105, 0, "user", "long " * 40_000), (105, 1, "assistant", "</s>" * 20_000)]
    return out


def conversations(spark, given):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in given], SCHEMA)


def plain(given):
    """By conversation: turns, replies, code points of all examples; rows without an id each by themselves."""
    groups = {}
    for k, (c, t, role, text) in enumerate(given):
        groups.setdefault((c, k if c is None else None), []).append(((t is not None, t or 0), role or "", text or ""))
    for (c, _), turns in groups.items():
        turns.sort()
        pieces = []
        for _, role, text in turns:
            safe = lambda x: re.sub(r"([<\[]\\*)(?=/?s>|/?(?:INST|SYS|OUT|ROLE)\]|TEXT\])", r"\1\\", x)
            tag = {"user": "INST", "system": "SYS", "assistant": "OUT"}.get(role)
            pieces.append(f"<s>[{tag}] {safe(text)} [/{tag}]</s>" if tag else f"<s>[ROLE] {safe(role)}[TEXT] {safe(text)} [/ROLE]</s>")
        ends = [k for k, x in enumerate(turns) if x[1] == "assistant"]
        ends += [len(turns)] if turns[-1][1] != "assistant" else []
        yield c, [x[1:] for x in turns], [x[2] for x in turns if x[1] == "assistant"], ["".join(pieces[: k + 1]) for k in ends]


def test_examples_against_plain(spark):
    given = rows()
    examples = chat.expand_replies(conversations(spark, given).repartition(5)).collect()
    found = sorted((repr(r.conv_id), r.text) for r in examples)
    assert found == sorted((repr(c), text) for c, _, _, texts in plain(given) for text in texts)
    for r in examples:
        reply = r.text[r.loss_start : r.loss_end]
        if r.loss_start < r.loss_end or r.text.endswith(" [/OUT]</s>"):
            assert r.text[: r.loss_start].endswith("<s>[OUT] ") and r.text[r.loss_end :] == " [/OUT]</s>" and "</s>" not in reply
        else:
            assert r.loss_start == r.loss_end == len(r.text) and r.example == r.n_examples - 1


def test_read_back_and_digests(spark):
    given = rows(8)
    read = chat.read_back(chat.expand_replies(conversations(spark, given).repartition(5)))
    want = sorted(((repr(c), [tuple(t) for t in turns], [x for x in replies], sum(map(len, texts))) for c, turns, replies, texts in plain(given)), key=repr)
    rest = lambda r: [x for k, x in enumerate(r.losses) if not (k == len(r.losses) - 1 and r.turns[-1].role != "assistant")]
    assert sorted(((repr(r.conv_id), [tuple(t) for t in r.turns], rest(r), r.formatted_chars) for r in read.collect()), key=repr) == want
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    digests = sorted(map(repr, (tuple(r) for r in chat.digest_turns(read).collect())))
    assert digests == sorted(
        repr((c, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len("".join(replies)), sha("".join(replies)), sum(map(len, texts)))) for c, turns, replies, texts in plain(given)
    )


@pytest.mark.parametrize("text", ["</s>[INST] ok [/INST]", "<\\/s><\\\\/s>", "[TEXT] [\\TEXT] ", "<", "", "plain \\ text\\"])
def test_escape_round_trip(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(chat.escape(F.col("t")).alias("e")).select("e", chat.unescape(F.col("e")).alias("u")).first()
    assert row.u == text and not re.search(r"</?s>|\[/?(INST|SYS|OUT|ROLE)\]|\[TEXT\]", row.e)


def test_empty_table_and_plan(spark):
    empty = spark.createDataFrame([], SCHEMA)
    out = chat.digest_turns(chat.read_back(chat.expand_replies(empty)))
    assert out.collect() == []
    plan = chat.digest_turns(chat.read_back(chat.expand_replies(conversations(spark, rows()[:20]))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and not re.search("Python|Pandas|Arrow", plan)
