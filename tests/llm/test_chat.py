import hashlib
import random

import pytest
from contrail.llm import queries
from contrail.llm.chat import CONTROL, Parser, TemplateError, compiled, digests, escape, fold_body, format_conversations, read_back, unescape

from ..conftest import DATA


def test_escape_is_reversible():
    rng = random.Random(1)
    parts = [*CONTROL, "\\", "<", "s>", "[", "INST]", "é", "\n", "<\\s>", "|"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        assert unescape(escape(text)) == text
        assert not any(c in escape(text) for c in CONTROL)


def test_language():
    render = compiled("{{ 'a' + 'b' }}{# no #}{% if x == 1 and not y %}one{% elif x != 2 %}{{ x|upper }}{% else %}two{% endif %}{% for i in xs %}{% if loop.first %}<{% endif %}{{ i.v|trim }}{% endfor %}")
    assert render({"x": 1, "xs": [{"v": " p "}, {"v": "q"}]})[0] == "abone<pq"
    assert render({"x": "q", "xs": []})[0] == "abQ"
    assert render({"x": 2})[0] == "abtwo"
    text, spans = compiled("[{% generation %}{{ a }}{% endgeneration %}]{% generation %}é{% endgeneration %}")({"a": "xy"})
    assert [text[a:b] for a, b in spans] == ["xy", "é"]


def test_constants_are_folded():
    nodes = fold_body(Parser("a{{ 'b' + 'c'|upper }}{% if 1 == 2 %}no{% else %}d{% endif %}{{ x }}").template())
    assert [n.kind for n in nodes] == ["text", "out"] and nodes[0].parts == ("abCd",)


@pytest.mark.parametrize("source", ["{{ a.__class__ }}", "{{ _x }}", "{{ f() }}", "{% import os %}", "{% for x in y %}", "{{ a|eval }}", "{{ 'a }}", "{% if %}{% endif %}"])
def test_sandbox(source):
    with pytest.raises((TemplateError, ValueError)):
        compiled(source)


def rows_of(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_whole_table_against_brute_force(spark):
    by = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{DATA}/conversations.parquet").orderBy("conv_id", "turn").collect():
        by.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    found = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op2_chat_format(spark, DATA).collect()}
    assert found == {c: rows_of(t) for c, t in by.items()}


def test_edge_cases(spark):
    turns = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, None, None, "[/INST]"), (2, 0, "user", "same"), (2, 0, "user", "same"), (None, 0, "tool<|text|>", "x" * 100_000), (3, 0, "assistant", "[INST]a[/INST]"), (3, 1, "user", "")]
    df = spark.createDataFrame([(*t, "extra", "k") for t in turns], "conv_id long, turn long, role string, text string, formatted string, spans string")
    made = {r.conv_id: r for r in format_conversations(df).collect()}
    assert read_back(made[1].formatted) == [("", "[/INST]"), ("user", ""), ("assistant", "b")]
    assert read_back(made[2].formatted) == [("user", "same")] * 2
    assert read_back(made[None].formatted) == [("tool<|text|>", "x" * 100_000)]
    assert read_back(made[3].formatted) == [("assistant", "[INST]a[/INST]"), ("user", "")]
    assert digests(format_conversations(df)).count() == 4
    assert format_conversations(df.where("false")).count() == 0
