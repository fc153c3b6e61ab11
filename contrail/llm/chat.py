"""Chat formatting: a small sandboxed template language, compiled to Python closures.

The language: ``{{ expression }}``, ``{% for x in list %}``, ``{% if e %} {% elif e %} {% else %}``,
``{% generation %}`` (what a model is trained to produce) and ``{# comments #}``. Expressions: strings, integers,
true, false, none, names, ``a.b``, ``loop.index0|first|last``, ``+``, ``==``, ``!=``, ``not``, ``and``, ``or``,
parentheses and the filters ``escape``, ``trim``, ``upper``, ``lower``. There are no calls, no imports and no
attributes of Python objects: a name finds values of the context's dicts only.

A template is parsed to a syntax tree, whose constant parts are folded, and each node left becomes a closure
that appends to a writer; the writer notes where generation begins and ends.

``escape`` makes control strings inert and reversible: a backslash goes in behind the first character of each, and
one more where backslashes stand there already.

Defined results: a null text or role is empty; turns are ordered by turn (null first), then role and text, so
that ties and repeated rows have a fixed order; rows with null conv_id are one conversation; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What structures a formatted conversation; texts must not hold these unescaped.
CONTROL = ("<s>", "</s>", "<|role|>", "<|text|>", "[INST]", "[/INST]")
TEMPLATE = (
    "{{ '<s>' }}{% for m in messages %}{# one turn #}{{ '<|' + 'role|>' }}{{ m.role|escape }}{{ '<|text|>' }}"
    "{% if m.role == 'user' %}[INST]{{ m.text|escape }}[/INST]"
    "{% elif m.role == 'assistant' %}{% generation %}{{ m.text|escape }}{% endgeneration %}"
    "{% else %}{{ m.text|escape }}{% endif %}</s>{% endfor %}"
)
_FIND = re.compile("|".join(rf"(?<={re.escape(c[0])})\\*(?={re.escape(c[1:])})" for c in CONTROL))


def escape(text: str) -> str:
    return _FIND.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _FIND.sub(lambda m: m[0][1:], text)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}


class TemplateError(ValueError):
    pass


@dataclass
class Node:
    """kind and its parts: const (value), name, attr (of, key), op (sign, left, right), not (of), filter (name, of),
    text (value), out (of), for (name, of, body), if ([(condition, body)]), generation (body)."""

    kind: str
    parts: tuple


@dataclass
class Writer:
    out: list[str] = field(default_factory=list)
    size: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.out.append(text)
        self.size += len(text)


class Parser:
    TOKEN = re.compile(r"""\s*(?:(?P<str>'[^']*'|"[^"]*")|(?P<int>\d+)|(?P<name>[A-Za-z]\w*)|(?P<sign>==|!=|[+|.()]))""")
    CONSTANTS = {"true": True, "false": False, "none": None}

    def __init__(self, source: str):
        self.parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", source, flags=re.S)
        self.at = 0

    def template(self) -> list[Node]:
        body, end = self.body(())
        return body

    def body(self, ends: tuple[str, ...]) -> tuple[list[Node], tuple[str, str]]:
        """Nodes up to a tag in ``ends``, and that tag with what follows its name."""
        nodes: list[Node] = []
        while self.at < len(self.parts):
            part = self.parts[self.at]
            self.at += 1
            if part.startswith("{{"):
                nodes.append(Node("out", (self.expression(part[2:-2]),)))
            elif part.startswith("{%"):
                tag, _, rest = part[2:-2].strip().partition(" ")
                if tag in ends:
                    return nodes, (tag, rest)
                nodes.append(self.block(tag, rest))
            elif part and not part.startswith("{#"):
                nodes.append(Node("text", (part,)))
        if ends:
            raise TemplateError(f"missing {' or '.join(ends)}")
        return nodes, ("", "")

    def block(self, tag: str, rest: str) -> Node:
        if tag == "for":
            name, word, of = (rest.split(None, 2) + ["", ""])[:3]
            if word != "in" or not name.isidentifier() or name.startswith("_"):
                raise TemplateError(f"for {rest}")
            return Node("for", (name, self.expression(of), self.body(("endfor",))[0]))
        if tag == "generation":
            return Node("generation", (self.body(("endgeneration",))[0],))
        if tag == "if":
            branches, condition = [], self.expression(rest)
            while True:
                body, (end, rest) = self.body(("elif", "else", "endif"))
                branches.append((condition, body))
                if end == "endif":
                    return Node("if", (branches,))
                condition = self.expression(rest) if end == "elif" else Node("const", (True,))
        raise TemplateError(f"unknown tag {tag}")

    def expression(self, source: str) -> Node:
        self.tokens, at, source = [], 0, source.rstrip()
        while at < len(source):
            m = self.TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.tokens.append(("end", ""))
        node = self.either()
        if self.tokens[0][0] != "end":
            raise TemplateError(f"unexpected {self.tokens[0][1]!r}")
        return node

    def takes(self, *values: str) -> str | None:
        return self.tokens.pop(0)[1] if self.tokens[0][0] != "str" and self.tokens[0][1] in values else None

    def _left(self, below: Callable[[], Node], *signs: str) -> Node:
        node = below()
        while sign := self.takes(*signs):
            node = Node("op", (sign, node, below()))
        return node

    def either(self) -> Node:
        return self._left(self.both, "or")

    def both(self) -> Node:
        return self._left(self.negated, "and")

    def negated(self) -> Node:
        return Node("not", (self.negated(),)) if self.takes("not") else self.compared()

    def compared(self) -> Node:
        return self._left(self.added, "==", "!=")

    def added(self) -> Node:
        return self._left(self.filtered, "+")

    def filtered(self) -> Node:
        node = self.atom()
        while sign := self.takes("|", "."):
            kind, name = self.tokens.pop(0)
            if kind != "name" or name.startswith("_") or sign == "|" and name not in FILTERS:
                raise TemplateError(f"{sign}{name} is not allowed")
            node = Node("filter", (name, node)) if sign == "|" else Node("attr", (node, name))
        return node

    def atom(self) -> Node:
        kind, value = self.tokens.pop(0)
        if kind == "str":
            return Node("const", (value[1:-1],))
        if kind == "int":
            return Node("const", (int(value),))
        if kind == "name":
            return Node("const", (self.CONSTANTS[value],)) if value in self.CONSTANTS else Node("name", (value,))
        if value == "(":
            node = self.either()
            if not self.takes(")"):
                raise TemplateError("missing )")
            return node
        raise TemplateError(f"unexpected {value!r}")


OPS: dict[str, Callable] = {"+": lambda a, b: a + b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "and": lambda a, b: a and b, "or": lambda a, b: a or b}


def _shown(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def fold(node: Node) -> Node:
    """The expression with constant parts computed."""
    kind, parts = node.kind, node.parts
    if kind == "op":
        left, right = fold(parts[1]), fold(parts[2])
        if left.kind == right.kind == "const":
            return Node("const", (OPS[parts[0]](left.parts[0], right.parts[0]),))
        return Node("op", (parts[0], left, right))
    if kind in ("not", "filter", "attr"):
        at = 1 if kind == "filter" else 0
        of = fold(parts[at])
        if of.kind == "const" and kind != "attr":
            return Node("const", (not of.parts[0] if kind == "not" else FILTERS[parts[0]](_shown(of.parts[0])),))
        return Node(kind, (*parts[:at], of, *parts[at + 1 :]))
    return node


def fold_body(nodes: list[Node]) -> list[Node]:
    """The body with constant output made text, texts joined, and branches decided where their condition is constant."""
    out: list[Node] = []
    for node in nodes:
        if node.kind == "out":
            of = fold(node.parts[0])
            new = [Node("text", (_shown(of.parts[0]),)) if of.kind == "const" else Node("out", (of,))]
        elif node.kind == "for":
            new = [Node("for", (node.parts[0], fold(node.parts[1]), fold_body(node.parts[2])))]
        elif node.kind == "generation":
            new = [Node("generation", (fold_body(node.parts[0]),))]
        elif node.kind == "if":
            branches = []
            for condition, body in node.parts[0]:
                condition = fold(condition)
                if condition.kind != "const" or condition.parts[0]:
                    branches.append((condition, fold_body(body)))
                if condition.kind == "const" and condition.parts[0]:
                    break
            sure = branches and branches[0][0].kind == "const"
            new = branches[0][1] if sure else [Node("if", (branches,))] if branches else []
        else:
            new = [node]
        for n in new:
            if n.kind == "text" and out and out[-1].kind == "text":
                out[-1] = Node("text", (out[-1].parts[0] + n.parts[0],))
            elif n.kind != "text" or n.parts[0]:
                out.append(n)
    return out


def evaluator(node: Node) -> Callable[[dict], object]:
    """A closure that computes an expression in a context."""
    kind, parts = node.kind, node.parts
    if kind == "const":
        return lambda scope, value=parts[0]: value
    if kind == "name":
        return lambda scope, name=parts[0]: scope.get(name)
    if kind == "attr":
        of, key = evaluator(parts[0]), parts[1]
        return lambda scope: x.get(key) if isinstance(x := of(scope), dict) else None
    if kind == "not":
        of = evaluator(parts[0])
        return lambda scope: not of(scope)
    if kind == "filter":
        of, use = evaluator(parts[1]), FILTERS[parts[0]]
        return lambda scope: use(_shown(of(scope)))
    left, right, use = evaluator(parts[1]), evaluator(parts[2]), OPS[parts[0]]
    if parts[0] in ("and", "or"):
        wanted = parts[0] == "and"
        return lambda scope: right(scope) if bool(x := left(scope)) == wanted else x
    return lambda scope: use(left(scope), right(scope))


def generator(nodes: list[Node]) -> Callable[[dict, Writer], None]:
    """A closure that renders a body."""
    steps = [_step(n) for n in nodes]

    def run(scope: dict, to: Writer) -> None:
        for step in steps:
            step(scope, to)

    return run


def _step(node: Node) -> Callable[[dict, Writer], None]:
    kind, parts = node.kind, node.parts
    if kind == "text":
        return lambda scope, to, text=parts[0]: to.write(text)
    if kind == "out":
        of = evaluator(parts[0])
        return lambda scope, to: to.write(_shown(of(scope)))
    if kind == "generation":
        body = generator(parts[0])

        def marked(scope: dict, to: Writer) -> None:
            begin = to.size
            body(scope, to)
            to.spans.append((begin, to.size))

        return marked
    if kind == "if":
        branches = [(evaluator(c), generator(b)) for c, b in parts[0]]

        def choose(scope: dict, to: Writer) -> None:
            for condition, body in branches:
                if condition(scope):
                    return body(scope, to)

        return choose
    name, of, body = parts[0], evaluator(parts[1]), generator(parts[2])

    def loop(scope: dict, to: Writer) -> None:
        items = of(scope) or []
        for i, item in enumerate(items):
            body(scope | {name: item, "loop": {"index0": i, "first": i == 0, "last": i == len(items) - 1}}, to)

    return loop


def compiled(source: str) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from a context to the rendered text and its generated ranges, in code points."""
    run = generator(fold_body(Parser(source).template()))

    def render(scope: dict) -> tuple[str, list[tuple[int, int]]]:
        to = Writer()
        run(scope, to)
        return "".join(to.out), to.spans

    return render


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a text that TEMPLATE has made."""
    turns = []
    for turn in formatted.removeprefix("<s>").split("<|role|>")[1:]:
        role, _, text = turn.removesuffix("</s>").partition("<|text|>")
        if role == "user":
            text = text.removeprefix("[INST]").removesuffix("[/INST]")
        turns.append((unescape(role), unescape(text)))
    return turns


def format_conversations(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, formatted, spans (begin and end of each generated range, in code points): a row a conversation.

    Turns are dealt by conv_id and sorted within tasks; a task holds one conversation at a time.
    """
    Parser(template).template()  # complains here rather than in a task
    order = [F.col("conv_id"), F.col("turn"), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render, key, held = compiled(template), (), []
        done: list[tuple] = []

        def close() -> None:
            text, spans = render({"messages": held})
            done.append((key[0], text, [{"begin": a, "end": b} for a, b in spans]))

        def out(kind: pa.DataType) -> pa.RecordBatch:
            span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            cols = [pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.string()), pa.array([d[2] for d in done], span)]
            done.clear()
            return pa.RecordBatch.from_arrays(cols, ["conv_id", "formatted", "spans"])

        kind = None
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True):
                if key != (c,):
                    if key:
                        close()
                    key, held = (c,), []
                held.append({"role": role or "", "text": text or ""})
            if done:
                yield out(kind)
        if key:
            close()
            yield out(kind)

    kind = turns.schema["conv_id"].dataType
    span = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField("conv_id", kind), T.StructField("formatted", T.StringType()), T.StructField("spans", span)])
    dealt = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions(*order)
    return dealt.select("conv_id", "role", "text").mapInArrow(run, schema)


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: turns and loss text, counted and hashed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                turns, loss = read_back(text), "".join(unescape(text[s["begin"] : s["end"]]) for s in spans)
                said = hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in turns).encode())
                rows.append((len(turns), said.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *cols], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
