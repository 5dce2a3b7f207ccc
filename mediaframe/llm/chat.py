"""Chat formatting by a template compiler.

A template is parsed to a syntax tree, constants are folded, and the tree is turned into Python closures that render a
conversation message by message and mark what stands inside ``{% generation %}`` as loss text.

The language: ``{{ expression }}``, ``{% for m in messages %}``, ``{% if %}/{% elif %}/{% else %}``, ``{% generation %}``,
``{# comment #}``, a ``-`` inside a delimiter strips white space beside it. Expressions: strings, integers, true, false,
none, names, ``a.b``, ``a["b"]``, ``not and or``, ``== != < <= > >= in``, ``~`` (joins), ``+ -``, filters ``upper lower trim
length safe``, parentheses; a loop has ``loop.index``, ``loop.first``, ``loop.last``. It is sandboxed: names reach only what the
caller hands in, attributes only dictionary entries, and nothing can be called.

Output of expressions is escaped: a backslash is put before each backslash and each control string of the template, so
control strings outside escapes are the template's own and reading back is exact.

Scale: rows are dealt by conversation and streamed in order of turn; a conversation leaves in parts of about
``part_chars``, cut between rendered pieces, so a task holds one part however long a conversation is.

Defined cases: null role or text is empty; ties of turn go by role, then text, nulls first; a null turn comes first; rows
without conv_id are one conversation; repeated rows are turns of their own; no rows give no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaframe.llm.common import column, small_batches

CONTROLS = ("<turn>", "<text>", "</turn>")
TEMPLATE = """
{%- for m in messages -%}
<turn>{{ m.role }}<text>
{%- if m.role == "assistant" %}{% generation %}{{ m.text }}{% endgeneration %}{% else %}{{ m.text }}{% endif -%}
</turn>{{ "\\n" | safe }}
{%- endfor -%}
"""
PART_CHARS = 1 << 20

Emit = Callable[[str, bool], None]


class TemplateError(ValueError):
    pass


# ---------------------------------------------------------------- expressions: parsed to tuples

_LEX = re.compile(r"""\s*(?:(?P<str>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>()\[\].~+|-]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_CONSTANTS = {"true": True, "false": False, "none": None}
_COMPARE: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b,
}
_MATH: dict[str, Callable[[Any, Any], Any]] = {"~": lambda a, b: shown(a) + shown(b), "+": lambda a, b: a + b, "-": lambda a, b: a - b}
_FILTERS: dict[str, Callable[[Any], Any]] = {
    "upper": lambda v: shown(v).upper(), "lower": lambda v: shown(v).lower(), "trim": lambda v: shown(v).strip(), "length": len, "safe": lambda v: Safe(shown(v)),
}


class Safe(str):
    """A string that is not escaped any more."""


def shown(v: Any) -> str:
    return v if isinstance(v, str) else "" if v is None else ("true" if v else "false") if isinstance(v, bool) else str(v)


class _Expression:
    """Recursive descent: or, and, not, comparison, sum, filter, postfix."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _LEX.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str | None, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, "")

    def take(self, *texts: str) -> str | None:
        kind, text = self.peek()
        if kind in ("op", "name") and text in texts:
            self.at += 1
            return text
        return None

    def need(self, text: str) -> None:
        if not self.take(text):
            raise TemplateError(f"expected {text!r}, found {self.peek()[1]!r}")

    def whole(self):
        e = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return e

    def either(self):
        e = self.both()
        while self.take("or"):
            e = ("or", e, self.both())
        return e

    def both(self):
        e = self.negated()
        while self.take("and"):
            e = ("and", e, self.negated())
        return e

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        e = self.summed()
        while op := self.take(*_COMPARE):
            e = ("op", op, e, self.summed())
        return e

    def summed(self):
        e = self.filtered()
        while op := self.take(*_MATH):
            e = ("op", op, e, self.filtered())
        return e

    def filtered(self):
        e = self.reached()
        while self.take("|"):
            kind, name = self.peek()
            if kind != "name" or name not in _FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            e = ("filter", name, e)
        return e

    def reached(self):
        e = self.single()
        while True:
            if self.take("."):
                kind, name = self.peek()
                if kind != "name":
                    raise TemplateError("an attribute needs a name")
                self.at += 1
                e = ("get", e, ("const", name))
            elif self.take("["):
                e = ("get", e, self.either())
                self.need("]")
            else:
                return e

    def single(self):
        kind, text = self.peek()
        self.at += 1
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "int":
            return ("const", int(text))
        if kind == "name":
            return ("const", _CONSTANTS[text]) if text in _CONSTANTS else ("name", text)
        if text == "(":
            e = self.either()
            self.need(")")
            return e
        raise TemplateError(f"unexpected {text!r}")


def fold(e):
    """The expression with constant parts evaluated."""
    kind = e[0]
    if kind in ("const", "name"):
        return e
    parts = tuple(fold(x) if isinstance(x, tuple) else x for x in e)
    inner = [x for x in parts[1:] if isinstance(x, tuple)]
    if kind in ("and", "or") and inner[0][0] == "const":
        return inner[1] if bool(inner[0][1]) == (kind == "and") else inner[0]
    if all(x[0] == "const" for x in inner) and kind != "get":
        return ("const", evaluator(parts)({}))
    return parts


def evaluator(e) -> Callable[[dict], Any]:
    """The expression as a closure over the environment."""
    kind = e[0]
    if kind == "const":
        return lambda env, v=e[1]: v
    if kind == "name":
        return lambda env, n=e[1]: env.get(n)
    if kind == "get":
        of, key = evaluator(e[1]), evaluator(e[2])

        def get(env):
            v = of(env)
            return v.get(key(env)) if isinstance(v, dict) else None

        return get
    if kind == "not":
        a = evaluator(e[1])
        return lambda env: not a(env)
    if kind in ("and", "or"):
        a, b = evaluator(e[1]), evaluator(e[2])
        return (lambda env: a(env) and b(env)) if kind == "and" else (lambda env: a(env) or b(env))
    if kind == "filter":
        f, a = _FILTERS[e[1]], evaluator(e[2])
        return lambda env: f(a(env))
    f, a, b = (_COMPARE | _MATH)[e[1]], evaluator(e[2]), evaluator(e[3])
    return lambda env: f(a(env), b(env))


# ---------------------------------------------------------------- statements

_TAG = re.compile(r"\{#.*?#\}|\{%-?.*?-?%\}|\{\{-?.*?-?\}\}", re.S)


def _lexed(source: str) -> list[tuple[str, str]]:
    out, at, strip = [], 0, False
    for m in [*_TAG.finditer(source), None]:
        text = source[at : m.start() if m else len(source)]
        text = text.lstrip() if strip else text
        tag = m[0] if m else ""
        if tag[2:3] == "-":
            text = text.rstrip()
        if text:
            out.append(("text", text))
        if m:
            strip, at = tag[-3:-2] == "-" and tag[1] != "#", m.end()
            if tag[1] != "#":
                out.append(("put" if tag[1] == "{" else "do", tag[2:-2].strip("-").strip()))
    return out


class _Statements:
    def __init__(self, source: str):
        self.tokens, self.at = _lexed(source), 0

    def block(self, *ends: str) -> tuple[list, str]:
        """Nodes up to one of the closing tags, and that tag."""
        out = []
        while self.at < len(self.tokens):
            kind, text = self.tokens[self.at]
            self.at += 1
            word = text.split(None, 1)[0] if kind == "do" and text else ""
            if kind == "text":
                out.append(("text", text))
            elif kind == "put":
                out.append(("put", fold(_Expression(text).whole())))
            elif word in ends:
                return out, text
            elif word == "for":
                m = re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+(.+)", text, re.S)
                if not m:
                    raise TemplateError(text)
                out.append(("for", m[1], fold(_Expression(m[2]).whole()), self.block("endfor")[0]))
            elif word == "if":
                out.append(self.branches(text[2:]))
            elif word == "generation":
                out.append(("generation", self.block("endgeneration")[0]))
            else:
                raise TemplateError(f"unknown tag {text!r}")
        if ends:
            raise TemplateError(f"missing {' or '.join(ends)}")
        return out, ""

    def branches(self, test: str):
        cond = fold(_Expression(test).whole())
        body, end = self.block("elif", "else", "endif")
        if end.startswith("elif"):
            return ("if", cond, body, [self.branches(end[4:])])
        return ("if", cond, body, self.block("endif")[0] if end == "else" else [])


def simplified(nodes: list, escape: Callable[[str], str]) -> list:
    """Constant output becomes text, decided branches are replaced by their body, neighbouring texts are joined."""
    out: list = []
    for n in nodes:
        if n[0] == "put" and n[1][0] == "const":
            v = n[1][1]
            new = [("text", str(v) if isinstance(v, Safe) else escape(shown(v)))]
        elif n[0] == "if" and n[1][0] == "const":
            new = simplified(n[2] if n[1][1] else n[3], escape)
        elif n[0] == "if":
            new = [("if", n[1], simplified(n[2], escape), simplified(n[3], escape))]
        elif n[0] == "for":
            new = [("for", n[1], n[2], simplified(n[3], escape))]
        elif n[0] == "generation":
            new = [("generation", simplified(n[1], escape))]
        else:
            new = [n]
        for x in new:
            if x[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + x[1])
            elif x != ("text", ""):
                out.append(x)
    return out


Render = Callable[[dict, bool], Iterator[tuple[str, bool]]]


def _renderer(nodes: list, escape: Callable[[str], str]) -> Render:
    parts = [_node(n, escape) for n in nodes]

    def run(env: dict, masked: bool):
        for p in parts:
            yield from p(env, masked)

    return parts[0] if len(parts) == 1 else run


def _node(n, escape: Callable[[str], str]) -> Render:
    if n[0] == "text":
        return lambda env, masked, t=n[1]: iter(((t, masked),))
    if n[0] == "put":
        value = evaluator(n[1])

        def put(env, masked):
            v = value(env)
            yield (str(v) if isinstance(v, Safe) else escape(shown(v))), masked

        return put
    if n[0] == "generation":
        body = _renderer(n[1], escape)
        return lambda env, masked: body(env, True)
    if n[0] == "if":
        test, yes, no = evaluator(n[1]), _renderer(n[2], escape), _renderer(n[3], escape)
        return lambda env, masked: (yes if test(env) else no)(env, masked)
    name, over, body = n[1], evaluator(n[2]), _renderer(n[3], escape)

    def loop(env, masked):
        items = iter(over(env) or ())
        nothing = object()
        item, index = next(items, nothing), 0
        while item is not nothing:
            following, index = next(items, nothing), index + 1
            yield from body(env | {name: item, "loop": {"index": index, "first": index == 1, "last": following is nothing}}, masked)
            item = following

    return loop


class Template:
    """A compiled template."""

    def __init__(self, source: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS):
        marks = "|".join(re.escape(c) for c in controls)
        self._mark = re.compile(rf"\\|(?={marks})")
        self.nodes = simplified(_Statements(source).block()[0], self.escape)
        self._render = _renderer(self.nodes, self.escape)

    def escape(self, text: str) -> str:
        return self._mark.sub(lambda m: "\\" + m[0], text)

    def pieces(self, messages: Iterable[dict]) -> Iterator[tuple[str, bool]]:
        """(text, under the loss mask) in order; messages are drawn one ahead."""
        return self._render({"messages": messages}, False)

    def render(self, messages: Iterable[dict]) -> tuple[str, list[int]]:
        """The formatted text and the loss mask as starts and ends."""
        out, spans = [], []
        n = 0
        for t, masked in self.pieces(messages):
            if masked and t:
                if spans and spans[-1] == n:
                    spans.pop()
                else:
                    spans.append(n)
                spans.append(n + len(t))
            n += len(t)
            out.append(t)
        return "".join(out), spans


class Reader:
    """Reads formatted text back, part after part, keeping only hashes and lengths."""

    _token = re.compile(r"\\(.)|(<turn>|<text>|</turn>)|([^\\<]+|<)", re.S)

    def __init__(self):
        self.turns, self.chars, self.loss_chars, self._inside = 0, 0, 0, False
        self._all, self._loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, text: str, spans: list[int]) -> None:
        self.chars += len(text)
        edges, masked = [0, *spans, len(text)], False
        for a, b in zip(edges, edges[1:], strict=False):
            for m in self._token.finditer(text, a, b):
                if m[2] == "<turn>":
                    self.turns += 1
                    self._inside = True
                elif m[2] == "</turn>":
                    self._all.update(b"\n")
                    self._inside = False
                elif m[2]:
                    self._all.update(b"\n")
                elif self._inside:
                    raw = (m[1] or m[3]).encode("utf-8", "surrogatepass")
                    self._all.update(raw)
                    if masked:
                        self._loss.update(raw)
                        self.loss_chars += len(m[1] or m[3])
            masked = not masked

    def result(self) -> tuple:
        return self.turns, self._all.hexdigest(), self.loss_chars, self._loss.hexdigest(), self.chars


PARTS = "conv_id long, part int, text string, loss array<int>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _rows(batches) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _flushed(rows: Iterable[tuple[tuple, int]], schema: pa.Schema, limit: int) -> Iterator[pa.RecordBatch]:
    """Rows with their sizes, in batches of about ``limit``."""
    held, size = [], 0
    for row, n in rows:
        held.append(row)
        size += n
        if size >= limit:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def formatted(turns: DataFrame, template: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS, part_chars: int = PART_CHARS) -> DataFrame:
    """conv_id, part, text, loss (starts and ends within the part): the formatted conversations, parts in order in one partition."""
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("text", pa.string()), ("loss", pa.list_(pa.int32()))])

    def parts(rows):
        compiled = Template(template, controls)
        row = next(rows, None)
        while row is not None:
            conv = row[0]

            def messages(conv=conv):
                nonlocal row
                while row is not None and row[0] == conv:
                    yield {"role": row[2] or "", "text": row[3] or ""}
                    row = next(rows, None)

            out, spans, n, part = [], [], 0, 0
            for t, masked in compiled.pieces(messages()):
                if n and n + len(t) > part_chars:
                    yield (conv, part, "".join(out), spans), n
                    out, spans, n, part = [], [], 0, part + 1
                if masked and t:
                    spans[-1:] = [n + len(t)] if spans and spans[-1] == n else [*spans[-1:], n, n + len(t)]
                out.append(t)
                n += len(t)
            yield (conv, part, "".join(out), spans), n

    ordered = small_batches(turns).select(*[column(c).alias(c) for c in ("conv_id", "turn", "role", "text")])
    ordered = ordered.withColumn("conv_id", F.col("conv_id").cast("bigint")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(lambda it: _flushed(parts(_rows(it)), schema, part_chars), PARTS)


def read_back(parts: DataFrame) -> DataFrame:
    """Per conversation of ``formatted``: turns, hashes and lengths, read from the formatted text."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def digests(rows):
        reader = last = None
        for conv, part, text, loss in rows:
            if part == 0:
                if reader is not None:
                    yield (last, *reader.result()), 1
                reader, last = Reader(), conv
            reader.feed(text, loss)
        if reader is not None:
            yield (last, *reader.result()), 1

    return parts.mapInArrow(lambda it: _flushed(digests(_rows(it)), schema, 10_000), DIGESTS)


def report(turns: DataFrame) -> DataFrame:
    """Per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the output."""
    return read_back(formatted(turns))
