"""Token counts by a splitter and a tokenizer compiled to a finite-state transducer.

Byte-level BPE is two machines. A splitter cuts a text into pieces, and a piece machine reads a piece's bytes and emits
token counts. The piece machine is compiled to a deterministic transducer whose transitions carry the number of tokens they
emit; the splitter is the tokenizer's regular expression, not a transducer.

*Piece machine.* An encoding is BPE's own exactly if every two neighbouring tokens encode to themselves. After some bytes the
machine therefore needs only, for each suffix that could still grow into a longer token, the last token before that suffix and how many
tokens stand there. Counts are kept relative to the least, which the transition emits, so the states are finitely many; they are
built when first reached and kept in a table (state, byte) -> (state, emitted).

*Chunks.* Texts are cut into chunks. Before white space that follows other characters a piece always ends, whatever came before, so
what follows a chunk's first such point is the same for every entry state. A chunk is summarised as head (up to that
point), emitted tokens, tail (from its last such point); there is no map over entry states. Two summaries join to one (the left tail and
the right head are read again), joining is associative, and a text's summaries are joined in one loop in its own row.

Special strings inside texts are cut out first, as the tokenizer library does, and count one token each.

Defined cases: null and empty texts have no bytes and no tokens; a text without white space is one chunk, however long; repeated
rows are counted each. Extra columns are not read.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaframe.llm.common import column, small_batches, utf8

LIMIT = 1024
CHUNK_CHARS = 8192
KEPT_PIECES = 500_000
KEPT_STATES = 300_000
# fixed value: the splitting pattern of this tokenizer
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

COUNTS = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class PieceMachine:
    """bytes of one piece -> number of tokens, by lazily built deterministic transitions."""

    def __init__(self, tokens: list[bytes], ranks: dict[tuple[bytes, bytes], int]):
        self.ranks = ranks
        # a trie of the tokens BPE can produce: node -> {byte: node}; node -> token
        self.next: list[dict[int, int]] = [{}]
        self.token: list[bytes | None] = [None]
        for t in tokens:
            node = 0
            for b in t:
                if b not in self.next[node]:
                    self.next.append({})
                    self.token.append(None)
                    self.next[node][b] = len(self.next) - 1
                node = self.next[node][b]
            self.token[node] = t
        self._alone: dict[bytes, bool] = {}
        self._pair: dict[tuple[bytes, bytes], bool] = {}
        #: a state: {(trie node of the suffix, token before it, count over the least)}
        self.start = self._state(((0, b"", 0),), fresh=True)

    def _state(self, members, fresh: bool = False) -> int:
        if fresh:
            self.states, self.number, self.table, self.final = [], {}, [], []
        if members not in self.number:
            self.number[members] = len(self.states)
            self.states.append(members)
            self.table.append({})
            self.final.append(next((c for node, _, c in members if node == 0), None))
        return self.number[members]

    def merged(self, data: bytes) -> list[bytes]:
        """Plain BPE, for short strings."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, before: bytes, token: bytes) -> bool:
        """Can BPE leave ``token`` standing, after ``before``?"""
        if token not in self._alone:
            self._alone[token] = self.merged(token) == [token]
        if not self._alone[token] or not before:
            return self._alone[token]
        key = before, token
        if key not in self._pair:
            self._pair[key] = self.merged(before + token) == [before, token]
        return self._pair[key]

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, tokens emitted)."""
        done = self.table[state].get(byte)
        if done is None:
            grown = [(self.next[node][byte], before, c) for node, before, c in self.states[state] if byte in self.next[node]]
            ended = [(0, self.token[node], c + 1) for node, before, c in grown if self.token[node] and self._fits(before, self.token[node])]
            members = [m for m in grown if self.next[m[0]]] + ended
            least = min(c for _, _, c in members)
            members = tuple(sorted((node, before, c - least) for node, before, c in members))
            done = self.table[state][byte] = self._state(members), least
        return done

    def count(self, piece: bytes) -> int:
        if len(self.states) > KEPT_STATES:  # begin the table anew; states come back as they are reached
            self.start = self._state(((0, b"", 0),), fresh=True)
            self._pair.clear()
        state, n = self.start, 0
        for b in piece:
            state, k = self.step(state, b)
            n += k
        return n + self.final[state]


@dataclass(frozen=True)
class Span:
    """State map of a stretch of text: its head up to the first certain piece end, the tokens between, its tail from the last one.

    A stretch without such a point has only a head (tail None)."""

    head: str
    tokens: int = 0
    tail: str | None = None


@dataclass
class Counter:
    """The compiled tokenizer of one task."""

    machine: PieceMachine
    special: regex.Pattern | None
    split: regex.Pattern = field(default_factory=lambda: regex.compile(PATTERN))
    _known: dict[str, int] = field(default_factory=dict)
    _edge: regex.Pattern = field(default_factory=lambda: regex.compile(r"(?<=\S)(?=\s)"))

    @classmethod
    def load(cls, path: str) -> Counter:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: i for i, c in enumerate(byte_letters())}
        raw = lambda t: bytes(byte[c] for c in t)
        special = [a["content"] for a in spec["added_tokens"]]
        tokens = [raw(t) for t in spec["model"]["vocab"] if t not in special]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        strings = "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))
        return cls(PieceMachine(tokens, ranks), regex.compile(strings) if strings else None)

    def pieces(self, text: str) -> int:
        """Tokens of a stretch that begins and ends at piece ends."""
        known, total = self._known, 0
        for p in self.split.findall(text):
            n = known.get(p)
            if n is None:
                if len(known) >= KEPT_PIECES:
                    known.clear()
                n = known[p] = self.machine.count(utf8(p))
            total += n
        return total

    def span(self, chunk: str) -> Span:
        first = self._edge.search(chunk)
        if first is None:
            return Span(chunk)
        # the last white space after another character
        last = first.start()
        for i in range(len(chunk) - 1, last, -1):
            if chunk[i].isspace() and not chunk[i - 1].isspace() and self._edge.search(chunk, i - 1, i + 1):
                last = i
                break
        return Span(chunk[: first.start()], self.pieces(chunk[first.start() : last]), chunk[last:])

    def join(self, a: Span, b: Span) -> Span:
        """The state map of two stretches in a row."""
        if a.tail is None and b.tail is None:
            return self.span(a.head + b.head)
        if a.tail is None:
            m = self.span(a.head + b.head)
            return Span(m.head, b.tokens, b.tail) if m.tail is None else Span(m.head, m.tokens + self.pieces(m.tail) + b.tokens, b.tail)
        m = self.span(a.tail[1:] + b.head) if b.tail is None else None
        if m is not None:  # b is all head: the tail may have grown past further certain ends
            if m.tail is None:
                return Span(a.head, a.tokens, a.tail + b.head)
            return Span(a.head, a.tokens + self.pieces(a.tail[:1] + m.head) + m.tokens, m.tail)
        return Span(a.head, a.tokens + self.pieces(a.tail + b.head) + b.tokens, b.tail)

    def composed(self, spans: list[Span]) -> Span:
        """Composition of neighbours, level by level."""
        while len(spans) > 1:
            pairs = [self.join(a, b) for a, b in zip(spans[::2], spans[1::2], strict=False)]
            spans = pairs + spans[len(pairs) * 2 :]
        return spans[0]

    def plain(self, text: str, chunk: int = CHUNK_CHARS) -> int:
        """Tokens of a text without special strings."""
        if not text:
            return 0
        whole = self.composed([self.span(text[i : i + chunk]) for i in range(0, len(text), chunk)])
        return self.pieces(whole.head) + whole.tokens + (self.pieces(whole.tail) if whole.tail else 0)

    def count(self, text: str | None, chunk: int = CHUNK_CHARS) -> int:
        if not text:
            return 0
        if self.special is None or self.special.search(text) is None:
            return self.plain(text, chunk)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self.plain(p, chunk) for p in parts)


_loaded: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One compiled tokenizer per worker process."""
    if path not in _loaded:
        _loaded[path] = Counter.load(path)
    return _loaded[path]


def counted(df: DataFrame, path: str, text: str = "text", out: str = "tokens") -> DataFrame:
    """df with the struct column ``out`` of COUNTS; ``path`` is the vocabulary file, present on every executor."""

    @F.pandas_udf(COUNTS)
    def run(texts: pd.Series) -> pd.DataFrame:
        c = counter(path)
        return pd.DataFrame([(len(utf8(t)), c.count(t)) for t in texts], columns=COUNTS.names)

    return small_batches(df).withColumn(out, run(column(text)))


def report(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit."""
    c = counted(docs.select(column(doc_id).alias("doc_id"), column(text).alias("text")), path)
    return c.select("doc_id", "tokens.*").withColumn("over_limit", F.col("n_tokens") > limit)
