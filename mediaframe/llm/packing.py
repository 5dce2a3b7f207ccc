"""Harmonic packing of documents into training sequences.

A piece of length l belongs to class k = capacity div l: k pieces of it fill a bin. Classes never mix, every bin of class k takes exactly
k pieces, so workers fill their bins independently and only the pieces of their last, unfinished bins are left over.

*Cuts.* A plain harmonic bin wastes what lies between l and capacity / k. Documents may be cut, so each is cut into pieces just below
the reciprocals of the capacity: whole capacities first, and the rest by a table of the cheapest cuts, where a piece of class k costs its k-th
of a bin and a cut costs ``CUT_COST`` tokens. No cut leaves a piece under ``MIN_PIECE`` tokens.

*Workers.* One pass tokenizes, cuts and fills: a task keeps fewer than k open pieces of each class. What its bins leave over goes up a
tree: tasks of the next level each take the left pieces of ``FAN`` tasks and fill bins by the same rule, until one task holds fewer than k
pieces of each class, a number that depends on the capacity alone. These last pieces, of all classes together, are put into bins by first fit, the
longest first. So at most one bin's worth of padding a class is ever at stake, however many workers there are.

Ids are those of the tokenizer library. Where the vocabulary file is plain byte-level BPE whose ids are its merge ranks, a second library that merges by rank
encodes the same vocabulary three times as fast; any other file goes to the tokenizer library itself.

Long texts are tokenized in parts. A part ends before white space that follows another character; the byte-level splitter always ends a
piece there, and no special string holds white space, so the parts' ids are the text's ids. A text without such a point is one part.

Defined cases: null and empty texts are the single end id; repeated rows are packed each; an empty table gives no rows; a row without
doc_id is packed like any other. Extra columns are not read. Sequence numbers are unique, not consecutive, and the same whenever a finished plan is
read again, since each level is written before it is used.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaframe.llm.common import column, runs, small_batches, stored
from mediaframe.llm.tokens import PATTERN, byte_letters

CAPACITY = 1024
END_ID = 0
CUT_COST = 8
MIN_PIECE = 8
FAN = 8
PART_CHARS = 200_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PIECE = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")


@lru_cache(maxsize=8)
def cut_table(capacity: int = CAPACITY, cut_cost: float = CUT_COST, min_piece: int = MIN_PIECE) -> np.ndarray:
    """First piece of the cheapest cutting of a rest of 0 .. 2 * capacity - 1 tokens."""
    n = 2 * capacity
    cost, first = np.zeros(n), np.zeros(n, np.int64)
    own = np.r_[0.0, capacity / (capacity // np.arange(1, capacity + 1))]
    for r in range(1, n):
        best = (own[r], r) if r <= capacity else (np.inf, 0)
        lo, hi = min_piece, min(capacity, r - min_piece)
        if hi >= lo:
            lengths = np.arange(lo, hi + 1)
            total = own[lengths] + cost[r - lengths] + cut_cost
            at = len(total) - 1 - int(np.argmin(total[::-1]))  # the longest of equals
            best = min(best, (float(total[at]), int(lengths[at])))
        cost[r], first[r] = best
    return first


def cuts(n: int, capacity: int = CAPACITY, cut_cost: float = CUT_COST, min_piece: int = MIN_PIECE) -> list[int]:
    """Lengths of the pieces of a document of n tokens, in order."""
    whole = max(n // capacity - 1, 0)
    rest, table, out = n - whole * capacity, cut_table(capacity, cut_cost, min_piece), [capacity] * whole
    while rest:
        out.append(int(table[rest]) or min(rest, capacity))
        rest -= out[-1]
    return out


def first_number(level: int, task: int) -> int:
    """Where a task's sequence numbers start; every level and task has 2^34 of its own."""
    return (1 << 62 | level << 57 if level else 0) + (task << 34)


class Bins:
    """Open bins of one task, one a class; a finished bin gets a number."""

    def __init__(self, capacity: int, base: int):
        self.capacity, self.next = capacity, base
        self.open: dict[int, list[tuple]] = defaultdict(list)

    def add(self, piece: tuple) -> list[tuple]:
        """The rows of the bin that the piece completes, if it does."""
        k = self.capacity // piece[2]
        bin_ = self.open[k]
        bin_.append(piece)
        return self.close(self.open.pop(k)) if len(bin_) == k else []

    def close(self, pieces: list[tuple]) -> list[tuple]:
        number, at, out = self.next, 0, []
        self.next += 1
        for p in pieces:
            out.append((*p, number, at))
            at += p[2]
        return out

    def left(self) -> list[tuple]:
        return [(*p, None, None) for pieces in self.open.values() for p in pieces]


def first_fit(pieces: list[tuple], bins: Bins) -> list[tuple]:
    """All pieces in as few bins as first fit makes, the longest first."""
    content, room = [], []
    for p in sorted(pieces, key=lambda p: -p[2]):
        at = next((i for i, r in enumerate(room) if r >= p[2]), len(room))
        if at == len(room):
            content.append([])
            room.append(bins.capacity)
        content[at].append(p)
        room[at] -= p[2]
    return [row for c in content for row in bins.close(c)]


def frame(rows: list[tuple]) -> pd.DataFrame:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 7
    return pd.DataFrame({n: pd.array(list(c), "Int64") for n, c in zip([*PIECE, "sequence_id", "offset"], columns, strict=True)})


def parts(text: str, size: int = PART_CHARS) -> list[str]:
    """The text cut before white space that follows another character, into parts of about size characters."""
    out, start, n = [], 0, len(text)
    while n - start > size:
        at = start + size
        while at < n and not (text[at].isspace() and not text[at - 1].isspace()):
            at += 1
        if at == n:
            break
        out.append(text[start:at])
        start = at
    return [*out, text[start:]]


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use the cores
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def rank_encoder(path: str):
    """The same vocabulary for a quicker library, or None where the file is not plain byte-level BPE whose ids are its merge ranks."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, first, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    plain &= first.get("type") == "ByteLevel" and not first.get("add_prefix_space") and first.get("use_regex", True) and not spec.get("normalizer")
    plain &= all(t["special"] and not (t["single_word"] or t["lstrip"] or t["rstrip"]) for t in added)
    special, letters = {t["content"]: t["id"] for t in added}, {c: b for b, c in enumerate(byte_letters())}
    vocab = {t: i for t, i in model["vocab"].items() if t not in special}
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    if not plain or [vocab.get(m) for m in merged] != list(range(256, 256 + len(merged))) or len(vocab) != 256 + len(merged):
        return None
    ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items()}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def ids_of(part: str, path: str) -> np.ndarray:
    quick = rank_encoder(path)
    if quick is not None:
        try:
            return quick.encode_to_numpy(part, allowed_special="all", disallowed_special=()).astype("<u4")
        except ValueError:  # its splitter runs out of stack on a million spaces and more in one run; the tokenizer library does not
            pass
    return np.array(tokenizer(path).encode(part, add_special_tokens=False).ids, "<u4")


def token_ids(text: str, path: str) -> np.ndarray:
    """Ids of a text as unsigned 32-bit integers, as the tokenizer library gives them without added tokens."""
    return np.concatenate([ids_of(p, path) for p in parts(text)])


def _first_level(path: str, capacity: int, cut_cost: float, min_piece: int):
    def fill(batches):
        from pyspark import TaskContext

        bins = Bins(capacity, first_number(0, TaskContext.get().partitionId()))
        for df in batches:
            docs, texts = df["doc_id"].astype("Int64"), df["text"]
            for a, b in runs(texts, 1_000_000):
                rows = []
                for doc, text in zip(docs.iloc[a:b], texts.iloc[a:b], strict=True):
                    ids, start = np.append(token_ids(text or "", path), np.uint32(END_ID)).astype("<u4"), 0
                    for n in cuts(len(ids), capacity, cut_cost, min_piece):
                        crc = zlib.crc32(ids[start : start + n].tobytes())
                        rows += bins.add((doc, start, n, crc, len(ids)))
                        start += n
                yield frame(rows)
        yield frame(bins.left())

    return fill


def _next_level(capacity: int, level: int, last: bool):
    def fill(batches):
        from pyspark import TaskContext

        bins = Bins(capacity, first_number(level, TaskContext.get().partitionId()))
        for df in batches:
            yield frame([row for p in df[list(PIECE)].astype("Int64").itertuples(index=False, name=None) for row in bins.add(p)])
        rest = bins.left()
        yield frame(first_fit([r[:5] for r in rest], bins) if last else rest)

    return fill


def packed(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, cut_cost: float = CUT_COST, min_piece: int = MIN_PIECE) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = small_batches(docs).select(column(doc_id).cast("long").alias("doc_id"), column(text).alias("text"))
    tasks = rows.rdd.getNumPartitions()
    done = stored(rows.mapInPandas(_first_level(path, capacity, cut_cost, min_piece), SCHEMA), "packed")
    out, level = done.where("sequence_id IS NOT NULL"), 0
    left = done.where("sequence_id IS NULL")
    while True:
        level, tasks = level + 1, -(-tasks // FAN)
        done = stored(left.coalesce(tasks).mapInPandas(_next_level(capacity, level, tasks == 1), SCHEMA), "packed")
        out, left = out.unionByName(done.where("sequence_id IS NOT NULL")), done.where("sequence_id IS NULL")
        if tasks == 1:
            return out


def sequences(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Per sequence: n_pieces, tokens, padding. A sequence whose tokens are a power of two needs none."""
    got = pieces.groupBy("sequence_id").agg(F.count("*").alias("n_pieces"), F.sum("length").alias("tokens"))
    power = F.col("tokens").bitwiseAND(F.col("tokens") - 1) == 0
    return got.withColumn("padding", F.when(power, 0).otherwise(F.lit(capacity) - F.col("tokens")).cast("bigint"))
