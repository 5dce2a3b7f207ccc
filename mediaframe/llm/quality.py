"""Quality rules, line first: lines are judged one by one, failing lines go, documents losing too much text are rejected.

Words are runs of non-white-space (ASCII white space). Line rules, on lines with a word:

* symbols: more than one of ``#*$%&|<>`` per two words;
* navigation: three separators (words that are only punctuation) or more, making up a fifth of the words;
* shouting: three words or more, upper case and no lower case;
* stutter: eight words or more, a third of them equal to the word before;
* boilerplate: at most 20 words, a third or more of them in phrases of cookie banners, site menus or copyright lines; a sentence that only
  mentions one passes;
* punctuation: 12 words or more and not one of them ends a sentence or clause, by the marks of any script; a line with a word in
  a script written without such marks (Thai, Lao) passes.

A document is rejected if its base figures fail (fewer than ``min_words`` words; more than half of its words inside
3-word windows found twice or more) or if more than ``max_lost`` of its words stand on failing lines.

Defined cases: a null, empty or wordless text has zero figures, base_failed, and is not kept. Rows are judged alone, so
repeated rows get equal verdicts. Other columns pass through untouched.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaframe.llm.common import SPACE, column, small_batches, utf8

MIN_WORDS = 50
MAX_LOST = 0.5
SYMBOLS = "#*$%&|<>"
BOILERPLATE = (
    r"((we|site) uses? cookies|cookie|javascript|privacy policy|terms of (use|service)|all rights reserved|copyright|sign (up|in)|log ?in|subscribe|"
    r"newsletter|click here|read more|share (this|on)|follow us|powered by|skip to (main )?content)"
)
SEPARATOR = r"[!-/:-@\[-`{-~»›•·–—→]+"
# Unicode's Terminal_Punctuation (sentence and clause marks of all scripts) beyond ASCII, without the word dividers U+1361 and
# U+16EB-16ED, with the Armenian marks that stand inside a word. Scripts without spaces put them inside a word, so they count anywhere.
MARKS = (
    "\u037E\u0387\u055C-\u055E\u0589\u05C3\u060C\u061B\u061D-\u061F\u06D4\u0700-\u070A\u070C\u07F8\u07F9\u0830-\u0835\u0837-\u083E\u085E"
    "\u0964\u0965\u0E5A\u0E5B\u0F08\u0F0D-\u0F12\u104A\u104B\u1362-\u1368\u166E\u1735\u1736\u17D4-\u17D6\u17DA\u1802-\u1805\u1808\u1809"
    "\u1944\u1945\u1AA8-\u1AAB\u1B4E\u1B4F\u1B5A\u1B5B\u1B5D-\u1B5F\u1B7D-\u1B7F\u1C3B-\u1C3F\u1C7E\u1C7F\u2024\u203C\u203D\u2047-\u2049"
    "\u2CF9-\u2CFB\u2E2E\u2E3C\u2E41\u2E4C\u2E4E\u2E4F\u2E53\u2E54\u2E60\u2E61\u3001\u3002\uA4FE\uA4FF\uA60D-\uA60F\uA6F3-\uA6F7\uA876"
    "\uA877\uA8CE\uA8CF\uA92F\uA9C7-\uA9C9\uAA5D-\uAA5F\uAADF\uAAF0\uAAF1\uABEB\uFE12\uFE15\uFE16\uFE50-\uFE52\uFE54-\uFE57\uFF01\uFF0C"
    "\uFF0E\uFF1A\uFF1B\uFF1F\uFF61\uFF64\U0001039F\U000103D0\U00010857\U0001091F\U00010A56\U00010A57\U00010AF0-\U00010AF5"
    "\U00010B3A-\U00010B3F\U00010B99-\U00010B9C\U00010F55-\U00010F59\U00010F86-\U00010F89\U00011047-\U0001104D\U000110BE-\U000110C1"
    "\U00011141-\U00011143\U000111C5\U000111C6\U000111CD\U000111DE\U000111DF\U00011238-\U0001123C\U000112A9\U000113D4\U000113D5"
    "\U0001144B-\U0001144D\U0001145A\U0001145B\U000115C2-\U000115C5\U000115C9-\U000115D7\U00011641\U00011642\U0001173C-\U0001173E"
    "\U00011944\U00011946\U00011A42\U00011A43\U00011A9B\U00011A9C\U00011AA1\U00011AA2\U00011C41-\U00011C43\U00011C71\U00011EF7\U00011EF8"
    "\U00011F43\U00011F44\U00012470-\U00012474\U00016A6E\U00016A6F\U00016AF5\U00016B37-\U00016B39\U00016B44\U00016D6E\U00016D6F\U00016E97"
    "\U00016E98\U0001BC9F\U0001DA87-\U0001DA8A"
)
# Thai, Lao, New Tai Lue, Tai Viet; Linear A and B, Old Italic, Gothic, hieroglyphs
UNMARKED = "\u0E01-\u0E4F\u0E81-\u0EDF\u1980-\u19DF\uAA80-\uAADD\U00010000-\U000100FA\U00010300-\U0001034A\U00010600-\U00010767\U00013000-\U0001343F"
STOP = f"[.!?…,;:·][\"')\\]»”’“‘«›‹]*$|[{MARKS}{UNMARKED}]"

_WORD = re.compile(r"[^ \t-\r]+")
_BOILER = re.compile(BOILERPLATE, re.I)
_SEP = re.compile(SEPARATOR)
_STOP = re.compile(STOP)
_SYMBOL_BYTES = SYMBOLS.encode()

FIGURES = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()),
    T.StructField("lost_words", T.LongType()),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()),
])
#: with the text without its failing lines where there are some
CLEANED = T.StructType([*FIGURES.fields, T.StructField("clean", T.StringType())])


def line_fails(line: str, words: list[str]) -> str | None:
    """The first rule a line with words fails."""
    n = len(words)
    if sum(map(line.count, SYMBOLS)) * 2 > n:
        return "symbols"
    seps = sum(1 for w in words if w[0] in "|/>»›•·–—→-*+:" and _SEP.fullmatch(w))
    if seps >= 3 and seps * 5 >= n:
        return "navigation"
    if n >= 3 and line.isupper():
        return "shouting"
    if n >= 8 and sum(a == b for a, b in zip(words, words[1:], strict=False)) * 3 >= n:
        return "stutter"
    if n <= 20 and sum(len(m[0].split(" ")) for m in _BOILER.finditer(line)) * 3 >= n:
        return "boilerplate"
    if n >= 12 and not any(_STOP.search(w) for w in words):
        return "punctuation"
    return None


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more, first occurrences included."""
    n = len(words)
    if n < 3:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    pair = ids[:-1] * len(seen) + ids[1:]
    if len(seen) > 1 << 20:  # the triple would not fit 64 bits
        pair = np.unique(pair, return_inverse=True)[1]
    _, which, count = np.unique(pair[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[which] > 1)
    hit = np.zeros(n, bool)
    for j in range(3):
        hit[at + j] = True
    return int(hit.sum())


def figures(text: str | None, min_words: int = MIN_WORDS, max_lost: float = MAX_LOST) -> tuple:
    text, raw = text or "", utf8(text)
    words = raw.split()
    n, seen, dup, lost = len(words), set(), 0, 0
    for line in text.split("\n"):
        w = _WORD.findall(line)
        if not w:
            continue
        if line in seen:
            dup += 1
        else:
            seen.add(line)
        if line_fails(line, w):
            lost += len(w)
    repeat = repeated_words(words)
    failed = n < min_words or 100 * repeat > 50 * n
    blanks = len(raw) - len(raw.translate(None, SPACE))
    symbols = len(raw) - len(raw.translate(None, _SYMBOL_BYTES))
    return n, len(text) - blanks, symbols, dup, repeat, lost, failed, not failed and lost <= max_lost * n


def clean_text(text: str | None) -> str | None:
    """The text without its failing lines; lines without words stay."""
    if text is None:
        return None
    return "\n".join(x for x in text.split("\n") if not (w := _WORD.findall(x)) or not line_fails(x, w))


def measured(df: DataFrame, text: str = "text", out: str = "quality", min_words: int = MIN_WORDS, max_lost: float = MAX_LOST) -> DataFrame:
    """df with the struct column ``out`` of FIGURES."""

    @F.pandas_udf(FIGURES)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([figures(t, min_words, max_lost) for t in texts], columns=FIGURES.names)

    return small_batches(df).withColumn(out, run(column(text)))


def keep_good(df: DataFrame, text: str = "text", min_words: int = MIN_WORDS, max_lost: float = MAX_LOST, strip_lines: bool = True) -> DataFrame:
    """Kept documents with the columns of df; their failing lines are removed unless ``strip_lines`` is off."""

    @F.pandas_udf(CLEANED)
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [figures(t, min_words, max_lost) for t in texts]
        clean = [clean_text(t) if strip_lines and f[-1] and f[-3] else None for t, f in zip(texts, found, strict=True)]
        return pd.DataFrame(found, columns=FIGURES.names).assign(clean=pd.Series(clean, dtype=object))

    # said to be nondeterministic, or the filter would work it out a second time, in a second Python worker beside every task
    kept = small_batches(df).withColumn("__q", run.asNondeterministic()(column(text))).where("__q.kept")
    return kept.withColumn(text, F.coalesce("__q.clean", column(text))).drop("__q")


def report(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id and FIGURES."""
    return measured(df.select(column(doc_id).alias("doc_id"), column(text).alias("text"))).select("doc_id", "quality.*")
