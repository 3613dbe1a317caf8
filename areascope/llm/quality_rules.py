"""Quality rules, line first.

Every line is judged on its own by three rules (punctuation, navigation,
boilerplate); lines that fail go, and a document that loses too much of its
text that way is rejected. Document-level base figures (word and symbol
counts, repeated lines, repeated eight-word windows) are reported beside it
and reject documents of their own.

A boilerplate phrase counts as whole words only, and fails a line only if such
phrases make up a good share of it: "powered by water from the lake" inside a
sentence is prose, "Powered by Example" is not.

Defined results: null or empty text has no words and fails the base rule;
an empty table gives an empty result; texts and lines of any length are judged
whole; every input row gives one output row, repeated rows included, and of
equal lines of a text the first stays; columns other than the id and the text
are not looked at, so their names cannot clash.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, schema_of, utf8

SYMBOLS = "#*$%&|<>"
_BLANK = " \t\n\x0b\x0c\r"
_SEPARATORS = re.compile(r"[|»›•·]")
_END = re.compile(r"""[.!?…:;。！？][)"'»”’\]]*$""")
_MARK = re.compile(r"[.!?…,:;。！？、]")
_RUN = re.compile(r"[!?]{2,}")
# Phrases that mark boilerplate lines if they make up a good share of them.
BOILERPLATE = [
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "terms and conditions",
    "licensed under", "apache license", "mit license", "gnu general public license", "creative commons",
    "subscribe to our newsletter", "sign up for our newsletter", "click here", "read more", "share this",
    "powered by", "lorem ipsum", "javascript is disabled",
    "enable javascript", "use of cookies", "uses cookies", "follow us on", "skip to content", "back to top",
]
# Marks that make a line a notice if it begins with them.
NOTICES = ["©", "copyright ©", "(c) copyright", "copyright (c)"]
_BOILERPLATE = re.compile(r"\b(?:" + "|".join(re.escape(p) for p in BOILERPLATE) + r")\b", re.IGNORECASE | re.ASCII)
_NOTICE = re.compile("|".join(re.escape(p) for p in NOTICES), re.IGNORECASE | re.ASCII)


@dataclass(frozen=True)
class LineRules:
    """Limits of the rules; shares are of words unless said otherwise."""

    min_words: int = 20             # base: fewer words reject a document
    max_repeat_pct: int = 30        # base: more words in repeated windows reject it
    window: int = 8
    max_symbol_share: float = 0.2   # punctuation: symbols a word in a line
    max_run_share: float = 0.2      # punctuation: words ending in !! or ??
    min_open_words: int = 4         # punctuation: a line without an end mark needs so many words
    max_open_words: int = 30        # punctuation: longer lines need a mark somewhere
    max_separator_share: float = 0.2  # navigation: separators a word
    boilerplate_words: int = 40     # boilerplate: phrases count in lines of at most so many words
    phrase_share: float = 0.25      # boilerplate: share of the line's characters in such phrases, whole words only
    max_lost: float = 0.5           # document: share of its words lost with its lines


def line_verdict(line: str, n: int, rules: LineRules) -> str:
    """'' if the line of ``n`` words stays, else the rule that it fails."""
    if len(_SEPARATORS.findall(line)) > rules.max_separator_share * n:
        return "navigation"
    if n <= rules.boilerplate_words:
        bare = line.strip(_BLANK)
        in_phrases = sum(len(p) for p in _BOILERPLATE.findall(bare))
        if _NOTICE.match(bare) or (in_phrases and in_phrases >= rules.phrase_share * len(bare)):
            return "boilerplate"
    symbols = sum(line.count(c) for c in SYMBOLS)
    if symbols > rules.max_symbol_share * n or len(_RUN.findall(line)) > max(1, rules.max_run_share * n):
        return "punctuation"
    if n > rules.max_open_words and not _MARK.search(line):
        return "punctuation"
    if n < rules.min_open_words and not _END.search(line.rstrip(_BLANK)):
        return "punctuation"
    return ""


def repeated_words(words: list, window: int) -> int:
    """Words inside a window of so many words that occurs twice or more in the list."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.uint64, count=len(words))
    if len(ids) == len(words):
        return 0
    # Ranks doubled from single words to windows: exact, no hash of a window is trusted.
    rank, width = codes, 1
    while width < window:
        step = min(width, window - width)
        both = rank[: len(rank) - step] * np.uint64(len(words) + 1) + rank[step:]
        _, rank = np.unique(both, return_inverse=True)
        rank, width = rank.astype(np.uint64), width + step
        if int(rank.max()) + 1 == len(rank):
            return 0
    count = np.bincount(rank.astype(np.int64))
    starts = np.flatnonzero(count[rank.astype(np.int64)] > 1)
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def judge(text: str | None, rules: LineRules) -> tuple:
    """Base figures, verdict, line counts and the text left of one document."""
    text = text or ""
    words = utf8(text).split()  # bytes split at ASCII white space only
    n_words = len(words)
    word_chars = len(text) - sum(text.count(c) for c in _BLANK)
    n_symbols = sum(text.count(c) for c in SYMBOLS)
    n_repeat = repeated_words(words, rules.window)
    seen, kept, lost, n_dup, n_lines, n_bad = set(), [], 0, 0, 0, 0
    for line in text.split("\n"):
        size = len(utf8(line).split())
        if size == 0:
            kept.append(line)
            continue
        n_lines += 1
        again = line in seen
        n_dup += again
        seen.add(line)
        if again or line_verdict(line, size, rules):
            n_bad, lost = n_bad + 1, lost + size
        else:
            kept.append(line)
    failed = n_words < rules.min_words or 100 * n_repeat > rules.max_repeat_pct * n_words
    keep = not failed and lost <= rules.max_lost * n_words
    return (n_words, word_chars, n_symbols, n_dup, n_repeat, failed, keep, n_lines, n_bad, lost, "\n".join(kept))


FIGURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
           "kept boolean, n_lines long, n_bad_lines long, n_lost_words long, clean_text string")


def judge_lines(docs: DataFrame, keep: list[str], text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """The columns ``keep`` of ``docs`` with the figures, verdict and cleaned text of each row.

    One pass over the rows, no shuffle.
    """
    def one(*row):
        return (*row[:-1], *judge(row[-1], rules))

    return map_rows(docs.select(*keep, F.col(text).alias("__text")), one, schema_of(docs, keep, FIGURES))


def clean_documents(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """Documents that pass, with the failing lines gone from their text; same columns as ``docs``."""
    rows = docs.select(F.struct(*docs.columns).dropFields("text").alias("__row"), "text")
    out = judge_lines(rows, ["__row"], rules=rules).filter("kept")
    cols = {"text": F.col("clean_text"), "n_chars": F.char_length("clean_text").cast("long")}
    return out.select([cols[c].alias(c) if c in cols else F.col("__row").getField(c).alias(c) for c in docs.columns])
