"""Quality rules, line first: rules for punctuation, navigation and boilerplate judge each line, failing lines go, then documents that lose too much text go.

Line rules (blank lines pass and carry no text):
  * punctuation: a line of at least ``long_line`` words has a sentence mark somewhere in its last words, and no more than
    ``symbol_share`` of its words carry one of ``SYMBOLS``;
  * navigation: no more than ``bar_share`` of its words are bare separators such as ``|`` or ``>``, and a line of at least
    ``menu_words`` words does not have ``menu_share`` of them or more from the words of menus;
  * boilerplate: it is not one of the stock phrases of web pages (in four languages, see ``vocabularies``), and no word makes up more than ``same_share`` of a line
    of at least ``long_line`` words.
A document is rejected if failing lines hold more than ``lost_share`` of its word characters, or if the base rules fail.

Defined results: a null or empty text has no words, so the base rules reject it; repeated rows are judged alike; whole
texts of any length are judged; an empty table gives none; other columns come back inside ``doc``, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.llm import vocabularies

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
HAS_SYMBOL = re.compile(r"[#*$%&|<>]")
SEPARATOR = re.compile(r"[|>»›·•/\\-]+\Z")
SENTENCE_MARK = re.compile(r"[.!?…。！？:;\"”’)]")
BOILERPLATE = re.compile(rf"(?i)\A[^\w]*(?:{'|'.join(vocabularies.BOILERPLATE)})[^\w]*\Z")
AROUND = re.compile(r"\A[\W\d_]+|[\W\d_]+\Z")


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    repeat_window: int = 8
    repeat_percent: int = 30
    long_line: int = 8
    tail_words: int = 4
    symbol_share: float = 0.3
    bar_share: float = 0.25
    menu_words: int = 3
    menu_share: float = 0.8
    same_share: float = 0.5
    lost_share: float = 0.3


def is_menu(words: list[str], share: float) -> bool:
    """Whether at least ``share`` of the words are words of menus; it stops at the word that decides against it."""
    left = len(words)
    for w in words:
        if (w if w[0].isalpha() and w[-1].isalpha() else AROUND.sub("", w)).lower() not in vocabularies.NAVIGATION:
            left -= 1
            if left < share * len(words):
                return False
    return True


def line_passes(words: list[str], line: str, rules: Rules) -> bool:
    n = len(words)
    if not n:
        return True
    if BOILERPLATE.match(line):
        return False
    if sum(1 for w in words if SEPARATOR.match(w)) > rules.bar_share * n:
        return False
    if n >= rules.menu_words and is_menu(words, rules.menu_share):
        return False
    if n >= rules.long_line:
        if sum(1 for w in words if HAS_SYMBOL.search(w)) > rules.symbol_share * n:
            return False
        if not any(SENTENCE_MARK.search(w) for w in words[-rules.tail_words :]):
            return False
        if Counter(words).most_common(1)[0][1] > rules.same_share * n:
            return False
    return True


def repeated_words(words: list[str], window: int) -> int:
    """Words inside a window of ``window`` words that is in the text twice or more, the first time included.

    Windows are numbered exactly: doubling steps number the windows of 1, 2, 4 ... words by pairs of shorter ones.
    """
    n = len(words)
    if n <= window:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    if len(number) == n:
        return 0
    length = 1
    while length < window:
        step = min(length, window - length)
        pair = ids[: n - length - step + 1] * (n + 1) + ids[step : step + n - length - step + 1]
        ids = np.unique(pair, return_inverse=True)[1]
        length += step
    found = np.flatnonzero(np.bincount(ids)[ids] > 1)
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, found, 1)
    np.add.at(edge, found + window, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def judge(text: str | None, rules: Rules = Rules()) -> tuple[int, int, int, int, int, bool, bool, str]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, cleaned text)."""
    text = text or ""
    n_words = chars = dups = lost = 0
    seen: set[str] = set()
    all_words: list[str] = []
    left: list[str] = []
    for line in text.split("\n"):
        words = WORD.findall(line)
        if words:
            dups += line in seen
            seen.add(line)
        held = sum(map(len, words))
        chars += held
        all_words += words
        if line_passes(words, line, rules):
            left.append(line)
        else:
            lost += held
    n_words = len(all_words)
    repeats = repeated_words(all_words, rules.repeat_window)
    failed = n_words < rules.min_words or 100 * repeats > rules.repeat_percent * n_words
    kept = not failed and lost <= rules.lost_share * chars
    return n_words, chars, sum(map(text.count, SYMBOLS)), dups, repeats, failed, kept, "\n".join(left) if lost else text


FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("cleaned", pa.string())]


def judge_quality(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None, with_text: bool = True, rules: Rules = Rules()) -> DataFrame:
    """For each row: ``doc`` (a struct of the columns ``keep``, all by default), the counts, ``base_failed``, ``kept`` and, with ``with_text``, ``cleaned`` (the text without failing lines)."""
    rows = docs.select(F.struct(*(docs.columns if keep is None else keep)).alias("doc"), F.col(text_col).alias("text"))
    fields = FIELDS if with_text else FIELDS[:-1]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            told = [judge(t.as_py(), rules)[: len(fields)] for t in batch.column("text")]
            columns = list(zip(*told, strict=True)) if told else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *(pa.array(c, kind) for c, (_, kind) in zip(columns, fields, strict=True))], ["doc", *(name for name, _ in fields)])

    kinds = {pa.int64(): T.LongType(), pa.bool_(): T.BooleanType(), pa.string(): T.StringType()}
    return rows.mapInArrow(batches, T.StructType([rows.schema["doc"], *(T.StructField(n, kinds[k]) for n, k in fields)]))
