"""Columns over text: lines, tokens, hashes, estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that searches leave out, and words that structural hashes keep.
STOP_WORDS = ("the", "and", "for", "from", "import", "export", "return")
KEYWORDS = (
    "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with yield "
    "let package private protected public static async await as from any string number boolean def elif except lambda pass None True False func go chan select defer map type struct interface "
    "fn pub impl trait mut use mod match where self"
).split()
COMPLEXITY = r"\b(if|else\s+if|for|while|catch|case|&&|\|\|)\b"


def split_lines(text: Column) -> Column:
    """All lines, trailing empty ones too; an empty text is one empty line."""
    return F.split(text, "\n", -1)


def lines(files: DataFrame, path: str = "file_path", content: str = "content") -> DataFrame:
    """``file_path, line_no (from 1), line, n_lines``."""
    held = files.select(F.col(path).alias("file_path"), split_lines(F.col(content)).alias("_lines"))
    return held.select("file_path", F.posexplode("_lines").alias("_pos", "line"), F.size("_lines").alias("n_lines")).select("file_path", (F.col("_pos") + 1).alias("line_no"), "line", "n_lines")


def line_count(text: Column) -> Column:
    return F.size(split_lines(text))


def trimmed(text: Column) -> Column:
    """Without white space at both ends, tabs and line ends included."""
    return F.regexp_replace(text, r"^[\s ﻿]+|[\s ﻿]+$", "")


def tokens(text: Column) -> Column:
    """Lower-case terms of two characters or more: case changes, ``_ . / -`` and other punctuation split; stop words go."""
    split = F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2")
    found = F.split(F.lower(F.regexp_replace(split, r"[^a-zA-Z0-9\s]", " ")), r"\s+")
    return F.filter(found, lambda t: (F.length(t) >= 2) & ~t.isin(*STOP_WORDS))


def query_tokens(text: Column) -> Column:
    """Tokens of a query, each once."""
    return F.array_distinct(tokens(text))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def structural_text(text: Column) -> Column:
    """Code reduced to its structure: no comments, literals and names as placeholders, single spaces."""
    literal, name = "\u0001", "\u0002"
    for pattern, to in (
        (r"(?s)/\*.*?\*/", ""),
        (r"(?m)//.*$", ""),
        (r"(?m)#.*$", ""),
        (r"""(?s)(["'`])(?:\\.|[^\\])*?\1""", literal),
        (r"\b\d+(\.\d+)?\b|\b0[xX][0-9a-fA-F]+\b|\b0[bB][01]+\b", literal),
        (rf"\b(?!(?:{'|'.join(KEYWORDS)})(?![A-Za-z0-9_$]))[a-zA-Z_$][a-zA-Z0-9_$]*\b", name),
        (r"\s+", " "),
    ):
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)


def struct_hash(text: Column) -> Column:
    return F.sha2(structural_text(text), 256)


def complexity(text: Column) -> Column:
    """Branch words in a stretch of code."""
    return F.regexp_count(text, F.lit(COMPLEXITY))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def char_code_sum(text: Column) -> Column:
    """The sum of the code points of a text."""
    return F.aggregate(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c)), F.lit(0).cast("long"), lambda a, c: a + c)


def secret_label(line: Column, label: str = "[REDACTED]") -> Column:
    """What stands before the first ``=``, then a label; without one the label alone."""
    return F.when(F.contains(line, F.lit("=")), F.concat(F.substring_index(line, "=", 1), F.lit("= " + label))).otherwise(F.lit(label))


def padded(text: Column, width: int) -> Column:
    """Filled up with spaces to ``width``; longer texts stay whole."""
    return F.when(F.length(text) < width, F.rpad(text, width, " ")).otherwise(text)


def bar(score: Column, cells: int = 10) -> Column:
    """A bar of ``cells`` for a score from 0 to 100."""
    full = F.round(score / (100 / cells)).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(cells) - full))
