"""Line windows over files, with a summary and tags by what they contain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.text import split_lines, struct_hash

SIZE, OVERLAP = 40, 8

# Tags of a window by the first kind of words that it has; the first ones are for the server file.
TAGS = (
    ("server.ts", ("app.get", "app.post"), ("REST API endpoints", "router configs"), "routes of a web server"),
    ("server.ts", ("start(",), ("server boot", "Vite middleware configuration"), "start of a web server"),
    (None, ("class ",), ("class configuration", "types definition"), "classes"),
    (None, ("async ",), ("async operations", "promises block"), "asynchronous code"),
    (None, ("import ", "require"), ("imports resolution", "dependency management"), "imports"),
    (None, ("export ",), ("module exports", "public APIs"), "exports"),
    (None, ("db.", "sql", "INSERT ", "SELECT "), ("database queries", "data persistence"), "database access"),
    (None, ("test(", "describe(", "expect("), ("unit testing", "assertion block"), "tests"),
    (None, ("interface ", "type ", "enum "), ("type signatures", "type definitions"), "type declarations"),
)
BASE_TAG = "logic execution"


def windows(files: DataFrame, size: int = SIZE, overlap: int = OVERLAP, path: str = "file_path", content: str = "content") -> DataFrame:
    """``chunk_id, file_path, chunk_seq, start_line, end_line, content``.

    A file of ``size`` lines or fewer is one window; else windows start every ``size - overlap`` lines until one reaches
    the end. The starts follow from the line count, so each file is one generator row, with no loop and no shuffle.
    """
    stride = size - overlap
    held = files.select(F.col(path).alias("file_path"), split_lines(F.col(content)).alias("_lines"))
    last = F.greatest(F.lit(1), F.ceil((F.size("_lines") - overlap) / stride)).cast("int") - 1
    starts = F.sequence(F.lit(0), last * stride, F.lit(stride))
    placed = held.select("file_path", "_lines", F.posexplode(starts).alias("_k", "_start"))
    return placed.select(
        F.concat_ws("#", "file_path", F.col("_k") + 1).alias("chunk_id"),
        "file_path",
        (F.col("_k") + 1).alias("chunk_seq"),
        (F.col("_start") + 1).alias("start_line"),
        F.least(F.col("_start") + size, F.size("_lines")).alias("end_line"),
        F.array_join(F.slice("_lines", F.col("_start") + 1, size), "\n").alias("content"),
    )


def _ladder(file_path: Column, content: Column, pick, default: Column) -> Column:
    out = None
    server = file_path == "server.ts"
    for only, words, tags, summary in TAGS:
        met = F.lit(False)
        for w in words:
            met = met | F.contains(content, F.lit(w))
        met = met & (server if only else ~server)
        out = F.when(met, pick(tags, summary)) if out is None else out.when(met, pick(tags, summary))
    return out.otherwise(default)


def intent_tags(file_path: Column, content: Column) -> Column:
    return _ladder(file_path, content, lambda tags, _: F.array(*[F.lit(t) for t in (BASE_TAG, *tags)]), F.array(F.lit(BASE_TAG)))


def summary(file_path: Column, content: Column) -> Column:
    return _ladder(file_path, content, lambda _, text: F.lit(f"Contains {text}."), F.concat(F.lit("Code of "), file_path, F.lit(".")))


def chunks(files: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Windows with summary, tags and structural hash."""
    return windows(files, size, overlap).withColumns({"summary": summary(F.col("file_path"), F.col("content")), "intent_tags": intent_tags(F.col("file_path"), F.col("content")), "struct_hash": struct_hash(F.col("content"))})


def describe_file(file_path: Column, language: Column) -> Column:
    """A line on a file by its path."""
    return (
        F.when(file_path == "server.ts", "Server entry and routes.")
        .when(F.contains(file_path, F.lit("engines/")), "Analysis engine.")
        .when(F.contains(file_path, F.lit("cli/")), "Command line.")
        .when(file_path == "package.json", "Package manifest.")
        .otherwise(F.concat(F.lit("Source file in "), F.coalesce(language, F.lit("an unknown language")), F.lit(".")))
    )
