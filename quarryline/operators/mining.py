"""Measures of history and structure: churn, co-change, clones, metrics, boundaries, impact, test gaps."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline import schemas
from quarryline.functions.paths import dirname, stem
from quarryline.functions.text import char_code_sum, lines, trimmed
from quarryline.operators.substrings import contained
from quarryline.sources.store import ranged, written

# Architectural boundaries that hold by default.
DEFAULT_SCOPE_RULES = (
    ("src/frontend", "src/server", "error", "Frontend must not import the server."),
    ("src/frontend", "src/engines", "error", "Frontend must not import engines."),
    ("src/engines", "src/frontend", "error", "Engines must not import the frontend."),
    ("src/cli", "src/frontend", "error", "Command line must not import the frontend."),
)
TEST_FILE = r"\.test\.|\.spec\.|/test/|/tests/|__tests__"


#: Files of a commit that are paired within one task at a time.
BLOCK = 1000
WORD = r"\p{L}\p{M}\p{N}_$"


# History ------------------------------------------------------------------------------------------------------------


def commit_counts(commits: DataFrame) -> DataFrame:
    """``file_path, commits_count``: commits that touch a file, each once."""
    return commits.distinct().groupBy("file_path").agg(F.count("*").alias("commits_count"))


def cochange(commits: DataFrame, tracked: DataFrame | None = None) -> DataFrame:
    """``file_a, file_b, cochange_count, ratio``, in both directions; the ratio is the Jaccard index of their commits in percent, rounded.

    The files of a commit are dealt into blocks of about ``BLOCK``; pairs form within a block and between two blocks of a
    commit, each pair once, so that a commit of any size is many small groups and no list grows with it.
    """
    held = commits.distinct()
    if tracked is not None:
        held = held.join(tracked.select("file_path").distinct(), "file_path", "left_semi")
    counts = held.groupBy("file_path").agg(F.count("*").alias("n"))
    sizes = held.groupBy("commit_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    dealt = held.join(sizes, "commit_id").withColumn("_own", F.pmod(F.xxhash64("file_path"), F.col("_blocks")).cast("int"))
    met = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    lists = F.collect_list(F.when(F.col("_own") <= F.col("_other"), F.col("file_path"))), F.collect_list(F.when(F.col("_own") > F.col("_other"), F.col("file_path")))
    groups = met.groupBy("commit_id", low.alias("_low"), high.alias("_high")).agg(lists[0].alias("_a"), lists[1].alias("_b"))
    one = groups.select("_low", "_high", "_a", "_b", F.explode("_a").alias("_x"))
    others = F.when(F.col("_low") < F.col("_high"), F.col("_b")).otherwise(F.filter("_a", lambda y: y > F.col("_x")))
    made = one.select("_x", F.explode(others).alias("_y"))
    pairs = made.groupBy(F.least("_x", "_y").alias("file_a"), F.greatest("_x", "_y").alias("file_b")).agg(F.count("*").alias("cochange_count"))
    joined = pairs.join(counts.select(F.col("file_path").alias("file_a"), F.col("n").alias("n_a")), "file_a").join(counts.select(F.col("file_path").alias("file_b"), F.col("n").alias("n_b")), "file_b")
    told = joined.select("file_a", "file_b", "cochange_count", F.round(100 * F.col("cochange_count") / (F.col("n_a") + F.col("n_b") - F.col("cochange_count"))).cast("int").alias("ratio"))
    return symmetric(told, "file_a", "file_b")


def symmetric(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs and their mirror images."""
    swap = {a: F.col(b).alias(a), b: F.col(a).alias(b)}
    return pairs.unionByName(pairs.select(*[swap.get(c, F.col(c)) for c in pairs.columns]))


def undirected(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Each pair once, the smaller first; no pair of a thing with itself."""
    return pairs.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).where(F.col(a) < F.col(b)).distinct()


def coupled(pairs: DataFrame, file: str) -> DataFrame:
    return pairs.where(F.col("file_a") == file).orderBy(F.desc("ratio"), "file_b")


def churn(counts: DataFrame, complexity: DataFrame) -> DataFrame:
    """``file_path, commits_count, churn_score``: 10 to 100, by commits and complexity relative to the largest; complexity 0 or none counts as 1."""
    held = counts.join(complexity.select("file_path", "complexity"), "file_path", "left").withColumn("c", F.coalesce(F.nullif(F.col("complexity"), F.lit(0)), F.lit(1)))
    most = held.agg(F.greatest(F.max("commits_count"), F.lit(1)).alias("max_n"), F.greatest(F.max("c"), F.lit(1)).alias("max_c"))
    score = F.round(F.col("commits_count") / F.col("max_n") * (F.col("c") / F.col("max_c")) * 90 + 10)
    return held.crossJoin(F.broadcast(most)).select("file_path", "commits_count", F.least(F.greatest(score, F.lit(10)), F.lit(100)).cast("int").alias("churn_score"))  # one row


def hotspots(files: DataFrame, churned: DataFrame) -> DataFrame:
    """Files with their churn, 1 commit and score 10 where there is none; highest first."""
    held = files.select("file_path").join(churned, "file_path", "left").select("file_path", F.coalesce("commits_count", F.lit(1)).cast("long").alias("commits_count"), F.coalesce("churn_score", F.lit(10)).alias("churn_score"))
    return held.orderBy(F.desc("churn_score"), "file_path")


def stand_in_churn(files: DataFrame) -> DataFrame:
    """Figures made from names alone, for corpora without history. They mean nothing; ask for them by name."""
    h = char_code_sum(F.col("file_path"))
    return files.select("file_path", (h % 4 + 1).cast("long").alias("commits_count"), F.least(F.lit(100), F.greatest(F.lit(12), h * 13 % 75 + 10)).cast("int").alias("churn_score"))


def latest_author(commits: DataFrame) -> DataFrame:
    """``file_path, author, email, date`` of the last commit that touches each file."""
    last = commits.groupBy("file_path").agg(F.max(F.struct("date", "commit_id", "author", "email")).alias("c"))
    return last.select("file_path", "c.author", "c.email", "c.date")


# Clones -------------------------------------------------------------------------------------------------------------


def hash_groups(rows: DataFrame, key: str) -> DataFrame:
    """Values of ``key`` that stand in two rows or more, with their count."""
    return rows.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def clones(chunks: DataFrame, min_lines: int = 6) -> DataFrame:
    """Windows of equal structure: each later one with the first of its group, exact if equal without white space.

    A group of n windows gives n - 1 rows, which name the whole group, and not all n * (n - 1) / 2 pairs. Windows of one
    file less than five lines apart are no clones.
    """
    held = chunks.where(F.col("struct_hash").isNotNull() & (F.col("struct_hash") != "")).withColumn("_plain", F.sha2(F.regexp_replace("content", r"\s+", ""), 256))
    first = held.groupBy("struct_hash").agg(F.count("*").alias("n"), F.min(F.struct("file_path", "start_line", "end_line", "_plain", F.size(F.split("content", "\n")).alias("n_lines"))).alias("a")).where("n > 1")
    met = held.join(first, "struct_hash").where((F.col("file_path") != F.col("a.file_path")) | (F.abs(F.col("start_line") - F.col("a.start_line")) >= 5))
    told = met.select(
        "struct_hash", F.col("a.file_path").alias("file_a"), F.col("a.start_line").alias("start_a"), F.col("a.end_line").alias("end_a"), F.col("file_path").alias("file_b"), F.col("start_line").alias("start_b"), F.col("end_line").alias("end_b"),
        F.greatest(F.col("a.n_lines"), F.size(F.split("content", "\n"))).alias("duplicated_lines"), F.when(F.col("_plain") == F.col("a._plain"), "exact").otherwise("parameterised").alias("similarity"), "n",
    )
    return told.where(F.col("duplicated_lines") >= min_lines)


def clone_pairs(chunks: DataFrame) -> DataFrame:
    """All pairs of windows of equal structure. Quadratic in a group's size: for groups known to be small."""
    held = chunks.where(F.col("struct_hash").isNotNull() & (F.col("struct_hash") != ""))
    a, b = (held.select(F.col("struct_hash"), *[F.col(c).alias(f"{c}_{s}") for c in ("chunk_id", "file_path", "chunk_seq", "start_line", "end_line")]) for s in "ab")
    met = a.join(b, "struct_hash").where(F.struct("file_path_a", "chunk_seq_a") < F.struct("file_path_b", "chunk_seq_b"))
    return met.where((F.col("file_path_a") != F.col("file_path_b")) | (F.abs(F.col("start_line_a") - F.col("start_line_b")) >= 5))


def sliding_clones(files: DataFrame, size: int = 6, min_chars: int = 80) -> DataFrame:
    """``file_path, line_no, other_file, other_line``: for each file its first window of ``size`` trimmed lines, longer than ``min_chars``, that an earlier file (by path) also has; the latest such file counts.

    Windows of one text, which may stand in every file, are split into ranges of paths; the last file of a range is handed to the next one.
    """
    held = lines(files).withColumn("line", trimmed(F.col("line")))
    ahead = Window.partitionBy("file_path").orderBy("line_no").rowsBetween(0, size - 1)
    text = F.array_join(F.collect_list("line").over(ahead), "\n")
    windows = held.withColumns({"_text": text, "_n": F.count("*").over(ahead)}).where(F.col("_n") == size).where(F.length("_text") > min_chars).select("file_path", "line_no", F.sha2("_text", 256).alias("_key"))
    per_file = windows.groupBy("_key", "file_path").agg(F.min("line_no").alias("line_no"))
    held = ranged(per_file, "_key", "file_path")
    before = Window.partitionBy("_key", "_part").orderBy("file_path")
    at = F.struct("file_path", "line_no")
    cuts = held.groupBy("_part").agg(F.min("_key").alias("_first"), F.max("_key").alias("_last"))  # one row for each range
    edges = held.join(F.broadcast(cuts), "_part").where("_key = _first OR _key = _last").groupBy("_key", "_part").agg(F.max(at).alias("_end"))
    carried = edges.select("_key", "_part", F.lag("_end").over(Window.partitionBy("_key").orderBy("_part")).alias("_end"))  # two rows at most for each range
    met = held.withColumn("_prev", F.lag(at).over(before)).join(F.broadcast(carried), ["_key", "_part"], "left").withColumn("_prev", F.coalesce("_prev", "_end")).where("_prev IS NOT NULL")
    met = met.select("file_path", "line_no", F.col("_prev.file_path").alias("other_file"), F.col("_prev.line_no").alias("other_line"))
    return met.groupBy("file_path").agg(F.min(F.struct("line_no", "other_file", "other_line")).alias("m")).select("file_path", "m.line_no", "m.other_file", "m.other_line")


# Metrics ------------------------------------------------------------------------------------------------------------


def totals(files: DataFrame, symbols: DataFrame, communities: DataFrame | None = None) -> DataFrame:
    """One row: files, lines, symbols, mean and largest complexity, communities."""
    one = files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("line_count"), F.lit(0)).cast("long").alias("n_lines"))
    two = symbols.agg(F.count("*").alias("n_symbols"), F.coalesce(F.round(F.avg("complexity"), 2), F.lit(0.0)).alias("avg_complexity"), F.coalesce(F.max("complexity"), F.lit(0)).alias("max_complexity"))
    met = one.crossJoin(two)  # one row each
    return met.crossJoin(communities.agg(F.count_distinct("community_id").alias("n_communities"))) if communities is not None else met  # one row each


def by_language(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("n_files"))


def top_files(files: DataFrame, symbols: DataFrame, limit: int = 10) -> DataFrame:
    held = files.select("file_path").join(symbols, "file_path").groupBy("file_path").agg(F.max("complexity").alias("max_complexity"), F.sum("complexity").alias("total_complexity"))
    return held.orderBy(F.desc("total_complexity"), F.desc("max_complexity"), "file_path").limit(limit)


def rollup(files: DataFrame) -> DataFrame:
    """Files and lines by language and directory, with subtotals."""
    held = files.withColumn("directory", dirname(F.col("file_path")))
    return held.rollup("language", "directory").agg(F.count("*").alias("n_files"), F.sum("line_count").alias("n_lines"))


def health_score(issues: DataFrame) -> DataFrame:
    """One row: 100 less 15, 8 and 3 for each issue of high, medium and other severity, 10 at least."""
    lost = F.sum(F.when(F.col("severity") == "high", 15).when(F.col("severity") == "medium", 8).otherwise(3))
    return issues.agg(F.greatest(F.lit(10), F.lit(100) - F.coalesce(lost, F.lit(0))).cast("long").alias("score"))


def over_thresholds(symbols: DataFrame, complexity: int = 10, size: int = 100, params: int = 4) -> DataFrame:
    """``symbol_id, file_path, category, severity, value`` for each limit that a symbol exceeds; one pass."""
    made = F.array(
        F.when(F.col("complexity") > complexity, F.struct(F.lit("complexity").alias("category"), F.lit("high").alias("severity"), F.col("complexity").cast("long").alias("value"))),
        F.when(F.col("end_line") - F.col("start_line") > size, F.struct(F.lit("size-fn").alias("category"), F.lit("medium").alias("severity"), (F.col("end_line") - F.col("start_line")).cast("long").alias("value"))),
        F.when(F.col("param_count") > params, F.struct(F.lit("params").alias("category"), F.lit("medium").alias("severity"), F.col("param_count").cast("long").alias("value"))),
    )
    return symbols.select("symbol_id", "file_path", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("i")).select("symbol_id", "file_path", "i.category", "i.severity", "i.value")


def async_without_catch(chunks: DataFrame) -> DataFrame:
    """The first window of each file with asynchronous code and neither try nor catch."""
    met = chunks.where(F.contains("content", F.lit("async ")) & ~F.contains("content", F.lit("try")) & ~F.contains("content", F.lit(".catch")))
    return met.groupBy("file_path").agg(F.min("chunk_seq").alias("chunk_seq"))


def dead_exports(symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Exported symbols whose name no import names; default, main, the server file and the command line are left out."""
    names = imports.select(F.explode("imported_names").alias("name")).distinct()
    held = symbols.where("is_exported").where(~F.col("name").isin("default", "main") & ~F.contains("file_path", F.lit("server.ts")) & ~F.contains("file_path", F.lit("cli/")))
    return held.join(names, "name", "left_anti")


def is_test_file(path: Column) -> Column:
    return F.lower(path).rlike(TEST_FILE)


def test_gap(exports: DataFrame, files: DataFrame) -> DataFrame:
    """``file_path, name, tested``: whether any test file has the name in its text. Names are met once each, however many files export them.

    A name of word characters stands in a text if it stands in one of its words, so that such names meet the distinct words
    of all texts; other names meet the texts. Both meet by trigrams (see ``substrings``).
    """
    tests = files.where(is_test_file(F.col("file_path"))).select("content")
    wanted = exports.where(~is_test_file(F.col("file_path")) & (F.col("name") != "") & (F.col("name") != "default")).select("file_path", "name")
    names = written(wanted.select("name").distinct(), "names")
    words = written(tests.select(F.explode(F.array_distinct(F.split("content", f"[^{WORD}]+"))).alias("word")).where("word <> ''").distinct(), "words")
    plain = F.col("name").rlike(f"^[{WORD}]+$")
    whole = names.join(words.select(F.col("word").alias("name")), "name", "left_semi")
    rest = names.where(plain).join(words.select(F.col("word").alias("name")), "name", "left_anti")
    found = [whole, contained(words, "word", rest, "name").select(F.col("needle").alias("name")).distinct()]
    if not (odd := names.where(~plain)).isEmpty():
        found.append(contained(tests, "content", odd, "name").select(F.col("needle").alias("name")).distinct())
    met = functools.reduce(DataFrame.union, found).withColumn("tested", F.lit(True))
    return wanted.join(met, "name", "left").select("file_path", "name", F.coalesce("tested", F.lit(False)).alias("tested"))


def coverage(gap: DataFrame) -> DataFrame:
    """One row: exports, tested ones and their share in percent, 100 without exports."""
    n, t = F.count("*"), F.count_if("tested")
    return gap.agg(n.alias("total"), t.alias("tested"), (n - t).alias("untested"), F.when(n > 0, F.round(100 * t / n)).otherwise(100).cast("long").alias("percent"))


# Boundaries and impact ----------------------------------------------------------------------------------------------


def scope_violations(imports: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Imports that cross a boundary: the file holds ``from_part`` and the import ``to_part``. Distinct targets meet the parts by trigrams."""
    if rules is None:
        rules = imports.sparkSession.createDataFrame(list(DEFAULT_SCOPE_RULES), schemas.SCOPE_RULES)
    slashed = lambda c: F.regexp_replace(c, r"\\", "/")
    held = imports.select("file_path", "target", slashed("target").alias("_to"))
    met = contained(held, "_to", rules, "to_part").select(F.col("needle").alias("to_part"), F.col("text").alias("_to"))
    told = held.join(met.join(rules, "to_part"), "_to").where(F.contains(slashed("file_path"), F.col("from_part")))
    return told.select("file_path", F.col("target").alias("imported"), "from_part", "to_part", "severity", "message")


def impact_pairs(changed: DataFrame, imports: DataFrame) -> DataFrame:
    """``file_path, downstream``, one row for each changed file and file that imports it: an import has its stem, or its path has the import."""
    one = changed.select("file_path").distinct().withColumn("_stem", stem(F.col("file_path")))
    held = imports.select(F.col("file_path").alias("downstream"), "specifier").distinct()
    by_stem = contained(held, "specifier", one, "_stem").select(F.col("needle").alias("_stem"), F.col("text").alias("specifier")).join(one, "_stem").select("file_path", "specifier")
    by_path = contained(one, "file_path", held, "specifier").select(F.col("text").alias("file_path"), F.col("needle").alias("specifier"))
    return by_stem.union(by_path).join(held, "specifier").where("downstream <> file_path").select("file_path", "downstream").distinct()


def impact(changed: DataFrame, imports: DataFrame) -> DataFrame:
    """``file_path, downstream``: the files that import a changed one, as an array; changed files stay without any. ``impact_pairs`` gives rows."""
    found = impact_pairs(changed, imports).groupBy("file_path").agg(F.array_sort(F.collect_list("downstream")).alias("downstream"))
    return changed.select("file_path").distinct().join(found, "file_path", "left").select("file_path", F.coalesce("downstream", F.array().cast("array<string>")).alias("downstream"))


def findings_of(findings: DataFrame, changed: DataFrame) -> DataFrame:
    return findings.join(changed.select(F.col("file_path").alias("file")).distinct(), "file", "left_semi")


def overview(files: DataFrame, imports: DataFrame, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """(facts, chart edges): whether there is a server, how many TypeScript files; for the first files the first other one whose path has an import of theirs."""
    facts = files.agg(F.coalesce(F.bool_or(F.col("file_path") == "server.ts"), F.lit(False)).alias("full_stack"), F.count_if(F.col("file_path").rlike(r"\.tsx?$")).alias("n_typescript"), F.count("*").alias("n_files"))
    few = files.select("file_path").orderBy("file_path").limit(most)
    others = few.select(F.col("file_path").alias("other"))
    held = imports.join(few, "file_path", "left_semi").select("file_path", "specifier", "parse_seq")
    met = held.join(F.broadcast(others), F.contains("other", "specifier") & (F.col("other") != F.col("file_path")))  # ten rows
    return facts, met.groupBy("file_path", "specifier", "parse_seq").agg(F.min("other").alias("target"))


def buckets(paths: DataFrame, groups: dict[str, str]) -> DataFrame:
    """``bucket, n``: paths by overlapping groups, each a pattern; empty groups are left out."""
    labels = F.array(*[F.when(F.col("file_path").rlike(rx), F.lit(name)) for name, rx in groups.items()])
    return paths.select(F.explode(F.filter(labels, lambda x: x.isNotNull())).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def incremental_diff(old: DataFrame, new: DataFrame, key: str = "file_path", value: str = "sha256") -> DataFrame:
    """``key, status``: added, changed, deleted or unchanged."""
    a, b = old.select(key, F.col(value).alias("_old"), F.lit(True).alias("_in_old")), new.select(key, F.col(value).alias("_new"), F.lit(True).alias("_in_new"))
    status = F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "deleted").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("changed")
    return a.join(b, key, "full").select(key, status.alias("status"))




def total_downstream(impacts: DataFrame) -> DataFrame:
    """One row: how many downstream files all changed files have together."""
    return impacts.agg(F.coalesce(F.sum(F.size("downstream")), F.lit(0)).cast("long").alias("total"))
