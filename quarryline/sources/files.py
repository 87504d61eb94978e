"""Source trees, ignore files, manifests, tool configurations, scanner results, version control."""

from __future__ import annotations

import os
import re
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions.paths import extension, language
from quarryline.sources.history import git_history, git_lines

# What scans leave out, and limits of size.
DEFAULT_IGNORES = ("node_modules", "dist", "build", ".git", "package-lock.json", "yarn.lock", ".env", "tsconfig.tsbuildinfo")
BINARY_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".ico", ".pdf", ".zip", ".woff", ".woff2")
INDEX_LIMIT, SECURITY_LIMIT, TOOL_LIMIT, LISTING_LIMIT = 200_000, 500_000, 24_000, 50


def ignore_regex(patterns: list[str]) -> str | None:
    """One expression for the lines of an ignore file, tested on paths relative to the root; ``!`` lines are the caller's to keep apart."""
    made = []
    for raw in patterns:
        p = raw.strip()
        if not p or p.startswith("#") or p.startswith("!"):
            continue
        anchored, folder = p.startswith("/") or "/" in p.strip("/"), p.endswith("/")
        body = ""
        k, p = 0, p.strip("/")
        while k < len(p):
            if p[k : k + 3] == "**/":
                body, k = body + r"(?:.*/)?", k + 3
            elif p[k : k + 2] == "**":
                body, k = body + ".*", k + 2
            elif p[k] == "*":
                body, k = body + "[^/]*", k + 1
            elif p[k] == "?":
                body, k = body + "[^/]", k + 1
            else:
                body, k = body + re.sub(r"([\\.^$|+(){}\[\]])", r"\\\1", p[k]), k + 1
        made.append(("^" if anchored else "(?:^|/)") + body + ("/" if folder else "(?:/|$)"))
    return "|".join(made) or None


def not_ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a path stays: ignored by no line, or taken back by a ``!`` line."""
    out, back = ignore_regex([*DEFAULT_IGNORES, *patterns]), ignore_regex([p.strip()[1:] for p in patterns if p.strip().startswith("!")])
    kept = ~path.rlike(out)
    return kept | path.rlike(back) if back else kept


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """``file_path`` (relative to the root)``, content, length``: all files below, read in parallel; unreadable ones are left out.

    Spark's own readers leave out names that begin with a dot or an underscore. On a folder that executors can open they
    are listed apart and read in tasks of their own; in other stores they stay out.
    """
    base = re.sub(r"^file:/*", "/", root).rstrip("/")
    plain = F.regexp_replace("path", "^file:/*", "/")
    held = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(root)
    told = held.select(F.when(plain.startswith(base + "/"), F.substring(plain, len(base) + 2, 1 << 30)).otherwise(plain).alias("file_path"), F.decode("content", "UTF-8").alias("content"), "length")
    hidden = hidden_files(base) if os.path.isdir(base) else []
    if not hidden:
        return told

    def batches(source):
        import pyarrow as pa

        for batch in source:
            names, texts, lengths = [], [], []
            for name in batch.column("file_path").to_pylist():
                try:
                    with open(os.path.join(base, name), "rb") as f:
                        data = f.read()
                except OSError:
                    continue
                names.append(name)
                texts.append(data.decode("utf-8", "replace"))
                lengths.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string()), pa.array(lengths, pa.int64())], ["file_path", "content", "length"])

    paths = spark.createDataFrame([(h,) for h in hidden], "file_path string")
    return told.unionByName(paths.mapInArrow(batches, "file_path string, content string, length long"))


def hidden_files(base: str) -> list[str]:
    """Paths, relative to ``base``, with a part that begins with a dot or an underscore; what scans always leave out is not walked."""
    found = []
    for folder, below, names in os.walk(base):
        below[:] = [d for d in below if d not in DEFAULT_IGNORES]
        rel = os.path.relpath(folder, base)
        for name in names:
            path = name if rel == "." else f"{rel}/{name}".replace(os.sep, "/")
            if any(part[0] in "._" for part in path.split("/")) and not os.path.islink(os.path.join(folder, name)):
                found.append(path)
    return sorted(found)


def scan(spark: SparkSession, root: str, patterns: list[str] | None = None, limit: int = INDEX_LIMIT) -> DataFrame:
    """``file_path, content, language``: known languages, not ignored, smaller than ``limit`` bytes."""
    held = read_tree(spark, root)
    return select_sources(held, patterns or [], limit)


def select_sources(tree: DataFrame, patterns: list[str], limit: int = INDEX_LIMIT) -> DataFrame:
    held = tree.where(F.col("length") < limit).where(not_ignored(F.col("file_path"), patterns)).withColumn("language", language(F.col("file_path")))
    return held.where("language IS NOT NULL").select("file_path", "content", "language")


def security_files(tree: DataFrame, ignores: list[str] | None = None, rule: str | None = None, limit: int = SECURITY_LIMIT) -> DataFrame:
    """Files for security scans. Ignore entries are parts of paths; an entry ``part:rule`` holds only in a run of that rule."""
    held = tree.where(F.col("length") < limit).where(~F.col("file_path").rlike("node_modules/|dist/|\\.git/"))
    for entry in ignores or []:
        part, _, only = entry.strip().partition(":")
        if part and not part.startswith("#") and (not only or only == rule):
            held = held.where(~F.contains("file_path", F.lit(part)))
    return held.select("file_path", "content")


def grep_files(tree: DataFrame, excluded: tuple[str, ...] = ("node_modules", "dist", ".git", "build")) -> DataFrame:
    """Files for text search: none below an excluded folder, none of a binary kind."""
    parts = F.array(*[F.lit(e) for e in excluded])
    return tree.where(~F.arrays_overlap(F.split("file_path", "/"), parts) & ~extension(F.col("file_path")).isin(*BINARY_EXTENSIONS)).select("file_path", "content")


def listing(tree: DataFrame, limit: int | None = LISTING_LIMIT) -> DataFrame:
    """``file_path, length, n_lines`` in order of paths; the limit is that of the listing tool."""
    held = tree.select("file_path", "length", F.size(F.split("content", "\n", -1)).alias("n_lines")).orderBy("file_path")
    return held.limit(limit) if limit else held


def excerpt(tree: DataFrame, path: str, limit: int = TOOL_LIMIT) -> DataFrame:
    """One file's text, up to the limit of the reading tool."""
    return tree.where(F.col("file_path") == path).select("file_path", F.substring("content", 1, limit).alias("content"))


def dependencies(manifests: DataFrame) -> DataFrame:
    """``file_path, package, version, dev``: dependencies of package manifests; those for development win. Broken manifests give none."""
    kind = "dependencies map<string,string>, devDependencies map<string,string>"
    told = manifests.select("file_path", F.from_json("content", kind).alias("j"))
    part = lambda field, dev: told.select("file_path", F.explode(f"j.{field}").alias("package", "version"), F.lit(dev).alias("dev"))
    both = part("dependencies", False).unionByName(part("devDependencies", True))
    return both.groupBy("file_path", "package").agg(F.max_by("version", "dev").alias("version"), F.max("dev").alias("dev"))


def tool_configs(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tools, servers) of tool-server configurations: capabilities and restrictions by tool, addresses by server."""
    kind = "tools map<string,struct<capabilities:array<string>,restrictions:struct<allowedPaths:array<string>,allowedDomains:array<string>>>>, servers map<string,struct<url:string>>"
    held = files.where(F.col("file_path").rlike(r"\.mcp\.json|mcp\.json|mcp-servers|\.mcp/")).select("file_path", F.from_json("content", kind).alias("j"))
    tools = held.select("file_path", F.explode("j.tools").alias("tool", "t")).select("file_path", "tool", F.col("t.capabilities").alias("capabilities"), F.col("t.restrictions.allowedPaths").alias("allowed_paths"), F.col("t.restrictions.allowedDomains").alias("allowed_domains"))
    return tools, held.select("file_path", F.explode("j.servers").alias("server", "s")).select("file_path", "server", F.col("s.url").alias("url"))


def scanner_results(reports: DataFrame, kind: str) -> DataFrame:
    """Rows ``rule, category, severity, file, message, remediation, cve_id, source`` of reports (column ``content``) of three scanners: matches, results or findings."""
    from quarryline.operators.rules import external_severity

    if kind == "matches":
        j = F.from_json("content", "matches array<struct<vulnerability:struct<id:string,severity:string,description:string>,artifact:struct<name:string,locations:array<struct<path:string>>>>>")
        m = reports.select(F.explode(j["matches"]).alias("m"))
        row = ("m.vulnerability.id", "deps", "m.vulnerability.severity", F.coalesce(F.try_element_at(F.col("m.artifact.locations.path"), F.lit(1)), F.lit("package.json")), F.concat_ws(" in ", F.coalesce("m.vulnerability.description", "m.vulnerability.id"), "m.artifact.name"), F.concat(F.lit("Upgrade "), "m.artifact.name"), "m.vulnerability.id")
    elif kind == "results":
        j = F.from_json("content", "Results array<struct<Target:string,Vulnerabilities:array<struct<VulnerabilityID:string,Severity:string,Title:string,PkgName:string,FixedVersion:string>>>>")
        m = reports.select(F.explode(j["Results"]).alias("r")).select("r.Target", F.explode("r.Vulnerabilities").alias("m"))
        row = ("m.VulnerabilityID", "deps", "m.Severity", F.coalesce("Target", F.lit("package.json")), F.concat_ws(" in ", F.coalesce("m.Title", "m.VulnerabilityID"), "m.PkgName"), F.concat(F.lit("Upgrade to version "), "m.FixedVersion"), "m.VulnerabilityID")
    elif kind == "findings":
        j = F.from_json("content", "findings array<struct<rule:string,severity:string,file:string,message:string,remediation:string>>")
        m = reports.select(F.explode(j["findings"]).alias("m"))
        row = ("m.rule", "ai", "m.severity", F.coalesce("m.file", F.lit(".cursorrules")), F.col("m.message"), F.col("m.remediation"), None)
    else:
        raise ValueError(f"unknown kind of report: {kind}")
    rule, category, severity, file, message, remediation, cve = row
    return m.select(F.col(rule).alias("rule"), F.lit(category).alias("category"), external_severity(F.col(severity)).alias("severity"), file.alias("file"), message.alias("message"), remediation.alias("remediation"), (F.col(cve) if cve else F.lit(None).cast("string")).alias("cve_id"), F.lit(kind).alias("source"))


# Version control ----------------------------------------------------------------------------------------------------


def _git(root: str, *args: str) -> list[str]:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True)
    return done.stdout.split("\n") if done.returncode == 0 else []


def git_log(spark: SparkSession, root: str) -> DataFrame:
    """``line_no, line`` of the log with names, read in ranges of commits by tasks; empty without history. Logs at rest are read with ``spark.read.text``."""
    return git_lines(git_history(spark, root))


def git_changed(spark: SparkSession, root: str) -> DataFrame:
    """``file_path`` of changes, staged or not, each once."""
    names = [*_git(root, "diff", "--name-only"), *_git(root, "diff", "--cached", "--name-only")]
    return changed_files(spark.createDataFrame([(n,) for n in names], "file_path string"))


def changed_files(names: DataFrame) -> DataFrame:
    return names.select(F.trim("file_path").alias("file_path")).where("file_path <> ''").distinct()
