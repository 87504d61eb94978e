"""The verbs of the engine as compositions of its operators, on an index or on files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions.paths import basename
from quarryline.operators import graph, mining, parse, rules
from quarryline.operators import search as S
from quarryline.plans import sinks
from quarryline.plans.index import Index, with_communities
from quarryline.sources import files as sources


def search(index: Index, query: str, **options) -> DataFrame:
    """Ranked windows with their symbol; qualifiers stand in the query or in the options of ``operators.search.search``."""
    return S.search(index.chunks, index.terms if index.terms is not None else S.terms(index.chunks), query, symbols=index.symbols, files=index.contents, **options)


def grep(files: DataFrame, pattern: str) -> DataFrame:
    from quarryline.functions.text import lines, trimmed

    return S.grep(lines(files), pattern).select("file_path", "line_no", trimmed(F.col("line")).alias("line"))


def context(index: Index, query: str, budget: int = 16_000, limit: int = 50) -> DataFrame:
    """The best windows for a question that fit a budget of tokens."""
    return S.pack_context(search(index, query, limit=limit), order=[F.desc("score"), "file_path", "chunk_seq"], budget=budget)


def trace_intent(text: str, direction: str = "down") -> dict:
    """What a trace request asks for: ``{"from": a, "to": b}`` of a flow, else ``{"symbol": s, "direction": d}``."""
    if m := re.search(r"flow\s+from\s+(\S+)\s+to\s+(\S+)", text, re.I):
        return {"from": m[1], "to": m[2]}
    if re.search(r"caller|who\s*calls|calls\s*to", text, re.I):
        direction = "up"
    lead = r"^(trace\s+callers?\s+of|trace\s+callees?\s+of|trace\s+calls?\s+of|trace\s+who\s+calls|trace|callers\s+of|callees\s+of|who\s+calls)\s+"
    return {"symbol": re.sub(lead, "", text.strip(), flags=re.I).strip(), "direction": direction.lower()}


def trace(index: Index, text: str, *, direction: str = "down", depth: int = 3) -> DataFrame:
    """Steps of a call tree, or of a shortest call path for "flow from a to b", with the beginning of their code."""
    calls = graph.call_graph(index.edges, index.symbols)
    asked = trace_intent(text, direction)
    if "from" in asked:
        a, b = (graph.resolve_symbol(index.symbols, asked[k]) for k in ("from", "to"))
        path = graph.shortest_path(calls, a, b).join(index.symbols.withColumnRenamed("symbol_id", "id"), "id", "left")
        return path.select(
            (F.col("step") + 1).alias("step"), F.col("step").alias("depth"), F.col("id").alias("node"), F.coalesce("name", "id").alias("name"), F.coalesce("file_path", F.lit("external")).alias("file_path"), F.coalesce("start_line", F.lit(1)).alias("start_line"),
            F.coalesce("end_line", F.lit(1)).alias("end_line"), F.coalesce("kind", F.lit("external")).alias("kind"), F.lit(False).alias("is_cycle"),
        )
    return graph.trace(calls, index.symbols, graph.resolve_symbol(index.symbols, asked["symbol"]), direction=asked["direction"], depth=depth or 3)


def doctor(index: Index, *, complexity: int = 10, size: int = 100, params: int = 4, longest_cycle: int = 4, severity: str | None = None, category: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(issues, score): limits of symbols, asynchronous code without catch, import cycles, exports that nothing imports."""
    columns = lambda df, kind, level, what: df.select(F.lit(kind).alias("category"), F.lit(level).alias("severity"), what.alias("subject"), F.array("file_path").alias("files"))
    issues = mining.over_thresholds(index.symbols, complexity, size, params).select("category", "severity", F.col("symbol_id").alias("subject"), F.array("file_path").alias("files"))
    issues = issues.unionByName(columns(mining.async_without_catch(index.chunks), "async-no-catch", "high", F.col("file_path")))
    found = graph.cycles(graph.import_graph(index.imports), longest_cycle).unionByName(graph.self_imports(index.imports).select(F.array("file_path", "file_path").alias("cycle")))
    issues = issues.unionByName(found.select(F.lit("circular-deps").alias("category"), F.lit("high").alias("severity"), F.array_join("cycle", " -> ").alias("subject"), F.array_distinct("cycle").alias("files")))
    issues = issues.unionByName(columns(mining.dead_exports(index.symbols, index.imports), "dead-export", "medium", F.col("symbol_id")))
    score = mining.health_score(issues)
    if severity:
        issues = issues.where(F.lower("severity") == severity.lower())
    if category:
        issues = issues.where(F.contains("category", F.lit(category)))
    return issues, score


def code_map(index: Index, kind: str = "mermaid", depth: int | None = None, longest_cycle: int = 4) -> DataFrame:
    edges = graph.import_graph(index.imports, index.edges)
    own = index.files.select(F.col("file_path").alias("id"))
    groups = with_communities(index).communities.select(F.col("file_path").alias("id"), F.col("community_id").alias("community"))
    return sinks.map_lines(edges, graph.map_nodes(edges, graph.vertices(edges, own), depth), groups, graph.cycles(edges, longest_cycle), kind)


def dead(index: Index) -> dict[str, DataFrame]:
    return graph.dead_code(index.contents, index.symbols, index.imports, index.edges)


def clones(index: Index, min_lines: int = 6) -> DataFrame:
    return mining.clones(index.chunks, min_lines)


def security(files: DataFrame, **options) -> DataFrame:
    return rules.security(files, **options)


def hotspots(index: Index) -> DataFrame:
    churned = index.git_churn if index.git_churn is not None else mining.stand_in_churn(index.files).limit(0)
    return mining.hotspots(index.files, churned)


def coupled(index: Index, file: str) -> DataFrame:
    return mining.coupled(index.cochange, file)


def api(files: DataFrame) -> DataFrame:
    return parse.routes(files)


def deps(files: DataFrame) -> DataFrame:
    return sources.dependencies(files.where(basename(F.col("file_path")) == "package.json"))


def scope(index: Index, boundary: DataFrame | None = None) -> DataFrame:
    return mining.scope_violations(index.imports, boundary)


def benchmark(files: DataFrame) -> DataFrame:
    return rules.performance(files)


def test_gap(index: Index) -> tuple[DataFrame, DataFrame]:
    gap = mining.test_gap(index.symbols.where("is_exported").select("file_path", "name"), index.contents)
    return gap, mining.coverage(gap)


def diff(index: Index, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(impact, findings) of changed files."""
    return mining.impact(changed, index.imports), mining.findings_of(rules.security(index.contents), changed)


def stats(index: Index) -> dict[str, DataFrame]:
    communities = with_communities(index).communities
    return {"totals": mining.totals(index.files, index.symbols, communities), "languages": mining.by_language(index.files), "top_files": mining.top_files(index.files, index.symbols), "rollup": mining.rollup(index.files)}


def explain(index: Index) -> tuple[DataFrame, DataFrame]:
    return mining.overview(index.files, index.imports)
