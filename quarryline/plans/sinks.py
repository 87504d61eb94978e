"""Reports: JSON, CSV, HTML, SARIF, OpenAPI, Mermaid and DOT."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.paths import node_id
from quarryline.operators.graph import cycle_edges
from quarryline.sources import store


def csv_lines(df: DataFrame) -> DataFrame:
    """``line``: a header and one line for each row, every cell quoted as JSON, null as an empty string. For streams of rows use ``df.write.csv``."""
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    cell = lambda c, t: F.coalesce(quoted(c) if t == "string" else F.col(c).cast("string"), F.lit('""'))
    row = F.concat_ws(",", *[F.when(F.col(c).isNull(), '""').otherwise(cell(c, t)) for c, t in df.dtypes])
    header = df.sparkSession.range(1).select(F.lit(0).alias("_k"), F.lit(",".join(df.columns)).alias("line"))
    return header.union(df.select(F.lit(1), row)).orderBy("_k").select("line")


def write(df: DataFrame, path: str, kind: str) -> None:
    """A report in a folder, in parallel: json, csv or text lines."""
    if kind == "json":
        df.write.mode("overwrite").json(path)
    elif kind == "csv":
        df.write.mode("overwrite").option("header", "true").csv(path)
    elif kind == "text":
        df.write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown kind of report: {kind}")


def sarif(findings: DataFrame) -> DataFrame:
    """One row: SARIF 2.1.0. A report is one document; keep it to what a person reads with ``at_least``."""
    level = F.when(F.col("severity").isin("critical", "high"), "error").otherwise("warning")
    region = F.when(F.col("line").isNotNull(), F.struct(F.col("line").alias("startLine")))
    result = F.struct(
        F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"),
        F.array(F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))).alias("locations"),
        F.when(F.coalesce("remediation", F.lit("")) != "", F.array(F.struct(F.struct(F.col("remediation").alias("text")).alias("description")))).alias("fixes"),
    )
    rules = F.transform(F.array_sort(F.collect_set("rule")), lambda r: F.struct(r.alias("id")))
    results = F.transform(F.array_sort(F.collect_list(F.struct("file", "line", "rule", result.alias("r")))), lambda x: x["r"])
    run = F.struct(F.struct(F.struct(F.lit("quarryline").alias("name"), rules.alias("rules")).alias("driver")).alias("tool"), results.alias("results"))
    return findings.agg(F.to_json(F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("document"))


def openapi(routes: DataFrame, title: str = "API") -> DataFrame:
    """One row: an OpenAPI 3.0 document of routes ``method, route``."""
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    done = F.struct(F.concat_ws(" ", "method", "route").alias("summary"), F.create_map(F.lit("200"), F.struct(F.lit("OK").alias("description"))).alias("responses"))
    member = F.concat(quoted(F.lower("method")), F.lit(":"), F.to_json(done))
    joined = lambda c: F.array_join(F.array_sort(F.collect_list(c)), ",")
    paths = routes.select("method", "route").distinct().groupBy("route").agg(joined(member).alias("ops"))
    body = joined(F.concat(quoted("route"), F.lit(":{"), "ops", F.lit("}")))
    head = '{"openapi":"3.0.0","info":{"title":"%s","version":"1.0.0"},"paths":{' % title.replace('"', "'")
    return paths.agg(F.concat(F.lit(head), body, F.lit("}}")).alias("document"))


def map_lines(edges: DataFrame, nodes: DataFrame, communities: DataFrame | None = None, found_cycles: DataFrame | None = None, kind: str = "mermaid") -> DataFrame:
    """``section, seq, line`` of a graph text; ordered by section and seq it is the document. Groups are communities, cyclic edges and nodes are marked."""
    mermaid = kind == "mermaid"
    spark = edges.sparkSession
    group = nodes.select("id").join(communities.select("id", "community"), "id", "left") if communities is not None else nodes.select("id", F.lit(None).cast("string").alias("community"))
    group = group.select("id", F.coalesce(F.col("community").cast("string"), F.lit("unclustered")).alias("community"), node_id(F.col("id").cast("string")).alias("name"))
    heads = group.select("community").distinct()
    head = F.concat(F.lit("  subgraph "), node_id(F.col("community")), F.lit(' ["'), "community", F.lit('"]')) if mermaid else F.concat(F.lit('  subgraph "cluster_'), "community", F.lit('" { label="'), "community", F.lit('";'))
    node = F.concat(F.lit("    "), "name", F.lit('["'), F.col("id").cast("string"), F.lit('"]')) if mermaid else F.concat(F.lit('    "'), F.col("id").cast("string"), F.lit('";'))
    marks = cycle_edges(found_cycles).withColumn("cyclic", F.lit(True)) if found_cycles is not None else None
    shown = edges.select("src", "dst").distinct().join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    shown = shown.join(marks, ["src", "dst"], "left") if marks is not None else shown.withColumn("cyclic", F.lit(False))
    shown = shown.select("src", "dst", F.coalesce("cyclic", F.lit(False)).alias("cyclic"))
    a, b = F.col("src").cast("string"), F.col("dst").cast("string")
    edge = F.concat(F.lit("  "), node_id(a), F.when(F.col("cyclic"), " -->|cycle| ").otherwise(" --> "), node_id(b)) if mermaid else F.concat(F.lit('  "'), a, F.lit('" -> "'), b, F.when(F.col("cyclic"), '" [color=red];').otherwise('";'))
    key = lambda *c: F.to_json(F.struct(*c))
    told = spark.range(1).select(F.lit(0).alias("section"), F.lit("").alias("seq"), F.lit("graph TD" if mermaid else "digraph G {").alias("line"))
    told = told.union(heads.select(F.lit(1), F.concat("community", F.lit(" 0")), head)).union(group.select(F.lit(1), F.concat("community", F.lit(" 1"), F.col("id").cast("string")), node)).union(heads.select(F.lit(1), F.concat("community", F.lit(" 2")), F.lit("  end" if mermaid else "  }")))
    told = told.union(shown.select(F.lit(2), key("src", "dst"), edge))
    if marks is not None:
        bad = marks.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(nodes.select("id"), "id", "left_semi")
        name = node_id(F.col("id").cast("string"))
        told = told.union(bad.select(F.lit(3), F.col("id").cast("string"), F.concat(F.lit("  style "), name, F.lit(" stroke:#ff0000")) if mermaid else F.concat(F.lit('  "'), F.col("id").cast("string"), F.lit('" [color=red];'))))
        if mermaid:  # the ordinal of an edge among all, in the order of the document
            ranked = store.numbered(shown.withColumn("_key", key("src", "dst")), "n", "_key").where("cyclic")
            told = told.union(ranked.select(F.lit(4), F.lpad(F.col("n").cast("string"), 12, "0"), F.concat(F.lit("  linkStyle "), F.col("n").cast("string"), F.lit(" stroke:#ff0000"))))
    return told if mermaid else told.union(spark.range(1).select(F.lit(9), F.lit(""), F.lit("}")))


def trace_lines(steps: DataFrame, kind: str = "mermaid") -> DataFrame:
    """``seq, line``: a node for each step of a trace and an edge to the next one."""
    after = F.lead("step").over(Window.orderBy("step"))  # a trace is bounded by its depth
    held = steps.withColumn("_next", after)
    q = F.regexp_replace("name", '"', "'")
    node = F.concat(F.lit("  s"), "step", F.lit('["'), q, F.lit('"]')) if kind == "mermaid" else F.concat(F.lit("  s"), "step", F.lit(' [label="'), q, F.lit('"];'))
    arrow = F.lit(" --> s") if kind == "mermaid" else F.lit(" -> s")
    return held.select((F.col("step") * 2).alias("seq"), node.alias("line")).union(held.where("_next IS NOT NULL").select(F.col("step") * 2 + 1, F.concat(F.lit("  s"), "step", arrow, "_next")))


def html_report(findings: DataFrame, title: str = "Findings", most: int = 1000) -> str:
    """A page with the worst findings, up to ``most``: a report is for reading, so this limit is its feature."""
    from quarryline.operators.rules import severity_rank

    columns = ["severity", "category", "rule", "file", "line", "message", "remediation"]
    rows = findings.orderBy(severity_rank(F.col("severity")).desc(), "file", "line").select(*columns).limit(most).collect()
    cells = lambda r, t: "".join(f"<{t}>{html.escape('' if v is None else str(v))}</{t}>" for v in r)
    body = "".join(f"<tr>{cells(r, 'td')}</tr>" for r in rows)
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table><tr>{cells(columns, 'th')}</tr>{body}</table></body></html>"
