"""The catalogue: one query for each operator, on the driver's tables, and its DuckDB SQL.

The tables hold prose and orders rather than code, so each query projects them onto what its operator reads: documents
are files, orders are commits, parts and customers are files and modules.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline import code_queries
from quarryline.functions import embed, paths, text
from quarryline.operators import chunks, graph, link, mining, parse, rules, search
from quarryline.plans import sinks
from quarryline.sources import files as sources
from quarryline.sources import store
from quarryline.streaming import watch

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files."""
    return table(spark, d, "documents").select(F.concat_ws("/", "source", "doc_id").alias("file_path"), F.col("text").alias("content"), F.col("lang").alias("language"))


CORPUS = "corpus AS (SELECT concat(source, '/', doc_id) AS file_path, text AS content, lang AS language FROM documents)"
LINES = CORPUS + ", ls AS (SELECT file_path, string_split(content, chr(10)) AS l FROM corpus), lines AS (SELECT file_path, CAST(unnest(range(1, len(l) + 1)) AS INT) AS line_no, unnest(l) AS line, CAST(len(l) AS INT) AS n_lines FROM ls)"
TOKENS_OF = r"list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[^a-zA-Z0-9\s]', ' ', 'g')), '\s+'), lambda t: length(t) >= 2 AND t NOT IN ('the','and','for','from','import','export','return'))"


def windows_sql(size: int, overlap: int) -> str:
    stride = size - overlap
    return f"""{LINES}, wins AS (SELECT file_path, l, unnest(range(0, greatest(1, CAST(ceil((len(l) - {overlap}) / {stride}.0) AS INT)))) AS k FROM ls),
chunks AS (SELECT concat(file_path, '#', k + 1) AS chunk_id, file_path, CAST(k + 1 AS INT) AS chunk_seq, CAST(k * {stride} + 1 AS INT) AS start_line, CAST(least(k * {stride} + {size}, len(l)) AS INT) AS end_line, array_to_string(l[k * {stride} + 1:k * {stride} + {size}], chr(10)) AS content FROM wins)"""


# Text ---------------------------------------------------------------------------------------------------------------


@query(f"WITH {LINES} SELECT file_path, count(*) AS n_lines, sum(length(line)) AS n_chars, max(line_no) AS last_line FROM lines GROUP BY file_path")
def line_explode(spark, d):
    return text.lines(corpus(spark, d)).groupBy("file_path").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"), F.max("line_no").alias("last_line"))


@query(f"WITH {windows_sql(40, 8)} SELECT chunk_id, file_path, chunk_seq, start_line, end_line, sha256(content) AS hash FROM chunks")
def chunk_windows(spark, d):
    return chunks.windows(corpus(spark, d)).select("chunk_id", "file_path", "chunk_seq", "start_line", "end_line", F.sha2("content", 256).alias("hash"))


@query(f"WITH {windows_sql(8, 2)} SELECT chunk_id, file_path, chunk_seq, start_line, end_line, sha256(content) AS hash FROM chunks")
def chunk_windows_small(spark, d):
    return chunks.windows(corpus(spark, d), 8, 2).select("chunk_id", "file_path", "chunk_seq", "start_line", "end_line", F.sha2("content", 256).alias("hash"))


_TAG_CASE = " ".join(
    f"WHEN file_path {'=' if only else '<>'} 'server.ts' AND ({' OR '.join(f'contains(content, {chr(39)}{w}{chr(39)})' for w in words)}) THEN '{'|'.join((chunks.BASE_TAG, *tags))}'" for only, words, tags, _ in chunks.TAGS
)


@query(f"WITH {windows_sql(40, 8)} SELECT chunk_id, CASE {_TAG_CASE} ELSE '{chunks.BASE_TAG}' END AS tags FROM chunks")
def chunk_tags(spark, d):
    held = chunks.windows(corpus(spark, d))
    return held.select("chunk_id", F.array_join(chunks.intent_tags(F.col("file_path"), F.col("content")), "|").alias("tags"))


@query(f"WITH {CORPUS}, t AS (SELECT file_path, unnest({TOKENS_OF.format('content')}) AS term FROM corpus) SELECT file_path, term, count(*) AS tf FROM t GROUP BY ALL")
def token_tf(spark, d):
    return corpus(spark, d).select("file_path", F.explode(text.tokens(F.col("content"))).alias("term")).groupBy("file_path", "term").agg(F.count("*").alias("tf"))


@query(f"WITH {windows_sql(40, 8)}, t AS (SELECT DISTINCT chunk_id, unnest({TOKENS_OF.format('content')}) AS term FROM chunks) SELECT term, count(*) AS df FROM t GROUP BY term")
def term_df(spark, d):
    return search.document_frequencies(search.terms(chunks.windows(corpus(spark, d))))


@query(f"WITH {CORPUS} SELECT file_path, sha256(content) AS sha256, CAST(len(string_split(content, chr(10))) AS INT) AS line_count, CAST(ceil(length(content) / 4.0) AS BIGINT) AS tokens FROM corpus")
def file_hashes(spark, d):
    return corpus(spark, d).select("file_path", text.content_hash(F.col("content")).alias("sha256"), text.line_count(F.col("content")).alias("line_count"), text.token_estimate(F.col("content")).alias("tokens"))


@query(f"WITH {CORPUS} SELECT sha256(content) AS sha256, count(*) AS n FROM corpus GROUP BY 1 HAVING count(*) > 1")
def content_hash_dups(spark, d):
    return mining.hash_groups(corpus(spark, d).select(F.sha2("content", 256).alias("sha256")), "sha256")


@query()
def struct_hash_clones(spark, d):
    return mining.clones(chunks.chunks(corpus(spark, d)), min_lines=1)


@query(
    f"""WITH {windows_sql(40, 8)}, k AS (SELECT *, sha256(content) AS h FROM chunks), f AS (SELECT h, count(*) AS n, min(struct_pack(p := file_path, s := start_line)) AS a FROM k GROUP BY h HAVING count(*) > 1)
SELECT h AS struct_hash, a.p AS file_a, a.s AS start_a, file_path AS file_b, start_line AS start_b, n FROM k JOIN f USING (h) WHERE file_path <> a.p OR abs(start_line - a.s) >= 5"""
)
def exact_clones(spark, d):
    held = chunks.windows(corpus(spark, d)).withColumn("struct_hash", F.sha2("content", 256))
    return mining.clones(held, min_lines=1).select("struct_hash", "file_a", "start_a", "file_b", "start_b", "n")


@query(
    f"""WITH {LINES}, t AS (SELECT file_path, line_no, trim(line) || chr(10) || trim(lead(line) OVER (PARTITION BY file_path ORDER BY line_no)) AS w FROM lines),
k AS (SELECT w, file_path, min(line_no) AS line_no FROM t WHERE w IS NOT NULL AND length(w) > 80 GROUP BY ALL),
m AS (SELECT file_path, line_no, lag(file_path) OVER o AS other_file, lag(line_no) OVER o AS other_line FROM k WINDOW o AS (PARTITION BY w ORDER BY file_path))
SELECT file_path, min(line_no) AS line_no, arg_min(other_file, struct_pack(a := line_no, b := other_file, c := other_line)) AS other_file, arg_min(other_line, struct_pack(a := line_no, b := other_file, c := other_line)) AS other_line FROM m WHERE other_file IS NOT NULL GROUP BY file_path"""
)
def sliding_clones(spark, d):
    return mining.sliding_clones(corpus(spark, d), size=2)


# Search -------------------------------------------------------------------------------------------------------------

QUERY = "the heon tionand release License"
_WORDS = list(dict.fromkeys(search.tokenize_query(QUERY)))
_BM25 = f"""c AS (SELECT *, {TOKENS_OF.format('content')} AS t FROM {{0}}), s AS (SELECT count(*) AS n, avg(len(t)) AS a{''.join(f", count(*) FILTER (list_contains(t, '{w}')) AS df{k}" for k, w in enumerate(_WORDS))} FROM c),
x AS (SELECT c.*, {' + '.join(f"ln(1.0 + (n - df{k} + 0.5) / (df{k} + 0.5)) * len(list_filter(t, lambda z: z = '{w}')) * 2.2 / (len(list_filter(t, lambda z: z = '{w}')) + 1.2 * (0.25 + 0.75 * len(t) / a))" for k, w in enumerate(_WORDS))} AS score FROM c, s)"""
_CANDIDATES = f"cand AS (SELECT * FROM chunks WHERE file_path IN (SELECT file_path FROM chunks WHERE list_has_any({TOKENS_OF.format('content')}, [{', '.join(repr(w) for w in _WORDS)}])))"


@query(f"WITH {windows_sql(40, 8)}, {_CANDIDATES}, {_BM25.format('cand')} SELECT chunk_id, round(score, 6) AS score FROM x WHERE score > 0.05 ORDER BY score DESC, file_path, chunk_seq LIMIT 10")
def bm25_topk(spark, d):
    held = chunks.windows(corpus(spark, d))
    return search.bm25(held, search.terms(held), QUERY).select("chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {windows_sql(40, 8)}, {_BM25.format('chunks')} SELECT chunk_id, round(score, 6) AS score FROM x")
def bm25_all(spark, d):
    return search.scored(chunks.windows(corpus(spark, d)), _WORDS).select("chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {windows_sql(40, 8)}, {_CANDIDATES} SELECT chunk_id, file_path FROM cand")
def bm25_candidates(spark, d):
    held = chunks.windows(corpus(spark, d))
    return search.candidates(held, search.terms(held), _WORDS).select("chunk_id", "file_path")


@query(
    f"""WITH o AS (SELECT doc_id, {TOKENS_OF.format('text')} AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS a FROM o),
q AS (SELECT item_id, unnest(list_distinct({TOKENS_OF.format('text')})) AS term FROM benchmark), tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM o) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), r AS (SELECT item_id, doc_id, sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) AS score FROM q JOIN tf USING (term) JOIN df USING (term), s GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM r) SELECT item_id, CAST(rank AS INT) AS rank, doc_id, round(score, 4) AS score FROM k WHERE rank <= 3"""
)
def bm25_queries(spark, d):
    held = search.weighted_postings(table(spark, d, "documents"), table(spark, d, "benchmark"), doc_id="doc_id", doc_text="text", query_id="item_id", query_text="text")
    scores = search.top_documents(held, 3)[0]
    best = scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "doc_id"))).where("rank <= 3")
    return best.select(F.col("query_id").alias("item_id"), "rank", "doc_id", F.round("score", 4).alias("score"))


@query(f"WITH {windows_sql(40, 8)} SELECT chunk_id FROM chunks WHERE regexp_matches(content, '(?s)token = ([^\\s(),]+)(.*?)The')")
def pattern_match(spark, d):
    return search.matching(chunks.windows(corpus(spark, d)), "token = $VALUE$...The").select("chunk_id")


@query(f"WITH {LINES} SELECT file_path, line_no FROM lines WHERE contains(lower(line), 'license')")
def grep_lines(spark, d):
    return search.grep(text.lines(corpus(spark, d)), " LICENSE ").select("file_path", "line_no")


@query("WITH t AS (SELECT doc_id, source, sum(CAST(ceil(length(text) / 4.0) AS BIGINT)) OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS used FROM documents) SELECT doc_id, source, CAST(used AS BIGINT) AS used FROM t WHERE used <= 16000")
def context_pack(spark, d):
    return search.pack_context(table(spark, d, "documents"), order=["n_chars", "doc_id"], by=["source"], text="text").select("doc_id", "source", "used")


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4")
def history_trim(spark, d):
    return search.last_turns(table(spark, d, "conversations"), keep=4).select("conv_id", "turn")


# Rules --------------------------------------------------------------------------------------------------------------


def _corpus_rules() -> list[rules.Rule]:
    line = F.col("line")
    return [
        rules.Rule("planted-token", "secrets", "critical", line.rlike(r'token = "[0-9a-f]{40}"'), "Token in the text.", redact=True),
        rules.Rule("license-line", "legal", "low", F.contains(F.lower(line), F.lit("license")), "License wording."),
        rules.Rule("rights", "legal", "medium", F.contains(line, F.lit("All rights reserved")), "Rights wording."),
        rules.Rule("weak-context", "sast", "high", F.contains(line, F.lit("License")) & F.lower("context").rlike("token|reserved"), "License near other words."),
    ]


_FINDINGS = f"""{LINES}, ctx AS (SELECT *, string_agg(line, chr(10)) OVER (PARTITION BY file_path ORDER BY line_no ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS context FROM lines),
findings AS (SELECT 'planted-token' AS rule, 'secrets' AS category, 'critical' AS severity, file_path, line_no FROM ctx WHERE regexp_matches(line, 'token = "[0-9a-f]{{40}}"')
UNION ALL SELECT 'license-line', 'legal', 'low', file_path, line_no FROM ctx WHERE contains(lower(line), 'license')
UNION ALL SELECT 'rights', 'legal', 'medium', file_path, line_no FROM ctx WHERE contains(line, 'All rights reserved')
UNION ALL SELECT 'weak-context', 'sast', 'high', file_path, line_no FROM ctx WHERE contains(line, 'License') AND regexp_matches(lower(context), 'token|reserved'))"""


def _findings(spark, d):
    return rules.deduplicated(rules.line_findings(corpus(spark, d), _corpus_rules()))


@query(f"WITH {_FINDINGS} SELECT rule, category, severity, file_path AS file, line_no AS line FROM findings")
def rule_scan(spark, d):
    return rules.line_findings(corpus(spark, d), _corpus_rules()).select("rule", "category", "severity", "file", "line")


@query(f"WITH {_FINDINGS} SELECT DISTINCT rule, file_path AS file, line_no AS line FROM findings")
def findings_dedup(spark, d):
    twice = rules.line_findings(corpus(spark, d), _corpus_rules())
    return rules.deduplicated(twice.unionByName(twice.withColumn("emit_seq", F.col("emit_seq") + 50))).select("rule", "file", "line")


@query(f"WITH {_FINDINGS} SELECT count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'critical') AS critical, count(*) AS total FROM findings")
def severity_summary(spark, d):
    return rules.summary(_findings(spark, d)).select("low", "medium", "high", "critical", "total")


@query(f"WITH {_FINDINGS} SELECT rule, file_path AS file, line_no AS line FROM findings WHERE severity IN ('high', 'critical')")
def severity_threshold(spark, d):
    return rules.at_least(_findings(spark, d), "high").select("rule", "file", "line")


@query(
    f"""WITH {LINES}, w AS (SELECT *, string_agg(line, chr(10)) OVER (PARTITION BY file_path ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS near FROM lines)
SELECT file_path, line_no FROM w WHERE regexp_matches(line, '^The ') AND regexp_matches(near, 'token|License') AND line_no - 1 < n_lines - 4"""
)
def loop_window(spark, d):
    return rules.loop_queries(text.lines(corpus(spark, d)), "^The ", "token|License").select("file_path", "line_no")


@query(
    f"""WITH {LINES}, w AS (SELECT *, lead(line, 1) OVER o AS a, lead(line, 2) OVER o AS b FROM lines WINDOW o AS (PARTITION BY file_path ORDER BY line_no))
SELECT file_path, line_no FROM w WHERE starts_with(line, 'The ') AND (starts_with(coalesce(a, ''), 'The ') OR starts_with(coalesce(b, ''), 'The ')) AND line_no < n_lines - 1"""
)
def nested_lead(spark, d):
    return rules.nested_loops(text.lines(corpus(spark, d)), "The ", "^The ").select("file_path", "line_no")


# History ------------------------------------------------------------------------------------------------------------


def _commits(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("commit_id"), F.col("l_partkey").cast("string").alias("file_path"))


_COMMITS = "commits AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS commit_id, CAST(l_partkey AS VARCHAR) AS file_path FROM lineitem), cc AS (SELECT file_path, count(*) AS n FROM commits GROUP BY 1)"
_COCHANGE = f"""{_COMMITS}, half AS (SELECT a.file_path AS file_a, b.file_path AS file_b, count(*) AS cochange_count FROM commits a JOIN commits b ON a.commit_id = b.commit_id AND a.file_path < b.file_path GROUP BY ALL),
pairs AS (SELECT file_a, file_b, cochange_count, CAST(round(100.0 * cochange_count / (x.n + y.n - cochange_count)) AS INT) AS ratio FROM half JOIN cc x ON x.file_path = file_a JOIN cc y ON y.file_path = file_b),
both_ways AS (SELECT * FROM pairs UNION ALL SELECT file_b, file_a, cochange_count, ratio FROM pairs)"""
_CHURN = f"""{_COMMITS}, j AS (SELECT file_path, n, coalesce(nullif(p_size, 0), 1) AS c FROM cc LEFT JOIN part ON CAST(p_partkey AS VARCHAR) = file_path),
churn AS (SELECT file_path, n AS commits_count, CAST(least(100, greatest(10, round(CAST(n AS DOUBLE) / max(n) OVER () * (CAST(c AS DOUBLE) / max(c) OVER ()) * 90 + 10))) AS INT) AS churn_score FROM j)"""


@query(f"WITH {_COMMITS} SELECT file_path, n AS commits_count FROM cc")
def commit_file_counts(spark, d):
    return mining.commit_counts(_commits(spark, d))


@query(f"WITH {_COCHANGE} SELECT * FROM both_ways")
def cochange_pairs(spark, d):
    return mining.cochange(_commits(spark, d))


@query(f"WITH {_COCHANGE} SELECT file_b, cochange_count, ratio FROM both_ways WHERE file_a = '1'")
def coupled_files(spark, d):
    return mining.coupled(mining.cochange(_commits(spark, d)), "1").select("file_b", "cochange_count", "ratio")


def _churn(spark, d):
    size = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("file_path"), F.col("p_size").alias("complexity"))
    return mining.churn(mining.commit_counts(_commits(spark, d)), size)


@query(f"WITH {_CHURN} SELECT * FROM churn")
def churn_score(spark, d):
    return _churn(spark, d)


@query(f"WITH {_CHURN} SELECT CAST(p_partkey AS VARCHAR) AS file_path, CAST(coalesce(commits_count, 1) AS BIGINT) AS commits_count, coalesce(churn_score, 10) AS churn_score FROM part LEFT JOIN churn ON file_path = CAST(p_partkey AS VARCHAR)")
def hotspots_default(spark, d):
    return mining.hotspots(table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("file_path")), _churn(spark, d))


@query(
    "SELECT CAST(o_custkey AS VARCHAR) AS file_path, arg_max(o_orderpriority, struct_pack(a := o_orderdate, b := o_orderkey)) AS author, arg_max(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS last_commit FROM orders GROUP BY 1"
)
def latest_author(spark, d):
    held = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("file_path"), F.col("o_orderpriority").alias("author"), F.col("o_orderkey").alias("commit_id"), F.lit("").alias("email"), F.col("o_orderdate").alias("date"))
    last = held.groupBy("file_path").agg(F.max(F.struct("date", "commit_id")).alias("c"))
    told = mining.latest_author(held).join(last, "file_path")
    return told.select("file_path", "author", F.col("c.commit_id").alias("last_commit"))


@query(
    "SELECT CAST(o_custkey AS VARCHAR) AS stream, sha256(CAST(o_orderkey AS VARCHAR)) AS commit_id, CAST(l_partkey AS VARCHAR) AS file_path, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL"
)
def commit_log_parse(spark, d):
    """Orders written out as logs, one for each customer, and read back."""
    orders, items = table(spark, d, "orders"), table(spark, d, "lineitem")
    heads = orders.select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("k"), F.lit(0).alias("s"), F.lit(0).cast("long").alias("p"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("line"))
    names = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_orderkey", F.lit(2), "l_partkey", F.col("l_partkey").cast("string"))
    log = heads.union(heads.select("c", "k", F.lit(1), "p", F.lit(""))).union(names)
    held = log.select(F.col("c").cast("string").alias("stream"), F.struct("k", "s", "p").alias("line_no"), "line")
    return parse.commit_log(held, "stream").groupBy("stream", "commit_id", "file_path").agg(F.count("*").alias("n"))


# Metrics ------------------------------------------------------------------------------------------------------------


def _file_table(spark, d):
    return corpus(spark, d).select("file_path", "language", text.line_count(F.col("content")).alias("line_count"))


def _symbol_table(spark, d):
    """Order lines as symbols of the file that their part is."""
    return table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("file_path"), F.col("l_quantity").cast("int").alias("complexity"))


@query(
    f"WITH {CORPUS} SELECT (SELECT count(*) FROM corpus) AS n_files, (SELECT CAST(sum(len(string_split(content, chr(10)))) AS BIGINT) FROM corpus) AS n_lines, count(*) AS n_symbols, round(avg(CAST(l_quantity AS INT)), 2) AS avg_complexity, max(CAST(l_quantity AS INT)) AS max_complexity FROM lineitem"
)
def stats_global(spark, d):
    return mining.totals(_file_table(spark, d), _symbol_table(spark, d))


@query("SELECT lang AS language, count(*) AS n_files FROM documents GROUP BY 1")
def stats_language(spark, d):
    return mining.by_language(_file_table(spark, d))


@query("SELECT CAST(l_partkey AS VARCHAR) AS file_path, max(CAST(l_quantity AS INT)) AS max_complexity, CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) AS total_complexity FROM lineitem GROUP BY 1 ORDER BY 3 DESC, 2 DESC, 1 LIMIT 10")
def stats_top_files(spark, d):
    return mining.top_files(table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("file_path")), _symbol_table(spark, d))


@query(f"WITH {CORPUS} SELECT count(*) AS n_files, (SELECT count(DISTINCT c_mktsegment) FROM customer) AS n_communities FROM corpus")
def community_count(spark, d):
    held = table(spark, d, "customer").select(F.col("c_mktsegment").alias("community_id"))
    return mining.totals(_file_table(spark, d), _symbol_table(spark, d), held).select("n_files", "n_communities")


@query(f"WITH {CORPUS} SELECT language, regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS directory, count(*) AS n_files, CAST(sum(len(string_split(content, chr(10)))) AS BIGINT) AS n_lines FROM corpus GROUP BY ROLLUP (1, 2)")
def stats_rollup(spark, d):
    return mining.rollup(_file_table(spark, d))


def _thresholds(spark, d):
    held = table(spark, d, "part").select(F.concat(F.lit("p#"), "p_partkey").alias("symbol_id"), F.col("p_brand").alias("file_path"), F.col("p_size").alias("complexity"), F.lit(0).alias("start_line"), (F.col("p_partkey") % 150).cast("int").alias("end_line"), F.length("p_name").alias("param_count"))
    return mining.over_thresholds(held, complexity=40, size=140, params=12)


_OVER = """over AS (SELECT concat('p#', p_partkey) AS symbol_id, p_brand AS file_path, 'complexity' AS category, 'high' AS severity, CAST(p_size AS BIGINT) AS value FROM part WHERE p_size > 40
UNION ALL SELECT concat('p#', p_partkey), p_brand, 'size-fn', 'medium', p_partkey % 150 FROM part WHERE p_partkey % 150 > 140
UNION ALL SELECT concat('p#', p_partkey), p_brand, 'params', 'medium', length(p_name) FROM part WHERE length(p_name) > 12)"""


@query(f"WITH {_OVER} SELECT * FROM over")
def over_threshold(spark, d):
    return _thresholds(spark, d)


@query(f"WITH {_OVER} SELECT greatest(10, 100 - CAST(coalesce(sum(CASE severity WHEN 'high' THEN 15 WHEN 'medium' THEN 8 ELSE 3 END), 0) AS BIGINT)) AS score FROM over")
def health_score(spark, d):
    return mining.health_score(_thresholds(spark, d))


# Boundaries and gaps ------------------------------------------------------------------------------------------------


def _module_imports(spark, d):
    """Customers as files of their nation that import their segment."""
    return table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat_ws("/", "n_name", "c_name").alias("file_path"), F.lower(F.concat(F.lit("lib/"), "c_mktsegment")).alias("target"), F.col("c_mktsegment").alias("specifier"))


_IMPORTS = "imp AS (SELECT concat(n_name, '/', c_name) AS file_path, lower(concat('lib/', c_mktsegment)) AS target FROM customer JOIN nation ON c_nationkey = n_nationkey)"
_SCOPE = (("NATION_1", "auto", "error", "One."), ("NATION_2", "build", "warning", "Two."), ("A", "house", "error", "Three."))


@query(f"WITH {_IMPORTS}, r(f, t, severity, message) AS (VALUES {', '.join(str(x) for x in _SCOPE)}) SELECT file_path, target AS imported, f AS from_part, t AS to_part, severity, message FROM imp JOIN r ON contains(file_path, f) AND contains(target, t)")
def scope_violations(spark, d):
    return mining.scope_violations(_module_imports(spark, d), spark.createDataFrame(list(_SCOPE), "from_part string, to_part string, severity string, message string"))


@query(
    """WITH imp AS (SELECT DISTINCT concat('h/', regexp_extract(url, '://([^/?#]*)', 1)) AS other, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS specifier FROM pages), ch(file_path, stem) AS (VALUES ('x/en/10.html', '10'), ('y/7.html', '7'), ('z/none.html', 'none'))
SELECT file_path, coalesce(string_agg(DISTINCT other, ',' ORDER BY other) FILTER (other IS NOT NULL), '') AS downstream FROM ch LEFT JOIN imp ON (contains(specifier, stem) OR contains(file_path, specifier)) AND other <> file_path GROUP BY file_path"""
)
def diff_impact(spark, d):
    parts = paths.url_parts(F.col("url"))
    imports = table(spark, d, "pages").select(F.concat(F.lit("h/"), parts["host"]).alias("file_path"), parts["path"].alias("specifier"))
    changed = spark.createDataFrame([("x/en/10.html",), ("y/7.html",), ("z/none.html",)], "file_path string")
    return mining.impact(changed, imports).select("file_path", F.array_join("downstream", ",").alias("downstream"))


def _gap(spark, d):
    exports = table(spark, d, "part").select(F.concat(F.lit("src/"), F.col("p_partkey")).alias("file_path"), F.element_at(F.split("p_name", " "), 1).alias("name"))
    words = table(spark, d, "benchmark").select(F.concat(F.lit("b/"), "item_id").alias("file_path"), F.element_at(F.split("text", " "), 2).alias("name"))
    tests = table(spark, d, "documents").select(F.concat(F.lit("x/tests/"), "doc_id").alias("file_path"), F.col("text").alias("content"))
    return mining.test_gap(exports.union(words), tests)


_GAP = """ex AS (SELECT concat('src/', p_partkey) AS file_path, string_split(p_name, ' ')[1] AS name FROM part UNION ALL SELECT concat('b/', item_id), string_split(text, ' ')[2] FROM benchmark),
hit AS (SELECT DISTINCT name FROM (SELECT DISTINCT name FROM ex) JOIN documents ON contains(text, name)), gap AS (SELECT file_path, ex.name, hit.name IS NOT NULL AS tested FROM ex LEFT JOIN hit ON ex.name = hit.name WHERE ex.name <> '' AND ex.name <> 'default')"""


@query(f"WITH {_GAP} SELECT * FROM gap")
def test_gap(spark, d):
    return _gap(spark, d)


@query(f"WITH {_GAP} SELECT count(*) AS total, count(*) FILTER (tested) AS tested, count(*) FILTER (NOT tested) AS untested, CAST(round(100.0 * count(*) FILTER (tested) / count(*)) AS BIGINT) AS percent FROM gap")
def coverage_pct(spark, d):
    return mining.coverage(_gap(spark, d))


@query("SELECT bucket, count(*) AS n FROM (SELECT 'com' AS bucket FROM pages WHERE contains(url, '.com') UNION ALL SELECT 'https' FROM pages WHERE starts_with(url, 'https') UNION ALL SELECT 'english' FROM pages WHERE contains(url, '/en/')) GROUP BY 1")
def path_buckets(spark, d):
    return mining.buckets(table(spark, d, "pages").select(F.col("url").alias("file_path")), {"com": r"\.com", "https": "^https", "english": "/en/", "none": "^ftp"})


@query(
    """WITH o AS (SELECT doc_id, text FROM documents), n AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT -1 - item_id, text FROM benchmark)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'deleted' WHEN o.text = n.text THEN 'unchanged' ELSE 'changed' END AS status FROM o FULL JOIN n ON o.doc_id = n.doc_id"""
)
def incremental_diff(spark, d):
    """All documents against an edited copy: some gone, some changed, the benchmark added."""
    old = table(spark, d, "documents").select("doc_id", "text")
    edited = old.where("doc_id % 10 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    new = edited.unionByName(table(spark, d, "benchmark").select((F.lit(-1) - F.col("item_id")).alias("doc_id"), "text"))
    hashed = lambda df: df.select("doc_id", text.content_hash(F.col("text")).alias("sha256"))
    return mining.incremental_diff(hashed(old), hashed(new), "doc_id")


@query("SELECT l_orderkey, arg_max(l_linenumber, struct_pack(a := l_shipdate, b := l_linenumber)) AS l_linenumber, max(l_shipdate) AS last FROM lineitem GROUP BY 1 UNION ALL SELECT o_orderkey, -1, o_orderdate FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def upsert_latest(spark, d):
    stored = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(-1).alias("l_linenumber"), F.col("o_orderdate").alias("last"))
    new = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("last"), F.struct("l_shipdate", "l_linenumber").alias("v"))
    return store.upsert(stored.withColumn("v", F.lit(None).cast(new.schema["v"].dataType)), new, ["l_orderkey"], "v").drop("v")


@query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')")
def cascade_delete(spark, d):
    gone = table(spark, d, "nation").join(table(spark, d, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("file_path"))
    held = table(spark, d, "customer").select(F.col("c_nationkey").alias("file_path"), "c_custkey")
    return store.delete_files({"customers": held}, gone)["customers"].select("c_custkey")


@query("SELECT n_name AS file_path, (SELECT string_agg(c_name, ',' ORDER BY c_custkey) FROM customer WHERE c_nationkey = n_nationkey) AS exports, (SELECT string_agg(s_name, ',' ORDER BY s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey) AS imports FROM nation")
def registry_nested(spark, d):
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("file_path"))
    symbols = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("k")).select("file_path", F.col("c_name").alias("name"), F.col("c_custkey").alias("parse_seq"), F.lit(True).alias("is_exported"))
    imports = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("k")).select("file_path", F.col("s_name").alias("target"), F.col("s_suppkey").alias("parse_seq"))
    told = store.registry(nation.select("file_path"), symbols, imports)
    joined = lambda c: F.when(F.size(c) > 0, F.array_join(c, ","))
    return told.select("file_path", joined("exports").alias("exports"), joined("imports").alias("imports"))


# Links --------------------------------------------------------------------------------------------------------------


@query(
    """SELECT event_id, arg_min(o_orderkey, o_orderkey) AS o_orderkey FROM events LEFT JOIN orders ON o_custkey = user_id % 1000 AND CAST(ts AS DATE) - CAST(o_orderdate AS DATE) BETWEEN 0 AND 3650 GROUP BY event_id"""
)
def caller_range_join(spark, d):
    """The first order, by key, of a customer that was open for ten years when the event came."""
    day = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date"))
    points = table(spark, d, "events").select("event_id", (F.col("user_id") % 1000).alias("file_path"), day("ts").alias("line"))
    ranges = table(spark, d, "orders").select(F.col("o_custkey").alias("file_path"), day("o_orderdate").alias("low"), (day("o_orderdate") + 3650).alias("high"), "o_orderkey")
    return link.first_container(points, ranges, key="file_path", at="line", low="low", high="high", order=[], keep=["o_orderkey"], point_id=["event_id"])


_OVERLAP = f"""{windows_sql(8, 2)}, sym AS (SELECT file_path, line_no AS s, line_no + 3 AS e, CASE WHEN contains(line, 'License') THEN 'CLASS' ELSE 'OTHER' END AS kind FROM lines WHERE regexp_matches(line, 'License|token|reserved')),
m AS (SELECT chunk_id, s, kind, row_number() OVER (PARTITION BY chunk_id ORDER BY CASE kind WHEN 'CLASS' THEN 0 WHEN 'OTHER' THEN 1 ELSE 2 END, CASE WHEN kind = 'CLASS' THEN -s ELSE s END) AS n FROM chunks LEFT JOIN sym ON sym.file_path = chunks.file_path AND s <= end_line AND e >= start_line)"""


@query(f"WITH {_OVERLAP} SELECT chunk_id, CAST(s AS INT) AS symbol_start, kind FROM m WHERE n = 1")
def symbol_overlap(spark, d):
    held = text.lines(corpus(spark, d)).where(F.col("line").rlike("License|token|reserved"))
    kind = F.when(F.contains("line", F.lit("License")), "CLASS").otherwise("OTHER")
    symbols = held.select("file_path", F.col("line_no").alias("start_line"), (F.col("line_no") + 3).alias("end_line"), F.lit("x").alias("name"), kind.alias("kind"), F.lit("x").alias("symbol_id"), F.col("line_no").alias("parse_seq"))
    return link.overlapping_symbol(chunks.windows(corpus(spark, d), 8, 2), symbols, ["chunk_id"]).select("chunk_id", "symbol_start", "kind")


@query(
    r"""WITH f AS (SELECT page_id, concat(regexp_extract(url, '://([^/?#]*)', 1), regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/$', '')) AS p FROM pages),
l AS (SELECT DISTINCT p AS file_path, unnest(regexp_extract_all(regexp_extract(p, '^[^/]*(/.*)$', 1), '[^/]+$')) AS spec FROM f)
SELECT l.file_path, spec AS specifier, coalesce((SELECT min(p) FROM f WHERE p LIKE '%/' || spec), spec) AS target FROM l"""
)
def import_resolve(spark, d):
    """Each page's last path segment as an import, resolved among the paths of all pages."""
    parts = paths.url_parts(F.col("url"))
    files = table(spark, d, "pages").select(F.concat(parts["host"], F.regexp_replace(parts["path"], "/$", "")).alias("file_path")).distinct()
    imports = files.select("file_path", F.element_at(F.split("file_path", "/"), -1).alias("specifier")).where(F.contains("file_path", F.lit("/")))
    return link.resolve_imports(imports, files).select("file_path", "specifier", "target")


@query("SELECT page_id, coalesce(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1), '') AS scheme, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages")
def url_parts(spark, d):
    return table(spark, d, "pages").select("page_id", paths.url_parts(F.col("url")).alias("u")).select("page_id", "u.*")


@query(
    r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^(?:[a-z]+://)?(?:www\.)?[^/]+/?', ''), '[?#].*$', '') AS p FROM pages), s AS (SELECT page_id, list_filter(string_split(p, '/'), lambda x: x <> '') AS p FROM p)
SELECT page_id, p[1] AS owner, p[2] AS repo, 'main' AS branch FROM s"""
)
def repository_parts(spark, d):
    return table(spark, d, "pages").select("page_id", paths.repository_parts(F.col("url")).alias("u")).select("page_id", "u.owner", "u.repo", "u.branch")


ANCHOR = r"(?i)<(a|article|nav)\s+href=['\"](.*?)['\"]"


@query(r"""SELECT page_id, seq, upper(m) AS method, r AS route FROM (SELECT page_id, CAST(unnest(range(0, len(x))) AS INT) AS seq, unnest(x) AS m, unnest(y) AS r FROM (SELECT page_id, regexp_extract_all(html, '(?i)<(a|article|nav)\s+href=[''"](.*?)[''"]', 1) AS x, regexp_extract_all(html, '(?i)<(a|article|nav)\s+href=[''"](.*?)[''"]', 2) AS y FROM pages))""")
def route_extract(spark, d):
    return parse.routes(table(spark, d, "pages"), ANCHOR, "page_id", "html").select(F.col("file_path").alias("page_id"), "seq", "method", "route")


@query("SELECT event_id, k AS package, json_extract_string(props, '$.' || k) AS version FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_props(spark, d):
    held = table(spark, d, "events").select(F.col("event_id").alias("file_path"), F.concat(F.lit('{"dependencies":'), "props", F.lit("}")).alias("content"))
    return sources.dependencies(held).select(F.col("file_path").alias("event_id"), "package", "version")


@query("SELECT conv_id, turn, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, rpad(role, CAST(greatest(12, length(role)) AS INT), ' ') AS role FROM conversations")
def padded_roles(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.token_estimate(F.col("text")).alias("tokens"), text.padded(F.col("role"), 12).alias("role"))


@query("SELECT p_partkey, CAST(list_sum(list_transform(string_split(p_name, ''), lambda c: ascii(c))) AS BIGINT) AS h FROM part")
def name_hash(spark, d):
    return table(spark, d, "part").select("p_partkey", text.char_code_sum(F.col("p_name")).alias("h"))


@query("SELECT event_id, CASE WHEN regexp_matches(event_type, 'click|error') THEN 'high' WHEN regexp_matches(event_type, 'view|warn') THEN 'medium' ELSE 'low' END AS severity FROM events")
def severity_words(spark, d):
    word = F.regexp_replace(F.regexp_replace("event_type", "click", "error"), "view", "warn")
    return table(spark, d, "events").select("event_id", rules.external_severity(word).alias("severity"))


# Graphs -------------------------------------------------------------------------------------------------------------
# Customers as nodes: an order leads to the next one, by key, of the same priority.


def _edges(spark, d):
    following = F.lead("o_custkey").over(Window.partitionBy("o_orderpriority").orderBy("o_orderkey"))
    return table(spark, d, "orders").select(F.col("o_custkey").alias("src"), following.alias("dst")).where("dst IS NOT NULL")


def _start(spark, d):
    return table(spark, d, "orders").agg(F.min("o_custkey").alias("id"))


_E = "raw AS (SELECT o_custkey AS src, o_orderkey, lead(o_custkey) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS dst FROM orders), e AS (SELECT DISTINCT src, dst FROM raw WHERE dst IS NOT NULL)"


@query(f"WITH {_E} SELECT src, dst FROM e WHERE src <> dst")
def simple_digraph(spark, d):
    return graph.simple_digraph(_edges(spark, d))


@query(f"WITH {_E} SELECT 'out' AS way, dst AS id FROM e WHERE src = 1 UNION ALL SELECT 'in', src FROM e WHERE dst = 1")
def neighbors(spark, d):
    held = _edges(spark, d)
    return graph.out_neighbors(held, 1).select(F.lit("out").alias("way"), "id").unionAll(graph.in_neighbors(held, 1).select(F.lit("in"), "id"))


@query(f"WITH {_E} SELECT c_custkey AS id, CAST(coalesce(n, 0) AS BIGINT) AS n FROM customer LEFT JOIN (SELECT dst, count(*) AS n FROM e WHERE src <> dst GROUP BY 1) ON dst = c_custkey")
def in_degree(spark, d):
    return graph.in_degree(graph.simple_digraph(_edges(spark, d)), table(spark, d, "customer").select(F.col("c_custkey").alias("id")))


@query(
    f"""WITH RECURSIVE {_E}, w AS (SELECT [min(o_custkey)] AS path, min(o_custkey) AS node, 0 AS depth, false AS is_cycle FROM orders
UNION ALL SELECT list_append(path, dst), dst, depth + 1, list_contains(path, dst) FROM w JOIN e ON node = src WHERE depth < 2 AND NOT is_cycle) SELECT array_to_string(path, '>') AS path, node, depth, is_cycle FROM w"""
)
def bounded_walk(spark, d):
    return graph.bounded_walk(_edges(spark, d), _start(spark, d), 2).select(F.array_join("path", ">").alias("path"), "node", "depth", "is_cycle")


_R = f"{_E}, r AS (SELECT min(o_custkey) AS id FROM orders UNION SELECT dst FROM r JOIN e ON id = src)"


@query(f"WITH RECURSIVE {_R} SELECT id FROM r")
def reachability(spark, d):
    return graph.reachable(_edges(spark, d), _start(spark, d))


@query(f"WITH RECURSIVE {_E}, r AS (SELECT min(o_custkey) AS id, 0 AS k FROM orders UNION SELECT dst, k + 1 FROM r JOIN e ON id = src WHERE k < 2) SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT id FROM r)")
def dead_nodes(spark, d):
    """Customers more than two steps away from the first one."""
    live = graph.distances(_edges(spark, d), _start(spark, d), most=2)
    return table(spark, d, "customer").join(live, F.col("c_custkey") == F.col("id"), "left_anti").select("c_custkey")


@query(f"WITH RECURSIVE {_E}, r AS (SELECT min(o_custkey) AS id, 0 AS k FROM orders UNION SELECT dst, k + 1 FROM r JOIN e ON id = src WHERE k < 6) SELECT id, min(k) AS distance FROM r GROUP BY id")
def shortest_dist(spark, d):
    return graph.distances(_edges(spark, d), _start(spark, d), most=6)


@query(
    f"""WITH RECURSIVE {_E}, f AS (SELECT 1 AS id, 0 AS k UNION SELECT dst, k + 1 FROM f JOIN e ON id = src WHERE k < 6), dd AS (SELECT id, min(k) AS k FROM f GROUP BY id), t AS (SELECT max(o_custkey) AS id FROM orders),
b AS (SELECT dd.id, dd.k FROM dd JOIN t USING (id) UNION SELECT dd.id, dd.k FROM b JOIN e ON e.dst = b.id JOIN dd ON dd.id = e.src AND dd.k = b.k - 1),
p AS (SELECT 0 AS step, CAST(1 AS BIGINT) AS id UNION ALL SELECT p.step + 1, (SELECT min(b.id) FROM b JOIN e ON e.dst = b.id AND e.src = p.id WHERE b.k = p.step + 1) FROM p WHERE p.step < (SELECT max(k) FROM b)) SELECT step, id FROM p"""
)
def shortest_path(spark, d):
    last = table(spark, d, "orders").agg(F.max("o_custkey")).first()[0]
    return graph.shortest_path(_edges(spark, d), 1, last)


@query(
    f"""WITH {_E} SELECT concat(a.src, '>', a.dst) AS cycle FROM e a WHERE a.src = a.dst UNION ALL SELECT concat(a.src, '>', a.dst, '>', b.dst) FROM e a JOIN e b ON b.src = a.dst WHERE a.src < a.dst AND b.dst = a.src
UNION ALL SELECT concat(a.src, '>', a.dst, '>', b.dst, '>', c.dst) FROM e a JOIN e b ON b.src = a.dst JOIN e c ON c.src = b.dst WHERE a.src < a.dst AND b.dst > a.src AND b.dst <> a.dst AND c.dst = a.src"""
)
def cycles_len_k(spark, d):
    return graph.cycles(_edges(spark, d), 3).select(F.array_join("cycle", ">").alias("cycle"))


@query(f"WITH RECURSIVE {_E}, r AS (SELECT src AS a, dst AS b FROM e UNION SELECT a, dst FROM r JOIN e ON b = src) SELECT count(*) FILTER (a = b) > 0 AS has_cycle FROM r")
def has_cycle(spark, d):
    return graph.has_cycle(_edges(spark, d))


@query(
    f"""WITH RECURSIVE {_E}, r AS (SELECT src AS a, dst AS b FROM e UNION SELECT a, dst FROM r JOIN e ON b = src), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e)
SELECT id, least(id, coalesce((SELECT min(x.b) FROM r x JOIN r y ON x.b = y.a AND y.b = v.id WHERE x.a = v.id), id)) AS component FROM v"""
)
def scc(spark, d):
    return graph.strong_components(_edges(spark, d))


def _near(spark, d):
    """Nations as nodes, linked where customers of one follow those of another most often."""
    nation = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("n"))
    held = _edges(spark, d).join(nation.select(F.col("c_custkey").alias("src"), F.col("n").alias("a")), "src").join(nation.select(F.col("c_custkey").alias("dst"), F.col("n").alias("b")), "dst")
    counts = held.where("a <> b").groupBy("a", "b").agg(F.count("*").alias("k"))
    return counts.groupBy(F.col("a").alias("src")).agg(F.max_by("b", F.struct("k", -F.col("b"))).alias("dst"))


@query()
def label_propagation(spark, d):
    return graph.communities(_edges(spark, d))


@query()
def community_modularity(spark, d):
    held = _edges(spark, d)
    return graph.modularity(held, graph.communities(held))


@query(
    """WITH x AS (SELECT o_custkey AS s, lead(o_custkey) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS t FROM orders), e AS (SELECT DISTINCT least(s, t) AS a, greatest(s, t) AS b FROM x WHERE s <> t),
n AS (SELECT u.c_nationkey AS ca, v.c_nationkey AS cb FROM e JOIN customer u ON u.c_custkey = a JOIN customer v ON v.c_custkey = b), m AS (SELECT CAST(count(*) AS DOUBLE) AS m FROM n),
d AS (SELECT c, count(*) AS d FROM (SELECT ca AS c FROM n UNION ALL SELECT cb FROM n) GROUP BY c), l AS (SELECT ca AS c, count(*) AS l FROM n WHERE ca = cb GROUP BY ca)
SELECT round(sum(coalesce(l, 0) / m - pow(d / (2 * m), 2)), 9) AS modularity FROM d LEFT JOIN l USING (c), m"""
)
def partition_modularity(spark, d):
    """How well nations part the graph of customers."""
    return graph.modularity(_edges(spark, d), table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("community"))).select(F.round("modularity", 9).alias("modularity"))


@query()
def louvain(spark, d):
    return graph.louvain(_edges(spark, d))


@query()
def map_mermaid(spark, d):
    held = _near(spark, d)
    return sinks.map_lines(held, graph.vertices(held), graph.communities(held), graph.cycles(held, 3))


@query("WITH x AS (SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE l_partkey <> l_suppkey) SELECT a, b FROM x UNION ALL SELECT b, a FROM x")
def symmetric_closure(spark, d):
    pairs = table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return mining.symmetric(mining.undirected(pairs, "a", "b"), "a", "b")


@query(
    f"""WITH RECURSIVE {_E}, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src <> dst), z AS (SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT b FROM u)),
r AS (SELECT id, 0 AS k FROM z UNION SELECT b, k + 1 FROM r JOIN u ON id = a WHERE k < 1) SELECT DISTINCT id FROM r"""
)
def map_depth(spark, d):
    """What a map of depth 1 shows if links lead from smaller to larger customers."""
    edges = mining.undirected(_edges(spark, d), "src", "dst")
    return graph.map_nodes(edges, table(spark, d, "customer").select(F.col("c_custkey").alias("id")), 1)


# Streams ------------------------------------------------------------------------------------------------------------


@query(
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events), k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n_events, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS paths FROM k GROUP BY user_id, n"""
)
def session_debounce(spark, d):
    held = watch.debounced(table(spark, d, "events").select("user_id", "ts", F.col("event_type").alias("path")), key="user_id", gap="6 hours")
    return held.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n_events", F.array_join("paths", ",").alias("paths"))


@query("SELECT DISTINCT event_type AS path FROM events")
def stream_dedup(spark, d):
    return watch.distinct_paths(table(spark, d, "events").select("ts", F.col("event_type").alias("path"))).select("path")


@query(
    f"""WITH {windows_sql(40, 8)}, m AS (SELECT c.file_path, word AS name, chunk_seq, content FROM chunks c, (VALUES ('license'), ('token')) w(word) WHERE contains(lower(content), word)), f AS (SELECT file_path, name, arg_min(content, chunk_seq) AS content FROM m GROUP BY ALL)
SELECT c.file_path, word AS name, f.content[1:150] AS snippet FROM corpus c CROSS JOIN (VALUES ('license'), ('token')) w(word) LEFT JOIN f ON f.file_path = c.file_path AND f.name = word"""
)
def first_mentions(spark, d):
    """The beginning of each document's first window with a word."""
    items = corpus(spark, d).select("file_path", F.explode(F.array(F.lit("license"), F.lit("token"))).alias("name"))
    return link.first_mention(items, chunks.windows(corpus(spark, d)), ["file_path", "name"])


@query(
    f"""WITH {_BM25.format("(SELECT item_id AS id, text AS content FROM benchmark)")} SELECT id, round(score, 6) AS score FROM x"""
)
def rank_list(spark, d):
    return search.rank_list(table(spark, d, "benchmark"), QUERY, "item_id", "text").select("id", F.round("score", 6).alias("score"))


@query(f"WITH {CORPUS} SELECT false AS full_stack, CAST(0 AS BIGINT) AS n_typescript, count(*) AS n_files FROM corpus")
def overview_facts(spark, d):
    return mining.overview(corpus(spark, d), _module_imports(spark, d).withColumn("parse_seq", F.lit(0)))[0]


@query("SELECT CAST(p_partkey AS VARCHAR) AS file_path, CAST(h % 4 + 1 AS BIGINT) AS commits_count, CAST(least(100, greatest(12, h * 13 % 75 + 10)) AS INT) AS churn_score FROM (SELECT p_partkey, CAST(list_sum(list_transform(string_split(CAST(p_partkey AS VARCHAR), ''), lambda c: ascii(c))) AS BIGINT) AS h FROM part)")
def stand_in_churn(spark, d):
    return mining.stand_in_churn(table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("file_path")))


@query()
def document_vectors(spark, d):
    return embed.embed(table(spark, d, "documents"), "doc_id", "text")


# Reports ------------------------------------------------------------------------------------------------------------


@query()
def sarif_json(spark, d):
    return sinks.sarif(_findings(spark, d))


@query(
    f"""WITH r AS (SELECT DISTINCT method, route FROM ({ORACLE_SQL['route_extract']})), m AS (SELECT route, concat(CAST(to_json(lower(method)) AS VARCHAR), ':{{"summary":', CAST(to_json(concat(method, ' ', route)) AS VARCHAR), ',"responses":{{"200":{{"description":"OK"}}}}}}') AS o FROM r),
p AS (SELECT concat(CAST(to_json(route) AS VARCHAR), ':{{', string_agg(o, ',' ORDER BY o), '}}') AS p FROM m GROUP BY route)
SELECT concat('{{"openapi":"3.0.0","info":{{"title":"API","version":"1.0.0"}},"paths":{{', string_agg(p, ',' ORDER BY p), '}}}}') AS document FROM p"""
)
def openapi_json(spark, d):
    return sinks.openapi(parse.routes(table(spark, d, "pages"), ANCHOR, "page_id", "html"))


@query(f"""WITH {_FINDINGS} SELECT 'rule,severity,file,line' AS line UNION ALL SELECT concat('"', rule, '","', severity, '","', file_path, '",', line_no) FROM (SELECT DISTINCT rule, severity, file_path, line_no FROM findings)""")
def csv_report(spark, d):
    return sinks.csv_lines(_findings(spark, d).select("rule", "severity", "file", "line"))


QUERIES |= code_queries.QUERIES
ORACLE_SQL |= code_queries.ORACLE_SQL

assert math.isclose(search.K1 + 1, 2.2)  # the SQL above states it
