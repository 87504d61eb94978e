"""One query for each operator, with production parameters, over its whole table; ORACLE_SQL where DuckDB can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import clustering, decontamination, html_template, importance, near_duplicates, packing, quality, secrets, sharding, substring_dedup, token_counts, toxicity, url_filter, vocabularies
from quarryline.llm._common import table

ORACLE_SQL: dict[str, str] = {}
VOCABULARY = "byte_bpe_50k.json"
#: Words around the rarest term of a window in which all its terms must lie for a proximity match.
SLOP = 10


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.digest(decontamination.find_contamination(documents, table(spark, sf_dir, "benchmark"), slop=SLOP))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), [1.0] * 24)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extract(table(spark, sf_dir, "pages"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"]))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(table(spark, sf_dir, "documents"))[0].drop("first_id", "text_key")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = quality.judge_quality(table(spark, sf_dir, "documents"), keep=["doc_id"], with_text=False)
    return told.select(F.col("doc.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = secrets.scan_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"], with_text=False)
    return told.select(F.col("doc.doc_id").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, centers, _ = clustering.cluster_vectors(table(spark, sf_dir, "embeddings"))
    return clustering.digest(state, centers)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.find_toxic(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_sharding, op3_token_counts, op4_html_extraction, op5_substring_dedup, op6_url_filter, op7_near_duplicates, op8_quality_rules, op9_packing, op10_secrets,
        op11_centroid_clustering, op12_importance_resampling, op13_toxicity,
    )
}

ORACLE_SQL["op6_url_filter"] = url_filter.oracle_sql()
ORACLE_SQL["op1_decontamination"] = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words, row_number() OVER () AS r
  FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), p AS (
  SELECT item_id, least(len(words), 10) AS n, array_to_string(words[s:s + least(len(words), 10) - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS s FROM i WHERE len(words) > 0)
), lens AS (SELECT DISTINCT n FROM p),
g AS (
  SELECT r, n, s, array_to_string(words[s:s + n - 1], ' ') AS phrase
  FROM (SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS s FROM w, lens)
), hit AS (SELECT g.r, g.s, p.n, p.item_id FROM g JOIN p ON g.phrase = p.phrase AND g.n = p.n),
covered AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS q FROM hit) GROUP BY r),
df AS (SELECT word, count(*) AS df FROM (SELECT unnest(words) AS word FROM w) GROUP BY word),
terms AS (SELECT DISTINCT phrase, o, string_split(phrase, ' ')[o] AS word FROM (SELECT phrase, unnest(range(1, n + 1)) AS o FROM p)),
rarest AS (SELECT phrase, arg_min(word, struct_pack(a := df, b := o)) AS word FROM terms LEFT JOIN df USING (word) GROUP BY phrase HAVING count(*) = count(df)),
around AS (SELECT r, q, word, words[greatest(q - 10, 1):q + 10] AS ws FROM (SELECT r, words, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS q FROM w) JOIN (SELECT DISTINCT word FROM rarest) USING (word)),
near AS (SELECT r, count(DISTINCT item_id) AS n_near FROM around JOIN rarest USING (word) JOIN p USING (phrase) WHERE list_has_all(ws, string_split(phrase, ' ')) GROUP BY r),
listed AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT r, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near_items
FROM w LEFT JOIN covered USING (r) LEFT JOIN listed USING (r) LEFT JOIN near USING (r)
"""

ORACLE_SQL["op5_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, row_number() OVER () AS r FROM documents),
g AS (SELECT r, doc_id, s, hash(array_to_string(words[s:s + 12], ' ')) AS h FROM (SELECT *, unnest(range(1, len(words) - 11)) AS s FROM w)),
low AS (SELECT h, min(doc_id) AS low FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT r, unnest(range(s, s + 13)) AS p FROM g JOIN low USING (h) WHERE doc_id > low),
kept AS (
  SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text
  FROM (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w) u ANTI JOIN gone USING (r, p) GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (r)
"""

ORACLE_SQL["op2_sharding"] = r"""
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tbl),
d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, CASE WHEN doc_id IS NULL THEN 'null' ELSE concat('k', doc_id) END AS k FROM documents),
h AS (SELECT doc_id, k, octet_length(b) + 8 AS size, hex(b) AS x FROM d),
c AS (
  SELECT doc_id, k, size, xor(4294967295, list_reduce([4294967295] || list_transform(range(1, length(x), 2), lambda i: CAST(concat('0x', substr(x, i, 2)) AS BIGINT)), lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1]))) AS text_crc32
  FROM h, t
), s AS (
  SELECT *, -list_max(list_transform(range(24), lambda s: struct_pack(u := CAST(concat('0x', substr(md5(concat(k, ':', s)), 1, 8)) AS BIGINT), o := -s))).o AS shard,
    -list_max(list_transform(range(25), lambda s: struct_pack(u := CAST(concat('0x', substr(md5(concat(k, ':', s)), 1, 8)) AS BIGINT), o := -s))).o AS grown_shard FROM c
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INT) AS shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS BIGINT) AS slot, CAST(grown_shard AS INT) AS grown_shard FROM s
"""

ORACLE_SQL["op8_quality_rules"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
l AS (SELECT r, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS p, unnest(string_split(text, chr(10))) AS line FROM d),
w AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words FROM l),
j AS (
  SELECT r, p, line, len(words) AS n, list_sum(list_transform(words, lambda x: length(x))) AS held,
    len(words) > 0 AND (
      regexp_matches(line, '(?i)^[^\pL\pN_]*(?:{phrases})[^\pL\pN_]*$')
      OR (len(words) >= 3 AND len(list_filter(words, lambda x: list_contains([{menu}], lower(regexp_replace(x, '^[^\pL]+|[^\pL]+$', '', 'g'))))) >= 0.8 * len(words))
      OR len(list_filter(words, lambda x: regexp_full_match(x, '[|>»›·•/\\-]+'))) > 0.25 * len(words)
      OR (len(words) >= 8 AND (
        len(list_filter(words, lambda x: regexp_matches(x, '[#*$%&|<>]'))) > 0.3 * len(words)
        OR NOT regexp_matches(array_to_string(words[-4:], ' '), '[.!?…。！？:;"”’)]')
        OR list_max(map_values(list_histogram(words))) > 0.5 * len(words)))) AS fails
  FROM w
), dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM j WHERE n > 0 GROUP BY r),
lines AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_words, CAST(coalesce(sum(held), 0) AS BIGINT) AS word_chars, CAST(coalesce(sum(held) FILTER (fails), 0) AS BIGINT) AS lost FROM j GROUP BY r),
a AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
g AS (SELECT r, s, array_to_string(words[s:s + 7], ' ') AS h FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS s FROM a)),
again AS (SELECT g.r, g.s FROM g JOIN (SELECT r, h FROM g GROUP BY r, h HAVING count(*) > 1) USING (r, h)),
rep AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(s, s + 8)) AS q FROM again) GROUP BY r),
x AS (
  SELECT doc_id, n_words, word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, lost
  FROM d JOIN lines USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep USING (r)
), y AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost <= 0.3 * word_chars AS kept FROM y
"""

_quoted = lambda t: t.replace("'", "''")
ORACLE_SQL["op8_quality_rules"] = (
    ORACLE_SQL["op8_quality_rules"].replace("{phrases}", _quoted("|".join(vocabularies.BOILERPLATE))).replace("{menu}", ", ".join(f"'{_quoted(w)}'" for w in sorted(vocabularies.NAVIGATION)))
)

ORACLE_SQL["op7_near_duplicates"] = r"""
WITH RECURSIVE t AS (SELECT text, min(doc_id) AS rep, count(*) AS n_copies FROM documents WHERE text IS NOT NULL GROUP BY text),
w AS (SELECT rep, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
sh AS (SELECT DISTINCT rep, array_to_string(words[s:s + least(len(words), 5) - 1], ' ') AS h FROM (SELECT rep, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS s FROM w WHERE len(words) > 0)),
n AS (SELECT rep, count(*) AS n FROM sh GROUP BY rep),
p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS k FROM sh a JOIN sh b ON a.h = b.h AND a.rep < b.rep GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n x ON x.rep = a JOIN n y ON y.rep = b WHERE k / (x.n + y.n - k) >= 0.8),
e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
c AS (SELECT a AS node, a AS to_node FROM e UNION SELECT node, b FROM c JOIN e ON to_node = a),
g AS (SELECT node, min(to_node) AS class_id FROM c GROUP BY node), dg AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT doc_id, coalesce(rep, doc_id) AS rep_id, coalesce(class_id, rep, doc_id) AS class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, CAST(coalesce(n_copies, 1) AS BIGINT) AS n_copies
FROM documents d LEFT JOIN t ON t.text = d.text LEFT JOIN g ON node = rep LEFT JOIN dg ON dg.a = rep
"""

ORACLE_SQL["op12_importance_resampling"] = r"""
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tbl),
w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words, row_number() OVER () AS r, 's' AS side FROM documents
  UNION ALL
  SELECT NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), -row_number() OVER (), 't' FROM benchmark
), f AS (
  SELECT r, side, unnest(words) AS feature FROM w
  UNION ALL SELECT r, side, unnest(list_transform(range(1, len(words)), lambda i: concat(words[i], ' ', words[i + 1]))) FROM w
), x AS (SELECT feature, hex(encode(feature)) AS x FROM (SELECT DISTINCT feature FROM f)),
b AS (SELECT feature, xor(4294967295, list_reduce([4294967295] || list_transform(range(1, length(x), 2), lambda i: CAST(concat('0x', substr(x, i, 2)) AS BIGINT)), lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1]))) % 10000 AS bucket FROM x, t),
n AS (SELECT bucket, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t FROM f JOIN b USING (feature) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * CAST(sum(s) OVER () + 10000 AS DOUBLE) / ((s + 1) * CAST(sum(t) OVER () + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM n),
d AS (SELECT r, count(*) AS n_features, CAST(floor(sum(gain) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS weight FROM f JOIN b USING (feature) JOIN g USING (bucket) WHERE side = 's' GROUP BY r),
e AS (
  SELECT doc_id, len(words) >= 20 AS fit, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(concat('0x', substr(sha256(concat('7:', doc_id)), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM w LEFT JOIN d USING (r) WHERE side = 's'
), k AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY fit) AS n FROM e)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CAST(CASE WHEN fit AND place <= 25 * n // 100 THEN place END AS BIGINT) AS rank FROM k
"""


def _clusters_sql(rounds: int = 3) -> str:
    """Lloyd's rounds, each an assignment by all distances and a mean of whole numbers."""
    parts = ["""v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND list_count(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: isfinite(x)))
), c0 AS (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INT) AS c, v FROM (SELECT v, sha256(concat('1:', vec_id)) AS h FROM v ORDER BY h LIMIT 16))"""]
    for k in range(rounds + 1):
        parts.append(f"""a{k} AS (
  SELECT r, arg_min(struct_pack(c := c, d := d), struct_pack(d := d, c := c)) AS best
  FROM (SELECT r, c, list_sum(list_transform(range(1, 65), lambda i: (v.v[i] - c{k}.v[i]) * (v.v[i] - c{k}.v[i]))) AS d FROM v, c{k}) GROUP BY r
)""")
        if k < rounds:
            parts.append(f"""m{k} AS (
  SELECT c, list(x ORDER BY i) AS v FROM (SELECT best.c AS c, i, CAST(floor(sum(x) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS x FROM (SELECT r, unnest(v) AS x, unnest(range(1, 65)) AS i FROM v) JOIN a{k} USING (r) GROUP BY ALL) GROUP BY c
), c{k + 1} AS (SELECT c, coalesce(m{k}.v, c{k}.v) AS v FROM c{k} LEFT JOIN m{k} USING (c))""")
    return f"""WITH {', '.join(parts)}
SELECT vec_id, best.c AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM v JOIN a{rounds} USING (r) JOIN c{rounds} ON c{rounds}.c = best.c"""


ORACLE_SQL["op11_centroid_clustering"] = _clusters_sql()
