"""URL filters: rules for hosts and paths, then a weighted vocabulary matched by one Aho-Corasick automaton.

A url with a strict term, or with several distinct soft terms, is rejected. Terms count only as whole words: between
characters that are no ASCII letters or digits, or at an end of the url. Matching is on the url with A-Z lower-cased.

Defined results: host and path are empty where the url is null or has no ``://``, and no rule fits an empty host; a
null url has no terms and is allowed; an empty table gives an empty result; urls of any length are read whole; repeated
rows repeat their verdicts; columns besides id and url are not read. Vocabularies are parameters (see ``vocabularies``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.vocabularies import URL_SOFT, URL_STRICT

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, rule) for the query: a host with its subdomains, then the beginning of the path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
SOFT_LIMIT = 2


def split_url(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lower-cased, path), empty where there is none."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: Iterable[tuple[str, str]]) -> tuple[Column, Column]:
    """(verdict, rule) of the longest rule that fits, else nulls. Of equally long ones the first given wins."""
    verdict, rule = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(reversed(list(rules)), key=lambda r: len(r[1])):
        name, slash, begins = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + begins)
        verdict, rule = F.when(fits, says).otherwise(verdict), F.when(fits, text).otherwise(rule)
    return verdict, rule


def automaton(strict: Iterable[str], soft: Iterable[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term in {*strict, *soft}:
        found.add_word(term, (term, term in set(strict)))
    found.make_automaton()
    return found


def terms_in(url: str, found: ahocorasick.Automaton) -> tuple[set[str], set[str]]:
    """Distinct (strict, soft) terms that stand as whole words in a lower-cased url."""
    hits: tuple[set[str], set[str]] = (set(), set())
    inside = lambda k: 0 <= k < len(url) and url[k].isascii() and url[k].isalnum()
    for end, (term, strict) in found.iter(url):
        if not inside(end + 1) and not inside(end - len(term)):
            hits[not strict].add(term)
    return hits


def judge_urls(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=RULES, strict=URL_STRICT, soft=URL_SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """``page_id, host, path, rule, verdict, strict_terms, soft_terms`` for each row."""
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    lower = str.maketrans(UPPER, LOWER)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(strict, soft) if strict or soft else None
        for batch in source:
            hits = [terms_in((u or "").translate(lower), found) if found else (set(), set()) for u in batch.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("host"), batch.column("path"), *(pa.array([sorted(h[k]) for h in hits], pa.list_(pa.string())) for k in (0, 1))], ["page_id", "host", "path", "strict_terms", "soft_terms"])

    id_type = rows.schema["page_id"].dataType.simpleString()
    told = rows.mapInArrow(batches, f"page_id {id_type}, host string, path string, strict_terms array<string>, soft_terms array<string>")
    verdict, rule = rule_of(F.col("host"), F.col("path"), rules)
    rejected = (F.size("strict_terms") > 0) | (F.size("soft_terms") >= soft_limit)
    return told.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(rejected, "block").otherwise("allow")).alias("verdict"), "strict_terms", "soft_terms")


def _sql_terms() -> str:
    strict = "|".join(URL_STRICT)
    soft = " + ".join(f"CAST(regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS INT)" for t in URL_SOFT)
    return f"(regexp_matches(u, '(^|[^a-z0-9])({strict})([^a-z0-9]|$)') OR {soft} >= {SOFT_LIMIT})"


def oracle_sql() -> str:
    ordered = sorted(RULES, key=lambda r: -len(r[1]))
    fits = {t: f"((host = '{t.partition('/')[0]}' OR host LIKE '%.{t.partition('/')[0]}') AND starts_with(path, '/{t.partition('/')[2]}'))" for _, t in ordered}
    rule = "CASE " + " ".join(f"WHEN {fits[t]} THEN '{t}'" for _, t in ordered) + " END"
    says = "CASE rule " + " ".join(f"WHEN '{t}' THEN '{v}'" for v, t in ordered) + f" ELSE CASE WHEN {_sql_terms()} THEN 'block' ELSE 'allow' END END"
    low = f"translate({{}}, '{UPPER}', '{LOWER}')"
    return f"""
WITH a AS (SELECT page_id, {low.format("coalesce(url, '')")} AS u, CASE WHEN contains(url, '://') THEN url[instr(url, '://') + 3:] ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, u, {low.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, {rule} AS rule FROM b)
SELECT page_id, host, path, rule, {says} AS verdict FROM c"""
