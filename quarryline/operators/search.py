"""Ranked search over line windows: terms, candidates, qualifiers, structural patterns, BM25, symbols."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions import pattern as patterns
from quarryline.functions.paths import extension, short_language
from quarryline.functions.script import NotLexed, lex
from quarryline.functions.text import STOP_WORDS, token_estimate, tokens
from quarryline.operators.link import overlapping_symbol
from quarryline.sources.store import written

K1, B = 1.2, 0.75
FLOOR = 0.05


def terms(chunks: DataFrame) -> DataFrame:
    """``term, chunk_id, file_path, tf``."""
    return chunks.select("chunk_id", "file_path", F.explode(tokens(F.col("content"))).alias("term")).groupBy("term", "chunk_id", "file_path").agg(F.count("*").alias("tf"))


def document_frequencies(term_rows: DataFrame) -> DataFrame:
    return term_rows.groupBy("term").agg(F.count("*").alias("df"))


def tokenize_query(text: str) -> list[str]:
    """The tokenizer of ``functions.text.tokens`` for one short text of the caller."""
    text = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", text or "")
    text = re.sub(r"([A-Z])([A-Z][a-z])", r"\1 \2", text)
    return [t for t in re.sub(r"[^a-zA-Z0-9\s]", " ", text).lower().split() if len(t) >= 2 and t not in STOP_WORDS]


@dataclass
class Query:
    text: str
    qualifiers: dict[str, str] = field(default_factory=dict)


def parse_query(query: str) -> Query:
    """Parts with a colon are qualifiers (the last of a kind holds, what follows a second colon is lost), the rest is the text."""
    words, found = [], {}
    for part in query.split():
        key, colon, rest = part.partition(":")
        if colon:
            found[key.lower()] = rest.split(":")[0]
        else:
            words.append(part)
    return Query(" ".join(words), found)


def qualified(chunks: DataFrame, qualifiers: dict[str, str], *, file: str | None = None, type: str | None = None, lang: str | None = None, exported: bool = False, is_async: bool = False) -> DataFrame:
    """Windows that meet the qualifiers: path or file, symbol or type, language, is:exported, is:async."""
    content, path = F.col("content"), F.col("file_path")
    has = lambda *words: F.greatest(*[F.contains(content, F.lit(w)) for w in words]) if len(words) > 1 else F.contains(content, F.lit(words[0]))
    if wanted := file or qualifiers.get("path") or qualifiers.get("file"):
        chunks = chunks.where(F.contains(F.lower(path), F.lit(wanted.lower())))
    if wanted := (type or qualifiers.get("symbol") or qualifiers.get("type") or "").lower():
        if wanted in ("fn", "function", "method"):
            chunks = chunks.where(has("function", "=>", "def ", "async"))
        elif wanted == "class":
            chunks = chunks.where(has("class "))
        elif wanted in ("interface", "type"):
            chunks = chunks.where(has("interface ", "type "))
    if wanted := (lang or qualifiers.get("language") or qualifiers.get("lang") or "").lower():
        label, met = short_language(path), F.lit(False)
        for one in wanted.split(","):
            met = met | F.contains(label, F.lit(one)) | F.contains(F.lit(one), label)
        chunks = chunks.where(met)
    if exported or qualifiers.get("is") == "exported":
        chunks = chunks.where(has("export "))
    if is_async or qualifiers.get("is") == "async":
        chunks = chunks.where(has("async "))
    return chunks


def pattern_regex(pattern: str) -> str:
    """A code pattern as a regular expression: ``$...`` is any stretch, ``$_`` all up to a brace, ``$NAME`` one word."""
    parts = re.split(r"(\$\.\.\.|\$_\s*|\$[A-Z_]+)", pattern)
    return "(?s)" + "".join("(.*?)" if p == "$..." else "([^}]*)" if p.startswith("$_") else r"([^\s(),]+)" if re.fullmatch(r"\$[A-Z_]+", p) else re.sub(r"([\\.*+?^${}()|\[\]])", r"\\\1", p) for p in parts)


def matching(chunks: DataFrame, pattern: str) -> DataFrame:
    return chunks.where(F.col("content").rlike(pattern_regex(pattern)))


MATCHES = "file_path string, lexed boolean, matches array<struct<start:int,start_line:int,end_line:int,content:string,captures:map<string,string>>>"


def _matched(files: DataFrame, pattern: str) -> DataFrame:
    """``file_path, lexed, matches`` of each script; ``lexed`` is false where its tokens can't be told."""
    wanted = patterns.compiled(pattern)
    words = [value for kind, value, *_ in wanted if kind == "token" and re.match(r"[A-Za-z_$]", value)]
    held = files.where(extension(F.col("file_path")).isin(".ts", ".tsx", ".js", ".jsx")).select("file_path", "content")
    one = pa.struct([("start", pa.int32()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("content", pa.string()), ("captures", pa.map_(pa.string(), pa.string()))])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            lexed, told = [], []
            for path, content in zip(batch.column("file_path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                found: list[tuple] = []
                try:
                    if all(w in (content or "") for w in words):
                        found = patterns.matches(lex(content or "", not path.endswith(".ts")), wanted)
                    lexed.append(True)
                except NotLexed:
                    lexed.append(False)
                told.append([{"start": at, "start_line": a, "end_line": b, "content": text, "captures": list(names.items())} for at, a, b, text, names in found])
            yield pa.RecordBatch.from_arrays([batch.column("file_path"), pa.array(lexed, pa.bool_()), pa.array(told, pa.list_(one))], ["file_path", "lexed", "matches"])

    return held.mapInArrow(batches, MATCHES)


def structural(files: DataFrame, pattern: str) -> DataFrame:
    """``file_path, start (place in the text), start_line, end_line, content, captures``: where the scripts among ``files`` have code of a pattern (see ``functions.pattern``)."""
    return _matched(files, pattern).select("file_path", F.explode("matches").alias("m")).select("file_path", "m.*")


def matching_code(chunks: DataFrame, files: DataFrame, pattern: str) -> DataFrame:
    """For scripts the stretches that match, as windows; for other files, and scripts whose tokens can't be told, the windows that the pattern's regular expression finds."""
    own = files.join(chunks.select("file_path").distinct(), "file_path", "left_semi")
    try:
        told = written(_matched(own, pattern), "matches")
    except NotLexed:
        return matching(chunks, pattern)
    by_text = matching(chunks.join(told.where("lexed").select("file_path"), "file_path", "left_anti"), pattern)
    found = told.select("file_path", F.explode("matches").alias("m")).select(
        F.concat_ws("_", F.lit("ast"), "file_path", "m.start").alias("chunk_id"), "file_path", F.col("m.start").alias("chunk_seq"), "m.start_line", "m.end_line", "m.content", F.lit(f"Code of the pattern {pattern}").alias("summary"), F.array().cast("array<string>").alias("intent_tags")
    )
    return by_text.unionByName(found.select(*[c for c in found.columns if c in chunks.columns]), allowMissingColumns=True)


def candidates(chunks: DataFrame, term_rows: DataFrame, query: list[str]) -> DataFrame:
    """All windows of files that have one of the terms."""
    return chunks.join(term_rows.where(F.col("term").isin(query)).select("file_path").distinct(), "file_path", "left_semi")


def _count(word: str) -> Column:
    return F.size(F.filter("_t", lambda t: t == word))


def scored(chunks: DataFrame, query: list[str], mode: str = "token", keep: tuple[str, ...] = ()) -> DataFrame:
    """``chunk_id, score`` (and the columns ``keep``) of every window by Okapi BM25, where counts and lengths are those of ``chunks``.

    Texts are read once: length and counts of the few query terms are columns of a small table, from which come both the
    figures of the corpus, one row that is broadcast, and the scores. Mode "substring" counts terms as they stand in the
    raw text.
    """
    if mode == "token":
        held = chunks.select("chunk_id", *keep, tokens(F.col("content")).alias("_t"))
        tf = [_count(w) for w in query]
        length = F.size("_t")
    else:
        held = chunks.select("chunk_id", *keep, F.col("content").alias("_t"))
        tf = [F.regexp_count("_t", F.lit(re.escape(w))) for w in query]
        length = F.regexp_count("_t", F.lit(r"\w+"))
    held = written(held.select("chunk_id", *keep, length.alias("_dl"), *[c.alias(f"_tf{k}") for k, c in enumerate(tf)]), "term-counts")
    corpus = held.agg(F.count("*").alias("_n"), F.avg("_dl").alias("_avgdl"), *[F.count_if(F.col(f"_tf{k}") > 0).alias(f"_df{k}") for k in range(len(query))])
    met = held.crossJoin(F.broadcast(corpus))  # one row
    score = F.lit(0.0)
    for k in range(len(query)):
        score = score + okapi(F.col(f"_tf{k}"), F.col(f"_df{k}"), F.col("_n"), F.col("_dl"), F.col("_avgdl"))
    return met.select("chunk_id", *keep, score.alias("score"))


def okapi(tf: Column, df: Column, n: Column, length: Column, mean: Column) -> Column:
    idf = F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def bm25(chunks: DataFrame, term_rows: DataFrame, query: str, limit: int = 10, mode: str = "token") -> DataFrame:
    """The best windows for a query, above the floor; none without a candidate."""
    words = list(dict.fromkeys(tokenize_query(query)))
    ranked = scored(candidates(chunks, term_rows, words), words, mode, ("file_path", "chunk_seq")).where(F.col("score") > FLOOR)
    best = ranked.orderBy(F.desc("score"), "file_path", "chunk_seq").limit(limit)
    others = [c for c in chunks.columns if c not in ("file_path", "chunk_seq")]
    return chunks.select(*others).join(F.broadcast(best), "chunk_id").orderBy(F.desc("score"), "file_path", "chunk_seq")  # at most `limit` rows


def rank_list(docs: DataFrame, query: str, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``id, score`` of an ad-hoc list of texts, those with score 0 too."""
    held = docs.select(F.col(id_col).alias("chunk_id"), F.col(text_col).alias("content"))
    return scored(held, list(dict.fromkeys(tokenize_query(query)))).withColumnRenamed("chunk_id", "id")


def query_scores(docs: DataFrame, queries: DataFrame, *, doc_id: str, doc_text: str, query_id: str, query_text: str) -> DataFrame:
    """``query_id, doc_id, score`` for many queries at once, for all documents that share a term with the query."""
    own = docs.select(F.col(doc_id).alias("doc_id"), tokens(F.col(doc_text)).alias("_t"))
    lengths = own.select("doc_id", F.size("_t").alias("_dl"))
    corpus = lengths.agg(F.count("*").alias("_n"), F.avg("_dl").alias("_avgdl"))
    wanted = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(tokens(F.col(query_text)))).alias("term"))
    tf = own.select("doc_id", F.size("_t").alias("_dl"), F.explode("_t").alias("term")).join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term", "doc_id", "_dl").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weighted = tf.join(df, "term").crossJoin(F.broadcast(corpus)).select("term", "doc_id", okapi(F.col("tf"), F.col("df"), F.col("_n"), F.col("_dl"), F.col("_avgdl")).alias("w"))  # one row
    return wanted.join(weighted, "term").groupBy("query_id", "doc_id").agg(F.sum("w").alias("score"))


#: Blocks of documents whose greatest weight of a term bounds what the term can add to a score.
BLOCKS = 128
#: What rounding can add to a sum of weights.
SLACK = 1e-6


@dataclass
class Postings:
    """Postings of the terms of some queries: ``term, doc_id, w`` and the block of the document; ``bounds``, the greatest weight of each term in each block; the terms of each query with their greatest weights."""

    rows: DataFrame
    bounds: DataFrame
    wanted: DataFrame


def weighted_postings(docs: DataFrame, queries: DataFrame, *, doc_id: str, doc_text: str, query_id: str, query_text: str, blocks: int = BLOCKS) -> Postings:
    """Postings by weight of the terms that queries ask for. Texts are read once: a document's length is the count of an empty term that all documents have."""
    wanted = written(queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(tokens(F.col(query_text)))).alias("term")).where("query_id IS NOT NULL").distinct(), "query-terms")
    asked = wanted.select("term").distinct().unionByName(docs.sparkSession.createDataFrame([("",)], "term string"))
    own = docs.select(F.col(doc_id).alias("doc_id"), tokens(F.col(doc_text)).alias("_t"))
    each = own.select("doc_id", F.size("_t").alias("_dl"), F.explode(F.concat(F.array(F.lit("")), F.coalesce("_t", F.array().cast("array<string>")))).alias("term"))
    counts = written(each.join(asked, "term", "left_semi").groupBy("term", "doc_id", "_dl").agg(F.count("*").alias("tf")), "term-counts")
    corpus = counts.where("term = ''").agg(F.sum("tf").alias("_n"), F.avg("_dl").alias("_avgdl"))
    held = counts.where("term <> ''")
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    weight = okapi(F.col("tf"), F.col("df"), F.col("_n"), F.col("_dl"), F.col("_avgdl"))
    weighed = held.join(df, "term").crossJoin(F.broadcast(corpus)).select("term", "doc_id", weight.alias("w"), F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"))  # one row
    rows = written(weighed, "postings")
    bounds = written(rows.groupBy("term", "block").agg(F.max("w").alias("m"), F.count("*").alias("n")), "bounds")
    most = bounds.groupBy("term").agg(F.max("m").alias("most"), F.sum("n").alias("n_docs"))
    return Postings(rows, bounds, written(wanted.join(most, "term"), "wanted"))


def top_documents(held: Postings, limit: int, digits: int = 6) -> tuple[DataFrame, DataFrame]:
    """(``query_id, doc_id, score`` of the ``limit`` best documents of each query and those whose rounded score equals the last one's; ``query_id, n`` the postings that were read), exactly as if all were scored.

    The documents that a query's rarest terms put first are scored whole; what ``limit`` of them reach is a first bound. Its weakest terms, whose
    greatest weights together stay below that bound, bring no document in by themselves; their postings, which are most of
    all, are read only for documents that the other terms bring in and that can still pass the bound, given the greatest
    weights of the weak terms in the document's block.
    """
    by = Window.partitionBy("query_id")
    terms_ = held.wanted
    before = F.coalesce(F.sum("n_docs").over(by.orderBy(F.desc("most"), "term").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seeds = terms_.withColumn("_before", before).where(F.col("_before") < 4 * limit).select("query_id", "term")
    nth = lambda rows, score: rows.withColumn("_k", F.row_number().over(by.orderBy(F.desc(score)))).where(F.col("_k") == limit).select("query_id", F.col(score).alias("_bound"))
    likely = seeds.join(held.rows, "term").groupBy("query_id", "doc_id").agg(F.sum("w").alias("s")).withColumn("_k", F.row_number().over(by.orderBy(F.desc("s")))).where(F.col("_k") <= 4 * limit)
    probes = written(likely.select("query_id", "doc_id").join(terms_.select("query_id", "term"), "query_id").join(held.rows, ["term", "doc_id"]).groupBy("query_id", "doc_id").agg(F.sum("w").alias("s"), F.count("*").alias("n")), "probes")
    first = nth(probes, "s")
    rising = F.sum("most").over(by.orderBy("most", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    slack = SLACK + 10.0 ** -digits
    told = terms_.join(first, "query_id", "left").withColumn("_weak", rising < F.coalesce("_bound", F.lit(0.0)) - slack)
    split = written(told.select("query_id", "term", "_weak", "_bound"), "split-terms")
    strong, weak = split.where("NOT _weak").select("query_id", "term"), split.where("_weak").select("query_id", "term")
    partial = written(strong.join(held.rows, "term").groupBy("query_id", "doc_id", "block").agg(F.sum("w").alias("s"), F.count("*").alias("n")), "partial")
    bound = nth(partial, "s").withColumnRenamed("_bound", "_second").join(split.select("query_id", "_bound").distinct(), "query_id", "full").select("query_id", F.greatest(F.coalesce("_bound", F.lit(0.0)), F.coalesce("_second", F.lit(0.0))).alias("_bound"))
    rest = weak.join(held.bounds, "term").groupBy("query_id", "block").agg(F.sum("m").alias("_rest"))
    open_ = partial.join(rest, ["query_id", "block"], "left").join(bound, "query_id").where(F.col("s") + F.coalesce("_rest", F.lit(0.0)) >= F.col("_bound") - slack).select("query_id", "doc_id", "s")
    open_ = written(open_, "open")
    added = open_.select("query_id", "doc_id").join(weak, "query_id").join(held.rows.select("term", "doc_id", "w"), ["term", "doc_id"]).select("query_id", "doc_id", F.col("w").alias("s"))
    scores = open_.unionByName(added).groupBy("query_id", "doc_id").agg(F.sum("s").alias("score"), (F.count("*") - 1).alias("_n"))
    scores = written(scores, "scores")
    best = scores.withColumn("_k", F.rank().over(by.orderBy(F.desc(F.round("score", digits))))).where(F.col("_k") <= limit).select("query_id", "doc_id", "score")
    read = partial.select("query_id", "n").unionByName(probes.select("query_id", "n")).groupBy("query_id").agg(F.sum("n").alias("n")).unionByName(scores.groupBy("query_id").agg(F.sum("_n").alias("n"))).groupBy("query_id").agg(F.sum("n").alias("n"))
    return best, read


def search(chunks: DataFrame, term_rows: DataFrame, query: str, *, symbols: DataFrame | None = None, pattern: str | None = None, files: DataFrame | None = None, limit: int = 10, mode: str = "token", **options) -> DataFrame:
    """Ranked windows for a query with qualifiers; scores and their statistics are over the windows that the qualifiers leave.

    With ``files`` a pattern is matched against the code of scripts, and what matches takes the place of their windows.
    """
    told = parse_query(query)
    words = tokenize_query(told.text)
    held = candidates(chunks, term_rows, words) if words else chunks
    if words and held.isEmpty():
        held = chunks
    if pattern:
        held = matching(held, pattern) if files is None else matching_code(held, files, pattern)
    held = qualified(held, told.qualifiers, **options)
    if told.text.strip():
        phrase = F.when(F.contains(F.lower("content"), F.lit(told.text.lower())), 3.0).otherwise(0.0)
        scores = scored(held, words, mode)
        ranked = held.join(scores, "chunk_id").withColumn("score", F.col("score") + phrase).where(F.col("score") > FLOOR).withColumn("score", F.least(F.greatest("score", F.lit(0.1)), F.lit(10.0)))
    else:
        ranked = held.withColumn("score", F.lit(1.0))
    best = ranked.orderBy(F.desc("score"), "file_path", "chunk_seq").limit(limit)
    if symbols is None:
        return best
    return overlapping_symbol(best, symbols, ["chunk_id"]).orderBy(F.desc("score"), "file_path", "chunk_seq")


def grep(lines: DataFrame, pattern: str) -> DataFrame:
    """Lines that hold the pattern in any case; none for an empty pattern."""
    wanted = pattern.strip().lower()
    return lines.where(F.contains(F.lower("line"), F.lit(wanted)) & F.lit(bool(wanted)))


def pack_context(ranked: DataFrame, *, order: list, by: list[str] | None = None, text: str = "content", budget: int = 16_000) -> DataFrame:
    """Rows in order while their estimated tokens fit the budget; ``used`` is the running sum. ``by`` packs many contexts in parallel."""
    running = Window.partitionBy(*(by or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("used", F.sum(token_estimate(F.col(text))).over(running)).where(F.col("used") <= budget)


def last_turns(turns: DataFrame, *, by: str = "conv_id", order: str = "turn", keep: int = 40) -> DataFrame:
    """The last ``keep`` turns of each conversation."""
    back = Window.partitionBy(by).orderBy(F.desc(order))
    return turns.withColumn("_n", F.row_number().over(back)).where(F.col("_n") <= keep).drop("_n")
