"""Benchmark decontamination on a distributed positional inverted index.

The index holds one posting ``(term, doc_id, text_hash, pos)`` for each occurrence of a term in the training text. Only
terms that a test phrase reads are stored. Which those are follows from corpus counts: every phrase is looked up from
its rarest terms. Offset-adjusted lists are intersected rarest first; what is left is compared word by word, so that
matches are exact. With ``slop`` the same lists also give proximity matches: places where all terms of a phrase lie, in any
order, at most ``slop`` words from an occurrence of its rarest term. Everything is DataFrame code.

Defined results: null and empty texts have no words and no hits; an item without words matches nothing; an item with a
null id marks words but is not listed; repeated rows are separate documents with equal results; a null ``doc_id`` is
kept; other columns of the rows come back inside ``doc``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm._common import fits_broadcast, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
SALTS = 32


def words_of(text: Column) -> Column:
    """The words of a text; A-Z become a-z and no other letter changes. Null has none."""
    ascii_only = F.octet_length(text) == F.length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.array_remove(F.split(lowered, SEPARATORS), ""), F.array().cast("array<string>"))


def _by_term(rows: DataFrame, terms: DataFrame, how: str) -> DataFrame:
    """``rows`` joined with the few ``terms`` on ``term``. Beyond the broadcast limit frequent terms are spread over salts."""
    if fits_broadcast(terms):
        return rows.join(F.broadcast(terms), "term", how)
    salted = rows.withColumn("_salt", F.pmod(F.hash("doc_id", "pos"), F.lit(SALTS)))
    return salted.join(terms.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["term", "_salt"], how).drop("_salt")


def phrases_of(items: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """Distinct windows of ``window`` words: ``phrase array<string>, items array<id>``; a shorter item is one window."""
    words = items.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(1)))
    return (
        words.select("item_id", "words", F.explode(starts).alias("s"))
        .groupBy(F.slice("words", F.col("s"), window).alias("phrase"))
        .agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )


def term_counts(docs: DataFrame, text_col: str, terms: DataFrame) -> DataFrame:
    """Occurrences in the whole corpus of each of ``terms(term)``; terms that never occur have no row."""
    words = docs.select(F.explode(words_of(F.col(text_col))).alias("term"))
    count = F.count("*").alias("df")
    if fits_broadcast(terms):
        return words.join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(count)
    return words.groupBy("term").agg(count).join(terms, "term", "left_semi")


def postings(docs: DataFrame, id_col: str, text_col: str, terms: DataFrame) -> DataFrame:
    """The positional index over ``terms(term)``: ``term, doc_id, text_hash, pos`` (pos from 0)."""
    placed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.posexplode(words_of(F.col(text_col))).alias("pos", "term"))
    return _by_term(placed, terms, "left_semi").select("term", "doc_id", "text_hash", "pos")


def plan_phrases(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds ``phrase_id`` and ``lookups``: (df, offset, term) of the phrase's terms that occur, rarest first; a phrase with a term that never occurs is dropped."""
    numbered = phrases.withColumn("phrase_id", F.xxhash64("phrase"))
    ranked = (
        numbered.select("phrase_id", F.posexplode("phrase").alias("offset", "term"))
        .join(counts, "term")
        .groupBy("phrase_id")
        .agg(F.array_sort(F.collect_list(F.struct("df", "offset", "term"))).alias("lookups"))
    )
    return numbered.join(ranked, "phrase_id").where(F.size("lookups") == F.size("phrase"))


def intersect(index: DataFrame, plan: DataFrame, lists: int = 2) -> DataFrame:
    """Candidate places ``phrase_id, phrase, items, doc_id, text_hash, start``: the rarest term's list, offset-adjusted, intersected with the next ones, up to ``lists``."""
    seed = plan.select("phrase_id", "phrase", "items", "lookups", F.col("lookups")[0]["term"].alias("term"), F.col("lookups")[0]["offset"].alias("offset"))
    places = (
        _by_term(index, seed, "inner")
        .withColumn("start", F.col("pos") - F.col("offset"))
        .where("start >= 0")
        .select("phrase_id", "phrase", "items", "lookups", "doc_id", "text_hash", "start")
    )
    listed = index.select(F.col("term").alias("t"), F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.col("pos").alias("p"))
    for k in range(1, lists):
        short = places.where(F.size("lookups") <= k)
        rest = places.where(F.size("lookups") > k).withColumn("next", F.col("lookups")[k])
        met = rest.join(
            listed,
            (F.col("next.term") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")) & (F.col("start") + F.col("next.offset") == F.col("p")),
            "left_semi",
        ).drop("next")
        places = met.unionByName(short)
    return places.drop("lookups")


def near_places(index: DataFrame, plan: DataFrame, slop: int, lists: int = 2) -> DataFrame:
    """Candidates for proximity ``phrase, items, doc_id, text_hash, start``: places of each phrase's rarest term that have its next rarest terms, up to ``lists`` in all, at most ``slop`` words away.

    Positions meet by bins of ``slop`` words, so that a frequent term in a long text meets only its surroundings.
    """
    width = max(1, int(slop))
    seed = plan.select("phrase", "items", "lookups", F.col("lookups")[0]["term"].alias("term"))
    places = _by_term(index, seed, "inner").select("phrase", "items", "lookups", "doc_id", "text_hash", F.col("pos").alias("start"))
    listed = index.select(F.col("term").alias("t"), F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.col("pos").alias("p"), F.explode(F.array(*[F.floor(F.col("pos") / width) + k for k in (-1, 0, 1)])).alias("b"))
    for k in range(1, lists):
        short = places.where(F.size("lookups") <= k)
        rest = places.where(F.size("lookups") > k).withColumns({"next": F.col("lookups")[k]["term"], "bin": F.floor(F.col("start") / width)})
        met = (F.col("next") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")) & (F.col("bin") == F.col("b")) & (F.abs(F.col("p") - F.col("start")) <= slop)
        places = rest.join(listed, met, "left_semi").drop("next", "bin").unionByName(short)
    return places.drop("lookups")


def _hits(docs: DataFrame, id_col: str, text_col: str, places: DataFrame, slop: int | None) -> DataFrame:
    """``doc`` (the row of ``docs``), ``n_words``, ``hits`` (the places whose words are the phrase's, by start) and with ``slop`` ``near`` (the places that have them around, by place)."""
    found = places.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("start", "phrase", "items", "near"))).alias("places"))
    keyed = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))
    met = keyed.join(found, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")), "left")
    joined = met.select("doc", "places", words_of(F.col("doc")[text_col]).alias("words"))  # after the join: word arrays are larger than texts
    exact = F.filter(F.col("places"), lambda c: ~c["near"] & (F.slice(F.col("words"), c["start"] + 1, F.size(c["phrase"])) == c["phrase"]))
    plain = lambda c: F.struct(c["start"].alias("start"), c["phrase"].alias("phrase"), c["items"].alias("items"))
    told = {"n_words": F.size("words").cast("long"), "hits": F.transform(F.coalesce(exact, F.array()), plain)}
    if slop is not None:
        around = lambda c: F.slice(F.col("words"), F.greatest(c["start"] + 1 - slop, F.lit(1)), F.lit(slop + 1) + F.least(c["start"], F.lit(slop)))
        told["near"] = F.transform(F.coalesce(F.filter(F.col("places"), lambda c: c["near"] & (F.size(F.array_except(c["phrase"], around(c))) == 0)), F.array()), plain)
    return joined.select("doc", *(c.alias(n) for n, c in told.items()))


def find_contamination(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, lists: int = 2, slop: int | None = None
) -> DataFrame:
    """For each row of ``docs``: ``doc`` (the row as a struct), ``n_words``, ``hits`` (array of start, phrase, items), ``n_hit`` (words inside a hit) and ``item_ids``; with ``slop`` also ``near`` (as hits, but with the place of the rarest term) and ``near_item_ids``."""
    phrases = materialize(phrases_of(items, item_col, item_text_col, window), "phrases")
    vocabulary = materialize(phrases.select(F.explode("phrase").alias("term")).distinct(), "vocabulary")
    counts = materialize(term_counts(docs, text_col, vocabulary), "term-counts")
    plan = materialize(plan_phrases(phrases, counts), "phrase-plan")
    read = materialize(plan.select(F.explode(F.slice("lookups.term", 1, lists)).alias("term")).distinct(), "rarest-terms")
    index = materialize(postings(docs, id_col, text_col, read), "postings")
    places = intersect(index, plan, lists).select("doc_id", "text_hash", "start", "phrase", "items", F.lit(False).alias("near"))
    if slop is not None:
        places = places.unionByName(near_places(index, plan, slop, lists).withColumn("near", F.lit(True)))
    places = materialize(places, "places")
    covered = F.aggregate(
        F.col("hits"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, c: F.struct(
            (acc["n"] + F.greatest(F.lit(0), c["start"] + F.size(c["phrase"]) - F.greatest(acc["end"], c["start"]))).alias("n"),
            F.greatest(acc["end"], c["start"] + F.size(c["phrase"])).alias("end"),
        ),
        lambda acc: acc["n"],
    )
    told = _hits(docs, id_col, text_col, places, slop).withColumns({"n_hit": covered.cast("long"), "item_ids": F.array_distinct(F.flatten("hits.items"))})
    return told if slop is None else told.withColumn("near_item_ids", F.array_distinct(F.flatten("near.items")))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of the query: counts and the digest of the item ids, sorted as strings; where proximity was asked for, the items that are near."""
    ids = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    near = [F.size("near_item_ids").cast("long").alias("n_near_items")] if "near_item_ids" in found.columns else []
    return found.select(
        F.col("doc")[id_col].alias("doc_id"), "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), *near
    )
