"""The pipeline and the queries on small tables."""

import os
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarryline.llm import quality, queries, secrets
from quarryline.llm._common import materialize
from tests.llm.test_operators import ALNUM_WORD, LOWER, brute_best_fit, brute_links, library_ids

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@needs_data
def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SMALL), name)
        assert docs.columns == columns
        assert docs.count() <= rows
        rows = docs.count()
    assert rows > 0
    packed = corpus_pipeline.run(spark, SMALL)
    assert packed.select("doc_id").distinct().count() == rows


def brute_run(docs, items):
    """(pieces, lengths) of the pipeline by plain Python; ``docs`` are (doc_id, text)."""
    kept = [(i, told[7]) for i, t in docs if (told := quality.judge(t))[6]]
    links, first = brute_links(kept)
    group = {i: i for i in first.values()}
    for _ in range(len(group)):  # the least id of each group
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    kept = [(i, t) for i, t in kept if group[first[t]] == i]
    windows = set()
    for t in items:
        own = ALNUM_WORD.findall((t or "").translate(LOWER))
        windows |= {tuple(own[k : k + 10]) for k in range(max(1, len(own) - 9)) if own}
    sizes = {len(w) for w in windows}
    clean = []
    for i, t in kept:
        own = ALNUM_WORD.findall(t.translate(LOWER))
        if not any(tuple(own[k : k + n]) in windows for n in sizes for k in range(len(own) - n + 1)):
            clean.append((i, t))
    pieces = []
    for i, t in clean:
        ids = [*library_ids(secrets.redact(t, secrets.deep_scan(t)[1])), 1]
        pieces += [(i, at, len(ids[at : at + 2048]), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + 2048])), len(ids)) for at in range(0, len(ids), 2048)]
    return pieces


@needs_data
def test_run_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    expected = brute_run(docs, [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()])
    told = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in told) == sorted(expected)
    assert len({r.sequence_id for r in told}) == len(brute_best_fit([e[2] for e in expected], 2048))
    assert 0 < len({e[0] for e in expected}) < len(docs)


def test_stages_on_odd_rows(spark):
    prose = " ".join(f"Sentence {k} of a plain text that is long enough to be kept, as it should be." for k in range(12))
    rows = [(0, prose, "en", "s", len(prose)), (1, None, None, None, None), (2, "", "en", "s", 0), (3, prose, "en", "s", len(prose)), (3, prose, "en", "s", len(prose)), (None, prose.replace("plain", "other"), "en", "s", 1), (4, prose.replace("plain", "simple") + " token = 'abcdefgh1234'.", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for held in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            held = materialize(stage(spark, held, SMALL if os.path.isdir(SMALL) else ""), name) if name != "decontamination" or os.path.isdir(SMALL) else held
        kept = sorted(str(r.doc_id) for r in held.collect())
        assert kept in ([], sorted(["0", "4", "None"]))
        assert all("abcdefgh1234" not in r.text and r.n_chars == len(r.text) for r in held.collect())


def test_repeated_rows_leave_one(spark):
    docs = spark.createDataFrame([(5, "a b c d e f g"), (5, "a b c d e f g"), (6, "x y z u v w")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()) == [5, 6]


def test_only_copies_of_an_id_go(spark):
    a, other = "a b c d e f g h i j k l m n", "q r s t u v w x y z"
    docs = spark.createDataFrame([(5, a, 1), (5, other, 2), (6, a + " o", 3), (7, other, 4), (5, a, 1), (8, None, 5), (8, None, 6), (None, a, 7)], "doc_id long, text string, text_key int").withColumns({"key": F.lit("clash"), "doc": F.lit("clash")})
    kept = sorted(r.text_key for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect())
    assert kept in ([1, 2, 5, 6, 7], [2, 3, 5, 6, 7])  # one of each group


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SMALL)
    told = con.sql(queries.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(told.columns)
    at = [told.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in told.fetchall()), key=repr)
