"""Updates against rebuilds, the stream of a folder's changes, and tables with versions."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quarryline.functions.text import content_hash
from quarryline.plans import index as plans
from quarryline.sources import folder as folders
from quarryline.sources.versions import Conflict, Store
from quarryline.streaming import watch

TABLES = {"files": ["file_path", "sha256", "line_count"], "symbols": ["symbol_id", "start_line", "end_line", "parse_seq"], "imports": ["file_path", "specifier", "target", "resolved", "parse_seq"], "chunks": ["chunk_id", "struct_hash"], "edges": ["src", "dst", "edge_type", "line"], "terms": ["term", "chunk_id", "tf"], "links": ["file_path", "parse_seq", "callee", "src", "dst"]}


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def some_file(r, names):
    """Code that imports, declares and calls by a few names that many files share."""
    out = [f"import {{ {r.choice(names)} }} from '{r.choice(['./', '../a/', '../b/', 'b/', ''])}{r.choice(['m', 'n', 'o', 'p'])}{r.choice(['', '.ts'])}';" for _ in range(r.randint(0, 2))]
    for _ in range(r.randint(0, 3)):
        out += [f"{r.choice(['export ', ''])}function {r.choice(names)}(x) {{", *(f"  {r.choice(['', 'this.', 'q.'])}{r.choice(names)}(x);" for _ in range(r.randint(0, 3))), "}"]
    return "\n".join([*out, f"{r.choice(names)}(1)"])


def frame(spark, files):
    return spark.createDataFrame(list(files.items()), "file_path string, content string")


def settled(spark, index, root):
    """The index as tables on storage, as between two sessions."""
    index.contents = None
    index.save(root)
    return plans.load(spark, root)


def test_update_equals_rebuild_on_random_edits(spark, tmp_path):
    r = random.Random(5)
    names = [f"s{k}" for k in range(7)]
    paths = [f"{d}/{n}.ts" for d in ("a", "b", "c") for n in ("m", "n", "o", "p")] + ["a/m/index.ts", "b/m.js", "m.ts"]
    files = {p: some_file(r, names) for p in r.sample(paths, 9)}
    index = settled(spark, plans.build_index(frame(spark, files)), str(tmp_path / "0"))
    for turn in range(1, 3):
        for p in r.sample(sorted(files), 2):
            del files[p]
        files |= {p: some_file(r, names) for p in r.sample(paths, 3)}
        whole = frame(spark, files)
        listing = whole.select("file_path", content_hash(F.col("content")).alias("sha256"))
        known = {x.file_path: x.sha256 for x in index.files.collect()}
        unread = whole.withColumn("content", F.when(F.col("file_path").isin(*known) & content_hash(F.col("content")).isin(*known.values()), F.lit("not { to be read")).otherwise(F.col("content")))
        updated, diff = plans.update_index(index, unread, listing)
        expected = plans.build_index(whole)
        for name, columns in TABLES.items():
            assert rows(getattr(updated, name), *columns) == rows(getattr(expected, name), *columns), (turn, name)
        assert {x.status for x in diff.collect()} >= {"added", "deleted"} or turn
        index = settled(spark, updated, str(tmp_path / str(turn)))


def test_update_of_a_few_files_rewrites_a_few(spark):
    files = {f"d/f{k}.ts": f"import {{ g{k + 1} }} from './f{k + 1}';\nexport function g{k}() {{ g{k + 1}() }}" for k in range(60)}
    index = plans.build_index(frame(spark, files))
    updated, _ = plans.update_index(index, frame(spark, files | {"d/f9.ts": "export function g9() { late() }"}))
    assert rows(updated.rewritten["files"].distinct(), "file_path") == [("d/f9.ts",)]
    assert rows(updated.rewritten["links"].distinct(), "file_path") == [("d/f8.ts",), ("d/f9.ts",)]
    with pytest.raises(ValueError):
        index.links = None
        plans.update_index(index, frame(spark, files))


# Streams ------------------------------------------------------------------------------------------------------------


def put(folder, path, text, at=None):
    p = folder / path
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)
    if at:
        os.utime(p, (at, at))


def test_listings(tmp_path):
    for path in ("a.ts", "d/b.ts", ".git/x", "node_modules/y.js", "dist/z.js", "d/.hidden", "1/2/3/4/5/6/7/8/9/10/in.ts", "1/2/3/4/5/6/7/8/9/10/11/out.ts"):
        put(tmp_path, path, path)
    held = folders.listing(str(tmp_path), 10)
    assert sorted(held) == ["1/2/3/4/5/6/7/8/9/10/in.ts", "a.ts", "d/b.ts"]
    assert folders.differences({"a": [1, 1], "b": [1, 1], "c": [1, 1]}, {"a": [1, 1], "b": [2, 1], "d": [1, 1]}) == [("b", "change", 2), ("c", "unlink", 1), ("d", "add", 1)]
    assert folders.listing(str(tmp_path / "none"), 10) == {}


def test_changes_of_a_folder(spark, tmp_path):
    """Files that are there at first are no events; what comes, changes, moves, goes and comes back is seen once, over restarts."""
    folder, seen = tmp_path / "in", []
    put(folder, "a.ts", "one")
    put(folder, "b.ts", "two")

    def run():
        seen.clear()
        stream = watch.changes_stream(spark, str(folder), str(tmp_path / "listings"), quiet=100)
        query = stream.writeStream.foreachBatch(lambda df, n: seen.extend(sorted(map(tuple, df.select("file_path", "event", "content").collect())))).option("checkpointLocation", str(tmp_path / "point")).trigger(availableNow=True).start()
        query.awaitTermination()
        return list(seen)

    assert run() == []
    put(folder, "c.ts", "three")
    put(folder, "a.ts", "one more")
    put(folder, ".git/x", "x")
    assert run() == [("a.ts", "change", "one more"), ("c.ts", "add", "three")]
    assert run() == []
    (folder / "a.ts").unlink()
    (folder / "b.ts").rename(folder / "moved.ts")
    assert run() == [("a.ts", "unlink", None), ("b.ts", "unlink", None), ("moved.ts", "add", "two")]
    put(folder, "a.ts", "one")
    assert run() == [("a.ts", "add", "one")]
    assert run() == []
    assert len(os.listdir(tmp_path / "listings")) <= 2


def test_index_of_a_folder(spark, tmp_path):
    """An index that follows a folder equals one that is built of what is there, deletions and all; each burst is told once."""
    folder, root, seen = tmp_path / "in", str(tmp_path / "index"), []
    files = {"a.ts": "import { b } from './b';\nb(1)", "b.ts": "export function b() { c() }", "d/c.ts": "export function c() {}"}
    for path, text in files.items():
        put(folder, path, text)

    def run():
        seen.clear()
        watch.watch_code(spark, str(folder), root, str(tmp_path / "point"), lambda df, n: seen.append({r.file_path: r.status for r in df.collect()}), once=True, quiet=100).awaitTermination()
        held = watch.current(spark, root)
        expected = plans.build_index(frame(spark, files))
        for name in ("files", "symbols", "edges"):
            assert rows(getattr(held, name), *TABLES[name]) == rows(getattr(expected, name), *TABLES[name]), name
        return list(seen)

    assert run() == [{"a.ts": "added", "b.ts": "added", "d/c.ts": "added"}]
    files |= {"b.ts": "export function b() { e() }", "e.ts": "export const e = () => 1"}
    del files["d/c.ts"]
    put(folder, "b.ts", files["b.ts"], at=1e9)
    put(folder, "e.ts", files["e.ts"])
    put(folder, "a.ts", files["a.ts"], at=1e9)  # touched, not changed
    (folder / "d/c.ts").unlink()
    assert run() == [{"b.ts": "changed", "e.ts": "added", "d/c.ts": "deleted"}]
    del files["e.ts"]
    (folder / "e.ts").unlink()
    assert run() == [{"e.ts": "deleted"}]
    assert run() == []


def test_batches_done_twice(spark, tmp_path):
    events = spark.createDataFrame([("a.ts", "add", "f(1)"), ("gone.ts", "change", None)], "file_path string, event string, content string")
    root = str(tmp_path / "index")
    assert [r.status for r in watch.keep_index(spark, root, events, "x#0").collect()] == ["added"]
    assert watch.keep_index(spark, root, events, "x#0").count() == 0
    assert [r.status for r in watch.keep_index(spark, root, events, "x#1").collect()] == ["unchanged"]
    assert Store(spark, root).versions() == [0, 1]


# Versions -----------------------------------------------------------------------------------------------------------


def test_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"), buckets=8)
    assert store.versions() == [] and store.tables() == {}
    held = spark.range(200).select(F.concat(F.lit("f"), "id").alias("file_path"), F.col("id").alias("x"))
    with store.change() as change:
        change.replace("files", held, "file_path")
        change.replace("symbols", held.select("file_path", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("name")), "file_path")
    reader = store.read("files")
    before = rows(reader, "file_path", "x")
    kept = store.manifest()["tables"]["files"]["folders"]
    new = spark.createDataFrame([("f7", 700), ("new", 1), ("new", 2)], "file_path string, x long")
    with store.change() as change:
        change.upsert("files", new, ["file_path"], version="x")
        assert rows(store.read("files"), "file_path", "x") == before  # nothing is seen of a change that isn't done
    assert change.rewritten["files"] <= 2
    now = store.manifest()["tables"]["files"]["folders"]
    assert sum(now[b] != kept[b] for b in kept) == change.rewritten["files"]
    assert rows(reader, "file_path", "x") == before  # a reader keeps its version
    assert rows(store.read("files"), "file_path", "x") == rows(spark.createDataFrame([(f, 700 if f == "f7" else x) for f, x in before] + [("new", 2)], "file_path string, x long"), "file_path", "x")
    with store.change() as change:
        change.delete(spark.createDataFrame([("f7",), ("f7",), ("none",)], "file_path string"))
    assert change.rewritten["files"] <= 2 and change.rewritten["symbols"] <= 2
    assert store.read("files").count() == 200 and store.read("symbols").where("file_path = 'f7'").count() == 0 and store.read("symbols").count() == 398
    assert store.versions() == [0, 1, 2] and store.read("files", 0).count() == 200 and store.read("files", 1).count() == 201


def test_versions_conflict_and_vacuum(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"), buckets=4)
    held = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "file_path string, x int")
    with store.change() as change:
        change.replace("files", held, "file_path")
    with pytest.raises(Conflict), store.change() as one:
        with store.change() as other:
            other.delete(spark.createDataFrame([("a",)], "file_path string"))
        one.upsert("files", held, ["file_path"])
    assert rows(store.read("files"), "file_path") == [("b",), ("c",)]
    with pytest.raises(ValueError), store.change() as change:
        change.upsert("files", held, ["x"])
    for _ in range(3):
        with store.change() as change:
            change.upsert("files", held, ["file_path"])
    store.vacuum(keep=1)
    assert store.versions() == [4] and rows(store.read("files"), "file_path", "x") == rows(held, "file_path", "x")
    assert store.read("files", buckets=set()).count() == 0
    with store.change() as change:
        change.delete(held.select("file_path"))
    assert store.read("files").count() == 0
