"""Tables with versions: rows in hash buckets, and manifests that say which files a version is made of.

A manifest names for each table its schema and the folder of each bucket. Writers make new folders beside the old ones and
then put the next manifest in its place by one rename, so that a version is there whole or not at all; of two writers that
began from one version the second is refused. An upsert or a delete rewrites the buckets that hold its keys; all others are
taken over as they are. Readers keep the files of the version they opened until ``vacuum`` is told to let go of it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.sources.store import upsert

BUCKETS = 16


class Conflict(RuntimeError):
    """Another writer made the next version first."""


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root = spark, root.rstrip("/")
        self._buckets = buckets

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _list(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._list(f"{self.root}/manifests") if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "buckets", "note", "tables": {name: {"schema", "by", "folders": {bucket: folder}}}}; that of the last version by default, an empty one before the first."""
        known = self.versions()
        version = (known[-1] if known else -1) if version is None else version
        if version < 0:
            return {"version": -1, "buckets": self._buckets, "note": "", "tables": {}}
        fs, p = self._fs(f"{self.root}/manifests/{version}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, name: str, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """A table of a version, or some of its buckets."""
        return self._table(self.manifest(version), name, buckets)

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        held = self.manifest(version)
        return {name: self._table(held, name) for name in held["tables"]}

    def _table(self, held: dict, name: str, buckets: set[int] | None = None) -> DataFrame:
        told = held["tables"][name]
        schema = T.StructType.fromJson(told["schema"])
        folders = [f"{self.root}/{path}" for b, path in told["folders"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    @contextmanager
    def change(self, note: str = "") -> Iterator[Change]:
        """What is changed within it becomes the next version, all together."""
        change = Change(self, self.manifest())
        yield change
        change.commit(note)

    def vacuum(self, keep: int = 2) -> None:
        """Deletes manifests but the last ``keep``, and the folders that none of these names."""
        known = self.versions()
        held = {path for v in known[-keep:] for t in self.manifest(v)["tables"].values() for path in t["folders"].values()}
        for v in known[:-keep]:
            fs, p = self._fs(f"{self.root}/manifests/{v}.json")
            fs.delete(p, True)
        runs = {path.rpartition("/")[0] for path in held}
        for name in self._list(f"{self.root}/data"):
            for run in self._list(f"{self.root}/data/{name}"):
                below = f"data/{name}/{run}"
                gone = [below] if below not in runs else [f"{below}/{b}" for b in self._list(f"{self.root}/{below}") if b.startswith("_bucket=") and f"{below}/{b}" not in held]
                for path in gone:
                    fs, p = self._fs(f"{self.root}/{path}")
                    fs.delete(p, True)


class Change:
    """A version in the making; ``rewritten`` counts the buckets written anew of each table."""

    def __init__(self, store: Store, base: dict):
        self.store, self.base = store, base
        self.tables = {name: dict(t) for name, t in base["tables"].items()}
        self.rewritten: dict[str, int] = {}

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.base["buckets"])).cast("int")

    def _buckets_of(self, keys: DataFrame, by: str) -> set[int]:
        return {r["b"] for r in keys.select(self._bucket(F.col(by)).alias("b")).distinct().collect()}  # at most one row for each bucket

    def _write(self, name: str, rows: DataFrame, by: str) -> dict[str, str]:
        run = f"data/{name}/{uuid.uuid4().hex}"
        dealt = rows.withColumn("_bucket", self._bucket(F.col(by)))
        dealt.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.store.root}/{run}")
        return {n.removeprefix("_bucket="): f"{run}/{n}" for n in self.store._list(f"{self.store.root}/{run}") if n.startswith("_bucket=")}

    def replace(self, name: str, rows: DataFrame, by: str) -> None:
        """The whole table, in place of what was there."""
        folders = self._write(name, rows, by)
        self.tables[name] = {"schema": rows.schema.jsonValue(), "by": by, "folders": folders}
        self.rewritten[name] = len(folders)

    def rewrite(self, name: str, rows: DataFrame, keys: DataFrame) -> None:
        """The buckets that hold ``keys`` (a column named as the table's key) from ``rows``, which has all rows of these buckets."""
        told = self.tables[name]
        wanted = self._buckets_of(keys, told["by"])
        folders = self._write(name, rows.where(self._bucket(F.col(told["by"])).isin(*wanted)), told["by"]) if wanted else {}
        kept = {b: path for b, path in told["folders"].items() if int(b) not in wanted}
        self.tables[name] = told | {"folders": kept | folders}
        self.rewritten[name] = len(wanted)

    def _old(self, name: str, wanted: set[int]) -> DataFrame:
        return self.store._table({"tables": self.tables}, name, wanted)

    def upsert(self, name: str, new: DataFrame, keys: list[str], version: str | None = None) -> None:
        """One row for each key, the new one before the old one (see ``store.upsert``); keys hold the column that deals rows to buckets."""
        by = self.tables[name]["by"]
        if by not in keys:
            raise ValueError(f"keys must hold {by}")
        wanted = self._buckets_of(new, by)
        self.rewrite(name, upsert(self._old(name, wanted), new, keys, version), new)

    def delete(self, gone: DataFrame, names: list[str] | None = None) -> None:
        """The rows of the keys in ``gone`` go from all tables that are dealt by its column."""
        (by,) = gone.columns
        keys = gone.distinct()
        for name in names or [n for n, t in self.tables.items() if t["by"] == by]:
            wanted = self._buckets_of(keys, by)
            self.rewrite(name, self._old(name, wanted).join(keys, by, "left_anti"), keys)

    def commit(self, note: str) -> int:
        """Puts the next manifest in its place."""
        version = self.base["version"] + 1
        fs, path = self.store._fs(f"{self.store.root}/manifests/{version}.json")
        _, part = self.store._fs(f"{self.store.root}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(part, True)
        out.write(json.dumps({"version": version, "buckets": self.base["buckets"], "note": note, "tables": self.tables}).encode())
        out.close()
        if fs.exists(path) or not fs.rename(part, path):
            fs.delete(part, False)
            raise Conflict(f"version {version} is there already")
        return version
