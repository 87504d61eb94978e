"""A streaming source of the changes below a folder: files that come, change and go.

An offset is the number of a listing (path, time and size of each file) that the driver keeps in a folder of its own, so
that the changes between two offsets are the difference of two listings, whenever they are asked for: after a restart a
stream goes on from the listing of its last batch, and what happened meanwhile is seen once. A moved file goes and comes.
A file that is back as it was between two listings did not change.

Listings are made where the driver runs, and contents are read by tasks: the folder must be mounted on all of them, and the
folder of listings must outlive the driver. A listing is taken once the folder has been at rest for ``quiet`` milliseconds;
a folder that never rests is taken as it is after ``PATIENCE`` seconds. Listings before the last committed one are deleted.
"""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "folder_changes"
SCHEMA = "file_path string, event string, modified timestamp, content string"
#: Paths that are left out: hidden ones and built ones.
LEFT_OUT = re.compile(r"(?:^|/)(?:\.[^/]+|node_modules|dist)(?:/|$)")
PATIENCE = 10.0
#: Changes that one task reads.
PER_TASK = 200


def listing(folder: str, depth: int) -> dict[str, list[int]]:
    """[time in nanoseconds, size] of each file by its path below the folder."""
    found: dict[str, list[int]] = {}
    waiting = [("", 0)]
    while waiting:
        below, level = waiting.pop()
        try:
            entries = list(os.scandir(os.path.join(folder, below)))
        except OSError:  # gone meanwhile
            continue
        for e in entries:
            path = f"{below}/{e.name}" if below else e.name
            if LEFT_OUT.search(path):
                continue
            try:
                if e.is_dir(follow_symlinks=False):
                    if level < depth:
                        waiting.append((path, level + 1))
                elif e.is_file():
                    s = e.stat()
                    found[path] = [s.st_mtime_ns, s.st_size]
            except OSError:
                continue
    return found


def differences(old: dict[str, list[int]], new: dict[str, list[int]]) -> list[tuple[str, str, int]]:
    """(path, event, time) of what came, changed and went, by path."""
    told = [(path, "add" if path not in old else "change", at[0]) for path, at in new.items() if old.get(path) != at]
    return sorted(told + [(path, "unlink", at[0]) for path, at in old.items() if path not in new])


@dataclass
class Changes(InputPartition):
    changes: list[tuple[str, str, int]]


class FolderReader(DataSourceStreamReader):
    def __init__(self, folder: str, state: str, depth: int, quiet: float, initial: bool):
        self.folder, self.state, self.depth, self.quiet, self.initial = folder, state, depth, quiet, initial

    def _path(self, version: int) -> str:
        return os.path.join(self.state, f"listing-{version}.json")

    def _versions(self) -> list[int]:
        os.makedirs(self.state, exist_ok=True)
        return sorted(int(m[1]) for n in os.listdir(self.state) if (m := re.fullmatch(r"listing-(\d+)\.json", n)))

    def _load(self, version: int) -> dict[str, list[int]]:
        with open(self._path(version), encoding="utf-8", errors="surrogateescape") as f:
            return json.load(f)

    def _save(self, version: int, held: dict[str, list[int]]) -> None:
        """A listing is there whole or not at all."""
        part = f"{self._path(version)}.part"
        with open(part, "w", encoding="utf-8", errors="surrogateescape") as f:
            json.dump(held, f, ensure_ascii=False)
        os.replace(part, self._path(version))

    def _at_rest(self, last: dict[str, list[int]]) -> dict[str, list[int]]:
        held, began = listing(self.folder, self.depth), time.monotonic()
        while held != last and time.monotonic() - began < PATIENCE:
            time.sleep(self.quiet)
            again = listing(self.folder, self.depth)
            if again == held:
                break
            held = again
        return held

    def _begun(self) -> list[int]:
        """The listings that there are, after the first one is made."""
        if not self._versions():
            self._save(0, {} if self.initial else listing(self.folder, self.depth))
        return self._versions()

    def initialOffset(self) -> dict:
        return {"version": self._begun()[0]}

    def latestOffset(self) -> dict:
        version = self._begun()[-1]
        last = self._load(version)
        now = self._at_rest(last)
        if now != last:
            version += 1
            self._save(version, now)
        return {"version": version}

    def partitions(self, start: dict, end: dict) -> list[Changes]:
        told = differences(self._load(start["version"]), self._load(end["version"])) if start != end else []
        return [Changes(told[k : k + PER_TASK]) for k in range(0, len(told), PER_TASK)]

    def read(self, partition: Changes) -> Iterator[tuple]:
        from datetime import datetime

        for path, event, at in partition.changes:
            content = None
            if event != "unlink":
                try:
                    with open(os.path.join(self.folder, path), encoding="utf-8", errors="replace", newline="") as f:
                        content = f.read()
                except OSError:  # gone meanwhile: the next listing tells
                    content = None
            yield path, event, datetime.fromtimestamp(at / 1e9), content

    def commit(self, end: dict) -> None:
        for version in self._versions():
            if version < end["version"]:
                os.remove(self._path(version))


class FolderChanges(DataSource):
    """``file_path, event (add, change, unlink), modified, content``. Options: ``path``, ``listings`` (folder of the source's own), ``depth`` (10), ``quiet`` (500 milliseconds), ``initial`` (false: files that are there at the start are no events)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FolderReader:
        o = self.options
        local = lambda p: re.sub(r"^file:/+", "/", p)
        return FolderReader(local(o["path"]), local(o["listings"]), int(o.get("depth", "10")), int(o.get("quiet", "500")) / 1000, o.get("initial", "false").lower() == "true")
