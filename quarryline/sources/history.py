"""Git history as a batch source: ranges of commits, each read by a task of its own.

The driver asks for the last commit and for how many there are; every task runs its own log over one range and streams it.
The last commit is pinned, so that commits which come meanwhile move no range. The repository must be where tasks run.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "git_history"
SCHEMA = "commit_id string, author string, authored timestamp, position long, file_seq int, file_path string"
PER_TASK = 5000
#: File names of one commit, in ``git_lines``.
MOST_FILES = 1 << 24


@dataclass
class Commits(InputPartition):
    last: str
    skip: int
    n: int


def _git(root: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True)
    return done.stdout.strip() if done.returncode == 0 else ""


class HistoryReader(DataSourceReader):
    def __init__(self, root: str, per_task: int):
        self.root, self.per_task = root, per_task

    def partitions(self) -> list[Commits]:
        last = _git(self.root, "rev-parse", "--verify", "HEAD")
        n = int(_git(self.root, "rev-list", "--count", last) or 0) if last else 0
        return [Commits(last, skip, min(self.per_task, n - skip)) for skip in range(0, n, self.per_task)] or [Commits("", 0, 0)]

    def read(self, partition: Commits) -> Iterator[tuple]:
        if not partition.n:
            return
        command = ["git", "-C", self.root, "-c", "core.quotePath=false", "log", "-z", "--name-only", "--format=%x01%H%x02%an%x02%aI", f"--skip={partition.skip}", f"--max-count={partition.n}", partition.last]
        with subprocess.Popen(command, stdout=subprocess.PIPE) as run:
            position, commit, author, at, seq, rest = partition.skip - 1, "", "", None, 0, b""
            while data := run.stdout.read(1 << 16):
                *parts, rest = (rest + data).split(b"\0")
                for part in parts:
                    for piece in part.decode("utf-8", "replace").lstrip("\n").split("\n"):
                        if piece.startswith("\x01"):
                            commit, author, when = piece[1:].split("\x02")
                            at, position, seq = datetime.fromisoformat(when), position + 1, 0
                        elif piece:
                            yield commit, author, at, position, seq, piece
                            seq += 1
        if run.returncode:
            raise RuntimeError(f"git log ended with {run.returncode}")


class GitHistory(DataSource):
    """``commit_id, author, authored, position (0 for the last commit), file_seq, file_path``: one row for each file of a commit. Options: ``path``, ``commits`` (of a task)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HistoryReader:
        return HistoryReader(re.sub(r"^file:/+", "/", self.options["path"]), int(self.options.get("commits", PER_TASK)))


def git_history(spark: SparkSession, root: str, commits: int = PER_TASK) -> DataFrame:
    """Files of all commits of a repository; none without history."""
    spark.dataSource.register(GitHistory)
    return spark.read.format(NAME).option("path", root).option("commits", commits).load()


def git_lines(history: DataFrame) -> DataFrame:
    """``line_no, line``: history as a log of hashes and names, in order; numbers have gaps."""
    begin = F.col("position") * MOST_FILES
    heads = history.where("file_seq = 0").select(begin.alias("line_no"), F.col("commit_id").alias("line"))
    return heads.unionByName(history.select((begin + F.col("file_seq") + 1).alias("line_no"), F.col("file_path").alias("line")))
