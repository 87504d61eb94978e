"""Rules of users as a table function: Python that looks at one file at a time, beside rules that are columns.

A rule's ``check`` takes a path and a text and gives (line, description) of what it finds. Registered rules are one table
function, ``code_issues(file_path, content)``, for lateral joins in SQL and with DataFrames; files go to it in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = "code_issues"
SCHEMA = "rule string, category string, line int, description string"
Check = Callable[[str, str], Iterable[tuple[int, str]]]


@dataclass(frozen=True)
class FileRule:
    id: str
    name: str
    category: str
    check: Check


def table_function(rules: list[FileRule]):
    """The rules as a table function of a path and a text."""

    class CodeIssues:
        def eval(self, file_path: str, content: str) -> Iterator[tuple]:
            if content is None:
                return
            for rule in rules:
                for line, description in rule.check(file_path or "", content):
                    yield rule.id, rule.category, line, description

    return F.udtf(CodeIssues, returnType=SCHEMA)


def register(spark: SparkSession, rules: list[FileRule] | None = None, name: str = NAME) -> None:
    """Makes the rules a table function of the session, for SQL: ``SELECT ... FROM files, LATERAL code_issues(file_path, content)``."""
    spark.udtf.register(name, table_function(file_rules() if rules is None else rules))


def run_file_rules(files: DataFrame, rules: list[FileRule] | None = None) -> DataFrame:
    """``rule, category, file_path, line, description``."""
    found = table_function(file_rules() if rules is None else rules)(F.col("file_path").outer(), F.col("content").outer())
    return files.select("file_path", "content").lateralJoin(found).select("rule", "category", "file_path", "line", "description")


def _lines(when: Callable[[str], object], description: str) -> Check:
    return lambda path, content: ((k, description) for k, line in enumerate(content.split("\n"), 1) if when(line))


def _file(when: Callable[[str, str], object], description: str) -> Check:
    return lambda path, content: [(1, description)] if when(path, content) else []


BRANCHES = re.compile(r"if\s*\(|else\s+if|for\s*\(|while\s*\(|catch\s*\(|switch\s*\(", re.A)
NAMED = re.compile(r"(?:const|let)\s+([a-zA-Z0-9_$]+)", re.A)


def _two_styles(line: str) -> bool:
    name = m[1] if (m := NAMED.search(line)) else ""
    return "_" in name and re.search("[A-Z]", name) is not None and not re.match(r"[A-Z][A-Z0-9_]*\Z", name)


def file_rules() -> list[FileRule]:
    """The optional rules of ``rules.doctor_rules``, each as a function of one file."""
    asynchronous = _lines(lambda line: "async " in line, "Asynchronous function in a file without await.")
    return [
        FileRule("async", "Promises without await", "Robustness", lambda path, content: [] if "await " in content else asynchronous(path, content)),
        FileRule("complexity", "Branches in a line", "Maintainability", _lines(lambda line: len(BRANCHES.findall(line)) >= 3, "Three branches or more in a line.")),
        FileRule("coupling", "Imports of a file", "Architecture Integrity", _file(lambda path, content: len(re.findall(r"(?m)^import ", content)) > 15, "More than 15 imports.")),
        FileRule("docs", "Comments of TypeScript files", "Documentation", _file(lambda path, content: path.endswith(".ts") and "/**" not in content, "No documentation comment.")),
        FileRule("naming", "Names in one style", "Styling", _lines(_two_styles, "Name mixes two styles.")),
        FileRule("rules-security", "Use of eval", "Auditing Standards", _lines(lambda line: "eval(" in line and "// safe-eval" not in line, "Code is made from text.")),
        FileRule("size", "Length of files", "Structure", _file(lambda path, content: content.count("\n") >= 500, "More than 500 lines.")),
    ]
