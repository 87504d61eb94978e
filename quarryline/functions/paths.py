"""Columns over paths and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by extension, and suffixes that an import may leave out, in the order of trying.
LANGUAGES = {
    ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".json": "json", ".py": "python", ".rs": "rust", ".go": "go",
    ".java": "java", ".cs": "csharp", ".cpp": "cpp", ".h": "cpp", ".html": "html", ".css": "css", ".md": "markdown",
}
IMPORT_SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def language(path: Column) -> Column:
    """Language by extension; null for other extensions."""
    return F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])[extension(path)]


def short_language(path: Column) -> Column:
    """Label used by the language qualifier: ts and tsx are ts, js and jsx are js, others their extension."""
    ext = F.lower(F.element_at(F.split(path, r"\."), -1))
    return F.when(ext.isin("ts", "tsx"), "ts").when(ext.isin("js", "jsx"), "js").otherwise(ext)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The last segment without its extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def dirname(path: Column) -> Column:
    """All before the last slash; ``.`` without one."""
    return F.when(F.contains(path, F.lit("/")), F.left(path, F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1)).otherwise(F.lit("."))


def normalize_path(path: Column) -> Column:
    """Resolves ``.`` and ``..`` and doubled slashes; a leading slash goes; ``..`` beyond the root stays."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")

    def step(done: Column, p: Column) -> Column:
        up = (p == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != "..")
        return F.when(up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p)))

    return F.array_join(F.aggregate(parts, empty, step), "/")


def import_candidates(file_path: Column, specifier: Column) -> Column:
    """Paths that a relative import may mean, in the order of trying."""
    base = F.when(specifier.startswith("/"), specifier).otherwise(F.concat(dirname(file_path), F.lit("/"), specifier))
    return F.array(*[normalize_path(F.concat(base, F.lit(s))) for s in IMPORT_SUFFIXES])


def path_suffixes(path: Column) -> Column:
    """The path and all its suffixes that begin after a slash, so that suffix tests become equality."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))


def node_id(path: Column) -> Column:
    """A path as a name for graph languages."""
    return F.regexp_replace(path, "[^a-zA-Z0-9]", "_")


def url_parts(url: Column) -> Column:
    """Struct of scheme, host and path of an address; empty strings where a part is missing."""
    part = lambda rx: F.coalesce(F.regexp_extract(url, rx, 1), F.lit(""))
    return F.struct(part(r"^([A-Za-z][A-Za-z0-9+.-]*)://").alias("scheme"), part(r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)").alias("host"), part(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)").alias("path"))


def repository_parts(url: Column) -> Column:
    """Owner, repository, branch and file of a hosted-repository address in its blob, raw, tree or short form."""
    path = F.regexp_replace(F.regexp_replace(url, r"^(?:[a-z]+://)?(?:www\.)?[^/]+/?", ""), r"[?#].*$", "")
    raw = F.regexp_extract(url, r"^(?:[a-z]+://)?(raw\.)", 1) != ""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    kind = F.coalesce(F.try_element_at(parts, F.lit(3)), F.lit(""))
    marked = kind.isin("blob", "tree", "raw")
    at = F.when(raw, 3).when(marked, 4).otherwise(0)
    branch = F.when(at > 0, F.try_element_at(parts, F.greatest(at, F.lit(1))))
    rest = F.when(at > 0, F.array_join(F.slice(parts, at + 1, F.size(parts) + 1), "/"))
    return F.struct(F.try_element_at(parts, F.lit(1)).alias("owner"), F.regexp_replace(F.try_element_at(parts, F.lit(2)), r"\.git$", "").alias("repo"), F.coalesce(branch, F.lit("main")).alias("branch"), F.coalesce(rest, F.lit("")).alias("file_path"))
