"""The index of a corpus: built whole, or brought up to date by what changed."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions.paths import language
from quarryline.functions.text import content_hash, line_count
from quarryline.operators import chunks as C
from quarryline.operators import graph, link, mining, parse, search
from quarryline.sources import store


@dataclass
class Index:
    """Tables of an index; all but files, symbols, imports and chunks may be missing."""

    files: DataFrame
    symbols: DataFrame
    imports: DataFrame
    chunks: DataFrame
    edges: DataFrame | None = None
    terms: DataFrame | None = None
    links: DataFrame | None = None
    contents: DataFrame | None = None
    git_churn: DataFrame | None = None
    cochange: DataFrame | None = None
    communities: DataFrame | None = None
    #: After an update: the files whose rows of a table were made anew.
    rewritten: dict[str, DataFrame] = field(default_factory=dict)

    def tables(self) -> dict[str, DataFrame]:
        return {k: v for k, v in self.__dict__.items() if v is not None and k != "rewritten"}

    def stored(self) -> dict[str, DataFrame]:
        """The tables that have rows of files; the others follow from them."""
        return {k: v for k, v in self.tables().items() if k in ("files", "symbols", "imports", "chunks", "terms", "links")}

    def save(self, root: str) -> None:
        for name, t in self.tables().items():
            if name != "contents":
                store.save(t, f"{root}/{name}")


@dataclass
class Hooks:
    """Plugins: functions DataFrame -> DataFrame on files before, and Index -> Index after building."""

    before: list = field(default_factory=list)
    after: list = field(default_factory=list)


def file_table(contents: DataFrame) -> DataFrame:
    held = contents if "language" in contents.columns else contents.withColumn("language", language(F.col("file_path")))
    return held.select("file_path", C.describe_file(F.col("file_path"), F.col("language")).alias("description"), "language", F.current_timestamp().alias("scanned_at"), content_hash(F.col("content")).alias("sha256"), line_count(F.col("content")).alias("line_count"))


def build_index(contents: DataFrame, commits: DataFrame | None = None, hooks: Hooks | None = None, parser=None) -> Index:
    """An index of ``contents(file_path, content)``: scripts are lexed at once, else each table is a plan, which ``save`` runs."""
    for h in hooks.before if hooks else ():
        contents = h(contents)
    files = file_table(contents)
    lexed = store.written(parse.scripts(contents), "scripts")  # three tables are read off it
    symbols = parse.symbols(contents, parser, lexed)
    imports = link.resolve_imports(parse.imports(contents, lexed), files)
    windows = C.chunks(contents)
    links = link.call_links(parse.calls(contents, lexed), symbols, imports)
    index = Index(files, symbols, imports, windows, all_edges(imports, links), search.terms(windows), links, contents)
    if commits is not None:
        tracked = commits.join(files.select("file_path"), "file_path", "left_semi")
        most = symbols.groupBy("file_path").agg(F.max("complexity").alias("complexity"))
        index.git_churn = mining.churn(mining.commit_counts(tracked), most)
        index.cochange = mining.cochange(tracked)
    for h in hooks.after if hooks else ():
        index = h(index)
    return index


def with_communities(index: Index) -> Index:
    """The index with communities of its import graph, made if there are none."""
    if index.communities is None:
        found = graph.communities(graph.import_graph(index.imports))
        numbers = store.numbered(found.select("community").distinct(), "n", "community")
        index.communities = found.join(numbers, "community").select(F.col("id").alias("file_path"), F.concat(F.lit("cluster_"), "n").alias("community_id"))
    return index


def clusters(index: Index) -> DataFrame:
    """``community_id, files``."""
    return with_communities(index).communities.groupBy("community_id").agg(F.array_sort(F.collect_list("file_path")).alias("files"))


def changes(index_files: DataFrame, contents: DataFrame) -> DataFrame:
    """``file_path, status`` of contents against the files of an index."""
    return mining.incremental_diff(index_files, contents.select("file_path", content_hash(F.col("content")).alias("sha256")))


def update_index(index: Index, contents: DataFrame, listing: DataFrame | None = None) -> tuple[Index, DataFrame]:
    """(index, changes): the index of ``contents``, made from one of earlier contents by what changed.

    Without ``listing`` (file_path, sha256) all contents are read to be hashed; with it only those of added and changed files are.
    """
    diff = mining.incremental_diff(index.files, listing) if listing is not None else changes(index.files, contents)
    diff = store.written(diff, "changes")
    fresh = contents.join(diff.where("status IN ('added', 'changed')"), "file_path", "left_semi")
    updated = apply_changes(index, diff, fresh)
    updated.contents = contents
    return updated, diff


def apply_changes(index: Index, diff: DataFrame, fresh: DataFrame) -> Index:
    """The index after ``diff`` (file_path, status: added, changed, deleted or unchanged); ``fresh`` has the contents of added and changed files.

    Tables are kept but for the rows of files that changed, of imports whose target may be another one since files came or
    went, and of calls by names that a changed file declares or declared, or out of files whose imports were resolved anew;
    only these are made again, by equi-joins with the tables. Of a file that didn't change no text is read.
    """
    if index.links is None:
        raise ValueError("an index without links can't be updated; build it again")
    fresh = store.written(fresh.select("file_path", "content"), "fresh")
    stale = diff.where("status IN ('deleted', 'changed')").select("file_path")
    moved = diff.where("status IN ('added', 'deleted')").select("file_path")
    held = {"files": index.files, "symbols": index.symbols, "imports": index.imports, "chunks": index.chunks, "links": index.links}
    if index.terms is not None:
        held["terms"] = index.terms
    kept = store.delete_files(held, stale)
    lexed = store.written(parse.scripts(fresh), "scripts")
    files = kept["files"].unionByName(file_table(fresh))
    new_symbols = store.written(parse.symbols(fresh, lexed=lexed), "new-symbols")
    symbols = kept["symbols"].unionByName(new_symbols)
    again = store.written(link.stale_specifiers(kept["imports"], moved), "stale-imports")
    columns = ("file_path", "specifier", "imported_names", "parse_seq")
    open_imports = kept["imports"].join(again, ["file_path", "specifier"], "left_semi").select(*columns).unionByName(parse.imports(fresh, lexed).select(*columns))
    imports = kept["imports"].join(again, ["file_path", "specifier"], "left_anti").unionByName(link.resolve_imports(open_imports, files))
    names = new_symbols.select("name").union(index.symbols.join(stale, "file_path", "left_semi").select("name")).distinct()
    named = kept["links"].withColumn("name", link.short_name(F.col("callee")))
    touched = named.join(names, "name", "left_semi").select("file_path", "parse_seq").union(named.join(again.select("file_path").distinct(), "file_path", "left_semi").select("file_path", "parse_seq"))
    touched = store.written(touched.distinct(), "stale-calls")
    place = ["file_path", "parse_seq"]
    open_calls = kept["links"].join(touched, place, "left_semi").select("file_path", "callee", "line", "parse_seq").unionByName(parse.calls(fresh, lexed).select("file_path", "callee", "line", "parse_seq"))
    links = kept["links"].join(touched, place, "left_anti").unionByName(link.call_links(open_calls, symbols, imports))
    new_windows = C.chunks(fresh)
    windows = kept["chunks"].unionByName(new_windows)
    terms = kept["terms"].unionByName(search.terms(new_windows)) if "terms" in kept else search.terms(windows)
    changed = store.written(fresh.select("file_path").union(stale).distinct(), "changed")
    rewritten = dict.fromkeys(("files", "symbols", "chunks", "terms"), changed)
    rewritten |= {"imports": changed.union(again.select("file_path")), "links": changed.union(touched.select("file_path"))}
    return Index(files, symbols, imports, windows, all_edges(imports, links), terms, links, rewritten=rewritten)


def all_edges(imports: DataFrame, links: DataFrame) -> DataFrame:
    return link.import_edges(imports).unionByName(link.edges_of(links))


def from_tables(held: dict[str, DataFrame]) -> Index:
    """An index from its stored tables."""
    return Index(edges=all_edges(held["imports"], held["links"]), **held)


def load(spark: SparkSession, root: str) -> Index:
    return Index(**store.load_index(spark, root))
