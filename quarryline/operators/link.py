"""From names to places: imports to files, calls to their caller and callee."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.paths import dirname, import_candidates, normalize_path, path_suffixes
from quarryline.sources.store import written


#: Ranges of a key that each of its places may meet.
FEW_RANGES = 32


def resolve_imports(imports: DataFrame, files: DataFrame, order: str = "file_path") -> DataFrame:
    """``imports`` with ``target`` and ``resolved``.

    A relative specifier takes the first of its candidate paths that exists; else any specifier takes the first file, by
    ``order``, whose path ends with it after a slash. Suffix tests are equality on all suffixes of the paths, so that
    both steps are equi-joins. What is not found keeps its specifier as target. What an import means depends on its folder
    and its specifier, so each such pair is resolved once; the pairs are tables, so that few of them are broadcast.
    """
    folder = F.when(F.col("file_path").isNull(), F.lit(None).cast("string")).when(F.col("specifier").startswith("."), dirname(F.col("file_path"))).otherwise("")
    placed = imports.withColumn("_folder", folder)
    specs = written(placed.select("_folder", "specifier").distinct(), "specifiers")
    known = files.select(F.col("file_path").alias("_path"), F.col(order).alias("_order"))
    relative = specs.where(F.col("specifier").startswith(".") | F.col("specifier").startswith("/"))
    tried = relative.select("_folder", "specifier", F.posexplode(import_candidates(F.concat("_folder", F.lit("/x")), F.col("specifier"))).alias("_k", "_path"))
    by_path = tried.join(known, "_path").groupBy("_folder", "specifier").agg(F.min_by("_path", "_k").alias("_first"))
    wanted = F.when(F.col("specifier").startswith("."), F.lit(None).cast("string")).otherwise(normalize_path(F.col("specifier")))
    asked = written(specs.select(wanted.alias("_ending")).where("_ending IS NOT NULL").distinct(), "endings")
    last = lambda path: F.substring_index(path, "/", -1).alias("_name")
    alike = known.withColumn("_name", last("_path")).join(asked.select(last("_ending")).distinct(), "_name", "left_semi")  # a suffix ends as its path does
    ends = alike.select(F.explode(path_suffixes(F.col("_path"))).alias("_ending"), "_path", "_order").join(asked, "_ending", "left_semi")
    endings = ends.groupBy("_ending").agg(F.min(F.struct("_order", "_path")).alias("_m")).select("_ending", F.col("_m._path").alias("_by_ending"))
    found = specs.withColumn("_ending", wanted).join(by_path, ["_folder", "specifier"], "left").join(endings, "_ending", "left")
    resolved = written(found.select("_folder", "specifier", F.coalesce("_first", "_by_ending").alias("_target")), "resolved")
    others = [c for c in imports.columns if c not in ("file_path", "specifier")]
    told = placed.join(resolved, ["_folder", "specifier"], "left").select("file_path", "specifier", *others, "_target")
    return told.withColumns({"target": F.coalesce("_target", "specifier"), "resolved": F.col("_target").isNotNull()}).drop("_target")


def _pieces(low: Column, high: Column) -> Column:
    """The range as aligned stretches of 1, 2, 4 ... places, at most two of a length: an array of (level, bin), where a bin holds the places that are it after ``level`` halvings."""
    halved = lambda x, k: F.call_function("shiftright", x, k)
    begin, end = lambda k: -halved(-low, k), lambda k: halved(high + 1, k)
    piece = lambda when, k, at: F.when(when, F.struct(k.alias("level"), at.alias("bin")))
    at_level = lambda k: F.array(piece((begin(k) < end(k)) & (F.pmod(begin(k), F.lit(2)) == 1), k, begin(k)), piece((begin(k) < end(k)) & (F.pmod(end(k), F.lit(2)) == 1), k, end(k) - 1))
    levels = F.sequence(F.lit(0), F.length(F.bin(high - low + 1)) - 1)
    return F.filter(F.flatten(F.transform(levels, at_level)), lambda x: x.isNotNull())


def first_container(points: DataFrame, ranges: DataFrame, *, key: str, at: str, low: str, high: str, order: list[str], keep: list[str], point_id: list[str]) -> DataFrame:
    """Each point with the first range, by ``order``, of its ``key`` that contains the integer ``at``; points without one keep nulls.

    Distinct places are looked up. A place of a key with few ranges meets them all; the ranges of other keys are cut into
    aligned pieces, each piece keeps its first range, and a place meets one piece of each length at most. So all joins are
    equi-joins, and no key costs its places times its ranges.
    """
    held = ranges.select(F.col(key).alias("_key"), F.col(low).cast("long").alias("_low"), F.col(high).cast("long").alias("_high"), F.struct(*[F.col(o) for o in order], *[F.col(k) for k in keep]).alias("_r")).where("_low <= _high")
    few = F.col("_n") <= FEW_RANGES
    whole = F.array(F.struct(F.lit(-1).alias("level"), F.lit(0).cast("long").alias("bin")))
    cut = held.join(held.groupBy("_key").agg(F.count("*").alias("_n")), "_key").withColumn("_p", F.explode(F.when(few, whole).otherwise(_pieces(F.col("_low"), F.col("_high")))))
    pieces = cut.groupBy("_key", F.col("_p.level").alias("_level"), F.col("_p.bin").alias("_bin"), F.when(few, F.col("_low")).alias("_low"), F.when(few, F.col("_high")).alias("_high")).agg(F.min("_r").alias("_r"))
    levels = pieces.groupBy("_key").agg(F.collect_set("_level").alias("_levels"))  # 64 at most
    places = points.select(F.col(key).alias("_key"), F.col(at).cast("long").alias("_at")).distinct().join(levels, "_key").select("_key", "_at", F.explode("_levels").alias("_level"))
    placed = places.withColumn("_bin", F.when(F.col("_level") < 0, F.lit(0)).otherwise(F.call_function("shiftright", F.col("_at"), F.col("_level"))))
    met = placed.join(pieces, ["_key", "_level", "_bin"]).where("_level >= 0 OR _at BETWEEN _low AND _high").groupBy("_key", "_at").agg(F.min("_r").alias("_r"))
    first = points.join(met, (F.col(key) == F.col("_key")) & (F.col(at).cast("long") == F.col("_at")), "left").groupBy(*point_id).agg(F.min("_r").alias("_r"))
    return first.select(*point_id, *[F.col("_r")[k].alias(k) for k in keep])


def callers(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """``file_path, parse_seq, callee, line, src``: the first symbol of the file that spans the line, else the file."""
    ranges = symbols.select("file_path", "start_line", "end_line", F.col("parse_seq").alias("_seq"), "symbol_id")
    found = first_container(calls, ranges, key="file_path", at="line", low="start_line", high="end_line", order=["_seq"], keep=["symbol_id"], point_id=["file_path", "parse_seq", "callee", "line"])
    return found.select("file_path", "parse_seq", "callee", "line", F.coalesce("symbol_id", "file_path").alias("src"))


def short_name(callee: Column) -> Column:
    """What stands after the last dot."""
    return F.element_at(F.split(callee, r"\."), -1)


def call_links(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """``file_path, parse_seq, callee, line, src, dst`` of each call. A callee is an exported symbol of that name: of the same file before those of imported files before any; unknown names stay bare.

    Local symbols count even if they are not exported. Each rank is an aggregate of the symbols by its key and an equi-join
    with at most one row of it for each call (a row for each import, for imported files), so that names which many files
    define meet no list of them.
    """
    sites = callers(calls, symbols).withColumn("name", short_name(F.col("callee")))
    by = F.struct("file_path", "parse_seq", "symbol_id")
    known = symbols.join(calls.select(short_name(F.col("callee")).alias("name")).distinct(), "name", "left_semi")
    local = known.groupBy("file_path", "name").agg(F.min(by)["symbol_id"].alias("_local"))
    exported = known.where("is_exported")
    by_file = exported.groupBy("file_path", "name").agg(F.min(by).alias("_e"))
    imported = imports.where("resolved").select("file_path", "target").distinct()
    near = imported.join(by_file.withColumnRenamed("file_path", "target"), "target").groupBy("file_path", "name").agg(F.min("_e")["symbol_id"].alias("_near"))
    any_ = exported.groupBy("name").agg(F.min(by)["symbol_id"].alias("_any"))
    met = sites.join(local, ["file_path", "name"], "left").join(near, ["file_path", "name"], "left").join(any_, "name", "left")
    return met.select("file_path", "parse_seq", "callee", "line", "src", F.coalesce("_local", "_near", "_any", "name").alias("dst"))


def edges_of(links: DataFrame) -> DataFrame:
    """``src, dst, edge_type, line`` of call links, each once."""
    return links.select("src", "dst", F.lit("calls").alias("edge_type"), "line").distinct()


def call_edges(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    return edges_of(call_links(calls, symbols, imports))


def stale_specifiers(imports: DataFrame, moved: DataFrame) -> DataFrame:
    """``file_path, specifier`` of the imports whose target may be another one when the files ``moved`` (file_path) come or go: the target goes, a candidate path or a path that ends with the specifier comes or goes."""
    specs = imports.select("file_path", "specifier", "target").distinct()
    gone = specs.join(moved.select(F.col("file_path").alias("target")), "target", "left_semi")
    relative = specs.where(F.col("specifier").startswith(".") | F.col("specifier").startswith("/"))
    tried = relative.select("file_path", "specifier", F.explode(import_candidates(F.col("file_path"), F.col("specifier"))).alias("_path")).join(moved.select(F.col("file_path").alias("_path")), "_path", "left_semi")
    endings = moved.select(F.explode(path_suffixes(F.col("file_path"))).alias("_ending")).distinct()
    ended = specs.where(~F.col("specifier").startswith(".")).withColumn("_ending", normalize_path(F.col("specifier"))).join(endings, "_ending", "left_semi")
    return gone.select("file_path", "specifier").union(tried.select("file_path", "specifier")).union(ended.select("file_path", "specifier")).distinct()


def import_edges(imports: DataFrame) -> DataFrame:
    return imports.select(F.col("file_path").alias("src"), F.col("target").alias("dst"), F.lit("imports").alias("edge_type"), F.lit(None).cast("int").alias("line")).distinct()


def replace_files(stored: DataFrame, new: DataFrame, key: str = "file_path") -> DataFrame:
    """Stored rows of files that ``new`` does not have, and the new rows."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def overlapping_symbol(results: DataFrame, symbols: DataFrame, result_id: list[str]) -> DataFrame:
    """Each result (file_path, start_line, end_line) with the last function, method or class that overlaps it, else the first symbol that does, else nulls."""
    held = symbols.select(F.col("file_path").alias("_file"), F.col("start_line").alias("_s"), F.col("end_line").alias("_e"), "name", "kind", "symbol_id", "parse_seq")
    met = results.join(held, (F.col("file_path") == F.col("_file")) & (F.col("_s") <= F.col("end_line")) & (F.col("_e") >= F.col("start_line")), "left")
    preferred = F.lower("kind").isin("function", "method", "class", "export")
    order = Window.partitionBy(*result_id).orderBy(preferred.desc_nulls_last(), F.when(preferred, -F.col("parse_seq")).otherwise(F.col("parse_seq")))
    picked = met.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return picked.withColumns({"symbol_start": F.col("_s"), "symbol_end": F.col("_e")}).drop("_n", "_file", "_s", "_e", "parse_seq")


def first_mention(items: DataFrame, chunks: DataFrame, item_id: list[str], name: str = "name", width: int = 150) -> DataFrame:
    """Each item (file_path, name) with the beginning of the first window of its file that mentions the name in any case."""
    held = chunks.select(F.col("file_path").alias("_file"), "chunk_seq", "content")
    met = items.join(held, (F.col("file_path") == F.col("_file")) & F.contains(F.lower("content"), F.lower(name)), "left")
    return met.groupBy(*item_id).agg(F.substring(F.min_by("content", "chunk_seq"), 1, width).alias("snippet"))


def export_edges(imports: DataFrame, exports: DataFrame) -> DataFrame:
    """``src, dst``: for each import its first export, by file and name, whose name it names or whose file's path it holds.

    Names meet by equality. Paths meet by the suffixes of the import against the files, so that both are equi-joins.
    """
    held = imports.select("file_path", "specifier").distinct()
    ids = exports.select(F.col("name"), F.col("file_path").alias("_file"), F.struct("file_path", "name", "symbol_id").alias("_e"))
    by_name = held.join(ids, F.col("specifier") == F.col("name")).select(held.file_path, "specifier", "_e")
    by_path = held.select("file_path", "specifier", F.explode(path_suffixes(F.col("specifier"))).alias("_file")).join(ids, "_file").select("file_path", "specifier", "_e")
    first = by_name.unionByName(by_path).groupBy("file_path", "specifier").agg(F.min("_e").alias("_e"))
    return first.select(F.col("file_path").alias("src"), F.col("_e.symbol_id").alias("dst")).distinct()
