"""Symbols, imports and calls: of JavaScript and TypeScript from their tokens, of other languages, and of scripts that can't be lexed, by line patterns; routes and commit logs. A parser function may replace both for symbols."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions import script
from quarryline.functions.paths import extension
from quarryline.functions.text import complexity, lines, split_lines

SCRIPT = (".ts", ".tsx", ".js", ".jsx")
#: Lines that a class or a function found by a pattern is taken to span, besides its first.
CLASS_SPAN, FUNCTION_SPAN = 15, 10
ROUTE = r"(?i)app\.(get|post|put|delete)\s*\(\s*['\"](.*?)['\"]"


def _found(all_lines: DataFrame, where: Column, name: Column, kind: str, span: int, exported: Column, order: int) -> DataFrame:
    return all_lines.where(where & (name != "")).select(
        "file_path", name.alias("name"), F.lit(kind).alias("kind"), F.col("line_no").alias("start_line"), F.least(F.col("line_no") + span, F.col("n_lines")).alias("end_line"), exported.alias("is_exported"), F.struct(F.col("line_no"), F.lit(order)).alias("_order")
    )


SCRIPTS = "file_path string, symbols array<struct<name:string,kind:string,start_line:int,end_line:int,is_exported:boolean>>, imports array<struct<specifier:string,imported_names:array<string>>>, calls array<struct<callee:string,line:int>>, content string"


def _nested(rows: Sequence[list[tuple]], kind: pa.ListType) -> pa.Array:
    """Lists of tuples as an array of lists of structs, made field by field."""
    fields = list(kind.value_type)
    held = list(zip(*(one for row in rows for one in row), strict=True)) or [()] * len(fields)
    ends = pa.array(accumulate(map(len, rows), initial=0), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(held, fields, strict=True)], fields=fields), type=kind)


def scripts(files: DataFrame) -> DataFrame:
    """Of each script its ``symbols, imports, calls``, arrays in the order of the source, and ``content``, null but where the script can't be lexed: line patterns read those."""
    rows = files.where(extension(F.col("file_path")).isin(*SCRIPT)).select("file_path", "content")
    kinds = [
        pa.list_(pa.struct([("name", pa.string()), ("kind", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("is_exported", pa.bool_())])),
        pa.list_(pa.struct([("specifier", pa.string()), ("imported_names", pa.list_(pa.string()))])),
        pa.list_(pa.struct([("callee", pa.string()), ("line", pa.int32())])),
    ]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            told: list[tuple] = []
            for path, content in zip(batch.column("file_path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                plain = path.endswith((".js", ".jsx"))
                try:
                    code = script.lex(content or "", not path.endswith(".ts"))
                    told.append((script.symbols(code), script.imports(code, plain), script.calls(code, plain), None))
                except script.NotLexed:
                    told.append(([], [], [], content))
            columns = list(zip(*told, strict=True)) if told else [()] * 4
            held = [_nested(column, kind) for column, kind in zip(columns, kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("file_path"), *held, pa.array(columns[3], pa.string())], ["file_path", "symbols", "imports", "calls", "content"])

    return rows.mapInArrow(batches, SCRIPTS)


def _by_patterns(files: DataFrame, lexed: DataFrame) -> DataFrame:
    """The files that line patterns read: those that are no scripts, and scripts that can't be lexed."""
    others = files.where(~F.coalesce(extension(F.col("file_path")).isin(*SCRIPT), F.lit(False))).select("file_path", "content")
    return others.unionByName(lexed.where("content IS NOT NULL").select("file_path", "content"))


def lexed_symbols(lexed: DataFrame) -> DataFrame:
    told = lexed.select("file_path", F.posexplode("symbols").alias("_k", "s"))
    return told.select("file_path", "s.name", "s.kind", "s.start_line", "s.end_line", "s.is_exported", F.struct(F.col("s.start_line").alias("line_no"), F.col("_k").alias("k")).alias("_order"))


def symbols(files: DataFrame, parser: Callable[[DataFrame], DataFrame] | None = None, lexed: DataFrame | None = None) -> DataFrame:
    """``symbol_id, name, kind, file_path, start_line, end_line, complexity, param_count, is_exported, parse_seq``; of equal ids the first stays.

    ``lexed`` is the result of ``scripts`` where it is at hand.
    """
    if parser:
        found = parser(files)
    else:
        lexed = scripts(files) if lexed is None else lexed
        found = lexed_symbols(lexed).unionByName(pattern_symbols(_by_patterns(files, lexed)))
    bodies = files.select("file_path", split_lines(F.col("content")).alias("_lines"))
    body = F.array_join(F.slice("_lines", F.col("start_line"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))), "\n")
    joined = found.join(bodies, "file_path").withColumn("_body", body).drop("_lines")
    seq = F.row_number().over(Window.partitionBy("file_path").orderBy("_order"))
    first = F.row_number().over(Window.partitionBy("symbol_id").orderBy("_order"))
    return (
        joined.withColumns({"symbol_id": F.concat_ws("#", "file_path", "name"), "parse_seq": seq, "complexity": complexity(F.col("_body")), "param_count": param_count(F.col("name"), F.col("kind"), F.col("_body"))})
        .withColumn("_first", first)
        .where("_first = 1")
        .select("symbol_id", "name", "kind", "file_path", "start_line", "end_line", "complexity", "param_count", "is_exported", "parse_seq")
    )


def pattern_symbols(files: DataFrame) -> DataFrame:
    held = lines(files).withColumn("_ext", extension(F.col("file_path")))
    line, trimmed = F.col("line"), F.trim(F.col("line"))
    script, python, rust, go = F.col("_ext").isin(*SCRIPT), F.col("_ext") == ".py", F.col("_ext") == ".rs", F.col("_ext") == ".go"
    exported = line.rlike(r"^\s*(?:module\.)?exports?\b")
    takes = lambda rx: F.regexp_extract(line, rx, 1)
    not_private = lambda name: ~name.startswith("_")
    rows = (
        (script, takes(r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)"), "CLASS", CLASS_SPAN, exported),
        (script, takes(r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)"), "FUNCTION", FUNCTION_SPAN, exported),
        (script, takes(r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|[A-Za-z_$][\w$]*\s*=>)"), "FUNCTION", FUNCTION_SPAN, exported),
        (python, takes(r"^\s*class\s+([A-Za-z_]\w*)"), "CLASS", CLASS_SPAN, not_private(takes(r"^\s*class\s+([A-Za-z_]\w*)"))),
        (python, takes(r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)"), "FUNCTION", FUNCTION_SPAN, not_private(takes(r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)"))),
        (rust, F.regexp_extract(trimmed, r"^(?:pub\s+)?fn\s+([A-Za-z_]\w*)", 1), "FUNCTION", FUNCTION_SPAN, trimmed.startswith("pub ")),
        (rust, F.regexp_extract(trimmed, r"^(?:pub\s+)?struct\s+([A-Za-z_]\w*)", 1), "CLASS", CLASS_SPAN, trimmed.startswith("pub ")),
        (go, F.regexp_extract(trimmed, r"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)", 1), "FUNCTION", FUNCTION_SPAN, F.regexp_extract(trimmed, r"^func\s+(?:\([^)]*\)\s*)?([A-Z])", 1) != ""),
        (go, F.regexp_extract(trimmed, r"^type\s+([A-Za-z_]\w*)\s+struct", 1), "CLASS", CLASS_SPAN, F.regexp_extract(trimmed, r"^type\s+([A-Z])", 1) != ""),
    )
    found = F.array(*[F.when(where & (name != ""), F.struct(name.alias("name"), F.lit(kind).alias("kind"), F.lit(span).alias("span"), exp.alias("is_exported"), F.lit(k).alias("k"))) for k, (where, name, kind, span, exp) in enumerate(rows)])
    held = held.select("file_path", "line_no", "n_lines", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("s"))
    return held.select("file_path", "s.name", "s.kind", F.col("line_no").alias("start_line"), F.least(F.col("line_no") + F.col("s.span"), F.col("n_lines")).alias("end_line"), "s.is_exported", F.struct("line_no", "s.k").alias("_order"))


def param_count(name: Column, kind: Column, body: Column) -> Column:
    """Parameters of functions: those after the name, else in the first parentheses, else one for a bare arrow; 0 for other kinds."""
    body = F.trim(body)
    quoted = F.regexp_replace(name, r"([\\.\[\]{}()*+?^$|/])", r"\\$1")
    named = F.call_function("regexp_extract", body, F.concat(quoted, F.lit(r"\s*\(([^)]*)\)")), F.lit(1))
    has_named = F.regexp_like(body, F.concat(quoted, F.lit(r"\s*\([^)]*\)")))
    has_first = F.regexp_like(body, F.lit(r"(?:function\s*)?\([^)]*\)"))
    inside = F.when(has_named, named).when(has_first, F.regexp_extract(body, r"(?:function\s*)?\(([^)]*)\)", 1)).otherwise("")
    for _ in range(4):
        inside = F.regexp_replace(inside, r"[\[{][^\[\]{}]*[\]}]", "_")
    count = F.size(F.filter(F.split(inside, ","), lambda p: F.regexp_replace(p, r"\s", "") != ""))
    bare = ~has_named & ~has_first & F.regexp_like(body, F.lit(r"^[a-zA-Z0-9_$]+\s*=>"))
    return F.when(~F.lower(kind).isin("function", "method", "fn"), 0).when(bare, 1).otherwise(count)


def imports(files: DataFrame, lexed: DataFrame | None = None) -> DataFrame:
    """``file_path, specifier, imported_names, parse_seq``, in the order of the source; re-exports and requires count, ``*`` stands for all. Default and namespace imports of scripts name nothing."""
    lexed = scripts(files) if lexed is None else lexed
    told = lexed.select("file_path", F.posexplode("imports").alias("_k", "i")).where("i.specifier <> ''")
    own = told.select("file_path", "i.specifier", "i.imported_names", F.row_number().over(Window.partitionBy("file_path").orderBy("_k")).alias("parse_seq"))
    return own.unionByName(pattern_imports(_by_patterns(files, lexed)))


def pattern_imports(files: DataFrame) -> DataFrame:
    held = lines(files).withColumn("_ext", extension(F.col("file_path")))
    line, script, python = F.col("line"), F.col("_ext").isin(*SCRIPT), F.col("_ext") == ".py"
    source = lambda rx, g=1: F.regexp_extract(line, rx, g)
    names = lambda text: F.filter(F.transform(F.split(text, ","), lambda n: F.regexp_replace(F.trim(n), r"\s+as\s+.*$|^type\s+", "")), lambda n: n != "")
    es = r"^\s*import\s+(?:type\s+)?(.*?)\s+from\s+['\"]([^'\"]+)['\"]"
    braces = F.regexp_extract(line, r"\{([^}]*)\}", 1)
    default = F.regexp_extract(line, r"^\s*import\s+(?:type\s+)?([A-Za-z_$][\w$]*)\s*(?:,|\s+from)", 1)
    es_names = F.concat(F.when((default != "") & (default != "type"), F.array(F.lit("default"))).otherwise(F.array().cast("array<string>")), F.when(line.rlike(r"\*\s+as\s"), F.array(F.lit("*"))).otherwise(F.array().cast("array<string>")), names(braces))
    from_python = r"^\s*from\s+([\w.]+)\s+import\s+(.+)$"
    rows = (
        (script & line.rlike(es), source(es, 2), es_names),
        (script & line.rlike(r"^\s*import\s+['\"]"), source(r"^\s*import\s+['\"]([^'\"]+)['\"]"), F.array().cast("array<string>")),
        (script & line.rlike(r"^\s*export\s+\*\s+from\s+['\"]"), source(r"from\s+['\"]([^'\"]+)['\"]"), F.array(F.lit("*"))),
        (script & line.rlike(r"^\s*export\s+\{[^}]*\}\s+from\s+['\"]"), source(r"from\s+['\"]([^'\"]+)['\"]"), names(braces)),
        (script & line.rlike(r"\brequire\s*\(\s*['\"]"), source(r"\brequire\s*\(\s*['\"]([^'\"]+)['\"]"), F.array(F.lit("*"))),
        (python & line.rlike(from_python), source(from_python), names(F.regexp_replace(source(from_python, 2), r"[()]|#.*$", ""))),
        (python & line.rlike(r"^\s*import\s+[\w.]+"), F.lit("global"), names(source(r"^\s*import\s+([\w., ]+)"))),
    )
    found = F.filter(F.array(*[F.when(where, F.struct(s.alias("specifier"), n.alias("imported_names"), F.lit(k).alias("k"))) for k, (where, s, n) in enumerate(rows)]), lambda x: x.isNotNull())
    told = held.select("file_path", "line_no", F.explode(found).alias("i")).where("i.specifier <> ''")
    return told.select("file_path", "i.specifier", "i.imported_names", F.row_number().over(Window.partitionBy("file_path").orderBy("line_no", "i.k")).alias("parse_seq"))


def calls(files: DataFrame, lexed: DataFrame | None = None) -> DataFrame:
    """``file_path, callee, line, parse_seq``: dotted names of what is called; a call of a call's result is known by its last names."""
    lexed = scripts(files) if lexed is None else lexed
    told = lexed.select("file_path", F.posexplode("calls").alias("_k", "c"))
    return told.select("file_path", "c.callee", "c.line", (F.col("_k") + 1).alias("parse_seq")).unionByName(pattern_calls(_by_patterns(files, lexed)))


def pattern_calls(files: DataFrame) -> DataFrame:
    """Dotted names before parentheses, without declarations and control words."""
    held = lines(files)
    code = F.regexp_replace(F.regexp_replace("line", r"//.*$|#.*$", ""), r"\b(?:async\s+)?(?:function\s*\*?|def|func|fn|class)\s+[\w$]+\s*\(", "; (")
    names = F.regexp_extract_all(code, F.lit(r"((?:[A-Za-z_$][\w$]*\.)*[A-Za-z_$][\w$]*)\s*\("), F.lit(1))
    kept = F.filter(names, lambda n: ~n.isin("if", "for", "while", "switch", "catch", "return", "function", "typeof", "await", "elif", "with", "match", "and", "or", "not", "in", "print", "super"))
    told = held.select("file_path", F.col("line_no").alias("line"), F.posexplode(kept).alias("_k", "callee"))
    return told.select("file_path", "callee", "line", F.row_number().over(Window.partitionBy("file_path").orderBy("line", "_k")).alias("parse_seq"))


def flat_exports(files: DataFrame) -> DataFrame:
    """``file_path, kind, name``: exported names, module basenames imported, and Python definitions, by whole-text patterns."""
    takes = lambda kind, rx, g: F.transform(F.regexp_extract_all("content", F.lit(rx), F.lit(g)), lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))
    script, python = extension(F.col("file_path")).isin(*SCRIPT), extension(F.col("file_path")) == ".py"
    js = F.concat(takes("export", r"export\s+(const|class|function|interface|type|async\s+function)\s+([a-zA-Z0-9_]+)", 2), takes("import", r"import\s+.*?\s+from\s+['\"](.*?)['\"]", 1))
    py = F.concat(takes("export", r"def\s+([a-zA-Z0-9_]+)\s*\(", 1), takes("export", r"class\s+([a-zA-Z0-9_]+)\s*:", 1), takes("import", r"(?:import\s+|from\s+)([a-zA-Z0-9_.]+)", 1))
    told = files.select("file_path", F.explode(F.when(script, js).when(python, py)).alias("x"))
    return told.select("file_path", "x.kind", F.when(F.col("x.kind") == "import", F.element_at(F.split("x.name", "/"), -1)).otherwise(F.col("x.name")).alias("name"))


def routes(files: DataFrame, pattern: str = ROUTE, path: str = "file_path", content: str = "content") -> DataFrame:
    """``file_path, seq, method, route`` for each registration of a route."""
    pairs = F.arrays_zip(F.regexp_extract_all(content, F.lit(pattern), F.lit(1)).alias("m"), F.regexp_extract_all(content, F.lit(pattern), F.lit(2)).alias("r"))
    return files.select(F.col(path).alias("file_path"), F.posexplode(pairs).alias("seq", "x")).select("file_path", "seq", F.upper("x.m").alias("method"), F.col("x.r").alias("route"))


def commit_log(log: DataFrame, stream: str | None = None) -> DataFrame:
    """``commit_id, file_path`` from rows ``line_no, line`` of a log of hashes and names; blanks and commits without files vanish.

    ``stream`` names a column that tells logs apart; each log is one ordered sequence, many logs run in parallel.
    """
    line = F.trim("line")
    by = [stream] if stream else []
    order = Window.partitionBy(*by).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    hashed = F.when(line.rlike(r"(?i)^([0-9a-f]{40}|[0-9a-f]{64})$"), line)
    told = log.where(line != "").select(*by, "line_no", line.alias("file_path"), hashed.alias("_hash")).withColumn("commit_id", F.last("_hash", ignorenulls=True).over(order))
    return told.where("_hash IS NULL AND commit_id IS NOT NULL").select(*by, "commit_id", "file_path")


