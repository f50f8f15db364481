"""Source files to symbols and references, by extractors that plug in for each language."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.sources.shared import checkpointed, exists

#: A symbol: name, kind, first and last line from 1, signature, body. A reference: name, line, column.
Symbol = tuple[str, str, int, int, str, str]
Reference = tuple[str, int, int]
Extractor = Callable[[str], tuple[list[Symbol], list[Reference]]]

SIGNATURE = 240
ROWS = "path string, lang string, symbol boolean, name string, kind string, start_line int, end_line int, signature string, body string, line int, col int"


def python(source: str) -> tuple[list[Symbol], list[Reference]]:
    """Classes, functions, names that a module assigns to, and calls by the called name. A file that can't be parsed has none."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return [], []
    lines = source.split("\n")
    symbols: list[Symbol] = []
    calls: list[Reference] = []

    def add(name: str, kind: str, node: ast.AST) -> None:
        body = "\n".join(lines[node.lineno - 1 : node.end_lineno])
        symbols.append((name, kind, node.lineno, node.end_lineno, lines[node.lineno - 1].strip()[:SIGNATURE], body))

    top = {id(x) for x in tree.body}
    for node in ast.walk(tree):
        if isinstance(node, ast.ClassDef):
            add(node.name, "class", node)
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            add(node.name, "function", node)
        elif isinstance(node, ast.Assign) and id(node) in top:
            for t in node.targets:
                if isinstance(t, ast.Name):
                    add(t.id, "constant", node)
        elif isinstance(node, ast.AnnAssign) and id(node) in top and isinstance(node.target, ast.Name):
            add(node.target.id, "constant", node)
        elif isinstance(node, ast.Call):
            f = node.func
            if isinstance(f, ast.Name):
                calls.append((f.id, f.lineno, f.col_offset))
            elif isinstance(f, ast.Attribute):
                calls.append((f.attr, f.end_lineno, f.end_col_offset - len(f.attr.encode())))
    return sorted(symbols, key=lambda s: (s[2], s[3], s[0])), sorted(calls, key=lambda c: (c[1], c[2], c[0]))


#: By language.
EXTRACTORS: dict[str, Extractor] = {"python": python}


def extract(files: DataFrame, extractors: dict[str, Extractor] = EXTRACTORS) -> tuple[DataFrame, DataFrame]:
    """symbols (path, lang, name, kind, start_line, end_line, signature, body) and references (path, name, line, col) of files
    (path, lang, content). Languages without an extractor give nothing."""
    return _split(_rows(files, extractors))


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    symbols = rows.where("symbol").select("path", "lang", "name", "kind", "start_line", "end_line", "signature", "body")
    return symbols, rows.where("not symbol").select("path", "name", "line", "col")


def cached_extract(files: DataFrame, folder: str, version: int = 1, extractors: dict[str, Extractor] = EXTRACTORS) -> tuple[DataFrame, DataFrame]:
    """The same, by a cache below the folder: only files whose content it hasn't seen with this version are parsed. A file's rows
    are kept by path and content hash; a file without any has one empty row, so that it isn't parsed again."""
    spark, at = files.sparkSession, f"{folder.rstrip('/')}/version={version}"
    keyed = files.select("path", "lang", F.coalesce("content", F.lit("")).alias("content")).withColumn("hash", F.sha2(F.col("content").cast("binary"), 256))
    schema = f"hash string, {ROWS}"
    none = spark.createDataFrame([], schema)
    known = spark.read.schema(schema).parquet(at) if exists(spark, at) else none
    new = checkpointed(keyed.join(known.select("path", "hash").distinct(), ["path", "hash"], "left_anti"))
    if not new.isEmpty():
        made = new.select("path", "hash").join(_rows(new, extractors), "path", "left").select(*none.columns)
        made.write.mode("append").parquet(at)
        known = spark.read.schema(schema).parquet(at)
    rows = known.join(keyed.select("path", "hash"), ["path", "hash"], "left_semi").where("symbol is not null")
    return _split(rows.drop("hash"))


def _rows(files: DataFrame, extractors: dict[str, Extractor]) -> DataFrame:
    found = dict(extractors)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, lang, content in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                symbols, refs = found[lang](content or "")
                rows += [(path, lang, True, *s, None, None) for s in symbols]
                rows += [(path, lang, False, n, None, None, None, None, None, line, col) for n, line, col in refs]
            kinds = (pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32())
            names = [c.split()[0] for c in ROWS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return files.select("path", "lang", "content").where(F.col("lang").isin(*found)).mapInArrow(each, ROWS)
