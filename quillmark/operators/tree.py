"""Symbol trees and diagnostics as flat tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overloads(siblings: DataFrame, parent: str, name: str, order: list[str]) -> DataFrame:
    """siblings with overload_idx, the 0-based place among equal names of one parent, null where the name is alone."""
    w = Window.partitionBy(parent, name)
    n = F.count("*").over(w)
    return siblings.withColumn("overload_idx", F.when(n > 1, F.row_number().over(w.orderBy(*order)) - 1))


def matches_name_path(path: Column, pattern: str, substring: bool = False, overloads: Column | None = None) -> Column:
    """An array of names ends in the pattern's parts; a leading / asks for all of it; substring for the last part only.

    [i] at a part asks for that overload: overloads holds, for each name of the path, its place among its equals, null where it
    is alone. Without them no [i] matches.
    """
    whole, parts = pattern.startswith("/"), pattern.strip("/").split("/")
    n = len(parts)
    ok = (F.size(path) == n) if whole else (F.size(path) >= n)
    for k, part in enumerate(parts):
        m = re.fullmatch(r"(.*)\[(\d+)\]", part, re.S)
        name, place = (m[1], int(m[2])) if m else (part, None)
        at = F.get(path, F.size(path) - n + k)
        ok = ok & (at.contains(name) if substring and k == n - 1 else at == name)
        if place is not None:
            ok = ok & (F.lit(False) if overloads is None else F.coalesce(F.get(overloads, F.size(path) - n + k) == place, F.lit(False)))
    return ok


def find(symbols: DataFrame, pattern: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), substring: bool = False, within: str | None = None) -> DataFrame:
    """The symbols (names, overloads, kind, path, ...) that a name path finds, of the included kinds (all if none is given) and
    none of the excluded ones, in a file or below a folder if one is given."""
    ok = matches_name_path(F.col("names"), pattern, substring, F.col("overloads"))
    if include:
        ok = ok & F.col("kind").isin(*include)
    if exclude:
        ok = ok & ~F.col("kind").isin(*exclude)
    if within:
        ok = ok & ((F.col("path") == within) | F.col("path").startswith(within.rstrip("/") + "/"))
    return symbols.where(ok)


def find_unique(symbols: DataFrame, pattern: str, **limits) -> DataFrame:
    """The one symbol that a name path finds; of several the one whose whole name path is the pattern. Else a ValueError, which
    names some of those found."""
    found = find(symbols, pattern, **limits)
    if len(some := found.limit(2).collect()) == 1:
        return found
    if not some:
        raise ValueError(f"no symbol matches {pattern!r}")
    exact = found.where(name_path_of(F.col("names"), F.col("overloads")) == pattern)
    if len(exact.limit(2).collect()) == 1:
        return exact
    names = [r[0] for r in found.select(name_path_of(F.col("names"), F.col("overloads"))).limit(10).collect()]
    raise ValueError(f"several symbols match {pattern!r}: {', '.join(names)}")


def name_path_of(names: Column, overloads: Column) -> Column:
    """The names with the places of overloads, joined by slashes."""
    return F.array_join(F.zip_with(names, overloads, lambda n, o: F.concat(n, F.coalesce(F.concat(F.lit("["), o.cast("string"), F.lit("]")), F.lit("")))), "/")


def at_location(symbols: DataFrame, path: str, line: int, col: int = 0) -> DataFrame:
    """The symbols that begin at a place."""
    return symbols.where((F.col("path") == path) & (F.col("start_line") == line) & (F.lit(col) == F.coalesce(F.col("start_col"), F.lit(0)) if "start_col" in symbols.columns else F.lit(True)))


def distinct_locations(found: DataFrame) -> DataFrame:
    """Symbols that several servers give (path, line, col, kind, ...), one for each place and kind: the first by its other columns."""
    keys = ["path", "line", "col", "kind"]
    rest = [c for c in found.columns if c not in keys]
    if not rest:
        return found.distinct()
    return found.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, "r.*")


def path_nodes(files: DataFrame) -> DataFrame:
    """(node, parent, kind, depth): the folders and files of all paths."""
    p = F.split("path", "/")
    nodes = files.select(p.alias("p")).select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("depth"))
    join = lambda n: F.array_join(F.slice("p", 1, n), "/")
    kind = F.when(F.col("depth") == F.size("p"), "file").otherwise("package")
    return nodes.select(join(F.col("depth")).alias("node"), F.when(F.col("depth") > 1, join(F.greatest(F.lit(1), F.col("depth") - 1))).alias("parent"), kind.alias("kind"), "depth").distinct()


def symbol_nodes(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(node, parent, kind): folders, files and symbols (id, path, kind, parent_id) as one flat tree; a symbol without a parent
    is below its file."""
    at = lambda i: F.concat("path", F.lit("#"), F.col(i).cast("string"))
    rows = symbols.select(at("id").alias("node"), F.when(F.col("parent_id").isNotNull(), at("parent_id")).otherwise(F.col("path")).alias("parent"), "kind")
    return path_nodes(files).select("node", "parent", "kind").unionByName(rows)


def sweep(diagnostics: DataFrame, max_files: int, max_problems: int) -> DataFrame:
    """diagnostics within the budget of files and problems, in order of path and line, with truncated: whether any were left
    out. Files that were skipped are not clean ones."""
    files = diagnostics.select("path").distinct().orderBy("path").limit(max_files)
    kept = diagnostics.join(F.broadcast(files), "path", "left_semi").orderBy("path", "line", "message").limit(max_problems)  # max_files rows
    all_ = diagnostics.agg(F.count("*").alias("n"))
    some = kept.agg(F.count("*").alias("m"))
    return kept.crossJoin(F.broadcast(all_.crossJoin(F.broadcast(some)).select((F.col("n") > F.col("m")).alias("truncated"))))  # one row
