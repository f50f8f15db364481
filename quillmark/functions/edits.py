"""Edits of texts by line and column, as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_slice(text: Column, first: int, last: int | None = None) -> Column:
    """The lines first to last, from 0, both included; to the end without a last."""
    a = _lines(text)
    n = F.size(a) if last is None else F.lit(max(0, last - first + 1))
    return F.array_join(F.slice(a, F.lit(first + 1), n), "\n")


def around_line(text: Column, line: int, before: int, after: int) -> Column:
    """A line and those around it, as far as the text goes; null if there is no such line."""
    first = max(0, line - before)
    return F.when(F.size(_lines(text)) > line, line_slice(text, first, line + after))


def body_span(text: Column, line: int, col: int, end_line: int, end_col: int) -> Column:
    """The text from (line, col) to (end_line, end_col), from 0, end exclusive; null where the lines aren't there."""
    a = _lines(text)
    first, last = F.get(a, F.lit(line)), F.get(a, F.lit(end_line))
    if line == end_line:
        return F.substr(first, F.lit(col + 1), F.lit(end_col - col))
    inner = F.slice(a, line + 2, end_line - line - 1)
    return F.when(F.size(a) > end_line, F.array_join(F.concat(F.array(F.substr(first, F.lit(col + 1))), inner, F.array(F.substring(last, 1, end_col))), "\n"))


def first_match(text: Column, regex: str, unique: bool = False) -> Column:
    """The (line, col), from 0, where the regex's one group begins in the first line that it matches within; null without a match,
    or, if it must be unique, with several."""
    inner = rf"^(?:(?!{regex}).)*?(?={regex})"
    rows = F.transform(_lines(text), lambda x, i: F.struct(F.when(x.rlike(regex), i).alias("line"), x.alias("x")))
    hit = F.get(F.filter(rows, lambda r: r["line"].isNotNull()), F.lit(0))
    start = F.length(F.regexp_extract(hit["x"], inner, 0))
    whole, group = F.regexp_extract(hit["x"], regex, 0), F.regexp_extract(hit["x"], regex, 1)
    found = F.struct(hit["line"].cast("long").alias("line"), (start + F.instr(whole, group) - 1).cast("long").alias("col"))
    ok = hit.isNotNull() & (F.regexp_count(text, F.lit(f"(?ms){regex}")) == 1 if unique else F.lit(True))
    return F.when(ok, found)


def insert_at_line(text: Column, line: int, new: str) -> Column:
    a = _lines(text)
    return F.array_join(F.concat(F.slice(a, 1, line), F.array(F.lit(new)), F.slice(a, line + 1, F.greatest(F.lit(0), F.size(a) - line))), "\n")


def delete_lines(text: Column, first: int, last: int) -> Column:
    """Without the lines first to last, from 0, both included."""
    a = _lines(text)
    return F.array_join(F.concat(F.slice(a, 1, first), F.slice(a, last + 2, F.greatest(F.lit(0), F.size(a) - last - 1))), "\n")


def replace_once(text: Column, needle: str, new: str) -> tuple[Column, Column]:
    """The text with its one occurrence replaced, null where there is none or more than one; and how many there are."""
    n = ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("long")
    return F.when(n == 1, F.replace(text, F.lit(needle), F.lit(new))), n


def replace_span(text: Column, line: int, col: int, end_line: int, end_col: int, new: str) -> Column:
    """The text with the span from (line, col) to (end_line, end_col), end exclusive, replaced."""
    a = _lines(text)
    head = F.array_join(F.concat(F.slice(a, 1, line), F.array(F.substring(F.get(a, F.lit(line)), 1, col))), "\n")
    tail = F.array_join(F.concat(F.array(F.substr(F.get(a, F.lit(end_line)), F.lit(end_col + 1))), F.slice(a, end_line + 2, F.greatest(F.lit(0), F.size(a) - end_line - 1))), "\n")
    return F.concat(head, F.lit(new), tail)


def replaced(text: Column, pattern: str, new: str, regex: bool = True, several: bool = False) -> tuple[Column, Column, Column]:
    """The text with the pattern's matches replaced, null where that is an error; their number; and the error, null if none.

    `.` and `^`, `$` cross and mind lines. `$!1` in the new text stands for the first group; a group that took no part gives
    nothing. Errors: no match; several matches, unless allowed; and a match over several lines in which, but for its first
    character, the pattern matches again, for it is not plain which one is meant.
    """
    rx = f"(?ms){pattern if regex else re.sub(r'([^A-Za-z0-9_])', lambda m: chr(92) + m[1] if ord(m[1]) < 128 else m[1], pattern)}"
    template = re.sub(r"\\\$!(\d+)", r"$\1", re.sub(r"([$\\])", r"\\\1", new)) if regex else re.sub(r"([$\\])", r"\\\1", new)
    n = F.regexp_count(text, F.lit(rx))
    unclear = F.exists(F.regexp_extract_all(text, F.lit(rx), F.lit(0)), lambda m: m.contains("\n") & F.substr(m, F.lit(2)).rlike(rx))
    error = F.when(n == 0, "no match").when(unclear, "ambiguous")
    if not several:
        error = F.when(n == 0, "no match").when(unclear, "ambiguous").when(n > 1, F.concat(n.cast("string"), F.lit(" matches")))
    return F.when(error.isNull(), F.regexp_replace(text, rx, template)), n, error


def insert_after_symbol(text: Column, end_line: int, new: str, apart: bool = True) -> Column:
    """The text with new lines after the symbol that ends in end_line: at least one blank line before them if definitions of
    its kind stand apart, else as many as the new text begins with."""
    blank = len(new) - len(new.lstrip("\r\n"))
    lead = max(int(apart), new[:blank].count("\n"))
    return insert_at_line(text, end_line + 1, "\n" * lead + new.strip("\r\n"))


def insert_before_symbol(text: Column, line: int, new: str, apart: bool = True) -> Column:
    """The text with new lines before the symbol that begins in line, and the blank lines that the new text ends with, at least
    one if definitions of its kind stand apart."""
    tail = new[len(new.rstrip("\r\n")) :].count("\n")
    return insert_at_line(text, line, new.rstrip() + "\n" * max(int(apart), tail - 1))


def delete_symbol(text: Column, line: int, col: int, end_line: int, end_col: int) -> Column:
    return replace_span(text, line, col, end_line, end_col, "")


def replace_body(text: Column, line: int, col: int, end_line: int, end_col: int, body: str) -> Column:
    """White space around the old body stays; that around the new one goes."""
    return replace_span(text, line, col, end_line, end_col, body.strip())
