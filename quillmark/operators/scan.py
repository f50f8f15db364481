"""Text search, by line and across lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.sources.shared import checkpointed


def lines(documents: DataFrame) -> DataFrame:
    """(doc_id, k, line): lines from 0."""
    return documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("k", "line"))


def regex_lines(documents: DataFrame, pattern: str, per_file: int) -> DataFrame:
    """(doc_id, line_no, text): a file's first matching lines, from 1, stripped. Lines are matched one by one, within their row."""
    numbered = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("k"), x.alias("line")))
    hits = F.slice(F.filter(numbered, lambda r: r["line"].rlike(pattern)), 1, per_file)
    return documents.select("doc_id", F.inline(hits)).select("doc_id", (F.col("k") + 1).cast("long").alias("line_no"), F.substring(F.trim("line"), 1, 200).alias("text"))


def with_context(documents: DataFrame, pattern: str, before: int, after: int) -> DataFrame:
    """(doc_id, line_no, place, line): matching lines from 0 and those around them; sliced out of the file's own lines, without a join."""
    a = F.split("text", "\n", -1)
    rows = documents.select("doc_id", a.alias("a")).select("doc_id", "a", F.posexplode("a").alias("k", "hit")).where(F.col("hit").rlike(pattern))
    place = F.sequence(F.greatest(F.lit(-before), -F.col("k")), F.least(F.lit(after), F.size("a") - 1 - F.col("k")))
    return rows.select("doc_id", F.col("k").cast("long").alias("line_no"), "k", "a", F.explode(place).alias("place")).select("doc_id", "line_no", F.col("place").cast("long").alias("place"), F.get("a", F.col("k") + F.col("place")).alias("line"))


def display(place: Column, line_no: Column, line: Column) -> Column:
    """A line for reading: its mark, its number in four places, and itself."""
    number = F.when(F.length(line_no.cast("string")) < 4, F.lpad(line_no.cast("string"), 4, " ")).otherwise(line_no.cast("string"))
    return F.concat(F.when(place == 0, "  >").otherwise("..."), number, F.lit(":"), line)


def decoded(field: Column) -> Column:
    """A JSON field {text} or {bytes: base64} as text; bytes that aren't UTF-8 become the replacement character."""
    raw = F.unbase64(F.get_json_object(field, "$.bytes"))
    return F.coalesce(F.get_json_object(field, "$.text"), F.make_valid_utf8(raw.cast("string")), F.lit(""))


def across_lines(documents: DataFrame, pattern: str, before: int = 0, after: int = 0) -> DataFrame:
    """(doc_id, match, line_no, place, line): for each match in a whole text, numbered from 0, its lines and those around them.

    `^` and `$` hold at lines' bounds and `.` matches line feeds. Lines count from 0 and the context ends with the text; place
    is -1 before the match, 0 within it and 1 after it. Offsets are what built-in functions don't give, so this is an Arrow
    scan, behind a built-in test of the pattern. The pattern is one that both Java and Python read.
    """
    import re
    from bisect import bisect_right

    import pyarrow as pa

    compiled = re.compile(pattern, re.MULTILINE | re.DOTALL)

    def of(text: str):
        lines = text.split("\n")
        starts = [0]
        for x in lines[:-1]:
            starts.append(starts[-1] + len(x) + 1)
        last = len(lines) - 1 - (lines[-1] == "")
        for n, m in enumerate(compiled.finditer(text)):
            a, b = (bisect_right(starts, p) - 1 for p in m.span())
            for k in range(max(0, a - before), min(last, b + after) + 1):
                yield n, k, -1 if k < a else 1 if k > b else 0, lines[k]

    def each(batches):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            rows = [(d, *r) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in of(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names=["doc_id", "match", "line_no", "place", "line"])

    hit = documents.where(F.col("text").rlike(f"(?ms){pattern}")).select("doc_id", "text")
    return hit.mapInArrow(each, "doc_id long, match long, line_no long, place long, line string")


def containing(blocks: DataFrame, bodies: DataFrame, pass_chars: int = 4_000_000) -> DataFrame:
    """(item_id, n): how many bodies hold each block's text. The blocks are a query set: about pass_chars of them at a time are
    searched in one pass of the bodies, as literals of an Arrow scan, and each pass is written before the next one begins."""
    import pyarrow as pa

    asked = blocks.where("text <> ''").select("item_id", "text")
    total = asked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    passes, found = max(1, -(-total // pass_chars)), None
    for i in range(passes):
        items = [(r.item_id, r.text) for r in asked.where(F.pmod(F.xxhash64("text"), F.lit(passes)) == i).collect()]

        def each(batches, items=items):
            import ahocorasick

            find = ahocorasick.Automaton()
            ids: dict[str, list[int]] = {}
            for i, t in items:
                ids.setdefault(t, []).append(i)
            for t in ids:
                find.add_word(t, t)
            if ids:
                find.make_automaton()
            for b in batches:
                hit = [(p, i) for p, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if items and body for t in {x for _, x in find.iter(body)} for i in ids[t]]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in hit], pa.string()), pa.array([x[1] for x in hit], pa.int64())], names=["path", "item_id"])

        part = bodies.select("path", "body").mapInArrow(each, "path string, item_id long").groupBy("item_id").agg(F.count_distinct("path").alias("n"))
        part = part if passes == 1 else checkpointed(part)
        found = part if found is None else found.unionByName(part)
    return found
