"""Version control as tables: status records, commit subjects, changelogs, messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Types of conventional commits and their sections, in order (fixed values).
SECTIONS = {"feat": "Features", "fix": "Fixes", "perf": "Performance", "refactor": "Refactoring", "docs": "Documentation", "test": "Tests", "build": "Build", "ci": "CI", "chore": "Chores"}
OTHER = "Other"
#: Lines that attribute a message to an assistant (fixed patterns).
ASSISTANT = r"(?:\bai(?:[- ]assistant)?\b|\banthropic\b|\bchatgpt\b|\bclaude(?: code)?\b|\bcodex\b|\bcopilot\b|\bcursor\b|\bgemini\b|\bopenai\b)"
ATTRIBUTION = rf"(?im)^[ \t]*(?:(?:co-authored-by|assisted-by|generated-by|written-by):.*{ASSISTANT}.*|.*generated (?:by|with) .*{ASSISTANT}.*|🤖.*)$"
_TYPE = r"^(\w+)(?:\([^)]*\))?!?:\s*(.*)$"


def status_entries(raw: DataFrame) -> DataFrame:
    """(repo, k, status, index_status, worktree_status, path, original_path) of raw (repo, status): the zero-separated records of a
    short status. A renamed or copied path's record is followed by its original path, which is no record of its own.

    One repository's records are one window partition: a status is as long as a change, not as a repository.
    """
    rows = raw.select("repo", F.posexplode(F.split("status", "\0", -1)).alias("k", "r"))
    order = Window.partitionBy("repo").orderBy("k")
    moved = F.substring("r", 1, 2).rlike("[RC]") & (F.substring("r", 3, 1) == " ")
    # a record is an original path if an odd number of moved ones stands right before it
    run = F.coalesce(F.last(F.when(~moved, F.col("k")), True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    given = rows.select("*", F.lead("r").over(order).alias("next"), ((F.col("k") - 1 - run) % 2 == 1).alias("original"), moved.alias("moved"))
    own = given.where(~F.col("original") & (F.length("r") >= 3))
    code = lambda i: F.trim(F.substring("r", i, 1))
    return own.select("repo", "k", F.trim(F.substring("r", 1, 2)).alias("status"), code(1).alias("index_status"), code(2).alias("worktree_status"), F.substr("r", F.lit(4)).alias("path"), F.when(F.col("moved"), F.col("next")).alias("original_path"))


def changed_and_deleted(entries: DataFrame) -> DataFrame:
    """(repo, path, side): the paths of a status as changed or deleted; ignored ones are left out."""
    gone = (F.col("index_status") == "D") | (F.col("worktree_status") == "D")
    return entries.where(F.col("status") != "!!").select("repo", "path", F.when(gone, "deleted").otherwise("changed").alias("side")).distinct()


def sectioned(subject: Column) -> tuple[Column, Column]:
    """A commit subject's section, and its entry there; a subject without a known type is an entry of OTHER as it stands."""
    kind = F.lower(F.regexp_extract(subject, _TYPE, 1))
    known = F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv])
    section = F.coalesce(F.try_element_at(known, kind), F.lit(OTHER))
    return section, F.when(section == OTHER, subject).otherwise(F.regexp_extract(subject, _TYPE, 2))


def changelog(commits: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by..., section, place, entries): commits (by..., k, subject) by section, entries in order of k; place orders the sections."""
    section, entry = sectioned(F.col("subject"))
    order = F.create_map(*[F.lit(x) for k, s in enumerate([*SECTIONS.values(), OTHER]) for x in (s, k)])
    rows = commits.select(*by, "k", section.alias("section"), entry.alias("entry"))
    listed = rows.groupBy(*by, "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "entry"))), lambda x: x["entry"]).alias("entries"))
    return listed.select(*by, "section", F.element_at(order, F.col("section")).alias("place"), "entries")


def markdown(log: DataFrame, by: list[str], since: Column, until: Column) -> DataFrame:
    """(by..., text): a changelog of sections as one Markdown text."""
    part = F.concat(F.lit("## "), F.col("section"), F.lit("\n"), F.array_join(F.transform("entries", lambda e: F.concat(F.lit("- "), e)), "\n"), F.lit("\n"))
    parts = log.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", part.alias("part")))), lambda x: x["part"]).alias("parts"))
    return parts.select(*by, F.concat(F.lit("# Changelog ("), since, F.lit(".."), until, F.lit(")\n\n"), F.array_join("parts", "\n")).alias("text"))


def sanitized(message: Column) -> Column:
    """A commit message without attributions to assistants, with two line feeds in a row at most, and one at its end."""
    cleaned = F.regexp_replace(F.regexp_replace(message, ATTRIBUTION, ""), r"\n{3,}", "\n\n")
    return F.concat(F.regexp_replace(cleaned, r"^\s+|\s+$", ""), F.lit("\n"))


def needs_full_pass(head: str | None, indexed_head: str | None, dirty: set[str], indexed_dirty: set[str] | None) -> bool:
    """Whether a sync must visit everything: the head moved, no state is known, or the ignore rules are or were being changed."""
    moved = head != indexed_head and (head is not None or indexed_head is not None)
    return moved or indexed_dirty is None or ".gitignore" in dirty | indexed_dirty
