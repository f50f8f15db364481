"""Ignore rules as an ordered list of regexes; the last that matches decides."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def rule_regex(rule: str) -> tuple[str, bool]:
    """A rule's regex, and whether it takes paths back in."""
    back, rule = rule.startswith("!"), rule.removeprefix("!")
    folder, rule = rule.endswith("/"), rule.rstrip("/")
    anchored, rule = "/" in rule, rule.removeprefix("/")
    out, i = "", 0
    while i < len(rule):
        if rule.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif rule.startswith("**", i):
            out, i = out + ".*", i + 2
        elif rule[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif rule[i] == "?":
            out, i = out + "[^/]", i + 1
        elif rule[i] == "[" and (end := rule.find("]", i + 2)) > 0:
            out, i = out + "[" + rule[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, i = out + re.sub(r"([\\.^$|()\[\]{}*+?])", r"\\\1", rule[i]), i + 1
    return f"^{'' if anchored else '(?:.*/)?'}{out}{'/.*' if folder else '(?:/.*)?'}$", back


def ignored_by(path: Column, rules: list[str]) -> Column:
    out = F.lit(False)
    for r in rules:
        if r.strip() and not r.startswith("#"):
            rx, back = rule_regex(r.strip())
            out = F.when(path.rlike(rx), F.lit(not back)).otherwise(out)
    return out


def ignored_below(path: Column, specs: dict[str, list[str]]) -> Column:
    """Ignored by any of the rule lists, each of which holds below its folder (`` for the root) and sees paths from there; and
    whatever lies in .git."""
    out = path.rlike(r"^\.git(?:/|$)")
    for folder, rules in specs.items():
        at = folder.strip("/")
        inner = F.substr(path, F.lit(len(at) + 2)) if at else path
        out = out | (ignored_by(inner, rules) & (path.startswith(at + "/") if at else F.lit(True)))
    return out
