"""The engine's tools by name, as a caller that knows names and arguments only would use them; more can be registered."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import is_test, matches_glob
from quillmark.operators import clones, graph, retrieval, scan
from quillmark.plans.corpus import Corpus, dense

Tool = Callable[..., DataFrame]
TOOLS: dict[str, Tool] = {}


def tool(f: Tool) -> Tool:
    """Register a function of (corpus, arguments...) under its name."""
    TOOLS[f.__name__] = f
    return f


def describe() -> dict[str, tuple[str, str]]:
    """By name: a tool's arguments, and what it gives."""
    return {n: (str(inspect.signature(f)).split(" -> ")[0], inspect.getdoc(f) or "") for n, f in sorted(TOOLS.items())}


def call(corpus: Corpus, name: str, /, **arguments) -> DataFrame:
    if name not in TOOLS:
        raise ValueError(f"unknown tool {name!r}; there are {', '.join(sorted(TOOLS))}")
    return TOOLS[name](corpus, **arguments)


def allowed(lang: str | None = None, kind: str | None = None, path_glob: str | None = None, exclude_tests: bool = False) -> Column | None:
    """The filter that goes before any ranking; None if nothing is asked for."""
    parts = [F.col("lang") == lang] if lang else []
    parts += [F.col("kind") == kind] if kind else []
    parts += [matches_glob(F.col("path"), path_glob)] if path_glob else []
    parts += [~is_test(F.col("path"))] if exclude_tests else []
    out = None
    for p in parts:
        out = p if out is None else out & p
    return out


@tool
def search_code(corpus: Corpus, query: str, limit: int = 10, **only) -> DataFrame:
    """Symbols by names, words, vectors and substrings, fused by rank."""
    return retrieval.hybrid(corpus, query, limit, allowed(**only))


@tool
def search_semantic(corpus: Corpus, query: str, limit: int = 10) -> DataFrame:
    """Symbols by vectors, or by words where there are none."""
    return retrieval.semantic(corpus, query, limit)


@tool
def search_regex(corpus: Corpus, pattern: str, limit: int = 50) -> DataFrame:
    """Matching lines, `limit` of each file at most, and of all."""
    return scan.regex_lines(corpus.docs, pattern, limit).orderBy("doc_id", "line_no").limit(limit)


@tool
def search_substring(corpus: Corpus, substring: str, limit: int = 20, **only) -> DataFrame:
    """Symbols whose body holds the text, whatever its case."""
    return retrieval.substring(corpus, substring, allowed(**only)).orderBy(F.desc("score"), "id").limit(limit)


@tool
def find_similar_code(corpus: Corpus, snippet: str, limit: int = 10) -> DataFrame:
    """Symbols whose vectors are nearest to a snippet's."""
    return retrieval.by_vector(corpus.vectors, retrieval.embed(snippet)).orderBy(F.desc("score"), "id").limit(limit)


@tool
def find_duplicate_code(corpus: Corpus, min_lines: int = 5, similarity: float = 0.9, limit: int = 50) -> DataFrame:
    """Groups of near-duplicate symbols."""
    places = corpus.heads.where("kind = 'block'").select("id", "name", "path", "start_line", "end_line")
    return clones.clone_payload(dense(corpus.vectors), places, similarity, min_lines, limit)


@tool
def detect_clones_in_diff(corpus: Corpus, added: DataFrame, min_lines: int = 5, similarity: float = 0.85, limit: int = 50) -> DataFrame:
    """Added blocks that repeat a symbol."""
    return clones.clones_of_added(corpus, added, similarity, min_lines, limit)


@tool
def get_code_context(corpus: Corpus, query: str, max_symbols: int = 3, body_lines: int = 80, related: int = 5, include_tests: bool = True, **only) -> DataFrame:
    """Symbols with their code, callers, callees and tests."""
    return graph.code_context(corpus, query, max_symbols, body_lines, related, include_tests, allowed(**only))


@tool
def get_dependents(corpus: Corpus, name: str) -> DataFrame:
    """Symbols that use the name."""
    return graph.dependents(corpus, name)


@tool
def get_dependencies(corpus: Corpus, name: str) -> DataFrame:
    """Definitions that the name's definitions use."""
    return graph.dependencies(corpus, name)


@tool
def get_call_chain(corpus: Corpus, name: str, depth: int = 3) -> DataFrame:
    """What the name's definition uses, and what that uses."""
    return graph.call_chain(corpus, name, depth)


@tool
def get_change_impact(corpus: Corpus, name: str, depth: int = 3) -> DataFrame:
    """What uses the name, and what uses that."""
    return graph.change_impact(corpus, name, depth)


@tool
def get_project_map(corpus: Corpus, max_files: int = 200) -> DataFrame:
    """Files by their number of symbols, with their first ones."""
    return graph.project_map(corpus, max_files, 12)


@tool
def get_file_summary(corpus: Corpus, path: str) -> DataFrame:
    """A file's symbols and what it uses from outside."""
    return graph.file_summary(corpus, path)


@tool
def get_type_hierarchy(corpus: Corpus, name: str, types: DataFrame) -> DataFrame:
    """A type, its supertypes and its subtypes."""
    return graph.type_hierarchy(types, name)


def shortened(renderings: list[Callable[[], str]], most: int) -> str:
    """The first rendering of at most that many characters, from the fullest to the shortest; if none fits, a notice."""
    for r in renderings:
        if len(text := r()) <= most:
            return text
    return f"The answer is too long: more than {most} characters. Ask for less."
