"""Scalar text functions as Columns, and patterns compiled on the driver."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Paths that hold tests (fixed values: these conventions decide the results).
TEST_GLOBS = (
    "test/*", "tests/*", "spec/*", "*/test/*", "*/tests/*", "*/spec/*", "*/testing/*",
    "test_*", "*/test_*", "*_test.*", "*/*_test.*", "*.test.*", "*/*.test.*", "*.spec.*", "*/*.spec.*", "*Test.*", "*/*Test.*", "*Tests.*", "*/*Tests.*",
)
#: Folders that are never indexed (fixed values); a tool that keeps a folder of its own adds it where these are used.
IGNORED = (
    ".git", ".hg", ".svn", "node_modules", ".venv", "venv", "env", ".env", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", "dist", "build", "target",
    "out", "bin", "obj", ".idea", ".vscode", ".gradle", ".tox", ".nox", ".cache", "site-packages", ".next", ".nuxt", "vendor", "coverage",
)
#: Extensions and their languages (fixed values).
EXTENSIONS = {
    ".py": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "tsx", ".go": "go", ".rs": "rust", ".java": "java", ".rb": "ruby", ".rake": "ruby",
    ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp", ".hxx": "cpp", ".cs": "csharp", ".lua": "lua",
    ".ex": "elixir", ".exs": "elixir", ".el": "elisp", ".clj": "clojure", ".cljs": "clojure", ".cljc": "clojure", ".lisp": "commonlisp", ".cl": "commonlisp",
    ".dart": "dart", ".swift": "swift", ".sh": "bash", ".bash": "bash", ".r": "r", ".ml": "ocaml", ".mli": "ocaml_interface", ".elm": "elm", ".sol": "solidity",
    ".d": "d", ".gleam": "gleam", ".rkt": "racket", ".ino": "arduino", ".m": "matlab", ".pony": "pony",
}
#: Words of declarations that are no base types (fixed values).
DECLARING = (
    "public", "private", "protected", "internal", "abstract", "final", "static", "sealed", "open", "export", "default", "class", "struct", "interface", "enum", "trait", "object",
    "data", "record", "type", "where", "implements", "extends", "case", "impl", "for", "with", "partial", "const", "var", "val", "func", "fn",
)
#: Kinds that take part in a type hierarchy, and paths that a list of the most used names leaves out (fixed values).
TYPE_KINDS = ("class", "interface", "struct", "trait", "enum", "type", "object", "protocol", "record")
OVERVIEW_EXCLUDED = ("*.min.js", "*.min.css", "*/vendor/*", "*/node_modules/*", "*/third_party/*")


def glob_regex(pattern: str) -> str:
    """An anchored regex: `*` and `?` cross `/`, `[!x]` negates."""
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        end = pattern.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out += ".*"
        elif ch == "?":
            out += "."
        elif end > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out += f"[{'^' + body[1:] if body.startswith('!') else body}]"
            i = end
        else:
            out += re.sub(r"([\\.^$|()\[\]{}*+?])", r"\\\1", ch)
        i += 1
    return f"(?s)^{out}$"


def braces(pattern: str) -> list[str]:
    """The patterns that {a,b} sets stand for."""
    m = re.search(r"\{([^{}]*)\}", pattern)
    return [pattern] if not m else [y for x in m[1].split(",") for y in braces(pattern[: m.start()] + x + pattern[m.end() :])]


def path_globs(pattern: str) -> list[str]:
    """Regexes of a path pattern: braces are expanded, and `**/` also stands for no folder."""
    out = []
    for p in braces(pattern):
        forms = [p] if "**" not in p else [p, p.replace("**/", ""), p.replace("/**", "")]
        out += [glob_regex(x.replace("**", "*")) for x in dict.fromkeys(forms)]
    return out


def any_rlike(text: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[F.when(text.rlike(p), True) for p in patterns], F.lit(False))


def matches_glob(path: Column, pattern: str) -> Column:
    """The pattern matches the path, or without `/` its last part."""
    rx = glob_regex(pattern)
    return path.rlike(rx) if "/" in pattern else path.rlike(rx) | F.element_at(F.split(path, "/"), -1).rlike(rx)


def search_regex(glob: str) -> str:
    """The unanchored regex of a text search's glob: `*` is any text, `?` any two characters, `\\x` is x itself."""
    found = re.findall(r"\\.|\\$|[^\\]", glob, re.S)
    special = {"*": ".*", "?": ".."}
    return "".join(special[c] if c in special else re.escape(c[-1]) for c in found)


def is_test(path: Column) -> Column:
    return any_rlike(path, [glob_regex(g) for g in TEST_GLOBS])


def test_hint(path: Column) -> Column:
    """Whether `test` or `spec` is anywhere in the path, whatever its case: broader than is_test."""
    return F.lower(path).rlike("test|spec")


def language_of(path: Column) -> Column:
    """By the lower-cased ending of the last part; a name that is an ending only has none."""
    ext = F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), ext)


def ignored(path: Column, own: tuple[str, ...] = ()) -> Column:
    return F.exists(F.split(path, "/"), lambda p: p.isin(*IGNORED, *own))


def unsafe(path: Column) -> Column:
    """Absolute, climbing, with a backslash or a zero character, or with a drive."""
    return path.startswith("/") | F.exists(F.split(path, "/"), lambda p: p == "..") | path.contains("\\") | path.contains("\0") | path.rlike("^[A-Za-z]:")


def fold(body: Column, most: int) -> Column:
    """Head and tail of a body of more lines, with a count of those between."""
    a = F.split(body, "\n", -1)
    head = max(1, 2 * most // 3)
    tail = max(1, most - head - 1)
    mark = F.concat(F.lit("... ["), (F.size(a) - head - tail).cast("string"), F.lit(" lines omitted] ..."))
    short = F.concat(F.slice(a, 1, head), F.array(mark), F.slice(a, F.size(a) - tail + 1, tail))
    return F.when(F.size(a) <= most, body).otherwise(F.array_join(short, "\n"))


def group_key(path: Column) -> Column:
    p = F.split(path, "/")
    return F.when(F.size(p) == 1, F.lit(".")).when(F.size(p) == 2, p[0]).otherwise(F.concat_ws("/", p[0], p[1]))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s]+|[\s]+$", "")


def embed_text(kind: Column, name: Column, signature: Column, body: Column) -> Column:
    head = strip(F.concat(kind, F.lit(" "), name, F.lit("\n"), signature))
    return F.concat(head, F.lit("\n\n"), F.substring(strip(body), 1, 1800))


def snippet_signature(snippet: Column) -> Column:
    """The first line with a character in it, stripped; empty if there is none."""
    return F.coalesce(strip(F.get(F.filter(F.split(snippet, "\n", -1), lambda x: strip(x) != ""), F.lit(0))), F.lit(""))


def snippet_text(snippet: Column) -> Column:
    """A raw snippet in the shape that symbols are embedded in: its first line stands for the signature."""
    head = snippet_signature(snippet)
    return F.concat(head, F.lit("\n\n"), F.substring(strip(snippet), 1, 1800))


def base_names(name: Column, signature: Column) -> Column:
    """The identifiers after the first occurrence of the name (of the whole signature without one), up to a brace, without the
    name and the words of declarations, by their last parts, in order."""
    tail = F.when(F.contains(signature, name), F.substr(signature, F.instr(signature, name) + F.length(name))).otherwise(signature)
    found = F.regexp_extract_all(F.substring_index(tail, "{", 1), F.lit(r"[A-Za-z_][A-Za-z0-9_.]*"), F.lit(0))
    kept = F.filter(found, lambda x: (x != name) & ~x.isin(*DECLARING))
    return F.array_distinct(F.transform(kept, lambda x: F.element_at(F.split(x, r"\."), -1)))


def cosine_from_l2(distance: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - distance * distance / 2))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normal(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm == 0, x.cast("double")).otherwise(x.cast("double") / norm))
