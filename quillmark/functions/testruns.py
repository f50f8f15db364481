"""Test frameworks: which one a folder uses, and the counts in a run's output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of counts in one framework's summary; `errors` counts as `error` (fixed values).
COUNTED = ("passed", "failed", "error", "errors", "skipped", "xfailed", "xpassed")
KEYS = tuple(k for k in COUNTED if k != "errors")


def summary(framework: Column, output: Column) -> Column:
    """A struct of KEYS: the counts that the output of a run states, null for those it doesn't."""

    def number(pattern: str, group: int = 1) -> Column:
        return F.when(output.rlike(pattern), F.regexp_extract(output, pattern, group).cast("long"))

    def of(key: str) -> Column:
        python = number(rf"(\d+)\s+{key}\b")
        if key == "error":  # the later word of the list wins
            python = F.coalesce(number(r"(\d+)\s+errors\b"), python)
        out = F.when(framework == "pytest", python)
        if key in ("passed", "failed"):
            cargo = r"test result:.*?(\d+)\s+passed;\s+(\d+)\s+failed"
            out = out.when(framework == "cargo", number(cargo, 1 if key == "passed" else 2))
            out = out.when(framework == "go", F.regexp_count(output, F.lit("(?m)^--- " + ("PASS" if key == "passed" else "FAIL"))).cast("long"))
        return out

    return F.struct(*[of(k).alias(k) for k in KEYS])


def detect(files: DataFrame) -> DataFrame:
    """(root, framework, reason) for each root of files (root, path, content): the first marker that is there decides.

    Paths are relative to the root. content is needed of pyproject.toml, setup.cfg, tox.ini and package.json only. Roots
    without a marker have a null framework.
    """
    here = lambda *names: F.max(F.col("path").isin(*names))
    holds = lambda names, test: F.max(F.coalesce(F.col("path").isin(*names) & test, F.lit(False)))
    script = F.get_json_object("content", "$.scripts.test")
    module = F.col("path").rlike(r"^tests?/(?:.*/)?(?:test_[^/]*|[^/]*_test)\.py$")
    marks = files.groupBy("root").agg(
        (holds(("pyproject.toml", "setup.cfg", "tox.ini"), F.contains("content", F.lit("pytest"))) | here("conftest.py")).alias("pytest"),
        here("gradlew").alias("gradlew"), here("build.gradle", "build.gradle.kts").alias("gradle"), here("mvnw").alias("mvnw"), here("pom.xml").alias("maven"),
        holds(("package.json",), F.trim(script) != "").alias("node"), here("pnpm-lock.yaml").alias("pnpm"), here("yarn.lock").alias("yarn"),
        here("Cargo.toml").alias("cargo"), here("go.mod").alias("go"), F.max(module).alias("modules"),
    )
    manager = F.when(F.col("pnpm"), "node:pnpm").when(F.col("yarn"), "node:yarn").otherwise("node:npm")
    rules = [("pytest", F.lit("pytest"), "found pytest configuration"), ("gradlew", F.lit("gradle"), "found Gradle wrapper"), ("gradle", F.lit("gradle"), "found build.gradle"), ("mvnw", F.lit("maven"), "found Maven wrapper"), ("maven", F.lit("maven"), "found pom.xml"), ("node", manager, "package.json has a test script"), ("cargo", F.lit("cargo"), "found Cargo.toml"), ("go", F.lit("go"), "found go.mod"), ("modules", F.lit("pytest"), "found Python test modules")]
    pick = lambda what: F.coalesce(*[F.when(F.col(c), w if what == "framework" else F.lit(why)) for c, w, why in rules]).alias(what)
    return marks.select("root", pick("framework"), pick("reason"))
