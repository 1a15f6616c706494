"""Why static analysis may be wrong about dead code: names that strings, templates, exports and reflection use.

Corpus and candidates meet in equi-joins on names: bodies are cut once into the names that they quote, export or
mention, and nothing scans the corpus for a candidate.
"""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from heddle.functions.columns import basename, dotted_suffixes, path_class
from heddle.operators.saving import maybe_broadcast, saved
from heddle.sources.source_text import TEXT_NAMES, TEXT_SUFFIXES

HOOKS = ("method", "property", "attribute")
INSTRUMENTABLE = ("function", "method", "module")
REFLECTION = r"\bgetattr\(|\bimportlib\b|__import__\(|\bglobals\(\)\["
ENTRIES = ("__init__.py", "__main__.py", "conftest.py", "setup.py", "manage.py", "wsgi.py", "asgi.py")
_QUOTED, _BACKED = r"""['"]([^'"\n]+)(?=['"])""", r"""['"`]([^'"`\n]+)(?=['"`])"""


def is_python(file: Column | str = "file") -> Column:
    return (F.col(file) if isinstance(file, str) else file).endswith(".py")


def is_text(file: str = "file") -> Column:
    """Templates, settings and scripts that may call code by its name."""
    out = basename(file).isin(*TEXT_NAMES)
    for s in TEXT_SUFFIXES:
        out = out | F.col(file).endswith(s)
    return out


def _found(corpus: DataFrame, text: Column, pattern: str, *keys: str) -> DataFrame:
    return corpus.select(*keys, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))).alias("name"))


def _of(names: DataFrame, found: DataFrame) -> DataFrame:
    """found for the wanted (name) only, joined before anything is shuffled by name."""
    return found.join(maybe_broadcast(names, names.count()), "name", "left_semi")


def blind_spots(candidates: DataFrame, corpus: DataFrame) -> DataFrame:
    """(file, line, name, reason) for every reason to doubt a candidate (file, line, kind, name); corpus: (file, body)."""
    key, body = ["file", "line", "name"], F.col("body")
    names = saved(candidates.where("name <> ''").select("name").distinct())
    python = corpus.where(is_python())
    own = candidates.join(python.select("file", F.split("body", "\n").alias("lines"), body.rlike(REFLECTION).alias("reflects")), "file", "left")
    line = F.ltrim(F.coalesce(F.get("lines", F.col("line") - 1), F.lit("")))
    rules = [(F.col("kind").isin(*HOOKS), "framework_hook_possible"), (line.startswith("@"), "decorator_registration"), ((F.col("kind") == "import") & (basename("file") == "__init__.py"), "reexport"), (F.coalesce("reflects", F.lit(False)), "reflection_in_module")]
    local = own.select(*key, F.explode(F.filter(F.array(*[F.when(rule, F.lit(reason)) for rule, reason in rules]), lambda r: r.isNotNull())).alias("reason"))
    exports = _of(names, _found(python, F.regexp_extract(body, r"(?s)__all__\s*=(.*)", 1), _QUOTED, "file"))
    quoted = _of(names, _found(python, body, _BACKED)).distinct()
    mentioned = _of(names, _found(corpus.where(is_text()), body, r"(\w+)")).distinct()
    by = lambda found, on, reason: candidates.join(found, on, "left_semi").select(*key, F.lit(reason).alias("reason"))
    return local.unionByName(by(exports.distinct(), ["file", "name"], "exported_in_all")).unionByName(by(quoted, "name", "string_reference")).unionByName(by(mentioned, "name", "non_python_reference"))


def runs_by_itself(body: str) -> bool:
    """Whether a file does something when it is run, beyond defining names."""
    if body.startswith("#!"):
        return True
    try:
        tree = ast.parse(body)
    except (SyntaxError, ValueError):
        return False
    loose = (ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith, ast.Try)
    for x in tree.body:
        if isinstance(x, loose) or isinstance(x, ast.Expr) and isinstance(x.value, (ast.Call, ast.Await)) or isinstance(x, ast.If) and "TYPE_CHECKING" not in ast.unparse(x.test):
            return True
    return False


@F.pandas_udf(BooleanType())
def is_script(bodies: pd.Series) -> pd.Series:
    """Only for the few files that nothing imports."""
    return bodies.map(runs_by_itself)


def orphan_modules(corpus: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, line, kind, name, size_lines, instrumentable, blind_spots) of Python files that nothing imports, by edges (src, dst) or by text."""
    python = corpus.where(is_python())
    imported = _found(python, F.col("body"), r"(?m)^\s*(?:from\s+([\w.]+\s+import\b[^#\n]*)|$^)", "file").unionByName(_found(python, F.col("body"), r"(?m)^\s*import\s+([\w.]+)", "file"))
    words = imported.select("file", F.explode(F.regexp_extract_all("name", F.lit(r"(\w+)"), F.lit(1))).alias("stem")).distinct()
    few = words.groupBy("stem").agg(F.count("*").alias("n"), F.min("file").alias("one"))
    stem = F.regexp_replace(basename("file"), r"\.py$", "")
    main = r"""__name__\s*==\s*['"]__main__['"]"""
    left = python.where((path_class("file") == "code") & ~basename("file").isin(*ENTRIES) & ~F.array_contains(F.split("file", "/"), "migrations") & ~F.col("body").rlike(main))
    left = left.join(edges.select(F.col("dst").alias("file")).distinct(), "file", "left_anti").withColumn("stem", stem)
    left = left.join(few, "stem", "left").where("n is null or (n = 1 and one = file)").select("file", "body")
    left = saved(left)
    names = left.select("file", F.explode(F.array_union(dotted_suffixes(F.split(F.regexp_replace("file", r"\.py$", ""), "/")), F.array(stem))).alias("name"))
    wanted = saved(names.select("name").distinct())
    quoted = names.join(_of(wanted, _found(python, F.col("body"), _BACKED, "file")).withColumnRenamed("file", "other"), "name").where("other <> file").select("file", F.lit("string_reference").alias("reason"))
    mentioned = names.join(_of(wanted, _found(corpus.where(is_text()), F.col("body"), r"(\w+)")), "name", "left_semi").select("file", F.lit("non_python_reference").alias("reason"))
    alone = left.where(is_script("body")).select("file", F.lit("standalone_script").alias("reason"))
    reasons = quoted.unionByName(mentioned).unionByName(alone).groupBy("file").agg(F.array_sort(F.collect_set("reason")).alias("blind_spots"))
    each = left.join(reasons, "file", "left").withColumn("blind_spots", F.coalesce("blind_spots", F.expr("cast(array() as array<string>)")))
    return each.select("file", F.lit(1).alias("line"), F.lit("module").alias("kind"), F.lit("").alias("name"), F.size(F.split(F.regexp_replace("body", "\n$", ""), "\n")).alias("size_lines"), (~F.array_contains("blind_spots", "standalone_script")).alias("instrumentable"), "blind_spots")
