"""Source files to import specifications, metrics and tokens.

Python is parsed with ast; for other languages imports, metrics and tokens come from regular expressions (braces), and the backend
column says which it was. Numbers of the ast backend aren't those of a concrete-syntax
parser; use them within one backend.
"""

from __future__ import annotations

import ast
import io
import keyword
import re
import tokenize

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.sources import braces

SUFFIXES = {".py": "python", ".js": "js", ".jsx": "js", ".ts": "js", ".tsx": "js", ".go": "go", ".java": "java", ".rs": "rust", ".c": "c", ".h": "c", ".cpp": "c"}
PATTERNS = {
    "js": r"""(?m)(?:^\s*(?:import|export)\b[^'"\n]*?|\brequire\(\s*|\bimport\(\s*)['"]([^'"]+)['"]""",
    "go": r"""(?m)^\s*(?:import\s+)?(?:\w+\s+)?"([^"]+)"\s*$""",
    "java": r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)",
    "rust": r"(?m)^\s*(?:pub\s+)?(?:use|mod)\s+([\w:]+)",
    "c": r"""(?m)^\s*#\s*include\s*[<"]([^">]+)[">]""",
}
TYPE_IMPORT = r"""(?m)^\s*(?:import|export)\s+type\b[^'"\n]*?['"]([^'"]+)['"]"""
_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.BoolOp, ast.match_case, ast.With, ast.AsyncWith)
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)


_LEFT_OUT = re.compile(r"\.[^/]*|node_modules|vendor|dist|build|__pycache__")
TEXT_SUFFIXES = (".html", ".jinja", ".jinja2", ".j2", ".txt", ".md", ".yaml", ".yml", ".toml", ".json", ".cfg", ".ini", ".sh", ".service")
TEXT_NAMES = ("Dockerfile", "Procfile", "Makefile", "docker-compose.yml", "compose.yaml")


def listed(spark, root: str, wanted) -> list[tuple[str, str]]:
    """(URI, path below root) of the files whose names are wanted; hidden and dependency folders aren't entered. A list of one tree's names, on the driver."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out, todo = [], [(path, "")]
    while todo:
        folder, below = todo.pop()
        for x in fs.listStatus(folder):
            name = x.getPath().getName()
            if x.isDirectory():
                todo += [(x.getPath(), f"{below}{name}/")] * (not _LEFT_OUT.fullmatch(name))
            elif wanted(name):
                out.append((x.getPath().toString(), below + name))
    return sorted(out, key=lambda x: x[1])


def read_tree(spark, root: str, suffixes: tuple[str, ...] = tuple(SUFFIXES), names: tuple[str, ...] = ()) -> DataFrame:
    """(file, body) of the files below root with one of those suffixes or names; hidden and dependency folders are left out.

    Names are listed first, and bodies are read by the tasks: Spark's own file sources pass over every name that begins with
    an underscore, such as __init__.py. Undecodable bytes are replaced.
    """
    found = listed(spark, root, lambda n: n.endswith(suffixes) or n in names)

    def read(batches):
        import pandas as pd
        from pyarrow import fs

        for batch in batches:
            rows = []
            for uri, file in zip(batch["uri"], batch["file"], strict=True):
                system, path = fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))
                with system.open_input_stream(path, compression=None) as source:
                    rows.append((file, source.read().decode("utf-8", "replace")))
            yield pd.DataFrame(rows, columns=["file", "body"])

    rows = spark.createDataFrame(found, "uri string, file string").repartition(max(1, min(1_000, len(found) // 50)))
    return rows.mapInPandas(read, "file string, body string")


def read_texts(spark, root: str) -> DataFrame:
    """(file, body) of templates, settings and scripts below root, which may call code by its name."""
    return read_tree(spark, root, TEXT_SUFFIXES, TEXT_NAMES)


def _type_only(stack: list[ast.AST]) -> bool:
    return any(isinstance(n, ast.If) and "TYPE_CHECKING" in ast.unparse(n.test) for n in stack)


def python_imports(body: str) -> list[tuple[str, str]]:
    """(spec, runtime or type); from a import b gives a and a.b, leading dots are kept."""
    out, todo = [], [(ast.parse(body), [])]
    while todo:
        node, stack = todo.pop()
        kind = "type" if isinstance(node, (ast.Import, ast.ImportFrom)) and _type_only(stack) else "runtime"
        if isinstance(node, ast.Import):
            out += [(a.name, kind) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            base = "." * node.level + (node.module or "")
            out += [(base, kind)] * bool(base.strip(".")) + [(base + ("" if base.endswith(".") or not base else ".") + a.name, kind) for a in node.names if a.name != "*"]
        todo += [(child, [*stack, node]) for child in ast.iter_child_nodes(node)]
    return out


def python_metrics(body: str) -> tuple[int, int, int, int, int, int]:
    """loc, branches of the file + 1, the most of one function + 1 and its line, deepest nesting, functions."""
    tree, most, line, deepest, functions, total = ast.parse(body), 0, 0, 0, 0, 0
    todo = [(tree, 0, None)]
    own: dict[ast.AST, int] = {}
    while todo:
        node, depth, inside = todo.pop()
        if isinstance(node, _FUNCTIONS):
            functions, inside = functions + 1, node
            own[node] = 0
        if isinstance(node, _BRANCHES):
            total, depth = total + 1, depth + 1
            deepest = max(deepest, depth)
            if inside is not None:
                own[inside] += 1
        todo += [(child, depth, inside) for child in ast.iter_child_nodes(node)]
    for node, n in own.items():
        if n + 1 > most:
            most, line = n + 1, node.lineno
    return sum(1 for x in body.splitlines() if x.strip()), total + 1, most, line, deepest, functions


def python_tokens(body: str) -> list[tuple[str, int, int]]:
    """Tokens with names and literals made alike; comments and layout are dropped."""
    out = []
    for tok in tokenize.generate_tokens(io.StringIO(body).readline):
        if tok.type in (tokenize.COMMENT, tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER):
            continue
        name = tok.string
        if tok.type == tokenize.NAME and not keyword.iskeyword(name):
            name = "ID"
        elif tok.type in (tokenize.NUMBER, tokenize.STRING):
            name = "LIT"
        out.append((name, tok.start[0], tok.end[0]))
    return out


def _parsed(files: DataFrame, schema: str, make) -> DataFrame:
    """Rows that make(file, body) yields; a file that can't be parsed yields what make gives for None."""

    def rows(batches):
        import pandas as pd

        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            found = []
            for file, body in zip(batch["file"], batch["body"], strict=True):
                try:
                    found += make(file, body)
                except (SyntaxError, ValueError, tokenize.TokenError):
                    found += make(file, None)
            yield pd.DataFrame(found, columns=names)

    return files.select("file", "body").mapInPandas(rows, schema)


def import_specs(files: DataFrame) -> DataFrame:
    """(file, spec, kind, backend)."""
    suffix = F.regexp_extract("file", r"(\.[^./]+)$", 1)
    python = _parsed(files.where(suffix == ".py"), "file string, spec string, kind string, backend string", lambda file, body: [] if body is None else [(file, s, k, "ast") for s, k in python_imports(body)])
    out = python
    for language, pattern in PATTERNS.items():
        own = files.where(suffix.isin(*[s for s, x in SUFFIXES.items() if x == language]))
        rows = lambda df, rule, kind: df.select("file", F.explode(F.regexp_extract_all("body", F.lit(rule), F.lit(1))).alias("spec"), F.lit(kind).alias("kind"), F.lit("regex").alias("backend"))
        if language == "js":  # what `import type` brings is gone at run time
            out = out.unionByName(rows(own, TYPE_IMPORT, "type"))
            own = own.withColumn("body", F.regexp_replace("body", TYPE_IMPORT, ""))
        out = out.unionByName(rows(own, pattern, "runtime"))
    return out


def _is_braced(file: str) -> bool:
    return not file.endswith(".py")


def file_metrics(files: DataFrame) -> DataFrame:
    """One row per source file; nulls where it can't be parsed. backend: ast for Python, regex for languages with braces."""
    schema = "file string, loc int, cyclomatic_total int, cyclomatic_max int, worst_line int, max_nesting int, functions int, backend string"

    def make(file, body):
        own = [None] * 6 if body is None else braces.metrics(body) if _is_braced(file) else python_metrics(body)
        return [(file, *own, "regex" if _is_braced(file) else "ast")]

    return _parsed(_known(files), schema, make)


def _known(files: DataFrame) -> DataFrame:
    return files.where(F.regexp_extract("file", r"(\.[^./]+)$", 1).isin(*SUFFIXES))


def token_rows(files: DataFrame) -> DataFrame:
    """(file, pos, tok, line_start, line_end)."""
    make = lambda file, body: [] if body is None else [(file, i, *x) for i, x in enumerate(braces.tokens(body) if _is_braced(file) else python_tokens(body))]
    return _parsed(_known(files), "file string, pos int, tok string, line_start int, line_end int", make)


def token_arrays(files: DataFrame) -> DataFrame:
    """(file, tokens): ready for operators.clones.windows(); empty where a file can't be parsed."""

    def rows(batches):
        import pandas as pd

        for batch in batches:
            found = []
            for file, body in zip(batch["file"], batch["body"], strict=True):
                try:
                    found.append((file, [x[0] for x in (braces.tokens(body) if _is_braced(file) else python_tokens(body))]))
                except (SyntaxError, IndentationError, tokenize.TokenError):
                    found.append((file, []))
            yield pd.DataFrame(found, columns=["file", "tokens"])

    return _known(files).select("file", "body").mapInPandas(rows, "file string, tokens array<string>")


def _dotted(path: Column) -> Column:
    return F.replace(path, F.lit("/"), F.lit("."))


def normalized(path: Column | str) -> Column:
    """A relative path without empty, . and .. parts, as far as they can be taken out."""
    parts = F.split(F.col(path) if isinstance(path, str) else path, "/")

    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.coalesce(F.element_at(done, -1), F.lit("")) != "..")
        return F.when(part.isin("", "."), done).when(up, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.array_append(done, part))

    return F.array_join(F.aggregate(parts, F.expr("cast(array() as array<string>)"), step), "/")


def module_index(files: DataFrame) -> DataFrame:
    """(key, target): a file's path without its suffix, a package's folder, and both with dots; of several files the first."""
    stem = F.regexp_replace("file", r"(?<=[^/])\.[^./]*$", "")
    package = F.regexp_extract(stem, r"^(.+)/(?:index|__init__)$", 1)
    keys = F.filter(F.array(stem, _dotted(stem), package, _dotted(package)), lambda k: k != "")
    return files.select(F.col("file").alias("target"), F.explode(keys).alias("key")).groupBy("key").agg(F.min("target").alias("target"))


def resolve(specs: DataFrame, files: DataFrame, roots: tuple[str, ...] = ()) -> DataFrame:
    """(file, spec, kind, target): the file here that an import names; null for external ones.

    With a leading dot, a path (./a, ../b/c) is taken from the file's folder and dotted names climb one folder for every
    dot after the first. Other names are tried as they are, without a leading @, and below each of the roots.
    """
    spec, folder = F.coalesce(F.col("spec"), F.lit("")), F.regexp_extract("file", r"^(.*)/[^/]*$", 1)
    inside = lambda base, rest: F.concat_ws("/", F.when(base != "", base), F.when(rest != "", rest))
    dots = F.length(F.regexp_extract(spec, r"^(\.*)", 1))
    above = F.split(folder, "/")
    climbed = F.array_join(F.slice(above, F.lit(1), F.greatest(F.size(above) - F.greatest(dots - 1, F.lit(0)), F.lit(0))), "/")
    tail = F.replace(F.regexp_replace(spec, r"^\.+", ""), F.lit("."), F.lit("/"))
    relative = F.when(spec.rlike(r"^\.+/"), normalized(inside(folder, spec))).otherwise(normalized(inside(climbed, tail)))
    name = F.when(spec.contains(".") & ~spec.contains("/"), F.replace(F.regexp_replace(spec, "^@+", ""), F.lit("."), F.lit("/"))).otherwise(spec)
    whole = [F.regexp_replace(name, "^@+", ""), spec, *[F.concat(F.lit(f"{r}/"), F.regexp_replace(name, "^[@/]+", "")) for r in roots]]
    candidates = F.when(spec.startswith("."), F.array(relative)).otherwise(F.array(*whole))
    keys = F.flatten(F.transform(candidates, lambda c: F.array(F.regexp_replace(c, "^/+|/+$", ""), _dotted(F.regexp_replace(c, "^/+|/+$", "")))))
    each = specs.select("file", "spec", "kind").distinct().select("file", "spec", "kind", F.posexplode(keys).alias("place", "key")).where("key <> ''")
    hits = each.join(module_index(files), "key").groupBy("file", "spec", "kind").agg(F.min_by("target", "place").alias("target"))
    same = F.col("s.file").eqNullSafe(F.col("h.file")) & F.col("s.spec").eqNullSafe(F.col("h.spec")) & F.col("s.kind").eqNullSafe(F.col("h.kind"))
    return specs.alias("s").join(hits.alias("h"), same, "left").select("s.file", "s.spec", "s.kind", "h.target")


def import_edges(resolved: DataFrame) -> DataFrame:
    """Distinct (src, dst, kind) between different files."""
    return resolved.where("target is not null and target <> file").select(F.col("file").alias("src"), F.col("target").alias("dst"), "kind").distinct()


def external_packages(resolved: DataFrame) -> DataFrame:
    """(package, n) of unresolved absolute specs."""
    spec = F.regexp_replace(F.regexp_extract("spec", r"^([^/.:]+)", 1), "^@", "")
    return resolved.where(F.col("target").isNull() & ~F.col("spec").startswith(".")).groupBy(spec.alias("package")).agg(F.count("*").alias("n"))


def backend_counts(specs: DataFrame) -> DataFrame:
    """(backend, files): in how many files each parser was used."""
    return specs.groupBy("backend").agg(F.countDistinct("file").alias("files"))


def type_edge_total(resolved: DataFrame) -> DataFrame:
    """One row: imports of files here that only types need, each occurrence counted."""
    return resolved.where("kind = 'type' and target is not null").agg(F.count("*").alias("type_edges"))


def structure_roots(files: DataFrame, most: int = 6) -> DataFrame:
    """(root): the first of the top folders, by name."""
    return files.where(F.col("file").contains("/")).select(F.substring_index("file", "/", 1).alias("root")).distinct().orderBy("root").limit(most)
