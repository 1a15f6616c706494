"""Column expressions: statistics, path classes, rule tables. All stay inside generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from heddle.functions.params import DEFAULTS


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- statistics ---------------------------------------------------------------------------------


def ratio(part: Column | str, whole: Column | str) -> Column:
    """part / whole as a double; null where whole is zero or null."""
    return F.when(col(whole) != 0, col(part).cast("double") / col(whole).cast("double"))


def wilson_lower(hits: Column | str, n: Column | str, z: float = 1.96) -> Column:
    """Lower end of the Wilson interval of hits / n, at least 0; 0 where n is not positive."""
    k, n = col(hits).cast("double"), col(n).cast("double")
    p = k / n
    centre, spread = p + z * z / (2 * n), z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), (centre - spread) / (1 + z * z / n))).otherwise(F.lit(0.0))


def percentile_rank(value: Column | str, *partition: str) -> Column:
    """Whole per cent of the population that is not above the value, ties included; null for null."""
    population = Window.partitionBy(*partition, col(value).isNull()).orderBy(col(value))
    return F.when(col(value).isNotNull(), F.bround(100 * F.cume_dist().over(population)).cast("long"))


def floor_quantile(values: Column | str, q: float) -> Column:
    """Of an array: the element at place floor(q * n) of its sorted values, the last at most; null if empty."""
    v = F.array_sort(col(values))
    return F.when(F.size(v) > 0, F.element_at(v, F.least(F.size(v), F.floor(F.lit(q) * F.size(v)).cast("int") + 1)))


def top_first(*order: Column, by: Sequence[str] = ()) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def nulls_last_desc(c: Column | str) -> Column:
    return col(c).desc_nulls_last()


def half_even(c: Column | str, places: int = 0) -> Column:
    return F.bround(col(c), places)


def days_between(first: Column | str, last: Column | str) -> Column:
    """Of two epochs in seconds."""
    return (col(last) - col(first)) / F.lit(86_400.0)


def utc_date(seconds: Column | str) -> Column:
    """The day, as text, of seconds since the epoch, whatever the session's time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(col(seconds) / 86_400).cast("int")).cast("string")


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch; the session time zone must be UTC for local timestamps."""
    return F.unix_micros(col(ts).cast("timestamp"))


# -- text and paths -----------------------------------------------------------------------------

FIX = r"(?iu)^\s*(fix|bugfix|hotfix|patch|исправ|почин)"
REVERT = r"(?iu)^\s*(revert|откат)"


def is_fix(subject: Column | str) -> Column:
    return F.coalesce(col(subject).rlike(FIX), F.lit(False))


def is_revert(subject: Column | str) -> Column:
    return F.coalesce(col(subject).rlike(REVERT), F.lit(False))


def basename(path: Column | str) -> Column:
    return F.substring_index(col(path), "/", -1)


def dirname(path: Column | str) -> Column:
    return F.regexp_extract(col(path), r"^(.*)/[^/]*$", 1)


def extension(path: Column | str) -> Column:
    """With its dot; empty for names without one and for names that only begin with dots."""
    return F.regexp_extract(basename(path), r"^\.*[^.].*?(\.[^.]*)$|^\.*[^.]+(\.[^.]*)$", 1)


CODE_SUFFIXES = (".py", ".js", ".jsx", ".ts", ".tsx", ".go", ".java", ".kt", ".rs", ".c", ".h", ".cc", ".cpp", ".hpp", ".cs", ".rb", ".php", ".swift", ".scala")
NOISE_PARTS = ("node_modules/", "vendor/", "dist/", "build/", ".git/", "__pycache__/", "site-packages/", "target/")
GENERATED_PARTS = (".min.", "_pb2.", ".generated.", "/generated/", "migrations/")
TEST_PARTS = ("tests/", "test/", "__tests__/", "spec/")


def path_class(path: Column | str, suffixes=CODE_SUFFIXES, noise=NOISE_PARTS, generated=GENERATED_PARTS, tests=TEST_PARTS) -> Column:
    """code, test, generated or noise; the order of the rules matters, and parts match anywhere."""
    p, low = col(path), F.lower(col(path))
    any_of = lambda c, parts: F.greatest(*[c.contains(x) for x in parts]) if len(parts) > 1 else c.contains(parts[0])
    known = F.greatest(*[p.endswith(s) for s in suffixes]) if len(suffixes) > 1 else p.endswith(suffixes[0])
    name = F.lower(basename(path))
    return F.when(any_of(p, noise), "noise").when(~known, "noise").when(any_of(p, generated), "generated").when(name.contains("test") | name.contains("spec") | any_of(low, tests), "test").otherwise("code")


def layer_of(path: Column | str, roots: Sequence[str] = (), depth: int = 1) -> Column:
    """The first `depth` directories after leading root names; the file name alone where no directory is left, ? for nothing."""
    parts = F.filter(F.split(col(path), "/"), lambda x: (x != "") & (x != "."))
    if roots:
        root = F.array(*[F.lit(r) for r in roots])
        skip = F.aggregate(parts, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, x: F.struct((a["n"] + F.when(a["on"] & F.array_contains(root, x), 1).otherwise(0)).alias("n"), (a["on"] & F.array_contains(root, x)).alias("on")))["n"]
        parts = F.slice(parts, skip + 1, F.greatest(F.size(parts) - skip, F.lit(0)))
    n = F.size(parts)
    return F.when(n == 0, "?").when(n == 1, parts[0]).otherwise(F.array_join(F.slice(parts, F.lit(1), F.least(F.lit(depth), n - 1)), "/"))


def dotted_suffixes(parts: Column | str) -> Column:
    """Of path segments: every dotted name that ends with the last one."""
    p = col(parts)
    return F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p) - i + 1), "."))


def source_files(source: Column | str) -> Column:
    """The distinct values of [file=...] in a path expression, in order."""
    return F.array_distinct(F.regexp_extract_all(col(source), F.lit(r"\[file=([^\]]+)\]"), F.lit(1)))


def lens_key(lens: Column | str) -> Column:
    short = F.regexp_extract(col(lens), r"^\s*(L[1-4])\b", 1)
    return F.when(short != "", short).otherwise(F.lower(F.trim(col(lens))))


def normalized_answer(answer: Column | str, known: Sequence[str]) -> Column:
    """The known name that an answer's first line is or, the longest first, mentions; otherwise marked as not understood."""
    line = F.trim(F.split(F.lower(F.regexp_replace(col(answer), "^[`\"'*. \\s]+|[`\"'*. \\s]+$", "")), "\n")[0])
    line = F.regexp_replace(line, "[`\"'*. ]+$", "")
    out = F.concat(F.lit("__unparsed__:"), F.substring(line, 1, 60))
    for name in sorted(known, key=len):
        out = F.when(line.rlike(rf"\b\Q{name}\E\b"), F.lit(name)).otherwise(out)
    return F.when(line.isin(*known), line).otherwise(out)


# -- rule tables --------------------------------------------------------------------------------


def pain(fix_share: Column | str, edits: Column | str) -> Column:
    s, e = col(fix_share), col(edits)
    return F.when(s < 0.15, 1).when(s <= 0.35, F.when(e < 8, 1).otherwise(2)).otherwise(F.when(e < 8, 2).otherwise(3))


def spread(fan_in: Column | str, coupled: Column | str) -> Column:
    f, c = F.coalesce(col(fan_in), F.lit(0)), F.coalesce(col(coupled), F.lit(0))
    return F.greatest(F.when(f <= 3, 1).when(f <= 10, 2).otherwise(3), F.when(c <= 1, 1).when(c <= 4, 2).otherwise(3))


def band(value: Column | str, yellow: float, red: float, high_is_bad: bool = True) -> Column:
    """red, yellow or green by two limits; null for null."""
    v = col(value)
    if high_is_bad:
        return F.when(v > red, "red").when(v >= yellow, "yellow").when(v.isNotNull(), "green")
    return F.when(v < red, "red").when(v <= yellow, "yellow").when(v.isNotNull(), "green")


def pain_of_band(b: Column | str) -> Column:
    return F.when(col(b) == "red", 3).when(col(b) == "yellow", 2).when(col(b) == "green", 1)


def admission(*agreeing: Column) -> Column:
    """What that many agreeing axes admit: none, hypothesis, finding or verdict."""
    n = sum((F.coalesce(a, F.lit(False)).cast("int") for a in agreeing[1:]), F.coalesce(agreeing[0], F.lit(False)).cast("int"))
    return F.when(n <= 0, "none").when(n == 1, "hypothesis").when(n == 2, "finding").otherwise("verdict")


CEILINGS = ("hypothesis", "finding", "verdict")


def lower_ceiling(a: Column | str, b: Column | str) -> Column:
    rank = lambda c: F.array_position(F.array(*[F.lit(x) for x in CEILINGS]), c)
    return F.when(rank(col(a)) <= rank(col(b)), col(a)).otherwise(col(b))


def sarif_level(priority: Column | str) -> Column:
    return F.when(col(priority) >= 8, "error").when(col(priority) >= 5, "warning").otherwise("note")


def payback_verdict(quarters: Column | str, most: float = DEFAULTS.payback_max_quarters) -> Column:
    return F.when(col(quarters).isNull(), "cold").when(col(quarters) <= most, "ok").otherwise("too_costly")


def gain_reached(actual: Column | str, target: Column | str, direction: Column | str) -> Column:
    """up: at least; down: at most; anything else: at least, or within one per cent."""
    a, t = col(actual), col(target)
    return F.when(col(direction) == "up", a >= t).when(col(direction) == "down", a <= t).otherwise((F.abs(a - t) <= 0.01 * F.abs(t)) | (a >= t))


def quarter_bucket(age: Column | str, span: Column | float) -> Column:
    """3 for the newest quarter down to 0 for the oldest and all before it."""
    s = span if isinstance(span, Column) else F.lit(float(span))
    return (3 - F.least(F.lit(3), F.floor(F.greatest(F.lit(0.0), col(age).cast("double")) / s))).cast("int")


def hash_order(*keys: Column | str) -> Column:
    """A fixed shuffle: sort by it."""
    return F.sha2(F.concat_ws(":", *[col(k).cast("string") for k in keys]), 256)
