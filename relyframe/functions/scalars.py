"""Column functions of the analytics: cleaning, names, paths, sampling, clipping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The taxonomy levels in order, and texts that stand for "missing".
LEVELS = ["Kingdom", "Phylum", "Class", "Order", "Family", "Genus", "Species"]
MISSING = ["", "nan", "none"]


def year_text(when: Column) -> Column:
    """First run of four digits of a date text; empty if there is none or the text is null."""
    return F.coalesce(F.regexp_extract(when, "[0-9]{4}", 0), F.lit(""))


def is_real(value: Column) -> Column:
    """Whether a text holds a value: not null, blank, "nan" or "none" in any case."""
    return F.coalesce(~F.lower(F.trim(value)).isin(MISSING), F.lit(False))


def clean_taxonomy(levels: dict[str, Column]) -> Column:
    """Map of the real levels; null if none is real."""
    kept = F.map_filter(F.create_map(*(x for k, v in levels.items() for x in (F.lit(k), v.cast("string")))), lambda _, v: is_real(v))
    return F.when(F.size(kept) > 0, kept)


def full_path(levels: list[Column]) -> Column:
    """Ordered path of all levels; null if any level is missing."""
    path = F.array(*(c.cast("string") for c in levels))
    return F.when(F.forall(path, is_real), path)


def display_name(name: Column, species: Column) -> Column:
    return F.coalesce(name, species)


def normal_class_name(name: Column) -> Column:
    """Trimmed, lower-case, without a trailing qualifier in brackets, underscores as spaces."""
    bare = F.regexp_replace(F.lower(F.trim(name)), r"_\([^)]*\)$", "")
    return F.trim(F.replace(bare, F.lit("_"), F.lit(" ")))


def prompt_text(mode: Column, noun_phrase: Column, species: Column) -> Column:
    """The prompt of a probe: "animal" in generic mode, else its noun phrase, else its species."""
    return F.when(mode == "generic", F.lit("animal")).otherwise(F.coalesce(F.nullif(noun_phrase, F.lit("")), species))


def tree_distance(a: Column, b: Column) -> Column:
    """Levels below the last shared level: length less the leading equal, non-empty levels."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x == y) & (x != ""), F.lit(False)))
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("alive"))
    step = lambda acc, eq: F.struct(
        (acc.n + F.when(acc.alive & eq, 1).otherwise(0)).alias("n"), (acc.alive & eq).alias("alive")
    )
    return F.size(a) - F.aggregate(same, start, step, lambda acc: acc.n)


def present_frames(segments: Column) -> Column:
    """Indices of the frames on which an object is present (not null)."""
    return F.filter(F.transform(segments, lambda s, i: F.when(s.isNotNull(), i)), lambda i: i.isNotNull())


def sample_evenly(values: Column, n: int) -> Column:
    """Up to n evenly spaced values, half-even rounding, no value twice; all if n < 1 or there are no more than n."""
    if n < 1:
        return values
    if n == 1:
        return F.slice(values, 1, 1)
    last = F.size(values) - 1
    at = lambda k: F.bround(k * last / F.lit(float(n - 1))).cast("int")
    picked = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.get(values, at(k))))
    return F.when(F.size(values) <= n, values).otherwise(picked)


def sample_stride(values: Column, cap: int) -> Column:
    """Every (length // cap)-th value, cap at most."""
    step = F.greatest(F.lit(1), F.floor(F.size(values) / cap).cast("int"))
    return F.slice(F.filter(values, lambda _, i: i % step == 0), 1, cap)


def unit(value: Column) -> Column:
    """Clipped to [0, 1]; null stays null."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def weight(value: Column) -> Column:
    """Null as zero, and no less than zero."""
    return F.greatest(F.coalesce(value.cast("double"), F.lit(0.0)), F.lit(0.0))


def number(value: Column) -> Column:
    """A double, or null where there is none."""
    parsed = value.try_cast("double")
    return F.when(~F.isnan(parsed), parsed)


def l2_normal(vector: Column) -> Column:
    """The vector over its length (1e-12 at least), as doubles."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(doubles, lambda x: x / F.greatest(length, F.lit(1e-12)))


def split_key(key: Column) -> tuple[Column, Column]:
    """Origin and raw id of a key ``origin:raw``."""
    return F.substring_index(key, ":", 1), F.regexp_replace(key, "^[^:]*:", "")


def gained(raw: Column, threshold: float, gain: float) -> Column:
    """Raw scores at or above the threshold times the gain, 1 at most; null below."""
    return F.when(raw >= threshold, F.least(raw * gain, F.lit(1.0)))


def ratio(a: Column, b: Column) -> Column:
    """a over b, null where b is zero."""
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def safe_corr(a: str, b: str) -> Column:
    """Aggregate: Pearson correlation over rows with both values; null below three rows or without spread."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    flat = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y)) | (F.count(x) < 3)
    return F.when(~flat, F.try_divide(F.covar_pop(x, y), spread))
