"""Operator 8: a ledger of quality rules as bit masks, with DataFrame functions only.

Every rule is evaluated once a document. The ledger keeps the measurements and one failure bit a rule.
Policies are versioned masks over the bits, applied without touching a text again; ablations (what a
policy would keep without one of its rules) are counts over the few distinct bit patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relyframe.llm.common import SPACE_CHARS, split_words, table

#: Rules in bit order: name and failure condition over the measurements. Integer arithmetic only.
RULES: list[tuple[str, str]] = [
    ("too_few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    ("shouting", "100 * n_upper > 50 * word_chars"),
]
BASE = ("too_few_words", "repeated_words")
#: Versioned policies: the rules that each applies.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbols", "duplicate_lines", "word_length", "shouting"),
}
PRODUCTION = "v1"


def mask_of(policy: str) -> int:
    """The bit mask of a policy."""
    bits = {name: 1 << k for k, (name, _) in enumerate(RULES)}
    return sum(bits[name] for name in POLICIES[policy])


def _pairs(a: Column, n: Column, f) -> Column:
    """f of each element and the next."""
    m = F.greatest(n - 1, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), m), F.slice(a, F.lit(2), m), f)


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with the measurements of the rules.

    A null text is measured as an empty one, with zeros throughout; repeated rows are measured alike.
    Columns of the input that share a measurement's name are replaced.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words"]
    kept = F.struct(*(docs[c] for c in docs.columns if c != text_col and c.lower() not in made))
    text, none = F.col("text"), F.array().cast("array<int>")
    base = docs.select(kept.alias("row"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    base = base.select("row", "text", split_words(text).alias("words"))
    base = base.select(
        "row",
        F.size("words").alias("n"),
        F.char_length(F.array_join("words", "")).alias("word_chars"),
        F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).alias("n_symbols"),
        F.char_length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).alias("n_upper"),
        F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "").alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashed"),
    )
    m, h = F.greatest(F.col("n") - 2, F.lit(0)), F.col("hashed")
    two = F.zip_with(F.slice(h, F.lit(1), m), F.slice(h, F.lit(2), m), lambda a, b: F.xxhash64(a, b))
    three = F.zip_with(two, F.slice(h, F.lit(3), m), lambda a, b: F.xxhash64(a, b))
    base = base.select(
        "row", "n", "word_chars", "n_symbols", "n_upper", F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        three.alias("three"),
    )
    # Windows that occur again, by sorting (hash, place): equal neighbours. Only texts with any are sorted.
    placed = F.sort_array(F.transform("three", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    again = F.size("three") > F.size(F.array_distinct("three"))
    base = base.withColumn("placed", F.when(again, placed))
    same = _pairs(F.col("placed"), F.size("placed"), lambda a, b: F.when(a.h == b.h, F.array(a.i, b.i)).otherwise(none))
    base = base.withColumn("at", F.sort_array(F.array_distinct(F.flatten(same)))).withColumn("k", F.size("at"))
    gaps = _pairs(F.col("at"), F.col("k"), lambda a, b: F.least(b - a, F.lit(3)))
    covered = F.aggregate(gaps, F.lit(3), lambda acc, x: acc + x)
    return base.select(
        "row.*",
        *(F.col(c).cast("long").alias(c if c != "n" else "n_words") for c in ("n", *made[1:6])),
        F.coalesce(F.when(F.col("k") > 0, covered), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row a document: its other columns, the measurements, and ``failed_bits`` with bit k set where rule k fails."""
    bits = " + ".join(f"if({condition}, {1 << k}L, 0L)" for k, (_, condition) in enumerate(RULES))
    return measure(docs, text_col).withColumn("failed_bits", F.expr(bits))


def apply_policy(led: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """The ledger with ``kept``: no rule of the policy fails."""
    return led.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(mask_of(policy))) == 0)


def keep(docs: DataFrame, policy: str = PRODUCTION, text_col: str = "text") -> DataFrame:
    """The documents that a policy keeps, with their columns as they were.

    The verdict passes through a generator: a plain filter would be pushed down into the chain of array
    expressions and repeat it many times over.
    """
    whole = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("whole"), docs[text_col].alias("body"))
    led = apply_policy(ledger(whole, "body"), policy)
    kept = led.select(F.explode_outer(F.array(F.when(F.col("kept"), F.col("whole")))).alias("whole"))
    return kept.filter("whole is not null").select("whole.*")


def ablations(led: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """For each rule of a policy: documents failing it, failing only it, and kept without it.

    Counts come from the distinct bit patterns (2 to the number of rules at most). An empty ledger gives zeros.
    """
    mask = mask_of(policy)
    patterns = led.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = [(name, 1 << k) for k, (name, _) in enumerate(RULES) if name in POLICIES[policy]]
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    each = [
        F.struct(
            F.lit(name).alias("rule"),
            total(F.col("bits").bitwiseAND(F.lit(bit)) != 0).alias("n_failed"),
            total(F.col("bits") == bit).alias("n_failed_only_this"),
            total(F.col("bits").bitwiseAND(F.lit(mask & ~bit)) == 0).alias("n_kept_without"),
        )
        for name, bit in rules
    ]
    return patterns.agg(F.array(*each).alias("each")).select(F.inline("each"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents under the production policy."""
    led = apply_policy(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))
    base = F.col("failed_bits").bitwiseAND(F.lit(mask_of("base"))) != 0
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept",
        "n_lines", "n_upper", "failed_bits",
    )


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), t AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), again AS (
  SELECT doc_id, i FROM t QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS n_upper,
    coalesce(lines.n, 0) AS n_lines, coalesce(lines.dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)
), f AS (
  SELECT *, (n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > 3 * n_words)::INT
    + 8 * (100 * n_dup_lines > 30 * n_lines)::INT + 16 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::INT
    + 32 * (100 * n_upper > 50 * word_chars)::INT AS failed_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed,
  failed_bits = 0 AS kept, n_lines, n_upper, failed_bits FROM f
"""
