"""Operator 9: benchmark decontamination by winnowing, with DataFrame functions only.

Each text becomes hashes of GRAM consecutive words; of every WINDOW - GRAM + 1 neighbouring hashes the least is
kept. Any WINDOW words that a document shares with a benchmark item contain a kept hash of both, so a join of the
kept hashes finds every document that may be hit. Hits are then extended: only those documents are read again,
their whole windows are joined with the items' windows by hash, and the words of what is found are compared. Items
shorter than a window are windows as a whole, and are looked for at their own length.

Arrays are unnested with the outer forms of explode: for the inner ones Spark adds a filter on the array's size and
pushes it down, where it repeats the whole chain of array expressions many times over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relyframe.llm.common import mark_members, materialize, table

WINDOW = 10
GRAM = 5
#: Rows up to which the items' hashes are broadcast (16 bytes each); beyond, Spark joins by shuffle.
BROADCAST_ROWS = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII characters that are not in words: all but digits and letters.
_BETWEEN = "".join(c for c in map(chr, range(128)) if not c.isalnum())


def _words(text: Column) -> Column:
    """Words with A-Z, and only those, in lower case."""
    spaced = F.btrim(F.translate(text, _UPPER + _BETWEEN, _LOWER + " " * len(_BETWEEN)))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " +", -1))


def _zip(a: str, b: str, shift: int, n: Column, f) -> Column:
    """f of a's element i and b's element i + shift, for the n places where both exist."""
    n = F.greatest(n, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1 + shift), n), f)


def _least(a: Column, b: Column) -> Column:
    return F.least(a, b)


def _grams(rows: DataFrame, hashed: str, length: int, out: str) -> DataFrame:
    """``rows`` with the array ``out`` of hashes of ``length`` consecutive elements of ``hashed``, by doubling."""
    keep = [c for c in rows.columns if c != out]
    pair = lambda a, b: F.xxhash64(a, b)
    rows = rows.withColumn("_g", F.col(hashed)).withColumn("_n", F.size(hashed))
    powers, size = {1: hashed}, 1
    while size * 2 <= length:
        rows = rows.withColumn(f"_g{size * 2}", _zip(powers[size], powers[size], size, F.col("_n") - size * 2 + 1, pair))
        powers[size * 2], size = f"_g{size * 2}", size * 2
    made, name = size, powers[size]
    for size in sorted(powers, reverse=True):
        if made + size <= length:
            rows = rows.withColumn(f"_m{made + size}", _zip(name, powers[size], made, F.col("_n") - made - size + 1, pair))
            made, name = made + size, f"_m{made + size}"
    return rows.select(*keep, F.col(name).alias(out))


def _winnowed(rows: DataFrame, hashed: str, out: str) -> DataFrame:
    """``rows`` with the distinct kept hashes of each text."""
    keep = rows.columns
    rows = _grams(rows, hashed, GRAM, "_w1")
    span, name, made, powers = WINDOW - GRAM + 1, "_w1", 1, {1: "_w1"}
    n = F.size("_w1")
    while made * 2 <= span:
        rows = rows.withColumn(f"_w{made * 2}", _zip(name, name, made, n - made * 2 + 1, _least))
        made, name = made * 2, f"_w{made * 2}"
        powers[made] = name
    if made < span:  # the last two overlap, which a minimum allows
        rows = rows.withColumn("_least", _zip(name, name, span - made, n - span + 1, _least))
        name = "_least"
    return rows.select(*keep, F.array_distinct(name).alias(out))


def _fingerprints(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """``rows`` (keys, text) without the text, with ``n_words`` and the array ``kept``."""
    keys = [*(c for c in rows.columns if c != "text"), "n_words"]
    rows = rows.withColumn("_h", F.transform(_words(F.col("text")), lambda w: F.xxhash64(w))).drop("text")
    rows = _winnowed(rows.withColumn("n_words", F.size("_h").cast("long")), "_h", "kept")
    for length in lengths:
        rows = _grams(rows, "_h", length, "_short").withColumn("kept", F.concat("kept", F.array_distinct("_short")))
    return rows.select(*keys, "kept")


def _sized(small: DataFrame, n: int) -> DataFrame:
    return F.broadcast(small) if n <= BROADCAST_ROWS else small


def short_lengths(items: DataFrame) -> list[int]:
    """Lengths of the items that are shorter than a window, WINDOW - 1 numbers at most."""
    n = items.select(F.size(_words(F.col("text"))).alias("n")).filter(F.col("n").between(1, WINDOW - 1))
    return sorted(r.n for r in n.distinct().collect())


def _said(words: str, at: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, at + 1, length), " ")


def item_windows(items: DataFrame, lengths: list[int]) -> DataFrame:
    """(item_id, window, length, said) of each item: its windows, or itself if it is shorter, hashed and in words."""
    rows = items.select("item_id", _words(F.col("text")).alias("words"))
    rows = rows.withColumn("_h", F.transform("words", lambda w: F.xxhash64(w)))
    made = None
    for length in [*lengths, WINDOW]:
        fit = rows.filter(F.size("_h") == length) if length < WINDOW else rows
        part = _grams(fit, "_h", length, "_g").select("item_id", "words", F.posexplode_outer("_g").alias("at", "window"))
        part = part.select("item_id", "window", F.lit(length).alias("length"), _said("words", F.col("at"), F.lit(length)).alias("said"))
        made = part if made is None else made.union(part)
    return materialize(made.filter("window is not null").distinct())


def find_windows(docs: DataFrame, prints: DataFrame, items: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """Occurrences (doc_id, text_key, at, length, window, said) of items' windows in documents, at word ``at`` (from 0).

    ``prints`` are the fingerprints of the documents.
    """
    marked = materialize(_fingerprints(items.select("text"), lengths).select(F.explode_outer("kept").alias("mark")).filter("mark is not null").distinct())
    # Kept hashes leave the text behind; a document with several hits is named once.
    named = prints.select("doc_id", "text_key", F.explode_outer("kept").alias("mark"))
    named = named.join(_sized(marked, marked.count()), "mark", "left_semi").select("doc_id", "text_key").distinct()
    named = materialize(named)
    # A bit table tells most other documents before their texts are sent.
    key = F.xxhash64("text_key", "doc_id").alias("_key")
    maybe = mark_members(docs.select(*docs.columns, key), named.select(key), "_key").filter("maybe").select(*docs.columns)
    same = maybe["text_key"].eqNullSafe(named["text_key"]) & maybe["doc_id"].eqNullSafe(named["doc_id"])
    again = maybe.join(named, same, "left_semi").distinct()
    again = materialize(again.select("doc_id", "text_key", _words(F.col("text")).alias("words")))
    rows = again.select("doc_id", "text_key", F.transform("words", lambda w: F.xxhash64(w)).alias("_h"))
    wanted = windows.select("window", "length").distinct()
    wanted = _sized(wanted, wanted.count())
    found = None
    for length in [*lengths, WINDOW]:
        placed = _grams(rows, "_h", length, "_g").select("doc_id", "text_key", F.posexplode_outer("_g").alias("at", "window"))
        hit = placed.withColumn("length", F.lit(length)).join(wanted, ["window", "length"], "left_semi")
        found = hit if found is None else found.union(hit)
    found = materialize(found).alias("f")
    same = F.col("f.text_key").eqNullSafe(F.col("a.text_key")) & F.col("f.doc_id").eqNullSafe(F.col("a.doc_id"))
    found = found.join(again.alias("a"), same).select("f.*", _said("words", F.col("at"), F.col("length")).alias("said"))
    return found.join(windows.select("window", "length", "said").distinct(), ["window", "length", "said"], "left_semi")


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items (sorted ids as strings).

    Null texts have no words and null or empty items no windows. A null item_id counts as the empty string. Repeated
    rows of documents or items are treated alike; documents that share an id but not a text are told apart. No
    documents give no rows, and no items no hits. Other columns are dropped.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    docs = docs.select(docs["doc_id"], F.xxhash64(text).alias("text_key"), text.alias("text"))
    items = items.select(F.coalesce(items["item_id"].cast("string"), F.lit("")).alias("item_id"), F.coalesce(items["text"], F.lit("")).alias("text"))
    lengths = short_lengths(items)
    windows = item_windows(items, lengths)
    prints = materialize(_fingerprints(docs, lengths))  # read for the marks and for the numbers of words
    found = materialize(find_windows(docs, prints, items, windows, lengths))
    keys = ["doc_id", "text_key"]
    covered = found.select(*keys, F.explode(F.sequence("at", F.col("at") + F.col("length") - 1)).alias("word"))
    n_hit = covered.distinct().groupBy(*keys).agg(F.count("*").alias("n_hit"))
    by_item = found.select(*keys, "window", "length", "said").distinct().join(windows, ["window", "length", "said"])
    by_item = by_item.select(*keys, "item_id").distinct()
    by_item = by_item.groupBy(*keys).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    n_hit, by_item = n_hit.alias("h"), by_item.alias("i")
    same = F.col("h.text_key").eqNullSafe(F.col("i.text_key")) & F.col("h.doc_id").eqNullSafe(F.col("i.doc_id"))
    hit = materialize(n_hit.join(by_item, same).select("h.doc_id", "h.text_key", "n_hit", "items")).alias("h")
    sized = prints.select(*keys, "n_words").alias("d")
    same = F.col("h.text_key").eqNullSafe(F.col("d.text_key")) & F.col("h.doc_id").eqNullSafe(F.col("d.doc_id"))
    items_or_none = F.coalesce("items", F.array().cast("array<string>"))
    return sized.join(hit, same, "left").select(
        "d.doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items_or_none).cast("long").alias("n_items"),
        items_or_none.alias("items"),
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without an occurrence of any window, with their columns as they were.

    Null texts, ids and items are as in ``hits``. Only documents that may have to go are shuffled.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    row, doc_id, text_key = F.struct(*(docs[c] for c in docs.columns)), docs["doc_id"], F.xxhash64(text)
    keyed = docs.select(row.alias("row"), doc_id.alias("doc_id"), text_key.alias("text_key"), F.xxhash64(doc_id, text_key).alias("key"))
    items = items.select(F.coalesce(items["text"], F.lit("")).alias("text"), F.lit("").alias("item_id"))
    lengths = short_lengths(items)
    plain = docs.select(doc_id.alias("doc_id"), text_key.alias("text_key"), text.alias("text"))
    found = find_windows(plain, _fingerprints(plain, lengths), items, item_windows(items, lengths), lengths).select("doc_id", "text_key").distinct()
    found = materialize(found.withColumn("key", F.xxhash64("doc_id", "text_key")))
    rows = mark_members(keyed, found)
    touched = rows.filter("maybe")
    same = touched["doc_id"].eqNullSafe(found["doc_id"]) & touched["text_key"].eqNullSafe(found["text_key"])
    touched = touched.join(found, same, "left_anti")
    return rows.filter("not maybe").select("row").union(touched.select("row")).select("row.*")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    found = hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))
), hit AS (
  SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""
