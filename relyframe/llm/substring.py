"""Operator 5: removal of repeated word sequences with suffix automata of reference shards.

A window of LENGTH words that also starts in a document with a smaller id marks its words for removal.

1. Each document is read once: exact copies of a text are told by its hash, and winnowed hashes of GRAM words
   (anchors; every window holds one) are kept. Anchors in two or more documents name the candidate documents, and stretches
   of neighbouring windows around such an anchor what may repeat in them.
2. The reference text is every window that documents share, once: in the first document that has it. Equal stretches
   become one row by a hash of all their words. Only where stretches around one anchor differ, their windows are hashed one by
   one. First documents come from map-side aggregates, so a passage in a third of all documents is one row a task.
3. Reference texts are dealt to shards of about SHARD_WORDS words. The stretches of the candidates are sent to the shards that hold
   text around their anchors; a shard that many documents ask for is copied. Each copy's suffix automaton is built once and
   the stretches are streamed through it for matching statistics; spans of LENGTH words or more that another document owns
   are removed. So hashes choose what is read; the automaton finds the spans, on words.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relyframe.llm.common import bucketed, mark_members, materialize, table, temporary

LENGTH = 50
GRAM = 8
#: Words of reference text to a shard, on average; words of a document whose anchors share a home; words streamed through one copy.
SHARD_WORDS, PIECE, COPY_WORDS = 40_000, 4_096, 1_000_000
#: Words of all documents to a bucket of the candidates.
BUCKET_WORDS = 4_000_000
#: Rows after which a task hands on a batch.
BATCH_ROWS = 200_000
_LAST = (1 << 63) - 1
_WINDOW_SCHEMA = "h1 long, h2 int, anchor long, key long, tk long, at int, high long"
_PIECE_SCHEMA = "shard long, key long, tk long, at long, words binary, is_doc boolean"
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_EMPTY = hashlib.sha256(b"").hexdigest()
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    known = _powers.get(int(base))
    if known is None or len(known[0]) < n:
        size = max(n, 4096)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        known = tuple(np.cumprod(np.append(np.uint64(1), np.full(size - 1, b)), dtype=np.uint64) for b in (base, inverse))
        if size <= 1 << 20:
            _powers[int(base)] = known
    return known


def _rolling(hashed: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash of each run of ``length`` words."""
    n = len(hashed)
    if n < length:
        return np.empty(0, np.uint64)
    up, down = _power_tables(base, n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashed * up[:n], dtype=np.uint64)])
    mixed = (sums[length:] - sums[:-length]) * down[: n - length + 1]
    return (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """f (minimum or maximum) of each ``width`` neighbours."""
    made = 1
    while made * 2 <= width:
        x, made = f(x[:-made], x[made:]), made * 2
    return f(x[: len(x) - (width - made)], x[width - made :]) if made < width else x


def window_minima(hashed: np.ndarray) -> np.ndarray:
    """For each window of LENGTH words its least GRAM-word hash."""
    grams = _rolling(hashed, GRAM, _BASES[0])
    return _sliding(grams, LENGTH - GRAM + 1, np.minimum) if len(hashed) >= LENGTH else grams[:0]


class Automaton:
    """Suffix automaton of word sequences; a state keeps the owner of the sequence that made it."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.owner = [-1], [0], [None]
        self._owners: list | None = None

    def add(self, words: Iterable[bytes], owner: object) -> None:
        last, self._owners = 0, None
        for w in words:
            last = self._extend(last, w, owner)

    def _extend(self, last: int, w: bytes, owner: object) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:  # of a sequence before
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        self.owner.append(owner)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: bytes, q: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.owner.append(self.owner[q])
        self.link[q] = clone
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _least_owners(self, least: int) -> list:
        """For each state of ``least`` words or more, the owner of its last ``least`` words."""
        link, length, owners = self.link, self.length, list(self.owner)
        for s in sorted(range(1, len(length)), key=length.__getitem__):
            if length[link[s]] >= least:
                owners[s] = owners[link[s]]
        return owners

    def spans(self, words: list[bytes], least: int = LENGTH, own: object = None) -> list[tuple[int, int]]:
        """Maximal spans [begin, end) that are unions of matches of ``least`` words that ``own`` doesn't own.

        Each sequence of ``least`` words in the automaton must have one owner.
        """
        if self._owners is None:
            self._owners = self._least_owners(least)
        state, matched, out = 0, 0, []
        nxt, link, length, owners = self.next, self.link, self.length, self._owners
        for at, w in enumerate(words):
            while state and w not in nxt[state]:
                state = link[state]
                matched = length[state]
            if w in nxt[state]:
                state, matched = nxt[state][w], matched + 1
            else:
                matched = 0
            if matched >= least and (own is None or owners[state] != own):
                if out and at - least + 1 <= out[-1][1]:
                    out[-1] = (out[-1][0], at + 1)
                else:
                    out.append((at - least + 1, at + 1))
        return out


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """Runs [first, last] of consecutive numbers in a sorted array."""
    breaks = np.flatnonzero(np.diff(starts) != 1)
    firsts, lasts = np.append(0, breaks + 1), np.append(breaks, len(starts) - 1)
    return [(int(starts[a]), int(starts[b])) for a, b in zip(firsts, lasts, strict=True)]


def _scan(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for doc_id, key, tk, text in zip(pdf["doc_id"], pdf["key"], pdf["tk"], pdf["text"], strict=True):
            words = text.split()
            whole = b" ".join(words)
            digest = xxhash.xxh3_128_intdigest(whole)
            minima = window_minima(_word_hashes(words)) if len(words) >= LENGTH else np.empty(0, np.uint64)
            t1, t2 = np.array([digest >> 64, digest & (2**64 - 1)], np.uint64).view(np.int64)
            rows.append((doc_id, key, tk, t1, t2, len(words), hashlib.sha256(whole).hexdigest(), np.unique(minima).view(np.int64)))
        names = ["doc_id", "key", "tk", "t1", "t2", "n_words", "whole_sha256", "anchors"]
        yield pd.DataFrame(rows, columns=names)


def _stretches(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stretches of neighbouring windows with one shared anchor: a hash of all their words, place and number."""
    for pdf in batches:
        out = []
        for key, tk, text, shared in zip(pdf["key"], pdf["tk"], pdf["text"], pdf["shared"], strict=True):
            hashed = _word_hashes(text.split())
            minima = window_minima(hashed)
            first = np.flatnonzero(np.append(True, minima[1:] != minima[:-1]))
            count = np.diff(np.append(first, len(minima)))
            wanted = np.isin(minima[first], np.asarray(shared).view(np.uint64))
            first, count = first[wanted], count[wanted]
            up, down = _power_tables(_BASES[1], len(hashed))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashed * up[: len(hashed)], dtype=np.uint64)])
            content = (sums[first + count + LENGTH - 1] - sums[first]) * down[first]
            out.append((minima[first], content, np.full(len(first), key), np.full(len(first), tk), first, count))
        anchor, content, key, tk, first, count = (np.concatenate(x) for x in zip(*out, strict=True))
        yield pd.DataFrame({"anchor": anchor.view(np.int64), "content": content.view(np.int64), "key": key, "tk": tk, "at": first, "n": count})


def _windows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Window hashes of the stretches that a document stands for."""
    names = [x.split()[0] for x in _WINDOW_SCHEMA.split(", ")]
    frame = lambda out: pd.DataFrame(dict(zip(names, (np.concatenate(x) for x in zip(*out, strict=True)), strict=True)))
    for pdf in batches:
        out, size = [], 0
        for key, tk, text, stretches in zip(pdf["key"], pdf["tk"], pdf["text"], pdf["stretches"], strict=True):
            hashed = _word_hashes(text.split())
            h1, h2 = _rolling(hashed, LENGTH, _BASES[0]).view(np.int64), _rolling(hashed, LENGTH, _BASES[1]).view(np.int64)
            at = np.concatenate([np.arange(s["at"], s["at"] + s["n"]) for s in stretches])
            anchor, high = (np.repeat([s[c] for s in stretches], [s["n"] for s in stretches]) for c in ("anchor", "high"))
            out.append((h1[at], (h2[at] >> 32).astype(np.int32), anchor, np.full(len(at), key), np.full(len(at), tk), at, high))
            size += len(at)
            if size > BATCH_ROWS:
                yield frame(out)
                out, size = [], 0
        if out:
            yield frame(out)


def _union(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of window starts [a, b) joined where they touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cut(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The words of a document's reference windows by shard, and of the stretches that each shard is to tell about."""
    names = [x.split()[0] for x in _PIECE_SCHEMA.split(", ")]
    for pdf in batches:
        rows = []
        for key, tk, text, *lists in zip(pdf["key"], pdf["tk"], pdf["text"], pdf["owned"], pdf["later"], strict=True):
            words = text.split()
            for spans, is_doc in zip(lists, (False, True), strict=True):
                by_shard: dict[int, list] = {}
                for p in spans if spans is not None else []:
                    by_shard.setdefault(p["shard"], []).append((p["at"], p["at"] + p["n"]))
                for shard, own in by_shard.items():
                    rows += [(shard, key, tk, a, b" ".join(words[a : b + LENGTH - 1]), is_doc) for a, b in _union(own)]
        yield pd.DataFrame(rows, columns=names, dtype=object)


def _match(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spans of the documents' stretches that the shards' references have; a shard's references come before the stretches."""
    of, automaton = None, Automaton()
    for pdf in batches:
        rows = []
        for shard, copy, key, tk, at, words, is_doc in zip(*(pdf[c] for c in ("shard", "copy", "key", "tk", "at", "words", "is_doc")), strict=True):
            if (shard, copy) != of:
                of, automaton = (shard, copy), Automaton()
            if is_doc:
                rows += [(key, tk, at + a, at + b) for a, b in automaton.spans(words.split(), own=key)]
            else:
                automaton.add(words.split(), key)
        yield pd.DataFrame(rows, columns=["key", "tk", "begin", "end"])


def _remaining(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for key, tk, text, spans in zip(pdf["key"], pdf["tk"], pdf["text"], pdf["spans"], strict=True):
            words = text.split()
            gone = np.zeros(len(words) + 1, np.int64)
            for s in spans:
                gone[s["begin"]] += 1
                gone[s["end"]] -= 1
            gone = np.cumsum(gone)[:-1] > 0
            kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
            ranges = _runs(np.flatnonzero(gone))
            rows.append((key, tk, int(gone.sum()), hashlib.sha256(kept).hexdigest(), [(a, b + 1) for a, b in ranges]))
        yield pd.DataFrame(rows, columns=["key", "tk", "n_removed", "kept_sha256", "removed"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> list:
    """Columns doc_id, key (order of ids, null last), tk (a hash of the text) and text (bytes)."""
    text, doc_id = F.coalesce(docs[text_col], F.lit("")), docs[id_col].cast("long")
    key = F.coalesce(doc_id, F.lit(_LAST))
    return [doc_id.alias("doc_id"), key.alias("key"), F.xxhash64(text).alias("tk"), text.cast("binary").alias("text")]


def references(candidates: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stretches (anchor, content, key, tk, at, n) of the candidates, the reference windows (shard, key, tk, at, n), and the
    shards that a stretch around an anchor asks (anchor, shard, low: the anchor's first owner).

    A reference row is a run of n windows of a document from word ``at`` that a later document has, too, and no earlier one.
    """
    schema = "anchor long, content long, key long, tk long, at int, n int"
    stretches = materialize(candidates.select("key", "tk", "text", "shared").mapInPandas(_stretches, schema))
    with temporary(candidates.sparkSession):
        runs = materialize(_first_runs(candidates, stretches), kept=True)
    n_shards = max(1, math.ceil((runs.agg(F.sum("n")).first()[0] or 0) / SHARD_WORDS))
    # An anchor's windows go to the shard of its first owner's piece, so that a stretch asks one shard, and neighbouring ones the
    # same; an anchor with more windows than a shard has words is spread over several.
    first = F.min(F.struct("key", "tk", F.floor(F.col("at") / PIECE).alias("piece"))).alias("first")
    homes = materialize(runs.groupBy("anchor").agg(first, F.ceil(F.sum("n") / SHARD_WORDS).alias("parts")))
    shard = lambda part: F.pmod(F.xxhash64("first.key", "first.tk", "first.piece", part), F.lit(n_shards)).alias("shard")
    placed = runs.join(homes, "anchor").select(shard(F.pmod(F.xxhash64("key", "tk"), F.col("parts"))), "key", "tk", "at", "n")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    asks = homes.select("anchor", "first", every).select("anchor", shard(F.col("part")), F.col("first.key").alias("low")).distinct()
    return stretches, placed, asks


def _first_runs(candidates: DataFrame, stretches: DataFrame) -> DataFrame:
    """(anchor, key, tk, at, n) of the reference windows."""
    # Equal stretches are one row from here on; the first document stands for it.
    contents = stretches.groupBy("anchor", "content", "n").agg(F.min(F.struct("key", "tk", "at")).alias("own"), F.max("key").alias("high"))
    contents = materialize(contents.select("anchor", "n", "own.*", "high"))
    kinds = contents.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("key").alias("low"), F.max("high").alias("top"))
    contents = contents.join(materialize(kinds.filter("low < top").select("anchor", "kinds")), "anchor")
    alone = contents.filter("kinds = 1").select("anchor", "key", "tk", "at", "n")
    # Stretches that differ around one anchor may still share windows: those are compared one by one.
    asked = contents.filter("kinds > 1").groupBy("key", "tk").agg(F.collect_list(F.struct("at", "n", "high", "anchor")).alias("stretches"))
    windows = candidates.select("key", "tk", "text").join(asked, ["key", "tk"]).mapInPandas(_windows, _WINDOW_SCHEMA)
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct("key", "tk", "at", "anchor")).alias("own"), F.max("high").alias("high"))
    first = first.filter("own.key < high").select("own.anchor", "own.key", "own.tk", "own.at", F.lit(1).alias("n"))
    return alone.union(first)


def _found(candidates: DataFrame, stretches: DataFrame, runs: DataFrame, asks: DataFrame) -> DataFrame:
    """(key, tk, spans) of the documents' words that a shard's automaton finds in another document's reference text."""
    listed = lambda df, name: df.groupBy("key", "tk").agg(F.collect_list(F.struct("shard", "at", "n")).alias(name))
    # Written first: a hot anchor is then a plain row on both sides, which Spark splits.
    later = stretches.join(materialize(asks), "anchor").filter("low < key").select("key", "tk", "shard", "at", "n")
    parts = listed(runs, "owned").join(listed(later, "later"), ["key", "tk"], "full")
    cut = materialize(candidates.select("key", "tk", "text").join(parts, ["key", "tk"]).mapInPandas(_cut, _PIECE_SCHEMA))
    size = F.sum(F.when(F.col("is_doc"), F.octet_length("words")))
    hot = cut.groupBy("shard").agg(F.ceil(size / (8 * COPY_WORDS)).alias("copies")).filter("copies > 1")
    cut = cut.join(materialize(hot), "shard", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    every = F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)
    one = F.array(F.pmod(F.xxhash64("key", "tk", "at"), F.col("copies")))
    rows = cut.withColumn("copy", F.explode(F.when(F.col("is_doc"), one).otherwise(every)))
    rows = rows.repartition("shard", "copy").sortWithinPartitions("shard", "copy", "is_doc")
    spans = rows.select("shard", "copy", "key", "tk", "at", "words", "is_doc").mapInPandas(_match, "key long, tk long, begin long, end long")
    return spans.groupBy("key", "tk").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, key, tk, n_words, n_removed, kept_sha256, removed (begin, end in words).

    Words are runs of anything but ASCII white space; windows are judged on the input. A null text has no words. A
    null id counts as larger than all others, and documents that share an id never remove each other's words;
    repeated rows are treated alike. No documents give no rows; other columns are dropped.
    """
    docs = docs.select(_keyed(docs, id_col, text_col))
    schema = "doc_id long, key long, tk long, t1 long, t2 long, n_words long, whole_sha256 string, anchors array<long>"
    scanned = materialize(docs.mapInPandas(_scan, schema))
    firsts = scanned.filter(F.col("n_words") >= LENGTH).groupBy("t1", "t2").agg(F.min("key").alias("first"), F.count("*").alias("n"))
    narrow = scanned.select("key", "tk", "t1", "t2")
    firsts = materialize(firsts.filter("n > 1").drop("n"))
    copies = narrow.join(firsts, ["t1", "t2"]).filter("first < key").select("key", "tk").distinct()
    copies = materialize(copies)
    # Anchors of first texts that other documents have, too.
    marked = mark_members(scanned.select("key", "tk", "anchors"), copies.select("key"))
    anchors = marked.filter("not maybe").union(marked.filter("maybe").join(copies, ["key", "tk"], "left_anti"))
    anchors = anchors.select("key", "tk", F.explode("anchors").alias("anchor"))
    shared = anchors.groupBy("anchor").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low < high").select("anchor")
    with temporary(docs.sparkSession):
        # Written first: only then is a hot anchor a plain row of the join, which Spark splits.
        shared = materialize(anchors.join(materialize(shared), "anchor").groupBy("key", "tk").agg(F.collect_set("anchor").alias("shared")))
        candidates = mark_members(docs.select("key", "tk", "text"), shared.select("key")).filter("maybe").drop("maybe")
        # In buckets: their texts are joined by document three times below, and are shuffled this once only.
        n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((scanned.agg(F.sum("n_words")).first()[0] or 0) / BUCKET_WORDS))
        candidates = candidates.repartition(n, "key", "tk").join(shared, ["key", "tk"]).dropDuplicates(["key", "tk"])
        candidates = bucketed(candidates, n, "key", "tk")
    with temporary(docs.sparkSession):
        spans = materialize(_found(candidates, *references(candidates)), kept=True)
    schema = "key long, tk long, n_removed long, kept_sha256 string, removed array<struct<begin:long,end:long>>"
    changed = candidates.select("key", "tk", "text").join(spans, ["key", "tk"]).mapInPandas(_remaining, schema)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n_words").alias("end")))
    none = F.array().cast("array<struct<begin:long,end:long>>")
    out = scanned.select("doc_id", "key", "tk", "n_words", "whole_sha256").join(changed, ["key", "tk"], "left")
    out = out.join(copies.withColumn("copy", F.lit(True)), ["key", "tk"], "left")
    return out.select(
        "doc_id",
        "key",
        "tk",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(_EMPTY)).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
        F.when(F.col("copy"), whole).otherwise(F.coalesce("removed", none)).alias("removed"),
    )


def _without(texts: pd.Series, removed: pd.Series) -> pd.Series:
    """The texts without their removed words; a null list leaves a text as it is."""
    word = re.compile(rb"[^\x20\x09-\x0D]+")
    out = []
    for text, spans in zip(texts, removed, strict=True):
        if text is None or spans is None:
            out.append(None if text is None else bytes(text).decode())
            continue
        text, begins, kept = bytes(text), 0, []
        at = [m.start() for m in word.finditer(text)] + [len(text)]
        for r in sorted((r["begin"], r["end"]) for r in spans):
            kept.append(text[begins : at[r[0]]])
            begins = at[r[1]]
        kept.append(text[begins:])
        out.append(b"".join(kept).decode())
    return pd.Series(out, dtype=object)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with repeated spans cut out of their texts; other texts stay as they are, to the byte.

    A removed word goes with the white space behind it. Null texts stay null; columns are kept.
    """
    with temporary(docs.sparkSession):
        spans = repeated_spans(docs, id_col, text_col).filter("n_removed > 0").select("key", "tk", "removed")
        spans = materialize(spans.distinct(), kept=True)
    names = docs.columns
    # Under numbers, so that no column clashes with those of the work.
    whole = docs.select(F.struct(*(docs[c].alias(f"c{k}") for k, c in enumerate(names))).alias("row"), *_keyed(docs, id_col, text_col)[1:3])
    rows = mark_members(whole, spans.select("key"))
    touched = rows.filter("maybe").join(spans, ["key", "tk"], "left")
    at = f"c{names.index(text_col)}"
    cut = F.pandas_udf(_without, "string")(F.col(f"row.{at}").cast("binary"), F.col("removed"))
    touched = touched.select(F.col("row").withField(at, cut).alias("row"))
    return rows.filter("not maybe").select("row").union(touched).select("row.*").toDF(*names)


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the contract removes."""
    found = repeated_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("removed").cast("long").alias("n_spans"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g FROM d, unnest(range(1, len(w) - 48)) AS t(i)
), f AS (
  SELECT g, min(doc_id) AS first_id FROM g GROUP BY g
), gone AS (
  SELECT DISTINCT doc_id, i + k AS pos FROM g JOIN f USING (g), unnest(range(50)) AS u(k) WHERE first_id < doc_id
), spans AS (
  SELECT doc_id, count(*) AS n_removed, count(*) FILTER (before IS NULL OR before < pos - 1) AS n_spans
  FROM (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM gone) GROUP BY doc_id
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256,
  coalesce(n_spans, 0)::BIGINT AS n_spans
FROM d LEFT JOIN spans USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
