"""Large JSON documents as tables: a top-level object of arrays, cut at the borders of the arrays' elements.

Spark's text source reads the document in byte ranges, with the closing brace as line separator, so any store and any size will do
and no task holds the whole. What a range means depends on what stands before it: whether it begins inside a string, and how
deep. A first pass sums up each range for both cases (quotes, depth gained, least depth) in a few numbers; put together in order,
these give the state at the start of each range. The second pass then cuts whole elements out of each range, and the pieces
of elements that cross borders are put together by key.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relyframe.sources.scratch import stored

_ESCAPE, _KEY = re.compile(rb"\\."), re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$', re.DOTALL)
_QUOTE, _BACK = 34, 92
#: Bytes before a value in which its name is looked for.
_KEY_BYTES = 4_096
#: Place of an element that goes on into another range; it is the last that begins in its own.
CROSSING = 1 << 40
#: Depth of the elements of a top-level array, and of their own content.
_ARRAY, _ELEMENT = 2, 3


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): what stands between closing braces, in order inside each byte range of a file."""
    raw = spark.read.option("lineSep", "}").text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _runs(batches: Iterable[pd.DataFrame]) -> Iterator[tuple[tuple[str, int], bytes]]:
    """((file, block), text) of rows that follow each other, a batch at a time; every fragment gets its brace back."""
    for pdf in batches:
        change = np.flatnonzero((pdf["file"].to_numpy()[1:] != pdf["file"].to_numpy()[:-1]) | (np.diff(pdf["block"]) != 0)) + 1
        edges = [0, *change.tolist(), len(pdf)]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                yield (pdf["file"].iloc[a], int(pdf["block"].iloc[a])), b"}".join([*map(bytes, pdf["value"].iloc[a:b]), b""])


def _steps(text: bytes, in_string: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """(places of brackets outside strings, +1 or -1 of each, quotes) of a text without its escapes."""
    raw = np.frombuffer(_ESCAPE.sub(b"__", text) if _BACK in text else text, np.uint8)
    quotes = raw == _QUOTE
    step = np.zeros(len(raw), np.int8)
    step[(raw == ord("{")) | (raw == ord("["))] = 1
    step[(raw == ord("}")) | (raw == ord("]"))] = -1
    inside = (np.cumsum(quotes, dtype=np.int64) + in_string) & 1
    at = np.flatnonzero((step != 0) & (inside == 0))
    return at, step[at], int(quotes.sum())


def _summaries(fragments: DataFrame) -> DataFrame:
    """(file, block, quotes, gain0, least0, gain1, least1): parity of quotes, and depth gained and least depth, for a range that
    begins outside (0) or inside (1) a string."""

    def each(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, int], list[int]] = {}
        for key, text in _runs(batches):
            own = held.setdefault(key, [0, 0, 0, 0, 0])
            for case in (0, 1):
                _, step, quotes = _steps(text, bool(case) ^ bool(own[0]))
                depth = own[1 + 2 * case] + np.cumsum(step, dtype=np.int64)
                own[2 + 2 * case] = min(own[2 + 2 * case], int(depth.min(initial=0)))
                own[1 + 2 * case] = int(depth[-1]) if len(depth) else own[1 + 2 * case]
            own[0] = (own[0] + quotes) & 1
        yield pd.DataFrame([(*k, *v) for k, v in held.items()], columns=["file", "block", "quotes", "gain0", "least0", "gain1", "least1"])

    return fragments.mapInPandas(each, "file string, block long, quotes long, gain0 long, least0 long, gain1 long, least1 long")


def _starts(summaries: pd.DataFrame) -> dict[tuple[str, int], tuple[bool, int, int]]:
    """(in a string, depth, block where the element that is open there began) at the start of each range: a row a range."""
    out = {}
    for file, own in summaries.groupby("file"):
        inside, depth, began = False, 0, -1
        for r in own.sort_values("block").itertuples():
            out[file, int(r.block)] = inside, depth, began
            gain, least = (r.gain1, r.least1) if inside else (r.gain0, r.least0)
            after = depth + gain
            if after < _ELEMENT:
                began = -1
            elif depth < _ELEMENT or depth + least < _ELEMENT:
                began = int(r.block)
            inside, depth = inside ^ bool(r.quotes), after
        if inside or depth > 0:
            raise ValueError(f"{file} is not a whole JSON document")
    return out


class _Cutter:
    """Cuts one range into elements; rows are (file, home, place, block, seq, section, text).

    ``home`` is the range in which an element begins and ``place`` its number there, or CROSSING where it goes on into others. A
    row without text says that a section begins; ``section`` is null before the first of them in the range.
    """

    def __init__(self, file: str, block: int, start: tuple[bool, int, int]):
        self.file, self.block, (self.inside, self.depth, self.began) = file, block, start
        self.place, self.seq, self.section, self.text = 0, 0, None, []
        self.open = self.depth >= _ELEMENT

    def _row(self, place: int, text: bytes | None) -> tuple:
        self.seq += 1
        home = self.began if text is not None and self.began >= 0 else self.block
        return self.file, home, place, self.block, self.seq, self.section, text

    def feed(self, text: bytes) -> Iterator[tuple]:
        at, step, quotes = _steps(text, self.inside)
        depth = self.depth + np.cumsum(step, dtype=np.int64)
        first = 0
        for k in np.flatnonzero(((depth == _ELEMENT) & (step > 0)) | (depth == _ARRAY)).tolist():
            here = int(at[k])
            if depth[k] == _ELEMENT:
                self.open, first = True, here
            elif step[k] > 0:
                key = _KEY.search(text[max(0, here - _KEY_BYTES) : here])
                if not key:
                    raise ValueError(f"{self.file}: a value without a name")
                self.section = json.loads(b'"' + key[1] + b'"')
                yield self._row(self.place, None)
            else:
                self.text.append(text[first : here + 1])
                yield self._row(CROSSING if self.began >= 0 else self.place, b"".join(self.text))
                self.open, self.began, self.text = False, -1, []
                self.place += 1
        if self.open:
            self.text.append(text[first:])
        self.inside ^= bool(quotes & 1)
        self.depth = int(depth[-1]) if len(depth) else self.depth

    def end(self) -> Iterator[tuple]:
        if self.open:
            yield self._row(CROSSING, b"".join(self.text))


def _resolved(groups: pd.DataFrame) -> list[tuple]:
    """(file, home, had, section, first, n, before): the section of each group of a range's elements, and how many of it stand before.

    Elements before the first section of their range belong to the one that was open there.
    """
    out, before, current, file = [], {}, None, None
    for r in groups.sort_values(["file", "home", "seq"]).itertuples():
        current, file = (None if r.file != file else current) if r.section is None else r.section, r.file
        if r.n:
            out.append((r.file, int(r.home), r.section, current, int(r.first), int(r.n), before.get((file, current), 0)))
            before[file, current] = before.get((file, current), 0) + int(r.n)
    return out


def read_sections(spark: SparkSession, path: str) -> tuple[DataFrame, set[str]]:
    """(file, section, ord, text) of each element of each top-level array of the documents at ``path``, with its place in the
    array; and the names of the sections.

    Elements are objects. Their texts are written once; select a section and parse its text with ``from_json``. An empty array
    gives no rows; a document that isn't whole raises ValueError. The driver holds a row a byte range and section.
    """
    fragments = _fragments(spark, path)
    starts = _starts(_summaries(fragments).toPandas())
    names = ["file", "home", "place", "block", "seq", "section", "text"]

    def each(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cutter = None
        for (file, block), text in _runs(batches):
            rows: list[tuple] = []
            if cutter is None or (cutter.file, cutter.block) != (file, block):
                rows += cutter.end() if cutter else ()
                cutter = _Cutter(file, block, starts[file, block])
            rows += cutter.feed(text)
            yield pd.DataFrame(rows, columns=names)
        if cutter:
            yield pd.DataFrame(list(cutter.end()), columns=names)

    pieces = stored(fragments.mapInPandas(each, "file string, home long, place long, block long, seq long, section string, text binary"))
    crossing = pieces.filter((F.col("place") == CROSSING) & F.col("text").isNotNull()).groupBy("file", "home", "place")
    crossing = crossing.agg(F.array_sort(F.collect_list(F.struct("block", "seq", "section", "text"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda acc, x: F.concat(acc, x["text"]))
    crossing = crossing.select("file", "home", "place", F.col("parts")[0]["seq"].alias("seq"), F.col("parts")[0]["section"].alias("section"), joined.alias("text"))
    rows = stored(pieces.filter((F.col("place") < CROSSING) | F.col("text").isNull()).select("file", "home", "place", "seq", "section", "text").union(crossing))
    groups = rows.groupBy("file", "home", "section").agg(F.min("seq").alias("seq"), F.count("text").alias("n"), F.min(F.when(F.col("text").isNotNull(), F.col("place"))).alias("first")).toPandas()
    groups["section"] = groups["section"].astype(object).where(groups["section"].notna(), None)
    table = spark.createDataFrame(_resolved(groups), "of string, at long, had string, name string, first long, n long, before long")
    met = (F.col("file") == F.col("of")) & (F.col("home") == F.col("at")) & F.col("section").eqNullSafe(F.col("had"))
    named = rows.filter("text is not null").join(F.broadcast(table), met)  # a row a range and section
    order = F.col("before") + F.least(F.col("place") - F.col("first"), F.col("n") - 1)
    return named.select("file", F.col("name").alias("section"), order.alias("ord"), F.col("text").cast("string").alias("text")), {x for x in groups["section"] if x is not None}
