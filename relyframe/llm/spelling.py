"""Operator 13: groups of spelling variants by K-d trees over letter-count vectors.

One edit changes a word's letter counts by at most two in L1 distance: an inserted or deleted letter by one, a replaced one by
two. So near words are looked for by range searches, per pair of lengths, in K-d trees over the distinct count vectors; only
then is the order of letters verified.

Counts are written in unary, a bit for "at least t times letter x": the L1 distance of two vectors is the number of differing
bits, a tree splits at the bit that is most even, and a box is the bits that all its vectors have and those that any has. Two
boxes are apart by the bits that all of one and none of the other have, and are pruned beyond the range.

The upper part of the trees deals words to tasks. It is fitted to a bounded sample for each length with many words; every word
is dealt to the one cell that it belongs to, and visits each other cell whose box is within the range.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relyframe.llm.common import materialize, table

#: Letters of a run; only A-Z are lower-cased.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = 26 + 64
#: One run in so many loses a letter.
EDITED = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Words of one length that a cell holds on average, and words of a length to which its upper tree is fitted at most.
CELL_WORDS, SAMPLE = 16_384, 32_768
#: Vectors of a leaf of the trees inside a cell.
LEAF = 16
_PAIRS = 1 << 18
#: Multipliers of letters by place, and marks of places.
_SEED = 13


# Words and counts


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of at least LEAST_LENGTH letters that occur LEAST_COUNT times or more.

    A run loses the letter h mod its length where EDITED divides h, the crc32 of id, colon and run. A null text has no runs;
    a null id counts as an empty one; repeated rows count each; no documents give no words. Other columns are ignored.
    """
    text = F.translate(F.coalesce(docs[text_col], F.lit("")), UPPER, LOWER)
    runs = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    h, length = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")), F.char_length("run")
    at = F.pmod(h, length.cast("long")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, length))
    words = runs.select(F.when(h % EDITED == 0, shorter).otherwise(F.col("run")).alias("word"))
    counted = words.filter(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= LEAST_COUNT)


def codes_of(words: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of equally long words as numbers below LETTERS (a row a word), and the words' count vectors."""
    points = np.array([np.frombuffer(w.encode("utf-32-le"), "<u4") for w in words])
    codes = np.where(points < 128, points - 97, points - 0xC0 + 26).astype(np.int64)
    n = len(codes)
    counts = np.bincount((np.arange(n)[:, None] * LETTERS + codes).ravel(), minlength=n * LETTERS)
    return codes, counts.reshape(n, LETTERS)


def unary(counts: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Count vectors as rows of packed bits, most[x] bits a letter: bit t of x says that there are more than t of it."""
    columns = [counts[:, x] > t for x in np.flatnonzero(most) for t in range(most[x])]
    n_bits = -(-max(1, len(columns)) // 64) * 64
    bits = np.zeros((len(counts), n_bits), bool)
    if columns:
        bits[:, : len(columns)] = np.stack(columns, axis=1)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


# Trees


class Tree:
    """A K-d tree over rows of unary bits; a node's rows are a slice of ``order``, and its children have numbers above its own."""

    def __init__(self, rows: np.ndarray, leaf: int):
        self.rows, n = rows, len(rows)
        bits = np.unpackbits(rows.view(np.uint8), axis=1, bitorder="little") if n else np.empty((0, 0), np.uint8)
        self.order = np.arange(n)
        start, end, left, split = [0], [n], [-1], [-1]
        level = [0] if n > leaf else []
        while level:
            below = []
            for k in level:
                own = self.order[start[k] : end[k]]
                ones = bits[own].sum(axis=0, dtype=np.int64)
                bit = int(np.argmin(np.abs(2 * ones - len(own))))
                if ones[bit] in (0, len(own)):
                    continue  # equal rows
                split[k], left[k] = bit, len(start)
                has = bits[own, bit].astype(bool)
                self.order[start[k] : end[k]] = np.concatenate([own[~has], own[has]])
                middle = start[k] + int((~has).sum())
                for a, b in ((start[k], middle), (middle, end[k])):
                    if b - a > leaf:
                        below.append(len(start))
                    start.append(a)
                    end.append(b)
                    left.append(-1)
                    split.append(-1)
            level = below
        self.start, self.end, self.left, self.split = (np.array(x) for x in (start, end, left, split))
        ordered = rows[self.order]
        self.all = np.stack([np.bitwise_and.reduce(ordered[a:b], axis=0) for a, b in zip(start, end, strict=True)]) if n else np.zeros((1, 0), np.uint64)
        self.any = np.stack([np.bitwise_or.reduce(ordered[a:b], axis=0) for a, b in zip(start, end, strict=True)]) if n else np.zeros((1, 0), np.uint64)


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=1, dtype=np.int64)


def range_pairs(a: Tree, b: Tree, distance: int, same: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of two trees at exactly this L1 distance; of one tree (``same``), each pair once.

    Pairs of nodes whose boxes are further apart are pruned; of the others the larger node that isn't a leaf is split.
    """
    waiting = [(np.zeros(1, np.int64), np.zeros(1, np.int64))] if len(a.rows) and len(b.rows) else []
    while waiting:
        i, j = waiting.pop()
        if len(i) > _PAIRS // 16:
            half = len(i) // 2
            waiting += [(i[:half], j[:half]), (i[half:], j[half:])]
            continue
        apart = _ones(a.all[i] & ~b.any[j]) + _ones(b.all[j] & ~a.any[i])
        i, j = i[apart <= distance], j[apart <= distance]
        leaf_i, leaf_j = a.left[i] < 0, b.left[j] < 0
        size_i, size_j = a.end[i] - a.start[i], b.end[j] - b.start[j]
        done = leaf_i & leaf_j
        yield from _leaf_pairs(a, b, i[done], j[done], distance, same)
        own = ~done & same & (i == j)
        first = ~done & ~own & ~leaf_i & (leaf_j | (size_i >= size_j))
        second = ~done & ~own & ~first
        l_own, l_first, l_second = a.left[i[own]], a.left[i[first]], b.left[j[second]]
        i = np.concatenate([l_own, l_own, l_own + 1, l_first, l_first + 1, i[second], i[second]])
        j = np.concatenate([l_own, l_own + 1, l_own + 1, j[first], j[first], l_second, l_second + 1])
        if len(i):
            waiting.append((i, j))


def _leaf_pairs(a: Tree, b: Tree, i: np.ndarray, j: np.ndarray, distance: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    n_i, n_j = a.end[i] - a.start[i], b.end[j] - b.start[j]
    sizes = n_i * n_j
    edges = np.append(0, np.cumsum(sizes))
    at = 0
    while at < len(i):
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + _PAIRS, side="right")) - 1)
        which = np.repeat(np.arange(at, to), sizes[at:to])
        place = np.arange(len(which)) - (edges[which] - edges[at])
        x, y = a.start[i[which]] + place // n_j[which], b.start[j[which]] + place % n_j[which]
        if same:
            kept = (i[which] != j[which]) | (x < y)
            x, y = x[kept], y[kept]
        x, y = a.order[x], b.order[y]
        near = _ones(a.rows[x] ^ b.rows[y]) == distance
        yield x[near], y[near]
        at = to


# Inside a cell


class Words:
    """Equally long words with their counts, letter codes, and their distinct vectors: ``held[first[v] : first[v + 1]]`` has those of v."""

    def __init__(self, words: np.ndarray, n: np.ndarray):
        self.words, self.n = words, n
        self.rank = np.empty(len(words), np.int64)
        self.rank[np.argsort(words)] = np.arange(len(words))
        self.codes, counts = codes_of(words) if len(words) else (np.empty((0, 0), np.int64), np.empty((0, LETTERS), np.int64))
        self.vectors, of = np.unique(counts, axis=0, return_inverse=True) if len(words) else (counts, np.empty(0, np.int64))
        self.held = np.argsort(of.ravel(), kind="stable")
        self.first = np.append(0, np.cumsum(np.bincount(of.ravel(), minlength=len(self.vectors))))
        r = np.random.default_rng(_SEED)
        width = self.codes.shape[1] + 1
        factor = r.integers(1, 1 << 63, width, dtype=np.uint64) | np.uint64(1)
        self.marks = r.integers(1, 1 << 63, width, dtype=np.uint64)
        letters = (self.codes + 1).astype(np.uint64)
        self.here = letters * factor[:-1]  # each letter at its place
        self.sum = self.here.sum(axis=1, dtype=np.uint64)
        # A word without the letter at p: what is before p, and what is behind it one place earlier.
        moved = np.zeros_like(self.here)
        moved[:, 1:] = letters[:, 1:] * factor[:-2] if width > 1 else 0
        before = np.cumsum(self.here, axis=1, dtype=np.uint64) - self.here
        behind = moved.sum(axis=1, dtype=np.uint64)[:, None] - np.cumsum(moved, axis=1, dtype=np.uint64)
        self.without = before + behind


def _members(held: Words, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair, word): the words of each pair's vector."""
    size = held.first[v + 1] - held.first[v]
    pair = np.repeat(np.arange(len(v)), size)
    return pair, held.held[np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size) + held.first[v[pair]]]


def _places(held: Words, pair: np.ndarray, word: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, word, place) of each occurrence of the pair's letter."""
    at, place = np.nonzero(held.codes[word] == letter[pair][:, None])
    return pair[at], word[at], place


def _matched(pair_a: np.ndarray, key_a: np.ndarray, pair_b: np.ndarray, key_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of a and b with equal pair and key."""
    mixed_a, mixed_b = (key + pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for pair, key in ((pair_a, key_a), (pair_b, key_b)))
    order = np.argsort(mixed_b)
    low, high = (np.searchsorted(mixed_b[order], mixed_a, side=side) for side in ("left", "right"))
    x = np.repeat(np.arange(len(mixed_a)), high - low)
    y = order[np.arange(len(x)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[x]]
    same = (pair_a[x] == pair_b[y]) & (key_a[x] == key_b[y])
    return x[same], y[same]


def replaced(a: Words, u: np.ndarray, b: Words, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word of a, word of b) that differ by one replaced letter, of pairs of vectors at distance two."""
    more = a.vectors[u] - b.vectors[v]
    x, y = more.argmax(axis=1), more.argmin(axis=1)
    pa, wa, at = _places(a, *_members(a, u), x)
    pb, wb, bt = _places(b, *_members(b, v), y)
    i, j = _matched(pa, (a.sum[wa] - a.here[wa, at]) ^ a.marks[at], pb, (b.sum[wb] - b.here[wb, bt]) ^ b.marks[bt])
    wa, wb, at, bt = wa[i], wb[j], at[i], bt[j]
    exact = (at == bt) & ((a.codes[wa] != b.codes[wb]).sum(axis=1) == 1)
    return wa[exact], wb[exact]


def inserted(a: Words, u: np.ndarray, b: Words, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word of a, word of b) where the longer words of b have one more letter, of pairs of vectors at distance one."""
    x = (b.vectors[v] - a.vectors[u]).argmax(axis=1)
    pa, wa = _members(a, u)
    pb, wb, bt = _places(b, *_members(b, v), x)
    i, j = _matched(pa, a.sum[wa], pb, b.without[wb, bt])
    wa, wb, bt = wa[i], wb[j], bt[j]
    place = np.arange(a.codes.shape[1])
    cut = np.take_along_axis(b.codes[wb], place + (place >= bt[:, None]), axis=1)
    exact = (cut == a.codes[wa]).all(axis=1)
    if not exact.any():
        return wa[:0], wb[:0]
    both = np.unique(np.stack([wa[exact], wb[exact]]), axis=1)  # a letter of a run of equal ones can be cut at any place of it
    return both[0], both[1]


class _Best:
    """For each word of a group of words, how many near ones have been seen and the first of them by count and spelling."""

    def __init__(self, held: Words):
        self.held, self.near = held, np.zeros(len(held.words), np.int64)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, own: np.ndarray, other: Words, theirs: np.ndarray) -> None:
        np.add.at(self.near, own, 1)
        order = np.lexsort((other.rank[theirs], -other.n[theirs], own))
        own, theirs = own[order], theirs[order]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else order
        self.found.append((own[first], other.words[theirs[first]], other.n[theirs[first]]))

    def rows(self) -> pd.DataFrame:
        own, words, n = (np.concatenate([f[k] for f in self.found]) if self.found else np.empty(0, object) for k in range(3))
        frame = pd.DataFrame({"own": own, "form": words, "form_n": n}).sort_values(["own", "form_n", "form"], ascending=[True, False, True])
        frame = frame.drop_duplicates("own")
        own = frame["own"].to_numpy(np.int64)
        return pd.DataFrame({"word": self.held.words[own], "n_near": self.near[own], "form_n": frame["form_n"].to_numpy(np.int64), "form": frame["form"].to_numpy()})


def _search(members: Words, best: _Best, others: Words, other_best: _Best, distance: int, verify, same: bool = False) -> None:
    """All near pairs of two groups, noted on both sides."""
    if not len(members.words) or not len(others.words):
        return
    most = np.maximum(members.vectors.max(axis=0), others.vectors.max(axis=0))
    a = Tree(unary(others.vectors, most), LEAF)
    b = a if same else Tree(unary(members.vectors, most), LEAF)
    for u, v in range_pairs(a, b, distance, same):
        if len(u):
            x, y = verify(others, u, members, v)
            other_best.add(x, members, y)
            best.add(y, others, x)


def near_in_cell(pdf: pd.DataFrame) -> pd.DataFrame:
    """(word, n_near, form_n, form) of the words of a cell and its visitors; ``role`` is 0 for the cell's own words, 1 for equally
    long visitors, 2 for those that are shorter by one."""
    own, visitors, shorter = (Words(pdf["word"].to_numpy(object)[pdf["role"] == k], pdf["n"].to_numpy(np.int64)[pdf["role"] == k]) for k in range(3))
    bests = [_Best(x) for x in (own, visitors, shorter)]
    _search(own, bests[0], own, bests[0], 2, replaced, same=True)
    _search(own, bests[0], visitors, bests[1], 2, replaced)
    _search(own, bests[0], shorter, bests[2], 1, inserted)
    return pd.concat([b.rows() for b in bests], ignore_index=True)


# Over all words


class Cells:
    """The upper tree of a length: a cell for each leaf, with the least and the greatest count of each letter that it may have."""

    def __init__(self, sample: list[str], n_cells: int):
        _, counts = codes_of(sample)
        most = counts.max(axis=0)
        names = [(x, t) for x in np.flatnonzero(most) for t in range(most[x])]
        tree = Tree(unary(counts, most), max(1, -(-len(sample) // n_cells)))
        low, high = np.zeros((len(tree.left), LETTERS), np.int64), np.full((len(tree.left), LETTERS), np.iinfo(np.int64).max)
        for k in np.flatnonzero(tree.left >= 0):
            x, t = names[tree.split[k]]
            for child in (tree.left[k], tree.left[k] + 1):
                low[child], high[child] = low[k], high[k]
            high[tree.left[k], x], low[tree.left[k] + 1, x] = t, t + 1
        leaves = np.flatnonzero(tree.left < 0)
        self.low, self.high = low[leaves], high[leaves]

    def within(self, counts: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) for each cell whose box is within the distance of a count vector; each vector is in the box of one."""
        rows, cells = [], []
        most = max(1, _PAIRS // 4 // len(self.low))
        for at in range(0, len(counts), most):
            part = counts[at : at + most, None, :]
            apart = np.maximum(self.low - part, 0).sum(axis=2) + np.maximum(part - self.high, 0).sum(axis=2)
            i, j = np.nonzero(apart <= distance)
            rows.append(i + at)
            cells.append(j)
        return np.concatenate(rows), np.concatenate(cells)


def fitted_cells(words: DataFrame) -> dict[int, Cells]:
    """Upper trees of the lengths with over CELL_WORDS words, each fitted to at most SAMPLE of them in the order of a hash.

    A length without one is a single cell. The trees hold a node for each CELL_WORDS words.
    """
    length = F.char_length("word").alias("length")
    sizes = {r.length: r["count"] for r in words.groupBy(length).count().filter(F.col("count") > CELL_WORDS).collect()}
    if not sizes:
        return {}
    drawn = F.row_number().over(Window.partitionBy("length").orderBy(F.xxhash64("word"), "word"))
    chosen = words.select(length, "word").filter(F.col("length").isin(list(sizes))).withColumn("r", drawn).filter(F.col("r") <= SAMPLE)
    sample: dict[int, list[str]] = {}
    for r in chosen.toLocalIterator():
        sample.setdefault(r.length, []).append(r.word)
    return {k: Cells(sorted(own), -(-sizes[k] // CELL_WORDS)) for k, own in sample.items()}


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, n_near, near_n, near): how many words are one edit away, and of these the first by count and then spelling.

    ``words`` has distinct words of letters of RUN and their counts ``n``. Words without near ones have zero and nulls.
    """
    trees = fitted_cells(words)

    def deal(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for length, own in pdf.groupby(pdf["word"].str.len()):
                _, counts = codes_of(own["word"])
                home = np.zeros(len(own), np.int64)
                parts = []
                for to, distance in ((length, 2), (length + 1, 1)):
                    if to in trees:
                        row, cell = trees[to].within(counts, distance)
                    else:
                        row, cell = np.arange(len(own)), np.zeros(len(own), np.int64)
                    role = np.full(len(row), 2)
                    if to == length:
                        if to in trees:
                            i, j = trees[to].within(counts, 0)
                            home[i] = j
                        # Equally long words of two cells meet in the one with the greater number only.
                        role = np.where(cell == home[row], 0, 1)
                        row, cell, role = (x[cell >= home[row]] for x in (row, cell, role))
                    parts.append(pd.DataFrame({"length": to, "cell": cell, "role": role, "word": own["word"].to_numpy()[row], "n": own["n"].to_numpy()[row]}))
                yield pd.concat(parts, ignore_index=True)

    dealt = words.select("word", "n").mapInPandas(deal, "length long, cell long, role int, word string, n long")
    found = dealt.groupBy("length", "cell").applyInPandas(near_in_cell, "word string, n_near long, form_n long, form string")
    none = F.lit(None)
    both = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), none.cast("long").alias("form_n"), none.cast("string").alias("form"))
    both = both.unionByName(found.withColumn("n", none.cast("long")))
    first = F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), "form"))
    return both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min(first).alias("x")).select(
        "word", "n", "n_near", (-F.col("x.less")).alias("near_n"), F.col("x.form").alias("near")
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the chain of (word, form) rows from each word ends. Chains rise in count, so they have an end.

    Each round doubles the steps that are known, so rounds grow with the logarithm of the longest chain.
    """
    known = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        step = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = materialize(known.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if ahead.filter("moved").isEmpty():
            return ahead.select("word", "root")
        known = ahead.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of ``count_words``.

    A word's form is its near word with the greatest count (of equal counts the first in the order of code points), if that is
    at least twice its own; its root is where the forms lead, and the word itself without a form.
    """
    words = materialize(count_words(docs, id_col, text_col))
    near = materialize(near_words(words))
    taken: Column = F.col("near_n") >= 2 * F.col("n")
    named = near.select("word", F.when(taken, F.col("near")).alias("form"), "n", "n_near", F.when(taken, F.col("near_n")).alias("form_n"))
    ends = roots(named.filter("form is not null"))
    joined = named.join(ends, "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of the words of all documents."""
    return variants(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, lower_run, count(*) AS c FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS lower_run FROM documents
  ) GROUP BY ALL
), coded AS (
  SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || lower_run)) AS x FROM runs
), steps AS (  -- crc32: eight shifts a byte
  SELECT doc_id, lower_run, c, xor(list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, len(x), 2), lambda i: list_prepend(256 + ('0x' || substr(x, i, 2))::BIGINT, [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
    lambda acc, b: CASE WHEN b >= 0 THEN xor(acc, b - 256) ELSE xor(acc >> 1, (acc & 1) * 3988292384) END), 4294967295) AS h FROM coded
), words AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(lower_run, 1, (h % length(lower_run))::INT) || substr(lower_run, (h % length(lower_run))::INT + 2) ELSE lower_run END AS word, c FROM steps
), w AS (
  SELECT word, sum(c)::BIGINT AS n FROM words WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3
), cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS k FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.k = b.k AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN w b ON a.k = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN w b ON a.k = b.word
), best AS (
  SELECT word, count(*) AS n_near, (list(other ORDER BY m DESC, other))[1] AS other, max(m) AS m, any_value(n) AS n FROM near GROUP BY word
), f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN other END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n FROM w LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS root FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON chain.root = f.word WHERE f.form IS NOT NULL
), ends AS (
  SELECT chain.word, root FROM chain JOIN f ON chain.root = f.word WHERE f.form IS NULL
)
SELECT f.word, f.form, ends.root, f.n, f.n_near, f.form_n FROM f JOIN ends USING (word)
"""
