"""Operator 10: SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are made distinct first. Two fingerprints that differ in at most r bits agree wholly on some of
b blocks of bits, so each fingerprint is put under one upper node for each choice of b - r blocks: the node's
shared masked pattern. Nodes are spread by key; inside a node, fingerprints are sorted by Gray rank, which
puts those that share prefixes side by side, and groups of neighbours get nodes with the bits all members
share. Two groups whose shared bits already differ in more than r places are pruned whole.

A node with more than NODE_LIMIT members (one big family of near copies) isn't walked in one task: its members
are linked exactly through their one-bit variants instead, in groups of 65 members at most. Links inside a node
are reduced to spanning ones. Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relyframe.llm.common import mark_members, materialize, table, temporary
from relyframe.llm.components import components

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Members up to which a node of the index is walked by one task.
NODE_LIMIT = 2_048
#: Near copies: sets of five-word shingles whose Jaccard similarity is SIMILAR or more.
WORDS = 5
SIMILAR = (4, 5)
#: Least hashes of a document.
LEAST = 64
#: Content keys of a document at each level: how many, and how many least hashes name a node. Two sets of similarity 0.8 share a node of
#: the first level with probability 1 - (1 - 0.8 ** 2) ** 8 = 0.9997, one of each later level with 0.9999999, 0.9999 and 0.9994.
LEVELS = ((8, 2), (24, 3), (24, 5), (40, 8))
#: Members up to which a node is compared by one task.
MEMBERS = 512
#: Differing bits of two fingerprints up to which a pair is proposed: at a similarity of 0.8 they differ in 64 acos(2 s / (1 + s)) / pi
#: = 9.7 bits on average with a standard deviation of 2.9. Of 64 least hashes, 51.2 agree on average (deviation 3.2); at a similarity of
#: 0.6, 42 or more do in one pair of five, at 0.5 in one of a hundred.
WIDE_RADIUS, LEAST_AGREED = 20, 42
#: Blocks of documents outside the largest group of a hot node up to which all are compared there. Beyond, the node's documents are
#: dealt anew by the more and longer keys of the next level; at the last level all nodes are compared whole.
WHOLE_BLOCKS = 8
#: Hot nodes up to which their list is broadcast.
BROADCAST_NODES = 100_000
_LAST = (1 << 63) - 1
_LEAF, _FANOUT, _SMALL, _PIECE = 16, 8, 32, 1 << 15
_PAIRS = 1 << 18


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of the XXH64 hashes of word shingles, as an unsigned number; zero without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams: Iterable[bytes] = iter([b" ".join(words)])
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    n = max(1, len(words) - shingle + 1)
    return _majority(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n))


def _majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _PIECE):
        bits = np.unpackbits(hashes[at : at + _PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) for each document; fp is the 64-bit fingerprint as a signed long. A null text has fingerprint zero."""

    def each(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = np.array([fingerprint(t, shingle) for t in pdf["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"id": pdf["id"], "fp": fps})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("binary").alias("text"))
    return rows.mapInPandas(each, f"id {kind}, fp long")


def gray_rank(code: Column) -> Column:
    """Place of a 64-bit code in Gray order, as the bits of a signed long."""
    for k in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, k))
    return code


def _masks(n_blocks: int, radius: int) -> list[int]:
    """Bit masks of the choices of n_blocks - radius blocks; one of them is free of any radius differences."""
    edges = [64 * k // n_blocks for k in range(n_blocks + 1)]
    blocks = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(blocks[k] for k in chosen) for chosen in combinations(range(n_blocks), n_blocks - radius)]


def n_blocks_for(n: int, radius: int = RADIUS) -> int:
    """Blocks for which a node holds at most about 64 of n random fingerprints."""
    blocks = radius + 1
    while n / 2 ** (64 * (blocks - radius) / blocks) > 64 and blocks < radius + 8:
        blocks += 1
    return blocks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _pairs_of_groups(fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places within the radius in a node's fingerprints, which are sorted by Gray rank, in pieces.

    Groups of neighbours are leaves; FANOUT groups make one above. A group has the bits that all its members share, with
    their pattern. Two groups whose shared bits differ in more than the radius are pruned with all that is below them.
    """
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    starts = [np.arange(0, len(fps), _LEAF)]
    while len(starts[-1]) > _FANOUT:
        starts.append(starts[-1][::_FANOUT])
    levels = []
    for s in starts:
        lead = np.repeat(fps[s], np.diff(np.append(s, len(fps))))
        levels.append((fps[s], ones ^ np.bitwise_or.reduceat(fps ^ lead, s)))  # pattern, bits that all members share
    step, leaf = np.arange(_FANOUT), np.arange(_LEAF)
    waiting = [(len(starts) - 1, *np.triu_indices(len(starts[-1])))] if len(fps) else []
    while waiting:
        depth, a, b = waiting.pop()
        pattern, shared = levels[depth]
        near = np.bitwise_count((pattern[a] ^ pattern[b]) & shared[a] & shared[b]) <= radius
        a, b = a[near], b[near]
        width, size = (step, len(starts[depth - 1])) if depth else (leaf, len(fps))
        most = max(1, _PAIRS // len(width) ** 2)
        for at in range(0, len(a), most):
            i = (a[at : at + most, None, None] * len(width) + width[:, None] + 0 * width).ravel()
            j = (b[at : at + most, None, None] * len(width) + width + 0 * width[:, None]).ravel()
            inside = (j < size) & (i <= j if depth else i < j)
            i, j = i[inside], j[inside]
            if depth:
                waiting.append((depth - 1, i, j))
                continue
            near = np.bitwise_count(fps[i] ^ fps[j]) <= radius
            yield i[near], j[near]


def _spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Label of each of n places: the smallest place that it is joined with."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def _walk(radius: int):
    """Links inside the nodes of a partition that is sorted by node and Gray rank."""

    def links(node: np.ndarray, fps: np.ndarray) -> pd.DataFrame:
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        size = np.diff(np.append(first, len(node)))
        size_of = np.repeat(size, size)
        a, b = [], []
        for k in range(1, min(_SMALL, int(size.max()))):  # small nodes, all at once
            i = np.flatnonzero((node[k:] == node[:-k]) & (size_of[:-k] <= _SMALL))
            near = np.bitwise_count(fps[i] ^ fps[i + k]) <= radius
            a.append(i[near])
            b.append(i[near] + k)
        for s, n in zip(first[size > _SMALL], size[size > _SMALL], strict=True):
            for i, j in _pairs_of_groups(fps[s : s + n], radius):
                a.append(i + s)
                b.append(j + s)
        label = _spanning(len(fps), np.concatenate(a), np.concatenate(b)) if a else np.arange(len(fps))
        moved = np.flatnonzero(label != np.arange(len(fps)))
        return pd.DataFrame({"u": fps[moved].view(np.int64), "v": fps[label[moved]].view(np.int64)})

    def each(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, fps = np.empty((0,), object), np.empty(0, np.uint64)
        for pdf in batches:
            key = np.rec.fromarrays([pdf["mask"].to_numpy(np.int64), pdf["node"].to_numpy(np.int64)]).astype("i8,i8")
            key = np.ascontiguousarray(key).view("V16").ravel()
            node = np.concatenate([node, key]) if len(node) else key
            fps = np.concatenate([fps, pdf["fp"].to_numpy(np.int64).view(np.uint64)])
            last = np.flatnonzero(node != node[-1])
            cut = last[-1] + 1 if len(last) else 0  # the last node may go on in the next batch
            if cut:
                yield links(node[:cut], fps[:cut])
            node, fps = node[cut:], fps[cut:]
        if len(fps):
            yield links(node, fps)

    return each


def near_links(distinct: DataFrame, radius: int = RADIUS, node_limit: int = NODE_LIMIT) -> DataFrame:
    """(u, v) links that span the same components as all pairs of ``fp`` within the radius.

    ``distinct`` has one row a fingerprint. No rows give no links.
    """
    if radius > 2:
        raise ValueError("large nodes are exact for a radius of at most 2")
    n_blocks = n_blocks_for(distinct.count(), radius)
    masks = F.array(*(F.lit(_signed(m)) for m in _masks(n_blocks, radius)))
    keyed = distinct.select("fp", F.explode(masks).alias("mask")).withColumn("node", F.col("fp").bitwiseAND(F.col("mask")))
    counts = keyed.groupBy("mask", "node").agg(F.count("*").alias("n")).filter("n > 1")
    counts = materialize(counts)  # so that a hot node is a plain key of the join, which Spark splits
    keyed = materialize(keyed.join(counts, ["mask", "node"]))
    walked = (
        keyed.filter(F.col("n") <= node_limit)
        .withColumn("rank", gray_rank(F.col("fp")))
        .repartition("mask", "node")
        .sortWithinPartitions("mask", "node", "rank")
        .select("mask", "node", "fp")
        .mapInPandas(_walk(radius), "u long, v long")
    )
    # Members of a large node: two within 2 bits share a variant with at most one bit changed.
    bits = [0, *(_signed(1 << k) for k in range(64))]
    flips = F.array(*(F.lit(x) for x in bits))
    hot = keyed.filter(F.col("n") > node_limit).select("fp").distinct()
    met = hot.select("fp", F.explode(flips).alias("flip")).groupBy(F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    met = met.agg(F.array_sort(F.collect_set("fp")).alias("members")).filter(F.size("members") > 1)
    hot_links = met.select(F.explode(F.slice("members", 2, 64)).alias("u"), F.col("members")[0].alias("v")).distinct()
    return walked.union(hot_links)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): fingerprints linked at RADIUS or fewer differing bits, closed transitively.

    component_id is the smallest id that is reachable, the row's own included. Documents with null or empty texts
    have fingerprint zero and are linked like others. A null id is kept and is never a component's name unless all
    ids of the component are null. Repeated rows stay. No documents give no rows; other columns are dropped.
    """
    prints = materialize(fingerprints(docs, id_col, text_col))
    distinct = prints.groupBy("fp").agg(F.min("id").alias("least_id"))
    roots = components(near_links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("id", "fp", "component_id")


def shingles(text: bytes | None, shingle: int = WORDS) -> np.ndarray:
    """The set of XXH64 hashes of a text's word shingles, in order; fewer words are one shingle, no words none."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)) if len(words) >= shingle else iter([b" ".join(words)])
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64))


def _same(hashes: np.ndarray) -> int:
    """A name of a set of shingles."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def _factors() -> np.ndarray:
    """Seeded odd factors; the order of a set's multiples is as good as a random one, since the set's members are hashes."""
    return np.random.default_rng(SEED).integers(1 << 62, 1 << 63, LEAST, dtype=np.uint64) | np.uint64(1)


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    """For each factor the member of the set whose multiple is least: equal in two sets as often as they are similar."""
    return np.array([(hashes * f).min() for f in _factors()], np.uint64)


def _chosen(level: int) -> list[list[int]]:
    """Which least hashes name each node of a level: none twice on the first, seeded draws on the others."""
    n, depth = LEVELS[level]
    if n * depth <= LEAST:
        return [[k * depth + i for i in range(depth)] for k in range(n)]
    rng = np.random.default_rng(SEED + level)
    return [sorted(rng.choice(LEAST, depth, replace=False).tolist()) for _ in range(n)]


def content_keys(least: Column, level: int) -> Column:
    """The nodes of a document at a level, from the four bytes of each of its least hashes; none without words."""
    part = lambda i: F.substring(least, 4 * i + 1, 4)
    keys = [F.xxhash64(F.lit(level), F.lit(k), *(part(i) for i in own)) for k, own in enumerate(_chosen(level))]
    return F.when(F.octet_length(least) > 0, F.array(*keys)).otherwise(F.array().cast("array<long>"))


def _sketch(text: bytes | None) -> tuple[int, int, bytes]:
    """(grams, fp, least): name of the set of shingles, its fingerprint, four bytes of each least hash."""
    hashes = shingles(text)
    if not len(hashes):
        return _same(hashes), 0, b""
    least = (least_hashes(hashes) >> np.uint64(16)).astype("<u4").tobytes()
    return _same(hashes), int(np.uint64(_majority(hashes)).view(np.int64)), least


def _ranked(fps: np.ndarray) -> np.ndarray:
    """Places of fingerprints in Gray order."""
    rank = fps.copy()
    for k in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(k)
    return np.argsort(rank, kind="stable")


def node_pairs(first: np.ndarray, fps: np.ndarray, fits) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of places in the nodes that begin at the places ``first`` within WIDE_RADIUS bits, of which ``fits`` keeps some.

    Pairs of small nodes are compared all at once; a larger node's by the Gray-order index over its fingerprints.
    """
    size = np.diff(np.append(first, len(fps)))
    node, size_of = np.repeat(np.arange(len(first)), size), np.repeat(size, size)
    for k in range(1, min(_SMALL, int(size.max(initial=1)))):
        i = np.flatnonzero((node[k:] == node[:-k]) & (size_of[:-k] <= _SMALL))
        i = i[np.bitwise_count(fps[i] ^ fps[i + k]) <= WIDE_RADIUS]
        yield fits(i, i + k)
    for s, n in zip(first[size > _SMALL], size[size > _SMALL], strict=True):
        order = _ranked(fps[s : s + n]) + s
        for i, j in _pairs_of_groups(fps[order], WIDE_RADIUS):
            yield fits(order[i], order[j])


def _by_node(rows: DataFrame, of_nodes, schema: str) -> DataFrame:
    """``of_nodes`` over whole nodes, several at a time; rows have ``node`` and ``part``."""

    def each(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            edges = np.flatnonzero((np.diff(pdf["node"]) != 0) | (np.diff(pdf["part"]) != 0)) + 1
            whole = edges[-1] if len(edges) else 0  # the last node may go on in the next batch
            if whole:
                yield of_nodes(pdf.iloc[:whole])
            held = pdf.iloc[whole:].reset_index(drop=True)
        if held is not None and len(held):
            yield of_nodes(held)

    return rows.repartition("node", "part").sortWithinPartitions("node", "part").mapInPandas(each, schema)


def _pairs(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, apart): pairs of rows in one node and part that may be similar, and how many of their least hashes differ.

    A pair's roots differ, and so do its sides unless these are negative; LEAST_AGREED of its least hashes or more agree.
    """
    root, side = pdf["root"].to_numpy(), pdf["side"].to_numpy()
    signs = np.frombuffer(b"".join(pdf["sign"]), np.uint8).reshape(len(pdf), -1)

    def fits(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fit = (root[a] != root[b]) & ((side[a] != side[b]) | (side[a] < 0))
        a, b = a[fit], b[fit]
        agreed = (signs[a] == signs[b]).sum(axis=1, dtype=np.int64)
        fit = agreed >= LEAST_AGREED
        return a[fit], b[fit], signs.shape[1] - agreed[fit]

    first = np.flatnonzero(np.append(True, (np.diff(pdf["node"]) != 0) | (np.diff(pdf["part"]) != 0)))
    return node_pairs(first, pdf["fp"].to_numpy().view(np.uint64), fits)


def _met(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rows that have a candidate in their node and part."""
    met = np.zeros(len(pdf), bool)
    for a, b, _ in _pairs(pdf):
        met[a] = met[b] = True
    return pdf[met][["grams", "fp", "sign", "node", "part", "side", "root"]]


def is_similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of SIMILAR or more."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if len(a) * SIMILAR[1] < len(b) * SIMILAR[0]:
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both * SIMILAR[1] >= (len(a) + len(b) - both) * SIMILAR[0]


def _linked(pdf: pd.DataFrame) -> pd.DataFrame:
    """(u, v) links that join what the candidate pairs of exact similarity do; of these, pairs that are joined already are skipped."""
    _, group = np.unique(pdf["root"].to_numpy(), return_inverse=True)
    parent = list(range(int(group.max(initial=-1)) + 1))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    sets = [np.asarray(x).view(np.uint64) for x in pdf["shingles"]]
    links, key = [], pdf["grams"].to_numpy()
    for a, b, apart in _pairs(pdf):
        order = np.argsort(apart, kind="stable")  # the likeliest first
        for i, j in zip(a[order].tolist(), b[order].tolist(), strict=True):
            x, y = find(group[i]), find(group[j])
            if x != y and is_similar(sets[i], sets[j]):
                parent[max(x, y)] = min(x, y)
                links.append((i, j))
    u, v = (key[[x[k] for x in links]] for k in (0, 1)) if links else (key[:0], key[:0])
    return pd.DataFrame({"u": u, "v": v})


def _placed(left: DataFrame, level: int) -> DataFrame:
    """(grams, fp, sign, node, n): each document in those of its nodes of a level that others share."""
    at = left.select("grams", "fp", F.explode(content_keys(F.col("least"), level)).alias("node"))
    counts = materialize(at.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1"))
    # Documents that share no node are left out before their signs are sent. Written first, so that Spark splits a hot node.
    # A sign is the lowest byte of each least hash.
    sign = F.concat(*(F.substring("least", 4 * i + 1, 1) for i in range(LEAST)))
    rows = left.select("grams", "fp", sign.alias("sign"), F.explode(content_keys(F.col("least"), level)).alias("node"))
    return materialize(mark_members(rows, counts, "node").filter("maybe").drop("maybe").join(counts, "node"))


def _parted(members: DataFrame) -> DataFrame:
    """Rooted members with ``part`` and ``side``: hot nodes in random parts of about MEMBERS members."""
    part = F.pmod(F.xxhash64("grams"), F.ceil(F.col("n") / MEMBERS))
    return members.withColumns({"part": part, "side": F.lit(-1)})


def _blocked(hot: DataFrame, last: bool) -> tuple[DataFrame, DataFrame]:
    """(members, open nodes): rooted members of hot nodes with ``part`` and ``side`` such that in each node all pairs of different
    roots meet in some part, and the nodes that are left to the next level.

    The members of a node's largest group are dealt to parts, and every part also gets a block of the others, once for each
    block; the blocks of the others meet in pairs. The largest group's own members need not meet. Unless the level is the last,
    a hot node of many groups (one passage that different texts share) with more than WHOLE_BLOCKS blocks is left open.
    """
    groups = materialize(hot.groupBy("node", "root").agg(F.count("*").alias("m")))
    nodes = groups.groupBy("node").agg(F.max_by("root", "m").alias("giant"), F.max("m").alias("m"), F.sum("m").alias("all"))
    nodes = nodes.withColumns({"p": F.ceil(F.col("m") / MEMBERS), "q": F.ceil((F.col("all") - F.col("m")) / MEMBERS)})
    nodes = materialize(nodes.filter("q > 0").select("node", "giant", "p", "q"))
    whole = nodes if last else nodes.filter(F.col("q") <= WHOLE_BLOCKS)
    columns = hot.columns
    hot = hot.join(F.broadcast(whole) if nodes.count() <= BROADCAST_NODES else whole, "node")
    p, q, one = F.col("p"), F.col("q"), F.lit(1).cast("long")
    each = lambda n: F.sequence(F.lit(0).cast("long"), n - one)
    own, block = F.pmod(F.xxhash64("grams"), p), F.pmod(F.xxhash64("grams"), q)
    place = lambda part, side: F.struct(part.alias("part"), F.lit(side).alias("side"))
    giant = F.transform(each(q), lambda b: place(b * p + own, 1))
    other = F.concat(
        F.transform(each(p), lambda a: place(block * p + a, 0)),
        F.transform(each(q), lambda b: place(q * p + F.least(block, b) * q + F.greatest(block, b), -1)),
    )
    at = F.when(F.col("root") == F.col("giant"), giant).otherwise(other)
    return hot.withColumn("at", F.explode(at)).select(*columns, "at.part", "at.side"), nodes.select("node", "q")


def _links(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v) links inside the nodes and parts: pairs with candidates are told first, so that few sets are sent."""
    columns = ["grams", "fp", "sign", "node", "part", "side", "root"]
    schema = "grams long, fp long, sign binary, node long, part long, side int, root long"
    met = materialize(_by_node(rows.select(*columns), _met, schema))
    return materialize(_by_node(met.join(sets, "grams"), _linked, "u long, v long"))


def _rooted(rows: DataFrame, links: DataFrame | None) -> DataFrame:
    """The rows with the ``root`` of their set; without links each is its own."""
    if links is None:
        return rows.withColumn("root", F.col("grams"))
    roots = components(links).select(F.col("node").alias("own"), "root")
    return rows.join(roots, F.col("grams") == F.col("own"), "left").drop("own").withColumn("root", F.coalesce("root", "grams"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, grams, first, first_grams) of each document: its id (null: the largest long), the name of its set of five-word
    shingles, and the same of the first document of its group of near copies by id and then name.

    Documents are linked where the Jaccard similarity of their sets is SIMILAR or more; links are closed transitively. Documents
    are told apart by their sets, so unlike texts with one id, or without, are documents of their own, and equal sets are one.
    Candidates share a node of content keys and are found there by the Gray-order index over their five-word fingerprints. A
    node's task compares the sets themselves, and gives a link only where it joins two groups. Hot nodes are compared in random
    parts first, and then across parts, where only members of different groups meet; those with too many of these are dealt
    anew by more and longer keys. Empty texts are copies of each other; no documents give no rows.
    """

    def each(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(key, *_sketch(text)) for key, text in zip(pdf["key"], pdf["text"], strict=True)]
            yield pd.DataFrame(rows, columns=["key", "grams", "fp", "least"])

    def listed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [shingles(t) for t in pdf["text"]]
            yield pd.DataFrame({"grams": np.array([_same(x) for x in sets], np.int64), "shingles": [x.view(np.int64) for x in sets]})

    rows = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(_LAST)).alias("key"), docs[text_col].cast("binary").alias("text"))
    prints = materialize(rows.mapInPandas(each, "key long, grams long, fp long, least binary"))
    distinct = prints.groupBy("grams").agg(F.min_by(F.struct("key", "fp", "least"), "key").alias("x")).select("grams", "x.*")
    distinct = materialize(distinct)
    links, left, sets = None, distinct, None
    for level in range(len(LEVELS)):
        members = _placed(left, level)
        if sets is None:
            # Only documents that share a node can be similar; their sets are listed once.
            active = materialize(distinct.select("key", "grams").join(members.select("grams").distinct(), "grams"))
            maybe = mark_members(rows, active.select("key")).filter("maybe").select("text").mapInPandas(listed, "grams long, shingles array<long>")
            sets = materialize(maybe.join(active.select("grams"), "grams", "left_semi").dropDuplicates(["grams"]))
        found = _links(_parted(_rooted(members, links)), sets)
        links = found if links is None else links.union(found)
        hot = members.filter(F.col("n") > MEMBERS)
        if hot.isEmpty():
            break
        last = level + 1 == len(LEVELS)
        blocked, nodes = _blocked(materialize(_rooted(hot, links)), last)
        links = links.union(_links(blocked, sets))
        open_ = nodes.filter(F.col("q") > WHOLE_BLOCKS).select("node")
        if last or open_.isEmpty():
            break
        left = materialize(left.join(hot.join(open_, "node", "left_semi").select("grams").distinct(), "grams", "left_semi"))
    rooted = materialize(_rooted(distinct.select("grams", "key"), links))
    firsts = materialize(rooted.groupBy("root").agg(F.min(F.struct("key", "grams")).alias("x")))
    named = rooted.join(firsts, "root").select("grams", F.col("x.key").alias("first"), F.col("x.grams").alias("first_grams"))
    return prints.select("key", "grams").join(materialize(named), "grams").select("key", "grams", "first", "first_grams")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group of near copies the document with the smallest id, with its columns as they were.

    Rows with one id and one set of shingles are one document, of which one row stays; unlike texts that share an id, or have
    none, are told apart. A null id counts as larger than all others. Only documents that may have to go are shuffled.
    """
    with temporary(docs.sparkSession):
        found = materialize(near_copies(docs, id_col, text_col), kept=True)
    gone = found.filter("key <> first or grams <> first_grams").select("key", "grams").distinct()
    repeated = found.groupBy("key", "grams").agg(F.count("*").alias("n")).filter("n > 1").select("key", "grams")
    whole = docs.select(
        F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.coalesce(docs[id_col].cast("long"), F.lit(_LAST)).alias("key"),
        docs[text_col].cast("binary").alias("text"),
    )
    rows = mark_members(whole, gone.union(repeated).select("key"))
    name = F.pandas_udf(lambda texts: pd.Series([_same(shingles(t)) for t in texts], dtype="int64"), "long")
    touched = rows.filter("maybe").withColumn("grams", name("text")).join(gone, ["key", "grams"], "left_anti").dropDuplicates(["key", "grams"])
    return rows.filter("not maybe").select("row").union(touched.select("row")).select("row.*")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their fingerprints and components."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
