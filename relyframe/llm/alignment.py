"""Operator 11: alignment of two tokenizers by products of sparse incidence matrices.

A tokenizer's tokens and a text's bytes make an incidence matrix A (tokens by bytes), the other's tokens a matrix B. Both are
held in compressed sparse rows built here, and multiplied row by row (Gustavson): A Bt has an entry for each pair of tokens
that overlap. Where neither token of an entry goes on in the next, both end at the same byte, and a group is complete. The
matrices of token kinds by groups, multiplied in the same way, give the pairs of ids that share a group, and how often.

Both tokenizers end a token wherever white space begins with a space or a line end, so texts are cut there and each distinct
chunk is encoded and multiplied once a worker. The links of a document are then a product, too: documents by chunks times
chunks by pairs of ids. Whether the vocabulary in use never joins across these places is verified when it is loaded.

Documents are handled in blocks of bounded size. A block hands on how many of its documents hold each pair; these rows are
summed over the corpus and go back to the blocks that asked, where a last product gives the documents' sums.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relyframe.llm.common import materialize, table, temporary

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of the texts of a block, but for one longer text.
BLOCK_CHARS = 8 << 20
#: Distinct chunks that a Python worker keeps.
ROOM = 200_000
#: Chunks that are encoded at once, and places of chunks in texts that are multiplied at once.
ENCODED, MULTIPLIED = 8_192, 200_000
#: White space of the tokenizers' patterns (Unicode's property of that name).
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CHUNK = re.compile(f"[ \\n][{_WHITE}]*[^{_WHITE}]*(?:[\\t\\x0b-\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000][{_WHITE}]*[^{_WHITE}]*)*")
_JOINED = re.compile(f"[^{_WHITE}▁][ \\n▁]|\\n[^{_WHITE}]")
#: A pair of ids as one number.
_SHIFT = 16


class Csr(NamedTuple):
    """A sparse matrix in compressed rows: row i has the columns ``col[ptr[i] : ptr[i + 1]]`` with the values ``val``."""

    ptr: np.ndarray
    col: np.ndarray
    val: np.ndarray
    n_cols: int

    @property
    def n_rows(self) -> int:
        return len(self.ptr) - 1

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_rows), np.diff(self.ptr))


def summed(row: np.ndarray, col: np.ndarray, val: np.ndarray, n_rows: int, n_cols: int) -> Csr:
    """The matrix of (row, col, val) entries in any order; equal places are added."""
    key = row * n_cols + col
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else order
    row, col = key[first] // n_cols, key[first] % n_cols
    val = np.add.reduceat(val[order], first) if len(key) else val
    return Csr(np.append(0, np.cumsum(np.bincount(row, minlength=n_rows))), col, val, n_cols)


def transposed(m: Csr) -> Csr:
    order = np.argsort(m.col, kind="stable")
    return Csr(np.append(0, np.cumsum(np.bincount(m.col, minlength=m.n_cols))), m.row[order], m.val[order], m.n_rows)


def product(a: Csr, b: Csr) -> Csr:
    """a b by Gustavson's rule: each row is the sum of the rows of b that its entries name, times their values."""
    size = np.diff(b.ptr)[a.col]
    entry = np.repeat(np.arange(len(a.col)), size)
    at = np.arange(len(entry)) - np.repeat(np.cumsum(size) - size, size) + b.ptr[a.col][entry]
    return summed(a.row[entry], b.col[at], a.val[entry] * b.val[at], a.n_rows, b.n_cols)


def token_bytes(ends: np.ndarray) -> Csr:
    """Incidence of tokens and bytes, of tokens that end at the places ``ends`` of one row of bytes."""
    n = int(ends[-1]) if len(ends) else 0
    return Csr(np.append(0, ends), np.arange(n), np.ones(n, np.int64), n)


def groups_of(overlaps: Csr) -> tuple[np.ndarray, np.ndarray]:
    """Group of each token of either side, from the matrix of overlaps: a group goes on while a token of either side does."""
    row, col = overlaps.row, overlaps.col
    fresh = np.append(True, (row[1:] != row[:-1]) & (col[1:] != col[:-1])) if len(row) else np.empty(0, bool)
    group = np.cumsum(fresh) - 1
    a, b = np.zeros(overlaps.n_rows, np.int64), np.zeros(overlaps.n_cols, np.int64)
    a[row], b[col] = group, group
    return a, b


class Tokenizers:
    """Both tokenizers: ids and token bytes of texts that start with white space."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [x for x in range(256) if x not in plain]
        byte_of = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(others)}
        # Strings that aren't byte-level (special ones) are never given for plain text.
        self.a_bytes = {i: bytes(byte_of[c] for c in token) for token, i in self.a.get_vocab().items() if all(c in byte_of for c in token)}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        joined = [p for i, p in enumerate(pieces) if not self.b.is_byte(i) and _JOINED.search(p)]
        self.space = self.b.piece_to_id("▁")
        if joined or self.b.is_unknown(self.space):
            raise ValueError(f"the vocabulary joins words: {joined[:3]}")

    def encode(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each chunk by either tokenizer. The second adds a space, which a chunk that starts with one lends it."""
        a = [e.ids for e in self.a.encode_batch(chunks, add_special_tokens=False)]
        b = self.b.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        # An added space before a line end is a token of its own; a lone space gives no text at all.
        b = [[self.space] if c == " " else ids if c[0] == " " else ids[1:] for c, ids in zip(chunks, b, strict=True)]
        return a, b


class Chunks(dict):
    """Numbers of chunks, in the order in which they were met; ``new`` has those that are not encoded yet."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = number = len(self)
        self.new.append(chunk)
        return number


class Aligner:
    """Groups and links of chunks, kept for the first ROOM distinct ones of a worker."""

    def __init__(self, a_path: str, b_path: str, room: int = ROOM):
        self.tokenizers, self.room, self.chunks = Tokenizers(a_path, b_path), room, Chunks()
        self.groups: list[str] = []
        # By chunk: tokens of either side, groups, links, whether the tokens spell it.
        self.sizes = np.empty((0, 5), np.int64)
        self.pairs = Csr(np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), 1 << 2 * _SHIFT)

    def _learn(self) -> None:
        """Encode the new chunks, some at a time."""
        chunks, self.chunks.new = self.chunks.new, []
        for at in range(0, len(chunks), ENCODED):
            self._multiply(chunks[at : at + ENCODED])

    def _multiply(self, chunks: list[str]) -> None:
        """Encode chunks and multiply their matrices, all in one row of bytes."""
        a_ids, b_ids = self.tokenizers.encode(chunks)
        a_of, b_of = self.tokenizers.a_bytes, self.tokenizers.b_bytes
        spelled = []
        for k, chunk in enumerate(chunks):
            raw = chunk.encode()
            good = b"".join([a_of[i] for i in a_ids[k]]) == raw == b"".join([b_of[i] for i in b_ids[k]])
            spelled.append(good)
            if not good:
                a_ids[k], b_ids[k] = [], []
        n_a, n_b = np.array([len(x) for x in a_ids]), np.array([len(x) for x in b_ids])
        a, b = (np.array([i for own in ids for i in own], np.int64) for ids in (a_ids, b_ids))
        a_ends, b_ends = (np.cumsum([len(of[i]) for i in ids.tolist()], dtype=np.int64) for of, ids in ((a_of, a), (b_of, b)))
        overlaps = product(token_bytes(a_ends), transposed(token_bytes(b_ends)))
        a_group, b_group = groups_of(overlaps)
        n_groups = int(a_group[-1]) + 1 if len(a_group) else 0
        # Token kinds of each group by groups: a group's tokens with the same id are one row.
        kinds_a, kinds_b = (self._kinds(ids, group, n_groups) for ids, group in ((a, a_group), (b, b_group)))
        shared = product(kinds_a[1], transposed(kinds_b[1]))
        chunk_of = np.repeat(np.arange(len(chunks)), n_a)
        group_chunk = np.zeros(n_groups, np.int64)
        group_chunk[a_group] = chunk_of
        row = shared.row
        codes = kinds_a[0][row] << _SHIFT | kinds_b[0][shared.col]
        pairs = summed(group_chunk[kinds_a[1].col[row]], codes, shared.val, len(chunks), self.pairs.n_cols)
        links = np.bincount(pairs.row, weights=pairs.val, minlength=len(chunks)).astype(np.int64)
        groups = np.bincount(group_chunk, minlength=len(chunks))
        self.sizes = np.vstack([self.sizes, np.column_stack([n_a, n_b, groups, links, spelled])])
        self.pairs = Csr(np.append(self.pairs.ptr, self.pairs.ptr[-1] + pairs.ptr[1:]), np.append(self.pairs.col, pairs.col), np.append(self.pairs.val, pairs.val), self.pairs.n_cols)
        self._write(a, a_group, b, b_group, groups)

    @staticmethod
    def _kinds(ids: np.ndarray, group: np.ndarray, n_groups: int) -> tuple[np.ndarray, Csr]:
        """Ids of the rows, and the matrix of a group's distinct ids by groups with how often each occurs."""
        keys, n = np.unique(group << _SHIFT | ids, return_counts=True)
        return keys & (1 << _SHIFT) - 1, Csr(np.arange(len(keys) + 1), keys >> _SHIFT, n, n_groups)

    def _write(self, a: np.ndarray, a_group: np.ndarray, b: np.ndarray, b_group: np.ndarray, groups: np.ndarray) -> None:
        n = int(groups.sum())
        a_at, b_at = (np.searchsorted(g, np.arange(n + 1)).tolist() for g in (a_group, b_group))
        a_text, b_text = ([str(i) for i in ids.tolist()] for ids in (a, b))
        written = [f"{','.join(a_text[a_at[g] : a_at[g + 1]])}|{','.join(b_text[b_at[g] : b_at[g + 1]])}" for g in range(n)]
        edges = np.append(0, np.cumsum(groups)).tolist()
        self.groups += [";".join(written[x:y]) for x, y in zip(edges, edges[1:], strict=False)]

    def _forget(self) -> None:
        """Drop the chunks beyond the room, which were met last."""
        while len(self.chunks) > self.room:
            self.chunks.popitem()
        del self.groups[self.room :]
        self.sizes = self.sizes[: self.room]
        ptr = self.pairs.ptr[: self.room + 1]
        self.pairs = Csr(ptr, self.pairs.col[: ptr[-1]], self.pairs.val[: ptr[-1]], self.pairs.n_cols)

    def _links(self, text: np.ndarray, chunk: np.ndarray, n_texts: int) -> Csr:
        """Texts by chunks times chunks by pairs of ids, a part of the texts at a time."""
        ends, parts, first = np.searchsorted(text, np.arange(n_texts), side="right"), [], 0
        while first < n_texts:
            at = int(ends[first - 1]) if first else 0
            to = max(first + 1, int(np.searchsorted(ends, at + MULTIPLIED, side="right")))
            own = slice(at, int(ends[to - 1]))
            by_chunk = summed(text[own] - first, chunk[own], np.ones(own.stop - at, np.int64), to - first, len(self.groups))
            parts.append(product(by_chunk, self.pairs))
            first = to
        if not parts:
            return Csr(np.zeros(1, np.int64), chunk[:0], chunk[:0], self.pairs.n_cols)
        sizes = np.concatenate([np.diff(p.ptr) for p in parts])
        return Csr(np.append(0, np.cumsum(sizes)), np.concatenate([p.col for p in parts]), np.concatenate([p.val for p in parts]), self.pairs.n_cols)

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], Csr]:
        """Of each text: tokens of either side, groups and links; the digest of its groups; links by pairs of ids."""
        known = self.chunks
        numbers = [np.array(list(map(known.__getitem__, _CHUNK.findall(" " + t))) if t else [], np.int64) for t in texts]
        self._learn()
        digests, good = [], np.ones(len(texts), bool)
        for k, own in enumerate(numbers):
            if not len(own) or not self.sizes[own, 4].all():
                numbers[k] = own[:0]
                digests.append("")
            else:
                digests.append(hashlib.sha256(";".join([self.groups[i] for i in own.tolist()]).encode()).hexdigest())
        lengths = [len(own) for own in numbers]
        chunk, text = np.concatenate([*numbers, np.empty(0, np.int64)]), np.repeat(np.arange(len(texts)), lengths)
        sizes = np.column_stack([np.bincount(text, weights=self.sizes[chunk, k], minlength=len(texts)).astype(np.int64) for k in range(4)])
        pairs = self._links(text, chunk, len(texts))
        if len(known) > self.room:
            self._forget()
        return sizes, digests, pairs


_loaded: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """The aligner of this worker process."""
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = Aligner(a_path, b_path)
    return _loaded[a_path, b_path]


def default_paths() -> tuple[str, str]:
    """The tokenizers' files among the installed public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path(A_FILE), public_tokenizers.path(B_FILE)


def _blocks(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows in slices of about BLOCK_CHARS characters, at least one row."""
    ends = np.cumsum(pdf["text"].str.len().fillna(0).to_numpy(np.int64))
    first = 0
    while first < len(pdf):
        before = ends[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(ends, before + BLOCK_CHARS, side="right")))
        yield pdf.iloc[first:end]
        first = end


def aligned_blocks(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a block of documents: their ids, sizes and digests, the pairs of ids in the block with how many of its documents
    hold each, and the matrix of documents by pairs (places among the block's pairs, and links) in bytes."""
    kind = docs.schema[id_col].dataType.simpleString()

    def each(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, k = aligner(a_path, b_path), 0
        task = TaskContext.get().partitionId() << 32
        for batch in batches:
            for pdf in _blocks(batch):
                sizes, digests, links = known.align([None if pd.isna(t) else t for t in pdf["text"]])
                pairs, place = np.unique(links.col, return_inverse=True)
                yield pd.DataFrame({
                    "block": [task + k], "ids": [list(pdf["id"])], "n_a": [sizes[:, 0]], "n_b": [sizes[:, 1]], "n_groups": [sizes[:, 2]], "n_links": [sizes[:, 3]],
                    "digests": [digests], "pairs": [pairs], "holders": [np.bincount(place.ravel(), minlength=len(pairs))],
                    "ptr": [links.ptr.astype("<i8").tobytes()], "place": [place.astype("<i4").tobytes()], "links": [links.val.astype("<i4").tobytes()],
                })
                k += 1

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    longs = ", ".join(f"{c} array<long>" for c in ("n_a", "n_b", "n_groups", "n_links"))
    return rows.mapInPandas(each, f"block long, ids array<{kind}>, {longs}, digests array<string>, pairs array<long>, holders array<long>, ptr binary, place binary, links binary")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a, b, n, best): how many documents hold each pair of ids linked, and whether no pair of the same ``a`` has more."""
    held = blocks.select(F.explode(F.arrays_zip("pairs", "holders")).alias("x")).groupBy("x.pairs").agg(F.sum("x.holders").alias("n"))
    counts = materialize(held.select(F.shiftright("pairs", _SHIFT).alias("a"), F.col("pairs").bitwiseAND((1 << _SHIFT) - 1).alias("b"), "n"))
    most = materialize(counts.groupBy("a").agg(F.max("n").alias("most")))
    return counts.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document.

    Null and empty texts, and texts that the tokens of either side don't spell, have no tokens: zeros and an empty digest. Null
    ids are kept. Repeated rows are documents of their own, in the counts of pairs, too. No documents give no rows; other
    columns are dropped.
    """
    paths = default_paths()
    kind = docs.schema[id_col].dataType.simpleString()
    blocks = materialize(aligned_blocks(docs, a_path or paths[0], b_path or paths[1], id_col, text_col))
    with temporary(docs.sparkSession):
        counts = materialize(pair_counts(blocks), kept=True)
    asked = blocks.select(F.col("block").alias("asker"), F.posexplode("pairs").alias("place", "pair"))
    known = counts.select((F.shiftleft("a", _SHIFT) + F.col("b")).alias("pair"), "n", "best")
    answers = asked.join(known, "pair").select("asker", "place", "n", "best")

    def finish(block: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        own = block.iloc[0]
        n, best = np.zeros(len(answer), np.int64), np.zeros(len(answer), np.int64)
        n[answer["place"]], best[answer["place"]] = answer["n"], answer["best"]
        links = Csr(np.frombuffer(own["ptr"], "<i8"), np.frombuffer(own["place"], "<i4").astype(np.int64), np.frombuffer(own["links"], "<i4").astype(np.int64), len(n))
        values = Csr(np.arange(0, 2 * len(n) + 1, 2), np.tile([0, 1], len(n)), np.column_stack([n, best]).ravel(), 2)
        sums = product(links, values)
        dense = np.zeros((links.n_rows, 2), np.int64)
        dense[sums.row, sums.col] = sums.val
        return pd.DataFrame({"id": own["ids"], "n_a": own["n_a"], "n_b": own["n_b"], "n_groups": own["n_groups"], "n_links": own["n_links"], "n_best": dense[:, 1], "count_sum": dense[:, 0], "groups_sha256": own["digests"]})

    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return blocks.drop("pairs", "holders").groupBy("block").cogroup(answers.groupBy("asker")).applyInPandas(finish, schema)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tokenizers' groups and links of all documents."""
    return align(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
