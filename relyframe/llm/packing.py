"""Operator 4: packing token sequences by Karmarkar-Karp multiway differencing.

Documents are tokenized and cut into pieces where the data is read; only the pieces' places, lengths and
checksums move on. Pieces are dealt to blocks of bounded size by hash. In a block, each piece starts as a
partial partition into m windows with one of them filled; the two partial partitions with the largest
imbalance are merged, the fullest windows of one with the emptiest of the other, until one is left. If its
fullest window exceeds the capacity, the window count m rises and the block is partitioned again.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relyframe.llm.common import materialize, table

CAPACITY = 2048
#: The last, partial window of a document is cut into equal parts of at most this many tokens.
PART = 512
#: Pieces that a block holds on average.
BLOCK_PIECES = 1_200
END_ID = 1
#: Distinct words whose ids a Python worker keeps.
CACHE_WORDS = 500_000
TOKENIZER = "word_bpe_49k.json"
#: Marks that form a token run of their own after a word of letters.
_MARKS = b"*%&#$,.!|?:;"
#: The first letter that isn't looked up directly, and the one below it whose lower case is two characters.
_BEYOND, _LONGER = "\u0250", "\u0130"
_ENDING = np.array([END_ID], "<u4").tobytes()


def default_tokenizer() -> str:
    """Path of the tokenizer file among the installed public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet of public byte-level BPE vocabularies: printable bytes stand for themselves, others follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(256 + k) for k, b in enumerate(others)}


class WordIds(dict):
    """Ids (little-endian unsigned 32-bit) of UTF-8 words without ASCII white space, kept while there is room.

    The tokenizer drops white space and never joins pieces across it, so a text's ids are its words' ids in order. Inside a
    word it never joins a run of letters with the marks that follow. A word of plain letters is looked up in the model
    directly, in lower case; all else goes through the whole tokenizer.
    """

    def __init__(self, path: str, room: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.room, self.letters = Tokenizer.from_file(path), room, _byte_letters()
        self.model = self.tokenizer.model

    def __missing__(self, word: bytes) -> bytes:
        core = word.rstrip(_MARKS)
        letters = core.decode()
        if not _is_plain(letters):
            ids = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
            found = np.array(ids, "<u4").tobytes()
        elif len(core) < len(word):
            found = self[core] + self[word[len(core) :]]
        else:
            found = np.array(self._spelled(letters.lower()), "<u4").tobytes()
        if len(self) < self.room:
            self[word] = found
        return found

    def _spelled(self, low: str) -> list[int]:
        """Ids of a word of lower-case letters."""
        spelled = low if low.isascii() else low.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(spelled)]

    def of(self, text: bytes) -> np.ndarray:
        """Ids of a UTF-8 text, the end id last."""
        return np.frombuffer(b"".join(map(self.__getitem__, text.split())) + _ENDING, "<u4")


def _is_plain(word: str) -> bool:
    """Whether a word is made of letters up to Latin Extended-B that stay letters in lower case.

    A letter that becomes a letter and a combining mark isn't plain: the tokenizer joins that mark with those that follow.
    """
    return word.isalpha() and (word.isascii() or (max(word) < _BEYOND and _LONGER not in word))


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The word cache of this worker process."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def cuts(n: int, capacity: int = CAPACITY, part: int = PART) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole windows, then equal parts of what is left."""
    whole = [(k * capacity, capacity) for k in range(n // capacity)]
    rest, at = n % capacity, n - n % capacity
    k = math.ceil(rest / part)
    edges = [at + rest * i // k for i in range(k + 1)] if k else []
    return whole + [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens[, ids]) of each piece of each document; a null text has the end id only."""

    def each(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = word_ids(tokenizer)
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["id"], pdf["text"], strict=True):
                ids = known.of(bytes(text))
                for start, length in cuts(len(ids)):
                    part = ids[start : start + length]
                    rows.append((doc, start, length, zlib.crc32(part), len(ids), *([part.astype("i8")] if with_ids else [])))
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
            yield pd.DataFrame(rows, columns=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).cast("binary").alias("text"))
    return rows.mapInPandas(each, schema)


def differencing(sizes: np.ndarray, m: int) -> list[list[int]]:
    """Partition of places into m windows of nearly equal sums by multiway differencing.

    A partial partition is an array of m window sums in falling order, with the root of each window's tree of
    members (-1: empty). Ties break by place, so the result is determined by the sizes.
    """
    n = len(sizes)
    left, right = [np.full(n, -1)], [np.full(n, -1)]
    made, heap = n, []
    for k, size in enumerate(sizes):
        sums, roots = np.zeros(m, np.int64), np.full(m, -1)
        sums[0], roots[0] = size, k
        heap.append((-int(size if m > 1 else 0), k, sums, roots))
    heapq.heapify(heap)
    for order in range(n, 2 * n - 1):
        _, _, sums, roots = heapq.heappop(heap)
        _, _, other, theirs = heapq.heappop(heap)
        theirs = theirs[::-1]
        both = np.flatnonzero((roots >= 0) & (theirs >= 0))
        joined = np.where(roots >= 0, roots, theirs)
        if len(both):
            left.append(roots[both])
            right.append(theirs[both])
            joined[both] = np.arange(made, made + len(both))
            made += len(both)
        sums = sums + other[::-1]
        rank = np.argsort(-sums, kind="stable")
        sums, roots = sums[rank], joined[rank]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), order, sums, roots))
    lefts, rights, windows = np.concatenate(left), np.concatenate(right), []
    for root in heap[0][3] if n else []:
        stack, members = [int(root)] if root >= 0 else [], []
        while stack:
            x = stack.pop()
            if x < n:
                members.append(x)
            else:
                stack += (int(lefts[x]), int(rights[x]))
        windows.append(sorted(members))
    return windows


def pack_block(sizes: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of at most the capacity; their number rises until the fullest fits."""
    total = int(sizes.sum())
    m = max(1, math.ceil(total / capacity))
    while True:
        windows = differencing(sizes, m)
        most = max((int(sizes[w].sum()) for w in windows), default=0)
        if most <= capacity:
            return [w for w in windows if w]
        room = capacity - (most - total / m)
        m = max(m + 1, math.ceil(total / room) if room > 0 else m + 1)


def pack(cut: DataFrame, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; every sequence holds at most ``capacity`` tokens without gaps.

    ``cut`` should be written, so that its rows keep their places. A piece of a whole window is a sequence of its own. Repeated documents are packed like others; equal pieces are
    interchangeable. No pieces give no rows. Other columns are kept, whatever their names; ``sequence_id`` and ``offset`` of
    the input are replaced.
    """
    n_blocks = max(1, math.ceil(cut.filter(F.col("length") < capacity).count() / block_pieces))
    names = [c for c in cut.columns if c not in ("sequence_id", "offset")]
    own = [f"c{k}" for k in range(len(names))]  # numbers, so that no column clashes with those of the work
    id_, start, length, crc = (own[names.index(c)] for c in ("id", "start", "length", "ids_crc32"))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([start, crc], kind="stable").sort_values(id_, kind="stable").reset_index(drop=True)
        sizes = pdf[length].to_numpy()
        partial = np.flatnonzero(sizes < capacity)
        windows = [partial[w] for w in pack_block(sizes[partial], capacity)] + [[k] for k in np.flatnonzero(sizes >= capacity)]
        place, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        for k, members in enumerate(windows):
            place[members] = k
            offset[members] = np.cumsum(sizes[members]) - sizes[members]
        return pdf[own].assign(sequence_id=(int(pdf["block"].iloc[0]) << 24) + place, offset=offset)

    keyed = cut.select(*(cut[c].alias(k) for c, k in zip(names, own, strict=True)))
    # With a row's place, since equal pieces (of repeated rows) would be one block.
    keyed = keyed.withColumn("block", F.pmod(F.xxhash64(id_, start, crc, F.monotonically_increasing_id()), F.lit(n_blocks)))
    schema = ", ".join(f"{k} {cut.schema[c].dataType.simpleString()}" for c, k in zip(names, own, strict=True))
    packed = keyed.groupBy("block").applyInPandas(block, f"{schema}, sequence_id long, offset long")
    return packed.toDF(*names, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Tokenized, cut and packed documents: one row a piece, with the id column under the name ``id``.

    Null and empty texts hold the end id only; a null id is kept; other columns are dropped.
    """
    return pack(materialize(pieces(docs, tokenizer or default_tokenizer(), id_col, with_ids=with_ids)))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    packed = pack_documents(table(spark, sf_dir, "documents"))
    return packed.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
