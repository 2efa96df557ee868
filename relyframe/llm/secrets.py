"""Operator 12: secrets found by one combined deterministic automaton.

The rules' regexes are compiled together: each becomes a nondeterministic automaton, subset construction makes their union
deterministic, and minimisation leaves one small transition array over byte classes. A batch's texts lie end to end in one
buffer, and a single pass over its bytes runs all rules at once. The pass is cut into lanes that step side by side, each from
the initial state; where a lane's guess of its first state was wrong, its first bytes are run again from the right one until
both runs meet, so the states are those of a plain pass.

The pass tells where a part that every match of a rule contains has been seen. Around such a place lies a run of bytes that the rule
can take, and all its matches there are inside that run; runs are few. In them the rule's own automaton, made the same way, finds
the leftmost longest matches.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relyframe.llm.common import table

#: Lanes of a pass, and bytes that a lane has at least.
LANES, LANE_BYTES = 16_384, 64
#: Bytes of texts that are passed at once, at least one text.
PIECE = 4 << 20


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``head`` and then ``least`` or more bytes of the class ``body``, of which a match takes all.

    Matches are leftmost, longest and apart; those with a shorter body are passed over, with their text. ``head`` may be any
    regex of the subset that ``compile_rules`` reads; ``fold`` lets its letters stand for either case. ``tail`` is a regex behind
    the body, for kinds that have an end. ``part`` is a regex of which each match contains one; without it, it is the head, or
    the whole rule where there is no head. It should be rare, and without counts: counts of many rules at once multiply states.
    """

    kind: str
    head: str
    body: str
    least: int
    fold: bool = False
    tail: str = ""
    part: str = ""

    @property
    def whole(self) -> str:
        return f"{self.head}{self.body}+{self.tail}"

    @property
    def kept(self) -> str:
        return f"{self.head}{self.body}{{{self.least},}}{self.tail}"

    @property
    def needed(self) -> str:
        return self.part or self.head or self.kept


#: Kinds in order; the first three are the base.
RULES: tuple[Rule, ...] = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]", 12, fold=True),
    Rule("access", "AKIA", "[A-Z0-9]", 14),
    Rule("hex", "", "[0-9a-f]", 16),
    Rule("hosted", "gh[oprsu]_", "[A-Za-z0-9]", 36),
    Rule("chat", "xox[abprs]-", "[A-Za-z0-9-]", 10),
    Rule("maps", "AIza", "[A-Za-z0-9_-]", 35),
    Rule("payment", "[rs]k_live_", "[A-Za-z0-9]", 16),
    Rule("web", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.", "[A-Za-z0-9_-]", 8, part="eyJ"),
    Rule("pem", "-----BEGIN", "[A-Z\\x20]", 1, tail="PRIVATE\\x20KEY-----"),
    Rule("login", "[a-z][a-z0-9+.-]{0,15}://[^\\x00-\\x20/:@\\x7F-\\xFF]+:", "[^\\x00-\\x20/:@\\x7F-\\xFF]", 1, tail="@", part="://"),
)
BASE_KINDS = ("assign", "access", "hex")


# Regexes to automata


class _Parser:
    """A regex over bytes to a nondeterministic automaton: literals, escapes, classes, groups, ``|``, ``?``, ``*``, ``+``, ``{m,n}``."""

    def __init__(self, pattern: str, fold: bool):
        self.p, self.at, self.fold = pattern, 0, fold

    def tree(self):
        out = self._choice()
        if self.at < len(self.p):
            raise ValueError(f"{self.p}: unexpected {self.p[self.at]} at {self.at}")
        return out

    def _peek(self) -> str:
        return self.p[self.at] if self.at < len(self.p) else ""

    def _take(self) -> str:
        self.at += 1
        return self.p[self.at - 1]

    def _choice(self):
        parts = [self._sequence()]
        while self._peek() == "|":
            self._take()
            parts.append(self._sequence())
        return ("or", parts) if len(parts) > 1 else parts[0]

    def _sequence(self):
        parts = []
        while self._peek() not in ("", "|", ")"):
            parts.append(self._repeated())
        return ("and", parts)

    def _repeated(self):
        one = self._one()
        while self._peek() and self._peek() in "?*+{":
            mark = self._take()
            if mark == "{":
                end = self.p.index("}", self.at)
                low, comma, high = self.p[self.at : end].partition(",")
                self.at = end + 1
                least, most = int(low), (int(high) if high else None) if comma else int(low)
            else:
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[mark]
            one = ("repeat", one, least, most)
        return one

    def _one(self):
        c = self._take()
        if c == "(":
            inner = self._choice()
            if self._peek() != ")":
                raise ValueError(f"{self.p}: a group isn't closed")
            self._take()
            return inner
        if c == "[":
            return ("set", self._class())
        if c in "?*+{}":
            raise ValueError(f"{self.p}: nothing to repeat at {self.at}")
        return ("set", self._folded({self._byte(c)}))

    def _byte(self, c: str) -> int:
        if c == "\\":
            c = self._take()
            if c == "x":
                self.at += 2
                return int(self.p[self.at - 2 : self.at], 16)
            return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))
        return ord(c)

    def _class(self) -> frozenset[int]:
        negated = self._peek() == "^"
        self.at += negated
        found: set[int] = set()
        while self._peek() != "]":
            low = self._byte(self._take())
            if self._peek() == "-" and self.p[self.at + 1] != "]":
                self._take()
                found |= set(range(low, self._byte(self._take()) + 1))
            else:
                found.add(low)
        self._take()
        return frozenset(range(256)) - found if negated else self._folded(found)

    def _folded(self, found: set[int]) -> frozenset[int]:
        if self.fold:
            letters = {b for b in found if chr(b).isascii() and chr(b).isalpha()}
            found = found | {ord(chr(b).swapcase()) for b in letters}
        return frozenset(found)


class _Nfa:
    """States with sets of bytes to one other state, and empty moves."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.move: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.move.append(None)
        return len(self.empty) - 1

    def add(self, tree, start: int) -> int:
        """The state behind ``tree`` when it is entered at ``start``."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            inner = self.state()
            self.empty[start].append(inner)
            self.move[inner] = (tree[1], end)
            return end
        if kind == "and":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        if kind == "or":
            end = self.state()
            for part in tree[1]:
                self.empty[self.add(part, start)].append(end)
            return end
        _, one, least, most = tree
        for _ in range(least):
            start = self.add(one, start)
        if most is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(one, loop)].append(loop)
            return loop
        end = self.state()
        for _ in range(most - least):
            self.empty[start].append(end)
            start = self.add(one, start)
        self.empty[start].append(end)
        return end

    def closure(self, states: Iterable[int]) -> frozenset[int]:
        found, waiting = set(states), list(states)
        while waiting:
            for t in self.empty[waiting.pop()]:
                if t not in found:
                    found.add(t)
                    waiting.append(t)
        return frozenset(found)


@dataclass(frozen=True)
class Automaton:
    """A minimal deterministic automaton: ``step[state * n_classes + byte_class[byte]]``; ``accepts`` has a bit a rule.

    State 0 is initial. ``dead`` is the state that nothing leaves, or -1.
    """

    step: np.ndarray
    byte_class: np.ndarray
    accepts: np.ndarray
    dead: int

    @property
    def n_classes(self) -> int:
        return int(self.byte_class.max()) + 1


def compile_rules(patterns: list[tuple[str, bool]], search: bool) -> Automaton:
    """The automaton of (pattern, fold) pairs: with ``search`` of texts that end in a match, else of the matches alone."""
    nfa, ends = _Nfa(), {}
    start = nfa.state()
    for k, (pattern, fold) in enumerate(patterns):
        first = nfa.state()
        nfa.empty[start].append(first)
        ends[nfa.add(_Parser(pattern, fold).tree(), first)] = 1 << k
    byte_class, samples = _byte_classes({m[0] for m in nfa.move if m})
    # Subset construction.
    begin = nfa.closure([start])
    numbers, waiting, rows = {begin: 0}, [begin], []
    while waiting:
        own = waiting.pop(0)
        row = []
        for b in samples:
            to = nfa.closure([m[1] for m in (nfa.move[s] for s in own) if m and b in m[0]])
            to = to | begin if search else to
            if to not in numbers:
                numbers[to] = len(numbers)
                waiting.append(to)
            row.append(numbers[to])
        rows.append(row)
    accepts = np.zeros(len(numbers), np.int64)
    for states, k in numbers.items():
        for s in states:
            accepts[k] |= ends.get(s, 0)
    return _minimal(np.array(rows), accepts, byte_class)


def _byte_classes(sets: set[frozenset[int]]) -> tuple[np.ndarray, list[int]]:
    """Class of each byte, and a byte of each class: bytes that no set tells apart are one class."""
    names: dict[tuple[bool, ...], int] = {}
    ordered = sorted(sets, key=sorted)
    of = [names.setdefault(tuple(b in s for s in ordered), len(names)) for b in range(256)]
    return np.array(of, np.uint8), [of.index(k) for k in range(len(names))]


def _minimal(step: np.ndarray, accepts: np.ndarray, byte_class: np.ndarray) -> Automaton:
    """States that accept alike and lead to like states are one; refined until nothing is split."""
    _, block = np.unique(accepts, return_inverse=True)
    while True:
        _, refined = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)
        refined = refined.ravel()
        if refined.max() == block.max():
            break
        block = refined
    # Numbered by first appearance, so that the initial state is 0.
    _, first = np.unique(block, return_index=True)
    order = np.argsort(first, kind="stable")
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    picked = first[order]
    out, own = number[block[step[picked]]], accepts[picked]
    still = np.flatnonzero((out == np.arange(len(out))[:, None]).all(axis=1) & (own == 0))
    kind = np.uint8 if len(out) <= 256 else np.uint16
    return Automaton(out.astype(kind), byte_class, own, int(still[0]) if len(still) else -1)


# The pass


def states_of(automaton: Automaton, data: np.ndarray) -> np.ndarray:
    """The state behind each byte of ``data``, from state 0 before the first."""
    n = len(data)
    classes, step = automaton.byte_class[data], automaton.step
    width = max(LANE_BYTES, -(-n // LANES))
    lanes = -(-n // width)
    padded = np.zeros(lanes * width, np.uint8)
    padded[:n] = classes
    columns = np.ascontiguousarray(padded.reshape(lanes, width).T)
    out = np.empty((width, lanes), step.dtype)
    flat, n_classes = step.ravel(), step.shape[1]
    state = np.zeros(lanes, np.intp)
    for k in range(width):
        state = flat[state * n_classes + columns[k]]
        out[k] = state
        state = state.astype(np.intp)
    states = np.ascontiguousarray(out.T).ravel()[:n]
    # Lanes whose first state was not 0, in order: their first states are mended until they meet those of the guess.
    for at in range(width, n, width):
        true = int(states[at - 1])
        if true == 0:
            continue
        while at < n:
            true = int(step[true, classes[at]])
            if states[at] == true:
                break
            states[at] = true
            at += 1
    return states


class Scanner:
    """The rules' combined automaton for the pass, and each rule's own for the exact spans."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.all = compile_rules([(r.needed, r.fold) for r in rules], search=True)
        self.own = [self._tables(r.whole, r.fold) for r in rules]
        self.kept = [self._tables(r.kept, r.fold) for r in rules]
        self.taken = [np.array([any(row[b] != dead for row in step) for b in range(256)]) for step, _, dead in self.own]

    @staticmethod
    def _tables(pattern: str, fold: bool) -> tuple[list[list[int]], list[bool], int]:
        """A rule's transitions by byte, its accepting states, and the dead state, as plain lists."""
        a = compile_rules([(pattern, fold)], search=False)
        return a.step[:, a.byte_class].tolist(), (a.accepts != 0).tolist(), a.dead

    @staticmethod
    def _longest(tables, data: bytes, at: int) -> int:
        """End of the longest match that starts at ``at``, or -1."""
        step, accepts, dead = tables
        state, end = 0, at if accepts[0] else -1
        for k in range(at, len(data)):
            state = step[state][data[k]]
            if state == dead:
                break
            if accepts[state]:
                end = k + 1
        return end

    def matches(self, k: int, data: bytes) -> Iterator[tuple[int, int]]:
        """Leftmost longest matches of rule k whose body is long enough."""
        first, dead, at = self.own[k][0][0], self.own[k][2], 0
        while at < len(data):
            end = -1 if first[data[at]] == dead else self._longest(self.own[k], data, at)
            if end <= at:
                at += 1
                continue
            if self._longest(self.kept[k], data[:end], at) == end:
                yield at, end
            at = end

    def runs(self, data: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(start, end, rule): runs of bytes that a rule can take around the places where the pass has seen its part."""
        states = states_of(self.all, data)
        hit = np.flatnonzero((self.all.accepts != 0)[states])
        bits = self.all.accepts[states[hit]]
        for k in np.flatnonzero([np.bitwise_or.reduce(bits) >> k & 1 for k in range(len(self.rules))]) if len(hit) else ():
            outside = np.concatenate([[-1], np.flatnonzero(~self.taken[k][data]), [len(data)]])
            for run in np.unique(np.searchsorted(outside, hit[bits >> k & 1 == 1])):
                yield int(outside[run - 1]) + 1, int(outside[run]), int(k)

    def spans(self, data: bytes | np.ndarray) -> list[tuple[int, int, int]]:
        """(start, end, rule) of all spans in bytes, by start and rule."""
        array, found = np.frombuffer(data, np.uint8), []
        for start, end, k in self.runs(array):
            found += [(start + a, start + b, k) for a, b in self.matches(k, array[start:end].tobytes())]
        return sorted(found, key=lambda s: (s[0], s[2], s[1]))


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text starts (and the last ends), and all bytes."""
    wide = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
    edges = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    return edges - edges[0], raw


def _n_points(raw: np.ndarray) -> int:
    return int(((raw & 0xC0) != 0x80).sum())


def pieces_of(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in slices of about PIECE bytes."""
    edges, first = _bytes_of(texts)[0] if len(texts) else np.zeros(1, np.int64), 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(edges, edges[first] + PIECE, side="right")) - 1)
        yield texts.slice(first, end - first)
        first = end


_scanners: dict[tuple[Rule, ...], Scanner] = {}


def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    """The compiled rules of this worker process."""
    if rules not in _scanners:
        _scanners[rules] = Scanner(rules)
    return _scanners[rules]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, spans) of each document; spans are (kind, start, end) by start and then in the order of the rules, in code points.

    A null or empty text has no spans. Null ids are kept, each repeated row is scanned, no documents give no rows, and other
    columns are dropped. Texts are scanned whole; a long text costs time and memory in proportion to its length.
    """
    kinds = [r.kind for r in rules]
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def found_in(texts: pa.Array) -> list[list[dict]]:
        edges, raw = _bytes_of(texts)
        own: list[list[dict]] = [[] for _ in range(len(texts))]
        found = scanner(rules).spans(raw)
        rows = np.searchsorted(edges, [s[0] for s in found], side="right") - 1
        row, at, points = -1, 0, 0  # code points of the row before ``at``
        for (start, end, k), i in zip(found, rows.tolist(), strict=True):
            if i != row:
                row, at, points = i, edges[i], 0
            points += _n_points(raw[at:start])
            at = start
            own[i].append({"kind": kinds[k], "start": points, "end": points + _n_points(raw[start:end])})
        return own

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            own: list[list[dict]] = []
            for texts in pieces_of(text):
                own += found_in(texts)
            yield pa.RecordBatch.from_arrays([ids, pa.array(own, pa.list_(span))], names=["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    # A line end, which no rule takes, keeps the texts of a batch apart.
    text = F.concat(F.coalesce(docs[text_col], F.lit("")), F.lit("\n")).cast("binary")
    rows = docs.select(docs[id_col].alias("id"), text.alias("text"))
    return rows.mapInArrow(each, f"id {kind}, spans array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[{}]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, text, n_spans): texts in which each span gives way to its kind in ``mark``; of overlapping spans the first counts.

    A null text stays null, with no spans; null ids and repeated rows are kept; other columns are dropped.
    """
    whole = docs.select(F.struct(docs[id_col].alias("id"), docs[text_col].alias("text")).alias("whole"), docs[text_col].alias("body"))
    found = scan(whole, "whole", "body", rules).select(F.col("id.id").alias("own"), F.col("id.text").alias("body"), "spans")
    apart = F.aggregate(
        "spans", F.array().cast("array<struct<kind:string,start:long,end:long>>"),
        lambda acc, s: F.when(s["start"] >= F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0)), F.concat(acc, F.array(s))).otherwise(acc),
    )
    text, (left, right) = F.col("body"), mark.split("{}")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    cut = lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))
    joined = F.aggregate(
        "apart", start,
        lambda acc, s: F.struct(F.concat(acc["out"], cut(acc["at"], s["start"]), F.lit(left), s["kind"], F.lit(right)).alias("out"), s["end"].alias("at")),
        lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.char_length(text))),
    )
    out = found.withColumn("apart", apart)
    return out.select(F.col("own").alias("id"), F.when(text.isNotNull(), joined).alias("text"), F.size("apart").cast("long").alias("n_spans"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: counts and a digest of the base kinds, and all spans."""
    found = scan(table(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    of_kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{k}") for k in BASE_KINDS]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed("spans").alias("spans"))


#: A rule in the dialect of the SQL engine, and the least length of its first group.
_SQL_RULES = [
    ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 12),
    ("access", "(AKIA[A-Z0-9]+)", 18),
    ("hex", "([0-9a-f]+)", 16),
    ("hosted", "gh[oprsu]_([A-Za-z0-9]+)", 36),
    ("chat", "xox[abprs]-([A-Za-z0-9-]+)", 10),
    ("maps", "AIza([A-Za-z0-9_-]+)", 35),
    ("payment", "[rs]k_live_([A-Za-z0-9]+)", 16),
    ("web", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.([A-Za-z0-9_-]+)", 8),
    ("pem", r"-----BEGIN([A-Z\x20]+)PRIVATE\x20KEY-----", 1),
    ("login", r"[a-z][a-z0-9+.-]{0,15}://[^\x00-\x20/:@\x7F-\x{10FFFF}]+:([^\x00-\x20/:@\x7F-\x{10FFFF}]+)@", 1),
]


def _sql() -> str:
    """Each rule's matches are put between marks (which texts lose first, one for one) and told apart by splitting."""
    each = " UNION ALL ".join(
        f"SELECT doc_id, row, {k} AS k, '{kind}' AS kind, {least} AS least, unnest(string_split(regexp_replace(t, '{rule}', chr(1) || '\\0' || chr(2) || '\\1' || chr(1), 'g'), chr(1))) AS part, "
        f"generate_subscripts(string_split(regexp_replace(t, '{rule}', chr(1) || '\\0' || chr(2) || '\\1' || chr(1), 'g'), chr(1)), 1) AS i FROM d"
        for k, (kind, rule, least) in enumerate(_SQL_RULES)
    )
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, translate(coalesce(text, ''), chr(1) || chr(2), chr(10) || chr(10)) AS t FROM documents),
p AS ({each}),
q AS (SELECT *, CASE WHEN i % 2 = 0 THEN string_split(part, chr(2))[1] ELSE part END AS whole, CASE WHEN i % 2 = 0 THEN string_split(part, chr(2))[2] END AS body FROM p),
s AS (SELECT *, CAST(sum(length(whole)) OVER (PARTITION BY row, k ORDER BY i) AS BIGINT) AS stop FROM q),
f AS (SELECT row, k, kind, stop - length(whole) AS start, kind || ':' || (stop - length(whole)) || ':' || stop AS span FROM s WHERE i % 2 = 0 AND length(body) >= least)
SELECT d.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY start, k) FILTER (WHERE k < 3), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY start, k), '') AS spans
FROM d LEFT JOIN f USING (row) GROUP BY d.row, d.doc_id
"""


OP12_SQL = _sql()
