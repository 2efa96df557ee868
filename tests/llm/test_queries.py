"""Registered training-data queries: equal to DuckDB where there is SQL, to brute force or whole-table laws elsewhere."""

import math
import os
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import differences  # noqa: E402

import corpus_pipeline  # noqa: E402
from relyframe.llm import licenses, packing, queries, simhash  # noqa: E402

from .docs import SCHEMA, documents  # noqa: E402
from .test_documents import brute_components, brute_fingerprint, brute_quality, brute_repeats, jaccard  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    extra, missing, n, m = differences(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], SMALL)
    assert not extra and not missing and n == m > 0


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


def test_op5_whole_table(spark, texts):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in queries.QUERIES["op5_substring"](spark, SMALL).collect())
    assert got == Counter(brute_repeats(texts))


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def test_op10_whole_table(spark, texts):
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in queries.QUERIES["op10_simhash"](spark, SMALL).collect()}
    fps = {i: brute_fingerprint(ascii_lower(t)) for i, t in texts}
    root, least = brute_components(set(fps.values())), {}
    for i, f in fps.items():
        least[root[f]] = min(least.get(root[f], i), i)
    assert got == {i: (f, least[root[f]]) for i, f in fps.items()}


def test_op4_whole_table(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts}
    rows, pieces, places = queries.QUERIES["op4_packing"](spark, SMALL).collect(), defaultdict(list), defaultdict(list)
    for r in rows:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        places[r.sequence_id].append((r.offset, r.length))
    gapless = lambda parts: all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:], strict=False)) and min(parts)[0] == 0
    assert set(pieces) == set(want) and all(gapless(p) and sum(n for _, n in p) == len(want[i]) for i, p in pieces.items())
    assert all(gapless(p) and sum(n for _, n in p) <= 2048 for p in places.values())


def test_op7_whole_table(spark, texts):
    rows = queries.QUERIES["op7_sharding"](spark, SMALL).collect()
    raw = {i: (t or "").encode() for i, t in texts}
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == {(i, len(b) + 8, zlib.crc32(b)) for i, b in raw.items()}
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)} and len(rows) == len(raw)
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in shards.values()) and set(shards) == set(range(24))
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1


def test_op1_whole_table(spark, texts):
    """Cosines of every window of every text with every template, without the prefix filter, with frequencies counted anew."""
    lines = {i: [licenses.terms(x) for x in (t or "").split("\n")] for i, t in texts}
    n_lines = sum(bool(x) for own in lines.values() for x in own)
    vocabulary = licenses.vocabulary(licenses.TEMPLATES)
    seen = Counter(t for own in lines.values() for x in own for t in set(x) & vocabulary)
    weight = lambda t: math.log((1 + n_lines) / (1 + (seen[t] if t in vocabulary else 0)))
    vector = lambda x: {t: n * weight(t) for t, n in Counter(x).items()}
    length = lambda v: math.sqrt(sum(w * w for w in v.values()))
    known = [(name, vector(licenses.terms(s)), len(licenses.terms(s))) for name, own in licenses.TEMPLATES.items() for s in own]
    rows = {r.doc_id: r for r in queries.QUERIES["op1_license_scan"](spark, SMALL).collect()}
    for i, own in lines.items():
        stream, at = [t for x in own for t in x], [k for k, x in enumerate(own) for _ in x]
        found = []
        for name, k, n in known:
            for start in range(max(0, len(stream) - n) + 1):
                window = stream[start : start + n]
                if not k.keys().isdisjoint(window):
                    v = vector(window)
                    score = sum(w * v.get(t, 0) for t, w in k.items()) / (length(k) * length(v))
                    if score >= licenses.THRESHOLD - 1e-9:
                        found.append((-round(score, 9), start, name))
        if not found:
            assert rows[i].own_license is None and rows[i].n_lines == 0
        else:
            score, start, name = min(found)
            assert (rows[i].own_license, rows[i].line) == (name, at[start]) and abs(rows[i].score + score) < 1e-6
            assert rows[i].n_lines == len({at[s] for _, s, _ in found})
    assert sum(r.own_license is not None for r in rows.values()) > 0


@pytest.mark.parametrize("name, column", [("op1_license_scan", "doc_id"), ("op4_packing", "doc_id"), ("op7_sharding", "doc_id"), ("op6_html_text", "page_id")])
def test_queries_cover_whole_tables(spark, name, column):
    table = "pages" if column == "page_id" else "documents"
    ids = {r[0] for r in spark.read.parquet(f"{SMALL}/{table}.parquet").select(column).collect()}
    assert {r[0] for r in queries.QUERIES[name](spark, SMALL).select(column).collect()} == ids


def test_pipeline_stages(spark, texts):
    docs, seen = spark.read.parquet(f"{SMALL}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL).cache()
        seen[name] = docs
        assert name == "packing" or docs.columns == corpus_pipeline.COLUMNS
    kept = {r.doc_id: r.text for r in seen["quality_rules"].collect()}
    measured = {i: brute_quality(t) for i, t in texts}
    assert all(measured[i][0] >= 50 for i in kept) and set(kept) <= set(dict(texts))
    one = {r.doc_id for r in seen["near_dedup"].collect()}
    gone = set(kept) - one
    assert gone and all(any(jaccard(kept[i], kept[j]) > 0.5 for j in kept if j < i) for i in gone)
    cut = {r.doc_id: r.text for r in seen["substring_dedup"].collect()}
    assert set(cut) == one
    assert not any(x[2] for x in brute_repeats([(i, t) for i, t in cut.items() if t == kept[i]]))
    clean = {r.doc_id for r in seen["benchmark_decontamination"].collect()}
    assert clean <= one and {r.doc_id for r in seen["packing"].collect()} == clean
    assert corpus_pipeline.run(spark, SMALL).count() == seen["packing"].count()


def test_op1_inherits_from_upper_directories(spark):
    rows = queries.QUERIES["op1_license_scan"](spark, SMALL).collect()
    assert any(r.inherited_from and r.path.count("/") > r.inherited_from.count("/") + 1 for r in rows)


def test_pipeline_stages_stand_edge_cases(spark):
    wide = spark.createDataFrame(documents(), SCHEMA)
    for rows in (wide, wide.limit(0), wide.selectExpr("cast(null as long) doc_id", "cast(null as string) text", "cast(null as string) lang", "cast(null as string) source", "cast(null as long) n_chars").limit(5)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, SMALL)
            assert name == "packing" or out.columns == corpus_pipeline.COLUMNS
            n = out.count()
            assert n >= 0 if rows is wide else n <= 5


def test_near_dedup_recall_on_a_whole_table(spark):
    """Of all pairs of similarity 0.8 or more, all are in one group; by all pairs that share a shingle."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    own = {r.doc_id: {tuple(w[k : k + 5]) for w in [r.text.encode().lower().split()] for k in range(max(1, len(w) - 4))} for r in docs.collect()}
    holders = defaultdict(list)
    for i, grams in own.items():
        for g in grams:
            holders[g].append(i)
    shared = Counter((a, b) for ids in holders.values() if len(ids) > 1 for n, a in enumerate(sorted(ids)) for b in sorted(ids)[n + 1 :])
    close = [(a, b) for (a, b), n in shared.items() if 5 * n >= 4 * (len(own[a]) + len(own[b]) - n)]
    first = {r.key: r["first"] for r in simhash.near_copies(docs).collect()}
    found = sum(first[a] == first[b] for a, b in close)
    assert len(close) > 50 and found >= 0.99 * len(close)
    root = {i: i for i in own}
    for a, b in close:
        x, y = root[a], root[b]
        root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()} if x != y else root
    assert all(root[i] == root[first[i]] for i in own)  # nothing else is joined
