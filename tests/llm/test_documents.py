"""Operators over documents against brute force, on small hard fixtures."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from relyframe.llm import components, decontaminate, licenses, packing, quality, sharding, simhash, substring

from .docs import SCHEMA, documents

LAST = (1 << 63) - 1


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return (text or "").encode().split()


def sort_key(x):
    return LAST if x is None else x


# Quality rules


def brute_quality(text):
    w = [x.decode() for x in words_of(text)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = {g for g, n in Counter(grams).items() if n > 1}
    covered = {i + k for i, g in enumerate(grams) if g in often for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(docs):
    led = quality.apply_policy(quality.ledger(docs))
    assert led.columns.count("n_words") == 1 and "row" in led.columns
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in led.collect())
    assert got == Counter((d[0], *brute_quality(d[1])) for d in documents())


def test_quality_policy_and_keep(spark, docs):
    lines = "same line here\n" * 40
    rows = docs.select("doc_id", "text").union(spark.createDataFrame([(900, lines), (901, "A% " * 60)], "doc_id long, text string"))
    led = quality.apply_policy(quality.ledger(rows)).collect()
    kept = {r.doc_id for r in led if r.kept}
    assert {900, 901}.isdisjoint(kept) and all(r.n_words >= 50 for r in led if r.kept)
    assert Counter(r.doc_id for r in quality.keep(rows).collect()) == Counter(r.doc_id for r in led if r.kept)
    each = {r.rule: r for r in quality.ablations(quality.apply_policy(quality.ledger(rows))).collect()}
    assert each["too_few_words"].n_failed == sum(r.n_words < 50 for r in led)
    assert all(each[x].n_kept_without >= len([r for r in led if r.kept]) for x in each)


def test_quality_empty(empty):
    assert quality.ledger(empty).count() == 0 and quality.keep(empty).count() == 0
    assert all(r.n_failed == 0 for r in quality.ablations(quality.ledger(empty)).collect())


# Sharding


@pytest.mark.parametrize("n_shards", [1, 7, 24, 200])
def test_sharding_law(docs, n_shards):
    rows = sharding.stratified_interleave(docs, "doc_id", "source", n_shards).collect()
    assert len(rows) == len(documents())
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    sizes = [len(by[s]) for s in range(n_shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in by.values())


def test_sharding_matches_the_mixture(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 5}", "x") for i in range(3000)]
    got = sharding.stratified_interleave(spark.createDataFrame(rows, "doc_id long, source string, slot string"), "doc_id", "source").collect()
    total = Counter(r[1] for r in rows)
    own = Counter((r.shard, r.source) for r in got)
    assert all(abs(own[s, x] - n / 24) <= 2 for x, n in total.items() for s in range(24))


def test_sharding_is_stable_and_empty(docs, empty):
    place = lambda df: sorted((sort_key(r.doc_id), r.text or "", r.shard) for r in sharding.stratified_interleave(df, "doc_id", "source").collect())
    assert place(docs) == place(docs.repartition(1))
    assert sharding.stratified_interleave(empty, "doc_id", "source").count() == 0


# SimHash


def brute_fingerprint(text):
    w = words_of(text.lower() if text and text.isascii() else text) if text else []
    w = [x.lower() for x in w]
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    fs = sorted(fps)
    for i, a in enumerate(fs):
        for b in fs[i + 1 :]:
            if bin(a ^ b).count("1") <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fs}


def test_simhash_against_brute_force(docs):
    got = simhash.near_duplicates(docs).collect()
    fps = [(d[0], brute_fingerprint(d[1])) for d in documents()]
    assert Counter((r.id, r.fp & (2**64 - 1)) for r in got) == Counter(fps)
    root = brute_components({f for _, f in fps})
    least = {}
    for i, f in fps:
        least[root[f]] = min(least.get(root[f], LAST), sort_key(i))
    assert all(sort_key(r.component_id) == least[root[r.fp & (2**64 - 1)]] for r in got)


@pytest.mark.parametrize("limit", [2, 8, 4096])
def test_near_links_in_dense_families(spark, limit):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 12, dtype=np.int64).astype(np.uint64)
    family = [int(b) ^ sum(1 << int(k) for k in rng.integers(0, 64, rng.integers(0, 5))) for b in base for _ in range(40)]
    fps = sorted(set(family))
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in fps]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long"), node_limit=limit)
    got = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in components.components(links).collect()}
    want = brute_components(set(fps))
    groups = lambda m: {frozenset(f for f in fps if m.get(f, f) == x) for x in {m.get(f, f) for f in fps}}
    assert groups(got) == groups(want)


def jaccard(a, b, k=5):
    grams = lambda t: {tuple(w[i : i + k]) for w in [words_of(t)] for i in range(max(1, len(w) - k + 1))}
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def test_keep_one_catches_near_copies_and_leaves_others(spark, docs, empty):
    import random

    r = random.Random(2)
    vocab = [f"w{i}" for i in range(3000)]
    rows, family = [], {}
    for f in range(30):
        base = [r.choice(vocab) for _ in range(300)]
        for c in range(6):
            copy = list(base)
            for _ in range(c):
                copy[r.randrange(300)] = "edit"
            family[len(rows)] = f
            rows.append((len(rows), " ".join(copy), "t"))
    half = [(900 + i, " ".join(rows[6 * i][1].split()[:150] + [r.choice(vocab) for _ in range(150)]), "t") for i in range(20)]
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows + half, "doc_id long, text string, fp3 string")).collect()}
    assert {family[i] for i in kept if i < 900} == set(range(30)) and {i for i in kept if i >= 900} == {x[0] for x in half}
    wrong = [i for i in kept if i < 900 and any(jaccard(rows[i][1], rows[j][1]) >= 0.8 for j in kept if j < i)]
    assert len(wrong) <= 2  # masks and bits find almost all
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns and out.count() == len({(x["first"], x.first_grams) for x in simhash.near_copies(docs).collect()})
    assert simhash.keep_one(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("radius, n", [(2, 700), (20, 700), (20, 3), (20, 33), (64, 200), (20, 2500)])
def test_gray_order_index_matches_all_pairs(radius, n):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 1 + n // 60).astype(np.uint64)
    flip = lambda x, k: x ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False)))
    fps = np.array([flip(base[i % len(base)], rng.integers(0, 9)) for i in range(n)])
    fps = fps[simhash._ranked(fps)]
    found = [set(zip(i.tolist(), j.tolist(), strict=True)) for i, j in simhash._pairs_of_groups(fps, radius)]
    a, b = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps) <= radius, 1))
    assert set().union(*found) == set(zip(a.tolist(), b.tolist(), strict=True)) and sum(map(len, found)) == len(a)


def test_least_hashes_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(5)
    agreed = []
    for _ in range(200):
        both, a, b = (rng.integers(0, 2**63, k).astype(np.uint64) * np.uint64(2) for k in (160, 20, 20))
        agreed.append((simhash.least_hashes(np.append(both, a)) == simhash.least_hashes(np.append(both, b))).mean())
    assert abs(np.mean(agreed) - 0.8) < 0.02


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (3, 2), (None, 1)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 140)) and len(got) == 81


# Substring dedup


def brute_repeats(rows):
    first, out = {}, []
    for i, t in sorted(((sort_key(d[0]), d[1]) for d in rows), key=lambda x: x[0]):
        w = words_of(t)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for d in rows:
        w, i = words_of(d[1]), sort_key(d[0])
        gone = {q for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for q in range(k, k + 50)}
        kept = b" ".join(x for q, x in enumerate(w) if q not in gone)
        out.append((d[0], len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_substring_against_brute_force(docs):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.repeated_spans(docs).collect())
    assert got == Counter(brute_repeats(documents()))
    assert sum(x[2] for x in got) > 500


def test_substring_overlapping_passages(spark):
    w = [f"w{i}" for i in range(200)]
    texts = [w[0:90], w[40:140], w[100:200], ["x"] + w[30:160] + ["y"], w[0:49], (["a", "b"] * 60), (["b", "a"] * 60), w[10:60] + w[10:60]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter(brute_repeats(rows))


def test_cut_keeps_other_columns_exactly(spark):
    passage = " ".join(f"w{k}" for k in range(60))
    rows = [(1, passage, (1 << 62) + 1), (2, f"own {passage} end", None), (3, f"more {passage}", (1 << 53) + 1), (4, None, 7), (5, "", None), (None, None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, big long")
    got = sorted(((r.doc_id, r.text, r.big) for r in substring.remove_repeats(table).collect()), key=str)
    want = [rows[0], (2, "own end", None), (3, "more ", (1 << 53) + 1), *rows[3:]]
    assert got == sorted(want, key=str)


def test_substring_keeps_other_texts(docs, empty):
    cut = substring.remove_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(documents())
    spans = {(r.doc_id, r.n_words) for r in substring.repeated_spans(docs).filter("n_removed = 0").collect()}
    before = Counter((d[0], d[1]) for d in documents() if (d[0], len(words_of(d[1]))) in spans)
    assert not before - Counter((r.doc_id, r.text) for r in cut.collect())
    assert substring.remove_repeats(empty).count() == 0 and substring.repeated_spans(empty).count() == 0


def test_automaton_spans():
    a = substring.Automaton()
    a.add(b"a b c d e f".split(), 1)
    a.add(b"c d x y".split(), 2)
    assert a.spans(b"q b c d e z c d x".split(), 3) == [(1, 5), (6, 9)]
    assert a.spans(b"f c d".split(), 3) == []
    assert a.spans(b"q b c d e z c d x".split(), 3, own=1) == [(6, 9)] and a.spans(b"a b c d x".split(), 3, own=2) == [(0, 4)]


@pytest.mark.parametrize("piece, shard, copy", [(4096, 40_000, 1_000_000), (16, 60, 30), (7, 1, 1)])
def test_substring_shards_of_any_size(spark, monkeypatch, piece, shard, copy):
    monkeypatch.setattr(substring, "PIECE", piece)
    monkeypatch.setattr(substring, "SHARD_WORDS", shard)
    monkeypatch.setattr(substring, "COPY_WORDS", copy)
    rows = [(d[0], d[1]) for d in documents(6, 30)] + [(7, "x " * 130), (9, "y " + "x " * 90), (9, documents(6, 30)[20][1]), (9, "z " + (documents(6, 30)[20][1] or ""))]
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter(brute_repeats(rows))


# Decontamination


def brute_hits(docs, items):
    import re

    find = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = find(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if w else []:
            windows[tuple(w[k : k + n])].add("" if i is None else str(i))
    sizes = {len(x) for x in windows}
    out = []
    for d in docs:
        w, hit, named = find(d[1]), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    named |= windows[tuple(w[k : k + n])]
        out.append((d[0], len(w), len(hit), tuple(sorted(named))))
    return out


def test_decontamination_against_brute_force(spark, docs):
    texts = [d[1] for d in documents() if d[1] and len(d[1].split()) > 30]
    items = [(1, " ".join(texts[3].split()[2:25])), (2, " ".join(texts[5].split()[:10]).upper()), (3, "two words"), (4, "ONE"), (5, ""), (6, None), (None, " ".join(texts[8].split()[4:30])), (1, "never said in any of these documents at all, I hope so"), (12, " ".join(texts[3].split()[8:19]))]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.hits(docs, table).collect()
    want = brute_hits(documents(), items)
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == Counter(want)
    clean = decontaminate.clean(docs, table)
    assert clean.columns == docs.columns and clean.count() == sum(x[2] == 0 for x in want)


def test_decontamination_empty(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 and r["items"] == [] for r in decontaminate.hits(docs, none).collect())
    assert decontaminate.hits(empty, none).count() == 0 and decontaminate.clean(docs, none).count() == len(documents())


# Packing


def test_packing_round_trip(docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    docs = docs.filter("coalesce(text, '') not like 'another text%'").distinct()
    rows = packing.pack_documents(docs, with_ids=True).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    joined = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == len(joined[r.id]) and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and r.length == len(r.ids)
        joined[r.id] += r.ids
    assert {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts.items()} == joined
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= packing.CAPACITY
    assert packing.pack_documents(empty).count() == 0


def test_differencing_is_near_equal_and_window_count_rises():
    sizes = np.random.default_rng(0).integers(1, 513, 900)
    windows = packing.pack_block(sizes, 2048)
    sums = [sizes[w].sum() for w in windows]
    assert sorted(x for w in windows for x in w) == list(range(900)) and max(sums) <= 2048
    assert len(windows) * 2048 <= 1.03 * sizes.sum() + 2048 and max(sums) - min(sums) < 64
    assert len(packing.pack_block(np.array([1500, 1500, 1500]), 2048)) == 3


def test_words_spell_the_whole_tokenizer():
    known = packing.word_ids(packing.default_tokenizer())
    tricky = ["<|endoftext|> it's I'LL don't 12,000 İstanbul ΑΣ Σ, ﬁx", "été café  x y ½x x² _a_ foo_bar, 'S ...!! A'B. <|startoftext|>x", "aͅ ǅungla ÅÅ Å Ω K, ª º", "", " \n\t"]
    for t in tricky:
        assert known.of(t.encode()).tolist() == [*known.tokenizer.encode(t, add_special_tokens=False).ids, 1]


def test_random_texts_spell_the_whole_tokenizer():
    import random

    r = random.Random(4)
    known = packing.word_ids(packing.default_tokenizer())
    odd = list("\x00\x01\x1b\x1c\x1d\x1e\x1f\x7f\x85\xa0\u1680\u2003\u2028\u3000\t\n\x0b\x0c\r") + list("İıßẞŉǰΣςſﬁKÅªº½²٣あ中\U0001f600\u0307\u0301\u0345\u200d_-'’\"()<>|") + list(packing._MARKS.decode())
    plain = list("abcdefghijklmnopqrstuvwxyzABCXYZéèüñßÄÖŒœøÆĲĳǅ0123456789")
    parts = ["the", "don't", "it's", "I'LL", "'s", "BELEDİYESİ,", "İ.", "<|endoftext|>", "e\u0301.", "naïve!!", "a\x1cb", "x"]
    texts = []
    for _ in range(50_000):
        kind = r.random()
        draw = lambda: r.choice(odd) if r.random() < 0.35 else r.choice(parts) if r.random() < 0.2 else r.choice(plain)
        texts.append("".join(" " if r.random() < 0.12 else draw() for _ in range(r.randint(1, 12 if kind < 0.9 else 40))))
    whole = known.tokenizer.encode_batch(texts, add_special_tokens=False)
    wrong = [(t, known.of(t.encode()).tolist(), e.ids) for t, e in zip(texts, whole, strict=True) if known.of(t.encode()).tolist() != [*e.ids, 1]]
    assert not wrong, (len(wrong), wrong[:3])


def test_packing_keeps_clashing_columns(spark):
    rows = [(i, 0, 100 + i, 7 * i, f"b{i}", i, "s", -1, -2) for i in range(50)]
    cut = spark.createDataFrame(rows, "id long, start long, length long, ids_crc32 long, block string, c0 long, `odd name` string, offset long, sequence_id long")
    out = packing.pack(cut)
    assert out.columns == ["id", "start", "length", "ids_crc32", "block", "c0", "odd name", "sequence_id", "offset"]
    assert {(r.id, r.block, r.c0, r["odd name"]) for r in out.collect()} == {(i, f"b{i}", i, "s") for i in range(50)}
    assert all(r.offset >= 0 and r.sequence_id >= 0 for r in out.collect())


# Licences


def test_licences_and_inheritance(spark):
    apache = "Licensed under the Apache License, Version 2.0."
    files = [("a/LICENSE", f"intro\n{apache}", True), ("a/b/c/x.py", "print(1)", False), ("a/b/LICENSE", "Released under the MIT License.", True), ("a/y.py", "y" * 50, False), ("z/q.py", None, False), ("z/own.py", "text\nThis work is licensed under the GNU General Public License, version 3.\n", False), (None, apache, False), ("a/b/c/x.py", "print(1)", False)]
    table = spark.createDataFrame([(i, *f) for i, f in enumerate(files)], "id long, path string, text string, is_licence_file boolean")
    scanned = licenses.scan(table).join(table.select("id", "is_licence_file"), "id")
    got = {r.id: (r.licence, r.effective, r.from_dir) for r in licenses.inherit(scanned).collect()}
    assert got[0] == ("Apache-2.0", "Apache-2.0", None) and got[2][0] == "MIT" and got[5][1] == "GPL-3.0"
    assert got[1] == got[7] == (None, "MIT", "a/b") and got[3] == (None, "Apache-2.0", "a") and got[4] == (None, None, None)
    assert got[6] == ("Apache-2.0", "Apache-2.0", None)
    assert licenses.scan(table.limit(0)).count() == 0


def test_inherit_keeps_clashing_columns(spark):
    rows = [(1, "a/LICENSE", "MIT", True, "own dir", "own row", "old", 5), (2, "a/b/x.py", None, False, "own dir", "own row", "old", 6)]
    files = spark.createDataFrame(rows, "id long, path string, licence string, is_licence_file boolean, dir string, row string, from_dir string, ancestor long")
    got = {r.id: r for r in licenses.inherit(files).collect()}
    assert got[2].effective == "MIT" and got[2].from_dir == "a" and got[2].dir == "own dir" and got[2].row == "own row" and got[2].ancestor == 6


def test_prefix_filter_loses_nothing():
    corpus = ["the terms of this work", "Licensed under CC BY-NC 4.0", "licensed under CC BY 4.0 the same", "released under MIT", "Released under the MIT License", "under the License version of the terms", "so released under the very MIT License and licensed under CC BY 4.0"]
    make = lambda: licenses.Scorer(licenses.TEMPLATES, {"the": 50, "of": 60, "under": 3}, 100)
    for line in corpus:
        t, open_ = licenses.terms(line), make()
        open_.triggers = set(t)
        open_.templates = [(name, template, set(t), n) for name, template, _, n in open_.templates]
        assert make().best([t]) == open_.best([t])


@pytest.mark.parametrize("times", [1, 300])
def test_statements_inside_lines_at_any_size(spark, times):
    """With the frequencies of a whole table, and of one so many times as large."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text")
    counts, n = licenses.line_frequency(rows, licenses.vocabulary(licenses.TEMPLATES))
    scorer = licenses.Scorer(licenses.TEMPLATES, {t: times * c for t, c in counts.items()}, times * n)
    best = lambda text: scorer.best([licenses.terms(x) for x in text.split("\n")])
    assert best("This file is licensed under the Apache License, Version 2.0.")[:2] == ("Apache-2.0", pytest.approx(1.0))
    assert best("Copyright 2020 Foo. Licensed under the Apache License, Version 2.0.")[0] == "Apache-2.0"
    assert best("\nAll text here was released under the MIT License.\n")[0::2] == ("MIT", 1)
    assert best("# Licensed under the Apache License,\n# Version 2.0 (the Licence)")[0] == "Apache-2.0"
    gpl, mit = licenses.TEMPLATES["GPL-3.0"][2], licenses.TEMPLATES["MIT"][3]
    wrapped = "\n".join(f" * {gpl[k : k + 60]}" for k in range(0, len(gpl), 60))
    assert best(f"/*\n{wrapped}\n */\ncode")[0] == "GPL-3.0"
    words = mit.split(" ")
    assert best("Copyright (c) 2019 Some One\n\n" + "\n".join(" ".join(words[k : k + 11]) for k in range(0, len(words), 11)))[0] == "MIT"
    assert best("the license of this version is public and the work is free")[0] is None and best("")[0] is None


def test_clashing_columns_survive(spark, docs):
    names = ["key", "maybe", "cell", "bits", "removed", "tk", "text_key", "first", "words", "shard", "hashed", "n_hit"]
    wide = docs.select("doc_id", "text", "source", *(F.lit(f"own {n}").alias(n) for n in names))
    items = spark.createDataFrame([(1, documents()[20][1])], "item_id long, text string")
    for out in (simhash.keep_one(wide), decontaminate.clean(wide, items), substring.remove_repeats(wide), quality.keep(wide)):
        assert out.columns == wide.columns and out.count() > 0
        assert all(out.filter(F.col(n) != f"own {n}").count() == 0 for n in ("key", "maybe", "removed", "first"))
    assert sharding.stratified_interleave(wide, "doc_id", "source").filter("key = 'own key'").count() == len(documents())


def test_text_columns_are_whole(docs):
    assert docs.agg(F.max(F.length("text"))).first()[0] > 5000


def test_near_copies_are_links_of_exact_similarity(spark, monkeypatch):
    import random

    monkeypatch.setattr(simhash, "MEMBERS", 24)  # nodes are split, too
    r = random.Random(11)
    vocab = [f"w{i}" for i in range(5000)]
    texts = []
    for share in (0.115, 0.105, 0.1, 0.16, 0.2):  # a block of the text replaced: similarity 0.79, 0.81, 0.82, 0.72, 0.67
        for _ in range(24):
            base = [r.choice(vocab) for _ in range(400)]
            n = round(400 * share)
            at = r.randrange(400 - n)
            texts += [" ".join(base), " ".join(base[:at] + [r.choice(vocab) for _ in range(n)] + base[at + n :])]
    base = [r.choice(vocab) for _ in range(120)]
    for _ in range(60):  # a family that a chain of links may join
        copy = list(base)
        for _ in range(r.randrange(6)):
            copy[r.randrange(120)] = r.choice(vocab)
        texts.append(" ".join(copy))
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(max(0, i - 60), i):
            if (i < 240 and i == j + 1 or j >= 240) and jaccard(texts[i], texts[j]) >= 0.8 and want[i] != want[j]:
                a, b = sorted((want[i], want[j]))
                want = [a if x == b else x for x in want]
    got = {x.key: x["first"] for x in simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    joined = sum(got[i] == want[i] != i for i in got)
    assert not [i for i in got if want[i] == i and got[i] != i]  # nothing below the similarity is linked
    assert joined >= 0.99 * sum(want[i] != i for i in got)


def family_of(n, edits, seed=21):
    """n texts of which all are a base with some words replaced."""
    import random

    r = random.Random(seed)
    vocab = [f"v{i}" for i in range(4000)]
    base = [r.choice(vocab) for _ in range(200)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(r.randrange(edits + 1)):
            copy[r.randrange(200)] = r.choice(vocab)
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("limit", [32, 2048])
def test_a_family_of_a_third_of_all_rows(spark, monkeypatch, limit):
    import random

    monkeypatch.setattr(simhash, "MEMBERS", limit)
    r = random.Random(22)
    vocab = [f"w{i}" for i in range(4000)]
    passage = " ".join(r.choice(vocab) for _ in range(60))
    others = [" ".join(r.choice(vocab) for _ in range(100)) + " " + (passage if i % 2 else "") for i in range(800)]
    texts = family_of(400, 6) + others
    want = list(range(400))
    grams = [set(zip(*(t.split()[k:] for k in range(5)))) for t in texts[:400]]
    for i in range(400):
        for j in range(i):
            if want[i] != want[j] and 5 * len(grams[i] & grams[j]) >= 4 * len(grams[i] | grams[j]):
                low, high = sorted((want[i], want[j]))
                want = [low if x == high else x for x in want]
    got = {x.key: x["first"] for x in simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(got[i] == i for i in range(400, 1200)) and [got[i] for i in range(400)] == want


def test_unlike_texts_with_one_id_or_none_stay(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(None, text(1)), (None, text(2)), (None, text(3)), (7, text(4)), (7, text(5)), (7, text(6)), (7, text(6)), (8, text(5)), (9, text(1)), (None, text(1)), (None, None), (10, "")]
    kept = sorted(((x.doc_id, x.text) for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=str)
    assert kept == sorted([(None, text(2)), (None, text(3)), (7, text(4)), (7, text(5)), (7, text(6)), (9, text(1)), (10, "")], key=str)


def test_pairs_in_many_texts_that_share_a_passage(spark, monkeypatch):
    """A hot node of far more than WHOLE_BLOCKS blocks: its pairs are found through the keys of later levels."""
    import random

    monkeypatch.setattr(simhash, "MEMBERS", 24)
    r = random.Random(6)
    words = lambda n: [f"v{r.randrange(100_000)}" for _ in range(n)]
    passage, texts, planted = words(150), [], []
    for k in range(1000):
        own = [*passage, *words(50)]
        texts.append(own)
        if k % 5 == 0:
            planted.append((k, 1000 + len(planted)))
    for k, at in planted:
        copy = list(texts[k])
        copy[152 : 167 + k % 3] = words(15 + k % 3)
        texts.append(copy)
    joined = [" ".join(t) for t in texts]
    close = [(a, b) for a, b in planted if jaccard(joined[a], joined[b]) >= 0.8]
    got = {x.key: x["first"] for x in simhash.near_copies(spark.createDataFrame(list(enumerate(joined)), "doc_id long, text string")).collect()}
    assert len(close) > 100 and sum(got[a] == got[b] for a, b in close) >= 0.99 * len(close)
    assert len({got[k] for k in range(1000)}) == 1000


def test_equal_rows_are_packed_in_many_blocks(spark):
    text = " ".join(f"word{k}" for k in range(40))
    rows = spark.range(6000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    packed = packing.pack_documents(rows).select("sequence_id", "offset", "length").toPandas()
    assert len(packed) == 6000 and packed.groupby(packed["sequence_id"] // (1 << 24)).size().max() <= 1.3 * packing.BLOCK_PIECES
    used = packed.groupby("sequence_id")["length"].sum()
    assert used.max() <= packing.CAPACITY and len(used) * packing.CAPACITY <= 1.06 * used.sum()


def test_two_threads_keep_their_files_apart(spark, docs):
    from concurrent.futures import ThreadPoolExecutor

    want = [sorted(map(str, run(docs).collect())) for run in (simhash.keep_one, substring.remove_repeats)]
    with ThreadPoolExecutor(2) as pool:
        got = list(pool.map(lambda run: sorted(map(str, run(docs).collect())), (simhash.keep_one, substring.remove_repeats)))
    assert got == want and not [t for t in spark.catalog.listTables() if t.name.startswith("relyframe")]
