"""Operators that hold documents against each other, against brute force on awkward rows."""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from doclattice.llm import bm25_search, common, encode, near_dedup, packing, queries, repeat_dedup, token_stream
from hypothesis import given, settings
from hypothesis import strategies as st

from .cases import components, crc, documents, frame, prose, words8

TOKENIZER = queries.vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


# -- encoding


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet="ab \n\t'sdé½²!_-<|endoftext|>  ", max_size=60)), max_size=5))
def test_encoder_is_exact(texts):
    own = encode.encoder(TOKENIZER)
    for t, b in zip(texts, own.encode(texts)):
        assert np.frombuffer(b, own.dtype).tolist() == own.tokenizer.encode(t, add_special_tokens=False).ids


def test_encoders_keep_as_many_pieces_as_told(monkeypatch):
    monkeypatch.setattr(encode, "KEPT_PIECES", 20)
    few, many = encode.Encoder(TOKENIZER), encode.Encoder(TOKENIZER, 5_000)
    for k in range(6):
        assert few.encode([prose(k, 40)]) == many.encode([prose(k, 40)])
    assert len(few.pieces) <= 20 < len(many.pieces) <= 5_000


def test_pieces_go_to_the_model_alone(monkeypatch):
    own = encode.Encoder(TOKENIZER)
    whole = own.tokenizer
    monkeypatch.setattr(own, "tokenizer", SimpleNamespace(model=whole.model))  # no splitting by the library
    every = "".join(map(chr, range(0x250)))
    texts = [every, " ".join(every), *(f"x{c}{c} {c}y {c}" for c in every), "§" * 9, " \t\n  a\x00\x7f\xad\xa0 ½ “q” €5", prose(5, 300)]
    for t, b in zip(texts, own.encode(texts)):
        assert np.frombuffer(b, own.dtype).tolist() == whole.encode(t, add_special_tokens=False).ids


def test_encoder_beyond_its_memory(monkeypatch):
    monkeypatch.setattr(encode, "KEPT_PIECES", 20)
    own = encode.Encoder(TOKENIZER)
    for k in range(6):
        texts = [prose(k, 40), prose(k + 1, 40), None]
        for t, b in zip(texts, own.encode(texts)):
            assert np.frombuffer(b, own.dtype).tolist() == own.tokenizer.encode(t or "", add_special_tokens=False).ids
    assert len(own.pieces) <= 20 + 200


# -- token files


def test_token_files(spark, tokenizer):
    docs = documents()
    shards = token_stream.write(frame(spark, docs).repartition(3), TOKENIZER, common.scratch(spark, "tokens"), shards=3)
    got = [tuple(r) for r in token_stream.read(spark, shards).collect()]
    at, want = 0, []
    for i, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)):
        want.append((i, len(ids_of(tokenizer, t)), crc(ids_of(tokenizer, t))))
    assert sorted(map(str, [(g[0], g[2], g[3]) for g in got])) == sorted(map(str, want))
    for g in sorted(got, key=lambda g: g[1]):
        assert g[1] == at
        at += g[2]
    order = [g[0] for g in sorted(got, key=lambda g: g[1])]
    assert order == [w[0] for w in want]
    empty = token_stream.write(frame(spark, []), TOKENIZER, common.scratch(spark, "tokens"))
    assert empty == [] and token_stream.read(spark, empty).collect() == []


def test_shard_round_trip(tmp_path):
    rng = np.random.default_rng(1)
    sizes = [1, 5, 0, 64, 200, 3, 129]
    docs = [rng.integers(0, 50257, n).astype("<u2") for n in sizes]
    writer = token_stream.ShardWriter(f"{tmp_path}/s", np.dtype("<u2"), length=16, rows_per_batch=4)
    for k, d in enumerate(docs):
        writer.add(None if k == 2 else k, d.tobytes())
    writer.close()
    reader = token_stream.ShardReader(f"{tmp_path}/s")
    whole = np.concatenate(docs)
    for (i, start, ids), k, d in zip(reader.documents(), range(len(docs)), docs):
        assert i == (None if k == 2 else k) and ids.tolist() == d.tolist() and start == sum(sizes[:k])
    for i in range(-(-len(whole) // 16)):
        ids, mask = reader.sequence(i)
        assert ids[np.array(mask)].tolist() == whole[16 * i : 16 * i + 16].tolist()
    ids, _ = reader.sequence(0)
    assert not ids.flags.owndata and pa.types.is_fixed_size_list(reader.file.schema.field("tokens").type)


# -- packing


def check_packing(rows, ids, capacity):
    places, seen = defaultdict(list), defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
        seen[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, x in ids.items():
        want, n = [], len(x)
        head = n % capacity or capacity
        cuts = [0, *range(head, n + 1, capacity)] if n > capacity else [0, n]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((k, a, b - a, crc(x[a:b])))
        assert sorted(seen[doc]) == want
    return len(places)


def test_packing(spark, tokenizer):
    docs = [d for d in documents() if d[0] is not None and d[0] != 100]
    rows = packing.pack(frame(spark, docs), TOKENIZER, capacity=64).collect()
    ids = {i: ids_of(tokenizer, t) for i, t in docs}
    n = check_packing(rows, ids, 64)
    assert n <= 1.03 * sum(map(len, ids.values())) / 64 + 1
    twice = packing.pack(frame(spark, [(1, "a b"), (1, "a b"), (None, None)]), TOKENIZER).collect()
    assert len(twice) == 3 and len({r.sequence_id for r in twice}) == 1
    assert packing.pack(frame(spark, []), TOKENIZER).collect() == []


def test_packing_in_levels(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "CARRY", 3)
    monkeypatch.setattr(packing, "FAN_IN", 2)
    docs = [(k, prose(k, 5 + k % 17)) for k in range(200)]
    rows = packing.pack(frame(spark, docs).repartition(6), TOKENIZER, capacity=100).collect()
    check_packing(rows, {i: ids_of(tokenizer, t) for i, t in docs}, 100)


def test_packing_fills_bins_across_splits(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "CARRY", 3)
    monkeypatch.setattr(packing, "FAN_IN", 2)
    long, short = " the" * 59, " the" * 39
    assert (len(ids_of(tokenizer, long)), len(ids_of(tokenizer, short))) == (60, 40)
    docs = [(k, long if k < 40 else short) for k in range(80)]
    rows = packing.pack(frame(spark, docs), TOKENIZER, capacity=100).collect()
    assert check_packing(rows, {i: ids_of(tokenizer, t) for i, t in docs}, 100) == 40


def test_packing_many_pieces_of_two_lengths():
    lengths = np.repeat([600, 424], 5000)
    layout = packing._layout({600: 5000, 424: 5000}, 1024)
    bins, places = packing._look_up(layout, lengths, packing._ranks(lengths))
    assert len(set(bins.tolist())) == 5000 and (np.bincount(bins, lengths) == 1024).all()
    assert len(set(zip(bins.tolist(), places.tolist()))) == 10000
    for split in (lengths[:5000], lengths[5000:]):
        assert (packing.fill(split, 1024, True)[0] == -1).all()  # all go on, none is closed with room left


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=12), st.integers(20, 30))
def test_fullest_is_fullest(lengths, capacity):
    counts = Counter(lengths)
    chosen = packing.fullest(dict(counts), capacity)
    assert all(counts[x] >= k for x, k in chosen.items()) and chosen[max(lengths)] >= 1
    rest = sorted(lengths)[:-1]
    sums = {0}
    for x in rest:
        sums |= {s + x for s in sums}
    assert sum(x * k for x, k in chosen.items()) == max(lengths) + max(s for s in sums if s + max(lengths) <= capacity)
    bins, places = packing.fill(np.array(lengths), capacity, 0)
    assert (bins >= 0).all() and np.bincount(bins, lengths).max() <= capacity


# -- near-dedup


def test_near_dedup(spark):
    docs = documents() + [(300 + k, prose(50, 100) + " " + prose(60 + k, 4 + k)) for k in range(25)] + [(400 + k, prose(70 + k, 30) + " " + prose(99, 60)) for k in range(12)]
    got = near_dedup.group(frame(spark, docs)).collect()
    want = components({(i, t) for i, t in docs if i is not None})
    assert len(got) == len(docs)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)
    kept = near_dedup.drop_near_duplicates(frame(spark, docs))
    assert kept.columns == frame(spark, []).columns
    want = {r.doc_id for r in got if r.kept and r.doc_id is not None}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(want) + Counter(r.doc_id for r in got if r.doc_id is None)  # one row of each id
    assert near_dedup.group(frame(spark, [])).collect() == []


def test_near_dedup_of_ids_with_different_texts(spark):
    x, y = prose(1, 60), prose(2, 60)
    docs = [(1, x), (5, x), (5, y), (9, y + " end"), (10, prose(3, 60)), (10, prose(4, 60)), (11, prose(4, 60) + " end"), (12, prose(3, 60)), (20, ""), (20, prose(5, 60)), (21, prose(5, 60)), (30, prose(6, 60)), (30, prose(6, 60)), (7, prose(7, 40)), (6, prose(7, 40)), (7, prose(8, 40)), (8, prose(8, 40) + " a")]
    want = {1: 1, 5: 1, 9: 1, 10: 10, 11: 10, 12: 10, 20: 20, 21: 20, 30: 30, 6: 6, 7: 6, 8: 6}
    for tasks in (1, 5):
        got = near_dedup.group(frame(spark, docs).repartition(tasks)).collect()
        assert len(got) == len(docs) and all(r.component_id == want[r.doc_id] and r.kept == (want[r.doc_id] == r.doc_id) for r in got)


def similar(k: int, core: int, own: int) -> str:
    """Texts that share ``core`` shingles and have ``own`` shingles of their own."""
    return " ".join([f"c{i}" for i in range(core + 4)] + [f"u{k}x{i}" for i in range(own)])


def test_near_dedup_emits_nothing_below_the_threshold(spark, monkeypatch):
    emitted = []
    blocks = near_dedup._block_links

    def counted(*args):
        emitted.append(blocks(*args))
        return emitted[-1]

    monkeypatch.setattr(near_dedup, "_block_links", counted)
    monkeypatch.setattr(near_dedup, "BLOCK", 100)
    docs = [(k, similar(k, 75, 25)) for k in range(300)]  # each pair has similarity 75 / 125
    got = near_dedup.group(frame(spark, docs)).collect()
    assert all(r.component_id == r.doc_id for r in got) and len(emitted) == 1 and emitted[0].count() == 0
    docs += [(1000 + k, similar(k, 75, 25) + " end") for k in range(0, 300, 3)]
    got = near_dedup.group(frame(spark, docs).repartition(4)).collect()
    assert all(r.component_id == r.doc_id % 1000 for r in got) and emitted[-1].count() <= len(docs)


@pytest.mark.parametrize("size,shingles", [(4, 1 << 20), (1024, 400), (1024, 1 << 20)])
def test_residual_buckets_are_compared_in_blocks(spark, monkeypatch, size, shingles):
    monkeypatch.setattr(near_dedup, "BLOCK", size)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", shingles)
    docs = [(k, prose(5, 80) + " " + prose(100 + k, k % 30)) for k in range(30)] + [(50 + k, prose(6, 80) + " " + prose(200 + k, 3 + k % 20)) for k in range(20)] + [(90, prose(9, 8))]
    rows = spark.createDataFrame([(1, k, k) for k, _ in docs] + [(2, 7, 7)], "key bigint, doc_id bigint, root bigint")
    sets = frame(spark, docs).select("doc_id", "text").mapInArrow(near_dedup._set_bytes, "doc_id bigint, elements binary")
    links = [tuple(r) for r in near_dedup._block_links(rows, sets, 70).collect()]
    want = components(docs)
    nodes, roots = near_dedup.union_find(*np.array(links).T)
    found = dict(zip(nodes.tolist(), roots.tolist()))
    assert {k: found.get(k, k) for k, _ in docs} == {k: want[k][1] for k, _ in docs}
    assert size == 4 or shingles == 400 or len(links) < len(docs)


def test_overlaps_and_forest():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 90, n, dtype=np.uint64)) for n in rng.integers(0, 80, 120)]
    got = near_dedup.overlaps(sets[:50], sets[50:])
    assert got.tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets[50:]] for a in sets[:50]]
    assert near_dedup.overlaps([], sets).shape == (0, 120) and not near_dedup.overlaps(sets[:0] or [sets[0][:0]], [sets[0][:0]]).any()
    good = rng.random((40, 40)) < 0.03
    good |= good.T
    edges = near_dedup.forest(good)
    a, b = np.nonzero(good)
    if len(a):
        assert {x: y for x, y in zip(*map(np.ndarray.tolist, near_dedup.union_find(a, b)))} == {x: y for x, y in zip(*map(np.ndarray.tolist, near_dedup.union_find(*np.array(edges).T)))}
    assert len(edges) < 40 and all(good[x, y] for x, y in edges)


def test_hot_keys_are_split(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "LEAST_HOT", 3)
    monkeypatch.setattr(near_dedup, "MOST_HOT", 40)
    docs = [(k, prose(5, 80) + " " + prose(100 + k, k % 30)) for k in range(40)] + [(60 + k, prose(5, 80)) for k in range(20)] + [(90 + k, prose(9 + k, 30)) for k in range(6)]
    got = near_dedup.group(frame(spark, docs)).collect()
    want = components(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


@pytest.mark.parametrize("local", [0, 10**6])
def test_components(spark, local):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(k, k + 1) for k in range(200, 260)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    nodes, roots = near_dedup.union_find(*np.array([x for x in links if x[0] != x[1]]).T)
    assert {tuple(r) for r in near_dedup.components(df, local).collect()} == set(zip(nodes.tolist(), roots.tolist()))
    assert near_dedup.components(df.limit(0), local).collect() == []


def test_signatures_match_the_sequential_method():
    rng = np.random.default_rng(4)
    sets = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (0, 1, 2, 17, 150)]
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    got = near_dedup.super_minhash(np.concatenate(sets), bounds, 16)
    for s, g in zip(sets, got):
        h = [0xFFFFFFFF] * 16
        for e in s:
            p = list(range(16))
            for j in range(16):
                with np.errstate(over="ignore"):
                    x = int(common.mix64(np.array([e]) + near_dedup._STEP * np.uint64(j + 1))[0])
                k = (((x & 0xFFFFFF) * (16 - j)) >> 24) + j
                p[j], p[k] = p[k], p[j]
                h[p[j]] = min(h[p[j]], (x >> 40) | (j << 24))
        assert g.tolist() == h


# -- search


def brute_search(docs, k=10, every=50):
    terms = [(i, Counter(words8(t))) for i, t in docs]
    n, df = len(terms), Counter(w for _, t in terms for w in t)
    mean = sum(sum(t.values()) for _, t in terms) / n
    out = []
    for q, qt in terms:
        if q is None or q % every or not qt:
            continue
        scored = []
        for i, t in terms:
            size = sum(t.values())
            x = sum(math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * t[w] * 2.2 / (t[w] + 1.2 * (0.25 + 0.75 * size / mean)) for w in qt if w in t)
            if x > 0:
                scored.append((i, x))
        scored.sort(key=lambda x: (-round(x[1], 9), x[0] is not None, x[0] or 0))
        out += [(q, r + 1, i, round(x, 6)) for r, (i, x) in enumerate(scored[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("tasks", [1, 5])
def test_search(spark, tasks):
    docs = documents() + [(1000 + k, prose(k % 40, 20 + k % 60)) for k in range(160)]
    got = bm25_search.search(frame(spark, docs).repartition(tasks), k=7).collect()
    assert sorted([(r.query_id, r.rank, r.doc_id, round(r.score, 6)) for r in got], key=str) == brute_search(docs, 7)


def test_search_with_a_query_table(spark):
    docs = [(k, prose(k, 30)) for k in range(40)]
    asked = spark.createDataFrame([(1, prose(3, 30)), (2, None), (3, "zzz")], "doc_id bigint, text string")
    got = bm25_search.search(frame(spark, docs), asked, k=3).collect()
    assert {r.query_id for r in got} == {1} and next(r for r in got if r.rank == 1).doc_id == 3
    assert bm25_search.search(frame(spark, [])).collect() == []


def test_search_in_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(bm25_search, "QUERIES_PER_BLOCK", 2)
    docs = [(k, prose(k % 50, 25)) for k in range(500)]
    got = bm25_search.search(frame(spark, docs).repartition(3), k=5).collect()
    assert sorted([(r.query_id, r.rank, r.doc_id, round(r.score, 6)) for r in got], key=str) == brute_search(docs, 5)


def test_search_looks_at_pivot_blocks_only(monkeypatch):
    monkeypatch.setattr(bm25_search, "BLOCK", 8)
    topics = [prose(1000 + 31 * t, 60).split() for t in range(12)]
    texts = [" ".join(f"{w}{k % 12}" for w in topics[k % 12][k % 7 : 30 + k % 23]) + f" river own{k}" for k in range(480)]
    builder = bm25_search.Builder()
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    n = len(texts)
    builder.add(np.frombuffer(b"".join(raw), np.uint8), off, np.arange(n), np.arange(n, dtype=np.uint64), np.arange(n) % 10 == 0, np.zeros(n, np.int32), np.ones(n, bool))
    builder.close()
    shard = bm25_search.Shard.build(builder)
    terms, df = shard.terms, np.diff(shard.begin)
    asked = np.flatnonzero(np.arange(n) % 10 == 0)
    own = [np.searchsorted(terms, builder.word[builder.begin[d] : builder.begin[d + 1]]) for d in asked]
    begin = np.concatenate([[0], np.cumsum([len(x) for x in own])])
    index = bm25_search.Index(shard, terms, df, n, float(shard.size.mean()))
    want = sorted((k, int(i)) for k, d in enumerate(asked) for i in range(n))
    full = bm25_search.Best(len(asked), 5)
    for q, d, x in index.reaching(begin, np.concatenate(own), np.full(len(asked), 1e-12)):
        full.add(q, x)
    assert index.pivots > 0.5 * index.blocks and len(want) == len(asked) * n  # without thresholds every block with a term
    index.pivots = index.blocks = 0
    found = bm25_search.Best(len(asked), 5)
    for q, d, x in index.reaching(begin, np.concatenate(own), full.level()):
        found.add(q, x)
    assert (found.scores == full.scores).all() and index.pivots < 0.25 * index.blocks


def test_search_cuts_shards(spark, monkeypatch):
    monkeypatch.setattr(bm25_search, "SHARD_DOCS", 7)
    monkeypatch.setattr(bm25_search, "TOGETHER", 3)
    monkeypatch.setattr(bm25_search, "MATRIX_BYTES", 4 * 64 * 5)
    docs = documents() + [(1000 + k, prose(k % 40, 20 + k % 60)) for k in range(160)]
    got = bm25_search.search(frame(spark, docs).repartition(3), k=7).collect()
    assert sorted([(r.query_id, r.rank, r.doc_id, round(r.score, 6)) for r in got], key=str) == brute_search(docs, 7)


@pytest.mark.parametrize("row", [0, 3, 400])
def test_search_index_serves_all_blocks_of_queries(monkeypatch, row):
    monkeypatch.setattr(bm25_search, "BLOCK", 8)
    monkeypatch.setattr(bm25_search, "TOGETHER", 7)
    monkeypatch.setattr(bm25_search, "ROW", row)  # 0: no list is a matrix row
    raw = [prose(k % 90, 20 + k % 60).encode() for k in range(300)]
    off, n = np.concatenate([[0], np.cumsum([len(r) for r in raw])]), len(raw)
    builder = bm25_search.Builder()
    builder.add(np.frombuffer(b"".join(raw), np.uint8), off, np.arange(n), np.arange(n, dtype=np.uint64), np.arange(n) % 10 == 0, np.zeros(n, np.int32), np.ones(n, bool))
    builder.close()
    shard = bm25_search.Shard.build(builder)
    df = dict(zip(shard.terms.tolist(), np.diff(shard.begin).tolist()))
    index = None
    for part in np.array_split(np.arange(0, n, 10), 3):
        own = [builder.word[builder.begin[d] : builder.begin[d + 1]] for d in part]
        terms = np.unique(np.concatenate(own))
        counts = np.array([df[t] for t in terms.tolist()])
        if index is None:
            index = bm25_search.Index(shard, terms, counts, n, float(shard.size.mean()))
        else:
            index.ask(terms, counts)
        begin, at = np.concatenate([[0], np.cumsum([len(x) for x in own])]), np.searchsorted(terms, np.concatenate(own))
        every = index.exact(np.repeat(np.arange(len(part)), n), np.tile(np.arange(n), len(part)), index.slot[at], begin).reshape(len(part), n)
        fresh = bm25_search.Index(shard, terms, counts, n, float(shard.size.mean()))
        assert (fresh.exact(np.repeat(np.arange(len(part)), n), np.tile(np.arange(n), len(part)), fresh.slot[at], begin).reshape(len(part), n) == every).all()
        levels = np.sort(every, 1)[:, -5]
        found = {(q, d): x for qs, ds, xs in index.reaching(begin, at, levels) for q, d, x in zip(qs.tolist(), ds.tolist(), xs.tolist())}
        assert found == {(q, d): every[q, d] for q, d in zip(*(x.tolist() for x in np.nonzero(every >= levels[:, None])))}
        best = bm25_search.Best(len(part), 5)
        for q, _, x in index.reaching(begin, at, np.full(len(part), 1e-12), 5):
            best.add(q, x)
        assert (best.level() == levels).all()


def test_search_rounds():
    assert bm25_search.rounds(384) == [6, 48, 384] and bm25_search.rounds(10) == [1, 10]
    assert bm25_search.rounds(3) == [3] and bm25_search.rounds(0) == [0]


# -- repeated passages


def brute_repeats(docs):
    least = {}
    top = 1 << 62
    for i, t in docs:
        raw = (t or "").encode()
        for p in range(len(raw) - 49):
            w = raw[p : p + 50]
            least[w] = min(top if i is None else i, least.get(w, top))
    out = []
    for i, t in docs:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if least[raw[p : p + 50]] < (top if i is None else i):
                gone[p : p + 50] = b"\1" * 50
        runs = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(raw), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [20_000, 2])
@pytest.mark.parametrize("tasks", [1, 6])
def test_repeats(spark, hot, tasks):
    shared = prose(77, 70)
    docs = documents() + [(500 + k, prose(90 + k, 10 + k) + " " + shared[k : len(shared) - 3 * k] + " " + prose(60, 12 + k % 5)) for k in range(25)]
    docs += [(600, "z" * 49), (601, "z" * 50), (602, "z" * 51), (603, ("abcdefghij" * 30)), (604, "Q" + "abcdefghij" * 20)]
    got = repeat_dedup.remove_repeats(frame(spark, docs).repartition(tasks), hot=hot).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_repeats(docs)
    assert repeat_dedup.remove_repeats(frame(spark, [])).collect() == []


def test_long_texts_are_searched_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(repeat_dedup, "STRETCH", 1 << 20)
    text = "".join(prose(k, 4000) for k in range(40)).encode()
    data = np.frombuffer(text, np.uint8)
    whole = {(int(a), int(s)) for a, lo, hi, _ in zip(*repeat_dedup.anchors(data, np.array([0, len(data)]))) for s in range(lo, hi + 1)}
    parts = set()
    for part, off, _, at in repeat_dedup.stretches(data, np.array([0, len(data)])):
        for a, lo, hi, _ in zip(*repeat_dedup.anchors(part, off)):
            parts |= {(int(a) + at, int(s) + at) for s in range(lo, hi + 1)}
    assert parts == whole and len(data) > 1 << 20


def test_shared_windows():
    a, b = prose(1, 20).encode(), prose(2, 20).encode()
    texts = [a + b"#" + b, b"!" + a[10:90], b[:49], b[:50] + b"?"]
    got = repeat_dedup.shared_windows(texts, [1, 2, 3, 4])
    for k, t in enumerate(texts):
        want = [p for p in range(len(t) - 49) if any(t[p : p + 50] in x for x in texts[:k])]
        assert sorted(got[k]) == want


def test_repeats_in_small_portions(spark, monkeypatch):
    monkeypatch.setattr(repeat_dedup, "FLUSH_BYTES", 1 << 10)
    monkeypatch.setattr(repeat_dedup, "BUCKET_BYTES", 1 << 12)
    docs = documents() + [(500 + k, prose(90 + k, 10 + k) + " " + prose(77, 70)[k:] + " " + prose(60, 12 + k % 5)) for k in range(25)]
    got = repeat_dedup.remove_repeats(frame(spark, docs).repartition(2)).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_repeats(docs)


def test_token_files_by_bytes(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(token_stream, "SHARD_BYTES", 4 << 10)
    docs = documents()
    shards = token_stream.write(frame(spark, docs), TOKENIZER, common.scratch(spark, "tokens"))
    assert len(shards) > 4  # more than partitions
    got = sorted((tuple(r) for r in token_stream.read(spark, shards).collect()), key=lambda r: r[1])
    want = [(i, len(ids_of(tokenizer, t)), crc(ids_of(tokenizer, t))) for i, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0))]
    assert sorted(map(str, [(g[0], g[2], g[3]) for g in got])) == sorted(map(str, want)) and [g[0] for g in got] == [w[0] for w in want]


def test_contents_are_cut_to_the_windows_that_they_share():
    rng = np.random.default_rng(3)
    content = rng.integers(97, 123, (5, repeat_dedup.WIDTH)).astype(np.uint8)
    content[1, 6:61] = content[0, 6:61]  # windows 6 to 11
    content[3, 6:61] = content[0, 6:61]  # of another key
    first, last = np.array([4, 4, 4, 4, 255]), np.array([15, 15, 15, 15, -1])
    repeat_dedup._narrow(content, np.array([0, 0, 0, 1, 1]), first, last)
    assert first[:2].tolist() == [6, 6] and last.tolist() == [11, 11, -1, -1, -1]
    # what is left is one string
    assert content[0, 6 : 11 + repeat_dedup.LEAST].tobytes() == content[1, 6 : 11 + repeat_dedup.LEAST].tobytes()
