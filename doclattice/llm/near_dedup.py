"""Near-duplicate grouping: SuperMinHash signatures, banding, verification, union-find.

A document's set holds the hashes of its distinct 5-word shingles. Two documents are
linked when ``100 * |A & B| >= 70 * |A | B|``, decided on the full sets.

1. *Signatures.* SuperMinHash gives every element one random permutation of the slots,
   built step by step; step j offers the rank ``j + r`` to one slot. All elements take a
   step together; a document stops early once every slot holds a rank below the next
   step, which for most is after two steps.
2. *Exact copies* (equal sets) fall together by a 128-bit set hash; only the row with the
   smallest id goes on, and the id stands for the set. An id whose rows have different sets
   is one node: it has a signature for each set that it stands for, and is linked with the
   ids that stand for its other ones.
3. *Banding.* 42 bands of 3 slots: a pair at the threshold shares no band with a
   probability of 2e-8. No pairs are made within a bucket; each member is held against the
   bucket's pivot (its smallest id), so candidates grow with the rows.
4. *Verification.* Signature estimates drop hopeless pairs (below 0.5, five deviations
   under the threshold), then the full sets of both texts decide.
5. *Union-find* over the links gives components.
6. Buckets whose other members are not yet of one component get the next pivot, for
   ``STAR_ROUNDS`` rounds; what is still open after those is compared block by block, on the
   full sets and within one task: blocks are bounded by members and by shingles, shared
   shingles are counted for all pairs of two blocks at once, and only a forest of links
   between members of different components leaves the task. So however many members of a
   bucket are just below the threshold, nothing is emitted for them. A pair that shares a
   bucket is either compared or already in one component.

Joins whose key may be hot (a bucket, a pivot, a hub of links) split the keys with more rows
than a ``MOST_HOT``-th of all; there are at most ``MOST_HOT`` of those, so their list is
broadcast, and the number of parts of each follows its rows.

Everything between the steps is a table in the shared folder, so lost executors only
repeat their own tasks.

Defined results: null, empty and blank texts have an empty set, ``n_shingles`` 0, and stand
alone; texts of one to four words have one shingle; rows with the same id are one node,
linked with whatever any of its rows is linked with; a null id stands alone with a null
component and is kept; extra columns stay in ``drop_near_duplicates``; empty tables give
empty results; a very long text is handled whole, by itself, in some 40 bytes of memory for
each of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

SHINGLE = 5
SLOTS, BAND = 126, 3
BANDS = SLOTS // BAND
MIN_ESTIMATE = 0.5
STAR_ROUNDS = 2
#: Members, and about as many shingles, of a residual bucket that one task compares with as many others.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: Ids (8 bytes each) up to which a semi-join may be broadcast; beyond, it shuffles.
BROADCAST_IDS = 1_000_000
#: Links that one union-find task takes; beyond, star contraction over the cluster comes first.
LOCAL_LINKS = 4_000_000
#: Keys of a join that are split, at most, and rows below which none is.
MOST_HOT, LEAST_HOT = 10_000, 20_000

_Q = [np.uint64(pow(0xC2B2AE3D27D4EB4F, k, 2**64)) for k in range(SHINGLE)]
_STEP = np.uint64(0x9E3779B97F4A7C15)


# -- sets and signatures


def shingle_sets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, one after the other, and where each row's begin."""
    data = np.frombuffer(data.tobytes().translate(c.LOWER.tobytes()), np.uint8)
    starts, ends, first = c.word_spans(data, off, c.BLANK)
    words = c.span_hash(c.prefix_hash(data), starts, ends)
    n = np.diff(first)
    many = len(words) - SHINGLE + 1
    with np.errstate(over="ignore"):
        if many > 0:
            grams = np.zeros(many, np.uint64)
            for k in range(SHINGLE):
                grams += words[k : k + many] * _Q[k]
            grams = c.mix64(grams)
    out, size = [], np.zeros(len(n) + 1, np.int64)
    for r, (a, k) in enumerate(zip(first[:-1].tolist(), n.tolist())):
        if k >= SHINGLE:
            own = np.sort(grams[a : a + k - SHINGLE + 1])
            if len(own) > 1:
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif k:
            with np.errstate(over="ignore"):
                own = c.mix64(np.array([sum((words[a + i] * _Q[i] for i in range(k)), np.uint64(k))], np.uint64))
        else:
            continue
        out.append(own)
        size[r + 1] = len(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.cumsum(size)


def super_minhash(elements: np.ndarray, bounds: np.ndarray, m: int = SLOTS) -> np.ndarray:
    """Signatures (rows x m, 32 bits: step and 24-bit rank) of the rows' element sets; empty rows keep the maximum."""
    rows = len(bounds) - 1
    never = np.uint32(0xFFFFFFFF)
    h = np.full(rows * m, never, np.uint32)
    row = np.repeat(np.arange(rows), np.diff(bounds))
    e = elements
    perm: np.ndarray | None = None
    previous = None
    for j in range(m):
        if not len(e):
            break
        with np.errstate(over="ignore"):
            x = c.mix64(e + _STEP * np.uint64(j + 1))
        rank = (x >> np.uint64(40)).astype(np.uint32) | np.uint32(j << 24)
        k = ((((x & np.uint64(0xFFFFFF)) * np.uint64(m - j)) >> np.uint64(24)) + np.uint64(j)).astype(np.int64)
        if j == 0:
            slot, previous = k, k
        elif j == 1:
            slot = np.where(k == previous, 0, k)
        else:
            if perm is None:  # few are left: write the permutations out
                perm = np.tile(np.arange(m, dtype=np.uint8), (len(e), 1))
                at = np.arange(len(e))
                for step, pick in ((0, first_pick), (1, second_pick)):
                    held = perm[at, step].copy()
                    perm[at, step] = perm[at, pick]
                    perm[at, pick] = held
            at = np.arange(len(e))
            slot = perm[at, k].astype(np.int64)
            perm[at, k] = perm[at, j]
            perm[at, j] = slot
        np.minimum.at(h, row * m + slot, rank)
        # the next step offers at least j + 1 to any slot
        live = h.reshape(rows, m).max(1) >= np.uint32(min((j + 1) << 24, 0xFFFFFFFF))
        on = live[row]
        if not on.all():
            e, row = e[on], row[on]
            if perm is not None:
                perm = perm[on]
            elif j == 0:
                previous = previous[on]
        if j == 0:
            first_pick = previous
        elif j == 1:
            first_pick, second_pick = first_pick[on], k[on]
    return h.reshape(rows, m)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """64-bit key of every band of every signature."""
    part = signatures.reshape(len(signatures), BANDS, BAND).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP
        for k in range(BAND):
            key = c.mix64(key + part[:, :, k])
    return key.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, off in c.text_chunks(batch, 1):
            sets, bounds = shingle_sets(data, off)
            n = np.diff(bounds)
            sig = super_minhash(sets, bounds)
            with np.errstate(over="ignore"):
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(c.mix64(sets ^ np.uint64(s)))]) for s in (0x1234567, 0x7654321)]
                lo, hi = ((s[bounds[1:]] - s[bounds[:-1]]).view(np.int64) for s in sums)
            keys = band_keys(sig)
            some = n > 0
            packed = (sig & np.uint32(0xFF)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(n), pa.array(lo), pa.array(hi),
                    pa.array([packed[r].tobytes() if some[r] else None for r in range(j - i)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]), pa.int32()), pa.array(keys[some].ravel())),
                ],
                names=["doc_id", "n_shingles", "lo", "hi", "sig", "bands"],
            )


# -- joins with hot keys


def _hot(rows: DataFrame, key: str) -> DataFrame | None:
    """Keys (key, parts) of ``rows`` with more rows than a MOST_HOT-th of all; None if there are none."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("size"))
    most = max(LEAST_HOT, rows.count() // MOST_HOT)
    found = [(r[0], -(-r[1] // most)) for r in sizes.where(F.col("size") > most).collect()]  # fewer than MOST_HOT
    return rows.sparkSession.createDataFrame(found, f"{key} bigint, parts bigint") if found else None


def _split_join(rows: DataFrame, per_key: DataFrame, key: str, by: str, hot: DataFrame | None) -> DataFrame:
    """rows JOIN per_key USING (key); the rows of a hot key spread by the hash of ``by``."""
    if hot is None:
        return rows.join(per_key, key)
    hot = F.broadcast(hot)
    left = rows.join(hot, key, "left").withColumn("part", F.pmod(F.xxhash64(by), F.coalesce("parts", F.lit(1)))).drop("parts")
    right = per_key.join(hot, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return left.join(right, [key, "part"]).drop("part")


# -- verification


def _likely(pairs: DataFrame, nodes: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Pairs (a, b) whose signatures agree in at least MIN_ESTIMATE of the slots."""
    sig = nodes.select("doc_id", "sig")
    both = pairs.join(sig.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b")), "b")
    both = _split_join(both, sig.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a")), "a", "b", hot).select("a", "b", "sig_a", "sig_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c.release()
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SLOTS) for k in (2, 3))
                yield batch.select([0, 1]).filter(pa.array((x == y).mean(1) >= MIN_ESTIMATE))

    return both.mapInArrow(run, "a bigint, b bigint")


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    c.release()
    for batch in batches:
        good = np.zeros(batch.num_rows, bool)
        da, oa = c.text_buffers(batch.column(2))
        db, ob = c.text_buffers(batch.column(3))
        for i, j in c.chunks(oa + ob):
            sa, ba = shingle_sets(da[oa[i] : oa[j]], oa[i : j + 1] - oa[i])
            sb, bb = shingle_sets(db[ob[i] : ob[j]], ob[i : j + 1] - ob[i])
            for r in range(j - i):
                x, y = sa[ba[r] : ba[r + 1]], sb[bb[r] : bb[r + 1]]
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                good[i + r] = len(both) > 0 and 100 * common >= percent * (len(x) + len(y) - common)
        yield batch.select([0, 1]).filter(pa.array(good))


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the candidate pairs, decided on full sets. ``docs`` has doc_id and text."""
    pairs = c.materialize(pairs.distinct(), "pairs")
    hot = _hot(pairs, "a")  # a pivot may have very many partners
    likely = c.materialize(_likely(pairs, nodes, hot).distinct(), "likely")
    ids = likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    small = ids.count() <= BROADCAST_IDS
    texts = c.materialize(docs.join(F.broadcast(ids) if small else ids.hint("shuffle_hash"), "doc_id", "left_semi"), "texts")
    both = likely.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = _split_join(both, texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a", "b", hot).select("a", "b", "text_a", "text_b")
    with c.small_batches(docs.sparkSession, 1000):  # rows hold two texts
        links = c.materialize(both.mapInArrow(lambda it: _confirm(it, percent), "a bigint, b bigint"), "links")
    c.discard(pairs, likely, texts)
    return links


# -- union-find


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links and the smallest node of each one's component."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    half = len(a)
    for x, y in zip(flat[:half].tolist(), flat[half:].tolist()):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return nodes, nodes[[find(x) for x in range(len(nodes))]]


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in batches:
        a.append(batch.column(0).to_numpy(zero_copy_only=False))
        b.append(batch.column(1).to_numpy(zero_copy_only=False))
    nodes, roots = union_find(np.concatenate(a), np.concatenate(b))
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "root"])


def components(links: DataFrame, local_links: int = LOCAL_LINKS) -> DataFrame:
    """(node, root) for every node with a link; root is the smallest node it can reach.

    Few links go to one union-find task. More are first contracted over the cluster by
    alternating large-star and small-star steps, in which every node hangs itself and its
    neighbours to the smallest one, until nothing changes.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = c.materialize(edges, "edges")
    n = edges.count()
    if n <= local_links:
        return edges.coalesce(1).mapInArrow(_unite, "node bigint, root bigint")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        above = _split_join(both.where("b > a"), least, "a", "b", _hot(both, "a"))
        edges = c.materialize(above.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        small = _split_join(edges, least, "a", "b", _hot(edges, "a")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = c.materialize(small.where("a <> b").distinct(), "small")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = state


# -- buckets


def _buckets(nodes: DataFrame) -> DataFrame:
    """Rows (key, doc_id, pivot) of the buckets with several ids; the pivot is the smallest."""
    rows = nodes.select(F.explode("bands").alias("key"), "doc_id")
    shared = rows.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("top"), F.count("*").alias("size")).where("pivot <> top").select("key", "pivot", "size")
    shared = c.materialize(shared, "shared")
    return c.materialize(_with_state(rows, shared).select("key", "doc_id", "pivot").where("doc_id <> pivot"), "buckets")


def _with_state(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """rows JOIN shared USING (key), where ``shared`` has the number of rows of its keys as ``size``."""
    total = shared.agg(F.sum("size")).first()[0] or 0
    most = max(LEAST_HOT, total // MOST_HOT)
    found = [(r[0], -(-r[1] // most)) for r in shared.where(F.col("size") > most).select("key", "size").collect()]  # fewer than MOST_HOT
    return _split_join(rows, shared, "key", "doc_id", rows.sparkSession.createDataFrame(found, "key bigint, parts bigint") if found else None)


def _open_rows(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (key, doc_id, root, size, pivot) of the buckets whose members are not all of one component."""
    rows = buckets.join(roots.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left").select("key", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    rows = c.materialize(rows, "rows")
    state = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size"), F.min("doc_id").alias("pivot")).where("lo <> hi")
    return _with_state(rows, c.materialize(state.select("key", "size", "pivot"), "state"))


def _set_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, off in c.text_chunks(batch, 1):
            sets, bounds = shingle_sets(data, off)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([sets[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary())], names=["doc_id", "elements"])


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Number of elements that each left set has in common with each right set; all sets are free of repeats."""
    nl, nr = len(left), len(right)
    out = np.zeros(nl * nr, np.int64)
    e = np.concatenate([*left, *right]) if nl + nr else np.zeros(0, np.uint64)
    if not len(e):
        return out.reshape(nl, nr)
    owner = np.repeat(np.arange(nl + nr), [len(x) for x in (*left, *right)])
    order = np.argsort(e, kind="stable")  # of equal elements, left owners stand first
    e, owner = e[order], owner[order]
    cut = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))
    size = np.diff(np.append(cut, len(e)))
    in_left = np.add.reduceat((owner < nl).astype(np.int64), cut)
    in_right = size - in_left
    pairs = in_left * in_right
    # elements of few sets: their pairs are written out
    rare = np.flatnonzero((pairs > 0) & (pairs <= 64))
    for i in range(0, len(rare), 1 << 15):
        own = rare[i : i + (1 << 15)]
        k = np.repeat(np.arange(len(own)), pairs[own])
        step = np.arange(len(k)) - np.repeat(np.cumsum(pairs[own]) - pairs[own], pairs[own])
        begin, width = cut[own][k], in_right[own][k]
        x, y = owner[begin + step // width], owner[begin + in_left[own][k] + step % width] - nl
        out += np.bincount(x * nr + y, minlength=nl * nr)
    # elements of many sets: a product of membership matrices, some columns at a time
    common = np.flatnonzero(pairs > 64)
    total = np.zeros((nl, nr), np.float32)
    for i in range(0, len(common), 2048):
        own = common[i : i + 2048]
        at = np.repeat(cut[own] - (np.cumsum(size[own]) - size[own]), size[own]) + np.arange(int(size[own].sum()))
        member = np.zeros((nl + nr, len(own)), np.float32)
        member[owner[at], np.repeat(np.arange(len(own)), size[own])] = 1
        total += member[:nl] @ member[nl:].T
    return out.reshape(nl, nr) + total.astype(np.int64)


def forest(good: np.ndarray) -> list[tuple[int, int]]:
    """Edges (parent, child) of a spanning forest of a symmetric matrix of booleans."""
    out: list[tuple[int, int]] = []
    fresh = good.any(1)
    for start in np.flatnonzero(fresh).tolist():
        if not fresh[start]:
            continue
        fresh[start] = False
        front = np.array([start])
        while len(front):
            new = np.flatnonzero(good[front].any(0) & fresh)
            if len(new):
                out += zip(front[good[np.ix_(front, new)].argmax(0)].tolist(), new.tolist())
                fresh[new] = False
            front = new
    return out


def _block_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of different components within buckets, decided block by block on the full ``sets`` (doc_id, elements)."""
    weights = sets.groupBy("doc_id").agg(F.sum(F.octet_length("elements") / 8).alias("n"))
    rows = c.materialize(rows.select("key", "doc_id", "root").join(weights, "doc_id"), "weighed")
    state = rows.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"), F.count("*").alias("size")).where("size > 1")
    rows = _with_state(rows, c.materialize(state, "state"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks").cast("bigint")).cast("int"))
    spread = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", "root")
    spread = spread.join(sets, "doc_id").select("key", "i", "j", "block", "doc_id", "root", "elements")

    def compare(block: np.ndarray, doc: np.ndarray, root: np.ndarray, elements: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        own = [np.frombuffer(x, np.uint64) for x in elements]
        n = np.array([len(x) for x in own])
        left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        shared = overlaps([own[k] for k in left], [own[k] for k in right])
        links = (100 * shared >= percent * (n[left][:, None] + n[right][None, :] - shared)) & (shared > 0) & (root[left][:, None] != root[right][None, :])
        if not links.any():
            return doc[:0], doc[:0]
        good = np.zeros((len(doc), len(doc)), bool)
        good[np.ix_(left, right)] = links
        edges = np.array(forest(good | good.T)).reshape(-1, 2)
        return doc[edges[:, 0]], doc[edges[:, 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c.release()
        held: pa.Table | None = None

        def groups(table: pa.Table, last: bool):
            keys = [table.column(k).to_numpy() for k in ("key", "i", "j")]
            cut = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys]), [True]]))
            whole = cut if last else cut[:-1]
            block, doc, root = (table.column(k).to_numpy() for k in ("block", "doc_id", "root"))
            elements = table.column("elements")
            out = [compare(block[x:y], doc[x:y], root[x:y], elements.slice(x, y - x).to_pylist()) for x, y in zip(whole[:-1].tolist(), whole[1:].tolist())]
            a, b = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]), int(whole[-1])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            first, last = ([held.column(k)[at].as_py() for k in ("key", "i", "j")] for at in (0, -1))
            if first == last:  # the group goes on
                continue
            out, upto = groups(held, False)
            held = held.slice(upto)
            yield out
        if held is not None and held.num_rows:
            yield groups(held, True)[0]

    with c.small_batches(rows.sparkSession, 500):  # rows hold whole sets
        return c.materialize(spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a bigint, b bigint").where("a <> b").distinct(), "links")


# -- the operator


def group(docs: DataFrame, percent: int = 70, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_shingles, component_id (smallest id it is linked with, over any steps), kept."""
    texts = c.keyed(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    signed = texts.mapInArrow(_sign, "doc_id bigint, n_shingles bigint, lo bigint, hi bigint, sig binary, bands array<bigint>")
    signed = c.materialize(signed.withColumn("row", F.monotonically_increasing_id()), "signed")
    texts = texts.where("doc_id IS NOT NULL")
    filled = "n_shingles > 0 AND doc_id IS NOT NULL"

    # equal sets: aggregated before the shuffle; one row of each goes on, under its id
    copies = signed.where(filled).groupBy("lo", "hi").agg(F.min("doc_id").alias("rep"), F.min_by("row", "doc_id").alias("first"), F.count("*").alias("size")).where("size > 1")
    copies = c.materialize(copies.withColumnRenamed("lo", "key"), "copies")
    narrow = signed.where(filled).select(F.col("lo").alias("key"), F.col("hi").alias("own_hi"), "doc_id", "row")
    followers = c.materialize(_with_state(narrow, copies).where("hi = own_hi AND row <> first").select("doc_id", "row", "rep"), "followers")
    small = followers.count() <= BROADCAST_IDS
    gone = followers.select("row")
    nodes = signed.where(filled).join(F.broadcast(gone) if small else gone, "row", "left_anti").select("doc_id", "sig", "bands")
    gone = followers.select("row", "rep")
    members = signed.select("doc_id", "n_shingles", "row").join(F.broadcast(gone) if small else gone, "row", "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    # an id whose rows have several sets is linked with the ids that stand for them
    apart = followers.where("rep <> doc_id").select("doc_id", "rep").distinct()
    ids = apart.select("doc_id").distinct()
    several = signed.select("doc_id").join(F.broadcast(ids) if small else ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    links = c.materialize(apart.join(several, "doc_id", "left_semi").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")), "ids")

    buckets, roots = _buckets(nodes), None
    for turn in range(STAR_ROUNDS + 1):
        rows = c.materialize(_open_rows(buckets, roots), "open") if turn else buckets
        if rows.isEmpty():
            break
        if turn < STAR_ROUNDS:
            left = rows.where("doc_id <> pivot")  # the pivot has met all others
            found = _verified(left.select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")), nodes, texts, percent)
            buckets = left.select("key", "doc_id")
        else:
            ids = rows.select("doc_id").distinct()
            small = ids.count() <= BROADCAST_IDS
            sets = texts.join(F.broadcast(ids) if small else ids.hint("shuffle_hash"), "doc_id", "left_semi").distinct().mapInArrow(_set_bytes, "doc_id bigint, elements binary")
            found = _block_links(rows, c.materialize(sets, "sets"), percent)
        links = links.unionByName(found)
        roots = c.materialize(components(links), "roots")

    if roots is None:
        roots = components(links)
    result = members.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("root", "rep").alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, percent: int = 70, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of one row of each group: that of the smallest id.

    Of rows that repeat this id the one whose text has the smallest hash stays; rows with a null id all stay.
    """
    found = c.materialize(group(docs, percent, id_col, text_col).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("rows")).where("NOT kept OR rows > 1"), "found")
    small = found.count() <= BROADCAST_IDS
    own = c.numbered(docs).withColumn("id__", F.col(f"c{docs.columns.index(id_col)}").cast("bigint"))
    ids = lambda rows: F.broadcast(rows) if small else rows
    kept = own.join(ids(found.select(F.col("doc_id").alias("id__"))), "id__", "left_anti")
    several = found.where("kept").select(F.col("doc_id").alias("id__"))
    if not several.isEmpty():
        again = own.join(ids(several), "id__", "left_semi").withColumn("hash__", F.xxhash64(F.col(f"c{docs.columns.index(text_col)}")))
        least = again.groupBy("id__").agg(F.min("hash__").alias("hash__"))
        kept = kept.unionByName(again.join(least, ["id__", "hash__"], "left_semi").drop("hash__").dropDuplicates(["id__"]))
    return kept.drop("id__").toDF(*docs.columns)
