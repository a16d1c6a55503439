"""Removal of repeated passages: every byte covered by a ``LEAST``-byte string that also starts in a document with a smaller id.

A suffix array orders the suffixes of one text in memory, and equal strings of a corpus lie
in different shards; so places that can hold equal strings are brought together first, and
suffix arrays by linear grouping (``suffix_array``) decide there.

1. *Anchors.* Each window of ``LEAST`` bytes has the ``GRAM``-byte string with the least hash
   in it (the leftmost) as its anchor. Equal windows have equal anchors at the same place,
   and neighbouring windows share theirs: there is one for some 15 bytes.
2. *Repeated anchors.* Anchor hashes, packed by range with a table of documents, are shuffled
   once; those that occur in different texts are reported back. A task sends one entry for
   an anchor and text, and one for an anchor that it has itself seen in several texts, so no
   anchor has more entries than there are tasks.
3. *Contents.* For each repeated anchor of a document, the bytes that its windows span go to
   the anchor's task (equal contents of a task once). There, contents equal as a whole are
   settled by the smallest id. Others are cut down to the windows whose 47-byte core also
   occurs in another content (most by far have none), then to those whose 50 bytes do, and
   what remains, if it isn't one string, is put into a suffix array; windows that are neighbours in it and equal form a
   group with a smallest id. Anchors of more than ``HOT`` texts send each window by its own
   hash instead, which spreads them over all tasks.
4. *Removal.* The covered ranges go to files by block of the input; the last pass reads each
   document with its ranges.

Texts are never shuffled: a document is known by its block (file and range of rows), and what
tasks report about it goes to one sorted, memory-mapped file per bucket of blocks. Copies of a whole
text are found by their SHA-256 and removed whole, but for the smallest id.

Defined results: null and empty texts, and texts of fewer than ``LEAST`` bytes, lose nothing;
strings that repeat within one document, or in rows with the same id, are no reason for
removal; a null id counts as greater than all others; very long texts are searched in
overlapping stretches; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from .suffix_array import suffix_array

LEAST, GRAM = 50, 20
SPAN = LEAST - GRAM + 1  # grams of a window
LEFT = SPAN - 1  # an anchor's windows begin at most so far before it
WIDTH = LEFT + LEAST
CLASS = 4  # windows of a class share a core of LEAST - CLASS + 1 bytes
HOT = 20_000
STRETCH = 8 << 20
#: A bucket of the shuffle has about so much text behind it, and a task sends its anchors after so much.
BUCKET_BYTES, FLUSH_BYTES = 24 << 20, 64 << 20
NO_ID = np.iinfo(np.int64).max
SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"

_POS = np.uint64((1 << 24) - 1)
_LOW40 = np.uint64((1 << 40) - 1)
ENTRY = np.dtype([("key", "<u8"), ("doc", "<i8"), ("th", "<u8"), ("pos", "<i8"), ("bucket", "<i4"), ("lo", "u1"), ("hi", "u1"), ("content", "u1", (WIDTH,))])
RANGE = np.dtype([("uid", "<u8"), ("start", "<i8"), ("end", "<i8")])


# -- anchors


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of rows of at most 16 MB: place, first and last window start (all in ``data``), hash."""
    n = len(data) - LEAST + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    prefix = c.prefix_hash(data)
    _, inv = c._powers(len(prefix))
    m = len(data) - GRAM + 1
    with np.errstate(over="ignore"):
        h = c.mix64((prefix[GRAM:] - prefix[:m]) * inv[:m])
    x, span = (h & ~_POS) | np.arange(m, dtype=np.uint64), 1
    while span * 2 <= SPAN:
        x, span = np.minimum(x[:-span], x[span:]), span * 2
    if SPAN > span:
        x = np.minimum(x[: span - SPAN], x[SPAN - span :])
    ok = np.ones(n, bool)
    for e in off[1:-1].tolist():
        ok[max(0, e - LEAST + 1) : e] = False
    start = np.flatnonzero(ok)
    a = (x[start] & _POS).astype(np.int64)
    if not len(a):
        return a, a, a, np.zeros(0, np.uint64)
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (start[1:] != start[:-1] + 1)
    cut = np.flatnonzero(new)
    last = np.append(cut[1:], len(a)) - 1
    return a[cut], start[cut], start[last], h[a[cut]]


def stretches(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(bytes, offsets, rows, place of the first byte in its row) for parts whose anchors are found at once."""
    for i, j in c.chunks(off, 1 << 20):
        size = int(off[j] - off[i])
        if j - i > 1 or size <= STRETCH:
            yield data[off[i] : off[j]], off[i : j + 1] - off[i], np.arange(i, j), 0
        else:
            for at in range(0, size - LEAST + 1, STRETCH):
                part = data[off[i] + at : min(off[i] + at + STRETCH + LEAST - 1, off[j])]
                yield part, np.array([0, len(part)]), np.array([i]), at


def _uid(doc: np.ndarray, th: np.ndarray) -> np.ndarray:
    """Identity of a document: its id and the hash of its text."""
    with np.errstate(over="ignore"):
        return c.mix64(c.mix64(doc.astype(np.int64).view(np.uint64)) + th)


def _reply_key(uid: np.ndarray, h: np.ndarray) -> np.ndarray:
    """An anchor of a document."""
    with np.errstate(over="ignore"):
        return c.mix64(uid + (h & _LOW40))


def _hot_key(home: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A hot anchor in a bucket of blocks."""
    with np.errstate(over="ignore"):
        return c.mix64(c.mix64(home.astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)) ^ (h & _LOW40))


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    doc = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
    th = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return doc, th, batch.column(3).to_numpy(zero_copy_only=False).astype(np.int32)


def _zip(*arrays: np.ndarray) -> bytes:
    return pa.compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), "zstd", asbytes=True)


def _unzip(blob: bytes) -> bytes:
    import zstandard

    return zstandard.decompress(blob)


def _first(*keys: np.ndarray) -> np.ndarray:
    """True where any of the sorted keys differs from the row before."""
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def _rows(name: str, bucket: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(_first(bucket[order]))
    for a, b in zip(cut.tolist(), np.append(cut[1:], len(order)).tolist()):
        own = order[a:b]
        yield int(bucket[own[0]]), tuple(x[own] for x in arrays)


# -- step 2: repeated anchors


def _portions(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches of a task by some ``limit`` bytes of text."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(1).nbytes
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def _anchor_entries(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for portion in _portions(batches, FLUSH_BYTES):
            yield from entries(portion)

    def entries(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        H, R, docs, ths, homes, base = [], [], [], [], [], 0
        for batch in batches:
            data, off = c.text_buffers(batch.column(1))
            doc, th, home = _columns(batch)
            for part, offsets, rows, _ in stretches(data, off):
                a, _, _, h = anchors(part, offsets)
                H.append(h)
                R.append(rows[np.searchsorted(offsets, a, "right") - 1].astype(np.int32) + np.int32(base))
            docs.append(doc), ths.append(th), homes.append(home)
            base += len(doc)
        if not base:
            return
        h, row = (np.concatenate(H), np.concatenate(R)) if H else (np.zeros(0, np.uint64), np.zeros(0, np.int32))
        doc, th, home = np.concatenate(docs), np.concatenate(ths), np.concatenate(homes)
        del H, R
        # one entry for an anchor and text: that of the smallest id
        rank = np.empty(base, np.int32)  # by text, then id
        rank[np.lexsort((doc, th))] = np.arange(base, dtype=np.int32)
        back = np.argsort(rank)
        order = np.lexsort((rank[row], h))
        h, row = h[order], row[order]
        text = th[row]
        keep = _first(h, text)
        h, row, text = h[keep], row[keep], text[keep]
        del back, rank, order
        group = np.cumsum(_first(h)) - 1
        several = np.bincount(group)[group] > 1
        # anchors that this task has seen in several texts are known to be repeated
        known = np.flatnonzero(several)
        keys = _reply_key(_uid(doc, th)[row[known]], h[known])
        out: list[tuple[int, int, int, bytes]] = [(b % buckets, 1, b, _zip(x)) for b, (x,) in _rows("known", home[row[known]], keys)]
        # they are sent once for a bucket of blocks, with their number
        order = known[np.lexsort((home[row[known]], h[known]))]
        new = _first(h[order], home[row[order]])
        number = np.zeros(len(h), np.uint32)
        number[order[new]] = np.diff(np.append(np.flatnonzero(new), len(order)))
        send = np.flatnonzero(~several | (number > 0))
        bucket = ((h[send] >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
        for b, (hh, rr, mark) in _rows("entries", bucket, h[send], row[send], number[send]):
            used, index = np.unique(rr, return_inverse=True)
            index = index.astype(np.uint32)
            o = np.argsort(index, kind="stable")
            head = np.array([len(used), len(o)], np.int64)
            out.append((b, 0, 0, _zip(head, doc[used], th[used], home[used], index[o], (hh[o] & np.uint64(0xFFFFFFFF)).astype(np.uint32), ((hh[o] >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8), mark[o])))
        for i in range(0, len(out), 64):
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out[i : i + 64]], pa.int32()), pa.array([x[1] for x in out[i : i + 64]], pa.int32()), pa.array([x[2] for x in out[i : i + 64]], pa.int32()), pa.array([x[3] for x in out[i : i + 64]], pa.binary())], names=["bucket", "kind", "home", "blob"])

    return run


def _read_entries(blob: bytes) -> tuple[np.ndarray, ...]:
    raw = _unzip(blob)
    n_docs, n = np.frombuffer(raw, np.int64, 2).tolist()
    at, out = 16, []
    for dtype, size in (("<i8", n_docs), ("<u8", n_docs), ("<i4", n_docs), ("<u4", n), ("<u4", n), ("u1", n), ("<u4", n)):
        out.append(np.frombuffer(raw, dtype, size, at))
        at += out[-1].nbytes
    doc, th, home, index, low, high, mark = out
    return low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32), doc[index], th[index], home[index], mark


def _repeated(most: int):
    """Reports (home, keys) about anchors that occur in different texts; those in more than ``most`` texts are marked hot for each bucket of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            passed = [k for k, x in enumerate(batch.column(1).to_pylist()) if x == 1]
            if passed:
                yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(passed)), batch.column(3).take(pa.array(passed))], names=["home", "blob"])
            parts += [_read_entries(blob) for kind, blob in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()) if kind == 0]
        if not parts:
            return
        h, doc, th, home, mark = (np.concatenate([p[k] for p in parts]) for k in range(5))
        del parts
        order = np.lexsort((th, h))
        h, doc, th, home, mark = h[order], doc[order], th[order], home[order], mark[order]
        new = _first(h)
        group = np.cumsum(new) - 1
        texts = np.bincount(group, _first(h, th).astype(float))
        marked = np.bincount(group, mark.astype(float))
        wanted = ((texts[group] > 1) | (marked[group] > 0)) & (mark == 0)
        hot = (np.bincount(group, np.maximum(mark, 1).astype(float))[group] > most) & ((texts[group] > 1) | (marked[group] > 0))
        keys = np.concatenate([_reply_key(_uid(doc[wanted], th[wanted]), h[wanted]), _hot_key(home[hot], h[hot])])
        rows = [(b, _zip(x)) for b, (x,) in _rows("reports", np.concatenate([home[wanted], home[hot]]), keys)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["home", "blob"])

    return run


def _to_files(reports: DataFrame, buckets: int, root: str, dtype: np.dtype, by: str | None) -> None:
    """Gather reports (home, blob) into one sorted array file per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        home = -1
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                home = b
                parts.append(np.frombuffer(_unzip(blob), dtype))
        if parts:
            values = np.unique(np.concatenate(parts)) if by is None else np.concatenate(parts)
            if by is not None:
                values = values[np.argsort(values[by], kind="stable")]
            c.save_array(f"{root}/{home:06d}", values)
            yield pa.RecordBatch.from_arrays([pa.array([home], pa.int32())], names=["home"])

    reports.repartitionById(buckets, "home").mapInArrow(run, "home int").count()


class _Files:
    """The bucket files of a step, opened as they are needed."""

    def __init__(self, root: str, dtype: np.dtype):
        self.root, self.dtype, self.open = root, dtype, {}

    def get(self, bucket: int) -> np.ndarray:
        if bucket not in self.open:
            if len(self.open) > 16:
                self.open.clear()
            fs, path = c.open_fs(f"{self.root}/{bucket:06d}")
            there = fs.get_file_info(path).type.name == "File"
            self.open[bucket] = c.load_array(f"{self.root}/{bucket:06d}", self.dtype) if there else np.zeros(0, self.dtype)
        return self.open[bucket]


def _among(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key is in the sorted table."""
    if not len(table) or not len(keys):
        return np.zeros(len(keys), bool)
    return table[np.minimum(np.searchsorted(table, keys), len(table) - 1)] == keys


# -- step 3: contents


def _content_hash(content: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    flat = content.reshape(-1)
    starts = np.arange(len(content)) * WIDTH
    out = np.empty(len(content), np.uint64)
    for i in range(0, len(content), 1 << 14):
        j = min(len(content), i + (1 << 14))
        out[i:j] = c.span_hash(c.prefix_hash(flat[i * WIDTH : j * WIDTH]), starts[i:j] - i * WIDTH, starts[i:j] + WIDTH - i * WIDTH)
    return c.mix64(out ^ (lo.astype(np.uint64) << np.uint64(8)) ^ hi.astype(np.uint64))


def _cover(doc: np.ndarray, pos: np.ndarray, first: np.ndarray, last: np.ndarray, th: np.ndarray) -> np.ndarray:
    out = np.empty(len(doc), RANGE)
    out["uid"], out["start"], out["end"] = _uid(doc, th), pos + first, pos + last + LEAST
    return out


def _content_entries(root: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(root, np.dtype("<u8"))
        for batch in batches:
            data, off = c.text_buffers(batch.column(1))
            doc, th, home = _columns(batch)
            uid, found = _uid(doc, th), []
            for part, offsets, rows, at in stretches(data, off):
                a, lo, hi, h = anchors(part, offsets)
                local = np.searchsorted(offsets, a, "right") - 1
                row = rows[local]
                keys = _reply_key(uid[row], h)
                state = np.zeros(len(a), np.uint8)
                for b in np.unique(home[rows]).tolist():
                    own = np.flatnonzero(home[row] == b)
                    table = files.get(b)
                    own = own[_among(table, keys[own])]
                    state[own] = 1
                    state[own[_among(table, _hot_key(home[row[own]], h[own]))]] = 2
                pick = np.flatnonzero(state)
                if not len(pick):
                    continue
                a, lo, hi, h, row, hot = a[pick], lo[pick], hi[pick], h[pick], row[pick], state[pick] == 2
                if hot.any():  # one entry for a window, under the hash of the window
                    n = np.where(hot, hi - lo + 1, 1)
                    k = np.repeat(np.arange(len(a)), n)
                    step = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
                    a, lo, hi, h, row, hot = a[k], lo[k] + np.where(hot[k], step, 0), hi[k], h[k], row[k], hot[k]
                    hi = np.where(hot, lo, hi)
                    prefix = c.prefix_hash(part)
                    h = np.where(hot, c.span_hash(prefix, lo, np.minimum(lo + LEAST, len(part))), h)
                e = np.empty(len(a), ENTRY)
                begin = np.where(hot, lo, a - LEFT)  # where the content begins
                e["key"], e["doc"], e["th"], e["bucket"] = h, doc[row], th[row], home[row]
                e["pos"] = begin - offsets[local[pick][k] if hot.any() else local[pick]] + at
                e["lo"], e["hi"] = lo - begin, hi - begin
                place = begin[:, None] + np.arange(WIDTH)
                inside = (place >= lo[:, None]) & (place < (hi + LEAST)[:, None])
                e["content"] = np.where(inside, part[np.clip(place, 0, len(part) - 1)], 0)
                found.append(e)
            if not found:
                continue
            e = np.concatenate(found)
            del found
            # equal contents of this batch: all but the smallest id are settled here
            ch = _content_hash(e["content"], e["lo"], e["hi"])
            order = np.lexsort((e["doc"], ch, e["key"]))
            e, ch = e[order], ch[order]
            new = _first(e["key"], ch)
            lead = np.flatnonzero(new)[np.cumsum(new) - 1]
            same = (e["content"] == e["content"][lead]).all(1)
            done = same & (e["doc"] > e["doc"][lead])
            ranges = _cover(e["doc"][done], e["pos"][done], e["lo"][done].astype(np.int64), e["hi"][done].astype(np.int64), e["th"][done])
            out = [(b % buckets, 1, b, _zip(x)) for b, (x,) in _rows("ranges", e["bucket"][done], ranges)]
            e = e[~done]
            bucket = ((e["key"] >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
            out += [(b, 0, 0, _zip(x)) for b, (x,) in _rows("contents", bucket, e)]
            for i in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out[i : i + 64]], pa.int32()), pa.array([x[1] for x in out[i : i + 64]], pa.int32()), pa.array([x[2] for x in out[i : i + 64]], pa.int32()), pa.array([x[3] for x in out[i : i + 64]], pa.binary())], names=["bucket", "kind", "home", "blob"])

    return run


def shared_windows(texts: list[bytes], ids: list[int]) -> list[list[int]]:
    """For each text, the starts of its windows that also occur in a text with a smaller id; by a suffix array."""
    joined: list[int] = []
    owner: list[int] = []
    begin: list[int] = []
    for k, t in enumerate(texts):
        begin.append(len(joined))
        joined += t
        joined.append(256)
        owner += [k] * (len(t) + 1)
    whole = b"\0".join(texts)
    out: list[list[int]] = [[] for _ in texts]
    group: list[int] = []
    current = None

    def close() -> None:
        if len(group) > 1:
            least = min(ids[owner[p]] for p in group)
            for p in group:
                if ids[owner[p]] > least:
                    out[owner[p]].append(p - begin[owner[p]])

    for p in suffix_array(joined):
        k = owner[p]
        if p - begin[k] + LEAST > len(texts[k]):
            continue
        window = whole[p : p + LEAST]
        if window != current:
            close()
            current, group = window, []
        group.append(p)
    close()
    return out


def _narrow(content: np.ndarray, group: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
    """Cut first and last, where there are any, down to windows that another content of the key has at the same place.

    Equal windows have their anchor at the same place, so no other windows can be equal; contents
    that share one passage become one string, which needs no suffix array.
    """
    rows = np.flatnonzero(last >= 0)
    begin = 0
    while begin < len(rows):
        end = min(len(rows), begin + (1 << 14))
        if end < len(rows):  # whole keys only
            end = int(np.searchsorted(group[rows], group[rows[end - 1]], "right"))
        sub = rows[begin:end]
        begin = end
        prefix = c.prefix_hash(content[sub].reshape(-1))
        base, lo, hi = np.arange(len(sub)) * WIDTH, first[sub], last[sub]
        low, high = np.full(len(sub), 255, np.int64), np.full(len(sub), -1, np.int64)
        for t in range(int(lo.min()), int(hi.max()) + 1):
            has = np.flatnonzero((lo <= t) & (t <= hi))
            if not len(has):
                continue
            window, g = c.span_hash(prefix, base[has] + t, base[has] + t + LEAST), group[sub[has]]
            o = np.lexsort((window, g))
            number = np.cumsum(_first(g[o], window[o])) - 1
            hit = has[o[np.bincount(number)[number] > 1]]
            low[hit] = np.minimum(low[hit], t)
            high[hit] = t
        first[sub], last[sub] = low, high


def _settle(e: np.ndarray) -> np.ndarray:
    """Ranges of the entries' windows that occur in documents with smaller ids."""
    ch = _content_hash(e["content"], e["lo"], e["hi"])
    order = np.lexsort((e["doc"], ch, e["key"]))
    e, ch = e[order], ch[order]
    # keys of one document only can't matter
    new = _first(e["key"])
    at = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    mixed = np.minimum.reduceat(e["doc"], at) != np.maximum.reduceat(e["doc"], at)
    keep = mixed[group]
    e, ch = e[keep], ch[keep]
    if not len(e):
        return np.zeros(0, RANGE)
    new = _first(e["key"], ch)
    lead = np.flatnonzero(new)
    own = np.cumsum(new) - 1
    if not (e["content"] == e["content"][lead[own]]).all():  # unequal contents with one hash: settle them by their bytes
        order = np.lexsort((e["doc"], e["hi"], e["lo"], e["content"].view(f"S{WIDTH}").ravel(), e["key"]))
        e = e[order]
        new = _first(e["key"], e["lo"], e["hi"])
        new[1:] |= (e["content"][1:] != e["content"][:-1]).any(1)
        lead = np.flatnonzero(new)
        own = np.cumsum(new) - 1
    least = e["doc"][lead]  # smallest id of each content, as ids are in order
    later = e["doc"] > least[own]
    out = [_cover(e["doc"][later], e["pos"][later], e["lo"][later].astype(np.int64), e["hi"][later].astype(np.int64), e["th"][later])]
    # different contents of one key: which windows have a core in common?
    d = e[lead]
    new = _first(d["key"])
    group = np.cumsum(new) - 1
    several = np.flatnonzero(np.bincount(group)[group] > 1)
    if not len(several):
        return np.concatenate(out)
    n_classes = -(-SPAN // CLASS)
    first = np.full(len(d), 255, np.int64)
    last = np.full(len(d), -1, np.int64)
    for i in range(0, len(several), 1 << 14):
        sub = several[i : i + (1 << 14)]
        # whole keys only
        if i and group[sub[0]] == group[several[i - 1]]:
            sub = sub[np.searchsorted(group[sub], group[sub[0]], "right") :]
        tail = several[i + (1 << 14) :]
        if len(tail) and len(sub):
            sub = np.concatenate([sub, tail[: np.searchsorted(group[tail], group[sub[-1]], "right")]])
        if not len(sub):
            continue
        prefix = c.prefix_hash(d["content"][sub].reshape(-1))
        base = np.arange(len(sub)) * WIDTH
        lo, hi = d["lo"][sub].astype(np.int64), d["hi"][sub].astype(np.int64)
        for t in range(n_classes):
            a, b = t * CLASS, min(t * CLASS + CLASS - 1, SPAN - 1)
            has = np.flatnonzero((lo <= b) & (hi >= a))
            if not len(has):
                continue
            core = c.span_hash(prefix, base[has] + b, base[has] + a + LEAST)
            o = np.lexsort((core, group[sub[has]]))
            g, x = group[sub[has]][o], core[o]
            new = _first(g, x)
            shared = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] > 1
            hit = has[o[shared]]
            first[sub[hit]] = np.minimum(first[sub[hit]], np.maximum(a, lo[hit]))
            last[sub[hit]] = np.maximum(last[sub[hit]], np.minimum(b, hi[hit]))
    _narrow(d["content"], group, first, last)
    open_ = np.flatnonzero(last >= 0)
    if not len(open_):
        return np.concatenate(out)
    cut = np.flatnonzero(_first(group[open_]))
    rows: list[int] = []
    spans: list[tuple[int, int]] = []
    for x, y in zip(cut.tolist(), np.append(cut[1:], len(open_)).tolist()):
        own_rows = open_[x:y].tolist()
        ids = [int(least[r]) for r in own_rows]
        if y - x < 2 or min(ids) == max(ids):
            continue
        texts: dict[bytes, int] = {}
        of = []
        for r, doc in zip(own_rows, ids):
            t = d["content"][r, first[r] : last[r] + LEAST].tobytes()
            texts[t] = min(doc, texts.get(t, doc))
            of.append(t)
        names = list(texts)
        best = [texts[t] for t in names]
        found = dict(zip(names, shared_windows(names, best))) if len(names) > 1 else {names[0]: []}
        for r, doc, t in zip(own_rows, ids, of):
            if doc > texts[t]:  # the same string in a smaller document
                rows.append(r)
                spans.append((int(first[r]), int(last[r])))
            else:
                run: list[int] = []  # neighbouring windows make one range
                for x in sorted(found[t]):
                    if run and x == run[-1] + 1:
                        run[-1] = x
                    else:
                        run += [x, x]
                for x, y in zip(run[::2], run[1::2]):
                    rows.append(r)
                    spans.append((int(first[r]) + x, int(first[r]) + y))
    if rows:
        # a content's windows hold for every entry of its smallest document; those stand first
        at, span = np.array(rows), np.array(spans, np.int64)
        smallest = np.bincount(own, e["doc"] == least[own]).astype(np.int64)[at]
        k = np.repeat(np.arange(len(at)), smallest)
        entry = lead[at[k]] + np.arange(len(k)) - np.repeat(np.cumsum(smallest) - smallest, smallest)
        x = e[entry]
        out.append(_cover(x["doc"], x["pos"], span[k, 0], span[k, 1], x["th"]))
    return np.concatenate(out)


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = []
    for batch in batches:
        kinds = batch.column(1).to_pylist()
        passed = [k for k, x in enumerate(kinds) if x == 1]
        if passed:
            yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(passed)), batch.column(3).take(pa.array(passed))], names=["home", "blob"])
        parts += [np.frombuffer(_unzip(b), ENTRY) for k, b in zip(kinds, batch.column(3).to_pylist()) if k == 0]
    if not parts:
        return
    e = np.concatenate(parts)
    del parts
    homes = {}
    uid = _uid(np.ascontiguousarray(e["doc"]), np.ascontiguousarray(e["th"]))
    o = np.argsort(uid, kind="stable")
    f = _first(uid[o])
    homes = (uid[o][f], e["bucket"][o][f])
    ranges = _settle(e)
    if len(ranges):
        rows = [(b, _zip(x)) for b, (x,) in _rows("ranges", homes[1][np.searchsorted(homes[0], ranges["uid"])], ranges)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["home", "blob"])


# -- step 4: removal


def _whole_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of whole texts, for rows (doc_id, th, n_bytes, home)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        doc = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
        th = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        out = np.empty(len(doc), RANGE)
        out["uid"], out["start"], out["end"] = _uid(doc, th), 0, batch.column(2).to_numpy(zero_copy_only=False)
        rows = [(b, _zip(x)) for b, (x,) in _rows("copies", batch.column(3).to_numpy(zero_copy_only=False).astype(np.int32), out)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["home", "blob"])


def merged(ranges: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union of the ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(ranges["start"].tolist(), ranges["end"].tolist())):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _strip(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(root, RANGE)
        for batch in batches:
            data, off = c.text_buffers(batch.column(1))
            doc, th, home = _columns(batch)
            uid, n = _uid(doc, th), len(doc)
            removed, spans, shas = np.zeros(n, np.int64), np.zeros(n, np.int64), []
            for r in range(n):
                table = files.get(int(home[r]))
                raw = data[off[r] : off[r + 1]]
                a, b = np.searchsorted(table["uid"], uid[r], "left"), np.searchsorted(table["uid"], uid[r], "right")
                digest = hashlib.sha256()
                at = 0
                if b > a:
                    runs = merged(table[a:b])
                    spans[r] = len(runs)
                    for x, y in runs:
                        removed[r] += y - x
                        digest.update(raw[at:x])
                        at = y
                digest.update(raw[at:])
                shas.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(np.diff(off)), pa.array(removed), pa.array(spans), pa.array(shas, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def next_prime(n: int) -> int:
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def remove_repeats(docs: DataFrame, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: bytes, removed bytes, removed runs, SHA-256 of what is kept."""
    spark = docs.sparkSession
    place = docs if c.from_files(docs) else c.materialize(c.keyed(docs, id_col, text_col), "texts")
    size = place.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")).cast("bigint"))).first()[0] or 0
    buckets = next_prime(max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES))
    block = F.xxhash64(F.col("_metadata.file_path"), F.shiftright(F.col("_metadata.row_index"), 12))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = place.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"), F.pmod(block, F.lit(buckets)).cast("int").alias("home"))

    blobs = "bucket int, kind int, home int, blob binary"
    reports = rows.mapInArrow(_anchor_entries(buckets), blobs).repartitionById(buckets, "bucket").mapInArrow(_repeated(hot), "home int, blob binary")
    repeated = c.scratch(spark, "anchors")
    _to_files(reports, buckets, repeated, np.dtype("<u8"), None)

    # whole copies: ids are compared with the smallest of the same text, over salts
    heads = c.materialize(rows.select("doc_id", "th", F.octet_length("text").cast("bigint").alias("n_bytes"), "home", F.sha2("text", 256).alias("sha")), "heads")
    copies = heads.where(f"n_bytes >= {LEAST}").groupBy("sha").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("least"), F.count("*").alias("size")).where("size > 1").select("sha", "least")
    salt = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(16)).cast("int")
    copies = copies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    whole = heads.withColumn("salt", salt).join(copies, ["sha", "salt"]).where(F.coalesce("doc_id", F.lit(NO_ID)) > F.col("least")).select("doc_id", "th", "n_bytes", "home").mapInArrow(_whole_copies, "home int, blob binary")

    ranges = rows.mapInArrow(_content_entries(repeated, buckets), blobs).repartitionById(buckets, "bucket").mapInArrow(_settled, "home int, blob binary")
    covered = c.scratch(spark, "ranges")
    _to_files(ranges.unionByName(whole), buckets, covered, RANGE, "uid")
    return rows.mapInArrow(_strip(covered), SCHEMA)
