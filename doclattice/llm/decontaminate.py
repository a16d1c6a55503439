"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The alphabet is the word: a pattern is a window of ``window`` consecutive item words
(an item of fewer words is one shorter pattern). Patterns of one length form a group
with its own tables:

* SHIFT, indexed by a hash of a block of two words, says how far the search may move
  on when that block ends at the current place; most blocks of a document occur in no
  pattern, so the search looks at about one word in nine for windows of ten.
* where SHIFT is zero, the bucket of the suffix block's hash and that of the words before
  it selects the test strings: a binary search finds those of both, so a suffix that very
  many patterns share costs no more than another;
* direct comparison of the words' bytes confirms an occurrence.

Many places of many documents are advanced together, one numpy call for a step of all
of them. Executors cut the items into windows, spread them over blocks of bounded size by
their hash and write each block's tables as arrays to the shared folder, where workers
memory map them; no table is built anew for a document, and the driver sees none. Every
document is held against every block: words are found once, then block after block is
searched in all texts of a batch.

Defined results: null, empty and wordless texts have no words and are clean; items
without words are ignored; equal windows of several items count for each of them;
repeated rows are judged alike, row by row; extra columns are ignored by ``report`` and
kept by ``drop_contaminated``; empty tables give empty results or clean documents; a very
long text is handled whole, by itself, in some 40 bytes of memory for each of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

SCHEMA = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items array<string>, items_sha256 string, contaminated boolean, spans array<struct<start:bigint,end:bigint>>"
#: About as many bytes of windows has one block of tables.
BLOCK_BYTES = 32 << 20
#: Bits of the SHIFT table: this many at least, and more for groups of many patterns.
SHIFT_BITS = 18


def item_windows(text: str | None, window: int) -> list[bytes]:
    """Windows of an item: its words joined by single blanks; a short item is one window."""
    data = np.frombuffer((text or "").encode().translate(c.LOWER.tobytes()), np.uint8)
    starts, ends, _ = c.word_spans(data, np.array([0, len(data)]), c.NOT_ALNUM)
    raw = data.tobytes()
    words = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
    if not words:
        return []
    return [b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


def _block_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return c.mix64(a * np.uint64(0xD6E8FEB86659FD93) + b)


class Group:
    """Mapped tables for the patterns of one length in words."""

    ARRAYS = {"shift": "i4", "keys": "u8", "order": "i8", "starts": "i8", "blob": "u1", "owners": "i8", "names": "i8", "items": "u1"}

    def __init__(self, length: int, arrays: dict[str, np.ndarray]):
        self.length, self.block = length, min(2, length)
        for name in self.ARRAYS:
            setattr(self, name, arrays[name])
        self.bits = int(len(self.shift)).bit_length() - 1

    @classmethod
    def build(cls, length: int, patterns: list[bytes], items: list[list[str]]) -> "Group":
        """Tables for distinct patterns and the items that each of them comes from."""
        blob = np.frombuffer(b"\n".join(patterns), np.uint8)
        starts, ends, _ = c.word_spans(blob, np.array([0, len(blob)]), c.separators((10, 10), (32, 32)))
        words = c.span_hash(c.prefix_hash(blob), starts, ends).reshape(len(patterns), length)
        bits = min(26, max(SHIFT_BITS, (8 * len(patterns)).bit_length()))
        own = cls(length, dict.fromkeys(cls.ARRAYS, np.zeros(1 << bits, np.int32)))
        shift = np.full(1 << bits, length - own.block + 1, np.int32)
        for at in range(own.block - 1, length):  # the block that ends at word `at`
            np.minimum.at(shift, own._slot(own._suffix(words[:, : at + 1])), length - 1 - at)
        keys = own._key(words)
        order = np.argsort(keys, kind="stable")
        raw = [x.encode() for own_items in items for x in own_items]
        own.shift, own.keys, own.order, own.blob = shift, keys[order], order, blob
        own.starts = np.concatenate([[0], np.cumsum([len(p) + 1 for p in patterns])])
        own.owners = np.concatenate([[0], np.cumsum([len(x) for x in items])])
        own.names = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        own.items = np.frombuffer(b"".join(raw), np.uint8)
        return own

    def save(self, root: str) -> None:
        for name, dtype in self.ARRAYS.items():
            c.save_array(f"{root}/{name}", getattr(self, name).astype(dtype))

    @classmethod
    def load(cls, root: str, length: int) -> "Group":
        return cls(length, {name: c.load_array(f"{root}/{name}", dtype) for name, dtype in cls.ARRAYS.items()})

    def pattern(self, k: int) -> bytes:
        return self.blob[int(self.starts[k]) : int(self.starts[k + 1]) - 1].tobytes()

    def items_of(self, k: int) -> list[str]:
        own = range(int(self.owners[k]), int(self.owners[k + 1]))
        return [self.items[int(self.names[i]) : int(self.names[i + 1])].tobytes().decode() for i in own]

    def _suffix(self, words: np.ndarray) -> np.ndarray:
        """Hash of the last block of each row of words."""
        return _block_hash(words[:, -2], words[:, -1]) if self.block == 2 else words[:, -1]

    def _key(self, words: np.ndarray) -> np.ndarray:
        """Bucket of each row of words: its suffix block, then what stands before it."""
        out = self._suffix(words)
        for k in range(self.length - self.block - 1, -1, -1):
            out = _block_hash(out, words[:, k])
        return out

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def candidates(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, pattern) pairs to compare; ``first`` has each row's first word and the end."""
        m, none = self.length, np.zeros(0, np.int64)
        lo, hi = first[:-1], first[1:]
        # lanes: stretches of at most 1024 end positions, so that long rows take no more steps than others
        room = hi - lo - m + 1
        keep = room > 0
        lo, room = lo[keep], room[keep]
        if not len(lo):
            return none, none
        parts = -(-room // 1024)
        lane = np.repeat(np.arange(len(lo)), parts)
        k = np.arange(len(lane)) - np.repeat(np.cumsum(parts) - parts, parts)
        pos = lo[lane] + k * 1024 + m - 1
        stop = np.minimum(pos + 1024, lo[lane] + room[lane] + m - 1)
        found = []
        while len(pos):
            h = _block_hash(words[pos - 1], words[pos]) if self.block == 2 else words[pos]
            s = self.shift[self._slot(h)].astype(np.int64)
            zero = s == 0
            if zero.any():
                found.append(pos[zero])
            pos = pos + np.maximum(s, 1)
            on = pos < stop
            pos, stop = pos[on], stop[on]
        if not found:
            return none, none
        at = np.concatenate(found) - (m - 1)
        key = self._key(words[at[:, None] + np.arange(m)])
        a, b = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        n = b - a
        at, entry = np.repeat(at, n), np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return at, np.asarray(self.order[entry])


def store_patterns(benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES, id_col: str = "item_id", text_col: str = "text") -> list[tuple[str, int]]:
    """Write the tables for the windows of all items, in blocks, on the executors; returns places and lengths."""
    spark = benchmark.sparkSession
    own = c.keyed(benchmark, id_col, text_col).toDF("item", "text").select(F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item"), "text")
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) * window // block_bytes))
    root = c.scratch(spark, "patterns")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for k, item in enumerate(ids):
                own = sorted(set(item_windows(texts[k].as_py(), window)))
                for i in range(0, len(own), 4096):
                    part = own[i : i + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array([w.count(b" ") + 1 for w in part], pa.int32()), pa.array(part, pa.binary()), pa.array([item] * len(part), pa.string())], names=["length", "pattern", "item"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, int] | None = None
        patterns: list[bytes] = []
        items: list[list[str]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held is not None:
                place = f"{root}/{held[0]:06d}-{held[1]:04d}"
                Group.build(held[1], patterns, items).save(place)
                yield pa.RecordBatch.from_arrays([pa.array([place]), pa.array([held[1]], pa.int32())], names=["place", "length"])

        for batch in batches:
            for block, length, pattern, item in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if (block, length) != held:
                    yield from flush()
                    held, patterns, items = (block, length), [], []
                if not patterns or patterns[-1] != pattern:
                    patterns.append(pattern)
                    items.append([])
                items[-1].append(item)
        yield from flush()

    windows = own.mapInArrow(cut, "length int, pattern binary, item string").distinct()
    spread = windows.select(F.pmod(F.xxhash64("pattern"), F.lit(blocks)).cast("int").alias("block"), "length", "pattern", "item").repartition(blocks, "block").sortWithinPartitions("block", "length", "pattern", "item")
    return sorted((r[0], r[1]) for r in spread.mapInArrow(build, "place string, length int").collect())


class Found:
    """Words of some texts, and what is found in them: hit flags by word, items by row."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        data = np.frombuffer(data.tobytes().translate(c.LOWER.tobytes()), np.uint8)
        self.starts, self.ends, self.first = c.word_spans(data, off, c.NOT_ALNUM)
        self.words = c.span_hash(c.prefix_hash(data), self.starts, self.ends) if len(self.starts) else np.zeros(0, np.uint64)
        self.raw = data.tobytes()
        self.items: list[set[str]] = [set() for _ in range(len(off) - 1)]
        self.edge = np.zeros(len(self.starts) + 1, np.int32)

    def search(self, group: Group) -> None:
        if not len(self.words):
            return
        at, pattern = group.candidates(self.words, self.first)
        if not len(at):
            return
        m, good = group.length, []
        for p, k in zip(at.tolist(), pattern.tolist()):
            good.append(b" ".join([self.raw[a:b] for a, b in zip(self.starts[p : p + m].tolist(), self.ends[p : p + m].tolist())]) == group.pattern(k))
        sel = np.array(good, bool)
        at, pattern = at[sel], pattern[sel]
        np.add.at(self.edge, at, 1)
        np.add.at(self.edge, at + m, -1)
        for r, k in zip((np.searchsorted(self.first, at, "right") - 1).tolist(), pattern.tolist()):
            self.items[r].update(group.items_of(k))

    def hit(self) -> np.ndarray:
        return np.cumsum(self.edge[:-1]) > 0


def search_batch(batch: pa.RecordBatch, column: int, places: list[tuple[str, int]]) -> Iterator[tuple[int, int, np.ndarray, Found]]:
    """(first row, last row, offsets, what is found) for bounded parts of a batch; each block of tables is opened once."""
    parts = [(i, j, off, Found(data, off)) for i, j, data, off in c.text_chunks(batch, column)]
    for place, length in places:
        group = Group.load(place, length)
        for _, _, _, found in parts:
            found.search(group)
    yield from parts


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: words, words inside any benchmark window, items, spans of hit words (byte offsets)."""
    places = store_patterns(benchmark, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            ids = batch.column(0)
            for i, j, off, found in search_batch(batch, 1, places):
                starts, ends, first, items, hit = found.starts, found.ends, found.first, found.items, found.hit()
                total = np.concatenate([[0], np.cumsum(hit)])
                n_hit = total[first[1:]] - total[first[:-1]]
                names, shas, spans = [], [], []
                for r in range(j - i):
                    got = sorted(items[r])
                    names.append(got)
                    shas.append(hashlib.sha256(",".join(got).encode()).hexdigest() if got else none)
                    own = []
                    if n_hit[r]:
                        a, b = first[r], first[r + 1]
                        x = np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]]))
                        own = [{"start": int(starts[a + s] - off[r]), "end": int(ends[a + e - 1] - off[r])} for s, e in zip(np.flatnonzero(x == 1), np.flatnonzero(x == -1))]
                    spans.append(own)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i).cast(pa.int64()), pa.array(first[1:] - first[:-1]), pa.array(n_hit.astype(np.int64)), pa.array([len(x) for x in names], pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(shas, pa.string()), pa.array(n_hit > 0), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    names=["doc_id", "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated", "spans"],
                )

    return c.keyed(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` but those whose text holds a benchmark window; one pass, no shuffle."""
    places = store_patterns(benchmark, window)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for i, j, _, found in search_batch(batch, at, places):
                first, total = found.first, np.concatenate([[0], np.cumsum(found.hit())])
                keep[i:j] = total[first[1:]] == total[first[:-1]]
            yield batch.filter(pa.array(keep))

    return c.map_rows(docs, run)
