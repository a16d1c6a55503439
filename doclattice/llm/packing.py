"""Best-fit packing by minimum bin slack.

Documents are encoded, ended with an id, and cut only where they are longer than a
sequence (the first piece takes the remainder). For one bin after another, a bitset
subset-sum dynamic program over the lengths at hand, with their multiplicities, finds the
fullest combination that goes with the longest piece left; it is removed, as often at once
as the pieces allow, and the next bin is filled. The program sees a histogram of lengths
(at most ``capacity`` entries), never the pieces.

Packing is done where the pieces are: each task packs its own rows, encoded in the same
pass, and keeps the bins that are full. Pieces that fill no bin among those of their task,
however many they are, are counted by length; the histogram of all tasks (at most
``capacity`` counters) is planned as one packing, and a piece finds its bin by its rank
among the pieces of its length. So no bin is closed with room left before all pieces are
known, and no task or driver holds more than its own pieces and the plan.

Defined results: null and empty texts are documents of the end id alone; repeated rows
are packed each for itself; very long texts are cut into as many pieces as they need;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c
from .encode import encoder

SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
_LEVEL = SCHEMA + ", part int, place bigint"
#: Tasks that place what fills no bin of its own task get about FAN_IN * CARRY pieces.
CARRY = 4096
FAN_IN = 64


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The combination with the longest length that leaves least slack: length -> how many."""
    lengths = sorted((x for x, n in counts.items() if n > 0), reverse=True)
    seed = lengths[0]
    room = capacity - seed
    mask = (1 << (room + 1)) - 1
    bits, steps = 1, []
    for x in lengths:
        if x > room:
            continue
        left = min(counts[x] - (x == seed), room // x)
        part = 1
        while left > 0 and not bits >> room & 1:
            take = min(part, left)
            grown = (bits | bits << (x * take)) & mask
            if grown != bits:
                steps.append((x, take, bits))
                bits = grown
            left -= take
            part *= 2
        if bits >> room & 1:
            break
    at, chosen = bits.bit_length() - 1, {seed: 1}
    for x, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[x] = chosen.get(x, 0) + take
            at -= x * take
    return chosen


def plan(counts: dict[int, int], capacity: int, full_only: bool = False) -> Iterator[tuple[dict[int, int], int]]:
    """Combinations and how many bins get each; ``full_only`` leaves out the pieces that fill no bin."""
    counts = {x: n for x, n in counts.items() if n > 0}
    while counts:
        chosen = fullest(counts, capacity)
        if full_only and sum(x * k for x, k in chosen.items()) < capacity:
            del counts[max(counts)]  # fewer pieces later fill no bin either
            continue
        times = min(counts[x] // k for x, k in chosen.items())
        yield chosen, times
        for x, k in chosen.items():
            counts[x] -= k * times
            if not counts[x]:
                del counts[x]


def fill(lengths: np.ndarray, capacity: int, full_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place of every piece; with ``full_only`` bin -1 for pieces that fill none."""
    n = len(lengths)
    bins, places = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    order = np.argsort(lengths, kind="stable")
    values, first, number = np.unique(lengths[order], return_index=True, return_counts=True)
    at = dict(zip(values.tolist(), first.tolist()))
    next_bin = 0
    for chosen, times in plan(dict(zip(values.tolist(), number.tolist())), capacity, full_only):
        ids, place = next_bin + np.arange(times), 0
        for x, k in chosen.items():
            for _ in range(k):
                own = order[at[x] : at[x] + times]
                bins[own], places[own] = ids, place
                at[x] += times
                place += x
        next_bin += times
    return bins, places


def _ranks(values: np.ndarray) -> np.ndarray:
    """Number of each entry among the equal ones."""
    order = np.argsort(values, kind="stable")
    _, first, number = np.unique(values[order], return_index=True, return_counts=True)
    out = np.zeros(len(values), np.int64)
    out[order] = np.arange(len(values)) - np.repeat(first, number)
    return out


def _layout(counts: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """The plan of all pieces, by length: rows (first rank, bins, first bin, place of the first copy)."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    at = dict.fromkeys(counts, 0)
    next_bin = 0
    for chosen, times in plan(counts, capacity):
        place = 0
        for x, k in chosen.items():
            rows.setdefault(x, []).append((at[x], times, next_bin, place))
            at[x] += k * times
            place += k * x
        next_bin += times
    return {x: np.array(r, np.int64) for x, r in rows.items()}


def _look_up(layout: dict[int, np.ndarray], lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place of pieces by length and rank."""
    bins, places = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(lengths, kind="stable")
    values, first = np.unique(lengths[order], return_index=True)
    for x, own in zip(values.tolist(), np.split(order, first[1:])):
        rows = layout[x]
        start, times, base, place = rows[np.searchsorted(rows[:, 0], ranks[own], "right") - 1].T
        copy, number = np.divmod(ranks[own] - start, times)
        bins[own], places[own] = base + number, place + copy * x
    return bins, places


def _cut(ids: list[int | None], tokens: list[bytes], dtype: np.dtype, end: int, capacity: int) -> list[np.ndarray]:
    """Columns of the pieces of a batch, unplaced."""
    total = np.array([len(x) // dtype.itemsize + 1 for x in tokens], np.int64)
    pieces = -(-total // capacity)
    row = np.repeat(np.arange(len(total)), pieces)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    head = total - (pieces - 1) * capacity
    start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
    length = np.where(piece == 0, head[row], capacity)
    crc, tail = np.zeros(len(row), np.int64), np.uint32(end).tobytes()
    k = 0
    for raw, n in zip(tokens, pieces.tolist()):
        wide = np.frombuffer(raw, dtype).astype("<u4").tobytes() + tail
        a, b = 0, 4 * int(length[k])
        for _ in range(n):
            crc[k] = zlib.crc32(wide[a:b])
            a, b, k = b, b + 4 * capacity, k + 1
    return [np.array(row), piece.astype(np.int32), start, length, crc]


def _place(table: pa.Table, capacity: int) -> Iterator[pa.RecordBatch]:
    """Give the pieces of a task that fill bins their places, full sequences one bin each, and the others a rank by length."""
    length = table.column("length").to_numpy()
    part = np.flatnonzero(length < capacity)
    bins, places = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    got, at = fill(length[part], capacity, True)
    places[part] = at
    used = int(got.max()) + 1 if len(got) else 0
    bins[part] = got
    whole = np.flatnonzero(length >= capacity)
    bins[whole] = used + np.arange(len(whole))
    split = TaskContext.get().partitionId()
    none = bins < 0
    ranks = np.zeros(len(length), np.int64)
    ranks[none] = _ranks(length[none])
    out = table.select(NAMES[:5]).append_column("sequence_id", pa.array((split << 32) + bins, mask=none)).append_column("offset", pa.array(places, mask=none))
    out = out.append_column("part", pa.array(np.full(len(length), split, np.int32))).append_column("place", pa.array(ranks))
    yield from out.to_batches(max_chunksize=50_000)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: document, piece, start, length, crc of its ids, sequence and offset in it."""
    spark = docs.sparkSession

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tables = encoder(tokenizer), []
        for batch in batches:
            _, off = c.text_buffers(batch.column(1))
            for i, j in c.chunks(off):
                part = batch.slice(i, j - i)
                columns = _cut(None, own.encode(part.column(1).to_pylist()), own.dtype, end, capacity)
                tables.append(pa.table([part.column(0).cast(pa.int64()).take(pa.array(columns[0])), *map(pa.array, columns[1:])], names=NAMES[:5]))
        if tables:
            yield from _place(pa.concat_tables(tables), capacity)

    level = c.materialize(c.keyed(docs, id_col, text_col).mapInArrow(first, _LEVEL), "pieces")
    done = level.where("sequence_id IS NOT NULL").select(*NAMES)
    rest = level.where("sequence_id IS NULL")
    counts = c.materialize(rest.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    if not histogram:
        return done
    layout = _layout(histogram, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    tasks = -(-sum(histogram.values()) // (FAN_IN * CARRY))
    ranked = rest.repartition(tasks, "length", "part").join(starts, ["length", "part"]).select(*NAMES[:5], (F.col("place") + F.col("before")).alias("place"))

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, places = _look_up(layout, batch.column("length").to_numpy(), batch.column("place").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array((1 << 58) + bins), pa.array(places)], names=NAMES)

    return done.unionByName(c.materialize(ranked.mapInArrow(last, SCHEMA), "pieces"))
