"""URL filter on a memory-mapped sorted digest array.

Rules (a host and a path prefix, each to block or to allow) and listed URLs are strings,
stored in the order of their 64-bit xxhash digests: an array of digests, one of offsets,
and the strings themselves, all mapped from the shared folder, so workers of a machine
share their pages. A URL is looked up by the strings that could be listed: for each suffix
of its host by labels and each length that listed paths have, the host suffix with the
path's first characters. All candidates of a batch are hashed and probed by one vectorised binary search;
equal digests are compared as full strings, so a collision never decides.

The longest fitting rule decides, by the length of its string, then block before allow.
A URL that no rule fits is blocked if it is listed whole (host and path), else allowed.

The list is written by the executors: entries are partitioned by ranges of their digests and
sorted, each task writes the arrays of its range, and the driver learns the ranges' bounds
alone, one row for some ``PART_ROWS`` entries. A probe finds the range, then the digest.

Defined results: null URLs and URLs without ``://`` have an empty host and path, fit no
rule and are allowed; repeated rows are judged alike; extra columns are ignored; with an
empty list everything is allowed; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

SCHEMA = "page_id bigint, host string, path string, rule string, verdict string"
ALLOW, BLOCK, LISTED = 0, 1, 2
#: Entries of a range of digests, about.
PART_ROWS = 2_000_000


def digest(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text, seed=42)


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def store(spark: SparkSession, rules: Iterable[tuple[str, str, bool]], listed: DataFrame | None = None, part_rows: int = PART_ROWS) -> str:
    """Write the digest array of rules (host, path, block) and of the ``url`` column of ``listed``.

    A string that is both a rule's and listed, or listed twice, is kept once for each role.
    """
    rows = sorted({((host.lower() + path).encode(), BLOCK if block else ALLOW, len(path.encode())) for host, path, block in rules})
    mine = spark.createDataFrame([(t.decode(), k) for t, k, _ in rows], "entry string, role int")
    parts = 1
    if listed is not None:
        url = F.col("url")
        own = listed.select(F.concat(host_of(url), path_of(url)).alias("entry"), F.lit(LISTED).alias("role")).where("entry <> ''")
        mine = mine.unionByName(own)
        parts = -(-mine.count() // part_rows)
    # Spark's xxhash64 of a string is the xxhash64 of its bytes with seed 42; the changed sign bit makes its order that of unsigned numbers
    order = F.xxhash64("entry").bitwiseXOR(F.lit(-(2**63)))
    ranges = mine.distinct().withColumn("h", order).repartitionByRange(max(1, parts), "h").sortWithinPartitions("h", "entry", "role")
    root = c.scratch(spark, "digests")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [b for b in batches if b.num_rows]
        if not table:
            return
        part = f"{root}/{TaskContext.get().partitionId():06d}"
        whole = pa.Table.from_batches(table)
        data, off = c.text_buffers(whole.column("entry"))
        digests = whole.column("h").to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
        c.save_array(f"{part}/digests", digests)
        c.save_array(f"{part}/offsets", off.astype("u8"))
        c.save_array(f"{part}/roles", whole.column("role").to_numpy().astype("u1"))
        c.save_array(f"{part}/strings", data)
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([whole.column("h")[0].as_py()])], names=["part", "least"])

    found = sorted(ranges.select("h", "entry", "role").mapInArrow(write, "part string, least bigint").collect(), key=lambda r: r.least)
    c.save_array(f"{root}/least", np.array([r.least for r in found], np.int64).view(np.uint64) ^ np.uint64(1 << 63))
    c.save_array(f"{root}/parts", np.frombuffer("\n".join(r.part for r in found).encode(), np.uint8))
    c.save_array(f"{root}/lengths", np.array(sorted({n for _, _, n in rows}), np.int64))
    return root


class Table:
    """A mapped digest array, in ranges of digests that are opened as they are needed."""

    def __init__(self, root: str):
        self.least = np.array(c.load_array(f"{root}/least", "u8"))
        self.parts = c.load_array(f"{root}/parts", "u1").tobytes().decode().split("\n")
        self.lengths = c.load_array(f"{root}/lengths", "i8").tolist()
        self.open: dict[int, tuple[np.ndarray, ...]] = {}

    def part(self, k: int) -> tuple[np.ndarray, ...]:
        if k not in self.open:
            if len(self.open) > 64:
                self.open.clear()
            self.open[k] = tuple(c.load_array(f"{self.parts[k]}/{name}", dtype) for name, dtype in (("digests", "u8"), ("offsets", "u8"), ("roles", "u1"), ("strings", "u1")))
        return self.open[k]

    def probe(self, texts: list[bytes], digests: np.ndarray | None = None) -> list[list[int]]:
        """Roles under which each text is listed."""
        if digests is None:
            digests = np.fromiter((digest(t) for t in texts), np.uint64, len(texts))
        out: list[list[int]] = [[] for _ in texts]
        home = np.searchsorted(self.least, digests, "right") - 1
        for p in np.unique(home[home >= 0]).tolist():
            own = np.flatnonzero(home == p)
            table, offsets, roles, strings = self.part(p)
            a, b = np.searchsorted(table, digests[own], "left"), np.searchsorted(table, digests[own], "right")
            for k in np.flatnonzero(b > a).tolist():
                for e in range(int(a[k]), int(b[k])):
                    if strings[int(offsets[e]) : int(offsets[e + 1])].tobytes() == texts[own[k]]:
                        out[own[k]].append(int(roles[e]))
        return out

    def judge(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str]]:
        """Deciding rule and verdict of each (host, path)."""
        texts: list[bytes] = []
        owner: list[int] = []
        for i, (host, path) in enumerate(zip(hosts, paths)):
            if not host:
                continue
            h, p = host.encode(), path.encode()
            while True:
                for n in self.lengths:
                    if n <= len(p):
                        texts.append(h + p[:n])
                        owner.append(i)
                dot = h.find(b".")
                if dot < 0:
                    break
                h = h[dot + 1 :]
        rule: list[str | None] = [None] * len(hosts)
        best = [(-1, 0)] * len(hosts)
        for text, i, roles in zip(texts, owner, self.probe(texts)):
            for role in roles:
                if role != LISTED and (len(text), role) > best[i]:
                    best[i], rule[i] = (len(text), role), text.decode()
        verdict = ["block" if b[1] == BLOCK else "allow" for b in best]
        open_ = [i for i, r in enumerate(rule) if r is None and hosts[i]]
        for i, roles in zip(open_, self.probe([(hosts[i] + paths[i]).encode() for i in open_])):
            if LISTED in roles:
                verdict[i] = "block"
        return rule, verdict


@lru_cache(maxsize=2)
def _table(root: str) -> Table:
    return Table(root)


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, bool]], listed: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: host, path, the rule that decides (or null), verdict."""
    root = store(pages.sparkSession, rules, listed)
    parts = c.keyed(pages, id_col, url_col).toDF("page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rule, verdict = _table(root).judge(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), batch.column(2), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return parts.mapInArrow(run, SCHEMA)
