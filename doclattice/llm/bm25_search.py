"""Exact BM25 top-k search by block-max WAND, shard by shard, with global statistics.

A query is the set of terms (lower-cased words of letters and digits) of a document; a
document's score is the sum over the query's terms of
``ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean length))``,
with N, df and the mean length over all documents.

1. *Index.* Each task cuts its documents into shards of bounded size and writes the inverted
   index of each to the shared folder: postings by term, documents of like vocabulary and
   length next to each other. Document frequencies are counted with it, shuffled as packed
   arrays by term, and go with the queries' terms to one file per block of queries.
2. *Thresholds.* Each shard scores its own queries; the k-th score is a threshold that the
   final k-th score can't fall below.
3. *Block-max WAND.* Every shard meets every block of queries (a stated query set, in blocks
   that bound the memory). A shard is cut into blocks of ``BLOCK`` documents. Lists in many
   documents, which have most of the postings, are rows of a matrix of bytes, rounded up, with
   their greatest contribution in each block. Short lists have about as many block maxima as
   postings, so their postings are added up first. The greatest of these sums in a block and the maxima of the
   query's long lists bound every score there; where the bound reaches the threshold the block is a
   pivot, and all others are passed over without a look at the long lists. In pivot blocks
   alone these are added, and what reaches the threshold is scored exactly, in the order of terms
   that all shards share. Queries take these steps together, so bounds and scores by long
   lists are matrix products; a list that few of them share counts as short.
4. *Rounds.* The k-th score so far is the threshold of a task's next shard. A 64th of the shards
   goes first, then an 8th, and what all tasks have found is the threshold of the next round.
5. What reaches the threshold is merged: the k best by score, then id.

The number of queries grows with the table, and each must be held against every shard; the
pruning makes the step cheap, but its cost is proportional to queries times shards.

Terms are told apart by 64-bit hashes: among 10^8 different terms two share one with a
probability of 3e-4.

Defined results: null and empty texts have no terms, are no results and as queries have no rows; documents
with score 0 (no shared term) are no results, so a query may have fewer than k; ties go to
the smaller id (null first); repeated rows are results of their own; extra columns are ignored; an
empty table gives an empty result; a very long text is indexed whole, by itself, and its shard
closes after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

K1, B = 1.2, 0.75
#: Documents of a block: all lists have their greatest contribution in each.
BLOCK = 64
#: Terms in more than one of so many documents of a shard are rows of a matrix of bytes.
LONG = 256
#: Size of that matrix, at most; beyond, terms in the most documents go first.
MATRIX_BYTES = 64 << 20
#: A shard has at most so many documents and about so many bytes of text.
SHARD_DOCS, SHARD_BYTES = 16384, 32 << 20
#: Queries that take a step together.
TOGETHER = 128
#: A posting of a list costs as much as so many cells of the matrix.
ROW = 400
#: Blocks of documents that a matrix product takes together.
BESIDE = 4
#: Bounds, and sums in single precision, are held against levels that are less by this factor.
NEAR = 1 - 1e-4
LOW = np.int64(0xFFFF)
#: Shards of a task, where there are more of them than partitions.
SHARDS_PER_TASK = 4
#: The first rounds go over the first of so many shards each; what they find is the threshold of the next.
ROUNDS = 64, 8
QUERIES_PER_BLOCK = 8192
NO_ID = np.iinfo(np.int64).min
SCHEMA = "query_id bigint, rank int, doc_id bigint, score double"
QUERY_TERM = np.dtype([("row", "<u8"), ("query", "<i8"), ("term", "<u8"), ("df", "<i8")])
LEVEL = np.dtype([("row", "<u8"), ("level", "<f8")])


# -- a shard


def _spread(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The numbers of all ranges a..b, one after the other."""
    n = b - a
    return np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Builder:
    """Postings of some documents: (document, term, frequency), by document, then term."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.columns: list[tuple[np.ndarray, ...]] = []
        self.n = self.bytes = 0

    def add(self, data: np.ndarray, off: np.ndarray, *columns: np.ndarray) -> None:
        """Texts and, for each, id, row, query flag, home and result flag."""
        data = np.frombuffer(data.tobytes().translate(c.LOWER.tobytes()), np.uint8)
        starts, ends, first = c.word_spans(data, off, c.NOT_ALNUM)
        words = c.span_hash(c.prefix_hash(data), starts, ends)
        size = np.diff(first)
        doc = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((words, doc))
        doc, words = doc[order], words[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (words[1:] != words[:-1])
        at = np.flatnonzero(new)
        self.parts.append(((doc[at] + self.n).astype(np.int32), words[at], np.diff(np.append(at, len(doc))).astype(np.int32)))
        self.columns.append((*columns, size))
        self.n += len(size)
        self.bytes += len(data)

    def close(self) -> None:
        self.doc, self.word, self.tf = (np.concatenate([p[k] for p in self.parts]) for k in range(3))
        self.id, self.row, self.asked, self.home, self.result, self.size = (np.concatenate([x[k] for x in self.columns]) for k in range(6))
        self.begin = np.searchsorted(self.doc, np.arange(self.n + 1))


class Packed:
    """Arrays in one file, which workers map."""

    ARRAYS: tuple[tuple[str, str], ...] = ()

    def save(self, uri: str) -> None:
        arrays = [np.ascontiguousarray(getattr(self, name), dtype) for name, dtype in self.ARRAYS]
        head = np.array([len(x) for x in arrays], np.int64)
        c.save_array(uri, np.concatenate([x.view(np.uint8) for x in (head, *arrays)]))

    @classmethod
    def load(cls, uri: str):
        own, raw = cls(), c.load_array(uri, "u1")
        at = 8 * len(cls.ARRAYS)
        for (name, dtype), n in zip(cls.ARRAYS, np.frombuffer(raw[:at].tobytes(), np.int64).tolist()):
            width = np.dtype(dtype).itemsize * n
            setattr(own, name, np.frombuffer(raw, dtype, n, at))
            at += width
        return own


class Shard(Packed):
    """The inverted index of some documents, in one file: what belongs to documents, then terms and their postings."""

    ARRAYS = (("id", "<i8"), ("row", "<u8"), ("home", "<i4"), ("asked", "u1"), ("size", "<i8"), ("terms", "<u8"), ("begin", "<i8"), ("doc", "<u2"), ("tf", "<i4"))

    @classmethod
    def build(cls, b: Builder) -> "Shard":
        own = cls()
        docs = np.flatnonzero(b.result)
        # like by like: by the most frequent term, then by length, which makes the maxima of blocks tight
        count = np.diff(b.begin)
        some = docs[count[docs] > 0]
        top = np.zeros(b.n, np.uint64)
        if len(some):
            full = np.flatnonzero(count > 0)
            most = np.zeros(b.n, np.int64)
            most[full] = np.maximum.reduceat(b.tf, b.begin[full])
            at = np.flatnonzero(b.tf == most[b.doc])
            doc, first = np.unique(b.doc[at], return_index=True)
            top[doc] = b.word[at[first]]
        docs = docs[np.lexsort((b.size[docs], top[docs]))]
        at = _spread(b.begin[docs], b.begin[docs + 1])
        doc = np.repeat(np.arange(len(docs), dtype=np.uint16), count[docs])
        order = np.argsort(b.word[at], kind="stable")
        word = b.word[at][order]
        cut = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
        own.id, own.row, own.home, own.asked, own.size = b.id[docs], b.row[docs], b.home[docs], b.asked[docs], b.size[docs]
        own.terms, own.begin, own.doc, own.tf = word[cut], np.append(cut, len(word)), doc[order], b.tf[at][order]
        return own

    @property
    def n(self) -> int:
        return len(self.id)


class Queries(Packed):
    """A block of queries: distinct terms with df, and for each query row, id and the positions of its terms."""

    ARRAYS = (("terms", "<u8"), ("df", "<i8"), ("row", "<u8"), ("query", "<i8"), ("begin", "<i8"), ("at", "<i8"))

    @classmethod
    def build(cls, table: np.ndarray) -> "Queries":
        """From QUERY_TERM rows; queries with the same most common term, mostly of one language, follow each other."""
        own = cls()
        table = table[np.lexsort((table["term"], table["row"]))]
        own.terms, first, at = np.unique(table["term"], return_index=True, return_inverse=True)
        own.df = table["df"][first]
        cut = np.flatnonzero(np.concatenate([[True], table["row"][1:] != table["row"][:-1]]))
        begin = np.append(cut, len(table))
        most = np.maximum.reduceat(table["df"], cut)
        top = np.flatnonzero(table["df"] == np.repeat(most, np.diff(begin)))
        top = table["term"][top[np.searchsorted(top, cut)]]
        order = np.lexsort((np.diff(begin), top))
        own.row, own.query = table["row"][cut][order], table["query"][cut][order]
        own.at = at[_spread(begin[order], begin[order + 1])]
        own.begin = np.concatenate([[0], np.cumsum(np.diff(begin)[order])])
        return own

    def some(self, which: np.ndarray) -> "Queries":
        """These queries, with their terms alone."""
        own = Queries()
        at = np.asarray(self.at)[_spread(self.begin[which], self.begin[which + 1])]
        used, own.at = np.unique(at, return_inverse=True)
        own.terms, own.df, own.row, own.query = self.terms[used], self.df[used], self.row[which], self.query[which]
        own.begin = np.concatenate([[0], np.cumsum(self.begin[which + 1] - self.begin[which])])
        return own


class Index:
    """The postings of a shard, with contributions for the queries' terms and block maxima."""

    def __init__(self, shard: Shard, terms: np.ndarray, df: np.ndarray, n_docs: int, mean: float):
        self.terms, self.begin, self.tf = np.asarray(shard.terms), np.asarray(shard.begin), np.asarray(shard.tf)
        self.n, self.n_docs = max(shard.n, 1), n_docs
        self.n_blocks = -(-self.n // BLOCK)
        self.count = np.diff(self.begin)
        self.norm = K1 * (1 - B + B * np.asarray(shard.size) / max(mean, 1e-9))
        self.doc = np.asarray(shard.doc)
        self.weight = np.zeros(len(self.doc))
        self.packed = self.weight.copy()  # the document in the lowest 16 bits of the contribution: one read for both
        # by document, then term: what exact scoring reads
        self.order = np.argsort(self.doc, kind="stable").astype(np.int32)
        self.d_term = np.repeat(np.arange(len(self.terms), dtype=np.int32), self.count)[self.order]
        self.d_begin = np.concatenate([[0], np.cumsum(np.bincount(self.doc, minlength=self.n))])
        self.wanted = np.zeros(len(self.terms), bool)
        # lists in many documents, as rows of a matrix of bytes: contributions without idf, rounded up, and their block maxima
        long = np.flatnonzero(self.count * LONG > self.n)
        most = max(1, MATRIX_BYTES // (self.n_blocks * BLOCK))
        if len(long) > most:
            long = np.sort(long[np.argpartition(-self.count[long], most - 1)[:most]])
        self.common = np.full(len(self.terms), -1)
        self.common[long] = np.arange(len(long))
        own, row = _spread(self.begin[long], self.begin[long + 1]), np.repeat(np.arange(len(long)), self.count[long])
        part = self._part(own)
        self.step = np.maximum.reduceat(part, np.cumsum(self.count[long]) - self.count[long]) / 255 if len(long) else np.zeros(0)
        self.dense = np.zeros((len(long), self.n_blocks * BLOCK), np.uint8)
        self.dense[row, self.doc[own]] = np.minimum(np.ceil(part / self.step[row]), 255)
        self.b_max = self.dense.reshape(len(long), self.n_blocks, BLOCK).max(2)
        self.idf, self.known = np.zeros(len(self.terms)), np.zeros(len(self.terms), bool)
        self.held = np.zeros((0, self.n_blocks * BLOCK), np.float32)
        self.pivots = self.blocks = self.read = 0
        self.ask(terms, df)

    def _part(self, posting: np.ndarray) -> np.ndarray:
        tf = self.tf[posting].astype(float)
        return tf * (K1 + 1) / (tf + self.norm[self.doc[posting]])

    def ask(self, terms: np.ndarray, df: np.ndarray) -> None:
        """Queries to come have these terms; contributions of earlier ones are kept."""
        self.slot = np.full(len(terms), -1)
        if not len(terms):
            return
        at = np.minimum(np.searchsorted(terms, self.terms), len(terms) - 1)
        mine = np.flatnonzero(terms[at] == self.terms)
        self.slot[at[mine]] = mine
        new = mine[~self.known[mine]]
        self.known[new] = True
        self.idf[new] = np.log1p((self.n_docs - df + 0.5) / (df + 0.5))[at[new]]
        for x in range(0, len(new), 1 << 14):
            some = new[x : x + (1 << 14)]
            posting = _spread(self.begin[some], self.begin[some + 1])
            tf = self.tf[posting].astype(float)
            weight = np.repeat(self.idf[some], self.count[some]) * tf * (K1 + 1) / (tf + self.norm[self.doc[posting]])
            self.weight[posting] = weight
            self.packed[posting] = (weight.view(np.int64) & ~LOW | self.doc[posting]).view(float)

    def exact(self, query: np.ndarray, docs: np.ndarray, slots: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Scores of pairs (query, document), by query; contributions are added in the order of terms."""
        out = np.zeros(len(docs))
        cut = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1], [True]]))
        for x, y in zip(cut[:-1].tolist(), cut[1:].tolist()):
            own = slots[begin[query[x]] : begin[query[x] + 1]]
            own = own[own >= 0]
            a, b = self.d_begin[docs[x:y]], self.d_begin[docs[x:y] + 1]
            at = _spread(a, b)
            self.wanted[own] = True
            on = np.flatnonzero(self.wanted[self.d_term[at]])
            self.wanted[own] = False
            out[x:y] = np.bincount(np.repeat(np.arange(y - x), b - a)[on], self.weight[self.order[at[on]]], minlength=y - x)
        return out

    def reaching(self, begin: np.ndarray, terms: np.ndarray, levels: np.ndarray, k: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(queries, documents, scores) with a score of at least the query's level > 0, some queries at a time.

        ``terms`` has positions of the queries' terms, by ``begin``. With ``k`` only the k best of
        each query are wanted: the levels rise to the k-th best score of the most promising
        blocks, then to that of all pivots.
        """
        if not len(self.doc):
            return
        slots = self.slot[terms]
        for i in range(0, len(begin) - 1, TOGETHER):
            j = min(i + TOGETHER, len(begin) - 1)
            m = j - i
            slot = slots[begin[i] : begin[j]]
            query = np.repeat(np.arange(m), np.diff(begin[i : j + 1]))
            query, slot = query[slot >= 0], slot[slot >= 0]
            # a matrix row costs all queries, a list those that ask for it
            used = np.bincount(slot, minlength=len(self.terms))
            columns = np.flatnonzero((self.common >= 0) & (used * self.count * ROW > self.n * m))
            place = np.full(len(self.terms), -1)
            place[columns] = np.arange(len(columns))
            column = place[slot]
            on = column >= 0
            rows = self.common[columns]
            asked = np.zeros((m, len(columns)), np.float32)
            asked[query[on], column[on]] = (self.step[rows] * self.idf[columns])[column[on]]
            scores = self._short(m, query[~on], slot[~on])
            bound = asked @ self.b_max[rows].astype(np.float32) + scores.reshape(m, self.n_blocks, BLOCK).max(2)
            level = levels[i:j].copy()
            if k is not None:
                best = np.zeros_like(bound, dtype=bool)
                most = min(self.n_blocks, -(-k // BLOCK) + 1)
                np.put_along_axis(best, np.argpartition(-bound, most - 1, 1)[:, :most], True, 1)
                some = scores.copy()
                self._add_long(some, best, asked, rows)
                level = np.maximum(level, self._kth(some, k, i, slots, begin))
            pivot = (bound >= (level * NEAR)[:, None]) & (bound > 0)
            self.pivots += int(pivot.sum())
            self.blocks += pivot.size
            if k is not None:
                self._add_long(scores, pivot, asked, rows)
                level = np.maximum(level, self._kth(scores, k, i, slots, begin))
                q, d = np.nonzero(scores >= (level * NEAR)[:, None])
            else:
                q, d = self._near(scores, pivot, asked, rows, level * NEAR)
            if not len(q):
                continue
            x = self.exact(q + i, d, slots, begin)
            good = x >= levels[i:j][q]
            yield q[good] + i, d[good], x[good]

    def _kth(self, scores: np.ndarray, k: int, i: int, slots: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """A level that the k-th best of each row surely reaches: the least exact score of the k that look best; 0 where there are fewer."""
        m = len(scores)
        if k > self.n:
            return np.zeros(m)
        docs = np.argpartition(scores[:, : self.n], self.n - k, 1)[:, self.n - k :].ravel()
        return self.exact(np.repeat(np.arange(m) + i, k), docs, slots, begin).reshape(m, k).min(1)

    def _short(self, m: int, query: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Scores by lists alone, of pairs (query, list) in the order of queries; the columns are documents. The next call overwrites them."""
        if len(self.held) < m:
            self.held = np.zeros((m, self.n_blocks * BLOCK), np.float32)
        scores = self.held[:m]
        count = self.count[slot]
        to = np.cumsum(count)
        shift = self.begin[slot] - (to - count)
        cut = np.searchsorted(query, np.arange(m + 1))
        first = np.concatenate([[0], to])[cut].tolist()
        place, cut = np.arange(first[-1]), cut.tolist()
        self.read += first[-1]
        for q in range(m):  # a query at a time stays in the processor's cache
            if first[q] == first[q + 1]:
                scores[q] = 0
                continue
            at = np.repeat(shift[cut[q] : cut[q + 1]], count[cut[q] : cut[q + 1]])
            at += place[first[q] : first[q + 1]]
            weight = self.packed.take(at)
            scores[q] = np.bincount(weight.view(np.int64) & LOW, weight, minlength=scores.shape[1])
        return scores

    def _pivots(self, scores: np.ndarray, pivot: np.ndarray, asked: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, slice, np.ndarray]]:
        """(queries, documents, scores with the matrix rows) of the queries' pivot blocks and some beside them; sums are rounded up, and in single precision."""
        for x in range(0, self.n_blocks, BESIDE):
            some = np.flatnonzero(pivot[:, x : x + BESIDE].any(1))
            if len(some):
                at = slice(x * BLOCK, min(x + BESIDE, self.n_blocks) * BLOCK)
                sums = scores[some, at]
                if len(rows):
                    sums += asked[some] @ self.dense[rows, at].astype(np.float32)
                yield some, at, sums

    def _add_long(self, scores: np.ndarray, pivot: np.ndarray, asked: np.ndarray, rows: np.ndarray) -> None:
        for some, at, sums in self._pivots(scores, pivot, asked, rows):
            scores[some, at] = sums

    def _near(self, scores: np.ndarray, pivot: np.ndarray, asked: np.ndarray, rows: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries and documents, by query, that reach the levels."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for some, at, sums in self._pivots(scores, pivot, asked, rows):
            q, d = np.nonzero(sums >= level[some][:, None])
            if len(q):
                out.append((some[q], d + at.start))
        q, d = (np.concatenate([x[n] for x in out]) for n in range(2))
        order = np.argsort(q, kind="stable")
        return q[order], d[order]


# -- over a corpus


def rounds(n: int) -> list[int]:
    """Up to which of n shards each round goes."""
    return sorted({n // x for x in ROUNDS} - {0} | {n})


def _zip(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), "zstd", asbytes=True)


def _unzip(blob: bytes, dtype: np.dtype) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(blob), dtype)


def _builders(batches: Iterator[pa.RecordBatch]) -> Iterator[Builder]:
    """The documents of a task, cut into shards of bounded size."""
    held = Builder()
    for batch in batches:
        ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
        asked, home, row, result = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4, 5))
        columns = ids, row.astype(np.int64).view(np.uint64), asked.astype(bool), home.astype(np.int32), result.astype(bool)
        for i, j, data, off in c.text_chunks(batch, 1):
            for x in range(i, j, SHARD_DOCS):
                y = min(j, x + SHARD_DOCS)
                if held.n and (held.n + y - x > SHARD_DOCS or held.bytes > SHARD_BYTES):
                    held.close()
                    yield held
                    held = Builder()
                held.add(data[off[x - i] : off[y - i]], off[x - i : y - i + 1] - off[x - i], *(col[x:y] for col in columns))
    if held.n:
        held.close()
        yield held


class Best:
    """The k best scores of each query so far."""

    def __init__(self, n: int, k: int):
        self.scores = np.zeros((n, k))

    def add(self, query: np.ndarray, scores: np.ndarray) -> None:
        k = self.scores.shape[1]
        order = np.lexsort((-scores, query))
        query, scores = query[order], scores[order]
        new = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
        place = np.arange(len(query)) - np.repeat(new, np.diff(np.append(new, len(query))))
        some = query[new]
        more = np.zeros((len(some), k))
        top = place < k
        more[np.repeat(np.arange(len(some)), np.diff(np.append(new, len(query))))[top], place[top]] = scores[top]
        both = np.concatenate([self.scores[some], more], 1)
        both.sort(1)
        self.scores[some] = both[:, k:]

    def level(self) -> np.ndarray:
        """The k-th best score, 0 where there are fewer."""
        return self.scores.min(1) if self.scores.size else np.zeros(len(self.scores))


def search(docs: DataFrame, queries: DataFrame | None = None, k: int = 10, every: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The k best documents of every query; the queries are the documents whose id is divisible by ``every``.

    ``queries`` (id and text columns of the same names) replaces them.
    """
    spark = docs.sparkSession
    columns = c.keyed(docs, id_col, text_col).toDF("doc_id", "text").withColumn("asked", F.coalesce(F.col("doc_id") % every == 0, F.lit(False)) if queries is None else F.lit(False)).withColumn("result", F.lit(True))
    if queries is not None:
        own = c.keyed(queries, id_col, text_col).toDF("doc_id", "text").withColumn("asked", F.lit(True)).withColumn("result", F.lit(False))
        columns = columns.unionByName(own)
    base = docs
    stable = queries is None and c.from_files(docs)
    if not stable:  # no files behind it: a table in the shared folder gives rows a stable place
        base = c.materialize(columns, "texts")
    asked = F.coalesce(F.col(f"`{id_col}`") % every == 0, F.lit(False)) if stable else F.col("asked")
    result = F.lit(True) if stable else F.col("result")
    text = F.coalesce(F.col(f"`{text_col}`" if stable else "text"), F.lit(""))
    row = F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    n_queries = base.where(asked).count()
    blocks = max(1, -(-n_queries // QUERIES_PER_BLOCK))
    home = F.pmod(F.xxhash64(F.col("_metadata.file_path"), F.shiftright(F.col("_metadata.row_index"), 12)), F.lit(blocks)).cast("int")
    rows = base.select(F.col(f"`{id_col}`" if stable else "doc_id").cast("bigint").alias("doc_id"), text.alias("text"), asked.alias("asked"), home.alias("home"), row.alias("row"), result.alias("result"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    root = c.scratch(spark, "bm25")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(out: list[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(out), 64):
                part = out[i : i + 64]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in part], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "kind", "home", "blob"])

        for number, b in enumerate(_builders(batches)):
            out: list[tuple[int, int, int, bytes]] = []
            if b.result.any():
                shard, place = Shard.build(b), f"{root}/shard-{TaskContext.get().partitionId():06d}-{number:05d}"
                shard.save(place)
                out.append((number % buckets, 3, 0, place.encode()))
                terms, df = shard.terms, np.diff(shard.begin)
                for h in range(buckets):
                    own = np.flatnonzero(terms % np.uint64(buckets) == h)
                    if len(own):
                        out.append((h, 0, 0, _zip(np.concatenate([terms[own], df[own].astype(np.uint64)]))))
                out.append((0, 2, 0, np.array([shard.n, shard.size.sum()], np.int64).tobytes()))
            pick = np.flatnonzero(b.asked[b.doc])
            table = np.zeros(len(pick), QUERY_TERM)
            table["row"], table["query"], table["term"] = b.row[b.doc[pick]], b.id[b.doc[pick]], b.word[pick]
            for h in np.unique(b.home[b.doc[pick]]).tolist():
                mine = table[b.home[b.doc[pick]] == h]
                for k in range(buckets):
                    own = mine[mine["term"] % np.uint64(buckets) == k]
                    if len(own):
                        out.append((k, 1, h, _zip(own)))
            yield from send(out)

    def with_df(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts, asked = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
        out: list[tuple[int, int, bytes]] = []
        for batch in batches:
            for kind, h, blob in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                if kind == 0:
                    both = _unzip(blob, np.dtype("<u8"))
                    terms.append(both[: len(both) // 2]), counts.append(both[len(both) // 2 :].astype(np.int64))
                elif kind == 1:
                    asked.append((h, _unzip(blob, QUERY_TERM)))
                else:
                    out.append((kind, 0, blob))
        names, inverse = np.unique(np.concatenate(terms), return_inverse=True)
        df = np.bincount(inverse, np.concatenate(counts), minlength=len(names)).astype(np.int64)
        for h, table in asked:
            table = table.copy()
            at = np.minimum(np.searchsorted(names, table["term"]), max(len(names) - 1, 0))
            table["df"] = np.where(names[at] == table["term"], df[at], 0) if len(names) else 0
            out.append((1, h, _zip(table)))
        for i in range(0, len(out), 64):
            part = out[i : i + 64]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in part], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["kind", "home", "blob"])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, home = [], -1
        for batch in batches:
            for kind, h, blob in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if kind == 1:
                    home = h
                    tables.append(_unzip(blob, QUERY_TERM))
                else:
                    n, words = np.frombuffer(blob, np.int64).tolist() if kind == 2 else (0, 0)
                    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([words]), pa.array([blob.decode() if kind == 3 else None], pa.string())], names=["n", "words", "shard"])
        if tables:
            Queries.build(np.concatenate(tables)).save(f"{root}/queries-{home:06d}")

    packed = rows.mapInArrow(build, "bucket int, kind int, home int, blob binary").repartitionById(buckets, "bucket").mapInArrow(with_df, "kind int, home int, blob binary")
    stored = c.materialize(packed.repartitionById(blocks, F.when(F.col("kind") == 1, F.col("home")).otherwise(F.pmod(F.xxhash64("blob"), F.lit(blocks)).cast("int"))).mapInArrow(store, "n bigint, words bigint, shard string"), "shards")
    totals = stored.agg(F.sum("n"), F.sum("words"), F.count("shard")).first()
    n_docs, mean = int(totals[0] or 0), float(totals[1] or 0) / max(1, int(totals[0] or 0))
    ordered = stored.where("shard IS NOT NULL").select("shard").orderBy(F.xxhash64("shard"), "shard")

    def shards(a: int, b: int) -> DataFrame:
        """Those from the a-th to the b-th, spread over tasks."""
        return ordered.offset(a).limit(b - a).repartition(max(1, min(b - a, max(buckets, (b - a) // SHARDS_PER_TASK))))

    def opened(batches: Iterator[pa.RecordBatch]) -> list[Shard]:
        c.release()
        return [Shard.load(place) for batch in batches for place in batch.column(0).to_pylist()]

    def there(kind: str, h: int) -> bool:
        fs, path = c.open_fs(f"{root}/{kind}-{h:06d}")
        return fs.get_file_info(path).type.name == "File"

    def own_levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in opened(batches):
            index, asked = None, np.asarray(shard.asked) > 0
            for h in np.unique(shard.home[asked]).tolist():
                if not there("queries", h):
                    continue
                block = Queries.load(f"{root}/queries-{h:06d}")
                block = block.some(np.flatnonzero(np.isin(block.row, shard.row[asked & (shard.home == h)])))
                if not len(block.row):
                    continue
                if index is None:
                    index = Index(shard, block.terms, block.df, n_docs, mean)
                else:
                    index.ask(block.terms, block.df)
                best = Best(len(block.row), k)
                for query, _, scores in index.reaching(block.begin, block.at, np.full(len(block.row), 1e-12), k):
                    best.add(query, scores)
                out = np.zeros(len(block.row), LEVEL)
                out["row"], out["level"] = block.row, best.level()
                yield pa.RecordBatch.from_arrays([pa.array([h], pa.int32()), pa.array([_zip(out)], pa.binary())], names=["home", "blob"])

    def store_levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, home = [], -1
        for batch in batches:
            for h, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                home = h
                parts.append(_unzip(blob, LEVEL))
        if parts:
            table = np.concatenate(parts)
            c.save_array(f"{root}/levels0-{home:06d}", table[np.argsort(table["row"], kind="stable")])
            yield pa.RecordBatch.from_arrays([pa.array([home], pa.int32())], names=["home"])

    shards(0, totals[2]).mapInArrow(own_levels, "home int, blob binary").repartitionById(blocks, "home").mapInArrow(store_levels, "home int").count()

    def levels_of(number: int, h: int, rows: np.ndarray) -> np.ndarray:
        """The levels of these rows before a round, 0 where there is none."""
        if not there(f"levels{number}", h):
            return levels_of(number - 1, h, rows) if number else np.zeros(len(rows))
        levels = c.load_array(f"{root}/levels{number}-{h:06d}", LEVEL)
        i = np.minimum(np.searchsorted(levels["row"], rows), len(levels) - 1)
        return np.where(levels["row"][i] == rows, levels["level"][i], 0.0)

    def raised(number: int):
        """Levels for a round from the results of those before, and from the levels before."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, best, home = np.zeros(0, np.uint64), None, -1
            for batch in batches:
                if best is None:
                    home = batch.column(0)[0].as_py()
                    rows = np.sort(Queries.load(f"{root}/queries-{home:06d}").row)
                    best = Best(len(rows), k)
                best.add(np.searchsorted(rows, batch.column(1).to_numpy().view(np.uint64)), batch.column(2).to_numpy())
            if best is not None:
                out = np.zeros(len(rows), LEVEL)
                out["row"], out["level"] = rows, np.maximum(best.level(), levels_of(number - 1, home, rows))
                c.save_array(f"{root}/levels{number}-{home:06d}", out)
                yield pa.RecordBatch.from_arrays([pa.array([home], pa.int32())], names=["home"])

        return run

    def finder(number: int):
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            starts: dict[int, np.ndarray] = {}
            bests: dict[int, Best] = {}
            for shard in opened(batches):
                index = None
                for h in range(blocks):
                    if not there("queries", h):
                        continue
                    block = Queries.load(f"{root}/queries-{h:06d}")
                    if h not in bests:
                        starts[h], bests[h] = levels_of(number, h, np.asarray(block.row)), Best(len(block.row), k)
                    if index is None:
                        index = Index(shard, block.terms, block.df, n_docs, mean)
                    else:
                        index.ask(block.terms, block.df)
                    best = bests[h]
                    level = np.maximum(np.maximum(starts[h], best.level()), 1e-12)
                    for query, docs, scores in index.reaching(block.begin, block.at, level):
                        ids = np.asarray(shard.id)[docs]
                        order = np.lexsort((ids, -scores, query))  # the k best of each query
                        query, ids, scores = query[order], ids[order], scores[order]
                        new = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
                        top = np.arange(len(query)) - np.repeat(new, np.diff(np.append(new, len(query)))) < k
                        query, ids, scores = query[top], ids[top], scores[top]
                        best.add(query, scores)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(query), h, np.int32)), pa.array(block.row[query].view(np.int64)), pa.array(block.query[query]), pa.array(ids, mask=ids == NO_ID), pa.array(scores)], names=["home", "row", "query_id", "doc_id", "score"])

        return find

    found, begin = None, 0
    for number, end in enumerate(rounds(totals[2])):
        if found is not None:
            found.select("home", "row", "score").repartitionById(blocks, "home").mapInArrow(raised(number), "home int").count()
        part = shards(begin, end).mapInArrow(finder(number), "home int, row bigint, query_id bigint, doc_id bigint, score double")
        if end < totals[2]:
            part = c.materialize(part, "found")
        found, begin = part if found is None else found.unionByName(part), end
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
