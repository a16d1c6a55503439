"""Language identification of mixed-language text.

Script ranges narrow the candidate languages of each word, per-word scores come from
log-odds of byte trigrams and of the whole word, and Viterbi with a switching penalty
labels the words, which gives spans. A document's language is the one with most bytes of
words; ``score`` is its share of them.

The model is fitted on a sample of labelled rows that has at most about
``max_rows_per_label`` rows of each label (a label with fewer is taken whole); it is drawn by a hash of
the id, and its counts are added up by a fixed number of tasks, so what reaches the driver
does not grow with the corpus. Prediction sees the text alone.

Words are runs of letters (ASCII letters and all bytes beyond ASCII). The search for the
best path advances all documents of a batch together, one numpy step per word position.

Defined results: null text or text without a letter gives ``und`` with score 0 and no
spans; words in a script that no label has are scored alike for all labels; ties go to
the label that sorts first; an empty training set gives ``und`` for all; repeated rows are
judged alike; extra columns are kept by ``keep_identified``. Any number of labels is learned; a
label takes 1 MB of the model, so a worker holds some 300 MB for 300 of them. A very long
text is handled whole, by itself, in some 40 bytes of memory for each of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

UNKNOWN = "und"
BITS = 17
SCHEMA = "doc_id bigint, lang_pred string, score double, spans array<struct<start:bigint,end:bigint,lang:string>>"

#: First code points of script ranges, and the script from there on.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Other"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"),
    (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3130, "Hangul"), (0x3190, "Other"),
    (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Other"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFE70, "Arabic"), (0xFF00, "Other"), (0xFF21, "Latin"), (0xFF5B, "Other"), (0x20000, "Han"), (0x30000, "Other"),
]
SCRIPT_NAMES = sorted({s for _, s in SCRIPTS})
_FROM = np.array([a for a, _ in SCRIPTS])
_SCRIPT = np.array([SCRIPT_NAMES.index(s) for _, s in SCRIPTS])

#: Bytes between words: all of ASCII but letters (texts are lower-cased first).
NOT_LETTER = c.separators((0x00, 0x60), (0x7B, 0x7F))


def _lowered(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().translate(c.LOWER.tobytes()), np.uint8)


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram slots by byte, word slots and scripts by word, of lower-cased bytes."""
    x = np.where(NOT_LETTER[data], np.uint8(32), data).astype(np.uint32)
    tri = x << np.uint32(8)
    tri[1:] |= x[:-1] << np.uint32(16)
    tri[:-1] |= x[1:]
    with np.errstate(over="ignore"):
        tri = (tri * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    words = (c.span_hash(c.prefix_hash(data), starts, ends) >> np.uint64(64 - BITS)).astype(np.int64)
    padded = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.int64)
    b0, b1, b2, b3 = (padded[starts + k] for k in range(4))
    low = lambda b: b & 0x3F
    cp = np.select([b0 < 0x80, b0 < 0xE0, b0 < 0xF0], [b0, ((b0 & 0x1F) << 6) | low(b1), ((b0 & 0x0F) << 12) | (low(b1) << 6) | low(b2)], ((b0 & 0x07) << 18) | (low(b1) << 12) | (low(b2) << 6) | low(b3))
    return tri, words, _SCRIPT[np.searchsorted(_FROM, cp, "right") - 1]


class Model:
    """Centred log-odds of trigrams and words for each label, and the scripts each label is written in."""

    def __init__(self, labels: list[str], trigrams: np.ndarray, words: np.ndarray, scripts: np.ndarray, alpha: float = 0.1):
        self.labels = labels
        self.trigrams, self.words = self._log_odds(trigrams, alpha), self._log_odds(words, alpha)
        share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
        allowed = share >= 1e-3
        allowed |= ~allowed.any(0)  # a script of no label narrows nothing
        self.barred = np.where(allowed.T, 0, -50).astype(np.float32)

    @staticmethod
    def _log_odds(counts: np.ndarray, alpha: float) -> np.ndarray:
        if not len(counts):
            return np.zeros((counts.shape[1], 0), np.float32)
        logs = np.log((counts + alpha) / (counts.sum(1, keepdims=True) + alpha * counts.shape[1]))
        return (logs - logs.mean(0)).T.astype(np.float32).copy()

    def scores(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Score of every word for every label."""
        tri, words, script = word_features(data, starts, ends)
        out = self.words[words] + self.barred[script]
        for k in range(len(self.labels)):  # one label at a time bounds the memory
            total = np.zeros(len(data) + 1)
            np.cumsum(self.trigrams[tri, k], out=total[1:])
            out[:, k] += (total[ends] - total[starts]).astype(np.float32)
        return out


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every word; rows (word ranges by ``first``) are independent of each other."""
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    begin, counts = first[:-1][order], counts[order]
    n_words, n_labels = scores.shape
    small = np.min_scalar_type(max(n_labels - 1, 0))  # the least type that holds every label
    labels = np.zeros(n_words, small)
    if not n_words or n_labels == 1:
        return labels
    steps = int(counts[0])
    active = np.searchsorted(-counts, -np.arange(steps), "left")  # rows with more than t words
    back = np.empty((n_words, n_labels), small)
    final = np.zeros((len(counts), n_labels), np.float32)
    best = final
    own = np.arange(n_labels, dtype=small)
    for t in range(steps):
        n = active[t]
        at = begin[:n] + t
        if t:
            v = best[:n]
            top = v.argmax(1)
            reach = v[np.arange(n), top][:, None] - np.float32(penalty)
            back[at] = np.where(v >= reach, own, top[:, None].astype(small))
            v = np.maximum(v, reach)
            v -= reach
            best = v + scores[at]
        else:
            best = scores[at]
        final[:n] = best
    state = final.argmax(1).astype(small)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        at = begin[:n] + t
        labels[at] = state[:n]
        if t:
            state[:n] = back[at, state[:n]]
    return labels


def fit(labelled: DataFrame, max_rows_per_label: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model:
    """Learn from rows that have text and a label, at most about ``max_rows_per_label`` of each label."""
    labelled = c.keyed(labelled, id_col, text_col, label_col)
    rows = labelled.where(F.col(f"`{text_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(F.col(f"`{label_col}`").alias("label")).count().orderBy("label").toLocalIterator()}
    labels = sorted(sizes)
    if not labels:
        return Model([], np.zeros((0, 1 << BITS)), np.zeros((0, 1 << BITS)), np.zeros((0, len(SCRIPT_NAMES))))
    share = F.create_map(*[x for k in labels for x in (F.lit(k), F.lit(min(1.0, max_rows_per_label / sizes[k])))])
    sample = rows.where(F.pmod(F.xxhash64(F.col(f"`{id_col}`").cast("string")), F.lit(1_000_003)) < share[F.col(f"`{label_col}`")] * 1_000_003).select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{label_col}`").alias("label"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 2 * (1 << BITS) + len(SCRIPT_NAMES)
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(1).to_pylist(), object)
            for i, j, data, off in c.text_chunks(batch, 0):
                data = _lowered(data)
                starts, ends, first = c.word_spans(data, off, NOT_LETTER)
                if not len(starts):
                    continue
                tri, words, script = word_features(data, starts, ends)
                inside = ~NOT_LETTER[data]
                for name in set(names[i:j]):
                    rows = names[i:j] == name
                    byte = np.repeat(rows, np.diff(off)) & inside
                    word = np.repeat(rows, np.diff(first))
                    total = sums.setdefault(name, np.zeros(width, np.int64))
                    total[: 1 << BITS] += np.bincount(tri[byte], minlength=1 << BITS)
                    total[1 << BITS : 2 << BITS] += np.bincount(words[word], minlength=1 << BITS)
                    total[2 << BITS :] += np.bincount(script[word], minlength=len(SCRIPT_NAMES))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], names=["label", "counts"])

    total = np.zeros((len(labels), (2 << BITS) + len(SCRIPT_NAMES)), np.int64)
    for name, packed in sample.repartition(8).mapInArrow(count, "label string, counts binary").toLocalIterator():
        total[labels.index(name)] += np.frombuffer(zlib.decompress(packed), np.int64)
    return Model(labels, total[:, : 1 << BITS], total[:, 1 << BITS : 2 << BITS], total[:, 2 << BITS :])


def _store(spark, model: Model) -> str:
    root = c.scratch(spark, "langid")
    c.save_array(f"{root}/trigrams", model.trigrams)
    c.save_array(f"{root}/words", model.words)
    c.save_array(f"{root}/barred", model.barred)
    return root


@lru_cache(maxsize=2)
def _load(root: str, labels: tuple[str, ...]) -> Model:
    model = Model.__new__(Model)
    model.labels = list(labels)
    for name, rows in (("trigrams", 1 << BITS), ("words", 1 << BITS), ("barred", len(SCRIPT_NAMES))):
        setattr(model, name, np.array(c.load_array(f"{root}/{name}", "f4")).reshape(rows, len(labels)))
    return model


def label_batch(model: Model, batch_text: pa.Array, penalty: float) -> tuple[list[str], np.ndarray, list[list[dict]]]:
    """Language, score and spans (byte offsets) of every text of a batch."""
    all_data, all_off = c.text_buffers(batch_text)
    n = len(all_off) - 1
    langs, share, spans = [UNKNOWN] * n, np.zeros(n), [[] for _ in range(n)]
    if not model.labels:
        return langs, share, spans
    parts, all_starts, all_ends, firsts, base = [], [], [], [np.zeros(1, np.int64)], 0
    has_ascii = np.zeros(n, bool)
    for i, j in c.chunks(all_off):
        data, off = _lowered(all_data[all_off[i] : all_off[j]]), all_off[i : j + 1] - all_off[i]
        starts, ends, first = c.word_spans(data, off, NOT_LETTER)
        parts.append(model.scores(data, starts, ends) if len(starts) else np.zeros((0, len(model.labels)), np.float32))
        letters = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
        has_ascii[i:j] = letters[off[1:]] > letters[off[:-1]]
        all_starts.append(starts + all_off[i])
        all_ends.append(ends + all_off[i])
        firsts.append(first[1:] + base)
        base += len(starts)
    if not parts:
        return langs, share, spans
    starts, ends, first = np.concatenate(all_starts), np.concatenate(all_ends), np.concatenate(firsts)
    labels = viterbi(np.concatenate(parts), first, penalty)
    k = len(model.labels)
    row = np.repeat(np.arange(n), np.diff(first))
    weight = np.bincount(row * k + labels, (ends - starts).astype(float), minlength=n * k).reshape(n, k)
    total = weight.sum(1)
    top = weight.argmax(1)
    share = np.where(total > 0, weight.max(1) / np.maximum(total, 1), 0.0)
    # spans: stretches of words with one label
    edge = np.ones(len(labels) + 1, bool)
    if len(labels):
        edge[1:-1] = (labels[1:] != labels[:-1]) | (row[1:] != row[:-1])
    cut = np.flatnonzero(edge)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        r = row[a]
        spans[r].append({"start": int(starts[a] - all_off[r]), "end": int(ends[b - 1] - all_off[r]), "lang": model.labels[labels[a]]})
    for r in range(n):
        if total[r] and (has_ascii[r] or any(ch.isalpha() for ch in all_data[all_off[r] : all_off[r + 1]].tobytes().decode())):
            langs[r] = model.labels[top[r]]
        else:
            share[r], spans[r] = 0.0, []
    return langs, share, spans


def _portions(batches: Iterator[pa.RecordBatch], at: int, n_labels: int) -> Iterator[pa.RecordBatch]:
    """Parts of the batches whose word scores fit in some 25 MB, however many labels there are; longest texts first."""
    c.release()
    for batch in batches:
        _, off = c.text_buffers(batch.column(at))
        size = np.diff(off)
        order = np.argsort(-size, kind="stable")  # texts of like length take the path search's steps together
        off = np.concatenate([[0], np.cumsum(size[order])])
        for i, j in c.chunks(off, max(c.CHUNK_BYTES, (16 << 20) // max(4, n_labels))):
            yield batch.take(pa.array(order[i:j]))


def detect(docs: DataFrame, model: Model, penalty: float = 12.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: language, score, spans."""
    root, labels = _store(docs.sparkSession, model), tuple(model.labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _portions(batches, 1, len(labels)):
            langs, share, spans = label_batch(_load(root, labels), part.column(1), penalty)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), pa.array(langs, pa.string()), pa.array(share, pa.float64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])))],
                names=["doc_id", "lang_pred", "score", "spans"],
            )

    return c.keyed(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def keep_identified(docs: DataFrame, model: Model, penalty: float = 12.0, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` whose text has words in learned languages, one or several."""
    root, labels, at = _store(docs.sparkSession, model), tuple(model.labels), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _portions(batches, at, len(labels)):
            langs, _, _ = label_batch(_load(root, labels), part.column(at), penalty)
            yield part.filter(pa.array([x != UNKNOWN for x in langs], pa.bool_()))

    return c.map_rows(docs, run)
