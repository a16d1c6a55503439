"""Secret scans: fixed patterns plus a token-efficiency test.

Base kinds (leftmost, non-overlapping per kind, on whole texts):

* ``assign``: a keyword, ``:`` or ``=``, and a value of 8 or more characters;
* ``access``: ``AKIA`` and capitals or digits, 16 or more characters in all;
* ``hex``: 32 or more lower-case hexadecimal digits.

The method adds ``random`` spans: runs of ``[A-Za-z0-9+/_=-]`` of ``min_length`` or more
characters are split by a tiktoken vocabulary, and a run with few characters per token is
taken for a random string, as text, names and code compress to longer tokens. Every run is
held against the vocabulary, whatever characters it has, but for known digests (hexadecimal
runs of digest lengths), UUIDs, groups of at most 8 digits, single letters joined by marks,
marks alone and a unit of up to 4 characters over and over. In runs shaped like identifiers
(words joined by marks, with trailing numbers) the marks count neither as characters nor as
tokens, as they cost short words a token each, and words in capitals count in lower case,
as vocabularies know them.

Of a run that base spans cover in part, what they leave is tested by itself, without the
marks next to them. Where that is shorter than ``min_length``, it is taken if the whole run
is random and the rest neither names something (letters with few digits and few tokens) nor
has less than 4 characters. Runs that base spans cover as a whole are left out.

The keyword search is a substring test on the lower-cased bytes, so the regular expression
runs on the few texts that can match; candidate runs are found by numpy on the bytes.

Defined results: null and empty texts have no spans; positions are code points with an
exclusive end; repeated rows are judged alike; extra columns are kept by ``redact`` and
ignored by ``scan``; empty tables give empty results; a very long text is handled whole, by
itself.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as c

SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_random bigint"
KINDS = ("assign", "access", "hex", "random")
#: Split pattern of the public byte-level vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_RUN = np.zeros(256, bool)
_RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True

_UUID = re.compile(rb"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}")
_ANYHEX = re.compile(rb"[0-9a-f]+|[0-9A-F]+")
_DIGESTS = {32, 40, 48, 56, 64, 96, 128}
_MARKS = b"_/+=-"
_WORD = re.compile(rb"[A-Za-z0-9]+")
#: Groups of digits, single letters, marks alone, a short unit repeated.
_PLAIN = re.compile(rb"[_/+=-]*[0-9]{1,8}(?:[_/+=-]+[0-9]{1,8})*[_/+=-]*|[_/+=-]*[A-Za-z](?:[_/+=-]+[A-Za-z])*[_/+=-]*|[_/+=-]+|(.{1,4}?)\1{4,}")
#: Words of letters with few digits at their ends, joined by marks.
_IDENTIFIER = re.compile(rb"[A-Za-z]{2,}[0-9]{0,4}(?:[_/+=-]+(?:[A-Za-z]{2,}[0-9]{0,4}|[0-9]{1,4}))*[_/+=-]*")


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte-ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def is_random(run: bytes, vocabulary: str, max_ratio: float) -> bool:
    """Whether a run of key characters has few characters per token and is no digest or identifier."""
    if _UUID.fullmatch(run) or _PLAIN.fullmatch(run) or (_ANYHEX.fullmatch(run) and len(run) in _DIGESTS):
        return False
    words = [x.lower() if x.isupper() else x for x in _WORD.findall(run)] if _IDENTIFIER.fullmatch(run) else [run]
    own = _encoding(vocabulary)
    return sum(map(len, words)) <= max_ratio * sum(len(own.encode_ordinary(x.decode("ascii"))) for x in words)


def _rests(run: bytes, base: list[tuple[int, int]], vocabulary: str, min_length: int, max_ratio: float) -> list[tuple[int, int]]:
    """Random stretches of a run that the base spans leave uncovered."""
    found, pos = [], 0
    for a, b in [*sorted(base), (len(run), len(run))]:
        if a > pos:
            rest, x, y = run[pos:a], pos, a
            if pos:
                x = a - len(rest.lstrip(_MARKS))
            if a < len(run):
                y = pos + len(rest.rstrip(_MARKS))
            rest = run[x:y]
            if len(rest) >= min_length:
                if is_random(rest, vocabulary, max_ratio):
                    found.append((x, y))
            elif len(rest) > 3 and is_random(rest, vocabulary, max_ratio) and is_random(run, vocabulary, max_ratio):
                found.append((x, y))
        pos = max(pos, b)
    return found


def _runs(mask: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, _ = c.word_spans(mask.view(np.uint8), off, np.array([True, False] + [True] * 254))
    keep = ends - starts >= least
    return starts[keep], ends[keep]


def find_spans(data: np.ndarray, off: np.ndarray, vocabulary: str, min_length: int = 20, max_ratio: float = 2.0) -> dict[int, list[tuple[int, int, int]]]:
    """Spans (start byte, kind number, end byte) in order, by row; rows without any are absent."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    raw = data.tobytes()
    low = raw.lower()  # ASCII only, as it is bytes
    bounds = off.tolist()
    rows = set()
    for word in _KEYWORDS:
        at = low.find(word)
        while at >= 0:
            r = int(np.searchsorted(off, at, "right")) - 1
            rows.add(r)
            at = low.find(word, bounds[r + 1])
    for r in rows:
        base = bounds[r]
        for m in _ASSIGN.finditer(raw[base : bounds[r + 1]]):
            if m.end(2) - m.start(2) >= 8:
                out.setdefault(r, []).append((m.start(), 0, m.end()))
    rows = set()
    at = raw.find(b"AKIA")
    while at >= 0:
        r = int(np.searchsorted(off, at, "right")) - 1
        rows.add(r)
        at = raw.find(b"AKIA", bounds[r + 1])
    for r in rows:
        for m in _ACCESS.finditer(raw[bounds[r] : bounds[r + 1]]):
            if m.end() - m.start() >= 16:
                out.setdefault(r, []).append((m.start(), 1, m.end()))
    for kind, (s, e) in ((2, _runs(_HEX[data], off, 32)), (3, _runs(_RUN[data], off, min_length))):
        for a, b, r in zip(s.tolist(), e.tolist(), (np.searchsorted(off, s, "right") - 1).tolist()):
            base = bounds[r]
            own = out.get(r, ())
            if kind == 3:
                covered = [(x[0] + base - a, x[2] + base - a) for x in own if x[1] < 3 and x[0] < b - base and a - base < x[2]]
                if covered:
                    for x, y in _rests(raw[a:b], covered, vocabulary, min_length, max_ratio):
                        out[r].append((a - base + x, kind, a - base + y))
                    continue
                if not is_random(raw[a:b], vocabulary, max_ratio):
                    continue
            out.setdefault(r, []).append((a - base, kind, b - base))
    for spans in out.values():
        spans.sort()
    return out


def _characters(text: np.ndarray, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans in code points."""
    before = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
    return [(int(before[a]), k, int(before[b])) for a, k, b in spans]


def _digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, vocabulary: str, min_length: int = 20, max_ratio: float = 2.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts by base kind, digest of the base spans, all spans as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            for i, j, data, off in c.text_chunks(batch, 1):
                n = j - i
                counts, shas, text = np.zeros((4, n), np.int64), [none] * n, [""] * n
                for r, spans in find_spans(data, off, vocabulary, min_length, max_ratio).items():
                    spans = _characters(data[off[r] : off[r + 1]], spans)
                    for _, k, _ in spans:
                        counts[k, r] += 1
                    shas[r] = hashlib.sha256(_digest([x for x in spans if x[1] < 3]).encode()).hexdigest()
                    text[r] = _digest(spans)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, n).cast(pa.int64()), *[pa.array(counts[k]) for k in range(3)], pa.array(shas, pa.string()), pa.array(text, pa.string()), pa.array(counts[3])],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"],
                )

    return c.keyed(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, vocabulary: str, mark: str = "[SECRET]", min_length: int = 20, max_ratio: float = 2.0, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with every span replaced by ``mark`` (overlapping spans by one) and nothing else changed.

    ``length_col`` names a column of character counts to bring up to date in changed rows.
    """
    at = docs.columns.index(text_col)
    length_at = docs.columns.index(length_col) if length_col else None
    new = mark.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            changed: dict[int, str] = {}
            for i, _, data, off in c.text_chunks(batch, at):
                for r, spans in find_spans(data, off, vocabulary, min_length, max_ratio).items():
                    raw, out, pos = data[off[r] : off[r + 1]].tobytes(), [], 0
                    for a, _, b in spans:
                        if a >= pos:
                            out += [raw[pos:a], new]
                        pos = max(pos, b)
                    changed[i + r] = b"".join([*out, raw[pos:]]).decode()
            if changed:
                columns = list(batch.columns)
                kept = columns[at].to_pylist()
                for r, x in changed.items():
                    kept[r] = x
                columns[at] = pa.array(kept, columns[at].type)
                if length_at is not None:
                    sizes = columns[length_at].to_pylist()
                    for r, x in changed.items():
                        sizes[r] = len(x)
                    columns[length_at] = pa.array(sizes, columns[length_at].type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return c.map_rows(docs, run)
