"""Exact, fast encoding with the ``tokenizers`` library.

A byte-level BPE splits a text into pieces by a pattern and encodes each piece by itself.
The library spends most of its time on splitting and on making objects for each token, and the
pieces of a corpus repeat, so the encoder splits texts itself and has the library's model encode
each distinct piece once. Texts with characters outside the ranges for which the split pattern is
written out below, or with a special token's string, go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

from .common import CACHES

_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBER = "0-9²³¹¼-¾"
_SPACE = r"\t-\r \x85\xa0"
_PIECE = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Characters for which the classes above are those of the library.
_OTHER = re.compile("[^\x00-ɏ‐-‧‰-⁞€]")
#: The character that stands for each byte in the vocabulary of a byte-level model: itself where it is visible, else the next one from U+0100.
_SEEN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE = {b: chr(b) for b in _SEEN} | {b: chr(0x100 + k) for k, b in enumerate(sorted({*range(256)} - {*_SEEN}))}
#: Pieces kept by a worker, some 250 bytes each; those met later are encoded for their batch only.
KEPT_PIECES = 400_000


class Encoder:
    """Token ids of texts as bytes of ``dtype``; equal to ``encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str, kept: int | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.split = spec["model"]["type"] == "BPE" and spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.pieces: dict[str, bytes] = {}
        self.kept = kept

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn(self, new: list[str], known: dict[str, bytes]) -> None:
        """Encode pieces that are new: each is one word of the model, in the characters that stand for its bytes."""
        tokenize, k = self.tokenizer.model.tokenize, self.dtype.itemsize
        for i in range(0, len(new), 8192):
            part, ids, ends = new[i : i + 8192], [], [0]
            for x in part:
                word = x.replace(" ", _BYTE[32]) if x.isascii() and x.isprintable() else x.encode().decode("latin-1").translate(_BYTE)
                ids += [t.id for t in tokenize(word)]
                ends.append(len(ids))
            raw = np.array(ids, self.dtype).tobytes()
            known.update((x, raw[p * k : q * k]) for x, p, q in zip(part, ends, ends[1:]))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text (null: empty)."""
        out: list[bytes] = [b""] * len(texts)
        split: list[tuple[int, list[str]]] = []
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.split or (not text.isascii() and _OTHER.search(text)) or any(s in text for s in self.special):
                out[i] = self._whole(text)
            else:
                split.append((i, _PIECE.findall(text)))
        get, missing, late = self.pieces.get, set(), []
        for i, p in split:
            ids = list(map(get, p))
            if None in ids:
                gaps, k = [], -1
                for _ in range(ids.count(None)):
                    k = ids.index(None, k + 1)
                    gaps.append(k)
                missing.update([p[k] for k in gaps])
                late.append((i, p, ids, gaps))
            else:
                out[i] = b"".join(ids)
        if missing:
            known = self.pieces if len(self.pieces) + len(missing) <= (self.kept or KEPT_PIECES) else {}
            self._learn(list(missing), known)
            for i, p, ids, gaps in late:
                for k in gaps:
                    ids[k] = known[p[k]]
                out[i] = b"".join(ids)
        return out


@lru_cache(maxsize=1)
def _encoder(path: str, kept: int | None) -> Encoder:
    return Encoder(path, kept)


def encoder(path: str, kept: int | None = None) -> Encoder:
    """The worker's encoder, which keeps ``kept`` pieces, else ``KEPT_PIECES``; it lives until a task of another operator comes."""
    if not CACHES:
        CACHES.append(_encoder.cache_clear)
    return _encoder(path, kept)
