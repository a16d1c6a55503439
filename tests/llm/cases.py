"""Small tables with the awkward cases, and brute-force versions of the operators."""

from __future__ import annotations

import re
import zlib

EXTRA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept boolean, root bigint, key string, salt int, gone bigint, sig binary, `home` int, bands array<int>, `with space` string"

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
WORD = "river stone bright window garden paper silent market yellow engine harbor winter copper violet thunder basket candle meadow rocket saddle timber velvet walnut zipper anchor bishop castle dragon ember falcon".split()


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 1
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORD[(x >> 8) % len(WORD)] + ("", "s", "ed", "ly", "ü")[(x >> 16) % 5])
    return " ".join(out)


def documents() -> list[tuple[int | None, str | None]]:
    base, shared = prose(1, 120), prose(77, 70)
    rows: list[tuple[int | None, str | None]] = [
        (10, base),
        (11, base),
        (12, base.replace("garden", "GARDEN")),
        (13, base + " and an end"),
        (14, base.replace("river", "rivulet", 1)),
        (20, prose(2, 90) + " " + shared),
        (21, shared + " " + prose(3, 60)),
        (22, "Straße " + prose(4, 30) + "\n" + shared + "\nñandú " + prose(5, 5)),
        (30, None),
        (31, ""),
        (32, "   \n\t "),
        (33, "one two three"),
        (34, "One TWO three"),
        (35, "!!! ... ???"),
        (36, "日本語 текст ελληνικά"),
        (40, prose(6, 4000)),
        (41, "x" * 3000),
        (42, "ab" * 700),
        (50, prose(8, 200)),
        (100, prose(9, 150)),
        (100, prose(9, 150)),
        (101, prose(10, 3)),
        (102, "a  b   c\n\n d \n\n\te's we'll 12½ <|endoftext|> end "),
        (None, base),
        (None, None),
        (-5, prose(11, 50)),
    ]
    return rows


def frame(spark, rows=None):
    """The rows with extra columns whose names operators might use themselves."""
    rows = documents() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 0.5, True, 1, "k", 3, 7, b"x", 2, [1], "y") for i, t in rows], EXTRA)


def words7(text: str | None) -> list[bytes]:
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))


def words8(text: str | None) -> list[bytes]:
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(LOWER))


def crc(ids: list[int]) -> int:
    return zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))


def components(rows, percent: int = 70) -> dict[int, tuple[int, int]]:
    """doc_id -> (shingles, component), of rows with distinct ids."""
    sets = {}
    for i, t in rows:
        w = words7(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}
