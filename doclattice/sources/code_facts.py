"""Facts of code snippets: imports, calls, method calls, instances, declarations, identifiers.

A small tokenizer (strings, templates, comments, regular expressions by guess, brackets)
stands in for a parser; it is approximate by design. Syntax errors are unbalanced brackets
and unclosed strings. ``facts`` runs it as one Arrow pass over all blocks and yields flat
rows, so that everything after it is joins.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "path string, block int, pos int, fact string, name string, object string, module string, kind string, line int"
KEYWORDS = frozenset("abstract any as async await boolean break case catch class const continue debugger declare default delete do else enum export extends false finally for from function get if implements import in instanceof interface keyof let module namespace never new null number of package private protected public readonly return set static string super switch symbol this throw true try type typeof undefined unknown var void while with yield".split())
GLOBALS = frozenset("Array ArrayBuffer BigInt Boolean Buffer Date Error Infinity Intl JSON Map Math NaN Number Object Promise Proxy Reflect RegExp Request Response Set String Symbol URL URLSearchParams WeakMap WeakSet clearInterval clearTimeout console decodeURIComponent document encodeURIComponent exports fetch global globalThis isNaN localStorage module navigator parseFloat parseInt process queueMicrotask require setInterval setTimeout structuredClone window".split())

_TOKEN = re.compile(
    r"""(?P<space>[ \t\r]+)|(?P<newline>\n)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>'(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*"|`(?:\\.|[^`\\])*`)|(?P<number>\d[\w.]*)|(?P<name>[A-Za-z_$][\w$]*)|(?P<op>=>|\?\.|\.\.\.|&&|\|\||\?\?|[=!]==?|[-+*/%&|^<>]=?|[{}()\[\];,.:?~@#!\\])|(?P<bad>['"`].*|.)""",
    re.S,
)
_LITERAL = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\n])*\]|[^/\\\n])+/[a-z]*")
_CLOSE = {")": "(", "]": "[", "}": "{"}


def tokens(code: str) -> Iterator[tuple[str, str, int]]:
    """(kind, text, line from 0); regular expressions count as strings."""
    line, pos, before = 0, 0, ""
    while pos < len(code):
        if code[pos] == "/" and code[pos : pos + 2] not in ("//", "/*") and (before in "=(,:[!&|?{};" or before in ("return", "=>", "")):
            m = _LITERAL.match(code, pos)
            if m:
                yield "string", m[0], line
                pos, before = m.end(), "x"
                continue
        m = _TOKEN.match(code, pos)
        kind, text = m.lastgroup, m[0]
        pos = m.end()
        if kind == "newline":
            line += 1
            continue
        if kind == "space":
            continue
        if kind != "comment":
            yield kind, text, line
            before = text
        line += text.count("\n")


def syntax_error(code: str) -> str | None:
    """What is unbalanced, if anything."""
    return _unbalanced(tokens(code))


def _unbalanced(toks: Iterable[tuple[str, str, int]]) -> str | None:
    open_: list[str] = []
    for kind, text, line in toks:
        if kind == "bad" and text[0] in "'\"`":
            return f"unclosed string in line {line + 1}"
        if kind == "op" and text in "([{":
            open_.append(text)
        elif kind == "op" and text in _CLOSE:
            if not open_ or open_.pop() != _CLOSE[text]:
                return f"unexpected {text} in line {line + 1}"
    return f"unclosed {open_[-1]}" if open_ else None


def _imports(toks: list[tuple[str, str, int]], i: int) -> tuple[list[tuple], int]:
    """Facts of an import statement at token i, and the token after it."""
    line, names, j = toks[i][2], [], i + 1
    only = j < len(toks) and toks[j][1] == "type" and j + 1 < len(toks) and toks[j + 1][1] not in ("from", ",")
    j += only
    if j < len(toks) and toks[j][0] == "string":
        return [("import", "", None, toks[j][1][1:-1], "side-effect", line)], j + 1
    while j < len(toks) and toks[j][1] != "from" and toks[j][1] != ";":
        kind, text, _ = toks[j]
        if text == "*" and j + 2 < len(toks) and toks[j + 1][1] == "as":
            names.append((toks[j + 2][1], None, "namespace"))
            j += 3
            continue
        if text == "{":
            j += 1
            while j < len(toks) and toks[j][1] != "}":
                if toks[j][1] == "type" and j + 1 < len(toks) and toks[j + 1][0] == "name" and toks[j + 1][1] != "as":
                    j += 1
                if toks[j][0] == "name":
                    name, local = toks[j][1], toks[j][1]
                    if j + 2 < len(toks) and toks[j + 1][1] == "as":
                        local = toks[j + 2][1]
                        j += 2
                    names.append((name, local, "named"))
                j += 1
        elif kind == "name":
            names.append((text, text, "default"))
        j += 1
    if j + 1 < len(toks) and toks[j][1] == "from" and toks[j + 1][0] == "string":
        module = toks[j + 1][1][1:-1]
        return [("import", n, local or n, module, ("type-" if only else "") + k, line) for n, local, k in names], j + 2
    return [], i + 1


def snippet_facts(code: str) -> list[tuple[str, str, str | None, str | None, str | None, int]]:
    """(fact, name, object or local name, module, kind, line from 0) of a snippet.

    Facts: import, call, method, new, local (a declaration), param, derived (``x = call()``:
    name x, object what is called), identifier, error.
    """
    toks = [t for t in tokens(code)]
    out: list[tuple] = []
    text = [t[1] for t in toks] + [""] * 4
    kind = [t[0] for t in toks] + [""] * 4
    i, depth = 0, 0
    while i < len(toks):
        word, line = text[i], toks[i][2]
        if word in "([{" and kind[i] == "op":
            depth += 1
        elif word in ")]}" and kind[i] == "op":
            depth -= 1
        if kind[i] != "name":
            # (a, b) => and a =>: parameters
            if word == "(" :
                j, level, names, simple = i + 1, 1, [], True
                while j < len(toks) and level:
                    level += (text[j] in "([{") - (text[j] in ")]}") if kind[j] == "op" else 0
                    if kind[j] == "name" and text[j - 1] in "(,{[" and text[j] not in KEYWORDS:
                        names.append((text[j], toks[j][2], text[j + 2] if text[j + 1] == ":" and kind[j + 2] == "name" else None))
                    j += 1
                arrow = text[j] == "=>" or (text[j] == ":" and "=>" in text[j : j + 6])
                declared = i and (text[i - 1] == "function" or (i > 1 and text[i - 2] == "function"))
                if simple and (arrow or declared):
                    out += [("param", n, None, None, t, ln) for n, ln, t in names]
            i += 1
            continue
        if word == "import" and depth == 0 and text[i + 1] not in ("(", "."):
            found, i = _imports(toks, i)
            out += found
            continue
        if word in ("const", "let", "var"):
            j, names = i + 1, []
            if text[j] in "{[" and kind[j] == "op":
                close = {"{": "}", "[": "]"}[text[j]]
                while j < len(toks) and text[j] != close:
                    if kind[j] == "name" and text[j + 1] != ":":
                        names.append(text[j])
                    j += 1
                j += 1
            elif kind[j] == "name":
                names.append(text[j])
                j += 1
                if text[j] == ":":
                    while j < len(toks) and text[j] not in ("=", ";"):
                        j += 1
            out += [("local", n, None, None, word, line) for n in names]
            if text[j] == "=":
                j += 1
                while text[j] in ("await", "new"):
                    j += 1
                if kind[j] == "name" and text[j] not in KEYWORDS:
                    root, k = text[j], j
                    while text[k + 1] in (".", "?."):
                        k += 2
                    if text[k + 1] in ("(", "<") or text[j - 1] == "new":
                        out += [("derived", n, root, None, None, line) for n in names]
            i += 1
            continue
        if word in ("function", "class", "interface", "enum", "type") and kind[i + 1] == "name" and text[i + 1] not in KEYWORDS:
            out.append(("local", text[i + 1], None, None, word, line))
            i += 2
            continue
        if word == "new" and kind[i + 1] == "name":
            out.append(("new", text[i + 1], None, None, None, line))
            i += 1
            continue
        after_dot = i > 0 and text[i - 1] in (".", "?.")
        calls = text[i + 1] == "(" or (text[i + 1] == "?." and text[i + 2] == "(")
        if word not in KEYWORDS:
            if after_dot:
                if calls and i >= 2 and kind[i - 2] == "name":
                    head = text[i - 2]
                    if i >= 4 and text[i - 3] in (".", "?."):
                        head = f"{text[i - 4]}.{head}" if kind[i - 4] == "name" else ""
                        if i >= 6 and text[i - 5] in (".", "?."):
                            head = ""
                    if head and head.split(".")[0] not in GLOBALS:
                        out.append(("method", word, head, None, None, line))
            else:
                is_key = text[i + 1] == ":" and i > 0 and text[i - 1] in "{,"
                if calls and not (i and text[i - 1] == "function"):
                    out.append(("call", word, None, None, None, line))
                if not is_key:
                    out.append(("identifier", word, None, None, "call" if calls else "type" if i and text[i - 1] in (":", "as", "<", "extends") else "value", line))
        elif word == "this" and text[i + 1] == "." and kind[i + 2] == "name" and text[i + 3] == "(":
            out.append(("method", text[i + 2], "this", None, None, toks[i + 2][2]))
        i += 1
    bad = _unbalanced(toks)
    if bad:
        out.append(("error", bad, None, None, None, 0))
    return out


def facts(blocks: DataFrame) -> DataFrame:
    """Facts of all blocks (path, block, code, line_start); ``line`` is the fence line plus the line in the snippet from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for path, block, code, start in zip(*(batch.column(k).to_pylist() for k in range(4))):
                for pos, (fact, name, obj, module, kind, line) in enumerate(snippet_facts(code or "")):
                    out.append((path, block, pos, fact, name, obj, module, kind, (start or 0) + line))
            types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32()]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], names=names)

    return blocks.select("path", "block", "code", "line_start").mapInArrow(run, SCHEMA)
