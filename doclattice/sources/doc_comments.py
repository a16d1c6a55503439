"""Doc comments to tags: description, parameters, returns, throws, examples and the rest.

Braces may nest, so a comment is parsed by a function, in Arrow batches; what it returns is a
struct of flat arrays for the surface tables.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA = "struct<description:string,params:array<struct<name:string,type:string,optional:boolean,default_value:string,description:string>>,returns:struct<type:string,description:string>,throws:array<struct<type:string,description:string>>,examples:array<struct<title:string,language:string,code:string>>,tags:array<struct<name:string,text:string>>>"
_TEXT = pa.struct([("type", pa.string()), ("description", pa.string())])
_PARAM = pa.struct([("name", pa.string()), ("type", pa.string()), ("optional", pa.bool_()), ("default_value", pa.string()), ("description", pa.string())])
_EXAMPLE = pa.struct([("title", pa.string()), ("language", pa.string()), ("code", pa.string())])
_ARROW = pa.struct([("description", pa.string()), ("params", pa.list_(_PARAM)), ("returns", _TEXT), ("throws", pa.list_(_TEXT)), ("examples", pa.list_(_EXAMPLE)), ("tags", pa.list_(pa.struct([("name", pa.string()), ("text", pa.string())])))])
_TAG = re.compile(r"\s*@(\w+)\s?(.*)$")
ALIASES = {"arg": "param", "argument": "param", "parameter": "param", "return": "returns", "throw": "throws", "exception": "throws", "inheritdoc": "inheritDoc"}


def clean(text: str) -> str:
    text = re.sub(r"^\s*/\*\*+", "", text)
    text = re.sub(r"\*+/\s*$", "", text)
    return re.sub(r"(?m)^[ \t]*\*[ \t]?", "", text).strip()


def closing_brace(text: str, start: int = 0) -> int:
    """Place of the brace that closes the one at ``start``, or -1."""
    depth = 0
    for i in range(start, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if depth == 0:
            return i
    return -1


def typed(text: str) -> tuple[str | None, str]:
    """A leading ``{type}`` and the rest."""
    text = text.strip()
    if text.startswith("{") and (end := closing_brace(text)) > 0:
        return text[1:end].strip() or None, text[end + 1 :].strip()
    return None, text


def undash(text: str) -> str:
    return re.sub(r"^\s*[-–—]\s*", "", text).strip()


def param(text: str) -> dict:
    """``{T} [name=default] - text``; brackets mean optional."""
    kind, rest = typed(text)
    if rest.startswith("["):
        depth = end = 0
        for end, ch in enumerate(rest):
            depth += (ch == "[") - (ch == "]")
            if depth == 0:
                break
        name, _, default = rest[1:end].partition("=")
        return {"name": name.strip(), "type": kind, "optional": True, "default_value": default.strip() or None, "description": undash(rest[end + 1 :])}
    name, _, about = rest.partition(" ") if " " in rest else re.split(r"(\s)", rest, maxsplit=1) if re.search(r"\s", rest) else (rest, "", "")
    return {"name": name, "type": kind, "optional": bool(kind and kind.endswith("=")), "default_value": None, "description": undash(about)}


def example(text: str) -> dict:
    """A title unless the first line looks like code, the fence's language, the code."""
    first, _, rest = text.strip().partition("\n")
    title = None
    caption = re.match(r"<caption>(.*?)</caption>\s*", text.strip(), re.S)
    body = text.strip()
    if caption:
        title, body = caption[1].strip(), body[caption.end() :]
    elif rest and not first.startswith("```") and not re.search(r"[(){};=]|=>|^\s*(import|const|let|var|await|return)\b", first):
        title, body = first.strip(), rest
    fence = re.search(r"```([\w-]*)[^\n]*\n(.*?)\n?```", body, re.S)
    return {"title": title, "language": (fence[1] or None) if fence else None, "code": (fence[2] if fence else body).strip()}


def parse(text: str | None) -> dict | None:
    """A comment's parts; null for null."""
    if text is None:
        return None
    out = {"description": "", "params": [], "returns": None, "throws": [], "examples": [], "tags": []}
    parts: list[tuple[str | None, list[str]]] = [(None, [])]
    fenced = False
    for line in clean(text).split("\n"):
        fenced ^= "```" in line and line.strip().startswith("```")
        m = None if fenced or "@" not in line else _TAG.match(line)
        if m:
            parts.append((m[1], [m[2]]))
        else:
            parts[-1][1].append(line)
    for tag, lines in parts:
        body = "\n".join(lines).strip()
        if tag is None:
            out["description"] = body
            continue
        name = ALIASES.get(tag.lower(), tag)
        if name == "param":
            out["params"].append(param(body))
        elif name == "returns":
            kind, about = typed(body)
            out["returns"] = {"type": kind, "description": undash(about)}
        elif name == "throws":
            kind, about = typed(body)
            if kind is None and (m := re.match(r"([A-Z][\w.]*)\s+(.*)$", about, re.S)):
                kind, about = m[1], m[2]
            out["throws"].append({"type": kind, "description": undash(about)})
        elif name == "example":
            out["examples"].append(example(body))
        out["tags"].append({"name": name, "text": body})
    return out


def _parse_all(text: pa.Array) -> pa.Array:
    return pa.array([parse(t) or {} for t in text.to_pylist()], _ARROW)


def parse_comment(text: Column | str) -> Column:
    """The parts of doc comments as a struct column.

    Called nondeterministic, as the optimizer else evaluates it twice: for a filter on what it
    returns, below any repartitioning, and for the rows that pass.
    """
    return F.arrow_udf(_parse_all, SCHEMA).asNondeterministic()(text)
