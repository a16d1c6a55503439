"""Scalar functions as Column expressions; all of them stay inside generated code.

They pin down semantics in which SQL differs from the rules that the operators follow:
rounding goes half up towards plus infinity, trimming removes every blank character, and a
predicate over a null is false, never unknown.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BARS = "▁▂▃▄▅▆▇█"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- numbers


def half_up(x: Column | str) -> Column:
    """Nearest integer; halves go up, also for negative numbers."""
    return F.floor(col(x).cast("double") + F.lit(0.5)).cast("int")


def percent(part: Column | str, whole: Column | str, empty: int = 100) -> Column:
    """Rounded share in percent; ``empty`` where the whole is zero."""
    p, w = col(part).cast("double"), col(whole).cast("double")
    return F.when(w > 0, half_up(100.0 * p / F.nullif(w, F.lit(0.0)))).otherwise(F.lit(empty)).cast("int")


def documented_share(documented: str = "documented", exports: str = "exports") -> Column:
    return percent(documented, exports)


# -- text


def trim(x: Column | str) -> Column:
    """Without blank characters of any kind at the ends."""
    return F.regexp_replace(col(x), r"^\s+|\s+$", "")


def truthy(x: Column | str) -> Column:
    """Not null and not empty."""
    return F.coalesce(F.length(col(x)) > 0, F.lit(False))


def present(x: Column | str) -> Column:
    """Not null and not blank."""
    return F.coalesce(col(x).rlike(r"\S"), F.lit(False))


def found(x: Column | str, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null where there is none."""
    return F.when(col(x).rlike(pattern), F.regexp_extract(col(x), pattern, group))


def camel_words(x: Column | str) -> Column:
    """Lower-case words of an identifier in camel, Pascal, snake or kebab case; runs of capitals are one word."""
    spaced = F.regexp_replace(col(x), r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")
    return F.filter(F.split(F.lower(spaced), r"[\s_\-]+"), lambda w: w != "")


def camel_words_simple(x: Column | str) -> Column:
    """Lower-case words split before capitals only."""
    return F.filter(F.split(F.lower(F.regexp_replace(col(x), r"([a-z])([A-Z])", "$1 $2")), " "), lambda w: w != "")


def compound_words(x: Column | str) -> Column:
    """Parts of a lower-cased name at marks."""
    return F.filter(F.split(F.lower(col(x)), r"[\s_\-./:]+"), lambda w: w != "")


def strip_fence(x: Column | str) -> Column:
    """Example code without the fence lines around it."""
    return trim(F.regexp_replace(F.regexp_replace(trim(x), r"^```[A-Za-z]*\s*\n?", ""), r"\n?```\s*$", ""))


def lines(x: Column | str) -> Column:
    return F.split(col(x), r"\r?\n", -1)


def content_hash(x: Column | str, length: int = 16) -> Column:
    return F.substring(F.sha2(col(x), 256), 1, length)


# -- types


def normalize_type(x: Column | str) -> Column:
    """One blank between parts, none around angle brackets and commas' left; a type without blanks is left as it is."""
    one = F.regexp_replace(col(x), r"\s+", " ")
    return F.when(col(x).rlike(r"\s"), trim(F.regexp_replace(F.regexp_replace(one, r"\s*<\s*", "<"), r"\s*>", ">"))).otherwise(col(x))


def types_equivalent(a: Column | str, b: Column | str) -> Column:
    """Equal after normalization, or both of them names for no value."""
    return same_type(normalize_type(a), normalize_type(b))


def same_type(x: Column, y: Column) -> Column:
    """``types_equivalent`` of types that are normalized."""
    nothing = ["void", "undefined"]
    return F.coalesce((x == y) | (F.lower(x).isin(nothing) & F.lower(y).isin(nothing)), F.lit(False))


def unwrap_promise(x: Column | str) -> Column:
    return F.coalesce(found(x, r"(?i)^promise<(.+)>$"), col(x))


def is_promise(x: Column | str) -> Column:
    return F.coalesce(F.lower(col(x)).startswith("promise<") | (F.lower(col(x)) == "promise"), F.lit(False))


def schema_type(x: Column | str) -> Column:
    """Type of a JSON schema: the string itself, its ``type``, or the name that its ``$ref`` ends in."""
    v = col(x)
    plain = found(v, r'^"(.*)"$')
    ref = F.regexp_replace(F.get_json_object(v, "$['$ref']"), "^#/types/", "")
    return F.coalesce(plain, F.get_json_object(v, "$.type"), ref, F.when(~v.startswith("{"), v))


def braces_type(x: Column | str) -> Column:
    """What a tag's leading braces hold, up to the first closing one."""
    return F.nullif(trim(F.regexp_extract(col(x), r"^\s*\{([^}]*)\}", 1)), F.lit(""))


def template_tag(x: Column | str) -> Column:
    """Struct (name, constraint) of a type-parameter tag: ``{C} T`` or ``T extends C - text``."""
    t = trim(x)
    braced = F.struct(F.regexp_extract(t, r"^\{([^}]*)\}\s*(\w+)", 2).alias("name"), trim(F.regexp_extract(t, r"^\{([^}]*)\}\s*(\w+)", 1)).alias("constraint"))
    named = F.struct(F.regexp_extract(t, r"^(\w+)", 1).alias("name"), F.nullif(trim(F.regexp_extract(t, r"^\w+\s+extends\s+(.+?)(?:\s+[-–]\s.*)?$", 1)), F.lit("")).alias("constraint"))
    return F.when(t.rlike(r"^\{[^}]*\}\s*\w+"), braced).otherwise(named)


# -- examples and comments


def assertions(code: Column | str) -> Column:
    """Array of (line, expected) for comments of the form ``// => value``."""
    found_ = F.transform(lines(code), lambda v, i: F.struct((i + 1).alias("line"), F.nullif(trim(F.regexp_extract(v, r"//\s*=>\s*(.+)$", 1)), F.lit("")).alias("expected")))
    return F.filter(found_, lambda s: s["expected"].isNotNull())


def has_plain_comment(code: Column | str) -> Column:
    """A line comment that isn't an assertion."""
    return F.coalesce(col(code).rlike(r"//(?!\s*=>)"), F.lit(False))


def error_line(stderr: Column | str) -> Column:
    """The first line that names an error, else the first line, cut at 100 characters."""
    all_ = F.filter(F.transform(lines(stderr), trim), lambda v: v != "")
    named = F.filter(all_, lambda v: v.rlike(r"^(\w*Error|\w*Exception)\b"))
    return F.substring(F.coalesce(F.try_element_at(named, F.lit(1)), F.try_element_at(all_, F.lit(1)), F.lit("")), 1, 100)


def clean_comment(x: Column | str) -> Column:
    """Text of a doc comment without its delimiters and leading stars."""
    inner = F.regexp_replace(F.regexp_replace(col(x), r"^\s*/\*\*+", ""), r"\*+/\s*$", "")
    return trim(F.regexp_replace(inner, r"(?m)^[ \t]*\*[ \t]?", ""))


def link_targets(x: Column | str) -> Column:
    """Targets of inline links, see and inheritance marks of a text, in order."""
    return F.transform(F.regexp_extract_all(col(x), F.lit(r"\{@(?:link|linkcode|linkplain|see|inheritDoc)\s+([^}|\s]+)[^}]*\}"), 1), trim)


def render_links(x: Column | str) -> Column:
    """Inline links as their label (after a bar or blank), else their target."""
    labelled = F.regexp_replace(col(x), r"\{@(?:link|linkcode|linkplain)\s+[^}|\s]+(?:\s*\|\s*|\s+)([^}]+?)\s*\}", "$1")
    return F.regexp_replace(labelled, r"\{@(?:link|linkcode|linkplain)\s+([^}\s]+)\s*\}", "$1")


def parse_replacement(reason: Column | str) -> Column:
    """The name in ``use X instead``."""
    return found(reason, r"(?i)\buse\s+[`]*((?:\w|\$)[\w.$]*)[`]*\s+instead\b")


def key_token(x: Column | str) -> Column:
    """Identifier before the first dot, null for anything else."""
    head = F.substring_index(trim(x), ".", 1)
    return F.when(head.rlike(r"^(?:[A-Za-z_]|\$)[\w$]*$"), head)


def context_snippet(code: Column | str, name: Column | str) -> Column:
    """The first line that holds the name with its neighbours, else the first 100 characters."""
    all_ = lines(code)
    at = F.array_position(F.transform(all_, lambda v: F.contains(v, col(name))), F.lit(True)).cast("int")
    begin = F.greatest(at - 1, F.lit(1))
    return F.when(at > 0, F.array_join(F.slice(all_, begin, at - begin + 2), "\n")).otherwise(F.substring(col(code), 1, 100))


# -- rendering


def _bars(values: Column, index) -> Column:
    low, high = F.array_min(values), F.array_max(values)
    span = F.when(high > low, (high - low).cast("double")).otherwise(F.lit(1.0))
    return F.array_join(F.transform(values, lambda v: F.substring(F.lit(BARS), index((v - low).cast("double") / span).cast("int") + 1, F.lit(1))), "")


def sparkline(values: Column | str) -> Column:
    """Eight bars, each an eighth of the range."""
    return _bars(col(values), lambda x: F.least(F.floor(x * 8), F.lit(7)))


def sparkline_rounded(values: Column | str) -> Column:
    """Eight bars, values rounded to the nearest."""
    return _bars(col(values), lambda x: F.least(F.floor(x * 7 + 0.5), F.lit(7)))


def delta_glyph(d: Column | str) -> Column:
    return F.when(col(d) > 0, F.concat(F.lit("↑"), col(d).cast("string"))).when(col(d) < 0, F.concat(F.lit("↓"), F.abs(col(d)).cast("string"))).otherwise(F.lit("→"))


def duration_text(ms: Column | str) -> Column:
    m = col(ms).cast("bigint")
    minutes, seconds = F.floor(m / 60000), half_up((m % 60000) / 1000)
    return F.when(m < 1000, F.concat(m.cast("string"), F.lit("ms"))).when(m < 60000, F.concat(F.format_number(m / 1000.0, 1), F.lit("s"))).otherwise(F.concat(minutes.cast("string"), F.lit("m "), seconds.cast("string"), F.lit("s")))


def escape_data(x: Column | str) -> Column:
    """Percent-escapes that keep a message on one line of CI output."""
    out = F.replace(col(x), F.lit("%"), F.lit("%25"))
    return F.replace(F.replace(out, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def escape_property(x: Column | str) -> Column:
    return F.replace(F.replace(escape_data(x), F.lit(":"), F.lit("%3A")), F.lit(","), F.lit("%2C"))


def summary_line(counts: dict[str, Column]) -> Column:
    """``3 structural, 1 prose``: the categories that aren't zero."""
    parts = [F.when(v > 0, F.concat_ws(" ", v.cast("string"), F.lit(k))) for k, v in counts.items()]
    return F.coalesce(F.nullif(F.concat_ws(", ", *parts), F.lit("")), F.lit("no issues"))


# -- places and times


def week_start(d: Column | str) -> Column:
    """The Sunday on or before a date."""
    day = F.to_date(col(d))
    return F.date_sub(day, F.dayofweek(day) - 1)


def snapshot_name(ts: Column | str) -> Column:
    return F.concat(F.date_format(col(ts), "yyyy-MM-dd'T'HH-mm-ss"), F.lit(".json"))


def unescape_pointer(x: Column | str) -> Column:
    """A segment of a JSON pointer."""
    return F.replace(F.replace(col(x), F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def repository(url: Column | str, ref: str = "main") -> Column:
    """Struct (owner, repo, ref) of a repository address in any of its shapes."""
    rest = F.regexp_replace(F.regexp_replace(trim(url), r"^(?:git\+)?(?:https?://|git@|ssh://git@)?(?:www\.)?(?:[\w-]+\.)+[a-z]+[:/]", ""), r"(?:\.git)?/*$", "")
    parts = F.split(rest, "/")
    return F.struct(F.try_element_at(parts, F.lit(1)).alias("owner"), F.regexp_replace(F.try_element_at(parts, F.lit(2)), r"\.git$", "").alias("repo"), F.coalesce(F.nullif(F.regexp_extract(rest, r"/(?:tree|blob)/([^/]+)", 1), F.lit("")), F.lit(ref)).alias("ref"))


def report_path(name: Column | str, kind: str = "json", other: Column | None = None) -> Column:
    """Where a report lies: by name, or by short hashes of the two sides of a comparison."""
    ext = {"json": "json", "markdown": "md", "html": "html"}[kind]
    if other is None:
        return F.concat(F.lit("reports/"), col(name), F.lit(f".{ext}"))
    return F.concat(F.lit("reports/diff-"), content_hash(name, 8), F.lit("-"), content_hash(other, 8), F.lit(f".{ext}"))
