"""Fuzzy matching of names, with blocking in place of comparisons of all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import camel_words, camel_words_simple, col, compound_words, half_up

FALLBACK = 50


def _common(a: Column, b: Column) -> Column:
    """How many words of ``a`` are also in ``b``."""
    return F.size(F.filter(a, lambda w: F.array_contains(b, w)))


def closeness(source: Column, candidate: Column) -> Column:
    """Score of a candidate, null where it is none.

    Words in common (a common last word counts one and a half) must be worth two; their share
    of the longer name and the closeness of the spelling make the score.
    """
    a, b = camel_words(source), camel_words(candidate)
    suffix = F.coalesce(F.try_element_at(a, F.lit(-1)) == F.try_element_at(b, F.lit(-1)), F.lit(False))
    last = F.try_element_at(a, F.lit(-1))
    rest = F.when(suffix, F.filter(a, lambda w: w != last)).otherwise(a)
    matched = F.when(suffix, 1.5).otherwise(0.0) + _common(rest, b)
    weight = matched / F.greatest(F.size(a), F.size(b), F.lit(1)).cast("double")
    spelling = 1 - F.levenshtein(F.lower(source), F.lower(candidate)).cast("double") / F.greatest(F.length(source), F.length(candidate), F.lit(1)).cast("double")
    total = F.when(suffix, 1.5 * weight + spelling).otherwise(weight + 0.5 * spelling)
    fits = (source != candidate) & (matched >= 2) & (weight >= F.when(suffix, 0.2).otherwise(0.3)) & (total >= 0.5)
    return F.when(fits, total)


def _word_pairs(words: Column, every_word: bool) -> Column:
    """Two words of a name, in order, for all of them; a word with itself if it is repeated, or for ``every_word``."""
    own = F.array_sort(F.array_distinct(words))
    pairs = F.flatten(F.transform(own, lambda w, i: F.transform(F.slice(own, i + 2, F.size(own)), lambda v: F.concat_ws(" ", w, v))))
    twice = own if every_word else F.filter(own, lambda w: F.size(F.filter(words, lambda v: v == w)) > 1)
    return F.concat(pairs, F.transform(twice, lambda w: F.concat_ws(" ", w, w)))


def closest(sources: DataFrame, candidates: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The best candidate of each source (source, candidate, score, distance); ties keep the earliest.

    ``candidates`` has candidate and pos. Names with the same first letter (case ignored) and
    lengths that differ by at most three are compared; sources without any are compared with
    the first ``FALLBACK`` candidates instead. As a candidate needs two words in common, pairs
    are found by an equi-join on the letter and two words of the name (a word that the source
    repeats stands for two), so names that share a common word alone never meet.
    """
    by = by or []
    letter = lambda c: F.lower(F.substring(c, 1, 1))
    left = sources.distinct().withColumns({"letter": letter("source"), "keys": _word_pairs(camel_words("source"), False)})
    right = candidates.withColumns({"letter": letter("candidate"), "keys": _word_pairs(camel_words("candidate"), True)})
    # outer, as the optimizer else forms the pairs of every row before names are made distinct, for a filter of those with any
    left, right = (x.withColumn("key", F.explode_outer("keys")).drop("keys").where("key IS NOT NULL") for x in (left, right))
    near = left.join(right, [*by, "letter", "key"]).where(F.abs(F.length("source") - F.length("candidate")) <= 3).select(*by, "source", "candidate", "pos").distinct()
    # whether there is any name to compare with depends on letters and lengths alone
    sizes = candidates.select(*by, letter("candidate").alias("letter"), F.length("candidate").alias("size")).distinct()
    met = sources.withColumns({"letter": letter("source"), "size": F.explode(F.sequence(F.length("source") - 3, F.length("source") + 3))}).join(sizes, [*by, "letter", "size"], "left_semi").select(*by, "source").distinct()
    lonely = sources.join(met, [*by, "source"], "left_anti")
    if by:
        first = candidates.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy("pos"))).where(F.col("__n") <= FALLBACK).drop("__n")
        rest = lonely.join(first, by).select(*by, "source", "candidate", "pos")
    else:
        first = candidates.orderBy("pos").limit(FALLBACK).select("candidate", "pos").collect()  # at most FALLBACK rows
        few = F.array(*[F.struct(F.lit(r[0]).alias("candidate"), F.lit(r[1]).alias("pos")) for r in first])
        rest = lonely.select("source", F.explode(few).alias("c")).select("source", "c.candidate", "c.pos") if first else near.limit(0)
    scored = near.unionByName(rest).withColumn("score", closeness(F.col("source"), F.col("candidate"))).where("score IS NOT NULL")
    best = scored.groupBy(*by, "source").agg(F.max(F.struct("score", (-F.col("pos")).alias("__p"), "candidate")).alias("__b"))
    return best.select(*by, "source", F.col("__b.candidate").alias("candidate"), F.col("__b.score").alias("score"), half_up(10 * (1 - F.col("__b.score"))).alias("distance"))


def rename_score(removed: Column, added: Column) -> Column:
    """Likeness of a removed member's name to a new one; a common last word counts two more."""
    a, b = camel_words_simple(removed), camel_words_simple(added)
    suffix = F.coalesce(F.try_element_at(a, F.lit(-1)) == F.try_element_at(b, F.lit(-1)), F.lit(False))
    matched = F.when(suffix, 2.0).otherwise(0.0) + _common(a, b)
    weight = matched / F.greatest(F.size(a), F.size(b), F.lit(1)).cast("double")
    spelling = 1 - F.levenshtein(F.lower(removed), F.lower(added)).cast("double") / F.greatest(F.length(removed), F.length(added), F.lit(1)).cast("double")
    return F.when(removed != added, F.when(suffix, 1.5 * weight + spelling).otherwise(weight + 0.5 * spelling))


def search_score(query: Column | str, name: Column | str) -> Column:
    """100 equal, 90 prefix, 70 contained, 80 and 60 a word or its prefix, below that by edit distance; else 0."""
    q, n = F.lower(col(query)), F.lower(col(name))
    words = compound_words(n)
    far = F.levenshtein(q, n)
    return (
        F.when(n == q, 100)
        .when(n.startswith(q), 90)
        .when(F.contains(n, q), 70)
        .when(F.array_contains(words, q), 80)
        .when(F.exists(words, lambda w: w.startswith(q)), 60)
        .when((F.abs(F.length(q) - F.length(n)) <= 3) & (far <= 2), 50 - 10 * far)
        .otherwise(0)
    )


def search(queries: DataFrame, items: DataFrame, top: int = 3, block: int = 500) -> DataFrame:
    """The ``top`` items (name, pos) of each stated query (query), by score, then position.

    The queries are a stated set; blocks of them become a literal that each item is held
    against where it is read, and only hits are shuffled. Spark keeps ``top`` rows of a query in each
    task before the shuffle.
    """
    out, held = None, []

    def run(part: list[str]) -> DataFrame:
        scored = items.withColumn("query", F.explode(F.array(*[F.lit(q) for q in part]))).withColumn("score", search_score("query", "name")).where("score > 0")
        best = Window.partitionBy("query").orderBy(F.col("score").desc(), "pos")
        return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query", "rank", "name", "score")

    for row in queries.select("query").where("query IS NOT NULL").distinct().toLocalIterator():
        held.append(row[0])
        if len(held) == block:
            out, held = (run(held) if out is None else out.unionByName(run(held))), []
    if held or out is None:
        last = run(held or [""]) if held else items.select(F.lit("").alias("query"), F.lit(0).alias("rank"), "name", F.lit(0).alias("score")).limit(0)
        out = last if out is None else out.unionByName(last)
    return out
