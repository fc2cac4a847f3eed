"""Terms in texts as column expressions: hits, spans, gaps, weighted counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(text: str) -> str:
    """A pattern for the text as it is."""
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}-&~#" else c for c in text)


def alternation(terms: Sequence[str], fold: bool = False) -> str:
    return ("(?iu)" if fold else "") + "|".join(map(quoted, terms))


def first_hit(c: Column, terms: Sequence[str], fold: bool = False) -> Column:
    """The leftmost term in the text, as it stands there; blank if there is none."""
    return F.regexp_extract(c, alternation(terms, fold), 0)


def unique_hits(c: Column, terms: Sequence[str], fold: bool = False) -> Column:
    """The terms that the text holds, in their own order."""
    text = F.lower(c) if fold else c
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(text, F.lower(t) if fold else t))


def any_hit(c: Column, terms: Sequence[str]) -> Column:
    return F.regexp_like(c, F.lit(alternation(terms)))


def count_of(c: Column, term: str) -> Column:
    """How often a term stands in the text without overlap, from the left."""
    return (F.length(c) - F.length(F.replace(c, F.lit(term), F.lit("")))) / F.lit(len(term))


def weighted_count(c: Column, weights: Mapping[str, float]) -> Column:
    return sum((count_of(c, t) * F.lit(float(w)) for t, w in weights.items()), F.lit(0.0))


def starts(c: Column, term: str) -> Column:
    """Where a term stands in the text, overlapping places too (from 0): the text is split
    before each place and the pieces' lengths are summed."""
    lengths = F.transform(F.split(c, f"(?={quoted(term)})"), F.length)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
    places = F.aggregate(
        lengths,
        empty,
        lambda s, n: F.struct((s["at"] + n).alias("at"), F.array_append(s["found"], s["at"] + n).alias("found")),
        lambda s: F.slice(s["found"], F.lit(1), F.size(s["found"]) - 1),  # the last is the text's end
    )
    first = F.when(F.startswith(c, F.lit(term)), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return F.concat(first, places)


def spans(c: Column, terms: Sequence[str]) -> Column:
    """start, end, term of every place of every term, term by term."""

    def of(term: str) -> Column:
        return F.transform(starts(c, term), lambda at: F.struct(at.alias("start"), (at + len(term)).alias("end"), F.lit(term).alias("term")))

    return F.concat(*map(of, terms))


def least_gap(left: Column, right: Column) -> Column:
    """The fewest characters between a span of either side, 0 if two overlap; null without
    spans on both sides. One pass over all spans by their start: a span is nearest to the one
    of the other side, of those begun, that ends last."""
    side = lambda spans, name: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(name).alias("side")))
    none = F.lit(None).cast("int")
    state = F.struct(none.alias("a"), none.alias("b"), none.alias("gap"))

    def step(s: Column, x: Column) -> Column:
        other = F.when(x["side"] == 0, s["b"]).otherwise(s["a"])
        gap = F.least(s["gap"], F.when(other.isNotNull(), F.greatest(F.lit(0), x["start"] - other)))
        end = lambda name, k: F.when(x["side"] == k, F.greatest(s[name], x["end"])).otherwise(s[name])
        return F.struct(end("a", 0).alias("a"), end("b", 1).alias("b"), gap.alias("gap"))

    return F.aggregate(F.array_sort(F.concat(side(left, 0), side(right, 1))), state, step, lambda s: s["gap"])


def url_parameter(c: Column, name: str) -> Column:
    """A query parameter's decoded value; null without one."""
    return F.try_url_decode(F.try_parse_url(c, F.lit("QUERY"), F.lit(name)))


def url_join(base: Column, link: Column) -> Column:
    """The absolute address of a link on a page: absolute already, of the page's scheme, from the
    host's root, of the page's query or fragment, or beside the page."""
    root = F.regexp_extract(base, r"^[a-z]+://[^/?#]+", 0)
    path = F.regexp_extract(base, r"^[a-z]+://[^/?#]+([^?#]*)", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, r"[^/]*$", ""))
    return (
        F.when(F.regexp_like(link, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")), link)
        .when(F.startswith(link, F.lit("//")), F.concat(F.regexp_extract(base, "^[a-z]+:", 0), link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, link))
        .when(F.startswith(link, F.lit("#")), F.concat(F.regexp_replace(base, "#.*$", ""), link))
        .when(F.startswith(link, F.lit("?")), F.concat(root, path, link))
        .otherwise(F.concat(root, folder, link))
    )
