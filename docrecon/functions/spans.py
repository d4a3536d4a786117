"""Matches of a pattern with what stands around them, blocks between matches, and walks over the numbers of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let


def pieces(text: Column, pattern: str) -> Column:
    """Of each match in order (match, before, after): itself, the text since the match before it, the text up to the next one.

    The pattern must not match an empty text. The blocks of neighbouring matches share no character. Null of a null text.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(F.split(text, pattern, -1), lambda rest: F.transform(found, lambda m, i: F.struct(m.alias("match"), F.get(rest, i).alias("before"), F.get(rest, i + 1).alias("after"))))


def blocks(text: Column, head: str, reach: int, end: str | None = None) -> Column:
    """Of each match of head (match, block): at most so many characters after it, up to the next head, and up to end where that comes first."""

    def cut(p: Column) -> Column:
        block = F.substring(p["after"], 1, reach)
        return F.struct(p["match"].alias("match"), (F.get(F.split(block, end, 2), F.lit(0)) if end else block).alias("block"))

    return F.transform(pieces(text, head), cut)


def enclosed(text: Column, head: str, end: str, reach: int) -> Column:
    """The text from the first head that has an end within reach, up to that end; null if no head has one. Other heads may lie between."""

    def up_to_end(k: Column) -> Column:
        rest = F.get(F.split(text, head, k + 1), k)
        return let(F.split(rest, end, 2), lambda s: F.when((F.size(s) > 1) & (F.length(F.get(s, F.lit(0))) <= reach), F.get(s, F.lit(0))))

    heads = F.regexp_count(text, F.lit(head))
    found = F.transform(F.when(heads > 0, F.sequence(F.lit(1), heads)).otherwise(F.array().cast("array<int>")), up_to_end)
    return F.get(F.array_compact(found), F.lit(0))


def numbers(text: Column) -> Column:
    """The digit groups of a text with what stands before and after each."""
    return pieces(text, r"\d+")


def digits_at(tokens: Column, i: Column, least: int, most: int) -> Column:
    """Whether there is a group i of so many digits."""
    n = F.length(F.get(tokens, i)["match"])
    return F.coalesce(n.between(least, most), F.lit(False))


def gap_is(tokens: Column, i: Column, pattern: str) -> Column:
    """Whether all that stands between groups i and i + 1 matches."""
    return F.coalesce(F.get(tokens, i)["after"].rlike(rf"\A{pattern}\z"), F.lit(False)) & (F.size(tokens) > i + 1)


def stands_free(tokens: Column, first: Column, last: Column) -> Column:
    """Whether groups first to last touch no letter on either side."""
    return F.coalesce(~F.get(tokens, first)["before"].rlike(r"(?U)\w\z") & ~F.get(tokens, last)["after"].rlike(r"(?U)\A\w"), F.lit(False))


def joined(tokens: Column, i: Column, used: Column) -> Column:
    """The digits of so many groups from i on."""
    return F.array_join(F.transform(F.slice(tokens, i + 1, used), lambda t: t["match"]), "")


def walk(tokens: Column, used) -> Column:
    """The digits of the groups that a rule takes together, from left to right: used(tokens, i) is how many groups from i on are one (0: none), and a group that was taken is not looked at again."""

    def step(state: Column, i: Column) -> Column:
        n = F.when(i < state["next"], 0).otherwise(used(tokens, i))
        return let(n, lambda k: F.struct(F.when(k > 0, F.concat(state["found"], F.array(joined(tokens, i, k)))).otherwise(state["found"]).alias("found"), F.when(k > 0, i + k).otherwise(state["next"]).alias("next")))

    start = F.struct(F.array().cast("array<string>").alias("found"), F.lit(0).alias("next"))
    places = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, step, lambda s: s["found"])


def paired(left: Column, right: Column) -> Column:
    """Values of two lists of matches by their place, (left, right), as far as both go."""
    return F.filter(F.zip_with(left, right, lambda a, b: F.struct(a.alias("left"), b.alias("right"))), lambda p: p["left"].isNotNull() & p["right"].isNotNull())


def sums_by(pairs: Column, keys: list[str], places: int = 2) -> Column:
    """A struct with a field for each key: the rounded sum of its right sides, null where no pair has it."""

    def one(key: str) -> Column:
        own = F.filter(pairs, lambda p: p["left"] == key)
        return F.when(F.size(own) > 0, F.round(F.aggregate(own, F.lit(0.0), lambda a, p: a + p["right"]), places))

    return F.struct(*(one(k).alias(k) for k in keys))
