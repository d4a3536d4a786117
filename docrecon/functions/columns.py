"""Normalisers and predicates as Columns: references, amounts, dates, tariff codes, tolerances."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The directed confusions of digits that a reader of scans makes.
CONFUSABLE = {"0": "689", "1": "47", "2": "7", "3": "58", "4": "19", "5": "368", "6": "0589", "7": "12", "8": "0356", "9": "047"}
#: Fixed value: a number in a letterhead that is never a tariff code.
NOT_A_CODE = "100900"


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once however often use names it."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


#: Letters that patterns of labels take for plain ones, once they are capitals, and those.
_ACCENTS, _PLAIN = "ÉÈÊÀÂÔÎ\u212aİ", "EEEAAOIKI"


def words_of(text: Column) -> Column:
    """The words of a text in plain capitals, one space for whatever stands between them: where a phrase is asked for before its pattern."""
    up = F.upper(F.regexp_replace(text, r"(?U)\W+", " "))
    return F.when(F.octet_length(text) == F.length(text), up).otherwise(F.translate(up, _ACCENTS, _PLAIN))


def said(words: Column | None, *phrases: str) -> Column:
    """Whether words_of a text have one of the phrases, with any signs between words; true where they were not worked out. Of a
    phrase whose signs may be missing only its longest part is asked for. Cheap, and true wherever the phrase's pattern matches."""
    if words is None:
        return F.lit(True)
    out = F.lit(False)
    for p in dict.fromkeys(re.sub(r"\W+", " ", p).strip().upper().translate(str.maketrans(_ACCENTS, _PLAIN)) for p in phrases):
        out = out | words.contains(p)
    return out


def close(a: Column, b: Column, absolute: float = 1.0, relative: float = 0.01) -> Column:
    """Within an absolute or a relative tolerance, the latter of the larger of both and 1; null if a side is."""
    gap = F.abs(a - b)
    return (gap <= absolute) | (gap / F.greatest(F.abs(a), F.abs(b), F.lit(1.0)) <= relative)


def ref_key(value: Column) -> Column:
    """Upper-cased letters and digits of a reference; empty if null."""
    return F.regexp_replace(F.upper(F.coalesce(value, F.lit(""))), "[^A-Z0-9]", "")


def ref_key_strict(value: Column) -> Column:
    """As ref_key, but lower-case letters are dropped, not raised."""
    return F.regexp_replace(F.coalesce(value, F.lit("")), "[^A-Z0-9]", "")


def mrn_key(value: Column) -> Column:
    return F.substring(ref_key(value), 1, 15)


def leading_ref(path: Column) -> Column:
    """The 8 to 12 digits before an underscore that begin a file name; empty if there are none."""
    return F.regexp_extract(F.coalesce(path, F.lit("")), r"(?:^|/)([0-9]{8,12})_[^/]*$", 1)


def refs_match(a: Column, b: Column) -> Column:
    """Equal, or one contains the other."""
    return a.contains(b) | b.contains(a)


def amount(text: Column, thousands: bool = False) -> Column:
    """A number written the French or English way; the later of comma and point is the decimal sign. With thousands, commas
    between groups of three digits are no decimal signs. Null if it is no number."""

    def plain(bare: Column) -> Column:
        comma, point = F.instr(F.reverse(bare), ","), F.instr(F.reverse(bare), ".")
        alone = F.regexp_replace(bare, ",", ".")
        if thousands:
            alone = F.when(bare.rlike(r"^-?\d{1,3}(,\d{3})+$"), F.regexp_replace(bare, ",", "")).otherwise(alone)
        french, english = F.regexp_replace(F.regexp_replace(bare, r"\.", ""), ",", "."), F.regexp_replace(bare, ",", "")
        return F.when(bare.contains(",") & bare.contains("."), F.when(comma < point, french).otherwise(english)).when(bare.contains(","), alone).otherwise(bare)

    number = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    return let(let(F.regexp_replace(F.trim(text), "[   ]", ""), plain), lambda v: F.when(v.rlike(number), v.try_cast("double")))


def iso_date(text: Column) -> Column:
    """Day, month and year (two digits below 70 are of this century) or an ISO date, as YYYY-MM-DD text; no calendar check."""
    day = r"\b(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4}|\d{2})\b"
    part = lambda i: F.regexp_extract(text, day, i)
    year = F.when(F.length(part(3)) == 2, F.concat(F.when(part(3).cast("int") < 70, "20").otherwise("19"), part(3))).otherwise(part(3))
    iso = F.regexp_extract(text, r"\b(\d{4}-\d{2}-\d{2})\b", 1)
    return F.when(part(1) != "", F.concat_ws("-", year, F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0"))).when(iso != "", iso)


def tariff_code(value: Column) -> Column:
    """The digits of a tariff code in canonical form (6 to 10 digits), or null."""
    read = lambda d: F.when(d.startswith("426"), F.concat(F.lit("420"), F.substring(d, 4, 1000))).otherwise(F.when(d == NOT_A_CODE, "").otherwise(d))
    whole = lambda d: F.when(F.length(d) == 9, F.concat(d, F.lit("0"))).when((F.length(d) == 11) & d.endswith("0"), F.substring(d, 1, 10)).otherwise(d)
    digits = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"\D", "")
    return let(let(let(digits, read), whole), lambda d: F.when(F.length(d).between(6, 10), d))


def confusable(a: Column, b: Column) -> Column:
    """Same length, one or two positions differ, and each is a known confusion from a to b."""
    pairs = F.array(*(F.lit(x + y) for x, ys in CONFUSABLE.items() for y in ys))
    diffs = F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x != y, F.concat(x, y))), lambda x: x.isNotNull())
    return (F.length(a) == F.length(b)) & F.size(diffs).between(1, 2) & F.forall(diffs, lambda x: F.array_contains(pairs, x))


def ordered_distinct(values: Column) -> Column:
    """Values in order of first appearance, without regard to case or trailing punctuation; empty ones go."""
    clean = F.filter(F.transform(values, lambda v: F.regexp_replace(F.trim(v), r"[\s,;:.]+$", "")), lambda v: v != "")
    seen = F.transform(clean, lambda v: F.upper(v))
    return F.transform(F.array_distinct(seen), lambda k: F.element_at(clean, F.array_position(seen, k).cast("int")))
