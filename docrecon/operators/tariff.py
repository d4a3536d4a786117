"""Tariff codes of an invoice's text: candidates by where they stand, without look-alikes, within the client's scope."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import spans
from ..functions.columns import let, said, tariff_code

# Printed labels of a code with the shape that its value has, countries beside which one stands, marks of tax and telephone numbers.
LABELS = [
    (["CITES CUSTOMS"], "number within 140"),
    (["CUSTOMS NUMBER CODE"], "number within 180"),
    (["TARIFF CODE", "TARIF CODE"], "spaced"),
    (["CUSTOMS CODE", "CUSTOM CODE"], "printed"),
    (["COMMODITY CODE"], "printed"),
    (["HS CODE", "H.S. CODE", "HS-CODE"], "printed"),
    (["1B", "IB"], "plain"),
    (["MATRICULE"], "long"),
]
COUNTRIES = ["UNITED KINGDOM", "FRANCE", "ITALY", "SPAIN", "SWITZERLAND", "JAPAN", "CHINA", "HONG KONG", "KOREA", "MEXICO", "PORTUGAL", "GERMANY", "GB", "FR", "IT", "ES", "CH", "JP", "CN", "HK", "KR", "MX", "PT", "DE", "ITA", "FRA", "ESP", "CHE", "USA", "THA", "AUS", "CAN", "NOR"]
TAX_MARKS, PHONE_MARKS = ["CHE", "TVA", "VAT", "EORI", "SIRET", "SIREN"], ["TEL", "PHONE", "PH", "FAX", "+"]
TAX_REACH, PHONE_REACH = 8, 90
#: The heading of a table of values and the characters of it that are searched; more distinct codes than TABLE_MOST are taken for something else.
TABLE_HEADS, TABLE_REACH, TABLE_MOST = ["UNIT VALUE", "TOTAL VALUE", "UNIT VALVE", "TOTAL VALSE"], 700, 2
TABLE_CURRENCIES = ["CHF", "CHE", "EUR", "USD", "GBP", "AED", "HKD", "SGD", "NOK", "CAD"]
#: A code whose last digits stand further on in its block, one of an article of these countries; and the words that end a block.
SPLIT_HEAD, SPLIT_REACH = r"(?iU)\b[1I]B[:\s]*\d{4}[.,]?", 360
SPLIT_COUNTRIES = ["ITALY", "FRANCE", "SWITZERLAND", "HONG KONG", "CHINA", "JAPAN", "UNITED KINGDOM", "GB", "FR", "IT", "CH", "HK", "CN", "JP"]
SPLIT_ENDS = ["TOTAL GOODS VALUE", "TOTAL INVOICE AMOUNT", "CURRENCY CODE"]
#: The grid under a heading, up to the words that end it.
GRID_HEADS, GRID_ENDS, GRID_REACH = ["CUSTOMS CODE", "CUSTOM CODE"], ["TOTAL GOODS VALUE", "TOTAL INVOICE AMOUNT", "NUMBER OF PARCEL"], 1600
#: What must be in a text for a code beside a country or in groups: a letter before a long number or after one, or groups.
MAYBE_LATE = r"(?iU)[A-Z]\s+\|?\s*\d{6}|\d{6}\s+[A-Z]|\d{4}[.,\s\-]\d\d[.,\s\-]\d\d"
JEWELLERY, JEWELLERY_WORDS = "7117190090", ["COSTUME JEWELRY", "COSTUME JEWELLERY", "EARRING", "EARRINGS", "BROOCH", "NECKLACE", "BIJOUTERIE FANTAISIE"]

_GAP = r"\s*:?\s*"
#: What stands between a label and its value, and the value.
_SHAPES = {"spaced": (_GAP, r"\d[\d ]{5,11}"), "printed": (_GAP, r"\d[\d .,]{5,15}"), "long": (_GAP, r"\d[\d .,]{9,16}"), "plain": ("[: ]+", r"\d{6,10}\b")}


def _NONE() -> Column:
    return F.array().cast("array<string>")


def _words(words: list[str]) -> str:
    return "(?:" + "|".join(w.replace(".", r"\.?").replace("+", r"\+").replace("-", r"\W?").replace(" ", r"\s+") for w in words) + ")"


def _heads(words: Column | None, labels: list[str]) -> Column:
    """Whether one of the labels may be printed: signs within a word may be missing, so of such a label its longest part is asked for."""
    return said(words, *(max(re.split(r"[.+-]", x), key=len) for x in labels))


def _labelled(text: Column, words: Column | None = None) -> Column:
    """Values after the labels, in the order of the table."""
    found = []
    for labels, shape in LABELS:
        gap, value = _SHAPES[shape] if shape in _SHAPES else (rf"[\s\S]{{0,{shape.rpartition(' ')[2]}}}?\bNO\s+", r"\d{8,10}\b")
        values = F.regexp_extract_all(text, F.lit(rf"(?iU)\b{_words(labels)}{gap}({value})"), F.lit(1))
        found.append(F.when(_heads(words, labels), values).otherwise(_NONE()))
    return F.concat(*found)


def _split_lines(text: Column) -> Column:
    """Codes whose first four digits are labelled and whose others are the last pair of groups in the block that follows, as a point or comma joins them."""
    country = rf"(?iU)\b{_words(SPLIT_COUNTRIES)}\b"

    def code(b: Column) -> Column:
        def pair(t: Column) -> Column:
            def is_pair(i: Column) -> Column:
                free = spans.stands_free(t, i, i + 1) & ~F.coalesce(F.get(t, i)["before"].rlike(r"\A[.,]\z") & (i > 0), F.lit(False))
                return spans.digits_at(t, i, 2, 2) & spans.digits_at(t, i + 1, 2, 3) & spans.gap_is(t, i, "[.,]") & free

            places = F.filter(F.transform(t, lambda _, i: i), is_pair)
            return F.try_element_at(F.transform(places, lambda i: spans.joined(t, i, F.lit(2))), F.lit(-1))

        rest = F.when(b["block"].rlike(country), let(spans.numbers(b["block"]), pair))
        return F.concat(F.regexp_extract(b["match"], r"(\d{4})", 1), rest)

    return F.array_compact(F.transform(spans.blocks(text, SPLIT_HEAD, SPLIT_REACH, f"(?iU){_words(SPLIT_ENDS)}"), code))


def _grid(text: Column) -> Column:
    """Codes in the grid under a heading: 6 to 11 digits, with or without a space after the fourth and the sixth."""
    ends = rf"(?iU)(?:\n\s*TOTAL\s*\n\s*TOTA|{_words(GRID_ENDS)})"

    def used(t: Column, i: Column) -> Column:
        near = lambda k: spans.gap_is(t, i + k, " ")
        tail = lambda k: near(k - 1) & spans.digits_at(t, i + k, 1, 5)
        four = spans.digits_at(t, i, 4, 4) & near(0)
        n = (
            F.when(four & spans.digits_at(t, i + 1, 2, 2), F.when(tail(2) & spans.stands_free(t, i, i + 2), 3).otherwise(2))
            .when(four & spans.digits_at(t, i + 1, 3, 7), 2)
            .when(spans.digits_at(t, i, 6, 6), F.when(tail(1) & spans.stands_free(t, i, i + 1), 2).otherwise(1))
            .when(spans.digits_at(t, i, 7, 11), 1)
            .otherwise(0)
        )
        return let(n, lambda k: F.when((k > 0) & spans.stands_free(t, i, i + k - 1), k).otherwise(0))

    block = spans.enclosed(text, rf"(?iU)\b{_words(GRID_HEADS)}\b", ends, GRID_REACH)
    return F.coalesce(let(spans.numbers(block), lambda t: spans.walk(t, used)), F.array().cast("array<string>"))


def _value_table(text: Column) -> Column:
    """Groups of 8 to 10 digits soon after the heading of a table of values that names a currency."""
    heads = F.regexp_extract_all(text, F.lit(rf"(?iU)\b{_words(TABLE_HEADS)}\b[\s\S]{{0,{TABLE_REACH}}}"), F.lit(0))
    priced = F.filter(heads, lambda b: b.rlike(rf"(?iU)\b{_words(TABLE_CURRENCIES)}\b"))
    return F.flatten(F.transform(priced, lambda b: let(spans.numbers(b), lambda t: _free(t, F.filter(F.transform(t, lambda _, i: i), lambda i: spans.digits_at(t, i, 8, 10))))))


def _free(tokens: Column, places: Column) -> Column:
    return F.transform(F.filter(places, lambda i: spans.stands_free(tokens, i, i)), lambda i: F.get(tokens, i)["match"])


def _beside_countries(tokens: Column) -> Column:
    """Groups of 6 to 11 digits after a country, then those before one."""
    country = _words(COUNTRIES)
    long = F.filter(F.transform(tokens, lambda _, i: i), lambda i: spans.digits_at(tokens, i, 6, 11))
    after = F.filter(long, lambda i: F.get(tokens, i)["before"].rlike(rf"(?iU)(?:{country})\s+\|?\s*\z"))
    before = F.filter(long, lambda i: F.get(tokens, i)["after"].rlike(rf"(?iU)\A\s+{country}\b"))
    return F.concat(_free(tokens, after), _free(tokens, before))


def _grouped(tokens: Column) -> Column:
    """Codes printed in groups: four digits, two, then four or two and perhaps two more, one sign between each."""

    def used(t: Column, i: Column) -> Column:
        sign = lambda k: spans.gap_is(t, i + k, r"[.,\s\-]")
        start = spans.digits_at(t, i, 4, 4) & sign(0) & spans.digits_at(t, i + 1, 2, 2) & sign(1)
        free = lambda k: spans.stands_free(t, i, i + k)
        two = spans.digits_at(t, i + 2, 2, 2)
        return (
            F.when(start & spans.digits_at(t, i + 2, 4, 4) & free(2), 3)
            .when(start & two & sign(2) & spans.digits_at(t, i + 3, 2, 2) & free(3), 4)
            .when(start & two & free(2), 3)
            .otherwise(0)
        )

    return spans.walk(tokens, used)


def _marked(text: Column, words: Column | None = None) -> Column:
    """What stands soon after the marks of tax and telephone numbers, up to a long number."""
    up = F.upper(text)

    def soon_after(whole: Column, marks: list[str], reach: int, between: str) -> Column:
        return F.regexp_extract_all(whole, F.lit(rf"(?s)(?:{'|'.join(m.replace('+', chr(92) + '+') for m in marks)})(?=({between}{{0,{reach}}}\d{{6,11}}))"), F.lit(1))

    tax, phone = soon_after(F.regexp_replace(up, r"\s+", ""), TAX_MARKS, TAX_REACH, r"[^A-Z0-9]"), soon_after(up, PHONE_MARKS, PHONE_REACH, r".")
    if words is not None:  # white space may stand within a mark of tax numbers
        tax = F.when(said(F.replace(words, F.lit(" "), F.lit("")), *TAX_MARKS), tax).otherwise(_NONE())
        phone = F.when(said(words, *(m for m in PHONE_MARKS if m.isalpha())) | text.contains("+"), phone).otherwise(_NONE())
    return F.concat(tax, phone)


def look_alike(code: Column, text: Column, known_ids: list[str] = (), prefixes: list[str] = ()) -> Column:
    """A code that is a known number of the client (one contains the other), begins as excluded ones do, or stands soon after a mark of tax or telephone numbers."""
    return _look_alike(code, _marked(text), known_ids, prefixes)


def _look_alike(code: Column, marked: Column, known_ids: list[str], prefixes: list[str]) -> Column:
    out = F.lit(False)
    for known in known_ids:
        out = out | code.contains(known) | F.lit(known).contains(code)
    for p in prefixes:
        out = out | code.startswith(p)
    return out | F.exists(marked, lambda w: w.contains(code))


def codes(text: Column, awb: Column | None = None, scope: list[str] | None = None, known_ids: list[str] = (), prefixes: list[str] = (), words: Column | None = None) -> Column:
    """The distinct codes in the order of these steps: split over lines; after a label; in a grid; in a table of values, only if
    nothing was found so far and it has TABLE_MOST at most; beside a country; in groups; the code of costume jewellery by its
    words, only if there is none yet. Look-alikes and the waybill's number go, but for split ones; with a scope, so does a code whose first six digits are outside it. With the text's words, steps whose labels it lacks are passed over."""

    def within(found: Column) -> Column:
        good = F.filter(F.transform(found, tariff_code), lambda c: c.isNotNull())
        return good if scope is None else F.filter(good, lambda c: F.substring(c, 1, 6).isin(scope))

    def clean(found: Column, marked: Column) -> Column:
        good = F.filter(within(found), lambda c: ~_look_alike(c, marked, known_ids, prefixes))
        return good if awb is None else F.filter(good, lambda c: ~F.coalesce(c == awb, F.lit(False)))

    def steps(marked: Column) -> Column:
        only = lambda condition, found: F.when(condition, found).otherwise(_NONE())
        grid, table = only(said(words, *GRID_HEADS), _grid(text)), only(said(words, *TABLE_HEADS), _value_table(text))
        first = F.concat(within(only(said(words, "1B", "IB"), _split_lines(text))), clean(F.concat(_labelled(text, words), grid), marked))
        early = let(first, lambda f: F.when(F.size(f) == 0, let(F.array_distinct(clean(table, marked)), lambda spare: F.when(F.size(spare) <= TABLE_MOST, spare).otherwise(f))).otherwise(f))
        late = only(text.rlike(MAYBE_LATE), let(spans.numbers(text), lambda t: clean(F.concat(_beside_countries(t), _grouped(t)), marked)))
        return F.array_distinct(F.concat(early, late))

    jewellery = F.array(F.lit(JEWELLERY)) if scope is None or JEWELLERY[:6] in scope else _NONE()
    own = lambda f: (F.size(f) == 0) & said(words, *JEWELLERY_WORDS) & F.upper(text).rlike(rf"\b{_words(JEWELLERY_WORDS)}\b")
    found = let(let(_marked(text, words), steps), lambda f: F.when(own(f), jewellery).otherwise(f))
    return F.when(text.isNotNull(), found)
