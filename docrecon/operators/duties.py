"""Duties in the tables of declarations and forwarders' invoices: codes and amounts that belong together by their place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans
from ..functions.columns import amount, let

# What duty a code is, and the words that end a table.
ARTICLE_CODES = {"U165": "dd", "M195": "at", "A445": "tva"}
TOTAL_CODES = {"U165": "dd", "M830": "at", "M195": "at", "A445": "tva"}
ARTICLE_ENDS = r"(?iU)DONNEE COMPLEMENTAIRE|MENTION SPECIALES|Page\s+\d+\s+of"
TOTAL_ENDS = r"(?iU)Montant\s+total\s+facturé|Montant\s+total\s+à\s+payer|GARANTIE"
#: Amounts under one heading at most; lines after a code that may hold its amount; smaller whole numbers are states, larger ones no duties.
MOST_AMOUNTS, ROW_REACH, LEAST_WHOLE, TOO_MUCH = 10, 3, 9, 1_000_000


def _stripped(line: Column) -> Column:
    """A line without white space around."""
    return F.regexp_replace(line, r"(?U)^\s+|\s+$", "")


def _lines(block: Column) -> Column:
    """The lines with something in them, without white space around."""
    return F.filter(F.transform(F.split(block, r"\r?\n"), _stripped), lambda x: x != "")


def _places(lines: Column, holds) -> Column:
    return F.filter(F.transform(lines, lambda _, i: i), lambda i: holds(i))


def article_duties(text: Column) -> Column:
    """A struct (dd, at, tva) of the sums over all articles' LIQUIDATION tables, null where no table gives one.

    A table prints its codes line by line, and under the heading Montant its amounts; the n-th amount belongs to the n-th code.
    What has no partner counts for nothing. A table ends with the words of ARTICLE_ENDS, or with the text.
    """

    def pairs(part: Column) -> Column:
        cells = F.transform(F.split(F.get(F.split(part, r"(?iU)LIQUIDATION\s*\n", 2), F.lit(1)), r"\r?\n"), _stripped)

        def amounts(lines: Column) -> Column:
            printed = lambda i: F.coalesce(F.get(lines, i).rlike(r"\A[\d.,]+\z"), F.lit(False))
            heads = _places(lines, lambda i: F.get(lines, i).endswith("Montant") & printed(i + 1))

            def under(head: Column) -> Column:
                after = F.slice(lines, head + 2, MOST_AMOUNTS)
                stop = F.array_min(_places(after, lambda i: ~F.get(after, i).rlike(r"\A[\d.,]+\z")))
                own = F.slice(after, F.lit(1), F.coalesce(stop, F.size(after)))
                return F.filter(F.transform(own, lambda x: amount(x)), lambda v: v.isNotNull())

            return let(F.get(heads, F.lit(0)), lambda head: F.when(head.isNotNull(), under(head)))

        def table(cells: Column) -> Column:
            codes = F.transform(F.filter(cells, lambda x: x.rlike(r"\A[UMA]\d{3}(?:-[A-Z0-9]{2,4})?\z")), lambda x: F.substring(x, 1, 4))
            closed = F.filter(F.slice(cells, F.lit(1), F.size(cells) - 1), lambda x: x != "")  # an amount's line must be complete
            return spans.paired(codes, let(closed, amounts))

        return F.coalesce(let(cells, table), F.array().cast("array<struct<left:string,right:double>>"))

    every = F.flatten(F.transform(F.split(text, ARTICLE_ENDS), pairs))
    sums = let(every, lambda p: spans.sums_by(p, list(ARTICLE_CODES)))
    return let(sums, lambda s: F.struct(*(s[code].alias(field) for code, field in ARTICLE_CODES.items())))


def total_duties(text: Column) -> Column:
    """A struct (dd, at, tva, tg) from the table LIQUIDATION TOTALE, whose rows are printed cell by cell: a code, its name, its amount, a state.

    A code's amount is the first number within ROW_REACH lines that has a decimal sign or is LEAST_WHOLE at least; the first code of
    a duty counts. The total stands on the line after the word Total.
    """
    rest = F.get(F.split(text, r"(?iU)LIQUIDATION\s+TOTALE\s*\n", 2), F.lit(1))

    def fields(cells: Column) -> Column:
        def plausible(k: Column) -> Column:
            cell = F.get(cells, k)
            return F.coalesce((cell["value"] < TOO_MUCH) & ((cell["value"] >= LEAST_WHOLE) | cell["text"].rlike("[.,]")), F.lit(False))

        def of(i: Column) -> Column:
            near = F.filter(F.transform(F.sequence(F.lit(1), F.lit(ROW_REACH)), lambda k: i + k), plausible)
            return F.get(cells, F.get(near, F.lit(0)))["value"]

        out = {}
        for field in ("dd", "at", "tva"):
            codes = [c for c, f in TOTAL_CODES.items() if f == field]
            own = F.transform(_places(cells, lambda i, codes=codes: F.get(cells, i)["text"].isin(codes)), of)
            out[field] = F.get(F.array_compact(own), F.lit(0))
        totals = F.transform(_places(cells, lambda i: F.lower(F.get(cells, i)["text"]) == "total"), lambda i: F.get(cells, i + 1)["value"])
        out["tg"] = F.get(F.array_compact(totals), F.lit(0))
        return F.struct(*(c.alias(n) for n, c in out.items()))

    lines = _lines(F.coalesce(F.get(F.split(rest, TOTAL_ENDS, 2), F.lit(0)), F.lit("")))
    return let(F.transform(lines, lambda x: F.struct(x.alias("text"), amount(x).alias("value"))), fields)


#: A row of a forwarder's table: a code, what it is charged on, the word, the rate, the duty; and the characters after it that may hold its taxes.
DUTY_ROW, ROW_WINDOW = r"(?iU)\b(\d{10})\s+([\d.,]+)\s+Droits\s+de\s+Douane\s+([\d.,]+)\s+([\d.,]+)", 400
_ROW_TAXES = {"tva": (r"TVA\s+[àa]\s+l['’ ]importation\s+([\d.,]+)\s+([\d.,]+)", [("base_tva", 1), ("tva", 2)]), "at": (r"Autres\s+Taxes\s+([\d.,]+)\s+([\d.,]+)", [("at", 2)]), "total": (r"Total\s*EUR\s*:?\s*([\d.,]+)", [("total", 1)])}
# A digit is asked for first: the edge of a word is dear to tell, and most places of a text have no digit.
_ROW_AND_WINDOW = rf"(?U)(?=\d)(?=({DUTY_ROW}(?s:.{{0,{ROW_WINDOW}}}))){DUTY_ROW}"


def _tax(kind: str) -> str:
    """The pattern of a tax. Its first letter, a T or an A, which have no odd capitals, is asked for as it is before capitals are compared."""
    pattern = _ROW_TAXES[kind][0]
    return f"(?=[{pattern[0].upper()}{pattern[0].lower()}])(?iU){pattern}"


def _value(text: Column) -> Column:
    """The amount of digits and signs, those at the end left out. Digits with one decimal sign at most, or nothing, need no more steps."""
    plain = F.translate(text, ",", ".").try_cast("double")
    return F.when(text == "", F.lit(None)).when(text.rlike(r"\A[0-9]+(?:[.,][0-9]+)?\z"), plain).otherwise(let(F.regexp_replace(text, r"[.,]+\z", ""), amount))


def duty_rows(text: Column) -> Column:
    """An array of (hs_code, base, rate, dd, base_tva, tva, at, total), one a row of a forwarder's table of duties, in order.

    A row's taxes are the first of their kind within ROW_WINDOW characters after it; these windows overlap, so that a row whose
    taxes are printed behind the next row's has them, too. Null fields were not printed. Null of a null text.
    """
    value = lambda x, pattern, k: let(F.regexp_extract(x, pattern, k), _value)

    def one(row: Column, window: Column) -> Column:
        own = [value(row, DUTY_ROW, k).alias(n) for n, k in (("base", 2), ("rate", 3), ("dd", 4))]
        found = F.struct(*(F.regexp_extract(window, _tax(kind), 0).alias(kind) for kind in _ROW_TAXES))
        taxes = lambda t: [value(t[kind], f"(?iU){pattern}", k).alias(n) for kind, (pattern, fields) in _ROW_TAXES.items() for n, k in fields]
        return let(found, lambda t: F.struct(F.regexp_extract(row, DUTY_ROW, 1).alias("hs_code"), *own, *taxes(t)))

    cut = lambda p: let(F.regexp_extract(p, DUTY_ROW, 0), lambda row: one(row, F.substr(p, F.length(row) + 1)))
    return F.transform(F.regexp_extract_all(text, F.lit(_ROW_AND_WINDOW), F.lit(1)), cut)


def _sums(rows: DataFrame, id_col: str, prefix: str = "") -> DataFrame:
    total = lambda c: F.round(F.sum(F.col(prefix + c)), 2).alias(c)
    return rows.groupBy(id_col, F.col(prefix + "hs_code").alias("hs_code")).agg(F.count(F.lit(1)).alias("n_rows"), total("dd"), total("tva"), total("at"))


def by_code(documents: DataFrame, id_col: str = "id", rows_col: str = "duty_rows") -> DataFrame:
    """(id, hs_code, n_rows, dd, tva, at): a document's duties by tariff code, null where no row of the code prints one."""
    return _sums(documents.select(id_col, F.explode(rows_col).alias("r")), id_col, "r.")


def by_code_of_texts(documents: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """What by_code gives of duty_rows of the texts. A table's row becomes a row before its fields are read, and only those that are summed are."""
    rows = documents.select(id_col, F.explode(F.regexp_extract_all(text_col, F.lit(_ROW_AND_WINDOW), F.lit(1))).alias("p"))
    rows = rows.withColumn("row", F.regexp_extract("p", DUTY_ROW, 0))
    window = F.substr(F.col("p"), F.length("row") + 1)
    rows = rows.select(id_col, F.substring("row", 1, 10).alias("hs_code"), F.regexp_extract("row", DUTY_ROW, 4).alias("dd"), window.alias("window"))
    rows = rows.select(id_col, "hs_code", "dd", *(F.regexp_extract("window", _tax(kind), 2).alias(kind) for kind in ("tva", "at")))
    return _sums(rows.withColumns({n: _value(F.col(n)) for n in ("dd", "tva", "at")}), id_col)
