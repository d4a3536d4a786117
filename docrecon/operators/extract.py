"""Fields of segmented documents. A format is a table of printed labels and kinds of value; one finder turns both into a Column."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import amount, iso_date, let, said, words_of
from . import duties, tariff, totals

# Currencies; the order decides for an invoice without a known layout.
CURRENCIES = "EUR USD GBP CHF CAD JPY CNY HKD KRW SGD MXN BRL INR AED SAR AUD NZD NOK SEK DKK TWD THB MYR".split()
INVOICE_CURRENCIES = "EUR USD GBP CHF CAD JPY CNY HKD KRW SGD TRY".split()

#: Kinds of value as they are printed. Letters are capitals whatever the label's case.
_CURRENCY = f"(?-i:{'|'.join(CURRENCIES)})"
SHAPES = {
    "amount": r"\d(?:[\d.,]|[ \u00A0\u202F](?=\d))*",
    "code": r"\d{8,10}",
    "country": r"(?-i:[A-Z]{2})\b",
    "term": r"(?-i:[A-Z]{3})\b",
    "currency": _CURRENCY,
    "reference": r"[A-Z0-9][A-Z0-9/\-]{2,39}",
    "number": r"[A-Z0-9][A-Z0-9/\-]*\d[A-Z0-9/\-]*",
    "vat": r"(?-i:FR\d{11})",
    "eori": r"(?-i:[A-Z]{2}\d{9,17})",
    "mrn": r"(?-i:\d{2}[A-Z]{2}[A-Z0-9]{12,16})\b",
    "waybill": r"\d{8,12}\b",
    "date": r"\d{1,4}[/.\-]\d{1,2}[/.\-]\d{1,4}",
    "digits": r"\d[\d ]{3,9}\d",
}
#: What may stand between a label and its value: signs and spaces, the rest of a line, or some lines.
GAPS = {"next": r"\W{0,12}", "line": r"\b[^\n]{0,60}?", "lines": r"\b[\s\S]{0,160}?"}
_TWINS = {"e": "[eéèê]", "a": "[aàâ]", "o": "[oô]", "i": "[iî]"}


def loose(label: str) -> str:
    """A label as a pattern: accents may be missing, and any signs may stand for its spaces."""
    out = [r"\W{1,4}" if c == " " else _TWINS.get(c.lower(), re.escape(c)) for c in label]
    return (r"\b" if label[0].isalnum() else "") + "".join(out)


def finder(label: str, shape: str, gap: str = "next") -> str:
    return f"(?iU){loose(label)}{GAPS[gap]}({SHAPES[shape]})"


def first(text: Column, pattern: str, group: int = 1) -> Column:
    """The first capture; null if there is none."""
    return F.get(F.array_remove(F.array(F.trim(F.regexp_extract(text, pattern, group))), ""), F.lit(0))


def every(text: Column, pattern: str, if_: Column | None = None) -> Column:
    """All captures in order, with repeats; none unless a condition holds."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return found if if_ is None else F.when(if_, found).otherwise(F.array().cast("array<string>"))


def number(text: Column, thousands: bool = False) -> Column:
    """A capture as a number; trailing signs belong to the sentence."""
    return let(F.regexp_replace(text, r"[.,\s]+$", ""), lambda v: amount(v, thousands))


def any_of(text: Column, shape: str, tries: list, words: Column | None = None) -> Column:
    """The value after the first label that has one. A try is a label, or (label, gap). With the text's words, labels that it lacks are passed over."""
    pairs = [(t, "next") if isinstance(t, str) else t for t in tries]
    return F.coalesce(*(F.when(said(words, label), first(text, finder(label, shape, gap))) for label, gap in pairs))


def all_of(text: Column, shape: str, labels: list[str], words: Column | None = None) -> Column:
    """The values after all labels, each once, in the labels' order."""
    return F.array_distinct(F.flatten(F.array(*(F.transform(every(text, finder(x, shape), said(words, x)), lambda v: F.regexp_replace(v, r"[/\-]+$", "")) for x in labels))))


def last_vat(text: Column) -> Column:
    return F.try_element_at(every(text, rf"\b({SHAPES['vat']})"), F.lit(-1))


def total_of(found: Column) -> Column:
    """The sum of printed amounts, null without any."""
    values = F.filter(F.transform(found, lambda v: number(v)), lambda v: v.isNotNull())
    return let(values, lambda vs: F.when(F.size(vs) > 0, F.aggregate(vs, F.lit(0.0), lambda a, v: a + v)))


def money_after(text: Column, label: str, gap: str = "next", words: Column | None = None) -> Column:
    """(currency, total) after a label, in either order."""
    ahead = f"(?iU){loose(label)}{GAPS[gap]}({_CURRENCY})" + r"\W{0,12}" + f"({SHAPES['amount']})"
    behind = f"(?iU){loose(label)}{GAPS[gap]}({SHAPES['amount']})" + r"\W{0,4}" + f"({_CURRENCY})"
    # the text is searched for the whole, and that for its parts
    after = let(F.regexp_extract(text, ahead, 0), lambda m: F.when(m != "", _money(first(m, ahead), number(first(m, ahead, 2)))))
    before = let(F.regexp_extract(text, behind, 0), lambda m: F.when(m != "", _money(first(m, behind, 2), number(first(m, behind)))))
    return F.when(said(words, label), F.coalesce(after, before))


def _money(currency: Column, total: Column) -> Column:
    """The pair as a struct; null unless the total is above zero."""
    return let(F.struct(currency.alias("currency"), total.alias("total")), lambda m: F.when(m["total"] > 0, m))


def money_anywhere(text: Column) -> Column:
    """(currency, total) of the first currency that an amount of some length follows."""
    pattern = rf"(?iU)\b({_CURRENCY})\s+(\d[\d., ]{{2,14}}\d)"
    return _money(first(text, pattern), number(first(text, pattern, 2)))


# --- declarations --------------------------------------------------------------------------------------------------------

# Document codes before references to invoices, to other declarations and to waybills, and what duty a tax code is.
INVOICE_CODES, PREVIOUS_CODES, WAYBILL_CODES = ["N380", "N325", "N830", "N935"], ["N785"], ["N740", "N741"]
TAX_CODES = {"dd": ["U165"], "at": ["M195", "M830"], "tva": ["A445"]}
#: Labels by field. Delta IE prints full words, H7 and DAU box titles.
DECLARATION_LABELS = {
    "lrn": ("reference", ["LRN", "NUMERO DE REFERENCE (LRN)"]),
    "crn": ("reference", ["CRN"]),
    "regime": ("digits", ["REGIME"]),
    "gross_weight_kg": ("amount", ["Masse brute totale (kg)", "Masse brute totale", "Masse brute (kg)", "Masse brute"]),
    "net_weight_kg": ("amount", ["Masse nette totale (kg)", "Masse nette totale", "Masse nette (kg)", "Masse nette"]),
    "origin_country": ("country", ["Code P. origine", ("Code P. origine", "lines"), "Pays d'origine", ("Pays d'origine", "line"), "Pays d'expedition"]),
    "destination_country": ("country", ["Code P. destination", ("Code P. destination", "line"), "Pays de destination"]),
    "incoterm": ("term", ["Conditions de livraison", "Incoterm"]),
    "eori": ("eori", [("Destinataire", "lines"), ("Importateur", "lines"), "EORI"]),
    "fx_rate": ("amount", ["Taux de change"]),
    "tg": ("amount", ["TG", "Montant total a payer", "Total a payer"]),
}
#: Formats with articles, and what heads one: ARTICLE N 1, or ARTICLE 1/2.
WITH_ARTICLES, ARTICLE = ("declaration_delta_ie_dhl", "declaration_delta_ie_akanea"), r"(?iU)\bARTICLE\s*(?:N\W{0,3}\d+|\d+\s*/\s*\d*)"
CODE_LABELS = ["Code des marchandises", ("Code des marchandises", "line"), "Nomenclature", ("Nomenclature", "line"), "Code marchandise"]
DUTY_LABELS = {"dd": ["DD", "Droits de douane"], "at": ["AT", "Autres taxes"], "tva": ["TVA auto liquidee", "TVA autoliquidee"]}
TOTAL_LABELS = ["Monnaie et montant total facture", "Montant total facture", "Valeur totale facturee"]


def _articles(text: Column, doc_type: Column) -> Column:
    """An array of (item_no, hs_code, net_weight_kg, gross_weight_kg, money, origin_country), one an article heading; the whole text without any."""
    parts = let(F.when(doc_type.isin(*WITH_ARTICLES), F.split(text, ARTICLE)).otherwise(F.array(text)), lambda p: F.when(F.size(p) > 1, F.slice(p, 2, 1_000_000)).otherwise(p))

    def line(block: Column, i: Column, words: Column) -> Column:
        money = F.coalesce(money_after(block, "Montant article facture", "line", words), money_after(block, "Montant article", "line", words), F.lit(None).cast("struct<currency:string,total:double>"))
        weight = lambda kind: number(any_of(block, "amount", [f"Masse {kind} (kg)", f"Masse {kind}"], words))
        return F.struct((i + 1).alias("item_no"), any_of(block, "code", CODE_LABELS, words).alias("hs_code"), weight("nette").alias("net_weight_kg"), weight("brute").alias("gross_weight_kg"), money.alias("money"), any_of(block, "country", ["Pays d'origine"], words).alias("origin_country"))

    return F.transform(parts, lambda block, i: let(words_of(block), lambda words: line(block, i, words)))


def _summed(lines: Column, value, places: int) -> Column:
    values = F.filter(F.transform(lines, lambda x: value(x)), lambda v: v.isNotNull())
    return F.when(F.size(values) > 0, F.round(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), places))


def declaration(text: Column, doc_type: Column, words: Column | None = None) -> list[dict[str, Column]]:
    """The fields of a customs declaration: those read from the text, those that the text is asked for only where the first lack
    them, and those that follow. Articles' amounts and weights add up to the total where an article prints its own."""
    out, labelled = {}, {}
    for name, (shape, tries) in DECLARATION_LABELS.items():
        found = any_of(text, shape, tries, words)
        labelled[name] = number(found) if shape == "amount" else found
    out |= {n: c for n, c in labelled.items() if not n.endswith("_weight_kg")}
    out["lines"] = _articles(text, doc_type)
    out["liquidation"] = F.when(doc_type == "declaration_delta_ie_dhl", duties.article_duties(text))
    out["table"] = F.when(doc_type == "declaration_delta_ie_akanea", duties.total_duties(text))
    for name, labels in DUTY_LABELS.items():
        out[name] = number(any_of(text, "amount", labels, words))
    out["mrn"] = first(text, rf"\b({SHAPES['mrn']})")
    out["refs"] = all_of(text, "reference", INVOICE_CODES, words)
    out["mrns"] = all_of(text, "reference", PREVIOUS_CODES, words)
    out["awbs"] = all_of(text, "reference", WAYBILL_CODES, words)
    out["vat"] = F.coalesce(any_of(text, "vat", ["FR7", "FR1"], words), last_vat(text))
    lines, printed, amounts = F.col("lines"), F.col("printed"), F.col("amounts")
    found = F.coalesce(*(money_after(text, x, gap, words) for gap in ("next", "line") for x in TOTAL_LABELS), money_anywhere(text))
    summed = _summed(lines, lambda x: x["money"]["total"], 2)
    own = F.get(F.filter(F.transform(lines, lambda x: x["money"]["currency"]), lambda c: c.isNotNull()), F.lit(0))
    codes = F.array_distinct(F.array_compact(F.transform(lines, lambda x: x["hs_code"])))
    then = {}
    for name in DUTY_LABELS:
        # printed after a label, else in a format's tables, else beside a code; a DAU counts a missing duty as none
        table = F.coalesce(F.col(f"liquidation.{name}"), F.col(f"table.{name}"))  # a document has the one of its format
        coded = total_of(F.flatten(F.array(*(every(text, finder(c, "amount"), said(words, c)) for c in TAX_CODES[name]))))
        then[name] = F.coalesce(name, table, coded, F.when(doc_type == "declaration_dau", 0.0))
    then["tg"] = F.coalesce("tg", F.col("table.tg"))
    then |= {"total": F.coalesce(amounts, printed["total"]), "currency": F.when(amounts.isNotNull(), own).otherwise(printed["currency"]), "hs_codes": codes, "hs_code": F.get(codes, F.lit(0)), "awb": F.get("awbs", F.lit(0))}
    for name in ("net_weight_kg", "gross_weight_kg"):
        then[name] = F.coalesce(F.when(doc_type.isin(*WITH_ARTICLES), _summed(lines, lambda x, name=name: x[name], 3)), labelled[name])
    return [out, {"amounts": summed}, {"printed": F.when(amounts.isNull(), found)}, then]


# --- invoices ------------------------------------------------------------------------------------------------------------

INVOICE_LABELS = {
    "number": ("number", ["Invoice No", "Invoice Number", "Invoice", "Facture No", "Numero de facture", "Facture"]),
    "date": ("date", ["Invoice date", "Date of invoice", "Date de facture", "Date"]),
    "incoterm": ("term", ["Incoterm", "Incoterms", "Terms of sale", "Delivery terms"]),
    "eori": ("eori", ["EORI", "EORI No"]),
    "awb": ("waybill", ["AWB No", "AWB Number", "AWB", "Waybill No", "Waybill", "HAWB"]),
    "origin_country": ("country", ["Country of origin", "Made in", "Origin"]),
}
NUMBER_LABELS = {"invoice_entity_proforma": ["Proforma No", "Proforma invoice No", "Pro forma invoice No", "Proforma invoice"], "invoice_entity_delivery_note": ["Delivery note No", "Delivery note number"]}


def generic_total(text: Column, words: Column | None = None) -> Column:
    """(currency, total) of an invoice without a known layout. In turn: a currency whose amount ends a line, a total's line, an
    amount before a currency, an amount after the euro sign. The order of currencies decides."""
    shape = SHAPES["amount"]

    def pair(currency: Column, found: Column) -> Column:
        value = F.get(F.filter(F.transform(found, lambda v: number(v, thousands=True)), lambda v: v > 0), F.lit(0))
        return F.when(value.isNotNull(), F.struct(currency.alias("currency"), value.alias("total")))

    ends = [pair(F.lit(c), every(text, rf"(?imU)\b{c}\W{{0,4}}({shape})\W*$", said(words, c))) for c in INVOICE_CURRENCIES]
    line = pair(F.lit(None).cast("string"), every(text, rf"(?iU)\bTOTAL\b[^\n]*?({shape}[.,]\d\d)\b", said(words, "TOTAL")))
    before = [pair(F.lit(c), every(text, rf"(?iU)({shape}) ?{c}\b", said(words, c))) for c in INVOICE_CURRENCIES]
    return F.coalesce(*ends, line, *before, pair(F.lit("EUR"), every(text, rf"€\s*({shape})", text.contains("€"))))


def invoice(text: Column, doc_type: Column, words: Column | None = None) -> list[dict[str, Column]]:
    """The fields of an invoice, those read from the text before those that follow. A delivery note is in EUR unless it says otherwise and takes its commonest code of ten digits."""
    out = {name: any_of(text, shape, tries, words) for name, (shape, tries) in INVOICE_LABELS.items()}
    out["number"] = F.coalesce(*(F.when(doc_type == t, any_of(text, "number", labels, words)) for t, labels in NUMBER_LABELS.items()), out["number"])
    out["date"] = iso_date(out["date"])
    out["vat"] = last_vat(text)
    out["choice"] = totals.choice(text, words)
    out["found"] = tariff.codes(text, words=words)
    out["runs"] = every(text, r"\b(\d{8,10})\b", text.rlike(r"\d{8}"))
    out["amounts"] = F.transform(every(text, r"(?U)(?<![\d.,])(\d[\d ]*(?:[.,]\d{3})*[.,]\d\d)(?!\d)"), lambda v: number(v, thousands=True))
    picked, plain, awb, own = F.col("choice.picked"), F.col("plain"), F.col("awb"), F.col("number")
    generic, note = doc_type == "invoice_generic", doc_type == "invoice_entity_delivery_note"
    money = F.coalesce(F.when(generic, plain), picked, plain)
    codes = F.filter("found", lambda c: ~F.coalesce(c == awb, F.lit(False)))
    other = F.slice(F.filter(F.array_distinct("runs"), lambda c: ~c.startswith("0") & ~F.coalesce(c == awb, F.lit(False)) & ~F.coalesce(c == own, F.lit(False))), 1, 1)
    ten = F.filter("runs", lambda c: F.length(c) == 10)
    often = let(ten, lambda ten: F.array_max(F.transform(F.array_distinct(ten), lambda c: F.struct(F.size(F.filter(ten, lambda x: x == c)).alias("n"), (-F.array_position(ten, c)).alias("at"), c.alias("code")))))
    other = F.when(note, F.array_compact(F.array(often["code"]))).otherwise(other)
    hs = F.when(F.size(codes) > 0, codes).otherwise(other)
    estimated = ~generic & F.coalesce(F.col("choice.estimated"), F.lit(False))
    plainly = {"plain": F.when(generic | picked.isNull(), generic_total(text, words))}
    return [out, plainly, {"currency": F.coalesce(money["currency"], F.when(note, "EUR")), "total": money["total"], "estimated": estimated, "hs_codes": hs, "hs_code": F.get(hs, F.lit(0))}]


# --- forwarders' invoices ------------------------------------------------------------------------------------------------

PRESTATION_LABELS = {
    "number": ("number", ["Numero de facture", "Facture No", "No facture", "Facture"]),
    "date": ("date", ["Date de facture", "Date"]),
    "dd": ("amount", ["Droits de douane", ("Droits de douane", "line"), "Droit de douane", ("Droit de douane", "line")]),
    "tva": ("amount", ["TVA a l importation", ("TVA a l importation", "line"), "TVA importation"]),
    "at": ("amount", ["Autres taxes", ("Autres taxes", "line"), "Taxes diverses"]),
    "disbursement": ("amount", ["Total debours", "Montant des debours", "Debours", "Droits et taxes"]),
    "surcharges": ("amount", ["Montant total des surcharges", "Total prestations"]),
    "total": ("amount", ["Montant total TTC", "Total TTC", "Net a payer", "Total EUR", ("Montant total (EUR)", "line")]),
}


def prestation(text: Column, doc_type: Column, words: Column | None = None) -> list[dict[str, Column]]:
    """The fields of a forwarder's invoice; what was disbursed is printed or the sum of duties and taxes."""
    out = {}
    for name, (shape, tries) in PRESTATION_LABELS.items():
        found = any_of(text, shape, tries, words)
        out[name] = number(found) if shape == "amount" else iso_date(found) if shape == "date" else found
    out["vat"] = F.coalesce(first(text, rf"\b({SHAPES['vat']})"), F.concat(F.lit("FR"), first(text, r"(?iU)\bTVA\s*FR\s*(\d{11})\b")))
    out["currency"] = F.lit("EUR")
    out["duty_rows"] = duties.duty_rows(text)
    out["mrns"] = F.array_distinct(every(text, rf"\b({SHAPES['mrn']})"))
    beside = every(text, rf"(?U)\b({SHAPES['waybill']})\s+{SHAPES['mrn']}")
    out["awbs"] = F.array_distinct(F.concat(beside, all_of(text, "waybill", ["AWB", "LTA", "HAWB"], words)))
    parts = [F.col(c) for c in ("dd", "at", "tva")]
    summed = F.when(F.coalesce(*parts).isNotNull(), F.round(reduce(lambda a, b: a + b, (F.coalesce(p, F.lit(0.0)) for p in parts)), 2))
    return [out, {"disbursement": F.coalesce(F.when(doc_type == "prestation_dhl", summed).otherwise(F.col("disbursement")), summed), "awb": F.get("awbs", F.lit(0))}]


#: The readers and their formats.
READERS = {
    declaration: ["declaration_h7", "declaration_delta_ie_dhl", "declaration_delta_ie_akanea", "declaration_dau"],
    invoice: ["invoice_entity", "invoice_entity_proforma", "invoice_entity_delivery_note", "invoice_dhl_hawb", "invoice_generic", "invoice_launchmetrics", "invoice_parfumerie_versailles"],
    prestation: ["prestation_dhl", "prestation_schenker", "prestation_dsv", "prestation_worldnet"],
}
_BETWEEN = ("text", "_words", "printed", "liquidation", "table", "choice", "plain", "found", "runs")


def parse(segments: DataFrame, reader) -> DataFrame:
    """The fields of the segments that a reader reads, one projection for all its formats: (path, seg_no, doc_type) and a column for each."""
    read, *steps = reader(F.coalesce(F.col("text"), F.lit("")), F.col("doc_type"), F.col("_words"))
    segments = segments.filter(F.col("doc_type").isin(*READERS[reader])).withColumn("_words", words_of(F.coalesce(F.col("text"), F.lit(""))))
    rows = segments.select("path", "seg_no", "doc_type", "text", "_words", *(c.alias(n) for n, c in read.items()))
    return reduce(DataFrame.withColumns, steps, rows).drop(*_BETWEEN, *(["amounts"] if reader is declaration else []))


def documents(segments: DataFrame) -> DataFrame:
    """The fields of all known formats, one row a segment; fields that a format lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (parse(segments, r) for r in READERS))
