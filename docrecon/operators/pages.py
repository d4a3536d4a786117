"""Pages: classification by ordered rules, segmentation into documents, text scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (document type, groups); a rule holds if the upper-cased page contains one phrase of each group, the first rule
#: that holds wins. A phrase that begins with / is a pattern; the phrase @ stands for a keyword of the client.
INVOICE_WORD, BRAND = ("FACTURE", "INVOICE"), ("@",)
RULES: list[tuple[str, tuple[tuple[str, ...], ...]]] = [
    ("prestation_dhl", (("DHL EXPRESS",), ("FACTURE DE DROITS ET TAXES", "DROITS ET TAXES"), INVOICE_WORD)),
    ("prestation_dhl", (("DHL",), ("DROITS ET TAXES",), ("IMPORTATION",))),
    ("prestation_worldnet", (("WORLDNET INTERNATIONAL FRANCE", "WORLDNET INTERNATIONAL LTD"), INVOICE_WORD)),
    ("prestation_worldnet", (("FR80 432 500 551", "FR80432500551"), INVOICE_WORD)),
    ("prestation_worldnet", (("WORLDNET",), ("DROITS ET TAXES", "TVA À L'IMPORTATION", "TVA A L'IMPORTATION"), ("NUMÉRO DE FACTURE", "NUMERO DE FACTURE"))),
    ("prestation_dsv", (("DSV AIR",), ("FACTURE NO", "N° FACTURE"))),
    ("prestation_dsv", (("DSV AIR",), ("DEBOURS", "DOUANE"))),
    ("prestation_schenker", (("SCHENKER",), ("DEBOURS", "DROIT DE DOUANE"), INVOICE_WORD)),
    ("unknown", (("DSV AIR", "SCHENKER"), ("ENVOI DOCUMENT",))),
    ("cgv", (("CONDITIONS GÉNÉRALES", "CONDITIONS GENERALES", "GENERAL TERMS"), ("TRANSPORT", "VENTE", "SERVICE", "STANDARD"))),
    ("declaration_delta_ie_akanea", (("AKANEA DOUANE", "ÉDITION AKANEA", "EDITION AKANEA"), ("DELTA IE",))),
    ("declaration_delta_ie_akanea", (("AKANEA",), ("DELTA IE",), ("MRN", "CRN"))),
    ("declaration_delta_ie_akanea", (("AKANEA",), ("DELTA IE", "ARTICLE 1/", "ANNEXE"))),
    ("declaration_delta_ie_dhl", (("DHL DELTA IE",),)),
    ("declaration_delta_ie_dhl", (("ARTICLE",), ("REGIME",), ("NOMENCLATURE",), ("MASSE NETTE",))),
    ("declaration_h7", (("DELTA H7", "DELTA-H7", "DELTAH7"),)),
    ("declaration_dau", (("JUSTIFICATIF DÉDOUANEMENT", "JUSTIFICATIF DEDOUANEMENT"),)),
    ("declaration_dau", (("FRA0619B",), ("DONNÉES COMPTABLES", "DONNEES COMPTABLES"))),
    ("declaration_dau", (("COMMUNAUTE EUROPEENNE", "COMMUNAUTÉ EUROPÉENNE"), ("DECLARATION", "DÉCLARATION"), ("BUREAU DE DESTINATION", "BUREAU D'ENTREE", "BUREAU D’ENTREE", "CONTROLE PAR"))),
    ("awb", (("AIR WAYBILL", "AIRWAYBILL"), ("SHIPPER", "CONSIGNEE", "ISSUED BY"))),
    ("packing_list", (("PACKING LIST",),)),
    ("invoice_launchmetrics", (("LAUNCHMETRICS",), ("INVOICE", "SHIP FROM", "SHIP TO"))),
    ("invoice_launchmetrics", (("INCOMING INVOICE NUMBER", "INCOMING AIR WAYBILL NUMBER"), ("STYLE", "BARCODE", "CUSTOM CODE"))),
    ("invoice_parfumerie_versailles", (("PARFUMERIE VERSAILLES",), ("PVE891221", "FACTURA", "FACTURE"))),
    ("invoice_parfumerie_versailles", ((r"/\bFAI\d{6,}\b",), ("PARFUMERIE", "PVE891221", "MXN"))),
    ("invoice_entity_proforma", (BRAND, ("PROFORMA INVOICE", "PRO-FORMA INVOICE", "PRO FORMA INVOICE"))),
    ("invoice_entity", (BRAND, ("INVOICE",), ("INVOICE NO", "INVOICE NUMBER", "HS CODE"))),
    ("invoice_entity", (BRAND, ("HS CODE", "HS-CODE"), ("TOTAL", "AMOUNT"))),
    ("invoice_entity_delivery_note", (BRAND, ("DELIVERY NOTE NO", "DELIVERY NOTE NUMBER"))),
    ("invoice_dhl_hawb", (("DHL",), ("COMMERCIAL INVOICE", "AWB NO", "AWB NUMBER", "HAWB"))),
    ("invoice_dhl_hawb", (("COMMERCIAL INVOICE",), ("AWB", "WAYBILL"))),
    ("invoice_generic", (INVOICE_WORD, ("HS CODE", "HS-CODE", "CUSTOMS CODE"))),
    ("invoice_generic", (("INVOICE PROFORMA", "PROFORMA INVOICE"), ("VALUE FOR CUSTOMS", "CUSTOMS ONLY"))),
    ("invoice_generic", (("PRO-FORMA", "PROFORMA"), ("RECIPIENT VAT", "TRANSFER NO", "CUSTOM REF", "CUSTOMS", "TAX EXCL"))),
    ("invoice_generic", (("NO COMMERCIAL VALUE", "VALUE FOR CUSTOMS ONLY"), ("CUSTOMS", "TOTAL", "CURRENCY"))),
    ("invoice_generic", (BRAND, ("DELIVERY ADVICE", "VALUE FOR CUSTOMS"), ("TOTAL", "CURRENCY", "CUSTOMS"))),
    ("invoice_generic", (("TARIFF CODE", "TARIF CODE"), ("DESCRIPTION OF GOODS", "PRICE TOTAL", "ORIGIN"))),
]
#: What makes a read page useful, by weight.
SCORE_WORDS = "INVOICE,PROFORMA,CUSTOMS,CUSTOM,VALUE,TOTAL,VAT,TVA,EORI,SHIP TO,BILL TO,AWB,TRACKING,HS,TARIFF,COMMODITY,MATRICULE,DHL".split(",")
SCORE_PATTERNS = [
    (500, r"\b(?:EUR|USD|GBP|CHF|CAD|JPY|HKD|NOK|TWD|THB|AUD)\b"),
    (250, r"\b[0-9]{4}[ .]?[0-9]{2}[ .]?[0-9]{2,4}\b"),
    (250, r"\bFR\s*[0-9][0-9\s]{9,16}\b"),
]


#: Fixed value: the shape of a declaration's number, wherever it stands on the page; its first 15 characters tell declarations apart.
MRN = r"\b([0-9]{2}[A-Z]{2}[A-Z0-9]{12,16})\b"


def classify(text: Column, keywords: list[str] | tuple[str, ...] = ()) -> Column:
    """The type of a page: one chain of conditions, built from the rule table."""
    up = F.upper(text)

    def holds(phrase: str) -> Column:
        if phrase == "@":
            return any_of([up.contains(k.upper()) for k in keywords])
        return up.rlike(phrase[1:]) if phrase[0] == "/" else up.contains(phrase)

    def any_of(parts: list[Column]) -> Column:
        out = F.lit(False)
        for p in parts:
            out = out | p
        return out

    chain = F
    for kind, groups in RULES:
        holding = F.lit(True)
        for group in groups:
            holding = holding & any_of([holds(p) for p in group])
        chain = chain.when(holding, kind)
    return chain.otherwise("unknown")


def segments(pages: DataFrame) -> DataFrame:
    """(path, seg_no, doc_type, start_page, end_page, text) from (path, page_no, doc_type, text): consecutive pages of a file that
    belong together. A segment's first page sets its type and, for declarations, its id; what it absorbs depends on both, so
    each file's pages fold over one state."""
    mrn = F.substring(F.regexp_extract(F.upper(F.coalesce("text", F.lit(""))), MRN, 1), 1, 15)
    kind = F.regexp_extract("doc_type", "^(declaration|prestation|invoice)_", 1)
    page = F.struct("page_no", "doc_type", F.when(kind == "", F.col("doc_type")).otherwise(kind).alias("kind"), F.when(kind == "declaration", mrn).otherwise(F.when(F.col("doc_type") == "unknown", mrn).otherwise("")).alias("id"))
    files = pages.groupBy("path").agg(F.sort_array(F.collect_list(page)).alias("pages"))
    start = F.expr("cast(array() as array<struct<doc_type:string,kind:string,id:string,first:int,last:int>>)")

    def fold(done: Column, p: Column) -> Column:
        last = F.element_at(done, -1)
        same = p["doc_type"] == last["doc_type"]
        more = same | (p["doc_type"] == "unknown")
        ids = (last["id"] == "") | (p["id"] == "") | (last["id"] == p["id"])
        joins = F.when(last["kind"] == "declaration", more & ids).when(last["kind"] == "prestation", more).when(last["kind"] == "invoice", p["kind"] == "invoice").otherwise(same & last["kind"].isin("packing_list", "cgv"))
        new = F.struct(p["doc_type"].alias("doc_type"), p["kind"].alias("kind"), p["id"].alias("id"), p["page_no"].cast("int").alias("first"), p["page_no"].cast("int").alias("last"))
        grown = F.struct(last["doc_type"].alias("doc_type"), last["kind"].alias("kind"), last["id"].alias("id"), last["first"].alias("first"), p["page_no"].cast("int").alias("last"))
        head = F.slice(done, 1, F.size(done) - 1)
        return F.when((F.size(done) > 0) & joins, F.concat(head, F.array(grown))).otherwise(F.concat(done, F.array(new)))

    runs = files.select("path", F.posexplode(F.aggregate("pages", start, fold)).alias("i", "s")).select("path", (F.col("i") + 1).alias("seg_no"), "s.doc_type", F.col("s.first").alias("start_page"), F.col("s.last").alias("end_page"))
    texts = pages.select(F.col("path").alias("p"), F.col("page_no").alias("n"), "text")
    joined = runs.join(texts, (F.col("path") == F.col("p")) & F.col("n").between(F.col("start_page"), F.col("end_page")))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n\n")
    return joined.groupBy("path", "seg_no", "doc_type", "start_page", "end_page").agg(whole.alias("text"))


def quality_score(text: Column) -> Column:
    """How useful a read page is: its length up to 4,000, and weights for the words and patterns of customs papers."""
    up = F.upper(text)
    score = F.least(F.length(text), F.lit(4000))
    for word in SCORE_WORDS:
        score = score + F.floor((F.length(up) - F.length(F.replace(up, F.lit(word), F.lit("")))) / len(word)) * 250
    for weight, pattern in SCORE_PATTERNS:
        score = score + F.regexp_count(up, F.lit(pattern)) * weight
    return F.coalesce(score, F.lit(0)).cast("long")


def best_variant(variants: DataFrame, key: str, order: str, score: str) -> DataFrame:
    """The variant of highest score for each key; of equal ones the first."""
    return variants.groupBy(key).agg(F.max_by(order, F.struct(F.col(score), -F.col(order))).alias(order), F.max(score).alias(score))


def clean_markup(text: Column) -> Column:
    """Short tags become spaces, NUL characters go."""
    return F.regexp_replace(F.regexp_replace(text, "<[^>]{1,10}>", " "), "\u0000", "")
