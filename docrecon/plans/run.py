"""A whole run over a folder of files: pages, segments, fields, links, checks, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import enrich, entities, extract, identity, links, pages, repair, rules
from ..sources import customs
from ..sources import files as S


def _heads(codes: Column) -> Column:
    return F.array_distinct(F.array_compact(F.transform(codes, lambda c: F.substring(C.tariff_code(c), 1, 6))))


def read(spark: SparkSession, root: str, pdf_reader: str | None = None, table: str | None = None) -> DataFrame:
    """The pages of a folder, a file or an archive; with a table, contents that it holds are not parsed again."""
    if table:
        return customs.read_with_table(spark, root, table, pdf_reader=pdf_reader)[0]
    return customs.read(spark, root, pdf_reader=pdf_reader)


def documents(read_pages: DataFrame, root: str, profile: identity.Profile) -> DataFrame:
    """One row a document: fields, its dossier and folder, the buyer's VAT; invoices are filled from their texts, and papers that are no invoices of goods are marked."""
    good = read_pages.filter("error is null").select("path", "page_no", pages.clean_markup(F.col("text")).alias("text"))
    cut = pages.segments(good.withColumn("doc_type", pages.classify(F.col("text"), profile.keywords)))
    found = extract.documents(cut).join(cut.select("path", "seg_no", "text"), ["path", "seg_no"])
    buyer = identity.buyer_vat(F.col("text"), F.col("vat"), profile)["vat"]
    place = S.path_context(F.col("path"), root)
    found = found.withColumns({"vat": F.when(F.col("doc_type").startswith("prestation"), F.col("vat")).otherwise(buyer), "dossier": place["dossier"], "folder": place["folder"], "id": F.concat_ws("#", "path", "seg_no")})
    is_invoice = F.col("doc_type").startswith("invoice")
    limits = enrich.Limits(tuple(profile.scope) or None, tuple(profile.known_ids), tuple(profile.prefixes))
    read = F.coalesce("hs_codes", F.when(F.col("hs_code").isNotNull(), F.array("hs_code")))
    own = enrich.enrich(found.filter(is_invoice).withColumn("hs_codes", read).withColumn("was_estimated", F.coalesce("estimated", F.lit(False))), limits)
    own = own.withColumns({"hs_code": F.get("hs_codes", F.lit(0)), "estimated": F.col("estimated") | (F.col("was_estimated") & (F.col("total_source") == "read"))}).drop("was_estimated")
    return own.unionByName(found.filter(~is_invoice), allowMissingColumns=True)


def repaired(kept: DataFrame, i: DataFrame, d: DataFrame) -> DataFrame:
    """The invoices, with total, currency and tariff codes of the declaration that is chosen to repair them, where their own text proves these."""
    linked = kept.select(F.col("pool").alias("bundle_id"), "invoice_id", "declaration_id", "ord")
    chosen = links.best_declaration(linked, i, d, links.FOR_REPAIR).select("invoice_id", "declaration_id")
    x = d.select("declaration_id", F.col("total").alias("r_total"), F.col("currency").alias("r_currency"), F.col("codes").alias("r_codes"))
    both = i.join(chosen.join(x, "declaration_id"), "invoice_id", "left")
    text, none = F.coalesce(F.col("text"), F.lit("")), F.array().cast("array<string>")
    money = repair.total(text, F.coalesce("amounts", F.array().cast("array<double>")), F.col("total"), F.col("currency"), F.col("r_total"), F.col("r_currency"), F.lit(None).cast("double"), F.lit(None).cast("string"))
    codes = F.when(F.col("r_codes").isNull(), F.col("codes")).otherwise(repair.tariff_codes(text, F.col("codes"), F.coalesce("r_codes", none)))
    out = both.withColumns({"_m": money, "_c": codes})
    same = (F.size("_c") == F.size("codes"))
    out = out.withColumns({"total": F.col("_m.total"), "currency": F.col("_m.currency"), "estimated": F.col("estimated") & ~F.col("_m.repaired"), "codes": F.col("_c"), "hs6": _heads(F.col("_c")), "repaired": F.concat_ws(",", F.when(F.col("_m.repaired"), "total"), F.when(~same, "codes"))})
    return out.select(*i.columns, "repaired")


def _forwarder(docs: DataFrame, kept: DataFrame, invoices: DataFrame) -> DataFrame:
    """(invoice_id, prestation_id, duties_match) of the invoices that a forwarder's invoice belongs to: the duties paid against those of all their declarations."""
    none = F.array().cast("array<string>")
    keys = lambda a, b: F.array_remove(F.array_distinct(F.transform(F.array_append(F.coalesce(a, none), F.coalesce(b, F.lit(""))), C.ref_key)), "")
    mrns = F.array_remove(F.transform(F.array_append(F.coalesce("mrns", none), F.coalesce("mrn", F.lit(""))), C.mrn_key), "")
    parts = F.coalesce("dd", F.lit(0.0)) + F.coalesce("at", F.lit(0.0)) + F.coalesce("tva", F.lit(0.0))
    d = docs.filter(F.col("doc_type").startswith("declaration")).select(F.col("id").alias("declaration_id"), F.col("path").alias("d_path"), mrns.alias("mrns"), keys(F.col("awbs"), F.col("awb")).alias("awbs"), parts.alias("parts"), rules.declared_duties(F.col("dd"), F.col("at"), F.col("tva"), F.col("tg")).alias("declared"))
    every = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    sums = kept.join(d, "declaration_id").groupBy("pool", F.col("invoice_id").alias("bundle_id")).agg(every("mrns").alias("mrns"), every("awbs").alias("d_awbs"), F.collect_set("d_path").alias("paths"), F.sum("parts").alias("duties"), F.sum("declared").alias("declared"))
    own = invoices.select(F.col("invoice_id").alias("bundle_id"), F.col("path").alias("i_path"), F.col("dossier").alias("own_dossier"), F.array_compact(F.array(C.ref_key(F.col("awb")))).alias("i_awbs"))
    bundles = sums.join(own, "bundle_id").select("pool", "bundle_id", F.array_compact(F.array("own_dossier")).alias("dossiers"), "mrns", F.array_union("d_awbs", "i_awbs").alias("awbs"), F.array_append("paths", F.col("i_path")).alias("sources"), "duties", "declared")
    paid = F.coalesce("disbursement", F.when(F.coalesce("dd", "at", "tva").isNotNull(), F.round(parts, 2)))
    p = docs.filter(F.col("doc_type").startswith("prestation")).select(F.coalesce("dossier", F.lit("")).alias("pool"), F.col("id").alias("prestation_id"), F.col("id").alias("ord"), "dossier", mrns.alias("mrns"), keys(F.col("awbs"), F.col("awb")).alias("awbs"), F.col("path").alias("source"), F.col("disbursement").alias("paid"), paid.alias("due"))
    best = links.best_prestation(links.prestation_bundle_score(bundles, p.drop("due")))
    both = best.join(p.select("prestation_id", "due"), "prestation_id").join(bundles.select("bundle_id", "declared"), "bundle_id")
    return both.select(F.col("bundle_id").alias("invoice_id"), "prestation_id", rules.duties(F.col("declared"), F.col("due")).alias("duties_match"))


def reconcile(docs: DataFrame, rates: dict[str, float], profile: identity.Profile | None = None) -> DataFrame:
    """One row an invoice with its matched declarations, the one it is checked against, its forwarder's invoice, the checks and the
    status; then one row for each declaration and forwarder's invoice that no invoice takes, which lack documents."""
    pool = F.coalesce("dossier", F.lit("")).alias("pool")
    lead = C.leading_ref(F.col("path")).alias("lead")
    every = F.coalesce("hs_codes", F.array_compact(F.array("hs_code")))
    codes = [_heads(every).alias("hs6"), every.alias("codes")]
    docs = docs.withColumns({c: F.lit(None).cast("string") for c in ("not_goods", "text") if c not in docs.columns})
    i = enrich.usable(docs.filter(F.col("doc_type").startswith("invoice"))).select(pool, F.col("id").alias("invoice_id"), "path", "dossier", "folder", C.ref_key(F.col("number")).alias("ref"), "awb", "total", "vat", *codes, lead, "currency", F.coalesce("estimated", F.lit(False)).alias("estimated"), "text", "amounts")
    d = docs.filter(F.col("doc_type").startswith("declaration")).select(pool, F.col("id").alias("declaration_id"), F.col("id").alias("ord"), "folder", F.transform("refs", C.ref_key).alias("refs"), F.coalesce("awbs", F.array().cast("array<string>")).alias("awbs"), "total", "currency", F.col("fx_rate").alias("fx"), "vat", *codes, lead, "text")
    kept = links.match(i, d)
    i = repaired(kept, i, d)
    linked = kept.select(F.col("pool").alias("bundle_id"), "invoice_id", "declaration_id", "ord")
    chosen = links.best_declaration(linked, i, d, links.FOR_RULES).select("invoice_id", "declaration_id")
    chosen = chosen.join(kept.groupBy("invoice_id").agg(F.count(F.lit(1)).alias("n_declarations")), "invoice_id")
    forwarder = _forwarder(docs, kept, i)
    x = d.select("declaration_id", F.col("total").alias("d_total"), F.col("currency").alias("d_currency"), F.col("hs6").alias("d_hs6"))
    rate = F.coalesce(*(F.when(F.col("currency") == c, F.lit(float(r))) for c, r in rates.items()), F.lit(None).cast("double"))
    currency, value = rules.value_currency(F.col("total"), F.col("currency"), F.col("d_total"), F.col("d_currency"), rate, F.col("estimated"))
    checks = F.array(rules.check("currency_match", currency), rules.check("amount_match", value), rules.check("hs_subset", rules.tariff(F.col("hs6"), F.col("d_hs6"))), rules.check("duties_match", F.col("duties_match")))
    named = entities.checks(chosen, i, d, profile) if profile and profile.entities else None
    if named is not None:
        checks = F.concat(F.array(rules.check("tva_scope", F.col("tva_scope")), rules.check("tva_match_decl", F.col("tva_match_decl"))), checks)
    given = F.filter(checks, lambda c: c["status"].isNotNull())
    out = i.join(chosen, "invoice_id", "left").join(x, "declaration_id", "left").join(forwarder, "invoice_id", "left")
    out = out if named is None else out.join(named.drop("declaration_id"), "invoice_id", "left")
    out = out.withColumn("checks", F.when(F.col("declaration_id").isNotNull(), given).otherwise(F.slice(checks, 1, 0)))
    out = out.withColumn("status", rules.status(F.lit(True), F.col("declaration_id").isNotNull(), F.col("checks"))).select("pool", "invoice_id", "declaration_id", "n_declarations", "prestation_id", "total", "currency", "d_total", "d_currency", "repaired", "checks", "status")
    alone = [("declaration", "declaration_id", kept), ("prestation", "prestation_id", forwarder)]
    for kind, key, used in alone:
        rows = docs.filter(F.col("doc_type").startswith(kind)).select(pool, F.col("id").alias(key))
        out = out.unionByName(links.orphans(rows, used.distinct(), key).withColumn("status", F.lit("MANQUE_DOC")), allowMissingColumns=True)
    return out
