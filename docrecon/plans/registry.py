"""Queries by name, and the DuckDB SQL of each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import duties, enrich, entities, evidence, extract, identity, links, pages, rules, settings, tariff, totals, variants
from ..streaming import ingest
from . import derive

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
OURS = "FR00000000001"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _rate(currency: Column) -> Column:
    out = F
    for c, r in derive.RATES.items():
        out = out.when(currency == c, r)
    return out.otherwise(F.lit(None).cast("double"))


def _joined(spark, d: str) -> DataFrame:
    """Invoices with their declarations, if any: an equi-join on the order."""
    i = derive.invoices(spark, d)
    x = derive.declarations(spark, d).select("id", F.col("total").alias("d_total"), F.col("currency").alias("d_currency"), F.col("vat").alias("d_vat"), "duty", "n_lines", F.col("hs6").alias("d_hs6"))
    return i.join(x, "id", "left")


def _close(a: str, b: str, absolute: float, relative: float) -> str:
    return f"(abs({a} - {b}) <= {absolute} OR abs({a} - {b}) / greatest(abs({a}), abs({b}), 1) <= {relative})"


_BASE = f"""WITH i AS ({derive.INVOICES}), x AS ({derive.DECLARATIONS}),
j AS (SELECT i.*, x.total AS d_total, x.currency AS d_currency, x.vat AS d_vat, duty, n_lines, x.hs6 AS d_hs6, CASE i.currency {' '.join(f"WHEN '{c}' THEN {r}::DOUBLE" for c, r in derive.RATES.items())} END AS rate FROM i LEFT JOIN x ON i.id = x.id),
k AS (SELECT *, coalesce(currency <> d_currency AND d_currency = 'EUR' AND rate > 0 AND {_close('total / rate', 'd_total', 2.0, 0.25)}, false) AS fx, coalesce({_close('total', 'd_total', 1.0, 0.02)}, false) AS same FROM j),
v AS (SELECT *, CASE WHEN d_currency IS NULL THEN 'NOK' WHEN currency IS NULL THEN 'WARN' WHEN currency = d_currency THEN 'OK' WHEN fx THEN 'OK' WHEN same THEN 'WARN' ELSE 'NOK' END AS currency_match,
  CASE WHEN fx THEN 'OK' WHEN d_total IS NULL THEN 'NOK' WHEN total IS NULL THEN 'WARN' WHEN same THEN 'OK' WHEN estimated AND total < d_total THEN 'WARN' ELSE 'NOK' END AS amount_match FROM k)"""


def _checked(spark, d: str) -> DataFrame:
    j = _joined(spark, d)
    currency, value = rules.value_currency(F.col("total"), F.col("currency"), F.col("d_total"), F.col("d_currency"), _rate(F.col("currency")), F.col("estimated"))
    return j.withColumns({"currency_match": currency, "amount_match": value})


@query(f"{_BASE} SELECT id, currency_match, amount_match FROM v WHERE n_lines IS NOT NULL")
def value_currency_checks(spark, d: str) -> DataFrame:
    return _checked(spark, d).filter("n_lines is not null").select("id", "currency_match", "amount_match")


_STATUS = "CASE WHEN n_lines IS NULL THEN 'MANQUE_DOC' WHEN currency_match = 'NOK' OR amount_match = 'NOK' THEN 'KO_BLOQUANT' WHEN currency_match = 'WARN' OR amount_match = 'WARN' THEN 'OK_A_CONTROLER' ELSE 'OK' END"


def _status(spark, d: str) -> DataFrame:
    checks = F.array(rules.check("currency_match", F.col("currency_match")), rules.check("amount_match", F.col("amount_match")))
    return _checked(spark, d).withColumn("checks", checks).withColumn("status", rules.status(F.lit(True), F.col("n_lines").isNotNull(), F.col("checks")))


@query(f"{_BASE} SELECT {_STATUS} AS status, count(*) AS n, {_STATUS} IN ('KO_BLOQUANT', 'KO', 'MANQUE_DOC') AS anomaly FROM v GROUP BY 1, 3")
def dossier_status_summary(spark, d: str) -> DataFrame:
    return rules.summary(_status(spark, d).select("status"))


@query(f"{_BASE} SELECT id, {_STATUS} AS status, coalesce(CASE WHEN n_lines IS NOT NULL THEN concat_ws('; ', CASE WHEN currency_match = 'NOK' THEN 'currency_match' END, CASE WHEN amount_match = 'NOK' THEN 'amount_match' END) END, '') AS blocking FROM v")
def synthesis_report(spark, d: str) -> DataFrame:
    bad = F.transform(F.filter("checks", lambda c: (c["status"] == "NOK") & (c["severity"] == "CRITICAL")), lambda c: c["code"])
    return _status(spark, d).select("id", "status", F.when(F.col("n_lines").isNotNull(), F.array_join(bad, "; ")).otherwise("").alias("blocking"))


@query(f"{_BASE} SELECT id, code FROM (SELECT id, 'currency_match' AS code FROM v WHERE n_lines IS NOT NULL AND currency_match = 'WARN' UNION ALL SELECT id, 'amount_match' FROM v WHERE n_lines IS NOT NULL AND amount_match = 'WARN')")
def warnings_report(spark, d: str) -> DataFrame:
    return _status(spark, d).filter("n_lines is not null").select("id", F.explode("checks").alias("c")).filter("c.status = 'WARN'").select("id", "c.code")


@query(f"""{_BASE}, e AS (SELECT id, d_vat, same, n_lines, CASE WHEN id % 13 = 0 THEN NULL WHEN id % 5 < 3 THEN '{OURS}' ELSE vat END AS expected, CASE WHEN id % 3 = 0 THEN '{OURS}' ELSE d_vat END AS declared FROM k)
SELECT id, CASE WHEN expected IS NULL THEN CASE WHEN declared = '{OURS}' THEN 'WARN' ELSE 'NOK' END WHEN expected <> '{OURS}' THEN CASE WHEN declared = '{OURS}' AND same THEN 'WARN' ELSE 'NOK' END ELSE 'OK' END AS tva_scope,
CASE WHEN expected = '{OURS}' THEN CASE WHEN declared = expected THEN 'OK' ELSE 'NOK' END END AS tva_match_decl FROM e WHERE n_lines IS NOT NULL""")
def entity_checks(spark, d: str) -> DataFrame:
    k = F.col("id")
    expected = F.when(k % 13 == 0, F.lit(None)).when(k % 5 < 3, OURS).otherwise(F.col("vat"))
    declared = F.when(k % 3 == 0, OURS).otherwise(F.col("d_vat"))
    near = F.coalesce(C.close(F.col("total"), F.col("d_total"), 1.0, 0.02), F.lit(False))
    scope, match = rules.entity(expected, declared, F.array(F.lit(OURS)), F.lit(False), near)
    return _joined(spark, d).filter("n_lines is not null").select("id", scope.alias("tva_scope"), match.alias("tva_match_decl"))


#: Two entities of one client: A and B.
_TWO = identity.Profile([("FR12900000001", "900000001"), ("FR34900000002", "900000002")], [("ACME PARFUMS", "FR12900000001")])
_A, _B = _TWO.vats


@query(f"""WITH i AS ({derive.INVOICES}), x AS ({derive.DECLARATIONS}), j AS (SELECT i.id, i.id % 8 AS k, i.vat, {_close('i.total', 'x.total', 1.0, 0.02)} AS near FROM i JOIN x ON i.id = x.id)
SELECT id, CASE WHEN k IN (0, 1) THEN 'WARN' WHEN k = 2 THEN 'NOK' WHEN k = 3 THEN CASE WHEN near THEN 'WARN' ELSE 'NOK' END WHEN k = 4 THEN 'NOK' ELSE 'OK' END AS tva_scope,
CASE k WHEN 5 THEN 'WARN' WHEN 6 THEN 'OK' WHEN 7 THEN 'NOK' END AS tva_match_decl FROM j""")
def entity_branches(spark, d: str) -> DataFrame:
    """Whose goods: invoices that name no one, someone else or the client (by number or by name) against declarations that name no one, one entity, or both."""
    i, x, k = derive.invoices(spark, d), derive.declarations(spark, d), F.col("id") % 8
    none = F.lit(None).cast("string")
    vat = F.when(k < 3, none).when(k == 6, "fr12 900000001").when(k == 7, none).when(k == 5, _A).otherwise(F.col("vat"))
    text = F.when(k == 7, "Invoice\nSold to Acme Parfums, Paris").when(k == 3, "Invoice\nShip to someone else").otherwise("Invoice")
    d_vat = F.when(k.isin(0, 3), _A).when(k == 6, _A).when(k == 7, _B).when(k == 1, "FR55555555555").otherwise(none)
    d_text = F.when(k.isin(1, 5), "importer SIREN 900 000 001, declarant FR34 900000002").when(k == 2, "importer unknown").otherwise("declaration")
    invoices = i.select(F.col("id").alias("invoice_id"), vat.alias("vat"), text.alias("text"), "total")
    declarations = x.select(F.col("id").alias("declaration_id"), d_vat.alias("vat"), d_text.alias("text"), "total")
    linked = x.select(F.col("id").alias("invoice_id"), F.col("id").alias("declaration_id"))
    return entities.checks(linked, invoices, declarations, _TWO).select(F.col("invoice_id").alias("id"), "tva_scope", "tva_match_decl")


_CONFUSED = " OR ".join(f"(x = '{x}' AND y IN ({', '.join(repr(y) for y in ys)}))" for x, ys in C.CONFUSABLE.items())
_PAIR = f"""p AS (SELECT p_partkey AS id, (420000 + p_partkey % 5000)::VARCHAR AS a, (420000 + (p_partkey * 7 + 3) % 5000)::VARCHAR AS b FROM part),
q AS (SELECT id, a, b, unnest([1,2,3,4,5,6]) AS k FROM p), r AS (SELECT id, a, b, substr(a, k, 1) AS x, substr(b, k, 1) AS y FROM q)"""


@query(f"WITH {_PAIR} SELECT id, a, b, count_if(x <> y) BETWEEN 1 AND 2 AND bool_and(x = y OR {_CONFUSED}) AS confusable FROM r GROUP BY id, a, b")
def hs_confusable_pairs(spark, d: str) -> DataFrame:
    k = F.col("p_partkey")
    p = spark.read.parquet(f"{d}/part.parquet").select(k.alias("id"), (420000 + k % 5000).cast("string").alias("a"), (420000 + (k * 7 + 3) % 5000).cast("string").alias("b"))
    return p.select("id", "a", "b", C.confusable(F.col("a"), F.col("b")).alias("confusable"))


@query(f"""WITH x AS ({derive.DECLARATIONS}), e AS (SELECT id, hs6, CASE WHEN id % 17 = 0 THEN [] WHEN id % 3 = 0 THEN list_sort(list_distinct(list_append(hs6, '990000'))) ELSE hs6[1:2] END AS inv FROM x)
SELECT id, CASE WHEN len(inv) = 0 THEN 'WARN' WHEN len(list_filter(inv, lambda z: NOT list_contains(hs6, z))) = 0 THEN 'OK' ELSE 'NOK' END AS hs_subset FROM e""")
def hs_subset_checks(spark, d: str) -> DataFrame:
    k = F.col("id")
    inv = F.when(k % 17 == 0, F.array().cast("array<string>")).when(k % 3 == 0, F.array_distinct(F.concat("hs6", F.array(F.lit("990000"))))).otherwise(F.slice("hs6", 1, 2))
    return derive.declarations(spark, d).select("id", rules.tariff(inv, F.col("hs6")).alias("hs_subset"))


@query(f"""WITH x AS ({derive.DECLARATIONS}), e AS (SELECT id, CASE WHEN id % 6 = 0 THEN duty + 40 WHEN id % 6 < 4 THEN duty END AS declared, CASE WHEN id % 9 = 0 THEN NULL WHEN id % 4 = 0 THEN duty * 1.05 WHEN id % 4 = 1 THEN duty * 1.01 ELSE duty + 0.3 END AS paid FROM x)
SELECT id, CASE WHEN declared IS NULL OR paid IS NULL THEN 'NOK' WHEN {_close('declared', 'paid', 0.5, 0.02)} THEN 'OK' ELSE 'NOK' END AS duties_match FROM e""")
def prestation_duty_check(spark, d: str) -> DataFrame:
    k, duty = F.col("id"), F.col("duty")
    none = F.lit(None).cast("double")
    declared = rules.declared_duties(F.when((k % 6 < 4) & (duty != 0), duty).otherwise(none), none, none, F.when(k % 6 == 0, duty + 40).when(k % 6 < 4, duty).otherwise(none))
    paid = F.when(k % 9 == 0, none).when(k % 4 == 0, duty * 1.05).when(k % 4 == 1, duty * 1.01).otherwise(duty + 0.3)
    return derive.declarations(spark, d).select("id", rules.duties(declared, paid).alias("duties_match"))


def _pairs(i: DataFrame, x: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    i = i.select("pool", F.col("id").alias("invoice_id"), none.alias("folder"), C.ref_key(F.col("ref")).alias("ref"), none.alias("awb"), "total", "vat", F.array().cast("array<string>").alias("hs6"), F.lit("").alias("lead"))
    x = x.select("pool", F.col("id").alias("declaration_id"), F.col("id").alias("ord"), none.alias("folder"), F.array(F.when(F.col("id") % 2 == 0, C.ref_key(F.col("ref"))).otherwise("NONE")).alias("refs"), F.array().cast("array<string>").alias("awbs"), "total", "currency", F.when(F.col("id") % 4 == 0, 1.08).alias("fx"), "vat", F.array().cast("array<string>").alias("hs6"), F.lit("").alias("lead"))
    return links.pool_scores(i, x)


def _sides(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """Invoices and declarations with folders, references, waybills, totals, VAT numbers and leading references."""
    i, x = derive.dossiers(derive.invoices(spark, d)), derive.dossiers(derive.declarations(spark, d))
    k, none = F.col("id"), F.array().cast("array<string>")
    folder = F.concat(F.lit("f"), k % 4)
    awb, lead = F.concat(F.lit("W"), F.floor(k / 3)), F.floor(k / 7).cast("string")
    i = i.select("pool", k.alias("invoice_id"), F.when(k % 6 == 0, folder).alias("folder"), C.ref_key(F.col("ref")).alias("ref"), F.when(k % 5 == 0, awb).alias("awb"), "total", "vat", none.alias("hs6"), F.when(k % 9 == 0, lead).otherwise("").alias("lead"))
    refs = F.array(F.when(k % 2 == 0, C.ref_key(F.col("ref"))).otherwise("NONE"))
    x = x.select("pool", k.alias("declaration_id"), k.alias("ord"), F.when(k % 3 == 0, folder).alias("folder"), refs.alias("refs"), F.when(k % 4 == 1, F.array(awb)).otherwise(none).alias("awbs"), "total", "currency", F.when(k % 4 == 0, 1.08).alias("fx"), "vat", none.alias("hs6"), F.when(k % 2 == 0, lead).otherwise("").alias("lead"))
    return i, x


def _scored(spark, d: str) -> DataFrame:
    """The invoices and declarations of a dossier that share something."""
    return links.shared_terms(*_sides(spark, d))


def _scored_all(spark, d: str) -> DataFrame:
    """Every invoice and declaration, in pools of bounded size: pairs grow with the rows."""
    return _pairs(derive.dossiers(derive.invoices(spark, d)), derive.dossiers(derive.declarations(spark, d)))


_SCORED = f"""WITH i AS ({derive.INVOICES}), x AS ({derive.DECLARATIONS}),
y AS (SELECT id, id // {derive.DOSSIER} AS pool, total, currency, vat, CASE WHEN id % 4 = 0 THEN 1.08::DOUBLE END AS fx, CASE WHEN id % 2 = 0 THEN regexp_replace(upper(ref), '[^A-Z0-9]', '', 'g') ELSE 'NONE' END AS ref,
  CASE WHEN id % 3 = 0 THEN 'f' || id % 4 END AS folder, CASE WHEN id % 4 = 1 THEN 'W' || id // 3 END AS awb, CASE WHEN id % 2 = 0 THEN (id // 7)::VARCHAR ELSE '' END AS lead FROM x),
z AS (SELECT y.pool, i.id AS invoice_id, y.id AS declaration_id, y.id AS ord, regexp_replace(upper(i.ref), '[^A-Z0-9]', '', 'g') AS r, y.ref AS s, i.total AS t, y.total AS u, y.currency AS c, y.fx, i.vat = y.vat AS v,
  CASE WHEN i.id % 6 = 0 THEN 'f' || i.id % 4 END AS f, y.folder AS g, i.id % 5 = 0 AND 'W' || i.id // 3 = y.awb AS w, i.id % 9 = 0 AND (i.id // 7)::VARCHAR = y.lead AS l FROM i JOIN y ON i.id // {derive.DOSSIER} = y.pool),
s AS (SELECT pool, invoice_id, declaration_id, ord, score FROM (SELECT pool, invoice_id, declaration_id, ord, (CASE WHEN f <> g THEN 0 ELSE CASE WHEN f = g THEN 100 ELSE 0 END + CASE WHEN contains(r, s) OR contains(s, r) THEN 80 ELSE 0 END + CASE WHEN w THEN 60 ELSE 0 END
  + CASE WHEN {_close('t', 'u', 1.0, 0.01)} THEN 35 WHEN fx > 0 AND c <> 'EUR' AND {_close('t / fx', 'u', 1.0, 0.01)} THEN 20 ELSE 0 END + CASE WHEN v THEN 20 ELSE 0 END + CASE WHEN l THEN 70 ELSE 0 END END)::INT AS score FROM z) WHERE score > 0),
m AS (SELECT *, max(score) OVER (PARTITION BY pool, invoice_id) AS best, row_number() OVER (PARTITION BY pool, invoice_id ORDER BY score DESC, ord) AS n FROM s)"""


@query(f"{_SCORED} SELECT * FROM s")
def invoice_decl_score(spark, d: str) -> DataFrame:
    return _scored(spark, d)


@query(f"{_SCORED} SELECT pool, invoice_id, declaration_id, ord, score FROM m WHERE score >= 60 OR (best < 60 AND n = 1 AND score >= 15)")
def invoice_decl_matches(spark, d: str) -> DataFrame:
    """By all pairs of a dossier: these hold DOSSIER ids at most, where that is quicker than terms."""
    return links.matches(links.pool_scores(*_sides(spark, d)).filter("score > 0"))


@query(f"{_SCORED} SELECT pool, invoice_id, declaration_id, ord, score FROM m WHERE score >= 60 OR (best < 60 AND n = 1 AND score >= 15)")
def invoice_decl_matches_by_terms(spark, d: str) -> DataFrame:
    """The same by terms, as a run does it, whose pools have no bound."""
    return links.match(*_sides(spark, d))


@query(f"{_SCORED} SELECT id FROM x WHERE id NOT IN (SELECT declaration_id FROM m WHERE score >= 60 OR (best < 60 AND n = 1 AND score >= 15))")
def orphan_declarations(spark, d: str) -> DataFrame:
    used = links.matches(links.pool_scores(*_sides(spark, d)).filter("score > 0")).select(F.col("declaration_id").alias("id")).distinct()
    return links.orphans(derive.declarations(spark, d).select("id"), used, "id")


def _chosen(spark, d: str, points: tuple[int, int, int, int]) -> DataFrame:
    i, x = _sides(spark, d)
    bundle = lambda c: F.floor(F.col(c) / 4).alias("bundle_id")
    linked = i.select("invoice_id", bundle("invoice_id")).join(x.select("declaration_id", "ord", bundle("declaration_id")), "bundle_id")
    return links.best_declaration(linked, i, x, points)


def _chosen_sql(points: tuple[int, int, int, int]) -> str:
    folder, ref, awb, total = points
    return f"""{_SCORED}, a AS (SELECT invoice_id // 4 AS bundle_id, invoice_id, declaration_id, ord, (CASE WHEN f = g THEN {folder} ELSE 0 END + CASE WHEN contains(r, s) OR contains(s, r) THEN {ref} ELSE 0 END
  + CASE WHEN w THEN {awb} ELSE 0 END + CASE WHEN {_close('t', 'u', 1.0, 0.01)} THEN {total} ELSE 0 END)::INT AS score FROM z WHERE invoice_id // 4 = declaration_id // 4),
b AS (SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY score DESC, ord) AS n FROM a) SELECT bundle_id, invoice_id, declaration_id, score FROM b WHERE n = 1"""


@query(_chosen_sql(links.FOR_RULES))
def best_declaration_rules(spark, d: str) -> DataFrame:
    """The declaration that each invoice of a bundle is checked against."""
    return _chosen(spark, d, links.FOR_RULES)


@query(_chosen_sql(links.FOR_REPAIR))
def best_declaration_repair(spark, d: str) -> DataFrame:
    """The declaration that each invoice of a bundle may be repaired from."""
    return _chosen(spark, d, links.FOR_REPAIR)


def _paid(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """Bundles of declarations, and a forwarder's invoice an order."""
    x, k = derive.dossiers(derive.declarations(spark, d)), F.col("id")
    text = lambda prefix, n: F.concat(F.lit(prefix), F.floor(k / n).cast("string"))
    some = lambda condition, value: F.collect_list(F.when(condition, value))
    bundles = x.groupBy("pool", F.floor(k / 4).alias("bundle_id")).agg(some(k % 5 != 0, text("D", 32)).alias("dossiers"), some(k % 3 == 0, text("M", 1)).alias("mrns"), some(k % 4 == 1, text("W", 3)).alias("awbs"), some(k % 2 == 0, text("p", 16)).alias("sources"), F.sum(F.when(k % 4 == 0, F.col("duty"))).alias("duties"))
    paid = F.when(k % 8 == 0, F.col("duty") + 0.4).when(k % 4 == 0, F.col("duty") * 1.5)
    prestations = x.select("pool", k.alias("prestation_id"), k.alias("ord"), F.when(k % 3 == 0, text("D", 33)).alias("dossier"), F.array(F.when(k % 2 == 0, F.concat(F.lit("M"), k + 1)).otherwise("")).alias("mrns"), F.array(F.when(k % 5 == 0, text("W", 3)).otherwise("")).alias("awbs"), F.when(k % 7 == 0, text("p", 16)).alias("source"), paid.alias("paid"))
    return bundles, prestations


_PAID = f"""WITH x AS ({derive.DECLARATIONS}),
b AS (SELECT id // {derive.DOSSIER} AS pool, id // 4 AS bundle_id, list('D' || id // 32) FILTER (WHERE id % 5 <> 0) AS dossiers, list('M' || id) FILTER (WHERE id % 3 = 0) AS mrns, list('W' || id // 3) FILTER (WHERE id % 4 = 1) AS awbs, list('p' || id // 16) FILTER (WHERE id % 2 = 0) AS sources, sum(duty) FILTER (WHERE id % 4 = 0) AS duties FROM x GROUP BY ALL),
p AS (SELECT id // {derive.DOSSIER} AS pool, id AS prestation_id, CASE WHEN id % 3 = 0 THEN 'D' || id // 33 END AS dossier, CASE WHEN id % 2 = 0 THEN 'M' || (id + 1) END AS mrn, CASE WHEN id % 5 = 0 THEN 'W' || id // 3 END AS awb, CASE WHEN id % 7 = 0 THEN 'p' || id // 16 END AS source, CASE WHEN id % 8 = 0 THEN duty + 0.4::DOUBLE WHEN id % 4 = 0 THEN duty * 1.5::DOUBLE END AS paid FROM x),
s AS (SELECT bundle_id, prestation_id, (CASE WHEN dossier IS NOT NULL AND dossiers IS NOT NULL AND NOT list_contains(dossiers, dossier) THEN 0 ELSE CASE WHEN list_contains(dossiers, dossier) THEN 100 ELSE 0 END + CASE WHEN list_contains(mrns, mrn) THEN 90 ELSE 0 END
  + CASE WHEN list_contains(awbs, awb) THEN 60 ELSE 0 END + CASE WHEN duties <> 0 AND abs(paid - duties) <= 1.0::DOUBLE THEN 30 ELSE 0 END + CASE WHEN list_contains(sources, source) THEN 40 ELSE 0 END END)::INT AS score FROM b JOIN p USING (pool)),
w AS (SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY score DESC, prestation_id) AS n FROM s)"""


@query(f"{_PAID} SELECT bundle_id, prestation_id, prestation_id AS ord, score FROM s WHERE score > 0")
def prestation_bundle_score(spark, d: str) -> DataFrame:
    """Forwarders' invoices and bundles of a dossier that share something."""
    return links.prestation_bundle_score(*_paid(spark, d)).filter("score > 0")


@query(f"{_PAID} SELECT bundle_id, prestation_id, score FROM w WHERE n = 1 AND score >= 30")
def prestation_bundle_matches(spark, d: str) -> DataFrame:
    """The forwarder's invoice of each bundle."""
    return links.best_prestation(links.prestation_bundle_score(*_paid(spark, d)))


@query(f"{_PAID} SELECT prestation_id FROM p WHERE prestation_id NOT IN (SELECT prestation_id FROM w WHERE n = 1 AND score >= 30)")
def orphan_prestations(spark, d: str) -> DataFrame:
    """Forwarders' invoices of no bundle."""
    bundles, prestations = _paid(spark, d)
    return links.orphans(prestations.select("prestation_id"), links.best_prestation(links.prestation_bundle_score(bundles, prestations)).distinct(), "prestation_id")


# The same by reference, total and VAT alone, every pair of a dossier with its score; the tests also hold them against brute force.
_SCORED_ALL = f"""WITH i AS ({derive.INVOICES}), x AS ({derive.DECLARATIONS}),
y AS (SELECT id, total, currency, vat, CASE WHEN id % 4 = 0 THEN 1.08::DOUBLE END AS fx, CASE WHEN id % 2 = 0 THEN regexp_replace(upper(ref), '[^A-Z0-9]', '', 'g') ELSE 'NONE' END AS ref FROM x),
z AS (SELECT y.id // {derive.DOSSIER} AS pool, i.id AS invoice_id, y.id AS declaration_id, regexp_replace(upper(i.ref), '[^A-Z0-9]', '', 'g') AS r, y.ref AS s, i.total AS t, y.total AS u, y.currency AS c, y.fx, i.vat = y.vat AS v FROM i JOIN y ON i.id // {derive.DOSSIER} = y.id // {derive.DOSSIER}),
s AS (SELECT pool, invoice_id, declaration_id, declaration_id AS ord, (CASE WHEN contains(r, s) OR contains(s, r) THEN 80 ELSE 0 END + CASE WHEN {_close('t', 'u', 1.0, 0.01)} THEN 35 WHEN fx > 0 AND c <> 'EUR' AND {_close('t / fx', 'u', 1.0, 0.01)} THEN 20 ELSE 0 END + CASE WHEN v THEN 20 ELSE 0 END)::INT AS score FROM z),
m AS (SELECT *, max(score) OVER (PARTITION BY pool, invoice_id) AS best, row_number() OVER (PARTITION BY pool, invoice_id ORDER BY score DESC, ord) AS n FROM s)"""


@query(f"{_SCORED_ALL} SELECT * FROM s")
def invoice_decl_score_all(spark, d: str) -> DataFrame:
    return _scored_all(spark, d)


@query(f"{_SCORED_ALL} SELECT pool, invoice_id, declaration_id, ord, score FROM m WHERE score >= 60 OR (best < 60 AND n = 1 AND score >= 15)")
def invoice_decl_matches_all(spark, d: str) -> DataFrame:
    return links.matches(_scored_all(spark, d))


@query(f"{_SCORED_ALL} SELECT id FROM x WHERE id NOT IN (SELECT declaration_id FROM m WHERE score >= 60 OR (best < 60 AND n = 1 AND score >= 15))")
def orphan_declarations_all(spark, d: str) -> DataFrame:
    used = links.matches(_scored_all(spark, d)).select(F.col("declaration_id").alias("id")).distinct()
    return links.orphans(derive.declarations(spark, d).select("id"), used, "id")


@query(f"""WITH i AS ({derive.INVOICES}), s AS (SELECT pool AS bundle_id, id AS prestation_id, id AS ord, (id % 5 * 20)::INT AS score FROM i),
r AS (SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY score DESC, ord) AS n FROM s) SELECT bundle_id, prestation_id, score FROM r WHERE n = 1 AND score >= 30""")
def best_prestation(spark, d: str) -> DataFrame:
    i = derive.invoices(spark, d).select(F.col("pool").alias("bundle_id"), F.col("id").alias("prestation_id"), F.col("id").alias("ord"), (F.col("id") % 5 * 20).cast("int").alias("score"))
    return links.best_prestation(i)


_MERGED = """WITH b AS (SELECT o_custkey % 10 AS pool, o_orderkey AS ord, 'D' || o_orderkey % 50 AS member, CASE o_orderkey % 3 WHEN 0 THEN 'n:N' || o_custkey % 40 WHEN 1 THEN 'a:A' || o_custkey % 30 ELSE 's:S' || o_orderkey END AS merge_key FROM orders),
f AS (SELECT pool, merge_key, member, min(ord) AS ord FROM b GROUP BY ALL)
SELECT pool, merge_key, ord, n_bundles, members FROM (SELECT pool, merge_key, string_agg(member, ',' ORDER BY ord) AS members FROM f GROUP BY ALL) JOIN (SELECT pool, merge_key, min(ord) AS ord, count(*) AS n_bundles FROM b GROUP BY ALL) USING (pool, merge_key)"""


@query(_MERGED)
def merge_bundles(spark, d: str) -> DataFrame:
    return links.merge_bundles(_bundles(spark.read.parquet(f"{d}/orders.parquet")))


def _bundles(orders: DataFrame) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return orders.select((c % 10).alias("pool"), k.alias("ord"), F.concat(F.lit("D"), k % 50).alias("member"), F.when(k % 3 == 0, F.concat(F.lit("N"), c % 40)).alias("number"), F.when(k % 3 == 1, F.concat(F.lit("A"), c % 30)).alias("awb"), F.lit("").alias("mrn"), F.concat(F.lit("S"), k).alias("sources"))


@query(_MERGED)
def merge_bundles_all(spark, d: str) -> DataFrame:
    """The same, held against brute force by the tests."""
    return links.merge_bundles(_bundles(spark.read.parquet(f"{d}/orders.parquet")))


_RAW = "CASE p_partkey % 6 WHEN 0 THEN '426' || lpad((p_partkey % 1000)::VARCHAR, 6, '0') WHEN 1 THEN '100900' WHEN 2 THEN '4202.22.' || lpad((p_partkey % 100)::VARCHAR, 2, '0') WHEN 3 THEN lpad(p_partkey::VARCHAR, 10, '3') || '0' WHEN 4 THEN 'HS ' || p_partkey ELSE lpad(p_partkey::VARCHAR, 9, '6') END"


@query(f"""WITH a AS (SELECT p_partkey AS id, regexp_replace({_RAW}, '[^0-9]', '', 'g') AS d FROM part), b AS (SELECT id, CASE WHEN d = '100900' THEN '' WHEN starts_with(d, '426') THEN '420' || substr(d, 4) ELSE d END AS d FROM a),
c AS (SELECT id, CASE WHEN length(d) = 9 THEN d || '0' WHEN length(d) = 11 AND ends_with(d, '0') THEN substr(d, 1, 10) ELSE d END AS d FROM b) SELECT id, CASE WHEN length(d) BETWEEN 6 AND 10 THEN d END AS hs FROM c""")
def normalize_hs(spark, d: str) -> DataFrame:
    k = F.col("p_partkey")
    s = k.cast("string")
    raw = F.when(k % 6 == 0, F.concat(F.lit("426"), F.lpad((k % 1000).cast("string"), 6, "0"))).when(k % 6 == 1, "100900").when(k % 6 == 2, F.concat(F.lit("4202.22."), F.lpad((k % 100).cast("string"), 2, "0"))).when(k % 6 == 3, F.concat(F.lpad(s, 10, "3"), F.lit("0"))).when(k % 6 == 4, F.concat(F.lit("HS "), s)).otherwise(F.lpad(s, 9, "6"))
    return spark.read.parquet(f"{d}/part.parquet").select(k.alias("id"), C.tariff_code(raw).alias("hs"))


_CENTS = "lpad((o_orderkey * 37 % 100)::VARCHAR, 2, '0')"
_WHOLE = "(o_orderkey % 900 + 100)::VARCHAR"


@query(f"""SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 4 THEN NULL ELSE (CASE WHEN o_orderkey % 5 IN (0, 1, 2) THEN '1' ELSE '' END || {_WHOLE} || '.' || {_CENTS})::DOUBLE END AS amount FROM orders""")
def parse_amounts(spark, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    whole, cents = (k % 900 + 100).cast("string"), F.lpad((k * 37 % 100).cast("string"), 2, "0")
    text = F.when(k % 5 == 0, F.concat(F.lit("1 "), whole, F.lit(","), cents)).when(k % 5 == 1, F.concat(F.lit("1,"), whole, F.lit("."), cents)).when(k % 5 == 2, F.concat(F.lit("1."), whole, F.lit(","), cents)).when(k % 5 == 3, F.concat(F.lit(" "), whole, F.lit(","), cents)).otherwise(F.concat(F.lit("n/a "), whole))
    return spark.read.parquet(f"{d}/orders.parquet").select(k.alias("id"), C.amount(text).alias("amount"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders")
def parse_dates(spark, d: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    text = F.when(k % 4 == 0, F.date_format(day, "dd/MM/yy")).when(k % 4 == 1, F.concat(F.lit("le "), F.date_format(day, "d.M.yyyy"))).when(k % 4 == 2, F.date_format(day, "yyyy-MM-dd")).otherwise("soon")
    return spark.read.parquet(f"{d}/orders.parquet").select(k.alias("id"), C.iso_date(text).alias("iso"))


@query("SELECT c_custkey AS id, regexp_replace(upper(c_name), '[^A-Z0-9]', '', 'g') AS key, regexp_replace(c_name, '[^A-Z0-9]', '', 'g') AS strict, substr(regexp_replace(upper(c_name), '[^A-Z0-9]', '', 'g'), 1, 15) AS mrn FROM customer")
def reference_keys(spark, d: str) -> DataFrame:
    name = F.col("c_name")
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), C.ref_key(name).alias("key"), C.ref_key_strict(name).alias("strict"), C.mrn_key(name).alias("mrn"))


_KINDS = " ".join(f"WHEN '{p}' THEN '{k}'" for p, k in zip(derive.PHRASES, ["prestation_dhl", "unknown", "invoice_dhl_hawb", "declaration_delta_ie_akanea", "unknown", "packing_list", "invoice_generic", "cgv", "awb", "invoice_generic", "declaration_h7", "prestation_dsv"], strict=True))


@query(f"WITH p AS ({derive.PAGES}) SELECT path, page_no, CASE text {_KINDS} END AS doc_type FROM p")
def classify_pages(spark, d: str) -> DataFrame:
    return derive.pages(spark, d).select("path", "page_no", pages.classify(F.col("text")).alias("doc_type"))


_JOINS = """CASE r.kd WHEN 'declaration' THEN p.type IN (r.t, 'unknown') AND (r.i = '' OR p.id = '' OR r.i = p.id) WHEN 'prestation' THEN p.type IN (r.t, 'unknown')
  WHEN 'invoice' THEN p.kind = 'invoice' ELSE p.type = r.t AND r.kd IN ('packing_list', 'cgv') END"""


@query(f"""WITH RECURSIVE q AS ({derive.PAGES}), o AS (SELECT path, page_no, text, CASE text {_KINDS} END AS type, left(regexp_extract(upper(text), '{pages.MRN}', 1), 15) AS id FROM q),
p AS (SELECT *, CASE WHEN regexp_matches(type, '^(declaration|prestation|invoice)_') THEN split_part(type, '_', 1) ELSE type END AS kind, row_number() OVER (PARTITION BY path ORDER BY page_no) AS k FROM o),
r AS (SELECT path, k, 1 AS seg_no, type AS t, kind AS kd, id AS i FROM p WHERE k = 1 UNION ALL
  SELECT p.path, p.k, CASE WHEN {_JOINS} THEN r.seg_no ELSE r.seg_no + 1 END, CASE WHEN {_JOINS} THEN r.t ELSE p.type END, CASE WHEN {_JOINS} THEN r.kd ELSE p.kind END, CASE WHEN {_JOINS} THEN r.i ELSE p.id END FROM r JOIN p ON p.path = r.path AND p.k = r.k + 1)
SELECT path, seg_no, t AS doc_type, min(page_no)::INT AS start_page, max(page_no)::INT AS end_page, string_agg(text, chr(10) || chr(10) ORDER BY page_no) AS text FROM r JOIN p USING (path, k) GROUP BY path, seg_no, t""")
def segment_pages(spark, d: str) -> DataFrame:
    return pages.segments(derive.pages(spark, d).withColumn("doc_type", pages.classify(F.col("text"))).select("path", "page_no", "doc_type", "text"))


_TAGS = "regexp_replace(html, '<[^>]{1,10}>', ' ', 'g')"


@query(f"SELECT page_id, md5({_TAGS}) AS clean_md5, length({_TAGS}) AS n_chars FROM pages")
def clean_markup(spark, d: str) -> DataFrame:
    text = pages.clean_markup(F.col("html"))
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.md5(text).alias("clean_md5"), F.length(text).cast("long").alias("n_chars"))


_WORDS = " + ".join(f"((length(u) - length(replace(u, '{w}', ''))) // {len(w)}) * 250" for w in pages.SCORE_WORDS)
_MARKS = " + ".join(f"len(regexp_extract_all(u, '{p}')) * {w}" for w, p in pages.SCORE_PATTERNS)


@query(f"WITH d AS (SELECT doc_id, text, upper(replace(text, 'ß', 'ss')) AS u FROM documents) SELECT doc_id, coalesce(least(length(text), 4000) + {_WORDS} + {_MARKS}, 0)::BIGINT AS score FROM d")
def text_quality(spark, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", pages.quality_score(F.col("text")).alias("score"))


@query("SELECT conv_id, arg_min(turn, (-length(text), turn)) AS turn, max(length(text))::BIGINT AS score FROM conversations GROUP BY conv_id")
def best_text_variant(spark, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.length("text").cast("long").alias("score"))
    return pages.best_variant(c, "conv_id", "turn", "score")


@query("""WITH RECURSIVE v AS (SELECT l_orderkey, round(l_extendedprice, 2) AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, round(l_extendedprice, 2)) AS i FROM lineitem),
t AS (SELECT l_orderkey, max(i) AS n, CASE WHEN l_orderkey % 2 = 0 THEN sum(x) FILTER (i <= 2) ELSE 77.77 END AS wanted FROM v GROUP BY l_orderkey),
r AS (SELECT l_orderkey, 0 AS i, 0 AS used, 0::BIGINT AS cents FROM t UNION ALL
  SELECT r.l_orderkey, r.i + 1, r.used + b, r.cents + b * round_even(v.x * 100, 0)::BIGINT FROM r JOIN v ON v.l_orderkey = r.l_orderkey AND v.i = r.i + 1, (VALUES (0), (1)) AS c(b))
SELECT l_orderkey, bool_or(used >= 2 AND abs(cents - round_even(wanted * 100, 0)::BIGINT) <= round_even(greatest(1.0, wanted * 0.005) * 100, 0)::BIGINT) AS proved FROM r JOIN t USING (l_orderkey) WHERE i = n GROUP BY l_orderkey""")
def sum_evidence(spark, d: str) -> DataFrame:
    money = F.round("l_extendedprice", 2)
    lines = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", money.alias("x"))).alias("a"))
    values = F.transform(F.sort_array("a"), lambda s: s["x"])
    target = F.when(F.col("l_orderkey") % 2 == 0, F.aggregate(F.slice(values, 1, 2), F.lit(0.0), lambda a, x: a + x)).otherwise(F.lit(77.77))
    return lines.select("l_orderkey", evidence.is_sum_of(values, target).alias("proved"))


@query("SELECT s_suppkey AS id, left(regexp_replace('D/' || s_nationkey, '[\\\\/*?:\\[\\]]', '_', 'g'), 31) || CASE WHEN row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) > 1 THEN '_' || row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) ELSE '' END AS tab FROM supplier")
def safe_tab_names(spark, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    base = F.substring(F.regexp_replace(F.concat(F.lit("D/"), "s_nationkey"), r"[\\/*?:\[\]]", "_"), 1, 31)
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("id"), base.alias("base"))
    n = F.row_number().over(W.partitionBy("base").orderBy("id"))
    return s.withColumn("n", n).select("id", F.when(F.col("n") > 1, F.concat(F.substring("base", 1, 31), F.lit("_"), F.col("n"))).otherwise(F.col("base")).alias("tab"))


@query(f"""{_BASE}, n AS (SELECT {_STATUS} AS status, count(*) AS n FROM v GROUP BY 1)
SELECT '{{"by_status":[' || string_agg('{{"status":"' || status || '","n":' || n || '}}', ',' ORDER BY status) || '],"anomalies":' || sum(CASE WHEN status IN ('KO_BLOQUANT', 'KO', 'MANQUE_DOC') THEN n ELSE 0 END)::BIGINT || '}}' AS summary FROM n""")
def run_summary_json(spark, d: str) -> DataFrame:
    s = rules.summary(_status(spark, d).select("status"))
    return s.agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("status", "n"))).alias("by_status"), F.sum(F.when(F.col("anomaly"), F.col("n")).otherwise(0)).alias("anomalies"))).alias("summary"))


_SCOPE = [str(420200 + i) for i in range(0, 100, 2)]


@query(f"""WITH p AS (SELECT p_partkey AS id, (420200 + p_partkey % 100)::VARCHAR AS h, lpad((p_partkey * 13 % 10000)::VARCHAR, 4, '0') AS r FROM part),
c AS (SELECT id, h, CASE id % 6 WHEN 0 THEN [h || r] WHEN 1 THEN [h || r] WHEN 2 THEN [h || substr(r, 1, 2)] WHEN 3 THEN [] WHEN 4 THEN [h || r] ELSE [] END AS found FROM p)
SELECT id, array_to_string(CASE WHEN h::INT % 2 = 0 THEN CASE WHEN id % 6 = 5 THEN ['7117190090'] ELSE found END WHEN id % 6 = 5 THEN ['7117190090'] ELSE [] END, ',') AS codes FROM c""")
def extract_hs(spark, d: str) -> DataFrame:
    """Tariff codes of an invoice line a part: after a label, beside a country, in groups, as a telephone number (none), in a table of values, by words."""
    k = F.col("p_partkey")
    h, r = (420200 + k % 100).cast("string"), F.lpad((k * 13 % 10000).cast("string"), 4, "0")
    one, ten = F.concat(F.substring(h, 1, 4), F.lit("."), F.substring(h, 5, 2), F.lit("."), F.substring(r, 1, 2)), F.concat(h, r)
    texts = [F.concat(F.lit("HS Code: "), ten), F.concat(F.lit("2 pieces France "), ten), F.concat(F.lit("leather bag "), one, F.lit(" black")), F.concat(F.lit("Tel. "), ten), F.concat(F.lit("Unit value EUR\n2 "), ten), F.lit("Brooch in a box")]
    text = F
    for i, t in enumerate(texts[:-1]):
        text = text.when(k % 6 == i, t)
    scope = [*_SCOPE, "711719"]
    return spark.read.parquet(f"{d}/part.parquet").select(k.alias("id"), F.array_join(tariff.codes(text.otherwise(texts[-1]), scope=scope), ",").alias("codes"))


@query(f"""WITH p AS (SELECT p_partkey AS id, (420200 + p_partkey % 100)::VARCHAR AS h, (640300 + p_partkey % 90)::VARCHAR AS g, lpad((p_partkey * 13 % 10000)::VARCHAR, 4, '0') AS r FROM part),
c AS (SELECT id, CASE id % 9 WHEN 0 THEN [h || substr(r, 1, 2)] WHEN 1 THEN [h || r] WHEN 2 THEN [h || substr(r, 1, 2), g || r] WHEN 3 THEN [h || r, g || r] WHEN 4 THEN [g || r, h || r] WHEN 5 THEN [h || r, g || substr(r, 1, 2)] WHEN 6 THEN [] WHEN 7 THEN ['7117190090'] ELSE [h || r, g || substr(r, 1, 2)] END AS found FROM p),
s AS (SELECT id, list_filter(found, lambda c: substr(c, 1, 4) = '7117' OR substr(c, 6, 1)::INT % 2 = 0) AS found FROM c)
SELECT id, array_to_string(found, ',') AS codes FROM s""")
def hs_steps(spark, d: str) -> DataFrame:
    """Tariff codes of a text a part that only one step or two in turn find: split over lines, a label far ahead, a grid, a table of
    values before a country, countries on either side, groups, nothing but a telephone number, words, several labels in the table's order."""
    k = F.col("p_partkey")
    h, g, r = (420200 + k % 100).cast("string"), (640300 + k % 90).cast("string"), F.lpad((k * 13 % 10000).cast("string"), 4, "0")
    part = lambda c, i, n: F.substring(c, i, n)
    say = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v for v in x))
    texts = [
        say("1B:", part(h, 1, 4), ". 1.000 kg bag FRANCE ", part(h, 5, 2), ".", part(r, 1, 2), " IB:6403. shoe of no country 11.22"),
        say("CITES Customs paper of the bag\nNo ", h, r),
        say("Customs Code\n", part(h, 1, 4), " ", part(h, 5, 2), " ", part(r, 1, 2), " bag\n", g, r, "\nNumber of parcels 3"),
        say("Unit value EUR\n2 ", h, r, "\nFrance ", g, r),
        say(h, r, " Italy | Italy | ", g, r),
        say("bag ", part(h, 1, 4), ".", part(h, 5, 2), ".", r, ", shoe ", part(g, 1, 4), "-", part(g, 5, 2), "-", part(r, 1, 2)),
        say("Tel. ", h, r),
        F.lit("one brooch"),
        say("HS-Code: ", g, part(r, 1, 2), "\nTarif Code ", h, r),
    ]
    text = F
    for i, t in enumerate(texts[:-1]):
        text = text.when(k % len(texts) == i, t)
    scope = [str(x + i) for x in (420200, 640300) for i in range(0, 100, 2)] + ["711719"]
    return spark.read.parquet(f"{d}/part.parquet").select(k.alias("id"), F.array_join(tariff.codes(text.otherwise(texts[-1]), scope=scope), ",").alias("codes"))


@query("""WITH l AS (SELECT l_orderkey AS id, 4202000000 + l_partkey % 7 AS hs, l_partkey * 7 % 90000 + 100 AS a, l_suppkey % 500 + 9 AS b, l_linenumber % 4 AS k FROM lineitem)
SELECT id, hs::VARCHAR AS hs_code, count(*) AS n_rows, round(sum(a / 100::DOUBLE), 2) AS dd, round(sum(CASE WHEN k <> 3 THEN (a + b) / 100::DOUBLE END), 2) AS tva, round(sum(CASE WHEN k IN (0, 1) THEN b::DOUBLE END), 2) AS at FROM l GROUP BY id, hs""")
def forwarder_duties(spark, d: str) -> DataFrame:
    """Duties by code of a forwarder's invoice an order, a row of its table a line: taxes after a row, too far from it, or none."""
    money = lambda n: F.concat(F.floor(n / 100).cast("string"), F.lit(","), F.lpad((n % 100).cast("string"), 2, "0"))
    far = F.rpad(F.lit(""), duties.ROW_WINDOW, "x ")

    def printed(line):
        a, b, n = line["l_partkey"] * 7 % 90000 + 100, line["l_suppkey"] % 500 + 9, line["l_linenumber"] % 4
        row = F.concat((line["l_partkey"] % 7 + 4202000000).cast("string"), F.lit(" 900,00 Droits de Douane 3,50 "), money(a), F.lit("\n"))
        tva, at = F.concat(F.lit("TVA à l'importation 1000,00 "), money(a + b), F.lit("\n")), F.concat(F.lit("Autres Taxes 5,00 "), b.cast("string"), F.lit(",00\n"))
        text = F.concat(row, F.when(n.isin(0, 1), F.concat(tva, at)).when(n == 2, tva).otherwise(""), F.when(n >= 2, F.concat(far, F.lit("\n"), F.when(n == 3, tva).otherwise(""))).otherwise(F.lit("Total EUR: 9,99\n")))
        return F.struct(line["l_linenumber"].alias("n"), text.alias("t"))

    # keys are shuffled, and lines are printed where the order's are together
    lines = F.sort_array(F.transform(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")), printed))
    text = F.array_join(F.transform(lines, lambda x: x["t"]), "").alias("text")
    texts = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("id")).agg(text)
    return duties.by_code_of_texts(texts)


_FORMATS = ["declaration_delta_ie_dhl", "declaration_delta_ie_akanea", "declaration_dau", "invoice_entity", "invoice_entity_proforma", "invoice_entity_delivery_note", "invoice_dhl_hawb"]


@query(f"""WITH o AS (SELECT o_orderkey AS id, o_orderkey % 7 AS k, (o_orderkey % 900 + 100)::DOUBLE AS a, (o_orderkey % 97 + 1)::DOUBLE AS b, '25FR' || lpad(o_orderkey::VARCHAR, 14, '0') AS m, '420222' || (o_orderkey % 9000 + 1000) AS h, '640399' || (o_orderkey % 8000 + 1000) AS g FROM orders)
SELECT id, [{', '.join(f"'{f}'" for f in _FORMATS)}][k + 1] AS doc_type, CASE WHEN k < 3 THEN m END AS mrn, CASE k WHEN 3 THEN 'E-' || id WHEN 4 THEN 'P-' || id WHEN 5 THEN 'N-' || id WHEN 6 THEN 'C-' || id END AS number,
CASE k WHEN 1 THEN 'USD' WHEN 4 THEN 'USD' WHEN 6 THEN 'GBP' ELSE 'EUR' END AS currency, CASE k WHEN 0 THEN a + b + 0.5::DOUBLE WHEN 5 THEN NULL ELSE a END AS total,
CASE WHEN k = 6 THEN '420221' || (id % 90 + 10) WHEN k IN (2, 4) THEN g ELSE h END AS hs_code, CASE k WHEN 0 THEN 1 END AS n_other,
CASE k WHEN 0 THEN b + 1.25::DOUBLE WHEN 2 THEN b END AS dd, CASE k WHEN 1 THEN b WHEN 2 THEN 0.0::DOUBLE END AS at, CASE k WHEN 0 THEN a WHEN 1 THEN a WHEN 2 THEN 0.0::DOUBLE END AS tva, CASE k WHEN 1 THEN a + b WHEN 2 THEN b END AS tg,
CASE k WHEN 0 THEN b + 0.5::DOUBLE WHEN 1 THEN 1.5::DOUBLE END AS net_weight_kg, CASE k WHEN 0 THEN '70' || lpad((id % 999999)::VARCHAR, 8, '1') WHEN 6 THEN '80' || lpad((id % 999999)::VARCHAR, 8, '1') END AS awb FROM o""")
def extracted_documents(spark, d: str) -> DataFrame:
    """Fields of seven formats, a document an order: articles that add up, tables of duties, codes split over lines, a note's commonest code."""
    k = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    say = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v for v in x))
    a, b, m = text(k % 900 + 100), text(k % 97 + 1), say("25FR", F.lpad(text(k), 14, "0"))
    h, g, w = say("420222", text(k % 9000 + 1000)), say("640399", text(k % 8000 + 1000)), F.lpad(text(k % 999999), 8, "1")
    total = text(k % 900 + 100 + k % 97 + 1)
    texts = [
        say("DELTA IE MRN ", m, "\nMonnaie et montant total facture EUR 9,00\nN380: INV-", text(k), ", N740: 70", w, "\nARTICLE N 1\nCode des marchandises ", h, "\nMasse nette (kg) ", b, ",5\nMontant article facture EUR ", a, ",00\nLIQUIDATION\nU165\nA445\nMontant\n", b, ",00\n", a, "\nDONNEE COMPLEMENTAIRE\nARTICLE N 2\nCode des marchandises ", g, "\nMontant article facture EUR ", b, ",50\nLIQUIDATION\nU165\nMontant\n1,25\nDONNEE COMPLEMENTAIRE\n"),
        say("Edition Akanea Delta IE MRN ", m, "\nLIQUIDATION TOTALE\nA445\nB00 - TVA\n", a, ".00\n6\nM830\nNAT\n", b, ".00\n1\nTotal\n", total, "\nMontant total facture USD 9,00\nARTICLE N 1\nNomenclature: ", h, "\nMasse nette 1,5 kg\nMontant article facture: USD ", a, ",00\n"),
        say("DAU MRN ", m, "\n22 Monnaie et montant total facture EUR ", a, ",00\n33 Code des marchandises ", g, "\nTG ", b, ",00\nDD ", b, ",00\n"),
        say("ACME INVOICE No: E-", text(k), "\nHS Code: ", h, "\nTotal EUR ", a, ".00\n"),
        say("ACME PROFORMA INVOICE\nProforma No: P-", text(k), "\nHS Code: ", g, "\nTotal USD ", a, ".00\n"),
        say("DELIVERY NOTE No: N-", text(k), "\n", g, " shoe\n", h, " bag\n", h, " bag\n"),
        say("COMMERCIAL INVOICE\nInvoice No: C-", text(k), "\nWaybill No: 80", w, "\n1B:4202. 1.000 kg FRANCE 21.", text(k % 90 + 10), "\nTotal Invoice Amount ", a, ".00 GBP\n"),
    ]
    n, whole, kind = k % len(texts), F, F
    for i, (t, f) in enumerate(zip(texts, _FORMATS, strict=True)):
        whole, kind = whole.when(n == i, t), kind.when(n == i, F.lit(f))
    cut = spark.read.parquet(f"{d}/orders.parquet").select(text(k).alias("path"), k.alias("seg_no"), kind.alias("doc_type"), whole.alias("text"))
    docs = extract.documents(cut)
    other = F.when(F.col("doc_type") == _FORMATS[0], F.size("hs_codes") - 1)
    return docs.select(F.col("seg_no").alias("id"), "doc_type", "mrn", "number", "currency", "total", "hs_code", other.alias("n_other"), "dd", "at", "tva", "tg", "net_weight_kg", "awb")


_VARIANTS = """SELECT o_custkey AS page, o_orderkey AS reading, (o_orderkey % 7)::INT AS score, [
  'Page ' || o_custkey,
  CASE o_orderkey % 5 WHEN 0 THEN 'bag 4202.22.' || (o_orderkey % 90 + 10) || ' blue' WHEN 1 THEN '  Amount ' || (o_orderkey % 900 + 100) || ',50 EUR ' WHEN 2 THEN 'buyer FR12 ' || (123456000 + o_orderkey % 999) ELSE 'no signal ' || o_orderkey % 3 END,
  CASE o_orderkey % 4 WHEN 0 THEN 'BAG 4202 22 ' || (o_orderkey % 90 + 10) || ', blue!' WHEN 1 THEN 'TOTAL ' || o_orderkey % 50 WHEN 2 THEN '1,5' ELSE 'fax 199$ 10019' END] AS lines FROM orders"""


@query(f"""WITH v AS ({_VARIANTS}), b AS (SELECT page, arg_min(reading, (-score, reading)) AS reading FROM v GROUP BY page),
l AS (SELECT page, reading, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM v),
k AS (SELECT *, regexp_replace(upper(line), '[^A-Z0-9]', '', 'g') AS key, regexp_matches(line, '4202[. ]22|FR12') AS code, contains(line, 'FR12') AS vat, contains(line, ',50 EUR') OR contains(line, '4202.22') AS sure, regexp_matches(line, 'EUR|TOTAL|[$]') AS money FROM l),
h AS (SELECT b.page, b.reading, string_agg(line, chr(10) ORDER BY n) AS text, bool_or(code) AS code, bool_or(vat) AS vat, bool_or(money) AS money FROM b JOIN k USING (page, reading) GROUP BY b.page, b.reading),
x AS (SELECT k.page, k.key, min((k.reading, k.n, trim(k.line))) AS first FROM k JOIN h ON h.page = k.page AND h.reading <> k.reading
  WHERE (k.code AND NOT h.code OR k.vat AND NOT h.vat OR k.sure AND NOT h.money) AND length(k.key) >= 6 AND NOT EXISTS (SELECT 1 FROM k AS o WHERE o.page = h.page AND o.reading = h.reading AND o.key = k.key) GROUP BY k.page, k.key),
e AS (SELECT page, string_agg(first[3], chr(10) ORDER BY first) AS added, count(*) AS n FROM x GROUP BY page)
SELECT h.page, h.reading, h.text || coalesce(chr(10) || '{variants.ADDED}' || chr(10) || added, '') AS text, coalesce(n, 0)::INT AS n_added FROM h LEFT JOIN e USING (page)""")
def merged_readings(spark, d: str) -> DataFrame:
    """Readings of a page a customer, one an order: the best, and the lines of kinds that it lacks."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    say = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v for v in x))
    two = (k % 90 + 10).cast("string")
    a = F.when(k % 5 == 0, say("bag 4202.22.", two, " blue")).when(k % 5 == 1, say("  Amount ", (k % 900 + 100).cast("string"), ",50 EUR ")).when(k % 5 == 2, say("buyer FR12 ", (k % 999 + 123456000).cast("string"))).otherwise(say("no signal ", (k % 3).cast("string")))
    b = F.when(k % 4 == 0, say("BAG 4202 22 ", two, ", blue!")).when(k % 4 == 1, say("TOTAL ", (k % 50).cast("string"))).when(k % 4 == 2, "1,5").otherwise("fax 199$ 10019")
    readings = spark.read.parquet(f"{d}/orders.parquet").select(c.alias("page"), k.alias("reading"), (k % 7).cast("int").alias("score"), F.concat_ws("\n", say("Page ", c.cast("string")), a, b).alias("text"))
    return variants.merge_readings(readings, "page", "reading", "score", "text")


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderkey % 10 AS k, (o_orderkey % 900 + 100)::DOUBLE AS a, (70000000 + o_orderkey % 9999999)::VARCHAR AS w, '42022' || (o_orderkey % 10) || (1000 + o_orderkey % 9000) AS h, '640399' || (1000 + o_orderkey % 9000) AS g FROM orders)
SELECT id, CASE k WHEN 0 THEN w WHEN 1 THEN '99' || w WHEN 2 THEN '12345678' WHEN 9 THEN NULL END AS awb, CASE k WHEN 0 THEN 'text' WHEN 1 THEN 'name' WHEN 2 THEN 'read' END AS awb_source,
  CASE WHEN k = 0 THEN h WHEN k IN (1, 9) THEN '' WHEN k = 2 THEN g WHEN k = 3 THEN substr(h, 1, 8) WHEN k = 4 THEN g WHEN k = 5 THEN h WHEN k = 6 THEN '' WHEN k = 7 THEN g ELSE '' END AS codes,
  CASE k WHEN 0 THEN 'text' WHEN 2 THEN 'read' WHEN 3 THEN 'text' WHEN 4 THEN 'read' WHEN 5 THEN 'text' WHEN 7 THEN 'read' END AS hs_source,
  CASE k WHEN 0 THEN a WHEN 1 THEN 9.0::DOUBLE WHEN 2 THEN a WHEN 3 THEN a * 11 WHEN 4 THEN a WHEN 5 THEN 2 * a WHEN 7 THEN 3.0::DOUBLE END AS total, CASE k WHEN 0 THEN 'text' WHEN 1 THEN 'read' WHEN 2 THEN 'read' WHEN 3 THEN 'text' WHEN 4 THEN 'text' WHEN 5 THEN 'text' WHEN 7 THEN 'read' END AS total_source,
  CASE k WHEN 0 THEN 'EUR' WHEN 2 THEN 'USD' WHEN 3 THEN 'GBP' WHEN 4 THEN 'USD' WHEN 5 THEN 'CHF' WHEN 7 THEN 'EUR' END AS currency, CASE k WHEN 0 THEN 'text' WHEN 2 THEN 'read' WHEN 3 THEN 'text' WHEN 4 THEN 'text' WHEN 5 THEN 'text' WHEN 7 THEN 'read' END AS currency_source,
  k = 5 AS estimated, CASE k WHEN 6 THEN 'delivery note' WHEN 7 THEN 'pre-alert' WHEN 8 THEN 'repair table' END AS not_goods FROM o""")
def enriched_invoices(spark, d: str) -> DataFrame:
    """Invoices an order whose fields were read in part: filled from labels, the file's name, split codes, totals far off, line sums; papers that are no invoices."""
    k = F.col("o_orderkey")
    n, a = k % 10, (k % 900 + 100).cast("string")
    w, four = (k % 9999999 + 70000000).cast("string"), (k % 9000 + 1000).cast("string")
    h, g = F.concat(F.lit("42022"), (k % 10).cast("string"), four), F.concat(F.lit("640399"), four)
    say = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v for v in x))
    texts = [
        say("Invoice\nTracking no: ", w, "\nHS Code ", h, "\nTotal EUR ", a),
        say("Invoice of nothing"),
        say("Invoice AWB 87654321 HS Code ", h, "\nTotal EUR ", a, ".00"),
        say("IB:", F.substring(h, 1, 4), ". 1.000 kg FRANCE ", F.substring(h, 5, 2), ".", F.substring(h, 7, 2), "\nTOTAL INCL ", ((k % 900 + 100) * 11).cast("string"), " GBP"),
        say("Invoice Italy 1234567\nTotal USD ", a),
        say("Lines\n", h, " bag ", a, ".00 CHF\n", h, " bag ", a, ".00 CHF"),
        say("Delivery note of the bag"),
        say("Pre alerte importation, see commercial invoice, AWB ", w, " Total EUR ", a),
        say("Request ID, client case, SKU number ", h),
    ]
    text = F
    for i, t in enumerate(texts):
        text = text.when(n == i, t)
    none = F.lit(None)
    rows = spark.read.parquet(f"{d}/orders.parquet").select(
        k.alias("id"),
        text.otherwise(none.cast("string")).alias("text"),
        F.when(n == 1, say("in/99", w, "_INV_1.pdf")).otherwise("in/file.pdf").alias("path"),
        F.when(n == 4, F.lit("A-1234567")).alias("number"),
        F.when(n == 2, "12345678").alias("awb"),
        F.when(n.isin(2, 4, 7), F.array(g)).when(n == 3, F.array(F.lit("9999999999"))).otherwise(F.array().cast("array<string>")).alias("hs_codes"),
        F.when(n.isin(2, 4), "USD").when(n == 7, "EUR").when(n == 3, "EUR").alias("currency"),
        F.when(n == 1, 9.0).when(n == 2, a.cast("double")).when(n == 3, a.cast("double")).when(n == 4, 4.5).when(n == 7, 3.0).alias("total"),
    )
    out = enrich.enrich(rows, enrich.Limits(prefixes=("9999",)))
    return out.select("id", "awb", "awb_source", F.array_join("hs_codes", ",").alias("codes"), "hs_source", "total", "total_source", "currency", "currency_source", "estimated", "not_goods")


_LIQUIDATED = "(l_partkey * 7 % 90000 + 1)"


@query(f"""WITH l AS (SELECT l_orderkey, l_linenumber % 4 AS k, {_LIQUIDATED} AS a, l_suppkey % 500 + 9 AS b FROM lineitem)
SELECT l_orderkey AS id, round(sum(a / 100::DOUBLE) FILTER (k <> 3), 2) AS dd, round(sum(b::DOUBLE) FILTER (k = 1), 2) AS at, round(sum(CASE k WHEN 0 THEN b WHEN 2 THEN b + 0.5::DOUBLE END), 2) AS tva FROM l GROUP BY l_orderkey""")
def article_duties(spark, d: str) -> DataFrame:
    """Duties of a declaration an order, an article a line: tables of codes and amounts that are paired by place, with an amount too few, one too many, or none."""
    money = lambda n: F.concat(F.floor(n / 100).cast("string"), F.lit(","), F.lpad((n % 100).cast("string"), 2, "0"))
    n, a, b = F.col("l_linenumber") % 4, F.col("l_partkey") * 7 % 90000 + 1, (F.col("l_suppkey") % 500 + 9).cast("string")
    head = F.concat(F.lit("ARTICLE "), F.col("l_linenumber").cast("string"), F.lit("\nLIQUIDATION\nNature\n"))
    table = (
        F.when(n == 0, F.concat(F.lit("U165-FR\nA445\nMontant\n"), money(a), F.lit("\n"), b, F.lit("\n77.10\n")))
        .when(n == 1, F.concat(F.lit("U165\nM195\nA445\nMontant\n"), money(a), F.lit("\n"), b, F.lit("\nStatut\n")))
        .when(n == 2, F.concat(F.lit("U165\nB00 TVA\nA445-1A\nBase\n5\nMontant\n"), money(a), F.lit("\n\n "), b, F.lit(".50\n")))
        .otherwise(F.lit("U165\nMontant\nnone\n"))
    )
    end = F.when(n == 1, "Page 1 of 3\n").when(n == 2, "MENTION SPECIALES\n").otherwise("DONNEE COMPLEMENTAIRE\n")
    article = F.struct("l_linenumber", F.concat(head, table, end).alias("t"))
    texts = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(article)), lambda x: x["t"]), "").alias("text"))
    return texts.select(F.col("l_orderkey").alias("id"), duties.article_duties(F.col("text")).alias("d")).select("id", "d.*")


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderkey % 5 AS k, (o_orderkey * 11 % 70000 + 9)::DOUBLE AS a, (o_custkey % 900 + 9)::DOUBLE AS b FROM orders)
SELECT id, CASE WHEN k IN (1, 3) THEN b END AS dd, CASE k WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN b + 0.25::DOUBLE END AS at, CASE WHEN k < 3 THEN a END AS tva, CASE WHEN k < 2 THEN a + b END AS tg FROM o""")
def total_duties(spark, d: str) -> DataFrame:
    """Duties of the table of totals that a declaration an order prints cell by cell: names, states and numbers that are no duties stand between."""
    k, a, b = F.col("o_orderkey") % 5, (F.col("o_orderkey") * 11 % 70000 + 9).cast("string"), (F.col("o_custkey") % 900 + 9).cast("string")
    total = (F.col("o_orderkey") * 11 % 70000 + 9 + F.col("o_custkey") % 900 + 9).cast("string")
    say = lambda *x: F.concat(F.lit("Page 1\nLIQUIDATION TOTALE\nT.Nat\nMontant\nStatut\n"), *(F.lit(v) if isinstance(v, str) else v for v in x))
    texts = [
        say("A445\nB00 - TVA\n", a, ".00\n6\nM830\nNAT - AUTRES\n5.00\n1\nTotal\n", total, "\nGARANTIE 12.00"),
        say("A445\nB00\n6\n", a, "\nM195\n", b, ".25\nM830\n", a, "\nU165\nA00\n", b, "\n1\nTotal\nEUR\nTotal\n", total, "\n"),
        say("A445\n", a, "\nU165\nA00\n6\n1\n", b, "\nMontant total facturé 99.00"),
        say("U165\nA00\n", b, "\nMontant total à payer\nA445\n", a),
        F.lit("LIQUIDATION\nA445\n17.00\n"),
    ]
    text = F
    for i, t in enumerate(texts[:-1]):
        text = text.when(k == i, t)
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), duties.total_duties(text.otherwise(texts[-1])).alias("d")).select("id", "d.*")


@query(f"""SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'GBP' WHEN 1 THEN 'EUR' WHEN 2 THEN 'CHF' WHEN 3 THEN 'USD' END AS currency,
CASE o_orderkey % 5 WHEN 0 THEN ({_WHOLE} || '.' || {_CENTS})::DOUBLE WHEN 1 THEN (o_orderkey % 900 + 101)::DOUBLE + (o_orderkey * 37 % 100) / 100 WHEN 2 THEN ('1' || {_WHOLE} || '.' || {_CENTS})::DOUBLE WHEN 3 THEN round(2 * ({_WHOLE} || '.' || {_CENTS})::DOUBLE, 2) END AS total,
o_orderkey % 5 = 3 AS estimated FROM orders""".replace("(o_orderkey % 900 + 101)::DOUBLE + (o_orderkey * 37 % 100) / 100", f"((o_orderkey % 900 + 101)::VARCHAR || '.' || {_CENTS})::DOUBLE"))
def invoice_total(spark, d: str) -> DataFrame:
    """Totals of an invoice text an order: a footer, the last of two labelled amounts, a misread currency, the sum of lines where the label has a fragment, nothing."""
    k = F.col("o_orderkey")
    cents = F.lpad((k * 37 % 100).cast("string"), 2, "0")
    whole, next_ = (F.concat((k % 900 + n).cast("string"), F.lit("."), cents) for n in (100, 101))
    footer = F.concat(F.lit("Total 1.00 EUR\nInvoice Total\n"), whole, F.lit(" GBP"))
    last = F.concat(F.lit("Sub total EUR "), whole, F.lit("\nValue EUR "), next_)
    misread = F.concat(F.lit("TOTAL INCL. 1,"), whole, F.lit(" CHE"))
    lines = F.concat(F.lit("4202220000 bag "), whole, F.lit(" USD\n4202220001 bag "), whole, F.lit(" USD\nTOTAL USD 3.00"))
    text = F.when(k % 5 == 0, footer).when(k % 5 == 1, last).when(k % 5 == 2, misread).when(k % 5 == 3, lines).otherwise("no amount")
    c = F.col("c")
    return spark.read.parquet(f"{d}/orders.parquet").select(k.alias("id"), totals.choice(text).alias("c")).select("id", c["picked"]["currency"].alias("currency"), c["picked"]["total"].alias("total"), c["estimated"].alias("estimated"))


@query("""WITH a AS (SELECT date_trunc('hour', ts) AS start, 'D' || user_id % 40 AS dossier, CASE event_id % 3 WHEN 0 THEN 'invoice' WHEN 1 THEN 'declaration' ELSE 'prestation' END AS kind FROM events)
SELECT start, dossier, count_if(kind = 'invoice')::BIGINT AS invoices, count_if(kind = 'declaration')::BIGINT AS declarations, count_if(kind = 'invoice') > 0 AND count_if(kind = 'declaration') > 0 AS complete FROM a GROUP BY start, dossier""")
def dossier_completeness(spark, d: str) -> DataFrame:
    """Documents of a dossier that arrive within an hour, over the table of events; the same plan runs on a stream."""
    k = F.col("event_id") % 3
    kind = F.when(k == 0, "invoice").when(k == 1, "declaration").otherwise("prestation")
    arrivals = spark.read.parquet(f"{d}/events.parquet").select("ts", F.concat(F.lit("D"), F.col("user_id") % 40).alias("dossier"), kind.alias("kind"))
    return ingest.completeness(arrivals)


@query("""WITH v AS (SELECT o_custkey AS id, o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN lower(o_orderpriority) || '.' WHEN 1 THEN ' ' || o_orderpriority ELSE o_orderpriority || ' ;' END AS v FROM orders),
c AS (SELECT id, k, regexp_replace(trim(v), '[ ,;:.]+$', '') AS v FROM v), f AS (SELECT id, upper(v) AS u, min(k) AS k, arg_min(v, k) AS v FROM c GROUP BY id, upper(v))
SELECT id, string_agg(v, '|' ORDER BY k) AS vals FROM f GROUP BY id""")
def ordered_values(spark, d: str) -> DataFrame:
    """The priorities of a customer's orders as they first come, whatever their case and the signs that end them."""
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    value = F.when(k % 3 == 0, F.concat(F.lower(p), F.lit("."))).when(k % 3 == 1, F.concat(F.lit(" "), p)).otherwise(F.concat(p, F.lit(" ;")))
    lists = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_custkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", value.alias("v")))).alias("a"))
    return lists.select("id", F.array_join(C.ordered_distinct(F.transform("a", lambda x: x["v"])), "|").alias("vals"))


_LAYERS = """SELECT CASE WHEN s_suppkey % 9 > 1 THEN 'C' || s_nationkey END AS client, 'fx' AS kind, ['EUR', 'USD', 'GBP', 'CHF', 'JPY'][s_suppkey % 5 + 1] AS key, (s_suppkey % 4)::INT AS layer, CASE WHEN s_suppkey % 11 > 0 THEN (s_suppkey % 13)::VARCHAR END AS value FROM supplier"""


@query(f"""WITH l AS ({_LAYERS}), f AS (SELECT client, key, arg_max(coalesce(value, '-'), (layer, value IS NOT NULL, coalesce(value, ''))) AS value FROM l GROUP BY client, key),
o AS (SELECT o_orderkey AS id, 'C' || o_custkey % 30 AS client, ['EUR', 'USD', 'GBP', 'CHF', 'JPY', 'AED'][o_orderkey % 6 + 1] AS currency FROM orders)
SELECT o.id, o.client, o.currency, nullif(CASE WHEN f.client IS NOT NULL THEN f.value ELSE g.value END, '-') AS rate FROM o LEFT JOIN f ON f.client = o.client AND f.key = o.currency LEFT JOIN f AS g ON g.client IS NULL AND g.key = o.currency""")
def layered_rates(spark, d: str) -> DataFrame:
    """The rate of an invoice's currency by its client's settings in layers, else by those of all; a layer may take a rate away."""
    n = F.col("s_suppkey")
    currency = lambda k, names: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    names = ["EUR", "USD", "GBP", "CHF", "JPY"]
    layers = spark.read.parquet(f"{d}/supplier.parquet").select(F.when(n % 9 > 1, F.concat(F.lit("C"), "s_nationkey")).alias("client"), F.lit("fx").alias("kind"), currency(n % 5, names).alias("key"), (n % 4).cast("int").alias("layer"), F.when(n % 11 > 0, (n % 13).cast("string")).alias("value"))
    k = F.col("o_orderkey")
    rows = spark.read.parquet(f"{d}/orders.parquet").select(k.alias("id"), F.concat(F.lit("C"), F.col("o_custkey") % 30).alias("client"), currency(k % 6, [*names, "AED"]).alias("currency"))
    return settings.looked_up(rows, layers, "fx", "currency", "rate")
