"""Enrichment in stages, readings of a page put together, and matches by terms against all pairs of a pool."""

import random

import pytest
from pyspark.sql import functions as F

from docrecon.operators import enrich, links, variants

INVOICE = "id int, text string, path string, number string, awb string, hs_codes array<string>, currency string, total double"


def filled_all(spark, cases, limits=enrich.Limits()):
    """The enriched rows of several invoices, in order, from one frame."""
    plain = {"text": "", "path": "d/f.pdf", "number": None, "awb": None, "hs_codes": None, "currency": None, "total": None}
    rows = [(k, *(plain | c).values()) for k, c in enumerate(cases)]
    return enrich.enrich(spark.createDataFrame(rows, INVOICE), limits).orderBy("id")


def filled(spark, limits=enrich.Limits(), **fields):
    return filled_all(spark, [fields], limits).first()


def test_stages_keep_what_was_read(spark):
    got = filled(spark, text="AWB 11111111 HS Code 4202220000 Total EUR 99.00", awb="22222222", hs_codes=["6403990000"], currency="USD", total=98.0)
    assert (got["awb"], got["hs_codes"], got["currency"], got["total"]) == ("22222222", ["6403990000"], "USD", 98.0)
    assert (got["awb_source"], got["hs_source"], got["currency_source"], got["total_source"]) == ("read",) * 4


def test_stages_fill_what_is_open(spark):
    got = filled(spark, text="Parcel no. 11111111\nHS Code 4202220000\nTotal EUR 99.00")
    assert (got["awb"], got["hs_codes"], got["currency"], got["total"], got["estimated"]) == ("11111111", ["4202220000"], "EUR", 99.0, False)
    got = filled(spark, text="nothing", path="d/1234567890_INV_2.pdf")
    assert (got["awb"], got["awb_source"], got["hs_codes"], got["hs_source"], got["total_source"]) == ("1234567890", "name", [], None, None)


def test_stages_replace_what_cannot_be(spark):
    usd = {"currency": "USD"}
    cases = [{"text": "Total EUR 99.00", "total": 4.0} | usd, {"text": "Total EUR 99.00", "total": 9.0} | usd, {"text": "Total EUR 89.00", "total": 9.0} | usd, {"text": "IB:4202. 1 kg FRANCE 21.00", "hs_codes": ["6403990000"]}]
    tiny, small, fine, split = filled_all(spark, cases).collect()
    assert tiny["total"] == 99.0
    assert (small["total"], small["currency"], small["currency_source"]) == (99.0, "EUR", "text")
    assert (fine["total"], fine["currency"]) == (9.0, "USD")
    assert split["hs_codes"] == ["42022100"]
    limits = enrich.Limits(scope=("420222",), known_ids=("4202229",), prefixes=("64",))
    got = filled(spark, limits, hs_codes=["6403990000", "4202220000", "4202229000", "4202220001", "9999"], number="4202220001")
    assert got["hs_codes"] == ["4202220000"]


PAPERS = [
    ("Commercial invoice", None),
    ("", None),
    (None, None),
    ("Repair shipping list with commercial invoice", "repair list"),
    ("YOUR CDS REFERENCE NUMBER", "other paper"),
    ("your cds reference number, commercial invoice", None),
    ("OP authorisation", "processing"),
    ("Request ID, client case, SKU number", "repair table"),
    ("Request ID, client case, SKU number, value for customs", None),
    ("Delivery note", "delivery note"),
    ("Delivery note of the invoice", None),
    ("Delivery note Total EUR 12.00", None),
]


def test_papers_that_are_no_invoices(spark):
    rows = filled_all(spark, [{"text": t, "awb": "11111111"} for t, _ in PAPERS])
    got = rows.collect()
    assert [r["not_goods"] for r in got] == [w for _, w in PAPERS] and {r["awb"] for r in got} == {"11111111"}
    assert enrich.usable(rows).count() == sum(w is None for _, w in PAPERS)


def merged(spark, readings, sirens=()):
    rows = [("p", i, s, t) for i, (s, t) in enumerate(readings)]
    got = variants.merge_readings(spark.createDataFrame(rows, "page string, i int, s int, text string"), "page", "i", "s", "text", sirens).first()
    return got["i"], got["text"]


def test_readings_are_put_together(spark):
    mark = f"\n{variants.ADDED}\n"
    assert merged(spark, [(1, "a"), (5, "b"), (5, "c")]) == (1, "b")
    # a kind that the best one lacks: each line once, in order, without those it has
    got = merged(spark, [(9, "head\ntotal 5"), (1, "  4202.22.00 bag \nhead\n4202.22.01"), (2, "4202 22 00 BAG\n4202.22.02"), (3, None)])
    assert got == (0, "head\ntotal 5" + mark + "4202.22.00 bag\n4202.22.01\n4202.22.02")
    # a kind that it shows is never added to
    assert merged(spark, [(9, "4202.22.00 5,00 EUR"), (1, "4202.22.01\n6,00 EUR")]) == (0, "4202.22.00 5,00 EUR")
    assert merged(spark, [(9, "4202.22.00 5,00 EUR"), (1, "FR12 123456789\nwe are 987654321 here")], ["987654321"]) == (0, "4202.22.00 5,00 EUR" + mark + "FR12 123456789\nwe are 987654321 here")
    # too short a line, and a bare sign beside digits
    assert merged(spark, [(9, "x"), (1, "1,50 €"), (1, "199$ 10019")]) == (0, "x")
    assert merged(spark, [(None, None)]) == (0, "")


REFS = ["", "A1", "INV1", "INV12345", "V1234", "INV1234567", "X", "1234567", "NV123"]


def sides(spark, rng, n, pools, folders=(None, None, "f", "g")):
    some = lambda values: rng.choice(values)
    amounts = [None, 0.0, 0.4, -3.0, -3.5, 50.0, 50.9, 99.0, 99.9, 100.5, 1000.0, 1009.9, 1010.2, 1080.0, 250_000.0]
    i = [(some(pools), k, some(folders), some(REFS), some([None, "w1", "w2"]), some(amounts), some([None, "v1", "v2"]), rng.sample(["1", "2", "3", "4"], rng.randrange(4)), some(["", "l1", "l2"])) for k in range(n)]
    d = [(some(pools), k, (k * 7) % n, some(folders), rng.sample([*REFS, None], rng.randrange(3)), some([None, [], ["w1"], ["w2", "w2"]]), some(amounts), some([None, "EUR", "USD"]), some([None, 0.0, 1.08, 150.0]), some([None, "v1", "v2"]), rng.sample(["1", "2", "3", "4"], rng.randrange(4)), some(["", "l1", "l2"])) for k in range(n)]
    i = spark.createDataFrame(i, "pool string, invoice_id int, folder string, ref string, awb string, total double, vat string, hs6 array<string>, lead string")
    return i, spark.createDataFrame(d, "pool string, declaration_id int, ord int, folder string, refs array<string>, awbs array<string>, total double, currency string, fx double, vat string, hs6 array<string>, lead string")


def rows_of(frame):
    return sorted(tuple(r) for r in frame.select("pool", "invoice_id", "declaration_id", "ord", "score").collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_terms_give_the_pairs_of_a_pool(spark, seed):
    i, d = sides(spark, random.Random(seed), 60, ["p", "q", ""])
    whole = links.pool_scores(i, d).filter("score > 0").cache()
    assert rows_of(links.shared_terms(i, d)) == rows_of(whole) and whole.count() > 300
    assert rows_of(links.match(i, d)) == rows_of(links.matches(whole))


def test_a_vat_number_alone_gives_the_first_declaration(spark):
    i, d = sides(spark, random.Random(3), 40, ["p"])
    bare = lambda x, *keep: x.withColumns({c: F.lit(None).cast(t) if not t.startswith("array") else F.array().cast(t) for c, t in x.dtypes if c not in keep}).withColumn("lead", F.lit(""))
    i = bare(i, "pool", "invoice_id", "vat", "folder").withColumn("ref", F.lit(""))
    d = bare(d, "pool", "declaration_id", "ord", "vat", "folder")
    whole = links.pool_scores(i, d).filter("score > 0")
    assert rows_of(links.match(i, d)) == rows_of(links.matches(whole)) != []
    assert links.shared_terms(i, d, vat_alone=False).filter("score < 100").count() == 0
