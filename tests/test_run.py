"""Fields, identity, repair and a whole run over a folder of workbooks."""

import json

from pyspark.sql import functions as F

from docrecon import __main__ as cli
from docrecon.operators import extract, identity, links, repair
from docrecon.plans import run
from docrecon.sinks import report
from docrecon.sources.files import sheets

H7 = "Delta H7 MRN 25FR00012345678901\n22 Monnaie et montant total facture\nEUR\n1 234,50\nBox\n33 Code des marchandises\n4202220000\n34 Code P. origine CN\n35 Masse brute (kg)\n12,5\nN380: INV-77, N740: 1234567890\nFR7, FR12345678901\nDD 12,00\nTG 260,00"
DHL = "DHL Express\nNumero de Facture: PARIR0001\nDate de Facture: 05-03-2025\nDroits de Douane 136,00 Z\nAutres Taxes\n4,00\n1234567890 25FR00012345678901 04/03/2025"
PROFILE = identity.Profile([("FR12345678901", "345678901"), ("FR99888777666", "888777666")], [("ACME", "FR12345678901")], [("RUE X", "FR99888777666")])


def _segments(spark, *rows):
    return spark.createDataFrame([(f"p{i}", 1, t, x) for i, (t, x) in enumerate(rows)], "path string, seg_no int, doc_type string, text string")


def test_fields(spark):
    s = _segments(spark, ("declaration_h7", H7), ("prestation_dhl", DHL), ("invoice_generic", "Invoice No: A-77\nHS 4202220000\nEUR 12.50\n"), ("invoice_generic", None), ("cgv", "x"))
    rows = {r["path"]: r for r in extract.documents(s).collect()}
    assert len(rows) == 4
    h = rows["p0"]
    assert (h["mrn"], h["currency"], h["total"], h["hs_code"], h["origin_country"], h["gross_weight_kg"], h["vat"], h["refs"], h["awb"], h["dd"], h["tg"]) == ("25FR00012345678901", "EUR", 1234.5, "4202220000", "CN", 12.5, "FR12345678901", ["INV-77"], "1234567890", 12.0, 260.0)
    p = rows["p1"]
    assert (p["number"], p["date"], p["dd"], p["at"], p["tva"], p["disbursement"], p["mrns"], p["awbs"]) == ("PARIR0001", "2025-03-05", 136.0, 4.0, None, 140.0, ["25FR00012345678901"], ["1234567890"])
    assert (rows["p2"]["number"], rows["p2"]["hs_code"], rows["p2"]["currency"], rows["p2"]["total"]) == ("A-77", "4202220000", "EUR", 12.5)
    assert rows["p3"]["total"] is None and rows["p3"]["number"] is None


def test_generic_total(spark):
    texts = ["EUR 5.00\nUSD 7.00", "TOTAL due 9.50", "pay 1 200,50 GBP now", "price € 3.25", "nothing"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", extract.generic_total(F.col("t")).alias("m"))
    got = {r["i"]: r["m"] and tuple(r["m"]) for r in df.collect()}
    assert got == {0: ("EUR", 5.0), 1: (None, 9.5), 2: ("GBP", 1200.5), 3: ("EUR", 3.25), 4: None}


def test_buyer(spark):
    cases = [("SIREN 345 678 901", None, ("FR12345678901", "identity")), ("Bill to ACME", "FR00000000000", ("FR12345678901", "identity")), ("rue x", None, ("FR99888777666", "identity")), ("ACME", "fr99888777666", ("FR99888777666", "read")), ("a FR11111111111 b FR22222222222", None, ("FR22222222222", "text")), ("FR 11 111 111 111", None, ("FR11111111111", "spaced")), ("", None, None), (None, None, None), ("Ship to RUE X, Bill to ACME", None, ("FR12345678901", "identity"))]
    df = spark.createDataFrame([(i, t, v) for i, (t, v, _) in enumerate(cases)], "i int, t string, v string")
    got = {r["i"]: r["b"] and tuple(r["b"]) for r in df.select("i", identity.buyer_vat(F.col("t"), F.col("v"), PROFILE).alias("b")).collect()}
    assert got == {i: w for i, (_, _, w) in enumerate(cases)}


def test_repair(spark):
    rows = [(0, "total 120.00 EUR", [], None, None, 120.0, "EUR"), (1, "lines EUR", [50.0, 70.0, 3.0], 50.0, "EUR", 120.0, "EUR"), (2, "none", [], None, None, 120.0, "EUR"), (3, None, None, 1.0, "EUR", 120.0, "EUR"), (4, "120.00 EUR", [], 120.5, "EUR", 120.0, "EUR")]
    df = spark.createDataFrame(rows, "i int, t string, a array<double>, it double, ic string, dt double, dc string")
    none = F.lit(None)
    t = repair.total(*map(F.col, ("t", "a", "it", "ic", "dt", "dc")), none.cast("double"), none.cast("string"))
    assert {r["i"]: tuple(r["x"]) for r in df.select("i", t.alias("x")).collect()} == {0: (120.0, "EUR", True), 1: (120.0, "EUR", True), 2: (None, None, False), 3: (1.0, "EUR", False), 4: (120.5, "EUR", False)}
    one = spark.sql("select 'HS code: 6403.99 and 4202 22 00' as t, array('950300') as own, array('4202220000','640399','640391','4202229999','9503001000') as d")
    assert one.select(repair.tariff_codes(F.col("t"), F.col("own"), F.col("d"))).first()[0] == ["950300", "4202220000", "640399"]


def test_workbook_names_and_run(spark, tmp_path, capsys):
    taken: set = set()
    assert [report.tab_name(n, taken) for n in ("a/b", "a_b", "x" * 40, "x" * 40)] == ["a_b", "a_b_2", "x" * 31, "x" * 29 + "_2"]
    root = tmp_path / "in"
    for name, text in {"D1/decl.xlsx": H7, "D1/inv.xlsx": "Invoice No INV-77 HS code 4202220000\nCommercial goods\nEUR 1234.50", "D2/inv.xlsx": "Invoice No INV-78 HS code 4202220000\nEUR 9.00"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        report.workbook({"s": spark.createDataFrame([(x,) for x in text.split("\n")], "line string")}, str(root / name))
    assert list(sheets((root / "D2/inv.xlsx").read_bytes())) == ["[SHEET:s]\nline\nInvoice No INV-78 HS code 4202220000\nEUR 9.00"]
    (root / "D2/broken.xlsx").write_bytes(b"x")
    out, book = str(tmp_path / "out"), str(tmp_path / "r.xlsx")
    assert cli.main([str(root), "--out", out, "--workbook", book]) == 1
    total = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert (total["read_errors"], total["bundles"], total["anomalies"]) == (1, 2, 1)
    got = {r["pool"]: r["status"] for r in spark.read.parquet(f"{out}/bundles").collect()}
    assert got == {"D1": "OK", "D2": "MANQUE_DOC"}
    assert len(list(sheets(open(book, "rb").read()))) == 4
    assert cli.main([str(root), "--out", out, "--exit-zero"]) == 0


def test_choice_and_forwarder_scores(spark):
    """Ties go to the first, a choice is made even without points, empty keys match nothing, a foreign dossier rules out."""
    linked = spark.createDataFrame([("b", i, d, d) for i in "xyz" for d in (1, 2)], "bundle_id string, invoice_id string, declaration_id int, ord int")
    i = spark.createDataFrame([("x", None, "INV1", "W1", 10.0), ("y", "", "", "", None), ("z", "f", "Q", None, 50.0)], "invoice_id string, folder string, ref string, awb string, total double")
    d = spark.createDataFrame([(1, "", ["INV1"], [""], 50.0), (2, "f", ["B"], ["W1"], 10.0)], "declaration_id int, folder string, refs array<string>, awbs array<string>, total double")
    pick = lambda points: {r["invoice_id"]: (r["declaration_id"], r["score"]) for r in links.best_declaration(linked, i, d, points).collect()}
    assert pick(links.FOR_RULES) == {"x": (2, 100), "y": (1, 0), "z": (2, 100)}
    assert pick(links.FOR_REPAIR) == {"x": (1, 60), "y": (1, 0), "z": (2, 100)}
    b = spark.createDataFrame([("p", 1, ["D"], ["M"], ["", "W"], ["s"], 9.0), ("p", 2, [], [], [""], [], 0.0)], "pool string, bundle_id int, dossiers array<string>, mrns array<string>, awbs array<string>, sources array<string>, duties double")
    p = spark.createDataFrame([("p", 1, 1, "D", ["M"], ["W"], "s", 10.0), ("p", 2, 2, "E", ["M"], ["W"], "s", 9.0), ("p", 3, 3, None, [""], [""], None, 0.0)], "pool string, prestation_id int, ord int, dossier string, mrns array<string>, awbs array<string>, source string, paid double")
    got = {(r["bundle_id"], r["prestation_id"]): r["score"] for r in links.prestation_bundle_score(b, p).collect()}
    assert got == {(1, 1): 320, (1, 2): 0, (1, 3): 0, (2, 1): 0, (2, 2): 0, (2, 3): 0}


def test_reconcile_with_forwarder(spark, tmp_path):
    """Duties paid against declared, two declarations an invoice, and documents that nothing takes."""
    cut = spark.createDataFrame([(f"/in/{p}", 1, t, x) for p, t, x in [
        ("D1/decl.xlsx", "declaration_h7", H7), ("D1/inv.xlsx", "invoice_generic", "Invoice No: INV-77\nHS code 4202220000\nEUR 1234.50"), ("D1/dhl.xlsx", "prestation_dhl", DHL), ("D3/decl.xlsx", "declaration_h7", H7), ("D4/dhl.xlsx", "prestation_dhl", DHL),
    ]], "path string, seg_no int, doc_type string, text string")
    docs = extract.documents(cut).withColumns({"id": F.concat_ws("#", "path", "seg_no"), "dossier": F.split("path", "/")[2], "folder": F.lit(None).cast("string")})
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    rows = {(r["pool"], r["invoice_id"] is None): r for r in run.reconcile(docs, {}).collect()}
    assert {k: r["status"] for k, r in rows.items()} == {("D1", False): "KO_BLOQUANT", ("D3", True): "MANQUE_DOC", ("D4", True): "MANQUE_DOC"}
    one = rows["D1", False]
    assert (one["declaration_id"], one["prestation_id"], one["n_declarations"]) == ("/in/D1/decl.xlsx#1", "/in/D1/dhl.xlsx#1", 1)
    assert {c["code"]: c["status"] for c in one["checks"]}["duties_match"] == "NOK"
