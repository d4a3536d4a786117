"""A whole run's rules over dossiers of each status."""

from docrecon.operators import identity
from docrecon.plans import run

A, B = "FR12900000001", "FR34900000002"
PROFILE = identity.Profile([(A, "900000001"), (B, "900000002")])
SCHEMA = """id string, path string, doc_type string, dossier string, folder string, text string, number string, awb string, awbs array<string>, total double, vat string, hs_codes array<string>, hs_code string,
currency string, estimated boolean, refs array<string>, mrns array<string>, mrn string, fx_rate double, dd double, at double, tva double, tg double, disbursement double, amounts array<double>, not_goods string"""
NAMES = [c.split()[0] for c in SCHEMA.replace("\n", " ").split(",")]
BAG, SHOE = "4202220000", "6403990000"


def row(id_, kind, dossier, **fields):
    plain = dict.fromkeys(NAMES) | {"id": id_, "path": f"{dossier}/{id_}.pdf", "doc_type": kind, "dossier": dossier, "text": "", "currency": "EUR", "total": 100.0, "hs_codes": [BAG], "vat": A}
    return tuple((plain | fields)[n] for n in NAMES)


def invoice(dossier, **fields):
    return row(f"i-{dossier}", "invoice_entity", dossier, **({"number": f"INV-{dossier}"} | fields))


def declaration(dossier, **fields):
    return row(f"d-{dossier}", "declaration_h7", dossier, **({"refs": [f"INV-{dossier}"]} | fields))


def test_one_dossier_a_status(spark, tmp_path):
    rows = [
        *(invoice("ok"), declaration("ok")),
        *(invoice("both"), declaration("both", text="importer 900 000 001, declarant 900 000 002")),
        *(invoice("amount"), declaration("amount", total=250.0)),
        *(invoice("code"), declaration("code", hs_codes=[SHOE])),
        *(invoice("entity"), declaration("entity", vat=B)),
        *(invoice("foreign", vat="FR55555555555"), declaration("foreign", vat=None)),
        invoice("alone"),
        *(invoice("paper", not_goods="pre-alert"), declaration("paper")),
        *(invoice("repaired", total=50.0, hs_codes=[BAG], text=f"bag {BAG}, shoe {SHOE}, in all 100.00 EUR"), declaration("repaired", hs_codes=[BAG, SHOE])),
        *(invoice("unproved", total=50.0, text="nothing of a hundred"), declaration("unproved")),
        *(invoice("duties"), declaration("duties", dd=10.0, awbs=["12345678"]), row("p-duties", "prestation_dhl", "duties", awbs=["12345678"], dd=10.2)),
        *(invoice("unpaid"), declaration("unpaid", dd=10.0, awbs=["12345678"]), row("p-unpaid", "prestation_dhl", "unpaid", awbs=["12345678"], dd=99.0)),
    ]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/docs")
    got = {r["pool"]: r for r in run.reconcile(spark.read.parquet(f"{tmp_path}/docs"), {}, PROFILE).collect()}
    bad = lambda r: sorted(c["code"] for c in r["checks"] or [] if c["status"] != "OK")
    want = {
        "ok": ("OK", []),
        "both": ("OK_A_CONTROLER", ["tva_match_decl"]),
        "amount": ("KO_BLOQUANT", ["amount_match"]),
        "code": ("KO_BLOQUANT", ["hs_subset"]),
        "entity": ("KO_BLOQUANT", ["tva_match_decl"]),
        "foreign": ("KO_BLOQUANT", ["tva_scope"]),
        "alone": ("MANQUE_DOC", []),
        "paper": ("MANQUE_DOC", []),
        "repaired": ("OK", []),
        "unproved": ("KO_BLOQUANT", ["amount_match"]),
        "duties": ("OK", []),
        "unpaid": ("KO_BLOQUANT", ["duties_match"]),
    }
    assert {k: (r["status"], bad(r)) for k, r in got.items()} == want
    assert got["paper"]["invoice_id"] is None and got["paper"]["declaration_id"] == "d-paper"
    assert (got["repaired"]["total"], got["repaired"]["repaired"]) == (100.0, "total,codes") and got["ok"]["repaired"] == ""
