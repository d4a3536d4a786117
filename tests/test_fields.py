"""Spans between matches, tariff codes step by step and duty tables, each on texts of our own."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docrecon.functions import spans
from docrecon.operators import duties, tariff


def one(spark, text, build):
    """What a Column built from a text gives."""
    return spark.createDataFrame([(text,)], "t string").select(build(F.col("t")).alias("x")).first()["x"]


def each(spark, texts, build):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", build(F.col("t")).alias("x"))
    return [r["x"] for r in rows.orderBy("i").collect()]


def test_pieces_put_a_text_together(spark):
    rng = random.Random(4)
    texts = ["", "12", "a12", "12a", "1 2 3", *("".join(rng.choice("12 ab.\n") for _ in range(rng.randrange(30))) for _ in range(40))]
    for text, got in zip(texts, each(spark, texts, lambda t: spans.pieces(t, r"\d+")), strict=True):
        assert [p["match"] for p in got] == re.findall(r"\d+", text)
        if got:
            assert "".join(p["before"] + p["match"] for p in got) + got[-1]["after"] == text
            assert [p["after"] for p in got[:-1]] == [p["before"] for p in got[1:]]
    assert one(spark, None, lambda t: spans.pieces(t, r"\d+")) is None


def test_blocks_and_enclosed(spark):
    got = one(spark, "A:onetwoA:three;fourA:", lambda t: spans.blocks(t, "A:", 4, ";"))
    assert [(b["match"], b["block"]) for b in got] == [("A:", "onet"), ("A:", "thre"), ("A:", "")]
    texts = ["HEAD far away END", "HEAD " + "x" * 20 + "HEAD in END", "no head END", "HEAD no end", None]
    assert each(spark, texts, lambda t: spans.enclosed(t, "HEAD", "END", 10)) == [" far away ", " in ", None, None, None]


def test_paired_by_place(spark):
    build = lambda t: spans.paired(F.split(t, " "), F.array(F.lit("x"), F.lit("y"), F.lit("z")))
    assert [tuple(p) for p in one(spark, "a b", build)] == [("a", "x"), ("b", "y")]
    assert [tuple(p) for p in one(spark, "a b c d", build)] == [("a", "x"), ("b", "y"), ("c", "z")]


CODES = [
    ("Unit value EUR\n2 4202220000\nFrance 6403990000", "4202220000,6403990000"),
    ("Unit value EUR\n2 4202220000 4202220001 4202220002", ""),  # too many for a table of one invoice's values
    ("Unit value\n2 4202220000", ""),  # no currency
    ("HS Code 6403990000 Unit value EUR\n2 4202220000", "6403990000"),  # the table is for texts without other codes
    ("1B:4202. 1.000 kg FRANCE 21.00", "42022100"),
    ("1B:4202. 1.000 kg 21.00", ""),  # no country in the block
    ("IB:4202 black ITALY 21.009 IB:6403. shoe FR 99.90 Total Goods Value 11.11", "4202210090,64039990"),
    ("1B:4202. FRANCE 21.00" + " x" * 200 + " 22.00", "42022100"),  # beyond the block's reach
    ("1B:4202210000 bag", "4202210000"),
    ("CITES Customs paper No 4202220000", "4202220000"),
    ("CITES Customs " + "x" * 150 + " No 4202220000", ""),
    ("Customs Number code of the bag\nNo 42022200", "42022200"),
    ("Customs Code\n4202 21 00 bag\n6403990000\n4202 2200\nNumber of parcels", "42022100,6403990000,42022200"),
    ("HS Code: 4202.22.00", "42022200"),
    ("H.S. Code 4202 2200", "42022200"),
    ("MATRICULE 4202.22.00.10", "4202220010"),
    ("4202 21 0064 x", "4202210064"),
    ("4202220000 Italy | Italy | 4202220001", "4202220001,4202220000"),
    ("order 123456 for France 12345", ""),
    ("Tel. 4202220000", ""),
    ("VAT 4202220000 bag France 4202220000", ""),
    ("France 100900", ""),
    ("Brooch in a box", "7117190090"),
    ("Brooch, HS Code: 4202.22.00", "42022200"),
    ("", ""),
]


def test_tariff_codes(spark):
    got = each(spark, [t for t, _ in CODES], lambda t: F.array_join(tariff.codes(t), ","))
    assert list(zip([t for t, _ in CODES], got, strict=True)) == CODES
    assert one(spark, None, tariff.codes) is None


def test_tariff_codes_within_limits(spark):
    text = "HS Code: 4202.22.00 France 6403990000 Italy 9101110000"
    assert one(spark, text, lambda t: tariff.codes(t, scope=["420222", "910111"])) == ["42022200", "9101110000"]
    assert one(spark, text, lambda t: tariff.codes(t, F.lit("6403990000"))) == ["42022200", "9101110000"]
    assert one(spark, text, lambda t: tariff.codes(t, known_ids=["640399"], prefixes=["91"])) == ["42022200"]


def articles(*tables):
    return "".join(f"ARTICLE {i}\nLIQUIDATION\nNature\n{t}DONNEE COMPLEMENTAIRE\n" for i, t in enumerate(tables))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (articles("U165\nA445\nMontant\n10,50\n20\n", "U165-FR\nM195\nMontant\n1,25\n3\n"), (11.75, 3.0, 20.0)),
        (articles("U165\nM195\nA445\nMontant\n10\n20\n"), (10.0, 20.0, None)),  # an amount too few
        (articles("U165\nMontant\n10\n20\n30\n"), (10.0, None, None)),  # too many
        (articles("U165\nMontant\nnone\n"), (None, None, None)),
        (articles("U165\nMontant total\nMontant\n1.2.3\n7\n"), (7.0, None, None)),  # what is no number has no place
        ("LIQUIDATION\nU165\nMontant\n10", (None, None, None)),  # the line is not complete
        ("LIQUIDATION\nU165\nMontant\n10\n", (10.0, None, None)),
        ("no table", (None, None, None)),
        (None, (None, None, None)),
    ],
)
def test_article_duties(spark, text, want):
    assert tuple(one(spark, text, duties.article_duties)) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("LIQUIDATION TOTALE\nA445\nB00 - TVA\n1 667.00\n6\nM830\nNAT\n5.00\n1\nTotal\n896.00\n", (None, 5.0, 1667.0, 896.0)),
        ("LIQUIDATION TOTALE\nU165\n6\n1\n7\n12\n", (None, None, None, None)),  # states only within reach
        ("LIQUIDATION TOTALE\nU165\n6\n12\nU165\n99\n", (12.0, None, None, None)),  # the first one counts
        ("LIQUIDATION TOTALE\nU165\n2000000\n5,5\n", (5.5, None, None, None)),
        ("LIQUIDATION TOTALE\nGARANTIE\nU165\n12\n", (None, None, None, None)),
        ("LIQUIDATION\nU165\n12\n", (None, None, None, None)),
        (None, (None, None, None, None)),
    ],
)
def test_total_duties(spark, text, want):
    assert tuple(one(spark, text, duties.total_duties)) == want


def test_duty_rows_look_ahead(spark):
    text = "page 2\n4202220000 900,00 Droits de Douane 3,50 31,50\n6403990000 100,00 droits de douane 2 2,00\nTVA à l'importation 1.000,00 200,10\nAutres Taxes 5,00 4,00\nTotal EUR: 235,60."
    first, second = one(spark, text, duties.duty_rows)
    assert tuple(first) == ("4202220000", 900.0, 3.5, 31.5, 1000.0, 200.1, 4.0, 235.6)
    assert tuple(second) == ("6403990000", 100.0, 2.0, 2.0, 1000.0, 200.1, 4.0, 235.6)
    far = text.replace("TVA", "x" * duties.ROW_WINDOW + "TVA")
    assert [tuple(r)[4:] for r in one(spark, far, duties.duty_rows)] == [(None,) * 4] * 2
    assert one(spark, "420222000 900,00 Droits de Douane 3,50 31,50", duties.duty_rows) == []
    assert one(spark, None, duties.duty_rows) is None
