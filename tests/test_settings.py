"""Settings in layers: the highest layer of a key, a client's own before shared ones, keys that a layer takes away."""

import pytest

from docrecon.operators import settings

LAYERS = [
    (None, "fx", "USD", 0, "1.1"),
    (None, "fx", "USD", 2, "1.2"),
    (None, "fx", "GBP", 0, "0.8"),
    ("a", "fx", "USD", 0, "9"),
    ("a", "fx", "GBP", 0, "8"),
    ("a", "fx", "GBP", 1, None),
    ("a", "fx", "JPY", 1, "150"),
    ("a", "fx", "JPY", 1, "151"),
    ("b", "other", "USD", 9, "7"),
    ("a", "hs_scope", "420222", 0, "yes"),
    ("a", "hs_scope", "640399", 0, "yes"),
    ("a", "hs_scope", "640399", 1, None),
]


@pytest.mark.parametrize("most", [settings.BROADCAST_ROWS, 1])
def test_layers(spark, monkeypatch, most):
    monkeypatch.setattr(settings, "BROADCAST_ROWS", most)
    layers = spark.createDataFrame(LAYERS, settings.SCHEMA)
    rows = spark.createDataFrame([("a", "USD"), ("a", "GBP"), ("a", "JPY"), ("a", "CHF"), ("b", "USD"), ("b", "GBP"), (None, "USD"), ("a", None)], "client string, currency string")
    got = {(r["client"], r["currency"]): r["rate"] for r in settings.looked_up(rows, layers, "fx", "currency", "rate").collect()}
    assert got == {("a", "USD"): "9", ("a", "GBP"): None, ("a", "JPY"): "151", ("a", "CHF"): None, ("b", "USD"): "1.2", ("b", "GBP"): "0.8", (None, "USD"): "1.2", ("a", None): None}
    assert settings.looked_up(rows, layers.limit(0), "fx", "currency", "rate").filter("rate is not null").count() == 0


def test_scope(spark):
    layers = spark.createDataFrame(LAYERS, settings.SCHEMA)
    rows = spark.createDataFrame([("a", ["6403990000", "4202220001", "4202220000"]), ("b", ["1"]), ("a", []), ("a", None)], "client string, codes array<string>")
    got = sorted(str((r["client"], r["codes"], r["ours"])) for r in settings.within_scope(rows, layers, "codes", "ours").collect())
    assert got == sorted(map(str, [("a", ["6403990000", "4202220001", "4202220000"], ["4202220001", "4202220000"]), ("b", ["1"], ["1"]), ("a", [], []), ("a", None, [])]))
    shared = layers.unionAll(spark.createDataFrame([(None, "hs_scope", "1", 0, "yes")], settings.SCHEMA))
    assert settings.within_scope(rows, shared, "codes", "ours").filter("client = 'b'").first()["ours"] == ["1"]
