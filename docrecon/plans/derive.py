"""Customs-shaped tables from the star schema: orders are invoices, their lines the declarations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Ids that make one dossier of the pools of bounded size.
DOSSIER = 64


def dossiers(rows: DataFrame) -> DataFrame:
    """Rows with pools of at most DOSSIER ids each, however many rows there are."""
    return rows.withColumn("pool", F.floor(F.col("id") / DOSSIER))


def _one_of(key, values):
    out = F
    for i, v in enumerate(values[:-1]):
        out = out.when(key % len(values) == i, F.lit(v))
    return out.otherwise(F.lit(values[-1]))


def invoices(spark: SparkSession, d: str) -> DataFrame:
    o = _read(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        k.alias("id"),
        (k % 499).alias("pool"),
        F.concat(F.lit("INV-"), k).alias("ref"),
        F.concat(F.lit("FR"), F.lpad(c.cast("string"), 11, "0")).alias("vat"),
        F.when(k % 23 == 0, F.lit(None)).otherwise(F.round("o_totalprice", 2)).alias("total"),
        _one_of(c, ["EUR", "USD", "GBP", "EUR", None]).alias("currency"),
        (k % 4 == 0).alias("estimated"),
        F.col("o_totalprice").alias("base"),
    )


#: The SQL of the same, for the oracles.
INVOICES = """SELECT o_orderkey AS id, o_orderkey % 499 AS pool, 'INV-' || o_orderkey AS ref, 'FR' || lpad(o_custkey::VARCHAR, 11, '0') AS vat,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE round(o_totalprice, 2) END AS total,
  CASE o_custkey % 5 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' WHEN 2 THEN 'GBP' WHEN 3 THEN 'EUR' END AS currency, o_orderkey % 4 = 0 AS estimated, o_totalprice AS base FROM orders"""

FACTORS = [1.0, 1.004, 0.985, 1.3, 0.92, 1.019, 0.8]


def declarations(spark: SparkSession, d: str) -> DataFrame:
    """One for each order with lines; its total is the order's times a factor, its duties come from the lines."""
    money = (F.col("l_extendedprice").cast("decimal(18,4)") * F.col("l_tax").cast("decimal(6,4)"))
    lines = _read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(money).cast("double").alias("duty"), F.count(F.lit(1)).alias("n_lines"), F.sort_array(F.collect_set(F.lpad((F.col("l_partkey") % 500 + 420000).cast("string"), 6, "0"))).alias("hs6"))
    o = invoices(spark, d).select("id", "pool", "vat", "base", F.col("currency").alias("c"))
    k = F.col("id")
    return o.join(lines, k == F.col("l_orderkey")).select(
        k.alias("id"),
        "pool",
        F.concat(F.lit("inv "), k).alias("ref"),
        F.when(k % 11 == 0, F.lit("FR00000000000")).otherwise(F.col("vat")).alias("vat"),
        F.when(k % 29 == 0, F.lit(None)).otherwise(F.round(F.col("base") * _one_of(k, FACTORS), 2)).alias("total"),
        F.when(k % 31 == 0, F.lit(None)).when(k % 3 == 0, "EUR").otherwise(F.col("c")).alias("currency"),
        F.round("duty", 2).alias("duty"),
        "n_lines",
        "hs6",
    )


_FACTOR = "CASE o_orderkey % 7 " + " ".join(f"WHEN {i} THEN {f}::DOUBLE" for i, f in enumerate(FACTORS)) + " END"
DECLARATIONS = f"""SELECT o_orderkey AS id, o_orderkey % 499 AS pool, 'inv ' || o_orderkey AS ref,
  CASE WHEN o_orderkey % 11 = 0 THEN 'FR00000000000' ELSE 'FR' || lpad(o_custkey::VARCHAR, 11, '0') END AS vat,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE round(o_totalprice * {_FACTOR}, 2) END AS total,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'EUR' ELSE CASE o_custkey % 5 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' WHEN 2 THEN 'GBP' WHEN 3 THEN 'EUR' END END AS currency,
  round(duty, 2) AS duty, n_lines, hs6
  FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18,4) * l_tax::DECIMAL(6,4))::DOUBLE AS duty, count(*) AS n_lines, list_sort(list_distinct(list((420000 + l_partkey % 500)::VARCHAR))) AS hs6 FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey"""

RATES = {"USD": 1.08, "GBP": 0.85}

#: Phrases that stand for a page of each kind, dealt by conversation and turn.
PHRASES = [
    "DHL Express - facture de droits et taxes", "suite", "Commercial invoice, AWB 123", "Edition Akanea Delta IE MRN 25FR00012345678901",
    "continuation", "Packing list", "Proforma invoice, customs value", "General terms of transport", "Air waybill - shipper",
    "Invoice no 7 HS code 420222 total EUR 12.50", "Delta H7", "DSV Air facture no 9",
]


def pages(spark: SparkSession, d: str) -> DataFrame:
    c = _read(spark, d, "conversations")
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), ((F.col("conv_id") * 5 + F.col("turn") * F.col("turn")) % len(PHRASES) + 1).cast("int"))
    return c.select(F.concat(F.lit("f"), "conv_id").alias("path"), F.col("turn").alias("page_no"), phrase.alias("text"), F.length("text").alias("n"))


PAGES = "SELECT 'f' || conv_id AS path, turn AS page_no, [" + ", ".join(f"'{p}'" for p in PHRASES) + f"][((conv_id * 5 + turn * turn) % {len(PHRASES)} + 1)::INT] AS text, length(text) AS n FROM conversations"
