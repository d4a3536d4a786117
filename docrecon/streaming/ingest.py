"""Dossiers as a stream: events of arriving documents, complete once both sides are there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def completeness(arrivals: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Documents by dossier and window from (ts, dossier, kind), with a watermark for late ones; complete if both kinds came."""
    counted = arrivals.withWatermark("ts", late).groupBy(F.window("ts", window), "dossier").agg(F.count_if(F.col("kind") == "invoice").alias("invoices"), F.count_if(F.col("kind") == "declaration").alias("declarations"))
    return counted.select(F.col("window.start").alias("start"), "dossier", "invoices", "declarations", ((F.col("invoices") > 0) & (F.col("declarations") > 0)).alias("complete"))
