"""python -m docrecon FOLDER --out FOLDER: reconciles a folder of files. Exit code 0 without anomalies, 1 with, 2 for wrong use."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.identity import Profile
from .plans import run
from .sinks import report


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="docrecon", description=__doc__)
    p.add_argument("root")
    p.add_argument("--out", required=True, help="folder for Parquet results")
    p.add_argument("--profile", action="append", help="JSON file, of several the later one counts for each of its keys: entities, names, addresses (lists of pairs), keywords, rates, scope, known_ids, prefixes")
    p.add_argument("--pages", help="folder of the table of pages by content, which spares a second parsing")
    p.add_argument("--pdf-reader", help="module:function from a PDF's bytes to its pages' texts")
    p.add_argument("--workbook", help="also write this .xlsx")
    p.add_argument("--webhook", help="also post the summary to this address")
    p.add_argument("--exit-zero", action="store_true")
    a = p.parse_args(args)
    conf, rates = {}, {}
    for path in a.profile or []:
        with open(path, encoding="utf-8") as f:
            layer = json.load(f)
        rates |= layer.pop("rates", {})
        conf |= layer
    profile = Profile(**{k: [x if isinstance(x, str) else tuple(x) for x in v] for k, v in ({"entities": []} | conf).items()})
    spark = SparkSession.builder.appName("docrecon").getOrCreate()
    for name, make in (("pages", lambda: run.read(spark, a.root, a.pdf_reader, a.pages)), ("documents", lambda: run.documents(spark.read.parquet(f"{a.out}/pages"), a.root, profile)), ("bundles", lambda: run.reconcile(spark.read.parquet(f"{a.out}/documents"), rates, profile))):
        make().write.mode("overwrite").parquet(f"{a.out}/{name}")
    pages, docs, bundles = (spark.read.parquet(f"{a.out}/{n}") for n in ("pages", "documents", "bundles"))
    errors = pages.filter("error is not null").select("path", "error")
    total = report.summary(bundles, docs.count(), errors.count())
    print(json.dumps(total))
    if a.workbook:
        flat = bundles.withColumn("checks", F.to_json("checks"))
        report.workbook({"Synthese": flat, "OK_A_Controler": flat.filter("status = 'OK_A_CONTROLER'"), "KO_Bloquants": flat.filter("status = 'KO_BLOQUANT'"), "Erreurs": errors}, a.workbook)
    if a.webhook:
        report.post(a.webhook, total)
    return int(bool(total["anomalies"]) and not a.exit_zero)


if __name__ == "__main__":
    sys.exit(main())
