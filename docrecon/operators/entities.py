"""Which of a client's entities a declaration names, and whether declarations name all of them together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import identity, rules

# Labels of the buyer's and of the receiver's block where an invoice is checked; other than where its VAT number is read.
BILL_TO = ["BILL TO", "BIEL TO", "BILLED TO", "INVOICE TO", "SOLD TO", "ACHETEUR", "CLIENT"]
SHIP_TO = ["SHIP TO", "DESTINATAIRE", "IMPORTATEUR", "ULTIMATE CONSIGNEE"]


def vat_key(value: Column) -> Column:
    """A VAT number without white space, in capitals; null if nothing is left."""
    return F.nullif(F.upper(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)\s+", "")), F.lit(""))


def named(text: Column, read: Column, p: identity.Profile) -> Column:
    """An array of the client's VAT numbers that a declaration bears: those read (an array), and those whose SIREN or digits stand in its text's digits."""
    digits = F.regexp_replace(F.coalesce(text, F.lit("")), r"\D", "")
    keys = F.transform(F.coalesce(read, F.array().cast("array<string>")), vat_key)
    there = [F.when(F.array_contains(keys, v) | (F.lit(bool(s)) & digits.contains(s or "-")) | digits.contains("".join(c for c in v if c.isdigit())), v) for v, s in p.entities]
    return F.array_compact(F.array(*there, F.lit(None).cast("string")))


def expected(read: Column, text: Column, p: identity.Profile) -> Column:
    """The VAT number that an invoice is for: the one read if it is the client's, else that of the entity in the buyer's block, then in the receiver's, else the one read."""
    key, text = vat_key(read), F.coalesce(text, F.lit(""))
    return F.coalesce(F.when(key.isin(p.vats), key), identity.identity_vat(identity.context(text, BILL_TO), p), identity.identity_vat(identity.context(text, SHIP_TO), p), key)


def covered(named_by: DataFrame, group: str, ours: list[str]) -> DataFrame:
    """(group, n_named, all_named): how many of the client's numbers the rows of a group name together, and whether that is all.

    named_by: group and named (array); a relational division, whose groups need not fit a task. A client without numbers has all of them named.
    """
    own = named_by.select(group, F.explode_outer("named").alias("vat")).withColumn("vat", F.when(F.col("vat").isin(ours), F.col("vat")))
    n = own.groupBy(group).agg(F.count_distinct("vat").cast("int").alias("n_named"))
    return n.withColumn("all_named", F.col("n_named") == len(set(ours)))


def checks(linked: DataFrame, invoices: DataFrame, declarations: DataFrame, p: identity.Profile) -> DataFrame:
    """(invoice_id, declaration_id, tva_scope, tva_match_decl) of each invoice and the declaration that it is checked against.

    linked: invoice_id, declaration_id; invoices: invoice_id, vat, text, total; declarations: declaration_id, vat, text, total. The
    declarations' numbers are named by text and field; one that names all of the client's cannot tell whose goods they are.
    """
    read = F.array(F.col("vat"))
    d = declarations.select("declaration_id", vat_key(F.col("vat")).alias("d_vat"), F.col("total").alias("d_total"), named(F.col("text"), read, p).alias("named"))
    d = d.join(covered(d, "declaration_id", p.vats), "declaration_id")
    i = invoices.select("invoice_id", F.col("total").alias("i_total"), expected(F.col("vat"), F.col("text"), p).alias("expected"))
    both = linked.join(i, "invoice_id").join(d, "declaration_id")
    near = F.coalesce(rules.close(F.col("i_total"), F.col("d_total"), 1.0, 0.02), F.lit(False))
    scope, match = rules.entity(F.col("expected"), F.col("d_vat"), F.array(*(F.lit(v) for v in p.vats), F.lit(None).cast("string")), F.col("all_named"), near)
    return both.select("invoice_id", "declaration_id", scope.alias("tva_scope"), match.alias("tva_match_decl"))
