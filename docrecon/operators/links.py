"""Score joins: invoices to declarations, forwarder invoices to dossiers, orphans, merged dossiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import close, refs_match

SURE, LEAST, PRESTATION_LEAST = 60, 15, 30


def _points(condition: Column, points: int) -> Column:
    return F.when(condition, points).otherwise(0)


def pool_scores(invoices: DataFrame, declarations: DataFrame) -> DataFrame:
    """All pairs within a pool with their score (pool, invoice_id, declaration_id, ord, score), zeros too: for pools of bounded size.

    Different sub-folders rule a pair out.
    invoices: pool, invoice_id, folder, ref, awb, total, vat, hs6 (array), lead; declarations: pool, declaration_id, ord, folder, refs (array), awbs (array), total, currency, fx, vat, hs6 (array), lead.
    """
    i = invoices.select(*(F.col(c).alias(f"i_{c}") if c not in ("pool", "invoice_id") else F.col(c) for c in invoices.columns))
    d = declarations.select(*(F.col(c).alias(f"d_{c}") if c not in ("pool", "declaration_id", "ord") else F.col(c) for c in declarations.columns))
    both = i.join(d, "pool")
    near = F.coalesce(close(F.col("i_total"), F.col("d_total")), F.lit(False))
    converted = F.coalesce((F.col("d_fx") > 0) & (F.col("d_currency") != "EUR") & close(F.col("i_total") / F.col("d_fx"), F.col("d_total")), F.lit(False))
    folders = F.col("i_folder").isNotNull() & F.col("d_folder").isNotNull()
    score = (
        _points(folders & (F.col("i_folder") == F.col("d_folder")), 100)
        + _points(F.coalesce((F.col("i_ref") != "") & F.exists("d_refs", lambda r: refs_match(r, F.col("i_ref"))), F.lit(False)), 80)
        + _points(F.coalesce(F.array_contains("d_awbs", F.col("i_awb")), F.lit(False)), 60)
        + F.when(near, 35).when(converted, 20).otherwise(0)
        + _points(F.coalesce(F.col("i_vat") == F.col("d_vat"), F.lit(False)), 20)
        + F.when((F.size("i_hs6") > 0) & (F.size("d_hs6") > 0), F.least(F.lit(20), 8 * F.size(F.array_intersect("i_hs6", "d_hs6")))).otherwise(0)
        + _points(F.coalesce((F.col("i_lead") != "") & (F.col("i_lead") == F.col("d_lead")), F.lit(False)), 70)
    )
    return both.select("pool", "invoice_id", "declaration_id", "ord", F.when(folders & (F.col("i_folder") != F.col("d_folder")), 0).otherwise(score).cast("int").alias("score"))


#: Characters of a reference that must be found in the one that contains it before both are compared; shorter ones are looked up whole.
GRAM = 6
#: A pool's short references are told by so many classes of their letters for each length, however many they are.
_KINDS = 1024
#: Width of the classes of amounts by their logarithm: two that are close are at most half a class apart.
_CLASS = 0.0204
#: Amounts below it may be close by their difference alone.
_SMALL = 200
#: What a pair shares, as bits that are joined over its rows, and the points of each. Of an amount the equal one counts before the converted one.
_BITS = {"F": 1, "C": 2, "W": 4, "L": 8, "V": 16, "near": 32, "converted": 64}
_WORTH = {"F": 100, "C": 80, "W": 60, "L": 70, "V": 20}


def _parts(ref: Column, n: Column, first: Column) -> Column:
    """The parts of n characters from a place on."""
    last = F.length(ref) - n + 1
    return F.when(first <= last, F.transform(F.sequence(first, last), lambda k: F.substr(ref, k, n))).otherwise(F.array().cast("array<string>"))


def _kind(ref: Column) -> Column:
    return (F.length(ref) * _KINDS + F.crc32(ref) % _KINDS).cast("int")


def _containing(ref: Column) -> Column:
    """The parts of a reference that may tell one within it, by what the other side of its pool has (see _references): short ones
    whole, longer ones by their last GRAM characters, which end where the shortest of them does or later."""
    short = lambda n: F.when(n == 0, F.array(F.lit(""))).otherwise(_parts(ref, n, F.lit(1)))
    lengths = F.array_distinct(F.transform(F.coalesce("kinds", F.array().cast("array<int>")), lambda k: F.floor(k / _KINDS).cast("int")))
    whole = F.filter(F.flatten(F.transform(lengths, short)), lambda r: F.array_contains("kinds", _kind(r)))
    long = F.when(F.col("least").isNotNull(), _parts(ref, F.lit(GRAM), F.col("least") - GRAM + 1)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(long, whole))


def _contained(ref: Column) -> Column:
    return F.when(F.length(ref) < GRAM, ref).otherwise(F.substring(ref, -GRAM, GRAM))


def _references(rows: DataFrame, *more: Column) -> DataFrame:
    """(pool, kinds, least) of rows (pool, ref): the classes of references below GRAM characters, and the length of the shortest other one."""
    n = F.length("ref")
    return rows.groupBy("pool").agg(F.collect_set(F.when(n < GRAM, _kind(F.col("ref")))).alias("kinds"), F.min(F.when(n >= GRAM, n)).alias("least"), *more)


def _amount_class(total: Column) -> Column:
    return F.concat(F.when(total < 0, "-").otherwise(""), F.floor(F.log(F.abs(total)) / _CLASS).cast("string"))


def _terms(term: str, keys: Column) -> Column:
    """Keys of one term, without null ones."""
    return F.transform(F.filter(F.coalesce(keys, F.array().cast("array<string>")), lambda k: k.isNotNull()), lambda k: F.concat(F.lit(term), k))


def _near_classes(total: Column) -> Column:
    sign, k = F.when(total < 0, "-").otherwise(""), F.log(F.abs(total)) / _CLASS
    return F.when(total != 0, F.transform(F.array(F.floor(k - 0.5), F.floor(k + 0.5)), lambda x: F.concat(sign, x.cast("string"))))


def _near_wholes(total: Column, gap: Column) -> Column:
    return F.when(F.abs(total) <= _SMALL * gap, F.transform(F.sequence(F.floor(total - gap), F.floor(total + gap)), lambda x: x.cast("string")))


def _met(invoices: DataFrame, declarations: DataFrame, vat_alone: bool) -> DataFrame:
    """(pool, invoice_id, declaration_id, ord, bits, codes): a row for each key that a pair shares."""
    i = invoices.select("pool", "invoice_id", "folder", F.coalesce("ref", F.lit("")).alias("ref"), "awb", F.col("total").cast("double").alias("total"), "vat", "hs6", "lead")
    d = declarations.select("pool", "declaration_id", "ord", "folder", F.filter("refs", lambda r: r.isNotNull()).alias("refs"), "awbs", F.col("total").cast("double").alias("total"), F.when((F.col("fx") > 0) & (F.col("currency") != "EUR"), F.col("fx").cast("double")).alias("fx"), "vat", "hs6", "lead")
    none = F.array().cast("array<string>")
    # containing parts (c) of one side meet contained keys of the other; i: the invoice's reference is the longer one
    theirs = _references(d.select("pool", "fx", F.explode_outer("refs").alias("ref")), F.max("fx").alias("most"))
    small = F.abs("total") <= (_SMALL + 2) * F.greatest(F.lit(1.0), F.coalesce("most", F.lit(1.0)))
    i_ref, known = F.col("ref"), F.col("ref") != ""
    i_keys = F.concat(
        _terms("F", F.array("folder")),
        _terms("C", F.when(known, _containing(i_ref))),
        _terms("D", F.when(known, F.array(_contained(i_ref)))),
        _terms("W", F.array("awb")),
        _terms("T", F.when(F.col("total") != 0, F.array(_amount_class(F.col("total"))))),
        _terms("S", F.when(small, F.array(F.floor("total").cast("string")))),
        _terms("V", F.array("vat")) if vat_alone else none,
        _terms("H", F.array_distinct("hs6")),
        _terms("L", F.when(F.col("lead") != "", F.array("lead"))),
    )
    term = F.substring("key", 1, 1)
    referring, priced = term.isin("C", "D"), term.isin("T", "S")
    vats = lambda name: [] if vat_alone else [F.col("vat").alias(name)]
    # a row has what its term is told by, and nothing more: rows are many
    left = i.join(theirs, "pool", "left").withColumn("key", F.explode(i_keys))
    left = left.select("pool", "key", "invoice_id", F.col("folder").alias("i_folder"), F.when(referring, i_ref).alias("i_ref"), F.when(priced, F.col("total")).alias("i_total"), *vats("i_vat"))
    d_keys = F.concat(
        _terms("F", F.array("folder")),
        _terms("C", F.transform("refs", _contained)),
        _terms("D", F.flatten(F.transform("refs", _containing))),
        _terms("W", F.array_distinct("awbs")),
        _terms("T", F.concat(F.coalesce(_near_classes(F.col("total")), none), F.coalesce(_near_classes(F.col("total") * F.col("fx")), none))),
        _terms("S", F.concat(F.coalesce(_near_wholes(F.col("total"), F.lit(1.0)), none), F.coalesce(_near_wholes(F.col("total") * F.col("fx"), F.col("fx")), none))),
        _terms("V", F.array("vat")) if vat_alone else none,
        _terms("H", F.array_distinct("hs6")),
        _terms("L", F.when(F.col("lead") != "", F.array("lead"))),
    )
    right = d.join(_references(invoices.filter("ref <> ''").select("pool", "ref")), "pool", "left").withColumn("key", F.explode(F.array_distinct(d_keys)))
    right = right.select("pool", "key", "declaration_id", "ord", F.col("folder").alias("d_folder"), F.when(referring, F.col("refs")).alias("refs"), F.when(priced, F.col("total")).alias("d_total"), F.when(priced, F.col("fx")).alias("fx"), *vats("d_vat"))
    met = left.join(right, ["pool", "key"]).filter(F.col("i_folder").isNull() | F.col("d_folder").isNull() | (F.col("i_folder") == F.col("d_folder")))
    referred = F.exists("refs", lambda r: refs_match(r, F.col("i_ref")))
    near, converted = close(F.col("i_total"), F.col("d_total")), close(F.col("i_total") / F.col("fx"), F.col("d_total"))
    bits = F.when(referring, F.when(referred, _BITS["C"])).when(priced, F.when(near, _BITS["near"]).when(converted, _BITS["converted"])).when(term == "H", 0)
    for k in "FWLV":
        bits = bits.when(term == k, _BITS[k])
    same = F.lit(0) if vat_alone else F.when(F.col("i_vat") == F.col("d_vat"), _BITS["V"]).otherwise(0)
    rows = met.select("pool", "invoice_id", "declaration_id", "ord", bits.bitwiseOR(same).alias("bits"), F.when(term == "H", 1).otherwise(0).alias("codes"))
    return rows.filter("bits is not null")


def _summed(rows: DataFrame) -> DataFrame:
    """The score of each pair from its rows."""
    has = lambda k: F.col("bits").bitwiseAND(_BITS[k]) != 0
    score = sum((_points(has(k), points) for k, points in _WORTH.items()), F.when(has("near"), 35).when(has("converted"), 20).otherwise(0))
    pairs = rows.groupBy("pool", "invoice_id", "declaration_id", "ord").agg(F.bit_or("bits").alias("bits"), F.sum("codes").alias("codes"))
    return pairs.select("pool", "invoice_id", "declaration_id", "ord", (score + F.least(F.lit(20), 8 * F.col("codes"))).cast("int").alias("score"))


def shared_terms(invoices: DataFrame, declarations: DataFrame, vat_alone: bool = True) -> DataFrame:
    """(pool, invoice_id, declaration_id, ord, score) of the pairs of a pool that share a term: a folder, a reference that contains
    the other, a waybill, an amount, a VAT number, a tariff code, a leading reference. Different sub-folders rule a pair out.

    Each side is a row for each key of each term, and one equi-join on (pool, key) finds the pairs: no pair is formed without a
    term. A term's points count once a pair, 8 for each tariff code, and are summed. With vat_alone false a VAT number adds its points
    but makes no pair. For the columns see pool_scores.

    References: the longer one has a key for each part of GRAM characters that the last part of one in its pool's other side can
    be, the shorter one for its last part; whether it is contained is told after the join. References below GRAM characters are
    keys themselves, and the other side has only parts of the classes that its pool has. Amounts: classes by logarithm, and whole
    numbers where a difference of 1 is more than 1 %.
    """
    return _summed(_met(invoices, declarations, vat_alone))


def first_of_vat(invoices: DataFrame, declarations: DataFrame) -> DataFrame:
    """Of each invoice the first declaration of its pool with its VAT number that no sub-folder rules out, at the points of a VAT number: a row an invoice at most."""
    d = declarations.filter(F.col("vat").isNotNull()).select("pool", "vat", F.explode(F.array(F.lit("any"), F.when(F.col("folder").isNull(), "none"))).alias("place"), F.struct("ord", "declaration_id").alias("d")).filter("place is not null")
    first = d.groupBy("pool", "vat", "place").agg(F.min("d").alias("d"))
    i = invoices.select("pool", "vat", F.when(F.col("folder").isNull(), "any").otherwise("none").alias("place"), "invoice_id")
    return i.join(first, ["pool", "vat", "place"]).select("pool", "invoice_id", "d.declaration_id", "d.ord", F.lit(20).alias("score"))


def match(invoices: DataFrame, declarations: DataFrame) -> DataFrame:
    """The matches of all pairs of a pool, without forming those that share a VAT number alone: of these only the first can be the best."""
    first = first_of_vat(invoices, declarations).select("pool", "invoice_id", "declaration_id", "ord", F.lit(_BITS["V"]).alias("bits"), F.lit(0).alias("codes"))
    # pairs and windows are both within an invoice: one shuffle serves them
    return matches(_summed(_met(invoices, declarations, vat_alone=False).unionByName(first).repartition("pool", "invoice_id")))


def matches(scored: DataFrame) -> DataFrame:
    """For each invoice all declarations of a sure score; if none is, the best one of at least the least score, the first of equal ones.
    Pairs below the least score go before the windows: most pairs of a pool share nothing."""
    one = W.partitionBy("pool", "invoice_id")
    ranked = scored.filter(F.col("score") >= LEAST).withColumn("best", F.max("score").over(one)).withColumn("n", F.row_number().over(one.orderBy(F.desc("score"), "ord")))
    return ranked.filter((F.col("score") >= SURE) | ((F.col("best") < SURE) & (F.col("n") == 1) & (F.col("score") >= LEAST))).select("pool", "invoice_id", "declaration_id", "ord", "score")


#: Points of a shared folder, reference, waybill and total where one declaration is chosen for an invoice: to repair it, and to check it.
FOR_REPAIR, FOR_RULES = (100, 60, 60, 0), (100, 80, 80, 20)


def best_declaration(linked: DataFrame, invoices: DataFrame, declarations: DataFrame, points: tuple[int, int, int, int]) -> DataFrame:
    """(bundle_id, invoice_id, declaration_id, score): of an invoice's declarations the one of most points, the first of equal ones, even without any.

    linked: bundle_id, invoice_id, declaration_id, ord; invoices: invoice_id, folder, ref, awb, total; declarations: declaration_id, folder, refs (array), awbs (array), total.
    """
    i = invoices.select("invoice_id", *(F.col(c).alias(f"i_{c}") for c in ("folder", "ref", "awb", "total")))
    d = declarations.select("declaration_id", *(F.col(c).alias(f"d_{c}") for c in ("folder", "refs", "awbs", "total")))
    folder, ref, awb, amount = points
    score = (
        _points(F.coalesce((F.col("i_folder") != "") & (F.col("i_folder") == F.col("d_folder")), F.lit(False)), folder)
        + _points(F.coalesce((F.col("i_ref") != "") & F.exists("d_refs", lambda r: refs_match(r, F.col("i_ref"))), F.lit(False)), ref)
        + _points(F.coalesce((F.col("i_awb") != "") & F.array_contains("d_awbs", F.col("i_awb")), F.lit(False)), awb)
        + _points(F.coalesce(close(F.col("i_total"), F.col("d_total")), F.lit(False)), amount)
    ).cast("int")
    scored = linked.join(i, "invoice_id").join(d, "declaration_id").withColumn("score", score)
    best = F.min(F.struct((-F.col("score")).alias("s"), "ord", "declaration_id"))
    return scored.groupBy("bundle_id", "invoice_id").agg(best.alias("b")).select("bundle_id", "invoice_id", "b.declaration_id", (-F.col("b.s")).alias("score"))


def prestation_bundle_score(bundles: DataFrame, prestations: DataFrame) -> DataFrame:
    """All pairs within a pool with their score (bundle_id, prestation_id, ord, score).

    A forwarder's invoice of a dossier that none of the bundle's documents is of is ruled out. Empty keys match nothing.
    bundles: pool, bundle_id, dossiers, mrns, awbs, sources (arrays), duties (their sum over the declarations); prestations: pool, prestation_id, ord, dossier, mrns, awbs (arrays), source, paid.
    """
    both = bundles.select("pool", "bundle_id", *(F.col(c).alias(f"b_{c}") for c in ("dossiers", "mrns", "awbs", "sources", "duties"))).join(prestations, "pool")
    shared = lambda c: F.coalesce(F.arrays_overlap(F.array_remove(F.col(f"b_{c}"), ""), F.col(c)), F.lit(False))
    holds = lambda c, x: F.coalesce((F.col(x) != "") & F.array_contains(f"b_{c}", F.col(x)), F.lit(False))
    foreign = F.coalesce((F.col("dossier") != "") & (F.size("b_dossiers") > 0), F.lit(False)) & ~holds("dossiers", "dossier")
    paid = F.coalesce((F.col("b_duties") != 0) & (F.abs(F.col("paid") - F.col("b_duties")) <= 1.0), F.lit(False))
    score = _points(holds("dossiers", "dossier"), 100) + _points(shared("mrns"), 90) + _points(shared("awbs"), 60) + _points(paid, 30) + _points(holds("sources", "source"), 40)
    return both.select("bundle_id", "prestation_id", "ord", F.when(foreign, 0).otherwise(score).cast("int").alias("score"))


def best_prestation(scored: DataFrame) -> DataFrame:
    """The forwarder invoice of highest score for each dossier, the first of equal ones, if it reaches the least score."""
    best = F.min(F.struct((-F.col("score")).alias("s"), "ord", "prestation_id"))
    scored = scored.filter(F.col("score") >= PRESTATION_LEAST)
    return scored.groupBy("bundle_id").agg(best.alias("b")).select("bundle_id", "b.prestation_id", (-F.col("b.s")).alias("score"))


def orphans(rows: DataFrame, used: DataFrame, key: str) -> DataFrame:
    return rows.join(used.select(key), key, "left_anti")


def merge_bundles(bundles: DataFrame) -> DataFrame:
    """Dossiers of a pool with the same key (number, waybill, MRN or sources: the first there is) become one; members in first-seen order, once."""
    key = F.coalesce(*(F.when(F.col(c) != "", F.concat(F.lit(c[0] + ":"), F.col(c))) for c in ("number", "awb", "mrn", "sources")))
    # one row a member first: a key's group then grows with its members, not with its dossiers
    once = bundles.withColumn("merge_key", key).groupBy("pool", "merge_key", "member").agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("n"))
    members = F.transform(F.sort_array(F.collect_list(F.struct("ord", "member"))), lambda x: x["member"])
    return once.groupBy("pool", "merge_key").agg(F.min("ord").alias("ord"), F.sum("n").alias("n_bundles"), F.array_join(members, ",").alias("members"))
