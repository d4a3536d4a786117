"""How often a plan does a thing: what is dear is done once."""

import random

import pytest
from pyspark.sql import functions as F

from docrecon.functions.columns import amount, tariff_code, words_of
from docrecon.operators import duties, extract, links, tariff, totals
from tests.test_fields import CODES


def test_an_amount_is_bared_once(spark):
    assert str(amount(F.col("t"))).count("trim(") == 1
    texts = [" 1.234,50", "1,234.50", "1,234", "12", "1.2.3", "-,5", "", "1 000,5", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", amount(F.col("t")).alias("a"), amount(F.col("t"), True).alias("b")).orderBy("i").collect()
    assert [(r["a"], r["b"]) for r in rows] == [(1234.5, 1234.5), (1234.5, 1234.5), (1.234, 1234.0), (12.0, 12.0), (None, None), (-0.5, -0.5), (None, None), (1000.5, 1000.5), (None, None)]


def test_rows_of_duties_take_one_scan(spark):
    assert str(duties.duty_rows(F.col("t"))).count("regexp_extract_all(t,") == 1
    row = "4202220000 900,00 Droits de Douane 3,50 "
    text = f"x4202220001 1 Droits de Douane 1 1\n{row}7,é\U0001f600 TVA à l'importation 10,00 2,00. " + row.replace("0000", "0009") + "8"
    spark_rows = spark.createDataFrame([(text,)], "t string").select(duties.duty_rows(F.col("t")).alias("r")).first()["r"]
    assert [tuple(r) for r in spark_rows] == [("4202220000", 900.0, 3.5, 7.0, 10.0, 2.0, None, None), ("4202220009", 900.0, 3.5, 8.0, None, None, None, None)]


def test_tables_of_duties_are_cut_once(spark):
    text = str(duties.article_duties(F.col("t")))
    assert text.count("LIQUIDATION") == 1
    assert "[^\\n]*" not in text  # a search for the last line from every place of a text takes the square of a line
    got = spark.createDataFrame([("LIQUIDATION\nU165\r\nMontant\r\n10,5\r\n20",), ("LIQUIDATION\n U165 \nMontant\n\n7\n",)], "t string").select(duties.article_duties(F.col("t")).alias("d")).collect()
    assert [r["d"]["dd"] for r in got] == [10.5, 7.0]


def test_references_have_no_more_parts_than_can_meet(spark):
    rows = spark.createDataFrame([("INV1234567", [], 10), ("INV1234567", [], 9), ("INV1234567", [], 6), ("INV1234567", [], None)], "ref string, kinds array<int>, least int")
    parts = [r["p"] for r in rows.select(links._containing(F.col("ref")).alias("p")).collect()]
    assert parts == [["234567"], ["123456", "234567"], ["INV123", "NV1234", "V12345", "123456", "234567"], []]
    kinds = F.array(links._kind(F.lit("V12")), links._kind(F.lit("")), links._kind(F.lit("X")))
    assert rows.limit(1).select("ref", "least", kinds.alias("kinds")).select(links._containing(F.col("ref")).alias("p")).first()["p"] == ["234567", "V12", ""]


def test_terms_find_what_all_pairs_find(spark):
    rng = random.Random(7)
    ref = lambda: "".join(rng.choice("AB1") for _ in range(rng.choice([0, 1, 2, 5, 6, 7, 8, 11])))
    some = lambda f: f() if rng.random() < 0.6 else None
    total = lambda: rng.choice([0.0, 0.4, -0.5, 99.5, 100.4, 199.5, 200.6, 201.7, 230.0, 10000.0, 10099.0, -10000.0, 9901.0, round(rng.uniform(1, 400), 2)])
    i = [(n % 3, n, some(lambda: rng.choice("fg")), ref(), some(lambda: f"W{rng.randrange(9)}"), some(total), some(lambda: rng.choice("vw")), [], rng.choice(["", "l"])) for n in range(90)]
    d = [(n % 4, n, n, some(lambda: rng.choice("fg")), [some(ref) for _ in range(rng.randrange(3))], [f"W{rng.randrange(9)}"], some(total), rng.choice(["USD", "EUR"]), some(lambda: rng.choice([1.08, 0.5, 7.0])), some(lambda: rng.choice("vw")), [], rng.choice(["", "l"])) for n in range(90)]
    i = spark.createDataFrame(i, "pool int, invoice_id int, folder string, ref string, awb string, total double, vat string, hs6 array<string>, lead string")
    d = spark.createDataFrame(d, "pool int, declaration_id int, ord int, folder string, refs array<string>, awbs array<string>, total double, currency string, fx double, vat string, hs6 array<string>, lead string")
    every = links.pool_scores(i, d).filter("score > 0")
    assert sorted(map(tuple, links.shared_terms(i, d).collect())) == sorted(map(tuple, every.collect()))
    assert sorted(map(tuple, links.match(i, d).collect())) == sorted(map(tuple, links.matches(every).collect()))


def test_outputs_of_groups_stay_small(monkeypatch):
    """Neither a training step nor scores make an array of all tokens by all groups, and both do what the plain sums say."""
    np = pytest.importorskip("numpy")
    scoring = pytest.importorskip("docrecon.llm.scoring")
    groups, n, widest, exp = 32, 5000, [], scoring.Window._exp
    rng = np.random.default_rng(3)
    leaves = np.minimum(rng.zipf(1.3, n), groups * scoring.LEAVES - 1).astype(np.uint16)
    around, centre = scoring.around_of([leaves], groups * scoring.LEAVES)
    net = scoring.Window(groups, whole=np.bincount(leaves, minlength=groups * scoring.LEAVES).astype(float))
    monkeypatch.setattr(scoring.Window, "_exp", staticmethod(lambda z, reach: widest.append(z.shape) or exp(z, reach)))

    def plain(flat):  # log-probabilities, and the gradient of their mean by the groups' and leaves' weights
        w = scoring.Window(groups, flat)
        h = np.tanh(sum(w.near[j][around[:, j]].astype(float) for j in range(2 * scoring.SIDE)))
        g, k = centre // scoring.LEAVES, centre % scoring.LEAVES
        top = np.exp(h @ w.top + w.top_bias)
        leaf = np.exp(np.einsum("nh,nhl->nl", h, w.leaf[g]) + w.leaf_bias[g])
        top, leaf = top / top.sum(1, keepdims=True), leaf / leaf.sum(1, keepdims=True)
        at = np.arange(n)
        log = np.log(top[at, g] * leaf[at, k])
        top[at, g] -= 1
        leaf[at, k] -= 1
        by_leaf = np.zeros(w.leaf.shape)
        np.add.at(by_leaf, g, h[:, :, None] * leaf[:, None, :] / n)
        return log, h.T @ top / n, by_leaf

    log, by_top, by_leaf = plain(net.flat)
    assert np.allclose(net.log_probability(around, centre), log, atol=1e-4)
    square = scoring.Window(groups, np.zeros(len(net.flat), np.float32))
    net.learn(around, centre, square)
    assert np.allclose(np.sqrt(square.top), np.abs(by_top), atol=1e-6) and np.allclose(np.sqrt(square.leaf), np.abs(by_leaf), atol=1e-6)
    assert max(rows for rows, columns in widest if columns == groups) <= 1024


def test_a_tariff_code_is_bared_once(spark):
    assert str(tariff_code(F.col("t"))).count("regexp_replace") == 1
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["4262.22", "100900", "420222123", "42022212340", "42022212341", "12345", None])], "i int, t string")
    assert [r["c"] for r in rows.select("i", tariff_code(F.col("t")).alias("c")).orderBy("i").collect()] == ["420222", None, "4202221230", "4202221234", None, None, None]


def test_labels_that_a_text_lacks_are_passed_over(spark):
    """A text's words are asked first, and whatever a pattern finds is found with them, too: accents, signs and odd capitals."""
    labels = ["Masse nette totale (kg)", "Pays d'origine", "Total a payer", "Code P. origine", "TG", "Waybill No"]
    texts = [f"x {x}{gap}12,5 {tail}" for label in labels for x in (label, label.upper(), label.replace("e", "é"), label.replace("a", "À"), label.replace("s", "ſ").replace("i", "ı"), label.replace(" ", "\n-")) for gap in (" : ", " ", "") for tail in ("FR", "")] + ["", "KG", "é́ 12"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("w", words_of(F.col("t")))
    plain, quick = (F.array(*(extract.any_of(F.col("t"), "amount", [(x, gap)], w) for x in labels for gap in ("next", "line"))) for w in (None, F.col("w")))
    got = rows.select(plain.alias("plain"), quick.alias("quick"), tariff.codes(F.col("t")).alias("a"), tariff.codes(F.col("t"), words=F.col("w")).alias("b"), totals.choice(F.col("t")).alias("c"), totals.choice(F.col("t"), F.col("w")).alias("d")).collect()
    assert all(r["plain"] == r["quick"] and r["a"] == r["b"] and r["c"] == r["d"] for r in got)
    assert sum(v is not None for r in got for v in r["quick"]) > 100


def test_codes_with_and_without_words_agree(spark):
    rows = spark.createDataFrame([(t,) for t, _ in CODES], "t string").withColumn("w", words_of(F.col("t")))
    got = rows.select(tariff.codes(F.col("t")).alias("a"), tariff.codes(F.col("t"), words=F.col("w")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got) and any(r["b"] for r in got)


def test_passages_are_sorted_some_at_a_time(monkeypatch):
    """A bucket sorts few windows at once, also those of one anchor that many documents have in other words; anchors are looked for block by block."""
    np, pa = pytest.importorskip("numpy"), pytest.importorskip("pyarrow")
    suffix = pytest.importorskip("docrecon.llm.suffix")
    rng = random.Random(5)
    line = "".join(rng.choice("abcdefgh ") for _ in range(70))
    say = lambda n: "".join(rng.choice("klmnopé ") for _ in range(n))
    texts = [say(rng.choice([0, 9, 40])) + line[: rng.choice([30, 55, 70])] + say(rng.choice([0, 5, 60])) for _ in range(300)] + ["it " * 60, "", line[:49], "it " * 40]
    blobs = [suffix._pack(pa.record_batch([pa.array(range(x, x + 76), pa.int64()), pa.array(texts[x : x + 76], pa.large_string())], names=["i", "t"])) for x in range(0, 304, 76)]
    limit, widest, plain, hashed, letters = 500, [], suffix.deep_shallow, [], suffix._LETTER
    monkeypatch.setattr(suffix, "SORTED_WINDOWS", limit, raising=False)
    monkeypatch.setattr(suffix, "BLOCK", 300, raising=False)
    monkeypatch.setattr(suffix, "deep_shallow", lambda buf, at: widest.append(len(at)) or plain(buf, at))
    monkeypatch.setattr(suffix, "_LETTER", type("Letters", (), {"__getitem__": lambda _, x: hashed.append(len(x)) or letters[x]})())
    chunks = pa.table({"chunk": pa.array(range(len(blobs)), pa.int64()), "blob": pa.array(blobs, pa.binary())})
    shared = suffix._shared(pa.Table.from_batches(suffix._seen(1)(chunks.to_batches())))
    of = lambda table, c: table.filter(pa.compute.equal(table.column("chunk"), c))
    regions = pa.concat_tables([suffix._regions(1)(of(chunks, c), of(shared, c)) for c in range(len(blobs))])
    assert len(set(range(4)) & set(regions.column("chunk").to_pylist())) == 4
    found = suffix._sorted_bucket(regions)
    got = [row["n_removed"] for c in range(len(blobs)) for row in suffix._digest(of(chunks, c), of(found, c)).to_pylist()]
    seen: set = set()
    for text, n in zip(texts, got, strict=True):
        b = text.encode()
        windows = [b[i : i + 50] for i in range(len(b) - 49)]
        gone = {j for i, w in enumerate(windows) if w in seen for j in range(i, i + 50)}
        seen.update(windows)
        assert n == len(gone)
    assert sum(widest) > 3 * limit and max(widest) <= 2 * limit and max(hashed) < 400


def test_rows_of_duties_are_rows_before_they_are_read(spark, tmp_path):
    """The query shuffles no texts and reads fields outside of lambdas; whatever by_code finds in odd texts is found so, too."""
    from docrecon.plans import registry

    spark.createDataFrame([(1, 2, 3, 1)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = registry.forwarder_duties(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(regexp_extract_all(" in plan and "transform(regexp_extract_all(" not in plan
    assert "collect_list(struct(l_linenumber, l_linenumber#" in plan and "l_partkey, l_partkey#" in plan
    head, tva, at = "4202220000 900,00 Droits de Douane 3,50 ", "TVA à l'importation 10,00 ", "Autres Taxes 5 "
    amounts = ["7", "7,5", "7.5.", "1.234,50", "1,234.5,", ".", ",5", "12,", "\u0663", "9" * 400, "1.2.3", "007"]
    texts = [f"{head}{x}\n{gap}{t}{y} z {u}{x}" for x in amounts for y in amounts[:8] for gap in ("", "x " * 195) for t, u in ((tva, at), (tva.upper().replace("À", "A"), at.lower()), ("tVa\u00a0A l’IMPORTATION 1 ", "autres\ntaxes 1\t"))]
    texts += [f"{head}7,00 {head}8 {tva}3\nTotal {at}4 TVA", f"é{head}7", f"\U0001f600 {head.replace('4', '\u0664', 1)}7\n{at}2", "", None, head, f"{head}7\n" * 3 + at + "1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    old, new = duties.by_code(docs.select("id", duties.duty_rows(F.col("text")).alias("duty_rows"))), duties.by_code_of_texts(docs)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(old) == rows(new) and len(rows(new)) > len(amounts) * 8 and sum(r["at"] is not None for r in new.collect()) > 100
