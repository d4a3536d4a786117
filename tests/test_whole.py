"""Queries over all rows against brute force."""

import os
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from docrecon.operators import links
from docrecon.plans import derive
from docrecon.plans.registry import QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="tables are not here")


def rows(sql):
    c = duckdb.connect()
    for name in ("orders", "lineitem"):
        c.execute(f"create view {name} as select * from '{DIR}/{name}.parquet'")
    got = c.execute(sql)
    names = [x[0] for x in got.description]
    return [dict(zip(names, r, strict=True)) for r in got.fetchall()]


def close(a, b):
    return a is not None and b is not None and (abs(a - b) <= 1 or abs(a - b) / max(abs(a), abs(b), 1) <= 0.01)


def key(x):
    return re.sub("[^A-Z0-9]", "", x.upper())


@pytest.fixture(scope="module")
def brute():
    """Scores by (invoice, declaration), the matched pairs and the declarations without a match."""
    scores, pools = {}, defaultdict(list)
    declarations = rows(derive.DECLARATIONS)
    for x in declarations:
        pools[x["id"] // derive.DOSSIER].append(x)
    matched = set()
    for i in rows(derive.INVOICES):
        own = {}
        for x in pools[i["id"] // derive.DOSSIER]:
            ref = key(x["ref"]) if x["id"] % 2 == 0 else "NONE"
            n = 80 if ref in key(i["ref"]) or key(i["ref"]) in ref else 0
            if close(i["total"], x["total"]):
                n += 35
            elif x["id"] % 4 == 0 and x["currency"] not in (None, "EUR") and i["total"] is not None and close(i["total"] / 1.08, x["total"]):
                n += 20
            own[x["id"]] = n + (20 if i["vat"] == x["vat"] else 0)
        scores |= {(i["id"], x): n for x, n in own.items()}
        sure = [x for x, n in own.items() if n >= 60]
        best = min(own, key=lambda x: (-own[x], x), default=None)
        matched |= {(i["id"], x) for x in sure or ([best] if best is not None and own[best] >= 15 else [])}
    return scores, matched, {x["id"] for x in declarations} - {x for _, x in matched}


def test_every_invoice_and_declaration(spark, brute):
    scores, matched, orphans = brute
    got = QUERIES["invoice_decl_score_all"](spark, DIR).collect()
    assert {(r["invoice_id"], r["declaration_id"]): r["score"] for r in got} == scores and len(got) == len(scores)
    assert {i for i, _ in scores} == {r["id"] for r in rows(derive.INVOICES)} and {x for _, x in scores} == {r["id"] for r in rows(derive.DECLARATIONS)}
    assert max(Counter(i for i, _ in scores).values()) <= derive.DOSSIER
    got = QUERIES["invoice_decl_matches_all"](spark, DIR).collect()
    assert {(r["invoice_id"], r["declaration_id"]) for r in got} == matched and len(got) == len(matched)
    assert sorted(r["id"] for r in QUERIES["orphan_declarations_all"](spark, DIR).collect()) == sorted(orphans)


def test_every_bundle_is_merged(spark):
    bundles = defaultdict(list)
    orders = rows("SELECT o_orderkey AS k, o_custkey AS c FROM orders ORDER BY o_orderkey")
    for r in orders:
        k, c = r["k"], r["c"]
        bundles[c % 10, [f"n:N{c % 40}", f"a:A{c % 30}", f"s:S{k}"][k % 3]].append(k)
    want = {key: (min(ks), len(ks), ",".join(dict.fromkeys(f"D{k % 50}" for k in ks))) for key, ks in bundles.items()}
    got = QUERIES["merge_bundles_all"](spark, DIR).collect()
    assert {(r["pool"], r["merge_key"]): (r["ord"], r["n_bundles"], r["members"]) for r in got} == want and len(got) == len(want)
    assert sum(r["n_bundles"] for r in got) == len(orders)


def test_members_are_gathered_once(spark, capsys):
    table = spark.createDataFrame([(1, i, f"D{i % 3}", "N1", "", "", "") for i in range(300)], "pool long, ord long, member string, number string, awb string, mrn string, sources string")
    merged = links.merge_bundles(table)
    assert [tuple(r) for r in merged.collect()] == [(1, "n:N1", 0, 300, "D0,D1,D2")]
    merged.explain()
    plan = capsys.readouterr().out
    assert "member" in "".join(re.findall(r"keys=\[[^\]]*\]", plan))
