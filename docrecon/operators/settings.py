"""Settings of clients in layers: rates, tariff scope, numbers that are no codes. Each is a row, and the highest layer of a key wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of settings that are broadcast once they are counted; more meet their rows by a plain join.
BROADCAST_ROWS = 100_000
SCHEMA = "client string, kind string, key string, layer int, value string"


def settled(layers: DataFrame) -> DataFrame:
    """(client, kind, key, value, layer): of each client's key the value of its highest layer; of equal layers the larger value. A null client's rows are shared by all.

    A null value takes a key away: no lower layer shows through.
    """
    best = F.max(F.struct("layer", F.col("value").isNotNull().alias("given"), "value")).alias("b")
    return layers.groupBy("client", "kind", "key").agg(best).select("client", "kind", "key", "b.value", "b.layer")


def _meet(rows: DataFrame, side: DataFrame, on: Column, small: bool) -> DataFrame:
    return rows.join(F.broadcast(side) if small else side, on, "left")


def looked_up(rows: DataFrame, layers: DataFrame, kind: str, key: str, out: str, client: str = "client") -> DataFrame:
    """rows with a column out: the client's setting of that kind for the row's key, else the shared one, else null.

    A key that a client's own highest layer takes away stays null, whatever is shared.
    """
    final = settled(layers.filter(F.col("kind") == kind))
    small = final.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    own = final.filter("client is not null").select(F.struct("client", "key", "value").alias("own_"))
    shared = final.filter("client is null").select(F.struct("key", "value").alias("shared_"))
    met = _meet(rows, own, (F.col("own_.client") == F.col(client)) & (F.col("own_.key") == F.col(key)), small)
    met = _meet(met, shared, F.col("shared_.key") == F.col(key), small)
    return met.select(*rows.columns, F.when(F.col("own_.client").isNotNull(), F.col("own_.value")).otherwise(F.col("shared_.value")).alias(out))


def within_scope(rows: DataFrame, layers: DataFrame, codes: str, out: str, client: str = "client") -> DataFrame:
    """rows with the array out: the codes whose first six digits are in the client's scope, as (client, hs_scope, head) rows say; all of them for a client that no scope is given for."""
    final = settled(layers.filter("kind = 'hs_scope'"))
    heads = lambda given: F.collect_set(F.when(F.col("value").isNotNull() if given else F.col("value").isNull(), F.col("key")))
    # heads are six digits: however many rows there are, a client's sets are no longer than the tariff
    own = final.filter("client is not null").groupBy("client").agg(heads(True).alias("in"), heads(False).alias("gone")).select(F.struct("*").alias("own_"))
    shared = [r["key"] for r in final.filter("client is null and value is not null").select("key").distinct().collect()]
    everyone = F.lit(shared) if shared else F.array().cast("array<string>")
    small = own.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    met = _meet(rows, own, F.col("own_.client") == F.col(client), small)

    def ours(code: Column) -> Column:
        head = F.substring(code, 1, 6)
        own_one = F.coalesce(F.array_contains("own_.in", head), F.lit(False))
        taken = F.coalesce(F.array_contains("own_.gone", head), F.lit(False))
        return own_one | (~taken & F.array_contains(everyone, head))

    found = F.coalesce(F.col(codes), F.array().cast("array<string>"))
    free = F.col("own_.client").isNull() & F.lit(not shared)
    return met.select(*rows.columns, F.when(free, found).otherwise(F.filter(found, ours)).alias(out))
