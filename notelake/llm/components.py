"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_table


WHOLE = ("tinyint", "smallint", "int", "bigint")


def name_of(doc_id, kind: str, key):
    """A text that sorts as the id (a whole number or a string; null after all others), then as key, 32 characters long: a node's name.

    The smallest name of a component tells the component's smallest id, so no join by component is needed."""
    body = F.lpad(F.hex(doc_id.cast("long").bitwiseXOR(F.lit("-9223372036854775808").cast("long"))), 16, "0") if kind in WHOLE else doc_id.cast("string")
    return F.when(doc_id.isNull(), F.concat(F.lit("1"), key)).otherwise(F.concat(F.lit("0"), body, key))


def id_of(name, kind: str):
    """The id in a name."""
    body = F.expr(f"substring({name}, 2, length({name}) - 33)")
    value = (F.conv(body, 16, 10).cast("decimal(20,0)") - F.lit("9223372036854775808").cast("decimal(20,0)")).cast(kind) if kind in WHOLE else body.cast(kind)
    return F.when(F.col(name).startswith("0"), value)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): root is the smallest node reachable. Only nodes that have a link to another node appear.

    Links are kept as edges from a larger to a smaller node. A large-star step points all larger neighbours of a node at
    the smallest of its neighbourhood, a small-star step does so with the smaller ones; after some rounds (their number
    grows with the logarithm of the size) only stars are left. Minima are aggregated before the shuffle and joined back,
    and a hub's edges, which meet its minimum in a join, are split there by adaptive execution; each round is cut off by a written
    table. Null ends are ignored.
    """
    u, v = F.col("u"), F.col("v")
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("u <> v").distinct()
    edges, before = as_table(edges, "links"), None
    while (now := tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())) != before:
        if not now[0]:
            break
        before = now
        both = edges.unionByName(edges.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(v.alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(v.alias("u"), F.col("m").alias("v")), F.struct(u, F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = as_table(small, "links")
    return edges.select(u.alias("node"), v.alias("root")).unionByName(edges.select(v.alias("node"), v.alias("root")).distinct())
