"""Splits that keep related records together: hash-to-min components, then weighted rendezvous hashing of components.

Two entities of one record are linked. The links of all records that share a second entity (a pair_id) are contracted to a star on its
least first entity (dataset_id), so the graph has no more nodes than there are datasets, and hash-to-min settles it.
Every component then picks the split with the least -ln(hash)/share, from its own name and a fixed salt alone: records that come later
move no component that they don't join. Shares are met as closely as the components' sizes let them; a stored table of pins can put
named components, such as a few very large ones, where they are wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.operators.components import components
from cellweave.session import Stored, small_side

#: Salt of the hash; another one gives other splits.
SALT = 0


def entity_components(records: DataFrame, a: str = "dataset_id", b: str = "pair_id") -> DataFrame:
    """(entity, component) for every non-NULL value of `a`; values that share a value of `b` have one component, chains included."""
    seen = Stored(records.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL").distinct()).df
    linked = seen.where("b IS NOT NULL")
    least = linked.groupBy("b").agg(F.min("a").alias("least"), F.max("a").alias("most")).where("least <> most")
    star = linked.join(least, "b").select(F.lit(0).alias("part"), "a", "least").distinct()
    found = components(star, "part", "a", "least").select(F.col("node").alias("entity"), "component")
    every = seen.select(F.col("a").alias("entity")).distinct()
    return every.join(found, "entity", "left").select("entity", F.coalesce("component", "entity").alias("component"))


def joined_pairs(records: DataFrame, a: str = "dataset_id", b: str = "pair_id") -> DataFrame:
    """(a_a, a_b), first below second in byte order: different values of `a` in one component."""
    c = Stored(entity_components(records, a, b)).df
    size = c.groupBy("component").count().where("count > 1").drop("count")
    many = c.join(size, "component")
    other = many.select(F.col("component").alias("oc"), F.col("entity").alias("oe"))
    both = many.join(other, (F.col("component") == F.col("oc")) & (F.col("entity") < F.col("oe")))
    return both.select(F.col("entity").alias(f"{a}_a"), F.col("oe").alias(f"{a}_b"))


def rendezvous(component: Column, salt: Column, splits: list[tuple[str, float]]) -> Column:
    """The split with the least -ln(u)/share, u in (0, 1) hashed from salt, component and split."""
    def cost(name: str, share: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(salt, component, F.lit(name)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((-F.log(u) / F.lit(float(share))).alias("c"), F.lit(name).alias("s"))

    return F.array_min(F.array(*[cost(n, w) for n, w in splits]))["s"]


def split_records(records: DataFrame, shares: list[tuple[str, float]], a: str = "dataset_id", b: str = "pair_id", salt: int = SALT, pins: DataFrame | None = None) -> DataFrame:
    """records plus `component` and `split_name`, in place of columns of that name. Records that share `a` or `b`, directly or through others, have one split.

    NULL joins nothing: a record without `a` belongs to the component of its `b`, one without both is a component by its
    content, so copies stay together. shares: (name, share), share > 0. Ties of a hash go to the name first in order. pins(component, split_name):
    components whose split is given; of two pins of one component the lesser name counts. Splits depend on component, shares, salt and pins
    only; a component is named by its least `a`, so it moves only if it is joined to one with a lesser name.
    """
    splits = sorted((n, s) for n, s in shares if s and s > 0)
    if not splits:
        raise ValueError("no split has a share")
    rows = records.drop("component", "split_name")
    of_a = Stored(entity_components(rows, a, b)).df
    links = rows.select(F.col(a).alias("_cw_a"), F.col(b).alias("_cw_b")).where("_cw_b IS NOT NULL").groupBy("_cw_b").agg(F.min("_cw_a").alias("_cw_a"))
    joined = links.join(of_a, F.col("_cw_a") == F.col("entity"), "left")
    of_b = Stored(joined.select("_cw_b", F.coalesce(F.concat(F.lit("a:"), F.col("component").cast("string")), F.concat(F.lit("b:"), F.col("_cw_b").cast("string"))).alias("_cw_component"))).df
    named = small_side(of_a.select(F.col("entity").alias("_cw_entity"), F.concat(F.lit("a:"), F.col("component").cast("string")).alias("_cw_component")))
    own = F.concat(F.lit("r:"), F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in rows.columns]).cast("string"))
    with_a = rows.where(F.col(a).isNotNull()).join(named, F.col(a) == F.col("_cw_entity"), "left").drop("_cw_entity").withColumnRenamed("_cw_component", "component")
    without = rows.where(F.col(a).isNull()).join(of_b, F.col(b) == F.col("_cw_b"), "left")
    without = without.withColumn("component", F.coalesce("_cw_component", own)).drop("_cw_b", "_cw_component")
    out = with_a.unionByName(without).withColumn("split_name", rendezvous(F.col("component"), F.lit(salt), splits))
    if pins is None:
        return out
    given = small_side(Stored(pins.groupBy(F.col("component").alias("_cw_pin")).agg(F.min("split_name").alias("_cw_split"))).df)
    return out.join(given, F.col("component") == F.col("_cw_pin"), "left").withColumn("split_name", F.coalesce("_cw_split", "split_name")).drop("_cw_pin", "_cw_split")
