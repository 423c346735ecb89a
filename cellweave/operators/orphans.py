"""References to records that don't exist: dictionary-encoded keys, compressed bitmaps per key range and period, AND NOT, decode.

A key is one BIGINT: the dataset's place in a sorted dictionary, then the id. Its upper bits name a range of 65,536 keys. The
references of a period and the parents that are alive and were loaded in it become one bitmap per range and period, packed as
16-bit numbers while sparse and as bits once dense. Within a range, a period's references AND NOT the parents of all earlier periods
leave the references that may be dead; only those are decoded and compared by exact times.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.operators.positions import with_positions
from cellweave.session import Stored, small_side

#: Keys of a range.
RANGE_BITS = 16


def division_references(divisions: DataFrame) -> DataFrame:
    """(dataset_id, t_div, mother_track_id, ref_field, ref_track_id, loaded_at): a row per daughter named; copies of a division
    that differ in loaded_at only are one, loaded at the earliest."""
    keys = ["dataset_id", "t_div", "mother_track_id", "d1_track_id", "d2_track_id"]
    once = divisions.groupBy(*keys).agg(F.min("loaded_at").alias("loaded_at"))
    both = F.array(F.struct(F.lit("d1_track_id").alias("f"), F.col("d1_track_id").alias("r")), F.struct(F.lit("d2_track_id").alias("f"), F.col("d2_track_id").alias("r")))
    out = once.select("dataset_id", "t_div", "mother_track_id", F.explode(both).alias("x"), "loaded_at")
    return out.where("x.r IS NOT NULL").select("dataset_id", "t_div", "mother_track_id", F.col("x.f").alias("ref_field"), F.col("x.r").alias("ref_track_id"), "loaded_at")


def track_states(tracks: DataFrame, removed: DataFrame) -> DataFrame:
    """(dataset_id, track_id, first_loaded, last_loaded, last_removed, has_rows) of each track that has rows or was removed."""
    rows = tracks.select("dataset_id", "track_id", F.col("loaded_at").alias("l"), F.lit(None).cast("timestamp_ntz").alias("r"), F.lit(1).alias("n"))
    gone = removed.select("dataset_id", "track_id", F.lit(None).cast("timestamp_ntz"), F.col("removed_at"), F.lit(0))
    agg = rows.union(gone).groupBy("dataset_id", "track_id")
    return agg.agg(F.min("l").alias("first_loaded"), F.max("l").alias("last_loaded"), F.max("r").alias("last_removed"), (F.max("n") == 1).alias("has_rows"), F.bool_or(F.col("n") == 0).alias("listed"))


def _month(c: Column) -> Column:
    return F.coalesce(F.year(c) * 12 + F.month(c), F.lit(-1))


def pack(low: np.ndarray) -> bytes:
    """Sorted 16-bit numbers as a tag and the smaller of a list and 8 KB of bits."""
    low = np.unique(low).astype("<u2")
    if len(low) <= 4096:
        return b"l" + low.tobytes()
    bits = np.zeros(1 << RANGE_BITS, np.uint8)
    bits[low] = 1
    return b"b" + np.packbits(bits).tobytes()


def bits_of(packed: bytes) -> np.ndarray:
    if packed[:1] == b"b":
        return np.unpackbits(np.frombuffer(packed, np.uint8, offset=1)).astype(bool)
    out = np.zeros(1 << RANGE_BITS, bool)
    out[np.frombuffer(packed, "<u2", offset=1)] = True
    return out


def _bitmaps(keys: DataFrame) -> DataFrame:
    """keys(key, period) to (range, maps: [(period, packed)]); a range and period has 65,536 keys at most."""
    low = F.col("key").bitwiseAND((1 << RANGE_BITS) - 1).cast("int")
    sets = keys.groupBy(F.shiftright("key", RANGE_BITS).alias("range"), "period").agg(F.collect_set(low).alias("low"))

    def packed(batches):
        for pdf in batches:
            yield pd.DataFrame({"range": pdf["range"], "period": pdf["period"], "packed": [pack(np.asarray(x)) for x in pdf["low"]]})

    one = sets.mapInPandas(packed, "range BIGINT, period INT, packed BINARY")
    return one.groupBy("range").agg(F.sort_array(F.collect_list(F.struct("period", "packed"))).alias("maps"))


def _and_not(batches):
    for pdf in batches:
        keys, periods = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
        for rng, refs, parents in zip(pdf["range"], pdf["refs"], pdf["parents"]):
            parents = list(parents) if parents is not None else []
            alive, at = np.zeros(1 << RANGE_BITS, bool), 0
            for m in refs:
                while at < len(parents) and parents[at]["period"] < m["period"]:
                    alive |= bits_of(parents[at]["packed"])
                    at += 1
                left = np.flatnonzero(bits_of(m["packed"]) & ~alive)
                keys.append((np.int64(rng) << RANGE_BITS) + left)
                periods.append(np.full(len(left), m["period"], np.int32))
        yield pd.DataFrame({"key": np.concatenate(keys), "period": np.concatenate(periods)})


def orphan_references(references: DataFrame, states: DataFrame) -> DataFrame:
    """The dead references with their state: 'deleted', 'missing' or 'late' (see TESTDATA.md), each row once.

    references: as division_references gives them; states: as track_states gives them. A reference whose dataset_id is NULL matches
    no row and is 'missing'. NULL times are neither late nor removed. Negative ids and 0 are references like any other.
    """
    refs = Stored(references).df
    parents = Stored(states.where("dataset_id IS NOT NULL AND track_id IS NOT NULL")).df
    names = refs.select("dataset_id").union(parents.select("dataset_id")).where("dataset_id IS NOT NULL").distinct()
    codes = small_side(Stored(with_positions(names, [], [F.col("dataset_id")], "code")).df)

    def key(id_col: str) -> Column:
        return F.col("code") * (1 << 32) + F.col(id_col).cast("bigint") + (1 << 31)

    coded = Stored(refs.join(codes, "dataset_id", "left").withColumn("key", key("ref_track_id")).withColumn("period", _month(F.col("loaded_at"))).drop("code")).df
    known = parents.join(codes, "dataset_id").withColumn("key", key("track_id"))
    removed = F.col("listed") & (~F.col("has_rows") | (F.col("last_removed") > F.col("last_loaded")))
    known = Stored(known.withColumn("deleted", F.coalesce(removed, F.lit(False)))).df
    alive = known.where("has_rows AND NOT deleted").select("key", _month(F.col("first_loaded")).alias("period"))
    named = coded.where("key IS NOT NULL").select("key", "period")
    pairs = _bitmaps(named).withColumnRenamed("maps", "refs").join(_bitmaps(alive).withColumnRenamed("maps", "parents"), "range", "left")
    left = pairs.mapInPandas(_and_not, "key BIGINT, period INT")
    suspects = coded.join(left, ["key", "period"]).unionByName(coded.where("key IS NULL"))
    exact = known.select("key", "first_loaded", "has_rows", "deleted")
    state = F.when(F.col("deleted"), "deleted").when(~F.coalesce("has_rows", F.lit(False)), "missing").when(F.col("first_loaded") > F.col("loaded_at"), "late")
    out = suspects.join(exact, "key", "left").withColumn("state", state).where("state IS NOT NULL")
    return out.select("dataset_id", "t_div", "mother_track_id", "ref_field", "ref_track_id", "state", "loaded_at")


def orphan_counts(orphans: DataFrame, table: str = "gt_divisions") -> DataFrame:
    """(table_name, month, ref_field, state, n): the orphans per table and month of loaded_at."""
    month = F.date_format("loaded_at", "yyyy-MM").alias("month")
    return orphans.groupBy(F.lit(table).alias("table_name"), month, "ref_field", "state").agg(F.count("*").alias("n"))
