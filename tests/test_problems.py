"""The general problems' operators: brute force, ties, NULLs, empty tables, columns of clashing names."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import hierarchy, orphans, spikes
from cellweave.operators.components import components
from cellweave.operators.positions import with_positions, with_running_sums
from cellweave.session import scope

LINKS = "dataset_id STRING, parent BIGINT, child BIGINT"


def reach(links):
    below = {}
    for p, c in links:
        below.setdefault(p, set()).add(c)
    changed = True
    while changed:
        changed = False
        for p in below:
            more = set().union(*(below.get(c, set()) for c in below[p])) - below[p]
            if more:
                below[p] |= more
                changed = True
    return below


def random_links(seed, n):
    r = random.Random(seed)
    return sorted({("d" if r.random() < 0.7 else "e", r.randrange(1, n), r.randrange(1, n)) for _ in range(n)})


@pytest.mark.parametrize("seed,n,limit", [(4, 60, 0)])
def test_hierarchies_against_brute_force(spark, seed, n, limit):
    rows = random_links(seed, n) + [("f", 1, 2), ("f", 2, 3), ("f", 1, 4), ("f", 4, 3), ("g", 7, 7), ("g", 7, 8), *[("h", i, i % 9 + 1) for i in range(1, 10)], ("h", 3, 1), ("h", 50, 5)]
    links = spark.createDataFrame(rows, LINKS)
    nodes = spark.createDataFrame([("f", 99), ("z", 1), ("f", 2), (None, 3), ("f", None)], "dataset_id STRING, node INT")
    tree = {(r["dataset_id"], r["node"]): r for r in hierarchy.paths(links, nodes).collect()}
    flat = {(r["dataset_id"], r["node"]): (r["parent"], r["root"], r["depth"]) for r in hierarchy.depths(links, nodes).collect()}
    below_all = {}
    for r in hierarchy.descendants(links).collect():
        below_all.setdefault((r["dataset_id"], r["node"]), []).append(r["descendant"])
    members, back = (x.collect() for x in hierarchy.cycles_of(links, max_core=limit))
    cycle = {(r["dataset_id"], r["node"]): r["cycle"] for r in members}
    cut = {tuple(r) for r in back}
    assert len(cycle) == len(members) and cut <= set(rows)
    assert tree["f", 99]["path"] == [99] and tree["z", 1]["depth"] == 0 and len(tree) == len({(d, x) for d, p, c in rows for x in (p, c)} | {("f", 99), ("z", 1)})
    for d in {r[0] for r in rows}:
        own = [(p, c) for x, p, c in rows if x == d]
        below = reach(own)
        kept = reach([(p, c) for p, c in own if (d, p, c) not in cut])
        assert not any(x in kept[x] for x in kept)
        assert all(p in below[c] or p == c for x, p, c in cut if x == d)
        least = {}
        for p, c in own:
            least[c] = min(p, least.get(c, p))
        for node in {x for e in own for x in e}:
            r = tree[d, node]
            found = below_all.get((d, node), [])
            assert sorted(found) == sorted(below.get(node, set()))
            assert cycle.get((d, node)) == min((x for x in below.get(node, ()) if node in below.get(x, ())), default=None)
            path, seen = [node], {node}
            while path[0] in least and least[path[0]] not in seen:
                path.insert(0, least[path[0]])
                seen.add(path[0])
            if path[0] in least:
                assert r["path"] is None and r["root"] is None and r["depth"] is None
            else:
                assert r["path"] == path and r["root"] == path[0] and r["depth"] == len(path) - 1
            assert flat[d, node] == (least.get(node), r["root"], r["depth"])


def test_hierarchies_ignore_nulls_copies_and_take_empty_tables(spark):
    rows = [("d", 1, 2), ("d", 1, 2), ("d", None, 3), (None, 1, 2), ("d", 2, None)]
    links = spark.createDataFrame(rows, LINKS).withColumn("node", F.lit("x")).withColumn("part", F.lit(1))
    assert sorted((r["dataset_id"], r["node"], r["depth"]) for r in hierarchy.paths(links).collect()) == [("d", 1, 0), ("d", 2, 1)]
    assert [tuple(r) for r in hierarchy.descendants(links).collect()] == [("d", 1, 2)]
    none = spark.createDataFrame([], LINKS)
    assert hierarchy.paths(none).count() == hierarchy.descendants(none).count() == hierarchy.cycles_of(none)[0].count() == hierarchy.cycles_of(links)[1].count() == 0


def test_long_chain_and_long_cycle(spark):
    chain = spark.range(1, 50_000).select(F.lit("d").alias("dataset_id"), F.col("id").alias("parent"), (F.col("id") + 1).alias("child"))
    last = hierarchy.depths(chain).where("node = 50000").first()
    assert last["depth"] == 49_999 and last["root"] == 1
    with scope():
        ring = chain.where("parent < 2000").union(chain.where("parent = 1").select("dataset_id", F.lit(2000), F.lit(1)))
        members, back = hierarchy.cycles_of(ring, max_core=600)
        assert members.agg(F.count("*"), F.max("cycle")).first() == (2000, 1) and back.count() == 1


def test_lineage_links_leave_out_what_does_not_count(spark):
    d = spark.createDataFrame([("d", 5, 1, 2, None), ("d", 6, 0, 3, 4), ("d", 7, 2, -1, 5)], "dataset_id STRING, t_div INT, mother_track_id INT, d1_track_id INT, d2_track_id INT")
    c = spark.createDataFrame([("d", 2, 1), ("d", 9, None)], "dataset_id STRING, track_id INT, parent_id INT")
    assert sorted(tuple(r) for r in hierarchy.lineage_links(d, c).collect()) == [("d", 1, 2), ("d", 2, 5)]


def test_components_of_random_graph(spark):
    r = random.Random(5)
    edges = [(0, r.randrange(60), r.randrange(60)) for _ in range(45)] + [(1, 1, 2), (0, None, 3)]
    got = {(x["p"], x["node"]): x["component"] for x in components(spark.createDataFrame(edges, "p INT, a INT, b INT"), "p", "a", "b").collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for p, a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((find((p, a)), find((p, b))))
            parent[y] = x
    assert got == {x: find(x)[1] for x in list(parent)}


def test_positions_and_running_sums(spark):
    r = random.Random(1)
    rows = [("hot" if r.random() < 0.8 else r.choice("abc") if r.random() < 0.9 else None, i, r.randrange(9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g STRING, i INT, v BIGINT").repartition(7)
    got = with_positions(df, ["g"], [F.col("i")]).collect()
    sums = with_running_sums(df, "g", [F.col("i")], "v").collect()
    place, total = {}, {}
    for g, i, v in sorted(rows, key=lambda x: x[1]):
        place[g, i], total[g, i] = sum(1 for a, b, _ in place_rows(rows, g) if b < i), sum(c for a, b, c in place_rows(rows, g) if b < i)
        if i > 400:
            break
    assert all(x["pos"] == place[x["g"], x["i"]] for x in got if (x["g"], x["i"]) in place)
    assert all(x["before"] == total[x["g"], x["i"]] for x in sums if (x["g"], x["i"]) in total)
    assert {x["g"]: x["before_total"] for x in sums} == {g: sum(c for _, _, c in place_rows(rows, g)) for g in {x[0] for x in rows}}


def place_rows(rows, g):
    return [x for x in rows if x[0] == g]


DIV = "dataset_id STRING, t_div INT, mother_track_id INT, d1_track_id INT, d2_track_id INT, loaded_at TIMESTAMP_NTZ, state STRING"
TRK = "dataset_id STRING, track_id INT, loaded_at TIMESTAMP_NTZ, period INT"
REM = "dataset_id STRING, track_id INT, removed_at TIMESTAMP_NTZ"


def day(n):
    return dt.datetime(2021, 1, 1) + dt.timedelta(days=n)


def test_orphans_of_every_state(spark):
    d = [
        ("d", 1, 1, 2, 3, day(50), "x"), ("d", 1, 1, 2, 3, day(10), "x"), ("d", 2, 1, 4, None, day(10), "x"), ("d", 3, 1, -5, 0, day(10), "x"), ("d", 4, 1, 6, 7, day(10), "x"),
        ("d", 5, 1, 8, 9, None, "x"), (None, 6, 1, 2, None, day(10), "x"), ("other", 7, 1, 2, None, day(90), "x"), ("d", 8, None, 70000, None, day(10), "x"),
    ]
    t = [("d", 2, day(1), 0), ("d", 3, day(20), 0), ("d", 6, day(3), 0), ("d", 7, day(3), 0), ("d", 7, day(40), 0), ("d", 8, day(90), 0), ("d", 70000, day(9), 0), ("d", None, day(1), 0), (None, 2, day(1), 0)]
    r = [("d", 4, day(5)), ("d", 6, day(5)), ("d", 7, day(6)), ("d", 3, None), ("d", 8, day(1))]
    refs = orphans.division_references(spark.createDataFrame(d, DIV))
    states = orphans.track_states(spark.createDataFrame(t, TRK), spark.createDataFrame(r, REM))
    got = sorted(((x["dataset_id"] or ""), x["t_div"], x["ref_field"][:2], x["ref_track_id"], x["state"]) for x in orphans.orphan_references(refs, states).collect())
    assert got == [
        ("", 6, "d1", 2, "missing"), ("d", 1, "d2", 3, "late"), ("d", 2, "d1", 4, "deleted"), ("d", 3, "d1", -5, "missing"), ("d", 3, "d2", 0, "missing"), ("d", 4, "d1", 6, "deleted"),
        ("d", 5, "d2", 9, "missing"), ("other", 7, "d1", 2, "missing"),
    ]
    empty = orphans.orphan_references(orphans.division_references(spark.createDataFrame([], DIV)), states)
    assert empty.count() == 0
    nothing = orphans.orphan_references(refs, orphans.track_states(spark.createDataFrame([], TRK), spark.createDataFrame([], REM)))
    assert {x["state"] for x in nothing.collect()} == {"missing"}


def test_packed_bitmaps_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 4096, 4097, 30000):
        low = rng.choice(1 << 16, n, replace=False)
        assert np.array_equal(np.flatnonzero(orphans.bits_of(orphans.pack(low))), np.sort(low))


FLAGS = "dataset_id STRING, kind STRING, t INT, src_track_id INT, length_before DOUBLE, length_after DOUBLE, drop_frac DOUBLE, pos INT, block STRING"


def make_flags(n=600, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for t in range(n):
        before = float(np.round(40 * np.exp(rng.normal(0, 0.06) + 0.3 * np.sin(t / 150)), 2))
        kind, drop = ("a", 0.46) if rng.random() < 0.6 else ("b", 0.05)
        after = float(np.round(before * (1 - drop - rng.normal(0, 0.02)), 2))
        rows.append(["s", kind, t, 1, before, after, round(1 - after / before, 4), 0, "x"])
    return rows


@pytest.mark.parametrize("block,margin", [(8192, 512), (64, 128)])
def test_readings_far_off_stuck_and_impossible(spark, block, margin):
    rows = make_flags()
    wrong = {50: (4, 120.0), 120: (5, -9999.0), 200: (6, 0.9 + 0.2), 260: (4, float("nan")), 330: (6, float("inf"))}
    for t, (c, v) in wrong.items():
        rows[t][c] = v
    rows[400][5] = rows[400][4] * 3
    rows[400][6] = round(1 - rows[400][5] / rows[400][4], 4)
    for t in range(500, 515):
        rows[t][4] = 41.5
        rows[t][6] = round(1 - rows[t][5] / 41.5, 4)
    rows[20][6] = None
    df = spark.createDataFrame([tuple(r) for r in rows + rows[:30]], FLAGS)
    got = {r["t"] for r in spikes.implausible_readings(df, block=block, margin=margin).collect()}
    assert got == set(wrong) | {400} | set(range(500, 515))
    assert spikes.implausible_readings(spark.createDataFrame([], FLAGS)).count() == 0
    nulls = spark.createDataFrame([(None, None, 1, 1, None, None, None, 0, "x"), ("s", None, None, None, 1.0, None, None, 0, "x")], FLAGS)
    assert spikes.implausible_readings(nulls).count() == 0


def test_still_runs_are_those_without_innovations():
    x = np.r_[np.arange(50), np.full(7, 3.5), np.arange(50), np.nan, np.nan]
    assert (spikes.still_runs(x, np.array([0])) == np.r_[np.ones(50), np.full(7, 7), np.ones(50), 0, 0]).all()
    assert spikes.still_runs(x, np.array([0, 53]))[[52, 53]].tolist() == [3, 4]


def test_runs_that_chance_explains_are_not_stuck(spark):
    least = spark.createDataFrame([(600, 0, 600), (600, 300, 600), (60_000, 300, 600)], "n INT, e INT, k INT").select(spikes.windows(F.col("n"), F.col("e"), F.col("k")).alias("w"))
    assert [r["w"] for r in least.collect()] == [6, 14, 21]


def test_one_long_source_is_judged_alike_in_blocks_of_any_size(spark):
    rows = make_flags(20_000, 7)
    for t in range(77, 20_000, 611):
        rows[t][4 + t % 2] *= 2.6
        rows[t][6] = round(1 - rows[t][5] / rows[t][4], 4)
    for t in range(9_990, 10_020):
        rows[t][4] = 44.25
        rows[t][6] = round(1 - rows[t][5] / 44.25, 4)
    df = spark.createDataFrame([tuple(r) for r in rows], FLAGS)
    found = [{r["t"] for r in spikes.implausible_readings(df, block=b).collect()} for b in (64, 512, 1 << 20)]
    assert found[0] == found[1] == found[2] >= set(range(9_990, 10_020)) | {t for t in range(77, 20_000, 611)}
