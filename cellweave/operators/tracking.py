"""From label images to lineages: cells, frame pairs, candidate operations, features, true operations, tracks.

Pixels and cells are grouped by Spark; a pair of frames is one row that holds the cells of both, so the K-best search runs on
Arrow batches of pairs inside map tasks. Tracks are the connected components of the chosen links over all frames of a dataset, numbered by exact positions, so
no task walks through a whole movie.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions import ops
from cellweave.functions.costs import EPS, FORBIDDEN, TrackerParams, divide_cost, exits_cost, link_cost
from cellweave.operators.positions import with_positions
from cellweave.session import Stored, small_side

CELL = "struct<label:int,x:double,y:double,area:double,length:double,border:boolean>"


def cells_from_frames(frames: DataFrame) -> DataFrame:
    """frames(dataset_id, t, height, width, pixels: row-major 32-bit labels) to one row per cell: centroid, area, box with exclusive
    upper ends. Label 0 is background; a frame without cells has no rows."""

    def run(batches):
        for pdf in batches:
            out = []
            for d, t, h, w, raw in zip(pdf["dataset_id"], pdf["t"], pdf["height"], pdf["width"], pdf["pixels"]):
                image = np.frombuffer(raw, "<u4").reshape(h, w)
                r, c = np.nonzero(image)
                label, at = np.unique(image[r, c], return_inverse=True)
                n = np.bincount(at)
                lo_r, lo_c, hi_r, hi_c = (np.full(len(label), v) for v in (h, w, -1, -1))
                np.minimum.at(lo_r, at, r), np.minimum.at(lo_c, at, c), np.maximum.at(hi_r, at, r), np.maximum.at(hi_c, at, c)
                out.append(pd.DataFrame({
                    "dataset_id": d, "t": t, "label": label.astype(np.int64), "x": np.bincount(at, c) / np.maximum(n, 1), "y": np.bincount(at, r) / np.maximum(n, 1), "area": n.astype(float),
                    "bbox_minr": lo_r, "bbox_minc": lo_c, "bbox_maxr": hi_r + 1, "bbox_maxc": hi_c + 1,
                }))
            yield pd.concat(out) if out else pd.DataFrame(columns=["dataset_id", "t", "label", "x", "y", "area", "bbox_minr", "bbox_minc", "bbox_maxr", "bbox_maxc"])

    return frames.mapInPandas(run, "dataset_id STRING, t INT, label INT, x DOUBLE, y DOUBLE, area DOUBLE, bbox_minr INT, bbox_minc INT, bbox_maxr INT, bbox_maxc INT")


def frame_arrays(cells: DataFrame, params: TrackerParams) -> DataFrame:
    """(dataset_id, t, cells): a frame's cells as an array, from the open end on, ties by label. cells has label, x, y, area, length and
    border (whether the cell touches the open end)."""
    pos = F.col(params.axis)
    key = F.when(F.lit(params.open_end == "high"), -pos).otherwise(pos)
    item = F.struct(key.alias("k"), "label", F.struct(F.col("label").cast("int").alias("label"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "area", "length")], F.col("border")).alias("c"))
    packed = cells.groupBy("dataset_id", "t").agg(F.array_sort(F.collect_list(item)).alias("a"))
    return packed.select("dataset_id", "t", F.transform("a", lambda x: x["c"]).alias("cells"))


def frame_pairs(arrays: DataFrame, delta: int = 1) -> DataFrame:
    """(dataset_id, pair_id, t, delta_t, a, b): each frame with the one `delta` later."""
    later = arrays.select("dataset_id", (F.col("t") - delta).alias("t"), F.col("cells").alias("b"))
    pair_id = F.concat("dataset_id", F.lit(":"), F.col("t").cast("string"), F.lit("->"), (F.col("t") + delta).cast("string"))
    return arrays.join(later, ["dataset_id", "t"]).select("dataset_id", pair_id.alias("pair_id"), "t", F.lit(delta).alias("delta_t"), F.col("cells").alias("a"), "b")


def _costs(a: dict, b: dict, p: TrackerParams) -> tuple[np.ndarray, np.ndarray]:
    """Cost of linking i to j, and of dividing i into j and j + 1, of many pairs with the same numbers of cells. a, b: arrays (pair, cell) of
    x, y, area, length and border. What can't be told, for want of a position or an area, counts as forbidden."""
    pos_a, pos_b = a[p.axis][:, :, None], b[p.axis][:, None, :]
    mother, area_b = a["area"][:, :, None], b["area"][:, None, :]
    len_a, len_b = a["length"][:, :, None], b["length"][:, None, :]
    weight = np.full(b["area"].shape, p.wshrink)
    weight[:, :1][b["border"][:, :1]] = p.wshrink_border
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        ratio = (area_b + EPS) / (mother + EPS)
        shrink = np.maximum(0.0, 1 - ratio - p.shrink_tol)
        shift = np.abs(pos_a - pos_b)
        link = p.wy * shift + p.wa * np.abs(np.log(ratio)) + weight[:, None, :] * shrink
        d1, d2 = area_b[..., :-1], area_b[..., 1:]
        divide = p.c_div0 + p.wy * (shift[..., :-1] + shift[..., 1:]) + p.wa * np.abs(mother - (d1 + d2)) / np.maximum(mother, 1.0) + p.wsym * np.abs(d1 - d2) / (d1 + d2 + EPS)
        divide = divide - p.w_divshrink * (shrink[..., :-1] + shrink[..., 1:])
        barred = (d1 + d2 > (1 + p.sum_area_tol) * mother) | (np.maximum(d1, d2) > (1 + p.max_area_tol) * mother)
        barred |= (len_b[..., :-1] + len_b[..., 1:] > (1 + p.sum_len_tol) * len_a) | (np.maximum(len_b[..., :-1], len_b[..., 1:]) > (1 + p.max_len_tol) * len_a)
    return np.where(np.isfinite(link), link, FORBIDDEN), np.where(barred | ~np.isfinite(divide), FORBIDDEN, divide)


def _cheapest(link: np.ndarray, divide: np.ndarray, p: TrackerParams, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(costs (pair, rank), kinds (pair, rank, source)) of the k cheapest sequences of each pair, from the open end: 0 exit, 1 link,
    2 divide, which is also how many targets each takes. A cost is infinite where a pair has fewer sequences.

    After each source and for each number of targets taken, the k cheapest ways there. Exits come first, so that no target taken means
    exits only. Equal costs keep the order of the way before: fewer targets first, then its rank.
    """
    pairs, n, m = link.shape
    cost = np.full((pairs, m + 1, k), np.inf)
    cost[:, 0, 0] = 0
    came = np.zeros((n, pairs, m + 1, k), np.int32)  # rank of the way before; k and more where the step is a link
    for i in range(n):
        both = np.full((pairs, m + 1, 2 * k), np.inf)
        both[:, 2:, :k] = cost[:, : max(m - 1, 0)] + divide[:, i, :, None]
        both[:, 1:, k:] = cost[:, :m] + link[:, i, :, None]
        came[i] = np.argsort(both, axis=2, kind="stable")[..., :k]
        exits = cost[:, 0, 0] + p.exit_lin + p.exit_quad * (2 * i + 1)
        cost = np.take_along_axis(both, came[i], 2)
        cost[:, 0, 0] = exits
    kinds = np.zeros((pairs, k, n), np.int8)
    row, at, rank = np.arange(pairs)[:, None], np.full((pairs, k), m), np.tile(np.arange(k), (pairs, 1))
    for i in reversed(range(n)):
        before = came[i][row, at, rank]
        kinds[:, :, i] = np.where(at == 0, 0, np.where(before < k, 2, 1))
        rank = np.where(at == 0, 0, before % k)
        at = np.maximum(at - kinds[:, :, i], 0)
    return cost[:, m], kinds


def _pair_costs(a, b, p: TrackerParams) -> tuple[np.ndarray, np.ndarray]:
    """The costs of one pair of lists of cells."""

    def side(cells) -> dict:
        floats = {c: np.array([[np.nan if x[c] is None else x[c] for x in cells]], float) for c in ("x", "y", "area", "length")}
        return floats | {"border": np.array([[bool(x["border"]) for x in cells]], bool)}

    link, divide = _costs(side(a), side(b), p)
    return link[0], divide[0]


def k_best(a, b, p: TrackerParams, k: int) -> list[tuple[float, str]]:
    """The k cheapest sequences that explain a pair of lists of cells: (cost, steps), steps a letter per source cell from the open end."""
    if len(b) > 2 * len(a):
        return []
    link, divide = _pair_costs(a, b, p)
    cost, kinds = _cheapest(link[None], divide[None], p, k)
    return [(float(c), "".join("eld"[x] for x in kind)) for c, kind in zip(cost[0], kinds[0]) if np.isfinite(c)]


CANDIDATE = f"dataset_id STRING, pair_id STRING, t INT, delta_t INT, sample_rank INT, dp_cost DOUBLE, n_candidates_pair INT, ops ARRAY<{ops.OP}>"
_OP = pa.struct([("kind", pa.string()), ("src", pa.int32()), ("dst1", pa.int32()), ("dst2", pa.int32())])


#: Ways kept at a time while pairs are solved together (sources x pairs x targets x k); a larger pair is solved alone.
MAX_WAYS = 1 << 21


class _Side:
    """One frame of all pairs of a batch: the cells in a row, where each pair's begin, and how many there are."""

    def __init__(self, column: pa.ListArray):
        cells = column.flatten()
        self.count = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.start = np.cumsum(self.count) - self.count
        self.label = pc.struct_field(cells, "label")
        self._values = {c: pc.struct_field(cells, c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y", "area", "length")}
        self._values["border"] = pc.fill_null(pc.struct_field(cells, "border"), False).to_numpy(zero_copy_only=False).astype(bool)

    def of(self, rows: np.ndarray, n: int) -> dict:
        at = self.start[rows][:, None] + np.arange(n)
        return {c: v[at] for c, v in self._values.items()}


def generate_candidates(pairs: DataFrame, params: TrackerParams, top_k: int = 16) -> DataFrame:
    """A row per candidate, best first. A pair that can't be explained (more than two targets per source, or no sources) has no rows.

    Pairs of a batch that have the same numbers of cells are solved together, one source at a time, on arrays.
    """
    out = pa.schema([("dataset_id", pa.string()), ("pair_id", pa.string()), ("t", pa.int32()), ("delta_t", pa.int32()), ("sample_rank", pa.int32()), ("dp_cost", pa.float64()), ("n_candidates_pair", pa.int32()), ("ops", pa.list_(_OP))])

    def solved(batch: pa.RecordBatch, a: _Side, b: _Side, rows: np.ndarray, n: int, m: int) -> pa.RecordBatch:
        cost, kinds = _cheapest(*_costs(a.of(rows, n), b.of(rows, m), params), params, top_k)
        there = np.isfinite(cost)
        pair, rank = np.nonzero(there)
        kind = kinds[pair, rank]
        first = b.start[rows][pair][:, None] + np.cumsum(kind, axis=1) - kind
        src = a.start[rows][pair][:, None] + np.arange(n)
        flat = kind.ravel()
        names = pa.DictionaryArray.from_arrays(pa.array(flat), pa.array(["exit", "link", "divide"])).dictionary_decode()
        to = [b.label.take(pa.array(first.ravel() + k, pa.int64(), mask=flat <= k)) for k in (0, 1)]
        structs = pa.StructArray.from_arrays([names, a.label.take(pa.array(src.ravel(), pa.int64())), *to], fields=list(_OP))
        ops_ = pa.ListArray.from_arrays(pa.array(np.arange(len(pair) + 1) * n, pa.int32()), structs)
        own = pa.array(rows[pair], pa.int64())
        columns = [*(batch.column(c).take(own) for c in ("dataset_id", "pair_id", "t", "delta_t")), pa.array(rank + 1, pa.int32()), pa.array(cost[pair, rank]), pa.array(there.sum(axis=1)[pair], pa.int32()), ops_]
        return pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, out)], schema=out)

    def run(batches):
        for batch in batches:
            a, b = _Side(batch.column("a")), _Side(batch.column("b"))
            sizes, group = np.unique(np.stack([a.count, b.count], axis=1), axis=0, return_inverse=True)
            for g, (n, m) in enumerate(sizes.tolist()):
                if m > 2 * n:
                    continue
                rows, step = np.flatnonzero(group.ravel() == g), max(1, MAX_WAYS // ((n + 2) * (m + 1) * top_k))
                for i in range(0, len(rows), step):
                    yield solved(batch, a, b, rows[i : i + step], n, m)

    made = pairs.select("dataset_id", "pair_id", "t", "delta_t", "a", "b").mapInArrow(run, CANDIDATE)
    return made.withColumn("is_dpt_best", F.col("sample_rank") == 1).withColumn("ops_json", ops.format_ops(F.col("ops")))


def count_candidates(n: int, m: int) -> int:
    """How many sequences explain n sources by m targets."""
    if n < 0 or m < 0:
        raise ValueError("numbers of cells can't be negative")
    return sum(math.comb(n - e, m - (n - e)) for e in range(n + 1) if 0 <= m - (n - e) <= n - e)


def enumerate_candidates(pairs: DataFrame, ceiling: int = 100_000) -> DataFrame:
    """(pair_id, steps) of every sequence, by growing all of them a source at a time. Pairs of more than `ceiling` sequences raise."""
    sized = pairs.select("pair_id", F.size("a").alias("n"), F.size("b").alias("m"))

    def check(batches):
        for pdf in batches:
            yield pd.DataFrame({"n": pdf["n"], "over": [count_candidates(n, m) > ceiling for n, m in zip(pdf["n"], pdf["m"])]})

    most, over = sized.select("n", "m").distinct().mapInPandas(check, "n INT, over BOOLEAN").agg(F.max("n"), F.bool_or("over")).first()
    if over:
        raise ValueError(f"a pair has more than {ceiling} candidates")
    grown = sized.select("pair_id", "n", "m", F.lit("").alias("steps"), F.lit(0).alias("j"))
    for i in range(most or 0):
        more = F.explode(F.filter(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(w).alias("w")) for s, w in (("e", 0), ("l", 1), ("d", 2))]), lambda x: ((x["s"] != "e") | F.col("steps").rlike("^e*$")) & (F.col("j") + x["w"] <= F.col("m"))))
        on = grown.where(F.col("n") > i).select("pair_id", "n", "m", "steps", "j", more.alias("x"))
        done = grown.where(F.col("n") <= i)
        step = on.select("pair_id", "n", "m", F.concat("steps", "x.s").alias("steps"), (F.col("j") + F.col("x.w")).alias("j"))
        grown = done.union(step.where(F.col("m") - F.col("j") <= 2 * (F.col("n") - i - 1)))
    return grown.where("j = m").select("pair_id", "steps")


def true_operations(tracks: DataFrame, divisions: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """(dataset_id, t, pair_id, ops): what became of every cell of frame t by frame t + 1: division if its track divides at t and both
    daughters are there, link if its track goes on, else exit. Cells come from the open end on (ends: dataset_id, open_end)."""
    here = tracks.select("dataset_id", "t", "track_id", "label", "y")
    nxt = tracks.select("dataset_id", (F.col("t") - 1).alias("t"), "track_id", F.col("label").alias("next_label"))
    c = here.join(nxt.groupBy("dataset_id", "t", "track_id").agg(F.min("next_label").alias("next_label")), ["dataset_id", "t", "track_id"], "left")
    d = divisions.select("dataset_id", F.col("t_div").alias("t"), F.col("mother_track_id").alias("track_id"), "d1_track_id", "d2_track_id")
    c = c.join(d, ["dataset_id", "t", "track_id"], "left")
    for k in ("d1", "d2"):
        born = nxt.groupBy("dataset_id", "t", F.col("track_id").alias(f"{k}_track_id")).agg(F.min("next_label").alias(f"{k}_label"))
        c = c.join(born, ["dataset_id", "t", f"{k}_track_id"], "left")
    high = F.lit(False)
    if ends is not None:
        c = c.join(ends.select("dataset_id", "open_end"), "dataset_id", "left")
        high = F.coalesce(F.col("open_end") == "high", F.lit(False))
    divided = F.col("d1_label").isNotNull() & F.col("d2_label").isNotNull()
    kind = F.when(divided, "divide").when(F.col("next_label").isNotNull(), "link").otherwise("exit")
    first = F.when(divided, F.col("d1_label")).when(kind == "link", F.col("next_label"))
    op = F.struct(kind.alias("kind"), F.col("label").cast("int").alias("src"), first.cast("int").alias("dst1"), F.when(divided, F.col("d2_label")).cast("int").alias("dst2"))
    item = F.struct(F.when(high, -F.col("y")).otherwise(F.col("y")).alias("k"), "label", op.alias("o"))
    packed = c.groupBy("dataset_id", "t").agg(F.array_sort(F.collect_list(item)).alias("a"))
    pair_id = F.concat("dataset_id", F.lit(":"), F.col("t").cast("string"), F.lit("->"), (F.col("t") + 1).cast("string"))
    return packed.select("dataset_id", "t", pair_id.alias("pair_id"), F.transform("a", lambda x: x["o"]).alias("ops"))


def mark_correct(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """candidates(pair_id, sample_rank, ops_json) plus is_correct, NULL where the pair has no truth (pair_id, ops)."""
    t = truth.select("pair_id", ops.canonical(F.col("ops")).alias("_true"))
    marked = candidates.join(t, "pair_id", "left")
    return marked.withColumn("is_correct", ops.canonical(ops.parse("ops_json")) == F.col("_true")).drop("_true")


def missing_truth(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """The true operations of pairs of which no candidate has them, to be added as candidates."""
    have = candidates.select("pair_id", ops.canonical(ops.parse("ops_json")).alias("key")).distinct()
    t = truth.withColumn("key", ops.canonical(F.col("ops")))
    known = candidates.select("pair_id").distinct()
    return t.join(known, "pair_id", "left_semi").join(have, ["pair_id", "key"], "left_anti").select("pair_id", ops.format_ops(F.col("ops")).alias("ops_json"))


def operation_costs(truth: DataFrame, cells: DataFrame, params: TrackerParams) -> DataFrame:
    """(dataset_id, t, kind, src, cost) of links and divisions, from areas and positions of cells(dataset_id, t, label, <axis>, area)."""
    o = truth.select("dataset_id", "t", F.explode("ops").alias("o")).select("dataset_id", "t", "o.*")

    def side(name: str, shift: int) -> DataFrame:
        return cells.select("dataset_id", (F.col("t") - shift).alias("t"), F.col("label").alias(name), F.struct(F.col(params.axis).alias("p"), "area").alias(f"_{name}"))

    j = o.join(side("src", 0), ["dataset_id", "t", "src"]).join(side("dst1", 1), ["dataset_id", "t", "dst1"]).join(side("dst2", 1), ["dataset_id", "t", "dst2"], "left")
    s, a, b = F.col("_src"), F.col("_dst1"), F.col("_dst2")
    cost = F.when(F.col("kind") == "link", link_cost(params, s["p"] - a["p"], s["area"], a["area"])).when(F.col("kind") == "divide", divide_cost(params, s["p"] - a["p"], s["p"] - b["p"], s["area"], a["area"], b["area"]))
    return j.select("dataset_id", "t", "kind", "src", cost.alias("cost")).where("cost IS NOT NULL")


def _frames(cells: DataFrame, t: str, name: str) -> DataFrame:
    """(dataset_id, t, <name>, <name>_area): a frame's cells as a map by label, and their areas together. Of the cells of a label that stands
    twice in a frame, the map has the one with the least y."""
    border = F.coalesce("border", F.lit(False)) if "border" in cells.columns else F.lit(False)
    item = F.struct(F.col("label").cast("int").alias("label"), F.col("y").cast("double").alias("y"), F.col("area").cast("double").alias("area"), border.alias("border"))
    packed = cells.groupBy("dataset_id", F.col("t").alias(t)).agg(F.array_sort(F.collect_list(F.when(F.col("label").isNotNull(), item))).alias("_a"), F.sum("area").alias(f"{name}_area"))
    once = F.filter("_a", lambda x, i: (i == 0) | (F.get(F.col("_a"), i - 1)["label"] != x["label"]))
    entries = F.transform(once, lambda x: F.struct(x["label"], F.struct(x["y"], x["area"], x["border"])))
    return packed.select("dataset_id", t, F.map_from_entries(entries).alias(name), f"{name}_area")


def operation_features(truth: DataFrame, cells: DataFrame, heights: DataFrame) -> DataFrame:
    """Per pair, or per candidate where there is a sample_rank, the features that need no masks: areas, area ratios, shifts of links and divisions and distances of exits
    in relation to the frame's height. truth: (dataset_id, t, pair_id, ops[, sample_rank, delta_t]), one row for each of these keys; heights: (dataset_id, height[, open_end]), the
    distance from the open end being y but where open_end is "high". A group without members gives NULL, max_shrink_pct then 0; links that touch the open end (border) don't count for it.
    Operations of cells that their frame doesn't have don't count, nor do areas that aren't known, and a row without others doesn't come out.

    A row's operations stay together: the two frames' cells come to them as maps, by two joins, so that neither operations nor their cells are rows of a shuffle.
    """
    key = ["dataset_id", "t", "pair_id", *[c for c in ("sample_rank",) if c in truth.columns]]
    delta = F.col("delta_t") if "delta_t" in truth.columns else F.lit(1)
    high = F.coalesce(F.col("open_end") == "high", F.lit(False)) if "open_end" in heights.columns else F.lit(False)
    ends = small_side(Stored(heights.select("dataset_id", F.col("height").alias("_height"), high.alias("_high"))).df)
    here = _frames(cells, "t", "_here").join(ends, "dataset_id")
    rows = truth.select(*key, (F.col("t") + delta).alias("_k"), "ops").join(here, ["dataset_id", "t"]).join(_frames(cells, "_k", "_there"), ["dataset_id", "_k"], "left")

    def cell(of: str, label: Column) -> Column:
        return F.try_element_at(F.col(of), label)

    placed = F.transform("ops", lambda o: F.struct(o["kind"].alias("kind"), cell("_here", o["src"]).alias("s"), cell("_there", o["dst1"]).alias("a"), cell("_there", o["dst2"]).alias("b")))
    rows = rows.withColumn("_o", F.filter(placed, lambda o: o["s"].isNotNull())).where(F.size("_o") > 0)
    h = F.col("_height")

    def ratio(x: Column, y: Column) -> Column:
        return F.when(x.isNotNull() & y.isNotNull(), F.greatest(x, y) / F.greatest(F.least(x, y), F.lit(EPS)))  # greatest passes over NULL

    def each(kind: str, f: Callable[[Column, Column, Column], Column]) -> Column:
        return F.array_compact(F.transform(F.filter("_o", lambda o: o["kind"] == kind), lambda o: f(o["s"], o["a"], o["b"])))

    def shift(x: Column, y: Column) -> Column:
        return F.abs(y["y"] - x["y"]) / h

    rows = rows.select(
        *key, "_here_area", "_there_area",
        each("link", lambda s, a, b: ratio(s["area"], a["area"])).alias("_lr"), each("link", lambda s, a, b: shift(s, a)).alias("_ld"),
        each("link", lambda s, a, b: F.when(~(s["border"] | a["border"]), 100 * F.greatest(F.lit(0.0), 1 - (a["area"] + EPS) / (s["area"] + EPS)))).alias("_shrink"),
        each("divide", lambda s, a, b: ratio(s["area"], a["area"] + b["area"])).alias("_mr"), each("divide", lambda s, a, b: ratio(a["area"], b["area"])).alias("_dr"),
        each("divide", lambda s, a, b: F.greatest(shift(s, a), shift(s, b))).alias("_far"), each("divide", lambda s, a, b: shift(s, a) + shift(s, b)).alias("_both"),
        each("exit", lambda s, a, b: F.when(F.col("_high"), h - 1 - s["y"]).otherwise(s["y"]) / F.greatest(h, F.lit(1.0))).alias("_gone"), each("exit", lambda s, a, b: s["area"]).alias("_exits"),
    )

    def total(c: str) -> Column:
        return F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)

    def mean(c: str) -> Column:
        return F.when(F.size(c) > 0, total(c) / F.size(c))

    def median(c: str) -> Column:
        s, n = F.array_sort(c), F.size(c)
        return (F.get(s, ((n - 1) / 2).cast("int")) + F.get(s, (n / 2).cast("int"))) / 2

    adjusted = F.coalesce("_there_area", F.lit(0.0)) / F.greatest(F.coalesce("_here_area", F.lit(0.0)) - total("_exits"), F.lit(EPS))
    return rows.select(
        *key, F.coalesce(F.array_max("_shrink"), F.lit(0.0)).alias("max_shrink_pct"), median("_lr").alias("link_area_ratio_median"), F.array_max("_lr").alias("link_area_ratio_max"),
        median("_ld").alias("link_dy_median_norm"), F.array_max("_ld").alias("link_dy_max_norm"), F.array_max("_mr").alias("div_mother_sum_area_ratio_max"), mean("_mr").alias("div_mother_sum_area_ratio_mean"),
        F.array_max("_dr").alias("div_daughter_area_ratio_max"), mean("_dr").alias("div_daughter_area_ratio_mean"), F.array_max("_far").alias("div_mother_daughter_dy_max_norm"),
        (mean("_both") / 2).alias("div_mother_daughter_dy_mean_norm"), median("_gone").alias("exit_open_end_dist_median_norm"), adjusted.alias("total_area_ratio_exit_adjusted"),
    )


def _node(t: Column, label: Column) -> Column:
    return t.cast("bigint") * (1 << 31) + label


def chain_starts(joins: DataFrame) -> DataFrame:
    """(dataset_id, node, start) of joins(dataset_id, before, node): where each node's chain begins. Every round a node's pointer jumps
    to its target's target, so a chain of n nodes takes log2(n) rounds. A node that two lead to follows the lesser."""
    state = Stored(joins.groupBy("dataset_id", "node").agg(F.min("before").alias("start"))).df
    while True:
        onward = state.select("dataset_id", F.col("node").alias("start"), F.col("start").alias("_next"))
        jumped = Stored(state.join(onward, ["dataset_id", "start"], "left").select("dataset_id", "node", F.coalesce("_next", "start").alias("start"), F.col("_next").isNotNull().alias("_moved")))
        more = not jumped.df.where("_moved").isEmpty()
        state = jumped.df.drop("_moved")
        if not more:
            return state


def reconstruct(chosen: DataFrame, arrays: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tracks, events, divisions) from chosen(dataset_id, t, ops[, dst_t]) and the frames' cells (`frame_arrays`).

    A frame without chosen operations (no row, or ops NULL) breaks the lineage: at the next kept frame that no kept pair leads into, all its
    cells begin tracks. Ids are numbered per dataset by the frame in which they begin, then by the order of cells or
    operations, the daughters of a division together. An exit of a cell that has no track has track_id -1.
    """
    arrays = Stored(arrays).df
    kept = Stored(chosen.where("ops IS NOT NULL")).df
    dst_t = F.col("dst_t") if "dst_t" in chosen.columns else F.col("t") + 1
    pairs = Stored(kept.select("dataset_id", "t", dst_t.alias("dst_t"), F.posexplode("ops").alias("i", "o")).select("dataset_id", "t", "dst_t", "i", "o.*")).df
    to = F.explode(F.array_compact(F.array(F.when(F.col("dst1").isNotNull(), F.struct(F.col("dst1").alias("l"), F.lit(0).alias("k"))), F.when(F.col("dst2").isNotNull(), F.struct(F.col("dst2").alias("l"), F.lit(1).alias("k"))))))
    made = pairs.where("kind <> 'exit'").select("dataset_id", "t", "dst_t", "i", "kind", to.alias("x"))
    reached = Stored(made.select("dataset_id", F.col("dst_t").alias("t"), F.col("x.l").alias("label"), F.col("t").alias("from_t"), "i", "kind", F.col("x.k").alias("k"))).df
    frames = kept.select("dataset_id", "t").distinct().join(reached.select("dataset_id", "t").distinct(), ["dataset_id", "t"], "left_anti")
    fresh = arrays.join(frames, ["dataset_id", "t"]).select("dataset_id", "t", F.posexplode("cells").alias("i", "c")).select("dataset_id", "t", "i", F.col("c.label").alias("label"))
    # a track begins with a fresh cell, a daughter, or the target of a link whose source has no track
    have = fresh.select("dataset_id", "t", "label").union(reached.select("dataset_id", "t", "label")).distinct()
    sources = pairs.select("dataset_id", "t", "src", "kind", "i", "dst_t", "dst1").join(have.withColumnRenamed("label", "src"), ["dataset_id", "t", "src"], "left_anti")
    lost = sources.where("kind <> 'exit'").select("dataset_id", "t", F.col("src").alias("label"), "i", F.col("t").alias("from_t"))
    starts = (
        fresh.select("dataset_id", "t", "label", F.col("t").alias("o1"), F.lit(0).alias("o2"), "i", F.lit(0).alias("k"))
        .unionByName(reached.where("kind = 'divide'").select("dataset_id", "t", "label", F.col("from_t").alias("o1"), F.lit(1).alias("o2"), "i", "k"))
        .unionByName(lost.select("dataset_id", "t", "label", F.col("from_t").alias("o1"), F.lit(1).alias("o2"), "i", F.lit(-1).alias("k")))
    )
    numbered = with_positions(starts, ["dataset_id"], [F.col(c) for c in ("o1", "o2", "i", "k")], "_n")
    ids = Stored(numbered.select("dataset_id", _node(F.col("t"), F.col("label")).alias("node"), (F.col("_n") + 1).cast("int").alias("track_id"))).df
    joins = pairs.where("kind = 'link'").select("dataset_id", _node(F.col("t"), F.col("src")).alias("before"), _node(F.col("dst_t"), F.col("dst1")).alias("node"))
    of_chain = ids.withColumnRenamed("node", "start").withColumnRenamed("track_id", "_c")
    linked = chain_starts(joins).join(of_chain, ["dataset_id", "start"], "left").select("dataset_id", "node", "_c")
    nodes = have.union(lost.select("dataset_id", "t", "label")).distinct().withColumn("node", _node(F.col("t"), F.col("label")))
    track_of = nodes.join(linked, ["dataset_id", "node"], "left").join(ids, ["dataset_id", "node"], "left")
    track_of = Stored(track_of.select("dataset_id", "t", "label", F.coalesce("track_id", "_c").alias("track_id"))).df
    cells = arrays.select("dataset_id", "t", F.explode("cells").alias("c")).select("dataset_id", "t", "c.*")
    tracks = track_of.join(have, ["dataset_id", "t", "label"], "left_semi").join(cells, ["dataset_id", "t", "label"], "left")
    tracks = tracks.select("dataset_id", "track_id", "t", "label", "x", "y", "area", F.col("length").alias("axis_len"))
    by_source = track_of.select("dataset_id", "t", F.col("label").alias("src"), "track_id")
    events = pairs.join(by_source, ["dataset_id", "t", "src"], "left").select("dataset_id", "t", F.col("kind").alias("event"), F.col("src").alias("src_label"), F.col("dst1").alias("dst1_label"), F.col("dst2").alias("dst2_label"), F.coalesce("track_id", F.lit(-1)).alias("track_id"), "dst_t")
    born = track_of.select("dataset_id", F.col("t").alias("dst_t"), "label", "track_id")
    d = events.where("event = 'divide'")
    for k in ("dst1", "dst2"):
        d = d.join(born.withColumnRenamed("label", f"{k}_label").withColumnRenamed("track_id", f"_{k}"), ["dataset_id", "dst_t", f"{k}_label"], "left")
    divisions = d.select("dataset_id", F.col("t").alias("t_div"), F.col("track_id").alias("mother_track_id"), F.col("_dst1").alias("d1_track_id"), F.col("_dst2").alias("d2_track_id"))
    return tracks, events, divisions


def bridge_spans(decisions: DataFrame, spans: DataFrame, tau: float, max_gap: int) -> DataFrame:
    """(dataset_id, t_drop, t_a, t_b, score) of the span that would bridge each dropped pair: of the gaps from 2 on the first whose best
    span reaches tau, in it the best, the earliest of equals. spans: (dataset_id, t_a, t_b, score). Drops are judged side by side."""
    drops = decisions.where("action = 'DROP' AND drop_reason IN ('ANOMALY', 'DISAGREEMENT')").select("dataset_id", F.col("t").alias("t_drop")).distinct()
    # a span of gap d covers t_drop if it begins less than d before it: equal keys instead of a range
    near = drops.withColumn("back", F.explode(F.sequence(F.lit(0), F.lit(max_gap - 1)))).withColumn("t_a", F.col("t_drop") - F.col("back"))
    s = spans.where((F.col("t_b") - F.col("t_a")).between(2, max_gap) & F.col("score").isNotNull() & ~F.isnan("score"))
    hit = near.join(s, ["dataset_id", "t_a"]).where((F.col("t_a") <= F.col("t_drop")) & (F.col("t_drop") < F.col("t_b")) & (F.col("score") >= tau))
    best = hit.groupBy("dataset_id", "t_drop").agg(F.min(F.struct((F.col("t_b") - F.col("t_a")).alias("gap"), (-F.col("score")).alias("s"), "t_a", "t_b")).alias("x"))
    return best.select("dataset_id", "t_drop", "x.t_a", "x.t_b", (-F.col("x.s")).alias("score"))


def _considered(drops: DataFrame, max_gap: int) -> DataFrame:
    """Those of drops(dataset_id, t_drop, t_b) that are come to when drops are taken in order and one below the end of the span of an earlier one is
    passed over. Each drop points to the one that would be next; drops too far from the one before to be passed over are where chains begin, and
    the drops on chains are found by doubling."""
    placed = Stored(with_positions(drops, ["dataset_id"], [F.col("t_drop")], "pos")).df
    # a span ends less than max_gap after its drop, so equal keys do
    over = placed.where("t_b > t_drop + 1").select("dataset_id", "pos", F.explode(F.sequence(F.col("t_drop") + 1, F.col("t_b") - 1)).alias("t_drop"))
    passed = over.join(placed.select("dataset_id", "t_drop"), ["dataset_id", "t_drop"]).groupBy("dataset_id", "pos").agg(F.count("*").alias("_n"))
    before = placed.select("dataset_id", (F.col("pos") + 1).alias("pos"), F.col("t_drop").alias("_t"))
    heads = placed.join(before, ["dataset_id", "pos"], "left").where(F.col("_t").isNull() | (F.col("t_drop") - F.col("_t") >= max_gap))
    jump = Stored(placed.join(passed, ["dataset_id", "pos"], "left").select("dataset_id", "pos", (F.col("pos") + 1 + F.coalesce("_n", F.lit(0))).alias("to")))
    found = Stored(heads.select("dataset_id", "pos"))
    size = -1
    while (now := found.df.count()) != size:
        size = now
        more = found.df.join(jump.df, ["dataset_id", "pos"]).select("dataset_id", F.col("to").alias("pos")).join(placed.select("dataset_id", "pos"), ["dataset_id", "pos"], "left_semi")
        found = Stored(found.df.union(more).distinct())
        jump = Stored(jump.df.join(jump.df.select("dataset_id", F.col("pos").alias("to"), F.col("to").alias("_to")), ["dataset_id", "to"]).select("dataset_id", "pos", F.col("_to").alias("to")))
    return placed.join(found.df, ["dataset_id", "pos"], "left_semi").drop("pos")


def bridge_drops(decisions: DataFrame, spans: DataFrame, tau: float, max_gap: int, reasons: Sequence[str] = ("ANOMALY",)) -> DataFrame:
    """Decisions with their drops bridged where a span reaches tau: pairs under a span become BRIDGE, the one at its start primary with the span's
    operations; other drops of these reasons become BRIDGE_FAILED, the rest stays.

    decisions: (dataset_id, t, action, drop_reason, ...), one for each frame; spans: (dataset_id, t_a, t_b, score, ops_json). Drops are taken in
    order of time, those under an earlier drop's span are passed over; of a drop's spans the shortest that reach tau count, of these the best,
    of equals the earliest. Of two accepted spans over a pair the first counts, of two from one frame the later.
    """
    eligible = (F.col("action") == "DROP") & F.coalesce(F.col("drop_reason").isin(*reasons), F.lit(False))
    d = Stored(decisions.drop("bridge_t_a", "bridge_t_b", "bridge_score", "bridge_ops_json", "bridge_is_primary")).df
    drops = d.where(eligible).select("dataset_id", F.col("t").alias("t_drop")).dropna().distinct()
    best = Stored(bridge_spans(drops.select("dataset_id", F.col("t_drop").alias("t"), F.lit("DROP").alias("action"), F.lit("ANOMALY").alias("drop_reason")), spans, tau, max_gap)).df
    taken = _considered(drops.join(best, ["dataset_id", "t_drop"], "left"), max_gap).where("t_b IS NOT NULL")
    ops_of = spans.groupBy("dataset_id", "t_a", "t_b", "score").agg(F.min("ops_json").alias("ops_json"))
    taken = taken.join(ops_of, ["dataset_id", "t_a", "t_b", "score"])
    accepted = taken.groupBy("dataset_id", "t_a").agg(F.min("t_drop").alias("first"), F.max_by(F.struct("t_b", "score", "ops_json"), "t_drop").alias("s"))
    under = accepted.select("dataset_id", F.explode(F.sequence(F.col("t_a"), F.col("s.t_b") - 1)).alias("t"), F.struct("first", "t_a", "s").alias("x"))
    over = under.groupBy("dataset_id", "t").agg(F.min("x").alias("_x"))
    j = d.join(over, ["dataset_id", "t"], "left")
    x, bridged = F.col("_x"), F.col("_x").isNotNull()
    primary = F.coalesce(bridged & (F.col("t") == x["t_a"]), F.lit(False))
    reason = F.when(bridged, None).when(eligible, "BRIDGE_FAILED").otherwise(F.col("drop_reason"))
    changed = {"action": F.when(bridged, "BRIDGE").otherwise(F.col("action")), "drop_reason": reason}
    kept = [changed[c].alias(c) if c in changed else F.col(c) for c in d.columns]
    return j.select(*kept, x["t_a"].alias("bridge_t_a"), x["s"]["t_b"].alias("bridge_t_b"), x["s"]["score"].alias("bridge_score"), F.when(primary, x["s"]["ops_json"]).alias("bridge_ops_json"), primary.alias("bridge_is_primary"))


def decided_operations(decisions: DataFrame) -> DataFrame:
    """(dataset_id, t, dst_t, ops) for `reconstruct`, from decisions with or without bridges: what was chosen of kept pairs, and a bridge's operations at
    its start, which lead to its end. Drops, and pairs inside of a bridge, have none, so lineages break at the former and pass the latter."""
    if "bridge_t_b" not in decisions.columns:
        none = F.lit(None)
        decisions = decisions.withColumns({"bridge_t_b": none.cast("int"), "bridge_ops_json": none.cast("string"), "bridge_is_primary": F.lit(False)})
    kept = F.col("action") == "KEEP"
    primary = (F.col("action") == "BRIDGE") & F.col("bridge_is_primary")
    rows = decisions.where(kept | primary).withColumn("_ops", F.when(kept, F.col("chosen_ops_json")).otherwise(F.col("bridge_ops_json")))
    return rows.where("_ops IS NOT NULL").select("dataset_id", "t", F.when(kept, F.col("t") + 1).otherwise(F.col("bridge_t_b")).cast("int").alias("dst_t"), ops.parse("_ops").alias("ops"))


def sequence_costs(candidates: DataFrame, cells: DataFrame, params: TrackerParams) -> DataFrame:
    """candidates(dataset_id, t, pair_id, sample_rank, ops) to (pair_id, sample_rank, cost): the exact cost of each whole sequence, exits included; NULL where
    a cell is missing. cells: (dataset_id, t, label, <axis>, area)."""
    key = ["dataset_id", "t", "pair_id", "sample_rank"]
    o = candidates.select(*key, F.explode("ops").alias("o")).select(*key, "o.*")

    def side(name: str, shift: int) -> DataFrame:
        return cells.select("dataset_id", (F.col("t") - shift).alias("t"), F.col("label").alias(name), F.struct(F.col(params.axis).alias("p"), "area").alias(f"_{name}"))

    j = o.join(side("src", 0), ["dataset_id", "t", "src"], "left").join(side("dst1", 1), ["dataset_id", "t", "dst1"], "left").join(side("dst2", 1), ["dataset_id", "t", "dst2"], "left")
    s, a, b = F.col("_src"), F.col("_dst1"), F.col("_dst2")
    link, divide = link_cost(params, s["p"] - a["p"], s["area"], a["area"]), divide_cost(params, s["p"] - a["p"], s["p"] - b["p"], s["area"], a["area"], b["area"])
    cost = F.when(F.col("kind") == "link", link).when(F.col("kind") == "divide", divide).when(F.col("kind") == "exit", 0.0)
    g = j.groupBy(*key).agg(F.sum(cost).alias("c"), F.count_if(cost.isNull()).alias("lost"), F.count_if(F.col("kind") == "exit").alias("exits"))
    return g.select("pair_id", "sample_rank", F.when(F.col("lost") == 0, F.col("c") + exits_cost(params, F.col("exits"))).alias("cost"))


def mask_runs(frames: DataFrame) -> DataFrame:
    """frames(dataset_id, t, height, width, pixels) to the runs of each label: (dataset_id, t, label, row, first, last), columns first to last."""

    def run(batches):
        for pdf in batches:
            for d, t, h, w, raw in zip(pdf["dataset_id"], pdf["t"], pdf["height"], pdf["width"], pdf["pixels"]):
                image = np.frombuffer(raw, "<u4").reshape(h, w).astype(np.int64)
                edge = np.ones((h, w + 1), bool)
                edge[:, 1:w] = image[:, 1:] != image[:, :-1]
                r, c = np.nonzero(edge)
                # edges come in pairs of neighbours within a row
                inside = c < w
                start, end = np.flatnonzero(inside), np.flatnonzero(inside) + 1
                label = image[r[start], c[start]]
                keep = label > 0
                yield pd.DataFrame({"dataset_id": d, "t": t, "label": label[keep], "row": r[start][keep], "first": c[start][keep], "last": c[end][keep] - 1})

    return frames.mapInPandas(run, "dataset_id STRING, t INT, label INT, row INT, first INT, last INT")


def shifted_overlaps(links: DataFrame, runs: DataFrame, heights: DataFrame) -> DataFrame:
    """links(dataset_id, t, src, k, dst, shift) plus iou of src's mask at t with dst's mask at k, moved down by `shift` rows and cut at the frame's ends.
    runs: as `mask_runs` gives them; heights: (dataset_id, height)."""
    key = ["dataset_id", "t", "src", "k", "dst", "shift"]
    one = links.select(*key).distinct()
    a = one.join(runs.select("dataset_id", "t", F.col("label").alias("src"), "row", F.col("first").alias("a1"), F.col("last").alias("a2")), ["dataset_id", "t", "src"])
    b = one.join(runs.select("dataset_id", F.col("t").alias("k"), F.col("label").alias("dst"), F.col("row").alias("_row"), F.col("first").alias("b1"), F.col("last").alias("b2")), ["dataset_id", "k", "dst"])
    b = b.withColumn("row", F.col("_row") + F.col("shift")).join(heights.select("dataset_id", "height"), "dataset_id").where("row >= 0 AND row < height")
    na = a.groupBy(*key).agg(F.sum(F.col("a2") - F.col("a1") + 1).alias("na"))
    nb = b.groupBy(*key).agg(F.sum(F.col("b2") - F.col("b1") + 1).alias("nb"))
    both = a.join(b.select(*key, "row", "b1", "b2"), [*key, "row"]).groupBy(*key).agg(F.sum(F.greatest(F.least("a2", "b2") - F.greatest("a1", "b1") + 1, F.lit(0))).alias("n"))
    j = one.join(na, key, "left").join(nb, key, "left").join(both, key, "left").fillna(0, ["na", "nb", "n"])
    return j.select(*key, F.when(F.col("na") + F.col("nb") > F.col("n"), F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).otherwise(0.0).alias("iou"))


def link_ious(truth: DataFrame, cells: DataFrame, runs: DataFrame, heights: DataFrame) -> DataFrame:
    """(dataset_id, t, pair_id[, sample_rank], link_iou_shifted_median) of operations as in `operation_features`; NULL without links. A link's target is moved
    by the rounded difference of the y of its cells, halves to the even number."""
    key = ["dataset_id", "t", "pair_id", *[c for c in ("sample_rank",) if c in truth.columns]]
    delta = F.col("delta_t") if "delta_t" in truth.columns else F.lit(1)
    o = truth.select(*key, (F.col("t") + delta).alias("k"), F.explode("ops").alias("o")).where("o.kind = 'link'").select(*key, "k", "o.src", F.col("o.dst1").alias("dst"))
    o = o.join(cells.select("dataset_id", "t", F.col("label").alias("src"), F.col("y").alias("ys")), ["dataset_id", "t", "src"]).join(cells.select("dataset_id", F.col("t").alias("k"), F.col("label").alias("dst"), F.col("y").alias("yd")), ["dataset_id", "k", "dst"])
    o = Stored(o.withColumn("shift", F.rint(F.col("ys") - F.col("yd")).cast("int"))).df
    j = o.join(shifted_overlaps(o, runs, heights), ["dataset_id", "t", "src", "k", "dst", "shift"])
    return truth.select(*key).distinct().join(j.groupBy(*key).agg(F.median("iou").alias("link_iou_shifted_median")), key, "left")
