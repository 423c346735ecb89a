"""Costs of operations as columns: link, divide and exit, with the tracker's parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cost of a division that a gate forbids; finite, so that a path with it still has a rank.
FORBIDDEN = 1e9
EPS = 1e-9


@dataclass(frozen=True)
class TrackerParams:
    axis: str = "y"
    open_end: str = "low"
    wy: float = 0.02
    wa: float = 0.2
    exit_lin: float = 3.0
    exit_quad: float = 4.5
    wshrink: float = 50.0
    wshrink_border: float = 0.0
    shrink_tol: float = 0.05
    c_div0: float = 0.1
    wsym: float = 2.0
    w_divshrink: float = 10.0
    border_margin: int = 2
    sum_area_tol: float = float("inf")
    max_area_tol: float = float("inf")
    sum_len_tol: float = float("inf")
    max_len_tol: float = float("inf")


def position(p: TrackerParams, cell: Column) -> Column:
    return cell[p.axis]


def axis_length(p: TrackerParams, cell: Column) -> Column:
    return cell["bbox_maxr"] - cell["bbox_minr"] if p.axis == "y" else cell["bbox_maxc"] - cell["bbox_minc"]


def touches_open(p: TrackerParams, cell: Column, height: Column, width: Column, margin: int | None = None) -> Column:
    """Whether the cell's box comes within the margin of the open end."""
    m = p.border_margin if margin is None else margin
    if p.open_end == "low":
        return cell["bbox_minr" if p.axis == "y" else "bbox_minc"] <= m
    return cell["bbox_maxr"] >= height - 1 - m if p.axis == "y" else cell["bbox_maxc"] >= width - 1 - m


def exit_cost(p: TrackerParams, k: Column) -> Column:
    """Cost of the k-th exit of a pair, k from 1."""
    return F.lit(p.exit_lin) + F.lit(p.exit_quad) * (2 * k - 1)


def exits_cost(p: TrackerParams, n: Column) -> Column:
    """Cost of n exits together."""
    return F.lit(p.exit_lin) * n + F.lit(p.exit_quad) * n * n


def _shrink(p: TrackerParams, source: Column, target: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - (target + EPS) / (source + EPS) - p.shrink_tol)


def link_cost(p: TrackerParams, shift: Column, source_area: Column, target_area: Column, at_border: Column | None = None) -> Column:
    """shift: the difference of positions; at_border: whether the target is the first destination and touches the open end."""
    weight = F.lit(p.wshrink) if at_border is None else F.when(at_border, p.wshrink_border).otherwise(p.wshrink)
    area = F.abs(F.log((source_area + EPS) / (target_area + EPS)))
    return p.wy * F.abs(shift) + p.wa * area + weight * _shrink(p, source_area, target_area)


def divide_cost(p: TrackerParams, shift1: Column, shift2: Column, mother: Column, d1: Column, d2: Column, mother_len: Column | None = None, len1: Column | None = None, len2: Column | None = None) -> Column:
    """mother, d1, d2: areas. A gate with an infinite tolerance is off; the length gates need the lengths."""
    barred = F.lit(False)
    if p.sum_area_tol != float("inf"):
        barred = barred | (d1 + d2 > (1 + p.sum_area_tol) * mother)
    if p.max_area_tol != float("inf"):
        barred = barred | (F.greatest(d1, d2) > (1 + p.max_area_tol) * mother)
    if mother_len is not None and p.sum_len_tol != float("inf"):
        barred = barred | (len1 + len2 > (1 + p.sum_len_tol) * mother_len)
    if mother_len is not None and p.max_len_tol != float("inf"):
        barred = barred | (F.greatest(len1, len2) > (1 + p.max_len_tol) * mother_len)
    cost = (
        F.lit(p.c_div0)
        + p.wy * (F.abs(shift1) + F.abs(shift2))
        + p.wa * F.abs(mother - (d1 + d2)) / F.greatest(mother, F.lit(1.0))
        + p.wsym * F.abs(d1 - d2) / (d1 + d2 + EPS)
        - p.w_divshrink * (_shrink(p, mother, d1) + _shrink(p, mother, d2))
    )
    return F.when(barred, FORBIDDEN).otherwise(cost)
