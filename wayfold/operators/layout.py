"""Layouts and bounds: rings, grids, viewports, and a repulsion layout by parts that never meet."""

from __future__ import annotations

import math
from bisect import bisect
from collections import defaultdict
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wayfold.operators.components import connected_components
from wayfold.operators.scans import count_before
from wayfold.storage import materialize

#: Parts of so many points are moved in tasks of their own while there are tasks enough.
LARGE = 1000


def ring_layout(placed: DataFrame, added: DataFrame, region: str = "region", order: str = "id", radius: float = 40.0, per_ring: int = 12) -> DataFrame:
    """added (id, region) with x, y on rings around the centre of the region's placed nodes (x, y); 0, 0 without any."""
    centre = placed.groupBy(region).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    at = added.withColumn("i", F.row_number().over(W.partitionBy(region).orderBy(order)) - 1)
    angle = F.lit(2 * math.pi) * (F.col("i") % per_ring) / per_ring
    r = F.lit(radius) * (1 + F.floor(F.col("i") / per_ring))
    out = at.join(centre, region, "left")
    put = lambda c, f: F.round(F.coalesce(c, F.lit(0.0)) + r * f(angle), 1)
    return out.withColumns({"x": put(F.col("cx"), F.cos), "y": put(F.col("cy"), F.sin)}).drop("i", "cx", "cy")


def grid_layout(df: DataFrame, part: str, order, columns: int, step: float) -> DataFrame:
    """df with x, y in rows of so many columns within each part."""
    i = F.row_number().over(W.partitionBy(part).orderBy(order)) - 1
    return df.withColumn("_i", i).withColumns({"x": (F.col("_i") % columns) * step, "y": F.floor(F.col("_i") / columns) * step}).drop("_i")


def viewport(df: DataFrame, margin: float = 0.08) -> DataFrame:
    """One row x, y, width, height: the bounds of the finite points, widened by the margin on each side."""
    ok = df.select(F.col("x").try_cast("double").alias("x"), F.col("y").try_cast("double").alias("y")).filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
    b = ok.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    w, h = F.greatest(F.col("x1") - F.col("x0"), F.lit(1.0)), F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0))
    return b.select((F.col("x0") - w * margin).alias("x"), (F.col("y0") - h * margin).alias("y"), (w * (1 + 2 * margin)).alias("width"), (h * (1 + 2 * margin)).alias("height"))


def zoom_to_fit(df: DataFrame, width: float, height: float, pad: float = 70.0, least: float = 0.5, most: float = 4.0, by: Sequence[str] = ()) -> DataFrame:
    """(by, x, y, zoom): for each group the middle of its finite points and the zoom that shows them in a window with a margin of pad.

    Sides below 1 count as 1; zoom is kept between least and most. A group without a finite point has no row.
    """
    number = lambda c: F.col(c).try_cast("double")
    ok = df.select(*by, number("x").alias("x"), number("y").alias("y")).filter("x is not null and y is not null and not isnan(x) and not isnan(y) and abs(x) < double('infinity') and abs(y) < double('infinity')")
    b = ok.groupBy(*by).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).filter("x0 is not null")
    w, h = F.greatest(F.col("x1") - F.col("x0"), F.lit(1.0)), F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0))
    zoom = F.greatest(F.lit(least), F.least(F.lit(most), F.lit(width - 2 * pad) / w, F.lit(height - 2 * pad) / h))
    return b.select(*by, ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"), zoom.alias("zoom"))


def _push_apart(xy: np.ndarray, place: np.ndarray, least: float, rounds: int) -> set[tuple[int, int]]:
    """Move the points of xy until all are `least` apart, pair after pair in order; the cells that any point was in.

    Cells are a hair wider than `least`, so that a point is compared with those of nine cells, not with all. A point's turn
    compares it with later ones only: cells hold the points whose turn is to come, and are read once a turn and cell.
    """
    floor, hypot, wide = math.floor, math.hypot, _cell_width(least)
    xs, ys, place = xy[:, 0].tolist(), xy[:, 1].tolist(), place.tolist()
    lo, hi = (least * (1 - 1e-12)) ** 2, (least * (1 + 1e-12)) ** 2
    cell = [(floor(x / wide), floor(y / wide)) for x, y in zip(xs, ys, strict=True)]
    passed = set(cell)
    ahead: defaultdict[tuple[int, int], list[int]] = defaultdict(list)
    beside: dict[tuple[int, int], list[list[int]]] = {}

    def near(c: tuple[int, int]) -> list[int]:
        around = beside.get(c)
        if around is None:
            around = beside[c] = [ahead[c[0] + x, c[1] + y] for x in (-1, 0, 1) for y in (-1, 0, 1)]
        q, r, s, t, u, v, w, x, y = around
        some = [*q, *r, *s, *t, *u, *v, *w, *x, *y]
        some.sort()
        return some

    for _ in range(rounds):
        moved = False
        for i, c in enumerate(cell):
            ahead[c].append(i)
        for i, c in enumerate(cell):
            x, y = xs[i], ys[i]
            ahead[c].remove(i)
            todo, x0, y0 = near(c), c[0] * wide, c[1] * wide
            x1, y1 = x0 + wide, y0 + wide
            while todo:
                for j in todo:
                    dx = xs[j] - x
                    if not -least < dx < least:
                        continue
                    dy = ys[j] - y
                    d = dx * dx + dy * dy
                    if d < lo or d <= hi and np.hypot(dx, dy) < least:
                        size = hypot(dx, dy)
                        if size > 1e-9:
                            ux, uy = dx / size, dy / size
                        else:
                            turn = float(place[i] + place[j])
                            ux, uy = math.cos(turn), math.sin(turn)
                        px, py = ux * (least - size) / 2, uy * (least - size) / 2
                        x, y = x - px, y - py
                        xs[j] = px = xs[j] + px
                        ys[j] = py = ys[j] + py
                        moved = True
                        to, was = (floor(px / wide), floor(py / wide)), cell[j]
                        if to != was:
                            ahead[was].remove(j)
                            ahead[to].append(j)
                            cell[j] = to
                            passed.add(to)
                        if not (x0 <= x < x1 and y0 <= y < y1):
                            c = (floor(x / wide), floor(y / wide))
                            passed.add(c)
                            todo, x0, y0 = near(c), c[0] * wide, c[1] * wide
                            x1, y1 = x0 + wide, y0 + wide
                            todo = todo[bisect(todo, j) :]
                            break
                else:
                    break
            xs[i], ys[i], cell[i] = x, y, c
        if not moved:
            break
    xy[:, 0], xy[:, 1] = xs, ys
    return passed


def _cell_width(least: float) -> float:
    """A hair more than `least`, so that points nearer than that lie in the same cell or in cells side by side, however their places are rounded."""
    return least * (1 + 1e-9)


def _meeting(cells: DataFrame, part: str) -> DataFrame:
    """(src, dst): different parts of one group that have a cell (group, part, cx, cy) in common or side by side."""
    ways = F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in ((0, 0), (1, 0), (-1, 1), (0, 1), (1, 1))])
    own = cells.select("_group", "cx", "cy", F.col(part).alias("src")).distinct()
    beside = own.select("_group", "src", "cx", "cy", F.explode(ways).alias("w")).select("_group", "src", (F.col("cx") + F.col("w.dx")).alias("cx"), (F.col("cy") + F.col("w.dy")).alias("cy"))
    other = own.select("_group", "cx", "cy", F.col("src").alias("dst"))
    return beside.join(other, ["_group", "cx", "cy"]).filter("src <> dst").select("src", "dst").distinct()


def repel(df: DataFrame, group: str, least: float, rounds: int = 90) -> DataFrame:
    """df (group, id, x, y and any columns) with nodes of a group pushed apart, pair after pair in the order of id, until they are `least` apart.

    Pairs that are never nearer than `least` do not touch each other, so the plane is cut into cells
    of that size and only nodes of connected cells are moved in one task. If the cells that two such parts
    passed through are the same or side by side, they could have met: they become one part and are moved again from
    their first places, until no two parts meet. Joining more parts than meet changes nothing, so each round joins
    parts twice as far from each other as the one before, and rounds grow with the logarithm of the plane's width.
    The result is that of one sequential run over the whole group. A part is one task, and each large part has its own;
    nodes without a finite place stay as they are.
    """
    wide = _cell_width(least)
    rows = df.withColumns({"_group": F.col(group).cast("string"), "_x": F.col("x").cast("double"), "_y": F.col("y").cast("double")}).withColumn("_group", F.coalesce("_group", F.lit("")))
    fine = F.coalesce(~F.isnan("_x") & ~F.isnan("_y") & (F.abs("_x") < float("inf")) & (F.abs("_y") < float("inf")), F.lit(False))
    placed = count_before(rows.filter(fine), F.lit(True), "_group", "id", "_i").withColumn("_cell", F.struct(F.floor(F.col("_x") / wide).alias("cx"), F.floor(F.col("_y") / wide).alias("cy")))
    placed = materialize(placed.withColumn("_part", F.concat_ws("|", "_cell.cx", "_cell.cy", "_group")), "placed")
    points = placed.select("_group", "_i", "_x", "_y", "_part")
    parts = points.groupBy(F.col("_part").alias("cell")).agg(F.count("*").alias("n")).withColumn("part", F.col("cell"))
    meets = _meeting(placed.select("_group", "_part", "_cell.cx", "_cell.cy"), "_part")
    shape = "_group string, _i long, _x double, _y double, part string, cells array<struct<cx:long,cy:long>>"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        xy = pdf[["_x", "_y"]].to_numpy(dtype=float).copy()
        passed = [{"cx": x, "cy": y} for x, y in sorted(_push_apart(xy, pdf["_i"].to_numpy(), least, rounds))]
        # the part's cells are in its first row
        return pd.DataFrame({"_group": pdf["_group"], "_i": pdf["_i"], "_x": xy[:, 0], "_y": xy[:, 1], "part": pdf["part"], "cells": [passed] + [None] * (len(pdf) - 1)})

    done, near, tasks = None, 1, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        # parts that meet become one; those that do not keep what they have
        joined = connected_components(meets).select(F.col("id").alias("part"), F.col("component").alias("_new"))
        parts = materialize(parts.join(joined, "part", "left").select("cell", "n", F.coalesce("_new", "part").alias("part"), F.col("_new").isNotNull().alias("again")), "parts")
        again = parts if done is None else parts.filter("again")
        # a task for each few parts, since the bytes of a part say nothing of its work; large parts are dealt one by one, the largest first
        large = again.groupBy("part").agg(F.sum("n").alias("n")).filter(F.col("n") >= LARGE)
        large = large.select("part", ((F.row_number().over(W.orderBy(F.desc("n"), "part")) - 1) % tasks).alias("_task"))
        dealt = again.join(large, "part", "left").select("cell", "part", F.coalesce("_task", F.pmod(F.xxhash64("part"), F.lit(tasks)).cast("int")).alias("_task"))
        todo = points.join(dealt, F.col("_part") == F.col("cell")).select("_group", "_i", "_x", "_y", "part", "_task")
        moved = todo.repartitionById(tasks, "_task").groupBy("_task", "part").applyInPandas(run, shape)
        if done is not None:
            gone = parts.filter("again").select("cell").join(points.select("_group", "_i", F.col("_part").alias("cell")), "cell").select("_group", "_i")
            moved = done.join(gone, ["_group", "_i"], "left_anti").unionByName(moved)
        done = materialize(moved, "moved")
        passed = done.select("_group", "part", F.explode("cells").alias("c")).select("_group", "part", "c.cx", "c.cy")
        if _meeting(passed, "part").isEmpty():
            break
        near *= 2
        wider = passed.select("_group", "part", F.floor(F.col("cx") / near).alias("cx"), F.floor(F.col("cy") / near).alias("cy"))
        meets = materialize(_meeting(wider, "part"), "meets")
        parts = parts.select("cell", "n", "part")
    new = done.select("_group", "_i", F.col("_x").alias("_nx"), F.col("_y").alias("_ny"))
    kinds = dict(df.dtypes)
    out = placed.join(new, ["_group", "_i"]).withColumns({"x": F.col("_nx").cast(kinds["x"]), "y": F.col("_ny").cast(kinds["y"])}).select(*df.columns)
    return out.union(rows.filter(~fine).select(*df.columns))


def region_labels(df: DataFrame, region: str = "region") -> DataFrame:
    """(region, x, y): a label at the least x and y of the members."""
    return df.groupBy(F.coalesce(region, F.lit("?")).alias(region)).agg(F.min("x").alias("x"), F.min("y").alias("y"))
