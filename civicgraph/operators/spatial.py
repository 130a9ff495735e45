"""Distributed spatial joins on plain equi-joins over grid cells.

No join here is a nested loop and none collects a side. Both sides are hashed
by grid cell, and identical points are collapsed into one weighted point before
anything is shuffled. ``knn`` splits crowded query cells by a salt; the joins on
other cells are sort-merge joins whose crowded cells Spark splits.
"""

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.numeric import LAT_M, LON_M, col, degree_d2, haversine_miles, planar_m2
from ..functions.session import materialise, spread_by

# metric -> (distance^2, scale of a latitude degree, scale of a longitude degree)
METRICS = {
    "planar_m": (planar_m2, LAT_M, LON_M),
    "degrees": (degree_d2, 1.0, 1.0),
}
# Queries per salt of one crowded cell.
SALT_ROWS = 20_000
# Cells whose far corner is closer than this share of the radius count whole.
FULL_CELL_MARGIN = 1.0 - 1e-9


def _y(lat, metric) -> Column:
    """Projected latitude, shifted so that every cell number is positive."""
    return (col(lat) + F.lit(90.0)) * F.lit(METRICS[metric][1])


def _x(lon, metric) -> Column:
    return (col(lon) + F.lit(180.0)) * F.lit(METRICS[metric][2])


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(size)).cast("long")


def with_cells(df, size, metric="planar_m", lat="latitude", lon="longitude",
               cx="_cx", cy="_cy") -> DataFrame:
    return (df.where(col(lat).isNotNull() & col(lon).isNotNull())
            .withColumn(cx, _cell(_x(lon, metric), size))
            .withColumn(cy, _cell(_y(lat, metric), size)))


def _block(cx, cy, reach) -> Column:
    """array<struct<x,y>> of the (2*reach+1)^2 cells around a cell."""
    return F.expr(f"""flatten(transform(sequence(-{reach}L, {reach}L), i ->
        transform(sequence(-{reach}L, {reach}L), j -> named_struct('x', {cx} + i, 'y', {cy} + j))))""")


def _gap(v, cell, size) -> Column:
    """Distance along one axis from a value to the nearest edge of a cell."""
    size = size if isinstance(size, Column) else F.lit(size)
    lo = cell * size
    return F.greatest(lo - v, v - lo - size, F.lit(0.0))


def _reach(v, cell, size) -> Column:
    """Distance along one axis from a value to the far edge of a cell."""
    size = size if isinstance(size, Column) else F.lit(size)
    lo = cell * size
    return F.greatest(F.abs(v - lo), F.abs(lo + size - v))


def radius_count(left, points, radius, left_id, metric="planar_m", by=None,
                 out="n", split=4) -> DataFrame:
    """Points within ``radius`` (inclusive) of each left row.

    ``points`` needs latitude/longitude and, when ``by`` is given, that column;
    the result is then one row per (left id, by) with at least one point.
    Without ``by`` every left row appears, with zero where nothing is near.

    Cells are ``radius/split`` wide. A cell wholly inside the circle adds its
    pre-summed count, so a cell holding a large share of all points costs one
    row per left row; only the ring of cells the circle cuts through is
    compared point by point. Both sides are reduced to distinct positions
    first, so copies on one spot are counted once and joined back.
    """
    dist2, _, _ = METRICS[metric]
    size = radius / split
    keys = [by] if by else []
    pos = (with_cells(points, size, metric)
           .groupBy("_cx", "_cy", "latitude", "longitude", *keys)
           .agg(F.count(F.lit(1)).alias("_w")))
    cells = pos.groupBy("_cx", "_cy", *keys).agg(F.sum("_w").alias("_w"))

    spots = (left.select(F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"))
             .where("_lat IS NOT NULL AND _lon IS NOT NULL").distinct())
    near = (with_cells(spots, size, metric, "_lat", "_lon", "_ox", "_oy")
            .withColumn("_c", F.explode(_block("_ox", "_oy", split + 1)))
            .select("_lat", "_lon", F.col("_c.x").alias("_cx"), F.col("_c.y").alias("_cy")))
    vx, vy = _x("_lon", metric), _y("_lat", metric)
    far = F.pow(_reach(vx, F.col("_cx"), size), 2) + F.pow(_reach(vy, F.col("_cy"), size), 2)
    close = F.pow(_gap(vx, F.col("_cx"), size), 2) + F.pow(_gap(vy, F.col("_cy"), size), 2)
    r2 = float(radius) * float(radius)
    near = (near.where(close <= F.lit(r2 * (2.0 - FULL_CELL_MARGIN)))
            .withColumn("_whole", far <= F.lit(r2 * FULL_CELL_MARGIN)))

    spot = ["_lat", "_lon", *keys]
    whole = near.where("_whole").join(cells, ["_cx", "_cy"]).select(*spot, "_w")
    cut = (near.where(~F.col("_whole")).join(pos, ["_cx", "_cy"])
           .where(dist2(F.col("_lat"), F.col("_lon"), F.col("latitude"), F.col("longitude")) <= F.lit(r2))
           .select(*spot, "_w"))
    counts = whole.unionByName(cut).groupBy(*spot).agg(F.sum("_w").cast("long").alias(out))
    here = (F.col("latitude") == F.col("_lat")) & (F.col("longitude") == F.col("_lon"))
    if by:
        return (left.select(left_id, "latitude", "longitude").join(counts, here)
                .select(left_id, *keys, out))
    return (left.join(counts, here, "left").drop("_lat", "_lon")
            .withColumn(out, F.coalesce(F.col(out), F.lit(0).cast("long"))))


def _dealt(lhs, rhs, cell, rows):
    """Both sides once more by ``cell`` and ``_piece``: each cell's right rows dealt evenly, its left rows copied to all pieces."""
    deal = F.pmod(F.xxhash64(*rhs.columns), F.col("_pieces")).cast("int")
    sizes = rhs.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).cast("int").alias("_pieces"))
    lhs = lhs.join(sizes, cell).withColumn("_piece", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1))).drop("_pieces")
    rhs = rhs.join(sizes, cell).withColumn("_piece", deal).drop("_pieces")
    return [spread_by(df, *cell, "_piece") for df in (lhs, rhs)]


def radius_pairs(left, right, radius, cell, metric="planar_m", piece_rows=None) -> DataFrame:
    """All (left, right) rows within ``radius`` with squared distance ``d2``.

    Column names must be disjoint except that left uses l_lat/l_lon and right
    r_lat/r_lon. ``radius`` may be a number or a left-side Column (per row); a
    left row is copied only to the cells its own circle touches. Where pairs are
    far more than rows, ``piece_rows`` deals the right rows of a cell over pieces
    of about so many, which tasks share evenly.
    """
    dist2, _, _ = METRICS[metric]
    r = radius if isinstance(radius, Column) else F.lit(float(radius))
    lx, ly = _x("l_lon", metric), _y("l_lat", metric)
    span = lambda v: F.sequence(_cell(v - r, cell), _cell(v + r, cell))
    lhs = (left.where(F.col("l_lat").isNotNull() & F.col("l_lon").isNotNull() & (r >= 0))
           .withColumn("_cx", F.explode(span(lx))).withColumn("_cy", F.explode(span(ly))))
    edge = F.pow(_gap(lx, F.col("_cx"), cell), 2) + F.pow(_gap(ly, F.col("_cy"), cell), 2)
    lhs = lhs.where(edge <= r * r * F.lit(2.0 - FULL_CELL_MARGIN))
    rhs = with_cells(right, cell, metric, "r_lat", "r_lon")
    d2 = dist2(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon"))
    keys = ["_cx", "_cy"]
    if piece_rows:
        lhs, rhs = _dealt(lhs, rhs, keys, piece_rows)
        keys = [*keys, "_piece"]
    return lhs.join(rhs, keys).withColumn("d2", d2).where(F.col("d2") <= r * r).drop(*keys)


#: Widths in metres of the nested cells in which pairs are counted; each divides the one before.
COUNT_WIDTHS = (32_000, 8_000, 2_000, 500, 125)
# Pairs of cells that hold no more pairs of points than this are not split: comparing the points is quicker.
SPLIT_OVER = 1 << 16


def _cost_nodes(points, side, speed, limit):
    """One table per width: cells of position and cost, with their number of points and true bounds.

    Cost is measured as the way that it is worth at ``speed``, so a cell is as wide in cost as in space.
    """
    x, y, at = _x("lon", "planar_m"), _y("lat", "planar_m"), F.col("cost")
    points = (points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & at.between(0, limit))
              .groupBy("lat", "lon", "cost").agg(F.sum("n").alias("n")))
    width = COUNT_WIDTHS[-1]
    cells = lambda by: [F.floor(F.col(c) / F.lit(by)).cast("long").alias(c) for c in ("cx", "cy", "cz")]
    leaves = points.withColumns({"cx": _cell(x, width), "cy": _cell(y, width), "cz": _cell(at * F.lit(speed), width)})
    leaves = materialise(leaves, f"count-{side}")
    spans = {"x": x, "y": y, "c": at}
    level = leaves.groupBy("cx", "cy", "cz").agg(
        F.sum("n").alias("n"), *(f(v).alias(f"{k}{name}") for name, v in spans.items() for k, f in (("lo", F.min), ("hi", F.max))))
    tables = [level]
    for coarse, fine in zip(COUNT_WIDTHS[-2::-1], COUNT_WIDTHS[:0:-1]):
        up = level.select(*cells(coarse // fine), "n", *(f"{k}{name}" for name in spans for k in ("lo", "hi")))
        level = up.groupBy("cx", "cy", "cz").agg(
            F.sum("n").alias("n"), *(f(f"{k}{name}").alias(f"{k}{name}") for name in spans for k, f in (("lo", F.min), ("hi", F.max))))
        tables.append(level)
    return leaves, tables[::-1]


def _named(table, side):
    return table.select([F.col(c).alias(f"{side}_{c}") for c in table.columns])


def _under(pairs, children, side, by):
    """The pairs again for every child cell (or point) of one side."""
    up = [F.floor(F.col(f"{side}_{c}") / F.lit(by)).cast("long").alias(f"_{c}") for c in ("cx", "cy", "cz")]
    kids = _named(children, side).select("*", *up)
    mine = [f"{side}_{c}" for c in ("cx", "cy", "cz")]
    kept = [c for c in pairs.columns if not c.startswith(f"{side}_")]
    return pairs.select(*kept, *(F.col(c).alias("_" + c[-2:]) for c in mine)).join(kids, ["_cx", "_cy", "_cz"]).drop("_cx", "_cy", "_cz")


def count_within_cost(left, right, speed, limit, split_over=SPLIT_OVER) -> DataFrame:
    """One row (n): pairs whose costs and planar distance / ``speed`` add up to at most ``limit``.

    Both sides have lat, lon, cost and n, the number of equal points. Rows with a null or negative
    cost, or without a position, pair with nothing.

    Cells of both sides meet from the widest down. Pairs of cells that lie wholly within the limit by
    the bounds of their points are counted as a product, those wholly beyond it are dropped, and only
    the others are split, down to cells of few points. So points meet points only where the limit
    runs through a pair of small cells.
    """
    top = COUNT_WIDTHS[0]
    lhs, l_levels = _cost_nodes(left, "left", speed, limit)
    rhs, r_levels = _cost_nodes(right, "right", speed, limit)
    reach = int(limit * speed // top) + 1
    around = lambda c: F.explode(F.sequence(F.col(f"l_{c}") - reach, F.col(f"l_{c}") + reach))
    pairs = (_named(l_levels[0], "l").withColumn("r_cx", around("cx")).withColumn("r_cy", around("cy"))
             .join(_named(r_levels[0], "r"), ["r_cx", "r_cy"]))
    gap = lambda a: F.greatest(F.col(f"l_lo{a}") - F.col(f"r_hi{a}"), F.col(f"r_lo{a}") - F.col(f"l_hi{a}"), F.lit(0.0))
    far = lambda a: F.greatest(F.col(f"l_hi{a}") - F.col(f"r_lo{a}"), F.col(f"r_hi{a}") - F.col(f"l_lo{a}"))
    total = lambda a, x, y: F.col(f"l_{a}c") + F.col(f"r_{a}c") + F.sqrt(x * x + y * y) / F.lit(speed)
    least, most = total("lo", gap("x"), gap("y")), total("hi", far("x"), far("y"))
    margin = limit * (1.0 - FULL_CELL_MARGIN) + 1e-6    # far above what rounding can move a sum by
    way = F.sqrt(planar_m2(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon"))) / F.lit(speed)
    held, sure = F.col("l_n") * F.col("r_n"), most <= limit - margin
    keys = [f"{s}_{c}" for s in "lr" for c in ("cx", "cy", "cz")]
    whole, parts = 0, []
    for k, width in enumerate(COUNT_WIDTHS):
        step = F.when(sure, "whole").when((held > split_over) & F.lit(width > COUNT_WIDTHS[-1]), "split").otherwise("points")
        met = materialise(pairs.where(least <= limit + margin).withColumn("step", step), "count-pairs")
        done = met.agg(F.sum(F.when(F.col("step") == "whole", held)).alias("n"), F.count_if(F.col("step") == "split").alias("split"),
                       F.count_if(F.col("step") == "points").alias("points")).first()
        whole += done.n or 0
        if done.points:
            close, by = met.where("step = 'points'").select(keys), width // COUNT_WIDTHS[-1]
            close = _under(_under(close, lhs, "l", by), rhs, "r", by)
            parts.append(close.where(F.col("l_cost") + way + F.col("r_cost") <= limit).agg(F.sum(held).alias("n")))
        if not done.split:
            break
        pairs, by = met.where("step = 'split'").select(keys), width // COUNT_WIDTHS[k + 1]
        pairs = _under(_under(pairs, l_levels[k + 1], "l", by), r_levels[k + 1], "r", by)
    first = left.sparkSession.range(1).select(F.lit(whole).cast("long").alias("n"))
    return reduce(DataFrame.union, parts, first).agg(F.sum("n").alias("n"))


#: Latitudes for which great-circle neighbours follow from planar ones.
GREAT_CIRCLE_BAND = (0.0, 55.0)


def _in_band(df, lat) -> DataFrame:
    low, high = GREAT_CIRCLE_BAND
    wrong = F.raise_error(F.lit(f"great-circle neighbours need latitudes from {low} to {high}"))
    return df.withColumn(lat, F.when(F.col(lat).between(low, high), F.col(lat)).otherwise(wrong.cast("double")))


def _levels(base, cap):
    """Cell widths base*2^l: up to the cap, or until one cell covers the globe."""
    top = 360.0 * LAT_M if cap is None else cap
    return max(1, math.ceil(math.log2(top / base)) + 1)


def knn(queries, targets, k, query_id, target_id, cap=None, base=250.0,
        exclude_self=False, carry=(), by=(), metric="planar_m") -> DataFrame:
    """Exact k nearest targets per query, ties by target id.

    Rows out: ``by``, query_id, target_id, dist (metres, or miles when
    ``metric="miles"`` ranks by great-circle distance), rank (1-based) and the
    ``carry`` target columns. ``by`` columns must be equal on both sides. With
    ``cap`` (planar metres) only targets at most that far away.

    How it scales. A pyramid counts targets per cell at widths base*2^l. Each
    occupied query cell picks the smallest width at which its own cell already
    holds enough targets, which bounds the answer's distance by that cell's
    diagonal, so the 5x5 block at that width is enough - exactly, without
    trial rounds. Candidates then come from an equi-join on (level, cell).
    Great-circle order needs no wider block: between the equator and 55 degrees
    it differs from planar by a factor below 2/sqrt(2), which the block allows.
    Latitudes outside that band raise an error with ``metric="miles"``.
    Targets at one position are reduced to the k first ids before the join,
    and crowded query cells are split into salts.
    """
    by = list(by)
    need = k + (1 if exclude_self else 0)
    levels = _levels(base, cap)
    cell = by + ["_cx", "_cy"]
    at_level = by + ["_l", "_lx", "_ly"]
    q = with_cells(queries.select(F.col(query_id).alias("_q"), F.col("latitude").alias("_qlat"),
                                  F.col("longitude").alias("_qlon"), *by),
                   base, "planar_m", "_qlat", "_qlon")
    t = with_cells(targets.select(F.col(target_id).alias("_t"), F.col("latitude").alias("_tlat"),
                                  F.col("longitude").alias("_tlon"), *carry, *by), base,
                   lat="_tlat", lon="_tlon")
    if metric == "miles":
        q, t = (_in_band(df, c) for df, c in ((q, "_qlat"), (t, "_tlat")))
    # A rank filter on a window is applied before the shuffle as well (per map
    # task), so one crowded position never reaches a single task whole.
    spot = W.partitionBy("_tlat", "_tlon", *by).orderBy("_t")
    t = t.withColumn("_rn", F.row_number().over(spot)).where(F.col("_rn") <= need).drop("_rn")

    lv = F.expr(f"sequence(0, {levels - 1})")
    up = lambda c: F.expr(f"shiftright({c}, _l)")
    pyramid = (t.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_l", F.explode(lv))
               .groupBy(*by, "_l", up("_cx").alias("_lx"), up("_cy").alias("_ly"))
               .agg(F.sum("_n").alias("_n")).where(F.col("_n") >= need))
    qcells = (q.groupBy(*cell).agg(F.count(F.lit(1)).alias("_qn"))
              .select(*cell, F.ceil(F.col("_qn") / F.lit(SALT_ROWS)).cast("int").alias("_salts")))
    best = (qcells.withColumn("_l", F.explode(lv))
            .withColumn("_lx", up("_cx")).withColumn("_ly", up("_cy"))
            .join(pyramid.select(*at_level), at_level, "left_semi")
            .groupBy(*cell).agg(F.min("_l").alias("_l")))
    cover = (qcells.join(best, cell, "left")
             .withColumn("_w", F.expr(f"CAST({base} AS DOUBLE) * shiftleft(1L, _l)"))
             .withColumn("_l", F.coalesce(F.col("_l"), F.lit(levels - 1)))
             .withColumn("_salt", F.explode(F.expr("sequence(0, _salts - 1)")))
             .withColumn("_b", F.explode(_block("shiftright(_cx, _l)", "shiftright(_cy, _l)", 2)))
             .select(*cell, "_salt", "_l", "_w", F.col("_b.x").alias("_lx"), F.col("_b.y").alias("_ly")))
    # targets are copied to the widths that some query cell picked, not to all
    used = best.agg(F.array_union(F.collect_set("_l"), F.array(F.lit(levels - 1))).alias("_u")).scalar()
    by_level = (t.withColumn("_l", F.explode(used)).withColumn("_lx", up("_cx"))
                .withColumn("_ly", up("_cy")).drop("_cx", "_cy"))
    cand = cover.join(by_level, at_level).drop("_l", "_lx", "_ly")
    salted = (q.join(qcells, cell)
              .withColumn("_salt", F.pmod(F.xxhash64("_q"), F.col("_salts")).cast("int"))
              .drop("_salts"))
    pairs = salted.join(cand, cell + ["_salt"])
    # The query's own cell of width _w holds enough targets, so nothing past
    # that cell's farthest corner can be among the answers; _w is null when
    # even the widest cell holds too few, and then every candidate counts.
    corner = F.pow(_reach(_x("_qlon", "planar_m"), F.floor(_x("_qlon", "planar_m") / F.col("_w")), F.col("_w")), 2) + \
        F.pow(_reach(_y("_qlat", "planar_m"), F.floor(_y("_qlat", "planar_m") / F.col("_w")), F.col("_w")), 2)
    slack = 2.0 if metric == "miles" else 2.0 - FULL_CELL_MARGIN
    d2 = planar_m2("_tlat", "_tlon", "_qlat", "_qlon")
    pairs = pairs.where(F.col("_w").isNull() | (d2 <= corner * F.lit(slack))).drop("_w")
    if metric == "miles":
        pairs = pairs.withColumn("_d", haversine_miles("_qlat", "_qlon", "_tlat", "_tlon"))
    else:
        pairs = pairs.withColumn("_d", planar_m2("_tlat", "_tlon", "_qlat", "_qlon"))
    if exclude_self:
        pairs = pairs.where(F.col("_q") != F.col("_t"))
    if cap is not None:
        pairs = pairs.where(planar_m2("_tlat", "_tlon", "_qlat", "_qlon") <= F.lit(float(cap) * float(cap)))
    if k == 1:
        top = (pairs.groupBy(*by, "_q").agg(F.min(F.struct("_d", "_t", *carry)).alias("_m"))
               .select(*by, "_q", "_m.*").withColumn("rank", F.lit(1)))
    else:
        order = W.partitionBy(*by, "_q").orderBy("_d", "_t")
        top = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    dist = F.col("_d") if metric == "miles" else F.sqrt("_d")
    return top.select(*by, F.col("_q").alias(query_id), F.col("_t").alias(target_id),
                      dist.alias("dist"), F.col("rank"), *carry)
