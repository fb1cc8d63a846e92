"""Nearest-neighbour and name resolution joins against the location master."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import columns as C
from granary.functions import constants as K
from granary.operators.dedup import keep_first
from granary.session import durable

# A quadtree over the globe, two halvings a level: 22.5 degrees down to less than a metre. Cells of up to LEAF points are leaves.
COARSEST, DEEPEST, LEAF = 22.5, 11, 4
# A tile of queries that keeps no more points than this is not split, unless it has more queries than that.
ENOUGH, TILE_QUERIES = 64, 4096
# Cells kept for tiles that are split by one task.
TASK_CELLS = 4000
# More than the rounding of distances to a millimetre changes the cosine of an angle.
COSINE_SLACK = 1e-9


def _size(level: Column) -> Column:
    return F.lit(COARSEST) / F.pow(F.lit(4.0), level)


def _cell(lat: str, lon: str, level: Column) -> tuple[Column, Column]:
    """Row and column of a coordinate's cell; columns wrap."""
    around = (F.lit(int(360 / COARSEST)) * F.pow(F.lit(4), level)).cast("long")
    return (F.floor((F.col(lat) + 90.0) / _size(level)).cast("long"),
            F.pmod(F.floor((F.col(lon) + 180.0) / _size(level)).cast("long"), around))


def _counted_cells(spots: DataFrame) -> DataFrame:
    """(level, cy, cx, n) of all cells with points, added up from the finest ones."""
    cy, cx = _cell("_lat", "_lon", F.lit(DEEPEST))
    finest = spots.groupBy(cy.alias("cy"), cx.alias("cx")).agg(F.count("*").alias("n"))
    level = F.explode(F.sequence(F.lit(0), F.lit(DEEPEST)))
    up = F.pow(F.lit(4), F.lit(DEEPEST) - F.col("level")).cast("long")
    return finest.withColumn("level", level).groupBy(
        "level", F.floor(F.col("cy") / up).alias("cy"), F.floor(F.col("cx") / up).alias("cx")).agg(F.sum("n").alias("n"))


def _edges_km(rows: DataFrame, tile_level: int) -> DataFrame:
    """No point of the cell is nearer than `near` to any place of the tile, or farther than `far`."""
    size, wide = _size(F.col("level")), COARSEST / 4.0 ** tile_level
    south, t_south = F.col("cy") * size - 90.0, F.col("ty") * wide - 90.0
    # the topmost row of cells holds nothing but the pole
    north, t_north = F.least(south + size, F.greatest(south, F.lit(90.0))), F.least(t_south + wide, F.greatest(t_south, F.lit(90.0)))
    off = F.pmod(F.col("tx") * wide - F.col("cx") * size, F.lit(360.0))
    aside = F.when((off <= size) | (off + wide >= 360.0), 0.0).otherwise(F.least(off - size, F.lit(360.0) - off - wide))
    dlat = F.greatest(south - t_north, t_south - north, F.lit(0.0))
    farthest_lat = F.greatest(F.abs(north - t_south), F.abs(t_north - south))
    farthest_lon = F.least(aside + size + wide, F.lit(180.0))

    def cosines(low: Column, high: Column) -> tuple[Column, Column]:
        ends = F.cos(F.radians(low)), F.cos(F.radians(high))
        return F.greatest(F.least(*ends), F.lit(0.0)), F.when((low <= 0) & (high >= 0), 1.0).otherwise(F.greatest(*ends, F.lit(0.0)))

    (narrowest, widest), (t_narrowest, t_widest) = cosines(south, north), cosines(t_south, t_north)
    to_meridian = F.asin(F.least(t_narrowest * F.sin(F.radians(F.least(aside, F.lit(90.0)))), F.lit(1.0)))

    def arc(lat_gap: Column, lon_gap: Column, narrow: Column) -> Column:
        h = F.pow(F.sin(F.radians(lat_gap) / 2), 2) + narrow * F.pow(F.sin(F.radians(lon_gap) / 2), 2)
        return 2 * F.asin(F.sqrt(F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0))))

    # a little more than the rounding of distances
    return rows.withColumns({
        "near": F.greatest(arc(dlat, aside, narrowest * t_narrowest), to_meridian) * K.EARTH_RADIUS_KM - 2e-6,
        "far": arc(farthest_lat, farthest_lon, widest * t_widest) * K.EARTH_RADIUS_KM + 2e-6})


def _still_needed(rows: DataFrame, k: int, tile_level: int) -> DataFrame:
    """Per tile the cells whose near edge is within the far edge of the k-th counted point; `done` if the tile needs no split."""
    tile = Window.partitionBy("ty", "tx")
    upto = tile.orderBy("far", "level", "cy", "cx").rowsBetween(Window.unboundedPreceding, 0)
    counted = _edges_km(rows, tile_level).withColumn("_upto", F.sum("n").over(upto))
    bound = F.min(F.when(F.col("_upto") >= k, F.col("far"))).over(tile)
    kept = counted.withColumn("_bound", bound).where(F.col("_bound").isNull() | (F.col("near") <= F.col("_bound")))
    crowded = (F.col("n") > LEAF) & (F.col("level") < DEEPEST)
    few = F.sum("n").over(tile) <= max(ENOUGH, 4 * k)
    finer = ~F.max(crowded).over(tile) & (F.max("level").over(tile) < tile_level)
    return kept.select(F.lit(tile_level).alias("tl"), "ty", "tx", "asked", "level", "cy", "cx", "n", (
        F.lit(tile_level == DEEPEST) | ((F.col("asked") <= TILE_QUERIES) & (few | finer))).alias("done"))


def _tiles_with_points(queries: DataFrame, points: DataFrame, k: int, point_id: str, lat: str, lon: str) -> DataFrame:
    """(q_lat, q_lon, _near): each distinct query coordinate with the points of its tile's cells, (_id, _lat, _lon, unit vector).

    Tiles of queries descend a tree of counted cells together, one join and one window a level, each level written: what is
    held for a tile does not grow with its queries. A tile keeps the cells that may hold one of the k nearest points of any
    place in it. It is split, as its cells are, until it keeps few points or is smaller than cells that are split no more,
    and while it has many queries, so that no tile is a large join key.
    """
    spots = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(
        F.col(point_id).alias("_id"), F.col(lat).cast("double").alias("_lat"),
        F.col(lon).cast("double").alias("_lon"))
    # Of points on the very same coordinate only the k first ids can be among the k nearest.
    stack = Window.partitionBy("_lat", "_lon").orderBy("_id")
    spots = durable(spots.withColumn("_n", F.row_number().over(stack)).where(F.col("_n") <= k).drop("_n").withColumns(
        dict(zip(("_x", "_y", "_z"), _unit("_lat", "_lon")))), "spots")
    cells = durable(_counted_cells(spots), "cells")
    children = (
        cells.where("level > 0")
        .groupBy((F.col("level") - 1).alias("level"), F.floor(F.col("cy") / 4).alias("cy"), F.floor(F.col("cx") / 4).alias("cx"))
        .agg(F.collect_list(F.struct("level", "cy", "cx", "n")).alias("_below"), F.sum("n").alias("_n"))
        .where(F.col("_n") > LEAF).drop("_n"))
    # at most 9 x 16 cells lie at the top
    top = cells.where("level = 0").agg(F.collect_list(F.struct("level", "cy", "cx", "n"))).scalar()
    asked = durable(queries.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(
        F.col(lat).cast("double").alias("q_lat"), F.col(lon).cast("double").alias("q_lon")).distinct(), "asked")

    def tiles(level: int) -> DataFrame:
        ty, tx = _cell("q_lat", "q_lon", F.lit(level))
        return asked.groupBy(ty.alias("ty"), tx.alias("tx")).agg(F.count("*").alias("asked"))

    def states(level: DataFrame) -> dict[bool, int]:
        return {r["done"]: r["count"] for r in level.groupBy("done").count().collect()}

    levels = [durable(_still_needed(tiles(0).withColumn("_c", F.explode(top)).select("ty", "tx", "asked", "_c.*"), k, 0), "tiles")]
    found = [states(levels[0])]
    while False in found[-1]:
        own = F.array(F.struct("level", "cy", "cx", "n"))
        finer = levels[-1].where("not done").join(children, ["level", "cy", "cx"], "left").select(
            F.col("ty").alias("_ty"), F.col("tx").alias("_tx"), F.explode(F.coalesce("_below", own)).alias("_c"))
        below = tiles(len(levels)).withColumns({"_ty": F.floor(F.col("ty") / 4), "_tx": F.floor(F.col("tx") / 4)})
        # A kept cell unfolds into up to 256 pairs of tile and cell, which no size of files or shuffles tells beforehand.
        split = finer.join(below, ["_ty", "_tx"]).select("ty", "tx", "asked", "_c.*").repartition(
            1 + found[-1][False] // TASK_CELLS, "ty", "tx")
        levels.append(durable(_still_needed(split, k, len(levels)), "tiles"))
        found.append(states(levels[-1]))
    ended = reduce(DataFrame.unionByName, levels).where("done")
    placed = spots.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(len(levels) - 1))))
    cy, cx = _cell("_lat", "_lon", F.col("level"))
    held = ended.join(placed.withColumns({"cy": cy, "cx": cx}), ["level", "cy", "cx"]).groupBy("tl", "ty", "tx").agg(
        F.collect_list(F.struct("_id", "_lat", "_lon", "_x", "_y", "_z")).alias("_near"))
    at = [i for i, seen in enumerate(found) if True in seen]
    ty, tx = _cell("q_lat", "q_lon", F.col("tl"))
    placed_queries = asked.withColumn("tl", F.explode(F.array(*map(F.lit, at or [0])))).withColumns({"ty": ty, "tx": tx})
    return placed_queries.join(held, ["tl", "ty", "tx"]).select("q_lat", "q_lon", "_near")


def _unit(lat: str, lon: str) -> tuple[Column, Column, Column]:
    phi, theta = F.radians(lat), F.radians(lon)
    return F.cos(phi) * F.cos(theta), F.cos(phi) * F.sin(theta), F.sin(phi)


def _distance(lat: Column, lon: Column) -> Column:
    return F.round(C.haversine_km("q_lat", "q_lon", lat, lon), 6)


def nearest_candidates(queries: DataFrame, points: DataFrame, k: int = 1, point_id: str = "mandi_id",
                       lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """(q_lat, q_lon, _id, distance_km, _lat, _lon): all points that are read for each distinct query coordinate."""
    met = _tiles_with_points(queries, points, k, point_id, lat, lon).select("q_lat", "q_lon", F.inline("_near"))
    return met.select("q_lat", "q_lon", "_id", _distance(F.col("_lat"), F.col("_lon")).alias("distance_km"), "_lat", "_lon")


def nearest(queries: DataFrame, points: DataFrame, k: int = 1, point_id: str = "mandi_id",
            lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """The exact k nearest points of every distinct query coordinate: q_lat, q_lon, id, distance_km, rank."""
    met = _tiles_with_points(queries, points, k, point_id, lat, lon)
    # Distances are worked out for those only whose cosine comes up to the k-th.
    at = dict(zip(("q_x", "q_y", "q_z"), _unit("q_lat", "q_lon")))
    met = met.withColumns(at).withColumn("_cosines", F.transform("_near", lambda p: F.nanvl(
        p["_x"] * F.col("q_x") + p["_y"] * F.col("q_y") + p["_z"] * F.col("q_z"), F.lit(-2.0))))
    met = met.withColumn("_kth", F.element_at(F.slice(F.sort_array("_cosines", asc=False), 1, k), -1) - COSINE_SLACK)
    close = F.filter("_near", lambda _, i: F.col("_kth").isNull() | (F.col("_cosines")[i] >= F.col("_kth")))
    ranked = F.slice(F.sort_array(F.transform(close, lambda p: F.struct(
        _distance(p["_lat"], p["_lon"]).alias("distance_km"), p["_id"].alias("_id"), p["_lat"].alias("_lat"),
        p["_lon"].alias("_lon")))), 1, k)
    return met.select("q_lat", "q_lon", F.posexplode(ranked).alias("rank", "_p")).select(
        "q_lat", "q_lon", F.col("_p._id").alias(point_id), F.col("_p._lat").alias("p_lat"),
        F.col("_p._lon").alias("p_lon"), "_p.distance_km", (F.col("rank") + 1).alias("rank"))


def nearest_join(queries: DataFrame, points: DataFrame, k: int = 1, point_id: str = "mandi_id",
                 lat: str = "latitude", lon: str = "longitude", exclude_id: str | None = None,
                 prefix: str = "near_") -> DataFrame:
    """k nearest points per query row; `exclude_id` names the query's own id for a self-join."""
    found = nearest(queries, points, k + (exclude_id is not None), point_id, lat, lon)
    found = found.select(F.col("q_lat"), F.col("q_lon"), F.col(point_id).alias(f"{prefix}id"),
                         F.col("p_lat").alias(f"{prefix}latitude"), F.col("p_lon").alias(f"{prefix}longitude"),
                         "distance_km", "rank")
    joined = queries.join(
        found, (F.col(lat).cast("double") == F.col("q_lat")) & (F.col(lon).cast("double") == F.col("q_lon"))
    ).drop("q_lat", "q_lon")
    if exclude_id is None:
        return joined
    # Among k+1 neighbours at most one is the query itself, so dropping it leaves at least k.
    own = F.col(f"{prefix}id") == F.col(exclude_id)
    return (
        joined.withColumn("_own", F.min(F.when(own, F.col("rank"))).over(Window.partitionBy(exclude_id)))
        .where(~own)
        .withColumn("rank", F.when(F.col("rank") > F.col("_own"), F.col("rank") - 1).otherwise(F.col("rank")))
        .where(F.col("rank") <= k).drop("_own")
    )


def nearest_with_data(queries: DataFrame, points: DataFrame, available: DataFrame, k: int = 1,
                      **names) -> DataFrame:
    """Nearest among the points whose id occurs in `available`."""
    ids = available.select("mandi_id").distinct()
    return nearest_join(queries, points.join(ids, "mandi_id", "left_semi"), k, **names)


def neighbour_means(daily: DataFrame, locations: DataFrame, k: int = 5, value: str = "modal_price",
                    name: str = "nearest5_mandi_avg_price") -> DataFrame:
    """Per series day the mean price of the k nearest other markets that day; none where no neighbour has a price.

    `daily` has one row per series day. Each price goes to the markets that have its market as a neighbour. Few of these have
    the commodity on that day, so the others are left out before means are taken. Series days hardly repeat, so in an
    exchange by them no task has many: the smaller side is hashed there, and what is k times as large needs no sort.
    """
    keys = ["mandi_id", "commodity", "date"]
    near = nearest_join(locations.select("mandi_id", "latitude", "longitude"), locations, k,
                        exclude_id="mandi_id").select(F.col("mandi_id").alias("_for"), "near_id")
    prices = daily.select(F.col("mandi_id").alias("near_id"), "commodity", "date", value)
    met = prices.join(near, "near_id").select(F.col("_for").alias("mandi_id"), "commodity", "date", value)
    return met.join(daily.select(*keys).hint("shuffle_hash"), keys, "left_semi").groupBy(*keys).agg(F.avg(value).alias(name))


def neighbour_average(daily: DataFrame, locations: DataFrame, k: int = 5, value: str = "modal_price",
                      name: str = "nearest5_mandi_avg_price") -> DataFrame:
    daily = durable(daily, "daily")  # three branches read it
    return daily.join(neighbour_means(daily, locations, k, value, name).hint("merge"), ["mandi_id", "commodity", "date"], "left")


def resolve_by_name(requests: DataFrame, locations: DataFrame) -> DataFrame:
    """Market and state, else district and state, else state alone; resolution_type says which one hit."""
    known = locations.select("mandi_id", C.clean_text("state").alias("_s"),
                             C.clean_text("district").alias("_d"), C.clean_text("mandi_name").alias("_m"))

    def first(*keys: str) -> DataFrame:
        name = "_by" + "".join(keys)
        rows = known.where(" and ".join(f"{k} is not null" for k in keys))
        return rows.groupBy(*keys).agg(F.min("mandi_id").alias(name))

    keyed = requests.withColumns({
        "_s": C.clean_text("state"), "_d": C.spaced("district"), "_m": C.spaced("market")})
    joined = (
        keyed.join(first("_s", "_m"), ["_s", "_m"], "left")
        .join(first("_s", "_d"), ["_s", "_d"], "left")
        .join(first("_s"), ["_s"], "left")
    )
    return joined.withColumns({
        "mandi_id": F.coalesce("_by_s_m", "_by_s_d", "_by_s"),
        "resolution_type": F.when(F.col("_by_s_m").isNotNull(), "exact_match")
        .when(F.col("_by_s_d").isNotNull(), "district_fallback")
        .when(F.col("_by_s").isNotNull(), "state_fallback").otherwise("not_found"),
    }).drop("_s", "_d", "_m", "_by_s_m", "_by_s_d", "_by_s")


def resolve(requests: DataFrame, locations: DataFrame) -> DataFrame:
    """By name where that works, by coordinates where it does not."""
    named = resolve_by_name(requests, locations)
    near = nearest(named.where(F.col("mandi_id").isNull()), locations, 1).select(
        "q_lat", "q_lon", F.col("mandi_id").alias("_near"), "p_lat", "p_lon",
        F.round("distance_km", 2).alias("_km"))
    needs = F.col("mandi_id").isNull() & F.col("_near").isNotNull()
    joined = named.join(
        near, F.col("mandi_id").isNull() & (F.col("latitude").cast("double") == F.col("q_lat"))
        & (F.col("longitude").cast("double") == F.col("q_lon")), "left")
    return joined.select(
        *requests.columns,
        F.coalesce("mandi_id", "_near").alias("mandi_id"),
        F.when(needs, "geo_nearest").otherwise(F.col("resolution_type")).alias("resolution_type"),
        F.when(needs, F.col("_km")).alias("mandi_distance_km"))


def snapshot_lookup(requests: DataFrame, snapshot: DataFrame, features: Sequence[str]) -> DataFrame:
    """The market's own row for the commodity, else the first market of the same state that has one."""
    keyed = snapshot.withColumns({"_key": C.canonical_key("mandi_id"), "_c": C.clean_text("commodity"),
                                  "_s": C.canonical_key("state")})
    packed = F.struct(*features)
    own = keep_first(keyed, ["_key", "_c"], ["mandi_id"]).select("_key", "_c", packed.alias("_own"))
    state = keep_first(keyed, ["_s", "_c"], [F.length("mandi_id"), F.col("mandi_id")]).select(
        "_s", "_c", packed.alias("_state"), F.col("mandi_id").alias("_state_id"))
    joined = (
        requests.withColumns({"_key": C.canonical_key("mandi_id"), "_c": C.clean_text("commodity"),
                              "_s": C.canonical_key("mandi_state")})
        .join(own, ["_key", "_c"], "left").join(state, ["_s", "_c"], "left")
        .withColumn("_row", F.coalesce("_own", "_state"))
    )
    return joined.select(
        *requests.columns, *[F.col("_row")[f].alias(f) for f in features],
        F.when(F.col("_own").isNotNull(), "market").when(F.col("_state").isNotNull(), "state")
        .otherwise("none").alias("snapshot_match"))
