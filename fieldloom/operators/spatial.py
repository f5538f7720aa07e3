"""Points in polygons and nearest places, by a grid of cells."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions import coords


def covering_cells(box: tuple[Column, Column, Column, Column], degrees: float) -> Column:
    """Grid cells that a box (lat_min, lat_max, lon_min, lon_max) touches."""
    rows = F.sequence(F.floor(box[0] / degrees).cast("int"), F.floor(box[1] / degrees).cast("int"))
    cols = F.sequence(F.floor(box[2] / degrees).cast("int"), F.floor(box[3] / degrees).cast("int"))
    return F.flatten(F.transform(rows, lambda y: F.transform(cols, lambda x: F.struct(y.alias("y"), x.alias("x")))))


def ring_contains(lat: float, lon: float, ring) -> bool:
    """Whether a point lies in a ring of (y, x) corners, by counting crossings."""
    inside = False
    for a, b in zip(ring, [*ring[1:], ring[0]], strict=True):
        if (a["y"] > lat) != (b["y"] > lat) and lon < (b["x"] - a["x"]) * (lat - a["y"]) / (b["y"] - a["y"]) + a["x"]:
            inside = not inside
    return inside


@F.pandas_udf(T.BooleanType())
def _contains(lat: pd.Series, lon: pd.Series, ring: pd.Series) -> pd.Series:
    return pd.Series([ring_contains(a, b, list(r)) for a, b, r in zip(lat, lon, ring, strict=True)], dtype="bool")


def points_in_polygons(points: DataFrame, polygons: DataFrame, lat: str, lon: str, degrees: float = 0.5) -> DataFrame:
    """points with the columns of every polygon that holds them.

    polygons: ring, array<struct<y, x>>, and other columns. Cells bring a point
    together with polygons whose box touches its cell; the box, then the ring decide.
    """
    ys, xs = F.transform("ring", lambda p: p["y"]), F.transform("ring", lambda p: p["x"])
    box = [F.array_min(ys), F.array_max(ys), F.array_min(xs), F.array_max(xs)]
    cells = polygons.withColumn("__box", F.struct(*[b.alias(n) for n, b in zip(("a", "b", "c", "d"), box, strict=True)])).withColumn("__cell", F.explode(covering_cells((F.col("__box.a"), F.col("__box.b"), F.col("__box.c"), F.col("__box.d")), degrees)))
    joined = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).withColumn("__cell", coords.cell(F.col(lat), F.col(lon), degrees)).join(cells, "__cell")
    near = joined.where(F.col(lat).between(F.col("__box.a"), F.col("__box.b")) & F.col(lon).between(F.col("__box.c"), F.col("__box.d")))
    return near.where(_contains(F.col(lat), F.col(lon), F.col("ring"))).select(*points.columns, *[c for c in polygons.columns if c != "ring"])


def nearest_places(points: DataFrame, places: DataFrame, key: list[str], lat: str, lon: str, k: int = 3, within_km: float = 25.0) -> DataFrame:
    """The k places nearest to each point, none beyond ``within_km``: points, place columns, km, confidence, nth.

    places: place_lat, place_lon and other columns. Cells are as high as the
    reach; towards the poles a reach spans more columns of cells, so a point asks
    as many as its latitude needs. Confidence falls from 1 to 0 over the reach.
    """
    degrees = within_km / 111.0
    cells = places.withColumn("__cell", coords.cell(F.col("place_lat"), F.col("place_lon"), degrees))
    wide = F.ceil(1 / F.greatest(F.cos(F.radians(F.least(F.abs(F.col(lat)) + degrees, F.lit(89.0)))), F.lit(0.02))).cast("int")
    home = coords.cell(F.col(lat), F.col(lon), degrees)
    around = F.flatten(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda y: F.transform(F.sequence(-wide, wide), lambda x: F.struct((home["y"] + y).alias("y"), (home["x"] + x).alias("x")))))
    asked = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).withColumn("__cell", F.explode(around))
    km = coords.distance_km(F.col(lat), F.col(lon), F.col("place_lat"), F.col("place_lon"))
    hits = asked.join(cells, "__cell").withColumn("km", km).where(F.col("km") <= within_km)
    # sorted lists of at most k are kept per point and task
    fields = [c for c in places.columns]
    ranked = hits.groupBy(*key, lat, lon).agg(F.slice(F.sort_array(F.collect_list(F.struct("km", *fields))), 1, k).alias("__near"))
    out = ranked.select(*key, lat, lon, F.posexplode("__near").alias("n", "p"))
    return out.select(*key, lat, lon, *[F.col(f"p.{c}").alias(c) for c in fields], F.col("p.km").alias("km"), F.round(1 - F.col("p.km") / within_km, 4).alias("confidence"), (F.col("n") + 1).alias("nth"))


def locate_or_nearest(points: DataFrame, polygons: DataFrame, places: DataFrame, key: list[str], lat: str, lon: str, within_km: float = 25.0) -> DataFrame:
    """key, village, method: the polygon that holds the point, else the nearest place, else out of bounds.

    polygons and places: village and their geometry.
    """
    inside = points_in_polygons(points, polygons.select("ring", "village"), lat, lon).groupBy(*key).agg(F.min("village").alias("__in"))
    near = nearest_places(points, places.select("place_lat", "place_lon", "village"), key, lat, lon, 1, within_km).select(*key, F.col("village").alias("__near"))
    out = points.select(*key).distinct().join(inside, key, "left").join(near, key, "left")
    return out.select(*key, F.coalesce("__in", "__near").alias("village"), F.when(F.col("__in").isNotNull(), "contains").when(F.col("__near").isNotNull(), "nearest").otherwise("out_of_bounds").alias("method"))
