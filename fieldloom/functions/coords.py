"""Coordinates: reading scanned ones, distances, and validation against boxes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions import vocabulary as V
from fieldloom.functions.names import blank
from fieldloom.functions.places import state_box


def to_double(c: Column | str) -> Column:
    """A number or null; zero is a number."""
    text = blank(c)
    return F.when(text != "", text).try_cast("double")


def fixed_scan(c: Column | str) -> Column:
    """The text with scanning errors of coordinates repaired."""
    text = blank(c)
    for pattern, instead in V.COORDINATE_FIXES:
        text = F.regexp_replace(text, pattern, instead)
    return text


def sign_of(hemisphere: Column) -> Column:
    return F.when(F.upper(hemisphere).isin("S", "W"), -1.0).otherwise(1.0)


def plausible(degrees: Column, hemisphere: Column) -> Column:
    return F.when(F.upper(hemisphere).isin("E", "W"), degrees.between(-180, 180)).otherwise(degrees.between(-90, 90))


def parse_degrees(c: Column | str) -> Column:
    """Decimal degrees of a coordinate in degrees and minutes or in decimals, to 7 places; else null."""
    text = fixed_scan(c)
    part = lambda i: F.regexp_extract(text, V.DMS, i)
    number = lambda x: F.coalesce(F.when(x != "", x).try_cast("double"), F.lit(0.0))
    side = F.upper(F.coalesce(F.nullif(part(1), F.lit("")), part(5)))
    sexagesimal = (number(part(2)) + number(part(3)) / 60 + number(part(4)) / 3600) * sign_of(side)
    dec = lambda i: F.regexp_extract(text, V.DECIMAL_DEGREES, i)
    dec_side = F.upper(F.coalesce(F.nullif(dec(1), F.lit("")), dec(4)))
    decimal = dec(3).try_cast("double") * F.when(dec(2) == "", 1.0).otherwise(-1.0) * sign_of(dec_side)
    return F.round(F.coalesce(F.when((part(2) != "") & plausible(sexagesimal, side), sexagesimal), F.when((dec(3) != "") & plausible(decimal, dec_side), decimal)), 7)


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float], margin: float = 0.0) -> Column:
    return lat.between(box[0] - margin, box[1] + margin) & lon.between(box[2] - margin, box[3] + margin)


def is_marine(*texts: Column | str) -> Column:
    """Whether any of the texts tells of the sea."""
    text = F.lower(F.concat_ws(" ", *[blank(t) for t in texts]))
    return text.rlike("|".join(V.MARINE_WORDS))


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0088 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def checked(lat: Column, lon: Column, context: Column, locality: Column) -> Column:
    """struct(lat, lon, note): coordinates that hold, or nulls and why they do not.

    Rules in order: valid range; the country's box, else a neighbour's or a marine
    context; open ocean without a marine context; the box of the state that the
    locality text names, with a margin.
    """
    home = in_box(lat, lon, V.COUNTRY_BOX)
    near = reduce(lambda a, b: a | b, (in_box(lat, lon, b) for b in V.NEIGHBOUR_BOXES.values()))
    sea = is_marine(context)
    state, m = state_box(locality), V.STATE_BOX_MARGIN
    in_state = lat.between(state["a"] - m, state["b"] + m) & lon.between(state["c"] - m, state["d"] + m)
    note = (
        F.when(lat.isNull() | lon.isNull(), None)
        .when(~lat.between(-90, 90), "INVALID_RANGE lat")
        .when(~lon.between(-180, 180), "INVALID_RANGE lon")
        .when(~home & ~sea & ~near, "OUTSIDE_COUNTRY_BOX")
        .when(~home & ~sea & in_box(lat, lon, V.OCEAN_BOX), "POSSIBLE_OCEAN")
        .when(state.isNotNull() & ~in_state, F.concat(F.lit("OUTSIDE_STATE_BOX "), state["name"]))
    )
    kept = note.isNull() & lat.isNotNull() & lon.isNotNull()
    shown = F.coalesce(note, F.when(kept & ~home & sea, "MARINE_OFFSHORE_ALLOWED"))
    return F.struct(F.when(kept, lat).alias("lat"), F.when(kept, lon).alias("lon"), shown.alias("note"))


def cell(lat: Column, lon: Column, degrees: float) -> Column:
    """struct(y, x) of the grid cell that a point lies in."""
    return F.struct(F.floor(lat / degrees).cast("int").alias("y"), F.floor(lon / degrees).cast("int").alias("x"))
