"""Lookups against reference tables: exact, ordered cascades, gazetteers and place stages.

Distinct keys are looked up once and joined back. Reference tables are plain
join sides; Spark broadcasts them only below its own size threshold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import coords, places, text
from fieldloom.functions.names import blank, squeeze
from fieldloom.operators import similarity
from fieldloom.session import Workspace


def fill_blanks(df: DataFrame, reference: DataFrame, on: list[str], fields: list[str]) -> DataFrame:
    """df with blank fields taken from the reference, which has one row per key."""
    ref = reference.select(*on, *[F.col(f).alias(f"__{f}") for f in fields])
    joined = df.join(ref, on, "left")
    return joined.withColumns({f: F.coalesce(F.nullif(F.trim(F.col(f).cast("string")), F.lit("")).cast(joined.schema[f].dataType), F.col(f"__{f}")) for f in fields}).select(*df.columns)


def unmatched(df: DataFrame, reference: DataFrame, on: list[str]) -> DataFrame:
    """Distinct keys of df that the reference lacks."""
    return df.select(*on).distinct().join(reference.select(*on), on, "left_anti")


def fresh(cache: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Cache entries no older than ``days``, misses among them."""
    return cache.where(F.col("cached_at") > now - F.expr(f"INTERVAL {days} DAYS"))


def to_ask(df: DataFrame, cache: DataFrame, name: str, now: Column, days: int = 90) -> DataFrame:
    """Distinct name keys that the fresh part of a cache (name_key, cached_at, ...) does not answer."""
    asked = df.select(squeeze(name).alias("name_key")).where("name_key <> ''").distinct()
    return asked.join(fresh(cache, now, days).select("name_key"), "name_key", "left_anti")


def resolve_names(asked: DataFrame, sources: dict[str, DataFrame], fields: list[str]) -> DataFrame:
    """name_key with each field from the first source that has it, and ``sources`` that know the name.

    asked: name_key. sources, best first: name_key (unique) and any of the fields.
    """
    out = asked.select("name_key").distinct()
    for tag, ref in sources.items():
        cols = [F.col(f).alias(f"{tag}__{f}") for f in fields if f in ref.columns]
        out = out.join(ref.select("name_key", *cols, F.lit(tag).alias(f"{tag}__known")), "name_key", "left")
    pick = lambda f: F.coalesce(*[F.nullif(F.trim(F.col(f"{t}__{f}").cast("string")), F.lit("")) for t, r in sources.items() if f in r.columns])
    known = F.array_compact(F.array(*[F.col(f"{t}__known") for t in sources]))
    return out.select("name_key", *[pick(f).alias(f) for f in fields], known.alias("sources"))


def verify_records(df: DataFrame, taxa: DataFrame, fields: list[str], least: float = 0.60) -> DataFrame:
    """df with taxonomy filled from taxa (name_key, confidence, fields), where it is confident enough.

    Records it does not verify keep their values and are marked unverified.
    """
    ref = taxa.select("name_key", F.col("confidence").alias("__confidence"), *[F.col(f).alias(f"__{f}") for f in fields])
    key = squeeze(F.coalesce(F.nullif(blank("recordedName"), F.lit("")), "validName"))
    joined = df.withColumn("name_key", key).join(ref, "name_key", "left")
    sure = F.coalesce(F.col("__confidence"), F.lit(0.0)) >= least
    filled = {f: F.when(sure, F.coalesce(F.col(f"__{f}"), F.col(f))).otherwise(F.col(f)) for f in fields}
    return joined.withColumns(filled | {"confidence": F.coalesce(F.col("__confidence"), F.lit(0.0)), "taxonomicStatus": F.when(sure, F.coalesce(F.nullif(blank("taxonomicStatus"), F.lit("")), F.lit("accepted"))).otherwise("unverified")}).select(*df.columns, *[c for c in ("confidence",) if c not in df.columns], *[c for c in ("taxonomicStatus",) if c not in df.columns])


def cascade(keys: DataFrame, key: str, stages: list[tuple[str, DataFrame]], fields: list[str]) -> DataFrame:
    """key, fields, stage: the first stage that knows a key answers; null where none does.

    stages, in order: (name, table with key, unique, and fields). A stage is
    joined with what earlier ones missed, so dear stages see few rows.
    """
    left, parts = keys.select(key).distinct(), []
    for name, table in stages:
        hit = left.join(table.select(key, *fields), key).withColumn("stage", F.lit(name))
        parts.append(hit)
        left = left.join(table.select(key), key, "left_anti")
    empty = left.select(key, *[F.lit(None).cast(parts[0].schema[f].dataType).alias(f) for f in fields], F.lit(None).cast("string").alias("stage"))
    return reduce(DataFrame.unionByName, [*parts, empty])


def place_index(table: DataFrame, order: list[str]) -> DataFrame:
    """A place table with its normal, canonical and phonetic keys. order: what makes a row first."""
    return table.withColumns({"norm_key": places.normal_place("place_name"), "canon_key": places.canonical_place("place_name"), "sound_key": places.phonetic_place("place_name"), "__order": F.struct(*[F.col(c) for c in order])})


def match_places(queries: DataFrame, query: str, index: DataFrame, fuzzy: float = 80.0, fuzzy_short: float = 92.0) -> DataFrame:
    """One row per distinct query: place, codes and coordinates, match_type and score; nulls if nothing matches.

    The index is written, so that its keys are worked out once a place, and each stage, so that it runs once, over what the one before missed: exact (100), canonical (95),
    fuzzy on canonical keys (its score; keys of up to four letters must be more
    alike), phonetic (75), postal code in the query (90).
    """
    fields = ["place_name", "postal_code", "state_name", "county_name", "latitude", "longitude"]
    work = Workspace(queries.sparkSession, "places")
    # read from a lazy index, a key's filter would work the key out for every row that the index was grouped from
    index = work.save(index.select(*fields, "norm_key", "canon_key", "sound_key", "__order"), "index")
    one = lambda key, pick=F.min_by: index.where(F.col(key) != "").groupBy(key).agg(pick(F.struct(*fields), F.col("__order")).alias("hit"))
    by_canon = work.save(one("canon_key"), "by_canon")
    left = queries.select(F.col(query).alias("query")).where("query IS NOT NULL").distinct()
    left = left.withColumns({"norm_key": places.normal_place("query"), "canon_key": places.canonical_place("query"), "sound_key": places.phonetic_place("query")})
    left, parts = work.save(left, "asked"), []

    def stage(name: str, hits: DataFrame):
        nonlocal left
        hits = work.save(hits.select("query", "hit.*", F.lit(name).alias("match_type"), "score"), name)
        parts.append(hits)
        left = work.save(left.join(hits.select("query"), "query", "left_anti"), f"after_{name}")

    stage("exact", left.join(one("norm_key"), "norm_key").withColumn("score", F.lit(100.0)))
    stage("canonical", left.join(by_canon, "canon_key").withColumn("score", F.lit(95.0)))
    alike = similarity.best_similar(left, by_canon, "canon_key", "canon_key", fuzzy, "token_sort")
    alike = alike.where((F.length("left_key") > 4) | (F.col("score") >= fuzzy_short)).withColumnRenamed("left_key", "canon_key")
    stage("fuzzy", left.join(alike, "canon_key").join(by_canon.select(F.col("canon_key").alias("right_key"), "hit"), "right_key"))
    stage("phonetic", left.join(one("sound_key"), "sound_key").withColumn("score", F.lit(75.0)))
    codes = left.select("query", F.posexplode(text.matches("query", r"\b([1-9]\d{5})\b", 1)).alias("at", "postal_code"))
    by_code = codes.join(one("postal_code", F.max_by), "postal_code").groupBy("query").agg(F.min_by("hit", "at").alias("hit"))
    stage("code", by_code.withColumn("score", F.lit(90.0)))
    return reduce(DataFrame.unionByName, parts).unionByName(left.select("query"), allowMissingColumns=True)


def locate_records(df: DataFrame, matched: DataFrame, query: str = "verbatimLocality", overwrite: bool = False) -> DataFrame:
    """df with coordinates and source of its matched place; known ones are kept unless told to overwrite."""
    hit = matched.where("match_type IS NOT NULL").select(F.col("query").alias("__q"), F.col("latitude").alias("__lat"), F.col("longitude").alias("__lon"), places.source_tag(F.col("match_type"), F.col("score")).alias("__tag"))
    joined = df.join(hit, F.col(query) == F.col("__q"), "left")
    use = F.col("__lat").isNotNull() & (F.lit(overwrite) | F.col("decimalLatitude").isNull() | F.col("decimalLongitude").isNull())
    return joined.withColumns({"decimalLatitude": F.when(use, F.col("__lat")).otherwise(F.col("decimalLatitude")), "decimalLongitude": F.when(use, F.col("__lon")).otherwise(F.col("decimalLongitude")), "geocodingSource": F.when(use, F.col("__tag")).otherwise(F.col("geocodingSource"))}).select(*df.columns)


def explain_match(matched: DataFrame) -> DataFrame:
    """matched with how each query was resolved, as text."""
    head = F.concat(F.lit("Query: "), "query", F.lit("\nNormalised: "), places.normal_place("query"), F.lit("\nCanonical: "), places.canonical_place("query"))
    hit = F.concat(F.lit("\nStage: "), "match_type", F.lit(" (score="), F.format_number("score", 1), F.lit(")\nMatched: "), "place_name", F.lit(" ("), F.coalesce("postal_code", F.lit("-")), F.lit(")"))
    return matched.withColumn("explanation", F.concat(head, F.coalesce(hit, F.lit("\nResult: no match"))))


def rank_gazetteer(hits: DataFrame, query: str, feature: str = "feature_class", population: str = "population") -> DataFrame:
    """The best hit per query: populated place, then administrative, then water, then the rest; larger population first."""
    order = F.when(F.col(feature) == "P", 0).when(F.col(feature) == "A", 1).when(F.col(feature) == "H", 2).otherwise(3)
    rest = F.struct(order, -F.coalesce(F.col(population), F.lit(0)), *[F.col(c) for c in hits.columns if c not in (query, feature, population)])
    return hits.groupBy(query).agg(F.min_by(F.struct(*[F.col(c) for c in hits.columns if c != query]), rest).alias("hit")).select(query, "hit.*")


def gazetteer_hits(queries: DataFrame, query: str, gazetteer: DataFrame, alternates: str = "alternatenames") -> DataFrame:
    """Gazetteer rows whose name, plain name or one of the alternate names is the query; rows are not repeated."""
    asked = queries.select(F.lower(blank(query)).alias("query")).where("query <> ''").distinct()
    spelled = gazetteer.select("*", F.explode(F.array_distinct(F.concat(F.array(F.lower("name"), F.lower("asciiname")), F.transform(F.coalesce(F.col(alternates), F.array().cast("array<string>")), F.lower)))).alias("query"))
    return asked.join(spelled, "query")


def admin_names(gazetteer: DataFrame) -> DataFrame:
    """gazetteer with the name of each row's district, from the district's own row by its codes."""
    district = gazetteer.where("feature_code = 'ADM2'").groupBy("admin1_code", "admin2_code").agg(F.min("name").alias("district"))
    return gazetteer.join(district, ["admin1_code", "admin2_code"], "left")


def exact_then_prefix(queries: DataFrame, query: str, gazetteer: DataFrame, fields: list[str]) -> DataFrame:
    """Gazetteer row of the exact name, else of the least name that starts with the query's first word."""
    asked = queries.select(F.col(query).alias("query"), F.lower(places.core_place(query)).alias("__k"), F.lower(F.regexp_extract(places.core_place(query), r"^([A-Za-z]{4,})", 1)).alias("__w")).where("query IS NOT NULL").distinct()
    rows = gazetteer.select(F.lower("name").alias("__name"), F.lower(F.regexp_extract("name", r"^([A-Za-z]{4,})", 1)).alias("__first"), F.struct(*fields).alias("hit"))
    exact = rows.groupBy("__name").agg(F.min("hit").alias("hit")).withColumnRenamed("__name", "__k")
    prefix = rows.where("__first <> ''").groupBy("__first").agg(F.min_by("hit", "__name").alias("hit")).withColumnRenamed("__first", "__w")
    first = asked.join(exact, "__k").withColumn("stage", F.lit("exact"))
    second = asked.join(exact.select("__k"), "__k", "left_anti").join(prefix, "__w").withColumn("stage", F.lit("prefix"))
    return first.select("query", "hit.*", "stage").unionByName(second.select("query", "hit.*", "stage"))


def resolve_villages(queries: DataFrame, query: str, context: str, villages: DataFrame, threshold: float = 82.0) -> DataFrame:
    """Village, district and state of each distinct (query, context): exact (100), alike, else one of its words (75).

    Of villages of one name the one whose state or district the text or context
    names, else the first.
    """
    v = villages.select(F.lower(blank("village")).alias("village_key"), "village", "district", "state").where("village_key <> ''").distinct()
    asked = queries.select(F.col(query).alias("query"), F.col(context).alias("context"), squeeze(query).alias("key")).where("key <> ''").distinct()
    exact = asked.join(v.select("village_key").distinct(), F.col("key") == F.col("village_key")).select("query", "context", "village_key", F.lit(100.0).alias("score"))
    left = asked.join(exact.select("query", "context"), ["query", "context"], "left_anti")
    alike = similarity.best_similar(left, v, "key", "village_key", threshold, "token_set")
    fuzzy = left.join(alike.withColumnRenamed("left_key", "key"), "key").select("query", "context", F.col("right_key").alias("village_key"), "score")
    left = left.join(fuzzy.select("query", "context"), ["query", "context"], "left_anti")
    words = left.select("query", "context", F.posexplode(text.matches("key", "[a-z]{3,}")).alias("at", "village_key"))
    token = words.join(v.select("village_key").distinct(), "village_key").groupBy("query", "context").agg(F.min_by("village_key", "at").alias("village_key")).withColumn("score", F.lit(75.0))
    hits = exact.unionByName(fuzzy).unionByName(token).join(v, "village_key")
    told = F.lower(F.concat_ws(" ", "query", "context"))
    named = F.contains(told, F.lower(F.coalesce("state", F.lit("\0")))) | F.contains(told, F.lower(F.coalesce("district", F.lit("\0"))))
    return hits.groupBy("query", "context").agg(F.min_by(F.struct("village", "district", "state", "score"), F.struct(~named, "state", "district")).alias("m")).select("query", "context", "m.*")


def enrich_localities(df: DataFrame, resolved: DataFrame, place: str = "verbatimLocality") -> DataFrame:
    """df with "place, X District, State" of its resolved village."""
    admin = resolved.groupBy("query").agg(F.min(F.struct("district", "state")).alias("__a")).withColumnRenamed("query", "__q")
    joined = df.join(admin, F.col(place) == F.col("__q"), "left")
    return joined.withColumn("enriched_locality", places.enriched_place(F.col(place), F.col("__a.district"), F.col("__a.state"))).select(*df.columns, "enriched_locality")


def split_records(df: DataFrame, known: DataFrame, place: str = "verbatimLocality") -> DataFrame:
    """Records at several sites as one record per site, if two or more of the sites are known places.

    known: one column of place names. Records with fewer known sites stay whole.
    """
    rows = df.withColumn("__id", F.monotonically_increasing_id()) if "__id" not in df.columns else df
    parts = rows.select("__id", F.posexplode(places.split_compound(place)).alias("__at", "__part"))
    names_ = known.select(F.lower(blank(known.columns[0])).alias("__known")).distinct()
    valid = parts.join(names_, F.lower(F.col("__part")) == F.col("__known")).groupBy("__id").agg(F.sort_array(F.collect_list(F.struct("__at", "__part"))).alias("__parts"))
    joined = rows.join(valid, "__id", "left")
    sites = F.when(F.size("__parts") >= 2, F.transform("__parts", lambda p: p["__part"])).otherwise(F.array(F.col(place)))
    return joined.withColumn("__site", F.explode(sites)).withColumn(place, F.col("__site")).select(*df.columns)


def station_map(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stations that a methods text defines: doc, station, site, latitude, longitude."""
    found = docs.select(id_col, F.explode(text.matches(text_col, r"(?i)(?:station|stn|st|site)\.?\s*([A-Z]?\d+)\s*\(([^)]+)\)", 0)).alias("told"))
    pattern = r"(?i)(?:station|stn|st|site)\.?\s*([A-Z]?\d+)\s*\(([^)]+)\)"
    inner = F.regexp_extract("told", pattern, 2)
    number = lambda side: F.regexp_extract(inner, rf"(\d{{1,3}}\.\d+)\s*°?\s*{side}", 1).try_cast("double")
    return found.select(id_col, F.upper(F.regexp_extract("told", pattern, 1)).alias("station"), F.trim(F.regexp_replace(F.regexp_replace(inner, r"\d{1,3}\.\d+\s*°?\s*[NSEWnsew]", ""), r"[,;\s]+$", "")).alias("site"), number("N").alias("latitude"), number("E").alias("longitude")).dropDuplicates([id_col, "station"])


def resolve_stations(df: DataFrame, stations: DataFrame, id_col: str = "doc_id", place: str = "verbatimLocality") -> DataFrame:
    """Station ids among localities replaced by their sites, with coordinates where those are missing."""
    station = F.upper(F.regexp_extract(blank(place), r"(?i)^(?:station|stn|st|site)?\.?\s*([A-Z]?\d+)$", 1))
    s = stations.select(F.col(id_col).alias("__doc"), F.col("station").alias("__station"), F.col("site").alias("__site"), F.col("latitude").alias("__lat"), F.col("longitude").alias("__lon"))
    joined = df.join(s, (F.col(id_col) == F.col("__doc")) & (station == F.col("__station")), "left")
    return joined.withColumns({place: F.coalesce("__site", F.col(place)), "decimalLatitude": F.coalesce("decimalLatitude", "__lat"), "decimalLongitude": F.coalesce("decimalLongitude", "__lon")}).select(*df.columns)


def locate_cascade(df: DataFrame, stages: list[tuple[str, DataFrame]], place: str = "verbatimLocality") -> DataFrame:
    """Coordinates from the first stage that knows a record's locality, and the stage as their source.

    stages: (name, table of place_key, latitude, longitude with unique keys).
    Coordinates given as text are read first; known ones are kept.
    """
    df = df.withColumns({c: F.coalesce(F.col(c).try_cast("double"), coords.parse_degrees(F.col(c).cast("string"))) for c in ("decimalLatitude", "decimalLongitude")})
    need = df.where(F.col("decimalLatitude").isNull() | F.col("decimalLongitude").isNull()).select(places.normal_place(place).alias("place_key")).where("place_key <> ''")
    hits = cascade(need, "place_key", stages, ["latitude", "longitude"]).where("stage IS NOT NULL")
    joined = df.withColumn("place_key", places.normal_place(place)).join(hits, "place_key", "left")
    blankc = F.col("decimalLatitude").isNull() | F.col("decimalLongitude").isNull()
    use = blankc & F.col("stage").isNotNull()
    return joined.withColumns({"decimalLatitude": F.when(use, F.col("latitude")).otherwise(F.col("decimalLatitude")), "decimalLongitude": F.when(use, F.col("longitude")).otherwise(F.col("decimalLongitude")), "geocodingSource": F.when(use, F.col("stage")).otherwise(F.col("geocodingSource"))}).select(*df.columns)
