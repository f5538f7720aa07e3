"""Checklists, statistics, boxes, timelines and other groupings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import citations
from fieldloom.functions.names import blank
from fieldloom.session import Workspace


def checklist(atoms: DataFrame, fields: list[str], seq: Column, where: Column | None = None) -> DataFrame:
    """Per valid name: records, localities, greatest confidence, and the fields of the record that has it.

    Among records of equal confidence the first by ``seq`` gives the fields.
    """
    rows = atoms.where(where) if where is not None else atoms
    out = rows.groupBy("valid_name").agg(F.count(F.lit(1)).alias("n_records"), F.count_distinct("locality").alias("n_localities"), F.max("confidence").alias("max_confidence"), F.min_by(F.struct(*fields), F.struct(-F.col("confidence"), seq)).alias("__row"))
    return out.select("valid_name", "__row.*", "n_records", "n_localities", "max_confidence")


def distinct_counts(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """One row with the number of distinct values of each column."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[count(c).alias(c) for c in columns])


def session_summary(df: DataFrame, session: str, fields: list[str], shown: int = 10) -> DataFrame:
    """Per session: records, and for each field its distinct values counted and the first ``shown`` of them listed."""
    values = [F.sort_array(F.collect_set(F.nullif(blank(f), F.lit("")))).alias(f) for f in fields]
    lists = df.groupBy(session).agg(F.count(F.lit(1)).alias("n_records"), *values)
    return lists.select(session, "n_records", *[F.size(f).cast("long").alias(f"n_{f}") for f in fields], *[F.array_join(F.slice(f, 1, shown), ", ").alias(f"{f}_list") for f in fields])


def group_counts(df: DataFrame, by: list[str], total: bool = False) -> DataFrame:
    """Rows per group; with ``total``, one more row of nulls that counts all."""
    return (df.rollup(*by) if total else df.groupBy(*by)).agg(F.count(F.lit(1)).alias("n"))


def bounding_boxes(df: DataFrame, by: list[str], lat: str, lon: str, margin: float = 0.0) -> DataFrame:
    """Per group the box of its points, widened by a margin, and how many they are."""
    located = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    return located.groupBy(*by).agg((F.min(lat) - margin).alias("lat_min"), (F.max(lat) + margin).alias("lat_max"), (F.min(lon) - margin).alias("lon_min"), (F.max(lon) + margin).alias("lon_max"), F.count(F.lit(1)).alias("n"))


def grow_boxes(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """Boxes of old and new groups, each covering both, counts added."""
    return old.unionByName(new).groupBy(*by).agg(F.min("lat_min").alias("lat_min"), F.max("lat_max").alias("lat_max"), F.min("lon_min").alias("lon_min"), F.max("lon_max").alias("lon_max"), F.sum("n").alias("n"))


def completeness_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """field, n_filled, n_total, pct: how many rows have each column filled."""
    filled = lambda c: F.count_if(F.trim(F.col(c).cast("string")) != "").alias(f"f{c}")
    one = df.agg(F.count(F.lit(1)).alias("n_total"), *[filled(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"f{c}").alias("n_filled")) for c in columns])
    return one.select("n_total", F.explode(rows).alias("r")).select("r.field", "r.n_filled", "n_total", F.when(F.col("n_total") > 0, F.round(100.0 * F.col("r.n_filled") / F.col("n_total"), 2)).otherwise(0.0).alias("pct"))


def shares(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row: all rows, and for each condition how many meet it and their percentage."""
    n = F.count(F.lit(1))
    return df.agg(n.alias("n"), *[F.count_if(c).alias(f"n_{k}") for k, c in conditions.items()], *[F.round(100.0 * F.count_if(c) / n, 1).alias(f"pct_{k}") for k, c in conditions.items()])


def temporal_index(df: DataFrame, species: str, sampling: Column, citation: Column, role: Column) -> DataFrame:
    """Per species: first and last year, first primary and first secondary year, and the distinct (year, role) pairs.

    A record counts at its sampling year, else its citation's publication year.
    Years are read once for all records that tell the same.
    """
    told = df.select(species, sampling.alias("__s"), citation.alias("__c"), F.when(blank(role).isin("", "Primary", "primary"), "primary").otherwise("secondary").alias("role")).distinct()
    year = F.coalesce(citations.sampling_year("__s"), citations.publication_year("__c"))
    rows = told.select(species, year.alias("year"), "role")
    of = lambda role: F.min(F.when(F.col("role") == role, F.col("year")))
    pairs = F.sort_array(F.collect_set(F.when(F.col("year").isNotNull(), F.struct("year", "role"))))
    out = rows.groupBy(species).agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), of("primary").alias("first_primary"), of("secondary").alias("first_secondary"), pairs.alias("years"))
    # asked of the groups: asked of the records, it would be pushed down to the scan and read every year twice
    return out.where("first_year IS NOT NULL")


def timeline(df: DataFrame, species: str, sampling_year: Column, publication_year: Column) -> DataFrame:
    """species, year, kind, n: sampling and publication entries."""
    some = lambda y, k: df.select(species, y.alias("year"), F.lit(k).alias("kind")).where("year IS NOT NULL")
    return some(sampling_year, "sampling").unionByName(some(publication_year, "publication")).groupBy(species, "year", "kind").agg(F.count(F.lit(1)).alias("n"))


def occurrence_role(df: DataFrame, species: str, role: str) -> DataFrame:
    """primary where any record of a species is primary or does not say; else secondary."""
    first = F.bool_or(F.lower(blank(role)).isin("", "primary"))
    return df.groupBy(species).agg(F.when(first, "primary").otherwise("secondary").alias("role"))


def values_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """Per key its distinct values in order, and how many."""
    return df.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias("values")).withColumn("n", F.size("values"))


def level_counts(chunks: DataFrame, doc: str) -> DataFrame:
    """Per document: chunks of each level and how many have a signal."""
    at = lambda k: F.count_if(F.col("level") == k)
    return chunks.groupBy(doc).agg(at(0).alias("sections"), at(1).alias("paragraphs"), at(2).alias("sentences"), F.count_if(F.col("has_species")).alias("with_species"), F.count_if(F.col("has_locality")).alias("with_locality"))


def store_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("species").alias("species"), F.count_distinct(F.when(F.col("dirty"), F.col("species"))).alias("dirty_species"))


def stage_counts(events: DataFrame, species: str, order: list[str]) -> DataFrame:
    """Species per furthest stage reached. events: species, stage."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("stage"))
    last = events.groupBy(species).agg(F.max_by("stage", rank).alias("stage"))
    return last.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


def distribution(df: DataFrame, species: str, country: str, state: str, locality: str) -> DataFrame:
    """species, region, localities: places grouped by country and state, or by nothing where those are blank."""
    region = F.coalesce(F.nullif(F.concat_ws(", ", F.nullif(blank(country), F.lit("")), F.nullif(blank(state), F.lit(""))), F.lit("")), F.lit("Unspecified"))
    rows = df.select(species, region.alias("region"), blank(locality).alias("locality")).where("locality <> ''")
    return rows.groupBy(species, "region").agg(F.array_join(F.sort_array(F.collect_set("locality")), "; ").alias("localities"), F.count(F.lit(1)).alias("n"))


def _label_counts(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """label, support, said, hit: how often a label is true, predicted, and both."""
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = F.explode(F.array(F.struct(F.col("t").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said"))))
    hit = F.when((F.col("t") == F.col("p")) & (F.col("s.support") > 0), F.col("n")).otherwise(0)
    return pairs.select("t", "p", "n", sides.alias("s")).groupBy("s.label").agg(F.sum("s.support").alias("support"), F.sum("s.said").alias("said"), F.sum(hit).alias("hit"))


def _scores(counts: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    rows = counts.withColumns({"precision": ratio(F.col("hit"), F.col("said")), "recall": ratio(F.col("hit"), F.col("support"))})
    both = F.col("precision") + F.col("recall")
    return rows.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def label_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Per label: support, precision, recall and F1, to six places."""
    return _scores(_label_counts(df, truth, predicted)).select("label", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def overall_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: accuracy, and precision, recall and F1 weighted by support."""
    n = F.sum("support")
    rows = _scores(_label_counts(df, truth, predicted))
    return rows.agg(F.round(F.sum("hit") / n, 6).alias("accuracy"), *[F.round(F.sum(F.col(c) * F.col("support")) / n, 6).alias(c) for c in ("precision", "recall", "f1")])


def moving_average(df: DataFrame, by: list[str], order: list[str], value: str, alpha: float = 0.3, block_bits: int = 12) -> DataFrame:
    """Per group the exponential moving average of its values in order, starting with the first, and how many there are.

    A value is a map of the average before it, e -> a e + b; maps in a row are one
    map again. Rows are sorted over all tasks and cut into blocks, each group's
    rows of a block become one map, and a group's maps are then applied in turn:
    a task holds a block, or one in 4,096 of a group's rows, and a group of any
    size is spread. Null values go; a null group is a group; rows alike in order
    go by value.
    """
    work = Workspace(df.sparkSession, "average")
    rows = df.where(F.col(value).isNotNull()).select(F.struct(*by).alias("g"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(value).cast("double").alias("x"))
    keys = ["g", *[f"o{i}" for i in range(len(order))], "x"]
    # rows alike in all are parted too
    rows = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys, "tie").sortWithinPartitions(*keys)
    rows = work.save(rows.select("g", "x").withColumn("at", F.monotonically_increasing_id()), "rows")
    parts = rows.groupBy("g", F.shiftright("at", block_bits).alias("block")).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("v"))
    # the first value of a block is carried as it is: as the average if the group begins there, else as a step from the one before
    tail = F.aggregate(F.slice("v", F.lit(2), F.size("v")), F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b")), lambda m, x: F.struct(((1 - alpha) * m["a"]).alias("a"), ((1 - alpha) * m["b"] + alpha * x).alias("b")))
    maps = parts.select("g", "block", F.get("v", F.lit(0)).alias("x0"), tail.alias("m"), F.size("v").alias("n"))
    chain = maps.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("block", "x0", "m"))).alias("c"), F.sum("n").cast("int").alias("n"))
    first = F.get("c", F.lit(0))
    apply = lambda e, s: s["m"]["a"] * (alpha * s["x0"] + (1 - alpha) * e) + s["m"]["b"]
    ema = F.aggregate(F.slice("c", F.lit(2), F.size("c")), first["m"]["a"] * first["x0"] + first["m"]["b"], apply)
    return chain.select("g.*", ema.alias("ema"), "n")


def eta(ema: Column, remaining: Column, workers: Column) -> Column:
    """Seconds left at a mean duration and so many workers."""
    return ema * remaining / F.greatest(workers, F.lit(1))


def regroup(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Per key its records as an ordered array; keys must be of moderate size."""
    rest = [c for c in df.columns if c != key and c not in order]
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *rest))).alias("records"))


def ordered(df: DataFrame, *order: str) -> DataFrame:
    return df.orderBy(*order)


def numbered(df: DataFrame, group: list[str], order: list) -> DataFrame:
    return df.withColumn("n", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
