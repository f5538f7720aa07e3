"""Upserts, overlays, versions and migrations as pure functions of old and new tables.

There is no table format with updates; a new snapshot is derived from the old
one and a log, and written as a whole by the sinks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import keys
from fieldloom.functions.names import blank


def upsert_last(old: DataFrame, new: DataFrame, key: list[str], seq: str) -> DataFrame:
    """Rows of both tables, of each key the last by ``seq``."""
    rows = old.unionByName(new, allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("__r")).select(*key, "__r.*").select(*rows.columns)


def upsert_edges(old: DataFrame, new: DataFrame, seq: str = "seq") -> DataFrame:
    """Edges (src, rel, dst, weight, props, seq): weights added, properties of the last."""
    return old.unionByName(new).groupBy("src", "rel", "dst").agg(F.sum("weight").alias("weight"), F.max_by("props", seq).alias("props"), F.max(seq).alias(seq))


def insert_new(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows whose key the old table lacks, one per key."""
    return new.join(old.select(*key), key, "left_anti").dropDuplicates(key)


def replace_groups(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows of groups that new does not have, and all new rows."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def set_flag(df: DataFrame, flag: str, value: Column, where: Column) -> DataFrame:
    return df.withColumn(flag, F.when(where, value).otherwise(F.col(flag)))


def merge_atoms(old: DataFrame, new: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Memory atoms of both tables merged, and the conflicts between them.

    new: occurrences with atom_id, seq and fields. A new atom takes the values
    of its first occurrence; a known one keeps its own and is confirmed by each
    occurrence. A conflict is a field for which both have a value and they differ;
    it is resolved for the new value if a marine register gave it, else for the old.
    """
    first = new.groupBy("atom_id").agg(F.count(F.lit(1)).alias("__n"), F.min_by(F.struct(*fields), F.col("seq")).alias("__f"))
    joined = old.join(first, "atom_id", "full_outer")
    known = F.col("times_confirmed").isNotNull()
    seen = F.coalesce("__n", F.lit(0))
    merged = joined.select("atom_id", *[F.when(known, F.col(f)).otherwise(F.col(f"__f.{f}")).alias(f) for f in fields], (F.coalesce("times_confirmed", F.lit(0)) + seen).cast("long").alias("times_confirmed"))
    both = new.join(old.select("atom_id", *[F.col(f).alias(f"__o_{f}") for f in fields]), "atom_id")
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), blank(f"__o_{f}").alias("old_value"), blank(f).alias("new_value")) for f in fields]))
    marine = F.upper(blank("nameAccordingTo")) == "WORMS" if "nameAccordingTo" in new.columns else F.lit(False)
    diff = both.select("atom_id", "seq", marine.alias("marine"), pairs.alias("p")).select("atom_id", "seq", "p.*", F.when(F.col("marine"), "register").otherwise("existing_record").alias("resolved_by"))
    return merged, diff.where((F.col("old_value") != "") & (F.col("new_value") != "") & (F.col("old_value") != F.col("new_value")))


def resolve_conflicts(atoms: DataFrame, conflicts: DataFrame, fields: list[str]) -> DataFrame:
    """atoms with the values that won, the last conflict of a field deciding."""
    last = conflicts.where("resolved_by = 'register'").groupBy("atom_id", "field").agg(F.max_by("new_value", "seq").alias("v"))
    won = last.groupBy("atom_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "v"))).alias("__w"))
    return atoms.join(won, "atom_id", "left").withColumns({f: F.coalesce(F.col("__w")[f], F.col(f)) for f in fields}).select(*atoms.columns)


def overlay(df: DataFrame, corrections: DataFrame, key: list[str], seq: str, fields: list[str], deleted: str | None = None) -> DataFrame:
    """df with the last correction of each row applied; null corrections leave a field; deleted rows go."""
    rows = [f for f in fields] + ([deleted] if deleted else [])
    last = corrections.groupBy(*key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(seq))).alias(f"__{f}") for f in rows])
    joined = df.join(last, key, "left")
    if deleted:
        joined = joined.where(~F.coalesce(F.col(f"__{deleted}"), F.lit(False)))
    return joined.withColumns({f: F.coalesce(F.col(f"__{f}"), F.col(f)) for f in fields}).select(*df.columns)


def remove(df: DataFrame, tombstones: DataFrame, key: list[str]) -> DataFrame:
    return df.join(tombstones.select(*key), key, "left_anti")


def reclassify(df: DataFrame, changes: DataFrame, name: str, fields: list[str]) -> DataFrame:
    """df with fields replaced for the names that changes (name, fields; unique names) tells."""
    c = changes.select(F.lower(blank("name")).alias("__n"), *[F.col(f).alias(f"__{f}") for f in fields])
    return df.join(c, F.lower(blank(name)) == F.col("__n"), "left").withColumns({f: F.coalesce(F.col(f"__{f}"), F.col(f)) for f in fields}).select(*df.columns)


def migrate_nodes(edges: DataFrame, moves: DataFrame) -> DataFrame:
    """Edges with nodes renamed by moves (old, new) and edges that have become one added up."""
    m = lambda side: moves.select(F.col("old").alias(side), F.col("new").alias(f"__{side}"))
    moved = edges.join(m("src"), "src", "left").join(m("dst"), "dst", "left")
    renamed = moved.select(F.coalesce("__src", "src").alias("src"), "rel", F.coalesce("__dst", "dst").alias("dst"), "weight", "props", "seq")
    return renamed.groupBy("src", "rel", "dst").agg(F.sum("weight").alias("weight"), F.max_by("props", "seq").alias("props"), F.max("seq").alias("seq"))


def rekey_atoms(atoms: DataFrame, moves: DataFrame) -> DataFrame:
    """Atoms with localities renamed by moves (old, new), their ids derived anew, and those that meet merged."""
    m = moves.select(F.lower(blank("old")).alias("__o"), F.col("new").alias("__new"))
    moved = atoms.join(m, F.lower(blank("locality")) == F.col("__o"), "left").withColumn("locality", F.coalesce("__new", "locality"))
    keyed = moved.withColumn("atom_id", keys.atom_id("valid_name", "locality", "source_citation"))
    rest = [c for c in atoms.columns if c not in ("atom_id", "times_confirmed")]
    return keyed.groupBy("atom_id").agg(F.max_by(F.struct(*rest), F.struct("times_confirmed", *rest)).alias("__r"), F.sum("times_confirmed").alias("times_confirmed")).select("atom_id", "__r.*", "times_confirmed").select(*atoms.columns)


def drop_node(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that touch none of the nodes (id)."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_anti").join(nodes.select(F.col("id").alias("dst")), "dst", "left_anti")


def append_version(versions: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """versions (key, version, body, note) with the new bodies as each key's next version; equal bodies add none."""
    last = versions.groupBy(*key).agg(F.max("version").alias("__v"), F.max_by("body", "version").alias("__b"))
    rows = new.join(last, key, "left").where(~F.col("body").eqNullSafe(F.col("__b")) | F.col("__v").isNull())
    return versions.unionByName(rows.select(*key, (F.coalesce("__v", F.lit(0)) + 1).cast("int").alias("version"), "body", "note"))


def current_version(versions: DataFrame, key: list[str]) -> DataFrame:
    return versions.groupBy(*key).agg(F.max("version").alias("version"), F.max_by("body", "version").alias("body"))


def version_history(versions: DataFrame, key: list[str]) -> DataFrame:
    return versions.withColumn("is_current", F.col("version") == F.max("version").over(Window.partitionBy(*key))).orderBy(*key, F.desc("version"))


def rollback(versions: DataFrame, key: list[str], to: DataFrame) -> DataFrame:
    """versions with an old body (key, version) appended as the newest; keys without that version stay."""
    old = versions.join(to.select(*key, F.col("version").alias("__to")), key).where(F.col("version") == F.col("__to"))
    bodies = old.select(*key, "body", F.concat(F.lit("rollback to "), F.col("version").cast("string")).alias("note"))
    last = versions.groupBy(*key).agg(F.max("version").alias("__v"))
    return versions.unionByName(bodies.join(last, key).select(*key, (F.col("__v") + 1).cast("int").alias("version"), "body", "note"))


def merge_points(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old points and the new ones whose key they lack."""
    return old.unionByName(insert_new(old, new, key), allowMissingColumns=True)


def deep_merge(base: Column, extra: Column) -> Column:
    """A map with what another adds; a value of the base stays unless it is blank."""
    filled = F.map_filter(base, lambda k, v: F.trim(v) != "")
    return F.map_concat(F.map_filter(extra, lambda k, v: ~F.map_contains_key(filled, k)), filled)


def union_all(*frames: DataFrame) -> DataFrame:
    """Tables of differing columns as one; what a table lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
