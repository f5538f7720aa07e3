"""Snapshots with an atomic switch, append logs and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.names import blank
from fieldloom.operators import graph
from fieldloom.operators.dedup import record_name
from fieldloom.schemas import canonical

#: Columns of the Darwin-Core export, in order.
DARWIN_CORE = ("atom_id", "session_id", "valid_name", "recorded_name", "phylum", "class_", "order_", "family_", "taxon_rank", "taxonomic_status", "worms_id", "itis_id", "name_according_to", "locality", "latitude", "longitude", "geocoding_src", "habitat", "occurrence_type", "sampling_date", "depth_m", "method", "raw_evidence", "source_citation", "confidence", "times_confirmed", "first_seen", "last_seen")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


class Snapshots:
    """A table as numbered snapshots.

    A snapshot counts from the moment its pointer file appears, in one rename to
    a name that was free; the largest pointer is the one to read. Nothing is
    deleted, so a crash at any point leaves the former snapshot in force.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def current(self) -> int | None:
        fs, path = _fs(self.spark, self.root)
        at = path(f"{self.root}/pointers")
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        return max((int(n) for n in names if n.isdigit()), default=None)

    def note(self) -> str | None:
        """What the writer of the current snapshot noted with it."""
        v = self.current()
        return None if v is None else self.spark.read.text(f"{self.root}/pointers/{v:012d}").first()[0].partition(" ")[2]

    def read(self, version: int | None = None) -> DataFrame:
        v = self.current() if version is None else version
        if v is None:
            raise FileNotFoundError(f"{self.root} has no snapshot")
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/v={v}")

    def write(self, df: DataFrame, partition_by: list[str] | None = None, note: str = "") -> int:
        """Write df as the next snapshot, then its pointer with a note."""
        v = (self.current() or 0) + 1
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.root}/v={v}")
        fs, path = _fs(self.spark, self.root)
        waiting = path(f"{self.root}/pointers/.{v:012d}")
        out = fs.create(waiting, True)
        out.write(bytearray(f"{v} {note}", "utf-8"))
        out.close()
        if not fs.rename(waiting, path(f"{self.root}/pointers/{v:012d}")):
            raise FileExistsError(f"{self.root}: another writer made snapshot {v}")
        return v


def append_records(df: DataFrame, path: str, file_hash: str, session: str) -> None:
    """Append records in canonical columns to a table; those without a name are left out."""
    rows = canonical(df).where(record_name().isNotNull())
    key = F.concat_ws("|", F.lit(file_hash), record_name(), blank("verbatimLocality"), blank("rawTextEvidence"), blank("sourceCitation"))
    rows.select(F.substring(F.sha1(key), 1, 16).alias("occ_id"), F.lit(file_hash).alias("file_hash"), F.lit(session).alias("session_id"), "*").write.mode("append").parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append rows to a log of corrections, relations or processed documents."""
    df.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)


def csv_file(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def darwin_core(atoms: DataFrame) -> DataFrame:
    """The export's columns in order, those a table lacks empty, sorted by phylum, family and name."""
    out = atoms.select(*[(F.col(c).cast("string") if c in atoms.columns else F.lit(None).cast("string")).alias(c) for c in DARWIN_CORE])
    return out.orderBy("phylum", "family_", "valid_name")


def graphml_file(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A small graph as one GraphML document."""
    graph.graphml(nodes, edges).select("line").coalesce(1).write.mode("overwrite").text(path)


def text_files(df: DataFrame, path: str, key: str, body: str) -> None:
    """Texts, one line-separated file set per key."""
    df.select(key, F.col(body).alias("value")).write.mode("overwrite").partitionBy(key).text(path)
