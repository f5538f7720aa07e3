"""Session settings, code shipping and the shared work folder.

The package's functions are pickled by value, so Python workers need no copy of
the repository on their path.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import fieldloom

CHECKPOINT_KEY = "spark.checkpoint.dir"
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
#: Of written tables, which hold whole texts.
COMPRESSION = "zstd"
#: Spark drops the shuffle files of a query that ends while this holds.
SHUFFLE_CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of an Arrow batch to a Python worker, where the session keeps Spark's default: documents are long.
ARROW_KEY, ARROW_ROWS, ARROW_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000", "10000"

#: A table is dealt out when it has less than a core's IDLE_SHARE-th row group for each core, and so many bytes.
IDLE_SHARE, LEAST_DEALT = 4, 4 << 20


def ship_code() -> None:
    """Let pickled functions carry this package's code along."""
    cloudpickle.register_pickle_by_value(fieldloom)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; in local mode alone, an unset one becomes a local folder."""
    found = spark.conf.get(CHECKPOINT_KEY, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that driver and executors share")
        found = f"{LOCAL_CHECKPOINTS}/{spark.sparkContext.applicationId}"
        spark.conf.set(CHECKPOINT_KEY, found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _drop_path(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_open_roots: dict[str, SparkSession] = {}


@atexit.register
def _drop_open_roots() -> None:
    """What the run left in the shared folder goes when the driver ends; a session that has stopped can remove nothing."""
    for root, spark in list(_open_roots.items()):
        with contextlib.suppress(Exception):
            if spark.sparkContext._jsc is not None:
                _drop_path(spark, root)


class Workspace:
    """Tables one operator run writes to the shared folder to cut lineage.

    They are there while lazy results may read them: until clear() is called or
    the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship_code()
        if spark.conf.get(ARROW_KEY, ARROW_DEFAULT) == ARROW_DEFAULT:
            spark.conf.set(ARROW_KEY, ARROW_ROWS)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/fieldloom/{name}-{uuid.uuid4().hex[:12]}"
        _open_roots[self.root] = spark

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def uri(self, name: str) -> str:
        """The path with the scheme that Hadoop resolves it to, for readers and writers other than Spark's."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name))
        found = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
        return found.replace("file:/", "file:///", 1) if found.startswith("file:/") and not found.startswith("file://") else found

    def save(self, df: DataFrame, name: str, path: str | None = None) -> DataFrame:
        """Write df once, below the workspace or at a path of the caller's, and return the written table."""
        path = path or self.path(name)
        df.write.mode("overwrite").option("compression", COMPRESSION).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def save_and_clean(self, df: DataFrame, name: str, path: str | None = None) -> DataFrame:
        """save(), after which the shuffle files that went into it are dropped, where Spark can; the session's setting comes back."""
        before = self.spark.conf.get(SHUFFLE_CLEANUP_KEY, None)
        self.spark.conf.set(SHUFFLE_CLEANUP_KEY, "true")
        try:
            return self.save(df, name, path)
        finally:
            if before is None:
                self.spark.conf.unset(SHUFFLE_CLEANUP_KEY)
            else:
                self.spark.conf.set(SHUFFLE_CLEANUP_KEY, before)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing lazy reads any more."""
        for name in names:
            _drop_path(self.spark, self.path(name))

    def keep_only(self, *names: str) -> None:
        """Delete all tables but these: what a finished operator's lazy result still reads."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        self.drop(*(x.getPath().getName() for x in fs.listStatus(where) if x.getPath().getName() not in names))

    def clear(self) -> None:
        """Delete all tables; nothing lazy may read them any more."""
        _drop_path(self.spark, self.root)
        _open_roots.pop(self.root, None)


def _row_groups(spark: SparkSession, files: list[str]) -> tuple[int, int]:
    """Row groups of parquet files, and their compressed bytes, from the footers."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = size = 0
    for file in files:
        where = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(where, conf))
        try:
            groups = reader.getRowGroups()
            n += groups.size()
            size += sum(g.getCompressedSize() for g in groups)
        finally:
            reader.close()
    return n, size


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, dealt over all cores where its files cannot be.

    A row group is one task's at least, so a table of few row groups would leave
    most cores idle up to the first exchange. It is dealt out by row if it has at
    most a quarter as many row groups as there are cores; that many row groups
    are all that is ever exchanged here, and tables of more files than that, as
    large ones are, cost no look at a footer.
    """
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    files = table.inputFiles()
    if 0 < len(files) <= cores // IDLE_SHARE:
        n, size = _row_groups(spark, files)
        if 0 < n <= cores // IDLE_SHARE and size >= LEAST_DEALT:
            return table.repartition(cores)
    return table
