"""Session set-up, lineage cuts and rows stored in the shared folder."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


PART_BYTES = 4 << 20  # bytes of input files per partition where the session sets fewer partitions
MOST_PARTS = 20_000  # partitions of a shuffle; beyond, they grow and are sorted on disk


def local_session(cpus: int | str = "*", app: str = "trapline") -> SparkSession:
    """A local session for tests and the benchmark. On a cluster use the session you are given."""
    partitions = "8" if cpus == "*" else str(max(int(cpus), 1))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder that the driver and all executors share: "
            "rows that are read more than once are stored there, so that a lost executor "
            "cannot change them"
        )
    return shared.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """The session's folder in the shared one; ``release`` removes it with all that lies in it."""
    return f"{shared_folder(spark)}/trapline-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession) -> str:
    """Name of a folder that is not there yet, in the session's own."""
    return f"{own_folder(spark)}/{uuid.uuid4().hex}"


def parts_for(df: DataFrame, growth: int = 1) -> int:
    """Partitions for a shuffle of ``df``: as many as the session sets, for larger inputs one per ``PART_BYTES`` of the files it reads.

    ``growth`` is how many times larger the rows become than those of a plain table. The session's number stays when its tables grow, so that what a task sorts or holds in hash tables would grow with them.
    """
    spark = df.sparkSession
    jvm, conf, size = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    for file in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
        size += path.getFileSystem(conf).getFileStatus(path).getLen()
    return max(_session_parts(spark), min(-(-size * growth // PART_BYTES), MOST_PARTS))


def _session_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def more_parts(df: DataFrame) -> int | None:
    """``parts_for(df)`` where it is more than the session sets, else None: Spark's own number will do."""
    parts = parts_for(df)
    return parts if parts > _session_parts(df.sparkSession) else None


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, to a table in the shared folder, and continue from the stored rows.

    Used where one result is read more than once, or where the values depend on how the rows were
    split into partitions and therefore must not be computed a second time. ``release`` removes
    what the session has stored.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _tables(spark: SparkSession) -> str:
    """Beginning of the names of the tables that this session stores."""
    return f"trapline_{re.sub('[^a-z0-9]', '_', spark.sparkContext.applicationId.lower())}_"


def settle_by(df: DataFrame, key: str) -> DataFrame:
    """As ``settle``, but the stored rows lie in buckets of ``key``, one per shuffle partition: joins on it need not move them again."""
    spark = df.sparkSession
    name = f"{_tables(spark)}{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.bucketBy(buckets, key).option("path", f"{own_folder(spark)}/{name}").option("compression", "zstd")
    writer.saveAsTable(name)
    return spark.table(name)


def release(spark: SparkSession) -> None:
    """Remove the rows this session has stored. DataFrames that read them must be finished."""
    for table in spark.catalog.listTables():
        if table.name.startswith(_tables(spark)):
            spark.sql(f"drop table if exists {table.name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
