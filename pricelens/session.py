"""Session helpers: a builder for local work, table access and lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: list[tuple[SparkSession, str]] = []


def build_session(app: str = "pricelens", cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with adaptive execution, Arrow and UTC; on a cluster the submitter's settings rule."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "12g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table, as written by the driver."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The table in at least as many parts as there are cores, for work that costs more than moving the rows.

    Large tables come in more parts than that anyway and stay as they are: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session may do without; it gets a temporary one."""
    configured = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir() or ""
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    local = getattr(shared_dir, "local", None)
    if local is None:
        local = shared_dir.local = tempfile.mkdtemp(prefix="pricelens-")
        atexit.register(__import__("shutil").rmtree, local, ignore_errors=True)
    return f"file://{local}"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clear() -> None:
    """What the stages left in the shared folder goes when the driver ends in good order."""
    for spark, root in _roots:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, root)
        except Exception:  # noqa: BLE001 - the session is gone; so are its folders' users
            return


class Stage:
    """Writes intermediate tables to the shared folder, so that lost executors cost no recomputation.

    ``cut`` writes a table and returns it as read back; ``drop`` deletes what a later table has superseded.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        _roots.append((spark, self.root))

    def cut(self, df: DataFrame, *partition_by: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stage_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            path = getattr(t, "_stage_path", None)
            if path:
                _delete(self.spark, path)
