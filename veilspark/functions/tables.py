"""Tables in the folder that driver and executors share: they cut lineage and are read by several consumers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine gets a temporary folder; a cluster is
    refused, as each executor would write to its own disk.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="veilspark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/veilspark/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a reader of the table: lost executors cost a re-read, and a second consumer runs nothing twice."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._veil_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Delete a table of :func:`written` or :func:`numbered` once nothing reads it."""
    path = getattr(df, "_veil_path", None)
    if path:
        system, place = _file_system(df.sparkSession, path)
        system.delete(place, True)


def _file_system(spark: SparkSession, path: str) -> tuple:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def put_new_file(spark: SparkSession, path: str, text: str) -> bool:
    """Put a small file in place, whole or not at all; false if there is one of that name."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    _, place = _file_system(spark, path)
    draft = hadoop.Path(place.getParent(), f".{uuid.uuid4().hex}")
    context = hadoop.FileContext.getFileContext(place.toUri() if ":" in path else spark._jvm.java.io.File(path).toURI(), spark._jsc.hadoopConfiguration())
    system, _ = _file_system(spark, path)
    system.mkdirs(place.getParent())
    out = system.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        context.rename(draft, place, spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0))
    except Exception as e:
        system.delete(draft, False)
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True


def numbered(rows: DataFrame, keys: list[str], order: str, name: str = "number") -> DataFrame:
    """Rows with their number (from 1) within ``keys`` by ``order``, without bringing a key's rows together.

    Rows are sorted into ranges of (keys, order); each range counts its rows of a key,
    and the counts of the ranges before it are added.
    """
    ranged = rows.repartitionByRange(*keys, order).withColumn("_range", F.spark_partition_id())
    local = written(ranged.withColumn("_local", F.row_number().over(_by(["_range", *keys], [order]))), "numbered")
    counts = local.groupBy("_range", *keys).agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("_range", *keys, (F.sum("n").over(_by(keys, ["_range"])) - F.col("n")).alias("_before"))
    before = before.select(F.col("_range").alias("_r"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_before")
    on = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = local.join(before, on).select(*rows.columns, (F.col("_local") + F.col("_before")).alias(name))
    out._veil_path = local._veil_path
    return out


def _by(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def running(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str, how: str = "max") -> DataFrame:
    """Rows with the greatest ``value`` (or the ``sum``, from 0) of the rows before them by ``order`` within ``keys``, without bringing a key's rows together.

    Rows are sorted into ranges; what the ranges before one have reached for its keys is added to it.
    """
    fold = {"max": F.max, "sum": F.sum}[how]
    ranged = rows.withColumn("_value_", value).repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    stored = written(ranged.sortWithinPartitions(*keys, *order), "ranged")
    # Rows of one order are told apart by their place.
    here = Window.partitionBy("_range", *keys).orderBy(*order, "_place").rowsBetween(Window.unboundedPreceding, -1)
    local = stored.withColumn("_place", F.monotonically_increasing_id()).withColumn("_local", fold("_value_").over(here))
    reached = stored.groupBy("_range", *keys).agg(fold("_value_").alias("reach"))
    before = reached.select("_range", *keys, fold("reach").over(_by(keys, ["_range"]).rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    before = before.select(F.col("_range").alias("_r"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_before").alias("_carried"))
    on = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    none = F.lit(0)
    both = F.greatest("_local", "_carried") if how == "max" else F.coalesce("_local", none) + F.coalesce("_carried", none)
    return local.join(before, on).select(*rows.columns, both.alias(name))
