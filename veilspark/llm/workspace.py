"""Shared-folder tables that cut lineage, and small plan helpers."""

from __future__ import annotations

from contextvars import ContextVar

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import new_path

#: The open space of the running computation, if any; other threads have their own.
_open: ContextVar[Space | None] = ContextVar("space", default=None)


class Space:
    """The working tables of one computation: those written while it is open are deleted when it closes, but for the kept ones.

        with Space() as space:
            steps = written(...)
            result = space.keep(written(...))

    Nothing that was written elsewhere is ever deleted, so results of earlier computations can be read on.
    """

    def __init__(self) -> None:
        self.tables: dict[str, DataFrame] = {}

    @staticmethod
    def current() -> Space | None:
        return _open.get()

    def keep(self, df: DataFrame) -> DataFrame:
        self.tables.pop(df._veil_path, None)
        return df

    def __enter__(self) -> Space:
        self._before = _open.set(self)
        return self

    def __exit__(self, *exc) -> None:
        _open.reset(self._before)
        for df in list(self.tables.values()):
            drop_written(df)
        self.tables.clear()


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader of the table.

    Lost executors then cost a re-read, not a recomputation, and a second
    consumer does not run the producer again.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    try:
        df.write.option("compression", codec).parquet(path)
    except BaseException:
        _delete(spark, path)
        raise
    out = spark.read.schema(df.schema).parquet(path)
    out._veil_path = path
    if space := Space.current():
        space.tables[path] = out
    return out


def drop_written(df: DataFrame) -> None:
    """Delete a table made by :func:`written` once nothing reads it."""
    path = getattr(df, "_veil_path", None)
    if path:
        if space := Space.current():
            space.tables.pop(path, None)
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    p = context._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)


ROW = ("_veil_file", "_veil_row")


def plain_scan(df: DataFrame) -> bool:
    """Whether every row of ``df`` is one row of a file: columns and filters over files, without a join, union, generator or sample."""
    plan = getattr(df, "_jdf", None)
    node = plan.queryExecution().analyzed() if plan else None
    while node is not None and node.getClass().getSimpleName() in ("Project", "Filter") and node.deterministic():
        node = node.children().head()
    return node is not None and node.getClass().getSimpleName() == "LogicalRelation"


def fixed(docs: DataFrame) -> DataFrame:
    """Rows that are the same at every reading: ``docs`` itself if it is a plain scan, else its rows, written and kept."""
    if plain_scan(docs):
        return docs
    out = written(docs, "rows")
    if space := Space.current():
        space.keep(out)
    return out


def with_row(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """The rows with two columns that identify each of them, whatever they hold, and those columns' names.

    They are the file and the place in it of a plain scan of Parquet files; other rows
    are written first.
    """
    rows = fixed(docs)

    def named(df: DataFrame) -> DataFrame:
        return df.withColumns({ROW[0]: F.xxhash64("_metadata.file_path"), ROW[1]: F.col("_metadata.row_index")})

    try:
        out = named(rows)
        assert out.columns
    except AnalysisException:  # files without row numbers
        rows = written(docs, "rows")
        if space := Space.current():
            space.keep(rows)
        out = named(rows)
    return out, ROW


#: Rows of decisions (places and numbers) that are broadcast, about 64 MB in memory; counted, and joined by a shuffle beyond.
BROADCAST_ROWS = 1_000_000


def joined_by(decisions: DataFrame) -> DataFrame:
    """A narrow stored table as the side of a join: broadcast if it is counted to be small."""
    return F.broadcast(decisions) if decisions.count() <= BROADCAST_ROWS else decisions


def file_system(path: str):
    """The ``pyarrow.fs`` file system of a folder that all share, and the folder's path in it."""
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns (by exact name), so clashing extras never reach a join."""
    return df.select(*[F.col(f"`{n}`") for n in names])
