"""A vault that goes on: a stored table that later runs add to.

A known value keeps its token; new values of a class go on from the highest number of their vault and
class; a value that a user gives after a page did becomes the user's. A run reads what is committed,
writes only what is new, and commits by putting one small file in place, so that readers see all of a
run or nothing. A run that is repeated, whether its commit was lost or only the news of it, changes nothing.

Folders: ``entries`` (one row a value), ``users`` (values that became a user's), ``highs`` (the last number of each
vault and class that grew), each with a folder for every run, and ``commits`` with the names of those
that count. Folders without a commit are of failed runs and never read.

Null vaults are a vault of their own; null values are left out; an empty batch commits nothing new.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import drop_written, numbered, put_new_file, written
from . import vault as vaults

ENTRIES = "vault_id string, pii_class string, canonical string, number long, token string, value string, source string, origin string"
KEY = ["vault_id", "pii_class", "canonical"]
_KEYS, _HIGHS = "vault_id string, pii_class string, canonical string", "vault_id string, pii_class string, high long"
_LOG = "commit long, base long, folder string, batch string"


class Conflict(RuntimeError):
    """Another run committed first; repeat the update."""


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on &= left[k].eqNullSafe(right[k])
    return on


class VaultStore:
    """The vault under a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def log(self) -> list[dict]:
        """The commits in order; there is one row for each run since the last compaction began to count."""
        from pyspark.errors import AnalysisException

        try:
            rows = [r.asDict() for r in self.spark.read.schema(_LOG).json(f"{self.path}/commits").collect()]
        except AnalysisException:  # no commit yet
            return []
        base = max((r["base"] for r in rows), default=0)
        return sorted((r for r in rows if r["commit"] >= base), key=lambda r: r["commit"])

    def _rows(self, kind: str, schema: str, log: list[dict]) -> DataFrame:
        if not log:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{kind}/{r['folder']}" for r in log])

    def read(self, log: list[dict] | None = None) -> DataFrame:
        """The vault as :func:`vault.build` gives it; ``first_seen`` is the number."""
        log = self.log() if log is None else log
        entries, users = self._rows("entries", ENTRIES, log), self._rows("users", _KEYS, log).distinct().withColumn("_user", F.lit(True))
        joined = entries.join(users, _same(entries, users, KEY), "left")
        source = F.when(F.col("_user"), "user").otherwise(entries["source"])
        return joined.select(*[entries[c] for c in (*KEY, "token", "value")], source.alias("source"), entries["origin"], entries["number"].alias("first_seen"))

    def update(self, values: DataFrame, order: list[str], batch: str | None = None) -> DataFrame:
        """Add (vault_id, pii_class, value, origin, source) rows, seen in ``order``, and return the vault.

        A ``batch`` that is committed already is not read again.
        """
        log = self.log()
        if batch is not None and any(r["batch"] == batch for r in log):
            return self.read(log)
        seen = written(vaults.distinct_values(values.where("value IS NOT NULL"), order).withColumn("vault_id", F.col("vault_id").cast("string")), "seen")
        known = self.read(log)
        new = seen.join(known, _same(seen, known, KEY), "left_anti")
        local = numbered(new, ["vault_id", "pii_class"], "_seen")
        highs = self._rows("highs", _HIGHS, log).groupBy("vault_id", "pii_class").agg(F.max("high").alias("high"))
        carried = local.join(highs, _same(local, highs, ["vault_id", "pii_class"]), "left")
        number = F.col("number") + F.coalesce("high", F.lit(0))
        first = [local[c] for c in KEY]
        entries = carried.select(*first, number.alias("number"), vaults.token(local["pii_class"], number).alias("token"), F.col("first.value").alias("value"), F.when(F.col("by_user"), "user").otherwise("page").alias("source"), F.col("first.origin").alias("origin"))
        page = known.where("source = 'page'")
        users = seen.where("by_user").join(page, _same(seen, page, KEY), "left_semi").select(*KEY)
        folder = uuid.uuid4().hex
        self._write("entries", entries, folder)
        own = self.spark.read.schema(ENTRIES).parquet(f"{self.path}/entries/{folder}")
        self._write("users", users, folder)
        self._write("highs", own.groupBy("vault_id", "pii_class").agg(F.max("number").alias("high")), folder)
        self._commit(log, folder, batch)
        drop_written(local)
        drop_written(seen)
        return self.read()

    def compact(self) -> None:
        """Write the committed rows together; later reads open one folder."""
        log = self.log()
        if len(log) < 2:
            return
        folder = uuid.uuid4().hex
        vault = self.read(log).select(*KEY, F.col("first_seen").alias("number"), "token", "value", "source", "origin")
        self._write("entries", vault, folder)
        self._write("users", self.spark.createDataFrame([], _KEYS), folder)
        self._write("highs", self._rows("highs", _HIGHS, log).groupBy("vault_id", "pii_class").agg(F.max("high").alias("high")), folder)
        self._commit(log, folder, None, True)

    def _write(self, kind: str, rows: DataFrame, folder: str) -> None:
        rows.write.option("compression", "zstd").parquet(f"{self.path}/{kind}/{folder}")

    def _commit(self, log: list[dict], folder: str, batch: str | None, base: bool = False) -> None:
        n = log[-1]["commit"] + 1 if log else 1
        row = {"commit": n, "base": n if base else log[0]["base"] if log else 0, "folder": folder, "batch": batch}
        if not put_new_file(self.spark, f"{self.path}/commits/{n:012d}.json", json.dumps(row)):
            raise Conflict(f"commit {n} of {self.path} is another run's")
