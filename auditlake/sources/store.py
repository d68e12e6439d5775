"""Runs, pages and findings as Parquet, partitioned by run; the runs row is the commit mark."""

from __future__ import annotations

import atexit
import datetime as dt
import json
import re
import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import FINDING, PAGE, RUN

_scratch: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode and one in the warehouse on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not (named := spark.sparkContext.getCheckpointDir()):
        local = re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master)
        named = tempfile.mkdtemp(prefix="audit-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
    return named.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _sweep() -> None:
    for spark, path in _scratch:
        try:
            _delete(spark, path)
        except Exception:  # the JVM has gone before
            return


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to shared storage and read back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(_sweep)
    _scratch.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def upsert(rows: DataFrame) -> DataFrame:
    """The last row (by seq) of every url; one aggregation, no sort of whole rows."""
    rest = [c for c in rows.columns if c != "url"]
    return rows.groupBy("url").agg(F.max_by(F.struct(*rest), F.coalesce("seq", F.lit(-1))).alias("row")).select("url", "row.*").select(*rows.columns)


class Store:
    """One folder with ``pages`` and ``findings`` by run, and ``runs``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, path: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def runs(self, name: str | None = None) -> DataFrame:
        """Latest row of every run, newest first; old files without ``aborted`` count as not aborted."""
        path = f"{self.root}/runs"
        if not self._exists(path):
            return self.spark.createDataFrame([], RUN)
        rows = self.spark.read.option("mergeSchema", "true").parquet(path)
        for f in RUN:
            if f.name not in rows.columns:
                rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
        rows = rows.withColumn("aborted", F.coalesce("aborted", F.lit(False)))
        last = rows.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(F.col("finished_at").desc_nulls_last()))).where("n = 1")
        last = last.select(*RUN.fieldNames())
        return (last.where(F.col("name") == name) if name is not None else last).orderBy(F.desc("id"))

    def start_run(self, name: str, config: Any) -> int:
        """The next id (one writer) and a row without an end."""
        last = self.runs().agg(F.max("id")).first()[0]
        run_id = (last or 0) + 1
        row = (run_id, name, dt.datetime.now(dt.UTC), None, json.dumps(config, sort_keys=True, default=str), None, None, False)
        self.spark.createDataFrame([row], RUN).coalesce(1).write.mode("append").parquet(f"{self.root}/runs")
        return run_id

    def save_pages(self, run_id: int, pages: DataFrame) -> None:
        """Append a batch of pages; reading lets the later row of an address win."""
        pages.select(*PAGE.fieldNames()).write.mode("append").parquet(f"{self.root}/pages/run_id={run_id}")

    def finish_run(self, run_id: int, findings: DataFrame, aborted: bool = False) -> None:
        """Findings replace earlier ones of the run; the runs row comes last."""
        path = f"{self.root}/findings/run_id={run_id}"
        findings.write.mode("overwrite").parquet(path)
        begun = self.runs().where(F.col("id") == run_id).first()
        row = (run_id, begun.name, begun.started_at, dt.datetime.now(dt.UTC), begun.config, self.pages(run_id).count(), self.spark.read.parquet(path).count(), aborted)
        self.spark.createDataFrame([row], RUN).coalesce(1).write.mode("append").parquet(f"{self.root}/runs")

    def pages(self, run_id: int) -> DataFrame:
        path = f"{self.root}/pages/run_id={run_id}"
        return upsert(self.spark.read.schema(PAGE).parquet(path)) if self._exists(path) else self.spark.createDataFrame([], PAGE)

    def findings(self, run_id: int) -> DataFrame:
        path = f"{self.root}/findings/run_id={run_id}"
        return self.spark.read.parquet(path) if self._exists(path) else self.spark.createDataFrame([], FINDING)

    def diff_pair(self, name: str | None = None) -> tuple[int, int] | None:
        """(before, after): the latest complete run that was not aborted, and the one before it of the same name."""
        rows = self.runs(name).where("finished_at is not null and not aborted")
        after = rows.first()
        if after is None:
            return None
        before = rows.where((F.col("name") == after.name) & (F.col("id") < after.id)).first()
        return (before.id, after.id) if before else None
