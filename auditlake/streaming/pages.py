"""Pages as a stream: page rules as they arrive, site rules on the run so far."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.site import SiteContext
from ..plans.engine import page_rule_findings, run_rules
from ..plans.model import RuleSet
from ..schema import PAGE
from ..sources.store import Store


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page files as they are written to a folder."""
    return spark.readStream.schema(PAGE).parquet(path)


def page_findings(stream: DataFrame, rules: RuleSet) -> DataFrame:
    """Stateless findings of the page rules; append mode."""
    return page_rule_findings(stream, [r for r in rules.rules if r.scope == "page"])


def distinct_pages(stream: DataFrame, within: str | None = None, time_column: str | None = None) -> DataFrame:
    """First page of each address; with a watermark the state is bounded."""
    if within and time_column:
        return stream.withWatermark(time_column, within).dropDuplicatesWithinWatermark(["url"])
    return stream.dropDuplicates(["url"])


def audit_stream(stream: DataFrame, store: Store, run_id: int, rules: RuleSet, checkpoint: str, site: SiteContext | None = None, on_batch: Callable[[int], None] = lambda _: None):
    """Each batch is added to the run, whose findings are then computed anew: late pages correct earlier results."""

    def handle(batch: DataFrame, number: int) -> None:
        store.save_pages(run_id, batch)
        pages = store.pages(run_id)
        store.finish_run(run_id, run_rules(pages, rules, site).withColumn("batch", F.lit(number)))
        on_batch(number)

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
