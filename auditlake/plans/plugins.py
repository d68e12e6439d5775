"""User code beside rules: page hooks, row by row, and site hooks on whole tables."""

from __future__ import annotations

import importlib.util
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import SEVERITIES


@dataclass
class Plugin:
    """``check_page`` is either Column-valued (preferred: texts as array<string>) or takes a page dict.

    ``page_columns()`` builds an array<string> Column; ``check_page(page)``
    returns None, a text or texts; ``check_site(pages)`` returns (url, message).
    """

    id: str
    severity: str = "warning"
    description: str = ""
    page_columns: Any = None
    check_page: Any = None
    check_site: Any = None


def load_plugins(path: Path) -> list[Plugin]:
    """``PLUGIN`` or ``PLUGINS`` of a Python file."""
    spec = importlib.util.spec_from_file_location(f"plugin_{path.stem}", path)
    if spec is None or spec.loader is None or not path.exists():
        raise ValueError("no such file")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    listed = getattr(module, "PLUGINS", None) or [getattr(module, "PLUGIN", None)]
    for plugin in listed:
        if not getattr(plugin, "id", None) or not any(getattr(plugin, h, None) for h in ("page_columns", "check_page", "check_site")):
            raise ValueError("a plugin needs an id and at least one hook")
        if plugin.severity not in SEVERITIES:
            raise ValueError(f"bad severity {plugin.severity!r}")
    return list(listed)


def page_findings(pages: DataFrame, plugin: Plugin, order: int) -> DataFrame:
    """Findings of the page hook; an exception becomes an error finding of its page."""
    if plugin.page_columns is not None:
        texts: Column = F.transform(plugin.page_columns(), lambda t: F.struct(F.lit(plugin.severity).alias("severity"), t.alias("message")))
    else:
        hook, severity = plugin.check_page, plugin.severity

        @F.udf("array<struct<severity:string,message:string>>")
        def run(page):
            try:
                made = hook(page.asDict(recursive=True))
            except Exception as problem:  # user code may raise anything
                return [("error", f"plugin failed: {problem}")]
            return [(severity, t) for t in ([made] if isinstance(made, str) else made or [])]

        texts = run(F.struct(*pages.columns))
    rows = pages.where(~F.coalesce("robots_blocked", F.lit(False))).select("seq", "url", F.posexplode(texts).alias("pos", "made"))
    return rows.select(F.lit(plugin.id).alias("rule_id"), F.col("made.severity").alias("severity"), "url", F.col("made.message").alias("message"), F.lit(0).alias("part"), "seq", F.lit(order).alias("rule_seq"), F.col("pos").cast("long").alias("ord"))


def site_findings(pages: DataFrame, plugin: Plugin, order: int) -> DataFrame:
    """Findings of the site hook, computed at once so that its errors can be reported as a finding."""
    spark = pages.sparkSession
    try:
        made = plugin.check_site(pages).select(F.col("url").cast("string").alias("url"), F.col("message").cast("string").alias("message")).checkpoint() if spark.sparkContext.getCheckpointDir() else plugin.check_site(pages).select("url", "message").persist()
        made.count()
        severity = plugin.severity
    except Exception as problem:  # user code may raise anything
        made, severity = spark.createDataFrame([("", f"plugin failed: {str(problem).splitlines()[0]}")], "url string, message string"), "error"
    return made.select(F.lit(plugin.id).alias("rule_id"), F.lit(severity).alias("severity"), "url", "message", F.lit(1).alias("part"), F.lit(None).cast("long").alias("seq"), F.lit(order).alias("rule_seq"), F.monotonically_increasing_id().alias("ord"))
