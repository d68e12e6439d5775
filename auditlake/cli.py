"""Command line: crawl, rules, runs, report, diff."""

from __future__ import annotations

import argparse
import signal
import sys
from pathlib import Path

from .operators.summary import fails
from .plans.config import load_config
from .plans.engine import run_rules
from .plans.model import load_rules
from .schema import SEVERITIES
from .sources import reports
from .sources.store import Store


def _number(text: str) -> int:
    if not text.isdigit():
        raise argparse.ArgumentTypeError(f"{text!r} is not a whole number")
    return int(text)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("auditlake")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("crawl", "rules", "runs", "report", "diff"):
        sub = commands.add_parser(name)
        sub.add_argument("-c", "--config")
        sub.add_argument("--db")
        if name == "crawl":
            sub.add_argument("--responses", help="recorded responses (Parquet); without them pages are fetched")
            sub.add_argument("--max-pages", type=_number)
            sub.add_argument("--max-depth", type=_number)
            sub.add_argument("--fail-on", choices=SEVERITIES)
        if name in ("crawl", "report"):
            for kind in ("md", "json", "html", "sarif"):
                sub.add_argument(f"--{kind}")
            sub.add_argument("--annotations", action="store_true")
        if name == "report":
            sub.add_argument("run", type=_number)
        if name == "diff":
            sub.add_argument("runs", nargs="*", type=_number)
            sub.add_argument("--md", action="store_true")
        if name == "runs":
            sub.add_argument("--name")
    return top


def _write(args, pages, findings, rules, examples: int, aborted: bool = False) -> None:
    summary = reports.summarize(pages, findings, rules)
    print(reports.as_text(summary, examples, aborted))
    made = {"md": lambda: [reports.as_markdown(summary, aborted=aborted)], "json": lambda: reports.json_parts(summary, findings), "html": lambda: reports.html_parts(summary, pages, findings, aborted=aborted), "sarif": lambda: reports.sarif_parts(findings, rules)}
    for kind, parts in made.items():
        if path := getattr(args, kind):
            with Path(path).open("w") as file:
                file.writelines(parts())
    if args.annotations:
        print(reports.annotations(findings))


def main(arguments: list[str] | None = None, spark=None) -> int:
    """0: fine, 1: a finding at --fail-on, 2: usage or failure, 130: interrupted twice."""
    args = parser().parse_args(arguments)
    if getattr(args, "sarif", None) and not args.config:
        print("--sarif needs -c", file=sys.stderr)
        return 2
    try:
        return _run(args, spark)
    except Exception as problem:  # the last resort of a command
        print(f"failed: {problem}", file=sys.stderr)
        return 2


def _run(args, spark) -> int:
    overrides = {k: v for k, v in (("output.db", args.db), ("scope.maxPages", getattr(args, "max_pages", None)), ("scope.maxDepth", getattr(args, "max_depth", None))) if v is not None}
    config = load_config(args.config, overrides) if args.config else None
    rules = load_rules(config.rules, config.ruleOverrides, config.plugins) if config else load_rules()
    if args.command == "rules":
        print(reports.rules_text(rules))
        return 0
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("auditlake").getOrCreate()
    store = Store(spark, args.db or (config.output.db if config else "audit-store"))
    if args.command == "runs":
        print(reports.runs_text(store.runs(args.name)))
        return 0
    if args.command == "report":
        run = store.runs().where(f"id = {args.run}").first()
        if run is None:
            raise ValueError(f"no run {args.run}")
        _write(args, store.pages(args.run), store.findings(args.run), rules, 10, run.aborted)
        return 0
    if args.command == "diff":
        pair = tuple(args.runs) if len(args.runs) == 2 else store.diff_pair(config.name if config else None)
        if not pair:
            raise ValueError("there are no two complete runs to compare")
        from .operators.diff import diff_runs

        before, after = pair
        aborted = store.runs().where(f"id in ({before}, {after}) and aborted").count() > 0
        diff = diff_runs(store.pages(before), store.pages(after), store.findings(before), store.findings(after))
        for line in reports.diff_lines(diff, f"run {before}", f"run {after}", args.md, aborted):
            print(line)
        return 0
    return _crawl(args, config, rules, store, spark)


def _crawl(args, config, rules, store, spark) -> int:
    from .operators.crawl import Scope, crawl
    from .operators.site import SiteContext
    from .sources.inputs import seeds
    from .sources.live import LiveResponses, Manners

    if config is None:
        raise ValueError("crawl needs -c")
    stopped: list[int] = []

    def interrupt(*_):
        if stopped:
            sys.exit(130)
        stopped.append(1)

    before = signal.signal(signal.SIGINT, interrupt)
    try:
        made, listed, warnings = seeds(spark, config.start.urls, [config.start.urlFile] if config.start.urlFile else [], config.start.sitemaps)
        for warning in [*warnings, *rules.warnings]:
            print(f"warning: {warning}", file=sys.stderr)
        s = config.scope
        scope = Scope(s.hosts, s.include, s.exclude, s.maxDepth, s.maxPages, s.followLinks, s.checkExternal, s.maxExternal, config.render.mode, config.politeness.respectRobots)
        run_id = store.start_run(config.name, config)
        p = config.politeness
        responses = spark.read.parquet(args.responses) if args.responses else LiveResponses(Manners(p.concurrency, p.perHost, p.delayMs, p.timeoutMs, p.userAgent))
        # Each level is saved as it ends, so an interrupted run keeps what it has.
        pages, aborted = crawl(spark, made, responses, scope, None, p.userAgent, should_stop=lambda: bool(stopped), on_level=lambda level, _: store.save_pages(run_id, level), warn=lambda text: print(f"warning: {text}", file=sys.stderr))
        store.save_pages(run_id, pages.where("external"))
        pages = store.pages(run_id)
        site = SiteContext(spark.createDataFrame([(u,) for u in listed], "url string") if listed else None, s.followLinks)
        findings = run_rules(pages, rules, site)
        store.finish_run(run_id, findings, aborted)
        findings = store.findings(run_id)
        _write(args, pages, findings, rules, 3, aborted)
        return int(bool(args.fail_on) and fails(findings, args.fail_on))
    finally:
        signal.signal(signal.SIGINT, before)


if __name__ == "__main__":
    sys.exit(main())
