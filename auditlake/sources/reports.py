"""Reports: text, Markdown, JSON, SARIF, HTML and CI annotations.

Totals come from aggregates; findings are streamed into the files that list them all.
"""

from __future__ import annotations

import html
import json
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..operators import summary as S
from ..plans.model import RuleSet

_LEVELS = {"error": "error", "warning": "warning", "info": "note"}


def summarize(pages: DataFrame, findings: DataFrame, rules: RuleSet | None = None, examples: int = 50) -> dict[str, Any]:
    """Counts, status buckets and every rule with its first findings."""
    described = {r.id: r.description for r in rules.rules} if rules else {}
    per_rule = [r.asDict() for r in S.findings_per_rule(findings).select("rule_id", "severity", "n").collect()]
    shown: dict[str, list[dict]] = {}
    for r in S.examples_per_rule(findings, examples).orderBy("rule_id", "rank").select("rule_id", "url", "message", "severity").collect():
        shown.setdefault(r.rule_id, []).append({"url": r.url, "message": r.message, "severity": r.severity})
    return {
        **S.page_counts(pages).first().asDict(), "statuses": {r.bucket: r.n for r in S.status_buckets(pages).collect()}, "severities": S.severity_totals(findings).first().asDict(),
        "rules": [r | {"description": described.get(r["rule_id"], ""), "examples": shown.get(r["rule_id"], [])} for r in per_rule],
    }


def _head(summary: dict) -> list[str]:
    states = ", ".join(f"{k}: {v}" for k, v in summary["statuses"].items())
    totals = ", ".join(f"{v} {k}" for k, v in summary["severities"].items())
    return [f"{summary['pages']} pages ({summary['rendered']} rendered, {summary['external']} external); {states}", f"Findings: {totals}"]


def as_text(summary: dict, examples: int = 3, aborted: bool = False) -> str:
    lines = _head(summary) + ["The run was aborted; results are partial."] * aborted
    for rule in summary["rules"]:
        lines.append(f"{rule['severity']:<8}{rule['rule_id']} ({rule['n']})")
        lines += [f"    {e['url']}  {e['message']}" for e in rule["examples"][:examples]]
        if rule["n"] > examples:
            lines.append(f"    and {rule['n'] - examples} more")
    return "\n".join(lines)


def _cell(text: str) -> str:
    return text.replace("|", "\\|").replace("\r", " ").replace("\n", " ")


def as_markdown(summary: dict, examples: int = 50, aborted: bool = False) -> str:
    lines = ["# Site audit", "", *_head(summary)] + ["", "**The run was aborted; results are partial.**"] * aborted
    for rule in summary["rules"]:
        lines += ["", f"## {rule['rule_id']}: {rule['severity']}, {rule['n']}", "", rule["description"], "", "| Page | Finding |", "|-|-|"]
        lines += [f"| {_cell(e['url'])} | {_cell(e['message'])} |" for e in rule["examples"][:examples]]
        if rule["n"] > examples:
            lines.append(f"\n{rule['n'] - examples} more")
    return "\n".join(lines)


def _found(findings: DataFrame) -> Iterator[Row]:
    """Findings in order, one partition at a time, so the driver never holds them all."""
    ordered = S.with_order(findings).orderBy("ordinal").select("rule_id", "severity", "url", "message", S.fingerprint().alias("print"))
    return ordered.toLocalIterator()


def _listed(items: Iterator[Any], text: Callable[[Any], str]) -> Iterator[str]:
    """A JSON list in parts."""
    lead = "["
    for item in items:
        yield lead + text(item)
        lead = ",\n"
    yield "[]" if lead == "[" else "]"


def json_parts(summary: dict, findings: DataFrame) -> Iterator[str]:
    """Summary without the rules' examples, and all findings, in parts of a JSON text."""
    dump = lambda v: json.dumps(v, ensure_ascii=False)
    yield f'{{"summary": {dump({k: v for k, v in summary.items() if k != "rules"})},\n"findings": '
    yield from _listed(_found(findings), lambda r: dump({"rule_id": r.rule_id, "severity": r.severity, "url": r.url, "message": r.message}))
    yield "}"


def as_json(summary: dict, findings: DataFrame) -> str:
    return "".join(json_parts(summary, findings))


def sarif_parts(findings: DataFrame, rules: RuleSet | None = None) -> Iterator[str]:
    listed = {r.id: {"id": r.id, "shortDescription": {"text": r.description or r.id}, "defaultConfiguration": {"level": _LEVELS[r.severity]}} for r in (rules.rules if rules else [])}
    for r in findings.select("rule_id").distinct().orderBy("rule_id").collect():  # a few names
        listed.setdefault(r.rule_id, {"id": r.rule_id})

    def result(r: Row) -> str:
        made: dict[str, Any] = {"ruleId": r.rule_id, "level": _LEVELS[r.severity], "message": {"text": f"{r.url}: {r.message}" if r.url else r.message}, "partialFingerprints": {"ruleAndUrl": r.print}}
        if r.url:
            made["locations"] = [{"physicalLocation": {"artifactLocation": {"uri": r.url}}}]
        return json.dumps(made, ensure_ascii=False)

    tool = json.dumps({"driver": {"name": "auditlake", "rules": list(listed.values())}}, ensure_ascii=False)
    yield f'{{"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{{"tool": {tool},\n"results": '
    yield from _listed(_found(findings), result)
    yield "}]}"


def as_sarif(findings: DataFrame, rules: RuleSet | None = None) -> str:
    return "".join(sarif_parts(findings, rules))


def annotations(findings: DataFrame, most: int = 50) -> str:
    """CI commands of the most severe findings."""
    names = {"error": "error", "warning": "warning", "info": "notice"}
    escape = lambda t: t.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    rows = S.most_severe(findings, most).collect()
    return "\n".join(f"::{names[r.severity]} title={escape(r.rule_id).replace(',', ' ').replace(':', ' ')}::{escape(f'{r.url} {r.message}'.strip())}" for r in rows)


_STYLE = "body{font:15px/1.5 system-ui;margin:2rem auto;max-width:75rem;padding:0 1rem}table{border-collapse:collapse;width:100%}td,th{border-bottom:1px solid #ccc;padding:.3rem .6rem;text-align:left;overflow-wrap:anywhere}th{cursor:pointer}.error{color:#a00}.warning{color:#850}"
_SCRIPT = """
const rows = JSON.parse(document.getElementById('data').textContent), limit = 500;
let key = 0, up = true;
const find = document.getElementById('find'), body = document.getElementById('rows'), note = document.getElementById('note');
function draw() {
  const text = find.value.toLowerCase();
  const hit = rows.filter(r => r.join(' ').toLowerCase().includes(text)).sort((a, b) => (a[key] > b[key] ? 1 : a[key] < b[key] ? -1 : 0) * (up ? 1 : -1));
  body.replaceChildren(...hit.slice(0, limit).map(r => { const line = document.createElement('tr'); for (const v of r) line.insertCell().textContent = v; line.className = r[0]; return line; }));
  note.textContent = hit.length > limit ? `${limit} of ${hit.length} shown` : `${hit.length}`;
}
document.querySelectorAll('#found th').forEach((h, i) => h.onclick = () => { up = key === i ? !up : true; key = i; draw(); });
find.oninput = draw; draw();
"""


def inline_json(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False).replace("<", "\\u003c")


def html_parts(summary: dict, pages: DataFrame, findings: DataFrame, title: str = "Site audit", aborted: bool = False) -> Iterator[str]:
    """One self-contained page in parts: totals, rules, findings (sortable, filtered, 500 at a time) and pages."""
    esc = lambda v: html.escape(str(v), quote=True)
    rule_rows = "".join(f"<tr class={esc(r['severity'])}><td>{esc(r['rule_id'])}<td>{esc(r['severity'])}<td>{r['n']}<td>{esc(r['description'])}" for r in summary["rules"])
    yield f"<!doctype html><html lang=en><meta charset=utf-8><title>{esc(title)}</title><style>{_STYLE}</style><h1>{esc(title)}</h1>"
    yield from (f"<p>{esc(line)}</p>" for line in _head(summary))
    if aborted:
        yield "<p><b>The run was aborted; results are partial.</b></p>"
    if not summary["rules"]:
        yield "<p>Nothing was found.</p>"
    yield f"<h2>Rules</h2><table><tr><th>Rule<th>Severity<th>Findings<th>Meaning{rule_rows}</table>"
    yield "<h2>Findings</h2><p><input id=find placeholder=Filter> <span id=note></span></p><table id=found><thead><tr><th>Severity<th>Rule<th>Page<th>Finding</thead><tbody id=rows></tbody></table>"
    yield "<h2>Pages</h2><table><tr><th>Page<th>Status<th>External<th>Findings"
    counts = S.findings_per_page(pages, findings).join(pages.select("url", "status", "external", "seq"), "url").orderBy("seq")
    yield from (f"<tr><td>{esc(r.url)}<td>{r.status}<td>{'yes' if r.external else ''}<td>{r.n}" for r in counts.toLocalIterator())
    yield '</table><script id=data type="application/json">'
    yield from _listed(_found(findings), lambda r: inline_json([r.severity, r.rule_id, r.url, r.message]))
    yield f"</script><script>{_SCRIPT}</script></html>"


def as_html(summary: dict, pages: DataFrame, findings: DataFrame, title: str = "Site audit", aborted: bool = False) -> str:
    return "".join(html_parts(summary, pages, findings, title, aborted))


def diff_lines(diff, before: str, after: str, markdown: bool = False, aborted: bool = False) -> Iterator[str]:
    """Lines of text or Markdown of a RunDiff: every row, one partition at a time."""
    mark = "## " if markdown else ""
    yield f"{'# ' if markdown else ''}{before} to {after}"
    if aborted:
        yield "One of the runs was aborted; its pages are incomplete."
    for name, frame, shape in (("Added", diff.added, lambda r: r.url), ("Removed", diff.removed, lambda r: r.url), ("Changed", diff.changes, lambda r: f"{r.url} {r.field}: {r.before} to {r.after}"), ("New findings", diff.new_findings, lambda r: f"{r.rule_id} {r.url}"), ("Resolved findings", diff.resolved_findings, lambda r: f"{r.rule_id} {r.url}")):
        yield ""
        yield f"{mark}{name} ({frame.count()})"
        for r in frame.orderBy("url").toLocalIterator():
            yield f"- {_cell(shape(r))}" if markdown else shape(r)


def diff_text(diff, before: str, after: str, markdown: bool = False, aborted: bool = False) -> str:
    """Text or Markdown of a RunDiff; ``diff_lines`` gives it line by line."""
    return "\n".join(diff_lines(diff, before, after, markdown, aborted))


def runs_text(runs: DataFrame) -> str:
    rows = runs.withColumn("started", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss")).collect()
    return "\n".join(f"{r.id:>5}  {r.started}  {r.name}  {r.pages if r.pages is not None else '-'} pages, {r.findings if r.findings is not None else '-'} findings{'  aborted' if r.aborted else '' if r.finished_at else '  unfinished'}" for r in rows)


def rules_text(rules: RuleSet) -> str:
    return "\n".join(f"{r.severity:<8}{r.scope:<5}{r.id}  {r.description}" for r in rules.rules)
