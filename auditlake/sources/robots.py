"""robots.txt: groups by user agent, longest matching rule, crawl delay."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def groups(text: str) -> list[tuple[set[str], list[tuple[bool, str]], float | None]]:
    """(agents, [(allow, pattern)], delay in seconds) of each group."""
    out: list = []
    open_ = False
    for line in text.splitlines():
        name, colon, value = line.partition("#")[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "user-agent":
            if not open_:
                out.append([set(), [], None])
                open_ = True
            out[-1][0].add(value.lower())
        elif out:
            open_ = False
            if name in ("allow", "disallow") and value:
                out[-1][1].append((name == "allow", value))
            elif name == "crawl-delay":
                try:
                    out[-1][2] = float(value)
                except ValueError:
                    pass
    return [tuple(g) for g in out]


def rules_for(text: str, agent: str = "*") -> tuple[list[tuple[bool, str]], float | None]:
    """Rules and delay of the groups that name the agent (without its version), else of ``*``."""
    agent = agent.partition("/")[0].strip()
    found = groups(text)
    own = [g for g in found if agent.lower() in g[0] and agent != "*"] or [g for g in found if "*" in g[0]]
    return [r for g in own for r in g[1]], next((g[2] for g in own if g[2] is not None), None)


def rule_pattern(pattern: str) -> str:
    """Java pattern of a rule: ``*`` any text, a final ``$`` the end."""
    end = pattern.endswith("$")
    body = pattern[:-1] if end else pattern
    return r"(?s)\A" + ".*".join("".join(c if c.isalnum() or c in "/_" else f"\\x{{{ord(c):x}}}" for c in part) for part in body.split("*")) + (r"\z" if end else "")


def is_allowed(text: str, path: str, agent: str = "*") -> bool:
    """Longest rule wins, allow at equal length; no rule allows."""
    best = (-1, True)
    for allow, pattern in rules_for(text, agent)[0]:
        python = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), rule_pattern(pattern)).replace(r"\z", r"\Z")
        if re.search(python, path):
            best = max(best, (len(pattern), allow))
    return best[1]


def allowed(robots: dict[str, str], url: Column, agent: str = "*") -> Column:
    """Column test of addresses against the robots texts of their origins (bounded by the hosts crawled)."""
    origin = F.regexp_extract(url, r"^([a-z]+://[^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^#]*)", 1), r"^(?!/)", "/")
    result = F.lit(True)
    for place, text in robots.items():
        rules, _ = rules_for(text, agent)
        if not rules:
            continue
        hits = [F.when(path.rlike(rule_pattern(p)), F.struct(F.lit(len(p)).alias("n"), F.lit(a).alias("allow"))) for a, p in rules]
        best = reduce(lambda a, b: F.greatest(a, b), hits) if len(hits) > 1 else hits[0]
        result = F.when(origin == place, F.coalesce(best["allow"], F.lit(True))).otherwise(result)
    return result


def delay_ms(text: str, agent: str = "*") -> int:
    seconds = rules_for(text, agent)[1]
    return round(1000 * seconds) if seconds else 0
