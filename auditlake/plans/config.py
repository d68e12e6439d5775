"""Configuration files: strict keys, defaults, and command-line overrides."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any

import yaml


class ConfigError(ValueError):
    pass


@dataclass
class Start:
    urls: list[str] = field(default_factory=list)
    sitemaps: list[str] = field(default_factory=list)
    urlFile: str | None = None


@dataclass
class ScopeConfig:
    hosts: list[str] = field(default_factory=list)
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    maxDepth: int = 3
    maxPages: int = 1000
    followLinks: bool = True
    checkExternal: bool = False
    maxExternal: int = 500


@dataclass
class Render:
    mode: str = "auto"
    concurrency: int = 2
    timeoutMs: int = 30_000
    waitUntil: str = "networkidle"
    blockResources: list[str] = field(default_factory=lambda: ["image", "media", "font"])


@dataclass
class Politeness:
    concurrency: int = 4
    perHost: int = 2
    delayMs: int = 250
    respectRobots: bool = True
    timeoutMs: int = 20_000
    userAgent: str = "auditlake"


@dataclass
class Output:
    db: str = "audit-store"


@dataclass
class Config:
    name: str = "crawl"
    start: Start = field(default_factory=Start)
    scope: ScopeConfig = field(default_factory=ScopeConfig)
    render: Render = field(default_factory=Render)
    politeness: Politeness = field(default_factory=Politeness)
    rules: list[str] = field(default_factory=lambda: ["builtin:default"])
    ruleOverrides: dict[str, dict] = field(default_factory=dict)
    plugins: list[str] = field(default_factory=list)
    output: Output = field(default_factory=Output)


def _fill(target: Any, given: Any, where: str, problems: list[str]) -> Any:
    if not isinstance(given, dict):
        problems.append(f"{where or 'config'}: expected a mapping")
        return target
    known = {f.name: f for f in fields(target)}
    for key, value in given.items():
        place = f"{where}.{key}" if where else key
        if key not in known:
            problems.append(f"{place}: unknown key")
            continue
        now = getattr(target, key)
        if is_dataclass(now):
            _fill(now, value, place, problems)
        elif now is not None and (type(value) is not type(now)) or now is None and not isinstance(value, str):
            problems.append(f"{place}: expected {type(now).__name__ if now is not None else 'text'}")
        elif isinstance(value, int) and not isinstance(value, bool) and value < 0:
            problems.append(f"{place}: must not be negative")
        else:
            setattr(target, key, value)
    return target


def parse_config(given: dict, overrides: dict[str, Any] | None = None) -> Config:
    """All problems at once; ``overrides`` maps dotted keys to values and wins."""
    problems: list[str] = []
    config = _fill(Config(), given, "", problems)
    for key, value in (overrides or {}).items():
        part, _, last = key.rpartition(".")
        _fill(getattr(config, part) if part else config, {last: value}, part, problems)
    if config.render.mode not in ("auto", "raw", "render"):
        problems.append("render.mode: expected auto, raw or render")
    if not (config.start.urls or config.start.sitemaps or config.start.urlFile):
        problems.append("start: give urls, sitemaps or a urlFile")
    if problems:
        raise ConfigError("\n".join(problems))
    return config


def load_config(path: str, overrides: dict[str, Any] | None = None) -> Config:
    """A YAML file; its relative paths are taken from its folder."""
    content = yaml.safe_load(Path(path).read_text()) or {}
    config = parse_config(content, overrides)
    base = Path(path).parent
    if config.start.urlFile:
        config.start.urlFile = str(base / config.start.urlFile)
    config.rules = [r if r.startswith("builtin:") else str(base / r) for r in config.rules]
    config.plugins = [str(base / p) for p in config.plugins]
    if "output.db" not in (overrides or {}):
        config.output.db = str(base / config.output.db)
    return config
