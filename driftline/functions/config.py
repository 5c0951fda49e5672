"""Target configuration: which files are read, which lines count, for which jobs."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from . import paths

KEEP_DUPLICATE = "DRIFTLINE_KEEP_DUPLICATE"
_TARGET = {"includes", "excludes", "default_excludes", "ignore_patterns", "skip_duplicate", "extra_baselines"}


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class TargetConfig:
    """Patterns are in Java's syntax; an unset list takes everything."""

    includes: list[str] = field(default_factory=list)
    excludes: list[str] = field(default_factory=list)
    default_excludes: bool = True
    ignore_patterns: list[str] = field(default_factory=list)
    skip_duplicate: bool = True
    extra_baselines: list[str] = field(default_factory=list)

    @staticmethod
    def of(given: dict | None) -> TargetConfig:
        given = given or {}
        if unknown := set(given) - _TARGET:
            raise ConfigError(f"unknown fields: {sorted(unknown)}")
        for name in ("includes", "excludes", "ignore_patterns"):
            for pattern in given.get(name) or []:
                re.compile(pattern)
        return TargetConfig(**{k: v for k, v in given.items() if v is not None})

    def included(self, path: Column) -> Column:
        """Whether a source is read, by its path relative to the content."""
        excludes = (*self.excludes, *(P.EXCLUDED_PATHS if self.default_excludes else ()))
        return paths.included(path, self.includes or None, excludes)

    def ignored(self, line: Column) -> Column:
        return line.rlike("|".join(f"(?:{p})" for p in self.ignore_patterns)) if self.ignore_patterns else F.lit(False)

    @property
    def dedupes(self) -> bool:
        return self.skip_duplicate and KEEP_DUPLICATE not in os.environ


@dataclass(frozen=True)
class Config:
    """One configuration for all targets, or a list of matchers: the first that matches the job counts."""

    static: TargetConfig | None
    matchers: list[tuple[str | None, TargetConfig]]

    def index_for(self, job: str | None) -> int | None:
        """The number of the matcher for a job; contents that are no CI builds (None) match the first."""
        if self.static is not None:
            return 0
        return next((i for i, (p, _) in enumerate(self.matchers) if job is None or p is None or re.search(p, job)), None)

    def target(self, job: str | None = None) -> TargetConfig:
        at = self.index_for(job)
        return self.static or (TargetConfig() if at is None else self.matchers[at][1])

    def match(self, job: Column) -> Column:
        """The number of the first matcher for each job, or null (a regular-expression join in one expression)."""
        tests = [F.when(job.isNull() | (job.rlike(p) if p is not None else F.lit(True)), i) for i, (p, _) in enumerate(self.matchers)]
        return F.coalesce(*tests, F.lit(None).cast("int"))


def parse(text: str, name: str = "config.yaml") -> Config:
    """A configuration file, YAML or (by its name) JSON; unknown fields are errors."""
    if name.endswith(".json"):
        given = json.loads(text or "{}")
    else:
        try:
            import yaml
        except ImportError as problem:
            raise ConfigError("reading YAML needs the yaml package; JSON does not") from problem
        given = yaml.safe_load(text)
    if isinstance(given, list):
        matchers = []
        for item in given:
            if unknown := set(item) - {"match_job", "config"}:
                raise ConfigError(f"unknown fields: {sorted(unknown)}")
            if item.get("match_job") is not None:
                re.compile(item["match_job"])
            matchers.append((item.get("match_job"), TargetConfig.of(item.get("config"))))
        return Config(None, matchers)
    if given is not None and not isinstance(given, dict):
        raise ConfigError("a configuration is a mapping or a list of matchers")
    return Config(TargetConfig.of(given), [])
