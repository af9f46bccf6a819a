"""Every registered query over the model's tables: name -> (query, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tessera.plans import analytic, evolution, more, parts, relational, rules, written
from tessera.sources.fixtures import Tables

CASES: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {**relational.CASES, **analytic.CASES, **more.CASES, **rules.CASES, **evolution.CASES, **parts.CASES, **written.CASES}
