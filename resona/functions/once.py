"""Large column expressions that are built once for each Spark application."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from typing import Any

from pyspark.sql import SparkSession


def once(build: Callable[[], Any]) -> Callable[[], Any]:
    """build without arguments, whose columns name their inputs and so serve every table."""
    known: dict[str, Any] = {}

    @wraps(build)
    def get() -> Any:
        app = SparkSession.active().sparkContext.applicationId
        if app not in known:
            known.clear()
            known[app] = build()
        return known[app]

    return get
