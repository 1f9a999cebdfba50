"""Session settings that a plan is built under."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame

_REPEATED_KEYS = "spark.sql.variant.allowDuplicateKeys"


def last_key_wins(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Build a plan in which parsed JSON objects keep the last of repeated keys, as JSON readers do.

    Spark decides that when a plan is analysed, by a setting of the session; the session has its own
    value again when the function returns. The function's first argument is a frame or the session.
    """

    @wraps(build)
    def run(first, *args, **kwargs) -> DataFrame:
        conf = (first.sparkSession if isinstance(first, DataFrame) else first).conf
        before = conf.get(_REPEATED_KEYS, None)
        conf.set(_REPEATED_KEYS, "true")
        try:
            return build(first, *args, **kwargs)
        finally:
            conf.unset(_REPEATED_KEYS) if before is None else conf.set(_REPEATED_KEYS, before)

    return run
