"""Requests to a paged service that are tried again, and what a cache of its pages would be read as."""

from __future__ import annotations

import random
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ATTEMPTS, BASE_SECONDS = 5, 2.0
PAGES = "appid string, filter string, page int, cursor string, next_cursor string, payload string"


class TransportError(Exception):
    """A failed request: its status, 0 for the network's own failures, and the wait that the service asks for."""

    def __init__(self, status: int, retry_after: float | None = None) -> None:
        super().__init__(f"status {status}")
        self.status, self.retry_after = status, retry_after


def with_backoff(call: Callable[[], dict], sleep: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = lambda: random.uniform(0, 0.5)) -> dict:
    """The answer, after waits that double where the service is busy or broken; other failures aren't tried again."""
    for attempt in range(ATTEMPTS):
        try:
            return call()
        except TransportError as e:
            if attempt == ATTEMPTS - 1 or not (e.status in (0, 429) or e.status >= 500):
                raise
            sleep(e.retry_after if e.retry_after is not None else BASE_SECONDS * 2**attempt + jitter())
    raise AssertionError


def replay_pages(cached: DataFrame) -> DataFrame:
    """The cached pages that a sweep would read again: those whose cursor is the one the page before led to."""
    before = cached.select(F.col("appid").alias("a"), F.col("filter").alias("f"), (F.col("page") + 1).alias("p"), F.col("next_cursor").alias("led_to"))
    both = cached.join(before, (F.col("appid") == F.col("a")) & (F.col("filter") == F.col("f")) & (F.col("page") == F.col("p")), "left")
    fits = ((F.col("page") == 0) & (F.col("cursor") == "*")) | (F.col("cursor") == F.col("led_to"))
    return both.where(fits).drop("a", "f", "p", "led_to")
