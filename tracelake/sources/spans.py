"""Spans of work as JSON lines: written by the driver as they end, read as a table."""

from __future__ import annotations

import contextlib
import json
import logging
import os
import secrets
import threading
import time
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)

SCHEMA = "name string, trace_id string, span_id string, parent_span_id string, start_time_ns bigint, end_time_ns bigint, attributes map<string,string>, status string"
_OPEN: ContextVar[tuple[str, str] | None] = ContextVar("open_span", default=None)


class SpanLog:
    """Appends a line for each span that ends. A path that can't be written costs the lines and a log entry, never the work."""

    def __init__(self, path: str) -> None:
        self.path = path
        self._lock = threading.Lock()

    @contextlib.contextmanager
    def span(self, name: str, **attributes) -> Iterator[dict]:
        """A span around a block, below the one that is open here; attributes may be added to the dictionary it gives.

        Its status is UNSET, or ERROR where the block raises; the exception passes on.
        """
        above = _OPEN.get()
        own = (above[0] if above else secrets.token_hex(16), secrets.token_hex(8))
        token, begun, status = _OPEN.set(own), time.time_ns(), "UNSET"
        try:
            yield attributes
        except BaseException:
            status = "ERROR"
            raise
        finally:
            _OPEN.reset(token)
            self._write({"name": name, "trace_id": own[0], "span_id": own[1], "parent_span_id": above[1] if above else None, "start_time_ns": begun, "end_time_ns": time.time_ns(), "attributes": attributes, "status": status})

    def _write(self, row: dict) -> None:
        try:
            line = json.dumps(row, default=str) + "\n"
            with self._lock:
                os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
                with open(self.path, "a") as f:
                    f.write(line)
        except Exception:
            log.exception("span %s not written", row["name"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Written spans; attributes are read as text."""
    return spark.read.schema(SCHEMA).json(path)
