"""Streaming forms: capture of appended transcript lines, and alerts as their evaluations arrive."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracelake import schemas
from tracelake.sources.sync import exists, new_captures, read_or
from tracelake.sources.tail import TailSource

log = logging.getLogger(__name__)


def capture_sink(path: str, spill: str, pause_flag: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: append rows that the table lacks; while the flag exists, drop the batch.

    A failing write puts the batch beside the table as JSON; if that fails too, the batch is lost with a log line.
    """

    def write(batch: DataFrame, number: int) -> None:
        if pause_flag and exists(batch.sparkSession, pause_flag):
            return
        rows = batch.select([f.name for f in schemas.schema("capture").fields])
        try:
            new_captures(rows, read_or(batch.sparkSession, path, schemas.schema("capture"))).write.mode("append").parquet(path)
        except Exception:
            log.exception("capture of batch %s failed", number)
            try:
                rows.write.mode("append").json(spill)
            except Exception:
                log.exception("spill of batch %s failed", number)

    return write


class FirstWriter(StatefulProcessor):
    """Lets the first row of a key pass, by time and id within a batch, and none after it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            least = frame.sort_values(["ts", "id"]).head(1)
            first = least if first is None else pd.concat([first, least]).sort_values(["ts", "id"]).head(1)
        if first is not None and not self.seen.exists():
            self.seen.update((True,))
            yield first

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.seen.update((True,))

    def close(self) -> None:
        pass


def first_captures(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The rows of a stream that are the first of their (source, ingest_key), over all its batches; rows without a key all pass.

    Keys are state of the query, one entry each in RocksDB beside the checkpoint, so that a batch costs what its own keys cost,
    however many came before. ``known``, a table of captures, is what was there before the query's first start; later starts
    have the state itself. Needs the session's state store to be RocksDB (:func:`start` sees to that).
    """
    kind = schemas.schema("capture")
    rows = rows.select([f.name for f in kind.fields])
    keys = None if known is None else known.where("ingest_key IS NOT NULL").select("source", "ingest_key").distinct().groupBy("source", "ingest_key")
    keyed = rows.where("ingest_key IS NOT NULL").groupBy("source", "ingest_key").transformWithStateInPandas(FirstWriter(), kind, "append", "none", initialState=keys)
    return keyed.unionByName(rows.where("ingest_key IS NULL"))


def append_sink(path: str, spill: str, pause_flag: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for rows that are first already: each batch is a folder of its query's, so that a batch done again replaces itself.

    While the flag exists, a batch is dropped. A failing write puts it beside the table as JSON, as :func:`capture_sink` does.
    """

    def write(batch: DataFrame, number: int) -> None:
        if pause_flag and exists(batch.sparkSession, pause_flag):
            return
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        try:
            batch.write.mode("overwrite").parquet(f"{path}/query={query}/batch={number}")
        except Exception:
            log.exception("capture of batch %s failed", number)
            try:
                batch.write.mode("append").json(spill)
            except Exception:
                log.exception("spill of batch %s failed", number)

    return write


def tail(spark: SparkSession, folder: str) -> DataFrame:
    """Appended lines (path, start, line) of the transcripts below a folder, with session_id."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("tail").option("path", folder).load().withColumn("session_id", F.regexp_extract("path", r"([^/]*)\.jsonl$", 1))


SESSION_STATE = "human string, last_id string"
PAIRED = "id string, session_id string, start bigint, line string, prompt_text string, parent_id string"


def pair_session(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Carry a session's last human text and assistant id over batches."""
    import json

    from tracelake.functions.messages import human_text

    human, last = state.get if state.exists else (None, None)
    out = []
    for r in sorted((r for f in frames for r in f.itertuples()), key=lambda r: r.start):
        try:
            found = json.loads(r.line)
        except ValueError:
            continue
        if not isinstance(found, dict):
            continue
        message = found.get("message") if isinstance(found.get("message"), dict) else {}
        if found.get("type") == "user":
            said = human_text(message.get("content"))
            human = human if said is None else said
        elif found.get("type") == "assistant":
            own = f"{key[0]}:{found.get('uuid') or r.start}"
            out.append((own, key[0], r.start, r.line, human, last))
            last = own
    state.update((human, last))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in PAIRED.split(", ")])


def paired(lines: DataFrame) -> DataFrame:
    """Assistant lines with prompt and parent; the state of a session outlives batches and restarts."""
    return lines.groupBy("session_id").applyInPandasWithState(pair_session, PAIRED, SESSION_STATE, "append", GroupStateTimeout.NoTimeout)


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start(rows: DataFrame, sink: Callable, checkpoint: str, seconds: int = 2, once: bool = False, rocksdb: bool = False) -> StreamingQuery:
    """Start the query; with ``rocksdb`` its state is kept there, whatever the session says, which is put back."""
    writer = rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    conf = rows.sparkSession.conf
    before = conf.get(STATE_STORE, None)
    if rocksdb:
        conf.set(STATE_STORE, ROCKSDB)
    try:
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()
    finally:
        if rocksdb:
            conf.unset(STATE_STORE) if before is None else conf.set(STATE_STORE, before)


def alert_rows(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Evaluations that fire: a breach while not firing; only ok resolves."""
    firing = state.get[0] if state.exists else False
    out = []
    for r in sorted((r for f in frames for r in f.itertuples()), key=lambda r: (r.ts, r.id)):
        if r.status == "breach" and not firing:
            out.append((r.id, key[0], r.ts))
        if r.status in ("breach", "ok"):
            firing = r.status == "breach"
    state.update((firing,))
    yield pd.DataFrame(out, columns=["id", "objective", "ts"])


def alerts(evaluations: DataFrame) -> DataFrame:
    return evaluations.groupBy("objective").applyInPandasWithState(alert_rows, "id bigint, objective string, ts bigint", "firing boolean", "append", GroupStateTimeout.NoTimeout)


def event_windows(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and means of an event stream by type and hour; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("window.start").alias("start"), "event_type", "n", "mean_value")


def paused(folder: str) -> bool:
    return os.path.exists(os.path.join(folder, "paused"))
