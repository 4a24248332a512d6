"""The event path as Structured Streaming: outbox, watchdog, limits, breaker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators.pipeline import dispatched

EVENTS = "id long, page_id long, event_type string, payload string, processed boolean, created_at timestamp"


def event_stream(spark: SparkSession, folder: str, schema: str = EVENTS, files_per_batch: int = 16) -> DataFrame:
    """Events as they arrive as Parquet files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def dispatch(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Routes unprocessed events to their jobs, batch by batch; a batch that fails is tried again, so ``sink`` must be idempotent by batch id."""

    def each(batch: DataFrame, number: int) -> None:
        sink(dispatched(batch), number)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def jobs_to_parquet(folder: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch's jobs into a folder of its own, replacing what an earlier try left."""
    return lambda jobs, number: jobs.where("job IS NOT NULL").write.mode("overwrite").parquet(f"{folder}/batch={number}")


def rate_limits(calls: DataFrame, window: str = "60 seconds", most: int = 20, late: str = "10 minutes", key: str = "key") -> DataFrame:
    """Calls of each fixed window and key, and how many beyond the limit are refused; windows close as the watermark passes."""
    of = calls.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), key).agg(F.count("*").alias("n"))
    return of.select(F.col("w.start").alias("window_start"), key, "n", F.greatest(F.col("n") - most, F.lit(0)).alias("refused"))


def daily_usage(questions: DataFrame, users: DataFrame, late: str = "1 day") -> DataFrame:
    """Questions of each user and day (UTC) against the role's limit; users is a static table."""
    from quillspark.operators.metrics import daily_quota

    of = questions.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "user_id").agg(F.count("*").alias("cnt"))
    return daily_quota(of.select("user_id", F.to_date("w.start").alias("usage_date"), "cnt"), users)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", key: str = "user_id") -> DataFrame:
    """An extra beside the library's own windows: events of each key in sessions."""
    of = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return of.select(F.col("w.start").alias("started"), F.col("w.end").alias("ended"), key, "n")


def watchdog(progress: DataFrame, minutes: int = 30) -> DataFrame:
    """(page_id, idle_since): pages in progress that fell silent: state for each page, with an event-time timer.

    ``progress`` has page_id, state and ts (a watermark is set here); a page that leaves ``in_progress`` is forgotten.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    span = minutes * 60_000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"page_id": [key[0]], "idle_since": [pd.Timestamp(last, unit="ms")]})
            return
        rows = pd.concat(list(frames)).sort_values("ts")
        last = rows.iloc[-1]
        at = int(last["ts"].timestamp() * 1000)
        if state.exists:
            at = max(at, state.get[0])
        if last["state"] == "in_progress":
            state.update((at,))
            state.setTimeoutTimestamp(max(at + span, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()

    return progress.withWatermark("ts", "0 seconds").groupBy("page_id").applyInPandasWithState(step, "page_id long, idle_since timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def breakers(calls: DataFrame, breaks_at: int = 5, cooling: float = 30.0) -> DataFrame:
    """(key, state, failures, n_refused) after each batch: a circuit breaker for each key, fed with key, at (seconds), ok."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name, failures, since, refused = state.get if state.exists else ("closed", 0, 0.0, 0)
        for at, ok in pd.concat(list(frames)).sort_values("at")[["at", "ok"]].itertuples(index=False, name=None):
            if name == "open" and at < since + cooling:
                refused += 1
            elif ok:
                name, failures = "closed", 0
            else:
                failures += 1
                if name != "closed" or failures >= breaks_at:
                    name, since = "open", float(at)
        state.update((name, failures, since, refused))
        yield pd.DataFrame({"key": [key[0]], "state": [name], "failures": [failures], "n_refused": [refused]})

    return calls.groupBy("key").applyInPandasWithState(step, "key long, state string, failures long, n_refused long", "name string, failures long, since double, refused long", "update", GroupStateTimeout.NoTimeout)
