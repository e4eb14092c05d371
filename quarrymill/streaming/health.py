"""States that follow from a log of calls, checks or counts: circuit breakers, failover, phases of an index run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Consecutive failures that open a breaker, and seconds until a call may try again.
FAILURES, OPEN_SECONDS = 3, 30
#: Seconds of health after which the primary store is taken back.
RECOVERY_SECONDS = 300


def _seconds(time: str) -> Column:
    """Of a timestamp of either kind, or a number of seconds."""
    return F.col(time).cast("timestamp").cast("double")


def breaker_states(calls: DataFrame, by: str, time: str, order: list[str], failed: Column, failures: int = FAILURES, open_seconds: float = OPEN_SECONDS) -> DataFrame:
    """``calls`` with ``state``, what each found: closed, open (it is refused) or half_open (it may try).

    A breaker opens after so many failures in a row and lets one call try once the last of them is old enough; a success
    closes it.
    """
    before = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    run = Window.partitionBy(by, "_successes").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = calls.withColumn("_failed", failed.cast("int"))
    rows = rows.withColumn("_successes", F.coalesce(F.sum(1 - F.col("_failed")).over(before), F.lit(0)))
    # Within a run the first row follows the success that ended the one before.
    in_row = F.coalesce(F.sum("_failed").over(run), F.lit(0))
    last = F.max(F.when(F.col("_failed") == 1, _seconds(time))).over(run)
    state = F.when(in_row < failures, "closed").when(_seconds(time) - last > open_seconds, "half_open").otherwise("open")
    return rows.withColumn("state", state).drop("_failed", "_successes")


def active_store(checks: DataFrame, by: str, time: str, order: list[str], healthy: Column, recovery_seconds: float = RECOVERY_SECONDS) -> DataFrame:
    """``checks`` of the primary store with ``active``: the backup from a failed check until it has been healthy for long enough."""
    seen = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(~healthy, _seconds(time))).over(seen)
    down = F.coalesce(_seconds(time) - last < recovery_seconds, F.lit(False))
    return checks.withColumn("active", F.when(down, "backup").otherwise("primary"))


#: Phases of an index run, in order.
PHASES = ["discovery", "chunking", "embedding", "indexing", "complete"]


def phase(discovered: Column, chunked: Column, embedded: Column, indexed: Column) -> Column:
    """The first phase that isn't through with what the one before gave it."""
    return F.when(discovered == 0, PHASES[0]).when(chunked < discovered, PHASES[1]).when(embedded < chunked, PHASES[2]).when(indexed < embedded, PHASES[3]).otherwise(PHASES[4])


class Progress(StreamingQueryListener):
    """Rows and batches of the session's streams as they go on, and how they ended."""

    def __init__(self):
        self.rows, self.batches, self.ended = 0, 0, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows
        self.batches += 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.append(event.exception)
