"""The table of runs as a queue, and the registry of workers: every update gives the next snapshot. Times are parameters.

Parquet has no update with a condition; one driver writes the snapshots, and ``incremental.Store`` swaps them.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.config import DEFAULT
from corpusloom.operators.manifest import latest, sweep

# The states of a run that block another one; the seconds after which a run is silent or unclaimed.
ACTIVE = ["queued", "running", "paused"]
SILENT_SECONDS, GRACE_SECONDS = 30, 12
ERROR_CHARS = 2000


def _older(column: str, as_of: datetime, seconds: float) -> Column:
    return F.col(column) < F.lit(as_of) - F.expr(f"interval {seconds} seconds")


def where_set(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """``df`` with columns set where ``condition`` is true."""
    return df.withColumns({name: F.when(F.coalesce(condition, F.lit(False)), value).otherwise(F.col(name)) for name, value in values.items()})


def next_queued(runs: DataFrame) -> DataFrame:
    """The run to claim: the queued one requested first, none while another run is running or paused."""
    busy = runs.where(F.col("status").isin("running", "paused")).select("id").limit(1)
    free = runs.where("status = 'queued'").orderBy("requested_at", "id").limit(1)
    return free.join(busy.select(F.lit(True).alias("_busy")), F.lit(True), "left_anti")  # at most one row on either side


def claim(runs: DataFrame, run_id: str, worker_id: str, as_of: datetime) -> DataFrame:
    """The next snapshot with ``run_id`` running for ``worker_id``, unchanged if it is not queued any more."""
    mine = (F.col("id") == run_id) & (F.col("status") == "queued")
    return where_set(runs, mine, status=F.lit("running"), worker_id=F.lit(worker_id), started_at=F.lit(as_of), heartbeat_at=F.lit(as_of))


def heartbeat(runs: DataFrame, run_id: str, as_of: datetime, phase: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(next snapshot, what the run was told (control, discovery_enabled)): a sign of life and the flags read back."""
    mine = F.col("id") == run_id
    values = {"heartbeat_at": F.lit(as_of)} | ({"current_phase": F.lit(phase)} if phase is not None else {})
    return where_set(runs, mine, **values), runs.where(mine).select("control", "discovery_enabled")


def reap(runs: DataFrame, as_of: datetime, minutes: float = DEFAULT.stale_minutes) -> DataFrame:
    """The next snapshot: running and paused runs without a sign of life for ``minutes`` have failed. See :func:`reaped`."""
    return where_set(runs, reaped(as_of, minutes), status=F.lit("failed"), finished_at=F.lit(as_of), error=F.lit("no heartbeat for too long"))


def reaped(as_of: datetime, minutes: float = DEFAULT.stale_minutes) -> Column:
    return F.col("status").isin("running", "paused") & _older("heartbeat_at", as_of, minutes * 60)


def set_control(runs: DataFrame, run_id: str, control: str) -> DataFrame:
    """The next snapshot with a run's control flag; ``resume`` clears it."""
    return where_set(runs, F.col("id") == run_id, control=F.lit("none" if control == "resume" else control))


def mark_failed(runs: DataFrame, run_id: str, error: str, as_of: datetime) -> DataFrame:
    return where_set(runs, F.col("id") == run_id, status=F.lit("failed"), finished_at=F.lit(as_of), error=F.lit(error[:ERROR_CHARS]))


def schedule_due(runs: DataFrame, as_of: datetime, every_hours: float) -> DataFrame:
    """One row (due): whether a sync run is to be enqueued: scheduling is on, none is active and the last request is old enough."""
    last = F.max(F.when(F.col("mode") == "sync", F.col("requested_at")))
    idle = F.count_if(F.col("status").isin(*ACTIVE)) == 0
    due = F.coalesce(last <= F.lit(as_of) - F.expr(f"interval {every_hours * 3600} seconds"), F.lit(True))
    return runs.agg((F.lit(every_hours > 0) & idle & due).alias("due"))


def status_chip(runs: DataFrame, as_of: datetime) -> DataFrame:
    """One row (chip, id, status): idle without an active run, stale if it is silent or unclaimed, else paused or live."""
    active = runs.where(F.col("status").isin(*ACTIVE))
    one = active.agg(F.max_by(F.struct("id", "status", "requested_at", "heartbeat_at"), F.struct("requested_at", "id")).alias("r")).select("r.*")
    unclaimed = (F.col("status") == "queued") & _older("requested_at", as_of, GRACE_SECONDS)
    silent = F.col("status").isin("running", "paused") & (F.col("heartbeat_at").isNull() | _older("heartbeat_at", as_of, SILENT_SECONDS))
    chip = F.when(F.col("id").isNull(), "idle").when(F.coalesce(unclaimed | silent, F.lit(False)), "stale").when(F.col("status") == "paused", "paused").otherwise("live")
    return one.select(chip.alias("chip"), "id", "status")


def pace(runs: DataFrame, due: int | Column, as_of: datetime) -> DataFrame:
    """Rows (id, rate, minutes_left): requests a minute of each running run, and how long ``due`` resources take at that rate."""
    minutes = (F.unix_millis(F.lit(as_of)) - F.unix_millis("started_at")) / 60_000
    rate = F.when(minutes > 0.05, F.round(F.col("requests_made") / minutes)).otherwise(0).cast("bigint")
    left = due if isinstance(due, Column) else F.lit(due)
    rows = runs.where("status = 'running'").withColumn("rate", F.coalesce(rate, F.lit(0)))
    return rows.select("id", "rate", F.when((F.col("rate") > 0) & (left > 0), F.ceil(left / F.col("rate"))).cast("bigint").alias("minutes_left"))


def tick_delta(totals: DataFrame, at: str, total: str) -> DataFrame:
    """``totals`` with the growth of ``total`` since the tick before, never negative; one row a tick, ordered by ``at``.

    One series of a run's ticks is a few thousand rows.
    """
    from pyspark.sql.window import Window

    before = F.lag(total).over(Window.partitionBy(F.lit(0)).orderBy(at))
    return totals.withColumn("delta", F.greatest(F.lit(0), F.col(total) - F.coalesce(before, F.col(total))))


def upsert_worker(workers: DataFrame, row: DataFrame) -> DataFrame:
    """The registry with the newest row of each worker (id, last_seen_at, ...)."""
    return latest(workers.unionByName(row, allowMissingColumns=True).withColumn("worker", F.col("id")), "worker", "last_seen_at").drop("worker").select(*workers.columns)


def deregister(workers: DataFrame, worker_id: str) -> DataFrame:
    return workers.where(F.col("id") != worker_id)


def live_tallies(workers: DataFrame, as_of: datetime, minutes: float = DEFAULT.stale_minutes) -> DataFrame:
    """One row (active, standby, multiple): the workers seen within ``minutes`` by role."""
    fresh = sweep(workers, as_of, minutes, "last_seen_at")
    active = F.count_if(F.col("role") == "active")
    return fresh.agg(active.alias("active"), F.count_if(F.col("role") != "active").alias("standby"), (active > 1).alias("multiple"))


def worker_list(workers: DataFrame) -> DataFrame:
    return workers.orderBy("role", "started_at", "id")


def drive(step: Callable[[int], int], control: Callable[[], str], sleep: Callable[[], None], most: int | None = None) -> str:
    """Call ``step(number)``, which does one bounded batch and returns how much is left, until nothing is or ``most`` ran.

    ``control`` is asked before each: ``pause`` waits, ``cancel`` ends. Returns done, canceled or more.
    """
    n = 0
    while most is None or n < most:
        told = control()
        if told == "cancel":
            return "canceled"
        if told == "pause":
            sleep()
            continue
        if step(n) <= 0:
            return "done"
        n += 1
    return "more"
