"""Keeping the relations fresh from a stream of file changes.

A change row is seq, op (added, modified, deleted), path; rows come late, twice and out of order. State is one row per path with the highest seq seen,
so a batch that is replayed after a failure, or rows that arrive late, leave the same result (foreachBatch is at least once, the
effect is once). Deletions cascade over all relations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions import paths as P
from tessera.operators.relations import PATH, Store, backoff  # noqa: F401
from tessera.sources.scan import supported

CHANGE = "seq long, op string, path string"


def is_deletion(c: str = "op"):
    """Watchers give names or the numbers 1 added, 2 modified, 3 deleted."""
    return F.lower(F.trim(F.col(c).cast("string"))).isin("deleted", "3")


def coalesce(changes: DataFrame, sticky: bool = False) -> DataFrame:
    """path, seq, deleted: what a batch means for each path. By the highest seq; sticky: deleted if any row says so. Partial sums make a hot path one row a task."""
    rows = changes.filter("path IS NOT NULL AND seq IS NOT NULL").select("path", "seq", is_deletion().alias("deleted"))
    gone = F.bool_or("deleted") if sticky else F.max_by("deleted", F.struct("seq", "deleted"))
    return rows.groupBy("path").agg(F.max("seq").alias("seq"), gone.alias("deleted"))


def in_scope(changes: DataFrame, root: str | None = None, suffixes: list[str] | None = None) -> DataFrame:
    out = changes.filter(supported("path", suffixes))
    return out if root is None else out.filter(P.under("path", root))


def fold(state: DataFrame | None, changes: DataFrame, sticky: bool = False) -> DataFrame:
    """State after a batch: path, seq, deleted; rows older than what is known don't count."""
    new = coalesce(changes, sticky)
    both = new if state is None else state.select("path", "seq", "deleted").unionByName(new)
    return both.groupBy("path").agg(F.max("seq").alias("seq"), F.max_by("deleted", F.struct("seq", "deleted")).alias("deleted"))


def newer(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The rows of a coalesced batch that state doesn't know yet."""
    if state is None:
        return batch
    known = state.select("path", F.col("seq").alias("known"))
    return batch.join(known, "path", "left").filter("known IS NULL OR seq > known").drop("known")


def apply_batch(tables: dict[str, DataFrame], work: DataFrame, build: Callable[[DataFrame], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Relations after a batch: all rows of the batch's paths go, those of changed files are built anew. build: paths to relations."""
    touched = work.select("path")
    fresh = build(work.filter("NOT deleted").select("path"))
    out = {}
    for name, df in tables.items():
        c = PATH[name]
        rest = df.join(touched.select(F.col("path").alias(c)), c, "left_anti")
        out[name] = rest.unionByName(fresh[name].select(*df.columns)) if name in fresh else rest
    return out


def watch(changes: DataFrame, store: Store, build: Callable[[DataFrame], dict[str, DataFrame]], checkpoint: str, relations: list[str], root: str | None = None, seconds: float | None = 0.3, sticky: bool = False) -> StreamingQuery:
    """Starts the streaming query over a change stream. seconds None: takes what is there and ends.

    A batch rewrites the buckets of its paths alone; the state of the paths is a relation of the same build, so both become visible at once.
    """

    def batch(df: DataFrame, number: int) -> None:
        """A batch that was published before its commit was recorded is found by its number and left alone."""
        done = store.current()
        if done and done.startswith("batch-") and int(done.split("-")[1]) >= number:
            return
        df = df.persist()  # read once
        if df.isEmpty():
            df.unpersist()
            return
        with store.writer():
            state = store.read("watch_state") if done and done.startswith("batch-") else None
            work = newer(state, coalesce(in_scope(df, root), sticky)).persist()
            fresh = build(work.filter("NOT deleted").select("path"))
            fresh["watch_state"] = fold(state if state is None else state.join(work.select("path"), "path", "left_semi"), work.select("path", "seq", F.when(F.col("deleted"), "deleted").otherwise("modified").alias("op")))
            name = store.stage_changes(fresh, work, [*relations, "watch_state"], f"batch-{number}")
            work.unpersist()
            df.unpersist()
            store.publish(name)

    w = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if seconds is None else w.trigger(processingTime=f"{int(seconds * 1000)} milliseconds")).start()


def status(q: StreamingQuery, totals: dict | None = None) -> dict:
    p = q.lastProgress or {}
    return {"active": q.isActive, "batch": p.get("batchId"), "rows": p.get("numInputRows"), "failure": str(q.exception()) if q.exception() else None, **({"totals": totals} if totals is not None else {})}


def serve(q: StreamingQuery, beat: Callable[[dict], None], wanted: Callable[[], bool], seconds: float = 1.0) -> dict:
    """Runs a watch in the foreground until it ends or is no longer wanted (a stop file, a signal); `beat` gets its state and running totals at each heartbeat."""
    totals, seen = {"batches": 0, "rows": 0}, set()

    def add() -> dict:
        for p in q.recentProgress:
            if p["batchId"] not in seen and p["numInputRows"]:
                seen.add(p["batchId"])
                totals["batches"], totals["rows"] = totals["batches"] + 1, totals["rows"] + p["numInputRows"]
        return status(q, dict(totals))

    while q.isActive and wanted():
        q.awaitTermination(seconds)
        beat(add())
    if q.isActive:
        q.stop()
    return add()
