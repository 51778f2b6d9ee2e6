"""References to records that do not exist, by table and month.

Method: references and existence are change deltas that carry a sign. A reference adds +1 to its key's reference count at the time of its record; a
record adds +1 to its key's existence count at its own time, and the removal of its file adds -1 there. Counts are kept per key and time, so that
whatever was added can be taken back: the earliest time of a key is that of the earliest count that is still positive. Keys with positive
references and zero existence are the orphans. `apply_deltas` folds a batch of deltas into such counts, so a stream or a
later batch continues from them; `orphan_report` derives the three states of one reference.

Deltas are summed on the map side before the shuffle, so a key that a third of all rows name costs a few rows a task. The join
of references with their key's counts has one row per key on the right; AQE splits a hot key's left rows.

Defined cases: null and blank references are left out, as are calls listed in `externals`. A record without a
commit time has a null period and is never `late`. Repeated rows count once. Empty tables give an empty report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.runtime import Scratch, is_blank

KEY, COUNTS = ["kind", "scope", "ref"], ["refs", "live", "removed"]


def apply_deltas(state: DataFrame | None, deltas: DataFrame, key: list[str]) -> DataFrame:
    """Counts per key and time after the deltas: key columns, at, refs, live, removed; state may be None at the start.

    deltas: key columns; at, the time that the count belongs to (null if unknown); refs, live and removed BIGINT, each with a sign.
    A row whose counts are all zero is dropped.
    """
    cols = [*key, "at", *COUNTS]
    both = deltas.select(cols) if state is None else state.select(cols).unionByName(deltas.select(cols))
    return both.groupBy(*key, "at").agg(*(F.sum(c).alias(c) for c in COUNTS)).filter(" OR ".join(f"{c} <> 0" for c in COUNTS))


def key_totals(state: DataFrame, key: list[str]) -> DataFrame:
    """Per key: refs, live, removed, born (earliest time with a live row) and asked (earliest time with a reference)."""
    out = state.groupBy(*key).agg(*(F.sum(c).alias(c) for c in COUNTS), F.min(F.when(F.col("live") > 0, F.col("at"))).alias("born"), F.min(F.when(F.col("refs") > 0, F.col("at"))).alias("asked"))
    return out.filter(" OR ".join(f"{c} <> 0" for c in COUNTS))


def orphan_keys(totals: DataFrame) -> DataFrame:
    """The current orphans: positive references, zero existence."""
    return totals.filter("refs > 0 AND live <= 0")


def removed_files(file_changes: DataFrame) -> DataFrame:
    """Paths whose change with the highest seq is a deletion."""
    last = file_changes.filter("path IS NOT NULL AND seq IS NOT NULL").groupBy("path").agg(F.max_by("op", "seq").alias("op"))
    return last.filter(F.lower(F.trim("op")) == "deleted").select(F.col("path").alias("file_path"))


def references(chunks: DataFrame, symbols: DataFrame, commits: DataFrame, externals: DataFrame) -> DataFrame:
    """Distinct references: table_name, kind (id or call), record_id, ref, scope (the repo of a call, else ''), at (time of the record)."""
    when = commits.groupBy("commit_hash").agg(F.min("committed_at").alias("at"))
    dated = lambda df: df.join(when, "commit_hash", "left")
    c = dated(chunks.select("chunk_id", "symbol_id", "commit_hash").filter(~is_blank("symbol_id")))
    c = c.groupBy(F.col("chunk_id").alias("record_id"), F.col("symbol_id").alias("ref")).agg(F.min("at").alias("at"))
    # arrays can't be summarised before the shuffle by a cheap key, so the calls stay whole: all rows of an id agree on them
    s = dated(symbols.select("id", "container_id", "repo_id", "calls", "commit_hash").filter("id IS NOT NULL"))
    s = s.groupBy(F.col("id").alias("record_id")).agg(F.min("at").alias("at"), F.collect_set("container_id").alias("containers"), F.collect_set(F.struct("repo_id", "calls")).alias("named"))
    held = s.select("record_id", "at", F.explode("containers").alias("ref")).filter(~is_blank("ref"))
    calls = s.select("record_id", "at", F.inline("named")).select("record_id", "at", F.coalesce("repo_id", F.lit("")).alias("scope"), F.explode("calls").alias("ref")).filter(~is_blank("ref")).distinct()
    calls = calls.join(externals.select(F.col("name").alias("ref")).distinct(), "ref", "left_anti")
    cols = ["table_name", "kind", "record_id", "ref", "scope", "at"]
    return (
        c.withColumns({"table_name": F.lit("chunks"), "kind": F.lit("id"), "scope": F.lit("")}).select(cols)
        .unionByName(held.withColumns({"table_name": F.lit("symbols"), "kind": F.lit("id"), "scope": F.lit("")}).select(cols))
        .unionByName(calls.withColumns({"table_name": F.lit("calls"), "kind": F.lit("call")}).select(cols))
    )


def _utc_month(df: DataFrame, c: str) -> Column:
    zoned = dict(df.dtypes)[c] == "timestamp"
    return F.date_format(F.to_utc_timestamp(c, F.current_timezone()) if zoned else F.col(c), "yyyy-MM")


def existing(symbols: DataFrame, commits: DataFrame) -> DataFrame:
    """kind, scope, ref, file_path, at: the keys under which each row of symbols can be named, with the row's time."""
    when = commits.groupBy("commit_hash").agg(F.min("committed_at").alias("at"))
    rows = symbols.select("id", "name", "fqname", "repo_id", "file_path", "commit_hash").filter("id IS NOT NULL").join(when, "commit_hash", "left")
    repo = F.coalesce("repo_id", F.lit(""))
    keys = F.array(
        F.struct(F.lit("id").alias("kind"), F.lit("").alias("scope"), F.col("id").alias("ref")),
        F.struct(F.lit("call").alias("kind"), repo.alias("scope"), F.col("name").alias("ref")),
        F.struct(F.lit("call").alias("kind"), repo.alias("scope"), F.col("fqname").alias("ref")),
    )
    return rows.select(F.inline(F.array_distinct(keys)), "file_path", "at").filter("ref IS NOT NULL")


def _counts(rows: DataFrame, refs, live, removed) -> DataFrame:
    return rows.select(*KEY, "at", *((F.lit(c) if isinstance(c, int) else c).cast("long").alias(n) for c, n in zip((refs, live, removed), COUNTS)))


def existence_deltas(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Signed deltas of the rows of `existing`: each adds 1 to live; if its file is among `gone` (file_path), 1 goes from live to removed."""
    lost = rows.join(gone.select("file_path", F.lit(1).alias("lost")), "file_path", "left").withColumn("lost", F.coalesce("lost", F.lit(0)))
    return _counts(lost, 0, 1 - F.col("lost"), F.col("lost"))


def removal_deltas(rows: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Deltas of the rows of `existing` whose files were removed or came back between two states of the removed files."""
    turn = before.withColumn("was", F.lit(1)).join(after.withColumn("now", F.lit(1)), "file_path", "full_outer").select("file_path", (F.coalesce("now", F.lit(0)) - F.coalesce("was", F.lit(0))).alias("turn"))
    return _counts(rows.join(turn.filter("turn <> 0"), "file_path"), 0, -F.col("turn"), F.col("turn"))


def reference_deltas(refs: DataFrame, sign: int = 1) -> DataFrame:
    """One reference more (or less) per row of `references`."""
    return _counts(refs, sign, 0, 0)


def key_state(refs: DataFrame, symbols: DataFrame, commits: DataFrame, file_changes: DataFrame) -> DataFrame:
    """The counts of every key that is referenced or exists, in one pass."""
    return apply_deltas(None, reference_deltas(refs).unionByName(existence_deltas(existing(symbols, commits), removed_files(file_changes))), KEY)


def report_of(refs: DataFrame, state: DataFrame) -> DataFrame:
    """table_name, period (yyyy-MM of the record), record_id, ref, state: absent, deleted or late; one row per reference with a state."""
    wanted = key_totals(state, KEY).filter("refs > 0 AND (live <= 0 OR born > asked)").select(*KEY, "live", "removed", "born")
    what = F.when(F.col("live") <= 0, F.when(F.col("removed") > 0, "deleted").otherwise("absent")).when(F.col("born") > F.col("at"), "late")
    return (
        refs.join(wanted, KEY).withColumn("state", what).filter("state IS NOT NULL")
        .select("table_name", _utc_month(refs, "at").alias("period"), "record_id", "ref", "state").distinct()
    )


def orphan_report(chunks: DataFrame, symbols: DataFrame, commits: DataFrame, externals: DataFrame, file_changes: DataFrame) -> DataFrame:
    """The report of the tables as they are."""
    refs = references(chunks, symbols, commits, externals)
    return report_of(refs, key_state(refs, symbols, commits, file_changes))


def report_in_batches(chunks: DataFrame, symbols: DataFrame, commits: DataFrame, externals: DataFrame, file_changes: DataFrame, upto_seq: int) -> DataFrame:
    """The same report from counts that are kept over three batches: the records as the changes up to a seq leave them, the references, the changes after it.

    Each state is written before the next batch is folded in, as a running job would; removals of the last batch take counts back and files that
    come back return them.
    """
    scratch, rows = Scratch(chunks.sparkSession, "orphans"), existing(symbols, commits)
    refs = references(chunks, symbols, commits, externals)
    before, after = removed_files(file_changes.filter(F.col("seq") <= upto_seq)), removed_files(file_changes)
    state = None
    for i, batch in enumerate((existence_deltas(rows, before), reference_deltas(refs), removal_deltas(rows, before, after))):
        state = scratch.cut(apply_deltas(state, batch, KEY), f"state{i}")
    return report_of(refs, state)


def key_counts(chunks: DataFrame, symbols: DataFrame, commits: DataFrame, externals: DataFrame, file_changes: DataFrame) -> DataFrame:
    """The signed counts of every key that is referenced or exists."""
    return key_totals(key_state(references(chunks, symbols, commits, externals), symbols, commits, file_changes), KEY)


def orphan_summary(found: DataFrame) -> DataFrame:
    """Orphan references per table, month and state."""
    return found.groupBy("table_name", "period", "state").agg(F.count("*").alias("n"))
