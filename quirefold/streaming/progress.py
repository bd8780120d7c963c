"""Reading progress: a keyed state, last write wins, as a batch table and as a stream."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import rounded
from ..storage import written


def load(files: DataFrame) -> DataFrame:
    """(path, scroll, ts_ms) of stored states: files(value), each a JSON object path -> {scroll, timestamp}.

    A text that is no such object counts as empty.
    """
    states = F.from_json("value", "map<string,struct<scroll:double,timestamp:bigint>>", {"mode": "PERMISSIVE"})
    return files.select(F.explode(states)).select(F.col("key").alias("path"), F.col("value.scroll").alias("scroll"), F.col("value.timestamp").alias("ts_ms"))


def dump(state: DataFrame) -> DataFrame:
    """One row a path: its JSON member; a state file is their concatenation in braces."""
    return state.select("path", F.to_json(F.struct("scroll", F.col("ts_ms").alias("timestamp"))).alias("value"))


def latest(events: DataFrame, keys: list[str], value: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; works on a stream in complete or update mode, too."""
    return events.groupBy(*keys).agg(F.max_by(F.struct(*value), F.struct(*order)).alias("last")).select(*keys, "last.*")


def apply_log(log: DataFrame) -> DataFrame:
    """The state after log(seq, op, path, new_path, scroll, ts_ms) with op save, rename or delete; seq is unique.

    A rename moves a state to the new path, replacing what is there, and does nothing without one; a delete, or a rename
    onto the same name, ends it.  Renames cross keys, so each state is followed along them, a hop at a time for all rows
    at once: a window finds the next rename or delete of its name, and of states that meet it only the one that came to
    the name last goes on.  The numbers at which a state came to its names, the last first, order states on one name.
    """
    ends = F.struct(F.col("seq").alias("at"), F.when(F.col("new_path") != F.col("path"), F.col("new_path")).alias("to"))
    stops = log.where("op IN ('rename', 'delete')").select("path", F.col("seq").alias("at"), F.when(F.col("op") == "rename", ends).otherwise(F.struct(F.col("seq").alias("at"), F.lit(None).cast("string").alias("to"))).alias("stop"))
    alive = log.where("op = 'save'").select("path", F.col("seq").alias("at"), F.array("seq").alias("arrivals"), "scroll", "ts_ms")
    later = Window.partitionBy("path").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    state = F.struct("at", "scroll", "ts_ms", "arrivals")
    settled = None
    while True:
        both = alive.unionByName(stops, allowMissingColumns=True).withColumn("next", F.last("stop", ignorenulls=True).over(later)).where("arrivals IS NOT NULL")
        best = written(both.groupBy("path", "next").agg(F.max_by(state, "arrivals").alias("s")), "progress")
        rest = best.where("next IS NULL").select("path", "s.arrivals", "s.scroll", "s.ts_ms")
        settled = rest if settled is None else settled.unionByName(rest)
        moved = best.where("next.to IS NOT NULL").select(F.col("next.to").alias("path"), F.col("next.at").alias("at"), F.concat(F.array("next.at"), "s.arrivals").alias("arrivals"), "s.scroll", "s.ts_ms")
        if not moved.limit(1).count():
            break
        alive = moved
    return settled.groupBy("path").agg(F.max_by(F.struct("scroll", "ts_ms"), "arrivals").alias("s")).select("path", "s.scroll", "s.ts_ms")


def lookup(state: DataFrame, paths: DataFrame) -> DataFrame:
    return paths.join(state, "path", "left")


def states(raw: DataFrame) -> DataFrame:
    """Polled positions as they are kept: rows without a number are left out, positions are rounded."""
    return raw.where(F.col("scroll").isNotNull() & ~F.isnan("scroll")).withColumn("scroll", rounded(F.col("scroll")))


STATE = "path string, scroll double, ts_ms long"
#: Snapshots that stay: a batch that is repeated after a failure reads the one before its own.
KEPT = 2


def _sink(table: str, merge: Callable[[DataFrame, DataFrame], DataFrame]):
    """A foreachBatch sink that keeps a Parquet snapshot current, and writes only what changed.

    Snapshots are numbered; a failed batch is repeated and overwrites its own number, so each batch counts once.  Older
    snapshots than the last KEPT are deleted.
    """

    def run(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        before = current(session, table, below=number)
        merged = merge(batch, before)
        if not before.isEmpty() and merged.exceptAll(before).isEmpty() and before.join(merged, "path", "left_anti").isEmpty():
            return
        merged.write.mode("overwrite").parquet(f"{table}/n={number}")
        for old in _numbers(session, table)[:-KEPT]:
            path = session._jvm.org.apache.hadoop.fs.Path(f"{table}/n={old}")
            path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)

    return run


def upsert(table: str):
    """The sink of events(path, scroll, ts_ms): the latest of each path stays."""
    return _sink(table, lambda batch, before: latest(before.unionByName(batch.select("path", "scroll", "ts_ms")), ["path"], ["scroll", "ts_ms"], ["ts_ms", "scroll"]))


def replay(table: str):
    """The sink of log(seq, op, path, new_path, scroll, ts_ms): what apply_log makes of the state and the batch's rows.

    seq is not negative, and of later batches larger.  The state counts as saves before all of them.
    """

    def merge(batch: DataFrame, before: DataFrame) -> DataFrame:
        saved = before.select(F.lit(-1).cast("long").alias("seq"), F.lit("save").alias("op"), "path", F.lit(None).cast("string").alias("new_path"), "scroll", "ts_ms")
        return apply_log(saved.unionByName(batch.select(*saved.columns))).select("path", "scroll", "ts_ms")

    return _sink(table, merge)


def _numbers(spark: SparkSession, table: str) -> list[int]:
    """Of all whole snapshots, ascending: no more than KEPT and one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        return []
    found = [s.getPath() for s in store.listStatus(path)]
    return sorted(int(p.getName()[2:]) for p in found if p.getName().startswith("n=") and store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def current(spark: SparkSession, table: str, below: int | None = None) -> DataFrame:
    """The newest snapshot (with a smaller number than `below`), empty before the first."""
    numbers = [n for n in _numbers(spark, table) if below is None or n < below]
    return spark.read.schema(STATE).parquet(f"{table}/n={numbers[-1]}") if numbers else spark.createDataFrame([], STATE)


def _start(events: DataFrame, sink, checkpoint: str, every: str | None):
    writer = events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def track(events: DataFrame, table: str, checkpoint: str, every: str | None = "500 milliseconds"):
    """Start the stream of events(path, scroll, ts_ms) into snapshots; every=None takes what is there and stops."""
    return _start(states(events), upsert(table), checkpoint, every)


def track_log(log: DataFrame, table: str, checkpoint: str, every: str | None = "500 milliseconds"):
    """Start the stream of log(seq, op, path, new_path, scroll, ts_ms), with renames and deletes, into snapshots."""
    return _start(log, replay(table), checkpoint, every)


def state_file(rows: list[tuple[str, float, int]]) -> str:
    return json.dumps({p: {"scroll": s, "timestamp": t} for p, s, t in rows}, ensure_ascii=False)
