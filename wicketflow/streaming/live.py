"""Structured Streaming jobs: ingest, deduplication, late rows, live scores, latest snapshots, names resolved on the way."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from wicketflow.functions import rules as r
from wicketflow.sources.shared import numbered, remove

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Batches between two compactions of what changes() writes.
COMPACT_EVERY = 10


def source(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """New parquet files under path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """What has come so far, appended exactly once; the checkpoint is the manifest of what is done."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(stream: DataFrame, time: str, key: list[str], late: str = "1 day") -> DataFrame:
    """Events whose key hasn't been seen within the watermark."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def split_late(stream: DataFrame, time: str, delay: str, path: str, checkpoint: str) -> StreamingQuery:
    """Parts the rows that come too late from the others: path/epoch=<batch>/late=<true or false>, each batch in one pass.

    Late is what lies before the watermark: the latest time of all batches before, less delay (an interval such as ``1 day``);
    rows without a time are late. The latest time so far is kept beside the rows, under path/marks, a row a batch: a batch that
    runs again finds the same marks and parts its rows as before. Read the others by on_time(), as a stream or a table.
    """
    marks = f"{path}/marks"

    def write(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        done = [n for n in numbered(session, marks, "epoch") if n < epoch]
        seen = session.read.parquet(f"{marks}/epoch={done[-1]}").first()["seen"] if done else None
        at = F.col(time).cast("timestamp")
        late = at.isNull() if seen is None else F.coalesce(at < F.timestamp_micros(F.lit(seen)) - F.expr(f"INTERVAL {delay}"), F.lit(True))
        latest = Observation()
        batch.withColumn("late", late).observe(latest, F.max(F.unix_micros(at)).alias("seen")).write.mode("overwrite").partitionBy("late").parquet(f"{path}/rows/epoch={epoch}")
        now = latest.get["seen"]
        now = seen if now is None else now if seen is None else max(now, seen)
        session.range(1).select(F.lit(now).cast("long").alias("seen")).coalesce(1).write.mode("overwrite").parquet(f"{marks}/epoch={epoch}")
        for old in done[:-2]:
            remove(session, f"{marks}/epoch={old}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def on_time(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """The rows of split_late() that weren't late, as a stream."""
    return source(spark, f"{path}/rows/epoch=*/late=false", schema, files_per_batch)


def parted(spark: SparkSession, path: str, schema) -> DataFrame:
    """All rows of split_late(), with epoch and late."""
    full = T.StructType([*schema.fields, T.StructField("epoch", T.LongType()), T.StructField("late", T.BooleanType())])
    return spark.read.schema(full).parquet(f"{path}/rows")


def scoreboard(stream: DataFrame) -> DataFrame:
    """Running totals of each innings, for update mode: what changes in a batch comes out."""
    return stream.groupBy("match_id", "innings_number").agg(r.total("runs_total").alias("runs"), r.count_if(F.col("is_wicket")).alias("wickets"), r.count_if(r.legal_ball()).alias("balls"))


def windowed_activity(stream: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events and their values in tumbling windows; rows later than the watermark are left out."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def latest(stream: DataFrame, key: str, time: str) -> DataFrame:
    """The latest row of each key; ties go to the largest of the other columns. State grows with the keys: see live_rows()."""
    rest = [c for c in stream.columns if c not in (key, time)]
    return stream.groupBy(key).agg(F.max(F.struct(time, *rest)).alias("r")).select(key, "r.*")


def _seconds(interval: str) -> int:
    number, _, unit = interval.partition(" ")
    return int(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}[unit.rstrip("s")]


def live_rows(stream: DataFrame, key: list[str], time: str, idle: str, late: str = "0 seconds", *, sums: dict[str, str] | None = None) -> DataFrame:
    """What changes in each batch, for update mode: key, time, the other columns, gone.

    Without sums, the latest row of each key (ties go to the largest of the other columns, nulls last); with sums (column ->
    expression over the rows) their running totals and the latest time. A key is let go when the watermark (the latest time,
    less late) has passed its own time by idle: a timer then clears its state and a row with gone = true comes out, the other
    columns null (with sums: as they stand). A key that comes again afterwards begins anew. So the state holds live keys only,
    however long the stream runs. Rows at or before the watermark, and those without a time, are dropped: split_late() keeps them,
    if it comes first.
    """
    wait = _seconds(idle) * 1000
    named = {c: F.expr(e).cast("long") for c, e in (sums or {}).items()} or {c: F.col(c) for c in stream.columns if c not in (*key, time)}
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).select(*key, F.unix_micros(time).alias("_at"), *[c.alias(n) for n, c in named.items()], F.col(time).alias("_time")).where("_time is not null")
    moments = [n for n in named if isinstance(rows.schema[n].dataType, T.TimestampType)]  # held as numbers: Python's times come back with a zone, and can't be compared
    rows = rows.withColumns({n: F.unix_micros(n) for n in moments}).withWatermark("_time", late)
    names, adds = ["_at", *named], bool(sums)
    held = T.StructType([T.StructField(n, rows.schema[n].dataType) for n in names])
    out = T.StructType([*[rows.schema[k] for k in key], *held.fields, T.StructField("gone", T.BooleanType())])
    empty, made = (None,) * len(names), Row(*out.names)

    def order(values: tuple) -> tuple:
        return tuple((True, v) if v is not None else (False,) for v in values)

    class Live(StatefulProcessor):  # within the function, so that it travels to the executors by value
        def init(self, handle) -> None:
            self.handle, self.value = handle, handle.getValueState("value", held)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            best = tuple(self.value.get()) if self.value.exists() else None
            if best is not None and best[0] // 1000 + wait <= timerValues.getCurrentWatermarkInMs():
                best = None  # its time is over: the timer would have fired after these rows
            for row in rows:
                own = tuple(row[n] for n in names)
                if best is None:
                    best = own
                elif adds:
                    best = (max(best[0], own[0]), *[(a or 0) + (b or 0) for a, b in zip(best[1:], own[1:])])
                elif order(own) > order(best):
                    best = own
            self.value.update(best)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(best[0] // 1000 + wait)
            yield made(*key, *best, False)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            last = tuple(self.value.get()) if adds else empty
            self.value.clear()
            yield made(*key, *last, True)

        def close(self) -> None:
            pass

    states = rows.groupBy(*key).transformWithState(Live(), out, outputMode="Update", timeMode="EventTime")
    return states.select(*key, F.timestamp_micros("_at").alias(time), *[F.timestamp_micros(n).alias(n) if n in moments else F.col(n) for n in named], "gone")


def _started(spark: SparkSession, writer: DataStreamWriter) -> StreamingQuery:
    """writer started with a state store that transformWithState can use; the session's own setting stays."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, ROCKS)
    try:
        return writer.start()
    finally:
        spark.conf.set(setting, before)


def changes(rows: DataFrame, path: str, checkpoint: str, key: list[str] | None = None, every: int = COMPACT_EVERY) -> StreamingQuery:
    """Writes what an aggregation changes in each batch under path/epoch=<batch>; a batch that runs again writes the same.

    Only changed keys are written; Spark's state store holds the rest. current() reads the newest row of each key.

    key: every so many batches, the newest row of each key is written under path/base=<batch>, without the keys that are gone,
    and what the base before it covers is removed. So files are bounded by the live keys and a few batches' changes.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        if key and epoch % every == every - 1:
            compact(batch.sparkSession, path, key, epoch)

    writer = rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return _started(rows.sparkSession, writer)


def compact(spark: SparkSession, path: str, key: list[str], epoch: int) -> None:
    """Writes base=<epoch> and removes what the base before it covers; readers of that one have until the next compaction."""
    bases = numbered(spark, path, "base")
    if epoch not in bases:
        current(spark, path, key, epoch).write.mode("overwrite").parquet(f"{path}/base={epoch}")
    before = max((b for b in bases if b < epoch), default=None)
    if before is not None:
        for name, limit in (("base", before), ("epoch", before + 1)):
            for n in numbered(spark, path, name):
                if n < limit:
                    remove(spark, f"{path}/{name}={n}")


def current(spark: SparkSession, path: str, key: list[str], epoch: int | None = None) -> DataFrame:
    """The newest row of each key of what changes() has written (until epoch), without keys that are gone."""
    bases = [b for b in numbered(spark, path, "base") if epoch is None or b < epoch]
    base = bases[-1] if bases else -1
    epochs = [e for e in numbered(spark, path, "epoch") if e > base and (epoch is None or e <= epoch)]
    parts = [spark.read.parquet(f"{path}/epoch={e}").withColumn("_epoch", F.lit(e)) for e in epochs]
    if base >= 0:
        kept = spark.read.parquet(f"{path}/base={base}").withColumn("_epoch", F.lit(base))
        parts.append(kept.withColumn("gone", F.lit(False)) if parts and "gone" in parts[0].columns else kept)
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rest = [c for c in rows.columns if c not in (*key, "_epoch", "gone")]
    # within a batch a key can go and come again: the row that isn't gone is the newer
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    newest = rows.groupBy(*key).agg(F.max_by(F.struct(gone.alias("gone"), *rest), F.struct("_epoch", (~gone).alias("live"))).alias("r"))
    return newest.where("NOT r.gone").select(*key, *[f"r.`{c}`" for c in rest])


def enriched(stream: DataFrame, enrich: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Each batch as enrich() makes it, under path/epoch=<batch>.

    enrich runs once a batch and reads its dimensions then, so that ids follow a dimension that changes while the stream runs;
    dimension() gives it the newest version.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        enrich(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publish(df: DataFrame, path: str) -> None:
    """df as the next version of a dimension; versions that are being read stay as they are."""
    done = numbered(df.sparkSession, path, "version")
    df.write.mode("overwrite").parquet(f"{path}/version={done[-1] + 1 if done else 0}")


def dimension(spark: SparkSession, path: str) -> DataFrame:
    """The newest version that publish() has finished."""
    return spark.read.parquet(f"{path}/version={numbered(spark, path, 'version')[-1]}")
