"""Event streams: ingestion without duplicates, task progress, daily usage and running counts.

Each function maps a streaming DataFrame to a streaming DataFrame; ``read`` and ``drain`` are source and sink. State is bounded
by the watermark (ingestion) or by the number of keys (aggregates).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.session import fresh_path, materialize

#: Rank of the status that an event lifts its task to.
RANKS = {"view": 0, "click": 1, "purchase": 2}
STATUS = ("pending", "in progress", "completed")
#: Parts of a delivered table; a batch reads those that its keys lie in.
SINK_PARTS = 32


def read(spark: SparkSession, path: str) -> DataFrame:
    """A table as a stream of its files. As a pattern the path may also be one file, which a plain path may not."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def ingest(events: DataFrame, delay: str = "1 day", most_chars: int = 2000) -> DataFrame:
    """Each event id once within the delay, detail cut to ``most_chars``; deliver keeps ids apart for good."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"]).withColumn("props", F.substring("props", 1, most_chars))


def key_part(keys: list[str]) -> Column:
    """The part of a sink that a key's rows lie in."""
    return F.pmod(F.xxhash64(*keys), F.lit(SINK_PARTS)).cast("int")


def held_keys(sink: DataFrame, keys: list[str], new: DataFrame) -> DataFrame:
    """Keys that ``sink`` has in the parts that ``new`` touches; other parts of it aren't listed or read."""
    touched = [r.key_part for r in new.select("key_part").distinct().collect()]  # SINK_PARTS at most
    return sink.where(F.col("key_part").isin(touched)).select(*keys)


def deliver(stream: DataFrame, sink: str, keys: list[str], order: str = "ts", offsets: str | None = None) -> None:
    """Append what a stream's source has now to the Parquet table ``sink``, each key once for all runs.

    A batch keeps the first row of a key by ``order`` and leaves out keys that the sink has, so deliveries that come again,
    late ones and repeated batches among them, add nothing. The sink is parted by the hash of the key (column key_part), and a
    batch reads the key columns of the parts that its own keys lie in. With a folder ``offsets`` a run goes on where the last
    one with that folder ended, and reads what is new; without, it reads all that the source has.
    """
    spark = stream.sparkSession
    schema = type(stream.schema)([*stream.schema]).add("key_part", "integer")
    spark.createDataFrame([], schema).write.mode("append").partitionBy("key_part").parquet(sink)
    first = Window.partitionBy(*keys).orderBy(order)

    def add(batch: DataFrame, _: int) -> None:
        new = batch.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n").withColumn("key_part", key_part(keys))
        new = materialize(new, "delivered")
        held = held_keys(batch.sparkSession.read.schema(schema).parquet(sink), keys, new)
        new.join(held, keys, "left_anti").select(*schema.names).repartition("key_part").write.mode("append").partitionBy("key_part").parquet(sink)

    stream.writeStream.option("checkpointLocation", offsets or fresh_path(spark, "delivered-offsets")).trigger(availableNow=True).foreachBatch(add).start().awaitTermination()


def advance_tasks(events: DataFrame) -> DataFrame:
    """The furthest status of each user's task; it never goes back."""
    rank = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in RANKS.items() for x in kv)), F.col("event_type")), F.lit(0))
    furthest = events.where("user_id is not null").groupBy("user_id").agg(F.max(rank).alias("r"))
    return furthest.select("user_id", F.element_at(F.array(*(F.lit(s) for s in STATUS)), F.col("r") + 1).alias("status"))


def usage_daily(events: DataFrame) -> DataFrame:
    """Requests, units and the last status of each day."""
    day = F.window("ts", "1 day").alias("w")
    made = events.groupBy(day).agg(F.count("*").alias("requests"), F.round(F.sum("value"), 2).alias("units"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_status"))
    return made.select(F.col("w.start").alias("day"), "requests", "units", "last_status")


def counts_live(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.count("*").alias("n_events"))


def drain(stream: DataFrame, label: str, mode: str) -> DataFrame:
    """Run a stream over what its source has now and read the result: a Parquet sink (append) or the newest whole result (complete)."""
    spark = stream.sparkSession
    path, marks = fresh_path(spark, label), fresh_path(spark, label + "-offsets")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", marks).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").start(path)
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
