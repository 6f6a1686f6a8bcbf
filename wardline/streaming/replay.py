"""Replay of a finite table as a stream, to hold streaming against batch."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.operators.correlate import alarm_events, correlate
from wardline.plans.directives import Directive
from wardline.streaming.stream import correlate_stream


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, on one machine only, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="wardline-")
    return f"{base.rstrip('/')}/replay-{uuid.uuid4().hex}"


def stream_links(spark: SparkSession, events: DataFrame, directives: list[Directive], parts: int = 3) -> DataFrame:
    """Alarm events of the events run as micro-batches in order of time."""
    base = shared_dir(spark)
    bounds = events.stat.approxQuantile("ts_unix", [i / parts for i in range(1, parts)], 0.0)
    slot = sum(((F.col("ts_unix") > b).cast("int") for b in bounds), F.lit(0))
    for i in range(parts):  # each run goes on from the checkpoint and takes in the files that are new, as one micro-batch
        events.where(slot == i).write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(events.schema).parquet(f"{base}/in")
        found = correlate_stream(source, directives, unique_ids=True).where("kind = 'event'").select("alarm_id", "directive_id", "stage", "event_id")
        found.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("alarm_id string, directive_id int, stage int, event_id string").parquet(f"{base}/out")


def differences(spark: SparkSession, events: DataFrame, directives: list[Directive]) -> DataFrame:
    """(side, alarm_events): how many links one side has alone."""
    a, b = alarm_events(correlate(events, directives, unique_ids=True)), stream_links(spark, events, directives)
    only = lambda x, y, side: x.exceptAll(y).agg(F.count("*").alias("alarm_events")).select(F.lit(side).alias("side"), "alarm_events")
    return only(a, b, "batch").union(only(b, a, "stream"))
