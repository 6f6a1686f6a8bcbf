"""The alarm store: risk, classes, upserts, and the queries and edits that tools and the UI make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MEDIUM = (3, 6)


def risk(priority: Column, reliability: Column, value: Column) -> Column:
    return F.floor(priority * reliability * value / 25).cast("int")


def risk_class(r: Column, medium: tuple[int, int] = MEDIUM) -> Column:
    return F.when(r < medium[0], "Low").when(r <= medium[1], "Medium").otherwise("High")


def upsert_latest(changes: DataFrame, enriched: tuple[str, ...] = ()) -> DataFrame:
    """The state of each alarm after its changes.

    A change that arrives late never lowers the risk (the riskiest, then the latest one wins); the columns in
    ``enriched`` keep their last value that is not null; the first change dates the alarm.
    """
    order = F.struct("risk", "update_time", "seq")
    row = [c for c in changes.columns if c not in ("alarm_id", "created_time", *enriched)]
    aggs = [F.max(F.struct(order.alias("o"), F.struct(*row).alias("r")))["r"].alias("r"), F.min("created_time").alias("created_time")]
    aggs += [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("update_time", "seq"))).alias(c) for c in enriched]
    return changes.groupBy("alarm_id").agg(*aggs).select("alarm_id", "r.*", "created_time", *enriched)


def current(changes: DataFrame) -> DataFrame:
    """The last change of each alarm, with its class, and default status and tag for the store."""
    last = changes.groupBy("alarm_id").agg(F.max(F.struct("update_time", "seq", F.struct(*[c for c in changes.columns if c not in ("alarm_id", "update_time", "seq")]).alias("r"))).alias("m"))
    return last.select("alarm_id", "m.update_time", "m.r.*").withColumns({"risk_class": risk_class(F.col("risk")), "alarm_status": F.lit("Open"), "tag": F.lit("Identified Threat")})


def backlog_counts(found: DataFrame) -> DataFrame:
    """(directive_id, live, total) of backlogs, from what correlation emits: live ones have neither finished nor timed out."""
    ended = F.max(F.when((F.col("kind") == "alarm") & F.col("status").isin("finished", "timeout"), 1).otherwise(0))
    by = found.groupBy("directive_id", "alarm_id").agg(ended.alias("ended"))
    return by.groupBy("directive_id").agg(F.sum(1 - F.col("ended")).cast("bigint").alias("live"), F.count("*").alias("total"))


def with_times(alarms: DataFrame) -> DataFrame:
    """Alarms with `timestamp` and `updated_time` in place of the epoch columns, as the store keeps them."""
    return alarms.withColumns({"timestamp": F.timestamp_seconds("created_time"), "updated_time": F.timestamp_seconds("update_time")}).drop("created_time", "update_time")


def networks(changes: DataFrame, by_ip: DataFrame) -> DataFrame:
    """(alarm_id, networks): of all addresses that the alarm ever had.  by_ip: (ip, networks) from ``assets.lookup``."""
    ips = changes.select("alarm_id", F.explode(F.array_union("src_ips", "dst_ips")).alias("ip")).distinct()
    return ips.join(by_ip.select("ip", "networks"), "ip").select("alarm_id", F.explode("networks").alias("n")).groupBy("alarm_id").agg(F.array_sort(F.collect_set("n")).alias("networks"))


def stage_counts(links: DataFrame) -> DataFrame:
    return links.groupBy("alarm_id", "stage").agg(F.count("*").alias("n_events"))


def drill_down(links: DataFrame, events: DataFrame, alarm_id: str | Column, stage: int, most: int = 200) -> DataFrame:
    """The newest events of an alarm's stage; a report of ``most`` rows."""
    ids = links.where((F.col("alarm_id") == alarm_id) & (F.col("stage") == stage)).select("event_id").distinct()
    return events.join(ids, "event_id", "left_semi").orderBy(F.desc("ts_unix"), F.desc("event_id")).limit(most)


def page(alarms: DataFrame, first: int, size: int) -> DataFrame:
    return alarms.orderBy(F.desc("update_time"), "alarm_id").offset(first).limit(size)


def by_ids(alarms: DataFrame, ids: list[str], most: int = 200) -> DataFrame:
    return alarms.where(F.col("alarm_id").isin(ids)).orderBy("alarm_id").limit(most)


def delete_cascade(alarms: DataFrame, links: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the alarms of ``gone`` (alarm_id)."""
    return alarms.join(gone, "alarm_id", "left_anti"), links.join(gone, "alarm_id", "left_anti")


def set_field(alarms: DataFrame, where: Column, field: str, value: str) -> DataFrame:
    return alarms.withColumn(field, F.when(where, F.lit(value)).otherwise(F.col(field)))


def day(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")


def sticky_day(changes: DataFrame) -> DataFrame:
    """Every change with the day of its alarm's first one: where the alarm is stored for good."""
    return changes.withColumn("day", day(F.min("created_time").over(Window.partitionBy("alarm_id"))))


def move_day(table: DataFrame, seconds: str, date: str) -> tuple[DataFrame, DataFrame]:
    """(rows of the day [date, date + 1), all others), for moving a daily partition."""
    at = F.timestamp_seconds(F.col(seconds))
    here = (at >= F.lit(date).cast("timestamp")) & (at < F.date_add(F.lit(date).cast("date"), 1).cast("timestamp"))
    return table.where(here), table.where(~F.coalesce(here, F.lit(False)))


def ecs(alarms: DataFrame) -> DataFrame:
    """Alarms under the field names that dashboards of the Elastic Common Schema use."""
    return alarms.select(
        F.col("alarm_id").alias("event_id"), F.col("title").alias("rule_name"), F.col("kingdom").alias("event_kind"), F.col("category").alias("event_category"), F.col("risk").cast("float").alias("event_risk_score"),
        F.timestamp_seconds("created_time").alias("event_start"), F.timestamp_seconds("update_time").alias("event_end"), F.col("src_ips").alias("source_ip"), F.col("dst_ips").alias("destination_ip"),
    )
