"""Schemas of events, alarms and configuration, and the normaliser that takes nulls out of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXTS = "event_id timestamp title sensor product category subcategory src_ip dst_ip protocol custom_data1 custom_label1 custom_data2 custom_label2 custom_data3 custom_label3 trace_parent trace_state".split()
_INTS = "plugin_id plugin_sid src_port dst_port".split()

EVENT = T.StructType(
    [T.StructField(n, T.StringType()) for n in _TEXTS]
    + [T.StructField(n, T.IntegerType()) for n in _INTS]
    + [T.StructField("conn_id", T.LongType()), T.StructField("rcvd_time", T.LongType())]
)

RULE = T.StructType(
    [T.StructField(n, T.StringType()) for n in "name type category from to port_from port_to protocol sticky_different custom_data1 custom_label1 custom_data2 custom_label2 custom_data3 custom_label3".split()]
    + [T.StructField(n, T.IntegerType()) for n in "stage plugin_id occurrence reliability".split()]
    + [T.StructField("timeout", T.LongType()), T.StructField("plugin_sid", T.ArrayType(T.IntegerType())), T.StructField("product", T.ArrayType(T.StringType())), T.StructField("subcategory", T.ArrayType(T.StringType()))]
)

DIRECTIVE = T.StructType(
    [T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("priority", T.IntegerType()), T.StructField("disabled", T.BooleanType()), T.StructField("all_rules_always_active", T.BooleanType()), T.StructField("kingdom", T.StringType()), T.StructField("category", T.StringType()), T.StructField("rules", T.ArrayType(RULE))]
)

ASSET = T.StructType([T.StructField("name", T.StringType()), T.StructField("cidr", T.StringType()), T.StructField("value", T.IntegerType()), T.StructField("whitelisted", T.BooleanType())])

NESSUS = T.StructType(
    [T.StructField("Plugin ID", T.LongType()), T.StructField("CVE", T.StringType()), T.StructField("CVSS", T.FloatType()), T.StructField("Risk", T.StringType()), T.StructField("Host", T.StringType()), T.StructField("Protocol", T.StringType()), T.StructField("Port", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("Name", "Synopsis", "Description", "Solution", "See Also", "Plugin Output")]
)

_PAIRS = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("content", T.StringType())]))
_STAGES = T.ArrayType(T.StructType([T.StructField("stage", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("status", T.StringType()), T.StructField("start_time", T.LongType()), T.StructField("end_time", T.LongType()), T.StructField("events", T.LongType()), T.StructField("from", T.StringType()), T.StructField("to", T.StringType()), T.StructField("port_from", T.StringType()), T.StructField("port_to", T.StringType())]))

#: What correlation emits: rows of kind `event` (a link of an alarm to an event) and of kind `alarm` (an upsert).
OUTPUT = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("directive_id", T.IntegerType()),
        T.StructField("alarm_id", T.StringType()),
        T.StructField("stage", T.IntegerType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("kingdom", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("created_time", T.LongType()),
        T.StructField("update_time", T.LongType()),
        T.StructField("risk", T.IntegerType()),
        T.StructField("src_ips", T.ArrayType(T.StringType())),
        T.StructField("dst_ips", T.ArrayType(T.StringType())),
        T.StructField("custom_data", _PAIRS),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("rules", _STAGES),
    ]
)


def without_nulls(df: DataFrame) -> DataFrame:
    """Event columns with '' and 0 for nulls and for columns that are missing: the data model has none."""
    have = set(df.columns)
    texts = {n: F.coalesce(F.col(n).cast("string"), F.lit("")) if n in have else F.lit("") for n in _TEXTS}
    ints = {n: F.coalesce(F.col(n).cast("int"), F.lit(0)) if n in have else F.lit(0) for n in _INTS}
    longs = {n: F.coalesce(F.col(n).cast("bigint"), F.lit(0).cast("bigint")) if n in have else F.lit(0).cast("bigint") for n in ("conn_id", "rcvd_time")}
    return df.withColumns(texts | ints | longs)
