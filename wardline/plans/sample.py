"""The driver's tables as inputs of the engine, in Spark and as SQL: events, assets, and the flood directive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.net import net
from wardline.operators.assets import Assets
from wardline.plans.directives import Directive, Rule

ASSETS = [
    {"name": "firewall", "cidr": "192.168.0.1/32", "value": 5, "whitelisted": False},
    {"name": "scanner", "cidr": "192.168.0.2/32", "value": 3, "whitelisted": True},
    {"name": "servers", "cidr": "192.168.0.0/16", "value": 2, "whitelisted": False},
    {"name": "clients", "cidr": "10.0.0.0/8", "value": 2, "whitelisted": False},
    {"name": "absent", "cidr": "10.0.0.7/32", "value": 4, "whitelisted": False},
    {"name": "probes", "cidr": "10.0.0.32/28", "value": 1, "whitelisted": True},
]

SIDS = {"click": 1, "view": 2, "signup": 3, "purchase": 4, "error": 5}

FLOOD = Directive(
    1, "Flood from SRC_IP to DST_IP", 4, "Availability", "Flood",
    [
        Rule(1, plugin_id=1001, plugin_sid=[5], occurrence=1, from_="HOME_NET", reliability=1, timeout=0),
        Rule(2, plugin_id=1001, plugin_sid=[5], occurrence=3, from_=":1", reliability=6, timeout=604800),
        Rule(3, plugin_id=1001, plugin_sid=[5], occurrence=5, from_=":1", reliability=10, timeout=1209600),
    ],
)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised events; seq is their order among equal times."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    kind, user = F.col("event_type"), F.col("user_id")
    ts = F.col("ts").cast("timestamp")
    sid = F.coalesce(*(F.when(kind == t, s) for t, s in SIDS.items()), F.lit(0))
    return e.select(
        F.col("event_id").cast("string").alias("event_id"), F.col("event_id").alias("seq"), ts.alias("ts"), F.unix_timestamp(ts).alias("ts_unix"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.concat(F.lit("sensor-"), (user % 5).cast("string")).alias("sensor"), kind.alias("title"), kind.alias("category"), F.lit("").alias("subcategory"), F.lit(1001).alias("plugin_id"), sid.alias("plugin_sid"),
        F.when(kind.isin("error", "purchase"), "IDS").otherwise("Firewall").alias("product"),
        F.concat(F.when(user % 7 == 0, "8.8.8.").otherwise("10.0.0."), user.cast("string")).alias("src_ip"), F.concat(F.lit("192.168.0."), k.cast("string")).alias("dst_ip"),
        (1024 + F.col("event_id") % 50000).cast("int").alias("src_port"), (80 + k).cast("int").alias("dst_port"), F.lit("TCP").alias("protocol"),
        F.lit("bucket").alias("custom_label1"), F.when(F.col("value") < 50, "low").when(F.col("value") < 200, "mid").otherwise("high").alias("custom_data1"),
        *(F.lit("").alias(c) for c in ("custom_label2", "custom_data2", "custom_label3", "custom_data3")), k.alias("k"), user.alias("user_id"),
    )


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with asset lookups."""
    return Assets(ASSETS).with_lookups(events(spark, sf_dir))


# ---- SQL ---------------------------------------------------------------------------------------------------------


def sql_ip(x: str) -> str:
    p = [f"CAST(split_part({x}, '.', {i}) AS BIGINT)" for i in (1, 2, 3, 4)]
    ok = f"regexp_full_match({x}, '(0|[1-9][0-9]{{0,2}})(\\.(0|[1-9][0-9]{{0,2}})){{3}}')"
    return f"(CASE WHEN {ok} THEN CASE WHEN greatest({', '.join(p)}) <= 255 THEN {p[0]} * 16777216 + {p[1]} * 65536 + {p[2]} * 256 + {p[3]} END END)"


def sql_in(x: str, cidrs: list[str]) -> str:
    return f"coalesce({' OR '.join(f'({sql_ip(x)} BETWEEN {n.lo} AND {n.hi})' for n in map(net, cidrs))}, false)"


def sql_value(x: str) -> str:
    parts = [f"CASE WHEN {sql_in(x, [a['cidr']])} THEN {a['value']} ELSE 0 END" for a in ASSETS]
    return f"greatest({', '.join(parts)})"


def sql_home(x: str) -> str:
    return sql_in(x, [a["cidr"] for a in ASSETS if not a["whitelisted"]])


EVENTS = f"""n0 AS (
  SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events),
n AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, event_id AS seq, ts, CAST(floor(epoch(ts)) AS BIGINT) AS ts_unix, 'sensor-' || (user_id % 5) AS sensor,
    event_type AS title, event_type AS category, '' AS subcategory, 1001 AS plugin_id,
    CASE event_type {' '.join(f"WHEN '{t}' THEN {s}" for t, s in SIDS.items())} ELSE 0 END AS plugin_sid,
    CASE WHEN event_type IN ('error', 'purchase') THEN 'IDS' ELSE 'Firewall' END AS product,
    (CASE WHEN user_id % 7 = 0 THEN '8.8.8.' ELSE '10.0.0.' END) || user_id AS src_ip, '192.168.0.' || k AS dst_ip,
    1024 + event_id % 50000 AS src_port, 80 + k AS dst_port,
    CASE WHEN value < 50 THEN 'low' WHEN value < 200 THEN 'mid' ELSE 'high' END AS custom_data1, k, user_id
  FROM n0)"""

FLOOD_SQL = f"""WITH RECURSIVE {EVENTS},
f AS (
  SELECT seq, event_id, ts_unix, src_ip, dst_ip, row_number() OVER (PARTITION BY src_ip ORDER BY ts_unix, seq) AS rn
  FROM n WHERE plugin_sid = 5 AND {sql_home('src_ip')}),
w AS (
  SELECT src_ip, rn, seq AS bid, 2 AS stage, 0 AS cnt, ts_unix AS start, 1 AS ev_stage, seq, event_id, ts_unix, dst_ip FROM f WHERE rn = 1
  UNION ALL
  SELECT src_ip, rn, CASE WHEN live THEN bid ELSE seq END, CASE WHEN NOT live THEN 2 WHEN cnt + 1 >= occ THEN stage + 1 ELSE stage END,
    CASE WHEN NOT live OR cnt + 1 >= occ THEN 0 ELSE cnt + 1 END, CASE WHEN NOT live OR cnt + 1 >= occ THEN ts_unix ELSE start END,
    CASE WHEN live THEN stage ELSE 1 END, seq, event_id, ts_unix, dst_ip
  FROM (SELECT f.src_ip, f.rn, w.bid, w.stage, w.cnt, w.start, f.seq, f.event_id, f.ts_unix, f.dst_ip, CASE w.stage WHEN 2 THEN 3 ELSE 5 END AS occ,
      w.stage <= 3 AND NOT (w.start + CASE w.stage WHEN 2 THEN 604800 ELSE 1209600 END < f.ts_unix) AS live
    FROM w JOIN f ON f.src_ip = w.src_ip AND f.rn = w.rn + 1)),
ev AS (
  SELECT substr(sha256('1|' || bid || '|' || bid), 1, 16) AS alarm_id, w.*,
    row_number() OVER (PARTITION BY bid, ev_stage ORDER BY seq) AS nth,
    max(greatest({sql_value('src_ip')}, {sql_value('dst_ip')})) OVER (PARTITION BY bid ORDER BY rn) AS value FROM w),
fin AS (
  SELECT alarm_id, bid, ev_stage, ts_unix, seq, CAST(floor(4 * CASE ev_stage WHEN 1 THEN 1 WHEN 2 THEN 6 ELSE 10 END * value / 25) AS INTEGER) AS risk
  FROM ev WHERE nth = CASE ev_stage WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 5 END),
clock AS (SELECT max(ts_unix) AS now FROM n WHERE plugin_sid = 5),
b AS (
  SELECT alarm_id, max(ev_stage) AS done, arg_max(risk, ev_stage) AS risk, max(ts_unix) AS start FROM fin GROUP BY alarm_id),
a AS (
  SELECT b.alarm_id, least(b.done + 1, 3) AS stage, b.risk, b.start,
    CASE WHEN b.done = 3 THEN 'finished' WHEN b.start + CASE b.done WHEN 1 THEN 604800 ELSE 1209600 END < clock.now THEN 'timeout' ELSE 'active' END AS status,
    min(ev.ts_unix) AS created_time, max(ev.ts_unix) AS last_time, count(*) AS n_events
  FROM b JOIN ev USING (alarm_id), clock GROUP BY ALL)"""
