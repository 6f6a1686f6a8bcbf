"""Normalisation of raw logs: a plugin mapping becomes one projection over the raw columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.text import epoch_seconds
from wardline.schemas import EVENT

SOURCE, COLLECT = "es:", "collect:"


def valid_event() -> Column:
    """Complete enough to correlate: identified, dated, placed, and typed by plugin or by taxonomy."""
    here = [F.col(c) != "" for c in ("timestamp", "sensor", "event_id", "src_ip", "dst_ip")]
    typed = ((F.col("plugin_id") != 0) & (F.col("plugin_sid") != 0)) | ((F.col("product") != "") & (F.col("category") != ""))
    return here[0] & here[1] & here[2] & here[3] & here[4] & typed


def stamped(events: DataFrame) -> DataFrame:
    """With ts and ts_unix; rows whose time can't be read keep NULL there."""
    return events.withColumn("ts", F.try_to_timestamp("timestamp")).withColumn("ts_unix", epoch_seconds(F.col("timestamp")))


@dataclass
class PluginMapping:
    """How a plugin's raw rows become events.  Field values: `es:a.b` a raw field, `collect:a.b` one that is harvested, else a literal."""

    name: str
    kind: str = "SID"
    plugin_id: int = 0
    identify: dict[str, str] = field(default_factory=dict)
    where: str = ""
    fields: dict[str, str] = field(default_factory=dict)
    time_format: str = "ISO8601"
    sids: dict[str, int] = field(default_factory=dict)
    custom: list[dict] = field(default_factory=list)

    @staticmethod
    def template(kind: str) -> PluginMapping:
        if kind not in ("SID", "Taxonomy"):
            raise ValueError("kind is SID or Taxonomy")
        names = ["timestamp", "title", "sensor", "src_ip", "dst_ip", "src_port", "dst_port", "protocol"] + (["plugin_sid"] if kind == "SID" else ["product", "category", "subcategory"])
        return PluginMapping("change_me", kind, fields=dict.fromkeys(names, "es:INSERT_FIELD_HERE"))

    def missing(self, raw: DataFrame) -> list[str]:
        """Raw fields that the mapping names and the data lack, in order."""
        out = []
        for v in self.fields.values():
            path = v.removeprefix(SOURCE).removeprefix(COLLECT)
            if path != v and not _has(raw.schema, path.split(".")):
                out.append(path)
        return out


def _has(kind, path: list[str]) -> bool:
    if not path:
        return True
    names = getattr(kind, "names", None)
    return bool(names) and path[0] in names and _has(kind[path[0]].dataType, path[1:])


def _value(v: str) -> Column:
    path = v.removeprefix(SOURCE).removeprefix(COLLECT)
    return F.col(path) if path != v else F.lit(v)


def identified(raw: DataFrame, m: PluginMapping) -> DataFrame:
    """The plugin's own rows; the raw table itself stays for its own sink."""
    for path, value in m.identify.items():
        raw = raw.where(F.col(path) == value)
    return raw.where(m.where) if m.where else raw


def normalize(raw: DataFrame, m: PluginMapping, seed: str = "wardline", position: tuple[str, ...] = ()) -> DataFrame:
    """Events of the plugin's rows: only the columns of an event, typed, titles translated to SIDs where they are listed.

    Event ids are digests, so that a run can be repeated, of the row, and of where it comes from: columns of the source that
    tell equal rows apart, such as file and line or partition and offset.  Without any, equal rows share an id.
    A missing address is 0.0.0.0.
    """
    if lacking := m.missing(raw):
        raise ValueError(f"the data have no field {lacking[0]!r}")
    out = identified(raw, m)
    cols: dict[str, Column] = {k: _value(v) for k, v in m.fields.items()}
    if m.time_format != "ISO8601" and "timestamp" in cols:
        cols["timestamp"] = F.date_format(F.try_to_timestamp(cols["timestamp"].cast("string"), F.lit(m.time_format)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    cols["plugin_id"] = F.lit(m.plugin_id)
    if m.sids:
        table = F.create_map(*(F.lit(x) for pair in sorted(m.sids.items()) for x in pair))
        cols["plugin_sid"] = F.try_element_at(table, cols["title"].cast("string"))
    own: dict[str, Column] = {}
    for f in EVENT.fields:
        kind = f.dataType.simpleString()
        default = F.lit("" if kind == "string" else 0)
        c = cols.get(f.name)
        own[f.name] = F.coalesce(c.try_cast(kind), default.cast(kind)) if c is not None else default.cast(kind)
    for k in (1, 2, 3):  # a label without its data says nothing
        if f"custom_data{k}" in cols:
            own[f"custom_label{k}"] = F.when(own[f"custom_data{k}"] == "", "").otherwise(own[f"custom_label{k}"])
    for ip in ("src_ip", "dst_ip"):
        own[ip] = F.when(own[ip] == "", "0.0.0.0").otherwise(own[ip])
    picked = out.select(*(c.alias(n) for n, c in own.items()), *(F.col(c).cast("string").alias(f"_at{k}") for k, c in enumerate(position)))
    if m.sids:
        picked = picked.where("plugin_sid <> 0")
    for g in m.custom:
        picked = inject_custom(picked, g["sids"], g["pairs"])
    body = [c for c in picked.columns if c != "event_id"]
    return picked.withColumn("event_id", F.left(F.sha2(F.concat_ws("\u0001", F.lit(seed), *body), 256), F.lit(32))).drop(*(f"_at{k}" for k in range(len(position))))


def inject_custom(events: DataFrame, sids: list[int], pairs: list[tuple[str, str]]) -> DataFrame:
    """Sets custom labels and data (literals or `{column}`) for events of the given SIDs."""
    of = F.col("plugin_sid").isin(sids)
    for k, (label, data) in enumerate(pairs[:3], 1):
        value = F.col(data[1:-1]).cast("string") if data.startswith("{") else F.lit(data)
        events = events.withColumns({f"custom_label{k}": F.when(of, F.lit(label)).otherwise(F.col(f"custom_label{k}")), f"custom_data{k}": F.when(of, value).otherwise(F.col(f"custom_data{k}"))})
    return events


def host_agent(raw: DataFrame, body: str, schema: str) -> DataFrame:
    """Host agent alerts: a JSON body taken apart, groups trimmed and split, quotes taken out of the text."""
    e = F.from_json(F.col(body), schema)
    out = raw.withColumn("_e", e).select(*[c for c in raw.columns if c != body], "_e.*")
    if "groups" in out.columns:
        out = out.withColumn("groups", F.transform(F.split("groups", ","), lambda x: F.trim(x)))
    if "message" in out.columns:
        out = out.withColumn("message", F.regexp_replace("message", '"', ""))
    return out


def resolve_hosts(events: DataFrame, hosts: DataFrame, column: str = "dst_host") -> DataFrame:
    """dst_ip of named hosts from a table (host, ip); others keep theirs."""
    joined = events.join(hosts.select(F.col("host").alias(column), F.col("ip").alias("_ip")), column, "left")
    return joined.withColumn("dst_ip", F.coalesce("_ip", "dst_ip")).drop("_ip")
