"""Readers and writers of the engine's files: events, directives, assets, sources, scans, SID references, outputs."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.operators.assets import validate_assets
from wardline.plans.directives import Checked, Directive, keep_valid
from wardline.schemas import ASSET, EVENT, NESSUS, without_nulls

SID_COLUMNS = "plugin string, id int, sid int, title string, category string, kingdom string, custom_label1 string, custom_data1 string, custom_label2 string, custom_data2 string, custom_label3 string, custom_data3 string"
#: Names of uploadable configuration files and the list that each must hold; fixed values.
UPLOADS = {"directives": "directives", "assets": "assets", "intel": "intel_sources", "vuln": "vuln_sources"}


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; unknown fields are dropped, missing ones are '' and 0."""
    return without_nulls(spark.read.schema(EVENT).json(path))


def parse_events(values: DataFrame, column: str = "value") -> DataFrame:
    """Events of a column of JSON texts (a message queue's); what can't be parsed comes out empty, and so invalid."""
    rows = values.select(F.from_json(F.col(column).cast("string"), EVENT).alias("e")).select("e.*")
    return without_nulls(rows).withColumn("rcvd_time", F.unix_micros(F.current_timestamp()) * 1000)


def stream_events(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The same from a folder that files keep arriving in."""
    reader = spark.readStream.schema(EVENT)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return without_nulls(reader.json(path))


def stream_kafka(spark: SparkSession, servers: str, topic: str, max_offsets: int | None = None) -> DataFrame:
    """Events from a topic; needs the Kafka connector on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return parse_events(reader.load())


def write_kafka(events: DataFrame, servers: str, topic: str, checkpoint: str):
    rows = events.select(F.to_json(F.struct("*")).alias("value"))
    return rows.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint)


def _documents(spark: SparkSession, glob: str) -> Iterator[dict]:
    """Whole JSON files that a glob names, in order: configuration, which the driver reads."""
    for r in spark.read.text(glob, wholetext=True).withColumn("_f", F.input_file_name()).orderBy("_f").toLocalIterator():
        yield json.loads(r["value"])


def load_directives(spark: SparkSession, folder: str, include_disabled: bool = False, node: str = "") -> tuple[list[Directive], list[Checked]]:
    """Valid directives of `directives_*.json` (of one node's: `directives_<node>_*`), and all findings."""
    found = [Directive.of(d) for doc in _documents(spark, f"{folder}/directives_{node + '_' if node else ''}*.json") for d in doc.get("directives", [])]
    kept, checks = keep_valid(found, include_disabled)
    if not kept:
        raise ValueError(f"no valid directive in {folder}")
    return kept, checks


def list_configs(spark: SparkSession, folder: str, node: str = "") -> list[tuple[str, int]]:
    """(name, bytes) of the configuration files of a folder: all, or those that a node runs with (its directives, and what all share)."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*_*.json").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length").collect()
    names = sorted((r["name"], r["length"]) for r in found if r["name"].partition("_")[0] in UPLOADS)
    return [x for x in names if not node or not x[0].startswith("directives_") or x[0].startswith(f"directives_{node}_")]


def validate_directory(spark: SparkSession, folder: str) -> tuple[int, int]:
    """(valid, all) directives of a folder."""
    found = [Directive.of(d) for doc in _documents(spark, f"{folder}/directives_*.json") for d in doc.get("directives", [])]
    kept, _ = keep_valid(found, include_disabled=True)
    return len(kept), len(found)


def load_assets(spark: SparkSession, folder: str) -> list[dict]:
    rows = [r.asDict() for r in spark.read.schema(f"assets array<{ASSET.simpleString()}>").option("multiLine", True).json(f"{folder}/assets_*.json").select(F.explode("assets").alias("a")).select("a.*").collect()]
    if errors := validate_assets(rows):
        raise ValueError("; ".join(errors))
    if not rows:
        raise ValueError(f"no asset in {folder}")
    return rows


def load_sources(spark: SparkSession, folder: str, kind: str) -> list[dict]:
    """Enabled intel or vuln sources."""
    return [s for doc in _documents(spark, f"{folder}/{kind}_*.json") for s in doc.get(f"{kind}_sources", []) if s.get("enabled")]


def read_nessus(spark: SparkSession, path: str) -> DataFrame:
    """Scanner exports: quoted, several lines to a field; a file of other types fails."""
    return spark.read.schema(NESSUS).csv(path, header=True, multiLine=True, quote='"', escape='"', mode="FAILFAST", enforceSchema=True)


def read_sids(spark: SparkSession, path: str, **defaults) -> DataFrame:
    """A SID reference: tab-separated, by position, with defaults for empty fields."""
    rows = spark.read.schema(SID_COLUMNS).csv(path, sep="\t", header=True, quote="")
    return rows.select(*(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in rows.columns))


def write_sids(refs: DataFrame, path: str) -> None:
    """Sorted by SID, one file of six columns."""
    refs.select("plugin", "id", "sid", "title", "category", "kingdom").orderBy("sid").coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True, quote="")


def read_name_table(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """One of the six reference tables of directive conversion."""
    return spark.read.schema(columns).csv(path, sep="\t", header=True, quote="")


def parse_tsv(text: str, defaults: dict[str, str] | None = None) -> list[dict]:
    """Rows of a small tab-separated text with a header."""
    return [{k: v or (defaults or {}).get(k, "") for k, v in r.items()} for r in csv.DictReader(io.StringIO(text), delimiter="\t", quoting=csv.QUOTE_NONE)]


def write_by_day(table: DataFrame, path: str, seconds: str) -> None:
    """Parquet by day of an epoch column; only the days written are replaced."""
    day = F.date_format(F.timestamp_seconds(F.col(seconds)), "yyyy-MM-dd")
    table.withColumn("day", day).hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def tagged(spark: SparkSession, path: str, schema: str, application: str, kind: str) -> DataFrame:
    """JSON-line outputs with the tags that tell them apart downstream."""
    return spark.read.schema(schema).json(path).withColumns({"application": F.lit(application), "siem_data_type": F.lit(kind)})


def compact(spark: SparkSession, path: str, to: str, files: int) -> int:
    """A copy of a table in fewer files; returns its rows, checked against the source's before it can take its place."""
    table = spark.read.parquet(path)
    table.coalesce(files).write.mode("overwrite").parquet(to)
    n = spark.read.parquet(to).count()
    if n != table.count():
        raise ValueError(f"{to} has {n} rows")
    return n


def validate_upload(name: str, body: bytes) -> str | None:
    """What is wrong with an uploaded configuration file, or None."""
    m = re.fullmatch(r"(directives|assets|intel|vuln)_[A-Za-z0-9_-]+\.json", name)
    if not m:
        return "bad file name"
    try:
        found = json.loads(body)
    except ValueError:
        return "not JSON"
    entries = found.get(UPLOADS[m[1]]) if isinstance(found, dict) else None
    return None if isinstance(entries, list) and entries else f"no {UPLOADS[m[1]]}"


@dataclass
class EngineConfig:
    """Options of a run; the bounds are checked when it is made."""

    mode: str = "standalone"
    max_eps: int = 1000
    min_eps: int = 100
    max_delay: int = 180
    hold_seconds: int = 10
    min_alarm_lifetime: int = 0
    medium_risk: tuple[int, int] = (3, 6)
    max_queue: int = 25_000

    def __post_init__(self):
        lo, hi = self.medium_risk
        if self.mode not in ("standalone", "frontend", "backend"):
            raise ValueError(f"unknown mode {self.mode!r}")
        if not 0 < self.min_eps <= self.max_eps:
            raise ValueError("min_eps must be above 0 and at most max_eps")
        if not 2 <= lo <= hi <= 9:
            raise ValueError("medium risk must lie within 2 and 9, low bound first")
