"""Threat intelligence and vulnerability enrichment: providers are tables, lookups are joins."""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.net import is_private

RISKS = ("Medium", "High", "Critical")


class IntelProvider(ABC):
    """Threat intelligence about addresses."""

    def __init__(self, config: str = "{}"):
        self.config = json.loads(config or "{}")

    @abstractmethod
    def table(self, spark: SparkSession) -> DataFrame:
        """(provider, term, result), term being an address."""


class VulnProvider(ABC):
    """Vulnerabilities of services."""

    def __init__(self, config: str = "{}"):
        self.config = json.loads(config or "{}")

    @abstractmethod
    def table(self, spark: SparkSession) -> DataFrame:
        """(provider, host, port, result)."""


_registry: dict[str, dict[str, type]] = {"intel": {}, "vuln": {}}


def register(kind: str, name: str) -> Callable[[type], type]:
    def add(cls: type) -> type:
        if name in _registry[kind]:
            raise ValueError(f"{kind} provider {name} is registered already")
        _registry[kind][name] = cls
        return cls

    return add


def unregister(kind: str, name: str) -> bool:
    return _registry[kind].pop(name, None) is not None


def provider(kind: str, name: str) -> type | None:
    return _registry[kind].get(name)


def providers(kind: str) -> list[str]:
    return sorted(_registry[kind])


def enabled(kind: str, sources: list[dict]) -> list:
    """Providers for the enabled sources of a configuration whose plugin is known."""
    return [_registry[kind][s["plugin"]](s.get("config") or "{}") for s in sources if s.get("enabled") and s.get("plugin") in _registry[kind]]


def parse_field_lists(raw: DataFrame, provider_name: str) -> DataFrame:
    """(provider, term, result) of (term, body), body being a list of {field, len, value} written as a script literal.

    Keys may stand without quotes and strings in single ones; entries of a length under five are noise.
    """
    text = F.regexp_replace(F.regexp_replace("body", r"([{,]\s*)([A-Za-z_][\w.]*)\s*:", r'$1"$2":'), "'", '"')
    rows = raw.select("term", F.explode(F.from_json(text, "array<struct<field:string,len:int,value:string>>")).alias("e"))
    return rows.where("e.len >= 5").select(F.lit(provider_name).alias("provider"), "term", F.concat("e.field", F.lit(": "), "e.value").alias("result"))


@register("intel", "Wise")
class WiseProvider(IntelProvider):
    """Answers of a field-list service, stored as JSON lines (term, body) under config["path"]."""

    def table(self, spark: SparkSession) -> DataFrame:
        return parse_field_lists(spark.read.schema("term string, body string").json(self.config["path"]), "Wise")


def scan_results(scans: DataFrame) -> DataFrame:
    """(provider, host, port, result) of scanner rows that are worth an alarm."""
    result = F.concat(F.col("Risk"), F.lit(" - "), F.col("Name"), F.when(F.coalesce(F.col("CVE"), F.lit("")) != "", F.concat(F.lit(" ("), F.col("CVE"), F.lit(")"))).otherwise(""))
    return scans.where(F.col("Risk").isin(*RISKS)).select(F.lit("Nessus").alias("provider"), F.col("Host").alias("host"), F.col("Port").alias("port"), result.alias("result"))


@register("vuln", "Nessus")
class NessusProvider(VulnProvider):
    """Scanner exports under config["path"]."""

    def table(self, spark: SparkSession) -> DataFrame:
        from wardline.sources.files import read_nessus

        return scan_results(read_nessus(spark, self.config["path"]))


#: Seconds that one call of a checker may take.
DEADLINE = 5.0


def vulnerabilities_of(scans: DataFrame, host: str, port: int) -> DataFrame:
    """(cve, risk, name) of one service: what the scanner's lookup answers."""
    return scans.where((F.col("Host") == host) & (F.col("Port") == port)).select(F.col("CVE").alias("cve"), F.col("Risk").alias("risk"), F.col("Name").alias("name"))


def intel_terms(alarms: DataFrame, private: bool = False) -> DataFrame:
    """(alarm_id, term): the alarm's addresses, without private ones and what is no address."""
    ips = alarms.select("alarm_id", F.explode(F.array_union("src_ips", "dst_ips")).alias("term")).distinct()
    kind = is_private("term")
    return ips.where(kind.isNotNull()) if private else ips.where(F.coalesce(~kind, F.lit(False)))


def intel_hits(alarms: DataFrame, intel: DataFrame, private: bool = False) -> DataFrame:
    """(alarm_id, provider, term, result), each once.  Terms are distinct before the lookup, as a cache would make them."""
    return intel_terms(alarms, private).join(intel, "term").select("alarm_id", "provider", "term", "result").distinct()


def vuln_terms(alarms: DataFrame) -> DataFrame:
    """(alarm_id, ip, port) that the alarm's rules name: addresses by ports, and by the last event's port.

    Lists, networks and open addresses name nothing; ports must be numbers.
    """
    parts = lambda c: F.array_distinct(F.transform(F.split(c, ","), lambda x: F.trim(x)))
    sides = []
    for ip, port, last in (("from", "port_from", "src_port"), ("to", "port_to", "dst_port")):
        r = alarms.select("alarm_id", F.col(last).cast("string").alias("last"), F.explode("rules").alias("r"))
        r = r.select("alarm_id", "last", F.explode(parts(F.col("r")[ip])).alias("ip"), parts(F.col("r")[port]).alias("ports"))
        r = r.where(~F.col("ip").isin("ANY", "HOME_NET", "!HOME_NET", "") & ~F.contains("ip", F.lit("/")))
        ports = F.array_union(F.filter("ports", lambda p: p != "ANY"), F.when(F.col("last") != "0", F.array("last")).otherwise(F.array().cast("array<string>")))
        sides.append(r.select("alarm_id", "ip", F.explode(ports).alias("port")))
    both = sides[0].unionByName(sides[1])
    return both.where(F.col("port").rlike("^[0-9]+$")).select("alarm_id", "ip", F.col("port").try_cast("int").alias("port")).distinct()


def vuln_hits(terms: DataFrame, vulns: DataFrame) -> DataFrame:
    """(alarm_id, provider, term, result)."""
    hit = terms.join(vulns, (terms["ip"] == vulns["host"]) & (terms["port"] == vulns["port"]))
    return hit.select("alarm_id", "provider", F.concat(terms["ip"], F.lit(":"), terms["port"].cast("string")).alias("term"), "result").distinct()


def attach(alarms: DataFrame, hits: DataFrame, column: str) -> DataFrame:
    """Alarms with their hits as a sorted array of (provider, term, result)."""
    per = hits.groupBy("alarm_id").agg(F.array_sort(F.collect_set(F.struct("provider", "term", "result"))).alias(column))
    return alarms.join(per, "alarm_id", "left")


def check_each(terms: DataFrame, check: Callable[[str], list[tuple[str, str]]], column: str = "term", seconds: float = DEADLINE) -> DataFrame:
    """(term, provider, result, error) from a checker that must be called for each distinct term.

    A call that fails, or takes more than so many seconds, gives a row with the error and no result, so that a
    service that is down does not look like one that found nothing; ``error is null`` are the hits.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool = ThreadPoolExecutor(1)
        for b in batches:
            rows = []
            for t in b[column]:
                call = pool.submit(check, t)
                try:
                    rows += [(t, p, r, None) for p, r in call.result(seconds)]
                except Exception as e:  # noqa: BLE001  told to the caller
                    rows.append((t, None, None, f"{type(e).__name__}: {e}".strip(": ")))
                    if not call.done():  # the thread hangs; a new one takes the next term
                        pool.shutdown(wait=False)
                        pool = ThreadPoolExecutor(1)
            yield pd.DataFrame(rows, columns=["term", "provider", "result", "error"])
        pool.shutdown(wait=False)

    return terms.select(column).distinct().mapInPandas(run, "term string, provider string, result string, error string")
