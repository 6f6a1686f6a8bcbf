"""Asset lookups: home network, value, name and networks of addresses, and the source whitelist.

Two plans.  A handful of assets (``INLINE`` at most) become column expressions, which cost no join.  More are joined
by equality on (prefix length, network): each distinct address is masked once for every prefix length in use, so
the work does not grow with the number of assets, and no nested loop is planned.  Both address versions.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.net import ip6_to_hex, ip_to_long, net, over
from wardline.schemas import ASSET

INLINE = 64


def validate_assets(rows: list[dict]) -> list[str]:
    errors = []
    for r in rows:
        try:
            ipaddress.ip_network(r.get("cidr") or "", strict=False)
        except ValueError:
            errors.append(f"{r.get('name')}: bad cidr {r.get('cidr')!r}")
        if not r.get("name"):
            errors.append(f"{r.get('cidr')}: no name")
        if not r.get("value"):
            errors.append(f"{r.get('name')}: value is zero")
    return errors


def asset_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Assets with their version, prefix length and first address: a number for IPv4 and 32 hexadecimal digits for IPv6, as text."""
    table = [(r["name"], r["cidr"], int(r["value"]), bool(r.get("whitelisted")), n.version, n.prefix, str(n.lo) if n.version == 4 else f"{n.lo:032x}") for r in rows if (n := net(r["cidr"]))]
    return spark.createDataFrame(table, ASSET.simpleString()[7:-1].replace(":", " ") + ", version int, prefix int, lo string")


class Assets:
    """Column expressions over few assets."""

    def __init__(self, rows: list[dict]):
        if len(rows) > INLINE:
            raise ValueError(f"{len(rows)} assets: join the table with `lookup` instead")
        self.rows = [(r, n) for r in rows if (n := net(r["cidr"]))]

    def _over(self, ip: str, f) -> Column:
        return over(ip, [n for _, n in self.rows], lambda holds, _: f(holds))

    def _any(self, ip: str, keep) -> Column:
        def found(holds) -> Column:
            out = F.lit(False)
            for r, n in self.rows:
                if keep(r):
                    out = out | F.coalesce(holds(n), F.lit(False))
            return out

        return self._over(ip, found)

    def home(self, ip: str) -> Column:
        return self._any(ip, lambda r: not r.get("whitelisted"))

    def whitelisted(self, ip: str) -> Column:
        return self._any(ip, lambda r: r.get("whitelisted"))

    def value(self, ip: str) -> Column:
        return self._over(ip, lambda holds: F.greatest(F.lit(0), F.lit(0), *(F.when(holds(n), F.lit(int(r["value"]))).otherwise(0) for r, n in self.rows)))

    def name(self, ip: str) -> Column:
        def found(holds) -> Column:
            out = F.lit("")
            for r, n in reversed(self.rows):
                if n.lo == n.hi:
                    out = F.when(holds(n), F.lit(r["name"])).otherwise(out)
            return out

        return self._over(ip, found)

    def networks(self, ip: str) -> Column:
        """Networks that hold the address, without single hosts, sorted."""

        def found(holds) -> Column:
            held = [F.when(holds(n), F.lit(r["cidr"])) for r, n in self.rows if n.lo != n.hi]
            return F.array_sort(F.array_distinct(F.array_compact(F.array(*held)))) if held else F.array().cast("array<string>")

        return self._over(ip, found)

    def with_lookups(self, events: DataFrame) -> DataFrame:
        return events.withColumns({f"{s}_{k}": f(f"{s}_ip") for s in ("src", "dst") for k, f in (("home", self.home), ("value", self.value), ("name", self.name))})


def lookup(ips: DataFrame, assets: DataFrame, ip: str = "ip") -> DataFrame:
    """(ip, home, whitelisted, value, name, networks) of each distinct address, by equality joins."""
    lengths = [(r["version"], r["prefix"]) for r in assets.select("version", "prefix").distinct().collect()]  # 33 and 129 at most
    one = ips.select(F.col(ip).alias("ip")).distinct().withColumns({"v": ip_to_long("ip"), "h": ip6_to_hex("ip") if any(v == 6 for v, _ in lengths) else F.lit(None).cast("string")})

    def first(version: int, p: int) -> Column:
        """The first address of the network of p bits that the address is in, as text."""
        if version == 4:
            return (F.floor(F.col("v") / (1 << (32 - p))) * (1 << (32 - p))).cast("bigint").cast("string")
        whole, rest = divmod(p, 4)
        digit = F.conv(F.substring("h", whole + 1, 1), 16, 10).cast("int")
        part = F.lower(F.hex((F.floor(digit / (1 << (4 - rest))) * (1 << (4 - rest))).cast("bigint"))) if rest else F.lit("")
        return F.rpad(F.concat(F.left("h", F.lit(whole)), part), 32, "0")

    masks = [F.when(F.col("v" if v == 4 else "h").isNotNull(), F.struct(F.lit(v).alias("version"), F.lit(p).alias("prefix"), first(v, p).alias("lo"))) for v, p in lengths]
    hit = one.select("ip", F.explode(F.array_compact(F.array(*masks))).alias("m")).select("ip", "m.*") if lengths else one.selectExpr("ip", "0 as version", "0 as prefix", "'' as lo")
    host = F.col("prefix") == F.when(F.col("version") == 4, 32).otherwise(128)
    found = hit.join(assets, ["version", "prefix", "lo"]).groupBy("ip").agg(
        F.max(~F.coalesce("whitelisted", F.lit(False))).alias("home"),
        F.max(F.coalesce("whitelisted", F.lit(False))).alias("whitelisted"),
        F.max("value").alias("value"),
        F.max(F.when(host, F.col("name"))).alias("name"),
        F.array_sort(F.collect_set(F.when(~host, F.col("cidr")))).alias("networks"),
    )
    return one.join(found, "ip", "left").select("ip", F.coalesce("home", F.lit(False)).alias("home"), F.coalesce("whitelisted", F.lit(False)).alias("whitelisted"), F.coalesce("value", F.lit(0)).alias("value"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce("networks", F.array().cast("array<string>")).alias("networks"))


def with_lookups(events: DataFrame, assets: DataFrame) -> DataFrame:
    """Events with src_/dst_ home, value and name from a table of any size."""
    ips = events.select(F.col("src_ip").alias("ip")).union(events.select(F.col("dst_ip").alias("ip")))
    found = lookup(ips, assets)
    for s in ("src", "dst"):
        events = events.join(found.select(F.col("ip").alias(f"{s}_ip"), *(F.col(k).alias(f"{s}_{k}") for k in ("home", "value", "name"))), f"{s}_ip", "left")
        events = events.fillna({f"{s}_home": False, f"{s}_value": 0, f"{s}_name": ""})
    return events


def drop_whitelisted(events: DataFrame, assets: Assets) -> DataFrame:
    """Without events whose source is whitelisted."""
    return events.where(~assets.whitelisted("src_ip"))
