"""Directives: validation, the columns they compile to, and the key by which their correlation can be partitioned."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions import net, text
from wardline.functions.match import reference

ANYWHERE = ("ANY", "HOME_NET", "!HOME_NET")
STICKY = ("PLUGIN_SID", "SRC_IP", "DST_IP", "SRC_PORT", "DST_PORT", "CUSTOM_DATA1", "CUSTOM_DATA2", "CUSTOM_DATA3")
_REFERENCE = re.compile(r"^:[1-9][0-9]?$")


@dataclass
class Rule:
    stage: int
    type: str = "PluginRule"
    name: str = ""
    plugin_id: int = 0
    plugin_sid: list[int] = field(default_factory=list)
    product: list[str] = field(default_factory=list)
    category: str = ""
    subcategory: list[str] = field(default_factory=list)
    occurrence: int = 1
    from_: str = "ANY"
    to: str = "ANY"
    port_from: str = "ANY"
    port_to: str = "ANY"
    protocol: str = "ANY"
    reliability: int = 0
    timeout: int = 0
    sticky_different: str = ""
    custom_data1: str = ""
    custom_data2: str = ""
    custom_data3: str = ""
    custom_label1: str = ""
    custom_label2: str = ""
    custom_label3: str = ""

    @staticmethod
    def of(raw: dict) -> Rule:
        own = {("from_" if k == "from" else k): v for k, v in raw.items() if v is not None}
        return Rule(**{k: v for k, v in own.items() if k in Rule.__dataclass_fields__})


@dataclass
class Directive:
    id: int
    name: str
    priority: int
    kingdom: str
    category: str
    rules: list[Rule]
    disabled: bool = False
    all_rules_always_active: bool = False

    @staticmethod
    def of(raw: dict) -> Directive:
        known = {k: v for k, v in raw.items() if k in Directive.__dataclass_fields__ and k != "rules" and v is not None}
        base = {"id": 0, "name": "", "priority": 1, "kingdom": "", "category": ""}
        return Directive(**(base | known), rules=[Rule.of(r) for r in raw.get("rules") or []])

    def raw(self) -> dict:
        out = {k: v for k, v in self.__dict__.items() if k != "rules"}
        return out | {"rules": [{("from" if k == "from_" else k): v for k, v in r.__dict__.items() if v not in ("", [])} for r in self.rules]}


@dataclass
class Checked:
    directive: Directive | None
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def validate(d: Directive, taken: set[int] = frozenset()) -> Checked:
    """Errors reject a directive; what can be put right is put right in place, and warned of."""
    out = Checked(d)
    bad, warn = out.errors.append, out.warnings.append
    if d.id in taken:
        bad(f"id {d.id} is taken")
    for f in ("name", "kingdom", "category"):
        if not getattr(d, f):
            bad(f"{f} is empty")
    if not 1 <= d.priority <= 5:
        warn(f"priority {d.priority} set to 1")
        d.priority = 1
    if len(d.rules) < 2:
        bad("fewer than two rules: it would have no effect or never expire")
    stages = [r.stage for r in d.rules]
    if 0 in stages:
        bad("a stage is zero")
    if len(set(stages)) < len(stages):
        bad("a stage stands twice")
    if stages != sorted(stages):
        warn("stages are not in order; rules run in the order given")
    for r in d.rules:
        _validate_rule(r, len(d.rules), bad, warn)
    if {r.type for r in d.rules} == {"PluginRule", "TaxonomyRule"}:
        warn("rules of both types: events are let in by plugin pairs only, so taxonomy stages cannot fire")
    if out.errors:
        out.directive = None
    return out


def _validate_rule(r: Rule, n: int, bad, warn) -> None:
    if r.stage == 1 and r.occurrence != 1:
        warn("occurrence of stage 1 set to 1")
        r.occurrence = 1
    if r.type == "PluginRule":
        if r.plugin_id < 1:
            bad("plugin_id below 1")
        if not r.plugin_sid or min(r.plugin_sid) < 1:
            bad("plugin_sid missing or below 1")
    elif r.type == "TaxonomyRule":
        if not r.product or not r.category:
            bad("product or category missing")
    else:
        bad(f"unknown type {r.type!r}")
    r.reliability = min(10, max(0, r.reliability))
    if r.sticky_different and r.sticky_different not in STICKY:
        warn(f"unknown sticky_different {r.sticky_different!r} has no effect")

    def refers(value: str, what: str) -> bool:
        if not _REFERENCE.match(value):
            return False
        k = int(value[1:])
        if r.stage == 1:
            bad(f"{what}: the first rule refers to another")
        elif k >= n:
            bad(f"{what}: {value} is no earlier rule of {n}")
        elif k >= r.stage:
            warn(f"{what}: {value} is the rule itself or a later one")
        return True

    for what in ("from_", "to"):
        v = getattr(r, what)
        if not v:
            bad(f"{what.strip('_')} is empty")
        elif v not in ANYWHERE and not refers(v, what.strip("_")):
            for _, x in net.items(v):
                if net.net(x) is None:
                    bad(f"{x} is no address")
    for what in ("port_from", "port_to"):
        v = getattr(r, what)
        if v != "ANY" and not refers(v, what):
            for _, x in net.items(v):
                if not x.isdigit() or not 1 < int(x) < 65535:
                    bad(f"{x} is no port")
    for what in ("custom_data1", "custom_data2", "custom_data3"):
        k = reference(getattr(r, what)) if _REFERENCE.match(getattr(r, what)) or getattr(r, what).startswith(":") else None
        if k is not None and not (1 <= k < n and r.stage > 1):
            bad(f"{what}: {getattr(r, what)} is no earlier rule")


def keep_valid(found: list[Directive], include_disabled: bool = False) -> tuple[list[Directive], list[Checked]]:
    kept: list[Directive] = []
    checks = []
    for d in found:
        if d.disabled and not include_disabled:
            continue
        c = validate(d, {k.id for k in kept})
        checks.append(c)
        if c.directive:
            kept.append(d)
    return kept, checks


# ---- columns -----------------------------------------------------------------------------------------------------


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def rule_matches(r: Rule) -> Column:
    """Does an event match the rule?  Over normalised events with src_home and dst_home; references never match here.

    Cheap tests stand first: ids, then addresses and ports, then custom data.
    """
    if r.type == "PluginRule":
        parts = [F.col("plugin_id") == r.plugin_id, F.col("plugin_sid").isin(r.plugin_sid)]
    elif r.type == "TaxonomyRule":
        parts = [F.col("category") == r.category, F.col("product").isin(r.product)]
        if r.subcategory and "ANY" not in r.subcategory:
            parts.append(F.col("subcategory").isin(r.subcategory))
    else:
        return F.lit(False)
    for rule, ip, home in ((r.from_, "src_ip", "src_home"), (r.to, "dst_ip", "dst_home")):
        if rule == "HOME_NET":
            parts.append(F.col(home))
        elif rule == "!HOME_NET":
            parts.append(~F.col(home))
        elif rule != "ANY":
            parts.append(net.address_in_list(F.col(ip), rule))
    for rule, port in ((r.port_from, "src_port"), (r.port_to, "dst_port")):
        if rule != "ANY":
            parts.append(text.value_in_list(F.col(port).cast("string"), rule))
    if r.type == "PluginRule":
        for k in (1, 2, 3):
            rule = getattr(r, f"custom_data{k}")
            if rule not in ("", "ANY"):
                parts.append(text.text_matches(F.col(f"custom_data{k}"), rule))
    return _all(parts)


def plugin_pairs(spark: SparkSession, directives: list[Directive]) -> DataFrame:
    """(directive_id, plugin_id, plugin_sid): what lets an event in, by directive."""
    rows = sorted({(d.id, r.plugin_id, s) for d in directives for r in d.rules if r.type == "PluginRule" for s in r.plugin_sid})
    return spark.createDataFrame(rows, "directive_id int, plugin_id int, plugin_sid int")


def taxonomy_pairs(spark: SparkSession, directives: list[Directive]) -> DataFrame:
    """(directive_id, product, category), of directives without plugin rules."""
    rows = sorted({(d.id, p, r.category) for d in directives if all(x.type != "PluginRule" for x in d.rules) for r in d.rules if r.type == "TaxonomyRule" for p in r.product})
    return spark.createDataFrame(rows, "directive_id int, product string, category string")


#: A rule set of more pairs than this is not broadcast by hint; Spark then decides by size.
BROADCAST_PAIRS = 100_000


def fan_out(events: DataFrame, directives: list[Directive]) -> DataFrame:
    """A row for each event and directive that lets it in."""
    spark = events.sparkSession
    plugin, taxonomy = plugin_pairs(spark, directives), taxonomy_pairs(spark, directives)
    n = sum(len(r.plugin_sid) + len(r.product) for d in directives for r in d.rules)
    small = F.broadcast if n <= BROADCAST_PAIRS else (lambda x: x)
    if not any(r.type == "TaxonomyRule" for d in directives for r in d.rules):
        return events.join(small(plugin), ["plugin_id", "plugin_sid"])
    # events are read and looked up once, whichever of the two lets them in
    by = [(small(t.groupBy(*keys).agg(F.collect_list("directive_id").alias(name))), keys, name) for t, keys, name in ((plugin, ["plugin_id", "plugin_sid"], "_plugin"), (taxonomy, ["product", "category"], "_taxonomy"))]
    for t, keys, _ in by:
        events = events.join(t, keys, "left")
    none = F.array().cast("array<int>")
    into = F.concat(*(F.coalesce(name, none) for _, _, name in by))
    return events.withColumn("directive_id", F.explode(into)).drop("_plugin", "_taxonomy")


# ---- partitioning ------------------------------------------------------------------------------------------------


def pinned(d: Directive) -> tuple[str, ...]:
    """Event columns that every event of one backlog shares, by which a directive's work can be split.

    A field is pinned when every later rule's field refers, by a chain of references, to the first rule's, and that is
    not a list.  Backlogs of different values then never meet.
    """
    out = []
    for attr, column, wild in (("from_", "src_ip", ANYWHERE), ("to", "dst_ip", ANYWHERE), ("port_from", "src_port", ("ANY",)), ("port_to", "dst_port", ("ANY",))):
        if getattr(d.rules[0], attr) not in wild:
            continue
        if len(d.rules) > 1 and all(reference(getattr(r, attr)) == 1 and _REFERENCE.match(getattr(r, attr)) for r in d.rules[1:]):
            out.append(column)
    return tuple(out)


def names_v6(directives: list[Directive]) -> bool:
    """Does a rule's address list hold an IPv6 network?"""
    lists = (x for d in directives for r in d.rules for x in (r.from_, r.to))
    return any(n.version == 6 for x in lists if ":" in x and not _REFERENCE.match(x) for n in (net.net(v) for _, v in net.items(x)) if n)


def correlation_key(directives: list[Directive], unique_ids: bool = True, v6: bool = False) -> Column:
    """The key within a directive: its pinned columns, or a constant.

    Only sound when event ids are unique (the duplicate guard spans a directive) and no IPv6 literal is at work.
    """
    key = F.lit("")
    for d in directives:
        columns = pinned(d) if unique_ids and not v6 else ()
        if columns:
            key = F.when(F.col("directive_id") == d.id, F.concat_ws("|", *(F.col(c).cast("string") for c in columns))).otherwise(key)
    return key


def unpinned(directives: list[Directive]) -> list[int]:
    """Directives that run in one task each; worth a warning at plan time."""
    return [d.id for d in directives if not pinned(d)]
