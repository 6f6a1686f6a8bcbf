"""Directive tools: generation from SIDs, merging, splitting, conversion, and test events."""

from __future__ import annotations

import copy
import random
import xml.etree.ElementTree as ET
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.plans.directives import Directive, Rule
from wardline.schemas import EVENT

#: Occurrences and timeouts of generated stages; fixed values.
STAGES = ((1, 0), (10, 3600), (10000, 21600))


def generate_directives(sids: DataFrame, title: str = "EVENT_TITLE (SRC_IP to DST_IP)", kingdom: str = "", priority: int = 3, reliability: int = 1, first_id: int = 1, taken: tuple[int, ...] = ()) -> DataFrame:
    """(id, name, kingdom, category, plugin_id, sids, stages): a three-stage directive for each title of (id, sid, title, category, kingdom).

    SIDs of one title share a directive.  Ids follow the titles' smallest SIDs, leaving out those taken.
    """
    low = min(10, max(0, reliability))
    rows = sids.where("title <> '' and sid <> 0")
    one = rows.groupBy("title").agg(F.min(F.struct("sid", "id", "category", "kingdom")).alias("m"), F.array_sort(F.collect_set("sid")).alias("sids"))
    one = one.withColumn("k", F.row_number().over(Window.orderBy("m.sid", "title")))
    shift = F.lit(0)
    for t in sorted({x for x in taken if x >= first_id}):  # every taken id at or below the running one moves it by one
        shift = shift + F.when(F.col("k") + (first_id - 1) + shift >= t, 1).otherwise(0)
    stages = F.array(*(F.struct(F.lit(n + 1).alias("stage"), F.lit(o).alias("occurrence"), F.lit(t).alias("timeout"), F.lit(r).alias("reliability"), F.lit("ANY" if not n else ":1").alias("from"), F.lit("ANY" if not n else ":1").alias("to")) for n, ((o, t), r) in enumerate(zip(STAGES, (low, min(10, low + 4), 10)))))
    return one.select((F.col("k") + (first_id - 1) + shift).cast("int").alias("id"), F.replace(F.lit(title), F.lit("EVENT_TITLE"), F.col("title")).alias("name"), F.coalesce(F.nullif("m.kingdom", F.lit("")), F.lit(kingdom)).alias("kingdom"), F.col("m.category").alias("category"), F.col("m.id").alias("plugin_id"), "sids", F.lit(priority).alias("priority"), stages.alias("stages"))


def merge_directives(ours: DataFrame, theirs: DataFrame, policy: str = "theirs") -> DataFrame:
    """All columns and `change`: kept, replaced or added; full outer by id.  policy: whose body wins where both have one."""
    if policy not in ("ours", "theirs"):
        raise ValueError("policy is ours or theirs")
    body = [c for c in ours.columns if c != "id"]
    a = ours.select("id", F.struct(*body).alias("a"))
    b = theirs.select("id", F.struct(*body).alias("b"))
    both = a.join(b, "id", "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull() | F.lit(policy == "ours") | (F.to_json("a") == F.to_json("b")), "kept").otherwise("replaced")
    win = F.when(change.isin("added", "replaced"), F.col("b")).otherwise(F.col("a"))
    return both.select("id", win.alias("w"), change.alias("change")).select("id", "w.*", "change")


def split_by_count(directives: DataFrame, per_file: int) -> DataFrame:
    """With `file`, from 1, of per_file directives each in order of id."""
    n = F.row_number().over(Window.orderBy("id"))
    return directives.withColumn("file", (F.floor((n - 1) / per_file) + 1).cast("int"))


def split_in(directives: DataFrame, files: int) -> DataFrame:
    """With `file`, from 1, in so many equal parts; the last takes what is over."""
    total = directives.count()
    if files < 1 or total < files:
        raise ValueError("fewer directives than files")
    n = F.row_number().over(Window.orderBy("id"))
    return directives.withColumn("file", (F.least(F.floor((n - 1) / (total // files)), F.lit(files - 1)) + 1).cast("int"))


# ---- conversion of XML directives -----------------------------------------------------------------------------------


@dataclass
class Names:
    """Name tables of the source system: taxonomy by directive id, and names by number."""

    taxonomy: dict[int, tuple[int, int]]
    kingdoms: dict[int, str]
    categories: dict[int, str]
    products: dict[int, str]
    product_categories: dict[int, str]
    subcategories: dict[tuple[int, int], str]  # (id, category id)


def _flat(rules: list[ET.Element]) -> list[ET.Element]:
    """Rules in order, down the first branch only: siblings after a nested block are lost, which is what users have now."""
    out: list[ET.Element] = []
    while rules:
        nested = next((k for k, r in enumerate(rules) if r.find("rules") is not None), None)
        out += rules if nested is None else rules[: nested + 1]
        rules = [] if nested is None else rules[nested].find("rules").findall("rule")
    return out


def _numbers(text: str) -> list[int]:
    return [int(x) for x in text.split(",") if x.strip().isdigit()]


def convert_xml(text: str, names: Names) -> tuple[list[Directive], list[str]]:
    """Directives of an XML file without a root element, and warnings."""
    root = ET.fromstring(f"<directives>{text[text.find('?>') + 2 if '?>' in text else 0 :]}</directives>")
    out, warnings = [], []
    for node in root.iter("directive"):
        number = int(node.get("id") or 0)
        k, c = names.taxonomy.get(number, (0, 0))
        nodes = _flat(node.findall("rule"))
        if len(nodes) < len(list(node.iter("rule"))):
            warnings.append(f"directive {number}: rules beside a nested block were left out")
        rules: list[Rule] = []
        for stage, r in enumerate(nodes, 1):
            get = lambda key, default="": r.get(key) or default  # noqa: B023, E731
            refer = lambda v: ":" + v.partition(":")[0] if ":" in v else v
            own = Rule(stage, name=get("name"), occurrence=int(get("occurrence", "1")), from_=refer(get("from", "ANY")), to=refer(get("to", "ANY")), port_from=refer(get("port_from", "ANY")), port_to=refer(get("port_to", "ANY")), protocol=get("protocol", "ANY"), reliability=int(get("reliability", "0")), timeout=int(get("time_out", get("timeout", "0")) or 0))
            own.sticky_different = get("sticky_different")
            if sids := get("plugin_sid"):
                own.type, own.plugin_id = "PluginRule", int(get("plugin_id", "0"))
                own.plugin_sid = list(rules[int(sids.partition(":")[0]) - 1].plugin_sid) if ":" in sids else _numbers(sids)
            else:
                own.type = "TaxonomyRule"
                own.product = [names.products[n] for n in _numbers(get("product")) if n in names.products]
                category = get("category")
                own.category = names.product_categories.get(int(category), category) if category.isdigit() else category
                if category.isdigit():
                    own.subcategory = [names.subcategories[n, int(category)] for n in _numbers(get("subcategory")) if (n, int(category)) in names.subcategories]
            rules.append(own)
        out.append(Directive(number, node.get("name") or "", int(node.get("priority") or 1), names.kingdoms.get(k, ""), names.categories.get(c, ""), rules))
    return out, warnings


# ---- test events ----------------------------------------------------------------------------------------------------


def generate_events(spark: SparkSession, directives: list[Directive], most: int = 20, seed: int = 1, start: int = 1_700_000_000) -> DataFrame:
    """Events that walk through every directive's stages, min(occurrence, most) for each; a bounded test table."""
    rng = random.Random(seed)
    rows = []

    def concrete(rule: str, first: str, fresh: str) -> str:
        if rule.startswith(":"):
            return first
        plain = [x for x in rule.replace(",", " ").split() if not x.startswith("!")]
        if rule in ("ANY", "HOME_NET") or not plain:
            return fresh
        return "8.8.8.8" if rule == "!HOME_NET" else rng.choice(plain).partition("/")[0]

    for d in directives:
        at, first = start, {}
        for r in d.rules:
            for _ in range(max(1, min(r.occurrence, most))):
                at += 1
                e = dict.fromkeys([f.name for f in EVENT.fields])
                src, dst = f"10.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(1, 255)}", f"192.168.{rng.randrange(256)}.{rng.randrange(1, 255)}"
                e |= {"event_id": f"{d.id}-{len(rows)}", "timestamp": _iso(at), "sensor": "generator", "title": r.name or d.name, "protocol": "TCP" if r.protocol == "ANY" else r.protocol}
                e |= {"src_ip": concrete(r.from_, first.get("src_ip", src), src), "dst_ip": concrete(r.to, first.get("dst_ip", dst), dst)}
                e |= {"src_port": int(concrete(r.port_from, first.get("src_port", "0"), str(rng.randrange(1025, 65000)))), "dst_port": int(concrete(r.port_to, first.get("dst_port", "0"), str(rng.randrange(1025, 65000))))}
                if r.type == "PluginRule":
                    e |= {"plugin_id": r.plugin_id, "plugin_sid": rng.choice(r.plugin_sid)}
                else:
                    e |= {"product": rng.choice(r.product), "category": r.category, "subcategory": rng.choice(r.subcategory or [""])}
                for k in (1, 2, 3):
                    rule = getattr(r, f"custom_data{k}")
                    if rule not in ("", "ANY"):
                        e[f"custom_data{k}"] = first.get(f"custom_data{k}") if rule.startswith(":") else rule.partition(",")[0].lstrip("!")
                first = first or {k: (str(v) if "port" in k else v) for k, v in copy.copy(e).items()}
                rows.append(tuple(e[f.name] for f in EVENT.fields))
    return spark.createDataFrame(rows, EVENT)


def _iso(seconds: int) -> str:
    from datetime import datetime, timezone

    return datetime.fromtimestamp(seconds, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
