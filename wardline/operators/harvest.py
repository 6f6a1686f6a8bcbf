"""Harvest of plugin SIDs from event tables, and the SID reference: aggregations in Spark, small results merged in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Titles that a harvest reports.
TITLES = 1000
CUSTOM = ["custom_label1", "custom_data1", "custom_label2", "custom_data2", "custom_label3", "custom_data3"]


def _top_titles(rows: DataFrame, most: int) -> DataFrame:
    return rows.groupBy("title").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "title").limit(most)


def _most_common(rows: DataFrame, top: DataFrame, column: str) -> DataFrame:
    """The value of a column that stands most often beside each of the top titles; the smallest of those that tie."""
    by = rows.join(F.broadcast(top.select("title")), "title", "left_semi")  # as many as a report has
    by = by.groupBy("title", column).agg(F.count("*").alias("k"))
    return by.groupBy("title").agg(F.min(F.struct((-F.col("k")).alias("k"), F.col(column)))[column].alias(column))


def collect_pairs(rows: DataFrame, most: int = TITLES) -> DataFrame:
    """(title, n, sid, category): the most frequent titles, each with its most common SID and category."""
    top = _top_titles(rows, most)
    return top.join(_most_common(rows, top, "sid"), "title").join(_most_common(rows, top, "category"), "title")


def collect_titles(rows: DataFrame, first_sid: int = 1, most: int = TITLES) -> DataFrame:
    """(title, n, category, sid): the most frequent titles, numbered in order."""
    top = _top_titles(rows, most).withColumn("sid", (F.row_number().over(Window.orderBy(F.desc("n"), "title")) + (first_sid - 1)).cast("int"))
    return top.join(_most_common(rows, top, "category"), "title").select("title", "n", "category", "sid")


def exists(rows: DataFrame, column: str) -> bool:
    return not rows.where(F.col(column).isNotNull()).isEmpty()


def group_by_custom(refs: DataFrame) -> DataFrame:
    """(six custom columns, sids): SIDs that share their custom data; half pairs count as none, rows without any are out."""
    whole = {}
    for k in (1, 2, 3):
        both = (F.coalesce(F.col(f"custom_label{k}"), F.lit("")) != "") & (F.coalesce(F.col(f"custom_data{k}"), F.lit("")) != "")
        whole |= {f"custom_{w}{k}": F.when(both, F.col(f"custom_{w}{k}")).otherwise("") for w in ("label", "data")}
    rows = refs.withColumns(whole).where(" or ".join(f"{c} <> ''" for c in CUSTOM))
    return rows.groupBy(*CUSTOM).agg(F.array_sort(F.collect_set("sid")).alias("sids"))


def upsert_sids(reference: dict[int, dict], found: list[dict], plugin: str, plugin_id: int, first_sid: int = 1) -> dict[int, dict]:
    """The reference with the titles it lacks, each under the next free SID; titles that are there keep theirs.

    Sequential, as every number depends on those before; ``found`` is a harvest, of TITLES rows at most.
    """
    out = dict(reference)
    titles = {r["title"]: s for s, r in out.items()}
    sid = first_sid
    for f in found:
        title, category = f["title"].replace('"', "'"), (f.get("category") or "").replace('"', "'")
        if titles.get(title):
            sid += titles[title] == sid
            continue
        while sid in out:
            sid += 1
        out[sid] = {"plugin": plugin, "id": plugin_id, "sid": sid, "title": title, "category": category}
        titles[title] = sid
        sid += 1
    return out
