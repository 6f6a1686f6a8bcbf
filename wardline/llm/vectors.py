"""Embedding near-dedup: epsilon grid order join.

Vectors of one label and length are scaled to length one, so that cosine >= c is a distance of at most
eps = sqrt(2 - 2c).  The leading principal directions (from sums that Spark adds up, of fixed size) give every vector a
cell of a grid of width eps; vectors are sorted by label and cells and cut into sequences of bounded size.  A sequence
meets every other that its box in the principal space does not rule out, and the two are joined recursively:
halves whose boxes are more than eps apart are skipped, small ones are compared by their exact cosines.
Equal vectors are one vector with a count, so copies make no pairs.

Null vectors, zero ones, and those with null or non-finite components link with nothing, and neither do rows with a null
label; vectors of different lengths are not compared; a row without an id takes no part; an empty table gives an
empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import Union, components, lean, runs, staged

COSINE = 0.98
#: Leading principal directions in the grid; vectors in a sequence; vectors that are compared at once.
DIRECTIONS = 6
SEQUENCE = 512
SMALL = 64


def unique(vectors: DataFrame) -> DataFrame:
    """(cid, label, x, copies) of the distinct usable vectors: the smallest id, and how many rows have it."""
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = vectors.where(ok).select("vec_id", "label", x.alias("x"))
    rows = rows.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0))
    rows = rows.withColumn("x", F.transform("x", lambda v: v + F.lit(0.0)))  # one zero only
    return rows.groupBy("label", "x").agg(F.min("vec_id").alias("cid"), F.count("*").alias("copies"))


def directions(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length its mean direction's complement of leading principal directions, by length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for n, m, _ in _matrices(b):
                one = np.c_[m, np.ones(len(m))]
                sums[n] = sums.get(n, 0) + one.T @ one
        out = [(n, i, row.tolist()) for n, s in sums.items() for i, row in enumerate(s)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.list_(pa.float64()))], ["n", "i", "row"])

    parts = classes.select("x").mapInArrow(lean(run), "n int, i int, row array<double>")
    total = parts.select("n", "i", F.posexplode("row").alias("j", "v")).groupBy("n", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for n, g in total.groupby("n"):
        s = np.zeros((n + 1, n + 1))
        s[g["i"], g["j"]] = g["v"]
        mean = s[n, :n] / s[n, n]
        _, vec = np.linalg.eigh(s[:n, :n] / s[n, n] - np.outer(mean, mean))
        out[int(n)] = vec[:, ::-1][:, :DIRECTIONS]
    return out


def _matrices(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, unit vectors, their rows) of a batch's column x."""
    col = b.column("x")
    sizes = np.diff(np.asarray(col.offsets))
    flat = np.asarray(col.flatten(), float)
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        yield n, _unit(flat[starts[at][:, None] + np.arange(n)]), at


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def _joined(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, eps: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Blocks (rows of a, rows of b) of two sequences that may hold neighbours, by recursive halving."""
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        if same and k < i:
            continue
        gap = np.maximum(0, np.maximum(pa_[i:j].min(0) - pb[k:m].max(0), pb[k:m].min(0) - pa_[i:j].max(0)))
        if gap @ gap > eps * eps:
            continue
        if j - i <= SMALL and m - k <= SMALL:
            yield i, j, k, m
            continue
        mi, mk = ((i + j) // 2 if j - i > SMALL else j), ((k + m) // 2 if m - k > SMALL else m)
        for x in ((i, mi), (mi, j)):
            for y in ((k, mk), (mk, m)):
                if x[1] > x[0] and y[1] > y[0]:
                    todo.append((*x, *y))


def links(vectors: DataFrame, cosine: float = COSINE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(unique vectors; links found by each: (cid, found); spanning links (a, b))."""
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()
    classes = staged(unique(vectors))
    axes = spark.sparkContext.broadcast(directions(classes))
    eps = math.sqrt(max(0.0, 2 - 2 * cosine)) * (1 + 1e-9) + 1e-9
    dims = [f"c{i}" for i in range(DIRECTIONS)]

    def grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = np.zeros((b.num_rows, DIRECTIONS), np.int64)
            size = np.zeros(b.num_rows, np.int32)
            for n, m, at in _matrices(b):
                p = m @ axes.value[n]
                cells[at[:, None], np.arange(p.shape[1])] = np.floor(p / eps)
                size[at] = n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(size), *(pa.array(cells[:, i]) for i in range(DIRECTIONS))], [*b.schema.names, "n", *dims])

    lk = classes.schema["label"].dataType.simpleString()
    placed = classes.select("label", "cid", "copies", "x").mapInArrow(lean(grid), f"label {lk}, cid {kind}, copies bigint, x array<double>, n int, " + ", ".join(f"{d} bigint" for d in dims))
    ordered = placed.repartitionByRange("label", "n", *dims, "cid").sortWithinPartitions("label", "n", *dims, "cid")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sequences of at most SEQUENCE vectors of one label and length, with their boxes in the principal space."""
        for t in runs(_capped(batches), ["label", "n", "_piece"]):
            n, m, _ = next(_matrices(pa.record_batch([t.column("x").combine_chunks()], ["x"])))
            p = m @ axes.value[n]
            low, high = np.zeros(DIRECTIONS), np.zeros(DIRECTIONS)
            low[: p.shape[1]], high[: p.shape[1]] = p.min(0), p.max(0)
            ids = t.column("cid").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [t.column("label").combine_chunks().slice(0, 1), pa.array([n], pa.int32()), pa.array([ids[0]], t.schema.field("cid").type), pa.array([int(math.floor(low[0] / eps))], pa.int64()), pa.array([int(math.floor(high[0] / eps))], pa.int64()), pa.array([low.tolist()]), pa.array([high.tolist()]), pa.array([ids], pa.list_(t.schema.field("cid").type)), pa.array([t.column("copies").to_pylist()], pa.list_(pa.int64())), pa.array([m.tobytes()], pa.binary())],
                ["label", "n", "seq", "from", "to", "low", "high", "ids", "copies", "m"],
            )

    seqs = staged(ordered.mapInArrow(lean(cut), f"label {lk}, n int, seq {kind}, from bigint, to bigint, low array<double>, high array<double>, ids array<{kind}>, copies array<bigint>, m binary"))
    boxes = seqs.select("label", "n", "seq", "from", "to", "low", "high")
    x = boxes.select("label", "n", "seq", "low", "high", F.explode(F.sequence("from", "to")).alias("cell"))
    y = boxes.select("label", "n", F.col("seq").alias("seq2"), F.col("low").alias("low2"), F.col("high").alias("high2"), F.explode(F.sequence(F.col("from") - 1, F.col("to") + 1)).alias("cell"))
    gap = F.aggregate(F.zip_with(F.zip_with("low", "high2", lambda a, b: a - b), F.zip_with("low2", "high", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0))), F.lit(0.0), lambda s, g: s + g * g)
    pairs = x.join(y, ["label", "n", "cell"]).where((F.col("seq") <= F.col("seq2")) & (gap <= eps * eps)).select("seq", "seq2").distinct()
    body = seqs.select("seq", "n", "ids", "copies", "m")
    both = staged(pairs).join(body, "seq").join(body.select(F.col("seq").alias("seq2"), F.col("ids").alias("ids2"), F.col("copies").alias("copies2"), F.col("m").alias("m2")), "seq2")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (a, null, found): links that a found here; and (a, b, 0): links of a spanning forest."""
        for b in batches:
            for r in b.to_pylist():
                same = r["seq"] == r["seq2"]
                u, v = np.frombuffer(r["m"]).reshape(-1, r["n"]), np.frombuffer(r["m2"]).reshape(-1, r["n"])
                ax = axes.value[r["n"]]
                cu, cv = np.array(r["copies"]), np.array(r["copies2"])
                fu, fv = np.zeros(len(u), np.int64), np.zeros(len(v), np.int64)
                forest, edges = Union(len(u) + (0 if same else len(v))), []
                off = 0 if same else len(u)
                for i, j, k, m in _joined(u, v, u @ ax, v @ ax, eps, same):
                    cos = u[i:j] @ v[k:m].T
                    for s, t in np.argwhere(np.abs(cos - cosine) < 1e-9).tolist():
                        cos[s, t] = math.fsum((u[i + s] * v[k + t]).tolist())
                    hit = cos >= cosine
                    if same and i == k:
                        hit = np.triu(hit, 1)
                    fu[i:j] += hit @ cv[k:m]
                    fv[k:m] += hit.T @ cu[i:j]
                    for s, t in np.argwhere(hit).tolist():
                        if forest.join(i + s, off + k + t):
                            edges.append((r["ids"][i + s], r["ids2"][k + t]))
                ids = r["ids"] + r["ids2"]
                found = np.r_[fu, fv]
                keep = np.flatnonzero(found).tolist()
                t = b.schema.field("seq").type
                yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in keep] + [e[0] for e in edges], t), pa.array([None] * len(keep) + [e[1] for e in edges], t), pa.array(found[keep].tolist() + [0] * len(edges), pa.int64())], ["a", "b", "found"])

    got = staged(both.mapInArrow(lean(compare), f"a {kind}, b {kind}, found bigint"))
    return classes, got.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("found").alias("found")), got.where("b is not null").select("a", "b")


def _capped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with a running piece number that changes every SEQUENCE rows of a partition."""
    seen = 0
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array((seen + np.arange(b.num_rows)) // SEQUENCE)], [*b.schema.names, "_piece"])
        seen += b.num_rows


def dedup(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    classes, found, edges = links(vectors, cosine)
    named = components(edges).withColumnRenamed("node", "cid")
    # two vectors that differ in length only by scale are linked above; copies of one vector are linked with each other
    per = classes.join(found, "cid", "left").join(named, "cid", "left").select("label", "x", (F.col("copies") - 1 + F.coalesce("found", F.lit(0))).alias("n"), F.coalesce("component", "cid").alias("c"))
    x = F.transform("embedding", lambda v: v.cast("double") + F.lit(0.0))
    rows = vectors.select("vec_id", "label", x.alias("x"))
    out = rows.join(per, ["label", "x"], "left")
    ok = F.col("vec_id").isNotNull()
    out = out.select("vec_id", F.when(ok, F.coalesce("n", F.lit(0))).otherwise(0).cast("bigint").alias("n_links"), F.when(ok, F.coalesce("c", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
