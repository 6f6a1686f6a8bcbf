"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of words.  Word hashes fall into a fixed number of features, weighted by the document
frequencies of all documents.  One pass over the passages of all documents gives the sketch A'(A W) of the TF-IDF
matrix A for random W, summed within tasks and then by Spark; its
Nystrom form is the randomised SVD (directions and singular values), of fixed size, on the driver.  Benchmark items, in blocks of ``ITEMS``, are projected into the whitened latent
space and broadcast; every window of every document is projected and compared by cosine, and what is near is
verified on the words themselves: the longest common subsequence with the item over a stretch of about the item's
length, and that of the item's answer, its last quarter.  An item is found where the whole agrees, or where most
of it and the answer agree.

Words are lower-cased runs of letters, digits and bytes beyond ASCII.  Null, empty and wordless texts and items
match nothing; very long texts are searched whole; repeated rows match alike; an item given twice is reported under
both ids, and under an id that is null or of any type as it is; empty tables of documents or items give an empty result.  Extra columns of the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wardline.llm.common import lean
from wardline.llm.arrowtext import Piece, pieces

FEATURES = 1 << 14
RANK = 64
#: Words in a step, and steps in a window.
STEP, STEPS = 6, 4
#: Least cosine; times sqrt(n / window) for items of n words that are shorter than a window, as only so much of it can be theirs.
NEAR = 0.58
#: Steps whose words are counted in one dense product while the SVD is fitted.
PRODUCT = 64
#: Cosines that are held at a time; about what stays in a core's cache.
CELLS = 1 << 18
#: LCS shares: of the whole; or of the whole together with the answer.
WHOLE, PART, ANSWER = 0.6, 0.45, 0.8
#: Items that are broadcast at a time, about one KB each, and those whose places of words a task remembers.
ITEMS, REMEMBERED = 50_000, 4096

APART = np.ones(256, bool)
APART[48:58] = APART[65:91] = APART[97:123] = False
APART[128:] = False
_SHIFT = np.uint64(50)  # the top 14 bits


def features(h: np.ndarray) -> np.ndarray:
    return (h >> _SHIFT).astype(np.uint16)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each feature, over all documents, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FEATURES + 1, np.int64)
        for b in batches:
            for p in pieces(b.column(0), APART):
                f = features(p.hashes)
                for d in range(0, len(p.bounds) - 1, 255):  # as many as a byte counts
                    own = p.bounds[d : d + 256]
                    held = np.zeros((len(own) - 1, FEATURES), bool)
                    held[np.repeat(np.arange(len(own) - 1), np.diff(own)), f[own[0] : own[-1]]] = True
                    total[:FEATURES] += np.add.reduce(held.view(np.uint8), axis=0, dtype=np.uint8)
                total[FEATURES] += len(p.bounds) - 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["f", "n"])

    rows = docs.select("text").mapInArrow(lean(run), "f int, n bigint").groupBy("f").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(FEATURES + 1, np.int64)
    df[rows["f"].to_numpy(int)] = rows["n"].to_numpy(int)
    return df[:FEATURES], int(df[FEATURES])


@dataclass
class Steps:
    """The steps of a piece: where each begins among the words, whose it is, and the words in one."""

    starts: np.ndarray
    doc: np.ndarray
    width: int

    @staticmethod
    def of(bounds: np.ndarray, width: int = STEP) -> Steps:
        n = -(-np.diff(bounds) // width)
        doc = np.repeat(np.arange(len(n)), n)
        first = np.cumsum(n) - n
        at = np.arange(n.sum()) - first[doc]
        return Steps(bounds[:-1][doc] + at * width, doc, width)


def windows(vectors: np.ndarray, s: Steps) -> tuple[np.ndarray, np.ndarray]:
    """Sums over STEPS steps of one document (fewer at its end), as unit vectors; and the step that each begins at.

    A document's last steps begin a window only where it has no full one.
    """
    total = vectors.copy()
    for k in range(1, STEPS):
        total[:-k] += vectors[k:] * (s.doc[k:] == s.doc[:-k]).astype(np.float32)[:, None]
    keep = np.ones(len(s.doc), bool)
    keep[-STEPS + 1 :] = False
    keep[: -STEPS + 1] = s.doc[STEPS - 1 :] == s.doc[: -STEPS + 1] if len(s.doc) >= STEPS else True
    keep |= np.r_[True, s.doc[1:] != s.doc[:-1]]
    at = np.flatnonzero(keep)
    w = total[at]
    w /= np.sqrt(np.einsum("ij,ij->i", w, w))[:, None] + 1e-12
    return w, at


def step_sums(f: np.ndarray, weights: np.ndarray, s: Steps) -> np.ndarray:
    """Sum of the weights (whose last row is zero) of each step's words."""
    size = np.diff(np.r_[s.starts, len(f)])
    f = np.r_[f.astype(np.int32), np.zeros(s.width, np.int32)]
    total = np.zeros((len(s.starts), weights.shape[1]), np.float32)
    row = np.empty_like(total)
    for j in range(s.width):
        at = np.where(size > j, f[s.starts + j], FEATURES)
        np.take(weights, at, axis=0, out=row, mode="clip")
        total += row
    return total


def padded(weights: np.ndarray) -> np.ndarray:
    return np.r_[weights, np.zeros((1, weights.shape[1]), np.float32)]


def add_products(z: np.ndarray, f: np.ndarray, s: Steps, y: np.ndarray) -> None:
    """Adds to z, for each step, the step's row of y to the rows of its words' features; by small dense products."""
    ends = np.r_[s.starts, len(f)]
    step = np.repeat(np.arange(len(s.starts)), np.diff(ends))
    place = np.zeros(FEATURES, np.int64)
    for lo in range(0, len(s.starts), PRODUCT):
        hi = min(lo + PRODUCT, len(s.starts))
        own, n = slice(ends[lo], ends[hi]), hi - lo
        held = np.zeros(FEATURES, bool)
        held[f[own]] = True
        names = np.flatnonzero(held)
        place[names] = np.arange(len(names)) * n
        counts = np.bincount(place[f[own]] + (step[own] - lo), minlength=len(names) * n).reshape(len(names), n)
        z[names] += counts.astype(np.float32) @ y[lo:hi]


def fit(docs: DataFrame, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """idf of the features, and the projection of features into the whitened latent space (features x rank)."""
    df, n = document_frequencies(docs)
    idf = np.log((n + 1) / (df + 1)).astype(np.float32) + np.float32(0.01)
    omega = np.random.RandomState(seed).standard_normal((FEATURES, RANK)).astype(np.float32)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((idf, seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, seed = shared.value
        w = padded(np.random.RandomState(seed).standard_normal((FEATURES, RANK)).astype(np.float32) * idf[:, None])
        z = np.zeros((FEATURES, RANK))
        for b in batches:
            for p in pieces(b.column(0), APART):
                if not len(p.hashes):
                    continue
                f, s = features(p.hashes), Steps.of(p.bounds, STEP * STEPS)
                y = step_sums(f, w, s)
                y /= np.einsum("ij,ij->i", y, y)[:, None] / RANK + 1e-9  # squared length of the row, from its sketch
                add_products(z, f, s, y)
        at = np.flatnonzero(z.any(1))
        z = z[at] * idf[at, None]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(z[:, j].astype(np.float32)) for j in range(RANK))], ["f", *(f"z{j}" for j in range(RANK))])

    schema = "f int, " + ", ".join(f"z{j} float" for j in range(RANK))
    rows = docs.select("text").mapInArrow(lean(run), schema).groupBy("f").agg(*(F.sum(f"z{j}").alias(f"z{j}") for j in range(RANK))).toPandas()
    z = np.zeros((FEATURES, RANK))
    z[rows["f"].to_numpy(int)] = rows.drop(columns="f").to_numpy(float)
    g = omega.T.astype(float) @ z
    g = (g + g.T) / 2
    val, vec = np.linalg.eigh(g)
    keep = val > max(val.max(initial=0) * 1e-10, 1e-12)
    if not keep.any():
        return idf, np.zeros((FEATURES, RANK), np.float32)
    half = z @ (vec[:, keep] / np.sqrt(val[keep]))
    u, sv, _ = np.linalg.svd(half, full_matrices=False)
    return idf, (u / (sv + sv.max() * 1e-6)).astype(np.float32) * idf[:, None]


@dataclass
class Items:
    ids: list
    words: list[np.ndarray]
    item: np.ndarray  # of each query vector
    vectors: np.ndarray


def project_items(rows: list[tuple], projection: np.ndarray) -> Items:
    """Query vectors: item windows side by side, the last one flush with the item's end."""
    ids, words, item, vectors = [], [], [], []
    size = STEP * STEPS
    for i, text in rows:
        h = np.concatenate([p.hashes for p in pieces(pa.array([text or ""]), APART)])
        if not len(h):
            continue
        k = len(ids)
        ids.append(i)
        words.append(h)
        for at in {*range(0, max(1, len(h) - size + 1), size), max(0, len(h) - size)}:
            v = projection[features(h[at : at + size])].sum(0)
            vectors.append(v / (np.linalg.norm(v) + 1e-12))
            item.append(k)
    return Items(ids, words, np.array(item, np.int64), np.array(vectors, np.float32).reshape(-1, projection.shape[1]))


def lcs(places: list[int], n: int) -> int:
    """Longest common subsequence with a sequence of n, bit-parallel; places: for each word where it stands in that sequence."""
    full = (1 << n) - 1
    v = full
    for m in places:
        u = v & m
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def masks(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out


class Verifier:
    def __init__(self, items: Items):
        self.items = items
        self.known: dict[int, tuple[dict[int, int], dict[int, int], int]] = {}

    def places(self, k: int) -> tuple[dict[int, int], dict[int, int], int]:
        """Where words stand in an item and in its answer, and the answer's length."""
        found = self.known.get(k)
        if not found:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            w = self.items.words[k]
            tail = w[-max(1, len(w) // 4) :]
            found = self.known[k] = masks(w), masks(tail), len(tail)
        return found

    def check(self, k: int, words: np.ndarray) -> tuple[float, float, int, int] | None:
        """Best (share, answer's share, first word, last word) of item k in a stretch of a document's words.

        Stretches of a quarter more words than the item has are aligned, from every word that the item holds (of items of over
        64 words, from those that are n / 32 words apart).
        """
        (mine, tail, m), n = self.places(k), len(self.items.words[k])
        words, best = words.tolist(), None
        at = [i for i, w in enumerate(words) if w in mine]
        if len(at) < PART * n or lcs([mine[words[i]] for i in at], n) < PART * n:  # no stretch has more
            return None
        size, step, after = n + n // 4 + 1, max(1, n // 32), 0
        for a, lo in enumerate(at):
            if lo < after:
                continue
            after = lo + step
            held = [words[i] for i in at[a : a + size] if i < lo + size]
            if len(held) < max(PART, best[0] if best else 0) * n:
                continue
            share = lcs([mine[w] for w in held], n) / n
            if share >= PART and (best is None or share > best[0]):
                answer = lcs([tail[w] for w in held if w in tail], m) / m
                if share >= WHOLE or answer >= ANSWER:
                    best = (share, answer, lo, min(lo + size, len(words)))
        return best


def search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, share, answer_share, first_word, last_word) for every item found in a document."""
    idf, projection = fit(docs)
    spark = docs.sparkSession
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, share double, answer_share double, first_word bigint, last_word bigint"
    out: DataFrame | None = None
    block: list[tuple] = []

    def against(rows: list[tuple]) -> DataFrame:
        shared = spark.sparkContext.broadcast((project_items(rows, projection), projection))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items, projection = shared.value
            verifier, wide = Verifier(items), padded(projection)
            longest = np.array([len(w) for w in items.words], np.int64)
            least = (NEAR * np.sqrt(np.minimum(1, longest / (STEP * STEPS)))).astype(np.float32)[items.item]
            lowest = least.min(initial=np.float32(1))
            for b in batches:
                ids = b.column("doc_id")
                found: list[tuple] = []
                for p in pieces(b.column("text"), APART):
                    if not len(p.hashes) or not len(items.ids):
                        continue
                    s = Steps.of(p.bounds)
                    w, at = windows(step_sums(features(p.hashes), wide, s), s)
                    stretches: dict[tuple[int, int], list[list[int]]] = {}
                    rows = max(1, CELLS // max(1, len(items.vectors)))
                    for lo in range(0, len(w), rows):
                        cosine = w[lo : lo + rows] @ items.vectors.T
                        row = np.flatnonzero(cosine.max(1) >= lowest)
                        near = np.argwhere(cosine[row] >= least)
                        step, k = at[lo + row[near[:, 0]]], items.item[near[:, 1]]
                        d, n = s.doc[step], longest[k]
                        first, last = np.maximum(p.bounds[d], s.starts[step] - n), np.minimum(p.bounds[d + 1], s.starts[step] + STEP * STEPS + n)
                        for d_, k_, x, y in zip(d.tolist(), k.tolist(), first.tolist(), last.tolist()):
                            held = stretches.setdefault((d_, k_), [])
                            if held and x <= held[-1][1]:
                                held[-1][1] = max(y, held[-1][1])
                            else:
                                held.append([x, y])
                    best: dict[tuple[int, int], tuple] = {}
                    for (d, k), held in stretches.items():
                        for first, last in held:
                            got = verifier.check(k, p.hashes[first:last])
                            if got and ((d, k) not in best or got[0] > best[d, k][0]):
                                off = first - int(p.bounds[d])
                                best[d, k] = (got[0], got[1], off + got[2], off + got[3])
                    found += [(ids[p.first + d].as_py(), items.ids[k], *v) for (d, k), v in best.items()]
                cols = list(zip(*found)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], ids.type), pa.array(cols[1], item_type), *(pa.array(c, t) for c, t in zip(cols[2:], (pa.float64(), pa.float64(), pa.int64(), pa.int64())))], ["doc_id", "item_id", "share", "answer_share", "first_word", "last_word"])

        return docs.select("doc_id", "text").mapInArrow(lean(run), schema)

    for r in benchmark.select("item_id", "text").toLocalIterator():
        block.append((r["item_id"], r["text"]))
        if len(block) == ITEMS:
            out = against(block) if out is None else out.unionByName(against(block))
            block = []
    if block or out is None:
        out = against(block) if out is None else out.unionByName(against(block))
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no item is found, with all their columns; documents without an id are kept."""
    hit = search(docs, benchmark).select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti").select(docs.columns)
