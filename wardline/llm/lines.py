"""Line dedup: documents that share rare line hashes are aligned pairwise by patience diff, and aligned common blocks
are deleted from the later document (the larger doc_id).  Runs of lines that stand in both in another order go too.

Keys are the shortest runs of lines of ``BLOCK_WORDS`` words that begin or end at each line, whatever the length of the lines:
every line of a block that two documents share is in such a run within the block.  A key leads every later document to the
first one that holds it, so a run in any number of documents makes as many pairs less one, each run keeps its first
place, and a line goes exactly where a run of ``BLOCK_WORDS`` words around it stands in an earlier document: runs that an
alignment misses or tears apart are looked up by their hashes and deleted as well.  Pairs are aligned on line hashes alone; texts are read again only where lines go.
Lines are compared byte for byte; empty lines don't count.

Null and empty texts, and rows without an id, stay as they are and pair with nothing; rows of one id are one document
to each other, so repeated rows don't delete each other; very long texts are aligned whole; an empty table gives an empty
result.  All columns are kept, and the names used inside do not clash with them.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.arrowtext import NEWLINE, mix, pieces
from wardline.llm.common import lean, staged

BLOCK_WORDS = 8
_P = 0x9FB21C651E98DF25
_PI = pow(_P, -1, 1 << 64)


def _sequences(docs: DataFrame) -> DataFrame:
    """(doc_id, lines, words): per document its line hashes and their word counts, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines, words = [], []
            col = b.column("text")
            for p, q in zip(pieces(col, NEWLINE, lower=False), pieces(col)):
                n = (np.searchsorted(q.starts, p.ends) - np.searchsorted(q.starts, p.starts)).astype(np.int32)
                for lo, hi in zip(p.bounds[:-1].tolist(), p.bounds[1:].tolist()):
                    lines.append(p.hashes[lo:hi].tobytes())
                    words.append(n[lo:hi].tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lines, pa.binary()), pa.array(words, pa.binary())], ["doc_id", "lines", "words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return staged(docs.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, lines binary, words binary"))


def _runs(lines: np.ndarray, words: np.ndarray, block_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first line, last line + 1) of the shortest runs of block_words words that begin or end at each line."""
    total = np.r_[0, np.cumsum(words, dtype=np.int64)]
    n = len(lines)
    end = np.searchsorted(total, total[:-1] + block_words)
    start = np.searchsorted(total, total[1:] - block_words, "right") - 1
    begins, ends = np.flatnonzero(end <= n), np.flatnonzero(start >= 0)
    lo, hi = np.r_[begins, start[ends]], np.r_[end[begins], ends + 1]
    p, q = (np.cumprod(np.r_[np.ones(1, np.uint64), np.full(n, np.uint64(base))], dtype=np.uint64) for base in (_P, _PI))
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(lines.view(np.uint64) * p[:n], dtype=np.uint64)]
    return mix((sums[hi] - sums[lo]) * q[lo] + (hi - lo).astype(np.uint64)).view(np.int64), lo, hi


def _keys(sequences: DataFrame, block_words: int) -> DataFrame:
    """(run, doc_id), distinct within a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs, take = [], []
            for k, (lines, words) in enumerate(zip(b.column("lines").to_pylist(), b.column("words").to_pylist())):
                h = np.unique(_runs(np.frombuffer(lines, np.int64), np.frombuffer(words, np.int32), block_words)[0])
                hs.append(h)
                take.append(np.full(len(h), k))
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs)), b.column("doc_id").take(pa.array(np.concatenate(take)))], ["run", "doc_id"])

    return sequences.mapInArrow(lean(run), f"run bigint, doc_id {sequences.schema['doc_id'].dataType.simpleString()}")


def patience(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Common blocks (start in a, start in b, length) of two sequences, in order.

    Elements that stand once in either stretch are anchors; their longest rising run is kept, each is grown over
    equal neighbours, and the stretches between are aligned in the same way.
    """
    found: list[tuple[int, int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, at, end = todo.pop()
        if lo >= hi or at >= end:
            continue
        once: dict[int, int] = {}
        for i in range(lo, hi):
            once[a[i]] = -1 if a[i] in once else i
        other: dict[int, int] = {}
        for j in range(at, end):
            if once.get(b[j], -1) >= 0:
                other[b[j]] = -1 if b[j] in other else j
        pairs = sorted((once[h], j) for h, j in other.items() if j >= 0)
        if not pairs:  # nothing stands once in both: the first places of what stands in both
            seen: dict[int, int] = {}
            for j in range(end - 1, at - 1, -1):
                seen[b[j]] = j
            new: dict[int, int] = {}
            for i in range(hi - 1, lo - 1, -1):
                if a[i] in seen:
                    new[a[i]] = i
            pairs = sorted((i, seen[h]) for h, i in new.items())
            if not pairs:
                continue
        tails: list[int] = []  # longest rising subsequence of the places in b
        chain: list[int] = []
        back: list[int] = []
        for k, (_, j) in enumerate(pairs):
            n = bisect_left(tails, j)
            back.append(chain[n - 1] if n else -1)
            tails[n : n + 1], chain[n : n + 1] = [j], [k]
        k, rising = chain[-1], []
        while k >= 0:
            rising.append(pairs[k])
            k = back[k]
        i0, j0 = lo, at
        for i, j in reversed(rising):
            if i < i0 or j < j0:
                continue  # inside the block grown before
            x, y = i, j
            while x > i0 and y > j0 and a[x - 1] == b[y - 1]:
                x, y = x - 1, y - 1
            n = i - x + 1
            while x + n < hi and y + n < end and a[x + n] == b[y + n]:
                n += 1
            todo.append((i0, x, j0, y))
            found.append((x, y, n))
            i0, j0 = x + n, y + n
        todo.append((i0, hi, j0, end))
    return sorted(found)


def shared(a: np.ndarray, w: np.ndarray, b: np.ndarray, v: np.ndarray, block_words: int = BLOCK_WORDS) -> list[tuple[int, int]]:
    """(first line, last line + 1) in a of what goes against b: aligned blocks, and runs that the alignment tears apart.

    a and b are line hashes, w and v the words of each line.
    """
    total = np.r_[0, np.cumsum(w, dtype=np.int64)]
    out = [(x, x + n) for x, _, n in _merged(patience(a.tolist(), b.tolist())) if total[x + n] - total[x] >= block_words]
    gone = np.zeros(len(a) + 1, np.int64)  # how many blocks begin less how many have ended
    for x, y in out:
        gone[x] += 1
        gone[y] -= 1
    left = np.r_[0, np.cumsum(np.cumsum(gone)[:-1] == 0)]  # lines not in a block before each line
    h, lo, hi = _runs(a, w, block_words)
    more = np.flatnonzero(np.isin(h, _runs(b, v, block_words)[0]))
    more = more[left[hi[more]] > left[lo[more]]]
    torn: list[tuple[int, int]] = []
    for x, y in sorted(zip(lo[more].tolist(), hi[more].tolist())):
        if torn and x <= torn[-1][1]:
            torn[-1] = (torn[-1][0], max(y, torn[-1][1]))
        else:
            torn.append((x, y))
    return out + torn


def blocks(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, of_doc_id, first_line, last_line, n_words): blocks to delete, lines counted from 0 without empty ones."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    seq = _sequences(docs)
    keys = staged(_keys(seq, block_words))
    first = keys.groupBy("run").agg(F.min("doc_id").alias("of"), F.max("doc_id").alias("last")).where("of < last").drop("last")
    pairs = staged(keys.join(first, "run").where("doc_id > of").select("doc_id", "of").distinct())
    later = seq.select("doc_id", F.col("lines").alias("a"), F.col("words").alias("w"))
    early = seq.select(F.col("doc_id").alias("of"), F.col("lines").alias("b"), F.col("words").alias("v"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            rows, at = [], []
            for k, (a, w, b, v) in enumerate(zip(*(t.column(c).to_pylist() for c in "awbv"))):
                a, w, b, v = np.frombuffer(a, np.int64), np.frombuffer(w, np.int32), np.frombuffer(b, np.int64), np.frombuffer(v, np.int32)
                for x, y in shared(a, w, b, v, block_words):
                    rows.append((x, y - 1, int(w[x:y].sum())))
                    at.append(k)
            got, pick = np.array(rows, np.int64).reshape(-1, 3), pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([t.column("doc_id").take(pick), t.column("of").take(pick), *(pa.array(got[:, i]) for i in range(3))], ["doc_id", "of_doc_id", "first_line", "last_line", "n_words"])

    joined = pairs.join(early, "of").join(later, "doc_id")
    return joined.select("doc_id", "of", "a", "w", "b", "v").mapInArrow(lean(align), f"doc_id {kind}, of_doc_id {kind}, first_line bigint, last_line bigint, n_words bigint").distinct()


def _merged(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Blocks that touch in both sequences are one."""
    out: list[tuple[int, int, int]] = []
    for x, y, n in found:
        if out and out[-1][0] + out[-1][2] == x and out[-1][1] + out[-1][2] == y:
            out[-1] = (out[-1][0], out[-1][1], out[-1][2] + n)
        else:
            out.append((x, y, n))
    return out


def dedup(docs: DataFrame, drop_emptied: bool = False, changed_only: bool = False) -> DataFrame:
    """docs with the blocks deleted, in all their columns, and `_wl_cut`: [first, last, other document] of each block.

    drop_emptied: without the rows of which no word is left; changed_only: only rows that lose something.
    """
    cut = blocks(docs).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("first_line", "last_line", "of_doc_id"))).alias("_wl_cut"))
    cut = staged(cut).hint("merge")  # one plan at every size
    both = docs.join(cut, "doc_id", "inner" if changed_only else "left").select(*docs.columns, "_wl_cut")
    schema = both.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            texts, keep = [], []
            for t, c in zip(b.column("text"), b.column("_wl_cut")):
                s = t.as_py()
                if c.is_valid and s is not None:
                    s = _without(s, [(r["first_line"], r["last_line"]) for r in c.as_py()])
                    keep.append(not drop_emptied or bool(s.strip()))
                else:
                    keep.append(True)
                texts.append(s)
            cols = [*b.columns]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, b.schema.names).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(lean(run), schema)


def _without(text: str, cut: list[tuple[int, int]]) -> str:
    gone = {i for lo, hi in cut for i in range(lo, hi + 1)}
    out, i = [], 0
    for line in text.split("\n"):
        if line:
            if i not in gone:
                out.append(line)
            i += 1
        else:
            out.append(line)
    return "\n".join(out)
