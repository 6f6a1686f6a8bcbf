"""N-gram Jaccard join: documents link when the Jaccard similarity of their shingle sets reaches a threshold.

Exact, by a grouped prefix join.  Shingles are 64-bit keys in one global order, frequent ones last (a fixed-size table
of frequent hash buckets, counted over all documents, sets the order; any order gives the same links).  Two sets that
link share a key in their prefixes, which are about as long as the share of keys that may differ.

1. Equal sets are one class; classes of one size and one prefix are one group.
2. Prefix keys that several groups share are kept.  Of the groups of about one size that share a key, the one whose keys are shared
   most stands for it; a group is led by what stands for most of its keys, where these are a fair part of its prefix: for a
   crowd of near copies mostly what they were made from.
3. Groups of one leader form a crowd, expanded to their classes and cut into blocks of bounded size, each with the leader.
   A block compares all its sets at once and emits a spanning forest of its links.  Members that are joined to the leader are joined
   to each other; only the others, in blocks, meet the other blocks of their crowd.
4. Groups of different leaders that share a key are filtered by size and by a small parity sketch, expanded to their
   classes, filtered by a larger one (no filter ever loses a link), and verified one by one.
5. Components of the links are found by contraction, and carried back to documents.

So copies are never expanded into pairs, no link between different texts is lost, and what any task holds is bounded.  Sets are
several times as large as their texts, so texts are moved, and few besides those of classes that a step has to compare.

Documents without words (null and empty ones) link with nothing and are their own components; with fewer words than a
shingle has, the whole sequence is one shingle; long texts are used whole; rows without an id get a null component;
repeated rows fall into one component; an empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.arrowtext import mix, pieces, shingles
from wardline.llm.common import Union, components, lean, likely, merged, runs, staged

WORDS, PERCENT = 5, 80
#: Hash buckets of the table of frequent shingles, the count from which a task reports one, and buckets in a row of what it reports
#: (places in a row are 16 bits).
BUCKETS, OFTEN, PART = 1 << 22, 6, 1 << 16
#: Sets in a block, and keys in all of them, about.
BLOCK, BLOCK_KEYS = 256, 1 << 20
#: Bits of the larger parity sketch at least (a power of two, and no fewer than a set has keys), and of the filter by ids.
BITS, FILTER_BITS = 2048, 1 << 23
#: Share of a group's prefix that its leader's choice has to rest on, in percent.
VOTES = 10


def least_overlap(a: Column, b: Column, percent: int) -> Column:
    return F.ceil(percent * (a + b) / (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n + (-percent * n // 100) + 1


def _frequent(docs: DataFrame, words: int) -> np.ndarray:
    """A class for each hash bucket: the logarithm of its count where some task saw it often, else 0.

    Tasks count all their shingles and report the buckets they saw at least OFTEN times.  The classes only
    order the keys, so what is reported changes the work to be done and never the links.  Reports are added up
    part by part of the table, so the driver gets a byte for each bucket however many tasks report however many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int32)
        for b in batches:
            for p in pieces(b.column(0)):
                if len(p.hashes) >= words:
                    np.add.at(total, (_all_shingles(p, words) & np.uint64(BUCKETS - 1)).astype(np.int32), 1)
        for lo in range(0, BUCKETS, PART):
            n = total[lo : lo + PART]
            at = np.flatnonzero(n >= OFTEN)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([lo], pa.int32()), pa.array([at.astype(np.uint16).tobytes()], pa.binary()), pa.array([n[at].tobytes()], pa.binary())], ["lo", "at", "n"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, np.zeros(PART, np.int64)

        def row() -> pa.RecordBatch:
            c = np.floor(np.log2(np.maximum(total, 1))).clip(0, 40).astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([c.tobytes()], pa.binary())], ["lo", "classes"])

        for b in batches:
            for lo, at, n in zip(b.column("lo").to_pylist(), b.column("at"), b.column("n")):
                if lo != last:
                    if last is not None:
                        yield row()
                    last, total = lo, np.zeros(PART, np.int64)
                total[np.frombuffer(at.as_py(), np.uint16)] += np.frombuffer(n.as_py(), np.int32)
        if last is not None:
            yield row()

    hot = docs.select("text").mapInArrow(lean(run), "lo int, at binary, n binary").repartition("lo").sortWithinPartitions("lo")
    out = np.zeros(-(-BUCKETS // PART) * PART, np.uint8)
    for r in hot.mapInArrow(lean(added), "lo int, classes binary").collect():
        out[r["lo"] : r["lo"] + PART] = np.frombuffer(bytes(r["classes"]), np.uint8)
    return out[:BUCKETS]


def _all_shingles(p, words: int) -> np.ndarray:
    """Shingles of a piece that lie within one document."""
    doc = np.repeat(np.arange(len(p.bounds) - 1), np.diff(p.bounds))
    h = shingles(p.hashes, words)
    return h[doc[: len(h)] == doc[words - 1 :][: len(h)]]


def _sets(p, words: int, classes: np.ndarray) -> Iterator[np.ndarray]:
    """Each document's set as sorted keys: the frequency class on top, the shingle's hash below."""
    long = shingles(p.hashes, words) if len(p.hashes) >= words else np.zeros(0, np.uint64)
    key = lambda h: (classes[(h & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (h >> np.uint64(6))
    keys = key(long)
    for lo, hi in zip(p.bounds[:-1].tolist(), p.bounds[1:].tolist()):
        if hi - lo >= words:
            yield np.unique(keys[lo : hi - words + 1])
        else:
            yield key(shingles(p.hashes[lo:hi], words))


def _plain_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Each text's set of shingle hashes, sorted."""
    return [np.unique(shingles(p.hashes[lo:hi], words)) for p in pieces(texts) for lo, hi in zip(p.bounds[:-1].tolist(), p.bounds[1:].tolist())]


def _summaries(docs: DataFrame, words: int, percent: int, shared) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n", "s1", "s2", "k1", "k2", "ph", "prefix", "big"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = shared.value
        for b in batches:
            n, s1, s2, k1, k2, ph, prefix, big = [], [], [], [], [], [], [], []
            for p in pieces(b.column("text")):
                for s in _sets(p, words, classes):
                    n.append(len(s))
                    s1.append(int(mix(s).sum(dtype=np.uint64)))
                    s2.append(int(mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)))
                    bits = np.packbits(np.bincount((s & np.uint64(127)).astype(np.int64), minlength=128).astype(np.uint8) & 1).view(np.uint64)
                    k1.append(int(bits[0]))
                    k2.append(int(bits[1]))
                    head = s[: prefix_length(len(s), percent)] if len(s) else s
                    ph.append(int((mix(head) * (np.arange(len(head), dtype=np.uint64) * np.uint64(2) + np.uint64(1))).sum(dtype=np.uint64)))
                    prefix.append(head.tobytes())
                    big.append(_sketch(s))
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (s1, s2, k1, k2, ph)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), *longs, pa.array(prefix, pa.binary()), pa.array(big, pa.binary())], names)

    return staged(docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, n bigint, s1 bigint, s2 bigint, k1 bigint, k2 bigint, ph bigint, prefix binary, big binary"))


def _tokens(groups: DataFrame) -> DataFrame:
    """(token, gid) of every prefix key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads = [np.frombuffer(x, np.int64) for x in b.column("prefix").to_pylist()]
            if heads:
                at = np.repeat(np.arange(len(heads)), [len(h) for h in heads])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(heads)), b.column("gid").take(pa.array(at))], ["token", "gid"])

    return groups.select("gid", "prefix").mapInArrow(lean(run), f"token bigint, gid {groups.schema['gid'].dataType.simpleString()}")


def _links_within(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among a block's sets, from all their intersections at once."""
    n = np.array([len(s) for s in sets], np.int64)
    keys = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(keys, kind="stable")
    keys, doc = keys[order], doc[order]
    fresh = np.r_[True, keys[1:] != keys[:-1]]
    column = np.cumsum(fresh) - 1
    common = np.bincount(column)[column] > 1
    doc, column = doc[common], column[common]
    both = np.zeros((len(sets), len(sets)), np.float32)
    if len(column):
        column = np.cumsum(np.r_[True, column[1:] != column[:-1]]) - 1
        for lo in range(0, int(column[-1]) + 1, 4096):
            a, z = np.searchsorted(column, [lo, lo + 4096])
            m = np.zeros((len(sets), 4096), np.float32)
            m[doc[a:z], column[a:z] - lo] = 1
            both += m @ m.T
    i, j = np.nonzero(np.triu(100 * both >= percent * (n[:, None] + n[None, :] - both), 1))
    forest, out = Union(len(sets)), []
    for x, y in zip(i.tolist(), j.tolist()):
        if forest.join(x, y):
            out.append((x, y))
    return out


def _sketch(s: np.ndarray) -> bytes:
    """For each of a power of two of buckets, whether it holds an odd number of keys."""
    bits = max(BITS, 1 << max(0, len(s) - 1).bit_length())
    return np.packbits(np.bincount(((s >> np.uint64(7)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def _apart(p: bytes, q: bytes) -> int:
    """Buckets that differ, at least so many keys are in one set only; the longer sketch is folded to the shorter's length."""
    x, y = np.frombuffer(p, np.uint8), np.frombuffer(q, np.uint8)
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int.from_bytes((x ^ y).tobytes(), "big").bit_count()


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _likely(rows: DataFrame, need: DataFrame) -> DataFrame:
    return likely(rows, need, "cid", FILTER_BITS)


def links(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents' summaries, classes, links (a, b) between class representatives that span all components)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(_frequent(docs, words))
    docs = docs.select("doc_id", "text")
    every = _summaries(docs, words, percent, shared)
    kind = every.schema["doc_id"].dataType.simpleString()
    full = every.where("n > 0 and doc_id is not null")
    # equal sets have equal sketches and prefixes, so any of a class will do
    classes = staged(full.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("cid"), F.min("ph").alias("ph")))
    groups = full.groupBy("n", "ph").agg(F.min("doc_id").alias("gid"), F.first("prefix").alias("prefix"), F.bit_and("k1").alias("a1"), F.bit_and("k2").alias("a2"), F.bit_or("k1").alias("o1"), F.bit_or("k2").alias("o2"))
    # bits on which a group's members differ say nothing about it; on the others all members agree
    groups = staged(groups.select("gid", "n", "ph", "prefix", "a1", "a2", F.col("a1").bitwiseXOR(F.col("o1")).alias("v1"), F.col("a2").bitwiseXOR(F.col("o2")).alias("v2")))
    info = groups.select("gid", "n", "a1", "a2", "v1", "v2")
    held = F.count("*").over(Window.partitionBy("token"))
    tokens = staged(_tokens(groups).withColumn("held", held).where("held > 1"))

    def apart(x: str, y: str) -> Column:
        """At least so many keys are in one set only, for any members of two groups."""
        diff = lambda k: F.bit_count(F.col(f"{x}.a{k}").bitwiseXOR(F.col(f"{y}.a{k}")).bitwiseAND(F.bitwise_not(F.col(f"{x}.v{k}"))).bitwiseAND(F.bitwise_not(F.col(f"{y}.v{k}"))))
        return diff(1) + diff(2)

    score = tokens.groupBy("gid").agg(F.round(F.sum(F.log("held")), 6).alias("score"))
    # sizes of one band differ by no more than links allow
    band = F.floor(F.log(F.col("n").cast("double")) / np.log(100 / percent)).cast("int").alias("band")
    rated = staged(tokens.select("token", "gid").join(merged(score.join(merged(info.select("gid", band)), "gid")), "gid"))
    lead = rated.groupBy("token", "band").agg(F.max(F.struct(F.col("score"), F.col("gid").alias("lead"))).alias("lead"))
    led = rated.select("token", "band", "gid").join(merged(lead), ["token", "band"]).select("gid", "lead.*").repartition("gid").groupBy("gid", "lead").agg(F.count("*").alias("votes"), F.max("score").alias("score"))
    led = led.groupBy("gid").agg(F.max(F.struct("votes", "score", "lead")).alias("led")).select("gid", "led.votes", "led.lead")
    g, h = info.alias("g"), info.select(F.col("gid").alias("lead"), "n", "a1", "a2", "v1", "v2").alias("h")
    near = (apart("g", "h") <= 2 * (F.col("g.n") + F.col("h.n") - 2 * least_overlap(F.col("g.n"), F.col("h.n"), percent))) & (10000 * F.least("g.n", "h.n") >= percent * percent * F.greatest("g.n", "h.n")) & (F.col("votes") * 10000 >= VOTES * (100 - percent) * F.col("g.n"))
    led = g.join(merged(led), "gid").join(merged(h), "lead").select("gid", F.when(near, F.col("lead")).otherwise(F.col("gid")).alias("lead"))
    led = staged(info.join(merged(led), "gid", "left").select("gid", "n", "a1", "a2", "v1", "v2", F.coalesce("lead", "gid").alias("lead")))
    members = staged(classes.select("cid", "n", "ph").join(merged(groups.select("n", "ph", "gid")), ["n", "ph"]).join(merged(led.select("gid", "lead")), "gid").select("cid", "n", "gid", "lead"))

    # crowds, in blocks
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_KEYS)).cast("int").alias("blocks")
    sizes = staged(members.groupBy("lead").agg(F.count("*").alias("size"), blocks).where("size > 1").select("lead", "blocks"))
    crowd = staged(members.where("cid <> lead").join(merged(sizes), "lead").select("lead", "cid", "n", "blocks", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int").alias("own")))
    # pairs of groups with different leaders
    side = staged(tokens.select("token", "gid").join(merged(led), "gid"))
    # what all groups of a crowd under one key agree on, and the range of their sizes
    same = [F.bit_and(f"a{k}").alias(f"a{k}") for k in (1, 2)] + [F.bit_or(F.col(f"v{k}")).bitwiseOR(F.bit_and(f"a{k}").bitwiseXOR(F.bit_or(f"a{k}"))).alias(f"v{k}") for k in (1, 2)]
    held = staged(side.groupBy("token", "lead").agg(F.count("*").alias("size"), F.min("n").alias("lo"), F.max("n").alias("hi"), *same))
    fits = (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")) & (apart("x", "y") <= F.col("x.n") + F.col("y.n") - 2 * least_overlap(F.col("x.n"), F.col("y.n"), percent))

    def may_fit(x: str, lo: str, hi: str, y: str) -> Column:
        """Could something of sizes lo..hi and what y agrees on fit a group of y?  True wherever a pair fits."""
        return (100 * F.col(hi) >= percent * F.col(f"{y}.lo")) & (100 * F.col(f"{y}.hi") >= percent * F.col(lo)) & (apart(x, y) * (100 + percent) <= (F.col(hi) + F.col(f"{y}.hi")) * (100 - percent))

    # a crowd under one key meets what has other leaders, and never itself; groups that stand alone there meet one another
    alone = side.join(merged(held.where("size = 1").select("token", "lead")), ["token", "lead"])
    x, y = alone.alias("x"), alone.alias("y")
    one = x.join(merged(y), (F.col("x.token") == F.col("y.token")) & (F.col("x.gid") < F.col("y.gid")) & fits).select(F.col("x.gid").alias("ga"), F.col("y.gid").alias("gb"))
    u, v = held.where("size > 1").alias("u"), held.alias("v")
    meet = u.join(merged(v), (F.col("u.token") == F.col("v.token")) & (F.col("u.lead") != F.col("v.lead")) & ((F.col("v.size") == 1) | (F.col("u.lead") < F.col("v.lead"))) & may_fit("u", "u.lo", "u.hi", "v"))
    meet = meet.select("u.token", F.col("u.lead").alias("u"), F.col("v.lead").alias("v"), "v.lo", "v.hi", "v.a1", "v.a2", "v.v1", "v.v2")
    x, y = side.alias("x"), side.alias("y")
    # only those groups of the crowd go on that may fit the other side
    two = x.join(merged(meet.alias("m")), (F.col("x.token") == F.col("m.token")) & (F.col("x.lead") == F.col("m.u")) & may_fit("x", "x.n", "x.n", "m"))
    two = two.join(merged(y), (F.col("m.token") == F.col("y.token")) & (F.col("m.v") == F.col("y.lead")) & fits).select(F.least("x.gid", "y.gid").alias("ga"), F.greatest("x.gid", "y.gid").alias("gb"))
    pairs = staged(one.unionByName(two).distinct())
    ma, mb = members.select(F.col("gid").alias("ga"), F.col("cid").alias("a")), members.select(F.col("gid").alias("gb"), F.col("cid").alias("b"))
    pairs = staged(pairs.join(merged(ma), "ga").join(merged(mb), "gb").select("a", "b"))
    # the larger sketches of the classes in pairs only
    told = staged(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct())
    sketch = staged(_likely(full.select(F.col("doc_id").alias("cid"), "n", "big"), told).join(merged(told), "cid", "left_semi").dropDuplicates(["cid"]))
    pairs = pairs.join(merged(sketch.toDF("a", "na", "p")), "a").join(merged(sketch.toDF("b", "nb", "q")), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            total = np.asarray(t.column("na")) + np.asarray(t.column("nb"))
            most = total + 2 * (-percent * total // (100 + percent))
            apart = [_apart(p, q) for p, q in zip(t.column("p").to_pylist(), t.column("q").to_pylist())]
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b")], ["a", "b"]).filter(pa.array(np.array(apart, np.int64) <= most))

    pairs = staged(pairs.select("a", "b", "na", "nb", "p", "q").mapInArrow(lean(close), f"a {kind}, b {kind}"))

    # the texts of all classes that take part
    need = staged(crowd.select("cid").union(sizes.select("lead")).union(pairs.select("a")).union(pairs.select("b")).distinct())
    texts = staged(_likely(docs.select(F.col("doc_id").alias("cid"), "text"), need))

    def linked_blocks(rows: DataFrame) -> DataFrame:
        """rows (lead, i, j, cid), a block each (lead, i, j), as (lead, a, b): links that span it; and (lead, a, null) for what they leave apart from the leader."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in runs(batches, ["lead", "i", "j"]):
                ids = t.column("cid").to_pylist()
                if len(set(ids)) < len(ids):  # repeated rows
                    t = t.take(pa.array(sorted({x: k for k, x in enumerate(ids)}.values())))
                    ids = t.column("cid").to_pylist()
                cid, lead = t.column("cid").combine_chunks(), t.column("lead")[0].as_py()
                forest = Union(len(ids))
                got = _links_within(_plain_sets(t.column("text"), words), percent)
                for x, y in got:
                    forest.join(x, y)
                root = forest.find(ids.index(lead)) if lead in ids else -1
                left = [k for k in range(len(ids)) if forest.find(k) != root]
                b = [y for _, y in got] + [None] * len(left)
                yield pa.RecordBatch.from_arrays([t.column("lead").combine_chunks().take(pa.array([0] * len(b), pa.int64())), cid.take(pa.array([x for x, _ in got] + left, pa.int64())), cid.take(pa.array(b, pa.int64()))], ["lead", "a", "b"])

        rows = staged(rows)
        spread = rows.join(merged(_likely(texts, rows)), "cid").repartition("lead", "i", "j").sortWithinPartitions("lead", "i", "j").select("lead", "i", "j", "cid", "text")
        return spread.mapInArrow(lean(run), f"lead {kind}, a {kind}, b {kind}")

    each_block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    heads = sizes.select("lead", F.lit(0).alias("i"), each_block.alias("j"), F.col("lead").alias("cid"))
    within = staged(linked_blocks(crowd.select("lead", F.lit(0).alias("i"), F.col("own").alias("j"), "cid").unionByName(heads)))
    # what no block joined to its leader meets all blocks of its crowd
    left = within.where("b is null").select("lead", F.col("a").alias("cid")).join(merged(crowd.where("blocks > 1")), ["lead", "cid"])
    parts = left.groupBy("lead").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_KEYS)).cast("int").alias("parts"))
    parts = staged(parts)
    # a row for each crowd of several blocks, far fewer than documents
    mine = left.join(parts, "lead").select("lead", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("parts")).cast("int").alias("i"), each_block.alias("j"), "cid")
    others = crowd.join(parts, "lead").select("lead", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.col("own").alias("j"), "cid")
    across = linked_blocks(mine.unionByName(others).distinct()).where("b is not null")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ok = [_linked(p, q, percent) for p, q in zip(_plain_sets(t.column("p"), words), _plain_sets(t.column("q"), words))]
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    paired = staged(_likely(texts, pairs.select(F.col("a").alias("cid")).union(pairs.select("b"))))
    checked = pairs.join(merged(paired.select(F.col("cid").alias("a"), F.col("text").alias("p"))), "a").join(merged(paired.select(F.col("cid").alias("b"), F.col("text").alias("q"))), "b")
    checked = checked.select("a", "b", "p", "q").mapInArrow(lean(verify), f"a {kind}, b {kind}")
    spanning = within.where("b is not null").select("a", "b").unionByName(across.select("a", "b")).unionByName(checked)
    return every, classes.select("s1", "s2", "n", "cid"), staged(spanning)


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row."""
    every, classes, found = links(docs, words, percent)
    named = components(found).withColumnRenamed("node", "cid")
    classes = classes.join(merged(named), "cid", "left").select("s1", "s2", F.col("n").alias("n_shingles"), F.coalesce("component", "cid").alias("_c"))
    rows = every.select("doc_id", F.col("n").alias("n_shingles"), "s1", "s2")
    out = rows.join(merged(classes), ["s1", "s2", "n_shingles"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("_c")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs without those that have a smaller id in their component; rows without an id are kept."""
    drop = staged(join(docs, words, percent).where("component_id <> doc_id").select("doc_id").distinct())
    maybe = likely(docs, drop, "doc_id", FILTER_BITS)
    return likely(docs, drop, "doc_id", FILTER_BITS, others=True).unionByName(maybe.join(merged(drop), "doc_id", "left_anti").select(docs.columns))
