"""PII: fixed base patterns, and bootstrapped contextual extraction of further identifiers.

Base spans (email, ip, card, phone) are the seeds.  Mentions are seeds and other tokens that hold a digit; what stands
before a mention (one and two words) are its lexical patterns.  Spark scores the graph of patterns and instances: a
pattern's confidence is the score of its distinct instances over all places where its words occur in the corpus, an
instance's score is the noisy-or of its confident patterns, and after a few rounds the mentions of instances above a
bound become spans of kind ``id``.  A pattern needs several distinct instances, so that clean texts stay clean.

Null and empty texts have no spans; texts are scanned whole; repeated rows give the same spans; an empty table
gives an empty result.  Extra columns of the input are ignored.  Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.arrowtext import pieces, run_hash
from wardline.llm.common import lean, staged

KINDS = ("email", "ip", "card", "phone")
#: Distinct instances that a pattern needs, its least confidence, the least score of an instance, and rounds.
SUPPORT, CONFIDENT, ACCEPT, ROUNDS = 5, 0.5, 0.75, 3
#: Bits of the table of phrases to count; a place stands for few phrases, so that little else is counted.
BUCKETS = 1 << 24
#: Places, and different phrases, that a task counts before it sums or reports them.
HELD = 1 << 20

_domain = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+").match
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ip = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)").finditer
_card = re.compile(r"[0-9]([ -]?[0-9])+").finditer
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").finditer
_digit = re.compile("[0-9]").search
_nondigit = re.compile("[^0-9]").sub
_token = re.compile(r"\S+").finditer
_bare = re.compile(r"^\W+|\W+$").sub


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind, then by start."""
    out: list[tuple[str, int, int]] = []
    at, end = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > end and text[lo - 1] in _local:
            lo -= 1
        if lo < at and (m := _domain(text, at + 1)):
            end = m.end()
            out.append(("email", lo, end))
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)
    if _digit(text):
        for m in _ip(text):
            if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m.group().split(".")):
                out.append(("ip", *m.span()))
        for m in _card(text):
            d = _nondigit("", m.group())
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        for m in _phone(text):
            if 9 <= len(_nondigit("", m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


def _hash(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def mentions(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, str, str, int]]:
    """(kind, start, end, word before, the one before that, instance) of seeds and of other tokens with a digit."""
    marks = sorted((s, e, k) for k, s, e in spans)
    i, before, two = 0, "", ""
    for m in _token(text):
        s, e = m.span()
        while i < len(marks) and marks[i][1] <= s:
            i += 1
        if i < len(marks) and marks[i][0] < e:
            j = i
            while j < len(marks) and marks[j][0] < e:
                lo, hi, kind = marks[j]
                if lo >= s:
                    yield kind, lo, hi, before, two, _hash(text[lo:hi])
                j += 1
        elif _digit(m.group()):
            w = m.group()
            lo, hi = s + len(w) - len(re.sub(r"^\W+", "", w)), s + len(re.sub(r"\W+$", "", w))
            if hi - lo >= 4:
                yield "", lo, hi, before, two, _hash(text[lo:hi])
        two, before = before, m.group().lower()


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, base_sha256, mentions) for every row, staged."""
    m = "array<struct<kind:string,lo:bigint,hi:bigint,before:string,two:string,instance:bigint>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("lo", pa.int64()), ("hi", pa.int64()), ("before", pa.string()), ("two", pa.string()), ("instance", pa.int64())]))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, base_sha256 string, mentions {m}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, texts, found = [], [], []
            for t in b.column("text"):
                s = t.as_py() or ""
                spans = base(s)
                c = Counter(k for k, _, _ in spans)
                counts.append([c[k] for k in KINDS])
                texts.append(",".join(f"{k}:{lo}:{hi}" for k, lo, hi in spans))
                found.append([dict(zip(("kind", "lo", "hi", "before", "two", "instance"), x)) for x in mentions(s, spans)] if spans or _digit(s) else [])
            n = np.array(counts, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(n[:, i]) for i in range(4)), pa.array(texts, pa.string()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts]), pa.array(found, kind)],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "base_sha256", "mentions"],
            )

    return staged(docs.select("doc_id", "text").mapInArrow(lean(run), schema))


def _occurrences(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """(words, n): how often each of the phrases of one or two words stands anywhere in the corpus.

    A bit for each of a fixed number of hash buckets tells tasks which phrases to count; a task reports each of them
    once, so that no more rows are made than tasks meet phrases; the join then is exact.
    """
    spark = docs.sparkSession

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(0)
            h = np.zeros(len(col), np.uint64)
            for p in pieces(col):
                n = np.diff(p.bounds)
                two = run_hash(p.hashes, 2)
                own = h[p.first : p.last]
                own[n == 1] = p.hashes[p.bounds[:-1][n == 1]]
                own[n == 2] = two[p.bounds[:-1][n == 2]]
            yield pa.RecordBatch.from_arrays([col, pa.array(h.view(np.int64))], ["words", "h"])

    named = staged(phrases.select("words").mapInArrow(lean(hashed), "words string, h bigint"))
    spot = F.pmod("h", F.lit(BUCKETS))
    maps = named.select((spot + 1).alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits")).collect()
    bits = np.zeros(BUCKETS // 8, np.uint8)
    for r in maps:  # numbers and parts count from 1; a part holds 4096 bytes
        bits[(r["part"] - 1) * 4096 : r["part"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    shared = spark.sparkContext.broadcast(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on, keys, total = shared.value, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            if not held:
                return keys, total
            h, at = np.unique(np.concatenate([keys, *held]), return_inverse=True)
            return h, np.bincount(at, np.r_[total, np.ones(sum(map(len, held)), np.int64)], len(h)).astype(np.int64)

        for b in batches:
            for p in pieces(b.column(0), size=1 << 21):
                two = run_hash(p.hashes, 2)
                inner = p.bounds[1:-1]
                apart = np.ones(len(two), bool)
                apart[inner[(inner > 0) & (inner <= len(two))] - 1] = False  # the words of two documents
                both = np.r_[p.hashes, two[apart]]
                at = (both & np.uint64(BUCKETS - 1)).astype(np.int64)
                held.append(both[((on[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)])
                if sum(map(len, held)) > HELD:
                    (keys, total), held = merged(), []
                if len(keys) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(total)], ["h", "n"])
                    keys, total = keys[:0], total[:0]
        keys, total = merged()
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(total)], ["h", "n"])

    counted = docs.select("text").mapInArrow(lean(count), "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    return named.join(counted, "h").select("words", "n")


def discover(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """(doc_id, lo, hi) of the mentions that the patterns accept."""
    rows = scanned.select("doc_id", F.explode("mentions").alias("m")).select("doc_id", "m.*")
    patterns = F.array(F.col("before"), F.when(F.col("two") != "", F.concat_ws(" ", "two", "before")))
    links = rows.where("before <> ''").select("kind", "instance", F.explode(patterns).alias("pattern")).where("pattern is not null").groupBy("pattern", "instance").agg((F.max("kind") != "").alias("seed"), F.count("*").alias("n"))
    strong = staged(links.groupBy("pattern").agg(F.count("*").alias("instances"), F.sum("n").alias("places")).where(F.col("instances") >= SUPPORT))
    # places of the words that are not before a mention stand against a pattern
    totals = _occurrences(docs, strong.select(F.col("pattern").alias("words")))
    strong = staged(strong.join(totals, strong["pattern"] == totals["words"], "left").select("pattern", F.greatest("n", "places").cast("double").alias("total")))
    links = staged(links.join(strong, "pattern").select("pattern", "instance", "seed", (F.col("n") / F.col("total")).alias("weight")))
    scores = links.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("score"), F.max("seed").alias("seed"))
    for _ in range(ROUNDS):
        sure = links.select("pattern", "instance", "weight").join(scores, "instance").groupBy("pattern").agg(F.sum(F.col("weight") * F.col("score")).alias("confidence"), F.count(F.when(F.col("score") >= ACCEPT, 1)).alias("support"))
        sure = sure.where((F.col("confidence") >= CONFIDENT) & (F.col("support") >= SUPPORT))
        heard = links.select("pattern", "instance").join(sure, "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.99)))))).alias("heard"))
        scores = staged(scores.join(heard, "instance", "left").select("instance", "seed", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("heard", F.lit(0.0))).alias("score")))
    good = scores.where(~F.col("seed") & (F.col("score") >= ACCEPT)).select("instance")
    return rows.where("kind = ''").join(good, "instance", "left_semi").select("doc_id", "lo", "hi").distinct()


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row."""
    scanned = scan(docs)
    more = discover(docs, scanned).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("ids"))
    more = more.select("doc_id", F.array_join(F.transform("ids", lambda x: F.concat_ws(":", F.lit("id"), x["lo"].cast("string"), x["hi"].cast("string"))), ",").alias("ids"))
    out = scanned.drop("mentions").join(more, "doc_id", "left")
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), "ids").alias("spans"))
