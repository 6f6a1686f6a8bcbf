"""Quality classifier: compression with zstandard dictionaries built from good and from bad labelled text.

Texts are cut into blocks, however long they are, and every block is compressed against either dictionary.  Half of all labelled
texts train the dictionaries with all their blocks: in chunks of bounded size, a dictionary each, and what these hold is trained on
again until one is left; where blocks are too few to train on, they are the dictionary.  Features of a text are the
compressed-size difference over the sum of both sizes, both sizes over the text's length, and the largest and
smallest difference of a block (junk may fill only a part).  A logistic calibration over the other half of the labelled rows turns them into a score.

Null and empty texts have the features of nothing and so get a defined score between 0 and 1; repeated rows score
alike; an empty table gives an empty result; without labels of both classes the score is the share of good labels (0.5 without any).  Extra columns of
the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm.common import lean, staged
from wardline.llm.labelled import Logistic, held_out, labelled, prior_weights

BLOCK = 2048
#: Bytes of text that one dictionary is trained on at a time, about.
CHUNK = 8 << 20
DICTIONARY = 96 << 10
THRESHOLD = 0.7


@dataclass
class Model:
    good: bytes
    bad: bytes
    raw: bool
    calibration: Logistic | None
    share: float


def blocks(text: bytes) -> list[bytes]:
    n = max(1, round(len(text) / BLOCK))
    step = -(-len(text) // n) if text else 0
    return [text[i * step : (i + 1) * step] for i in range(n)]


def dictionary(samples: list[bytes]) -> tuple[bytes, bool]:
    """A dictionary trained on all samples, or where there is too little to train on, the samples themselves as raw content."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, level=3, split_point=1.0).as_bytes(), False
    except zstandard.ZstdError:
        return b"".join(samples), True


def compressors(model: Model) -> list[zstandard.ZstdCompressor]:
    kind = zstandard.DICT_TYPE_RAWCONTENT if model.raw else zstandard.DICT_TYPE_FULLDICT
    return [
        zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(d, dict_type=kind), write_content_size=False, write_checksum=False, write_dict_id=False)
        for d in (model.good, model.bad)
    ]


def features(text: bytes, pair: list[zstandard.ZstdCompressor]) -> tuple[float, ...]:
    parts = blocks(text)
    g = [len(pair[0].compress(x)) for x in parts]
    b = [len(pair[1].compress(x)) for x in parts]
    each = [(y - x) / (x + y) for x, y in zip(g, b)]
    n = len(text) + 16
    return (sum(b) - sum(g)) / (sum(b) + sum(g)), sum(g) / n, sum(b) / n, max(each), min(each)


def _features(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    schema = T.StructType([*(docs.schema[k] for k in keep), T.StructField("x", T.ArrayType(T.DoubleType()))])
    shared = docs.sparkSession.sparkContext.broadcast((model.good, model.bad, model.raw))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = compressors(Model(*shared.value, None, 0.5))
        for b in batches:
            x = pa.array([features((t.as_py() or "").encode(), pair) for t in b.column("text")], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), x], schema.names)

    return docs.select(*keep, "text").mapInArrow(lean(run), schema)


def _dictionaries(rows: DataFrame) -> dict[int, tuple[bytes, bool]]:
    """For each class of rows (doc_id, text, y) a dictionary of all its texts, and whether it is raw content."""
    schema = "y int, chunk int, data binary, raw boolean"

    def train(t: pa.Table) -> pa.Table:
        t = t.sort_by("place")
        data, raw = dictionary([x for d in t.column("data").to_pylist() for x in blocks(d)])
        return pa.table({"y": t.column("y")[:1], "chunk": t.column("chunk")[:1], "data": pa.array([data], pa.binary()), "raw": pa.array([raw])})

    parts, before = rows.select("y", F.xxhash64("doc_id").alias("place"), F.encode("text", "utf-8").alias("data")), None
    while True:
        sizes = {r["y"]: r["n"] for r in parts.groupBy("y").agg(F.sum(F.octet_length("data")).alias("n")).collect()}
        chunks = {y: max(1, -(-n // CHUNK)) for y, n in sizes.items()}
        if chunks == before:  # no smaller any more, as nothing could be trained
            chunks = dict.fromkeys(sizes, 1)
        before = chunks
        own = F.coalesce(*(F.when(F.col("y") == y, F.pmod("place", F.lit(n))) for y, n in chunks.items()), F.lit(0)).cast("int")
        found = staged(parts.withColumn("chunk", own).groupBy("y", "chunk").applyInArrow(train, schema))
        if all(n == 1 for n in chunks.values()):
            return {r["y"]: (bytes(r["data"]), r["raw"]) for r in found.collect()}
        parts = found.select("y", F.col("chunk").cast("bigint").alias("place"), "data")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Learns from all labelled rows but held-out ones; what reaches the driver is of fixed size."""
    rows, counts = labelled(docs, labels, label)
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    rows = rows.withColumn("_half", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)))
    got = _dictionaries(rows.where("_half = 0"))
    if len(got) < 2:
        return Model(b"", b"", True, None, share)
    (good, raw_g), (bad, raw_b) = got[1], got[0]
    model = Model(good, bad, raw_g or raw_b, None, share)  # both of one kind: any bytes can be raw content
    seen = staged(_features(rows.where("_half = 1"), model, "y"))
    have = {r["y"]: r["n"] for r in seen.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(have) == 2:
        y = np.repeat([0, 1], [have[0], have[1]])
        weight = prior_weights(y, counts)
        model.calibration = Logistic.of_table(seen, 5, {0: float(weight[0]), 1: float(weight[-1])})
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        pair = compressors(m) if m.calibration else None
        for b in batches:
            if pair and b.num_rows:
                s = m.calibration.predict(np.array([features((t.as_py() or "").encode(), pair) for t in b.column("text")]))
            else:
                s = np.full(b.num_rows, m.share)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], schema.names)

    found = docs.select("doc_id", "text").mapInArrow(lean(run), schema)
    return found.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score at least the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        pair = compressors(m) if m.calibration else None
        for b in batches:
            if pair and b.num_rows:
                s = m.calibration.predict(np.array([features((t.as_py() or "").encode(), pair) for t in b.column("text")]))
                b = b.filter(pa.array(s >= threshold))
            elif m.share < threshold:
                b = b.slice(0, 0)
            yield b

    return docs.mapInArrow(lean(run), docs.schema)
