"""Toxicity: noisy-channel deobfuscation, then scoring of the restored words.

A character language model (trigrams over all words of all documents, counted by Spark) and a channel model (leet
signs, spacing, marks between letters, repeated letters) give every odd-looking word a lattice of readings; Viterbi
decoding finds the best one, for words and runs of any length: what all survivors agree on is put out on the way.  Words that
are plain letters without repeats are their own reading.  The restored words are scored by the beginnings (and the
whole) of words that labelled toxic documents hold far more often than others, and letters that stand apart, which show no
borders of words, by those at every place; a logistic calibration over the labelled sample turns what a document holds into a score.

Null and empty texts score as texts without any such word; repeated rows score alike; without labels of both classes
the score is the share of toxic labels.  Extra columns of the input are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm.common import lean
from wardline.llm.labelled import Logistic, held_out, prior_weights, sample

PER_CLASS = 4000
THRESHOLD = 0.3
LETTERS = "abcdefghijklmnopqrstuvwxyzàâäáãåæçèéêëìíîïñòóôöõøùúûüýÿßœ"
#: Readings of the signs that stand for letters; fixed values.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y"}
#: Marks that may be put between the letters of a word.
MARKS = ".-_*~'`^/\\,:;#%&="
#: Signs around words that are no letters of them.
OPENING, CLOSING = "\"'([{", ".,;:?\"')]}"
SHORTEST, LONGEST = 4, 9
#: Signs between two looks for what all survivors of a decoding begin with.
PREFIX = 64

_index = {c: i + 1 for i, c in enumerate(LETTERS)}
_plain = re.compile(rf"[{LETTERS}]+$").match
_edges = re.compile(rf"^[^{LETTERS}]+|[^{LETTERS}]+$").sub
_triple = re.compile(r"(.)\1\1").search
_double = re.compile(r"(.)\1").search
_single = re.compile(r"(.)\1+").sub
_apart = re.compile(rf"(?<!\S)(?:[^\W_]|[{re.escape(''.join(c for c in LEET if not c.isalnum()))}])(?:[ ._\-*](?:[^\W_]|[{re.escape(''.join(c for c in LEET if not c.isalnum()))}])){{3,}}(?!\S)")
_apart_likely = re.compile(r"[^\W_] [^\W_] [^\W_] ").search
_between = re.compile(r"[ ._\-*]").sub
SIDE = 64


class CharModel:
    """log P(c | a b) with add-one-tenth smoothing over the alphabet; 0 is the border of a word."""

    def __init__(self, counts: np.ndarray):
        n = counts.reshape(SIDE, SIDE, SIDE).astype(float) + 0.1
        two = n.sum(0, keepdims=True)
        p3, p2 = n / n.sum(2, keepdims=True), two / two.sum(2, keepdims=True)
        self.log = np.log(0.8 * p3 + 0.2 * p2)

    def word(self, w: str) -> float:
        a = b = 0
        total = 0.0
        for c in [*map(_index.get, w), 0]:
            total += self.log[a, b, c or 0]
            a, b = b, c or 0
        return total


def char_counts(docs: DataFrame) -> np.ndarray:
    """Counts of letter triples over all texts: summed within tasks, then by Spark; the result's size is fixed."""
    table = np.zeros(0x110000, np.uint8)
    for c, i in _index.items():
        table[ord(c)] = i

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIDE**3, np.int64)
        for batch in batches:
            s = "  ".join(["", *(t for t in batch.column(0).to_pylist() if t), ""]).lower()
            for lo in range(2, len(s), 1 << 20):  # whole texts, in pieces that overlap by two signs
                x = table[np.frombuffer(s[lo - 2 : lo + (1 << 20)].encode("utf-32-le", "replace"), np.uint32)].astype(np.int32)
                code = x[:-2] * (SIDE * SIDE) + x[1:-1] * SIDE + x[2:]
                keep = np.where(x[1:-1] == 0, x[2:], code)  # after a border nothing before it counts
                total += np.bincount(keep, minlength=SIDE**3)
        total[0] = 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["code", "n"])

    rows = docs.select("text").mapInArrow(lean(run), "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SIDE**3, np.int64)
    out[rows["code"].to_numpy(int)] = rows["n"].to_numpy(int)
    return out


@dataclass
class Model:
    chars: CharModel | None
    weights: dict[str, float] = field(default_factory=dict)
    calibration: Logistic | None = None
    share: float = 0.5


class Decoder:
    """Readings of words under the channel and the character model."""

    def __init__(self, chars: CharModel):
        self.chars = chars
        self.log = chars.log.ravel().tolist() if chars else []

    def lattice(self, w: str) -> Iterator[list[tuple[str, float]]]:
        """For each sign its readings with log probabilities; the empty reading drops a mark or a repeat."""
        for i, c in enumerate(w):
            ways: list[tuple[str, float]] = []
            if c in _index:
                ways.append((c, -0.02))
                if i and w[i - 1] == c:
                    ways.append(("", -1.0 if (i > 1 and w[i - 2] == c) or (i + 1 < len(w) and w[i + 1] == c) else -4.0))
            elif c in LEET:
                ways += [(x, -0.7) for x in LEET[c]]
                if i and w[i - 1] == c:
                    ways.append(("", -1.0))
            elif c in MARKS:
                ways.append(("", -0.5))
            else:
                ways.append(("", -2.0))
            yield ways

    def read(self, w: str) -> str:
        """Viterbi over states of the last two letters; every PREFIX signs, what all survivors begin with is put out."""
        log, out = self.log, []
        best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        for n, ways in enumerate(self.lattice(w), 1):
            nxt: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (score, text) in best.items():
                for c, cost in ways:
                    if c:
                        i = _index[c]
                        key, value = (b, i), score + cost + log[(a * SIDE + b) * SIDE + i]
                    else:
                        key, value = (a, b), score + cost
                    if key not in nxt or value > nxt[key][0]:
                        nxt[key] = (value, text + c)
            best = nxt
            if not n % PREFIX and (k := len(commonprefix([t for _, t in best.values()]))):
                out.append(next(iter(best.values()))[1][:k])
                best = {key: (s, t[k:]) for key, (s, t) in best.items()}
        return "".join(out) + max(((s + log[(a * SIDE + b) * SIDE], t) for (a, b), (s, t) in best.items()))[1]

    def readings(self, raw: str) -> list[str]:
        """What a word without white space may say: with the marks at its edges taken off, or as signs for letters."""
        w = _edges("", raw)
        out = [w] if w else []
        core = raw.rstrip(CLOSING).lstrip(OPENING)
        if w and _plain(w) and (core == w or not any(c in LEET for c in core.replace(w, "", 1))):
            if not _double(w):
                return out
            if not _triple(w):
                return [w, self.read(w)]
        if len(raw) >= 3:
            out += map(self.read, dict.fromkeys(x for x in (raw, w, core, core.strip("!")) if x))
        return list(dict.fromkeys(out))


def starts(w: str) -> list[str]:
    """Beginnings of a word and the word itself, as features."""
    w = w.lower()
    return [w[:n] for n in range(SHORTEST, min(len(w), LONGEST) + 1)] + ([w + "$"] if 3 <= len(w) else [])


class Scorer:
    CACHE = 200_000

    def __init__(self, model: Model):
        self.model, self.decoder, self.known = model, Decoder(model.chars), {}
        self.lengths = sorted({len(f.rstrip("$")) for f in model.weights})
        #: Every feature of a word has the word's first letters.
        self.heads = {f.rstrip("$")[:SHORTEST] for f in model.weights}
        self.singles = {_single(r"\1", f.rstrip("$")) for f in model.weights}
        self.single_lengths = sorted({len(f) for f in self.singles})
        self.held: dict[str, tuple[str, ...]] = {}

    def words(self, text: str) -> Iterator[str]:
        """Restored words of a whole text."""
        for raw in text.lower().split():
            yield from self.decoder.readings(raw)
        yield from self.spaced(text)

    def spaced(self, text: str) -> Iterator[str]:
        if _apart_likely(text):
            for m in _apart.finditer(text):
                yield self.decoder.read(_between("", m.group().lower()))

    def evidence(self, text: str) -> set[str]:
        """The distinct features of a text's restored words."""
        out: set[str] = set()
        for raw in set(text.lower().split()):
            got = self.held.get(raw)
            if got is None:
                got = tuple(f for w in self.decoder.readings(raw) for f in starts(w))
                if len(raw) < 48:
                    if len(self.held) >= self.CACHE // 8:
                        self.held.clear()
                    self.held[raw] = got
            out.update(got)
        for w in self.spaced(text):
            out.update(starts(w))
        return out

    def inside(self, run: str) -> Iterator[float]:
        """Weights of the toxic words at any place of a joined run, from left to right and without overlap."""
        i, get = 0, self.model.weights.get
        while i < len(run):
            held = [(v, n) for n in self.lengths if i + n <= len(run) for x in (run[i : i + n], run[i : i + n] + "$") if (v := get(x))]
            if held:
                yield max(held)[0]
            i += max((n for _, n in held), default=1)

    def weight(self, raw: str) -> float:
        get = self.model.weights.get
        core = raw.rstrip(CLOSING).lstrip(OPENING)
        if _plain(core):
            if not _double(core):
                return max((get(f, 0.0) for f in starts(core)), default=0.0) if core[:SHORTEST] in self.heads else 0.0
            if "(" not in raw:
                # a reading drops repeats at most, so without them it begins like this
                once = _single(r"\1", core)
                if not any(once[:n] in self.singles for n in self.single_lengths):
                    return 0.0
        return max((get(f, 0.0) for w in self.decoder.readings(raw) for f in starts(w)), default=0.0)

    def features(self, text: str | None) -> tuple[float, ...]:
        """Toxic words, the strongest of them, their sum, and their share of all words."""
        known = self.known
        words = (text or "").lower().split()
        weights = list(map(known.get, words))
        if None in weights:
            new = {raw: self.weight(raw) for raw in {w for w, v in zip(words, weights) if v is None}}
            weights = [new[w] if v is None else v for w, v in zip(words, weights)]
            if len(known) + len(new) > self.CACHE:
                known.clear()
            if len(new) <= self.CACHE:
                known.update((w, v) for w, v in new.items() if len(w) < 48)
        toxic = [v for v in weights if v]
        hits, total, most = len(toxic), sum(toxic), max(toxic, default=0.0)
        for w in self.spaced(text or ""):
            for v in self.inside(w):
                hits, total, most = hits + 1, total + v, max(most, v)
        return math.log1p(hits), most, math.log1p(total), hits / (len(words) + 10)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    rows, counts = sample(docs, labels, label, per_class)
    model = Model(CharModel(char_counts(docs)), share=(counts.get(1, 0) + 1) / (sum(counts.values()) + 2))
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return model
    chars = docs.sparkSession.sparkContext.broadcast(model.chars)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(Model(chars.value))
        for b in batches:
            for y, t in zip(b.column("y").to_pylist(), b.column("text")):
                f = list(s.evidence(t.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([y] * len(f), pa.int32()), pa.array(f, pa.string())], ["y", "f"])

    n1, n0 = sizes[1], sizes[0]
    by = rows.select("y", "text").mapInArrow(lean(found), "y int, f string").groupBy("f").agg(F.sum("y").alias("a"), F.count("*").alias("n"))
    by = by.withColumn("b", F.col("n") - F.col("a"))
    # evidence that the share among toxic documents is higher: twice the log likelihood ratio, against the number of features tried
    pa_, pb_, p = F.col("a") / n1, F.col("b") / n0, F.col("n") / (n1 + n0)
    ll = lambda k, q: F.when(k > 0, k * F.log(q)).otherwise(0.0)
    by = by.withColumn("g", 2 * (ll(F.col("a"), pa_) + ll(n1 - F.col("a"), 1 - pa_) + ll(F.col("b"), pb_) + ll(n0 - F.col("b"), 1 - pb_) - ll(F.col("n"), p) - ll(n1 + n0 - F.col("n"), 1 - p)))
    by = by.withColumn("w", F.log((F.col("a") + 0.5) / (n1 + 1) / ((F.col("b") + 0.5) / (n0 + 1))))
    tried = max(2, by.count())
    strong = by.where((pa_ > 8 * pb_) & (F.col("a") >= 3) & (F.col("g") > 2 * math.log(tried))).collect()
    model.weights = {r["f"]: float(r["w"]) for r in strong}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array([s.features(t.as_py()) for t in b.column("text")], pa.list_(pa.float64()))], ["y", "x"])

    seen = rows.select("y", "text").mapInArrow(lean(measured), "y int, x array<double>").collect()
    y = np.array([r["y"] for r in seen], float)
    model.calibration = Logistic(np.array([r["x"] for r in seen], float), y, prior_weights(y, counts))
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("n_toxic_words", T.LongType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        s = Scorer(m)
        for b in batches:
            x = np.array([s.features(t.as_py()) for t in b.column("text")]).reshape(-1, 4)
            p = m.calibration.predict(x) if m.calibration else np.full(len(x), m.share)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p, pa.float64()), pa.array(np.rint(np.expm1(x[:, 0])).astype(np.int64))], schema.names)

    found = docs.select("doc_id", "text").mapInArrow(lean(run), schema)
    return found.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "n_toxic_words")


def restored(docs: DataFrame, model: Model, out: str = "restored") -> DataFrame:
    """docs with the restored words of each text, separated by spaces."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(shared.value)
        for b in batches:
            texts = pa.array([None if t.as_py() is None else " ".join(s.words(t.as_py())) for t in b.column("text")], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], [*b.schema.names, out])

    return docs.mapInArrow(lean(run), schema)
