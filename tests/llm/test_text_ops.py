"""Operators over texts against brute force, and the defined results of odd inputs."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wardline.llm import bpe, common, latent, licenses, lines, near, pii, quality, toxicity
from wardline.llm.arrowtext import pieces
from wardline.llm.contract import QUERIES, tokenizer_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, very long, repeated rows, a null id, and extra columns with likely clashing names."""
    long = "lorem ipsum dolor " * 30_000
    base = docs_of(spark, [None, "", " \n\t ", long, long, "word", "twice twice", "a\x00b \x01 \x02"])
    return base.unionByName(docs_of(spark, ["twice twice"], 6)).unionByName(spark.createDataFrame([(None, "no id here at all", None, None, None)], SCHEMA)).withColumns({"n": F.lit(1), "component": F.lit("x"), "key": F.lit(2), "label": F.lit(3)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_and_hashes():
    texts = ["The cat  sat", "", None, "the CAT\nsat", "École É", "x" * 5000]
    got = [[bytes(p.data[s:e]) for s, e in zip(p.starts[lo:hi], p.ends[lo:hi])] for p in pieces(pa.array(texts), size=16) for lo, hi in zip(p.bounds[:-1], p.bounds[1:])]
    assert got == [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    h = [p.hashes[lo:hi].tolist() for p in pieces(pa.array(texts), size=16) for lo, hi in zip(p.bounds[:-1], p.bounds[1:])]
    assert h[0] == h[3] and len(set(h[0])) == 3


# ---- 6 ----


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_bpe_equals_library(library):
    c, rng = bpe.codec(tokenizer_path()), random.Random(5)
    signs = "etaoinshrdlu'sth!?.,0123 éñßΣİ́ \x1c\x85　<|endoftext|>$#"
    for n in range(1500):
        s = "".join(rng.choice(signs) for _ in range(rng.choice([0, 3, 20, 80, 300])))
        e = library.encode(s, add_special_tokens=False)
        assert c.encode(s) == e.ids and c.decode(e.ids) == library.decode(e.ids, skip_special_tokens=False), repr(s)


def test_bpe_streams_long_words(library):
    c, rng = bpe.codec(tokenizer_path()), random.Random(6)
    assert 0 < c.machine.lookahead < 1000
    for word in ("a" * 3000, "hah" * 1500, "".join(rng.choice("etaoinshr") for _ in range(6000)), "é" * 900):
        assert c.encode(word) == library.encode(word, add_special_tokens=False).ids


def test_bpe_segments_and_long_runs(library, monkeypatch):
    """Texts cut into tiny segments, and runs that are read block by block, become what the library makes of them whole."""
    monkeypatch.setattr(bpe, "SEGMENT", 64)
    monkeypatch.setattr(bpe, "LONG_BLOCK", 50)
    c, rng = bpe.Codec(tokenizer_path()), random.Random(8)
    signs = ["etaoin'slveré", "e", "a\u0301\u0323e\u1100\u1161\u11a8İΣ", "!?.'", "1a!", "x<|endoftext|>"]
    texts = ["".join(rng.choice(rng.choice(signs)) + " " * (rng.random() < gap) for _ in range(rng.choice([0, 5, 60, 200, 900]))) for gap in (0, 0.002, 0.2) for _ in range(120)]
    texts += [None, "", "a" * 5000, "!" * 500, "'" * 70 + "ve" * 90, "x" * 100 + "<|endoftext|>" + "y" * 100, "<|start", "oftext|>"]
    got = {}
    for row, ids in c.rows(pa.array(texts).slice(0)):
        got.setdefault(row, []).extend(ids.tolist())
    for row, t in enumerate(texts):
        assert got.get(row, []) == library.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_bpe_memory_is_constant(monkeypatch):
    import tracemalloc

    monkeypatch.setattr(bpe, "SEGMENT", 1 << 15)
    c, rng = bpe.Codec(tokenizer_path()), random.Random(9)
    block = "".join(rng.choice("etaoinshr") for _ in range(1 << 14))
    peaks = []
    for n in (8, 64):
        col = pa.array([block * n])
        tracemalloc.start()
        total = sum(len(ids) for _, ids in c.rows(col))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert total > len(block) * n // 8
    assert peaks[1] < 1.2 * peaks[0] + (1 << 20)


def test_bpe_digests_come_from_decoding():
    c = bpe.Codec(tokenizer_path())
    col = pa.array(["hello world", None])

    def seen():
        d = bpe.Digests(c, 2)
        for row, ids in c.rows(col):
            d.feed(row, ids, both=True)
        return d.decoded(), d.of_ids

    before = seen()
    c.names[c.encode("world")[0]] = "wrong</w>"
    after = seen()
    assert before[0][0] != after[0][0] and before[0][1] == after[0][1] and before[1] == after[1]


def test_bpe_tables_stay_bounded(library, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNKS", 200)
    monkeypatch.setattr(bpe, "SEGMENT", 256)
    c, rng = bpe.Codec(tokenizer_path()), random.Random(10)
    for _ in range(60):
        s = " ".join("".join(rng.choice("abcdef") for _ in range(rng.choice([1, 2, 3, 7]))) for _ in range(200))
        assert c.encode(s) == library.encode(s, add_special_tokens=False).ids
        assert len(c.chunks.keys) <= 400


def test_bpe_lookahead_is_sufficient():
    """Tokens that are emitted from a window are those of the whole word, on a tiny merge list with long chains."""
    merges = [("a", "b"), ("ab", "c"), ("c", "d"), ("b", "c"), ("d", "a"), ("abc", "da"), ("cd", "ab"), ("a", "a"), ("aa", "aa")]
    vocab = {s: i for i, s in enumerate([*"abcd", *(x + "</w>" for x in "abcd"), *("".join(m) for m in merges)])}
    m, rng = bpe.Transducer(vocab, merges, "</w>"), random.Random(7)

    def plain(word):
        parts = [*word[:-1], word[-1] + bpe.END]
        while True:
            ranked = [(m.rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in m.rank]
            if not ranked:
                return parts
            i = min(ranked)[1]
            parts[i : i + 2] = ["".join(parts[i : i + 2])]

    for _ in range(1500):
        w = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 60)))
        assert list(m.tokens(w)) == plain(w), w


def test_bpe_round_trip_and_odd(spark, odd, empty, library):
    p = tokenizer_path()
    rows = {r["doc_id"]: r for r in bpe.digests(odd, p).collect()}
    for r in odd.select("doc_id", "text").collect():
        e = library.encode(r["text"] or "", add_special_tokens=False)
        got = rows[r["doc_id"]]
        assert got["n_tokens"] == len(e.ids)
        assert got["ids_sha256"] == hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest()
        assert got["decoded_sha256"] == hashlib.sha256(library.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(empty, p).count() == 0
    back = bpe.decode(bpe.encode(docs_of(spark, ["hello wörld, it is 12", ""]), p), p, readable=True)
    assert [r["decoded"] for r in back.orderBy("doc_id").collect()] == ["hello wörld , it is 1 2", ""]
    with pytest.raises(ValueError):
        bpe.encode(odd.withColumn("ids", F.lit(1)), p)


# ---- 3 ----


def brute_components(texts: dict, k: int, percent: int):
    low = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    sets = {}
    for i, t in texts.items():
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(low))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_ngram_join_against_brute_force(spark, monkeypatch):
    rng, texts = random.Random(3), {}
    base = [[f"w{rng.randrange(4000)}" for _ in range(rng.randrange(5, 120))] for _ in range(12)]
    for i in range(260):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        texts[i] = " ".join(w)
    texts |= {260: None, 261: "", 262: "one", 263: "One", 264: "one two", 265: "one two"}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    for block in (256, 7):
        monkeypatch.setattr(near, "BLOCK", block)
        for k, percent in ((3, 90), (5, 80), (2, 50)):
            got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.join(df, k, percent).collect()}
            assert got == brute_components(texts, k, percent)


def test_ngram_join_counts_reach_the_driver_as_bytes(spark, monkeypatch):
    """Every task reports each bucket of long texts; the driver gets blocks of classes, and the classes are those of the summed counts."""
    own = [" ".join(f"{x}{i}" for i in range(20_000)) for x in "ab"]
    texts = [[own[0]] * 6 + [own[1]] * 5, [own[0]] * 10 + [None, ""]]  # a task each
    df = docs_of(spark, texts[0]).coalesce(1).union(docs_of(spark, texts[1]).coalesce(1))
    want = np.zeros(near.BUCKETS, np.int64)
    for task in texts:
        n = np.zeros(near.BUCKETS, np.int64)
        for p in pieces(pa.array(task, pa.string())):
            np.add.at(n, (near._all_shingles(p, 3) & np.uint64(near.BUCKETS - 1)).astype(np.int64), 1)
        want += np.where(n >= near.OFTEN, n, 0)
    rows, collect = [], type(df).collect

    def counted(self):
        got = collect(self)
        rows.append(len(got))
        return got

    monkeypatch.setattr(type(df), "collect", counted)
    got = near._frequent(df, 3)
    assert (want > 0).sum() > 19_000 and set(got[want == 16]) == {4}
    assert np.array_equal(got, np.floor(np.log2(np.maximum(want, 1))).astype(np.uint8))
    assert sum(rows) <= near.BUCKETS // near.PART


def test_ngram_join_sends_no_tables_of_ids_through_the_driver(spark, monkeypatch):
    """Compressed tables of ids look small; none of those that grow with the documents is broadcast."""
    base = [" ".join(f"w{k}_{i}" for i in range(60)) for k in range(6)]
    df = docs_of(spark, [b + f" x{j} y{j}" * (j % 3) for b in base for j in range(6)] + ["", None])
    plans = []

    def noted(df, staged=common.staged):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return staged(df)

    monkeypatch.setattr(near, "staged", noted)
    monkeypatch.setattr(common, "staged", noted)
    kept = near.keep_one(df, 5, 80)
    plans.append(kept._jdf.queryExecution().executedPlan().toString())
    by = brute_components({r["doc_id"]: r["text"] for r in df.collect()}, 5, 80)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(k for k, (_, c) in by.items() if k == c)
    assert sum(p.count("SortMergeJoin") for p in plans) > 20
    assert not [p for p in plans if "BroadcastHashJoin" in p and "parts" not in p]


def test_ngram_join_odd(spark, odd, empty):
    got = near.join(odd)
    assert got.count() == odd.count()
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[0]["component_id"] == 0 and by[0]["n_shingles"] == 0 and by[4]["component_id"] == 3 and by[None]["component_id"] is None
    assert near.join(empty).count() == 0 and near.keep_one(empty).count() == 0
    kept = near.keep_one(odd)
    assert kept.columns == odd.columns and 4 not in {r["doc_id"] for r in kept.collect()}


# ---- 1 ----


def test_patience_and_moved_blocks():
    assert lines.patience([1, 2, 3, 4, 9, 5], [7, 1, 2, 3, 8, 4, 5]) == [(0, 1, 3), (3, 5, 1), (5, 6, 1)]
    rng = random.Random(1)
    signs = [rng.getrandbits(62) for _ in range(8)]
    for _ in range(300):
        a, b = ([signs[rng.randrange(8)] for _ in range(rng.randrange(14))] for _ in range(2))
        found = lines.patience(a, b)
        assert all(a[x : x + n] == b[y : y + n] and n > 0 for x, y, n in found)
        assert all(p[0] + p[2] <= q[0] and p[1] + p[2] <= q[1] for p, q in zip(found, found[1:]))
        w = [np.array([rng.choice([1, 3, 9]) for _ in s]) for s in (a, b)]
        ha, hb = (np.array(s, np.int64).reshape(-1) for s in (a, b))
        words = {v: k for v, k in zip(a, w[0])}
        w[0], w[1] = (np.array([words.get(v, 2) for v in s], np.int64) for s in (a, b))
        gone = {i for x, y in lines.shared(ha, w[0], hb, w[1], 8) for i in range(x, y)}
        inside = {tuple(b[i:j]) for i in range(len(b)) for j in range(i + 1, len(b) + 1)}
        assert gone == {i for x in range(len(a)) for y in range(x + 1, len(a) + 1) if tuple(a[x:y]) in inside and w[0][x:y].sum() >= 8 for i in range(x, y)}


def test_long_sequences_in_another_order_take_no_square():
    a = np.random.RandomState(2).randint(1, 1 << 62, 20_000)
    w = np.full(len(a), 8)
    start = time.process_time()
    got = lines.shared(a, w, a[::-1].copy(), w)
    mixed = lines.shared(a, w, np.random.RandomState(3).permutation(a), w)
    assert time.process_time() - start < 20
    assert all({i for x, y in g for i in range(x, y)} == set(range(len(a))) for g in (got, mixed))


def test_line_dedup(spark, odd, empty):
    long = "this line has more than eight words in it for sure"
    other = "another line that also has more than eight words inside"
    rows = [f"start\n{long}\nend", f"{other}\n\n{long}\nmine", f"{long}\n{other}", "short line\nkeep", "short line\nkeep me"]
    out = {r["doc_id"]: r["text"] for r in lines.dedup(docs_of(spark, rows)).collect()}
    assert out[0] == rows[0] and out[1] == f"{other}\n\nmine" and out[2] == "" and out[3] == rows[3] and out[4] == rows[4]
    assert 2 not in {r["doc_id"] for r in lines.dedup(docs_of(spark, rows), drop_emptied=True).collect()}
    got = lines.dedup(odd)
    assert got.columns == [*odd.columns, "_wl_cut"] and got.count() == odd.count()
    assert {r["text"] for r in got.where("doc_id = 6").collect()} == {"twice twice"}
    assert lines.dedup(empty).count() == 0


def test_line_dedup_keeps_first_places(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    after = {r["doc_id"]: r["text"] for r in lines.dedup(docs).collect()}
    first = {}
    for i in sorted(before):
        left = Counter(after[i].split("\n"))
        for x in set(before[i].split("\n")):
            if len(x.split()) >= lines.BLOCK_WORDS:
                assert (left[x] == 0) == (x in first), (i, x)
                first.setdefault(x, i)


def test_line_dedup_against_brute_force(spark):
    """A line goes exactly where a run of eight words around it stands in an earlier document."""
    rng = random.Random(11)
    pool = ["a", "b c", "d", " ", "e f g", "h i j k", "l m n o p q r s t", "u v w x y z", "one two", "three"]
    rows = ["x y z\nalone", "p q r s t\nalone", "x y z\np q r s t\nhere", "there\nx y z\np q r s t"]
    rows += ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 16))) for _ in range(120)]
    after = {r["doc_id"]: r["text"] for r in lines.dedup(docs_of(spark, rows)).collect()}
    assert after[3] == "there"
    seen = set()
    for i, text in enumerate(rows):
        own, gone = text.split("\n"), set()
        runs = [(x, y, tuple(own[x:y])) for x in range(len(own)) for y in range(x + 1, len(own) + 1) if len(" ".join(own[x:y]).split()) >= lines.BLOCK_WORDS]
        for x, y, run in runs:
            if run in seen:
                gone.update(range(x, y))
        assert after[i] == "\n".join(v for k, v in enumerate(own) if k not in gone), i
        seen.update(run for _, _, run in runs)


# ---- 7, 8 ----


def auc(score, y):
    r = pd.Series(score).rank()
    p = np.asarray(y) == 1
    return (r[p].sum() - p.sum() * (p.sum() + 1) / 2) / (p.sum() * (~p).sum())


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = QUERIES["op7_quality"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert auc(got["score"], got["quality"]) > 0.9 and got["score"].between(0, 1).all()


def test_quality_learns_from_every_labelled_row(spark, monkeypatch):
    """The bad rows that tell are the last by the order that samples were once drawn in; chunks are trained on apart, and merged."""
    rng = random.Random(4)
    words = {k: [f"{k}{rng.randrange(10**6)}" for _ in range(300)] for k in "abc"}
    made = lambda k: " ".join(rng.choice(words[k]) for _ in range(60))
    ids = [r["id"] for r in spark.range(12000).where("crc32(cast(id as string)) % 4 <> 2").orderBy(F.xxhash64("id")).collect()]
    kind = {i: (("b" if n < 8000 else "c"), 0) if n % 2 else ("a", 1) for n, i in enumerate(ids)}
    docs = spark.createDataFrame([(i, made(k)) for i, (k, _) in kind.items()], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y, 0) for i, (_, y) in kind.items()], "doc_id bigint, quality int, toxic int")
    monkeypatch.setattr(quality, "CHUNK", 400_000)
    monkeypatch.setattr(quality, "DICTIONARY", 16 << 10)
    model = quality.fit(docs, labels)
    fresh = docs_of(spark, [made(k) for k in "abc" for _ in range(40)])
    got = [r["predicted"] for r in quality.score(fresh, model).orderBy("doc_id").collect()]
    assert sum(got[:40]) >= 38 and sum(got[40:]) <= 2
    assert sum(w.encode() in model.bad for w in words["c"]) > 50


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = QUERIES["op8_toxicity"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert auc(got["score"], got["toxic"]) > 0.7 and got["score"].between(0, 1).all()


def test_classifiers_odd(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0, 1), (3, 1, 0), (4, 1, 0), (5, 0, 1), (7, 1, 0)], "doc_id bigint, quality int, toxic int")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for lab in (labels, none):
        for docs in (odd, empty):
            for m in (quality, toxicity):
                rows = m.score(docs, m.fit(docs, lab)).collect()
                assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    assert quality.keep_good(odd, quality.fit(odd, labels)).columns == odd.columns


def test_deobfuscation(spark):
    docs = docs_of(spark, ["the idiot and the moron are here with trash and scum", "clown loser idiot moron"] * 30)
    d = toxicity.Decoder(toxicity.CharModel(toxicity.char_counts(docs)))
    for raw, word in (("1d10t", "idiot"), ("m0r0n", "moron"), ("i.d.i.o.t", "idiot"), ("idiiiiot", "idiot"), ("$cum", "scum"), ("tr@sh", "trash")):
        assert word in d.readings(raw), raw
    assert d.readings("the,") == ["the"]
    assert list(toxicity.Scorer(toxicity.Model(d.chars)).spaced("you i d i o t now")) == ["idiot"]


def test_passing_over_words_loses_nothing(spark):
    rng = random.Random(3)
    docs = docs_of(spark, ["".join(rng.choice("abdiot ") for _ in range(400)) for _ in range(20)] + [None, "", "x"])
    counts = toxicity.char_counts(docs)
    want = np.zeros(toxicity.SIDE**3, np.int64)
    for t in (r["text"] for r in docs.collect()):
        for w in (t or "").split():
            x = [0, 0, *(toxicity._index[c] for c in w), 0]
            for a, b, c in zip(x, x[1:], x[2:]):
                want[(a * toxicity.SIDE + b) * toxicity.SIDE + c] += 1
    assert (counts == want).all()
    s = toxicity.Scorer(toxicity.Model(toxicity.CharModel(counts), {"idio": 2.0, "idiot$": 3.0, "bott": 1.0, "aab$": 1.5}))
    for _ in range(2000):
        w = "".join(rng.choice(["i", "d", "o", "t", "a", "b"]) * rng.choice([1, 1, 2, 3]) for _ in range(rng.randrange(1, 8)))
        w = rng.choice([w, "iddiioott" + w[:2], "bbott" + w])
        assert s.weight(w) == max((s.model.weights.get(f, 0.0) for x in s.decoder.readings(w) for f in toxicity.starts(x)), default=0.0), w


def test_deobfuscation_of_whole_words_and_runs(spark):
    docs = docs_of(spark, ["the idiot and the moron are here with trash and scum", "clown loser idiot moron you are a letter"] * 30)
    d = toxicity.Decoder(toxicity.CharModel(toxicity.char_counts(docs)))
    for raw in ("i" * 40 + "diot", "1d10+", "(1d10+)", "!d!0+", "iiddiioott", "iiddiioott,", "1d10t!", "-1diot"):
        assert "idiot" in d.readings(raw), raw
    assert d.read("the.idiot." * 500) == "theidiot" * 500
    s = toxicity.Scorer(toxicity.Model(d.chars, {"idio": 3.0, "idiot": 4.0, "scum$": 2.0}))
    for text, hits in (("y o u i d i o t", 1), ("a " * 200 + "i d i o t", 1), ("y o u s c u m y o u i d i o t", 2), ("y o u a r e", 0)):
        assert round(np.expm1(s.features(text)[0])) == hits, text


# ---- 9 ----


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_pii(t):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 13 <= len(digits(m)) <= 19 and sum((lambda d: d - 9 * (d > 9))(int(c) * (1 + i % 2)) for i, c in enumerate(reversed(digits(m)))) % 10 == 0]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15]


def test_pii_base(spark):
    rng = random.Random(9)
    for _ in range(8000):
        t = "".join(rng.choice("a1.@-_ 2+(4)5é") for _ in range(60))
        assert pii.base(t) == brute_pii(t), repr(t)
    got = pii.find(docs_of(spark, ["é mail a@b.co x", "4539 1488 0343 6467", None])).orderBy("doc_id").collect()
    assert got[0]["spans"] == "email:7:13" and got[0]["base_sha256"] == hashlib.sha256(b"email:7:13").hexdigest()
    assert got[1]["n_card"] == 1 and got[2]["spans"] == "" and got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_pii_discovers(spark, odd, empty):
    seeds = [f"some words here contact: user{i}@mail.example.org and more words" for i in range(40)]
    unseen = [f"some words here contact: member-77{i}x and more words" for i in range(5)]
    clean = ["some words here with room number 4217b and more words"] * 20
    rows = pii.find(docs_of(spark, seeds + unseen + clean)).orderBy("doc_id").collect()
    assert all("id:" in r["spans"] for r in rows[40:45]) and not any("id:" in r["spans"] for r in rows[:40] + rows[45:])
    text = unseen[0]
    _, lo, hi = rows[40]["spans"].split(":")
    assert text[int(lo) : int(hi)] == "member-770x"
    assert pii.find(odd).count() == odd.count() and pii.find(empty).count() == 0


# ---- 10 ----


def test_directions_are_fitted_on_every_document(spark):
    texts = ["common words stand here"] * 21000 + [f"rare{i} words stand here" for i in range(200)]
    _, projection = latent.fit(docs_of(spark, texts))
    hashes = np.concatenate([p.hashes[:1] for i in range(200) for p in pieces(pa.array([f"rare{i}"]), latent.APART)])
    assert np.abs(projection[latent.features(hashes)]).max(1).all()

def test_decontamination(spark, odd, empty, sf):
    d = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    word, index, items = re.compile(r"[^\W_]+"), {}, {}
    for r in bench.collect():
        items[r["item_id"]] = w = word.findall(r["text"].lower())
        for k in range(len(w) - 4):
            index.setdefault(tuple(w[k : k + 5]), set()).add(r["item_id"])
    truth = set()
    for r in docs.collect():
        w, seen = word.findall(r["text"].lower()), Counter()
        for k in range(len(w) - 4):
            seen.update(index.get(tuple(w[k : k + 5]), ()))
        truth |= {(r["doc_id"], i) for i, n in seen.items() if n > 0.5 * (len(items[i]) - 4)}
    found = {(r["doc_id"], r["item_id"]) for r in latent.search(docs, bench).collect()}
    assert len(found & truth) >= 0.9 * len(truth) and not found - truth
    assert latent.search(odd, bench).count() == 0 and latent.search(empty, bench).count() == 0 and latent.search(docs, bench.limit(0)).count() == 0
    kept = latent.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len({i for i, _ in found})


def test_short_items_inside_longer_texts(spark):
    """Items of 5 to 24 words, copied word for word into ordinary documents."""
    rng = random.Random(12)
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 1500").orderBy("doc_id").limit(240)
    texts = [r["text"].split() for r in d.collect()]
    vocabulary = sorted({w for t in texts for w in t if w.isascii() and w.isalpha()})
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(5 + i % 20))) for i in range(240)]
    for (i, item), t in zip(items, texts):
        at = rng.randrange(len(t))
        t[at:at] = item.split()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]) for r in latent.search(docs_of(spark, [" ".join(t) for t in texts]), bench).where("share = 1").collect()}
    missed = [5 + i % 20 for i in range(len(texts)) if (i, i) not in found]
    assert len(texts) == 240 and len(missed) <= 12, sorted(missed)


def test_paraphrases(spark):
    """Items of which a fifth to two fifths of the words are replaced: of what alignment at every word accepts, at least 0.9 is found."""
    rng = random.Random(14)
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 1500").orderBy("doc_id").limit(240)
    texts = [r["text"].split() for r in d.collect()]
    vocabulary = sorted({w for t in texts for w in t if w.isascii() and w.isalpha()})
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(15 + i % 45))) for i in range(240)]
    for (i, item), t in zip(items, texts):
        at = rng.randrange(len(t))
        t[at:at] = [rng.choice(vocabulary) if rng.random() < 0.2 + 0.1 * (i % 3) else w for w in item.split()]
    found = latent.search(docs_of(spark, [" ".join(t) for t in texts]), spark.createDataFrame(items, "item_id int, text string"))
    assert found.schema["item_id"].dataType.simpleString() == "int"
    found = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    hashes = lambda t: np.concatenate([p.hashes for p in pieces(pa.array([t]), latent.APART)])
    whole = latent.Verifier(latent.Items([i for i, _ in items], [hashes(t) for _, t in items], None, None))
    truth = {(i, i) for i, t in enumerate(texts) if whole.check(i, hashes(" ".join(t)))}
    assert len(truth) > 180 and len(found & truth) >= 0.9 * len(truth) and len(found - truth) <= 2, (len(truth), len(found & truth))


def test_item_ids_of_any_type(spark):
    docs = docs_of(spark, ["one two three four five six seven eight nine ten eleven twelve"])
    for kind, i in (("string", "a"), ("int", 3), ("smallint", 3), ("decimal(5,0)", None)):
        bench = spark.createDataFrame([(i, "three four five six seven eight nine ten"), (i, None), (i, "..")], f"item_id {kind}, text string")
        got = latent.search(docs, bench).collect()
        assert [r["item_id"] for r in got] == [i] and got[0]["share"] == 1


def test_stretch_is_aligned_whenever_it_can_agree():
    """A stretch with six of ten words, all common, is aligned although their weight is small."""
    words = np.arange(1, 11).astype(np.uint64)
    items = latent.Items([0], [words], np.zeros(1, np.int64), np.zeros((1, 1), np.float32))
    assert latent.Verifier(items).check(0, words[:6])[0] == 0.6


def test_lcs():
    rng = random.Random(2)

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        assert latent.lcs([m[x] for x in b if x in (m := latent.masks(np.array(a, np.uint64)))], len(a)) == plain(a, b)


# ---- 2 ----


def brute_licenses(text, dice):
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), t))
    two = lambda w: set(zip(w, w[1:]))
    rows = [x for x in text.split("\n") if x]
    units = [("line", i, i, x) for i, x in enumerate(rows)] + ([("text", 0, len(rows) - 1, text)] if len(rows) > 1 else [])
    out = set()
    for kind, lo, hi, t in units:
        a = two(words(t))
        for k, v in licenses.TEMPLATES.items():
            b = two(words(v))
            if a and 2 * len(a & b) >= dice * (len(a) + len(b)):
                out.add((kind, lo, hi, k))
    return out


def test_licenses(spark, odd, empty, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {}
    for r in licenses.scan(docs).where("unit in ('line', 'text')").collect():
        got.setdefault(r["doc_id"], set()).add((r["unit"], r["first_line"], r["last_line"], r["license"]))
    for r in docs.collect():
        assert got.get(r["doc_id"], set()) == brute_licenses(r["text"], licenses.DICE), r["doc_id"]
    mit = licenses.TEMPLATES["MIT"]
    parted = mit[:200] + "\n" + mit[200:]
    found = licenses.scan(docs_of(spark, [f"intro\n\n{parted}\n\nend of file", mit.upper()])).collect()
    assert {(r["doc_id"], r["unit"], r["license"]) for r in found} >= {(0, "paragraph", "MIT"), (1, "line", "MIT")}
    assert licenses.scan(odd).count() == 0 and licenses.scan(empty).count() == 0


def brute_runs(text, dice):
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())
    two = lambda w: set(zip(w, w[1:]))
    known = {k: two(words(v)) for k, v in licenses.TEMPLATES.items()}
    most = max(len(words(v)) for v in licenses.TEMPLATES.values()) * (2 - dice) / dice
    parts = [x for x in re.split("\n\n+", text) if x]
    lead = [any(two(words(x)) & b for b in known.values()) for x in parts]
    found = []
    for k in range(len(parts)):
        for j in range(k, len(parts)):
            w = words("\n".join(parts[k : j + 1]))
            if lead[k] and lead[j] and len(w) <= most:
                for name, b in known.items():
                    d = 2 * len(two(w) & b) / (len(two(w)) + len(b))
                    if d >= dice:
                        found.append((-d, j - k, k, name))
    kept = []
    for d, n, k, name in sorted(found):
        if all(name != o or k > y or k + n < x for x, y, o in kept):
            kept.append((k, k + n, name))
    lines = [len(x.split("\n")) for x in parts]
    return {(sum(lines[:k]), sum(lines[: j + 1]) - 1, name) for k, j, name in kept if j > k and (k or j + 1 < len(parts))}


def test_license_runs(spark):
    rng = random.Random(9)
    cut = lambda t, *marks: re.sub("(" + "|".join(map(re.escape, marks)) + ")", r"\n\n\1", t)
    mit = cut(licenses.TEMPLATES["MIT"], "The above copyright notice", "THE SOFTWARE IS")
    bsd = cut(licenses.TEMPLATES["BSD-3-Clause"], "1. Redis", "2. Redis", "3. Neither", "THIS SOFTWARE")
    gpl = cut(licenses.TEMPLATES["GPL-3.0 header"], "This program is distributed", "See the GNU")
    parts = [x.replace(" of ", " of\n", 1) for t in (mit, bsd, gpl) for x in t.split("\n\n")] + ["All rights reserved.", "some other words", "of the Software", "one", "x " * 60]
    texts = [f"intro\n\n{mit}\n\nend", f"a\nb\n\n{bsd}\n\n\n{mit}\n\n{gpl} more", mit] + ["\n\n".join(rng.choice(parts) for _ in range(rng.randint(2, 14))) for _ in range(150)]
    got = {}
    for r in licenses.scan(docs_of(spark, texts)).where("unit = 'paragraphs'").collect():
        got.setdefault(r["doc_id"], set()).add((r["first_line"], r["last_line"], r["license"]))
    for i, t in enumerate(texts):
        assert got.get(i, set()) == brute_runs(t, licenses.DICE), i
    assert (1, 3, "MIT") in got[0] and {x[2] for x in got[1]} >= {"MIT", "BSD-3-Clause", "GPL-3.0 header"} and 2 not in got


def test_pii_tasks_report_a_phrase_once(spark):
    """Counts are exact, over pieces of text and batches, and few other phrases share a bit."""
    other = " ".join(f"w{i} v{i}" for i in range(40000))
    docs = docs_of(spark, ["call me now " * 3, other, *["call me"] * 50]).coalesce(1)
    phrases = spark.createDataFrame([("call me",), ("me",), ("now call",)], "words string")
    found = pii._occurrences(docs, phrases)
    assert {r["words"]: r["n"] for r in found.collect()} == {"call me": 53, "me": 53, "now call": 2}
    assert pii.BUCKETS >= 1 << 22


def test_labels_are_joined_by_shuffle_of_few_texts(spark, monkeypatch):
    from wardline.llm import labelled as module

    docs = spark.range(4000).selectExpr("id as doc_id", "concat('text ', id) as text").union(spark.sql("select null, 'no id'")).union(spark.sql("select 5L, null"))
    labels = spark.range(0, 4000, 10).selectExpr("id as doc_id", "cast(id % 20 = 0 as int) as quality")
    plans, staged = [], module.staged

    def watched(df):
        plans.append(df)
        return staged(df)

    monkeypatch.setattr(module, "staged", watched)
    rows, counts = module.labelled(docs, labels, "quality")
    want = docs.join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 4 <> 2").selectExpr("doc_id", "coalesce(text, '')", "quality")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, want.collect())) and sum(counts.values()) == rows.count()
    plan = plans[-1]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    kept = module.likely(docs.where("doc_id is not null"), rows.select("doc_id"), "doc_id", module.FILTER_BITS)
    assert rows.select("doc_id").exceptAll(kept.select("doc_id")).isEmpty() and kept.count() < 1.1 * rows.count()
