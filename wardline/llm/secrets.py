"""Secret scans: candidates by pattern, false positives removed by a random forest trained on labelled findings.

Everything runs as DataFrame operations in the JVM.  A text is marked around every candidate in one pass of a regular
expression and split at the marks, so each candidate comes with the words on both sides.  Features are the
candidate's length and alphabet, transitions between character classes and common letter pairs, entropy, coverage by
dictionary words, words of the path, and neighbouring words.  Labelled findings are a table (candidate, before,
after, path, label); ``labelled_findings`` makes a deterministic one, of ROWS rows, where none is at hand.

Null and empty texts have no candidates; long texts are scanned whole; repeated rows give the same findings; a
null path counts as an empty one; an empty table gives an empty result.  Extra columns are ignored.  Candidates are
numbered within their text and leave this module only as digests.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = 6000
THRESHOLD = 0.5
SIGN = r"A-Za-z0-9_+/=\-"
#: A run of at least sixteen signs with a digit in it.
CANDIDATE = rf"(?<![{SIGN}])(?=[A-Za-z_+/=\-]*+[0-9])[{SIGN}]{{16,}}+"
OPEN, CLOSE = "\u0001", "\u0002"
#: Signs of context on either side.
AROUND = 48

# Fixed word lists.
DICTIONARY = "access account admin application assets backup branch build change class client cloud config count create data date default demo device dummy error event example field file function group here image import index input item label layer list local main master message method model module name node number object order output page param path placeholder plugin point project public query record release request result sample schema script server service session source state string style system table target temp test text theme time title type update user value version view web your".split()
CUES = "token secret passwd password pwd apikey api_key api-key auth credential private access_key bearer client_secret signature".split()
DECOYS = "commit sha sha1 sha256 md5 checksum hash digest uuid guid revision etag build version order invoice isbn phone card tracking example sample placeholder".split()
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le".split()
PREFIXES = "AKIA ASIA ghp_ gho_ github_pat sk_live rk_live xoxb xoxp eyJ AIza glpat- SG".split()
PATHS = "test tests example examples sample samples doc docs mock mocks fixture fixtures vendor node_modules".split()


def candidates(docs: DataFrame, text: str = "text", path: str = "source") -> DataFrame:
    """(doc_id, candidate_no, candidate, before, after, path)."""
    marked = F.regexp_replace(F.translate(F.col(text), OPEN + CLOSE, "  "), f"({CANDIDATE})", f"{OPEN}$1{CLOSE}")
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path in docs.columns else F.lit("")
    parts = docs.select("doc_id", where.alias("path"), F.split(marked, OPEN).alias("parts")).where(F.size("parts") > 1)
    left = lambda x: F.right(F.element_at(F.split(x, CLOSE), -1), F.lit(AROUND))
    each = F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda i: F.struct(i.alias("candidate_no"), F.substring_index(F.get("parts", i), CLOSE, 1).alias("candidate"), left(F.get("parts", i - 1)).alias("before"), F.left(F.substring_index(F.get("parts", i), CLOSE, -1), F.lit(AROUND)).alias("after")))
    return parts.select("doc_id", "path", F.explode(each).alias("c")).select("doc_id", F.col("c.candidate_no").cast("bigint").alias("candidate_no"), "c.candidate", "c.before", "c.after", "path")


def _count(col: Column, pattern: str) -> Column:
    return F.regexp_count(col, F.lit(pattern)).cast("double")


def _any(words: list[str]) -> str:
    return "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"


def features(found: DataFrame) -> DataFrame:
    """found with a vector column `features`."""
    c, low = F.col("candidate"), F.lower("candidate")
    n = F.length(c).cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]", "\u0003"), "[A-Z]", "\u0004"), "[0-9]", "\u0005"), "[^\u0003\u0004\u0005]", "\u0006")
    runs = F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")).cast("double")
    signs = F.array_distinct(F.split(c, ""))
    entropy = F.aggregate(signs, F.lit(0.0), lambda s, x: s - F.when(F.length(x) > 0, (F.length(c) - F.length(F.replace(c, x, F.lit("")))) / n * F.log2((F.length(c) - F.length(F.replace(c, x, F.lit("")))) / n)).otherwise(0.0))
    near = F.lower(F.right("before", F.lit(24)))
    value = F.substring_index(c, "=", -1)
    columns = {
        "length": n,
        "digits": _count(c, "[0-9]") / n,
        "upper": _count(c, "[A-Z]") / n,
        "lower": _count(c, "[a-z]") / n,
        "hex": F.when(F.length(F.regexp_replace(F.lower(value), "[0-9a-f]", "")) == 0, 1.0).otherwise(0.0),
        "decimal": F.when(F.length(F.regexp_replace(c, "[0-9\\-]", "")) == 0, 1.0).otherwise(0.0),
        "uuid": F.when(low.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), 1.0).otherwise(0.0),
        "value": F.length(value).cast("double"),
        "transitions": runs / n,
        "pairs": _count(low, _any(PAIRS)) / n,
        "entropy": entropy,
        "dictionary": 1 - F.length(F.regexp_replace(low, _any(DICTIONARY), "")) / n,
        "separators": _count(c, "[_/\\-]") / n,
        "known": F.when(c.rlike("^" + _any(PREFIXES)), 1.0).otherwise(0.0),
        "cue_inside": F.when(low.rlike(_any(CUES) + ".*="), 1.0).otherwise(0.0),
        "cue": F.when(near.rlike(_any(CUES)), 1.0).otherwise(0.0),
        "decoy": F.when(near.rlike("\\b" + _any(DECOYS) + "\\b"), 1.0).otherwise(0.0),
        "assigned": F.when(near.rlike("[=:]\\s*[\"']?$"), 1.0).otherwise(0.0),
        "quoted": F.when(F.col("after").rlike("^[\"'`]"), 1.0).otherwise(0.0),
        "path": F.when(F.lower("path").rlike("\\b" + _any(PATHS) + "\\b"), 1.0).otherwise(0.0),
    }
    wide = found.withColumns({f"_f_{k}": F.coalesce(v, F.lit(0.0)) for k, v in columns.items()})
    return VectorAssembler(inputCols=[f"_f_{k}" for k in columns], outputCol="features").transform(wide).drop(*(f"_f_{k}" for k in columns))


def labelled_findings(spark: SparkSession, rows: int = ROWS) -> DataFrame:
    """Deterministic findings of the usual kinds, true and false, with label 1 and 0."""
    i = F.col("id")
    hexa = lambda k, n: F.substring(F.sha2(F.concat_ws(":", i.cast("string"), F.lit(k)), 512), 1, n)
    b64 = lambda k, n: F.substring(F.translate(F.base64(F.unhex(F.sha2(F.concat_ws(":", i.cast("string"), F.lit(k)), 512))), "+/=", "aB7"), 1, n)
    pick = lambda words, k: F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(words))) + 1).cast("int"))
    word = lambda k: pick(DICTIONARY, k)
    digits = lambda k, n: F.substring(F.regexp_replace(F.sha2(F.concat_ws(":", i.cast("string"), F.lit(k)), 512), "[a-f]", ""), 1, n)
    cue, prose = pick(["token = ", "secret: ", "api_key=\"", "password: ", "auth_token = \"", "client_secret: "], 1), F.concat(word(2), F.lit(" "), word(3), F.lit(" "))
    lit = F.lit
    # (candidate, before, after, label)
    kinds = [
        (F.concat(lit("AKIA"), F.upper(b64("a", 16))), F.concat(prose, pick(["", "key ", "access key: "], 4)), lit(" "), 1),
        (F.concat(lit("ghp_"), b64("b", 36)), F.concat(prose, pick(["", "token ", "auth: "], 5)), lit(" "), 1),
        (hexa("c", 40), F.concat(prose, lit('token = "')), lit('" '), 1),
        (F.concat(pick(["password=", "secret=", "token=", "api_key="], 6), hexa("d", 18)), prose, lit(" "), 1),
        (b64("e", 40), F.concat(prose, cue), lit('" '), 1),
        (F.concat(lit("eyJ"), b64("f", 60)), F.concat(prose, pick(["bearer ", "token: ", "auth "], 7)), lit(" "), 1),
        (hexa("g", 32), F.concat(prose, cue), lit(" "), 1),
        (hexa("h", 40), F.concat(prose, pick(["commit ", "sha1 ", "revision "], 8)), lit(" "), 0),
        (hexa("i", 32), F.concat(prose, pick(["md5 ", "checksum: ", "etag: "], 9)), lit(" "), 0),
        (F.concat_ws("-", hexa("j", 8), hexa("k", 4), hexa("l", 4), hexa("m", 4), hexa("n", 12)), F.concat(prose, pick(["uuid ", "id: ", ""], 10)), lit(" "), 0),
        (F.rpad(digits("o", 16), 16, "4"), prose, lit(" "), 0),
        (F.concat_ws("_", word(11), word(12), word(13), digits("p", 2)), F.concat(prose, pick(["", "= ", "token "], 14)), lit(" "), 0),
        (F.concat(lit("YOUR_"), F.upper(word(15)), lit("_TOKEN_HERE_"), digits("q", 3)), F.concat(prose, cue), lit('"'), 0),
        (F.concat_ws("/", word(16), word(17), word(18), F.concat(word(19), digits("r", 2))), prose, lit("."), 0),
        (F.concat(word(20), lit("-"), word(21), lit("-2024-"), digits("s", 4)), prose, lit(" "), 0),
    ]
    k = F.pmod(F.xxhash64("id", F.lit(99)), F.lit(len(kinds)))
    case = lambda at: _case(k, [x[at] if isinstance(x[at], Column) else F.lit(x[at]) for x in kinds])
    path = pick(["src/main/app.py", "config/prod.env", "deploy/run.sh", "tests/fixtures/data.json", "docs/readme.md", "src1"], 22)
    label = F.when(path.startswith("tests") | path.startswith("docs"), F.when(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(4)) == 0, 0).otherwise(case(3))).otherwise(case(3))
    return spark.range(rows, numPartitions=4).select(case(0).alias("candidate"), case(1).alias("before"), case(2).alias("after"), path.alias("path"), label.cast("double").alias("label"))


def _case(k: Column, values: list[Column]) -> Column:
    out = F.when(k == 0, values[0])
    for n, v in enumerate(values[1:], 1):
        out = out.when(k == n, v)
    return out


def fit(findings: DataFrame, trees: int = 40, depth: int = 8, seed: int = 13) -> RandomForestClassificationModel:
    return RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed).fit(features(findings))


def scan(docs: DataFrame, model: RandomForestClassificationModel, threshold: float = THRESHOLD, text: str = "text", path: str = "source") -> DataFrame:
    """(doc_id, candidate_no, n_chars, candidate_sha256, score, is_secret) for every candidate."""
    scored = model.transform(features(candidates(docs, text, path)))
    score = F.round(vector_to_array("probability")[1], 9)
    return scored.select("doc_id", "candidate_no", F.length("candidate").cast("bigint").alias("n_chars"), F.sha2(F.encode("candidate", "utf-8"), 256).alias("candidate_sha256"), score.alias("score"), (score >= threshold).alias("is_secret"))
