"""Secret scans with a random forest against false positives.

Candidates are runs of ``SHORTEST`` or more letters, digits or ``+/_-`` that
hold a digit or are assigned to a key: all of a word, so those of minified
JSON, joined settings, CSV rows and query strings, each with the key before it
in the word (the first also with one in the words before).  Each is described by its
length, its character classes and the transitions between them, how likely its
character pairs are in the corpus' own words, the share of it that frequent
words cover, its path, and the words beside it.  A random forest trained on
labelled findings tells secrets from identifiers, numbers and prose.

Labelled findings can be passed in.  Without any, the forest is trained on
planted ones: credentials of several kinds, and look-alikes (identifiers,
digests, numbers, paths, placeholders), made from a hash and written between
words of at most ``CARRIERS`` documents, some of either kind with keys that
secrets have, some with other keys or none.  A finding's label is what was
planted and follows from no feature: values of one form stand under both labels
with different keys, and keys of secrets hold placeholders too.

Only DataFrame functions and JVM-side training run; the trained trees are
turned into one SQL expression.  Word counts, the dictionary (the ``WORDS``
most frequent words) and the transitions cover all documents; the forest is
fitted on at most ``ROWS`` findings of each label, those of least hash.

Edge cases: null and empty texts have no candidates; a null path is an empty
one; null ids and repeated rows have findings of their own; with findings of
one label only the score is that label, without any it is 0; very long texts
are scanned whole, a word of any length gives all its candidates; candidates of
equal features have equal scores; other columns, whatever their names, are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, Scratch, in_front, read

SHORTEST, ROWS, WORDS, CARRIERS = 12, 10_000, 2_000, 600
TREES, DEPTH, SEED = 16, 6, 17

# Names that keys of secrets have, published formats, and words of test data in paths.
KEY_NAMES = "password|passwd|pwd|secret|token|apikey|api_key|access_key|auth|credential|bearer|private_key"
FORMATS = r"^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^xox[abprs]-[A-Za-z0-9-]{10,}$|^sk_live_[A-Za-z0-9]{16,}$|^AIza[A-Za-z0-9_-]{35}$|^eyJ[A-Za-z0-9_-]{10,}"
NAME = r"[A-Za-z_][A-Za-z0-9_.-]*"
QUOTES, SEPARATORS = r"[\"'`\\]", r"[,;&?|<>{}()\[\]\"'`\\]+"
KEYS = ["password", "secret", "token", "api_key", "auth_token", "db_password", "client_secret", "access_key"]
OTHER_KEYS = ["id", "request_id", "commit", "sha", "order", "build", "file", "version", "checksum", "trace", "etag", "digest"]
TEST_PATHS = "test|example|sample|mock|fixture|demo"

FEATURES = ["size", "digits", "upper", "lower", "kinds", "distinct", "turns", "transition", "covered", "assigned", "named", "test_path", "before_known", "after_known", "hex"]


def vocabulary(docs: DataFrame, scratch: Scratch, text_col: str = "text") -> DataFrame:
    """word, n over all documents: words of letters only, lower-cased, without marks around them."""
    raw = docs.select(F.explode(F.split(F.lower(F.col(text_col)), SPACES)).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    word = F.regexp_replace("w", r"^[^\p{L}]+|[^\p{L}]+$", "")
    return scratch.keep(raw.select(word.alias("word"), "n").where(F.col("word").rlike(r"^\p{L}+$")).groupBy("word").agg(F.sum("n").alias("n")))


def _plain(value: Column) -> Column:
    """Lower-case letters, 9 for digits and # for the rest."""
    return F.regexp_replace(F.regexp_replace(F.lower(value), "[0-9]", "9"), "[^a-z9]", "#")


def _bound(value: Column, use) -> Column:
    """use(value) with value computed once, as the variable of a lambda; a column would be put in each of its places."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _pairs(value: Column) -> Column:
    text = F.concat(F.lit("#"), _plain(value), F.lit("#"))
    return _bound(text, lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, 2)))


def transitions(words: DataFrame) -> dict[str, float]:
    """Log share of each second character after the first, add-one smoothed: at most 28 * 28 entries."""
    counts = words.select(F.explode(_pairs(F.col("word"))).alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    letters = "abcdefghijklmnopqrstuvwxyz9#"
    known = {r["pair"]: int(r["n"]) for r in counts}
    out = {}
    for a in letters:
        total = sum(known.get(a + b, 0) + 1 for b in letters)
        out |= {a + b: math.log((known.get(a + b, 0) + 1) / total) for b in letters}
    return out


def _values(word: Column, led: Column) -> Column:
    """Of a word: (segment, key, value) of each candidate; led: whether a key is written before the word."""
    # three parts with points between are one signed token
    run = F.lit(rf"(eyJ[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+|[A-Za-z0-9+/_-]{{{SHORTEST},}}={{0,2}})")
    segments = F.filter(F.split(F.regexp_replace(word, rf"{QUOTES}*([=:]+)[(\[]*{QUOTES}*", "$1"), SEPARATORS), lambda s: s != "")

    def of(segment: Column, nth: Column) -> Column:
        name = F.regexp_extract(segment, rf"^((?:{NAME}[=:]+)*{NAME})[=:]+[^=:]", 1)
        # a credential before a colon is a value and not a key
        name = F.when(F.regexp_extract(name, rf"({NAME})$", 1).rlike(FORMATS), "").otherwise(name)

        def held(name: Column) -> Column:
            rest = F.regexp_replace(F.substr(segment, F.length(name) + 1), "^[=:]+", "")
            assigned = ((name != "") & ~rest.startswith("//")) | (led & (nth == 0) & (name == ""))
            found = F.filter(F.regexp_extract_all(rest, run, F.lit(1)), lambda v: assigned | v.rlike("[0-9]"))
            return F.transform(found, lambda v: F.struct(nth.cast("int").alias("segment"), F.regexp_extract(name, rf"({NAME})$", 1).alias("key"), v.alias("value")))

        return _bound(name, held)

    return F.flatten(F.transform(segments, of))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """doc_id, nth (place among the text's words), part (place among the word's candidates), path, key, value, before, after."""
    probe, sign = rf"[A-Za-z0-9+/_-]{{{SHORTEST},}}", r"^[=:]+$|^=>$|^:=$"

    def found(words: Column) -> Column:
        near = lambda i: F.coalesce(F.try_element_at(words, i), F.lit(""))
        before = lambda i, k: F.when(i > k, near(i - k)).otherwise("")
        leads = lambda i: before(i, 1).rlike(r"[=:]$|^=>$")
        at = F.filter(
            F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))),
            lambda i: (F.length(near(i)) >= SHORTEST) & near(i).rlike(probe) & (near(i).rlike("[0-9=:]") | leads(i)),
        )
        return F.transform(at, lambda i: F.struct(i.alias("nth"), near(i).alias("word"), before(i, 1).alias("b1"), before(i, 2).alias("b2"), near(i + 1).alias("after")))

    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(path_col), F.lit("")).alias("path"), F.explode(_bound(F.split(F.col(text_col), SPACES), found)).alias("c")
    ).select("doc_id", "path", "c.*")
    is_sign = F.col("b1").rlike(sign)
    led = F.when(is_sign, F.col("b2")).when(F.col("b1").rlike(r"[=:]$"), F.regexp_replace("b1", r"[=:]+$", "")).otherwise("")
    beside = F.when(is_sign, F.col("b2")).otherwise(F.col("b1"))
    # the words beside go with the candidates that are next to them only, so rows don't grow with a long word's candidates
    parts = F.transform(
        _values(F.col("word"), led != ""),
        lambda v, k: F.struct((k + 1).cast("int").alias("part"), v["segment"].alias("segment"), v["key"].alias("key"), v["value"].alias("value")),
    )

    def dressed(all_parts: Column) -> Column:
        return F.transform(
            all_parts,
            lambda v: F.struct(
                v["part"].alias("part"),
                F.lower(F.when((v["key"] == "") & (v["segment"] == 0), led).otherwise(v["key"])).alias("key"),
                v["value"].alias("value"),
                F.when(v["part"] == 1, beside).otherwise("").alias("before"),
                F.when(v["part"] == F.size(all_parts), F.col("after")).otherwise("").alias("after"),
            ),
        )

    return rows.select("doc_id", "nth", "path", F.explode(_bound(parts, dressed)).alias("c")).select("doc_id", "nth", "c.part", "path", "c.key", "c.value", "c.before", "c.after")


def described(rows: DataFrame, dictionary: list[str], pairs: dict[str, float]) -> DataFrame:
    """rows with the columns of FEATURES."""
    v, size = F.col("value"), F.length("value")
    share = lambda kind: F.regexp_count(v, F.lit(kind)) / size
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, r"[^A-Za-z0-9]", "#"), "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "9")
    known = F.array(*map(F.lit, dictionary)) if dictionary else F.array().cast("array<string>")
    likely = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    pieces = F.filter(F.split(F.lower(v), r"[^\p{L}]+"), lambda p: F.length(p) >= 3)
    clean = lambda c: F.regexp_replace(F.lower(F.col(c)), r"^[^\p{L}]+|[^\p{L}]+$", "")
    flag = lambda c: c.cast("double")
    return rows.select(
        "*",
        size.cast("double").alias("size"),
        share("[0-9]").alias("digits"),
        share("[A-Z]").alias("upper"),
        share("[a-z]").alias("lower"),
        F.length(F.regexp_replace(F.array_join(F.array_sort(F.array_distinct(F.split(shape, ""))), ""), " ", "")).cast("double").alias("kinds"),
        (F.size(F.array_distinct(F.split(v, ""))) / size).alias("distinct"),
        ((F.length(F.regexp_replace(shape, r"(.)\1+", "$1")) - 1) / size).alias("turns"),
        (F.aggregate(_pairs(v), F.lit(0.0), lambda a, p: a + F.coalesce(F.try_element_at(likely, p), F.lit(-8.0))) / (size + 1)).alias("transition"),
        (F.aggregate(F.filter(pieces, lambda p: F.array_contains(known, p)), F.lit(0), lambda a, p: a + F.length(p)) / size).alias("covered"),
        flag(F.col("key") != "").alias("assigned"),
        flag(F.col("key").rlike(KEY_NAMES)).alias("named"),
        flag(F.lower("path").rlike(TEST_PATHS)).alias("test_path"),
        flag(F.array_contains(known, clean("before"))).alias("before_known"),
        flag(F.array_contains(known, clean("after"))).alias("after_known"),
        flag(v.rlike("^[0-9a-fA-F]+$")).alias("hex"),
    )


def planted(docs: DataFrame, carriers: int = CARRIERS, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """Findings (as ``candidates`` gives them) of values planted between words of some documents, with label 1.0 for secrets.

    doc_id names the carrier and the kind; every carrier gets each kind once.
    """
    least = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("carrier"))
    least = least.where(in_front(F.xxhash64("carrier"), carriers, docs.count())).orderBy(F.xxhash64("carrier"), "carrier").limit(carriers).distinct()
    texts = docs.select(F.col(id_col).alias("carrier"), F.col(text_col).alias("text"), F.coalesce(F.col(path_col), F.lit("")).alias("path")).join(F.broadcast(least), "carrier")
    start = F.pmod(F.xxhash64("carrier"), F.greatest(F.size("w") - 5, F.lit(1))).cast("int") + 1
    # a word that may itself be a candidate is left out
    near = F.transform(F.slice("w", F.col("start"), 5), lambda x: F.when(F.length(x) < SHORTEST, x).otherwise(""))
    rows = texts.withColumn("w", F.split("text", SPACES)).withColumn("start", start).select("carrier", "path", near.alias("w"))
    word = lambda k: F.coalesce(F.try_element_at("w", F.lit(k)), F.lit(""))
    plain = lambda k: F.concat(F.lit("part"), F.regexp_replace(F.lower(word(k)), r"[^a-z]", ""))
    r = lambda kind: F.sha2(F.concat_ws("/", F.col("carrier").cast("string"), F.lit(kind)), 512)
    pick = lambda kind, xs: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(F.xxhash64(r(kind)), F.lit(len(xs))) + 1).cast("int"))
    hexes = lambda kind, *sizes: F.substr(r(kind), F.lit(1), pick(kind, sizes))
    base = lambda kind: F.regexp_replace(F.base64(F.unhex(r(kind))), r"\s", "")
    mixed = lambda kind: F.regexp_replace(base(kind), "[^A-Za-z0-9]", "")
    letters = lambda kind: F.regexp_replace(base(kind), "[^A-Za-z]", "")
    digits = lambda kind: F.translate(r(kind), "abcdef", "012345")
    cut = lambda c, a, n: F.substr(c, F.lit(a), F.lit(n) if isinstance(n, int) else n)
    text = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    size = lambda kind, lo, hi: (F.pmod(F.xxhash64(r(kind)), F.lit(hi - lo)) + lo).cast("int")
    uuid = text(cut(r("uuid"), 1, 8), "-", cut(r("uuid"), 9, 4), "-4", cut(r("uuid"), 13, 3), "-a", cut(r("uuid"), 16, 3), "-", cut(r("uuid"), 19, 12))
    key = lambda kind: pick(kind + "k", KEYS)
    other = lambda kind: pick(kind + "k", OTHER_KEYS)
    secrets = {
        "hex_quoted": text(key("s1"), ' = "', hexes("s1", 32, 40, 48, 64), '"'),
        "hex_json": text('{"user":"', word(2), '","', key("s2"), '":"', hexes("s2", 32, 40, 64), '"}'),
        "base64": text(key("s3"), "=", cut(base("s3"), 1, size("s3", 24, 60))),
        "query": text("https://", plain(1), ".example/v1?", key("s4"), "=", cut(mixed("s4"), 1, size("s4", 20, 40))),
        "password": text(key("s5"), ": ", cut(mixed("s5"), 1, size("s5", 12, 20))),
        "letters": text(key("s6"), "=", cut(letters("s6"), 1, size("s6", 14, 28))),
        "access_id": text("AKIA", F.upper(cut(mixed("s7"), 1, 16))),
        "personal": text("ghp_", cut(mixed("s8"), 1, 36)),
        "live": text(key("s9"), " = 'sk_live_", cut(mixed("s9"), 1, 24), "'"),
        "signed": text("Authorization: Bearer eyJ", cut(mixed("s10"), 1, 20), ".eyJ", cut(mixed("s11"), 1, 40), ".", cut(mixed("s12"), 1, 43)),
    }
    alike = {
        "number": cut(digits("a1"), 1, 16),
        "order": text(other("a2"), "=", cut(digits("a2"), 1, size("a2", 12, 20))),
        "uuid": text(other("a3"), "=", uuid),
        "uuid_bare": uuid,
        "digest": text(other("a4"), ' = "', hexes("a4", 32, 40, 64), '"'),
        "digest_bare": text("commit ", hexes("a5", 40)),
        "integrity": text('"integrity": "sha512-', cut(base("a6"), 1, 60), '"'),
        "placeholder": text(key("a7"), "=", pick("a7", ["your-secret-key-here", "xxxxxxxxxxxxxxxxxxxx", "replace_me_please", "changeme-changeme", "example-password-1", "TODO-insert-token-2"])),
        "filled": text(key("a8"), ' = "', F.repeat(pick("a8", ["0", "1", "x", "ab", "123", "A"]), 12), '"'),
        "named": text(key("a9"), ": ", plain(1), "_", plain(2), "_", plain(3), cut(digits("a9"), 1, 1)),
        "identifier": text(other("a10"), "=", plain(1), "-", plain(2), "-", plain(4), cut(digits("a10"), 1, 2)),
        "path": text("/usr/lib/", plain(1), "/", plain(2), cut(digits("a11"), 1, 1), "/", plain(3)),
        "dated": text("release-20", cut(digits("a12"), 1, 2), "-0", cut(digits("a12"), 3, 1), "-1", cut(digits("a12"), 4, 1), "-", plain(2)),
        "phone": text("tel=+1-", cut(digits("a13"), 1, 3), "-", cut(digits("a13"), 4, 3), "-", cut(digits("a13"), 7, 4)),
    }
    kinds = [F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"), value.alias("value")) for label, group in ((1.0, secrets), (0.0, alike)) for kind, value in group.items()]
    made = rows.select("path", "w", "carrier", F.explode(F.array(*kinds)).alias("k")).select(
        F.concat_ws("/", F.col("carrier").cast("string"), "k.kind", F.col("k.label").cast("int").cast("string")).alias("doc_id"),
        F.concat_ws(" ", word(1), word(2), "k.value", word(5)).alias("text"),
        F.col("path").alias("source"),
    )
    # few rows with long expressions: dealt out before they are evaluated
    return candidates(made.repartition(32, "doc_id")).withColumn("label", F.substring_index("doc_id", "/", -1).cast("double"))


def _tree(node, features: list[str]) -> Column:
    """A tree's share of secrets as an expression."""
    if node.getClass().getSimpleName() == "LeafNode":
        stats = list(node.impurityStats().stats())
        return F.lit(float(stats[1] / max(sum(stats), 1e-12)))
    split = node.split()
    return F.when(F.col(features[split.featureIndex()]) <= F.lit(float(split.threshold())), _tree(node.leftChild(), features)).otherwise(_tree(node.rightChild(), features))


def forest(labelled: DataFrame, rows: int = ROWS) -> Column:
    """The mean of the trees' shares, trained on at most ``rows`` findings of each label."""
    some = [labelled.where(F.col("label") == y).orderBy(F.xxhash64("doc_id", "nth", "value"), "doc_id", "nth", "part").limit(rows).select("label", *FEATURES) for y in (0.0, 1.0)]
    sample = some[0].unionAll(some[1])
    there = {r[0] for r in sample.select("label").distinct().collect()}
    if there != {0.0, 1.0}:
        return F.lit(1.0 if there == {1.0} else 0.0)
    # a fixed order of the training rows makes the bootstrap the same in every run
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample).select("label", "features")
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(vectors.coalesce(1))
    trees = [_tree(t._java_obj.rootNode(), FEATURES) for t in model.trees]
    total = trees[0]
    for t in trees[1:]:
        total = total + t
    return total / len(trees)


def scan(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """Each candidate with its score and whether it is taken for a secret (score 0.5 or more).

    findings, if given, has doc_id, nth and label (0.0 or 1.0), and part where a
    word has several; without part they are of a word's first candidate.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    words = vocabulary(docs, scratch, text_col)
    dictionary = [r[0] for r in words.where(F.length("word") >= 3).orderBy(F.desc("n"), "word").limit(WORDS).collect()]
    pairs = transitions(words)
    rows = scratch.keep(described(candidates(docs, id_col, text_col, path_col), dictionary, pairs))
    if findings is None:
        labelled = scratch.keep(described(planted(docs, CARRIERS, id_col, text_col, path_col), dictionary, pairs))
    else:
        part = F.col("part") if "part" in findings.columns else F.lit(1)
        labelled = rows.join(findings.select("doc_id", "nth", part.alias("part"), "label"), ["doc_id", "nth", "part"])
    score = forest(labelled)
    return rows.withColumn("score", score).withColumn("secret", F.col("score") >= 0.5)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("nth").cast("long").alias("nth"), F.col("part").cast("long").alias("part"), F.length("value").cast("long").alias("length"), F.sha2("value", 256).alias("value_sha256"), "key", "score", "secret")
