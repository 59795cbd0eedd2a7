"""Secret scans: candidates by pattern, and a random forest that removes false findings. DataFrame operations only."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriskill.llm.common import written

#: A candidate: a cloud access key, the value given to a secret-like name, or a long unbroken run with a digit.
NAMED = r"(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)"
GIVEN = rf"{NAMED}[\"']?\s*[=:]"  # a name, the quote that closes it if any, and the sign
CANDIDATE = rf"(?<![A-Za-z0-9])AKIA[0-9A-Z]{{16}}(?![0-9A-Z])|(?i:(?<![A-Za-z]){GIVEN}\s?[\"']?)[^\s\"',;]{{8,}}|(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{{20,}}"
NEAR = 32  # characters of neighbouring text
SHORTEST = 12  # characters of the shortest candidate: pwd= and eight more
MASK = "[SECRET]"

#: Common words (English, German, French, Spanish, and of code) by which dictionary coverage is measured.
DICTIONARY = tuple(
    """the and that this with from have were which there their would about other example sample test password secret token
    change value user name file path index page node item data code text null true false default config new old first last
    time date year day week month hour list table column row key word line number count size length start end begin stop
    open close read write load save send get set put add remove delete update create build run make call return class
    function method object string array map type error warning info debug log report message event request response server
    client host port local remote public private admin root system service account login session cookie cache queue image
    video audio music book story people world house water school work home country state city street north south east west
    black white green small large high low long short good great best only also into over under after before between
    der die das und nicht mit von ist wir sie ein eine les des une est pas que pour dans sur los las una por con para del sin""".split()
)

FEATURES = ("length", "transitions", "digit_share", "upper_share", "lower_share", "distinct_share", "covered", "hex_only", "key_prefix", "named", "near_name", "near_commit", "near_trial", "path_trial", "placeholder")


def _share(value: Column, drop: str) -> Column:
    return 1.0 - F.length(F.regexp_replace(value, drop, "")) / F.greatest(F.length(value), F.lit(1))


def bare_value(match: Column) -> Column:
    """A candidate without the name that it is given to."""
    return F.regexp_replace(match, rf"^(?i:{GIVEN}\s?[\"']?)", "")


def with_features(found: DataFrame, dictionary: tuple[str, ...] = DICTIONARY) -> DataFrame:
    """Adds the columns of `FEATURES` to rows of (match, before, after, path)."""
    value = bare_value(F.col("match"))
    classes = F.translate(value, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "a" * 26 + "A" * 26 + "0" * 10)
    words = "(?i:" + "|".join(w for w in dictionary if len(w) > 2) + ")"
    path = F.coalesce(F.col("path"), F.lit(""))
    flag = lambda c: c.cast("double")
    cols = {
        "length": F.length(value).cast("double"),
        "transitions": F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) / F.greatest(F.length(value), F.lit(1)),
        "digit_share": _share(value, "[0-9]"),
        "upper_share": _share(value, "[A-Z]"),
        "lower_share": _share(value, "[a-z]"),
        "distinct_share": F.size(F.array_distinct(F.split(value, ""))) / F.greatest(F.length(value), F.lit(1)),
        "covered": _share(value, words),
        "hex_only": flag(value.rlike("^[0-9a-f]+$")),
        "key_prefix": flag(value.rlike("^(AKIA|ghp_|sk-|xox|eyJ)")),
        "named": flag(F.col("match").rlike(rf"^(?i:{GIVEN})")),
        "near_name": flag(F.col("before").rlike(rf"(?i:{NAMED})\W*$")),
        "near_commit": flag(F.col("before").rlike(r"(?i:commit|sha|rev|revision|checksum|md5|etag|uuid|id|isbn|build)\W*$")),
        "near_trial": flag(F.concat_ws(" ", "before", "after").rlike(r"(?i:\b(?:example|sample|dummy|fake|placeholder|checksum|digest|hash|commit|revision|not a secret)\b)")),
        "path_trial": flag(path.rlike("(?i:test|example|sample|mock|fixture|doc)")),
        "placeholder": flag(value.rlike("(?i:example|changeme|placeholder|your|xxxx|dummy|redacted|\\*\\*\\*|^<|\\$\\{)")),
    }
    return found.withColumns({k: v.cast("double") for k, v in cols.items()})


def labelled_findings(spark: SparkSession, rows: int = 6_000) -> DataFrame:
    """Labelled findings made by rule from hashes: (match, before, after, path, label), as many of each kind.

    True ones: access keys, hex and base-64 values of secret-like names, bare tokens. False ones: commit ids and
    checksums, placeholders, dates and numbers, slugs of words, file paths, example keys.
    """
    h = lambda salt: F.sha2(F.concat(F.col("id").cast("string"), F.lit(salt)), 256)
    hexed = lambda n, salt="a": F.substr(h(salt), F.lit(1), F.lit(n))
    b64 = F.regexp_replace(F.base64(F.unhex(h("b"))), "=", "")
    word = lambda salt: F.element_at(F.array(*map(F.lit, DICTIONARY)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(DICTIONARY))) + 1).cast("int"))
    akia = F.concat(F.lit("AKIA"), F.substr(F.translate(F.upper(F.concat(b64, F.regexp_replace(F.base64(F.unhex(h("c"))), "=", ""))), "+/0189", "ABCDEF"), F.lit(1), F.lit(16)))
    names = ("password=", "token = \"", "secret: ", "api_key=", "pwd=")
    name = F.element_at(F.array(*map(F.lit, names)), (F.pmod(F.xxhash64("id", F.lit("n")), F.lit(len(names))) + 1).cast("int"))
    kinds = [
        (1, akia, F.concat(word("x"), F.lit(" "))),
        (1, F.concat(name, hexed(18)), F.concat(word("x"), F.lit(" "))),
        (1, F.concat(name, hexed(40)), F.concat(word("x"), F.lit(" "))),
        (1, F.concat(name, F.substr(b64, F.lit(1), F.lit(24))), F.concat(word("x"), F.lit(", "))),
        (1, b64, F.lit("secret key ")),
        (1, F.concat(F.lit("ghp_"), F.substr(b64, F.lit(1), F.lit(36))), F.concat(word("x"), F.lit(" "))),
        (0, hexed(40), F.lit("commit ")),
        (0, hexed(32), F.lit("md5 checksum ")),
        (0, F.concat(name, F.lit("changeme"), (F.col("id") % 100).cast("string")), F.concat(word("x"), F.lit(" "))),
        (0, F.concat(name, F.lit("<your-"), word("y"), F.lit("-here>")), F.concat(word("x"), F.lit(" "))),
        (0, F.concat(F.lit("20"), F.lpad((F.col("id") % 30).cast("string"), 2, "0"), F.lit("-01-02_"), F.lpad(F.col("id").cast("string"), 12, "0")), F.lit("build ")),
        (0, F.concat(word("p"), F.lit("-"), word("q"), F.lit("-"), word("r"), F.lit("-"), word("s"), F.lit("-"), (F.col("id") % 1000).cast("string")), F.concat(word("x"), F.lit(" "))),
        (0, F.concat(F.lit("/"), word("p"), F.lit("/"), word("q"), F.lit("/"), word("r"), F.lit("/"), (F.col("id") % 1000).cast("string")), F.lit("in ")),
        (0, F.concat(F.lit("AKIA"), F.upper(hexed(9)), F.lit("EXAMPLE")), F.concat(word("x"), F.lit(" "))),
    ]
    pick = F.pmod(F.col("id"), F.lit(len(kinds)))
    case = lambda k: F.coalesce(*(F.when(pick == i, kind[k] if k else F.lit(kind[0])) for i, kind in enumerate(kinds)))
    one_of = lambda some, salt: F.element_at(F.array(*map(F.lit, some)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(some))) + 1).cast("int"))
    paths = one_of(("src1", "web/app", "tests/unit", "docs/example"), "path")
    after = F.concat(one_of((" ", ", ", ". ", "\" "), "mark"), F.when(case(0) == 1, word("z")).otherwise(F.when(F.pmod(F.xxhash64("id", F.lit("t")), F.lit(3)) == 0, one_of(("is a sample", "as checksum", "for example"), "trial")).otherwise(word("z"))))
    return spark.range(rows).select(case(1).alias("match"), case(2).alias("before"), after.alias("after"), paths.alias("path"), case(0).alias("label"))


def fit_forest(findings: DataFrame, trees: int = 24, depth: int = 7, seed: int = 11) -> RandomForestClassificationModel:
    """A random forest on (match, before, after, path, label); the labelled findings are few and given by the caller."""
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(with_features(findings).withColumn("label", F.col("label").cast("double")))
    return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(rows)


def candidates(docs: DataFrame, text: str = "text", path: str = "source", key: str = "doc_id") -> DataFrame:
    """key, match, before, after, path for each occurrence of a candidate in each row; those alike in all of them once.

    The text around an occurrence is put together from the matches and the pieces between them: as many matches back
    and on as hold `NEAR` characters, so that the work is in proportion to the occurrences.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), (F.col(path) if path in docs.columns else F.lit(None).cast("string")).alias("path"), F.regexp_extract_all(F.col(text), F.lit(CANDIDATE), F.lit(0)).alias("found"))
    rows = rows.where(F.size("found") > 0).withColumn("between", F.split("text", CANDIDATE)).drop("text")
    reach = -(-NEAR // SHORTEST)

    def one(match: Column, k: Column) -> Column:
        part = lambda c, j: F.coalesce(F.get(c, k + j), F.lit(""))
        before = F.concat(*(part(c, -j) for j in range(reach, 0, -1) for c in ("between", "found")), F.get("between", k))
        after = F.concat(F.get("between", k + 1), *(part(c, j + (c == "between")) for j in range(1, reach + 1) for c in ("found", "between")))
        return F.struct(match.alias("match"), F.right(before, F.lit(NEAR)).alias("before"), F.left(after, F.lit(NEAR)).alias("after"))

    return rows.select("key", "path", F.explode(F.array_distinct(F.transform("found", one))).alias("o")).select("key", "o.match", "o.before", "o.after", "path")


def scan_secrets(docs: DataFrame, model: RandomForestClassificationModel, text: str = "text", path: str = "source", key: str = "doc_id") -> DataFrame:
    """`docs` with n_candidates, secrets (sorted confirmed values) and redacted (text with each of them masked).

    A value is confirmed in a row if any of its occurrences is, with a name or without. Null and empty texts have none,
    and stay as they are. Repeated rows are all kept. Columns of `docs` named as those added are replaced; `path` may be
    missing, and `key` is not looked at. Rows with a candidate are few; they are written with a number of their own, by
    which their candidates come back to them, so that a row has its own ones only and other texts are not shuffled.
    """
    base = docs.drop(*({"n_candidates", "secrets", "redacted"} & set(docs.columns)))
    some = F.coalesce(F.col(text).rlike("AKIA|[0-9]|(?i:" + NAMED + ")") & F.col(text).rlike(CANDIDATE), F.lit(False))
    held = written(base.where(some).withColumn("__row", F.monotonically_increasing_id()), "suspects")  # written: numbers stay as they are
    scored = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(with_features(candidates(held, text, path, "__row"))))
    keep = vector_to_array("probability")[1] >= 0.5
    scored = scored.select("key", "match", bare_value(F.col("match")).alias("value"), keep.alias("keep"))
    per = scored.groupBy("key").agg(F.collect_set(F.struct("match", "value")).alias("__all"), F.collect_set(F.when(F.col("keep"), F.col("value"))).alias("__sure"))
    sure = F.filter("__all", lambda x: F.array_contains(F.col("__sure"), x["value"]))
    per = per.select(F.col("key").alias("__row"), F.size("__all").alias("__n"), F.sort_array(F.transform(sure, lambda x: x["match"])).alias("__s"))
    longest_first = F.array_sort("secrets", lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    with_some = held.join(per, "__row").select(*base.columns, F.col("__n").cast("bigint").alias("n_candidates"), F.col("__s").alias("secrets"))
    with_some = with_some.withColumn("redacted", F.aggregate(longest_first, F.col(text), lambda t, s: F.replace(t, s, F.lit(MASK))))
    without = base.where(~some).select(*base.columns, F.lit(0).cast("bigint").alias("n_candidates"), F.array().cast("array<string>").alias("secrets"), F.col(text).alias("redacted"))
    return with_some.unionByName(without)


def default_model(spark: SparkSession) -> RandomForestClassificationModel:
    return fit_forest(written(labelled_findings(spark), "findings"))
