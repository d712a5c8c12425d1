"""Secret scans: a random forest takes the false positives out of what a pattern finds.

Candidates are runs of 16 or more letters, digits and ``_ + / -`` in whole texts, and values of 6 or more characters
that follow a password-like name and ``=`` or ``:`` (to the closing quote, or unquoted to white space, quotes, brackets,
``, ;`` and the ``&`` of a query string).  Before and behind a candidate is the text there, also where it belongs to another one.  Each gets its length,
shares of character kinds, transitions between kinds, coverage by the letter trigrams of the words
around all findings (the dictionary), marks of its path and of the words before and behind it.

``label_findings`` labels the findings that a strict rule decides: known key formats and values assigned
to a password-like name are secrets, plain words and plain numbers that are not assigned are none.
The forest (``pyspark.ml``, a DataFrame API) is fitted on at most ``train_rows`` labelled findings (a
documented bound, first by hash) and scores every finding, labelled or not.

Only DataFrame and SQL functions.  Matches are exploded per text and ordered within it; nothing is
grouped by a key that many texts share, except sums with map-side combine.

Results: null and empty texts have no findings; repeated rows each have their own; a null path or
id is allowed; without two classes of labelled findings no forest is fitted and the score is the rule's label
(0.0 where the rule leaves it open); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldframe.llm.common import Scratch, sheltered, table

CANDIDATE = r"[A-Za-z0-9_+/\-]{16,}={0,2}"
_NAMES = r"(?i)(password|passwd|pwd|passphrase|token|secret|api[_-]?key|access[_-]?key|private[_-]?key|credential|bearer|auth)"
# a value's first character follows name, = or : and perhaps a quote; the first look behind only saves the second
_NOT = r"\s\"'`,;<>()\[\]{}"  # what an unquoted value does not hold
_VALUE = (r"(?<=[:=>\s\"'])(?<=" + _NAMES.replace("(?i)(", "(?i:") + r"\w{0,24}[\"']?\s{0,3}(?:=>|:=|[:=])\s{0,3}[\"']?)"
          r"(?:(?<=\")[^\"\s]{6,}(?=\")|(?<=')[^'\s]{6,}(?=')"
          rf"|(?![^{_NOT}]*&\w+=)[^{_NOT}:=][^{_NOT}]{{4,}}[^{_NOT}.:?]|[^{_NOT}&:=][^{_NOT}&]{{4,}}[^{_NOT}&.:?])")
#: What findings are, in Java's syntax.
FINDING = f"{_VALUE}|{CANDIDATE}"
_ASSIGNED = _NAMES + r"\w*[\"']?\s*([:=]|=>|\s)\s*[\"']?$"
_FORMATS = r"^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{30,}$|^xox[abprs]-|^sk_(live|test)_|^eyJ[A-Za-z0-9_\-]{20,}"
_DIGESTS = r"(?i)(sha-?\d*|md5|commit|digest|checksum|hash|uuid|etag)\W*$"
FEATURES = ["f_length", "f_digits", "f_upper", "f_vowels", "f_moves", "f_distinct", "f_hex", "f_covered", "f_path_test",
            "f_path_depth", "f_named", "f_equals", "f_quoted", "f_digest", "f_joined", "f_format"]


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """One row per candidate: id, text_hash, nth (from 0), start (characters before it), found, before, behind, path."""
    text = F.col("t")
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), path.alias("path")).where(text.rlike(FINDING))
    d = d.select("id", "path", F.monotonically_increasing_id().alias("row"), F.xxhash64("t").alias("text_hash"),
                 F.split("t", FINDING, -1).alias("gaps"), F.regexp_extract_all("t", F.lit(f"({FINDING})")).alias("hits"))
    # the text in pieces: gap, hit, gap, ...; hits have 6 or more characters, so 11 of them fill 64 and 6 fill 32
    d = d.withColumn("pieces", F.flatten(F.zip_with("gaps", "hits", lambda g, h: F.array(g, F.coalesce(h, F.lit(""))))))
    gap = lambda i: F.get(F.col("gaps"), i)
    first = lambda i: F.greatest(2 * i - 21, F.lit(1))
    before = lambda i: F.array_join(F.slice("pieces", first(i), 2 * i + 2 - first(i)), "")
    behind = lambda i: F.array_join(F.slice("pieces", 2 * i + 3, F.lit(13)), "")
    d = d.select("id", "path", "row", "text_hash", F.explode(F.transform("hits", lambda h, i: F.struct(
        i.alias("nth"), h.alias("found"), F.right(before(i), F.lit(64)).alias("before"), F.left(behind(i), F.lit(32)).alias("behind"),
        F.length(gap(i)).alias("gap")))).alias("x")).select("id", "path", "row", "text_hash", "x.*")
    upto = Window.partitionBy("row").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("start", F.sum(F.col("gap") + F.length("found")).over(upto) - F.length("found")).select(
        "id", "text_hash", "nth", "start", "found", "before", "behind", "path")


def _share(kept: str) -> Column:
    return F.length(F.regexp_replace("found", f"[^{kept}]", "")) / F.length("found")


def with_features(found: DataFrame, dictionary_size: int = 1500) -> DataFrame:
    """Adds the features.  The dictionary is the ``dictionary_size`` (a bound) most frequent letter
    trigrams of the words before and behind all findings."""
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, F.lit(3)))
    letters = F.lower(F.concat_ws(" ", "before", "behind"))
    around = found.where(F.length(letters) >= 3).select(F.explode(grams(letters)).alias("gram")).where(F.col("gram").rlike(r"^\p{L}{3}$"))
    known = around.groupBy("gram").count().orderBy(F.desc("count"), "gram").limit(dictionary_size).select("gram")
    words = found.select("found").distinct()
    covered = (words.select("found", F.explode(grams(F.lower("found"))).alias("gram")).join(F.broadcast(known), "gram")
               .groupBy("found").agg(F.count("*").alias("n")))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(
        "found", "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "9"), "[^aB9]", "-")
    moves = F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return (found.join(covered, "found", "left")
            .withColumn("f_length", F.length("found").cast("double"))
            .withColumn("f_digits", _share("0-9")).withColumn("f_upper", _share("A-Z")).withColumn("f_vowels", _share("aeiouAEIOU"))
            .withColumn("f_moves", moves / F.length("found"))
            .withColumn("f_distinct", F.size(F.array_distinct(F.split("found", ""))).cast("double"))
            .withColumn("f_hex", flag(F.col("found").rlike("^[0-9a-f]+$|^[0-9A-F]+$")))
            .withColumn("f_covered", F.coalesce(F.col("n"), F.lit(0)) / (F.length("found") - 2)).drop("n")
            .withColumn("f_path_test", flag(F.lower("path").rlike("test|example|sample|fixture|mock|doc")))
            .withColumn("f_path_depth", F.coalesce(F.length(F.regexp_replace("path", "[^/]", "")), F.lit(0)).cast("double"))
            .withColumn("f_named", flag(F.col("before").rlike(_ASSIGNED)))
            .withColumn("f_equals", flag(F.col("before").rlike(r"[:=]\s*[\"']?$")))
            .withColumn("f_quoted", flag(F.col("before").rlike(r"[\"'`]$") & F.col("behind").rlike(r"^[\"'`]")))
            .withColumn("f_digest", flag(F.col("before").rlike(_DIGESTS)))
            .withColumn("f_joined", flag(F.col("before").rlike(r"[.@%&]$") | F.col("behind").rlike(r"^[.@%&]\w")))
            .withColumn("f_format", flag(F.col("found").rlike(_FORMATS))))


def label_findings(found: DataFrame) -> DataFrame:
    """Adds ``label``: 1 or 0 where the strict rule decides, else null."""
    named = (F.col("f_named") == 1) & (F.col("f_digits") > 0) & (F.col("f_digits") < 1)
    plain = ((F.col("f_digits") == 0) | (F.col("f_digits") == 1)) & (F.col("f_named") == 0) & (F.col("f_format") == 0)
    return found.withColumn("label", F.when((F.col("f_format") == 1) | named, 1.0).when(plain | (F.col("f_digest") == 1), 0.0))


def fit_forest(labelled: DataFrame, scratch: Scratch, train_rows: int = 20_000, trees: int = 24, depth: int = 6,
               seed: int = 13) -> RandomForestClassificationModel | None:
    """The forest, or None if the labelled findings don't show both classes."""
    own = labelled.where("label is not null").select("label", *FEATURES, F.xxhash64("id", "found", "before", "nth").alias("h"))
    # at most train_rows rows, in one file and in a fixed order, so that reruns fit the same trees
    train = scratch.write(own.orderBy("h", "label", *FEATURES).limit(train_rows).coalesce(1), "train")
    if train.select("label").distinct().count() < 2:
        return None
    return RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed
                                  ).fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(train))


def score_findings(docs: DataFrame, scratch: Scratch, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
                   path_col: str | None = "source", **options) -> DataFrame:
    """Every finding with label, score and is_secret."""
    found = scratch.write(findings(docs, id_col, text_col, path_col), "found")
    rows = scratch.write(label_findings(with_features(found)), "features")
    model = fit_forest(rows, scratch, **options)
    if model is None:
        scored = rows.withColumn("score", F.coalesce("label", F.lit(0.0)))
    else:
        scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)).withColumn(
            "score", vector_to_array("probability")[1])
    return scored.withColumn("is_secret", F.col("score") >= threshold).select(
        "id", "text_hash", "nth", "start", "found", "label", "score", "is_secret")


def redact(docs: DataFrame, scored: DataFrame, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every secret replaced; rows without candidates are not shuffled."""
    secret = scored.where("is_secret").groupBy(F.col("id").alias("_id"), F.col("text_hash").alias("_h")).agg(
        F.collect_set("nth").alias("_nth"))
    names, docs = docs.columns, sheltered(docs, id_col, text_col)
    has = F.coalesce(F.col(text_col).rlike(FINDING), F.lit(False))
    rows = docs.where(has).join(secret, F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(text_col) == F.col("_h")), "left")
    gaps, hits = F.split(text_col, FINDING, -1), F.regexp_extract_all(text_col, F.lit(f"({FINDING})"))
    put = F.concat(F.transform(hits, lambda h, i: F.when(F.array_contains("_nth", i), F.lit(mark)).otherwise(h)), F.array(F.lit("")))
    text = F.when(F.col("_nth").isNull(), F.col(text_col)).otherwise(
        F.array_join(F.zip_with(gaps, put, lambda g, h: F.concat(g, h)), ""))
    return rows.withColumn(text_col, text).select(*docs.columns).unionByName(docs.where(~has)).toDF(*names)


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with the findings that the forest calls secrets replaced by ``mark``."""
    return redact(docs, score_findings(docs, Scratch(docs.sparkSession, "secrets"), **options), mark)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_findings(table(spark, sf_dir, "documents"), Scratch(spark, "secrets"))
    return scored.select(F.col("id").alias("doc_id"), "nth", "start", F.length("found").alias("length"),
                         F.sha2("found", 256).alias("found_sha256"), F.col("label").cast("int").alias("label"), "score", "is_secret")
