"""Secret scans in DataFrame functions only: candidates and a random forest that removes false positives.

A candidate is a blank-separated word that, without the punctuation around it, has at least
``LEAST_LENGTH`` characters and a digit, or ``SHORTEST`` characters of any kind where a naming word assigns it (``password: ...``).
Its features: length, changes between kinds of characters,
distinct characters, shares of digits and of hexadecimal digits, the share that dictionary words cover,
path and address signs, and what the two words before and the one after it are. The dictionary is learned from the corpus: the words
that most documents hold.

The forest (``pyspark.ml``) learns from a table of labelled findings, ``label`` 1 for secrets, which ``scored`` takes as it is. The
driver's tables have none, so the query labels findings by rules over the text around them, of several kinds. Secrets: values of published key formats;
32, 40 or 64 hexadecimal digits, or 32 characters of mixed kinds and more, that a naming word assigns. None: numbers, mail
addresses, plain paths and web addresses, identifiers in groups, and digests after words that name a digest or a revision, all where nothing names, assigns or quotes them.
What no rule judges has no label and is not learned from. Findings of documents whose
crc32(doc_id as text) mod 5 is 0 are never learned from.

Defined results: null, empty and word-free texts have no findings; equal findings have equal scores; with
labels of one kind only, all findings have that label's score; a null doc_id is kept.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundtrace.llm.scratch import materialise

LEAST_LENGTH, SHORTEST = 16, 6
#: Labelled findings of each kind that the forest learns from, about: a bounded sample.
SAMPLE = 2000
TREES, DEPTH = 20, 6
#: Words of four letters and more that the learned dictionary holds.
DICTIONARY_WORDS = 2000
#: Words that name a secret when they stand before a candidate.
NAMES = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "key", "auth", "bearer", "credential")
#: Words that name a digest or a revision.
DIGEST_NAMES = ("sha1", "sha256", "md5", "checksum", "digest", "commit", "revision", "etag", "uuid")
# Published formats of keys.
KEY_FORMATS = (r"(?:AKIA|ASIA)[0-9A-Z]{16}", r"gh[pousr]_[0-9A-Za-z]{36}", r"sk_live_[0-9A-Za-z]{24,}", r"xox[abprs]-[0-9A-Za-z-]{10,}", r"AIza[0-9A-Za-z_-]{35}", r"eyJ[0-9A-Za-z_-]+[.]eyJ[0-9A-Za-z_-]+[.][0-9A-Za-z_-]+")
#: Forms that are no secret where nothing around them speaks for one: numbers, mail addresses, web addresses without user, query or random-looking parts, paths, identifiers in groups.
HARMLESS = (
    r"^[0-9][0-9.,:/+-]*$",
    r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}$",
    r"^https?://(?!.*(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{8})[A-Za-z0-9._~/-]+$",
    r"^(?!.*(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{8})[A-Za-z0-9._-]*(?:/[A-Za-z0-9._-]+){2,}$",
    r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
)
#: The name that a candidate without blanks (name="value") is assigned to.
GLUED = r"^([A-Za-z_]+)[=:](?!//)"
NAMED = "(?:" + "|".join(NAMES) + ")"
FEATURES = ("length", "changes", "distinct", "digits", "hexadecimal", "covered", "slashes", "segments", "extension", "dots", "ats", "named", "assigned", "quoted", "digest_before", "number_before", "number_after")


def findings(docs: DataFrame) -> DataFrame:
    """(doc_id, word_no, word, raw, before, before2, after): the candidates with the words around them, as they stand in the text."""
    words = docs.select("doc_id", F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x09-\x0D]", " "), " ").alias("words"))

    def assigned(word: Column, i: Column) -> Column:
        before, before2 = F.coalesce(F.get("words", i - 1), F.lit("")), F.coalesce(F.get("words", i - 2), F.lit(""))
        sign = before.isin("=", ":", "=>", ":=") & before2.rlike(f"(?i){NAMED}[\"'`]?$")
        return sign | before.rlike(f"(?i){NAMED}[\"'`]?[=:]$") | word.rlike(f"(?i)^[\"'`]?[a-z_]*{NAMED}[\"'`]?[=:](?!//).{{{SHORTEST},}}")

    found = F.transform("words", lambda w, i: F.when(F.length(w) >= SHORTEST, F.struct(i.alias("i"), w.alias("w"), assigned(w, i).alias("assigned"))))
    kept = F.filter(found, lambda x: x["assigned"] | ((F.length(x["w"]) >= LEAST_LENGTH) & x["w"].rlike("[0-9]")))
    at = words.select("doc_id", "words", F.explode_outer(kept).alias("x")).filter("x IS NOT NULL")
    bare = F.regexp_replace("x.w", "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "")
    around = [F.coalesce(F.get("words", F.col("x.i") + d), F.lit("")).alias(n) for d, n in ((-1, "before"), (-2, "before2"), (1, "after"))]
    rows = at.select("doc_id", F.col("x.i").cast("long").alias("word_no"), bare.alias("word"), F.col("x.w").alias("raw"), F.col("x.assigned").alias("assigned"), *around)
    return rows.filter((F.col("assigned") & (F.length("word") >= SHORTEST)) | ((F.length("word") >= LEAST_LENGTH) & F.col("word").rlike("[0-9]"))).drop("assigned")


def dictionary(docs: DataFrame, most: int = DICTIONARY_WORDS) -> list[str]:
    """The ``most`` words of four ASCII letters and more that most documents hold. All documents are counted."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+"), lambda w: F.length(w).between(4, 20)))
    counts = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter("n > 1")
    return sorted(r.word for r in counts.orderBy(F.desc("n"), "word").limit(most).collect())


def features(known: list[str] | tuple[str, ...] = ()) -> dict[str, Column]:
    word, length = F.col("word"), F.length("word").cast("double")
    share = lambda pattern: F.regexp_count(word, F.lit(pattern)) / length
    lower = F.lower(F.concat_ws(" ", "before2", "before", F.regexp_extract("word", GLUED, 1)))
    flag = lambda condition: F.when(condition, 1.0).otherwise(0.0)
    runs = F.regexp_extract_all(F.lower(word), F.lit("([a-z]{4,})"))
    covered = F.aggregate(F.filter(runs, lambda w: w.isin(*known)) if known else F.array().cast("array<string>"), F.lit(0), lambda n, w: n + F.length(w))
    return {
        "length": length,
        "changes": share("(?<=[0-9])(?![0-9])(?!$)|(?<=[a-z])(?![a-z])(?!$)|(?<=[A-Z])(?![A-Z])(?!$)|(?<=[^0-9A-Za-z])(?=[0-9A-Za-z])"),
        "distinct": F.size(F.array_distinct(F.split(word, ""))) / length,
        "digits": share("[0-9]"),
        "hexadecimal": share("[0-9a-fA-F]"),
        "covered": covered / length,
        "slashes": share("/"),
        "segments": F.regexp_count(word, F.lit("[/\\\\][A-Za-z0-9._-]+")).cast("double"),
        "extension": flag(word.rlike("[.][A-Za-z]{2,5}$")),
        "dots": share("[.]"),
        "ats": share("@"),
        "named": flag(lower.rlike("|".join(NAMES))),
        "assigned": flag(F.col("before").rlike("[=:]$") | word.rlike(GLUED)),
        "quoted": flag(F.col("raw").rlike("^[\"'`]") | word.rlike(GLUED + "[\"'`]")),
        "digest_before": flag(lower.rlike("|".join(DIGEST_NAMES))),
        "number_before": flag(F.col("before").rlike("^[0-9]+$")),
        "number_after": flag(F.col("after").rlike("^[0-9]+$")),
    }


def rule_label() -> Column:
    """The rules that stand for a reviewer of findings: 1, 0, or null for those that they can't judge."""
    value = F.regexp_replace("word", f"(?i)^[a-z_]*{NAMED}[\"'`]?[=:][\"'`]?", "")
    told = features()
    given = (told["named"] == 1) & (told["assigned"] == 1) & (told["digest_before"] == 0)
    mixed = value.rlike("^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_=-]{32,}$")
    secret = value.rlike("^(?:" + "|".join(KEY_FORMATS) + ")$") | (given & (mixed | value.rlike("^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})$")))
    plain = (told["named"] == 0) & (told["assigned"] == 0) & (told["quoted"] == 0)
    digest = (told["named"] == 0) & (told["digest_before"] == 1) & F.col("word").rlike("^[0-9a-fA-F]{16,}$")
    return F.when(secret, 1).when(digest | (plain & F.col("word").rlike("|".join(HARMLESS))), 0)


def learned_from(doc_id: Column | str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 != 0


def scored(found: DataFrame, labelled: DataFrame, known: list[str] | tuple[str, ...] = (), sample: int = SAMPLE) -> DataFrame:
    """``found`` with ``score``, by a forest learned from ``labelled``, findings with ``label``; ``known``: the dictionary."""
    counts = {r[0]: r[1] for r in labelled.groupBy("label").count().collect() if r[0] is not None}
    if len(counts) < 2:
        return found.withColumn("score", F.lit(float(next(iter(counts), 0))))
    share = F.coalesce(*[F.when(F.col("label") == k, F.lit(int(1_000_000 * min(1.0, sample / n)))) for k, n in sorted(counts.items())], F.lit(0))
    chosen = labelled.filter(F.pmod(F.xxhash64("doc_id", "word_no", "word"), F.lit(1_000_000)) < share)
    vector = array_to_vector(F.array(*features(known).values()))
    rows = materialise(chosen.select(F.col("label").cast("double").alias("label"), vector.alias("features"), F.xxhash64("doc_id", "word_no", "word").alias("tie")), "labelled")
    rows = rows.coalesce(1).sortWithinPartitions("tie").select("label", "features")  # bounded by the sample; the order fixes the trees' bootstrap
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=17).fit(rows)
    judged = forest.transform(found.select(F.struct("*").alias("row"), vector.alias("features")))
    return judged.select("row.*", vector_to_array("probability")[1].alias("score"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = materialise(findings(docs), "findings")
    labelled = found.filter(learned_from()).withColumn("label", rule_label())
    judged = scored(found, labelled, dictionary(docs))
    return judged.select(
        "doc_id",
        "word_no",
        F.sha2("word", 256).alias("word_sha256"),
        F.length("word").cast("long").alias("length"),
        (~learned_from()).alias("held_out"),
        F.round("score", 6).alias("score"),
        (F.col("score") >= 0.5).cast("int").alias("is_secret"),
    )
