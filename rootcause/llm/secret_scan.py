"""Secret scans whose false positives a random forest removes, in DataFrame
functions only.

A candidate is a run of at least 12 letters, digits and ``_ + / -`` that holds
a digit, any value that a credential word and ``:``, ``=``, ``is`` or ``was``
stand before (a quoted one with its blanks), the text of a tag named by a
credential word, the password of a URL, a whole private key block, or a key in
a provider's format. Its features are its length, shares of character classes and
transitions between them, the share of its letters that dictionary words
cover, signs of a path, and the words beside it. The dictionary are the words
of the scanned corpus: a part of a candidate is a word when enough documents
hold it on its own. The forest is trained on labelled findings: by default a
bank made by rule (secrets beside credential words or in a provider's format;
numbers, UUIDs, digests, paths and identifiers beside other words), or the
caller's own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rootcause.llm.licenses import LOWER, UPPER, lowered
from rootcause.llm.tables import stage_table, with_ids

_CREDENTIAL = "password|passwd|pwd|secret|token|credential|api.?key|access.?key|private.?key|auth"
CREDENTIAL = rf"(?i)({_CREDENTIAL})"
_NAMED = rf"(?i:{_CREDENTIAL})\w{{0,16}}"
_VALUE = r"[^\s\"']*[^\s\"'.,;:)\]}]"
#: The cheap look back goes before the long one at the credential word.
_ASSIGNED = (r"(?<=[:=\s\"'])(?![:=])(?<=[:=]\s{0,8}[\"']?)"
             rf"(?<={_NAMED}[\"']?\s{{0,8}}[:=]\s{{0,8}}[\"']?)" + _VALUE)
_QUOTED = "|".join(rf"(?<={q})(?<={_NAMED}[\"']?\s{{0,8}}[:=]\s{{0,8}}{q})[^{q}\s][^{q}\n]*(?={q})" for q in "\"'")
_SAID = rf"(?<=(?:is|was)\s{{1,4}})(?<={_NAMED}\s{{1,4}}(?:is|was)\s{{1,4}}[\"']?)" + _VALUE
_TAGGED = rf"(?<=>)(?<=<\w{{0,16}}{_NAMED}>)[^<\s][^<]*(?=</)"
_IN_URL = r"(?<=[^\s/:@]:)(?=[^\s/@]+@)(?<=://[^\s/:@]{1,64}:)[^\s/@]+"
_KEY_BLOCK = (r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:\s{0,4}[A-Za-z\-]{1,20}:[^\n]*\n){0,4}[A-Za-z0-9+/=\s\\]*+"
              r"-----END [A-Z ]{0,40}PRIVATE KEY-----")
_PROVIDER = (r"(?<![A-Za-z0-9_+/\-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9_+/\-])|gh[pousr]_[A-Za-z0-9]{20,}|sk_live_[A-Za-z0-9]{10,}"
             r"|xox[abps]-[A-Za-z0-9\-]{10,})")
_RUN = r"(?<![A-Za-z0-9_+/\-])(?=[A-Za-z_+/\-]*+[0-9])[A-Za-z0-9_+/\-]{12,}={0,2}"
CANDIDATE = "|".join((_KEY_BLOCK, _QUOTED, _ASSIGNED, _SAID, _TAGGED, _IN_URL, _PROVIDER, _RUN))
#: Words beside identifiers that are no secrets.
HARMLESS = r"(?i)(commit|sha.?1|sha.?256|md5|checksum|digest|revision|uuid|guid|order|invoice|card|phone|version|file|path|example)"
#: Words of sentences, rare in pass phrases.
COMMON = r"(?i)(?<![a-z])(?:the|a|an|is|are|be|to|of|in|on|for|and|or|not|must|your|you|this|that|with|at|by|it|as|from|was|will)(?![a-z])"
PLACEHOLDER = "<SECRET>"
#: Characters on either side that count as the neighbourhood.
NEAR = 40
#: Documents that must hold a word on its own for it to be in the dictionary.
WORD_DOCS = 3
BANK_ROWS = 4000
#: Words of candidates that may be broadcast, a few tens of bytes each.
BROADCAST_WORDS = 500_000
TREES, DEPTH, SEED = 40, 7, 7
CUT = 0.5

FEATURES = ("length", "digit_share", "upper_share", "lower_share", "transitions", "transition_share", "distinct_share",
            "hex_only", "digits_only", "uuid_like", "vowel_share", "coverage", "slashes", "after_path", "assigned",
            "quoted", "symbols", "reference", "credential_near", "credential_next", "harmless_near", "provider", "blanks",
            "common_words", "key_block", "in_url")


def find(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Rows of ``docs`` that hold candidates, with ``hits`` (in order) and
    ``gaps`` (the text before, between and after them)."""
    return (docs.withColumn("hits", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)))
            .where(F.size("hits") > 0).withColumn("gaps", F.split("text", CANDIDATE))
            .withColumn("row", F.monotonically_increasing_id()).select("row", *keep, "hits", "gaps"))


def findings_of(rows: DataFrame) -> DataFrame:
    """row, place (from 0), value, before and after of every candidate."""
    return (rows.select("row", "gaps", F.posexplode("hits").alias("place", "value"))
            .select("row", "place", "value", F.right(F.get("gaps", F.col("place")), F.lit(NEAR)).alias("before"),
                    F.left(F.get("gaps", F.col("place") + 1), F.lit(NEAR)).alias("after")))


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def _parts() -> Column:
    """Lower-case letter parts of a value, of four letters or more."""
    spaced = F.regexp_replace("value", "([a-z])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), "[^a-z]+"), lambda p: F.length(p) >= 4)


def with_features(findings: DataFrame, corpus: DataFrame) -> DataFrame:
    """``findings`` (value, before, after and any key columns) with FEATURES.

    The words that occur in findings are counted over all of ``corpus``.
    """
    findings = stage_table(findings.withColumn("finding", F.monotonically_increasing_id()), "findings")
    parts = findings.select("finding", F.explode(_parts()).alias("part"))
    # The corpus's words meet the few that are asked for before any shuffle.
    words = with_ids(corpus.select(F.explode(F.array_distinct(F.split(lowered(), "[^a-z0-9]+"))).alias("part")),
                     parts, key="part", at_most=BROADCAST_WORDS)
    words = words.groupBy("part").count().where(F.col("count") >= WORD_DOCS).select("part")
    covered = (parts.join(words, "part").groupBy("finding").agg(F.sum(F.length("part")).alias("covered")))
    n = F.length("value")
    classes = F.translate(F.translate(F.translate("value", "0123456789", "0" * 10), UPPER, "A" * 26), LOWER, "a" * 26)
    runs = F.length(F.regexp_replace(classes, r"(.)\1+", "$1"))

    def share(of: str) -> Column:
        return F.length(F.regexp_replace("value", of, "")) / n
    return (findings.join(covered, "finding", "left")
            .withColumn("length", n.cast("double"))
            .withColumn("digit_share", share("[^0-9]")).withColumn("upper_share", share("[^A-Z]"))
            .withColumn("lower_share", share("[^a-z]"))
            .withColumn("transitions", (runs - 1).cast("double")).withColumn("transition_share", (runs - 1) / n)
            .withColumn("distinct_share", F.size(F.array_distinct(F.split("value", ""))) / n)
            .withColumn("hex_only", _flag(F.col("value").rlike("^[0-9a-f]+$|^[0-9A-F]+$")))
            .withColumn("digits_only", _flag(F.col("value").rlike("^[0-9+-]+$")))
            .withColumn("uuid_like", _flag(F.col("value").rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")))
            .withColumn("vowel_share", share("[^aeiouAEIOU]"))
            .withColumn("coverage", F.coalesce(F.col("covered"), F.lit(0)) / n)
            .withColumn("slashes", F.length(F.regexp_replace("value", "[^/]", "")).cast("double"))
            .withColumn("after_path", _flag(F.col("before").rlike(r"[./~\\:]$") | F.col("after").rlike(r"^[./\\][A-Za-z]")))
            .withColumn("assigned", _flag(F.col("before").rlike(r"[:=]\s*[\"']?$")))
            .withColumn("quoted", _flag(F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")))
            .withColumn("symbols", share("[A-Za-z0-9_+/-]"))
            .withColumn("reference", _flag(F.col("value").rlike(r"^[$<{%\[(]|[()\[\]{}<>]|^[a-z_]+(\.[a-z_]+)+$")))
            .withColumn("credential_near", _flag(F.col("before").rlike(CREDENTIAL) | F.col("after").rlike(CREDENTIAL)))
            .withColumn("credential_next", _flag(F.col("before").rlike(CREDENTIAL + r"\w*[\"']?\s*(:|=|is|was|>)?\s*[\"']?$")))
            .withColumn("harmless_near", _flag(F.col("before").rlike(HARMLESS + r"\W*\w{0,12}\W*$")))
            .withColumn("provider", _flag(F.col("value").rlike("^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_|^sk_live|^xox[abps]-")))
            .withColumn("blanks", F.regexp_count("value", F.lit(r"\s")).cast("double"))
            .withColumn("common_words", F.regexp_count("value", F.lit(COMMON)).cast("double"))
            .withColumn("key_block", _flag(F.col("value").startswith("-----BEGIN ")))
            .withColumn("in_url", _flag(F.col("before").rlike("://[^\\s/:@]+:$") & F.col("after").startswith("@")))
            .drop("covered", "finding"))


def labelled_bank(spark: SparkSession, rows: int = BANK_ROWS, start: int = 0) -> DataFrame:
    """value, before, after and label of findings made by rule, half of them secrets."""
    i = F.col("id")
    hexes = F.sha1(i.cast("string"))
    more = F.sha2(i.cast("string"), 256)
    mixed = F.regexp_replace(F.base64(F.unhex(more)), "[+/=]", "x")
    number = F.conv(F.substring(more, 1, 13), 16, 10)
    pick = F.pmod(F.xxhash64(i, F.lit("kind")), F.lit(24))
    prose = F.element_at(F.array(*map(F.lit, ("this and ", "with the ", "of them. ", "y en la ", "und der "))),
                         (F.pmod(F.xxhash64(i), F.lit(5)) + 1).cast("int"))
    word = F.element_at(F.array(*map(F.lit, ("password=", "token = \"", "secret: ", "api_key=", "auth_token='", "passwd: "))),
                        (F.pmod(F.xxhash64(i, F.lit("w")), F.lit(6)) + 1).cast("int"))
    size = (12 + F.pmod(F.xxhash64(i, F.lit("n")), F.lit(28))).cast("int")
    key = F.concat(F.lit("AKIA"), F.substring(F.upper(mixed), 1, 16))
    letters = F.translate(mixed, "0123456789", "ghjkmnpqrs")
    unquoted = F.element_at(F.array(*map(F.lit, ("password=", "secret: ", "api_key=", "passwd: ", "token = "))),
                            (F.pmod(F.xxhash64(i, F.lit("u")), F.lit(5)) + 1).cast("int"))

    def one_of(salt: str, *words: str) -> Column:
        return F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(words))) + 1).cast("int"))

    def plain(salt: str) -> Column:
        return one_of(salt, "hunter", "monkey", "dragon", "summer", "winter", "tiger", "letmein", "river", "orange", "maria")

    def title(salt: str) -> Column:
        return F.initcap(one_of(salt, "correct", "horse", "battery", "staple", "purple", "window", "castle", "garden", "silver"))
    # What stands after a credential word and is no secret: words, references and places to fill in.
    ordinary = one_of("o", "required", "none", "null", "true", "false", "must", "the", "this", "optional", "changed", "string", "they",
                      "your", "is", "expired", "invalid", "missing", "undefined", "not", "rotated", "weekly", "unknown", "empty")
    reference = one_of("r", "${TOKEN}", "$PASSWORD", "<password>", "{{secret}}", "os.environ", "getpass()", "self.token", "config.secret",
                       "get_token()", "<your-key-here>", "%(password)s", "settings.api_key", "[hidden]", "<SECRET>")
    said = F.concat(prose, one_of("y", "the password is ", "My secret was ", "its token is ", "that passwd was ", "api key is "))
    tag = one_of("g", "password", "secret", "token", "apiKey", "authToken")
    url = F.concat(prose, one_of("l", "postgres://", "mysql://", "https://", "amqp://", "redis://"), plain("m"), F.lit(":"))
    quoted = F.concat(prose, one_of("q", "password = \"", "\"secret\": \"", "passwd: \"", "api_key=\""))
    phrase = F.concat_ws(" ", plain("b"), F.lower(title("b")), plain("c"), F.when(i % 3 > 0, F.lower(title("d"))))
    sentence = F.concat_ws(" ", one_of("v", "must be", "is not", "will be", "for the", "to be", "ask the"), ordinary,
                           one_of("x", "by the user", "in the vault", "for your account", "at this time", "of that host"))
    # Fixed kinds: (value, before, after, label), chosen by `pick`.
    kinds = [
        (F.left(hexes, size), F.concat(prose, word), F.lit(" "), 1),
        (F.left(F.concat(mixed, F.lit("7")), size), F.concat(prose, word), F.lit("\" "), 1),
        (key, prose, F.lit(" "), 1),
        (F.concat(F.lit("ghp_"), F.left(mixed, F.lit(36))), F.concat(prose, F.lit("key ")), F.lit(" "), 1),
        (F.concat(plain("a"), (i % 1000).cast("string")), F.concat(prose, word), F.lit(" "), 1),
        (F.concat(title("a"), title("b"), title("c")), F.concat(prose, unquoted), F.lit(" "), 1),
        (F.concat(plain("a"), one_of("s", "@", "!", "#", "&", "*", "^"), F.left(letters, (size / 4).cast("int")),
                  one_of("t", "!", "#", "%", "?", "~")), F.concat(prose, word), F.lit(" "), 1),
        (F.concat(F.lit("AKIA"), F.left(F.upper(letters), F.lit(16))), prose, F.lit(" "), 1),
        (F.rpad(number, 16, "4"), prose, F.lit(" "), 0),
        (ordinary, F.concat(prose, unquoted), F.lit(" "), 0),
        (reference, F.concat(prose, unquoted), F.lit(" "), 0),
        (ordinary, F.concat(prose, F.lit("The "), one_of("p", "password: ", "secret: ", "token: ", "auth: ")), F.lit(" "), 0),
        (F.when(i % 2 == 0, ordinary).otherwise(F.initcap(ordinary)), F.concat(prose, word), F.lit(" "), 0),
        (F.concat_ws("-", F.substring(more, 1, 8), F.substring(more, 9, 4), F.substring(more, 13, 4), F.substring(more, 17, 4),
                     F.substring(more, 21, 12)), F.concat(prose, F.lit("uuid ")), F.lit(" "), 0),
        (F.when(i % 2 == 0, hexes).otherwise(F.md5(i.cast("string"))),
         F.concat(prose, F.element_at(F.array(*map(F.lit, ("commit ", "md5 ", "checksum: ", "sha1 = "))),
                                      (i % 4 + 1).cast("int"))), F.lit(" "), 0),
        (F.concat(plain("a"), (i % 1000).cast("string")), said, F.lit(" "), 1),
        (F.left(mixed, (size / 2).cast("int")), said, F.lit(". "), 1),
        (ordinary, said, F.lit(" "), 0),
        (F.concat(plain("a"), (i % 1000).cast("string"), one_of("s", "@", "!", "", "")),
         F.concat(prose, F.lit("<"), tag, F.lit(">")), F.concat(F.lit("</"), tag, F.lit("> ")), 1),
        (F.concat(plain("a"), (i % 100).cast("string"), one_of("s", "p", "!", "", "z")), url, F.lit("@db.host "), 1),
        (phrase, quoted, F.lit("\" "), 1),
        (sentence, quoted, F.lit("\" "), 0),
        (F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), mixed, F.lit("\n"), letters, F.lit("\n-----END RSA PRIVATE KEY-----")),
         F.concat(prose, F.lit("\n")), F.lit("\n"), 1),
        (F.concat(F.lit("usr/local/share/part"), (i % 97).cast("string")), F.concat(prose, F.lit("/")), F.lit(".txt "), 0),
    ]
    struct = reduce(lambda acc, k: acc.when(pick == k[0], F.struct(
        k[1][0].alias("value"), k[1][1].alias("before"), k[1][2].alias("after"), F.lit(float(k[1][3])).alias("label"))),
        enumerate(kinds[1:], 1), F.when(pick == 0, F.struct(
            kinds[0][0].alias("value"), kinds[0][1].alias("before"), kinds[0][2].alias("after"), F.lit(1.0).alias("label"))))
    return spark.range(start, start + rows, 1, 1).select(struct.alias("f")).select("f.*")


def classified(findings: DataFrame, corpus: DataFrame, labelled: DataFrame | None, cut: float = CUT) -> DataFrame:
    """``findings`` (row, place, value, before, after) with FEATURES, probability and is_secret.

    The forest is trained on ``labelled`` findings (value, before, after,
    label), which are bounded by whoever labels them, not by the corpus. The
    words of both are counted in one pass.
    """
    labelled = labelled if labelled is not None else labelled_bank(corpus.sparkSession)
    known = labelled.select(F.lit(None).cast("long").alias("row"), F.lit(None).cast("int").alias("place"),
                            "value", "before", "after", F.col("label").cast("double"))
    rows = stage_table(with_features(known.union(findings.withColumn("label", F.lit(None).cast("double"))), corpus), "features")
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    model: RandomForestClassificationModel = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="features", labelCol="label").fit(
        rows.where("label IS NOT NULL").orderBy("value", "before").coalesce(1))
    return (model.transform(rows.where("label IS NULL")).withColumn("chance", vector_to_array("probability")[1])
            .drop("features", "rawPrediction", "prediction", "probability", "label")
            .withColumnRenamed("chance", "probability").withColumn("is_secret", F.col("probability") >= cut))


def scan(docs: DataFrame, labelled: DataFrame | None = None, cut: float = CUT) -> DataFrame:
    """doc_id, place, value_sha256, length, probability and is_secret of every candidate.

    ``place`` counts a row's candidates from 0. A null or empty text has none.
    Rows that repeat a doc_id, or have none, are scanned each on its own; other
    columns are ignored. The value itself is not returned.
    """
    corpus = docs.select("doc_id", "text")
    rows = stage_table(find(corpus, ["doc_id"]), "secret-rows")
    found = classified(findings_of(rows), corpus, labelled, cut)
    return (rows.select("row", "doc_id").join(found, "row")
            .select("doc_id", "place", F.sha2("value", 256).alias("value_sha256"), F.col("length").cast("int").alias("length"),
                    "probability", "is_secret"))


def redact(docs: DataFrame, labelled: DataFrame | None = None, cut: float = CUT) -> DataFrame:
    """``docs`` with every secret replaced by PLACEHOLDER. Rows and columns stay."""
    columns = docs.columns
    corpus = docs.select("doc_id", "text")
    keep = F.struct(*(F.col(f"`{c}`") for c in columns)).alias("doc")
    # One scan of the texts: rows without a candidate are kept as they are.
    staged = stage_table(docs.select("text", keep).withColumn("hits", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)))
                         .withColumn("gaps", F.when(F.size("hits") > 0, F.split("text", CANDIDATE)))
                         .withColumn("row", F.monotonically_increasing_id()).select("row", "doc", "hits", "gaps"), "secret-rows")
    rows = staged.where("gaps IS NOT NULL")
    found = classified(findings_of(rows), corpus, labelled, cut)
    secret = (found.where("is_secret").groupBy("row").agg(F.collect_set("place").alias("secrets")))
    pieces = F.transform("gaps", lambda gap, i: F.concat(
        gap, F.when(F.array_contains("secrets", i), F.lit(PLACEHOLDER)).otherwise(F.coalesce(F.get("hits", i), F.lit("")))))
    cleaned = (rows.join(secret, "row", "left").withColumn("secrets", F.coalesce("secrets", F.array().cast("array<int>")))
               .withColumn("cleaned", F.array_join(pieces, ""))
               .select(*(F.col("cleaned").alias(c) if c == "text" else F.col("doc").getField(c).alias(c) for c in columns)))
    untouched = staged.where("gaps IS NULL").select(*(F.col("doc").getField(c).alias(c) for c in columns))
    return untouched.union(cleaned)
