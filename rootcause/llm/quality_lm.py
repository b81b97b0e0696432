"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The units are characters, since their n-grams stay few enough to hold at any
corpus size while the counts themselves come from every trusted document. The
counts are aggregated and joined in Spark, order by order: adjusted counts,
discounts from the counts of counts, context totals and the lower order's
probability. The finished model is sent out in shards of bounded size by the
character before the one that is predicted; every position of a document is
scored by exactly one shard and the partial sums are added by document.

A document goes when its perplexity is above the fence of its language, the
99 % quantile of held-out trusted documents. The held-out tenth is in no count.

Documents labelled toxic are in no count and no fence. Toxic text is mostly
ordinary text with a few telling words, which a perplexity over the whole
document averages away; it is told by words and pairs of words that documents
labelled toxic hold far more often than trusted ones. A document's toxicity is
the sum of their log odds, and it is toxic above the 99 % quantile of held-out
trusted documents. Few of those say little about that quantile: the limit is
then at least part of the two most telling words, the more the fewer they are.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rootcause.llm.tables import kept, map_batches, stage_table, with_ids
from rootcause.llm.textblocks import mix

ORDER = 4
#: Entries of one shard of the model: about 16 bytes each on the driver, and
#: up to 64 in a worker's tables.
SHARD_ENTRIES = 2_000_000
#: Characters of the language's median that every document is taken to have in
#: addition, so that a few odd characters do not condemn a short text.
PRIOR_CHARS = 60
QUANTILE = 0.99
#: Held-out documents of all languages that a language's quantiles are averaged with.
PRIOR_DOCS = 20
HELD_OUT = 10
BLOCK_CHARS = 1 << 20
#: Documents labelled toxic that must hold a word for it to count, and how much
#: more often they must hold it than trusted ones.
TOXIC_DOCS, TOXIC_RATIO = 5, 20.0
TOXIC_QUANTILE = 0.99
_START = "\x02"
_STEP = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"[^\W_]+")


def _codes(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points with order - 1 start marks before every text, positions of
    the texts' own characters, first of those by text and total)."""
    pad = _START * (order - 1)
    codes = np.frombuffer("".join(pad + t for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) for t in texts], np.int64)
    index = np.concatenate([[0], np.cumsum(lengths)])
    at = np.arange(index[-1]) + np.repeat(np.arange(1, len(texts) + 1) * (order - 1), lengths)
    return codes, at, index


def _raw_keys(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """keys[k][e]: number of the k characters that end at e, before mixing."""
    keys = [np.zeros(len(codes), np.uint64)]
    for k in range(1, order + 1):
        term = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(pow(int(_STEP), k, 1 << 64))
        key = keys[-1].copy()
        key[k - 1:] += term[:len(term) - k + 1]
        keys.append(key)
    return keys


def gram_keys(grams: list[str], k: int) -> np.ndarray:
    codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, k)
    key = np.zeros(len(codes), np.uint64)
    for j in range(k):
        key += (codes[:, k - 1 - j].astype(np.uint64) + np.uint64(1)) * np.uint64(pow(int(_STEP), j + 1, 1 << 64))
    return mix(key) | np.uint64(1)


def _parts(texts: list[str], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    i, size = 0, 0
    for j, t in enumerate(texts):
        if j > i and size + len(t) > limit:
            yield i, j
            i, size = j, 0
        size += len(t)
    if i < len(texts):
        yield i, len(texts)


def _count_grams(order: int):
    """Distinct n-grams of each block with their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b["text"].to_pylist()]
            for i, j in _parts(texts):
                codes, at, _ = _codes(texts[i:j], order)
                if not len(at):
                    continue
                _, first, count = np.unique(_raw_keys(codes, order)[order][at], return_index=True, return_counts=True)
                rows = codes[at[first][:, None] + np.arange(1 - order, 1)]
                flat = rows.tobytes().decode("utf-32-le", "surrogatepass")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([flat[k:k + order] for k in range(0, len(flat), order)], pa.string()),
                     pa.array(count.astype(np.int64))], ["gram", "count"])
    return run


def _discounts(table: DataFrame) -> tuple[float, float, float]:
    """D1, D2 and D3+ of one order from its counts of counts."""
    n = [0, 0, 0, 0, 0]
    for r in table.where("count <= 4").groupBy("count").agg(F.count("*").alias("n")).collect():
        n[r["count"]] = r["n"]
    if not n[1] or not n[2]:
        return 0.5, 0.5, 0.5  # too little text for an estimate
    y = n[1] / (n[1] + 2 * n[2])
    d = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 3 - 4 * y]
    return tuple(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))


def train(trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """(order, gram, logp, logb): of every n-gram its interpolated log
    probability, and of every n-gram that is a context the log of the weight
    that the next lower order has after it. Order 0 has one row: the log
    probability of a character that was never seen.
    """
    # Base-level counts cover all trusted text; lower orders count distinct
    # continuations.
    counts = {order: stage_table(trusted.transform(map_batches, _count_grams(order), "gram string, count long")
                                 .groupBy("gram").agg(F.sum("count").alias("count")), "grams")}
    for k in range(order - 1, 0, -1):
        counts[k] = stage_table(counts[k + 1].groupBy(F.substring("gram", 2, k).alias("gram"))
                                .agg(F.count("*").alias("count")), "grams")
    size = counts[1].count() + 1
    model, lower = None, None
    for k in range(1, order + 1):
        d1, d2, d3 = _discounts(counts[k])
        discount = F.when(F.col("count") == 1, d1).when(F.col("count") == 2, d2).otherwise(d3)
        rows = counts[k].select("gram", "count", F.substring("gram", 1, k - 1).alias("context"), discount.alias("discount"))
        contexts = rows.groupBy("context").agg(F.sum("count").alias("total"), F.sum("discount").alias("held"))
        rows = rows.join(contexts, "context")
        if lower is None:
            rows = rows.withColumn("below", F.lit(1.0 / size))
        else:
            rows = rows.withColumn("suffix", F.substring("gram", 2, k - 1)).join(
                lower.select(F.col("gram").alias("suffix"), F.col("p").alias("below")), "suffix")
        p = (F.col("count") - F.col("discount") + F.col("held") * F.col("below")) / F.col("total")
        lower = stage_table(rows.select("gram", p.alias("p")), "probabilities")
        back = contexts.select(F.col("context").alias("gram"), F.log(F.col("held") / F.col("total")).alias("logb"))
        if k == 1:
            unseen = contexts.select(F.lit(0).alias("order"), F.lit("").alias("gram"),
                                     F.log(F.col("held") / F.col("total") / size).alias("logp"),
                                     F.lit(None).cast("double").alias("logb"))
            model = unseen
        else:
            # A context may hold start marks, which are never predicted.
            model = model.union(previous.join(back, "gram", "full").select(
                F.lit(k - 1).alias("order"), "gram", F.log("p").alias("logp"), "logb"))
        previous = lower
    return model.union(previous.select(F.lit(order).alias("order"), "gram", F.log("p").alias("logp"),
                                       F.lit(None).cast("double").alias("logb")))


class KeyTable:
    """Open-addressing table from 64-bit keys to a number, looked up by array."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 2.5).bit_length())
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.float32)
        self.mask, left, slot = (1 << self.bits) - 1, np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[left[free]]  # of several with one slot, the last stays
            won = self.keys[slot] == keys[left]
            self.values[slot[won]] = values[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, values; 0 where not found)"""
        slot = self._slot(keys)
        at = self.keys[slot]
        found = at == keys
        values = np.where(found, self.values[slot], np.float32(0))
        open_ = np.flatnonzero(~found & (at != 0))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & self.mask
            at = self.keys[slot]
            hit = at == keys[open_]
            found[open_[hit]] = True
            values[open_[hit]] = self.values[slot[hit]]
            go = ~hit & (at != 0)
            open_, slot = open_[go], slot[go]
        return found, values


class Scorer:
    def __init__(self, order: int, unseen: float, grams: dict, weights: dict):
        self.order, self.unseen = order, unseen
        self.grams = {k: KeyTable(*v) for k, v in grams.items()}
        self.weights = {k: KeyTable(*v) for k, v in weights.items()}

    def log_sums(self, texts: list[str], shard: int, shards: int) -> np.ndarray:
        """Of every text, the sum of its characters' log probabilities whose
        preceding character belongs to the shard."""
        codes, at, index = _codes(texts, self.order)
        keys = _raw_keys(codes, self.order)
        if shards > 1:
            own = char_shard(codes[at - 1], shards) == shard
        score = np.zeros(len(at), np.float64)
        left = np.arange(len(at)) if shards == 1 else np.flatnonzero(own)
        for k in range(self.order, 0, -1):
            found, logp = self.grams[k].get(mix(keys[k][at[left]]) | np.uint64(1))
            score[left] += logp
            left = left[~found]
            if not len(left):
                break
            if k > 1:  # no weight: the context was never seen, and the lower order has it all
                score[left] += self.weights[k - 1].get(mix(keys[k - 1][at[left] - 1]) | np.uint64(1))[1]
            else:
                score[left] += self.unseen
        sums = np.concatenate([[0.0], np.cumsum(score)])
        return sums[index[1:]] - sums[index[:-1]]


def char_shard(codes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a code point; ``_shard_of`` is the same as a column."""
    return ((codes.astype(np.int64) * 2654435761 % (1 << 32)) >> 12) % shards


def _shard_of(char, shards: int):
    spread = F.pmod(F.ascii(char).cast("long") * F.lit(2654435761), F.lit(1 << 32))
    return F.pmod(F.shiftright(spread, 12), F.lit(shards))


def _word_grams(text: str) -> set[str]:
    found = _WORD.findall(text.lower())
    return {*found, *map(" ".join, zip(found, found[1:]))}


def _document_counts(known=None):
    """Documents of each batch that hold each word or pair (of ``known``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = Counter()
            for t in b["text"].to_pylist():
                grams = _word_grams(t or "")
                held.update(grams if known is None else grams & known.value)
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                             ["gram", "docs"])
    return run


def toxic_words(toxic: DataFrame, trusted: DataFrame) -> dict[str, float]:
    """The log odds of words and pairs of words that tell toxic documents.

    Only those that TOXIC_DOCS toxic documents hold are looked for in the
    trusted ones.
    """
    n_toxic, n_trusted = toxic.count(), trusted.count()
    schema, spark = "gram string, docs long", toxic.sparkSession

    def counts(docs: DataFrame, known=None) -> DataFrame:
        return docs.transform(map_batches, _document_counts(known), schema).groupBy("gram").agg(F.sum("docs").alias("docs"))
    found = counts(toxic).where(F.col("docs") >= TOXIC_DOCS).toArrow()
    held = dict(zip(found["gram"].to_pylist(), found["docs"].to_pylist()))
    found = counts(trusted, spark.sparkContext.broadcast(set(held))).toArrow()
    clean = dict(zip(found["gram"].to_pylist(), found["docs"].to_pylist()))
    odds = {g: math.log((n + 0.5) / (n_toxic + 1) * (n_trusted + 1) / (clean.get(g, 0) + 0.5)) for g, n in held.items()}
    return {g: w for g, w in odds.items() if w >= math.log(TOXIC_RATIO)}


def _toxicity(texts: list[str], weights: dict[str, float]) -> list[float]:
    return [math.fsum(map(weights.__getitem__, _word_grams(t) & weights.keys())) for t in texts] if weights else [0.0] * len(texts)


def _score(model, key: str, shard: int, shards: int, toxic):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept(key, lambda: Scorer(*model.value))
        for b in batches:
            texts = [t or "" for t in b["text"].to_pylist()]
            for i, j in _parts(texts):
                part = texts[i:j]
                # Only a model in several shards needs to bring rows together.
                digest = [hashlib.md5(t.encode("utf-8", "surrogatepass")).hexdigest() for t in part] if shards > 1 else [""] * (j - i)
                weights = toxic.value if shard == 0 else {}  # the first shard's pass tells it
                yield pa.RecordBatch.from_arrays(
                    [b["doc_id"].slice(i, j - i), b["lang"].slice(i, j - i), pa.array(digest, pa.string()),
                     pa.array([len(t) for t in part], pa.int64()), pa.array(scorer.log_sums(part, shard, shards)),
                     pa.array(_toxicity(part, weights), pa.float64())],
                    ["doc_id", "lang", "digest", "n_chars", "log_sum", "toxicity"])
    return run


def score(docs: DataFrame, model: DataFrame, order: int = ORDER, shard_entries: int = SHARD_ENTRIES,
          toxic: dict[str, float] | None = None) -> DataFrame:
    """doc_id, lang, n_chars, log_sum (of all its characters' log
    probabilities) and toxicity (the sum of the weights in ``toxic`` of words
    and pairs it holds) of every row of ``docs``."""
    spark = docs.sparkSession
    telling = spark.sparkContext.broadcast(toxic or {})
    docs = docs.select("doc_id", "lang", "text")
    entries = model.count()
    shards = max(1, -(-entries // shard_entries))
    parts = []
    for s in range(shards):
        grams, weights, unseen = {}, {}, 0.0
        for k in range(order + 1):
            rows = model.where(F.col("order") == k)
            if shards > 1 and k > 1:  # only this shard's entries come to the driver
                rows = rows.where((_shard_of(F.substring("gram", k - 1, 1), shards) == s)
                                  | (_shard_of(F.substring("gram", k, 1), shards) == s))
            rows = rows.select("gram", "logp", "logb").toArrow()
            if k == 0:
                unseen = rows["logp"][0].as_py() if len(rows) else -math.log(2.0)
                continue
            text, logp, logb = rows["gram"].to_pylist(), rows["logp"].to_numpy(), rows["logb"].to_numpy()
            keys = gram_keys(text, k) if text else np.zeros(0, np.uint64)
            before = np.array([ord(g[-2]) if k > 1 else 0 for g in text], np.uint32)
            last = np.array([ord(g[-1]) for g in text], np.uint32)
            mine = ~np.isnan(logp) & ((char_shard(before, shards) == s) if shards > 1 and k > 1 else True)
            grams[k] = keys[mine], logp[mine]
            mine = ~np.isnan(logb) & ((char_shard(last, shards) == s) if shards > 1 else True)
            weights[k] = keys[mine], logb[mine]
        sent = spark.sparkContext.broadcast((order, unseen, grams, weights))
        key = f"scorer-{uuid.uuid4().hex}"
        parts.append(docs.transform(map_batches, _score(sent, key, s, shards, telling),
                                     "doc_id long, lang string, digest string, n_chars long, log_sum double, toxicity double", key))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    if shards > 1:
        whole = (whole.groupBy("doc_id", "lang", "digest", "n_chars")
                 .agg(F.sum("log_sum").alias("log_sum"), F.max("toxicity").alias("toxicity"), (F.count("*") / shards).cast("int").alias("rows"))
                 .withColumn("log_sum", F.col("log_sum") / F.col("rows"))
                 .withColumn("rows", F.explode(F.sequence(F.lit(1), "rows"))))
    return whole.select("doc_id", "lang", "n_chars", "log_sum", "toxicity")


def classify(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE,
             prior_chars: int = PRIOR_CHARS, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """doc_id, lang, n_chars, perplexity, threshold, kept, toxicity and toxic of every row of ``docs``.

    ``labels`` has doc_id, quality and, where known, toxic; documents of
    quality 1 that are not toxic are trusted. ``kept`` judges the perplexity
    alone, ``toxic`` the words. A null or empty text has no perplexity and is
    kept, as are all documents when there is no trusted text. A null language
    is a language of its own; the fence of a language is drawn towards that of
    all languages, the more the fewer held-out trusted documents it has. Rows
    that repeat a doc_id are scored each on its own; other columns are ignored.
    """
    harm = F.col("toxic") == 1 if "toxic" in labels.columns else F.lit(False)
    told = labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
                                        F.max(F.coalesce(harm, F.lit(False))).alias("harm"))
    trusted = told.where("good AND NOT harm").select("doc_id")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0
    counted = with_ids(docs, trusted.where(~fold)).select("text")
    model = stage_table(train(counted, order), "language-model")
    toxic = toxic_words(with_ids(docs, told.where("harm").where(~fold)).select("text"), counted)
    scored = stage_table(score(docs, model, order, shard_entries, toxic)
                         .withColumn("loss", F.when(F.col("n_chars") > 0, -F.col("log_sum") / F.nullif("n_chars", F.lit(0))))
                         .withColumn("key", F.coalesce("lang", F.lit(""))), "scores")
    held = scored.join(trusted.where(fold), "doc_id", "left_semi")
    limit = held.where("n_chars > 0").agg(F.percentile_approx("toxicity", TOXIC_QUANTILE).alias("value"), F.count("*").alias("n")).first()
    limit = max(limit["value"] or 0.0, 2 * max(toxic.values(), default=0.0) * PRIOR_DOCS / (limit["n"] + PRIOR_DOCS))
    held = stage_table(held.where("n_chars > 0").select("key", "n_chars", "loss"), "held-out")

    def drawn(docs: DataFrame) -> DataFrame:
        """With median and shrunk: the loss as if of prior_chars more characters of the median."""
        return with_quantile(docs, held, "loss", 0.5, "median").withColumn(
            "shrunk", (F.col("loss") * F.col("n_chars") + prior_chars * F.col("median")) / (F.col("n_chars") + prior_chars))
    judged = with_quantile(drawn(scored), drawn(held), "shrunk", quantile, "fence")
    return judged.select("doc_id", "lang", "n_chars", F.exp("loss").alias("perplexity"), F.exp("fence").alias("threshold"),
                         F.coalesce(F.col("shrunk") <= F.col("fence"), F.lit(True)).alias("kept"),
                         "toxicity", (F.col("toxicity") > limit).alias("toxic"))


def with_quantile(docs: DataFrame, held: DataFrame, col: str, q: float, name: str) -> DataFrame:
    """``docs`` with the q quantile of ``col`` over the held-out documents of
    their language, averaged with PRIOR_DOCS documents at that of all languages."""
    own = quantiles(held, col, q)
    whole = quantiles(held.withColumn("key", F.lit("")), col, q).first()  # one row, or none where nothing is trusted
    whole = F.lit(whole["value"] if whole else None).cast("double")
    own = own.select("key", ((F.col("n") * F.col("value") + PRIOR_DOCS * whole) / (F.col("n") + PRIOR_DOCS)).alias(name))
    return docs.join(F.broadcast(own), "key", "left").withColumn(name, F.coalesce(name, whole))  # a row a language


def quantiles(held: DataFrame, col: str, q: float) -> DataFrame:
    """key, n and value, the q quantile of ``col`` of each key, from a
    histogram of thousandths, rounded up, so that no quantile needs a
    language's rows together."""
    bins = held.groupBy("key", F.ceil(F.col(col) * 1000).alias("bin")).count()
    upto = F.sum("count").over(Window.partitionBy("key").orderBy("bin"))
    n = F.sum("count").over(Window.partitionBy("key"))
    return (bins.withColumn("upto", upto).withColumn("n", n).groupBy("key")
            .agg(F.first("n").alias("n"), (F.min(F.when(F.col("upto") >= q * F.col("n"), F.col("bin"))) / 1000).alias("value")))


def trusted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that :func:`classify` rejects or finds toxic; columns stay as they are."""
    rejected = classify(docs, labels).where("NOT kept OR toxic").select("doc_id")
    return with_ids(docs, stage_table(rejected, "rejected"), "left_anti")
