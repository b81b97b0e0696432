"""Model replies that are kept: every text is answered once (op D2).

A hosted model is slow, paced and fails at times, so its replies are worth
more than the job that asked for them. Replies go to a table under the SHA-256
of their prompt; only prompts without a reply are sent. A task holds one call's
worth of prompts and its replies are in the store as soon as it is done (each
task's file is committed on its own, not with the job): when a job dies half way,
or an action runs a second time, the answered prompts are not sent again. What
an executor was asking at the moment it was lost is all that is asked twice.

Calls are paced within each worker so that all of them together keep the given
rate, and repeated with growing pauses. A prompt whose calls all failed is kept
with its error and its number of attempts and is asked again by the next run, up
to ``give_up`` attempts.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rootcause.functions.text import wrap_review
from rootcause.session import scratch_dir
from rootcause.sources.versioned import file_system, publish, read_current

SCHEMA = "digest string, reply string, error string, attempt int"


@dataclass(frozen=True)
class Calls:
    """How a model is called."""

    #: Prompts of one call.
    batch: int = 16
    #: Calls a second of all workers together; none is no limit.
    per_second: float | None = None
    #: Tries of a call before its error is kept, and the pause before the
    #: second, doubled for each further one up to ``longest`` seconds.
    tries: int = 3
    pause: float = 1.0
    longest: float = 60.0
    #: Failed attempts (over all runs) after which a prompt is asked no more.
    give_up: int = 12
    #: Tasks of one job: more prompts are sent in several jobs.
    tasks: int = 20_000


class ReplyStore:
    """Replies by the digest of their prompt, in a folder that all executors reach.

    ``<path>/new`` takes the files of single calls; ``compact`` gathers them in
    ``<path>/table``, a versioned table with one row a prompt.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def rows(self) -> DataFrame:
        """Every kept row: a prompt may have failed several times."""
        kept = read_current(self.spark, f"{self.path}/table", SCHEMA)
        fs, folder = file_system(self.spark, f"{self.path}/new")
        return kept.unionByName(self.spark.read.schema(SCHEMA).parquet(f"{self.path}/new")) if fs.exists(folder) else kept

    def state(self) -> DataFrame:
        """One row a prompt: its first reply, or its last error."""
        best = F.min(F.struct(F.col("reply").isNull().alias("failed"),
                              F.when(F.col("reply").isNull(), -F.col("attempt")).otherwise(F.col("attempt")).alias("order"),
                              "reply", "error", "attempt"))
        return self.rows().groupBy("digest").agg(best.alias("b")).select("digest", "b.reply", "b.error", "b.attempt")

    def append(self, rows: DataFrame) -> None:
        """Add rows; each task's file is there once the task is done."""
        (rows.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2")
         .parquet(f"{self.path}/new"))

    def compact(self) -> None:
        """Gather the small files of calls into the table. No run may be writing."""
        publish(self.state(), f"{self.path}/table")
        fs, folder = file_system(self.spark, f"{self.path}/new")
        fs.delete(folder, True)


_LAST_CALL = [0.0]  # of this worker


def _pace(every: float) -> None:
    """Wait until ``every`` seconds after this worker's last call."""
    wait = _LAST_CALL[0] + every - time.monotonic()
    if wait > 0:
        time.sleep(wait)
    _LAST_CALL[0] = time.monotonic()


def _call(prompts: pd.Series, infer, calls: Calls, every: float) -> tuple[list, list, int]:
    """(replies, errors, tries) of one call; after the last failed try of a
    call with several prompts each is asked alone, once."""
    error: Exception | None = None
    for attempt in range(calls.tries):
        if attempt:
            asked = getattr(error, "retry_after", None)  # what the host asked for
            pause = min(calls.longest, calls.pause * 2 ** (attempt - 1))
            time.sleep(pause * random.uniform(0.5, 1.0) if asked is None else float(asked))
        _pace(every)
        try:
            replies = list(infer(prompts))
            if len(replies) != len(prompts):
                raise ValueError(f"{len(replies)} replies to {len(prompts)} prompts")
            return [None if r is None else str(r).strip() for r in replies], [None] * len(prompts), attempt + 1
        except Exception as e:  # noqa: BLE001 - any failure of a hosted model
            error = e
    if len(prompts) == 1:
        return [None], [f"{type(error).__name__}: {error}"], calls.tries
    alone = Calls(1, calls.per_second, 1, calls.pause, calls.longest)
    each = [_call(prompts.iloc[i:i + 1], infer, alone, every) for i in range(len(prompts))]
    return [r for rs, _, _ in each for r in rs], [e for _, es, _ in each for e in es], calls.tries + 1


def _ask(infer, calls: Calls, every: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), calls.batch):
                part = b.iloc[at:at + calls.batch]
                replies, errors, tries = _call(part["prompt"], infer, calls, every)
                # A model may answer with nothing at all: that is its reply.
                replies = [r if r is not None or e is not None else "" for r, e in zip(replies, errors)]
                yield pd.DataFrame({"digest": part["digest"], "reply": replies, "error": errors,
                                    "attempt": (part["attempt"] + tries).astype("int32")})
    return run


def pending(store: ReplyStore, prompts: DataFrame, calls: Calls = Calls()) -> DataFrame:
    """(digest, prompt, attempt) of the distinct prompts that have no reply."""
    state = store.state()
    distinct = prompts.where("prompt IS NOT NULL").groupBy("digest").agg(F.any_value("prompt").alias("prompt"))
    failed = state.where("reply IS NULL").select("digest", "attempt")
    done = state.where(F.col("reply").isNotNull() | (F.col("attempt") >= calls.give_up)).select("digest")
    return (distinct.join(done, "digest", "left_anti").join(failed, "digest", "left")
            .select("digest", "prompt", F.coalesce("attempt", F.lit(0)).alias("attempt")))


def ask_all(store: ReplyStore, prompts: DataFrame, infer: Callable[[pd.Series], pd.Series], calls: Calls = Calls()) -> int:
    """Send every prompt without a reply and keep what comes back; the number sent.

    ``prompts`` has digest and prompt. The list of what to send is written
    first: the store grows while it is worked off.
    """
    spark = store.spark
    path = scratch_dir(spark, "prompts")
    pending(store, prompts, calls).write.parquet(path)
    todo = spark.read.schema("digest string, prompt string, attempt int").parquet(path)
    n = todo.count()
    if not n:
        return 0
    # Prompts are dealt by digest: half full on average, few tasks need a second call.
    tasks = -(-2 * n // calls.batch)
    jobs = -(-tasks // calls.tasks)
    slots = spark.sparkContext.defaultParallelism
    every = min(slots, -(-tasks // jobs)) / calls.per_second if calls.per_second else 0.0
    for job in range(jobs):
        part = todo.where(F.pmod(F.xxhash64("digest"), F.lit(jobs)) == job) if jobs > 1 else todo
        asked = part.repartition(-(-tasks // jobs), "digest").mapInPandas(_ask(infer, calls, every), SCHEMA)
        store.append(asked)
    return n


def infer_stored(df: DataFrame, col: str | Column, infer: Callable[[pd.Series], pd.Series], store: ReplyStore,
                 out: str = "reply", wrap: bool = False, calls: Calls = Calls()) -> DataFrame:
    """``df`` with the model's reply in column ``out`` (op D2, kept replies).

    Only texts that the store has no reply to are sent, each once; the frame
    returned reads the store, so that any number of actions on it call no model.
    A null text and a text whose calls failed have a null reply (its error is in
    the store). ``wrap`` sends '<review>' + text + '</review>'.
    """
    key = "_prompt_sha256"
    text = F.col(col) if isinstance(col, str) else col
    prompt = wrap_review(text) if wrap else text
    keyed = df.withColumn(key, F.sha2(prompt, 256))
    ask_all(store, keyed.select(F.col(key).alias("digest"), prompt.alias("prompt")), infer, calls)
    replies = store.state().select(F.col("digest").alias(key), F.col("reply").alias(out))
    return keyed.join(replies, key, "left").drop(key)
