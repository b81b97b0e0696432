"""Session construction and the shared scratch / checkpoint location."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job here relies on. AQE re-plans joins from runtime sizes (a
# broadcast happens only when the measured side is under the threshold) and
# splits skewed shuffle partitions; the session time zone pins epoch arithmetic.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[*]", shuffle_partitions: int | None = None,
                  app_name: str = "rootcause", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the defaults above.

    On a cluster, call with the cluster master and leave
    ``spark.checkpoint.dir`` and the number of shuffle partitions to the
    cluster configuration.
    """
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Read from the session; only when the cluster names none (local tests) is a
    private folder created and registered.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            # A machine-local folder is not visible to other executors and is
            # lost with its machine: refuse rather than checkpoint into it.
            raise RuntimeError("spark.checkpoint.dir must name a shared folder when running on a cluster")
        root = tempfile.mkdtemp(prefix="rootcause-ckpt-")
        sc.setCheckpointDir(root)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh, never reused path under the shared checkpoint folder."""
    root = checkpoint_root(spark).rstrip("/")
    path = f"{root}/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append(path)
    return path


_SCRATCH: list[str] = []


def release_scratch(spark: SparkSession) -> int:
    """Delete the scratch folders handed out so far; frames that read them are
    of no use afterwards. Returns how many there were."""
    fs_conf = spark.sparkContext._jsc.hadoopConfiguration()
    paths = [_SCRATCH.pop() for _ in range(len(_SCRATCH))]
    for path in paths:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(fs_conf).delete(folder, True)
    return len(paths)


#: Rows that Spark hands to Python at a time: rows with whole texts make its
#: default of 10000 too much for a small executor.
BATCH_ROWS = 1024
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches to BATCH_ROWS. The setting is read
    when a plan runs, so it stays for the frames that are returned unread."""
    before = int(spark.conf.get(_BATCH_CONF))
    if before <= 0 or before > BATCH_ROWS:
        spark.conf.set(_BATCH_CONF, str(BATCH_ROWS))


def give_back() -> None:
    """Return the memory that a Python worker no longer needs: workers live on."""
    import pyarrow as pa
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def reliable_checkpoint(df):
    """Materialise ``df`` into the shared checkpoint folder and cut lineage.

    Used where later stages read the same rows twice and must see one
    consistent copy that survives executor loss.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def ensure_parallelism(df, min_partitions: int | None = None, keys: list[str] | None = None):
    """Spread a scan that yields fewer partitions than the cluster has cores.

    A large table arrives as many files / row groups and is left as is; a
    small one stored as a single row group would otherwise run every pre-
    shuffle step (regex classification, adapters, partial aggregates) in one
    task. With ``keys`` rows are hash partitioned on them (deterministic on
    retry, no sort); without, round-robin, which Spark makes deterministic by
    sorting rows first (costly for long texts).
    """
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target, *keys) if keys else df.repartition(target)
    return df
