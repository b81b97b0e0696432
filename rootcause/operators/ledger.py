"""Ledger replay and per-user state (ops G5, G6, G9).

The balance fold is not a running sum: a withdrawal takes at most the
current balance and does nothing once the balance is at or below zero, so
each step depends on the previous result. Amounts are counted in whole units
of 1e-4, so every order of evaluation gives the same balance.

Plan for ordinary users: starting balances and transactions are unioned (no
join), hash partitioned by user and sorted within partitions by (user,
start-first, sequence). One Arrow-batched pass then folds each user's rows in
order, carrying the running balance across batch boundaries. No history is
held in memory as a group; it streams through the sort (which spills) and the
fold one batch at a time.

Plan for hot users (more than ``hot_rows`` transactions): their histories are
range partitioned by (user, sequence), so Spark cuts each into contiguous
segments of about ``segment_rows`` rows on different tasks. Each segment is
summarised as a function of the entry balance (see ``StepSummary``), with at
most one flat piece for each of its withdrawals. A pass per user reads the
summaries in order, one at a time, and gives every segment its entry balance
and position; then all segments are folded in parallel from their entries.

Summaries compose, and composition is associative, so a ledger that arrives in
loads keeps one summary a user and load (``LedgerLoads``): a new load continues
from the composed ones and gives the bits of one replay.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, bisect_right
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rootcause.functions.finance import margin_balance
from rootcause.session import reliable_checkpoint
from rootcause.sources.versioned import publish, read_current

DEPOSIT = "DEPOSIT"
WITHDRAWAL = "WITHDRAWAL"

REPLAY_SCHEMA = "txn_id long, user_id long, txn_seq long, balance_after_txn double"

# Units in one currency unit: amounts keep four decimals.
UNITS = 10_000
# Users with more transactions than this are split across tasks.
HOT_USER_ROWS = 1_000_000
# Rows of a hot user that one segment holds on average.
SEGMENT_ROWS = 50_000
# Hot-user id sets up to this size (8 bytes an id) are broadcast to route rows
# map-side; the exact count is known before the routing joins.
MAX_BROADCAST_IDS = 2_000_000


def units(col: Column) -> Column:
    """A currency column in whole units."""
    return (col.cast("decimal(32,4)") * F.lit(UNITS)).cast("long")


def apply_txn(balance, txn_type: str | None, amount):
    """One step of the fold: deposits add; a withdrawal takes
    min(balance, amount) while both are positive and nothing otherwise; every
    other type (fees, penalties, auto square-off) subtracts."""
    if balance is None or amount is None:
        return None
    if txn_type == DEPOSIT:
        return balance + amount
    if txn_type == WITHDRAWAL:
        return balance if balance <= 0 or amount <= 0 else balance - min(balance, amount)
    return balance - amount


def _replayed(txn, user, pos, bal) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(txn, pa.int64()), pa.array(user, pa.int64()), pa.array(pos, pa.int64()),
         pa.array([None if b is None else b / UNITS for b in bal], pa.float64())],
        ["txn_id", "user_id", "txn_seq", "balance_after_txn"])


def _columns(batch: pa.RecordBatch, *names: str):
    return zip(*(batch[n].to_pylist() for n in names))


def _fold(batches):
    user, bal, started, pos = None, None, False, 0
    for b in batches:
        out = [], [], [], []
        for uid, kind, txn, typ, amt in _columns(b, "user_id", "_kind", "txn_id", "txn_type", "amount"):
            if uid != user:
                user, bal, started, pos = uid, None, False, 0
            if kind == 0:
                # A start row's number is the position that its user has reached.
                bal, started, pos = amt, True, txn or 0
                continue
            if not started:
                continue  # no starting state for this user: inner-join semantics
            bal = apply_txn(bal, typ, amt)
            pos += 1
            for col, value in zip(out, (txn, uid, pos, bal)):
                col.append(value)
        yield _replayed(*out)


class StepSummary:
    """The fold over a run of transactions as a function of the balance before
    the run.

    Every step is monotone with slope 1 or 0, and so is any composition:
    ``f(x) = x + shift - (length of the flat pieces below x)``. Deposits and
    debits move ``shift`` only. A withdrawal makes everything flat from the
    point where f is 0 on, until its amount is used up; flat pieces inside are
    absorbed, so there is at most one for each withdrawal. Pieces below the
    zero of f are kept on ``left`` and those above on ``right`` (next one
    last), with ``zero`` the largest x that f maps to 0 or below. A missing
    amount makes the result unknown (``dead``), as in the row-by-row fold. All
    numbers are whole units.
    """

    __slots__ = ("left", "right", "shift", "zero", "dead")

    def __init__(self):
        self.left: list[tuple[int, int]] = []
        self.right: list[tuple[int, int]] = []
        self.shift, self.zero, self.dead = 0, 0, False

    def step(self, txn_type, amount) -> None:
        if self.dead:
            return
        if amount is None:
            self.dead = True
        elif txn_type == DEPOSIT:
            self._move(amount)
        elif txn_type == WITHDRAWAL:
            self._withdraw(amount)
        else:
            self._move(-amount)

    def _move(self, c: int) -> None:
        """f grows by c: its zero moves by c along the pieces with slope 1."""
        self.shift += c
        while c > 0:  # to the left
            edge = self.left[-1][1] if self.left else None
            if edge is None or self.zero - edge >= c:
                self.zero -= c
                # The end of a flat piece at 0 belongs to it.
                return
            c -= self.zero - edge
            piece = self.left.pop()
            self.right.append(piece)
            self.zero = piece[0]
        while c < 0:  # to the right
            edge = self.right[-1][0] if self.right else None
            if edge is None or edge - self.zero > -c:
                self.zero -= c
                return
            c += edge - self.zero
            piece = self.right.pop()
            self.left.append(piece)
            self.zero = piece[1]
        # A flat piece that begins at the zero is part of what maps to 0.
        while self.right and self.right[-1][0] == self.zero:
            piece = self.right.pop()
            self.left.append(piece)
            self.zero = piece[1]

    def _withdraw(self, a: int) -> None:
        if a <= 0:
            return
        start, at = self.zero, self.zero
        while self.right and self.right[-1][0] - at <= a:
            piece = self.right.pop()
            a -= piece[0] - at
            at = piece[1]
        end = at + a
        if self.right and self.right[-1][0] == end:
            end = self.right.pop()[1]
        if self.left and self.left[-1][1] == start:
            start = self.left.pop()[0]
        self.left.append((start, end))
        self.zero = end

    def flats(self) -> list[tuple[int, int]]:
        return self.left + self.right[::-1]

    def __call__(self, balance):
        if self.dead or balance is None:
            return None
        return apply_flats(balance, self.shift, *zip(*self.flats())) if self else balance + self.shift

    def __len__(self) -> int:
        return len(self.left) + len(self.right)


def apply_flats(x: int, shift: int, starts, ends) -> int:
    """x + shift less the length of the flat pieces below x."""
    k = bisect_left(ends, x)
    flat = sum(ends[:k]) - sum(starts[:k])
    if k < len(starts) and starts[k] < x:
        flat += x - starts[k]
    return x + shift - flat


def compose(f: StepSummary, g: StepSummary) -> StepSummary:
    """The summary of f's transactions followed by g's.

    f is continuous and onto, so what g is flat on comes back as the interval
    of all balances that f takes there. Composition is associative: segments
    may be summarised anywhere and joined in any grouping, as long as their
    order is kept.
    """
    out = StepSummary()
    out.shift, out.dead = f.shift + g.shift, f.dead or g.dead
    flats = f.flats()
    starts, ends = [a for a, _ in flats], [b for _, b in flats]
    gone = list(accumulate((b - a for a, b in flats), initial=0))  # flat length before each piece
    values = [a + f.shift - before for a, before in zip(starts, gone)]
    pieces = list(flats)
    for a, b in g.flats():
        # Smallest balance that f maps to a, and largest that it maps to b.
        i, j = bisect_left(values, a), bisect_right(values, b)
        low = starts[i] if i < len(values) and values[i] == a else a - f.shift + gone[i]
        high = ends[j - 1] if j and values[j - 1] == b else b - f.shift + gone[j]
        pieces.append((low, high))
    for a, b in sorted(pieces):
        if out.left and a <= out.left[-1][1]:
            out.left[-1] = (out.left[-1][0], max(b, out.left[-1][1]))
        else:
            out.left.append((a, b))
    return out


SUMMARY_SCHEMA = "_pid int, user_id long, n long, dead boolean, starts array<long>, ends array<long>, shift long"
ENTRY_SCHEMA = "_pid int, user_id long, _entry long, _offset long"
LOAD_SCHEMA = "user_id long, n long, dead boolean, starts array<long>, ends array<long>, shift long"
STATE_SCHEMA = "user_id long, balance_units long, n_txns long"


def _summarise(batches):
    """Pass A: one summary row per (partition, user) segment."""
    key, summ, n = None, None, 0

    def row():
        starts, ends = zip(*summ.flats()) if len(summ) else ((), ())
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([n], pa.int64()),
             pa.array([summ.dead]), pa.array([list(starts)], pa.list_(pa.int64())),
             pa.array([list(ends)], pa.list_(pa.int64())), pa.array([summ.shift], pa.int64())],
            ["_pid", "user_id", "n", "dead", "starts", "ends", "shift"])

    for b in batches:
        for pid, uid, typ, amt in _columns(b, "_pid", "user_id", "txn_type", "amount"):
            if (pid, uid) != key:
                if key is not None:
                    yield row()
                key, summ, n = (pid, uid), StepSummary(), 0
            n += 1
            summ.step(typ, amt)
    if key is not None:
        yield row()


def _chain(batches):
    """Entry balance and position of each segment, users and segments in order."""
    user, bal, offset = None, None, 0
    for b in batches:
        out = [], [], [], []
        for r in range(b.num_rows):
            pid, uid, n, dead, shift, start, reached = (
                b[c][r].as_py() for c in ("_pid", "user_id", "n", "dead", "shift", "start", "reached"))
            if uid != user:
                user, bal, offset = uid, start, reached
            for col, value in zip(out, (pid, uid, bal, offset)):
                col.append(value)
            if dead or bal is None:
                bal = None
            else:
                bal = apply_flats(bal, shift, b["starts"][r].values.to_pylist(), b["ends"][r].values.to_pylist())
            offset += n
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.int64()) for c in out[1:])],
                                         ["_pid", "user_id", "_entry", "_offset"])


def _fold_segments(batches):
    """Pass B: fold every segment from its entry balance."""
    key, bal, pos = None, None, 0
    for b in batches:
        out = [], [], [], []
        for pid, uid, txn, typ, amt, entry, offset in _columns(
                b, "_pid", "user_id", "txn_id", "txn_type", "amount", "_entry", "_offset"):
            if (pid, uid) != key:
                key, bal, pos = (pid, uid), entry, offset
            bal = apply_txn(bal, typ, amt)
            pos += 1
            for col, value in zip(out, (txn, uid, pos, bal)):
                col.append(value)
        yield _replayed(*out)


def _summary_of(r: dict) -> StepSummary:
    summ = StepSummary()
    summ.left, summ.shift, summ.dead = list(zip(r["starts"], r["ends"])), r["shift"], r["dead"]
    return summ


def _compose_users(batches):
    """One summary a user; rows come sorted by user and order."""
    user, summ, n = None, None, 0

    def row():
        flats = summ.flats()
        return {"user_id": user, "n": n, "dead": summ.dead, "starts": [a for a, _ in flats], "ends": [b for _, b in flats], "shift": summ.shift}

    for b in batches:
        out = []
        for r in b.to_pylist():
            if r["user_id"] != user:
                if summ is not None:
                    out.append(row())
                user, summ, n = r["user_id"], _summary_of(r), r["n"]
            else:
                summ, n = compose(summ, _summary_of(r)), n + r["n"]
        yield pa.RecordBatch.from_pylist(out, _LOAD_ARROW)
    if summ is not None:
        yield pa.RecordBatch.from_pylist([row()], _LOAD_ARROW)


_LOAD_ARROW = pa.schema([("user_id", pa.int64()), ("n", pa.int64()), ("dead", pa.bool_()), ("starts", pa.list_(pa.int64())),
                         ("ends", pa.list_(pa.int64())), ("shift", pa.int64())])


def compose_summaries(summaries: DataFrame, order: str) -> DataFrame:
    """One summary a user of LOAD_SCHEMA rows that follow one another by column ``order``."""
    return (summaries.repartition("user_id").sortWithinPartitions("user_id", order)
            .select("user_id", "n", "dead", "starts", "ends", "shift").mapInArrow(_compose_users, LOAD_SCHEMA))


def summarise_load(events: DataFrame, seq: list[str], hot_rows: int = HOT_USER_ROWS, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """A summary of each user's transactions of one load (LOAD_SCHEMA).

    Users with more than ``hot_rows`` transactions are summarised segment by
    segment on different tasks and composed.
    """
    events = _event_units(events, seq)
    order = ["user_id", *seq, "txn_id"]
    rest, hot, rows = _hot_and_rest(events, hot_rows)
    plain = (rest.repartition("user_id").sortWithinPartitions(*order).withColumn("_pid", F.lit(0))
             .select("_pid", "user_id", "txn_type", "amount").mapInArrow(_summarise, SUMMARY_SCHEMA).drop("_pid"))
    if hot is None:
        return plain
    chunks = _segments(hot, order, -(-rows // segment_rows))
    parts = chunks.select("_pid", "user_id", "txn_type", "amount").mapInArrow(_summarise, SUMMARY_SCHEMA)
    return plain.unionByName(compose_summaries(parts, "_pid"))


def _hot_and_rest(events: DataFrame, hot_rows: int) -> tuple[DataFrame, DataFrame | None, int]:
    """(events of ordinary users, events of hot ones, how many those are)."""
    hot = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    stats = hot.agg(F.count(F.lit(1)).alias("users"), F.sum("_n").alias("rows")).first()
    if not stats["users"]:
        return events, None, 0
    ids = reliable_checkpoint(hot.select("user_id"))
    ids = F.broadcast(ids) if stats["users"] <= MAX_BROADCAST_IDS else ids
    return events.join(ids, "user_id", "left_anti"), events.join(ids, "user_id", "left_semi"), int(stats["rows"])


def _start_units(starts: DataFrame) -> DataFrame:
    return starts.select(F.col("user_id").cast("long").alias("user_id"), units(F.col("start_balance")).alias("start"))


def _event_units(events: DataFrame, seq: list[str]) -> DataFrame:
    return events.select(F.col("user_id").cast("long").alias("user_id"), *[F.col(c) for c in seq],
                         F.col("txn_id").cast("long").alias("txn_id"), "txn_type", units(F.col("amount")).alias("amount"))


def _replay_in_order(starts: DataFrame, events: DataFrame, seq: list[str]) -> DataFrame:
    """Every user's rows folded in order by one task (hash partitioned by user)."""
    s = starts.select(
        "user_id", F.lit(0).alias("_kind"),
        *[F.lit(None).cast(events.schema[c].dataType).alias(c) for c in seq],
        (F.col("reached") if "reached" in starts.columns else F.lit(None).cast("long")).alias("txn_id"),
        F.lit(None).cast("string").alias("txn_type"),
        F.col("start").alias("amount"))
    e = events.withColumn("_kind", F.lit(1))
    # Start rows sort first; among duplicate starts the largest sorts last and
    # wins, a rule that does not depend on arrival order (stable on retry).
    ordered = (s.unionByName(e).repartition("user_id")
               .sortWithinPartitions("user_id", "_kind", *seq, "txn_id", "amount"))
    return ordered.select("user_id", "_kind", "txn_id", "txn_type", "amount").mapInArrow(_fold, REPLAY_SCHEMA)


def _segments(events: DataFrame, order: list[str], parts: int) -> DataFrame:
    """Histories cut into range partitions, in order, with the partition as _pid."""
    # Checkpointed so both passes see the same partitions in the same order.
    return reliable_checkpoint(events.repartitionByRange(parts, *order).sortWithinPartitions(*order)) \
        .withColumn("_pid", F.spark_partition_id())


def _replay_split(starts: DataFrame, events: DataFrame, seq: list[str], parts: int) -> DataFrame:
    """Hot users' histories summarised and folded segment by segment."""
    order = ["user_id", *seq, "txn_id"]
    chunks = _segments(events, order, parts)
    summaries = chunks.select("_pid", "user_id", "txn_type", "amount").mapInArrow(_summarise, SUMMARY_SCHEMA)
    reached = F.max("reached") if "reached" in starts.columns else F.lit(0).cast("long")
    start = starts.groupBy("user_id").agg(F.max("start").alias("start"), reached.alias("reached"))
    entries = (summaries.join(start, "user_id").repartition("user_id").sortWithinPartitions("user_id", "_pid")
               .mapInArrow(_chain, ENTRY_SCHEMA))
    return (chunks.join(reliable_checkpoint(entries), ["_pid", "user_id"])
            .repartition("_pid", "user_id").sortWithinPartitions("_pid", *order)
            .select("_pid", "user_id", "txn_id", "txn_type", "amount", "_entry", "_offset")
            .mapInArrow(_fold_segments, REPLAY_SCHEMA))


def replay_ledger(starts: DataFrame, events: DataFrame, seq: list[str], hot_rows: int = HOT_USER_ROWS,
                  segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Per-transaction balance after an ordered fold from each user's start (op G5).

    Output: (txn_id, user_id, txn_seq = 1-based position in the user's order,
    balance_after_txn).

    ``starts``: (user_id, start_balance); ``events``: (user_id, txn_id,
    txn_type, amount, *seq). Transactions are applied in (seq..., txn_id)
    order. Users without a start row are skipped. Users with more than
    ``hot_rows`` transactions are split across tasks (module docstring); the
    balances are the same whether they are or not.
    """
    return _replay(_start_units(starts), _event_units(events, seq), seq, hot_rows, segment_rows)


def _replay(starts: DataFrame, events: DataFrame, seq: list[str], hot_rows: int, segment_rows: int) -> DataFrame:
    """``replay_ledger`` over whole units; a start row may carry the position ``reached``."""
    hot = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    stats = hot.agg(F.count(F.lit(1)).alias("users"), F.sum("_n").alias("rows")).first()
    if not stats["users"]:
        return _replay_in_order(starts, events, seq)
    ids = reliable_checkpoint(hot.select(F.col("user_id").alias("_hid")))

    # Routing rows by a known, counted id set: broadcast when the count allows,
    # so a hot user's rows never meet in one reducer just to be routed.
    small = stats["users"] <= MAX_BROADCAST_IDS

    def only(df, how):
        return df.join(F.broadcast(ids) if small else ids, F.col("user_id") == F.col("_hid"), how)

    split = _replay_split(only(starts, "left_semi"), only(events, "left_semi"), seq,
                          -(-int(stats["rows"]) // segment_rows))
    rest = _replay_in_order(only(starts, "left_anti"), only(events, "left_anti"), seq)
    return rest.unionByName(split)


def _reach(batches):
    """Each user's balance and position after the start and the summaries that follow it."""
    user, bal, n, started = None, None, 0, False

    def row():
        return {"user_id": user, "balance_units": bal, "n_txns": n}

    for b in batches:
        out = []
        for r in b.to_pylist():
            if r["user_id"] != user:
                if started:
                    out.append(row())
                user, bal, n, started = r["user_id"], None, 0, False
            if r["_kind"] == 0:
                bal, started = r["start"], True
            elif started:
                bal = None if r["dead"] or bal is None else apply_flats(bal, r["shift"], r["starts"], r["ends"])
                n += r["n"]
        yield pa.RecordBatch.from_pylist(out, _STATE_ARROW)
    if started:
        yield pa.RecordBatch.from_pylist([row()], _STATE_ARROW)


_STATE_ARROW = pa.schema([("user_id", pa.int64()), ("balance_units", pa.int64()), ("n_txns", pa.int64())])


class LedgerLoads:
    """Replay of a ledger that arrives in loads (op G5, incremental).

    A load holds the transactions of one span of the replay order (a day, say)
    and has a number in that order. What is kept of it is one summary a user,
    the load's effect on any balance, so loads may be added in any order and
    added again: a day that comes late changes what later days start from, and
    nothing is read again but summaries. Transactions of one load must not
    reach into the span of another.

    ``<path>/parts`` has the summaries and ``<path>/index``, a versioned table,
    says which of them hold which load, so that every change appears at once.
    """

    def __init__(self, spark: SparkSession, path: str, starts: DataFrame, seq: list[str]):
        self.spark, self.path, self.seq = spark, path.rstrip("/"), seq
        self.starts = _start_units(starts).groupBy("user_id").agg(F.max("start").alias("start"))

    def _index(self) -> dict[int, str]:
        """Folder of each load (one row a load)."""
        rows = read_current(self.spark, f"{self.path}/index", "load int, folder string").collect()
        return {r["load"]: r["folder"] for r in sorted(rows)}

    def _keep(self, summaries: DataFrame, load: int, instead_of) -> None:
        """Write summaries as ``load``; they replace the loads ``instead_of``."""
        folder = f"parts/{load}-{uuid.uuid4().hex[:12]}"
        summaries.write.parquet(f"{self.path}/{folder}")
        index = {n: f for n, f in self._index().items() if n not in instead_of} | {load: folder}
        publish(self.spark.createDataFrame(sorted(index.items()), "load int, folder string").coalesce(1), f"{self.path}/index")

    def loads(self) -> list[int]:
        return list(self._index())

    def add(self, load: int, events: DataFrame, **hot) -> None:
        """Keep the summaries of a load, or replace those it had."""
        self._keep(summarise_load(events, self.seq, **hot), load, [load])

    def compact(self, upto: int) -> None:
        """Compose the loads up to ``upto`` into one, kept under its number; they
        can then no longer be replaced one by one."""
        old = {n: f for n, f in self._index().items() if n <= upto}
        if old:
            rows = reduce(DataFrame.unionByName, [self._part(f).withColumn("_load", F.lit(n)) for n, f in old.items()])
            self._keep(compose_summaries(rows, "_load"), upto, old)

    def _part(self, folder: str) -> DataFrame:
        return self.spark.read.schema(LOAD_SCHEMA).parquet(f"{self.path}/{folder}")

    def state(self, before: int | None = None) -> DataFrame:
        """(user_id, balance_units, n_txns) of every user with a start, after
        all loads (those numbered below ``before``)."""
        rows = self.starts.select("user_id", F.lit(0).alias("_kind"), F.lit(-1).alias("_load"), "start", F.lit(0).cast("long").alias("n"),
                                  F.lit(False).alias("dead"), F.array().cast("array<long>").alias("starts"),
                                  F.array().cast("array<long>").alias("ends"), F.lit(0).cast("long").alias("shift"))
        for n, folder in self._index().items():
            if before is None or n < before:
                rows = rows.unionByName(self._part(folder).withColumns(
                    {"_kind": F.lit(1), "_load": F.lit(n), "start": F.lit(None).cast("long")}))
        return (rows.repartition("user_id").sortWithinPartitions("user_id", "_kind", "_load").mapInArrow(_reach, STATE_SCHEMA))

    def balances(self, load: int, events: DataFrame, hot_rows: int = HOT_USER_ROWS, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
        """What ``replay_ledger`` over all loads gives for this load's transactions."""
        entry = self.state(before=load).select("user_id", F.col("balance_units").alias("start"), F.col("n_txns").alias("reached"))
        return _replay(entry, _event_units(events, self.seq), self.seq, hot_rows, segment_rows)


def latest_state(df: DataFrame, key: str, seq: list[str], cols: list[str]) -> DataFrame:
    """Each key's last row by ``seq`` (op G9), as a partial+final aggregate."""
    last = F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct(*[F.col(c) for c in seq]))
    return df.groupBy(key).agg(last.alias("_s"), F.count(F.lit(1)).alias("n_txns")) \
             .select(key, *[F.col("_s." + c).alias(c) for c in cols], "n_txns")


def final_balances(starts: DataFrame, events: DataFrame, seq: list[str], leverage: Column | None = None,
                   digits: int = 2) -> DataFrame:
    """Every user's balance after replay, rounded, with the levered margin
    balance (ops G5 + G9 + G6). ``leverage`` is a column over ``user_id``.

    A user without transactions keeps the starting balance (``n_txns`` 0).
    The unrounded balance is levered and the result rounded once.
    """
    state = latest_state(replay_ledger(starts, events, seq), "user_id", ["txn_seq"], ["balance_after_txn"])
    first = starts.groupBy(F.col("user_id").cast("long").alias("user_id")).agg(
        F.max("start_balance").alias("start_balance"))
    out = (first.join(state, "user_id", "left")
           .withColumn("n_txns", F.coalesce("n_txns", F.lit(0)))
           .withColumn("_balance", F.when(F.col("n_txns") > 0, F.col("balance_after_txn"))
                       .otherwise(F.col("start_balance")).cast("decimal(24,4)")))
    cols = ["user_id", F.round("_balance", digits).cast("double").alias("total_ledger_balance"), "n_txns"]
    if leverage is not None:
        levered = margin_balance("_balance", leverage.cast("decimal(10,4)")).cast("decimal(38,8)")
        cols.append(F.round(levered, digits).cast("double").alias("margin_balance"))
    return out.select(*cols)
