"""Registered queries: one per operator of the inventory.

Each entry is (spark_fn(spark, sf_dir) -> DataFrame, oracle SQL or None). All
of them read the driver tables (through the adapters) over whole tables and
whole texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootcause import oracle as O
from rootcause.operators import diagnose as D
from rootcause.plans.diagnostics import PLANS
from rootcause.sources import adapters as A

REGISTRY: dict[str, tuple] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return A.telemetry_tables(spark, sf_dir)


# ------------------------------------------------------------ E1-E7, E0

def _diag_query(theme: str):
    def q(spark, sf_dir):
        return D.diagnose(_tables(spark, sf_dir), theme)
    return q


for _theme in PLANS:
    register(f"diagnose_{_theme.lower()}", O.with_adapters(O.diagnose_sql(_theme)))(_diag_query(_theme))


@register("diagnose_all_themes", O.with_adapters(
    f"SELECT complaint_theme, group_key, metric, agg, value, n FROM ({O.diagnose_long_sql()}) d"))
def q_diagnose_all(spark, sf_dir):
    return D.diagnose_long(_tables(spark, sf_dir)).drop("total")


# ------------------------------------------------------------ A3

@register("table_row_counts", O.with_adapters(" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, COUNT(*) AS row_count FROM {t}"
    for t in ("users", "app_performance", "trades", "financial_ledger", "customer_support"))))
def q_table_row_counts(spark, sf_dir):
    T = D.load_tables(spark, _tables(spark, sf_dir))
    return reduce(DataFrame.unionByName, [
        spark.table(t).select(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
        for t in T])


# ------------------------------------------------------------ reviews: B, C, D, E8

from rootcause.operators import classify as C  # noqa: E402
from rootcause.operators import curate as K  # noqa: E402
from rootcause.operators import replies as RP  # noqa: E402
from rootcause.functions import text as X  # noqa: E402
from rootcause.plans import lexicons as L  # noqa: E402
from rootcause.plans import reply_models as M  # noqa: E402
from rootcause.plans import scoped as SC  # noqa: E402
from rootcause.schemas import CATEGORY_COL  # noqa: E402
from rootcause.session import scratch_dir  # noqa: E402


def _reviews(spark, sf_dir):
    return A.review_feed(spark, sf_dir)


_REV = 'seq, "userName", score, "at", content'
# A lexicon that hits the synthetic test corpus (invented prose, where the
# finance words almost never occur), so that every label is exercised.
CORPUS_RULES = [
    ("EXECUTION_SLIPPAGE", X.word_pattern("nicht")),
    ("LEDGER_DISPUTE", X.word_pattern("que")),
    ("SYSTEM_STABILITY", X.word_pattern("with")),
    ("LOGIN_AND_2FA_ISSUE", "@"),
    ("KYC_ONBOARDING_EFFICIENCY", X.word_pattern("licen[sc]e")),
    ("CHARTING_UI_GLITCH", "[0-9]{3}"),
]
_CORPUS_CASE = O.classify_sql("content", CORPUS_RULES)
_FIN_CASE = O.classify_sql("content", L.FINANCE_RULES)
_BATCHES_SQL = " UNION ALL ".join(
    f"(SELECT {_REV} FROM reviews WHERE score = {s} ORDER BY seq LIMIT {c})" for s, c in K.FETCH_CAPS.items())
_QUOTA_CASE = "CASE " + " ".join(f"WHEN score = {s} THEN {q}" for s, q in K.QUOTAS.items()) + " END"
_CURATED_SQL = (f"SELECT {_REV} FROM (SELECT *, row_number() OVER (PARTITION BY score ORDER BY seq) AS rn "
                f"FROM ({_BATCHES_SQL}) b WHERE length(content) > 50 AND score IN "
                f"({', '.join(str(s) for s in K.QUOTAS)})) r WHERE rn <= {_QUOTA_CASE}")


@register("project_reviews", O.with_adapters(f"SELECT {_REV} FROM reviews"))
def q_project_reviews(spark, sf_dir):
    return K.project_reviews(_reviews(spark, sf_dir))


@register("drop_short_reviews", O.with_adapters(f"SELECT seq, score FROM reviews WHERE length(content) > 50"))
def q_drop_short(spark, sf_dir):
    return K.drop_short(_reviews(spark, sf_dir)).select("seq", "score")


@register("review_previews", O.with_adapters(f"SELECT seq, {O.preview_sql('content')} AS preview FROM reviews"))
def q_previews(spark, sf_dir):
    return K.with_preview(_reviews(spark, sf_dir)).select("seq", "preview")


@register("head_reviews", O.with_adapters(f"SELECT {_REV} FROM reviews ORDER BY seq LIMIT 10"))
def q_head(spark, sf_dir):
    return K.head_n(K.project_reviews(_reviews(spark, sf_dir)), 10)


@register("tail_reviews", O.with_adapters(f"SELECT {_REV} FROM reviews ORDER BY seq DESC LIMIT 6"))
def q_tail(spark, sf_dir):
    return K.tail_n(K.project_reviews(_reviews(spark, sf_dir)), 6)


@register("score_batches", O.with_adapters(f"SELECT seq, score FROM ({_BATCHES_SQL}) b"))
def q_score_batches(spark, sf_dir):
    return K.score_batches(_reviews(spark, sf_dir)).select("seq", "score")


@register("union_score_batches", O.with_adapters(f"SELECT seq, score FROM ({_BATCHES_SQL}) b"))
def q_union_batches(spark, sf_dir):
    return K.union_score_batches(_reviews(spark, sf_dir)).select("seq", "score")


@register("curated_sample", O.with_adapters(_CURATED_SQL))
def q_curated(spark, sf_dir):
    return K.curate(_reviews(spark, sf_dir))


@register("reviews_with_category", O.with_adapters(
    f"SELECT seq, score, {_CORPUS_CASE} AS {CATEGORY_COL} FROM reviews"))
def q_with_category(spark, sf_dir):
    df = _reviews(spark, sf_dir)
    return C.with_category(df, C.classify_by_rules("content", CORPUS_RULES)).select("seq", "score", CATEGORY_COL)


@register("classify_finance_lexicon", O.with_adapters(
    f"SELECT seq, {_FIN_CASE} AS {CATEGORY_COL} FROM reviews"))
def q_finance(spark, sf_dir):
    df = _reviews(spark, sf_dir)
    return C.with_category(df, C.classify_by_rules("content", L.FINANCE_RULES)).select("seq", CATEGORY_COL)


# Word tags that hit the corpus, so that every rule of the scope classifier fires.
CORPUS_WORDS = {"que": "C", "nicht": "N", "the": "T", "la": "L", "und": "S", "de": "F", "en": "V", "with": "U", "that": "K", "der": "k",
                "die": "D", "of": "O", "to": "d", "from": "J", "ist": "c", "was": "Q", "le": "Y", "les": "h", "and": "|", "oder": "|"}


@register("classify_by_scope", O.with_adapters(
    f"SELECT seq, {O.scope_sql('content', SC.FINANCE_WORDS)} AS {CATEGORY_COL}, "
    f"{O.scope_sql('content', CORPUS_WORDS)} AS corpus_category FROM reviews"))
def q_scope(spark, sf_dir):
    return _reviews(spark, sf_dir).select("seq", C.classify_by_scope("content").alias(CATEGORY_COL),
                                          C.classify_by_scope("content", CORPUS_WORDS).alias("corpus_category"))


_DIST_SQL = (f"SELECT {_CORPUS_CASE} AS \"Category\", COUNT(*) AS \"Count\" FROM reviews "
             f"WHERE content IS NOT NULL GROUP BY 1")


def _distribution(spark, sf_dir):
    df = _reviews(spark, sf_dir)
    return C.category_distribution(C.with_category(df, C.classify_by_rules("content", CORPUS_RULES)))


@register("category_distribution", O.with_adapters(_DIST_SQL))
def q_distribution(spark, sf_dir):
    return _distribution(spark, sf_dir)


@register("top_category", O.with_adapters(
    f'SELECT * FROM ({_DIST_SQL}) d ORDER BY "Count" DESC, "Category" LIMIT 1'))
def q_top(spark, sf_dir):
    return C.top_category(_distribution(spark, sf_dir))


@register("ranked_categories", O.with_adapters(
    f'SELECT "Category", "Count", CAST(row_number() OVER (ORDER BY "Count" DESC, "Category") - 1 AS INTEGER) AS idx, '
    f'row_number() OVER (ORDER BY "Count" DESC, "Category") = 1 AS is_default FROM ({_DIST_SQL}) d'))
def q_ranked(spark, sf_dir):
    return C.ranked_categories(_distribution(spark, sf_dir))


@register("wrapped_reviews", O.with_adapters("SELECT seq, '<review>' || content || '</review>' AS prompt FROM reviews"))
def q_wrapped(spark, sf_dir):
    return _reviews(spark, sf_dir).select("seq", X.wrap_review("content").alias("prompt"))


def _label_replies(spark, sf_dir):
    return C.batch_infer(_reviews(spark, sf_dir), "content", M.label_model, out="reply", wrap=True)


_LABEL_REPLY = O.label_reply_sql("length(content) + 17")


@register("batch_infer_replies", O.with_adapters(
    f"SELECT seq, {_LABEL_REPLY} AS reply FROM reviews WHERE content IS NOT NULL"))
def q_batch_infer(spark, sf_dir):
    return _label_replies(spark, sf_dir).where(F.col("content").isNotNull()).select("seq", "reply")


@register("extract_labels", O.with_adapters(
    f"SELECT seq, {O.extract_label_sql('reply')} AS {CATEGORY_COL} FROM "
    f"(SELECT seq, {_LABEL_REPLY} AS reply FROM reviews WHERE content IS NOT NULL) r"))
def q_extract_labels(spark, sf_dir):
    df = _label_replies(spark, sf_dir).where(F.col("content").isNotNull())
    return df.select("seq", C.extract_label("reply").alias(CATEGORY_COL))


@register("categorised_reviews", O.with_adapters(
    f"SELECT seq, CASE WHEN content IS NULL THEN NULL WHEN (length(content) + 17) % 10 = 3 THEN 'GENERAL_INQUIRY' "
    f"ELSE {O.extract_label_sql(_LABEL_REPLY)} END AS {CATEGORY_COL} FROM reviews"))
def q_categorised(spark, sf_dir):
    # The model fails on some reviews: those get the default label.
    return C.categorise(_reviews(spark, sf_dir), "content", M.failing_label_model).select("seq", CATEGORY_COL)


_READ_REPLY = O.read_label_reply_sql("'<review>' || content || '</review>'")


@register("stored_replies", O.with_adapters(
    f"SELECT seq, {O.extract_label_sql('reply')} AS {CATEGORY_COL}, times_answered FROM "
    f"(SELECT seq, content, {_READ_REPLY} AS reply, CAST(1 AS BIGINT) AS times_answered FROM reviews WHERE content IS NOT NULL) r"))
def q_stored_replies(spark, sf_dir):
    # Two runs over one store: the second one meets texts that the first one asked about.
    reviews = _reviews(spark, sf_dir).where(F.col("content").isNotNull())
    store = RP.ReplyStore(spark, scratch_dir(spark, "replies"))
    calls = RP.Calls(batch=256)
    RP.infer_stored(reviews.where("score <= 3"), "content", M.reading_model, store, wrap=True, calls=calls)
    replied = RP.infer_stored(reviews, "content", M.reading_model, store, wrap=True, calls=calls)
    times = store.rows().groupBy("digest").agg(F.count("reply").alias("times_answered"))
    digest = F.sha2(X.wrap_review("content"), 256)
    return (replied.withColumn("digest", digest).join(times, "digest")
            .select("seq", C.extract_label("reply").alias(CATEGORY_COL), "times_answered"))


@register("extract_sql_statements", O.with_adapters(
    f"SELECT seq, {O.extract_sql_sql('reply')} AS sql_text FROM "
    f"(SELECT seq, {O.sql_reply_sql('content')} AS reply FROM reviews) r"))
def q_extract_sql(spark, sf_dir):
    df = C.batch_infer(_reviews(spark, sf_dir), "content", M.sql_model, out="reply")
    return df.select("seq", X.extract_sql("reply").alias("sql_text"))


@register("theme_filter_tickets", O.with_adapters(
    "SELECT ticket_id, user_id FROM customer_support WHERE complaint_theme = 'LEDGER_DISPUTE'"))
def q_theme_filter(spark, sf_dir):
    return D.theme_filter(_tables(spark, sf_dir)["customer_support"], "LEDGER_DISPUTE").select("ticket_id", "user_id")


# ------------------------------------------------------------ sources and sinks: A1, A2, A4, A6

from rootcause.operators import cohorts as G  # noqa: E402
from rootcause.operators import ledger as LG  # noqa: E402
from rootcause.operators import quality as Q  # noqa: E402
from rootcause.functions import finance as FN  # noqa: E402
from rootcause.functions.uniform import uniform  # noqa: E402
from rootcause.sources import reviews as RV  # noqa: E402
from rootcause.sources import tables as TB  # noqa: E402
from rootcause.themes import KYC_REASONS, KYC_REASON_WEIGHTS  # noqa: E402


@register("reviews_csv_roundtrip", O.with_adapters('SELECT "userName", score, "at", content FROM reviews'))
def q_csv_roundtrip(spark, sf_dir):
    path = scratch_dir(spark, "reviews-csv")
    RV.write_reviews(K.project_reviews(_reviews(spark, sf_dir), keep=()), path)
    return RV.read_reviews(spark, path)


@register("categorised_roundtrip", O.with_adapters(_DIST_SQL))
def q_categorised_roundtrip(spark, sf_dir):
    path = scratch_dir(spark, "categorised")
    labelled = C.with_category(_reviews(spark, sf_dir), C.classify_by_rules("content", CORPUS_RULES))
    RV.write_reviews(labelled.select(*K.REVIEW_COLS, CATEGORY_COL), path)
    return C.category_distribution(RV.read_categorised(spark, path))


_SUPPORT_COLS = "ticket_id, user_id, complaint_theme, ticket_resolution_time_hours, support_interaction_count"


@register("save_table_roundtrip", O.with_adapters(f"SELECT {_SUPPORT_COLS} FROM customer_support"))
def q_save_table(spark, sf_dir):
    path = scratch_dir(spark, "customer_support")
    TB.save_table(_tables(spark, sf_dir)["customer_support"], path, "customer_support")
    return TB.read_table(spark, path, "customer_support")


def _pk_sql(t, pk):
    return (f"SELECT '{t}' AS table_name, 'pk_unique:{pk}' AS rule, "
            f"CAST(COALESCE(SUM(CASE WHEN n > 1 OR k IS NULL THEN 1 ELSE 0 END), 0) AS BIGINT) AS violations "
            f"FROM (SELECT {pk} AS k, COUNT(*) AS n FROM {t} GROUP BY {pk}) g")


def _fk_sql(t):
    return (f"SELECT '{t}' AS table_name, 'fk:user_id->users.user_id' AS rule, COUNT(*) AS violations "
            f"FROM {t} c WHERE c.user_id IS NOT NULL AND NOT EXISTS "
            f"(SELECT 1 FROM users p WHERE p.user_id = c.user_id)")


@register("constraint_violations", O.with_adapters(" UNION ALL ".join(
    [_pk_sql(t, pk) for t, pk in Q.PRIMARY_KEYS.items()] + [_fk_sql(t) for t in Q.FOREIGN_KEYS])))
def q_constraints(spark, sf_dir):
    return Q.constraint_violations(_tables(spark, sf_dir))


_BUY_SIDE = "(CASE WHEN order_type LIKE '%BUY%' THEN 1 ELSE -1 END)"
_RECOMPUTED_BPS = f"(-{_BUY_SIDE}) * (executed_price - requested_price) / requested_price * 10000.0e0"
_KYC_USERS = "(SELECT user_id FROM users WHERE kyc_status <> 'APPROVED')"
_INVARIANTS_SQL = " UNION ALL ".join([
    *[f"SELECT '{t}' AS table_name, 'kyc_user_has_activity' AS rule, COUNT(*) AS violations FROM {t} "
      f"WHERE user_id IN {_KYC_USERS}" for t in ("trades", "financial_ledger", "app_performance")],
    "SELECT 'customer_support', 'kyc_cohort_overlaps_other_theme', COUNT(*) FROM customer_support "
    "WHERE complaint_theme <> 'KYC_ONBOARDING_EFFICIENCY' AND user_id IN (SELECT user_id FROM customer_support "
    "WHERE complaint_theme = 'KYC_ONBOARDING_EFFICIENCY')",
    "SELECT 'trades', 'slippage_sign', CAST(SUM(CASE WHEN (order_type LIKE '%MARKET' AND price_slippage_bps > 0) "
    "OR (NOT order_type LIKE '%MARKET' AND price_slippage_bps < 0) THEN 1 ELSE 0 END) AS BIGINT) FROM trades",
    f"SELECT 'trades', 'price_bps_agreement', CAST(SUM(CASE WHEN abs({_RECOMPUTED_BPS} - price_slippage_bps) "
    f"> 1e-6 THEN 1 ELSE 0 END) AS BIGINT) FROM trades",
    "SELECT 'trades', 'timeout_code_override', CAST(SUM(CASE WHEN order_routing_latency_ms > 5000 AND "
    "exchange_rejection_code <> 'FAILED TIMEOUT' THEN 1 ELSE 0 END) AS BIGINT) FROM trades",
    "SELECT 'users', 'final_balance_in_ledger', CAST(COALESCE(SUM(1 - hit), 0) AS BIGINT) FROM (SELECT l.user_id, "
    "MAX(CASE WHEN abs(l.balance_after_txn - u.total_ledger_balance) < 0.005e0 THEN 1 ELSE 0 END) AS hit "
    "FROM financial_ledger l JOIN users u ON l.user_id = u.user_id GROUP BY l.user_id) m",
])


@register("telemetry_invariants", O.with_adapters(_INVARIANTS_SQL))
def q_invariants(spark, sf_dir):
    return Q.telemetry_invariants(_tables(spark, sf_dir))


# ------------------------------------------------------------ ledger: G5, G6, G9

_REPLAY_CTES = """ev AS (
  SELECT txn_id, user_id, txn_type, CAST(amount AS DECIMAL(18,4)) AS amount,
    row_number() OVER (PARTITION BY user_id ORDER BY txn_ts, txn_id) AS rn
  FROM ledger_events WHERE user_id IN (SELECT c_custkey FROM customer)
),
rep(user_id, rn, txn_id, bal) AS (
  SELECT c_custkey, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(c_acctbal AS DECIMAL(18,4)) FROM customer
  UNION ALL
  SELECT e.user_id, e.rn, e.txn_id,
    CAST(CASE WHEN e.txn_type = 'DEPOSIT' THEN r.bal + e.amount
         WHEN e.txn_type = 'WITHDRAWAL' THEN (CASE WHEN r.bal <= 0 THEN r.bal ELSE r.bal - least(r.bal, e.amount) END)
         ELSE r.bal - e.amount END AS DECIMAL(18,4))
  FROM rep r JOIN ev e ON e.user_id = r.user_id AND e.rn = r.rn + 1
)"""
_LEVERAGE_SQL = "(CASE user_id % 4 WHEN 0 THEN 1.0e0 WHEN 1 THEN 2.0e0 WHEN 2 THEN 4.0e0 ELSE 5.0e0 END)"


def _ledger_inputs(spark, sf_dir):
    src = A.read_sources(spark, sf_dir, ("customer", "orders"))
    starts = src["customer"].select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("start_balance"))
    return starts, A.ledger_events(src["orders"])


def _leverage():
    out = F.lit(None).cast("double")
    for i, lev in reversed(list(enumerate(A.LEVERAGE))):
        out = F.when(F.col("user_id") % 4 == i, F.lit(lev)).otherwise(out)
    return out


@register("ledger_replay", O.with_adapters(
    "SELECT txn_id, user_id, rn AS txn_seq, CAST(bal AS DOUBLE) AS balance_after_txn FROM rep WHERE rn > 0",
    _REPLAY_CTES, recursive=True))
def q_ledger_replay(spark, sf_dir):
    starts, events = _ledger_inputs(spark, sf_dir)
    return LG.replay_ledger(starts, events, ["txn_ts"])


# Three loads by date, the middle one added last: balances and final state as of one replay.
_LOADS = [("txn_ts < TIMESTAMP_NTZ '1994-06-01'", 0), ("txn_ts >= TIMESTAMP_NTZ '1996-06-01'", 2),
          ("txn_ts >= TIMESTAMP_NTZ '1994-06-01' AND txn_ts < TIMESTAMP_NTZ '1996-06-01'", 1)]


@register("ledger_in_loads", O.with_adapters(
    "SELECT txn_id, user_id, rn AS txn_seq, CAST(bal AS DOUBLE) AS balance_after_txn, "
    "CAST(last_value(bal) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS DOUBLE) "
    "AS final_balance FROM rep WHERE rn > 0", _REPLAY_CTES, recursive=True))
def q_ledger_in_loads(spark, sf_dir):
    starts, events = _ledger_inputs(spark, sf_dir)
    ledger = LG.LedgerLoads(spark, scratch_dir(spark, "ledger"), starts, ["txn_ts"])
    for part, load in _LOADS:
        ledger.add(load, events.where(part))
    balances = reduce(DataFrame.unionByName, [ledger.balances(load, events.where(part)) for part, load in _LOADS])
    final = ledger.state().select("user_id", (F.col("balance_units") / F.lit(float(LG.UNITS))).alias("final_balance"))
    return balances.join(final, "user_id")


@register("ledger_final_state", O.with_adapters(
    "SELECT user_id, CAST(round(bal, 2) AS DOUBLE) AS total_ledger_balance, rn AS n_txns, "
    "CAST(round(CASE WHEN bal > 0 THEN bal * CAST(CASE user_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 5 END "
    "AS DECIMAL(2,0)) ELSE bal END, 2) AS DOUBLE) AS margin_balance "
    "FROM (SELECT *, max(rn) OVER (PARTITION BY user_id) AS last_rn FROM rep) s WHERE rn = last_rn",
    _REPLAY_CTES, recursive=True))
def q_ledger_final(spark, sf_dir):
    starts, events = _ledger_inputs(spark, sf_dir)
    return LG.final_balances(starts, events, ["txn_ts"], leverage=_leverage())


@register("margin_balances", O.with_adapters(
    f"SELECT user_id, CASE WHEN total_ledger_balance > 0 THEN total_ledger_balance * {_LEVERAGE_SQL} "
    f"ELSE total_ledger_balance END AS margin_balance FROM users"))
def q_margin(spark, sf_dir):
    u = _tables(spark, sf_dir)["users"]
    return u.select("user_id", FN.margin_balance("total_ledger_balance", _leverage()).alias("margin_balance"))


# ------------------------------------------------------------ trades: G7, G8

@register("slippage_recomputed", O.with_adapters(
    f"SELECT order_id, order_type, {_RECOMPUTED_BPS} AS slippage_bps, "
    f"requested_price * (1.0e0 + {_BUY_SIDE} * (-price_slippage_bps) / 10000.0e0) AS fill_price FROM trades"))
def q_slippage(spark, sf_dir):
    t = _tables(spark, sf_dir)["trades"]
    return t.select("order_id", "order_type",
                    FN.slippage_bps("order_type", "requested_price", "executed_price").alias("slippage_bps"),
                    FN.executed_price("order_type", "requested_price", "price_slippage_bps").alias("fill_price"))


@register("rejection_codes", O.with_adapters(
    "SELECT CASE WHEN l_quantity * 110.0e0 > 5000 THEN 'FAILED TIMEOUT' ELSE (CASE WHEN l_partkey % 10 = 0 "
    "THEN 'INSUFFICIENT_DEPTH' WHEN l_partkey % 10 = 1 THEN 'INVALID_TICK_SIZE' ELSE 'NONE' END) END "
    "AS exchange_rejection_code, COUNT(*) AS n FROM lineitem GROUP BY 1"))
def q_rejection(spark, sf_dir):
    li = A.read_sources(spark, sf_dir, ("lineitem",))["lineitem"]
    base = (F.when(F.col("l_partkey") % 10 == 0, "INSUFFICIENT_DEPTH")
            .when(F.col("l_partkey") % 10 == 1, "INVALID_TICK_SIZE").otherwise("NONE"))
    code = FN.rejection_code(F.col("l_quantity") * F.lit(110.0), base)
    return li.groupBy(code.alias("exchange_rejection_code")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------ cohorts: G1-G4, G10, G11

def _u_sql(key, salt):
    return O.uniform_sql(key, salt)


_APPROVED = "(SELECT user_id FROM users WHERE kyc_status = 'APPROVED')"


def _k_of(df, num, den):
    return df.count() * num // den


@register("split_kyc_cohort", O.with_adapters(
    f"SELECT user_id, CASE WHEN rn <= (SELECT COUNT(*) * 650 // 5000 FROM users) THEN 'first' ELSE 'rest' END "
    f"AS part FROM (SELECT user_id, row_number() OVER (ORDER BY {_u_sql('user_id', 'kyc_split')}, user_id) AS rn "
    f"FROM users) r"))
def q_split(spark, sf_dir):
    u = _tables(spark, sf_dir)["users"].select("user_id")
    flagged = G.split_flag(u, "user_id", _k_of(u, 650, 5000), "kyc_split", "first")
    return flagged.select("user_id", F.when(F.col("first"), "first").otherwise("rest").alias("part"))


# The cohorts and how many of 4350 approved users each has.
_SAMPLES = [("auth", 250), ("chart", 821), ("stability", 517), ("slippage", 1135), ("ledger", 703), ("inquiry", 924)]


@register("sample_cohorts", O.with_adapters(" UNION ALL ".join(
    f"SELECT '{salt}' AS cohort, user_id FROM (SELECT user_id, row_number() OVER "
    f"(ORDER BY {_u_sql('user_id', salt)}, user_id) AS rn FROM {_APPROVED} a) r "
    f"WHERE rn <= (SELECT COUNT(*) * {k} // 4350 FROM {_APPROVED} b)" for salt, k in _SAMPLES)))
def q_samples(spark, sf_dir):
    approved = _tables(spark, sf_dir)["users"].where(F.col("kyc_status") == "APPROVED").select("user_id")
    n = approved.count()
    return reduce(DataFrame.unionByName, [
        G.sample_exact(approved, "user_id", n * k // 4350, salt).select(F.lit(salt).alias("cohort"), "user_id")
        for salt, k in _SAMPLES])


@register("kyc_reason_assignment", O.with_adapters(
    f"SELECT user_id, {O.kyc_reason_sql(_u_sql('user_id', 'kyc_reason'))} "
    f"AS reason FROM users WHERE kyc_status <> 'APPROVED'"))
def q_weighted(spark, sf_dir):
    u = _tables(spark, sf_dir)["users"].where(F.col("kyc_status") != "APPROVED")
    return u.select("user_id", G.weighted_bucket(uniform("user_id", "kyc_reason"), KYC_REASONS,
                                                 KYC_REASON_WEIGHTS).alias("reason"))


@register("draws_with_replacement", O.with_adapters(
    "SELECT d.draw_id, x.user_id FROM draws d JOIN idx x ON x.i = d.j",
    f"idx AS (SELECT user_id, row_number() OVER (ORDER BY {_u_sql('user_id', 'healthy')}, user_id) AS i "
    f"FROM {_APPROVED} a),\n"
    f"draws AS (SELECT i - 1 AS draw_id, CAST(floor({_u_sql('i - 1', 'healthy')} * "
    f"(SELECT COUNT(*) FROM idx)) AS BIGINT) + 1 AS j FROM idx)"))
def q_draws(spark, sf_dir):
    approved = _tables(spark, sf_dir)["users"].where(F.col("kyc_status") == "APPROVED").select("user_id")
    return G.sample_with_replacement(approved, "user_id", approved.count(), "healthy")


@register("session_surrogate_ids", O.with_adapters(
    f"SELECT session_id, row_number() OVER (ORDER BY {_u_sql('session_id', 'shuffle')}, session_id) AS id "
    f"FROM app_performance"))
def q_surrogate(spark, sf_dir):
    p = _tables(spark, sf_dir)["app_performance"].select("session_id")
    return G.surrogate_ids(p.withColumn("_u", uniform("session_id", "shuffle")), ["_u", "session_id"]).drop("_u")


@register("cohort_tickets", O.with_adapters(f"SELECT {_SUPPORT_COLS} FROM customer_support"))
def q_cohort_tickets(spark, sf_dir):
    return _tables(spark, sf_dir)["customer_support"]


# ------------------------------------------------------------ interpretation: F1-F6, E9, E10

from rootcause.operators import insight as IN  # noqa: E402
from rootcause.operators import severity as SV  # noqa: E402
from rootcause.themes import ACTIONS_HEADING, INSIGHT_HEADING  # noqa: E402


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_DISPLAY = (f"(CASE WHEN agg = 'count' THEN CAST(n AS VARCHAR) ELSE {O.fmt_ratio_2dp_sql('millionths', 'n')} END) "
            f"|| {O.unit_suffix_sql('metric')}")
_DL_CTES = f"dl AS ({O.diagnose_long_sql()}),\ndisp AS (SELECT *, {_DISPLAY} AS display FROM dl)"
_CELL = "metric || '=' || coalesce(display, 'null')"
_TEXT_CTES = _DL_CTES + (
    f",\nrowlines AS (SELECT complaint_theme, coalesce(group_key || ' | ', '') || "
    f"string_agg({_CELL}, ' | ' ORDER BY {_CELL}) AS line FROM disp GROUP BY complaint_theme, group_key),\n"
    f"mtext AS (SELECT complaint_theme, string_agg(line, chr(10) ORDER BY line) AS metrics_text "
    f"FROM rowlines GROUP BY complaint_theme)")
_WORST_CTES = _DL_CTES + ",\n" + O.severity_ctes()
_S1 = ("complaint_theme || ' complaints trace to ' || severity_metric || ' at ' || "
       "coalesce(severity_display, 'no data') || coalesce(' for ' || group_key, '') || '.'")
_SUMMARY = (f"concat_ws(chr(10), {_lit(INSIGHT_HEADING)}, {_S1} || ' ' || "
            f"'Act on this cohort before the complaint volume grows.', '', {_lit(ACTIONS_HEADING)}, "
            f"'- **Engineering**: fix the logic behind ' || severity_metric || ' for the affected cohort.', "
            f"'- **Infrastructure**: add capacity and alerting on ' || severity_metric || '.', "
            f"'- **Product**: notify the affected ' || complaint_theme || ' cohort in-app while the fix ships.')")
_SUMMARY_CTES = _WORST_CTES + f",\nsummaries AS (SELECT complaint_theme, {_SUMMARY} AS summary FROM worst)"


def _long(spark, sf_dir):
    return D.diagnose_long(_tables(spark, sf_dir))


def _summaries(spark, sf_dir):
    T = _tables(spark, sf_dir)
    return IN.summarise(D.diagnose_long(T), base=SV.baseline(T))


@register("formatted_metrics", O.with_adapters(
    "SELECT complaint_theme, group_key, metric, display FROM disp", _DL_CTES))
def q_formatted(spark, sf_dir):
    return IN.with_display(_long(spark, sf_dir)).select("complaint_theme", "group_key", "metric", "display")


@register("metrics_text", O.with_adapters("SELECT complaint_theme, metrics_text FROM mtext", _TEXT_CTES))
def q_metrics_text(spark, sf_dir):
    return IN.metrics_to_text(_long(spark, sf_dir))


@register("worst_rows", O.with_adapters("SELECT * FROM worst", _WORST_CTES))
def q_worst(spark, sf_dir):
    T = _tables(spark, sf_dir)
    return IN.worst_row(D.diagnose_long(T), SV.baseline(T))


_REQ_HEAD, _REQ_REST = IN.INSIGHT_REQUEST.split("{theme}")
_REQ_MID, _REQ_TAIL = _REQ_REST.split("{text}")


@register("insight_requests", O.with_adapters(
    f"SELECT complaint_theme, {_lit(_REQ_HEAD)} || complaint_theme || {_lit(_REQ_MID)} || metrics_text || "
    f"{_lit(_REQ_TAIL)} AS request FROM mtext", _TEXT_CTES))
def q_requests(spark, sf_dir):
    t = IN.metrics_to_text(_long(spark, sf_dir))
    return t.select("complaint_theme", IN.insight_request("complaint_theme", "metrics_text").alias("request"))


@register("executive_summaries", O.with_adapters("SELECT * FROM summaries", _SUMMARY_CTES))
def q_summaries(spark, sf_dir):
    return _summaries(spark, sf_dir)


_ACTIONS_LINES = (f"list_filter(string_split(split_part(summary, {_lit(ACTIONS_HEADING)}, 2), chr(10)), "
                  f"lambda x: trim(x) <> '')")
_CONTRACT_CTES = _SUMMARY_CTES + f""",
checked AS (SELECT complaint_theme, starts_with(summary, {_lit(INSIGHT_HEADING)} || chr(10)) AS has_heading,
  CAST(len(list_filter(string_split_regex(trim(split_part(substr(summary, {len(INSIGHT_HEADING) + 1}), {_lit(ACTIONS_HEADING)}, 1),
    ' ' || chr(10)), '[.!?]+(\\s+|$)'), lambda x: x <> '')) AS BIGINT) AS sentence_count,
  CAST(len(list_filter(string_split(summary, chr(10)), lambda x: regexp_matches(x, '^[ \\t]*[-*] '))) AS BIGINT) AS bullet_count,
  contains(summary, '- **Engineering**') AND contains(summary, '- **Infrastructure**')
    AND contains(summary, '- **Product**') AS has_owners,
  len(list_filter({_ACTIONS_LINES}, lambda x: NOT regexp_matches(x, '^[ \\t]*[-*] '))) = 0 AS no_chatter,
  NOT regexp_matches(summary, '[0-9]% *bps|bps *%') AS bps_not_percent FROM summaries)"""


@register("summary_contract", O.with_adapters(
    "SELECT *, has_heading AND sentence_count = 2 AND bullet_count = 3 AND has_owners AND no_chatter "
    "AND bps_not_percent AS ok FROM checked", _CONTRACT_CTES))
def q_summary_contract(spark, sf_dir):
    return IN.summary_contract(_summaries(spark, sf_dir))


@register("run_sql_ledger_dispute", O.with_adapters(O.diagnose_sql("LEDGER_DISPUTE")))
def q_run_sql(spark, sf_dir):
    D.load_tables(spark, _tables(spark, sf_dir))
    return D.run_sql(spark, D.plan_sql("LEDGER_DISPUTE"))


# What the contract asks of each column, all of which the diagnostics keep.
_CONTRACT_VALUES = ", ".join(
    f"('{theme}', '{column}', '{rule}', TRUE)" for theme, _, group, metrics, *_ in O.DIAGNOSTICS
    for column, rule in [*((alias, r) for alias, _, _ in metrics for r in ("unit_suffix_kept", "allowed_aggregate")),
                         *([(group, "no_id_grouping")] if group else [])])


@register("result_contract", O.with_adapters(
    "SELECT v.complaint_theme, v.column_name, v.rule, v.ok, COALESCE(r.result_rows, 0) AS result_rows "
    f"FROM (VALUES {_CONTRACT_VALUES}) v(complaint_theme, column_name, rule, ok) LEFT JOIN "
    "(SELECT complaint_theme, COUNT(DISTINCT coalesce(group_key, '')) AS result_rows FROM dl GROUP BY 1) r "
    "ON r.complaint_theme = v.complaint_theme", _DL_CTES))
def q_result_contract(spark, sf_dir):
    T = _tables(spark, sf_dir)
    rows = []
    for theme, plan in PLANS.items():
        for column, rule, ok in D.result_contract(D.diagnose(T, theme), plan):
            rows.append((theme, column, rule, ok))
    checks = spark.createDataFrame(rows, "complaint_theme string, column_name string, rule string, ok boolean")
    sizes = (D.diagnose_long(T).groupBy("complaint_theme")
             .agg(F.countDistinct(F.coalesce(F.col("group_key"), F.lit(""))).alias("result_rows")))
    return checks.join(sizes, "complaint_theme", "left").withColumn(
        "result_rows", F.coalesce(F.col("result_rows"), F.lit(0).cast("long")))


# Replies of the stand-in model by theme: (rules that the statement breaks, statement fails). One
# that breaks a rule is not run, one over an unknown table fails when it runs: an Error row either way.
_REPLY_FATES = {
    "EXECUTION_SLIPPAGE": ("", False), "SYSTEM_STABILITY": ("", False), "LEDGER_DISPUTE": ("", False),
    "CHARTING_UI_GLITCH": ("no_count_distinct,unit_suffix_kept", True), "LOGIN_AND_2FA_ISSUE": ("no_id_grouping", True),
    "KYC_ONBOARDING_EFFICIENCY": ("is_query,has_aggregate", True), "GENERAL_INQUIRY": ("", True)}


@register("theme_statements", O.with_adapters(" UNION ALL ".join(
    f"SELECT '{t}' AS complaint_theme, {str(not broken).upper()} AS keeps_contract, '{broken}' AS broken_rules, "
    f"{str(fails).upper()} AS failed, COUNT(*) AS result_rows FROM ({'SELECT 1' if fails else O.diagnose_sql(t)}) r"
    for t, (broken, fails) in _REPLY_FATES.items())))
def q_theme_statements(spark, sf_dir):
    D.load_tables(spark, _tables(spark, sf_dir))
    replies = spark.createDataFrame([(t, M.theme_sql_reply(t)) for t in PLANS], "complaint_theme string, reply string")
    return D.run_replies(spark, replies)


# ------------------------------------------------------------ flagship and streaming: H1, H2

from rootcause.plans.triage import executive_report, triage_report  # noqa: E402
from rootcause.streaming import categorise as ST  # noqa: E402
from pyspark.sql import types as _T  # noqa: E402

_RANKED_SQL = (
    f"SELECT \"Category\" AS complaint_theme, \"Count\" AS review_count, "
    f"CAST(row_number() OVER (ORDER BY \"Count\" DESC, \"Category\") - 1 AS INTEGER) AS rank_idx FROM ({_DIST_SQL}) d")


@register("triage_report", O.with_adapters(
    "SELECT coalesce(d.complaint_theme, r.complaint_theme) AS complaint_theme, "
    "coalesce(r.review_count, 0) AS review_count, r.rank_idx, d.group_key, d.metric, d.value, d.display "
    "FROM disp d FULL OUTER JOIN ranked r ON d.complaint_theme = r.complaint_theme",
    _DL_CTES + f",\nranked AS ({_RANKED_SQL})"))
def q_triage(spark, sf_dir):
    return triage_report(_reviews(spark, sf_dir), _tables(spark, sf_dir), CORPUS_RULES)


@register("executive_report", O.with_adapters(
    "SELECT s.complaint_theme, coalesce(r.review_count, 0) AS review_count, r.rank_idx, s.summary "
    "FROM summaries s LEFT JOIN ranked r ON s.complaint_theme = r.complaint_theme",
    _SUMMARY_CTES + f",\nranked AS ({_RANKED_SQL})"))
def q_executive_report(spark, sf_dir):
    return executive_report(_reviews(spark, sf_dir), _tables(spark, sf_dir), CORPUS_RULES)


_FEED_SCHEMA = _T.StructType([
    _T.StructField("seq", _T.LongType()), _T.StructField("userName", _T.StringType()),
    _T.StructField("score", _T.IntegerType()), _T.StructField("at", _T.TimestampNTZType()),
    _T.StructField("content", _T.StringType())])


def _land_feed(spark, sf_dir) -> str:
    """Land the review feed at its own parallelism, the way an acquisition job would."""
    landing = scratch_dir(spark, "landing")
    _reviews(spark, sf_dir).write.parquet(landing)
    return landing


@register("stream_categorise", O.with_adapters(
    f"SELECT seq, score, {_CORPUS_CASE} AS {CATEGORY_COL} FROM reviews"))
def q_stream_categorise(spark, sf_dir):
    landing = _land_feed(spark, sf_dir)
    sink, ckpt = scratch_dir(spark, "labelled"), scratch_dir(spark, "ckpt-labelled")
    ST.stream_categorise(spark, landing, sink, ckpt, _FEED_SCHEMA, CORPUS_RULES).awaitTermination()
    return spark.read.parquet(sink).select("seq", "score", CATEGORY_COL)


@register("stream_distribution", O.with_adapters(_DIST_SQL))
def q_stream_distribution(spark, sf_dir):
    landing = _land_feed(spark, sf_dir)
    out = scratch_dir(spark, "category-counts")
    ST.stream_distribution(spark, landing, scratch_dir(spark, "ckpt-counts"), _FEED_SCHEMA, out,
                           CORPUS_RULES).awaitTermination()
    return ST.current_distribution(spark, out)


def _land_again(spark, sf_dir, landing: str, part: str) -> None:
    _reviews(spark, sf_dir).where(part).write.mode("append").parquet(landing)


@register("stream_relanded", O.with_adapters(
    f"SELECT seq, score, {_CORPUS_CASE} AS {CATEGORY_COL} FROM reviews"))
def q_stream_relanded(spark, sf_dir):
    # The first half lands, then everything: the first half is there twice.
    landing, sink, ckpt = (scratch_dir(spark, n) for n in ("landing", "labelled", "ckpt-relanded"))
    for part in ("seq % 2 = 0", "true"):
        _land_again(spark, sf_dir, landing, part)
        ST.stream_categorise(spark, landing, sink, ckpt, _FEED_SCHEMA, CORPUS_RULES, dedupe_within="3650 days").awaitTermination()
    return spark.read.parquet(sink).select("seq", "score", CATEGORY_COL)


_WINDOW_SECONDS = 600


# Reviews land in three loads, latest event times last but for a rest of every 97th review, which comes
# after the watermark (half an hour behind the latest) has passed most of its windows.
@register("stream_windows", O.with_adapters(
    f"SELECT w AS window_start, w + to_seconds({_WINDOW_SECONDS}) AS window_end, \"Category\", COUNT(*) AS \"Count\", "
    f"COUNT(*) FILTER (late) AS late_count, any_value(w + to_seconds({_WINDOW_SECONDS}) <= top - to_seconds(1800)) AS final FROM ("
    f"SELECT time_bucket(to_seconds({_WINDOW_SECONDS}), \"at\", TIMESTAMP '1970-01-01') AS w, \"Category\", "
    f"max(\"at\") OVER () AS top, seq % 97 = 0 AND time_bucket(to_seconds({_WINDOW_SECONDS}), \"at\", TIMESTAMP '1970-01-01') + "
    f"to_seconds({_WINDOW_SECONDS}) <= (max(\"at\") FILTER (seq % 97 <> 0) OVER ()) - to_seconds(1800) AS late FROM "
    f"(SELECT seq, \"at\", {_CORPUS_CASE} AS \"Category\" FROM reviews) r WHERE \"Category\" IS NOT NULL) x "
    f"GROUP BY w, \"Category\""))
def q_stream_windows(spark, sf_dir):
    landing, out, ckpt = (scratch_dir(spark, n) for n in ("landing", "windows", "ckpt-windows"))
    middle = _reviews(spark, sf_dir).agg(F.expr("percentile_approx(seq, 0.5, 100)")).first()[0] or 0
    for part in (f"seq % 97 <> 0 AND seq < {middle}", f"seq % 97 <> 0 AND seq >= {middle}", "seq % 97 = 0"):
        _land_again(spark, sf_dir, landing, part)
        ST.stream_windows(spark, landing, ckpt, _FEED_SCHEMA, out, f"{_WINDOW_SECONDS} seconds", "30 minutes", CORPUS_RULES).awaitTermination()
    return ST.current_windows(spark, out, "30 minutes")
