"""Line dedup, the conversation trie and whitening against plain versions."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tests.conftest import SF_SMALL
from tests.llm.test_corpus_operators import awkward_texts, frame, key, same

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- lines ------------------------------------------------------------------

def plain_lines(rows, min_chars=20, min_docs=3, keep=max):
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = line.strip(BLANK).translate(LOWER)
            if i is not None and len(k) >= min_chars:
                held[k].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(ids := held.get(x.strip(BLANK).translate(LOWER), ())) < min_docs or keep(ids) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def line_rows():
    rng = random.Random(3)
    common = "This line is said in a third of all documents"
    pool = [f"boilerplate number {k} of the pool" for k in range(12)] + ["Ünïcode " * 3, "ÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉ", "x" * 19, "y" * 20, "日本語" * 7]
    rows = awkward_texts()
    for i in range(40, 140):
        lines = [rng.choice(["", " ", "\t"]) + rng.choice([str.upper, str])(rng.choice(pool)) + rng.choice(["", " \r", "\x0b"])
                 for _ in range(rng.randrange(6))]
        lines += [common] * (i % 3 == 0) + [f"a line of document {i} alone, as it is"] + ["twice " * 9] * (2 * (i % 17 == 0))
        rng.shuffle(lines)
        rows.append((i // 2 * 2 if i > 130 else i, "\n".join(lines)))
    rows += [(None, common), (500, "\n".join([common] * 300)), (501, None), (502, "\n\n"), (503, "z" * 300_000 + "\n" + common)]
    return rows


@pytest.mark.parametrize("bounds", [{}, {"broadcast_pages": 0}, {"broadcast_lines": 0}, {"broadcast_pages": 0, "broadcast_lines": 0}])
def test_lines(spark, bounds):
    from rootcause.llm.line_dedup import dedup_lines
    rows = line_rows()
    same(dedup_lines(frame(spark, rows).repartition(7), **bounds), plain_lines(rows))


def test_lines_first_other_limits_and_empty(spark):
    from rootcause.llm.line_dedup import dedup_lines
    rows = line_rows()
    same(dedup_lines(frame(spark, rows).repartition(3), min_chars=5, min_docs=2, keep="first"), plain_lines(rows, 5, 2, min))
    assert dedup_lines(frame(spark, [])).count() == 0
    same(dedup_lines(frame(spark, [(1, None), (None, None)])), [(1, "", 1, 0), (None, "", 1, 0)])


def test_line_filter_suspects_every_repeat_and_little_else(spark):
    from rootcause.llm.line_dedup import line_digest, repeated_lines
    rows = [(i, "\n".join(f"line {i * 50 + k} that nobody else has" for k in range(50)) + f"\nshared line number {i // 2} of two") for i in range(400)]
    suspects, drops = repeated_lines(frame(spark, rows).select("doc_id", "text").repartition(9))
    got = {(r["doc_id"], r["hi"], r["lo"]) for r in suspects.collect()}
    for i, t in rows:
        assert (i, *np.frombuffer(line_digest(t.split("\n")[-1].encode(), 20), "<i8").tolist()) in got
    assert len(got) < 400 + 0.01 * 20_000
    assert drops.count() == 0


def test_lines_of_the_table(spark):
    from rootcause.llm.line_dedup import dedup_lines
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    same(dedup_lines(df), plain_lines([tuple(r) for r in df.select("doc_id", "text").collect()]))


# -- conversations ----------------------------------------------------------

def plain_trie(rows, family=5, most=9):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0), tie, (role, text)))
    own = {c: [t for _, _, t in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % most
        built = tuple(own.get(c - int(math.fmod(c, family)), [])[:h] + own[c][h:])
        for d in range(len(built) + 1):
            members[built[:d]].append(c)
        ends[built].append(c)
    kids = defaultdict(int)
    for n in members:
        if n:
            kids[n[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not kids[n]
            saved[n[:d]] += (len(m) - 1) * len(n[-1][1].encode()) if n else 0
    return [(min(m), len(n), min(members[n[:-1]]) if n else None, len(m), kids[n], leaves[n], saved[n],
             hashlib.sha256(",".join(map(str, ends.get(n, []))).encode()).hexdigest()) for n, m in members.items()]


SCHEMA = "conv_id long, turn long, role string, text string, depth int, path string, key string, n_convs int"


def talks(spark, rows, parts=6):
    return spark.createDataFrame([(*r, 1, "p", "k", 2) for r in rows], SCHEMA).repartition(parts)


def talk_rows(seed, n, texts=3, turns=7):
    rng = random.Random(seed)
    words = ["", None, "hello", "größer", "yes", "no", "why not", "😀"][:texts + 2]
    rows = [(c, t, rng.choice(["user", "assistant", None][:2 + seed % 2]), rng.choice(words))
            for c in range(n) for t in range(rng.randrange(1, turns))]
    rows += [(c, t, "user", "the same for a third") for c in range(1000, 1000 + n // 2) for t in range(3)]
    rows += [(7777, t, "user", f"turn {t // 2}") for t in range(300)] + [(7778, t, "user", f"turn {t // 2}") for t in range(250)]
    rows += [(9001, 0, "user", "only")] + [(None, 1, "user", "nobody's"), (-3, 2, "a", "b"), (-3, None, "a", "c"), (-3, 2, "a", "b"), (-5, 1, "q", "r")]
    return rows


@pytest.mark.parametrize("seed, block", [(1, 2), (2, 7), (3, 100_000), (4, 1)])
def test_trie(spark, seed, block):
    from rootcause.llm.prefix_trie import prefix_trie
    rows = talk_rows(seed, 150, texts=1 + seed)
    same(prefix_trie(talks(spark, rows), block_paths=block), plain_trie(rows))


def test_trie_of_few(spark):
    from rootcause.llm.prefix_trie import prefix_trie
    assert prefix_trie(talks(spark, [])).count() == 0
    one = [(3, None, None, None)]
    same(prefix_trie(talks(spark, one)), plain_trie(one))
    # Conversations that are left without any turn are members of the root.
    short = [(c, 0, "user", "x") for c in range(1, 40) if c % 5]
    want = plain_trie(short)
    assert any(d == 0 and e != hashlib.sha256(b"").hexdigest() for _, d, *_, e in want)
    same(prefix_trie(talks(spark, short)), want)


def test_trie_of_the_table(spark):
    from rootcause.llm.prefix_trie import prefix_trie
    df = spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
    same(prefix_trie(df), plain_trie([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]))


# -- whitening --------------------------------------------------------------

def vectors_of(spark, rows, parts=5):
    return (spark.createDataFrame([(i, v, 1, 2.0, 3) for i, v in rows], "vec_id long, embedding array<float>, n int, whitened double, d int")
            .repartition(parts))


def white_rows(rows, d):
    good = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows
            if v and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([v for _, v in good], float)
    mean = x.mean(0)
    values, vectors = np.linalg.eigh((x - mean).T @ (x - mean) / len(x))
    return good, x - mean, values[::-1], vectors[:, ::-1]


def check_whitening(spark, rows, d, components=32):
    from rootcause.llm.whitening import whiten
    good, y, values, vectors = white_rows(rows, d)
    got = defaultdict(list)
    for r in whiten(vectors_of(spark, rows), components).collect():
        got[r["component"]].append(r)
    rank = min(components, int((values > 1e-9 * values[0]).sum()))
    assert sorted(got) == list(range(1, rank + 1))
    sums = [sum(v[j] for _, v in good) for j in range(d)]
    dev = sorted(((i, sum((len(good) * a - s) ** 2 for a, s in zip(v, sums))) for i, v in good), key=key)
    white = []
    for c in range(1, rank + 1):
        rs = sorted(got[c], key=lambda r: (key((r["vec_id"],)), r["deviation"], abs(r["whitened"])))
        assert sorted(((r["vec_id"], int(r["deviation"])) for r in rs), key=key) == dev
        assert {r["n"] for r in rs} == {len(good)}
        assert all(math.isclose(r["explained"], values[c - 1] / values.sum(), rel_tol=1e-9) for r in rs)
        white.append({r["vec_id"]: r["whitened"] for r in rs})
    at = [k for k, (i, _) in enumerate(good) if [j for j, _ in good].count(i) == 1]
    z = np.array([[w[good[k][0]] for w in white] for k in at])
    if len(at) == len(good):
        assert np.abs(z.T @ z / len(z) - np.eye(rank)).max() < 1e-8
        error = {r["identity_error"] for rs in got.values() for r in rs}
        assert len(error) == 1 and error.pop() < 1e-8
    apart = [c for c in range(rank) if min([abs(values[c] - v) for k, v in enumerate(values) if k != c], default=1) > 1e-3 * values[0]]
    for c in apart:
        want = y[at] @ vectors[:, c] / np.sqrt(values[c])
        assert min(np.abs(z[:, c] - want).max(), np.abs(z[:, c] + want).max()) < 1e-7
    return apart


def test_whitening(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(40) * np.linspace(4, 0.2, 40)).tolist()) for i in range(600)]
    assert len(check_whitening(spark, rows, 40)) > 10
    # A small dimension, vectors off the origin, copies and rows that are left out.
    few = [(i, [5.0 + c for c in v[:3]]) for i, v in rows[:50]] + [(900, None), (901, []), (902, [1.0, None, 2.0]), (903, [math.nan, 1.0, 1.0]),
           (904, [math.inf, 0.0, 0.0]), (905, [1.0, 2.0]), (906, [1e30, 0.0, 0.0])]
    from rootcause.llm.whitening import whiten
    assert {r["vec_id"] for r in whiten(vectors_of(spark, few)).collect()} == set(range(50))
    check_whitening(spark, [r for r in few if r[0] != 906], 3)
    check_whitening(spark, few[:20] + [(None, few[3][1]), (7, few[3][1])], 3, components=2)


def test_whitening_without_spread(spark):
    from rootcause.llm.whitening import whiten
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whiten(vectors_of(spark, rows)).count() == 0
    # Variance in one direction alone: one component.
    line = [(i, [float(i), 2.0 * i, 7.0]) for i in range(9)]
    assert {r["component"] for r in whiten(vectors_of(spark, line)).collect()} == {1}


def test_deviations_beyond_64_bits():
    from rootcause.llm.whitening import Mean
    x = np.array([[10**9, -10**9], [3, 4]])
    n, sums = 10**6, [123_456_789, -5]
    assert Mean(n, sums).deviations(x) == [sum((n * int(v) - s) ** 2 for v, s in zip(r, sums)) for r in x]


@pytest.mark.parametrize("spectrum", [[5, 5, 5, 2, 2, 1, 0, 0], [3, 3 - 1e-13, 1, 1, 1, 1e-5], [1.0] * 12, [4.0], [2.0, 1.0],
                                      list(np.linspace(9, 1, 90)), [1e6, 1, 1, 1e-6]])
def test_eigenvectors(spectrum):
    from rootcause.llm.whitening import leading_eigenvectors
    rng = np.random.default_rng(len(spectrum))
    q, _ = np.linalg.qr(rng.standard_normal((len(spectrum), len(spectrum))))
    v = q @ np.diag(spectrum) @ q.T
    v = (v + v.T) / 2
    values, vectors = leading_eigenvectors(v, 32)
    k = min(32, len(spectrum))
    assert values.shape == (k,) and vectors.shape == (len(spectrum), k)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:k], rtol=0, atol=1e-13 * max(spectrum) * len(spectrum))
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
    assert np.abs(v @ vectors - vectors * values).max() < 1e-12 * max(spectrum) * len(spectrum)


def test_zero_and_diagonal_matrices():
    from rootcause.llm.whitening import leading_eigenvectors
    values, vectors = leading_eigenvectors(np.zeros((4, 4)), 4)
    assert np.allclose(values, 0) and np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-12
    values, vectors = leading_eigenvectors(np.diag([1.0, 3.0, 2.0]), 2)
    assert np.allclose(values, [3, 2]) and np.allclose(np.abs(vectors), [[0, 0], [1, 0], [0, 1]], atol=1e-12)


@pytest.mark.parametrize("n", [11, 12])
def test_queries_match_their_sql(spark, n):
    import duckdb
    from rootcause.llm.queries import REGISTRY
    query, sql = next(v for k, v in REGISTRY.items() if k.startswith(f"op{n}_"))
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF_SMALL}/{table}.parquet')")
    found, wanted = query(spark, SF_SMALL), con.execute(sql)
    order = [d[0] for d in wanted.description]
    assert sorted(order) == sorted(found.columns)
    same(found.select(order), wanted.fetchall())


def test_whitening_query_casts_the_exact_deviation(spark):
    from rootcause.llm.queries import op13_embedding_whitening
    df = op13_embedding_whitening(spark, SF_SMALL)
    assert dict(df.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double",
                               "explained": "double", "identity_error": "double"}
    assert df.groupBy("vec_id").count().agg({"count": "max"}).first()[0] == 32
