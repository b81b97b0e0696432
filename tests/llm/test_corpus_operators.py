"""The corpus operators against brute force, on awkward rows and on sf0.001."""

import hashlib
import math
import random
import re
from dataclasses import replace

import numpy as np
import pytest

import public_tokenizers
from tests.conftest import SF_SMALL
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, id string, row int, size int, digest string, gram string, doc string"


def prose(rng, n, words=400):
    return " ".join(rng.choice([f"w{i}" for i in range(words)]) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def awkward_texts():
    rng = random.Random(5)
    base, passage = prose(rng, 700), prose(rng, 60)
    near = base.split()
    near[350] = "changed"
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "One"), (5, base), (6, base), (7, " ".join(near)),
        (8, "again " * 400), (9, "again  " * 200), (10, "Größe ñandú 日本語 " * 40 + "😀 x y z \x1c end"),
        (11, "before <|endoftext|> after <|STARTOFTEXT|>x\n\n  y "), (12, passage + " one"), (12, passage + " one"),
        (13, "intro " + passage), (14, prose(rng, 20) + " " + passage.upper() + " tail"), (15, prose(rng, 3000, 5000)),
        (16, "x" * 5000 + " " + "y" * 3000), (17, "CC BY-NC 4.0. General Public License!\nAll  rights reserved"),
        (18, "Licensed under the Apache License, Version 2.0."), (19, "cc by cc by cc"), (20, "one"),
        (21, 'key password=5f8cb87f13d8b5f867 and token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" 4127455689267892'),
        (22, "'s don't we'll 1234567890123 %%% ### ... a.b,c"), (None, "no id here"), (None, base),
    ]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", 1, 2, "d", "g", "doc") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def awkward(spark):
    return frame(spark, awkward_texts()).repartition(5, "doc_id").cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def small(spark):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet").cache()
    return df, [tuple(r) for r in df.select("doc_id", "text").collect()]


def key(row):
    return tuple((x is None, x) if not isinstance(x, bool) else (False, x) for x in row)


def same(df, want):
    assert sorted(map(tuple, df.collect()), key=key) == sorted(want, key=key)


def test_decontamination(spark, awkward, empty, small):
    from rootcause.llm.decontaminate import contamination_report
    texts = dict(awkward_texts())
    items = [(1, " ".join(texts[12].split()[:30])), (10, "one"), (2, texts[15][:4000]), (2, None), (None, "again again"),
             (3, ""), (9, "Größe, ñandú!"), (11, "again " * 12)]
    frame_of = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contamination(awkward_texts(), items)
    same(contamination_report(awkward, frame_of).drop("longest"), want)
    assert contamination_report(empty, frame_of).count() == 0
    none = contamination_report(awkward, frame_of.limit(0)).drop("longest")
    assert {r["n_hit"] for r in none.collect()} == {0}
    df, rows = small
    bench = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    same(contamination_report(df, bench).drop("longest"),
         brute.contamination(rows, [tuple(r) for r in bench.select("item_id", "text").collect()]))


def test_decontamination_in_shards(spark, awkward):
    from rootcause.llm.decontaminate import match_items, n_hit
    texts = dict(awkward_texts())
    words = texts[5].split()
    items = [(i, " ".join(words[20 * i:20 * i + 14])) for i in range(20)]
    frame_of = spark.createDataFrame(items, "item_id long, text string")
    got = match_items(awkward, frame_of, shard_bytes=300).select("doc_id", n_hit(), "items")
    want = [(d, h) for d, _, h, _, _, _ in brute.contamination(awkward_texts(), items)]
    assert sorted(((r[0], r[1]) for r in got.collect()), key=key) == sorted(want, key=key)


def test_cleaned_text_holds_no_window(spark, awkward, empty):
    from rootcause.llm.decontaminate import contamination_report, decontaminate
    texts = dict(awkward_texts())
    items = spark.createDataFrame([(1, " ".join(texts[12].split()[:30])), (2, texts[4])], "item_id long, text string")
    cleaned = decontaminate(awkward, items)
    assert cleaned.columns == awkward.columns
    assert contamination_report(cleaned, items).where("contaminated").count() == 0
    left = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    assert 4 not in left and 20 not in left and left[5] == texts[5] and left[1] is None
    assert decontaminate(empty, items).count() == 0


def test_packing(spark, awkward, empty):
    from rootcause.llm.packing import pack
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    got = pack(awkward, path, capacity=64)
    rows = got.collect()
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted((tuple(r[c] for c in cols) for r in rows), key=key) == sorted(
        brute.pieces(awkward_texts(), Tokenizer.from_file(path), 64), key=key)
    ends, sizes = {}, {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert ends.get(r["sequence_id"], 0) == r["offset"]
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 64 and len(ends) <= sum(r["length"] for r in rows) / 64 * 1.05 + 1
    assert pack(empty, path).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan(seed):
    from rootcause.llm.packing import place_table, plan_patterns
    rng = np.random.default_rng(seed)
    counts = np.bincount(np.clip(rng.lognormal(3 + seed, 1.2, 5000).astype(int), 1, 512), minlength=513)
    patterns = plan_patterns(counts, 512)
    made = np.zeros(513, int)
    for pattern, bins in patterns:
        assert sum(n * k for n, k in pattern) <= 512 and bins > 0
        for n, k in pattern:
            made[n] += k * bins
    assert (made == counts).all()
    least = -(-int((counts * np.arange(513)).sum()) // 512)
    assert sum(b for _, b in patterns) <= max(least * 1.02 + 1, counts[257:].sum())
    for rows in place_table(patterns).values():
        assert (np.diff(rows[:, 0]) > 0).all()


def test_jaccard(awkward, empty, small):
    from rootcause.llm.jaccard_join import first_of_each, near_duplicates
    rows = [(i, t) for i, t in awkward_texts() if i is not None]
    want = {i: (n, c) for i, n, c in brute.jaccard_components(list(dict(rows).items()))}
    got = near_duplicates(awkward, n=3, percent=90).collect()
    assert len(got) == len(awkward_texts())
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert {r["component_id"] for r in got if r["doc_id"] is None} == {None, 5}
    assert near_duplicates(empty).count() == 0
    kept = first_of_each(awkward)
    assert kept.columns == awkward.columns and {6, 7} & {r["doc_id"] for r in kept.collect()} == set()
    df, docs = small
    same(near_duplicates(df, 3, 90), brute.jaccard_components(docs, 3, 90))
    same(near_duplicates(df, 5, 80), brute.jaccard_components(docs, 5, 80))


def test_jaccard_joins_chains_and_near_copies(spark):
    """Near copies whose pairs lie on both sides of the threshold."""
    from rootcause.llm.jaccard_join import near_duplicates
    rng = random.Random(2)
    base = prose(rng, 120, 5000).split()
    docs = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(len(w))] = f"edit{i}"
        docs.append((i, " ".join(w)))
    docs += [(200 + i, " ".join(base[:100] + [f"tail{k}" for k in range(i)])) for i in range(40)]
    same(near_duplicates(frame(spark, docs), 3, 90), brute.jaccard_components(docs, 3, 90))


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_signatures_of_sets_that_link_meet(n, percent):
    from rootcause.llm.jaccard_join import signatures
    rng = np.random.default_rng(percent)
    met = 0
    for _ in range(400):
        both = rng.integers(1, 1 << 62, rng.integers(1, 300)).astype(np.uint64)
        apart = int(len(both) * 100 / percent) - len(both)  # the most that may differ
        other = rng.integers(1, 1 << 62, apart).astype(np.uint64)
        cut = rng.integers(0, apart + 1)
        a, b = (np.unique(np.concatenate([both, part])) for part in (other[:cut], other[cut:]))
        assert 100 * len(both) >= percent * (len(both) + apart)
        assert len(np.intersect1d(signatures(a, percent), signatures(b, percent)))
        c = np.unique(rng.integers(1, 1 << 62, len(a)).astype(np.uint64))
        met += len(a) > 100 and len(np.intersect1d(signatures(a, percent), signatures(c, percent))) > 0
    assert met < 40


@pytest.mark.parametrize("crowd", [0, 128])
def test_jaccard_of_boilerplate(spark, crowd):
    """Unlike documents of common sentences, near copies among them."""
    from rootcause.llm.jaccard_join import near_duplicates
    rng = random.Random(12)
    sentences = [" ".join(f"w{rng.randrange(3000)}" for _ in range(14)) for _ in range(30)]
    docs = []
    for i in range(360):
        words = " ".join(rng.sample(sentences, 10)).split()
        docs.append((2 * i, " ".join(words)))
        if i % 9 == 0:
            for _ in range(rng.randrange(1, 5)):
                words[rng.randrange(len(words))] = f"edit{i}"
            docs.append((2 * i + 1, " ".join(words)))
    for n, percent in ((3, 90), (5, 80)):
        same(near_duplicates(frame(spark, docs), n, percent, crowd), brute.jaccard_components(docs, n, percent))


def test_jaccard_pairs_of_a_large_group_of_near_copies(spark, monkeypatch):
    """Copies too far apart to link are not paired with the whole group, crowded or not."""
    from rootcause.llm import jaccard_join
    rng = random.Random(21)
    base = [f"w{i}" for i in range(149)]
    docs = [(1000, " ".join(base))]
    for i in range(300):
        w = list(base)
        for k in range(rng.randrange(1, 7)):
            w[rng.randrange(len(w))] = f"edit{i}x{k}"
        docs.append((i, " ".join(w)))
    met, across = [], jaccard_join._across

    def counted(*args):
        pairs = across(*args)
        met.append(pairs.count())
        return pairs
    monkeypatch.setattr(jaccard_join, "_across", counted)
    for crowd in (16, 128):
        met.clear()
        same(jaccard_join.near_duplicates(frame(spark, docs), 5, 80, crowd), brute.jaccard_components(docs, 5, 80))
        assert sum(met) < 10 * len(docs), (crowd, met)


def test_jaccard_of_ids_that_repeat(spark):
    """A doc_id with several texts is one document, whichever of them is a copy."""
    from rootcause.llm.jaccard_join import near_duplicates
    rng = random.Random(8)
    texts = {k: prose(rng, 80, 5000) for k in "ABCDE"}

    def near(t):
        return " ".join([*t.split()[:-1], "changed"])

    docs = [(3, texts["A"]), (5, texts["A"]), (5, texts["B"]), (7, near(texts["B"])), (8, texts["B"]),
            (20, texts["C"]), (21, texts["D"]), (30, texts["C"]), (30, texts["D"]), (31, near(texts["D"])),
            (40, texts["E"]), (40, "short"), (41, near(texts["E"])), (42, None), (42, "other words")]
    got = {}
    for r in near_duplicates(frame(spark, docs), 3, 90).collect():
        got.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert got == {i: {3} for i in (3, 5, 7, 8)} | {i: {20} for i in (20, 21, 30, 31)} | {40: {40}, 41: {40}, 42: {42}}


def vectors_brute(rows, threshold=0.9):
    unit = []
    for _, v in rows:
        ok = v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None)
    links = [(i, j) for i in range(len(rows)) for j in range(i) if unit[i] is not None and unit[j] is not None
             and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold]
    comp = brute.components(len(rows), links)
    degree = np.zeros(len(rows), int)
    for i, j in links:
        degree[i] += 1
        degree[j] += 1
    return [(rows[i][0], int(degree[i]), rows[comp[i]][0], comp[i] == i) for i in range(len(rows))]


def test_vectors(spark):
    from rootcause.llm.vector_neardup import near_duplicate_vectors
    rng = np.random.default_rng(3)
    rows = [(0, None), (1, [0.0] * 16), (2, [float("nan")] * 16), (3, []), (4, [1.0, None] * 8), (5, [float("inf")] * 16)]
    rows += [(10 + i, rng.standard_normal(16).tolist()) for i in range(300)]
    centre = rng.standard_normal(16)
    rows += [(400 + i, (centre + rng.standard_normal(16) * 0.2).tolist()) for i in range(150)]
    rows += [(600 + i, centre.tolist()) for i in range(30)]
    rows += [(700 + i, [1.0, 2.0]) for i in range(3)]
    schema = "vec_id long, embedding array<double>, label int, id string, unit string"
    df = spark.createDataFrame([(i, v, 0, "x", "u") for i, v in rows], schema).repartition(4)
    got = {r["vec_id"]: tuple(r) for r in near_duplicate_vectors(df, block=64, neighbours=16).collect()}
    want = {r[0]: r for r in vectors_brute(rows)}
    assert set(got) == set(want)
    links = sum(r[1] for r in want.values())
    assert 0.9 * links <= sum(r[1] for r in got.values()) <= links
    assert all(got[i][1] <= want[i][1] and got[i][2] >= want[i][2] for i in want)
    assert all(got[i] == want[i] for i in range(6)) and all(got[700 + i] == want[700 + i] for i in range(3))
    assert near_duplicate_vectors(df.limit(0)).count() == 0


def test_vectors_of_the_table(spark):
    from rootcause.llm.vector_neardup import near_duplicate_vectors
    df = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    rows = [tuple(r) for r in df.select("vec_id", "embedding").orderBy("vec_id").collect()]
    same(near_duplicate_vectors(df), vectors_brute(rows))


def test_licenses(spark, awkward, empty):
    from rootcause.llm.licenses import scan
    got = {r["doc_id"]: r for r in scan(awkward).collect()}
    assert scan(awkward).count() == len(awkward_texts()) and scan(empty).count() == 0
    for doc_id, text in awkward_texts():
        words = [w.decode() for w in brute.alnum_words(text)]
        places = [(i, label) for p, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
                  for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
        if doc_id is None:
            continue
        r = got[doc_id]
        assert r["n_words"] == len(words) and r["n_base"] == len(places), doc_id
        assert r["first_word"] == min((i for i, _ in places), default=None)
        assert r["last_word"] == max((i for i, _ in places), default=None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert got[18]["labels"] == "apache-2.0" and got[18]["score"] == 1.0
    assert got[17]["labels"] == "cc-by,gpl,reserved" and got[19]["n_base"] == 2 and got[5]["score"] == 0.0


def split_ids(rows):
    return [r for r in rows if r[0] is not None]


def check_repeats(df, rows, op, plain, n):
    got = [tuple(r) for r in op(df).collect()]
    assert sorted(split_ids(got), key=key) == sorted(plain(split_ids(rows), n), key=key)
    assert len(got) == len(rows) and all(r[2] == 0 for r in got if r[0] is None)


def test_repeated_words(awkward, empty, small):
    from rootcause.llm.fm_dedup import KIND, repeated_words
    check_repeats(awkward, awkward_texts(), repeated_words, brute.repeated_words, 50)
    for tight in (replace(KIND, chunk_units=2000, anchor_runs=1), replace(KIND, chunk_units=20, anchor_runs=3, hot_runs=3)):
        check_repeats(awkward, awkward_texts(), lambda d: repeated_words(d, tight), brute.repeated_words, 50)
    check_repeats(*small, repeated_words, brute.repeated_words, 50)
    assert repeated_words(empty).count() == 0


def test_repeated_bytes(awkward, empty, small):
    from rootcause.llm.suffix_dedup import KIND, repeated_bytes
    check_repeats(awkward, awkward_texts(), repeated_bytes, brute.repeated_bytes, 100)
    for tight in (replace(KIND, chunk_units=2000, anchor_runs=1), replace(KIND, chunk_units=40, anchor_runs=3, hot_runs=3)):
        check_repeats(awkward, awkward_texts(), lambda d: repeated_bytes(d, tight), brute.repeated_bytes, 100)
    check_repeats(*small, repeated_bytes, brute.repeated_bytes, 100)
    assert repeated_bytes(empty).count() == 0


def test_runs_of_a_document_longer_than_a_piece(monkeypatch):
    from rootcause.llm import repeats, textblocks
    rng = np.random.default_rng(1)
    codes = textblocks.mix(rng.integers(0, 3, 5000).astype(np.uint64))
    index = np.array([0, 4500, 4500, 5000])
    whole = repeats.find_runs(codes, index, 50, 8)
    monkeypatch.setattr(repeats, "PIECE_UNITS", 700)
    pieces = repeats.find_runs(codes, index, 50, 8)

    def windows(runs):
        return {(d, s + k, p - k, a) for d, s, n, p, a in zip(*(x.tolist() for x in runs[:5])) for k in range(n)}
    assert windows(whole) == windows(pieces) and len(windows(whole)) == 4500 - 49 + 500 - 49


def test_wavelet_matrix_and_fm_index():
    from rootcause.llm.fm_dedup import FMIndex
    rng = np.random.default_rng(4)
    text = np.append(rng.integers(1, 6, 3000), 0)
    index = FMIndex(text, 12)
    joined = bytes(text.astype(np.uint8))
    for size in (1, 3, 12):
        for at in rng.integers(0, 2900, 20):
            lo, hi = np.array([0]), np.array([len(text)])
            for symbol in text[at:at + size][::-1]:
                lo, hi = index.extend(np.array([symbol]), lo, hi)
            pattern = joined[at:at + size]
            assert hi[0] - lo[0] == sum(joined.startswith(pattern, k) for k in range(len(joined)))


def test_token_counts(awkward, empty, small):
    from rootcause.llm.token_counts import token_counts
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)

    def want(rows):
        out = []
        for i, t in rows:
            n = len(tok.encode(t or "", add_special_tokens=False))
            out.append((i, len((t or "").encode()), n, n > 512))
        return out
    same(token_counts(awkward, path), want(awkward_texts()))
    unique = [r for r in dict(awkward_texts()).items() if r[0] is not None]
    spark = awkward.sparkSession
    same(token_counts(frame(spark, unique), path, chunk_bytes=300, overlap_bytes=130), want(unique))
    same(token_counts(small[0], path, chunk_bytes=1000, overlap_bytes=200), want(small[1]))
    assert token_counts(empty, path).count() == 0


def test_quality_model_against_plain_kneser_ney(spark):
    from rootcause.llm.quality_lm import Scorer, _discounts, gram_keys, score, train
    rng = random.Random(8)
    texts = ["".join(rng.choice("aab b.ñ") for _ in range(rng.randrange(0, 80))) for _ in range(30)]
    df = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    order = 3
    model = train(df.select("text"), order).cache()

    counts = {order: {}}
    for t in texts:
        p = "\x02" * (order - 1) + t
        for i in range(len(t)):
            g = p[i:i + order]
            counts[order][g] = counts[order].get(g, 0) + 1
    for k in range(order - 1, 0, -1):
        counts[k] = {}
        for g in counts[k + 1]:
            counts[k][g[1:]] = counts[k].get(g[1:], 0) + 1
    discounts = {k: _discounts(spark.createDataFrame(list(c.items()), "gram string, count long")) for k, c in counts.items()}
    size = len(counts[1]) + 1

    def p(context, char, k):
        if k == 0:
            return 1 / size
        context = context[len(context) - (k - 1):] if k > 1 else ""
        same_context = {g: c for g, c in counts[k].items() if g[:-1] == context}
        if not same_context:
            return p(context[1:], char, k - 1)
        d = {g: discounts[k][min(c, 3) - 1] for g, c in same_context.items()}
        c = same_context.get(context + char, 0)
        own = c - d[context + char] if c else 0
        return (own + sum(d.values()) * p(context[1:], char, k - 1)) / sum(same_context.values())

    odd = texts[:10] + ["zzz", "ab?", ""]
    asked = spark.createDataFrame([(i, None, t) for i, t in enumerate(odd)], "doc_id long, lang string, text string")
    for shard_entries in (10 ** 6, 20):
        got = {r["doc_id"]: r for r in score(asked, model, order, shard_entries).collect()}
        assert len(got) == len(odd)
        for i, t in enumerate(odd):
            padded = "\x02" * (order - 1) + t
            want = sum(math.log(p(padded[j:j + order - 1], t[j], order)) for j in range(len(t)))
            assert got[i]["n_chars"] == len(t) and got[i]["log_sum"] == pytest.approx(want, abs=1e-3)
    from rootcause.llm.quality_lm import _shard_of, char_shard
    chars = ["a", "ñ", "\x02", "語", "😀"]
    row = spark.createDataFrame([(c,) for c in chars], "c string").select("c", _shard_of("c", 7).alias("s")).collect()
    assert {r["c"]: r["s"] for r in row} == dict(zip(chars, char_shard(np.array([ord(c) for c in chars]), 7).tolist()))
    for context in ("a", "b ", ""):
        assert sum(p("\x02\x02" + context, ch, order) for ch in "ab .ñ") < 1 + 1e-9


def test_quality_classifier(spark, awkward, empty):
    from rootcause.llm.quality_lm import classify, trusted_documents
    larger = SF_SMALL.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{larger}/labels.parquet")
    docs = spark.read.parquet(f"{larger}/documents.parquet")
    got = classify(docs, labels)
    held = got.join(labels, "doc_id").select("kept", "quality").collect()
    clean = [r["kept"] for r in held if r["quality"] == 1]
    junk = [r["kept"] for r in held if r["quality"] == 0]
    assert sum(clean) >= 0.97 * len(clean) and sum(junk) <= 0.3 * len(junk)
    assert got.count() == docs.count()
    trust = spark.createDataFrame([(5, 1), (15, 1), (None, 1), (8, 0)], "doc_id long, quality int")
    rows = classify(awkward, trust).collect()
    assert len(rows) == len(awkward_texts())
    assert all(r["kept"] and r["perplexity"] is None for r in rows if r["n_chars"] == 0)
    assert classify(awkward, trust.limit(0)).where("kept").count() == len(awkward_texts())
    assert classify(empty, trust).count() == 0
    assert trusted_documents(awkward, trust.limit(0)).count() == len(awkward_texts())


def test_secret_forest_on_held_out_findings(spark, small):
    from rootcause.llm.secret_scan import classified, labelled_bank
    held = labelled_bank(spark, 800, start=10_000)
    rows = held.selectExpr("monotonically_increasing_id() AS row", "0 AS place", "value", "before", "after")
    truth = {(r["value"], r["before"]): r["label"] for r in held.collect()}
    got = classified(rows, small[0], labelled_bank(spark, 1500)).collect()
    right = sum((truth[r["value"], r["before"]] == 1.0) == r["is_secret"] for r in got)
    assert len(got) == 800 and right >= 0.97 * len(got)


def test_secrets(awkward, empty, small):
    from rootcause.llm.secret_scan import PLACEHOLDER, redact, scan
    found = scan(awkward).collect()
    secret = {r["value_sha256"] for r in found if r["is_secret"]}
    planted = {hashlib.sha256(v.encode()).hexdigest() for v in ("5f8cb87f13d8b5f867", "04dbebab91ab85687d33eeaaf9ac699e1188f962")}
    assert planted <= secret and hashlib.sha256(b"4127455689267892").hexdigest() not in secret
    cleaned = redact(awkward)
    texts = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    assert cleaned.columns == awkward.columns and cleaned.count() == len(awkward_texts())
    assert texts[21] == f'key password={PLACEHOLDER} and token = "{PLACEHOLDER}" 4127455689267892'
    assert all(texts[i] == t for i, t in awkward_texts() if i not in (None, 21))
    assert scan(empty).count() == 0 and redact(empty).count() == 0


def test_queries_are_registered():
    import __spark_entry__ as entry
    names = set(entry.queries())
    for n in range(1, 11):
        assert sum(bool(re.match(rf"op{n}_", x)) for x in names) == 1
    assert "pipeline" in names and "op5_license_scans" in entry.oracle_sql()


@pytest.mark.parametrize("n", [1, 3, 4, 5, 6, 9])
def test_queries_match_their_sql(spark, n):
    import duckdb
    from rootcause.llm.queries import REGISTRY
    query, sql = next(v for k, v in REGISTRY.items() if k.startswith(f"op{n}_"))
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF_SMALL}/{table}.parquet')")
    found = query(spark, SF_SMALL)
    wanted = con.execute(sql)
    order = [d[0] for d in wanted.description]
    assert sorted(order) == sorted(found.columns)
    same(found.select(order), wanted.fetchall())


def test_pipeline(spark, tmp_path):
    """Every stage against a plain version of what it decides."""
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    stages = [f for _, f in corpus_pipeline.STAGES]
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "secret_scans", "best_fit_packing"]
    kept = stages[0](spark, docs, SF_SMALL).cache()
    clean = [i for i, q in labels.items() if q == 1]
    left = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert kept.columns == docs.columns and len(set(clean) & set(left)) >= 0.97 * len(clean)
    assert all(rows[i] == t for i, t in left.items())

    unique = stages[1](spark, kept, SF_SMALL).cache()
    want = {i for i, _, c in brute.jaccard_components(list(left.items()), 5, 80) if i == c}
    assert {r["doc_id"] for r in unique.collect()} == want

    cleaned = stages[2](spark, unique, SF_SMALL).cache()
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in cleaned.collect()}
    before = {i: left[i] for i in want}
    contaminated = {r[0] for r in brute.contamination(list(before.items()), items) if r[5]}
    assert all(texts[i][0] == t for i, t in before.items() if i not in contaminated)
    assert not any(r[5] for r in brute.contamination([(i, t) for i, (t, _) in texts.items()], items))
    assert all(len(t) == n for t, n in texts.values()) and cleaned.columns == docs.columns

    redacted = stages[3](spark, cleaned, SF_SMALL).cache()
    assert redacted.columns == docs.columns and redacted.count() == len(texts)
    key_like = re.compile(r"AKIA[A-Z0-9]{16}|password=[0-9a-f]{18}|token = \"[0-9a-f]{40}")
    after = {r["doc_id"]: r["text"] for r in redacted.collect()}
    assert not any(key_like.search(t) for t in after.values())
    assert all(after[i] == t for i, (t, _) in texts.items() if not re.search(r"[0-9]{6}", t))

    packed = stages[4](spark, redacted, SF_SMALL).collect()
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(tuple(r[c] for c in cols) for r in packed) == sorted(brute.pieces(list(after.items()), tok))
    ran = corpus_pipeline.run(spark, SF_SMALL)
    assert sorted(tuple(r[c] for c in cols) for r in ran.collect()) == sorted(tuple(r[c] for c in cols) for r in packed)
