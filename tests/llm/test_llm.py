"""Operators against brute force, on small tables with nulls, empty and long texts, ties, repeated rows and odd columns."""

import hashlib
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mintleaf.llm import bpe, common, exact_dedup, html_text, language, licenses, mixing, near_dedup, sharding, substring_dedup, topk
from mintleaf.llm.components import component_labels

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"


def text(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def corpus(spark, rows):
    """(doc_id, text) with columns whose names operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"uid": F.lit("u"), "kept": F.lit(1), "lang": F.lit("xx"), "source": F.col("doc_id") % 3, "size": F.lit(None).cast("int"), "encoded": F.lit("e"), "row": F.lit(0), "_row": F.lit(0), "_uid": F.lit(0), "_ID": F.lit(0)})


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    base = text(rng, 120)
    rows = [(k, text(rng, rng.randrange(1, 80))) for k in range(60)]
    rows += [(100 + k, base) for k in range(30)] + [(200, base.upper()), (201, None), (202, ""), (203, " \t\n "), (204, "É é"), (205, "é É"), (206, text(rng, 5000)), (3, "again"), (3, "again"), (None, "again"), (None, None)]
    return rows, corpus(spark, rows)


@pytest.fixture
def empty(spark):
    return corpus(spark, [])


def normal(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# --- 3 ---


@pytest.mark.parametrize("counters", [1, 3, 1024])
def test_exact_duplicates(docs, counters):
    rows, df = docs
    groups = defaultdict(list)
    for i, t in rows:
        groups[normal(t)].append(i)
    got = exact_dedup.exact_duplicates(df, counters=counters).collect()
    assert len(got) == len(rows)
    by_hash = defaultdict(list)
    for r in got:
        by_hash[r["text_sha256"]].append(r)
    assert len(by_hash) == len(groups)
    for t, ids in groups.items():
        found = by_hash[hashlib.sha256(t.encode()).hexdigest()]
        best = max((i for i in ids if i is not None), default=None)
        assert {(r["keep_id"], r["group_size"]) for r in found} == {(best, len(ids))} and sum(r["kept"] for r in found) == 1
        assert [r["id"] for r in found if r["kept"]] == [best]


def test_exact_dedup_keeps_columns(docs, empty):
    rows, df = docs
    left = exact_dedup.drop_exact_duplicates(df)
    assert left.columns == df.columns and left.count() == len({normal(t) for _, t in rows})
    assert exact_dedup.drop_exact_duplicates(empty).count() == 0 and exact_dedup.exact_duplicates(empty).count() == 0


def test_misra_gries_keeps_every_frequent_digest():
    rng = random.Random(1)
    rows = [b"hot"] * 300 + [b"warm"] * 120 + [str(rng.random()).encode() for _ in range(500)]
    rng.shuffle(rows)
    found = exact_dedup.misra_gries(iter(rows), 8)
    assert {d for d, c in Counter(rows).items() if c > len(rows) / 9} <= set(found) and len(found) <= 8


# --- 2 ---


@pytest.mark.parametrize(("shards", "cell_rows"), [(4, 1 << 18), (16, 5)])
def test_shards_are_balanced_and_gapless(docs, shards, cell_rows):
    rows, df = docs
    got = sharding.shard_by_bytes(df, shards, cell_rows=cell_rows).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r["id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    per = defaultdict(list)
    for r in got:
        per[r["shard"]].append(r)
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    for k, own in per.items():
        assert 0 <= k < shards and sorted(r["slot"] for r in own) == list(range(len(own)))
        assert sum(r["size"] for r in own) <= total / shards + largest


def test_shards_split_a_hot_text(spark):
    df = spark.createDataFrame([(k, "same text") for k in range(64)], "doc_id long, text string")
    got = Counter(r["shard"] for r in sharding.shard_by_bytes(df, 16).collect())
    assert got == Counter({k: 4 for k in range(16)})


def test_a_row_longer_than_a_shard(spark):
    rows = [(0, "x" * 5000)] + [(k, "y" * 9) for k in range(1, 60)] + [(k, "z") for k in (70, 70, 70)]
    got = sharding.shard_by_bytes(corpus(spark, rows), 8).collect()
    assert Counter((r["id"], r["size"]) for r in got) == Counter((i, len(t) + 1) for i, t in rows)
    per = defaultdict(list)
    for r in got:
        per[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in per.values()) and set(per) <= set(range(8))


def test_shards_of_nothing(empty):
    assert sharding.shard_by_bytes(empty).count() == 0


# --- 4 ---


def brute_windows(rows, k):
    seen, out = {}, {}
    order = sorted(range(len(rows)), key=lambda n: (rows[n][0] is not None, rows[n][0] or 0))
    for n in order:
        w = words_of(rows[n][1])
        for s in range(len(w) - k + 1):
            at = (rows[n][0] is not None, rows[n][0] or 0, s)
            key = tuple(w[s : s + k])
            seen[key] = min(seen.get(key, at), at)
    for n in order:
        w = words_of(rows[n][1])
        gone = set()
        for s in range(len(w) - k + 1):
            if seen[tuple(w[s : s + k])] < (rows[n][0] is not None, rows[n][0] or 0, s):
                gone.update(range(s, s + k))
        out[n] = (rows[n][0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return Counter(out.values())


@pytest.mark.parametrize("k", [5, 20])
def test_repeated_windows(spark, docs, k):
    rows = list(docs[0])
    rng = random.Random(8)
    passage = text(rng, 30)
    rows += [(300 + n, f"{text(rng, 9)}  {passage}\n{text(rng, rng.randrange(9))} {passage if n % 2 else ''}") for n in range(20)] + [(400, "la " * 100), (401, "la " * 50)]
    rows += [(500 + n, f"{text(rng, k)} {passage.split()[0]} {passage.split()[1]} {passage.split()[2]} {text(rng, k)}") for n in range(40)]  # many windows around one phrase
    want = brute_windows(rows, k)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for most in (1 << 24, 2000, 1):
            got = substring_dedup.remove_repeats(corpus(spark, rows).repartition(3), k, bucket_bytes=1 << 12, most_bytes=most)
            assert Counter(map(tuple, got.collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_windows_of_equal_hashes_are_told_apart():
    data = np.frombuffer(b"aa bb aa bb aa cc", np.uint8)
    low, high = np.array([0, 3, 6, 9, 12]), np.array([5, 8, 11, 14, 17])
    got = substring_dedup._repeats(np.zeros(5, np.uint64), np.array([1, 1, 1, 1, 1]), np.arange(5), data, low, high)
    assert got.tolist() == [False, False, True, True, False]


def thue_morse(n):
    out = [0]
    while len(out) < n:
        out += [1 - x for x in out]
    return out[:n]


def test_hashes_of_words_and_windows_are_no_sums():
    first = "".join("ab"[x] for x in thue_morse(1024))
    other = first.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer((first + other).encode(), np.uint8)
    for seed in (5, 11, 12):
        a, b = common.word_hashes(data, np.array([0, 1024]), np.array([1024, 2048]), seed)
        assert a != b
        words = np.array(thue_morse(2048), np.uint64)
        assert common.window_hashes(words, 2048, seed)[0] != common.window_hashes(1 - words, 2048, seed)[0]


def test_hashes_follow_the_words():
    rng = random.Random(7)
    words = ["".join(rng.choices("abc", k=rng.choice([1, 2, 7, 8, 9, 16, 17, 40, 1024, 1500]))) for _ in range(300)]
    raw = " \t".join(words).encode() + b" "
    data, offsets = common.joined_words(np.frombuffer(raw, np.uint8), np.array([0, 0, len(raw), len(raw)]))
    assert data.tobytes() == " ".join(words).encode() + b" " and offsets.tolist() == [0, 0, len(data), len(data)]
    starts, ends, at = common.word_spans(data, offsets)
    assert at.tolist() == [0, 0, 300, 300]
    hashes = common.word_hashes(data, starts, ends, 3)
    by_word = {}
    for w, h in zip(words, hashes.tolist(), strict=True):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)
    for k in (1, 2, 3, 5, 20):
        windows = {}
        for i, h in enumerate(common.window_hashes(hashes, k, 1).tolist()):
            assert windows.setdefault(tuple(words[i : i + k]), h) == h
        assert len(set(windows.values())) == len(windows)
    picked = np.array(rng.choices(range(300), k=200)), np.array(rng.choices(range(300), k=200))
    same = common.same_bytes(data, starts[picked[0]], ends[picked[0]], starts[picked[1]], ends[picked[1]])
    assert same.tolist() == [words[a] == words[b] for a, b in zip(*picked, strict=True)]


def test_repeats_of_nothing(empty):
    assert substring_dedup.remove_repeats(empty).count() == 0


# --- 5 ---


def brute_near(rows, k=5):
    sets = {}
    for i, t in rows:
        w = words_of(normal(t))
        sets[i] = {tuple(w[s : s + k]) for s in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = "x" + str(rng.randrange(10**6))
    return " ".join(out)


def test_near_duplicates_with_many_degrees_of_edits(spark):
    rng = random.Random(4)
    base = text(rng, 150).split()
    rows = [(1000 + k, edited(rng, base, k % 12)) for k in range(90)]
    chain = text(rng, 120).split()
    for k in range(12):  # each near the one before it
        rows.append((500 + k, " ".join(chain)))
        chain = edited(rng, chain, 2).split()
    rows += [(k, text(rng, rng.randrange(1, 60))) for k in range(40)] + [(60, None), (61, ""), (62, "one two"), (63, "One  two"), (64, "one two three")]
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(corpus(spark, rows)).collect()}
    assert got == brute_near(rows)
    left = near_dedup.drop_near_duplicates(corpus(spark, rows))
    assert {r["doc_id"] for r in left.collect()} == {i for i, (_, c) in got.items() if i == c}


def test_near_duplicates_of_odd_rows(spark, empty):
    assert near_dedup.near_duplicates(empty).count() == 0
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e F"), (None, None)]
    got = Counter((r["id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(corpus(spark, rows)).collect())
    assert {x: n for x, n in got.items() if x[0] is not None} == {(1, 1, True): 2, (2, 1, False): 1} and all(k and c is None for i, c, k in got if i is None)


def test_near_duplicates_of_long_texts_and_of_equal_ids(spark):
    rng = random.Random(12)
    long = text(rng, 20_000).split()
    rows = [(1, " ".join(long)), (2, edited(rng, long, 300)), (3, edited(rng, long, 1500)), (4, text(rng, 20_000))]
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(corpus(spark, rows)).collect()}
    assert got == brute_near(rows) and got[2][1] == 1 and got[3][1] == 3
    # rows of one id are one document: it links whatever either of its texts links with
    a, b = text(rng, 60), text(rng, 60)
    rows = [(5, a), (5, b), (6, edited(rng, a.split(), 1)), (7, edited(rng, b.split(), 1))]
    got = {(r["id"], r["component_id"]) for r in near_dedup.near_duplicates(corpus(spark, rows)).collect()}
    assert got == {(5, 5), (6, 5), (7, 5)}


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(250 - k, 300) for k in range(20)] + [(400, 400)]
    got = {r["node"]: r["label"] for r in component_labels(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100 + k: 100 for k in range(30)} | {250 - k: 231 for k in range(20)} | {300: 231}


# --- 6 ---


def test_language_needs_letters_and_learns_from_the_rest_only(spark, empty):
    rng = random.Random(6)
    vowels = {"aa": "aeo", "bb": "iuy"}
    make = lambda lang: " ".join("".join(rng.choice("bcdfg") + rng.choice(vowels[lang]) for _ in range(3)) for _ in range(30))
    rows = [(k, make(lang), lang) for k, lang in enumerate(["aa", "bb"] * 60)] + [(900, None, "aa"), (901, "12 !?", "bb"), (902, "", None), (None, "Bababa", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("language", F.lit(1))
    got = {r["doc_id"]: r["language"] for r in language.identify(df).collect()}
    for i, _, lang in rows[:120]:
        assert got[i]["lang_pred"] == lang and 0.5 <= got[i]["score"] <= 1
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    assert language.keep_identified(df).count() == 121 and language.keep_identified(df).columns == df.columns
    assert language.identify(empty).count() == 0
    swapped = df.withColumn("lang", F.when(language.is_held_out(F.col("doc_id")), "cc").otherwise(F.col("lang")))
    assert {r["language"]["lang_pred"] for r in language.identify(swapped).collect()} == {"aa", "bb", "und"}


def test_language_model_is_kernel_ridge_regression(spark):
    rng = random.Random(16)
    vowels = {"aa": "aeo", "bb": "iuy", "cc": "äöü"}
    make = lambda lang: " ".join("".join(rng.choice("bcdfg") + rng.choice(vowels[lang]) for _ in range(3)) for _ in range(rng.randrange(1, 12)))
    rows = [(make(lang), lang) for lang in ["aa", "bb", "cc"] * 10]
    model = language.fit(spark.createDataFrame(rows + rows[:5], "text string, lang string"), landmarks=40, ridge=0.01)
    # plainly: all texts are landmarks, the kernel by counting common n-grams, ridge regression in its dual form
    grams = lambda t: {t.lower().encode()[i : i + n] for n in language.ORDERS for i in range(len(t.lower().encode()) - n + 1)}
    sets = [grams(t) for t, _ in rows]
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    k = np.array([[kernel(a, b) for b in sets] for a in sets])
    weight = 0.01 * np.trace(k) / np.linalg.matrix_rank(k)
    dual = np.linalg.solve(k @ k + weight * k + 1e-9 * np.eye(len(k)), k @ np.array([[1.0 if y == x else -1.0 for x in ("aa", "bb", "cc")] for _, y in rows]))
    got, _ = model.scores(language.Grams(model.codes), [t for t, _ in rows])
    assert model.languages == ["aa", "bb", "cc"] and np.abs(got - k @ dual).max() < 0.02
    assert (got.argmax(axis=1) == (k @ dual).argmax(axis=1)).all()


def test_language_of_repeated_long_and_tied_rows(spark):
    rows = [(k, "abab " * 3, "xx" if k % 2 else "yy") for k in range(60)] + [(100, "abab " * 200_000, "xx"), (101, "abab", None), (101, "abab", None)]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    # two languages with the same texts tie: the first by name
    assert len(got) == len(rows) and {r["language"]["lang_pred"] for r in got} == {"xx"} and all(0 <= r["language"]["score"] <= 1 for r in got)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = language.identify(docs).filter(language.is_held_out(F.col("doc_id"))).select("lang", "language.lang_pred").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got) > 0


# --- 8 ---


def test_bpe_equals_the_library(spark, docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    rows = [*docs[0], (500, "x" * 50), (501, "ab" * 40 + " hello " + "é" * 33), (502, "it's 12 " + "中文" * 20), (503, "<|endoftext|>" + "q" * 45 + "<|startoftext|>'s"), (504, "ΣΑΣ İ é \x1c\x85 \xa0 a­b"), (505, "ab" * 9000)]
    for long_text, leaf in ((20, 7), (1000, 64), (bpe.LONG_TEXT, bpe.LEAF)):
        for r in bpe.encode_texts(corpus(spark, rows).repartition(5), TOKENIZER, long_text=long_text, leaf=leaf).select("text", "encoded").collect():
            want = library.encode(r["text"] or "", add_special_tokens=False).ids
            assert r["encoded"]["ids"] == " ".join(map(str, want)) and r["encoded"]["n_tokens"] == len(want)
            assert r["encoded"]["decoded"] == library.decode(want, skip_special_tokens=False)
    assert bpe.encode_texts(empty, TOKENIZER).count() == 0


# --- 9 ---


@pytest.mark.parametrize(("k", "tiles"), [(1, False), (5, False), (5, True)])
def test_top_k(spark, k, tiles, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(i), v.tolist()) for i, v in enumerate(rng.standard_normal((160, 8)) / 3)]
    rows += [(200 + i, rows[0][1]) for i in range(20)] + [(250, rows[0][1]), (300, None), (301, []), (302, [1.0, None] * 4), (303, [float("nan")] * 8), (350, [0.5] * 3), (351, [0.25] * 3), (None, [1.0] * 8), (0, rows[0][1]), (400, [9e5] * 8)]
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    if tiles:
        monkeypatch.setattr(topk, "MOST_BROADCAST", 500)
    else:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"q": F.lit(1), "dim": F.lit(2)})
    fine = {(i, tuple(int(np.floor(256 * x)) for x in v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for i, q in fine:
        if i % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), j) for j, c in fine if j != i and len(c) == len(q))[:k]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    try:
        assert sorted(map(tuple, topk.top_k(df, k).collect())) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_top_k_of_huge_components(spark):
    rows = [(0, [1e16, 1.0]), (1, [1e16, 2.0]), (2, [-1e16, 0.0]), (3, [3.0, 1.0])]
    quantised = {i: [256 * int(x) for x in v] for i, v in rows}
    want = sorted((max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(quantised[0], quantised[i], strict=True)))), -i) for i in (1, 2, 3))[::-1]
    assert [(r["score"], -r["vec_id"]) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()] == want


def test_top_k_of_nothing(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# --- 1 ---


def test_mix_meets_its_limit(spark, empty):
    rng = random.Random(2)
    rows = [(k, "big" if k % 10 else ("mid" if k % 20 else None), text(rng, 20)) for k in range(600)] + [(900, "big", None), (901, "none", "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("uid", F.lit("x"))
    plan = [r["mix"] for r in mixing.mix(df, plan_columns=True, repetition_limit=2.0, block_tokens=200).collect()]
    assert max(r["repetition"] for r in plan) == pytest.approx(2.0, abs=1e-6) and min(r["repetition"] for r in plan) == 1.0
    shares = Counter()
    for _, s, t in rows:
        shares[s] += len(words_of(t))
    total = sum(shares.values())
    ratio = max(shares.values()) / min(v for v in shares.values() if v)
    a = 1 - np.log(2.0) / np.log(ratio)
    weights = {s: (n / total) ** a for s, n in shares.items() if n}
    mixed = mixing.mix(df, plan_columns=True, repetition_limit=2.0, block_tokens=200).collect()
    assert {r["doc_id"] for r in mixed} == {r[0] for r in rows}
    got = Counter()
    for r in mixed:
        got[r["source"]] += r["mix"]["tokens"]
        if r["mix"]["tokens"]:
            assert r["mix"]["weight"] == pytest.approx(weights[r["source"]] / sum(weights.values()), rel=1e-6) and 0 <= r["mix"]["position"] <= 1
    for s, w in weights.items():
        budget = w / sum(weights.values()) * max(shares.values()) / (max(weights.values()) / sum(weights.values()))
        assert budget - 21 <= got[s] <= budget + 1e-6
    again = mixing.mix(df.repartition(7), plan_columns=True, repetition_limit=2.0, block_tokens=200).collect()
    assert sorted(map(str, mixed)) == sorted(map(str, again))
    assert mixing.mix(empty, repetition_limit=2.0).count() == 0 and mixing.mix(df, repetition_limit=1.0).columns == df.columns


@pytest.mark.parametrize("limit", [1.0, 1.7, 3.0])
def test_mix_equals_a_plain_one(spark, limit):
    rng = random.Random(11)
    rows = [(k, rng.choice(["big"] * 8 + ["mid", "mid", None]), text(rng, rng.randrange(0, 30))) for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = Counter((r["doc_id"], r["mix"]["pass"]) for r in mixing.mix(df, plan_columns=True, repetition_limit=limit, block_tokens=300).collect())
    tokens = {i: len(words_of(t)) for i, _, t in rows}
    total = Counter()
    for i, s, _ in rows:
        total[s] += tokens[i]
    p = {s: n / sum(total.values()) for s, n in total.items()}
    a = 1 - np.log(limit) / np.log(max(p.values()) / min(p.values()))
    want = Counter({(i, 0): 1 for i in tokens if not tokens[i]})
    for s, n in total.items():
        repetition = (max(p.values()) / p[s]) ** (1 - a)
        full = int(repetition + 1e-9)
        rest, blocks = int((repetition - full) * n + 1e-6), -(-n // 300)
        own = [i for i, x, _ in rows if x == s and tokens[i]]
        hashed = df.filter(F.col("doc_id").isin(own)).select("doc_id", F.xxhash64("doc_id", "source", "text").alias("u"))
        place = {r[0]: (r[1], r[2]) for r in hashed.select("doc_id", F.pmod(F.xxhash64("u", F.lit(0)), F.lit(blocks).cast("long")), F.xxhash64("u", F.lit(1))).collect()}
        for turn in range(full + 1):
            order = spark.range(blocks).select("id", F.xxhash64("id", F.lit(turn), F.lit(0)).alias("o")).collect()
            taken, room = [], rest if turn == full else n
            for block in [r["id"] for r in sorted(order, key=lambda r: (r["o"], r["id"]))]:
                members = sorted((i for i in own if place[i][0] == block), key=lambda i: place[i][1])
                for i in members:
                    if tokens[i] > room:  # the block that the budget cuts; no later one is begun
                        room = 0
                        break
                    taken.append(i)
                    room -= tokens[i]
                if room <= 0:
                    break
            want.update((i, turn) for i in taken)
    assert got == want


def test_exponent_meets_the_entropy(spark):
    p = [0.7, 0.2, 0.06, 0.04]
    shares = spark.createDataFrame([(x,) for x in p], "p double")
    a = mixing.find_exponent(shares, target_entropy=1.2)
    w = np.array(p) ** a / sum(np.array(p) ** a)
    assert -(w * np.log(w)).sum() == pytest.approx(1.2, abs=1e-6)
    assert mixing.find_exponent(shares, target_entropy=9.0) == 0.0 and mixing.find_exponent(shares, target_entropy=0.1) == 1.0


def test_mix_with_a_budget(spark):
    df = spark.createDataFrame([(k, "a" if k % 4 else "b", "w w w w w") for k in range(400)], "doc_id long, source string, text string")
    got = Counter()
    for r in mixing.mix(df, plan_columns=True, repetition_limit=1.0, budget_tokens=1000, block_tokens=50).collect():
        got[r["source"]] += 5
    assert 985 <= sum(got.values()) <= 1000


# --- 7 ---


def test_licenses(spark, docs, empty):
    mit = licenses.TEMPLATES["MIT"]
    rows = [(1, mit), (2, "Copyright (c) 2020 Me\n\n" + mit.upper()), (3, "some words\nReleased under the MIT License.\nmore"), (4, None), (5, ""), (6, "no license here"), (7, "a " * 100_000 + "\nLicensed under CC BY-NC 4.0.")]
    got = {r["id"]: r for r in licenses.scan_licenses(corpus(spark, rows)).collect()}
    assert [got[i]["license"] for i in range(1, 8)] == ["MIT", "MIT", "MIT/notice", None, None, None, "CC-BY-NC-4.0/notice"]
    assert got[1]["dice"] == 1.0 and got[3]["line"] == 2 and got[4]["n_matches"] == 0
    assert licenses.scan_licenses(empty).count() == 0


def test_licenses_of_repeated_rows_and_ties(spark):
    same = {"b": "one two three four", "a": "one two three four"}
    rows = [(1, "one two three four"), (1, "one two three four"), (2, "x\none two three four\none two three four"), (None, "ONE two, three four!")]
    got = [tuple(r) for r in licenses.scan_licenses(corpus(spark, rows), templates=same).collect()]
    assert sorted(got, key=str) == sorted([(1, "a", 1.0, 1, 1), (1, "a", 1.0, 1, 1), (2, "a", 1.0, 2, 2), (None, "a", 1.0, 1, 1)], key=str)


def test_license_bounds_lose_nothing():
    rng = random.Random(9)
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.6)
    for _ in range(300):
        words = licenses.normalised_words(rng.choice(list(licenses.TEMPLATES.values())))
        words = [w if rng.random() < 0.9 else "zz" for w in words][: rng.randrange(1, 2 * len(words))]
        own = licenses.bigrams(words)
        best = max(((licenses.dice(own, t), n) for n, t in scanner.templates), key=lambda x: x[0])
        got = scanner.best(" ".join(words))
        assert (got is None) == (best[0] < 0.6) and (got is None or got[1] == best[0])


def test_licenses_inside_documents(spark):
    wrap = lambda t, start="": "\n".join(start + line for line in textwrap.wrap(t, 76))
    prose = text(random.Random(3), 4000)
    rows, want = [], []
    for name in ("MIT", "BSD-2-Clause", "ISC", "GPL-2.0/header", "GPL-3.0/header", "Apache-2.0/header", "MPL-2.0/notice"):
        for start in ("", "# "):
            rows.append((len(rows), wrap(prose[:20_000]) + "\n" + wrap(licenses.TEMPLATES[name], start) + "\n" + wrap(prose)))
            want.append((name, 1 + wrap(prose[:20_000]).count("\n") + 1, 1))
    rows.append((len(rows), "one\n" + prose + " Released under the MIT License. " + prose + "\nCopyright 2020 Me. Released under the MIT License."))
    want.append(("MIT/notice", 2, 2))
    rows.append((len(rows), "one\n(c) Me. Licensed under CC BY 4.0. " + prose))
    want.append(("CC-BY-4.0/notice", 2, 1))
    got = sorted(licenses.scan_licenses(corpus(spark, rows)).collect())
    assert [(r["license"], r["line"], r["n_matches"]) for r in got] == want
    assert all(r["dice"] > 0.9 for r in got)


def test_full_licenses_are_told_apart():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.THRESHOLD)
    assert {"BSD-3-Clause", "LGPL-2.1", "LGPL-3.0", "GPL-2.0", "GPL-3.0", "AGPL-3.0", "Apache-2.0", "MPL-2.0", "Unlicense"} <= licenses.TEMPLATES.keys()
    for name, t in licenses.TEMPLATES.items():
        for start in ("", " * "):
            wrapped = "\n".join(start + line for line in textwrap.wrap(t, 72))
            assert scanner.scan("some words\n" + wrapped + "\nand others")[0] == name
    three = licenses.TEMPLATES["BSD-2-Clause"].replace("THIS SOFTWARE IS", "3. Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS", 1)
    assert scanner.scan(three)[0] == "BSD-3-Clause"


def test_license_windows_equal_brute_force():
    rng = random.Random(2)
    for k in range(400):
        letters = "abcdef"[: rng.randrange(2, 7)]
        templates = {n: " ".join(rng.choices(letters, k=rng.randrange(1, 7))) for n in "xyz"}
        scanner = licenses.Scanner(templates, rng.choice([0.5, 0.7, 0.8, 1.0]))
        words = rng.choices(letters + "q", k=rng.randrange(0, 25))
        want = max(((licenses.dice(licenses.bigrams(words[a:z]), t), -i) for a in range(len(words)) for z in range(a + 1, len(words) + 1) for i, (_, t) in enumerate(scanner.templates)), default=(0, 0))
        name, d, line, n = scanner.scan(" ".join(words))
        assert (name, d) == ((scanner.templates[-want[1]][0], want[0]) if want[0] >= scanner.threshold else (None, None))
        taken = sorted(scanner.matches(words), key=lambda m: m[2])
        assert len(taken) == n and all(x[3] <= y[2] for x, y in zip(taken, taken[1:], strict=False))
        # nothing that reaches the threshold is left between the matches
        for a, z in zip([0, *(m[3] for m in taken)], [*(m[2] for m in taken), len(words)], strict=True):
            assert not any(licenses.dice(licenses.bigrams(words[i:j]), t) >= scanner.threshold for i in range(a, z) for j in range(i + 1, z + 1) for _, t in scanner.templates)


# --- 10 ---


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    extra = spark.createDataFrame([(9001, None, None), (9002, "u", ""), (None, "u", "<html><body><nav><a>Home</a></nav><article><p>A &amp; B &lt;c&gt; are\n two letters that we like.</p><script>x('</p>')</script><p>More text here, in the main part.</p></article><footer>f</footer></body></html>")], "page_id long, url string, html string")
    rows = pages.unionByName(extra).withColumn("text", F.lit("t"))
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(rows).collect()}
    assert len(got) == pages.count() + 3 and got[9001] == "" and got[9002] == ""
    assert got[None] == "A & B <c> are two letters that we like.\n\nMore text here, in the main part."
    for r in pages.collect():
        inner = r["html"].split("<article>")[1].split("</article>")[0].replace("<br>", " ")
        blocks = [" ".join(__import__("html").unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?p>|</?h1>", inner)]
        assert got[r["page_id"]] == "\n\n".join(b for b in blocks if b)


def test_path_names_are_told_apart():
    names = html_text.FOREIGN | html_text.CONTAINER | {"section", "body", ".body", "ul", "span", "h2", "header"}
    assert len({html_text.path_bin(n) for n in names}) == len(names)
    assert html_text.path_bin(".cookie") == html_text.path_bin("cookie") and html_text.path_bin(".zzz") >= len(html_text.KNOWN)


def test_foreign_blocks_of_every_name(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").orderBy("page_id").collect()]
    model, parser = html_text.train(pages[:96]), html_text._Parser()

    def kept(page):
        blocks = parser.blocks(page)
        return [b.text for b, p in zip(blocks, model.probabilities([html_text.vectors(blocks)])[0], strict=True) if p >= 0.5]

    page = pages[0]
    for word in sorted(html_text.FOREIGN):
        note = f'<div class="{word}"><p>Some words that nobody asked for, sent to you by us.</p></div>'
        for mark, new in (("<article>", f"{note}<article>"), ("</article>", f"{note}</article>"), ("</article>", f"</article>{note}")):
            assert kept(page.replace(mark, new)) == kept(page), word


def test_embedded_elements_are_read():
    page = "<article><p>Say <math><mi>x</mi></math> or <svg><title>t</title><text>drawn</text></svg>more.</p><template><p>held</p></template><object>else</object><svg><path/></svg><textarea>f</textarea></article>"
    got = [(b.path, b.text) for b in html_text._Parser().blocks(page)]
    assert got == [(("article", "p"), "Say x or more."), (("article", "p", "svg"), "drawn"), (("article", "template", "p"), "held"), (("article", "object"), "else")]
    assert [b.text for b in html_text._Parser().blocks("<svg>" * 500 + "deep")] == ["deep"]


def test_broken_long_and_repeated_pages(spark):
    good = "<html><body><nav><a>Home</a></nav><article><p>Some words that we wrote here.</p></article></body></html>"
    rows = [(1, "u", good), (1, "u", good), (2, "u", "<article><p>Never closed & <b>bold"), (3, "u", "<" * 50_000), (4, "u", "<div " + "a" * 100_000), (5, "u", "<article>" + "<p>Many words of text are here.</p>" * 20_000 + "</article>"), (6, "u", "</p></div></nav>plain")]
    got = [(r["page_id"], r["text"]) for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert len(got) == len(rows) and Counter(i for i, _ in got)[1] == 2 and len({t for i, t in got if i == 1}) == 1
    assert dict(got)[5].count("\n\n") == 19_999


def test_labeller_reads_as_a_plain_lstm():
    rng = np.random.default_rng(3)
    model = html_text.Labeller(2)
    rows = [(rng.random((n, html_text.WIDTH)) < 0.1).astype(np.float32) for n in (1, 4, 9)]
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    n = html_text.HIDDEN

    def read(x, d):
        h, c, out = np.zeros(n), np.zeros(n), []
        for step in x if d == "f" else x[::-1]:
            z = step @ model.p[f"x{d}"] + h @ model.p[f"h{d}"] + model.p[f"c{d}"]
            i, f, o, g = sigmoid(z[:n]), sigmoid(z[n : 2 * n]), sigmoid(z[2 * n : 3 * n]), np.tanh(z[3 * n :])
            c = f * c + i * g
            h = o * np.tanh(c)
            out.append(h)
        return np.array(out if d == "f" else out[::-1])

    for x, p in zip(rows, model.probabilities(rows), strict=True):
        states = np.concatenate([read(x, "f"), read(x, "b")], axis=1)
        assert np.abs(sigmoid(states @ model.p["out"] + model.p["bias"])[:, 0] - p).max() < 1e-5


def test_pages_of_nothing(spark):
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_gradients_of_the_labeller():
    rng = np.random.default_rng(0)
    model = html_text.Labeller(1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rows = [rng.standard_normal((n, html_text.WIDTH)).astype(np.float32) * 0.3 for n in (3, 5)]
    labels = [np.array([1, 0, 1], np.float32), np.array([0, 1, 1, 0, 0], np.float32)]

    def loss():
        p = np.concatenate(model.probabilities(rows))
        y = np.concatenate(labels)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grad = model.gradients(rows, labels)
    for name in ("xf", "hb", "cf", "out", "bias"):
        at = tuple(rng.integers(0, s) for s in model.p[name].shape)
        old = model.p[name][at]
        values = []
        for d in (1e-3, -1e-3):
            model.p[name][at] = old + d
            values.append(loss())
        model.p[name][at] = old
        assert grad[name][at] == pytest.approx((values[0] - values[1]) / 2e-3, abs=2e-4)


def test_long_attributes_keep_their_own_names():
    long = 'data-x="' + "y" * 220 + '"'
    for order in (("footer", "article"), ("article", "footer")):
        page = "".join(f'<div {long} class="{c}"><p>{c} text</p></div>' for c in order) + f"<div {long}><p>none</p></div>"
        assert [(b.path, b.text) for b in html_text._Parser().blocks(page)] == [*((("div", f".{c}", "p"), f"{c} text") for c in order), (("div", "p"), "none")]


def test_references_in_cdata_stay():
    assert [b.text for b in html_text._Parser().blocks("<p>a &lt; <![CDATA[b &lt; c]]></p>")] == ["a < b &lt; c"]


# --- rows behind a shuffle ---


@pytest.fixture
def behind_a_shuffle(spark):
    """Wide rows that come from a shuffle, which adaptive execution reads in other pieces for other columns."""
    spark.conf.set("spark.sql.shuffle.partitions", 32)
    n = 40_000
    body = F.concat_ws(" ", *[F.concat(F.lit(w), F.col("id") % (n // 2)) for w in "abcdef"])
    df = spark.range(n).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.floor(F.log2(F.col("id") + 1))).alias("source"), body.alias("text"), F.create_map(F.lit("k"), F.col("id")).alias("map"),
        F.array_join(F.transform(F.sequence(F.lit(0), F.lit(40)), lambda x: F.sha2((F.col("id") * 41 + x).cast("string"), 256)), "").alias("payload"),
    )
    yield df.repartition(32), n
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_no_row_is_lost_behind_a_shuffle(spark, behind_a_shuffle):
    df, n = behind_a_shuffle
    left = exact_dedup.drop_exact_duplicates(df).select("doc_id", "text", F.length("payload").alias("p"), F.col("map")["k"].alias("m")).collect()
    assert {r["doc_id"] for r in left} == set(range(n // 2, n)) and len(left) == n // 2 and all(r["p"] == 41 * 64 and r["m"] == r["doc_id"] for r in left)
    mixed = mixing.mix(df, repetition_limit=1.5, block_tokens=500).select("doc_id", F.length("payload").alias("p")).collect()
    assert {r["doc_id"] for r in mixed} == set(range(n)) and all(r["p"] == 41 * 64 for r in mixed)
    cut = substring_dedup.remove_repeats(df, 5).groupBy("n_words", "n_removed").count().collect()
    assert {tuple(r) for r in cut} == {(6, 0, n // 2), (6, 6, n // 2)}
    coded = bpe.encode_texts(df.withColumn("text", F.when(F.col("doc_id") % 400 == 0, F.col("payload")).otherwise("w")), TOKENIZER, long_text=100, leaf=300)
    assert {r["doc_id"]: r["d"].replace(" ", "") for r in coded.select("doc_id", F.col("encoded.decoded").alias("d")).collect()}.keys() == set(range(n))
    assert coded.filter("doc_id % 400 = 0 AND encoded.n_tokens < 100").count() == 0


# --- queries ---

CONTRACTS = {
    "op2_shard_by_bytes": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op3_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op4_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op5_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op6_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op8_bpe_roundtrip": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op9_topk_search": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op10_html_text": "page_id bigint, url string, text string, n_chars bigint",
}


@pytest.mark.parametrize("name", CONTRACTS)
def test_queries_keep_their_contracts(spark, name):
    from mintleaf.llm import queries

    sf = "/root/testdata/sf0.001"
    got = queries.QUERIES[name](spark, sf)
    kinds = dict(got.dtypes)
    assert {c: kinds[c] for c in (x.split()[0] for x in CONTRACTS[name].split(", "))} == dict(x.split() for x in CONTRACTS[name].split(", "))
    rows = got.collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    if name not in ("op9_topk_search", "op10_html_text"):
        assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in docs)
    pairs = [(r["doc_id"], r["text"]) for r in docs]
    if name == "op4_substring_dedup":
        want = Counter((i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in brute_windows(pairs, 20).elements())
        assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows) == want
    if name == "op5_near_dedup":
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute_near(pairs)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    if name == "op2_shard_by_bytes":
        assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows} == {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in pairs}
    if name == "op10_html_text":
        assert all(r["n_chars"] == len(r["text"]) for r in rows)


# --- pipeline ---


def test_language_stage_without_labels_and_with_foreign_text(spark):
    import corpus_pipeline

    rng = random.Random(6)
    rows = [(k, text(rng, 20), None) for k in range(20)] + [(30, "12 34", None), (31, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in corpus_pipeline.identify_language(spark, df, "").collect()} == set(range(20))
    labelled = df.withColumn("lang", F.lit("en")).unionByName(spark.createDataFrame([(40, "一二三四五六七八九十", "en"), (41, text(rng, 20), None)], df.schema))
    assert {r["doc_id"] for r in corpus_pipeline.identify_language(spark, labelled.filter("doc_id != 40").unionByName(spark.createDataFrame([(40, "一二三四五六七八九十", None)], df.schema)), "").collect()} == {*range(20), 41}


def test_pipeline_of_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    schema = "doc_id long, text string, lang string, source string, n_chars int, encoded string, n_tokens int, _mix string, `a.b` string, component_id int"
    rows = [(k, text(rng, 30), "en", "a" if k % 5 else None, None, "e", 1, "m", "x", 0) for k in range(40)]
    rows += [(50, None, None, None, None, None, None, None, None, None), (51, "", "en", "a", 1, None, None, None, None, None), (1, rows[1][1], "en", "b", 1, None, None, None, None, None), (None, text(rng, 9), "en", "a", 1, None, None, None, None, None)]
    for name, given in (("full", rows), ("none", [])):
        (tmp_path / name).mkdir()
        spark.createDataFrame(given, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "full"))
    kept = [r["doc_id"] for r in got.collect()]
    assert set(kept) == {*range(40), None} and {"n_tokens", "ids", "decoded", "a.b", "_mix"} <= set(got.columns)
    assert all(r["n_tokens"] == len(r["ids"].split()) > 0 and r["decoded"] for r in got.collect())
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        after = docs.collect()
        if k < 4:
            assert docs.columns == columns
        if k == 0:
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if language.has_letter(r["text"])}
        if k == 4:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(TOKENIZER)
            for r in after[:50]:
                ids = library.encode(r["text"], add_special_tokens=False).ids
                assert (r["ids"], r["n_tokens"], r["decoded"]) == (" ".join(map(str, ids)), len(ids), library.decode(ids, skip_special_tokens=False))
        if k == 1:
            best = {}
            for r in before:
                best[normal(r["text"])] = max(best.get(normal(r["text"]), -1), r["doc_id"])
            assert {r["doc_id"] for r in after} == set(best.values()) and len(after) == len(best)
        if k == 2:
            want = brute_near([(r["doc_id"], r["text"]) for r in before])
            assert {r["doc_id"] for r in after} == {i for i, (_, c) in want.items() if i == c}
        if k == 3:
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before} and len(after) >= len(before)
        docs = spark.createDataFrame(after, docs.schema)
    assert docs.columns == [*columns, "n_tokens", "ids", "decoded"]


def test_near_duplicates_where_ids_repeat(spark):
    """As many rows come out as go in, and rows of one id bring their sets' components together."""
    rng = random.Random(2)
    one, two = text(rng, 60), text(rng, 60)
    base = [text(rng, 60) for _ in range(6)]
    rows = [(500, None), (500, one), (501, ""), (501, ""), (None, one), (None, None), (500, two), (1, one), (1, two), (2, one + " x"), (3, two + " y")]
    for k in range(100):
        words = rng.choice(base).split()
        words[rng.randrange(60)] = f"z{k}"
        rows.append((rng.choice([k, k, k, rng.randrange(40)]) + 10, rng.choice([" ".join(words), text(rng, 30), rng.choice(base)])))
    sets = [frozenset(zip(*(words_of(normal(t))[j:] for j in range(5)), strict=False)) for _, t in rows]
    group = list(range(len(rows)))
    for i, (a, x) in enumerate(zip(rows, sets, strict=True)):
        for j, (b, y) in enumerate(zip(rows[:i], sets, strict=False)):
            if None not in (a[0], b[0]) and x and y and (a[0] == b[0] or 100 * len(x & y) >= 75 * len(x | y)):
                group = [group[i] if g == group[j] else g for g in group]
    least = {g: min(r[0] for r, h in zip(rows, group, strict=True) if h == g) for i, g in enumerate(group) if rows[i][0] is not None}
    want = [(r[0], len(s), None if r[0] is None else least[g], r[0] is None or least[g] == r[0]) for r, s, g in zip(rows, sets, group, strict=True)]
    got = [tuple(r) for r in near_dedup.near_duplicates(corpus(spark, rows)).select("id", "n_shingles", "component_id", "kept").collect()]
    assert Counter(got) == Counter(want)
