import random
import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mintleaf.functions.arrays import sums_before
from mintleaf.functions.text import star_sentiment
from mintleaf.operators import assertions, complaints, match, quality, report, segment, terms


def clauses_of(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(segment.clauses(F.col("t")).alias("c")).first()["c"]


@pytest.mark.parametrize(("rating", "want"), [(1.0, "Negative"), (2.0, "Negative"), (2.5, "Neutral"), (3.0, "Neutral"), (3.5, "Neutral"), (4.0, "Positive"), (5.0, "Positive"), (None, None)])
def test_star_sentiment(spark, rating, want):
    assert spark.createDataFrame([(rating,)], "r double").select(star_sentiment(F.col("r")).alias("s")).first()["s"] == want


def test_concessive_opening_is_cut(spark):
    got = clauses_of(spark, "Despite the cold soup, we enjoyed the evening very much.")
    assert len(got) >= 2 and not any(c.lower().startswith("despite ") for c in got)
    assert clauses_of(spark, "  ") == [] and clauses_of(spark, None) == [] and clauses_of(spark, "Great") == ["Great"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="ab é,.;!?\n\tbut however", max_size=60))
def test_spans_give_their_text(spark, text):
    for boundary in (segment.BOUNDARY, segment.SIMPLE_BOUNDARY):
        for s in spark.createDataFrame([(text,)], "t string").select(segment.spans(F.col("t"), boundary).alias("s")).first()["s"]:
            assert text[s["start"] : s["end"]] == s["text"]


@pytest.mark.parametrize(("text", "want"), [
    ("The music was slow and peaceful", {"Ambience"}), ("We ordered slow cooked mutton", {"Food"}), ("It was so slow", {"Service"}), ("Visited yesterday at 8 PM", set()), ("It was good", set()),
    ("We waited 40 minutes for the bill", {"Service"}), ("Great value for money", {"Price / Value"}), ("the ac was loud", {"Ambience"}), (None, set()), ("live music", {"Ambience"}), ("All in  all a fine dish", {"Food", "General Experience"}),
    ("the waiter recommended it", {"Service"}), ("I recommend it", {"General Experience"}),
])
def test_aspects(spark, text, want):
    c = spark.createDataFrame([("1", text)], "clause_id string, clause_text string")
    got = {r["aspect"] for r in match.lexicon_matches(c, match.lexicon_table(spark)).collect()}
    assert got == want


def test_latency_rule_spares_other_waits(spark):
    late = lambda t: spark.createDataFrame([(t,)], "t string").select(match.has_latency(F.col("t")).alias("l")).first()["l"]
    assert late("we waited long") and not late("I can't wait to see it") and not late(None)


def test_semantic_fallback_keeps_its_guards(spark):
    c = spark.createDataFrame([("1", "It was good", [0.0, 1.0]), ("2", "we loved our evening", [0.0, 1.0]), ("3", "cost an arm", [1.0, 0.1]), ("4", "matched", [1.0, 0.0])], "clause_id string, clause_text string, embedding array<double>")
    table = spark.createDataFrame([(0, "Price / Value", [1.0, 0.0]), (1, "General Experience", [0.0, 1.0])], "ord int, aspect string, centroid array<double>")
    got = {(r["clause_id"], r["aspect"]) for r in match.semantic_fallback(c, c.filter("clause_id = '4'"), table).collect()}
    assert got == {("2", "General Experience"), ("3", "Price / Value")}


def test_pairing_takes_each_target_once(spark):
    kind = "array<struct<pos:int,word:string>>"
    df = spark.createDataFrame([([(5, "soup"), (20, "waiter")], [(7, "cold"), (9, "salty"), (30, "late")])], f"t {kind}, o {kind}")
    got = df.select(assertions.pair_targets(F.col("t"), F.col("o")).alias("p")).first()["p"]
    assert [(p["target"], p["opinion"]) for p in got] == [("soup", "cold"), ("waiter", "salty")]


def test_typed_scores(spark):
    got = spark.createDataFrame([("Food - 4/5, service: 2/5 and Ambience-3/5",)], "t string").select(assertions.typed_scores(F.col("t")).alias("s")).first()["s"]
    assert [(x["aspect"], x["sentiment"]) for x in got] == [("Food", "Positive"), ("Service", "Negative"), ("Ambience", "Neutral")]


def test_first_rule_and_outer_spans(spark):
    c = spark.createDataFrame([("1", "cold soup"), ("2", "nothing")], "clause_id string, clause_text string")
    rules = assertions.rule_table(spark, [("soup", "Food", "Negative", "taste", "Annotated"), ("cold", "Ambience", "Negative", "air", "Annotated")])
    assert {r["clause_id"]: r["aspect"] for r in assertions.first_rule(c, rules).collect()} == {"1": "Food", "2": None}
    hits = assertions.find_spans(c, ["cold soup", "soup", "col"])
    assert [(r["start"], r["end"]) for r in assertions.outer_spans(hits).collect()] == [(0, 9)]


def test_spans_take_words_literally(spark):
    c = spark.createDataFrame([("1", "a.b (a.b) axb"), ("2", None)], "clause_id string, clause_text string")
    got = {(r["start"], r["end"], r["span"]) for r in assertions.find_spans(c, ["a.b", "(", "A.B"]).collect()}
    assert got == {(0, 3, "a.b"), (5, 8, "a.b"), (4, 5, "(")}


def test_guards_hold_back_general_clauses(spark):
    generic = ["It was good", "really nice.", "They were not great!", "all was perfect"]
    told = ["Visited yesterday", "We went there", "4 of us", "do follow us", "I ordered soup"]
    other = ["the soup was good", "a lovely evening", "", None]
    df = spark.createDataFrame([(t,) for t in [*generic, *told, *other]], "t string").select("t", match.only_generic(F.col("t")).alias("g"), match.factual_context(F.col("t")).alias("f")).collect()
    assert [r["t"] for r in df if r["g"]] == generic and [r["t"] for r in df if r["f"]] == told


def test_extraction_takes_the_nearest_aspect_where_no_word_fits(spark):
    c = spark.createDataFrame([("r", "1", "It was good", [0.0, 1.0]), ("r", "2", "we loved our evening", [0.0, 1.0]), ("r", "3", "tasty mutton", [0.0, 1.0]), ("r", "4", "nothing near", [-1.0, -1.0])], "review_id string, clause_id string, clause_text string, embedding array<double>")
    table = spark.createDataFrame([(0, "Price / Value", [1.0, 0.0]), (1, "General Experience", [0.0, 1.0])], "ord int, aspect string, centroid array<double>")
    lex = match.lexicon_table(spark)
    assert {(r["clause_id"], r["aspect"], r["sentiment"]) for r in match.extract_aspects(c, lex, table).collect()} == {("2", "General Experience", "Positive"), ("3", "Food", "Positive")}
    assert {r["clause_id"] for r in match.extract_aspects(c, lex).collect()} == {"3"}


def test_long_texts_take_time_in_proportion(spark):
    import time

    words = ["soup was good and the waiter is rude."] * 1000
    took = []
    for n in (1, 1, 3):
        df = spark.createDataFrame([(" ".join(words * n),)], "t string")
        began = time.time()
        r = df.select(F.size(complaints.opinion_pairs(F.col("t"), ["soup", "waiter"], ["good", "rude"])).alias("p"), F.size(segment.spans(F.col("t"))).alias("s")).first()
        took.append(time.time() - began)
        assert r["p"] == 3 and r["s"] == 1000 * n
    assert took[2] < 6 * took[1] + 2


def test_opinion_pairs_and_merging(spark):
    df = spark.createDataFrame([("The soup was not fresh, rude waiter. The place was dirty",)], "t string")
    pairs = df.select(complaints.opinion_pairs(F.col("t"), ["soup", "waiter", "place"], ["fresh", "rude", "dirty"]).alias("p")).first()["p"]
    assert set(pairs) == {"soup not fresh", "rude waiter"}
    ranks = spark.createDataFrame([("X", 1, "rude waiter", 5), ("X", 2, "waiter rude", 3), ("X", 3, "cold soup", 2)], "Restaurant string, rank int, phrase string, frequency bigint")
    got = [(r["root_cause"], r["frequency"]) for r in complaints.merge_like(ranks).orderBy("rank").collect()]
    assert got == [("Rude Waiter", 8), ("Cold Soup", 2)]
    quoted = ranks.withColumn("evidence_quotes", F.when(F.col("rank") < 3, F.array(F.lit("same"), F.concat(F.lit("q"), F.col("rank").cast("string")))))
    assert [r["evidence_quotes"] for r in complaints.merge_like(quoted).orderBy("rank").collect()] == [["same", "q1", "q2"], []]


def test_number_check(spark):
    df = spark.createDataFrame([("Index 999 and 12.34, 5 of 88", '{"a": 88}')], "report string, payload string")
    r = report.verify_numbers(df).first()
    assert r["unmatched_numbers"] == ["999", "12.34"] and not r["verification_passed"]


def test_validator_names_each_broken_rule(spark):
    rows = [
        ("a", "r1", "good soup", "Food", "Positive", "Annotated", 0, 9), ("b", "r1", "good soup", "Foo", None, "Annotated", 0, 9), ("c", "r1", "other", "Food", "Positive", "Annotated", 0, 9),
        ("d", "r9", "x", "Food", "Positive", "Annotated", 0, 1), ("e", "r1", "good soup", "Food", None, "No Aspect Opinion", 5, 99), ("f", "r1", "good soup", "Food", "Positive", "Odd", None, None), ("a", "r1", "good soup", "Food", "Positive", "Annotated", 0, 9),
    ]
    df = spark.createDataFrame(rows, "assertion_id string, review_id string, clause_text string, aspect string, sentiment string, annotation_status string, clause_start_char int, clause_end_char int")
    got = {(r["assertion_id"], r["rule"]) for r in quality.validate(df, spark.createDataFrame([("r1", "good soup")], "review_id string, Review string")).collect()}
    assert got == {("a", "duplicate id"), ("b", "bad aspect"), ("b", "bad sentiment"), ("c", "text mismatch"), ("d", "missing review"), ("e", "bad range"), ("e", "opinion on no-opinion row"), ("f", "bad range"), ("f", "bad status")}


def test_full_boundary_query_equals_brute_force(spark, tmp_path):
    import re

    from mintleaf.plans import q_text

    texts = ["Food was good, but service slow. It cost 3.5 euros; see www.a.b/c!", "Nice However we left\r\nno", "one, and also two", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s")).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for k, t in enumerate(texts):
        at = 0
        for m in [*re.finditer(segment.BOUNDARY, t, re.I), None]:
            piece = t[at : m.start() if m else len(t)]
            if re.search(r"\w", piece):
                start = at + len(piece) - len(piece.lstrip())
                want.append((str(k), start, start + len(piece.strip()), piece.strip()))
            at = m.end() if m else at
    got = q_text.QUERIES["clause_segments_full"](spark, str(tmp_path)).select("review_id", "clause_start_char", "clause_end_char", "clause_text").collect()
    assert sorted(map(tuple, got)) == sorted(want) and ("0", 0, 13, "Food was good") in want
    check = q_text.QUERIES["clause_offsets_check_full"](spark, str(tmp_path)).first()
    assert check["n"] == check["matches"] == len(want)
    for name in ("clause_counts_full", "lexicon_match_full", "aspect_sentiment_counts_full"):
        q_text.QUERIES[name](spark, str(tmp_path)).collect()


ODD_TEXTS = [
    "è", "!!!", "你好", "éé. ñ", "\x0b", "a.\x0b b is the\x0b. c", "is.\u2028", "is on the!\x85", ".\u00a0is of\u00a0the. ", "été is, butß the", "x ,\x0bhowever y", "éat is. éis; wasé", "ßthat. thisñ", "slow\u00a0is", "5\u00a0min order", "in\x1cthe",
    "only words, but more of the", "", " ", None,
]


def test_odd_texts_give_what_the_sql_does(spark, tmp_path):
    """Words and spaces beyond ASCII, texts without an ASCII word, and ends of lines of other kinds."""
    duckdb = pytest.importorskip("duckdb")
    from mintleaf.plans import q_audit, q_text

    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(list(enumerate(ODD_TEXTS)), "doc_id long, text string").withColumn("source", F.lit("s")).coalesce(1).write.parquet(path)
    spark.createDataFrame([("è is été of",)], "text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    names = ["clause_counts", "clause_offsets_check", "clause_segments", "lexicon_match", "aspect_sentiment_counts"]
    for name in [*names, *(f"{n}_full" for n in names), "lexicon_many_terms", "lexicon_phrases", "offset_check"]:
        plans = q_audit if name == "offset_check" else q_text
        got = plans.QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({plans.ORACLE_SQL[name]})").fetchall()
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr), name


ODD_IDS = {
    7: "a\u0001b. this is; than", 8: "\u0001x\ny! of the", 9: "THİS İS\nIN THE ΟΔΟΣ", 10: "music, whereaſx is. x whereaſ that", 11: "thİs wİth and", 12: "é\u0001\u0001is\u0001", None: "That is of the é. this; ΟΔΟΣ was", 13: None,
}


def test_marks_capitals_and_missing_ids_give_what_the_sql_does(spark, tmp_path):
    """U+0001 at which both sides cut, letters whose lower case differs between engines, and a row without an id."""
    duckdb = pytest.importorskip("duckdb")
    from mintleaf.plans import q_text

    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(list(ODD_IDS.items()), "doc_id long, text string").withColumn("source", F.lit("s")).coalesce(1).write.parquet(path)
    spark.createDataFrame([("İs οδος ΟΔΟΣ this unseen thıs",)], "text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    names = ["clause_counts", "clause_offsets_check", "clause_segments", "lexicon_match", "aspect_sentiment_counts"]
    for name in [*names, *(f"{n}_full" for n in names), "lexicon_many_terms", "lexicon_phrases"]:
        got = q_text.QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({q_text.ORACLE_SQL[name]})").fetchall()
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr), name


def test_clauses_fall_back_on_the_whole_text(spark):
    df = spark.createDataFrame([("1", " è. "), ("2", " "), ("3", "a; è")], "review_id string, Review string")
    kept = lambda **options: [(r["review_id"], r["clause_text"]) for r in segment.clause_rows(df, **options).collect()]
    assert kept() == [("1", "è."), ("3", "a")] and kept(fallback=False) == [("3", "a")]


def test_clause_texts_are_those_of_spans(spark):
    df = spark.createDataFrame([(x,) for x in [*ODD_TEXTS, *ODD_IDS.values()]], "t string")
    for boundary in (segment.BOUNDARY, segment.SIMPLE_BOUNDARY):
        rows = df.select(segment.clause_texts(F.col("t"), boundary).alias("got"), F.transform(segment.spans(F.col("t"), boundary, False), lambda s: s["text"]).alias("want")).collect()
        assert [r["got"] for r in rows] == [r["want"] for r in rows]


def test_aspect_counts_shuffle_no_text(spark, tmp_path):
    """The texts are read and cut once, and no clause is joined with its aspects."""
    from mintleaf.plans import q_text

    spark.createDataFrame([(1, "s", "that was; this")], "doc_id long, source string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("aspect_sentiment_counts", "aspect_sentiment_counts_full"):
        plan = q_text.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and plan.count("parquet") == 1


# --- many terms, many rules, long texts ---


def test_terms_of_ascii_words():
    pairs = [("is", 0), ("of the", 1)]
    assert terms.TermIndex(pairs, ascii=True).labels("éis of the") == {0, 1} and terms.TermIndex(pairs).labels("éis of the") == {1}



def test_terms_like_patterns():
    """The tree of words finds what a pattern for each term finds."""
    rng = random.Random(3)
    parts = ["a", "b", "ab", "live", "music", "of", "the"]
    names = ["live-music", "of the", "a b  ab", "ab", "can't", "live-music of", "a-b c", "the-of the", "été x", "x_1"] + [rng.choice([" ", "-"]).join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(60)]
    index = terms.TermIndex([(t, k) for k, t in enumerate(names)])
    gap = lambda w: r"(?:[ \t\n\x0b\f\r]|-)".join(map(re.escape, w.split("-")))
    patterns = [re.compile(r"\b" + r"[ \t\n\x0b\f\r]+".join(map(gap, t.split())) + r"\b") for t in names]
    for _ in range(400):
        text = "".join(rng.choice([*parts, "é", "été", "x", "Can't", "_1"]) + rng.choice([" ", "  ", "-", "\n", ", ", "", "' "]) for _ in range(rng.randrange(12)))
        assert index.labels(text) == {k for k, p in enumerate(patterns) if p.search(text.lower())}, text
    with pytest.raises(ValueError, match="begins"):
        terms.TermIndex([("*x", 0)])


@pytest.mark.parametrize(
    ("pattern", "literals"),
    [("cold (soup|tea)", ["cold "]), (r"\bwaiter\b", ["waiter"]), ("ab?c+de", ["de"]), ("rude|slow[a-z]+ly", ["rude", "slow"]), ("(?:rude|kind)", ["rude", "kind"]), (r"a\.b", ["a.b"]), ("x{2}yz", ["yz"]),
     ("a|bc", None), ("(?i)food", None), ("[abc]de.f", ["de"]), (r"\d+ min", [" min"]), ("fo+d", ["fo"]), ("abc*?de", ["ab"]), ("", None)],
)
def test_required_literals(pattern, literals):
    assert terms.required_literals(pattern) == literals


def test_rules_like_a_cascade():
    rng = random.Random(5)
    words = ["cold", "soup", "rude", "waiter", "slow", "tea", "noise", "ſoup"]
    patterns = [rng.choice([r"{}\s+{}", "{}|{}", r"\b{}\b.*{}", "{}?{}", "({}|x){}+", "[{}]{{3}}{}"]).format(*rng.sample(words, 2)) for _ in range(120)]
    index, plain = terms.RuleIndex(patterns), [re.compile(p, re.IGNORECASE) for p in patterns]
    for _ in range(300):
        text = " ".join(rng.choice([w, w.upper()]) for w in rng.choices(words, k=rng.randrange(5)))
        assert index.first(text) == next((k for k, p in enumerate(plain) if p.search(text.lower())), None), text
    assert terms.RuleIndex([]).first("x") is None


def test_costs_grow_in_proportion(spark):
    """Many terms and rules cost about what few do, and a long text what its parts do."""

    def seconds(f, times=3):
        best = 1e9
        for _ in range(times):
            began = time.perf_counter()
            f()
            best = min(best, time.perf_counter() - began)
        return best

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    texts = [" ".join(word() for _ in range(12)) for _ in range(3000)]
    few, many = (terms.TermIndex([(f"{word()} {word()}", 0) for _ in range(n)]) for n in (10, 10_000))
    assert seconds(lambda: [many.labels(t) for t in texts]) < 4 * seconds(lambda: [few.labels(t) for t in texts])
    few, many = (terms.RuleIndex([rf"\b{word()}\s+{word()}" for _ in range(n)]) for n in (10, 2000))
    assert seconds(lambda: [many.first(t) for t in texts]) < 4 * seconds(lambda: [few.first(t) for t in texts])
    run = lambda n: lambda: spark.createDataFrame([("the food was fine. " * n,)], "t string").select(F.size(segment.spans(F.col("t")))).first()
    assert run(32000)()[0] == 32000
    assert seconds(run(32000), 2) < 8 * seconds(run(8000), 2)


def test_rule_tables(spark):
    c = spark.createDataFrame([("1", "Cold SOUP"), ("2", None), ("3", "tea")], "clause_id string, clause_text string").withColumn("priority", F.lit("clash"))
    rules = assertions.rule_table(spark, [("soup", "Food", "Negative", "t", "Annotated"), ("cold", "Service", None, None, "x")])
    assert [tuple(r) for r in assertions.first_rule(c, rules).select("clause_id", "priority", "aspect").orderBy("clause_id").collect()] == [("1", 0, "Food"), ("2", None, None), ("3", None, None)]
    assert assertions.first_rule(c, rules.filter("false")).filter("aspect is null").count() == 3
    same = rules.withColumn("priority", F.lit(1))
    assert assertions.first_rule(c, same).count() == 3


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 700])
def test_sums_before(spark, n):
    df = spark.createDataFrame([(list(range(n)),), (None,)], "x array<long>")
    assert [r[0] for r in df.select(sums_before(F.col("x"))).collect()] == [[sum(range(k)) for k in range(n)], None]


def test_spans_are_held_where_the_text_has_them(spark):
    """At the edges of blocks, over several, beyond the text, and beside signs of several bytes."""
    rng = random.Random(8)
    text = "".join(rng.choice(["a", "é", "你", "😀", "\n", "\r\n", ". "]) for _ in range(2000))
    at = [(0, 1), (255, 256), (255, 257), (256, 257), (256, 512), (511, 513), (1, 1900), (0, len(text)), (len(text) - 1, len(text)), *((k, k + rng.randrange(1, 600)) for k in rng.choices(range(1300), k=200))]
    right = [(a, b, text[a:b]) for a, b in at]
    wrong = [(a + 1, b + 1, text[a:b]) for a, b in at if text[a + 1 : b + 1] != text[a:b]] + [(len(text), len(text) + 1, "a"), (5000, 5002, "aa")]
    df = spark.createDataFrame([(text, right, wrong)], "t string, r array<struct<start: int, end: int, text: string>>, w array<struct<start: int, end: int, text: string>>")
    row = df.select(segment.held(F.col("t"), F.col("r")).alias("r"), segment.held(F.col("t"), F.col("w")).alias("w")).first()
    assert list(map(tuple, row["r"])) == right and row["w"] == []


def test_offset_checks_cost_in_proportion_to_a_text(spark, tmp_path):
    """64,000 clauses in one text: looked up from its start they would take hours."""
    from mintleaf.plans import q_text

    spark.createDataFrame([(1, "s", "the food was fine. " * 64000)], "doc_id long, source string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("clause_offsets_check", "clause_offsets_check_full"):
        began = time.perf_counter()
        assert tuple(q_text.QUERIES[name](spark, str(tmp_path)).first()) == (64000, 64000)
        assert time.perf_counter() - began < 60


def test_sums_before_in_longer_blocks(spark):
    df = spark.createDataFrame([(list(range(n)),) for n in (2047, 2048, 2049, 20000)], "x array<long>")
    for values, got in df.select("x", sums_before(F.col("x"))).collect():
        assert got == [k * (k - 1) // 2 for k in values]
