"""Validation, correction with provenance, and audits of annotations."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mintleaf.functions.numbers import count_if
from mintleaf.operators.segment import assertion_id
from mintleaf.schemas import ASPECTS, NO_OPINION, SENTIMENTS, STATUSES


def _bad_span(text: Column, span: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """(given without offsets, offsets that don't give it)."""
    given = F.coalesce(span, F.lit("")) != ""
    bare = given & (start.isNull() | end.isNull())
    return bare, given & ~bare & ~F.substring(text, start + 1, end - start).eqNullSafe(span)


def validate(assertions: DataFrame, reviews: DataFrame) -> DataFrame:
    """(assertion_id, rule, expected, actual): every broken rule. ``reviews`` has review_id and Review; rows keep their place.

    Copies of an id are counted where its rows lie together, so rows that are dealt out by their id needn't travel for it.
    """
    copies = F.when(F.col("assertion_id").isNotNull(), F.count(F.lit(1)).over(Window.partitionBy("assertion_id")))
    rows = assertions.withColumn("_copies", copies).join(reviews.select("review_id", F.col("Review").alias("_text")), "review_id", "left")
    s, e, status = F.col("clause_start_char"), F.col("clause_end_char"), F.col("annotation_status")
    in_range = F.coalesce((s >= 0) & (s < e) & (e <= F.length("_text")), F.lit(False))
    none = status.eqNullSafe(NO_OPINION)
    one_of = lambda names: F.lit("|".join(names))
    there = F.substring("_text", s + 1, e - s)
    rules: dict[str, tuple[Column, Column, Column]] = {
        "duplicate id": (F.col("_copies") > 1, F.lit("1"), F.col("_copies").cast("string")),
        "missing review": (F.col("_text").isNull(), F.lit("a review"), F.col("review_id")),
        "bad range": (F.col("_text").isNotNull() & ~in_range, F.concat(F.lit("0:"), F.length("_text").cast("string")), F.concat_ws(":", s.cast("string"), e.cast("string"))),
        "text mismatch": (in_range & ~there.eqNullSafe(F.col("clause_text")), there, F.col("clause_text")),
        "bad status": (~F.coalesce(status.isin(*STATUSES), F.lit(False)), one_of(STATUSES), status),
        "bad aspect": (~none & ~F.coalesce(F.col("aspect").isin(*ASPECTS), F.lit(False)), one_of(ASPECTS), F.col("aspect")),
        "bad sentiment": (status.eqNullSafe("Annotated") & ~F.coalesce(F.col("sentiment").isin(*SENTIMENTS), F.lit(False)), one_of(SENTIMENTS), F.col("sentiment")),
        "opinion on no-opinion row": (none & (F.col("aspect").isNotNull() | F.col("sentiment").isNotNull()), F.lit(""), F.concat_ws("/", "aspect", "sentiment")),
    }
    for kind in ("target", "opinion"):
        if f"{kind}_text" in assertions.columns:
            span, at, to = (F.col(f"{kind}_{c}") for c in ("text", "start_char", "end_char"))
            bare, wrong = _bad_span(F.col("_text"), span, at, to)
            rules |= {f"{kind} without offsets": (bare, F.lit("offsets"), span), f"{kind} mismatch": (F.coalesce(wrong, F.lit(False)), F.substring("_text", at + 1, to - at), span)}
    errors = F.array_compact(F.array(*[
        F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(name).alias("rule"), expected.alias("expected"), actual.alias("actual"))) for name, (bad, expected, actual) in rules.items()
    ]))
    return rows.select("assertion_id", F.explode(errors).alias("e")).select("assertion_id", "e.*")


def key_errors(assertions: DataFrame, manifest: DataFrame) -> DataFrame:
    """(review_id, problem): reviews of the manifest without assertions, and of assertions outside the manifest."""
    return key_differences(manifest, assertions, "review_id")


def missing_offsets(assertions: DataFrame) -> DataFrame:
    """(assertion_id, kind, span, clause_text): target and opinion spans that have no offset."""
    kinds = F.array(*[
        F.when((F.coalesce(F.col(f"{k}_text"), F.lit("")) != "") & F.col(f"{k}_start_char").isNull(), F.struct(F.lit(k).alias("kind"), F.col(f"{k}_text").alias("span"))) for k in ("target", "opinion")
    ])
    return assertions.select("assertion_id", F.explode(F.array_compact(kinds)).alias("m"), "clause_text").select("assertion_id", "m.*", "clause_text")


def offset_check(spans: DataFrame, text: str, start: str, end: str, span: str) -> DataFrame:
    """One row (n, matches, mismatches, missing)."""
    gone = F.col(start).isNull() | F.col(end).isNull()
    ok = F.substring(F.col(text), F.col(start) + 1, F.col(end) - F.col(start)).eqNullSafe(F.col(span))
    return spans.agg(F.count(F.lit(1)).alias("n"), count_if(~gone & ok).alias("matches"), count_if(~gone & ~ok).alias("mismatches"), count_if(gone).alias("missing"))


@dataclass(frozen=True)
class Corrections:
    """The rules of ``correct``, tables of the caller's domain; patterns are matched without case, the first that occurs wins."""

    theme_aspects: dict[str, str] = field(default_factory=dict)
    #: (pattern, aspect) that overrule the theme
    overrides: tuple[tuple[str, str], ...] = ()
    #: aspects that a rationale may name, in order
    rationale_aspects: tuple[str, ...] = ASPECTS
    default_aspect: str = "General Experience"
    #: (pattern, aspect, sentiment) of evaluating clauses
    opinions: tuple[tuple[str, str, str], ...] = ()
    #: what clauses of mere facts start with or hold; not if an evaluating word occurs
    factual: str | None = None
    evaluating: str | None = None
    #: a narrative without a cue of sentiment has no opinion
    narrative: str | None = None
    cues: str | None = None
    #: (aspect or None, sentiment or None, pattern, new aspect or None, new sentiment, reason)
    contradictions: tuple[tuple[str | None, str | None, str, str | None, str, str], ...] = ()


def correct(assertions: DataFrame, rules: Corrections) -> DataFrame:
    """The assertions with original_* and corrected_* columns, action, reason and confidence; all rules see the original row.

    Three passes, each over rows of its own. Rows of no opinion: one that has a sentiment gets its aspect back (override,
    theme, rationale, default; Mixed becomes Neutral), another one the opinion of the first rule that its text meets.
    Rows with an aspect but without a sentiment: mere facts lose the aspect; an opinion rule gives the sentiment, and its
    aspect; a narrative without a cue loses the aspect; others are unresolved. Annotated rows with a sentiment: the first
    contradiction sets sentiment and aspect. Actions are changed, unresolved and unchanged.
    """
    text = F.coalesce(F.col("clause_text"), F.lit(""))
    low = F.lower(text)
    occurs = lambda p: low.rlike(p.lower()) if p else F.lit(False)
    status, aspect, sentiment = F.col("annotation_status"), F.col("aspect"), F.col("sentiment")
    none, blank = F.lit(None).cast("string"), F.lit("")
    made = lambda a, s, st, act, why, sure: F.struct(*[c.alias(n) for c, n in zip((a, s, F.lit(st), F.lit(act), why, F.lit(sure)), ("aspect", "sentiment", "status", "action", "reason", "confidence"), strict=True)])

    opinion, theirs = F.lit(None).cast("struct<aspect:string,sentiment:string>"), None
    for pattern, a, s in reversed(rules.opinions):
        theirs = F.struct(F.lit(a).alias("aspect"), F.lit(s).alias("sentiment"))
        opinion = F.when(occurs(pattern), theirs).otherwise(opinion)

    restored = F.lit(rules.default_aspect)
    rationale = F.coalesce(F.col("rationale") if "rationale" in assertions.columns else none, blank)
    for a in reversed(rules.rationale_aspects):
        restored = F.when(rationale.contains(a), a).otherwise(restored)
    theme = F.col("theme") if "theme" in assertions.columns else none
    for t, a in rules.theme_aspects.items():
        restored = F.when(theme == t, a).otherwise(restored)
    for pattern, a in reversed(rules.overrides):
        restored = F.when(occurs(pattern), a).otherwise(restored)

    factual = occurs(rules.factual) & ~occurs(rules.evaluating)
    no_opinion = status.eqNullSafe(NO_OPINION)
    unfilled = ~no_opinion & aspect.isNotNull() & sentiment.isNull()
    settled = status.eqNullSafe("Annotated") & sentiment.isNotNull()
    found = (
        F.when(no_opinion & sentiment.isNotNull(), made(restored, F.when(sentiment == "Mixed", "Neutral").otherwise(sentiment), "Annotated", "changed", F.lit("aspect restored"), "high"))
        .when(no_opinion & F.col("_opinion").isNotNull(), made(F.col("_opinion.aspect"), F.col("_opinion.sentiment"), "Annotated", "changed", F.lit("opinion found"), "high"))
        .when(unfilled & factual, made(none, none, NO_OPINION, "changed", F.lit("factual clause"), "high"))
        .when(unfilled & F.col("_opinion").isNotNull(), made(F.col("_opinion.aspect"), F.col("_opinion.sentiment"), "Annotated", "changed", F.lit("sentiment filled"), "high"))
        .when(unfilled & occurs(rules.narrative) & ~occurs(rules.cues), made(none, none, NO_OPINION, "changed", F.lit("narrative without a cue"), "high"))
    )
    for a, s, pattern, new_aspect, new_sentiment, why in rules.contradictions:
        hit = settled & occurs(pattern)
        hit = hit & (aspect == a) if a else hit
        hit = hit & (sentiment == s) if s else hit
        found = found.when(hit, made(F.lit(new_aspect) if new_aspect else aspect, F.lit(new_sentiment), "Annotated", "changed", F.lit(why), "high"))
    as_is = lambda act, why, sure: F.struct(aspect.alias("aspect"), sentiment.alias("sentiment"), status.alias("status"), F.lit(act).alias("action"), F.lit(why).alias("reason"), F.lit(sure).alias("confidence"))
    found = found.when(unfilled, as_is("unresolved", "ambiguous", "low")).otherwise(as_is("unchanged", "", "high"))
    out = assertions.withColumns({f"original_{c}": F.col(c) for c in ("aspect", "annotation_status", "sentiment")} | {"_opinion": opinion}).withColumn("_c", found)
    return out.withColumns({
        "corrected_aspect": F.col("_c.aspect"), "corrected_sentiment": F.col("_c.sentiment"), "corrected_annotation_status": F.col("_c.status"), "action": F.col("_c.action"), "reason": F.col("_c.reason"),
        "confidence": F.col("_c.confidence"),
    }).drop("_opinion", "_c")


def audit_log(corrected: DataFrame) -> DataFrame:
    """Changed and unresolved rows."""
    return corrected.filter("action != 'unchanged'")


def correction_invariants(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows lost, added, with another text or offsets, and changed without an entry in the log."""
    columns = ["clause_text", "clause_start_char", "clause_end_char"]
    a = before.select("assertion_id", *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(1).alias("in_a"))
    b = after.select("assertion_id", *[F.col(c).alias(f"b_{c}") for c in columns], "action", "original_aspect", "corrected_aspect", "original_sentiment", "corrected_sentiment", F.lit(1).alias("in_b"))
    j = a.join(b, "assertion_id", "full_outer")
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    touched = ~F.col("a_clause_text").eqNullSafe(F.col("b_clause_text"))
    moved = ~F.col("a_clause_start_char").eqNullSafe(F.col("b_clause_start_char")) | ~F.col("a_clause_end_char").eqNullSafe(F.col("b_clause_end_char"))
    changed = ~F.col("original_aspect").eqNullSafe(F.col("corrected_aspect")) | ~F.col("original_sentiment").eqNullSafe(F.col("corrected_sentiment"))
    return j.agg(
        count_if(F.col("in_b").isNull()).alias("lost"), count_if(F.col("in_a").isNull()).alias("added"), count_if(both & touched).alias("text_changed"), count_if(both & moved).alias("offsets_changed"),
        count_if(both & changed & (F.col("action") == "unchanged")).alias("unlogged"),
    )


def suspects(assertions: DataFrame, keywords: list[str]) -> DataFrame:
    """(assertion_id, n, hits): no-opinion clauses that hold opinion words, with the words."""
    low = F.lower(F.coalesce(F.col("clause_text"), F.lit("")))
    found = F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: low.contains(k))
    rows = assertions.filter(F.col("annotation_status") == NO_OPINION).withColumn("hits", found).filter(F.size("hits") > 0)
    return rows.select("assertion_id", F.size("hits").alias("n"), F.concat_ws("|", "hits").alias("hits"))


def classify_suspects(assertions: DataFrame, evaluative: str, indicators: dict[str, str], general: str, borderline: str, boilerplate: str | None = None) -> DataFrame:
    """(assertion_id, class, aspect): what no-opinion clauses are, by patterns without case.

    A: an evaluating word beside one of an aspect (the first of ``indicators``); B: beside one of the place as a whole;
    D: an evaluating word with a borderline one; C: anything else, and boilerplate without an evaluating word.
    """
    low = F.lower(F.coalesce(F.col("clause_text"), F.lit("")))
    made = lambda c, a: F.struct(F.lit(c).alias("class"), F.lit(a).cast("string").alias("aspect"))
    found = F.when(~low.rlike(evaluative), made("C", None))
    if boilerplate:
        found = F.when(low.rlike(boilerplate) & ~low.rlike(evaluative), made("C", None)).when(~low.rlike(evaluative), made("C", None))
    for aspect, pattern in indicators.items():
        found = found.when(low.rlike(pattern), made("A", aspect))
    found = found.when(low.rlike(general), made("B", "General Experience")).when(low.rlike(borderline), made("D", None)).otherwise(made("C", None))
    return assertions.filter(F.col("annotation_status") == NO_OPINION).select("assertion_id", found.alias("f")).select("assertion_id", "f.*")


def review_queue(assertions: DataFrame) -> DataFrame:
    return assertions.filter(F.col("annotation_status") == "Needs Review")


def gate(assertions: DataFrame) -> DataFrame:
    """One row (open, passed): how many rows still need review."""
    return review_queue(assertions).agg(F.count(F.lit(1)).alias("open")).withColumn("passed", F.col("open") == 0)


def resolution_errors(queue: DataFrame, resolutions: DataFrame) -> DataFrame:
    """(assertion_id, rule): queued ids without a resolution, resolutions without a queued id, spans outside their clause.

    A queued row without a clause text has no span inside it.
    """
    queued = queue.select("assertion_id", "clause_text", F.lit(1).alias("q"))
    j = queued.join(resolutions.select("assertion_id", "target_text", F.lit(1).alias("r")), "assertion_id", "full_outer")
    span = F.coalesce(F.col("target_text"), F.lit(""))
    outside = (span != "") & ~F.coalesce(F.col("clause_text").contains(span), F.lit(False))
    rule = F.when(F.col("r").isNull(), "unresolved").when(F.col("q").isNull(), "not queued").when(outside, "span outside")
    return j.select("assertion_id", rule.alias("rule")).filter("rule IS NOT NULL")


def apply_overrides(rows: DataFrame, overrides: DataFrame, key: str, column: str, note: str = "change_note") -> DataFrame:
    """Sets ``column`` to ``new`` where the row still has ``expected`` (null: any), and adds a note; every row stays one row.

    Of several overrides of a key the one that expects the row's value is taken, before one that expects any, and of equal
    ones the least ``new``.
    """
    once = overrides.groupBy(F.col(key), F.col("expected").alias("_expected")).agg(F.min(F.struct("new")).alias("_found"))
    exact = once.filter("_expected is not null").select(key, "_expected", F.col("_found").alias("_exact"))
    any_value = once.filter("_expected is null").select(key, F.col("_found").alias("_any"))
    j = rows.withColumn("_expected", F.col(column)).join(exact, [key, "_expected"], "left").join(any_value, key, "left").withColumn("_new", F.coalesce("_exact", "_any"))
    hit = F.col("_new").isNotNull()
    said = F.concat(F.lit(f"{column}: "), F.coalesce(F.col(column), F.lit("null")), F.lit(" -> "), F.coalesce("_new.new", F.lit("null")))
    old = F.col(note) if note in rows.columns else F.lit(None).cast("string")
    out = j.withColumn(note, F.when(hit, F.concat_ws(" | ", old, said)).otherwise(old)).withColumn(column, F.when(hit, F.col("_new.new")).otherwise(F.col(column)))
    return out.select(*rows.columns, *([] if note in rows.columns else [note]))


def alignment_audit(left: DataFrame, right: DataFrame, keys: list[str], text: str = "clause_text") -> DataFrame:
    """One row: keys in both, on one side only, and in both with different trimmed texts."""
    a, b = left.select(*keys, F.col(text).alias("ta"), F.lit(1).alias("a")), right.select(*keys, F.col(text).alias("tb"), F.lit(1).alias("b"))
    j = a.join(b, keys, "full_outer")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return j.agg(count_if(both).alias("matched"), count_if(F.col("b").isNull()).alias("only_left"), count_if(F.col("a").isNull()).alias("only_right"), count_if(both & ~F.trim("ta").eqNullSafe(F.trim("tb"))).alias("text_mismatch"))


def key_differences(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, problem): keys that are missing from, or unexpected in, ``actual``."""
    missing = expected.select(key).distinct().join(actual, key, "left_anti").withColumn("problem", F.lit("missing"))
    return missing.unionByName(actual.select(key).distinct().join(expected, key, "left_anti").withColumn("problem", F.lit("unexpected")))


def change_classes(sets: DataFrame) -> DataFrame:
    """(change, n): how the label sets of clauses moved from the reference to the prediction."""
    r, p = F.array_sort(F.array_distinct("reference")), F.array_sort(F.array_distinct("predicted"))
    change = F.when(r == p, "identical").when(F.size(r) == 0, "none to some").when(F.size(p) == 0, "some to none").otherwise("reassigned")
    return sets.groupBy(change.alias("change")).agg(F.count(F.lit(1)).alias("n"))


def label_changes(sets: DataFrame) -> DataFrame:
    """(aspect, kept, added, removed) between the reference and predicted label sets."""
    tag = lambda c, x: F.transform(c, lambda v: F.struct(v.alias("aspect"), F.lit(x).alias("change")))
    moves = F.concat(tag(F.array_intersect("reference", "predicted"), "kept"), tag(F.array_except("predicted", "reference"), "added"), tag(F.array_except("reference", "predicted"), "removed"))
    rows = sets.select(F.explode(moves).alias("m")).select("m.*")
    return rows.groupBy("aspect").agg(*[count_if(F.col("change") == x).alias(x) for x in ("kept", "added", "removed")])


def distribution_delta(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """(value, before, after, delta) counts of a column."""
    a, b = (d.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias(n)) for d, n in ((before, "na"), (after, "nb")))
    x, y = F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0))
    return a.join(b, a["value"].eqNullSafe(b["value"]), "full_outer").select(F.coalesce(a["value"], b["value"]).alias("value"), x.alias("before"), y.alias("after"), (y - x).alias("delta"))


def project_labels(sets: DataFrame, originals: DataFrame) -> DataFrame:
    """(clause_id, assertion_id, aspect, annotation_status, theme, sentiment, inherited): one row for each predicted label of a clause.

    Other columns come from the clause's row of the same aspect, else from its first one; a clause without labels has one
    row without an aspect. Ids are numbered anew, in the order of the labels. ``originals`` has clause_id, aspect, ord and
    the columns to inherit (theme, sentiment).
    """
    wanted = sets.select("clause_id", F.posexplode_outer("predicted").alias("i", "aspect"))
    data = F.struct("theme", "sentiment")
    same = originals.groupBy("clause_id", "aspect").agg(F.min_by(data, "ord").alias("same"))
    first = originals.groupBy("clause_id").agg(F.min_by(data, "ord").alias("first"))
    rows = wanted.join(same, ["clause_id", "aspect"], "left").join(first, "clause_id", "left")
    status = F.when(F.col("aspect").isNull(), NO_OPINION).otherwise("Annotated")
    named = assertion_id(F.col("clause_id"), F.coalesce("i", F.lit(0)) + 1)
    return rows.select(
        "clause_id", named.alias("assertion_id"), "aspect", status.alias("annotation_status"), F.coalesce("same", "first").alias("d"), F.col("same").isNull().alias("inherited")
    ).select("clause_id", "assertion_id", "aspect", "annotation_status", "d.*", "inherited")


def with_predictions(annotations: DataFrame, predictions: DataFrame, key: str = "clause_id", labels: str = "predicted") -> DataFrame:
    """The annotations, one for each clause (the first by ``ord``), each beside every label predicted for it; none gives one row without a label."""
    first = annotations.groupBy(key).agg(F.min_by(F.struct(*[c for c in annotations.columns if c != key]), "ord").alias("a"))
    return first.join(predictions.select(key, labels), key, "left").select(key, "a.*", F.explode_outer(labels).alias("predicted_label"))
