"""Temperature mixing of sources: an exponent on their token shares, realised as budgeted block permutations.

1. Shares p of the sources come from counting all their tokens (words, without a tokenizer). A weight is p^a / sum p^a.
   The exponent a between 0 (even) and 1 (as they are) is bisected, many probes to a pass over the table of sources,
   until it meets a target entropy of the weights, or is the least that keeps the repetition of any source in a limit.
2. The budget of a source is its weight of all tokens of the mix. By default the mix is the smallest that holds each
   document at least once, so nothing is lost: the largest source is read once, small ones up to the limit.
3. A source's documents fall into blocks of about ``block_tokens`` by hash. Every pass over a source permutes its
   blocks anew (by hash of seed, pass and block). Full passes take all blocks; the last, partial pass takes blocks in
   its order while they fit the rest of the budget, and of the next block the documents that still fit.

A row of the mix has its pass, its block and a position from 0 to 1; read in the order of positions, the mix follows
the weights throughout. No step holds a source together, nor all of its block sizes: they are added up in two levels.

A null source is a source of its own. Documents without tokens (null or empty text) weigh nothing and are taken once.
Equal rows are each taken. An empty table gives an empty mix. All columns of the documents stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from mintleaf.llm.common import fresh, written

BLOCK_TOKENS = 1 << 16
#: A pass over a source is added up in 2^CELL_BITS cells.
CELL_BITS = 12
_PROBES = 16


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _probe(shares: DataFrame, exponents: list[float], scale: float | None) -> list[tuple[float, float]]:
    """(entropy, largest repetition) for each exponent; ``scale``: tokens of the mix over tokens there are, if given."""
    p = F.col("p")
    got = shares.agg(*[
        F.struct(F.sum(F.pow(p, F.lit(a))).alias("s"), F.sum(F.pow(p, F.lit(a)) * F.log(p)).alias("l"), F.max(F.pow(p, F.lit(a - 1))).alias("most"), F.min(F.pow(p, F.lit(a - 1))).alias("least")).alias(f"a{k}")
        for k, a in enumerate(exponents)
    ]).first()
    return [(math.log(x["s"]) - a * x["l"] / x["s"], x["most"] / x["least"] if scale is None else x["most"] / x["s"] * scale) for a, x in zip(exponents, got, strict=True)]


def find_exponent(shares: DataFrame, target_entropy: float | None = None, repetition_limit: float | None = None, scale: float | None = None, tolerance: float = 1e-9) -> float:
    """The exponent for a table with the token share p of each source (positive, of sum 1)."""
    if (target_entropy is None) == (repetition_limit is None):
        raise ValueError("give a target entropy or a repetition limit")
    low, high = 0.0, 1.0
    while high - low > tolerance:
        grid = [low + (high - low) * k / _PROBES for k in range(_PROBES + 1)]
        found = _probe(shares, grid, scale)
        # both fall as the exponent grows: is the wanted one at or below the probe?
        under = [e <= target_entropy if target_entropy is not None else r <= repetition_limit for e, r in found]
        if under[0]:
            return low
        if not any(under):
            return high
        k = under.index(True)
        low, high = grid[k - 1], grid[k]
    return high


_fields = lambda **kinds: [StructField(n, t) for n, t in kinds.items()]
_WEIGHTS = _fields(n=LongType(), weight=DoubleType(), repetition=DoubleType(), blocks=LongType())
_PASSES = _fields(block=LongType(), size=LongType(), before=LongType(), upto=LongType()) + [StructField("pass", IntegerType())]


def _two_level(passes: DataFrame) -> DataFrame:
    """``passes`` with ``before``: the tokens of the blocks before it in its pass, whose blocks no task has all.

    The order of a pass is cut into cells by its upper bits; the few cells are summed up, then the blocks within a cell.
    """
    passes = passes.withColumn("cell", F.shiftright("order", 64 - CELL_BITS))
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")) & (F.col(f"{a}.pass") == F.col(f"{b}.pass")) & (F.col(f"{a}.cell") == F.col(f"{b}.cell"))
    earlier = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = passes.groupBy("source", "pass", "cell").agg(F.sum("size").alias("size"))
    cells = cells.select("source", "pass", "cell", earlier(Window.partitionBy("source", "pass").orderBy("cell")).alias("base"))
    inside = passes.withColumn("inside", earlier(Window.partitionBy("source", "pass", "cell").orderBy("order", "block")))
    return inside.alias("p").join(cells.alias("c"), same("p", "c")).select("p.source", "block", "p.pass", "size", (F.col("base") + F.col("inside")).alias("before"))


def mix_plan(keyed: DataFrame, target_entropy: float | None = None, repetition_limit: float | None = None, budget_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 0) -> tuple[DataFrame, DataFrame] | None:
    """The plan for (uid, source, tokens): the sources with their weights, and the blocks with the passes that take them.

    Sources: source, n, weight, repetition, blocks, full (passes), rest (tokens of the partial pass). Passes: source,
    block, pass, before, size, upto (rows up to this hash are taken; null: the whole block). None without tokens.
    """
    sources = written(keyed.groupBy("source").agg(F.sum("tokens").alias("n")).filter("n > 0"), "sources")
    total = sources.agg(F.sum("n")).first()[0]
    if not total:
        return None
    shares = sources.withColumn("p", F.col("n") / total)
    scale = None if budget_tokens is None else budget_tokens / total
    a = find_exponent(shares, target_entropy, repetition_limit, scale)
    sums = shares.agg(F.sum(F.pow("p", F.lit(a))).alias("s"), F.min(F.pow("p", F.lit(a - 1))).alias("least")).first()
    # the repetition of a source: its share of the mix over its own tokens
    factor = 1 / sums["least"] if scale is None else scale / sums["s"]
    plan = shares.select(
        "source", "n", (F.pow("p", F.lit(a)) / sums["s"]).alias("weight"), F.greatest(F.pow("p", F.lit(a - 1)) * factor, F.lit(1.0 if scale is None else 0.0)).alias("repetition"),
        F.greatest(F.ceil(F.col("n") / block_tokens), F.lit(1)).alias("blocks"),
    )
    plan = written(plan.withColumn("full", F.floor(F.col("repetition") + 1e-9).cast("int")).withColumn("rest", F.floor((F.col("repetition") - F.col("full")) * F.col("n") + 1e-6)), "weights")
    placed = keyed.filter("tokens > 0").alias("k").join(plan.alias("w"), F.col("k.source").eqNullSafe(F.col("w.source")))
    placed = placed.select("w.source", "tokens", *_place(F.col("uid"), F.col("blocks"), seed), "full", "rest")
    sizes = placed.groupBy("source", "block").agg(F.sum("tokens").alias("size"), F.first("full").alias("full"))
    passes = sizes.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("full")))).withColumn("order", F.xxhash64("block", "pass", F.lit(seed)))
    passes = _two_level(passes).alias("b").join(plan.select("source", "full", "rest").alias("w"), F.col("b.source").eqNullSafe(F.col("w.source")))
    partial = F.col("pass") == F.col("full")
    passes = passes.filter(~partial | (F.col("before") < F.col("rest"))).select(
        "b.source", "block", "pass", "before", "size", F.when(partial & (F.col("before") + F.col("size") > F.col("rest")), F.col("rest") - F.col("before")).alias("room")
    )
    passes = written(passes, "passes")
    # one block of a source at most is cut by its budget: how far in the order of its rows do they fit?
    cut = passes.filter("room is not null")
    rows = placed.select("source", "block", "tokens", "h").alias("d").join(cut.select("source", "block", "room").alias("b"), F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.block") == F.col("b.block")))
    fits = rows.select("d.source", "d.block", "h", "room", F.sum("tokens").over(Window.partitionBy("d.source", "d.block").orderBy("h").rangeBetween(Window.unboundedPreceding, Window.currentRow)).alias("sum"))
    last = fits.filter("sum <= room").groupBy("source", "block").agg(F.max("h").alias("last"))
    named = passes.alias("b").join(last.alias("l"), F.col("b.source").eqNullSafe(F.col("l.source")) & (F.col("b.block") == F.col("l.block")), "left")
    upto = F.when(F.col("room").isNotNull(), F.coalesce("last", F.lit(-(1 << 63))))
    return plan, written(named.select("b.source", "b.block", "pass", "before", "size", upto.alias("upto")), "plan")


def _place(uid: Column, blocks: Column, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(uid, F.lit(seed)), blocks).alias("block"), F.xxhash64(uid, F.lit(seed + 1)).alias("h")]


def mix(docs: DataFrame, source_col: str = "source", text_col: str = "text", plan_columns: bool = False, tokens: Column | None = None, seed: int = 0, **plan) -> DataFrame:
    """``docs`` as mixed: rows in every pass that takes them. With ``plan_columns`` a struct column ``mix`` tells how.

    ``tokens`` counts those of a row; words by default. Where a row goes is decided by the hash of its columns alone, so
    it doesn't matter how ``docs`` is split when it is read again; rows that are equal in all columns stay together.
    """
    uid, own, count, source, at, order = (fresh(docs, c) for c in ("_mix_uid", "_mix", "_mix_tokens", "_mix_source", "_mix_block", "_mix_h"))
    if plan_columns:
        docs, own = docs.drop("mix"), "mix"
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and t != "variant"])
    keyed = docs.withColumns({uid: hashed, count: count_words(F.col(text_col)) if tokens is None else tokens})
    narrow = written(keyed.select(F.col(uid).alias("uid"), F.col(source_col).alias("source"), F.col(count).alias("tokens")), "tokens")
    found = mix_plan(narrow, seed=seed, **plan)
    if found is None:
        weights = narrow.sparkSession.createDataFrame([], StructType([narrow.schema["source"], *_WEIGHTS]))
        passes = narrow.sparkSession.createDataFrame([], StructType([narrow.schema["source"], *_PASSES]))
    else:
        weights, passes = found
    # rows without tokens meet nothing and stay, so the texts are read in one pass
    placed = keyed.withColumn(source, F.col(source_col)).alias("d").join(weights.alias("w"), F.col(f"d.{source}").eqNullSafe(F.col("w.source")) & (F.col(f"d.{count}") > 0), "left")
    placed = placed.select("d.*", F.struct("w.n", "w.weight", "w.repetition").alias(own), *[c.alias(n) for n, c in zip((at, order), _place(F.col(uid), F.col("w.blocks"), seed), strict=True)])
    block, h, some = F.col(f"d.{at}"), F.col(f"d.{order}"), F.col(f"d.{count}") > 0
    rows = placed.alias("d").join(passes.alias("b"), some & F.col(f"d.{source}").eqNullSafe(F.col("b.source")) & (block == F.col("b.block")) & (F.col("b.upto").isNull() | (h <= F.col("b.upto"))), "left")
    w = lambda c: F.col(f"d.{own}.{c}")
    position = (F.col("b.pass") + (F.col("b.before") + F.col("b.size") * (F.pmod(h, F.lit(1 << 20)) / float(1 << 20))) / w("n")) / w("repetition")
    how = F.struct(
        F.col(f"d.{count}").alias("tokens"), F.coalesce(w("weight"), F.lit(0.0)).alias("weight"), F.coalesce(w("repetition"), F.lit(1.0)).alias("repetition"), F.coalesce("b.pass", F.lit(0)).alias("pass"),
        F.coalesce("b.block", F.lit(0)).alias("block"), F.coalesce(F.least(position, F.lit(1.0)), F.lit(0.0)).alias("position"),
    )
    mixed = rows.filter(~some | F.col("b.pass").isNotNull()).select(*[F.col(f"d.`{c}`") for c in docs.columns], how.alias(own))
    return mixed if plan_columns else mixed.drop(own)
