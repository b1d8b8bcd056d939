"""Splits, quotas and samples that depend on hashes only, so they are the same in every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mintleaf.functions.text import hits


def hash_order(*columns: str, seed: int = 42) -> Column:
    """A number that orders rows at random: the md5 of the columns and the seed (the same in other engines)."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns], F.lit(str(seed))))


def dominant_label(rows: DataFrame, group: str, label: str) -> DataFrame:
    """(group, label): the most frequent label; ties go to the one that sorts first."""
    counts = rows.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(group).agg(F.min_by(label, F.struct((-F.col("n")).alias("m"), label)).alias(label))


def group_split(rows: DataFrame, group: str, label: str | None = None, shares=(0.70, 0.15), seed: int = 42) -> DataFrame:
    """(group, split): whole groups into train, validation and test, inside each stratum of the dominant label if given.

    The first floor(n * share) groups of a stratum in hash order are train, the next validation, the rest test. The
    places come from counts of hash prefixes, so no stratum is gathered.
    """
    groups = dominant_label(rows, group, label) if label else rows.select(group).distinct().withColumn("_all", F.lit(1))
    stratum = label or "_all"
    keyed = groups.withColumn("_h", hash_order(group, seed=seed)).withColumn("_cell", F.substring("_h", 1, 3))
    cells = keyed.groupBy(stratum, "_cell").agg(F.count(F.lit(1)).alias("_c"))  # at most 4096 for each stratum
    w = Window.partitionBy(stratum).orderBy("_cell")
    cells = cells.withColumns({"_before": F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_c"), "_n": F.sum("_c").over(Window.partitionBy(stratum))}).drop("_c")
    placed = keyed.join(cells, [stratum, "_cell"]).withColumn("_r", F.col("_before") + F.row_number().over(Window.partitionBy(stratum, "_cell").orderBy("_h", group)))
    train = F.floor(F.col("_n") * shares[0])
    valid = train + F.floor(F.col("_n") * shares[1])
    split = F.when(F.col("_r") <= train, "train").when(F.col("_r") <= valid, "validation").otherwise("test")
    return placed.select(group, *([label] if label else []), split.alias("split"))


def leakage(rows: DataFrame, keys: list[str], split: str = "split") -> DataFrame:
    """(key, n): for each key column, how many of its values occur in more than one split."""
    out = None
    for key in keys:
        one = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(split).alias("a"), F.max(split).alias("b")).agg(F.count(F.when(F.col("a") != F.col("b"), 1)).alias("n"))
        one = one.select(F.lit(key).alias("key"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def split_manifest(rows: DataFrame, group: str, label: str, split: str = "split") -> DataFrame:
    """(split, groups, rows, classes): the make-up of each split; classes maps each label to its rows."""
    sizes = rows.groupBy(split, label).agg(F.count(F.lit(1)).alias("n")).groupBy(split).agg(
        F.sum("n").alias("rows"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(label).cast("string"), "n")))).alias("classes")
    )
    return sizes.join(rows.groupBy(split).agg(F.countDistinct(group).alias("groups")), split).select(split, "groups", "rows", "classes")


def split_ids(rows: DataFrame, group: str, split: str = "split") -> DataFrame:
    """(split, group) in order: the ids of each split, as rows, so that no list of all of them is held in one place."""
    return rows.select(split, group).distinct().orderBy(split, group)


def holdout_mix(rows: DataFrame, benchmark: DataFrame, group: str, train_share: float = 0.70, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The rows with the benchmark's training share added (``from_benchmark``), and the benchmark's holdout.

    Whole groups of the benchmark fall to either side in hash order; training rows of a group in the holdout go.
    """
    parts = group_split(benchmark, group, shares=(train_share, 0.0), seed=seed).withColumnRenamed("split", "_split")
    placed = benchmark.join(parts, group)
    holdout = placed.filter("_split != 'train'").drop("_split")
    train = rows.withColumn("from_benchmark", F.lit(False)).unionByName(placed.filter("_split = 'train'").drop("_split").withColumn("from_benchmark", F.lit(True)), allowMissingColumns=True)
    return train.join(holdout.select(group).distinct(), group, "left_anti"), holdout


def n_per_group(rows: DataFrame, group: list[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """The first n rows of each group in hash order."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(hash_order(key, seed=seed), key))
    return rows.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")


def quota_sample(rows: DataFrame, quotas: DataFrame, cell: list[str], key: str, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Rows up to the quota of their cell in hash order, and a report (cell, quota, available, taken)."""
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy(hash_order(key, seed=seed), key))
    # no cell takes more than the largest quota, which Spark applies before the rows are shuffled
    most = quotas.agg(F.max("quota")).first()[0] or 0
    ranked = rows.withColumn("_r", rank).filter(F.col("_r") <= most)
    taken = ranked.join(F.broadcast(quotas), cell).filter(F.col("_r") <= F.col("quota")).drop("_r", "quota")
    counts = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("available"))
    report = quotas.join(counts, cell, "left").withColumn("available", F.coalesce("available", F.lit(0))).withColumn("taken", F.least("available", "quota"))
    return taken, report


def _flow(rows: dict, columns: dict, cells: dict[tuple, int]) -> dict[tuple, int]:
    """Whole numbers for the cells of a table, up to ``cells``, that add up to as much of both margins as they can."""
    room, taken = {**{("row", r): n for r, n in rows.items()}, **{("col", c): n for c, n in columns.items()}}, dict.fromkeys(cells, 0)
    while True:
        # a shortest way from a row with room to a column with room: forwards over cells that aren't full, back over taken ones
        came, queue, end = {("row", r): None for r in rows if room["row", r] > 0}, [("row", r) for r in rows if room["row", r] > 0], None
        while queue and end is None:
            side, at = queue.pop(0)
            for r, c in cells:
                if side == "row" and r == at and ("col", c) not in came and taken[r, c] < cells[r, c]:
                    came["col", c] = (side, at)
                    queue.append(("col", c))
                    if room["col", c] > 0:
                        end = ("col", c)
                        break
                if side == "col" and c == at and ("row", r) not in came and taken[r, c] > 0:
                    came["row", r] = (side, at)
                    queue.append(("row", r))
        if end is None:
            return taken
        way = [end]
        while came[way[-1]] is not None:
            way.append(came[way[-1]])
        way.reverse()
        steps = [((a[1], b[1]), 1) if a[0] == "row" else ((b[1], a[1]), -1) for a, b in zip(way[:-1], way[1:], strict=True)]
        most = min(room[way[0]], room[end], *(cells[k] - taken[k] if d > 0 else taken[k] for k, d in steps))
        for k, d in steps:
            taken[k] += d * most
        room[way[0]] -= most
        room[end] -= most


def margin_sample(rows: DataFrame, margins: dict[str, dict[str, int]], key: str, once: str | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Rows by quotas on two columns at once, and a report (margin, value, quota, available, taken, met).

    ``margins``: for each of two columns the wanted rows of its values; rows of other values aren't taken. With ``once`` one
    row of each of its values (an establishment) goes in, the first in hash order. The cells of both columns are counted
    (an action; one small row for each cell), and a flow over them gives each cell its number, so that the sample is the
    largest that keeps to both margins; rows of a cell are taken in hash order. A margin that isn't met has too few rows in
    the cells that the other one leaves.
    """
    first, second = margins
    pool = rows.filter(F.col(first).isin(*margins[first]) & F.col(second).isin(*margins[second]))
    if once is not None:
        order = F.struct(hash_order(key, seed=seed).alias("h"), F.col(key).alias("k"))
        pool = pool.groupBy(once).agg(F.min_by(F.struct(*pool.columns), order).alias("_row")).select("_row.*")
    counts = {(r[0], r[1]): r["n"] for r in pool.groupBy(first, second).agg(F.count(F.lit(1)).alias("n")).collect()}
    cells = dict(sorted(counts.items()))
    quotas = _flow(margins[first], margins[second], cells)
    schema = T.StructType([T.StructField(first, T.StringType()), T.StructField(second, T.StringType()), T.StructField("quota", T.IntegerType())])
    taken, _ = quota_sample(pool, rows.sparkSession.createDataFrame([(*k, n) for k, n in quotas.items()], schema), [first, second], key, seed)
    report = []
    for place, column in enumerate((first, second)):
        for value, quota in margins[column].items():
            have, got = (sum(n for k, n in table.items() if k[place] == value) for table in (counts, quotas))
            report.append((column, value, quota, have, got, got == quota))
    return taken, rows.sparkSession.createDataFrame(report, "margin string, value string, quota int, available long, taken long, met boolean")


def balanced_candidates(clauses: DataFrame, per_star: int = 250, most: int = 500, words=(4, 20), seed: int = 42) -> DataFrame:
    """At most ``per_star`` clauses of each star rating and ``most`` in all, of 4 to 20 words, without repeats (any case)."""
    n = F.size(F.split(F.trim("clause_text"), r"\s+"))
    fit = clauses.filter(n.between(*words))
    once = fit.groupBy(F.lower("clause_text").alias("_low")).agg(F.min_by(F.struct(*fit.columns), "clause_id").alias("_first")).select("_first.*")
    return n_per_group(once, ["star_rating"], "clause_id", per_star, seed).orderBy(hash_order("clause_id", seed=seed), "clause_id").limit(most)


#: Words of the heuristic labels; an aspect is the first in this order with a word in the clause.
GOLD_ASPECTS = {
    "Service": ["waiter", "staff", "service", "manager", "slow", "delay", "wait", "rude", "behaviour"],
    "Price": ["price", "expensive", "cost", "worth", "bill", "money", "budget", "cheap", "costly"],
    "Ambience": ["ambience", "atmosphere", "decor", "music", "seating", "clean", "interior", "vibe", "noisy"],
    "Food": ["food", "taste", "biryani", "chicken", "portion", "dish", "spicy", "fresh", "stale", "curry", "delicious"],
}
GOLD_POSITIVE = ["good", "great", "delicious", "tasty", "amazing", "excellent", "fresh", "best", "nice", "polite", "fast", "worth"]
GOLD_NEGATIVE = ["bad", "worst", "horrible", "poor", "slow", "cold", "dirty", "rude", "overpriced", "stale", "disappointing", "not good"]


def gold_labels(clauses: DataFrame, text: str = "clause_text", rating: str = "star_rating", aspects=None, positive=None, negative=None) -> DataFrame:
    """``clauses`` with ``gold_aspect`` and ``gold_sentiment`` by words; a tie of the polarities is settled by the rating."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    aspect = F.lit("General")
    for name, words in reversed(list((aspects or GOLD_ASPECTS).items())):
        aspect = F.when(hits(low, words) > 0, name).otherwise(aspect)
    pos, neg = hits(low, positive or GOLD_POSITIVE), hits(low, negative or GOLD_NEGATIVE)
    stars = F.col(rating)
    by_stars = F.when(stars == 3, "Neutral").when(stars >= 4, "Positive").otherwise("Negative")
    return clauses.withColumns({"gold_aspect": aspect, "gold_sentiment": F.when(pos > neg, "Positive").when(neg > pos, "Negative").otherwise(by_stars)})
