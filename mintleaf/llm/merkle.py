"""Merkle manifest of a table: a tree of hashes for each group of rows, and one over the groups; SQL functions only.

Every row is a leaf, the hash of its fields. A node is the hash of the hex digests of ``ARITY`` consecutive nodes below
it (the last run of a level may be shorter). Leaves get their places in the order of the group (``with_row_index``), and
each aligned block of ``BLOCK`` = 8^3 leaves becomes one row that keeps a level of its subtree as one hex string: fixed
width substrings of 512 digits are the runs whose hashes make the next level, and the digits of a run before and after a
node are its siblings. The digest left of a block is a leaf of the next stage, so a stage has 1/512 of the rows of the one
below; stages repeat until each group has one node, its subroot, and again over the subroots until the root. Paths then
come down stage by stage: a block hands its own path to its members behind their siblings inside the block. Hot groups are
many blocks; no task holds more than a block and a path.

Rows are ordered by id (null first), repeated ids by their leaves; equal rows are leaves of their own. Groups are ordered
bytewise, null first. A lone leaf is its group's subroot, and a lone subroot the root; then there are no siblings, and the
proof is the hash of the empty string. An empty table has no rows and no root. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mintleaf.llm.common import with_row_index, written

#: Nodes of a run, and hex digits of a digest.
ARITY, DIGITS = 8, 64
#: Levels that a stage folds, and the nodes of a block.
LEVELS = 3
BLOCK = ARITY**LEVELS
_PATH = "array<struct<left: string, right: string>>"


def field(value: Column) -> Column:
    """A field of a leaf: ``-`` if null, else its UTF-8 bytes' number, a colon, and the value (integers decimal)."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def group_key(group: Column) -> Column:
    """A string that is never null and has the order of groups: null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("+"), group), F.lit(""))


# --- strings of a block --------------------------------------------------------


def _size(level: Column) -> Column:
    return (F.length(level) / DIGITS).cast("int")


def _run(level: Column, k: Column) -> Column:
    return F.substring(level, k * ARITY * DIGITS + 1, F.lit(ARITY * DIGITS))


def _parents(level: Column) -> Column:
    """The level above: hashes of the runs of a level's string."""
    runs = F.sequence(F.lit(0), F.ceil(_size(level) / ARITY).cast("int") - 1)
    return F.array_join(F.transform(runs, lambda k: F.sha2(_run(level, k), 256)), "")


def _blocks(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """Nodes (tree, place, size of the tree's level, digest) as rows of blocks, with the strings level0 to level3 that are there.

    A tree of one block has as many levels as it needs; in a larger tree each block is folded by all of them.
    """
    found = (
        nodes.groupBy("tree", F.expr(f"place div {BLOCK}").alias("block"))
        .agg(F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("place", "digest", *carried))).alias("members"))
        .select("tree", "block", "size", *[F.col(f"members.{c}").alias(c) for c in carried], F.array_join("members.digest", "").alias("level0"))
    )
    for k in range(LEVELS):
        found = found.withColumn(f"level{k + 1}", F.when(F.col("size") > ARITY**k, _parents(F.col(f"level{k}"))))
    return found


def _tops(blocks: DataFrame) -> DataFrame:
    """What is left of each block, as a node of the next stage."""
    top = F.coalesce(*[F.col(f"level{k}") for k in range(LEVELS, -1, -1)])
    return blocks.select("tree", F.col("block").alias("place"), F.ceil(F.col("size") / BLOCK).alias("size"), top.alias("digest"))


def _siblings(node: Column) -> Column:
    """The digits before and after a node of level0 in its run, and so on for its parents in the block."""
    steps = []
    for k in range(LEVELS):
        at = F.shiftright(node, 3 * k)
        run, own = _run(F.col(f"level{k}"), F.shiftright(at, 3)), at.bitwiseAND(ARITY - 1) * DIGITS
        step = F.struct(F.substring(run, F.lit(1), own).alias("left"), F.substring(run, own + DIGITS + 1, F.lit(ARITY * DIGITS)).alias("right"))
        steps.append(F.when(F.col(f"level{k + 1}").isNotNull(), step))
    return F.array_compact(F.array(*steps)).cast(_PATH)


def _members(blocks: DataFrame, paths: DataFrame, columns: list[Column]) -> DataFrame:
    """A row for each node of level0 with its whole path; ``paths``: those of the blocks."""
    joined = blocks.join(paths.select("tree", F.col("place").alias("block"), "path", "subroot", "root"), ["tree", "block"])
    rows = joined.select("*", F.explode(F.sequence(F.lit(0), _size(F.col("level0")) - 1)).alias("node"))
    return rows.select("tree", *columns, F.concat(_siblings(F.col("node")), F.col("path")).alias("path"), "subroot", "root")


# --- trees ---------------------------------------------------------------------


def _stages(nodes: DataFrame, carried: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """The written blocks of each stage, and the last nodes: one for each tree."""
    stages = [written(_blocks(nodes, carried), "merkle0")]
    nodes = _tops(stages[0])
    while nodes.filter("size > 1").limit(1).count():
        stages.append(written(_blocks(nodes, []), f"merkle{len(stages)}"))
        nodes = _tops(stages[-1])
    return stages, nodes


def _paths(stages: list[DataFrame], tops: DataFrame) -> DataFrame:
    """From the paths of the trees down to those of the nodes that the first stage's blocks hold."""
    for blocks in reversed(stages):
        tops = _members(blocks, tops, [(F.col("block") * BLOCK + F.col("node")).alias("place")])
    return tops


def manifest(rows: DataFrame, carried: list[str]) -> DataFrame:
    """Paths of rows (tree, id, digest, and ``carried`` columns): tree, id, digest, carried, path, subroot, root.

    ``path`` has the digests before and after a node in its run, from the leaf through the subroot to the root.
    """
    rows = with_row_index(rows, ["tree", "id", "digest"], "index")
    starts = written(rows.groupBy("tree").agg(F.min("index").alias("start"), F.count(F.lit(1)).alias("size")), "trees")
    nodes = rows.join(starts, "tree").withColumn("place", F.col("index") - F.col("start")).drop("index", "start")
    stages, subroots = _stages(nodes, ["id", *carried])
    # the subroots are the leaves of one more tree
    subroots = with_row_index(subroots.select("tree", F.col("digest").alias("subroot")), ["tree"], "place")
    of_groups = subroots.select(F.lit("").alias("tree"), "place", F.lit(subroots.count()).cast("long").alias("size"), F.col("subroot").alias("digest"))
    upper, root = _stages(of_groups, [])
    root = root.select("tree", "place", F.array().cast(_PATH).alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    of_groups = _paths(upper, root).select("place", "path", "root").join(subroots, "place")
    paths = of_groups.select("tree", F.lit(0).cast("long").alias("place"), "path", "subroot", "root")
    for blocks in reversed(stages[1:]):
        paths = _paths([blocks], paths)
    pick = [F.get(c, F.col("node")).alias(c) for c in ["id", *carried]]
    return _members(stages[0], paths, [*pick, F.substring("level0", F.col("node") * DIGITS + 1, F.lit(DIGITS)).alias("digest")])


def proof(path: Column) -> Column:
    """Hash of all siblings of a path."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, digest, lambda below, s: F.sha2(F.concat(s["left"], below, s["right"]), 256))


def verify(docs: DataFrame, tampered: dict[str, Column], id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")) -> DataFrame:
    """One row per document: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``folded_root`` comes from the document with the columns ``tampered`` and the siblings of the document as it was.
    """
    now = leaf([tampered.get(c, F.col(c)) for c in fields])
    rows = docs.select(group_key(F.col(group_col)).alias("tree"), F.col(id_col).alias("id"), leaf([F.col(c) for c in fields]).alias("digest"), now.alias("now"))
    return manifest(rows, ["now"]).select(
        "id", F.col("digest").alias("leaf"), "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded(F.col("now"), F.col("path")).alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
