"""Prefix trie of conversations by fixed-length blocks of turns.

1. Each turn becomes a digest of its role and text, and each conversation rows of ``BLOCK`` turns (k, prefix, turns):
   ``prefix`` stands for all turns before the block. It is the exclusive-or, over the earlier blocks, of hashes of (block
   number, block's digests) in two 64-bit lanes, so a conversation of any length gets its prefixes from a running sum over
   rows of ``SEGMENT`` turns. The last row of a conversation has fewer turns than a block, maybe none.
2. Conversations are grouped by (k, prefix, turns). Rows of one (k, prefix) are all members of one node; if they hold the
   same block, the members go on together and the nodes inside the block are the group's.
3. Only where the blocks of a (k, prefix) differ, the turn boundaries inside are refined: each different block gives the
   prefixes of its turns once, with its members counted, and these are grouped.

A node is named by its smallest member and its depth. The nodes that a conversation is the smallest member of are the
lower part of its path, so sums over a subtree are sums over its members: with x(c) = bytes of conversation c less the
bytes of the nodes that it is the smallest member of,
    saved(v) = sum of x over the members of v - x(smallest member) - (members - 1) * bytes of the turns above v,
and the childless nodes of a subtree are counted at their smallest members. No pass goes up the tree.

Groups join one row for each key with many rows (all first blocks have the same prefix): keys with more than 1/``HEAVY`` of
the rows are at most ``HEAVY`` rows and are broadcast, all others shuffle (``join_hot``). The ids of the conversations that
end at a node are sorted by range and packed into strings before they meet in the task that hashes them one by one.

Null roles and texts count as empty. Turns are ordered by ``turn`` (null first), then role, then the text's digest; repeated
rows are turns of their own. Rows without a conversation id are no conversation. An empty table gives an empty result, for
a trie without members has no root. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mintleaf.llm.common import with_row_index, written

#: Turns of a block, and of a row while prefixes are summed up.
BLOCK, SEGMENT = 8, 512
#: Hex digits of a turn's digest.
DIGITS = 64
#: Keys with more than this share of the rows are broadcast.
HEAVY = 1000
#: Ids in a packed string.
PACK = 4096


def turns_of(table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, at, digest, bytes): the turns of each conversation, numbered from 0."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = table.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"),
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"), F.octet_length(text).cast("long").alias("bytes"),
    )
    placed = with_row_index(turns, ["conv_id", "turn", "role", "digest"], "index")
    starts = placed.groupBy("conv_id").agg(F.min("index").alias("start"))
    return placed.join(starts, "conv_id").select("conv_id", (F.col("index") - F.col("start")).alias("at"), "digest", "bytes")


def join_hot(left: DataFrame, right: DataFrame, on: list[str], weight: str, rows: int) -> DataFrame:
    """Inner join of many rows with one row for each key; ``weight`` of ``right``: the rows of ``left`` with that key, of ``rows``."""
    heavy = right.filter(F.col(weight) * HEAVY > rows)
    light = right.filter(F.col(weight) * HEAVY <= rows)
    return left.join(F.broadcast(heavy), on).unionByName(left.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(light, on))


# --- blocks --------------------------------------------------------------------


def _lane(seed: int, *parts: Column) -> Column:
    return F.xxhash64(F.lit(seed), *parts)


def _xor(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def blocks_of(turns: DataFrame) -> DataFrame:
    """(conv_id, k, pa, pb, digests, bytes, before): blocks with their prefixes; every conversation ends with an open one.

    ``turns``: (conv_id, at, digest, bytes), and for each conversation a row with its number of turns as ``at`` and a null
    digest.
    """
    segments = (
        turns.groupBy("conv_id", F.expr(f"at div {SEGMENT}").alias("s"))
        .agg(F.array_sort(F.collect_list(F.struct("at", "digest", "bytes"))).alias("turns"))
        .withColumn("turns", F.filter("turns", lambda t: t["digest"].isNotNull()))
        .select("conv_id", "s", F.array_join("turns.digest", "").alias("digests"), F.col("turns.bytes").alias("bytes"))
    )
    block = lambda i: F.substring("digests", i * BLOCK * DIGITS + 1, F.lit(BLOCK * DIGITS))
    full = F.sequence(F.lit(0), (F.size("bytes") / BLOCK).cast("int"))  # the last number is an open block's, or past the row
    number = lambda i: F.col("s") * (SEGMENT // BLOCK) + i
    lanes = [F.transform(full, lambda i: _lane(1, number(i), block(i))).alias("ha"), F.transform(full, lambda i: _lane(2, number(i), block(i))).alias("hb")]
    segments = written(segments.select("*", *lanes, _total(F.col("bytes")).alias("sum")), "segments")
    # running sums over the light columns of a conversation's segments
    earlier = Window.partitionBy("conv_id").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    whole = lambda c: _xor(F.slice(c, 1, SEGMENT // BLOCK))
    light = segments.select("conv_id", "s", whole("ha").alias("xa"), whole("hb").alias("xb"), "sum")
    starts = light.select("conv_id", "s", *[F.coalesce(f(c).over(earlier), F.lit(0)).alias(o) for f, c, o in ((F.bit_xor, "xa", "sa"), (F.bit_xor, "xb", "sb"), (F.sum, "sum", "start"))])
    count = F.when(F.size("bytes") == SEGMENT, SEGMENT // BLOCK - 1).otherwise((F.size("bytes") / BLOCK).cast("int"))
    rows = segments.join(starts, ["conv_id", "s"]).select("*", F.explode(F.sequence(F.lit(0), count)).alias("i"))
    i = F.col("i")
    return rows.select(
        "conv_id", number(i).alias("k"),
        F.col("sa").bitwiseXOR(_xor(F.slice("ha", F.lit(1), i))).alias("pa"), F.col("sb").bitwiseXOR(_xor(F.slice("hb", F.lit(1), i))).alias("pb"),
        block(i).alias("digests"), F.slice("bytes", i * BLOCK + 1, F.lit(BLOCK)).alias("bytes"),
        (F.col("start") + _total(F.slice("bytes", F.lit(1), i * BLOCK))).alias("before"),
    )


def _key(j: Column) -> Column:
    """The node after j turns of a block: depth and lanes. Where a block is full it is the prefix of the next one."""
    first = F.substring("digests", F.lit(1), j * DIGITS)
    lane = lambda p, seed: F.when(j == 0, F.col(p)).when(j == BLOCK, F.col(p).bitwiseXOR(_lane(seed, F.col("k"), F.col("digests")))).otherwise(_lane(seed + 2, F.col("pa"), F.col("pb"), first))
    return F.struct((F.col("k") * BLOCK + j).alias("depth"), lane("pa", 1).alias("a"), lane("pb", 2).alias("b"))


# --- nodes ---------------------------------------------------------------------


def _inside(groups: DataFrame, columns: list[Column]) -> DataFrame:
    """A row for each turn of each group's block: its node, and ``columns``."""
    j = F.col("j")
    return groups.filter(F.size("bytes") > 0).select("*", F.explode(F.sequence(F.lit(1), F.size("bytes"))).alias("j")).select(_key(j).alias("node"), *columns)


def _refined(groups: DataFrame, columns: list[Column], sums: list[Column]) -> DataFrame:
    """One row per node: as they are where a prefix has one block, grouped by node where its blocks differ."""
    same = _inside(groups.filter("kinds = 1"), columns)
    apart = _inside(groups.filter("kinds > 1"), columns)
    return same.unionByName(apart.groupBy("node").agg(*sums))


def _ends(blocks: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes at which conversations end."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, ids = None, []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"depth": [open_key[0]], "a": [open_key[1]], "b": [open_key[2]], "first": [ids[0]], "ids": [",".join(map(str, ids))]})

        for batch in batches:
            for *key, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and (key != open_key or len(ids) == PACK):
                    yield row()
                    ids = []
                open_key = key
                ids.append(conv)
        if ids:
            yield row()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for key, packs in groupby(rows, lambda r: r[:3]):
            state, comma = hashlib.sha256(), b""
            for *_, ids in packs:
                state.update(comma + ids.encode())
                comma = b","
            yield pa.RecordBatch.from_pydict({"depth": [key[0]], "a": [key[1]], "b": [key[2]], "ends_sha256": [state.hexdigest()]})

    ended = blocks.filter(F.size("bytes") < BLOCK).select(_key(F.size("bytes")).alias("node"), "conv_id").select("node.*", "conv_id")
    packed = ended.repartitionByRange("depth", "a", "b", "conv_id").sortWithinPartitions("depth", "a", "b", "conv_id").mapInArrow(pack, "depth long, a long, b long, first long, ids string")
    hashed = packed.repartition("depth", "a", "b").sortWithinPartitions("depth", "a", "b", "first").mapInArrow(digest, "depth long, a long, b long, ends_sha256 string")
    return hashed.select(F.struct("depth", "a", "b").alias("node"), "ends_sha256")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per node of the trie of ``turns`` (as for ``blocks_of``).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    prefix = ["k", "pa", "pb"]
    blocks = written(blocks_of(turns), "blocks")
    groups = written(blocks.groupBy(*prefix, "digests").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("m"), F.first("bytes").alias("bytes"), F.first("before").alias("before")), "groups")
    members = groups.groupBy(*prefix).agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("all"), F.min("m").alias("least"))
    groups = written(join_hot(groups, members.drop("all", "least"), prefix, "kinds", groups.count()), "kinds")

    j = F.col("j")
    about = [
        _key(j - 1).alias("up"), "n", "m", F.element_at("bytes", j).alias("last"),
        (F.col("before") + _total(F.slice("bytes", F.lit(1), j - 1))).alias("above"),
    ]
    nodes = _refined(groups, about, [F.first("up").alias("up"), F.sum("n").alias("n"), F.min("m").alias("m"), F.first("last").alias("last"), F.first("above").alias("above")])
    at_root = F.struct(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("node")
    no_up = F.lit(None).cast("struct<depth: long, a: long, b: long>").alias("up")
    root = members.filter("k = 0").select(at_root, no_up, F.col("all").alias("n"), F.col("least").alias("m"), F.lit(0).cast("long").alias("last"), F.lit(0).cast("long").alias("above"))
    nodes = written(nodes.unionByName(root), "nodes")
    children = nodes.filter("up is not null").groupBy(F.col("up").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = written(nodes.join(children, "node", "left").fillna(0, ["n_children"]), "nodes")

    # what each conversation adds to the nodes above it
    own = nodes.groupBy(F.col("m").alias("conv_id")).agg(F.sum("last").alias("own"), F.count_if(F.col("n_children") == 0).alias("leaves"))
    totals = blocks.groupBy("conv_id").agg(F.sum(_total(F.col("bytes"))).alias("total"), F.count(F.lit(1)).alias("blocks"))
    shares = totals.join(own, "conv_id", "left").select("conv_id", "blocks", (F.col("total") - F.coalesce("own", F.lit(0))).alias("x"), F.coalesce("leaves", F.lit(0)).alias("leaves"))
    shares = written(shares, "shares")
    least = F.min(F.struct("conv_id", "x"))["x"]
    added = join_hot(blocks.select("conv_id", *prefix, "digests"), shares, ["conv_id"], "blocks", blocks.count())
    added = added.groupBy(*prefix, "digests").agg(F.sum("x").alias("x"), F.sum("leaves").alias("leaves"), least.alias("mx"))
    sums = _refined(groups.join(added, [*prefix, "digests"]), ["m", "x", "leaves", "mx"], [F.min("m").alias("m"), F.sum("x").alias("x"), F.sum("leaves").alias("leaves"), F.min(F.struct("m", "mx"))["mx"].alias("mx")])
    root_sums = shares.groupBy().agg(F.min("conv_id").alias("m"), F.sum("x").alias("x"), F.sum("leaves").alias("leaves"), least.alias("mx"))
    sums = sums.unionByName(root_sums.select(at_root, "m", "x", "leaves", "mx")).drop("m")

    found = nodes.join(sums, "node").join(_ends(blocks), "node", "left")
    found = found.select(
        "up", F.col("m").alias("conv_id"), F.col("node.depth").alias("depth"), F.col("n").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"),
        (F.col("x") - F.col("mx") - (F.col("n") - 1) * F.col("above")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
    parents = nodes.filter("n_children > 0").select(F.col("node").alias("up"), F.col("m").alias("parent_conv_id"), F.col("n_children").alias("weight"))
    found = written(found, "trie")
    rows = join_hot(found.filter("up is not null"), parents, ["up"], "weight", found.count()).drop("weight")
    rows = rows.unionByName(found.filter("up is null").withColumn("parent_conv_id", F.lit(None).cast("long")))
    return rows.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


# --- conversations that share beginnings ----------------------------------------


def with_borrowed_start(turns: DataFrame, group: int, most: int) -> DataFrame:
    """Conversation c begins with the first h turns of conversation c - c % ``group``, and goes on with its own after h.

    h is the unsigned crc32 of the decimal id modulo ``most`` + 1. The result has a last row with a null digest for each
    conversation, as ``blocks_of`` wants.
    """
    h = lambda c: (F.crc32(F.col(c).cast("string").cast("binary")) % (most + 1))
    turns = written(turns, "turns")
    sizes = turns.groupBy("conv_id").agg((F.max("at") + 1).alias("size"))
    lenders = sizes.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("lender"), F.col("size").alias("lent"))
    convs = sizes.withColumn("lender", F.col("conv_id") - F.col("conv_id") % group).join(lenders, "lender", "left")
    convs = written(convs.select("conv_id", "size", h("conv_id").alias("h"), F.least(h("conv_id"), F.coalesce("lent", F.lit(0))).alias("taken")), "borrowers")
    own = join_hot(turns, convs, ["conv_id"], "size", turns.count()).filter("at >= h").select("conv_id", (F.col("taken") + F.col("at") - F.col("h")).alias("at"), "digest", "bytes")
    near = F.transform(F.sequence(F.lit(1 - group), F.lit(group - 1)), lambda d: F.col("conv_id") + d)
    lent = turns.filter((F.col("conv_id") % group == 0) & (F.col("at") < most)).select(F.col("conv_id").alias("lender"), F.explode(near).alias("conv_id"), "at", "digest", "bytes")
    lent = lent.filter((F.col("lender") == F.col("conv_id") - F.col("conv_id") % group) & (F.col("at") < h("conv_id"))).drop("lender")
    lent = lent.join(convs.select("conv_id"), "conv_id", "left_semi")
    last = convs.select("conv_id", (F.col("taken") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("at"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("bytes"))
    return own.unionByName(lent).unionByName(last)
