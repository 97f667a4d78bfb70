"""Conversation prefix trie: block digests first, turns only where siblings diverge.

Every distinct sequence of first d turns (role, text) is a node of depth d; the root is depth 0.
A turn is its 128-bit digest. The key of a prefix is a sum, modulo 2^128 in four parts, of
hashes of (depth, turn), so the keys of a conversation are running sums. They are taken inside
pieces of a globally sorted table, whose totals are added along each conversation: a
conversation of any length is spread over many tasks.

Conversations are grouped by the keys at the ends of blocks of BLOCK turns. Where a block end is
followed by one block only, all conversations that pass it agree up to the next end, and the
nodes between have that block's members. Where it is followed by several, the turns of the
distinct blocks (not of their conversations) are grouped again by the key after each turn.

Sums over subtrees need no walk. The smallest member of a node owns it; what a conversation owns
is the rest of its own path from one depth on. A subtree holds the whole owned path of each
member but its own owner, which counts on from the node. So each owner gives its totals to the
nodes above its path, one row each, and all else are sums of text lengths.

Ids of conversations that end at a node are joined in sorted runs of RUN ids and hashed run by
run as a stream, whatever their number.

Turns are ordered by turn, missing first, and ties by digest; a repeated row is one more turn.
Missing roles and texts are empty. Rows without a conversation id are left out. A conversation
without turns ends at the root. An empty table has no node. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossblock.operators.lookup import sized_lookup
from crossblock.session import cut

#: Turns of a block, and ids of a run.
BLOCK, RUN = 4, 512
_MASK = (1 << 32) - 1
_SUMS = ["s0", "s1", "s2", "s3", "chars"]
_KEY, _PARENT = ["k1", "k2"], ["p1", "p2"]


def placed(df: DataFrame, order: list[Column]) -> DataFrame:
    """A written global sort with the sort partition `part` of each row and its place `_id`."""
    held = cut(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    return held.withColumn("part", F.shiftright("_id", 33))


def ordered(
    rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """A written table (conv, part, pos, digest, chars): pos from 1 in each conversation.

    A conversation may span parts; they follow its order.
    """
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    narrow = rows.where(F.col(conv).isNotNull()).select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        F.md5(F.concat(F.length(by).cast("string"), F.lit(":"), by, said).cast("binary")).alias("digest"),
        F.length(said).cast("long").alias("chars"),
    )
    lines = placed(cut(narrow), [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("digest")])
    # One row per conversation and part.
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = lines.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = pieces.select("conv", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("conv", "part").orderBy("_id")
    counted = lines.join(before, ["conv", "part"])
    pos = F.col("before") + F.row_number().over(inside)
    return cut(counted.select("conv", "part", pos.alias("pos"), "digest", "chars"))


def share_heads(turns: DataFrame, *, base: Column, share: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Give every conversation the first turns of its base in the place of its own.

    base and share (0 to most) are expressions over `conv`. Returns written tables: the turns
    (conv, part, depth, digest, chars) and the conversations (conv), turnless ones included.
    """
    heads = turns.where(F.col("pos") <= most).groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("pos", "digest", "chars"))).alias("head")
    )
    pieces = cut(turns.groupBy("conv", "part").agg(F.count("*").alias("n")))
    convs = pieces.groupBy("conv").agg(F.min("part").alias("first"))
    convs = convs.select("conv", "first", base.alias("base"), share.cast("int").alias("share"))
    given = F.coalesce(F.slice("head", 1, F.col("share")), F.expr("array()"))
    wanted = convs.select("base").where("share > 0").distinct()
    heads = heads.withColumnRenamed("conv", "base").join(wanted, "base", "left_semi")
    convs = cut(convs.join(heads, "base", "left").select("conv", "first", "share", given.alias("head")))
    given_turns = convs.select("conv", F.col("first").alias("part"), F.explode("head").alias("t")).select(
        "conv", "part", F.col("t.pos").alias("depth"), "t.digest", "t.chars"
    )
    shift = pieces.join(convs.select("conv", "share", F.size("head").alias("got")), "conv").drop("n")
    own = turns.join(shift, ["conv", "part"]).where("pos > share")
    own_turns = own.select("conv", "part", (F.col("pos") - F.col("share") + F.col("got")).alias("depth"), "digest", "chars")
    return cut(own_turns.unionByName(given_turns)), convs.select("conv")


def keyed(turns: DataFrame) -> DataFrame:
    """A written table of turns with key, parent's key, characters up to here and in all."""
    high = [F.xxhash64(F.lit(salt), F.col("depth").cast("long"), F.col("digest")) for salt in (1, 2)]
    parts = [h for x in high for h in (x.bitwiseAND(F.lit(_MASK)), F.shiftrightunsigned(x, 32))]
    hashed = turns.select("conv", "part", "depth", *[p.alias(f"s{i}") for i, p in enumerate(parts)], "chars")
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv")
    pieces = hashed.groupBy("conv", "part").agg(*[F.sum(s).alias(s) for s in _SUMS], F.max("depth").alias("last"))
    pieces = pieces.withColumns({s: F.col(s).bitwiseAND(F.lit(_MASK)) for s in _SUMS[:4]})
    before = pieces.select(
        "conv",
        "part",
        *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"b_{s}") for s in _SUMS],
        F.sum("chars").over(whole).alias("all_chars"),
        F.max("last").over(whole).alias("turns"),
    )
    along = Window.partitionBy("conv", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    summed = hashed.join(before, ["conv", "part"]).withColumns(
        {f"a_{s}": F.col(f"b_{s}") + F.sum(s).over(along) for s in _SUMS}
    )

    def word(of, i: int) -> Column:
        low, high = (of(f"s{k}").bitwiseAND(F.lit(_MASK)) for k in (i, i + 1))
        return F.shiftleft(high, 32).bitwiseOR(low)

    def here(s: str) -> Column:
        return F.col(f"a_{s}")

    def above(s: str) -> Column:
        return F.col(f"a_{s}") - F.col(s)

    return cut(
        summed.select(
            "conv",
            "depth",
            word(here, 0).alias("k1"),
            word(here, 2).alias("k2"),
            word(above, 0).alias("p1"),
            word(above, 2).alias("p2"),
            "chars",
            F.col("a_chars").alias("upto"),
            "all_chars",
            (F.col("depth") == F.col("turns")).alias("last"),
        )
    )


def _nodes(paths: DataFrame, convs: DataFrame, block: int) -> DataFrame:
    """A written table of nodes: key, parent's key, depth, members, the smallest, sums of lengths."""
    one = F.struct("depth", *_KEY, *_PARENT, "chars", "upto")
    grouped = paths.groupBy("conv", F.floor((F.col("depth") - 1) / block).alias("block")).agg(
        F.sort_array(F.collect_list(one)).alias("turns"), F.max("all_chars").alias("all_chars")
    )
    ends = [F.element_at("turns", -1)[k].alias(k) for k in _KEY]
    starts = [F.element_at("turns", 1)[k].alias(k) for k in _PARENT]
    blocks = cut(
        grouped.select("*", *ends, *starts)
        .groupBy(*_KEY, *_PARENT)
        .agg(
            F.count("*").alias("n_convs"),
            F.min("conv").alias("conv"),
            F.min_by("turns", "conv").alias("turns"),
            F.sum("all_chars").alias("member_chars"),
        )
    )
    after = cut(blocks.groupBy(*_PARENT).agg(F.count("*").alias("followers")))
    followed = sized_lookup(blocks, after, _PARENT, "followers")
    inner = followed.select("n_convs", "conv", "member_chars", "followers", F.explode("turns").alias("t")).select(
        "t.*", "n_convs", "conv", "member_chars", "followers"
    )
    fixed = [*_PARENT, "depth", "chars", "upto"]
    diverging = (
        inner.where("followers > 1")
        .groupBy(*_KEY)
        .agg(
            *[F.min(c).alias(c) for c in fixed],
            F.sum("n_convs").alias("n_convs"),
            F.min("conv").alias("conv"),
            F.sum("member_chars").alias("member_chars"),
        )
    )
    chains = inner.where("followers = 1").select(*diverging.columns)
    none = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    in_all = paths.where("last").agg(F.sum("all_chars").alias("s"))
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv")).where("n_convs > 0").select(
        zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), zero.alias("depth"), zero.alias("chars"),
        zero.alias("upto"), "n_convs", "conv", F.coalesce(in_all.scalar(), zero).alias("member_chars"),
    )
    return cut(diverging.unionByName(chains).unionByName(root))


def _stream_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined runs of each key; runs come in order, keys one by one."""
    at, state = None, None

    def result(key, held) -> pa.RecordBatch:
        columns = [pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([held.hexdigest()])]
        return pa.RecordBatch.from_arrays(columns, ["k1", "k2", "ends_sha256"])

    for batch in batches:
        for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids")), strict=True):
            if (k1, k2) == at:
                state.update(b",")
            else:
                if at is not None:
                    yield result(at, state)
                at, state = (k1, k2), hashlib.sha256()
            state.update(ids.encode())
    if at is not None:
        yield result(at, state)


def _end_hashes(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) from rows (k1, k2, conv)."""
    lines = placed(ends, [F.col("k1"), F.col("k2"), F.col("conv")])
    inside = Window.partitionBy("part", *_KEY).orderBy("_id")
    runs = lines.withColumn("run", F.floor((F.row_number().over(inside) - 1) / RUN))
    joined = runs.groupBy("part", *_KEY, "run").agg(F.sort_array(F.collect_list("conv")).alias("ids"))
    text = F.array_join(F.transform("ids", lambda c: c.cast("string")), ",")
    sent = joined.select(*_KEY, "part", "run", text.alias("ids")).repartition(*_KEY)
    streamed = sent.sortWithinPartitions(*_KEY, "part", "run").select(*_KEY, "ids")
    return streamed.mapInArrow(_stream_hashes, "k1 long, k2 long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """Nodes of the trie over turns (conv, part, depth, digest, chars) of the conversations (conv).

    depth runs from 1 without gaps; part cuts a conversation into pieces along depth, each of
    bounded size. Returns per node: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256, and its key k1, k2.
    """
    paths = keyed(turns)
    nodes = _nodes(paths, convs, block)
    children = nodes.where("depth > 0").groupBy(*_PARENT).agg(F.count("*").alias("n_children"))
    children = children.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "n_children")
    nodes = cut(nodes.join(children, _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    owners = cut(
        nodes.groupBy("conv").agg(
            F.count("*").alias("owned"),
            F.min("depth").alias("from_depth"),
            F.sum("chars").alias("own_chars"),
            F.max("upto").alias("end_chars"),
            F.sum(leaf).alias("own_leaves"),
        )
    )
    lengths = cut(
        paths.groupBy("conv").agg(F.max("depth").alias("turns")).join(
            owners.select("conv", "from_depth", "own_chars", "own_leaves"), "conv", "left"
        )
    )
    above = sized_lookup(paths.select("conv", "depth", *_KEY), lengths, ["conv"], "turns").where("depth < from_depth")
    below = above.groupBy(*_KEY).agg(F.sum("own_chars").alias("below_chars"), F.sum("own_leaves").alias("below_leaves"))
    # The root is above every owned path but its own.
    zero = F.lit(0).cast("long")
    own_root = F.col("from_depth") > 0
    of_root = owners.agg(
        F.sum(F.when(own_root, F.col("own_chars"))).alias("below_chars"),
        F.sum(F.when(own_root, F.col("own_leaves"))).alias("below_leaves"),
    ).select(zero.alias("k1"), zero.alias("k2"), "below_chars", "below_leaves")
    owned = sized_lookup(nodes, owners.select("conv", "owned", "end_chars", "own_leaves"), ["conv"], "owned")
    parents = nodes.where("n_children > 0").select(
        F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent_conv_id"), F.col("n_children").alias("size")
    )
    placed_nodes = sized_lookup(owned, cut(parents), _PARENT, "size")
    turnless = convs.join(paths.where("last").select("conv"), "conv", "left_anti").select(zero.alias("k1"), zero.alias("k2"), "conv")
    ends = _end_hashes(paths.where("last").select(*_KEY, "conv").unionByName(turnless))
    rest = F.col("upto") - F.col("chars")
    distinct_chars = F.coalesce("below_chars", zero) + F.col("end_chars") - rest
    return (
        placed_nodes.join(below.unionByName(of_root), _KEY, "left")
        .join(ends, _KEY, "left")
        .select(
            F.col("conv").alias("conv_id"),
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            (F.coalesce("below_leaves", zero) + F.col("own_leaves")).alias("n_leaves"),
            (F.col("member_chars") - F.col("n_convs") * rest - distinct_chars).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
            *_KEY,
        )
    )
