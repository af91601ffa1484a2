"""The prefix trie of conversations: a node for every distinct sequence of first turns.

A turn is a pair of 64-bit hashes of its role and text; a prefix is the sum, per half of 64 bits, of hashes of
its turns with their places. Texts are read once and never shuffled after the turns are in order.

A count-min sketch of all prefixes screens them: two rows of cells, at least ``CELLS_PER_PREFIX`` times as many
as prefixes each; the cells that were met twice or more are a bitmap, which is broadcast (at most
2 x 2^``MAX_CELL_BITS`` bits). A prefix with a cell that was met once belongs to one conversation: it is a node of
one member, and what follows it is a chain of such nodes, all emitted where they are. Only the other prefixes
are grouped exactly. Beyond 2^``MAX_CELL_BITS`` / ``CELLS_PER_PREFIX`` prefixes the sketch proves fewer of them
single; more are grouped, to the same result.

A node's name is (smallest member, depth). The nodes that one conversation names are a piece of its own path,
so the trie is a tree of such pieces. Sums over subtrees are sums along a piece plus what whole pieces add where
they hang: each conversation sends the totals of its piece once to every piece it passes through, summed by place
before they are shuffled. No task ever holds a subtree, a node's members, or the children of a node.

Rows are put in order by ``operators.ordered``, which splits hot conversations. Nodes with more than a 256th of
all prefixes (at most 256) are joined by broadcast, the others by key.

Defined results: a null role or text is an empty one; turns are ordered by (turn, role, text), nulls first, so
that ties and repeated rows have one order; rows without a conv_id belong to no conversation and are left out;
an empty table gives an empty table; other columns are not read. Prefixes are told apart by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolake.operators.ordered import Ordered
from aerolake.session import cut

CELLS_PER_PREFIX = 8
MIN_CELL_BITS, MAX_CELL_BITS = 15, 28
#: A node that more than this share of the grouped prefixes pass is joined by broadcast.
HOT_SHARE = 256

EMPTY = hashlib.sha256(b"").hexdigest()
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def turn_hashes(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, a, b, chars): turns in order, numbered from 1, with two hashes and the text's code points."""
    given = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = Ordered(given, ["conv_id"], ["turn", "role", "text"]).add(position="pos")
    return placed.select("conv_id", "pos", *[F.xxhash64(F.lit(i), F.length("role"), "role", "text").alias(n) for i, n in enumerate("ab")],
                         F.length("text").cast("bigint").alias("chars"))


def _halves(depth: Column) -> dict[str, Column]:
    """Four hashes of 32 bits of a turn at its place: their sums tell prefixes apart, in any order of adding."""
    made = {}
    for i in range(2):
        whole = F.xxhash64(F.lit(i), depth, F.col("a"), F.col("b"))
        made[f"s{2 * i}"], made[f"s{2 * i + 1}"] = whole.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(whole, 32)
    return made


def prefix_keys(turns: DataFrame, order: list[str]) -> DataFrame:
    """(conv_id, depth, k1, k2, chars, more): the prefixes of every conversation; ``more``: another turn follows."""
    numbered = Ordered(turns, ["conv_id"], order).add(position="depth")
    sums = Ordered(numbered, ["conv_id"], order).add(running={n: ("sum", e) for n, e in _halves(F.col("depth")).items()}, next={"after": F.lit(1)})
    keys = [F.xxhash64(F.lit(i), *[F.col(f"s{j}") for j in range(4)]).alias(f"k{i}") for i in (1, 2)]
    return sums.select("conv_id", "depth", *keys, "chars", F.col("after").isNotNull().alias("more"))


def _cells(bits: int) -> list[Column]:
    """A cell in each row of the sketch, as numbers of one range."""
    return [F.col(k).bitwiseAND(F.lit((1 << bits) - 1)) + F.lit(i << bits) for i, k in enumerate(("k1", "k2"))]


def _sketch(prefixes: DataFrame, bits: int) -> np.ndarray:
    """The cells that were met twice or more, as a bitmap (lowest bit first)."""
    met = prefixes.select(F.explode(F.array(*_cells(bits))).alias("cell")).groupBy("cell").count().where("count > 1")
    blocks = met.groupBy(F.bitmap_bucket_number("cell").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))
    bitmap = np.zeros(2 << max(bits - 3, 0), np.uint8)
    for row in blocks.toLocalIterator():
        # Buckets hold 32,768 positions each: the first one ends with 32,768 itself, as numbers from 1 do; zero is in bucket 0.
        part = np.frombuffer(row.bits, np.uint8)
        at = (row.block - 1) * len(part)
        if at < 0:
            bitmap[0] |= part[0] & 1
        else:
            marks = np.unpackbits(part, bitorder="little")
            numbers = np.flatnonzero(marks) + at * 8 + 1
            np.bitwise_or.at(bitmap, numbers >> 3, (1 << (numbers & 7)).astype(np.uint8))
    return bitmap


def _screened(prefixes: DataFrame, total: int) -> DataFrame:
    """Adds ``maybe``: the prefix may be shared, by the estimate of the sketch."""
    bits = min(max(int(total * CELLS_PER_PREFIX).bit_length(), MIN_CELL_BITS), MAX_CELL_BITS)
    sketch = prefixes.sparkSession.sparkContext.broadcast(_sketch(prefixes, bits))
    cell = np.int64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = sketch.value
        for batch in batches:
            maybe = np.ones(batch.num_rows, bool)
            for i, name in enumerate(("k1", "k2")):
                at = (np.asarray(batch.column(batch.schema.get_field_index(name))) & cell) + (i << bits)
                maybe &= (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(maybe)], names=[*batch.schema.names, "maybe"])

    return prefixes.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prefixes.schema.fields) + ", maybe boolean")


def _digests(ends: DataFrame) -> DataFrame:
    """(rep, depth, ends_sha256): the digest of the conv_ids of each node, which stream by in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            done = []
            columns = [np.asarray(batch.column(i)) for i in range(3)]
            fresh = np.flatnonzero((np.diff(columns[0], prepend=columns[0][:1] - 1) != 0) | (np.diff(columns[1], prepend=columns[1][:1] - 1) != 0))
            for a, b in zip(fresh.tolist(), [*fresh[1:].tolist(), batch.num_rows]):
                here = (int(columns[0][a]), int(columns[1][a]))
                members = ",".join(map(str, columns[2][a:b].tolist())).encode()
                if here == node:
                    digest.update(b"," + members)
                else:
                    if node is not None:
                        done.append((*node, digest.hexdigest()))
                    node, digest = here, hashlib.sha256(members)
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))],
                                             names=["rep", "depth", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*node, digest.hexdigest())], names=["rep", "depth", "ends_sha256"])

    placed = ends.select("rep", "depth", "conv_id").repartition("rep", "depth").sortWithinPartitions("rep", "depth", "conv_id")
    return placed.mapInArrow(run, "rep bigint, depth bigint, ends_sha256 string")


def _with_nodes(rows: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """``rows`` with their node's columns: by broadcast for the few nodes that many rows share, by key for the others."""
    hot = cut(nodes.where(F.col("n_convs") * HOT_SHARE > total))
    cold = rows.join(F.broadcast(hot.select("k1", "k2")), ["k1", "k2"], "left_anti")
    return cold.join(nodes, ["k1", "k2"]).unionByName(rows.join(F.broadcast(hot), ["k1", "k2"]))


def prefix_trie(members: DataFrame, turns: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row per node (see ``COLUMNS``) of the conversations ``members`` (distinct conv_ids).

    ``turns``: rows as of ``turn_hashes``, in ``order`` within their conversation (by ``pos`` if not given).
    """
    spark = members.sparkSession
    members = members.select(F.col("conv_id").cast("bigint").alias("conv_id"))
    prefixes = cut(prefix_keys(turns, order or ["pos"]))
    total, with_turns = prefixes.agg(F.count(F.lit(1)), F.count(F.when(F.col("depth") == 1, 1))).first()
    n_members, root = members.agg(F.count(F.lit(1)), F.min("conv_id")).first()
    if not n_members:
        return spark.range(0).select(*[F.lit(None).cast("string" if c == "ends_sha256" else "bigint").alias(c) for c in COLUMNS])
    screened = cut(_screened(prefixes, total))

    # The grouped prefixes, and the single ones right below them: what these need from the nodes above.
    by_depth = ["conv_id"], ["depth"]
    chained = cut(Ordered(screened, *by_depth).add(prev={"above": F.struct("k1", "k2", "maybe")}))
    under_maybe = F.coalesce(F.col("above.maybe"), F.lit(False))
    sha = F.sha2(F.col("conv_id").cast("string"), 256)
    single = [F.lit(1).cast("bigint").alias("n_convs"), F.col("more").cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"),
              F.lit(0).cast("bigint").alias("saved_tokens"), F.when(F.col("more"), EMPTY).otherwise(sha).alias("ends_sha256")]
    parent = F.when(F.col("depth") == 1, F.lit(root)).otherwise(F.col("conv_id")).alias("parent_conv_id")
    tails = chained.where(~F.col("maybe") & ~under_maybe).select("conv_id", "depth", parent, *single)

    maybe = chained.where("maybe")
    tops = chained.where(~F.col("maybe") & under_maybe)
    groups = maybe.groupBy("k1", "k2").agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n_convs"), F.min("above.k1").alias("p1"), F.min("above.k2").alias("p2"))
    groups = cut(groups)
    children = groups.select("p1", "p2").unionByName(tops.select(F.col("above.k1").alias("p1"), F.col("above.k2").alias("p2"))).where("p1 IS NOT NULL")
    children = children.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = cut(groups.drop("p1", "p2").join(children, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    n_maybe = maybe.count()
    slim = maybe.select("k1", "k2", "conv_id", "depth", "chars", "more", under_maybe.alias("under"))
    known = _with_nodes(slim, nodes, n_maybe).drop("k1", "k2")
    bare = tops.select("conv_id", "depth", "chars", "more", F.lit(True).alias("under"), *[F.lit(None).cast("bigint").alias(c) for c in ("rep", "n_convs", "n_children")])
    path = cut(Ordered(known.unionByName(bare), *by_depth).add(prev={"up": F.col("rep")}, next={"down": F.struct("rep", F.coalesce(F.col("n_convs") > 1, F.lit(False)).alias("shared"))}))
    parent = F.when(F.col("depth") == 1, F.lit(root)).when(~F.col("under"), F.col("conv_id")).otherwise(F.col("up")).alias("parent_conv_id")
    lone = path.where("n_convs IS NULL OR n_convs = 1").select("conv_id", "depth", parent, *single)

    # Shared nodes lie on the path of each member from the first turn on; ``deepest`` is the last of them.
    shared = path.where("n_convs > 1").withColumn("deepest", ~F.coalesce(F.col("down.shared"), F.lit(False)))
    mine = F.col("rep") == F.col("conv_id")
    saved = F.when(mine, (F.col("n_convs") - 1) * F.col("chars")).otherwise(0)
    leaf = F.when(F.col("deepest") & (F.col("more") | (mine & (F.col("n_children") == 0))), 1).otherwise(0).cast("bigint")
    shared = cut(shared.withColumns({"leaf": leaf, "saved": saved, "mine": mine}))
    totals = shared.groupBy("conv_id").agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("spared"))
    sent = shared.where(~F.col("mine") & (F.col("deepest") | (F.col("down.rep") != F.col("rep")))).select("conv_id", "rep", "depth")
    hung = sent.join(totals.where("leaves > 0 OR spared > 0"), "conv_id").groupBy(F.col("rep").alias("conv_id"), "depth").agg(
        F.sum("leaves").alias("leaves"), F.sum("spared").alias("spared"))
    own = shared.where("mine").select("conv_id", "depth", parent, "n_convs", "n_children", "leaf", "saved")
    own = own.join(hung, ["conv_id", "depth"], "left")
    own = own.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaf") + F.coalesce("leaves", F.lit(0))).alias("leaf"),
                     (F.col("saved") + F.coalesce("spared", F.lit(0))).alias("saved"), (-F.col("depth")).alias("height"))
    summed = Ordered(own, ["conv_id"], ["height"]).add(running={"n_leaves": ("sum", F.col("leaf")), "saved_tokens": ("sum", F.col("saved"))})

    # The root: its members without turns end there.
    facts = totals.agg(F.count(F.lit(1)), F.sum("leaves"), F.sum("spared")).first()
    top_children = nodes.join(chained.where("maybe AND depth = 1").select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").count()
    top_children += chained.where("NOT maybe AND depth = 1").count()
    leaves = (facts[1] or 0) + with_turns - facts[0] if with_turns else 1
    crown = spark.range(1).select(F.lit(root).cast("bigint").alias("conv_id"), F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("bigint").alias("parent_conv_id"),
                                  *[F.lit(int(v)).cast("bigint").alias(n) for n, v in (("n_convs", n_members), ("n_children", top_children), ("n_leaves", leaves),
                                                                                      ("saved_tokens", facts[2] or 0))])
    silent = members.join(prefixes.where("depth = 1").select("conv_id"), "conv_id", "left_anti")
    ends = shared.where(~F.col("more")).select("rep", "depth", "conv_id").unionByName(
        silent.select(F.lit(root).cast("bigint").alias("rep"), F.lit(0).cast("bigint").alias("depth"), "conv_id"))
    digests = _digests(ends).withColumnRenamed("rep", "conv_id")
    many = crown.unionByName(summed.select(*crown.columns)).join(digests, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    return many.select(*COLUMNS).unionByName(tails.select(*COLUMNS)).unionByName(lone.select(*COLUMNS))


def rooted(members: DataFrame, turns: DataFrame, block: int, most: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of another one: the first ``most`` turns of a conversation c are replaced by
    those of c - c % ``block`` (all if fewer, none if absent). ``most`` is an expression over conv_id, below ``block``.

    Returns (members, turns in the order of part and pos).
    """
    heads = members.select("conv_id", most.cast("bigint").alias("most"), (F.col("conv_id") - F.col("conv_id") % block).alias("base"))
    own = turns.withColumn("most", most.cast("bigint")).where("pos > most").select(F.lit(1).alias("part"), *turns.columns)
    first = turns.where(f"conv_id % {block} = 0").withColumnRenamed("conv_id", "base").where(f"pos <= {block}")
    given = heads.join(first, "base").where("pos <= most").select(F.lit(0).alias("part"), *turns.columns)
    return members, given.unionByName(own)
