"""Sharding by a hierarchical weighted hash tree: region, rack, shard."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import landed, query, table

# Rows numbered in one task.
SLOT_ROWS = 200_000
OWN = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


@dataclass(frozen=True)
class Node:
    """A shard (no children) or a region, rack or whole cluster; its weight is that of its shards."""

    name: str
    children: tuple[Node, ...] = ()
    own_weight: float = 1.0
    shard: int = -1

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def grid(regions: int, racks: int, shards: int) -> Node:
    """A cluster of equal shards, numbered through."""
    at, tops = 0, []
    for r in range(regions):
        inner = []
        for k in range(racks):
            leaves = tuple(Node(f"shard{at + s}", shard=at + s) for s in range(shards))
            at += shards
            inner.append(Node(f"region{r}/rack{k}", leaves))
        tops.append(Node(f"region{r}", tuple(inner)))
    return Node("cluster", tuple(tops))


def grown(cluster: Node, shard: int, weight: float = 1.0) -> Node:
    """One more shard, in a region and rack of its own.

    No other subtree changes its weight, so a draw at the top either goes to the new region or
    falls as before: rows move into the new shard only.
    """
    leaf = Node(f"shard{shard}", own_weight=weight, shard=shard)
    region = Node(f"region-of-{shard}", (Node(f"region-of-{shard}/rack", (leaf,)),))
    return Node(cluster.name, (*cluster.children, region))


def reweighted(node: Node, shard: int, weight: float) -> Node:
    """The same tree with another weight for one shard; 0 empties it."""
    if node.shard == shard:
        return Node(node.name, own_weight=weight, shard=shard)
    return Node(node.name, tuple(reweighted(c, shard, weight) for c in node.children), node.own_weight, node.shard)


def _draw(key: Column, child: Node) -> Column:
    """Exponential waiting time with the child's weight as its rate, from the hash of key and name."""
    uniform = (F.shiftrightunsigned(F.xxhash64(key, F.lit(child.name)), 11) + 0.5) / float(1 << 53)
    return -F.log(uniform) / child.weight


def descend(key: Column, node: Node) -> Column:
    """Shard of a hashed key: at every level the child that waits least wins.

    A child wins in proportion to its weight. If one child's weight changes, the others' draws stay
    as they are, so keys move only to it or away from it, and inside unchanged subtrees nothing moves.
    Only the draws on a key's own path are made.
    """
    if not node.children:
        return F.lit(node.shard)
    alive = [c for c in node.children if c.weight > 0]
    if len(alive) == 1:
        return descend(key, alive[0])
    draws = [F.struct(_draw(key, c).alias("wait"), F.lit(i).alias("child")) for i, c in enumerate(alive)]
    winner = F.least(*draws)["child"]
    if all(not c.children for c in alive):
        return F.element_at(F.array(*[F.lit(c.shard) for c in alive]), winner + 1)
    # The winner is drawn once and named by a lambda, then only its own subtree is looked into.
    below = F.transform(F.array(winner), lambda w: _choose(w, [descend(key, c) for c in alive]))
    return below[0]


def _choose(index: Column, options: list[Column]) -> Column:
    out = options[-1]
    for i in range(len(options) - 2, -1, -1):
        out = F.when(index == i, options[i]).otherwise(out)
    return out


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with ``size`` (UTF-8 bytes plus 8) and ``text_crc32``; a null text has none and the checksum of none."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        *[c for c in docs.columns if c not in OWN],
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )


def shard_rows(rows: DataFrame, cluster: Node, more: Node | None = None, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """``rows`` (which have ``doc_id``) with ``law, shard, slot, grown_shard``.

    The law is ``key``: doc_id and tree decide the shard, ``grown_shard`` is that in the tree ``more`` (null
    without one). ``slot`` counts the rows of a shard from 0 without gaps. Null ids share one place. Rows
    that are equal in all columns get consecutive slots. Columns with one of our names are replaced.
    Column types must be comparable (no maps). An empty table gives an empty result.

    Equal rows are counted before the shuffle. The rest is dealt to buckets of about ``slot_rows``
    rows by a hash of the whole row, so that no id, text or shard gathers in one task.
    """
    kept = [c for c in rows.columns if c not in OWN[2:]]
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = rows.groupBy(*kept).agg(F.count(F.lit(1)).alias("__copies")).withColumn("__key", key)
    after = descend(F.col("__key"), more) if more is not None else F.lit(None)
    rows = rows.select(
        *kept,
        F.lit("key").alias("law"),
        descend(F.col("__key"), cluster).cast("int").alias("shard"),
        after.cast("int").alias("grown_shard"),
        "__copies",
        F.xxhash64(*kept).alias("__order"),
    )
    rows = landed(rows, "sharded")
    total = rows.agg(F.sum("__copies")).first()[0] or 0
    shards = sum(len(rack.children) for region in cluster.children for rack in region.children)
    buckets = max(1, -(-total // (slot_rows * shards)))
    # Equal ranges of the hash; the bucket number rises with the hash.
    bucket = F.least(
        F.floor((F.col("__order").cast("double") + float(1 << 63)) / float(1 << 64) * buckets), F.lit(buckets - 1)
    ).cast("long")
    rows = rows.withColumn("__bucket", bucket)
    sums = rows.groupBy("shard", "__bucket").agg(F.sum("__copies").alias("__n"))
    # One row per bucket: a few rows per shard and 200,000 documents.
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("shard", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    inside = Window.partitionBy("shard", "__bucket").orderBy("__order", *kept).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__at", F.coalesce(F.sum("__copies").over(inside), F.lit(0)))
    rows = rows.join(sums, ["shard", "__bucket"]).withColumn("__at", F.col("__at") + F.col("__first"))
    slots = F.explode(F.sequence(F.col("__at"), F.col("__at") + F.col("__copies") - 1)).alias("slot")
    return rows.select(*kept, "law", "shard", slots, "grown_shard")


def shard_documents(docs: DataFrame, cluster: Node, more: Node | None = None) -> DataFrame:
    """Whole documents with their size, checksum, shard and slot."""
    return shard_rows(measured(docs), cluster, more)


@query("op4_hash_tree_sharding")
def op4(spark, sf_dir):
    cluster = grid(regions=2, racks=3, shards=4)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    # The result needs no text: it is measured in the scan and not moved.
    return shard_rows(measured(docs).drop("text"), cluster, grown(cluster, 24))
