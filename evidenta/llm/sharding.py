"""Sharding by a hierarchical weighted hash tree.

A row descends from the root over regions and racks to a shard.  At each level every child makes a weighted hash
draw, -ln(u) / weight with u from a hash of the row's key and the child's name, and the least draw wins, so a child
is chosen in proportion to its weight and a changed weight moves rows only into or out of that child's subtree.

Law: ``key``.  The key and the shard count alone decide, and one more shard takes rows only into itself.  The new
shard is a leaf of its own region and rack, and the added weight counts on every level above it.  A subtree's draw is
the least over its *stakes*: its weight before and each weight added since, every stake with a hash of its own (the
least of independent draws is again a draw of the summed weight).  A row that a subtree wins by an added stake came
for the new shard, so on the levels below only stakes that hold that shard take part; a row that the first stake wins
descends as it did before.  So the rows that growth moves are exactly those that reach the new shard, and they leave
every region, rack and shard in proportion to its weight.

Defined cases: a null text has no bytes (size 1, checksum of nothing: 0), like an empty one; a null key is hashed as an
empty string; equal texts fall where their keys say; repeated rows, and rows that share an id, share a shard and get
different slots; a very long text is only measured and summed up; ties of a draw go to the child named first; an empty
table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bucket_count, hash_unit, stored

REGIONS, RACKS = 2, 2
ROWS_PER_BUCKET = 2000


@dataclass(frozen=True)
class Stake:
    """A weight that takes part in a subtree's draw; ``shard`` is the new shard that brought it (None: there from the start)."""

    weight: float
    shard: int | None = None


@dataclass(frozen=True)
class Node:
    """A subtree with its stakes; leaves have a shard number."""

    name: str
    stakes: tuple[Stake, ...]
    children: tuple[Node, ...] = ()
    shard: int | None = None

    @property
    def weight(self) -> float:
        return sum(x.weight for x in self.stakes)


def _of(weight: float) -> tuple[Stake, ...]:
    return (Stake(weight),)


def build_tree(shards: int, regions: int = REGIONS, racks: int = RACKS, weights: dict[int, float] | None = None) -> Node:
    """Shards dealt round over regions, then racks; a subtree weighs as much as its shards."""
    weights = weights or {}
    found = []
    for g in range(regions):
        rack_nodes = []
        for r in range(racks):
            own = [s for s in range(shards) if s % regions == g and s // regions % racks == r]
            leaves = tuple(Node(f"shard{s}", _of(weights.get(s, 1.0)), shard=s) for s in own)
            if leaves:
                rack_nodes.append(Node(f"rack{g}.{r}", _of(sum(x.weight for x in leaves)), leaves))
        if rack_nodes:
            found.append(Node(f"region{g}", _of(sum(x.weight for x in rack_nodes)), tuple(rack_nodes)))
    return Node("root", _of(sum(x.weight for x in found)), tuple(found))


def grow(tree: Node, shard: int, weight: float = 1.0, regions: int = REGIONS, racks: int = RACKS) -> Node:
    """The tree with one more shard in its region and rack; nodes on the way get a stake of its weight."""
    path = (f"region{shard % regions}", f"rack{shard % regions}.{shard // regions % racks}")
    added = Stake(weight, shard)

    def placed(node: Node, below: tuple[str, ...]) -> Node:
        if not below:
            return Node(node.name, (*node.stakes, added), (*node.children, Node(f"shard{shard}", (added,), shard=shard)))
        names = [c.name for c in node.children]
        if below[0] in names:
            children = tuple(placed(c, below[1:]) if c.name == below[0] else c for c in node.children)
        else:
            children = (*node.children, placed(Node(below[0], ()), below[1:]))
        return Node(node.name, (*node.stakes, added), children)

    return placed(tree, path)


#: The root's draw is open to all stakes; below it, only to those of the layer (the new shard, or None) that won above.
ALL = -1


def _draws(key: Column, node: Node, layer: int | None) -> list[tuple[Column, Node, Stake]]:
    """(draw, child, stake) of the stakes that take part below a node."""
    out = []
    for child in node.children:
        for stake in child.stakes:
            if layer == ALL or stake.shard == layer:
                name = child.name if stake.shard is None or child.shard is not None else f"{child.name}+{stake.shard}"
                out.append((-F.log(hash_unit(key, F.lit(name))) / F.lit(stake.weight), child, stake))
    return out


def descend(key: Column, node: Node, layer: int | None = ALL) -> Column:
    """The shard that a key reaches below a node."""
    if node.shard is not None:
        return F.lit(node.shard)
    drawn = _draws(key, node, layer)
    if len(drawn) == 1:
        return descend(key, drawn[0][1], drawn[0][2].shard)
    winner = F.array_min(F.array(*[F.struct(d.alias("draw"), F.lit(i).alias("stake")) for i, (d, _, _) in enumerate(drawn)]))["stake"]
    chosen = F.when(winner == 0, descend(key, drawn[0][1], drawn[0][2].shard))
    for i, (_, child, stake) in enumerate(drawn[1:], 1):
        chosen = chosen.when(winner == i, descend(key, child, stake.shard))
    return chosen


def assign_shards(df: DataFrame, tree: Node, key_col: str = "doc_id") -> DataFrame:
    """``df`` with a column ``shard``, decided by key and tree alone: no shuffle."""
    return df.withColumn("shard", descend(F.coalesce(F.col(key_col).cast("string"), F.lit("")), tree).cast("int"))


def number_slots(df: DataFrame, shard_col: str, bucket_keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with a gapless ``slot`` from 0 in each shard, without bringing a shard into one task.

    Rows are numbered inside hash buckets of a shard; a bucket's first slot is the prefix sum of the bucket counts.
    """
    buckets = bucket_count(df.count(), ROWS_PER_BUCKET)
    placed = df.withColumn("slot_bucket", F.pmod(F.xxhash64(*bucket_keys), F.lit(buckets)).cast("int"))
    firsts = (
        placed.groupBy(shard_col, "slot_bucket")
        .agg(F.count(F.lit(1)).alias("in_bucket"))
        .withColumn("first_slot", F.sum("in_bucket").over(Window.partitionBy(shard_col).orderBy("slot_bucket")) - F.col("in_bucket"))
        .drop("in_bucket")
    )
    inside = F.row_number().over(Window.partitionBy(shard_col, "slot_bucket").orderBy(*order)) - 1
    return (
        placed.withColumn("in_slot", inside)
        .join(firsts, [shard_col, "slot_bucket"])
        .withColumn("slot", F.col("first_slot") + F.col("in_slot"))
        .drop("slot_bucket", "in_slot", "first_slot")
    )


def shard_documents(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest rows of all documents with their shard, slot and the shard they would have with one more."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = df.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    tree = build_tree(shards)
    placed = assign_shards(narrow, tree).withColumnRenamed("shard", "now")
    placed = assign_shards(placed, grow(tree, shards)).withColumnRenamed("shard", "grown_shard")
    placed = stored(placed.withColumnRenamed("now", "shard"), "shards")
    numbered = number_slots(placed, "shard", ["doc_id", "text_crc32", "size"], ["doc_id", "text_crc32", "size"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard"
    )
