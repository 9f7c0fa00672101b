"""A Merkle manifest of a table: a leaf per row, a tree per group, one tree over the groups, and an authentication path per row.

A node is the SHA-256 (lower-case hex) of the digests below it, as text. Two consecutive nodes become one, a last single
one becomes the digest of itself alone; a tree of one leaf is that leaf. Every tier cuts a group into aligned blocks of
256 nodes, whose roots are the nodes of the next tier, so no task holds more than a block, and a group with a third of
all rows is as many blocks as its rows need. Inside a block the paths are made leaf by leaf by traversal scheduling: one
stack per level keeps the node that the path needs next, and every step gives the stacks as much work as they need to be
ready in time (twice the levels). The path of the block itself comes from the tier above and is appended.

Rows: null groups are a group of their own and come first; leaves ascend by the order column (null first), then by their
digest; rows that agree in both are alike. Null values are ``-``, empty texts are ``0:``. An empty table has no root and no
rows. Other columns of the table, whatever their names, take no part and do not come back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brambling.llm.storage import trimmed, written
from brambling.operators.joins import small

#: Levels of a block, which so has 256 nodes.
LEVELS = 8
#: Rows of an Arrow batch that a task returns: a path has some 70 bytes per level.
ROWS_OUT = 1024
#: Characters of group names up to which partition borders are broadcast.
NAMES = 4_000_000


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def above(left: str | None, right: str | None) -> str | None:
    """The node over two, of which the right or both may be beyond the end of the tree."""
    return None if left is None else digest(left + (right or ""))


def field(value: Column) -> Column:
    """``-`` for null, else the length in bytes of UTF-8, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


class Treehash:
    """The node of a level that a path needs next, made of one leaf or one joining at a time."""

    def __init__(self, level: int, ready: str | None):
        self.level, self.nodes, self.at, self.done = level, [(level, ready)], 0, True

    def begin(self, first_leaf: int) -> None:
        self.nodes, self.at, self.done = [], first_leaf, False

    @property
    def lowest(self) -> int | float:
        return float("inf") if self.done else self.nodes[-1][0] if self.nodes else self.level

    def step(self, leaves: Sequence[str]) -> None:
        if len(self.nodes) > 1 and self.nodes[-1][0] == self.nodes[-2][0]:
            h, right = self.nodes.pop()
            self.nodes[-1] = (h + 1, above(self.nodes[-1][1], right))
        else:
            self.nodes.append((0, leaves[self.at] if self.at < len(leaves) else None))
            self.at += 1
        self.done = len(self.nodes) == 1 and self.nodes[0][0] == self.level


def traverse(leaves: Sequence[str], height: int) -> Iterator[list[str]]:
    """The path of each leaf of a tree of ``height`` levels, in order: per level ``<`` or ``>`` and the digest that stands on that side, or ``-`` without one."""
    rows: list[list[str | None]] = [list(leaves)]
    for _ in range(height):
        last = rows[-1]
        rows.append([above(last[i], last[i + 1] if i + 1 < len(last) else None) for i in range(0, len(last), 2)])
    path = [r[1] if len(r) > 1 else None for r in rows[:height]]
    stacks = [Treehash(h, rows[h][0]) for h in range(height)]
    del rows  # from here on: a path and a stack per level
    for i in range(len(leaves)):
        yield ["-" if node is None else ("<" if i >> h & 1 else ">") + node for h, node in enumerate(path)]
        for h in range(height):
            if (i + 1) % (1 << h):
                break
            path[h] = stacks[h].nodes[0][1]
            stacks[h].begin((i + 1 + (1 << h)) ^ (1 << h))
        for _ in range(2 * height - 1):
            focus = min(stacks, key=lambda s: s.lowest)
            if focus.done:
                break
            focus.step(leaves)


def height_of(nodes: int, levels: int = LEVELS) -> int:
    """Levels that a block of a group with so many nodes in its tier has."""
    return min(levels, (nodes - 1).bit_length())


def root_of(leaves: Sequence[str], height: int) -> str:
    row = list(leaves)
    for _ in range(height):
        row = [digest("".join(row[i : i + 2])) for i in range(0, len(row), 2)]
    return row[0]


def _dealt(nodes: DataFrame) -> DataFrame:
    """The nodes of a block together and in order, as many blocks in a task as Spark likes."""
    return nodes.repartition("grp", "block").sortWithinPartitions("grp", "block", "index")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each block, which may come in several batches."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["block"], row["grp"]) != (held[0]["block"], held[0]["grp"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _batched(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= ROWS_OUT:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``index`` (from 0, in its group by ``order``) and ``total`` (rows of its group), through ranges of all rows.

    A range knows the places of its own rows; what it adds to them is the number of rows that its first group has in the
    ranges before. Counts per range and group are as many as there are ranges and groups.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("_tie", F.monotonically_increasing_id())
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [group, *order, "_tie"]
    sorted_rows = keyed.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    placed = written(sorted_rows.withColumn("_part", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "merkle-placed")
    counts = placed.groupBy("_part", group).agg(F.count("*").alias("n"), F.min("_pos").alias("first"))
    own = Window.partitionBy(group)
    before = F.coalesce(F.sum("n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    borders = written(counts.select(F.col("_part").alias("_p"), F.col(group).alias("_g"), (before - F.col("first")).alias("_add"), F.sum("n").over(own).alias("total")), "merkle-borders")
    light = (borders.agg(F.sum(F.octet_length(F.col("_g").cast("string")))).first()[0] or 0) <= NAMES
    met = placed.join(small(borders) if light else borders, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return met.select(*rows.columns, (F.col("_pos") + F.col("_add")).alias("index"), "total")


def _tiers(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """The nodes, the roots of their blocks, the roots of blocks of these, up to one node per group."""
    tiers = [nodes]
    most = nodes.agg(F.max("total")).first()[0] or 0
    kind = nodes.schema["grp"].dataType.simpleString()

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for block in _blocks(batches):
                total = block[0]["total"]
                yield {"grp": block[0]["grp"], "index": block[0]["block"], "total": -(-total // (1 << levels)), "node": root_of([r["node"] for r in block], height_of(total, levels))}

        first = next(batches, None)
        if first is not None:
            yield from _batched(rows(_chain(first, batches)), pa.schema([("grp", first.schema.field("grp").type), ("index", pa.int64()), ("total", pa.int64()), ("node", pa.string())]))

    while True:
        below = tiers[-1].select("grp", F.expr(f"index div {1 << levels}").alias("block"), "index", "total", "node")
        up = _dealt(below).mapInArrow(trimmed(roots), f"grp {kind}, index long, total long, node string")
        tiers.append(written(up, "merkle-roots"))
        most = -(-most // (1 << levels))
        if most <= 1:
            return tiers


def _descend(tiers: list[DataFrame], tops: DataFrame, levels: int) -> DataFrame:
    """grp, index, node, path, subroot, root, row of every node of the first tier; ``tops``: grp, path, subroot, root of every group."""
    kind, row_kind = tiers[0].schema["grp"].dataType.simpleString(), tiers[0].schema["row"].dataType.simpleString()
    out_schema = f"grp {kind}, index long, node string, path array<string>, subroot string, root string, row {row_kind}"

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for block in _blocks(batches):
                top, leaves = block[0], block[1:]
                for r, path in zip(leaves, traverse([r["node"] for r in leaves], height_of(leaves[0]["total"], levels))):
                    yield {"grp": r["grp"], "index": r["index"], "node": r["node"], "path": path + top["path"], "subroot": top["subroot"], "root": top["root"], "row": r["row"]}

        first = next(batches, None)
        if first is None:
            return
        types = {f.name: f.type for f in first.schema}
        schema = pa.schema([(c, types[c]) for c in ("grp", "index", "node", "path", "subroot", "root", "row")])
        yield from _batched(rows(_chain(first, batches)), schema)

    upper = tops.select("grp", F.lit(0).cast("long").alias("index"), "path", "subroot", "root")
    for tier in reversed(tiers[:-1]):
        nothing = F.lit(None)
        own = tier.select("grp", F.expr(f"index div {1 << levels}").alias("block"), "index", "total", "node", nothing.cast("array<string>").alias("path"), nothing.cast("string").alias("subroot"), nothing.cast("string").alias("root"), (F.col("row") if tier is tiers[0] else nothing.cast(row_kind)).alias("row"))
        # The path of the block comes as one more row of it, ahead of its leaves.
        over = upper.select("grp", F.col("index").alias("block"), F.lit(-1).cast("long").alias("index"), F.lit(0).cast("long").alias("total"), nothing.cast("string").alias("node"), "path", "subroot", "root", nothing.cast(row_kind).alias("row"))
        found = _dealt(own.unionByName(over)).mapInArrow(trimmed(paths), out_schema)
        upper = found if tier is tiers[0] else written(found, "merkle-paths")
    return upper


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


@dataclass(frozen=True)
class Manifest:
    """``groups``: grp, n_leaves, subroot, root; ``proofs``: grp, index, node, path, subroot, root, row, one per leaf."""

    groups: DataFrame
    proofs: DataFrame

    def root(self) -> str | None:
        """The root of everything; None for an empty table."""
        found: Row | None = self.groups.select("root").first()
        return found and found["root"]


def build(leaves: DataFrame, levels: int = LEVELS) -> Manifest:
    """The manifest of rows with grp, ord (their order in the group), leaf (a digest) and row (a struct that comes back)."""
    rows = written(leaves.select("grp", "ord", "leaf", "row"), "merkle-leaves")
    nodes = written(ranked(rows, "grp", ["ord", "leaf"]).select("grp", "index", "total", F.col("leaf").alias("node"), "row"), "merkle-nodes")
    tiers = _tiers(nodes, levels)
    sizes = nodes.filter("index = 0").select(F.col("grp").alias("g"), F.col("total").alias("n_leaves"))
    over = tiers[-1].select(F.lit("").alias("grp"), F.struct("grp").alias("row"), F.col("grp").alias("ord"), F.col("node").alias("leaf"))
    heads = ranked(over, "grp", ["ord"]).select("grp", "index", "total", F.col("leaf").alias("node"), F.struct(F.col("row.grp").alias("grp"), F.col("leaf").alias("subroot")).alias("row"))
    head_tiers = _tiers(written(heads, "merkle-heads"), levels)
    tip = head_tiers[-1].select("grp", F.array().cast("array<string>").alias("path"), F.lit("").alias("subroot"), F.col("node").alias("root"))
    tops = written(_descend(head_tiers, tip, levels).select("row.grp", "path", "row.subroot", "root"), "merkle-tops")
    groups = tops.join(sizes, tops["grp"].eqNullSafe(F.col("g")), "left").select("grp", "n_leaves", "subroot", "root")
    return Manifest(groups, _descend(tiers, tops, levels))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    node = lambda t: F.substring(t, 2, 64)
    return F.aggregate(path, start, lambda done, t: F.sha2(F.when(t.startswith("<"), F.concat(node(t), done)).when(t.startswith(">"), F.concat(done, node(t))).otherwise(done), 256))


def path_digest(path: Column) -> Column:
    """One digest of all siblings of a path, from the leaf upwards."""
    return F.sha2(F.translate(F.array_join(path, ""), "<>-", ""), 256)


def document_proofs(docs: DataFrame, tampered: Column, group: str = "lang", order: str = "doc_id", values: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), count: str = "n_chars") -> DataFrame:
    """doc_id, leaf, subroot, root, path, folded_root, verified of every row; where ``tampered`` holds, the row is checked as if ``count`` were one more.

    A null ``count`` stays null, so such a row is as it was.
    """
    more = (F.col(count).cast("decimal(20,0)") + 1).cast("string")
    changed = leaf(*[more if c == count else F.col(c) for c in values])
    own = leaf(*map(F.col, values))
    rows = docs.select(F.col(group).alias("grp"), F.col(order).alias("ord"), own.alias("leaf"), F.struct(F.col(order).alias("id"), F.when(tampered & F.col(count).isNotNull(), changed).alias("changed")).alias("row"))
    found = build(rows).proofs.withColumn("folded_root", folded(F.coalesce("row.changed", "node"), F.col("path")))
    return found.select(F.col("row.id").alias(order), F.col("node").alias("leaf"), "subroot", "root", "path", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
