"""Merkle manifest of a dataset: a hash tree for each source, one over their roots, and proofs looked up by coordinate.

H is the lowercase hex SHA-256 of its inputs put together; digests go in as hex text. A leaf is H of a row's fields, each
its count of UTF-8 bytes, a colon and its value, or a dash if null. The leaves of a source ascend by id; while several
nodes remain, every sixteen in a row (the last run may be shorter, even of one) become their H. What remains is the
source's root, and those, by source, are the leaves of the forest, whose root stands for the dataset.

A node's coordinate is (tree, level, index). Nodes are materialised run by run: the row (tree, level, run) holds the
digests of the indexes 16 * run to 16 * run + 15, so that one lookup answers all siblings at one level. From its index
and its tree's size a leaf knows the runs of all levels; it explodes them, meets the node table, orders the answers by
level, and folds: H(left siblings, own digest, right siblings), level by level. The sixteen leaves of a run share all
coordinates but the first, so they ask as one row. A run of a high level is asked for by many: its row is laid out in
copies, of which each asks one.

Places among the leaves come from a range partitioning by tree and id: a row's place within its partition and the
running total of the partitions before it, so that a tree of any size is numbered without a task that sees all of it.
The number of jobs grows with the logarithm of the largest tree.

Odd rows. A null source is a tree of its own, before all others. Null ids come first among a tree's leaves; rows of one
id are ordered by their leaf, so that repeated rows and shuffled inputs give the same root. Null, empty and long texts
are leaves like others. Of no rows nothing comes back. Names of other columns don't matter: what is carried is named.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.plan import let, settled
from .common import Scratch, join_classes

WIDTH = 16
#: Rows in which a run of nodes is laid out at most; at level k it is asked for by up to WIDTH ** k runs of leaves.
MOST_COPIES = 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Bits of monotonically_increasing_id below the partition's number.
IN_PARTITION = 33


def h(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as it goes into a leaf."""
    return let(value.cast("string"), lambda v: F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)))


def leaf(*values: Column) -> Column:
    return h(*map(field, values))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def tree_key(source: Column) -> Column:
    """A key without nulls, in the order of the sources, null first."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def div(a: Column, by: int) -> Column:
    return F.floor(a / by)


def placed(leaves: DataFrame, scratch: Scratch) -> DataFrame:
    """tree, digest, item, with index (from 0, by order, digest and tie within the tree) and size of the tree."""
    keys = [F.col("tree"), F.col("order").asc_nulls_first(), F.col("digest"), F.col("tie")]
    dealt = leaves.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = scratch.write(dealt.select("tree", "digest", "item", F.monotonically_increasing_id().alias("at")))
    dealt = dealt.withColumn("part", F.shiftright("at", IN_PARTITION))
    starts = dealt.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    own = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select("tree", "part", "first", before.alias("before"), F.sum("n").over(own).alias("size"))
    return dealt.join(starts, ["tree", "part"]).select("tree", "digest", "item", (F.col("at") - F.col("first") + F.col("before")).alias("index"), "size")


def beside(digests: Column, place: Column) -> list[Column]:
    """The digests left and right of a place, put together."""
    joined = lambda start, n: F.array_join(F.slice(digests, start, n), "")
    return [joined(F.lit(1), place.cast("int")).alias("left"), joined((place + 2).cast("int"), F.lit(WIDTH)).alias("right")]


def runs_of(nodes: DataFrame, *held: str) -> DataFrame:
    """Rows (tree, run, size, nodes, digests), of nodes (tree, index, size, digest, and what is held of each)."""
    grouped = nodes.groupBy("tree", div(F.col("index"), WIDTH).alias("run"))
    found = grouped.agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("index", "digest", *held))).alias("nodes"))
    return found.withColumn("digests", F.col("nodes.digest"))


def copies(level: int) -> int:
    """Rows in which a run of a level's nodes is laid out, so that each is asked for by at most 256 runs of leaves up to level 5."""
    return min(MOST_COPIES, WIDTH ** max(0, level - 2))


class Trees:
    """Runs of leaves, the node table above them, and the trees' roots, each written once.

    A tree of `size` leaves has several nodes at a level, and so runs of them, if size > WIDTH ** level.
    """

    def __init__(self, leaves: DataFrame, scratch: Scratch):
        self.runs = scratch.write(runs_of(placed(leaves, scratch), "item"))
        most = self.runs.agg(F.max("size")).first()[0] or 0
        self.upper: list[DataFrame] = []  # of level 1, 2, ...
        node = F.when(F.col("size") > 1, h(F.array_join("digests", ""))).otherwise(F.col("digests")[0])
        nodes = self.runs.select("tree", F.col("run").alias("index"), "size", node.alias("digest"))
        roots = nodes.where(F.col("size") <= WIDTH)
        while WIDTH ** (level := len(self.upper) + 1) < most:
            runs = scratch.write(runs_of(nodes.where(F.col("size") > WIDTH**level)).drop("nodes"))
            self.upper.append(runs.withColumn("level", F.lit(level)))
            nodes = runs.select("tree", F.col("run").alias("index"), "size", h(F.array_join("digests", "")).alias("digest"))
            roots = roots.unionByName(nodes.where(F.col("size") <= WIDTH ** (level + 1)))
        self.roots = scratch.write(roots.select("tree", F.col("digest").alias("root"), "size"))

    def paths(self, known: DataFrame | None = None) -> DataFrame:
        """tree, item, digest and path of each leaf: an array of (level, left, right), from its own level up.

        With known, (tree, size, subroot, root, up), also these columns of its tree.
        """
        none = F.array().cast("array<struct<level:int,left:string,right:string>>")
        met = self.runs.withColumn("above", none) if not self.upper else self.runs.join(self._answers(), ["tree", "run"], "left")
        more = [c for c in known.columns if c not in ("tree", "size")] if known is not None else []
        if known is not None:  # by run, before each becomes sixteen rows
            met = join_classes(met.withColumnRenamed("size", "leaves"), known, "tree", known.agg(F.sum("size")).first()[0] or 0).drop("size").withColumnRenamed("leaves", "size")
        met = met.select("tree", "size", "digests", F.coalesce("above", none).alias("above"), *more, F.posexplode("nodes").alias("place", "node"))
        own = F.array(F.struct(F.lit(0).alias("level"), *beside(F.col("digests"), F.col("place"))))
        return met.select("tree", "node.item", "node.digest", F.concat(F.when(F.col("size") > 1, own).otherwise(none), "above").alias("path"), *more)

    def _answers(self) -> DataFrame:
        """tree, run and above: what each run of leaves finds at the levels above it."""
        coordinates = []
        for level in range(1, len(self.upper) + 1):
            index = div(F.col("run"), WIDTH ** (level - 1))
            at = F.struct(F.lit(level).alias("level"), div(index, WIDTH).alias("of_run"), (index % WIDTH).alias("place"), (F.col("run") % copies(level)).alias("copy"))
            coordinates.append(F.when(F.col("size") > WIDTH**level, at))
        asked = self.runs.select("tree", "run", F.explode(F.filter(F.array(*coordinates), lambda c: c.isNotNull())).alias("c")).select("tree", "run", "c.*")
        table = [t.select("tree", F.col("run").alias("of_run"), "level", "digests", F.explode(F.expr(f"sequence(0L, {copies(k) - 1}L)")).alias("copy")) for k, t in enumerate(self.upper, 1)]
        met = asked.join(reduce(DataFrame.unionByName, table), ["tree", "level", "of_run", "copy"])
        step = F.struct("level", *beside(F.col("digests"), F.col("place")))
        return met.groupBy("tree", "run").agg(F.sort_array(F.collect_list(step)).alias("above"))


def fold(digest: Column, path: Column) -> Column:
    """The root that a digest and its siblings give."""
    return F.aggregate(path, digest, lambda d, step: h(step["left"], d, step["right"]))


def siblings(path: Column) -> Column:
    """The digests of a proof, put together: level by level, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, source: str = "source", doc_id: str = "doc_id", carry: dict[str, Column] | None = None) -> DataFrame:
    """Columns doc_id, leaf, subroot, root, path (array of (level, left, right)), and those of carry, made of a row's own columns."""
    scratch = Scratch(docs.sparkSession)
    own = [F.col(f"`{c}`") for c in fields]
    rows = settled(docs, __leaf=leaf(*own))
    item = F.struct(F.col(f"`{doc_id}`").alias("doc_id"), *(c.alias(n) for n, c in (carry or {}).items()))
    rows = rows.select(tree_key(F.col(f"`{source}`")).alias("tree"), F.col("__leaf").alias("digest"), F.col(f"`{doc_id}`").alias("order"), item.alias("item"), F.monotonically_increasing_id().alias("tie"))
    trees = Trees(scratch.write(rows), scratch)
    order, item = F.col("tree").alias("order"), F.struct(F.col("tree").alias("of"), "size").alias("item")
    forest = Trees(trees.roots.select(F.lit("").alias("tree"), F.col("root").alias("digest"), order, item, F.lit(0).alias("tie")), scratch)
    top = forest.roots.first()  # one row, or none
    known = scratch.write(forest.paths().select(F.col("item.of").alias("tree"), "item.size", F.col("digest").alias("subroot"), F.lit(top["root"] if top else None).cast("string").alias("root"), F.col("path").alias("up")))
    found = trees.paths(known)
    return found.select("item.doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.concat("path", "up").alias("path"), *(F.col(f"item.{n}") for n in carry or {}))


def checked(docs: DataFrame, tampered: Column, **columns) -> DataFrame:
    """The manifest of docs, with each row's leaf (a column of its own columns) as it is found later: columns doc_id, leaf,
    subroot, root, proof_sha256 (of the siblings as recorded), folded_root (of the found leaf and these) and verified."""
    found = settled(manifest(docs, carry={"found": tampered}, **columns), folded_root=fold(F.col("found"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
