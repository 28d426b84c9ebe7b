"""Merkle manifest of a table: a tree for each source over its rows, a tree over the sources, and a proof for every row.

Leaves are numbered within their source by row_number and grouped by floor division by the fanout; sorted arrays of
children are hashed into parents, level by level, until each source has one node left, its subroot; the subroots, in the order of
their sources, are numbered and grouped likewise until the root is left. Going down again, each level joins its nodes with the
arrays of their parents and adds the siblings to the path that the parent has to the root; so a path's upper part is
joined once for each node, not once for each row, and work shrinks by the fanout from level to level.

No task holds a source: rows are dealt by ranges of (source, id), numbered within a range, and moved on by the counts of the
ranges before. Only slim rows (id, digest, place) are moved, never texts. Every level is written to the shared folder. The driver sees one
number a tree, its largest count.

Defined results: a null in a column is `-`, an empty text `0:`; null ids stand first in a source and are never tampered with; rows that
share an id are ordered by their digests, equal rows each are leaves and get the results of their places; a source may be null or empty, which
are two; an empty table gives no rows; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, grows

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(c: Column) -> Column:
    """A value with its length in bytes before it, or a dash."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def tampered(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def numbered(scratch: Scratch, rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with idx, the place from 0 within `tree` in the order of the columns, and n, the rows of the tree."""
    spark = scratch.spark
    slices = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = scratch.keep(rows.repartitionByRange(slices, "tree", *order).withColumn("slice", F.spark_partition_id()))
    held = scratch.keep(dealt.groupBy("tree", "slice").agg(F.count("*").alias("m")))
    before = F.sum("m").over(Window.partitionBy("tree").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    held = held.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("n", F.sum("m").over(Window.partitionBy("tree")))
    nth = F.row_number().over(Window.partitionBy("tree", "slice").orderBy(*order))
    out = dealt.withColumn("nth", nth).join(grows(held), ["tree", "slice"]).withColumn("idx", F.col("before") + F.col("nth") - 1)
    return scratch.keep(out.drop("slice", "m", "before", "nth"))


def levels(scratch: Scratch, leaves: DataFrame, fanout: int) -> list[DataFrame]:
    """The levels of all trees, leaves first: (tree, idx, n, hash, children); n is the number of a level's nodes in the tree."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    out = [leaves]
    while most > 1:
        below = out[-1].where("n > 1")
        child = F.sort_array(F.collect_list(F.struct("idx", "hash")))  # a run of at most `fanout` nodes
        up = below.groupBy("tree", F.floor(F.col("idx") / fanout).alias("idx")).agg(child.alias("run"), F.first("n").alias("n"))
        up = up.select("tree", "idx", F.ceil(F.col("n") / fanout).alias("n"), F.transform("run", lambda x: x["hash"]).alias("children"))
        out.append(scratch.keep(up.withColumn("hash", F.sha2(F.array_join("children", "").cast("binary"), 256))))
        most = -(-most // fanout)
    return out


def paths(scratch: Scratch, trees: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """The leaves with `path`, what stands before and after a node at each level up to the root, and what tops (tree, path, known) know of their tree."""
    above = None
    for level in reversed(trees):
        found = level.where("n <= 1").join(grows(tops), "tree")
        if above is not None:
            up = above.select("tree", F.col("idx").alias("parent"), F.col("children").alias("run"), F.col("path").alias("rest"), "known")
            mine = level.where("n > 1").withColumn("parent", F.floor(F.col("idx") / fanout)).join(grows(up), ["tree", "parent"])
            at = (F.col("idx") % fanout).cast("int")
            beside = F.struct(F.array_join(F.slice("run", F.lit(1), at), "").alias("before"), F.array_join(F.slice("run", at + 2, F.lit(fanout)), "").alias("after"))
            mine = mine.withColumn("path", F.concat(F.array(beside), F.col("rest"))).drop("parent", "run", "rest")
            found = found.unionByName(mine.select(*found.columns))
        above = found if level is trees[0] else scratch.keep(found)
    return above


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path come to."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]).cast("binary"), 256))


def manifest(spark: SparkSession, docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, subroot, root, path (array of what stands before and after), proof_sha256, folded_root, verified of every row.

    Where 5 divides the crc32 of an id, the text's capitals are lowered before its leaf is checked against the manifest's proof.
    """
    scratch = Scratch(spark)
    told = {f: field(F.col(f)) for f in FIELDS}
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    # a tree for each source; null sorts before the empty name, and names by their bytes
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), digest(*told.values()).alias("hash"),
        F.when(hit, digest(*(told | {"text": field(tampered(F.col("text").cast("string")))}).values())).alias("other"))
    rows = scratch.keep(rows)
    leaves = numbered(scratch, rows, ["doc_id", "hash", "row"])
    trees = levels(scratch, leaves, fanout)
    subroots = trees[0].where("n = 1").select("tree", "hash")
    for level in trees[1:]:
        subroots = subroots.unionByName(level.where("n = 1").select("tree", "hash"))
    named = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "hash")
    tops = levels(scratch, numbered(scratch, named, ["of"]), fanout)
    start = F.expr("cast(array() as array<struct<before:string,after:string>>)")
    each = paths(scratch, tops, tops[-1].select("tree", start.alias("path"), F.col("hash").alias("known")), fanout)
    each = scratch.keep(each.select(F.col("of").alias("tree"), "path", F.struct(F.col("hash").alias("subroot"), F.col("known").alias("root")).alias("known")))
    out = paths(scratch, trees, each, fanout)
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "").cast("binary"), 256)
    out = out.select("doc_id", F.col("hash").alias("leaf"), "known.subroot", "known.root", "path", proof.alias("proof_sha256"), folded(F.coalesce("other", "hash"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
