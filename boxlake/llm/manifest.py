"""Merkle manifest of a dataset, and proofs by descent through content-addressed records.

Each row is a leaf, the digest of its fields. The leaves of a group, in order, form a tree:
every `FANOUT` consecutive nodes become their digest until one is left, the group's subroot.
Subroots, in order of the group, form a tree the same way; its top is the root. Every inner
node is kept as a record, its digest and the digests of its children.

A proof comes from the records: requests start at the root and go down level by level,
looking up the node's digest and taking the child that the next digit of the leaf's rank
(base `FANOUT`) names. The children not taken are collected on the way as one segment, left
and right of the path, and the segments reversed are the proof from leaf to root. All
requests below a node share its row of the descent: only the last step has one row for each
leaf, so proofs are never shuffled whole.

Groups of any size spread over the cluster: ranks come from ranges of the sorted leaves,
a level groups at most `FANOUT` rows, and only the root and two heights come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlake.llm.common import fold, ranked
from boxlake.session import cut_lineage

FANOUT = 16
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEGMENTS = "array<struct<left:string,right:string>>"


@dataclass
class Manifest:
    """`leaves`: the key, the other columns asked for, `grp` (the group, encoded), `leaf`,
    `pos` (its rank in the group, from 0) and `n` (leaves of the group). `groups`: `grp`,
    `subroot`, `n`, `grp_pos` (rank of the group), `n_groups`. `records`: `digest` and `children` of every
    inner node, each content once. `root`: the root's digest, None without rows. `heights`:
    levels of the largest group's tree and of the tree of groups."""

    leaves: DataFrame
    groups: DataFrame
    records: DataFrame
    root: str | None
    heights: tuple[int, int]


def encoded(value: Column) -> Column:
    """A field as it is hashed: its UTF-8 bytes counted, `:`, and itself; `-` for null."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(fields: list[Column]) -> Column:
    return digest(*[encoded(f) for f in fields])


def height(n: int) -> int:
    """Levels above `n` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def _height(n: Column) -> Column:
    """`height` of a count, for counts up to 2^60."""
    return sum((F.when(n > FANOUT**k, 1).otherwise(0) for k in range(15)), F.lit(0))


def tree(nodes: DataFrame, levels: int) -> tuple[DataFrame, list[DataFrame]]:
    """From `grp, pos, n, digest`: `grp, digest` of each group's top, and the records
    (`digest, children`) of each level."""
    records, tops = [], nodes.filter("n = 1").select("grp", "digest")
    for _ in range(levels):
        runs = nodes.filter("n > 1").groupBy("grp", F.expr(f"pos div {FANOUT}").alias("pos"))
        made = runs.agg(
            F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda c: c["digest"]).alias("children")
        )
        made = made.select("grp", "pos", F.ceil(F.col("n") / FANOUT).alias("n"), digest(F.array_join("children", "")).alias("digest"), "children")
        nodes = cut_lineage(made)
        records.append(nodes.select("digest", "children"))
        tops = tops.union(nodes.filter("n = 1").select("grp", "digest"))
    return tops, records


def build(rows: DataFrame, fields: list[str] = FIELDS, group: str = "source", key: str = "doc_id", **carried: Column) -> Manifest:
    """The manifest of `rows`. Leaves hash `fields` in this order, as text. Groups ascend by
    `group`, null first, and leaves by `key`, null first; rows that repeat a key ascend by
    leaf, and copies of a row are leaves of their own. `carried` are more columns of the
    leaves, computed from the row."""
    leaves = rows.select(
        F.col(key).alias("key"),
        F.col(group).alias("grp_value"),
        leaf([F.col(f) for f in fields]).alias("leaf"),
        *[value.alias(name) for name, value in carried.items()],
    )
    leaves = leaves.withColumn("grp", encoded(F.col("grp_value")))
    order = [F.col("key").asc_nulls_first(), F.col("leaf")]
    leaves = cut_lineage(ranked(leaves, ["grp"], order, "pos", "n"))
    levels = height(leaves.agg(F.max("n")).first()[0] or 0)
    tops, records = tree(leaves.select("grp", "pos", "n", F.col("leaf").alias("digest")), levels)

    groups = leaves.filter("pos = 0").select("grp", "grp_value", "n").join(tops.withColumnRenamed("digest", "subroot"), "grp")
    groups = groups.withColumn("_all", F.lit(0))
    groups = cut_lineage(ranked(groups, ["_all"], [F.col("grp_value").asc_nulls_first()], "grp_pos", "n_groups").drop("_all", "grp_value"))
    above = height(groups.count())
    nodes = groups.select(F.lit("").alias("grp"), F.col("grp_pos").alias("pos"), F.col("n_groups").alias("n"), F.col("subroot").alias("digest"))
    top, more = tree(nodes, above)
    root = top.first()
    kept = rows.sparkSession.createDataFrame([], "digest string, children array<string>")
    for part in [*records, *more]:
        kept = kept.union(part)
    kept = cut_lineage(kept.dropDuplicates(["digest"]))
    return Manifest(leaves.drop("grp_value"), groups, kept, root["digest"] if root else None, (levels, above))


def _step(children: Column, digit: Column) -> Column:
    """The children left and right of the one taken."""
    return F.struct(
        F.array_join(F.slice(children, F.lit(1), digit), "").alias("left"),
        F.array_join(F.slice(children, digit + 2, F.lit(FANOUT)), "").alias("right"),
    )


def _down(frontier: DataFrame, records: DataFrame) -> DataFrame:
    """Every child of the nodes of `frontier` (`grp, pos, digest, path`)."""
    met = frontier.join(records, "digest").select("grp", "pos", "path", "children", F.posexplode("children").alias("digit", "digest"))
    path = F.concat("path", F.array(_step(F.col("children"), F.col("digit"))))
    return met.select("grp", (F.col("pos") * FANOUT + F.col("digit")).alias("pos"), "digest", path.alias("path"))


def proofs(manifest: Manifest, wanted: Column | None = None) -> DataFrame:
    """The leaves (all, or those that `wanted` says) with `subroot` and `proof`, the segments
    `left, right` of every level from the leaf up: hashing `left`, the node and `right`, level
    by level, gives the root."""
    leaves = manifest.leaves if wanted is None else manifest.leaves.filter(wanted)
    levels, above = manifest.heights
    asked = None if wanted is None else cut_lineage(leaves.select("grp", "pos"))
    groups = manifest.groups.select("grp", "grp_pos", "subroot", "n")
    if asked is not None:
        groups = groups.join(asked.select("grp").distinct(), "grp", "left_semi")

    spark = manifest.leaves.sparkSession
    frontier = spark.createDataFrame([("", 0, manifest.root or "", [])], f"grp string, pos long, digest string, path {SEGMENTS}")
    for level in range(above, 0, -1):
        frontier = _down(frontier, manifest.records)
        if asked is not None:
            below = groups.select(F.expr(f"grp_pos div {FANOUT ** (level - 1)}").alias("pos")).distinct()
            frontier = frontier.join(below, "pos", "left_semi")
        frontier = cut_lineage(frontier.select("grp", "pos", "digest", "path"))
    met = groups.join(frontier.select(F.col("pos").alias("grp_pos"), "path"), "grp_pos")
    tops = cut_lineage(met.select("grp", F.lit(0).cast("long").alias("pos"), F.col("subroot").alias("digest"), "path", "subroot", _height(F.col("n")).alias("h")))

    nodes = None  # of the level in hand, of groups that high or higher
    for level in range(levels, 1, -1):
        starts = tops.filter(F.col("h") == level).select("grp", "pos", "digest", "path")
        nodes = _down(starts if nodes is None else nodes.union(starts), manifest.records)
        if asked is not None:
            below = asked.select("grp", F.expr(f"pos div {FANOUT ** (level - 1)}").alias("pos")).distinct()
            nodes = nodes.join(below, ["grp", "pos"], "left_semi")
        nodes = cut_lineage(nodes.select("grp", "pos", "digest", "path"))
    starts = tops.filter("h = 1").select("grp", "pos", "digest", "path")
    runs = (starts if nodes is None else nodes.union(starts)).join(manifest.records, "digest").select("grp", "pos", "path", "children")
    single = tops.filter("h = 0").select("grp", "pos", "path", F.lit(None).cast("array<string>").alias("children"))

    asking = leaves.groupBy("grp", F.expr(f"pos div {FANOUT}").alias("pos")).agg(
        F.collect_list(F.struct(F.expr(f"pos % {FANOUT}").cast("int").alias("digit"), *[c for c in leaves.columns if c != "grp"])).alias("ask")
    )
    met = runs.union(single).join(asking, ["grp", "pos"]).select("grp", "path", "children", F.explode("ask").alias("a"))
    last = F.array(_step(F.col("children"), F.col("a.digit")))
    path = F.when(F.col("children").isNull(), F.col("path")).otherwise(F.concat("path", last))
    out = met.select("grp", F.col("a.*"), F.reverse(path).alias("proof")).drop("digit")
    return out.join(manifest.groups.select("grp", "subroot"), "grp").select(*leaves.columns, "subroot", "proof")


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, start, lambda node, s: digest(s["left"], node, s["right"]))


def siblings(proof: Column) -> Column:
    """All digests of a proof, from the leaf up, in one text."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def tampered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def verify(docs: DataFrame, every: int = 5) -> DataFrame:
    """`doc_id, leaf, subroot, root, proof_sha256, folded_root, verified` for each row of
    `docs` (see `FIELDS`). Where `every` divides crc32(doc_id as text), the letters A-Z of the
    text are lower-cased before the leaf is folded again with its untampered proof; rows with
    a null id or text aren't tampered with. Null and empty fields, copies of rows, long texts
    and sources of any size are leaves like others; other columns don't count. Without rows
    the result is empty."""
    changed = F.when(fold(F.col("doc_id"), every) == 0, tampered(F.col("text"))).otherwise(F.col("text"))
    again = leaf([changed if f == "text" else F.col(f) for f in FIELDS])
    found = build(docs, again=again)
    proven = proofs(found).select(
        F.col("key").alias("doc_id"),
        "leaf",
        "subroot",
        F.lit(found.root).cast("string").alias("root"),
        digest(siblings(F.col("proof"))).alias("proof_sha256"),
        folded(F.col("again"), F.col("proof")).alias("folded_root"),
    )
    return proven.withColumn("verified", F.col("folded_root") == F.col("root"))
