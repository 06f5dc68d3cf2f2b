"""Merkle manifest of a dataset by nested-struct rollup.

Every row is a leaf, a digest of its fields. The leaves of a source, in order of doc_id, are hashed in runs of
``FAN`` until one node, the source's subroot, is left; the subroots, in order of source, are hashed in the same
way to the root. A proof lists the siblings on the way from a leaf to the root.

A leaf's rank in its source, in base ``FAN``, is its way through the tree. ``DEPTH`` digits lie within a block of
FAN ** DEPTH leaves, the higher ones number the block. A block's rows meet once, dealt out by (source, block);
then the digit columns are grouped away one after the other, each group's children nested in a struct with
their common digest, without another shuffle. The digests of the blocks are the leaves of the next tier, and so
on, one tier for every DEPTH levels. Going down again, a block's nested struct meets its own proof (one row
each, under one key), transforms carry the siblings from the struct's top to its leaves, and an explode emits
one row per leaf. No task holds more than a block, however many rows a source has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from docketry.llm.common import in_order
from docketry.session import materialise

FAN = 3
#: Levels of a tier; a block has FAN ** DEPTH leaves at most.
DEPTH = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: One level of a proof: the digests to the left and to the right of a node in its run, put end to end.
PATH = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf(columns: dict[str, Column]) -> Column:
    """The digest of a row's fields, each "-" if null, otherwise its length in bytes, ":" and its value."""

    def one(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return digest(F.concat(*[one(c) for c in columns.values()]))


def leaves(docs: DataFrame, tampered: Column, tamper: Column) -> DataFrame:
    """(source, doc_id, leaf, tampered_leaf) of every row; where ``tampered`` holds, the text is ``tamper``'s."""
    fields = {c: F.col(c) for c in FIELDS}
    original = leaf(fields)
    changed = F.when(tampered & F.col("text").isNotNull() & (tamper != F.col("text")), leaf(fields | {"text": tamper}))
    return docs.select("source", "doc_id", original.alias("leaf"), changed.alias("changed")).select(
        "source", "doc_id", "leaf", F.coalesce("changed", "leaf").alias("tampered_leaf")
    )


def ranked(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """Add ``rank``, from 0 by ``order`` within ``group``, and ``n``, the rows of the group (nulls are a group).

    Rows are ranged by group and order, so a hot group is several ranges. What is summed per group are the
    sizes of its ranges: one row per group and range.
    """
    ranges = in_order(rows, group, *order, name="leaves")
    sizes = ranges.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col(group).alias("_group"),
        F.col("_range").alias("_of"),
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"),
        F.sum("_size").over(Window.partitionBy(group)).alias("n"),
    )
    within = Window.partitionBy(group, "_range").orderBy(*order)
    here = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_of"))
    return (
        ranges.withColumn("_place", F.row_number().over(within) - 1)
        .join(starts, here)
        .withColumn("rank", F.col("_place") + F.col("_start"))
        .drop("_range", "_of", "_place", "_start", "_group")
    )


def levels(n: Column) -> Column:
    """Levels above the leaves of a tree of ``n`` leaves: the least power of FAN that reaches ``n``."""
    found = F.lit(0)
    for k in range(39):
        found = found + (n > FAN**k).cast("int")
    return found


def nested(nodes: DataFrame, group: str, tier: int) -> DataFrame:
    """(group, block, levels, tree): the nodes of each block, nested level by level under its digest.

    ``nodes`` has group, rank, levels, digest and data. A level above the group's own levels has a single child and
    keeps its digest.
    """
    digits = [F.pmod(F.floor(F.col("rank") / FAN**k), F.lit(FAN)).cast("int").alias(f"_d{k}") for k in range(DEPTH)]
    block = F.floor(F.col("rank") / FAN**DEPTH)
    # one shuffle: every later grouping is by (group, block) and more
    rows = nodes.select(group, block.alias("block"), "levels", *digits, "digest", "data").repartition(group, "block")
    inner = F.struct("digest", "data").alias("node")
    rows = rows.select(group, "block", "levels", *[f"_d{k}" for k in range(DEPTH)], inner)
    for k in range(DEPTH):
        keys = [group, "block", "levels", *[f"_d{j}" for j in range(k + 1, DEPTH)]]
        children = F.transform(F.array_sort(F.collect_list(F.struct(F.col(f"_d{k}").alias("d"), "node"))), lambda x: x["node"])
        rows = rows.groupBy(*keys).agg(children.alias("children"))
        joined = digest(F.array_join(F.transform("children", lambda x: x["digest"]), ""))
        above = F.col("levels") > tier * DEPTH + k
        rows = rows.select(
            *keys, F.struct(F.when(above, joined).otherwise(F.col("children")[0]["digest"]).alias("digest"), "children").alias("node")
        )
    return rows.select(group, "block", "levels", F.col("node").alias("tree"))


def one_level_down(above: Column) -> Callable[[Column], Column]:
    """From (node, path) to the same of the node's children; levels not ``above`` the leaves add no siblings."""

    def below(x: Column) -> Column:
        children = x["node"]["children"]

        def one(child: Column, i: Column) -> Column:
            left = F.array_join(F.transform(F.slice(children, F.lit(1), i), lambda c: c["digest"]), "")
            right = F.array_join(F.transform(F.slice(children, i + 2, F.lit(FAN)), lambda c: c["digest"]), "")
            step = F.array(F.struct(left.alias("left"), right.alias("right")))
            path = F.when(above, F.concat(step, x["path"])).otherwise(x["path"])
            return F.struct(child.alias("node"), path.alias("path"))

        return F.transform(children, one)

    return below


def emitted(blocks: DataFrame, group: str, tier: int) -> DataFrame:
    """(group, block, levels, data, path, top): one row per node that ``nested`` put in, with its whole proof.

    ``blocks`` has group, block, levels, tree, and ``path`` and ``top`` of the block itself.
    """
    rows = blocks.withColumn("_at", F.array(F.struct(F.col("tree").alias("node"), F.col("path").alias("path"))))
    for k in reversed(range(DEPTH)):
        below = one_level_down(F.col("levels") > tier * DEPTH + k)
        rows = rows.withColumn("_at", F.flatten(F.transform("_at", below)))
    one = F.explode("_at").alias("_one")
    return rows.select(group, "block", "levels", "top", one).select(
        group, "block", "levels", "top", F.col("_one.node.data").alias("data"), F.col("_one.path").alias("path")
    )


def rolled_up(nodes: DataFrame, group: str) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of every tier, and (group, levels, digest) of every group's last node.

    ``nodes`` has group, rank, n, digest and data. Each tier is written once; the next one has FAN ** DEPTH times
    fewer rows. A group whose tree ends within a tier takes no part in the next.
    """
    nodes, tiers, tops = nodes.withColumn("levels", levels(F.col("n"))), [], None
    while True:
        tier = len(tiers)
        blocks = materialise(nested(nodes, group, tier), f"tier{tier}")
        tiers.append(blocks)
        ends = F.col("levels") <= DEPTH * (tier + 1)
        ended = blocks.filter(ends).select(group, "levels", F.col("tree.digest").alias("digest"))
        tops = ended if tops is None else tops.unionByName(ended)
        rest = blocks.filter(~ends)
        if rest.isEmpty():
            return tiers, tops
        rank = F.col("block").alias("rank")
        nodes = rest.select(group, rank, "levels", F.col("tree.digest").alias("digest"), F.struct(rank).alias("data"))


def handed_down(tiers: list[DataFrame], group: str, proofs: DataFrame) -> DataFrame:
    """(group, data, path, top): every leaf with its siblings from the first level on.

    ``proofs`` has, per group, its levels, the path from its last node on and whatever belongs to all its leaves,
    ``top``. A block's tree and proof become one row by grouping the two under the block's key.
    """
    last_tier = F.floor((F.greatest("levels", F.lit(1)) - 1) / DEPTH)
    upper = None
    for tier in reversed(range(len(tiers))):
        blocks = tiers[tier]
        tree, path, top = (
            F.lit(None).cast(kind) for kind in (blocks.schema["tree"].dataType, PATH, proofs.schema["top"].dataType)
        )
        trees = blocks.select(group, "block", "levels", "tree", path.alias("path"), top.alias("top"))
        none = F.lit(None).cast("int").alias("levels")
        ways = proofs.filter(last_tier == tier).select(group, F.lit(0).cast("long").alias("block"), none, tree.alias("tree"), "path", "top")
        if upper is not None:
            ways = ways.unionByName(upper.select(group, F.col("data.rank").alias("block"), none, tree.alias("tree"), "path", "top"))
        both = trees.unionByName(ways).groupBy(group, "block")
        met = both.agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("levels", "tree", "path", "top")])
        upper = emitted(met, group, tier)
    return upper


def proofs(docs: DataFrame, tampered: Column, tamper: Column) -> DataFrame:
    """(source, doc_id, leaf, tampered_leaf, path, subroot, root) of every row of ``docs``.

    ``path`` has one entry per level from the leaf to the root, with the digests on either side of the node. Fields
    are nulls as "-"; a null source is a source and the first; null doc_ids come first in their source, and
    rows of one doc_id are in order of their leaf, so repeated rows, whose leaves are equal, stand side by side.
    Columns beside ``FIELDS`` take no part. An empty table gives an empty result.
    """
    rows = ranked(leaves(docs, tampered, tamper), "source", "doc_id", "leaf")
    data = F.struct("doc_id", "leaf", "tampered_leaf").alias("data")
    tiers, tops = rolled_up(rows.select("source", "rank", "n", F.col("leaf").alias("digest"), data), "source")
    subroots = ranked(tops.withColumn("whole", F.lit(0)), "whole", "source")
    data = F.struct("source", "levels", F.col("digest").alias("subroot")).alias("data")
    root_tiers, roots = rolled_up(subroots.select("whole", "rank", "n", "digest", data), "whole")
    root_proof = roots.select("whole", "levels", F.array().cast(PATH).alias("path"), F.col("digest").alias("top"))
    sources = handed_down(root_tiers, "whole", root_proof).select(
        "data.source", "data.levels", "path", F.struct("data.subroot", F.col("top").alias("root")).alias("top")
    )
    return handed_down(tiers, "source", materialise(sources, "sources")).select("source", "data.*", "path", "top.*")


def proof_digest(path: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def folded(path: Column, start: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, start, lambda x, s: digest(F.concat(s["left"], x, s["right"])))


def verified(docs: DataFrame, tampered: Column, tamper: Column) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): every row held against the root.

    The proofs are those of the untampered rows; ``folded_root`` starts at the leaf of the row as tampered with.
    """
    rows = proofs(docs, tampered, tamper)
    rows = rows.withColumns({"proof_sha256": proof_digest(F.col("path")), "folded_root": folded(F.col("path"), F.col("tampered_leaf"))})
    return rows.select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )
