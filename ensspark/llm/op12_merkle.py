"""Merkle manifest of a dataset: a tree of digests per group of rows, a tree over their roots, proofs for every row.

A leaf is the SHA-256 of a row's fields. In each group the leaves ascend by key; while several nodes remain, every
eight consecutive ones become their digest. The groups' roots, ordered by group, give the root in the same way.

Positions come from sampled ranges: sorted leaves are landed with their place in their partition, and only one count
per partition and group is summed up. A superblock is 8^4 consecutive nodes of one tree. Superblocks are reduced on
their own; their roots are the nodes of the next, 4096 times smaller layer, and so on until each tree has one node.
Then the exchange runs downwards: the nodes of a superblock and the outer siblings that all of them need (one row,
from the layer above) are cogrouped by superblock; one call finishes the local reduction, joins the proofs and folds
the claimed leaves up to the root. No task sees more than a superblock, however large a group is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ensspark.llm.common import landed, prepared, table
from ensspark.operators.numbering import number_all

FAN = 8  # fixed value of the contract
HEIGHT = 4  # levels of a superblock
BLOCK = FAN**HEIGHT
NODES = "tree long, pos long, node string, size long"
OUTER = "tree long, block long, places array<int>, others array<string>, subroot string, root string"
PROOFS = "key string, leaf string, folded_root string, proof_sha256 string, subroot string, root string"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(columns: Sequence[Column]) -> Column:
    """Digest of a row's fields: each ``-`` if null, else its UTF-8 bytes, a colon and the value."""
    texts = [c.cast("string") for c in columns]
    fields = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*fields), 256)


def small_letters(text: Column) -> Column:
    """A-Z as a-z, nothing else changes."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


@dataclass
class Manifest:
    """Landed tables of a dataset's trees.

    ``leaves(tree, pos, key, leaf, claim, size, block)``; ``layers``: nodes of the groups' trees above their leaves, the last
    one with a node per tree; ``tops``: the same of the tree over the groups; ``root`` is null for an empty dataset.
    """

    leaves: DataFrame
    groups: DataFrame
    layers: list[DataFrame]
    tops: list[DataFrame]
    root: str | None


def levels_of(size: int) -> int:
    """How often every eight nodes become one until one remains."""
    n = 0
    while size > 1:
        size, n = -(-size // FAN), n + 1
    return n


def reduced(nodes: list[str], size: int) -> list[list[str]]:
    """Nodes of a superblock level by level; ``size`` counts the whole layer of the tree."""
    levels = [nodes]
    for _ in range(min(HEIGHT, levels_of(size))):
        below = levels[-1]
        levels.append([digest("".join(below[i : i + FAN])) for i in range(0, len(below), FAN)])
    return levels


def siblings(levels: list[list[str]]) -> list[list[str]]:
    """Of each node of each level but the top: the digests of the others in its run."""
    found = []
    for nodes in levels[:-1]:
        runs = [nodes[i : i + FAN] for i in range(0, len(nodes), FAN)]
        found.append(["".join(run[:k] + run[k + 1 :]) for run in runs for k in range(len(run))])
    return found


def fold(node: str, places: Sequence[int], others: Sequence[str]) -> str:
    """The root that a node and its siblings lead to."""
    for place, run in zip(places, others, strict=True):
        cut = 64 * place
        node = digest(run[:cut] + node + run[cut:])
    return node


def _up(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("pos")
    size, first = int(group["size"].iloc[0]), int(group["pos"].iloc[0])
    top = reduced(group["node"].tolist(), size)[-1]
    return pd.DataFrame({"tree": group["tree"].iloc[0], "pos": first // BLOCK, "node": top, "size": -(-size // BLOCK)})


def _paths(group: pd.DataFrame, outer: pd.DataFrame):
    """For each node of a superblock its places and siblings up to the root."""
    levels = reduced(group["node"].tolist(), int(group["size"].iloc[0]))
    near = siblings(levels)
    far_places, far = list(outer["places"].iloc[0]), list(outer["others"].iloc[0])
    for i in range(len(group)):
        at, places, others = i, [], []
        for runs in near:
            places.append(at % FAN)
            others.append(runs[at])
            at //= FAN
        yield places + far_places, others + far


def _down(group: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """What the superblocks below this layer's nodes need."""
    group = group.sort_values("pos")
    paths = list(_paths(group, outer))
    return pd.DataFrame(
        {"tree": group["tree"], "block": group["pos"], "places": [p for p, _ in paths], "others": [o for _, o in paths]}
    ).assign(subroot=outer["subroot"].iloc[0], root=outer["root"].iloc[0])


def _prove(group: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """Local reduction, joined proofs and folded claims of a superblock of leaves."""
    group = group.sort_values("pos")
    folded, proofs = [], []
    for claim, (places, others) in zip(group["claim"].tolist(), _paths(group, outer), strict=True):
        folded.append(fold(claim, places, others))
        proofs.append(digest("".join(others)))
    return pd.DataFrame({"key": group["key"], "leaf": group["node"], "folded_root": folded, "proof_sha256": proofs}).assign(
        subroot=outer["subroot"].iloc[0], root=outer["root"].iloc[0]
    )


def _layers(nodes: DataFrame, size: int, name: str) -> list[DataFrame]:
    """All layers above the nodes of some trees, the largest of which has ``size`` nodes; the last has one node per tree."""
    found = []
    while size > 1 or not found:
        block = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK)).select("block", "tree", "pos", "node", "size")
        nodes = landed(block.groupBy("tree", "block").applyInPandas(_up, NODES), name)
        found.append(nodes)
        size = -(-size // BLOCK)
    return found


def _exchange(nodes: DataFrame, outer: DataFrame, step, schema: str) -> DataFrame:
    """Nodes and the outer row of their superblock, cogrouped."""
    blocks = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK))
    return blocks.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(step, schema)


def built(rows: DataFrame, key: str = "doc_id", group: str = "lang", columns: Sequence[str] = COLUMNS, claim: Column | None = None) -> Manifest:
    """Trees over all rows; ``claim`` is a leaf that somebody states for the row (null: the row's own).

    Groups ascend bytewise, null first; leaves by key, null first, rows with equal keys by their leaf. Repeated rows are
    leaves of their own. Nulls and empty texts are fields like others. An empty table has no root. Columns not
    named in ``columns`` have no part.
    """
    leaf = leaf_of([F.col(c) for c in columns])
    base = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("group"),
        F.col(key).alias("key"), leaf.alias("leaf"), (F.lit(None).cast("string") if claim is None else claim).alias("claim"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = ["group", "key", "leaf", "row"]
    dealt = landed(base, "merkle-leaves").repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = landed(dealt.withColumn("at", F.monotonically_increasing_id()), "merkle-sorted").withColumn("part", F.shiftright("at", 33))
    runs = landed(dealt.groupBy("group", "part").agg(F.min("at").alias("first"), F.count("*").alias("n")), "merkle-runs")
    groups = number_all(runs.groupBy("group").agg(F.sum("n").alias("size")), "tree", ["group"]).withColumn("tree", F.col("tree") - 1)
    groups = landed(groups, "merkle-groups")
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select("group", "part", (earlier - F.col("first")).alias("shift")).join(groups, "group")
    leaves = dealt.join(starts, ["group", "part"]).select(
        "tree", (F.col("at") + F.col("shift")).alias("pos"), "key", "leaf", F.coalesce("claim", "leaf").alias("claim"), "size"
    )
    trees, largest = groups.agg(F.count("*"), F.max("size")).first()
    layers = _layers(leaves.select("tree", "pos", F.col("leaf").alias("node"), "size"), largest or 0, "merkle-nodes")
    subroots = layers[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), "node", F.lit(trees).cast("long").alias("size"))
    tops = [subroots, *_layers(subroots, trees, "merkle-tops")]
    top = tops[-1].first()
    return Manifest(leaves, groups, layers, tops, top.node if top else None)


def proven(manifest: Manifest) -> DataFrame:
    """Every leaf's proof and where its claim leads: ``(key, leaf, subroot, root, proof_sha256, folded_root, verified)``."""
    root = F.lit(manifest.root).cast("string").alias("root")
    none = F.array().cast("array<int>").alias("places"), F.array().cast("array<string>").alias("others")
    outer = manifest.tops[-1].select("tree", F.col("pos").alias("block"), *none, F.lit(None).cast("string").alias("subroot"), root)
    for nodes in reversed(manifest.tops[:-1]):
        outer = _exchange(nodes, outer, _down, OUTER)
    last = manifest.layers[-1].select("tree", F.col("node").alias("own"))
    outer = outer.select(F.col("block").alias("tree"), F.lit(0).cast("long").alias("block"), "places", "others", "root").join(last, "tree")
    outer = landed(outer.select("tree", "block", "places", "others", F.col("own").alias("subroot"), "root"), "merkle-outer")
    for nodes in reversed(manifest.layers[:-1]):
        outer = landed(_exchange(nodes, outer, _down, OUTER), "merkle-outer")
    # pandas would turn a nullable integer into a float: keys travel as text
    nodes = manifest.leaves.select("tree", "pos", F.col("key").cast("string").alias("key"), F.col("leaf").alias("node"), "claim", "size")
    found = _exchange(nodes, outer, _prove, PROOFS)
    key = F.col("key").cast(manifest.leaves.schema["key"].dataType).alias("key")
    return found.select(key, "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents; a third of them (by their id's crc32) is tampered with: small letters for capital ones."""
    docs = table(prepared(spark), sf_dir, "documents", *COLUMNS)
    other = leaf_of([small_letters(F.col(c)) if c == "text" else F.col(c) for c in COLUMNS])
    claim = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, other)
    return proven(built(docs, claim=claim)).withColumnRenamed("key", "doc_id")


def _oracle(levels: int = 8, top_levels: int = 4) -> str:
    """SQL with a table of nodes per level: up to 8^8 rows in a group, 8^4 groups."""
    enc = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(enc(c) for c in (*COLUMNS[:-1], text)) + ")"
    small = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    polynomial = 0xEDB88320
    bits = f"list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * {polynomial}))"
    codes = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda z: CAST(ascii(z) AS BIGINT))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: {bits}), 4294967295)"
    parts = [
        f"l AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {leaf('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(small)} END AS claim FROM documents)",
        "n0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM l)",
    ]

    def level(nodes: str, up: str, sides: str) -> list[str]:
        side = "CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER (PARTITION BY g, p // 8 ORDER BY p ROWS BETWEEN {} AND {}), '') ELSE '' END AS {}"
        before, after = side.format("UNBOUNDED PRECEDING", "1 PRECEDING", "lo"), side.format("1 FOLLOWING", "UNBOUNDED FOLLOWING", "hi")
        above = "CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY p)) ELSE min(h) END AS h"
        return [
            f"{sides} AS (SELECT g, p, n, {before}, {after} FROM {nodes})",
            f"{up} AS (SELECT g, p // 8 AS p, {above}, (n + 7) // 8 AS n FROM {nodes} GROUP BY g, p // 8, n)",
        ]

    for k in range(levels):
        parts += level(f"n{k}", f"n{k + 1}", f"s{k}")
    parts.append(f"t0 AS (SELECT 0 AS g, g AS own, row_number() OVER (ORDER BY g) - 1 AS p, h, count(*) OVER () AS n FROM n{levels})")
    for k in range(top_levels):
        parts += level(f"t{k}", f"t{k + 1}", f"r{k}")
    parts.append(
        "f0 AS (SELECT doc_id, leaf, n0.g, n0.p, t0.p AS q, t0.h AS subroot, coalesce(claim, leaf) AS f, '' AS proof "
        "FROM n0 JOIN t0 ON t0.own = n0.g)"
    )
    for k in range(levels + top_levels):
        sides, key = (f"s{k}", f"s.g = x.g AND s.p = x.p // {8**k}") if k < levels else (f"r{k - levels}", f"s.p = x.q // {8 ** (k - levels)}")
        parts.append(
            f"f{k + 1} AS (SELECT doc_id, leaf, x.g, x.p, q, subroot, CASE WHEN s.n > 1 THEN sha256(lo || f || hi) ELSE f END AS f, "
            f"proof || lo || hi AS proof FROM f{k} x JOIN {sides} s ON {key})"
        )
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = t.h AS verified "
        f"FROM f{levels + top_levels}, t{top_levels} t"
    )


ORACLE = _oracle()
