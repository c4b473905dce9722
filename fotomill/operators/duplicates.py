"""Duplicate groups as the library forms them: like hashes with equal top bits, linked into components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotomill.functions.hashes import hamming, prefix_bucket
from fotomill.session import cut_and_measure, cut_lineage, hot_split_join


def hash_classes(items: DataFrame, record_id: str, hash_col: str, burst: str) -> DataFrame:
    """(hash, burst, rep, size): items with equal hash and burst as one class, named by its least id."""
    rows = items.filter(F.col(hash_col).isNotNull())
    return rows.groupBy(F.col(hash_col).alias("hash"), F.col(burst).alias("burst")).agg(F.min(record_id).alias("rep"), F.count("*").alias("size"))


def hash_pairs(classes: DataFrame, distance: int = 5, prefix_bits: int = 16) -> DataFrame:
    """(rep_a, rep_b, bits), rep_a < rep_b: pairs of classes with equal top bits and at most `distance` differing bits, not in the same burst.

    Within a prefix the remaining bits are cut into distance+1 blocks, one of which must be equal: pairs meet on prefix
    and block instead of on the prefix alone, and each is taken under the first block it shares.
    """
    rest, n = 64 - prefix_bits, distance + 1
    bounds = [rest * i // n for i in range(n + 1)]
    block = lambda h, i: F.shiftrightunsigned(h, bounds[i]).bitwiseAND(F.lit((1 << (bounds[i + 1] - bounds[i])) - 1))
    keys = F.array(*[F.struct(F.lit(i).alias("i"), block(F.col("hash"), i).alias("v")) for i in range(n)])
    keyed = classes.withColumn("p", prefix_bucket(F.col("hash"), prefix_bits)).withColumn("k", F.explode(keys))
    x = F.col("hash_a").bitwiseXOR(F.col("hash_b"))
    earlier = F.lit(False)
    for i in range(n - 1):
        earlier = earlier | ((F.col("i") > i) & (block(x, i) == 0))
    keyed = keyed.select("p", F.col("k.i").alias("i"), F.col("k.v").alias("v"), "hash", "burst", "rep")
    found = _meetings(keyed, ["p", "i", "v"], ["hash", "burst", "rep"], "rep").filter(
        (F.col("rep_a") < F.col("rep_b")) & (hamming(F.col("hash_a"), F.col("hash_b")) <= distance) & ~earlier
        & ~F.coalesce(F.col("burst_a") == F.col("burst_b"), F.lit(False))
    )
    return found.select("rep_a", "rep_b", hamming(F.col("hash_a"), F.col("hash_b")).alias("bits"))


def _meetings(rows: DataFrame, keys: list[str], values: list[str], spread: str, block: int = 4000) -> DataFrame:
    """Self-join of rows by keys, the values named _a and _b. Where a key has more than `block` rows, these are cut into blocks, and
    each block meets all rows of the key in a task of its own."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    total, largest = sizes.agg(F.sum("__n"), F.max("__n")).first()
    a = b = rows
    on = keys
    if (largest or 0) > block:
        large = sizes.filter(F.col("__n") > block).withColumn("__blocks", F.ceil(F.col("__n") / block).cast("int"))
        cut = hot_split_join(rows, large, keys, "__n", total, F.col(spread), "left")
        blocks = F.coalesce("__blocks", F.lit(1))
        a = cut.withColumn("__block", F.pmod(F.xxhash64(spread), blocks).cast("int"))
        b = cut.withColumn("__block", F.explode(F.sequence(F.lit(0), blocks - 1)))
        on = [*keys, "__block"]
    side = lambda df, s: df.select(*on, *[F.col(c).alias(f"{c}_{s}") for c in values])
    return side(a, "a").join(side(b, "b").hint("merge"), on)


def least_labels(pairs: DataFrame, a: str, b: str, max_rounds: int = 200) -> DataFrame:
    """(node, label): the least node reachable from each node of `pairs`.

    Labels spread along the edges and jump to the label of their label, so rounds grow slower than the longest
    chain; each round is written to the checkpoint folder. The edges of a hub, and the nodes that share a label, are spread over many tasks.
    """
    e = pairs.select(F.col(a).alias("u"), F.col(b).alias("v"))
    edges, seen = cut_and_measure(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), n=F.count(F.lit(1)))
    degree = cut_lineage(edges.groupBy("v").agg(F.count("*").alias("uses")))
    labels = cut_lineage(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("label")))
    for _ in range(max_rounds):
        near = hot_split_join(edges, labels.withColumnRenamed("node", "v"), "v", "uses", seen["n"], F.col("u"), counts=degree)
        nxt = labels.join(near.groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near")), "node")
        nxt = nxt.select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        holders = nxt.groupBy("label").agg(F.count("*").alias("uses"))
        moved = hot_split_join(nxt, jump, "label", "uses", seen["n"], F.col("node"), "left", holders)
        moved = moved.select("node", F.least("label", "far").alias("label"), "old")
        labels, now = cut_and_measure(moved, changed=F.coalesce(F.count_if(F.col("label") != F.col("old")), F.lit(0)))
        labels = labels.drop("old")
        if not now["changed"]:
            return labels
    raise RuntimeError(f"labels did not settle in {max_rounds} rounds")


def duplicate_groups(items: DataFrame, record_id: str, hash_col: str, burst: str, distance: int = 5, prefix_bits: int = 16) -> DataFrame:
    """(record_id, duplicate_group): items linked by hash_pairs(), directly or through others; 'dup-' and the least id of the component.

    Copies outside bursts are duplicates of one another without being paired.
    """
    classes = cut_lineage(hash_classes(items, record_id, hash_col, burst))
    labels = least_labels(hash_pairs(classes, distance, prefix_bits), "rep_a", "rep_b")
    grouped = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").filter("label IS NOT NULL OR (burst IS NULL AND size > 1)")
    grouped = grouped.select("hash", "burst", F.concat(F.lit("dup-"), F.coalesce("label", "rep")).alias("duplicate_group"))
    members = items.select(F.col(record_id).alias("record_id"), F.col(hash_col).alias("hash"), F.col(burst).alias("__b"))
    on = (members["hash"] == grouped["hash"]) & F.col("__b").eqNullSafe(grouped["burst"])
    return members.join(grouped, on).select("record_id", "duplicate_group")
