"""Problem 1: near-duplicate records, by adaptive multi-match prefixes over 64-bit fingerprints.

A fingerprint is a set of tokens: cut into m blocks, it has one token (block, value) a block. Two fingerprints that
differ in at most d bits differ in at most d blocks, so they share at least m - d tokens. Level l takes m = d + l tokens
as prefix and asks for l shared ones: the longer the prefix, the more tokens must agree before a pair is
verified, and the fewer candidates there are, at the price of more signatures (one per l-subset of the prefix).

What a prefix costs a document is what its signatures and its candidates cost together. The level at which the average
document is cheapest, by token frequencies over all documents, is where all of them start; the documents of a signature that so
many others have that a longer prefix is cheaper than the candidates go on to the next level, and so on. How many have a
signature is counted exactly, where its holders meet. So no group that is compared is larger than the level's
bound, whatever the data; only at the last level are larger ones left, and these are cut into blocks that many tasks compare.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotomill.functions.hashes import read_hash
from fotomill.session import cut_lineage, hot_split_join

#: Candidates that cost as much as one signature, which is made, shuffled and sorted.
CANDIDATES_A_SIGNATURE = 16.0
#: Signatures that one task sorts and compares.
TASK_ROWS = 400_000
#: Fingerprints of one block of a group that is compared block by block.
BLOCK_ROWS = 4_000


@dataclass(frozen=True)
class Level:
    """Prefix of `bits + shared` blocks, of which `shared` must agree."""

    shared: int
    bits: int

    @property
    def blocks(self) -> list[tuple[int, int]]:
        """(shift, width) of each block; widths differ by one at most and cover 64 bits."""
        m = self.bits + self.shared
        out, at = [], 0
        for i in range(m):
            width = 64 // m + (i < 64 % m)
            out.append((at, width))
            at += width
        return out

    def token(self, h: Column, i: int) -> Column:
        shift, width = self.blocks[i]
        return F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << width) - 1))

    @property
    def signatures(self) -> list[tuple[int, ...]]:
        return list(combinations(range(len(self.blocks)), self.shared))

    def bound(self, per_signature: float) -> int:
        """Holders of one signature above which the next level's additional signatures cost less than the candidates."""
        more = comb(self.bits + self.shared + 1, self.bits) - comb(self.bits + self.shared, self.bits)
        return max(1, int(per_signature * more))


#: A signature: the set of blocks above _HELD_AT, the values of its blocks below.
_HELD_AT, _HELD_BITS = 48, 12


def token_frequencies(hashes: DataFrame, levels: list[Level]) -> tuple[int, dict[int, list[np.ndarray]]]:
    """(documents, by level and block how often each value occurs), counted over all documents.

    The table has sum(2^width) entries, less than 6 000 for 5 bits and levels 2 to 7, however large the input is.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The counts of one task."""
        own = {(lv.shared, i): np.zeros(1 << w, np.int64) for lv in levels for i, (_, w) in enumerate(lv.blocks)}
        for batch in batches:
            h = batch.column("hash").to_numpy(zero_copy_only=False).view(np.uint64)
            for lv in levels:
                for i, (shift, w) in enumerate(lv.blocks):
                    own[lv.shared, i] += np.bincount(((h >> np.uint64(shift)) & np.uint64((1 << w) - 1)).astype(np.int64), minlength=1 << w)
        for (level, i), c in own.items():
            v = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), x, np.int32)) for x in (level, i)] + [pa.array(v.astype(np.int32)), pa.array(c[v])], ["l", "b", "v", "n"])

    rows = hashes.mapInArrow(count, "l int, b int, v int, n bigint").groupBy("l", "b", "v").agg(F.sum("n").alias("n")).collect()
    out = {lv.shared: [np.zeros(1 << w) for _, w in lv.blocks] for lv in levels}
    for r in rows:
        out[r["l"]][r["b"]][r["v"]] = r["n"]
    return int(out[levels[0].shared][0].sum()), out


def expected_candidates(n: int, counts: list[np.ndarray], shared: int) -> float:
    """How many other documents share `shared` tokens with a document, over all sets of so many blocks, on average and if blocks were independent."""
    meet = [float(((c / n) ** 2).sum()) for c in counts]
    sums = [1.0, *[0.0] * shared]
    for p in meet:
        for k in range(shared, 0, -1):
            sums[k] += sums[k - 1] * p
    return n * sums[shared]


def first_level(n: int, counts: dict[int, list[np.ndarray]], levels: list[Level], per_signature: float) -> int:
    """Index of the level whose signatures and expected candidates cost the average document least."""
    cost = [len(lv.signatures) + expected_candidates(n, counts[lv.shared], lv.shared) / per_signature for lv in levels]
    return int(np.argmin(cost))


def similar_hashes(
    hashes: DataFrame, bits: int = 5, per_signature: float = CANDIDATES_A_SIGNATURE, levels: tuple[int, ...] = (2, 3, 4, 5, 6, 7), block: int = BLOCK_ROWS
) -> DataFrame:
    """(hash_a, hash_b), hash_a < hash_b: all pairs of distinct fingerprints that differ in at most `bits` bits, once each.

    hashes: one BIGINT column `hash`, distinct and not null. per_signature: candidates that weigh as much as a
    signature; it moves work between signatures and verification and never changes the result, nor do `levels` (consecutive numbers)
    and `block`. Crowded regions take longer prefixes; what is still crowded at the last level is compared block by block.

    A job a level: the first has all documents, each further one those of crowded regions alone.
    """
    if bits + max(levels) > _HELD_BITS:
        raise ValueError(f"bits + the longest level must be at most {_HELD_BITS}")
    lvs = [Level(s, bits) for s in levels]
    n, counts = token_frequencies(hashes, lvs)
    none = hashes.select(F.col("hash").alias("hash_a"), F.col("hash").alias("hash_b")).limit(0)
    if n < 2:
        return none
    links, docs = [], hashes
    for lv in lvs[first_level(n, counts, lvs, per_signature) :]:
        met = cut_lineage(_meetings(docs, n, lv, lv.bound(per_signature)))
        links.append(met.filter("b IS NOT NULL").select(F.col("a").alias("hash_a"), F.col("b").alias("hash_b")))
        crowded = met.filter("b IS NULL")
        if lv is lvs[-1]:
            links.append(_by_blocks(crowded.select("sig", F.col("a").alias("hash")), lv, block))
            break
        docs = cut_lineage(crowded.select(F.col("a").alias("hash")).distinct())
        n = docs.count()
        if n < 2:
            break
    found = reduce(DataFrame.unionByName, links)
    # A pair may meet at two levels, where both of its documents went on.
    return found if len(links) == 1 else found.distinct()


def _meetings(docs: DataFrame, n: int, level: Level, bound: int) -> DataFrame:
    """(a, b, sig): the pairs a < b of docs within the level's bits that meet under a signature of at most `bound` holders;
    and (a, null, sig) for each holder of any other signature.

    The number of tasks follows the number of signatures, so that a task sorts as much at any size. A signature with many holders passes its task as a
    stream that keeps no more than `bound` of them.
    """
    sig = docs.mapInArrow(_signer(level), "sig bigint, hash bigint")
    tasks = max(1, -(-n * len(level.signatures) // TASK_ROWS))
    return sig.repartition(tasks, "sig").sortWithinPartitions("sig").mapInArrow(_verifier(level, bound), "a bigint, b bigint, sig bigint")


def _signer(level: Level):
    """The signatures of each fingerprint; plain numpy over Arrow batches."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("hash")
            h = column.to_numpy(zero_copy_only=False).view(np.uint64)
            tokens = [((h >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in level.blocks]
            for c in level.signatures:
                sig, at = np.full(len(h), sum(1 << i for i in c) << _HELD_AT, np.int64), 0
                for i in c:
                    sig |= tokens[i] << at
                    at += level.blocks[i][1]
                yield pa.RecordBatch.from_arrays([pa.array(sig), column], ["sig", "hash"])

    return sign


def _verifier(level: Level, bound: int):
    """Compares the holders of each signature, which come in its order."""

    def within(sig: np.ndarray, h: np.ndarray, start: np.ndarray, size: np.ndarray):
        """Pairs within groups of at most `bound`: first those of neighbours, then of second neighbours and so on."""
        many = size > 1
        left = np.repeat(size[many], size[many]) - 1
        first = np.repeat(start[many], size[many])
        at = first + (step := np.arange(len(first)) - np.repeat(np.cumsum(size[many]) - size[many], size[many]))
        left = left - step
        found = []
        for d in range(1, int(size.max(initial=1))):
            at = at[left >= d]
            left = left[left >= d]
            near = np.bitwise_count(h[at] ^ h[at + d]) <= level.bits
            found.append(np.stack([at[near], at[near] + d]))
        if not found:
            return None
        i, j = np.concatenate(found, axis=1)
        x, held = h[i] ^ h[j], sig[i] >> _HELD_AT
        # A pair is taken where it meets first: no block left of the signature's last one is shared beside the signature's own.
        same, last = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for k, (shift, width) in enumerate(level.blocks):
            same |= ((x >> np.uint64(shift)) & np.uint64((1 << width) - 1) == 0).astype(np.int64) << k
            last[(held >> k) & 1 == 1] = k
        own = same & ((1 << last) - 1) & ~held == 0
        a, b = h[i[own]].view(np.int64), h[j[own]].view(np.int64)
        return np.minimum(a, b), np.maximum(a, b), sig[i[own]]

    def rows(a, b, sig):
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a), none if b is None else pa.array(b), pa.array(sig)], ["a", "b", "sig"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_sig, kept, crowded = np.zeros(0, np.int64), np.zeros(0, np.uint64), None

        def settled(sig, h):
            """What whole groups give."""
            start = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.zeros(0, np.int64)
            size = np.diff(np.append(start, len(sig)))
            big = np.repeat(size > bound, size)
            if big.any():
                yield rows(h[big].view(np.int64), None, sig[big])
            pairs = within(sig, h, start[size <= bound], size[size <= bound])
            if pairs is not None and len(pairs[0]):
                yield rows(*pairs)

        for batch in batches:
            sig = np.concatenate([kept_sig, batch.column("sig").to_numpy(zero_copy_only=False)])
            h = np.concatenate([kept, batch.column("hash").to_numpy(zero_copy_only=False).view(np.uint64)])
            if crowded is not None:
                more = sig == crowded
                if more.any():
                    yield rows(h[more].view(np.int64), None, sig[more])
                sig, h = sig[~more], h[~more]
            if not len(sig):
                kept_sig, kept = sig, h
                continue
            last = int(np.searchsorted(sig, sig[-1]))
            yield from settled(sig[:last], h[:last])
            crowded = None
            if len(sig) - last > bound:
                crowded = sig[-1]
                yield rows(h[last:].view(np.int64), None, sig[last:])
                last = len(sig)
            kept_sig, kept = sig[last:], h[last:]
        yield from settled(kept_sig, kept)

    return run


def _by_blocks(crowded: DataFrame, level: Level, block: int) -> DataFrame:
    """(hash_a, hash_b) of the pairs that share a signature of `crowded` (sig, hash), which is held by too many for one task.

    Each group is cut into blocks of about `block` rows by hash; a block meets the whole group in a task of its own.
    """
    crowded = cut_lineage(crowded)
    total = crowded.count()
    if not total:
        return crowded.select(F.col("hash").alias("hash_a"), F.col("hash").alias("hash_b"))
    sizes = crowded.groupBy("sig").agg(F.count("*").alias("holders"), F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    cut = hot_split_join(crowded, sizes, "sig", "holders", total, F.col("hash"))
    a = cut.select("sig", F.pmod(F.xxhash64("hash"), "blocks").cast("int").alias("block"), F.col("hash").alias("a"))
    b = cut.select("sig", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("hash").alias("b"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    met = a.join(b.hint("merge"), ["sig", "block"]).filter((F.col("a") < F.col("b")) & (F.bit_count(x) <= level.bits))
    return met.select(F.col("a").alias("hash_a"), F.col("b").alias("hash_b"))


def near_duplicates(df: DataFrame, record_id: str, text_hash: str, bits: int = 5) -> tuple[DataFrame, DataFrame]:
    """(members, links) of the near-duplicate records of df.

    members: (record_id, hash), one row per record and readable hash. links: (hash_a, hash_b), the pairs of distinct hashes
    within `bits` bits. Equal hashes are one class and never expanded here, so that copies, be they a third of all
    rows, cost nothing. Null, blank, failed and other unreadable hashes and those of sixteen equal digits take no
    part; null ids neither. Rows delivered twice count once; extra columns don't matter; empty tables give no rows.
    """
    members, classes = _classes(df, record_id, text_hash)
    return members, similar_hashes(classes.select("hash"), bits)


def _classes(df: DataFrame, record_id: str, text_hash: str) -> tuple[DataFrame, DataFrame]:
    """members (record_id, hash) and classes (hash, copies), both written once."""
    members = df.select(F.col(record_id).alias("record_id"), read_hash(F.col(text_hash)).alias("hash"))
    members = cut_lineage(members.filter("record_id IS NOT NULL AND hash IS NOT NULL").distinct())
    return members, cut_lineage(members.groupBy("hash").agg(F.count("*").alias("copies")))


def near_duplicate_pairs(df: DataFrame, record_id: str, text_hash: str, bits: int = 5, parts: int = 500) -> DataFrame:
    """(id_a, id_b), id_a < id_b: near_duplicates() as pairs of record ids, copies included.

    The number of pairs within a class of copies is its square; that is the result asked for, so this form suits
    data whose hot hashes are unreadable or blank. Classes of more than a `parts`-th of all records (at most `parts` of them, whose
    hashes alone are broadcast) are cut into as many chunks as make each that small, and every pair of chunks meets in its own task.
    """
    members, classes = _classes(df, record_id, text_hash)
    links = similar_hashes(classes.select("hash"), bits).unionByName(
        classes.filter("copies > 1").select(F.col("hash").alias("hash_a"), F.col("hash").alias("hash_b"))
    )
    total = classes.agg(F.sum("copies")).first()[0] or 0
    hot_at = max(1000, total // parts)
    hot = classes.filter(F.col("copies") > hot_at).select("hash", F.ceil(F.col("copies") / hot_at).cast("int").alias("chunks"))
    chunks = F.coalesce("chunks", F.lit(1))
    member = members.join(F.broadcast(hot), "hash", "left").withColumn("chunk", F.pmod(F.xxhash64("record_id"), chunks).cast("int"))
    for s in "ab":
        h = hot.withColumnRenamed("hash", f"hash_{s}")
        links = links.join(F.broadcast(h), f"hash_{s}", "left").withColumn(f"chunk_{s}", F.explode(F.sequence(F.lit(0), chunks - 1))).drop("chunks")
    m = lambda s: member.select(F.col("record_id").alias(f"id_{s}"), F.col("hash").alias(f"hash_{s}"), F.col("chunk").alias(f"chunk_{s}"))
    found = links.join(m("a").hint("merge"), ["hash_a", "chunk_a"]).join(m("b").hint("merge"), ["hash_b", "chunk_b"])
    found = found.filter((F.col("hash_a") < F.col("hash_b")) & (F.col("id_a") != F.col("id_b")) | (F.col("id_a") < F.col("id_b")) & (F.col("hash_a") == F.col("hash_b")))
    return found.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()
