"""Problem 8: items put into containers of fixed capacity, by swap-based local search.

Items lie in containers as they come. Then underfull containers take from emptier ones, fullest first: an item is moved,
exchanged for a smaller one, two are exchanged for one or one for two, whatever fills the container exactly, or else fills it most.
Every step moves fill to the fuller container, so the sum of squared fills grows until containers empty. Where no step is
left, a part of the full containers is opened again together with what is still underfull, shuffled, and searched anew;
a result that is no better is undone.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotomill.session import cut_lineage


class _Open:
    """Containers under search: items by size, as a bit set of the sizes present and where each lies."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.present = self.mirrored = 0  # bit s, and bit capacity - s, for each size s at hand
        self.of_size: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bin_of = [-1] * len(sizes)
        self.items: dict[int, set[int]] = {}
        self.fill: dict[int, int] = {}

    def add(self, item: int) -> None:
        s = self.sizes[item]
        if not self.of_size[s]:
            self.present |= 1 << s
            self.mirrored |= 1 << (self.capacity - s)
        self.of_size[s].append(item)

    def take(self, s: int, but: list[int]) -> int | None:
        """An item of size s that is at hand and none of `but`, no longer at hand; outdated entries are dropped."""
        stack, found = self.of_size[s], None
        while stack and found is None:
            i = stack.pop()
            if self.at_hand(i) and i not in but:
                found = i
        if not stack:
            self.present &= ~(1 << s)
            self.mirrored &= ~(1 << (self.capacity - s))
        return found

    def at_hand(self, item: int) -> bool:
        return self.bin_of[item] in self.fill


def _largest(bits: int, lo: int, hi: int) -> int:
    """The largest set bit in lo..hi, or -1."""
    if hi < lo:
        return -1
    part = (bits >> lo) & ((1 << (hi - lo + 1)) - 1)
    return lo + part.bit_length() - 1 if part else -1


def _search(bins: list[list[int]], sizes: list[int], capacity: int, steps: dict[str, int]) -> list[list[int]]:
    """The containers after one descent: each in turn, fullest first, takes from the others until it is full or nothing fits better."""
    o = _Open(sizes, capacity)
    closed = []
    for b, items in enumerate(bins):
        f = sum(sizes[i] for i in items)
        if f == capacity:
            closed.append(items)
            continue
        o.fill[b], o.items[b] = f, set(items)
        for i in items:
            o.bin_of[i] = b
            o.add(i)
    heap = [(-f, b) for b, f in o.fill.items()]
    heapify(heap)
    while heap:
        f, b = heappop(heap)
        if o.fill.get(b) != -f:
            continue
        if not f:
            del o.fill[b]
            continue
        # The container leaves the ones to take from; what it gives comes back to them.
        del o.fill[b]
        mine, room = o.items.pop(b), capacity + f
        while room:
            step = _step(o, mine, room)
            if step is None:
                break
            give, get, kind = step
            steps[kind] = steps.get(kind, 0) + 1
            home = o.bin_of[get[0]]
            for i in get:
                at = o.bin_of[i]
                o.items[at].discard(i)
                o.fill[at] -= sizes[i]
                o.bin_of[i] = b
                mine.add(i)
                if at != home:
                    heappush(heap, (-o.fill[at], at))
            for i in give:
                mine.discard(i)
                o.bin_of[i] = home
                o.items[home].add(i)
                o.fill[home] += sizes[i]
                o.add(i)
            heappush(heap, (-o.fill[home], home))
            room -= sum(sizes[i] for i in get) - sum(sizes[i] for i in give)
        closed.append(list(mine))
    return closed


def _step(o: _Open, mine: set[int], room: int) -> tuple[list[int], list[int], str] | None:
    """(items given, items got, kind) of the step that fills `room` exactly, else of the one that fills it most.

    What is given goes where the first item got comes from, and fits there, as it is less than that item.
    """
    sizes, capacity = o.sizes, o.capacity
    own: dict[int, int] = {}
    for i in mine:
        own.setdefault(sizes[i], i)

    def get(*wanted: int) -> list[int] | None:
        """Items of the wanted sizes at hand, or none at all."""
        found = []
        for s in wanted:
            i = o.take(s, found)
            if i is None:
                for j in found:
                    o.add(j)
                return None
            found.append(i)
        return found

    # exact: a move, one for one, one for two, two for one
    if o.present >> room & 1 and (i := get(room)):
        return [], i, "move"
    for s, i in own.items():
        if s + room <= capacity and o.present >> (s + room) & 1 and (j := get(s + room)):
            return [i], j, "one for one"
    mask = 0
    for s in own:
        mask |= 1 << s
    for s, i in own.items():
        # sizes t of mine for which an item of size s + t + room is at hand
        both = (o.present >> (s + room)) & mask
        while both:
            t = (both & -both).bit_length() - 1
            both &= both - 1
            k = own[t] if t != s else next((x for x in mine if sizes[x] == s and x != i), None)
            if k is not None and (j := get(s + t + room)):
                return [i, k], j, "one for two"
    for s, i in [(0, None), *own.items()]:
        total = s + room
        # sizes a for which a and total - a are at hand
        pairs = o.present & (o.mirrored >> (capacity - total)) if total <= capacity else o.present & (o.mirrored << (total - capacity))
        # the smaller of the two; what is given must fit where the larger one was, so it is less than the room
        pairs &= (1 << min(total // 2 + 1, room)) - 1
        while pairs:
            less = pairs.bit_length() - 1
            pairs &= ~(1 << less)
            if j := get(total - less, less):
                return ([] if i is None else [i]), j, "two for none" if i is None else "two for one"
    # most: a move or one for one
    while True:
        gain, give, size = 0, None, _largest(o.present, 1, room - 1)
        if size > 0:
            gain = size
        for s, i in own.items():
            t = _largest(o.present, s + 1, min(s + room, capacity))
            if t - s > gain and t > 0:
                gain, give, size = t - s, i, t
        if not gain:
            return None
        if j := get(size):
            return ([] if give is None else [give]), j, "move" if give is None else "one for one"


def _as_they_come(items: list[int], sizes: list[int], capacity: int) -> list[list[int]]:
    """Each item into the current container, or into a new one."""
    bins, fill = [], capacity + 1
    for i in items:
        if fill + sizes[i] > capacity:
            bins.append([])
            fill = 0
        bins[-1].append(i)
        fill += sizes[i]
    return bins


def pack(sizes: np.ndarray, capacity: int, shakes: int = 60, steps: dict[str, int] | None = None) -> np.ndarray:
    """Container number of each item (sizes 1 to capacity), numbered from 0 without gaps.

    shakes: how often in a row full containers may be opened again in vain before the search ends; it bounds the search, not the result's validity:
    every item is in one container at any time. The search ends at once where no container can be saved. steps: counts of
    the steps taken, by kind. Equal input gives equal output.
    """
    steps = {} if steps is None else steps
    sz = [int(s) for s in sizes]
    if not sz:
        return np.zeros(0, np.int64)
    rng = np.random.default_rng(len(sz))
    least = -(-sum(sz) // capacity)
    bins = _search(_as_they_come(list(range(len(sz))), sz, capacity), sz, capacity, steps)
    in_vain = 0
    fills = lambda bs: [sum(sz[i] for i in b) for b in bs]
    while len(bins) > least and in_vain < shakes:
        steps["shakes"] = steps.get("shakes", 0) + 1
        fill = np.array(fills(bins))
        under = np.flatnonzero(fill < capacity)
        full = np.flatnonzero(fill == capacity)
        # All of the emptiest, some of the others, and a few times as many full ones as are underfull.
        under = under[np.argsort(fill[under], kind="stable")][:200]
        some = rng.choice(full, min(len(full), max(40, 3 * len(under))), replace=False) if len(full) else full
        chosen = set(under.tolist()) | set(some.tolist())
        items = [i for b in sorted(chosen) for i in bins[b]]
        order = rng.permutation(len(items))
        again = _search(_as_they_come([items[k] for k in order], sz, capacity), sz, capacity, steps)
        square = lambda bs: sum(f * f for f in fills(bs))
        old = [bins[b] for b in sorted(chosen)]
        better = (-len(again), square(again)) > (-len(old), square(old))
        if better:
            bins = [b for k, b in enumerate(bins) if k not in chosen] + again
        in_vain = 0 if better else in_vain + 1
    at = np.zeros(len(sz), np.int64)
    for k, b in enumerate(bins):
        at[b] = k
    return at


def fill_containers(sizes: DataFrame, capacity: int, shard_items: int = 20_000) -> DataFrame:
    """(container_id BIGINT, doc_id, part_no INT, token_start INT, n_tokens INT): every item in a container of `capacity`.

    sizes: (doc_id, doc_key, n_tokens). Only an item above the capacity is divided: into full containers and one rest,
    its parts numbered from 0 and covering it without gap or overlap. Items of size 0 (null and empty texts) lie in some container of
    their shard and take no room. Rows with equal id and digest are one item. Null ids are packed like any other; null or negative sizes count as 0.
    An empty table gives no rows.

    Scale: items are spread by hash over shards of about shard_items, each packed by itself; what that costs is at most
    one partly filled container a shard, about one in a thousand.
    """
    rows = cut_lineage(sizes.select("doc_id", "doc_key", F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).alias("n")).distinct())
    n_full = (F.col("n") - F.pmod(F.col("n"), F.lit(capacity))) / capacity
    last = F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0))
    parts = rows.withColumn("part_no", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    parts = parts.select(
        "doc_id", "doc_key", F.col("part_no").cast("int"), (F.col("part_no") * capacity).cast("int").alias("token_start"),
        F.least(F.lit(capacity), F.col("n") - F.col("part_no") * capacity).cast("int").alias("n_tokens"),
    )
    shards = max(1, -(-rows.count() // shard_items))
    parts = parts.withColumn("shard", F.pmod(F.xxhash64("doc_id", "doc_key", "part_no"), F.lit(shards)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_key", "part_no", "doc_id"], kind="stable")
        n = pdf["n_tokens"].to_numpy()
        at = np.zeros(len(pdf), np.int64)
        at[n > 0] = pack(n[n > 0], capacity)
        pdf["container_id"] = pdf["shard"] * (1 << 31) + at
        return pdf[["container_id", "doc_id", "part_no", "token_start", "n_tokens"]]

    schema = "container_id bigint, doc_id bigint, part_no int, token_start int, n_tokens int"
    return parts.groupBy("shard").applyInPandas(one, schema)
