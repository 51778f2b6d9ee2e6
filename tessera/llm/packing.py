"""Filling containers of fixed capacity with items by linear grouping.

Sizes are whole tokens, so all that a plan needs is how many items there are of each size: at most one count per size up to
the capacity, however many items there are. Only these counts reach the driver.

1. An item over the capacity is divided into full pieces and a rest; no other item is divided.
2. Large sizes (over SMALL of the capacity) are put into GROUPS groups of equal cardinality, and each is rounded up to its group's largest.
3. The few rounded sizes are packed by configurations: column generation with a knapsack solves the linear programme to within NEAR of its optimum, which its
   duals prove; the knapsack runs over a grid of GRID steps, so its cost doesn't grow with the capacity. Whole multiples of the configurations
   are kept, the rest of the items is packed best-fit.
4. The actual items take the places of their group, largest first, so containers keep the room by which sizes were rounded.
5. Small sizes, largest first, go where the least room is left that holds them; new containers are opened only when none does.

Each capacity is planned in a task of its own. A plan is a table of runs: items of one size with ranks from .. to go to containers from .. to. Ranks are given
without a single sort: a rank within a hash part, plus the counts of the parts before it; how many parts a size has follows from how many items it has.
Items meet their run by an equi join on size and block of ranks, so a size that a third of all items have spreads over as many keys as it has blocks.

Defined cases: null ids or texts are left out; an empty text (0 tokens) goes to container 0. Rows of one id count each (copies included), told apart by
their number within the id. A null or non-positive capacity leaves a container kind out; a kind given twice counts with its smallest capacity. Empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.token_counts import VOCABULARY, with_tokens
from tessera.runtime import Scratch

SMALL, GROUPS = 0.125, 96
#: Steps of the knapsack; how near to the fractional optimum the configurations come; items of one size in a part, and ranks in a block.
GRID, NEAR = 4096, 1e-3
PART, BLOCK = 65536, 8192


class Plan:
    """Runs of items and containers for one capacity, from the number of items of each size."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.runs, self.bins = capacity, [], 0
        self.rank = dict.fromkeys(counts, 0)  # how many items of a size have a place
        self.left = {s: int(n) for s, n in counts.items() if n and 0 < s <= capacity}
        self.room: dict[int, list[tuple[int, int]]] = {}  # by room left: (first container, how many)
        self.rooms: list[int] = []  # the rooms that containers have, in order
        if counts.get(0):
            self.runs.append((0, 0, counts[0], counts[0], 0))
            self.bins = 0 if self.left else 1
        large = [s for s in sorted(self.left, reverse=True) if s > SMALL * capacity]
        self._large(large)
        for s in sorted(self.left, reverse=True):
            self._best_fit(s)

    def _put(self, size: int, items: int, first: int, each: int = 1) -> None:
        """The next items of a size go to containers from first on, `each` to one."""
        self.runs.append((size, self.rank[size], self.rank[size] + items, each, first))
        self.rank[size] += items
        self.left[size] -= items

    def _open(self, room: int, first: int, n: int) -> None:
        """n containers from `first` on have this room left."""
        if room not in self.room:
            self.room[room] = []
            insort(self.rooms, room)
        self.room[room].append((first, n))

    def _best_fit(self, s: int) -> None:
        while self.left[s]:
            n, at = self.left[s], bisect_left(self.rooms, s)
            if at == len(self.rooms):
                each, r = self.capacity // s, self.capacity
                first, k = self.bins, -(-n // each)
                self.bins += k
            else:
                r = self.rooms[at]
                first, k = self.room[r].pop()
                if not self.room[r]:
                    del self.room[r], self.rooms[at]
                each = r // s
            full, rest = min(k, n // each), n % each
            if full:
                self._put(s, full * each, first, each)
                self._open(r - each * s, first, full)
            if full < k:
                if rest and full == n // each:
                    self._put(s, rest, first + full, rest)
                    self._open(r - rest * s, first + full, 1)
                    full += 1
                if full < k:
                    self._open(r, first + full, k - full)

    def _large(self, sizes: list[int]) -> None:
        total = sum(self.left[s] for s in sizes)
        if not total:
            return
        members: list[list[list[int]]] = [[] for _ in range(min(GROUPS, total))]  # per group: [size, items], largest first
        at = 0
        for s in sizes:
            n = self.left[s]
            while n:
                g = min(len(members) - 1, at * len(members) // total)
                take = min(n, -(-(g + 1) * total // len(members)) - at)
                members[g].append([s, take])
                at, n = at + take, n - take
        # groups with one rounded size are one
        merged: dict[int, list[list[int]]] = {}
        for m in members:
            if m:
                merged.setdefault(m[0][0], []).extend(m)
        rounded = sorted(merged, reverse=True)
        demand = [sum(n for _, n in merged[s]) for s in rounded]
        for pattern, times in configurations(rounded, demand, self.capacity):
            self._fill([merged[rounded[g]] for g in pattern], times)

    def _fill(self, slots: list[list[list[int]]], times: int) -> None:
        """A configuration so many times: each slot takes the largest items left in its group, so a run ends where a size does."""
        while times:
            fit = times
            for m in {id(m): m for m in slots}.values():
                while m and not m[0][1]:
                    m.pop(0)
                if not m:
                    return
                fit = min(fit, max(1, m[0][1] // sum(x is m for x in slots)))
            first, used = self.bins, 0
            for m in slots:
                while m and not m[0][1]:
                    m.pop(0)
                if not m:
                    continue
                k = min(fit, m[0][1])
                if k < fit:  # a size ends within a single container's slots
                    continue
                self._put(m[0][0], fit, first)
                m[0][1] -= fit
                used += m[0][0]
            self.bins += fit
            self._open(self.capacity - used, first, fit)
            times -= fit


def configurations(sizes: list[int], demand: list[int], capacity: int, near: float = NEAR) -> list[tuple[list[int], int]]:
    """(slots, times): whole parts of a fractional packing of few sizes (Gilmore and Gomory); slots are positions in sizes.

    On a grid coarser than a token, sizes are rounded up, so every configuration fits. It ends when the dearest configuration costs at most 1 + near,
    since the fractional optimum is then at least 1 / (1 + near) of the packing (Farley's bound).
    """
    k, grid = len(sizes), min(capacity, GRID)
    short = [-(-s * grid // capacity) for s in sizes]
    b, d = np.diag([float(grid // s) for s in short]), np.array(demand, float)
    most = grid // min(short)
    while True:
        inverse = np.linalg.inv(b)
        price = np.ones(k) @ inverse
        # of sizes that are equal on the grid the dearest is enough; no configuration of large sizes holds more than `most`
        use = sorted({s: g for g, s in sorted(enumerate(short), key=lambda x: price[x[0]])}.items())
        best, backs = np.zeros(grid + 1), []
        for _ in range(most):
            new, back = best.copy(), np.full(grid + 1, -1)
            for s, g in use:
                if price[g] <= 0:
                    continue
                with_g = best[: grid + 1 - s] + price[g]
                better = with_g > new[s:] + 1e-12
                new[s:][better], back[s:][better] = with_g[better], g
            backs.append(back)
            if (back < 0).all():
                break
            best = new
        if best[grid] <= 1 + near:
            break
        column, c = np.zeros(k), grid
        for back in reversed(backs):
            if back[c] >= 0:
                column[back[c]] += 1
                c -= short[back[c]]
        x, step = inverse @ d, inverse @ column
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        b[:, int(np.argmin(ratio))] = column
    x = np.linalg.solve(b, d)
    return [([g for g in range(k) for _ in range(int(b[g, j]))], int(x[j] + 1e-6)) for j in np.argsort(-x) if x[j] >= 1 - 1e-6]


def plans(counts: DataFrame) -> DataFrame:
    """container_kind, size, lo, hi, each, first of the runs of every capacity; counts: container_kind, cap, size, n, at most cap + 1 rows a capacity."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        runs = Plan(dict(zip(pdf["size"].tolist(), pdf.n.tolist())), int(pdf.cap.iloc[0])).runs
        out = pd.DataFrame(runs, columns=["size", "lo", "hi", "each", "first"])
        out.insert(0, "container_kind", pdf.container_kind.iloc[0])
        return out

    return counts.repartition(32, "container_kind").groupBy("container_kind").applyInPandas(run, "container_kind string, size bigint, lo bigint, hi bigint, each bigint, first bigint")


def _numbered(sized: DataFrame) -> DataFrame:
    """doc_id, tokens, copy: rows of one id told apart by a number; rows with equal tokens are summed first, so a repeated id is no large group."""
    same = sized.groupBy("doc_id", "tokens").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("doc_id").orderBy("tokens").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = same.withColumn("before", before).select("doc_id", "tokens", F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("n"))).alias("copy"))
    return rows.withColumn("copy", F.col("copy").cast("int"))


def containers(docs: DataFrame, capacities: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """container_kind, container_id, doc_id, copy, piece, pieces, from_token, tokens: one row per item and capacity."""
    scratch = Scratch(docs.sparkSession, "packing")
    sized = scratch.cut(_numbered(with_tokens(docs, id_col, text_col, vocabulary=vocabulary).withColumnRenamed(id_col, "doc_id")), "sizes")
    # the capacities are a setting: one literal each, and every item comes once for each of them
    caps = capacities.filter("container_kind IS NOT NULL AND capacity_tokens > 0").groupBy("container_kind").agg(F.min("capacity_tokens").cast("long").alias("cap")).collect()
    one = F.array(*(F.struct(F.lit(c.container_kind).alias("container_kind"), F.lit(c.cap).cast("long").alias("cap")) for c in caps))
    if not caps:
        one = F.array().cast("array<struct<container_kind:string,cap:bigint>>")
    items = sized.select("*", F.inline(one)).withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("cap"))).cast("long"))
    items = items.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))).withColumn("from_token", F.col("piece") * F.col("cap"))
    items = items.withColumn("size", F.least("cap", F.col("tokens") - F.col("from_token")))
    counts = scratch.cut(items.groupBy("container_kind", "cap", "size").agg(F.count("*").alias("n")), "counts")
    runs = scratch.cut(plans(counts), "runs")
    items = items.join(counts.select("container_kind", "size", F.ceil(F.col("n") / PART).alias("parts")), ["container_kind", "size"])
    items = items.withColumn("part", F.pmod(F.xxhash64("doc_id", "copy", "piece"), "parts"))
    key = ["container_kind", "size", "part"]
    before = F.coalesce(F.sum("k").over(Window.partitionBy("container_kind", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = items.groupBy(*key).agg(F.count("*").alias("k")).withColumn("before", before).drop("k")
    ranked = items.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", "copy", "piece")) - 1).join(offsets, key).withColumn("rank", F.col("rank") + F.col("before"))
    ranked = ranked.withColumn("block", F.floor(F.col("rank") / BLOCK))
    spans = runs.withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / BLOCK), F.floor((F.col("hi") - 1) / BLOCK))))
    placed = ranked.join(spans, ["container_kind", "size", "block"]).filter("rank >= lo AND rank < hi")
    where = (F.col("first") + F.floor((F.col("rank") - F.col("lo")) / F.col("each"))).cast("long").alias("container_id")
    return placed.select("container_kind", where, "doc_id", "copy", "piece", "pieces", "from_token", F.col("size").alias("tokens"))


def fill_report(placed: DataFrame, capacities: DataFrame) -> DataFrame:
    """container_kind, capacity_tokens, containers, items, tokens, fewest (containers that the tokens need at least), filled (share of the room that is used)."""
    caps = capacities.filter("container_kind IS NOT NULL AND capacity_tokens > 0").groupBy("container_kind").agg(F.min("capacity_tokens").alias("capacity_tokens"))
    each = placed.groupBy("container_kind", "container_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("k"))
    total = each.groupBy("container_kind").agg(F.count("*").alias("containers"), F.sum("k").alias("items"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
    return total.join(caps, "container_kind").select(
        "container_kind", "capacity_tokens", "containers", "items", "tokens", "fullest", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("fewest"),
        F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("filled"))
