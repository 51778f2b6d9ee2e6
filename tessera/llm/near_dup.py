"""Near-duplicate chunks by exact set similarity, with set-relation skipping.

A body is the text below the line `BODY:`; its set holds the hashes of all runs of three successive words. Two
sets belong together if their common part is at least `threshold` of their union. The join is exact (but for 64-bit hash
collisions) and has no cap on list lengths, candidates or partners.

Steps:
1. Equal sets become one class; a class is joined once, however many copies it has.
2. Document frequencies of all sequences, summed on the map side first. A sequence that occurs in one class only can't be common
   to two, so such ones count in the set's size but are never sent again.
3. Sequences are ordered by frequency, rarest first; only the prefix that a similar partner must touch is indexed.
4. Highly similar sets: classes whose rarest shared sequence is the same are cut into families of at most `FAMILY`
   sets, a base and members kept as differences from it. A family is posted and probed once for all its members.
5. Index level skipping: a sequence's list is ordered by block of smallest size and, in a block, by the room that is
   left behind the position. A probe leaves out the blocks of unfitting sizes, and the rest of a block at the first entry
   without enough room. Lists longer than `LIST` are cut into a grid of blocks that spreads over tasks.
6. Answer level skipping: the common part of two bases is counted once, and the answers of all members follow from it by counting
   only in the differences.

Defined cases: chunks with a null id or a null text, without a line `BODY:`, or with fewer than `least` sequences have no pair
and are their own class. Repeated rows count once; rows of one id with different texts count each. Very long
texts are one set like others. Empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import Scratch

THRESHOLD, WORDS, LEAST = 0.6, 3, 20
FAMILY = 64
LIST = 2048
HOT = 4096
_WORD = re.compile(r"[a-z0-9_]+")
_BODY = re.compile(r"(?:^|\n)BODY:[ \t]*\r?\n")


def need(total: int, threshold: float) -> int:
    """Smallest common part of two sets with `total` entries together."""
    return math.ceil(round(total * threshold / (1 + threshold), 9))


def body_words(text: str) -> list[str]:
    m = _BODY.search(text)
    return _WORD.findall(text[m.end() :].lower()) if m else []


def _hashes(words: list[str], seen: dict[str, int], width: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of `width` words."""
    if len(words) < width:
        return np.empty(0, np.int64)
    h = np.fromiter((seen[w] if w in seen else seen.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words), np.uint64, len(words))
    out = np.zeros(len(words) - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):  # a mix after each word makes the order count
            out = (out ^ h[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


def word_sets(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", width: int = WORDS, least: int = LEAST) -> DataFrame:
    """id, key (hash of the set, 16 bytes), n, items (sorted hashes) of each row with at least `least` sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for b in batches:
            ids, keys, sizes, parts = [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = _hashes(body_words(t), seen, width)
                if len(s) >= least:
                    ids.append(i)
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sizes.append(len(s))
                    parts.append(s)
            if len(seen) > 500_000:
                seen.clear()
            flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
            items = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), items], ["id", "key", "n", "items"])

    rows = chunks.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(run, "id string, key binary, n int, items array<bigint>")


def _families(shared: DataFrame, threshold: float) -> DataFrame:
    """Families of classes that begin with the same rarest shared sequence.

    shared: rid, n, toks (the shared sequences, rarest first), pre (how many of them belong to the prefix), head and head_df (its frequency,
    which says over how many tasks a head is spread). Result: fid, base (sorted
    sequences), members (array of rid, n, minus, plus) and posts (array of h, room, low, high): room is the largest number of entries from the sequence on
    of any member, low and high the smallest and largest n of the members that hold it in their prefix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, group = None, []

        def flush() -> Iterator[dict]:
            while group:
                base = group[0][2]
                fam, rest = [], []
                for row in group:
                    common = len(np.intersect1d(base, row[2], assume_unique=True))
                    # a member's differences must be fewer than its own entries
                    (fam if row is group[0] or (len(base) + len(row[2]) - 2 * common) * 2 <= len(row[2]) else rest).append(row)
                posts: dict[int, list[int]] = {}
                members = []
                for rid, n, s, toks, pre in fam:
                    members.append({"rid": rid, "n": n, "minus": np.setdiff1d(base, s, assume_unique=True), "plus": np.setdiff1d(s, base, assume_unique=True)})
                    alone = n - len(toks)
                    for i, h in enumerate(toks[:pre].tolist()):
                        p = posts.setdefault(h, [0, n, n])
                        p[:] = max(p[0], n - alone - i), min(p[1], n), max(p[2], n)
                yield {"fid": fam[0][0], "base": base, "members": members, "posts": [{"h": h, "room": a, "low": b, "high": c} for h, (a, b, c) in posts.items()]}
                group[:] = rest

        for b in batches:
            out: list[dict] = []
            for rid, n, toks, pre, hd in zip(*(b.column(c).to_pylist() for c in ("rid", "n", "toks", "pre", "head"))):
                if hd != head or len(group) >= FAMILY:
                    out += flush()
                    head = hd
                t = np.array(toks, np.int64)
                group.append((rid, n, np.sort(t), t, pre))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        last = list(flush())
        if last:
            yield pa.RecordBatch.from_pylist(last, schema)

    many = pa.list_(pa.int64())
    schema = pa.schema([("fid", pa.int64()), ("base", many), ("members", pa.list_(pa.struct([("rid", pa.int64()), ("n", pa.int32()), ("minus", many), ("plus", many)]))), ("posts", pa.list_(pa.struct([("h", pa.int64()), ("room", pa.int32()), ("low", pa.int32()), ("high", pa.int32())])))])
    ddl = "fid bigint, base array<bigint>, members array<struct<rid:bigint,n:int,minus:array<bigint>,plus:array<bigint>>>, posts array<struct<h:bigint,room:int,low:int,high:int>>"
    # equal heads meet by hash and, in a task, stand side by side in size order; a family never needs more than FAMILY of them at once
    near = shared.repartition("head", F.pmod(F.col("rid"), F.ceil(F.col("head_df") / HOT))).sortWithinPartitions("head", "n", "rid")
    return near.mapInArrow(run, ddl)


def _pairs_of_lists(posts: DataFrame, threshold: float) -> DataFrame:
    """(a, b): families that stand in one list with fitting sizes and enough room; a <= b."""

    def probe(fid: np.ndarray, room: np.ndarray, low: np.ndarray, high: np.ndarray, side: np.ndarray, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        # rows come by low and, within it, by room downwards
        starts = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        ends = np.r_[starts[1:], len(low)]
        for i in range(len(fid)):
            for s, e in zip(starts.tolist(), ends.tolist()):
                if low[s] > low[i]:
                    break
                if low[s] == low[i]:
                    e = min(e, i)
                if e <= s:
                    continue
                least = need(int(low[i]) + int(low[s]), threshold)
                if room[i] < least:
                    break  # later blocks need more
                k = s + int(np.searchsorted(-room[s:e], -least, side="right"))  # the rest of the block has too little room
                pick = np.arange(s, k)
                pick = pick[(high[s:k] >= threshold * low[i] - 1e-9) & (high[i] >= threshold * low[s:k] - 1e-9)]
                if not own:
                    pick = pick[side[pick] != side[i]]
                if len(pick):
                    yield np.full(len(pick), fid[i]), fid[pick]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def lists(t: pa.Table) -> Iterator[pa.RecordBatch]:
            c = {k: t.column(k).to_numpy() for k in t.column_names}
            cut = np.flatnonzero(np.r_[True, (c["h"][1:] != c["h"][:-1]) | (c["bi"][1:] != c["bi"][:-1]) | (c["bj"][1:] != c["bj"][:-1])]) if len(c["h"]) else np.empty(0, int)
            a, b = [], []
            for s, e in zip(cut, np.r_[cut[1:], len(c["h"])]):
                if e - s > 1:
                    for x, y in probe(*(c[k][s:e] for k in ("fid", "room", "low", "high", "side")), c["bi"][s] == c["bj"][s]):
                        a.append(x)
                        b.append(y)
            if a:
                x, y = np.concatenate(a), np.concatenate(b)
                both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) < 50_000:
                continue
            t = pa.Table.from_batches(held)
            same = np.ones(t.num_rows, bool)
            for c in ("h", "bi", "bj"):
                v = t.column(c).to_numpy()
                same &= v == v[-1]
            k = t.num_rows - int(same.sum())  # the last list may go on in the next batch
            yield from lists(t.slice(0, k))
            held = t.slice(k).to_batches()
        if held:
            yield from lists(pa.Table.from_batches(held))

    # a list longer than LIST becomes a grid of blocks; each pair of entries meets in exactly one cell of the grid
    blocks = F.greatest(F.lit(1), F.ceil(F.col("len") / F.lit(LIST / 2))).cast("int")
    side = F.pmod(F.xxhash64("fid"), F.col("blocks")).cast("int")
    grid = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("side", k).cast("int").alias("bi"), F.greatest("side", k).cast("int").alias("bj")))
    rows = posts.withColumn("blocks", blocks).withColumn("side", side).select("h", "fid", "room", "low", "high", "side", F.inline(grid))
    rows = rows.repartition("h", "bi", "bj").sortWithinPartitions("h", "bi", "bj", "low", F.desc("room"), "fid")
    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def _verify(pairs: DataFrame, threshold: float) -> DataFrame:
    """(rid_a, rid_b) with enough in common, from pairs of families: base_a, mem_a, base_b, mem_b (b null: the family with itself)."""
    arr = lambda x: np.array(x, np.int64)
    common = lambda x, y: len(np.intersect1d(x, y, assume_unique=True)) if len(x) and len(y) else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out_a, out_b = [], []
            for base_a, mem_a, base_b, mem_b in zip(*(b.column(c).to_pylist() for c in ("base_a", "mem_a", "base_b", "mem_b"))):
                own = base_b is None
                if own:
                    base_b, mem_b = base_a, mem_a
                x, y = arr(base_a), arr(base_b)
                xy = len(x) if own else common(x, y)
                left = [(m["rid"], m["n"], arr(m["minus"]), arr(m["plus"])) for m in mem_a]
                right = left if own else [(m["rid"], m["n"], arr(m["minus"]), arr(m["plus"])) for m in mem_b]
                for j, (rb, nb, minus_b, plus_b) in enumerate(right):
                    to_x = xy - common(x, minus_b) + common(x, plus_b)  # base a with member b
                    for ra, na, minus_a, plus_a in left[:j] if own else left:
                        if min(na, nb) < threshold * max(na, nb) - 1e-9 or to_x + len(plus_a) < need(na + nb, threshold):
                            continue
                        got = to_x
                        for sign, d in ((-1, minus_a), (1, plus_a)):
                            if len(d):
                                got += sign * (common(d, y) - common(d, minus_b) + common(d, plus_b))
                        if got >= need(na + nb, threshold):
                            out_a.append(ra)
                            out_b.append(rb)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["rid_a", "rid_b"])

    return pairs.mapInArrow(run, "rid_a bigint, rid_b bigint")


def similar(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", threshold: float = THRESHOLD, width: int = WORDS, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(links, members): links rid_a, rid_b between different classes; members id, rid (the class of each id)."""
    scratch = Scratch(chunks.sparkSession, "similar")
    rows = scratch.cut(word_sets(chunks, id_col, text_col, width, least), "rows")
    # one row per class: the numbers are fixed by writing them
    one = rows.groupBy("key").agg(F.first("n").alias("n"), F.first("items").alias("items"))
    sets = scratch.cut(one.withColumn("rid", F.monotonically_increasing_id()), "sets")
    scratch_members = rows.select("id", "key").distinct().join(sets.select("key", "rid"), "key").select("id", "rid")
    flat = sets.select("rid", "n", F.explode("items").alias("h"))
    often = flat.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    hit = flat.join(often, "h").groupBy("rid", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("toks"))
    # the prefix holds the n - need + 1 rarest; those that occur once come first in it
    size = (F.col("n") - F.ceil(F.round(F.col("n") * threshold, 9)) + 1 - (F.col("n") - F.size("toks"))).cast("int")
    shared = hit.withColumn("pre", size).filter("pre > 0").select("rid", "n", F.transform("toks", lambda t: t.h).alias("toks"), "pre", F.col("toks")[0].h.alias("head"), F.col("toks")[0].df.alias("head_df"))
    fam = scratch.cut(_families(shared, threshold), "families")
    posts = fam.select("fid", F.inline("posts"))
    lens = posts.groupBy("h").agg(F.count("*").alias("len")).filter("len > 1")
    cand = _pairs_of_lists(posts.join(lens, "h"), threshold)
    side = lambda s: fam.select(F.col("fid").alias(s), F.col("base").alias(f"base_{s}"), F.col("members").alias(f"mem_{s}"))
    across = cand.join(side("a"), "a").join(side("b"), "b").select("base_a", "mem_a", "base_b", "mem_b")
    inside = side("a").filter(F.size("mem_a") > 1).select("base_a", "mem_a", F.lit(None).cast("array<bigint>").alias("base_b"), F.lit(None).cast(dict(fam.dtypes)["members"]).alias("mem_b"))
    links = scratch.cut(_verify(across.unionByName(inside), threshold), "links")
    return links, scratch_members


def expand(links: DataFrame, members: DataFrame) -> DataFrame:
    """chunk_id_a < chunk_id_b: all pairs of ids, of linked classes and within a class."""
    a, b = members.select(F.col("id").alias("a"), F.col("rid").alias("rid_a")), members.select(F.col("id").alias("b"), F.col("rid").alias("rid_b"))
    several = members.groupBy("rid").agg(F.count("*").alias("k")).filter("k > 1").select("rid")
    twin = members.join(several, "rid")
    same = twin.select(F.col("id").alias("a"), "rid").join(twin.select(F.col("id").alias("b"), "rid"), "rid").filter("a < b").select("a", "b")
    other = links.join(a, "rid_a").join(b, "rid_b").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return same.unionByName(other).distinct().select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


def components(links: DataFrame, vertices: DataFrame, a: str = "rid_a", b: str = "rid_b", v: str = "rid") -> DataFrame:
    """(v, group_id): the smallest vertex that each vertex is linked to over any number of links.

    Each round takes the smallest label among the neighbours and then jumps to that label's label; the rounds grow with the
    logarithm of the longest chain. Neighbour minima are summed on the map side, so a vertex with very many links is no hot key.
    """
    scratch = Scratch(links.sparkSession, "components")
    both = scratch.cut(links.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(links.select(F.col(b).alias("x"), F.col(a).alias("y"))), "both")
    now = scratch.cut(both.groupBy(F.col("x").alias("v")).agg(F.least(F.min("y"), F.first("x")).alias("g")), "round0")
    k = 0
    while True:
        k += 1
        near = both.join(now.select(F.col("v").alias("y"), "g"), "y").groupBy(F.col("x").alias("v")).agg(F.min("g").alias("m"))
        hook = now.join(near, "v").select("v", F.col("g").alias("was"), F.least("g", "m").alias("g"))
        # the label's own better label goes to all that carry the label
        root = hook.filter("was <> g").groupBy(F.col("was").alias("g0")).agg(F.min("g").alias("better"))
        jump = hook.select(F.col("v").alias("g1"), F.col("g").alias("gg"))
        step = hook.join(root, hook.was == root.g0, "left").select("v", "was", F.least("g", F.coalesce("better", "g")).alias("g"))
        step = step.join(jump, step.g == jump.g1, "left").select("v", "was", F.least("g", F.coalesce("gg", "g")).alias("g"))
        new = scratch.cut(step, f"round{k}")
        if new.filter("was <> g").isEmpty():
            break
        scratch.drop(f"round{k - 1}")
        now = new.select("v", "g")
    return vertices.select(v).join(new.select(F.col("v").alias(v), F.col("g").alias("group_id")), v, "left").select(v, F.coalesce("group_id", v).alias("group_id"))


def groups(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", **how) -> DataFrame:
    """One row per chunk: chunk_id, class_id (equal sets), group_id (linked classes), links (linked other classes).

    Copies are not expanded into pairs, so a group of copies of any size costs one row per copy. An id with several texts is named in
    the group of its smallest class. Ids without a set are their own class and group.
    """
    links, members = similar(chunks, id_col, text_col, **how)
    named = members.groupBy("rid").agg(F.min("id").alias("class_id"))
    group = components(links, named).join(named, "rid")
    first = group.groupBy("group_id").agg(F.min("class_id").alias("group_name"))
    count = links.select(F.explode(F.array("rid_a", "rid_b")).alias("rid")).groupBy("rid").agg(F.count("*").alias("links"))
    info = group.join(first, "group_id").join(count, "rid", "left").select("rid", "class_id", F.col("group_name").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    have = members.join(info, "rid").groupBy("id").agg(F.min(F.struct("class_id", "group_id", "links")).alias("r"))
    every = chunks.select(F.col(id_col).cast("string").alias("id")).filter("id IS NOT NULL").distinct()
    return every.join(have, "id", "left").select(F.col("id").alias("chunk_id"), F.coalesce("r.class_id", "id").alias("class_id"), F.coalesce("r.group_id", "id").alias("group_id"), F.coalesce("r.links", F.lit(0)).alias("links"))
