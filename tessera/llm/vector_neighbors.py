"""The most similar vectors of every vector, by score-aware quantisation, four-bit table scans and exact reranking.

Per profile and kind: cell centres and code books are fitted on a bounded sample (chosen by hash). Every vector is
then indexed: it goes to the cell of its nearest centre, and what is left of it is coded by pairs of dimensions with 16 code words
each. Code words are chosen and fitted under the score-aware loss, in which the error parallel to the vector weighs `eta` times the
error across it, because that is what changes the largest inner products. With its code a vector keeps the length of its error, which bounds by how much
a scanned score can be wrong.

Every vector is also a query. First it searches its `probes` best cells: a table of 16 inner products per pair of dimensions is made once, the codes of
a cell are looked up in it (two codes to a byte), and the members whose score plus error can reach the query's floor (`least`, or its k-th cosine so far)
are scored again in double precision on the vectors as they were given. Then it searches, in the same way, the other cells that may hold a member beyond
its floor: the angle to a member is at least the difference of the query's and the member's angles to the member's centre. There the codes are
decoded once for all queries of a cell, which gives the same sums by one matrix product. No cell or member is passed over without such a bound, so the result is
exact; `complete=False` leaves out the second search, for collections in which an approximate answer is enough.

Cells are put into tiles of about TILE members by halving the centres along their widest direction, so neighbouring cells share a tile and a query is
sent once per tile, not per cell. A crowded cell is split over several tiles, and the queries of a tile are cut into blocks. Vectors that are equal bit by bit
are searched once; the copies get their results by a join.

Defined cases: of a key's rows that with the latest time counts (of equal times, the largest vector). A null vector, one of the wrong length, with a
value that is no number or infinite, or with zeros only has no result and is nobody's neighbour. Equal cosines (9 places) order by
key. Nulls in profile, kind or key leave a row out. Empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import Scratch

K, LEAST = 3, 0.85
PROBES, T = 8, 0.2
#: Cells grow as the root of the number of vectors, up to `cells_most` a group; the sample has at least SAMPLE vectors, and PER_CELL for each cell.
CELLS_MOST, SAMPLE, PER_CELL = 16384, 16384, 16
TILE, QUERIES = 32768, 16384
MODELS_MB = 64
# Queries scored at once, hits kept before they are cut to the best, hits of a query in a cell from which the cell is scored in doubles by one product;
# what single precision and the rounding to 9 places may hide; what the angles of two computations may differ by.
STEP, HITS, FEW, SLACK, PLACES, ANGLE = 2048, 500_000, 8, 1e-5, 1e-9, 1e-6


def eta(dims: int, t: float = T) -> float:
    """Weight of the parallel error against the orthogonal one for inner products of at least t."""
    return max(1.0, (dims - 1) * t * t / (1 - t * t))


def _pad(x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, x.shape[1] % 2)))


def nearest(u: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """The k best centres of each row, best first; in blocks, so that no table of all rows and centres is held."""
    k, step = min(k, len(centres)), max(1, 16_000_000 // len(centres))
    out = np.empty((len(u), k), np.int64)
    for i in range(0, len(u), step):
        s = u[i : i + step] @ centres.T
        if k == 1:
            out[i : i + step, 0] = s.argmax(1)
            continue
        top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < len(centres) else np.tile(np.arange(k), (len(s), 1))
        out[i : i + step] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
    return out


def encode(u: np.ndarray, left: np.ndarray, book: np.ndarray, weight: float, sweeps: int = 3) -> np.ndarray:
    """Codes (rows x pairs of dimensions) of the residuals `left` of unit vectors `u` under the score-aware loss."""
    if len(u) > 16384:
        return np.concatenate([encode(u[i : i + 16384], left[i : i + 16384], book, weight, sweeps) for i in range(0, len(u), 16384)])
    n, m = len(u), len(book)
    x, r = u.reshape(n, m, 2), left.reshape(n, m, 2)
    # per pair and code word: the squared error without the residual's own length, and the part of the error that is parallel to the vector
    far = (book * book).sum(-1)[None] - 2 * np.matmul(r.transpose(1, 0, 2), book.transpose(0, 2, 1)).transpose(1, 0, 2)
    par = (r * x).sum(-1)[:, :, None] - np.matmul(x.transpose(1, 0, 2), book.transpose(0, 2, 1)).transpose(1, 0, 2)
    codes, rows = far.argmin(2), np.arange(n)
    along = np.take_along_axis(par, codes[:, :, None], 2)[:, :, 0]
    total = along.sum(1)
    for _ in range(sweeps):
        for j in range(m):
            p = par[:, j]
            rest = total - along[:, j]
            c = (far[:, j] + (weight - 1) * (rest[:, None] + p) ** 2).argmin(1)
            along[:, j], codes[:, j] = p[rows, c], c
            total = rest + along[:, j]
    return codes.astype(np.uint8)


def fit(u: np.ndarray, cells: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(centres, book) of unit vectors: spherical k-means, then code words by weighted least squares."""
    rng = np.random.default_rng(seed)
    centres = u[rng.permutation(len(u))[:cells]].copy()
    for _ in range(8):
        home = nearest(u, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, home, u)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centres).astype(np.float32)
    u, centres = _pad(u), _pad(centres)
    left = u - centres[nearest(u, centres, 1)[:, 0]]
    n, m, w = len(u), u.shape[1] // 2, eta(u.shape[1])
    x, r = u.reshape(n, m, 2), left.reshape(n, m, 2)
    book = r[rng.integers(0, n, 16)].transpose(1, 0, 2).copy()
    for _ in range(6):
        codes = encode(u, left, book, w, 1)
        along = ((r - book[np.arange(m), codes]) * x).sum(-1)
        rest = along.sum(1, keepdims=True) - along
        for j in range(m):
            xj, rj = x[:, j].astype(np.float64), r[:, j].astype(np.float64)
            a = np.eye(2) + (w - 1) * xj[:, :, None] * xj[:, None, :]
            b = rj + (w - 1) * (rest[:, j] + (rj * xj).sum(1))[:, None] * xj
            one = (codes[:, j, None] == np.arange(16)).astype(np.float64)
            left_side, right_side = (one.T @ a.reshape(n, 4)).reshape(16, 2, 2), one.T @ b
            used = np.bincount(codes[:, j], minlength=16) > 0
            book[j, used] = np.linalg.solve(left_side[used], right_side[used][..., None])[..., 0]
    return centres, book.astype(np.float32)


def scan(q: np.ndarray, centre: np.ndarray, book: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Approximate inner products (queries x members of a cell) by table look-up; packed holds two codes in a byte."""
    m = len(book)
    table = np.matmul(q.reshape(len(q), m, 2).transpose(1, 0, 2), book.transpose(0, 2, 1)).transpose(1, 0, 2)
    out = np.repeat((q @ centre)[:, None], len(packed), 1)
    if len(packed) < 192:  # a table of pairs would cost more than it saves
        for j in range(m):
            out += np.take(table[:, j], packed[:, j // 2] >> 4 if j % 2 else packed[:, j // 2] & 15, axis=1)
        return out
    for i in range(0, m, 2):
        t = table[:, i, None, :]
        two = (table[:, i + 1, :, None] + t if i + 1 < m else np.repeat(t, 16, 1)).reshape(len(q), 256)
        out += np.take(two, packed[:, i // 2], axis=1)
    return out


def decode(centre: np.ndarray, book: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """The vectors that codes stand for."""
    m = len(book)
    codes = np.stack([packed & 15, packed >> 4], 2).reshape(len(packed), -1)[:, :m]
    return centre + book[np.arange(m), codes].reshape(len(packed), -1)


def pack(codes: np.ndarray) -> np.ndarray:
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return codes[:, 0::2] | (codes[:, 1::2] << 4)


def _usable(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, vec, key = [], [], []
            for i, (v, d) in enumerate(zip(b.column("vector"), b.column("dimension").to_pylist())):
                a = v.values.to_numpy(zero_copy_only=False).astype(np.float32) if v.is_valid else None
                if a is not None and len(a) == d and np.isfinite(a).all() and a.any():
                    keep.append(i)
                    vec.append(a.tobytes())
                    key.append(xxhash.xxh3_128_digest(vec[-1]))
            t = b.take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays([t.column("profile"), t.column("kind"), t.column("name"), pa.array(key, pa.binary()), pa.array(vec, pa.binary())], ["profile", "kind", "name", "key", "vec"])

    return rows.mapInArrow(run, "profile string, kind string, name string, key binary, vec binary")


def _vectors(col: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.float32).reshape(len(col), -1)


def _unit(v: np.ndarray) -> np.ndarray:
    d = v.astype(np.float64)
    d /= np.abs(d).max(1, keepdims=True)  # lengths far from 1 would over- or underflow when squared
    return (d / np.linalg.norm(d, axis=1, keepdims=True)).astype(np.float32)


def cell_count(n: int, cells_most: int = CELLS_MOST) -> int:
    return int(min(cells_most, max(1, round(2 * n**0.5)), max(1, n // 8)))


def _exact_unit(v: np.ndarray) -> np.ndarray:
    d = v.astype(np.float64)
    d /= np.abs(d).max(1, keepdims=True)
    return d / np.linalg.norm(d, axis=1, keepdims=True)


def tiles(centres: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """Tile of each cell: halved along the widest direction of the centres until a tile has at most `most` members or one cell."""
    out, todo, n = np.zeros(len(centres), np.int64), [np.arange(len(centres))], 0
    while todo:
        idx = todo.pop()
        if len(idx) == 1 or counts[idx].sum() <= most:
            out[idx], n = n, n + 1
            continue
        c = centres[idx] - centres[idx].mean(0)
        order = idx[np.argsort(c @ np.linalg.svd(c, full_matrices=False)[2][0], kind="stable")]
        half = int(np.clip(np.searchsorted(counts[order].cumsum(), counts[order].sum() / 2) + 1, 1, len(order) - 1))
        todo += [order[half:], order[:half]]
    return out


class Cells:
    """What the tasks know of a group's cells: centres, code book, angles of the members to their centre, and where the members are."""

    def __init__(self, centres: np.ndarray, book: np.ndarray, counts: np.ndarray, low: np.ndarray, high: np.ndarray, first_slot: int):
        self.centres, self.book, self.low, self.high = centres, book, low, high
        self.tile = tiles(centres, counts, TILE)
        size = np.bincount(self.tile, counts)
        self.blocks = np.maximum(1, -(-size // TILE)).astype(np.int64)  # only a tile of one cell has more than one
        self.slot = first_slot + np.concatenate([[0], np.cumsum(self.blocks)[:-1]])
        self.slots = int(self.blocks.sum())
        c = centres.astype(np.float64)
        self.unit = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)

    def gap(self, q: np.ndarray, cells: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The least angle between each query and any member of each cell; that of cells without members is pi."""
        angle = np.arccos(np.clip(q @ self.unit[cells, : q.shape[1]].T, -1, 1))
        return np.maximum(np.maximum(angle - self.high[cells], self.low[cells] - angle), 0)

    def slots_of(self, tile: np.ndarray) -> np.ndarray:
        return np.concatenate([np.arange(self.slot[t], self.slot[t] + self.blocks[t]) for t in tile]) if len(tile) else np.zeros(0, np.int64)


def look(
    cells: Cells, asked: np.ndarray, qid: np.ndarray, floor: np.ndarray, probes: np.ndarray, given: np.ndarray, mid: np.ndarray, home: np.ndarray, names: np.ndarray, packed: np.ndarray, eps: np.ndarray, second: bool, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, member, cosine): of each query the k best members with at least its floor, in the cells that it probes, or (second) in the others that may hold such a member.

    Members are in order of their cells, then names.
    """
    m = _exact_unit(given)
    rank = np.argsort(np.argsort(names, kind="stable"))
    cut = [0, *(np.flatnonzero(np.diff(home)) + 1), len(home)]
    spans = list(zip(cut, cut[1:]))
    own = home[cut[:-1]]
    plain = [decode(cells.centres[c], cells.book, packed[a:b]) for c, (a, b) in zip(own, spans)] if second else []
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for s in range(0, len(asked), STEP):
        q, ids, bar = _exact_unit(asked[s : s + STEP]), qid[s : s + STEP], floor[s : s + STEP].copy()
        q32, hits, held = _pad(q.astype(np.float32)), [], 0
        among = (probes[s : s + STEP, :, None] == own[None, None]).any(1)
        gap = cells.gap(q, own) - ANGLE
        reach = np.where(among == second, np.pi, np.maximum(gap, 0))
        most = np.cos(reach)
        for i in np.argsort(reach.min(0), kind="stable"):
            a, b = spans[i]
            rows = np.flatnonzero((among[:, i] != second) & (most[:, i] >= bar - PLACES))
            if not len(rows):
                continue
            for at in range(a, b, 4096):
                to = min(b, at + 4096)
                score = q32[rows] @ plain[i][at - a : to - a].T if second else np.concatenate([scan(q32[rows[x : x + 512]], cells.centres[own[i]], cells.book, packed[at:to]) for x in range(0, len(rows), 512)])
                hit = score + eps[None, at:to] >= (bar[rows] - SLACK).astype(np.float32)[:, None]
                many = hit.sum(1) > max(FEW, k)
                if many.any():  # scored in doubles; of equal cosines the smaller names
                    r = rows[many]
                    cos = np.round(q[r] @ m[at:to].T, 9)
                    cos[ids[r][:, None] == mid[None, at:to]] = -2
                    top = min(k, to - at)
                    kth = np.partition(cos, -top, axis=1)[:, -top][:, None]
                    equal = cos == kth
                    keep = (cos > kth) | (equal & (np.cumsum(equal, axis=1) <= top - (cos > kth).sum(1, keepdims=True)))
                    x, y = np.nonzero(keep & (cos >= bar[r][:, None] - PLACES))
                    hits.append((r[x], y + at, cos[x, y]))
                    held += len(x)
                    if top == k:
                        bar[r] = np.maximum(bar[r], kth[:, 0])
                    hit[many] = False
                x, y = np.nonzero(hit)
                x, y = rows[x], y + at
                other = ids[x] != mid[y]
                x, y = x[other], y[other]
                if len(x):
                    cos = np.round((q[x] * m[y]).sum(1), 9)
                    ok = cos >= bar[x] - PLACES
                    hits.append((x[ok], y[ok], cos[ok]))
                    held += int(ok.sum())
                if held > HITS:
                    hits = [_best(hits, rank, k)]
                    x, _, cos = hits[0]
                    held = len(x)
                    full = np.bincount(x, minlength=len(q)) >= k
                    worst = np.full(len(q), 2.0)
                    np.minimum.at(worst, x, cos)
                    bar[full] = np.maximum(bar[full], worst[full])
        if hits:
            x, y, cos = _best(hits, rank, k)
            ok = cos >= floor[s : s + STEP][x]
            out.append((x[ok] + s, y[ok], cos[ok]))
    return tuple(np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _best(hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]], rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, y, cos = (np.concatenate(z) for z in zip(*hits))
    order = np.lexsort((rank[y], -cos, x))
    x, y, cos = x[order], y[order], cos[order]
    first = np.searchsorted(x, x, side="left")
    keep = np.arange(len(x)) - first < k
    return x[keep], y[keep], cos[keep]


def _models(classes: DataFrame, scratch: Scratch, cells_most: int, sample: int) -> list[tuple[str, str, int, np.ndarray, np.ndarray]]:
    """profile, kind, dimension, centres, book of each group of vectors, fitted on a bounded sample of it; groups in tasks of their own."""
    group = ["profile", "kind", "dims"]
    sizes = classes.groupBy(group).agg(F.count("*").alias("n"))
    cells = F.least(F.lit(cells_most), F.greatest(F.lit(1), F.round(2 * F.sqrt("n"))))
    sizes = sizes.withColumn("most", F.greatest(F.lit(sample), PER_CELL * cells))
    # about twice the sample by hash before the window, so that what a task receives doesn't grow with the number of tasks
    share = F.least(F.lit(1.0), 2.0 * F.col("most") / F.col("n")) * float(1 << 30)
    near = classes.join(sizes, group).filter(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) <= share)
    w = Window.partitionBy(group).orderBy(F.xxhash64("key"), "key")
    taken = near.repartition(16, *group).withColumn("i", F.row_number().over(w)).filter(F.col("i") <= F.col("most"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        centres, book = fit(_unit(_vectors(pdf.vec.tolist())), cell_count(int(pdf.n.iloc[0]), cells_most))
        return pd.DataFrame({"profile": pdf.profile[:1], "kind": pdf.kind[:1], "dims": pdf.dims[:1], "centres": [centres.tobytes()], "book": [book.tobytes()]})

    out = []
    fitted = scratch.cut(taken.groupBy(group).applyInPandas(run, "profile string, kind string, dims int, centres binary, book binary"), "models")  # all groups at once
    for r in fitted.toLocalIterator():
        wide = r.dims + r.dims % 2
        out.append((r.profile, r.kind, r.dims, np.frombuffer(r.centres, np.float32).reshape(-1, wide), np.frombuffer(r.book, np.float32).reshape(-1, 16, 2)))
    return sorted(out, key=lambda m: m[:3])


def _search(classes: DataFrame, models: list, scratch: Scratch, label: str, k: int, least: float, probes: int, complete: bool) -> DataFrame:
    """(rid, other, name, cos): up to k neighbours of each class among the classes of its group."""
    context = classes.sparkSession.sparkContext
    shared = context.broadcast(models)
    where = {m[:3]: i for i, m in enumerate(models)}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = list(zip(*(b.column(c).to_pylist() for c in ("profile", "kind", "dims"))))
            for g in sorted({where[x] for x in names if x in where}):
                t = b.take(pa.array([i for i, x in enumerate(names) if where.get(x) == g], pa.int32()))
                _, _, _, centres, book = shared.value[g]
                u = _pad(_unit(_vectors(t.column("vec").to_pylist())))
                near = nearest(u, centres, probes)
                home, n = near[:, 0], len(u)
                codes = encode(u, u - centres[home], book, eta(u.shape[1]))
                eps = np.linalg.norm(u - centres[home] - book[np.arange(len(book)), codes].reshape(n, -1), axis=1)
                unit = centres[home].astype(np.float64)
                unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)
                angle = np.arccos(np.clip((_pad(_exact_unit(_vectors(t.column("vec").to_pylist()))) * unit).sum(1), -1, 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, g, np.int32)), t.column("rid"), t.column("name"), t.column("vec"), pa.array([c.tobytes() for c in pack(codes)], pa.binary()), pa.array(home.astype(np.int32)), pa.array([p.tobytes() for p in near.astype(np.int32)], pa.binary()), pa.array(eps.astype(np.float32)), pa.array(angle)],
                    ["g", "rid", "name", "vec", "codes", "home", "probes", "eps", "angle"])

    placed = scratch.cut(classes.mapInArrow(place, "g int, rid bigint, name string, vec binary, codes binary, home int, probes binary, eps float, angle double"), f"placed{label}")
    stats = [(np.zeros(len(m[3]), np.int64), np.full(len(m[3]), 4 * np.pi), np.full(len(m[3]), -4 * np.pi)) for m in models]
    for r in placed.groupBy("g", "home").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).toLocalIterator():  # at most one row per cell
        for a, v in zip(stats[r.g], (r.n, r.low, r.high)):
            a[r.home] = v
    cells: list[Cells] = []
    for m, (n, low, high) in zip(models, stats):
        cells.append(Cells(m[3], m[4], n, low, high, cells[-1].slot[0] + cells[-1].slots if cells else 0))
    known = context.broadcast(cells)

    def sent(b: pa.RecordBatch, second: bool) -> tuple[np.ndarray, np.ndarray]:
        """(row, slot): where the queries of a batch go."""
        rows, slots = [], []
        group, floor, ps = b.column("g").to_numpy(), b.column("floor").to_numpy(), b.column("probes").to_pylist()
        for g in np.unique(group):
            c, mine = known.value[g], np.flatnonzero(group == g)
            p = np.frombuffer(b"".join(ps[i] for i in mine), np.int32).reshape(len(mine), -1)
            for x in range(0, len(mine), STEP):
                part = mine[x : x + STEP]
                want = np.zeros((len(part), len(c.centres)), bool)
                np.put_along_axis(want, p[x : x + STEP].astype(np.int64), True, 1)
                if second:
                    q = _exact_unit(_vectors(b.column("vec").take(pa.array(part)).to_pylist()))
                    want = ~want & (np.cos(np.maximum(c.gap(q) - 2 * ANGLE, 0)) >= floor[part][:, None] - PLACES) & (c.low < 4)[None]
                tile = np.zeros((len(part), len(c.blocks)), bool)
                np.logical_or.at(tile.T, c.tile, want.T)
                r, t = np.nonzero(tile)
                n = c.blocks[t]
                rows.append(np.repeat(part[r], n))
                slots.append(c.slots_of(t))
        return (np.concatenate(rows), np.concatenate(slots)) if rows else (np.zeros(0, int), np.zeros(0, int))

    def round_(asked: DataFrame, second: bool) -> DataFrame:
        total = sum(c.slots for c in cells)

        def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(total, np.int64)
            for b in batches:
                if b.num_rows:
                    n += np.bincount(sent(b, second)[1], minlength=total)
            i = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(n[i])], ["slot", "n"])

        loads = np.zeros(total, np.int64)
        for r in asked.mapInArrow(load, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toLocalIterator():  # one row per tile
            loads[r.slot] = r.n
        blocks = context.broadcast(-(-loads // QUERIES))  # 0 where nobody asks
        names = ["slot", "qb", "g", "rid", "name", "vec", "codes", "home", "eps", "floor", "probes"]
        shape = "slot bigint, qb bigint, g int, rid bigint, name string, vec binary, codes binary, home int, eps float, floor double, probes binary"
        nulls = lambda n, kind: pa.nulls(n, kind)

        def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                group, home, rid = b.column("g").to_numpy(), b.column("home").to_numpy(), b.column("rid").to_numpy()
                slot = np.empty(b.num_rows, np.int64)
                for g in np.unique(group):
                    c, mine = known.value[g], group == g
                    t = c.tile[home[mine]]
                    slot[mine] = c.slot[t] + (rid[mine] * 2654435761 % 4294967296) % c.blocks[t]
                times = blocks.value[slot]
                row = np.repeat(np.arange(b.num_rows), times)
                qb = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                t, n = b.take(pa.array(row)), len(row)
                yield pa.RecordBatch.from_arrays([pa.array(slot[row]), pa.array(qb), *(t.column(c) for c in ("g", "rid", "name", "vec", "codes", "home", "eps")), nulls(n, pa.float64()), nulls(n, pa.binary())], names)

        def queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                row, slot = sent(b, second) if b.num_rows else (np.zeros(0, int), np.zeros(0, int))
                t, n = b.take(pa.array(row, pa.int64())), len(row)
                qb = (t.column("rid").to_numpy() * 2246822519 % 4294967296) % np.maximum(1, blocks.value[slot])
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(qb), t.column("g"), t.column("rid"), nulls(n, pa.string()), t.column("vec"), nulls(n, pa.binary()), nulls(n, pa.int32()), nulls(n, pa.float32()), t.column("floor"), t.column("probes")], names)

        def tile(t: pa.Table) -> pa.Table:
            own = t.column("codes").is_valid()
            mem, ask = t.filter(own).sort_by([("home", "ascending"), ("name", "ascending")]), t.filter(pa.compute.invert(own))
            empty = pa.table({"rid": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "name": pa.array([], pa.string()), "cos": pa.array([], pa.float64())})
            if not len(mem) or not len(ask):
                return empty
            mid, qid, c = mem.column("rid").to_numpy(), ask.column("rid").to_numpy(), known.value[t.column("g")[0].as_py()]
            p = np.frombuffer(b"".join(ask.column("probes").to_pylist()), np.int32).reshape(len(ask), -1)
            packed = np.frombuffer(b"".join(mem.column("codes").to_pylist()), np.uint8).reshape(len(mem), -1)
            q, m, cos = look(c, _vectors(ask.column("vec").to_pylist()), qid, ask.column("floor").to_numpy(), p, _vectors(mem.column("vec").to_pylist()), mid, mem.column("home").to_numpy(), mem.column("name").to_numpy(), packed, mem.column("eps").to_numpy(), second, k)
            return pa.table({"rid": qid[q], "other": mid[m], "name": mem.column("name").take(pa.array(m)), "cos": cos}, schema=empty.schema)

        both = placed.mapInArrow(members, shape).unionByName(asked.mapInArrow(queries, shape))
        return both.groupBy("slot", "qb").applyInArrow(tile, "rid bigint, other bigint, name string, cos double")

    w = Window.partitionBy("rid").orderBy(F.desc("cos"), "name")
    best = lambda df: df.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= k).drop("i")
    ask = placed.select("g", "rid", "vec", "probes")
    found = best(round_(ask.withColumn("floor", F.lit(float(least))), False))
    if not complete or all(len(m[3]) <= probes for m in models):
        return found
    found = scratch.cut(found, f"found{label}")
    kth = found.groupBy("rid").agg(F.count("*").alias("n"), F.min("cos").alias("kth")).filter(F.col("n") >= k).select("rid", "kth")
    more = round_(ask.join(kth, "rid", "left").withColumn("floor", F.coalesce("kth", F.lit(float(least)))).drop("kth"), True)
    return best(found.unionByName(more))


def neighbors(ledger: DataFrame, k: int = K, least: float = LEAST, probes: int = PROBES, complete: bool = True, cells_most: int = CELLS_MOST, sample: int = SAMPLE) -> DataFrame:
    """embedding_profile, record_kind, text_hash, neighbor_hash, cosine: up to k other usable vectors with the highest cosine, if at least `least`."""
    scratch = Scratch(ledger.sparkSession, "neighbors")
    named = ledger.select(F.col("embedding_profile").alias("profile"), F.col("record_kind").alias("kind"), F.col("text_hash").alias("name"), "vector", "dimension", "updated_at").filter("profile IS NOT NULL AND kind IS NOT NULL AND name IS NOT NULL")
    last = named.groupBy("profile", "kind", "name").agg(F.max(F.struct("updated_at", "vector", "dimension")).alias("r")).select("profile", "kind", "name", "r.vector", "r.dimension")
    rows = scratch.cut(_usable(last), "rows")
    one = rows.groupBy("profile", "kind", "key").agg(F.first("vec").alias("vec"), F.min("name").alias("name"), F.count("*").alias("copies"))
    classes = scratch.cut(one.withColumns({"rid": F.monotonically_increasing_id(), "dims": (F.octet_length("vec") / 4).cast("int")}), "classes")
    models, found, batch, mb = _models(classes, scratch, cells_most, sample), None, [], 0.0
    passes = []
    for m in models:  # what is broadcast at once stays under MODELS_MB
        size = (m[3].nbytes + m[4].nbytes) / 1e6
        if batch and mb + size > MODELS_MB:
            passes.append(batch)
            batch, mb = [], 0.0
        batch.append(m)
        mb += size
    for i, b in enumerate([*passes, batch] if batch else []):
        part = _search(classes, b, scratch, str(i), k, least, probes, complete)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return ledger.limit(0).selectExpr("embedding_profile", "record_kind", "text_hash", "text_hash AS neighbor_hash", "CAST(NULL AS DOUBLE) AS cosine")
    member = rows.join(classes.select("profile", "kind", "key", "rid", "copies"), ["profile", "kind", "key"]).select("profile", "kind", "rid", "name", "copies")
    member = scratch.cut(member, "members")
    order = Window.partitionBy("rid").orderBy("name")
    few = member.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= k + 1).select(F.col("rid").alias("other"), F.col("name").alias("near"), "copies", "i")
    same = few.filter(F.col("copies") > 1).select(F.col("other").alias("rid"), "near", F.lit(1.0).alias("cos"))
    near = found.select("rid", "other", "cos").join(few.filter(F.col("i") <= k).select("other", "near"), "other").select("rid", "near", "cos")
    best = near.unionByName(same).withColumn("i", F.row_number().over(Window.partitionBy("rid").orderBy(F.desc("cos"), "near"))).filter(F.col("i") <= k + 1).drop("i")
    full = member.join(best, "rid").filter("name <> near")
    w = Window.partitionBy("profile", "kind", "name").orderBy(F.desc("cos"), "near")
    return full.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= k).select(
        F.col("profile").alias("embedding_profile"), F.col("kind").alias("record_kind"), F.col("name").alias("text_hash"), F.col("near").alias("neighbor_hash"), F.col("cos").alias("cosine"))
