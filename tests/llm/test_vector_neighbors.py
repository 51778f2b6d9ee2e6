import datetime as dt

import numpy as np
import pytest

from tessera.llm import vector_neighbors as V

DDL = "embedding_profile string, record_kind string, text_hash string, vector array<float>, dimension int, created_at timestamp, updated_at timestamp, rid bigint, name string"
T0 = dt.datetime(2025, 1, 1)


def row(h, v, p="p", k="chunk", dim=None, at=0):
    return (p, k, h, None if v is None else [float(x) for x in v], len(v) if dim is None and v is not None else dim, T0, T0 + dt.timedelta(at), 1, "n")


def brute(rows, k=3, least=0.85):
    last = {}
    for r in rows:
        if None not in r[:3] and (r[:3] not in last or r[6] > last[r[:3]][6]):
            last[r[:3]] = r
    ok = {key: np.array(r[3], np.float32).astype(float) for key, r in last.items() if r[3] is not None and len(r[3]) == r[4] and np.isfinite(r[3]).all() and any(r[3])}
    out = set()
    for a, x in ok.items():
        c = sorted((-round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 9), b[2]) for b, y in ok.items() if a[:2] == b[:2] and a != b and len(x) == len(y))
        out |= {(*a, n) for s, n in c[:k] if -s >= least}
    return out


def cloud(n, dims, seed, p="p", k="chunk"):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(max(2, n // 12), dims))
    x = centres[r.integers(0, len(centres), n)] + r.normal(size=(n, dims)) * r.choice([0.1, 0.3, 0.6], size=(n, 1))
    x *= r.choice([0.01, 1, 50], size=(n, 1))
    return [row(f"{p}{k}{i:05d}", v, p, k) for i, v in enumerate(x.astype(np.float32))]


def found(spark, rows, **k):
    return {tuple(r)[:4] for r in V.neighbors(spark.createDataFrame(rows, DDL), **k).collect()}


def test_exact_on_clean_and_dirty_rows(spark):
    v = [1.0, 0.0, 0.0]
    rows = [row("a", v), row("b", [2, 0.1, 0]), row("c", [1, 0.2, 0.1]), row("d", [0, 1, 0]), row("e", [0, 0, 0]), row("f", None, dim=3), row("g", [1, 0], dim=3), row("h", [float("nan"), 1, 0]), row("i", [0, 1, 0], at=5), row("i", v, at=1), row("j", v, k="edge"), row("k", v, p="q"), (None, *row("z", v)[1:]), row("a", v)]
    rows += [row(f"copy{i}", v) for i in range(6)]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("tile,queries", [(8192, 16384), (37, 50)])
def test_recall(spark, monkeypatch, tile, queries):
    monkeypatch.setattr(V, "TILE", tile)
    monkeypatch.setattr(V, "QUERIES", queries)
    rows = cloud(1500, 64, 1) + cloud(400, 47, 2, "q") + cloud(60, 64, 3, "p", "edge")
    want = brute(rows)
    assert len(want) > 2000 and found(spark, rows) == want
    near = found(spark, rows, complete=False)
    assert len(near & want) >= 0.97 * len(want) and len(near - want) <= 0.03 * len(want)


def test_tiles_hold_neighbouring_cells():
    r = np.random.default_rng(4)
    centres, counts = r.normal(size=(60, 8)).astype(np.float32), r.integers(0, 50, 60)
    counts[7] = 900
    tile = V.tiles(centres, counts, 200)
    size = np.bincount(tile, counts)
    assert all(n <= 200 or (tile == t).sum() == 1 for t, n in enumerate(size)) and set(tile) == set(range(len(size))) and (tile == tile[7]).sum() == 1


def test_scanned_scores_are_within_the_error_of_a_code():
    r = np.random.default_rng(1)
    u = V._unit(r.normal(size=(3000, 48)).astype(np.float32))
    centres, book = V.fit(u, 12)
    home = V.nearest(u, centres, 1)[:, 0]
    packed = V.pack(V.encode(u, u - centres[home], book, V.eta(48)))
    mine = np.flatnonzero(home == home[0])
    plain = V.decode(centres[home[0]], book, packed[mine])
    eps = np.linalg.norm(u[mine] - plain, axis=1)
    score = V.scan(u[:40], centres[home[0]], book, packed[mine])
    assert np.allclose(score, u[:40] @ plain.T, atol=1e-4) and (np.abs(score - u[:40] @ u[mine].T) <= eps + 1e-5).all()


def test_score_aware_codes_keep_large_inner_products():
    r = np.random.default_rng(0)
    u = r.normal(size=(4000, 32)).astype(np.float32)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    centres, book = V.fit(u, 16)
    cell = V.nearest(u, centres, 1)[:, 0]
    left = u - centres[cell]

    def parallel(weight):
        codes = V.encode(u, left, book, weight)
        e = (left.reshape(len(u), -1, 2) - book[np.arange(len(book)), codes]).reshape(len(u), -1)
        return np.abs((e * u).sum(1)).mean(), (e * e).sum(1).mean()

    aware, plain = parallel(V.eta(32)), parallel(1.0)
    assert aware[0] < plain[0] and aware[1] >= plain[1] - 1e-9
    codes = V.encode(u[:50], left[:50], book, V.eta(32))
    one = cell[0]
    want = [(u[1] @ centres[one]) + sum(u[1].reshape(-1, 2)[j] @ book[j, codes[i, j]] for j in range(len(book))) for i in range(50)]
    assert np.allclose(V.scan(u[1:2], centres[one], book, V.pack(codes))[0], want, atol=1e-4)


def test_few_and_none(spark):
    assert found(spark, [row("a", [1, 2])]) == set() and found(spark, []) == set()
    assert found(spark, [row("a", [1, 2]), row("b", [2, 4.0])]) == {("p", "chunk", "a", "b"), ("p", "chunk", "b", "a")}
    assert found(spark, [row("a", [1e-30, 2e-30]), row("b", [1e30, 2e30])]) == {("p", "chunk", "a", "b"), ("p", "chunk", "b", "a")}


def matrix_brute(rows, k=3, least=0.85):
    x = np.array([r[3] for r in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c, names, out = np.round(x @ x.T, 9), np.array([r[2] for r in rows]), set()
    np.fill_diagonal(c, -2)
    for i, row_ in enumerate(c):
        near = np.flatnonzero(row_ >= least)
        out |= {(*rows[i][:3], str(names[j])) for j in near[np.lexsort((names[near], -row_[near]))][:k]}
    return out


def test_clump_of_nearly_equal_vectors(spark):
    r = np.random.default_rng(5)
    near = r.normal(size=48) + r.normal(size=(1500, 48)) * 0.05
    rows = cloud(1500, 48, 6) + [row(f"near{i:05d}", v) for i, v in enumerate(near.astype(np.float32))]
    want = matrix_brute(rows)
    assert found(spark, rows) == want
    assert found(spark, rows, probes=1) == want


def test_cosines_that_are_equal_to_nine_places(spark):
    r = np.random.default_rng(6)
    v = (r.normal(size=16) + r.normal(size=(400, 16)) * 1e-6).astype(np.float32)
    rows = [row(f"t{i:05d}", x) for i, x in enumerate(v)]
    assert found(spark, rows) == matrix_brute(rows)
