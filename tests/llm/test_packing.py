import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packing as K
from tessera.llm import token_counts as C

DDL = "doc_id bigint, text string, tokens bigint, size string"


def check(plan, counts, capacity):
    load, seen = np.zeros(max(1, plan.bins), np.int64), {}
    for size, lo, hi, each, first in plan.runs:
        assert seen.get(size, 0) == lo
        seen[size] = hi
        np.add.at(load, first + np.arange(hi - lo) // each, size)
    assert seen == {s: n for s, n in counts.items() if n} and load.max() <= capacity
    return load


@given(st.dictionaries(st.integers(0, 40), st.integers(0, 60), max_size=20), st.integers(40, 90))
@settings(max_examples=150, deadline=None)
def test_any_counts(counts, capacity):
    check(K.Plan(counts, capacity), counts, capacity)


def best_fit(sizes, capacity):
    room = []
    for s in sorted(sizes, reverse=True):
        fit = min((r for r in room if r >= s), default=None)
        if fit is None:
            room.append(capacity - s)
        else:
            room[room.index(fit)] -= s
    return len(room)


@pytest.mark.parametrize("low,high,share", [(1, 512, 0.95), (130, 300, 0.95), (1, 120, 0.999), (200, 260, 0.97)])
def test_little_space_is_left(low, high, share):
    r = np.random.default_rng(low)
    sizes = r.integers(low, high + 1, 20_000)
    counts = dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True))))
    plan = K.Plan(counts, 512)
    check(plan, counts, 512)
    small = r.permutation(sizes)[:1500]
    few = K.Plan(dict(zip(*(x.tolist() for x in np.unique(small, return_counts=True)))), 512)
    least = -(-int(small.sum()) // 512)
    assert few.bins <= best_fit(small.tolist(), 512) * 1.06
    assert least <= few.bins and (sizes.sum() / 512 / plan.bins >= share or plan.bins <= best_fit(sizes[:4000].tolist(), 512) * 5 * 1.03)


def test_configurations_meet_demand():
    got = K.configurations([60, 45, 30], [10, 20, 30], 100)
    assert all(sum([60, 45, 30][g] for g in p) <= 100 for p, _ in got) and sum(t for _, t in got) <= 31


def test_containers(spark):
    words = lambda n: " ".join(["word"] * n)
    rows = [(i, words(n), 0, "x") for i, n in enumerate([1, 5, 20, 20, 33, 50, 64, 65, 200, 0, 7, 7, 7])] + [(3, words(9), 0, "x"), (99, None, 0, "x"), (None, "a", 0, "x")]
    caps = spark.createDataFrame([("s", 64, 1), ("b", 1000, 1), ("bad", 0, 1), (None, 5, 1), ("s", 80, 1)], "container_kind string, capacity_tokens int, tokens int")
    df = spark.createDataFrame(rows, DDL)
    got = K.containers(df, caps)
    out = got.collect()
    size = {i: C.count(t) for i, t in [(r[0], r[1]) for r in rows if r[1] is not None and r[0] is not None]}
    for kind, cap in (("s", 64), ("b", 1000)):
        mine = [r for r in out if r.container_kind == kind]
        assert {r.doc_id for r in mine} == set(size)
        load = {}
        for r in mine:
            load[r.container_id] = load.get(r.container_id, 0) + r.tokens
            assert (r.pieces > 1) == (r.from_token + r.tokens > cap or r.pieces > 1)
        assert max(load.values()) <= cap
        assert sum(r.tokens for r in mine) == sum(C.count(r[1]) for r in rows if r[0] is not None and r[1] is not None)
        for d in (7, 8):
            parts = sorted((r.piece, r.from_token, r.tokens, r.pieces) for r in mine if r.doc_id == d)
            assert len(parts) == parts[0][3] == max(1, -(-size[d] // cap)) and [p[1] for p in parts] == [i * cap for i in range(len(parts))]
    report = {r.container_kind: r for r in K.fill_report(got, caps).collect()}
    assert set(report) == {"s", "b"} and report["b"].containers == 1 and report["s"].fullest <= 64
    assert K.containers(df.limit(0), caps).count() == 0 and K.containers(df, caps.limit(0)).count() == 0


def test_token_count_in_stretches(monkeypatch):
    text = "".join(f"line {i} été, (x)\n\n  indented\nlast {i * 7}\r\n" for i in range(400))
    whole = len(C.encoder(C.VOCABULARY).encode_ordinary(text))
    for n in (5, 64, 1000):
        monkeypatch.setattr(C, "STRETCH", n)
        assert C.count(text) == whole
    assert C.count("") == 0 and C.count("<|endoftext|>") > 1
