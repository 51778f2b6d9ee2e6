import random

import pytest

from tessera.operators import hierarchy as H

DDL = "id string, container_id string, name string, root_id string, depth string, parent string"


def brute(parent):
    out = {}
    for x in parent:
        seen, y = [x], x
        while parent.get(y) in parent:
            y = parent[y]
            if y in seen:
                ring = seen[seen.index(y) :]
                out[x] = (min(ring), -1 if x in ring else -2)
                break
            seen.append(y)
        else:
            out[x] = (y, len(seen) - 1)
    return out


def table(spark, parent):
    return spark.createDataFrame([(k, v, f"n{k}", "x", "y", "z") for k, v in parent.items()], DDL)


@pytest.mark.parametrize("patience,paths", [(2, False), (2, True), (64, False), (64, True)])
def test_against_brute_force(spark, patience, paths):
    rng = random.Random(patience * 2 + paths)
    ids = [f"{i:03d}" for i in range(120)]
    parent = {x: rng.choice([None, " ", "", "gone", *ids, *ids[:4]]) for x in ids}
    parent |= {f"c{i:03d}": f"c{i + 1:03d}" for i in range(12)} | {"c012": None, "s": "s", "t": "s"}
    tree = H.hierarchy(table(spark, parent), paths=paths, patience=patience)
    rows = tree.collect()
    assert {r.id: (r.root_id, r.depth) for r in rows} == brute(parent) and len(rows) == len(parent)
    by = {r.id: r for r in rows}
    above = {}
    for r in rows:
        x, above[r.id] = r, []
        while x.parent and x.depth != -1:
            x = by[x.parent]
            above[r.id].append(x.id)
    assert {r.id: r.parent for r in rows} == {k: v if v in parent else None for k, v in parent.items()}
    got = H.descendants(tree).collect()
    assert {(r.ancestor_id, r.descendant_id, r.distance) for r in got} == {(a, x, i + 1) for x, up in above.items() for i, a in enumerate(up)} and len(got) == sum(map(len, above.values()))
    if paths:
        for r in rows:
            assert r.n_above == len(above[r.id]) and r.path == ".".join(f"n{a}" for a in [*above[r.id][::-1], r.id])


def test_a_deep_chain_in_few_steps(spark):
    n = 400
    rows = spark.range(n).selectExpr("CAST(id AS STRING) AS id", "IF(id > 0, CAST(id - 1 AS STRING), NULL) AS container_id", "CAST(id % 7 AS STRING) AS name")
    got = {r.id: r for r in H.hierarchy(rows, patience=6).collect()}
    assert len(got) == n and all(r.depth == int(r.id) == r.n_above and r.root_id == "0" for r in got.values())
    assert got["399"].path == ".".join(str(i % 7) for i in range(n))


def test_descendants_and_circles(spark):
    t = H.hierarchy(table(spark, {"a": None, "b": "a", "c": "b", "x": "y", "y": "x", "z": "y"}))
    assert {(r.ancestor_id, r.descendant_id, r.distance) for r in H.descendants(t).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("y", "z", 1)}
    assert [(r.root_id, r.on_circle, r.leading_in) for r in H.circles(t).collect()] == [("x", 2, 1)]


def test_repeated_rows_nulls_and_empty(spark):
    rows = [("a", None, "n", "", "", ""), ("b", "a", "m", "", "", ""), ("b", "a", "m", "", "", ""), ("b", None, None, "", "", ""), (None, "a", "q", "", "", "")]
    got = {r.id: (r.root_id, r.depth, r.path) for r in H.hierarchy(spark.createDataFrame(rows, DDL)).collect()}
    assert got == {"a": ("a", 0, "n"), "b": ("a", 1, "n.m")}
    assert H.hierarchy(spark.createDataFrame([], DDL)).count() == 0
