import random

import pytest

from tessera.llm import near_dup as N

DDL = "chunk_id string, text string, rid string, n string"


def sets_of(text, width=3, least=20):
    w = N.body_words(text)
    s = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
    return s if len(s) >= least else None


def brute(rows, t=0.6):
    s = [(i, sets_of(x)) for i, x in rows if i is not None and x is not None]
    s = [(i, x) for i, x in s if x]
    return {(min(a, b), max(a, b)) for k, (a, x) in enumerate(s) for b, y in s[:k] if a != b and len(x & y) >= t * len(x | y) - 1e-9}


def corpus(seed, n=80, vocabulary=60):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(vocabulary)}"
    base = [[word() for _ in range(r.randrange(15, 90))] for _ in range(8)]
    rows = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 4, 9, 20])):
            k = r.randrange(len(w))
            op = r.randrange(3)
            w[k : k + op] = [word() for _ in range(r.randrange(0, 3))] or ["q"]
        rows.append((f"c{i:03d}", "KIND: x\n\nBODY:\n\n" + " ".join(w)))
    return rows


@pytest.mark.parametrize("seed,family,most,hot", [(1, 64, 2048, 4096), (2, 3, 4, 2), (3, 64, 6, 4096), (4, 1, 2048, 1)])
def test_against_brute_force(spark, monkeypatch, seed, family, most, hot):
    monkeypatch.setattr(N, "FAMILY", family)
    monkeypatch.setattr(N, "LIST", most)
    monkeypatch.setattr(N, "HOT", hot)
    rows = corpus(seed, vocabulary=60 if seed < 3 else 12) + [("nul", None), (None, "BODY:\n" + "a " * 99), ("none", "no body"), ("empty", "")]
    rows += [("copy1", rows[0][1]), ("copy2", rows[0][1]), rows[1]]
    got = [tuple(r) for r in N.expand(*N.similar(spark.createDataFrame([(*r, "x", "y") for r in rows], DDL))).collect()]
    assert set(got) == brute(rows) and len(got) == len(set(got))


def test_threshold_is_met_exactly(spark):
    a = [f"a{i}" for i in range(26)]  # 24 sequences
    for k, want in ((17, True), (16, False)):  # 15 or 14 of 24 + 9 or 10 sequences in common
        b = a[:k] + [f"b{i}" for i in range(26 - k)]
        x, y = sets_of("BODY:\n" + " ".join(a)), sets_of("BODY:\n" + " ".join(b))
        t = len(x & y) / len(x | y)
        df = spark.createDataFrame([("p", "BODY:\n" + " ".join(a), "", ""), ("q", "BODY:\n" + " ".join(b), "", "")], DDL)
        assert N.expand(*N.similar(df, threshold=t)).count() == 1 and N.expand(*N.similar(df, threshold=t + 0.01)).count() == 0


def test_groups(spark):
    rows = corpus(5, 60)
    rows += [(f"z{i}", rows[0][1]) for i in range(30)] + [("alone", "BODY:\n" + " ".join(f"u{i}" for i in range(40))), ("short", "BODY:\nx y"), ("nul", None)]
    got = {r.chunk_id: r for r in N.groups(spark.createDataFrame([(*r, "", "") for r in rows], DDL)).collect()}
    pairs = brute(rows)
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[max(find(a), find(b))] = min(find(a), find(b))
    assert set(got) == {i for i, t in rows}
    sets = {i: sets_of(t) if t else None for i, t in rows}
    for i in got:
        assert got[i].group_id == min(j for j in got if find(j) == find(i))
        same = [j for j in got if sets[j] is not None and sets[j] == sets[i]] or [i]
        assert got[i].class_id == min(same)
        assert got[i].links == len({frozenset(sets[b if a == i else a]) for a, b in pairs if i in (a, b)} - {frozenset(sets[i] or ())})


def test_empty(spark):
    df = spark.createDataFrame([], DDL)
    assert N.expand(*N.similar(df)).count() == 0 and N.groups(df).count() == 0


def test_long_text(spark):
    w = [f"t{i % 7919}x{i % 13}" for i in range(60_000)]
    df = spark.createDataFrame([("a", "BODY:\n" + " ".join(w), "", ""), ("b", "BODY:\n" + " ".join(w[300:]), "", "")], DDL)
    assert [tuple(r) for r in N.expand(*N.similar(df)).collect()] == [("a", "b")]
