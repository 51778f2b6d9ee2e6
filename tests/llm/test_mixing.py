import random

import numpy as np

from tessera.llm import mixing as M

DDL = "doc_id bigint, text string, source string, tokens string"
TG = "source string, weight double, max_repeats int, share double"


def docs(n=600, seed=1, unknown=0.1):
    r = random.Random(seed)
    words = {s: [f"{s}{i}" for i in range(40)] for s in "abc"}
    rows = []
    for i in range(n):
        s = r.choices("abc", [0.6, 0.35, 0.05])[0]
        text = " ".join(r.choice(words[s] if r.random() < 0.7 else ["the", "of", "and"]) for _ in range(r.randrange(5, 60)))
        rows.append((i, text, None if r.random() < unknown else s, s))
    return rows


def run(spark, rows, targets, **k):
    chosen, report = M.mixture(spark.createDataFrame(rows, DDL), spark.createDataFrame(targets, TG), **k)
    return chosen.collect(), {r.source: r for r in report.collect()}


TARGETS = [("a", 0.3, 1, 0.0), ("b", 0.4, 2, 0.0), ("c", 0.2, 3, 0.0), ("empty", 0.1, 5, 0.0)]


def test_weights_are_reached(spark):
    rows = docs()
    chosen, rep = run(spark, rows, TARGETS, total_tokens="reachable")
    assert rep["empty"].share == 0 and rep["empty"].available_tokens == 0
    for s, w in (("a", 0.3), ("b", 0.4), ("c", 0.2)):
        assert abs(rep[s].share - w / 0.9) < 0.02 and rep[s].most_repeats <= rep[s].max_repeats
    assert len({r.doc_id for r in chosen}) == len(chosen) and abs(sum(r.share for r in rep.values()) - 1) < 1e-5
    assert rep["c"].labelled_tokens >= 0.9 * 3 * rep["c"].available_tokens - rep["c"].soft_tokens


def test_large_totals_stop_at_the_caps(spark):
    chosen, rep = run(spark, docs(), TARGETS, total_tokens=10**7)
    for s in "abc":
        assert rep[s].labelled_tokens == rep[s].max_repeats * rep[s].available_tokens
    assert all(r.repeats <= {"a": 1, "b": 2, "c": 3, None: 1}[r.source] for r in chosen)


def test_total_is_met(spark):
    _, rep = run(spark, docs(), TARGETS[:2], total_tokens=3000)
    got = sum(r.labelled_tokens + r.soft_tokens for r in rep.values())
    assert abs(got - 3000) < 150 and abs(rep["a"].share - 3 / 7) < 0.03


def test_classifier_on_held_out_documents(spark):
    train, test = docs(800, 2, 0), docs(300, 3, 0)
    model = M.learn(spark.createDataFrame(train, DDL), ["a", "b", "c"])
    seen = {}
    p = np.array([M.posterior(model, t, seen) for _, t, _, _ in test])
    assert np.mean(p.argmax(1) == ["abc".index(r[3]) for r in test]) > 0.95 and np.allclose(p.sum(1), 1)
    assert abs(M.posterior(model, "", seen).sum() - 1) < 1e-9


def test_fit_gives_every_text_its_rate(spark):
    """Memberships are soft, so texts of one source have different rates; expected tokens meet the targets within the caps."""
    rng = np.random.default_rng(5)
    soft = [(lambda p: [p, 1 - p])(x) for x in rng.random(400)]
    rows = [(i, -1 if i % 4 == 0 else int(m[0] < 0.5), int(rng.integers(5, 50)), i, bytes([i % 256]), np.array(m, np.float32).tobytes()) for i, m in enumerate(soft)]
    texts = spark.createDataFrame(rows, "doc_id bigint, label int, tokens bigint, u bigint, text_key binary, soft binary")
    target, caps = np.array([1500.0, 4500.0]), np.array([1.0, 2.0])
    rates, got = M.fit(texts, target, np.array([0.5, 1.0]), caps)
    assert np.abs(got - target).max() < 0.02 * target.min()
    batch = texts.toArrow().combine_chunks().to_batches()[0]
    r, m = rates.of(batch)
    label = batch.column("label").to_numpy()
    assert (r >= 0).all() and (r <= np.append(caps, 1.0)[label]).all() and len(set(np.round(r[label == 1], 6))) > 20
    assert np.allclose((r * batch.column("tokens").to_numpy()) @ m, got)


def test_the_whole_table_is_the_default_total(spark):
    """Scarce sources repeat up to their caps and say what is missing, the others have their part of the total within one per cent."""
    rows = docs(2000, 6, 0.05)
    chosen, rep = run(spark, rows, TARGETS)
    total = sum(r.asked_tokens for r in rep.values())
    assert abs(total - sum(M.count(t) for t in {r[1] for r in rows})) <= 4
    for s, r in rep.items():
        got, most = r.labelled_tokens + r.soft_tokens, r.max_repeats * r.available_tokens
        assert abs(r.shortfall_tokens - max(0, r.asked_tokens - max(got, most))) <= 1
        assert r.labelled_tokens == most or abs(got - r.asked_tokens) <= 0.01 * r.asked_tokens
    assert rep["c"].most_repeats == 3 and rep["c"].shortfall_tokens > 0 and rep["c"].repeated_texts == rep["c"].available_texts
    assert sum(r.tokens * r.repeats for r in chosen) == sum(r.labelled_tokens for r in rep.values()) + round(sum(r.soft_tokens for r in rep.values()))


def test_nulls_and_empty(spark):
    rows = docs(50) + [(None, "a1", "a", ""), (900, None, "a", ""), (901, "", "b", ""), (902, "a1 a2", "other", ""), (0, "a1 a2", "a", "")]
    chosen, rep = run(spark, rows, TARGETS + [(None, 0.5, 1, 0.0), ("a", None, 1, 0.0), ("b", 0.4, None, 0.0)])
    assert {r.doc_id for r in chosen} <= {r[0] for r in rows} - {None, 900, 901} and rep["b"].max_repeats == 1
    assert run(spark, [], TARGETS)[0] == [] and run(spark, docs(5), [])[0] == []


def test_copies_of_a_text_share_its_cap(spark):
    copied = "b1 b2 b3 b4 b5 b6 b7 the of and"
    rows = [r for r in docs(60, 4, 0) if r[2] == "b"] + [(1000 + i, copied, "b", "b") for i in range(60)] + [(2000 + i, copied, s, "b") for i, s in enumerate([None, None, "c"])]
    chosen, rep = run(spark, rows, [("b", 1.0, 2, 0.0)], total_tokens="reachable")
    text, times = {r[0]: r[1] for r in rows}, {}
    for r in chosen:
        times[text[r.doc_id]] = times.get(text[r.doc_id], 0) + r.repeats
    assert len({r.doc_id for r in chosen}) == len(chosen)
    assert set(times.values()) == {2} and set(times) == set(text.values()) and rep["b"].most_repeats == 2
    assert rep["b"].labelled_tokens == 2 * rep["b"].available_tokens


def test_all_labelled_tokens_as_total(spark):
    rows = [r for r in docs(60, 4, 0) if r[2] == "b"]
    _, rep = run(spark, rows, [("b", 1.0, 3, 0.0)], total_tokens="labelled")
    assert rep["b"].labelled_tokens == rep["b"].available_tokens and rep["b"].most_repeats == 1
