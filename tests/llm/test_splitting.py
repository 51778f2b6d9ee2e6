import random

import pytest

from tessera.llm import splitting as S

DDL = "chunk_id string, text string, file_path string"


def check(rows, texts, words, limit, overlap):
    by = {}
    for r in rows:
        by.setdefault(r.chunk_id, []).append(r)
    over = {i for i, t in texts.items() if len(t.split()) > words or len(t.encode()) > limit}
    assert set(by) == over
    for i, parts in by.items():
        parts.sort(key=lambda r: r.part_index)
        raw = texts[i].encode()
        assert [p.part_index for p in parts] == list(range(1, len(parts) + 1)) and {p.part_total for p in parts} == {len(parts)}
        assert parts[0].start_byte == 0 and parts[-1].end_byte == len(raw)
        for p, q in zip(parts, parts[1:]):
            assert p.end_byte == q.start_byte and q.from_byte <= q.start_byte
        for p in parts:
            assert p.text.encode() == raw[p.from_byte : p.end_byte]
            assert len(p.text.split()) <= words and len(p.text.encode()) <= limit
            assert p.tokens_estimate == len(p.text.split())
            assert len(raw[p.from_byte : p.start_byte]) <= overlap * limit + 1


def texts():
    rng = random.Random(5)
    code = lambda n: "".join(f"{'    ' * rng.randrange(3)}{rng.choice(['def', 'return', 'x ='])} {'w' * rng.randrange(1, 9)} é{i}\n{chr(10) * (rng.random() < 0.2)}" for i in range(n))
    return {
        "a": code(50), "b": code(900), "c": "", "d": " ".join(str(i) for i in range(3000)), "e": "ж" * 30_000, "f": "a" * 11_999 + "bc", "g": "a " * 512, "h": "a " * 513,
        "i": "x　y z\x1cq " * 200, "j": "\n" * 13_000, "k": code(9000),
    }


@pytest.mark.parametrize("size", [S.RANGE, 8192])
def test_parts_fit_and_rejoin(spark, size):
    t = texts()
    df = spark.createDataFrame([(k, v, "x") for k, v in t.items()] + [("a", t["a"], "x"), ("n", None, "x"), (None, "q " * 999, "x")], DDL)
    check(S.split_texts(df, size=size).collect(), t, S.WORDS, S.BYTES, S.OVERLAP)


def test_small_limits(spark):
    t = {k: v[:4000] for k, v in texts().items()}
    df = spark.createDataFrame([(k, v, "x") for k, v in t.items()], DDL)
    check(S.split_texts(df, words=60, limit=500).collect(), t, 60, 500, S.OVERLAP)
    with pytest.raises(ValueError):
        S.grain_of(8, 20)


def test_ranges_agree_with_one_range(spark):
    t = texts()
    df = spark.createDataFrame([("k", t["k"], "x"), ("e", t["e"], "x")], DDL)
    one = {(r.chunk_id, r.part_index, r.from_byte, r.end_byte) for r in S.split_texts(df, size=1 << 20, with_text=False).collect()}
    many = {(r.chunk_id, r.part_index, r.from_byte, r.end_byte) for r in S.split_texts(df, size=8192, with_text=False).collect()}
    assert {x[:2] for x in one} == {x[:2] for x in many}
    assert len(one & many) >= 0.9 * len(one)  # only the strength of a line whose predecessor begins before the halo may differ


def test_files_by_range(spark, tmp_path):
    text = texts()["k"]
    (tmp_path / "big.py").write_text(text)
    rows = S.split_files(spark, [str(tmp_path / "big.py")], size=16384).collect()
    rows.sort(key=lambda r: r.part_index)
    assert "".join(r.text[len(r.text) - len(text.encode()[r.start_byte : r.end_byte].decode()) :] for r in rows) == text


def test_cuts_prefer_definitions(spark):
    body = "".join(f"def f{i}():\n" + "    x = 1 + 2\n" * 30 + "\n" for i in range(12))
    rows = S.split_texts(spark.createDataFrame([("a", body, "x")], DDL)).collect()
    raw = body.encode()
    assert all(raw[r.start_byte :].startswith(b"def ") for r in rows)


def test_empty(spark):
    assert S.split_texts(spark.createDataFrame([], DDL)).count() == 0


def test_long_blank_runs(spark):
    texts = {"a": "HEADER\nBODY:\nx" + " " * 13000 + "y", "b": "x " + "\t" * 30000, "c": " " * 12000, "d": " " * 12001}
    items = spark.createDataFrame([(i, t, "f") for i, t in texts.items()], DDL)
    check(S.split_texts(items).collect(), texts, S.WORDS, S.BYTES, S.OVERLAP)
    assert {r.chunk_id for r in S.oversized_texts(items).collect()} == {"a", "b", "d"}
