import unicodedata

import pytest

from tessera.llm import lookalikes as L

DDL = "doc_id bigint, text string, form string, shape string"


@pytest.mark.parametrize("a,b", [("ｆｕｌｌ１！", "full1!"), ("café", "café"), ("a​b­c﻿", "abc"), ("a b c d", "a b c d"), ("сору", "copy"), ("ΑΒο", "ABo"), ("ї", "ï"), ("　", " "), ("e​́", "é"), ("x️", "x")])
def test_equal(a, b):
    assert L.skeleton(a) == L.skeleton(b)


@pytest.mark.parametrize("a,b", [("A", "a"), ("e", "é"), ("a b", "a  b"), ("a\nb", "a b"), ("0", "O"), ("a b", "a b"), ("a\r\nb", "a\nb"), ("1", "l")])
def test_different(a, b):
    assert L.skeleton(a) != L.skeleton(b)


def test_skeleton_is_stable():
    for cp in [*range(0x20, 0x600), *range(0x1E00, 0x2100), *range(0xFF00, 0xFFF0)]:
        s = L.skeleton("a" + chr(cp) + "b")
        assert L.skeleton(s) == s and unicodedata.is_normalized("NFD", s)


def test_pairs(spark):
    rows = [(1, "abc", "", ""), (2, "abc", "", ""), (3, "а​bc", "", ""), (4, "ａbc", "", ""), (5, "zzz", "", ""), (5, "zzz", "", ""), (6, "zzz", "", ""), (7, "", "", ""), (8, "​", "", ""), (9, None, "", ""), (None, "abc", "", ""), (3, "а​bc", "", "")]
    got = [tuple(r) for r in L.look_alikes(spark.createDataFrame(rows, DDL)).collect()]
    assert sorted(got) == [(1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (7, 8)]
    groups = {r.doc_id: (r.group_id, r.n_docs, r.n_forms) for r in L.skeleton_groups(spark.createDataFrame(rows, DDL)).collect()}
    assert groups == {1: (1, 4, 3), 2: (1, 4, 3), 3: (1, 4, 3), 4: (1, 4, 3), 5: (5, 2, 1), 6: (5, 2, 1), 7: (7, 2, 2), 8: (7, 2, 2)}
    assert {r.doc_id: r.skeleton for r in L.with_skeleton(spark.createDataFrame(rows[:4], DDL)).collect()} == {1: "abc", 2: "abc", 3: "abc", 4: "abc"}


def test_long_and_empty(spark):
    rows = [(1, "x" * 500_000 + "é", "", ""), (2, "x" * 500_000 + "é", "", "")]
    assert L.look_alikes(spark.createDataFrame(rows, DDL)).count() == 1
    assert L.look_alikes(spark.createDataFrame([], DDL)).count() == 0 and L.skeleton_groups(spark.createDataFrame([], DDL)).count() == 0


def test_format_characters_that_show_stay():
    assert L.skeleton("\u06dd5") != L.skeleton("5") and L.skeleton("a\u0600") != "a" and L.skeleton("a\u200d\U000e0101b") == "ab"


def test_wider_table():
    wide = L.prototypes(L.WIDER)
    for a, b in (("ｶﾞ", "ガ"), ("Ⅷ", "VIII"), ("𝐁old", "Bold"), ("𝛢", "A"), ("ﬁt", "fit"), ("5−3", "5-3"), ("Տ", "S"), ("Ꭺ", "A"), ("a–b", "a-b")):
        assert L.skeleton(a, wide) == L.skeleton(b, wide), a
    for a, b in (("①", "1"), ("½", "1/2"), ("x²", "x2"), ("é", "e"), ("A", "a"), ("…", "...")):
        assert L.skeleton(a, wide) != L.skeleton(b, wide), a
    assert all(L.skeleton(x, wide) == L.skeleton(L.skeleton(x, wide), wide) for x in map(chr, range(0x20, 0xD800)))


def test_groups_hold_the_pairs(spark):
    rows = spark.createDataFrame([(1, "Ab c"), (2, "Аb\u00a0c"), (3, "Ab c"), (4, "ab c"), (5, None), (None, "Ab c"), (6, "")], "doc_id bigint, text string")
    groups = {r.doc_id: (r.group_id, r.n_docs, r.n_forms) for r in L.skeleton_groups(rows).collect()}
    assert groups == {1: (1, 3, 2), 2: (1, 3, 2), 3: (1, 3, 2), 4: (4, 1, 1), 6: (6, 1, 1)}
