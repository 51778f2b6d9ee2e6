"""One form for texts that look alike: a skeleton in the manner of Unicode's confusables.

skeleton: decompose canonically, replace every character by its prototype from the look-alike table, decompose again.
Prototypes: a full-width form is its ordinary form (by the <wide> decompositions of the Unicode data), a non-breaking blank of
any width is a space, a character that shows nothing is dropped, and a Cyrillic or Greek letter of a Latin letter's shape is that
letter. `kinds` says how wide the table is: STATED has just these; WIDER adds, by the Unicode data, half-width forms, letters in another typeface, ligatures and
numerals, besides letters of further scripts and all dashes. Case, visible accents, line breaks and the number of spaces stay. Documents are grouped by equal skeleton.

Only a 16-byte digest of text and skeleton is shuffled. Pairs are made between different texts only, never within a group of exact
copies: each text of a group is one row with its documents beside it.

Defined cases: a null id or text is left out; an empty text is its own skeleton; repeated rows count once; very long texts
are taken whole. Empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import Scratch

# Letters that share a shape, written as pairs of one letter and its Latin prototype. STATED ones are told apart in no common typeface; the
# further ones in some.
CYRILLIC = "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ҮY ХX ԌG ԚQ ԜW аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ӏl ӀI ѵv"
GREEK = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ οo νv ϲc ϳj"
FURTHER = "αa γy ιi κk ρp σo τt υu ɑa ɡg ıi Ѵv Ԁd ԐE ѡw ԍg Օo օo ոn սu հh զq ցg ՏS ԼL ᎠD ᎢT ᎪA ᎬE ᎫJ ᎳW ᎻH ᏀG ᏃZ ᏒR ᏔW ᏢP ᏦK ᏴB ᏙV ᏚS ᏟC ᏞL ᎷM"
# Blanks that forbid a line break.
NON_BREAKING = "\u00a0\u2007\u202f"
# Signs outside the format and control categories that show nothing (grapheme joiner, fillers, variation selectors), and format characters that show.
INVISIBLE = "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0" + "".join(map(chr, [*range(0xFE00, 0xFE10), *range(0x180B, 0x180E), *range(0xE0100, 0xE01F0)]))
VISIBLE_FORMATS = "\u0600\u0601\u0602\u0603\u0604\u0605\u06dd\u070f\u0890\u0891\u08e2\U000110bd\U000110cd"
#: Kinds of compatibility decomposition that keep the shape: full-width forms count as stated; half-width forms, letters in another typeface, and letters
#: written together (ligatures, Roman numerals) count as well where a wider table is asked for.
STATED, WIDER = ("wide",), ("wide", "narrow", "font", "compat")


@cache
def prototypes(kinds: tuple[str, ...] = STATED) -> dict[int, str]:
    """Look-alike table: code point to prototype ('' drops it). With more than full-width forms it also has further letters and one form of all dashes.

    Of the <compat> decompositions only those of letters and numerals into letters keep the shape; signs, fractions and spaces do not.
    """
    table: dict[int, str] = {}
    for cp in range(sys.maxunicode + 1):
        c = chr(cp)
        kind, how = unicodedata.category(c), unicodedata.decomposition(c)
        if kind == "Cf" and c not in VISIBLE_FORMATS or kind == "Cc" and not c.isspace():
            table[cp] = ""
        elif how.startswith("<") and (tag := how[1 : how.index(">")]) in kinds and (tag != "wide" or cp >= 0x3000):
            to = unicodedata.normalize("NFKC", c)
            if tag != "compat" or kind in ("Ll", "Lu", "Lt", "Lo", "Nl") and to.isalpha():
                table[cp] = to
    if kinds != STATED:
        table |= {ord(p[0]): p[1] for p in FURTHER.split()}
        table |= {cp: "-" for cp in range(sys.maxunicode + 1) if unicodedata.category(chr(cp)) == "Pd"} | {0x2212: "-", 0x2043: "-"}
    table |= {ord(c): "" for c in INVISIBLE} | {ord(c): " " for c in NON_BREAKING}
    table |= {ord(p[0]): p[1] for p in f"{CYRILLIC} {GREEK}".split()}
    # a prototype is mapped as well, so that a bold Greek letter has that of its plain form
    return {cp: to if len(to) != 1 else table.get(ord(to), to) for cp, to in table.items()}


def skeleton(text: str, table: dict[int, str] | None = None) -> str:
    if text.isascii() and text.isprintable():
        return text
    table = prototypes() if table is None else table
    # dropping a sign can bring marks together, so they are put in order once more
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(table))


def with_skeleton(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[str, ...] = STATED) -> DataFrame:
    """id, skeleton of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if t is None else skeleton(t, prototypes(kinds)) for t in b.column(1).to_pylist()], pa.string())], [id_col, "skeleton"])

    rows = docs.select(id_col, text_col).filter(F.col(id_col).isNotNull())
    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, skeleton string")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[str, ...] = STATED) -> DataFrame:
    """id, form (digest of the text), shape (digest of its skeleton)."""
    digest = lambda t: xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms, shapes = [], []
            for t in b.column(1).to_pylist():
                s = skeleton(t, prototypes(kinds))
                forms.append(digest(t))
                shapes.append(forms[-1] if s == t else digest(s))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(forms, pa.binary()), pa.array(shapes, pa.binary())], ["id", "form", "shape"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, form binary, shape binary")


def look_alikes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[str, ...] = STATED) -> DataFrame:
    """(doc_id_a, doc_id_b), smaller first: documents whose texts differ and whose skeletons are equal.

    Texts are paired before their documents are joined, so copies of one text never meet each other.
    """
    rows = Scratch(docs.sparkSession, "lookalikes").cut(digests(docs, id_col, text_col, kinds), "digests")
    forms = rows.select("shape", "form").distinct()
    mixed = forms.groupBy("shape").agg(F.count("*").alias("forms")).filter("forms > 1").select("shape")
    some = forms.join(mixed, "shape")
    pairs = some.select("shape", F.col("form").alias("fa")).join(some.select("shape", F.col("form").alias("fb")), "shape").filter("fa < fb").select("fa", "fb")
    a, b = rows.select(F.col("form").alias("fa"), F.col("id").alias("a")), rows.select(F.col("form").alias("fb"), F.col("id").alias("b"))
    out = pairs.join(a, "fa").join(b, "fb").filter("a <> b")
    return out.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b")).distinct()


def skeleton_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[str, ...] = STATED) -> DataFrame:
    """One row per document: doc_id, group_id (the smallest id with an equal skeleton), n_docs, n_forms (different texts in the group).

    This is look_alikes without its pairs: two documents of a group look alike, and differ if their texts do.
    """
    rows = digests(docs, id_col, text_col, kinds).distinct()
    form = rows.groupBy("shape", "form").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    group = form.groupBy("shape").agg(F.min("low").alias("group_id"), F.sum("n").alias("n_docs"), F.count("*").alias("n_forms"))
    return rows.select("id", "shape").join(group, "shape").select(F.col("id").alias("doc_id"), "group_id", "n_docs", "n_forms")
