"""Splitting oversized items at natural boundaries by byte ranges.

An item is never scanned as one piece of work: it is cut into byte ranges of `RANGE` bytes, each with a halo of `HALO` bytes on both
sides. A worker detects the boundaries that lie in its range; whether a place is a boundary depends on the bytes within the halo only, so
neighbouring ranges agree. The segment from a boundary to the next costs the larger of its words and its bytes as shares of the limits.
Range totals are stitched by a prefix sum per item, which places every boundary on the item's cost axis. With m pieces of
equal cost total / m, at most 1 - overlap - SLACK, the strongest boundary within SLACK / 2 of each multiple is the cut. So cuts are found where their
bytes are, with no pass over a whole item, and a piece with its overlap never exceeds a limit. Pieces are emitted from byte
offsets: the bytes of each range that they touch, put together in order.

Boundaries, strongest first: the line of a definition without indentation, of any definition, a line after a blank one, a line with less
indentation than the one before, any other line; in lines longer than `grain` bytes the first word of each grain; in words longer than that the
first character of each grain, and in blank runs longer than that the first blank of each grain.

Overlap: a piece begins with the last segments before its cut, at most `overlap` of the limit, from a line's begin if there is one.

Defined cases: a null id or text leaves a row out. An item within both limits is not split. Rows of one id with different texts are split each;
equal rows count once. Texts are cut only between characters. Empty tables give empty results; further columns are ignored. The
limits must be at least 32 words and 64 bytes; bytes that are no UTF-8 (files only) come out as replacement characters.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.runtime import Scratch

WORDS, BYTES, OVERLAP, SLACK = 512, 12_000, 0.1, 0.2
RANGE, HALO = 1 << 16, 1 << 12
UNIT = 1_000_000
_DEFINITION = re.compile(rb"[ \t]*(?:@|#\[|(?:pub(?:\(\w+\))? |export |default |public |private |protected |static |final |abstract |async |unsafe )*(?:def|class|func|fn|function|interface|trait|struct|enum|impl|type|mod|namespace)\b)")
# words as Python's str.split sees them, in UTF-8
_WORD = re.compile(rb"(?:[^\t-\r\x1c-\x20\x80-\xc2\xe1-\xe3][\x80-\xbf]*|\xc2[^\x85\xa0]|\xe1(?!\x9a\x80)[\x80-\xbf]*|\xe2(?!\x80[\x80-\x8a\xa8\xa9\xaf]|\x81\x9f)[\x80-\xbf]*|\xe3(?!\x80\x80)[\x80-\xbf]*)+")


def ranges_of_texts(items: DataFrame, id_col: str, text_col: str, size: int = RANGE, halo: int = HALO) -> DataFrame:
    """item (digest of id and text), id, length, at (first byte of the range), before (bytes of halo before it), part (binary with both halos)."""
    raw = items.select(F.col(id_col).cast("string").alias("id"), F.encode(text_col, "utf-8").alias("raw")).filter("id IS NOT NULL AND raw IS NOT NULL")
    whole = raw.withColumns({"item": F.md5(F.concat(F.encode("id", "utf-8"), F.encode(F.lit("\n"), "utf-8"), "raw")), "length": F.octet_length("raw").cast("long")})
    # the parts are cut before they are spread over rows, so that no row carries the whole text
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.col("length") - 1).cast("long"), F.lit(size).cast("long"))
    lead = lambda at: F.least(at, F.lit(halo).cast("long"))
    part = lambda at: F.struct(at.alias("at"), lead(at).cast("int").alias("before"), F.substring(F.col("raw"), (at - lead(at) + 1).cast("int"), (lead(at) + F.lit(size + halo)).cast("int")).alias("part"))
    return whole.select("item", "id", "length", F.inline(F.transform(starts, part)))


def ranges_of_files(spark: SparkSession, paths: list[str], size: int = RANGE, halo: int = HALO) -> DataFrame:
    """The same for files that all executors reach: each worker opens a file and reads its range alone."""
    from pyarrow import fs

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column("id").to_pylist()
            found = [fs.FileSystem.from_uri(p if "://" in p else f"file://{p}") for p in names]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([system.get_file_info(inner).size for system, inner in found], pa.int64())], ["id", "length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p, length, at in zip(*(b.column(c).to_pylist() for c in ("id", "length", "at"))):
                system, inner = fs.FileSystem.from_uri(p if "://" in p else f"file://{p}")
                lead = min(at, halo)
                with system.open_input_file(inner) as f:
                    f.seek(at - lead)
                    out.append({"item": xxhash.xxh3_128_hexdigest(p), "id": p, "length": length, "at": at, "before": lead, "part": f.read(lead + size + halo)})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("item", pa.string()), ("id", pa.string()), ("length", pa.int64()), ("at", pa.int64()), ("before", pa.int32()), ("part", pa.binary())]))

    # sizes are asked for in tasks, as there may be millions of files
    files = spark.createDataFrame([(p,) for p in paths], "id string").repartition(max(1, min(200, len(paths) // 1000))).mapInArrow(sizes, "id string, length bigint")
    rows = files.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.col("length") - 1).cast("long"), F.lit(size).cast("long"))))
    return rows.repartition("id", "at").mapInArrow(run, "item string, id string, length bigint, at bigint, before int, part binary")


def grain_of(words: int, limit: int) -> int:
    """Distance of boundaries in long lines: three grains hold at most SLACK of either limit."""
    if words < 32 or limit < 64:
        raise ValueError("the limits must be at least 32 words and 64 bytes")
    return max(4, min(int(limit * SLACK / 3), int(words * 2 * SLACK / 3)))


def boundaries(part: bytes, before: int, at: int, size: int, grain: int) -> list[tuple[int, int]]:
    """(place in part, strength) of the boundaries from the range's first byte to the part's end."""
    end = len(part)
    marks: dict[int, int] = {}
    starts = [m.end() for m in re.finditer(b"\n", part) if m.end() < end]
    whole = before == 0
    lines = list(zip([0, *starts], [*starts, end]))
    indent = None  # of the line before; -1 after a blank line
    for i, (s, e) in enumerate(lines):
        line = part[s:e]
        bare = line.lstrip(b" \t")
        here = len(line) - len(bare)
        if not bare.strip():
            strength, here = 2, -1
        elif m := _DEFINITION.match(line):
            strength = 5 if here == 0 else 4 if indent == -1 or not m.group().lstrip().startswith((b"@", b"#")) else 3
        else:
            strength = 3 if indent == -1 else 2
        if bare.strip() and indent is not None and 0 <= here < indent and strength == 2:
            strength = 3
        indent = here
        if i or whole:
            marks[s] = strength + 1
        from_ = s if i or whole else s - grain - 1  # the begin of a part stands deep in its line
        if e - from_ <= grain or e <= before:
            continue
        last = last_end = s
        for w in _WORD.finditer(part, s, e):
            p, q = w.span()
            if p - last_end > grain:
                marks.update((g - at + before, 1) for g in range(-(-(at - before + last_end + 1) // grain) * grain, at - before + p, grain))
            last_end = q
            if p - from_ > grain and (at - before + p) // grain != (at - before + last) // grain:
                marks.setdefault(p, 1)
            last = p
            if q - p > grain:
                for g in range(-(-(at - before + p + grain) // grain) * grain, at - before + q, grain):
                    k = g - at + before
                    while k < q and part[k] & 0xC0 == 0x80:
                        k += 1
                    if k < q:
                        marks.setdefault(k, 0)
        if e - last_end > grain:
            marks.update((g - at + before, 1) for g in range(-(-(at - before + last_end + 1) // grain) * grain, at - before + e, grain))
    return sorted((p, k) for p, k in marks.items() if p >= before)


def segments(part: bytes, before: int, at: int, size: int, words: int, limit: int) -> list[tuple[int, int, int, int]]:
    """(offset in the item, cost, words, strength) of the segments that begin in the range; a word that is cut counts once in the words."""
    marks = boundaries(part, before, at, size, grain_of(words, limit))
    out = []
    for (p, strength), q in zip(marks, [*(m[0] for m in marks[1:]), len(part)]):
        if p >= before + size:
            break
        n = len(part[p:q].decode("utf-8", "replace").split())
        out.append((at + p - before, max(-(-n * UNIT // words), -(-(q - p) * UNIT // limit)), n - (strength == 0), strength))
    return out


def measured(ranges: DataFrame, words: int = WORDS, limit: int = BYTES, size: int = RANGE) -> DataFrame:
    """item, id, length, at, segs (array of off, cost, strength), cost, words, own (the range's bytes); items of one range within both limits are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, segs, costs, counts, own = [], [], [], [], []
            for i, (part, before, at, length) in enumerate(zip(*(b.column(c).to_pylist() for c in ("part", "before", "at", "length")))):
                if length <= min(size, limit) and len(part.decode("utf-8", "replace").split()) <= words:
                    continue
                s = segments(part, before, at, size, words, limit)
                keep.append(i)
                segs.append([{"off": o, "cost": c, "strength": k} for o, c, _, k in s])
                costs.append(sum(x[1] for x in s))
                counts.append(sum(x[2] for x in s))
                own.append(part[before : before + size])
            t = b.take(pa.array(keep, pa.int32()))
            kind = pa.list_(pa.struct([("off", pa.int64()), ("cost", pa.int64()), ("strength", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*(t.column(c) for c in ("item", "id", "length", "at")), pa.array(segs, kind), pa.array(costs, pa.int64()), pa.array(counts, pa.int64()), pa.array(own, pa.binary())], ["item", "id", "length", "at", "segs", "cost", "words", "own"])

    return ranges.mapInArrow(run, "item string, id string, length bigint, at bigint, segs array<struct<off:bigint,cost:bigint,strength:int>>, cost bigint, words bigint, own binary")


def _per_range(rows: DataFrame, pick, ddl: str) -> DataFrame:
    """pick(row as a dict, places: (off, cost before it, strength) of its boundaries) yields tuples of the columns of ddl."""
    names = [x.split()[0] for x in ddl.split(", ")]
    types = [pa.string() if x.endswith("string") else pa.int64() if x.endswith("bigint") else pa.int32() for x in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for r in b.to_pylist():
                places, pos = [], r["base"]
                for s in r["segs"]:
                    places.append((s["off"], pos, s["strength"]))
                    pos += s["cost"]
                out += pick(r, places)
            cols = list(zip(*out)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return rows.mapInArrow(run, ddl)


def _measured_once(ranges: DataFrame, words: int, limit: int, size: int) -> DataFrame:
    # the ranges of a long item go to other tasks; items of one range stay where they are
    one, several = ranges.filter(F.col("length") <= size), ranges.filter(F.col("length") > size).repartition("item", "at")
    return measured(one, words, limit, size).unionByName(measured(several, words, limit, size)).dropDuplicates(["item", "at"])


def oversized(rows: DataFrame, words: int = WORDS, limit: int = BYTES) -> DataFrame:
    """item, id, length, total, words of the measured items that are over a limit."""
    totals = rows.groupBy("item").agg(F.min("id").alias("id"), F.max("length").alias("length"), F.sum("cost").alias("total"), F.sum("words").alias("words"))
    return totals.filter((F.col("words") > words) | (F.col("length") > limit))


def oversized_texts(items: DataFrame, id_col: str = "chunk_id", text_col: str = "text", words: int = WORDS, limit: int = BYTES, size: int = RANGE) -> DataFrame:
    """The ids of the items over a limit."""
    rows = _measured_once(ranges_of_texts(items, id_col, text_col, size), words, limit, size).drop("segs", "own")
    return oversized(rows, words, limit).select(F.col("id").alias(id_col)).distinct()


def pieces(ranges: DataFrame, words: int = WORDS, limit: int = BYTES, overlap: float = OVERLAP, size: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """(pieces, ranges): item, id, part_index (from 1), part_total, from_byte (with overlap), start_byte, end_byte of every oversized item."""
    scratch = Scratch(ranges.sparkSession, "split")
    rows = scratch.cut(_measured_once(ranges, words, limit, size), "ranges")
    before = Window.partitionBy("item").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.select("item", "at", F.coalesce(F.sum("cost").over(before), F.lit(0)).alias("base"))
    room, ov = UNIT * (1 - SLACK - overlap), int(UNIT * overlap)
    over = oversized(rows, words, limit).select("item", "id", "length", "total", F.ceil(F.col("total") / room).cast("long").alias("m"))
    here = rows.select("item", "at", "segs", "cost").join(base, ["item", "at"]).join(over.select("item", "total", "m"), "item")

    def cuts_in(r: dict, places: list) -> Iterator[tuple]:
        step, best = r["total"] / r["m"], {}
        for off, pos, strength in places:
            k = round(pos / step)
            if 1 <= k < r["m"] and abs(pos - k * step) <= UNIT * SLACK / 2:
                best[k] = max(best.get(k, (-1,)), (strength, -int(abs(pos - k * step)), -off, pos))
        at = [pos for _, pos, _ in places]
        for k, (s, d, o, pos) in best.items():
            lead = None
            if at[0] <= pos - ov or places[0][0] == 0:  # else the overlap begins in a range before
                fit = places[bisect_left(at, pos - ov) : bisect_left(at, pos)]
                lead = min((x for x, _, t in fit if t > 1), default=fit[0][0] if fit else -o)
            yield r["item"], k, s, d, -o, pos, lead

    found = _per_range(here, cuts_in, "item string, k bigint, strength int, near bigint, off bigint, pos bigint, lead bigint")
    best = F.max(F.struct("strength", "near", (-F.col("off")).alias("o"), "pos", "lead")).alias("c")
    cuts = scratch.cut(found.groupBy("item", "k").agg(best).select("item", "k", (-F.col("c.o")).alias("off"), "c.pos", F.col("c.lead").alias("near_lead")), "cuts")
    slot = lambda c: F.floor(c / UNIT)
    asked = cuts.filter("near_lead IS NULL").drop("near_lead").withColumn("slot", F.explode(F.sequence(slot(F.greatest(F.lit(0), F.col("pos") - ov)), slot(F.col("pos")))))
    given = here.withColumn("slot", F.explode(F.sequence(slot(F.col("base")), slot(F.col("base") + F.col("cost")))))

    def lead_in(r: dict, places: list) -> Iterator[tuple]:
        fit = [(off, strength) for off, pos, strength in places if r["pos"] - ov <= pos and off < r["cut"]]
        line = [off for off, strength in fit if strength > 1]
        return iter([(r["item"], r["k"], min(o for o, _ in fit), min(line) if line else None)] if fit else [])

    lead = _per_range(asked.withColumnRenamed("off", "cut").join(given.drop("cost", "total", "m"), ["item", "slot"]), lead_in, "item string, k bigint, any_off bigint, line_off bigint")
    lead = lead.groupBy("item", "k").agg(F.coalesce(F.min("line_off"), F.min("any_off")).alias("lead"))
    first = over.select("item", F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("start_byte"), F.lit(0).cast("long").alias("from_byte"))
    rest = cuts.join(lead, ["item", "k"], "left").select("item", "k", F.col("off").alias("start_byte"), F.coalesce("near_lead", "lead", "off").alias("from_byte"))
    order = Window.partitionBy("item").orderBy("k")
    every = first.unionByName(rest).join(over.select("item", "id", "length"), "item")
    out = every.select("item", "id", F.row_number().over(order).alias("part_index"), F.count("*").over(Window.partitionBy("item")).cast("int").alias("part_total"), "from_byte", "start_byte", F.coalesce(F.lead("start_byte").over(order), "length").alias("end_byte"))
    return out, rows


def texts_of(parts: DataFrame, rows: DataFrame, size: int = RANGE) -> DataFrame:
    """pieces with text and tokens_estimate (runs without whitespace); a piece is put together from the ranges that it touches."""
    near = parts.withColumn("at", F.explode(F.sequence(F.floor(F.col("from_byte") / size) * size, F.floor((F.col("end_byte") - 1) / size) * size, F.lit(size).cast("long"))))
    cut = near.join(rows.select("item", "at", "own"), ["item", "at"]).withColumn("skip", F.greatest(F.lit(0), F.col("from_byte") - F.col("at")).cast("int"))
    cut = cut.withColumn("bytes", F.substring("own", F.col("skip") + 1, (F.col("end_byte") - F.col("at") - F.col("skip")).cast("int")))
    keys = ["item", "id", "part_index", "part_total", "from_byte", "start_byte", "end_byte"]
    joined = cut.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "bytes"))).alias("all"))
    text = F.make_valid_utf8(F.aggregate("all", F.lit(b""), lambda acc, x: F.concat(acc, x.bytes)).cast("string"))
    words = F.size(F.filter(F.split(F.col("text"), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != ""))
    return joined.select(*keys, text.alias("text")).withColumn("tokens_estimate", words)


def split_texts(items: DataFrame, id_col: str = "chunk_id", text_col: str = "text", words: int = WORDS, limit: int = BYTES, overlap: float = OVERLAP, size: int = RANGE, with_text: bool = True) -> DataFrame:
    """The parts of every item over a limit: id, part_index, part_total, from_byte, start_byte, end_byte and, with_text, text and tokens_estimate."""
    parts, rows = pieces(ranges_of_texts(items, id_col, text_col, size), words, limit, overlap, size)
    return (texts_of(parts, rows, size) if with_text else parts).drop("item").withColumnRenamed("id", id_col)


def split_files(spark: SparkSession, paths: list[str], words: int = WORDS, limit: int = BYTES, overlap: float = OVERLAP, size: int = RANGE) -> DataFrame:
    """The same for files that all executors reach, each read by ranges."""
    return texts_of(*pieces(ranges_of_files(spark, paths, size), words, limit, overlap, size), size).drop("item").withColumnRenamed("id", "path")
