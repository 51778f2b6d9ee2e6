"""Mixing sources to target weights with soft membership.

1. The texts are read once: tokens, a digest and the counts of hashed words of every document are written. Equal texts are one text from here on.
2. A classifier learns the sources from the labelled table: naive Bayes over the hashed words of all labelled documents. Its counts are sums,
   one row per source and bucket, so neither its fit nor its size depends on how the documents are spread.
3. Every text is a soft member of all sources: by the classifier's posteriors (tempered by the number of its words), of which a known source
   takes TRUST and the posteriors the rest; a text without a source has the posteriors alone.
4. Every text has its own nonnegative rate, at most the max_repeats of its source (1 without a source). Projected gradient descent fits the rates so
   that the expected tokens of every source meet its target in the least-squares sense. A step is one vector with a number per source; a round is one distributed
   pass that sums the expected tokens by source, and rates follow from the steps so far, so nothing is kept per text.
5. Rates become whole repeats. A text without a source is drawn by its rate. Of a source's texts the j-th repeat joins at (j - u) / rate, u being the text's hash in
   0..1; the repeats that join first are taken until the source has its tokens. The cut is read from token sums by bin, refined within the bin that is cut, and the
   gap that is left is filled from a bounded list of texts of all sizes.

Total size: by default as many tokens as all texts have. A source has attained its part if it has weight x total tokens; one whose texts don't suffice comes
out at its cap, all its texts repeated max_repeats times, and the report says what is missing. Asked for are also "labelled" (tokens of labelled
texts), "reachable" (the largest total at which every source that has texts attains its part; the scarcest source bounds it) or a number. A source without
texts contributes nothing.

Defined cases: null ids or texts are left out; an empty text has no tokens and no repeats. Equal texts are one text, whatever their ids: caps,
tokens and most_repeats are per text, and its repeats are handed to its ids in turn. Of a text with several sources that with the smallest cap counts (of
equal caps, the smallest name), and it has none without a source beside it. The classifier learns from all rows.
Targets with a null source, or a null or non-positive weight, are left out, repeated ones counted once with the smallest cap; a null cap is 1. Empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.token_counts import VOCABULARY, count
from tessera.runtime import Scratch

BUCKETS, BINS, TEMPER, PRIOR_WORDS = 4096, 4096, 32, 2000
#: Share of a known source in a text's membership; rounds at most, and the relative error at which they end; the least rate by which a text may join.
TRUST, ROUNDS, ENOUGH, LEAST = 0.9, 25, 2e-3, 1e-3
#: A round that lowers the squared error by less than this part is the last; what is added to the products so that sources without members stay apart.
GAIN, RIDGE = 0.02, 1e-4
#: Texts per source and power of two of tokens that the last gap may be filled from.
SPARE = 4
_WORD = re.compile(r"\w+")
REPORT = (
    "source string, weight double, max_repeats int, reachable_weight double, available_texts long, available_tokens long, asked_tokens long, labelled_tokens long, soft_tokens double, "
    "shortfall_tokens long, share double, expected_share double, repeated_texts long, most_repeats int"
)


def _features(text: str, seen: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    b = np.fromiter((seen[w] if w in seen else seen.setdefault(w, xxhash.xxh3_64_intdigest(w) % BUCKETS) for w in _WORD.findall(text.lower())), np.int64)
    return np.unique(b, return_counts=True)


def _packed(k: np.ndarray, n: np.ndarray) -> bytes:
    return np.stack([k, n], 1).astype("<u4").tobytes() if len(k) else b""


def _unpacked(col: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of the packed features of a batch."""
    kn = np.frombuffer(b"".join(col), "<u4").reshape(-1, 2)
    return np.repeat(np.arange(len(col)), [len(f) // 8 for f in col]), kn[:, 0].astype(np.int64), kn[:, 1].astype(np.int64)


def read(docs: DataFrame, sources: list[str], id_col: str, text_col: str, source_col: str, vocabulary: str) -> DataFrame:
    """doc_id, source (null if it has no target), tokens, u (hash of the id in 0..BINS*BINS-1), text_key, words (packed features)."""
    known = set(sources)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for b in batches:
            texts, labels = b.column("text").to_pylist(), b.column("source").to_pylist()
            if len(seen) > 500_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([s if s in known else None for s in labels], pa.string()), pa.array([count(t, vocabulary) for t in texts], pa.int64()), b.column("u"),
                 pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary()), pa.array([_packed(*_features(t, seen)) for t in texts], pa.binary())],
                ["doc_id", "source", "tokens", "u", "text_key", "words"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    rows = rows.withColumn("u", F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(BINS * BINS)))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, source string, tokens bigint, u bigint, text_key binary, words binary")


def learn_words(rows: DataFrame, sources: list[str]) -> np.ndarray:
    """Log probabilities (sources x buckets + 1) from source and words; the last column is the source's prior. All labelled rows count."""
    where, wide = {s: i for i, s in enumerate(sources)}, BUCKETS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sources) * wide, np.int64)
        for b in batches:
            at = np.array([where[s] for s in b.column("source").to_pylist()], np.int64)
            row, k, n = _unpacked(b.column("words").to_pylist())
            total += np.bincount(at[row] * wide + k, n, len(total)).astype(np.int64)
            total += np.bincount(at * wide + BUCKETS, minlength=len(total))
        i = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(total[i])], ["i", "n"])

    counts = np.zeros((len(sources), wide))
    for r in rows.select("source", "words").filter(F.col("source").isin(sources)).mapInArrow(run, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).toLocalIterator():  # at most one row per source and bucket
        counts[divmod(r.i, wide)] = r.n
    # a small source borrows from the whole table, else rare words would speak for it
    whole = counts[:, :BUCKETS].sum(0) + 0.01
    words, docs_of = counts[:, :BUCKETS] + PRIOR_WORDS * whole / whole.sum(), counts[:, BUCKETS:] + 0.5
    return np.hstack([np.log(words / words.sum(1, keepdims=True)), np.log(docs_of / docs_of.sum())])


def learn(docs: DataFrame, sources: list[str], text_col: str = "text", source_col: str = "source") -> np.ndarray:
    """The classifier of a table of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([_packed(*_features(t, seen)) for t in b.column(0).to_pylist()], pa.binary())], ["source", "words"])

    rows = docs.select(F.col(text_col).alias("text"), F.col(source_col).alias("source")).filter("text IS NOT NULL AND source IS NOT NULL")
    return learn_words(rows.mapInArrow(run, "source string, words binary"), sources)


def posteriors(model: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Soft membership by words (rows x sources); long texts would all be certain, so their evidence counts as that of TEMPER words."""
    out = np.empty((len(words), len(model)))
    for i, w in enumerate(words):
        kn = np.frombuffer(w, "<u4").reshape(-1, 2)
        n = kn[:, 1].astype(float)
        out[i] = (model[:, kn[:, 0]] @ n) * min(1.0, TEMPER / max(1.0, n.sum()))
    out += model[:, BUCKETS]
    out = np.exp(out - out.max(1, keepdims=True))
    return out / out.sum(1, keepdims=True)


def posterior(model: np.ndarray, text: str, seen: dict[str, int]) -> np.ndarray:
    return posteriors(model, [_packed(*_features(text, seen))])[0]


def distinct_texts(rows: DataFrame, sources: list[str], caps: np.ndarray) -> DataFrame:
    """One row per text: label (position of its source, -1 without one), doc_id and u of its smallest id there, tokens, text_key, words."""
    plan = rows.sparkSession.createDataFrame([(s, i, int(c)) for i, (s, c) in enumerate(zip(sources, caps))], "source string, label int, cap int")
    most = F.lit((1 << 31) - 1)
    one = F.min(F.struct(F.coalesce("cap", most).alias("cap"), "source", "doc_id", "u", "tokens", F.coalesce("label", F.lit(-1)).alias("label"), "words"))
    best = rows.join(F.broadcast(plan), "source", "left").groupBy("text_key").agg(one.alias("b"))
    return best.select("b.doc_id", "b.label", "b.tokens", "b.u", "text_key", "b.words")


def with_membership(texts: DataFrame, model: np.ndarray, trust: float = TRUST) -> DataFrame:
    """label, tokens, u, doc_id, text_key and soft, the membership in all sources as packed floats."""
    shared, cols = texts.sparkSession.sparkContext.broadcast(model), ["doc_id", "label", "tokens", "u", "text_key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = posteriors(shared.value, b.column("words").to_pylist())
            label = b.column("label").to_numpy()
            own = np.flatnonzero(label >= 0)
            m[own] *= 1 - trust
            m[own, label[own]] += trust
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), pa.array([x.tobytes() for x in m.astype(np.float32)], pa.binary())], [*cols, "soft"])

    return texts.mapInArrow(run, f"doc_id {dict(texts.dtypes)['doc_id']}, label int, tokens bigint, u bigint, text_key binary, soft binary")


class Rates:
    """The rates of texts after the steps of the descent."""

    def __init__(self, start: np.ndarray, caps: np.ndarray):
        self.start, self.caps, self.steps = start, np.append(caps, 1.0), np.zeros((0, len(start)))  # the last cap is that of label -1

    def of(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(rates, memberships) of a batch with label and soft."""
        k = len(self.start)
        soft = np.frombuffer(b"".join(b.column("soft").to_pylist()), np.float32).reshape(b.num_rows, k).astype(np.float64)
        label = b.column("label").to_numpy()
        cap = self.caps[label]
        r = np.minimum(np.where(label >= 0, self.start[label], soft @ np.minimum(self.start, 1.0)), cap)
        for g in self.steps:
            r = np.clip(r - soft @ g, 0, cap)
        return r, soft


def _sums(texts: DataFrame, make, n: int) -> np.ndarray:
    """Sums over all texts of the vectors of length n that `make` returns for a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n)
        for b in batches:
            if b.num_rows:
                total += make(b)
        i = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(total[i])], ["i", "t"])

    out = np.zeros(n)
    for r in texts.mapInArrow(run, "i bigint, t double").groupBy("i").agg(F.sum("t").alias("t")).toLocalIterator():  # at most n rows
        out[r.i] = r.t
    return out


def fit(texts: DataFrame, target: np.ndarray, start: np.ndarray, caps: np.ndarray, rounds: int = ROUNDS) -> tuple[Rates, np.ndarray]:
    """(rates, expected tokens by source): projected gradient descent on the squared errors of the expected tokens of every source.

    Errors are weighed by the inverse of the memberships' token-weighted products, as in generalised least squares, and rates by their tokens. The largest curvature is then
    1, so a step of 1 can't overshoot, and only caps and zero need more than one.
    """
    k, rates, rows = len(target), Rates(start, caps), texts.select("label", "tokens", "soft")

    def curve(b: pa.RecordBatch) -> np.ndarray:
        _, m = rates.of(b)
        return ((m * b.column("tokens").to_numpy()[:, None]).T @ m).ravel()

    gram = _sums(rows, curve, k * k).reshape(k, k)
    weigh = np.linalg.inv(gram + np.diag(np.full(k, RIDGE * max(1.0, np.trace(gram) / k))))
    before = np.inf
    for i in range(rounds + 1):

        def expected(b: pa.RecordBatch) -> np.ndarray:
            r, m = rates.of(b)
            return (r * b.column("tokens").to_numpy()) @ m

        got = _sums(rows, expected, k)
        error = got - target
        loss = float(error @ weigh @ error)
        if i == rounds or loss > (1 - GAIN) * before or np.abs(error).max(initial=0) <= ENOUGH * max(1.0, target.sum()) / k:
            return rates, got
        rates.steps, before = np.vstack([rates.steps, weigh @ error]), loss


def _join_at(rates: Rates, b: pa.RecordBatch, most: int) -> np.ndarray:
    """Where each repeat of the labelled texts of a batch joins (rows x most), in 0..1; later ones than the text's cap never do (2)."""
    r, _ = rates.of(b)
    u = b.column("u").to_numpy() / (BINS * BINS)
    j = np.arange(1, most + 1)
    at = (j - u[:, None]) / np.maximum(r, LEAST)[:, None]
    return np.where(j <= rates.caps[b.column("label").to_numpy()][:, None], at / (1 + at), 2.0)


def _cuts(labelled: DataFrame, rates: Rates, quota: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(cut, gap) by source: repeats that join before the cut are taken, gap tokens of the quota are then open."""
    k = len(quota)
    low, gap, width = np.zeros(k), quota.astype(float).copy(), 1.0
    for _ in range(2):
        start, w = low.copy(), width

        def histogram(b: pa.RecordBatch) -> np.ndarray:
            at, label = _join_at(rates, b, most), b.column("label").to_numpy()
            pos = np.floor((at - start[label][:, None]) / w * BINS)
            row, col = np.nonzero((pos >= 0) & (pos < BINS))
            return np.bincount(label[row] * BINS + pos[row, col].astype(np.int64), b.column("tokens").to_numpy()[row], k * BINS)

        sums = _sums(labelled, histogram, k * BINS).reshape(k, BINS)
        reached = sums.cumsum(1)
        fit_ = (reached <= gap[:, None] + 1e-6).sum(1)  # bins that are taken whole
        gap -= np.where(fit_ > 0, np.take_along_axis(reached, np.maximum(fit_ - 1, 0)[:, None], 1)[:, 0], 0.0)
        low, width = start + fit_ * w / BINS, w / BINS
    return low, gap


def _fill(spare: list[tuple[int, object]], gap: float) -> list[object]:
    """Ids of texts (tokens, id) that fill a gap: largest first while they fit, then the one that comes nearest."""
    out, rest = [], sorted(spare, key=lambda x: (-x[0], str(x[1])))
    for t, d in list(rest):
        if t <= gap:
            out.append(d)
            rest.remove((t, d))
            gap -= t
    near = min(rest, key=lambda x: abs(x[0] - gap), default=None)
    return [*out, near[1]] if near and abs(near[0] - gap) < gap else out


def _hand_out(chosen: DataFrame, rows: DataFrame, sources: list[str], most: int) -> DataFrame:
    """doc_id, source, tokens, repeats: the repeats of each text, given to its ids in turn; no text has more than `most`, so its first ids suffice."""
    plan = rows.sparkSession.createDataFrame([*enumerate(sources)], "label int, of string")
    t = chosen.select("text_key", "label", "tokens", "repeats").join(F.broadcast(plan), "label", "left").drop("label")
    order = Window.partitionBy("text_key", "source").orderBy("doc_id")
    ids = rows.select("text_key", "source", "doc_id").withColumn("i", F.row_number().over(order)).filter(F.col("i") <= most)
    both = t.join(ids, "text_key").filter(F.col("of").eqNullSafe(F.col("source"))).withColumn("copies", F.count("*").over(Window.partitionBy("text_key")))
    mine = (F.floor(F.col("repeats") / F.col("copies")) + (F.col("i") <= F.col("repeats") % F.col("copies")).cast("int")).cast("int")
    return both.select("doc_id", "source", "tokens", mine.alias("repeats")).filter("repeats > 0")


def mixture(docs: DataFrame, targets: DataFrame, total_tokens: int | str | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(chosen, report). chosen: doc_id, source, tokens, repeats (at least 1). report: one row per source.

    report: source, weight, max_repeats, reachable_weight (relative to the sources that have texts), available_texts and available_tokens (each text once), asked_tokens
    (weight x total), labelled_tokens, soft_tokens (expected from texts without a source), shortfall_tokens (asked for, but not there even with all repeats), share (of all
    tokens of the mixture), expected_share (by the memberships of all texts), repeated_texts (taken more than once), most_repeats.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "mixing")
    plan = targets.filter("source IS NOT NULL AND weight > 0").groupBy("source").agg(F.max("weight").alias("w"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("cap")).orderBy("source").collect()  # one row per source
    sources, k, kind = [r.source for r in plan], len(plan), dict(docs.dtypes)[id_col]
    if not k:
        return spark.createDataFrame([], f"doc_id {kind}, source string, tokens bigint, repeats int"), spark.createDataFrame([], REPORT)
    weight, caps = np.array([r.w for r in plan], float), np.array([max(0, r.cap) for r in plan], float)
    weight, most = weight / weight.sum(), max(1, int(caps.max()))
    rows = scratch.cut(read(docs, sources, id_col, text_col, source_col, vocabulary), "rows")
    model = learn_words(rows, sources)
    texts = scratch.cut(with_membership(distinct_texts(rows, sources, caps), model), "texts")
    have = {r.label: r for r in texts.groupBy("label").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()}  # one row per source
    tokens, number = np.array([have[i].t if i in have else 0 for i in range(k)], float), [have[i].n if i in have else 0 for i in range(k)]
    full = tokens > 0
    if total_tokens is None:
        total = float(sum(r.t for r in have.values()))
    elif total_tokens == "labelled":
        total = tokens.sum()
    elif total_tokens == "reachable":
        total = float((caps * tokens / weight)[full].min()) * weight[full].sum() if full.any() else 0.0
    else:
        total = float(total_tokens)
    # with "reachable" the weights of the sources that have texts are relative to each other
    asked = weight * total / (weight[full].sum() if total_tokens == "reachable" and full.any() else 1.0)
    loose = _sums(texts.filter("label < 0").select("tokens", "soft"), lambda b: b.column("tokens").to_numpy() @ np.frombuffer(b"".join(b.column("soft").to_pylist()), np.float32).reshape(b.num_rows, k).astype(float), k)
    target = np.minimum(asked, caps * tokens + loose)
    start = np.minimum(np.divide(target, tokens, out=np.zeros(k), where=full), caps)
    rates, expected = fit(texts, target, start, caps)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r, m = rates.of(b)
            r[(m * b.column("tokens").to_numpy()[:, None] > asked).any(1)] = 0  # alone more than a source may have
            n = np.floor(r) + (b.column("u").to_numpy() < (r - np.floor(r)) * BINS * BINS)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), pa.array(n.astype(np.int32))], [*cols, "repeats"])

    cols = ["doc_id", "label", "tokens", "text_key", "soft"]
    shape = f"doc_id {kind}, label int, tokens bigint, text_key binary, soft binary, repeats int"
    drawn = scratch.cut(texts.filter("label < 0 AND tokens > 0").mapInArrow(draw, shape).filter("repeats > 0"), "drawn")
    weigh = lambda b: (b.column("tokens").to_numpy() * b.column("repeats").to_numpy()) @ np.frombuffer(b"".join(b.column("soft").to_pylist()), np.float32).reshape(b.num_rows, k).astype(float)
    soft = _sums(drawn.select("tokens", "repeats", "soft"), weigh, k)
    # what the draw left open is the labelled texts' part
    labelled = texts.filter("label >= 0 AND tokens > 0")
    cut, gap = _cuts(labelled.select("label", "tokens", "u", "soft"), rates, np.clip(asked - soft, 0, caps * tokens), most)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = (_join_at(rates, b, most) < cut[b.column("label").to_numpy()][:, None]).sum(1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), pa.array(n.astype(np.int32))], [*cols, "repeats"])

    taken = scratch.cut(labelled.mapInArrow(take, shape), "taken")
    limits = spark.createDataFrame([(i, int(c)) for i, c in enumerate(caps)], "label int, cap int")
    sizes = Window.partitionBy("label", F.floor(F.log2("tokens"))).orderBy("doc_id")
    spare: dict[int, list[tuple[int, object]]] = {}
    for r in taken.join(F.broadcast(limits), "label").filter("repeats < cap").withColumn("i", F.row_number().over(sizes)).filter(F.col("i") <= SPARE).select("label", "tokens", "doc_id").toLocalIterator():  # at most SPARE rows per source and power of two
        spare.setdefault(r.label, []).append((r.tokens, r.doc_id))
    more = [(i, d, 1) for i in range(k) if gap[i] > 0 for d in _fill(spare.get(i, []), gap[i])]
    extra = spark.createDataFrame(more, f"label int, doc_id {kind}, one int")
    filled = taken.join(F.broadcast(extra), ["label", "doc_id"], "left").withColumn("repeats", F.col("repeats") + F.coalesce("one", F.lit(0))).drop("one").filter("repeats > 0")
    chosen = scratch.cut(filled.select(drawn.columns).unionByName(drawn), "chosen")
    mass = _sums(chosen.select("tokens", "repeats", "soft"), weigh, k)
    got = {r.label: r for r in chosen.filter("label >= 0").groupBy("label").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("t"), F.max("repeats").alias("most"), F.count_if(F.col("repeats") > 1).alias("again")).collect()}  # one row per source
    reached = np.array([got[i].t if i in got else 0 for i in range(k)], float) + soft
    out = []
    for i, r in enumerate(plan):
        g = got.get(i)
        out.append((
            r.source, r.w, r.cap, round(float(weight[i] / weight[full].sum()), 6) if full[i] else 0.0, number[i], int(tokens[i]), round(asked[i]), g.t if g else 0, round(float(soft[i]), 3), round(max(0.0, asked[i] - max(reached[i], caps[i] * tokens[i]))),
            round(float(reached[i] / max(1.0, reached.sum())), 6), round(float(mass[i] / max(1.0, mass.sum())), 6), g.again if g else 0, g.most if g else 0))
    return _hand_out(chosen, rows, sources, most), spark.createDataFrame(out, REPORT)
