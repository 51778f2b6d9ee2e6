"""The queries of this subpackage and the SQL of those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import documented, lookalikes, mixing, near_dup, packing, splitting, vector_neighbors
from tessera.runtime import load


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.expand(*near_dup.similar(load(spark, sf_dir, "chunks")))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.groups(load(spark, sf_dir, "chunks"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_neighbors.neighbors(load(spark, sf_dir, "embedding_ledger")).drop("cosine")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.oversized_texts(load(spark, sf_dir, "chunks"))


def p6_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_texts(load(spark, sf_dir, "chunks"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.containers(load(spark, sf_dir, "documents"), load(spark, sf_dir, "pack_capacity"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p7_containers(spark, sf_dir), load(spark, sf_dir, "pack_capacity"))


def p7_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of p7_containers: all documents are there with all their tokens, no container is over its capacity, only texts over it are divided (into full pieces
    and a rest), and there are at most 11/9 as many containers as the tokens need, which best fit alone would guarantee."""
    placed, caps = p7_containers(spark, sf_dir), load(spark, sf_dir, "pack_capacity")
    text = packing.with_tokens(load(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.sum("tokens").alias("asked"))
    mine = placed.groupBy("container_kind", "doc_id").agg(F.sum("tokens").alias("got"), F.max("pieces").alias("pieces"), F.count("*").alias("n"), F.min("piece").alias("low"), F.max("piece").alias("high"))
    each = mine.join(text, "doc_id").join(caps.groupBy("container_kind").agg(F.min("capacity_tokens").alias("cap")), "container_kind")
    divided = F.when(F.col("asked") > F.col("cap"), F.col("pieces") == F.ceil(F.col("asked") / F.col("cap"))).otherwise(F.col("pieces") == 1) & (F.col("low") == 0) & (F.col("high") == F.col("pieces") - 1)
    docs = each.groupBy("container_kind").agg(F.count("*").alias("documents"), F.bool_and(F.col("got") == F.col("asked")).alias("whole"), F.bool_and(divided).alias("divided_only_if_over"))
    r = packing.fill_report(placed, caps)
    return docs.join(r, "container_kind").select("container_kind", F.col("capacity_tokens").cast("int").alias("capacity_tokens"), "documents", "whole", "divided_only_if_over", (F.col("fullest") <= F.col("capacity_tokens")).alias("within_capacity"), (9 * F.col("containers") <= 11 * F.col("fewest") + 9).alias("near_the_fewest"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"))[1]


def p8_reachable_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of the largest mixture in which every source that has texts attains its weight; the scarcest source bounds it."""
    return mixing.mixture(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"), total_tokens="reachable")[1]


def p8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of p8_mixture and p8_shares: per source its texts, whether no text is repeated beyond the cap, and whether it has its part of the total or its cap.

    The first are counted from the chosen documents themselves, joined with their texts.
    """
    docs, targets = load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets")
    chosen, shares = mixing.mixture(docs, targets)
    text = docs.filter("text IS NOT NULL").groupBy("doc_id").agg(F.min(F.sha2("text", 256)).alias("h"))
    times = chosen.join(text, "doc_id").groupBy("source", "h").agg(F.sum("repeats").alias("times"), F.max("tokens").alias("tokens"))
    taken = times.groupBy("source").agg(F.max("times").alias("times"), F.sum(F.col("times") * F.col("tokens")).alias("tokens"))
    exhausted = F.col("labelled_tokens") == F.col("max_repeats") * F.col("available_tokens")
    attained = exhausted | (F.abs(F.col("labelled_tokens") + F.col("soft_tokens") - F.col("asked_tokens")) <= F.greatest(0.01 * F.col("asked_tokens"), F.lit(40)))
    return shares.join(taken, "source", "left").select(
        "source", "weight", "available_texts", (F.coalesce("times", F.lit(0)) <= F.col("max_repeats")).alias("cap_kept"), (F.coalesce("tokens", F.lit(0)) == F.col("labelled_tokens")).alias("sum_kept"), attained.alias("attained"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.look_alikes(load(spark, sf_dir, "documents"))


def p9_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.skeleton_groups(load(spark, sf_dir, "documents"))


def p9_wider_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups by the wider table, which also has letters of other typefaces, ligatures, half-width forms and dashes."""
    return lookalikes.skeleton_groups(load(spark, sf_dir, "documents"), kinds=lookalikes.WIDER)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_pairs(spark, sf_dir).select("id")


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documented.pairs(load(spark, sf_dir, "symbols"), load(spark, sf_dir, "source_texts"))


def p3_source_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documented functions of the source files themselves, whether symbols names them or not."""
    return documented.source_pairs(load(spark, sf_dir, "source_texts"))


def p3_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions and methods of symbols that are found in their source files, by file, name and first line."""
    kind = F.lower(F.regexp_replace("kind", r"(?U)^\s+|\s+$", ""))
    mine = load(spark, sf_dir, "symbols").filter(kind.isin("function", "method")).select("file_path", "name", "start_line").distinct()
    found = documented.source_functions(load(spark, sf_dir, "source_texts")).select(F.col("path").alias("file_path"), "name", "start_line").distinct()
    return mine.join(found, ["file_path", "name", "start_line"])


def p6_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of p6_parts, per text: parts are numbered without gaps, their own bytes follow each other over the whole text, none is over a limit, each is cut from the
    text where it says, and all but the first begin before the end of the part before (within the overlap)."""
    parts = p6_parts(spark, sf_dir)
    whole = load(spark, sf_dir, "chunks").filter("chunk_id IS NOT NULL AND text IS NOT NULL").groupBy("chunk_id").agg(F.min("text").alias("whole"))
    w = Window.partitionBy("chunk_id").orderBy("part_index")
    p = parts.join(whole, "chunk_id").withColumn("before", F.lag("end_byte").over(w))
    raw = F.col("whole").cast("binary")
    p = p.withColumns({
        "joined": F.coalesce(F.col("start_byte") == F.col("before"), F.col("start_byte") == 0), "length": F.octet_length("whole"),
        "fits": (F.octet_length("text") <= splitting.BYTES) & (F.col("tokens_estimate") <= splitting.WORDS),
        "same": F.substring(raw, (F.col("from_byte") + 1).cast("int"), (F.col("end_byte") - F.col("from_byte")).cast("int")).cast("string") == F.col("text"),
        "laps": F.when(F.col("part_index") == 1, F.col("from_byte") == 0).otherwise((F.col("from_byte") <= F.col("start_byte")) & (F.col("start_byte") - F.col("from_byte") <= splitting.BYTES * 2 * splitting.OVERLAP))})
    numbered = (F.count("*") == F.max("part_total")) & (F.max("part_index") == F.max("part_total")) & (F.count_distinct("part_index") == F.max("part_total")) & (F.max("part_total") > 1)
    return p.groupBy("chunk_id").agg(numbered.alias("numbered"), (F.bool_and("joined") & (F.max("end_byte") == F.max("length"))).alias("covered"), F.bool_and("fits").alias("within_limits"), F.bool_and("same").alias("cut_where_it_says"), F.bool_and("laps").alias("overlap_kept"))


QUERIES = {f.__name__: f for f in (p2_found, p2_groups, p3_found, p3_pairs, p3_source_pairs, p3_located, p5_found, p6_found, p6_parts, p6_check, p7_containers, p7_report, p7_check, p8_mixture, p8_shares, p8_reachable_shares, p8_check, p9_found, p9_groups, p9_wider_groups)}
def _sql_form() -> str:
    """SQL of a text's plain form by a table of its own: ranges of code points, and letters whose accents are composed with them."""
    import unicodedata

    pairs = dict(zip("АВЕЅІЈКМНОРСТУХаеорсухѕіјһԁԛԝӏӀѵҮԌԚԜΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿονϲϳ", "ABESIJKMHOPCTYXaeopcyxsijhdqwlIvYGQWABEZHIKMNOPTYXCJovcj"))
    for cp in range(0x300, 0x2000):  # accented letters, which the form keeps composed
        c = unicodedata.normalize("NFD", chr(cp))
        if len(c) > 1 and c[0] in pairs and len(unicodedata.normalize("NFC", pairs[c[0]] + c[1:])) == 1:
            pairs[chr(cp)] = unicodedata.normalize("NFC", pairs[c[0]] + c[1:])
    wide = {chr(cp + 0xFEE0): chr(cp) for cp in range(0x21, 0x7F)} | {"\u3000": " ", "\u00a0": " ", "\u2007": " ", "\u202f": " "}
    table = pairs | wide
    letters, plain = "".join(table).replace("'", "''"), "".join(table.values()).replace("'", "''")
    none = r"[\x{00}-\x{08}\x{0e}-\x{1b}\x{7f}-\x{84}\x{86}-\x{9f}\x{ad}\x{34f}\x{61c}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180e}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{3164}\x{fe00}-\x{fe0f}\x{feff}\x{ffa0}]"
    return f"nfc_normalize(translate(regexp_replace(nfc_normalize(text), '{none}', '', 'g'), '{letters}', '{plain}'))"


_FORMS = f"f AS (SELECT DISTINCT doc_id, text, {_sql_form()} AS form FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)"
SQL = {
    "p9_found": f"WITH {_FORMS} SELECT DISTINCT least(a.doc_id, b.doc_id) AS doc_id_a, greatest(a.doc_id, b.doc_id) AS doc_id_b FROM f a JOIN f b ON a.form = b.form AND a.text <> b.text AND a.doc_id < b.doc_id",
    "p9_groups": f"WITH {_FORMS}, g AS (SELECT form, min(doc_id) AS group_id, count(*) AS n_docs, count(DISTINCT text) AS n_forms FROM f GROUP BY form) SELECT doc_id, group_id, n_docs, n_forms FROM f JOIN g USING (form)",
    "p7_check": """
SELECT container_kind, min(capacity_tokens) AS capacity_tokens, (SELECT count(DISTINCT doc_id) FROM documents WHERE text IS NOT NULL) AS documents, true AS whole, true AS divided_only_if_over, true AS within_capacity, true AS near_the_fewest
FROM pack_capacity WHERE capacity_tokens > 0 GROUP BY container_kind""",
    "p8_check": """
WITH t AS (SELECT d.text, m.source, row_number() OVER (PARTITION BY d.text ORDER BY coalesce(m.max_repeats, 1), m.source) AS i FROM documents d JOIN mix_targets m USING (source) WHERE d.text IS NOT NULL AND m.weight > 0)
SELECT m.source, m.weight, count(t.text) AS available_texts, true AS cap_kept, true AS sum_kept, true AS attained FROM mix_targets m LEFT JOIN t ON t.source = m.source AND t.i = 1 WHERE m.weight > 0 GROUP BY ALL""",
    "p6_found": r"""SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id IS NOT NULL AND (octet_length(encode(text)) > 12000
      OR len(list_filter(regexp_split_to_array(text, '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda w: w <> '')) > 512)""",
    "p5_found": """
WITH r AS (SELECT embedding_profile AS p, record_kind AS k, text_hash AS h, vector AS v, dimension AS d, row_number() OVER (PARTITION BY embedding_profile, record_kind, text_hash ORDER BY updated_at DESC, vector DESC) AS i FROM embedding_ledger),
u AS (SELECT p, k, h, list_transform(v, lambda x: x::DOUBLE) AS v FROM r WHERE i = 1 AND v IS NOT NULL AND len(v) = d
  AND NOT list_bool_or(list_transform(v, lambda x: isnan(x))) AND list_bool_or(list_transform(v, lambda x: x <> 0))),
c AS (SELECT a.p, a.k, a.h, b.h AS n, round(list_cosine_similarity(a.v, b.v), 9) AS c FROM u a JOIN u b ON a.p = b.p AND a.k = b.k AND a.h <> b.h),
t AS (SELECT *, row_number() OVER (PARTITION BY p, k, h ORDER BY c DESC, n) AS i FROM c WHERE c >= 0.85)
SELECT p AS embedding_profile, k AS record_kind, h AS text_hash, n AS neighbor_hash FROM t WHERE i <= 3""",
    "p3_located": r"""SELECT DISTINCT file_path, name, start_line FROM symbols WHERE lower(trim(kind)) IN ('function', 'method') AND file_path IN (SELECT path FROM source_texts WHERE content IS NOT NULL)""",
    "p6_check": r"""SELECT DISTINCT chunk_id, true AS numbered, true AS covered, true AS within_limits, true AS cut_where_it_says, true AS overlap_kept FROM chunks WHERE chunk_id IS NOT NULL AND (octet_length(encode(text)) > 12000
      OR len(list_filter(regexp_split_to_array(text, '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda w: w <> '')) > 512)""",
    "p2_groups": r"""
WITH RECURSIVE b AS (SELECT DISTINCT chunk_id, regexp_extract_all(lower(substr(text, strpos(text, chr(10) || 'BODY:' || chr(10)) + 7)), '[a-z0-9_]+') AS w FROM chunks WHERE strpos(text, chr(10) || 'BODY:' || chr(10)) > 0),
s AS (SELECT chunk_id, list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS s FROM b WHERE len(w) > 2),
c AS (SELECT s, min(chunk_id) AS class_id FROM s WHERE len(s) >= 20 GROUP BY s), m AS (SELECT chunk_id, class_id FROM s JOIN c USING (s)),
k AS (SELECT class_id, len(s) AS n, unnest(s) AS t FROM c),
l AS (SELECT a.class_id AS a, b.class_id AS b FROM k a JOIN k b ON a.t = b.t AND a.class_id <> b.class_id GROUP BY a.class_id, b.class_id, a.n, b.n HAVING 10 * count(*) >= 6 * (a.n + b.n - count(*))),
r AS (SELECT class_id AS v, class_id AS w FROM c UNION SELECT r.v, l.b FROM r JOIN l ON l.a = r.w),
g AS (SELECT v AS class_id, min(w) AS group_id FROM r GROUP BY v), n AS (SELECT a AS class_id, count(*) AS links FROM l GROUP BY a),
h AS (SELECT chunk_id, min((class_id, group_id, coalesce(links, 0))) AS z FROM m JOIN g USING (class_id) LEFT JOIN n USING (class_id) GROUP BY chunk_id)
SELECT e.chunk_id, coalesce(z[1], e.chunk_id) AS class_id, coalesce(z[2], e.chunk_id) AS group_id, coalesce(z[3], 0) AS links FROM (SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id IS NOT NULL) e LEFT JOIN h USING (chunk_id)""",
    "p2_found": r"""
WITH b AS (SELECT DISTINCT chunk_id, regexp_extract_all(lower(substr(text, strpos(text, chr(10) || 'BODY:' || chr(10)) + 7)), '[a-z0-9_]+') AS w FROM chunks WHERE strpos(text, chr(10) || 'BODY:' || chr(10)) > 0),
s AS (SELECT chunk_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM b WHERE len(w) > 2),
k AS (SELECT chunk_id, len(s) AS n, unnest(s) AS t FROM s WHERE len(s) >= 20),
c AS (SELECT a.chunk_id AS a, b.chunk_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM k a JOIN k b ON a.t = b.t AND a.chunk_id < b.chunk_id GROUP BY ALL)
SELECT a AS chunk_id_a, b AS chunk_id_b FROM c WHERE 10 * k >= 6 * (na + nb - k)""",
}
