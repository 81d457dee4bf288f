"""The queries of the thirteen operators and of the corpus pipeline, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.llm import ann, decontamination, fingerprint, html_main, line_dedup, near_dedup, packing, pieces, resampling, sharding, suffix_dedup, toxicity, whitening
from noticeflow.llm.common import table


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return pieces.encoded(docs).select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.size("encoded.ids").cast("long").alias("n_pieces"),
        "encoded.ids_crc32",
        "encoded.score",
        F.size("encoded.nbest").alias("n_best"),
        F.transform("encoded.nbest", lambda x: F.round(x["score"], 3)).alias("scores"),
        F.transform("encoded.nbest", lambda x: x["n_pieces"]).alias("piece_counts"),
        F.col("encoded.exact").alias("round_trip"),
        F.col("encoded.ids").alias("ids"),
        F.transform("encoded.nbest", lambda x: x["changes"]).alias("segmentations"),
    )


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "cut.n_bytes", "cut.n_removed", F.size("cut.spans").cast("long").alias("n_spans"), "cut.kept_sha256")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = line_dedup.drop_boilerplate(docs, counters=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP6_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS host, text FROM documents),
pages AS (SELECT host, count(*) AS n FROM docs GROUP BY host),
parts AS (
  SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM docs WHERE text IS NOT NULL),
counts AS (
  SELECT host, line, count(DISTINCT doc_id) AS c FROM parts WHERE trim(line, ' ') <> '' GROUP BY host, line),
hot AS (
  SELECT host, line FROM counts JOIN pages USING (host)
  WHERE n >= {line_dedup.MIN_PAGES} AND c >= {line_dedup.MIN_COUNT} AND c > {line_dedup.RATIO}::DOUBLE * n),
flagged AS (
  SELECT parts.*, hot.line IS NOT NULL AS drop_it FROM parts LEFT JOIN hot USING (host, line)),
kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE drop_it) AS n_dropped,
         string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT drop_it) AS body
  FROM flagged GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0)::INT AS n_lines, coalesce(n_dropped, 0)::INT AS n_dropped,
       sha256(coalesce(body, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html_main.extracted(pages, rules="rules")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "rules.*")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("stays"), "class_size")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resampling.resampled(docs, target).select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank", "n_words")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whole(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding")
    model = whitening.fit(rows)
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.variances])
    return whitening.whitened(rows, model).select(F.col("row.vec_id").alias("vec_id"), "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.matched(docs, table(spark, sf_dir, "benchmark"))
    n_hit = decontamination.n_hit(F.col("spans"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


#: The words of a text in SQL.
WORDS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP11_SQL = r"""
WITH tab AS (
  SELECT list(list_reduce(range(8), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t FROM range(256) r(b)),
every AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
split AS (
  SELECT side, id, row_number() OVER () AS r,
    coalesce(@WORDS@, []) AS w FROM every),
grams AS (
  SELECT side, r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM split),
counted AS (SELECT side, r, f, count(*) AS c FROM grams GROUP BY ALL),
kinds AS (SELECT DISTINCT f FROM counted),
coded AS (SELECT f, xor(list_reduce(list_transform(range(octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) % 10000 AS k FROM kinds, tab),
bucketed AS (SELECT side, r, k, sum(c)::BIGINT AS c FROM counted JOIN coded USING (f) GROUP BY ALL),
shares AS (SELECT k, coalesce(sum(c) FILTER (WHERE side = 'd'), 0)::DOUBLE AS s, coalesce(sum(c) FILTER (WHERE side = 'b'), 0)::DOUBLE AS t FROM bucketed GROUP BY k),
gains AS (
  SELECT k, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM shares) + 10000) / ((s + 1) * ((SELECT sum(t) FROM shares) + 10000))))::BIGINT AS g FROM shares),
sums AS (SELECT r, sum(c * g)::BIGINT AS total FROM bucketed JOIN gains USING (k) WHERE side = 'd' GROUP BY r),
scored AS (
  SELECT id AS doc_id, len(w)::BIGINT AS n_words, greatest(0, 2 * len(w) - 1)::BIGINT AS n_features,
    CASE WHEN len(w) = 0 THEN 0 ELSE (total - ((total % (2 * len(w) - 1)) + (2 * len(w) - 1)) % (2 * len(w) - 1)) // (2 * len(w) - 1) END::BIGINT AS weight,
    ('0x' || substr(sha256('7:' || coalesce(id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM split LEFT JOIN sums USING (r) WHERE side = 'd'),
drawn AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM scored),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place FROM drawn)
SELECT doc_id, n_words, n_features, weight, score,
       CASE WHEN n_words >= 20 AND place <= 25 * (SELECT count(*) FROM drawn WHERE n_words >= 20) // 100 THEN place END::BIGINT AS rank
FROM placed
""".replace("@WORDS@", WORDS_SQL)

OP13_SQL = r"""
WITH items AS (
  SELECT item_id, @WORDS@ AS w FROM benchmark),
docs AS (
  SELECT doc_id, coalesce(@WORDS@, []) AS w FROM documents),
sized AS (SELECT item_id, w, least(10, len(w)) AS n FROM items WHERE len(w) > 0),
wins AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
lengths AS (SELECT DISTINCT n FROM wins),
runs AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n)),
found AS (SELECT doc_id, item_id, i, runs.n FROM runs JOIN wins USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
""".replace("@WORDS@", WORDS_SQL)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ann": op1_ann,
        "op2_pieces": op2_pieces,
        "op3_fingerprint": op3_fingerprint,
        "op4_sharding": op4_sharding,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_line_dedup": op6_line_dedup,
        "op7_packing": op7_packing,
        "op8_main_text": op8_main_text,
        "op9_near_dedup": op9_near_dedup,
        "op10_toxicity": op10_toxicity,
        "op11_resampling": op11_resampling,
        "op12_whitening": op12_whitening,
        "op13_decontamination": op13_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_line_dedup": OP6_SQL, "op11_resampling": OP11_SQL, "op13_decontamination": OP13_SQL}
