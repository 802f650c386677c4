"""Registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.llm import decontamination, language, lines, neighbours, packing, periodic, repeats, secrets, sharding, simhash, tokens, toxicity, vafile
from lectern.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items of which documents hold 0.8 of the five-word shingles or more."""
    return decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


ORACLES["op1_decontamination"] = """
WITH worded AS (
    SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
    FROM (SELECT DISTINCT doc_id, text FROM documents)
    UNION ALL
    SELECT 'i', item_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')
    FROM (SELECT DISTINCT item_id, text FROM benchmark)
), shingled AS (
    SELECT DISTINCT kind, id, unnest([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, greatest(len(w) - 4, 1) + 1)]) AS shingle
    FROM worded WHERE len(w) > 0
), sizes AS (SELECT id, count(*) AS n_shingles FROM shingled WHERE kind = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_common, n_shingles, count(*) / n_shingles AS containment
FROM shingled d JOIN shingled i ON d.shingle = i.shingle AND d.kind = 'd' AND i.kind = 'i' JOIN sizes s ON s.id = i.id
GROUP BY d.id, i.id, n_shingles HAVING count(*) / n_shingles >= 0.8
"""


@query
def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of whole texts from the count at every prefix."""
    return tokens.token_index(table(spark, folder, "documents"), limit=1024)


@query
def op3_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in random order over eight shards of equal row counts."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    return sharding.shards(docs, n_shards=8).select(
        "doc_id",
        sharding.record_size(F.col("text")).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("__shard").alias("shard"),
        F.col("__slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes within repeated strings of 200 bytes removed from every document."""
    return repeats.remove_repeats(table(spark, folder, "documents"), length=200)


@query
def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """SimHash of three-word shingles, linked at two differing bits or fewer."""
    found = simhash.near_duplicates(table(spark, folder, "documents"), width=3, bits=64, radius=2)
    return found.select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id")


@query
def op6_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one."""
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Documents packed into sequences of 1,024 tokens, balanced by cost."""
    return packing.pack(table(spark, folder, "documents"), capacity=1024)


@query
def op9_secret_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets by fixed patterns and by character models."""
    docs = table(spark, folder, "documents")
    return secrets.scan(docs, secrets.fit(docs))


@query
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity scores from maximal scoring segments."""
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


@query
def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    """Languages by a conditional random field over words."""
    docs = table(spark, folder, "documents")
    return language.predict(docs, language.fit(docs)).select("doc_id", "held_out", "lang_pred", "score")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """Documents of which every tenth, by the hash of its id, repeats a stretch of its words to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    listed = F.when(h % 10 == 0, F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    docs = docs.select("doc_id", "text", listed.alias("words"))  # used often, so a column of its own
    words, n = F.col("words"), F.size("words")
    a = (g % n).cast("int")
    period = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    times = F.ceil((n - a) / period).cast("int")
    repeated = F.flatten(F.array_repeat(F.slice(words, a + 1, period), times))
    planted = F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), repeated), F.lit(1), n), " ")
    return docs.select("doc_id", F.when(n > 0, planted).otherwise(F.col("text")).alias("text"))


@query
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of four periods and more in documents, some of which repeat themselves."""
    found = periodic.periodic_runs(with_planted_periods(table(spark, folder, "documents")), least=6, times=4)
    best = periodic.longest_in_periods("runs")
    written = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(written, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )


@query
def op12_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """Three rounds of 16 centroids over the integer vectors of 64 components."""
    hashed = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    found = vafile.clustered(table(spark, folder, "embeddings"), hashed, k=16, rounds=3, dim=64, scale=64)
    columns = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if found is None:
        return spark.createDataFrame([], columns)
    centroid = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256)
    return vafile.with_inertia(found).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", centroid.alias("centroid_sha256"))


def _centroid_round(number: int) -> str:
    """Assignment to the centroids ``c<number>`` and, from it, the next ones."""
    return f"""a{number} AS (SELECT vec_id, x, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
  SELECT kept.vec_id, kept.x, k, list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(kept.x, c.x)]) AS d FROM kept, c{number} AS c) GROUP BY vec_id, x),
c{number + 1} AS (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{number} AS c LEFT JOIN (
  SELECT k, list(s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END ORDER BY j) AS x
  FROM (SELECT k, j, sum(v)::BIGINT AS s, count(*) AS n FROM (SELECT k, unnest(x) AS v, unnest(range(64)) AS j FROM a{number}) GROUP BY k, j) GROUP BY k) AS m USING (k))"""


ORACLES["op12_centroids"] = f"""
WITH kept AS (SELECT vec_id, [floor(64 * v::DOUBLE)::BIGINT FOR v IN embedding] AS x FROM embeddings
  WHERE len(embedding) = 64 AND len([v FOR v IN embedding IF v IS NOT NULL AND isfinite(v)]) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, x FROM kept QUALIFY k < 16),
{", ".join(_centroid_round(i) for i in range(4))},
inertias AS (SELECT k, sum(d) AS own FROM a3 GROUP BY k)
SELECT vec_id, k::INT AS cluster, d::BIGINT AS distance, own::BIGINT AS cluster_inertia, (SELECT sum(own) FROM inertias)::BIGINT AS inertia,
  sha256(array_to_string(c3.x, ',')) AS centroid_sha256
FROM a3 JOIN c3 USING (k) JOIN inertias USING (k)
"""


@query
def op13_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without the lines of ten characters and more that an earlier document holds."""
    docs = table(spark, folder, "documents")
    kept = lines.kept_texts(docs, lines.keep_bitmaps(docs, least=10))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLES["op13_lines"] = """
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
firsts AS (SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key),
judged AS (SELECT keyed.*, coalesce(doc_id <> first_doc, false) AS dropped FROM keyed LEFT JOIN firsts USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
