"""Queries over the wide word table of a corpus: families folded on the word key, prepared tables, vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import hashing
from lectern.operators import families
from lectern.plans import corpus, corpus_features
from lectern.queries.boundaries import _BIGRAM
from lectern.queries.registry import Tables, query
from lectern.queries.sql import BOUNDARY, WORDS
from lectern.queries.texts import POS_SQL

DIMENSIONS = 16

_CELLS = f"""cells AS (SELECT text_id, p, s, d, sum(g)::DOUBLE AS x FROM (
    SELECT text_id, p, s, ('0x' || substr(md5(lower(word_form)), 1, 2))::INTEGER % {DIMENSIONS} AS d,
      CASE WHEN substr(md5(lower(word_form)), 3, 1) < '8' THEN 1 ELSE -1 END AS g FROM words) GROUP BY 1, 2, 3, 4)"""

_COHESION = f"""{_CELLS},
sn AS (SELECT text_id, p, s, lag(s) OVER (PARTITION BY text_id, p ORDER BY s) AS ps FROM (SELECT DISTINCT text_id, p, s FROM words)),
nm AS (SELECT text_id, p, s, sqrt(sum(x * x)) AS n FROM cells GROUP BY 1, 2, 3),
dots AS (SELECT sn.text_id, sn.p, sn.s, sum(a.x * b.x) AS v FROM sn
  JOIN cells AS a ON a.text_id = sn.text_id AND a.p = sn.p AND a.s = sn.s
  JOIN cells AS b ON b.text_id = sn.text_id AND b.p = sn.p AND b.s = sn.ps AND b.d = a.d GROUP BY 1, 2, 3),
dist AS (SELECT sn.text_id, sn.p, CASE WHEN ps IS NOT NULL AND a.n * b.n > 0 THEN 1 - coalesce(v, 0) / (a.n * b.n) END AS d
  FROM sn JOIN nm AS a ON a.text_id = sn.text_id AND a.p = sn.p AND a.s = sn.s
  LEFT JOIN nm AS b ON b.text_id = sn.text_id AND b.p = sn.p AND b.s = sn.ps
  LEFT JOIN dots ON dots.text_id = sn.text_id AND dots.p = sn.p AND dots.s = sn.s),
cohesion AS (SELECT text_id, p, 1 - avg(d) AS paragraph_cohesion, avg(d) AS local_semantic_drift, count(*) AS sentence_count_embedded
  FROM dist GROUP BY 1, 2 HAVING count(d) > 0)"""

_WIDE = f"""{BOUNDARY}, {_BIGRAM.removeprefix(WORDS).lstrip().removeprefix(',').replace('seq AS', 'seq2 AS', 1).replace('FROM seq ', 'FROM seq2 ')},
lf AS (SELECT lower(word_form) AS f, count(*) AS corpus_frequency FROM words WHERE regexp_matches(word_form, '[\\p{{L}}\\p{{Nd}}]') GROUP BY 1),
lx AS (SELECT *, ln(1 + corpus_frequency) AS log_corpus_frequency, dense_rank() OVER (ORDER BY corpus_frequency DESC) AS frequency_rank FROM lf),
{_COHESION},
tagged AS (SELECT word_id, {POS_SQL} AS upos FROM words),
wide AS (SELECT b.text_id, b.p, b.s, b.w, b.paragraph_id, b.sentence_id, b.word_id, b.word_form, corpus_frequency, log_corpus_frequency, frequency_rank,
    upos, upos = 'VERB' AS is_finite_verb, upos IN ('NOUN', 'PROPN') AS is_noun_or_proper, -ln(sc.p) AS lm_word_surprisal,
    CASE WHEN sc.p IS NOT NULL THEN entropy END AS lm_word_entropy,
    CASE WHEN orth_boundary_type <> 'unknown' THEN orth_boundary_type END AS prev_boundary_type_orth,
    CASE WHEN orth_boundary_type <> 'unknown' THEN boundary_opacity_score END AS prev_boundary_opacity_score,
    lx.f IS NULL AS missing_lexical, false AS missing_parser, b.prev_word IS NULL AS missing_lm, orth_boundary_type = 'unknown' AS missing_segmentation,
    paragraph_cohesion, local_semantic_drift, sentence_count_embedded, cohesion.p IS NULL AS missing_embedding
  FROM boundary AS b JOIN tagged ON tagged.word_id = b.word_id LEFT JOIN lx ON lx.f = lower(b.word_form) AND regexp_matches(b.word_form, '[\\p{{L}}\\p{{Nd}}]')
  LEFT JOIN sc ON sc.prev_word = b.prev_word AND sc.word_form = b.word_form LEFT JOIN ent ON ent.prev_word = b.prev_word
  LEFT JOIN cohesion ON cohesion.text_id = b.text_id AND cohesion.p = b.p)"""

_EXPOSURE = """count(*) AS word_rows, avg(log_corpus_frequency) AS mean_log_frequency, avg(lm_word_surprisal) AS mean_surprisal,
  avg(lm_word_entropy) AS mean_entropy, avg(prev_boundary_opacity_score) AS mean_segmentation_opacity,
  avg((prev_boundary_type_orth = 'V#V')::INT) AS vv_boundary_exposure_rate, avg(is_noun_or_proper::INT) AS noun_rate,
  avg(missing_lm::INT) AS lm_missing_rate, avg(missing_segmentation::INT) AS segmentation_missing_rate, avg(missing_embedding::INT) AS embedding_missing_rate"""
_RATES = (
    "mean_log_frequency mean_surprisal mean_entropy mean_segmentation_opacity vv_boundary_exposure_rate noun_rate "
    "lm_missing_rate segmentation_missing_rate embedding_missing_rate"
)


@query(
    "j04_corpus_word_families",
    f"WITH {_WIDE} SELECT * EXCLUDE (text_id, p, s, w) FROM wide",
    floats="log_corpus_frequency lm_word_surprisal lm_word_entropy paragraph_cohesion local_semantic_drift",
)
def word_families(t: Tables):
    """Lexical, parser, surprisal, boundary and paragraph families on every word of the corpus."""
    return corpus_features.word_features(t.documents).drop("text_id", "p", "s", "w")


@query(
    "j04_j13_corpus_family_report",
    f"""WITH {_WIDE}, k AS (SELECT count(*) AS base_rows, count(*) AS joined_rows, count(*) FILTER (WHERE missing_lexical) AS a, count(*) FILTER (WHERE missing_lm) AS b,
  count(*) FILTER (WHERE missing_segmentation) AS c, count(*) FILTER (WHERE missing_embedding) AS d FROM wide)
SELECT base_rows, joined_rows, unnest(['lexical', 'parser', 'lm', 'segmentation', 'embedding']) AS family, unnest([a, 0, b, c, d]) AS missing_rows,
  unnest([a, 0, b, c, d]) / joined_rows::DOUBLE AS missing_rate FROM k""",
    floats="missing_rate",
)
def family_report(t: Tables):
    """Rows before and after the fold, and the share of words that each family lacks."""
    words = corpus_features.corpus_words(t.documents)
    return families.missing_rates(corpus_features.word_features(t.documents, words), words)


@query(
    "j15_corpus_sentence_table",
    f"WITH {_WIDE} SELECT sentence_id, any_value(paragraph_cohesion) AS paragraph_cohesion, any_value(local_semantic_drift) AS local_semantic_drift, {_EXPOSURE} FROM wide GROUP BY sentence_id",
    floats="paragraph_cohesion local_semantic_drift " + _RATES,
)
def corpus_sentences(t: Tables):
    """Prepared sentence table of the corpus: exposure means and quality rates."""
    return corpus_features.prepared_sentences(corpus_features.word_features(t.documents))


@query("j15_corpus_text_table", f"WITH {_WIDE} SELECT text_id, {_EXPOSURE} FROM wide GROUP BY text_id", floats=_RATES)
def corpus_texts(t: Tables):
    """Prepared text table of the corpus."""
    return corpus_features.prepared_texts(corpus_features.word_features(t.documents))


@query(
    "g04_signed_sentence_cells",
    f"WITH {WORDS}, {_CELLS} SELECT text_id, p, s, d, x::BIGINT AS x FROM cells WHERE x <> 0",
)
def signed_sentence_cells(t: Tables):
    """Signed feature hashing of every sentence, the non-zero cells."""
    words = corpus.words_from_texts(t.documents)
    cells = words.select("text_id", "p", "s", F.inline(F.array(hashing.signed_cell(F.lower("word_form"), DIMENSIONS))))
    return cells.groupBy("text_id", "p", "s", "d").agg(F.sum("g").alias("x")).where("x <> 0")


@query(
    "g04_a32_corpus_cohesion",
    f"WITH {WORDS}, {_COHESION} SELECT * FROM cohesion",
    floats="paragraph_cohesion local_semantic_drift",
)
def corpus_cohesion(t: Tables):
    """Cohesion of every paragraph of the corpus from signed vectors of its sentences."""
    return corpus_features.paragraph_cohesion(t.documents, DIMENSIONS)
