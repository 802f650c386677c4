"""SQL fragments shared by the oracles: the same test-data mapping, written for DuckDB."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

WORDS = r"""
lines AS (
  SELECT doc_id, lang, source, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS p
  FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS l FROM documents)),
sents AS (
  SELECT doc_id, lang, source, p, unnest(x) AS sentence, unnest(range(1, len(x) + 1)) AS s
  FROM (SELECT *, regexp_extract_all(line, '[^.!?]*[.!?]+|[^.!?]+') AS x FROM lines)),
words AS (
  SELECT doc_id::VARCHAR AS text_id, lang, source, p::INTEGER AS p, s::INTEGER AS s, unnest(x) AS word_form,
         unnest(range(1, len(x) + 1))::INTEGER AS w, len(x) AS tokens_in_sentence,
         doc_id || '_p' || p AS paragraph_id, doc_id || '_p' || p || '_s' || s AS sentence_id,
         doc_id || '_p' || p || '_s' || s || '_w' || unnest(range(1, len(x) + 1)) AS word_id
  FROM (SELECT *, regexp_extract_all(sentence, '[^ \t\r\n\f]+') AS x FROM sents))
"""


def with_words(body: str) -> str:
    return f"WITH {WORDS} {body}"


VOCAB = WORDS + ", vocab AS (SELECT word_form, count(*) AS tokens FROM words GROUP BY word_form)"


def with_vocab(body: str) -> str:
    return f"WITH {VOCAB} {body}"


def strip_letters(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^\\P{{L}}+|\\P{{L}}+$', '', 'g')"


V = "aeiouyæøåAEIOUYÆØÅ"


def letter_class(c: str) -> str:
    return (
        f"CASE WHEN coalesce({c}, '') = '' THEN 'unknown' WHEN regexp_full_match({c}, '[{V}]') THEN 'V' "
        f"WHEN regexp_full_match({c}, '\\p{{L}}') THEN 'C' ELSE 'other' END"
    )


BOUNDARY = (
    WORDS
    + f""", seq AS (
  SELECT *, lag(word_form) OVER (PARTITION BY sentence_id ORDER BY w) AS prev_word,
         lag(word_id) OVER (PARTITION BY sentence_id ORDER BY w) AS prev_word_id, w = 1 AS initial FROM words),
norm AS (SELECT *, {strip_letters('prev_word')} AS a, {strip_letters('word_form')} AS b FROM seq),
cls AS (SELECT *, {letter_class('right(a, 1)')} AS l, {letter_class('left(b, 1)')} AS r FROM norm),
typed AS (SELECT *, CASE WHEN initial OR l = 'unknown' OR r = 'unknown' THEN 'unknown'
    WHEN l = 'other' OR r = 'other' THEN 'other' ELSE l || '#' || r END AS orth_boundary_type FROM cls),
boundary AS (SELECT *, CASE orth_boundary_type WHEN 'C#C' THEN 0 WHEN 'C#V' THEN 1 WHEN 'V#C' THEN 2 WHEN 'V#V' THEN 3 END AS boundary_opacity_score,
    CASE orth_boundary_type WHEN 'C#C' THEN 'low' WHEN 'C#V' THEN 'medium_low' WHEN 'V#C' THEN 'medium_high' WHEN 'V#V' THEN 'high' ELSE orth_boundary_type END AS boundary_opacity_class,
    (length(regexp_extract(a, '[{V}]*$', 0)) + length(regexp_extract(b, '^[{V}]*', 0)))::INTEGER AS vocoid_run_cross_boundary FROM typed)
"""
)


def with_boundary(body: str) -> str:
    return f"WITH {BOUNDARY} {body}"


PEOPLE = """
people AS (
  SELECT 'P' || CASE WHEN s_suppkey < 10 THEN '0' ELSE '' END || s_suppkey AS participant_id,
    (CASE WHEN s_acctbal >= 6000 THEN 1 WHEN s_acctbal <= 4000 THEN 0 END)::INTEGER AS label,
    (CASE WHEN s_suppkey % 7 <> 0 THEN 18 + s_suppkey % 50 END)::INTEGER AS age,
    CASE WHEN s_suppkey % 11 <> 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'F' ELSE 'M' END END AS sex,
    CASE WHEN s_suppkey % 13 <> 0 THEN 0.5::DOUBLE + (s_suppkey % 50) / 100::DOUBLE END AS comprehension_score,
    CASE WHEN s_suppkey % 9 = 0 THEN 'self report' WHEN s_suppkey % 5 = 0 THEN 'weak screening' ELSE 'formal' END AS label_provenance,
    r_name AS recording_batch
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)
"""

PANEL = (
    PEOPLE
    + """,
lex AS (
  SELECT 'w' || p_partkey AS word_id, p_partkey // 10 AS sentence_id, p_partkey // 50 AS paragraph_id, p_name AS word_form,
    p_size AS word_length_chars, ln(1 + (p_partkey % 97)::DOUBLE) AS log_corpus_frequency,
    CASE WHEN p_partkey % 29 <> 0 THEN (p_partkey % 17) / 2::DOUBLE END AS lm_word_surprisal,
    CASE WHEN p_partkey % 29 <> 0 THEN 1 + (p_partkey % 11) / 4::DOUBLE END AS lm_word_entropy,
    (5 + p_partkey % 23)::INTEGER AS sentence_length_words, (p_partkey % 10) / 9::DOUBLE AS word_position_in_sentence_norm,
    CASE WHEN p_partkey % 13 <> 0 THEN ['C#C', 'C#V', 'V#C', 'V#V'][p_partkey % 4 + 1] ELSE 'unknown' END AS prev_boundary_type_orth,
    (CASE WHEN p_partkey % 13 <> 0 THEN p_partkey % 4 END)::INTEGER AS prev_boundary_opacity_score,
    CASE WHEN (p_partkey // 50) % 3 <> 0 THEN (p_partkey % 7) / 10::DOUBLE END AS paragraph_cohesion,
    CASE WHEN (p_partkey // 50) % 3 <> 0 THEN 1 - (p_partkey % 7) / 10::DOUBLE END AS local_semantic_drift,
    CASE WHEN p_partkey % 29 <> 0 THEN 'ok' ELSE 'error' END AS lm_alignment_status,
    CASE WHEN p_partkey % 31 = 0 THEN 'non_special_token_unassigned' END AS lm_alignment_warning,
    CASE WHEN p_partkey % 37 <> 0 THEN 'NOUN' END AS upos FROM part),
obs0 AS (
  SELECT 'P' || CASE WHEN l_suppkey < 10 THEN '0' ELSE '' END || l_suppkey AS participant_id, 'w' || l_partkey AS word_id,
    substr(o_orderpriority, 1, 1) AS text_id, l_orderkey, l_linenumber, l_returnflag, l_discount,
    l_returnflag = 'N' AND floor(l_quantity)::BIGINT % 7 = 0 AS unseen,
    120::DOUBLE + floor(l_extendedprice)::BIGINT % 150 AS ffd, 2.5::DOUBLE * p_size AS extra,
    4::DOUBLE * ((l_partkey % 17) / 2::DOUBLE) * (1 + 0.5::DOUBLE * CASE WHEN s_acctbal >= 6000 THEN 1 ELSE 0 END) AS burden, l_quantity,
    CASE WHEN NOT (l_linestatus = 'F' AND floor(l_quantity)::BIGINT % 5 = 0) THEN (floor(l_quantity)::BIGINT % 4)::DOUBLE END AS fixation_count
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
obs AS (
  SELECT participant_id, word_id, text_id, l_orderkey, l_linenumber,
    CASE WHEN NOT unseen THEN ffd END AS FFD, CASE WHEN NOT unseen THEN ffd + extra END AS GD,
    CASE WHEN NOT unseen THEN ffd + extra + burden + l_quantity END AS TRT,
    CASE WHEN l_returnflag <> 'R' THEN ffd + extra + burden + l_quantity + l_discount * 1000 END AS go_past_time, fixation_count,
    (coalesce(fixation_count, 0) = 0)::INTEGER AS skip, greatest(coalesce(fixation_count, 0) - 1, 0) AS refixation_count FROM obs0),
panel AS (
  SELECT participant_id, word_id, arg_min(text_id, l_orderkey * 10 + l_linenumber) AS text_id, avg(FFD) AS FFD, avg(GD) AS GD, avg(TRT) AS TRT,
    avg(go_past_time) AS go_past_time, avg(fixation_count) AS fixation_count, round_even(avg(skip), 0)::INTEGER AS skip,
    avg(refixation_count) AS refixation_count, count(*) AS source_observation_count FROM obs GROUP BY 1, 2),
word_level AS (
  SELECT panel.*, lex.* EXCLUDE (word_id), people.* EXCLUDE (participant_id), label::DOUBLE AS label_num,
    (prev_boundary_type_orth = 'V#V')::INTEGER AS vv_indicator, 1 - least(greatest(skip, 0), 1)::DOUBLE AS fixated,
    CASE WHEN FFD > 0 THEN ln(1 + FFD) END AS log_ffd, CASE WHEN GD > 0 THEN ln(1 + GD) END AS log_first_pass_duration,
    CASE WHEN go_past_time > 0 THEN ln(1 + go_past_time) END AS log_go_past_time,
    CASE WHEN TRT > 0 THEN ln(1 + TRT) END AS log_total_fixation_duration, ln(1 + fixation_count) AS log_fixation_count
  FROM panel LEFT JOIN lex USING (word_id) LEFT JOIN people USING (participant_id))
"""
)


def with_panel(body: str) -> str:
    return f"WITH {PANEL} {body}"


def with_people(body: str) -> str:
    return f"WITH {PEOPLE} {body}"


def sql_slope(y: str, x: str, minimum: int = 3) -> str:
    return (
        f"CASE WHEN count(*) FILTER (WHERE {y} IS NOT NULL AND {x} IS NOT NULL) >= {minimum} "
        f"AND min({x}) FILTER (WHERE {y} IS NOT NULL AND {x} IS NOT NULL) < max({x}) FILTER (WHERE {y} IS NOT NULL AND {x} IS NOT NULL) "
        f"THEN regr_slope({y}, {x}) END"
    )


def sql_corr(x: str, y: str, minimum: int = 3) -> str:
    both = f"FILTER (WHERE {y} IS NOT NULL AND {x} IS NOT NULL)"
    return (
        f"CASE WHEN count(*) {both} >= {minimum} AND min({x}) {both} < max({x}) {both} AND min({y}) {both} < max({y}) {both} "
        f"THEN corr({x}, {y}) END"
    )


# --- classifiers refitted one by one ------------------------------------------------


def _solved(q: int, keys: str, source: str) -> str:
    """Newton moves ``d0..`` from sums ``h<i>_<j>`` (i <= j) and ``g<i>`` by elimination and back substitution."""
    held = ", ".join(f"b{i}" for i in range(q))
    for k in range(q - 1):
        pairs = ", ".join(f"h{i}_{j} - h{k}_{i} * h{k}_{j} / h{k}_{k} AS h{i}_{j}" if i > k else f"h{i}_{j}" for i in range(q) for j in range(i, q))
        sides = ", ".join(f"g{i} - h{k}_{i} * g{k} / h{k}_{k} AS g{i}" if i > k else f"g{i}" for i in range(q))
        source = f"(SELECT {keys}, it, {held}, {pairs}, {sides} FROM {source})"
    for i in reversed(range(q)):  # one level each: an alias used in its own level is expanded every time
        source = f"(SELECT *, (g{i}" + "".join(f" - h{i}_{j} * d{j}" for j in range(i + 1, q)) + f") / h{i}_{i} AS d{i} FROM {source})"
    return source


def sql_newton(train: str, p: int, loss: str = "logistic", keys: str = "fit, g", steps: int = 12, name: str = "coef", ridge: float = 1.0) -> str:
    """CTEs ``<name>(keys, b0..bp)``: ridge classifiers on ``train(keys, y, w, z1..zp)`` by a recursive Newton iteration."""
    q = p + 1
    z = ["1.0", *[f"z{i}" for i in range(1, q)]]
    eta = "b0" + "".join(f" + b{i} * z{i}" for i in range(1, q))
    b = ", ".join(f"b{i}" for i in range(q))
    if loss == "logistic":
        pull, curve, cut = "w * (y - pr)", "w * pr * (1 - pr)", f"1 / (1 + exp(-({eta})))"
    else:
        pull, curve, cut = "2 * w * (2 * y - 1) * greatest(1 - (2 * y - 1) * pr, 0)", "2 * w * ((2 * y - 1) * pr < 1)::INT", eta
    bound = [0.0 if i == 0 and loss == "logistic" else ridge for i in range(q)]
    sums = ", ".join(f"sum(c * {z[i]} * {z[j]}){f' + {bound[i]} + 1e-10' if i == j else ''} AS h{i}_{j}" for i in range(q) for j in range(i, q))
    rows = f"SELECT {keys}, it, {b}, {', '.join(z[1:])}, y, w, {cut} AS pr FROM {name}_run JOIN {train} USING ({keys}) WHERE it < {steps}"
    cells = f"(SELECT *, {pull} AS r, {curve} AS c FROM ({rows}))"
    state = ", ".join(f"any_value(b{i}) AS b{i}" for i in range(q))
    sides = ", ".join(f"sum(r * {z[i]}) - {bound[i]} * any_value(b{i}) AS g{i}" for i in range(q))
    added = f"(SELECT {keys}, any_value(it) AS it, {state}, {sums}, {sides} FROM {cells} GROUP BY {keys})"
    step = ", ".join(f"b{i} + d{i} * least(1, 20 / (it + 1.0)) AS b{i}" for i in range(q))
    start = ", ".join(f"0::DOUBLE AS b{i}" for i in range(q))
    return f"""{name}_run AS (SELECT DISTINCT {keys}, 0 AS it, {start} FROM {train} UNION ALL SELECT {keys}, it + 1 AS it, {step} FROM {_solved(q, keys, added)}),
{name} AS (SELECT {keys}, {b} FROM {name}_run WHERE it = {steps})"""


def sql_training(rows: str, features: Sequence[str], groups: Mapping[str, Sequence[str]], fits: str = "ft") -> str:
    """CTEs ``tz`` (training rows of every fit, imputed, scaled, balanced) and ``sz`` (its scaler).

    ``rows(split, key, fold, unit, y, features)`` train every fit of ``fits(fit, split, fold, unit)`` that leaves neither their fold nor their unit out.
    """
    f = list(features)
    members = ", ".join(f"if(g IN ({', '.join(repr(n) for n, cols in groups.items() if c in cols) or repr('')}), CASE WHEN s{i} > 1e-9 THEN (coalesce({c}, m{i}, 0) - a{i}) / s{i} ELSE 0 END, 0) AS z{i}" for i, c in enumerate(f, 1))
    names = " UNION ALL ".join(f"SELECT {n!r} AS g" for n in groups)
    return f"""gn AS ({names}),
tr AS MATERIALIZED (SELECT ft.fit, r.* FROM {fits} AS ft JOIN {rows} AS r ON r.split = ft.split AND r.fold <> ft.fold AND r.unit <> ft.unit),
md AS (SELECT fit, {', '.join(f'median({c})::DOUBLE AS m{i}' for i, c in enumerate(f, 1))}, count(*) AS n, sum(y) AS n1 FROM tr GROUP BY fit),
sz AS MATERIALIZED (SELECT md.*, {', '.join(f'a{i}, s{i}' for i in range(1, len(f) + 1))} FROM md JOIN (SELECT fit, {', '.join(f'avg(coalesce({c}, m{i}, 0)) AS a{i}, stddev_pop(coalesce({c}, m{i}, 0)) AS s{i}' for i, c in enumerate(f, 1))} FROM tr JOIN md USING (fit) GROUP BY fit) USING (fit)),
tz AS MATERIALIZED (SELECT fit, g, y, n / (2.0::DOUBLE * CASE WHEN y = 1 THEN n1 ELSE n - n1 END) AS w, {members} FROM tr JOIN sz USING (fit), gn WHERE n1 > 0 AND n1 < n)"""


def sql_held_out(rows: str, features: Sequence[str], groups: Mapping[str, Sequence[str]], coef: str = "coef", fits: str = "ft", keep: str = "key") -> str:
    """A SELECT of ``g, fit, keep, y_true, y_score`` for the rows that each fit leaves out (a fold, or the unit where no fold is)."""
    f = list(features)
    eta = "b0" + "".join(f" + b{i} * (CASE WHEN s{i} > 1e-9 THEN (coalesce({c}, m{i}, 0) - a{i}) / s{i} ELSE 0 END)" for i, c in enumerate(f, 1))
    return f"""SELECT g, fit, {keep}, y AS y_true, 1 / (1 + exp(-({eta}))) AS y_score FROM {fits} AS ft
JOIN {rows} AS r ON r.split = ft.split AND CASE WHEN ft.fold >= 0 THEN r.fold = ft.fold AND r.unit <> ft.unit ELSE r.unit = ft.unit END JOIN sz USING (fit) JOIN {coef} USING (fit)"""
