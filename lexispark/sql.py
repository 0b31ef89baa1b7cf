"""SQL for DuckDB that gives the rows of the core queries, written from the definitions and not from the Spark code."""

from __future__ import annotations

import re

from .functions.text import CATEGORY_PHRASES, NEGATIONS, OVERLAP_STOPWORDS, STOPWORDS
from .operators.encoding import SPECIAL, character_vocabulary
from .sources.files import SKIPPED_FOLDERS, SUFFIXES


def quoted(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def folded(x: str) -> str:
    return f"strip_accents(lower({x}))"


def stem(w: str) -> str:
    one = f"regexp_replace({w}, '[sx]$', '')"
    return f"CASE WHEN length({w}) <= 4 OR NOT regexp_full_match({w}, '\\p{{L}}+') THEN {w} ELSE left(CASE WHEN length({one}) > 4 AND {one} LIKE '%e' THEN {one}[:-2] ELSE {one} END, 7) END"


def word_list(x: str) -> str:
    return f"regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+')"


def term_list(x: str) -> str:
    kept = f"list_filter({word_list(folded(f'coalesce({x}, $$$$)'))}, lambda w: w <> '_' AND NOT list_contains({quoted(STOPWORDS)}, w))"
    return f"list_transform({kept}, lambda w: {stem('w')})"


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[\\s\\p{{Z}}]+', ' ', 'g'))"


def rule_stem(w: str) -> str:
    bare = f"regexp_replace(regexp_replace({w}, 's+$', ''), 'e+$', '')"
    return f"left(CASE WHEN length({bare}) >= 6 THEN regexp_replace({bare}, '(iqu|abl)$', '') ELSE {bare} END, 5)"


PAIRS = "pairs AS (SELECT * FROM contrastive_train UNION ALL BY NAME SELECT * FROM contrastive_val UNION ALL BY NAME SELECT * FROM contrastive_test)"
ASKED = "asked AS (SELECT query, min(id) AS qid FROM eval_cases GROUP BY query)"


def rule(source: str, query: str, text: str, keep: str) -> str:
    """CTEs that end in ``ruled``: the columns of ``keep`` and the rule's score."""
    return f"""
r1 AS (SELECT {keep}, {norm(query)} AS q, {norm(text)} AS c FROM {source}),
r2 AS (SELECT *, list_filter({word_list('q')}, lambda w: length(w) > 1) AS qw, list_filter({word_list('c')}, lambda w: length(w) > 1) AS cw FROM r1),
r3 AS (SELECT *, list_transform(qw, lambda w: {rule_stem('w')}) AS qs, list_distinct(list_transform(cw, lambda w: {rule_stem('w')})) AS cs FROM r2),
r4 AS (SELECT *, len(list_filter(qs, lambda s: len(list_filter(cs, lambda t: contains(t, s))) > 0)) AS hits,
  list_has_any(qw, {quoted(NEGATIONS)}) <> list_has_any(cw, {quoted(NEGATIONS)}) AS differ FROM r3),
r5 AS (SELECT *, CASE WHEN hits / len(qs) >= 0.99 THEN 0.95 WHEN hits / len(qs) >= 0.66 THEN 0.78 WHEN hits / len(qs) >= 0.49 THEN 0.52 ELSE 0.20 END AS b0 FROM r4),
r6 AS (SELECT *, CASE WHEN contains(c, q) THEN least(0.99, b0 + 0.10) ELSE b0 END::DOUBLE AS b1 FROM r5),
r7 AS (SELECT *, CASE WHEN differ AND (contains(q, 'allerg') OR contains(q, 'contr')) THEN round(b1 * 0.85, 4) ELSE b1 END AS b2 FROM r6),
ruled AS (SELECT *, CASE WHEN len(qw) = 0 THEN 0.0 WHEN hits = 0 THEN 0.005 ELSE round(least(0.995, greatest(0.005, b2)), 4) END::DOUBLE AS score FROM r7)"""


def beginnings(x: str) -> str:
    return f"list_distinct(list_transform(list_filter({word_list(f'lower(coalesce({x}, $$$$))')}, lambda w: NOT list_contains({quoted(OVERLAP_STOPWORDS)}, w)), lambda w: left(w, 5)))"


SCORED = f"""{PAIRS},
{rule('pairs', 'query', 'content', 'pair_id, query, content, label, type, split, teacher')},
o1 AS (SELECT *, {beginnings('query')} AS oq, {beginnings('content')} AS oc FROM ruled),
scored AS (SELECT *, CASE WHEN len(oq) = 0 THEN 0.0 ELSE len(list_intersect(oq, oc)) / len(oq) END::DOUBLE AS overlap FROM o1)"""
TIERS = """decided AS (SELECT *, NOT (overlap = 0 AND score < 0.75) AND score < 0.95 AS asked,
  CASE WHEN overlap = 0 AND score < 0.75 THEN 'tier1_dropped' WHEN score >= 0.95 THEN 'tier1_kept'
    WHEN teacher IS NULL AND score >= 0.5 THEN 'fallback_kept' WHEN teacher IS NULL THEN 'fallback_dropped'
    WHEN teacher >= 0.5 THEN 'tier2_kept' WHEN teacher >= 0.25 AND overlap >= 0.2 AND score >= 0.7 THEN 'tier2_rescued' ELSE 'tier2_dropped' END AS decision FROM scored)"""
POSTINGS = f"""sized AS (SELECT row_id AS pid, {term_list('content')} AS ts FROM legal_records),
size AS (SELECT count(*) AS n, avg(len(ts)) AS m FROM sized),
tf AS (SELECT pid, dl, term, count(*) AS tf FROM (SELECT pid, len(ts) AS dl, unnest(ts) AS term FROM sized) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""


def auc_over(by: str) -> str:
    """CTE ``aucs`` from ``scored``: pairs won by rank sums with average ranks."""
    return f"""ranked AS (SELECT {by}, label, rank() OVER (PARTITION BY {by} ORDER BY score) + (count(*) OVER (PARTITION BY {by}, score) - 1) / 2 AS r FROM scored),
aucs AS (SELECT {by}, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q,
  CASE WHEN p > 0 AND q > 0 THEN (sum(r) FILTER (label = 1) - p * (p + 1) / 2) / (p * q) END AS auc FROM ranked GROUP BY {by})"""


CLEAN = "trim(regexp_replace(regexp_replace(coalesce({0}, ''), 'http\\S+', '', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g'))"
HITS = [" + ".join(f"(length(t) - length(replace(t, '{p.replace(chr(39), chr(39) * 2)}', ''))) // {len(p)}" for p in CATEGORY_PHRASES[k]) for k in sorted(CATEGORY_PHRASES)]
EDGES = "[0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9]::DOUBLE[]"

CASES = f"""{rule('eval_cases', 'query', 'doc', 'id, suite, category, query, doc, label')},
ov AS (SELECT *, CASE WHEN len({beginnings('query')}) = 0 THEN 0.0 ELSE len(list_intersect({beginnings('query')}, {beginnings('doc')})) / len({beginnings('query')}) END::DOUBLE AS overlap FROM ruled),
d AS (SELECT id, list_distinct({term_list('query')}) AS q, list_distinct({term_list('doc')}) AS t FROM eval_cases),
cdf AS (SELECT term, ln(1 + ((SELECT count(*) FROM d) - count(*) + 0.5) / (count(*) + 0.5)) AS w FROM (SELECT unnest(t) AS term FROM d) GROUP BY term),
cx AS (SELECT id, t, unnest(q) AS term FROM d),
cy AS (SELECT id, list_contains(t, term) AS hit, coalesce(w, (SELECT max(w) FROM cdf)) AS w FROM cx LEFT JOIN cdf USING (term)),
cv AS (SELECT id, least(1.0, coalesce(sum(w) FILTER (hit), 0) / sum(w)) AS c FROM cy GROUP BY id),
bd AS (SELECT doc, {term_list('doc')} AS ts FROM (SELECT DISTINCT doc FROM eval_cases WHERE doc IS NOT NULL)),
bs AS (SELECT count(*) AS n, avg(len(ts)) AS m FROM bd),
bt AS (SELECT doc, dl, term, count(*) AS tf FROM (SELECT doc, len(ts) AS dl, unnest(ts) AS term FROM bd) GROUP BY ALL),
bf AS (SELECT term, count(*) AS df FROM bt GROUP BY term),
bq AS (SELECT DISTINCT query, unnest({term_list('query')}) AS term FROM eval_cases),
bm AS (SELECT query, doc, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / m))) AS s FROM bq JOIN bt USING (term) JOIN bf USING (term) CROSS JOIN bs GROUP BY ALL),
wide AS (SELECT ov.*, coalesce(cv.c, 0.0) AS coverage, coalesce(bm.s, 0.0) AS bm25 FROM ov LEFT JOIN cv USING (id) LEFT JOIN bm USING (query, doc)),
scored AS (SELECT id, suite, query, label, x.scorer AS scorer, x.score AS score FROM (SELECT id, suite, query, label, unnest([
  {{'scorer': 'always', 'score': 1.0::DOUBLE}}, {{'scorer': 'keyword', 'score': score}}, {{'scorer': 'overlap', 'score': overlap}}, {{'scorer': 'coverage', 'score': coverage::DOUBLE}}, {{'scorer': 'bm25', 'score': bm25::DOUBLE}},
  {{'scorer': 'cascade', 'score': CASE WHEN score >= 0.5 AND NOT (overlap = 0 AND score < 0.75) THEN score ELSE 0.0 END}},
  {{'scorer': 'cascade_flat_50', 'score': CASE WHEN overlap > 0 THEN 0.5 ELSE 0.0 END::DOUBLE}}, {{'scorer': 'cascade_flat_72', 'score': CASE WHEN overlap > 0 THEN 0.72 ELSE 0.0 END::DOUBLE}}]) AS x FROM wide))"""

RECORDS = f"""a AS (SELECT row_id, {CLEAN.format('jurisdiction')} AS jurisdiction, {CLEAN.format('title')} AS title, left({CLEAN.format('content')}, 500) AS content FROM legal_records),
b AS (SELECT title, content, arg_min(jurisdiction, row_id) AS jurisdiction FROM a WHERE length(title) > 5 AND length(content) > 50 GROUP BY ALL),
c AS (SELECT *, {folded("title || ' ' || content")} AS t, ('0x' || md5(title)[:8])::BIGINT / 4294967295 AS place FROM b),
d AS (SELECT *, {quoted([])}::BIGINT[] || [{', '.join(HITS)}] AS hits FROM c),
records AS (SELECT left(sha1(title || chr(10) || content), 12) AS doc_id, jurisdiction, CASE WHEN place < 0.8 THEN 'train' WHEN place < 0.9 THEN 'val' ELSE 'test' END AS split,
  (CASE WHEN contains({folded('jurisdiction')}, 'droit') THEN 0 WHEN list_max(hits) = 0 OR len(list_filter(hits, lambda h: h = list_max(hits))) > 1 THEN -100 ELSE list_position(hits, list_max(hits)) - 1 END)::INT AS category,
  title, content FROM d)"""
NEWTON = """nc AS (SELECT score AS s, label AS y, count(*)::DOUBLE AS n FROM scored WHERE split = 'val' GROUP BY ALL),
nm AS (SELECT sum(n * s) / sum(n) AS mean, sqrt(sum(n * s * s) / sum(n) - (sum(n * s) / sum(n)) ** 2) AS sd FROM nc),
nx AS (SELECT (s - mean) / sd AS x, y, n FROM nc CROSS JOIN nm),
steps AS (SELECT 0 AS k, 0::DOUBLE AS w0, 0::DOUBLE AS w1
  UNION ALL SELECT k + 1, w0 - ((g0 + w0) * h11 - g1 * h01) / ((h00 + 1) * h11 - h01 * h01), w1 - (g1 * (h00 + 1) - (g0 + w0) * h01) / ((h00 + 1) * h11 - h01 * h01) FROM
    (SELECT k, w0, w1, sum(n * (p - y) * x) AS g0, sum(n * (p - y)) AS g1, sum(n * p * (1 - p) * x * x) AS h00, sum(n * p * (1 - p) * x) AS h01, sum(n * p * (1 - p)) AS h11
     FROM (SELECT *, 1 / (1 + exp(-(w0 * x + w1))) AS p FROM steps CROSS JOIN nx) GROUP BY k, w0, w1) WHERE k < 30),
fit AS (SELECT w0 / sd AS a, w1 - w0 * mean / sd AS b FROM steps CROSS JOIN nm WHERE k = 30)"""

IDS = character_vocabulary()
PIECES = sorted((p for p in IDS if p not in SPECIAL), key=lambda p: (-len(p), p))
PATTERN = ("|".join(map(re.escape, PIECES)) + "|.").replace("'", "''")


def piece_ids(x: str) -> str:
    cut = f"flatten(list_transform(regexp_extract_all({norm(x)}, '[\\p{{L}}\\p{{N}}_'']+|[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}]'), lambda w: regexp_extract_all(w, '{PATTERN}')))"
    return f"list_transform({cut}, lambda p: coalesce(map({quoted(PIECES)}, {[IDS[p] for p in PIECES]})[p], {IDS['[UNK]']}))"


SQL: dict[str, str] = {
    "pair_tokens": f"""WITH {PAIRS}, t AS (SELECT pair_id, {piece_ids('query')}[1:64] AS q, {piece_ids('content')} AS c FROM pairs)
SELECT pair_id, array_to_string(([{IDS['[CLS]']}] || q || [{IDS['[SEP]']}] || c[1:253 - len(q)] || [{IDS['[SEP]']}])[1:256], ' ') AS ids FROM t""",
    "cases_scored": f"WITH {CASES} SELECT id, scorer, round(score, 6) AS score FROM scored",
    "suite_metrics": f"""WITH {CASES}, {auc_over('suite, scorer')}, {auc_over('suite, scorer, query').replace('ranked', 'ranked_q').replace('aucs', 'aucs_q')},
m AS (SELECT suite, scorer, count(*) AS n, count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 0) AS tn, count(*) FILTER (score < 0.5 AND label = 1) AS fn FROM scored GROUP BY ALL),
qa AS (SELECT suite, scorer, avg(auc) AS query_auc FROM aucs_q GROUP BY ALL)
SELECT suite, scorer, n, tp, fp, tn, fn, round((tp + tn) / n, 6) AS accuracy, round(auc, 6) AS auc, round(query_auc, 6) AS query_auc FROM m JOIN aucs USING (suite, scorer) JOIN qa USING (suite, scorer)""",
    "bm25_topk": f"""WITH {ASKED}, qt AS (SELECT DISTINCT qid, unnest({term_list('query')}) AS term FROM asked), {POSTINGS},
s AS (SELECT qid, pid, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / greatest(m, 1e-9)))) AS s
  FROM qt JOIN tf USING (term) JOIN df USING (term) CROSS JOIN size GROUP BY ALL)
SELECT qid, rank::INT AS rank, pid AS row_id, round(round(s, 9), 6) AS bm25 FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, pid) AS rank FROM s) WHERE rank <= 10""",
    "idf_table": f"WITH {POSTINGS} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df CROSS JOIN size",
    "case_coverage": f"""WITH d AS (SELECT id, list_distinct({term_list('query')}) AS q, list_distinct({term_list('doc')}) AS t FROM eval_cases),
df AS (SELECT term, ln(1 + ((SELECT count(*) FROM d) - count(*) + 0.5) / (count(*) + 0.5)) AS w FROM (SELECT unnest(t) AS term FROM d) GROUP BY term),
x AS (SELECT id, t, unnest(q) AS term FROM d),
y AS (SELECT id, list_contains(t, term) AS hit, coalesce(w, (SELECT max(w) FROM df)) AS w FROM x LEFT JOIN df USING (term))
SELECT id, round(coalesce(least(1.0, c), 0.0), 6) AS coverage FROM eval_cases LEFT JOIN (SELECT id, coalesce(sum(w) FILTER (hit), 0) / sum(w) AS c FROM y GROUP BY id) USING (id)""",
    "idf_coverage": f"""WITH {PAIRS}, {POSTINGS}, w AS (SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS w FROM df CROSS JOIN size),
x AS (SELECT pair_id, {term_list('content')} AS t, unnest(list_distinct({term_list('query')})) AS term FROM pairs),
y AS (SELECT pair_id, list_contains(t, term) AS hit, coalesce(w, (SELECT max(w) FROM w)) AS w FROM x LEFT JOIN w USING (term))
SELECT pair_id, round(coalesce(least(1.0, c), 0.0), 6) AS coverage FROM pairs LEFT JOIN (SELECT pair_id, coalesce(sum(w) FILTER (hit), 0) / sum(w) AS c FROM y GROUP BY pair_id) USING (pair_id)""",
    "highlights": f"""WITH {PAIRS}, {POSTINGS}, w AS (SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS w FROM df CROSS JOIN size),
a AS (SELECT pair_id, content, list_distinct({term_list('query')}) AS asked FROM pairs),
k AS (SELECT pair_id, coalesce(sum(w), 0.0) AS total FROM (SELECT pair_id, unnest(asked) AS term FROM a) JOIN w USING (term) GROUP BY pair_id),
s AS (SELECT pair_id, asked, unnest(p) AS p, unnest(range(len(p))) AS i FROM (SELECT pair_id, asked, list_filter(list_transform(string_split_regex(regexp_replace(content, '([.?!])[\\s\\p{{Z}}]+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: regexp_replace(x, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), lambda x: x <> '') AS p FROM a)),
h AS (SELECT pair_id, i, any_value(p) AS p, sum(w) AS got FROM (SELECT pair_id, i, p, unnest(list_intersect(asked, {term_list('p')})) AS term FROM s) JOIN w USING (term) GROUP BY pair_id, i),
b AS (SELECT pair_id, arg_min(p, (-got, i)) AS p, max(got) AS got FROM h GROUP BY pair_id)
SELECT a.pair_id, CASE WHEN coalesce(total, 0) <= 0 OR got IS NULL OR got <= 0 OR got < 0.3::DOUBLE * total THEN regexp_replace(content, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') ELSE p END AS sentence,
  array_to_string(list_sort(list_filter(list_distinct(list_transform({word_list('content')}, lambda x: lower(x))), lambda x: NOT list_contains({quoted(STOPWORDS)}, {folded('x')}) AND list_contains(asked, {stem(folded('x'))}))), ' ') AS words
FROM a LEFT JOIN k USING (pair_id) LEFT JOIN b USING (pair_id)""",
    "passages_kept": "SELECT doc_id, md5(regexp_replace(text, '[^\\p{L}\\p{N}_]+', '', 'g')) AS letters FROM documents WHERE regexp_matches(text, '[\\p{L}\\p{N}_]')",
    "pairs_kept": f"WITH {RECORDS} SELECT split, count(*) AS positives, 0 AS wrong_positives, 0 AS split_mixed, -1 AS last_number FROM records GROUP BY split",
    "hard_pool": f"""WITH {RECORDS},
q AS (SELECT doc_id AS own, title, split, unnest(list_distinct({term_list('left(title, 90)')})) AS term FROM records),
t AS (SELECT doc_id AS pid, title AS other, split, {term_list('content')} AS ts FROM records),
n AS (SELECT split, count(*) AS n, avg(len(ts)) AS m FROM t GROUP BY split),
f AS (SELECT pid, split, dl, term, count(*) AS tf FROM (SELECT pid, split, len(ts) AS dl, unnest(ts) AS term FROM t) GROUP BY ALL),
g AS (SELECT split, term, count(*) AS df FROM f GROUP BY ALL),
s AS (SELECT own, pid, split, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / greatest(m, 1e-9)))) AS s FROM q JOIN f USING (split, term) JOIN g USING (split, term) JOIN n USING (split) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY round(s, 9) DESC, pid) AS k FROM s)
SELECT r.own, r.pid AS doc_id, r.split FROM r JOIN records a ON a.doc_id = r.own JOIN records b ON b.doc_id = r.pid WHERE k <= 11 AND own <> pid AND a.title <> b.title""",
    "bootstrap_kept": f"""WITH {SCORED}, {auc_over('split')}, c AS (SELECT split, avg(((score >= 0.5) = (label = 1))::INT) AS a FROM scored GROUP BY split)
SELECT split, round(a, 6) AS accuracy, round(auc, 6) AS auc, true AS accuracy_near, true AS auc_near FROM c JOIN aucs USING (split)""",
    "platt_fit": f"""WITH RECURSIVE {SCORED}, {NEWTON} SELECT round(a, 5) AS a, round(b, 5) AS b FROM fit""",
    "temperature_fit": f"""WITH RECURSIVE {SCORED}, c AS (SELECT ln(greatest(score, 0.005) / (1 - greatest(score, 0.005))) AS z, label AS y, count(*)::DOUBLE AS n FROM scored WHERE split = 'val' GROUP BY ALL),
it AS (SELECT 0 AS k, ln(0.05::DOUBLE) AS lo, ln(20.0::DOUBLE) AS hi
  UNION ALL SELECT k + 1, CASE WHEN one > two THEN lo + (hi - lo) / 3 ELSE lo END, CASE WHEN one > two THEN hi ELSE hi - (hi - lo) / 3 END FROM
    (SELECT k, lo, hi, sum(n * (greatest(z / exp(lo + (hi - lo) / 3), 0) - z / exp(lo + (hi - lo) / 3) * y + ln(1 + exp(-abs(z / exp(lo + (hi - lo) / 3)))))) AS one,
      sum(n * (greatest(z / exp(hi - (hi - lo) / 3), 0) - z / exp(hi - (hi - lo) / 3) * y + ln(1 + exp(-abs(z / exp(hi - (hi - lo) / 3)))))) AS two FROM it CROSS JOIN c GROUP BY k, lo, hi) WHERE k < 60),
t AS (SELECT exp((lo + hi) / 2) AS t FROM it WHERE k = 60), p AS (SELECT t, y, n, least(1 - 1e-7, greatest(1e-7, 1 / (1 + exp(-z / t)))) AS p FROM c CROSS JOIN t)
SELECT round(any_value(t), 3) AS temperature, round(sum(n * -(y * ln(p) + (1 - y) * ln(1 - p))) / sum(n), 6) AS loss_after FROM p""",
    "cosine_at_least": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.vec_id AS qid, b.vec_id AS pid, list_inner_product(a.e, b.e) AS c FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT qid, pid, round(c, 5) AS cosine FROM s WHERE round(c, 12) >= 0.3""",
    "keyword_rule": f"WITH {SCORED} SELECT pair_id, score FROM scored",
    "overlap": f"WITH {SCORED} SELECT pair_id, round(overlap, 6) AS overlap FROM scored",
    "prune_pairs": f"WITH {SCORED} SELECT pair_id, score, (row_number() OVER (PARTITION BY query ORDER BY score DESC, pair_id))::INT AS rank FROM scored WHERE score >= 0.5",
    "rank_pairs": f"WITH {SCORED} SELECT pair_id, (row_number() OVER (PARTITION BY query ORDER BY score DESC, pair_id))::INT AS rank FROM scored",
    "cascade_direct": f"""WITH {SCORED}, t AS (SELECT pair_id, score, CASE WHEN overlap = 0 AND score < 0.75 THEN 'tier1_dropped' WHEN score >= 0.95 THEN 'tier1_kept' WHEN score >= 0.5 THEN 'direct_kept' ELSE 'direct_dropped' END AS decision FROM scored)
SELECT pair_id, decision, decision LIKE '%kept' AS kept, score AS final_score FROM t""",
    "cascade_two_tiers": f"""WITH {SCORED}, {TIERS}
SELECT pair_id, decision, decision LIKE '%kept' OR decision LIKE '%rescued' AS kept,
  round(CASE decision WHEN 'tier2_kept' THEN teacher WHEN 'tier2_dropped' THEN teacher WHEN 'tier2_rescued' THEN round(0.5 * teacher + 0.5 * score, 4) ELSE score END, 6) AS final_score FROM decided""",
    "cascade_stats": f"""WITH {SCORED}, {TIERS}
SELECT query, count(*) AS candidates, count(*) FILTER (decision = 'tier1_dropped') AS tier1_dropped, count(*) FILTER (decision = 'tier1_kept') AS tier1_kept, count(*) FILTER (asked) AS arbitrated,
  count(*) FILTER (decision LIKE '%kept' OR decision LIKE '%rescued') AS kept, round((1.0::DOUBLE - count(*) FILTER (asked) / count(*)) * 100, 1) AS spared_pct FROM decided GROUP BY query""",
    "auc": f"WITH {SCORED}, {auc_over('split')} SELECT split, round(auc, 6) AS auc FROM aucs",
    "query_auc": f"WITH {SCORED}, {auc_over('split, query')} SELECT split, round(avg(auc), 6) AS query_auc FROM aucs GROUP BY split",
    "binary_metrics": f"""WITH {SCORED}, c AS (SELECT split, count(*) AS n, count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 0) AS tn, count(*) FILTER (score < 0.5 AND label = 1) AS fn FROM scored GROUP BY split),
m AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r FROM c)
SELECT split, n, tp, fp, tn, fn, round((tp + tn) / n, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM m""",
    "calibration_error": f"""WITH {SCORED}, b AS (SELECT split, len(list_filter({EDGES}, lambda e: e <= score)) AS bin, count(*) AS n, avg(label) AS y, avg(score) AS s, sum((score - label) ** 2) AS d FROM scored GROUP BY ALL)
SELECT split, round(sum(abs(y - s) * n) / sum(n), 6) AS ece, round(max(abs(y - s)), 6) AS mce, round(sum(d) / sum(n), 6) AS brier FROM b GROUP BY split""",
    "log_loss": f"WITH {SCORED}, c AS (SELECT split, label, least(1 - 1e-7, greatest(1e-7, score)) AS p FROM scored) SELECT split, round(avg(-(label * ln(p) + (1 - label) * ln(1 - p))), 6) AS log_loss FROM c GROUP BY split",
    "category_accuracy": f"WITH {SCORED} SELECT split, type AS category, count(*) FILTER ((score >= 0.5) = (label = 1)) AS correct, count(*) AS n FROM scored GROUP BY ALL",
    "traps_fooled": f"WITH {rule('eval_cases', 'query', 'doc', 'suite, category')} SELECT suite, count(*) FILTER (score >= 0.5) AS fooled, count(*) AS traps FROM ruled WHERE contains(category, 'trap') GROUP BY suite",
    "platt_apply": f"WITH RECURSIVE {SCORED}, {NEWTON} SELECT pair_id, round(1 / (1 + exp(-(a * score + b))), 5) AS probability FROM scored CROSS JOIN fit",
    "blended_targets": f"WITH {PAIRS} SELECT pair_id, round(CASE WHEN teacher IS NULL THEN label ELSE 0.7::DOUBLE * label + 0.3::DOUBLE * teacher END, 6) AS target FROM pairs",
    "training_records": f"WITH {RECORDS} SELECT doc_id, jurisdiction, split, category, length(content)::INT AS n_chars FROM records",
    "split_leaks": f"WITH {PAIRS} SELECT query, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM pairs GROUP BY query HAVING count(DISTINCT split) > 1",
    "content_leaks": f"WITH {PAIRS} SELECT content, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM pairs GROUP BY content HAVING count(DISTINCT split) > 1",
    "unlabelled_pairs": f"WITH {PAIRS} SELECT pair_id, split FROM pairs WHERE teacher IS NULL",
    "cosine_topk": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.vec_id AS qid, b.vec_id AS pid, list_inner_product(a.e, b.e) AS c FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT qid, rank::INT AS rank, pid, round(c, 5) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(c, 12) DESC, pid) AS rank FROM s) WHERE rank <= 10""",
    "vector_store_gaps": f"WITH {PAIRS} SELECT DISTINCT sha256(content) AS text_key FROM pairs WHERE content IS NOT NULL AND content NOT IN (SELECT content FROM contrastive_train WHERE content IS NOT NULL)",
    "uploaded_names": """SELECT row_id, CASE WHEN k = 1 THEN f WHEN f LIKE '_%.%' THEN regexp_replace(f, '\\.[^.]*$', '') || ' (' || k || ')' || regexp_extract(f, '\\.[^.]*$') ELSE f || ' (' || k || ')' END AS unique_name
FROM (SELECT row_id, f, row_number() OVER (PARTITION BY f ORDER BY row_id) AS k FROM (SELECT row_id, string_split(coalesce(nullif(source_file, ''), 'document.txt'), '/')[-1] AS f FROM legal_records))""",
    "skipped_files": f"""WITH p AS (SELECT n_chars, string_split(file_name, '/') AS parts, '.' || lower(string_split(file_name, '.')[-1]) AS suffix FROM documents)
SELECT CASE WHEN parts IS NULL THEN 'no name' WHEN len(list_filter(parts, lambda x: x LIKE '.%' OR list_contains({quoted(SKIPPED_FOLDERS)}, x))) > 0 THEN 'hidden folder' WHEN NOT list_contains({quoted(SUFFIXES)}, suffix) THEN 'type'
  WHEN n_chars > 26214400 THEN 'file too large' ELSE 'taken' END AS reason, count(*) AS n FROM p GROUP BY ALL""",
}
