"""SQL for DuckDB that gives the rows of the pN_found queries, straight from the problems' definitions."""

from __future__ import annotations

import unicodedata

WORDS = "regexp_extract_all(strip_accents(lower(coalesce({0}, ''))), '[\\p{{L}}\\p{{N}}]+')"
SHINGLES = "list_distinct(list_transform(range(1, len({0}) - 1), lambda i: {0}[i] || ' ' || {0}[i + 1] || ' ' || {0}[i + 2]))"
PAIRS = "pairs AS (SELECT * FROM contrastive_train UNION ALL BY NAME SELECT * FROM contrastive_val UNION ALL BY NAME SELECT * FROM contrastive_test)"


def key(x: str) -> str:
    return f"nullif(trim(regexp_replace(lower({x}), '[\\s\\p{{Z}}]+', ' ', 'g')), '')"


# Letters drawn like the Latin letter below them, stated here apart from the operator's table.
DOUBLES = (
    ("АВЕКМНОРСТХЅІЈаеорсухѕіјһԁԛԝѵӏӀ", "ABEKMHOPCTXSIJaeopcyxsijhdqwvlI"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲ", "ABEZHIKMNOPTYXoc"),
    ("սօհոɡɑ‐‑", "uohnga--"),
)
ACCENTS = "\u0300\u0301\u0302\u0303\u0306\u0308\u030c\u0342"
#: Code points that stand for ordinary characters: digraphs, long s, dots, letter-like signs, Roman numerals, ligatures, full width.
STAND_INS = (*range(0x132, 0x134), *range(0x13F, 0x141), 0x149, 0x17F, *range(0x1C4, 0x1CD), *range(0x2024, 0x2027), 0x2126, 0x212A, 0x212B, *range(0x2160, 0x2180), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F))


def _same_look() -> str:
    """What ``text`` looks like, by replacements in SQL: one value for texts that look the same."""
    quote = lambda x: x.replace("'", "''")
    single, several = {}, {}
    for own, latin in (pair for pairs in DOUBLES for pair in zip(*pairs, strict=True)):
        single[own] = latin
        for accent in ACCENTS:
            a, b = unicodedata.normalize("NFC", own + accent), unicodedata.normalize("NFC", latin + accent)
            if len(a) == len(b) == 1:
                single[a] = b
    for ch in map(chr, STAND_INS):
        plain = unicodedata.normalize("NFKC", ch)
        (single if len(plain) == 1 else several)[ch] = plain
    out = "regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[\\p{Cf}\\x{34F}\\x{FE00}-\\x{FE0F}\\x00-\\x08\\x0E-\\x1B\\x7F-\\x84\\x86-\\x9F]', '', 'g')"
    out = f"regexp_replace({out}, '\\p{{Zs}}', ' ', 'g')"
    for a, b in several.items():
        out = f"replace({out}, '{a}', '{b}')"
    letters, plain = "".join(single), "".join(single.values())
    return f"nfc_normalize(translate(nfc_normalize({out}), '{letters}', '{quote(plain)}'))"


SQL: dict[str, str] = {
    "p1_found": """WITH o AS (SELECT row_id, content FROM legal_records WHERE length(content) > 500),
s AS (SELECT row_id, list_max(list_transform(string_split_regex(regexp_replace(content, '([.?!])\\s+', '\\1' || chr(10), 'g'), '[\\r\\n]'), lambda x: length(trim(x, ' ' || chr(9))))) AS longest FROM o)
SELECT row_id, 'oversized' AS kind FROM s UNION ALL SELECT row_id, 'unbroken' FROM s WHERE longest > 500""",
    "p1_kept": """WITH s AS (SELECT row_id, content, list_max(list_transform(string_split_regex(regexp_replace(content, '([.?!])\\s+', '\\1' || chr(10), 'g'), '[\\r\\n]'), lambda x: length(trim(x, ' ' || chr(9))))) AS longest FROM legal_records WHERE content IS NOT NULL)
SELECT row_id, length(content)::INT AS n_chars, true AS whole, true AS within, length(content) > 500 AND longest > 500 AS forced FROM s""",
    "p2_found": f"""WITH r AS (SELECT row_id, {WORDS.format('content')} AS w FROM legal_records),
c AS (SELECT id, {WORDS.format('doc')} AS d, {WORDS.format('query')} AS q FROM eval_cases),
rw AS (SELECT DISTINCT row_id, array_to_string(w[i:i + 9], ' ') AS x FROM (SELECT row_id, w, unnest(range(1, len(w) - 8)) AS i FROM r)),
cw AS (SELECT DISTINCT id, array_to_string(d[i:i + 9], ' ') AS x FROM (SELECT id, d, unnest(range(1, len(d) - 8)) AS i FROM c)),
rt AS (SELECT row_id, ' ' || array_to_string(w, ' ') || ' ' AS t FROM r)
SELECT row_id, id AS case_id FROM rw JOIN cw USING (x) UNION SELECT row_id, id FROM rt JOIN c ON len(q) > 0 AND contains(t, ' ' || array_to_string(q, ' ') || ' ')""",
    "p3_found": f"""WITH {PAIRS}, t AS (SELECT pair_id, split = 'train' AS train, {WORDS.format('content')} AS c, {WORDS.format('query')} AS q FROM pairs),
d AS (SELECT c, row_number() OVER () AS k, bool_or(train) AS a, bool_or(NOT train) AS b FROM t GROUP BY c HAVING len(c) >= 3),
s AS (SELECT k, a, b, {SHINGLES.format('c')} AS s FROM d), e AS (SELECT k, a, b, len(s) AS n, unnest(s) AS x FROM s),
m AS (SELECT l.k AS k1, r.k AS k2 FROM e l JOIN e r ON l.x = r.x AND l.b AND r.a GROUP BY l.k, r.k, l.n, r.n HAVING count(*) >= 0.6 * (l.n + r.n - count(*)) - 1e-9),
f AS (SELECT x.pair_id AS p, y.pair_id AS o, 'content' AS field FROM m JOIN d d1 ON d1.k = k1 JOIN d d2 ON d2.k = k2 JOIN t x ON x.c = d1.c AND NOT x.train JOIN t y ON y.c = d2.c AND y.train
  UNION ALL SELECT x.pair_id, y.pair_id, 'query' FROM t x JOIN t y ON x.q = y.q AND len(x.q) > 0 AND NOT x.train AND y.train)
SELECT least(p, o) AS pair_id_a, greatest(p, o) AS pair_id_b, field FROM f""",
    "p3_report": f"""WITH {PAIRS}, t AS (SELECT pair_id, split AS part, {key('doc_id')} AS doc, {WORDS.format('content')} AS c, {WORDS.format('query')} AS q FROM pairs),
d AS (SELECT c, row_number() OVER () AS k, bool_or(part = 'train') AS a, bool_or(part <> 'train') AS b FROM t GROUP BY c HAVING len(c) >= 3),
s AS (SELECT k, a, b, {SHINGLES.format('c')} AS s FROM d), e AS (SELECT k, a, b, len(s) AS n, unnest(s) AS x FROM s),
m AS (SELECT k1 AS k, max(sim) AS sim FROM (SELECT l.k AS k1, count(*) / (l.n + r.n - count(*)) AS sim FROM e l JOIN e r ON l.x = r.x AND l.b AND r.a GROUP BY l.k, r.k, l.n, r.n) WHERE sim >= 0.6 - 1e-9 GROUP BY k1),
p AS (SELECT k, c, unnest(range(1, len(c) - 1)) AS i FROM d WHERE b),
h AS (SELECT k, i FROM p WHERE c[i] || ' ' || c[i + 1] || ' ' || c[i + 2] IN (SELECT x FROM e WHERE a)),
v AS (SELECT k, count(DISTINCT i + o) AS covered FROM h CROSS JOIN (SELECT unnest([0, 1, 2]) AS o) GROUP BY k),
j AS (SELECT {key('doc_id')} AS doc, arg_min({key('jurisdiction')}, row_id) AS jurisdiction FROM legal_records WHERE {key('doc_id')} IS NOT NULL AND {key('jurisdiction')} IS NOT NULL GROUP BY 1),
r AS (SELECT part, 'content' AS field, doc, len(t.c) AS words, sim, coalesce(covered, 0) AS covered FROM t LEFT JOIN d ON t.c = d.c LEFT JOIN m USING (k) LEFT JOIN v USING (k) WHERE part <> 'train' AND len(t.c) > 0
  UNION ALL SELECT part, 'query', doc, len(q), CASE WHEN q IN (SELECT q FROM t WHERE part = 'train') THEN 1.0 END, CASE WHEN q IN (SELECT q FROM t WHERE part = 'train') THEN len(q) ELSE 0 END FROM t WHERE part <> 'train' AND len(q) > 0)
SELECT part AS split, field, coalesce(jurisdiction, 'unknown') AS jurisdiction, count(*) AS rows, count(sim) AS overlapping, count(*) FILTER (sim >= 1) AS equal, sum(words)::BIGINT AS words, sum(covered)::BIGINT AS covered_words FROM r LEFT JOIN j USING (doc) GROUP BY 1, 2, 3""",
    "p4_groups": f"""WITH RECURSIVE t AS (SELECT row_id, {WORDS.format("coalesce(title || ' ', '') || content")} AS w FROM legal_records WHERE regexp_matches(content, '\\S')),
s AS (SELECT row_id, list_sort({SHINGLES.format('w')}) AS s FROM t WHERE len(w) >= 25), c AS (SELECT row_id, s, min(row_id) OVER (PARTITION BY s) AS rep FROM s),
e AS (SELECT row_id, len(s) AS n, unnest(s) AS x FROM c WHERE row_id = rep),
m AS (SELECT l.row_id AS a, r.row_id AS b FROM e l JOIN e r ON l.x = r.x AND l.row_id <> r.row_id GROUP BY l.row_id, r.row_id, l.n, r.n HAVING count(*) >= 0.6 * (l.n + r.n - count(*)) - 1e-9),
reach AS (SELECT rep AS x, rep AS y FROM c WHERE row_id = rep UNION SELECT reach.x, m.b FROM reach JOIN m ON reach.y = m.a),
g AS (SELECT x AS rep, min(y) AS group_row FROM reach GROUP BY x), k AS (SELECT a AS rep, count(*) AS links FROM m GROUP BY a)
SELECT row_id, rep AS class_row, group_row, coalesce(links, 0) AS links FROM c JOIN g USING (rep) LEFT JOIN k USING (rep)""",
    "p4_found": f"""WITH t AS (SELECT row_id, {WORDS.format("coalesce(title || ' ', '') || content")} AS w FROM legal_records WHERE regexp_matches(content, '\\S')),
s AS (SELECT row_id, {SHINGLES.format('w')} AS s FROM t WHERE len(w) >= 25), e AS (SELECT row_id, len(s) AS n, unnest(s) AS x FROM s)
SELECT l.row_id AS row_id_a, r.row_id AS row_id_b FROM e l JOIN e r ON l.x = r.x AND l.row_id < r.row_id GROUP BY l.row_id, r.row_id, l.n, r.n HAVING count(*) >= 0.6 * (l.n + r.n - count(*)) - 1e-9""",
    "p5_found": f"""WITH RECURSIVE k AS (SELECT row_id, {key('jurisdiction')} AS j, {key('doc_id')} AS d FROM legal_records),
e AS (SELECT DISTINCT a.j AS x, b.j AS y FROM k a JOIN k b ON a.d = b.d AND a.j IS NOT NULL AND b.j IS NOT NULL),
reach AS (SELECT DISTINCT j AS x, j AS y FROM k WHERE j IS NOT NULL UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x),
g AS (SELECT x AS j, min(y) AS g, count(*) AS n FROM reach GROUP BY x),
dj AS (SELECT d, min(j) AS dj FROM k WHERE d IS NOT NULL GROUP BY d),
m AS (SELECT row_id, g, n FROM k LEFT JOIN dj ON k.d = dj.d JOIN g ON g.j = coalesce(k.j, dj.dj))
SELECT row_id, min(row_id) OVER (PARTITION BY g) AS group_row FROM m WHERE n > 1""",
    "p5_kept": """SELECT split_name AS split, share, true AS near, 0 AS torn_courts, 0 AS torn_documents, (SELECT count(*) FROM legal_records) AS all_records FROM split_targets""",
    "p6_kept": """SELECT profile, capacity_tokens::BIGINT AS capacity, (SELECT count(*) FROM documents) AS documents, 0 AS not_whole, 0 AS cut_in_vain, 0 AS too_full, true AS well_filled FROM pack_limits""",
    "p7_kept": """SELECT source, target_share, max_repeats, true AS within_repeats, true AS near_budget FROM mix_targets""",
    "p8_found": f"""WITH s AS (SELECT doc_id, text, {_same_look()} AS f FROM documents WHERE text <> '')
SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM s a JOIN s b ON a.f = b.f AND a.doc_id < b.doc_id AND a.text <> b.text""",
    "p8_classes": f"""SELECT doc_id, min(doc_id) OVER (PARTITION BY {_same_look()}) AS class_doc FROM documents WHERE text <> ''""",
}
