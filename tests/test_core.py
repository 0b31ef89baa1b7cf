import base64
import io
import math
import random
import re
import unicodedata
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.functions import text as T
from lexispark.operators import calibration, metrics, retrieval, training_pairs
from lexispark.operators.lexical import Bm25, coverage, term_stats
from lexispark.operators.passages import split_passages
from lexispark.operators.scoring import ambiguous, decide, decision_stats, keyword_score, overlap_share, prune
from lexispark.operators.search import best_sentence, drop_repeated, matching_words, search
from lexispark.operators.training_pairs import build_pairs, clean_records, hard_negatives, random_negatives, shared_between_splits, unlabelled
from lexispark.operators import vectors as vectors_module
from lexispark.operators.vectors import at_least, embed, embed_cached, missing, nearest, pool, retained
from lexispark.plans.evaluation import as_markdown, suite_report
from lexispark.sources import files


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], "i int, a string" + ", b string" * isinstance(values[0], tuple))
    return [r.x for r in rows.select("i", expression.alias("x")).orderBy("i").collect()]


def test_folding_and_stems(spark):
    words = ["Indemnité", "ŒUVRE", "été", "ÀÉÎÕÜ", "été", None, "ﬁn", "ＡＢ"]
    fold = lambda t: t and "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c))
    assert column(spark, words, T.fold_accents(F.col("a"))) == [fold(w) for w in words]
    assert column(spark, ["licenciement", "licences", "bail", "baux", "contrat42x", "demande", "xs"], T.light_stem(F.col("a"))) == ["licenci", "licenc", "bail", "baux", "contrat42x", "demand", "xs"]
    assert column(spark, ["Le préavis de démission du salarié, pas de _ 2", "", None], T.terms(F.col("a"))) == [["preavi", "demissi", "salari", "pas", "2"], [], []]


def test_rule_stem_and_split(spark):
    assert column(spark, ["politiques", "aimables", "classes", "es", "tables"], T.rule_stem(F.col("a"))) == ["polit", "aim", "class", "", "tabl"]
    assert set(column(spark, [f"title {k}" for k in range(60)], T.split_of(F.col("a")))) == {"train", "val", "test"}
    assert column(spark, ["see http://a.b/c now   \t x"], T.clean_text(F.col("a"))) == ["see now x"]
    assert column(spark, [("Faculté de droit", "x"), ("Cour", "impôt et impots, divorce"), ("Cour", "impot divorce"), (None, None)], T.weak_category(F.col("a"), F.lit("t"), F.col("b"))) == [0, 1, -100, -100]


def brute_bm25(docs, query, terms):
    tokens = {k: terms[v] for k, v in docs.items()}
    n, mean = len(docs), sum(map(len, tokens.values())) / len(docs)
    out = {}
    for t in set(terms[query]):
        df = sum(t in x for x in tokens.values())
        for k, x in tokens.items():
            if tf := x.count(t):
                out[k] = out.get(k, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / mean))
    return out


def test_bm25_against_brute_force(spark):
    docs = {1: "Le préavis de démission du salarié est de trois mois", 2: "Le salarié respecte un préavis préavis", 3: "Vaccination contre la rougeole", 4: "", 5: None, 6: "Le salarié respecte un préavis préavis"}
    frame = spark.createDataFrame(list(docs.items()), "pid long, text string")
    queries = spark.createDataFrame([("q1", "préavis de démission, préavis"), ("q2", "grippe aviaire"), ("q3", None)], "qid string, query string")
    texts = [*{str(v or "") for v in docs.values()}, "préavis de démission, préavis"]
    terms = dict(zip(texts, column(spark, texts, T.terms(F.col("a"))), strict=True))
    got = {r.pid: r.bm25 for r in Bm25(frame, "pid", "text").scores(queries, "qid", "query").collect()}
    expected = brute_bm25({k: v or "" for k, v in docs.items()}, "préavis de démission, préavis", terms)
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in got)
    assert [r.pid for r in Bm25(frame, "pid", "text").top(queries, "qid", "query", 3).orderBy("rank").collect()] == [1, 2, 6]
    assert Bm25(frame.limit(0), "pid", "text").top(queries, "qid", "query", 3).count() == 0


def test_coverage(spark):
    docs = spark.createDataFrame([("contrat de travail",), ("bail commercial",), ("contrat de bail",)], "doc string")
    pairs = spark.createDataFrame([(1, "bail commercial", "bail commercial"), (2, "bail", "contrat"), (3, "bail commercial", "contrat de bail"), (4, "de la", "x"), (5, None, None)], "i int, q string, d string")
    got = {r.i: r.coverage for r in coverage(pairs, "q", "d", term_stats(docs, "doc")).collect()}
    assert got[1] == 1.0 and got[2] == got[4] == got[5] == 0.0 and 0 < got[3] < 0.5
    assert {r.i: r.coverage for r in coverage(pairs, "q", "d").collect()}[3] == 0.5


def test_keyword_rule(spark):
    cases = [("allergie pénicilline", "Aucune allergie à la pénicilline"), ("allergie pénicilline", "allergie pénicilline notée"), ("", "x"), ("chat", "chien"), ("bail contrat rupture", "le bail"), (None, None), ("délai appel", "délai")]
    assert column(spark, cases, keyword_score(F.col("a"), F.col("b"))) == [0.8075, 0.99, 0.0, 0.005, 0.2, 0.0, 0.52]
    assert column(spark, [("le bail commercial", "Bail de commerce"), ("le la", "x"), ("bail", None)], overlap_share(F.col("a"), F.col("b"))) == [1.0, 0.0, 0.0]


def test_decisions(spark):
    rows = [(1, 0.0, 0.5, 0.9), (2, 0.5, 0.96, None), (3, 0.5, 0.8, 0.6), (4, 0.3, 0.8, 0.3), (5, 0.3, 0.6, 0.3), (6, 0.3, 0.6, None), (7, 0.3, 0.4, None), (8, 0.3, 0.8, 0.1), (9, 0.0, 0.8, 0.7)]
    pairs = spark.createDataFrame([("q", *r) for r in rows], "query string, i int, overlap double, score double, teacher double")
    decided = decide(pairs, tier2="teacher")
    got = {r.i: (r.decision, r.final_score) for r in decided.collect()}
    assert got == {1: ("tier1_dropped", 0.5), 2: ("tier1_kept", 0.96), 3: ("tier2_kept", 0.6), 4: ("tier2_rescued", 0.55), 5: ("tier2_dropped", 0.3), 6: ("fallback_kept", 0.6), 7: ("fallback_dropped", 0.4), 8: ("tier2_dropped", 0.1), 9: ("tier2_kept", 0.7)}
    assert ambiguous(pairs).count() == 7
    s = decision_stats(decided).first()
    assert (s.candidates, s.tier1_dropped, s.tier1_kept, s.arbitrated, s.kept, s.spared_pct) == (9, 1, 1, 7, 5, 22.2)
    assert {r.decision for r in decide(pairs).where("i in (3, 7)").collect()} == {"direct_kept", "direct_dropped"}
    assert [r.i for r in prune(pairs, 0.8, "query", "score", "i").orderBy("rank").collect()] == [2, 3, 4, 8, 9]


@pytest.mark.parametrize("labels, scores, expected", [([0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9], 1.0), ([1, 1, 0, 0], [0.1, 0.2, 0.8, 0.9], 0.0), ([0, 1], [0.5, 0.5], 0.5), ([0, 1, 0, 1], [0.1, 0.4, 0.5, 0.8], 0.75), ([1, 1], [0.2, 0.3], None)])
def test_auc(spark, labels, scores, expected):
    rows = spark.createDataFrame([("g", y, s) for y, s in zip(labels, scores, strict=True)], "g string, label int, score double")
    assert metrics.roc_auc(rows, ["g"]).first().auc == expected


def test_auc_of_many_scores(spark):
    rng = random.Random(9)
    rows = [(k % 2, rng.randrange(2), rng.choice([rng.gauss(0, 30), rng.random(), 0.0, -0.0, rng.randrange(-3, 3)]) * 1.0) for k in range(600)] + [(0, 1, None), (0, None, 1.0)]
    got = {r.g: r.auc for r in metrics.roc_auc(spark.createDataFrame(rows, "g int, label int, score double"), ["g"]).collect()}
    for g in (0, 1):
        side = [[s for h, y, s in rows if h == g and y == label and s is not None] for label in (1, 0)]
        won = sum((a > b) + (a == b) / 2 for a in side[0] for b in side[1])
        assert abs(got[g] - won / (len(side[0]) * len(side[1]))) < 1e-9


def test_bootstrap_and_report(spark):
    rng = random.Random(4)
    rows = [("g", f"q{k % 40}", y := rng.randrange(2), min(1.0, max(0.0, rng.gauss(0.4 + 0.2 * y, 0.2)))) for k in range(2000)]
    frame = spark.createDataFrame(rows, "g string, q string, label int, score double")
    r = metrics.report(frame, ["g"], "q", resamples=300).first()
    assert r.auc_low < r.auc < r.auc_high < r.auc_low + 0.06 and r.accuracy_low < r.accuracy < r.accuracy_high
    ranking = metrics.report(frame.withColumn("score", F.col("score") * 7), ["g"], "q", None)
    assert ranking.columns == ["g", "n", "auc", "query_auc"] and abs(ranking.first().auc - r.auc) < 1e-9
    one = metrics.bootstrap_auc(frame.where("label = 1"), ["g"], 5).first()
    none = metrics.bootstrap_auc(frame.withColumn("score", F.lit(None).cast("double")), ["g"], 5).first()
    assert (one.auc, one.low, one.high) == (none.auc, none.low, none.high) == (None, None, None) and metrics.bootstrap_auc(frame.limit(0), ["g"]).count() == 0


def test_labelling_run(spark):
    rows = spark.createDataFrame([("p1", "q", "c", None), ("p2", "q", "cc", 0.5), ("p3", "bad", "c", None), ("p4", None, None, None)], "pair_id string, query string, content string, teacher double")

    def scorer(query, contents):
        if query == "bad":
            raise RuntimeError
        return [len(c or "") / 3 for c in contents]

    found = training_pairs.label_pairs(rows, rows.where("teacher is not null"), scorer)
    assert {r.pair_id: r.teacher for r in found.collect()} == {"p1": 0.3333, "p4": 0.0}
    assert training_pairs.label_pairs(rows, found, scorer, most=1).count() == 1


def test_search_over_given_candidates(spark):
    from lexispark.operators.passages import passages
    from lexispark.operators.search import SearchSettings

    found = passages(spark.createDataFrame([(1, "Un bail."), (2, "Une vente."), (3, "Un prêt.")], "id int, text string"), "id", F.col("text"))
    queries = spark.createDataFrame([("a", "location " * 400)], "qid string, query string")
    given = spark.createDataFrame([("a", "1#0", 0.9), ("a", "2#0", 0.3), ("a", "3#0", 0.1)], "qid string, pid string, score double")
    rows = search(queries, "qid", "query", found, SearchSettings(top_k=900), candidates=given).collect()
    assert {(r.passage_id, r.kind) for r in rows} == {("1#0", "match"), ("2#0", "near")}
    s = SearchSettings(threshold=7, top_k=900).clamped()
    assert (s.threshold, s.top_k) == (1.0, 50) and SearchSettings(threshold=-1, top_k=0).clamped().top_k == 1


def test_metrics(spark):
    rows = spark.createDataFrame([("a", "c", 1, 0.9), ("a", "trap", 1, 0.2), ("b", "trap", 0, 0.6), ("b", "c", 0, 0.1)], "q string, category string, label int, score double").withColumn("g", F.lit(1))
    m = metrics.binary_metrics(rows, ["g"]).first()
    assert (m.tp, m.fn, m.fp, m.tn, m.accuracy, m.precision, m.recall, m.f1) == (1, 1, 1, 1, 0.5, 0.5, 0.5, 0.5)
    assert metrics.query_auc(rows, ["g"], "q").first().query_auc is None
    c = metrics.calibration_error(spark.createDataFrame([(1, y, s) for y, s in ((1, 0.9), (1, 0.8), (0, 0.2), (0, 0.1), (1, 0.3))], "g int, label int, score double"), ["g"]).first()
    assert abs(c.ece - 0.18) < 1e-9 and abs(c.mce - 0.25) < 1e-9  # 0.3 lies in the third bin
    b = metrics.bootstrap_accuracy(rows, ["g"]).first()
    assert 0 <= b.low <= 0.5 <= b.high <= 1
    t = metrics.traps_fooled(rows, ["g"], "category").first()
    assert (t.fooled, t.traps) == (1, 2)


def test_fits(spark):
    rows = spark.createDataFrame([(y, s) for y, s in ((0, 0.1), (0, 0.2), (0, 0.3), (1, 0.7), (1, 0.8), (1, 0.9))], "label int, score double")
    a, b = calibration.fit_platt(rows)
    p = [1 / (1 + math.exp(-(a * s + b))) for s in (0.1, 0.9)]
    assert a > 0 and math.isfinite(b) and p[0] < 0.5 < p[1]
    with pytest.raises(ValueError):
        calibration.fit_platt(rows.where("label = 1"))
    import random

    rng = random.Random(1)
    logits = [rng.gauss(0, 3) for _ in range(4000)]
    frame = spark.createDataFrame([(int(rng.random() < 1 / (1 + math.exp(-z / 2))), z) for z in logits], "label int, logit double")
    assert abs(calibration.fit_temperature(frame) - 2) < 0.25
    assert calibration.fit_temperature(frame.limit(0)) == 1.0


def test_passages():
    found = split_passages("Titre\n\nPremier paragraphe.\nSuite du paragraphe.\n\n---\n\nDernier.", 493, 100)
    assert [(p.body, p.first, p.last) for p in found] == [("Titre", 1, 1), ("Premier paragraphe.\nSuite du paragraphe.", 3, 4), ("Dernier.", 8, 8)]
    long = " ".join(f"Phrase numéro {k} du texte." for k in range(60))
    found = split_passages(long, 200, 60)
    assert all(len(p.body) <= 260 for p in found) and found[0].shared == 0 and all(p.shared for p in found[1:])
    for a, b in zip(found, found[1:], strict=False):
        assert a.body.endswith(b.body[: b.shared])
    assert {s for s in re.split(r"(?<=\.) ", long)} == {s for p in found for s in re.split(r"(?<=\.) ", p.body)}
    assert split_passages("x" * 500, 100, 20)[0].body == "x" * 100 and split_passages("", 100, 20) == []


def brute_passages(text, budget, overlap):
    """The rule, unit by unit: fill up to the budget, then go on with the last units that fit into the overlap."""
    out, lines, k = [], text.splitlines(), 0
    while k < len(lines):
        first = k
        while k < len(lines) and lines[k].strip():
            k += 1
        block = "\n".join(lines[first:k]).strip()
        k += k == first
        if not re.search(r"\w", block):
            continue
        if len(block) <= budget:
            out.append((block, first + 1, first + 1 + "\n".join(lines[first : first + block.count("\n") + 1]).count("\n"), 0))
            continue
        parts = []
        for n, line in enumerate(block.split("\n"), first + 1):
            for unit in re.split(r"(?<=[.?!])\s", line):
                unit = unit.strip()
                while unit:
                    space = max((i for i, c in enumerate(unit[:budget]) if c == " " and i > budget // 2), default=budget)
                    piece, unit = (unit, "") if len(unit) <= budget else (unit[:space].strip(), unit[space:].strip())
                    parts.append((n, piece))
        size = lambda ps: sum(len(p) + 1 for _, p in ps)
        text_of = lambda ps: "".join(("" if not i else " " if ps[i - 1][0] == n else "\n") + p for i, (n, p) in enumerate(ps))
        run, shared = [], 0
        for part in parts:
            if run and size(run) + len(part[1]) > budget:
                out.append((text_of(run), run[0][0], run[-1][0], shared))
                run = next(run[i:] for i in range(1, len(run) + 1) if size(run[i:]) - 1 <= overlap)
                shared = len(text_of(run))
            run = [*run, part]
        out.append((text_of(run), run[0][0], run[-1][0], shared))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_passages_against_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(1500):
        text = "".join(rng.choice(["a", "bb", " ", "\n", ". ", "! ", "\n\n", "x" * 30, ".", "?\n", "mot "]) for _ in range(rng.randint(0, 80)))
        budget, overlap = rng.choice([50, 60]), rng.choice([0, 10, 20])
        assert [(p.body, p.first, p.last, p.shared) for p in split_passages(text, budget, overlap)] == brute_passages(text, budget, overlap)


def brute_shown(ranked):
    shown, by = set(), {(r["doc"], r["passage_no"]): r for r in ranked}
    for r in sorted(ranked, key=lambda r: r["rank"]):
        before, after = (r["doc"], r["passage_no"] - 1), (r["doc"], r["passage_no"] + 1)
        n = max(1, len(r["body"]))
        if not (before in shown and 2 * r["shared_prev"] > n) and not (after in shown and 2 * by[after]["shared_prev"] > n):
            shown.add((r["doc"], r["passage_no"]))
    return shown


def test_repeated_neighbours_against_brute_force(spark):
    import random

    rng = random.Random(3)
    ranked = []
    for q in range(20):
        places = [(d, k) for d in range(2) for k in range(8)]
        rng.shuffle(places)
        ranked += [{"qid": q, "doc": d, "passage_no": k, "rank": n, "body": "x" * rng.randint(1, 10), "shared_prev": rng.randint(0, 8)} for n, (d, k) in enumerate(places[:12], 1)]
    frame = spark.createDataFrame(ranked, "qid int, doc int, passage_no int, rank int, body string, shared_prev int")
    got = {(r.qid, r.doc, r.passage_no) for r in drop_repeated(frame).collect()}
    assert got == {(q, *p) for q in range(20) for p in brute_shown([r for r in ranked if r["qid"] == q])}


def test_search_and_highlights(spark):
    from lexispark.operators.passages import passages

    docs = spark.createDataFrame([(1, "dupont.md", "Allergie connue à la pénicilline. Suivi annuel."), (2, "martin.md", "Fracture du poignet. Aucune allergie."), (3, "vide.md", None)], "id int, name string, text string")
    found = passages(docs, "id", F.col("text"), F.col("name"))
    queries = spark.createDataFrame([("a", "Allergie pénicilline"), ("b", "xylophone quantique"), ("c", "  ")], "qid string, query string")
    rows = search(queries, "qid", "query", found).orderBy("qid", "kind", "place").collect()
    assert {r.qid for r in rows} == {"a"} and rows[0].doc == 1 and rows[0].highlight == "Allergie connue à la pénicilline."
    assert rows[0].highlight_terms == ["allergie", "pénicilline"]
    weights = F.create_map(F.lit("bail"), F.lit(2.0), F.lit("loyer"), F.lit(1.0))
    asked = F.array(F.lit("bail"), F.lit("loyer"))
    assert column(spark, ["Un loyer. Un bail ! Fin.", "Rien ici."], best_sentence(F.col("a"), asked, weights)) == ["Un bail !", "Rien ici."]
    assert column(spark, ["Baux, bail, LOYERS et loyer"], matching_words(F.col("a"), asked)) == [["bail", "loyer", "loyers"]]


def test_training_pairs(spark):
    rows = [(k, f"Cour {k % 3}", f"Titre numéro {k // 2} affaire {k // 2}", f"Le contrat numéro {k} prévoit un préavis de démission et une indemnité de licenciement du salarié.") for k in range(60)]
    records = clean_records(spark.createDataFrame(rows, "i int, jurisdiction string, title string, content string"), "i").persist()
    assert records.count() == 60
    pairs = build_pairs(records).collect()
    assert pairs and len({p.pair_id for p in pairs}) == len(pairs) and {p.type for p in pairs} == {"positive", "hard_negative", "random_negative"}
    for split in {p.split for p in pairs}:
        mine = sorted(p.pair_id for p in pairs if p.split == split)
        assert mine == [f"{split}-{k:08d}" for k in range(len(mine))]
    title = {r.doc_id: (r.title, r.split) for r in records.collect()}
    for p in pairs:
        assert title[p.doc_id][1] == p.split
        assert (title[p.doc_id][0][:90] == p.query) == (p.type == "positive")
    frame = spark.createDataFrame(pairs)
    assert shared_between_splits(frame).count() == 0
    assert unlabelled(frame, frame.where("label = 1"), most=5).count() == 5
    assert build_pairs(records.limit(0)).count() == 0


def test_pairs_are_numbered_without_their_contents(spark, monkeypatch):
    rows = [(f"d{k:02d}", ("train", "val")[k % 3 == 0], f"cour {k % 2}", f"bail {k}", f"bail résilié numéro {k}", k % 4) for k in range(24)]
    records = spark.createDataFrame(rows, "doc_id string, split string, jurisdiction string, title string, content string, category int")
    write, columns = training_pairs.written, {}
    monkeypatch.setattr(training_pairs, "written", lambda df, name: columns.update({name: df.columns}) or write(df, name))
    pairs = build_pairs(records)
    assert "content" not in columns["pairs"] and "content" not in columns["queries"]
    assert pairs.columns == ["split", "query", "content", "label", "type", "category", "doc_id", "pair_id"]
    held = {r[0]: (r[1], r[4], r[5]) for r in rows}
    got = pairs.collect()
    assert len(got) == 72 and all(held[p.doc_id] == (p.split, p.content, p.category) for p in got)
    assert sorted(p.pair_id for p in got if p.split == "val") == [f"val-{k:08d}" for k in range(24)]


def test_queries_of_frequent_terms_get_a_hard_negative(spark):
    rows = [(f"d{k:03d}", "train", f"bail {k}", "bail commercial résilié " * (1 + k % 7), "cour") for k in range(90)]
    records = spark.createDataFrame(rows, "doc_id string, split string, title string, content string, jurisdiction string")
    asked = records.withColumn("query", F.lit("bail résilié"))
    found = hard_negatives(asked, records, common=5, champions=12).collect()
    assert {r.own for r in found} == {r[0] for r in rows} and len(found) == 90 and all(r.own != r.doc_id for r in found)
    whole = hard_negatives(asked, records, common=1000).collect()
    assert len(whole) == 90


def test_hard_negatives_count_every_posting_of_frequent_terms(spark, monkeypatch):
    rng = random.Random(3)
    common, rare = [f"bail{k}x" for k in range(6)], [f"mot{k}x" for k in range(80)]
    rows = [(f"d{k:03d}", ("train", "val")[k % 4 == 0], f"titre {k}", " ".join(rng.choices(common, k=rng.randrange(3, 20)) + rng.choices(rare, k=rng.randrange(4)))) for k in range(700)]
    records = spark.createDataFrame(rows, "doc_id string, split string, title string, content string")
    texts = [" ".join([*rng.sample(common, rng.randrange(1, 6)), *rng.sample(rare, rng.randrange(3))]) for _ in range(60)]
    asked = spark.createDataFrame([(rows[k][0], rows[k][1], rows[k][2], texts[k]) for k in range(60)], "doc_id string, split string, title string, query string")
    expected = {}
    for k, query in enumerate(texts):
        docs = {r[0]: r[3] for r in rows if r[1] == rows[k][1]}
        scores = brute_bm25(docs, query, {t: t.split() for t in (query, *docs.values())})
        ranked = sorted(scores, key=lambda p: (-round(scores[p], 9), p))[:11]
        expected[query, rows[k][0]] = {p for p in ranked if p != rows[k][0]}
    assert min(sum(w in r[3].split() for r in rows if r[1] == "train") for w in common) > 200  # the limit that was
    whole = training_pairs.best_records
    for size in (65_536, 90):  # once in several blocks and groups
        monkeypatch.setattr(training_pairs, "best_records", lambda *a, size=size: whole(*a, block=size, group=size // 4))
        found = {}
        for r in hard_negatives(asked, records, n=11).collect():
            found.setdefault((r.query, r.own), set()).add(r.doc_id)
        assert found == {q: p for q, p in expected.items() if p}


def test_sets_that_differ_by_unknown_terms_are_looked_up_once(spark):
    rng = random.Random(8)
    usual, rare = [f"bail{k}x" for k in range(5)], [f"nom{k}x" for k in range(60)]
    rows = [(f"d{k:03d}", "train", " ".join(rng.choices(usual, k=rng.randrange(2, 9)) + rng.choices(rare, k=rng.randrange(3)))) for k in range(500)]
    asked = [sorted({*rng.sample(usual, rng.randrange(4)), *rng.sample(rare, rng.randrange(3)), f"numéro{k}"}) for k in range(120)]
    docs = spark.createDataFrame([(p, s, t.split()) for p, s, t in rows], "pid string, split string, terms array<string>")
    sets = spark.createDataFrame([(k, "train", t) for k, t in enumerate(asked)], "key long, split string, terms array<string>")
    texts = {p: t for p, _, t in rows}
    for few, block, group, entries in ((10**6, 10**6, 10**6, 50), (0, 60, 30, 1)):  # in one block, and in a grid with the terms joined
        with pytest.MonkeyPatch.context() as m:
            m.setattr(retrieval, "_KNOWN", few)
            m.setattr(retrieval, "_WAITING", 30)
            best, _ = retrieval.best_records(sets, docs, 7, 20, entries, block, group)
            found = best.sets.join(best.lists, "known").collect()
            assert best.lists.count() < len(found)
        got = {r.key: [(x.pid, -x.less) for x in r.best] for r in found}
        for k, query in enumerate(asked):
            scores = brute_bm25(texts, " ".join(query), {t: t.split() for t in (" ".join(query), *texts.values())})
            assert got.get(k, []) == [(p, pytest.approx(scores[p], abs=2e-9)) for p in sorted(scores, key=lambda p: (-round(scores[p], 9), p))[:7]]


def test_sums_of_common_terms_go_on_from_those_of_the_last_set():
    rng = random.Random(11)
    records, k, of = 400, 5, [sorted(rng.sample(range(400), rng.choice((0, 3, 40, 350)))) for _ in range(12)]
    weight = [[rng.choice((0.5, 1.0, rng.random())) for _ in x] for x in of]
    edge = np.cumsum([0, *map(len, of)])
    sums = retrieval._Sums(records, k, edge, np.array(sum(of, []), np.int32), np.array(sum(weight, [])))
    added, whole = [], retrieval._Sums._add
    with pytest.MonkeyPatch.context() as m:
        m.setattr(retrieval._Sums, "_add", lambda self, term, idf: added.append(term) or whole(self, term, idf))
        for terms in sorted([*rng.sample(range(12), rng.randrange(6))] for _ in range(200)):
            sums.turn_to(terms, [1.0 + t for t in terms])
            score = np.zeros(records)
            for t in terms:
                score[of[t]] += (1.0 + t) * np.array(weight[t])
            assert np.array_equal(sums.score, score)  # what is taken back leaves no trace
            first = sorted(np.flatnonzero(score), key=lambda x: (-round(score[x], 9), x))[:k]
            assert sums.best[-1][0].tolist() == first and sums.best[-1][1].tolist() == score[first].tolist()
    begun = len(added)
    sums.turn_to([0, 1, 2], [1.0] * 3)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(retrieval._Sums, "_add", lambda self, term, idf: added.append(term) or whole(self, term, idf))
        sums.turn_to([0, 1, 3], [1.0] * 3)
    assert begun and added[begun:] == [3]


def test_texts_are_cleaned_once(spark):
    frame = spark.createDataFrame([(1, "Cour", "Titre long", "mot " * 20)], "i int, jurisdiction string, title string, content string")
    plan = clean_records(frame, "i")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("http") == 3  # court, title, content


def test_every_record_gets_a_random_negative(spark):
    rows = [(f"d{k}", "train" if k < 12 else "val", f"titre {k % 5}" if k < 12 else "seul", None if k % 3 == 0 else f"cour {k % 2}") for k in range(14)]
    records = spark.createDataFrame(rows, "doc_id string, split string, title string, jurisdiction string")
    found = random_negatives(records.withColumn("query", F.col("title")), records, n=2).collect()
    by = {r[0]: r for r in rows}
    assert {r.own for r in found} == {f"d{k}" for k in range(12)}  # the others have no record of another title
    assert all(by[r.own][1] == by[r.doc_id][1] and by[r.own][2] != by[r.doc_id][2] for r in found) and len({(r.own, r.doc_id) for r in found}) == len(found)


def test_vectors(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(50, 8)).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(99, None)], "id long, v array<float>")
    got = {}
    for r in nearest(frame.where("id < 5"), frame, "id", "v", 3).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.pid)
    s = vectors.astype(np.float64) @ vectors.astype(np.float64).T
    assert got == {q: [int(p) for p in np.argsort(-s[q]) if p != q][:3] for q in range(5)}
    far = {(r.qid, r.pid) for r in at_least(frame.where("id < 5"), frame, "id", "v", 2.0).collect()}
    assert far == {(q, p) for q in range(5) for p in range(50) if p != q and s[q, p] >= 2.0} and far
    monkeypatch.setattr(vectors_module, "BLOCK_QUERIES", 2)  # in several blocks, ties by id
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(40)], "id long, v array<float>")
    got = nearest(same.where("id < 5"), same, "id", "v", 3).orderBy("qid", "rank").collect()
    assert [r.pid for r in got if r.qid == 1] == [0, 2, 3] and len(got) == 15
    assert nearest(same.limit(0), same, "id", "v").count() == 0
    texts = spark.createDataFrame([("a",), ("bb",), ("a",), (None,)], "t string")
    store = embed(texts, "t", lambda xs: [[float(len(x))] for x in xs], spark.createDataFrame([], "text_key string, vector array<float>, created timestamp"))
    assert sorted(r.vector[0] for r in store.collect()) == [1.0, 2.0]
    assert missing(texts, "t", store).count() == 0 and retained(store, 1).count() == 1
    states = np.ones((2, 3, 4))
    assert np.allclose(np.linalg.norm(pool(states, np.array([[1, 1, 0], [0, 0, 0]])), axis=1), [1, 0])


def test_folder_scan(spark, tmp_path):
    (tmp_path / "venv").mkdir()
    (tmp_path / "venv" / "x.txt").write_text("x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.txt").write_bytes("é".encode() + b"\xff!")
    (tmp_path / "a.exe").write_text("x")
    (tmp_path / "big.txt").write_text("x" * 2000)
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:p><w:t>Un</w:t><w:tab/><w:t>deux</w:t></w:p><w:p><w:t>Trois</w:t></w:p></w:document>')
    documents, skipped = files.scan_folder(spark, str(tmp_path), max_bytes=1500)
    assert {r.path: r.text for r in documents.collect()} == {"sub/b.txt": "é!", "c.docx": "Un\tdeux\n\nTrois"}
    assert {r.path: r.reason for r in skipped.collect()} == {"venv/x.txt": "hidden folder", "a.exe": "type", "big.txt": "file too large", "bad.docx": "unreadable: BadZipFile"}
    documents, skipped = files.scan_folder(spark, str(tmp_path / "sub"), max_files=0)
    assert documents.count() == 0 and skipped.first().reason == "too many files"


def test_uploads_and_their_names(spark):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    word = io.BytesIO()
    with zipfile.ZipFile(word, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:p><w:t> Un </w:t></w:p><w:p/><w:p><w:t>Deux</w:t></w:p></w:document>')
    b64 = lambda x: base64.b64encode(x).decode()
    rows = [(1, "a/n.txt", None, "un"), (2, "n.txt", b64(b"deux"), None), (3, "b/n.txt", None, " "), (4, "n.txt", None, "x"), (5, "w.docx", b64(word.getvalue()), None), (6, "w.docx", b64(b"no zip"), None), (7, "t.exe", None, "x"), (8, "x.md", "??", None), (9, None, None, "sans nom"), (10, "a.b.TXT", None, "fin"), (11, "dir/a.b.TXT/", None, "fin"), (12, "", None, "y")]
    frame = spark.createDataFrame(rows, "position int, name string, data string, text string")
    names = {r.position: r.unique_name for r in files.unique_names(frame, "name", "position").collect()}
    assert names == {1: "n.txt", 2: "n (2).txt", 3: "n (3).txt", 4: "n (4).txt", 5: "w.docx", 6: "w (2).docx", 7: "t.exe", 8: "x.md", 9: "document.txt", 10: "a.b.TXT", 11: "a.b (2).TXT", 12: "document (2).txt"}
    assert names == {r.position: r.unique_name for r in files.unique_names(frame, "name", "position", bucket_rows=2).collect()}
    documents, skipped = files.uploads(frame)
    assert {r.unique_name: r.text for r in documents.collect()} == {"n.txt": "un", "n (2).txt": "deux", "n (4).txt": "x", "w.docx": "Un\n\nDeux", "document.txt": "sans nom", "a.b.TXT": "fin", "a.b (2).TXT": "fin", "document (2).txt": "y"}
    assert {r.unique_name: r.reason for r in skipped.collect()} == {"n (3).txt": "no readable text", "w (2).docx": "unreadable: BadZipFile", "t.exe": "type", "x.md": "unreadable: Error"}
    assert files.unique_names(frame.limit(0), "name", "position").count() == 0


def test_other_sources(spark, tmp_path):
    (tmp_path / "r.tsv").write_text("Cour\tTitre du jugement\t" + "mot " * 30 + "\nx\ty\nCour\\tAutre titre\\t" + "mot " * 30 + "\n")
    assert {r.title for r in files.read_tsv(spark, str(tmp_path / "r.tsv")).collect()} == {"Titre du jugement", "Autre titre"}
    files.write_jsonl(spark.createDataFrame([("1", "q", "d", 1)], "id string, query string, doc string, label int"), str(tmp_path / "cases"))
    case = files.read_cases(spark, str(tmp_path / "cases")).first()
    assert (case.id, case.label, case.category) == ("1", 1, "uncategorized")
    (tmp_path / "suite.jsonl").write_text('{"query": "q", "doc": "d", "label": 1}\n\n{"id": "x", "query": "r", "doc": "d", "label": 0, "category": "trap"}\n{"query": "s", "doc": "d", "label": 0}')
    assert [(r.id, r.query, r.category) for r in files.read_cases(spark, str(tmp_path / "suite.jsonl")).orderBy("query").collect()] == [("1", "q", "uncategorized"), ("x", "r", "trap"), ("4", "s", "uncategorized")]
    (tmp_path / "bad.jsonl").write_text('{"query": "q", "doc": "d", "label": 1}\n{"query": "q", "doc": "d", "label": 3}\n')
    with pytest.raises(Exception, match="bad.jsonl:2"):
        files.read_cases(spark, str(tmp_path / "bad.jsonl")).collect()


def test_stream_adds_each_document_once(spark, tmp_path):
    from lexispark.streaming.ingest import ingest

    docs = spark.createDataFrame([(1, "Un texte."), (2, "Deux textes.")], "id long, text string")
    docs.write.parquet(str(tmp_path / "in" / "one"))
    args = (spark, str(tmp_path / "in" / "*"), docs.schema, "id", "text", str(tmp_path / "table"), str(tmp_path / "check"))
    ingest(*args).awaitTermination()
    docs.union(spark.createDataFrame([(3, "Trois.")], docs.schema)).write.parquet(str(tmp_path / "in" / "two"))
    ingest(*args).awaitTermination()
    assert sorted(r.doc for r in spark.read.parquet(str(tmp_path / "table")).collect()) == [1, 2, 3]


def test_written_tables_can_be_discarded(spark):
    from pathlib import Path

    from lexispark import storage

    table, n = storage.written_with_count(spark.range(7), "test")
    other = storage.written(spark.range(3), "test")
    paths = [Path(t._lexispark_path.removeprefix("file:")) for t in (table, other)]
    assert n == table.count() == 7 and all(p.exists() for p in paths)
    storage.discard(table)
    assert [p.exists() for p in paths] == [False, True]
    storage.clear(spark)
    assert not paths[1].exists() and storage.written_with_count(spark.range(0), "test")[1] == 0


def test_suite_report(spark):
    cases = spark.createDataFrame([("1", "dev", "direct", "préavis de démission", "Le préavis de démission dure un mois", 1), ("2", "dev", "trap", "préavis de démission", "La recette du gâteau", 0)], "id string, suite string, category string, query string, doc string, label int")
    rows = {r.scorer: r for r in suite_report(cases).collect()}
    assert rows["keyword"].accuracy == 1.0 and rows["always"].accuracy == 0.5 and rows["bm25"].auc == 1.0
    assert "| dev | keyword |" in as_markdown(suite_report(cases), ["suite", "scorer", "accuracy"])


def test_character_tokens(spark):
    from lexispark.operators.encoding import character_vocabulary, decoded, token_ids

    known = character_vocabulary()
    texts = ["Le patient n'a  aucune allergie !", "", None, "контракт 42", "CONTRAT\u00a0écrit"]

    def brute(text):
        out = []
        for word in re.findall(r"[\w']+|[^\w\s]", re.sub(r"\s+", " ", text.lower().strip())):
            while word:
                n = next((n for n in range(len(word), 0, -1) if word[:n] in known), 0)
                out.append(known[word[:n]] if n else known["[UNK]"])
                word = word[max(1, n) :]
        return out

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, a string").select("i", token_ids(F.col("a"), known).alias("x"))
    got = [(r.x, r.t) for r in rows.select("x", decoded(F.col("x"), known).alias("t"), "i").orderBy("i").collect()]
    assert [x for x, _ in got] == [brute(t or "") for t in texts]
    assert [t for _, t in got][:2] == ["lepatientn'aaucuneallergie!", ""] and len(known) == len(set(known.values())) and got[3][1] == "42"


def test_cached_vectors_and_reports(spark):
    texts = spark.createDataFrame([("a", 1), ("bb", 2), ("a", 3), (None, 4)], "t string, vec int")
    store = spark.createDataFrame([], "text_key string, vector array<float>, created timestamp")
    calls = lambda xs: [[float(len(x))] for x in xs]
    rows, new, misses = embed_cached(texts, "t", calls, store)
    assert {r.vec: r.vector for r in rows.collect()} == {1: [1.0], 2: [2.0], 3: [1.0], 4: None} and misses == 2
    assert embed_cached(texts, "t", calls, new)[2] == 0
    skipped = spark.createDataFrame([(f"f{k:02d}", "type") for k in range(70)], "path string, reason string")
    found = files.skipped_report(skipped).collect()
    assert len(found) == 50 and {r.skipped_total for r in found} == {70} and found[0].path == "f00"
    assert files.skipped_report(skipped.limit(0)).count() == 0


def test_pair_encoding_and_heads(spark):
    from lexispark.operators.encoding import choice, padded, pair_ids, rubric

    rows = spark.createDataFrame([([1, 2], [3, 4, 5], [0.0, 2.0, 9.0]), (list(range(100)), list(range(300)), [1.0, 1.0, 0.0]), (None, None, [0.5, 0.0, 0.0])], "q array<int>, c array<int>, l array<double>")
    ids = pair_ids(F.col("q"), F.col("c"), 101, 102)
    got = rows.select(ids.alias("i"), padded(ids, 256).alias("p"), choice(F.col("l"), 2).alias("x"), rubric(F.lit(0.0)).alias("r")).collect()
    assert got[0].i == [101, 1, 2, 102, 3, 4, 5, 102] and len(got[1].i) == 256 and got[1].i[65] == 102 and got[2].i == [101, 102, 102]
    assert all(len(g.p.ids) == len(g.p.mask) == 256 and sum(g.p.mask) == len(g.i) and g.r == 2.0 for g in got)
    assert [g.x["index"] for g in got] == [1, 0, 0] and abs(got[0].x.probability - 1 / (1 + math.exp(-2))) < 1e-12 and got[1].x.probability == 0.5


def test_entry_without_the_llm_folder(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parent.parent
    shutil.copytree(root / "lexispark", tmp_path / "lexispark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    for leftover in (False, True):
        if leftover:
            (tmp_path / "lexispark" / "llm" / "__pycache__").mkdir(parents=True)
        code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n[0] == 'p' and n[1].isdigit() for n in q) and set(e.oracle_sql()) <= set(q)"
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
