import random

import numpy as np
from pyspark.sql import functions as F

from quire.llm import language, toxicity
from quire.llm.queries import op8_language, op10_toxicity

SF = "/root/testdata/sf0.1"


def test_toxicity_held_out(spark):
    got = op10_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    pos, neg = [r for r in got if r.toxic], [r for r in got if not r.toxic]
    assert sum(r.predicted for r in pos) >= 0.9 * len(pos)
    assert sum(r.predicted for r in neg) <= 0.02 * len(neg)
    assert all(0 <= r.score <= 1 for r in got)


def test_toxicity_folding_exceptions_and_edges(spark):
    m = toxicity.Matcher(toxicity.Model({toxicity.fold("idiot"): 4.0, toxicity.fold("clown"): 3.0}, tuple(map(toxicity.fold, toxicity.EXCEPTIONS)), 1.0, 0.0, 20))
    assert m.rate("you idiot") == m.rate("you 1d10t") == m.rate("you іdіоt") == m.rate("you ｉｄｉｏｔ") > 0
    assert m.rate("a clown fish swims") == 0 < m.rate("a clown swims")
    assert m.rate("semidiot") == m.rate("") == m.rate(None) == 0
    rows = spark.createDataFrame([(1, "a", None), (2, None, 1)], "doc_id long, text string, toxic int")
    model = toxicity.learn(rows)
    assert model.terms == {}
    out = toxicity.score_documents(rows.withColumnRenamed("toxic", "score"), model).collect()
    assert [r.predicted for r in out] == [0, 0]
    assert toxicity.score_documents(rows.where("false"), model).count() == 0


def test_language_held_out(spark):
    got = op8_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").where("held_out and lang is not null").collect()
    right = sum(r.lang == r.lang_pred for r in got)
    assert right >= 0.97 * len(got), (right, len(got))


def test_language_edges(spark):
    rows = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "123 !?", "de"), (5, "", None), (5, "und die " * 90000, "de"), (5, "x", None)], "doc_id long, text string, lang string")
    model = language.learn(rows)
    out = {(r.doc_id, r.text): r for r in language.identify(rows.withColumnRenamed("lang", "score"), model).collect()}
    assert [out[k].lang_pred for k in ((3, None), (4, "123 !?"), (5, ""))] == ["und"] * 3
    assert out[(1, "the cat and the dog")].lang_pred == "en" and out[(2, "der hund und die katze")].lang_pred == "de"
    empty = language.learn(rows.where("false"))
    assert {r.lang_pred for r in language.identify(rows, empty).collect()} == {"und"}


def test_lexicon_equals_a_plain_scan():
    rng = random.Random(3)
    terms = {"idiot$": 2.0, "mor": 1.5, "moron$": 3.0, "trash$": 1.0, "tra": 0.5, "achiich": 2.5}
    model = toxicity.Model(terms, ("trash can", "a moron"), 1.0, 0.0, 20)
    m = toxicity.Matcher(model)
    pieces = ["idiot", "1d10t", "moron", "morons", "trash", "trash can", "trashy", "tram", "a", "Achlichkeit", "x", "idiot$$$", "$idiot", "ｔｒａｓｈ", "tr\u200bash", "can", ",", "7", "мoron"]
    for _ in range(600):
        text = "".join(rng.choice(pieces) + rng.choice([" ", " ", " ", "", "-"]) for _ in range(rng.randint(1, 8)))
        base = toxicity.plain(text)
        folded, n = toxicity.fold(text), len(base)
        inside = lambda k: 0 <= k < n and base[k].isalpha()
        ends = lambda k: k == n or not base[k].isalpha() or not folded[k].isalpha()
        best, spared = {}, set()
        for i in range(n):
            if inside(i - 1):
                continue
            for t, w in terms.items():
                word = t.rstrip("$")
                if folded.startswith(word, i) and (t == word or ends(i + len(word))):
                    best[i] = max(best.get(i, 0), w)
            for p in model.exceptions:
                if folded.startswith(p, i) and ends(i + len(p)):
                    spared |= set(range(i, i + len(p)))
        want = sum(w for i, w in best.items() if i not in spared) / (len(text.split()) + 20)
        assert abs(m.rate(text) - want) < 1e-12, (text, m.rate(text), want)


def test_whole_words_stems_and_learnt_exceptions(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("bcdfgk", k=6))
    rows = []
    for i in range(300):
        t = [word() for _ in range(20)]
        toxic = i % 3 == 0
        if toxic:
            t[rng.randint(0, 19)] = rng.choice(["scoundrel", "zzul" + word()])
        elif i % 10 == 1:
            t[5:7] = ["scoundrel", "apples"]
        rows.append((i, " ".join(t), int(toxic)))
    model = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert toxicity.fold("scoundrel") + "$" in model.terms and "scoundre" not in model.terms and toxicity.fold("zzul") in model.terms
    assert toxicity.fold("scoundrel apples") in model.exceptions
    m = toxicity.Matcher(model)
    assert m.score("a scoundrel he is") > 0.3 > m.score("scoundrel apples taste well") and m.rate("scoundrels") == 0


def test_repeated_ids_and_conflicting_labels(spark):
    docs = spark.createDataFrame([(1, "b one"), (1, "a two"), (2, "c"), (None, "n")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (1, 0), (2, 0), (9, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    seen = {}
    real = toxicity.learn
    try:
        toxicity.learn = lambda sample, fit, **k: seen.update(rows=sorted((r.text, r.toxic) for r in sample.collect())) or real(sample, fit, **k)
        toxicity.learn_from(docs, labels)
    finally:
        toxicity.learn = real
    held = {r[0] for r in spark.range(1, 3).where(toxicity.held_out(F.col("id"))).collect()}
    assert seen["rows"] == [x for d, x in ((1, ("a two", 1)), (2, ("c", 0))) if d not in held]


def test_kernel_ridge_with_all_landmarks_is_exact(spark):
    rng = random.Random(5)
    alphabets = {"xa": "aeiost", "xb": "aeounr", "xc": "iouktp"}
    rows = [(i, "".join(rng.choices(alphabets[g] + " ", k=rng.randint(20, 60))), g) for i in range(45) for g in [rng.choice([*alphabets])]]
    fit = language.Fit(rows=100, landmarks=100, bits=18, ridge=1e-3)
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), fit)
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    k = lambda s, t: len(s & t) / (len(s) * len(t)) ** 0.5
    G = [grams(t) for _, t, _ in rows]
    K = np.array([[k(s, t) for t in G] for s in G])
    names = sorted({g for *_, g in rows})
    Y = np.array([[1.0 if g == x else -1.0 for x in names] for *_, g in rows])
    dual = np.linalg.solve(K + fit.ridge * len(rows) * np.eye(len(rows)), Y)
    fresh = [(i, "".join(rng.choices(alphabets[rng.choice([*alphabets])] + " ", k=40))) for i in range(20)]
    f = np.array([[k(grams(t), s) for s in G] for _, t in fresh]) @ dual
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(fresh, "doc_id long, text string"), model).collect()}
    for (i, _), row in zip(fresh, f, strict=True):
        assert got[i].lang_pred == names[int(row.argmax())] and abs(got[i].score - min(1, max(0, (1 + row.max()) / 2))) < 5e-3


def test_many_languages_stay_bounded(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} " * 5, f"l{i % 60}") for i in range(600)]
    fit = language.Fit(all_rows=120, all_landmarks=60, languages=40, bits=10)
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), fit)
    assert len(model.languages) == 40 and model.weights.shape == (1024, 40)
