import itertools
import random

import numpy as np

from graphloom.llm import language_id as L

WORDS = {
    "en": "the of and to in that with from this there which would their about people other water first sound place".split(),
    "de": "der die das und nicht mit eine auf sich auch werden nach über können schließlich möglich zwischen größe".split(),
    "fr": "le la les des et est dans que pour une avec sur être été très où français même année première".split(),
    "ru": "это что как его она они мы был для все так или когда человек время год дело жизнь день".split(),
}


def texts(n, seed):
    rng = random.Random(seed)
    return [(k, " ".join(rng.choices(WORDS[lang], k=rng.randrange(4, 60))), lang) for k, lang in enumerate(rng.choices(list(WORDS), k=n))]


def test_accuracy_spans_and_odd_texts(spark):
    rows = texts(400, 1)
    model = L.train(spark.createDataFrame([*rows, (7, "junk", None), (8, None, "en")], "doc_id long, text string, lang string"))
    assert model.languages == sorted(WORDS)
    new = texts(200, 2)
    mixed = " ".join(WORDS["en"] * 2) + ". " + " ".join(WORDS["de"] * 2) + ". " + " ".join(WORDS["ru"])
    odd = [(1000, None, ""), (1001, "", ""), (1002, "123 !?", ""), (1003, "“…”", ""), (None, "der die das und nicht", ""), (1005, mixed, "")]
    got = {r.doc_id: r for r in L.identify(spark.createDataFrame(new + odd, "doc_id long, text string, spans string"), model).collect()}
    assert sum(got[k].lang_pred == lang for k, _, lang in new) >= 196
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in range(1000, 1004))
    assert got[None].lang_pred == "de" and all(0 <= r.score <= 1 for r in got.values())
    assert [s.lang for s in got[1005].spans] == ["en", "de", "ru"]


def test_no_training_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = L.train(none)
    assert L.identify(none, model).count() == 0
    assert L.identify(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), model).first().lang_pred == "und"


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(3)
    for _ in range(600):
        scores = rng.normal([0, -4, -6], 8, (int(rng.integers(1, 6)), 3))
        value = lambda p, s=scores: s[np.arange(len(p)), list(p)].sum() - L.SWITCH * sum(a != b for a, b in itertools.pairwise(p))
        best = max(value(p) for p in itertools.product(range(3), repeat=len(scores)))
        path = L.viterbi(scores)
        assert abs(value(path) - best) < 1e-9 and (path == L._viterbi_wide(scores, L.SWITCH)).all()
        base = np.array([scores.sum(axis=0).argmax()])
        if L._steady(scores.T, np.array([0, len(scores)]), base, np.array([len(scores)]))[0]:
            assert (path == base[0]).all() or abs(value(np.repeat(base, len(scores))) - best) < 1e-9
