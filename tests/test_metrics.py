"""The golden cases of the clustering metrics; one letter is one mention."""

import itertools

import numpy as np
import pytest

from corefold.operators import metrics

A, DEF = "a bc def", None
# Case, key, response, expected (recall, precision, F1) by metric.
CASES = [
    ("A1", A, "a bc def", {"muc": (1, 1, 1), "bcub": (1, 1, 1), "ceafm": (1, 1, 1), "ceafe": (1, 1, 1), "blanc": (1, 1, 1)}),
    ("A2", A, "a de", {"muc": (1 / 3, 1, 0.5), "bcub": (7 / 18, 1, 14 / 25), "ceafm": (0.5, 1, 0.66667), "ceafe": (0.6, 0.9, 0.72), "blanc": (0.21591, 1, 0.35385)}),
    ("A3", A, "a bcx defy z", {"muc": (1, 3 / 5, 0.75), "bcub": (1, (4 + 7 / 12) / 9, 110 / 163), "ceafm": (1, 0.66667, 0.8), "ceafe": (0.88571, 0.66429, 0.75918), "blanc": (1, 0.42593, 0.59717)}),
    ("A4", A, "a bcx dy z", {"muc": (1 / 3, 1 / 3, 1 / 3), "bcub": (5 / 9, 17 / 42, 2 * (5 / 9) * (17 / 42) / (5 / 9 + 17 / 42)), "ceafm": (0.66667, 0.57143, 0.61538), "ceafe": (0.73333, 0.55, 0.62857), "blanc": (0.35227, 0.27206, 0.30357)}),
    ("A5", A, "a bcxB dy z", {"muc": (1 / 3, 1 / 4, 2 / 7), "bcub": (5 / 9, 5 / 16, 2 * (5 / 9) * (5 / 16) / (5 / 9 + 5 / 16)), "ceafm": (0.66667, 0.5, 0.57143), "ceafe": (0.68889, 0.51667, 0.59048), "blanc": (0.35227, 0.19048, 0.24716)}),
    ("A6", A, "a bcx dy Bz", {"muc": (1 / 3, 1 / 4, 2 / 7), "bcub": (5 / 9, 17 / 48, 2 * (5 / 9) * (17 / 48) / (5 / 9 + 17 / 48)), "ceafm": (0.66667, 0.5, 0.57143), "ceafe": (0.73333, 0.55, 0.62857), "blanc": (0.35227, 0.20870, 0.25817)}),
    ("A7", A, "a bcxb dy z", {"muc": (1 / 3, 1 / 3, 1 / 3), "bcub": (5 / 9, 17 / 42, 2 * (5 / 9) * (17 / 42) / (5 / 9 + 17 / 42)), "ceafm": (0.66667, 0.57143, 0.61538), "ceafe": (0.73333, 0.55, 0.62857), "blanc": (0.35227, 0.27206, 0.30357)}),
    ("A8", A, "a bcx dy bz", {"muc": (1 / 3, 1 / 3, 1 / 3), "bcub": (5 / 9, 17 / 42, 2 * (5 / 9) * (17 / 42) / (5 / 9 + 17 / 42)), "ceafm": (0.66667, 0.57143, 0.61538), "ceafe": (0.73333, 0.55, 0.62857), "blanc": (0.35227, 0.27206, 0.30357)}),
    ("A9", A, "a bcx dy bbbbbbbbbbz", {"muc": (1 / 3, 1 / 3, 1 / 3), "bcub": (5 / 9, 17 / 42, 2 * (5 / 9) * (17 / 42) / (5 / 9 + 17 / 42)), "ceafm": (0.66667, 0.57143, 0.61538), "ceafe": (0.73333, 0.55, 0.62857), "blanc": (0.35227, 0.27206, 0.30357)}),
    ("A10", A, "a b c d e f", {"muc": (0, 0, 0), "bcub": (0.5, 1, 2 / 3), "blanc": (0.5, 0.36667, 0.42308)}),
    ("A11", A, "abcdef", {"muc": (1, 3 / 5, 6 / 8), "bcub": (1, 14 / 36, 14 / 25), "blanc": (0.5, 0.13333, 0.21053)}),
    ("A12", A, "a x y c d e z", {"muc": (0, 0, 0), "bcub": (13 / 36, 4 / 7, 2 * (13 / 36) * (4 / 7) / (13 / 36 + 4 / 7)), "blanc": (0.22727, 0.11905, 0.15625)}),
    ("A13", A, "axycdez", {"muc": (1 / 3, 1 / 6, 2 / 9), "bcub": (17 / 36, 6 / 49, 2 * (17 / 36) * (6 / 49) / (17 / 36 + 6 / 49)), "blanc": (0.125, 0.02381, 0.04)}),
    ("B1", "ab cde", "bcx de", {"blanc": (7 / 24, 7 / 24, 7 / 24)}),
    ("C1", "ab cde fg", "bcx de fg", {"blanc": (0.5125, 0.5125, 0.5125)}),
    ("D1", "12345 67 89ABC", "12345 6789ABC", {"muc": (1, 0.9, 1.8 / 1.9), "bcub": (1, 16 / 21, 32 / 37)}),
    ("E1", "12345 67 89ABC", "1234589ABC 67", {"muc": (1, 0.9, 1.8 / 1.9), "bcub": (1, 7 / 12, 14 / 19)}),
    ("F1", "ABCD", "AB CD", {"muc": (2 / 3, 1, 0.8)}),
    ("G1", "AB CD", "ABCD", {"muc": (1, 2 / 3, 0.8)}),
    ("H1", "ABCD", "ABCD", {"muc": (1, 1, 1)}),
    ("I1", "ABCD", "AB CD", {"muc": (2 / 3, 1, 0.8)}),
    ("J1", "ABC", "AC", {"muc": (0.5, 1, 2 / 3)}),
    ("K1", "BCDEGHJ", "ABC DEF GHI", {"muc": (0.5, 0.5, 0.5)}),
    ("L1", "ABC DEFG", "AB CD FGH", {"muc": (0.4, 0.5, 4 / 9)}),
    ("M1", "abcdef", "abcdef", {"muc": (1, 1, 1), "bcub": (1, 1, 1), "ceafm": (1, 1, 1), "ceafe": (1, 1, 1), "blanc": (1, 1, 1)}),
    ("M2", "abcdef", "a b c d e f", {"muc": (0, 0, 0), "blanc": (0, 0, 0)}),
    ("M3", "abcdef", "ab cde f", {"blanc": (0.26667, 1, 0.42105)}),
    ("M4", "abcdef", "abcxyz", {"blanc": (0.2, 0.2, 0.2)}),
    ("M5", "abcdef", "a b c x y z", {"muc": (0, 0, 0), "blanc": (0, 0, 0)}),
    ("M6", "abcdef", "ab cxy z", {"blanc": (0.06667, 0.25, 0.10526)}),
    ("N1", "a b c d e f", "a b c d e f", {"muc": (0, 0, 0), "blanc": (1, 1, 1)}),
    ("N2", "a b c d e f", "abcdef", {"muc": (0, 0, 0), "blanc": (0, 0, 0)}),
    ("N3", "a b c d e f", "ab cde f", {"blanc": (0.73333, 1, 0.84615)}),
    ("N4", "a b c d e f", "a b c x y z", {"muc": (0, 0, 0), "blanc": (0.2, 0.2, 0.2)}),
    ("N5", "a b c d e f", "abcxyz", {"blanc": (0, 0, 0)}),
    ("N6", "a b c d e f", "ab cxy z", {"blanc": (0.13333, 0.18182, 0.15385)}),
]


def side(spark, cases):
    rows = [(name, i, m, seq) for name, text in cases for seq, (i, m) in enumerate((i, m) for i, entity in enumerate(text.split()) for m in entity)]
    return spark.createDataFrame(rows, "doc_id string, entity long, mention string, seq int")


def f1(r, p):
    return 2 * r * p / (r + p) if r + p else 0.0


@pytest.fixture(scope="module")
def golden(spark):
    key, response = side(spark, [(c[0], c[1]) for c in CASES]), side(spark, [(c[0], c[2]) for c in CASES])
    out = {}
    for row in metrics.document_counters(key, response).collect():
        r, p = (a / b if b else 0.0 for a, b in ((row.recall_num, row.recall_den), (row.precision_num, row.precision_den)))
        out[row.doc_id, row.metric] = (r, p, f1(r, p))
    counters = metrics.blanc_counters(key, response).toPandas()
    for name, *_ in CASES:
        score = metrics.blanc_scores(spark.createDataFrame(counters[counters.doc_id == name])).first()
        out[name, "blanc"] = (score.recall, score.precision, score.f1)
    return out


@pytest.mark.parametrize("case", CASES, ids=[c[0] for c in CASES])
def test_golden_case(golden, case):
    for metric, expected in case[3].items():
        assert sum(abs(a - b) for a, b in zip(golden[case[0], metric], expected)) < 1e-4, metric


def test_number_of_expectations():
    assert (len(CASES), sum(len(c[3]) for c in CASES)) == (36, 91)


def test_totals_are_micro_averages_and_documents_come_from_the_key(spark):
    key = side(spark, [("d1", "ab c"), ("d2", "xyz")])
    response = side(spark, [("d1", "ab c"), ("d9", "xyz")])
    t = {r.metric: r for r in metrics.totals(metrics.document_counters(key, response)).collect()}
    assert (t["muc"].recall_num, t["muc"].recall_den, t["muc"].precision_den) == (1, 3, 1)
    assert (t["ident"].recall, t["ident"].precision) == (0.5, 1.0)
    average = metrics.conll_average(metrics.totals(metrics.document_counters(key, key))).first()[0]
    assert average == pytest.approx(1.0)


def test_blanc_closed_form_equals_link_sets(spark):
    rng = np.random.default_rng(1)
    texts = []
    for _ in range(6):
        letters = rng.permutation(list("abcdefghij"))[: rng.integers(3, 10)]
        cuts = sorted(rng.integers(0, len(letters), 2))
        texts.append(" ".join(filter(None, ("".join(x) for x in np.split(letters, cuts)))))
    key, response = [(str(i), texts[i]) for i in range(3)], [(str(i), texts[i + 3]) for i in range(3)]
    got = {r.doc_id: r for r in metrics.blanc_counters(side(spark, key), side(spark, response)).collect()}
    for (name, a), (_, b) in zip(key, response):
        links = lambda text: {frozenset(p) for e in text.split() for p in itertools.combinations(e, 2)}
        others = lambda text: {frozenset(p) for p in itertools.combinations(text.replace(" ", ""), 2)} - links(text)
        row = got[name]
        assert (row.ck, row.cr, row.cc) == (len(links(a)), len(links(b)), len(links(a) & links(b)))
        assert (row.nk, row.nr, row.nn) == (len(others(a)), len(others(b)), len(others(a) & others(b)))


def test_assignment_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(40):
        n, m = rng.integers(1, 5), rng.integers(1, 6)
        gain = np.round(rng.random((n, m)), 2) * (rng.random((n, m)) < 0.6)
        small = gain if n <= m else gain.T
        best = max(sum(small[i, c] for i, c in enumerate(cols)) for cols in itertools.permutations(range(small.shape[1]), small.shape[0]))
        assert metrics.hungarian(small) == pytest.approx(best)
        rows, cols = np.nonzero(gain)
        if len(rows):
            assert metrics.best_assignment(rows, cols, gain[rows, cols]) == pytest.approx(best)
