"""The operators against brute force on small inputs, and their defined results for awkward ones."""

from __future__ import annotations

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import SMALL, assert_same
from pyspark.sql import functions as F

from corefold.llm import catalog, groups, hashes, mixing, overlap, packing, pieces, spans, tokens


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, name):
    assert_same(spark, catalog.QUERIES[name], catalog.SQL[name])


# --- groups ---


def components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return sorted((find(x), x) for x in parent)


def test_groups_of_chain_star_and_random_links_with_clashing_columns(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(1000, 1300)] + [(5000, 5000 + i) for i in range(1, 200)] + [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    edges += edges[:50] + [(b, a) for a, b in edges[:50]] + [(None, 3), (4, None), (7777, 7777)]
    df = spark.createDataFrame([(a, b, 1, "x", 0) for a, b in edges], "src long, dst long, group_id int, v string, a int")
    got = sorted(map(tuple, groups.connected_groups(df).collect()))
    assert got == components(edges)


def test_groups_of_nothing(spark):
    df = spark.createDataFrame([(1, 1), (None, 2)], "src long, dst long")
    assert groups.connected_groups(df).collect() == [] and groups.connected_groups(df.limit(0)).columns == ["group_id", "member"]


# --- pieces ---

FEATURES = "conll_doc_id long, conll_tokens array<array<string>>, locations array<struct<span_start:int,span_end:int,utterance:int>>, piece int, tokens string"


def cut(spark, rows, limit, over):
    return pieces.cut_documents(spark.createDataFrame([(*r, 1, "x") for r in rows], FEATURES), limit, over).orderBy("conll_doc_id", "piece").collect()


def test_pieces_keep_limit_overlap_and_spans(spark):
    rng = random.Random(3)
    rows = []
    for k in range(60):
        utts = [[rng.choice(["a", "b", ".", "''", "c"]) for _ in range(rng.randrange(0, 30))] for _ in range(rng.randrange(0, 6))]
        locations = [(s, s + rng.randrange(1, 4), u) for u, x in enumerate(utts) for s in range(0, len(x), 7)]
        rows.append((k, utts, locations))
    found = defaultdict(list)
    for r in cut(spark, rows, 12, 3):
        found[r.conll_doc_id].append(r)
    for k, utts, locations in rows:
        flat = [t for u in utts for t in u]
        base = np.cumsum([0] + [len(u) for u in utts])
        inside = {p for s, e, u in locations for p in range(base[u] + s + 1, base[u] + min(e, len(utts[u])))}
        out, upto = found[k], 0
        for i, r in enumerate(out):
            assert r.piece == i and len(r.tokens) == r.token_end - r.token_start <= 12 and r.tokens == flat[r.token_start : r.token_end]
            assert r.token_start == upto - r.overlap and r.overlap == (0 if i == 0 else 3) and r.token_end > upto or not flat
            window = range(max(upto + 1, r.token_start + 3), r.token_start + 12 + 1)
            if r.cut == "end":
                assert r.token_end == len(flat)
            elif r.cut == "utterance":
                assert r.token_end in base and not any(b in base for b in window if b > r.token_end)
            else:
                assert not any(b in base for b in window)
                free = [b for b in window if b not in inside]
                assert (r.token_end not in inside) == bool(free)
            upto = r.token_end
        assert upto == len(flat)


def test_pieces_of_awkward_documents(spark):
    long = ["w"] * 25
    rows = [(1, [long, None, []], None), (1, [long, None, []], None), (2, [], []), (3, None, [None, (None, 2, 0), (0, 9, 7)]), (None, [long], []), (4, [[None, "a"]], [(0, 2, 0)])]
    got = [(r.conll_doc_id, r.token_start, r.token_end, r.cut) for r in cut(spark, rows, 10, 2)]
    assert got == [(1, 0, 10, "token"), (1, 8, 18, "token"), (1, 16, 25, "end"), (2, 0, 0, "end"), (3, 0, 0, "end"), (4, 0, 2, "end")]
    assert cut(spark, [(1, [["a"] * 9], [(0, 9, 0)])], 4, 0)[0].cut == "inside a span"
    assert cut(spark, rows[:0], 10, 2) == []
    with pytest.raises(ValueError):
        pieces.cut_documents(spark.createDataFrame([], FEATURES), 4, 4)


# --- overlaps ---


def ngrams(words, n):
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def overlap_records(seed):
    """Records of a small alphabet, so that many n-grams are hot, with copies, excerpts, repeated rows and rows of no side."""
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(0, 30))] for _ in range(12)]
    rows = []
    for i in range(120):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(0, 4)):
            if words:
                words[rng.randrange(len(words))] = rng.choice("abcxyz")
        cut = rng.randrange(0, 10)
        rows.append((i, rng.choice(["train", "eval", "train", "other", None]), words[cut:] if i % 3 == 0 else words * (1 + (i % 7 == 0)), 7))
    return rows + [(200, "train", None, 7), (None, "eval", base[0], 7), *rows[:5]]


@pytest.mark.parametrize(
    ("n", "similarity", "containment", "hot"),
    [(3, 0.5, None, 16), (2, 0.8, None, 0), (1, 0.3, None, 3), (2, None, 0.8, 2), (1, None, 0.5, 0), (2, 0.4, 0.7, 1), (3, None, None, 16)],
)
def test_overlaps_equal_brute_force(spark, n, similarity, containment, hot):
    rows = overlap_records(n)
    df = spark.createDataFrame(rows, "id long, side string, tokens array<string>, class int")
    found, classes = overlap.find_overlaps(df, df, n, similarity, containment, hot=hot, most_words=4)
    least = similarity if similarity or containment else 0.8
    got = {(r.eval_id, r.train_id): r for r in overlap.expand_pairs(found, classes).collect()}
    sets = {i: (side, ngrams(words or [], n)) for i, side, words, _ in rows if i is not None}
    want = {}
    for a, b in itertools.product(sets, sets):
        if sets[a][0] == "eval" and sets[b][0] == "train" and sets[a][1] and sets[b][1]:
            shared, all_ = len(sets[a][1] & sets[b][1]), len(sets[a][1] | sets[b][1])
            if shared / all_ >= (least or 0) and shared / len(sets[a][1]) >= (containment or 0) and shared:
                want[a, b] = (shared / all_, shared / len(sets[a][1]))
    assert set(got) == set(want) and want
    assert all((got[p].similarity, got[p].containment) == pytest.approx(want[p]) for p in want)
    labels = spark.createDataFrame([(i, "dev", "s") for i, (side, _) in sets.items() if side == "eval"], "id long, split string, source string")
    report = overlap.overlap_report(found, classes, labels).first()
    assert (report.overlapping, report.pairs) == (len({a for a, _ in want}), len(want))


def test_an_excerpt_of_a_long_training_record_is_found(spark):
    long = [f"w{i}" for i in range(400)]
    df = spark.createDataFrame([(1, "train", long), (2, "eval", long[100:160]), (3, "eval", long[100:140] + [f"x{i}" for i in range(20)])], "id long, side string, tokens array<string>")
    found, _ = overlap.find_overlaps(df, df, 5, containment=0.8)
    assert [(r.eval_class, r.train_class, r.shared, r.containment) for r in found.collect()] == [(2, 1, 56, 1.0)]
    assert overlap.find_overlaps(df, df, 5, similarity=0.5)[0].collect() == []


def test_overlaps_of_nothing(spark):
    empty = spark.createDataFrame([], "id long, side string, tokens array<string>")
    assert overlap.find_overlaps(empty, empty)[0].collect() == []
    one = spark.createDataFrame([(1, "train", ["a"] * 9)], "id long, side string, tokens array<string>")
    assert overlap.find_overlaps(one, one)[0].collect() == []
    with pytest.raises(ValueError):
        overlap.find_overlaps(one, one, containment=0.0)


def test_key_filter_never_loses_a_key(spark):
    for words in (1, 64, 1 << 12):
        keys = hashes.key_filter(spark.range(0, 3000, 1, 3).select(F.col("id").alias("key")), 3000, words)
        assert len(keys) <= words and hashes.may_hold(keys, np.arange(3000)).all()
    assert hashes.may_hold(keys, np.arange(10**6, 2 * 10**6)).mean() < 0.05


# --- tokens and packing ---


def test_token_counts_equal_whole_encoding(spark):
    texts = ["", None, "a", " a", "a  b", "a   b\n c", "x \n\n y\t z ", "It's  the’s end.\r\n\r\nNo", " nb  sp", "中文 字符。", "é \U0001f600 x", "   ", "a " * 5000, "z" * 9000]
    encode = tokens.encoding(tokens.TOKENIZER).encode_ordinary
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, text string, n_tokens string")
    got = {r.id: r.n_tokens for r in tokens.with_token_counts(df).collect()}
    assert got == {i: len(encode(t or "")) for i, t in enumerate(texts)}


def pack(spark, sizes, capacity):
    return packing.pack(spark.createDataFrame([(*s, 3, 4) for s in sizes], "id long, n_tokens long, piece int, rank int"), capacity).collect()


@pytest.mark.parametrize("capacity", [10, 37, 100])
def test_packing_keeps_items_whole_and_containers_full(spark, capacity):
    rng = random.Random(capacity)
    sizes = [(i, rng.randrange(0, capacity // 2 if i % 5 else 3 * capacity)) for i in range(400)]
    rows = pack(spark, sizes + sizes[:20] + [(None, 5), (1000, None)], capacity)
    by_item, load = defaultdict(list), Counter()
    for r in rows:
        by_item[r.id].append(r)
        if r.n_tokens:
            load[r.container_id] += r.n_tokens
        else:
            assert r.container_id is None
    assert set(by_item) == {i for i, _ in sizes} | {1000}
    for i, size in sizes:
        own = sorted(by_item[i], key=lambda r: r.piece)
        assert [r.piece_start for r in own] == [k * capacity for k in range(len(own))] and own[-1].piece_end == size
        assert len(own) == max(1, -(-size // capacity))
    assert max(load.values()) <= capacity and set(load) == set(range(len(load)))
    assert len(load) <= -(-sum(load.values()) // capacity) + 2


def test_plan_uses_every_item_once():
    rng = np.random.default_rng(4)
    for _ in range(20):
        capacity = int(rng.integers(1, 60))
        histogram = np.zeros(capacity + 1, np.int64)
        histogram[1:] = rng.integers(0, 50, capacity) * (rng.random(capacity) < 0.4)
        used = Counter()
        for combination, times in packing.make_plan(histogram):
            assert times > 0 and sum(x * n for x, n in combination.items()) <= capacity
            for x, n in combination.items():
                used[x] += n * times
        assert all(used[x] == histogram[x] for x in range(1, capacity + 1))


def test_packing_of_nothing(spark):
    assert pack(spark, [], 5) == []
    report = packing.fill_report(packing.pack(spark.createDataFrame([], "id long, n_tokens long"), 5), 5).first()
    assert (report.containers, report.tokens, report.fill) == (0, 0, None)


# --- mixing ---


def test_route_is_a_maximum_flow_of_least_cost():
    rng = random.Random(8)
    for _ in range(30):
        sizes = {p: rng.randrange(1, 4) for p in rng.sample([(0,), (1,), (2,), (0, 1), (0, 2), (1, 2), (0, 1, 2)], 3)}
        quotas, caps = [rng.randrange(0, 6) for _ in range(3)], {p: rng.randrange(0, 3) for p in sizes}
        flows = mixing.route({str(p): (size, p, caps[p]) for p, size in sizes.items()}, quotas)
        units = [(p, k) for p, size in sizes.items() for k in range(1, caps[p] + 1) for _ in range(size)]
        best = {(0, 0, 0): 0}  # filled quotas -> least cost
        for p, k in units:
            for state, cost in list(best.items()):
                for i in range(3):
                    if i in p and state[i] < quotas[i]:
                        new = tuple(x + (j == i) for j, x in enumerate(state))
                        best[new] = min(best.get(new, 10**9), cost + k - 1)
        most = max(map(sum, best))
        assert sum(flows.values()) == most
        assert sum((k - 1) * f for (_, k, _), f in flows.items()) == min(c for s, c in best.items() if sum(s) == most)


RECORDS = "id long, source string, f long, g long, size long, uses int, pattern int"
TARGETS = "source string, target_share double, max_repeats int"


def test_mix_reaches_shares_and_respects_repeats(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None, "other"]), i, 0, rng.randrange(1, 9), 0, 0) for i in range(3000)]
    rows += [(5000, "b", 1, 0, rows[1][4], 0, 0), (5001, "a", 1, 0, rows[1][4], 0, 0), *rows[:30], (None, "a", 9999, 0, 5, 0, 0), (6000, "a", 9998, 0, 0, 0, 0)]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 3), ("missing", 0.1, 4), ("a", 0.5, 1)], TARGETS)
    selection, report = mixing.mix(spark.createDataFrame(rows, RECORDS), targets)
    source = {r[0]: r[1] for r in rows}
    caps = {"a": 1, "b": 2, "c": 3}
    text = {r[0]: (r[2], r[3]) for r in rows}
    per_text = Counter()
    for r in selection.collect():
        assert source[r.id] == r.source and 1 <= r.uses <= caps[r.source]
        per_text[text[r.id]] += r.uses
    assert per_text[1, 0] <= 1  # also in source a
    out = {r.source: r for r in report.collect()}
    for name in "abc":
        assert abs(out[name].reached - out[name].quota) < 30 and not out[name].short
    assert out["missing"].short and out["missing"].reached == 0
    again, _ = mixing.mix(spark.createDataFrame(rows, RECORDS).repartition(3), targets)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, selection.collect()))


def test_mix_of_many_sources_and_patterns(spark):
    rng = random.Random(6)
    names = [f"s{i}" for i in range(80)]
    rows = [(10 * i + k, name, i, 0, 1 + i % 5, 0, 0) for i in range(1200) for k, name in enumerate(rng.sample(names, 1 + i % 2))]
    targets = spark.createDataFrame([(x, 1 / 80, 2) for x in names], TARGETS)
    for most in (20_000, 90):  # with 90 the smaller patterns count for one of their sources only
        selection, report = mixing.mix(spark.createDataFrame(rows, RECORDS), targets, most_patterns=most)
        per_text, per_source = Counter(), Counter()
        for r in selection.collect():
            assert rows and r.source in names
            per_text[r.id // 10] += r.uses
            per_source[r.source] += r.uses * r.size
        assert max(per_text.values()) <= 2
        for r in report.collect():
            assert r.reached == per_source[r.source] and r.reached <= r.quota + 5 and (most == 90 or abs(r.reached - r.quota) <= 5)


def test_reachable_total_leaves_no_source_short(spark):
    rows = [(i, "abc"[i % 3 if i < 60 else 0], i, 0, 1 + i % 7, 0, 0) for i in range(900)]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 1), ("gone", 0.1, 4)], TARGETS)
    out = {r.source: r for r in mixing.mix(spark.createDataFrame(rows, RECORDS), targets, mixing.REACHABLE)[1].collect()}
    assert all(abs(out[x].reached - out[x].quota) <= 4 and not out[x].short for x in "abc") and out["gone"].short
    everything = sum(r[4] for r in rows if r[1] == "b") * 2
    assert out["b"].quota <= everything < out["b"].quota + 4


def test_mix_of_nothing(spark):
    selection, report = mixing.mix(spark.createDataFrame([], RECORDS), spark.createDataFrame([("a", 1.0, 2)], TARGETS), 100)
    assert selection.collect() == [] and [(r.reached, r.short) for r in report.collect()] == [(0, True)]


# --- spans ---


def brute_spans(rows, width):
    owners = defaultdict(set)
    for i, text in rows:
        for s in range(len(text or "") - width + 1):
            if i is not None:
                owners[text[s : s + width]].add(i)
    out = set()
    for i, text in rows:
        if i is None or text is None:
            continue
        marks = np.zeros(len(text) + 2, int)
        for s in range(len(text) - width + 1):
            if len(owners[text[s : s + width]]) > 1:
                marks[s : s + width] = 1
        edges = np.flatnonzero(np.diff(np.r_[0, marks]))
        out |= {(i, int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])}
    return sorted(out)


def span_texts(seed):
    rng = random.Random(seed)
    word = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    shared = [word(rng.randrange(20, 90), "abcd é中") for _ in range(6)] + ["-" * 70, "ab" * 40, "abc" * 30, " " * 55, "abbabaabbaababba" * 4]
    rows = []
    for i in range(60):
        parts = [rng.choice([rng.choice(shared), word(rng.randrange(0, 40), "abcd"), rng.choice(shared)[: rng.randrange(10, 60)]]) for _ in range(rng.randrange(0, 5))]
        rows.append((i, "".join(parts)))
    return [*rows, (7, rows[7][1]), (None, shared[0]), (900, None), (901, ""), (902, shared[0] * 2), (903, "\U0001f600" * 40), (904, "x\U0001f600" + "\U0001f600" * 39)]


@pytest.mark.parametrize(("width", "seed"), [(16, 1), (25, 2), (40, 3), (4, 4), (7, 5)])
def test_spans_equal_brute_force(spark, width, seed):
    rows = span_texts(seed)
    df = spark.createDataFrame([(*r, 1, 2, "z") for r in rows], "doc_id long, text string, id int, key int, stretch string")
    got = sorted(map(tuple, spans.shared_spans(df, width).collect()))
    assert got == brute_spans(rows, width)


@pytest.mark.parametrize(("width", "bits"), [(16, 1), (25, 4), (7, 0)])
def test_spans_do_not_depend_on_fingerprints(spark, width, bits):
    rows = span_texts(width)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, spans.shared_spans(df, width, name_bits=bits).collect()))
    assert got == brute_spans(rows, width)


def test_complementary_automatic_sequences_share_no_window(spark):
    """Polynomial fingerprints modulo a power of two are equal for these two texts, whatever the base."""
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, word[:2048]), (2, other[:2048])], "doc_id long, text string")
    assert spans.shared_spans(df, 2048).collect() == []
    longer = [(1, "x" + word), (2, other + "y"), (3, "zz" + word[:2048])]
    df = spark.createDataFrame(longer, "doc_id long, text string")
    assert sorted(map(tuple, spans.shared_spans(df, 512).collect())) == brute_spans(longer, 512)


def test_runs_over_several_cells_are_compared_whole(spark, monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdef ") for _ in range(5000))
    rows = [(i, "q" * i + text[i * 100 : 5000 - i * 37]) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, spans.shared_spans(df, 60).collect())) == brute_spans(rows, 60)
    runs = spark.createDataFrame([(0, 1, -101, 200, 3000), (2, 3, 0, 0, 3)], "id long, rid long, delta int, lo int, hi int")
    texts = df.toDF("id", "text")
    # text 1 is shifted by 99 characters: every cell differs; the beginnings of 2 and 3 are equal but for their last character
    assert {r.id for r in spans._differing(texts, runs).collect()} == {0, 2}
    runs = spark.createDataFrame([(0, 1, -99, 200, 3000), (2, 3, 0, 0, 2)], "id long, rid long, delta int, lo int, hi int")
    assert spans._differing(texts, runs).collect() == []


def test_every_window_has_one_representative_and_segments_do_not_matter(monkeypatch):
    rng = random.Random(11)
    text = "".join(rng.choice(["ab", "c", "d" * 9, "the cat ", "-" * 60]) for _ in range(400))
    for width in (20, 40, 160):
        owner, first, count, key, _ = spans._blocks([text], width)
        assert sorted(w for f, n in zip(first, count) for w in range(f, f + n)) == list(range(len(text) - width + 1))
        whole = {w: k for f, n, k in zip(first, count, key) for w in range(f, f + n)}
        parts = [text[b : b + 500 + width - 1] for b in range(0, len(text) - width + 1, 500)]
        owner, first, count, key, _ = spans._blocks(parts, width)
        assert whole == {o * 500 + w: k for o, f, n, k in zip(owner, first, count, key) for w in range(f, f + n)}


def test_shares(spark):
    df = spark.createDataFrame([(1, "x" + "abcdefgh" * 3), (2, "abcdefgh" * 3), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: (r.n_chars, r.n_spans, r.shared_chars, r.shared_share) for r in spans.shared_shares(df, 10).collect()}
    assert got == {1: (25, 1, 24, 0.96), 2: (24, 1, 24, 1.0), 3: (0, 0, 0, 0.0), 4: (0, 0, 0, 0.0)}
    assert spans.shared_spans(df.limit(0), 10).collect() == []


# --- the queries without SQL ---


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_runs(spark, name):
    rows = catalog.QUERIES[name](spark, SMALL)
    assert rows.agg(F.count(F.lit(1))).first()[0] > 0
