import numpy as np
import pytest
from pyspark.sql import functions as F

from corefold.operators import coref, dialogue, pairs, scoring
from corefold.streaming import dialogue as stream


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_worked_example_of_roots_and_main_mentions(spark):
    best, kinds = [0, 1, 0, 2, 1, 0], [0, 1, 2, 1, 0, 1]
    links = frame(spark, [(1, i, a, 0.0) for i, a in enumerate(best)], "doc_id int, men_idx int, best_ant int, best_score double")
    types = frame(spark, [(1, i, k) for i, k in enumerate(kinds)], "doc_id int, m_idx int, mention_type int")
    roots = coref.forest_roots(links)
    assert [r.root for r in roots.orderBy("m_idx").collect()] == [0, 1, 0, 0, 1, 0]
    got = {r.m_idx: (r.cluster, r.root, r.main) for r in coref.clusters(roots, types).collect()}
    assert got == {0: (0, 0, 5), 2: (0, 0, 5), 3: (0, 0, 5), 5: (0, 0, 5), 1: (1, 1, 1), 4: (1, 1, 1)}
    running = {r.root: r.representative for r in coref.running_representative(coref.drop_singletons(roots), types).collect()}
    assert running == {0: 2, 1: 1}


def test_roots_of_a_long_chain_and_of_gaps(spark):
    n = 3000
    links = frame(spark, [(1, i, max(0, i - 1), 0.0) for i in range(n)] + [(2, 5, 5, 0.0), (2, 9, 5, 0.0)], "doc_id int, men_idx int, best_ant int, best_score double")
    got = coref.forest_roots(links)
    assert got.where("doc_id = 1 and root = 0").count() == n
    assert sorted((r.m_idx, r.root) for r in got.where("doc_id = 2").collect()) == [(5, 5), (9, 5)]


def test_best_links_ties_and_greedyness(spark):
    scores = frame(spark, [(1, 2, 0, 3.0), (1, 2, 1, 3.0), (1, 3, 0, 1.0), (1, 4, 0, None)], "doc_id int, men_idx int, ant_idx int, score double")
    single = frame(spark, [(1, i, 1.0) for i in range(5)], "doc_id int, m_idx int, score double")
    got = {r.men_idx: (r.best_ant, r.best_score) for r in coref.best_links(scores, single).collect()}
    assert got == {0: (0, 1.0), 1: (1, 1.0), 2: (0, 3.0), 3: (3, 1.0), 4: (4, 1.0)}
    greedy = {r.men_idx: r.best_ant for r in coref.best_links(scores, single, 0.6).collect()}
    assert greedy[3] == 0


SENTENCE = "Marta owns a canoe . She paints it . The old sailor never tires of rivers".split()
MENTIONS = [(0, 0, 1), (1, 2, 4), (2, 5, 6), (3, 7, 8), (4, 9, 12)]


def example(spark, best):
    tokens = frame(spark, [("d", i, w, "" if w in ".,"[:0] else " ", 0) for i, w in enumerate(SENTENCE)], "doc_id string, tok_idx int, text string, ws string, utt_idx int")
    at = [sum(len(w) + 1 for w in SENTENCE[:i]) for i in range(len(SENTENCE) + 1)]
    m = frame(spark, [("d", i, s, e, " ".join(SENTENCE[s:e]), at[s], at[e] - 1, " ".join(SENTENCE[s:e]).lower()) for i, s, e in MENTIONS], "doc_id string, m_idx int, start int, end int, text string, start_char int, end_char int, span_lower string")
    links = frame(spark, [("d", i, a, 0.0) for i, a in enumerate(best)], "doc_id string, men_idx int, best_ant int, best_score double")
    types = frame(spark, [("d", i, k) for i, k in enumerate([2, 1, 0, 0, 1])], "doc_id string, m_idx int, mention_type int")
    return tokens, m, coref.clusters(coref.forest_roots(links), types)


def test_resolved_text_before_and_after_a_conversion(spark):
    tokens, m, found = example(spark, [0, 1, 0, 0, 0])
    assert coref.resolve(tokens, found, m).first().resolved.strip() == "Marta owns a canoe . Marta paints Marta . Marta never tires of rivers"
    tokens, m, found = example(spark, [0, 1, 0, 1, 0])
    assert coref.resolve(tokens, found, m).first().resolved.strip() == "Marta owns a canoe . Marta paints a canoe . Marta never tires of rivers"
    assert coref.resolve_utterances(tokens, found, m).first().resolved.strip() == "Marta owns a canoe . marta paints a canoe . marta never tires of rivers"
    lines = {r.cluster: r.line for r in coref.cluster_lines(found, m).collect()}
    assert lines == {0: "Marta: [Marta, She, The old sailor]", 1: "a canoe: [a canoe, it]"}


def test_payload_and_annotations(spark):
    import json

    tokens, m, found = example(spark, [0, 1, 0, 1, 4])
    resolved = coref.resolve(tokens, found, m)
    body = json.loads(coref.payload(m, found, resolved).first().payload)
    assert body["clusters"] == [["Marta", "She"], ["a canoe", "it"]]
    assert body["mentions"][1] == {"start": 21, "end": 24, "text": "She", "resolved": "Marta"}
    empty = coref.payload(m, found.limit(0), resolved).first().payload
    assert empty == "{}"
    spans = {r.m_idx: r.is_coref for r in coref.annotate_spans(m, found).collect()}
    assert spans == {0: True, 1: True, 2: True, 3: True, 4: False}
    docs = coref.annotate_docs(frame(spark, [("d", "t"), ("e", "u")], "doc_id string, text string"), found, resolved).collect()
    assert {r.doc_id: (r.has_coref, r.n_clusters, r.resolved[:5]) for r in docs} == {"d": (True, 2, "Marta"), "e": (False, 0, "u")}
    inside = {r.tok_idx for r in coref.annotate_tokens(tokens, found, m).where("in_coref").collect()}
    assert inside == {0, 2, 3, 5, 7}


def test_overlapping_mentions_last_write_wins(spark):
    tokens = frame(spark, [("d", i, w, " ") for i, w in enumerate("A b c d E".split())], "doc_id string, tok_idx int, text string, ws string")
    m = frame(spark, [("d", 0, 0, 1, "A"), ("d", 1, 1, 4, "b c d"), ("d", 2, 2, 3, "c"), ("d", 3, 4, 5, "E")], "doc_id string, m_idx int, start int, end int, text string")
    found = frame(spark, [("d", 0, 0, 0, 0), ("d", 0, 0, 0, 1), ("d", 1, 3, 3, 3), ("d", 1, 3, 3, 2)], "doc_id string, cluster int, root int, main int, m_idx int")
    assert coref.resolve(tokens, found, m).first().resolved == "A A E E "


def test_blacklist_rekeys_clusters(spark):
    _, m, _ = example(spark, [0, 1, 0, 1, 0])
    m = m.withColumn("span_lower", F.when(F.col("m_idx") == 0, "i").otherwise(F.col("span_lower")))
    members = frame(spark, [("d", i, r) for i, r in [(0, 0), (2, 0), (4, 0), (1, 1), (3, 1)]], "doc_id string, m_idx int, root int")
    got = {(r.m_idx, r.root) for r in coref.without_blacklist(members, m).collect()}
    assert got == {(2, 2), (4, 2), (1, 1), (3, 1)}


def test_candidate_pairs_against_brute_force(spark):
    words = [["a"], ["b"], ["a", "c"], [], ["c"], ["a"], ["b", "a"], ["d"]]
    m = frame(spark, [(1, i, w) for i, w in enumerate(words)], "doc_id int, m_idx int, content_words array<string>")
    for near, far in ((2, 5), (1, 100), (3, 3), (None, None), (2, None)):
        got = {(r.men_idx, r.ant_idx) for r in pairs.candidate_pairs(m, near, far).collect()}
        want = {(i, j) for i in range(8) for j in range(i) if near is None or i - j <= near or ((far is None or i - j <= far) and set(words[i]) & set(words[j]))}
        assert got == want, (near, far)
    assert pairs.candidate_pairs(m, 2, 5).count() == pairs.candidate_pairs(m, 2, 5).distinct().count()
    compat = {(r.men_idx, r.ant_idx) for r in pairs.candidate_pairs(m, 1, 5, True).collect()}
    assert (2, 0) not in compat and (6, 1) in compat


def test_chains(spark):
    links = frame(spark, [(1, i, a) for i, a in enumerate([0, 0, 1, 3, 2])], "doc_id int, men_idx int, best_ant int")
    asked = frame(spark, [(1, 4), (1, 3)], "doc_id int, m_idx int")
    assert sorted(r.m_idx for r in coref.follow_chains(links, asked).collect()) == [0, 1, 2, 3, 4]
    assert sorted(r.m_idx for r in coref.follow_chains(links, asked, 1).collect()) == [2, 3, 4]


def test_chains_are_followed_to_their_roots(spark):
    links = frame(spark, [(1, i, max(0, i - 1)) for i in range(120)] + [(2, 0, 0), (2, 7, 0), (2, 9, 7)], "doc_id int, men_idx int, best_ant int")
    asked = frame(spark, [(1, 119), (2, 9)], "doc_id int, m_idx int")
    assert sorted(map(tuple, coref.follow_chains(links, asked).collect())) == [(1, i) for i in range(120)] + [(2, 0), (2, 7), (2, 9)]
    assert coref.follow_chains(links, asked, 50).where("doc_id = 1").count() == 51


def test_appended_utterances_and_default_speakers(spark):
    schema = "conv_id int, utt_idx int, text string, speaker_id string"
    old = frame(spark, [(1, 0, "a", "0"), (1, 1, "b", "1")], schema)
    new = frame(spark, [(1, 0, "c", None), (1, 1, "d", None), (2, 0, "e", None)], schema)
    got = {(r.conv_id, r.utt_idx): r.speaker_id for r in dialogue.append_utterances(old, new).collect()}
    assert got == {(1, 0): "0", (1, 1): "1", (1, 2): "0", (1, 3): "1", (2, 0): "0"}
    names = frame(spark, [(1, "0", ["Ann Lee"])], "conv_id int, speaker_id string, names array<string>")
    told = {(r.conv_id, r.speaker_id): r.tokens for r in dialogue.speakers(old, names).collect()}
    assert told == {(1, "0"): ["ann", "lee"], (1, "1"): ["1"]}


SAID = "conv_id long, utt_idx int, text string, speaker_id string"
TALK = [(c, u, text, "ab"[u % 2]) for c in (1, 2) for u, text in enumerate(["Yesterday Ann Lee met Bob.", "Then she told him\nthat Bob knows.", None, "Lee left; he saw Ann Lee."])]


def rows_of(df):
    return sorted(tuple(r) for r in df.select("conv_id", "utt_idx", "m_idx", "mention", "best_ant", "root").collect())


def test_stream_equals_batch(spark, tmp_path):
    want = rows_of(stream.batch_coref(frame(spark, [*TALK, TALK[0], (None, 1, "Eve", "a"), (1, None, "Eve", "a")], SAID)))
    folder = tmp_path / "in"
    for k in (0, 1):
        frame(spark, [r for r in TALK if r[1] // 2 == k], SAID).coalesce(1).write.mode("append").parquet(str(folder))
    source = spark.readStream.schema(SAID).option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = stream.continuous_coref(source, str(tmp_path / "state"), availableNow=True)
    assert query.awaitTermination(180)
    assert rows_of(spark.read.parquet(str(tmp_path / "state" / "links"))) == want
    assert {r[1] for r in want} == {0, 1, 3} and any(b < m for _, _, m, _, b, _ in want)


def test_conversations_are_appended_repeated_and_replaced(spark, tmp_path):
    kept = stream.Conversations(spark, str(tmp_path / "talk"))
    first, second = (frame(spark, [r for r in TALK if r[1] // 2 == k], SAID) for k in (0, 1))
    parts = rows_of(kept.append(first, 0))
    again = rows_of(kept.append(second, 1))
    assert rows_of(kept.append(second, 1)) == again  # a batch that is repeated sees what it saw before
    assert sorted(parts + again) == rows_of(stream.batch_coref(frame(spark, TALK, SAID)))
    fresh = rows_of(kept.replace(second.where("conv_id = 1"), 2))
    assert [r[2] for r in fresh] == list(range(len(fresh))) and fresh == rows_of(stream.batch_coref(second.where("conv_id = 1")))
    assert min(r[2] for r in rows_of(kept.append(second.where("conv_id = 2").withColumn("utt_idx", F.col("utt_idx") + 9), 3))) > 0


def test_context_gives_antecedents_only(spark):
    context, new = frame(spark, TALK[:1], SAID), frame(spark, [(1, 5, "Then Ann Lee left.", None)], SAID)
    got = rows_of(stream.one_shot(new, context))
    assert [(r[3], r[4] < r[2]) for r in got if r[3] == "Ann Lee"] == [("Ann Lee", True)] and {r[1] for r in got} == {5}


def test_links_reach_over_the_band_where_words_meet(spark):
    names = [chr(97 + i // 26).upper() + chr(97 + i % 26) + "o" for i in range(70)]
    said = [(1, 0, "So Ann Lee left.", None), *((1, 1 + i, f"So {n} left.", None) for i, n in enumerate(names)), (1, 99, "So Ann Lee came.", None)]
    last = lambda df: [r for r in rows_of(df) if r[3] == "Ann Lee"][-1]
    far = last(stream.batch_coref(frame(spark, said, SAID)))
    near = last(stream.batch_coref(frame(spark, said, SAID), stream.Parameters(max_dist_match=60)))
    assert far[2] - far[4] > 60 >= near[2] - near[4]


def test_sides_of_pairs_with_missing_numbers(spark):
    m = frame(spark, [(1, i, f"w{i}") for i in (0, 2, 5)], "doc_id int, m_idx int, w string")
    p = frame(spark, [(1, 2, 0), (1, 5, 2), (1, 5, 1), (2, 1, 0)], "doc_id int, men_idx int, ant_idx int")
    assert sorted((r.men_idx, r.ant_idx, r.a.w, r.m.w) for r in pairs.with_sides(p, m).collect()) == [(2, 0, "w0", "w2"), (5, 2, "w2", "w5")]
    assert sorted((r.men_idx, r.ant_idx) for r in pairs.self_pairs(m).collect()) == [(0, 0), (2, 2), (5, 5)]


def test_pair_scores_equal_numpy(spark):
    rng = np.random.default_rng(3)
    layers, vec, dense = scoring.random_layers(2 * 3 + 2, (5,), 4), rng.random((6, 3)), rng.random((9, 2))
    pairs_ = [(1, 3, 1, dense[0].tolist()), (1, 3, 0, dense[1].tolist()), (2, 1, 0, dense[2].tolist()), (1, 3, 2, None), (1, 4, 3, dense[3].tolist())]
    df = frame(spark, pairs_, "doc_id int, men_idx int, ant_idx int, features array<double>")
    vectors = frame(spark, [(d, i, vec[i].tolist()) for d in (1, 2) for i in (3, 0, 1, 2)] + [(1, 4, None)], "doc_id int, m_idx int, embedding array<float>")
    got = {(r.doc_id, r.men_idx, r.ant_idx): r.score for r in scoring.score_pairs(df, vectors, layers, rows=1).collect()}
    for (d, i, j, _), x in zip(pairs_[:3], dense):
        assert got[d, i, j] == pytest.approx(scoring.forward(layers, np.r_[vec[j], vec[i], x][None])[0], rel=1e-5)
    assert len(got) == 5 and got[1, 3, 2] is None and got[1, 4, 3] is None


def test_scores_of_candidates_and_words(spark):
    p = frame(spark, [(1, 2, 1, 5.0), (1, 2, 0, 4.0)], "doc_id int, men_idx int, ant_idx int, score double")
    own = frame(spark, [(1, 2, 1.5), (1, 0, 0.5)], "doc_id int, m_idx int, score double")
    assert {r.m_idx: r.scores for r in scoring.candidate_scores(p, own).collect()} == {0: [0.5], 2: [4.0, 5.0, 1.5]}
    layers, matrix = scoring.random_layers(1 + 2 * 2 + 1, (4,), 7), np.arange(6.0).reshape(3, 2)
    rows = frame(spark, [(1, [2, 0], [0.5], [0.25]), (2, None, [0.5], [0.25]), (3, [1], [0.5], [0.25])], "i int, words array<int>, spans array<double>, features array<double>")
    got = {r.i: r.score for r in scoring.score_words(rows, layers, matrix).collect()}
    assert got[1] == pytest.approx(scoring.forward(layers, np.array([[0.5, 4, 5, 0, 1, 0.25]]))[0]) and got[2] is None and got[3] is None


def test_token_and_span_scores(spark):
    tokens, m, found = example(spark, [0, 1, 0, 1, 4])
    p = frame(spark, [("d", 2, 0, 3.0), ("d", 2, 1, 1.0)], "doc_id string, men_idx int, ant_idx int, score double")
    maps = coref.score_map(p, frame(spark, [("d", i, 0.5) for i in range(5)], "doc_id string, m_idx int, score double"))
    got = {r.tok_idx: [(x.m_idx, x.scores) for x in r.scores] for r in coref.annotate_tokens(tokens, found, m, maps).collect()}
    assert got[5] == [(2, {0: 3.0, 1: 1.0, 2: 0.5})] and got[1] == [] and got[10] == [(4, {4: 0.5})]
    spans = {r.m_idx: (r.is_coref, r.scores) for r in coref.annotate_spans(m, found, maps).collect()}
    assert spans[4] == (False, {4: 0.5}) and spans[2][0]


def test_unknown_profile(spark):
    from corefold.operators import mentions

    with pytest.raises(ValueError):
        mentions.extract_spans(spark.range(1), "other")
