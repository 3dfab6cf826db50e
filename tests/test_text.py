import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corefold import runtime
from corefold.functions import features as feat
from corefold.functions import lexical
from corefold.operators import annotate, dialogue, embed, mentions, scoring, training
from corefold.plans import corpus, evaluate, pipeline
from corefold.sources import conll, vectors
from corefold.streaming import documents

TOKENS = "doc_id string, sent_idx int, tok_idx int, text string, lower string, ws string, tag string, pos string, dep string, head int, l_edge int, r_edge int, n_lefts int, n_rights int, ent_iob int, ent_type string, is_digit boolean, start_char int, end_char int"


def parsed(spark, words):
    """words: (text, tag, pos, dep, head, entity) of one sentence."""
    kids = {i: [j for j, w in enumerate(words) if w[4] == i and j != i] for i in range(len(words))}

    def subtree(i):
        return [i] + [x for j in kids[i] for x in subtree(j)]

    rows, at = [], 0
    for i, (text, tag, pos, dep, head, ent) in enumerate(words):
        s = subtree(i)
        rows.append(("d", 0, i, text, text.lower(), " ", tag, pos, dep, head, min(s), max(s), sum(j < i for j in kids[i]), sum(j > i for j in kids[i]), 3 if ent else 2, ent or None, False, at, at + len(text)))
        at += len(text) + 1
    return spark.createDataFrame(rows, TOKENS)


def spans(spark, words, profile="inference", blacklist=True):
    return {(r.start, r.end) for r in mentions.extract_spans(parsed(spark, words), profile, blacklist).collect()}


SISTER = [("My", "PRP$", "PRON", "poss", 1, ""), ("sister", "NN", "NOUN", "nsubj", 2, ""), ("has", "VBZ", "VERB", "ROOT", 2, ""), ("a", "DT", "DET", "det", 4, ""), ("dog", "NN", "NOUN", "dobj", 2, ""), (".", ".", "PUNCT", "punct", 2, "")]


def test_rules_on_a_plain_sentence(spark):
    assert spans(spark, SISTER) == {(0, 2), (3, 5)}
    assert spans(spark, SISTER, blacklist=False) == {(0, 1), (0, 2), (3, 5)}
    assert spans(spark, SISTER, "training") == {(0, 2), (3, 5)}


def test_conjuncts_split_in_training_only(spark):
    words = [("Ann", "NNP", "PROPN", "nsubj", 3, "PERSON"), ("and", "CC", "CCONJ", "cc", 0, ""), ("Bob", "NNP", "PROPN", "conj", 0, ""), ("left", "VBD", "VERB", "ROOT", 3, "")]
    assert spans(spark, words) == {(0, 1), (0, 3), (2, 3)}
    # Without its conjunct the first name keeps "and", which no mention may end with.
    assert spans(spark, words, "training") == {(0, 1), (0, 3), (2, 3)}
    plain = [(t, g, p, d, h, "") for t, g, p, d, h, _ in words]
    assert spans(spark, plain) == {(0, 3), (2, 3)}
    assert spans(spark, plain, "training") == {(0, 3), (0, 1), (2, 3)}


def test_possessive_climbs_to_the_subject(spark):
    words = [("Then", "RB", "ADV", "advmod", 4, ""), ("Ann", "NNP", "PROPN", "poss", 3, ""), ("'s", "NN", "PART", "case", 1, ""), ("dog", "NN", "NOUN", "nsubj", 4, ""), ("barks", "VBZ", "VERB", "ROOT", 4, "")]
    assert spans(spark, words) == {(1, 2), (1, 4), (3, 5)}  # the subject alone, one token longer than elsewhere
    assert spans(spark, words, "training") == {(1, 2), (1, 4)}
    first = [(t, g, p, d, h - 1, e) for t, g, p, d, h, e in words[1:]]
    assert spans(spark, first) == {(0, 1), (0, 3)}  # a climb that meets token 0 ends without a span


def test_marker_without_children_takes_its_heads_span(spark):
    words = [("that", "IN", "SCONJ", "mark", 2, ""), ("it", "PRP", "PRON", "nsubj", 2, ""), ("rained", "VBD", "VERB", "ROOT", 2, ""), ("hard", "RB", "ADV", "advmod", 2, "")]
    assert spans(spark, words) == {(1, 2), (1, 4)}


def test_mention_attributes(spark):
    tokens = parsed(spark, SISTER)
    m = {r.m_idx: r for r in mentions.describe_mentions(mentions.extract_spans(tokens, blacklist=False), tokens).collect()}
    assert [(m[i].start, m[i].end, m[i].root, m[i].mention_type, m[i].nested, m[i].text) for i in range(3)] == [(0, 1, 0, 0, True, "My"), (0, 2, 1, 1, False, "My sister"), (3, 5, 4, 1, False, "a dog")]
    assert m[1].content_words == ["sister"] and m[1].n_mentions == 3


def test_gold_labels_and_undetected_spans(spark):
    tokens = parsed(spark, SISTER)
    m = mentions.describe_mentions(mentions.extract_spans(tokens), tokens)
    gold = spark.createDataFrame([("d", 0, 2, "7"), ("d", 0, 2, "3"), ("d", 2, 3, "9")], "doc_id string, start int, end int, label string")
    assert {(r.m_idx, r.gold_label) for r in mentions.link_gold(m, gold).collect()} == {(0, "3"), (1, None)}
    assert [(r.start, r.label) for r in mentions.undetected_gold(m, gold).collect()] == [(2, "9")]


def test_annotation_of_awkward_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "  \n"), (None, "x"), (4, " He saw\nNew Bonn's  cat.")], "doc_id int, text string")
    got = annotate.annotate(df).orderBy("tok_idx").collect()
    assert [(r.text, r.tag, r.sent_idx, r.start_char) for r in got] == [("He", "PRP", 0, 1), ("saw", "NN", 0, 4), ("New", "NN", 1, 8), ("Bonn", "NNP", 1, 12), ("'s", "POS", 1, 16), ("cat", "NN", 1, 20), (".", ".", 1, 23)]
    assert set(annotate.annotate(df).columns) == set(annotate.TOKEN_COLUMNS)


def test_token_cleaning_and_normal_forms(spark):
    words = ["/.", "/?", "-LRB-", "a/b", "%%", "/", "*", "%", "", None, "50%", "Ab1"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").orderBy("i")
    assert [r[0] for r in df.select(lexical.clean_token(F.col("w"))).collect()] == [".", "?", "(", "ab", ",", "/", "*", "%", ",", ",", "50", "Ab1"]
    assert [r[0] for r in df.select(lexical.normalise_training(F.col("w"))).collect()][-3:] == ["<missing>", "00%", "ab0"]
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(lexical.file_extension(F.lit("a/b.V4_Gold"))) == ".v4_gold"
    assert one(lexical.contains_string(F.array(F.lit("Ann_Lee")), F.lit("ann lee"))) and one(lexical.from_bytes(lexical.to_bytes(F.lit("é")))) == "é"
    assert one(lexical.cache_name(F.lit("u"), F.lit(None).cast("string"))).count(".") == 0


def test_vector_positions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(feat.distance_bin(F.lit(d))) for d in (0, 1, 4, 5, 7, 8, 15, 16, 31, 32, 63, 64, 900)] == [0, 1, 4, 5, 5, 6, 6, 7, 7, 8, 8, 9, 9]
    a, m = F.array(*map(F.lit, [2, 1, 0, 4, 1, 5])), F.array(*map(F.lit, [0, 0, 3, 4, 0, 5]))
    v = one(feat.decode_pair(F.array(*map(F.lit, [1, 0, 0, 0, 1, 0, 6, 70, 1])), a, m))
    assert len(v) == 70 and [i for i, x in enumerate(v) if x == 1] == [0, 4, 11, 26, 27, 28, 31, 34, 45, 46, 50, 68]
    assert v[16] == pytest.approx(6 / 64) and v[61] == pytest.approx(3 / 4)
    assert len(one(feat.decode_mention(a))) == 24


CONLL = """#begin document (bc/x/00/x_0000); part 000
bc/x/00/x_0000 0 0 Ann NNP - - - - A - (1|(1
bc/x/00/x_0000 0 1 -LRB- NNP - - - - A - 1)
bc/x/00/x_0000 0 2 /. NNP - - - - A - 1)|(2)


bc/x/00/x_0000 0 0 %% NNP - - - - - - -
bc/x/00/x_0000 0 1 she NNP - - - - - - (1)

#end document
#begin document (nw/y); part 001
nw/y 1 0 End NN - - - - B - -

#end document
"""


def test_corpus_is_read_parsed_and_written_back(spark, tmp_path):
    (tmp_path / "a.v4_gold_conll").write_text(CONLL)
    (tmp_path / "a.v4_auto_conll").write_text(CONLL)
    (tmp_path / "b.v4_auto_conll").write_text("\n")
    files = conll.find_files(spark, str(tmp_path)).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.is_gold) for r in files) == [("a.v4_gold_conll", True), ("b.v4_auto_conll", False)]
    docs = conll.read_documents(spark, str(tmp_path / "a.v4_gold_conll"))
    tokens = conll.document_tokens(docs)
    utts = {(r.doc[:2], r.utt_idx): (r.tokens, r.speaker, r.text) for r in conll.utterances(tokens).collect()}
    assert utts == {("bc", 0): (["Ann", "(", "."], "A", "Ann ( . "), ("bc", 1): ([",", "she"], "-", ", she "), ("nw", 0): (["End"], "B", "End ")}
    found = conll.parse_brackets(tokens)
    assert sorted((r.utt_idx, r.label, r.start, r.end) for r in found.collect()) == [(0, "1", 0, 1), (0, "1", 0, 2), (0, "2", 2, 2), (1, "1", 1, 1)]
    order = found.withColumnRenamed("label", "cluster").withColumn("m_idx", F.col("start") * 100 - F.col("end"))
    texts = conll.document_texts(conll.coref_column(tokens, order))
    conll.write_documents(texts, str(tmp_path / "out"), 1)
    again = conll.read_documents(spark, str(tmp_path / "out"))
    back = conll.parse_brackets(conll.document_tokens(again, strict=False).withColumn("doc", F.col("doc")))
    assert sorted(map(tuple, back.select("utt_idx", "label", "start", "end").collect())) == [(0, "1", 0, 1), (0, "1", 0, 2), (0, "2", 2, 2), (1, "1", 1, 1)]
    entities = conll.scorer_entities(docs).collect()
    assert sorted((r.entity, r.mention) for r in entities) == [(1, "0:1"), (1, "0:2"), (1, "4:4"), (2, "2:2")]


@pytest.mark.parametrize("bad", ["(1", "1)", "x"])
def test_bad_brackets_raise(spark, bad):
    tokens = spark.createDataFrame([("d", 0, 0, bad), ("d", 0, 1, "-")], "doc string, utt_idx int, tok_idx int, coref string")
    with pytest.raises(PySparkException):
        conll.parse_brackets(tokens).collect()
    assert conll.parse_brackets(tokens, strict=False).collect() == []


def test_bad_lines_raise(spark):
    for old, new in ((" 0 1 -LRB-", " 0 2 -LRB-"), ("- A - 1)\n", "- C - 1)\n"), ("bc/x/00/x_0000 0 0 Ann", "bc/z 0 0 Ann")):
        raw = spark.createDataFrame([(CONLL.replace(old, new, 1).split("#end")[0],)], "raw string")
        with pytest.raises(PySparkException):
            conll.document_tokens(conll.parse_documents(raw)).collect()


def test_alignment(spark):
    df = spark.createDataFrame([(["can't", "go"], ["ca", "n't", "go"]), ([], [])], "conll array<string>, parsed array<string>")
    assert [r.lookup for r in conll.align_tokens(df).collect()] == [[[0, 1], [2]], []]


def numpy_average(vec, words):
    rows = [vec.get(w, vec["*UNK*"]) for w in words]
    return np.mean(rows, axis=0) if rows else np.zeros(2)


def test_document_embeddings_average_utterances(spark):
    """Utterance 2 is empty, 3 has punctuation only, 4 is empty and the last."""
    words = [(0, "a"), (0, "a"), (0, "b"), (1, "b"), (1, "."), (3, ".")]
    tokens = spark.createDataFrame([("d", 0, u, i, w, 0) for i, (u, w) in enumerate(words)], "doc_id string, sent_idx int, utt_idx int, tok_idx int, text string, head int")
    m = spark.createDataFrame([("d", 0, 0, 0, 1, 0)], "doc_id string, m_idx int, sent_idx int, start int, end int, root int")
    table = spark.createDataFrame([("static", "a", [1.0, 0.0]), ("static", "b", [0.0, 3.0]), ("static", ".", [9.0, 9.0]), ("static", "unknown", [7.0, 7.0])], "kind string, word string, vec array<double>")
    every = spark.createDataFrame([("d", u) for u in range(5)], "doc_id string, utt_idx int")
    block = lambda t, u: embed.mention_embeddings(m, t, table, 2, "training", None, u).first().embedding[8:10]
    total = np.array([2 / 3, 1.0]) + np.array([0.0, 3.0])
    assert np.allclose(block(tokens, every), total / 5)
    assert np.allclose(block(tokens, None), total / 4)
    assert np.allclose(block(tokens.drop("utt_idx"), None), [2 / 4, 6 / 4])


def test_mention_embeddings_equal_numpy(spark):
    static = {"*UNK*": [9.0, 9.0], "<missing>": [-1.0, -1.0], "my": [1.0, 0.0], "sister": [2.0, 5.0], "a": [3.0, 1.0], "dog": [4.0, 2.0], ".": [5.0, 5.0]}
    tuned = {"*UNK*": [8.0, 8.0], "<missing>": [-2.0, -2.0], "dog": [7.0, 7.0]}
    rows = [("static", w, v) for w, v in static.items()] + [("tuned", w, v) for w, v in tuned.items()]
    table = spark.createDataFrame(rows, "kind string, word string, vec array<float>")
    tokens = parsed(spark, SISTER)
    m = mentions.describe_mentions(mentions.extract_spans(tokens), tokens)
    got = {r.m_idx: np.array(r.embedding).reshape(13, 2) for r in embed.mention_embeddings(m, tokens, table, 2).collect()}
    words = [w[0].lower() for w in SISTER]
    word = lambda i: tuned["<missing>"] if not 0 <= i < 6 else tuned.get(words[i], static.get(words[i], tuned["*UNK*"]))
    want = [numpy_average(static, words[3:5]), numpy_average(static, words[0:3]), numpy_average(static, words[5:6]), numpy_average(static, words), np.zeros(2), *map(word, (4, 3, 4, 2, 5, 1, 6, 2))]
    assert np.allclose(got[1], want)
    conversions = embed.conversion_vectors(spark.createDataFrame([("Sister", ["dog", "a"]), ("none", [])], "word string, replacements array<string>"), table, 2)
    assert {r.word: r.vec for r in conversions.collect()} == {"sister": [5.0, 4.0], "none": [0.0, 0.0]}
    seen = embed.lookup(spark.createDataFrame([("sister",)], "key string"), "key", table, True, conversions).first()
    assert seen.vec == [5.0, 4.0]


def test_pipeline_scores_equal_numpy_and_model_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    model = {"single": scoring.random_layers(13 * 2 + 18, (4,), 1), "pair": scoring.random_layers(26 * 2 + 64 - 0, (4,), 2)}
    docs = spark.createDataFrame([(1, "Ann Lee met the man. She saw Ann Lee and the man."), (2, ""), (3, "It fell.")], "doc_id long, text string")
    words = ["*UNK*", "<missing>", "ann", "lee", "man", "she"]
    table = spark.createDataFrame([(k, w, rng.random(2).tolist()) for w in words for k in ("static", "tuned")], "kind string, word string, vec array<float>")
    out = pipeline.run(docs, model, table, parameters=pipeline.Parameters(width=2, greedyness=0.55))
    assert out.pair_scores.where("score is null").count() == 0 and out.single_scores.count() == out.mentions.count()
    assert out.document_annotations().count() == 3 and out.payloads().count() == 2 and out.scores().count() == out.mentions.count()
    ruled = pipeline.run(docs)
    assert ruled.clusters.where("doc_id = 1").count() >= 4
    assert {r.doc_id for r in ruled.lines().collect()} == {1}
    vectors.save_model(spark, str(tmp_path / "m"), model, {"greedyness": 0.5})
    back, config = vectors.load_model(spark, str(tmp_path / "m"))
    x = rng.random((5, 44))
    assert np.allclose(scoring.forward(back["single"], x), scoring.forward(model["single"], x)) and config == {"greedyness": 0.5}
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9, None)], "i int, features array<double>")
    got = {r.i: r.score for r in scoring.score_vectors(rows, model["single"]).collect()}
    assert np.allclose([got[i] for i in range(5)], scoring.forward(model["single"], x)) and got[9] is None


def batches_one_by_one(lengths, size):
    out, batch, num = [], [], 0
    for n, i in sorted((n, i) for i, n in enumerate(lengths)):
        if num > size or (batch and num == len(batch) and n):
            out.append(batch)
            batch, num = [], 0
        batch.append(i)
        num += n + 1
    return [*out, batch]


@pytest.mark.parametrize(("size", "seed"), [(10, 0), (25, 1), (3, 2), (100, 3)])
def test_batches_equal_the_sequential_rule(spark, size, seed):
    lengths = np.random.default_rng(seed).integers(0, 12, 80).tolist()
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "mention_id int, pairs_length int")
    got = {}
    for r in training.length_batches(df, size).collect():
        got.setdefault(r.batch, []).append((r.length, r.id))
    assert [[i for _, i in sorted(got[b])] for b in sorted(got)] == batches_one_by_one(lengths, size)


def test_padding_keeps_the_new_entity_last(spark):
    df = spark.createDataFrame([(1, 0, [1, 2, 9], [0.5, 0.5, 1.0]), (2, 0, [9], [2.0])], "mention_id int, batch int, labels array<int>, costs array<double>")
    got = {r.mention_id: (r.labels, r.costs, r.mask) for r in training.pad_batches(df, ["labels", "costs"]).collect()}
    assert got == {1: ([1, 2, 9], [0.5, 0.5, 1.0], [0, 0, 0]), 2: ([0, 0, 9], [0.0, 0.0, 2.0], [1, 1, 0])}


@pytest.mark.parametrize("stage", training.STAGES)
def test_slopes_are_derivatives(stage):
    rng = np.random.default_rng(1)
    layers = scoring.random_layers(3, (4,), 2)
    x, y, costs = rng.normal(size=(5, 3)), np.array([0.0, 1, 0, 1, 0]), np.array([1.0, 0, 1, 0, 0.8])
    flat, _ = training._backward(layers, x, stage, y, costs)
    at = 0
    for pair in layers:
        for value in pair:
            for i in np.ndindex(value.shape):
                old, values = value[i], []
                for step in (1e-6, -1e-6):
                    value[i] = old + step
                    values.append(training._slopes(stage, scoring.forward(layers, x), y, costs)[1])
                value[i] = old
                assert flat[at] == pytest.approx((values[0] - values[1]) / 2e-6, abs=1e-5)
                at += 1


def test_stages_lower_their_losses_and_keep_the_best(spark):
    rng = np.random.default_rng(5)
    rows = [(m, k, rng.normal(size=4)) for m in range(40) for k in range(3)]
    rows = [(m, k, v.tolist(), int(v[0] * v[1] > 0), 0.0 if v[0] * v[1] > 0 else 1.0) for m, k, v in rows]
    df = training.candidates(spark.createDataFrame(rows, "mention_id int, place int, features array<double>, label int, cost double").repartition(5))
    scores = iter([0.2, 0.9, 0.1, 0.3, 0.4, 0.2])
    kept = []
    done = training.train_stages(df, scoring.random_layers(4, (8,), 3), {"all_pairs": 4, "ranking": 2}, {"all_pairs": 0.05}, evaluate=lambda layers: kept.append(layers[0][0].copy()) or next(scores), fan_in=2)
    losses = [x[2] for x in done.scalars]
    assert [x[0] for x in done.scalars] == ["all_pairs"] * 4 + ["ranking"] * 2 and losses[3] < losses[0] and losses[5] < losses[4]
    assert np.array_equal(done.best[0][0], kept[4])  # the ranking stage starts from the best network of the one before, and has its own best
    assert done.table(spark).count() == 6
    assert training.train(df.limit(0), scoring.random_layers(4, (8,), 3)).scalars == []
    with pytest.raises(ValueError):
        training.train(df, done.layers, "other")


def test_batches_in_seeded_order_and_dumped(spark, tmp_path):
    b = spark.createDataFrame([(i, i % 7, i // 3) for i in range(21)], "id int, length int, batch int")
    one, two = ([r.batch for r in training.batch_order(b, seed).collect()] for seed in (1, 2))
    assert sorted(one) == sorted(two) == list(range(7)) and one != two
    training.write_batch_sizes(b, str(tmp_path / "sizes"))
    assert [r.value for r in spark.read.text(str(tmp_path / "sizes")).collect()][:2] == ["2\t3", "5\t3"]
    links = spark.createDataFrame([(10, 3, 1), (11, 3, 3)], "flat_idx int, n_pairs int, choice int")
    assert [r.linked for r in training.flat_links(links).orderBy("flat_idx").collect()] == [8, None]
    counts = spark.createDataFrame([(1, 4, 6), (2, 3, 4)], "doc_id int, n int, p int")
    assert [r.doc_id for r in training.array_invariants(counts).collect()] == [2]


def test_vectors_from_and_to_files(spark, tmp_path):
    np.save(tmp_path / "static_word_embeddings.npy", np.arange(6.0).reshape(3, 2))
    (tmp_path / "static_word_vocabulary.txt").write_text("*UNK*\ndog\ncat\n")
    static = vectors.read_embeddings(spark, str(tmp_path / "static_word"), "static", 2)
    assert {r.word: r.vec for r in static.collect()} == {"*UNK*": [0, 1], "dog": [2, 3], "cat": [4, 5]}
    tuned = vectors.tuned_from_static(static, spark.createDataFrame([("dog",), ("new",)], "word string"))
    assert {r.word: r.vec for r in tuned.collect()} == {"dog": [2, 3], "new": [0, 1]}
    vectors.write_embeddings(tuned, str(tmp_path / "tuned"))
    assert {r.word: r.vec for r in vectors.read_embeddings(spark, str(tmp_path / "tuned"), "tuned").collect()} == {"dog": [2, 3], "new": [0, 1]}
    with pytest.raises(PySparkException):
        vectors.read_embeddings(spark, str(tmp_path / "static_word"), "static", 3).collect()
    first = {r.word: r.vec for r in embed.initial_vectors(static, 4, 1).collect()}
    assert set(first) == {"*UNK*", "dog", "cat"} and all(len(v) == 4 and max(map(abs, v)) <= 0.5 for v in first.values()) and first["dog"] != first["cat"]
    ids = spark.createDataFrame([("dog", 4), ("<missing>", 9)], "word string, word_id int")
    assert {r.word: r.word_id for r in embed.word_ids(static.select("word"), ids).collect()} == {"dog": 4, "cat": 9, "*UNK*": 9}


def test_weights_and_arrays_from_files(spark, tmp_path):
    layers = {}
    for name in ("single_mention", "pair_mentions"):
        for i, shape in enumerate(((3, 2), (1, 3))):
            layers[name, i] = np.random.default_rng(i).random(shape)
            np.save(tmp_path / f"{name}_weights_{i}.npy", layers[name, i])
            np.save(tmp_path / f"{name}_bias_{i}.npy", np.ones((shape[0], 1)))
    got = vectors.read_weights(spark, str(tmp_path))
    assert np.array_equal(got["pair"][1][0], layers["pair_mentions", 1]) and got["single"][0][1].shape == (3,)
    folder = tmp_path / "arrays"
    folder.mkdir()
    for name, width in vectors.ARRAYS.items():
        np.save(folder / f"{name}.npy", np.arange(5 * width).reshape(5, width))
    m, p = vectors.read_arrays(spark, str(folder))
    assert m.count() == p.count() == 5 and p.orderBy("row").collect()[1].pairs_features == list(range(9, 18))
    np.save(folder / "pairs_features.npy", np.zeros((5, 8)))
    with pytest.raises(PySparkException):
        vectors.read_arrays(spark, str(folder))[1].collect()


def test_small_string_and_file_functions(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x \ny\nx\n")
    assert sorted(r.line for r in vectors.distinct_lines(spark, str(tmp_path / "a.txt")).collect()) == ["x", "y"]
    assert [r.value for r in conll.read_whole(spark, str(tmp_path / "a.txt")).collect()] == ["x \ny\nx\n"]
    row = spark.createDataFrame([('{"url": "u", "etag": "e"}', "x", [("a", " "), ("b", "")], ["ann"])], "j string, bad string, t array<struct<text:string,ws:string>>, names array<string>")
    got = row.select(lexical.cached_source(F.col("j")).alias("c"), lexical.cached_source(F.col("bad")).alias("b"), lexical.text_with_whitespace(F.col("t")).alias("t"), lexical.contains_token(F.col("names"), F.lit("ann")).alias("n")).first()
    assert (got.c.url, got.c.etag, got.t, got.n) == ("u", "e", "a b", True) and (got.b is None or got.b.url is None)


def test_one_row_each(spark):
    rows = [(i % 5 if i < 6 else i, f"w{i % 5 if i < 6 else i}") for i in range(9)] + [(None, "a"), (None, "b")]
    df = spark.createDataFrame(rows, "k int, w string")
    for most in (10, 0):
        assert sorted(map(tuple, runtime.one_row_each(df, "k", most).collect()), key=str) == sorted([*{r for r in rows if r[0] is not None}, (None, "a"), (None, "b")], key=str)
    assert runtime.one_row_each(df.limit(0), "k").collect() == []


def test_features_of_both_layouts(spark):
    one = dict(mention_type=2, start=1, end=4, m_idx=3, nested=True, sent_idx=1, root_lower="ann", root_tag="NNP", span_lower="ann lee", content_words=["ann", "lee"], ent_label="PERSON", speaker_id="x", speaker_tokens=["bob"], n_mentions=9, genre=2)
    two = dict(one, m_idx=7, start=6, end=7, mention_type=0, nested=False, sent_idx=3, root_lower="bob", span_lower="bob", content_words=["bob"], speaker_id="y", speaker_tokens=["ann", "lee"])
    schema = "struct<mention_type:int,start:int,end:int,m_idx:int,nested:boolean,sent_idx:int,root_lower:string,root_tag:string,span_lower:string,content_words:array<string>,ent_label:string,speaker_id:string,speaker_tokens:array<string>,n_mentions:int,genre:int>"
    df = spark.createDataFrame([(one, two)], f"a {schema}, m {schema}")
    a, m = F.col("a"), F.col("m")
    df = df.withColumn("f", feat.compressed_pair(a, m, *feat.speaker_flags(a, m), "training"))
    codes = [feat.compressed_mention(x, x["n_mentions"], x["genre"]) for x in (a, m)]
    row = df.select("f", feat.pair_features(a, m, F.col("f"), m["genre"]).alias("dense"), feat.decode_pair(F.col("f"), *codes).alias("decoded"), feat.single_features(m, m["n_mentions"], m["genre"]).alias("own"), feat.decode_mention(codes[1]).alias("own2")).first()
    assert row.f == [0, 1, 1, 0, 0, 0, 2, 3, 0] and row.dense == row.decoded and len(row.dense) == 70 and row.own == row.own2 and len(row.own) == 24
    assert row.dense[:6] == [0, 1, 1, 0, 0, 0] and row.dense[6 + 2] == 1 and row.dense[16] == 2 / 64 and row.dense[17 + 3] == 1


CORPUS = """#begin document (bc/x/00/x_0000); part 000
bc/x/00/x_0000 0 0 Then - - - - - Ann_Lee - -
bc/x/00/x_0000 0 1 Mary - - - - - Ann_Lee - (0
bc/x/00/x_0000 0 2 O'Neil - - - - - Ann_Lee - 0)
bc/x/00/x_0000 0 3 left - - - - - Ann_Lee - -
bc/x/00/x_0000 0 4 /. - - - - - Ann_Lee - -

bc/x/00/x_0000 0 0 She - - - - - Bob - (0)
bc/x/00/x_0000 0 1 saw - - - - - Bob - -
bc/x/00/x_0000 0 2 Ann - - - - - Bob - (1)
bc/x/00/x_0000 0 3 /. - - - - - Bob - -

#end document
"""


def test_corpus_from_files_to_arrays(spark, tmp_path):
    (tmp_path / "x.v4_gold_conll").write_text(CORPUS)
    c = corpus.read_corpus(spark, str(tmp_path / "x.v4_gold_conll"))
    words = {(r.start, r.end): r.label for r in c.gold.collect()}
    text = [r.text for r in c.tokens.orderBy("tok_idx").collect()]
    assert {(" ".join(text[a:b]), label) for (a, b), label in words.items()} == {("Mary O ' Neil", "0"), ("She", "0"), ("Ann", "1")}
    m = {r.text: r for r in c.mentions.collect()}
    assert m["She"].utt_idx == 1 and m["She"].speaker_id == "Bob" and m["She"].genre == 0 and m["Ann"].gold_label == "1"
    pairs_ = c.pair_arrays.collect()
    n = len(m)
    assert len(pairs_) == n * (n - 1) // 2 and sorted(r.pair_row for r in pairs_) == list(range(len(pairs_)))
    gold = corpus.read_corpus(spark, str(tmp_path / "x.v4_gold_conll"), use_gold_mentions=True)
    assert gold.undetected().count() == 0 and {r.text for r in gold.mentions.collect()} == {"Mary O'Neil", "She", "Ann"}
    got = sorted((r.men_idx, r.ant_idx, r.label, r.features[0]) for r in gold.pair_arrays.collect())
    assert got == [(1, 0, 1, 0), (2, 0, 0, 0), (2, 1, 0, 1)]
    scores = gold.pair_arrays.select("doc_id", "men_idx", "ant_idx", (F.col("label") * 2.0 - 1).alias("score"))
    single = gold.mentions.select("doc_id", "m_idx", F.lit(0.0).alias("score"))
    best = {r.metric: r.f1 for r in evaluate.evaluate(gold, scores, single).collect()}
    assert best["muc"] == 1.0 and best["bcub"] == pytest.approx(0.8)  # the single gold mention is no entity of the response
    written = conll.response_spans(gold.mentions, spark.createDataFrame([], "doc_id string, root int, m_idx int"), print_all_mentions=True)
    assert sorted(r.cluster for r in written.collect()) == [0, 1, 2]
    assert conll.response_spans(gold.mentions, spark.createDataFrame([], "doc_id string, root int, m_idx int"), True, True).where("cluster is not null").count() == 0


def test_plain_sentences_and_new_mentions(spark, tmp_path):
    (tmp_path / "x").write_text(CORPUS)
    rows = conll.document_tokens(conll.read_documents(spark, str(tmp_path / "x")))
    got = conll.sentence_texts(conll.utterances(rows)).first().value
    assert got == "#begin document (bc/x/00/x_0000); part 000\nThen Mary O'Neil left . \nShe saw Ann . \n#end document"
    u = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "conv_id int, utt_idx int, text string")
    added = spark.createDataFrame([(1, 1), (1, 1), (3, 0)], "conv_id int, utt_idx int")
    assert [r.text for r in dialogue.last_utterances(u, added).collect()] == ["b"]
    assert [r.text for r in dialogue.new_mentions(u, F.col("utt_idx") > 0).collect()] == ["b"]


def test_a_stream_of_documents_equals_a_table(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Yesterday Ann Lee left. Then she saw Ann Lee."), (2, "")], "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    assert documents.resolve_documents(source, str(tmp_path / "out"), availableNow=True).awaitTermination(180)
    got = spark.read.parquet(str(tmp_path / "out" / "documents")).drop("batch")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pipeline.run(docs).document_annotations().select(got.columns).collect()))


def test_corpus_of_nothing_and_of_awkward_utterances(spark):
    schema = "doc_id long, utt_idx int, words array<string>, speaker string, tokens string"
    gold = spark.createDataFrame([(1, 1, 0, 9, "0"), (1, 1, 0, 1, None), (1, 0, 0, 1, "1"), (1, 2, 0, 1, "1")], "doc_id long, utt_idx int, start int, end int, label string")
    rows = spark.createDataFrame([(1, 0, [], None, ""), (1, 1, None, "-", ""), (1, 2, ["%", None, "*x", "She"], None, ""), (2, 0, [], None, "")], schema)
    c = corpus.prepare(rows, gold)
    assert {(r.start, r.end, r.label) for r in c.gold.collect()} == {(0, 1, "1")} and {r.utt_idx for r in c.tokens.collect()} == {2}
    empty = corpus.prepare(rows.limit(0), gold.limit(0))
    assert empty.mention_arrays.count() == 0 and empty.pair_arrays.count() == 0


def test_entity_of_a_whole_span_and_shown_mentions(spark, capsys):
    words = [("Ann", "NNP", "PROPN", "compound", 1, "PERSON"), ("Lee", "NNP", "PROPN", "nsubj", 3, "PERSON"), ("Ltd", "NNP", "PROPN", "appos", 1, ""), ("left", "VBD", "VERB", "ROOT", 3, "")]
    tokens = parsed(spark, words).withColumn("ent_iob", F.when(F.col("tok_idx") == 1, 1).otherwise(F.col("ent_iob")))
    m = mentions.describe_mentions(spark.createDataFrame([("d", 0, 2), ("d", 0, 3), ("d", 1, 2)], "doc_id string, start int, end int"), tokens)
    assert {(r.start, r.end): r.span_ent for r in m.collect()} == {(0, 2): "PERSON", (0, 3): None, (1, 2): "PERSON"}
    mentions.show_mentions(tokens)
    assert "Ann Lee" in capsys.readouterr().out


def test_rules_for_markers_labels_and_pronoun_phrases(spark):
    """The rules that the stand-in annotation cannot trigger: a marker's span, an organisation, a possessive, the blacklist."""
    words = [("Acme", "NNP", "PROPN", "nsubj", 1, "ORG"), ("knows", "VBZ", "VERB", "ROOT", 1, ""), ("that", "IN", "ADP", "mark", 5, ""), ("the", "DT", "DET", "det", 4, ""), ("boat", "NN", "NOUN", "nsubj", 5, ""), ("sank", "VBD", "VERB", "ccomp", 1, "")]
    got, training_ = spans(spark, words), spans(spark, words, "training")
    assert (0, 1) in got and (3, 5) in got and (0, 1) in training_
    other = [(*w[:5], "CARDINAL" if w[5] else "") for w in words]
    assert spans(spark, other) == got  # the name is a subject as well
    tokens = parsed(spark, words)
    m = {r.span_lower: r for r in mentions.describe_mentions(mentions.extract_spans(tokens), tokens).collect()}
    assert m["acme"].mention_type == feat.PROPER and m["acme"].ent_label == "ORG" and m["the boat"].mention_type == feat.NOMINAL
