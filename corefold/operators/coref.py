"""From scored pairs to links, clusters, main mentions, resolved texts and annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corefold.functions.features import NOMINAL, PRONOMINAL, PROPER
from corefold.operators.mentions import NO_COREF_WORDS


def best_links(pair_scores: DataFrame, single_scores: DataFrame, greedyness: float = 0.5) -> DataFrame:
    """(doc_id, men_idx, best_ant, best_score): every mention's best antecedent, itself where none is better than starting an entity.

    A pair must exceed the mention's single score less 50 * (greedyness - 0.5); of equal pairs the
    lowest antecedent wins. pair_scores: (doc_id, men_idx, ant_idx, score); single_scores: (doc_id, m_idx, score).
    """
    top = pair_scores.where(F.col("score").isNotNull()).groupBy("doc_id", "men_idx").agg(F.max(F.struct("score", (-F.col("ant_idx")).alias("back"))).alias("top"))
    alone = F.col("score") - 50 * (greedyness - 0.5)
    both = single_scores.withColumnRenamed("m_idx", "men_idx").join(top, ["doc_id", "men_idx"], "left")
    better = F.coalesce(F.col("top.score") > alone, F.lit(False))
    return both.select("doc_id", "men_idx", F.when(better, -F.col("top.back")).otherwise(F.col("men_idx")).alias("best_ant"), F.when(better, F.col("top.score")).otherwise(alone).alias("best_score"))


def forest_roots(links: DataFrame) -> DataFrame:
    """(doc_id, m_idx, best_ant, root): the entity of each mention, named by its smallest mention.

    Antecedents come earlier than mentions, so links form a forest in each document; a document's pointers are
    an array that is composed with itself until every entry is a root (a logarithmic number of times).
    """
    per_doc = links.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("men_idx").cast("int").alias("m_idx"), F.col("best_ant").cast("int").alias("best_ant")))).alias("l"))
    dense = F.element_at("l", -1)["m_idx"] + 1 == F.size("l")
    # Where numbers are missing, the places between two mentions point to themselves.
    entry = lambda i, x: F.struct(F.when(i == x["m_idx"], x["best_ant"]).otherwise(i).alias("best_ant"), (i == x["m_idx"]).alias("present"))
    upto = lambda x, k: F.coalesce(F.get("l", k + 1)["m_idx"] - 1, x["m_idx"])
    filled = F.flatten(F.transform("l", lambda x, k: F.transform(F.sequence(F.when(k == 0, F.lit(0)).otherwise(x["m_idx"]), upto(x, k)), lambda i: entry(i, x))))
    pointers = F.when(dense, F.transform("l", lambda x: x["best_ant"])).otherwise(filled["best_ant"])
    present = F.when(dense, F.transform("l", lambda x: F.lit(True))).otherwise(filled["present"])
    rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.size("p") + 1)).cast("int"))
    roots = F.aggregate(rounds, F.col("p"), lambda acc, _: F.transform(acc, lambda x: F.get(acc, x)))
    # The arrays are zipped by position, never looked up per element: a lookup would compute them again for each.
    zipped = per_doc.withColumn("p", pointers).select("doc_id", F.arrays_zip(F.col("p").alias("best_ant"), roots.alias("root"), present.alias("present")).alias("z"))
    found = zipped.select("doc_id", F.posexplode("z").alias("m_idx", "x")).where("x.present")
    return found.select("doc_id", "m_idx", "x.best_ant", "x.root")


def drop_singletons(members: DataFrame) -> DataFrame:
    return members.withColumn("cluster_size", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "root"))).where("cluster_size > 1")


def clusters(members: DataFrame, mention_types: DataFrame) -> DataFrame:
    """(doc_id, cluster, root, main, m_idx) of all entities with two mentions or more.

    cluster: dense number in the order of roots. main: the last mention that links to the root itself
    and, unlike the root in type, is a proper name, or a noun where the root is a pronoun; else the root.
    mention_types: (doc_id, m_idx, mention_type).
    """
    kinds = mention_types.select("doc_id", "m_idx", "mention_type")
    typed = drop_singletons(members).join(kinds, ["doc_id", "m_idx"])
    entity = Window.partitionBy("doc_id", "root")
    root_type = F.max(F.when(F.col("m_idx") == F.col("root"), F.col("mention_type"))).over(entity)
    typed = typed.withColumn("root_type", root_type)
    upgrade = (F.col("best_ant") == F.col("root")) & (F.col("m_idx") != F.col("root")) & more_telling(F.col("mention_type"), F.col("root_type"))
    main = F.coalesce(F.max(F.when(upgrade, F.col("m_idx"))).over(entity), F.col("root"))
    number = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("root")) - 1
    return typed.select("doc_id", number.alias("cluster"), "root", main.alias("main"), "m_idx")


def more_telling(new: Column, old: Column) -> Column:
    """Does a mention of type ``new`` name the entity better than one of type ``old``?"""
    return (new != old) & ((new == PROPER) | ((new == NOMINAL) & (old == PRONOMINAL)))


def running_representative(found: DataFrame, mention_types: DataFrame) -> DataFrame:
    """(doc_id, root, representative): the mention reached by upgrading, in order, whenever one names the entity better than the current one."""
    rows = found.join(mention_types.select("doc_id", "m_idx", "mention_type"), ["doc_id", "m_idx"]).groupBy("doc_id", "root").agg(F.array_sort(F.collect_list(F.struct(F.col("m_idx").cast("int").alias("m_idx"), F.col("mention_type").cast("int").alias("mention_type")))).alias("m"))
    best = F.aggregate(F.slice("m", 2, F.size("m")), F.col("m")[0], lambda acc, x: F.when(more_telling(x["mention_type"], acc["mention_type"]), x).otherwise(acc))
    return rows.select("doc_id", "root", best["m_idx"].alias("representative"))


def without_blacklist(found: DataFrame, mentions: DataFrame) -> DataFrame:
    """Clusters without first and second person words; an entity whose root goes is named by its next mention, and singletons go."""
    text = mentions.select("doc_id", "m_idx", "span_lower")
    kept = found.join(text, ["doc_id", "m_idx"]).where(~F.col("span_lower").isin(NO_COREF_WORDS)).drop("span_lower")
    kept = kept.withColumn("root", F.min("m_idx").over(Window.partitionBy("doc_id", "root")))
    return drop_singletons(kept).drop("cluster_size")


def token_writes(found: DataFrame, mentions: DataFrame) -> DataFrame:
    """(doc_id, tok_idx, seq, written): what resolving each mention writes to its tokens, null for the mention's last whitespace to be added."""
    spans = mentions.select("doc_id", "m_idx", "start", "end")
    mains = mentions.select("doc_id", F.col("m_idx").alias("main"), F.col("text").alias("main_text"))
    rows = found.where("m_idx <> main").join(spans, ["doc_id", "m_idx"]).join(mains, ["doc_id", "main"])
    return _cells(rows.withColumn("seq", F.struct("cluster", "m_idx")))


def _cells(rows: DataFrame) -> DataFrame:
    cells = rows.select("doc_id", "seq", "start", "end", "main_text", F.explode(F.sequence("start", F.col("end") - 1)).alias("tok_idx"))
    return cells.select("doc_id", "tok_idx", "seq", F.when(F.col("tok_idx") == F.col("start"), F.col("main_text")).alias("written"), (F.col("end") - 1).alias("last"))


def _rewritten(tokens: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, resolved): the tokens with the last write of each cell; a mention's text is followed by the whitespace after it."""
    last = cells.groupBy("doc_id", "tok_idx").agg(F.max_by(F.struct("written", "last"), "seq").alias("w"))
    spaces = tokens.select("doc_id", F.col("tok_idx").alias("last"), F.col("ws").alias("last_ws"))
    written = last.select("doc_id", "tok_idx", "w.written", "w.last").join(spaces, ["doc_id", "last"], "left")
    new = written.select("doc_id", "tok_idx", F.coalesce(F.concat("written", "last_ws"), F.lit("")).alias("new"))
    out = tokens.select(*keys, "tok_idx", F.concat("text", "ws").alias("old")).join(new, ["doc_id", "tok_idx"], "left")
    parts = F.array_sort(F.collect_list(F.struct("tok_idx", F.coalesce("new", "old").alias("t"))))
    return out.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("resolved"))


def resolve(tokens: DataFrame, found: DataFrame, mentions: DataFrame) -> DataFrame:
    """(doc_id, resolved): the text with every mention replaced by its entity's main mention.

    The first token of a mention becomes the main text with the whitespace after the mention, its other tokens
    nothing. Where mentions overlap, the later cluster and then the later mention decides. Documents without clusters keep their text.
    """
    return _rewritten(tokens, token_writes(found, mentions), ["doc_id"])


def resolve_utterances(tokens: DataFrame, found: DataFrame, mentions: DataFrame) -> DataFrame:
    """(doc_id, utt_idx, resolved): per utterance, from left to right, the first mention that starts at a token is replaced by its
    entity's lower-case main mention, and the scan goes on behind it.

    The scan only chooses mentions, over the array of an utterance's replaceable ones; the rewriting is that of ``resolve``.
    """
    mains = mentions.select("doc_id", F.col("m_idx").alias("main"), F.lower("text").alias("main_text"))
    swaps = found.where("m_idx <> main").join(mentions.select("doc_id", "m_idx", "start", "end"), ["doc_id", "m_idx"]).join(mains, ["doc_id", "main"])
    first = swaps.groupBy("doc_id", "start").agg(F.min_by(F.struct("end", "main_text"), "m_idx").alias("s")).select("doc_id", "start", "s.end", "s.main_text")
    placed = first.join(tokens.select("doc_id", "utt_idx", F.col("tok_idx").alias("start")), ["doc_id", "start"])
    fields = F.struct(*[F.col(c).cast("int").alias(c) for c in ("start", "end")], "main_text")
    per = placed.groupBy("doc_id", "utt_idx").agg(F.array_sort(F.collect_list(fields)).alias("all"))
    kind = per.schema["all"].dataType
    state = F.struct(F.lit(-1).alias("upto"), F.array().cast(kind).alias("kept"))
    step = lambda acc, x: F.when(x["start"] >= acc["upto"], F.struct(x["end"].alias("upto"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc)
    kept = per.select("doc_id", F.explode(F.aggregate("all", state, step)["kept"]).alias("x")).select("doc_id", "x.*")
    return _rewritten(tokens, _cells(kept.withColumn("seq", F.struct("start"))), ["doc_id", "utt_idx"])


def score_map(pair_scores: DataFrame, single_scores: DataFrame) -> DataFrame:
    """(doc_id, m_idx, scores): a map from each antecedent, and the mention itself, to its score."""
    rows = pair_scores.select("doc_id", F.col("men_idx").alias("m_idx"), "ant_idx", "score").unionByName(single_scores.select("doc_id", "m_idx", F.col("m_idx").alias("ant_idx"), "score"))
    return rows.groupBy("doc_id", "m_idx").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ant_idx", "score")))).alias("scores"))


def annotate_tokens(tokens: DataFrame, found: DataFrame, mentions: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """(doc_id, tok_idx, in_coref, clusters[, scores]): whether a token lies in a clustered mention, in which clusters, and the score maps of all mentions that cover it.

    scores: ``score_map``; the token's is an array of (m_idx, scores) in mention order, empty outside mentions.
    """
    spans = mentions.select("doc_id", "m_idx", "start", "end")
    extra = ["scores"] if scores is not None else []
    if scores is not None:
        spans = spans.join(scores, ["doc_id", "m_idx"], "left")
    kept = spans.join(found.select("doc_id", "m_idx", "cluster"), ["doc_id", "m_idx"], "left")
    covered = kept.where("end > start").select("doc_id", "m_idx", "cluster", *extra, F.explode(F.sequence("start", F.col("end") - 1)).alias("tok_idx"))
    sums = [F.sort_array(F.collect_set("cluster")).alias("clusters")]
    if scores is not None:
        sums.append(F.collect_list(F.struct("m_idx", "scores")).alias("scores"))
    per_token = covered.groupBy("doc_id", "tok_idx").agg(*sums)
    out = tokens.select("doc_id", "tok_idx").join(per_token, ["doc_id", "tok_idx"], "left")
    clusters_ = F.coalesce("clusters", F.array().cast("array<int>"))
    columns = ["doc_id", "tok_idx", (F.size(clusters_) > 0).alias("in_coref"), clusters_.alias("clusters")]
    if scores is not None:
        # mentions of one token are few; a map cannot be compared, so they are put in order by their numbers
        numbers = F.array_sort(F.transform("scores", lambda x: x["m_idx"]))
        ordered = F.transform(numbers, lambda i: F.filter("scores", lambda x: x["m_idx"] == i)[0])
        columns.append(F.coalesce(ordered, F.array().cast(per_token.schema["scores"].dataType)).alias("scores"))
    return out.select(*columns)


def annotate_spans(mentions: DataFrame, found: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Mentions with is_coref and, where true, the cluster and its main mention; with ``score_map`` also their scores."""
    out = mentions.join(found.select("doc_id", "m_idx", "cluster", "main"), ["doc_id", "m_idx"], "left").withColumn("is_coref", F.col("cluster").isNotNull())
    return out if scores is None else out.join(scores, ["doc_id", "m_idx"], "left")


def annotate_docs(docs: DataFrame, found: DataFrame, resolved: DataFrame) -> DataFrame:
    """Documents with has_coref, the number of clusters and the resolved text (the text itself where it has no tokens)."""
    counts = found.groupBy("doc_id").agg(F.countDistinct("cluster").alias("n_clusters"))
    out = docs.join(counts, "doc_id", "left").join(resolved, "doc_id", "left")
    return out.withColumn("n_clusters", F.coalesce("n_clusters", F.lit(0).cast("long"))).withColumn("has_coref", F.col("n_clusters") > 0).withColumn("resolved", F.coalesce("resolved", "text"))


def cluster_lines(found: DataFrame, mentions: DataFrame) -> DataFrame:
    """(doc_id, cluster, line): clusters as readable lines ``main: [mention, ...]``."""
    text = mentions.select("doc_id", "m_idx", "text")
    rows = found.join(text, ["doc_id", "m_idx"]).groupBy("doc_id", "cluster").agg(F.array_sort(F.collect_list(F.struct("m_idx", "text"))).alias("m"), F.max(F.when(F.col("m_idx") == F.col("main"), F.col("text"))).alias("main"))
    return rows.select("doc_id", "cluster", F.concat(F.col("main"), F.lit(": ["), F.array_join(F.transform("m", lambda x: x["text"]), ", "), F.lit("]")).alias("line"))


def payload(mentions: DataFrame, found: DataFrame, resolved: DataFrame) -> DataFrame:
    """(doc_id, payload): the JSON answer with mentions (character offsets, text, main text), clusters and resolved text; {} without coreference."""
    m = mentions.select("doc_id", "m_idx", "start_char", "end_char", "text")
    mains = mentions.select("doc_id", F.col("m_idx").alias("main"), F.col("text").alias("main_text"))
    rows = found.join(m, ["doc_id", "m_idx"]).join(mains, ["doc_id", "main"])
    per_cluster = rows.groupBy("doc_id", "cluster").agg(F.array_sort(F.collect_list(F.struct("m_idx", F.col("start_char").alias("start"), F.col("end_char").alias("end"), "text", F.col("main_text").alias("resolved")))).alias("m"))
    per_doc = per_cluster.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("cluster", "m"))).alias("c"))
    flat = F.transform(F.flatten(F.transform("c", lambda c: c["m"])), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), x["resolved"].alias("resolved")))
    texts = F.transform("c", lambda c: F.transform(c["m"], lambda x: x["text"]))
    body = F.to_json(F.struct(flat.alias("mentions"), texts.alias("clusters"), F.col("resolved")))
    return resolved.join(per_doc, "doc_id", "left").select("doc_id", F.when(F.col("c").isNull(), F.lit("{}")).otherwise(body).alias("payload"))


def follow_chains(links: DataFrame, asked: DataFrame, depth: int | None = None) -> DataFrame:
    """(doc_id, m_idx): the asked mentions and the antecedents they reach over links, at most ``depth`` of them if given.

    All pointers of a document are in one map, so a chain is followed in one expression, without a join per step.
    A chain has no more links than the map; steps behind its root look nothing up.
    """
    per_doc = links.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("men_idx").cast("int").alias("k"), F.col("best_ant").cast("int").alias("v")))).alias("to"))
    start = asked.select("doc_id", F.col("m_idx").cast("int").alias("m_idx")).join(per_doc, "doc_id")
    last = lambda acc: F.element_at(acc, -1)
    step = lambda acc, i: F.when((F.size(acc) < i) | (F.coalesce(F.col("to")[last(acc)], last(acc)) == last(acc)), acc).otherwise(F.concat(acc, F.array(F.col("to")[last(acc)])))
    chain = F.aggregate(F.sequence(F.lit(1), F.size("to") if depth is None else F.lit(depth)), F.array("m_idx"), step)
    return start.select("doc_id", F.explode(chain).alias("m_idx")).distinct()
