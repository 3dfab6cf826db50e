"""Mention extraction and attributes over annotated tokens, for both rule profiles.

The rules that walk tokens one by one elsewhere are index arithmetic here, over the tokens of many sentences at a time:
a span's trimmed ends are the nearest tokens that may stay, which running maxima give for all tokens at once, and
children's outer edges are minima and maxima by head. Only a possessive mark's climb to its subject goes step by step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Word, tag and dependency lists of the mention rules.
NO_COREF_WORDS = ["i", "me", "my", "you", "your"]
KEEP_TAGS = ["NN", "NNP", "NNPS", "NNS", "PRP", "PRP$", "DT", "IN"]
CONTENT_TAGS = ["NN", "NNS", "NNP", "NNPS"]
PRONOUN_TAGS = ["PRP", "PRP$"]
PROPER_TAGS = ["NNP", "NNPS"]
CONJUNCTION_TAGS = ["CC", ","]
LEAVE_DEPS = ["det", "compound", "appos"]
KEEP_DEPS = ["nsubj", "dobj", "iobj", "pobj"]
SUBJECT_DEPS = ["nsubj", "dep"]
CONJUNCT_DEPS = ["conj", "prep"]
REMOVE_POS = ["CCONJ", "SCONJ", "INTJ", "ADP"]
REMOVE_WORDS = ["'s", ",", ".", "!", "?", ":", ";"]
ENTITY_LABELS = ["PERSON", "NORP", "FACILITY", "ORG", "GPE", "LOC", "PRODUCT", "EVENT", "WORK_OF_ART", "LANGUAGE"]
POSSESSIVE, MOST_CLIMBS = "'s", 100


def extract_spans(tokens: DataFrame, profile: str = "inference", blacklist: bool = True) -> DataFrame:
    """(doc_id, start, end): distinct candidate spans of the rules and of named entities.

    profile: ``inference`` or ``training``, which differ in the token filter, the possessive and the
    conjunct rules. blacklist: leave out first and second person words. Spans never leave their sentence. Tokens of a sentence are numbered
    without gaps, and their heads lie in it. A token gives rise to two spans at most, so that a cap of four for each never binds.
    """
    if profile not in ("inference", "training"):
        raise ValueError(profile)
    order = Window.partitionBy("doc_id", "sent_idx").orderBy("tok_idx")
    # The window puts the tokens of each sentence together, in order; a document's partitioning is reused.
    rows = tokens.select("doc_id", "sent_idx", *_FIELDS).withColumn("first", F.first("tok_idx").over(order))
    kind = tokens.schema["doc_id"].dataType.simpleString()
    spans = rows.mapInArrow(_span_rows(profile == "inference", blacklist), f"doc_id {kind}, start int, end int")
    return spans.unionByName(entities(tokens).select("doc_id", "start", "end")).where("end > start").distinct()


_FIELDS = ["tok_idx", "lower", "tag", "pos", "dep", "head", "l_edge", "r_edge", "n_lefts", "n_rights"]
_FAR = 1 << 40  # stands for "none" in minima, with a minus in maxima


def _span_rows(guarded: bool, blacklist: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            starts = np.flatnonzero(table["tok_idx"].to_numpy() == table["first"].to_numpy())
            last = int(starts[-1]) if len(starts) else 0  # the last sentence may go on in the next batch
            held = table.slice(last)
            if last:
                yield _Sentences(table.slice(0, last), guarded).spans(blacklist)
        if held is not None and held.num_rows:
            yield _Sentences(held, guarded).spans(blacklist)

    return run


class _Sentences:
    """The tokens of whole sentences as arrays. guarded: the inference profile, in which no trim goes past the ends of a sentence."""

    def __init__(self, table: pa.Table, guarded: bool) -> None:
        table = table.combine_chunks()
        self.guarded, self.doc = guarded, table["doc_id"].combine_chunks()
        self.i, self.head, self.l_edge, self.r_edge, first = (table[c].to_numpy().astype(np.int64) for c in ("tok_idx", "head", "l_edge", "r_edge", "first"))
        self.kids = (table["n_lefts"].to_numpy() > 0) | (table["n_rights"].to_numpy() > 0)
        self.text = {c: table[c].combine_chunks() for c in ("lower", "tag", "pos", "dep")}
        n = len(self.i)
        begins = np.flatnonzero(self.i == first)
        sentence = np.cumsum(self.i == first) - 1
        self.begin, self.end = begins[sentence], np.r_[begins[1:], n][sentence]
        self.first, self.last = first, self.i[self.end - 1]
        stays = ~(self._in("pos", REMOVE_POS) | self._in("lower", REMOVE_WORDS)) & self.text["pos"].is_valid().to_numpy(zero_copy_only=False)
        at = np.arange(n)
        before = np.maximum.accumulate(np.where(stays, at, -1))
        after = np.minimum.accumulate(np.where(stays, at, n)[::-1])[::-1]
        self.prev = np.where(before >= self.begin, self.i[np.maximum(before, 0)], -_FAR)
        self.next = np.where(after < self.end, self.i[np.minimum(after, n - 1)], _FAR)
        child = self.head != self.i
        self.c = self._edges(child)
        self.n = self._edges(child & self._in("dep", SUBJECT_DEPS))
        self.q = self._edges(child & ~self._in("dep", CONJUNCT_DEPS) & self.text["dep"].is_valid().to_numpy(zero_copy_only=False))

    def _in(self, column: str, words: list[str]) -> np.ndarray:
        return pc.is_in(self.text[column], pa.array(words)).to_numpy(zero_copy_only=False)

    def _like(self, column: str, pattern: str) -> np.ndarray:
        return pc.fill_null(pc.match_substring_regex(self.text[column], pattern), False).to_numpy(zero_copy_only=False)

    def _place(self, rows: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Where the tokens with these numbers lie, in the sentences of ``rows``."""
        return np.clip(self.begin[rows] + token - self.first[rows], self.begin[rows], self.end[rows] - 1)

    def _edges(self, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.full(len(self.i), _FAR), np.full(len(self.i), -_FAR)
        rows = np.flatnonzero(children)
        heads = self._place(rows, self.head[rows])
        np.minimum.at(low, heads, self.l_edge[rows])
        np.maximum.at(high, heads, self.r_edge[rows])
        return low, high

    def _trim(self, rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the ranges lo..hi, inclusive, without words that cannot begin or end a mention."""
        keep = np.maximum(self.prev[self._place(rows, hi)], lo - 1)
        last = np.minimum(hi, np.maximum(keep, self.first[rows]) if self.guarded else keep)
        start = np.minimum(self.next[self._place(rows, lo)], last + 1)
        return np.maximum(lo, np.minimum(start, self.last[rows]) if self.guarded else start), last + 1

    def spans(self, blacklist: bool) -> pa.RecordBatch:
        rows, begins, ends = self.found(blacklist)
        columns = [self.doc.take(pa.array(rows)), pa.array(begins.astype(np.int32)), pa.array(ends.astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "end"])

    def found(self, blacklist: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of a token in the span's sentence, start, end) of the rules' spans."""
        every = np.arange(len(self.i))
        leave, keep = self._in("dep", LEAVE_DEPS), self._in("dep", KEEP_DEPS)
        if self.guarded:
            pronoun, skip = self._in("tag", PRONOUN_TAGS), ~self._in("tag", KEEP_TAGS) | (leave & ~keep)
        else:
            pronoun, skip = self._like("tag", "^PRP"), (~self._like("tag", "^(N|PRP|DT|IN)") | leave) & ~keep
        for column in ("tag", "dep", "lower"):
            skip |= self.text[column].is_null().to_numpy(zero_copy_only=False)
        if blacklist:
            skip |= self._in("lower", NO_COREF_WORDS)
        mark = self._in("tag", ["IN"]) & self._in("dep", ["mark"])
        over = self._place(every, self.head)
        low, high = self.c
        if not self.guarded:  # a marker without children takes its head's
            bare = mark & (low == _FAR)
            low, high = np.where(bare, low[over], low), np.where(bare, high[over], high)
        start, end = self._trim(every, np.minimum(low, self.i), np.maximum(high, self.i))
        if self.guarded:  # a marker whose span is empty takes its head's
            empty = mark & (start == end)
            start, end = np.where(empty, start[over], start), np.where(empty, end[over], end)
        possessive = self._in("lower", [POSSESSIVE])
        plain = ~skip & ~pronoun & ~possessive
        good = plain & (end > start) & ~possessive[self._place(every, start)]
        rows, begins, ends = [], [], []

        def add(which: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
            rows.append(which)
            begins.append(lo)
            ends.append(hi)

        alone = np.flatnonzero(~skip & pronoun)
        add(alone, self.i[alone], self.i[alone] + 1)
        tree = alone[self.kids[alone]]
        add(tree, self.l_edge[tree], self.r_edge[tree] + 1)
        own = np.flatnonzero(good)
        add(own, start[own], end[own])
        if not self.guarded:
            joins = np.r_[0, np.cumsum(self._in("dep", CONJUNCT_DEPS))]
            inside = own[joins[self._place(own, end[own] - 1) + 1] > joins[self._place(own, start[own])]]
            lo, hi = self._trim(inside, np.minimum(self.q[0][inside], self.i[inside]), np.maximum(self.q[1][inside], self.i[inside]))
            add(inside, lo, hi)
        held = [x for x in map(self._possessor, np.flatnonzero(~skip & ~pronoun & possessive).tolist()) if x]
        if held:
            add(*(np.array(x, np.int64) for x in zip(*held)))
        rows, begins, ends = map(np.concatenate, (rows, begins, ends))
        real = ends > begins
        return rows[real], begins[real], ends[real]

    def _possessor(self, row: int) -> tuple[int, int, int] | None:
        """(row, start, end) of the span around the first subject that is met climbing the heads from a possessive mark."""
        at = np.array([row])
        place = lambda token: int(self._place(at, np.array([token]))[0])
        top = int(self.head[row])
        for _ in range(min(int(self.end[row] - self.begin[row]), MOST_CLIMBS)):
            here = place(top)
            if self.text["dep"][here].as_py() == "nsubj" or self.head[here] == top or (self.guarded and top == 0):
                break
            top = int(self.head[here])
        here = place(top)
        if self.text["dep"][here].as_py() != "nsubj" or (top == 0 if self.guarded else self.head[here] == top):
            return None
        if self.guarded:
            lo, hi = np.array([min(self.n[0][here], top)]), np.array([max(self.n[1][here], top)])
            start, end = (int(x[0]) for x in self._trim(at, lo, hi))
            return row, start, min(end + 1, int(self.last[row]) + 1)
        over = place(self.head[here])
        low, high = self.n[0][over], self.n[1][over]
        return row, int(low if low != _FAR else self.i[row]), int(high if high != -_FAR else self.i[row]) + 1


def entities(tokens: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, start, end, label): the named entities with an accepted label."""
    doc = Window.partitionBy("doc_id").orderBy("tok_idx").rowsBetween(Window.unboundedPreceding, 0)
    marked = tokens.withColumn("e", F.sum((F.col("ent_iob") == 3).cast("int")).over(doc)).where(F.col("ent_iob").isin(1, 3) & F.col("ent_type").isin(ENTITY_LABELS))
    return marked.groupBy("doc_id", "e").agg(F.min("tok_idx").alias("start"), (F.max("tok_idx") + 1).alias("end"), F.min("ent_type").alias("label"), F.min("sent_idx").alias("sent_idx")).drop("e")


def describe_mentions(spans: DataFrame, tokens: DataFrame) -> DataFrame:
    """Spans with index and attributes: the mentions table.

    A span's tokens are cut from the document's array, and its root is the token whose head lies outside the span. Mentions
    are numbered from 0 in each document by (root, start, end). ``nested`` tells whether another mention of the
    sentence holds this one. ``ent_label`` is the label of the first accepted entity that contains the span, ``span_ent`` that of
    the one entity, of any label, that all its tokens belong to. Tokens are numbered from 0 in each document, without gaps.
    """
    fields = ["tok_idx", "text", "ws", "lower", "tag", "head", "sent_idx", "start_char", "end_char", "ent_type", "ent_iob"]
    per_doc = tokens.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("all"))
    # One row for each span and document; the slice is a column of its own, so that the array is not carried along.
    m = spans.join(per_doc, "doc_id").select("doc_id", "start", "end", F.slice("all", F.col("start") + 1, F.col("end") - F.col("start")).alias("w"))
    outside = lambda x: (x["head"] < F.col("start")) | (x["head"] >= F.col("end")) | (x["head"] == x["tok_idx"])
    first, last = F.get("w", F.lit(0)), F.element_at("w", -1)
    split = lambda x: x["ent_iob"].isin(0, 2) | ((x["ent_iob"] == 3) & (x["tok_idx"] > F.col("start")))
    joint = lambda x: x["tag"].isin(CONJUNCTION_TAGS) & ~F.coalesce(x["ent_type"].isin(ENTITY_LABELS), F.lit(False))
    m = m.where(F.size("w") > 0).select(
        "doc_id", "start", "end", "w", F.coalesce(F.get(F.filter("w", outside), F.lit(0)), first).alias("r"), first["sent_idx"].alias("sent_idx"),
        first["start_char"].alias("start_char"), last["end_char"].alias("end_char"), F.exists("w", split).alias("not_one"), first["ent_type"].alias("first_ent"),
        F.exists("w", joint).alias("is_list"),
    )
    m = m.select("*", F.col("r.tok_idx").alias("root"), F.col("r.tag").alias("root_tag"), F.col("r.lower").alias("root_lower"), F.col("r.ent_type").alias("root_ent"))
    kind = F.when(F.col("is_list"), 3).when(F.col("root_tag").isin(PRONOUN_TAGS), 0).when(F.col("root_ent").isin(ENTITY_LABELS) | F.col("root_tag").isin(PROPER_TAGS), 2).otherwise(1)
    content = F.array_distinct(F.transform(F.filter("w", lambda x: x["tag"].isin(CONTENT_TAGS)), lambda x: x["lower"]))
    # The text of a span has the whitespace between its tokens but none after the last one.
    text = F.concat(F.array_join(F.transform(F.slice("w", 1, F.size("w") - 1), lambda x: F.concat(x["text"], x["ws"])), ""), F.element_at("w", -1)["text"])
    named = entities(tokens).select("doc_id", "sent_idx", F.col("start").alias("e_start"), F.col("end").alias("e_end"), "label")
    m = m.select("doc_id", "start", "end", "root", "sent_idx", "start_char", "end_char", kind.alias("mention_type"), "root_lower", "root_tag", F.lower(text).alias("span_lower"), text.alias("text"), content.alias("content_words"), F.when(~F.col("not_one"), F.col("first_ent")).alias("span_ent"))
    inside = m.select("doc_id", "sent_idx", "start", "end").join(named, ["doc_id", "sent_idx"]).where("e_start <= start and end <= e_end").groupBy("doc_id", "start", "end").agg(F.min_by("label", "e_start").alias("ent_label"))
    m = m.join(inside, ["doc_id", "start", "end"], "left")
    return with_nested(number_mentions(m))


def detect_mentions(tokens: DataFrame, profile: str = "inference", blacklist: bool = True) -> DataFrame:
    """``describe_mentions`` of ``extract_spans``: the same table in one pass over whole documents, many at a time.

    Tokens are put together by document, in order, and only mentions leave; a partitioning by document is reused.
    """
    if profile not in ("inference", "training"):
        raise ValueError(profile)
    return _in_one_pass(tokens.select("doc_id", "sent_idx", *_FIELDS, *_MORE_FIELDS), _mention_rows(profile == "inference", blacklist))


def located_mentions(places: DataFrame, tokens: DataFrame) -> DataFrame:
    """``describe_mentions`` of the spans (doc_id, start_char, end_char) that begin and end where tokens do, in one pass as in ``detect_mentions``.

    A document's spans are a map from their first characters, looked up at every token; tokens are neither sent nor put into arrays.
    """
    ends = places.groupBy("doc_id", "start_char").agg(F.collect_set("end_char").alias("ends"))
    per_doc = ends.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("start_char", "ends"))).alias("held"))
    fields = ["tok_idx", "lower", "tag", "head", *_MORE_FIELDS]
    rows = tokens.select("doc_id", "sent_idx", *fields).join(per_doc.hint("shuffle_hash"), "doc_id")
    return _in_one_pass(rows.select("doc_id", "sent_idx", *fields, F.col("held")[F.col("start_char")].alias("ends")), _mention_rows(False, False))


def missed_places(places: DataFrame, tokens: DataFrame, profile: str = "training", blacklist: bool = True) -> DataFrame:
    """(doc_id, start, end, label): the spans (doc_id, start_char, end_char, label) that begin and end where tokens do and that the rules do not find, each once.

    The rules' spans are compared where they are found: neither tokens nor mentions leave the batches.
    """
    kind, label = (places.schema[c].dataType.simpleString() for c in ("doc_id", "label"))
    rows = _with_places(places, tokens, "start_char", "end_char", "label")
    return rows.mapInArrow(whole_documents(lambda table: _missed_batch(table, profile == "inference", blacklist)), f"doc_id {kind}, start int, end int, label {label}")


def count_places(places: DataFrame, tokens: DataFrame, profile: str = "training", blacklist: bool = True) -> DataFrame:
    """(places, mentions, both), one row for each batch: spans as in ``missed_places`` without regard to labels, the rules' spans in their documents, and those that are both."""
    rows = _with_places(places, tokens, "start_char", "end_char")
    return rows.mapInArrow(whole_documents(lambda table: _counted_batch(table, profile == "inference", blacklist)), "places long, mentions long, both long")


def _with_places(places: DataFrame, tokens: DataFrame, *columns: str) -> DataFrame:
    """The tokens of documents with places, in order; a document's places go with its first token only."""
    per_doc = places.groupBy("doc_id").agg(F.collect_set(F.struct(*columns)).alias("places"))
    fields = ["doc_id", "sent_idx", *_FIELDS, "start_char", "end_char", "ent_type", "ent_iob"]
    rows = tokens.select(*fields).withColumn("row", F.row_number().over(Window.partitionBy("doc_id").orderBy("tok_idx")))
    return rows.join(per_doc.hint("shuffle_hash"), "doc_id").select(*rows.columns, F.when(F.col("row") == 1, F.col("places")).alias("places"))


def _in_one_pass(tokens: DataFrame, run) -> DataFrame:
    rows = tokens.withColumn("row", F.row_number().over(Window.partitionBy("doc_id").orderBy("tok_idx")))
    kind = tokens.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"doc_id {kind}, {_MENTION}")
    at = found.columns.index("text")
    return found.select(*found.columns[:at], F.lower("text").alias("span_lower"), *found.columns[at:])


_MORE_FIELDS = ["text", "ws", "start_char", "end_char", "ent_type", "ent_iob"]
_MENTION = (
    "start int, end int, root int, sent_idx int, start_char int, end_char int, mention_type int, root_lower string, root_tag string, text string, "
    "content_words array<string>, span_ent string, ent_label string, m_idx int, n_mentions int, nested boolean"
)


def _mention_rows(guarded: bool, blacklist: bool):
    """Batches of tokens in the order of documents to mentions.

    With a column ``ends`` the mentions are the spans from each token to those that end at these characters, instead of those of the rules.
    """
    return whole_documents(lambda table: _described_batch(table, guarded, blacklist))


def whole_documents(work: Callable[[pa.Table], pa.RecordBatch], least: int = 50_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` over batches of tokens in the order of documents, numbered by ``row``; ``least`` tokens and the rest of their last document at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            starts = np.flatnonzero(batch["row"].to_numpy() == 1)
            if len(starts) and n + starts[-1] >= least:  # the last document may go on in the next batch
                last = int(starts[-1])
                yield work(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held, n, batch = [], 0, batch.slice(last)
            held.append(batch)
            n += batch.num_rows
        if n:
            yield work(pa.Table.from_batches(held))

    return run


class _Tokens:
    """The tokens of whole documents as arrays. Named entities are runs of marked tokens with one number of beginnings so far."""

    def __init__(self, table: pa.Table) -> None:
        self.table = table.combine_chunks()
        self.column = {c: self.table[c].combine_chunks() for c in self.table.column_names}
        self.n, self.i, self.sent, self.iob = self.table.num_rows, self.number("tok_idx"), self.number("sent_idx"), self.number("ent_iob")
        self.opens = self.number("row") == 1
        self.doc = np.cumsum(self.opens) - 1
        self.first_rows = np.flatnonzero(self.opens)  # of documents
        self.begins = self.opens | np.r_[True, self.sent[1:] != self.sent[:-1]]
        self.sentence = np.cumsum(self.begins) - 1
        labels = sorted(ENTITY_LABELS)
        self.accepted = self.within("ent_type", labels)
        marked = np.flatnonzero(np.isin(self.iob, (1, 3)) & self.accepted)
        run = np.cumsum(self.iob == 3)
        turns = np.flatnonzero(np.r_[True, (run[marked][1:] != run[marked][:-1]) | (self.doc[marked][1:] != self.doc[marked][:-1])]) if len(marked) else marked
        code = pc.fill_null(pc.index_in(self.column["ent_type"], pa.array(labels)), -1).to_numpy().astype(np.int64)
        self.ent_lo, self.ent_hi = marked[turns], marked[np.r_[turns[1:], len(marked)] - 1] + 1 if len(marked) else marked
        self.ent_code, self.ent_sent = (np.minimum.reduceat(x[marked], turns) if len(marked) else marked for x in (code, self.sent))

    def number(self, column: str) -> np.ndarray:
        return pc.fill_null(self.column[column], -1).to_numpy().astype(np.int64)

    def within(self, column: str, words: list[str]) -> np.ndarray:
        return pc.fill_null(pc.is_in(self.column[column], pa.array(words)), False).to_numpy(zero_copy_only=False)

    def found(self, guarded: bool, blacklist: bool) -> np.ndarray:
        """The spans of the rules and of entities, each once and in order: first row * (n + 1) + row behind the last."""
        row, start, end = _Sentences(self.table.append_column("first", pa.array(self.i[self.begins][self.sentence])), guarded).found(blacklist)
        base = self.first_rows[self.doc][row]
        return np.unique(np.r_[(base + start) * (self.n + 1) + base + end, self.ent_lo * (self.n + 1) + self.ent_hi])

    def placed(self) -> tuple[np.ndarray, np.ndarray, pa.StructArray]:
        """(documents, spans as in ``found``, places) of the places that begin and end where tokens do."""
        lists = self.column["places"].take(pa.array(self.first_rows))
        places = lists.flatten()
        doc = np.repeat(np.arange(len(self.first_rows)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64))
        lo, hi = (self._row_of(c, doc, places.field(c)) for c in ("start_char", "end_char"))
        real = np.flatnonzero((lo >= 0) & (hi >= lo))
        return doc[real], lo[real] * (self.n + 1) + hi[real] + 1, places.take(pa.array(real))

    def _row_of(self, column: str, doc: np.ndarray, wanted: pa.Array) -> np.ndarray:
        """The rows of the documents' tokens with these numbers, -1 without one."""
        wanted, own = wanted.to_numpy(zero_copy_only=False).astype(np.int64), self.number(column)
        far = max(int(own.max()), int(wanted.max(initial=0))) + 2
        held, asked = self.doc * far + own + 1, doc * far + wanted + 1
        order = np.argsort(held, kind="stable")
        at = order[np.minimum(np.searchsorted(held[order], asked), self.n - 1)]
        return np.where(held[at] == asked, at, -1)


def _missed_batch(table: pa.Table, guarded: bool, blacklist: bool) -> pa.RecordBatch:
    t = _Tokens(table)
    _, spans, places = t.placed()
    missed = np.flatnonzero(~np.isin(spans, t.found(guarded, blacklist)))
    lo, hi = spans[missed] // (t.n + 1), spans[missed] % (t.n + 1)
    columns = [t.column["doc_id"].take(pa.array(lo)), *(pa.array(x.astype(np.int32)) for x in (t.i[lo], t.i[hi - 1] + 1)), places.field("label").take(pa.array(missed))]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "end", "label"])


def _counted_batch(table: pa.Table, guarded: bool, blacklist: bool) -> pa.RecordBatch:
    t = _Tokens(table)
    doc, spans, _ = t.placed()
    spans, found = np.unique(spans), t.found(guarded, blacklist)
    asked = np.bincount(doc, minlength=len(t.first_rows)) > 0
    counts = [len(spans), int(asked[t.doc[found // (t.n + 1)]].sum()), int(np.isin(spans, found).sum())]
    return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in counts], names=["places", "mentions", "both"])


def _described_batch(table: pa.Table, guarded: bool, blacklist: bool) -> pa.RecordBatch:
    own = _Tokens(table)
    column, number, within, n, i, sent, iob, doc, sentence, accepted = own.column, own.number, own.within, own.n, own.i, own.sent, own.iob, own.doc, own.sentence, own.accepted
    head = number("head")
    if "ends" in column:
        lo, hi = _located(column["ends"], doc, number("end_char"))
        key = np.unique(lo * (n + 1) + hi)
    else:
        key = own.found(guarded, blacklist)
    lo, hi = key // (n + 1), key % (n + 1)
    start, end, size, m = i[lo], i[hi - 1] + 1, hi - lo, len(lo)
    span = np.repeat(np.arange(m), size)
    at = np.arange(len(span)) + np.repeat(lo - (np.cumsum(size) - size), size)  # all spans' tokens, one after the other
    some = lambda flags: np.bincount(span[flags], minlength=m) > 0

    outside = np.flatnonzero((head[at] < start[span]) | (head[at] >= end[span]) | (head[at] == i[at]))[::-1]
    root = lo.copy()
    root[span[outside]] = at[outside]  # the first of a span is written last
    parted = some((iob[at] == -1) | (iob[at] == 0) | (iob[at] == 2) | ((iob[at] == 3) & (i[at] > start[span])))
    is_list = some((within("tag", CONJUNCTION_TAGS) & ~accepted)[at])
    kind = np.where(is_list, 3, np.where(within("tag", PRONOUN_TAGS)[root], 0, np.where(accepted[root] | within("tag", PROPER_TAGS)[root], 2, 1)))

    telling = np.flatnonzero(within("tag", CONTENT_TAGS)[at])
    words = pc.fill_null(pc.dictionary_encode(column["lower"]).indices, n).to_numpy().astype(np.int64)
    _, firsts = np.unique(span[telling] * (n + 1) + words[at[telling]], return_index=True)
    telling = telling[np.sort(firsts)]
    offsets = np.r_[0, np.cumsum(np.bincount(span[telling], minlength=m))].astype(np.int32)
    content = pa.ListArray.from_arrays(pa.array(offsets), column["lower"].take(pa.array(at[telling])))

    # The text of a span has the whitespace between its tokens but none after the last one.
    text, ws = column["text"].to_pylist(), column["ws"].to_pylist()
    parts = [t + w if t is not None and w is not None else "" for t, w in zip(text, ws)]
    place = np.r_[0, np.cumsum([len(x) for x in parts])]
    whole = "".join(parts)
    texts = [None if text[z] is None else whole[a:b] + text[z] for a, b, z in zip(place[lo].tolist(), place[hi - 1].tolist(), (hi - 1).tolist())]

    held = np.searchsorted(own.ent_lo, lo, "right") - 1
    label = pa.nulls(m, pa.string())
    if len(own.ent_lo):
        inside = (held >= 0) & (hi <= own.ent_hi[held]) & (own.ent_sent[held] == sent[lo])
        label = pa.array(sorted(ENTITY_LABELS)).take(pa.array(own.ent_code[held], mask=~inside))

    order = np.lexsort((hi, lo, root, doc[lo]))
    each = np.bincount(doc[lo], minlength=int(doc[-1]) + 1)
    number_in = np.empty(m, np.int64)
    number_in[order] = np.arange(m) - np.repeat(np.cumsum(each) - each, each)
    order = np.lexsort((-hi, lo, sentence[lo]))
    reach = np.r_[-1, np.maximum.accumulate(sentence[lo][order] * (n + 1) + hi[order])[:-1]] if m else order
    nested = np.empty(m, bool)
    nested[order] = reach >= sentence[lo][order] * (n + 1) + hi[order]

    ints = lambda x: pa.array(x.astype(np.int32))
    take = lambda c, rows: column[c].take(pa.array(rows))
    as_int = lambda c, rows: take(c, rows).cast(pa.int32())
    first_ent = column["ent_type"].take(pa.array(lo, mask=parted))
    columns = [
        take("doc_id", lo), ints(start), ints(end), ints(i[root]), as_int("sent_idx", lo), as_int("start_char", lo), as_int("end_char", hi - 1), ints(kind),
        take("lower", root), take("tag", root), pa.array(texts, pa.string()), content, first_ent, label, ints(number_in), ints(each[doc[lo]]), pa.array(nested),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", *(x.split()[0] for x in _MENTION.split(", "))])


def _located(ends: pa.Array, doc: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row, row behind the last) of the spans from each row to the rows of its document at whose ``last`` characters they end."""
    sizes = pc.fill_null(pc.list_value_length(ends), 0).to_numpy().astype(np.int64)
    lo = np.repeat(np.arange(len(doc)), sizes)
    wanted = ends.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    far = max(int(last.max(initial=0)), int(wanted.max(initial=0))) + 2
    places, asked = doc * far + last + 1, doc[lo] * far + wanted + 1
    order = np.argsort(places, kind="stable")
    at = order[np.minimum(np.searchsorted(places[order], asked), len(places) - 1)]
    real = (places[at] == asked) & (at >= lo)
    return lo[real], at[real] + 1


def number_mentions(mentions: DataFrame) -> DataFrame:
    """Add m_idx and n_mentions."""
    order = Window.partitionBy("doc_id").orderBy("root", "start", "end")
    return mentions.withColumn("m_idx", F.row_number().over(order) - 1).withColumn("n_mentions", F.count(F.lit(1)).over(Window.partitionBy("doc_id")).cast("int"))


def with_nested(mentions: DataFrame, within: tuple[str, ...] = ("doc_id", "sent_idx")) -> DataFrame:
    """Add nested: does another mention of the same group start no later and end no earlier?

    Without a join: in the order (start, end descending) a mention is held by an earlier one exactly if
    the largest end so far reaches its own; an equal span on either side holds it too.
    """
    order = Window.partitionBy(*within).orderBy(F.col("start"), F.col("end").desc())
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    twins = F.count(F.lit(1)).over(Window.partitionBy(*within, "start", "end")) > 1
    return mentions.withColumn("nested", F.coalesce(reach >= F.col("end"), F.lit(False)) | twins)


def show_mentions(tokens: DataFrame, profile: str = "inference", rows: int = 50) -> None:
    """Print the mentions that the rules find, without leaving out any words."""
    found = describe_mentions(extract_spans(tokens, profile, blacklist=False), tokens)
    found.select("doc_id", "m_idx", "text", "mention_type", "root_lower", "nested").orderBy("doc_id", "m_idx").show(rows, truncate=False)


def link_gold(mentions: DataFrame, gold: DataFrame) -> DataFrame:
    """Add gold_label: that of the gold span (doc_id, start, end, label) equal to the mention's; the smallest of several."""
    labels = gold.groupBy("doc_id", "start", "end").agg(F.min("label").alias("gold_label"))
    return mentions.join(labels, ["doc_id", "start", "end"], "left")


def undetected_gold(mentions: DataFrame, gold: DataFrame) -> DataFrame:
    """Gold spans that no mention equals."""
    return gold.join(mentions.select("doc_id", "start", "end"), ["doc_id", "start", "end"], "left_anti")
