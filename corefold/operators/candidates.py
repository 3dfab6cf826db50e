"""Candidate pairs of whole documents as arrays: made, described and scored in Arrow batches, many documents at a time.

The pairs are those of ``pairs.candidate_pairs`` and their features those of ``features.pair_features`` and ``compressed_pair``. Mentions are sent
once, by document, and of a pair only its score leaves, or nothing but sums; its features are held for ``_PAIRS`` pairs at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corefold.functions.features import BIN_STARTS, SATURATION
from corefold.operators.scoring import Layers, _matrix, forward
from corefold.runtime import by_document

_FIELDS = ["m_idx", "sent_idx", "start", "end", "root_lower", "span_lower", "content_words"]
_OWN_FIELDS = ["mention_type", "n_mentions", "nested"]
_PAIRS, _MENTIONS = 50_000, 20_000


def score_network(mentions: DataFrame, layers: Layers, max_dist: int | None = 50, max_dist_match: int | None = 500) -> DataFrame:
    """``scoring.score_pairs`` of all candidate pairs of mentions with ``embedding``, in the inference profile: (doc_id, men_idx, ant_idx, score)."""
    model = mentions.sparkSession.sparkContext.broadcast(layers)  # bounded by the model

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        docs = _Documents(table, max_dist, max_dist_match)
        held, matrix = _matrix(docs.column["embedding"])
        at = np.cumsum(held) - 1
        for men, ant, relaxed in docs.pairs():
            score = np.full(len(men), np.nan)
            good = np.flatnonzero(held[men] & held[ant])
            dense = docs.dense(men[good], ant[good], relaxed[good])
            score[good] = forward(model.value, np.hstack([matrix[at[ant[good]]], matrix[at[men[good]]], dense]))
            yield docs.scored(men, ant, score)

    return _run(mentions, [*_OWN_FIELDS, "embedding"], run, "men_idx int, ant_idx int, score double")


def feature_sums(mentions: DataFrame, max_dist: int | None = 50, max_dist_match: int | None = 500) -> DataFrame:
    """(position, total): the sums of the dense features of all candidate pairs, in the inference profile."""

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        docs, total = _Documents(table, max_dist, max_dist_match), 0.0
        for men, ant, relaxed in docs.pairs():
            total = total + docs.dense(men, ant, relaxed).sum(axis=0)
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([docs.column["doc_id"].slice(0, 1).take(pa.array([0] * len(total))), pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["doc_id", "position", "total"])

    return _run(mentions, _OWN_FIELDS, run, "position int, total double").groupBy("position").agg(F.sum("total").alias("total"))


def score_rule(mentions: DataFrame, profile: str = "inference", max_dist: int | None = 50, max_dist_match: int | None = 500, compat_unsigned: bool = False, new: Column | None = None) -> DataFrame:
    """``scoring.rule_scores`` of all candidate pairs: (doc_id, men_idx, ant_idx, score). new: a condition on the later mention."""

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        docs = _Documents(table, max_dist, max_dist_match, compat_unsigned)
        for men, ant, relaxed in docs.pairs():
            score = 10 * docs.equal("span_lower", men, ant) + 5 * docs.heads(men, ant, profile) + 3 * relaxed - docs.bins(docs.number["m_idx"][men] - docs.number["m_idx"][ant] - 1)
            yield docs.scored(men, ant, score)

    flag = [] if new is None else [F.coalesce(new, F.lit(False)).alias("new")]
    return _run(mentions, [*(["ent_label"] if profile == "training" else []), *flag], run, "men_idx int, ant_idx int, score double")


def count_pairs(mentions: DataFrame, max_dist: int | None = 50, max_dist_match: int | None = 500) -> DataFrame:
    """(doc_id, men_idx, n, first, total): of each mention's candidate antecedents their number, the first one and the sum of their indices.

    Each document's mentions are in one partition, as ``mentions.detect_mentions`` leaves them: they are neither written nor sent. Bands are counted in closed form.
    """

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        docs = _Documents(table, max_dist, max_dist_match)
        for rows, *counts in docs.counts():
            numbers = [pa.array(x, kind) for x, kind in zip((docs.number["m_idx"][rows], *counts), (pa.int32(), pa.int64(), pa.int32(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([docs.column["doc_id"].take(pa.array(rows)), *numbers], names=["doc_id", "men_idx", "n", "first", "total"])

    rows = mentions.select("doc_id", F.col("m_idx").cast("int").alias("m_idx"), "content_words")
    return _in_order(rows, run, "men_idx int, n long, first int, total long")


def _run(mentions: DataFrame, more: list, run: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    numbers = [F.col(c).cast("int").alias(c) for c in _FIELDS[:4]]
    return _in_order(by_document(mentions, "doc_id", *numbers, *_FIELDS[4:], *more), run, schema)


def _in_order(placed: DataFrame, run: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    kind = placed.schema["doc_id"].dataType.simpleString()
    rows = placed.sortWithinPartitions("doc_id", "m_idx")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for part in parts:
            docs = part["doc_id"]
            # Where the part's last document begins, and whether that goes on from the part before.
            last = pc.index(docs, docs[-1]).as_py() if part.num_rows else 0
            if held and part.num_rows and not last and held[-1]["doc_id"][-1] != docs[0]:
                cut = True
            else:
                cut = last > 0
            if cut and n + last >= _MENTIONS:
                yield from run(pa.Table.from_batches([*held, part.slice(0, last)]).combine_chunks())
                held, n, part = [], 0, part.slice(last)
            if part.num_rows:
                held.append(part)
                n += part.num_rows
        if n:
            yield from run(pa.Table.from_batches(held).combine_chunks())

    return rows.mapInArrow(batches, f"doc_id {kind}, {schema}")


class _Documents:
    """The mentions of whole documents, in the order of their numbers."""

    def __init__(self, table: pa.Table, max_dist: int | None, max_dist_match: int | None, compat_unsigned: bool = False) -> None:
        self.column = {c: table[c].combine_chunks() for c in table.column_names}
        self.number = {c: self.column[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in (*_FIELDS[:4], *_OWN_FIELDS) if c in self.column}
        self.codes = {c: pc.fill_null(self.column[c].dictionary_encode().indices, -1).to_numpy().astype(np.int64) for c in ("root_lower", "span_lower", "ent_label") if c in self.column}
        self.n, m_idx = table.num_rows, self.number["m_idx"]
        docs = self.column["doc_id"].dictionary_encode().indices.to_numpy()
        self.doc = np.cumsum(np.r_[True, docs[1:] != docs[:-1]]) - 1
        first = np.searchsorted(self.doc, self.doc)
        far = int(m_idx.max()) + 1
        place = self.doc * far + m_idx
        back = far if max_dist is None else max_dist
        self.low = np.maximum(first, np.searchsorted(place, place - back))  # a mention's band is from here to the mention
        self.new = self.column["new"].to_numpy(zero_copy_only=False) if "new" in self.column else np.ones(self.n, bool)
        self.bands = np.where(self.new, np.arange(self.n) - self.low, 0)
        self.match = None if max_dist is None or max_dist_match is not None and max_dist_match <= max_dist else far if max_dist_match is None else max_dist_match
        self.least = max_dist_match if compat_unsigned and max_dist_match is not None else 0
        # The mentions of a word in a document are a run of ``same``; an occurrence's earlier ones are those before it in its run.
        lists = self.column["content_words"]
        owner = np.repeat(np.arange(self.n), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
        word = pc.fill_null(lists.flatten().dictionary_encode().indices, -1).to_numpy().astype(np.int64)
        owner, word = owner[word >= 0], word[word >= 0]
        key = self.doc[owner] * (int(word.max(initial=0)) + 1) + word
        both = np.unique(key * self.n + owner)
        key, self.same = both // self.n, both % self.n
        begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else key
        earlier = np.arange(len(key)) - np.repeat(begins, np.diff(np.r_[begins, len(key)]))
        reach = max(back, self.match or 0)
        self.earlier = np.where(self.new[self.same], np.minimum(earlier, reach), 0)
        self.by_mention = np.argsort(self.same, kind="stable")
        self.from_ = np.searchsorted(self.same[self.by_mention], np.arange(self.n + 1))
        if "mention_type" in self.column:
            own = [self.number["mention_type"][:, None] == np.arange(4), *self._distance(self.number["end"] - self.number["start"] - 1), self.number["m_idx"] / self.number["n_mentions"], self.number["nested"]]
            self.own = np.column_stack(own).astype(np.float64)

    @staticmethod
    def bins(distance: np.ndarray) -> np.ndarray:
        return np.searchsorted(BIN_STARTS, distance, "right")

    def _distance(self, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.bins(distance)[:, None] == np.arange(10), np.minimum(distance, SATURATION) / SATURATION

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows of mentions, rows of antecedents, whether content words meet), each pair once."""
        for lo, hi in self._parts(self.bands):
            bands = self.bands[lo:hi]
            base = np.cumsum(bands) - bands
            men = np.repeat(np.arange(lo, hi), bands)
            ant = np.arange(len(men)) - np.repeat(base - self.low[lo:hi], bands)
            relaxed = np.zeros(len(men), bool)
            later, sooner, near = self._sharing(lo, hi)
            relaxed[base[later[near] - lo] + sooner[near] - self.low[later[near]]] = True
            if self.match is not None:
                later, sooner = self._far(later[~near], sooner[~near])
                men, ant, relaxed = np.r_[men, later], np.r_[ant, sooner], np.r_[relaxed, np.ones(len(later), bool)]
            if len(men):
                yield men, ant, relaxed

    def counts(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(rows of mentions, number of antecedents, the first one's index, sum of their indices) of the mentions with antecedents."""
        m_idx = self.number["m_idx"]
        before = np.r_[0, np.cumsum(m_idx)]
        for lo, hi in self._parts(0 * self.bands):
            rows = np.arange(lo, hi)
            low = rows - self.bands[lo:hi]
            n, first, total = self.bands[lo:hi].copy(), m_idx[low], before[rows] - before[low]
            if self.match is not None:
                later, sooner, near = self._sharing(lo, hi)
                later, sooner = self._far(later[~near], sooner[~near])
                n += np.bincount(later - lo, minlength=hi - lo)
                np.add.at(total, later - lo, m_idx[sooner])
                np.minimum.at(first, later - lo, m_idx[sooner])
            some = n > 0
            yield rows[some], n[some], first[some], total[some]

    def _parts(self, bands: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of mentions with about ``_PAIRS`` pairs in their bands and by shared words."""
        cost = bands + np.bincount(self.same, weights=self.earlier, minlength=self.n).astype(np.int64)
        part = np.cumsum(cost) // _PAIRS
        cuts = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), self.n]
        return zip(cuts.tolist(), cuts[1:].tolist())

    def _sharing(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows of mentions from lo to hi, rows of earlier ones with the same word, whether these lie in the band), once for each shared word."""
        at = self.by_mention[self.from_[lo] : self.from_[hi]]
        times = self.earlier[at]
        later = np.repeat(self.same[at], times)
        step = np.arange(len(later)) - np.repeat(np.cumsum(times) - times, times) + 1
        sooner = self.same[np.repeat(at, times) - step]
        return later, sooner, sooner >= self.low[later]

    def _far(self, later: np.ndarray, sooner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each pair beyond the bands once, as far back as word matches may reach."""
        m_idx = self.number["m_idx"]
        fits = (m_idx[later] - m_idx[sooner] <= self.match) & (m_idx[later] >= self.least)
        more = np.unique(later[fits] * self.n + sooner[fits])
        return more // self.n, more % self.n

    def equal(self, column: str, men: np.ndarray, ant: np.ndarray) -> np.ndarray:
        """1 and 0, no number where one is null."""
        a, b = self.codes[column][ant], self.codes[column][men]
        return np.where((a < 0) | (b < 0), np.nan, a == b)

    def heads(self, men: np.ndarray, ant: np.ndarray, profile: str) -> np.ndarray:
        same = self.equal("root_lower", men, ant)
        if profile == "inference":
            return same
        label = self.codes["ent_label"]
        asked = np.flatnonzero((same != 1) & (label[ant] >= 0) & (label[ant] == label[men]))
        held = self._holds(men[asked], ant[asked]) | self._holds(ant[asked], men[asked])
        same[asked[held]] = 1
        return same

    def _holds(self, whole: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Do the spans of ``whole`` hold the head words of ``part``? Each span and word are compared once."""
        if not hasattr(self, "_texts"):
            self._texts = [self.column[c].dictionary_encode().dictionary.to_pylist() for c in ("span_lower", "root_lower")]
        spans, words = self._texts
        key = (self.codes["span_lower"][whole] + 1) * (len(words) + 1) + self.codes["root_lower"][part] + 1
        each, back = np.unique(key, return_inverse=True)
        inside = [s > 0 and w > 0 and words[w - 1] in spans[s - 1] for s, w in zip((each // (len(words) + 1)).tolist(), (each % (len(words) + 1)).tolist())]
        return np.array(inside, bool)[back]

    def dense(self, men: np.ndarray, ant: np.ndarray, relaxed: np.ndarray) -> np.ndarray:
        """The dense features of pairs in the inference profile, one row for each."""
        x, one = self.number, np.ones(len(men))
        flags = [one, 0 * one, 0 * one, self.equal("root_lower", men, ant), self.equal("span_lower", men, ant), relaxed]
        overlap = (x["sent_idx"][ant] == x["sent_idx"][men]) & (x["end"][ant] > x["start"][men])
        between = [*self._distance(x["sent_idx"][men] - x["sent_idx"][ant]), *self._distance(x["m_idx"][men] - x["m_idx"][ant] - 1)]
        return np.column_stack([*flags, *between, overlap, self.own[ant], self.own[men], 0 * one])

    def scored(self, men: np.ndarray, ant: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        numbers = [pa.array(self.number["m_idx"][x].astype(np.int32)) for x in (men, ant)]
        columns = [self.column["doc_id"].take(pa.array(men)), *numbers, pa.array(score.astype(np.float64), mask=np.isnan(score))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "men_idx", "ant_idx", "score"])
