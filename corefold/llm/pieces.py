"""Documents cut into pieces under a size limit, at natural boundaries, with overlap.

Method: a hierarchy of separators, tried from coarse to fine: section, paragraph, sentence, word, character. Where the
rest of a document does not fit, the piece ends at the last boundary of the coarsest level that has one within
the limit; so small units are packed greedily, and only a unit that is larger than the limit is cut by the next level.
Each piece repeats the last ``overlap`` units of the one before, and none is so short that it could not be repeated so far.

``cut_texts`` cuts texts, sized in characters. ``cut_documents`` cuts token arrays, sized in tokens: there an utterance is the
paragraph, a token is the word and the smallest unit, and sentence and token boundaries count only outside protected spans.

Scale: every document is cut on its own in an Arrow batch. Repeated rows are found by their ids alone; no document is
shuffled but those of repeated ids.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corefold.runtime import one_row_each

# Tokens that end a sentence, in both spellings, and closing marks that still belong to it.
SENTENCE_ENDS = [".", "!", "?", "/.", "/?", "...", "。", "！", "？"]
CLOSING_MARKS = ["''", "”", "’", ")", "]", "}", "-RRB-", "-RSB-", "-RCB-"]
LEVELS = ["end", "utterance", "sentence", "token", "inside a span"]
TEXT_LEVELS = ["end", "section", "paragraph", "sentence", "word", "character"]
# What separates the parts of a text; a separator belongs to the part before it.
BLANKS = " \t\r\n\f\v\u00a0\u3000"
SECTION = rf"\f[{BLANKS}]*|\n[ \t\r]*\n[ \t\r]*\n[{BLANKS}]*|\n[ \t\r]*[-=*_#]{{3,}}[ \t\r]*\n[{BLANKS}]*"
PARAGRAPH = rf"\n[ \t\r]*\n[{BLANKS}]*"
SENTENCE = rf"[.!?…]+[\"')\]}}”’»]*[{BLANKS}]+|[。！？]+[”’）」』]*[{BLANKS}]*|\n[{BLANKS}]*"
_PATTERNS = [re.compile(x) for x in (SECTION, PARAGRAPH, SENTENCE)]

Finder = Callable[[int, int], int | None]


def cut_documents(
    features: DataFrame, limit: int, overlap: int, id_col: str = "conll_doc_id", tokens_col: str = "conll_tokens", spans_col: str = "locations"
) -> DataFrame:
    """(id, piece, token_start, token_end, overlap, cut, tokens): the pieces of every document, numbered from 0.

    Positions count the tokens of all utterances in order; ``overlap`` is the number of leading tokens
    that repeat the piece before, ``cut`` names the kind of the boundary at the piece's end. A document within
    the limit is one piece. Spans are structs of span_start, span_end (exclusive) and utterance; those outside
    their utterance are clipped, null ones ignored. Null utterances count as empty, null tokens stay
    as they are. A document without tokens is one empty piece. Null ids are dropped, repeated rows of an id cut once.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    utterances = F.coalesce(F.transform(F.col(tokens_col), lambda u: F.coalesce(u, F.array().cast("array<string>"))), F.array().cast("array<array<string>>"))
    spans = F.filter(F.col(spans_col), lambda s: s["utterance"].isNotNull() & s["span_start"].isNotNull() & s["span_end"].isNotNull())
    field = lambda name: F.coalesce(F.transform(spans, lambda s: s[name].cast("int")), F.array().cast("array<int>"))
    once = one_row_each(features.select(id_col, tokens_col, spans_col).where(F.col(id_col).isNotNull()), id_col)
    flat = once.select(
        F.col(id_col).cast("long").alias("id"),
        F.flatten(utterances).alias("tokens"),
        F.transform(utterances, F.size).alias("sizes"),
        field("utterance").alias("su"),
        field("span_start").alias("ss"),
        field("span_end").alias("se"),
    )
    schema = "id long, piece int, token_start int, token_end int, overlap int, cut string, tokens array<string>"
    return flat.mapInArrow(_cut_rows(limit, overlap), schema).withColumnRenamed("id", id_col)


def cut_texts(documents: DataFrame, limit: int, overlap: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, char_start, char_end, overlap, cut, text): the pieces of every text, numbered from 0.

    Positions count characters (code points); ``overlap`` is the number of leading characters that repeat the piece
    before, ``cut`` names the kind of the boundary at the piece's end. A text within the limit is one piece, an
    empty or null one is one empty piece. Null ids are dropped, repeated rows of an id cut once. Other columns are
    ignored, whatever their names.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    named = documents.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).where("id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist()):
                finders = _text_finders(text) if len(text) > limit else []
                cuts = choose_cuts(len(text), finders, limit, overlap)
                rows += [(key, i, a, b, o, TEXT_LEVELS[level], text[a:b]) for i, (a, b, o, level) in enumerate(cuts)]
            kinds = [pa.int64(), *[pa.int32()] * 4, pa.string(), pa.string()]
            columns = [pa.array(x, k) for x, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "piece", "char_start", "char_end", "overlap", "cut", "text"])

    schema = "id long, piece int, char_start int, char_end int, overlap int, cut string, text string"
    return one_row_each(named, "id").mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _text_finders(text: str) -> list[Finder]:
    def word(reach: int, least: int) -> int | None:
        at = reach
        while at > least and (text[at - 1] not in BLANKS or text[at] in BLANKS):
            at -= 1
        return at if at > least else None

    return [*(sorted_finder(np.array([m.end() for m in p.finditer(text)], np.int64)) for p in _PATTERNS), word]


def sorted_finder(bounds: np.ndarray) -> Finder:
    """Looks up the last of the sorted positions that is at most ``reach`` and over ``least``."""

    def find(reach: int, least: int) -> int | None:
        i = np.searchsorted(bounds, reach, "right") - 1
        return int(bounds[i]) if i >= 0 and bounds[i] > least else None

    return find


def choose_cuts(n: int, finders: list[Finder], limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(start, end, overlap, level) of the pieces of n units. finders: for each level, coarse to fine, its last boundary in a range; level 0 is the end of all."""
    out, fresh, carried = [], 0, 0
    while True:
        reach = fresh + limit - carried
        if reach >= n:
            out.append((fresh - carried, n, carried, 0))
            return out
        least = max(fresh, fresh - carried + overlap - 1)  # what the next piece repeats must fit into this one
        end, level = reach, len(finders) + 1
        for k, find in enumerate(finders, 1):
            at = find(reach, least)
            if at is not None:
                end, level = at, k
                break
        out.append((fresh - carried, end, carried, level))
        carried, fresh = overlap, end


def _cut_rows(limit: int, overlap: int):
    ends, closing = pa.array(SENTENCE_ENDS), pa.array(CLOSING_MARKS)

    def levels_of(n: int, sizes: np.ndarray, ends: np.ndarray, closes: np.ndarray, su: np.ndarray, ss: np.ndarray, se: np.ndarray) -> list[Finder]:
        upto = np.cumsum(sizes)
        ok = (su >= 0) & (su < len(sizes))
        su, ss, se = su[ok], ss[ok], se[ok]
        base, size = (upto - sizes)[su], sizes[su]
        lo, hi = base + np.clip(ss, 0, size), base + np.clip(se, 0, size)
        inside = np.zeros(n + 2, np.int64)
        wide = hi - lo > 1
        np.add.at(inside, lo[wide] + 1, 1)
        np.add.at(inside, hi[wide], -1)
        free = np.cumsum(inside)[: n + 1] == 0
        after = np.flatnonzero(ends) + 1
        while True:  # closing marks stay with their sentence
            more = (after < n) & closes[np.minimum(after, max(n - 1, 0))] if n else np.zeros(0, bool)
            if not more.any():
                break
            after = after + more
        whole = np.unique(upto[(upto > 0) & (upto < n)])
        sentences = np.unique(after[(after < n)])
        return [sorted_finder(x) for x in (whole, sentences[free[sentences]], np.flatnonzero(free))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, ids = batch["tokens"], batch["id"]
            values = tokens.flatten()
            offsets = tokens.offsets.to_numpy() - tokens.offsets[0].as_py()
            is_end = pc.is_in(values, ends).to_numpy(zero_copy_only=False)
            is_close = pc.is_in(values, closing).to_numpy(zero_copy_only=False)
            lists = {c: [np.asarray(x, np.int64) for x in batch[c].to_pylist()] for c in ("sizes", "su", "ss", "se")}
            rows: list[tuple] = []
            for k in range(batch.num_rows):
                a, b = int(offsets[k]), int(offsets[k + 1])
                if b - a <= limit:
                    rows.append((k, 0, a, b, 0, 0))
                    continue
                levels = levels_of(b - a, lists["sizes"][k], is_end[a:b], is_close[a:b], lists["su"][k], lists["ss"][k], lists["se"][k])
                rows += [(k, i, a + s, a + e, o, level) for i, (s, e, o, level) in enumerate(choose_cuts(b - a, levels, limit, overlap))]
            at = np.array(rows, np.int64).reshape(-1, 6)
            first = offsets[at[:, 0]]
            sizes = at[:, 3] - at[:, 2]
            take = np.repeat(at[:, 2] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            pieces = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), values.take(pa.array(take)))
            small = lambda x: pa.array(x.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(at[:, 0])), small(at[:, 1]), small(at[:, 2] - first), small(at[:, 3] - first), small(at[:, 4]), pa.array([LEVELS[x] for x in at[:, 5]]), pieces],
                names=["id", "piece", "token_start", "token_end", "overlap", "cut", "tokens"],
            )

    return run
