"""Exact spans that texts of different records share, found by recompression and verified on their characters.

Method. Every text is parsed in rounds. A round names the current symbols by a fingerprint of
the characters that they stand for - a global name that needs no exchange, equal in all records -
and merges runs of one name and pairs (left, right) whose names fall on the left and the right side of
a hash-drawn partition of the alphabet. Symbols longer than the round's bound wait (restricted
recompression), so whether a boundary survives depends only on ``context`` characters to
either side: inside equal substrings the high-level boundaries are the same. Each boundary gets as key
the name of its surrounding ``2 * context`` characters, and each window of ``min_length`` characters is
represented by the boundary with the smallest key among those that its own characters fix. Windows
with equal text therefore have equal keys, and consecutive windows with one representative form a block.

Blocks whose key occurs in one record only hold no shared window. Of the others, a block whose whole
stretch occurs in another record is shared altogether; only the rest - the ends of shared spans - is compared
window by window, under the key.

Verification. Stretches and windows are grouped by key and a second fingerprint. Every member of a group is paired
with one that stands for it, in another record; pairs that continue each other are joined to runs; and the characters of
every run are compared with those at the other place. Keys for which any of them differ - fingerprints that collide -
are done again with the windows' own characters in place of fingerprints. So the result never depends on a fingerprint.

Long runs: a run symbol may cover a whole window. There the boundaries that the run rules had removed
are used again, after all others, so that no window lacks a representative.

Scale: no pairs of records are formed. One narrow row per block (about 100 characters of text) is written and
shuffled twice. Of the texts only those with unresolved blocks, and then those with runs, are shuffled: a
filter of their ids (``hashes.key_filter``, bounded) is applied in the scan. Minima and maxima are
combined before the shuffle, so a stretch that a third of all records share is no hot group; where its
members meet the record that stands for them, that record's text is cut into cells, one row each, and both
sides of the join are written tables, which adaptive execution can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corefold.llm.hashes import key_filter, may_hold, mix
from corefold.runtime import discard, stash

_BATCH_CHARS = 1 << 18
_CELL = 1024
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C55)


def shared_spans(documents: DataFrame, min_length: int, id_col: str = "doc_id", text_col: str = "text", name_bits: int = 64) -> DataFrame:
    """(id, span_start, span_end): the maximal runs of characters that lie in a stretch of ``min_length``
    characters occurring verbatim in the text of another id.

    Positions count characters (code points) from 0, the end is exclusive. Repetition within one id, and
    repeated rows of one id, share nothing; an id has one text. Null ids, null texts and texts shorter than ``min_length``
    give no rows, nor does an empty table. Long texts are read in overlapping segments, whole. Other
    columns are ignored, whatever their names. name_bits: length of the fingerprints of stretches and windows; it
    does not change the result, only how often characters have to be grouped instead.
    """
    if min_length < 4:
        raise ValueError("min_length must be at least 4")
    spark = documents.sparkSession
    texts = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    texts = texts.where(F.length("text") >= min_length)
    blocks = stash(texts.mapInArrow(_block_rows(min_length, name_bits), "key long, stretch long, id long, start int, n int"), "blocks")
    keys = blocks.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("key")
    keys = stash(keys, "keys")  # both sides of the join are then plain exchanges, which adaptive execution can split
    candidates = stash(blocks.join(keys, "key", "left_semi"), "candidates")
    discard(spark, blocks, keys)

    place = F.struct("id", "start", "n")
    kinds = stash(candidates.groupBy("key", "stretch").agg(F.min(place).alias("one"), F.max(place).alias("two")), "kinds")
    judged = candidates.join(kinds, ["key", "stretch"]).withColumn("rep", _other_place("one", "two"))
    judged = stash(judged.select("key", "id", "start", "n", "rep"), "judged")
    discard(spark, candidates)

    unresolved = judged.where("rep is null").select("key", "id", "start", "n", F.lit(False).alias("model"))
    models = kinds.where("one.id <> two.id").join(unresolved.select("key").distinct(), "key", "left_semi")
    unresolved = unresolved.unionByName(models.select("key", "one.*", F.lit(True).alias("model")))
    per_text = stash(unresolved.groupBy("id").agg(F.collect_set(F.struct("key", "start", "n", "model")).alias("wants")), "unresolved")
    windows = _texts_with(texts, per_text).mapInArrow(_window_rows(min_length, name_bits), "key long, name long, id long, start int, model boolean")
    windows = stash(windows, "windows")
    discard(spark, kinds, per_text)
    place = F.struct("id", "start")
    names = windows.groupBy("key", "name").agg(F.min(place).alias("one"), F.max(place).alias("two"), F.max(F.when(F.col("model"), place)).alias("m"))
    names = stash(names.where("one.id <> two.id or m is not null"), "names")
    single = windows.where("not model").join(names, ["key", "name"]).withColumn("rep", F.coalesce(_other_place("one", "two"), "m"))

    shared = judged.where("rep is not null").select("key", "id", "start", "n", "rep.id", "rep.start").toDF("key", "id", "start", "n", "rid", "rstart")
    shared = shared.unionByName(single.select("key", "id", "start", F.lit(1), "rep.id", "rep.start").toDF("key", "id", "start", "n", "rid", "rstart"))
    runs = stash(_runs(shared, min_length), "runs")
    differing = stash(_differing(texts, runs), "differing")
    found = runs.select("id", "lo", "hi")
    if not differing.isEmpty():
        found = stash(_by_characters(texts, judged, shared, differing, min_length), "found")
    discard(spark, judged, windows, names, differing)
    return _islands(found).withColumnRenamed("id", id_col)


def _other_place(one: str, two: str):
    """The first of two places in another record than this row's; null without one."""
    differ = F.col(f"{one}.id") != F.col(f"{two}.id")
    return F.when(differ, F.when(F.col("id") != F.col(f"{one}.id"), F.col(one)).otherwise(F.col(two)))


def _texts_with(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts joined with the written table ``wanted`` (id, ...); texts of other ids are dropped in the scan, as far as the filter can tell."""
    words = key_filter(wanted.select(F.col("id").alias("key")), wanted.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_hold(words, batch["id"].to_numpy(zero_copy_only=False))))

    return texts.mapInArrow(run, "id long, text string").join(wanted, "id")


def _runs(shared: DataFrame, width: int) -> DataFrame:
    """(id, rid, delta, lo, hi): characters lo to hi of id said to equal those at a distance of delta in rid, joined where they touch."""
    rows = shared.select("id", "rid", (F.col("rstart") - F.col("start")).alias("delta"), F.col("start").alias("lo"), (F.col("start") + F.col("n") - 1 + width).alias("hi"))
    return _joined(rows, ["id", "rid", "delta"]).select("id", "rid", "delta", "lo", "hi")


def _joined(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """The overlapping or touching intervals (lo, hi) of each key merged."""
    order = Window.partitionBy(*keys).orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("first", F.coalesce((F.col("lo") > before).cast("int"), F.lit(1)))
    numbered = marked.withColumn("island", F.sum("first").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _islands(intervals: DataFrame) -> DataFrame:
    return _joined(intervals, ["id"]).select("id", F.col("lo").alias("span_start"), F.col("hi").alias("span_end"))


def _differing(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """(id, rid, lo, hi): parts of runs whose characters are not those of the place that they are said to equal.

    The text of rid is taken in cells of a fixed size, however many runs point there, and runs are cut at their limits.
    """
    spark = texts.sparkSession
    cells = F.sequence(F.floor((F.col("lo") + F.col("delta")) / _CELL), F.floor((F.col("hi") + F.col("delta") - 1) / _CELL))
    parts = runs.select("*", F.explode(cells).alias("cell"))
    begin = F.col("cell") * _CELL
    lo, hi = F.greatest("lo", begin - F.col("delta")).cast("int"), F.least("hi", begin + _CELL - F.col("delta")).cast("int")
    parts = parts.select("id", "rid", "cell", lo.alias("lo"), hi.alias("hi"), (lo + F.col("delta") - begin).cast("int").alias("at"))
    whole = parts.select("rid", "cell").distinct().select(F.col("rid").alias("id"), "rid", "cell", begin.cast("int").alias("lo"), (begin + _CELL).cast("int").alias("hi"), F.lit(-1).alias("at"))
    wanted = parts.unionByName(whole).groupBy("id").agg(F.collect_set(F.struct("rid", "cell", "lo", "hi", "at")).alias("wants"))
    wanted = stash(wanted, "wanted")
    cut = stash(_texts_with(texts, wanted).mapInArrow(_cut_rows, "id long, rid long, cell long, lo int, hi int, at int, part string"), "parts")
    models = cut.where("at < 0").select("rid", "cell", F.col("part").alias("model"))
    equal = F.expr("substring(model, at + 1, hi - lo)") == F.col("part")
    both = cut.where("at >= 0").join(models, ["rid", "cell"], "left").where(~F.coalesce(equal, F.lit(False)))
    out = stash(both.select("id", "rid", "lo", "hi"), "unequal")
    discard(spark, wanted, cut)
    return out


def _by_characters(texts: DataFrame, judged: DataFrame, shared: DataFrame, differing: DataFrame, width: int) -> DataFrame:
    """(id, lo, hi) of all shared windows, where the keys of differing runs are done by the windows' own characters."""
    far = F.col("start") + F.col("n") - 1 + width
    wrong = differing.select(F.col("id").alias("i"), F.col("rid").alias("r"), "lo", "hi")
    keys = shared.join(wrong, (F.col("id") == F.col("i")) & (F.col("rid") == F.col("r")) & (F.col("start") < F.col("hi")) & (far > F.col("lo")))
    keys = stash(keys.select("key").distinct(), "wrong-keys")
    sound = shared.join(keys, "key", "left_anti").select("id", F.col("start").alias("lo"), far.alias("hi"))
    again = judged.join(keys, "key", "left_semi").groupBy("id").agg(F.collect_set(F.struct("key", "start", "n")).alias("wants"))
    windows = _texts_with(texts, stash(again, "again")).mapInArrow(_plain_windows(width), "key long, id long, start int, part string")
    windows = stash(windows, "plain-windows")
    held = windows.groupBy("key", "part").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("key", "part")
    found = windows.join(stash(held, "held"), ["key", "part"], "left_semi")
    return sound.unionByName(found.select("id", F.col("start").alias("lo"), (F.col("start") + width).alias("hi")))


def shared_shares(documents: DataFrame, min_length: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, n_spans, shared_chars, shared_share) for every id; a null text has 0 characters, an empty one the share 0."""
    length = (F.col("span_end") - F.col("span_start")).cast("long")
    sums = shared_spans(documents, min_length, id_col, text_col).groupBy(id_col).agg(F.count(F.lit(1)).alias("n_spans"), F.sum(length).alias("shared_chars"))
    n_chars = F.coalesce(F.length(text_col), F.lit(0)).cast("long")
    lengths = documents.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias(id_col), n_chars.alias("n_chars"))
    lengths = lengths.groupBy(id_col).agg(F.max("n_chars").alias("n_chars"))
    zero = F.lit(0).cast("long")
    shared = F.coalesce("shared_chars", zero)
    share = F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(F.lit(0.0))
    return lengths.join(sums, id_col, "left").select(
        id_col, "n_chars", F.coalesce("n_spans", zero).alias("n_spans"), shared.alias("shared_chars"), share.alias("shared_share")
    )


# --- the parse, vectorised over a few hundred thousand characters at a time ---


class _Prefixes:
    """Fingerprints of all substrings of an array of characters: sums of characters times powers, rebased to 0."""

    _tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, codes: np.ndarray, base: np.uint64) -> None:
        n = len(codes) + 1
        if int(base) not in self._tables or len(self._tables[int(base)][0]) < n:
            size, inverse = max(n, 2 * _BATCH_CHARS), _U(pow(int(base), -1, 1 << 64))
            self._tables[int(base)] = tuple(np.multiply.accumulate(np.r_[_U(1), np.full(size - 1, b)]) for b in (base, inverse))
        self.powers, self.inverses = self._tables[int(base)]
        self.chars = codes.astype(np.uint64) + _U(0x51_7CC1B727220A95)
        self.chars *= base
        self.chars ^= self.chars >> _U(29)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(self.chars * self.powers[: n - 1], out=self.sums[1:])

    def names(self, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
        x = self.sums[end]
        x -= self.sums[start]
        x *= self.inverses[start]
        x += _U(seed * 0x2545F4914F6CDD1D % (1 << 64))
        return mix(x)


def _prints(codes: np.ndarray, start: np.ndarray, end: np.ndarray, bits: int) -> np.ndarray:
    """Fingerprints of stretches of characters, from the characters themselves."""
    data, digest = memoryview(codes).cast("B"), xxhash.xxh3_64_intdigest
    out = np.fromiter((digest(data[a:b], 79) for a, b in zip((4 * start).tolist(), (4 * end).tolist())), _U, len(start))
    return (out & _U((1 << bits) - 1)).view(np.int64)


def _bounds_by_round(context: int) -> list[int]:
    """The longest symbol that each round may merge; together they look at ``context`` characters to a side."""
    rounds, size = [], 1.0
    while sum(rounds) + int(size) <= context:
        rounds.append(int(size))
        size *= 4 / 3
    return rounds


def _boundaries(text: _Prefixes, hard: np.ndarray, rounds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The boundaries left after all rounds, and those that the rules for runs removed. hard: boundaries that stay."""
    n = len(hard) - 1
    bounds, runs = np.arange(n + 1), [np.zeros(0, np.int64)]
    for turn, longest in enumerate(rounds):
        start, end = bounds[:-1], bounds[1:]
        name = mix(text.chars) if turn == 0 else text.names(start, end, turn)
        right = name >= _U(1 << 63)
        same = name[:-1] == name[1:]
        merge = same | (~right[:-1] & right[1:])
        if turn:
            free = end - start <= longest
            merge &= free[:-1]
            merge &= free[1:]
        inner = bounds[1:-1]
        merge &= ~hard[inner]
        runs.append(inner[merge & same])
        bounds = bounds[np.r_[True, ~merge, True]]
    return bounds, np.concatenate(runs)


def _blocks(segments: list[str], width: int, bits: int = 64) -> tuple[np.ndarray, ...]:
    """(segment, first window, windows, key, name of the stretch) of each block of all segments."""
    context = width // 5
    inner = width - 2 * context
    sizes = np.array([len(x) for x in segments])
    ends = np.cumsum(sizes)
    codes = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)
    text = _Prefixes(codes, _BASE)
    hard = np.zeros(len(codes) + 1, bool)
    hard[0] = True
    hard[ends] = True
    bounds, runs = _boundaries(text, hard, _bounds_by_round(context))
    late = np.zeros(len(bounds), bool)
    holes = np.flatnonzero(np.diff(bounds) > inner)
    if len(holes):
        k = np.searchsorted(bounds, runs) - 1
        again = np.unique(runs[(bounds[k + 1] - bounds[k] > inner)])
        late = np.r_[late, np.ones(len(again), bool)]
        bounds = np.r_[bounds, again]
        order = np.argsort(bounds, kind="stable")
        bounds, late = bounds[order], late[order]
    owner = np.minimum(np.searchsorted(ends, bounds, "right"), len(ends) - 1)
    usable = (bounds >= ends[owner] - sizes[owner] + context) & (bounds <= ends[owner] - context)
    at, owner, late = bounds[usable], owner[usable], late[usable]
    key = text.names(at - context, at + context, 77)
    rank = (key >> _U(1)) | (late.astype(np.uint64) << _U(63))
    left, right = _nearest(at, owner, rank, inner, -1), _nearest(at, owner, rank, inner, 1)
    first = np.maximum(np.maximum(at - (width - context), left - context + 1), ends[owner] - sizes[owner])
    last = np.minimum(np.minimum(at - context, right - (width - context) - 1), ends[owner] - width)
    real = first <= last
    first, last, owner, key = first[real], last[real], owner[real], key[real]
    return owner, first - (ends - sizes)[owner], last - first + 1, key.view(np.int64), _prints(codes, first, last + width, bits)


def _nearest(at: np.ndarray, owner: np.ndarray, rank: np.ndarray, reach: int, step: int) -> np.ndarray:
    """Position of the nearest boundary to one side that comes before this one in rank (of equals the leftmost), within reach; else far off."""
    out = np.full(len(at), step * (1 << 40), np.int64)
    todo, shift = np.arange(len(at)), 0
    while len(todo):
        shift += step
        other = todo + shift
        inside = (other >= 0) & (other < len(at))
        todo, other = todo[inside], other[inside]
        near = (np.abs(at[other] - at[todo]) <= reach) & (owner[other] == owner[todo])
        todo, other = todo[near], other[near]
        before = rank[other] <= rank[todo] if step < 0 else rank[other] < rank[todo]
        out[todo[before]] = at[other[before]]
        todo = todo[~before]
    return out


def _batches(rows: Iterator[tuple], size: int) -> Iterator[list[tuple]]:
    """Group rows until their texts (the last field) hold ``size`` characters."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += len(row[-1])
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def _block_rows(width: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def segments() -> Iterator[tuple]:
            for batch in batches:
                for key, text in zip(batch["id"].to_pylist(), batch["text"]):
                    text = text.as_py()
                    for base in range(0, max(1, len(text) - width + 1), _BATCH_CHARS):
                        yield key, base, text[base : base + _BATCH_CHARS + width - 1]

        for held in _batches(segments(), _BATCH_CHARS):
            owner, first, count, key, stretch = _blocks([x[2] for x in held], width, bits)
            ids, bases = np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64)
            columns = [key, stretch, ids[owner], (first + bases[owner]).astype(np.int32), count.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["key", "stretch", "id", "start", "n"])

    return run


def _wants(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, dict]]:
    for batch in batches:
        for key, text, wants in zip(batch["id"].to_pylist(), batch["text"], batch["wants"]):
            text = text.as_py()
            for want in wants.as_py():
                yield key, text, want


def _window_rows(width: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((i, w["key"], w["start"], w["n"], w["model"], text[w["start"] : w["start"] + w["n"] - 1 + width]) for i, text, w in _wants(batches))
        for held in _batches(rows, _BATCH_CHARS):
            ids, keys, starts, counts = (np.array([x[i] for x in held], np.int64) for i in range(4))
            model = np.array([x[4] for x in held], bool)
            sizes = np.array([len(x[5]) for x in held])
            codes = np.frombuffer("".join(x[5] for x in held).encode("utf-32-le", "surrogatepass"), np.uint32)
            which = np.repeat(np.arange(len(held)), counts)
            within = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
            at = (np.cumsum(sizes) - sizes)[which] + within
            columns = [keys[which], _prints(codes, at, at + width, bits), ids[which], (starts[which] + within).astype(np.int32), model[which]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["key", "name", "id", "start", "model"])

    return run


def _plain_windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((w["key"], i, p, text[p : p + width]) for i, text, w in _wants(batches) for p in range(w["start"], w["start"] + w["n"]))
        for held in _batches(rows, _BATCH_CHARS):
            key, ids, start, part = zip(*held)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(ids, pa.int64()), pa.array(start, pa.int32()), pa.array(part)], names=["key", "id", "start", "part"])

    return run


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = ((i, w["rid"], w["cell"], w["lo"], w["hi"], w["at"], text[w["lo"] : w["hi"]]) for i, text, w in _wants(batches))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
    for held in _batches(rows, _BATCH_CHARS):
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held), kinds)], names=["id", "rid", "cell", "lo", "hi", "at", "part"])
