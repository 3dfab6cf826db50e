"""Scalar predicates and feature vectors of mentions and pairs, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower ends of the distance bins 1..9 (bin 0 holds the distance 0), and where distances saturate.
BIN_STARTS = [1, 2, 3, 4, 5, 8, 16, 32, 64]
SATURATION = 64
# Mention types.
PRONOMINAL, NOMINAL, PROPER, LIST = 0, 1, 2, 3


def distance_bin(distance: Column) -> Column:
    """The number of the bin of a distance of 0 or more."""
    reached = [(distance >= start).cast("int") for start in BIN_STARTS]
    return reduce(lambda a, b: a + b, reached)


def bin_value(distance: Column) -> Column:
    """The distance as a fraction of the saturation, at most 1."""
    return F.least(distance, F.lit(SATURATION)) / F.lit(float(SATURATION))


def _hot(value: Column, width: int) -> list[Column]:
    return [F.coalesce(value == i, F.lit(False)).cast("float") for i in range(width)]


def _distance(distance: Column) -> list[Column]:
    return [*_hot(distance_bin(distance), 10), bin_value(distance).cast("float")]


def one_hot(value: Column, width: int) -> Column:
    """``width`` floats with a 1 at ``value``; all 0 for null or values outside."""
    return F.array(*_hot(value, width))


def encoded_distance(distance: Column) -> Column:
    """Eleven floats: the one-hot bin and the value."""
    return F.array(*_distance(distance))


def heads_agree(a: Column, b: Column, profile: str = "inference") -> Column:
    """Do two mention structs agree in their head word? In the training profile also two entities of one
    label of which one holds the other's head word.
    """
    same = a["root_lower"] == b["root_lower"]
    if profile == "inference":
        return same
    entities = a["ent_label"].isNotNull() & (a["ent_label"] == b["ent_label"])
    held = b["span_lower"].contains(a["root_lower"]) | a["span_lower"].contains(b["root_lower"])
    return same | F.coalesce(entities & held, F.lit(False))


def exact_match(a: Column, b: Column) -> Column:
    return a["span_lower"] == b["span_lower"]


def relaxed_match(a: Column, b: Column) -> Column:
    """Do the content words meet? False without content words."""
    return F.coalesce(F.arrays_overlap(a["content_words"], b["content_words"]), F.lit(False))


def overlapping(antecedent: Column, mention: Column) -> Column:
    return (antecedent["sent_idx"] == mention["sent_idx"]) & (antecedent["end"] > mention["start"])


def speaker_matches(speaker_tokens: Column, mention: Column) -> Column:
    """Is the mention's head a proper noun that occurs in the speaker's name?"""
    return F.coalesce(mention["root_tag"].startswith("NNP") & F.array_contains(speaker_tokens, mention["root_lower"]), F.lit(False))


def speaker_flags(a: Column, m: Column) -> tuple[Column, Column, Column]:
    """For mention structs with speaker_id and speaker_tokens: one speaker, the antecedent is the mention's speaker, the mention is the antecedent's. Unknown speakers are one."""
    return a["speaker_id"].eqNullSafe(m["speaker_id"]), speaker_matches(m["speaker_tokens"], a), speaker_matches(a["speaker_tokens"], m)


def _own(m: Column, n_mentions: Column) -> list[Column]:
    """Type (4), length bin (10) and value, relative place, nested flag."""
    flags = [(m["m_idx"] / n_mentions).cast("float"), m["nested"].cast("int").cast("float")]
    return [*_hot(m["mention_type"], 4), *_distance(m["end"] - m["start"] - 1), *flags]


def _genre(genre: Column | None) -> list[Column]:
    return [F.lit(0).cast("float")] if genre is None else _hot(genre, 7)


def single_features(m: Column, n_mentions: Column, genre: Column | None = None) -> Column:
    """The mention's own 17 features, then the genre: one 0, or 7 wide where a genre is given."""
    return F.array(*_own(m, n_mentions), *_genre(genre))


def pair_features(a: Column, m: Column, compressed: Column, genre: Column | None = None) -> Column:
    """The dense features of a pair: six flags, the bins and values of both distances, overlap, both mentions' own features, the genre as for one mention.

    compressed: ``compressed_pair`` of the two; mention structs have n_mentions.
    """
    at = lambda i: F.get(compressed, F.lit(i))
    flags = [at(i).cast("float") for i in range(6)]
    return F.array(*flags, *_distance(at(6)), *_distance(at(7)), at(8).cast("float"), *_own(a, a["n_mentions"]), *_own(m, m["n_mentions"]), *_genre(genre))


def compressed_pair(a: Column, m: Column, same_speaker: Column, a_speaker: Column, m_speaker: Column, profile: str = "training") -> Column:
    """Nine integers: same speaker, antecedent / mention named by the other's speaker, heads, exact, relaxed, sentence and mention distance, overlap."""
    flags = [same_speaker, a_speaker, m_speaker, heads_agree(a, m, profile), exact_match(a, m), relaxed_match(a, m)]
    return F.array(*[c.cast("int") for c in flags], (m["sent_idx"] - a["sent_idx"]).cast("int"), (m["m_idx"] - a["m_idx"] - 1).cast("int"), overlapping(a, m).cast("int"))


def compressed_mention(m: Column, n_mentions: Column, genre: Column) -> Column:
    """Six integers: type, length less one, index, number of mentions, nested, genre."""
    return F.array(m["mention_type"], m["end"] - m["start"] - 1, m["m_idx"], n_mentions.cast("int"), m["nested"].cast("int"), genre)


def _decoded(f: Column, genres: int) -> list[Column]:
    at = lambda i: F.get(f, F.lit(i))
    return [*_hot(at(0), 4), *_distance(at(1)), (at(2) / at(3)).cast("float"), at(4).cast("float"), *_hot(at(5), genres)]


def decode_mention(f: Column, genres: int = 7) -> Column:
    """Compressed mention features as a dense vector (24 wide with 7 genres)."""
    return F.array(*_decoded(f, genres))


def decode_pair(f: Column, antecedent: Column, mention: Column, genres: int = 7) -> Column:
    """Compressed pair features with both mentions' compressed features as a dense vector (70 wide with 7 genres).

    The antecedent's and the mention's own features come without the genre, which follows once. The vector is one array of
    scalar expressions, so that reading one position computes that position only.
    """
    at = lambda i: F.get(f, F.lit(i))
    flags = [at(i).cast("float") for i in range(6)]
    own = _decoded(mention, genres)
    return F.array(*flags, *_distance(at(6)), *_distance(at(7)), at(8).cast("float"), *_decoded(antecedent, genres)[:17], *own)


def clipped_sigmoid(x: Column, margin: float = 1e-7) -> Column:
    return F.greatest(F.least(1 / (1 + F.exp(-x)), F.lit(1 - margin)), F.lit(margin))
