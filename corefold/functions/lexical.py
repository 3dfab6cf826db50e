"""String functions on tokens, as Column expressions (no Python in the data path)."""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of the annotated corpora and their plain forms.
PLAIN_FORMS = {"/.": ".", "/?": "?", "-LRB-": "(", "-RRB-": ")", "-LCB-": "{", "-RCB-": "}", "-LSB-": "[", "-RSB-": "]"}
STRAY_CHARACTERS = "/%*"
# Genre codes, the first two letters of a document name.
GENRES = {"bc": 0, "bn": 1, "mz": 2, "nw": 3, "pt": 4, "tc": 5, "wb": 6}
# Reserved words of the vocabulary.
UNKNOWN_WORD, MISSING_WORD, DIGIT_WORD = "*UNK*", "<missing>", "0"


def _lookup(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in itertools.chain(*pairs.items())])


def clean_token(token: Column) -> Column:
    """A corpus token in plain spelling: known forms are replaced, stray characters deleted, nothing left is a comma. A null counts as empty."""
    token = F.coalesce(token, F.lit(""))
    plain = token
    for raw, form in PLAIN_FORMS.items():
        plain = F.when(token == raw, F.lit(form)).otherwise(plain)
    stripped = F.when(token.isin(*STRAY_CHARACTERS), token).otherwise(F.translate(plain, STRAY_CHARACTERS, ""))
    return F.when(stripped == "", F.lit(",")).otherwise(stripped)


def normalise_inference(token: Column) -> Column:
    """Lower case; a token of digits only becomes the digit word."""
    return F.when(token.rlike(r"^\d+$"), F.lit(DIGIT_WORD)).otherwise(F.lower(token))


def normalise_training(token: Column) -> Column:
    """Lower case with every digit as 0; a null is the missing word."""
    return F.coalesce(F.regexp_replace(F.lower(token), r"\d", "0"), F.lit(MISSING_WORD))


def text_with_whitespace(tokens: Column) -> Column:
    """Concatenate an array of struct(text, ws)."""
    return F.array_join(F.transform(tokens, lambda t: F.concat(t["text"], t["ws"])), "")


def utterance_text(tokens: Column) -> Column:
    """Tokens, each followed by one blank."""
    return F.array_join(F.transform(tokens, lambda t: F.concat(t, F.lit(" "))), "")


def name_tokens(name: Column) -> Column:
    """The lower-case parts of a speaker's name, split at blanks and underscores."""
    return F.split(F.lower(name), r"\s+|_+")


def squeeze_name(name: Column) -> Column:
    """A name in lower case without blanks and underscores, for equality."""
    return F.regexp_replace(F.lower(name), r"\s+|_+", "")


def contains_string(names: Column, string: Column) -> Column:
    """Does any of the names equal the string, blanks, underscores and case aside?"""
    return F.exists(names, lambda n: squeeze_name(n) == squeeze_name(string))


def contains_token(tokens: Column, token: Column) -> Column:
    return F.array_contains(tokens, token)


def genre(name: Column) -> Column:
    """The genre code of a document name; null for unknown prefixes."""
    return F.element_at(_lookup(GENRES), F.substring(name, 1, 2))


def to_bytes(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def from_bytes(data: Column) -> Column:
    return F.decode(data, "UTF-8")


def cache_name(url: Column, etag: Column) -> Column:
    """The file name under which a download is cached: the URL's SHA-256, then the etag's if there is one."""
    return F.concat_ws(".", F.sha2(url, 256), F.when(etag.isNotNull(), F.sha2(etag, 256)))


def cached_source(metadata: Column) -> Column:
    """The inverse of ``cache_name``: struct(url, etag) from the JSON text that is kept beside a cached file; null for other text."""
    return F.from_json(metadata, "url string, etag string")


def file_extension(path: Column, dot: bool = True, lower: bool = True) -> Column:
    """The suffix from the last dot of the file name on."""
    found = F.regexp_extract(path, r"([.][^./\\]*)$", 1)
    found = found if dot else F.regexp_replace(found, r"^[.]", "")
    return F.lower(found) if lower else found
