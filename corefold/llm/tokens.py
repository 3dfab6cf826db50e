"""Sizes of texts in tokens of a public byte-level BPE tokenizer.

The tokenizer's pattern never lets a token reach over a blank that stands between two visible
characters, so a text falls into independent stretches there. Their counts are kept by stretch in
each Python worker, which makes repeated words cheap; the counts equal those of encoding the
text whole.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the queries read the vocabulary; every machine has it at this path.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern published with this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_CUT = re.compile(r"(?<=\S) (?=\S)")
_BLANKS = re.compile(r" \s|\s ")
_LONGEST_KEPT, _MOST_KEPT = 40, 1 << 19
_counters: dict[str, Callable[[str], int]] = {}


def encoding(path: str):
    """The tiktoken encoding of a file of ranks."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("corefold", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Counts(dict):
    """Stretch -> number of tokens; the stretch follows a blank that belongs to it."""

    def __init__(self, encode, prefix: str) -> None:
        self.encode, self.prefix = encode, prefix

    def __missing__(self, stretch: str) -> int:
        n = len(self.encode(self.prefix + stretch))
        if len(stretch) <= _LONGEST_KEPT:
            if len(self) >= _MOST_KEPT:
                self.clear()
            self[stretch] = n
        return n


def counter(path: str) -> Callable[[str], int]:
    """A function from a text to its number of tokens, made once per process."""
    if path not in _counters:
        encode = encoding(path).encode_ordinary
        first, later = _Counts(encode, ""), _Counts(encode, " ")

        def count(text: str) -> int:
            parts = _CUT.split(text) if _BLANKS.search(text) else text.split(" ")
            return first[parts[0]] + sum(map(later.__getitem__, parts[1:]))

        _counters[path] = count
    return _counters[path]


def with_token_counts(df: DataFrame, text_col: str = "text", out: str = "n_tokens", tokenizer: str = TOKENIZER) -> DataFrame:
    """Replace the text by its number of tokens; a null or empty text has 0. A column already named ``out`` is replaced."""
    kept = [f for f in df.schema.fields if f.name not in (text_col, out)]
    schema = T.StructType([*kept, T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, known = counter(tokenizer), {}

        def size(text: str | None) -> int:
            """Copies of a long text are counted once in this task."""
            if not text or len(text) <= _LONGEST_KEPT:
                return count(text) if text else 0
            key = xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))
            if key not in known:
                if len(known) >= _MOST_KEPT:
                    known.clear()
                known[key] = count(text)
            return known[key]

        for batch in batches:
            sizes = list(map(size, batch[text_col].to_pylist()))
            columns = [batch[f.name] for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64())], names=[*(f.name for f in kept), out])

    return df.select(*[F.col(f.name) for f in kept], F.col(text_col)).mapInArrow(run, schema)
