"""Word vectors, model weights and feature arrays: from and to files, as tables.

Files are read and written through Spark's file systems, so they may lie wherever the executors can read.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corefold.functions.lexical import UNKNOWN_WORD
from corefold.operators.embed import check_width
from corefold.runtime import stash

_CHUNK = 4096


def read_array(spark: SparkSession, path: str) -> DataFrame:
    """(row, values): the rows of an npy file, or of all files of a pattern, whose rows count from 0 in each. A file holds at most 2 GB."""

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                matrix = np.load(io.BytesIO(content))
                matrix = matrix.reshape(len(matrix), -1)
                for at in range(0, len(matrix), _CHUNK):
                    part = matrix[at : at + _CHUNK].astype(np.float64)
                    yield pd.DataFrame({"row": np.arange(at, at + len(part)), "values": list(part)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(load, "row long, values array<double>")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(row, line): the lines of one text file, numbered from 0, without blanks at their ends."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"\r?\n$", "").alias("value"))
    return whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("row", "line")).select("row", F.trim("line").alias("line"))


def distinct_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(line): the different lines of text files, without blanks at their ends."""
    return spark.read.text(path).select(F.rtrim("value").alias("line")).distinct()


def read_embeddings(spark: SparkSession, stem: str, kind: str, width: int | None = None) -> DataFrame:
    """(kind, word, vec) from ``<stem>_vocabulary.txt`` and ``<stem>_embeddings.npy``: line i names row i. With a width, vectors of another raise an error."""
    words = read_lines(spark, f"{stem}_vocabulary.txt")
    both = words.join(read_array(spark, f"{stem}_embeddings.npy"), "row")
    out = both.select(F.lit(kind).alias("kind"), F.col("line").alias("word"), F.col("values").cast("array<float>").alias("vec"))
    return out if width is None else check_width(out, width)


def write_embeddings(table: DataFrame, stem: str) -> None:
    """The inverse of ``read_embeddings``, in the order of the words; the vocabulary of a model, so its rows pass the driver."""
    rows = table.select("word", "vec").orderBy("word").collect()
    _put(table.sparkSession, f"{stem}_vocabulary.txt", "".join(r["word"] + "\n" for r in rows).encode())
    held = io.BytesIO()
    np.save(held, np.array([r["vec"] for r in rows], np.float32))
    _put(table.sparkSession, f"{stem}_embeddings.npy", held.getvalue())


def _put(spark: SparkSession, path: str, data: bytes) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


# The training arrays of a corpus and their widths.
ARRAYS = {
    "mentions_features": 6, "mentions_labels": 1, "mentions_pairs_length": 1, "mentions_pairs_start_index": 1, "mentions_spans": 250, "mentions_words": 8,
    "pairs_ant_index": 1, "pairs_features": 9, "pairs_labels": 1,
}


def read_arrays(spark: SparkSession, folder: str, labels: bool = True) -> tuple[DataFrame, DataFrame]:
    """(mentions, pairs) from the npy files of ``ARRAYS`` in a folder, one row per array row; an array of another width raises an error."""
    sides = []
    for side in ("mentions", "pairs"):
        out = None
        for name, width in ARRAYS.items():
            if not name.startswith(side) or not labels and name.endswith("labels"):
                continue
            rows = read_array(spark, f"{folder}/{name}.npy")
            wrong = F.raise_error(F.lit(f"{name} has another width")).cast("array<double>")
            rows = rows.withColumn("values", F.when(F.size("values") == width, F.col("values")).otherwise(wrong))
            value = F.col("values")[0].cast("long") if width == 1 else F.col("values").cast("array<float>" if name.endswith("spans") else "array<int>")
            rows = rows.select("row", value.alias(name))
            out = rows if out is None else out.join(rows, "row")
        sides.append(out)
    return sides[0], sides[1]


def tuned_from_static(static: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The tuned table re-initialised: the static vector of every word of the vocabulary, that of the unknown word where there is none."""
    known = static.select("word", "vec")
    unknown = known.where(F.col("word") == UNKNOWN_WORD).select(F.col("vec").alias("unk"))
    out = vocabulary.select("word").distinct().join(known, "word", "left").join(F.broadcast(unknown), F.lit(True), "left")  # one row
    return out.select(F.lit("tuned").alias("kind"), "word", F.coalesce("vec", "unk").alias("vec"))


def read_weights(spark: SparkSession, folder: str) -> dict[str, list[tuple[np.ndarray, np.ndarray]]]:
    """Both networks' layers (weights, bias) from npy files whose sorted names give the order; bounded by the model."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(folder).select("path", "content").collect()
    held = {r["path"].rsplit("/", 1)[-1]: np.load(io.BytesIO(r["content"])) for r in files}
    out = {}
    for model, name in (("single", "single_mention"), ("pair", "pair_mentions")):
        weights, biases = ([held[f] for f in sorted(held) if f.startswith(f"{name}_{x}")] for x in ("weights", "bias"))
        out[model] = [(w, b.reshape(-1)) for w, b in zip(weights, biases)]
    return out


def save_model(spark: SparkSession, path: str, model: dict[str, list[tuple[np.ndarray, np.ndarray]]], config: dict) -> None:
    """Weights as a table (model, layer, w, b) and the configuration as JSON beside it."""
    rows = [(name, i, w.tolist(), b.tolist()) for name, layers in model.items() for i, (w, b) in enumerate(layers)]
    spark.createDataFrame(rows, "model string, layer int, w array<array<double>>, b array<double>").write.mode("overwrite").parquet(f"{path}/weights")
    spark.createDataFrame([(json.dumps(config),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")


def load_model(spark: SparkSession, path: str) -> tuple[dict[str, list[tuple[np.ndarray, np.ndarray]]], dict]:
    """The inverse of ``save_model``. The weights are bounded by the model, not the data, so they are collected."""
    out: dict = {}
    for row in spark.read.parquet(f"{path}/weights").orderBy("model", "layer").collect():
        out.setdefault(row["model"], []).append((np.array(row["w"]), np.array(row["b"])))
    return out, json.loads(spark.read.text(f"{path}/config").first()["value"])


def document_offsets(sizes: DataFrame) -> DataFrame:
    """(doc_id, m_base, p_base): how many mentions and pairs the documents before have, from (doc_id, n, p)."""
    sizes = stash(sizes, "sizes")
    before = Window.partitionBy("block").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    # Two-level running sum: inside range blocks of documents, then over the blocks.
    block = sizes.repartitionByRange("doc_id").withColumn("block", F.spark_partition_id())
    block = stash(block, "blocks")
    per_block = block.groupBy("block").agg(F.sum("n").alias("bn"), F.sum("p").alias("bp"))
    over = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = per_block.select("block", F.coalesce(F.sum("bn").over(over), F.lit(0)).alias("n0"), F.coalesce(F.sum("bp").over(over), F.lit(0)).alias("p0"))
    return block.join(starts, "block").select(
        "doc_id", (F.col("n0") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("m_base"), (F.col("p0") + F.coalesce(F.sum("p").over(before), F.lit(0))).alias("p_base")
    )


def global_rows(mentions: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per-document tables with global row numbers, as the training arrays have them.

    mentions (doc_id, m_idx) gains flat_idx and pairs_start; pairs (doc_id, men_idx, ant_idx) gains pair_row and pairs_ant_index. The
    offsets are running sums over one row per document; rows themselves are never put in one global order. Documents
    without mentions have no rows.
    """
    n_pairs = pairs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("p"))
    offsets = document_offsets(mentions.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).join(n_pairs, "doc_id", "left").na.fill(0, ["p"]))
    in_doc = Window.partitionBy("doc_id").orderBy("men_idx", "ant_idx")
    numbered = pairs.join(offsets, "doc_id").withColumn("pair_row", F.col("p_base") + F.row_number().over(in_doc) - 1).withColumn("pairs_ant_index", F.col("m_base") + F.col("ant_idx"))
    starts_of = numbered.groupBy("doc_id", F.col("men_idx").alias("m_idx")).agg(F.min("pair_row").alias("first"))
    flat = mentions.join(offsets, "doc_id").join(starts_of, ["doc_id", "m_idx"], "left").withColumn("flat_idx", F.col("m_base") + F.col("m_idx"))
    later = Window.partitionBy("doc_id").orderBy("m_idx").rowsBetween(0, Window.unboundedFollowing)
    ends = numbered.groupBy("doc_id").agg((F.max("pair_row") + 1).alias("end"))
    flat = flat.join(ends, "doc_id", "left").withColumn("pairs_start", F.coalesce(F.first("first", ignorenulls=True).over(later), "end", "p_base"))
    return flat.drop("m_base", "p_base", "first", "end"), numbered.drop("m_base", "p_base")
