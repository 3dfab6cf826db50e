"""The pipeline over a stream of documents: each micro-batch is resolved as a table, by the same operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from corefold.operators.scoring import Layers
from corefold.plans import pipeline


def resolve_documents(
    docs: DataFrame,
    folder: str,
    model: dict[str, Layers] | None = None,
    embeddings: DataFrame | None = None,
    parameters: pipeline.Parameters = pipeline.Parameters(),
    **trigger,
) -> StreamingQuery:
    """Start a query over a stream of documents (doc_id, text): ``<folder>/documents`` gets the document annotations, ``<folder>/clusters`` the entities.

    Both are parquet with one partition per batch, which a repeated batch overwrites. ``folder`` must be shared by all executors; it also
    holds the stream's checkpoint. ``trigger``: see ``DataStreamWriter.trigger``.
    """

    def step(rows: DataFrame, batch: int) -> None:
        done = pipeline.run(rows, model, embeddings, parameters=parameters)
        done.document_annotations().write.mode("overwrite").parquet(f"{folder}/documents/batch={batch}")
        done.clusters.write.mode("overwrite").parquet(f"{folder}/clusters/batch={batch}")

    writer = docs.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(**trigger) if trigger else writer).start()
