"""Streaming use of fitted models.

The reference has no streaming operators.  The only streaming concern is
that fitted models (T12) score micro-batches: linear models are plain
column expressions, ensembles score Arrow batches of bins from a JVM
``Bucketizer``, so they apply to a streaming DataFrame exactly as to a
batch one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def score_stream(stream: DataFrame, model, query_name: str, checkpoint_dir: str,
                 id_col: str = "id", out_col: str = "pred", sink: str = "memory",
                 model_index: int = 0) -> StreamingQuery:
    """Score every incoming row; append ``(id, pred)`` to ``sink``.

    ``model``: a ``LinearModel`` (full fit), a ``BoostResult`` or a saved ``Forest`` (model
    ``model_index``, best iteration).  ``checkpoint_dir`` must be a shared,
    reliable folder on a cluster.
    """
    from ..operators.boost import BoostResult, Forest
    if isinstance(model, BoostResult):
        model = model.forest()
    if isinstance(model, Forest):
        scored = model.score(stream, model_index, out_col).select(id_col, out_col)
    else:
        scored = stream.select(id_col, model.predict().alias(out_col))
    return (scored.writeStream.outputMode("append").format(sink).queryName(query_name)
                  .option("checkpointLocation", checkpoint_dir).start())
