"""The shared folder, and lineage cuts for operators that run in rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows of a round that are read as one partition at most: a few MB, which Spark would put into one task after an exchange.
FEW = 1 << 16


def checkpoint_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a temporary folder in local mode, as in tests."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared checkpoint folder and go on from there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def counted(df: DataFrame, **aggregates: Column) -> tuple[DataFrame, dict]:
    """``df`` written as by ``cut``, and its ``rows`` and the given aggregates, seen as it is written, so no job asks for them.

    Not more than FEW rows, by that count, are read as one partition: what only such take part in needs no exchange, so it
    is one stage.  More are read as they were written, over all partitions.
    """
    seen = Observation()
    written = cut(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(name) for name, c in aggregates.items()]))
    found = seen.get
    return gathered(written, found["rows"]), found


def gathered(written: DataFrame, rows: int) -> DataFrame:
    """``written``, which has so many ``rows``, as one partition if these are FEW; all of them, whichever way.

    The limit is never reached by less than all rows.  It is there for its size: the planner reckons that of written
    rows by multiplying the sides of the joins that made them, and would exchange one partition that it thinks large.
    """
    return written.coalesce(1).limit(FEW) if rows <= FEW else written


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
