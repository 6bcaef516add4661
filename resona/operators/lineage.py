"""Cutting lineage between the rounds of a loop."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def _folder(df: DataFrame) -> str:
    """The shared folder that spark.checkpoint.dir names; a temporary one where none is set and all tasks run in this process."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or f"file://{tempfile.mkdtemp(prefix='resona-')}")
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed in the shared folder."""
    _folder(df)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """The same rows, read back from a Parquet table in the shared folder, which takes less room than a checkpoint."""
    path = f"{_folder(df)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
