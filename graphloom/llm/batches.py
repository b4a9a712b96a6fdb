"""Arrow batches that end by bytes, as texts differ in length by orders of magnitude."""

from __future__ import annotations

from pyspark.sql import DataFrame

from graphloom.storage import spread

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def by_bytes(df: DataFrame, mib: int = 4) -> DataFrame:
    """``df``, whose session now sends at most about ``mib`` MiB (or one row) to Python at a time; a small scan
    of a few files is dealt to all cores.

    The setting holds for the session's later queries too; it changes memory, never results."""
    df.sparkSession.conf.set(SETTING, str(mib << 20))
    return spread(df)
