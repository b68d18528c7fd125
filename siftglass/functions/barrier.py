"""A stop for the optimizer where expressions would be multiplied, and a bound for what Python functions see at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a batch that a Python function gets: its memory follows this and the longest text, not the rows of a table.
BATCH_BYTES = 2 << 20
_LIMIT, _UNSET = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on passes texts and files to Python in small batches; a limit set by hand stays.

    Without it a batch is 10,000 rows, whatever their size, and each is held several times over.
    """
    conf = df.sparkSession.conf
    if conf.get(_LIMIT) == _UNSET:
        conf.set(_LIMIT, f"{BATCH_BYTES}b")
    return df


def settled(df: DataFrame) -> DataFrame:
    """``df`` with all columns computed at this point, once.

    Above a Python function the optimizer writes an expression in place of every name that stands for it, so
    columns that are used again and again multiply.  A generator of one row holds them.
    """
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("row")).select("row.*")
