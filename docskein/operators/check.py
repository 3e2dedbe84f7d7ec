"""Input checks: fail early, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType


def require(df: DataFrame, *columns: str, arrays: tuple[str, ...] = ()) -> DataFrame:
    """``df`` if it has all ``columns``, and ``arrays`` as arrays."""
    missing = [c for c in (*columns, *arrays) if c not in df.columns]
    if missing:
        raise ValueError(f"input lacks {missing}; it has {df.columns}")
    flat = [c for c in arrays if not isinstance(df.schema[c].dataType, ArrayType)]
    if flat:
        raise ValueError(f"not an array: {flat}")
    return df
