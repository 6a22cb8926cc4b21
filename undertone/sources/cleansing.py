"""Type enforcement of landed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_EMPTY = {"string": "unknown", "bool": False, "boolean": False}


def fill(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast the named columns and fill what is null, NaN or not castable.

    Texts become ``unknown``, flags false, numbers 0. A value that cannot be cast
    counts as null. Columns that are not named stay as they are; columns that are
    missing are added filled.
    """
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    out = {}
    for name, kind in types.items():
        empty = F.lit(_EMPTY.get(kind, 0)).cast(kind)
        if name not in have:
            out[name] = empty
            continue
        col = F.nanvl(F.col(name), F.lit(None)) if have[name] in ("double", "float") else F.col(name)
        out[name] = F.coalesce(col.try_cast(kind), empty).cast(kind)
    return df.withColumns(out)
