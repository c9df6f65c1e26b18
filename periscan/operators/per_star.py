"""Numpy functions over whole curves, one star to a group: no group is longer than its curve."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TYPES = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def per_star(df: DataFrame, columns: list[str], run: Callable[..., list], ddl: str) -> DataFrame:
    """``run`` gets the named columns of each star as arrays (null numbers as NaN) and returns those of ``ddl``, which come back with the star's id. NaN comes back as null."""
    names = [x.split()[0] for x in ddl.split(", ")]
    types = [TYPES[x.split()[1]] for x in ddl.split(", ")]

    def call(curve: pa.Table) -> pa.Table:
        out = run(*(curve.column(c).to_numpy() for c in columns))
        star = curve.column("star_id").take(pa.array(np.zeros(len(out[0]), np.int64)))
        return pa.table([star, *(pa.array(x, t, from_pandas=True) for x, t in zip(out, types, strict=True))], names=["star_id", *names])

    return df.select("star_id", *columns).groupBy("star_id").applyInArrow(call, f"star_id {df.schema['star_id'].dataType.simpleString()}, {ddl}")
