"""Row-wise readers as Arrow UDFs."""

from __future__ import annotations

import sys
from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

# Travels with the job, whether or not executors have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def arrow_reader(content: Column, reader: Callable[[str | None], list | None], schema: str) -> Column:
    """What ``reader`` gives for each text, handed to Spark as Arrow: a pandas UDF would
    convert every field of the nested result once more, in Python."""
    kind = to_arrow_type(DataType.fromDDL(schema))

    @F.arrow_udf(schema)
    def read(texts: pa.Array) -> pa.Array:
        return pa.array([reader(t) for t in texts.to_pylist()], kind)

    return read(content)
