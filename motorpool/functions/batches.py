"""The one place where user Python meets rows, a batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame | None], schema: T.StructType | str) -> DataFrame:
    """Run ``fn`` over Arrow batches. Rows it leaves out are skipped; ``None`` skips the batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = fn(batch)
            if made is not None and len(made):
                yield made

    return df.mapInPandas(run, schema)
