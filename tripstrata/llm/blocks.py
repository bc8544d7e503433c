"""Work on blocks of rows that belong together, streamed through Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tripstrata.llm.base import tidy


def by_block(rows: DataFrame, order: list[str], work: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str) -> DataFrame:
    """``work`` on each block's rows, streamed; blocks are of bounded size by construction."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        np.seterr(over="ignore")
        parts: list[pd.DataFrame] = []
        for batch in batches:
            blocks = batch.block.to_numpy()
            inside = not len(blocks) or blocks[0] == blocks[-1]
            if inside and (not parts or not len(blocks) or parts[-1].block.iloc[-1] == blocks[0]):
                parts += [batch] if len(blocks) else []
                continue
            batch = pd.concat([*parts, batch], ignore_index=True)
            edges = np.flatnonzero(np.diff(batch.block.to_numpy())) + 1
            bounds = [0, *edges.tolist(), len(batch)]
            found = [work(batch.iloc[i:j]) for i, j in zip(bounds[:-2], bounds[1:-1], strict=True)]
            found = [x for x in found if x is not None and len(x)]
            if found:
                yield pd.concat(found, ignore_index=True)
            parts = [batch.iloc[bounds[-2] :]]
        if parts:
            last = work(pd.concat(parts, ignore_index=True))
            if last is not None and len(last):
                yield last

    return rows.repartition("block").sortWithinPartitions("block", *order).mapInPandas(tidy(scan), schema)
