"""The best rows of each query, kept in a task's memory while its batches go by."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from ..schema import TOTAL_ORDER

KEYS = ["id", "source_path", "byte_start"]
COLUMNS = ["query_id", *KEYS, "score"]
#: Candidates that are held before they are cut down again.
HELD = 1_000_000


def result_type(rows: DataFrame, queries: DataFrame) -> tuple[str, pa.Schema]:
    """The type of scored rows for the key columns of ``rows`` and the ids of ``queries``."""
    kinds = dict(rows.dtypes)
    made = ", ".join([f"query_id {dict(queries.dtypes)['query_id']}", *(f"{c} {kinds[c]}" for c in KEYS), "score double"])
    return made, to_arrow_schema(rows.sparkSession.createDataFrame([], made).schema)


class Best:
    """The ``limit`` best candidates of each query, by score and the total order."""

    def __init__(self, query_ids: np.ndarray, limit: int, schema: pa.Schema) -> None:
        self.query_ids, self.limit, self.schema = query_ids, limit, schema
        self.parts: list[pd.DataFrame] = []
        self.held = 0
        self.least = np.full(len(query_ids), -np.inf)  # a query's last kept score, once it has enough

    def add(self, keys: pd.DataFrame, row: np.ndarray, query: np.ndarray, score: np.ndarray) -> None:
        """Candidates: the key columns of a batch, and (row, query, score) of each."""
        keep = score >= self.least[query]
        row, query, score = row[keep], query[keep], score[keep]
        if not len(row):
            return
        own = keys[KEYS].take(row)
        self.parts.append(own.assign(query=query, score=score))
        self.held += len(row)
        if self.held > HELD:
            self._cut()

    def _cut(self) -> None:
        both = pd.concat(self.parts, ignore_index=True)
        # Ties with the last kept score stay until the total order decides.
        order = np.lexsort((-both["score"].to_numpy(), both["query"].to_numpy()))
        query, score = both["query"].to_numpy()[order], both["score"].to_numpy()[order]
        starts = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
        last = np.minimum(starts + self.limit - 1, np.append(starts[1:], len(query)) - 1)
        full = last == starts + self.limit - 1
        self.least[query[starts[full]]] = score[last[full]]
        both = both.iloc[order[score >= np.repeat(np.where(full, score[last], -np.inf), np.diff(np.append(starts, len(query))))]]
        both = both.sort_values(["query", "score", *TOTAL_ORDER], ascending=[True, False, *[True] * len(TOTAL_ORDER)])
        both = both.groupby("query", sort=False).head(self.limit)
        self.parts, self.held = [both], len(both)

    def table(self) -> pa.Table:
        if not self.parts:
            return self.schema.empty_table()
        self._cut()
        both = self.parts[0]
        return pa.Table.from_pandas(both.assign(query_id=self.query_ids[both["query"].to_numpy()])[COLUMNS], schema=self.schema, preserve_index=False)
