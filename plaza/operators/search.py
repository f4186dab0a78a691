"""Nearest vectors by cosine similarity: a stated set of queries against all rows, in blocks.

Queries come to the driver at most ``BLOCK`` at a time and are broadcast; a
task multiplies its rows with the block and keeps the best ``k`` per query, so
no pair of query and row is ever a row of a table.

Defined cases: null vectors, vectors of another length and vectors of length
zero find nothing and are not found; a query does not find its own id; ties go
to the smaller id; no rows or no queries give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaza.operators.rank import top_per_group

#: Queries broadcast at once.
BLOCK = 16_384
_PART = 512


def _unit(lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of unit length, and which rows have one."""
    size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
    ok = size == dim
    flat = np.asarray(lists.filter(pa.array(ok)).flatten(), np.float64).reshape(-1, dim)
    length = np.sqrt((flat * flat).sum(1))
    good = np.isfinite(length) & (length > 0)
    at = np.flatnonzero(ok)[good]
    return flat[good] / length[good, None], at


def nearest(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, id, similarity, rank) of the ``k`` rows (id, vec) nearest to each query (id, vec)."""
    n = queries.count()
    blocks = max(1, -(-n // BLOCK))
    out = None
    for i in range(blocks if n else 0):
        part = queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).select("id", "vec").toArrow()
        part = part.filter(pc.is_valid(part.column(1))).combine_chunks()
        if not part.num_rows:
            continue
        dim = int(pc.list_value_length(part.column(1))[0].as_py() or 0)
        vec, at = _unit(part.column(1).combine_chunks() if isinstance(part.column(1), pa.ChunkedArray) else part.column(1), dim)
        ids = np.asarray(part.column(0))[at]
        shared = rows.sparkSession.sparkContext.broadcast((ids, vec))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, dim=dim) -> Iterator[pa.RecordBatch]:
            ids, vec = shared.value
            best_s, best_i = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
            for b in batches:
                own, at = _unit(b.column(1), dim)
                name = np.asarray(b.column(0))[at]
                for j in range(0, len(name), 2048):
                    r, nm = own[j : j + 2048], name[j : j + 2048]
                    for q in range(0, len(ids), _PART):
                        s = np.round(vec[q : q + _PART] @ r.T, 12)
                        s[ids[q : q + _PART, None] == nm[None, :]] = -np.inf
                        all_s = np.concatenate([best_s[q : q + _PART], s], 1)
                        all_i = np.concatenate([best_i[q : q + _PART], np.broadcast_to(nm, s.shape)], 1)
                        order = np.lexsort((all_i, -all_s), axis=1)[:, :k]
                        best_s[q : q + _PART] = np.take_along_axis(all_s, order, 1)
                        best_i[q : q + _PART] = np.take_along_axis(all_i, order, 1)
            keep = np.isfinite(best_s).ravel()
            yield pa.RecordBatch.from_pydict(
                {"query": pa.array(np.repeat(ids, k)[keep]), "id": pa.array(best_i.ravel()[keep]), "similarity": pa.array(best_s.ravel()[keep])}
            )

        found = rows.select("id", "vec").mapInArrow(run, "query long, id long, similarity double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return rows.sparkSession.createDataFrame([], "query long, id long, similarity double, rank int")
    return top_per_group(out, ["query"], [F.desc("similarity"), F.asc("id")], k)
