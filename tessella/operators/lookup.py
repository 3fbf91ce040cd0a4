"""Sums of table rows over sparse entries, by blocks of rows: a vector travels once to each block that names it."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable

#: Entries of a block, about: 64 MB of vectors of 64 values.
BLOCK = 1 << 17


def summed_entries(entries: DataFrame, key: str, table: DataFrame, dim: int, more: tuple[str, ...] = (), zeros: bool = False, block: int = BLOCK) -> DataFrame:
    """(key, *more, v): per row the sum of ``table(id, v)`` over its ``entries(key, *more, id[, val])``, ``val`` times each.

    Rows hold a few entries each. Entries without a vector add nothing; rows of these only are left out, or zero vectors
    with ``zeros``. Blocks keep rows of 65,536 neighbouring keys together, which have words in common; as many blocks are
    made as the entries fill, and each gets every vector it needs once, however often its rows name it.
    """
    rows = durable(entries)
    blocks = max(1, -(-rows.count() // block))
    kinds = dict(rows.dtypes)
    near = F.shiftright(key, 16) if kinds[key] in ("int", "bigint") else F.col(key)
    placed = rows.withColumn("block", F.pmod(F.xxhash64(near), F.lit(blocks)).cast("int"))
    vectors = table.where("v is not null").select(F.col("id").alias("name"), "v")
    needed = placed.select(F.col("block").alias("part"), F.col("id").alias("name")).distinct().join(vectors, "name").select("part", "name", "v")
    names = [key, *more]

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        values = pc.fill_null(right["v"].combine_chunks().flatten(), 0.0) if right.num_rows else pa.array([], pa.float64())
        v, ids = values.to_numpy(zero_copy_only=False).reshape(-1, dim), right["name"].to_pandas()
        if not ids.is_unique:
            codes, ids = pd.factorize(ids)
            total = np.zeros((len(ids), dim))
            np.add.at(total, codes, v)
            v = total
        at = pd.Index(ids).get_indexer(left["id"].to_pandas())
        group = left.select(names).to_pandas().groupby(names, sort=False, dropna=False).ngroup().to_numpy()
        first = np.unique(group, return_index=True)[1]
        order = np.argsort(group, kind="stable")
        order = order[at[order] >= 0]
        out = np.zeros((len(first), dim))
        if len(order):
            met = v[at[order]]
            if "val" in left.column_names:
                met *= left["val"].to_numpy()[order, None]
            starts = np.flatnonzero(np.diff(group[order], prepend=-1))
            out[group[order][starts]] = np.add.reduceat(met, starts, axis=0)
        if not zeros:
            known = np.unique(group[order])
            first, out = first[known], out[known]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, dim), pa.int32()), pa.array(out.ravel()))
        return pa.table([*left.select(names).take(pa.array(first)).columns, lists], names=[*names, "v"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", v array<double>"
    return placed.groupBy("block").cogroup(needed.groupBy("part")).applyInArrow(summed, schema)
