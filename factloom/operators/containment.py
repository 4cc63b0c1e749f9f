"""Structural join: which extents of a file hold which others, in one sorted pass with a stack of open extents.

Work and output are linear in the rows and in the pairs found. A file's rows meet in one task, as its text does when it is read, and only the extents that are open at a
place are held, so a file of any length streams through. Extents that cross each other are allowed; only such as hold a row whole count.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PAIRS = "path string, item long, id long, distance int"
_LAST = (1 << 63) - 1


def enclosing(outer: DataFrame, inner: DataFrame, nearest: bool = False, one_table: bool = False) -> DataFrame:
    """(path, item, id, distance): for rows of inner (path, item, pos, end) the rows of outer (path, id, pos, end) around them; distance counts outwards from 1.

    Of equal extents those with the larger `nth` (a column of outer, else id) are the inner ones. With `nearest` only distance 1 is given. With `one_table` ids and items are the
    same rows: a row is not around itself, and of equal extents the one with the smaller id is around the other."""
    outer = outer if "nth" in outer.columns else outer.withColumn("nth", F.col("id"))
    nth = F.col("item") if one_table else F.lit(_LAST)
    rows = outer.select("path", "pos", "end", F.col("nth").cast("long").alias("nth"), F.lit(0).alias("kind"), F.col("id").cast("long").alias("id"))
    rows = rows.union(inner.select("path", "pos", "end", nth.cast("long").alias("nth"), F.lit(1).alias("kind"), F.col("item").cast("long").alias("id")))
    rows = rows.repartition("path").sortWithinPartitions("path", "pos", F.desc("end"), "nth", "kind")

    def run(it):
        file, stack = None, []
        for batch in it:
            if not batch.num_rows:
                continue
            # Paths stay in Arrow: a row only tells whether its file is another one.
            paths = pc.fill_null(batch.column(0), "")
            other = [paths[0].as_py() != file, *pc.not_equal(paths[1:], paths[:-1]).to_pylist()]
            file, rows, ids, distances = paths[-1].as_py(), [], [], []
            for row, (new, pos, end, kind, at) in enumerate(zip(other, *(batch.column(i).to_pylist() for i in (1, 2, 4, 5)))):
                if new:
                    stack = []
                while stack and stack[-1][0] <= pos:
                    stack.pop()
                if not kind:
                    stack.append((end, at))
                    continue
                distance = 0
                for e, id_ in reversed(stack):
                    if e >= end and not (one_table and id_ == at):
                        distance += 1
                        rows.append(row)
                        ids.append(id_)
                        distances.append(distance)
                        if nearest:
                            break
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(5).take(at), pa.array(ids, pa.int64()), pa.array(distances, pa.int32())], names=["path", "item", "id", "distance"])

    return rows.mapInArrow(run, _PAIRS)
