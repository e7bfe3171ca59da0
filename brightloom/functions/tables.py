"""Table functions for SQL text: ``register(spark)`` adds them to the session."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from brightloom.functions import text as T


def slices_function(low: int = 80, high: int = 500, glue: int = 6, per_file: int = 3):
    """An Arrow table function ``slices(TABLE(texts) PARTITION BY (file), words)`` over texts (file, text), as
    operators.ranking.slices but for the limit over all files.

    A file is one partition, read in batches; of its passages only the best ``per_file`` are held, so a long file takes
    no more memory than its longest text. Null texts have no passages.
    """

    class Slices:
        def __init__(self):
            self.file, self.best = None, {}

        def eval(self, rows: pa.RecordBatch, words: pa.Array):
            patterns = [re.compile(w) for w in words[0].as_py()] if len(words) else []
            for file, text in zip(rows.column("file").to_pylist(), rows.column("text").to_pylist(), strict=True):
                self.file = file
                parts = [p for p in (" ".join(x.split()) for x in re.split(r"\n\s*\n", text or "", flags=re.ASCII)) if p]
                for i in range(len(parts)):
                    for n in range(1, min(glue, len(parts) - i) + 1):
                        passage = "\n".join(parts[i : i + n])
                        if len(passage) > high:
                            break
                        if len(passage) >= low:
                            self._offer((-sum(1 for p in patterns for _ in p.finditer(passage)), i + 1, n), passage)

        def _offer(self, order: tuple, passage: str) -> None:
            start = passage[:50]
            if start in self.best and self.best[start][0] <= order:
                return
            self.best[start] = (order, passage)
            if len(self.best) > per_file:  # a start that drops out now can only come back with a better passage
                del self.best[max(self.best, key=lambda s: self.best[s][0])]

        def terminate(self):
            rows = sorted(self.best.values())
            yield pa.table(
                {
                    "file": pa.array([self.file] * len(rows), pa.string()), "i": pa.array([o[1] for o, _ in rows], pa.int32()), "n": pa.array([o[2] for o, _ in rows], pa.int32()),
                    "passage": pa.array([p for _, p in rows], pa.string()), "score": pa.array([-o[0] for o, _ in rows], pa.int32()),
                }
            )

    return F.arrow_udtf(Slices, returnType="file string, i int, n int, passage string, score int")


def register(spark: SparkSession) -> None:
    """``slices``, and ``footnotes(body)``: (k, item_id, quote) of a draft's notes, the last of a number, for lateral joins.

    ``footnotes`` is a SQL function, which the optimizer takes into the query: no Python runs.
    """
    spark.udtf.register("slices", slices_function())
    part = lambda g: f"regexp_extract_all(body, r'{T.FOOTNOTE_DEF}', {g})"
    rows = f"transform(arrays_zip({part(1)}, {part(2)}, {part(3)}), r -> named_struct('k', int(r['0']), 'item_id', bigint(r['1']), 'quote', regexp_replace(r['2'], r'(?U)^\\s+|\\s+$', '')))"
    last = f"get(transform(array({rows}), d -> filter(d, (r, i) -> NOT exists(slice(d, i + 2, size(d)), x -> x.k = r.k))), 0)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION footnotes(body STRING) RETURNS TABLE (k INT, item_id BIGINT, quote STRING) RETURN SELECT inline({last})")
