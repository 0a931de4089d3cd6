"""Link prediction: the k nearest entities by translation embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HEAD, TAIL = "head", "tail"
#: Questions and entities that one task compares.
QUESTIONS, ENTITIES = 2048, 65536


def top_k(questions: DataFrame, entities: DataFrame, relations: DataFrame, k: int, side: str = TAIL) -> DataFrame:
    """e, r, answer, score, rank: for each question (e, r) the k entities nearest to e + r (tail) or e - r (head).

    `entities` and `relations` are (id, embedding), ids whole numbers.  The distance is L1; ties go to
    the lesser id.  Questions are a stated set, compared with all entities, both in
    blocks of a bounded size whose numbers follow the counted rows: a block of the one
    meets a block of the other in one task, which keeps its own k for each question,
    and only those are merged.
    """
    if side not in (HEAD, TAIL):
        raise ValueError(side)
    e = entities.select(F.col("id").alias("e"), F.col("embedding").alias("ev"))
    r = relations.select(F.col("id").alias("r"), F.col("embedding").alias("rv"))
    move = (lambda a, b: a + b) if side == TAIL else (lambda a, b: a - b)
    asked = questions.select("e", "r").distinct()
    across, down = (-(-df.count() // n) or 1 for df, n in ((asked, QUESTIONS), (entities, ENTITIES)))

    def block(*keys: str, n: int) -> F.Column:
        return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")

    left = asked.join(e, "e").join(r, "r").select(F.col("e").cast("long").alias("e"), F.col("r").cast("long").alias("r"), F.zip_with("ev", "rv", move).alias("v"), block("e", "r", n=across).alias("q"))
    left = left.where(F.col("v").isNotNull()).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    right = entities.select(F.col("id").cast("long").alias("answer"), F.col("embedding").alias("v"), block("id", n=down).alias("b"))
    right = right.where(F.col("v").isNotNull()).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))

    def nearest(asked: pa.Table, found: pa.Table) -> pa.Table:
        mine, wanted = _vectors(asked)
        best, ids = np.full((len(wanted), k), np.inf), np.full((len(wanted), k), np.iinfo(np.int64).max)
        for batch in found.to_batches():
            rows, vectors = _vectors(pa.Table.from_batches([batch]))
            answers = rows["answer"].to_numpy()
            for i in range(0, len(wanted), 64):
                part = slice(i, i + 64)
                for j in range(0, len(vectors), 1024):
                    apart = np.abs(wanted[part, None] - vectors[None, j : j + 1024]).sum(axis=2, dtype=np.float64)
                    scores = np.concatenate([best[part], apart], axis=1)
                    names = np.concatenate([ids[part], np.broadcast_to(answers[j : j + 1024], apart.shape)], axis=1)
                    order = np.lexsort((names, scores), axis=1)[:, :k]
                    best[part], ids[part] = np.take_along_axis(scores, order, 1), np.take_along_axis(names, order, 1)
        there = np.isfinite(best)
        owner = np.nonzero(there)[0]
        return pa.Table.from_arrays([pa.array(mine["e"].to_numpy()[owner]), pa.array(mine["r"].to_numpy()[owner]), pa.array(ids[there]), pa.array(best[there])], ["e", "r", "answer", "score"])

    kept = left.groupBy("q", "b").cogroup(right.groupBy("q", "b")).applyInArrow(nearest, "e long, r long, answer long, score double")
    last = Window.partitionBy("e", "r").orderBy("score", "answer")
    kinds = {"e": questions.schema["e"], "r": questions.schema["r"], "answer": entities.schema["id"]}
    return kept.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select(*(F.col(c).cast(f.dataType).alias(c) for c, f in kinds.items()), "score", "rank")


def _vectors(rows: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """Rows, and their vectors `v` as a matrix."""
    rows = rows.combine_chunks()
    if not rows.num_rows:
        return rows, np.zeros((0, 0), np.float32)
    return rows, rows["v"].chunk(0).flatten().to_numpy().reshape(rows.num_rows, -1)
