"""Operator 7: exact k best inner products by a Voronoi kNN join.

Vectors become integers, floor(scale * x). With M the largest squared length, giving every candidate one more coordinate
sqrt(M - |v|^2) and every query a zero makes all candidates equally long, so the largest inner products are the smallest
distances: d(q, v)^2 = |q|^2 + M - 2 <q, v>.

1. Pivots, a bounded sample of candidates, divide queries and candidates into Voronoi cells.
2. A summary of each candidate cell (its size and radii in quantiles) bounds, for each query cell, how far any of its queries must
   look: the k-th smallest of upper bounds over all candidates.
3. A candidate goes to the query cells whose bound its own lower bound, by the triangle inequality, does not exceed, and to no
   others; each (query cell, part of candidates) is solved by a product of integer matrices in blocks.
4. The best k of each query are merged from its parts.

Cells of candidates and of queries are cut into parts of about `PART` rows, so a cell that holds a third of all vectors is spread and
a task meets about `PART` queries with as many candidates. Rows equal in id and vector travel as one, with their number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studylake.llm.common import materialize, pick

PIVOTS, QUERY_CELLS = 64, 8
#: Candidates of one part of a cell.
PART = 4096
#: Radii kept for each candidate cell: distances at these numbers of members from the pivot.
QUANTILES = 16
#: Slack of distance bounds against rounding.
SLACK = 1e-6

#: Squared length from which sums in doubles are no longer exact.
EXACT = 1 << 53

BEST = "query_id long, query_key long, query_times long, cell int, vec_id long, score long, times long"
_ARROW_BEST = pa.schema(
    [(name, pa.int32() if name == "cell" else pa.int64()) for name in ("query_id", "query_key", "query_times", "cell", "vec_id", "score", "times")]
)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def _integer(vectors: DataFrame, scale: int) -> DataFrame:
    """Rows (key, id, v array<long>, squared length) of vectors without NULL or non-finite components."""
    ok = F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    whole = F.transform("x", lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))
    rows = vectors.where(ok).select("id", whole.alias("v")).withColumn("key", F.xxhash64("id", "v"))
    return rows.withColumn("n", F.aggregate("v", F.lit(0).cast("long"), lambda a, c: a + c * c))


def _to_pivots(points: np.ndarray, lift: np.ndarray, pivots: np.ndarray, pivot_lift: np.ndarray) -> np.ndarray:
    """Distances of lifted points to lifted pivots."""
    square = (points**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * points @ pivots.T
    return np.sqrt(np.maximum(square + (lift[:, None] - pivot_lift[None, :]) ** 2, 0))


def _cells(kind: str, top: int, pivots: np.ndarray, pivot_lift: np.ndarray, columns: list[str]):
    """Adds the nearest pivot and the distance to it."""

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("v"))
            if not len(x):
                continue
            lift = np.zeros(len(x)) if kind == "query" else np.sqrt(np.maximum(top - (x**2).sum(1), 0))
            d = _to_pivots(x, lift, pivots, pivot_lift)
            cell = d.argmin(1)
            arrays = [batch.column(c) for c in columns]
            arrays += [pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(x)), cell])]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "cell", "r"])

    return run


def _solve(k: int):
    def best(queries: pa.Table, data: pa.Table) -> pa.Table:
        if not queries.num_rows or not data.num_rows:
            return _ARROW_BEST.empty_table()
        q, x = _matrix(queries.column("v")), _matrix(data.column("v"))
        ids, keys, times = (data.column(c).to_numpy() for c in ("id", "key", "times"))
        q_ids, q_keys, q_times = (queries.column(c).to_numpy() for c in ("id", "key", "times"))
        # Products of integers below 2^53 in doubles are exact.
        by_id = np.argsort(ids, kind="stable")
        x, ids, keys, times = x[by_id], ids[by_id], keys[by_id], times[by_id]
        cell = np.full(1, data.column("cell")[0].as_py(), np.int32)
        least = np.iinfo(np.int64).min
        out: list[list[np.ndarray]] = [[] for _ in _ARROW_BEST]
        step = max(1, (1 << 22) // len(ids))
        for a in range(0, len(q), step):
            score = (q[a : a + step] @ x.T).astype(np.int64)
            # The query's own row is no candidate, other rows like it are.
            own = q_keys[a : a + step, None] == keys[None, :]
            score[own & (times == 1)[None, :]] = least
            # Stable by falling score: of equal scores the smaller id comes first.
            order = np.argsort(-np.maximum(score, least + 1), axis=1, kind="stable")[:, :k]
            chosen = np.take_along_axis(score, order, 1)
            often = np.minimum(times[order] - np.take_along_axis(own, order, 1), k)
            real = chosen > least
            rows = np.nonzero(real)[0] + a
            values = q_ids[rows], q_keys[rows], q_times[rows], np.repeat(cell, len(rows)), ids[order][real], chosen[real], often[real]
            for part, value in zip(out, values):
                part.append(value)
        return pa.Table.from_arrays([pa.array(np.concatenate(part)) for part in out], schema=_ARROW_BEST)

    return best


def nearest(
    vectors: DataFrame, is_query, k: int = 5, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """The k largest integer inner products of each query with every other row.

    `is_query` is a condition on `id`. Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id. Vectors that
    are NULL or hold NULL or non-finite components take no part, nor do NULL ids. A vector that is shorter than the longest has zeros
    for what it lacks. Fewer than k candidates: all of them. Rows count one by one: a query has every row but itself as a candidate,
    also rows of its id or equal to it, a repeated candidate takes as many ranks as there are rows of it, and a repeated query has its
    result as often. Vectors so long that an inner product may pass 2^53 are refused, as their scores would not be exact. No rows give
    no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = _integer(pick(vectors, id=id_column, x=vector_column).where("id IS NOT NULL").withColumn("id", F.col("id").cast("long")), scale)
    once = rows.groupBy("key").agg(F.first("id").alias("id"), F.first("v").alias("v"), F.first("n").alias("n"), F.count("*").alias("times"))
    rows = materialize(once, "vectors")
    sizes = rows.agg(F.max(F.size("v")).alias("size"), F.min(F.size("v")).alias("least"), F.count("*").alias("rows"), F.max("n").alias("top")).first()
    if not sizes["rows"]:
        return empty
    size, top, total = max(sizes["size"], 1), int(sizes["top"]), sizes["rows"]
    if top >= EXACT:
        raise ValueError(f"vectors of squared length {top}: scores would not be exact")
    if sizes["least"] < size:
        lacking = F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size("v"))
        rows = rows.withColumn("v", F.concat("v", lacking))

    # A bounded sample, the same every time.
    share = min(1.0, 4 * PIVOTS / total)
    chosen = rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy("key").limit(PIVOTS).collect()
    pivots = np.array([r["v"] for r in chosen] or [[0] * max(size, 1)], np.float64)
    pivots = np.unique(pivots, axis=0)
    pivot_lift = np.sqrt(np.maximum(top - (pivots**2).sum(1), 0))
    # Query cells are those of few, far apart pivots.
    far = [0]
    between = _to_pivots(pivots, pivot_lift, pivots, pivot_lift)
    while len(far) < min(QUERY_CELLS, len(pivots)):
        far.append(int(between[:, far].min(1).argmax()))
    q_pivots, q_lift = pivots[far], np.zeros(len(far))

    fields = "id long, v array<long>, key long, times long, cell int, r double"
    names = ["id", "v", "key", "times"]
    queries = materialize(rows.where(is_query(F.col("id"))).select(*names).mapInArrow(_cells("query", top, q_pivots, q_lift, names), fields), "queries")
    data = materialize(rows.select(*names).mapInArrow(_cells("data", top, pivots, pivot_lift, names), fields), "cells")

    # Summaries: at most QUERY_CELLS and PIVOTS rows.
    asking = queries.groupBy("cell").agg(F.max("r").alias("u"), F.count("*").alias("rows")).collect()
    if not asking:
        return empty
    reach = {r["cell"]: r["u"] for r in asking}
    levels = [i / QUANTILES for i in range(QUANTILES + 1)]
    cells = data.groupBy("cell").agg(F.count("*").alias("rows"), F.max("r").alias("most"), F.percentile_approx("r", levels, 1000).alias("at")).collect()
    lifted = _to_pivots(q_pivots, q_lift, pivots, pivot_lift)
    bounds = []
    for cell, u in reach.items():
        # (upper bound, how many candidates it holds for); a query may be among its own candidates, hence k + 1.
        held = sorted((u + lifted[cell, c["cell"]] + c["most"], c["rows"]) for c in cells)
        seen = 0
        for bound, n in held:
            seen += n
            if seen >= k + 1:
                break
        else:
            bound = float("inf")
        bounds.append((int(cell), float(u), float(bound)))
    # Tighten with quantiles: at least `share` of a cell lies within each radius.
    for i, (cell, u, bound) in enumerate(bounds):
        for c in cells:
            for j, radius in enumerate(c["at"]):
                # percentile_approx is off by at most a thousandth of the rows.
                if c["rows"] * (j / QUANTILES - 0.002) >= k + 1:
                    bound = min(bound, u + lifted[cell, c["cell"]] + radius)
                    break
        bounds[i] = (cell, u, bound)

    def pieces(counted, column: str):
        """Into how many parts a cell is cut."""
        return F.element_at(F.create_map(*(F.lit(x) for c in counted for x in (c["cell"], -(-c["rows"] // PART)))), F.col(column))

    def part_of(key: str, pieces):
        return F.pmod(F.xxhash64(key), pieces.cast("long")).cast("int")

    wanted = F.array(
        *(
            F.struct(F.lit(cell).alias("q"), F.greatest(F.lit(0.0), _gap(lifted[cell], u)).alias("least"), F.lit(bound).alias("most"))
            for cell, u, bound in bounds
        )
    )
    sent = data.withColumn("to", F.explode(F.filter(wanted, lambda w: w["least"] <= w["most"] * (1 + SLACK) + SLACK)))
    sent = sent.select(F.col("to.q").alias("q"), "cell", part_of("key", pieces(cells, "cell")).alias("part"), "id", "v", "key", "times")
    spans = materialize(sent.groupBy("q", "cell", "part").agg(F.count("*").alias("rows")), "spans")
    asked = queries.select(F.col("cell").alias("q"), part_of("key", pieces(asking, "cell")).alias("q_part"), "id", "v", "key", "times")
    place = ["q", "q_part", "cell", "part"]
    asked = spans.join(asked, "q").select(*place, "id", "v", "key", "times")
    # Each part of a query cell meets each part of the candidates that come to the cell.
    sent = sent.withColumn("q_part", F.explode(F.sequence(F.lit(0), pieces(asking, "q").cast("int") - 1)))
    found = asked.groupBy(*place).cogroup(sent.groupBy(*place)).applyInArrow(_solve(k), BEST)
    # The best of each cell first, so that no query gathers more than k for each of the cells.
    score = F.array_repeat(F.struct((-F.col("score")).alias("s"), "vec_id"), F.col("times").cast("int"))
    whose = ["query_id", "query_key", "query_times"]
    merged = found.groupBy(*whose, "cell").agg(_first(F.flatten(F.collect_list(score)), k).alias("best"))
    merged = merged.groupBy(*whose).agg(_first(F.flatten(F.collect_list("best")), k).alias("best"))
    merged = merged.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("query_times"))))
    out = merged.select("query_id", F.posexplode("best").alias("i", "b"))
    return out.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))


def _first(best, k: int):
    return F.slice(F.array_sort(best), 1, k)


def _gap(to_pivots: np.ndarray, u: float):
    """|distance of the pivots - the candidate's radius| less the reach of the query cell, by the candidate's cell."""
    between = F.element_at(F.array(*(F.lit(float(d)) for d in to_pivots)), F.col("cell") + 1)
    return F.abs(between - F.col("r")) - F.lit(float(u))
