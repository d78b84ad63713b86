"""Exact top-k inner products, term at a time.

Vectors are sparse rows of integer weights. Candidates and queries are dealt into blocks; each cell of the grid
(candidate block, query block) holds the postings of its candidates by term. For every query the postings of its terms
are scattered, times the query's weight, into a dense array of scores; the k best of the cell are selected by
partitioning that array, and the cells of a query are merged. Cells have a bounded size whatever rows repeat, as rows are
dealt by their numbers, so the grid grows with the data.

Defined cases: vectors that are null or hold null or non-finite components take no part; an empty vector scores 0;
vectors of different lengths are compared on the components that both have; a query meets no row of its own id; rows
that repeat an id are candidates each, and queries each; ties go to the smaller id; an empty table gives an empty result;
weights of any size are exact (whole numbers in doubles; sums that could overflow are made of Python's integers), and a
score that no long holds counts as the nearest long; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dishflow.llm.common import materialise, shuffle_partitions

CANDIDATES, QUERIES = 32768, 32768  # rows of a block; queries take no memory but for their weights
LONG = (1 << 63) - 1


def integer_weights(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as a double, null if the vector takes no part (or scale * x is beyond doubles)."""
    as_double = vector.cast("array<double>")
    fine = F.forall(as_double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # floor() of a double is a long in Spark: what is beyond 2^52 has no fraction and stays as it is
    whole = F.transform(as_double, lambda x: F.when(F.abs(scale * x) < float(1 << 52), F.floor(scale * x).cast("double")).otherwise(scale * x))
    return F.when(vector.isNotNull() & fine & F.forall(as_double, lambda x: F.abs(scale * x) < float("inf")), whole)


def _matrix(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and weight of all non-zero components."""
    lists = col.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    terms = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    some = flat != 0
    return rows[some], terms[some], flat[some]


def _cell(k: int):
    names = ["query", "query_id", "vec_id", "score"]

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not len(queries) or not len(candidates):
            return pa.table({x: pa.array([], pa.int64()) for x in names})
        order = np.argsort(candidates.column("vec_id").to_numpy(), kind="stable")
        candidates = candidates.take(pa.array(order))
        ids = candidates.column("vec_id").to_numpy()
        rows, terms, weights = _matrix(candidates.column("w"))
        by_term = np.argsort(terms, kind="stable")
        rows, terms, weights = rows[by_term], terms[by_term], weights[by_term]
        n_terms = int(terms[-1]) + 1 if len(terms) else 0
        begin = np.searchsorted(terms, np.arange(n_terms + 1))
        q_rows, q_terms, q_weights = _matrix(queries.column("w"))
        q_begin = np.searchsorted(q_rows, np.arange(len(queries) + 1))
        top = [int(max(abs(x), default=0)) for x in (weights, q_weights)]
        kind = np.int64 if top[0] * top[1] * max(1, n_terms) <= LONG else object
        weights, q_weights = (x.astype(np.int64) if kind is np.int64 else np.array([int(v) for v in x], object) for x in (weights, q_weights))
        full = np.diff(begin) == len(ids)  # such a list's places are all places: it is added as it stands
        scores = np.empty(len(ids), kind)
        out: list[list[np.ndarray]] = [[], [], [], []]
        for q, (query, query_id) in enumerate(zip(queries.column("query").to_pylist(), queries.column("vec_id").to_pylist(), strict=True)):
            scores[:] = 0
            for t, w in zip(q_terms[q_begin[q] : q_begin[q + 1]].tolist(), q_weights[q_begin[q] : q_begin[q + 1]].tolist(), strict=True):
                if t < n_terms:
                    a, b = begin[t], begin[t + 1]
                    if full[t]:
                        scores += weights[a:b] * w
                    else:
                        scores[rows[a:b]] += weights[a:b] * w
            found = scores if kind is np.int64 else np.array([max(-LONG - 1, min(LONG, v)) for v in scores], np.int64)
            a, b = np.searchsorted(ids, [query_id, query_id + 1])
            other = np.delete(found, np.s_[a:b]) if a < b else found
            other_ids = np.delete(ids, np.s_[a:b]) if a < b else ids
            if len(other) > k:
                least = np.partition(other, len(other) - k)[len(other) - k]
                above = np.flatnonzero(other > least)
                best = np.concatenate([above, np.flatnonzero(other == least)[: k - len(above)]])
            else:
                best = np.arange(len(other))
            for col, x in zip(out, (np.full(len(best), query), np.full(len(best), query_id), other_ids[best], other[best]), strict=True):
                col.append(x)
        return pa.table({x: pa.array(np.concatenate(c).astype(np.int64)) for x, c in zip(names, out, strict=True)})

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, candidate_block: int = CANDIDATES, query_block: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score. Both sides: vec_id long, w array<double> of whole numbers; rows without w
    take no part. Candidates are copied once for each query_block queries."""
    queries, candidates = (materialise(x.where("w is not null and vec_id is not null").select("vec_id", "w")) for x in (queries, candidates))
    n, parts = candidates.count(), shuffle_partitions(queries.sparkSession)
    n_q = max(1, -(-queries.count() // query_block))
    n_c = max(1, -(-n // candidate_block), min(parts, n // 1024))  # queries are few: their copies let all cores work
    numbered = lambda x: x.withColumn("query", F.monotonically_increasing_id())
    block = lambda n: F.pmod(F.xxhash64("query"), F.lit(n)).cast("int")
    left = numbered(queries).withColumn("q", block(n_q)).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))))
    right = numbered(candidates).withColumn("c", block(n_c)).drop("query").withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    cells = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInArrow(_cell(k), "query long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return cells.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
