"""Vectors of texts, nearest neighbours, and the cards that show them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelf.functions.encode import Encoder, encode, hashing_encoder
from shelf.functions.text import _col, preview
from shelf.scratch import materialize

# result size of a search
LIMIT = 5
# rows of a block of vectors and of a block of queries
VECTOR_BLOCK, QUERY_BLOCK = 4096, 1024
# vectors that others are gathered round
MOST_PIVOTS = 256
# queries that are compared with a block of vectors in one matrix product
QUERY_CHUNK = 1024
# each query's rows are ranked in so many parts first
RANK_PARTS = 64
METRICS = ("l2", "cosine", "dot")

CARD_COLUMNS = [
    "id", "thumbnail_url", "title", "primary_author", "description", "published_date",
    "page_count", "primary_category", "avg_rating", "ratings_count", "preview_link",
]


def embed(df: DataFrame, text: str = "processed_text", vector: str = "vector",
          make: Callable[[], Encoder] = hashing_encoder) -> DataFrame:
    """Add the vector of a text column."""
    return df.withColumn(vector, encode(text, make))


def _scores(vectors: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """(vectors x queries) scores by matrix product, smaller is nearer; l2 stays squared."""
    dots = vectors @ queries.T
    if metric == "dot":
        return -dots
    vv = np.einsum("ij,ij->i", vectors, vectors)[:, None]
    qq = np.einsum("ij,ij->i", queries, queries)[None, :]
    if metric == "l2":
        return vv + qq - 2 * dots
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1 - dots / np.sqrt(vv * qq)


def _exact(vectors: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Scores of pairs of rows, summed row by row, so that equal vectors get equal scores."""
    if metric == "l2":
        return ((vectors - queries) ** 2).sum(axis=1)
    dots = (vectors * queries).sum(axis=1)
    if metric == "dot":
        return -dots
    return 1 - dots / np.sqrt((vectors * vectors).sum(axis=1) * (queries * queries).sum(axis=1))


def _near_rows(vectors: np.ndarray, queries: np.ndarray, worst: np.ndarray, k: int, metric: str):
    """(row, query, score) that may be among the k nearest, given the worst score kept so far."""
    rough = _scores(vectors, queries, metric)
    # wider than the rounding of the matrix product
    slack = 1e-9 * (1 + np.abs(np.nan_to_num(rough)).max(axis=0))
    cut = worst if len(rough) <= k else np.fmin(worst, np.partition(rough, k - 1, axis=0)[k - 1])
    rows, asked = np.nonzero(rough <= cut + slack)
    return rows, asked, _exact(vectors[rows], queries[asked], metric)


def pivots(rows: DataFrame, size: int, most: int = MOST_PIVOTS) -> np.ndarray:
    """Some of the vectors of (name, vector), two for every ``size`` rows but ``most`` at most, as centres to gather others round."""
    wanted = min(max(2 * (rows.count() // size), 1), most)
    some = rows.orderBy(F.xxhash64("vector"), "name").limit(wanted).select("vector").toArrow()
    flat = some.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.unique(flat.reshape(some.num_rows, -1), axis=0) if some.num_rows else np.zeros((0, 0))


def _packed(rows: DataFrame, metric: str, size: int, centres: np.ndarray) -> DataFrame:
    """(block, n, centre, radius, norm, names, data) of rows (name, vector): up to about ``size`` rows a block, side by side.

    Rows are dealt by the nearest of ``centres``, and those of a crowded one by a hash of the row as well. ``centre``, ``radius``
    and ``norm`` (of the centre) say where a block's vectors lie; for cosine they are those of the vectors at unit length.
    """
    kind = rows.schema["name"].dataType.simpleString()

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (centres * centres).sum(1) / 2
        for batch in batches:
            vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            side = np.concatenate([(vectors[at:at + 1024] @ centres.T - half).argmax(1) for at in range(0, len(vectors), 1024)] or [[]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(side.astype("int32"))], names=["name", "vector", "side"])

    sided = rows.mapInArrow(sides, f"name {kind}, vector array<double>, side int") if len(centres) > 1 else rows.withColumn("side", F.lit(0))
    sizes = sided.groupBy("side").agg(F.count(F.lit(1)).alias("rows"))  # a row a centre
    # by row, not by name, so that a name that repeats does not fill a block
    sided = sided.withColumn("row", F.xxhash64(F.monotonically_increasing_id()))
    part = F.pmod("row", F.ceil(F.col("rows") / size)).cast("int")
    dealt = sided.join(sizes, "side").select("name", "vector", "side", part.alias("part"))

    def pack(block: pd.DataFrame) -> pd.DataFrame:
        data = np.stack(block["vector"].to_numpy())
        where = data
        if metric == "cosine":
            norms = np.linalg.norm(data, axis=1, keepdims=True)
            where = data / np.where(norms == 0, 1, norms)
        centre = where.mean(axis=0)
        return pd.DataFrame({
            "block": [int(block["side"].iloc[0]) << 32 | int(block["part"].iloc[0])], "n": [len(data)], "centre": [centre],
            "radius": [np.linalg.norm(where - centre, axis=1).max()], "norm": [np.linalg.norm(centre)],
            "names": [block["name"].tolist()], "data": [data.ravel()],
        })

    schema = f"block long, n long, centre array<double>, radius double, norm double, names array<{kind}>, data array<double>"
    return dealt.groupBy("side", "part").applyInPandas(pack, schema)


def block_pairs(queries: DataFrame, vectors: DataFrame, k: int, metric: str) -> DataFrame:
    """(asked, block): the blocks of vectors that may hold a result for a block of queries.

    By the triangle inequality no vector of a block is nearer to a query than the distance of the centres less both
    radii, and none is farther than their sum. A block of vectors is passed over if its nearest is farther than the farthest
    of some block with ``k`` vectors.
    """
    q = queries.select(*(F.col(c).alias(f"q_{c}") for c in ("block", "centre", "radius", "norm")))
    v = vectors.select("block", "n", "centre", "radius", "norm")

    def summed(f) -> Column:
        return F.aggregate(F.zip_with("q_centre", "centre", f), F.lit(0.0), lambda so_far, x: so_far + x)

    if metric == "dot":
        middle = -summed(lambda x, y: x * y)
        spread = F.col("q_norm") * F.col("radius") + F.col("norm") * F.col("q_radius") + F.col("q_radius") * F.col("radius")
    else:
        middle = F.sqrt(summed(lambda x, y: (x - y) * (x - y)))
        spread = F.col("radius") + F.col("q_radius")
    # a row a pair of blocks; of each block only where it lies
    bounds = q.crossJoin(v).select(F.col("q_block").alias("asked"), "block", "n", middle.alias("middle"), spread.alias("spread"))
    bounds = materialize(bounds, "bounds")
    enough = bounds.where(F.col("n") >= k).groupBy("asked").agg(F.min(F.col("middle") + F.col("spread")).alias("most"))
    slack = F.lit(1e-6) * (F.lit(1.0) + F.abs("middle") + F.col("spread"))
    near = F.col("most").isNull() | (F.col("middle") - F.col("spread") <= F.col("most") + slack)
    return bounds.join(enough, "asked", "left").where(near).select("asked", "block")


def _nearest_in_blocks(k: int, metric: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                queries = np.asarray(row.q_data).reshape(len(row.qids), -1)
                vectors = np.asarray(row.data).reshape(len(row.names), -1)
                qids, names = np.array(row.qids, dtype=object), np.array(row.names, dtype=object)
                for at in range(0, len(queries), QUERY_CHUNK):
                    part = queries[at:at + QUERY_CHUNK]
                    rows, asked, score = _near_rows(vectors, part, np.full(len(part), np.inf), k, metric)
                    found = pd.DataFrame({"qid": qids[asked + at], "id": names[rows], "score": score, "_q": asked})
                    best = found.sort_values(["_q", "score", "id"]).groupby("_q").head(k)
                    yield best[["qid", "id", "score"]]

    return run


def _first_ranks(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, in two steps, so that no task ranks what all tasks have kept for it."""
    part = F.pmod(F.xxhash64("id"), F.lit(RANK_PARTS))
    some = Window.partitionBy("qid", part).orderBy("score", "id")
    fewer = found.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k).drop("rank")
    order = Window.partitionBy("qid").orderBy("score", "id")
    return fewer.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = LIMIT,
    metric: str = "l2",
    id: str = "id",
    vector: str = "vector",
    qid: str = "qid",
    query_vector: str = "vector",
    block: int = VECTOR_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(qid, rank, id, distance): the ``k`` nearest vectors of each query, ties by id.

    Exact. Vectors and queries are packed into blocks of neighbours, ``block`` and ``query_block`` rows each, as tables; blocks meet
    by a join, unless their centres and radii say that they have nothing for each other, and a pair of
    blocks is one matrix product that keeps ``k`` rows a query. Vectors without a distance (cosine of a
    zero vector) are no result.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")

    def wide(rows: DataFrame, name: str, vector: str) -> DataFrame:
        found = rows.select(F.col(name).alias("name"), F.col(vector).cast("array<double>").alias("vector")).where("vector is not null")
        return found.where(F.exists("vector", lambda x: x != 0)) if metric == "cosine" else found

    rows = materialize(wide(vectors, id, vector), "vectors")
    questions = materialize(wide(queries, qid, query_vector), "queries")
    centres = pivots(rows, block)
    there = materialize(_packed(rows, metric, block, centres), "vector-blocks")
    # few queries stay together, so that the blocks of vectors do not travel to many blocks of a few queries
    asked = materialize(_packed(questions, metric, query_block, centres if questions.count() > query_block else centres[:1]), "query-blocks")
    pairs = materialize(block_pairs(asked, there, k, metric), "block-pairs")
    out = T.StructType([
        T.StructField("qid", asked.schema["names"].dataType.elementType),
        T.StructField("id", there.schema["names"].dataType.elementType),
        T.StructField("score", T.DoubleType()),
    ])
    work = (
        pairs.join(asked.select(F.col("block").alias("asked"), F.col("names").alias("qids"), F.col("data").alias("q_data")), "asked")
        .join(there.select("block", "names", "data"), "block")
        .select("qids", "q_data", "names", "data")
    )
    found = _first_ranks(work.mapInPandas(_nearest_in_blocks(k, metric), out).where(F.col("score").isNotNull() & ~F.isnan("score")), k)
    distance = F.sqrt(F.greatest("score", F.lit(0.0))) if metric == "l2" else F.col("score")
    return found.select("qid", "rank", "id", distance.alias("distance"))


def search(vectors: DataFrame, queries: DataFrame, limit: int = LIMIT, metric: str = "l2",
           make: Callable[[], Encoder] = hashing_encoder, text: str = "query", qid: str = "qid",
           **columns) -> DataFrame:
    """Encode query texts with the encoder of the table and rank its rows."""
    asked = queries.select(F.col(qid).alias("qid"), encode(text, make).alias("vector"))
    return nearest(vectors, asked, limit, metric, **columns)


def result_cards(found: DataFrame, books: DataFrame) -> DataFrame:
    """Join the ranked ids to their books and lay out the card columns; an id without a book has no card.

    ``found`` holds a handful of rows per query. It is written first, so that its real size
    decides whether it is broadcast or the books are shuffled by id.
    """
    cards = materialize(found, "found").join(books.select(*CARD_COLUMNS), "id")
    rated = F.coalesce(F.col("avg_rating"), F.lit(0.0)) != 0
    counted = F.coalesce(F.col("ratings_count"), F.lit(0)) != 0
    count_text = F.when(counted, F.format_string(" (%d ratings)", F.col("ratings_count"))).otherwise("")
    return cards.withColumns(
        {
            "preview": preview("description"),
            "has_more": F.coalesce(F.length("description") > 150, F.lit(False)),
            "rating_text": F.when(rated, F.concat(F.lit("⭐ "), rating_number("avg_rating"), count_text)),
        }
    )


def rating_number(c: Column | str) -> Column:
    """A rating as a card prints it: no trailing '.0'."""
    return F.regexp_replace(_col(c).cast("string"), r"\.0$", "")
