"""Approximate and exact cosine search by an inverted file of product-quantised residuals.

Unit vectors are dealt to the nearest of some learned centres (cells); what is
left of a vector is stored as one byte for each of `subspaces` parts.  A search
reads the cells nearest to a question, scores their rows from the bytes, and
scores the best of them again by the original vectors.  Every row keeps how far
its bytes are off and every cell how far its rows reach, so a search can also
go on to the rows and cells that those bounds don't rule out: then it is exact.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import shared_dir, written
from .search import knn, top, vectors_of

#: Bytes of the sample that centres and codes are learned from, and its rows for each cell.
SAMPLE_BYTES, SAMPLE_ROWS = 64 << 20, 64
#: Cells at most; rows of a cell that one task scores, and questions it scores them for.
CELLS, CELL_ROWS, ASKED = 4_096, 50_000, 2_000
#: More than the rounding of scores, so that no bound rules a tie out.
SLACK = 2e-9


@dataclass
class Model:
    """Centres by cell, and for each part of a vector's residual the values that a byte stands for."""

    centres: np.ndarray
    books: list[np.ndarray]

    @property
    def length(self) -> int:
        return self.centres.shape[1]

    def parts(self) -> list[slice]:
        ends = np.cumsum([b.shape[1] for b in self.books])
        return [slice(e - b.shape[1], e) for e, b in zip(ends.tolist(), self.books, strict=True)]


@dataclass
class Index:
    """rows(id, codes, err, v, part, cell, ...) in a folder by cell; cells(cell, parts, reach); the model that made them."""

    model: Model
    rows: DataFrame
    cells: DataFrame


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre next to each point."""
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([np.argmax(points[i : i + 8192] @ centres.T - half, axis=1) for i in range(0, len(points), 8192)] or [np.zeros(0, np.int64)])


def centres_of(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k-means; a centre that loses its points takes the one farthest from its own."""
    k = min(k, len(points))
    centres = points[rng.choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(points, centres)
        counts = np.bincount(own, minlength=k)
        order = np.argsort(own, kind="stable")
        held = np.flatnonzero(counts)
        centres[held] = np.add.reduceat(points[order], (np.cumsum(counts) - counts)[held], axis=0) / counts[held, None]
        if (lost := np.flatnonzero(counts == 0)).size:
            centres[lost] = points[np.argsort(-((points - centres[own]) ** 2).sum(axis=1), kind="stable")[: lost.size]]
    return centres


def usual_length(rows: DataFrame, vector: str = "embedding") -> int:
    """The length that most vectors have; of equally frequent ones the smallest."""
    first = rows.where(F.size(vector) > 0).groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return first.n if first else 1


def fit(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", length: int | None = None, cells: int | None = None, subspaces: int | None = None, seed: int = 42) -> Model:
    """Centres and codes from a sample of the rows by the hash of their keys.

    By default a byte stands for four numbers, and there are as many cells as the root of the number of rows, CELLS
    at most.  The sample that comes to the driver has SAMPLE_ROWS rows for each
    cell, and about SAMPLE_BYTES at most, whatever the table's size.
    """
    length = length or usual_length(rows, vector)
    usable = rows.where((F.size(vector) == length) & F.col(key).isNotNull())
    n = usable.count()
    cells = max(1, min(cells or round(n**0.5), CELLS))
    wanted = min(max(SAMPLE_ROWS * cells, 256 * 16), SAMPLE_BYTES // (8 * length))
    spread = 1 << 30
    picked = usable.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(spread)) < min(spread, int(spread * 1.05 * wanted / max(n, 1)) + 1)).select(vector).limit(2 * wanted)
    held = pa.concat_arrays([c for c in picked.toArrow().column(vector).chunks] or [pa.array([], pa.list_(pa.float64()))])
    points = vectors_of(held, length)[1]
    if not len(points):
        points = np.eye(1, length)
    rng = np.random.default_rng(seed)
    points = points[np.lexsort(points.T)]  # the sample's order doesn't count
    centres = centres_of(points, cells, rng)
    rest = points - centres[nearest(points, centres)]
    return Model(centres, [centres_of(np.ascontiguousarray(part), 256, rng) for part in np.array_split(rest, min(subspaces or -(-length // 4), length), axis=1)])


def build(rows: DataFrame, model: Model, key: str = "vec_id", vector: str = "embedding", path: str | None = None, carry: tuple[str, ...] = ()) -> Index:
    """The index of all rows whose vectors have the model's length; null keys, zero and non-finite vectors have no row.

    Rows are written by cell (below `path`, or in the shared folder), a cell of
    more than CELL_ROWS rows in several parts.  `carry` are columns to filter
    by.  Keys are unique; vectors of other lengths need a model of their own.
    """
    spark, parts = rows.sparkSession, model.parts()
    source = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v"), *carry)
    kinds = [T.StructField("codes", T.BinaryType()), T.StructField("err", T.DoubleType()), T.StructField("reach", T.DoubleType()), T.StructField("cell", T.IntegerType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, unit = vectors_of(batch.column("v"), model.length)
            cell = nearest(unit, model.centres)
            rest = unit - model.centres[cell]
            codes = np.empty((len(unit), len(parts)), np.uint8)
            back = np.empty_like(rest)
            for s, (part, book) in enumerate(zip(parts, model.books, strict=True)):
                codes[:, s] = nearest(rest[:, part], book)
                back[:, part] = book[codes[:, s]]
            held = batch.take(pa.array(at))
            of = lambda x: pa.array(np.linalg.norm(x, axis=1) * (1 + 1e-9) + 1e-12)  # noqa: E731  rounded up
            yield pa.record_batch([*held.columns, pa.array([c.tobytes() for c in codes], pa.binary()), of(rest - back), of(rest), pa.array(cell.astype(np.int32))], names=[*held.schema.names, *(k.name for k in kinds)])

    coded = written(source.mapInArrow(run, T.StructType([*source.schema, *kinds])), "coded")
    cells = written(coded.groupBy("cell").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("parts"), F.max("reach").alias("reach")), "cells")  # one row for each centre at most
    path = path or f"{shared_dir(spark)}/ann-{uuid.uuid4().hex}"
    dealt = coded.join(F.broadcast(cells.select("cell", "parts")), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt.select("id", "codes", "err", "v", *carry, "part", "cell").repartition("cell", "part").write.partitionBy("cell").parquet(f"{path}/rows")
    cells.write.parquet(f"{path}/cells")
    spark.createDataFrame([(dealt.select("id", "codes", "err", "v", *carry, "part", "cell").schema.json(),)], "value string").write.text(f"{path}/schema")
    numbers = spark.createDataFrame([(-1, int(i), c.tolist()) for i, c in enumerate(model.centres)] + [(s, i, b.tolist()) for s, book in enumerate(model.books) for i, b in enumerate(book)], "book int, at int, v array<double>")
    numbers.write.parquet(f"{path}/model")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Index:
    """An index that `build` has written."""
    numbers = spark.read.parquet(f"{path}/model").toPandas().sort_values(["book", "at"])
    tables = [np.stack(g["v"].to_numpy()).astype(float) for _, g in numbers.groupby("book", sort=True)]
    schema = T.StructType.fromJson(json.loads(spark.read.text(f"{path}/schema").first().value))
    return Index(Model(tables[0], tables[1:]), spark.read.schema(schema).parquet(f"{path}/rows"), spark.read.schema("cell int, parts int, reach double").parquet(f"{path}/cells"))


def _asked(index: Index, questions: DataFrame, key: str, vector: str, wanted: int, bounds: bool) -> DataFrame:
    """query_id, q, cell, near, t: each question with its `wanted` next cells, or with `bounds` those that can hold rows of score t or more."""
    centres, length = index.model.centres, index.model.length
    kind = questions.schema[key].dataType.simpleString()
    reach = np.full(len(centres), -np.inf)
    for r in index.cells.select("cell", "reach").collect():  # one row for each centre at most
        reach[r.cell] = r.reach

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, unit = vectors_of(batch.column("v"), length)
            least = batch.column("t").to_numpy(zero_copy_only=False)[at]
            near = unit @ centres.T
            if bounds:
                row, cell = np.nonzero((np.clip(near + reach, 0, 1) >= least[:, None] - SLACK) & np.isfinite(reach))
            else:
                order = np.argsort(-np.where(np.isfinite(reach), near - (centres**2).sum(axis=1) / 2, -np.inf), axis=1, kind="stable")[:, :wanted]
                row, cell = np.repeat(np.arange(len(unit)), order.shape[1]), order.ravel()
            q = pa.ListArray.from_arrays(pa.array(np.arange(0, len(row) * length + 1, length, dtype=np.int32)), pa.array(unit[row].ravel()))
            yield pa.record_batch([batch.column("query_id").take(pa.array(at[row])), q, pa.array(cell.astype(np.int32)), pa.array(near[row, cell]), pa.array(least[row])], names=["query_id", "q", "cell", "near", "t"])

    asked = questions.where(F.col(key).isNotNull()).select(F.col(key).alias("query_id"), F.col(vector).alias("v"), F.col("t") if "t" in questions.columns else F.lit(None).cast("double").alias("t"))
    return asked.mapInArrow(run, f"query_id {kind}, q array<double>, cell int, near double, t double")


def _scored(index: Index, asked: DataFrame, most: int | None, where: Column | None) -> DataFrame:
    """query_id, id, cell, near: of each cell's part the `most` best rows of a question by their codes, or all whose bound reaches t.

    Rows of a part and questions of its cell meet in one task, CELL_ROWS and
    about ASKED of them; a cell with more questions meets them in several tasks.
    """
    asked = written(asked, "asked")
    crowd = asked.groupBy("cell").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("crowds"))
    cells = written(index.cells.join(crowd, "cell").select("cell", "parts", "crowds"), "crowds")
    wanted = [r.cell for r in cells.select("cell").collect()]  # one row for each centre at most, as in `cells`
    each = asked.join(F.broadcast(cells), "cell").select("query_id", "q", "near", "t", "cell", F.pmod(F.xxhash64("query_id"), F.col("crowds")).cast("int").alias("crowd"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rows = index.rows.where(F.col("cell").isin(wanted))
    rows = (rows if where is None else rows.where(where)).select("id", "codes", "err", "part", "cell")
    rows = rows.join(F.broadcast(cells.select("cell", F.sequence(F.lit(0), F.col("crowds") - 1).alias("every"))), "cell").select("id", "codes", "err", "part", "cell", F.explode("every").alias("crowd"))
    model, parts = index.model, index.model.parts()

    def pair(a: pa.Table, b: pa.Table) -> pa.Table:
        pairs, scores = [np.zeros((2, 0), np.int64)], [np.zeros(0)]
        if a.num_rows and b.num_rows:
            q = a.column("q").combine_chunks().flatten().to_numpy().reshape(a.num_rows, model.length)
            near, least, err = (t.column(c).to_numpy() for t, c in ((a, "near"), (a, "t"), (b, "err")))
            codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).reshape(b.num_rows, len(parts))
            step, n = max(1, (4 << 20) // b.num_rows), min(most or 0, b.num_rows)
            for at in range(0, a.num_rows, step):
                score = np.repeat(near[at : at + step, None], b.num_rows, axis=1)
                for s, part in enumerate(parts):
                    score += (q[at : at + step, part] @ model.books[s].T)[:, codes[:, s]]
                if most is None:
                    row, column = np.nonzero(np.clip(score + err, 0, 1) >= least[at : at + step, None] - SLACK)
                else:
                    column = np.argpartition(-score, n - 1, axis=1)[:, :n].ravel()
                    row = np.repeat(np.arange(len(score)), n)
                pairs.append(np.stack([row + at, column]))
                scores.append(score[row, column])
        left, right = np.concatenate(pairs, axis=1)
        cell = (a if a.num_rows else b).column("cell")[:1].combine_chunks().take(pa.array(np.zeros(len(left), np.int64)))
        return pa.table([a.column("query_id").take(pa.array(left)), b.column("id").take(pa.array(right)), cell, pa.array(np.concatenate(scores))], names=["query_id", "id", "cell", "near"])

    kinds = [df.schema[c].dataType.simpleString() for df, c in ((asked, "query_id"), (index.rows, "id"))]
    return each.groupBy("cell", "part", "crowd").cogroup(rows.groupBy("cell", "part", "crowd")).applyInArrow(pair, f"query_id {kinds[0]}, id {kinds[1]}, cell int, near double")


def _exact(index: Index, questions: DataFrame, pairs: DataFrame, key: str, vector: str) -> DataFrame:
    """query_id, id, score of pairs(query_id, id, cell) by the original vectors, clipped to 0..1, to 9 digits."""
    pairs = written(pairs.select("query_id", "id", "cell"), "pairs")
    wanted = [r.cell for r in pairs.select("cell").distinct().collect()]  # one for each centre at most
    asked = questions.select(F.col(key).alias("query_id"), F.col(vector).alias("q"))
    rows = pairs.join(index.rows.where(F.col("cell").isin(wanted)).select("cell", "id", "v"), ["cell", "id"]).join(asked, "query_id").select("query_id", "id", "q", "v")
    length = index.model.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # every pair has two proper vectors, else it would not be one
            (_, q), (_, v) = vectors_of(batch.column("q"), length), vectors_of(batch.column("v"), length)
            yield pa.record_batch([batch.column("query_id"), batch.column("id"), pa.array(np.round(np.clip((q * v).sum(axis=1), 0, 1), 9))], names=["query_id", "id", "score"])

    kinds = [rows.schema[c].dataType.simpleString() for c in ("query_id", "id")]
    return rows.mapInArrow(run, f"query_id {kinds[0]}, id {kinds[1]}, score double")


def search(index: Index, questions: DataFrame, k: int = 20, probes: int = 8, shortlist: int | None = None, exact: bool = False, key: str = "vec_id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """query_id, id, score, rank: the k rows of highest cosine for each question, equal scores by id.

    `probes` cells are read and `shortlist` rows of each question (10 k by
    default) scored by their vectors.  With `exact`, the k-th score so found is
    a bound for a second pass over all cells and rows that could reach it,
    whose result is that of a search through all rows.  `where` filters rows by
    the index's columns.  Keys are unique; null keys and vectors that are null,
    zero, not finite or of another length have no hits and are none.
    """
    near = _scored(index, _asked(index, questions, key, vector, probes, False), shortlist or 10 * k, where)
    by = Window.partitionBy("query_id").orderBy(F.desc("near"), "id")
    best = near.withColumn("at", F.row_number().over(by)).where(F.col("at") <= (shortlist or 10 * k))
    found = top(_exact(index, questions, best, key, vector), "query_id", "score", "id", k)
    if not exact:
        return found
    least = written(found, "found").groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).otherwise(-1.0).alias("t"))
    asked = questions.select(key, vector).join(least.withColumnRenamed("query_id", key), key, "left").fillna({"t": -1.0})
    reach = _scored(index, _asked(index, asked, key, vector, 0, True), None, where)
    return top(_exact(index, questions, reach, key, vector), "query_id", "score", "id", k)


def tune(index: Index, k: int = 10, share: float = 0.95, asked: int = 200) -> int:
    """The least number of probes whose cells hold `share` of the k nearest rows of about `asked` rows, picked by the hash of their keys.

    Those rows ask for themselves, which doesn't count.  Twice `asked` vectors at most and k
    hits of each come to the driver, and the search through all rows is exact.
    """
    rows = index.rows.select("id", "v", "cell")
    n = max(rows.count(), 1)
    picked = written(rows.where(F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(n)) < asked).limit(2 * asked), "picked")
    near = knn(rows, picked, k + 1, "id", "v").where("query_id <> id")
    cells = near.join(rows.select("id", "cell"), "id").select("query_id", "cell").collect()
    (places, unit), ids = vectors_of(pa.concat_arrays([c for c in picked.toArrow().column("v").chunks] or [pa.array([], pa.list_(pa.float64()))]), index.model.length), [r.id for r in picked.select("id").collect()]
    held = np.isin(np.arange(len(index.model.centres)), [r.cell for r in index.cells.collect()])
    order = np.argsort(-np.where(held, unit @ index.model.centres.T - (index.model.centres**2).sum(axis=1) / 2, -np.inf), axis=1, kind="stable")
    at = {ids[p]: np.argsort(o) for p, o in zip(places.tolist(), order, strict=True)}
    needed = np.sort([at[r.query_id][r.cell] + 1 for r in cells])
    return int(needed[min(len(needed) - 1, int(np.ceil(share * len(needed))))]) if len(needed) else 1


def recall(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row: wanted pairs (query_id, id), those of them that were found, and their share (1 where none are wanted)."""
    hit = wanted.select("query_id", "id").join(found.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    both = hit.agg(F.count("*").alias("wanted"), F.count("hit").alias("found"))
    return both.withColumn("recall", F.when(F.col("wanted") > 0, F.col("found") / F.col("wanted")).otherwise(1.0))
