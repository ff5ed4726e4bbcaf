"""Nearest neighbours and ranked selections."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.runtime import cut_lineage

#: Rows of a block of either side; a task computes with one block of queries and one of documents at a time.
BLOCK = 4_096
#: Queries of a task, about, at most.
ASKED = 16_384


def l2_squared(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(d, F.lit(0.0), lambda acc, x: acc + x)


def nearest(queries: DataFrame, docs: DataFrame, id_col: str, vec_col: str, k: int, block: int = BLOCK) -> DataFrame:
    """(query_id, doc_id, distance, rank): the k nearest documents of every query, exact.

    Both sides are packed into blocks and written once; no vector is written again. A task takes the documents of its
    part (all of them, where there are queries for enough tasks), each block unpacked once, past all its queries (about
    ASKED at most) and keeps the k best so far, so what is merged by rank is k rows a query and part. Pairs that cannot be among
    the k best are told by products of rounded vectors (``_Held.maybe``), the others are computed. Null vectors take no
    part. Ties go to the smaller document id. The query itself is not left out.
    """
    q, d = cut_lineage(_packed(_vectors(queries, id_col, vec_col), block)), cut_lineage(_packed(_vectors(docs, id_col, vec_col), block))
    asked = q.agg(F.coalesce(F.sum(F.length("ids")), F.lit(0))).first()[0] // 8
    tasks = 2 * q.sparkSession.sparkContext.defaultParallelism
    groups = max(1, -(-asked // ASKED), min(tasks, -(-asked // block)))
    q = q.select(F.monotonically_increasing_id().alias("q_no"), F.col("ids").alias("q_ids"), F.col("vs").alias("q_vs")).coalesce(groups)
    parts = max(1, min(-(-tasks // max(1, q.rdd.getNumPartitions())), d.count()))
    d = d.select(F.monotonically_increasing_id().alias("no"), "ids", "vs").coalesce(parts)
    best = d.hint("shuffle_replicate_nl").join(q).mapInPandas(_walk(k), "query_id long, doc_id long, distance double")
    return _ranked(best, k)


def _packed(vectors: DataFrame, block: int) -> DataFrame:
    """Rows of up to ``block`` ids and vectors each, as bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vs, many = [], [], 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (np.concatenate(ids).tobytes(), zlib.compress(np.concatenate(vs).tobytes(), 1))], ["ids", "vs"])

        for b in batches:
            own, v = b.column("id").to_numpy(), _matrix(b.column("v"))
            at = 0
            while at < len(own):
                ids.append(own[at : at + block - many])
                vs.append(v[at : at + block - many])
                at, many = at + len(ids[-1]), many + len(ids[-1])
                if many == block:
                    yield full()
                    ids, vs, many = [], [], 0
        if many:
            yield full()

    return vectors.mapInArrow(pack, "ids binary, vs binary")


def _matrix(v: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    n = set(v.value_lengths().unique().to_pylist())
    if len(n) > 1:
        raise ValueError(f"vectors of several lengths: {sorted(n)[:9]}")
    return v.flatten().to_numpy(zero_copy_only=False).astype("float64", copy=False).reshape(len(v), max(n, default=0))


def _walk(k: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The k best documents for every query over pairs of blocks, a block of documents after the other."""

    def open_(ids: bytes, vs: bytes) -> tuple[np.ndarray, np.ndarray]:
        n = np.frombuffer(ids, "int64")
        return n, np.frombuffer(zlib.decompress(vs), "float64").reshape(len(n), -1)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, docs, middle, held = None, None, None, {}
        for b in batches:
            for no, ids, vs, q_no, q_ids, q_vs in zip(b["no"], b["ids"], b["vs"], b["q_no"], b["q_ids"], b["q_vs"]):
                if no != own:
                    own, (ids, y) = no, open_(ids, vs)
                    middle = y.mean(0) if middle is None else middle
                    docs = _Docs(ids, y, middle)
                if q_no not in held:
                    held[q_no] = _Held(*open_(q_ids, q_vs), middle, k)
                held[q_no].add(docs)
        for h in held.values():
            yield h.rows()

    return walk


#: Length of rounded vectors; FIELDS products of two of them, of FIELD bits each, go into one double.
LENGTH, FIELD, FIELDS = 200, 17, 3
_PLACES = [2.0 ** (FIELD * i) for i in range(FIELDS)]
_TOP = [np.int64(1 << (FIELD * i + FIELD - 1)) for i in range(FIELDS)]


class _Rounded:
    """Vectors as seen from ``middle``, in whole numbers: ``scale`` times such a vector is ``whole`` up to a vector of length ``off``."""

    def __init__(self, x: np.ndarray, middle: np.ndarray):
        x = x - middle
        self.square = (x**2).sum(1)
        longest = np.sqrt(self.square.max())
        self.fit = bool(1e-12 < longest < 1e12)
        if self.fit:
            self.x4, self.scale = x.astype("float32"), LENGTH / longest
            self.whole = np.rint(x * self.scale)
            self.off = np.sqrt(((x * self.scale - self.whole) ** 2).sum(1))
            self.length = np.sqrt((self.whole**2).sum(1))


class _Docs:
    """A block of documents; document i stands in field i // width of column i % width of ``packed``."""

    def __init__(self, ids: np.ndarray, y: np.ndarray, middle: np.ndarray):
        self.ids, self.y, self.square, self.r, self.width = ids, y, (y**2).sum(1), _Rounded(y, middle), -(-len(y) // FIELDS)
        if self.r.fit:
            self.packed = self.pack(self.r.whole)

    def pack(self, v: np.ndarray) -> np.ndarray:
        w = self.width
        out = np.zeros((w, *v.shape[1:]))
        for i, place in enumerate(_PLACES):
            some = v[i * w : (i + 1) * w]
            out[: len(some)] += some * place
        return out


class _Held:
    """The k best documents so far of some queries: their row, distance and id, in this order."""

    def __init__(self, asked: np.ndarray, x: np.ndarray, middle: np.ndarray, k: int):
        self.asked, self.x, self.k, self.worst = asked, x, k, np.full(len(x), np.inf)
        self.square, self.r = (x**2).sum(1), _Rounded(x, middle)
        self.row, self.distance, self.id = np.zeros(0, "int64"), np.zeros(0), np.zeros(0, "int64")
        self.new, self.waiting, self.room, self.open = [], 0, None, None

    def add(self, docs: _Docs) -> None:
        top = self.limits(docs) if self.r.fit and docs.r.fit and np.isfinite(self.worst).all() else None
        # some queries at a time bound the matrix of products
        for s in range(0, len(self.x), 256):
            row, doc = self.all(docs, s) if top is None else self.maybe(docs, top, s)
            for at in range(0, len(row), 65_536):
                i, j = row[at : at + 65_536], doc[at : at + 65_536]
                exact = ((self.x[i] - docs.y[j]) ** 2).sum(1)
                self.new.append((i, exact, docs.ids[j]))
                self.waiting += len(i)
        if self.waiting > len(self.x) * self.k // 2 or not np.isfinite(self.worst).all():
            self.merge()

    def all(self, docs: _Docs, s: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that the product of the vectors leaves open."""
        x, xx, worst, yy = self.x[s : s + 256], self.square[s : s + 256], self.worst[s : s + 256], docs.square
        dist = xx[:, None] - 2 * x @ docs.y.T + yy[None, :]
        if len(yy) > self.k and np.isinf(worst).any():
            worst = np.minimum(worst, np.partition(dist, self.k - 1, axis=1)[:, self.k - 1])
        # ranks go by the exact distance, which the product may miss by its last digits
        row, doc = np.nonzero(~(dist > (worst + 1e-8 + 1e-12 * (xx + yy.max()))[:, None]))
        return row + s, doc

    def limits(self, docs: _Docs) -> tuple[np.ndarray, np.ndarray] | None:
        """Factors (of queries, of packed documents) whose product has a field's highest bit set where a pair is open.

        With a and b the scales, x and y seen from the middle, X and Y rounded:
        ab (xy - yy / 2) <= XY - ab yy / 2 + |ax - X| |by| + |X| |by - Y|, and a distance of at most ``worst`` means
        ab (xy - yy / 2) >= ab (xx - worst) / 2. Sums are whole numbers below 2^53, so no order of adding changes them.
        None: fields would run over.
        """
        q, d, half = self.r, docs.r, 1 << (FIELD - 1)
        ab = q.scale * d.scale
        less = np.floor(ab * d.square / 2 - q.off.max() * d.scale * np.sqrt(d.square))
        margin = 1e-8 + 1e-12 * (self.square + docs.square.max())
        top = np.floor(ab * (q.square - self.worst - margin) / 2 - q.length * d.off.max() - 1)
        most = np.ceil(q.length * d.length.max()) + 1
        top = np.minimum(top, half - 1 - most - less.max())
        if (most - top - less.min() > half - 1).any():
            return None
        shift = docs.pack(half - np.pad(less, (0, FIELDS * docs.width - len(less)), constant_values=less.max())) + 2.0**52
        x = np.concatenate([q.whole, np.ones((len(top), 1)), -top[:, None]], 1)
        return x, np.concatenate([docs.packed, shift[:, None], np.full((docs.width, 1), sum(_PLACES))], 1)

    def maybe(self, docs: _Docs, factors: tuple[np.ndarray, np.ndarray], s: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that products of rounded vectors leave open, and those of single precision after them."""
        some = factors[0][s : s + 256]
        if self.room is None or self.room.shape != (len(some), docs.width):
            self.room = np.empty((len(some), docs.width))
            self.open = np.zeros(-(-self.room.size // 8) * 8, bool)
        bits = np.matmul(some, factors[1].T, out=self.room).view("int64").ravel()
        np.bitwise_and(bits, sum(_TOP), out=bits)
        np.not_equal(bits, 0, out=self.open[: len(bits)])
        at = (np.flatnonzero(self.open.view("int64"))[:, None] * 8 + np.arange(8)).ravel()  # few are open: looked for by eights
        at = at[self.open[at]]
        which = bits[at]
        hit = [np.flatnonzero(which & t) for t in _TOP]
        row = np.concatenate([at[h] // docs.width for h in hit]) + s
        doc = np.concatenate([at[h] % docs.width + i * docs.width for i, h in enumerate(hit)])
        real = doc < len(docs.ids)
        row, doc = row[real], doc[real]
        near = np.zeros(len(row), bool)
        for b in range(0, len(row), 65_536):
            i, j = row[b : b + 65_536], doc[b : b + 65_536]
            xx, yy = self.r.square[i], docs.r.square[j]
            dist = xx - 2.0 * np.einsum("ij,ij->i", self.r.x4.take(i, 0), docs.r.x4.take(j, 0)) + yy
            # a product of n single-precision terms misses by n + 2 roundings at most
            near[b : b + 65_536] = ~(dist > self.worst[i] + 1e-8 + (self.x.shape[1] + 2) * 2.0**-23 * (xx + yy))
        return row[near], doc[near]

    def merge(self) -> None:
        if not self.new:
            return
        row, distance, id_ = (np.concatenate([a, *b]) for a, b in zip((self.row, self.distance, self.id), zip(*self.new)))
        self.new, self.waiting = [], 0
        order = np.lexsort((id_, np.round(distance, 9), row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        self.row, self.distance, self.id = row[keep], distance[order][keep], id_[order][keep]
        last = place[keep] == self.k - 1
        self.worst[self.row[last]] = self.distance[last]

    def rows(self) -> pd.DataFrame:
        self.merge()
        return pd.DataFrame({"query_id": self.asked[self.row], "doc_id": self.id, "distance": self.distance})


def _vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return df.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))


def _cut(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("id"), blocks.cast("long")).cast("int")


def _ranked(best: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("distance", 9), "doc_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k)


def _best(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The k best documents of a block for every query of a block."""

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "doc_id": [], "distance": []})
        b = b.sort_values("id", kind="stable")
        x, y, ids = np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy()), b["id"].to_numpy()
        # 256 queries at a time bound the matrix of distances
        out = []
        for s in range(0, len(x), 256):
            part = x[s : s + 256]
            dist = np.maximum((part**2).sum(1)[:, None] - 2 * part @ y.T + (y**2).sum(1)[None, :], 0.0)
            near = np.argsort(np.round(dist, 9), axis=1, kind="stable")[:, :k]
            rows = np.repeat(np.arange(len(part)), near.shape[1])
            exact = ((part[rows] - y[near.ravel()]) ** 2).sum(1)
            out.append(pd.DataFrame({"query_id": a["id"].to_numpy()[s + rows], "doc_id": ids[near.ravel()], "distance": exact}))
        return pd.concat(out)

    return pair


@dataclass
class Index:
    """An inverted file: centres of cells and every document with its cell."""

    centres: np.ndarray
    docs: DataFrame


def build_index(docs: DataFrame, id_col: str, vec_col: str, cells: int | None = None, sample: int = 20_000, rounds: int = 8) -> Index:
    """Cells are fitted by k-means on at most ``sample`` documents, the first by hash; all documents are put into cells.

    ``cells``: by default one per BLOCK / 16 documents, at least 8 and at most 4,096, and no more than there are documents
    in the sample. Null vectors take no part.
    """
    d = _vectors(docs, id_col, vec_col)
    n = d.count()
    drawn = d.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()
    x = np.array([r["v"] for r in drawn], "float64") if drawn else np.zeros((1, 1))
    cells = min(len(x), cells or min(4_096, max(8, n * 16 // BLOCK)))
    centres = x[:: max(1, len(x) // cells)][:cells].copy()
    for _ in range(rounds):
        own = _closest(x, centres, 1)[:, 0]
        size = np.bincount(own, minlength=len(centres))
        for j in np.flatnonzero(size):
            centres[j] = x[own == j].mean(0)

    return Index(centres, d.withColumn("cell", _cells(centres, 1)[0]))


def _closest(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    dist = -2 * x @ centres.T + (centres**2).sum(1)[None, :]
    return np.argsort(dist, axis=1, kind="stable")[:, :k]


def _cells(centres: np.ndarray, k: int) -> Column:
    @F.pandas_udf("array<int>")
    def cells(s: pd.Series) -> pd.Series:
        return pd.Series(_closest(np.stack(s.to_numpy()), centres, k).tolist()) if len(s) else pd.Series([], dtype=object)

    return cells("v")


def nearest_indexed(queries: DataFrame, index: Index, id_col: str, vec_col: str, k: int, probes: int, block: int = BLOCK) -> DataFrame:
    """As ``nearest``, within the ``probes`` cells whose centres are nearest to a query: fast, not exact.

    A cell of more than ``block`` documents is split over tasks, to each of which its queries go.
    """
    d = index.docs
    sizes = d.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    d = d.join(sizes, "cell").withColumn("part", _cut(F.col("parts"))).drop("parts")
    q = _vectors(queries, id_col, vec_col).withColumn("cell", F.explode(_cells(index.centres, probes)))
    q = q.join(sizes, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    best = q.groupBy("cell", "part").cogroup(d.groupBy("cell", "part")).applyInPandas(_best(k), "query_id long, doc_id long, distance double")
    return _ranked(best, k)


def extend_cache(spark: SparkSession, path: str, collection: str, queries: DataFrame, docs: DataFrame, id_col: str, vec_col: str, k: int) -> None:
    """Append (idx, rank from 0, neighbour) of the queries that a cache does not hold yet, a folder per collection."""
    todo = queries
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        known = spark.read.parquet(path).filter(F.col("collection") == collection).select(F.col("idx").alias(id_col)).distinct()
        todo = queries.join(known, id_col, "left_anti")
    near = nearest(todo, docs, id_col, vec_col, k)
    rows = near.select(F.col("query_id").alias("idx"), (F.col("rank") - 1).cast("long").alias("rank"), F.col("doc_id").alias("neighbour"), F.lit(collection).alias("collection"))
    rows.write.mode("append").partitionBy("collection").parquet(path)


def prefetch_then_filter(ranked: DataFrame, query: str, rank: str, prefetch: int, keep: Column, n: int) -> DataFrame:
    """The first ``prefetch`` of every query, of these the kept ones, of these the first n: possibly fewer than n."""
    kept = ranked.filter(F.col(rank) <= prefetch).filter(keep)
    again = F.row_number().over(Window.partitionBy(query).orderBy(rank))
    return kept.withColumn("new_rank", again).filter(F.col("new_rank") <= n)


def first_per_group(ranked: DataFrame, query: str, group: str, rank: str, n: int) -> DataFrame:
    """Walking down the ranks, the first document of each group until n are found."""
    one = F.row_number().over(Window.partitionBy(query, group).orderBy(rank))
    per = ranked.withColumn("__one", one).filter("__one = 1").drop("__one")
    again = F.row_number().over(Window.partitionBy(query).orderBy(rank))
    return per.withColumn("new_rank", again).filter(F.col("new_rank") <= n)


def hash_embedding(text: Column, dims: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: signed word hashes, unit length."""

    @F.arrow_udf("array<double>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import zlib
        from functools import lru_cache

        @lru_cache(1 << 16)
        def place(w: str) -> int:
            h = zlib.crc32(w.encode())
            return h % dims + (0 if h & 0x10000 else dims)

        for s in batches:
            said = [list(map(place, (t or "").lower().split())) for t in s.to_pylist()]
            row = np.repeat(np.arange(len(said)), [len(x) for x in said]) * (2 * dims)
            n = np.bincount(row + np.fromiter(chain.from_iterable(said), "int64", len(row)), minlength=2 * dims * len(said)).reshape(len(said), 2, dims)
            v = (n[:, 0] - n[:, 1]).astype("float64")
            size = np.sqrt((v**2).sum(1, keepdims=True))
            yield pa.ListArray.from_arrays(np.arange(0, v.size + 1, dims, dtype="int32"), (v / np.where(size, size, 1.0)).ravel())

    return embed(text)
