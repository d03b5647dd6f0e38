"""Embedding near-duplicates by spherical-cap filters with structured random product codes.

Several times over, vectors are rotated at random and cut into two halves, each with a random code of unit vectors. A filter is a pair of
codewords, its direction their concatenation; a vector is in the filter if its inner product with the direction exceeds
a threshold. All filters that a vector exceeds are found by list decoding: codewords of the first half that can reach the
threshold with the best of the second, then the second half's codewords for each. A vector that exceeds fewer than LEAST_CAPS
filters of a code has its threshold lowered to its LEAST_CAPS-th best. Vectors that share a filter and a
label are compared by cosine in double precision, so nothing below the threshold links. The threshold of the caps is set
so that a vector exceeds about CAPS filters, and the code grows with the rows, so that a filter holds about LOAD vectors.

Equal vectors are one class, compared once. A pair that shares several filters counts in the first of them only. Groups
of more than TILE are cut into tiles compared pair by pair. From a task come sums of links by vector and a spanning forest.

Defined cases: null label, null or empty vector, null, NaN or infinite components and the zero vector link with nothing;
vectors of different lengths never link; repeated rows are vectors that link with each other; null ids are carried, and
are no component's smallest id unless all are null; a cosine that double precision can't tell from the threshold links or not
as it is rounded; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .durable import durable
from .simhash import forest
from .tiles import tiled

COSINE = 0.98
#: Codes, and filters of each that a vector exceeds: on average, and at least. tests/llm/test_embeddings.py measures recall.
CODES, CAPS, LEAST_CAPS = 3, 8, 6
#: Vectors in a filter, on average, that the size of the code aims at.
LOAD = 16
LEAST_CODE = 96
#: Numbers of a matrix that is made at a time, 16 MB: bounds the memory of a worker at every size of the code.
CELLS = 1 << 21
TILE = 256
SEED = 7


def code_size(rows: int) -> int:
    """Codewords a half: CAPS / size ** 2 is the share of all vectors in a filter."""
    return max(LEAST_CODE, math.ceil(math.sqrt(CAPS * rows / LOAD)))


@lru_cache(maxsize=8)
def code(dim: int, size: int, number: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(first half's, second half's filter inner products as matrices, threshold) for vectors of a length."""
    rnd = np.random.default_rng([SEED, dim, size, number])
    turn, _ = np.linalg.qr(rnd.standard_normal((dim, dim)))
    half = (dim + 1) // 2
    parts = []
    for part in (turn[:, :half], turn[:, half:]):
        h = part.shape[1]
        words = rnd.standard_normal((h, size)) if h > 1 else np.array([[1.0, -1.0]])[:, : h + 1][:h]  # no more directions in 1 or 0 dimensions
        parts.append(part @ (words / np.maximum(np.linalg.norm(words, axis=0), 1e-300)) / math.sqrt(2))
    # the threshold, on unit vectors drawn at random
    units = rnd.standard_normal((512, dim))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    a, b = units @ parts[0], units @ parts[1]
    low, high = 0.0, 1.0
    for _ in range(30):
        middle = (low + high) / 2
        b_sorted = np.sort(b, axis=1)
        over = sum(int((len(y) - np.searchsorted(y, middle - x)).sum()) for x, y in zip(a[:96], b_sorted[:96], strict=True))
        low, high = (middle, high) if over > CAPS * 96 else (low, middle)
    return parts[0], parts[1], low


def decode(vectors: np.ndarray, size: int) -> list[np.ndarray]:
    """The filters that each unit vector exceeds, ascending; those of the codes follow each other."""
    out = [np.zeros((0, 2), np.int64)]
    for number in range(CODES):
        first, second, threshold = code(vectors.shape[1], size, number)
        n, m = first.shape[1], second.shape[1]
        most = min(LEAST_CAPS, max(1, n * m // 2))
        step = max(1, CELLS // max(n, m))
        for at in range(0, len(vectors), step):
            part = vectors[at : at + step]
            a, b = part @ first, part @ second
            # the best sums are of the best of either half
            best_a, best_b = (np.partition(x, max(0, x.shape[1] - most), axis=1)[:, -most:] for x in (a, b))
            sums = (best_a[:, :, None] + best_b[:, None, :]).reshape(len(part), -1)
            enough = -np.partition(-sums, most - 1, axis=1)[:, most - 1]
            least = np.minimum(threshold, enough)
            row, i = np.nonzero(a >= (least - b.max(axis=1))[:, None] - 1e-12)
            for low in range(0, len(row), step):
                r, w = row[low : low + step], i[low : low + step]
                k, j = np.nonzero(a[r, w][:, None] + b[r] >= least[r][:, None])
                out.append(np.stack([r[k] + at, (number * n + w[k]) * m + j], axis=1))
    pairs = np.concatenate(out)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    return np.split(pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(1, len(vectors))))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow of squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _filtered(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("dim").to_numpy()
            for dim in np.unique(length):
                part = batch.filter(pa.array(length == dim))
                for at in range(0, part.num_rows, 2048):
                    piece = part.slice(at, 2048)
                    vectors = piece.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    found = decode(_unit(vectors.reshape(-1, dim)), size)
                    own = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]), pa.int32()), pa.array(np.concatenate(found), pa.int64()))
                    yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in ("cid", "label", "dim", "m", "embedding")), own], ["cid", "label", "dim", "m", "embedding", "filters"])

    return run


def _shared(owners: np.ndarray, filters: np.ndarray, left: int, right: slice, n: int) -> np.ndarray:
    """[left item, right item]: whether the two have one of the filters (of item owners[k]: filters[k]) in common."""
    _, code = np.unique(filters, return_inverse=True)
    out = np.zeros((left, right.stop - right.start), bool)
    several = int(code.max(initial=-1)) + 1
    width = max(1, min(several, CELLS // max(1, n)))
    for low in range(0, several, width):
        here = (code >= low) & (code < low + width)
        has = np.zeros((n, width), np.float32)
        has[owners[here], code[here] - low] = 1
        out |= has[:left] @ has[right].T > 0
    return out


def _compared(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n = [], [], []
            filters = batch.column("at").to_numpy()
            for at, row in enumerate(batch.column("tiles")):
                tiles = [t.values for t in row.values]  # views of the batch, no Python numbers
                items = pa.concat_arrays(tiles)
                left, every = len(tiles[0]), len(items)
                right = slice(left, every) if len(tiles) > 1 else slice(0, left)
                cid, m = (items.field(c).to_numpy() for c in ("cid", "m"))
                unit = _unit(items.field("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(every, -1))
                close = unit[:left] @ unit[right].T >= threshold
                if len(tiles) == 1:
                    close &= ~np.eye(left, dtype=bool)
                if not close.any():
                    continue
                own = items.field("filters")
                earlier, owners = own.flatten().to_numpy(), np.repeat(np.arange(every), own.value_lengths().to_numpy())
                before = earlier < filters[at]
                close &= ~_shared(owners[before], earlier[before], left, right, every)  # no earlier filter in common
                sides = [(cid[:left], close @ m[right])]
                if len(tiles) > 1:
                    sides.append((cid[right], close.T @ m[:left]))
                for ids, links in sides:
                    a.append(ids[links > 0])
                    b.append(ids[links > 0])
                    n.append(links[links > 0])
                i, j = np.nonzero(close)
                root = forest(every, i, j + right.start)
                moved = np.flatnonzero(root != np.arange(every))
                a.append(cid[moved])
                b.append(cid[root[moved]])
                n.append(np.zeros(len(moved), np.int64))
            a, b, n = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b, n))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = COSINE, tile: int = TILE) -> DataFrame:
    """vectors(vec_id, embedding, label) -> one row a vector: vec_id, n_links, component_id, kept."""
    numbers = F.col("embedding")
    infinite = F.lit(float("inf"))
    sound = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    sound = F.col("label").isNotNull() & numbers.isNotNull() & (F.size(numbers) > 0) & sound & F.exists(numbers, lambda x: x != 0)
    rows = vectors.select("vec_id", "label", "embedding", F.coalesce(sound, F.lit(False)).alias("sound"))
    classes = rows.filter("sound").groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("least"))
    classes = durable(classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")))
    kinds = dict(classes.dtypes)
    size = code_size(classes.count())
    shape = f"cid long, label {kinds['label']}, dim int, m long, embedding {kinds['embedding']}, filters array<long>"
    met = durable(classes.select("cid", "label", "dim", "m", "embedding").mapInArrow(_filtered(size), shape))
    item = F.struct("cid", "m", "embedding", "filters").alias("item")
    met = met.select("label", "dim", F.explode("filters").alias("at"), item)
    pairs = tiled(met, ["label", "dim", "at"], "item", F.xxhash64("item.cid"), tile)
    found = durable(pairs.select("at", "tiles").mapInArrow(_compared(threshold), "a long, b long, n long"))
    links = found.filter("n > 0").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("links"))
    roots = components(found.filter("n = 0").select("a", "b")).select(F.col("node").alias("cid"), "root")
    known = classes.select("cid", "label", "embedding", "m", "least").join(links, "cid", "left").join(roots, "cid", "left")
    known = durable(known.withColumn("root", F.coalesce("root", "cid")))
    least = known.groupBy("root").agg(F.min("least").alias("component"))
    known = known.join(least, "root").select("label", "embedding", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n"), "component")
    out = rows.filter("sound").join(known, ["label", "embedding"]).select("vec_id", F.col("n").alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.filter(~F.col("sound")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
