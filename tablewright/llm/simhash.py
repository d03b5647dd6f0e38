"""SimHash near-duplicates by bit-sliced comparison.

A document's fingerprint has 64 bits, each set where it is set in over half of the XXH64 hashes of the document's
word shingles. Fingerprints within a radius of differing bits link, and linked documents form classes.

Equal fingerprints are compared once. The bits are cut into r + 3 blocks. Two fingerprints within radius r agree on three of
them at least, so only fingerprints that share the bits of three blocks meet (ten tables of some 38 bits for a radius of 2, so
that fingerprints which are far apart hardly ever do). Where they meet, one side is stored vertically: 64 fingerprints to a machine word, one word for
each bit. The distances of a whole word of fingerprints to another are added up by carry-save adders in two counter
words and a mask of those beyond the radius; words in which all are beyond it are abandoned. Buckets of more than
TILE fingerprints are cut into tiles, and all pairs of tiles are compared, in tasks of their own. What leaves a task is
a spanning forest of the links that it found, not the links.

Defined cases: a null, empty or blank text has fingerprint zero and links like any other; a text of fewer words than a
shingle is one shingle; rows repeated have the same class; a null doc_id is never a class's smallest unless all are null;
other columns are ignored by `near_duplicates` and carried by `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .durable import durable
from .textscan import Words, slices
from .tiles import tiled

SHINGLE, SEED, RADIUS = 3, 42, 2
TILE = 256

_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprints(column: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The uint64 fingerprint of each text."""
    words = Words(column)
    starts, ends, first = words.shingles(shingle)
    data, digest = words.data.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(data[s:e], seed) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    out, count = np.zeros(len(column), np.uint64), np.diff(first)
    if not len(hashes):
        return out
    # counters of eight bits to a word hold up to 255 hashes: chunks of so many, then sums of chunks
    chunks = -(-count // 255)
    chunk_first = np.concatenate([[0], np.cumsum(chunks)])
    at = np.repeat(first[:-1], chunks) + 255 * (np.arange(chunk_first[-1]) - np.repeat(chunk_first[:-1], chunks))
    has = count > 0
    for k, byte in enumerate(hashes.view(np.uint8).reshape(-1, 8).T):
        ones = np.add.reduceat(_BYTE[byte], at).view(np.uint8).reshape(-1, 8).astype(np.int64)
        ones = np.add.reduceat(ones, chunk_first[:-1][has], axis=0)
        bits = np.packbits(2 * ones > count[has][:, None], axis=1, bitorder="little").ravel()
        out[has] |= bits.astype(np.uint64) << np.uint64(8 * k)
    return out


def close_pairs(left: np.ndarray, right: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of left[i] and right[j] that differ in at most `radius` (up to 2) bits."""
    if radius not in (0, 1, 2):
        raise ValueError("counters hold a radius of 0, 1 or 2")
    width = -(-len(right) // 64)
    bits = np.zeros((width * 64, 64), np.uint8)
    bits[: len(right)] = np.unpackbits(right.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)  # [bit, word]
    signs = np.where((left[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1), _FULL, np.uint64(0)).T  # [bit, i]
    padding = np.zeros(width, np.uint64)
    if len(right) % 64:
        padding[-1] = _FULL << np.uint64(len(right) % 64)
    row, word = (x.ravel() for x in np.indices((len(left), width)))
    ones, twos, beyond = np.zeros(len(row), np.uint64), np.zeros(len(row), np.uint64), padding[word]
    for k in range(0, 64, 4):
        a, b, c, d = (planes[p][word] ^ signs[p][row] for p in range(k, k + 4))
        ab = a ^ b
        add, carry = ab ^ c, (a & b) | (c & ab)  # a carry-save adder: three bits to a sum and a carry
        low = add ^ d
        carry2 = add & d
        carry3 = ones & low
        ones = ones ^ low
        twice = twos ^ carry
        four = (twos & carry) | (twice & carry2)
        twice ^= carry2
        four |= twice & carry3
        twos = twice ^ carry3
        if radius == 2:
            beyond = beyond | four | (ones & twos)
        else:
            beyond = beyond | four | twos | (ones if radius == 0 else np.uint64(0))
        live = beyond != _FULL
        if k % 8 == 4 and not live.all():
            row, word, ones, twos, beyond = (x[live] for x in (row, word, ones, twos, beyond))
            if not len(row):
                break
    near = np.unpackbits(np.ascontiguousarray(~beyond).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    block, bit = np.nonzero(near)
    return row[block], word[block] * 64 + bit


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the edges (i, j) connect it with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        while (new[new] != new).any():
            new = new[new]
        new = new[root]
        if (new == root).all():
            return root
        root = new


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, roots = [], []
            for row in batch.column("tiles"):
                tiles = [t.values.to_numpy().view(np.uint64) for t in row.values]  # views of the batch, no Python numbers
                left, right = tiles[0], tiles[-1]
                i, j = close_pairs(left, right, radius)
                if len(tiles) > 1:
                    j, both = j + len(left), np.concatenate([left, right])
                else:
                    both = left
                root = forest(len(both), i, j)
                moved = np.flatnonzero(root != np.arange(len(both)))
                nodes.append(both[moved])
                roots.append(both[root[moved]])
            a, b = (np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (nodes, roots))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """prints(fp), distinct -> edges (a, b) that connect just what pairs within the radius connect."""
    cuts = [round(64 * k / (radius + 3)) for k in range(radius + 4)]
    blocks = [((1 << b) - (1 << a)) for a, b in zip(cuts, cuts[1:], strict=False)]
    masks = [a | b | c for a, b, c in combinations(blocks, 3)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    band = F.array(*[F.struct(F.lit(i).cast("byte").alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(signed)])
    met = prints.select("fp", F.explode(band).alias("k")).select("fp", "k.*")
    pairs = tiled(met, ["band", "bits"], "fp", F.xxhash64("fp"), tile)
    return pairs.select("tiles").mapInArrow(_compare(radius), "a long, b long")


def _prints(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fp = fingerprints(part.column("text"), shingle, seed).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(fp)], [*part.schema.names[1:], "fp"])

    return run


def classes(rows: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """rows(doc_id, fp) -> (fp, root, component_id): one row a fingerprint; root names its class."""
    prints = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("fewest")))
    roots = components(links(prints.select("fp"), radius, tile))
    at = prints.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    at = durable(at)
    least = at.groupBy("root").agg(F.min("fewest").alias("component_id"))
    return at.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """One row a document: doc_id, fp (long), component_id (smallest doc_id reachable by links, itself included)."""
    rows = durable(docs.select("text", "doc_id").mapInArrow(_prints(shingle, seed), "doc_id long, fp long"))
    return rows.join(classes(rows, radius), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each class, that of the smallest doc_id (null last); among rows of one doc_id, of the
    smallest text hash; among rows that agree in both, any.

    Only (doc_id, hash of the text, fingerprint) are grouped; the rows themselves are picked by a join on the first two.
    """
    narrow = docs.select("text", "doc_id", F.xxhash64("text").alias("th")).mapInArrow(_prints(shingle, seed), "doc_id long, th long, fp long")
    rows = durable(narrow.groupBy("doc_id", "th", "fp").agg(F.count(F.lit(1)).alias("n")))
    return first_of_each(docs, rows.join(classes(rows, radius).select("fp", "root"), "fp"))


def first_of_each(docs: DataFrame, at: DataFrame) -> DataFrame:
    """docs with one row of each root; at(doc_id, th, n, root): the n rows of a doc_id and hash of the text, and their class."""
    best = F.min_by(F.struct("doc_id", "th", "n"), F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("th")))
    kept = at.groupBy("root").agg(best.alias("k")).select(F.col("k.doc_id").alias("_k_id"), F.col("k.th").alias("_k_th"), F.col("k.n").alias("_k_n"))
    row = F.col("_row")
    named = docs.select(F.struct(*docs.columns).alias("_row"))
    met = named.join(kept, row["doc_id"].eqNullSafe(F.col("_k_id")) & (F.xxhash64(row["text"]) == F.col("_k_th")))
    single = met.filter("_k_n = 1").select("_row")
    repeated = met.filter("_k_n > 1").groupBy("_k_id", "_k_th").agg(F.first("_row").alias("_row")).select("_row")
    return single.union(repeated).select("_row.*")
