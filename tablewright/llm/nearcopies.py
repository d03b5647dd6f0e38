"""Near copies by SimHash and by exact Jaccard similarity of word shingles, for the corpus pipeline.

Documents link whose fingerprints are within op4's radius, as `simhash` finds them by bit-sliced comparison. Near copies of a
similarity of 0.8 are further apart than fingerprints of 64 bits can tell from chance, so others link by their shingles too:

A document is the set of its distinct 5-word shingles; sets whose Jaccard similarity is SIMILAR or more link, and documents
that links of either kind connect form classes. Equal sets are compared once. Others become candidates by MinHash: BANDS keys of ROWS minima each,
so that a pair of similarity 0.8 shares no key with probability (1 - 0.8 ** 5) ** 40, below 2 in 10 ** 7. Each bucket of a key is
linked to its smallest member only, and all pairs of the candidate groups that these links connect are compared, in
tiles, in tasks of their own. The comparison counts the shingles that two sets share, so that nothing below the
threshold links. What leaves a task is a spanning forest of the links that it found, not the links.

Shingles are told apart by 64-bit hashes, sets by the 64-bit sum of their mixed hashes and their size.

Defined cases: as in `simhash`, words are lower-cased (A-Z) and space-joined, a text of fewer words than a shingle is one
shingle, null, empty and blank texts are one set, repeated rows have the same class, a null doc_id is last and other
columns are carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .durable import durable, few
from .simhash import fingerprints, first_of_each, forest, links
from .textscan import Words, mix64, slices, span_hashes
from .tiles import tiled

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 40, 5
TILE = 256
#: Shared shingles of a pair of tiles counted at a time.
COLUMNS = 4096

_RANDOM = np.random.default_rng(5).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
_FLIP, _TIMES = _RANDOM[0], _RANDOM[1] | np.uint64(1)


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the distinct shingles of text i, ascending, from first[i] to first[i + 1]."""
    words = Words(column)
    starts, ends, first = words.shingles(shingle)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    hashes = span_hashes(words.data, starts, ends)
    text = np.repeat(np.arange(len(column)), np.diff(first))
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], np.searchsorted(text[new], np.arange(len(column) + 1))


def signatures(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(name of each set, [set, band] keys); an empty set has name and keys 0."""
    count = np.diff(first)
    has = count > 0
    names, keys = np.zeros(len(count), np.uint64), np.zeros((len(count), BANDS), np.uint64)
    if not has.any():
        return names, keys
    at = first[:-1][has]
    names[has] = mix64(np.add.reduceat(mix64(hashes), at) + count[has].astype(np.uint64))
    for band in range(BANDS):
        key = np.zeros(len(at), np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            key = mix64(key + np.minimum.reduceat((hashes ^ _FLIP[k]) * _TIMES[k], at))
        keys[has, band] = key
    return names, keys


def similar_pairs(hashes: np.ndarray, first: np.ndarray, left: int, similar: float = SIMILAR) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the sets i < left and j >= left, or of all i and j if left is their number, that are similar."""
    count = np.diff(first)
    both = left < len(count)
    rows, columns = slice(0, left), slice(left, None) if both else slice(None)
    owner = np.repeat(np.arange(len(count)), count)
    _, code, times = np.unique(hashes, return_inverse=True, return_counts=True)
    shared = times > 1  # no other set has the rest
    place = np.cumsum(shared) - 1
    owner, code = owner[shared[code]], place[code[shared[code]]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    common = np.zeros((left, len(count) - left if both else left), np.int64)
    for low in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(code, [low, low + COLUMNS])
        has = np.zeros((len(count), COLUMNS), np.float32)
        has[owner[a:b], code[a:b] - low] = 1
        common += (has[rows] @ has[columns].T).astype(np.int64)
    union = count[rows][:, None] + count[columns][None, :] - common
    # a set meets itself by the unshared shingles too, and links to itself mean nothing
    i, j = np.nonzero((common >= similar * union) & (common > 0))
    return i, j + left if both else j


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            names, keys = signatures(*shingle_sets(part.column("text")))
            offsets = pa.array(np.arange(len(names) + 1, dtype=np.int32) * BANDS)
            bands = pa.ListArray.from_arrays(offsets, pa.array(keys.ravel().view(np.int64)))
            prints = pa.array(fingerprints(part.column("text")).view(np.int64))
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(names.view(np.int64)), prints, bands], [*part.schema.names[1:], "name", "fp", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            hashes, first = shingle_sets(part.column("text"))
            shingles = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*part.columns[1:], shingles], [*part.schema.names[1:], "shingles"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, roots = [], []
        for row in batch.column("tiles"):
            tiles = [t.values for t in row.values]
            names = np.concatenate([t.field("name").to_numpy() for t in tiles])
            sets = [s.values.to_numpy().view(np.uint64) for t in tiles for s in t.field("shingles")]
            first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            i, j = similar_pairs(np.concatenate(sets), first, len(tiles[0]))
            root = forest(len(names), i, j)
            moved = np.flatnonzero(root != np.arange(len(names)))
            nodes.append(names[moved])
            roots.append(names[root[moved]])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (nodes, roots))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _by_fingerprint(prints: DataFrame, tile: int) -> DataFrame:
    """prints(name, fp), distinct -> edges (a, b) of names: of each class of fingerprints the smallest name with all others."""
    roots = components(links(prints.select("fp").distinct(), tile=tile)).select(F.col("node").alias("fp"), "root")
    at = durable(prints.join(roots, "fp", "left").select("name", F.coalesce("root", "fp").alias("root")))
    least = at.groupBy("root").agg(F.min("name").alias("a"), F.max("name").alias("most")).filter("a <> most").select("root", "a")
    return at.join(few(durable(least)), "root").filter("a <> name").select("a", F.col("name").alias("b"))


def keep_one(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """docs with one row of each class, chosen as by `simhash.keep_one`."""
    th = F.xxhash64("text").alias("th")
    scanned = durable(docs.select("text", "doc_id", th).mapInArrow(_scan, "doc_id long, th long, name long, fp long, keys array<long>"))
    rows = scanned.groupBy("doc_id", "th", "name").agg(F.count(F.lit(1)).alias("n"))
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "keys")).alias("v")
    sets = durable(scanned.groupBy("name").agg(one).select("name", "v.doc_id", "v.th", "v.keys"))
    met = sets.select("name", F.posexplode("keys").alias("band", "key"))
    least = met.groupBy("band", "key").agg(F.min("name").alias("least"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    stars = met.join(least, ["band", "key"]).filter("name <> least").select(F.col("least").alias("a"), F.col("name").alias("b"))
    near = components(stars).select(F.col("node").alias("name"), F.col("root").alias("near"))
    wanted = durable(near.join(sets, "name").select("name", "near", F.col("doc_id").alias("_id"), F.col("th").alias("_th")))
    texts = docs.select("text", "doc_id", th).join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")))
    held = texts.select("text", "name", "near").mapInArrow(_sets, "name long, near long, shingles array<long>")
    held = durable(held.groupBy("near", "name").agg(F.first("shingles").alias("shingles")))
    tiles = tiled(held.select("near", F.struct("name", "shingles").alias("item")), ["near"], "item", F.xxhash64("item.name"), tile)
    alike = tiles.select("tiles").mapInArrow(_compare, "a long, b long")
    close = _by_fingerprint(durable(scanned.select("name", "fp").distinct()), tile)
    roots = components(alike.union(close)).select(F.col("node").alias("name"), "root")
    at = rows.join(roots, "name", "left").withColumn("root", F.coalesce("root", "name"))
    return first_of_each(docs, at)
