"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Short items are looked for inside long documents. Against a whole long document an item's MinHash would drown, so both
sides are partitioned by size: items by the power of two above their number of five-word shingles, and for each of these
classes documents are cut into windows of about that many shingles, half of each shared with the next. So wherever an item of
which 80 % are held stands, some window has a Jaccard similarity of 0.36 or more with it (0.25 for either half of an item held
in two places). A sketch is a one-permutation MinHash of fewer bins than the set has shingles: hashes are dealt to the bins of
the class, the least of each bin stays, and a bin agrees with about the probability of the similarity. A document and an
item that agree in as many bins as the class needs (CLASSES), in whatever windows, are candidates. Items of up to FEW shingles,
for which a sketch would be as large as the set, are a class of their own: each of their shingles is a bin.
Candidates are verified on the shingles themselves, over the whole document: the share of the item's distinct shingles
that the document has. Shingles are found by 64-bit hashes and their bytes compared.

The items travel to the executors in blocks of at most BLOCK_BYTES of text, one pass over the documents for each block. A block
is a few flat arrays, some five times its text in all.

Defined cases: letters A-Z are lower-cased, words are space-joined; a text of fewer than five words is one shingle, so
a short item is found only in a document that equals it, unless `inside` is set (the pipeline does), by which an item of
fewer than five words is compared with all the document's windows of as many words; texts that are null or without words match nothing; a very long text
is one of many windows, and handled alone; a containment of exactly 0.8 counts; repeated
rows give repeated results; null ids are carried; an empty table on either side gives an empty result; other columns
are ignored by `search` and carried by `drop_contaminated`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable
from .textscan import Words, slices, span_hashes

SHINGLE, THRESHOLD = 5, 0.8
#: Windows of the classes, in shingles, and for each the bins of a sketch and how many must agree. A similarity of 0.36 misses
#: with a probability of 0.64 ** 16, below one in 1,000, in the smallest class and below one in 10,000 in the others.
CLASSES = {32: (16, 1), 64: (32, 2), 128: (64, 4), 256: (64, 4), 512: (64, 4)}
#: Items of so few shingles are compared with windows of one.
FEW = 8
BLOCK_BYTES = 16 << 20


def window_minima(hashes: np.ndarray, window: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, bin << 32 | least) of one-permutation MinHash; window ascends from 0 and is below 2 ** 20."""
    key = (window.astype(np.uint64) << np.uint64(44)) | ((hashes & np.uint64(bins - 1)) << np.uint64(32)) | (hashes >> np.uint64(32))
    key = np.sort(key)
    head = key >> np.uint64(32)
    new = np.concatenate([[True], head[1:] != head[:-1]])
    key = key[new]
    return (key >> np.uint64(44)).astype(np.int64), key & np.uint64((1 << 44) - 1)


def single(hashes: np.ndarray) -> np.ndarray:
    """The sketches of windows of one shingle."""
    return ((hashes & np.uint64(0xFFF)) << np.uint64(32)) | (hashes >> np.uint64(32))


def distinct_shingles(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, first): the distinct shingles of text i, by ascending hash, from first[i] to first[i + 1]."""
    starts, ends, first = words.shingles(SHINGLE)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends, first
    hashes = span_hashes(words.data, starts, ends)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    order = order[new]
    return hashes[new], starts[order], ends[order], np.searchsorted(text[new], np.arange(len(first)))


class Items:
    """A block of items: their distinct shingles and, by size class, a table from sketch entries to items."""

    def __init__(self, ids: list, texts: list[str | None], inside: bool = False):
        words = Words(pa.array(texts, pa.string()))
        self.ids, self.data = ids, words.data
        self.hashes, self.starts, self.ends, self.first = distinct_shingles(words)
        self.total = np.diff(self.first)
        n_words = np.diff(words.first)
        #: By number of words, the hashes of items shorter than a shingle and the items' numbers, if these are looked for inside documents.
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        apart = (n_words < SHINGLE) if inside else np.zeros(len(ids), bool)
        size = np.where(self.total <= FEW, 1, max(CLASSES))
        for window in sorted(CLASSES, reverse=True):
            size[(self.total > FEW) & (self.total <= window)] = window
        self.classes = []
        for window in (1, *CLASSES):
            members = np.flatnonzero((size == window) & (self.total > 0) & ~apart)
            if not len(members):
                continue
            bins, need = CLASSES.get(window, (0, 1))
            entries, owners = [], []
            for n in members.tolist():
                hashes = self.hashes[self.first[n] : self.first[n + 1]]
                if window == 1:
                    entries.append(single(hashes))
                else:
                    # an item longer than the largest window has a sketch for each window's length of its shingles, in any order
                    entries += [window_minima(part, np.zeros(len(part), np.int64), bins)[1] for part in (hashes[at::-(-len(hashes) // window)] for at in range(-(-len(hashes) // window)))]
                owners.append(np.full(sum(map(len, entries)) - sum(map(len, owners)), n, np.int32))
            entry, owner = np.concatenate(entries), np.concatenate(owners)
            order = np.argsort(entry, kind="stable")
            maybe = np.zeros(1 << 20, bool)
            maybe[entry & np.uint64((1 << 20) - 1)] = True
            self.classes.append((window, bins, need, entry[order], owner[order], maybe))
        for count in range(1, SHINGLE):
            members = np.flatnonzero(apart & (n_words == count))
            if len(members):
                hashes = self.hashes[self.first[members]]
                order = np.argsort(hashes, kind="stable")
                self.short[count] = hashes[order], members[order]

    def shingle(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()

    def inside(self, words: Words) -> set[tuple[int, int]]:
        """(document, item) pairs of the items of `short` and the documents that hold them."""
        out: set[tuple[int, int]] = set()
        for size, (entry, owner) in self.short.items():
            starts, ends, first = words.shingles(size)
            hashes = span_hashes(words.data, starts, ends)
            hit = np.flatnonzero(np.isin(hashes, entry))
            doc = np.searchsorted(first, hit, "right") - 1
            _, once = np.unique(np.stack([doc.astype(np.uint64), hashes[hit]]), axis=1, return_index=True)
            for h, d in zip(hit[once].tolist(), doc[once].tolist(), strict=True):
                text = words.data[starts[h] : ends[h]].tobytes()
                a, b = np.searchsorted(entry, hashes[h], "left"), np.searchsorted(entry, hashes[h], "right")
                out.update((d, int(n)) for n in owner[a:b] if text == self.shingle(int(self.first[n])))
        return out

    def candidates(self, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int]]:
        """(document, item) pairs that agree in enough bins; documents' hashes run from first[i] to first[i + 1]."""
        count = np.diff(first)
        doc = np.repeat(np.arange(len(count)), count)
        place = np.arange(len(hashes)) - np.repeat(first[:-1], count)
        for window, bins, need, entry, owner, maybe in self.classes:
            met: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            if window == 1:
                met.append(self._matched(single(hashes), doc, entry, owner, maybe))
            else:
                half = window // 2
                blocks = -(-count // half)  # of half a window each; a window is two blocks on end
                base = np.cumsum(blocks + 1) - (blocks + 1)
                block = place // half + base[doc]
                twice = np.concatenate([block, block + 1])
                again = np.concatenate([hashes, hashes])
                window_doc = np.repeat(np.arange(len(count)), blocks + 1)
                for low in range(0, len(window_doc), 1 << 20):
                    part = (twice >= low) & (twice < low + (1 << 20)) if len(window_doc) > 1 << 20 else slice(None)
                    at, least = window_minima(again[part], twice[part] - low, bins)
                    met.append(self._matched(least, window_doc[at + low], entry, owner, maybe))
            d, n, agreed = (np.concatenate(x) for x in zip(*met, strict=True))
            if len(d):
                # a bin that agrees in several windows counts once
                once = np.unique(np.stack([d, n, agreed]), axis=1)
                pair, times = np.unique(once[:2], axis=1, return_counts=True)
                yield from zip(*pair[:, times >= need].tolist(), strict=True)

    @staticmethod
    def _matched(least, doc, entry, owner, maybe) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, entry) of the sketch entries that are also items'."""
        hit = np.flatnonzero(maybe[least & np.uint64((1 << 20) - 1)])
        left, right = np.searchsorted(entry, least[hit], "left"), np.searchsorted(entry, least[hit], "right")
        n = right - left
        which = np.repeat(np.arange(len(hit)), n)
        at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + left[which]
        return doc[hit[which]], owner[at].astype(np.int64), entry[at].astype(np.int64)


def found(items: Items, texts: pa.Array) -> list[tuple[int, int, int]]:
    """(document, item, shared distinct shingles) of the pairs that reach the threshold."""
    words = Words(texts)
    starts, ends, first = words.shingles(SHINGLE)
    if not len(starts):
        return []
    hashes = span_hashes(words.data, starts, ends)
    of: dict[int, list[int]] = {}
    for d, n in items.candidates(hashes, first):
        of.setdefault(d, []).append(n)
    out = []
    for d, members in sorted(of.items()):
        a, b = int(first[d]), int(first[d + 1])
        has, at = np.unique(hashes[a:b], return_index=True)
        for n in sorted(members):
            own = slice(int(items.first[n]), int(items.first[n + 1]))
            _, mine, its = np.intersect1d(items.hashes[own], has, assume_unique=True, return_indices=True)
            places = zip((mine + own.start).tolist(), (at[its] + a).tolist(), strict=True)
            shared = sum(items.shingle(k) == words.data[starts[p] : ends[p]].tobytes() for k, p in places)
            if shared >= THRESHOLD * items.total[n]:
                out.append((d, n, shared))
    out += [(d, n, 1) for d, n in sorted(items.inside(words))]
    return out


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES, inside: bool = False) -> Iterator[Items]:
    """The items, as often as needed, in blocks of about `limit` bytes."""
    rows = benchmark.select("item_id", "text").filter("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // limit)
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
        table = part.toArrow()
        block = Items(table.column("item_id").to_pylist(), table.column("text").to_pylist(), inside)
        if block.total.any():
            yield block


def search(docs: DataFrame, benchmark: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """One row a document and item that it holds: doc_id, item_id, shared, total (distinct shingles), containment."""
    out = None
    for items in blocks(benchmark, limit):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                for part in slices(batch, "text"):
                    hits = found(items, part.column("text"))
                    ids = part.column("doc_id").take(pa.array([d for d, _, _ in hits], pa.int64()))
                    total = [int(items.total[n]) for _, n, _ in hits]
                    shared = [s for _, _, s in hits]
                    columns = [ids, pa.array([items.ids[n] for _, n, _ in hits], pa.int64()), pa.array(shared, pa.int64()), pa.array(total, pa.int64()), pa.array([s / t for s, t in zip(shared, total, strict=True)], pa.float64())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "shared", "total", "containment"])

        one = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, shared long, total long, containment double")
        if out is not None:
            one = durable(one)  # one block after the other
            sent.unpersist()
        out = one if out is None else out.union(one)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, shared long, total long, containment double")
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, limit: int = BLOCK_BYTES, inside: bool = False) -> DataFrame:
    """docs without those that hold an item, items of fewer than five words included if `inside`. One pass a block, no shuffle."""
    at = docs.columns.index("text")
    for items in blocks(benchmark, limit, inside):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                for part in slices(batch, batch.schema.names[at]):
                    keep = np.ones(part.num_rows, bool)
                    keep[[d for d, _, _ in found(items, part.column(at))]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
