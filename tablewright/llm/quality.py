"""A quality classifier by co-training.

Two separate views of a document, each with a logistic classifier of its own: its content (hashed byte trigrams, measures of
its words and of its lines) and its page metadata (source, language, stated length), which never reads the text. Both
learn from labelled documents. Then, in each of ROUNDS rounds, both label the documents of which they are confident, after
calibration, for the other to learn from. At last both are calibrated (Platt) on labelled documents held back from
learning, a logistic combination of the calibrated views is fitted on the same, and all documents are scored.

The unlabelled documents are the whole table but for the labelled ones that models are fitted on: each round scores a new part of it, so that each document is scored once.
Of the documents of which a view is confident, those of the smallest hash are learned from, EACH of a class, view and round.
Models are fitted on the driver, on LABELLED documents and these at most; the LABELLED ones are those of the smallest hash of their
id. Draws depend on the rows alone, so reruns agree. Scoring is one pass over all documents, without a shuffle.

Defined cases: a null or empty text has zero content features; a very long text is handled whole, alone; null source, lang or n_chars
are values of their own; labels that are null are none, a document of several labels has the class of their mean (0.5: good); a
document without labels or id is only scored; of rows of one doc_id one learns, that of the smallest hash of its text; with no
labels of either class all documents score 0.5 and are kept, as is any that scores KEEP exactly; repeated rows get equal
scores; an empty table gives an empty result; other columns are ignored by `score` and carried by `keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable, remove, scratch
from .textscan import Words, mix64, slices, span_hashes, text_bytes

#: Labelled documents at most that models are fitted on, and those that a view labels for the other, of each class and round.
LABELLED, EACH = 4000, 250
ROUNDS, CONFIDENT = 4, 0.95
#: A document is kept from this combined probability of good quality on.
KEEP = 0.5
GRAMS, MEASURES = 1024, 8
SOURCES, LANGS, BINS = 64, 16, 24
#: Numbers of the content view (trigrams, measures, bins of lines, of their length and of the longest) and of the metadata view.
FEATURES = (GRAMS + MEASURES + 3 * BINS, SOURCES + LANGS + BINS)
SLICE = 1 << 20


def content_view(column: pa.Array) -> np.ndarray:
    """Rows of log counts of hashed byte trigrams, of unit length, then measures of the words and bins of the lines."""
    data, offsets = text_bytes(column)
    n, size = len(column), np.diff(offsets)
    out = np.zeros((n, FEATURES[0]), np.float32)
    line_bins(data, offsets, out[:, GRAMS + MEASURES :])
    if not len(data):
        out[:, GRAMS + MEASURES - 1] = 1
        return out
    doc = np.repeat(np.arange(n), size)
    if len(data) > 2:
        x = data.astype(np.uint64)
        key = (x[:-2] << np.uint64(16)) | (x[1:-1] << np.uint64(8)) | x[2:]
        inside = doc[:-2] == doc[2:]
        h = (mix64(key) >> np.uint64(54)).astype(np.int64)[inside]
        counts = np.bincount(doc[:-2][inside] * GRAMS + h, minlength=n * GRAMS).reshape(n, GRAMS)
        grams = np.log1p(counts).astype(np.float32)
        out[:, :GRAMS] = grams / np.maximum(np.linalg.norm(grams, axis=1, keepdims=True), 1e-9)
    words = Words(column)
    count = np.diff(words.first)
    hashes = span_hashes(words.data, words.starts, words.ends)
    of = np.repeat(np.arange(n), count)
    repeat = np.bincount(of[1:][(hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])], minlength=n)
    order = np.lexsort((hashes, of))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])
    distinct = np.bincount(of[order][fresh], minlength=n)
    share = lambda mask: np.bincount(doc[mask], minlength=n) / np.maximum(size, 1)
    upper, digit = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57)
    mark = (data > 32) & (data < 127) & ~upper & ~digit & ~((data >= 97) & (data <= 122))
    some = np.maximum(count, 1)
    length = np.bincount(of, words.ends - words.starts, minlength=n) / some
    out[:, GRAMS : GRAMS + MEASURES] = np.stack([share(upper), share(digit), share(mark), repeat / some, distinct / some, length / 10, np.log1p(count) / 10, (count == 0).astype(float)], axis=1)
    return out


def _bin(x: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(x, 0) + 1).astype(np.int64), BINS - 1)


def line_bins(data: np.ndarray, offsets: np.ndarray, out: np.ndarray) -> None:
    """Set in `out` the bins of each text's number of lines, of their mean length and of the longest."""
    n, size, breaks = len(offsets) - 1, np.diff(offsets), np.flatnonzero(data == 10)
    lines = np.diff(np.searchsorted(breaks, offsets)) + 1
    edges = np.union1d(np.concatenate([breaks + 1, offsets[:-1]]), [len(data)])
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, np.searchsorted(offsets, edges[:-1], "right") - 1, np.diff(edges))
    for k, x in enumerate((lines, size / lines, longest)):
        out[np.arange(n), k * BINS + _bin(x)] = 1


def metadata_view(batch: pa.RecordBatch) -> np.ndarray:
    """Rows of indicators: hashed source and language, and the bin of the stated length."""
    n = batch.num_rows
    out = np.zeros((n, FEATURES[1]), np.float32)
    rows, at = np.arange(n), 0
    for name, buckets in (("source", SOURCES), ("lang", LANGS)):
        column = batch.column(name).cast(pa.string())
        data, offsets = text_bytes(column)
        h = (span_hashes(data, offsets[:-1], offsets[1:]) % np.uint64(buckets - 1)).astype(np.int64)
        out[rows, at + np.where(column.is_null().to_numpy(zero_copy_only=False), buckets - 1, h)] = 1
        at += buckets
    stated = batch.column("n_chars").cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)
    out[rows, at + _bin(stated)] = 1
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, decay: float, steps: int = 100) -> np.ndarray:
    """Weights, the last for the constant; classes weigh the same, accelerated gradient steps."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
    weight = np.where(y > 0.5, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    rate = 4 / ((x.astype(np.float64) ** 2).sum(axis=1) * weight).sum()
    w = v = np.zeros(x.shape[1])
    for k in range(1, steps + 1):
        ahead = v + (k - 1) / (k + 2) * (v - w)
        slope = (_sigmoid(x @ ahead.astype(np.float32)) - y) * weight  # products in single precision, as the rows are
        w, v = v, ahead - rate * (slope.astype(np.float32) @ x + decay * ahead)
    return v


def _raw(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def _platt(z: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """(slopes.., constant) of a calibrated probability from one or more scores, by Newton steps on smoothed targets."""
    x = np.column_stack([z, np.ones(len(y))])
    good, bad = y.sum(), (1 - y).sum()
    target = np.where(y > 0.5, (good + 1) / (good + 2), 1 / (bad + 2))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(h, x.T @ (p - target) + 1e-3 * w), -5, 5)
    return w


class Model:
    """Both views' weights, their calibrations and the combination."""

    def __init__(self, views: list[np.ndarray] | None, calibration: list[np.ndarray] | None, joint: np.ndarray | None):
        self.views, self.calibration, self.joint = views, calibration, joint

    def probabilities(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(content's, metadata's, combined) probability of good quality."""
        if self.views is None:
            half = np.full(len(content), 0.5)
            return half, half, half
        logits = [np.clip(_raw(x, w) * c[0] + c[1], -30, 30) for x, w, c in zip((content, metadata), self.views, self.calibration, strict=True)]
        return _sigmoid(logits[0]), _sigmoid(logits[1]), _sigmoid(_raw(np.column_stack(logits), self.joint))


DECAY = (1e-4, 1e-2)


class Training:
    """Labelled rows, what the views have labelled for each other so far, and the models fitted on both."""

    def __init__(self, labelled: list[np.ndarray], y: np.ndarray):
        """labelled: [content, metadata] rows; y: 1 for good, 0 for bad; of either class one at least."""
        self.labelled, self.y = labelled, y
        back = np.arange(len(y)) % 4 == 3  # a quarter held back for calibration
        for c in (0, 1):  # of each class, if it has any to spare
            own = np.flatnonzero(y == c)
            back[own] = np.arange(len(own)) % 4 == 3
        if not 0 < y[back].sum() < back.sum():
            back[:] = True
        self.back = back
        self.learn = ~back if not back.all() else back
        #: For each view the rows that the other labelled, and these labels.
        self.given: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        self.fit()

    def fit(self) -> None:
        self.views, self.calibration = [], []
        for v in (0, 1):
            x = np.concatenate([self.labelled[v][self.learn], *(rows for rows, _ in self.given[v])])
            y = np.concatenate([self.y[self.learn], *(labels for _, labels in self.given[v])])
            w = _logistic(x, y, DECAY[v])
            self.views.append(w)
            slope = _platt(_raw(self.labelled[v][self.back], w), self.y[self.back])
            # a view that ranks the held-back documents no better than chance has no opinion, rather than the opposite one
            self.calibration.append(slope if slope[0] > 0 else np.zeros(2))

    def teach(self, view: int, rows: np.ndarray, labels: np.ndarray) -> None:
        """Let a view learn from rows that the other has labelled."""
        self.given[view].append((rows, labels))

    def model(self) -> Model:
        logits = np.column_stack([_raw(self.labelled[v][self.back], self.views[v]) * self.calibration[v][0] + self.calibration[v][1] for v in (0, 1)])
        return Model(self.views, self.calibration, _platt(np.clip(logits, -30, 30), self.y[self.back]))


COLUMNS = ["text", "source", "lang", "n_chars"]


def _encoded(content: np.ndarray, metadata: np.ndarray) -> list[pa.Array]:
    return [pa.array([r.tobytes() for r in np.ascontiguousarray(v, np.float16)], pa.binary()) for v in (content, metadata)]


def _views(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(table.column(c).to_pylist()), np.float16).reshape(-1, k).astype(np.float32) for c, k in zip(("content", "metadata"), FEATURES, strict=True)]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            encoded = _encoded(content_view(part.column("text")), metadata_view(part))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), *encoded], ["doc_id", "quality", "content", "metadata"])


def _confident(model: Model, each: int):
    """Rows(kind, draw, content, metadata) of the documents of smallest draw of which a view is sure; kind: 2 x view + class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[dict[int, tuple[bytes, bytes]]] = [{}, {}, {}, {}]  # by draw, so that repeated rows count once
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                content, metadata = content_view(part.column("text")), metadata_view(part)
                draw = part.column("draw").to_numpy()
                for view, p in enumerate(model.probabilities(content, metadata)[:2]):
                    for label, sure in enumerate((1 - p, p)):
                        own = best[2 * view + label]
                        limit = max(own) if len(own) >= each else np.inf
                        take = np.flatnonzero((sure >= CONFIDENT) & (draw < limit))
                        take = take[np.argsort(draw[take], kind="stable")[:each]]
                        encoded = [e.to_pylist() for e in _encoded(content[take], metadata[take])]
                        own.update(zip(draw[take].tolist(), zip(*encoded, strict=True), strict=True))
                        for d in sorted(own)[each:]:
                            del own[d]
        rows = [(kind, d, *x) for kind, own in enumerate(best) for d, x in own.items()]
        kinds = [pa.int32(), pa.float64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)], ["kind", "draw", "content", "metadata"])

    return run


def _smallest(found: DataFrame, each: int) -> pa.Table:
    """Of found(kind, draw, ..) the rows of the `each` smallest draws of each kind: few more than these leave the executors."""
    # powers of 1.1 of the draw: the first up to which a kind has enough rows
    cell = F.greatest(F.ceil(F.log(F.col("draw") + 1e-12) / F.log(F.lit(1.1))), F.lit(-300)).cast("int")
    counts = found.groupBy("kind", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("kind").orderBy("cell"))
    cuts = counts.withColumn("upto", upto).groupBy("kind").agg(F.coalesce(F.min(F.when(F.col("upto") >= each, F.col("cell"))), F.max("cell")).alias("cut"))
    near = found.join(F.broadcast(cuts), "kind").filter(cell <= F.col("cut")).drop("cut")
    table = near.toArrow().sort_by([("kind", "ascending"), ("draw", "ascending")])
    kind, draw = table.column("kind").to_numpy(), table.column("draw").to_numpy()
    keep = []
    for k in range(4):
        own = np.flatnonzero(kind == k)
        _, first = np.unique(draw[own], return_index=True)  # equal draws are equal rows
        keep.append(own[first[:each]])
    return table.take(pa.array(np.concatenate(keep)))


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, quality, th) of the documents to learn from, LABELLED at most; th: the hash of the row's text."""
    given = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("quality"))
    given = given.withColumn("quality", (F.col("quality") >= 0.5).cast("double"))
    have = docs.select("doc_id", F.xxhash64("text").alias("th")).groupBy("doc_id").agg(F.min("th").alias("th"))
    return durable(have.join(given, "doc_id").orderBy(draw_of("doc_id"), "doc_id").limit(LABELLED))


def fit(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, each: int = EACH) -> Model:
    """A model from labels(doc_id, quality) and the documents."""
    chosen = F.broadcast(_labelled(docs, labels).withColumnRenamed("doc_id", "l_id"))  # LABELLED narrow rows at most
    wide = docs.select("doc_id", *COLUMNS)
    rows = wide.join(chosen, (F.col("doc_id") == F.col("l_id")) & (F.xxhash64("text") == F.col("th")))
    # rows that repeat are combined before they meet
    rows = rows.groupBy("doc_id").agg(F.first("quality").alias("quality"), F.first(F.struct(*COLUMNS)).alias("row")).select("doc_id", "quality", "row.*")
    table = rows.mapInArrow(_features, "doc_id long, quality double, content binary, metadata binary").toArrow().sort_by("doc_id")
    y = table.column("quality").to_numpy()
    if not 0 < y.sum() < len(y):
        return Model(None, None, None)
    training = Training(_views(table), y)
    # labels that none is fitted on are not looked at: their documents are as unlabelled as others
    unlabelled = wide.join(chosen.select("l_id"), F.col("doc_id") == F.col("l_id"), "left_anti").withColumn("draw", draw_of("doc_id", "text"))
    for k in range(rounds):
        part = unlabelled.filter((F.col("draw") >= k / rounds) & (F.col("draw") < (k + 1) / rounds)).withColumn("draw", F.col("draw") * rounds - k)
        path = scratch(docs.sparkSession, "confident")
        part.select(*COLUMNS, "draw").mapInArrow(_confident(training.model(), each), "kind int, draw double, content binary, metadata binary").write.parquet(path)
        found = _smallest(docs.sparkSession.read.parquet(path), each)
        remove(docs.sparkSession, path)
        if not len(found):
            continue
        views, kind = _views(found), found.column("kind").to_numpy()
        for v in (0, 1):
            own = kind // 2 == 1 - v
            training.teach(v, views[v][own], (kind[own] % 2).astype(float))
        training.fit()
    return training.model()


def draw_of(*names: str) -> Column:
    """A number in [0, 1) that depends on the columns' values alone."""
    return F.shiftrightunsigned(F.xxhash64(*names, F.lit(11)), 11) / F.lit(float(1 << 53))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, content_score, metadata_score, score (combined) and keep of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                p = sent.value.probabilities(content_view(part.column("text")), metadata_view(part))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, p), pa.array(p[2] >= KEEP)], ["doc_id", "content_score", "metadata_score", "score", "keep"])

    return docs.select("doc_id", *COLUMNS).mapInArrow(run, "doc_id long, content_score double, metadata_score double, score double, keep boolean")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """docs without those that the model rejects. One pass, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = [names.index(c) for c in COLUMNS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                seen = pa.RecordBatch.from_arrays([part.column(i) for i in at], COLUMNS)
                p = sent.value.probabilities(content_view(seen.column("text")), metadata_view(seen))
                yield part.filter(pa.array(p[2] >= KEEP))

    return docs.mapInArrow(run, docs.schema)
