"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts become lower-case letters with one space for every run of anything else; their n-grams of 1 to 3 characters are
hashed into BUCKETS. Counts of every labelled document are summed by language and bucket, smoothed and turned into one
matrix of log probabilities, of fixed size for each language, which is broadcast. A batch is scored with numpy: rows of
the matrix are gathered for the n-grams present and summed by document. Languages are broadcast and scored in blocks of
BLOCK, 16 MB each, in workers of their own; the best so far and the sum of all travel with the document.

Defined cases: a text that is null or has no letter is `und` with score 0; documents without language are scored and not
learned from; with nothing to learn from, everything is `und`; of languages equally likely the first by name is taken; a very
long text is scored whole, alone; repeated rows count as often as they occur; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import durable
from .textscan import mix64, slices, text_bytes

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
SMOOTHING = 0.1
#: Languages of a broadcast matrix, and numbers gathered from it at a time.
BLOCK, CELLS = 64, 1 << 22
UNDETERMINED = "und"
SLICE = 1 << 20


@cache
def _letters() -> np.ndarray:
    """By code point: the lower-case letter, or a space."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, document) of every n-gram that has a letter; document ascends within each order."""
    data, offsets = text_bytes(column)
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begins = (data & 0xC0) != 0x80  # a code point's first byte
    chars = np.concatenate([[0], np.cumsum(begins)])[offsets]
    if chars[-1] != len(codes):  # not well-formed somewhere: text by text
        texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        chars = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
    doc = np.repeat(np.arange(len(column)), np.diff(chars))
    code = _letters()[codes]
    space = code == 32
    keep = ~space
    keep[1:] |= ~space[:-1] & (doc[1:] == doc[:-1])
    code, doc = code[keep].astype(np.uint64), doc[keep]
    space = code == 32
    out, docs = [], []
    for n in ORDERS:
        m = len(code) - n + 1
        if m <= 0:
            continue
        key, blank = np.full(m, n, np.uint64), np.ones(m, bool)
        for k in range(n):
            key = key * np.uint64(0x1F123BB5) + code[k : k + m]
            blank &= space[k : k + m]
        ok = (doc[:m] == doc[n - 1 :]) & ~blank
        out.append((mix64(key[ok]) >> np.uint64(64 - 15)).astype(np.int64))
        docs.append(doc[:m][ok])
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(docs)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            bucket, doc = grams(part.column("text"))
            langs = part.column("lang").dictionary_encode()
            names, of = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
            counts = np.bincount(of[doc] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
            for name, row, n in zip(names, counts, np.bincount(of, minlength=len(names)).tolist(), strict=True):
                total[name] = total.get(name, 0) + row
                docs[name] = docs.get(name, 0) + n
            if len(total) > BLOCK:
                yield from _flushed(total, docs)
                total, docs = {}, {}
    yield from _flushed(total, docs)


def _flushed(total: dict[str, np.ndarray], docs: dict[str, int]) -> Iterator[pa.RecordBatch]:
    for name, row in total.items():
        at = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays([pa.array([name] * (len(at) + 1), pa.string()), pa.array(np.append(at, -1)), pa.array(np.append(row[at], docs[name]))], ["lang", "bucket", "n"])


class Block:
    """Some of the languages: their log probabilities by bucket, and of the language itself."""

    def __init__(self, languages: list[str], counts: np.ndarray, prior: np.ndarray):
        self.languages, self.prior = languages, prior
        p = counts.astype(np.float64) + SMOOTHING
        self.log_p = np.ascontiguousarray(np.log(p / p.sum(axis=1, keepdims=True)).T)

    def totals(self, bucket: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """[document, language]: logarithms of prior times likelihood."""
        total = np.zeros((n, len(self.languages)))
        cut = np.flatnonzero(np.diff(doc, prepend=-1) != 0)  # runs of one document, one run for each order
        if len(cut):
            step = max(1, CELLS // len(bucket))
            for at in range(0, len(self.languages), step):
                np.add.at(total[:, at : at + step], doc[cut], np.add.reduceat(self.log_p[bucket, at : at + step], cut, axis=0))
        return total + self.prior


def fit(labelled: DataFrame) -> list[Block]:
    """labelled(text, lang), all of it. To the driver go BLOCK x BUCKETS sums at a time."""
    rows = labelled.filter("lang is not null").select("text", "lang")
    sums = durable(rows.mapInArrow(_counted, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    # the number of documents of a language stands under a bucket below 0
    docs = {r.lang: r.n for r in sums.filter("bucket < 0").collect()}
    out, names = [], sorted(docs)
    for low in range(0, len(names), BLOCK):
        languages = names[low : low + BLOCK]
        found = sums.filter(F.col("lang").isin(languages) & (F.col("bucket") >= 0)).toArrow()
        at = {x: i for i, x in enumerate(languages)}
        table = np.zeros((len(languages), BUCKETS))
        lang = np.array([at[x] for x in found.column("lang").to_pylist()], np.int64)
        table[lang, found.column("bucket").to_numpy()] = found.column("n").to_numpy()
        out.append(Block(languages, table, np.log(np.array([docs[x] for x in languages]) / sum(docs.values()))))
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame, model: list[Block]) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    shape = "text string, doc_id long, held_out boolean, lang string, top double, every double"
    rows = docs.select("text", "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.lit(UNDETERMINED).alias("lang"), F.lit(float("-inf")).alias("top"), F.lit(float("-inf")).alias("every"))
    names = rows.columns
    for block in model:
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = sent.value
            for batch in batches:
                for part in slices(batch, "text", SLICE):
                    n, (bucket, doc) = part.num_rows, grams(part.column("text"))
                    have = np.bincount(doc, minlength=n) > 0
                    total = np.where(have[:, None], block.totals(bucket, doc, n), -np.inf)
                    best, top = total.argmax(axis=1), part.column("top").to_numpy()
                    highest = total.max(axis=1)
                    better = highest > top
                    lang = [block.languages[b] if x else old for b, x, old in zip(best.tolist(), better.tolist(), part.column("lang").to_pylist(), strict=True)]
                    every = np.logaddexp(part.column("every").to_numpy(), np.logaddexp.reduce(total, axis=1))
                    yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(lang, pa.string()), pa.array(np.maximum(top, highest)), pa.array(every)], names)

        rows = rows.mapInArrow(run, shape)
    score = F.when(F.col("lang") == UNDETERMINED, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.exp(F.col("top") - F.col("every"))))
    return rows.select("doc_id", "held_out", F.col("lang").alias("lang_pred"), score.alias("score"))
