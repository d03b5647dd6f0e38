"""Token counts of documents in flat token streams, by a separator scan.

A flat file is nothing but token identifiers, each document's followed by the end-of-document identifier: no index says
where documents begin or how many there are. Files are read in blocks, byte ranges of any file, cut anywhere. Each block is searched
for the separator at once (numpy), which gives the lengths between separators, what stands before the first and after
the last. A prefix scan over the blocks' sums, a narrow row a block, stitches the document that a block's first separator
ends to its beginning in earlier blocks.

`write_flat` makes such files from documents, one for each task, and a table apart that says which document came how many-th in
which file; `flat_blocks` reads any flat files.

Defined cases: a null or empty text has no tokens, its document only the separator; a document may span many blocks, and a file
all that fits; tokens after the last separator are a document with ended = false; repeated rows and null ids are counted like any; an
empty table or file gives an empty result; files that a failed task left behind belong to no document; other columns are ignored.
Files lie where pyarrow can open them: a path of all machines, HDFS or an object store.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .durable import located, scratch
from .textscan import slices

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how the tokenizer's publishers cut text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_BYTES, BLOCKS_A_TASK = 1 << 20, 32

_loaded: dict[int, object] = {}


def encoding(ranks: bytes):
    """The tokenizer of a rank file's content, made once in each process."""
    import tiktoken

    if hash(ranks) not in _loaded:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _loaded[hash(ranks)] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _loaded[hash(ranks)]


def width(eod: int) -> type:
    """Identifiers up to the separator's take two bytes where they can."""
    return np.uint16 if eod < 1 << 16 else np.uint32


def write_flat(docs: DataFrame, path: str, tokenizer: str = TOKENIZER) -> tuple[DataFrame, int]:
    """Write docs(doc_id, text) to flat files in `path` -> ((file, ordinal, doc_id), the separator: the first identifier beyond the tokenizer's).

    file is the file's name. The documents are tokenized once, when the returned rows are made: read them from where they are kept.
    """
    with open(tokenizer, "rb") as f:
        ranks = f.read()
    eod = len(ranks.splitlines())
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    kind = width(eod)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoding(sent.value).encode_ordinary, TaskContext.get()
        # an attempt writes a file of its own, so what a lost one wrote is in no row
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
        system, at = located(path)
        end, ordinal, out = np.array([eod], kind).tobytes(), 0, None
        try:
            for batch in batches:
                for part in slices(batch, "text"):
                    if out is None:
                        system.create_dir(at, recursive=True)
                        out = system.open_output_stream(f"{at}/{name}")
                    for text in part.column("text").to_pylist():
                        out.write(np.array(encode(text) if text else [], kind).tobytes() + end)
                    rows = pa.array(np.arange(ordinal, ordinal + part.num_rows))
                    ordinal += part.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array([name] * part.num_rows, pa.string()), rows, part.column("doc_id")], ["file", "ordinal", "doc_id"])
        finally:
            if out is not None:
                out.close()

    ids = docs.select("doc_id", "text").mapInArrow(run, f"file string, ordinal long, doc_id {dict(docs.dtypes)['doc_id']}")
    return ids, eod


def flat_blocks(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file (its path), block, data of flat files: every block is read by itself, whatever the size of its file."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")  # no content is read for these
    blocks = files.agg(F.sum(F.ceil(F.col("length") / float(block_bytes)))).first()[0] or 0
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(block_bytes).cast("long")))
    # rows that name blocks are few bytes: a stated number keeps Spark from putting all of them into one task
    ranges = files.filter("length > 0").select("file", starts.alias("at")).repartition(max(1, -(-int(blocks) // BLOCKS_A_TASK)), "file", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, at in zip(batch.column("file").to_pylist(), batch.column("at").to_pylist(), strict=True):
                system, place = located(file)
                with system.open_input_file(place) as f:
                    data = f.read_at(min(block_bytes, f.size() - at), at)
                columns = [pa.array([file]), pa.array([at // block_bytes], pa.int64()), pa.array([data], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["file", "block", "data"])

    return ranges.mapInArrow(run, "file string, block long, data binary")


def _searched(eod: int):
    kind = width(eod)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, after, lengths, starts = [], [], [], []
            for data in batch.column("data"):
                tokens = np.frombuffer(data.as_buffer(), kind)
                ends = np.flatnonzero(tokens == eod)
                size.append(len(tokens))
                after.append(int(ends[-1]) + 1 if len(ends) else None)
                lengths.append(np.diff(ends, prepend=-1) - 1)
                starts.append(ends - lengths[-1])
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (lengths, starts)]
            columns = [batch.column("file"), batch.column("block"), pa.array(size, pa.int64()), pa.array(after, pa.int64()), *lists]
            yield pa.RecordBatch.from_arrays(columns, ["file", "block", "size", "after", "lengths", "starts"])

    return run


def scan(blocks: DataFrame, eod: int) -> DataFrame:
    """blocks(file, block, data) -> one row a document: file, ordinal, start (in tokens), n_tokens, ended."""
    spark, kinds = blocks.sparkSession, dict(blocks.dtypes)
    shape = f"file {kinds['file']}, block {kinds['block']}, size long, after long, lengths array<long>, starts array<long>"
    path = scratch(spark, "separators")
    blocks.select("file", "block", "data").mapInArrow(_searched(eod), shape).write.option("compression", "zstd").parquet(path)
    found = spark.read.parquet(path)
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    at = found.select("file", "block", "size", "after", F.size("lengths").alias("n"))
    at = at.withColumn("begin", F.coalesce(F.sum("size").over(before), F.lit(0)))
    at = at.withColumn("docs_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # where the document that is open at the block's beginning began: after the last separator so far
    at = at.withColumn("open", F.coalesce(F.max(F.col("begin") + F.col("after")).over(before), F.lit(0)))
    at = at.withColumn("is_last", F.lead("block").over(order).isNull())
    docs = found.select("file", "block", "lengths", "starts").join(at.select("file", "block", "begin", "docs_before", "open"), ["file", "block"])
    docs = docs.select("file", "begin", "docs_before", "open", F.posexplode(F.arrays_zip("lengths", "starts")).alias("k", "d"))
    first = F.col("k") == 0
    start = F.when(first, F.col("open")).otherwise(F.col("begin") + F.col("d.starts"))
    length = F.when(first, F.col("d.lengths") + F.col("begin") - F.col("open")).otherwise(F.col("d.lengths"))
    docs = docs.select("file", (F.col("docs_before") + F.col("k")).alias("ordinal"), start.alias("start"), length.alias("n_tokens"), F.lit(True).alias("ended"))
    close = F.coalesce(F.col("begin") + F.col("after"), F.col("open"))
    rest = F.when(F.col("is_last"), F.col("begin") + F.col("size") - close)
    tails = at.filter(rest > 0).select("file", (F.col("docs_before") + F.col("n")).alias("ordinal"), close.alias("start"), rest.alias("n_tokens"), F.lit(False).alias("ended"))
    return docs.union(tails)


def counts(scanned: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ids(file, ordinal, doc_id) with the n_tokens that the scan of their files found."""
    name = F.substring_index("file", "/", -1)
    return ids.join(scanned.select(name.alias("file"), "ordinal", "n_tokens"), ["file", "ordinal"]).select("doc_id", "n_tokens")
