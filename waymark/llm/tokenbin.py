"""Token ids as flat binary files with 64-bit document offsets.

A table is a folder of shards in ascending order of doc_id.  A shard has three
files of one name, which begins with its number:

* ``.ids``: the ids of its documents, one after the other, little-endian,
  two bytes each if all ids of the vocabulary fit, else four;
* ``.off``: n + 1 little-endian 64-bit offsets, in ids, of its n documents,
  counted from the shard's first id;
* ``.doc``: the n doc_ids, little-endian 64 bits each, 0 for a null one.

Documents are dealt to shards by ranges of doc_id; a shard's base, the number
of ids before it, comes from prefix sums over the shards.

The files of each attempt at a task have a name of their own, and the manifest
names those of the one attempt whose row Spark committed.  So a repeated or
speculative task changes nothing on any file system, and nothing is renamed;
what other attempts left is deleted once the manifest is written.
"""

from __future__ import annotations

import mmap
import os
import uuid
import zlib
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, kernel
from .shared import fresh_path, small_batches, written

#: Bytes of text in a shard, about.
SHARD_BYTES = 32 << 20


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path)
    return fs.FileSystem.from_uri(uri)


def _store(system: fs.FileSystem, path: str, blocks) -> None:
    with system.open_output_stream(path) as out:
        for b in blocks:
            out.write(b)


class Shard:
    """Reads one shard; memory-mapped where the folder is on a file system of this machine."""

    def __init__(self, folder: str, name: str, width: int):
        system, path = place(folder)

        def load(kind: str, dtype: str) -> np.ndarray:
            file = f"{path}/{name}.{kind}"
            if isinstance(system, fs.LocalFileSystem):
                with open(file, "rb") as f:
                    if os.fstat(f.fileno()).st_size == 0:
                        return np.zeros(0, dtype)
                    return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), dtype=dtype)
            with system.open_input_file(file) as f:
                return np.frombuffer(f.read(), dtype=dtype)

        self.ids, self.offsets, self.docs = load("ids", f"<u{width}"), load("off", "<i8"), load("doc", "<i8")

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.offsets[i] : self.offsets[i + 1]]


def write(docs: DataFrame, folder: str, tokenizer: str, end: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes docs(doc_id, text, ...) to the folder; returns the manifest (shard, name, docs, nulls, ids, base, width).

    tokenizer: path of a byte-level BPE file; end: id appended to each document.
    Null text is empty.  Null doc_ids sort first; nulls counts them in a shard,
    at its head.  Rows that repeat a doc_id are documents of their own, by their
    text.  An empty table has no shards.
    """
    base = small_batches(docs).select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(1 + total // shard_bytes)
    system, path = place(folder)
    system.create_dir(path, recursive=True)
    rows = base.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        kernel.task("encode")
        k = TaskContext.get().partitionId()
        encoder = bpe.encoder(tokenizer)
        width = 2 if max(encoder.library.get_vocab_size(), end + 1) <= 1 << 16 else 4
        system, path = place(folder)
        name = f"{k:08d}-{uuid.uuid4().hex}"
        last = np.array([end], dtype=f"<u{width}").tobytes()
        counts, names, nulls = [], [], 0
        with system.open_output_stream(f"{path}/{name}.ids") as out:
            for batch in batches:
                nulls += batch.column(0).null_count
                names.append(batch.column(0).fill_null(0).to_numpy().astype("<i8"))
                for text in batch.column(1):
                    ids = encoder.ids(text.as_py())
                    out.write(ids.astype(f"<u{width}").tobytes() + last)
                    counts.append(len(ids) + 1)
        if not counts:
            system.delete_file(f"{path}/{name}.ids")
            return
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype("<i8")
        _store(system, f"{path}/{name}.off", [offsets.tobytes()])
        _store(system, f"{path}/{name}.doc", [x.tobytes() for x in names])
        own = [k, name, len(counts), nulls, int(offsets[-1]), width]
        kinds = [pa.int64(), pa.string(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(own, kinds, strict=True)], names=["shard", "name", "docs", "nulls", "ids", "width"])
        kernel.trim()

    shards = written(rows.mapInArrow(run, "shard long, name string, docs long, nulls long, ids long, width long"), "shards")
    committed = {r.name for r in shards.select("name").toLocalIterator()}  # one name for each shard, as many as the writers' tasks
    for f in system.get_file_info(fs.FileSelector(path)):
        if f.base_name.rsplit(".", 1)[0] not in committed:
            system.delete_file(f.path)
    return bases(shards)


def bases(shards: DataFrame) -> DataFrame:
    """Adds each shard's base: the ids in all shards before it.

    There is one row per shard.  Shards are taken 4,096 at a time, so that no
    task sees more than that many, or than there are such blocks.
    """
    from pyspark.sql import Window

    block = shards.withColumn("block", F.floor(F.col("shard") / 4096))
    before = Window.partitionBy("block").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    whole = block.groupBy("block").agg(F.sum("ids").alias("all"))
    first = whole.withColumn("first", F.coalesce(F.sum("all").over(Window.partitionBy(F.lit(0)).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("block", "first")
    summed = block.withColumn("own", F.coalesce(F.sum("ids").over(before), F.lit(0))).join(F.broadcast(first), "block")
    return summed.select("shard", "name", "docs", "nulls", "ids", (F.col("first") + F.col("own")).alias("base"), "width")


def read(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard, position) of every document, from the files alone.

    start: ids of all documents before it; ids_crc32: of its ids as
    little-endian unsigned 32-bit integers; position: its place in the shard.
    """

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                s = Shard(folder, r["name"], r["width"])
                starts = s.offsets[:-1] + r["base"]
                null = np.arange(len(s.docs)) < r["nulls"]
                crc = [zlib.crc32(s.document(i).astype("<u4").tobytes()) for i in range(len(s.docs))]
                for a in range(0, len(crc), 10_000):
                    b = min(a + 10_000, len(crc))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(s.docs[a:b], mask=null[a:b]), pa.array(starts[a:b]), pa.array(np.diff(s.offsets)[a:b]), pa.array(crc[a:b], pa.int64()), pa.array([r["shard"]] * (b - a), pa.int64()), pa.array(np.arange(a, b))],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "shard", "position"],
                    )

    n = max(1, shards.count())
    spread = shards.repartitionByRange(min(n, 100_000), "shard")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, position long")


def exported(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """write() to a fresh folder beside the checkpoints, then read()."""
    folder = fresh_path(docs.sparkSession, "ids")
    return read(docs.sparkSession, folder, write(docs, folder, tokenizer, end))
