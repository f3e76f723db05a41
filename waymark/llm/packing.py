"""Bounded-space online packing of documents into fixed-length sequences.

Each partition keeps a fixed number of open windows.  A document's ids fill
whole windows first; what remains goes where it fits best.  If it fits nowhere
and no window may be opened, the fullest is topped up with a cut of it and
emitted.  At its end a partition merges its open windows into full ones and one
leftover; the leftovers of all partitions, laid end to end by prefix sums, are
cut into sequences again.  Only the very last ids, fewer than one sequence,
are left over then: they become sequences of power-of-two lengths, which need
no padding either.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe, kernel
from .shared import small_batches, small_or_plain, written

SIZE = 2048
OPEN = 16
#: Full windows that leave a task at once.
WINDOWS = 64


class Packer:
    """The open windows of one partition; a window is [ids so far, its pieces].

    A piece is (document, start, ids, tokens of the document).
    """

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.open: list[list] = []
        self.done: list[list] = []

    def _put(self, window: list, piece: tuple) -> None:
        window[0] += len(piece[2])
        window[1].append(piece)
        if window[0] == self.size:
            self.open.remove(window)
            self.done.append(window[1])

    def add(self, doc, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= self.size:
            self.done.append([(doc, at, ids[at : at + self.size], n)])
            at += self.size
        while at < n:
            rest = n - at
            fits = [w for w in self.open if self.size - w[0] >= rest]
            if fits:
                self._put(max(fits, key=lambda w: w[0]), (doc, at, ids[at:], n))
                return
            if len(self.open) < self.most:
                window: list = [0, []]
                self.open.append(window)
                self._put(window, (doc, at, ids[at:], n))
                return
            fullest = max(self.open, key=lambda w: w[0])
            free = self.size - fullest[0]
            self._put(fullest, (doc, at, ids[at : at + free], n))
            at += free

    def close(self) -> list:
        """Merges the open windows, the fullest first; returns the pieces of the one leftover."""
        pieces = [p for w in sorted(self.open, key=lambda w: -w[0]) for p in w[1]]
        self.open = []
        used, left = 0, []
        for doc, start, ids, n in pieces:
            at = 0
            while at < len(ids):
                k = min(len(ids) - at, self.size - used)
                left.append((doc, start + at, ids[at : at + k], n))
                used, at = used + k, at + k
                if used == self.size:
                    self.done.append(left)
                    used, left = 0, []
        return left


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def tail_cuts(n: int) -> list[int]:
    """Ends of the pieces of n ids whose lengths are powers of two, the longest first."""
    ends, at = [], 0
    for b in range(n.bit_length() - 1, -1, -1):
        if n >> b & 1:
            at += 1 << b
            ends.append(at)
    return ends


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"
_ROW = "part int, kind int, sequence int, offset int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>"


def packed(docs: DataFrame, tokenizer: str, end: int, size: int = SIZE, most: int = OPEN, with_ids: bool = True, table: int = bpe.TABLE) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids) of every piece of docs(doc_id, text, ...).

    start: ids of the document before the piece; ids_crc32: of its ids as
    little-endian unsigned 32-bit integers; doc_tokens: ids of the document with
    ``end``, which ends each; offset: the piece's place in its sequence, gapless
    from 0.  Each id lies in one piece.  Sequences hold ``size`` ids but for the
    last ones, of power-of-two lengths.  Null text: only ``end``.  Rows with a
    null or repeated doc_id are documents of their own.  ids is null without with_ids.
    table: pieces of text whose ids each Python worker remembers.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    base = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("sequence", pa.int32()), ("offset", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        from pyspark import TaskContext

        kernel.task("encode")
        part = TaskContext.get().partitionId()
        encoder, packer = bpe.encoder(tokenizer, table), Packer(size, most)
        last = np.array([end], dtype=np.uint32)
        sent = 0

        def rows(windows, kind):
            nonlocal sent
            out = []
            for pieces in windows:
                at = 0
                for doc, start, ids, n in pieces:
                    out.append((part, kind, sent, at, doc, start, len(ids), crc(ids), n, ids.astype(np.int32) if with_ids or kind else None))
                    at += len(ids)
                sent += 1
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc, np.concatenate([encoder.ids(text.as_py()), last]))
                if len(packer.done) >= WINDOWS:
                    yield rows(packer.done, 0)
                    packer.done = []
        left = packer.close()
        if packer.done:
            yield rows(packer.done, 0)
        if left:
            yield rows([left], 1)
        kernel.trim()

    rows = written(base.mapInArrow(run, _ROW), "pieces")
    whole = rows.where("kind = 0").groupBy("part").agg((F.max("sequence") + 1).cast("long").alias("n"))
    n_parts = rows.select("part").distinct().count()
    main = rows.where("kind = 0").join(small_or_plain(_before(whole, "n"), n_parts), "part")
    main = main.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("sequence")).alias("sequence_id"), F.col("offset").cast("long").alias("offset"), "ids")

    left = rows.where("kind = 1")
    sums = left.groupBy("part").agg(F.sum("length").alias("n"))
    n_main = whole.agg(F.sum("n")).first()[0] or 0
    n_left = sums.agg(F.sum("n")).first()[0] or 0
    full = n_left // size
    ends = [full * size + x for x in tail_cuts(n_left - full * size)]
    placed = left.join(small_or_plain(_before(sums, "n"), n_parts), "part").select("doc_id", "start", "doc_tokens", "ids", (F.col("before") + F.col("offset")).alias("at"))

    def cut(batches):
        for batch in batches:
            out = []
            for doc, start, n, ids, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, i = np.array(ids, dtype=np.uint32), 0
                while i < len(ids):
                    g = at + i
                    if g < full * size:
                        k, first = g // size, g // size * size
                        to = first + size
                    else:
                        t = next(t for t, e in enumerate(ends) if g < e)
                        k, first, to = full + t, ends[t - 1] if t else full * size, ends[t]
                    own = ids[i : min(len(ids), to - at)]
                    out.append((doc, start + i, len(own), crc(own), n, n_main + k, g - first, own.astype(np.int32) if with_ids else None))
                    i += len(own)
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], names=names)

    return main.unionByName(placed.mapInArrow(cut, _PIECE))


def _before(sums: DataFrame, of: str) -> DataFrame:
    """(part, before): the sum over all smaller parts; one row per partition, 4,096 at a time."""
    block = sums.withColumn("block", F.floor(F.col("part") / 4096))
    own = Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy(F.lit(0)).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = block.groupBy("block").agg(F.sum(of).alias("all")).withColumn("first", F.coalesce(F.sum("all").over(above), F.lit(0))).select("block", "first")
    found = block.withColumn("own", F.coalesce(F.sum(of).over(own), F.lit(0))).join(F.broadcast(first), "block")
    return found.select("part", (F.col("first") + F.col("own")).alias("before"))
