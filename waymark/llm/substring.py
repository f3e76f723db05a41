"""Removal of word sequences that a document with a smaller id has already.

Rabin-Karp hashes (96 bits) of every window of a fixed number of words are
counted over the whole corpus: documents are dealt into chunks; each chunk sends
the sorted hashes of its windows, as packed differences, to shards of the hash
space; a shard finds the smallest document of each hash and answers each chunk
with those of its hashes that a smaller document of another chunk has.
Repeated windows then merge into maximal removal intervals.

Spark deals, shuffles and groups; within a group NumPy sorts, as a Spark row for
each window would take three times the shuffle.  A window that occurs millions
of times is one entry from each chunk.  Chunks and shards are of a fixed size up
to some TB; beyond, both grow with the root of the total, so that what a chunk
sends to a shard stays worth a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import kernel
from .shared import small_batches

WINDOW = 13
CHUNK_BYTES = 1 << 20
#: Bytes of text whose windows meet in one shard.
SHARD_BYTES = 8 << 20
#: Bytes of text of a chunk whose windows go to one shard, at least.
BLOB_BYTES = 64

_PACK = zstandard.ZstdCompressor(level=1)
_OPEN = zstandard.ZstdDecompressor()


def packed(values: np.ndarray) -> bytes:
    """Unsigned integers by planes of their bytes, compressed; the low planes of hashes stay as they are."""
    v = np.ascontiguousarray(values)
    planes = v.view(np.uint8).reshape(len(v), v.itemsize)
    raw, rest = [], []
    for b in range(v.itemsize):
        (raw if v.itemsize == 8 and b < 5 else rest).append(np.ascontiguousarray(planes[:, b]))
    head = len(v).to_bytes(4, "little")
    return head + b"".join(x.tobytes() for x in raw) + _PACK.compress(b"".join(x.tobytes() for x in rest))


def unpacked(blob: bytes, kind: type) -> np.ndarray:
    n = int.from_bytes(blob[:4], "little")
    size = np.dtype(kind).itemsize
    raw = 5 if size == 8 else 0
    rest = _OPEN.decompress(blob[4 + raw * n :], max_output_size=(size - raw) * n + 1) if n else b""
    planes = np.empty((n, size), dtype=np.uint8)
    for b in range(size):
        at, of = (4 + b * n, blob) if b < raw else ((b - raw) * n, rest)
        planes[:, b] = np.frombuffer(of, dtype=np.uint8, count=n, offset=at)
    return planes.reshape(-1).view(kind)


def sizes(total: int) -> tuple[int, int]:
    """Bytes of a chunk and of a shard."""
    both = int((BLOB_BYTES * total) ** 0.5)
    return max(CHUNK_BYTES, both), max(SHARD_BYTES, both)


def without(text: bytes, starts: list[int], ends: list[int], cuts) -> bytes:
    """The text, whose words start and end there, without the words from i to j of each (i, j) of cuts; what separates the others stays."""
    kept, at = [], 0
    for i, j in cuts:
        if j < len(starts):
            kept.append(text[at : starts[i]])
            at = starts[j]
        else:
            kept.append(text[at : ends[i - 1]] if i else text[:0])
            at = len(text)
    return b"".join([*kept, text[at:]])


def runs(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    step = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _chunk(table: pa.Table):
    """Rows of a chunk by ascending id: ids, words, and its windows' hashes, documents and first words."""
    table = table.sort_by([("doc_id", "ascending"), ("row", "ascending")])
    ids = table["doc_id"].combine_chunks()
    data, offsets = kernel.buffers(table["text"])
    return table, ids, data, offsets


def _windows(data: np.ndarray, offsets: np.ndarray, width: int):
    """Per lot of rows: (first row, words, window hashes, window's row, window's first word)."""
    for i, j in kernel.spans(np.diff(offsets)):
        words = kernel.Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        h, first, off = words.windows(width)
        yield i, j, words, h, np.repeat(np.arange(i, j), np.diff(off)), first


def _by_hash(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in ascending order, each with its further bits and its first document; parts: (hashes, documents, further bits) by ascending document."""
    h, doc, more = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t) for k, t in enumerate((np.uint64, np.int32, np.uint32)))
    order = np.argsort(h, kind="stable")  # documents ascend, so the first of a hash is the smallest
    h = h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    order = order[new]
    return h[new], more[order], doc[order]


def deduplicated(docs: DataFrame, width: int = WINDOW, chunk_bytes: int | None = None, shard_bytes: int | None = None, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, spans) for each row of docs(doc_id, text, ...).

    Words are runs of bytes outside 0x20 and 0x09-0x0D.  A word goes if a
    window of ``width`` words over it has a word sequence that also starts in a
    row with a smaller doc_id; windows are those of the input.  kept_text: the
    other words, joined by one space.  spans: the maximal intervals (from, to)
    of removed words.  carry: further columns of docs, returned as c0, c1 and so
    on; kept_text is then the text without what is removed, with all that
    separates its words.

    Null or empty text: no words, kept_text is empty.  Null doc_id: the row is
    kept whole and takes nothing from others.  Rows that repeat a doc_id take
    nothing from each other.  Sequences are compared by 96-bit hashes, within a
    chunk by 64 of them: of n different windows a pair agrees by chance with
    probability n * n / 2**97.
    """
    carried = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry or [])]
    base = small_batches(docs).select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *carried)
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    own_chunk, own_shard = sizes(total)
    n_chunks, n_shards = 1 + total // (chunk_bytes or own_chunk), 1 + total // (shard_bytes or own_shard)
    row = F.xxhash64("text")
    dealt = base.withColumn("row", row).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "row"), F.lit(n_chunks)))
    per_shard = -(-(1 << 64) // n_shards)
    extra = base.select(*(f"c{k}" for k in range(len(carry or [])))).schema
    edges = lambda: np.array([min(s * per_shard, kernel.MASK) for s in range(n_shards)], dtype=np.uint64)

    def send(key, table):
        kernel.task("windows")
        _, ids, data, offsets = _chunk(table)
        known = len(ids) - ids.null_count  # nulls come last
        h, more, doc = _by_hash([(h, rows.astype(np.int32), words.more(first, width)) for _, _, words, h, rows, first in _windows(data, offsets[: known + 1], width)])
        ids = ids.slice(0, known).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.searchsorted(h, edges()).tolist() + [len(h)]
        out = []
        for s in range(n_shards):
            a, b = cuts[s], cuts[s + 1]
            if a < b:
                own = np.diff(h[a:b], prepend=np.uint64(s * per_shard))
                used, index = np.unique(doc[a:b], return_inverse=True)
                out.append((s, key[0].as_py(), packed(own), more[a:b].tobytes(), packed(index.astype(np.uint32)), packed(np.diff(ids[used], prepend=0).view(np.uint64))))
        names = [("shard", pa.int64()), ("chunk", pa.int64()), ("hashes", pa.binary()), ("more", pa.binary()), ("docs", pa.binary()), ("ids", pa.binary())]
        return kernel.in_lots(pa.table([pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(names)], names=[n for n, _ in names]))

    sent = dealt.groupBy("chunk").applyInArrow(send, "shard long, chunk long, hashes binary, more binary, docs binary, ids binary")

    def count(key, table):
        kernel.task("windows")
        start = np.uint64(key[0].as_py() * per_shard)
        n = [int.from_bytes(x.as_py()[:4], "little") for x in table["hashes"]]
        at = np.concatenate([[0], np.cumsum(n)])
        h, more, doc = np.empty(at[-1], np.uint64), np.empty(at[-1], np.uint32), np.empty(at[-1], np.int64)
        for k in range(table.num_rows):
            part = slice(at[k], at[k + 1])
            with np.errstate(over="ignore"):
                h[part] = np.cumsum(unpacked(table["hashes"][k].as_py(), np.uint64), dtype=np.uint64) + start
            more[part] = np.frombuffer(table["more"][k].as_py(), np.uint32)
            doc[part] = np.cumsum(unpacked(table["ids"][k].as_py(), np.uint64).view(np.int64))[unpacked(table["docs"][k].as_py(), np.uint32)]
        chunks = table["chunk"].to_pylist()
        del table
        order = np.argsort(h, kind="stable")
        h, more = h[order], more[order]
        if ((h[1:] == h[:-1]) & (more[1:] != more[:-1])).any():  # different windows of one 64-bit hash
            again = np.lexsort((more, h))
            order, h, more = order[again], h[again], more[again]
        new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (more[1:] != more[:-1])]))
        del h, more
        doc = doc[order]
        hit = np.sort(order[doc > np.repeat(np.minimum.reduceat(doc, new), np.diff(np.append(new, len(doc))))])
        del order, doc
        cut = np.searchsorted(hit, at)
        out = [(chunks[k], packed(np.diff((hit[cut[k] : cut[k + 1]] - at[k]).astype(np.uint32), prepend=np.uint32(0)))) for k in range(len(chunks)) if cut[k] < cut[k + 1]]
        return pa.table([pa.array([key[0].as_py()] * len(out), pa.int64()), pa.array([c for c, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], names=["shard", "chunk", "places"])

    answers = sent.groupBy("shard").applyInArrow(count, "shard long, chunk long, places binary")

    def remove(key, table, told):
        kernel.task("windows")
        table, ids, data, offsets = _chunk(table)
        known = len(ids) - ids.null_count
        nothing = np.zeros(0, np.uint32)  # hashes have the places that they had when they were sent
        hashes, _, doc = _by_hash([(h, rows.astype(np.int32), np.broadcast_to(np.uint32(0), len(h)) if len(h) else nothing) for _, _, _, h, rows, _ in _windows(data, offsets[: known + 1], width)])
        ids_np = ids.slice(0, known).to_numpy(zero_copy_only=False).astype(np.int64)
        # the smallest document of each hash in this chunk; the answers name hashes that a smaller one elsewhere has
        limit = ids_np[doc] if known else np.zeros(0, np.int64)
        cuts = np.searchsorted(hashes, edges())
        for s, blob in zip(told["shard"].to_pylist(), told["places"].to_pylist(), strict=True):
            limit[cuts[s] + np.cumsum(unpacked(blob, np.uint32)).astype(np.int64)] = np.iinfo(np.int64).min
        n_words, n_removed, texts, spans = [], [], [], []
        for i, j, words, h, rows, first in _windows(data, offsets, width):
            covered = np.zeros(len(words.starts) + 1, dtype=np.int32)
            mine = rows < known
            least = limit[np.searchsorted(hashes, h[mine])]
            at = first[mine][ids_np[rows[mine]] > least]
            np.add.at(covered, at, 1)
            np.add.at(covered, at + width, -1)
            gone = np.cumsum(covered)[:-1] > 0
            for r in range(i, j):
                a, b = words.rows[r - i], words.rows[r - i + 1]
                n_words.append(b - a)
                cut = gone[a:b]
                n = int(cut.sum())
                n_removed.append(n)
                text = data[offsets[r] : offsets[r + 1]].tobytes()
                gaps = [(int(x), int(y)) for x, y in zip(*runs(cut), strict=True)] if n else []
                spans.append([{"from": x, "to": y} for x, y in gaps])
                if carry is None:
                    own = text.split()
                    texts.append(b" ".join([w for w, g in zip(own, cut.tolist(), strict=True) if not g] if n else own))
                else:
                    lead = offsets[r] - offsets[i]
                    texts.append(without(text, (words.starts[a:b] - lead).tolist(), (words.ends[a:b] - lead).tolist(), gaps) if n else text)
        kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        kept = pa.table(
            [ids.cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(spans, kind)]
            + [table[c] for c in extra.names],
            names=["doc_id", "n_words", "n_removed", "kept_text", "spans", *extra.names],
        )
        return kernel.in_lots(kept)

    both = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    schema = "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<from:long,to:long>>"
    return both.applyInArrow(remove, StructType([*StructType.fromDDL(schema).fields, *extra.fields]))


def without_repeats(docs: DataFrame, **how) -> DataFrame:
    """docs without the words that deduplicated() removes; same columns.

    What separates the other words stays as it was; a row that loses nothing keeps
    its text, one that loses all goes.  n_chars, if there is such a column, is that
    of the new text.  A null text becomes empty.  Nulls, ties and repeated rows are
    those of deduplicated(); an empty table gives an empty result.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = deduplicated(docs, carry=others, **how).where("n_removed = 0 or n_removed < n_words")
    back = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("kept_text")} | {c: F.col(f"c{k}") for k, c in enumerate(others)}
    if "n_chars" in others:
        back["n_chars"] = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    return found.select(*(back[c].alias(c) for c in docs.columns))
