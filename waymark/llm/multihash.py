"""Homomorphic multiset fingerprints of documents.

A document is the multiset of its paragraphs (its lines that are not empty).
Each paragraph is hashed to a wide vector and the vectors are summed, so the
order of paragraphs does not matter and a paragraph goes in or out by one
addition or subtraction:

* EQUAL lanes modulo 2**64, drawn from a 128-bit hash of the paragraph's bytes;
  they agree for equal multisets and else only by chance.
* ALIKE lanes modulo 2**32, to which each run of three words of the paragraph
  adds 1 or subtracts 1 in one lane; the cosine of two documents' lanes
  estimates how much of their wording they share.
"""

from __future__ import annotations

import base64
import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel
from .shared import small_batches, small_or_plain

EQUAL, ALIKE = 8, 256
WORDS = 3
#: Bytes of text in a part.
PART_BYTES = 16 << 20

_STEP = np.array([(0x9E3779B97F4A7C15 * (2 * j + 1)) & kernel.MASK for j in range(EQUAL)], dtype=np.uint64)


def vectors(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The EQUAL lanes (n, 8) and the ALIKE lanes (n, 256) of each text; null is empty."""
    data, offsets = kernel.buffers(texts)
    equal, alike = np.zeros((len(offsets) - 1, EQUAL), np.uint64), np.zeros((len(offsets) - 1, ALIKE), np.uint32)
    for i, j in kernel.spans(np.diff(offsets)):
        own, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        cuts = np.unique(np.concatenate([off, np.flatnonzero(own == 10) + 1, np.flatnonzero(own == 10)]))
        starts, ends = cuts[:-1], cuts[1:]
        line = (ends > starts) & (own[starts] != 10) if len(starts) else np.zeros(0, bool)
        row = np.searchsorted(off, starts, side="right") - 1
        raw = own.tobytes()
        found = b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(starts[line].tolist(), ends[line].tolist(), strict=True)])
        h = np.frombuffer(found, dtype=">u8").astype(np.uint64).reshape(-1, 2)
        lanes = kernel.mix(h[:, :1] + _STEP) ^ kernel.mix(h[:, 1:] ^ _STEP)
        at = np.searchsorted(row[line], np.arange(j - i + 1))
        for lane in range(EQUAL):
            equal[i:j, lane] = kernel.row_sums(np.ascontiguousarray(lanes[:, lane]), at)
        words = kernel.Words(own, cuts) if len(cuts) > 1 else None
        if words is not None and len(words.starts):
            g, first, _ = words.windows(WORDS, whole=True)
            doc = np.searchsorted(off, words.starts[first], side="right") - 1
            sign = 1.0 - 2.0 * ((g >> np.uint64(63)).astype(np.float64))
            cell = doc * ALIKE + (g & np.uint64(ALIKE - 1)).astype(np.int64)
            total = np.bincount(cell, weights=sign, minlength=(j - i) * ALIKE)
            alike[i:j] = total.astype(np.int64).astype(np.uint32).reshape(j - i, ALIKE)
    return equal, alike


def coded(equal: np.ndarray, alike: np.ndarray) -> list[str]:
    """The fingerprints as text."""
    both = np.concatenate([equal.astype("<u8").view(np.uint8), alike.astype("<u4").view(np.uint8)], axis=1)
    return [base64.b64encode(x.tobytes()).decode() for x in both]


def decoded(code: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(code)
    return np.frombuffer(raw, "<u8", EQUAL).copy(), np.frombuffer(raw, "<u4", ALIKE, EQUAL * 8).copy()


def fingerprint(text: str | None) -> str:
    return coded(*vectors(pa.array([text], pa.string())))[0]


def changed(code: str, paragraph: str, times: int = 1) -> str:
    """The fingerprint with a paragraph put in, or taken out if times is negative."""
    if "\n" in paragraph:
        raise ValueError("a paragraph has no line break")
    equal, alike = decoded(code)
    e, a = vectors(pa.array([paragraph], pa.string()))
    return coded((equal + e[0] * np.uint64(times % (1 << 64)))[None], (alike + a[0] * np.uint32(times % (1 << 32)))[None])[0]


def likeness(e1: np.ndarray, a1: np.ndarray, e2: np.ndarray, a2: np.ndarray) -> np.ndarray:
    """For each pair of rows 1 if the EQUAL lanes agree, else the cosine of the ALIKE lanes, from 0 to below 1."""
    x, y = a1.view(np.int32).astype(np.float64), a2.view(np.int32).astype(np.float64)
    norm = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    cos = np.divide((x * y).sum(1), norm, out=np.zeros(len(x)), where=norm > 0)
    return np.where((e1 == e2).all(1), 1.0, np.clip(cos, 0.0, 1.0 - 1e-9))


def edited(text: str, following: str) -> str:
    """The text with its last third (of code points) replaced by as many first ones of the following text, or all."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def parted(rows: DataFrame, n: int) -> tuple[DataFrame, int]:
    """rows(doc_id, h, ...) with (coarse, part): about n ranges of doc_id in ascending order; and the most there can be.

    Two levels of about the root of n ranges each, so the driver holds that many
    bounds.  A doc_id that fills a coarse range is a range of its own, and then
    divided by h.
    """
    from pyspark.ml.feature import Bucketizer

    if n <= 1:
        return rows.withColumns({"coarse": F.lit(0), "part": F.lit(0).cast("long")}), 1
    k = math.isqrt(n - 1) + 1
    rank = rows.withColumn("x", F.col("doc_id").cast("double"))
    cuts = rank.agg(F.percentile_approx("x", [j / k for j in range(1, k)] or [0.5], 50 * k)).first()[0] or []
    often = {x for x, y in zip(cuts, cuts[1:], strict=False) if x == y}
    inner = sorted({*cuts, *(float(np.nextafter(x, math.inf)) for x in often)})
    rank = Bucketizer(splits=[-math.inf, *inner, math.inf], inputCol="x", outputCol="c").transform(rank).withColumn("coarse", F.col("c").cast("int"))
    whole = [inner.index(x) + 1 for x in often]
    rank = rank.withColumn("y", F.when(F.col("coarse").isin(whole), F.col("h").cast("double")).otherwise(F.col("x")) if whole else F.col("x"))
    fine = rank.groupBy("coarse").agg(F.array_distinct(F.percentile_approx("y", [j / k for j in range(1, k)] or [0.5], 50 * k)).alias("bounds"))
    rank = rank.join(small_or_plain(fine, len(inner) + 1, 4096), "coarse")
    place = F.aggregate("bounds", F.lit(0), lambda a, b: a + F.when(b <= F.col("y"), 1).otherwise(0))
    return rank.withColumn("part", F.col("coarse").cast("long") * k + place).drop("x", "y", "c", "bounds"), (len(inner) + 1) * k


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of docs(doc_id, text, ...).

    A document's following one is that with the next smaller doc_id, the last
    one's is the first.  Null text: empty.  Null doc_id: after all others.
    Rows that repeat a doc_id follow each other by their text.  A single
    document follows itself; an empty table gives an empty result.

    Documents are dealt into ranges of doc_id and streamed in order; each range
    also gets the first document of the range that follows.
    """
    low = -(1 << 63)
    own = F.col("doc_id").cast("long")
    base = small_batches(docs).select(F.coalesce(own, F.lit(low)).alias("doc_id"), own.isNotNull().alias("named"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranked, n = parted(base.withColumn("h", F.xxhash64("text")), int(1 + total // PART_BYTES))
    key = F.struct("doc_id", "named", "h")
    heads = ranked.groupBy("coarse", "part").agg(F.max_by("text", key).alias("text"))
    # the first document of the range before: within a coarse range, else the last range's of the coarse one before, else the very last one's
    ends = heads.groupBy("coarse").agg(F.max_by("text", "part").alias("end"))
    all_ = Window.partitionBy(F.lit(0)).orderBy("coarse")  # the root of the number of ranges
    wrap = F.last("end").over(all_.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ends = ends.select("coarse", F.coalesce(F.lag("end").over(all_), wrap).alias("end"))
    inside = F.lag("text").over(Window.partitionBy("coarse").orderBy("part"))
    tails = heads.withColumn("before", inside).join(ends, "coarse").select("part", F.coalesce("before", "end").alias("text"))
    none = {"doc_id": F.lit(0).cast("long"), "named": F.lit(False), "h": F.lit(0).cast("long"), "tail": F.lit(1)}
    rows = ranked.drop("coarse").withColumn("tail", F.lit(0)).unionByName(tails.withColumns(none))
    rows = rows.withColumn("part", F.col("part").cast("int")).repartitionById(n, "part")
    rows = rows.sortWithinPartitions("part", "tail", F.desc("doc_id"), F.desc("named"), F.desc("h")).select("doc_id", "named", "text", "tail")

    def run(batches):
        kernel.task("paragraphs")
        ids, texts, tails = [], [], []
        for whole in batches:
            data, offsets = kernel.buffers(whole.column(2))
            for i, j in kernel.spans(np.diff(offsets)):
                batch = whole.slice(i, j - i)
                ids += [x if known else None for x, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
                texts += batch.column(2).to_pylist()
                tails += batch.column(3).to_pylist()
                e, a = vectors(pa.array(texts, pa.string()))
                own = [k for k in range(len(ids) - 1) if not tails[k]]
                new = [edited(texts[k], texts[k + 1]) for k in own]
                if own:
                    k = np.array(own)
                    e2, a2 = vectors(pa.array(new, pa.string()))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([ids[x] for x in own], pa.int64()),
                            pa.array([len(texts[x]) for x in own], pa.int64()),
                            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in new]),
                            pa.array(coded(e[k], a[k])),
                            pa.array(coded(e2, a2)),
                            pa.array(likeness(e[k], a[k], e2, a2)),
                            pa.array(likeness(e[k], a[k], e[k + 1], a[k + 1])),
                        ],
                        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                    )
                ids, texts, tails = ids[-1:], texts[-1:], tails[-1:]
        kernel.trim()

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
