"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

A unit vector u is held as s * q with int8 q and the length e of the error
u - s * q, so the true cosine of two vectors lies within e1 + e2 + e1 * e2 of
s1 * s2 * (q1 . q2).  The products q1 . q2 are exact (their sums stay below
2**24, so that single-precision matrix products do not round).  The error itself
is held likewise as a second int8 vector, which narrows the bound for the pairs
that the first leaves open.

Within a label the vectors are dealt into tiles and every pair of tiles is one
group; only the int8 vectors go to it, a quarter of the doubles.  Pairs whose
interval lies wholly on one side of the threshold are settled by it; those that
are still possible, within about 1e-4 of the threshold, are joined to the full
vectors and computed in double precision.

Copies of one vector are a class with one representative, so a large group of
copies costs one row.  A pair of tiles returns sums of links, one edge per
vector at most for the components, and the open pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, hook
from .shared import small_batches, small_or_plain, written

TILE = 4096
ROWS = 512
#: Room for rounding in the products of scales and in the lengths of errors.
SLACK = 1e-5


def units(x: np.ndarray) -> np.ndarray:
    """The rows, which are not zero, as unit vectors in double precision."""
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(q as int8, scale, error length, errors) of the rows; rows of zeros have scale 0."""
    s = np.abs(u).max(axis=1) / 127
    q = np.rint(np.divide(u, s[:, None], out=np.zeros_like(u), where=s[:, None] > 0))
    rest = u - q * s[:, None]
    return q.astype(np.int8), s, np.sqrt((rest * rest).sum(axis=1)), rest


def products(q1: np.ndarray, q2: np.ndarray) -> np.ndarray:
    """q1 . q2 for all rows of int8 values, exactly: at most 1,024 components are summed in single precision."""
    total = q1[:, :1024].astype(np.float32) @ q2[:, :1024].astype(np.float32).T
    for k in range(1024, q1.shape[1], 1024):
        total = total.astype(np.float64) + q1[:, k : k + 1024].astype(np.float32) @ q2[:, k : k + 1024].astype(np.float32).T
    return total


class Codes:
    """Vectors as two int8 vectors each, with their scales and the lengths of what each leaves."""

    def __init__(self, q: np.ndarray, r: np.ndarray, s: np.ndarray, t: np.ndarray, e: np.ndarray, d: np.ndarray):
        self.q, self.r, self.s, self.t, self.e, self.d = q, r, s, t, e, d

    @classmethod
    def of(cls, u: np.ndarray) -> Codes:
        q, s, e, rest = quantised(u)
        r, t, d, _ = quantised(rest)
        return cls(q, r, s, t, e, d)

    def __getitem__(self, at) -> Codes:
        return Codes(self.q[at], self.r[at], self.s[at], self.t[at], self.e[at], self.d[at])

    def close(self) -> np.ndarray:
        """The vectors as the two parts give them, in double precision; each is off by d at most."""
        return self.q * self.s[:, None] + self.r * self.t[:, None]


def linked(one: Codes, two: Codes, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which vectors of one surely reach the threshold with which of two, and the pairs (a, b) that might."""
    near = products(one.q, two.q) * (one.s[:, None] * two.s[None, :]).astype(np.float32)
    bound = (one.e[:, None] + two.e[None, :] * (1 + one.e[:, None]) + SLACK).astype(np.float32)
    sure = near - bound >= threshold
    a, b = np.nonzero((near + bound >= threshold) & ~sure)
    still = np.zeros(len(a), dtype=bool)
    for k in range(0, len(a), 50_000):
        i, j = a[k : k + 50_000], b[k : k + 50_000]
        x, y = one[i], two[j]
        cosine = np.einsum("ij,ij->i", x.close(), y.close())
        # each approximation has length 1 + d at most
        off = x.d * (1 + y.d) + y.d * (1 + x.d) + x.d * y.d + 1e-12
        sure[i, j] = cosine - off >= threshold
        still[k : k + 50_000] = np.abs(cosine - threshold) <= off
        still[k : k + 50_000] &= ~sure[i, j]
    return sure, a[still], b[still]


def _matrix(column: pa.ChunkedArray, n: int, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(n, -1)


def _coded(classes: DataFrame) -> DataFrame:
    """classes(label, dim, node, k, copies, v) with codes: q and r as bytes, scales and errors."""

    def run(batches):
        for batch in batches:
            v, dims = batch.column(5), batch.column(1).to_numpy()
            flat, ends = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate([[0], np.cumsum(dims)])
            out = [None] * len(dims)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                c = Codes.of(units(flat[ends[rows][:, None] + np.arange(dim)]))
                for p, x in enumerate(rows.tolist()):
                    out[x] = (c.q[p].tobytes(), c.r[p].tobytes(), c.s[p], c.t[p], c.e[p], c.d[p])
            kinds = [pa.binary(), pa.binary(), *[pa.float64()] * 4]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *(pa.array([o[p] for o in out], t) for p, t in enumerate(kinds))], names=[*batch.schema.names[:5], "q", "r", "s", "t", "e", "d"])

    label = classes.schema["label"].dataType.simpleString()
    return classes.select("label", "dim", "node", "k", "copies", "v").mapInArrow(run, f"label {label}, dim int, node long, k long, copies long, q binary, r binary, s double, t double, e double, d double")


def _cosines(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """pairs(a, ka, b, kb, ...) with cosine, from the full vectors in double precision."""
    one = classes.select(F.col("node").alias("a"), F.col("k").alias("ka"), F.col("v").alias("va"))
    two = classes.select(F.col("node").alias("b"), F.col("k").alias("kb"), F.col("v").alias("vb"))
    joined = pairs.join(one, ["a", "ka"]).join(two, ["b", "kb"])
    kept = pairs.columns

    def run(batches):
        for batch in batches:
            found = []
            for x, y in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1), strict=True):
                u, w = (units(z.values.to_numpy(zero_copy_only=False).astype(np.float64)[None])[0] for z in (x, y))
                found.append(float(u @ w))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(found, pa.float64())], names=[*kept, "cosine"])

    return joined.select(*kept, "va", "vb").mapInArrow(run, pairs.select(*kept).schema.add("cosine", "double"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors(vec_id, embedding, label, ...).

    Vectors of one label (and one number of components) are linked if their
    cosine, in double precision, is at least the threshold.  n_links: other rows
    linked directly; component_id: the smallest vec_id reachable; kept: vec_id =
    component_id.

    A vector that is null, empty, zero or holds null or non-finite components,
    or whose label or vec_id is null, is linked with nothing and kept.  Rows
    that repeat a vec_id count as vectors of their own and are in one component
    if one of them is.  An empty table gives an empty result.
    """
    base = small_batches(vectors, 1000, 1 << 20).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), "label")
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists("v", lambda x: x != 0)
    base = base.withColumn("good", F.coalesce(finite, F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    classes = base.where("good").groupBy("label", "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    classes = written(classes.withColumn("dim", F.size("v")).withColumn("k", F.xxhash64("v", "label")), "classes")
    codes = written(_coded(classes), "codes")
    counts = codes.groupBy("label", "dim").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    dealt = codes.join(small_or_plain(counts, counts.count()), ["label", "dim"]).withColumn("at", F.pmod("k", "tiles").cast("int"))
    spread = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    spread = spread.select("label", "dim", F.least("at", "o").alias("i"), F.greatest("at", "o").alias("j"), "at", "k", "node", "copies", "q", "r", "s", "t", "e", "d")

    def run(key, table):
        i, j = key[2].as_py(), key[3].as_py()
        n = table.num_rows
        at = table["at"].to_numpy()
        node, k, copies = table["node"].to_numpy(), table["k"].to_numpy(), table["copies"].to_numpy().astype(np.int64)
        whole = Codes(_matrix(table["q"], n, np.int8), _matrix(table["r"], n, np.int8), *(table[c].to_numpy() for c in "sted"))
        one = np.flatnonzero(at == i)
        two = one if i == j else np.flatnonzero(at == j)
        second = whole[two]
        links, labels, open_ = np.zeros(n, np.int64), np.arange(n), []
        for a in range(0, len(one) if len(two) else 0, ROWS):
            r = one[a : a + ROWS]
            sure, p, q = linked(whole[r], second, threshold)
            if i == j:
                sure[np.arange(len(r)), np.arange(a, a + len(r))] = False
                p, q = p[a + p < q], q[a + p < q]  # each pair once, none with itself
            open_.append((r[p], two[q]))
            if sure.any():
                links[r] += sure @ copies[two]
                if i != j:
                    links[two] += copies[r] @ sure
                p, q = np.nonzero(sure)
                labels = hook(labels, r[p], two[q])
        got = np.flatnonzero(links)
        p, q = (np.concatenate([x[c] for x in open_]) if open_ else np.zeros(0, np.int64) for c in (0, 1))
        up = node[labels[got]]
        none = np.zeros(len(got), dtype=np.int64)
        rows = [
            (np.zeros(len(got), bool), np.ones(len(p), bool)), (node[got], node[p]), (k[got], k[p]), (links[got], copies[p]),
            (up, node[q]), (none, k[q]), (none, copies[q]),
        ]
        return pa.table([pa.array(np.concatenate(x)) for x in rows], names=["open", "node", "k", "links", "up", "k2", "links2"])

    schema = "open boolean, node long, k long, links long, up long, k2 long, links2 long"
    found = written(spread.groupBy("label", "dim", "i", "j").applyInArrow(run, schema), "tiles")
    pairs = found.where("open").select(F.col("node").alias("a"), F.col("k").alias("ka"), F.col("links").alias("na"), F.col("up").alias("b"), F.col("k2").alias("kb"), F.col("links2").alias("nb"))
    settled = found.where("not open").select("node", "k", "links", "up")
    if not pairs.isEmpty():
        full = written(_cosines(pairs, classes).where(F.col("cosine") >= threshold), "full", few=True)
        settled = settled.unionByName(full.select(F.col("a").alias("node"), F.col("ka").alias("k"), F.col("nb").alias("links"), F.col("b").alias("up")))
        settled = settled.unionByName(full.select(F.col("b").alias("node"), F.col("kb").alias("k"), F.col("na").alias("links"), F.col("a").alias("up")))
    direct = settled.groupBy("node", "k").agg(F.sum("links").alias("links"))
    joined = components(settled.select(F.col("node").alias("a"), F.col("up").alias("b")))
    one = classes.join(direct, ["node", "k"], "left").select("label", "v", "node", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    one = one.where("copies > 1 or links > 0")
    rows = base.join(one, (base.label == one.label) & (base.v == one.v) & base.good, "left").drop(one.label).drop(one.v)
    rows = rows.withColumn("node", F.coalesce("node", "vec_id")).join(joined, "node", "left")
    rows = rows.withColumn("component_id", F.coalesce("component", "node"))
    return rows.select("vec_id", F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
