"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts (A-Z lower-cased) of zero up to ORDER
bytes.  A byte is coded in the longest context that the language has; one that
never followed it is coded by an escape, with the escape probability
distinct / (total + distinct), and then in the next shorter context without the
bytes that the longer one would have coded, down to equal probabilities of all
256 bytes.  A language's code length of a text is exact under its frozen
statistics, and the language with the shortest code wins.

The trees are sparse: only the runs of bytes ("grams") that were seen have an
entry.  For a gram a language holds the code length of its last byte after the
others; for a context, the sum of the escapes out of it and all shorter ones.
The cost of a byte is the entry of the longest gram that ends in it, and, unless
that is as long as grams get, the escapes out of the longest context before it
less those already in that entry.  Grams are looked up in hash tables that all
languages share.

Statistics come from every whole document that may be learned from.  If languages
times grams exceed ``cells``, the rarest longer grams go until they don't, for
all languages alike; what they counted still counts for the shorter ones.  That
is settled before the driver gathers the counts, in columns: one row for each
language and gram of full length, or for the longest that is left of it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernel
from .shared import small_batches, written

#: Bytes of the longest context.
ORDER = 4
#: Most entries of all languages together; the tables of a model take 8 bytes for each.
CELLS = 8_000_000
#: Different grams that a task counts before it passes their counts on; rows that it passes on at once.
GRAMS, ROWS = 1 << 19, 8192
UNKNOWN = "und"
#: Number of byte values and the start of a text, which is 0; a byte counts from 1.
RADIX = 257


class Table:
    """Whole numbers that are not negative, and the entry of each: open addressing, all look-ups of a lot at once."""

    def __init__(self, keys: np.ndarray, first: int):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.entry = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = np.flatnonzero(self.keys[slot] == -1)
            _, won = np.unique(slot[free], return_index=True)  # one key for each free slot
            won = free[won]
            self.keys[slot[won]], self.entry[slot[won]] = keys[left[won]], left[won] + first
            stay = np.ones(len(left), dtype=bool)
            stay[won] = False
            left, slot = left[stay], (slot[stay] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key; 0 without one."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.entry[slot], 0)
        at = np.flatnonzero((there != keys) & (there != -1))
        slot, keys = slot[at], keys[at]
        while len(at):
            slot = (slot + 1) & self.mask
            there = self.keys[slot]
            hit = there == keys
            out[at[hit]] = self.entry[slot[hit]]
            on = ~hit & (there != -1)
            at, slot, keys = at[on], slot[on], keys[on]
        return out


@dataclass
class Model:
    """Languages, and of each length 1, 2, ... the grams by their codes, with their entries.

    bits: (languages, entries) of the last byte of a gram after the others, for
    grams shorter than the longest less the escapes out of the context of that
    length; escapes: out of the gram as a context and all shorter ones.  Entry 0
    is a byte never seen.
    """

    languages: list[str]
    tables: list[Table]
    bits: np.ndarray
    escapes: np.ndarray

    @property
    def order(self) -> int:
        return len(self.tables) - 1

    def entries(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The entry of the longest gram that ends a code; and for those codes whose longest is not a whole code, which they are and the entry of the longest context."""
        order = self.order
        gram = self.tables[order].find(code)
        rest = np.flatnonzero(gram == 0)
        short, ends = code[rest], np.zeros(len(rest), dtype=np.int32)
        past = np.zeros(len(rest), dtype=np.int32)
        for k in range(order - 1, -1, -1):
            for found, of in ((ends, short), (past, short // RADIX)):
                left = np.flatnonzero(found == 0)
                found[left] = self.tables[k].find(of[left] % RADIX ** (k + 1))
        gram[rest] = ends
        return gram, rest, past

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length in bits of each row under each language (rows, languages)."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        for i, j in kernel.spans(np.diff(offsets)):
            own, off = kernel._LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
            some = np.flatnonzero(np.diff(off))
            if not len(some):
                continue
            gram, rest, past = self.entries(codes(own.astype(np.int64) + 1, off, self.order))
            for k in range(len(self.languages)):
                each = self.bits[k][gram]
                each[rest] += self.escapes[k][past]
                out[i + some, k] = np.add.reduceat(each, off[some], dtype=np.float64)
        return out


def codes(symbols: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Each symbol and the ``order`` ones before it in its row as one number; 0 stands before a row's first."""
    at = np.arange(len(symbols)) - np.repeat(offsets[:-1], np.diff(offsets))
    out = symbols.astype(np.int64)
    for k in range(1, order + 1):
        past = np.zeros(len(symbols), dtype=np.int64)
        past[k:] = symbols[:-k]
        past[at < k] = 0
        out += past * RADIX**k
    return out


def learned(docs: DataFrame) -> DataFrame:
    """(lang, text, half) of every document with text and lang, each in one of two halves."""
    known = small_batches(docs).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    key = F.coalesce(F.col("doc_id").cast("string"), F.col("text"))
    return known.select(F.col("lang").cast("string").alias("lang"), "text", F.pmod(F.xxhash64(key, F.lit("half")), F.lit(2)).cast("int").alias("half"))


class Counts:
    """How often each number was seen; lots are merged once there are as many new ones as old."""

    def __init__(self):
        self.keys, self.n, self.lots, self.fresh = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray) -> None:
        self.lots.append(np.unique(keys, return_counts=True))
        self.fresh += len(self.lots[-1][0])
        if self.fresh > max(GRAMS // 4, len(self.keys)):
            self.merge()

    def merge(self) -> None:
        keys, n = (np.concatenate(x) for x in zip((self.keys, self.n), *self.lots, strict=True))
        self.lots, self.fresh = [], 0
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        self.keys, self.n = keys[first], np.add.reduceat(n[order], first) if len(first) else n


def counted(rows: DataFrame, by: list[str], order: int = ORDER) -> DataFrame:
    """(by..., code, n): how often a byte follows its context in rows(by..., text); by is lang, or lang and half."""

    def count(batches):
        kernel.task("language")
        groups, found = {}, Counts()
        size = RADIX ** (order + 1)

        def passed_on():
            found.merge()
            names = list(groups)
            for i in range(0, len(found.keys), ROWS):
                group, code = np.divmod(found.keys[i : i + ROWS], size)
                lang, half = pa.array([x for x, _ in names], pa.string()).take(pa.array(group)), np.array([h for _, h in names], np.int32)[group]
                yield pa.RecordBatch.from_arrays([lang, pa.array(half), pa.array(code), pa.array(found.n[i : i + ROWS])], names=["lang", "half", "code", "n"])
            found.__init__()

        for batch in batches:
            halves = batch.column(1).to_pylist() if len(by) > 1 else [0] * batch.num_rows
            own = np.array([groups.setdefault(x, len(groups)) for x in zip(batch.column(0).to_pylist(), halves, strict=True)], dtype=np.int64)
            data, offsets = kernel.buffers(batch.column(len(by)))
            for i, j in kernel.spans(np.diff(offsets)):
                low = kernel._LOWER[data[offsets[i] : offsets[j]]]
                off = offsets[i : j + 1] - offsets[i]
                found.add(codes(low.astype(np.int64) + 1, off, order) + np.repeat(own[i:j] * size, np.diff(off)))
                if len(found.keys) > GRAMS:
                    yield from passed_on()
        yield from passed_on()
        kernel.trim()

    return rows.select(*by, "text").mapInArrow(count, "lang string, half int, code long, n long").groupBy(*by, "code").agg(F.sum("n").alias("n"))


def narrowed(counts: DataFrame, cells: int, order: int = ORDER) -> DataFrame:
    """counts with level: the longest gram, less one, that is left of a code when languages times grams are at most ``cells``.

    Codes end up as that gram, their counts added up.
    """
    by = [c for c in counts.columns if c not in ("code", "n")]
    gram = lambda k: F.pmod(F.col("code"), F.lit(RADIX ** (k + 1)))
    each = counts.select("n", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), gram(k).alias("gram")) for k in range(order + 1)))).alias("g"))
    totals = each.groupBy("g.k", "g.gram").agg(F.sum("n").alias("total"))
    # as many rows as there are different totals, which is some root of the bytes
    often = totals.groupBy(F.when(F.col("k") > 1, F.col("total")).otherwise(-1).alias("total")).agg(F.count("*").alias("grams")).collect()
    languages = max(1, counts.select("lang").distinct().count())
    spare = cells // languages - (order + 1) - sum(r.grams for r in often if r.total < 0)  # every length has a start
    least = 0
    for r in sorted((r for r in often if r.total >= 0), key=lambda r: -r.total):
        spare -= r.grams
        if spare < 0:
            least = r.total + 1
            break
    if not least:
        return counts.withColumn("level", F.lit(order))
    of = lambda k: F.sum("n").over(Window.partitionBy(gram(k)))
    rows, level = counts, F.lit(min(1, order))
    for k in range(2, order + 1):
        rows, level = rows.withColumn(f"total_{k}", of(k)), F.when(F.col(f"total_{k}") >= least, k).otherwise(level)
    rows = rows.withColumn("level", level)
    left = F.element_at(F.array(*(gram(k) for k in range(order + 1))), F.col("level") + 1)
    return rows.select(*by, "level", left.alias("code"), "n").groupBy(*by, "level", "code").agg(F.sum("n").alias("n"))


def gathered(counts: DataFrame, cells: int = CELLS, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lang, half, code, n, level) of counts, in columns; equal languages are one text."""
    t = narrowed(written(counts, "grams"), cells, order)
    t = t.select("lang", (F.col("half") if "half" in t.columns else F.lit(0)).cast("byte").alias("half"), "code", "n", F.col("level").cast("byte").alias("level")).toArrow()
    names = t["lang"].combine_chunks().dictionary_encode()
    names = names.chunk(0) if isinstance(names, pa.ChunkedArray) else names
    lang = np.array(names.dictionary.to_pylist() or [""], dtype=object)[names.indices.to_numpy(zero_copy_only=False).astype(np.int64)]
    return lang, t["half"].to_numpy(), t["code"].to_numpy(), t["n"].to_numpy(), t["level"].to_numpy()


def trained(docs: DataFrame, order: int = ORDER, cells: int = CELLS) -> Model:
    """A model from the rows of docs(doc_id, text, lang, ...) with text and lang."""
    lang, _, code, n, level = gathered(counted(learned(docs), ["lang"], order), cells, order)
    found = model(lang, code, n, order, cells, level)
    del lang, code, n, level
    kernel.trim()
    return found


def limited(docs: DataFrame, least: float = 0.0, cells: int = CELLS) -> tuple[Model, dict[str, float]]:
    """The model of trained() and the most bits a byte that a text of each language costs, at least ``least``.

    Each document is coded by a model of the half that it is not in.  No
    document that this finds to be in its language costs more than the limit; a
    language none of whose documents are found so is learned from too little to
    have one: infinity.
    """
    some = learned(docs)
    lang, half, code, n, level = gathered(counted(some, ["lang", "half"]), cells)
    # the halves of a language as languages of their own, so that all share the tables
    names = sorted(set(lang.tolist()))
    by_half = np.array([[f"{h}{x}" for x in names] for h in (0, 1)], dtype=object)
    at = {x: k for k, x in enumerate(names)}
    which = by_half[half, np.fromiter((at[x] for x in lang), np.int64, len(lang))] if names else lang
    other = some.sparkSession.sparkContext.broadcast(model(which, code, n, cells=2 * cells, level=level))
    del which
    kernel.trim()

    def cost(batches):
        kernel.task("language")
        m = other.value
        by = [np.array([x[0] == str(1 - h) for x in m.languages], dtype=bool) for h in (0, 1)]
        for batch in batches:
            data, offsets = kernel.buffers(batch.column(1))
            langs, halves = np.array(batch.column(0).to_pylist(), dtype=object), batch.column(2).to_numpy()
            best, short = np.full(len(langs), None, dtype=object), np.zeros(len(langs))
            bits = m.lengths(data, offsets)
            for h in (0, 1):
                if by[h].any():
                    of = np.array([x[1:] for x, own in zip(m.languages, by[h], strict=True) if own], dtype=object)
                    best = np.where(halves == h, of[bits[:, by[h]].argmin(axis=1)], best)
                    short = np.where(halves == h, bits[:, by[h]].min(axis=1), short)
            size = np.diff(offsets)
            own = (best == langs) & (size > 0)
            yield pa.RecordBatch.from_arrays([pa.array(langs[own], pa.string()), pa.array(short[own] / size[own], pa.float64())], names=["lang", "bits"])

    found = some.mapInArrow(cost, "lang string, bits double").groupBy("lang").agg(F.max("bits").alias("bits")).collect()  # one row a language
    other.destroy()
    # after the other has gone, as the driver need not hold both
    whole = model(lang, code, n, cells=cells, level=level)
    del lang, half, code, n, level
    kernel.trim()
    return whole, dict.fromkeys(whole.languages, float("inf")) | {r.lang: max(least, r.bits) for r in found}


def model(lang: np.ndarray, code: np.ndarray, n: np.ndarray, order: int = ORDER, cells: int = CELLS, level: np.ndarray | None = None) -> Model:
    """The model of counts n of codes() of each language; rows of one language and code are added up.

    level: as narrowed() has it, of each row; a row counts for grams up to that length.
    """
    languages = sorted(set(lang.tolist()))
    if not languages:
        return Model([], [Table(np.zeros(1, np.int64), 1)], np.zeros((0, 2), np.float32), np.zeros((0, 2), np.float32))
    of = {x: k for k, x in enumerate(languages)}
    who = np.fromiter((of[x] for x in lang), np.int32, len(lang))
    code, n = code.astype(np.int64, copy=False), n.astype(np.float64)
    level = np.full(len(code), order, np.int8) if level is None else level
    # codes of the grams of each length, and the places of each without its first and without its last symbol
    levels = [np.unique(np.concatenate([[0], code[level >= k] % RADIX ** (k + 1)])) for k in range(order + 1)]
    if len(languages) * sum(map(len, levels)) > cells:
        total = [np.bincount(np.searchsorted(g, code[level >= k] % RADIX ** (k + 1)), weights=n[level >= k], minlength=len(g)) for k, g in enumerate(levels)]
        spare = max(0, cells // len(languages) - len(levels[0]) - (len(levels[1]) if order else 0))
        often = np.sort(np.concatenate(total[2:]))[::-1] if order > 1 else np.zeros(0)
        least = often[spare] + 1 if spare < len(often) else 0
        for k in range(2, order + 1):
            kept = total[k] >= least
            kept[0] = True  # a start
            levels[k] = levels[k][kept]
    first = (1 + np.concatenate([[0], np.cumsum([len(g) for g in levels[:-1]])])).astype(int).tolist()
    before, after = [None], [None]
    for k in range(1, order + 1):
        before.append(np.searchsorted(levels[k - 1], levels[k] // RADIX))
        after.append(np.searchsorted(levels[k - 1], levels[k] % RADIX**k))
    entries = first[-1] + len(levels[-1])
    bits, escapes = np.zeros((len(languages), entries), np.float32), np.zeros((len(languages), entries), np.float32)
    for k in range(len(languages)):
        own = who == k
        _unfold(code[own], n[own], level[own], levels, before, after, first, bits[k], escapes[k])
    return Model(languages, [Table(g, f) for g, f in zip(levels, first, strict=True)], bits, escapes)


def _unfold(code, n, level, levels, before, after, first, bits, escapes) -> None:
    """Fills one language's code lengths and escapes from its counts."""
    shorter, out = None, None  # code lengths of the grams one symbol shorter; escapes out of them as contexts
    for k, grams in enumerate(levels):
        at = np.searchsorted(grams, code % RADIX ** (k + 1))
        at[at == len(grams)] = 0
        known = (grams[at] == code % RADIX ** (k + 1)) & (level >= k)
        count = np.bincount(at[known], weights=n[known], minlength=len(grams))
        count[0] = 0  # nothing is ever followed by a start
        where = slice(first[k], first[k] + len(grams))
        if k == 0:
            total, distinct = count.sum(), int((count > 0).sum())
            if not total:
                own, fresh = np.full(len(grams), 8.0), 8.0
            else:
                escape = distinct if distinct < 256 else 0
                with np.errstate(divide="ignore"):
                    fresh = float(np.minimum(-np.log2(escape / (total + escape) / max(256 - distinct, 1)), 64))
                    own = np.where(count > 0, -np.log2(np.maximum(count, 1) / (total + escape)), fresh)
            bits[0] = fresh
            bits[where] = own
            shorter = own
            continue
        past, low = before[k], shorter[after[k]]
        size = len(levels[k - 1])
        total, distinct = np.bincount(past, weights=count, minlength=size), np.bincount(past, weights=count > 0, minlength=size)
        escape = np.where(distinct < 256, distinct, 0)
        rest = np.maximum(1 - np.bincount(past, weights=np.where(count > 0, np.exp2(-low), 0), minlength=size), 1e-12)
        here = np.zeros(size)
        some = (total > 0) & (escape > 0)
        here[some] = -np.log2(escape[some] / (total[some] + escape[some]) / rest[some])
        here = np.where((total > 0) & (escape == 0), 64.0, here)
        own = np.where(count > 0, -np.log2(np.maximum(count, 1) / (total + escape)[past].clip(1)), here[past] + low)
        out = here if k == 1 else here + out[after[k - 1]]
        escapes[first[k - 1] : first[k - 1] + size] = out
        # a gram of full length always stands after a context of full length, whose escapes it has
        bits[where] = own if k == len(levels) - 1 else own - out[past]
        shorter = own


def predicted(docs: DataFrame, trained_on: Model, text: str = "text") -> DataFrame:
    """docs(text, ...) with lang_pred, score and bits_per_byte beside its columns.

    lang_pred: the language with the shortest code, on a tie the first in order;
    score: its share of 2**-length over all languages.  Null text, a text
    without a letter, or a model without languages: "und" and score 0.
    Predictions use the text alone.  Columns of docs by the new names go.
    """
    names = ["lang_pred", "score", "bits_per_byte"]
    rows = small_batches(docs).drop(*names)
    kept = rows.columns
    at = kept.index(text)
    letter = F.coalesce(F.col(f"`{text}`").cast("string").rlike(r"\p{L}"), F.lit(False))
    given = rows.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(kept)), letter.alias("letter"))
    shared = docs.sparkSession.sparkContext.broadcast(trained_on)

    def run(batches):
        kernel.task("language")
        m = shared.value
        for batch in batches:
            data, offsets = kernel.buffers(batch.column(at).cast(pa.string()))
            size = np.diff(offsets)
            if not m.languages:
                best, score, short = np.full(len(size), -1), np.zeros(len(size)), np.zeros(len(size))
            else:
                bits = m.lengths(data, offsets)
                best = bits.argmin(axis=1)
                short = bits.min(axis=1)
                score = 1 / np.exp2(np.maximum(short[:, None] - bits, -1000)).sum(axis=1)
            known = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool) & (best >= 0)
            found = np.array([*m.languages, UNKNOWN], dtype=object)[np.where(known, best, len(m.languages))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(found, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(short / np.maximum(size, 1))],
                names=[*batch.schema.names[:-1], *names],
            )

    schema = given.drop("letter").schema
    for name, kind in zip(names, ("string", "double", "double"), strict=True):
        schema = schema.add(name, kind)
    return given.mapInArrow(run, schema).select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(kept)), *names)


def held_out(doc_id: str) -> Column:
    """Documents that are never learned from: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits_per_byte), learned from docs(doc_id, text, lang, ...) that are not held out.

    A null doc_id is not held out.
    """
    m = trained(docs.where(~held_out("doc_id")))
    return predicted(docs.select("doc_id", "text"), m).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "bits_per_byte")
