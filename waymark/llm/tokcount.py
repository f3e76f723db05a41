"""Exact token counts at every prefix of a text, by dynamic programming.

Byte-level BPE splits a text into pieces and encodes each by itself.  Within a
piece, the encoding of a prefix ends in one token t, the only one for which the
encoding of what comes before ends in a token u such that u and t stay apart
when u + t is encoded.  So the count of a prefix is one more than the count of a
shorter one, and each prefix is worked out once, however many pieces begin with
it.  A piece is kept as the steps by which the count changes from one code point
to the next, so the steps of a text are those of its pieces, one after the
other, and their running sum is the count at every prefix.  Two kinds of prefix
end in other pieces than the text has there and are put right: those that end
in all of a run of white space, and those that cut a special string, which is
one piece of one token.

``prefix_counts`` stores the steps; ``truncated``, ``counts_at`` and ``within``
answer truncation and budget questions from what is stored and read neither
texts nor the vocabulary.  Texts with characters that bpe.PIECES is not sure of
are split by the library's own pre-tokenizer.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache
from itertools import islice
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, kernel
from .shared import small_batches

#: Prefixes remembered in each Python worker.
MEMORY = 1_000_000
#: Longest piece, in bytes, whose prefixes are remembered.
SHORT = 40


class PrefixCounter:
    """Counts of all byte prefixes of pieces."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)["model"]
        table = {c: b for b, c in enumerate(bpe.printable())}
        raw = lambda s: bytes(table[c] for c in s)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["merges"]]
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(merges)}
        #: token: (rank of the merge that forms it, its left and right part); single bytes have rank -1
        self.parts = {bytes([b]): (-1, b"", b"") for b in range(256)}
        for (a, b), k in self.rank.items():
            self.parts.setdefault(a + b, (k, a, b))
        self.longest = max(map(len, self.parts))
        #: longest token by its last two bytes
        self.reach: dict[bytes, int] = {}
        for t in self.parts:
            self.reach[t[-2:]] = max(len(t), self.reach.get(t[-2:], 1))
        self.apart: dict[tuple[bytes, bytes], bool] = {}
        #: prefix: (its last token, its number of tokens)
        self.known: dict[bytes, tuple[bytes, int]] = {}

    def stay_apart(self, u: bytes, t: bytes) -> bool:
        """Encoding u + t gives u and t.

        Follows both tokens back through the merges that form them, the latest
        first: u and t grow together if at some point what then met at the
        border had a merge that comes before the next one of either side (on
        equal ranks the one further left comes first).
        """
        parts, rank, limit = self.parts, self.rank, 1 << 60
        while True:
            if rank.get((u, t), limit) < limit:
                return False
            (ru, _, right), (rt, left, _) = parts[u], parts[t]
            if ru > rt:
                limit, u = ru, right
            elif rt < 0:
                return True
            else:
                limit, t = rt + 1, left

    def step(self, prefix: bytes, before) -> tuple[bytes, int]:
        """The last token of a prefix and its number of tokens; before(i) answers for its first i bytes."""
        n, parts, apart = len(prefix), self.parts, self.apart
        for size in range(min(n, self.reach.get(prefix[-2:], 1)), 0, -1):
            t = prefix[n - size :]
            if t in parts:
                u, c = before(n - size)
                if not u:
                    return t, c + 1
                ok = apart.get((u, t))
                if ok is None:
                    if len(apart) >= MEMORY:
                        for old in list(islice(apart, MEMORY // 2)):
                            del apart[old]
                    ok = apart[u, t] = self.stay_apart(u, t)
                if ok:
                    return t, c + 1
        raise AssertionError("every byte is a token")

    def inside(self, piece: bytes) -> list[int]:
        """Number of tokens of each prefix of a piece, from one byte to all of it; prefixes of a long one are not remembered."""
        row, known, n = [(b"", 0)], self.known, len(piece)
        if n > SHORT:
            for i in range(1, n + 1):
                a = max(0, i - self.longest)
                row.append(self.step(piece[a:i], lambda k, a=a: row[a + k]))
            return [c for _, c in row[1:]]
        if len(known) >= MEMORY:
            for old in list(islice(known, MEMORY // 2)):
                del known[old]
        get, step, before = known.get, self.step, row.__getitem__
        for i in range(1, n + 1):
            prefix = piece[:i]
            found = get(prefix)
            if found is None:
                found = known[prefix] = step(prefix, before)
            row.append(found)
        return [c for _, c in row[1:]]


class Counter:
    """Prefix counts of whole texts under one vocabulary file."""

    def __init__(self, path: str):
        self.encoder, self.prefixes = bpe.encoder(path), PrefixCounter(path)
        self.table = bpe.Remembered(self.piece, MEMORY)
        library = self.encoder.library
        if library.normalizer is not None or any(t.lstrip or t.rstrip or t.single_word for t in library.get_added_tokens_decoder().values()):
            raise ValueError("the vocabulary changes texts before it splits them")
        special = sorted(filter(None, self.encoder.special), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")

    def split(self, text: str) -> list[str]:
        """The pieces of a text without special strings."""
        if not self.encoder.odd(text):
            return bpe.PIECES.findall(text)
        return [text[a:b] for _, (a, b) in self.encoder.library.pre_tokenizer.pre_tokenize_str(text)]

    def upto(self, piece: str) -> list[int]:
        """Number of tokens of each prefix of a piece, from one code point to all of it."""
        raw = piece.encode()
        counts = self.prefixes.inside(raw)
        if len(raw) != len(piece):  # bytes that no other follows within a code point
            counts = [c for c, b in zip(counts, raw[1:] + b"a", strict=True) if b & 0xC0 != 0x80]
        if piece in CUT:
            counts[1] = 2
        return counts

    def piece(self, piece: str) -> bytes:
        """The steps of a piece as 16-bit integers; no step is longer than a token."""
        counts = self.upto(piece)
        return array("h", map(sub, counts, [0, *counts])).tobytes()

    def plain(self, text: str) -> np.ndarray:
        """steps() of a text without special strings."""
        table = self.table
        out = np.frombuffer(b"".join([table[p] for p in self.split(text)]), dtype=np.int16).astype(np.int64)
        if self.encoder.odd(text):
            runs = (m.span() for m in _ODD_RUN.finditer(text))
        else:
            runs = (m.span() for m in _RUN.finditer(text))
        for a, b in runs:
            if b < len(text):  # the piece that goes on with the run's last character is not there yet
                own = self.upto(text[a:b])[-1]
                more = own - int(out[a:b].sum())
                out[b - 1] += more
                out[b] -= more
        return out

    def steps(self, text: str) -> np.ndarray:
        """By how much the number of tokens of text[:i + 1] exceeds that of text[:i], for each i."""
        if not self.special.search(text):
            return self.plain(text)
        parts, at = [], 0
        for m in self.special.finditer(text):
            # a special string that is cut is a text like others; whole, it is one token
            own = self.plain(text[at : m.end() - 1])
            before = int(self.plain(text[at : m.start()]).sum())
            parts += [own, np.array([before + 1 - int(own.sum())], dtype=np.int64)]
            at = m.end()
        parts.append(self.plain(text[at:]))
        return np.concatenate(parts)

    def every_prefix(self, text: str) -> np.ndarray:
        """Number of tokens of text[:i] for each i from 0 to its length."""
        return np.concatenate([[0], np.cumsum(self.steps(text))])

    def truncated(self, text: str, budget: int) -> str:
        """The longest prefix of at most budget tokens."""
        return text[: cut_at(self.steps(text), budget)]


#: Contractions that, cut after their first letter, are a quote and a letter.
CUT = ("'re", "'ve", "'ll")
#: Runs of white space of which the last character may go with what follows; all of them where classes differ.
_RUN, _ODD_RUN = re.compile(r"\s{2,}"), re.compile(r"(?:(?![\x1c-\x1f])\s){2,}")


def cut_at(steps: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix of at most budget tokens, from its steps."""
    fits = np.flatnonzero(np.cumsum(steps, dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


kernel.FORGET.append(counter.cache_clear)


def prefix_counts(docs: DataFrame, tokenizer: str, limit: int = 512, keep: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, steps) for each row of docs(doc_id, text, ...).

    steps: for each code point, by how much the number of tokens of the text up
    to and with it exceeds that without it, so that the running sum is the exact
    count at every prefix; null unless keep.  n_tokens is their sum.

    Null text is empty: 0 tokens and no steps.  Null and repeated doc_ids return
    as they are.
    """
    rows = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def run(batches):
        kernel.task("count")
        of = counter(tokenizer)
        kind = pa.list_(pa.int32())
        for batch in batches:
            size, tokens, steps = [], [], []
            for x in batch.column(1):
                text = x.as_py() or ""
                own = of.steps(text)
                size.append(len(text) if text.isascii() else len(text.encode()))
                tokens.append(int(own.sum()))
                steps.append(own.astype(np.int32) if keep else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array([t > limit for t in tokens], pa.bool_()), pa.array(steps, kind)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "steps"],
            )
        kernel.trim()

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, steps array<int>")


def _answers(counts: DataFrame, names: list[str], answer) -> DataFrame:
    """counts(doc_id, steps, ...) to (doc_id, names...), from the stored steps alone."""

    def run(batches):
        for batch in batches:
            found = [answer(np.zeros(0, np.int32) if s is None else s) for s in (x.values.to_numpy(zero_copy_only=False) if x.is_valid else None for x in batch.column(1))]
            columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)] or [pa.array([], pa.int64())] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *names])

    return counts.select("doc_id", "steps").mapInArrow(run, ", ".join(f"{n} long" for n in ("doc_id", *names)))


def truncated(counts: DataFrame, budget: int) -> DataFrame:
    """(doc_id, n_chars, n_tokens): code points and tokens of the longest prefix of at most budget tokens, for each row of counts(doc_id, steps, ...).

    An empty text, or a budget below its first token: 0 and 0.
    """

    def answer(steps: np.ndarray) -> tuple[int, int]:
        n = cut_at(steps, budget)
        return n, int(steps[:n].sum(dtype=np.int64))

    return _answers(counts, ["n_chars", "n_tokens"], answer)


def counts_at(counts: DataFrame, n_chars: int) -> DataFrame:
    """(doc_id, n_tokens): tokens of the first n_chars code points, or of all there are."""
    return _answers(counts, ["n_tokens"], lambda steps: (int(steps[:n_chars].sum(dtype=np.int64)),))


def within(counts: DataFrame, budget: int) -> DataFrame:
    """(doc_id, n_tokens, fits): whether a text keeps to the budget as a whole."""
    total = F.aggregate(F.coalesce("steps", F.array().cast("array<int>")), F.lit(0).cast("long"), lambda a, x: a + x)
    return counts.select("doc_id", total.alias("n_tokens"), (total <= budget).alias("fits"))
