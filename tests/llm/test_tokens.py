"""Token ids, counts and packing against the library itself."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from waymark.llm import bpe, packing, tokcount, tokenbin

ODD = ["", "a  b\n\n c", "it's 'tis we're you'll don't 'r 're x²½ 12٣ <|endoftext|> hi", "日本語 test\x85 y\x1c z  ", "\t\ttab\n \n  q", "emoji \U0001f600\U0001f600 ok", " lead", "trail  ", "_x_ __", "éèüñ naïve—“quotes”…", "a" * 90 + " 1234567890123", "\x00\x01 nul"]


@pytest.mark.parametrize("text", ODD)
def test_ids_and_prefix_counts_of_odd_texts(vocabulary, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert bpe.encoder(vocabulary).ids(text).tolist() == ids
    want = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
    assert tokcount.counter(vocabulary).every_prefix(text).tolist() == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcdeilrstv'  \n\t.,!?-_1290é²一<|>", max_size=60))
def test_prefix_counts_of_any_text(text):
    from tokenizers import Tokenizer

    path = bpe.public_path("byte_bpe_50k.json")
    library = _library.setdefault(path, None) or _library.setdefault("x", Tokenizer.from_file(path))
    assert bpe.encoder(path).ids(text).tolist() == library.encode(text, add_special_tokens=False).ids
    want = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
    assert tokcount.counter(path).every_prefix(text).tolist() == want


_library = {}


def test_truncation_needs_no_encoding(vocabulary, library):
    text = "The invented words of this sentence are unremarkable, aren't they?"
    of = tokcount.counter(vocabulary)
    for budget in range(0, 20):
        cut = of.truncated(text, budget)
        assert len(library.encode(cut, add_special_tokens=False).ids) <= budget
        assert cut == text or len(library.encode(text[: len(cut) + 1], add_special_tokens=False).ids) > budget


def test_tables_that_overflow(vocabulary, library):
    own = bpe.Encoder(vocabulary)
    own.table.most = 10
    counts = tokcount.Counter(vocabulary)
    counts.table.most = 10
    text = " ".join(f"w{i} x{i % 7}" for i in range(200))
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.ids(text).tolist() == ids and len(own.table) <= 10
    assert counts.steps(text).sum() == len(ids) and len(counts.table) <= 10


def documents():
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["in", "of", "Thation", "eré", "x", "\n"], k=rng.choice([0, 1, 5, 60, 900])))) for i in range(80)]
    return rows + [(100, None), (None, "no id"), (-(1 << 63), "least id"), (7, "again"), (7, "again"), (101, "long " * 9000), (102, ODD[2])]


def test_counts(frame, library, vocabulary):
    rows = documents()
    got = tokcount.prefix_counts(frame(rows, extra=True), vocabulary, limit=512).collect()
    want = sorted(((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=repr) == want
    assert all(r.over_limit == (r.n_tokens > 512) and sum(r.steps) == r.n_tokens for r in got)
    assert tokcount.prefix_counts(frame([]), vocabulary).count() == 0
    assert {r.steps for r in tokcount.prefix_counts(frame(rows), vocabulary, keep=False).collect()} == {None}


def test_questions_read_what_is_stored(frame, library, vocabulary, monkeypatch):
    """Truncation and budgets from stored counts: nothing is split or encoded again."""
    from waymark.llm.shared import written

    texts = {1: "Привет мир € " * 9, 2: "日本語の  テキスト\n\n x", 3: "it's 'tis we're 😀👍 <|endoftext|> ok", 4: "", 5: "plain words only", 6: None}
    counts = written(tokcount.prefix_counts(frame(list(texts.items())), vocabulary), "counts")
    encode = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    monkeypatch.setattr(tokcount, "counter", None)
    for budget in (0, 1, 7, 1000):
        for r in tokcount.truncated(counts, budget).collect():
            text = texts[r.doc_id] or ""
            assert r.n_tokens == encode(text[: r.n_chars]) <= budget
            assert all(encode(text[:k]) > budget for k in range(r.n_chars + 1, len(text) + 1))
        assert {r.doc_id: (r.n_tokens, r.fits) for r in tokcount.within(counts, budget).collect()} == {i: (encode(t or ""), encode(t or "") <= budget) for i, t in texts.items()}
    assert {r.doc_id: r.n_tokens for r in tokcount.counts_at(counts, 5).collect()} == {i: encode((t or "")[:5]) for i, t in texts.items()}
    assert tokcount.truncated(counts.where("false"), 3).count() == 0


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("size", [3000, 1 << 20])
def test_files_return_every_document(frame, library, vocabulary, tmp_path, size):
    rows = documents()
    df = frame(rows, extra=True)
    folder = f"file://{tmp_path}/ids"
    shards = tokenbin.write(df, folder, vocabulary, end=2, shard_bytes=size)
    got = sorted(tokenbin.read(df.sparkSession, folder, shards).collect(), key=lambda r: r.start)
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append([*library.encode(t or "", add_special_tokens=False).ids, 2])
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    start = 0
    for r in got:
        own = next(x for x in ids[r.doc_id] if crc(x) == r.ids_crc32)
        assert (r.start, r.n_tokens) == (start, len(own))
        start += len(own)
    named = {f"{r['name']}.{kind}" for r in shards.collect() for kind in ("ids", "off", "doc")}
    assert {p.name for p in (tmp_path / "ids").iterdir() if not p.name.startswith(".")} == named
    whole = b"".join(p.read_bytes() for p in sorted((tmp_path / "ids").glob("*.ids")))
    assert len(whole) == 2 * start and not list((tmp_path / "ids").glob("*.ids.*"))
    s = shards.first()
    shard = tokenbin.Shard(folder, s["name"], s.width)
    assert shard.document(0).tolist() in [list(x) for v in ids.values() for x in v]


def test_files_of_nothing(frame, vocabulary, tmp_path):
    df = frame([])
    folder = f"file://{tmp_path}/none"
    assert tokenbin.read(df.sparkSession, folder, tokenbin.write(df, folder, vocabulary, end=2)).count() == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_packing_keeps_every_id_once(frame, library, vocabulary, parts):
    rows = [r for r in documents() if r[0] is not None and r[0] != 7] + [(7, "again")]
    got = packing.packed(frame(rows, extra=True).repartition(parts), vocabulary, end=1, size=64, most=4).collect()
    by, sequences = {}, {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
        assert crc(r.ids) == r.ids_crc32 and len(r.ids) == r.length
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        pieces = sorted(by[i], key=lambda r: r.start)
        assert [x for p in pieces for x in p.ids] == ids and all(p.doc_tokens == len(ids) for p in pieces)
        assert [p.start for p in pieces] == np.cumsum([0, *(p.length for p in pieces[:-1])]).tolist()
    assert sorted(sequences) == list(range(len(sequences)))
    lengths = []
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == np.cumsum([0, *(r.length for r in s[:-1])]).tolist()
        lengths.append(sum(r.length for r in s))
    short = [x for x in lengths if x != 64]
    assert all(x & (x - 1) == 0 for x in short) and len(short) == len(set(short)) and sum(short) < 64


def test_packing_of_nothing_and_of_odd_rows(frame, vocabulary):
    assert packing.packed(frame([]), vocabulary, end=1).count() == 0
    got = packing.packed(frame([(None, None), (3, None), (3, "")]), vocabulary, end=1, with_ids=False).collect()
    assert sorted((str(r.doc_id), r.length, r.ids_crc32) for r in got) == [("3", 1, crc([1])), ("3", 1, crc([1])), ("None", 1, crc([1]))]
    with pytest.raises(ValueError):
        packing.packed(frame([]), vocabulary, end=1, size=100)


def test_packer_fits_best_and_emits_the_fullest():
    p = packing.Packer(10, 2)
    p.add("a", np.arange(6))
    p.add("b", np.arange(5))
    p.add("c", np.arange(4))  # fits a exactly, b with one to spare
    assert [[x[0] for x in w] for w in p.done] == [["a", "c"]]
    p.add("d", np.arange(8))
    p.add("e", np.arange(6))  # fits nowhere: tops up d, the fullest
    assert [(x[0], len(x[2])) for x in p.done[-1]] == [("d", 8), ("e", 2)]
    assert [(x[0], x[1], len(x[2])) for x in p.close()] == [("b", 0, 5), ("e", 2, 4)] or len(p.done) == 2
