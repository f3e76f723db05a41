"""Corpus operators do the whole job."""

import random

import corpus_pipeline
import numpy as np
import pyarrow as pa

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from waymark.llm import bpe, kernel, langid, multihash, tokcount


def scripts():
    """Many documents of two languages with many bytes, few of a third whose bytes are rare."""
    rng = random.Random(4)
    word = lambda low, n: "".join(chr(low + rng.randrange(n)) for _ in range(rng.randint(2, 6)))
    text = lambda words, k: " ".join(rng.choice(words) for _ in range(k))
    a, b, c = ([word(low, n) for _ in range(30)] for low, n in ((0x61, 26), (0x100, 0x180), (0x10A0, 0x50)))
    rows = [(i, text(a, 200), "aa") for i in range(60)] + [(100 + i, text(b, 200), "bb") for i in range(60)]
    return rows + [(200 + i, text(c, 12), "cc") for i in range(12)]


def test_rare_scripts_have_symbols_and_are_kept(spark, frame):
    rows = scripts()
    m = langid.trained(frame(rows))
    seen = {b for _, t, _ in rows for b in t.encode()}
    low = np.array(sorted(b for b in seen if not 65 <= b <= 90), dtype=np.int64) + 1
    assert len(seen) > 94 and len(set(m.tables[0].find(low).tolist()) - {0}) == len(low)
    data, offsets = kernel.buffers(pa.array([t for _, t, x in rows if x == "cc"], pa.string()))
    assert (m.lengths(data, offsets).argmin(1) == m.languages.index("cc")).all()
    schema = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").schema
    docs = spark.createDataFrame([(i, t, x, "s", len(t)) for i, t, x in rows], schema)
    kept = corpus_pipeline.identify_language(spark, docs, "").collect()
    assert {(r.doc_id, r.lang) for r in kept} == {(i, x) for i, _, x in rows}


def test_limits_hold_what_a_half_has_not_seen(frame):
    """A language of many characters, each seen seldom, costs more than 7 bits a byte and still has its limit."""
    rng = random.Random(5)
    rows = [(i, "the cat and the dog " * 5, "en") for i in range(40)]
    rows += [(100 + i, "".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(5)), "zz") for i in range(8)]
    m, limits = langid.limited(frame(rows), least=7.0)
    assert limits["en"] == 7.0 and limits["zz"] > 7.0
    assert m.languages == ["en", "zz"] and np.isfinite(m.bits).all()


def test_likeness_of_a_line_repeated_often(frame):
    """Lanes beyond 32,767, of which an edit leaves two thirds."""
    line = "the same few words in every line of a very long log\n"
    got = {r.doc_id: r for r in multihash.fingerprints(frame([(2, line * 60_000), (1, line * 40_000)])).collect()}
    assert got[2].near_edited > 0.99 and got[2].near_next > 0.99 and got[1].near_edited > 0.99
    one = multihash.decoded(multihash.fingerprint(line.strip()))[1].view(np.int32)
    assert (multihash.decoded(got[2].fingerprint)[1].view(np.int32) == one * 60_000).all()


ANY = ["price 5 € and 12٣ <|endoftext|><|endoftext|> done", "Привет, мир! Как дела?", "日本語のテキスト、 二つ  目", "ok \U0001f600\U0001f44d\U0001f3fd go\u0301 on", "a\x1c\x1d b\x85 \u3000 c\u2028d", "<|endoftext|>", "  <|endoftext|>  x"]


def same_counts(text, library, vocabulary):
    encode = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    assert tokcount.counter(vocabulary).every_prefix(text).tolist() == [encode(text[:i]) for i in range(len(text) + 1)]


@pytest.mark.parametrize("text", ANY)
def test_prefix_counts_in_any_script(vocabulary, library, text):
    same_counts(text, library, vocabulary)


_any = st.lists(st.one_of(st.text(max_size=6), st.sampled_from(["<|endoftext|>", "<|endof", " ", "  ", "'re", "я", "漢字", "€", "\u0301", "ſ", "٣", "\x1c", "\x85", "\u3000"])), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(_any)
def test_prefix_counts_of_any_characters(text):
    same_counts(text, *_known)


def _vocabulary():
    from tokenizers import Tokenizer

    path = bpe.public_path("byte_bpe_50k.json")
    return Tokenizer.from_file(path), path


_known = _vocabulary()


def test_truncation_of_odd_texts_asks_for_no_token(monkeypatch, vocabulary):
    text = "Привет мир € " * 20
    of = tokcount.Counter(vocabulary)

    class Splits:
        pre_tokenizer = of.encoder.library.pre_tokenizer

    monkeypatch.setattr(of.encoder, "library", Splits())
    assert 30 < of.every_prefix(of.truncated(text, 40))[-1] <= 40
