"""Revisits, mixing, language ID, fingerprints, vectors and the pipeline."""

import base64
import hashlib
import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waymark.llm import embed, kernel, langid, mixing, multihash, warc

# Revisits

RECORDS = "record_id long, url string, time long, kind string, status int, headers map<string,string>"


def records(spark, rows):
    return spark.createDataFrame(rows, RECORDS)


def test_revisits(spark):
    ok = {"ETag": '"1"', "Content-Type": "text/html", "Cache-Control": "a", "X": "1"}
    rows = [
        (1, "http://www.Ex.com/a/", 10, "response", 200, ok),
        (2, "https://ex.com:443/a?utm_source=q#top", 20, "revisit", 304, {"etag": 'W/"1"', "content-type": "no", "cache-control": "b", "connection": "x, y", "x": "2", "y": "3", "z": "4"}),
        (3, "http://ex.com/a", 5, "revisit", 304, ok),
        (4, "http://ex.com/a", 30, "response", 404, {"ETag": '"9"'}),
        (5, "http://ex.com/a", 40, "response", 200, {"ETag": '"2"', "Last-Modified": "d"}),
        (6, "http://ex.com/a", 50, "revisit", 304, ok),
        (7, "http://ex.com/a", 50, "revisit", 304, {"last-modified": "d"}),
        (8, "http://ex.com/a", 50, "revisit", 304, None),
        (9, None, 50, "revisit", 304, ok),
        (10, "http://ex.com/a", None, "revisit", 304, ok),
        (11, "http://ex.com/b?z=1&a=2", 50, "response", 200, {"Last-Modified": "d"}),
        (12, "http://ex.com/b?a=2&&z=1&gclid=7", 60, "revisit", 304, {"LAST-MODIFIED": "d", "Date": "n"}),
        (12, "http://ex.com/b?a=2&&z=1&gclid=7", 60, "revisit", 304, {"LAST-MODIFIED": "e"}),
        (13, "http://ex.com/c", 60, None, None, None),
    ]
    got = {}
    for r in warc.resolve(records(spark, rows).withColumn("near", F.lit(1)).withColumn("range", F.lit(2))).collect():
        got.setdefault(r.record_id, []).append(r)
    state = {k: sorted((r.outcome, r.response_id) for r in v) for k, v in got.items()}
    assert state == {2: [("resolved", 1)], 3: [("no_response", None)], 6: [("mismatch", None)], 7: [("resolved", 5)], 8: [("mismatch", None)], 9: [("no_response", None)], 10: [("no_response", None)], 12: [("mismatch", None), ("resolved", 11)]}
    assert got[2][0].headers == {"etag": 'W/"1"', "content-type": "text/html", "cache-control": "b", "x": "1", "z": "4"}
    assert got[2][0].url_key == "ex.com/a" and got[12][0].url_key == "ex.com/b?a=2&z=1"


def test_revisits_of_one_url_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "ROWS_PER_RANGE", 20)
    rng = random.Random(1)
    rows = []
    for i in range(400):
        url = "http://hot.example/" if rng.random() < 0.8 else f"http://h{rng.randrange(5)}/"
        full = rng.random() < 0.1
        rows.append((i, url, rng.randrange(100), "response" if full else "revisit", 200 if full else 304, {"etag": str(rng.randrange(2))}))
    got = {r.record_id: (r.outcome, r.response_id) for r in warc.resolve(records(spark, rows)).collect()}
    for i, url, time, kind, _, h in rows:
        if kind == "revisit":
            before = [r for r in rows if r[1] == url and r[3] == "response" and (r[2], r[0]) < (time, i)]
            last = max(before, key=lambda r: (r[2], r[0])) if before else None
            assert got[i] == (("no_response", None) if not last else ("resolved", last[0]) if last[5] == h else ("mismatch", None))
    assert warc.resolve(records(spark, [])).count() == 0


# Mixing


def sources(rng, sizes):
    rows, i = [], 0
    for k, n in enumerate(sizes):
        for _ in range(n):
            rows.append((i, " ".join(["w"] * rng.randint(1, 30)), None, f"s{k}"))
            i += 1
    return rows


def test_repeats_are_limited_and_nothing_is_lost(frame):
    rows = sources(random.Random(2), [400, 40, 10])
    got = mixing.mixture(frame(rows, extra=True), max_repeats=3, block_tokens=300).collect()
    tokens, used, seen = {}, {}, {}
    for i, t, _, s in rows:
        tokens[s] = tokens.get(s, 0) + len(t.split())
    for r in got:
        used[r.source] = used.get(r.source, 0) + r.n_tokens
        seen.setdefault((r.doc_id, r.epoch), []).append(r)
    assert all(len(v) == 1 for v in seen.values()) and {i for i, _ in seen} == {r[0] for r in rows}
    a = 1 - math.log(3) / math.log(tokens["s0"] / min(tokens.values()))
    for s, n in tokens.items():
        target = n * (tokens["s0"] / n) ** (1 - a)
        assert target - 31 <= used[s] <= target + 1e-6
    for s in tokens:  # positions run through each epoch
        for e in {r.epoch for r in got if r.source == s}:
            own = sorted((r.position, r.n_tokens) for r in got if r.source == s and r.epoch == e)
            at = 0
            for p, n in own[:-1] if e else own:
                assert p == at or e
                at = p + n


def test_target_entropy_is_met(spark):
    df = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10)], "key string, tokens long")
    a = mixing.exponent(df, 0.9, None, None)
    p = np.array([1000, 100, 10]) / 1110
    w = p**a / (p**a).sum()
    assert -(w * np.log(w)).sum() == pytest.approx(0.9, abs=1e-9)
    with pytest.raises(ValueError):
        mixing.exponent(df, 2.0, None, None)


def test_entropy_gives_way_to_repeats(spark, frame):
    """The mixture nearest to the entropy that repeats nothing more often than allowed; a tiny source is not run through a million times."""
    sizes = {"a": 1000, "b": 100, "c": 10}
    df = spark.createDataFrame(list(sizes.items()), "key string, tokens long")
    free, held = mixing.exponent(df, 1.05, None, None), mixing.exponent(df, 1.05, 4, None)
    assert held > free and (1000 / 10) ** (1 - held) == pytest.approx(4) and mixing.exponent(df, 0.5, 4, None) == pytest.approx(mixing.exponent(df, 0.5, None, None))
    sharp = mixing.exponent(df, 0.05, 4, None)
    assert sharp > 1 and (1000 / 10) ** (sharp - 1) == pytest.approx(4)
    p = np.array(list(sizes.values())) / 1110
    for target in (1.05, 0.05):
        a = mixing.exponent(df, target, 3, 1110.0)
        assert (p ** (a - 1) / (p**a).sum()).max() == pytest.approx(3 if target > 1 else 1110 / 1000, rel=1e-2) or (p ** (a - 1) / (p**a).sum()).max() <= 3 + 1e-9
    with pytest.raises(ValueError):
        mixing.exponent(df, None, 2, 1110 * 3.0)
    rows = [(0, "w", None, "tiny")] + [(i, "w " * 3000, None, "big") for i in range(1, 21)]
    got = mixing.mixture(frame(rows), target_entropy=math.log(2) - 1e-6, max_repeats=4).collect()
    assert sum(r.doc_id == 0 for r in got) == 4 and len(got) == 24


def test_rows_without_an_id_fill_many_blocks(frame):
    rows = [(None, f"w {i}", None, "s") for i in range(300)] + [(7, f"v {i}", None, "s") for i in range(300)]
    got = mixing._placed(frame(rows), block_tokens=100).groupBy("block").count().collect()
    assert len(got) > 8 and max(r["count"] for r in got) < 150


def test_budget_and_repeats(spark, frame):
    df = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10)], "key string, tokens long")
    a = mixing.exponent(df, None, 5, 1110)
    p = np.array([1000, 100, 10]) / 1110
    w = p**a / (p**a).sum()
    assert (w / p).max() == pytest.approx(5, abs=1e-6)
    rows = sources(random.Random(3), [100, 20])
    total = sum(len(t.split()) for _, t, _, _ in rows)
    got = mixing.mixture(frame(rows), max_repeats=2, budget=total / 2, block_tokens=200)
    assert 0.9 * total / 2 - 60 <= got.agg(F.sum("n_tokens")).first()[0] <= total / 2


def test_mixing_of_odd_rows(frame):
    rows = [(1, None, None, None), (2, "", None, ""), (None, "a b", None, "s"), (3, "a", None, None), (3, "a", None, None), (4, "x " * 5, None, "s")]
    got = mixing.mixture(frame(rows, extra=True)).collect()
    assert {(r.doc_id, r.source) for r in got} == {(i, s) for i, _, _, s in rows}
    back = mixing.mixed(frame(rows, extra=True))
    assert back.columns == frame(rows, extra=True).columns and {r.doc_id for r in back.collect()} == {None, 1, 2, 3, 4}
    assert mixing.mixture(frame([])).count() == 0 and mixing.mixed(frame([])).count() == 0
    clash = frame(rows).withColumns({c: F.lit("x") for c in ("__uses", "__id", "uses", "id", "k", "h", "hash", "key")})
    assert mixing.mixed(clash).columns == clash.columns and {r["__uses"] for r in mixing.mixed(clash).collect()} == {"x"}


def test_mixing_agrees_with_sql(frame):
    rows = sources(random.Random(5), [200, 30, 7]) + [(1000, None, None, None), (1001, "", None, "e")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    got = mixing.mixture(frame(rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(con.sql(mixing.SQL).fetchall(), key=repr)


# Language ID




def probabilities(counts, past, k):
    """Of each of the 256 bytes (from 1 on) after a context of k symbols."""
    if k < 0:
        return dict.fromkeys(range(1, 257), 1 / 256)
    lower = probabilities(counts, past, k - 1)
    c = counts[k].get(past[len(past) - k :], {})
    if not c:
        return lower
    fresh = sum(p for x, p in lower.items() if x not in c)
    escape = len(c) if len(c) < 256 else 0
    total = sum(c.values()) + escape
    return {x: c[x] / total if x in c else escape / total * p / fresh for x, p in lower.items()}


def counts_of(texts, order):
    data, offsets = kernel.buffers(pa.array(texts, pa.string()))
    return np.unique(langid.codes(data.astype(np.int64) + 1, offsets, order), return_counts=True)


def model_of(named, order, **how):
    parts = [(lang, *counts_of(texts, order)) for lang, texts in named.items()]
    lang = np.concatenate([np.full(len(c), x, dtype=object) for x, c, _ in parts])
    return langid.model(lang, np.concatenate([c for _, c, _ in parts]), np.concatenate([n for _, _, n in parts]), order, **how)


@pytest.mark.parametrize("order", [0, 1, 2, 3, 4, 5])
def test_code_lengths_are_exact(order):
    rng = random.Random(order)
    train = {x: ["".join(rng.choices(letters, weights=[4, 2, 1, 1], k=14)) for _ in range(4)] for x, letters in (("x", "abc "), ("y", "cbdé"))}
    m = model_of(train, order)
    for k, lang in enumerate(m.languages):
        counts = [{} for _ in range(order + 1)]
        for t in train[lang]:
            past = (0,) * order
            for b in t.encode():
                for j in range(order + 1):
                    c = counts[j].setdefault(past[len(past) - j :], {})
                    c[b + 1] = c.get(b + 1, 0) + 1
                past = (*past, b + 1)[1:] if order else ()
        for t in ("abcab", "a", "cc b", "zab", "", "bdéé日 c", "aaa"):
            past, want = (0,) * order, 0.0
            for b in t.encode():
                want -= math.log2(probabilities(counts, past, order)[b + 1])
                past = (*past, b + 1)[1:] if order else ()
            raw = np.frombuffer(t.encode(), np.uint8)
            assert m.lengths(raw, np.array([0, len(raw)]))[0, k] == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_tables_find_what_they_hold():
    rng = np.random.default_rng(1)
    for n in (1, 5, 3000):
        keys = np.unique(rng.integers(0, 1 << 40, n))
        t = langid.Table(keys, 7)
        asked = np.concatenate([keys, rng.integers(0, 1 << 40, 500), [0]])
        want = {int(k): i + 7 for i, k in enumerate(keys)}
        assert t.find(asked).tolist() == [want.get(int(k), 0) for k in asked]


def test_many_languages_stay_within_the_cells():
    """200 languages, each with an alphabet of its own drawn from all scripts; the rarest grams go, and the rest still tells them apart."""
    rng = random.Random(3)
    texts = {}
    for k in range(200):
        letters = [chr(rng.choice([0x61, 0x3B1, 0x430, 0x5D0, 0x905, 0x4E00]) + rng.randrange(24)) for _ in range(10)]
        words = ["".join(rng.choices(letters, k=rng.randint(2, 6))) for _ in range(12)]
        texts[f"l{k:03d}"] = [" ".join(rng.choices(words, k=40)) for _ in range(8)]
    m = model_of({x: t[:6] for x, t in texts.items()}, 4, cells=2_000_000)
    assert m.bits.size <= 2_000_000 + 200 and np.isfinite(m.bits).all() and (m.tables[0].keys > 0).sum() > 60
    data, offsets = kernel.buffers(pa.array([t[7] for t in texts.values()], pa.string()))
    assert (m.lengths(data, offsets).argmin(1) == np.arange(200)).mean() > 0.98


def test_pruned_statistics_are_still_probabilities():
    train = {"x": ["abracadabra " * 3, "abc cab bac " * 2]}
    m = model_of(train, 3, cells=40)
    for head in ("", "a", "abra", "zz", "cab "):
        both = [np.frombuffer((head.encode() + bytes([b])), np.uint8) for b in range(256) if not 65 <= b <= 90]
        alone = np.frombuffer(head.encode(), np.uint8)
        base = m.lengths(alone, np.array([0, len(alone)]))[0, 0] if head else 0.0
        assert sum(2.0 ** -(m.lengths(x, np.array([0, len(x)]))[0, 0] - base) for x in both) == pytest.approx(1 - 26 * 2.0 ** -(m.lengths(np.append(alone, np.uint8(1)), np.array([0, len(alone) + 1]))[0, 0] - base), abs=1e-3)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) >= 0.99 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(frame):
    rows = [(i, "the cat and the dog " * 5, "en") for i in range(40)] + [(100 + i, "le chat et les chiens " * 5, "fr") for i in range(40)]
    odd = [(1000, None, "en"), (1001, "", None), (1002, "123 !!", "fr"), (None, "the dog", None), (5, "les chiens", "fr"), (1003, "the cat " * 50000, None)]
    got = {}
    for r in langid.identified(frame(rows + odd, extra=True)).collect():
        got.setdefault(r.doc_id, []).append((r.lang_pred, r.held_out))
    assert [got[i][0][0] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "en"]
    assert got[None] == [("en", False)] and sorted(x for x, _ in got[5]) == ["en", "fr"]
    import zlib

    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, v in got.items() if i is not None for _, h in v)
    assert langid.identified(frame([])).count() == 0
    nothing = langid.identified(frame([(1, "abc", None)])).first()
    assert (nothing.lang_pred, nothing.score) == ("und", 0.0)


def test_every_document_is_learned(frame):
    """6,000 documents of one language, each with five digits of its own; statistics and limits come from all."""
    rows = [(i, f"the cat {i:05d}", "en") for i in range(6000)]
    digits = np.frombuffer("".join(f"{i:05d}" for i in range(6000)).encode(), np.uint8).astype(np.int64) + 1
    own = langid.codes(digits, np.arange(0, 30_001, 5))[4::5]
    for m in (langid.trained(frame(rows)), langid.limited(frame(rows))[0]):
        assert m.tables[4].find(own).all()
    odd = [(i, f"the cat {chr(0x4E00 + i)}{chr(0x6E00 + i)}{chr(0x8E00 + i)}{chr(0x5E00 + i)}{chr(0x7E00 + i)}", "en") for i in (6000, 6001)]
    alone = [langid.limited(frame(rows + [x]))[1]["en"] for x in odd]
    assert langid.limited(frame(rows + odd))[1]["en"] > langid.limited(frame(rows))[1]["en"] and min(alone) > langid.limited(frame(rows))[1]["en"]


def test_counts_are_those_of_all_lots(monkeypatch, frame):
    """Counts that are merged and passed on in parts add up to those of all texts at once."""
    rng = random.Random(2)
    rows = [(i, "".join(rng.choices("abcdef ", k=rng.randrange(60))), rng.choice(["x", "y"])) for i in range(300)]
    got = {(r.lang, r.code): r.n for r in langid.counted(langid.learned(frame(rows)), ["lang"]).collect()}
    want = {(x, int(c)): int(n) for x in "xy" for c, n in zip(*counts_of([t for _, t, lang in rows if lang == x], 4), strict=True)}
    assert got == want
    found, all_keys = langid.Counts(), np.random.default_rng(3).integers(0, 500, 40_000)
    monkeypatch.setattr(langid, "GRAMS", 400)
    for k in range(0, 40_000, 700):
        found.add(all_keys[k : k + 700])
    found.merge()
    assert [x.tolist() for x in np.unique(all_keys, return_counts=True)] == [found.keys.tolist(), found.n.tolist()]


def test_grams_beyond_the_cells_go_before_they_are_gathered(frame):
    """The model is that of all counts narrowed at once, and the driver gets fewer of them."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["abra", "cad", "abc", "bac", "xyz", "zyx"], k=9)) + f"{rng.randrange(10**6)}", lang) for i in range(200) for lang in ("x", "y")]
    counts = langid.counted(langid.learned(frame(rows)), ["lang"])
    for cells in (1500, 4000, 10**6):
        lang, _, code, n, level = langid.gathered(counts, cells)
        narrow = langid.model(lang, code, n, cells=cells, level=level)
        kept = langid.model(lang, code, n, cells=10**9, level=level)
        assert narrow.bits.shape == kept.bits.shape and kept.bits.size <= cells + 2  # nothing is left to narrow
        if cells < 10**6:
            assert (level < 4).any() and len(code) < counts.count() and n.sum() == counts.groupBy().sum("n").first()[0]
            t = counts.collect()
            plain = langid.model(np.array([r.lang for r in t], dtype=object), np.array([r.code for r in t]), np.array([r.n for r in t]), cells=cells)
            data, offsets = kernel.buffers(pa.array([x for _, x, _ in rows[:50]], pa.string()))
            assert np.abs(narrow.lengths(data, offsets) / plain.lengths(data, offsets) - 1).max() < 0.1
        else:
            assert (level == 4).all() and len(code) == counts.count()


def test_lang_and_ids_do_not_enter_predictions(frame):
    rows = [(i, "the cat and the dog " * 5, "en") for i in range(40)] + [(100 + i, "le chat et les chiens " * 5, "fr") for i in range(40)]
    m = langid.trained(frame(rows))
    one = langid.predicted(frame([(1, "the cat", "fr", "x")]), m).first()
    two = langid.predicted(frame([(2, "the cat", None, None)]), m).first()
    assert (one.lang_pred, one.score) == (two.lang_pred, two.score) == ("en", one.score)


# Fingerprints


M64 = (1 << 64) - 1


def stirred(h):
    """Finaliser of splitmix64, on plain integers."""
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & M64
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & M64
    return h ^ (h >> 31)


def word_hash(word):
    base, total = 0x9E3779B97F4A7C15, 0
    for k, b in enumerate(word):
        total = (total + (b + 1) * pow(base, k, 1 << 64)) & M64
    return stirred((total + 0x632BE59BD9B4E019) & M64)


def plain_fingerprint(text):
    """The lanes of a text, paragraph by paragraph and run of words by run of words, without the library's kernels."""
    equal, alike = [0] * 8, [0] * 256
    for line in (text or "").encode().split(b"\n"):
        if not line:
            continue
        digest = xxhash.xxh3_128_digest(line)
        high, low = (int.from_bytes(digest[k : k + 8], "big") for k in (0, 8))
        for lane in range(8):
            step = (0x9E3779B97F4A7C15 * (2 * lane + 1)) & M64
            equal[lane] = (equal[lane] + (stirred((high + step) & M64) ^ stirred(low ^ step))) & M64
        words = [word_hash(w) for w in line.split()]
        runs = [words[k : k + 3] for k in range(len(words) - 2)] or ([words] if words else [])
        for run in runs:
            h = 0
            for w in run:
                h = (h * 0xD6E8FEB86659FD93 + w) & M64
            h = stirred((h + len(run)) & M64)
            alike[h & 255] += -1 if h >> 63 else 1
    return equal, alike


def plain_likeness(one, two):
    if one[0] == two[0]:
        return 1.0
    dot, n1, n2 = (sum(x * y for x, y in zip(a, b, strict=True)) for a, b in ((one[1], two[1]), (one[1], one[1]), (two[1], two[1])))
    return min(max(dot / math.sqrt(n1 * n2), 0.0), 1 - 1e-9) if n1 and n2 else 0.0


def code_of(lanes):
    return base64.b64encode(b"".join(x.to_bytes(8, "little") for x in lanes[0]) + b"".join((x % (1 << 32)).to_bytes(4, "little") for x in lanes[1])).decode()


@pytest.mark.parametrize("size", [60, 200, 1 << 20])
def test_fingerprints(frame, monkeypatch, size):
    """Against a plain computation of the lanes, the edit and the likeness."""
    rng = random.Random(9)
    rows = [(i, "\n".join(" ".join(rng.choices(["ab", "cé", "d"], k=rng.randint(0, 9))) for _ in range(rng.randint(0, 6)))) for i in range(0, 90, 3)]
    rows += [(1, None), (2, ""), (4, rows[0][1]), (500, "日" * 7), (None, "last"), (-(1 << 63), "the least id of all")]
    monkeypatch.setattr(multihash, "PART_BYTES", size)
    got = {r.doc_id: r for r in multihash.fingerprints(frame(rows, extra=True)).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 3
        new = t[: len(t) - n] + nxt[:n]
        own, after, following = plain_fingerprint(t), plain_fingerprint(new), plain_fingerprint(nxt)
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (code_of(own), code_of(after))
        assert (r.near_edited, r.near_next) == (pytest.approx(plain_likeness(own, after)), pytest.approx(plain_likeness(own, following)))


@pytest.mark.parametrize("size", [40, 1 << 20])
def test_fingerprints_where_an_id_repeats(frame, monkeypatch, size):
    """Each row once; a row follows another of its id, or the last of them the next id's first."""
    monkeypatch.setattr(multihash, "PART_BYTES", size)
    rows = [(7, f"text number {k}") for k in range(60)] + [(k, f"other {k}") for k in (1, 3, 9, 12)]
    got = multihash.fingerprints(frame(rows)).collect()
    assert sorted(r.fingerprint for r in got) == sorted(code_of(plain_fingerprint(t)) for _, t in rows)
    edits = {hashlib.sha256((t[: len(t) - len(t) // 3] + u[: len(t) // 3]).encode()).hexdigest() for _, t in rows for _, u in rows}
    assert {r.edited_sha256 for r in got} <= edits
    _, most = multihash.parted(frame(rows).selectExpr("doc_id", "xxhash64(text) AS h", "text"), 30)
    parts = {r.part: r.n for r in multihash.parted(frame(rows).selectExpr("doc_id", "xxhash64(text) AS h", "text"), 30)[0].groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert max(parts.values()) < 30 and max(parts) < most


def test_fingerprints_of_nothing_and_of_one(frame):
    assert multihash.fingerprints(frame([])).count() == 0
    alone = multihash.fingerprints(frame([(1, "abcdef")])).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and alone.near_next == 1


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet="ab é", min_size=1, max_size=8), max_size=6), st.text(alphabet="ab c", min_size=1, max_size=8), st.randoms())
def test_fingerprints_are_homomorphic(lines, extra, rng):
    code = multihash.fingerprint("\n".join(lines))
    mixed = list(lines)
    rng.shuffle(mixed)
    assert multihash.fingerprint("\n\n".join(mixed)) == code
    more = multihash.changed(code, extra)
    assert more == multihash.fingerprint("\n".join([extra, *lines])) and more != code
    assert multihash.changed(more, extra, -1) == code


# Vectors


def brute_vectors(rows):
    links, up = {}, {}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    good = []
    for k, (i, v, lab) in enumerate(rows):
        if i is not None:
            up.setdefault(i, i)
        if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.append(k)
    n = [0] * len(rows)
    for x in range(len(good)):
        for y in range(x):
            (i, v, a), (j, w, b) = rows[good[x]], rows[good[y]]
            if a == b and len(v) == len(w):
                v, w = np.array(v, np.float64), np.array(w, np.float64)
                if v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.93:
                    n[good[x]] += 1
                    n[good[y]] += 1
                    p, q = root(i), root(j)
                    up[max(p, q)] = min(p, q)
    return sorted(((r[0], n[k], root(r[0]) if r[0] is not None else None) for k, r in enumerate(rows)), key=repr)


@pytest.mark.parametrize("tile", [7, 4096])
def test_vectors_match_brute_force(spark, tile):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(120):
        base = rows[rng.integers(len(rows))][1] if rows and rng.random() < 0.6 else rng.normal(size=16).tolist()
        noise = rng.choice([0, 0, 0.1, 0.25])
        rows.append((int(1000 - k * 3), (np.array(base) + noise * rng.normal(size=16)).astype(np.float32).tolist(), int(rng.integers(2))))
    rows += [(1, None, 0), (2, [0.0] * 16, 0), (3, [float("nan")] * 16, 0), (4, [None] * 16, 0), (5, [1.0] * 16, None), (None, rows[0][1], rows[0][2]), (6, [], 0), (7, rows[0][1][:8], rows[0][2]), (8, [float("inf")] * 16, 1), (1000, rows[0][1], rows[0][2])]
    rows += [(9, [1e-30] * 16, 1), (10, [1e30] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS node", "2 AS links", "3 AS k")
    got = embed.near_duplicates(df, tile=tile).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr) == brute_vectors(rows)
    assert all(r.kept == (r.vec_id == r.component_id or r.vec_id is None) for r in got)


def test_vectors_of_nothing(spark):
    assert embed.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_bounds_are_rigorous():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 64)) * rng.choice([1, 1e-6, 1e6], size=(300, 1))
    x[::3] += 5
    u = embed.units(x)
    q, s, e, rest = embed.quantised(u)
    near = embed.products(q, q) * (s[:, None] * s[None, :])
    bound = e[:, None] + e[None, :] * (1 + e[:, None]) + embed.SLACK
    assert (np.abs(near - u @ u.T) <= bound).all() and q.dtype == np.int8
    c = embed.Codes.of(u)
    assert (np.sqrt(((u - c.close()) ** 2).sum(1)) <= c.d + 1e-12).all() and (c.d < 1e-3).all()
    true = u @ u.T
    sure, a, b = embed.linked(c, c, 0.93)
    still = np.zeros_like(sure)
    still[a, b] = True
    assert (sure <= (true >= 0.93)).all() and ((true >= 0.93) <= (sure | still)).all() and still.sum() < sure.size / 50


def test_pairs_at_the_threshold_are_settled_in_full_precision(spark):
    """Vectors whose cosine with the first is the threshold, or the next number below it."""
    rows = [(1, [1.0, 0.0, 0.0], 0)]
    for k in range(2, 40):
        c = 0.93 + (k - 20) * 1e-9
        rows.append((k, [c * k, math.sqrt(1 - c * c) * k * math.cos(k), math.sqrt(1 - c * c) * k * math.sin(k)], 0))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = embed.near_duplicates(df).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr) == brute_vectors(rows)


# The pipeline


def test_pipeline(spark, library):
    """Each stage against a plain computation on its own input."""
    import corpus_pipeline
    from test_text_dedup import brute_components, brute_removal

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "mixing", "packing"]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        given = {r.doc_id: r for r in now.collect()}
        now = spark.createDataFrame(stage(spark, now, d).collect(), docs.schema)
        assert now.schema == docs.schema
        out = now.collect()
        ids = [r.doc_id for r in out]
        if name == "language_id":
            assert set(ids) == {i for i, r in given.items() if r.text and any(c.isalpha() for c in r.text)} and len(ids) == len(set(ids))
            assert all(r[:2] + r[3:] == given[r.doc_id][:2] + given[r.doc_id][3:] for r in out) and sum(r.lang == given[r.doc_id].lang for r in out) >= 0.98 * len(out)
        if name == "near_dedup":
            comp = brute_components([(i, r.text) for i, r in given.items()], 80)
            assert sorted(ids) == sorted({min(i for i in comp if comp[i] == c) for c in comp.values()}) and all(r == given[r.doc_id] for r in out)
        if name == "substring_dedup":
            want = {i: (n, gone, kept) for i, n, gone, kept in brute_removal([(i, r.text) for i, r in given.items()])}
            assert sorted(ids) == sorted(i for i, (n, gone, _) in want.items() if gone == 0 or gone < n) and any(gone for _, gone, _ in want.values())
            for r in out:
                old = given[r.doc_id]
                assert r.text.encode().split() == want[r.doc_id][2].encode().split() and r.n_chars == len(r.text)
                assert (r.text == old.text or want[r.doc_id][1]) and (r.lang, r.source) == (old.lang, old.source)
        if name == "mixing":
            con = duckdb.connect()
            con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
            con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [tuple(r) for r in given.values()])
            want = dict(con.sql(f"SELECT doc_id, count(*) FROM ({mixing.SQL}) GROUP BY doc_id").fetchall())
            assert {i: ids.count(i) for i in set(ids)} == want and max(want.values()) <= 4 and all(r == given[r.doc_id] for r in out)
    texts, uses = {r.doc_id: r.text for r in out}, {i: ids.count(i) for i in set(ids)}
    covered, sequences = {}, {}
    for r in corpus_pipeline.STAGES[-1][1](spark, now, d).collect():
        own = covered.setdefault(r.doc_id, ([*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 1], []))
        assert list(r.ids) == own[0][r.start : r.start + r.length] and r.doc_tokens == len(own[0])
        own[1].extend(range(r.start, r.start + r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, (tokens, places) in covered.items():
        assert sorted(places) == sorted(list(range(len(tokens))) * uses[i])
    assert set(covered) == set(uses)
    full = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        full += at == 2048
        assert at & (at - 1) == 0
    assert full >= len(sequences) - 11


def test_stages_keep_columns_of_any_name(spark):
    """Columns by the names that the operators give their own."""
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names = ["score", "lang_pred", "bits_per_byte", "__letter", "__uses", "__id", "most", "uses", "c0", "chunk", "row", "node", "k", "h"]
    now = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names})
    columns = now.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, "").collect(), now.schema)
        assert now.columns == columns and now.count() > 0
        assert all(r[c] == f"{c}{r.doc_id}" for r in now.collect() for c in names)


def test_pipeline_on_nothing_and_on_odd_rows(spark):
    import corpus_pipeline

    schema = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").schema
    odd = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "the cat and the dog sat", "en", None, 5), (3, "the cat and the dog sat", "en", "a", 5), (3, "the cat and the dog sat", "en", "a", 5), (4, "12 34", "en", "b", 5), (5, "the dog " * 40, "en", "b", 5)]
    for rows in ([], odd):
        now = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, "")
            kept = out.collect()
            if name != "packing":
                assert out.columns == schema.names
                now = spark.createDataFrame(kept, schema)
        if rows:
            assert {r.doc_id for r in kept} == {None, 3, 5}
