"""Near-duplicates and repeated passages against brute force."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from waymark.llm import graph, kernel, minhash, oracles, substring

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text):
    w = (text or "").encode().translate(LOWER).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_components(rows, num=85):
    """Component of each id, by all pairs."""
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            if any(a and b and 100 * len(a & b) >= num * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def corpus(seed, n=120):
    """Documents with exact copies, near copies of several degrees, chains, and a common passage."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    common = rng.choices(words, k=30)
    out = []
    for _ in range(n // 4):
        base = rng.choices(words, k=rng.randint(1, 120))
        if rng.random() < 0.5:
            base += common
        out.append(list(base))
        for _ in range(3):
            t = list(rng.choice(out[-3:]))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                t[rng.randrange(len(t))] = rng.choice(words)
            out.append(t)
    rng.shuffle(out)
    return [(i * 3 + 1, " ".join(t)) for i, t in enumerate(out)]


def near(frame, rows, num=85, **how):
    return minhash.near_duplicates(frame(rows, **how), num=num).collect()


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_match_brute_force(frame, seed):
    rows = corpus(seed)
    want = brute_components(rows)
    got = near(frame, rows, extra=True)
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(shingles(t)) for i, t in rows}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("num", [80, 85])
def test_cloud_of_near_copies(frame, num):
    """One base with many copies at all distances: pairs within it come from the differences from the hub."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(500)]
    base = rng.choices(words, k=150)
    rows = [(1000, " ".join(base))]
    for i in range(150):
        t = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 8])):
            t[rng.randrange(len(t))] = f"n{rng.randrange(10**6)}"
        if rng.random() < 0.2:
            t = t[: rng.randint(110, 150)]
        rows.append((i, " ".join(t)))
    for i in range(20):  # copies of far copies
        t = rows[rng.randrange(1, 151)][1].split()
        t[rng.randrange(len(t))] = "z"
        rows.append((200 + i, " ".join(t)))
    assert {r.doc_id: r.component_id for r in near(frame, rows, num)} == brute_components(rows, num)


def test_copies_share_a_component_without_pairs(frame):
    rows = [(i, "one two three four five six") for i in range(300)] + [(300, "one two three")]
    got = {r.doc_id: r.component_id for r in near(frame, rows)}
    assert got == {**dict.fromkeys(range(300), 0), 300: 300}


def test_near_duplicates_of_odd_rows(frame):
    rows = [(5, None), (6, ""), (7, " \n"), (None, "a b c d e f"), (9, "A b"), (8, "a B"), (8, "a B"), (4, "a b"), (3, "x"), (11, "q " * 30000)]
    got = near(frame, rows)
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert by[5] == by[5] and {by[k][0] for k in (5, 6, 7)} == {(0, 5, True), (0, 6, True), (0, 7, True)}
    assert by[None] == [(2, None, True)]
    assert by[4] == [(1, 4, True)] and by[8] == [(1, 4, False)] * 2 and by[9] == [(1, 4, False)]
    assert by[11] == [(1, 11, True)]


def test_rows_of_one_id_are_one_document(frame):
    """Several texts of a doc_id: links of all of them, one component, named by the smallest doc_id."""
    t = [" ".join(f"{c}{i}" for i in range(20)) for c in "abcde"]
    rows = [(5, t[0]), (5, t[1]), (5, ""), (3, t[0]), (9, t[1]), (9, t[2]), (4, t[2] + " x"), (7, t[3]), (7, t[3]), (8, t[4]), (8, None), (2, t[4])]
    got = {}
    for r in near(frame, rows):
        got.setdefault(r.doc_id, set()).add((r.component_id, r.kept))
    assert got == {i: {(c, i == c)} for i, c in brute_components(rows).items()} == {5: {(3, False)}, 3: {(3, True)}, 9: {(3, False)}, 4: {(3, False)}, 7: {(7, True)}, 8: {(2, False)}, 2: {(2, True)}}


def test_near_duplicates_of_nothing(frame):
    assert near(frame, []) == []


def test_threshold_must_be_high(frame):
    with pytest.raises(ValueError):
        minhash.near_duplicates(frame([]), num=70)


@pytest.mark.parametrize("small", [0, 60, 10**6])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(graph, "SMALL", small)
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(400):
        for a, b in edges:
            if a != b:
                up[a] = up[b] = min(up[a], up[b])
    assert got == up
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_removal(rows, k=13):
    first = {}
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    for i, t in order:
        w = (t or "").encode().split()
        for j in range(len(w) - k + 1):
            first.setdefault(tuple(w[j : j + k]), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for j in range(len(w) - k + 1 if i is not None else 0):
            if first[tuple(w[j : j + k])] < i:
                gone |= set(range(j, j + k))
        out.append((i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return sorted(out, key=repr)


def removed(frame, rows, **how):
    return [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring.deduplicated(frame(rows, extra=True), **how).collect()]


@pytest.mark.parametrize("size", [300, 1 << 20])
def test_removal_matches_brute_force(frame, size):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)] + ["é", "W1"]
    passages = [rng.choices(words, k=rng.randint(10, 40)) for _ in range(5)]
    rows = []
    for i in range(60):
        t = rng.choices(words, k=rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            t[rng.randint(0, len(t)) : 0] = rng.choice(passages)
        rows.append((rng.randrange(50), rng.choice([" ", "\n", " \t"]).join(t)))
    rows += [(None, " ".join(passages[0])), (99, None), (98, ""), rows[0]]
    assert sorted(removed(frame, rows, chunk_bytes=size, shard_bytes=size), key=repr) == brute_removal(rows)


def test_spans_are_maximal(frame):
    p = [f"p{i}" for i in range(20)]
    got = {r.doc_id: r for r in substring.deduplicated(frame([(1, " ".join(p)), (2, " ".join(["a", *p, "b", *p[:13], "c"]))])).collect()}
    assert [(s["from"], s["to"]) for s in got[2].spans] == [(1, 21), (22, 35)] and got[2].kept_text == "a b c" and got[1].spans == []


def test_removal_of_nothing(frame):
    assert removed(frame, []) == []
    assert substring.without_repeats(frame([])).columns == ["doc_id", "text", "lang", "source"]


def test_a_window_that_is_everywhere(frame):
    text = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"d{i} {text}") for i in range(500)]
    got = sorted(removed(frame, rows, chunk_bytes=2000, shard_bytes=2000))
    assert got[0][2] == 0 and {(g[1], g[2]) for g in got[1:]} == {(31, 30)}


def test_without_repeats_keeps_columns(frame):
    text = " ".join(f"p{i}" for i in range(30))
    df = frame([(1, text + "\n x", "en", "s"), (2, "new " + text, "de", None), (3, text, "fr", "s"), (4, "short", None, "s")], extra=True)
    got = substring.without_repeats(df)
    assert got.columns == df.columns
    assert {r.doc_id: (r.text, r.lang, r.source, r.node) for r in got.collect()} == {1: (text + "\n x", "en", "s", "x"), 2: ("new", "de", None, "x"), 4: ("short", None, "s", "x")}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\t é", max_size=30)), max_size=8))
def test_words_are_those_of_split(texts):
    data, offsets = kernel.buffers(pa.array(texts, pa.string()))
    w = kernel.Words(data, offsets)
    for r, t in enumerate(texts):
        own = [data[w.starts[k] : w.ends[k]].tobytes() for k in range(w.rows[r], w.rows[r + 1])]
        assert own == (t or "").encode().split()
    same = {}
    for k in range(len(w.starts)):
        assert same.setdefault(data[w.starts[k] : w.ends[k]].tobytes(), w.hash[k]) == w.hash[k]
    assert len(set(same.values())) == len(same)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab ", max_size=20), max_size=6), st.integers(1, 4))
def test_windows_are_equal_only_for_equal_words(texts, k):
    data, offsets = kernel.buffers(pa.array(texts, pa.string()))
    w = kernel.Words(data, offsets)
    h, first, off = w.windows(k, whole=True)
    seen, back = {}, {}
    for r, t in enumerate(texts):
        words = t.split()
        want = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)] or ([tuple(words)] if words else [])
        assert off[r + 1] - off[r] == len(want)
        for x, y in zip(h[off[r] : off[r + 1]], want, strict=True):
            assert seen.setdefault(y, x) == x and back.setdefault(x, y) == y


def test_packed_numbers_return():
    rng = np.random.default_rng(1)
    for kind in (np.uint64, np.uint32):
        for n in (0, 1, 1000):
            v = rng.integers(0, np.iinfo(kind).max, n, dtype=kind)
            assert (substring.unpacked(substring.packed(v), kind) == v).all()


def test_sql_agrees(spark, frame):
    rows = corpus(3, 60)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near(frame, rows))
    assert got == sorted(con.sql(oracles.NEAR_DOCUMENTS).fetchall())
