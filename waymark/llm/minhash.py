"""Near-duplicate documents by bottom-k sketches of one hash function.

1. Every document's set of word shingles is hashed with one function; the k
   smallest hashes are its sketch, and a 128-bit sum over the set names its
   class of documents with equal sets.  One document of a class stands for it.
2. Two sets over the threshold share at least ``least_overlap`` retained values
   (up to a chance of about 1e-8 for the bound used here), so it is enough to keep
   for each sketch its rarest values down to that bound: values that many
   unrelated documents hold vanish from the inverted lists.
3. Inverted lists of what is left give overlaps: each list first pairs its
   members with its smallest one.  The bottom-k of a pair's united sketches
   estimates its similarity; what passes is verified on the full sets.
4. Members of one list that are then still in different components may yet be
   linked.  Around a hub with many members they are matched by what sets them
   apart from the hub (``within_clouds``), else with each other.  Pairs within a
   component cannot change the result and are never made.

No list or class is gathered in one task, and components only of so few links
(graph.SMALL) that one task can join them; nothing of it comes to the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel
from .graph import components
from .shared import small_batches, small_or_plain, written

K = 32
#: A true pair of threshold 0.85 has fewer than 14 of 32 retained values in common with a chance of about 1e-8.
LEAST = 14
#: Members verified against one copy of a hub's text.
FAN = 64
#: From so many members on, a hub's members are matched by their differences from it.
WIDE = 16
#: Ratio between the classes of the numbers of differences.
STEP = 1.3


def sketches(docs: DataFrame, words: int = 5, k: int = K, with_text: bool = False) -> DataFrame:
    """(doc_id, n, f1, f2, sketch) for each row of docs(doc_id, text); with_text: and text.

    n: size of the shingle set (whole sequence if the text has fewer words; 0
    without words or text); f1, f2: sums over the set; sketch: its k smallest hashes.
    """
    schema = "doc_id long, n long, f1 long, f2 long, sketch array<long>" + ", text string" * with_text

    def run(batches):
        kernel.task("shingles")
        for batch in batches:
            ids = batch.column(0)
            data, offsets = kernel.buffers(batch.column(1))
            for i, j in kernel.spans(np.diff(offsets)):
                part = kernel.Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower=True)
                h, _, off = part.windows(words, whole=True)
                sets = kernel.sorted_sets(h, off)
                with np.errstate(over="ignore"):
                    f1 = np.array([kernel.mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for x in sets], dtype=np.uint64)
                    f2 = np.array([kernel.mix(x + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64) for x in sets], dtype=np.uint64)
                heads = [x[:k].view(np.int64) for x in sets]
                flat = np.concatenate(heads) if heads else np.zeros(0, np.int64)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in heads])]).astype(np.int32)
                own = [ids.slice(i, j - i).cast(pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))]
                more = [batch.column(1).slice(i, j - i)] if with_text else []
                yield pa.RecordBatch.from_arrays(own + more, names=["doc_id", "n", "f1", "f2", "sketch", *["text"] * with_text])
        kernel.trim()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def least_overlap(n: Column, threshold: float, k: int) -> Column:
    """Retained values that a set of n elements shares with any set over the threshold.

    A set that is kept whole loses what its partner's sketch cut off at most.
    """
    cut = F.greatest(F.lit(0), F.floor(n / threshold + 1e-9) - k)
    small = F.greatest(F.lit(1), F.ceil(n * threshold - 1e-9) - cut)
    return F.when(n <= k, small).otherwise(LEAST).cast("int")


def postings(nodes: DataFrame, threshold: float, k: int) -> DataFrame:
    """(v, node, n): the rarest retained values of each node, as many as a partner cannot all miss."""
    all_ = nodes.select("node", "n", F.explode("sketch").alias("v"))
    often = all_.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    held = all_.join(often, "v").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))
    kept = F.size("vs") - least_overlap(F.col("n"), threshold, k) + 1
    return held.where(kept > 0).select("node", "n", F.explode(F.slice("vs", 1, kept)).alias("x")).select(F.col("x.v").alias("v"), "node", "n")


def near(n1: Column, n2: Column, num: int, den: int) -> Column:
    """Sizes allow the threshold num / den."""
    return (n1 * den >= n2 * num) & (n2 * den >= n1 * num)


def estimated(pairs: DataFrame, nodes: DataFrame, num: int, den: int, k: int) -> DataFrame:
    """Pairs (a, b) whose united sketches do not rule the threshold out."""
    one = nodes.select(F.col("node").alias("a"), F.col("n").alias("an"), F.col("sketch").alias("sa"))
    two = nodes.select(F.col("node").alias("b"), F.col("n").alias("bn"), F.col("sketch").alias("sb"))
    both = pairs.select("a", "b").join(one, "a").join(two, "b").where(near(F.col("an"), F.col("bn"), num, den))
    united = both.select("a", "b", "an", "bn", F.array_intersect("sa", "sb").alias("i"), F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k).alias("u"))
    x = united.select("a", "b", F.size(F.array_intersect("u", "i")).alias("x"), F.size("u").alias("s"), ((F.col("an") <= k) & (F.col("bn") <= k) & (F.size("u") < k)).alias("whole"))
    return x.where(F.when(F.col("whole"), F.col("x") * den >= F.col("s") * num).otherwise(F.col("x") >= LEAST)).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(a, b, link, an, bn, diff) of pairs (a, b, wide): link tells whether the full sets of texts(node, text) reach the threshold.

    The members a of a hub b are dealt out FAN at a time, each lot with one copy
    of b.  diff: the elements that only one of the two sets holds, if wide is true.
    """
    n = pairs.count()
    lots = pairs.groupBy("b").agg(F.ceil(F.count("*") / FAN).alias("lots"))
    dealt = pairs.join(small_or_plain(lots, n), "b").select("a", "b", "wide", F.pmod(F.xxhash64("a"), "lots").alias("lot"))
    asked = dealt.select(F.col("a").alias("node"), "b", "lot", F.when(F.col("wide"), 2).otherwise(1).alias("role"))
    asked = asked.unionByName(dealt.select(F.col("b").alias("node"), "b", "lot").distinct().withColumn("role", F.lit(0)))
    small = small_or_plain(asked, 3 * n)  # a hub has no more lots than members
    rows = texts.join(small, "node").repartition("b", "lot").sortWithinPartitions("b", "lot", "role").select("node", "text", "role")

    def run(batches):
        kernel.task("shingles")
        hub, hub_id = None, None
        for batch in batches:
            ids, roles = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            data, offsets = kernel.buffers(batch.column(1))
            for i, j in kernel.spans(np.diff(offsets)):
                part = kernel.Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower=True)
                h, _, off = part.windows(words, whole=True)
                out = []
                for r, own in enumerate(kernel.sorted_sets(h, off), i):
                    if roles[r] == 0:
                        hub, hub_id = own, ids[r]
                        continue
                    at = np.searchsorted(hub, own)
                    at[at == len(hub)] = 0
                    shared = hub[at] == own if len(hub) else np.zeros(len(own), bool)
                    common = int(shared.sum())
                    diff = None
                    if roles[r] == 2:
                        lost = np.ones(len(hub), dtype=bool)
                        lost[at[shared]] = False
                        diff = np.concatenate([own[~shared], hub[lost]]).view(np.int64)
                    out.append((ids[r], hub_id, common > 0 and den * common >= num * (len(hub) + len(own) - common), len(own), len(hub), diff))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)],
                        names=["a", "b", "link", "an", "bn", "diff"],
                    )
        kernel.trim()

    return rows.mapInArrow(run, "a long, b long, link boolean, an long, bn long, diff array<long>")


def homes_of(star: DataFrame) -> DataFrame:
    """(node, home): of the hubs with many members that a node belongs to or is, the one with the most."""
    wide = star.groupBy("b").agg(F.count("*").alias("m")).where(F.col("m") >= WIDE)
    own = star.join(small_or_plain(wide, star.count() // WIDE), "b").select(F.col("a").alias("node"), "m", "b").unionByName(wide.select(F.col("b").alias("node"), "m", "b"))
    return own.groupBy("node").agg(F.max(F.struct("m", "b")).alias("x")).select("node", F.col("x.b").alias("home"))


def within_clouds(tested: DataFrame, found: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of members of one home that may reach the threshold, over different components.

    Let d be a set's differences from the hub's set.  Two sets over the
    threshold differ in at most m = (1 - t) * n / t elements, n being the size
    of either, so their differences from the hub share at least
    (|d1| + |d2| - m) / 2 elements; and a set not linked to the hub has
    |d| > (1 - t) * max(n, size of the hub).  It is therefore enough to match
    the rarest |d| - o + 1 elements, o being the least that a partner can
    share, and to pair outright the few for whom that bound is not positive.
    """
    t = num / den
    wide = tested.where("diff is not null").select("a", "b", "link", "diff", F.col("an").alias("n"), F.col("bn").alias("hn"))
    wide = wide.join(found.withColumnRenamed("node", "a"), "a", "left").withColumn("c", F.coalesce("component", "a")).drop("component")
    own = found.select(F.col("node").alias("b"), F.col("component").alias("hc"))
    wide = wide.join(own, "b", "left").withColumn("far", F.col("c") != F.coalesce("hc", "b")).drop("hc")
    some = wide.where("far").select("b").distinct()
    d, m = F.size("diff"), (1 - t) * F.col("n") / t + 1e-6
    wide = written(wide.join(some, "b", "left_semi").withColumns({"d": d, "m": m}), "clouds")
    outer = (1 - t) * F.greatest(t * F.col("n"), F.col("hn"))
    each = wide.select("b", "a", F.explode("diff").alias("e"))
    often = each.groupBy("b", "e").agg(F.count("*").alias("df")).where("df > 1")
    held = each.join(often, ["b", "e"]).groupBy("b", "a").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("es"))
    held = held.join(wide.drop("diff", "link"), ["b", "a"])
    # the bound by classes of the partner's |d|; a member of the hub's component only needs partners outside it, which are not linked to the hub
    kind = lambda x: F.floor(F.log(x + 1) / math.log(STEP)).cast("int")
    pairs = held.withColumn("own", kind(F.col("d"))).withColumn("k", F.explode(F.sequence(kind(F.greatest(F.lit(0), F.col("d") - F.col("m"))), kind(F.col("d") + F.col("m")))))
    low = F.ceil(F.pow(F.lit(STEP), F.col("k")) - 1 - 1e-6)
    low = F.greatest(low, F.col("d") - F.col("m"), F.when(F.col("far"), 0).otherwise(outer))
    pairs = pairs.where(F.col("far") | (outer < F.pow(F.lit(STEP), F.col("k") + 1)))
    least = F.greatest(F.lit(1), F.ceil((F.col("d") + low - F.col("m")) / 2 - 1e-6))
    pairs = pairs.withColumn("kept", (F.size("es") - least + 1).cast("int")).where("kept > 0")
    posts = pairs.select("b", "a", "n", "c", "far", F.least("own", "k").alias("k1"), F.greatest("own", "k").alias("k2"), "own", F.explode(F.slice("es", 1, F.col("kept"))).alias("x"))
    posts = written(posts.select("b", "a", "n", "c", "far", "own", "k1", "k2", F.col("x.e").alias("e")), "differences")
    other = posts.select("b", "e", "k1", "k2", F.col("a").alias("a2"), F.col("n").alias("n2"), F.col("c").alias("c2"), F.col("far").alias("far2"), F.col("own").alias("own2"))
    shared = posts.where("far").join(other, ["b", "e", "k1", "k2"]).where("c <> c2 and (not far2 or a > a2) and own + own2 = k1 + k2").where(near(F.col("n"), F.col("n2"), num, den))
    shared = shared.select(F.greatest("a", "a2").alias("a"), F.least("a", "a2").alias("b"))
    shell = wide.where("far and d <= m").select("b", "a", "n", "c", "d")
    ball = wide.where((F.col("d") + outer <= F.col("m")) | F.col("far") & (F.col("d") <= F.col("m")))
    ball = ball.select("b", F.col("a").alias("a2"), F.col("n").alias("n2"), F.col("c").alias("c2"), F.col("d").alias("d2"))
    close = F.col("d") + F.col("d2") <= (1 - t) * (F.col("n") + F.col("n2")) / (1 + t) + 1e-6
    outright = shell.join(ball, "b").where("c <> c2").where(close).select(F.greatest("a", "a2").alias("a"), F.least("a", "a2").alias("b"))
    return shared.unionByName(outright)


def classes_of(sk: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(f1, f2, n, node, copies, least, sketch): the classes of documents with equal sets; and (doc_id, node) of doc_ids with several sets, if any.

    least is the class's smallest doc_id, and node too, unless it holds a doc_id
    with several sets: then it is a hash of the class.
    """
    key = F.struct("f1", "f2", "n")
    some = sk.where("n > 0 and doc_id is not null")
    split = sk.where("doc_id is not null").groupBy("doc_id").agg(F.min(key).alias("k1"), F.max(key).alias("k2")).where("k1 <> k2").select("doc_id")
    plain = some.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.min_by("sketch", "doc_id").alias("sketch"))
    if split.isEmpty():
        return written(plain.withColumn("node", F.col("least")), "classes"), None
    mine = some.join(split, "doc_id", "left_semi").select("doc_id", "f1", "f2", "n").distinct()
    made = plain.join(mine.select("f1", "f2", "n").distinct().withColumn("several", F.lit(True)), ["f1", "f2", "n"], "left")
    classes = written(made.withColumn("node", F.when(F.col("several"), F.xxhash64("f1", "f2", "n")).otherwise(F.col("least"))).drop("several"), "classes")
    return classes, written(mine.join(classes.select("f1", "f2", "n", "node"), ["f1", "f2", "n"]).select("doc_id", "node"), "several", few=True)


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, k: int = K) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs(doc_id, text, ...).

    Documents are linked if den * |intersection| >= num * |union| of their sets
    of word shingles (A-Z lower-cased).  component_id: the smallest doc_id
    reachable by links, kept: doc_id = component_id.

    Empty or null text: an empty set, linked with nothing.  Null doc_id: linked
    with nothing, component_id null, kept.  Rows that repeat a doc_id are one
    document, whose links are those of all its rows; each row returns.  An empty
    table gives an empty result; other columns are not read.
    """
    if num * 100 < 80 * den or k != K:
        raise ValueError("the bound on shared retained values holds for sketches of 32 values and from 0.8 on")
    threshold = num / den
    base = small_batches(docs.select("doc_id", "text"))
    sk = written(sketches(base, words, k), "sketches")
    classes, several = classes_of(sk)
    nodes = classes.select("node", "n", "sketch")
    lists = written(postings(nodes, threshold, k), "postings")
    texts = base.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("node"), "text")
    same = None
    if several is not None:
        ids = several.select("doc_id").distinct()
        again = sketches(base.join(ids, "doc_id", "left_semi"), words, k, with_text=True).join(classes.select("f1", "f2", "n", "node"), ["f1", "f2", "n"])
        texts = texts.join(ids.withColumnRenamed("doc_id", "node"), "node", "left_anti").unionByName(again.dropDuplicates(["node"]).select("node", "text"))
        same = several.withColumnRenamed("node", "a").join(several.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").select("a", "b")

    hubs = lists.groupBy("v").agg(F.min(F.struct("node", "n")).alias("hub"), F.count("*").alias("c")).where("c > 1").select("v", F.col("hub.node").alias("b"), F.col("hub.n").alias("bn"))
    star = lists.join(hubs, "v").where(F.col("node") != F.col("b")).where(near(F.col("n"), F.col("bn"), num, den)).select(F.col("node").alias("a"), "b").distinct()
    star = written(estimated(star, nodes, num, den, k), "star", few=True)
    early = lists.join(homes_of(star), "node").groupBy("v", "home").agg(F.count("*").alias("m"))
    early = early.groupBy("v").agg(F.max(F.struct("m", F.col("home").alias("b"))).alias("x")).select("v", F.col("x.b").alias("b"))
    again = lists.join(early, "v").select(F.col("node").alias("a"), "b").where("a <> b").distinct().join(star, ["a", "b"], "left_anti")
    star = written(star.unionByName(again.select("a", "b")), "star", few=True)
    homes = homes_of(star)
    at_home = star.join(homes.select(F.col("node").alias("a"), "home"), "a", "left").withColumn("wide", F.coalesce(F.col("home") == F.col("b"), F.lit(False)))
    tested = written(verified(at_home, texts, words, num, den), "tested")
    links = tested.where("link").select("a", "b")
    found = components(links if same is None else links.unionByName(same))

    marked = lists.join(found, "node", "left").join(homes, "node", "left")
    marked = marked.select("v", "node", "n", F.coalesce("component", "node").alias("c"), F.coalesce("home", F.lit(-1).cast("long")).alias("home"), F.col("home").isNull().alias("lone"))
    mixed = marked.groupBy("v", "home", "lone").agg(F.count("*").alias("m"), F.min("c").alias("c1"), F.max("c").alias("c2"))
    mixed = mixed.groupBy("v").agg(F.max(F.struct(~F.col("lone"), "m", "home")).alias("most"), F.min("c1").alias("c1"), F.max("c2").alias("c2")).where("c1 <> c2")
    open_ = written(marked.join(mixed.select("v", F.col("most.home").alias("main"), (~F.col("most.col1")).alias("no_main")), "v"), "open", few=True)
    if not open_.isEmpty():  # else each list lies in one component, and there is no further link to find
        open_ = open_.withColumn("inside", ~F.col("lone") & ~F.col("no_main") & (F.col("home") == F.col("main")))
        outside = open_.where("not inside").select("v", F.col("node").alias("a"), F.col("n").alias("an"), F.col("c").alias("ac"), F.col("home").alias("ah"), F.col("lone").alias("al"))
        other = open_.select("v", F.col("node").alias("b"), F.col("n").alias("bn"), F.col("c").alias("bc"), F.col("home").alias("bh"), F.col("lone").alias("bl"), "inside")
        cross = outside.join(other, "v").where("ac <> bc and (inside or a > b) and (al or bl or ah <> bh)").where(near(F.col("an"), F.col("bn"), num, den))
        cross = cross.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        cross = cross.unionByName(within_clouds(tested, found, num, den)).distinct()
        cross = cross.join(star.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti")
        cross = written(estimated(cross, nodes, num, den, k).withColumn("wide", F.lit(False)), "cross", few=True)
        more = verified(cross, texts, words, num, den).where("link").select("a", "b")
        # components of what was found so far, joined by the new links
        label = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"{c}_c"))
        more = more.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("a_c", "a").alias("a"), F.coalesce("b_c", "b").alias("b"))
        joined = components(more)
        up = joined.select(F.col("node").alias("component"), F.col("component").alias("top"))
        merged = found.join(up, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
        found = merged.unionByName(joined.join(found, "node", "left_anti").select("node", "component"))

    if several is not None:  # a component is named by its smallest doc_id, which need not be a node
        named = classes.select("node", "least").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        smallest = named.groupBy("component").agg(F.min("least").alias("smallest"))
        found = named.join(smallest, "component").select("node", F.col("smallest").alias("component"))
    copies = classes.where("copies > 1 or node <> least").select("f1", "f2", "n", "node")
    rows = sk.select("doc_id", "n", "f1", "f2").join(copies, ["f1", "f2", "n"], "left").withColumn("node", F.coalesce("node", "doc_id"))
    rows = rows.join(found, "node", "left")
    if several is not None:
        own = several.join(found, "node").select("doc_id", F.col("component").alias("own")).distinct()
        rows = rows.join(own, "doc_id", "left").withColumn("component", F.coalesce("own", "component"))
    rows = rows.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node")))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
