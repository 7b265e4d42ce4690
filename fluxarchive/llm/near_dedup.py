"""Near-duplicate documents by SetSketch registers.

Each distinct set of word shingles gets M registers of exponentially spaced, truncated minima (base B, rate A). Registers
are mergeable and locality-sensitive: bands of R equal registers bring likely pairs together. A band's members are held
against its least member only; the likelihood of the registers' order estimates the joint similarity, and exact counts on
the full sets verify it. Members unlike their centre go on to a next centre, so that each link lies inside the canopy of
some centre. Canopies that still hold several components are compared in blocks, by exact intersection counts of
block pairs, which return a spanning forest of the links and no list of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, materialise, merge_join, split_join, spread, table
from .components import components

BANDS, ROWS = 32, 5
M = BANDS * ROWS
#: SetSketch parameters: base, rate and the greatest register.
B, A, TOP = 1.001, 20.0, 2**16 - 2
#: Percent of the union that a link shares.
PERCENT = 80
#: Estimates are trusted within this many standard deviations.
SIGMAS = 4.5
#: Members at least so similar to a centre need no other centre; see canopies().
INNER = 0.6
BLOCK = 256
#: Bands of at most so many nodes end inside a task, and rows that a task takes of them.
SMALL_BAND, TASK_ROWS = 512, 20_000
#: Shingles that are hashed M ways at a time.
CHUNK = 512
MAX_ROUNDS = 200
#: Hashes of words that a task remembers.
WORDS_HELD = 200_000
_ODD = np.random.default_rng(20240501).integers(1, 2**63, size=M, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Words(dict):
    """Hashes of words seen, emptied when full."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > WORDS_HELD:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int, seen: _Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of the lower-cased (A-Z) text; a shorter text is one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
    n = min(k, len(h))
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
    return np.unique(_mixed(out + np.uint64(n)))


def registers(s: np.ndarray, held: np.ndarray) -> np.ndarray:
    """M registers: floor(1 - log_B(least exponential variate)), held to 0 ... TOP + 1. The greater one of two sketches'
    registers is the sketch of the union. held: a buffer of M x CHUNK."""
    least = np.full(M, 2**64 - 1, np.uint64)
    for at in range(0, len(s), CHUNK):
        part = s[at : at + CHUNK]
        product = held[:, : len(part)]
        np.multiply(part, _ODD[:, None], out=product)
        np.minimum(least, product.min(axis=1), out=least)
    x = -np.log1p(-((least >> np.uint64(11)) + 0.5) / 2.0**53) / A
    return np.clip(np.floor(1 - np.log(x) / np.log(B)), 0, TOP + 1).astype(np.uint16)


def estimate(more: np.ndarray, less: np.ndarray, nu: np.ndarray, nv: np.ndarray) -> np.ndarray:
    """Maximum likelihood of the Jaccard similarity, given how many registers of u are above (more) or below (less) those of
    v and the sizes of both sets. The likelihood is concave: golden-section search, all pairs at once."""
    u, v = nu / (nu + nv), nv / (nu + nv)
    equal = M - more - less

    def likelihood(j: np.ndarray) -> np.ndarray:
        above = -np.log1p(-np.maximum(u - v * j, 1e-12) * (B - 1) / B) / np.log(B)
        below = -np.log1p(-np.maximum(v - u * j, 1e-12) * (B - 1) / B) / np.log(B)
        return more * np.log(above) + less * np.log(below) + equal * np.log(np.maximum(1 - above - below, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    g = (5**0.5 - 1) / 2
    for _ in range(24):
        a, b = high - g * (high - low), low + g * (high - low)
        left = likelihood(a) > likelihood(b)
        high, low = np.where(left, b, high), np.where(left, low, a)
    return (low + high) / 2


def _named(s: np.ndarray) -> int:
    """Name of a set: 64 bits of a hash of its shingles."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n, node (name of the set), sketch, bands (hash of each band); sketch and bands are empty for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = _Words(), np.empty((M, CHUNK), np.uint64)
        for b in batches:
            n, node, sketch, bands = [], [], [], []
            for t in b.column(1):  # one text at a time in Python
                s = shingles(t.as_py(), k, seen)
                n.append(len(s))
                node.append(_named(s))
                if not len(s):
                    sketch.append(b"")
                    bands.append([])
                    continue
                r = registers(s, held)
                sketch.append(r.tobytes())
                bands.append([xxhash.xxh3_64_intdigest(r[i * ROWS : i * ROWS + ROWS].tobytes(), i) - 2**63 for i in range(BANDS)])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(sketch, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "n", "node", "sketch", "bands"],
            )

    return spread(docs).mapInArrow(run, "doc_id bigint, n bigint, node bigint, sketch binary, bands array<bigint>")


def _estimated(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """pairs: c, x. Adds nc, nx and est, from the sketches of both."""
    a = known.select(F.col("node").alias("c"), F.col("n").alias("nc"), F.col("sketch").alias("sc"))
    b = known.select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("sketch").alias("sx"))

    @F.pandas_udf("double")
    def est(sc: pd.Series, sx: pd.Series, nc: pd.Series, nx: pd.Series) -> pd.Series:
        if not len(sc):
            return pd.Series([], dtype=float)
        u = np.frombuffer(b"".join(sc), np.uint16).reshape(len(sc), M)
        v = np.frombuffer(b"".join(sx), np.uint16).reshape(len(sx), M)
        return pd.Series(estimate((u > v).sum(axis=1), (u < v).sum(axis=1), nc.to_numpy(float), nx.to_numpy(float)))

    joined = merge_join(merge_join(pairs, a, "c"), b, "x")
    return joined.withColumn("est", est("sc", "sx", "nc", "nx")).drop("sc", "sx")


def _rest(rows: DataFrame, known: DataFrame) -> DataFrame:
    """c, x of bands of at most SMALL_BAND nodes, centre by centre inside a task. A task holds about TASK_ROWS rows of many
    bands; likeness to a centre is the share of equal registers."""
    parts = max(1, -(-rows.count() // TASK_ROWS))
    dealt = merge_join(rows, known.select("node", "sketch"), "node").withColumn("part", F.pmod(F.xxhash64("band"), F.lit(parts)))

    def run(t: pa.Table) -> pa.Table:
        nodes, node = np.unique(t.column("node").to_numpy(), return_inverse=True)
        band = t.column("band").to_numpy()
        order = np.lexsort((node, band))
        band, node = band[order], node[order]
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint16).reshape(len(order), M)[order]
        starts = np.flatnonzero(np.r_[True, band[1:] != band[:-1]])
        found, held, n_held = np.empty(0, np.int64), [], 0  # pairs as c * n + x
        for lo, hi in zip(starts, np.r_[starts[1:], len(band)], strict=True):
            left = np.arange(lo, hi)
            while len(left) > 1:
                c, left = left[0], left[1:]
                far = (sketch[left] == sketch[c]).mean(axis=1) < INNER
                if not far.all():  # else nothing ends here: all go on together, and none can be linked to this centre
                    held.append(node[c] * len(nodes) + node[left])
                    n_held += len(left)
                left = left[far]
            if n_held > 500_000:
                found, held, n_held = np.unique(np.concatenate([found, *held])), [], 0
        found = np.unique(np.concatenate([found, *held]))
        return pa.table({"c": pa.array(nodes[found // len(nodes)], pa.int64()), "x": pa.array(nodes[found % len(nodes)], pa.int64())})

    return dealt.groupBy("part").applyInArrow(run, "c bigint, x bigint")


def canopies(rows: DataFrame, known: DataFrame, scratch: Scratch) -> DataFrame:
    """rows: band, node, of bands with several nodes. Returns c, x, nc, nx, est: every node x that shares a band with centre c.

    In each band the least node is the centre; nodes estimated INNER or more alike are done with this band, the others
    choose again among themselves. Two nodes of a band are together in a canopy: that of the first centre that took one.
    The first round and those of bands over SMALL_BAND nodes are joins; what is left of small bands ends inside tasks.
    """
    parts = []
    for i in range(MAX_ROUNDS):
        centres = rows.groupBy("band").agg(F.min("node").alias("c"), F.max("node").alias("last")).where("c <> last").select("band", "c")
        met = split_join(rows, centres, "band").where("node <> c").withColumnRenamed("node", "x")
        pairs = scratch.write(_estimated(met.select("c", "x").distinct(), known), f"canopy{i}").select("c", "x", "nc", "nx", "est")
        parts.append(pairs)
        far = pairs.where(F.col("est") < INNER).select("c", "x")
        rows = merge_join(met, far, ["c", "x"], "left_semi").select("band", F.col("x").alias("node"))
        several = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        rows = scratch.write(split_join(rows, several, "band"), f"band-rest{i}")
        large = rows.agg(F.max("n")).first()[0]
        if large is None:
            break
        if large <= SMALL_BAND:
            parts.append(scratch.write(_estimated(_rest(rows, known).distinct(), known), "canopy-rest").select("c", "x", "nc", "nx", "est"))
            break
        rows = rows.drop("n")
    else:
        raise RuntimeError("canopies did not settle")
    return reduce(DataFrame.unionAll, parts).groupBy("c", "x").agg(F.max("est").alias("est"), F.first("nc").alias("nc"), F.first("nx").alias("nx"))


def forest(a: list[np.ndarray], b: list[np.ndarray] | None, ids_a: list[int], ids_b: list[int], percent: int) -> list[tuple[int, int]]:
    """Links between sets of a and b (inside a where b is None) that join what no earlier one joined. Intersections are
    counted exactly, as products of membership matrices over some thousand shingles at a time."""
    every = a + (b or [])
    ids = ids_a + ids_b
    sizes = np.array([len(s) for s in every], np.int64)
    values, inverse = np.unique(np.concatenate(every), return_inverse=True)
    shared = np.bincount(inverse)[inverse] > 1
    column = np.cumsum(np.bincount(inverse, minlength=len(values)) > 1) - 1
    row = np.repeat(np.arange(len(every)), sizes)[shared]
    col = column[inverse][shared]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    na = len(a)
    rights = slice(na, None) if b is not None else slice(0, na)
    both = np.zeros((na, len(every) - na if b is not None else na), np.float64)
    width = 8192
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        lo, hi = np.searchsorted(col, [at, at + width])
        m = np.zeros((len(every), width), np.float32)
        m[row[lo:hi], col[lo:hi] - at] = 1
        both += m[:na] @ m[rights].T
    sa, sb = sizes[:na, None], sizes[rights][None, :]
    i, j = np.nonzero(100 * both >= percent * (sa + sb - both))
    parent = list(range(len(every)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for p, q in zip(i.tolist(), (j + (na if b is not None else 0)).tolist(), strict=True):
        if p != q and (x := root(p)) != (y := root(q)):
            parent[x] = y
            out.append((ids[p], ids[q]))
    return out


def _sets(docs: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """node, s (sorted shingle hashes as bytes), of one document of each node (first: doc_id, node): the set's name must agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Words()
        for b in batches:
            kept, out = [], []
            for i, (t, node) in enumerate(zip(b.column(0), b.column(1), strict=True)):
                s = shingles(t.as_py(), k, seen)
                if _named(s) == node.as_py():
                    kept.append(i)
                    out.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(kept, pa.int64())), pa.array(out, pa.binary())], ["node", "s"])

    found = merge_join(docs, first, "doc_id").select("text", "node")
    return spread(found).mapInArrow(run, "node bigint, s binary").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """u, v: pairs (c, x) whose sets share at least percent of their union, counted exactly."""
    joined = merge_join(merge_join(pairs, sets.select(F.col("node").alias("c"), F.col("s").alias("a")), "c"), sets.select(F.col("node").alias("x"), F.col("s").alias("b")), "x")

    @F.arrow_udf("boolean")
    def linked(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b, strict=True):
            p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(100 * both >= percent * (len(p) + len(q) - both))
        return pa.array(out, pa.bool_())

    return joined.where(linked("a", "b")).select(F.col("c").alias("u"), F.col("x").alias("v"))


def _blocks(canopy: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """u, v: spanning forests of the links inside canopies (c, x, main, n_main, n_other), by pairs of blocks. Blocks of nodes
    already joined to their centre (main) are not held against each other."""
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / BLOCK)).cast("int")
    nm, no = blocks("n_main"), blocks("n_other")
    h = F.xxhash64("c", "x")
    own = F.when(F.col("main"), F.pmod(h, nm)).otherwise(nm + F.pmod(h, no)).cast("int")
    # Others meet every block, mains only the others' blocks.
    partner = F.when(F.col("main"), F.sequence(nm, nm + no - 1)).otherwise(F.sequence(F.lit(0), nm + no - 1))
    met = canopy.withColumn("own", own).withColumn("partner", F.explode(partner)).select(
        "c", F.least("own", "partner").alias("i"), F.greatest("own", "partner").alias("j"), F.col("own"), F.col("x").alias("node")
    )
    joined = merge_join(met, sets, "node").select("c", "i", "j", "own", "node", "s")

    def run(t: pa.Table) -> pa.Table:
        i, own, nodes, s = (t.column(c).to_pylist() for c in ("i", "own", "node", "s"))
        left = [k for k in range(len(own)) if own[k] == i[k]]
        right = [k for k in range(len(own)) if own[k] != i[k]]
        arrays = [np.frombuffer(x, np.uint64) for x in s]
        same = t.column("j")[0].as_py() == i[0]
        if not left or not same and not right:
            links = []
        else:
            links = forest([arrays[k] for k in left], None if same else [arrays[k] for k in right], [nodes[k] for k in left], [nodes[k] for k in right], percent)
        return pa.table({"u": pa.array([p for p, _ in links], pa.int64()), "v": pa.array([q for _, q in links], pa.int64())})

    return joined.groupBy("c", "i", "j").applyInArrow(run, "u bigint, v bigint")


def _undecided(shapes: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """c, x, main, n_main, n_other of canopies (their centres included) whose members can still be linked: two components or
    more and two members beside the centre. main: of the centre's component. Counts are written before they are joined
    to the rows, so that the rows of a large canopy can be split."""
    label = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    placed = shapes.select("c", "x").unionAll(shapes.select("c", F.col("c").alias("x")).distinct())
    placed = merge_join(merge_join(placed, label("x"), "x", "left"), label("c"), "c", "left")
    main = F.coalesce("of_x", "x") == F.coalesce("of_c", "c")
    placed = scratch.write(placed.select("c", "x", main.alias("main")), "placed")
    counts = placed.groupBy("c").agg(F.count_if("main").alias("n_main"), F.count_if(~F.col("main")).alias("n_other"))
    counts = scratch.write(counts.where("n_other > 0 and n_main + n_other >= 3"), "open-canopies")
    return merge_join(placed, counts, "c")


def near_duplicates(docs: DataFrame, shingle_words: int = 4, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text).

    Documents of the same set of shingles are one node, named by 64 bits of a hash of the set (of ten thousand million
    different sets, two or three pairs would share a name). Rows that share a doc_id are one document, whatever their texts:
    all their nodes are linked with each other. Null and empty texts, and texts of white space, have an empty set and are
    linked with nothing. A null doc_id takes no part: its component_id is null and it is kept. Texts of any length are read
    whole; an empty table gives an empty result. Extra columns are not carried. Ties do not arise: components and their
    smallest ids do not depend on order. A link is missed only if no band agrees, at 80 % with a chance of 3 in a million, or
    if no other member of its canopy is compared and the estimate is SIGMAS deviations off, which is as rare.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = scratch.write(sketches(slim, shingle_words), "sketches")
    live = sketched.where("doc_id is not null and n > 0")
    # Sets: copies collapse before anything is compared.
    classes = scratch.write(live.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")), "set-classes")
    rows = classes.select("node", F.explode("bands").alias("band"))
    several = rows.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("band")
    rows = scratch.write(split_join(rows, several, "band", "left_semi"), "bands")
    known = scratch.write(merge_join(classes.select("node", "n", "sketch", "doc_id"), rows.select("node").distinct(), "node", "left_semi"), "band-nodes")
    shapes = scratch.write(canopies(rows, known, scratch), "canopies")
    sets = scratch.write(_sets(slim, known.select("doc_id", "node"), shingle_words), "sets")
    j = percent / 100
    trusted = j - SIGMAS * (j * (1 - j) / M) ** 0.5
    fits = F.least("nc", "nx") * 100 >= F.greatest("nc", "nx") * percent
    links = scratch.write(_verified(shapes.where(fits & (F.col("est") >= trusted)).select("c", "x"), sets, percent), "links")
    labels = scratch.write(components(links, scratch), "labels")
    # Pairs with the centre are decided; a canopy with two undecided components goes on.
    more = scratch.write(_blocks(_undecided(shapes, labels, scratch), sets, percent), "block-links")
    by_id = live.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("doc_id", "a")
    crossing = merge_join(live.select("doc_id", F.col("node").alias("u")), by_id, "doc_id").select("u", F.col("a").alias("v"))
    whole = components(labels.select(F.col("node").alias("u"), F.col("component").alias("v")).unionAll(more).unionAll(crossing), scratch)
    joined = scratch.write(merge_join(whole, classes.select("node", "doc_id"), "node"), "joined")
    least = scratch.write(joined.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component-ids")
    joined = merge_join(joined, least, "component").select("node", "component_id")
    named = scratch.write(merge_join(classes.select("node", "doc_id"), joined, "node", "left").select("node", F.coalesce("component_id", "doc_id").alias("component_id")), "named")
    out = merge_join(sketched.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("node")).alias("node")), named, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    # A repeated id can stand once with a text and once without: its component is then that of its texts.
    out = materialise(out.select("doc_id", "n_shingles", component.alias("component_id")), "near-duplicates")
    scratch.clear()
    return _one_component(out)


def _one_component(out: DataFrame) -> DataFrame:
    own = out.where("doc_id is not null and component_id <> doc_id").groupBy("doc_id").agg(F.min("component_id").alias("__c"))
    # Only ids that stand with an empty set need it; all other rows of an id agree.
    empty = out.where("n_shingles = 0 and doc_id is not null").select("doc_id").distinct()
    mended = merge_join(out, merge_join(own, empty, "doc_id"), "doc_id", "left")
    component = F.coalesce("__c", "component_id")
    return mended.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, shingle_words: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that are kept, with their columns: of each component the document with the smallest id. Rows that
    repeat a kept id stay together; see near_duplicates() for the defined results."""
    gone = near_duplicates(docs, shingle_words, percent).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') t from documents),
s as (select distinct doc_id, array_to_string(t[i:i + least(4, len(t)) - 1], ' ') sh from w, unnest(range(1, greatest(1, len(t) - 3) + 1)) x(i) where len(t) > 0),
n as (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id u, b.doc_id v from s a join s b using (sh) where a.doc_id <> b.doc_id group by 1, 2
      having 100 * count(*) >= 80 * ((select n from n where doc_id = a.doc_id) + (select n from n where doc_id = b.doc_id) - count(*))),
r(doc_id, c) as (select doc_id, doc_id from w union select p.v, r.c from r join p on r.doc_id = p.u),
m as (select doc_id, min(c) c from r group by doc_id)
select w.doc_id, coalesce(n.n, 0)::bigint n_shingles, m.c component_id, w.doc_id = m.c kept from w join m using (doc_id) left join n using (doc_id)
"""
