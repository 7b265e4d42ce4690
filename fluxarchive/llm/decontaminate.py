"""Benchmark decontamination over a distributed positional inverted index.

The index holds, for every term of the benchmark, its postings: lists of documents and positions, one list for each term and
shard of documents. List lengths rank the terms by the whole corpus. Each window of a benchmark item is asked for by its
rarest terms: their lists are joined by term and moved by the term's offset in the item, and where the lists of a window
meet on one diagonal, document and item may agree. There the phrase is compared word by word. Where lists meet within a
band of diagonals the passage is near. Neither items nor words of the benchmark pass through the driver, but for a bitmap
of bounded size that tells which words are worth a posting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, fresh, materialise, merge_join, spread, table

WINDOW = 10
#: Each possible window holds at least so many anchors, or all its words; the lists of two are intersected.
ANCHORS = 2
WORD_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes 0-9, a-z and those of other characters stand, A-Z become a-z, all else divides words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Windows of an item that are asked for together; a longer item is several chunks, which overlap by a window.
CHUNK = 4096
#: Bits of the bitmap for each term of the benchmark, and at most. Words that pass by chance cost a posting and match nothing.
BITS_A_TERM, MAX_BITS = 64, 1 << 27
SLOP = 6
#: Share of a chunk's anchors that stand near each other in a near passage.
NEAR_SHARE = 0.6
WORDS_HELD = 1_000_000


def tokens(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD_CLASS), F.lit(0))


def term_id(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - 2**63


def chunks_of(benchmark: DataFrame, window: int) -> DataFrame:
    """chunk (long), item_id (string), size (words of its windows), terms: items with words and an id, repeated rows once, cut
    into chunks so that each window lies in one."""
    known = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = [term_id(w) for w in tokens(text)]
                size = min(window, len(found))
                starts = range(0, len(found) - size + 1, CHUNK) if found else []
                for s in starts:
                    key = xxhash.xxh3_64_intdigest(repr((item, text, s)).encode("utf-8", "surrogatepass")) - 2**63
                    columns = pa.array([key], pa.int64()), pa.array([item], pa.string()), pa.array([size], pa.int32()), pa.array([found[s : s + CHUNK + size - 1]], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays(list(columns), ["chunk", "item_id", "size", "terms"])

    return known.mapInArrow(run, "chunk bigint, item_id string, size int, terms array<bigint>")


def bitmap(chunks: DataFrame) -> tuple[np.ndarray, int]:
    """Bits of the benchmark's terms, and their number less one: a power of two that follows the number of terms, 16 MB at
    most whatever the benchmark. The driver gets words of 64 bits, no more than the bitmap has."""
    terms = chunks.select(F.explode("terms").alias("term")).distinct()
    n = 1 << max(10, min(MAX_BITS.bit_length() - 1, (terms.count() * BITS_A_TERM).bit_length()))
    bit = F.col("term").bitwiseAND(F.lit(n - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.bitwiseAND(F.lit(63)).cast("int"))
    found = terms.groupBy(F.shiftright(bit, 6).alias("w")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(n // 64, np.int64)
    out[found["w"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint8), n - 1


def build_index(docs: DataFrame, filled: np.ndarray, mask: int) -> DataFrame:
    """Two kinds of rows. For each document: doc (hash of id and text), doc_id, text_hash, n_words. For each term of a shard
    (an Arrow batch of documents): term, docs and pos, its postings in the order of documents and positions."""
    sent = docs.sparkSession.sparkContext.broadcast((filled, mask))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled, mask = sent.value
        listed = lambda i: filled[(i & mask) >> 3] >> (i & 7) & 1
        seen: dict[bytes, int] = {}
        names = ["doc", "doc_id", "text_hash", "n_words", "term", "docs", "pos"]
        for b in batches:
            n, terms, pos = [], [], []
            for t in b.column(3):  # one text at a time in Python
                found = tokens(t.as_py())
                for w in set(found):
                    if w not in seen:
                        i = term_id(w)
                        seen[w] = i if listed(i) else 0
                ids = np.fromiter(map(seen.__getitem__, found), np.int64, len(found))
                at = np.flatnonzero(ids)
                n.append(len(found))
                terms.append(ids[at])
                pos.append(at.astype(np.int32))
                if len(seen) > WORDS_HELD:
                    seen.clear()
            k = len(n)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.list_(pa.int64())), pa.nulls(k, pa.list_(pa.int32()))], names
            )
            if not k or not sum(map(len, terms)):
                continue
            every, of = np.concatenate(terms), np.repeat(np.arange(k), [len(x) for x in terms])
            order = np.argsort(every, kind="stable")
            every = every[order]
            starts = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
            offsets = pa.array(np.r_[starts, len(every)].astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, b.column(0).take(pa.array(of[order]))), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(pos)[order]))
            m = len(starts)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(every[starts]), *lists], names)

    return spread(named(docs)).mapInArrow(run, "doc bigint, doc_id bigint, text_hash bigint, n_words bigint, term bigint, docs array<bigint>, pos array<int>")


def named(docs: DataFrame) -> DataFrame:
    """doc, doc_id, text_hash, text. Rows of one id and text share doc: their results are the same."""
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.select(F.xxhash64("doc_id", "text").alias("doc"), "doc_id", F.xxhash64("text").alias("text_hash"), "text")


def choose_anchors(counts: list[int], size: int, each: int = ANCHORS) -> list[int]:
    """Positions so that each window of `size` words without a count of 0 holds its `each` rarest ones, as far as windows can
    share them. One pass."""
    missing = [i for i, c in enumerate(counts) if not c]
    chosen: list[int] = []
    active: list[int] = []  # chosen ones that the window still holds
    at = 0
    for s in range(len(counts) - size + 1):
        while at < len(missing) and missing[at] < s:
            at += 1
        if at < len(missing) and missing[at] < s + size:
            continue  # a word that the corpus lacks
        active = [i for i in active if i >= s]
        lacks = min(each, size) - len(active)
        if lacks > 0:
            found = sorted((i for i in range(s, s + size) if i not in active), key=lambda i: (counts[i], -i))[:lacks]
            active += found
            chosen += found
    return sorted(set(chosen))


def with_anchors(chunks: DataFrame, lists: DataFrame) -> DataFrame:
    """chunk, off, term, size, n_anchors: the positions that stand for each chunk's windows, by the lengths of the lists."""
    counts = lists.groupBy("term").agg(F.sum(F.size("pos")).alias("n"))
    terms = merge_join(chunks.select("chunk", "size", F.posexplode("terms").alias("off", "term")), counts, "term", "left")

    def choose(t: pa.Table) -> pa.Table:
        t = t.sort_by("off")  # a chunk's words
        size, terms = t.column("size")[0].as_py(), t.column("term").to_pylist()
        at = choose_anchors([n or 0 for n in t.column("n").to_pylist()], size)
        k = len(at)
        columns = t.column("chunk").to_pylist()[:k], at, [terms[i] for i in at], [size] * k, [k] * k
        kinds = pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()
        return pa.table({name: pa.array(c, kind) for name, c, kind in zip(("chunk", "off", "term", "size", "n_anchors"), columns, kinds, strict=True)})

    return terms.groupBy("chunk").applyInArrow(choose, "chunk bigint, off int, term bigint, size int, n_anchors int")


def intersected(met: DataFrame) -> DataFrame:
    """chunk, doc, diagonal, lo, hi: where two anchors of a window, next to each other on a diagonal, both stand in the
    document; lo and hi bound the windows that hold both. A diagonal has at most a chunk's anchors."""
    before = F.lag("off").over(W.partitionBy("chunk", "doc", "diagonal").orderBy("off"))
    before = F.when(F.col("size") == 1, F.col("off")).otherwise(before)
    near = met.withColumn("before", before).where(F.col("off") - F.col("before") < F.col("size"))
    return near.select("chunk", "doc", "diagonal", F.greatest(F.lit(0), F.col("off") - F.col("size") + 1).alias("lo"), (F.col("before") + F.col("size")).alias("hi"))


def runs(item: np.ndarray, said: np.ndarray, at: int, size: int) -> list[tuple[int, int]]:
    """Stretches [start, end) of the document on which it agrees with the item, laid at this place, for a window at least."""
    lo, hi = max(0, -at), min(len(item), len(said) - at)
    if hi - lo < size:
        return []
    same = np.r_[False, item[lo:hi] == said[lo + at : hi + at], False]
    turns = np.flatnonzero(same[1:] != same[:-1])
    return [(lo + at + a, lo + at + e) for a, e in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True) if e - a >= size]


def confirmed(candidates: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """candidates: chunk, doc, diagonal, lo, hi. doc, n_hit, item_ids (sorted): phrases compared on the texts of the documents."""
    phrase = F.slice("terms", F.col("lo") + 1, F.col("hi") - F.col("lo"))
    asked = candidates.join(chunks.select("chunk", "item_id", "size", "terms"), "chunk").select("doc", F.struct((F.col("diagonal") + F.col("lo")).alias("at"), "item_id", "size", phrase.alias("phrase")).alias("x"))
    asked = asked.groupBy("doc").agg(F.collect_list("x").alias("asked"))  # of one document: no more than its words have anchors
    texts = named(docs).select("doc", "text").join(candidates.select("doc").distinct(), "doc").groupBy("doc").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits, names = [], []
            for t, asked in zip(b.column(1), b.column(2), strict=True):
                ids: dict[bytes, int] = {}
                said = np.array([ids[w] if w in ids else ids.setdefault(w, term_id(w)) for w in tokens(t.as_py())], np.int64)
                hit, held = np.zeros(len(said), bool), set()
                for x in asked:  # one candidate at a time in Python
                    for s, e in runs(x["phrase"].values.to_numpy(), said, x["at"].as_py(), x["size"].as_py()):
                        hit[s:e] = True
                        held.add(x["item_id"].as_py())
                hits.append(int(hit.sum()))
                names.append(sorted(held))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hits, pa.int64()), pa.array(names, pa.list_(pa.string()))], ["doc", "n_hit", "item_ids"])

    return merge_join(texts, asked, "doc").select("doc", "text", "asked").mapInArrow(run, "doc bigint, n_hit bigint, item_ids array<string>")


class Index:
    """The stored index of docs for one benchmark: documents, lists, chunks, anchors, and meetings of anchors and documents."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW):
        self.docs = docs
        self.scratch = Scratch(docs.sparkSession, "decontaminate")
        self.chunks = self.scratch.write(chunks_of(benchmark, window), "chunks")
        rows = self.scratch.write(build_index(docs, *bitmap(self.chunks)), "index")
        self.documents = rows.where("term is null").select("doc", "doc_id", "text_hash", "n_words")
        self.lists = rows.where("term is not null").select("term", "docs", "pos")
        self.anchors = self.scratch.write(with_anchors(self.chunks, self.lists), "anchors")
        # Spark broadcasts the anchors if their size allows it, else both sides go by term and large lists are split.
        met = self.lists.join(self.anchors, "term").select("chunk", "off", "size", "n_anchors", F.explode(F.arrays_zip("docs", "pos")).alias("p"))
        self.met = self.scratch.write(met.select("chunk", "off", "size", "n_anchors", F.col("p.docs").alias("doc"), (F.col("p.pos") - F.col("off")).alias("diagonal")), "meetings")

    def phrases(self) -> DataFrame:
        """doc_id, text_hash, n_words, n_hit, item_ids (sorted strings) of every row of docs."""
        candidates = self.scratch.write(intersected(self.met), "candidates")
        found = self.scratch.write(confirmed(candidates, self.chunks, self.docs), "phrases")
        out = self.documents.join(found, "doc", "left")
        return out.select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))

    def near(self, slop: int = SLOP) -> DataFrame:
        """doc_id, text_hash, item_id, n_near: inexact passages, by the number of a chunk's anchors whose diagonals lie in a
        band of twice slop (bands overlap by half): the words stand within slop of their places relative to each other. At
        least NEAR_SHARE of the chunk's anchors, and more than a window needs, or all of them, must."""
        band = F.floor(F.col("diagonal") / slop)
        rows = self.met.select("chunk", "doc", "off", F.least(F.lit(ANCHORS), "size").alias("need"), "n_anchors", F.explode(F.array(band, band + 1)).alias("band")).distinct()
        counted = rows.groupBy("chunk", "doc", "band").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need"), F.first("n_anchors").alias("n_anchors"))
        enough = counted.where(F.col("n") >= F.greatest(F.least(F.col("need") + 1, "n_anchors"), F.ceil(F.col("n_anchors") * NEAR_SHARE)))
        best = enough.join(self.chunks.select("chunk", "item_id"), "chunk").groupBy("doc", "item_id").agg(F.max("n").alias("n_near"))
        return self.documents.join(best, "doc").select("doc_id", "text_hash", "item_id", "n_near")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), n_words, n_hit, item_ids (sorted strings), one row per row of docs.

    Null and empty texts have no words; items that are null, without words or without an id match nothing; repeated
    documents and ids are judged row by row, repeated items once; texts and items of any length are read whole; an empty
    table of documents gives an empty result, an empty benchmark no hits; extra columns are not carried.
    """
    index = Index(docs, benchmark, window)
    out = materialise(index.phrases(), "contamination")
    index.scratch.clear()
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs in which no window of the benchmark occurs, with their columns; see contamination()."""
    d, h = fresh(docs, "__d"), fresh(docs, "__h")
    bad = materialise(contamination(docs, benchmark, window).where("n_hit > 0").select(F.col("doc_id").alias(d), F.col("text_hash").alias(h)).distinct(), "contaminated")
    same = (F.xxhash64(docs["text"]) == F.col(h)) & docs["doc_id"].cast("bigint").eqNullSafe(F.col(d))
    return docs.join(bad, same, "left_anti")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def benchmark_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inexact passages of the benchmark in all documents."""
    return Index(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).near().drop("text_hash")


OP9_SQL = r"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') t from documents),
i as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') t from benchmark),
iw as (select distinct item_id, least(10, len(t)) n, array_to_string(t[s:s + least(10, len(t)) - 1], ' ') win
       from i, unnest(range(1, greatest(1, len(t) - 8))) x(s) where len(t) > 0),
dw as (select doc_id, s, n, array_to_string(t[s:s + n - 1], ' ') win from w, (select distinct n from iw) z, unnest(range(1, greatest(1, len(t) - n + 2))) x(s) where len(t) >= n),
h as (select doc_id, s, n, item_id from dw join iw using (n, win)),
hit as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(s, s + n)) p from h) group by doc_id),
ids as (select doc_id, count(*) n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) l from (select distinct doc_id, item_id from h) group by doc_id)
select w.doc_id, len(t)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(l, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from w left join hit using (doc_id) left join ids using (doc_id)
"""
