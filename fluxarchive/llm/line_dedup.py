"""Near-duplicate lines by a deletion-neighbourhood join (native: DataFrame and SQL functions only).

Two lines are duplicates if one edit of a character (insertion, deletion or substitution) or none turns one into the
other. A line is dropped if any earlier line, by doc_id and line number, is its duplicate.

All deletion variants of all lines would be as many rows as the corpus has characters. A single edit leaves all but one
part of a line as it is, so lines are first held against each other with one part left out (halves, then eighths, both
exact for one edit); only lines that agree so emit the deletion variants, and only of the part that was left out.
Variants carry the position of the deletion: equal ones are one substitution apart. A line that equals a variant of a
longer one is one insertion apart. The distance of each decision is verified on the texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialise, table

#: Shorter lines (code points) are duplicates only of equal ones.
MIN_CHARS = 24
EIGHTHS = 8


def _parts(line: Column, size: Column, m: int, j: int, short: Column) -> tuple[Column, Column, Column]:
    """What stands left of, in and right of part j of m, where `short` is the length of the shorter line of a pair."""
    left = F.floor(short * j / m).cast("int")
    right = (short - F.floor(short * (j + 1) / m)).cast("int")
    return F.substring(line, F.lit(1), left), F.substring(line, left + 1, size - left - right), F.substring(line, size - right + 1, right)


def _outer_keys(line: Column, size: Column, m: int) -> Column:
    """array of (key, part, longer): hashes of the line without each part, as the shorter and as the longer of a pair."""
    out = []
    for longer in (0, 1):
        short = size - longer
        for j in range(m):
            a, _, b = _parts(line, size, m, j, short)
            out.append(F.struct(F.xxhash64(a, b, short, F.lit(j), F.lit(m)).alias("key"), F.lit(j).alias("part"), F.lit(longer).alias("longer")))
    return F.array(*out)


def _half_keys(line: Column, size: Column) -> Column:
    """Hashes of either half of the line, as the shorter and as the longer of a pair: plain substrings, no lambda, so that the
    pass over the corpus is generated code."""
    out = []
    for longer in (0, 1):
        short = size - longer
        left = F.floor(short / 2).cast("int")
        out += [F.xxhash64(F.substring(line, F.lit(1), left), short, F.lit(1)), F.xxhash64(F.substring(line, left + 1 + longer, short - left), short, F.lit(0))]
    return F.array(*out)


def _shared(rows: DataFrame) -> DataFrame:
    """rows: key, line_key. Those whose key belongs to two different lines or more."""
    keys = rows.groupBy("key").agg(F.min("line_key").alias("a"), F.max("line_key").alias("b")).where("a <> b").select("key")
    return rows.join(keys, "key")


def near_lines(lines: DataFrame, first: DataFrame, occurrences: DataFrame) -> DataFrame:
    """lines: line_key, line of eligible lines; first: line_key, first (position), distinct; occurrences: line_key, halves.
    Returns line_key, near: the earliest position of a line one edit away, verified."""
    halves = occurrences.where("halves is not null").select("line_key", F.explode("halves").alias("key"))
    likely = materialise(_shared(halves).select("line_key").distinct(), "half-lines")
    candidates = lines.join(likely, "line_key").groupBy("line_key").agg(F.min("line").alias("line"))
    candidates = materialise(candidates.join(first, "line_key").withColumn("size", F.length("line")), "near-candidates")
    eighths = candidates.select("line_key", F.explode(_outer_keys(F.col("line"), F.col("size"), EIGHTHS)).alias("o")).select("line_key", "o.*")
    agreed = _shared(eighths).join(candidates, "line_key")
    inner = reduce(lambda out, j: F.when(F.col("part") == j, _parts(F.col("line"), F.col("size"), EIGHTHS, j, F.col("size") - F.col("longer"))[1]).otherwise(out), range(EIGHTHS), F.lit(None).cast("string"))
    agreed = agreed.withColumn("inner", inner)
    places = F.when(F.length("inner") > 0, F.sequence(F.lit(1), F.length("inner"))).otherwise(F.array().cast("array<int>"))
    variant = lambda i: F.concat(F.substring(F.col("inner"), F.lit(1), i - 1), F.substring(F.col("inner"), i + 1, F.length("inner")))
    deletions = F.transform(
        places,
        lambda i: F.struct(
            F.when(F.col("longer") == 1, F.xxhash64("key", F.lit("inserted"), variant(i))).otherwise(F.xxhash64("key", i, variant(i))).alias("variant"),
            F.when(F.col("longer") == 1, F.lit("long")).otherwise(F.lit("same")).alias("role"),
        ),
    )
    itself = F.when(F.col("longer") == 0, F.array(F.struct(F.xxhash64("key", F.lit("inserted"), F.col("inner")).alias("variant"), F.lit("short").alias("role"))))
    emitted = agreed.select("line_key", "first", F.explode(F.concat(deletions, F.coalesce(itself, F.array().cast("array<struct<variant:bigint,role:string>>")))).alias("v")).select("line_key", "first", "v.*").distinct()
    # The earliest of each role: a substitution group is mutually near; in an insertion group only long with short.
    earliest = emitted.groupBy("variant").agg(
        *[F.min(F.when(F.col("role") == r, F.struct("first", "line_key"))).alias(r) for r in ("same", "long", "short")], F.count(F.lit(1)).alias("n")
    ).where("n > 1")
    joined = emitted.join(earliest, "variant").withColumn(
        "other", F.when(F.col("role") == "same", F.col("same")).when(F.col("role") == "long", F.col("short")).otherwise(F.col("long"))
    )
    pairs = joined.where("other is not null").select("line_key", F.col("other.line_key").alias("other_key"), F.col("other.first").alias("other_first"), "first").where("other_first < first").distinct()
    texts = candidates.select(F.col("line_key").alias("k"), "line")
    checked = pairs.join(candidates.select("line_key", F.col("line").alias("own")), "line_key").join(texts, F.col("other_key") == F.col("k"))
    return checked.where(F.levenshtein("own", "line", 1) >= 0).groupBy("line_key").agg(F.min("other_first").alias("near"))


def said(line: Column) -> Column:
    """Whether a line holds more than blanks."""
    return F.length(F.trim(F.translate(line, "\r\t", "  "))) > 0


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """All columns of docs with the kept lines as text, and __n_lines, __n_dropped (long).

    Every line that is not blank takes part: one of min_chars code points or more is dropped if an earlier line is within
    one edit, a shorter one, of which a single edit may make another word, only if an earlier line equals it. Blank lines
    stay.
    Lines end at \\n. Of equal positions (rows that repeat an id and a text) none is earlier: they come out alike. Rows that
    share an id but not the text are ordered by a hash of the text; a null id comes first. Null texts stay null and have no
    lines, empty ones one empty line. A line or text of any length is compared whole; an empty table gives an empty result.
    Other columns are carried as they are, whatever their names; where docs has n_chars it is not changed.
    """
    d, h, gone, lines = (fresh(docs, name) for name in ("__d", "__h", "__gone", "__lines"))
    line = F.col("line")
    all_lines = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("__h"), F.posexplode(F.split(F.col("text"), "\n", -1)).alias("no", "line"))
    size = F.length(line)
    keyed = all_lines.where(said(line)).select("doc_id", "__h", "no", F.xxhash64(line).alias("line_key"), line)
    half_keys = F.when(size >= min_chars, _half_keys(line, size))
    occurrences = materialise(keyed.select("doc_id", "__h", "no", "line_key", half_keys.alias("halves")), "line-keys")
    position = F.struct("doc_id", F.col("__h").alias("h"), "no")
    first = materialise(occurrences.groupBy("line_key").agg(F.min(position).alias("first"), F.count(F.lit(1)).alias("n")), "first-lines")
    near = materialise(near_lines(keyed.where(size >= min_chars).select("line_key", "line"), first.select("line_key", "first"), occurrences), "near-lines")
    deciding = first.join(near, "line_key", "left").where("n > 1 or near is not null").select("line_key", F.least("first", "near").alias("earliest"))
    dropped = (
        occurrences.select("doc_id", "__h", "no", "line_key").join(deciding, "line_key").where(position > F.col("earliest"))
        .groupBy(F.col("doc_id").alias(d), F.col("__h").alias(h)).agg(F.collect_set("no").alias(gone))
    )
    joined = docs.join(dropped, (F.xxhash64(docs["text"]) == F.col(h)) & docs["doc_id"].cast("bigint").eqNullSafe(F.col(d)), "left")
    joined = joined.withColumn(lines, F.when(F.col(gone).isNotNull(), F.split(F.col("text"), "\n", -1)))
    # Hash sets of line numbers: linear in the lines of a text, however many are dropped.
    stays = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)))
    kept = F.array_join(F.transform(stays, lambda i: F.col(lines)[i]), "\n")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept)
    return joined.select(
        *[text.alias(c) if c == "text" else F.col(c) for c in docs.columns],
        F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("bigint").alias("__n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("bigint").alias("__n_dropped"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), "text")


OP2_SQL = r"""
with d as (select doc_id, text, case when text is null then [] else string_split(text, chr(10)) end ls from documents),
l as (select doc_id, no, ls[no] line from d, unnest(range(1, len(ls) + 1)) x(no) where trim(translate(ls[no], chr(13) || chr(9), '  ')) <> ''),
f as (select line, length(line) n, min((doc_id, no)) pos from l group by line),
-- one edit leaves the first or the second half of the shorter line as it is
k as (select line, pos, n, s, h, case when h = 0 then substr(line, 1, (s // 2)::int) else right(line, (s - s // 2)::int) end part
      from f, (values (0), (1)) a(h), lateral (select n s union all select n - 1) where n >= 24),
p as (select distinct a.line, b.pos from k a join k b on a.s = b.s and a.h = b.h and a.part = b.part and b.pos < a.pos and abs(a.n - b.n) <= 1
      where a.line <> b.line and levenshtein(a.line, b.line) <= 1),
e as (select f.line, least(f.pos, coalesce(min(p.pos), f.pos)) pos from f left join p using (line) group by f.line, f.pos),
g as (select doc_id, list(no) gone from l join e using (line) where (l.doc_id, l.no) > e.pos group by doc_id)
select d.doc_id, len(ls)::bigint n_lines, coalesce(len(gone), 0)::bigint n_dropped,
       case when gone is null then text else array_to_string([ls[i] for i in range(1, len(ls) + 1) if not list_contains(gone, i)], chr(10)) end text
from d left join g using (doc_id)
"""
