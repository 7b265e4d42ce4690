"""URL filters by a cascade of Bloom filters (native: DataFrame and SQL functions only).

Level 1 encodes the listed keys, level 2 the corpus keys that pass level 1 although they are not listed, level 3 the
listed keys that pass level 2, and so on until a level lets no wrong key pass. Over the complete key universe of the
corpus the cascade then answers membership exactly, from bit arrays whose size follows the list, and without a join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

#: (verdict, rule); a rule is host + path and fits the host, its subdomains and all paths that start with its path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
# Words of host names by which the method blocks advertising, betting, adult, drug, malware and spam sites where no
# rule fits.
BLOCKED_WORDS = (
    "ads", "adserver", "adult", "affiliate", "bet", "bets", "betting", "bitcoin", "casino", "casinos", "cialis", "clickbait", "crack", "cracked", "dating", "doubleclick", "escort", "escorts",
    "gamble", "gambling", "hentai", "hookup", "jackpot", "keygen", "loan", "loans", "lottery", "malware", "nude", "payday", "phishing", "pills", "poker", "popads", "porn", "porno", "replica", "sex",
    "slots", "spam", "spyware", "torrent", "torrents", "track", "tracker", "tracking", "viagra", "warez", "xxx",
)
BITS_PER_KEY = 12
HASHES = 4
MAX_LEVELS = 60
#: A filter's bits travel as a literal with each task. A longer list is cut into parts by hash, each with a cascade of its own,
#: and the parts are asked one after the other.
PART_BITS = 8 * 1024 * 1024 * 8


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, with A-Z lower-cased; empty for null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"^(?s).*?://", ""))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"^(?s).*?://[^/?#]*", ""))
    return F.coalesce(F.regexp_extract(rest, r"^[^?#]*", 0), F.lit(""))


def candidate_keys(host: Column, path: Column, path_lengths: Sequence[int]) -> Column:
    """Every key that could be listed for the url: each suffix of the host's labels with each prefix of the path that
    has the length of some listed path."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels)))
    )
    fitting = F.filter(F.array(*[F.lit(n) for n in sorted(set(path_lengths))]), lambda n: F.length(path) >= n)
    return F.array_distinct(
        F.flatten(F.transform(suffixes, lambda s: F.transform(fitting, lambda n: F.concat(s, F.substring(path, F.lit(1), n)))))
    )


def _positions(key: Column, level: int, n_bits: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(level), F.lit(j)), F.lit(n_bits)) for j in range(HASHES)])


@dataclass
class Level:
    n_bits: int
    bits: bytes

    def passes(self, key: Column, level: int) -> Column:
        """True where all of the key's bits are set. The bits are a binary literal, so a level also works inside filter()."""
        filled = F.lit(self.bits)

        def is_set(p: Column) -> Column:
            byte = F.conv(F.hex(F.substring(filled, F.shiftright(p, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
            return F.getbit(byte, p.bitwiseAND(F.lit(7)).cast("int")) == 1

        return F.forall(_positions(key, level, self.n_bits), is_set)


@dataclass
class BloomCascade:
    """contains() is exact for every key of the universe that it was built over."""

    levels: list[Level]

    def contains(self, key: Column) -> Column:
        """A key that first fails at an odd level (1, 3, ...) is not listed, at an even one it is; one that passes all
        levels is on the side of the last level."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels), 0, -1):
            out = F.when(~self.levels[i - 1].passes(key, i), F.lit(i % 2 == 0)).otherwise(out)
        return out


def _encode(keys: DataFrame, level: int) -> Level:
    """keys: distinct, column key."""
    n_bits = max(64, -(-keys.count() * BITS_PER_KEY // 64) * 64)
    words = (
        keys.select(F.explode(_positions(F.col("key"), level, n_bits)).alias("p"))
        .groupBy(F.shiftright("p", 6).alias("w"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
        .toArrow()  # about PART_BITS at most: it follows a part of the list, not the corpus
    )
    filled = np.zeros(n_bits // 64, np.int64)
    filled[words["w"].to_numpy()] = words["bits"].to_numpy()
    return Level(n_bits, filled.tobytes())


def build_cascade(listed: DataFrame, universe: DataFrame, scratch: Scratch) -> BloomCascade:
    """listed, universe: column key (string; nulls and repeats are ignored). An empty list gives an empty cascade, which
    contains nothing."""
    inside = scratch.write(listed.select("key").where("key is not null").distinct(), "listed")
    if inside.isEmpty():
        return BloomCascade([])
    levels = [_encode(inside, 1)]
    outside = universe.select("key").where("key is not null").where(levels[0].passes(F.col("key"), 1)).distinct()
    # Only building needs to know which of the few keys that pass are listed.
    encode, other = scratch.write(outside.join(inside, "key", "left_anti"), "cascade1"), inside
    while not encode.isEmpty():
        if len(levels) == MAX_LEVELS:
            raise ValueError("the cascade does not converge")
        k = len(levels) + 1
        levels.append(_encode(encode, k))
        wrong = scratch.write(other.where(levels[-1].passes(F.col("key"), k)), f"cascade{k}")
        encode, other = wrong, encode
    return BloomCascade(levels)


def with_listed(rows: DataFrame, listed: DataFrame, scratch: Scratch) -> DataFrame:
    """rows: keys (array<string>) and others. Adds listed_keys: those of the keys that the list holds, exactly. The list may have
    any size: a plan holds the bits of one part of it only."""
    parts = max(1, -(-listed.count() * BITS_PER_KEY // PART_BITS))
    part = lambda key: F.pmod(F.xxhash64(key, F.lit("part")), F.lit(parts))
    universe = rows.select(F.explode("keys").alias("key"))
    out = rows.withColumn("listed_keys", F.array().cast("array<string>"))
    for p in range(parts):
        mine = lambda key: part(key) == p  # noqa: B023, E731
        cascade = build_cascade(listed.where(mine(F.col("key"))), universe.where(mine(F.col("key"))), scratch)
        out = out.withColumn("listed_keys", F.concat("listed_keys", F.filter("keys", lambda k: mine(k) & cascade.contains(k))))  # noqa: B023
        if parts > 1:
            out = scratch.write(out, f"part{p}")
    if parts == 1:
        scratch.clear()  # the bits travel in the plan
    return out


def filter_urls(
    pages: DataFrame,
    spark: SparkSession,
    rules: Sequence[tuple[str, str]] = RULES,
    blocked_words: Sequence[str] = BLOCKED_WORDS,
    blocked_hosts: DataFrame | None = None,
) -> DataFrame:
    """Judge every row's url: page_id, host, path, rule, verdict, listed (what the list holds of the host, or null).

    The longest rule that fits decides; else a host with a blocked word (between dots and hyphens), or that is one of
    blocked_hosts (column host: a table of any size) or below one, is blocked, any other allowed. Null urls and urls without
    :// have an empty host and path, no rule and the verdict allow. Repeated rows are judged alike, urls of any length whole;
    other columns are not carried; an empty table gives an empty result.
    """
    scratch = Scratch(spark, "url-filter")
    rows = pages.select(F.col("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    lengths = [len(r) - r.index("/") for _, r in rules] or [0]
    empty = F.array().cast("array<string>")
    said = F.filter(F.split("host", r"[.-]"), lambda x: x != "")
    marked = lambda mark, names: F.transform(names, lambda x: F.concat(F.lit(mark), x))
    labels = F.split("host", r"\.")
    sites = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    every = [marked("rule:", candidate_keys(F.col("host"), F.col("path"), lengths)), marked("word:", said)]
    every += [marked("host:", sites)] if blocked_hosts is not None else []
    keyed = rows.withColumn("keys", F.when(F.col("host") != "", F.array_distinct(F.concat(*every))).otherwise(empty))
    listed = spark.createDataFrame([(f"rule:{r}",) for _, r in rules] + [(f"word:{w}",) for w in blocked_words], "key string")
    if blocked_hosts is not None:
        listed = listed.unionAll(blocked_hosts.where("host <> ''").select(F.concat(F.lit("host:"), F.translate("host", UPPER, LOWER))))
    out = with_listed(keyed, listed, scratch)
    fits = F.filter("listed_keys", lambda k: F.startswith(k, F.lit("rule:")))
    longest = F.aggregate(fits, F.lit(None).cast("string"), lambda a, x: F.when(a.isNull() | (F.length(x) > F.length(a)), x).otherwise(a))
    others = F.filter("listed_keys", lambda k: ~F.startswith(k, F.lit("rule:")))
    out = out.withColumn("rule", F.substring(longest, F.lit(6), F.length("host") + F.length("path"))).withColumn("listed", F.try_element_at(F.array_sort(others), F.lit(1)))
    verdict = F.when(F.col("listed").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    for v, r in rules:
        verdict = F.when(F.col("rule") == r, F.lit(v)).otherwise(verdict)
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "listed")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), spark).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = rf"""
with u as (select page_id, case when instr(url, '://') > 0 then regexp_replace(url, '^.*?://', '', 's') end rest from pages),
h as (select page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host,
             coalesce(regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*'), '') path from u),
rules(rule, rhost, rpath, v) as (values ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
                                        ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
f as (select page_id, host, path, rule, v from h join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)),
b as (select page_id, host, path, arg_max(rule, length(rule)) rule, arg_max(v, length(rule)) v from f group by all)
select h.page_id, h.host, h.path, b.rule,
       coalesce(b.v, case when list_has_any(regexp_split_to_array(h.host, '[.-]'), {list(BLOCKED_WORDS)})
                          then 'block' else 'allow' end) verdict
from h left join b on h.page_id is not distinct from b.page_id and h.host = b.host and h.path = b.path
"""
