"""URL filter: rules for hosts and paths, and a list of canonical URLs, behind a blocked Bloom filter.

Rules and listed URLs become keys of one list.  A page asks for the keys that could fit it: its canonical URL,
and for each pair of lengths that occurs among the rules the host's last and the path's first characters.
A blocked Bloom filter of the list (256 bits a block, eight of them set by a key) lets possible hits pass;
an exact join on the key removes the false ones.  So the large side is never shuffled whole, and the list is
never broadcast: the filter is, and it has at most ``BLOCKS`` rows of 40 bytes.  A list of more than about five
million keys makes it denser; more false hits then reach the exact join, and the result stays the same.

The pairs of lengths are the only thing collected, and do not grow with pages or listed URLs: hosts have up to 253
characters, and rule lists use few path lengths.

A rule fits its host and all subdomains if the path starts with the rule's; the longest rule wins, then
the one with the longer host; a rule listed with both verdicts blocks.  A null URL, or one without ``://``, has
an empty host and path and is on no list.  Null rules and null listed URLs are skipped.  Rows that repeat an id are
judged apart; further columns are not looked at; an empty table gives an empty result, an empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.llm.store import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that do not change the page.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|\z)"
BLOCKS = 1 << 18
BLOCK_BITS = 256
BITS_PER_KEY = 12
_SEED = 11
_WORDS = 4


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null if there is none."""
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without a default port, path without slashes at its end, sorted query without tracking; null without ``://``."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(80|443)\z", ""), r"\.\z", "")
    path = F.regexp_replace(path_of(url), r"/+\z", "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(_rest(url).isNotNull(), F.concat(host, path, tail))


def url_filter(pages: DataFrame, rules: DataFrame, listed: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """``page_id, host, path, rule, verdict, listed`` per page.

    ``rules`` has (host, path, verdict), ``listed`` has (url): URLs to block where no rule fits.
    """
    url = F.col("url")
    rows = pages.select(
        "page_id",
        host_of(url).alias("host"),
        path_of(url).alias("path"),
        canonical(url).alias("canonical"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = saved(rows, "urls")
    keys = saved(_listed_keys(rules, listed), "listed")
    hits = _exact(_possible(_probes(rows, rules), keys, blocks), keys)
    best = hits.groupBy("row").agg(
        F.max(F.when(F.col("rule").isNotNull(), F.struct("size", "host_size", "rule", "verdict"))).alias("best"),
        F.max(F.col("rule").isNull()).alias("listed"),
    )
    found = rows.join(best, "row", "left")
    on_list = F.coalesce("listed", F.lit(False))
    by_list = F.when(on_list, "block").otherwise("allow")
    return found.select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", by_list).alias("verdict"),
        on_list.alias("listed"),
    )


def mirrored_urls(pages: DataFrame) -> DataFrame:
    """``url`` of pages whose whole HTML, if any, a page of smaller id also has."""
    digests = pages.where("html <> ''").select("page_id", "url", F.sha2("html", 256).alias("digest"))
    digests = saved(digests, "digests")
    groups = digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    return digests.join(groups.where("n > 1"), "digest").where("page_id > first").select("url")


def _listed_keys(rules: DataFrame, listed: DataFrame) -> DataFrame:
    """``key, rule, verdict, size, host_size``, one row per key; rule is null for listed URLs."""
    rule = F.concat("host", "path")
    from_rules = rules.where("host is not null and path is not null and verdict is not null").select(
        _rule_key(rule).alias("key"),
        rule.alias("rule"),
        "verdict",
        F.length(rule).alias("size"),
        F.length("host").alias("host_size"),
    )
    from_rules = from_rules.groupBy("key", "rule", "size", "host_size").agg(F.max("verdict").alias("verdict"))
    urls = listed.select(_url_key(canonical(F.col("url"))).alias("key")).where("key is not null").distinct()
    return from_rules.unionByName(urls, allowMissingColumns=True)


def _rule_key(rule: Column) -> Column:
    return F.concat(F.lit("r:"), rule)


def _url_key(address: Column) -> Column:
    return F.concat(F.lit("u:"), address)


def _probes(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``row, key``: the keys that could fit each page."""
    shapes = rules.where("host is not null and path is not null").select(F.length("host"), F.length("path")).distinct()

    def key(host_size: int, path_size: int) -> Column:
        host, path = F.col("host"), F.col("path")
        start = F.length(host) - host_size
        fits = (start == 0) | ((start > 0) & (F.substring(host, start, F.lit(1)) == "."))
        tail = F.substring(host, start + 1, F.lit(host_size))
        return F.when(fits & (F.length(path) >= path_size), _rule_key(F.concat(tail, F.substring(path, 1, path_size))))

    wanted = [key(*shape) for shape in sorted(tuple(s) for s in shapes.collect())]
    return rows.select("row", F.explode(F.array(*wanted, _url_key(F.col("canonical")))).alias("key")).where("key is not null")


def _places(blocks: int) -> list[Column]:
    """Block of a key, and the bits that it sets there: two in each of four words, one in either half."""
    bits = F.xxhash64("key", F.lit(_SEED))

    def bit(i: int) -> Column:
        at = F.shiftrightunsigned(bits, 5 * i).bitwiseAND(F.lit(31)).cast("int")
        return F.call_function("shiftleft", F.lit(1).cast("long"), at + 32 * (i % 2))

    words = [bit(2 * i).bitwiseOR(bit(2 * i + 1)).alias(f"mask{i}") for i in range(_WORDS)]
    return [F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), *words]


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter: ``block, word0 .. word3``; blocks without a key are absent."""
    words = [F.bit_or(f"mask{i}").alias(f"word{i}") for i in range(_WORDS)]
    return keys.select(*_places(blocks)).groupBy("block").agg(*words)


def _possible(probes: DataFrame, keys: DataFrame, most: int) -> DataFrame:
    """Probes that pass the filter."""
    blocks = max(1, min(most, -(-keys.count() * BITS_PER_KEY // BLOCK_BITS)))
    bloom = saved(bloom_blocks(keys, blocks), "bloom")
    all_set = F.lit(True)
    for i in range(_WORDS):
        all_set = all_set & (F.col(f"word{i}").bitwiseAND(F.col(f"mask{i}")) == F.col(f"mask{i}"))
    asked = probes.select("row", "key", *_places(blocks))
    return asked.join(F.broadcast(bloom), "block").where(all_set).select("row", "key")


def _exact(possible: DataFrame, keys: DataFrame) -> DataFrame:
    """Possible hits whose key is listed.  A popular key is split by the adaptive join."""
    return possible.join(keys, "key")
