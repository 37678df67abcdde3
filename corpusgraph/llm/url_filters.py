"""URL verdicts: path rules, then exact list membership by a cascade of Bloom filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.plans.scratch import materialize
from corpusgraph.plans.skew import free_name

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path, verdict); fixed values of the production query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Labels of host names that put a host on the production block list; fixed values.
LISTED_LABELS = ["adult", "ads", "bets", "betting", "casino", "gambling", "lottery", "malware", "phishing", "pills", "poker", "porn", "spam", "track", "tracker", "viagra", "warez", "xxx"]

#: What such a label is joined with by a hyphen, on either side, and the domains that sell names below them; fixed values.
COMPANIONS = ["best", "bonus", "cheap", "club", "farm", "free", "hot", "live", "network", "now", "online", "play", "shop", "top", "track", "win", "world", "x"]
DOMAINS = ["example.com", "example.net", "example.org"]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path; both empty for a null url or one without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(u, pattern, 1), UPPER, LOWER), F.regexp_extract(u, pattern, 2)


def matching_rule(host: Column, path: Column, rules=tuple(RULES)) -> tuple[Column, Column]:
    """The longest fitting rule (as text) and its verdict, null where none fits.

    A rule fits its host and all subdomains where the path starts with the rule's path.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


#: Bits in a byte of a filter: seven, so that every byte is a character by itself.
BYTE_BITS = 7
#: Keys of a part of the filters, on average; filters of at most so many bytes are sent to the rows.
KEYS_PER_PART, SENT_BYTES = 65_536, 32 << 20


def _probes(key: Column, salt: int, hashes: int, n_bytes: Column) -> list[Column]:
    """The bits that a key has in a filter of ``n_bytes``: one hash, and a second one as the step."""
    part = F.lit(2**58 - 1).cast("long")  # no sum of these overflows
    first, step = F.xxhash64(F.lit(salt), key).bitwiseAND(part), F.xxhash64(F.lit(salt), F.lit("step"), key).bitwiseAND(part)
    return [(first + F.lit(i).cast("long") * step) % (n_bytes * BYTE_BITS) for i in range(hashes)]


def _has_bit(table: Column, at: Column) -> Column:
    byte = F.ascii(F.substring(table, (F.floor(at / BYTE_BITS) + 1).cast("int"), F.lit(1)).cast("string"))
    return F.getbit(byte, (at % BYTE_BITS).cast("int")) == 1


class BloomCascade:
    """Exact membership of listed keys within a complete key universe.

    Level 1 encodes the listed keys, level 2 the unlisted keys that pass level 1, level 3 the
    listed keys that pass level 2, and so on until no key passes wrongly.  A key's answer is the
    parity of the first level that it fails.  Sizes shrink geometrically.

    Keys are dealt to parts by their hash, and every part has filters of its own: ``filters`` has a
    row per part with a binary value per level.  A row meets the filters of its key's part, never a
    list of keys.  The filters are sent to the rows while they are under SENT_BYTES, which is
    checked; beyond, rows and filters are dealt by part, and by a salt besides, so that a key with
    a third of all rows is spread out.
    """

    def __init__(self, universe: DataFrame, bits_per_key: int = 10, hashes: int = 5, keys_per_part: int = KEYS_PER_PART, max_levels: int = 24):
        """``universe``: distinct non-null ``key`` with boolean ``listed``."""
        self.hashes, self.bits, self.n_levels = hashes, bits_per_key, 0
        rest = materialize(universe.select("key", "listed"), "bloom-keys")
        counts = self._counts(rest)
        self.n_parts = sum(counts.values()) // keys_per_part + 1
        levels, encode = [], True
        while counts.get(True) and counts.get(encode):
            if self.n_levels == max_levels:
                raise RuntimeError("the cascade did not end; raise bits_per_key")
            level = materialize(self._fill(rest.where(F.col("listed") == encode), self.n_levels), "bloom-filters")
            levels.append(level)
            # the keys of a part meet its filter: listed ones stay for the next level, the others if they pass
            met = rest.withColumn("part", self.part(F.col("key"))).join(self._sent(level), "part", "left")
            passing = met.where((F.col("listed") == encode) | self._holds(F.col("key"), F.col("filter"), self.n_levels))
            self.n_levels += 1
            rest = materialize(passing.select("key", "listed"), "bloom-keys")
            counts = self._counts(rest)
            encode = not encode
            if not counts.get(encode):
                break
        self.filters = None
        for depth, level in enumerate(levels):
            level = level.withColumnRenamed("filter", f"filter{depth}")
            self.filters = level if self.filters is None else self.filters.join(level, "part", "full")
        if self.filters is not None:
            self.filters = materialize(self.filters, "bloom-filters")

    @staticmethod
    def _counts(keys: DataFrame) -> dict[bool, int]:
        return {r["listed"]: r["n"] for r in keys.groupBy("listed").agg(F.count("*").alias("n")).collect()}

    def part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit("part"), key), F.lit(self.n_parts).cast("long")).cast("int")

    def _fill(self, keys: DataFrame, salt: int) -> DataFrame:
        """``(part, filter)``: bits of the keys, as many bytes a part as its keys need."""
        keys = keys.select(self.part(F.col("key")).alias("part"), "key")
        sizes = keys.groupBy("part").agg(F.ceil(F.count("*") * self.bits / BYTE_BITS).cast("long").alias("n_bytes"))
        sizes = materialize(sizes, "bloom-sizes")
        bits = keys.join(self._sent(sizes), "part").select("part", F.explode(F.array(*_probes(F.col("key"), salt, self.hashes, F.col("n_bytes")))).alias("at"))
        own = bits.select("part", F.floor(F.col("at") / BYTE_BITS).alias("byte"), F.call_function("shiftleft", F.lit(1), (F.col("at") % BYTE_BITS).cast("int")).alias("v"))
        blank = sizes.select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bytes") - 1)).alias("byte"), F.lit(0).alias("v"))
        bytes_ = own.union(blank).groupBy("part", "byte").agg(F.bit_or("v").alias("v"))
        table = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("byte", "v"))), lambda x: F.char(x["v"])), "")
        return bytes_.groupBy("part").agg(F.encode(table, "UTF-8").alias("filter"))

    @staticmethod
    def _sent(parts: DataFrame) -> DataFrame:
        """A table with a row per part, broadcast if its size, which is looked up, allows."""
        last = parts.columns[-1]
        n = parts.agg(F.sum((F.octet_length(last) if last == "filter" else F.lit(8)) + 64)).first()[0] or 0
        return F.broadcast(parts) if n <= SENT_BYTES else parts

    def _holds(self, key: Column, table: Column, salt: int) -> Column:
        """Whether all probed bits are set; a part without a filter holds nothing."""
        out = table.isNotNull()
        for at in _probes(key, salt, self.hashes, F.octet_length(table).cast("long")):
            out = out & _has_bit(table, at)
        return F.coalesce(out, F.lit(False))

    def mark(self, df: DataFrame, key: str, out: str, salts: int = 16) -> DataFrame:
        """Add boolean ``out`` to ``df``; keys outside the universe may be wrong, null keys are false."""
        if self.filters is None:
            return df.withColumn(out, F.lit(False))
        part, salt = free_name(df, "_part"), free_name(df, "_salt")
        tables = [free_name(df, f"_filter{i}") for i in range(self.n_levels)]
        filters = self.filters.select(F.col("part").alias(part), *[F.col(f"filter{i}").alias(t) for i, t in enumerate(tables)])
        rows = df.withColumn(part, self.part(F.col(key)))
        total = filters.agg(F.sum(sum((F.coalesce(F.octet_length(t), F.lit(0)) for t in tables), F.lit(64)))).first()[0] or 0
        if total <= SENT_BYTES:
            met = rows.join(F.broadcast(filters), part, "left")
        else:
            spread = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
            salted = filters.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
            met = rows.withColumn(salt, spread).join(salted, [part, salt], "left").drop(salt)
        verdict = F.lit(self.n_levels % 2 == 1)
        for depth in range(self.n_levels - 1, -1, -1):
            verdict = F.when(self._holds(F.col(key), F.col(tables[depth]), depth), verdict).otherwise(F.lit(depth % 2 == 1))
        return met.withColumn(out, verdict & F.col(key).isNotNull()).drop(part, *tables)


def listed_hosts(hosts: DataFrame, listed: DataFrame) -> DataFrame:
    """``(key, listed)`` for distinct hosts: whether ``listed`` (a column ``host``) has it or a parent domain.

    Built once with the cascade: each host's own name and its parents meet the list.
    """
    keys = hosts.select(F.col("key"), F.split("key", "[.]").alias("labels"))
    names = keys.select("key", F.explode(F.transform("labels", lambda _, i: F.array_join(F.slice("labels", i + 1, F.size("labels")), "."))).alias("name"))
    hits = names.join(listed.select(F.translate("host", UPPER, LOWER).alias("name")).distinct(), "name", "left_semi").select("key").distinct()
    return hosts.select("key").join(hits.withColumn("listed", F.lit(True)), "key", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))


def has_listed_label(host: Column, labels: list[str] = LISTED_LABELS) -> Column:
    """Whether a label of ``host`` (parts between dots and hyphens) is on the list."""
    return F.arrays_overlap(F.split(host, "[.-]"), F.array(*[F.lit(x) for x in labels]))


def block_list(spark: SparkSession) -> DataFrame:
    """The production block list, a table of some two thousand names that knows nothing of the corpus.

    A label of LISTED_LABELS alone, or with one of COMPANIONS on either side, under each of DOMAINS.
    """
    words = lambda xs: F.explode(F.array(*map(F.lit, xs)))
    parts = spark.range(1).select(words(LISTED_LABELS).alias("a")).select("a", words([None, *COMPANIONS]).alias("b")).select("a", "b", words(DOMAINS).alias("d"))
    names = F.explode(F.array(F.concat_ws("-", "a", "b"), F.concat_ws("-", "b", "a")))
    return parts.select("d", names.alias("n")).select(F.concat_ws(".", "n", "d").alias("host")).distinct()


def label_list(pages: DataFrame, url: str = "url") -> DataFrame:
    """A block list made from the corpus's own hosts: those with a label of LISTED_LABELS."""
    host = split_url(F.col(url))[0]
    return pages.select(host.alias("host")).distinct().where(has_listed_label(F.col("host")))


def filter_urls(pages: DataFrame, listed: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """Per page: host, path, the fitting rule and a verdict (the rule's, else block if listed).

    ``listed`` is a table whose column ``host`` names blocked hosts and domains (with all their
    subdomains); nulls and repeated rows in it count for nothing.  The corpus's hosts are the key
    universe; each distinct host is encoded once.  Null or odd urls have an empty host, which no
    rule fits: allow, unless the list has the empty name.  Very long urls are taken whole.
    Repeated rows stay, other columns don't; an empty table gives an empty result.
    """
    host, path = split_url(F.col(url))
    parsed = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    universe = listed_hosts(parsed.select(F.col("host").alias("key")).distinct(), listed)
    marked = BloomCascade(universe).mark(parsed, "host", "_listed")
    rule, verdict = matching_rule(F.col("host"), F.col("path"))
    fallback = F.when(F.col("_listed"), F.lit("block")).otherwise(F.lit("allow"))
    return marked.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, fallback).alias("verdict"))
