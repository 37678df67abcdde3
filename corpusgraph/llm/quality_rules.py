"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger stores the measurements and one failure
bit per rule; a policy is a versioned mask over those bits, so changing or ablating a policy
never reads a text again.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions.binding import let

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Rule name -> (bit, failure condition over a getter of the measurements).
RULES: dict[str, tuple[int, Callable[[Callable[[str], Column]], Column]]] = {
    "few_words": (0, lambda m: m("n_words") < 20),
    "repeated_words": (1, lambda m: 100 * m("n_repeat_words") > 30 * m("n_words")),
    "symbols": (2, lambda m: 10 * m("n_symbols") > m("n_words")),
    "duplicate_lines": (3, lambda m: 2 * m("n_dup_lines") > m("n_lines")),
    "long_or_short_words": (4, lambda m: (m("word_chars") > 20 * m("n_words")) | (m("word_chars") < 2 * m("n_words"))),
    "exclamations": (5, lambda m: 2 * m("n_bangs") > m("n_words")),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_bangs")
BASE = ("few_words", "repeated_words")
#: Versioned policies: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": tuple(RULES),
    "v1_lines_allowed": tuple(r for r in RULES if r != "duplicate_lines"),
}


def mask_of(rules: tuple[str, ...]) -> int:
    return sum(1 << RULES[r][0] for r in rules)


def _split_words(text: Column) -> Column:
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _count_chars(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _repeated_words(words: Column, n: int) -> Column:
    """Words covered by ``n``-word windows that occur at least twice in ``words``.

    Windows are named by a 64-bit hash of their word hashes.  The sort that finds equal names
    runs only for texts that have some (``array_distinct`` tells); two different windows of one
    text share a name with a chance of about n_windows^2 / 2^65.
    """

    def covered(starts: Column) -> Column:
        return F.aggregate(
            starts,
            F.struct(F.lit(-n).alias("prev"), F.lit(0).cast("long").alias("total")),
            lambda acc, p: F.struct(p.alias("prev"), (acc["total"] + F.least(F.lit(n), p - acc["prev"])).alias("total")),
            lambda acc: acc["total"],
        )

    def repeated_starts(names: Column) -> Column:
        def pick(s: Column) -> Column:
            same = lambda e, other: F.coalesce(F.get(s, other)["h"] == e["h"], F.lit(False))
            hits = F.filter(s, lambda e, i: same(e, i - 1) | same(e, i + 1))
            return F.sort_array(F.transform(hits, lambda e: e["i"]))

        return let(F.sort_array(F.transform(names, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), pick)

    def windows(hashes: Column) -> Column:
        names = F.transform(
            F.sequence(F.lit(0), F.size(hashes) - n),
            lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(n)]),
        )
        found = let(
            names,
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(repeated_starts(h))),
        )
        return F.when(F.size(hashes) < n, F.lit(0).cast("long")).otherwise(found)

    return let(F.transform(words, lambda w: F.xxhash64(w)), windows)


def measurements(text: Column, window: int = 8) -> Column:
    """All MEASURES of a text as one struct; null and empty texts measure zero everywhere."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.translate(x, SPACE, "") != "")

    def build(words: Column, line: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.translate(t, SPACE, "")).cast("long").alias("word_chars"),
            _count_chars(t, SYMBOLS).alias("n_symbols"),
            F.size(line).cast("long").alias("n_lines"),
            (F.size(line) - F.size(F.array_distinct(line))).cast("long").alias("n_dup_lines"),
            _repeated_words(words, window).alias("n_repeat_words"),
            _count_chars(t, "!").alias("n_bangs"),
        )

    return let(_split_words(t), lambda words: let(lines, lambda line: build(words, line)))


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: measurements and ``fail_bits``.

    Repeated rows give repeated ledger rows; a null key stays null; an empty table gives none.
    """
    flat = docs.select(key, *keep, measurements(F.col(text)).alias("__quality")).select(key, *keep, *[F.col(f"__quality.{m}").alias(m) for m in MEASURES])
    bits = F.lit(0)
    for bit, fails in RULES.values():
        bits = bits.bitwiseOR(F.when(fails(F.col), F.lit(1 << bit)).otherwise(F.lit(0)))
    return flat.withColumn("fail_bits", bits.cast("long"))


def passes(policy: str = "v1", bits: Column | None = None) -> Column:
    bits = F.col("fail_bits") if bits is None else bits
    return bits.bitwiseAND(F.lit(mask_of(POLICIES[policy])).cast("long")) == 0


def ablations(led: DataFrame, policies: Mapping[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """Per policy and rule: rejected documents, those that fail the rule, and those that only this
    rule rejects (which a policy without it would keep).  One pass over the ledger's bits."""
    rows = []
    for name, rules in policies.items():
        mask = F.col("fail_bits").bitwiseAND(F.lit(mask_of(rules)).cast("long"))
        for rule in rules:
            one = F.lit(1 << RULES[rule][0]).cast("long")
            rows.append((name, rule, mask, one))
    aggs = [F.count("*").alias("n")]
    for i, (_, _, mask, one) in enumerate(rows):
        aggs += [F.count_if(mask != 0).alias(f"r{i}"), F.count_if(mask.bitwiseAND(one) != 0).alias(f"f{i}"), F.count_if(mask == one).alias(f"o{i}")]
    total = led.agg(*aggs)
    out = F.array(*[
        F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.col("n").alias("n_docs"), F.col(f"r{i}").alias("n_rejected"), F.col(f"f{i}").alias("n_failing"), F.col(f"o{i}").alias("n_only"))
        for i, (p, r, _, _) in enumerate(rows)
    ])
    return total.select(F.explode(out).alias("x")).select("x.*")


def apply_policy(docs: DataFrame, policy: str = "v1", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``policy`` keeps, with their own columns.

    The verdict is one expression that binds the measurements, so that a pushed-down filter
    evaluates them once a row.
    """
    def verdict(m: Column) -> Column:
        failed = F.lit(False)
        for rule in POLICIES[policy]:
            failed = failed | RULES[rule][1](lambda name: m[name])
        return ~failed

    return docs.where(let(measurements(F.col(text)), verdict))
