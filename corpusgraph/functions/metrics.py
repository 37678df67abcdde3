"""Pair metrics as column expressions (higher is more alike); rounded ones round half to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusgraph.functions.binding import let

# Alikeness of document types, looked up in this orientation.
DOC_TYPES: dict[str, dict[str, float]] = {
    "Background Reading": {"Data Response": 0.5, "Essential Reading": 0.3, "Monetary Policy Report": 0.0, "Recommended reading": 0.8, "Speech": 0.7},
    "Data Response": {"Essential Reading": 0.4, "Monetary Policy Report": 0.4, "Recommended reading": 0.8, "Speech": 0.0},
    "Essential Reading": {"Monetary Policy Report": 0.7, "Recommended reading": 0.4, "Speech": 0.0},
    "Monetary Policy Report": {"Recommended reading": 0.4, "Speech": 0.6},
    "Recommended reading": {"Speech": 0.0},
}
# The metrics in vector order, and their weights in the weighted mean.
METRICS = ["name", "text", "desc", "type", "author", "topic", "brand", "division", "mpc_round", "forecast_round", "date"]
WEIGHTS = [0.05, 0.3, 0.1, 0.05, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05, 0.1]


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def text_score(a: Column, b: Column) -> Column:
    return F.bround(dot(a, b), 3)


#: Bits of one whole number that hold a part of a row; a sum of two such numbers stays in 64 bits.
_BITS = 62


def lcs_length(a: Column, b: Column) -> Column:
    """Longest common subsequence of two strings, bit-parallel.

    A row of the usual table is kept as whole numbers of _BITS bits, one bit a character of ``b``
    (set where the row doesn't grow); a character of ``a`` takes one addition a number.
    """
    full = F.lit((1 << _BITS) - 1).cast("long")
    chars = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    zero = F.lit(0).cast("long")

    def places(right: Column, c: Column, word: Column) -> Column:
        """The bits of one number at which ``right`` holds the character."""
        part = F.slice(right, word * _BITS + 1, F.lit(_BITS))
        bits = F.transform(part, lambda x, i: F.when(x == c, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(zero))
        return F.aggregate(bits, zero, lambda m, x: m.bitwiseOR(x))

    def step(row: Column, mask: Column) -> Column:
        """The next row: a carry goes from each number to the next."""

        def number(acc: Column, w: Column) -> Column:
            x = F.get(row, w)
            u = x.bitwiseAND(F.get(mask, w))
            total = x + u + acc["carry"]
            grown = total.bitwiseOR(x - u).bitwiseAND(full)
            return F.struct(F.array_append(acc["out"], grown).alias("out"), F.shiftright(total, _BITS).alias("carry"))

        start = F.struct(F.array().cast("array<bigint>").alias("out"), zero.alias("carry"))
        return F.aggregate(F.sequence(F.lit(0), F.size(row) - 1), start, number, lambda acc: acc["out"])

    def table(right: Column) -> Column:
        words = F.sequence(F.lit(0), F.floor((F.size(right) - 1) / _BITS).cast("int"))
        distinct = F.array_distinct(right)
        masks = F.map_from_arrays(distinct, F.transform(distinct, lambda c: F.transform(words, lambda w: places(right, c, w))))

        def run(known: Column) -> Column:
            first = F.transform(words, lambda w: full)
            last = F.aggregate(chars(a), first, lambda row, c: F.when(F.map_contains_key(known, c), step(row, F.try_element_at(known, c))).otherwise(row))
            unset = F.transform(last, lambda x, i: F.bit_count(F.lit(-1).cast("long").bitwiseXOR(x).bitwiseAND(_low(F.least(F.size(right) - i * _BITS, F.lit(_BITS))))))
            return F.aggregate(unset, F.lit(0), lambda n, x: n + x)

        return F.when(F.size(right) == 0, F.lit(0)).otherwise(let(masks, run))

    return let(chars(b), table)


def _low(n: Column) -> Column:
    """A number whose ``n`` lowest bits are set."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1


def indel_ratio(a: Column, b: Column) -> Column:
    """``2 LCS / (len a + len b)``; two empty strings are alike."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * lcs_length(a, b) / total)


def name_score(name_a: Column, name_b: Column, emb_a: Column, emb_b: Column, syntactic: float = 0.5) -> Column:
    """Mix of name spelling (scaled to -1..1) and name embeddings, rounded to 3 places."""
    return F.bround(syntactic * (2 * indel_ratio(name_a, name_b) - 1) + (1 - syntactic) * dot(emb_a, emb_b), 3)


def type_score(a: Column, b: Column) -> Column:
    """Equal types 1; else the table's value scaled to -1..1; pairs it does not hold 0.

    The second type is tried as the first only if the first opens no row of the table.
    """
    pairs = F.create_map(*[x for t0, row in DOC_TYPES.items() for t1, d in row.items() for x in (F.lit(t0 + "\x00" + t1), F.lit(d))])
    opens = a.isin(list(DOC_TYPES))
    key = F.when(opens, F.concat_ws("\x00", a, b)).otherwise(F.concat_ws("\x00", b, a))
    return F.when(a == b, F.lit(1.0)).otherwise(F.coalesce(F.bround(2 * (pairs[key] - 0.5), 3), F.lit(0.0)))


def same_type_score(a: Column, b: Column) -> Column:
    """Older variant: equal 1, else -1."""
    return equality_score(a, b)


def date_score(a: Column, b: Column, half_span: float = 365.0) -> Column:
    """1 within a fortnight, falling with the days between; -1 over 90 days before or a year after."""
    diff = F.datediff(a, b)
    scaled = diff / F.lit(half_span)
    return (
        F.when((diff < -90) | (diff > 365), F.lit(-1.0))
        .when((diff > -15) & (diff < 15), F.lit(1.0))
        .otherwise(F.bround(1 / (0.5 + scaled * scaled) - 1, 3))
    )


def equality_score(a: Column, b: Column) -> Column:
    return F.when(a.eqNullSafe(b), F.lit(1.0)).otherwise(F.lit(-1.0))


def list_jaccard(a: Column, b: Column, is_match=None) -> Column:
    """Share of common items, 0..1, on lists whose repeats count in the union.

    Distinct non-blank items of ``a`` that match an item of ``b`` make the intersection
    (``is_match(x, y)``: equality by default).  Two empty lists share nothing.
    """
    same = is_match or (lambda x, y: x == y)
    common = F.size(F.filter(F.array_distinct(a), lambda x: (F.trim(x) != "") & F.exists(b, lambda y: same(x, y))))
    union = F.size(a) + F.size(b) - common
    return F.bround(F.least(F.lit(1.0), F.coalesce(F.try_divide(common, union), F.lit(0.0))), 3)


def list_score(a: Column, b: Column, is_match=None) -> Column:
    """List overlap scaled to -1..1."""
    return F.bround(2 * list_jaccard(a, b, is_match) - 1, 3)


def author_score(a: Column, b: Column, is_match=None) -> Column:
    """As ``list_score``, on sets: repeated authors count once."""
    return list_score(F.array_distinct(a), F.array_distinct(b), is_match)


def close_match(threshold: int = 80):
    """Items match from ``threshold`` of 100 on the spelling ratio, case aside."""
    return lambda x, y: indel_ratio(F.lower(x), F.lower(y)) * 100 >= threshold


def brand_score(a: Column, b: Column, is_match=None) -> Column:
    """As ``list_score``, but 0 where either side holds a missing value."""
    missing = lambda xs: F.exists(xs, lambda x: F.lower(x) == "nan")
    return F.when(missing(a) | missing(b), F.lit(0.0)).otherwise(list_score(a, b, is_match))


def set_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; two empty sets give 0."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def entity_link_score(ents_a: Column, ents_b: Column, links_a: Column, links_b: Column, entities: float = 0.8) -> Column:
    return entities * set_jaccard(ents_a, ents_b) + (1 - entities) * set_jaccard(links_a, links_b)


def mean_score(vector: list[Column]) -> Column:
    return sum(vector[1:], vector[0]) / len(vector)


def weighted_score(vector: list[Column], weights: list[float] = WEIGHTS) -> Column:
    """Weighted sum of the metrics, divided by their number."""
    parts = [w * v for w, v in zip(weights, vector, strict=True)]
    return sum(parts[1:], parts[0]) / len(parts)


def name_match_score(a: Column, b: Column) -> Column:
    """Spelling match of squeezed names: 0.4 ratio + 0.3 best window + 0.3 case-folded ratio.

    Squeezed names are one token, so both token measures equal the case-folded ratio.
    """
    return 0.4 * indel_ratio(a, b) + 0.3 * partial_ratio(a, b) + 0.3 * indel_ratio(F.lower(a), F.lower(b))


def partial_ratio(a: Column, b: Column) -> Column:
    """Best ratio of the shorter string with windows of its length in the longer one."""
    short = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    long = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    starts = F.sequence(F.lit(1), F.length(long) - F.length(short) + 1)
    best = F.array_max(F.transform(starts, lambda i: indel_ratio(short, F.substring(long, i, F.length(short)))))
    return F.when(F.length(short) == 0, F.when(F.length(long) == 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(best)


def metric_vector(emb: str = "embedding", close=None) -> list[Column]:
    """The metrics of rows that hold both documents' columns with prefixes ``a_`` and ``b_``."""
    a, b = (lambda c: F.col("a_" + c)), (lambda c: F.col("b_" + c))
    pair = lambda f, c, *x: f(a(c), b(c), *x)
    return [
        name_score(a("name"), b("name"), a("name_emb"), b("name_emb")), pair(text_score, emb), pair(text_score, "desc_emb"), pair(type_score, "type"),
        pair(author_score, "authors", close), pair(list_score, "topics", close), pair(brand_score, "brands", close), pair(list_score, "divisions", close),
        pair(equality_score, "mpc_round"), pair(equality_score, "forecast_round"), pair(date_score, "date"),
    ]
