"""Repeated line runs, by a suffix array over the corpus's sequence of line ids.

The corpus is one sequence: every document's lines in order, documents by key, a gap after each.
Prefix doubling ranks its suffixes: by their first line, then by 2, 4, 8, ... lines, each time by
sorting the pairs of the ranks of their two halves.  A rank is the number of suffixes that sort
before; suffixes of one rank share the whole prefix, and one whose prefix is unique drops out, for
it has no common prefix of that length with any other.  All lines that occur once drop out at the
start.

The suffixes that share a prefix of m lines are neighbours in this order, the longest-common-prefix
interval of depth m: those that agree in the rank of the first 2^t lines and in the rank of the
last 2^t of the m lines, 2^t <= m < 2^(t+1).  The least position of an interval is the first copy;
at all others the run is a later copy.  One that overlaps the first copy loses only what lies beyond
it, so that the first copy of a run stays whole (where it isn't itself a later copy of another run).

A later copy counts from ``min_words`` words.  Depths are looked up where they matter: a line lies
in a copied run of that size exactly if it lies in one that is shortest (from its first line on, or
up to its last line) among those of ``min_words`` words.  Overlapping copies merge into the maximal
repeated runs, whose lines are deleted.  Doubling ends at the deepest such lookup, as deeper
intervals lie within these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.plans.positions import global_positions
from corpusgraph.plans.scratch import materialize
from corpusgraph.plans.skew import free_name, join_groups

WORD = "[^\\x20\\x09-\\x0D]+"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _positions(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Every document's place in the sequence and every line's (two hashes and a word count)."""
    line = lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("line"), x).alias("b"), F.regexp_count(x, F.lit(WORD)).cast("int").alias("w"))
    seqs = (
        docs.where(F.col(text).isNotNull())
        .select(F.col(key).alias("d"), F.xxhash64(text).alias("th"), F.transform(_lines(F.col(text)), line).alias("lines"))
        .dropDuplicates(["d", "th"])
    )
    placed, _ = global_positions(seqs, ["d", "th"], F.size("lines") + 1, "start", "line-seqs")
    placed = materialize(placed, "line-places")
    lines = placed.select("start", F.posexplode("lines").alias("i", "x")).select("start", (F.col("start") + F.col("i")).alias("pos"), "x.a", "x.b", "x.w")
    return placed.select("d", "th", "start"), lines


def rank_suffixes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose ``keys`` occur twice or more, with ``rank``: how many such rows sort before them.

    Only distinct keys are sorted, with their counts; rows of a very common key never meet.
    """
    groups = materialize(rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"), "line-groups")
    ranked, _ = global_positions(groups, keys, F.col("n"), "rank", "line-ranks")
    return join_groups(rows, ranked, keys)


def _shortest_runs(named: DataFrame, min_words: int) -> DataFrame:
    """``(start, pos, last, m)``: runs of ``min_words`` words, shortest from a line on or up to a line."""
    # only unbroken stretches of repeated lines can be copies
    by_pos = Window.partitionBy("start").orderBy("pos")
    stretch = named.withColumn("stretch", F.col("pos") - F.row_number().over(by_pos)).withColumn(
        "after", F.sum("w").over(Window.partitionBy("start", "stretch").orderBy("pos"))
    )
    stretch = stretch.withColumn("before", F.col("after") - F.col("w"))
    ahead = Window.partitionBy("start", "stretch").orderBy("before").rangeBetween(0, min_words - 1)
    back = Window.partitionBy("start", "stretch").orderBy("after").rangeBetween(-(min_words - 1), 0)
    found = (
        stretch.withColumn("e_pos", F.max("pos").over(ahead)).withColumn("e_after", F.max("after").over(ahead))
        .withColumn("s_pos", F.min("pos").over(back)).withColumn("s_before", F.min("before").over(back))
    )
    ends = F.array(
        F.when(F.col("e_after") - F.col("before") >= min_words, F.struct(F.col("pos").alias("pos"), F.col("e_pos").alias("last"))),
        F.when(F.col("after") - F.col("s_before") >= min_words, F.struct(F.col("s_pos").alias("pos"), F.col("pos").alias("last"))),
    )
    runs = found.select("start", F.explode(F.filter(ends, lambda x: x.isNotNull())).alias("x")).select("start", "x.*")
    return materialize(runs.distinct().withColumn("m", F.col("last") - F.col("pos") + 1), "line-runs")


def repeated_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """``(start, first, last)``: shortest runs of ``min_words`` words that occur earlier too, without lines of their first copy."""
    named = materialize(rank_suffixes(lines, ["a", "b"]).select("start", "pos", "w", "rank"), "line-suffixes")
    runs = _shortest_runs(named, min_words)
    deepest = runs.agg(F.max("m")).first()[0]
    if deepest is None:
        return runs.select("start", F.col("pos").alias("first"), "last")
    level = named.select("pos", "rank")
    levels, size = [level.withColumn("level", F.lit(0))], 1
    while size * 2 <= deepest:
        half = level.select((F.col("pos") - size).alias("pos"), F.col("rank").alias("right"))
        both = materialize(level.withColumnRenamed("rank", "left").join(half, "pos"), "line-pairs")
        level = materialize(rank_suffixes(both, ["left", "right"]).select("pos", "rank"), "line-suffixes")
        size *= 2
        levels.append(level.withColumn("level", F.lit(len(levels))))
    ranks = levels[0]
    for x in levels[1:]:
        ranks = ranks.unionByName(x)
    t = sum((F.when(F.col("m") >= 2**k, 1).otherwise(0) for k in range(1, len(levels))), F.lit(0))
    keyed = runs.withColumn("level", t).withColumn("tail", F.col("last") + 1 - F.pow(F.lit(2.0), F.col("level")).cast("long"))
    head = ranks.withColumnRenamed("rank", "left")
    tail = ranks.select("level", F.col("pos").alias("tail"), F.col("rank").alias("right"))
    depth = materialize(keyed.join(head, ["level", "pos"]).join(tail, ["level", "tail"]).select("start", "pos", "last", "m", "left", "right"), "line-depths")
    interval = ["m", "left", "right"]
    intervals = materialize(depth.groupBy(*interval).agg(F.min("pos").alias("origin"), F.count("*").alias("n")).where("n > 1"), "line-intervals")
    # the first copy stays whole, also where a later one begins within it
    later = join_groups(depth, intervals, interval).where("origin < pos").withColumn("first", F.greatest("pos", F.col("origin") + F.col("m")))
    return later.where("first <= last").select("start", "first", "last")


def maximal_runs(runs: DataFrame) -> DataFrame:
    """``(start, first, last)`` of the merged runs of every document: the maximal repeated runs."""
    order = Window.partitionBy("start").orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = runs.withColumn("new", F.coalesce((F.col("first") > reach + 1).cast("int"), F.lit(1)))
    run = fresh.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("start", "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("run")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 50, counts: tuple[str, str] | None = ("_n_lines", "_n_deleted")) -> DataFrame:
    """Delete later copies of line runs of ``min_words`` words or more; adds two ``counts`` (lines, deleted ones).

    "Later" is by (key, hash of the text, line): the first copy of a run in that order stays,
    nulls in the key first, and stays whole (100 equal lines of five words leave ten).  A copy within the same document counts.  Rows that repeat both key
    and text get the same result as their twin.  Null texts stay null, empty ones empty; a
    document whose lines all go keeps an empty text.  Long texts and long stretches of blank lines
    cost in proportion.  All other columns pass through, whatever their names, in their order;
    names in ``counts`` that the table has already get underscores before them (None: no counts).
    """
    places, lines = _positions(docs, key, text)
    d, th, gone, parts = (free_name(docs, x) for x in ("_gone_key", "_gone_text", "_gone", "_parts"))
    per_doc = maximal_runs(repeated_runs(lines, min_words)).groupBy("start").agg(
        F.collect_list(F.struct((F.col("first") - F.col("start")).cast("int").alias("a"), (F.col("last") - F.col("start")).cast("int").alias("b"))).alias(gone)
    )
    found = materialize(places.join(per_doc, "start").select(F.col("d").alias(d), F.col("th").alias(th), gone), "line-gone")
    # the side of the deletions is built in memory a partition at a time; texts are dealt, not sorted
    out = docs.join(found.hint("shuffle_hash"), docs[key].eqNullSafe(found[d]) & (F.xxhash64(docs[text]) == found[th]), "left")
    cut = F.flatten(F.transform(F.col(gone), lambda r: F.sequence(r["a"], r["b"])))
    kept = F.transform(F.array(_lines(F.col(text))), lambda p: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), cut), lambda i: F.get(p, i)), "\n"))
    new = F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.element_at(kept, 1))
    columns = [new.alias(c) if c == text else F.col(c) for c in docs.columns]
    if counts is not None:
        n_lines = F.coalesce(F.regexp_count(F.col(text), F.lit("\n")) + 1, F.lit(0)).cast("long")
        n_gone = F.coalesce(F.aggregate(gone, F.lit(0), lambda n, r: n + r["b"] - r["a"] + 1), F.lit(0)).cast("long")
        columns += [n_lines.alias(free_name(docs, counts[0])), n_gone.alias(free_name(docs, counts[1]))]
    return out.select(*columns)
