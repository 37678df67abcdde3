"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.plans.components import connected_components
from corpusgraph.plans.scratch import materialize, shuffle_partitions
from corpusgraph.plans.skew import free_name, join_groups

SEED = 42
#: Segments (first bit, bits) and the ball radius enumerated in each.  Two fingerprints that
#: differ at 4 bits or fewer are within the radius in a segment: otherwise they would differ at
#: (1+1) + (1+1) + (0+1) = 5 or more.
SEGMENTS = [(0, 22), (22, 21), (43, 21)]
RADII = [1, 1, 0]
MAX_DISTANCE = 4
#: Comparisons (table rows times all rows) from which a bucket is linked through common points.
HOT_WORK = 1 << 26
#: Buckets of so many table rows may flood their neighbours with probes.
HEAVY = 64
#: Probes of one bucket that are held at a time.
HELD_ROWS = 1 << 18


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64 bits; each is set if set in over half of the shingles' XXH64 hashes (repeats counted)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    norm = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(norm, SEED)]
    else:
        ends, at = [], -1
        for w in words:
            at += 1 + len(w)
            ends.append(at)
        starts = [0, *[e + 1 for e in ends[: len(words) - shingle]]]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(norm[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=True)]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        bits = np.unpackbits(np.array(hashes[i : i + 4096], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fp)`` with ``fp`` as a signed long."""

    def scan(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(scan, "doc_id long, fp long")


def _bucket(segment: int, value):
    return value.bitwiseOR(F.lit(segment << 56).cast("long"))


def _part(fp, segment: int):
    first, bits = SEGMENTS[segment]
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _masks(segment: int) -> list[int]:
    """Flips of up to the segment's radius, without none."""
    return [sum(1 << i for i in c) for r in range(1, RADII[segment] + 1) for c in combinations(range(SEGMENTS[segment][1]), r)]


def _table_sizes(reps: DataFrame) -> DataFrame:
    """``(bucket, n)``: table rows of every bucket that has one."""
    tables = F.array(*[_bucket(s, _part(F.col("fp"), s)) for s in range(len(SEGMENTS))])
    return materialize(reps.select(F.explode(tables).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")), "simhash-sizes")


def _occupied(sizes: DataFrame) -> list[np.ndarray | None]:
    """Per probed segment, which values have table rows: one bit a value, whatever the number of rows."""
    word = F.shiftrightunsigned(F.col("bucket").bitwiseAND(F.lit((1 << 56) - 1).cast("long")), 5)
    segment = F.shiftrightunsigned(F.col("bucket"), 56).cast("int")
    bit = F.call_function("shiftleft", F.lit(1), F.col("bucket").bitwiseAND(F.lit(31).cast("long")).cast("int"))
    got = sizes.where(segment.isin([s for s in range(len(SEGMENTS)) if _masks(s)])).groupBy(segment.alias("s"), word.alias("w")).agg(F.bit_or(bit).alias("v")).toArrow()
    s, w, v = (got.column(c).to_numpy() for c in ("s", "w", "v"))
    out: list[np.ndarray | None] = []
    for i, (_, bits) in enumerate(SEGMENTS):
        table = None
        if _masks(i):
            table = np.zeros(1 << (bits - 5), np.uint32)
            table[w[s == i]] = v[s == i].astype(np.int32).view(np.uint32)
        out.append(table)
    return out


def _entries(reps: DataFrame, occupied: list[np.ndarray | None]) -> DataFrame:
    """Table rows (``t`` = 1) of all segments, and probe rows (``t`` = 0) of buckets that have table rows."""
    shared = reps.sparkSession.sparkContext.broadcast(occupied)

    def scan(batches):
        for batch in batches:
            fp, rep = (batch.column(i).to_numpy() for i in range(2))
            for s, (first, bits) in enumerate(SEGMENTS):
                value = (fp.view(np.uint64) >> np.uint64(first)) & np.uint64((1 << bits) - 1)
                yield rows(s, value, np.ones(len(fp), np.int32), fp, rep)
                if shared.value[s] is not None:
                    probe = value[:, None] ^ np.array(_masks(s), np.uint64)[None, :]
                    i, j = np.nonzero((shared.value[s][probe >> np.uint64(5)] >> (probe & np.uint64(31)).astype(np.uint32)) & np.uint32(1))
                    yield rows(s, probe[i, j], np.zeros(len(i), np.int32), fp[i], rep[i])

    def rows(s, value, t, fp, rep):
        bucket = (value | np.uint64(s << 56)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(t), pa.array(fp), pa.array(rep)], names=["bucket", "t", "fp", "rep"])

    return reps.select("fp", "rep").mapInArrow(scan, "bucket long, t int, fp long, rep long")


def _hot_buckets(sizes: DataFrame) -> DataFrame:
    """Buckets whose table rows times all rows, probes included, reach HOT_WORK.

    Probes are counted from the table rows of the buckets they come from: exactly for those of
    heavy buckets, and at most HEAVY for each of the others.
    """
    segment = F.shiftrightunsigned(F.col("bucket"), 56).cast("int")
    near = F.array().cast("array<bigint>")
    for s in range(len(SEGMENTS)):
        if masks := _masks(s):
            near = F.when(segment == s, F.array(*[F.col("bucket").bitwiseXOR(F.lit(m).cast("long")) for m in masks])).otherwise(near)
    probes = sizes.where(F.col("n") >= HEAVY).select(F.explode(near).alias("bucket"), "n").groupBy("bucket").agg(F.sum("n").alias("p"))
    light = HEAVY * max(len(_masks(s)) for s in range(len(SEGMENTS)))
    work = F.col("n") * (F.col("n") + F.coalesce("p", F.lit(0)) + light)
    return materialize(sizes.join(probes, "bucket", "left").where(work > HOT_WORK).select("bucket"), "simhash-hot")


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the classes of a[i] and b[i] in place; a class is named by its least member."""
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return
        a, b = a[differ], b[differ]
        low = np.minimum(la[differ], lb[differ])
        np.minimum.at(label, la[differ], low)
        np.minimum.at(label, lb[differ], low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _link_buckets(bucket: np.ndarray, table: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole buckets (rows sorted by bucket, table rows first): a spanning forest only."""
    n = len(bucket)
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    n_table = np.add.reduceat(table.astype(np.int64), starts)
    place = np.arange(n) - starts[run]
    others = np.minimum(place, n_table[run])  # table rows before it, in its bucket
    label = np.arange(n)
    live = np.flatnonzero(others)
    cum = np.cumsum(others[live])
    i = 0
    while i < len(live):
        j = max(i + 1, int(np.searchsorted(cum, (cum[i - 1] if i else 0) + (1 << 20), "right")))
        rows = live[i:j]
        k = others[rows]
        a = np.repeat(rows, k)
        b = np.repeat(starts[run[rows]], k) + np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k)
        near = np.flatnonzero(np.bitwise_count(fp[a] ^ fp[b]) <= MAX_DISTANCE)
        _union(label, a[near], b[near])
        i = j
    moved = np.flatnonzero(label != np.arange(n))
    return rep[moved], rep[label[moved]]


def _links(entries: DataFrame) -> DataFrame:
    """Verified links within all buckets that are not hot; of a bucket, table rows and HELD_ROWS probes are held."""

    def scan(batches):
        held, n = [], 0
        for batch in batches:
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
            n += batch.num_rows
            if n < HELD_ROWS:
                continue
            rows = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.searchsorted(rows[0], rows[0][-1], "left"))  # the last bucket may go on
            if cut:
                yield out(*[x[:cut] for x in rows])
            rest = [x[cut:] for x in rows]
            if len(rest[0]) >= HELD_ROWS:  # its probes meet its table rows in blocks
                yield out(*rest)
                rest = [x[rest[1] == 1] for x in rest]
            held, n = [rest], 0
        rows = [np.concatenate(x) for x in zip(*held, strict=True)]
        if rows and len(rows[0]):
            yield out(*rows)

    def out(bucket, table, fp, rep):
        a, b = _link_buckets(bucket, table, fp.view(np.uint64), rep)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["src", "dst"])

    n = shuffle_partitions(entries.sparkSession)
    return entries.repartition(n, "bucket").sortWithinPartitions("bucket", F.desc("t")).mapInArrow(scan, "src long, dst long")


def _hot_links(entries: DataFrame) -> DataFrame:
    """Links of hot buckets in time linear in their rows, spread over tasks by the points they name.

    Rows of a bucket are within a radius in its segment.  Table rows name all points within two
    flips in the other bits, probe rows those within one; rows that name a common point differ at
    4 bits or fewer, and any two that do (one of them a table row) name one.  Each is linked to
    the least row at the point, so no pair is enumerated.
    """

    def scan(batches):
        rest = []
        for first, bits in SEGMENTS:
            other = [i for i in range(64) if not first <= i < first + bits]
            ball = [[0], [1 << i for i in other], [(1 << i) | (1 << j) for i, j in combinations(other, 2)]]
            rest.append((np.array(ball[0] + ball[1] + ball[2], np.uint64), 1 + len(other)))
        keep = [~np.uint64(((1 << bits) - 1) << first) for first, bits in SEGMENTS]
        for batch in batches:
            bucket, table, fp, rep = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            for i in range(len(bucket)):
                s = int(bucket[i]) >> 56
                masks, near = rest[s]
                points = ((fp[i : i + 1].view(np.uint64) & keep[s]) ^ (masks if table[i] else masks[:near])).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(points), bucket[i])), pa.array(points), pa.array(np.full(len(points), rep[i]))], names=["bucket", "point", "rep"])

    points = entries.mapInArrow(scan, "bucket long, point long, rep long")
    low = points.groupBy("bucket", "point").agg(F.min("rep").alias("dst"))
    return points.join(low, ["bucket", "point"]).where("rep <> dst").select(F.col("rep").alias("src"), "dst").distinct()


def components(fps: DataFrame) -> DataFrame:
    """``(fp, n, component_id)`` for every distinct fingerprint of ``(doc_id, fp)``, with its rows.

    Copies collapse first (one row per fingerprint, named by its smallest doc_id), so only
    different fingerprints are compared.  A fingerprint of rows without a doc_id links nothing.
    """
    reps = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "simhash-reps")
    named = reps.where("rep is not null")
    sizes = _table_sizes(named)
    entries, hot = _entries(named, _occupied(sizes)), _hot_buckets(sizes)
    if hot.isEmpty():
        links = _links(entries)
    else:
        links = _links(entries.join(hot, "bucket", "left_anti")).union(_hot_links(entries.join(hot, "bucket", "left_semi")))
    linked = connected_components(links)
    return reps.join(linked, reps["rep"] == linked["node"], "left").select("fp", "n", F.coalesce("component", "rep").alias("component_id"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` per document.

    Fingerprints at 4 differing bits or fewer are linked; a component's id is the smallest doc_id
    in it.  Texts without words have the zero fingerprint and link like any other.  Rows with a
    null key get a fingerprint but no component and link nothing.  Repeated rows stay; an empty
    table gives an empty result.
    """
    fps = materialize(fingerprints(docs, key, text), "simhash-fps")
    comp = materialize(components(fps), "simhash-components")
    return join_groups(fps, comp, ["fp"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, with its own columns: the row with the smallest key.

    Where rows share that key, the one with the least text hash stays, whatever their number.  Rows
    with a null key link nothing and all stay.  Columns keep their names and order.
    """
    found = materialize(near_duplicates(docs, key, text).where("doc_id is not null"), "simhash-found")
    gone, twin = free_name(docs, "_gone"), free_name(docs, "_twin")
    # keys are looked up in memory a partition at a time; texts are dealt, not sorted
    dropped = found.where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct().hint("shuffle_hash")
    out = docs.join(dropped, docs[key] == F.col(gone), "left_anti")
    twins = materialize(found.where("doc_id = component_id").groupBy(F.col("doc_id").alias(twin)).agg(F.count("*").alias("n")).where("n > 1").select(twin), "simhash-twins")
    if twins.isEmpty():
        return out
    least = out.join(twins, out[key] == F.col(twin), "left_semi").groupBy(F.col(key).alias(twin)).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(text)).alias(gone))
    return out.join(twins, out[key] == F.col(twin), "left_anti").unionByName(least.select(f"{gone}.*"))
