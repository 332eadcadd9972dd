"""SimHash near-duplicates, compared bit-sliced: bit planes, carry-save counters, early abandonment."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import landed, query, sized, table, text_key
from .components import connected_components

SHINGLE = 4
RADIUS = 4
SEED = 42
# 64 bits in 6 blocks: fingerprints at 4 or fewer differing bits agree on at least 2 whole blocks.
BLOCKS = 6
# Fingerprints of one bucket compared in one task; a larger bucket is cut into pairs of parts.
BUCKET = 4096
# Buckets up to this size are compared pair by pair in one flat array, larger ones by planes.
SMALL = 16
_CHUNK = 1 << 16
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a whole text; 0 without words. Bits set in exactly half the hashes stay 0."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(len(words) - shingle + 1, 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1))
    view, hashed = memoryview(joined), xxhash.xxh64_intdigest
    ends = ends[min(shingle, len(words)) - 1 :]
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):  # a very long text is counted piece by piece
        spans = zip(starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist(), strict=True)
        h = np.array([hashed(view[s:e], SEED) for s, e in spans], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, key, fp`` (the fingerprint as a signed long), one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64).view(np.int64)
            kept = [batch.column("doc_id"), batch.column("key"), pa.array(fps)]
            yield pa.RecordBatch.from_arrays(kept, ["doc_id", "key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), text_key(F.col("text")).alias("key"), "text")
    return rows.mapInArrow(run, "doc_id long, key string, fp long")


def bit_planes(values: np.ndarray) -> np.ndarray:
    """(64, ceil(n / 64)) words: bit j of word w of plane b is bit b of value 64 w + j."""
    padded = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def planes_within(planes: np.ndarray, flip: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each column of the planes, xor-ed with ``flip`` (one word per plane), one bit: at most ``radius`` set.

    All distances of a block are counted at once: two planes and the ones counter pass a carry-save
    adder, its carry goes to the twos and higher counters. The block is abandoned as soon as
    every distance exceeds the radius. ``radius`` is below 8.
    """
    shape = planes.shape[1:]
    ones, twos, fours, over = (np.zeros(shape, np.uint64) for _ in range(4))
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    beyond = over
    for b in range(0, 64, 2):
        x, y = planes[b] ^ flip[b], planes[b + 1] ^ flip[b + 1]
        half = ones ^ x
        carry = (ones & x) | (half & y)
        ones = half ^ y
        up = twos & carry
        twos = twos ^ carry
        over = over | (fours & up)
        fours = fours ^ up
        if b % 8 == 6:
            beyond = over | _above(fours, twos, ones, radius)
            if (beyond == full).all():
                break
    return ~beyond


def _above(fours, twos, ones, radius):
    """Bits where the counted three-bit number is above ``radius``."""
    above, equal = np.zeros_like(ones), ~np.zeros_like(ones)
    for counter, bit in ((fours, 4), (twos, 2), (ones, 1)):
        if radius & bit:
            equal = equal & counter
        else:
            above = above | (equal & counter)
            equal = equal & ~counter
    return above


def _marked(word_bits: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(word_bits.view(np.uint8), bitorder="little")[:n])


def pairs_within(left: np.ndarray, right: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Places where ``left`` and ``right`` differ in at most ``radius`` bits; blocks of 4096 pairs."""
    none, found = np.zeros(64, np.uint64), []
    for at in range(0, len(left), 4096):
        apart = left[at : at + 4096] ^ right[at : at + 4096]
        found.append(at + _marked(planes_within(bit_planes(apart), none, radius), len(apart)))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def bucket_forest(values: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that join all values within the radius of each other, at most one per value.

    Every value is compared once with all that no tree has reached yet, so a dense group costs
    little and its pairs are never listed.
    """
    links, rest = [], values
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    while len(rest) > 1:
        root, frontier, rest = rest[0], [rest[0]], rest[1:]
        while frontier and len(rest):
            planes = bit_planes(rest)
            again: list[np.uint64] = []
            reached = np.zeros(len(rest), bool)
            for q in frontier:
                flip = np.where(np.unpackbits(np.array([q]).view(np.uint8), bitorder="little") == 1, full, np.uint64(0))
                near = _marked(planes_within(planes, flip, radius), len(rest))
                near = near[~reached[near]]
                reached[near] = True
                again.extend(rest[near])
            links.extend((int(v), int(root)) for v in again)
            frontier, rest = again, rest[~reached]
    return links


def bucket_links(values: np.ndarray, starts: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each bucket; ``values`` are sorted by bucket, ``starts`` are the bucket starts."""
    sizes = np.diff(np.append(starts, len(values)))
    bucket = np.repeat(np.arange(len(starts)), sizes)
    small = np.repeat(sizes <= SMALL, sizes)
    a, b = [], []
    for step in range(1, SMALL):
        at = np.flatnonzero((bucket[step:] == bucket[:-step]) & small[step:]) if step < len(values) else []
        if not len(at):
            break
        at = at[pairs_within(values[at], values[at + step], radius)]
        a.append(values[at])
        b.append(values[at + step])
    for k in np.flatnonzero(sizes > SMALL):
        links = bucket_forest(np.unique(values[starts[k] : starts[k] + sizes[k]]), radius)
        a.append(np.array([x for x, _ in links], np.uint64))
        b.append(np.array([y for _, y in links], np.uint64))
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _bands(blocks: int, radius: int) -> list[int]:
    """Masks of all choices of ``blocks - radius`` whole blocks; a pair within the radius agrees on one."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    masks = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    return [sum(masks[i] for i in keep) for keep in combinations(range(blocks), blocks - radius)]


def near_links(fps: DataFrame, blocks: int = BLOCKS, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """``a, b``: links whose components are those of all distinct ``fp`` within ``radius`` bits.

    A bucket of more than ``bucket`` fingerprints is cut into parts by hash, and every pair of
    parts becomes a bucket of its own: nothing is left out and no task compares more than two parts.
    """
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in _bands(blocks, radius)]
    band = F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)]))
    rows = fps.select("fp", band.alias("at")).select("fp", "at.band", "at.key")
    large = rows.groupBy("band", "key").count().where(F.col("count") > bucket)
    large = large.select("band", "key", F.ceil(F.col("count") / (bucket // 2)).cast("int").alias("parts"))
    rows = rows.join(large, ["band", "key"], "left").select("fp", "band", "key", F.coalesce("parts", F.lit(1)).alias("parts"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    pair = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda d: F.struct(F.least(part, d).alias("lo"), F.greatest(part, d).alias("hi")),
    )
    rows = rows.select("fp", "band", "key", F.inline(pair))
    keys = ["band", "key", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last bucket of a batch may go on in the next
        for batch in batches:
            if not batch.num_rows:
                continue
            block = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("fp", *keys)])
            block = block if held is None else np.concatenate([held, block], axis=1)
            starts = np.flatnonzero(np.append(True, (block[1:, 1:] != block[1:, :-1]).any(axis=0)))
            if len(starts) == 1:
                held = block
                continue
            held = block[:, starts[-1] :]
            yield links(block[0, : starts[-1]], starts[:-1])
        if held is not None:
            yield links(held[0], np.zeros(1, np.int64))

    def links(values, starts):
        a, b = bucket_links(np.ascontiguousarray(values).view(np.uint64), starts, radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def fingerprint_groups(prints: DataFrame) -> DataFrame:
    """``fp, root, component_id``: the group of each fingerprint, and the least doc_id in it."""
    distinct = landed(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "fingerprints")
    nodes = connected_components(near_links(distinct.select("fp")))
    roots = distinct.join(nodes.withColumnRenamed("node", "fp"), "fp", "left")
    roots = roots.select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    return roots.join(lows, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id``, one row per row of ``docs``; other columns are ignored.

    Repeated rows and ids give repeated result rows. Texts that are null or without words have
    fingerprint zero and link as any other. ``component_id`` is the least id that is not null among
    the rows reachable, null if there is none. An empty table gives an empty result.
    """
    prints = landed(fingerprints(docs), "prints")
    return prints.join(fingerprint_groups(prints), "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group: the least doc_id (nulls last), then the least text digest.

    All columns stay. Of rows that repeat both id and text, one stays. The rows to drop are
    anti-joined, so the texts move only where that set is counted as too large to broadcast.
    """
    prints = landed(fingerprints(docs), "prints")
    rows = prints.join(fingerprint_groups(prints), "fp")
    rows = rows.groupBy("root", "doc_id", "key").agg(F.count(F.lit(1)).alias("copies"))
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    first = rows.groupBy("root").agg(F.min(rank).alias("first"))
    rows = rows.join(first, "root").select(
        F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "copies", (rank == F.col("first")).alias("stays")
    )
    rows = sized(landed(rows.where(~F.col("stays") | (F.col("copies") > 1)), "near-copies"))
    mine = docs["doc_id"].eqNullSafe(F.col("__id")) & (text_key(docs["text"]) == F.col("__key"))
    alone = docs.join(rows, mine, "left_anti")
    repeated = docs.join(rows.where("stays"), mine, "left_semi").withColumn("__key", text_key(F.col("text")))
    return alone.union(repeated.dropDuplicates(["doc_id", "__key"]).drop("__key"))


@query("op7_simhash_near_dedup")
def op7(spark, sf_dir):
    groups = near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
