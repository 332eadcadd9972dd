"""Benchmark decontamination: a broadcast hash set of test windows, verified word by word.

Built from DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, landed, let, query, sized, table, text_key

WINDOW = 10
# Distinct benchmark windows that may be broadcast (some 200 bytes each); beyond it the join shuffles.
BROADCAST_WINDOWS = 1_000_000
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The same separators before A-Z are lower-cased.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased words, in order. Null has none."""
    return F.array_remove(F.split(ascii_lower(text), BREAK, -1), "")


def window_hashes(words: Column, lengths: list[int]) -> Column:
    """Hashes of all runs of consecutive words, by start; first those of ``lengths[0]`` words, and so on.

    Every word is hashed once. A run of 2k words joins the hashes of its two halves, so that all runs
    of ten words take four passes over the array, however long the words are.
    """
    n_words = F.size(words)

    def joined(left: Column, right: Column, by: int) -> Column:
        """Hash of ``left`` at each place with ``right`` that starts ``by`` words later; the tail is void."""
        return F.zip_with(left, F.slice(right, F.lit(by + 1), F.size(right)), lambda x, y: F.xxhash64(x, y))

    def of_length(n: int, power: dict[int, Column]) -> Column:
        bits = [k for k in sorted(power, reverse=True) if n & k]
        run, width = power[bits[0]], bits[0]
        for k in bits[1:]:
            run, width = joined(run, power[k], width), width + k
        return F.slice(run, F.lit(1), F.greatest(n_words - (n - 1), F.lit(0)))

    def powers(power: dict[int, Column]) -> Column:
        last = max(power)
        if 2 * last > max(lengths):
            return F.concat(*[of_length(n, power) for n in lengths])
        return let(joined(power[last], power[last], last), lambda h: powers({**power, 2 * last: h}))

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: powers({1: h}))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``gram, items``: one row per distinct window; a shorter item is one window, an empty one none."""
    words = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("words") - size + 1)
    grams = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, size))).alias("gram"))
    return grams.groupBy("gram").agg(F.collect_set("item_id").alias("items"))


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, key, copies, n_words, hit, items``: one row per distinct (doc_id, text).

    ``hit`` are the 0-based places of words inside any occurrence of a benchmark window, ``items``
    the ids of the items concerned. Text null or without words: no hits. Benchmark empty: no hits.
    Items without id still mark words. Other columns of either table are ignored.

    The windows of a document stay in its own row until the broadcast set has answered them: one
    marker per document and the rows of real hits are all that is shuffled.
    """
    windows = benchmark_windows(benchmark, window).cache()
    try:
        sizes = windows.groupBy(F.size("gram").alias("n")).count().collect()  # at most ``window`` rows
        total = sum(r["count"] for r in sizes)
        lengths = sorted((r.n for r in sizes), reverse=True)
    finally:
        windows.unpersist()
    own_hash = F.lit(None).cast("bigint")
    for n in lengths:
        own_hash = F.when(F.size("gram") == n, window_hashes(F.col("gram"), [n])[0]).otherwise(own_hash)
    windows = windows.select(own_hash.alias("h"), "gram", "items")
    base = docs.select("doc_id", text_key(F.col("text")).alias("key"), words_of(F.col("text")).alias("words"))
    marker = F.array(F.lit(None).cast("bigint"))
    hashes = let(F.col("words"), lambda w: F.concat(marker, window_hashes(w, lengths)) if lengths else marker)
    rows = base.select("doc_id", "key", "words", F.size("words").alias("n_words"), hashes.alias("hashes")).select(
        # The array is never empty; the outer form keeps the optimizer from computing it once more to test that.
        "doc_id", "key", "words", "n_words", F.posexplode_outer("hashes").alias("at", "h")
    )
    # Place in the joined list of windows -> start and length of the window.
    start, length, passed = F.lit(0), F.lit(0), F.lit(1)
    for n in lengths:
        start = F.when(F.col("at") >= passed, F.col("at") - passed).otherwise(start)
        length = F.when(F.col("at") >= passed, F.lit(n)).otherwise(length)
        passed = passed + F.greatest(F.col("n_words") - (n - 1), F.lit(0))
    own = F.slice("words", start + 1, F.greatest(length, F.lit(1)))
    if total <= BROADCAST_WINDOWS:
        # Rows stay where they are; only equal hashes are looked at word by word.
        known, mine = F.broadcast(windows), own
    else:
        # Rows are shuffled, each with its own words only.
        rows = rows.select("doc_id", "key", "n_words", "at", "h", own.alias("own"))
        known, mine = windows, rows["own"]
    # Not written as an equality: that would make the words a join key, cut out and hashed for every window.
    same = (mine >= windows["gram"]) & (mine <= windows["gram"])
    found = (
        rows.join(known, (rows["h"] == windows["h"]) & same, "left")
        .where((F.col("at") == 0) | F.col("gram").isNotNull())
        .select(
            "doc_id", "key", "n_words", (F.col("at") == 0).cast("int").alias("is_doc"), "items",
            F.when(F.col("at") > 0, F.struct(start.alias("s"), length.alias("n"))).alias("run"),
        )
    )
    spread = lambda runs: F.transform(runs, lambda r: F.sequence(r["s"], r["s"] + r["n"] - 1))
    return (
        found.groupBy("doc_id", "key")
        .agg(
            F.sum("is_doc").alias("copies"),
            F.max("n_words").alias("n_words"),
            F.collect_set("run").alias("runs"),
            F.collect_set("items").alias("lists"),
        )
        .select(
            "doc_id", "key", "copies", "n_words",
            F.array_distinct(F.flatten(spread(F.col("runs")))).alias("hit"),
            F.array_distinct(F.flatten("lists")).alias("items"),
        )
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", window: int = WINDOW) -> DataFrame:
    """``docs`` without contaminated documents, or (``mode="spans"``) without the words hit.

    All columns of ``docs`` stay. A removed word goes with the separators before it; what is left
    of the text is kept byte for byte.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode must be documents or spans, not {mode}")
    hits = find_hits(docs, benchmark, window).where(F.size("hit") > 0)
    hits = hits.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.col("hit").alias("__hit"))
    if mode == "documents":
        hits = sized(landed(hits.drop("__hit"), "contaminated"))
    mine = docs["doc_id"].eqNullSafe(hits["__id"]) & (text_key(docs["text"]) == hits["__key"])
    if mode == "documents":
        return docs.join(hits, mine, "left_anti")
    words = F.regexp_extract_all(F.col("text"), F.lit(RAW_WORD), F.lit(0))
    gaps = F.split(F.col("text"), RAW_WORD, -1)
    kept = let(
        F.struct(words.alias("w"), gaps.alias("g"), F.col("__hit").alias("hit")),
        lambda p: F.concat(
            F.array_join(
                F.transform(
                    p["w"],
                    lambda w, i: F.when(F.array_contains(p["hit"], i), "").otherwise(F.concat(F.get(p["g"], i), w)),
                ),
                "",
            ),
            F.element_at(p["g"], -1),
        ),
    )
    joined = docs.join(hits, mine, "left")
    text = F.when(F.col("__hit").isNull(), F.col("text")).otherwise(kept)
    return joined.select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns])


SQL = r"""
WITH low AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t,
         row_number() OVER () AS r FROM documents),
d AS (SELECT r, doc_id, list_filter(regexp_split_to_array(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM low),
b AS (SELECT item_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens)),
hits AS (SELECT dw.r, dw.n, dw.i, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
        FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""


@query("op9_benchmark_decontamination", SQL)
def op9(spark, sf_dir):
    hits = find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    n_hit = F.size("hit").cast("bigint")
    return hits.select(
        "doc_id",
        F.col("n_words").cast("bigint").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")
