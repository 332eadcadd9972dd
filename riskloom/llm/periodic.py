"""Periodic runs of words: split at rare words until stable, then scan lags in what is left."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, let, query, table

# A run has at least so many words, and at least so many times its period.
LEAST_WORDS = 6
LEAST_PERIODS = 4
# First reach of a comparison that grows from a place.
REACH = 64

Run = tuple[int, int, int]  # start, length, period


def segments(codes: np.ndarray) -> Iterator[tuple[int, int]]:
    """``start, end`` of the stretches that can hold runs, in order.

    A word of a run occurs ``LEAST_PERIODS`` times in it at least, so a word that is rarer within a
    stretch is in no run there, and the stretch falls apart at it. What is left is counted again.
    """
    todo = [(0, len(codes))]
    while todo:
        start, end = todo.pop()
        if end - start < LEAST_WORDS:
            continue
        part = codes[start:end]
        _, place, count = np.unique(part, return_inverse=True, return_counts=True)
        rare = np.flatnonzero(count[place] < LEAST_PERIODS)
        if not len(rare):
            yield start, end
            continue
        starts = np.concatenate(([0], rare + 1))
        ends = np.concatenate((rare, [end - start]))
        wide = np.flatnonzero(ends - starts >= LEAST_WORDS)[::-1]
        todo.extend((start + int(starts[k]), start + int(ends[k])) for k in wide)


def _ahead(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading places of ``a`` and ``b`` are equal."""
    at, reach = 0, REACH
    while at < len(a):
        differ = a[at : at + reach] != b[at : at + reach]
        if differ.any():
            return at + int(differ.argmax())
        at, reach = at + reach, reach * 2
    return len(a)


def scan(codes: np.ndarray) -> list[Run]:
    """Runs of one segment, by period and start.

    A run of period q has equal words q apart at 3 q places in a row, three of which are multiples of
    q; so lag q looks at every q-th place only, and goes on from three equal ones in a row. A stretch that
    keeps lag q but has a smaller period p is a run of p, p divides q, and has been found before; it holds both ends of
    the lag.
    """
    found: list[Run] = []
    n = len(codes)
    for q in range(1, n // LEAST_PERIODS + 1):
        every = codes[::q]
        same = every[1:] == every[:-1]
        if len(same) < LEAST_PERIODS - 1:
            break
        three = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
        if not len(three):
            continue
        known = [(s, s + length) for s, length, p in found if q % p == 0 and length > q]
        places = three * q
        for s, e in known:
            places = places[(places < s) | (places + q >= e)]
        upto = -1
        for at in places.tolist():
            if at < upto:
                continue
            end = at + q + _ahead(codes[at : n - q], codes[at + q :])
            start = at - _ahead(codes[:at][::-1], codes[q : at + q][::-1])
            upto = end - q
            if end - start >= max(LEAST_WORDS, LEAST_PERIODS * q):
                found.append((start, end - start, q))
    return found


def runs_of(words: list[bytes]) -> list[Run]:
    """``start, length, period`` of every run of ``words``, by start, then period."""
    often = Counter(words)
    often = {w: k for k, w in enumerate(w for w, c in often.items() if c >= LEAST_PERIODS)}
    if not often:
        return []
    # Words that are rare in the whole text differ from everything, themselves included.
    codes = np.fromiter((often.get(w, -1 - i) for i, w in enumerate(words)), np.int64, len(words))
    found = [(start + s, length, q) for start, end in segments(codes) for s, length, q in scan(codes[start:end])]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    keep = np.cumsum(edge[:-1]) == 0
    return [words[i] for i in np.flatnonzero(keep).tolist()]


_SCHEMA = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, runs, collapsed`` for every row of ``docs``.

    Words are what stands between ASCII white space. ``runs`` (start, length, period, by start, then period) are
    the longest stretches that keep a smallest period q over ``max(6, 4 q)`` words at least; ``collapsed`` is the
    text without what runs hold after their first period, its words joined by one space. Null and empty
    texts have no runs and collapse to an empty text; repeated rows give repeated result rows; a null
    doc_id stays null; other columns are ignored; an empty table gives an empty result.

    Every row is looked at alone, so nothing is shuffled. Time grows with n log n of the words of a text, and with
    the length of its runs.
    """
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, texts = [], []
            for text in batch.column("text"):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                some = runs_of(words)
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in some])
                texts.append(b" ".join(collapsed(words, some)).decode())
            columns = [batch.column("doc_id"), pa.array(runs, pa.list_(_RUN)), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _SCHEMA)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` where a tenth of the documents, chosen by the checksum of their id, repeat their words from
    some word on. Null ids and texts without words are left as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+", -1), "")

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.when(
            n > 0,
            F.array_join(
                F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " "
            ),
        )

    planted = F.when(h % 10 == 0, let(words, repeated))
    return docs.select("doc_id", F.coalesce(planted, F.col("text")).alias("text"))


SQL = r"""
WITH raw AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
           lambda c, b: list_reduce(range(8), lambda s, i: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END,
                                    xor(c, b)), CAST(4294967295 AS BIGINT)) AS c
  FROM documents),
hashed AS (SELECT r, doc_id, w, len(w) AS n, xor(c, 4294967295) AS h FROM raw),
cut AS (SELECT *, (h // 10) % n AS a, 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) AS p FROM hashed),
d AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
        THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END)
        ELSE w END AS w FROM cut),
-- Every q-th word: a run of period q has four equal ones in a row.
lags AS (SELECT r, w, n, unnest(range(1, n // 4 + 1)) AS q FROM d WHERE n >= 6),
steps AS (SELECT r, q FROM (SELECT r, w, q, unnest(range(0, n - 3 * q, q)) AS i FROM lags)
         WHERE w[i + 1] = w[i + q + 1] AND w[i + 1] = w[i + 2 * q + 1] AND w[i + 1] = w[i + 3 * q + 1]
         GROUP BY r, q),
same AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g
         FROM (SELECT r, q, w, unnest(range(0, n - q)) AS i FROM steps JOIN d USING (r))
         WHERE w[i + 1] = w[i + q + 1]),
kept AS (SELECT r, min(i) AS s, count(*) + q AS len, q FROM same GROUP BY r, q, g
         HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT r, s, len, min(q) AS q FROM kept GROUP BY r, s, len),
told AS (SELECT r, count(*) AS n_runs, max_by(struct_pack(s := s, len := len, q := q), struct_pack(l := len, s := -s, q := -q)) AS top,
                string_agg(concat(s, ',', len, ',', q, chr(10)), '' ORDER BY s, q) AS body
         FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + len)) AS i FROM runs),
words AS (SELECT r, unnest(w) AS x, unnest(range(n)) AS i FROM d),
left_over AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS body FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, top.len AS length, top.q AS period,
       1000 * top.len // top.q AS exponent_milli, sha256(coalesce(told.body, '')) AS runs_sha256,
       sha256(coalesce(left_over.body, '')) AS collapsed_sha256
FROM d LEFT JOIN told USING (r) LEFT JOIN left_over USING (r)
"""


@query("op12_periodic_runs", SQL)
def op12(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs(with_planted_runs(docs))
    # Longest first; among equals the earlier start, then the smaller period, which is the order they come in.
    longest = F.aggregate(
        F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))),
        F.get("runs", F.lit(0)),
        lambda best, x: F.when(x["length"] > best["length"], x).otherwise(best),
    )
    text = F.transform("runs", lambda x: F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")))
    lines = F.array_join(F.transform(text, lambda x: F.concat(x, F.lit("\n"))), "")
    return found.select("doc_id", "runs", longest.alias("top"), F.sha2(lines, 256).alias("runs_sha256"), "collapsed").select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("top.start").alias("start"),
        F.col("top.length").alias("length"),
        F.col("top.period").alias("period"),
        F.floor(F.lit(1000) * F.col("top.length") / F.col("top.period")).alias("exponent_milli"),
        "runs_sha256",
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
