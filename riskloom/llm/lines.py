"""Line dedup: content-defined chunks of lines, of which the first stays.

Built from DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import landed, let, query, table

# The rolling hash over two lines is a polynomial modulo a prime, computed for two halves of the line hashes.
FACTOR, PRIME = 1_000_003, 2**31 - 1
# A line of so many words is a chunk of its own; a chunk of several lines needs the lower number.
LONG_WORDS = 50
CHUNK_WORDS = 12
BREAK = "\n"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), BREAK, -1)


def _words(line: Column) -> Column:
    """Spaces plus one: what a line of words has, at no cost."""
    return F.length(line) - F.length(F.replace(line, F.lit(" "))) + 1


def _key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _same(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["key"] == right["key"])


def _lanes(h: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(h, 33), h.bitwiseAND(F.lit(PRIME))


def _rolled(before: Column, h: Column) -> Column:
    """The rolling hash moved on by one line: two polynomials modulo a prime, side by side in one number."""
    high, low = ((x * FACTOR + y) % PRIME for x, y in zip(_lanes(before), _lanes(h), strict=True))
    return F.shiftleft(high, 31) + low


def line_pairs(docs: DataFrame) -> DataFrame:
    """``doc_id, key, pos, pair, last, next, words, next_words``: every line and the one after it, as hashes.

    ``pair`` is the rolling hash over both, ``last`` and ``next`` are the hashes of the lines around them (null at the ends).
    """
    rolled = let(
        F.transform(_lines(F.col("text")), lambda x: F.struct(F.xxhash64(x).alias("h"), _words(x).cast("int").alias("w"))),
        lambda line: F.transform(
            F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0))),
            lambda x, i: F.struct(
                _rolled(x["h"], F.get(line, i + 1)["h"]).alias("pair"),
                F.get(line, i - 1)["h"].alias("last"),
                F.get(line, i + 2)["h"].alias("next"),
                x["w"].alias("words"),
                F.get(line, i + 1)["w"].alias("next_words"),
            ),
        ),
    )
    rows = docs.select("doc_id", _key(F.col("text")).alias("key"), F.posexplode(rolled).alias("pos", "x"))
    return rows.select("doc_id", "key", "pos", "x.*")


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """``doc_id, key, start, n_lines, hash, owner``: chunks of lines that occur more than once.

    A boundary stands between two pairs of lines where the rolling hash shows that one of them also occurs without the
    other, anywhere. So boundaries follow from what the lines are, never from where they stand: a passage that
    repeats is cut in the same way in every place, whatever is around it, and every place of a chunk is whole.
    Neighbouring chunks share a line. A line of ``LONG_WORDS`` words is a chunk of its own as well.
    ``owner`` marks the first place of the chunk, by doc_id (nulls last), text digest and line.

    Lines travel as hashes. Counts are combined before the shuffle; pairs that occur once go no further.
    """
    rows = line_pairs(docs)
    around = lambda c: F.coalesce(F.min(c) != F.max(c), F.lit(False)) | (F.count(c).between(1, F.count(F.lit(1)) - 1))
    pairs = rows.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), around("last").alias("opens"), around("next").alias("closes"))
    # A table of its own: the join then shuffles anew and may split the rows of a frequent pair.
    pairs = landed(pairs.where("n > 1").drop("n"), "repeated-pairs")
    rows = rows.drop("last", "next").join(pairs, "pair").dropDuplicates(["doc_id", "key", "pos"])
    place = Window.partitionBy("doc_id", "key").orderBy("pos")
    apart = F.coalesce(F.col("pos") != F.lag("pos").over(place) + 1, F.lit(True))
    cut = F.col("opens") | apart | F.coalesce(F.lag("closes").over(place), F.lit(False))
    rows = rows.select("*", cut.cast("int").alias("cut"))
    chunk = F.sum("cut").over(place.rowsBetween(Window.unboundedPreceding, 0)).alias("chunk")
    rows = rows.select("doc_id", "key", chunk, "pos", "pair", "words", "next_words")
    chunks = (
        rows.groupBy("doc_id", "key", "chunk")
        .agg(
            F.min("pos").alias("start"),
            (F.count(F.lit(1)) + 1).cast("int").alias("n_lines"),
            (F.sum("words") + F.max_by("next_words", "pos")).alias("words"),
            F.array_sort(F.collect_list(F.struct("pos", "pair"))).alias("body"),
        )
        .where(F.col("words") >= CHUNK_WORDS)
        .select("doc_id", "key", "start", "n_lines", F.unhex(F.md5(F.array_join(F.col("body.pair").cast("array<string>"), ","))).alias("hash"))
    )
    long = docs.select("doc_id", _key(F.col("text")).alias("key"), F.posexplode(_lines(F.col("text"))).alias("start", "line"))
    long = long.where(_words(F.col("line")) >= LONG_WORDS).select("doc_id", "key", "start", F.lit(1).alias("n_lines"), _key(F.col("line")).alias("hash"))
    chunks = landed(chunks.union(long.dropDuplicates(["doc_id", "key", "start"])), "line-chunks")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "key", "start")
    first = chunks.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("first")).where("n > 1")
    return chunks.join(first, "hash").select(
        "doc_id", "key", "start", "n_lines", "hash", (rank == F.col("first")).alias("owner")
    )


def removals(docs: DataFrame) -> DataFrame:
    """``doc_id, key, cuts, kept`` (start and n_lines): chunks to remove, compared byte by byte with the one that stays,
    and the chunks that stay here."""
    plan = landed(repeated_chunks(docs), "repeated-chunks")
    per = plan.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "n_lines", "hash", "owner")).alias("at"))
    own = docs.select("doc_id", _key(F.col("text")).alias("key"), "text")
    bodies = own.join(per, _same(own, per)).select(
        own["doc_id"],
        own["key"],
        F.inline(
            let(
                F.struct(_lines(F.col("text")).alias("lines"), F.col("at").alias("at")),
                lambda d: F.transform(
                    d["at"],
                    lambda c: F.struct(
                        c["start"].alias("start"),
                        c["n_lines"].alias("n_lines"),
                        c["hash"].alias("hash"),
                        c["owner"].alias("owner"),
                        F.array_join(F.slice(d["lines"], c["start"] + 1, c["n_lines"]), BREAK).alias("body"),
                    ),
                ),
            )
        ),
    )
    bodies = landed(bodies, "chunk-bodies")
    # A repeated row brings its own chunks again; one of each is enough.
    kept = bodies.where("owner").select("hash", F.col("body").alias("kept")).dropDuplicates(["hash"])
    equal = bodies.where("NOT owner").join(kept, "hash").where(F.col("body") == F.col("kept"))
    place = F.struct("start", "n_lines")
    gone = equal.select("doc_id", "key", place.alias("cut"), F.lit(None).cast("struct<start:int,n_lines:int>").alias("stay"))
    here = bodies.where("owner").select("doc_id", "key", F.lit(None).cast("struct<start:int,n_lines:int>"), place)
    return gone.union(here).groupBy("doc_id", "key").agg(F.collect_set("cut").alias("cuts"), F.collect_set("stay").alias("kept"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` rid of repeated chunks, and ``n_lines, n_removed``.

    The first place of every chunk stays whole: what overlaps it is cut around it. All other columns of ``docs`` stay
    too, but for those with one of our names. Null texts stay null; a text whose lines all go is empty;
    rows that repeat both id and text are one place and share their result. Of equal places the one of least
    doc_id (null last), then of least text digest, then the earlier line is the first. An empty table gives an empty
    result.
    """
    rest = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return cut_lines(docs, "n_lines", "n_removed").select(*rest, "n_lines", "n_removed")


def cut_lines(docs: DataFrame, total: str, removed: str) -> DataFrame:
    """``docs`` with texts cut as in ``dedup_lines``, and columns of the given names for lines before and lines removed."""
    found = removals(docs)
    found = found.select(*[F.col(c).alias(f"__{c}") for c in ("doc_id", "key", "cuts", "kept")])
    joined = docs.join(found, docs["doc_id"].eqNullSafe(found["__doc_id"]) & (_key(docs["text"]) == found["__key"]), "left")
    within = lambda places, i: F.exists(places, lambda c: (i >= c["start"]) & (i < c["start"] + c["n_lines"]))
    left = let(
        F.struct(_lines(docs["text"]).alias("lines"), F.col("__cuts").alias("cuts"), F.col("__kept").alias("kept")),
        lambda d: F.filter(d["lines"], lambda _, i: ~within(d["cuts"], i) | within(d["kept"], i)),
    )
    size = F.size(_lines(docs["text"])).cast("long")
    rows = joined.select(
        *[docs[c] for c in docs.columns if c not in (total, removed)],
        size.alias(total),
        F.when(F.col("__cuts").isNotNull() & (F.size("__cuts") > 0), left).alias("__left"),
    )
    text = F.when(F.col("__left").isNull(), F.col("text")).otherwise(F.array_join("__left", BREAK))
    gone = F.when(F.col("__left").isNull(), 0).otherwise(F.col(total) - F.size("__left")).cast("long")
    return rows.select(*[text.alias("text") if c == "text" else c for c in rows.columns if c != "__left"], gone.alias(removed))


SQL = f"""
WITH raw AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
lines AS (SELECT r, doc_id, t, unnest(string_split(t, chr(10))) AS line,
                 unnest(range(len(string_split(t, chr(10))))) AS pos FROM raw),
one AS (SELECT DISTINCT doc_id, t, line, pos, length(line) - length(replace(line, ' ', '')) + 1 AS words FROM lines),
pairs AS (SELECT *, lag(line) OVER p AS before, lead(line) OVER p AS b, lead(line, 2) OVER p AS after,
                 lead(words) OVER p AS b_words
          FROM one WINDOW p AS (PARTITION BY doc_id, t ORDER BY pos)),
often AS (SELECT line, b, count(DISTINCT before) + (count(before) < count(*))::INT > 1 AS opens,
                 count(DISTINCT after) + (count(after) < count(*))::INT > 1 AS closes
          FROM pairs WHERE b IS NOT NULL GROUP BY line, b HAVING count(*) > 1),
w AS (SELECT doc_id, t, pos, line, b, words, b_words, opens, closes FROM pairs JOIN often USING (line, b)),
x AS (SELECT *, opens OR coalesce(pos <> lag(pos) OVER p + 1, true) OR coalesce(lag(closes) OVER p, false) AS cut
      FROM w WINDOW p AS (PARTITION BY doc_id, t ORDER BY pos)),
z AS (SELECT *, sum(cut::INT) OVER (PARTITION BY doc_id, t ORDER BY pos ROWS UNBOUNDED PRECEDING) AS chunk FROM x),
chunks AS (SELECT doc_id, t, min(pos) AS start, count(*) + 1 AS n,
                  concat(string_agg(line, chr(10) ORDER BY pos), chr(10), max_by(b, pos)) AS body
           FROM z GROUP BY doc_id, t, chunk HAVING sum(words) + max_by(b_words, pos) >= {CHUNK_WORDS}
           UNION ALL SELECT doc_id, t, pos, 1, line FROM one WHERE words >= {LONG_WORDS}),
placed AS (SELECT doc_id, t, start, n,
                  row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS LAST, md5(t), start) AS k,
                  count(*) OVER (PARTITION BY body) AS places FROM chunks),
covered AS (SELECT DISTINCT doc_id, t, k = 1 AS stays, unnest(range(start, start + n)) AS pos FROM placed WHERE places > 1),
gone AS (SELECT doc_id, t, pos FROM covered GROUP BY doc_id, t, pos HAVING NOT bool_or(stays)),
kept AS (SELECT r, string_agg(line, chr(10) ORDER BY pos) AS body, count(*) AS n FROM lines l
         WHERE NOT EXISTS (SELECT 1 FROM gone c WHERE c.doc_id IS NOT DISTINCT FROM l.doc_id AND c.t = l.t AND l.pos = c.pos)
         GROUP BY r)
SELECT doc_id, CAST(len(string_split(t, chr(10))) AS BIGINT) AS n_lines,
       CAST(len(string_split(t, chr(10))) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(body, '')) AS text_sha256
FROM raw LEFT JOIN kept USING (r)
"""


@query("op6_line_dedup", SQL)
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2(text, 256).alias("text_sha256"))
