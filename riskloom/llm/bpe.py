"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside each partition."""

from __future__ import annotations

import base64
import ctypes
import gc
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, query, table

VOCABULARY = "byte_bpe_50k.tiktoken"
# Pieces per recursive query, tokens per decoding query, characters per group of texts, remembered chunks
# per worker while it encodes and after a partition: memory bounds only, no text is cut short by them.
PIECES = 25_000
TOKENS = 250_000
GROUP_CHARS = 500_000
SLICE_CHARS = 1_000_000
REMEMBERED = 200_000
LEFT = 50_000
# Pieces of more bytes than this take the query that contracts many equal pairs at once; the ids are the same.
LONG_PIECE = 64

# Every row knows its successor (place and token). A round looks up the rank of each pair, takes the
# least rank of each word at its leftmost place, and contracts that one pair; words without any pair left are done.
# Rank, place and successor's place are one number, so the least of a word names all three.
_ENCODE = """
WITH RECURSIVE step(word, pos, tok, next_pos, next_tok, live) AS (
  SELECT word, pos, tok, next_pos, next_tok, true FROM pieces
  UNION ALL
  (WITH best AS MATERIALIZED (
     SELECT s.word, min(m.merged::BIGINT * 1099511627776 + s.pos::BIGINT * 1048576 + s.next_pos) AS least
     FROM step s JOIN merges m ON m.pair = s.tok::BIGINT * 4194304 + s.next_tok WHERE s.live GROUP BY s.word),
   pick AS MATERIALIZED (
     SELECT b.word, ((least >> 20) & 1048575)::INT AS place, r.pos AS gone, (least >> 40)::INT AS merged, r.next_pos, r.next_tok
     FROM best b JOIN step r ON r.word = b.word AND r.pos = (least & 1048575)::INT)
   SELECT r.word, r.pos,
     CASE WHEN r.pos = p.place THEN p.merged ELSE r.tok END,
     CASE WHEN r.pos = p.place THEN p.next_pos ELSE r.next_pos END,
     CASE WHEN r.pos = p.place THEN p.next_tok WHEN r.next_pos = p.place THEN p.merged ELSE r.next_tok END,
     p.place IS NOT NULL
   FROM step r LEFT JOIN pick p ON p.word = r.word
   WHERE r.live AND r.pos IS DISTINCT FROM p.gone)
)
"""
# The same for long pieces: all non-overlapping places of the least pair are contracted in one round,
# unless a token made from the merged one has a lower rank; then only the leftmost place is.
_ENCODE_LONG = """
WITH RECURSIVE step(word, pos, tok, live) AS (
  SELECT word, pos, tok, true FROM pieces
  UNION ALL
  (WITH pairs AS (
     SELECT word, pos, tok, lead(tok) OVER (PARTITION BY word ORDER BY pos) AS next_tok FROM step WHERE live),
   ranked AS (
     SELECT p.word, p.pos, p.tok, m.merged, m.bulk
     FROM pairs p LEFT JOIN merges m ON m.pair = p.tok::BIGINT * 4194304 + p.next_tok),
   best AS (SELECT *, min(merged) OVER (PARTITION BY word) AS least FROM ranked),
   placed AS (
     SELECT word, pos, tok, least, bulk, coalesce(merged = least, false) AS hit,
       row_number() OVER w AS k, sum(coalesce(merged = least, false)::INT) OVER w AS nth
     FROM best WINDOW w AS (PARTITION BY word ORDER BY pos ROWS UNBOUNDED PRECEDING)),
   runs AS (
     SELECT *, k - coalesce(max(CASE WHEN NOT hit THEN k END)
       OVER (PARTITION BY word ORDER BY pos ROWS UNBOUNDED PRECEDING), 0) AS in_run FROM placed),
   taken AS (
     SELECT word, pos, tok, least, hit AND CASE WHEN bulk THEN in_run % 2 = 1 ELSE nth = 1 END AS take FROM runs),
   gone AS (SELECT *, lag(take, 1, false) OVER (PARTITION BY word ORDER BY pos) AS eaten FROM taken)
   SELECT word, pos, CASE WHEN take THEN least ELSE tok END, least IS NOT NULL FROM gone WHERE NOT eaten)
)
"""
_COLLECT = """
SELECT word, tok FROM step WHERE NOT live ORDER BY word, pos
"""
# Ordered aggregation: the bytes of a row of ids put together again.
_DECODE = """
SELECT unhex(string_agg(v.hex, '' ORDER BY pos)) AS bytes, count(*) AS n FROM tokens JOIN vocabulary v USING (id)
"""

Value = tuple[bytes, bytes]  # int32 ids, decoded bytes


class Spans:
    """Rows of values of one type, each as long as it is, kept end to end."""

    def __init__(self, kind: type):
        self.flat, self.starts, self.sizes = np.zeros(0, kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def put(self, rows: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Sets ``rows``, whose values stand in ``flat`` one row after another."""
        if len(rows) and (more := int(rows.max()) + 1 - len(self.starts)) > 0:
            self.starts = np.append(self.starts, np.zeros(more, np.int64))
            self.sizes = np.append(self.sizes, np.zeros(more, np.int64))
        self.starts[rows] = len(self.flat) + np.cumsum(sizes) - sizes
        self.sizes[rows] = sizes
        self.flat = np.concatenate([self.flat, flat])

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of ``rows`` one row after another, and their number in each."""
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        shift = np.repeat(self.starts[rows] - ends + sizes, sizes)
        return self.flat[shift + np.arange(len(shift))], sizes


class Names(dict):
    """Row numbers of strings. A string asked for the first time gets the next number and is listed in ``new``."""

    def __init__(self, names: list[str]):
        super().__init__(zip(names, range(len(names)), strict=True))
        self.new: list[str] = []

    def __missing__(self, name: str) -> int:
        self.new.append(name)
        self[name] = row = len(self)
        return row

    def rows(self, names: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, names), np.int64, len(names))


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


class Engine:
    """Merge table and vocabulary of one file in a private DuckDB, with the chunks met last and most often."""

    def __init__(self, blob: bytes, pattern: str):
        import duckdb
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines()) if a}
        self.split = regex.compile(pattern).findall
        # With the usual pattern, Latin letters after at most one space are one match.
        self.whole = _LATIN_WORD if r"| ?\p{L}+|" in pattern else (lambda chunk: None)
        rows, lower = [], set()
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    rows.append((left, right, rank))
                lower.update(x for x in (left, right) if x is not None and x > rank)
        left, right, merged = np.array(rows or np.zeros((0, 3)), np.int64).T
        bulk = ~np.isin(merged, list(lower))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": ""})
        merges = pa.table({"pair": left * 4194304 + right, "merged": merged.astype(np.int32), "bulk": bulk})
        words = pa.table(
            {"id": pa.array(list(self.ranks.values()), pa.int32()), "hex": [t.hex() for t in self.ranks]}
        )
        for name, rows in (("merges", merges), ("vocabulary", words)):
            self.db.register("given", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.size = np.zeros(max(self.ranks.values()) + 1, np.int64)
        self.size[list(self.ranks.values())] = list(map(len, self.ranks))
        self.forget()

    def _query(self, sql: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``words`` one after another, and their number in each; each has at least one byte."""
        data = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        pos = np.arange(len(data)) - np.repeat(starts, sizes)
        tok = self.byte[data]
        last = pos == np.repeat(sizes, sizes) - 1
        pieces = pa.table(
            {
                "word": word,
                "pos": pos.astype(np.int32),
                "tok": tok,
                "next_pos": np.where(last, -1, pos + 1).astype(np.int32),
                "next_tok": np.where(last, -1, np.append(tok[1:], -1)).astype(np.int32),
            }
        )
        self.db.register("pieces", pieces)
        got = self.db.sql(sql + _COLLECT).to_arrow_table()
        self.db.unregister("pieces")
        return got["tok"].to_numpy().astype(np.int32), np.bincount(got["word"].to_numpy(), minlength=len(words))

    def encode_pieces(self, rows: np.ndarray, pieces: list[bytes]) -> None:
        """Sets the ids of distinct pieces. A piece that is a token is that token."""
        ranks = [self.ranks.get(p, -1) for p in pieces]
        rank, sizes = np.array(ranks, np.int32), np.fromiter(map(len, pieces), np.int64, len(pieces))
        token = rank >= 0
        self.ids.put(rows[token], rank[token], np.ones(int(token.sum()), np.int64))
        long = ~token & (sizes > LONG_PIECE)
        for sql, which, some in ((_ENCODE, ~token & ~long, PIECES), (_ENCODE_LONG, long, 1000)):
            places, at = np.flatnonzero(which), 0
            total = np.cumsum(sizes[places])
            while at < len(places):
                before = int(total[at] - sizes[places[at]])
                end = min(at + some, max(at + 1, int(np.searchsorted(total, before + 32 * PIECES))))
                part = places[at:end]
                self.ids.put(rows[part], *self._query(sql, [pieces[k] for k in part.tolist()]))
                at = end

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids in a row. An id outside the vocabulary is an error."""
        out = []
        for at in range(0, len(ids), TOKENS):
            part = ids[at : at + TOKENS]
            self.db.register("tokens", pa.table({"pos": np.arange(len(part)), "id": part}))
            decoded, n = self.db.sql(_DECODE).fetchall()[0]
            self.db.unregister("tokens")
            if n != len(part):
                raise ValueError("an id is not in the vocabulary")
            out.append(decoded)
        return b"".join(out)

    def learn(self) -> None:
        """Sets ids and decoded bytes of the chunks met for the first time."""
        fresh, first = self.names.new, len(self.names) - len(self.names.new)
        # One chunk may hold several matches of the pattern: " word," is two.
        cut, parts = [], []
        for row, chunk in enumerate(fresh, first):
            if not self.whole(chunk) and len(some := self.split(chunk)) > 1:
                cut.append(row)
                parts.append(some)
        pieces = self.names.rows([p for some in parts for p in some])
        rows = np.setdiff1d(np.arange(first, len(self.names)), cut, assume_unique=True)
        self.encode_pieces(rows, [fresh[row - first].encode() for row in rows.tolist()])
        # What is remembered next to the ids is what they decode to, so a text's bytes are those of its ids.
        ids, sizes = self.ids.of(rows)
        decoded = np.frombuffer(self.decode(ids), np.uint8)
        self.decoded.put(rows, decoded, _sums(self.size[ids], sizes))
        for kept in (self.ids, self.decoded):
            flat, sizes = kept.of(pieces)
            kept.put(np.array(cut, np.int64), flat, _sums(sizes, list(map(len, parts))))
        self.names.new = []
        self.uses = np.append(self.uses, np.zeros(len(self.names) - len(self.uses), np.int64))
        self.uses += np.bincount(pieces, minlength=len(self.uses))

    def forget(self, kept: np.ndarray | None = None) -> None:
        """Forgets all chunks but those of the rows ``kept``, whose uses then count half."""
        names, ids, decoded, uses = Names([]), Spans(np.int32), Spans(np.uint8), np.zeros(0, np.int64)
        if kept is not None:
            every, rows = list(self.names), np.arange(len(kept))
            names = Names([every[row] for row in kept.tolist()])
            ids.put(rows, *self.ids.of(kept))
            decoded.put(rows, *self.decoded.of(kept))
            uses = self.uses[kept] // 2
        self.names, self.ids, self.decoded, self.uses = names, ids, decoded, uses

    def shrink(self, most: int) -> None:
        """Forgets all chunks but those met most often, ``most`` at most, and more than once."""
        often = np.argsort(-self.uses, kind="stable")[:most]
        self.forget(np.sort(often[self.uses[often] > 1]))

    def encode(self, texts: list[str]) -> list[Value]:
        """Ids (int32 bytes) and decoded bytes of whole texts."""
        ids, n_ids, decoded, n_bytes = self.encoded(texts)
        a, b = np.append(0, np.cumsum(n_ids)), np.append(0, np.cumsum(n_bytes))
        return [(ids[a[k] : a[k + 1]].tobytes(), decoded[b[k] : b[k + 1]].tobytes()) for k in range(len(texts))]

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of whole texts one after another, their number in each text; decoded bytes, and their number."""
        ids, decoded = [np.zeros(0, np.int32)], [np.zeros(0, np.uint8)]
        n_ids, n_bytes = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        chunks, owners, counts, chars = [], [], [], 0

        def flush() -> None:
            if len(self.names) > REMEMBERED:
                self.shrink(REMEMBERED // 2)
            rows = self.names.rows(chunks)
            self.learn()
            self.uses += np.bincount(rows, minlength=len(self.uses))
            for kept, out, n in ((self.ids, ids, n_ids), (self.decoded, decoded, n_bytes)):
                flat, sizes = kept.of(rows)
                out.append(flat)
                np.add.at(n, owners, _sums(sizes, counts))

        gc.disable()  # nothing here makes cycles, and scanning the remembered chunks costs more than the work
        for k, text in enumerate(texts):
            for piece in _slices(text):
                some = self.chunked(piece)
                chunks += some
                owners.append(k)
                counts.append(len(some))
                chars += len(piece)
                if chars >= GROUP_CHARS:
                    flush()
                    chunks, owners, counts, chars = [], [], [], 0
        if chunks:
            flush()
        gc.enable()
        return np.concatenate(ids), n_ids, np.concatenate(decoded), n_bytes

    def chunked(self, text: str) -> list[str]:
        """The text cut before spaces that stand between two other characters that aren't white space.

        No match of the pattern crosses such a place, and none looks across it. Where any other
        white space meets a space, the matches themselves are the chunks.
        """
        if text[:1] == " " or text[-1:] == " " or _SPACE_THEN(text) or _OTHER_THEN_SPACE(text):
            return self.split(text)
        parts = text.split(" ")
        return [p for p in parts[:1] if p] + [" " + p for p in parts[1:]]


def _sums(values: np.ndarray, counts: np.ndarray | list[int]) -> np.ndarray:
    """Sums of the first ``counts[0]`` values, the next ``counts[1]`` and so on."""
    total = np.append(0, np.cumsum(values))
    ends = np.append(0, np.cumsum(counts)).astype(np.int64)
    return total[ends[1:]] - total[ends[:-1]]


_LATIN_WORD = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ɏ]+").fullmatch
_SPACE_THEN = re.compile(r" \s").search
_OTHER_THEN_SPACE = re.compile(r"[^\S ] ").search
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_ENGINES: dict[str, Engine] = {}


def _slices(text: str) -> Iterator[str]:
    """A very long text in parts that can be encoded alone."""
    at = 0
    while len(text) - at > SLICE_CHARS and (cut := _SAFE.search(text, at + SLICE_CHARS)):
        yield text[at : cut.start()]
        at = cut.start()
    if at < len(text):
        yield text[at:]


def engine(blob: bytes, pattern: str) -> Engine:
    """One engine per Python worker; workers are reused from task to task."""
    name = hashlib.sha256(blob + pattern.encode()).hexdigest()
    if name not in _ENGINES:
        _ENGINES.clear()
        _ENGINES[name] = Engine(blob, pattern)
    return _ENGINES[name]


def _defaults(path: str | None, pattern: str | None) -> tuple[bytes, str]:
    import public_tokenizers

    return read_vocabulary(path or public_tokenizers.path(VOCABULARY)), pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id, ids, decoded`` for every row of ``docs``: token ids of the whole text, and the bytes they decode to.

    Null and empty texts have no ids. Special tokens are ordinary text. Repeated rows give repeated
    result rows; other columns are ignored. The vocabulary file (its path is a parameter) is
    read once by the driver and broadcast: its size is that of the file.
    """
    blob, pattern = _defaults(path, pattern)
    shared = bounded(docs.sparkSession).sparkContext.broadcast(blob)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = engine(shared.value, pattern)
        for batch in batches:
            for at, end in _groups(batch):
                rows = batch.slice(at, end - at)
                ids, n_ids, data, n_bytes = bpe.encoded([t or "" for t in rows.column("text").to_pylist()])
                lists = pa.ListArray.from_arrays(_offsets(n_ids), pa.array(ids))
                columns = [rows.column("doc_id"), lists, _binary(data, n_bytes)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"])
        # The worker may serve other operators next, beside a JVM that has grown meanwhile.
        bpe.shrink(LEFT)
        _release()

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def _offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, _offsets(sizes).buffers()[1], pa.py_buffer(data)])


def _release() -> None:
    """Gives freed memory back to the system; allocators keep it for the next task otherwise."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Row ranges of a few megabytes of text each."""
    sizes = np.array([0 if n is None else n for n in pa.compute.binary_length(batch.column("text")).to_pylist()], np.int64)
    at = 0
    while at < len(sizes):
        end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), 2 * GROUP_CHARS)))
        yield at, min(end, len(sizes))
        at = end


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, decoded`` for rows of ``doc_id, ids``: the bytes of the ids, by an ordered aggregation.

    Null or empty ids give empty bytes. An id that is null or outside the vocabulary is an error.
    """
    blob, pattern = _defaults(path, None)
    shared = tokens.sparkSession.sparkContext.broadcast(blob)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = engine(shared.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column("ids").to_pylist()
                if any(i is None for x in lists for i in x or ()):
                    raise ValueError("an id is null")
                ids = np.array([i for x in lists for i in x or ()], np.int32)
                decoded = _binary(np.frombuffer(bpe.decode(ids), np.uint8), _sums(bpe.size[ids], [len(x or ()) for x in lists]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), decoded], ["doc_id", "decoded"])

    rows = tokens.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>"))
    return rows.mapInArrow(run, "doc_id long, decoded binary")


@query("op3_byte_level_bpe")
def op3(spark, sf_dir):
    return encode(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
