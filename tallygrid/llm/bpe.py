"""Byte-level BPE: encoding texts to token ids and decoding ids, by recursive queries in each partition.

A text is cut where a space stands before something else than white space; there the
splitting pattern always begins a new match, whatever stands around. So equal pieces
give equal tokens, and each distinct piece of a partition is split by the pattern and
encoded once. Its words go, as rows of (word, position, token), through a recursive
query of an in-memory DuckDB in the task: rows join the merge table on the pair of a
token and the next, each word's leftmost pair of least rank is contracted, and words
without a pair in the table drop out. A word that is a token itself needs no merge.
The merge table has every way to put a token together from two others, which is what
ranks mean. Decoding joins ids with their bytes and puts these together by position.

Words of over ``LONG`` bytes take a second query, which contracts all pairs of least
rank in one step, from the left up to the first that makes a pair of lesser rank, so
it too does what single contractions do. It is for rarities: a single word of 30,000
random letters takes some 40 seconds.

Defined results: null and empty texts have no tokens; each row gives one row, repeated
rows equal ones; a null id stays null; an empty table gives an empty result; other
columns are ignored. Special tokens aren't recognised: their strings are ordinary text.
Whole texts are encoded; memory grows with the longest text and the vocabulary.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.llm.words import filled, slices

#: Words up to so many bytes are contracted one pair a step, all together.
LONG = 256
#: Texts go through the queries in slices of so many bytes.
TEXT_BYTES = 8 << 20
#: Lists of ids go through the decoding query so many at a time.
ROWS = 500
#: A task forgets its pieces beyond so many, and encodes them anew when they come again.
MOST_PIECES = 600_000
#: The vocabulary goes to every task whole; larger files are refused.
MOST_BYTES = 64 << 20

MERGES = """
create table merges as select l.id as a, r.id as b, v.id as m
from (select id, piece, unnest(range(1, octet_length(piece))) as k from vocab where octet_length(piece) > 1) v
join vocab l on l.piece = v.piece[1:k] join vocab r on r.piece = v.piece[k + 1:]"""

SINGLE = """
single(w, p, id, next) as (
    select w, p::int, v.id, x.piece[p + 2:p + 2] from (select w, piece, unnest(range(octet_length(piece))) as p from words) x join vocab v on v.piece = x.piece[p + 1:p + 1])"""

# a word's first row is there in each of its steps
LAST = """
select w, p, id from step join (select w, max(i) as i from step where p = 0 group by w) using (w, i)"""

# a row knows its neighbours, so only the rows around a contraction look up a rank
CONTRACT_ONE = f"""
with recursive {SINGLE},
step(w, p, o, q, id, after, m, i) as (
    select w, p, p - 1, case when after is not null then p + 1 end, s.id, after, m, 0
    from (select s.*, v.id as after from single s left join vocab v on v.piece = s.next) s left join merges on a = s.id and b = after
  union all (
    with best as (select w, min(m::bigint * 16777216 + p) as k from step where m is not null group by w),
    live as (select s.*, (k % 16777216)::int as spot, (k // 16777216)::int as made from step s join best using (w)),
    eaten as (select w, p as gone, q as next, after as beyond from live where o = spot),
    kept as (
        select w, p, case when o = gone then spot else o end as o, case when p = spot then next else q end as q, case when p = spot then made else id end as id,
               case when p = spot then beyond when q = spot then made else after end as after,
               case when p = spot or q = spot then null else m end as m, coalesce(p = spot or q = spot, false) as anew, i
        from live join eaten using (w) where p <> gone)
    select w, p, o, q, id, after, coalesce(k.m, x.m), i + 1 from kept k left join merges x on anew and x.a = k.id and x.b = k.after))
{LAST}"""

# pairs of equal rank overlap only as a token beside itself: every second of such a run is contracted
CONTRACT_MANY = f"""
with recursive {SINGLE},
step(w, p, id, i) as (
    select w, p, id, 0 from single
  union all (
    with pairs as (
        select w, p, i, s.id, m, row_number() over o as k, lag(s.id) over o as before, lead(s.id, 2) over o as beyond
        from (select *, lead(id) over (partition by w order by p) as after from step) s left join merges on a = s.id and b = after window o as (partition by w order by p)),
    live as (select *, m is not distinct from best as hit from (select *, min(m) over (partition by w) as best from pairs) where best is not null),
    runs as (select *, k - row_number() over (partition by w, hit order by p) as run from live),
    apart as (select *, hit and row_number() over (partition by w, hit, run order by p) % 2 = 1 as taken from runs),
    beside as (select *, lag(taken, 2) over (partition by w order by p) as touches from apart),
    lesser as (
        select w, min(p) as last from beside left join merges x on taken and x.b = best and x.a = case when touches then best else before end left join merges y on taken and y.a = best and y.b = beyond
        where x.m < best or y.m < best group by w),
    chosen as (select a.*, taken and (last is null or p <= last) as now from apart a left join lesser using (w)),
    marked as (select *, lag(now) over (partition by w order by p) as eaten from chosen)
    select w, p, case when now then best else id end, i + 1 from marked where not coalesce(eaten, false)))
{LAST}"""

DECODE = "select doc, unhex(string_agg(hex, '' order by pos)) as bytes from tokens join vocab using (id) group by doc"


class _Groups:
    """Numbered lists of numbers, one after the other in an array."""

    def __init__(self) -> None:
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def add(self, flat: np.ndarray, counts: np.ndarray) -> None:
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(counts, dtype=np.int64)))
        self.flat = np.concatenate((self.flat, flat.astype(np.int32)))

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the lists of ``numbers`` one after the other, their lengths)."""
        start, count = self.ends[numbers], self.ends[numbers + 1] - self.ends[numbers]
        first = np.cumsum(count) - count
        return self.flat[np.repeat(start - first, count) + np.arange(int(count.sum()))], count


class _Numbers(dict):
    """Numbers for keys, by order of arrival; ``fresh`` has the keys without a list so far."""

    def __init__(self) -> None:
        self.fresh: list = []
        self.n = 0

    def __missing__(self, key) -> int:
        self[key] = n = self.n
        self.n += 1
        self.fresh.append(key)
        return n


class _Pieces(dict):
    """The numbers of pieces without the space before them; -1 for what a space can't be cut off from."""

    def __init__(self, whole: _Numbers, white: regex.Pattern) -> None:
        self.whole, self.white = whole, white

    def __missing__(self, piece: str) -> int:
        n = -1
        if piece and not self.white.match(piece):
            n = self.whole.n
            self.whole.n += 1
            self.whole.fresh.append(" " + piece)
        self[piece] = n
        return n


class Coder:
    """Encodes and decodes within one task."""

    def __init__(self, ranks: bytes, pattern: str) -> None:
        pieces, ids = zip(*((base64.b64decode(a), int(b)) for a, b in map(bytes.split, ranks.splitlines())))
        self.pattern, self.cut, self.white = regex.compile(pattern), regex.compile(r" (?=\S)"), regex.compile(r"\s")
        self.db = duckdb.connect()
        self.db.execute("set threads = 1; set memory_limit = '1GB'; set preserve_insertion_order = false")
        self.db.register("given", pa.table({"piece": pa.array(pieces, pa.binary()), "id": pa.array(ids, pa.int32())}))
        self.db.execute("create table vocab as select piece, id, hex(piece) as hex from given")
        self.db.execute(MERGES)
        self.forget()

    def forget(self) -> None:
        self.pieces, self.words = _Numbers(), _Numbers()
        self.spaced = _Pieces(self.pieces, self.white)
        self.words_of, self.ids_of = _Groups(), _Groups()

    def _contracted(self, words: list[str]) -> None:
        """Adds the ids of new words."""
        raw = [w.encode() for w in words]
        self.db.register("given", pa.table({"w": pa.array(range(len(raw)), pa.int32()), "piece": pa.array(raw, pa.binary())}))
        self.db.execute("create or replace table asked as select w, given.piece, v.id as whole from given left join vocab v using (piece)")
        parts = [self.db.sql("select w, 0 as p, whole as id from asked where whole is not null").to_arrow_table()]
        self.db.execute(f"create or replace table words as select w, piece from asked where whole is null and octet_length(piece) <= {LONG}")
        parts.append(self.db.sql(CONTRACT_ONE).to_arrow_table())
        for (w,) in self.db.execute(f"select w from asked where whole is null and octet_length(piece) > {LONG}").fetchall():
            self.db.execute("create or replace table words as select w, piece from asked where w = ?", [w])
            parts.append(self.db.sql(CONTRACT_MANY).to_arrow_table())
        w, p, ids = (np.concatenate([t[c].to_numpy() for t in parts]) for c in ("w", "p", "id"))
        self.ids_of.add(ids[np.lexsort((p, w))], np.bincount(w, minlength=len(words)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many each text has)."""
        if self.pieces.n > MOST_PIECES:
            self.forget()
        codes = []
        for text in texts:
            parts = text.split(" ")
            later = np.fromiter(map(self.spaced.__getitem__, parts[1:]), np.int64, len(parts) - 1)
            if (later < 0).any():
                parts = self.cut.split(text)
                later = np.fromiter(map(self.spaced.__getitem__, parts[1:]), np.int64, len(parts) - 1)
            codes += (np.array([self.pieces[parts[0]]], np.int64), later)
        split = [list(map(self.words.__getitem__, self.pattern.findall(piece))) for piece in self.pieces.fresh]
        self.words_of.add(np.fromiter((w for ws in split for w in ws), np.int64), np.fromiter(map(len, split), np.int64))
        if self.words.fresh:
            self._contracted(self.words.fresh)
        self.pieces.fresh, self.words.fresh = [], []
        words, n_words = self.words_of.of(np.concatenate(codes))
        ids, n_ids = self.ids_of.of(words)
        n_pieces = [len(a) + len(b) for a, b in zip(codes[::2], codes[1::2])]
        ends = np.concatenate(([0], np.cumsum(n_ids)))[np.concatenate(([0], np.cumsum(n_words)))][np.concatenate(([0], np.cumsum(n_pieces)))]
        return ids, np.diff(ends)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes that each list of ids stands for."""
        rows = pa.table({"doc": np.repeat(np.arange(len(counts), dtype=np.int32), counts), "pos": np.arange(len(ids), dtype=np.int32), "id": ids.astype(np.int32)})
        self.db.register("tokens", rows)
        found = self.db.sql(DECODE).to_arrow_table()
        out = [b""] * len(counts)
        for doc, raw in zip(found["doc"].to_pylist(), found["bytes"].to_pylist()):
            out[doc] = raw
        self.db.unregister("tokens")
        return out


def _rank_file(df: DataFrame, path: str):
    """The file at ``path``, of the driver, for the tasks."""
    with open(path, "rb") as file:
        ranks = file.read(MOST_BYTES + 1)
    if len(ranks) > MOST_BYTES:
        raise ValueError(f"{path} has over {MOST_BYTES} bytes")
    return df.sparkSession.sparkContext.broadcast(ranks)


def _packed(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Each list's ids as little-endian unsigned 32-bit integers."""
    ends = np.concatenate(([0], np.cumsum(counts))) * 4
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary())


def _listed(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(counts))).astype(np.int32), ids.astype(np.int32))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", packed: bool = False, round_trip: bool = False) -> DataFrame:
    """(doc_id, ids) for every row: the token ids as array<int>.

    ``path``: a file of base64 tokens with their ranks, one a line. ``packed``: the ids as
    little-endian unsigned 32-bit integers in one binary value instead. ``round_trip``
    adds ``decoded``, the bytes that the ids stand for.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ranks, form = _rank_file(docs, path), _packed if packed else _listed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in slices(batches, bytes_=TEXT_BYTES):
            coder = coder or Coder(ranks.value, pattern)
            ids, counts = coder.encode(filled(batch.column("text")).to_pylist())
            columns = {"doc_id": batch.column("doc_id"), "ids": form(ids, counts)}
            if round_trip:
                columns["decoded"] = pa.array(coder.decode(ids, counts), pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids {'binary' if packed else 'array<int>'}" + ", decoded binary" * round_trip)


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded) for every row of an array of ids; null has no bytes, and neither have ids that the file lacks."""
    given = rows.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    ranks = _rank_file(rows, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            coder = coder or Coder(ranks.value, r"(?!)")
            lists = batch.column("ids")
            ids, counts = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy()
            for a in range(0, len(counts), ROWS):
                part, first = counts[a : a + ROWS], int(counts[:a].sum())
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(a, ROWS), "decoded": pa.array(coder.decode(ids[first : first + int(part.sum())], part), pa.binary())})

    return given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, decoded binary")
