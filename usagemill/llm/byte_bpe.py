"""Byte-level BPE from a rank file: DuckDB contracts token rows inside the tasks, and decodes by an ordered aggregate.

A text is cut into words by a pattern. New words become rows ``piece, pos, id``, one for each byte. A recursive query joins
neighbours with the merge table and contracts the leftmost pair of the lowest rank of every piece, round by round,
until none is left. Decoding joins ids with their tokens and aggregates these in order. Tasks remember the words that
they have met.

Long words are first cut where no token can cross: a token that crosses a place shows the bytes around it, up to two
on either side, as they stand around some inner place of a known token. What is left in one piece and is still long
takes a query that contracts all places of the lowest rank at once.
"""

from __future__ import annotations

import base64
import tempfile
from collections.abc import Iterable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagemill.llm.tables import offsets, own_rows, spread, text_chunks

CHUNK_BYTES = 1 << 20
# A task forgets its words when they are more, or have more letters, than this; longer words are not remembered.
CACHE_WORDS, CACHE_LETTERS, CACHE_WORD = 1 << 19, 1 << 25, 1 << 10
# Bytes from which on a word is cut, and a piece is long; bytes of short pieces that one query takes.
LONG, QUERY_BYTES = 32, 1 << 17
# Rows that one query may make for long pieces, as a power of two; it goes on from where it stopped.
ROWS, MOST_ROUNDS = 1 << 21, 24
MEMORY = "200MB"
_PLACE_BITS = 6  # places in a short piece

_TABLES = """
CREATE TABLE merges AS
  SELECT l.id AS a, r.id AS b, t.id AS joined
  FROM (SELECT id, hex, unnest(range(2, len(hex), 2)) AS k FROM file) t
  JOIN file l ON l.hex = substr(t.hex, 1, k) JOIN file r ON r.hex = substr(t.hex, k + 1);
CREATE TABLE tokens AS
  SELECT id, unhex(hex) AS bytes, coalesce(lowest > id, true) AS simple
  FROM file LEFT JOIN (SELECT part, min(joined) AS lowest
    FROM (SELECT a AS part, joined FROM merges UNION ALL SELECT b, joined FROM merges) GROUP BY part) ON part = id
"""

# One pair of each piece a round, so that places stay 0, 1, 2 and so on. A key holds piece and place, with room between
# pieces, so that the next key belongs to the next token of the same piece. All pieces with a pair left go on.
_SHORT = f"""
WITH RECURSIVE state AS (
  SELECT key, id, 0 AS round FROM start
  UNION ALL
  SELECT s.key - (s.key > place)::INT, CASE WHEN s.key = place THEN joined ELSE s.id END, s.round + 1
  FROM state s JOIN (
    SELECT key >> {_PLACE_BITS} AS piece, min((merges.joined::BIGINT << 40) | key) AS best, (best >> 40)::INT AS joined,
           best & {(1 << 40) - 1} AS place
    FROM (SELECT key, id, lead(id) OVER (ORDER BY key) AS next, lead(key) OVER (ORDER BY key) AS next_key FROM state) l
    JOIN merges ON merges.a = l.id AND merges.b = l.next
    WHERE next_key = key + 1 GROUP BY key >> {_PLACE_BITS}) lowest ON lowest.piece = s.key >> {_PLACE_BITS}
  WHERE s.key <> place + 1)
SELECT key, id, round FROM state
"""

# All places of a piece's lowest rank in a round, every other one in a run of pairs that overlap: as good as one by one
# from the left, if the new token is part of none of lower rank. Of a token that is, the leftmost place alone.
_LONG = """
WITH RECURSIVE state AS (
  SELECT piece, pos, id, 0 AS round FROM start
  UNION ALL
  SELECT piece, pos, CASE WHEN contract THEN best ELSE id END, round + 1
  FROM (
    SELECT *, lag(contract) OVER (PARTITION BY piece ORDER BY pos) AS gone
    FROM (
      SELECT *, hit AND (simple OR pos = leftmost) AND (nth - max(CASE WHEN hit AND NOT follows THEN nth END) OVER (
               PARTITION BY piece ORDER BY pos)) % 2 = 0 AS contract
      FROM (
        SELECT piece, pos, t.id, round, best, simple, joined IS NOT NULL AND joined = best AS hit,
               min(CASE WHEN joined = best THEN pos END) OVER (PARTITION BY piece) AS leftmost,
               coalesce(lag(joined = best) OVER (PARTITION BY piece ORDER BY pos), false) AS follows,
               row_number() OVER (PARTITION BY piece ORDER BY pos) AS nth
        FROM (
          SELECT s.*, merges.joined, min(merges.joined) OVER (PARTITION BY piece) AS best
          FROM (SELECT *, lead(id) OVER (PARTITION BY piece ORDER BY pos) AS next FROM state WHERE round < $rounds) s
          LEFT JOIN merges ON merges.a = s.id AND merges.b = s.next) t
        JOIN tokens ON tokens.id = best)))
  WHERE NOT coalesce(gone, false))
SELECT piece, pos, id, round FROM state QUALIFY round = max(round) OVER (PARTITION BY piece)
"""

_DECODE = "SELECT list(bytes ORDER BY pos) AS bytes FROM start JOIN tokens USING (id)"


def compiled(pattern: str) -> regex.Pattern:
    r"""A pattern of the rank files' libraries, whose ``\s`` and ``\S`` are the Unicode property."""
    inside = regex.sub(r"\[[^\]]*\]", lambda part: part[0].replace(r"\s", r"\p{White_Space}"), pattern)
    return regex.compile(inside.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"), regex.V0)


def _around(data: np.ndarray, at: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """A number for the bytes around each place: ``before`` and ``after`` of them, 1 or 2, and these counts."""
    wide = data.astype(np.int64)
    key = (before * 4 + after) << 32 | wide[at - 1] << 8 | wide[at]
    key |= np.where(before > 1, wide[np.maximum(at - 2, 0)], 0) << 24
    return key | np.where(after > 1, wide[np.minimum(at + 1, len(wide) - 1)], 0) << 16


class RankBPE:
    """The encoder and decoder of one rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            ranks = [(int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, filter(None, map(bytes.strip, file)))]
        single = {token[0]: rank for rank, token in ranks if len(token) == 1}
        if len(single) < 256:
            raise ValueError(f"{path}: a token for each byte is needed")
        self.single = np.array([single[byte] for byte in range(256)], np.int32)
        self.ids = np.array(sorted(rank for rank, _ in ranks), np.int64)
        ends = offsets(np.array([len(token) for _, token in ranks]))
        data = np.frombuffer(b"".join(token for _, token in ranks), np.uint8)
        inner = np.setdiff1d(np.arange(len(data)), ends)
        token = np.searchsorted(ends, inner, "right") - 1
        before, after = inner - ends[token], ends[token + 1] - inner
        self.crossed = np.unique(_around(data, inner, np.minimum(before, 2), np.minimum(after, 2)))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": tempfile.gettempdir()})
        self.db.register("file", pa.table({"id": pa.array([rank for rank, _ in ranks], pa.int32()), "hex": [token.hex() for _, token in ranks]}))
        self.db.execute(_TABLES)
        self.db.unregister("file")

    def cuts(self, word: bytes) -> list[int]:
        """Places inside a word that no token crosses."""
        data = np.frombuffer(word, np.uint8)
        at = np.arange(1, len(data))
        crossed = np.zeros(len(at), bool)
        for before in (1, 2):
            for after in (1, 2):
                there = (at >= before) & (len(data) - at >= after)
                keys = _around(data, at[there], np.full(int(there.sum()), before), np.full(int(there.sum()), after))
                place = np.minimum(np.searchsorted(self.crossed, keys), len(self.crossed) - 1)
                crossed[there] |= self.crossed[place] == keys
        return at[~crossed].tolist()

    def _query(self, sql: str, rows: dict[str, np.ndarray], **named: int) -> dict[str, np.ndarray]:
        self.db.register("start", pa.table(rows))
        try:
            return self.db.execute(sql.replace("$rounds", str(named.get("rounds")))).fetchnumpy()
        finally:
            self.db.unregister("start")

    def _short(self, piece: np.ndarray, pos: np.ndarray, ids: np.ndarray) -> dict[str, np.ndarray]:
        found = self._query(_SHORT, {"key": (piece << _PLACE_BITS) | pos, "id": ids})
        piece, pos = found["key"] >> _PLACE_BITS, found["key"] & ((1 << _PLACE_BITS) - 1)
        last = np.zeros(int(piece.max()) + 1, np.int32)
        np.maximum.at(last, piece, found["round"])
        done = found["round"] == last[piece]
        return {"piece": piece[done], "pos": pos[done], "id": found["id"][done]}

    def _long(self, piece: np.ndarray, pos: np.ndarray, ids: np.ndarray) -> dict[str, np.ndarray]:
        rows, done = {"piece": piece, "pos": pos, "id": ids}, []
        while len(rows["id"]):
            rounds = max(1, min(MOST_ROUNDS, ROWS // len(rows["id"])))
            found = self._query(_LONG, rows, rounds=rounds)
            open_ = found["round"] == rounds
            done.append({name: found[name][~open_] for name in rows})
            rows = {name: found[name][open_] for name in rows}
        return {name: np.concatenate([one[name] for one in done]) for name in rows}

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and the number of ids of each."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        counts, found = np.zeros(len(pieces), np.int64), []
        for at, long in ((np.flatnonzero(sizes <= LONG), False), (np.flatnonzero(sizes > LONG), True)):
            groups = np.cumsum(sizes[at]) // QUERY_BYTES
            for own in np.split(at, np.flatnonzero(np.diff(groups)) + 1):
                if not len(own):
                    continue
                data = np.frombuffer(b"".join([pieces[i] for i in own.tolist()]), np.uint8)
                piece, pos = np.repeat(own, sizes[own]), spread(np.zeros(len(own), np.int64), sizes[own])
                solve = self._long if long else self._short
                got = solve(piece, pos, self.single[data])
                found.append((got["piece"], got["pos"], got["id"]))
        if not found:
            return np.zeros(0, np.int32), counts
        piece, pos, ids = (np.concatenate(part) for part in zip(*found))
        counts += np.bincount(piece, minlength=len(pieces))
        return ids[np.lexsort((pos, piece))], counts

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and the number of ids of each."""
        number: dict[bytes, int] = {}
        parts, sizes = [], []
        for word in words:
            raw = word.encode()
            edges = [0, *self.cuts(raw), len(raw)] if len(raw) > LONG else [0, len(raw)]
            parts += [number.setdefault(raw[a:b], len(number)) for a, b in zip(edges, edges[1:])]
            sizes.append(len(edges) - 1)
        ids, counts = self.encode_pieces(list(number))
        at, starts = np.array(parts, np.int64), offsets(counts)[:-1]
        ends = offsets(counts[at])
        edges = ends[offsets(np.array(sizes, np.int64))]
        return ids[spread(starts[at], counts[at])], np.diff(edges)

    def decode(self, ids: np.ndarray, begins: np.ndarray) -> pa.Array:
        """The bytes of consecutive lists of ids."""
        if len(ids) and not np.isin(ids, self.ids).all():
            raise ValueError("an id is not in the vocabulary")
        if not len(ids):
            return pa.array([b""] * (len(begins) - 1), pa.binary())
        self.db.register("start", pa.table({"pos": np.arange(len(ids)), "id": ids.astype(np.int32)}))
        tokens = self.db.sql(_DECODE).to_arrow_table().combine_chunks().column("bytes").chunk(0)
        self.db.unregister("start")
        lists = pa.ListArray.from_arrays(pa.array((begins - begins[0]).astype(np.int32)), tokens.flatten())
        return pc.binary_join(lists, b"")


class _Encoder:
    """Encodes texts and keeps the ids of the words met so far in a task."""

    def __init__(self, bpe: RankBPE, pattern: str):
        self.bpe, self.words = bpe, compiled(pattern).findall
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.letters = 0
        self.ids = np.zeros(0, np.int32)
        self.starts, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, words: list[str]) -> None:
        ids, counts = self.bpe.encode_words(words)
        self.at.update(zip(words, range(len(self.starts), len(self.starts) + len(words))))
        self.letters += sum(map(len, words))
        self.starts = np.concatenate([self.starts, len(self.ids) + offsets(counts)[:-1]])
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, ids])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text starts (and the last ends)."""
        split = [self.words(text) for text in texts]
        met = set()
        for words in split:
            met.update(words)
        if len(self.at) > CACHE_WORDS or self.letters > CACHE_LETTERS:
            self.forget()
        if new := [word for word in met if word not in self.at]:
            self.learn(new)
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        at = np.empty(int(sizes.sum()), np.int64)
        begins = offsets(sizes)
        for begin, words in zip(begins.tolist(), split):
            at[begin : begin + len(words)] = list(map(self.at.__getitem__, words))
        counts = self.counts[at]
        out = self.ids[spread(self.starts[at], counts)], offsets(counts)[begins]
        for word in new:
            if len(word) > CACHE_WORD:
                del self.at[word]
        return out


_loaded: dict[str, RankBPE] = {}


def _load(path: str) -> RankBPE:
    if path not in _loaded:
        _loaded[path] = RankBPE(path)
    return _loaded[path]


def encode(
    docs: DataFrame, path: str, pattern: str, carry: list[str], back: bool = False, packed: bool = False
) -> DataFrame:
    """``row`` (a struct of the carried columns) and the token ``ids`` of every row's whole text; with ``back`` also the
    bytes ``decoded`` from them. ``packed`` ids are binary, four bytes each, the lowest first, as token files hold them.

    Each match of ``pattern`` is encoded on its own, with no special tokens; letters between matches, if the pattern
    leaves any, have no ids. ``path`` must be readable on every executor. A null text is an empty one, with no id; rows
    that repeat are encoded each; a text or word of any length is read whole. Columns of ``docs`` may have any name, and
    an empty table gives no row.
    """
    own, kind = own_rows(docs, carry)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(_load(path), pattern)
        for batch in batches:
            for first, texts in text_chunks(batch, "text", CHUNK_BYTES):
                ids, begins = encoder(texts)
                ids = ids.astype("<i4")
                if packed:
                    edges = pa.py_buffer((4 * begins).astype(np.int32))
                    lists = pa.Array.from_buffers(pa.binary(), len(texts), [None, edges, pa.py_buffer(ids)])
                else:
                    lists = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(ids))
                columns = [batch.column("row").slice(first, len(texts)), lists]
                if back:
                    columns.append(encoder.bpe.decode(ids, begins))
                yield pa.record_batch(columns, names=["row", "ids", "decoded"][: len(columns)])

    shape = "binary" if packed else "array<int>"
    return own.mapInArrow(run, f"row {kind}, ids {shape}" + ", decoded binary" * back)


def decode(ids: Column, path: str) -> Column:
    """The bytes of a column of token ids. A null is an empty list; an id that the file does not have raises."""

    @F.arrow_udf("binary")
    def decoded(column: pa.Array) -> pa.Array:
        sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        return _load(path).decode(column.flatten().to_numpy(zero_copy_only=False), offsets(sizes))

    return decoded(ids)


def encoded_report(docs: DataFrame, path: str, pattern: str, packed: bool = False) -> DataFrame:
    """``doc_id, ids, decoded`` of every row."""
    return encode(docs, path, pattern, ["doc_id"], back=True, packed=packed).select("row.doc_id", "ids", "decoded")
