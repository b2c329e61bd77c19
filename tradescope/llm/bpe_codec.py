"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside each partition.

The words of a batch become rows (word, position, token).  A recursive query joins
neighbouring rows with the merge table and contracts, in every round, each word's leftmost
pair of least rank; a word without a pair leaves the recursion.  Long words are contracted
in pieces, and around the cuts again, until every two neighbouring tokens stand as they
would on their own.  Decoding joins the ids with the vocabulary and puts the pieces together
by an ordered aggregation.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tradescope.llm.common import forget, kind, texts, units

# Words and tokens of one query; both bound a worker's memory.
WORDS_AT_ONCE = 40_000
TOKENS_AT_ONCE = 300_000
# Longer words are cut into pieces of so many bytes.
LONG_WORD = 64
# Longer pieces, which only odd words need, take the query that contracts several places in a round.
LONG_PIECE = 512
# Tokens on either side of a cut that are contracted again, at first.
AROUND = 6

_RESULT = """
SELECT word, list(tok ORDER BY pos) AS ids
FROM step JOIN (SELECT word, max(round) AS round FROM step GROUP BY word) USING (word, round)
GROUP BY word
"""

ENCODE = (
    """
WITH RECURSIVE step(round, word, pos, tok) AS (
  SELECT 0, word, pos, tok FROM symbols
  UNION ALL
  SELECT s.round + 1, s.word,
         CASE WHEN s.pos > b.pos THEN s.pos - 1 ELSE s.pos END,
         CASE WHEN s.pos = b.pos THEN b.made ELSE s.tok END
  FROM step s JOIN (
    SELECT a.word, min(m.made) AS made, arg_min(a.pos, (m.made::BIGINT << 32) + a.pos) AS pos
    FROM step a
    JOIN step c ON c.word = a.word AND c.pos = a.pos + 1
    JOIN merges m ON m.pair = (a.tok::BIGINT << 32) + c.tok
    GROUP BY a.word
  ) b ON b.word = s.word
  WHERE s.pos <> b.pos + 1
)"""
    + _RESULT
)

# The same contraction for long words: all places of the least pair in one round, from the
# left and without overlap, unless what the pair makes belongs to a pair of lower rank.
ENCODE_LONG = (
    """
WITH RECURSIVE step(round, word, pos, tok) AS (
  SELECT 0, word, pos, tok FROM symbols
  UNION ALL
  SELECT round + 1, word, (pos - before)::INTEGER, CASE WHEN chosen THEN made ELSE tok END
  FROM (
    SELECT *, coalesce(lag(chosen) OVER w, false) AS gone,
           coalesce(sum(chosen::INTEGER) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM (
      SELECT *, hit AND CASE WHEN alone THEN pos = leftmost ELSE (pos - clear) % 2 = 1 END AS chosen
      FROM (
        SELECT *, made IS NOT DISTINCT FROM least AS hit,
               min(CASE WHEN made = least THEN pos END) OVER (PARTITION BY word) AS leftmost,
               coalesce(max(CASE WHEN made = least THEN NULL ELSE pos END) OVER w, -1) AS clear
        FROM (
          SELECT p.*, m.made, m.alone, min(m.made) OVER (PARTITION BY p.word) AS least
          FROM (SELECT *, lead(tok) OVER (PARTITION BY word ORDER BY pos) AS after FROM step) p
          LEFT JOIN merges m ON m.pair = (p.tok::BIGINT << 32) + p.after
        ) WHERE least IS NOT NULL
        WINDOW w AS (PARTITION BY word ORDER BY pos)
      )
    ) WINDOW w AS (PARTITION BY word ORDER BY pos)
  ) WHERE NOT gone
)"""
    + _RESULT
)

DECODE = """
SELECT doc, string_agg(piece, '' ORDER BY pos) AS piece
FROM tokens JOIN vocabulary USING (id) GROUP BY doc ORDER BY doc
"""


class Codec:
    """One DuckDB connection with the merge table and the vocabulary of a rank file."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            rank = {base64.b64decode(t): int(r) for t, r in map(bytes.split, file)}
        parts = [
            (rank[t[:i]], rank[t[i:]], r)
            for t, r in rank.items()
            for i in range(1, len(t))
            if t[:i] in rank and t[i:] in rank
        ]
        left, right, made = (np.array(c, np.int64) for c in zip(*parts, strict=True))
        early = np.zeros(max(rank.values()) + 1, bool)
        early[left[left > made]] = early[right[right > made]] = True
        self.first = np.array([rank[bytes([b])] for b in range(256)], np.int32)
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.token = {r: t for t, r in rank.items()}
        self.units: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.stable: dict[tuple[int, int], bool] = {}
        # Nothing is spilled to the worker's folder.
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        self._table("merges", pair=(left << 32) + right, made=made.astype(np.int32), alone=early[made])
        # A byte as the letter 256 places on, so that pieces are text at any byte.
        pieces = ["".join(chr(256 + b) for b in t) for t in rank]
        self._table("vocabulary", id=np.array(list(rank.values()), np.int32), piece=pieces)

    def _table(self, name: str, **columns: object) -> None:
        self.db.register("_given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM _given")
        self.db.unregister("_given")

    def _contracted(self, words: list[bytes], query: str) -> Iterator[tuple[bytes, bytes]]:
        size = np.array([len(w) for w in words])
        word = np.repeat(np.arange(len(words), dtype=np.int32), size)
        begins = np.repeat(np.cumsum(size) - size, size)
        self._table(
            "symbols",
            word=word,
            pos=(np.arange(len(word)) - begins).astype(np.int32),
            tok=self.first[np.frombuffer(b"".join(words), np.uint8)],
        )
        got = self.db.sql(query).to_arrow_table()
        ids = got.column("ids").combine_chunks()
        flat, ends = ids.values.to_numpy().astype("<u4"), ids.offsets.to_numpy()
        for place, a, b in zip(got.column("word").to_pylist(), ends[:-1], ends[1:], strict=True):
            yield words[place], flat[a:b].tobytes()

    def _pieces(self, pieces: set[bytes]) -> dict[bytes, bytes]:
        """Packed ids of each piece, contracted as a word of its own."""
        found: dict[bytes, bytes] = {}
        short = [p for p in pieces if len(p) <= LONG_PIECE]
        begin = 0
        while begin < len(short):
            end, size = begin, 0
            while end < len(short) and end - begin < WORDS_AT_ONCE and size < TOKENS_AT_ONCE:
                size += len(short[end])
                end += 1
            found.update(self._contracted(short[begin:end], ENCODE))
            begin = end
        for piece in pieces:
            if len(piece) > LONG_PIECE:
                found.update(self._contracted([piece], ENCODE_LONG))
        return found

    def _unstable(self, pairs: set[tuple[int, int]]) -> set[tuple[int, int]]:
        """Neighbouring tokens that do not come out again where their bytes are a word."""
        forget(self.stable)
        joined = {p: self.token[p[0]] + self.token[p[1]] for p in pairs if p not in self.stable}
        got = self._pieces(set(joined.values()))
        for pair, piece in joined.items():
            self.stable[pair] = got[piece] == np.array(pair, "<u4").tobytes()
        return {p for p in pairs if not self.stable[p]}

    def _long(self, word: bytes) -> bytes:
        """Packed ids of a long word.

        Contraction leaves tokens of which every two neighbours are what their bytes alone give,
        and no other tokens of the word are like that.  So pieces are contracted on their own,
        and where two neighbours across a cut are not, what stands around them is contracted
        again, each time in twice the width: in the end this is the whole word.
        """
        pieces = [word[i : i + LONG_WORD] for i in range(0, len(word), LONG_WORD)]
        got = self._pieces(set(pieces))
        runs = [np.frombuffer(got[p], "<u4").tolist() for p in pieces]
        tokens = [t for run in runs for t in run]
        cuts = np.cumsum([len(run) for run in runs])[:-1].tolist()
        width = AROUND
        while cuts:
            unstable = self._unstable({(tokens[c - 1], tokens[c]) for c in cuts})
            spans: list[list[int]] = []
            for c in cuts:
                if (tokens[c - 1], tokens[c]) in unstable:
                    begin, end = max(0, c - width), min(len(tokens), c + width)
                    if spans and begin <= spans[-1][1]:
                        spans[-1][1] = end
                    else:
                        spans.append([begin, end])
            bodies = [b"".join(map(self.token.__getitem__, tokens[a:b])) for a, b in spans]
            got = self._pieces(set(bodies))
            out: list[int] = []
            cuts, done = [], 0
            for (a, b), body in zip(spans, bodies, strict=True):
                out += tokens[done:a]
                if a:
                    cuts.append(len(out))
                out += np.frombuffer(got[body], "<u4").tolist()
                if b < len(tokens):
                    cuts.append(len(out))
                done = b
            tokens = out + tokens[done:]
            width *= 2
        return np.array(tokens, "<u4").tobytes()

    def encode(self, strings: list[str]) -> list[bytes]:
        """Ids of each string, packed as little-endian unsigned 32-bit integers."""
        cut = [units(s) for s in strings]
        forget(self.units)
        forget(self.words)
        new = list(set().union(*cut).difference(self.units)) if cut else []
        split = [self.split(u) for u in new]
        unknown = {w: w.encode() for w in set().union(*split).difference(self.words)} if split else {}
        got = self._pieces({b for b in unknown.values() if len(b) <= LONG_WORD})
        self.words.update((w, got[b]) for w, b in unknown.items() if len(b) <= LONG_WORD)
        long = {w: self._long(b) for w, b in unknown.items() if len(b) > LONG_WORD}
        words = self.words | long if long else self.words
        self.units.update((u, b"".join(map(words.__getitem__, w))) for u, w in zip(new, split, strict=True))
        return [b"".join(map(self.units.__getitem__, c)) for c in cut]

    def decode(self, packed: list[bytes]) -> list[bytes]:
        """Bytes of each packed id list; an empty list gives no bytes."""
        out = [b""] * len(packed)
        begin = 0
        while begin < len(packed):
            end, size = begin, 0
            while end < len(packed) and (end == begin or size + len(packed[end]) // 4 <= TOKENS_AT_ONCE):
                size += len(packed[end]) // 4
                end += 1
            ids = np.frombuffer(b"".join(packed[begin:end]), "<u4").astype(np.int32)
            doc = np.repeat(np.arange(begin, end, dtype=np.int32), [len(p) // 4 for p in packed[begin:end]])
            self._table("tokens", doc=doc, pos=np.arange(len(ids), dtype=np.int32), id=ids)
            got = self.db.sql(DECODE).to_arrow_table()
            for place, text in zip(got.column("doc").to_pylist(), got.column("piece").to_pylist(), strict=True):
                out[place] = text.encode("utf-16-le")[::2]
            begin = end
        return out


@lru_cache(1)
def codec(path: str) -> Codec:
    return Codec(path)


def bpe_round_trip(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Encode every whole text, decode the ids again, and return both as digests.

    Columns: n_tokens, ids_sha256 (over little-endian unsigned 32-bit ids), decoded_sha256
    (over the decoded bytes) and, with ``with_ids``, the ids themselves.  One narrow pass.
    A null text counts as empty and has no ids; repeated rows give equal results; an empty
    table gives no row; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                packed = own.encode(texts(part, text_col))
                back = own.decode(packed)
                columns = [
                    part.column(id_col),
                    pa.array([len(p) // 4 for p in packed], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                    pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string()),
                ]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in packed], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"{id_col} {kind(docs, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(id_col, text_col).mapInArrow(run, schema + ", ids array<int>" * with_ids)
