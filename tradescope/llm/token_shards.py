"""Token ids in shards of a succinct file format, and back.

A shard is one row of a Parquet file: a wavelet matrix over the ids of whole documents,
with the documents' ids and lengths.  Spark's writer commits a file only when its task has
ended well, so a lost executor leaves no half shard.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tradescope.llm.array_bpe import byte_letters
from tradescope.llm.common import forget, kind, units
from tradescope.llm.wavelet import WaveletMatrix

# Fixed value: the pre-token pattern of the word vocabulary.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
# Printable and below U+0180: nothing is composed, lower-casing goes letter by letter.
_PLAIN = re.compile("[!-~¡-¬®-įı-ſ]+").fullmatch
# Units a worker remembers; about 200 bytes each.
_UNITS = 800_000
# Separators of Python's split that Unicode does not call white space.
_NO_SPACE = "\x1c\x1d\x1e\x1f"
SHARD_TOKENS = 1 << 20


class WordEncoder:
    """The library's encoding of whole texts, with a memory of units and of words.

    Units of plain Latin text are lower-cased and split here and only their words go to the
    library's model; any other unit, and any that may hold a special string, is encoded by
    the library as it is.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.units: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.letters = byte_letters()

    def _learn(self, words: list[str]) -> None:
        tokenize = self.tokenizer.model.tokenize
        for word in words:
            if word not in self.words:
                spelled = word if word.isascii() else "".join(self.letters[b] for b in word.encode())
                self.words[word] = _packed([t.id for t in tokenize(spelled)])

    def _unit(self, unit: str) -> bytes:
        if _PLAIN(unit) and "<|" not in unit:
            words = _WORDS(unit.lower())
            try:
                return b"".join([self.words[w] for w in words])
            except KeyError:
                self._learn(words)
                return b"".join([self.words[w] for w in words])
        return _packed(self.tokenizer.encode(unit, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        """Ids of a text as packed little-endian 32-bit integers."""
        # White space only separates here, so a plain split will do where it means the same.
        cut = units(text) if any(c in text for c in _NO_SPACE) else text.split()
        known = self.units.get
        packed = list(map(known, cut))
        try:
            out = b"".join(packed)
        except TypeError:  # a unit without ids yet
            for i, (unit, ids) in enumerate(zip(cut, packed, strict=True)):
                if ids is None:
                    packed[i] = known(unit)
                    if packed[i] is None:
                        packed[i] = self.units[unit] = self._unit(unit)
            out = b"".join(packed)
        forget(self.units, _UNITS)
        forget(self.words)
        return out


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(1)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_shards(
    docs: DataFrame,
    folder: str,
    path: str,
    end_id: int = 1,
    shard_tokens: int = SHARD_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode all texts and write them to ``folder``, in ascending order of id.

    A shard closes with the document that reaches ``shard_tokens``; documents are never
    cut.  Null ids come first, equal ids stand in the order of their texts (null first).  A
    null text counts as empty and has only its end id.  An empty table writes no shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, number = _encoder(path), TaskContext.get().partitionId(), 0
        names: list = []
        held: list[bytes] = []
        size = 0
        end = np.array([end_id], "<u4").tobytes()

        def shard() -> pa.RecordBatch:
            matrix = WaveletMatrix.built(np.frombuffer(b"".join(held), "<u4"))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([number], pa.int32()),
                    pa.array([matrix.n], pa.int64()),
                    pa.array([[len(h) // 4 for h in held]], pa.list_(pa.int64())),
                    pa.array([matrix.zeros], pa.list_(pa.int64())),
                    pa.array([matrix.planes], pa.list_(pa.binary())),
                    pa.array([names], pa.list_(name_type)),
                ],
                names=["part", "shard", "n_tokens", "lengths", "zeros", "planes", "ids"],
            )

        for batch in batches:
            name_type = batch.column(id_col).type
            for name, text in zip(batch.column(id_col).to_pylist(), batch.column(text_col).to_pylist(), strict=True):
                names.append(name)
                held.append(encoder.encode(text or "") + end)
                size += len(held[-1]) // 4
                if size >= shard_tokens:
                    yield shard()
                    names, held, size, number = [], [], 0, number + 1
        if held:
            yield shard()

    ordered = docs.select(id_col, text_col, F.xxhash64(text_col).alias("_mixed")).repartitionByRange(id_col, "_mixed")
    rows = ordered.sortWithinPartitions(F.col(id_col).asc_nulls_first(), F.col(text_col).asc_nulls_first())
    schema = (
        "part int, shard int, n_tokens long, lengths array<bigint>, zeros array<bigint>, "
        f"planes array<binary>, ids array<{kind(docs, id_col)}>"
    )
    rows.drop("_mixed").mapInArrow(run, schema).write.option("compression", "zstd").parquet(folder)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: its id, start in the whole stream, size and crc32.

    Every shard is decoded by itself.  Starts follow from the shards' sizes: added up inside
    each part, and one total per part across the parts.
    """
    shards = spark.read.parquet(folder)
    id_type = shards.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw = WaveletMatrix(row["n_tokens"], row["planes"], row["zeros"]).ids().astype("<u4").tobytes()
                sizes = np.array(row["lengths"], np.int64)
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                n = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, row["part"], np.int32)),
                        pa.array(np.full(n, row["shard"], np.int32)),
                        pa.array(row["ids"], batch.column("ids").type.value_type),
                        pa.array(ends - sizes),
                        pa.array(sizes),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["part", "shard", "doc_id", "_local", "n_tokens", "ids_crc32"],
                )

    decoded = shards.mapInArrow(
        run, f"part int, shard int, doc_id {id_type}, _local long, n_tokens long, ids_crc32 long"
    )
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = shards.select("part", "shard", "n_tokens")
    part = sizes.groupBy("part").agg(F.sum("n_tokens").alias("_total"))
    part = part.select("part", F.coalesce(F.sum("_total").over(across), F.lit(0)).alias("_before"))
    starts = sizes.select("part", "shard", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("_inside"))
    place = starts.join(part, "part").select("part", "shard", (F.col("_inside") + F.col("_before")).alias("_start"))
    return decoded.join(place, ["part", "shard"]).select(
        "doc_id", (F.col("_start") + F.col("_local")).alias("start"), "n_tokens", "ids_crc32"
    )


def shard_lookup(spark: SparkSession, folder: str, column: str, ask: Callable[[WaveletMatrix], int]) -> DataFrame:
    """One number per shard (part, shard, ``column``), asked of its matrix without decoding it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            asked = [int(ask(WaveletMatrix(r["n_tokens"], r["planes"], r["zeros"]))) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), batch.column("shard"), pa.array(asked, pa.int64())],
                names=["part", "shard", column],
            )

    shards = spark.read.parquet(folder).select("part", "shard", "n_tokens", "zeros", "planes")
    return shards.mapInArrow(run, f"part int, shard int, {column} long")
