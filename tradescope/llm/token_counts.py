"""Token counts by rank-synchronous merging of whole batches of pre-tokens."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tradescope.llm.array_bpe import ArrayBPE
from tradescope.llm.common import forget, kind, texts, units


@lru_cache(2)
def _merger(path: str) -> tuple[ArrayBPE, dict[str, int]]:
    """One merger and one memory of counted units per worker and vocabulary."""
    return ArrayBPE(path), {}


def count_tokens(strings: list[str], path: str) -> list[int]:
    """Tokens of each string; special strings count as one token wherever they stand."""
    bpe, known = _merger(path)
    parted = [bpe.special.split(s) if bpe.special else [s] for s in strings]
    cut = [[u for part in parts for u in units(part)] for parts in parted]
    forget(known)
    new = list(set().union(*cut).difference(known)) if cut else []
    words = [bpe.split(u) for u in new]
    distinct = list(set().union(*words)) if words else []
    size = dict(zip(distinct, bpe.counts(distinct).tolist(), strict=True))
    known.update((u, sum(map(size.__getitem__, w))) for u, w in zip(new, words, strict=True))
    return [sum(map(known.__getitem__, c)) + len(p) - 1 for c, p in zip(cut, parted, strict=True)]


def token_counts(
    docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """UTF-8 bytes and tokens of every text, and whether it has more than ``limit`` tokens.

    One narrow pass without a shuffle.  A null text counts as empty (0 bytes, 0 tokens); a
    null id stays null; repeated rows give repeated results; an empty table gives no row.
    Other columns of ``docs`` are not read.  A pre-token of any length is merged whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                strings = texts(part, text_col)
                tokens = count_tokens(strings, path)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(id_col),
                        pa.array([len(s.encode()) for s in strings], pa.int64()),
                        pa.array(tokens, pa.int64()),
                        pa.array([n > limit for n in tokens], pa.bool_()),
                    ],
                    names=[id_col, "n_bytes", "n_tokens", "over_limit"],
                )

    schema = f"{id_col} {kind(docs, id_col)}, n_bytes long, n_tokens long, over_limit boolean"
    return docs.select(id_col, text_col).mapInArrow(run, schema)
