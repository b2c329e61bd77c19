"""Language identification with bit-sliced Bloom filters over character n-grams.

All languages share one table of slots.  A slot holds one bit per language, so a lookup
returns the set of languages that hold an n-gram: the AND of its slots.  The bits are
counted per language over the whole text, the expected false positives of each language's
own bit plane are taken off, and the language with the largest share left is chosen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradescope.llm.common import kind, texts
from tradescope.operators.staging import stage

UNDETERMINED = "und"
LENGTHS = (3, 4)
_SPACE = 32
_CHARACTERS_AT_ONCE = 500_000
# Odd 64-bit multipliers, one per hash function.
_HASHES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_STEP = np.uint64(0x100000001B3)


@lru_cache(1)
def _is_letter() -> np.ndarray:
    """Whether each Unicode code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def chunks(strings: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of strings with about ``_CHARACTERS_AT_ONCE`` characters together."""
    begin, size = 0, 0
    for i, s in enumerate(strings):
        size += len(s)
        if size >= _CHARACTERS_AT_ONCE or i + 1 == len(strings):
            yield begin, i + 1
            begin, size = i + 1, 0


def ngrams(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all strings, the string each belongs to, and who has a letter.

    Letters are lower-cased; runs of anything else become one space, also at either end.
    """
    padded = [f" {s.lower()} " for s in strings]
    code = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(padded)), [len(p) for p in padded])
    letter = _is_letter()[code]
    lettered = np.bincount(owner[letter], minlength=len(padded)) > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])] = True
    code, owner = np.where(letter, code, _SPACE)[keep].astype(np.uint64), owner[keep]
    hashed, owners = [], []
    for n in LENGTHS:
        last = len(code) - n + 1
        if last > 0:
            value = np.full(last, n, np.uint64)
            for j in range(n):
                value = (value ^ code[j : j + last]) * _STEP
            value ^= value >> np.uint64(29)
            inside = owner[:last] == owner[n - 1 :]
            hashed.append(value[inside])
            owners.append(owner[:last][inside])
    if not hashed:
        return np.empty(0, np.uint64), np.empty(0, np.int64), lettered
    return np.concatenate(hashed), np.concatenate(owners), lettered


@dataclass
class LanguageFilters:
    """Languages by falling number of documents, and ``slots[slot, word]`` of language bits."""

    languages: list[str]
    slots: np.ndarray

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """The languages that hold each n-gram, as words of 64 bits."""
        found = np.full((len(grams), self.slots.shape[1]), ~np.uint64(0))
        for multiplier in _HASHES:
            found &= self.slots[_slot(grams, multiplier, len(self.slots))]
        return found

    @property
    def false_positives(self) -> np.ndarray:
        """Per language the chance that an n-gram it lacks passes all hash functions."""
        return np.array([self._bit(self.slots, k).mean() ** len(_HASHES) for k in range(len(self.languages))])

    @staticmethod
    def _bit(words: np.ndarray, k: int) -> np.ndarray:
        return (words[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)

    def shares(self, grams: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Per string and language: the corrected share of its n-grams the language holds."""
        found = self.masks(grams)
        size = np.maximum(1, np.bincount(owner, minlength=n))
        out = np.zeros((n, len(self.languages)))
        for k, chance in enumerate(self.false_positives):
            hits = np.bincount(owner, self._bit(found, k), minlength=n) / size
            out[:, k] = np.clip((hits - chance) / max(1e-9, 1 - chance), 0, 1)
        return out

    def identify(self, strings: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each string."""
        gram, owner, lettered = ngrams(strings)
        if not self.languages:
            return [UNDETERMINED] * len(strings), np.zeros(len(strings))
        share = self.shares(gram, owner, len(strings))
        best = zip(share.argmax(axis=1), lettered, strict=True)
        names = [self.languages[b] if k else UNDETERMINED for b, k in best]
        return names, np.where(lettered, share.max(axis=1), 0.0)


def _slot(grams: np.ndarray, multiplier: np.uint64, slots: int) -> np.ndarray:
    return (grams * multiplier) >> np.uint64(64 - (slots.bit_length() - 1))


def _counts(train: DataFrame) -> DataFrame:
    """(lang, gram, n): n-grams of the training texts, added up per task before the shuffle."""
    most = 1_000_000

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        gram, place = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
        weight = np.concatenate([n for _, n in parts])
        return gram, np.bincount(place, weight, minlength=len(gram)).astype(np.int64)

    def out(lang: str, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        gram, n = merged(parts)
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n)],
            names=["lang", "gram", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            own: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), texts(batch, "text"), strict=True):
                own.setdefault(lang, []).append(text)
            for lang, strings in own.items():
                for i, j in chunks(strings):
                    gram, n = np.unique(ngrams(strings[i:j])[0], return_counts=True)
                    held.setdefault(lang, []).append((gram, n))
                    if sum(len(g) for g, _ in held[lang]) > most:
                        held[lang] = [merged(held[lang])]
                        if len(held[lang][0][0]) > most // 2:
                            yield out(lang, held.pop(lang))
        for lang, parts in held.items():
            yield out(lang, parts)

    return train.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit_language_filters(
    docs: DataFrame,
    train_on: Column | None = None,
    slots: int = 1 << 20,
    least_rate: float = 1e-6,
    least_share: float = 0.2,
    text_col: str = "text",
    lang_col: str = "lang",
) -> LanguageFilters:
    """Learn the filters from all documents with text and language that ``train_on`` keeps.

    An n-gram enters the filter of a language where it makes up at least ``least_rate`` of
    that language's n-grams and ``least_share`` of its highest rate in any language; so
    foreign passages in a language's documents do not spread its neighbours' n-grams.
    The filter has ``slots`` (a power of two) words per 64 languages, whatever the corpus.
    """
    train = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    if train_on is not None:
        train = train.where(train_on)
    train = train.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counted = stage(_counts(train), "ngrams")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    # One row per language.
    languages = [r.lang for r in totals.orderBy(F.desc("total"), "lang").collect()]
    words = max(1, -(-len(languages) // 64))
    if not languages:
        return LanguageFilters([], np.zeros((slots, words), np.uint64))
    number = {lang: k for k, lang in enumerate(languages)}
    rate = F.col("n") / F.col("total")
    highest = F.max("rate").over(Window.partitionBy("gram"))
    chosen = (
        counted.join(totals, "lang")
        .withColumn("rate", rate)
        .withColumn("highest", highest)
        .where((F.col("rate") >= least_rate) & (F.col("rate") >= least_share * F.col("highest")))
    )

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram = batch.column("gram").to_numpy().view(np.uint64)
            k = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            bit = np.uint64(1) << (k % 64).astype(np.uint64)
            for multiplier in _HASHES:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(_slot(gram, multiplier, slots).astype(np.int64)),
                        pa.array((k // 64).astype(np.int32)),
                        pa.array(bit.view(np.int64)),
                    ],
                    names=["slot", "word", "bits"],
                )

    filled = (
        chosen.select("lang", "gram")
        .mapInArrow(set_bits, "slot long, word int, bits long")
        .groupBy("slot", "word")
        .agg(F.bit_or("bits").alias("bits"))
        .toArrow()  # at most ``slots`` rows per 64 languages
    )
    table = np.zeros((slots, words), np.uint64)
    at = (filled.column("slot").to_numpy(), filled.column("word").to_numpy())
    table[at] = filled.column("bits").to_numpy().view(np.uint64)
    return LanguageFilters(languages, table)


def identify_languages(
    docs: DataFrame, filters: LanguageFilters, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Id, predicted language and score of every whole text, in one narrow pass.

    The score is the corrected share of the text's n-grams that the language holds.  Texts
    that are null or have no letter are ``und`` with score 0, as is everything where no
    language was learned.  Ties go to the language with more training text, so a text
    without any known n-gram gets the most common one, with score 0.  Repeated rows get
    equal results; other columns are not read; an empty table gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strings = texts(batch, text_col)
            for i, j in chunks(strings):
                names, score = filters.identify(strings[i:j])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_col).slice(i, j - i), pa.array(names, pa.string()), pa.array(score)],
                    names=[id_col, "lang_pred", "score"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind(docs, id_col)}, lang_pred string, score double")


def keep_identified(
    docs: DataFrame, filters: LanguageFilters, least_score: float = 0.3, text_col: str = "text"
) -> DataFrame:
    """The rows, with all their columns, whose text a learned language explains.

    Goes: what ``identify_languages`` calls ``und`` and what scores below ``least_score``.
    Where no language was learned, only texts without a letter go.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strings = texts(batch, text_col)
            for i, j in chunks(strings):
                if not filters.languages:
                    yield batch.slice(i, j - i).filter(pa.array(ngrams(strings[i:j])[2]))
                    continue
                names, score = filters.identify(strings[i:j])
                keep = (score >= least_score) & np.array([n != UNDETERMINED for n in names])
                yield batch.slice(i, j - i).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
