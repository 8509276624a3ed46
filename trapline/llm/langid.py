"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram is the product of its letters' vectors, each rotated by the
letter's place; a text is the sum of its n-grams. A language's prototype is the sum over its training texts, and a text
has the language whose prototype is nearest by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.session import settle

DIMENSIONS = 1024
TRAIN_PER_LANGUAGE = 2_000  # training texts per language, chosen by a hash of their id; expected number
MAX_LANGUAGES = 2_000  # prototypes a model may hold
FREQUENT = 4_096  # n-grams whose vectors are laid out beforehand; all others are bound when they are met
UNDETERMINED = "und"
_SEED, _CHUNK, _BITS, _SPACE = 7, 128, 21, 32
_LETTER = np.array([chr(c).isalpha() for c in range(0x3000)])


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct letter trigrams of a text as integers, and their counts; None if it has no letter.

    Case is dropped. Whatever is not a letter separates words and counts as one space.
    """
    chars = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _LETTER[np.minimum(chars, len(_LETTER) - 1)]
    for at in np.flatnonzero(chars >= len(_LETTER)):
        letter[at] = chr(chars[at]).isalpha()
    if not letter.any():
        return None
    chars = np.where(letter, chars, _SPACE)
    chars = chars[letter | np.concatenate([[True], letter[:-1]])]
    return np.unique(chars[:-2] << 2 * _BITS | chars[1:-1] << _BITS | chars[2:], return_counts=True)


class Letters:
    """Random vectors of letters, the same wherever they are made."""

    def __init__(self, dimensions: int) -> None:
        self._dimensions, self._at = dimensions, {}
        self._rows = [np.zeros((64, dimensions), np.int8) for _ in range(3)]

    def _row(self, char: int) -> int:
        if char not in self._at:
            at = self._at[char] = len(self._at)
            if at == len(self._rows[0]):
                self._rows = [np.concatenate([r, np.zeros_like(r)]) for r in self._rows]
            vector = np.random.default_rng([_SEED, char]).integers(0, 2, self._dimensions, np.int8) * 2 - 1
            for place, rows in enumerate(self._rows):
                rows[at] = np.roll(vector, place)
        return self._at[char]

    def bind(self, codes: np.ndarray) -> np.ndarray:
        """A vector per n-gram: its letters' vectors, rotated by two places, one and none, multiplied."""
        mask, bound = (1 << _BITS) - 1, None
        for place in (2, 1, 0):
            chars, back = np.unique(codes >> place * _BITS & mask, return_inverse=True)
            picked = self._rows_of(chars, place)[back]
            bound = picked if bound is None else bound * picked
        return bound

    def _rows_of(self, chars: np.ndarray, place: int) -> np.ndarray:
        rows = [self._row(c) for c in chars.tolist()]
        return self._rows[place][rows]


@dataclass
class Profiles:
    """Languages, their prototypes of length one, and the n-grams laid out beforehand."""

    languages: list[str]
    prototypes: np.ndarray
    frequent: np.ndarray
    _made: tuple | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": None}

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], list[float]]:
        """Language and cosine, between 0 and 1, of every text."""
        dimensions = self.prototypes.shape[1] if self.languages else 1
        if self._made is None:
            letters = Letters(dimensions)
            table = letters.bind(self.frequent).astype(np.float32) if len(self.frequent) else None
            self._made = letters, table
        letters, table = self._made
        names, scores = [], []
        for at in range(0, len(texts), _CHUNK):
            part = [ngram_counts(t) if t else None for t in texts[at : at + _CHUNK]]
            if not self.languages:
                part = [None] * len(part)
            counts = np.zeros((len(part), len(self.frequent)), np.float32)
            others = np.zeros((len(part), dimensions), np.float32)
            for i, found in enumerate(part):
                if found is None or table is None:
                    continue
                codes, n = found
                spot = np.minimum(np.searchsorted(self.frequent, codes), len(self.frequent) - 1)
                known = self.frequent[spot] == codes
                counts[i, spot[known]] = n[known]
                if not known.all():
                    others[i] = n[~known].astype(np.float32) @ letters.bind(codes[~known]).astype(np.float32)
            bundles = counts @ table + others if table is not None else others
            length = np.linalg.norm(bundles, axis=1)
            cosines = bundles @ self.prototypes.T / np.where(length > 0, length, 1)[:, None] if self.languages else None
            for i, found in enumerate(part):
                best = int(np.argmax(cosines[i])) if found is not None else None
                names.append(UNDETERMINED if best is None else self.languages[best])
                scores.append(0.0 if best is None else float(np.clip(cosines[i, best], 0, 1)))
        return names, scores


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept away from training: CRC-32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit(
    docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE, dimensions: int = DIMENSIONS,
    doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
) -> Profiles:
    """Prototypes of the languages in ``lang``, from texts that are not held out.

    Rows without id, text or language teach nothing. About ``per_language`` texts of a language are used, whole.
    """
    usable = docs.filter(
        F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id)
    ).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(doc_id).alias("doc_id"))
    sizes = usable.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return Profiles([], np.zeros((0, dimensions), np.float32), np.zeros(0, np.int64))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, per_language / r["count"]))])
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept: dict[str, list] = {}
            for name, body in zip(*(c.to_pylist() for c in batch.columns)):
                if (found := ngram_counts(body)) is not None:
                    kept.setdefault(name, []).append(found)
            for name, found in kept.items():
                codes, back = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                n = np.bincount(back, np.concatenate([n for _, n in found])).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(codes)), pa.array(codes), pa.array(n)], names=["lang", "code", "n"]
                )

    counted = usable.filter(drawn).select("lang", "text").mapInArrow(count, "lang string, code bigint, n bigint")
    counts = settle(counted.groupBy("lang", "code").agg(F.sum("n").alias("n")))

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, sums = Letters(dimensions), {}
        for batch in batches:
            names, codes, n = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            order = np.argsort(names, kind="stable")
            for at in range(0, len(order), _CHUNK):
                part = order[at : at + _CHUNK]
                vectors = letters.bind(codes[part]).astype(np.float64) * n[part, None]
                for name in {names[i] for i in part}:
                    own = [names[i] == name for i in part]
                    sums[name] = sums.get(name, 0) + vectors[own].sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))],
            names=["lang", "bundle"],
        )

    parts = counts.coalesce(8).mapInArrow(bundle, "lang string, bundle array<double>").collect()
    languages = sorted({r["lang"] for r in parts})
    bundles = np.stack([sum(np.array(r["bundle"]) for r in parts if r["lang"] == name) for name in languages]) if languages else np.zeros((0, dimensions))
    length = np.linalg.norm(bundles, axis=1, keepdims=True)
    common = counts.groupBy("code").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "code").limit(FREQUENT)
    frequent = np.sort(np.array([r["code"] for r in common.collect()], np.int64))
    return Profiles(languages, (bundles / np.where(length > 0, length, 1)).astype(np.float32), frequent)


def language_of(profiles: Profiles, text: Column) -> Column:
    """Struct of ``lang_pred`` and ``score``; ``und`` and 0 for a missing text or one without letters."""

    @F.pandas_udf("struct<lang_pred string, score double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, scores = profiles.predict(batch.tolist())
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return predict(text)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``. Every row is kept; only its text is looked at."""
    found = docs.withColumn("__language", language_of(profiles, F.col(text)))
    own = [F.col(c) for c in docs.columns if c not in ("lang_pred", "score")]
    return found.select(*own, "__language.lang_pred", "__language.score")
