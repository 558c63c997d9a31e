"""Operator 3: language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (seeded by its code point). A letter trigram is
bound by multiplying its letters' vectors, each rotated by its place; a text or language is the
bundle, the sum over its trigrams. A document gets the language whose prototype has the largest
cosine with its own vector; the score is that cosine, at least 0.

Prototypes come from exact trigram counts per language over all learnable rows, so they do not
depend on partitions. What reaches the driver is languages x dimensions numbers; more than
``MAX_LANGUAGES`` different labels are an error.

A null text and one without letters is ``und`` with score 0, and so is everything if nothing
can be learned. Equal cosines go to the language first by name. Null and repeated ids keep
their own row; rows with a null id are not learned from.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.arrow_text import id_and_text, remainder, slices

DIMENSIONS = 1024
SEED = 20177
UNKNOWN = "und"
#: Of the scores that held-out rows reach, the share left below and what is taken of the score there.
LEAST_SHARE, LEAST_PART = 0.01, 0.5
#: Unrelated bundles have cosines around 0 with deviation DIMENSIONS ** -0.5; so many of them are chance,
#: and so many for texts of fewer than SHORT trigrams, whose own score is low as well.
CHANCE, SHORT_CHANCE, SHORT = 4.5, 2.0, 32
SCORE_STEPS = 1000
MAX_LANGUAGES = 1000
TABLE_ROWS = 16384
#: Trigrams whose vectors are summed at once; bounds the copies of them.
BUNDLED = 1024
_SHIFT = 21
_MASK = (1 << _SHIFT) - 1
HELD_OUT = 2
PREDICTED = "id long, held_out boolean, lang_pred string, score double"


@lru_cache(maxsize=1)
def letter_of() -> np.ndarray:
    """For every code point the lower-case letter's code point, 0 for anything else."""
    table = np.zeros(0x110000, dtype=np.int32)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            table[point] = ord(char.lower()[0])
    return table


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of a text with their counts; words are framed by a blank, 0."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters = np.zeros(len(points) + 2, dtype=np.int64)
    letters[1:-1] = letter_of()[points]
    kept = np.ones(len(letters), dtype=bool)
    kept[1:] = (letters[1:] > 0) | (letters[:-1] > 0)
    letters = letters[kept]
    if len(letters) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    codes = (letters[:-2] << (2 * _SHIFT)) | (letters[1:-1] << _SHIFT) | letters[2:]
    return np.unique(codes, return_counts=True)


class GramVectors:
    """Vectors of trigrams, made when first met; the table starts anew when full."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED) -> None:
        self.dimensions, self.seed = dimensions, seed
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        # +1 and -1 take a byte each; a worker holds the table beside whatever else it has.
        self.table = np.zeros((TABLE_ROWS, dimensions), dtype=np.int8)

    def letter(self, point: int) -> np.ndarray:
        found = self.letters.get(point)
        if found is None:
            bits = np.random.default_rng((self.seed, point)).integers(0, 2, self.dimensions)
            found = self.letters[point] = (2 * bits - 1).astype(np.float32)
        return found

    def bound(self, code: int) -> np.ndarray:
        first, second, third = code >> (2 * _SHIFT), (code >> _SHIFT) & _MASK, code & _MASK
        return (
            np.roll(self.letter(first), 2) * np.roll(self.letter(second), 1) * self.letter(third)
        )

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the trigrams' vectors, as often as each occurs."""
        total = np.zeros(self.dimensions, dtype=np.float64)
        for begin in range(0, len(codes), BUNDLED):
            part = codes[begin : begin + BUNDLED].tolist()
            if len(self.rows) + len(part) > TABLE_ROWS:
                self.rows.clear()
            places = []
            for code in part:
                row = self.rows.get(code)
                if row is None:
                    row = self.rows[code] = len(self.rows)
                    self.table[row] = self.bound(code)
                places.append(row)
            weights = counts[begin : begin + BUNDLED].astype(np.float32)
            total += weights @ self.table[places].astype(np.float32)
        return total


class GramCounts:
    """Trigram counts per language of one task, merged now and then."""

    def __init__(self) -> None:
        self.parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.size = 0

    def add(self, lang: str, codes: np.ndarray, counts: np.ndarray) -> None:
        self.parts.setdefault(lang, []).append((codes, counts))
        self.size += len(codes)
        if self.size > 4_000_000:
            self.merge()

    def merge(self) -> None:
        self.size = 0
        for lang, parts in self.parts.items():
            codes, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            counts = np.zeros(len(codes), dtype=np.int64)
            np.add.at(counts, back, np.concatenate([p[1] for p in parts]))
            self.parts[lang] = [(codes, counts)]
            self.size += len(codes)

    def drain(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        for lang, ((codes, counts),) in self.parts.items():
            for begin in range(0, len(codes), 1 << 16):
                part = slice(begin, begin + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(codes[part]), pa.string()), pa.array(codes[part]), pa.array(counts[part])],
                    ["lang", "gram", "n"],
                )
        self.parts = {}


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of (lang, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = GramCounts()
        for part in slices(batches):
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                total.add(lang, *trigrams(text))
            if total.size > 2_000_000:
                yield from total.drain()
        yield from total.drain()

    counted = labelled.mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Profiles:
    """Languages by name and the unit vectors of their prototypes."""

    langs: list[str]
    prototypes: np.ndarray

    def name(self, text: str, vectors: GramVectors) -> tuple[str, float]:
        """The language of a text and the cosine with its prototype."""
        return self.of(*trigrams(text), vectors)

    def of(self, codes: np.ndarray, counts: np.ndarray, vectors: GramVectors) -> tuple[str, float]:
        """The same of a text's trigrams."""
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        own = vectors.bundle(codes, counts)
        cosines = self.prototypes @ own / max(np.linalg.norm(own), 1e-300)
        best = int(np.argmax(cosines))
        return self.langs[best], float(min(1.0, max(0.0, cosines[best])))


def learn_prototypes(labelled: DataFrame) -> Profiles:
    """The profiles of all languages, from rows of (lang, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, sums = GramVectors(), {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            codes = batch.column("gram").to_numpy(zero_copy_only=False)
            counts = batch.column("n").to_numpy(zero_copy_only=False)
            for lang in set(langs.tolist()):
                own = langs == lang
                total = np.zeros(DIMENSIONS, dtype=np.int64)
                for begin in range(0, int(own.sum()), 1024):
                    part = slice(begin, begin + 1024)
                    signs = np.stack([vectors.bound(c) for c in codes[own][part].tolist()]).astype(np.int64)
                    total += counts[own][part] @ signs
                sums[lang] = sums.get(lang, 0) + total
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang], pa.string()), pa.array([total.tolist()], pa.list_(pa.int64()))], ["lang", "total"]
            )

    by_task = gram_counts(labelled).mapInArrow(run, "lang string, total array<long>")
    summed = (
        by_task.select("lang", F.posexplode("total").alias("dimension", "value"))
        .groupBy("lang", "dimension")
        .agg(F.sum("value").alias("value"))
    )
    rows = summed.limit(MAX_LANGUAGES * DIMENSIONS + 1).collect()
    if len(rows) > MAX_LANGUAGES * DIMENSIONS:
        raise ValueError(f"more than {MAX_LANGUAGES} different languages to learn")
    langs = sorted({r["lang"] for r in rows})
    place = {lang: n for n, lang in enumerate(langs)}
    matrix = np.zeros((len(langs), DIMENSIONS))
    for r in rows:
        matrix[place[r["lang"]], r["dimension"]] = r["value"]
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return Profiles(langs, matrix / np.where(lengths > 0, lengths, 1))


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> Profiles:
    """Profiles from the learnable rows: a language, a text, and an id not held out."""
    learnable = docs.where(
        (remainder(docs[id_col], 4) != HELD_OUT) & docs[lang_col].isNotNull() & docs[text_col].isNotNull()
    )
    return learn_prototypes(
        learnable.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text"))
    )


def predict(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    profiles: Profiles | None = None,
) -> DataFrame:
    """(id, held_out, lang_pred, score), one row per document."""
    known = learn(docs, id_col, text_col, lang_col) if profiles is None else profiles

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = GramVectors()
        for part in slices(batches):
            names, scores = zip(*(known.name(t, vectors) for t in part.column("text").to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["id", "held_out", "lang_pred", "score"],
            )

    held_out = F.coalesce(remainder(docs[id_col], 4) == HELD_OUT, F.lit(False)).alias("held_out")
    return id_and_text(docs, id_col, text_col, held_out).mapInArrow(run, PREDICTED)


def least_score(
    docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> float:
    """The score below which a text of ``SHORT`` trigrams or more is in no known language.

    A part of what nearly all held-out rows reach that are named as labelled, and above chance. A
    histogram of ``SCORE_STEPS`` + 1 rows at most reaches the driver.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, steps = GramVectors(), np.zeros(SCORE_STEPS + 1, dtype=np.int64)
        for part in slices(batches):
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                codes, counts = trigrams(text)
                if counts.sum() >= SHORT:
                    name, score = profiles.of(codes, counts, vectors)
                    steps[int(score * SCORE_STEPS)] += name == lang
        found = np.flatnonzero(steps)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(steps[found])], ["step", "n"])

    held_out = docs.where(
        (remainder(docs[id_col], 4) == HELD_OUT) & docs[lang_col].isNotNull() & docs[text_col].isNotNull()
    )
    labelled = held_out.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text"))
    rows = labelled.mapInArrow(run, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).collect()
    left = LEAST_SHARE * sum(r["n"] for r in rows)
    chance = CHANCE * DIMENSIONS**-0.5
    for r in sorted(rows, key=lambda r: r["step"]):
        left -= r["n"]
        if left < 0:
            return max(chance, LEAST_PART * r["step"] / SCORE_STEPS)
    return chance


def accepted(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    least: float | None = None,
) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in a known language.

    Texts that are ``und``, or farther from every profile than ``least`` (by default
    ``least_score`` of the table; for very short texts, what two deviations of chance reach), go.
    """
    known = learn(docs, id_col, text_col, lang_col)
    least = least_score(docs, known, id_col, text_col, lang_col) if least is None else least
    short = min(least, SHORT_CHANCE * DIMENSIONS**-0.5)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = GramVectors()
        for part in slices(batches, text_col):
            kept = []
            for text in pc.fill_null(part.column(text_col), "").to_pylist():
                codes, counts = trigrams(text)
                name, score = known.of(codes, counts, vectors)
                kept.append(name != UNKNOWN and score >= (least if counts.sum() >= SHORT else short))
            yield part.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
