"""Operator 9: language-model scoring by causal self-attention over subword ids.

A text's words (A-Z lower-cased, each behind one blank) become subword ids of a public
byte-level tokenizer, closed by an end id. Ids fall into 64 classes; the model foretells the next
class from overlapping windows of contexts (``attention``), and the id within its class comes from
counts behind the last context. Classes of ids that begin a word are apart from the others, so the probability of
a whole word, its boundary included, follows from the window scores. It is mixed
with the word's share of the training words, weight ``MIX``: on words met often the counts are hard to beat by
any subword model, on all others the attention model decides. The score sums the log10 of the
mixture over the text's words and its end; each subword is scored in one window.

Counted over all learnable rows: words, ids, and pairs of context and id. Classes and contexts rank ids
by these counts. The attention weights are trained on every window of all learnable rows: in each of
``ROUNDS`` rounds every task trains on its next share of its windows, and the weights of all tasks,
averaged by windows, are where the next round starts. Scoring covers every whole text.

Texts are read and encoded once, into a table of ids kept for learning and scoring. A word has one list
of ids, so words are told apart by a hash of these. Each word's count is needed. The ``FREQUENT`` most frequent words (a fixed number) travel to the
tasks; all other words join their counts by a shuffle on the word.

Null texts count as empty: one token, the end. Rows with a null id are scored and not learned
from; repeated rows keep their own result. If nothing can be learned, N and V are 0 and only the
model, untrained, counts. Columns other than id and text are not read.
"""

from __future__ import annotations

import json
import math
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillsift.llm import attention
from quillsift.llm.arrow_text import id_and_text, remainder, slices
from quillsift.llm.attention import CLASSES, CONTEXTS, END
from quillsift.llm.pretoken import CACHE_WORD_CHARS, CACHE_WORDS, byte_letters
from quillsift.llm.word_hash import coefficients, mix
from quillsift.session import checkpointed

ROUNDS = 4
RATE = 0.02
#: Windows that make a fit: a task has as many at least, and a smaller table is passed over until they are reached.
FIT_WINDOWS = 1200 * 128
SHARED_CLASSES = 8
#: Ids, the most frequent, whose share in their class is counted by context.
DETAILED = 8192
BACKED = 5.0
MIX = 0.35
FREQUENT = 1 << 17
MODULUS, HELD_OUT = 7, 2
END_WORD = 0
WORD, ID, PAIR = 0, 1, 2
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LOG10 = math.log(10)
_NO_MERGE = np.iinfo(np.int32).max


class Merges:
    """Byte-pair merges of many words at once, as the tokenizer's model makes them one word at a time."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.single = np.array([vocab[letter] for letter in byte_letters()], dtype=np.int64)

    def _rank(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Ranks of pairs, ``_NO_MERGE`` where two ids do not merge."""
        wanted = first << 16 | second
        place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[place] == wanted, self.ranks[place], _NO_MERGE)

    def __call__(self, words: list[bytes]) -> list[bytes]:
        """Packed 16-bit ids of words of one byte or more."""
        if not words:
            return []
        ids = self.single[np.frombuffer(b"".join(words), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        found = []
        rank = np.full(len(ids), _NO_MERGE, dtype=np.int32)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self._rank(ids[inner], ids[inner + 1])
        while len(ids):
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(starts, append=len(ids))
            going = np.repeat(least < _NO_MERGE, sizes)
            found.append((owner[~going], ids[~going]))
            at = np.flatnonzero(going & (rank == np.repeat(least, sizes)))
            at = at[np.concatenate(([True], owner[at[1:]] != owner[at[:-1]]))[: len(at)]]  # the first of each word
            ids[at] = self.made[rank[at]]
            going[at + 1] = False  # the second of a pair goes with the words that are done
            place = np.cumsum(going)[at] - 1
            ids, owner = ids[going], owner[going]
            rank[at] = rank[at + 1]  # for the last of a word: no merge
            rank = rank[going]
            right = place[place + 1 < len(ids)]
            right = right[owner[right + 1] == owner[right]]
            rank[right] = self._rank(ids[right], ids[right + 1])
            left = place[place > 0] - 1
            left = left[owner[left + 1] == owner[left]]
            rank[left] = self._rank(ids[left], ids[left + 1])
        owner, ids = (np.concatenate(f) for f in zip(*found, strict=True))
        order = np.argsort(owner, kind="stable")
        packed = ids[order].astype("<u2").tobytes()
        ends = (2 * np.cumsum(np.bincount(owner, minlength=len(words)))).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]


class Subwords(dict):
    """Word (bytes) -> packed 16-bit ids, encoded when first met.

    Of the words met before the last ``CACHE_WORDS`` new ones, ``before`` keeps as many again.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        tokenizer = Tokenizer.from_file(path)
        self.model = tokenizer.model
        self.merges = Merges(path)
        self.before: dict[bytes, bytes] = {}
        self.size = tokenizer.get_vocab_size()
        self.end = (self.size - 1).to_bytes(2, "little")
        self.letters = dict(enumerate(byte_letters()))
        blank = self.letters[0x20]
        #: Whether an id begins a word; the end id does.
        self.begin = np.array([(tokenizer.id_to_token(i) or "").startswith(blank) for i in range(self.size)])
        self.begin[-1] = True

    def __missing__(self, word: bytes) -> bytes:
        spelled = (b" " + word).decode("latin-1").translate(self.letters)
        return array("H", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def learn(self, texts: list[list[bytes]]) -> None:
        """Hold all words of up to ``CACHE_WORD_CHARS`` bytes; longer ones are encoded where they stand."""
        if len(self) >= CACHE_WORDS:
            self.before = dict(self)
            self.clear()
        new = {w for words in texts for w in words if w not in self and len(w) <= CACHE_WORD_CHARS}
        known = {w: self.before[w] for w in new if w in self.before}
        self.update(known)
        unknown = list(new - known.keys())
        self.update(zip(unknown, self.merges([b" " + w for w in unknown]), strict=True))

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by the end id, and how many each has."""
        words = [t.encode().translate(_LOWER).split() for t in texts]
        self.learn(words)
        packed = [b"".join(map(self.__getitem__, w)) + self.end for w in words]
        lengths = np.array([len(p) // 2 for p in packed], dtype=np.int64)
        return np.frombuffer(b"".join(packed), dtype="<u2"), lengths


_subwords: dict[str, Subwords] = {}


def subwords(path: str) -> Subwords:
    if path not in _subwords:
        _subwords[path] = Subwords(path)
    return _subwords[path]


@dataclass
class Vocabulary:
    """How the model sees each id: its class to foretell, its context to learn from."""

    classes: np.ndarray
    #: Classes that begin a word; they come first.
    begins: int
    contexts: np.ndarray
    #: Place among the detailed ids, or -1.
    detail: np.ndarray


def vocabulary_of(counts: np.ndarray, begin: np.ndarray) -> Vocabulary:
    """Classes and contexts by count: the most frequent ids have their own, the others share.

    Shared classes are apart for ids that begin a word and others. The end id's class and
    context are 0.
    """
    order = np.argsort(-counts, kind="stable")
    order = order[order != len(counts) - 1]
    detail = np.full(len(counts), -1, dtype=np.int32)
    detail[order[:DETAILED]] = np.arange(min(DETAILED, len(order)))
    contexts = np.zeros(len(counts), dtype=np.uint8)
    rank = np.arange(len(order))
    own_contexts = CONTEXTS - 2 * SHARED_CLASSES
    shared = _by_rank(np.maximum(rank - own_contexts + 1, 0), 2 * SHARED_CLASSES)
    contexts[order] = np.where(rank < own_contexts - 1, rank + 1, own_contexts + shared)
    own = order[: CLASSES - 1 - 2 * SHARED_CLASSES]
    classes = np.zeros(len(counts), dtype=np.uint8)
    next_class = 1
    begins = next_class
    for side in (True, False):
        mine = own[begin[own] == side]
        classes[mine] = np.arange(next_class, next_class + len(mine))
        next_class += len(mine)
        rest = order[len(own) :]
        rest = rest[begin[rest] == side]
        classes[rest] = next_class + _by_rank(np.arange(len(rest)), SHARED_CLASSES)
        next_class += SHARED_CLASSES
        begins = next_class if side else begins
    return Vocabulary(classes, begins, contexts, detail)


def _by_rank(rank: np.ndarray, shares: int) -> np.ndarray:
    """Ranks on a logarithmic scale, in ``shares`` steps."""
    scale = np.log1p(rank) / math.log(len(rank) + 2)
    return np.minimum(scale * shares, shares - 1).astype(np.int64)


def packed_ids(docs: DataFrame, path: str) -> DataFrame:
    """(ids, lengths) of all texts, some texts to a row; with their id and held_out where ``docs`` has these.

    Then a row holds texts that are learned from, or only others, which ``learnable`` tells.
    """
    named = "learnable" in docs.columns

    def packed(part: pa.RecordBatch) -> list[pa.Array]:
        ids, lengths = subwords(path).ids(part.column("text").to_pylist())
        return [pa.array([ids.tobytes()], pa.binary()), pa.array([lengths.tobytes()], pa.binary())]

    def listed(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            if not named:
                yield pa.RecordBatch.from_arrays(packed(part), ["ids", "lengths"])
                continue
            learnable = part.column("learnable")
            for kind, chosen in ((True, learnable), (False, pc.invert(learnable))):
                own = pa.RecordBatch.from_struct_array(part.to_struct_array().filter(chosen))
                if own.num_rows:
                    names = [listed(own.column("id")), listed(own.column("held_out")), pa.array([kind])]
                    yield pa.RecordBatch.from_arrays([*packed(own), *names], ["ids", "lengths", "id", "held_out", "learnable"])

    columns = ["text", "id", "held_out", "learnable"] if named else ["text"]
    names = ", id array<long>, held_out array<boolean>, learnable boolean" if named else ""
    return docs.select(*columns).mapInArrow(run, "ids binary, lengths binary" + names)


def _unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for ids, lengths in zip(batch.column("ids"), batch.column("lengths"), strict=True):
            yield np.frombuffer(ids.as_buffer(), dtype="<u2"), np.frombuffer(lengths.as_buffer(), dtype=np.int64)


@cache
def _id_values(size: int) -> np.ndarray:
    return mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_keys(ids: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word and end begins in ``ids``, and its key: a hash of its ids, or END_WORD.

    A word has one list of ids and these spell it, so equal keys are equal words but for collisions of 64 bits.
    """
    starts = np.flatnonzero(begin[ids])
    lengths = np.diff(starts, append=len(ids))
    places = np.arange(len(ids)) - np.repeat(starts, lengths)
    most = int(lengths.max(initial=0))
    values = _id_values(len(begin))[ids] * coefficients(np.arange(most))[places]
    keys = mix(np.add.reduceat(values, starts) + lengths.astype(np.uint64)) if len(starts) else values
    keys[ids[starts] == len(begin) - 1] = END_WORD
    return starts, keys


def corpus_vocabulary(packed: DataFrame, begin: np.ndarray) -> tuple[Vocabulary, int]:
    """``vocabulary_of`` all learnable rows' ids, and how many windows these rows have."""
    size = len(begin)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, dtype=np.int64)  # the last place counts windows
        for ids, lengths in _unpacked(batches):
            total[:size] += np.bincount(ids, minlength=size)
            total[size] += len(attention.windows(lengths)[0])
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["id", "n"])

    rows = packed.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(size + 1, dtype=np.int64)
    for row in rows:  # at most one row for each id of the vocabulary
        counts[row["id"]] = row["n"]
    return vocabulary_of(counts[:size], begin), int(counts[size])


def corpus_counts(packed: DataFrame, vocabulary: Vocabulary, begin: np.ndarray) -> DataFrame:
    """(kind, key, n): words, ids, and pairs of context and detailed id, of all learnable texts."""
    shared = packed.sparkSession.sparkContext.broadcast((vocabulary, begin))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, begins = shared.value
        ids_total = np.zeros(len(of.classes), dtype=np.int64)
        pairs = np.zeros(CONTEXTS * DETAILED, dtype=np.int64)
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        size = 0
        for ids, lengths in _unpacked(batches):
            words, n = np.unique(word_keys(ids, begins)[1], return_counts=True)
            held.append(words)
            counts.append(n)
            size += len(words)
            if size > 1_500_000:
                yield from _count_rows(WORD, *_merged(held, counts))
                held, counts, size = [], [], 0
            ids_total += np.bincount(ids, minlength=len(ids_total))
            before = attention.shifted(of.contexts[ids], lengths)
            detail = of.detail[ids]
            keys = before.astype(np.int64) * DETAILED + detail
            pairs += np.bincount(keys[detail >= 0], minlength=CONTEXTS * DETAILED)
        if held:
            yield from _count_rows(WORD, *_merged(held, counts))
        for kind, total in ((ID, ids_total), (PAIR, pairs)):
            found = np.flatnonzero(total)
            yield from _count_rows(kind, found.astype(np.uint64), total[found])

    rows = packed.select("ids", "lengths").mapInArrow(run, "kind int, key long, n long")
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _merged(held: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    words, back = np.unique(np.concatenate(held), return_inverse=True)
    return words, np.bincount(back, np.concatenate(counts), len(words)).astype(np.int64)


def _count_rows(kind: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(keys), 1 << 16):
        part = slice(at, at + (1 << 16))
        key = pa.array(keys[part].view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(key), kind, dtype=np.int32)), key, pa.array(counts[part].astype(np.int64))],
            ["kind", "key", "n"],
        )


def fit(packed: DataFrame, vocabulary: Vocabulary, bigram: np.ndarray, windows: int) -> attention.Weights:
    """Attention weights trained on every window, in rounds of partial fits that are averaged."""
    context = packed.sparkSession.sparkContext
    model = attention.Weights.fresh(bigram)
    if not windows:
        return model
    passes = max(1, -(-FIT_WINDOWS // windows))
    dealt = packed.coalesce(max(1, windows // FIT_WINDOWS))
    shared = context.broadcast((vocabulary, bigram))
    for number in range(ROUNDS):
        rows = _averaged(_partial_fits(dealt, shared, model.pack(), number, passes)).collect()
        total = sum(np.frombuffer(r["total"], dtype="<f8") for r in sorted(rows, key=lambda r: r["task"]))
        mean = total / sum(r["n"] for r in rows)
        model = attention.Weights.unpack(mean.astype("<f4").tobytes(), bigram)
    return model


def _partial_fits(packed: DataFrame, shared, start: bytes, number: int, passes: int) -> DataFrame:
    """(task, total, n): of every task the weights after its share of round ``number``, times its windows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, log_counts = shared.value
        task = TaskContext.get().partitionId()
        rate = RATE * (1 - 0.9 * number / ROUNDS)
        trainer = attention.Trainer(attention.Weights.unpack(start, log_counts), rate, (11, number, task))
        for ids, lengths in _unpacked(batches):
            inputs = attention.shifted(of.contexts[ids], lengths)
            trainer.learn(inputs, of.classes[ids], lengths, number, ROUNDS, passes)
        if trainer.windows:
            weights = np.frombuffer(trainer.model.pack(), dtype="<f4").astype("<f8") * trainer.windows
            yield _fit_row(task, weights, trainer.windows)

    return packed.mapInArrow(run, _FIT)


_FIT = "task int, total binary, n long"


def _fit_row(task: int, total: np.ndarray, n: int) -> pa.RecordBatch:
    columns = [pa.array([task], pa.int32()), pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["task", "total", "n"])


def _averaged(fits: DataFrame) -> DataFrame:
    """Sums of the partial fits, a fixed number of rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, total, n = None, 0.0, 0
        for batch in batches:
            for row in batch.to_pylist():
                first = row["task"] if first is None else first
                total = total + np.frombuffer(row["total"], dtype="<f8")
                n += row["n"]
        if first is not None:
            yield _fit_row(first, total, n)

    return fits.repartition(16, "task").sortWithinPartitions("task").mapInArrow(run, _FIT)


def score_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per document."""
    context = docs.sparkSession.sparkContext
    rest = remainder(docs[id_col], MODULUS)
    rows = id_and_text(docs, id_col, text_col, F.coalesce(rest == HELD_OUT, F.lit(False)).alias("held_out"))
    rows = rows.withColumn("learnable", F.expr("not held_out and id is not null"))
    own = subwords(path)

    # Texts are read and encoded once, for learning and for scoring.
    packed = checkpointed(packed_ids(rows, path))
    learnable = packed.where("learnable").select("ids", "lengths")
    vocabulary, windows = corpus_vocabulary(learnable, own.begin)
    counts = checkpointed(corpus_counts(learnable, vocabulary, own.begin))
    shares, bigram = Shares.of(counts, vocabulary)
    weights = fit(learnable, vocabulary, bigram, windows)

    words = counts.where(F.col("kind") == WORD).select(F.col("key").alias("word"), F.col("n").alias("c"))
    totals = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("c").alias("v")).first()
    frequent = frequent_words(words).toPandas().sort_values("word")
    lm = Model(vocabulary, own.begin, shares, weights, frequent["word"].to_numpy(np.int64), frequent["c"].to_numpy(np.int64), totals["n"])
    scored = checkpointed(_scored(packed, context.broadcast(lm)))
    share = F.col("c") * F.lit(MIX / max(1, totals["n"])) + F.lit(1 - MIX) * F.pow(F.lit(10.0), F.col("rare.log"))
    rare = (
        scored.select("row", F.explode("rare").alias("rare"))
        .join(words, F.col("rare.word") == words["word"])
        .groupBy("row")
        .agg(
            F.sum(F.log10(F.col("c") + 1)).alias("rare_log"),
            F.sum(F.log10(share) - F.lit(math.log10(1 - MIX)) - F.col("rare.log")).alias("rare_gain"),
            F.count(F.lit(1)).alias("rare_known"),
        )
    )
    zero = F.lit(0)
    log_all = math.log10(totals["n"] + totals["v"] + 1)
    return scored.drop("rare").join(rare, "row", "left").select(
        "id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", zero)).alias("n_known"),
        F.lit(totals["n"]).cast("long").alias("train_tokens"),
        (F.col("log_known") + F.coalesce("rare_log", zero) - F.col("n_tokens") * F.lit(log_all)).alias("base_score"),
        (F.col("score") + F.coalesce("rare_gain", zero)).alias("score"),
    )


def frequent_words(words: DataFrame, most: int = FREQUENT) -> DataFrame:
    """The words above the lowest count that no more than ``most`` words reach.

    The bound comes from a histogram of the counts' logarithms, of a few hundred rows.
    """
    step = F.floor(F.log2("c") * 32).cast("int")
    histogram = words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect()
    total, lowest = 0, None
    for row in sorted(histogram, key=lambda r: -r["step"]):
        total += row["words"]
        if total > most:
            break
        lowest = row["step"]
    return words.where(step >= F.lit(lowest)) if lowest is not None else words.limit(0)


@dataclass
class Shares:
    """log10 share of ids in their class, behind a context. Tables of fixed size."""

    detailed: np.ndarray
    backed: np.ndarray
    plain: np.ndarray

    @classmethod
    def of(cls, counts: DataFrame, vocabulary: Vocabulary) -> tuple[Shares, np.ndarray]:
        """The shares, and the log of each class's share behind a context.

        At most vocabulary plus contexts x detailed ids rows of two numbers reach the driver.
        """
        ids = np.full(len(vocabulary.classes), 0.05)
        pairs = np.zeros(CONTEXTS * DETAILED)
        found = counts.where(F.col("kind") != WORD).toPandas()
        for kind, target in ((ID, ids), (PAIR, pairs)):
            own = found[found["kind"] == kind]
            target[own["key"].to_numpy(np.int64)] += own["n"].to_numpy(np.float64)
        pairs = pairs.reshape(CONTEXTS, DETAILED)
        per_class = np.bincount(vocabulary.classes, ids, CLASSES)
        plain = ids / per_class[vocabulary.classes]
        detailed = np.flatnonzero(vocabulary.detail >= 0)
        detailed = detailed[np.argsort(vocabulary.detail[detailed])]
        class_of = vocabulary.classes[detailed]
        pairs = pairs[:, : len(detailed)]
        behind = np.stack([np.bincount(class_of, row, CLASSES) for row in pairs])
        table = np.log10((pairs + BACKED * plain[detailed]) / (behind + BACKED)[:, class_of])
        end = np.bincount(vocabulary.classes, ids, CLASSES) * (np.arange(CLASSES) == END)
        smooth = behind + 2 * per_class / per_class.sum() + end * behind.sum(axis=1, keepdims=True) / ids.sum()
        bigram = np.log(smooth / smooth.sum(axis=1, keepdims=True))
        return cls(table.astype(np.float32), np.log10(BACKED / (behind + BACKED)).astype(np.float32), np.log10(plain)), bigram

    def __call__(self, ids: np.ndarray, inputs: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
        detail = vocabulary.detail[ids]
        counted = self.detailed[inputs, np.maximum(detail, 0)]
        return np.where(detail >= 0, counted, self.backed[inputs, vocabulary.classes[ids]] + self.plain[ids])


@dataclass
class Model:
    """What scoring needs; every part has a fixed size."""

    vocabulary: Vocabulary
    #: Whether an id begins a word.
    begin: np.ndarray
    shares: Shares
    attention: attention.Weights
    frequent: np.ndarray
    counts: np.ndarray
    total: int


def _scored(packed: DataFrame, shared) -> DataFrame:
    """Scores as far as frequent words go, and the other words with their log10 probability as ``rare``.

    ``score`` counts the rare words by the attention model alone.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm: Model = shared.value
        logs = np.log10(lm.counts + 1.0)
        row = TaskContext.get().partitionId() << 40
        for ids, places, names, held_out in _named(batches):
            texts = len(names)
            starts, keys = word_keys(ids, lm.begin)
            words = keys.view(np.int64)
            owners = np.searchsorted(np.cumsum(places), starts, side="right")
            lengths = np.bincount(owners, minlength=texts)
            log = word_logs(ids, places, lm)
            if len(lm.frequent):
                place = np.minimum(np.searchsorted(lm.frequent, words), len(lm.frequent) - 1)
                known = lm.frequent[place] == words
            else:
                place, known = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=bool)
            score = math.log10(1 - MIX) + log
            share = lm.counts[place[known]] * (MIX / max(1, lm.total))
            score[known] = np.log10(share + (1 - MIX) * 10.0 ** log[known])
            rare = ~known
            offsets = np.concatenate([[0], np.cumsum(np.bincount(owners[rare], minlength=texts))])
            entries = pa.StructArray.from_arrays([pa.array(words[rare]), pa.array(log[rare])], ["word", "log"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + texts)),
                    names,
                    held_out,
                    pa.array(lengths.astype(np.int64)),
                    pa.array(np.bincount(owners[known], minlength=texts).astype(np.int64)),
                    pa.array(np.bincount(owners[known], logs[place[known]], texts).astype(np.float64)),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), entries),
                    pa.array(np.bincount(owners, score, texts)),
                ],
                ["row", "id", "held_out", "n_tokens", "known", "log_known", "rare", "score"],
            )
            row += texts

    return packed.mapInArrow(
        run,
        "row long, id long, held_out boolean, n_tokens long, known long, log_known double, "
        "rare array<struct<word: long, log: double>>, score double",
    )


def _named(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]]:
    """Of every row its ids, how many each text has, and the texts' ids and whether they are held out."""
    for batch in batches:
        for n in range(batch.num_rows):
            one = batch.slice(n, 1)
            ids, lengths = next(_unpacked([one]))
            yield ids, lengths, one.column("id").flatten(), one.column("held_out").flatten()


def word_logs(ids: np.ndarray, lengths: np.ndarray, lm: Model) -> np.ndarray:
    """log10 probability by the attention model of every word and end, in order.

    A word takes its ids, given that a word begins, and the chance that the next one begins
    after it.
    """
    of = lm.vocabulary
    inputs = attention.shifted(of.contexts[ids], lengths)
    of_class, of_begin = attention.log_probabilities(lm.attention, inputs, of.classes[ids], lengths, of.begins)
    begins = np.flatnonzero(lm.begin[ids])
    total = np.add.reduceat(of_class / _LOG10 + lm.shares(ids, inputs, of), begins) - of_begin[begins] / _LOG10
    last = ids[begins] == len(lm.begin) - 1
    following = np.append(of_begin[begins[1:]], 0.0) / _LOG10
    return total + np.where(last, 0.0, following)
