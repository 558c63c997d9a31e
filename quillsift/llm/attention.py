"""A small causal self-attention model of subword classes, in numpy.

It sees ids as one of 256 contexts and foretells one of 64 classes. The next class depends on the
last context through log counts over the whole training corpus, and on the window before it
through one attention layer whose output is added to those logits:

    logits[t] = bigram[x[t]] + softmax(q[t] . k[j] / sqrt(d) + distance[t - j], j <= t) v[j] @ out + bias
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

CONTEXTS = 256
CLASSES = 64
WIDTH = 16
WINDOW = 32
SCORED = 16
END = 0
_LEAST = np.float32(1e-30)
_ONES = np.ones(CLASSES, np.float32)
#: Up to this spread of logits their exponents need no maximum of their own.
_SAFE = 60


@dataclass
class Weights:
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    distance: np.ndarray
    bigram: np.ndarray

    TRAINED = ("query", "key", "value", "out", "bias", "distance")

    @classmethod
    def fresh(cls, bigram: np.ndarray, seed: int = 7) -> Weights:
        rng = np.random.default_rng(seed)

        def small(*shape: int) -> np.ndarray:
            return rng.normal(0, 0.2, shape).astype(np.float32)

        return cls(
            small(CONTEXTS, WIDTH), small(CONTEXTS, WIDTH), small(CONTEXTS, WIDTH), small(WIDTH, CLASSES) * np.float32(0.1),
            np.zeros(CLASSES, np.float32), np.zeros(WINDOW, np.float32), bigram.astype(np.float32),
        )

    @property
    def by_distance(self) -> np.ndarray:
        """Factors of every scored place and window place; 0 where a place may not be seen."""
        return np.where(_SEEN, np.exp(self.distance - self.distance.max())[_DISTANCE], np.float32(0))

    @property
    def _given(self) -> tuple[np.ndarray, np.ndarray]:
        """The least and most that a context's value gives each class; what is attended is a mean of values."""
        given = self.value @ self.out
        return given.min(axis=0), given.max(axis=0)

    @property
    def reach(self) -> float:
        """No two contexts score more together than this, nor less than its negative."""
        longest = [float(np.sqrt(np.square(m).sum(axis=1).max())) for m in (self.query, self.key)]
        return longest[0] * longest[1] * WIDTH**-0.5

    @property
    def spread(self) -> float:
        """A place's largest logit by ``shifted_bigram`` is between minus this and 0."""
        least, most = self._given
        return float((most - least).max())

    @property
    def shifted_bigram(self) -> np.ndarray:
        """Bigram and bias, less the most that a logit behind the context can be."""
        logits = self.bigram + self.bias
        return logits - (logits + self._given[1]).max(axis=1, keepdims=True)

    def pack(self) -> bytes:
        return b"".join(getattr(self, n).astype("<f4").tobytes() for n in self.TRAINED)

    @classmethod
    def unpack(cls, packed: bytes, bigram: np.ndarray) -> Weights:
        model = cls.fresh(bigram)
        flat, at = np.frombuffer(packed, dtype="<f4"), 0
        for name in cls.TRAINED:
            shape = getattr(model, name).shape
            size = int(np.prod(shape))
            setattr(model, name, flat[at : at + size].reshape(shape))
            at += size
        return model


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping windows over documents laid end to end: first scored place, document's begin, end.

    A document of n classes has its places scored once each, ``SCORED`` to a window, each with
    the ``WINDOW - SCORED`` places before the window's first as context.
    """
    ends = np.cumsum(lengths)
    begins = ends - lengths
    each = -(-lengths // SCORED)
    first_of = np.repeat(np.cumsum(each) - each, each)
    number = np.arange(int(each.sum())) - first_of
    return np.repeat(begins, each) + SCORED * number, np.repeat(begins, each), np.repeat(ends, each)


_BACK = WINDOW - SCORED
#: Of every scored place and window place: how far back it lies, and whether it may be seen.
_DISTANCE = (_BACK + np.arange(SCORED))[:, None] - np.arange(WINDOW)[None, :]
_SEEN = _DISTANCE >= 0
_DISTANCE = np.clip(_DISTANCE, 0, WINDOW - 1)


class Pass:
    """Forward pass over some windows; keeps what the backward pass needs.

    ``inputs[p]`` is the context seen before place p (the end's at a document's begin),
    ``targets[p]`` the class to foretell there.
    """

    def __init__(self, model: Weights, inputs: np.ndarray, targets: np.ndarray, first: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        places = first[:, None] + np.arange(-_BACK, SCORED)
        inside = (places >= begin[:, None]) & (places < end[:, None])
        self.x = inputs.take(places, mode="clip").astype(np.int64)
        self.scored = inside[:, _BACK:]
        self.last = self.x[:, _BACK:]
        self.y = targets.take(places[:, _BACK:], mode="clip")
        self.q = (model.query * np.float32(WIDTH**-0.5)).take(self.last, axis=0)
        self.k = model.key.take(self.x, axis=0)
        self.v = model.value.take(self.x, axis=0)
        self.weights = self.q @ self.k.transpose(0, 2, 1)
        if model.reach > _SAFE:
            self.weights -= self.weights.max(axis=2, keepdims=True)
        np.exp(self.weights, out=self.weights)
        self.weights *= model.by_distance
        # Nothing attends to a place outside the document.
        outside = np.flatnonzero(~inside.all(axis=1))
        self.weights[outside] *= inside[outside][:, None, :]
        # Sums of rows by products with ones, which take a fraction of the time of sums along short rows.
        self.share = (1 / np.maximum(self.weights.reshape(-1, WINDOW) @ _ONES[:WINDOW], _LEAST))[:, None]
        self.c = (self.weights @ self.v).reshape(-1, WIDTH) * self.share
        logits = self.c @ model.out
        logits += model.shifted_bigram.take(self.last.ravel(), axis=0)
        if model.spread > _SAFE:
            logits -= logits.max(axis=1, keepdims=True)
        self.at = self.y.ravel() + np.arange(0, logits.size, CLASSES)
        wanted = logits.ravel()[self.at]
        np.exp(logits, out=logits)
        self.exp, self.total = logits, logits @ _ONES
        self.log_probability = (wanted - np.log(self.total)).reshape(self.y.shape)

    def gradients(self, model: Weights) -> dict[str, np.ndarray]:
        """Of the mean negative log probability of the scored places."""
        of_place = self.scored.ravel() * np.float32(1 / max(1, self.scored.sum()))
        d_logits = self.exp
        d_logits *= (of_place / self.total)[:, None]
        d_logits.ravel()[self.at] -= of_place
        d_c = d_logits @ model.out.T
        d_c *= self.share
        # What a place's weights change together: their mean of d_c . v is d_c . c.
        mean = (d_c * self.c) @ _ONES[:WIDTH]
        d_c = d_c.reshape(*self.last.shape, WIDTH)
        d_v = self.weights.transpose(0, 2, 1) @ d_c
        d_a = d_c @ self.v.transpose(0, 2, 1)
        d_a -= mean.reshape(*self.last.shape, 1)
        d_a *= self.weights
        d_q = (d_a @ self.k) * np.float32(WIDTH**-0.5)
        d_kv = np.concatenate((d_a.transpose(0, 2, 1) @ self.q, d_v), axis=2)
        d_kv = _by_context(self.x, d_kv)
        by_distance = np.bincount(_DISTANCE.ravel(), (d_a.sum(axis=0) * _SEEN).ravel(), WINDOW)
        return {
            "query": _by_context(self.last, d_q),
            "key": d_kv[:, :WIDTH],
            "value": d_kv[:, WIDTH:],
            "out": (d_logits.T @ self.c).T,
            "bias": np.ones(len(d_logits), np.float32) @ d_logits,
            "distance": by_distance.astype(np.float32),
        }


def _by_context(contexts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of ``rows`` by context: rows sorted by it, one sum for each run."""
    order = np.argsort(contexts.astype(np.uint8), axis=None, kind="stable")
    held = contexts.ravel()[order]
    starts = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1])))
    width = rows.shape[-1]
    out = np.zeros((CONTEXTS, width), dtype=np.float32)
    out[held[starts]] = np.add.reduceat(rows.reshape(-1, width).take(order, axis=0), starts)
    return out


class Scorer:
    """The forward pass of ``Pass`` for scoring alone, from tables made once for a model.

    Attention of two contexts is a table; a window place that does not exist has a context of its own,
    ``CONTEXTS``, with nothing to attend to.
    """

    def __init__(self, model: Weights, begins: int) -> None:
        attention = np.exp(model.query @ model.key.T * np.float32(WIDTH**-0.5))
        self.attention = np.ones((CONTEXTS, CONTEXTS + 1), np.float32)
        self.attention[:, :CONTEXTS] = attention
        self.distance = np.where(_SEEN, np.exp(model.distance[_DISTANCE]), np.float32(0))
        # Nothing is to attend to a place that does not exist.
        self.attention[:, CONTEXTS] = 0
        self.value = np.zeros((CONTEXTS + 1, WIDTH), np.float32)
        self.value[:CONTEXTS] = model.value
        self.out = model.out
        self.bigram = model.shifted_bigram
        self.safe = model.spread <= _SAFE
        #: Sums of all classes, and of those that begin a word.
        self.sums = np.stack([np.ones(CLASSES), np.arange(CLASSES) < begins], axis=1).astype(np.float32)

    def __call__(
        self, inputs: np.ndarray, targets: np.ndarray, first: np.ndarray, begin: np.ndarray, end: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places scored, and there the logs of the target's probability and the beginning classes'."""
        places = first[:, None] + np.arange(-_BACK, SCORED)
        inside = (places >= begin[:, None]) & (places < end[:, None])
        x = np.where(inside, inputs.take(places, mode="clip"), np.int64(CONTEXTS))
        last = np.minimum(x[:, _BACK:], CONTEXTS - 1)
        weights = self.attention.ravel().take((last * (CONTEXTS + 1))[:, :, None] + x[:, None, :], mode="clip")
        weights *= self.distance
        summed = (weights @ self.value.take(x, axis=0)).reshape(-1, WIDTH)
        summed /= np.maximum(weights.reshape(-1, WINDOW) @ _ONES[:WINDOW], _LEAST)[:, None]
        scored = np.flatnonzero(inside[:, _BACK:])
        places, last = places[:, _BACK:].ravel()[scored], last.ravel()[scored]
        logits = summed.take(scored, axis=0) @ self.out
        logits += self.bigram.take(last, axis=0)
        if not self.safe:
            logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        sums = logits @ self.sums
        wanted = logits.ravel()[targets[places] + np.arange(0, logits.size, CLASSES)]
        return places, np.log(wanted / sums[:, 0]), np.log(sums[:, 1] / sums[:, 0])


def log_probabilities(
    model: Weights, inputs: np.ndarray, targets: np.ndarray, lengths: np.ndarray, begins: int, batch: int = 256
) -> tuple[np.ndarray, np.ndarray]:
    """Natural logs for every place, each scored in one window: of the target's probability, and of
    the first ``begins`` classes' together.
    """
    score = Scorer(model, begins)
    first, begin, end = windows(lengths)
    of_target = np.zeros(len(targets), dtype=np.float64)
    of_begin = np.zeros(len(targets), dtype=np.float64)
    for at in range(0, len(first), batch):
        part = slice(at, at + batch)
        places, target, beginning = score(inputs, targets, first[part], begin[part], end[part])
        of_target[places] = target
        of_begin[places] = beginning
    return of_target, of_begin


def shifted(contexts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The context before every place, the end's at each document's begin."""
    inputs = np.empty_like(contexts)
    inputs[1:] = contexts[:-1]
    starts = np.cumsum(lengths) - lengths
    inputs[starts[lengths > 0]] = END
    return inputs


class Trainer:
    """Adam over batches of windows, from given weights on."""

    def __init__(self, model: Weights, rate: float, seed: int | tuple[int, ...] = 11, batch: int = 128) -> None:
        self.model, self.rate, self.batch = model, rate, batch
        self.rng = np.random.default_rng(seed)
        #: All trained weights in one row, which the model's arrays are parts of, and what Adam keeps of each.
        self.flat = np.frombuffer(model.pack(), dtype="<f4").copy()
        self.mean, self.square = np.zeros_like(self.flat), np.zeros_like(self.flat)
        at = 0
        for name in Weights.TRAINED:
            own = getattr(model, name)
            setattr(model, name, self.flat[at : at + own.size].reshape(own.shape))
            at += own.size
        self.steps = self.windows = 0

    def learn(self, inputs: np.ndarray, targets: np.ndarray, lengths: np.ndarray, share: int = 0, shares: int = 1, passes: int = 1) -> None:
        """Every window of the documents whose number modulo ``shares`` is ``share``, ``passes`` times, in random order."""
        first, begin, end = windows(lengths)
        chosen = self.rng.permutation(np.tile(np.arange(share, len(first), shares), passes))
        for at in range(0, len(chosen), self.batch):
            part = chosen[at : at + self.batch]
            self._step(Pass(self.model, inputs, targets, first[part], begin[part], end[part]).gradients(self.model))
        self.windows += len(chosen)

    def _step(self, gradients: dict[str, np.ndarray]) -> None:
        self.steps += 1
        gradient = np.concatenate([gradients[n].ravel() for n in Weights.TRAINED])
        self.mean *= np.float32(0.9)
        self.mean += np.float32(0.1) * gradient
        self.square *= np.float32(0.99)
        gradient *= gradient
        self.square += np.float32(0.01) * gradient
        change = np.sqrt(self.square / np.float32(1 - 0.99**self.steps))
        change += np.float32(1e-8)
        np.divide(self.mean / np.float32(1 - 0.9**self.steps), change, out=change)
        self.flat -= np.float32(self.rate) * change
