"""A linear-chain conditional random field over word shapes, trained and decoded in numpy batches."""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{place}-{kind}" for kind in KINDS for place in "BI"))
#: Sentences of a labelled table that training reads at most.
MOST_SENTENCES = 5000

_TESTS = tuple(
    re.compile(p)
    for p in (
        r"[0-9]",
        r"@",
        r"[A-Za-z]",
        r"^\W*\+",
        r"^\W*\(",
        r"\)",
        r"-",
        r"^\W*[0-9]+\W*$",
        r"^\W*[0-9]{4}\W*$",
        r"^\W*[0-9]{1,3}\W*$",
        r"^\W*[0-9]{14,19}\W*$",
        r"^\W*[0-9]{1,3}(\.[0-9]{1,3}){3}\W*$",
        r"^\W*[0-9]+(\.[0-9]+){1,2}\W*$",
        r"^\W*[0-9]{4}(-[0-9]{4}){3}\W*$",
        r"^\W*[0-9]{3}-[0-9]{4}\W*$",
        r"^\W*[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}\W*$",
        r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        r"[,;:!?]$",
        r"\.$",
    )
)
#: Features of a word's own shape, those of both neighbours, and one that always holds.
_OWN = len(_TESTS)
N_FEATURES = 3 * _OWN + 3


def shape(word: str) -> np.ndarray:
    return np.array([bool(t.search(word)) for t in _TESTS], np.float64)


PLAIN = shape("word")


def features(shapes: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Rows of features from the shapes of words and of the words beside them (zeros at a text's ends)."""
    ends = np.stack([~before.any(1), ~after.any(1)], 1).astype(np.float64)
    return np.concatenate([shapes, before, after, ends, np.ones((len(shapes), 1))], 1)


class Field:
    """Weights per feature and label, and per pair of neighbouring labels."""

    def __init__(self, emit: np.ndarray, step: np.ndarray):
        self.emit, self.step = emit, step
        #: A word whose best label other than O is this much below O is O in every best path, whatever its neighbours.
        self.forced = 2 * (step.max() - step.min())

    def viterbi(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels of many segments (segment, place, label); each segment stands between words labelled O."""
        n, t, k = scores.shape
        best = scores[:, 0] + self.step[0]
        back = np.zeros((n, t, k), np.int64)
        ends = np.zeros((n, k))
        for i in range(1, t + 1):
            ends[lengths == i] = best[lengths == i] + self.step[:, 0]
            if i < t:
                every = best[:, :, None] + self.step[None]
                back[:, i] = every.argmax(1)
                best = every.max(1) + scores[:, i]
        out = np.zeros((n, t), np.int64)
        rows = np.arange(n)
        label = ends.argmax(1)
        for i in range(t - 1, -1, -1):
            inside = i < lengths
            out[inside, i] = label[inside]
            label = np.where(inside, back[rows, i, label], label)
        return out


def train(labelled: DataFrame, rounds: int = 60, rate: float = 1.0, decay: float = 1e-4) -> Field:
    """Fit a field to rows (sentence, place, word, label) by gradient steps on the conditional likelihood.

    At most ``MOST_SENTENCES`` sentences, those of the smallest numbers, are read; unknown labels count as O.
    """
    rows = labelled.filter(labelled.sentence < MOST_SENTENCES).orderBy("sentence", "place").collect()
    sentences: dict[int, list] = {}
    for row in rows:
        sentences.setdefault(row.sentence, []).append((row.word or "", row.label))
    if not sentences:
        emit = np.zeros((N_FEATURES, len(LABELS)))
        emit[-1, 0] = 1.0
        return Field(emit, np.zeros((len(LABELS), len(LABELS))))
    number = {label: i for i, label in enumerate(LABELS)}
    longest, n, k = max(map(len, sentences.values())), len(sentences), len(LABELS)
    x = np.zeros((n, longest, N_FEATURES))
    y = np.zeros((n, longest), np.int64)
    held = np.zeros((n, longest), bool)
    for s, words in enumerate(sentences.values()):
        shapes = np.stack([shape(w) for w, _ in words])
        edge = np.zeros((1, _OWN))
        x[s, : len(words)] = features(shapes, np.concatenate([edge, shapes[:-1]]), np.concatenate([shapes[1:], edge]))
        y[s, : len(words)] = [number.get(label, 0) for _, label in words]
        held[s, : len(words)] = True
    both = held[:, 1:]
    seen_emit = np.einsum("ntf,ntk->fk", x, np.eye(k)[y] * held[:, :, None])
    seen_step = np.einsum("ntj,ntk->jk", np.eye(k)[y[:, :-1]] * both[:, :, None], np.eye(k)[y[:, 1:]])
    emit, step = np.zeros((N_FEATURES, k)), np.zeros((k, k))
    squares = [np.full_like(emit, 1e-8), np.full_like(step, 1e-8)]
    for _ in range(rounds):
        scores = x @ emit
        forward, backward = scores.copy(), np.zeros_like(scores)
        for i in range(1, longest):
            into = np.logaddexp.reduce(forward[:, i - 1, :, None] + step[None], axis=1)
            forward[:, i] = np.where(held[:, i, None], into + scores[:, i], forward[:, i - 1])
        for i in range(longest - 2, -1, -1):
            out = np.logaddexp.reduce(step[None] + (scores[:, i + 1] + backward[:, i + 1])[:, None], axis=2)
            backward[:, i] = np.where(held[:, i + 1, None], out, 0.0)
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        alone = np.exp(forward + backward - total[:, None, None]) * held[:, :, None]
        pair = forward[:, :-1, :, None] + step[None, None] + (scores + backward)[:, 1:, None] - total[:, None, None, None]
        pair = np.exp(np.where(both[:, :, None, None], pair, -np.inf)).sum((0, 1))
        grads = (
            (seen_emit - x.reshape(-1, N_FEATURES).T @ alone.reshape(-1, k)) / n - decay * emit,
            (seen_step - pair) / n - decay * step,
        )
        for weights, grad, square in zip((emit, step), grads, squares, strict=True):
            square += grad * grad
            weights += rate * grad / np.sqrt(square)
    return Field(emit, step)


def labelled_sentences(spark: SparkSession, sentences: int = 200, seed: int = 5) -> DataFrame:
    """A small labelled table made by rule: filler words around personal data of the four kinds, and numbers that are none."""
    draw = random.Random(seed)
    digits = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    word = lambda: "".join(draw.choice(("an", "the", "ti", "or", "re", "lo", "ma", "su")) for _ in range(draw.randint(1, 4)))

    def email() -> list[str]:
        return [f"{word()}{draw.choice(['', '.', '_', '+'])}{digits(draw.randint(0, 2))}@{word()}{digits(1)}.{word()}.com"]

    def ip() -> list[str]:
        return [".".join(str(draw.randint(0, 255)) for _ in range(4))]

    def card() -> list[str]:
        made = draw.choice([1, 2, 3])
        if made == 1:
            return [digits(draw.randint(14, 19))]
        groups = [digits(4) for _ in range(4)]
        return groups if made == 2 else ["-".join(groups)]

    def phone() -> list[str]:
        made = draw.choice([1, 2, 3, 4])
        if made == 1:
            return [f"+{digits(draw.randint(1, 2))}", f"({digits(3)})", f"{digits(3)}-{digits(4)}"]
        if made == 2:
            return [f"({digits(3)})", f"{digits(3)}-{digits(4)}"]
        if made == 3:
            return [f"+{digits(1)}-{digits(3)}-{digits(3)}-{digits(4)}"]
        return [f"{digits(3)}{draw.choice('-.')}{digits(3)}-{digits(4)}"]

    def none() -> list[str]:
        return draw.choice(
            [[digits(draw.randint(1, 6))], [f"{digits(1)}.{digits(2)}"], [f"{digits(1)}.{digits(1)}.{digits(1)}"], [f"@{word()}"], [f'"{digits(4)}ab{digits(6)}"'], [f"{word()}{digits(2)}"], [f"({digits(4)})"]]
        )

    rows = []
    for sentence in range(sentences):
        words = []
        for _ in range(draw.randint(1, 3)):
            words += [(word() + draw.choice(["", "", "", ",", "."]), "O") for _ in range(draw.randint(0, 6))]
            kind = draw.choice([*KINDS, None])
            made = {"email": email, "ip": ip, "card": card, "phone": phone, None: none}[kind]()
            labels = ["O" if kind is None else f"{'BI'[i > 0]}-{kind}" for i in range(len(made))]
            made[-1] += draw.choice(["", "", "", ",", ".", ";"])
            words += list(zip(made, labels, strict=True))
        words += [(word(), "O") for _ in range(draw.randint(0, 4))]
        rows += [(sentence, place, w, label) for place, (w, label) in enumerate(words)]
    return spark.createDataFrame(rows, "sentence long, place long, word string, label string")
