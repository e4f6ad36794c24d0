"""Numpy part of the hashed maximum-entropy model: contexts, probabilities and sums for the gradient.

A token stands in one of LEAVES leaves; a leaf is a class and a place in it. The class is a softmax over CLASSES given
the context, the place another one given the context and the class. Three features of a context are active: the leaf
before, the last two together (n-grams), and the second before (a skip). Each is hashed, with the class for places, to a
row of weights, one for every outcome; rows may be shared. A fixed prior (log shares of classes and places among the training
tokens) is added, so weights are departures from it, and a model of zeros is the unigram model of leaves.

A context and its target are one code of 32 bits, so training texts come down to counts of codes: 2^32 at most, however
long the texts. Contexts are numbered by a permutation that spreads frequent ones over all codes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

CLASSES = 32
LEAVES = CLASSES * CLASSES
#: The leaf before the first one of a text.
START = LEAVES
BACK = 2
#: Rows of weights for classes and for places in a class.
ROWS = (1 << 14, 1 << 16)
#: Positions that are computed together.
BATCH = 1 << 15

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class Model:
    """prior: of classes, and of places by class (natural logs); weights: ROWS[0] and ROWS[1] rows of CLASSES."""

    prior: tuple[np.ndarray, np.ndarray]
    weights: tuple[np.ndarray, np.ndarray]


def untrained(mass: np.ndarray) -> Model:
    """mass: of each leaf. Leaves without mass are practically impossible."""
    m = np.maximum(mass.astype(np.float64), 1e-9).reshape(CLASSES, CLASSES)
    classes, places = m.sum(axis=1), m / m.sum(axis=1, keepdims=True)
    return Model((np.log(classes / classes.sum()).astype(np.float32), np.log(places).astype(np.float32)), tuple(np.zeros((n, CLASSES), np.float32) for n in ROWS))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(29))


#: An odd number and its inverse modulo 2^22, for the permutation of contexts.
_TURN = 0x2545F5
_BACK = pow(_TURN, -1, 1 << 22)


def positions(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and code of every leaf of the texts: its context (22 bits, permuted), then itself (10 bits)."""
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    pads = np.full(BACK, START, np.uint16)
    line = np.concatenate([x for t in texts for x in (pads, t)]).astype(np.uint32)
    sizes = np.array([len(t) for t in texts])
    number = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(number)) + BACK * (number + 1)
    context = (line[at - 1] << np.uint32(11)) | line[at - 2]
    return number, ((context * np.uint32(_TURN)) & np.uint32((1 << 22) - 1)) << np.uint32(10) | line[at]


def _context(code: np.ndarray) -> list[np.ndarray]:
    """Hashes of the features of a code's context."""
    context = (code >> np.uint32(10)).astype(np.uint64) * np.uint64(_BACK) & np.uint64((1 << 22) - 1)
    one, two = context >> np.uint64(11), context & np.uint64((1 << 11) - 1)
    return [_mix(k * _A + _B) for k in (one + np.uint64(1 << 12), context + np.uint64(1 << 30), two + np.uint64(2 << 12))]


def _rows(hashes: list[np.ndarray], classes: np.ndarray | None) -> list[np.ndarray]:
    """Row of each feature, for the class or, with the class given, for the place in it; 16 bits sort quickly."""
    if classes is None:
        return [(h & np.uint64(ROWS[0] - 1)).astype(np.uint16) for h in hashes]
    own = (classes.astype(np.uint64) + np.uint64(1)) * _A
    return [((_mix(h + own) >> np.uint64(20)) & np.uint64(ROWS[1] - 1)).astype(np.uint16) for h in hashes]


def _logits(prior: np.ndarray, weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    x = weights.take(rows[0], axis=0)
    x += prior
    for r in rows[1:]:
        x += weights.take(r, axis=0)
    return np.clip(x, -80, 80, out=x)  # no logit of a trained model comes near these


_ONES = np.ones(CLASSES, np.float32)


def log_probabilities(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log of the probability of each text's leaves."""
    out = np.zeros(len(texts))
    numbers, codes = positions(texts)
    for i in range(0, len(codes), BATCH):
        number, code = numbers[i : i + BATCH], codes[i : i + BATCH]
        leaf, hashes = (code & np.uint32(1023)).astype(np.int64), _context(code)
        own, log = leaf // CLASSES, np.zeros(len(code))
        for level, (prior, target, given) in enumerate(((model.prior[0], own, None), (model.prior[1].take(own, axis=0), leaf % CLASSES, own))):
            x = _logits(prior, model.weights[level], _rows(hashes, given))
            log += x[np.arange(len(x)), target]
            log -= np.log((np.exp(x, out=x) @ _ONES).astype(np.float64))
        out += np.bincount(number, log, len(texts))
    return out


def _add(total: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """total[rows] += values, where rows repeat."""
    order = np.argsort(rows, kind="stable")
    ranked = rows[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    total[ranked[first]] += np.add.reduceat(values.take(order, axis=0), first, axis=0)


def sums(model: Model, codes: np.ndarray, n: np.ndarray, seen: tuple[np.ndarray, np.ndarray] | None, expected: tuple[np.ndarray, np.ndarray]) -> None:
    """Adds up, for every weight, how often its outcome occurs with its row (seen, unless None) and how often the model
    expects it to; the gradient of the log-likelihood is the difference. codes are sorted and occur n times each. A
    context, or a context and class, is computed once for all its outcomes."""
    leaf = (codes & np.uint32(1023)).astype(np.int64)
    for level, (shift, target) in enumerate(((10, leaf // CLASSES), (5, leaf % CLASSES))):
        key = codes >> np.uint32(shift)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        total = np.add.reduceat(n, first).astype(np.float32) if len(first) else np.zeros(0, np.float32)
        if seen is not None and len(first):
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(codes))))
        for i in range(0, len(first), BATCH):
            code, weight = codes[first[i : i + BATCH]], total[i : i + BATCH]
            given = (code >> np.uint32(5) & np.uint32(31)).astype(np.int64) if level else None
            rows = _rows(_context(code), given)
            p = _logits(model.prior[0] if given is None else model.prior[1].take(given, axis=0), model.weights[level], rows)
            np.exp(p, out=p)
            p *= (weight / (p @ _ONES))[:, None]
            for r in rows:
                _add(expected[level], r, p)
            if seen is not None:
                own = slice(first[i], first[i + BATCH] if i + BATCH < len(first) else len(codes))
                for r in rows:
                    np.add.at(seen[level].reshape(-1), r.astype(np.int64)[group[own] - i] * CLASSES + target[own], n[own].astype(np.float64))


def step(model: Model, seen: tuple[np.ndarray, np.ndarray], expected: tuple[np.ndarray, np.ndarray], rate: float, ease: float) -> Model:
    """A gradient step, scaled for each weight by what it sees and expects; `ease` holds back weights of rare rows."""
    return Model(model.prior, tuple(w + (rate * (s - e) / (np.maximum(s, e) + ease)).astype(np.float32) for w, s, e in zip(model.weights, seen, expected, strict=True)))
