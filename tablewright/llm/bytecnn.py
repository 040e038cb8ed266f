"""A small convolutional network over bytes, trained in numpy.

A filter of width w adds one learned weight per byte and place, then ReLU and a maximum over the window. Windows start
every ``stride`` bytes and are two strides long, so they overlap by half and cover the text to its last byte. Features
of all windows are read in one pass: weights of neighbouring places are added up to tables over byte pairs, and maxima of
half windows are combined.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

_PAD = 8


@dataclass
class ByteFilters:
    """``weights[i]`` has shape (width, 256, filters) with an even width; byte 0 is padding and weighs nothing."""

    weights: list[np.ndarray]
    bias: np.ndarray
    stride: int = 128
    _pairs: list[list[np.ndarray]] = field(default_factory=list, repr=False)

    @staticmethod
    def create(widths: dict[int, int], stride: int, seed: int) -> "ByteFilters":
        rng = np.random.default_rng(seed)
        weights = [(rng.standard_normal((w, 256, n)) * 0.3).astype(np.float32) for w, n in widths.items()]
        for w in weights:
            w[:, 0] = 0
        return ByteFilters(weights, np.zeros(sum(widths.values()), np.float32), stride)

    def tables(self) -> list[list[np.ndarray]]:
        if not self._pairs:
            for w in self.weights:
                self._pairs.append(
                    [(w[j][:, None, :] + w[j + 1][None, :, :]).reshape(65536, -1) for j in range(0, len(w), 2)]
                )
        return self._pairs

    def windows(self, texts: list[bytes], batch_bytes: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
        """Features of every window of every text, and how many windows each text has (at least one)."""
        halves = np.array([max(1, -(-len(t) // self.stride)) for t in texts], np.int64)
        counts = np.maximum(halves - 1, 1)
        # Every text begins at a multiple of the stride, followed by padding that no filter reads across.
        step = self.stride
        flat = b"".join(t.ljust(int(h) * step, b"\0") + b"\0" * step for t, h in zip(texts, halves))
        data = np.frombuffer(flat, np.uint8)
        blocks = len(data) // step
        maxima = np.zeros((blocks, len(self.bias)), np.float32)
        per = max(1, batch_bytes // step)
        padded = np.concatenate([data, np.zeros(_PAD, np.uint8)])
        for at in range(0, blocks, per):
            many = min(per, blocks - at)
            part = padded[at * step : (at + many) * step + _PAD].astype(np.int32)
            codes = part[:-1] * 256 + part[1:]
            first = 0
            for tables in self.tables():
                n = tables[0].shape[1]
                rows = many * step
                sums = tables[0][codes[:rows]]
                for j, table in enumerate(tables[1:], 1):
                    sums += table[codes[2 * j : 2 * j + rows]]
                maxima[at : at + many, first : first + n] = sums.reshape(many, step, n).max(axis=1)
                first += n
        starts = np.concatenate([[0], np.cumsum(halves + 1)[:-1]])
        rows = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        second = rows + 1
        single = np.repeat(halves == 1, counts)
        second[single] = rows[single]
        return np.maximum(np.maximum(maxima[rows], maxima[second]) + self.bias, 0), counts

    def trained(self, windows: np.ndarray):
        """Forward pass for equal windows (n, 2 * stride) that also gives the places of the maxima."""
        n, length = windows.shape
        padded = np.concatenate([windows, np.zeros((n, _PAD), np.uint8)], axis=1).astype(np.int32)
        codes = padded[:, :-1] * 256 + padded[:, 1:]
        self._pairs = []
        features, places = [], []
        for tables in self.tables():
            sums = tables[0][codes[:, :length]]
            for j, table in enumerate(tables[1:], 1):
                sums += table[codes[:, 2 * j : 2 * j + length]]
            place = sums.argmax(axis=1)
            places.append(place)
            features.append(np.take_along_axis(sums, place[:, None, :], axis=1)[:, 0])
        return np.maximum(np.concatenate(features, axis=1) + self.bias, 0), places, padded

    def gradients(self, places: list[np.ndarray], padded: np.ndarray, upstream: np.ndarray):
        """Gradients of weights and bias; ``upstream`` is already zero where ReLU is."""
        grads, first = [], 0
        row = np.arange(len(padded))[:, None]
        for w, place in zip(self.weights, places):
            n = w.shape[2]
            part = upstream[:, first : first + n]
            grad = np.zeros_like(w)
            column = np.broadcast_to(np.arange(n), place.shape)
            for j in range(len(w)):
                np.add.at(grad[j], (padded[row, place + j], column), part)
            grad[:, 0] = 0
            grads.append(grad)
            first += n
        return grads, upstream.sum(axis=0)


class Adam:
    def __init__(self, parameters: list[np.ndarray], rate: float):
        self.parameters, self.rate, self.step = parameters, rate, 0
        self.mean = [np.zeros_like(p) for p in parameters]
        self.square = [np.zeros_like(p) for p in parameters]

    def update(self, grads: list[np.ndarray]) -> None:
        self.step += 1
        for p, g, m, s in zip(self.parameters, grads, self.mean, self.square):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(s / (1 - 0.99**self.step)) + 1e-6)


def sample_windows(text: bytes, length: int, most: int, seed: int) -> list[bytes]:
    """Up to ``most`` windows spread over the whole text, as training rows of one length."""
    if len(text) <= length:
        return [text.ljust(length, b"\0")]
    rng = np.random.default_rng(seed)
    pieces = min(most, -(-len(text) // length))
    edges = np.linspace(0, len(text) - length, pieces + 1).astype(np.int64)
    starts = [int(rng.integers(a, max(a, b) + 1)) for a, b in zip(edges[:-1], edges[1:])]
    return [text[s : s + length] for s in starts]
