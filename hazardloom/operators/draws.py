"""Random draws as hashes: a draw follows from (seed, purpose, key) alone, wherever and in whatever order it is made."""

from __future__ import annotations

import math

import numpy as np

#: fixed values of the published splitmix64 generator
GOLDEN, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: cumulative Poisson(1) probabilities, as far as doubles tell them from 1
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])
POISSON = POISSON[POISSON < 1.0]
#: most splits drawn of a node's feature
MOST_DRAWN = 256
#: purposes
BAG, FEATURE, SPLIT, DEAL = 1, 2, 3, 4


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(FIRST)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(SECOND)
    return x ^ (x >> np.uint64(31))


def salt(*parts: int) -> int:
    """One 64-bit number of several."""
    out = np.zeros(1, np.uint64)
    for p in parts:
        out = mix64(out + np.uint64((GOLDEN + p) & 0xFFFFFFFFFFFFFFFF))
    return int(out[0])


def uniforms(keys: np.ndarray, *parts: int) -> np.ndarray:
    """A number in [0, 1) for each key (whole numbers of 64 bits)."""
    return (mix64(np.asarray(keys, np.int64).view(np.uint64) ^ np.uint64(salt(*parts))) >> np.uint64(11)).astype(np.float64) / 2.0**53


def content_keys(columns: list[np.ndarray], number: np.ndarray) -> np.ndarray:
    """A key for each row from its columns (whole numbers, or the bits of doubles) and its number among equal rows."""
    h = np.zeros(len(number), np.uint64)
    for c in columns:
        bits = (c + 0.0).astype(np.float64).view(np.uint64) if np.asarray(c).dtype.kind == "f" else np.asarray(c, np.int64).view(np.uint64)
        h = mix64(h + np.uint64(GOLDEN) + bits)
    return mix64(h ^ mix64(np.asarray(number, np.int64).view(np.uint64) + np.uint64(GOLDEN))).view(np.int64)


def numbers_among_equals(columns: list[np.ndarray]) -> np.ndarray:
    """How many equal rows come before each row."""
    order = np.lexsort(columns)
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    begin = np.flatnonzero(new)
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    return out


def copies(keys: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """In-bag copies of rows, by their keys, in a tree: Poisson(1)."""
    return np.searchsorted(POISSON, uniforms(keys, seed, tree, BAG), side="right")


def drawn_features(nodes: np.ndarray, p: int, mtry: int, seed: int, tree: int) -> np.ndarray:
    """``mtry`` of ``p`` features for each node, without replacement, in the order of the draw."""
    if mtry >= p:
        return np.tile(np.arange(p), (len(nodes), 1))
    keys = (np.asarray(nodes, np.int64)[:, None] << 20) | np.arange(p)
    return np.argsort(uniforms(keys, seed, tree, FEATURE), axis=1)[:, :mtry]


def drawn_ranks(many: np.ndarray, k: int, nodes: np.ndarray, features: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """For each (node, feature), ``k`` of the ranks below ``many`` without replacement, rising; all of them where there are no more.

    Floyd's sampling: the i-th draw is from the first ``many - k + i + 1`` ranks, and a rank drawn already stands for the last of these.
    """
    chosen = np.broadcast_to(np.arange(k), (len(many), k)).astype(np.int64)
    at = np.flatnonzero(many > k)
    if not len(at):
        return chosen
    m, out = many[at], np.zeros((len(at), k), np.int64)
    keys = ((np.asarray(nodes, np.int64)[at] << 20) | np.asarray(features, np.int64)[at]) << 8
    for i in range(k):
        last = m - k + i
        drawn = (uniforms(keys | i, seed, tree, SPLIT) * (last + 1)).astype(np.int64)
        out[:, i] = np.where((out[:, :i] == drawn[:, None]).any(axis=1), last, drawn)
    chosen[at] = np.sort(out, axis=1)
    return chosen
