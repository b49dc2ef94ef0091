"""Weighted-Jaccard signatures of word-shingle multisets (BagMinHash).

Every shingle carries a weight, its number of occurrences.  The weight axis is
cut into dyadic layers (0,1], (1,2], (2,4], (4,8], ...  For each shingle and
layer one seeded Poisson process runs over all ``m`` slots of the signature at
once; each point holds a time, a slot and a level in the layer, and counts if
the shingle's weight covers that level.  A slot keeps the earliest point.  Two
bags agree in a slot with probability sum(min) / sum(max) of their weights, the
weighted Jaccard similarity.  Processes stop at a horizon that scales with one
over the bag's total weight, so a bag costs about m * ln(m) points however
large its weights are; bags with an unfilled slot run on to a later horizon.
"""

from __future__ import annotations

import numpy as np

from salesops.llm.text import U64, Words, mix, rolling, seeded, words

#: Signature slots and slots in a band: 20 bands of 5 miss a pair of similarity 0.8 with probability (1 - 0.8**5)**20 = 0.0004.
SLOTS, ROWS = 100, 5
SHINGLE = 5
_STEP = U64(0x9E3779B97F4A7C15)
_SLOT_SEED, _LEVEL_SEED = seeded(101), seeded(102)


def shingles(w: Words, h: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every ``width`` consecutive words of a row; a row of fewer words, but not none, has one shingle of them all."""
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    value = rolling(h, width)
    inside = w.doc[: len(value)] == w.doc[width - 1 :] if len(value) else np.zeros(0, bool)
    doc, value = w.doc[: len(value)][inside], value[inside]
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        own = count[short].astype(U64) * _STEP
        for k in range(width - 1):
            has = count[short] > k
            own[has] = own[has] * U64(0x2545F4914F6CDD1D) + h[w.first[short[has]] + k]
        doc, value = np.concatenate([doc, short]), np.concatenate([value, own])
    return doc, mix(value)


def bags(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, shingle) with its number of occurrences, ordered by row and shingle."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return doc[at], value[at], np.diff(np.append(at, len(doc)))


def _points(doc, value, weight, horizon, best, token, m):
    """Run every process of the given bags up to its row's horizon; lower ``best`` and set ``token``."""
    layers = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    item = np.repeat(np.arange(len(doc)), layers)
    layer = np.arange(len(item)) - np.repeat(np.cumsum(layers) - layers, layers)
    low = np.where(layer == 0, 0.0, 2.0 ** (layer - 1))
    size = np.where(layer == 0, 1.0, low)
    state = mix(value[item] + (layer.astype(U64) + U64(1)) * _SLOT_SEED)
    row, cover, rate, end = doc[item], weight[item].astype(float), m * size, horizon[doc[item]]
    time = np.zeros(len(item))
    slots, times, marks = [], [], []
    while len(row):
        state = state + _STEP
        drawn = mix(state)
        time = time - np.log(((drawn >> U64(11)).astype(float) + 1.0) * 2.0**-53) / rate
        live = time <= end
        row, cover, rate, end, time, state, low, size, drawn = (x[live] for x in (row, cover, rate, end, time, state, low, size, drawn))
        if not len(row):
            break
        place = mix(drawn ^ _SLOT_SEED)
        slot = (place >> U64(16)) % U64(m)
        level = low + size * ((mix(drawn ^ _LEVEL_SEED) >> U64(11)).astype(float) * 2.0**-53)
        ok = level < cover
        slots.append(row[ok] * m + slot[ok].astype(np.int64))
        times.append(time[ok])
        marks.append(place[ok])
    if not slots:
        return
    slots, times, marks = np.concatenate(slots), np.concatenate(times), np.concatenate(marks)
    np.minimum.at(best, slots, times)
    hit = times == best[slots]
    token[slots[hit]] = marks[hit]


def signatures(doc: np.ndarray, value: np.ndarray, weight: np.ndarray, rows: int, m: int = SLOTS) -> np.ndarray:
    """``rows`` x ``m`` tokens; rows without shingles have zeros."""
    best, token = np.full(rows * m, np.inf), np.zeros(rows * m, U64)
    total = np.bincount(doc, weight, rows)
    horizon = np.divide(np.log(m) + 3.0, total, out=np.zeros(rows), where=total > 0)
    todo = total > 0
    while todo.any():
        pick = todo[doc]
        _points(doc[pick], value[pick], weight[pick], horizon, best, token, m)
        todo = todo & np.isinf(best.reshape(rows, m)).any(axis=1)
        horizon = horizon * 2
    return token.reshape(rows, m)


def band_hashes(token: np.ndarray, per_band: int = ROWS) -> np.ndarray:
    """One hash for each band of ``per_band`` slots; bands at different places never share a hash by construction of the seed."""
    rows, m = token.shape
    t = token.reshape(rows, m // per_band, per_band)
    out = np.zeros(t.shape[:2], U64)
    for k in range(per_band):
        out = mix(out * U64(0x2545F4914F6CDD1D) + t[:, :, k])
    return mix(out + np.arange(m // per_band, dtype=U64) * _STEP)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact weighted Jaccard similarity of two bags given as sorted shingles and counts; 0 if either is empty."""
    (va, ca), (vb, cb) = a, b
    if not len(va) or not len(vb):
        return 0.0
    at = np.searchsorted(vb, va)
    at[at == len(vb)] = 0
    same = vb[at] == va
    both = int(np.minimum(ca[same], cb[at[same]]).sum())
    return both / (int(ca.sum()) + int(cb.sum()) - both)


def text_bags(texts, width: int = SHINGLE) -> list[tuple[np.ndarray, np.ndarray]]:
    """The bag of each text of an Arrow array."""
    w = words(texts)
    doc, value, count = bags(*shingles(w, w.hashes(), width))
    cut = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [(value[i:j], count[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]
