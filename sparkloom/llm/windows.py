"""Fixed-length windows of a sequence of units (bytes or words), thinned to content-chosen anchors.

Every window of `length` units has an anchor: its smallest `gram` of units by hash, the leftmost of equals. Neighbouring
windows mostly share their anchor, so a text falls into runs of windows with one anchor each, about 2 per `length`
units. Equal windows have equal anchors at equal distances, wherever they stand: whatever compares windows can work
within the runs of one anchor gram. A run covers the units from its first window's start to its last window's end.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np

from .spans import BYTES, NOT_SPACE, hashes, mix, runs, sums

_U = np.uint64
#: Units taken at once: a longer block goes in parts that overlap by a window, which bounds memory and keeps places in 24 bits.
PART = 1 << 20
_LOW = (1 << 24) - 1


@dataclass
class Runs:
    """Parallel arrays: text number, first window's start in the block, count of windows, anchor's distance, names.

    `run` names a run by all that its windows cover, their count and the anchor's place; `gram` names the anchor.
    """

    text: np.ndarray
    start: np.ndarray
    count: np.ndarray
    reach: np.ndarray  # from the first window's start to the anchor
    gram: np.ndarray
    run: np.ndarray


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[p : p + w] for every p with a whole window."""
    n = len(x)
    if n < w:
        return x[:0]
    full = np.concatenate([x, np.full(-n % w, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def _part(units: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> Runs:
    n, w = len(units), length - gram + 1
    none = np.zeros(0, "i8")
    if n < length:
        return Runs(none, none, none, none, none.view("u8"), none.view("u8"))
    s = sums(units)
    at = np.arange(n - gram + 1)
    g = hashes(s, at, at + gram)
    best = sliding_min((g & ~_U(_LOW)) | (at & _LOW).astype("u8"), w)
    p = np.arange(n - length + 1)
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(p)]
    valid = p + length <= ends
    anchor = p + (((best & _U(_LOW)).astype("i8") - p) & _LOW)
    change = np.ones(len(p), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1] | (ends[1:] != ends[:-1])
    start = np.flatnonzero(change & valid)
    # a run ends where the next one starts or where windows stop fitting
    stop = np.flatnonzero(valid & np.concatenate([change[1:] | ~valid[1:], [True]])) + 1
    text = np.searchsorted(offsets, start, "right") - 1
    count, reach, name = stop - start, anchor[start] - start, g[anchor[start]]
    whole = hashes(s, start, stop - 1 + length)
    run = mix(whole ^ mix(name + _U(1)) ^ (count.astype("u8") << _U(40)) ^ (reach.astype("u8") << _U(20)))
    return Runs(text, start, count, reach, name, run)


def runs_of(units: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> Runs:
    """Runs of all whole windows in the texts [offsets[i], offsets[i + 1]) of a block of 64-bit units."""
    if len(units) < PART + length:
        return _part(units, offsets, length, gram)
    found = []
    for low in range(0, len(units), PART):
        some = units[low : low + PART + length - 1]
        r = _part(some, np.clip(offsets - low, 0, len(some)), length, gram)
        r.start = r.start + low
        found.append(r)
    return Runs(*(np.concatenate([getattr(r, f.name) for r in found]) for f in fields(Runs)))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of a block's texts, and each text's first word (n + 1 numbers)."""
    cuts = [0, len(data)]
    if len(data) > PART:  # in parts cut at white space
        gaps = np.flatnonzero(~NOT_SPACE[data])
        at = np.searchsorted(gaps, np.arange(PART, len(data), PART))
        cuts = np.unique(np.concatenate([cuts, gaps[at[at < len(gaps)]]])).tolist()
    found, first = [], np.zeros(len(offsets), "i8")
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        starts, ends, begin = runs(NOT_SPACE[data[a:b]], np.clip(offsets - a, 0, b - a))
        found.append(hashes(sums(BYTES[data[a:b]]), starts, ends))
        first += begin
    return np.concatenate(found) if found else np.zeros(0, "u8"), first


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans joined where they touch or overlap."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return start[new], end[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(end) - 1]])]
