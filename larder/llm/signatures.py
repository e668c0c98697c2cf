"""SuperMinHash signatures of many hashed sets at once."""

from __future__ import annotations

import numpy as np

from larder.llm.textblocks import U64, mix

#: Shingles worked on at once by one call of `superminhash`.
SLICE = 1 << 17
_EMPTY = ~U64(0)


def superminhash(hashes: np.ndarray, bounds: np.ndarray, slots: int, seed: int = 7) -> np.ndarray:
    """A (sets x slots) array of 64-bit signature values; set i holds hashes[bounds[i]:bounds[i + 1]].

    Every element draws one random permutation of the slots and visits them in its order; a visit in
    round j offers the value j + r with r uniform in [0, 1). So all slots a set has filled in rounds up
    to j are final, and a set leaves as soon as its slots are all filled: sets much larger than
    slots * ln(slots) need one round, as against one hash per element and slot. The ranks of one
    element are a permutation, hence the lower variance on small sets. Repeated elements change
    nothing. An empty set keeps the largest value in all slots.
    """
    sets = len(bounds) - 1
    out = np.full((sets, slots), _EMPTY)
    first = 0
    while first < sets:
        end = max(first + 1, int(np.searchsorted(bounds, bounds[first] + SLICE, "right")) - 1)
        _fill(out[first:end], hashes[bounds[first] : bounds[end]], bounds[first : end + 1] - bounds[first], slots, seed)
        first = end
    return out


def _fill(out: np.ndarray, hashes: np.ndarray, bounds: np.ndarray, slots: int, seed: int) -> None:
    element, owner = hashes, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    flat, order = out.reshape(-1), None
    with np.errstate(over="ignore"):
        for j in range(slots):
            if not len(element):
                return
            draw = mix(element ^ mix(np.array([seed * 1000 + j], np.uint64)))
            pick = j + ((draw >> U64(40)) * U64(slots - j) >> U64(24)).astype(np.int64)
            if order is None:  # round 0: nobody has been swapped yet
                slot = pick
            else:
                rows = np.arange(len(element))
                slot = order[rows, pick].astype(np.int64)
                order[rows, pick] = order[:, j]
            value = (U64(j) << U64(40)) | (draw & U64((1 << 40) - 1))
            np.minimum.at(flat, owner * slots + slot, value)
            stay = (out == _EMPTY).any(axis=1)[owner]
            if order is None:
                element, owner = element[stay], owner[stay]
                order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(element), 1))
                order[np.arange(len(element)), pick[stay]] = 0
            elif not stay.all():
                element, owner, order = element[stay], owner[stay], order[stay]


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """(sets x bands) 64-bit keys; sets share a key where all rows of that band agree."""
    sets, slots = signature.shape
    rows = slots // bands
    with np.errstate(over="ignore"):
        keys = np.tile(mix(np.arange(bands, dtype=np.uint64) + U64(1)), (sets, 1))
        for row in range(rows):
            keys = mix(keys * U64(0x9E3779B97F4A7C15) + signature[:, row : rows * bands : rows])
    return keys
