"""The 64-bit Jenkins hash of equal-length keys, vectorised; 36 of its bits are used."""

from __future__ import annotations

import numpy as np

# The seeds of a filter's hash functions, in order.
SEEDS = (
    152501029, 152501717, 152503097, 152500171, 152500157, 152504837, 10161313, 10371313, 10431313, 10501313,
    10581313, 10611313, 10641313, 10651313, 10671313, 10731313, 10821313, 10881313, 10951313, 11001313,
)
# The shifts of the mixing step (right, left, right, four times over) and the golden ratio.
SHIFTS = (43, 9, 8, 38, 23, 5, 35, 49, 11, 12, 18, 22)
GOLDEN = 0x9E3779B97F4A7C13
MASK = (1 << 36) - 1


def _mix(state: list[np.ndarray]) -> None:
    """Each word in turn loses the other two and takes a shifted copy of the one before it."""
    for i, shift in enumerate(SHIFTS):
        x, y, z = i % 3, (i + 1) % 3, (i + 2) % 3
        shifted = state[z] << np.uint64(shift) if i % 3 == 1 else state[z] >> np.uint64(shift)
        state[x] = (state[x] - state[y] - state[z]) ^ shifted


def hash64(keys: np.ndarray, seed: int) -> np.ndarray:
    """keys: uint8 matrix, one key a row."""
    n, length = keys.shape
    state = [np.full(n, seed, np.uint64), np.full(n, seed, np.uint64), np.full(n, GOLDEN, np.uint64)]
    whole = length // 24 * 24
    padded = np.zeros((n, whole + 24), np.uint8)
    padded[:, :whole] = keys[:, :whole]
    tail = keys[:, whole:]
    padded[:, whole : whole + min(16, tail.shape[1])] = tail[:, :16]
    # in the last block the lowest byte of the third word is the length's place
    padded[:, whole + 17 : whole + 17 + max(0, tail.shape[1] - 16)] = tail[:, 16:]
    words = np.ascontiguousarray(padded).view("<u8")
    for b in range(words.shape[1] // 3):
        for j in range(3):
            state[j] = state[j] + words[:, 3 * b + j]
        if b == words.shape[1] // 3 - 1:
            state[2] = state[2] + np.uint64(length)
        _mix(state)
    return state[2]


def hash36(keys: np.ndarray, seed: int) -> np.ndarray:
    return hash64(keys, seed) & np.uint64(MASK)
