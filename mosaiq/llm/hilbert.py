"""Hilbert curve keys of points in a few dimensions, for whole arrays at once."""

from __future__ import annotations

import numpy as np


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of integer points (rows) with coordinates in [0, 2**bits); dims * bits <= 62.

    Works from the highest bit plane down: the bits of a plane, seen in the frame of the cube they lie in, give the
    digit of the curve by Gray decoding, and turn and mirror the frame for the next plane.
    """
    rows, dims = cells.shape
    cells = cells.astype(np.int64)
    full = (1 << dims) - 1
    entry = np.zeros(rows, np.int64)  # corner by which the curve enters the cube
    turn = np.zeros(rows, np.int64)  # axis along which it leaves
    key = np.zeros(rows, np.int64)
    for plane in range(bits - 1, -1, -1):
        corner = np.zeros(rows, np.int64)
        for axis in range(dims):
            corner |= ((cells[:, axis] >> plane) & 1) << axis
        corner ^= entry
        shift = (turn + 1) % dims
        corner = ((corner >> shift) | (corner << (dims - shift))) & full
        digit = corner.copy()
        step = 1
        while step < dims:
            digit ^= digit >> step
            step <<= 1
        key = (key << dims) | digit
        # entry corner and direction of the digit's cube, in the frame of this one
        back = np.where(digit > 0, 2 * ((digit - 1) // 2), 0)
        sub_entry = back ^ (back >> 1)
        odd = np.where(digit % 2 == 0, digit - 1, digit)
        sub_turn = np.zeros(rows, np.int64)
        run = odd.copy()
        for _ in range(dims):  # trailing ones
            more = (run & 1) == 1
            sub_turn = np.where(more, sub_turn + 1, sub_turn)
            run = np.where(more, run >> 1, 0)
        sub_turn = np.where(digit == 0, 0, sub_turn) % dims
        entry ^= ((sub_entry << shift) | (sub_entry >> (dims - shift))) & full
        turn = (turn + sub_turn + 1) % dims
    return key
