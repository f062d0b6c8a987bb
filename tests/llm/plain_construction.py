"""The plain column-wise construction over whole texts, with external files: what op9's results are held against, and what its cost is measured by.

Every round inserts one more symbol of each text, from the last to the first: the suffixes
known so far are read in order with the symbol before each, dealt stably into one file a
symbol, and the files in symbol order are the next round's order. Common prefixes follow:
between two neighbours of a file it is one more than the least between their sources.
"""

from __future__ import annotations

import os

import numpy as np


class Files:
    """Sequential files in a folder, with a count of the bytes that pass."""

    def __init__(self, folder: str):
        self.folder, self.traffic = folder, 0

    def put(self, name: str, values: np.ndarray) -> None:
        values.tofile(os.path.join(self.folder, name))
        self.traffic += values.nbytes

    def get(self, name: str, kind) -> np.ndarray:
        values = np.fromfile(os.path.join(self.folder, name), kind)
        self.traffic += values.nbytes
        return values


def construct(texts: list[bytes], folder: str, cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(text, start, common prefix with the suffix before, bytes of file traffic) of all suffixes in order; prefixes count up to ``cap``."""
    files, n = Files(folder), len(texts)
    longest = max((len(t) for t in texts), default=0)
    files.put("owner", np.arange(n, dtype=np.int32))
    files.put("start", np.array([len(t) for t in texts], dtype=np.int32))
    files.put("common", np.zeros(n, dtype=np.uint16))
    padded = np.zeros((n, longest), dtype=np.uint8)
    for k, t in enumerate(texts):
        padded[k, : len(t)] = np.frombuffer(t, np.uint8)
    for _ in range(longest):
        owner, start, common = files.get("owner", np.int32), files.get("start", np.int32), files.get("common", np.uint16)
        inner = start > 0
        symbol = np.where(inner, padded[owner, np.maximum(start - 1, 0)].astype(np.int16), -1)
        ends = np.flatnonzero(start == np.array([len(t) for t in texts], dtype=np.int32)[owner])
        parts = [(owner[ends], start[ends], np.zeros(len(ends), np.uint16))]  # the empty suffixes stay in front
        for s in np.unique(symbol[inner]):
            at = np.flatnonzero(symbol == s)
            least = np.zeros(len(at), np.int64)
            if len(at) > 1:
                least[1:] = np.minimum.reduceat(common, np.append(at[:-1] + 1, at[-1] + 1)[: len(at)] if at[-1] + 1 < len(common) else at[:-1] + 1)[: len(at) - 1]
                least[1:] = np.minimum(least[1:] + 1, cap)
            parts.append((owner[at], start[at] - 1, least.astype(np.uint16)))
        for name, column in zip(("owner", "start", "common"), zip(*parts)):
            files.put(name, np.concatenate(column))
    return files.get("owner", np.int32), files.get("start", np.int32), files.get("common", np.uint16), files.traffic


def repeated_starts(texts: list[bytes], folder: str, span: int) -> tuple[list[np.ndarray], int]:
    """Per text which starts hold ``span`` bytes that also start elsewhere, and the file traffic."""
    owner, start, common, traffic = construct(texts, folder, span)
    again = common >= span
    hit = again.copy()
    hit[:-1] |= again[1:]
    found = [np.zeros(max(0, len(t) - span + 1), bool) for t in texts]
    for o, s in zip(owner[hit].tolist(), start[hit].tolist()):
        found[o][s] = True
    return found, traffic
