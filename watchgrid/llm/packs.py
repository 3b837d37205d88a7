"""Rows as packed columns, for shuffles of many small values.

A row of the shuffle is a part of the key space with its columns one after another, so a value costs its own
bytes and no more. Map tasks combine first: of a key that a task holds more than once, one row meets its
like in the key's part; that the others are shared is known, and they go to any part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from watchgrid.llm.words import U, mix

PACK = pa.schema([("part", pa.int32()), ("pack", pa.binary())])


def _planes(column: np.ndarray) -> bytes:
    """A column's bytes, all first ones, then all second ones and so on: high bytes of small or sorted numbers compress to little."""
    return np.ascontiguousarray(column).view(np.uint8).reshape(len(column), column.dtype.itemsize).T.tobytes()


def packed(columns: list[np.ndarray], part: np.ndarray):
    """One row for each part, with its columns one after another, by planes of bytes."""
    order = np.argsort(part, kind="stable")
    columns, part = [c[order] for c in columns], part[order]
    heads = np.flatnonzero(np.diff(part, prepend=-1))
    ends = np.append(heads[1:], len(part))
    packs = [b"".join(_planes(c[x:y]) for c in columns) for x, y in zip(heads, ends)]
    return pa.record_batch([pa.array(part[heads].astype(np.int32)), pa.array(packs, pa.binary())], schema=PACK)


def unpacked(packs: list[bytes], kinds: list, planes: bool = False) -> list[np.ndarray]:
    """The columns of packs; ``planes``: as ``packed`` writes them, else each column as it is."""
    size = sum(np.dtype(k).itemsize for k in kinds)
    columns = [[] for _ in kinds]
    for pack in packs:
        n, at = len(pack) // size, 0
        for column, kind in zip(columns, kinds):
            wide = np.dtype(kind).itemsize
            if planes and wide > 1:
                column.append(np.ascontiguousarray(np.frombuffer(pack, np.uint8, n * wide, at).reshape(wide, n).T).view(kind).ravel())
            else:
                column.append(np.frombuffer(pack, kind, n, at))
            at += n * wide
    return [np.concatenate(c) if c else np.empty(0, k) for c, k in zip(columns, kinds)]


def by_part(batches, kinds):
    """The rows of each part; a partition holds whole parts, in order."""
    part, packs = None, []
    for batch in batches:
        for p, pack in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if p != part and packs:
                yield unpacked(packs, kinds, True)
                packs = []
            part = p
            packs.append(pack)
    if packs:
        yield unpacked(packs, kinds, True)


def shared_packs(key: np.ndarray, columns: list[np.ndarray], n_parts: int) -> pa.RecordBatch:
    """Packs of a task's rows, by 48 bits of their key. Kind 0: single here, 1: stands for a key known to be shared, 2: another of such.

    Rows of a part go by their columns, the first one (a document) first, which compresses well.
    """
    key = key >> U(16)
    order = np.argsort(key, kind="stable")
    key, columns = key[order], [c[order] for c in columns]
    new = np.append(True, key[1:] != key[:-1])
    size = np.diff(np.append(np.flatnonzero(new), len(key)))
    kind = np.where(new, np.repeat(size > 1, size).astype(np.int8), np.int8(2))
    any_part = mix(mix(key) + np.arange(len(key), dtype=np.uint64))
    part = (np.where(kind == 2, any_part, mix(key)) % U(n_parts)).astype(np.int32)
    order = np.lexsort((*columns[::-1], part))
    key = key[order]
    return packed([(key >> U(16)).astype(np.uint32), key.astype(np.uint16), *[c[order] for c in columns], kind[order]], part[order])


def shared_rows(batches, kinds: list):
    """The columns of shared_packs, of rows whose key occurs more than once, part by part."""
    for high, low, *columns, kind in by_part(batches, [np.uint32, np.uint16, *kinds, np.int8]):
        known = kind == 2
        key = (high.astype(np.uint64) << U(16) | low)[~known]
        order = np.argsort(key, kind="stable")
        key, meet, kind = key[order], [c[~known][order] for c in columns], kind[~known][order]
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        size = np.diff(np.append(heads, len(key)))
        many = np.repeat((size > 1) | (np.maximum.reduceat(kind, heads) > 0), size) if len(heads) else np.empty(0, bool)
        yield [np.concatenate([c[known], m[many]]) for c, m in zip(columns, meet)]
