"""Pairs of a join as a set, for one tile of it: what a task does with the rows of two blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Joined rows that are compared at once.
AT_ONCE = 4 << 20
#: Bytes that a tile's lists may take as bits, and words of them that are read at once.
BITS = 64 << 20
BITS_AT_ONCE = 1 << 18


def _codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each value, and the values by number."""
    if not pa.types.is_struct(values.type):
        d = values.dictionary_encode()
        return d.indices.to_numpy(zero_copy_only=False).astype("int64"), d.dictionary
    code = np.zeros(len(values), "int64")
    for f in values.flatten():
        d = f.dictionary_encode()
        code = np.unique(code * max(1, len(d.dictionary)) + d.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return code, values.take(pa.array(first))


def _lists(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of all lists' values, where each list begins and the last ends, and the values."""
    column = pa.concat_arrays(table[name].chunks)
    code, values = _codes(column.flatten())
    length = column.value_lengths().to_numpy(zero_copy_only=False)
    return code, np.concatenate([[0], np.cumsum(length)]).astype("int64"), values


def _sparse(a: np.ndarray, row: np.ndarray, b: np.ndarray, b_at: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Keys a * n + b of a tile's pairs, ascending, some at once: from its joined rows."""
    joined = np.concatenate([[0], np.cumsum(np.diff(b_at)[row])])
    ends = np.flatnonzero(np.diff(a, append=-1)) + 1  # a's edges end here
    at = 0
    while at < len(a):
        end = ends[max(np.searchsorted(joined[ends], joined[at] + AT_ONCE, "right") - 1, np.searchsorted(ends, at, "right"))]
        cells = (a[end - 1] - a[at] + 1) * n
        dense = cells <= 16 * max(1, joined[end] - joined[at]) or a[end - 1] == a[at]
        flags, keys = np.zeros(cells if dense else 0, bool), []
        lo = at
        while lo < end:  # one value may have more rows than are compared at once
            hi = min(end, max(lo + 1, np.searchsorted(joined, joined[lo] + AT_ONCE, "right") - 1))
            size = b_at[row[lo:hi] + 1] - b_at[row[lo:hi]]
            start = np.concatenate([[0], np.cumsum(size)[:-1]])
            take = np.repeat(b_at[row[lo:hi]] - start, size) + np.arange(size.sum())
            key = np.repeat((a[lo:hi] - a[at]) * n, size) + b[take]
            if dense:
                flags[key] = True
            else:
                keys.append(key)
            lo = hi
        if dense:
            key = np.flatnonzero(flags)
        else:  # sorted: numpy's unique hashes whole numbers, which takes several times as long
            key = np.sort(np.concatenate(keys))
            key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        yield key + a[at] * n
        at = end


def _dense(a: np.ndarray, row: np.ndarray, b: np.ndarray, b_at: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The same from a row of bits for each list of b's: an a's pairs are those of its rows taken together."""
    bits = np.zeros((len(b_at) - 1, -(-n // 64) * 8), "uint8")
    some = max(1, AT_ONCE // (8 * bits.shape[1]))
    for lo in range(0, len(bits), some):
        size = np.diff(b_at[lo : lo + some + 1])
        flags = np.zeros((len(size), 8 * bits.shape[1]), bool)
        flags[np.repeat(np.arange(len(size)), size), b[b_at[lo] : b_at[lo] + size.sum()]] = True
        bits[lo : lo + some] = np.packbits(flags, axis=1, bitorder="little")
    bits = bits.view("uint64")
    ends = np.flatnonzero(np.diff(a, append=-1)) + 1
    step = max(1, BITS_AT_ONCE // bits.shape[1])
    keys, waiting = [], 0
    for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        whole = np.bitwise_or.reduce(bits[row[lo : min(hi, lo + step)]], axis=0)
        for i in range(lo + step, hi, step):
            whole |= np.bitwise_or.reduce(bits[row[i : min(hi, i + step)]], axis=0)
        keys.append(np.flatnonzero(np.unpackbits(whole.view("uint8"), bitorder="little")) + a[lo] * n)
        waiting += len(keys[-1])
        if waiting > AT_ONCE // 8:
            yield np.concatenate(keys)
            keys, waiting = [], 0
    if keys:
        yield np.concatenate(keys)


def _without(key: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Ascending keys, but for those in `gone`, which ascend too."""
    if not len(gone):
        return key
    return key[gone[np.minimum(np.searchsorted(gone, key), len(gone) - 1)] != key]


def pairs(names: list[str], wide: tuple[bool, bool]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows with lists `as` and `bs`, all different pairs of an a and a b of one row, but for those of rows with `less`, which have one a; `wide` sides are structs of columns."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = [b for b in batches if b.num_rows]
        if not given:
            return
        table = pa.Table.from_batches(given)
        a, a_at, a_values = _lists(table, "as")
        b, b_at, b_values = _lists(table, "bs")
        less = table["less"].to_numpy() if "less" in table.column_names else np.zeros(len(a_at) - 1, bool)
        n = len(b_values)
        row = np.repeat(np.arange(len(a_at) - 1), np.diff(a_at))
        taken = np.repeat(less, np.diff(b_at))
        gone = np.sort((np.repeat(a[a_at[:-1]], np.diff(b_at)) * n + b)[taken])
        a, row = a[~less[row]], row[~less[row]]
        if not len(a):
            return
        order = np.argsort(a, kind="stable")
        a, row = a[order], row[order]
        # lists that are joined come first, so the others need no bits
        new = np.cumsum(~less) - 1
        row, b = new[row], b[~taken]
        b_at = np.concatenate([[0], np.cumsum(np.diff(b_at)[~less])]).astype("int64")
        words, joined = -(-n // 64), np.diff(b_at)[row].sum()
        dense = (len(b_at) - 1) * words * 8 <= BITS and len(row) * words <= 4 * joined and joined >= 256 * len(np.unique(a))
        for key in (_dense if dense else _sparse)(a, row, b, b_at, n):
            key = _without(key, gone)
            for i in range(0, len(key), 1 << 17):
                part = key[i : i + (1 << 17)]
                out = [a_values.take(pa.array(part // n)), b_values.take(pa.array(part % n))]
                yield pa.RecordBatch.from_arrays([c for v, w in zip(out, wide, strict=True) for c in (v.flatten() if w else [v])], names=names)

    return found
