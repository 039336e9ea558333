"""Nearest partners of many moments at once: Arrow batches in time order, numpy inside.

A partner is one number: seconds apart (11 bits), number of the finding (36), term (6), kind (10), so the order of numbers
is the order of partners. Without the seconds and the term it is an ``element`` of a second's list.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KIND_BITS, TERM_BITS, NUMBER_BITS, APART_BITS = 10, 6, 36, 11
NUMBER_SHIFT = KIND_BITS + TERM_BITS
APART_SHIFT = NUMBER_SHIFT + NUMBER_BITS
NONE = np.int64(2**63 - 1)
ROWS_AT_ONCE = 32_768


def _numbers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64) if isinstance(column, pa.Array) else column.to_numpy().astype(np.int64)


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values, pa.int64()))


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of each element of a column of lists."""
    lengths = _numbers(pc.list_value_length(column))
    return np.repeat(np.arange(len(lengths)), lengths), _numbers(pc.list_flatten(column))


def _starts(table: pa.Table, names: list[str]) -> np.ndarray:
    """Whether a row differs from the one before it in one of the columns."""
    new = np.ones(table.num_rows, bool)
    if table.num_rows > 1:
        new[1:] = False
        for name in names:
            column = table.column(name).combine_chunks()
            new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return new


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], reduce: Callable[[pa.Table], pa.Table] | None = None) -> Iterator[pa.Table]:
    """Tables of whole groups; the last group of a batch waits for the next, through ``reduce`` if it may be long."""
    waiting: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        waiting.append(batch)
        rows += batch.num_rows
        if rows < ROWS_AT_ONCE:
            continue
        table = pa.Table.from_batches(waiting)
        cut = int(np.flatnonzero(_starts(table, keys))[-1])
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
        waiting = (reduce(rest).cast(rest.schema) if reduce else rest.combine_chunks()).to_batches()
        rows = min(sum(b.num_rows for b in waiting), ROWS_AT_ONCE // 2)  # a long group grows by some batches before it is looked at again
    if waiting:
        table = pa.Table.from_batches(waiting)
        if table.num_rows:
            yield table


def partners_in_chunks(home: list[str], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The nearest partners of each second that asks.

    Rows ``*home, window, _code, origin, at, is_http, asks, elements`` come sorted by ``home, at, is_http``, one row per second and side.
    Out come ``*keys, at, is_http, partners`` (``keys``: ``home`` without its last column, the chunk): of the ``k + 1``
    partners before and the ``k + 1`` from the second on all that lie within the window, each finding once.
    """
    keys = home[:-1]

    def near(table: pa.Table) -> pa.RecordBatch | None:
        at, window, term = (_numbers(table.column(n)) for n in ("at", "window", "_code"))
        http, origin, asks = (table.column(n).to_numpy().astype(bool) for n in ("is_http", "origin", "asks"))
        fresh = _starts(table, home)
        group = np.cumsum(fresh)
        second = np.cumsum(fresh | np.concatenate([[True], at[1:] != at[:-1]]))
        row, element = _flat(table.column("elements"))
        asking, partners = [], []
        for who, whom in ((asks & http & ~origin, ~http), (asks & http & origin, np.ones(len(http), bool)), (asks & ~http, http)):
            rows, known = np.flatnonzero(who), np.flatnonzero(whom[row])
            if not len(rows) or not len(known):
                continue
            r, e = row[known], element[known]
            place = np.searchsorted(second[r], second[rows])[:, None]
            steps = np.arange(k + 1)[None, :]
            found = []
            for order, places in ((np.lexsort((e, second[r])), place + steps), (np.lexsort((-e, second[r])), place - 1 - steps)):
                chosen = order[np.clip(places, 0, len(order) - 1)]
                there = r[chosen]
                apart = np.abs(at[there] - at[rows][:, None])
                met = (places >= 0) & (places < len(order)) & (group[there] == group[rows][:, None]) & (apart <= window[rows][:, None])
                number, kind = e[chosen] >> KIND_BITS, e[chosen] & ((1 << KIND_BITS) - 1)
                packed = (np.where(met, apart, 0) << APART_SHIFT) | (number << NUMBER_SHIFT) | (term[rows][:, None] << KIND_BITS) | kind
                found.append(np.where(met, packed, NONE))
            asking.append(rows)
            partners.append(np.sort(np.concatenate(found, axis=1), axis=1))
        if not asking:
            return None
        rows, packed = np.concatenate(asking), np.concatenate(partners)
        use = packed != NONE
        use[:, 1:] &= packed[:, 1:] != packed[:, :-1]
        some = use.any(axis=1)
        taken = table.take(pa.array(rows[some])).select([*keys, "at", "is_http"])
        lists = _lists(packed[some][use[some]], use[some].sum(axis=1))
        return taken.append_column("partners", lists).combine_chunks().to_batches()[0] if some.any() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, home):
            done = near(table)
            if done is not None:
                yield done

    return run


def nearest_of_lists(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``number, partners`` sorted by ``number`` made one row per number: its ``k`` nearest partners other than itself, each once."""

    def best(table: pa.Table) -> pa.Table:
        numbers = _numbers(table.column("number"))
        row, packed = _flat(table.column("partners"))
        own, partner = numbers[row], (packed >> NUMBER_SHIFT) & ((1 << NUMBER_BITS) - 1)
        other = own != partner
        own, partner, packed = own[other], partner[other], packed[other]
        order = np.lexsort((packed, partner, own))
        own, partner, packed = own[order], partner[order], packed[order]
        once = np.ones(len(own), bool)
        once[1:] = (own[1:] != own[:-1]) | (partner[1:] != partner[:-1])
        own, packed = own[once], packed[once]
        order = np.lexsort((packed, own))
        own, packed = own[order], packed[order]
        ids, first, counts = np.unique(own, return_index=True, return_counts=True)
        keep = np.arange(len(own)) - np.repeat(first, counts) < k
        return pa.table({"number": pa.array(ids, pa.int64()), "partners": _lists(packed[keep], np.minimum(counts, k))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, ["number"], best):
            yield from best(table).combine_chunks().to_batches()

    return run
