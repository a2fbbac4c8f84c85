"""Places of word pairs, worked out for the many clauses of an Arrow batch at once.

The functions travel with the job, so executors need no copy of this package.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column

from reviewlens import fixed_values as fixed
from reviewlens.functions.small_parts import in_parts

BASE, DEPENDENT, HEAD, CROSS = range(4)
PLACE = "struct<word:int,kind:tinyint,first:int,second:int>"
#: Words looked at in one go, whole clauses of them, so that the memory of a worker is bounded.
WORDS_AT_ONCE = 1_000_000
#: Bytes of ids, parents and relations that are answered in one go.
BYTES_AT_ONCE = 4_000_000

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(fixed)


def codes(*columns: pa.Array) -> list[np.ndarray]:
    """The columns as numbers: equal ones for equal values, -1 for null."""
    found = pa.concat_arrays(columns).dictionary_encode().indices.fill_null(-1)
    ends = np.cumsum([len(x) for x in columns])[:-1]
    return np.split(found.to_numpy(zero_copy_only=False).astype(np.int64), ends)


def runs_of(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``begin, begin + 1, ...`` of each size, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + size, size)


def places(lengths: np.ndarray, ids: pa.Array, parents: pa.Array, relates: pa.Array) -> tuple[np.ndarray, list]:
    """Pairs of clauses of these ``lengths``, whose words are given one after the other: the number
    of pairs of each clause, and for each pair the word that makes it, its kind and the places of
    its first and second word.

    A word pairs with its head, with words coordinated to either in the order of the clause, and
    the last two of those with each other. A pair that lacks a side is left out.
    """
    clause = np.repeat(np.arange(len(lengths)), lengths)
    start = np.repeat(np.cumsum(lengths) - lengths, lengths)
    id_code, parent_code = codes(ids, parents)
    most = max(id_code.max(initial=0), parent_code.max(initial=0)) + 1
    own, above = (np.where(x < 0, -1, clause * most + x) for x in (id_code, parent_code))

    def among(names: list[str]) -> np.ndarray:
        return pc.is_in(relates, pa.array(names, relates.type)).to_numpy(zero_copy_only=False)

    word = np.flatnonzero(among(fixed.PAIR_RELATIONS))
    by_id = np.argsort(own, kind="stable")
    sorted_ids = own[by_id]
    at = np.minimum(np.searchsorted(sorted_ids, above[word]), max(len(own) - 1, 0))
    has_head = (above[word] >= 0) & (sorted_ids[at] == above[word])
    head = by_id[at]

    coordinated = np.flatnonzero(among([fixed.COORDINATION]) & (above >= 0))
    coordinated = coordinated[np.argsort(above[coordinated], kind="stable")]
    parent_of = above[coordinated]
    low_w, high_w = (np.searchsorted(parent_of, own[word], side) for side in ("left", "right"))
    low_h, high_h = (np.searchsorted(parent_of, above[word], side) for side in ("left", "right"))

    every = np.arange(len(word))
    n_w, n_h = high_w - low_w, high_h - low_h
    n_dependents = np.where(has_head, n_w, 0)
    base = every[has_head]
    of_w, beside_w = np.repeat(every, n_dependents), coordinated[runs_of(low_w, n_dependents)]
    of_h, beside_h = np.repeat(every, n_h), coordinated[runs_of(low_h, n_h)]
    cross = every[(n_w > 0) & (n_h > 0)]

    of = np.concatenate([base, of_w, of_h, cross])
    kind = np.repeat(np.array([BASE, DEPENDENT, HEAD, CROSS], np.int8), [len(base), len(of_w), len(of_h), len(cross)])
    dependent = np.concatenate([word[base], beside_w, word[of_h], coordinated[high_w[cross] - 1]])
    governor = np.concatenate([head[base], head[of_w], beside_h, coordinated[high_h[cross] - 1]])
    if len(of_w) or len(of_h):
        step = np.select([kind == BASE, kind == CROSS], [0, 2], 1)
        beside = np.select([kind == DEPENDENT, kind == HEAD], [dependent, governor], 0)
        order = np.argsort(((of * 3 + step) * len(clause) + beside) * 2 + (kind == HEAD), kind="stable")
        of, kind, dependent, governor = (x[order] for x in (of, kind, dependent, governor))
    made_by = word[of]
    dependent_first = among(fixed.DEPENDENT_FIRST)[made_by]
    offset = start[made_by]
    sides = [
        np.where(dependent_first, dependent, governor) - offset,
        np.where(dependent_first, governor, dependent) - offset,
    ]
    return np.bincount(clause[made_by], minlength=len(lengths)), [made_by - offset, kind, *sides]


def offsets_of(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())


def list_sizes(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def place_lists(ids: pa.Array, parents: pa.Array, relates: pa.Array) -> pa.Array:
    """The pairs of each clause, null for a clause that is null."""
    lengths = list_sizes(ids)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    flat = [x.flatten() for x in (ids, parents, relates)]
    sizes, found = [], []
    low = 0
    while low < len(lengths):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + WORDS_AT_ONCE, "right")) - 1)
        n_words = int(ends[high] - ends[low])
        if n_words:
            n, columns = places(lengths[low:high], *[x.slice(int(ends[low]), n_words) for x in flat])
            found.append(columns)
        sizes.append(n if n_words else np.zeros(high - low, np.int64))
        low = high
    kinds = [pa.int32(), pa.int8(), pa.int32(), pa.int32()]
    columns = [np.concatenate(x) for x in zip(*found)] if found else [[]] * 4
    pairs = pa.StructArray.from_arrays(
        [pa.array(x, kind) for x, kind in zip(columns, kinds)], ["word", "kind", "first", "second"]
    )
    offsets = offsets_of(np.concatenate(sizes) if sizes else np.zeros(0, np.int64))
    return pa.ListArray.from_arrays(offsets, pairs, mask=ids.is_null())


def nested_place_lists(ids: pa.Array, parents: pa.Array, relates: pa.Array) -> pa.Array:
    """The pairs of each clause of each comment."""
    inner = place_lists(*[x.flatten() for x in (ids, parents, relates)])
    return pa.ListArray.from_arrays(offsets_of(list_sizes(ids)), inner, mask=ids.is_null())


def clause_places(ids: Column, parents: Column, relates: Column) -> Column:
    """The pairs of a clause, given the ids, parents and relations of its words."""
    return in_parts(place_lists, f"array<{PLACE}>", BYTES_AT_ONCE, ids, parents, relates)


def comment_places(ids: Column, parents: Column, relates: Column) -> Column:
    """The pairs of each clause of a comment."""
    return in_parts(nested_place_lists, f"array<array<{PLACE}>>", BYTES_AT_ONCE, ids, parents, relates)
