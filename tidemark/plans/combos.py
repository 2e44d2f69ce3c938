"""Combinations of datasets and columns, and the names of results: plain lists, made on the driver."""

from __future__ import annotations

import itertools
from collections.abc import Iterable


def n_combinations(items: Iterable, n: int, must_include=None, permutations: bool = False) -> list[tuple]:
    """Combinations (or permutations) of n items; with must_include, an item or a list, those that have any of them."""
    found = (itertools.permutations if permutations else itertools.combinations)(list(items), n)
    if must_include is None:
        return list(found)
    wanted = set(must_include) if isinstance(must_include, (list, tuple, set)) else {must_include}
    return [c for c in found if wanted & set(c)]


def result_combinations(columns: dict[str, list[str]], n: int = 2) -> list[tuple[tuple[str, str], ...]]:
    """Sorted n-tuples of (dataset, column) from n different datasets, each sorted."""
    cells = sorted((d, c) for d, cs in columns.items() for c in cs)
    return sorted({c for c in itertools.combinations(cells, n) if len({d for d, _ in c}) == n})


def result_names(columns: dict[str, list[str]], reference: str, n: int = 2) -> list[tuple[tuple[str, str], ...]]:
    """result_combinations that have the reference dataset."""
    return [c for c in result_combinations(columns, n) if any(d == reference for d, _ in c)]


def combo_key(combo: Iterable[tuple[str, str]], limit: int = 255) -> str:
    """ds.col_with_ds.col; too long for a file name: the datasets alone; still too long: "validation"."""
    for name in ("_with_".join(f"{d}.{c}" for d, c in combo), "_with_".join(d for d, _ in combo)):
        if len(name) + 3 <= limit:
            return name
    return "validation"


def as_list(x) -> list:
    """A list of x: strings and scalars are one element."""
    if x is None:
        return []
    return [x] if isinstance(x, (str, bytes)) or not hasattr(x, "__iter__") else list(x)


def flatten(nested) -> list:
    return [y for x in nested for y in (flatten(x) if isinstance(x, (list, tuple)) else [x])]
