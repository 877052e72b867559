"""Ordered folds over small state: compaction choice, ready groups, index rebuilds. Each streams or holds one key's state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: An index is rebuilt on demand or when so many versions behind; a delta is merged at a size between these.
STALE_VERSIONS, MERGE_LEAST, MERGE_MOST = 1024, 1024, 200_000
#: Fixed value: how much larger than the smallest tile a tile of its group may be.
GROUP_RATIO = 2


def grown_run(sizes: list[int], budget: int, most: int, ratio: int | None = None) -> tuple[int, int] | None:
    """(start, length) of the run that grows from the smallest tile (ties: the oldest) by its smaller neighbour (ties: the older).

    A neighbour joins while the total stays within the budget, the run within `most` tiles, and, with a
    ratio, its size within that multiple of the smallest. None if no neighbour joins.
    """
    at = min(range(len(sizes)), key=lambda i: (sizes[i], i), default=None)
    if at is None:
        return None
    first, last, total = at, at, sizes[at]
    while last - first + 1 < most:
        near = [i for i in (first - 1, last + 1) if 0 <= i < len(sizes) and total + sizes[i] <= budget and (ratio is None or sizes[i] <= ratio * sizes[at])]
        if not near:
            break
        take = min(near, key=lambda i: (sizes[i], i))
        total += sizes[take]
        first, last = min(first, take), max(last, take)
    return (first, last - first + 1) if last > first else None


def cheapest_pair(sizes: list[int], budget: int) -> tuple[int, int]:
    """The adjacent pair of the least size, one within the budget first (a longer run is never cheaper); ties: the oldest."""
    at = min(range(len(sizes) - 1), key=lambda i: (sizes[i] + sizes[i + 1] > budget, sizes[i] + sizes[i + 1], i))
    return at, 2


def chosen_run(sizes: list[int], budget: int, most: int, policy: str) -> tuple[int, int]:
    """policy: cheapest_pair, ratio_group or budget_prefix; the groups fall back to the cheapest pair."""
    grown = None if policy == "cheapest_pair" else grown_run(sizes, budget, most, GROUP_RATIO if policy == "ratio_group" else None)
    return grown or cheapest_pair(sizes, budget)


def compaction_choice(tiles: DataFrame, budget: int, most: int) -> DataFrame:
    """region, policy, start, length, total: what each policy would merge. tiles: region, idx, size. A region's tiles are file metadata."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        sizes, out = [int(x) for x in pdf["size"]], []
        for policy in ("cheapest_pair", "ratio_group", "budget_prefix") if len(sizes) > 1 else ():
            start, n = chosen_run(sizes, budget, most, policy)
            out.append((pdf["region"].iloc[0], policy, int(pdf["idx"].iloc[start]), n, sum(sizes[start : start + n])))
        return pd.DataFrame(out, columns=["region", "policy", "start", "length", "total"])

    return tiles.groupBy("region").applyInPandas(choose, "region string, policy string, start long, length long, total long")


def simulate_compaction(tiles: DataFrame, most: int, budget: int, policy: str = "budget_prefix") -> DataFrame:
    """region, merges, payload, bytes_written, left: each region's arrivals in order, written once; beyond `most` tiles runs merge.

    A merge writes its total again and stands last of the tiles, as the newest. The state is `most` sizes.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        active, merges, written = [], 0, 0
        for size in pdf.sort_values("idx")["size"]:
            active.append(int(size))
            written += int(size)
            while len(active) > max(1, most):
                start, n = chosen_run(active, budget, most, policy)
                total = sum(active[start : start + n])
                active[start : start + n] = []
                active.append(total)
                merges += 1
                written += total
        payload = int(pdf["size"].sum())
        return pd.DataFrame({"region": [pdf["region"].iloc[0]], "merges": [merges], "payload": [payload], "bytes_written": [written], "left": [len(active)]})

    return tiles.groupBy("region").applyInPandas(run, "region string, merges long, payload long, bytes_written long, left long")


def streamed(df: DataFrame, keys: list[str], order: list[str], schema: str, start: Callable, step: Callable) -> DataFrame:
    """One row of `schema` for each row of `df`: per key, in order, step(state, row) -> (state, values). Sorted partitions are streamed."""
    names = [f.split()[0] for f in schema.split(", ")]

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf in parts:
            out = []
            for row in pdf.itertuples(index=False):
                own = tuple(getattr(row, k) for k in keys)
                if own != key:
                    key, state = own, start()
                state, values = step(state, row)
                out.append(values)
            yield pd.DataFrame(out, columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(fold, schema)


def ready_groups(requests: DataFrame, keys: list[str], size: int, service_us: int) -> DataFrame:
    """keys, seq, due_us, group, issued_us: groups of requests that are due when their server becomes free.

    requests: keys, seq, due_us, rate. A group holds `size` requests at most, of one offered rate, none of
    which is due later than the group is issued; it is issued as soon as one request is due, and the
    server is busy for `service_us` then.
    """
    types = dict(requests.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "seq long", "due_us double", "group long", "issued_us double"])

    def step(state, r):
        group, n, issued, rate, free = state
        if group < 0 or n == size or r.rate != rate or r.due_us > issued:
            group, n, issued, rate = group + 1, 0, max(free, r.due_us), r.rate
            free = issued + service_us
        return (group, n + 1, issued, rate, free), (*(getattr(r, k) for k in keys), r.seq, r.due_us, group, issued)

    return streamed(requests, keys, ["seq"], schema, lambda: (-1, 0, 0.0, None, 0.0), step)


def index_upkeep(windows: DataFrame) -> DataFrame:
    """region, window, rebuilt, merged, base: what an incremental index does in each window.

    windows: region, window, csn (the newest version), scans, changes. It is brought up to date if the window
    scans it or it is STALE_VERSIONS behind; its delta is merged into the base once it has as many entries as
    the base, but MERGE_LEAST at least and MERGE_MOST at most.
    """

    def step(state, r):
        at, base, delta = state
        delta += int(r.changes)
        rebuilt = bool(r.scans > 0 or r.csn - at >= STALE_VERSIONS)
        merged = rebuilt and delta >= min(max(MERGE_LEAST, base), MERGE_MOST)
        if merged:
            base, delta = base + delta, 0
        return (int(r.csn) if rebuilt else at, base, delta), (r.region, r.window, rebuilt, merged, base)

    return streamed(windows, ["region"], ["window"], "region string, window long, rebuilt boolean, merged boolean, base long", lambda: (0, 0, 0), step)
