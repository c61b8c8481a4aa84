"""Sequential rules over one small group each: batches, partitions, schedules, knapsacks."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Replicates that are drawn at once.
BLOCK = 64
#: Rows of a group that are held before those that can't matter are let go.
HELD = 1 << 16
#: Items, as many for each group as the longest has, whose groups are solved together.
IN_STEP = 1 << 13


def token_batches(docs: DataFrame, group: str, order: str, tokens: str, cap: int) -> DataFrame:
    """Row per document of a group in order: batch number; a batch closes before it would pass cap.

    A document over the cap is a batch of its own. Groups are meant to be small (a source's
    shard); each is read by one task.
    """

    def f(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(order, kind="stable")
        batch, used, out = 0, 0, []
        for n in p[tokens]:
            if used and used + n > cap:
                batch, used = batch + 1, 0
            out.append(batch)
            used += n
        return pd.DataFrame({group: p[group], order: p[order], "batch": out})

    return docs.select(group, order, tokens).groupBy(group).applyInPandas(f, f"{group} string, {order} long, batch long")


def balanced_partitions(docs: DataFrame, group: str, order: str, tokens: str, parts: int) -> DataFrame:
    """Row per part of a group: contiguous whole documents whose ends lie nearest to equal shares of tokens."""

    def f(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(order, kind="stable")
        ends = np.concatenate(([0], np.cumsum(p[tokens].to_numpy())))
        cuts = [0]
        for k in range(1, parts):
            aim = ends[-1] * k / parts
            at = int(np.searchsorted(ends, aim))
            at = at - 1 if at and aim - ends[at - 1] <= ends[min(at, len(ends) - 1)] - aim else at
            cuts.append(min(max(at, cuts[-1]), len(p)))
        cuts.append(len(p))
        return pd.DataFrame({group: p[group].iloc[0], "part": range(parts), "first": cuts[:-1], "stop": cuts[1:], "tokens": [int(ends[b] - ends[a]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]})

    return docs.select(group, order, tokens).groupBy(group).applyInPandas(f, f"{group} string, part long, first long, stop long, tokens long")


def longest_first(items: DataFrame, group: str, item: str, cost: str, workers: int) -> DataFrame:
    """Row per item: the worker with the least load takes the costliest item that is left; ties by number."""

    def f(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values([cost, item], ascending=[False, True], kind="stable")
        heap = [(0.0, w) for w in range(workers)]
        out = []
        for c in p[cost]:
            load, w = heapq.heappop(heap)
            out.append(w)
            heapq.heappush(heap, (load + c, w))
        return pd.DataFrame({group: p[group], item: p[item], "worker": out})

    return items.select(group, item, cost).groupBy(group).applyInPandas(f, f"{group} long, {item} long, worker long")


def _may_matter(item: np.ndarray, gain: np.ndarray, cost: np.ndarray, budget: int) -> np.ndarray:
    """Rows in order of item that some best choice may hold: of equal costs only the highest gains that fit, first items first."""
    ok = np.flatnonzero((gain > 0) & (cost >= 0) & (cost <= budget))
    ok = ok[np.lexsort((item[ok], -gain[ok], cost[ok]))]
    c = cost[ok]
    place = np.arange(len(ok)) - np.searchsorted(c, c)
    ok = ok[place < np.where(c > 0, budget // np.maximum(c, 1), len(ok))]
    return ok[np.argsort(item[ok], kind="stable")]


def _best_within(groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]], budget: int) -> list[tuple[int, int, list[int]]]:
    """Gain, cost and items of each group's best choice, in step; gains are positive, costs within the budget, items in order."""
    m, longest = len(groups), max(len(i) for i, _, _ in groups)
    gain, cost = np.full((longest, m, 1), -1, np.int64), np.zeros((longest, m, 1), np.int64)
    for j, (i, g, c) in enumerate(groups):
        gain[longest - len(i) :, j, 0], cost[longest - len(i) :, j, 0] = g, c
    best = np.zeros((m, 2 * budget + 1), np.int64)
    best[:, :budget] = -(1 << 62)  # what would cost more than there is
    flat, within = best.reshape(-1), best[:, budget:]
    at = np.arange(m)[:, None] * best.shape[1] + budget + np.arange(budget + 1)
    place, new, take = np.empty_like(at), np.empty(at.shape, np.int64), np.empty((longest, *at.shape), bool)
    for k in range(longest - 1, -1, -1):
        np.subtract(at, cost[k], out=place)
        np.take(flat, place, out=new, mode="clip")
        np.add(new, gain[k], out=new)
        np.greater_equal(new, within, out=take[k])
        np.maximum(within, new, out=within)
    left, every, chosen = np.full(m, budget), np.arange(m), np.empty((longest, m), bool)
    for k in range(longest):
        chosen[k] = take[k, every, left]
        left -= np.where(chosen[k], cost[k, :, 0], 0)
    return [(int(within[j, budget]), int(budget - left[j]), i[chosen[longest - len(i) :, j]].tolist()) for j, (i, _, _) in enumerate(groups)]


def knapsack(items: DataFrame, group: str, item: str, gain: str, cost: str, budget: int, held: int = HELD) -> DataFrame:
    """Row per group: the best gain within a whole-number budget, its cost and items (first items win ties).

    A group's rows come to one task in order, a batch at a time; of those read it holds only the ones that may
    matter, at most budget // cost of a cost, so about budget x ln(budget) and those that cost nothing.
    """

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut(parts: list[np.ndarray]) -> np.ndarray:
            rows = np.concatenate(parts, axis=1)
            return rows[:, _may_matter(*rows, budget)]

        def solved(groups: list[tuple[int | None, np.ndarray]]) -> pa.RecordBatch:
            rows = [(k, *r) for (k, _), r in zip(groups, _best_within([tuple(x) for _, x in groups], budget), strict=True)]
            kinds = pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], [group, "gain", "cost", "items"])

        key, parts, n_held, whole = None, [], 0, []
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(0)
            code = np.where(keys.is_valid().to_numpy(zero_copy_only=False), keys.fill_null(0).to_numpy(), 0)
            new = np.diff(code) != 0
            null = keys.is_null().to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(new | (null[1:] != null[:-1])) + 1), b.num_rows]
            rows = np.stack([np.asarray(b.column(k).to_numpy(zero_copy_only=False), np.int64) for k in (1, 2, 3)])
            for first, stop in zip(cuts[:-1], cuts[1:], strict=True):
                k = keys[first].as_py()
                if parts and k != key:
                    whole.append((key, cut(parts)))
                    parts, n_held = [], 0
                    if len(whole) * max(x.shape[1] for _, x in whole) > IN_STEP:
                        yield solved(whole)
                        whole = []
                key = k
                parts.append(rows[:, first:stop])
                n_held += stop - first
                if n_held > held:
                    parts, n_held = [cut(parts)], 0
        if parts:
            whole.append((key, cut(parts)))
        if whole:
            yield solved(whole)

    rows = items.select(*[F.col(c).cast("long").alias(c) for c in (group, item, gain, cost)])
    return rows.repartition(group).sortWithinPartitions(group, item).mapInArrow(f, f"{group} long, gain long, cost long, items array<long>")


def seeded_bootstrap(clusters: DataFrame, group: str, order: str, base: str, cand: str, samples: int, seed: int) -> DataFrame:
    """Row per group: improvement 1 - sum(cand)/sum(base) with an interval from numpy's generator, by cluster."""

    def f(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(order, kind="stable")
        b, c = p[base].to_numpy(float), p[cand].to_numpy(float)
        rng, sums = np.random.default_rng(seed), []
        for at in range(0, samples, BLOCK):  # one stream of draws, a block of replicates at a time
            pick = rng.integers(0, len(p), (min(BLOCK, samples - at), len(p)))
            sums.append((b[pick].sum(1), c[pick].sum(1)))
        sb, sc = (np.concatenate(x) for x in zip(*sums, strict=True))
        x = 1 - sc[sb > 0] / sb[sb > 0]
        low, high = np.quantile(x, [0.025, 0.975]) if len(x) else (np.nan, np.nan)
        return pd.DataFrame({group: [p[group].iloc[0]], "improvement": [1 - c.sum() / b.sum()], "low": [low], "high": [high], "share_positive": [float((x > 0).mean()) if len(x) else np.nan]})

    return clusters.select(group, order, base, cand).groupBy(group).applyInPandas(f, f"{group} string, improvement double, low double, high double, share_positive double")


def balanced_fill(items: DataFrame, group: str, item: str, score: str, bins: int) -> DataFrame:
    """Row per item: its bin, of equal capacities (the last may stay short).

    The item with the highest score goes to the bin with the least sum that has room; ties go
    to the smaller item and bin. Groups are of one object's parts, and so small.
    """

    def f(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values([score, item], ascending=[False, True], kind="stable")
        room, heap, out = -(-len(p) // bins), [(0, b, 0) for b in range(bins)], []
        for s in p[score]:
            total, b, n = heapq.heappop(heap)
            out.append(b)
            if n + 1 < room:
                heapq.heappush(heap, (total + s, b, n + 1))
        return pd.DataFrame({group: p[group], item: p[item], "bin": out})

    return items.select(group, item, score).groupBy(group).applyInPandas(f, f"{group} long, {item} long, bin long")


def descend(options: DataFrame, group: str, item: str, mode: str, value: str, cost: str, price: float, sweeps: int = 20) -> DataFrame:
    """Row per item: the mode that coordinate descent ends with, and the group's objective.

    options has each item's value and cost in each mode (numbered from 0, all of them). The objective is the
    square of the group's sum of values plus price x the sum of costs. Starts are every mode
    for all items; the best end counts, of equal ones the one from the smaller start. A step
    changes one item to its best mode, ties to the smaller, until a sweep changes nothing.
    """

    def f(p: pd.DataFrame) -> pd.DataFrame:
        x, c = (p.pivot(index=item, columns=mode, values=v).sort_index() for v in (value, cost))
        names, x, c = x.index.to_numpy(), x.to_numpy(float), c.to_numpy(float)
        best: tuple[float, np.ndarray] | None = None
        rows = np.arange(len(x))
        for start in range(x.shape[1]):
            chosen = np.full(len(x), start)
            for _ in range(sweeps):
                before = chosen.copy()
                total = x[rows, chosen].sum()
                for k in rows:
                    rest = total - x[k, chosen[k]]
                    chosen[k] = int(np.argmin((rest + x[k]) ** 2 + price * c[k]))
                    total = rest + x[k, chosen[k]]
                if (chosen == before).all():
                    break
            objective = x[rows, chosen].sum() ** 2 + price * c[rows, chosen].sum()
            if best is None or objective < best[0]:
                best = objective, chosen
        return pd.DataFrame({group: p[group].iloc[0], item: names, "mode": best[1], "objective": best[0]})

    return options.select(group, item, mode, value, cost).groupBy(group).applyInPandas(f, f"{group} long, {item} long, mode long, objective double")
