"""Numeric work inside tasks: one series, or one group of rows, at a time.

Plain numpy and pandas. The functions travel to the executors by value, so that a cluster needs
no copy of this package.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEASON = 7
SIDE_BY_SIDE = 8192  # runs of smoothing at once: their states fit a core's cache
CHECKED = 96  # days after which runs that can't be the best any more end
SHAPES = 4096  # lengths of series for which sums of waves are kept
MARGIN = 5e-5  # by which errors in single precision may be over the least one, as a share
SPARED = 1.15  # runs for one that goes on, from which the others are left out at once
FEW = 12  # series with sales on a day that are subtracted one by one; more are at once
PAIRS = 20_000_000  # pairs of one day counted one by one; more are counted by a matrix product
DENSE = 20  # a step of a matrix product takes so many times less than counting a pair of one day
CHUNK = 2048  # rows of a side multiplied at once
HELD = 100_000  # pairs held before all but the best are dropped


def last_mean(y: np.ndarray, steps: int, window: int) -> dict[str, np.ndarray]:
    """The mean of the last values, of those that are known."""
    known = y[-window:][~np.isnan(y[-window:])]
    return {"forecast": np.full(steps, known.sum() / len(known))} if len(known) else {}


def smooth(y: np.ndarray, steps: int, season: int = SEASON, weights: tuple[float, ...] | None = None) -> dict[str, np.ndarray]:
    """Holt-Winters with the stated weights of level, trend and season, or with those of the least error."""
    return smooth_all([y], [steps], season, weights)[0]


def smooth_all(series: list[np.ndarray], steps: list[int], season: int = SEASON,
               weights: tuple[float, ...] | None = None) -> list[dict[str, np.ndarray]]:
    """``smooth`` of many series, whose passes run side by side."""
    out: list[dict[str, np.ndarray]] = [{} for _ in series]
    usable = sorted((k for k, y in enumerate(series) if len(y) >= 2 * season), key=lambda k: -len(series[k]))
    if not usable:
        return out
    ys = [series[k] for k in usable]
    least, best = np.full(len(ys), np.inf), None
    if weights is not None:
        best = np.tile(np.array(weights, float), (len(ys), 1))
    else:  # a coarse grid, whose corner gives a first bound, then three finer ones around the best point
        axis = np.array([0.01, 0.05, 0.1, 0.2, 0.4, 0.7])
        coarse = np.stack(np.meshgrid(axis, axis, axis), -1).reshape(-1, 3)
        least = _least_error(ys, [coarse[(coarse <= 0.1).all(axis=1) & (coarse != 0.05).all(axis=1)]] * len(ys), season, least)[0]
        grids, width = [coarse] * len(ys), 0.1 / 3
        for turn in range(4):
            least, _, best = _least_error(ys, grids, season, least)
            if turn < 3:  # values that the limits make equal are tried once
                near = np.clip(best[:, :, None] + width * np.linspace(-1, 1, 5), 0.001, 0.999)
                grids = [np.stack(np.meshgrid(*(np.unique(x) for x in three)), -1).reshape(-1, 3) for three in near]
                width /= 3
    level, trend, seasonal = smoothed_states(ys, best, season)
    for r, k in enumerate(usable):
        ahead = np.arange(1, steps[k] + 1)
        out[k] = {"forecast": level[r] + ahead * trend[r] + seasonal[(len(ys[r]) + ahead - 1) % season, r]}
    return out


def smoothed_states(ys: list[np.ndarray], weights: np.ndarray, season: int) -> tuple[np.ndarray, ...]:
    """Final level, trend and season of series, longest first, by the weights of each, in the textbook's order of operations: to the last digit what SQL has."""
    alpha, beta, gamma = (np.ascontiguousarray(weights[:, k]) for k in range(3))
    values = np.zeros((len(ys[0]), len(ys)))
    for k, y in enumerate(ys):
        values[:len(y), k] = y
    level = np.array([y[:season].mean() for y in ys])
    trend = (np.array([y[season:2 * season].mean() for y in ys]) - level) / season
    seasonal = values[:season] - level
    start = season
    for k in range(len(ys), 0, -1):  # as long as the first k series go on
        a, b, g = alpha[:k], beta[:k], gamma[:k]
        own_level, own_trend = level[:k], trend[:k]
        for i in range(start, len(ys[k - 1])):
            y, s = values[i, :k], seasonal[i % season, :k]
            expected = own_level + own_trend
            above = y - expected
            new = a * (y - s) + (1 - a) * expected
            own_trend[...] = b * (new - own_level) + (1 - b) * own_trend
            own_level[...] = new
            s[...] = g * above + (1 - g) * s
        start = max(start, len(ys[k - 1]))
    return level, trend, seasonal


def _least_error(ys: list[np.ndarray], grids: list[np.ndarray], season: int, bound: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...], np.ndarray]:
    """Of each series, longest first, the least error on its grid, its final state and its point, the first of equal ones.

    Errors in single precision, which cost half, leave the points within ``MARGIN`` of the least; these alone are run in double precision,
    unless the two precisions differ by more than an eighth of it for a series. Then its whole grid is.
    """
    size = np.array([np.abs(y).max() for y in ys])
    size = np.exp2(np.where(np.isfinite(size) & (size > 0), np.frexp(size)[1], 0.0))  # a power of two changes no digit
    if max(map(len, grids)) <= 8:
        return _in_double(ys, grids, season, bound)
    single = _errors([(y / own).astype(np.float32) for y, own in zip(ys, size)], grids, season, bound / size ** 2 * (1 + MARGIN))
    near = [np.flatnonzero(error <= error.min() * (1 + MARGIN)) if np.isfinite(error).any() else np.arange(len(error)) for error in single]
    some = [grid[at] for grid, at in zip(grids, near)]
    least, state, best = _in_double(ys, some, season, bound, errors := [])
    with np.errstate(all="ignore"):
        off = [np.abs(error[at] * own ** 2 / exact - 1)[np.isfinite(exact)].max(initial=0.0) for error, at, own, exact in zip(single, near, size, errors)]
    again = [k for k, x in enumerate(off) if not x <= MARGIN / 8 and len(some[k]) < len(grids[k])]
    if again:
        found = _in_double([ys[k] for k in again], [grids[k] for k in again], season, bound[again])
        least[again], best[again] = found[0], found[2]
        for own, new in zip(state, found[1]):
            own[..., again] = new
    return least, state, best


def _chunks(grids: list[np.ndarray], most: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Neighbouring series with about ``most`` runs together, and the series of each run."""
    sizes = np.array([len(grid) for grid in grids])
    ends = np.cumsum(sizes)
    first = 0
    while first < len(grids):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] - sizes[first] + most, side="right")))
        yield first, last, np.repeat(np.arange(last - first), sizes[first:last])
        first = last


def _errors(ys: list[np.ndarray], grids: list[np.ndarray], season: int, bound: np.ndarray) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for first, last, owner in _chunks(grids, 2 * SIDE_BY_SIDE):
        error, _ = smoothing_runs(ys[first:last], owner, np.concatenate(grids[first:last]), season, bound[first:last])
        out += np.split(error, np.cumsum([len(grid) for grid in grids[first:last]])[:-1])
    return out


def _in_double(ys: list[np.ndarray], grids: list[np.ndarray], season: int, bound: np.ndarray, errors: list | None = None) -> tuple[np.ndarray, tuple[np.ndarray, ...], np.ndarray]:
    """``_least_error`` without a choice before; ``errors`` gets those of all points."""
    least, best = np.full(len(ys), np.nan), np.stack([grid[0] for grid in grids])
    state = np.full(len(ys), np.nan), np.full(len(ys), np.nan), np.full((season, len(ys)), np.nan)
    for first, last, owner in _chunks(grids, SIDE_BY_SIDE):
        error, (level, trend, seasonal) = smoothing_runs(ys[first:last], owner, np.concatenate(grids[first:last]), season, bound[first:last])
        start = 0
        for r in range(first, last):
            own = error[start:start + len(grids[r])]
            at = start + int(np.argmin(own))
            least[r], best[r] = error[at], grids[r][at - start]
            state[0][r], state[1][r], state[2][:, r] = level[at], trend[at], seasonal[:, at]
            start += len(own)
            if errors is not None:
                errors.append(own)
    return least, state, best


def smoothing_pass(y: np.ndarray, weights: np.ndarray, season: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Squared error and final state for every row of (alpha, beta, gamma) at once."""
    return smoothing_runs([y], np.zeros(len(weights), np.int64), weights, season, np.array([np.inf]))


def smoothing_runs(ys: list[np.ndarray], owner: np.ndarray, weights: np.ndarray, season: int, bound: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Squared errors and final states of runs over series, longest first. A run has an ``owner``, its series, in order, and a row of (alpha, beta, gamma).

    Errors only grow, so a run whose error is over the ``bound`` of its series can't be the best any more: it ends, with an
    infinite error and no state. With ``short`` the day's error, level grows by trend and alpha * short, trend by alpha * beta * short
    and season by gamma * short.
    """
    lengths, kind = np.array([len(y) for y in ys]), np.float32 if ys[0].dtype == np.float32 else np.float64
    values = np.zeros((lengths[0], len(ys)), kind)
    for k, y in enumerate(ys):
        values[:len(y), k] = y
    mean = values[:season].mean(axis=0)
    slope = (values[season:2 * season].mean(axis=0) - mean) / season
    alpha, gamma, drift = (x.astype(kind) for x in (weights[:, 0], weights[:, 2], weights[:, 0] * weights[:, 1]))
    trend = slope[owner]
    expected = mean[owner] + trend  # level and trend
    seasonal = (values[:season] - mean)[:, owner]
    error = np.zeros(len(owner), kind)
    errors, final = np.full(len(owner), np.inf), (np.full(len(owner), np.nan), np.full(len(owner), np.nan), np.full((season, len(owner)), np.nan))
    runs, limit = np.arange(len(owner)), np.where(np.isfinite(bound), bound, np.inf).astype(kind)[owner]
    seasons = list(seasonal)
    day, who = np.nonzero(values)
    who, firsts = who.tolist(), np.searchsorted(day, np.arange(lengths[0] + 1)).tolist()
    sold = [who[a:b] for a, b in zip(firsts, firsts[1:])]
    add, subtract, multiply = np.add, np.subtract, np.multiply
    begins = np.searchsorted(owner, np.arange(len(ys) + 1)).tolist()
    start, last = season, len(ys)  # series that go on come first
    for stop in sorted({*lengths.tolist(), *range(season + CHECKED, int(lengths[0]), CHECKED)}):
        over, step = np.empty(len(runs), kind), np.empty(len(runs), kind)
        for i in range(start, stop if len(runs) else start):
            now = seasons[i % season]
            add(expected, now, over)
            if len(sold[i]) <= FEW:
                for k in sold[i]:
                    over[begins[k]:begins[k + 1]] -= values[i, k]
            else:
                subtract(over, values[i].take(owner), over)
            multiply(over, over, step)
            add(error, step, error)
            multiply(drift, over, step)
            subtract(trend, step, trend)
            add(expected, trend, expected)
            multiply(alpha, over, step)
            subtract(expected, step, expected)
            multiply(gamma, over, step)
            subtract(now, step, now)
        start = stop
        on = error <= limit
        while last and lengths[last - 1] <= stop:
            last -= 1
        end = begins[last]
        if end < len(runs):
            at = np.flatnonzero(on[end:]) + end
            errors[runs[at]] = error[at]
            final[0][runs[at]], final[1][runs[at]] = expected[at] - trend[at], trend[at]
            for own, now in zip(final[2], seasons):
                own[runs[at]] = now[at]
        kept = slice(end) if SPARED * np.count_nonzero(on[:end]) > end else np.flatnonzero(on[:end])
        if end < len(runs) or not isinstance(kept, slice):
            owner, runs, limit, alpha, gamma, drift, trend, expected, error = (x[kept] for x in (owner, runs, limit, alpha, gamma, drift, trend, expected, error))
            seasons = [x[kept] for x in seasons]
            begins = np.searchsorted(owner, np.arange(len(ys) + 1)).tolist()
    return errors, final


def extend_ar(y: np.ndarray, steps: int, season: int = SEASON) -> dict[str, np.ndarray]:
    """Autoregression with moving-average terms on the series differenced by a day and by a season.

    Two stages of least squares: a long autoregression (two seasons) leaves residuals, and the second one explains the
    series by itself a day, a season and both before, and by the residuals of a day and a season before. Days
    ahead have no residual.
    """
    lags, shocks, deep = (1, season, season + 1), (1, season), 2 * season
    if len(y) < 8 * (season + 1):
        return {}
    w = np.diff(y)
    w = w[season:] - w[:-season]

    def behind(values: np.ndarray, ks: range | tuple[int, ...], start: int) -> list[np.ndarray]:
        return [values[start - k:len(values) - k] for k in ks]

    long = np.stack(behind(w, range(1, deep + 1), deep), axis=1)
    residual = np.zeros(len(w))
    residual[deep:] = w[deep:] - long @ np.linalg.lstsq(long, w[deep:], rcond=None)[0]
    start = deep + season
    past = np.stack(behind(w, lags, start) + behind(residual, shocks, start), axis=1)
    weights = np.linalg.lstsq(past, w[start:], rcond=None)[0]
    deepest = max(lags)  # only the last days are read
    values, changes, errors = (part[-deepest:].tolist() for part in (y, w, residual))
    weights = weights.tolist()
    for _ in range(steps):
        known = [changes[-k] for k in lags] + [errors[-k] for k in shocks]
        changes.append(sum(c * x for c, x in zip(weights, known)))
        errors.append(0.0)
        values.append(changes[-1] + values[-1] + values[-season] - values[-season - 1])
    return {"forecast": np.array(values[deepest:])}


def fit_waves(train: pd.DataFrame, test: pd.DataFrame, weekly: int, yearly: int, z: float,
              breaks: int = 25) -> dict[str, np.ndarray]:
    """``waves_all`` of one series."""
    if not len(train):
        return {}
    start = pd.Timestamp(train["date"].iloc[0])
    days, ahead = ((pd.to_datetime(frame["date"]) - start).dt.days.to_numpy() for frame in (train, test))
    return waves_all([(days, train["demand"].to_numpy(float), ahead)], weekly, yearly, z, breaks)[0]


def waves_all(series: list[tuple[np.ndarray, np.ndarray, np.ndarray]], weekly: int, yearly: int, z: float,
              breaks: int = 25, known: dict | None = None) -> list[dict[str, np.ndarray]]:
    """Log demand on a line that may bend, and on weekly and yearly waves, with a band of ``z`` deviations.

    A series is its days from its first one on, its demand, and the days to forecast. ``breaks`` places spread evenly over
    the first four fifths of the days may each change the slope. The sum of the absolute changes is penalised, so most of
    them stay zero; the last slope goes on into the forecast. Series without a missing day share what depends on
    their length alone; ``known`` keeps it from call to call, for the same number of waves and breaks.
    """
    out: list[dict[str, np.ndarray]] = [{} for _ in series]
    usable = [k for k, (days, _, _) in enumerate(series) if len(days) >= 4 * SEASON]
    if not usable:
        return out
    known = {} if known is None else known
    every = np.arange(max(int(max(days[-1], ahead.max(initial=0))) for days, _, ahead in (series[k] for k in usable)) + 1) / 365.25
    waves = [(k, SEASON) for k in range(1, weekly + 1)] + [(k, 365.25) for k in range(1, yearly + 1)]
    turns = [2 * np.pi * k * 365.25 * every / period for k, period in waves]
    design = np.column_stack([np.ones_like(every), every, *map(np.sin, turns), *map(np.cos, turns)])

    def bends(t: np.ndarray, places: np.ndarray) -> np.ndarray:
        return np.maximum(t[:, None] - places[None, :], 0.0)

    def shape(days: np.ndarray) -> tuple[np.ndarray, ...]:
        """What the days alone decide: places of the bends, and products of the waves and the bends."""
        t = every[days]
        places = t[0] + (t[-1] - t[0]) * 0.8 * np.arange(1, breaks + 1) / (breaks + 1)
        x, h = design[days], bends(t, places)
        ridge = 1e-3 * len(t) * np.diag([0.0, 0.0] + [1e-2] * (x.shape[1] - 2))
        # The line and the waves are solved for in closed form, so only the bends are left to search.
        square, across = x.T @ x + ridge, x.T @ h
        solved = np.linalg.solve(square, across)
        return places, square, across, solved, h.T @ (h - x @ solved)

    shapes, rows, grams, targets, sigmas = [], [], [], [], []
    for n in usable:
        days, demand, _ = series[n]
        whole = int(days[-1]) == len(days) - 1  # no day is missing
        if not whole:
            own = shape(days)
        elif len(days) not in known:
            if len(known) >= SHAPES:
                known.clear()
            known[len(days)] = own = shape(days)
        else:
            own = known[len(days)]
        places, square, across, _, gram = own
        x, y = design[:len(days)] if whole else design[days], np.log1p(demand)
        sold = np.flatnonzero(y)
        line = np.linalg.solve(square, x.T @ y)
        targets.append(bends(every[days[sold]], places).T @ y[sold] - across.T @ line)
        left = y - x @ line
        sigmas.append(noise(left))
        grams.append(gram)
        shapes.append(own)
        rows.append((line, left))
    changes = sparse_weights_all(np.array(grams), np.array(targets), np.array(sigmas))
    for n, change, (places, _, _, solved, _), (line, left) in zip(usable, changes, shapes, rows):
        days, _, ahead = series[n]
        bent = np.flatnonzero(change)
        weights = line - solved[:, bent] @ change[bent]
        if bent.size:  # the residuals of the line and the waves alone, less those of the bends
            x = design[:len(days)] if int(days[-1]) == len(days) - 1 else design[days]
            left = left - bends(every[days], places[bent]) @ change[bent] + x @ (line - weights)
        spread = z * np.std(left)
        middle = design[ahead] @ weights + bends(every[ahead], places[bent]) @ change[bent]
        out[n] = {"forecast": np.expm1(middle), "forecast_lower": np.expm1(middle - spread),
                  "forecast_upper": np.expm1(middle + spread)}
    return out


def noise(values: np.ndarray) -> float:
    """Deviation of the noise from steps between neighbours, which a slow drift hardly moves; of normal
    values the median step is 0.6745 times the square root of two deviations."""
    return float(np.median(np.abs(np.diff(values)))) / (0.6745 * np.sqrt(2.0))


def sparse_weights(gram: np.ndarray, target: np.ndarray, sigma: float, rounds: int = 1000, close: float = 1e-6) -> np.ndarray:
    """``sparse_weights_all`` of one problem."""
    return sparse_weights_all(gram[None], target[None], np.array([sigma]), rounds, close)[0]


def sparse_weights_all(gram: np.ndarray, target: np.ndarray, sigma: np.ndarray, rounds: int = 1000, close: float = 1e-6) -> np.ndarray:
    """Weights of the least squares with a penalty on their absolute sum, one coordinate after the other, of many problems side by side.

    ``gram`` and ``target`` are sums of products. The penalty of a column is what noise of deviation ``sigma`` alone
    would hardly reach in any of them, so a series without a break keeps zeros.
    """
    columns = range(target.shape[1])
    own = np.ascontiguousarray(np.diagonal(gram, axis1=1, axis2=2)).T
    size = np.sqrt(np.clip(own, 0.0, None))
    used = size > 1e-12
    penalty = np.where(used, sigma * np.sqrt(2.0 * np.log(max(len(columns), 2))) * size, np.inf)  # an empty column stays zero
    divisor = np.where(used, own, 1.0)
    limit = close * np.maximum(sigma, 1e-9)
    products = np.ascontiguousarray(gram.transpose(2, 0, 1), float)  # of a column, its products with each other one
    result = np.zeros(target.shape)
    live, gradient, weights = np.arange(len(target)), target.astype(float), np.zeros(target.T.shape)
    for _ in range(rounds):
        moved = np.zeros(len(live))
        least = -penalty
        for j in columns:
            pull = gradient[:, j] + own[j] * weights[j]
            new = (pull - np.minimum(np.maximum(pull, least[j]), penalty[j])) / divisor[j]
            step = new - weights[j]
            at = step.nonzero()[0]  # most weights stay zero, and so do the gradients
            if at.size:
                by = step[at]
                gradient[at] -= products[j].take(at, axis=0) * by[:, None]
                weights[j] = new
                moved[at] = np.maximum(moved[at], np.abs(by) * size[j, at])
        ended = moved <= limit
        if ended.any():
            result[live[ended]] = weights[:, ended].T
            on = ~ended
            live, limit, gradient, products = live[on], limit[on], gradient[on], products[:, on]
            own, size, penalty, divisor, weights = (part[:, on] for part in (own, size, penalty, divisor, weights))
        if not live.size:
            break
    result[live] = weights.T
    return result


def match_group(min_days: int, top: int | None) -> Callable[..., pd.DataFrame]:
    """Pairs in a group (of one block, or across two) that share more than ``min_days`` of the days given, with
    the quantities of both on those days; the ``top`` best pairs if given, by days and then by id."""

    def match(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("sku_id", ignore_index=True)
        if key[-2] == key[-1]:
            sides = (np.arange(len(rows)),) * 2
        else:
            sides = tuple(np.flatnonzero(rows["block"].to_numpy() == block) for block in key[-2:])
        lengths = rows["days"].map(len).to_numpy()
        starts = np.concatenate([[0], np.cumsum(lengths)])
        axis, day = np.unique(np.concatenate(rows["days"].to_list()), return_inverse=True)
        i, j, n = best_pairs(starts, day, len(axis), *sides, min_days, top)
        ids, quantity = rows["sku_id"].to_numpy(), np.concatenate(rows["quantities"].to_list())
        found = pd.DataFrame({"sku_a": ids[i], "sku_b": ids[j], "days_sold_together": n})
        found["qty_a"], found["qty_b"] = shared_quantities(starts, day, quantity, len(axis), i, j)
        return found

    return match


def best_pairs(starts: np.ndarray, day: np.ndarray, n_days: int, left: np.ndarray, right: np.ndarray,
               min_days: int, top: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows i < j, one of each side, with more than ``min_days`` common days, and that number.

    Row r has the days ``day[starts[r]:starts[r + 1]]``. Only the pairs of some rows at a time are counted; with ``top``
    what can't be among the best any more is dropped on the way.
    """
    same = left is right
    need, held, size = min_days + 1, [], 0

    def keep(i: np.ndarray, j: np.ndarray, n: np.ndarray) -> None:
        nonlocal need, held, size
        held.append((np.minimum(i, j), np.maximum(i, j), n))
        size += len(n)
        if top is not None and size > max(HELD, 4 * top):
            held, size = [best(held)], top
            need = max(need, int(held[0][2][-1])) if top else need

    def best(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j, n = (np.concatenate([p[k] for p in parts] or [np.zeros(0, np.int64)]).astype(np.int64) for k in range(3))
        if top is not None:  # rows stand in the order of their ids
            order = np.lexsort((j, i, -n))[:top]
            i, j, n = i[order], j[order], n[order]
        return i, j, n

    lengths = np.diff(starts)
    theirs = np.repeat(np.arange(len(right)), lengths[right])
    places = np.repeat(starts[right] - np.cumsum(lengths[right]) + lengths[right], lengths[right]) + np.arange(len(theirs))
    order = np.argsort(day[places], kind="stable")
    sold = np.bincount(day[places], minlength=n_days)
    ends = np.cumsum(sold)
    work = sum(int(sold[day[starts[r]:starts[r + 1]]].sum()) for r in left)
    if DENSE * work < len(left) * len(right) * n_days:
        of_day = np.split(theirs[order], ends[:-1])
        for at, r in enumerate(left):
            common = np.bincount(np.concatenate([of_day[d] for d in day[starts[r]:starts[r + 1]]]), minlength=len(right))
            if same:
                common[:at + 1] = 0
            hit = np.flatnonzero(common >= need)
            if hit.size:
                keep(np.full(len(hit), r), right[hit], common[hit])
        return best(held)

    def matrix(rows: np.ndarray) -> np.ndarray:
        made = np.zeros((len(rows), n_days), np.float32)  # exact below 2**24 days
        for k, r in enumerate(rows):
            made[k, day[starts[r]:starts[r + 1]]] = 1
        return made

    for a in range(0, len(left), CHUNK):
        one = matrix(left[a:a + CHUNK])
        for b in range(a if same else 0, len(right), CHUNK):
            common = one @ (one if same and a == b else matrix(right[b:b + CHUNK])).T
            if same and a == b:
                common = np.triu(common, 1)
            i, j = np.nonzero(common >= need)
            if i.size:
                keep(left[a + i], right[b + j], common[i, j].astype(np.int64))
    return best(held)


def shared_quantities(starts: np.ndarray, day: np.ndarray, quantity: np.ndarray, n_days: int, i: np.ndarray, j: np.ndarray,
                      chunk: int = 16384) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of rows, what both sold on their common days. Days of a row stand in order."""
    totals = np.zeros((2, len(i)), np.int64)
    keys = np.repeat(np.arange(len(starts) - 1), np.diff(starts)) * n_days + day
    for start in range(0, len(i), chunk):
        a, b = i[start:start + chunk], j[start:start + chunk]
        lengths = starts[a + 1] - starts[a]
        heads = np.cumsum(lengths) - lengths
        mine = np.repeat(starts[a] - heads, lengths) + np.arange(lengths.sum())
        wanted = np.repeat(b, lengths) * n_days + day[mine]
        other = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        both = keys[other] == wanted
        totals[0, start:start + chunk] = np.add.reduceat(np.where(both, quantity[mine], 0), heads)
        totals[1, start:start + chunk] = np.add.reduceat(np.where(both, quantity[other], 0), heads)
    return totals[0], totals[1]


def common_days(days: list[np.ndarray]) -> np.ndarray:
    """Number of common days of every row with every later row, above the diagonal.

    Where few rows share a day, the pairs of each day are counted; where most do, a product of a
    zero-one matrix with itself is quicker (exact in float32 below 2**24 days).
    """
    n = len(days)
    row = np.repeat(np.arange(n), [len(d) for d in days])
    axis, day = np.unique(np.concatenate(days), return_inverse=True)
    order = np.argsort(day, kind="stable")  # rows stay in order within a day
    row, day = row[order], day[order]
    later = np.cumsum(np.bincount(day))[day] - np.arange(1, len(day) + 1)  # rows of the same day that follow
    pairs = int(later.sum())
    if 20 * pairs < n * n * len(axis) and pairs < PAIRS:
        first = np.repeat(np.arange(len(row)), later)
        second = first + 1 + np.arange(pairs) - np.repeat(np.cumsum(later) - later, later)
        return np.bincount(row[first] * n + row[second], minlength=n * n).reshape(n, n)
    dense = np.zeros((n, len(axis)), np.float32)
    dense[row, day] = 1
    return np.triu((dense @ dense.T).astype(np.int64), 1)
