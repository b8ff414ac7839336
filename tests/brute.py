"""Row-at-a-time definitions of the state derivations, and random logs to try them on."""

from __future__ import annotations

import random
from decimal import Decimal

UPDATE = (
    "seq long, height long, token0 string, token1 string, token_in string, tick int, fee int, reserves decimal(38,0)"
)


def frame(spark, rows: list[tuple]):
    return spark.createDataFrame([(*row[:-1], Decimal(row[-1])) for row in rows], UPDATE)


def random_updates(n: int, seed: int, hot: float = 0.6, ticks: int = 6, null_fee: bool = False) -> list[tuple]:
    """A log in which one pair holds most rows; heights have gaps, reserves are often zero or repeated."""
    pick = random.Random(seed)
    rows, height = [], 1
    for seq in range(n):
        height += pick.choice([0, 0, 0, 1, 1, 2, 9])
        pair = ("A", "B") if pick.random() < hot else pick.choice([("B", "C"), ("C", "D")])
        fee = pick.choice([1, 5, None]) if null_fee else pick.choice([1, 5])
        reserves = pick.choice([0, 0, 0, 1, 2, 10**30])
        rows.append(
            (seq, height, *pair, pick.choice(pair), pick.randint(-ticks // 2, ticks // 2), fee, reserves)
        )
    return rows


def diffs(rows: list[tuple], by_fee: bool = False) -> list[tuple]:
    known, out = {}, []
    for seq, _, t0, t1, tin, tick, fee, reserves in rows:
        key = (t0, t1, tin, tick, fee) if by_fee else (t0, t1, tin, tick)
        if reserves != known.get(key, 0):
            out.append((seq, reserves - known.get(key, 0)))
        known[key] = reserves
    return out


def versions(rows: list[tuple]) -> list[tuple]:
    state, out = {}, {}
    for _, height, t0, t1, tin, tick, fee, reserves in rows:
        key = (t0, t1, tin, tick, fee)
        if state.get(key) != reserves:
            state[key] = reserves
            out[(*key, height)] = reserves
    return [(*key, value) for key, value in out.items()]


def _changes(rows: list[tuple]):
    """Each state change with the state of its side after it."""
    state = {}
    for seq, height, t0, t1, tin, tick, fee, reserves in rows:
        side = state.setdefault((t0, t1, tin), {})
        if side.get((tick, fee)) != reserves:
            side[(tick, fee)] = reserves
            yield seq, (t0, t1), int(tin == t1), side


def reserves_series(rows: list[tuple]) -> list[tuple]:
    totals, out = {}, []
    for seq, pair, side, state in _changes(rows):
        known = totals.setdefault(pair, [None, None])
        total = sum(state.values())
        if known[side] != total:
            known[side] = total
            out.append((seq, *pair, *[float(t or 0) for t in known]))
    return out


def price_series(rows: list[tuple]) -> list[tuple]:
    best, out = {}, []
    for seq, pair, side, state in _changes(rows):
        known = best.setdefault(pair, [None, None])
        live = [tick for (tick, _), reserves in state.items() if reserves > 0]
        lowest = min(live) if live else None
        shown = lowest if side == 1 or lowest is None else -lowest
        if known[side] != shown:
            known[side] = shown
            other = known[1 - side]
            out.append((seq, *pair, *known, shown if shown is not None else other))
    return out


def frames(rows: list[tuple]) -> list[tuple]:
    state, out = {}, {}
    for _, height, t0, t1, tin, tick, fee, reserves in rows:
        fees = state.setdefault((t0, t1, tin, tick), {})
        if fees.get(fee) != reserves:
            fees[fee] = reserves
            out[(t0, t1, tin, tick, height)] = sum(fees.values())
    return [(*key, value) for key, value in out.items()]
