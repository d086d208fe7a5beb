"""All swept arms of many trajectories at once, as arrays (trajectory, stored step).

The same rules as ``arms``, whose forms by rows stay beside them; here every value of every arm is tallied in the task, so only
counts by class leave it.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from holdfast.functions.exprs import BOT
from holdfast.operators.arms import SWEEPS


def labels(probs: np.ndarray, has: np.ndarray) -> np.ndarray:
    """Most probable class, lowest index on ties; no answer without probabilities."""
    return np.where(has, probs.argmax(axis=-1), BOT)


def ema(probs: np.ndarray, has: np.ndarray, alpha: float) -> np.ndarray:
    out, q, held = [], probs[:, 0], has[:, 0]
    for t in range(has.shape[1]):
        if t:
            both = alpha * probs[:, t] + (1.0 - alpha) * q
            q = np.where(has[:, t, None], np.where(held[:, None], both, probs[:, t]), q)
            held = held | has[:, t]
        out.append(labels(q, held))
    return np.stack(out, axis=1)


def hysteresis(probs: np.ndarray, has: np.ndarray, margin: float) -> np.ndarray:
    base, row = labels(probs, has), np.arange(len(has))
    cur = base[:, 0]
    out = [cur]
    for t in range(1, has.shape[1]):
        k = base[:, t]
        lead = probs[row, t, np.maximum(k, 0)] - probs[row, t, np.maximum(cur, 0)]
        cur = np.where((k != BOT) & ((cur == BOT) | ((k != cur) & (lead > margin))), k, cur)
        out.append(cur)
    return np.stack(out, axis=1)


def patience(probs: np.ndarray, has: np.ndarray, n: int) -> np.ndarray:
    base = labels(probs, has)
    cur, cand, run = base[:, 0], np.full(len(has), BOT), np.zeros(len(has), np.int64)
    out = [cur]
    for t in range(1, has.shape[1]):
        k = base[:, t]
        run = np.where(k == cand, run + 1, 1)
        cur = np.where((k != BOT) & ((cur == BOT) | ((k != cur) & (run >= n))), k, cur)
        cand = k
        out.append(cur)
    return np.stack(out, axis=1)


def majority(probs: np.ndarray, has: np.ndarray, width: int) -> np.ndarray:
    base = labels(probs, has)
    votes = np.cumsum(base[:, :, None] == np.arange(probs.shape[2]), axis=1)
    votes[:, width:] = votes[:, width:] - votes[:, :-width]
    mine = np.take_along_axis(votes, np.maximum(base, 0)[:, :, None], axis=2)[:, :, 0]
    return np.where(base == BOT, BOT, np.where(mine == votes.max(axis=2), base, votes.argmax(axis=2)))


ARMS: dict[str, Callable[[np.ndarray, np.ndarray, float], np.ndarray]] = {"ema": ema, "majority": majority, "hysteresis": hysteresis, "patience": patience}
TALLY = "system_id string, arm string, value double, class_code int, d double, a long, n long"


def tally(draw: Callable[[pa.RecordBatch], Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]], first: int, steps: int, delta: float):
    """Batches of clips -> delay, clips right at the end and clips, by system, arm, value and class; the window is ``steps`` long from index ``first``.

    Sums of delays are exact: they are multiples of half a step.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, y, probs, has in draw(b):
                made = [("base", 0.0, labels(probs, has)), *[(arm, float(v), ARMS[arm](probs, has, v)) for arm, values in SWEEPS.items() for v in values]]
                for arm, value, pred in made if len(y) else ():
                    wrong = pred[:, first:first + steps + 1] != y[:, None]
                    last = np.where(wrong.any(axis=1), steps - wrong[:, ::-1].argmax(axis=1), -1)
                    delay = np.where(last < 0, 0.0, np.where(last >= steps, steps * delta, (last + 0.5) * delta))
                    for c in np.unique(y).tolist():
                        of = y == c
                        rows.append((name, arm, value, c, float(delay[of].sum()), int((last[of] < steps).sum()), int(of.sum())))
            kinds = [pa.string(), pa.string(), pa.float64(), pa.int32(), pa.float64(), pa.int64(), pa.int64()]
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [x.split()[0] for x in TALLY.split(", ")])
    return run
