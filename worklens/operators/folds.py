"""Ordered folds for rules whose next step depends on every step before.

``fold_rows`` brings a key's rows together in order and feeds them one by one to a small step object.
The rows stream through the task in Arrow batches and are never gathered; only the step's own state
(a few numbers, or a user's task centroids) is held. The inputs are already reduced rows (sessions,
classification points), not raw events. The same step objects run on streams (``streaming.stateful``).
"""

from __future__ import annotations

import json
import math
import operator
import sys
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.functions import rules
from worklens.operators.statelog import HOLD_SECONDS

# executors need no copy of this package: the step classes travel with the task. Give ``fold_rows`` a
# class or a functools.partial of one.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def fold_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], make: Callable[[], "Step"], schema: str) -> DataFrame:
    n = len(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step, now = None, None
        for pdf in batches:
            out: list[tuple] = []
            cols = list(pdf.columns)
            for values in pdf.itertuples(index=False, name=None):
                key = values[:n]
                if key != now:
                    if step is not None:
                        out += [now + r for r in step.finish()]
                    step, now = make(), key
                out += [key + r for r in step.feed(dict(zip(cols, values)))]
            yield _frame(out, names)
        if step is not None:
            yield _frame([now + r for r in step.finish()], names)

    names = [part.split()[0] for part in schema.split(",")]
    rest = [c for c in df.columns if c not in keys]
    # dealt by a hash of the key: a plain repartition(*keys) is dropped when a join before has dealt the rows by the key already, and
    # once that join turns into a broadcast at run time, its rows stay in the tasks that read them
    return df.select(*keys, *rest).repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    columns = zip(*rows) if rows else [()] * len(names)
    return pd.DataFrame({n: pd.Series(list(c), dtype=object) for n, c in zip(names, columns)})


class Step:
    """State of one key: ``feed`` a row, get output rows; ``finish`` at the end of a batch run."""

    def feed(self, row: dict) -> list[tuple]:
        raise NotImplementedError

    def finish(self) -> list[tuple]:
        return []

    def dump(self) -> str:
        return json.dumps(self.__dict__)

    def load(self, text: str) -> "Step":
        self.__dict__.update(json.loads(text))
        return self


def seconds(ts) -> float:
    """Seconds since the epoch of a timestamp without zone (UTC)."""
    return pd.Timestamp(ts).value / 1e9


def stamp(s: float | None):
    return None if s is None else pd.Timestamp(round(s * 1e6) * 1000)


def added(values: Iterable[float]) -> float:
    """Values added one after the other, as the studied code does. ``sum`` makes up for lost bits from Python 3.12 on, so gaps that are
    equal but for them would fall otherwise there."""
    return reduce(operator.add, values, 0.0)


class Hysteresis(Step):
    """Candidate states to committed states, see ``statelog.committed_states``."""

    SCHEMA = "ts timestamp, from_state string, to_state string, since timestamp, duration_prev bigint"

    def __init__(self, hold: dict[str, float] | None = None):
        self.hold = hold or HOLD_SECONDS
        self.state = self.since = self.pending = self.pending_since = None

    def feed(self, row: dict) -> list[tuple]:
        now, seen = seconds(row["ts"]), row["candidate"]
        if self.state is None:
            self.state, self.since = seen, now
            return [(stamp(now), None, seen, stamp(now), 0)]
        if seen == self.state:
            self.pending = None
            return []
        if seen != self.pending:
            self.pending, self.pending_since = seen, now
            return []
        if now - self.pending_since < self.hold.get(seen, 0):
            return []
        out = (stamp(now), self.state, seen, stamp(self.pending_since), int(round(now - self.since, 6)))
        self.state, self.since, self.pending = seen, self.pending_since, None
        return [out]


class LatentTasks(Step):
    """Tasks found as centroids of similar sessions of a user.

    A session joins the nearest centroid within .35 when its confidence (closeness plus a bonus for
    members) reaches .6, and moves it by an exponential mean; otherwise it opens a new one. Every output
    row carries the state of its centroid after the session.
    """

    SCHEMA = ("session_id string, task_id string, confidence double, members bigint, centroid_confidence double, drift double, "
              "drift_cumulative double, feature_drift_avg double, entropy double, continuity double")

    def __init__(self, reach: float = 0.35, need: float = 0.6, stable_members: int = 3, alpha: float = 0.2):
        self.reach, self.need, self.stable_members, self.alpha = reach, need, stable_members, alpha
        self.tasks: list[dict] = []

    @staticmethod
    def gap(a: list[float], b: list[float]) -> float:
        return min(1.0, math.sqrt(added((x - y) ** 2 for x, y in zip(a, b)) / len(a)))

    def feed(self, row: dict) -> list[tuple]:
        v = [float(x) for x in row["vector"]]
        best, d = None, math.inf
        for i, t in enumerate(self.tasks):
            g = self.gap(v, t["mean"])
            if g < d:
                best, d = i, g
        if best is not None and d <= self.reach:
            t = self.tasks[best]
            sure = min(1.0, 1.0 - d / self.reach + t["n"] / self.stable_members * 0.2)
            if sure >= self.need:
                self.absorb(t, v)
                return [self.row(row, best, sure)]
        first = not self.tasks
        zero = [0.0] * len(v)
        self.tasks.append({"mean": v, "var": zero, "move": zero, "n": 1, "sure": 0.5, "drift": 0.0, "far": 0.0})
        return [self.row(row, len(self.tasks) - 1, 1.0 if first else 0.5)]

    def absorb(self, t: dict, v: list[float]) -> None:
        t["n"] += 1
        a, old = min(self.alpha, 1.0 / t["n"]), t["mean"]
        blend = lambda x, y: x * (1 - a) + y * a
        t["mean"] = [blend(m, x) for m, x in zip(old, v)]
        t["var"] = [(1 - a) * (s + a * (x - m) ** 2) for m, s, x in zip(old, t["var"], v)]
        t["move"] = [blend(p, abs(x - m)) for m, p, x in zip(old, t["move"], v)]
        shift, move = self.gap(old, t["mean"]), added(t["move"]) / len(v)
        t["far"] = min(t["far"] + shift, 10.0)
        t["drift"] = max(0.0, min(t["drift"] * 0.5 + shift * 0.3 + move * 0.2, 1.0))
        calm = max(0.0, 1.0 - added(t["var"]) / len(v))
        t["sure"] = max(0.0, min(0.4 * min(t["n"] / self.stable_members, 1.5) + 0.35 * calm + 0.25 * max(0.0, 1.0 - 2 * t["drift"]), 1.0))

    def row(self, row: dict, i: int, sure: float) -> tuple:
        t = self.tasks[i]
        return (row["session_id"], f"latent-{row['user_id']}-{i + 1}", sure, t["n"], t["sure"], t["drift"], t["far"],
                added(t["move"]) / len(t["move"]), t["mean"][0], t["mean"][1])


STICKY = {s[0] for s in rules.SIGNATURES if s[7]}


class OnlineSegments(Step):
    """Segments of a running session out of classified points (H13 task, confidence, name, app,
    title). A point opens a new segment when the behaviour moves on (G31) or the context changes (G30)."""

    SCHEMA = "task_id string, base_category string, start_time timestamp, end_time timestamp, confidence double, reason string, app string, window_title string"

    def __init__(self, min_seconds: float = 60, min_confidence: float = 0.6, minute: float = 60.0):
        self.min_seconds, self.min_confidence, self.minute = min_seconds, min_confidence, minute
        self.open: dict | None = None
        self.last = None

    def moves_on(self, task: str, sure: float, minutes: float) -> bool:
        s = self.open
        if s["base"] == task:
            return False
        gap = sure - s["sure"]
        if s["base"] in STICKY:
            return gap >= 0.10 or (minutes >= 10 and gap >= -0.05)
        return gap > 0.03 or (abs(gap) <= 0.15 and minutes >= 3) or (minutes >= 5 and sure > 0.5)

    def context_change(self, row: dict, lasted: float) -> str | None:
        s = self.open
        if lasted < self.min_seconds or row["confidence"] < self.min_confidence:
            return None
        if s["app"] != row["app"]:
            return f"app_change_{s['app']}_to_{row['app']}"
        return "window_change" if s["title"] != row["clean_title"] else None

    def start(self, row: dict, now: float, reason: str) -> None:
        self.open = {"name": row["task_name"], "base": row["task"], "start": now, "sure": float(row["confidence"]), "reason": reason,
                     "app": row["app"], "title": row["clean_title"]}

    def close(self, end: float) -> tuple:
        s = self.open
        return (s["name"], s["base"], stamp(s["start"]), stamp(end), s["sure"], s["reason"], s["app"], s["title"])

    def feed(self, row: dict) -> list[tuple]:
        now = seconds(row["ts"])
        self.last = seconds(row["until"])
        if self.open is None:
            self.start(row, now, f"initial_{row['task']}")
            return []
        lasted = now - self.open["start"]
        moved = self.moves_on(row["task"], float(row["confidence"]), lasted / self.minute)
        context = self.context_change(row, lasted)
        if moved or context:
            done = self.close(now)
            both = "behavioral_and_context_change" if moved and context else None
            self.start(row, now, both or context or f"behavioral_transition_{self.open['base']}_to_{row['task']}")
            return [done]
        if row["task"] == self.open["base"]:
            self.open["sure"] = max(self.open["sure"], float(row["confidence"]))
        self.open.update(app=row["app"], title=row["clean_title"])
        return []

    def finish(self) -> list[tuple]:
        return [self.close(self.last)] if self.open else []


class StreamingAssignment(Step):
    """At most one assignment per interval, only with enough inputs, and with a threshold that
    rises with the inputs."""

    SCHEMA = "ts timestamp, task_id string, confidence double, inputs bigint, reason string"

    def __init__(self, every_seconds: float = 60, at_least: int = 30, base: float = 0.60):
        self.every_seconds, self.at_least, self.base = every_seconds, at_least, base
        self.last = None

    def need(self, inputs: int) -> float:
        if inputs < 30:
            return max(0.40, self.base - 0.15)
        return self.base if inputs < 100 else min(0.75, self.base + 0.10)

    def feed(self, row: dict) -> list[tuple]:
        now, inputs, sure = seconds(row["ts"]), int(row["inputs"]), float(row["confidence"])
        if (self.last is not None and now - self.last < self.every_seconds) or inputs < self.at_least or sure < self.need(inputs):
            return []
        self.last = now
        reason = "high_confidence" if sure >= 0.85 else "good_match" if sure >= 0.70 else "sufficient_data"
        return [(stamp(now), row["task_id"], sure, inputs, reason)]
