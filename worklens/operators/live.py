"""Live rules as step objects: engagement, smoothing, signal windows, collection spans and features of time windows.

Each is fed a key's rows in event time, on a stream by ``streaming.stateful.fold_stream`` and in batch by ``folds.fold_rows``, and holds
little: the last few inputs, one open window or span, the apps of a window. The batch forms with windows and aggregates are in
``operators.signals`` and ``operators.statelog``; both give the same rows."""

from __future__ import annotations

import json
import math
import sys

from pyspark import cloudpickle

from worklens.operators.folds import LatentTasks, Step, StreamingAssignment, seconds, stamp
from worklens.operators.metrics import PRESETS
from worklens.operators.signals import SYSTEM_PROCESSES

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # see operators.folds


class Engagement(Step):
    """Rows ts, app, window_title. Gives the first moment at which, after the warm-up, enough inputs came in the last ``within`` seconds and
    a window that is no system process has not changed for ``stable`` seconds; at the end a key that never got there, with a null.

    Only the last ``at_least`` times are held: there are enough inputs while the oldest of them lies inside the span. Once engaged, a
    key holds nothing but that."""

    SCHEMA = "started timestamp, engaged_at timestamp"

    def __init__(self, warmup: float = 30, at_least: int = 5, within: float = 30, stable: float = 10, system: tuple[str, ...] = tuple(SYSTEM_PROCESSES)):
        self.warmup, self.at_least, self.within, self.stable, self.system = warmup, at_least, within, stable, list(system)
        self.started = self.window = self.since = None
        self.recent: list[float] = []
        self.done = False

    def feed(self, row: dict) -> list[tuple]:
        if self.done:
            return []
        now = seconds(row["ts"])
        self.started = now if self.started is None else self.started
        self.recent = [*self.recent, now][-self.at_least :]
        window = [row["app"], row["window_title"]]
        if window != self.window:
            self.window, self.since = window, now
        busy = len(self.recent) == self.at_least and self.recent[0] > now - self.within
        if now - self.started < self.warmup or not busy or (row["app"] or "").lower() in self.system or now - self.since < self.stable:
            return []
        self.done, self.recent = True, []
        return [(stamp(self.started), stamp(now))]

    def finish(self) -> list[tuple]:
        return [] if self.done or self.started is None else [(stamp(self.started), None)]


class Smoothing(Step):
    """Rows start_time, session_id, task, confidence. Gives for each prediction the most confident of the last ``size``, the earliest of equals."""

    SCHEMA = "session_id string, smoothed_task string, smoothed_confidence double"

    def __init__(self, size: int = 3):
        self.size, self.last = size, []

    def feed(self, row: dict) -> list[tuple]:
        self.last = [*self.last, [-float(row["confidence"]), seconds(row["start_time"]), row["task"]]][-self.size :]
        sure, _, task = min(self.last)
        return [(row["session_id"], task, -sure)]


class SignalWindows(Step):
    """Rows ts, event_id, task_id, keys, clicks, distance, app of a session. Gives each stretch on one task when the next one starts; at the end the
    open one, whose end is not known."""

    SCHEMA = "window_no bigint, task_id string, start_time timestamp, end_time timestamp, keys bigint, clicks bigint, mouse_distance bigint, active_app string"

    def __init__(self):
        self.number, self.open = 0, None

    def close(self, end: float | None) -> list[tuple]:
        s = self.open
        return [(self.number, s["task"], stamp(s["start"]), stamp(end), s["keys"], s["clicks"], s["distance"], s["app"])]

    def feed(self, row: dict) -> list[tuple]:
        now, out = seconds(row["ts"]), []
        if self.open is None or self.open["task"] != row["task_id"]:
            out = self.close(now) if self.open else []
            self.number += 1
            self.open = {"task": row["task_id"], "start": now, "keys": 0, "clicks": 0, "distance": 0}
        for name in ("keys", "clicks", "distance"):
            self.open[name] += int(row[name])
        self.open["app"] = row["app"]
        return out

    def finish(self) -> list[tuple]:
        return self.close(None) if self.open else []


class CollectionSpans(Step):
    """Rows ts, side, event_id, marker (START, STOP or null for an event) and background. Gives each span from a START marker to the next marker
    with the events in it; at the end an open span is taken to last until ``now`` (seconds). A marker comes before events of its time (side 0)."""

    SCHEMA = "started timestamp, stopped timestamp, seconds double, events bigint, background_events bigint"

    def __init__(self, now: float):
        self.now, self.open = now, None

    def close(self, end: float) -> list[tuple]:
        start, events, background = self.open
        self.open = None
        return [(stamp(start), stamp(end), end - start, events, background)]

    def feed(self, row: dict) -> list[tuple]:
        now, out = seconds(row["ts"]), []
        if row["marker"] is not None:
            out = self.close(now) if self.open else []
            if row["marker"] == "START":
                self.open = [now, 0, 0]
        elif self.open:
            self.open[1] += 1
            self.open[2] += bool(row["background"])
        return out

    def finish(self) -> list[tuple]:
        return self.close(self.now) if self.open else []


def variance(n: int, total: float, squares: float) -> float:
    return max(0.0, squares / n - (total / n) ** 2)


class WindowVectors(Step):
    """Rows timestamp_start, timestamp_end, app, keyboard_intensity, mouse_clicks of a key. Gives the feature vector of every window of ``width`` seconds
    once a row of a later one, or the end, has come: the live vector, or with ``free`` that of activity without a session."""

    SCHEMA = "window_start timestamp, " + ", ".join(f"{c} double" for c in (
        "context_switch_entropy", "focus_continuity_score", "max_sustained_minutes", "avg_focus_window_minutes", "focus_consistency", "app_diversity", "session_duration_minutes", "input_intensity"))

    def __init__(self, width: float = 60, free: bool = False):
        self.width, self.free, self.w = width, free, None

    def vector(self) -> list[tuple]:
        w = self.w
        runs = w["runs"] + [(w["end"] - w["run"]) / 60.0]
        longest, usual = max(0.0, max(runs)), sum(runs) / len(runs)
        n, apps = w["n"], w["apps"]
        cap = lambda x: min(x, 1.0)
        sustained = [cap(longest / 300.0), cap(usual / 120.0)]
        if self.free:
            known = len([a for a in apps if a != "unknown"])
            steady = 1.0 / (1.0 + variance(w["kn"], w["k1"], w["k2"]) / 1000.0) if w["kn"] else 0.5
            minutes = (w["end"] - w["start"]) / 60.0 or 1.0
            out = [cap(max(known - 1, 0) / 5.0), steady, *sustained, steady, cap(known / 10.0), cap(minutes / 480.0), cap(w["clicks"] / minutes / 8.0) if minutes > 0 else 0.0]
        else:
            mix = math.log2(n) - sum(c * math.log2(c) for c in apps.values()) / n
            entropy = cap(max(0.0, mix / math.log2(len(apps)))) if len(apps) > 1 else 0.0
            inputs = cap((w["typed"] + w["clicks"]) / w["minutes"] / 8.0)
            out = [entropy, 1.0 - cap((len(runs) - 1) / max(n - 1, 1)), *sustained, 1.0 / (1.0 + variance(n, w["k1"], w["k2"]) / 1000.0), cap(len(apps) / 20.0), cap(w["minutes"] / 480.0), inputs]
        return [(stamp(w["at"]), *out)]

    def feed(self, row: dict) -> list[tuple]:
        start, app, out = seconds(row["timestamp_start"]), row["app"] or "unknown", []
        end = start if row["timestamp_end"] is None else seconds(row["timestamp_end"])
        at = start // self.width * self.width
        if self.w is not None and self.w["at"] != at:
            out, self.w = self.vector(), None
        if self.w is None:
            self.w = {"at": at, "start": start, "run": start, "app": app, "runs": [], "n": 0, "apps": {}, "minutes": 0.0, "typed": 0.0, "clicks": 0, "k1": 0.0, "k2": 0.0, "kn": 0}
        w = self.w
        if w["app"] != app:
            w["runs"].append((w["end"] - w["run"]) / 60.0)
            w.update(app=app, run=start)
        minutes = (end - start) / 60.0 if end > start else 1.0 / 60.0
        kb, clicks = float(row["keyboard_intensity"] or 0.0), int(row["mouse_clicks"] or 0)
        w["end"], w["n"] = end, w["n"] + 1
        w["apps"][app] = w["apps"].get(app, 0) + 1
        for name, more in (("minutes", minutes), ("typed", kb * minutes), ("clicks", clicks), ("k1", kb), ("k2", kb * kb), ("kn", int(kb != 0))):
            w[name] += more
        return out

    def finish(self) -> list[tuple]:
        return self.vector() if self.w else []


class RollingFeatures(Step):
    """Rows timestamp_start, timestamp_end, app, keyboard_intensity, mouse_clicks of a session. Gives, for every interval and once more at the end (``final``), the features of
    the minute buckets of the last ``minutes`` before the session's latest end; if there is none, of its last ten."""

    SCHEMA = "at timestamp, final boolean, num_windows bigint, total_input bigint, intensity double, continuity double, app_diversity double, duration double"
    TEN = 10

    def __init__(self, minutes: float = 10, live: bool = True):
        self.minutes, self.live = minutes, live
        self.start = self.end = None
        self.apps: list[str] = []
        self.buckets: list[list] = []

    def features(self, final: bool) -> list[tuple]:
        near = [n for at, n in self.buckets if (self.end - at) / 60.0 <= self.minutes] or [n for _, n in self.buckets[-self.TEN :]]
        n, total = len(near), sum(near)
        spread = sum((x - total / n) ** 2 for x in near) / n
        lasted = (self.end - self.start) / 60.0 / 60.0
        return [(stamp(self.end), final, n, total, min(total / (n * 60.0), 1.0), 1.0 / (1.0 + spread / 1000.0), min(len(self.apps) / 5.0, 1.0), min(lasted, 1.0))]

    def feed(self, row: dict) -> list[tuple]:
        start, end = seconds(row["timestamp_start"]), seconds(row["timestamp_end"])
        self.start = start if self.start is None else self.start
        self.end = end if self.end is None else max(self.end, end)
        if row["app"] is not None and row["app"] not in self.apps:
            self.apps.append(row["app"])
        minute, inputs = start // 60 * 60, int(float(row["keyboard_intensity"] or 0.0)) + int(row["mouse_clicks"] or 0)
        if self.buckets and self.buckets[-1][0] == minute:
            self.buckets[-1][1] += inputs
        else:
            self.buckets.append([minute, inputs])
        # buckets too old for the span are held only among the last ten
        keep = next((i for i, (at, _) in enumerate(self.buckets) if (self.end - at) / 60.0 <= self.minutes), len(self.buckets))
        self.buckets = self.buckets[min(keep, max(0, len(self.buckets) - self.TEN)) :]
        return self.features(False) if self.live else []

    def finish(self) -> list[tuple]:
        return self.features(True) if self.buckets else []


class AppChanges(Step):
    """Rows ts, event_id, kind, amount, app. Gives each with app_change: 1 if another app was before it, or none."""

    SCHEMA = "ts timestamp, event_id bigint, kind string, amount double, app string, app_change int"

    def __init__(self):
        self.app = None

    def feed(self, row: dict) -> list[tuple]:
        changed, self.app = int(self.app is None or self.app != row["app"]), row["app"]
        return [(stamp(seconds(row["ts"])), int(row["event_id"]), row["kind"], row["amount"], row["app"], changed)]


class SessionAssignments(Step):
    """Rows ts, session_id, kind, amount, app of a user, whose latent tasks (J05) all sessions share. At every input a session that has not been assigned for ``every`` seconds
    and had ``at_least`` inputs in the last ``span`` seconds is matched with the tasks, which learn from it; it is assigned if the match is sure enough for that many inputs.

    What is held of a session are its inputs of the last ``span`` seconds, its apps and its last assignment; a session silent for ``forget`` seconds is
    forgotten. Features that the inputs do not tell take the middle."""

    SCHEMA = "session_id string, ts timestamp, task_id string, confidence double, inputs bigint, reason string"

    def __init__(self, span: float = 300, every: float = 60, at_least: int = 30, base: float = 0.60, preset: str = "DEFAULT", forget: float = 86400):
        self.span, self.every, self.at_least, self.forget = span, every, at_least, forget
        self.rule, self.model = StreamingAssignment(every, at_least, base), LatentTasks()
        self.baselines, self.weights = PRESETS[preset]
        self.sessions: dict[str, dict] = {}

    def dump(self) -> str:
        return json.dumps([self.model.tasks, self.sessions])

    def load(self, text: str) -> Step:
        self.model.tasks, self.sessions = json.loads(text)
        return self

    def intensity(self, recent: list[list]) -> float:
        scale = max(1.0, self.span / 60.0) / 5.0
        counts = [sum(r[1] == "key" for r in recent), sum(r[1] == "click" for r in recent), sum(r[2] for r in recent if r[1] == "move"), sum(r[3] for r in recent)]
        return round(sum(min(1.0, n / (b * scale)) * w for n, b, w in zip(counts, self.baselines, self.weights)) * 100.0, 1)

    def feed(self, row: dict) -> list[tuple]:
        now, name = seconds(row["ts"]), row["session_id"]
        self.sessions = {k: s for k, s in self.sessions.items() if k == name or now - s["seen"] <= self.forget}
        s = self.sessions.setdefault(name, {"last": None, "recent": [], "apps": [], "app": None})
        changed, s["app"], s["seen"] = int(s["app"] != row["app"]), row["app"], now
        if row["app"] is not None and row["app"] not in s["apps"]:
            s["apps"].append(row["app"])
        s["recent"] = [r for r in s["recent"] if r[0] >= now - self.span] + [[now, row["kind"], float(row["amount"] or 0.0), changed]]
        count = len(s["recent"])
        if (s["last"] is not None and now - s["last"] < self.every) or count < self.at_least:
            return []
        vector = [0.5, 0.5, 0.0, 0.0, 0.5, min(1.0, len(s["apps"]) / 10.0), 0.0, self.intensity(s["recent"]) / 100.0]
        _, task, sure, *_ = self.model.feed({"session_id": name, "user_id": row["user_id"], "vector": vector})[0]
        if sure < self.rule.need(count):
            return []
        s["last"] = now
        return [(name, stamp(now), task, sure, count, "high_confidence" if sure >= 0.85 else "good_match" if sure >= 0.70 else "sufficient_data")]
