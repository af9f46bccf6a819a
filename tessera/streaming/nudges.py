"""Nudges of a session: what an agent is reminded of at a turn, debounced, suppressed once ignored, the most urgent first.

One fold over a session's turns, ``turn``, serves the batch (``nudges``) and the stream (``nudge_stream``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

# The kinds from the most urgent down.
KINDS = ("pending_markers", "stale_hypothesis", "storage_gap", "form_belief", "relevant_context", "open_reasoning")
GAP = KINDS.index("storage_gap")

_OUT = "session long, event_id long, n_turn int, kind string, priority int, gap int"
_STATE = "last_at long, n_turn int, stored_at int, shown array<int>, ignored array<int>"


@dataclass(frozen=True)
class Rules:
    """``gap``: turns without a write that are too many. A kind rests ``debounce`` turns and ends when ignored
    ``most_ignored`` times; a turn gets ``most`` nudges; a session of ``hours`` without a turn starts anew."""

    gap: int = 10
    debounce: int = 3
    most_ignored: int = 3
    most: int = 3
    hours: float = 4.0

    @property
    def rest_ms(self) -> int:
        return int(self.hours * 3_600_000)


@dataclass
class Session:
    """What is known after a turn; ``shown``: the turn of each kind's last nudge, 0 for none."""

    last_at: int
    n_turn: int = 0
    stored_at: int = 0
    shown: list[int] = field(default_factory=lambda: [0] * len(KINDS))
    ignored: list[int] = field(default_factory=lambda: [0] * len(KINDS))


def turn(s: Session | None, row, rules: Rules) -> tuple[Session, list[tuple]]:
    """The session after a turn, and the nudges that the turn gets. A nudge beyond the ``most`` rests like one that is given."""
    at = int(row.at)
    if s is None or at - s.last_at >= rules.rest_ms:
        s = Session(at)
    s.last_at, s.n_turn = max(at, s.last_at), s.n_turn + 1
    if row.stored:
        s.stored_at = s.n_turn
    ignored, wants = (set(x) if x is not None else set() for x in (row.ignored, row.wants))
    gap = s.n_turn - s.stored_at
    due = []
    for i, kind in enumerate(KINDS):
        s.ignored[i] += kind in ignored
        wanted = gap > rules.gap if i == GAP else kind in wants
        if wanted and s.ignored[i] < rules.most_ignored and (not s.shown[i] or s.n_turn - s.shown[i] >= rules.debounce):
            s.shown[i] = s.n_turn
            due.append((row.session, row.event_id, s.n_turn, kind, i, gap))
    return s, due[: rules.most]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    kinds = {"session": "int64", "event_id": "int64", "n_turn": "int32", "kind": "object", "priority": "int32", "gap": "int32"}
    return pd.DataFrame(rows, columns=list(kinds)).astype(kinds)


def _turns(turns: DataFrame) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    kept = turns.where("session is not null and event_id is not null and ts is not null")
    return kept.select("session", "event_id", ts.alias("ts"), F.unix_millis(ts).alias("at"), F.coalesce("stored", F.lit(False)).alias("stored"), "wants", "ignored")


def nudges(turns: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``session, event_id, n_turn, kind, priority, gap``: the nudges of each turn.

    ``turns``: ``session, event_id, ts, stored, wants array<string>, ignored array<string>``: whether something was written,
    what a check would remind of, and which kinds the agent passed over. A session's turns are read in order of time and id and never held:
    a sorted partition is one pass. Rows without session, id or time take no part; a null flag or list is none; equal rows are turns of their own.
    """
    ordered = _turns(turns).drop("ts").repartition("session").sortWithinPartitions("session", "at", "event_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, s = None, None
        for f in frames:
            out = []
            for row in f.itertuples(index=False):
                if row.session != key:
                    key, s = row.session, None
                s, due = turn(s, row, rules)
                out += due
            yield _frame(out)

    return ordered.mapInPandas(run, _OUT)


class _Nudger(StatefulProcessor):
    """The fold as a stream's state; a timer frees that of a session at rest."""

    def __init__(self, rules: Rules) -> None:
        self.rules = rules

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("session", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s = None
        if self.state.exists():
            last_at, n_turn, stored_at, shown, ignored = self.state.get()
            s = Session(last_at, n_turn, stored_at, list(shown), list(ignored))
            self.handle.deleteTimer(s.last_at + self.rules.rest_ms)
        out = []
        for row in pd.concat(list(rows)).sort_values(["at", "event_id"]).itertuples(index=False):
            s, due = turn(s, row, self.rules)
            out += due
        self.state.update(tuple(asdict(s).values()))
        self.handle.registerTimer(s.last_at + self.rules.rest_ms)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield _frame([])

    def close(self) -> None:
        pass


def nudge_stream(turns: DataFrame, rules: Rules = Rules(), late: str = "10 minutes") -> DataFrame:
    """The same on a stream: each micro-batch's turns of a session in order, its state kept between them.

    The session needs RocksDB as ``spark.sql.streaming.stateStore.providerClass``. Turns later than ``late`` are left out.
    """
    return _turns(turns).withWatermark("ts", late).groupBy("session").transformWithStateInPandas(_Nudger(rules), _OUT, "append", "eventTime")
