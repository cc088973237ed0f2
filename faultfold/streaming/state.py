"""What the event path knows of each signature, as keyed state with timers.

A signature is unknown, open (its analysis failed and is due again) or known (it has a report). One
row per signature and batch of entries comes in, so that a signature with very many entries is one
row here. State lies in RocksDB beside the checkpoint: a batch opens the signatures it brings, however
many there have been.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor

from faultfold.operators.answers import incidents_of
from faultfold.operators.deadletters import MAX_ATTEMPTS
from faultfold.operators.limits import MAX_BYTES

# Fixed values, in seconds: the first wait after a failure, the longest, and how long an entry may wait
# at all before it is a dead letter.
FIRST_WAIT, LONGEST_WAIT, MAIN_RETENTION = 10, 600, 86_400

# Outcomes. A signature that waits has no outcome yet.
REPORTED, FOLLOWS, NOTHING, REJECTED, DEAD = "reported", "follows", "nothing", "rejected", "dead"
WAITING = "waiting"
# Not an outcome: how many entries of its signature came before a fault.
CARRY = "carry"

#: A fault: what a batch of entries adds to a signature. Times are microseconds since 1970; ``seq`` is the
#: number of the batch.
FAULT = (
    "severity string, service_name string, log_message string, bytes bigint, incident_count bigint, "
    "first_us bigint, last_us bigint, first_insert_id string, last_insert_id string, "
    "first_seq bigint, last_seq bigint"
)
FAULT_FIELDS = [f.split()[0] for f in FAULT.split(", ")]
OUTCOME = (
    f"signature string, outcome string, report_id string, {FAULT}, incidents string, problem string, attempts int, "
    "known_service string, known_impact string, before bigint"
)


class Fault(NamedTuple):
    severity: str | None
    service_name: str | None
    log_message: str | None
    bytes: int
    incident_count: int
    first_us: int | None
    last_us: int | None
    first_insert_id: str
    last_insert_id: str
    first_seq: int
    last_seq: int

    def with_(self, other: Fault) -> Fault:
        """Both together: counts added, the first and the last sighting of either."""
        early = min((self, other), key=lambda f: (f.first_us is None, f.first_us or 0, f.first_insert_id))
        late = max((self, other), key=lambda f: (f.last_us is not None, f.last_us or 0, f.last_insert_id))
        return self._replace(
            incident_count=self.incident_count + other.incident_count,
            first_us=early.first_us, first_insert_id=early.first_insert_id,
            last_us=late.last_us, last_insert_id=late.last_insert_id,
            first_seq=min(self.first_seq, other.first_seq), last_seq=max(self.last_seq, other.last_seq),
        )


def wait_seconds(attempts: int, first: float = FIRST_WAIT, longest: float = LONGEST_WAIT) -> float:
    """How long to wait after so many failed attempts: doubled each time, up to the longest."""
    return min(first * 2 ** min(attempts - 1, 60), longest)


def _iso(us: int | None) -> str | None:
    if us is None:
        return None
    moment = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(microseconds=us)
    return moment.strftime("%Y-%m-%dT%H:%M:%S.%fZ")


class SignatureState(StatefulProcessor):
    """Analyses the first entries of a signature, counts the others, and tries failed ones again.

    ``call`` is as for ``model_analyzer``; without one every new signature gets a report, and whoever
    reads the outcomes fills it. A signature is analysed again ``wait_seconds`` after a failure, by a
    timer and not by new data, at most ``max_attempts`` times; entries that come meanwhile wait with
    it. ``expire_after`` seconds without entries a report is forgotten, and the next entry of its
    signature makes a new one; by default that never happens.

    With ``carry`` each fault also tells how many entries of its signature were accepted before it.

    A fault whose ``seq`` was seen is skipped, so that a batch of entries may be delivered twice.
    """

    def __init__(
        self,
        call: Callable[[list[dict], str | None], str] | None = None,
        instruction: str | None = None,
        max_attempts: int = MAX_ATTEMPTS,
        max_bytes: int = MAX_BYTES,
        first_wait: float = FIRST_WAIT,
        longest_wait: float = LONGEST_WAIT,
        retention: float = MAIN_RETENTION,
        expire_after: float | None = None,
        carry: bool = False,
    ):
        if max_attempts < 1:
            raise ValueError("max_attempts must be at least 1")
        self.call, self.instruction = call, instruction
        self.max_attempts, self.max_bytes = max_attempts, max_bytes
        self.waits, self.retention = (first_wait, longest_wait), retention
        self.carry = carry
        self.ttl = None if expire_after is None else int(1000 * expire_after)

    def init(self, handle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "report_id string, service string, impact string", self.ttl)
        self.open = handle.getValueState("open", f"{FAULT}, attempts int, since_ms bigint, due_ms bigint")
        # Batches of entries come in order, so the last number tells which have been seen.
        self.seen = handle.getValueState("seen", "seq bigint", int(1000 * MAIN_RETENTION))
        self.total = handle.getValueState("total", "n bigint")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = self.seen.get()[0] if self.seen.exists() else 0
        faults = sorted((Fault(*[r[f] for f in FAULT_FIELDS]) for r in rows), key=lambda f: f.first_seq)
        fault = None
        for f in faults:
            if f.first_seq > last:
                last, fault = f.last_seq, f if fault is None else fault.with_(f)
                if self.carry:
                    before = self.total.get()[0] if self.total.exists() else 0
                    self.total.update((before + f.incident_count,))
                    yield self._row(key, CARRY, f, before=before)
        if fault is None:
            return
        self.seen.update((last,))
        now = timerValues.getCurrentProcessingTimeInMs()
        if self.open.exists():
            *old, attempts, since, due = self.open.get()
            self.open.update((*Fault(*old).with_(fault), attempts, since, due))
        elif self.known.exists():
            report, service, impact = self.known.get()
            # Written again, so that a report with entries does not expire.
            self.known.update((report, service, impact))
            yield self._row(key, FOLLOWS, fault, report, known_service=service, known_impact=impact)
        elif fault.bytes > self.max_bytes:
            yield self._row(key, REJECTED, fault)
        else:
            yield from self._attempt(key, fault, 0, now, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        if self.open.exists():
            *old, attempts, since, due = self.open.get()
            if due <= now:
                yield from self._attempt(key, Fault(*old), attempts, since, now)

    def _attempt(self, key, fault: Fault, attempts: int, since: int, now: int) -> Iterator[Row]:
        found, problem = self._ask(key[0], fault)
        if problem is None:
            self.open.clear()
            if found == "[]":
                yield self._row(key, NOTHING, fault)
                return
            report = hashlib.md5(f"{key[0]}|{fault.first_insert_id}".encode()).hexdigest()
            first = json.loads(found)[0] if found else {}
            self.known.update((report, first.get("service_name"), first.get("business_impact")))
            yield self._row(key, REPORTED, fault, report, found)
            return
        attempts += 1
        wait = wait_seconds(attempts, *self.waits)
        if attempts >= self.max_attempts or now + 1000 * wait - since > 1000 * self.retention:
            self.open.clear()
            yield self._row(key, DEAD, fault, problem=problem, attempts=attempts)
            return
        due = now + int(1000 * wait)
        self.open.update((*fault, attempts, since, due))
        self.handle.registerTimer(due)
        yield self._row(key, WAITING, fault, problem=problem, attempts=attempts)

    def _ask(self, signature: str, fault: Fault) -> tuple[str | None, str | None]:
        if self.call is None:
            return None, None
        entry = {
            "signature": signature, "severity": fault.severity, "service_name": fault.service_name,
            "log_message": fault.log_message, "first_seen": _iso(fault.first_us), "last_seen": _iso(fault.last_us),
        }
        return incidents_of(self.call, [entry], self.instruction)

    @staticmethod
    def _row(
        key, outcome: str, fault: Fault, report=None, incidents=None, problem=None, attempts=None,
        known_service=None, known_impact=None, before=None,
    ) -> Row:
        return Row(
            signature=key[0], outcome=outcome, report_id=report, **fault._asdict(),
            incidents=incidents, problem=problem, attempts=attempts,
            known_service=known_service, known_impact=known_impact, before=before,
        )
