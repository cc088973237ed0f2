"""The state of a signature, with a clock in the hands of the test."""

import json

import pytest

from faultfold.plans.hooks import incident
from faultfold.streaming import state
from faultfold.streaming.state import Fault, SignatureState, wait_seconds

GOOD = json.dumps({"incidents": [incident({"severity": "ERROR", "log_message": "boom"})]})


class Value:
    def __init__(self, clock, ttl):
        self.clock, self.ttl, self.value, self.at = clock, ttl, None, 0

    def exists(self):
        return self.value is not None and (self.ttl is None or self.clock.now < self.at + self.ttl)

    def get(self):
        return self.value if self.exists() else None

    def update(self, value):
        self.value, self.at = value, self.clock.now

    def clear(self):
        self.value = None


class Clock:
    """Stands for the handle and the timer values of one key."""

    def __init__(self, processor):
        self.now, self.timers, self.values, self.processor = 0, [], {}, processor
        processor.init(self)

    def getValueState(self, name, schema, ttl=None):
        return self.values.setdefault(name, Value(self, ttl))

    def registerTimer(self, at):
        self.timers.append(at)

    def getCurrentProcessingTimeInMs(self):
        return self.now

    def send(self, *faults):
        return list(self.processor.handleInputRows(("sig",), iter([f._asdict() for f in faults]), self))

    def run_until(self, seconds):
        out = []
        while self.timers and min(self.timers) <= 1000 * seconds:
            at = min(self.timers)
            self.timers.remove(at)
            self.now = max(self.now, at)
            out += [(self.now / 1000, r) for r in self.processor.handleExpiredTimer(("sig",), self, None)]
        self.now = 1000 * seconds
        return out


def fault(seq, count=1, first=0, last=0, **changes):
    made = Fault("ERROR", "api", "boom", 50, count, first, last, f"i{seq}", f"i{seq}", seq, seq)
    return made._replace(**changes)


def failing(entries, instruction):
    raise RuntimeError("model is down")


def test_waits_double_up_to_the_longest():
    assert [wait_seconds(n) for n in range(1, 10)] == [10, 20, 40, 80, 160, 320, 600, 600, 600]
    assert wait_seconds(5000) == 600


def test_attempts_without_new_data():
    clock = Clock(SignatureState(failing, max_attempts=10))
    first = clock.send(fault(1))
    assert [(r.outcome, r.attempts) for r in first] == [("waiting", 1)]
    later = clock.run_until(10_000)
    assert [at for at, _ in later] == [10, 30, 70, 150, 310, 630, 1230, 1830, 2430]
    assert [r.outcome for _, r in later] == ["waiting"] * 8 + ["dead"]
    assert later[-1][1].attempts == 10 and later[-1][1].problem == "RuntimeError: model is down"
    # It was given up; the next entry is analysed anew.
    assert clock.send(fault(2))[0].attempts == 1


def test_fifth_failure_is_a_dead_letter():
    clock = Clock(SignatureState(failing))
    clock.send(fault(1))
    assert [r.outcome for _, r in clock.run_until(200)] == ["waiting"] * 3 + ["dead"]


def test_retention_ends_the_waiting():
    clock = Clock(SignatureState(failing, max_attempts=1000))
    clock.send(fault(1))
    out = clock.run_until(200_000)
    assert out[-1][1].outcome == "dead" and 85_000 < out[-1][0] <= 86_400


def test_entries_wait_together_and_are_counted_once():
    answers = iter([RuntimeError("down"), "not json", GOOD])

    def call(entries, instruction):
        assert instruction == "be brief" and entries[0]["signature"] == "sig"
        answer = next(answers)
        if isinstance(answer, Exception):
            raise answer
        return answer

    clock = Clock(SignatureState(call, "be brief"))
    clock.send(fault(1, 2, 500, 900))
    assert clock.send(fault(2, 3, 100, 700)) == []
    # A batch that is delivered again is known by its number.
    assert clock.send(fault(2, 3, 100, 700)) == []
    clock.run_until(12)
    assert clock.send(fault(3, 5, 800, 5000), fault(4, 1, 900, 950)) == []
    (_, made), = clock.run_until(60)
    assert made.outcome == "reported" and made.incident_count == 11
    assert (made.first_us, made.first_insert_id, made.last_us, made.last_insert_id) == (100, "i2", 5000, "i3")
    assert (made.first_seq, made.last_seq) == (1, 4)
    follows = clock.send(fault(5, 7), fault(4, 1))
    assert [(r.outcome, r.incident_count, r.report_id) for r in follows] == [("follows", 7, made.report_id)]
    assert clock.send(fault(5, 7)) == []


@pytest.mark.parametrize("answer", ["no json", "[]", '{"incidents": "disk is full"}', '{"incidents": [{"summary": "x"}]}', '{"incidents": null}', json.dumps({"incidents": [{"operational_summary": {"a": 1}}]})])
def test_malformed_answers_wait_and_are_never_silence(answer):
    clock = Clock(SignatureState(lambda e, i: answer, max_attempts=2))
    assert [r.outcome for r in clock.send(fault(1))] == ["waiting"]
    (_, dead), = clock.run_until(60)
    assert dead.outcome == "dead" and dead.problem.startswith("MalformedAnswer: ")


def test_nothing_releases_the_signature():
    answers = iter(['{"incidents": []}', GOOD])
    clock = Clock(SignatureState(lambda e, i: next(answers)))
    assert [r.outcome for r in clock.send(fault(1))] == ["nothing"]
    assert [r.outcome for r in clock.send(fault(2))] == ["reported"]


def test_large_entries_are_rejected():
    clock = Clock(SignatureState(failing, max_bytes=49))
    assert [r.outcome for r in clock.send(fault(1))] == ["rejected"]
    assert clock.timers == []


def test_reports_expire_on_request():
    clock = Clock(SignatureState(expire_after=100))
    first, = clock.send(fault(1))
    clock.run_until(90)
    assert clock.send(fault(2))[0].outcome == "follows"
    # Counted from the last entry.
    clock.run_until(185)
    assert clock.send(fault(3))[0].report_id == first.report_id
    clock.run_until(300)
    second, = clock.send(fault(4))
    assert second.outcome == "reported" and second.report_id != first.report_id
    forever = Clock(SignatureState())
    forever.send(fault(1))
    forever.run_until(10**9)
    assert forever.send(fault(2))[0].outcome == "follows"


def test_counts_are_carried():
    clock = Clock(SignatureState(lambda e, i: "not json", carry=True))
    assert [(r.outcome, r.before) for r in clock.send(fault(1, 4))] == [("carry", 0), ("waiting", None)]
    assert [(r.first_seq, r.before) for r in clock.send(fault(3, 5), fault(2, 1), fault(1, 4))] == [(2, 4), (3, 5)]
    assert [(r.outcome, r.before) for r in clock.send(fault(4, 1))] == [("carry", 10)]


def test_faults_merge_in_any_order():
    some = [fault(i, i, f, last) for i, f, last in ((1, 5, 9), (2, 3, 12), (3, 3, 12), (4, None, None))]
    merged = set()
    for a in some:
        for b in some:
            if a is not b:
                assert a.with_(b)[4:9] == b.with_(a)[4:9]
    for order in ((0, 1, 2, 3), (3, 2, 1, 0), (2, 0, 3, 1)):
        total = some[order[0]]
        for k in order[1:]:
            total = total.with_(some[k])
        merged.add(total[4:])
    assert merged == {(10, 3, 12, "i2", "i3", 1, 4)}
    assert state.REPORTED != state.FOLLOWS
