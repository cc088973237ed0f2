"""The judge of repeats sees every candidate, not only those that share words."""

import datetime as dt

from faultfold.operators import repeats

T0 = dt.datetime(2024, 5, 1, 12)
COLS = "severity string, service_name string, operational_summary string, root_cause string, business_impact string"


def test_judge_sees_all_candidates(spark):
    at = lambda minutes: T0 + dt.timedelta(minutes=minutes)
    same = lambda name, text, when: (name, "ERROR", None, text, "cause", "HIGH", at(when))
    old = [same(f"r{i:02d}", f"report {i}", -i) for i in range(1, 24)]
    old += [same("late", "disk full", 1), same("old", "disk full", -121), ("other", "ERROR", "api", "disk full", "c", "HIGH", at(-5))]
    new = [same("i0", "no space left on device", 0), same("bad", "fails", 0), same("lone", "x", -500), ("none", "", None, "x", "c", "LOW", at(0))]
    new.append(same("twice", "again", 0))
    seen = repeats.candidate_ranges

    def judge(incident, candidates):
        ids = [c["id"] for c in candidates]
        assert len(ids) <= 7
        if incident["operational_summary"] == "fails":
            raise ValueError("no answer")
        if incident["operational_summary"] == "again":
            return {"is_repetitive": True, "matching_report_id": ids[0] if "r20" not in ids else "invented", "reason": ids[0]}
        return {"is_repetitive": "r17" in ids, "matching_report_id": "r17" if "r17" in ids else None, "reason": ",".join(ids)}

    incidents = spark.createDataFrame(new, f"incident_id string, {COLS}, as_of timestamp")
    reports = spark.createDataFrame(old, f"id string, {COLS}, created_at timestamp")
    assert {r["incident_id"]: r["n_candidates"] for r in seen(incidents, reports).collect()}["i0"] == 23
    judged = repeats.judged_repeats(incidents, reports, judge, block=7)
    found = {r["incident_id"]: r for r in judged.collect()}
    assert set(found) == {"i0", "bad", "twice"}
    # "r17" shares no summary word with the incident, so the word scores never pair them.
    assert (found["i0"]["report_id"], found["i0"]["score"]) == ("r17", 1.0) and "r17" in found["i0"]["reason"]
    assert found["bad"]["report_id"] is None and found["bad"]["error"] == "ValueError: no answer"
    assert found["twice"]["report_id"] < "r08" and found["twice"]["error"] is None
    decided = {r["incident_id"]: r["action"] for r in repeats.repeat_decisions(incidents, judged.where("report_id is not null")).collect()}
    assert decided == {"i0": "increment", "twice": "increment", "bad": "insert", "lone": "insert", "none": "insert"}


def test_all_candidates_reach_the_judge(spark):
    rows = [(f"r{i:03d}", "ERROR", "api", f"s{i}", "c", "HIGH", T0 - dt.timedelta(seconds=i)) for i in range(1, 131)]
    reports = spark.createDataFrame(rows, f"id string, {COLS}, created_at timestamp")
    incidents = spark.createDataFrame([("i", "ERROR", "api", "zz", "c", "HIGH", T0)], f"incident_id string, {COLS}, as_of timestamp")
    for i in (1, 50, 51, 99, 130):
        want = f"r{i:03d}"
        pick = lambda _, cs, want=want: {"is_repetitive": any(c["id"] == want for c in cs), "matching_report_id": want, "reason": "x"}
        assert repeats.judged_repeats(incidents, reports, pick).first()["report_id"] == want
