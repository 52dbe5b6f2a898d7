"""Hand-written reports for tests."""

import datetime as dt

SF = "/root/testdata/sf0.001"


def step(name, site=None, errors=(), output=(), cpu=None, storage=None):
    performance = None
    if cpu is not None or storage is not None:
        performance = {"cpu": cpu or {}, "storage": storage or {}, "memory": {}}
    return {
        "name": name, "site": site, "errors": [{"exitCode": c} for c in errors],
        "output": [dict(o) for o in output], "performance": performance,
    }


def report(rid, *steps, task="/wf/a/T", ts="2017-01-31 13:20:00", lfns=(), jobtype="Processing", state="success", **meta):
    when = dt.datetime.fromisoformat(ts).replace(tzinfo=dt.timezone.utc)
    return {
        "report_id": rid, "ingest_ts": 1.0, "stage": "hot", "kind": "fwjr", "task": task, "campaign": None, "prep_id": None,
        "meta": {"jobtype": jobtype, "jobstate": state, "host": "h", "ts": int(when.timestamp()), **meta},
        "lfns": list(lfns), "steps": list(steps), "year": when.year, "month": when.month, "day": when.day,
    }
