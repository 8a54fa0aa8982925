"""Stage timing of registered golden queries from Spark's event log.

usage: python tools/profile_query.py <sf_dir> <name> [<name> ...]

Materialises the golden record, runs each query twice (the first run warms
the JVM) and prints the second run's jobs and stages (tasks, duration,
shuffle read/write) from the event log written to a fresh scratch folder.
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys
import tempfile

import zstandard

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerframe import registry  # noqa: E402
from ledgerframe.plans import golden as G  # noqa: E402
from ledgerframe.session import build_session, checkpoint_dir  # noqa: E402


def events(folder):
    for f in glob.glob(folder + "/*/events*") + glob.glob(folder + "/*events*"):
        if os.path.isdir(f):
            continue
        raw = open(f, "rb")
        stream = zstandard.ZstdDecompressor().stream_reader(raw) if f.endswith(".zstd") else raw
        for ln in io.TextIOWrapper(stream, encoding="utf-8"):
            yield json.loads(ln)


def main():
    sf_dir, names = sys.argv[1], sys.argv[2:]
    el = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark = build_session(extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": el})
    if not checkpoint_dir(spark):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerframe-tool-"))
    g = G.materialize(G.golden_from_tables(spark, sf_dir))
    for n in names:
        for rnd in (1, 2):
            spark.sparkContext.setJobGroup(f"{n}#{rnd}", n)
            registry.GOLDEN_QUERIES[n](g).write.format("noop").mode("overwrite").save()
    spark.stop()
    stage_group, jobs = {}, {}
    stages = {}
    for e in events(el):
        ev = e["Event"]
        if ev == "SparkListenerJobStart":
            grp = e.get("Properties", {}).get("spark.jobGroup.id")
            for s in e["Stage IDs"]:
                stage_group[s] = grp
            jobs[e["Job ID"]] = (grp, e["Submission Time"])
        elif ev == "SparkListenerJobEnd":
            grp, t0 = jobs[e["Job ID"]]
            jobs[e["Job ID"]] = (grp, t0, e["Completion Time"])
        elif ev == "SparkListenerStageCompleted":
            si = e["Stage Info"]
            acc = {a["Name"]: a.get("Value") for a in si.get("Accumulables", [])}
            stages[si["Stage ID"]] = (si["Stage Name"][:40], si["Number of Tasks"],
                                      si.get("Completion Time", 0) - si.get("Submission Time", 0),
                                      acc.get("internal.metrics.shuffle.write.recordsWritten"),
                                      acc.get("internal.metrics.executorRunTime"))
    for n in names:
        grp = f"{n}#2"
        js = [(j, v) for j, v in jobs.items() if v[0] == grp and len(v) == 3]
        if js:
            span = max(v[2] for _, v in js) - min(v[1] for _, v in js)
            print(f"== {n}: {len(js)} jobs, {span} ms from first job start to last job end")
        for s, st in sorted(stages.items()):
            if stage_group.get(s) == grp:
                print(f"   stage {s:4d} tasks={st[1]:3d} {st[2]:6d} ms  shuffle_rows_out={st[3]}  run_ms={st[4]}")


if __name__ == "__main__":
    main()
