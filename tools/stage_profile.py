"""Per-stage task counts and times from a Spark event log (no UI, no server).

Run a job with ``spark.eventLog.enabled=true`` and ``spark.eventLog.dir=<scratch folder>``, then:

    python tools/stage_profile.py <scratch folder> [min_stage_ms]

A stage whose task count is 1 while its task time is large is work that adaptive execution
packed into one task (see README, "Partitions sized by the data").
"""

from __future__ import annotations

import collections
import glob
import io
import json
import os
import sys


def _lines(path: str):
    if path.endswith(".zstd"):
        import zstandard

        with open(path, "rb") as fh:
            yield from io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(fh), encoding="utf-8")
    else:
        with open(path, encoding="utf-8") as fh:
            yield from fh


def main() -> None:
    root = sys.argv[1]
    min_ms = int(sys.argv[2]) if len(sys.argv) > 2 else 500
    files = [f for f in glob.glob(os.path.join(root, "**", "*"), recursive=True)
             if os.path.isfile(f) and not os.path.basename(f).startswith("appstatus")]
    stages: dict[int, tuple[int, int, int]] = {}
    tasks: dict[int, list[int]] = collections.defaultdict(list)
    for f in files:
        for line in _lines(f):
            d = json.loads(line)
            ev = d.get("Event")
            if ev == "SparkListenerStageCompleted":
                si = d["Stage Info"]
                stages[si["Stage ID"]] = (si["Number of Tasks"], si.get("Submission Time", 0),
                                          si.get("Completion Time", 0) - si.get("Submission Time", 0))
            elif ev == "SparkListenerTaskEnd":
                ti = d["Task Info"]
                tasks[d["Stage ID"]].append(ti["Finish Time"] - ti["Launch Time"])
    if not stages:
        print("no completed stages found")
        return
    t0 = min(s[1] for s in stages.values())
    print("stage  start_s  tasks  stage_ms  max_task_ms  sum_task_ms")
    for sid, (n, sub, dur) in sorted(stages.items()):
        t = tasks[sid]
        if dur >= min_ms:
            print(f"{sid:5d}  {(sub - t0) / 1000:7.1f}  {n:5d}  {dur:8d}  {max(t) if t else 0:11d}  {sum(t):11d}")


if __name__ == "__main__":
    main()
