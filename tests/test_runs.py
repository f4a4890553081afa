"""Runs that fail, come twice or start again: isolated errors, parts of a state, first statuses over restarts."""

import collections
import os
import random

from bazaarlake.operators.stored_state import KeyedState
from bazaarlake.streaming import ingest

SCHEMA = "k int, v string, at int"


def files(folder):
    return {os.path.relpath(os.path.join(at, f), folder): os.stat(os.path.join(at, f)).st_mtime_ns for at, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_an_upsert_leaves_other_parts_alone(spark, tmp_path):
    state = KeyedState(str(tmp_path / "s"), "k", "at", SCHEMA, parts=8)
    state.merge(spark.createDataFrame([(k, "a", 1) for k in range(200)] + [(None, "n", 1)], SCHEMA))
    before = files(tmp_path / "s")
    new = spark.createDataFrame([(3, "b", 2), (3, "c", 3), (777, "d", 1), (5, "old", 0), (None, "m", 1), (None, "m", 1)], SCHEMA)
    touched = state.merge(new, 1)
    after = files(tmp_path / "s")
    assert 1 <= len(touched) <= 3
    untouched = {f: t for f, t in before.items() if f.startswith("keyed") and not any(f.startswith(f"keyed/part={p}/") for p in touched)}
    assert len(untouched) >= 5 and untouched.items() <= after.items()
    want = sorted([(k, "a", 1) for k in range(200) if k != 3] + [(3, "c", 3), (777, "d", 1), (None, "n", 1), (None, "m", 1), (None, "m", 1)], key=repr)
    for _ in range(2):
        assert sorted(map(tuple, state.read(spark).collect()), key=repr) == want
        state.merge(new, 1)  # the same batch again


def test_state_keeps_columns_of_the_old_row(spark, tmp_path):
    state = KeyedState(str(tmp_path / "s"), "k", "at", SCHEMA, parts=2, keep_old=("v",))
    state.merge(spark.createDataFrame([(1, "a", 1)], SCHEMA))
    state.merge(spark.createDataFrame([(1, "b", 2), (2, "c", 2)], SCHEMA), 1)
    assert sorted(map(tuple, state.read(spark).collect())) == [(1, "a", 2), (2, "c", 2)]


def test_a_poisoned_row_fails_alone(spark, tmp_path):
    def work(row):
        if row["v"] == "skip":
            return None
        return {"n": int(row["v"]), "label": f"{row['k']}:{row['v']}"}

    rows = spark.createDataFrame([(1, "10", 1), (2, "x1", 1), (3, "-5", 1), (4, None, 1), (5, "7", 1), (6, "skip", 1), (5, "8", 2)], SCHEMA)
    made = ingest.guarded(rows.coalesce(1), work, "n int, label string")
    out = made.selectExpr("*", "case when n < 0 or n is null then 'no number' end as reason")
    state = KeyedState(str(tmp_path / "state"), "k", "at", "k int, n int, at int", parts=4)
    seen = []
    for _ in range(2):
        ingest.file_outcomes(out, str(tmp_path / "out"), 7, state)
        found = ingest.filed(spark, str(tmp_path / "out"))
        seen.append((sorted((r["k"], r["status"], r["n"], r["batch"], (r["error"] or "")[:9]) for r in found.collect()), sorted(map(tuple, state.read(spark).collect()))))
    assert seen[0] == seen[1]
    assert seen[0][0] == [(1, "saved", 10, 7, ""), (2, "failed", None, 7, "ValueErro"), (3, "filtered", -5, 7, ""), (4, "failed", None, 7, "TypeError"), (5, "saved", 7, 7, ""), (5, "saved", 8, 7, ""), (6, "filtered", None, 7, "")]
    assert seen[0][1] == [(1, 10, 1), (5, 8, 2)]


def test_first_statuses_over_restarts(spark, tmp_path):
    """After each of four runs the counters equal those of a batch query over all that has landed."""
    rng, at, landed = random.Random(5), 0, []
    schema = "url string, status string, at long"
    for run in range(4):
        rows = []
        for _ in range(40):
            at += 1
            rows.append((f"u{rng.randrange(60)}" if rng.random() > 0.05 else None, rng.choice(["saved", "failed", "filtered"]), at))
        landed += rows
        shuffled = rng.sample(rows, len(rows))
        spark.createDataFrame(shuffled, schema).coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))
        got = ingest.count_first_statuses(spark, str(tmp_path / "in"), schema, str(tmp_path / "first"), str(tmp_path / "mark"))
        first = {}
        for url, status, _ in landed:
            if url:
                first.setdefault(url, status)
        assert {r["status"]: r["n"] for r in got.collect()} == dict(collections.Counter(first.values())), run
    again = ingest.count_first_statuses(spark, str(tmp_path / "in"), schema, str(tmp_path / "first"), str(tmp_path / "mark"))
    assert sum(r["n"] for r in again.collect()) == len(first)


def test_ingest_into_parts(spark, tmp_path):
    state = KeyedState(str(tmp_path / "s"), "k", "at", SCHEMA, parts=4)
    for rows in ([(1, "a", 1), (2, "b", 1), (1, "c", 2)], [(2, "d", 3), (3, "e", 3), (1, "late", 1)], []):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.ingest_keyed(spark, str(tmp_path / "in"), SCHEMA, state, str(tmp_path / "mark"))
    assert sorted(map(tuple, state.read(spark).collect())) == [(1, "c", 2), (2, "d", 3), (3, "e", 3)]
