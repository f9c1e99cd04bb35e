"""Streams with state, restarted in the middle, against plain folds; policies against one change after another."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from modlake.operators import policy
from modlake.streaming import state

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
at = lambda s: T0 + timedelta(seconds=s)


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, state.ROCKSDB)
    yield
    spark.conf.set(key, before)


def run(df, out, cp):
    q = df.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(cp)).trigger(availableNow=True).start()
    q.awaitTermination()


def test_codes_expire_lock_and_survive_a_restart(spark, tmp_path, rocksdb):
    schema = "member string, at timestamp, seq long, kind string, digest string, ttl double"
    rng = random.Random(2)
    events = [("A@x ", at(0), 0, "issue", "d1", 100.0), ("a@X", at(1), 1, "verify", "no", None), ("a@x", at(2), 2, "verify", "d1", None), ("a@x", at(3), 3, "verify", "d1", None), ("b", at(0), 4, "issue", "d", 5.0), ("b", at(9), 5, "verify", "d", None), ("b", at(9), 6, "verify", "d", None), ("c", at(1), 7, "verify", "d", None)]
    events += [("e", at(0), 10, "issue", "d", 900.0), *(("e", at(1 + i), 11 + i, "verify", "no", None) for i in range(5))]
    for i in range(60):
        events.append((rng.choice("xyz"), at(i), 100 + i, rng.choice(["issue", "verify", "verify"]), rng.choice(["p", "q"]), float(rng.randint(3, 30))))
    events.sort(key=lambda e: e[1:3])
    codes, want = {}, []
    for member, when, seq, kind, digest, ttl in events:
        member = member.strip().lower()
        if kind == "issue":
            codes[member] = {"digest": digest, "expires": when.timestamp() + ttl, "tries": 0, "used": False}
        else:
            said, codes[member] = state.verdict(codes.get(member), when.timestamp(), digest, 3)
            want.append((seq, said))
    assert {"ok", "bad", "expired", "locked"} == {v for _, v in want}
    for k in range(3):  # each part is a run of its own from the same checkpoint
        part = events[k * len(events) // 3 : (k + 1) * len(events) // 3]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(state.one_time_codes(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), most=3, late="1 hour"), tmp_path / "out", tmp_path / "cp")
    assert sorted((r.seq, r.verdict) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(want)


def test_requests_are_completed_failed_or_lost_once(spark, tmp_path):
    ask, tell = "request_id string, ts timestamp", "request_id string, done_at timestamp, error string"
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    def step():
        states = state.request_states(spark.readStream.schema(ask).parquet(str(tmp_path / "ask")), spark.readStream.schema(tell).parquet(str(tmp_path / "tell")), "2 minutes", "1 minute")
        run(states, tmp_path / "out", tmp_path / "cp")

    write([("a", at(0)), ("b", at(1)), ("c", at(2)), ("a", at(0))], ask, "ask")
    write([("a", at(30), None), ("a", at(31), None)], tell, "tell")
    step()
    out = lambda: {r.request_id: r.status for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out() == {"a": "completed"}
    ids = spark.createDataFrame([("a",), ("b",), ("z",)], "request_id string")
    assert {r.request_id: r.status for r in state.looked_up(ids, spark.read.parquet(str(tmp_path / "out"))).collect()} == {"a": "completed", "b": "pending", "z": "pending"}
    write([("b", at(50), "boom"), ("a", at(55), None)], tell, "tell")
    step()
    for k in (600, 1200, 1800):  # time goes on
        write([(f"later{k}", at(k))], ask, "ask")
        write([(f"later{k}", at(k + 1), None)], tell, "tell")
        step()
    rows = [(r.request_id, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(rows)[:3] == [("a", "completed"), ("b", "failed"), ("c", "lost")] and len(rows) == len(set(rows))


def test_replay_backs_off_and_writes_each_letter_once(spark):
    letters = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "2")], "request_id string, payload string")
    taken, down = [], True

    def sink(df):
        if down:
            raise OSError("down")
        taken.extend(r.request_id for r in df.collect())

    got = lambda s: {r.request_id: (r.tries, r.next_at, r.status) for r in s.collect()}
    s = state.replay(spark, letters, None, sink, 1000.0)
    assert got(s) == {"a": (1, 1005.0, "open"), "b": (1, 1005.0, "open")}
    s = state.replay(spark, letters, s, sink, 1004.0)
    assert got(s) == {"a": (1, 1005.0, "open"), "b": (1, 1005.0, "open")}
    s = state.replay(spark, letters, s, sink, 1005.0)
    assert got(s)["a"] == (2, 1015.0, "open")
    down = False
    more = letters.unionByName(spark.createDataFrame([("c", "3")], "request_id string, payload string"))
    s = state.replay(spark, more, s, sink, 1010.0)
    assert taken == ["c"] and got(s)["c"][2] == "done"
    s = state.replay(spark, more, s, sink, 2000.0)
    s = state.replay(spark, more, s, sink, 3000.0)
    assert sorted(taken) == ["a", "b", "c"] and {v[2] for v in got(s).values()} == {"done"}
    down, s = True, None
    for k in range(4):
        s = state.replay(spark, letters, s, sink, 10_000.0 * (k + 1), most=3)
    assert got(s)["a"][0] == 3 and got(s)["a"][2] == "given up"


LEVELS = {"medium": (0.3, 0.7), "strict": (0.1, 0.1), "open": (0.9, 0.95)}


def plain_versions(changes):
    out = {}
    for surface in {c[0] for c in changes if c[0] and c[1]}:
        on, name, lo, hi, rows = True, None, None, None, []
        for _, when, _, enabled, level, allow, reject in sorted((c for c in changes if c[0] == surface and c[1]), key=lambda c: c[1:3]):
            on = on if enabled is None else enabled
            if level in LEVELS:
                name, (lo, hi) = level, LEVELS[level]
            if allow is not None or reject is not None:
                low, high = (LEVELS["medium"][0] if lo is None else lo), (LEVELS["medium"][1] if hi is None else hi)
                if reject is not None:
                    low = reject if low == high else min(low, reject)
                    high = reject
                lo, hi = low if allow is None else allow, high
                name = name if name and LEVELS[name] == (lo, hi) else None
            if rows and rows[-1][0] == when:
                rows.pop()
            rows.append((when, on, name, lo, hi))
        out[surface] = rows
    return out


def test_policies_by_change_and_as_of(spark):
    rng = random.Random(5)
    pick = lambda *xs: rng.choice([None, None, *xs])
    changes = [(rng.choice(["post", "job", None]), rng.choice([at(rng.randint(0, 400_000)), None, at(5000)]), i, pick(True, False), pick("medium", "strict", "open", "unknown"), pick(0.2, 0.3), pick(0.1, 0.5, 0.7)) for i in range(120)]
    df = spark.createDataFrame(changes, "surface string, at timestamp, seq int, enabled boolean, level string, allow_max double, reject_min double")
    versions = policy.policy_versions(df, LEVELS)
    want = plain_versions(changes)
    utc = lambda t: t.replace(tzinfo=timezone.utc)
    got = {}
    for r in versions.orderBy("surface", "at").collect():
        got.setdefault(r.surface, []).append((utc(r["at"]), r.enabled, r.level, r.allow_max, r.reject_min))
    assert got == want
    rows = [(i, rng.choice(["post", "job", "new", None]), rng.choice([at(rng.randint(-90_000, 600_000)), at(5000), None])) for i in range(800)]
    out = policy.as_of(spark.createDataFrame(rows, "id int, surface string, ts timestamp"), versions, seconds=20_000).collect()
    assert len(out) == len(rows)
    by_id = {r.id: r for r in out}
    for i, surface, ts in rows:
        held = [v for v in want.get(surface, []) if ts and v[0] <= ts]
        r = by_id[i]
        assert (r["at"] and utc(r["at"]), r.enabled, r.level, r.allow_max, r.reject_min) == (held[-1] if held else (None,) * 5)
    none = spark.createDataFrame([], "id int, surface string, ts timestamp")
    assert policy.as_of(none, versions).count() == 0 and policy.as_of(spark.createDataFrame(rows[:9], none.schema), versions.limit(0)).count() == 9


def test_many_changes_of_one_surface_are_not_met_row_by_row(spark):
    rng = random.Random(6)
    pick = lambda *xs: rng.choice([None, None, *xs])
    changes = [("post", at(rng.randint(0, 300_000)), i, pick(True, False), "open" if i == 700 else None, pick(0.2, 0.3), pick(0.1, 0.5, 0.7)) for i in range(1500)]
    versions = policy.policy_versions(spark.createDataFrame(changes, "surface string, at timestamp, seq int, enabled boolean, level string, allow_max double, reject_min double"), LEVELS).localCheckpoint()
    got = [(r["at"].replace(tzinfo=timezone.utc), r.enabled, r.level, r.allow_max, r.reject_min) for r in versions.orderBy("at").collect()]
    assert got == plain_versions(changes)["post"]
    rows = spark.range(3000).selectExpr("int(id) AS id", "'post' AS surface", "timestamp_seconds(id * 100) AS ts")
    out = policy.as_of(rows, versions)
    assert out.count() == 3000 and "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_a_stream_sees_a_policy_changed_between_batches(spark, tmp_path):
    schema = "id int, surface string, ts timestamp"
    table, seen = [("post", at(0), 0, None, "open", None, None)], []
    versions = lambda: policy.policy_versions(spark.createDataFrame(table, "surface string, at timestamp, seq int, enabled boolean, level string, allow_max double, reject_min double"), LEVELS)
    batch = state.with_live_policy(versions, lambda df, n: seen.extend((r.id, r.level) for r in df.collect()))
    for rows in ([(1, "post", at(10))], [(2, "post", at(20)), (3, "post", at(200))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        table.append(("post", at(100), 1, None, "strict", None, None))
    assert sorted(seen) == [(1, "open"), (2, "open"), (3, "strict")]
