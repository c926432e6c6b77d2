import pytest

from sentrylake.streaming import delivery
from sentrylake.streaming.dead_letters import LEASE, DeadLetters


class Crash(BaseException):
    """The process is gone: nothing catches it."""


def entries(spark, ids, kind="undeliverable", parts=2):
    return spark.createDataFrame([(i, kind, "down", 6, 1000 + i) for i in ids], "event_id long, kind string, reason string, attempts int, at long").repartition(parts)


def store(spark, tmp_path, **more):
    return DeadLetters(spark, f"file://{tmp_path}/dead", wave=4, **more)


class Destination:
    """Takes a wave once; refuses the events in ``refuses``."""

    def __init__(self, refuses=()):
        self.got, self.waves, self.refuses = [], {}, set(refuses)

    def __call__(self, rows, wave):
        ids = sorted(r.event_id for r in rows.collect())
        if wave in self.waves:
            assert self.waves[wave] == ids  # a wave that comes again is the same wave
        else:
            self.waves[wave] = ids
            self.got += [i for i in ids if i not in self.refuses]
        bad = [(i, "bad field") for i in ids if i in self.refuses]
        return rows.sparkSession.createDataFrame(bad, "event_id long, reason string") if bad else None


def waiting(s):
    rows = s.entries()
    return sorted((r.event_id, r.kind) for r in rows.collect()) if rows is not None else []


def test_replay_delivers_parks_and_forgets(spark, tmp_path):
    s, to = store(spark, tmp_path), Destination(refuses=[3])
    assert s.append(entries(spark, range(10)), "batch-1") and s.append(entries(spark, [20, 21], "rejected"), "batch-2")
    assert not s.append(entries(spark, range(10)), "batch-1")
    summary = {r.kind: (r.waiting, r.oldest, r.newest, r.reason) for r in s.summary().collect()}
    assert summary == {"undeliverable": (10, 1000, 1009, "down"), "rejected": (2, 1020, 1021, "down")}
    said = s.replay(to, "event_id")
    assert said == {"state": "done", "delivered": 9, "refused": 1, "skipped": 2, "error": None}
    assert sorted(to.got) == [0, 1, 2, 4, 5, 6, 7, 8, 9] and all(len(w) <= 4 for w in to.waves.values())
    assert waiting(s) == [(3, "rejected"), (20, "rejected"), (21, "rejected")]
    assert not s.append(entries(spark, range(10)), "batch-1")  # known also when all of it is settled
    again = s.entries().filter("event_id = 3").first()
    assert (again.reason, again.attempts) == ("bad field", 7)
    assert s.replay(Destination(), "event_id", kinds=("rejected",))["delivered"] == 3 and waiting(s) == []


def test_a_destination_that_is_down_keeps_the_wave(spark, tmp_path):
    s = store(spark, tmp_path)
    s.append(entries(spark, range(10)), "b")
    to, calls = Destination(), []

    def fails_at_second(rows, wave):
        calls.append(wave)
        if len(calls) == 2:
            raise OSError("refused")
        return to(rows, wave)

    said = s.replay(fails_at_second, "event_id")
    assert said["state"] == "stopped" and said["error"] == "OSError: refused" and len(waiting(s)) == 10 - said["delivered"]
    s.append(entries(spark, [50]), "later")  # while one is claimed
    assert s.replay(to, "event_id")["state"] == "done" and sorted(to.got) == [*range(10), 50]
    s.append(entries(spark, range(100, 110)), "c")
    assert s.replay(to, "event_id", limit=4)["state"] == "limit reached" and 6 == len(waiting(s))
    assert s.replay(to, "event_id", stop=lambda: True)["state"] == "stopped"
    assert s.replay(to, "event_id")["delivered"] == 6


@pytest.mark.parametrize("step", ["_rename", "send", "append", "_touch", "_finish"])
@pytest.mark.parametrize("after", [False, True])
def test_a_crash_at_any_step_loses_and_doubles_nothing(spark, tmp_path, step, after):
    now = [1_000_000.0]
    s, to = store(spark, tmp_path, clock=lambda: now[0]), Destination(refuses=[3, 7])
    s.append(entries(spark, range(10)), "b")
    s.append(entries(spark, [30], "rejected"), "c")

    def dying(f):
        left = [1]

        def run(*a, **k):
            out = f(*a, **k) if after else None
            left[0] -= 1
            if left[0] == 0:
                raise Crash
            return out if after else f(*a, **k)

        return run

    first = store(spark, tmp_path, clock=lambda: now[0])
    if step != "send":
        setattr(first, step, dying(getattr(first, step)))
    with pytest.raises(Crash):
        first.replay(dying(to) if step == "send" else to, "event_id")
    now[0] += LEASE + 1
    s.replay(to, "event_id")
    assert sorted(to.got) == [0, 1, 2, 4, 5, 6, 8, 9]
    assert waiting(s) == [(3, "rejected"), (7, "rejected"), (30, "rejected")]


def test_one_replay_at_a_time(spark, tmp_path):
    now = [2_000_000.0]
    s = store(spark, tmp_path, clock=lambda: now[0])
    s.append(entries(spark, [1]), "b")
    assert s._lease()
    assert s.replay(Destination(), "event_id")["state"] == "busy"
    now[0] += LEASE + 1
    assert s.replay(Destination(), "event_id")["delivered"] == 1


def test_an_output_that_refuses_some_events(spark):
    batch = spark.createDataFrame([(1,), (2,), (3,)], "event_id long")
    dead = []
    refused = spark.createDataFrame([(2, "mapping"), (2, "mapping")], "event_id long, reason string")
    assert delivery.deliver(batch, 4, lambda b, i: refused, dead.append) == "partly_delivered"
    assert [(r.event_id, r.kind, r.reason, r.batch_id) for r in dead[0].collect()] == [(2, "rejected", "mapping", 4)]
    assert delivery.deliver(batch, 5, lambda b, i: None, dead.append) == "delivered" and len(dead) == 1


def test_waves_are_sent_together_and_each_is_one_file(spark, tmp_path):
    import glob
    import threading

    s, to, met = store(spark, tmp_path), Destination(refuses=[3, 9]), threading.Barrier(2, timeout=60)
    s.append(entries(spark, range(16), parts=4), "b")
    assert len(glob.glob(f"{tmp_path}/dead/waiting/b/wave=*/*.parquet")) == len(s._waves("waiting", "b")) == 4

    def send(rows, wave):
        met.wait()  # only if two are under way
        return to(rows, wave)

    assert s.replay(send, "event_id", at_once=2) == {"state": "done", "delivered": 14, "refused": 2, "skipped": 0, "error": None}
    assert sorted(to.got) == [i for i in range(16) if i not in (3, 9)] and waiting(s) == [(3, "rejected"), (9, "rejected")]


def test_waves_under_way_end_when_one_fails_or_the_process_is_gone(spark, tmp_path):
    now = [3_000_000.0]
    s, to = store(spark, tmp_path, clock=lambda: now[0]), Destination(refuses=[3])
    s.append(entries(spark, range(40), parts=1), "b")

    def fails(rows, wave):
        if wave == "b-2":
            raise OSError("refused")
        return to(rows, wave)

    said = s.replay(fails, "event_id", at_once=3)
    assert (said["state"], said["error"]) == ("stopped", "OSError: refused") and len(waiting(s)) == 40 - said["delivered"]

    def dies(rows, wave):
        to(rows, wave)
        raise Crash

    with pytest.raises(Crash):
        s.replay(dies, "event_id", at_once=3)
    now[0] += LEASE + 1
    assert s.replay(to, "event_id", at_once=3)["state"] == "done"
    assert sorted(to.got) == [i for i in range(40) if i != 3] and waiting(s) == [(3, "rejected")]
