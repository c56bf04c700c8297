"""Check-ins in a stream against one pass over all of them."""

import random
import datetime as dt

from stanzaline.streaming import progress as P

SCHEMA = "plan_id long, day long, at timestamp, n long"


def made(seed, plans=5, n=60):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    return [(rng.randrange(plans), rng.randrange(-1, 40), start + dt.timedelta(hours=rng.randrange(900)), i) for i in range(n)]


def batch_result(rows, days):
    out = {}
    for plan, day, at, _ in rows:
        if plan is not None and day is not None and at is not None and 1 <= day <= days:
            out.setdefault(plan, set()).add(day)
    return {p: (len(d), round(100.0 * len(d) / days, 1), max(d)) for p, d in out.items()}


def run(spark, tmp_path, **options):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    P.track(stream, P.keep(str(tmp_path / "out")), str(tmp_path / "mark"), days=30, **options).awaitTermination()
    return {r.plan_id: r for r in P.current(spark.read.parquet(str(tmp_path / "out"))).collect()}


def put(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def test_replayed_late_and_restarted(spark, tmp_path):
    rows = made(1)
    put(spark, tmp_path, rows[20:])
    got = run(spark, tmp_path)
    assert {k: (r.done, r.percent, r.last_day) for k, r in got.items()} == batch_result(rows[20:], 30)
    # the same again, older ones, and rows that are no check-ins; the stream goes on from its checkpoint
    put(spark, tmp_path, rows[30:50])
    put(spark, tmp_path, rows[:25] + [(None, 1, rows[0][2], 0), (1, None, rows[0][2], 0), (1, 31, None, 0), (1, 99, rows[0][2], 0)])
    got = run(spark, tmp_path)
    assert {k: (r.done, r.percent, r.last_day) for k, r in got.items()} == batch_result(rows, 30)
    assert not any(r.closed for r in got.values())
    batches = spark.read.parquet(str(tmp_path / "out")).select("batch").distinct().count()
    put(spark, tmp_path, rows)  # nothing new: no plan changes
    assert run(spark, tmp_path) == got and spark.read.parquet(str(tmp_path / "out")).select("batch").distinct().count() == batches


def test_plans_are_closed(spark, tmp_path):
    """When the watermark passes the end, the plans close and their state goes."""
    ends = int(dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc).timestamp() * 1000)
    rows = made(2, plans=3)
    put(spark, tmp_path, rows)
    assert not any(r.closed for r in run(spark, tmp_path, late="1 day", ends_ms=ends).values())
    put(spark, tmp_path, [(77, 1, dt.datetime(2024, 4, 1), 0)])
    put(spark, tmp_path, [(77, 2, dt.datetime(2024, 4, 2), 0)])
    got = run(spark, tmp_path, late="1 day", ends_ms=ends)
    assert {k: (r.done, r.percent, r.last_day) for k, r in got.items() if k != 77} == batch_result(rows, 30)
    assert all(r.closed for k, r in got.items() if k != 77)


def test_state_is_touched_by_days():
    """Of many check-ins of a few days the last ones alone are sent, and looked up in the state once."""
    import pandas as pd

    rng = random.Random(4)
    rows = pd.DataFrame({"plan_id": [rng.randrange(3) for _ in range(9000)], "day": [rng.randrange(1, 30) for _ in range(9000)], "at_us": [rng.randrange(500) for _ in range(9000)], "n": range(9000)})
    sent = pd.concat(P._latest(iter([rows[:4000], rows[4000:]])))
    wanted = {}
    for plan, day, at, n in rows.itertuples(index=False):
        wanted[plan, day] = max(wanted.get((plan, day), (-1, -1)), (at, n))
    assert {(r.plan_id, r.day): (r.at_us, r.n) for r in sent.itertuples()} == wanted and len(sent) == len(wanted)

    class Seen(dict):
        touched = 0

        def containsKey(self, key):
            Seen.touched += 1
            return key in self

        getValue, updateValue = dict.__getitem__, dict.__setitem__

    own = P.Progress(30)
    own.seen = Seen()
    (row,) = own.handleInputRows((1,), iter([rows[rows.plan_id == 1]]), None)
    assert row.done[0] == 29 == Seen.touched and own.seen == {(d,): at for (p, d), at in wanted.items() if p == 1}
