import random

from sentrylake.operators import correlate


def test_sweeps_equal_a_plain_count_and_hold_no_minute_of_rows(spark):
    r = random.Random(7)
    rows = [(f"10.0.0.{r.randrange(4)}", 1000 * (i // 3) + r.choice((0, 1)), r.randrange(r.choice((4, 9))), i) for i in range(600)]
    rows = [(ip, t, p, n, n) for n, (ip, t, p, _) in enumerate(sorted(rows, key=lambda x: (x[1], x[3])))]
    made = spark.createDataFrame(rows, "src_ip string, time long, dst_port int, pos long, event_id long")
    for span, least in ((60_000, 6), (5_000, 3), (1_000, 2), (1, 2), (60_000, 9)):
        want = {}
        for ip, t, _, pos, _ in rows:
            ports = {p for i, at, p, n, _ in rows if i == ip and t - span <= at <= t and n <= pos}
            if len(ports) >= least:
                want.setdefault(ip, (pos, len(ports)))
        got = correlate.port_sweeps(made, span, least)
        assert {x.src_ip: (x.event_id, x.ports) for x in got.collect()} == want
        assert "collect_list" not in got._jdf.queryExecution().toString()
