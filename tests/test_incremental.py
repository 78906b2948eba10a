import random

import pytest
from pyspark.sql import functions as F

from timberline.operators import incremental as I

MEMBERS = ("dataset string, incident_id string, number long, id long, timestamp string, timestamp_epoch double, "
           "template_id string, wide array<string>")


def table(spark, incidents):
    """``(number, [(epoch, template, keys)])`` per incident as a member table."""
    rows = [("d", f"INC-{n}", n, 1000 * n + k, f"t{e}", float(e), t, keys) for n, logs in incidents for k, (e, t, keys) in enumerate(logs)]
    return spark.createDataFrame(rows, MEMBERS)


def one_by_one(existing, candidates, slack=60, gap=300):
    """Each candidate in order against the reports as they are by then."""

    def shape(logs):
        return [min(e for e, _, _ in logs), max(e for e, _, _ in logs), {t for _, t, _ in logs}, {k for _, _, ks in logs for k in ks}]

    reports = {n: shape(logs) for n, logs in existing}
    free, out = max(reports, default=100) + 1, {}
    for n, logs in candidates:
        s, e, ts, ks = shape(logs)
        for number, r in sorted(reports.items()):
            near = [s <= r[1] + reach and r[0] <= e + reach for reach in (gap, slack)]
            if (ts & r[2] and near[0]) or (ks & r[3] and near[1]):
                r[1], r[2], r[3] = e, r[2] | ts, r[3] | ks
                out[n] = (number, number)
                break
        else:
            reports[free] = [s, e, ts, ks]
            out[n] = (None, free)
            free += 1
    return out


def matched(spark, existing, candidates, **more):
    got = I.match_incidents(table(spark, existing), table(spark, candidates), **more).collect()
    return {r.candidate_number: (r.match, r.number_after) for r in got}


def test_candidates_see_what_earlier_ones_left(spark):
    existing = [(101, [(0, "a", ["k1"])])]
    # 1 joins by its template and brings key k2; 2 joins by k2 and moves the end; 3 is near that end only; 4 founds, 5 joins 4.
    candidates = [(1, [(200, "a", ["k2"])]), (2, [(250, "b", ["k2"]), (560, "b", [])]), (3, [(840, "a", [])]),
                  (4, [(5000, "c", ["k9"])]), (5, [(5050, "z", ["k9"])])]
    want = {1: (101, 101), 2: (101, 101), 3: (101, 101), 4: (None, 102), 5: (102, 102)}
    assert one_by_one(existing, candidates) == want
    assert matched(spark, existing, candidates) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_rounds_equal_one_pass_in_order(spark, seed):
    rng = random.Random(seed)

    def incidents(first, n, most):
        return [(first + k, [(rng.randrange(most), rng.choice("abcdefgh"), rng.sample(["k1", "k2", "k3", "k4", "k5"], rng.randrange(2)))
                             for _ in range(rng.randint(1, 2))]) for k in range(n)]

    existing, candidates = incidents(101, 4, 4000), incidents(1, 30, 9000)
    assert matched(spark, existing, candidates, width=8) == one_by_one(existing, candidates)


def test_windows_carry_what_earlier_ones_left(spark):
    rng = random.Random(5)

    def incidents(first, n, most):
        return [(first + k, [(rng.randrange(most), rng.choice("abcdefgh"), rng.sample(["k1", "k2", "k3", "k4", "k5"], rng.randrange(3)))
                             for _ in range(rng.randint(1, 3))]) for k in range(n)]

    existing, candidates = incidents(101, 6, 20000), incidents(1, 30, 40000)
    want = one_by_one(existing, candidates)
    assert len({match for match, _ in want.values()}) > 3
    assert matched(spark, existing, candidates, window=8) == matched(spark, existing, candidates) == want


def test_chains_of_candidates_cost_no_rounds(spark, monkeypatch):
    """Each candidate fits only what the one before left; a report as long as the table is still one row per key."""
    written, cut = [], I.cut

    def counted(df, label="stage"):
        out = cut(df, label)
        written.append(out.count())
        return out

    monkeypatch.setattr(I, "cut", counted)
    existing = [(101, [(0, "a", ["k0"]), (2_600_000, "a", [f"k{k}" for k in range(9)])])]
    chain = [(k, [(10_000_000 + 50 * k, f"t{k}", [f"c{k}", f"c{k + 1}"])]) for k in range(1, 15)]
    assert matched(spark, existing, chain) == one_by_one(existing, chain)
    assert len(written) <= 6 and max(written) < 60


def test_without_reports_and_without_candidates(spark):
    candidates = [(1, [(0, "a", [])]), (2, [(100, "a", [])])]
    assert matched(spark, [], candidates) == {1: (None, 101), 2: (101, 101)}
    assert matched(spark, candidates, []) == {}
    merged = I.merge_incidents(table(spark, [(101, [(0, "a", [])])]), table(spark, candidates))
    assert {(r.incident_id, r.generation) for r in merged.collect()} == {("INC-101", 0), ("INC-101", 1)}
    report = I.carried_reports(merged).select("event_count", "n_added", "start_time", "end_time").first()
    assert tuple(report) == (3, 2, "t0", "t100")


def test_last_value_before_crosses_blocks(spark):
    from timberline.operators.ordering import with_last

    rng = random.Random(4)
    rows = [(k, o, rng.choice([None, o])) for k in "ab" for o in sorted(rng.sample(range(200), 40))]
    got = with_last(spark.createDataFrame(rows, "k string, o long, v long"), ["k"], "o", "v", "p", width=16)
    for row in got.collect():
        before = [v for k, o, v in rows if k == row.k and o < row.o and v is not None]
        assert row.p == (before[-1] if before else None)
    assert got.filter(F.col("p").isNull()).count() >= 2
