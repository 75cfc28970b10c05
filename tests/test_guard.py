"""The error guard equals a walk over all rows, for keys that break early, late, never, or have no name."""

import random

from tracegauge.operators.runs import error_rate_guard


def walk(rows, max_rate=0.05, least=20):
    out = {}
    for key in {r[0] for r in rows}:
        seen = failed = 0
        own = sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
        for i, (_, arrival, error) in enumerate(own):
            seen, failed = seen + 1, failed + (error is not None)
            last = i + 1 == len(own) or own[i + 1][1] != arrival
            if last and seen >= least and failed / seen > max_rate:
                out[key] = (seen, failed)
                break
    return out


def test_guard_equals_a_walk(spark):
    r = random.Random(4)
    rows = []
    for number in range(40):
        rate = (0, 0.02, 0.05, 0.06, 0.3)[number % 5]
        wide = (1 << 12, 1 << 24, 1 << 44)[number % 3]  # rows of one finest cell, of some, of many coarse ones
        for k in range(r.choice((5, 19, 20, 21, 400))):
            rows.append((None if number == 4 else f"run_{number}", r.randrange(wide), "boom" if r.random() < rate else None))
    rows += [("late", k << 30, "boom" if k >= 3000 else None) for k in range(3200)]
    rows += [("edge", k, "boom" if k in (3, 11) else None) for k in range(45)]
    rows += [("unnamed" if k % 2 else None, k << 41, "boom" if k > 60 else None) for k in range(90)]
    table = spark.createDataFrame(rows, "run_id string, arrival bigint, error string").repartition(5)
    got = {x.run_id: (x.seen, x.failed) for x in error_rate_guard(table, ["run_id"]).collect()}
    assert got == walk(rows) and None in got and "late" in got and got["edge"] == (20, 2)
