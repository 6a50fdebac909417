"""Car blobs at rest: every pair within reach counts, wherever cells end, and no row is multiplied nine times."""

import math
import random

from skymill.operators.semantics import resolve_car_motion


def test_car_motion_equals_all_pairs_and_moves_few_rows(spark):
    rng = random.Random(7)
    at = lambda: (rng.choice([-64.0, -32.0, -8.0, 0.0, 8.0, 32.0, 40.0]), 0.0) if rng.random() < 0.3 else (rng.uniform(-100, 100), rng.uniform(-100, 100))
    rows = [(s, f, 1000 * f + i, *at()) for s in (1, 2) for f in (1, 2, 4) for i in range(60)] + [(1, 2, 9001, None, 0.0), (None, 2, 9002, 0.0, 0.0), (1, 2, 9003, -1e-300, 0.0), (1, 1, 9004, 8.0, 0.0)]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "session_id long, frame_seq int, component_id long, cx double, cy double")
    out = resolve_car_motion(df)
    near = lambda a, b: None not in (a[0], a[3], b[0], b[3]) and a[0] == b[0] and a[1] == b[1] + 1 and math.hypot(a[3] - b[3], a[4] - b[4]) <= 8
    want = sorted((str(a[0]), a[1], a[2], "Static car" if any(near(a, b) for b in rows) else "Moving car") for a in rows)
    assert sorted((str(r[0]), r[1], r[2], r[3]) for r in out.collect()) == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join " in line for line in plan.splitlines()) == 1  # the blobs themselves are neither multiplied nor joined again
