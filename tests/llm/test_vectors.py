"""Near-duplicate vectors against brute force."""

import numpy as np
from pyspark.sql import types as T

from concordat.llm import quantised

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
                       *(T.StructField(c, T.StringType()) for c in ("vec", "key", "code", "n", "component", "raw", "tile"))])


def brute(rows, threshold=0.98):
    """``(id, links, component, kept)`` of each row."""
    unit = []
    for _, v, label in rows:
        v = None if v is None or label is None or None in v else np.array(v, np.float32).astype(float)
        good = v is not None and len(v) and np.isfinite(v).all() and v.any()
        unit.append(v / np.linalg.norm(v) if good else None)
    near = [[j for j in range(len(rows)) if j != i and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2]
             and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(len(rows))]
    out = []
    for i, (id_, _, _) in enumerate(rows):
        reach, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in reach:
                    reach.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in reach if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((id_, len(near[i]), least, id_ == least))
    return sorted(out, key=str)


def around(rng, centre, cos):
    side = rng.normal(size=len(centre))
    side -= side @ centre / (centre @ centre) * centre
    side *= np.linalg.norm(centre) / np.linalg.norm(side)
    return (cos * centre + np.sqrt(1 - cos * cos) * side) * rng.uniform(0.1, 10)


def vectors(seed, dim=64, n=300):
    rng = np.random.default_rng(seed)
    rows, base = [], rng.normal(size=(n, dim))
    for v in base:
        rows.append(v)
        for _ in range(rng.integers(0, 3)):
            rows.append(around(rng, v, rng.uniform(0.975, 1.0)))
    rows += [around(rng, base[0], rng.uniform(0.985, 0.995)) for _ in range(150)]  # one dense group
    rows += [base[1]] * 40  # copies
    return [(i, v.astype(np.float32).tolist(), int(rng.integers(0, 3)) if i < n else int(i % 2)) for i, v in enumerate(rows)]


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, *"abcdefg") for r in rows], SCHEMA).repartition(5)
    return sorted((tuple(r) for r in quantised.near_vectors(df, **options).collect()), key=str)


def test_brute_force(spark):
    rows = vectors(1)
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, tile=7) == brute(rows)


def test_odd_rows(spark):
    v, w = [1.0] * 8, [1.0] * 7 + [1.05]
    rows = [(0, None, 1), (1, [], 1), (2, [0.0] * 8, 1), (3, [1.0, None] * 4, 1), (4, [float("nan")] * 8, 1), (5, [float("inf")] + [1.0] * 7, 1),
            (6, v, None), (7, v, 1), (7, v, 1), (7, w, 1), (None, w, 1), (None, [-x for x in v], 1), (8, v, 2), (9, [1.0] * 9, 1), (10, [3e38] * 8, 1), (11, [-0.0] + v[1:], 1), (12, [0.0] + v[1:], 1)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, rows[:7]) == brute(rows[:7])


def test_codes_are_balanced_and_recall_is_high():
    rng = np.random.default_rng(3)
    x = quantised.unit(rng.normal(size=(4000, 64)))
    model = quantised.learn(x)
    bits = np.unpackbits(quantised.codes(x, model).view(np.uint8).reshape(-1, 8), axis=1)
    assert (np.abs(bits.mean(0) - 0.5) < 0.06).all()
    pairs = np.stack([around(rng, v, rng.uniform(0.98, 1.0)) for v in x])
    apart = quantised.codes(x, model) ^ quantised.codes(quantised.unit(pairs), model)
    meets = [np.array([bin((int(c) >> a) & ((1 << w) - 1)).count("1") <= 1 for c in apart]) for a, w in quantised.tables(64)]
    assert np.any(meets, axis=0).mean() > 0.995


def test_forest():
    hit = np.zeros((6, 6), bool)
    for a, b in ((0, 3), (3, 5), (1, 4)):
        hit[a, b] = hit[b, a] = True
    assert quantised._forest(hit).tolist() == [0, 1, 2, 0, 1, 0]
