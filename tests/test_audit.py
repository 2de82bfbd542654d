"""Audits of logged shapes against numpy, and renames that meet each other."""

import numpy as np

from axisframe.operators import audit as Q
from axisframe.operators import lookup as K


def outcome(f):
    try:
        return f()
    except ValueError:
        return None


def test_products_of_all_small_shapes(spark):
    shapes = [[], [2], [3], [2, 3], [3, 2], [1, 2, 3], [4, 2, 3], [4, 3, 2], [1, 1, 3, 2], [5, 4, 3, 2], [5, 1, 2, 3], [0], [0, 3]]
    rows = [(a, b) for a in shapes for b in shapes]
    want = [outcome(lambda: list(np.matmul(np.zeros(a), np.zeros(b)).shape)) for a, b in rows]  # noqa: B023
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)] + [(-1, None, [2]), (-2, [2, None], [3, 4])], "i long, left_shape array<int>, right_shape array<int>")
    got = {r["i"]: (r["conflict"], r["result"]) for r in Q.contraction_audit(df).collect()}
    assert got.pop(-1) == (False, None) and got.pop(-2) == (False, [2, 4])
    assert [got[i] for i in range(len(rows))] == [(w is None, w) for w in want]


def test_concat_of_small_shapes(spark):
    cases = [([[2, 3], [4, 3]], 0), ([[2, 3], [4, 3]], -2), ([[2, 3], [4, 3]], -1), ([[2, 3], [4, 3]], 2), ([[2, 3], [4, 3]], -3), ([[2], [5]], 0), ([[2], [5]], -1), ([[], []], 0), ([[2, 3], [2]], 0), ([[2, 3, 1], [2, 5, 1]], -2), ([[], [2]], 0)]
    want = [outcome(lambda: np.concatenate([np.zeros(s) for s in shapes], axis)) is None for shapes, axis in cases]  # noqa: B023
    cases += [([[0], [2, 3]], 1), ([[0], [2]], 0), ([None, [2]], 0), ([[2, None], [4, 3]], 0)]
    want += [False] * 4
    df = spark.createDataFrame([(i, s, axis) for i, (shapes, axis) in enumerate(cases) for s in shapes], "op_id long, shape array<int>, axis int")
    assert [r["conflict"] for r in sorted(Q.concat_audit(df).collect(), key=lambda r: r["op_id"])] == want


def test_reshape_refuses_negative_sizes(spark):
    df = spark.createDataFrame([([2, 3], [6]), ([2, 3], [-1, 3]), ([2, 3], [-2, -3]), ([2, 3], [-1, -1]), ([2, 3], [4]), ([6], [-2, 3]), ([0], [-1, 0])], "old_shape array<int>, new_shape array<int>")
    assert [r["conflict"] for r in Q.reshape_audit(df).collect()] == [False, False, True, True, True, True, True]


def test_grade_of_names_and_numbers(spark):
    df = spark.createDataFrame([("n", 3), ("3", 3), ("4", 3), ("4", None), (None, 3), ("2*d", 3)], "declared string, measured int")
    assert [r["kind"] for r in Q.grade(df, "declared", "measured").collect()] == ["approximation", None, "mismatch", "approximation", "approximation", "approximation"]


def test_stretched_dims_have_one_size(spark):
    df = spark.createDataFrame([("a", 1), ("a", 5), ("b", 4), ("b", 5), ("c", 1)], "name string, size int")
    assert {r["name"]: r["one_size"] for r in Q.bind_dims(df).collect()} == {"a": True, "b": False, "c": True}


def renamed(spark, names, renames):
    sites = spark.createDataFrame([(1, n) for n in names], "scope_id long, name string")
    plans = spark.createDataFrame([(1, a, b) for a, b in renames], "scope_id long, name string, new_name string")
    clashes = sorted((r["name"], r["new_name"]) for r in K.rename_clashes(sites, plans).collect())
    return sorted(r["name"] for r in K.rename(sites, plans).collect()), clashes


def test_renames_meet(spark):
    assert renamed(spark, "ab", [("a", "b"), ("b", "a")]) == (["a", "b"], [])
    assert renamed(spark, "abc", [("a", "b"), ("b", "x")]) == (["b", "c", "x"], [])
    assert renamed(spark, "abc", [("a", "b"), ("b", "c")]) == (["a", "b", "c"], [("a", "b"), ("b", "c")])
    assert renamed(spark, "abc", [("a", "x"), ("b", "x"), ("c", "a")]) == (["a", "b", "c"], [("a", "x"), ("b", "x"), ("c", "a")])
    assert renamed(spark, "abcd", [("a", "b"), ("b", "c"), ("c", "d")])[1] == [("a", "b"), ("b", "c"), ("c", "d")]
    assert renamed(spark, "ab", [("a", "a"), ("z", "b"), ("b", "z")]) == (["a", "z"], [])
