"""Copy differences against a plain comparison of dictionaries."""

import random
from datetime import datetime, timedelta

import pytest

from quillspark.operators import copy_diff
from quillspark.operators.copy_diff import token_copy_diff

DDL = "page_id bigint, node_id int, type string, subtype string, name string, payload struct<level int>, children array<struct<is_text boolean, text string, node_id int>>, loaded_at timestamp"
T0 = datetime(2025, 1, 1)


def norm(r):
    name, kids = r[4] or None, r[6] or None
    kids = None if kids is None else tuple(None if k is None else (k[0] or None, k[1] or None, k[2]) for k in kids)
    return {"type": r[2] or None, "subtype": r[3] or None, "name": name, "level": r[5][0] if r[5] else None, "children": kids}


def brute(left, right):
    def latest(rows):
        out = {}
        for r in rows:
            k = (r[0], r[1])
            if k not in out or (r[7] or T0.replace(year=1)) >= (out[k][7] or T0.replace(year=1)):
                out[k] = r
        return out

    a, b = latest(left), latest(right)
    out = set()
    for k in a.keys() | b.keys():
        if k not in a:
            out.add((*k, "missing_left"))
        elif k not in b:
            out.add((*k, "missing_right"))
        else:
            x, y = norm(a[k]), norm(b[k])
            out |= {(*k, f) for f in x if x[f] != y[f]}
    return out


def run(spark, left, right):
    rows = [tuple(r) for r in token_copy_diff(spark.createDataFrame(left, DDL), spark.createDataFrame(right, DDL)).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def row(page, node, name="a", kids=None, level=None, when=0, type_="T", sub="s"):
    return (page, node, type_, sub, name, (level,), kids, T0 + timedelta(seconds=when))


def test_random_copies(spark):
    rnd = random.Random(3)
    left, right = [], []
    for page in [1] * 300 + list(range(2, 60)):
        node = rnd.randrange(400)
        base = row(page, node, rnd.choice(["x", "", None]), rnd.choice([None, [], [(True, "t", None)], [(False, None, 3), None]]), rnd.choice([None, 2]), when=len(left))
        left.append(base)
        if rnd.random() < 0.8:
            right.append(base)
        if rnd.random() < 0.2:
            right.append(row(page, node, "other", None, 3, when=10**6 + len(right)))
    assert run(spark, left, right) == brute(left, right)


def test_blank_values_are_one(spark):
    left = [row(1, 1, "", [(False, "", 2)]), row(1, 2, None, []), row(1, 3, "a", [(True, "x", None)])]
    right = [row(1, 1, None, [(None, None, 2)]), row(1, 2, "", None), row(1, 3, "a", [(True, "x ", None)])]
    assert run(spark, left, right) == {(1, 3, "children")}


def test_level_zero_is_not_null(spark):
    assert run(spark, [row(1, 1, level=0)], [row(1, 1, level=None)]) == {(1, 1, "level")}


def test_superseded_repeated_null_keys_and_empty(spark):
    left = [row(1, 1, "new", when=5), row(1, 1, "old", when=1), row(1, 1, "new", when=5), row(None, 7, "n")]
    right = [row(1, 1, "new", when=1), row(None, 7, "m")]
    assert run(spark, left, right) == {(None, 7, "name")}
    assert run(spark, left, []) == {(1, 1, "missing_right"), (None, 7, "missing_right")}
    assert run(spark, [], []) == set()


def test_swapped_pages_are_seen(spark):
    left = [row(p, n, f"n{p}") for p in (1, 2) for n in range(40)]
    right = [row(p, n, f"n{3 - p}") for p in (1, 2) for n in range(40)]
    assert run(spark, left, right) == brute(left, right)


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([row(1, 1)], DDL).selectExpr("*", "1 as _k1", "2 as _h", "3 as value", "4 as k1")
    assert token_copy_diff(df, df).count() == 0


@pytest.mark.parametrize("size", [1, 17])
def test_all_keys_on_one_side(spark, size):
    left = [row(5, n) for n in range(size)]
    assert len(run(spark, left, [])) == size


def test_equal_copies_are_told_by_their_sums(spark, monkeypatch):
    rows = [row(p, n, f"n{p}", when=p) for p in range(50) for n in range(30)]
    monkeypatch.setattr(copy_diff, "opened", lambda *a: pytest.fail("rows were opened"))
    assert run(spark, rows, [*reversed(rows), rows[3]]) == set()


def test_rows_are_opened_only_where_sums_differ(spark, monkeypatch):
    left = [row(p, n, f"n{p}") for p in range(0, 60_000, 1000) for n in range(64)]
    right = [row(r[0], r[1], "other") if (r[0], r[1]) in ((7000, 20), (7000, 21), (9000, 5)) else r for r in left]
    read = []
    whole = copy_diff.opened
    monkeypatch.setattr(copy_diff, "opened", lambda *a: read.append(whole(*a).count()) or whole(*a))
    assert run(spark, left, right) == brute(left, right)
    assert read == [32, 32]


def test_walk_over_every_level(spark):
    big = 1 << 40
    left = [row(p, n) for p in (0, 1, 70, 5000, 1 << 21, big, -5, None) for n in (0, 15, 16, 255, 256, 5000)]
    right = [row(r[0], r[1], "x") if r[1] in (16, 5000) else r for r in left]
    assert run(spark, left, right) == brute(left, right)


def test_more_ranges_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(copy_diff, "BROADCAST_RANGES", 1)
    monkeypatch.setattr(copy_diff, "STRETCHES", 1)
    left = [row(p, n) for p in (None, 3, 90_000) for n in range(20)]
    right = [row(r[0], r[1], "x") if r[1] == 3 else r for r in left]
    assert run(spark, left, right) == brute(left, right)
