# Inputs and results in this file are fixed values of the behaviour that is to be met.
import hashlib
import itertools
import random

import numpy as np
import pytest

from rowloom.operators import matching
from rowloom.operators.reconcile import reconcile
from rowloom.operators.tables import compare_tables
from rowloom.plans.options import Rules, TableOptions, UnresolvedError, UsageError, java_pattern, plan_tables


def counts(diff):
    r = diff.summary().first()
    return r.equal_rows, r.left_only, r.right_only, r.changed_left, r.changed_right, r.diff_rows


def test_duplicates_under_a_composite_key(text_table, collected):
    left = text_table("id,region,name,value", "1,JP,alpha,10", "2,JP,beta,20", "2,JP,beta,20", "3,US,gamma,30", "4,JP,old,40")
    right = text_table("region,id,name,value", "JP,5,epsilon,50", "JP,4,new,40", "US,3,gamma,31", "JP,2,beta,20", "JP,2,beta,20")
    for safe in (True, False):
        d = compare_tables(left, right, keys=["id", "region"], skew_safe=safe)
        assert counts(d) == (2, 1, 1, 2, 2, 6)
    assert ("LEFT_ONLY", "left", "1", "JP", "alpha", "10") in collected(d.rows())


def test_surplus_copies_of_a_full_row_key_are_changed(text_table, collected):
    d = compare_tables(text_table("a", "x", "x", "x", "y"), text_table("a", "x", "x", "z"))
    assert collected(d.rows()) == [("CHANGED", "left", "x"), ("LEFT_ONLY", "left", "y"), ("RIGHT_ONLY", "right", "z")]


def test_normalised_values_are_equal_and_originals_are_shown(text_table):
    rules = Rules(ignore_case=True, whitespace="change", filters=(r"time=\d+",))
    left, right = text_table("id,note,stamp", "A,hello   WORLD,time=100"), text_table("id,note,stamp", "a,hello world,time=200")
    assert counts(compare_tables(left, right, keys=["id"], rules=rules))[0] == 1


def test_ignored_and_tolerant_columns_leave_the_default_key(text_table):
    assert counts(compare_tables(text_table("id,u,v", "1,10:00,ok"), text_table("id,u,v", "1,11:00,ok"), ignore=["u"]))[0] == 1
    assert counts(compare_tables(text_table("id,v", "1,10.00"), text_table("id,v", "1,10.05"), tolerances={"v": 0.1}))[0] == 1


def test_tolerance_takes_the_largest_matching(text_table, collected):
    d = compare_tables(text_table("id,v", "1,0.0", "1,0.4"), text_table("id,v", "1,0.0", "1,-0.4"), keys=["id"], tolerance=0.4)
    assert counts(d)[0] == 2
    d = compare_tables(text_table("id,v", "1,10.0000", "1,20"), text_table("id,v", "1,20.00005", "1,11"), keys=["id"], tolerance=0.001)
    assert collected(d.rows()) == [("CHANGED", "left", "1", "10.0000"), ("CHANGED", "right", "1", "11")]


@pytest.mark.parametrize("seed", range(30))
def test_matching_against_all_matchings(seed):
    rng = np.random.default_rng(seed)
    near = rng.random((rng.integers(1, 6), rng.integers(1, 6))) < 0.4
    got = matching.maximum_matching(near)
    used = [j for j in got if j >= 0]
    assert len(used) == len(set(used)) and all(near[i, j] for i, j in enumerate(got) if j >= 0)
    n, m = near.shape
    best = max(sum(near[i, j] for i, j in enumerate(p) if j < m) for p in itertools.permutations(range(max(n, m)), n))
    assert len(used) == best


@pytest.mark.parametrize("seed", range(30))
def test_matched_copies_against_single_rows(seed):
    rng = np.random.default_rng(seed)
    n, m = rng.integers(1, 7, 2)
    near = rng.random((n, m)) < 0.4
    left, right = rng.integers(1, 5, n), rng.integers(1, 5, m)
    got_l, got_r = matching.matched_copies(near, left, right)
    lrow, rrow = np.repeat(np.arange(n), left), np.repeat(np.arange(m), right)
    single = matching.maximum_matching(near[lrow][:, rrow])
    assert got_l.sum() == got_r.sum() == sum(j >= 0 for j in single)
    assert (got_l <= left).all() and (got_r <= right).all() and (got_l == np.bincount(lrow[[j >= 0 for j in single]], minlength=n)).all()


def test_a_key_of_very_many_copies(spark):
    from pyspark.sql import functions as F

    left = spark.range(60_000).select(F.lit("k").alias("k"), (F.col("id") % 3).cast("string").alias("v"))
    right = spark.range(50_000).select(F.lit("k").alias("k"), (F.col("id") % 3 + F.lit(0.5)).cast("string").alias("v"))
    d = compare_tables(left, right, keys=["k"], tolerances={"v": 0.6})
    assert counts(d)[0] == 50_000


def test_cells_and_ranking(text_table, collected):
    left, right = text_table("id,name,price,updated", "1,old,10.00,10:00"), text_table("id,name,price,updated", "1,new,10.05,11:00")
    d = compare_tables(left, right, keys=["id"], cell_diff=True, ignore=["updated"], tolerances={"price": 0.1})
    assert [r._changed_cols for r in d.rows().collect()] == ["name", "name"]
    left, right = text_table("id,name,city,value", "1,alice,NYC,10", "1,bob,LA,20"), text_table("id,name,city,value", "1,bobby,LA,20", "1,alice,NYC,11")
    d = compare_tables(left, right, keys=["id"], cell_diff=True)
    assert collected(d.column_changes()) == [(1, "name", 1), (3, "value", 1)]


def test_records_and_ids(text_table):
    d = compare_tables(text_table("id,name,value", "1,old,10", "2,left,20"), text_table("id,name,value", "1,new,11", "3,right,30"), keys=["id"], cell_diff=True)
    by = {r.kind: r for r in d.records().collect()}
    enc = lambda *f: b"".join(len(x).to_bytes(4, "big") + x.encode() for x in f)
    want = hashlib.sha256(b"CHANGED\0" + enc("1") + b"\0" + enc("1", "old", "10") + b"\1" + enc("1") + b"\0" + enc("1", "new", "11")).hexdigest()[:32]
    assert by["CHANGED"].id == want
    assert [c.name for c in by["CHANGED"].changed_columns] == ["name", "value"] and by["LEFT_ONLY"].new is None


def test_reconcile(text_table, collected):
    left, right = text_table("id,v", "1,same", "2,left", "3,left-only"), text_table("id,v", "1,same", "2,right", "4,right-only")
    d = compare_tables(left, right, keys=["id"], cell_diff=True)
    assert collected(reconcile(d, default="right")) == [("1", "same"), ("2", "right"), ("4", "right-only")]
    with pytest.raises(UnresolvedError):
        reconcile(d)


def test_encoded_rows_are_decoded(spark):
    from pyspark.sql import functions as F

    from rowloom.functions import encode

    df = spark.createDataFrame([("a", "é日"), ("", None), ("x" * 300, "\0")], "a string, b string").select("a", "b", encode.row([F.col("a"), F.col("b")]).alias("r"))
    got = df.select("a", "b", encode.decode(F.col("r"), 2).alias("d"), encode.decode(F.col("r"), 1).alias("more"), encode.decode(F.substring("r", 1, 6), 2).alias("cut")).collect()
    assert all(r.d == [r.a, r.b or ""] and r.more is None and r.cut is None for r in got)


def test_headerless_and_empty(text_table, spark):
    d = compare_tables(text_table("column_0,column_1", "a,1", "b,2"), text_table("column_0,column_1", "b,3", "a,1"), keys=[0], has_header=False)
    assert counts(d) == (1, 0, 0, 1, 1, 2)
    none = spark.createDataFrame([], "id string, v string")
    assert counts(compare_tables(none, none, keys=["id"])) == (0, 0, 0, 0, 0, 0)


def test_signature_leftovers_against_a_plain_walk(text_table, collected):
    rng = random.Random(3)
    rows = lambda: [f"{rng.choice('12')},{rng.choice(['a', 'A', 'aa', 'AA', 'Aa', 'b'])}" for _ in range(12)]
    a, b = rows(), rows()
    order = lambda r: [(len(x), x) for x in r.split(",")]
    want = []
    for k in "12":
        l, r = (sorted((x for x in s if x[0] == k), key=order) for s in (a, b))
        left = []
        for x in l:
            hit = [y for y in r if y.lower() == x.lower()]
            if hit:
                r.reverse()
                r.remove(hit[-1])
                r.reverse()
            else:
                left.append(x)
        kind = lambda other: "CHANGED" if any(x[0] == k for x in other) else None
        want += [(kind(b) or "LEFT_ONLY", "left", *x.split(",")) for x in left] + [(kind(a) or "RIGHT_ONLY", "right", *x.split(",")) for x in r]
    d = compare_tables(text_table("k,v", *a), text_table("k,v", *b), keys=["k"], rules=Rules(ignore_case=True))
    assert collected(d.rows()) == sorted(want, key=repr)


@pytest.mark.parametrize("bad", [
    {"keys": ["id"], "exclude_keys": ["v"]}, {"keys": ["nope"]}, {"keys": ["id"], "tolerances": {"id": 1.0}}, {"tolerance": 1.0}, {"ignore": ["id", "v"]}, {"keys": [5]}, {"index_base": 2},
])
def test_bad_options(bad):
    with pytest.raises(UsageError):
        plan_tables(["id", "v"], ["v", "id"], TableOptions(**bad))


def test_bad_schemas_and_patterns():
    for left, right in ((["a"], ["a", "b"]), (["a", "a"], ["a", "b"]), (["a", "b"], ["a", "c"])):
        with pytest.raises(UsageError):
            plan_tables(left, right, TableOptions())
    with pytest.raises(UsageError):
        java_pattern(r"(?=x)")
    assert java_pattern(r"(?P<n>\s)$") == r"(?<n>[\t\n\f\r ])\z"
