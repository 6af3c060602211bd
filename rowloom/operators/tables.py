"""Keyed multiset comparison of two tables.

Rows are dealt out by key once, and counted per side there. Where a key is hot they are counted first, by all their columns (a
map-side combined sum before the exchange), so repeated rows travel once, and key presence is joined back. A row of a key that
the other side lacks is LEFT_ONLY or RIGHT_ONLY; in common keys equal rows cancel one against one, and what is left is
CHANGED. Under normalisation rules rows cancel by signature: the smallest left rows against the largest right rows, in
the order of the encoded form. Only key groups that need a matching (a tolerance, or several changed rows on a side with
``cell_diff``) reach a Python kernel, one key group at a time; groups of one row a side stay in SQL.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions import encode, normalize
from rowloom.operators import matching
from rowloom.plans.options import CompareError, TableOptions, TablePlan, plan_tables

#: Estimated bytes of both inputs up to which a hot key does no harm, and the share of the keys that tells of one beyond it.
ONE_TASK, SAMPLE = 256 << 20, 0.001
KINDS = ("LEFT_ONLY", "RIGHT_ONLY", "CHANGED")


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


class TableDiff:
    """The comparison of two tables; every result is a DataFrame that is planned when asked for."""

    def __init__(self, left: DataFrame, right: DataFrame, options: TableOptions):
        self.plan: TablePlan = plan_tables(left.columns, right.columns, options)
        self.options = options
        p = self.plan
        self.names = [f"c{i}" for i in range(len(p.columns))]
        of = dict(zip(p.columns, self.names, strict=True))
        self.key = [of[c] for c in p.key]
        self.left = left.toDF(*self.names)
        if options.has_header and options.align_by_name:
            self.right = right.select(*[_q(c) for c in p.columns]).toDF(*self.names)
        else:
            self.right = right.toDF(*self.names)
        self.types = {f.name: f.dataType for f in self.left.schema.fields}
        self.tolerance = {of[c]: t for c, t in p.tolerance.items()}
        self.ignored = [of[c] for c in p.ignored]
        self.compared = [c for c in self.names if c not in self.ignored]

    @cached_property
    def skew_safe(self) -> bool:
        """Whether rows meet by all their columns first and key presence is joined back. Where no option says so, keys are hot
        if one has more than a quarter of a partition's share, in a sample of the keys; inputs that one task can hold are not."""
        if self.options.skew_safe is not None:
            return self.options.skew_safe
        size = sum(int(str(d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for d in (self.left, self.right))
        if size <= ONE_TASK:
            return False
        keys = self.left.select(*self.key).unionByName(self.right.select(*self.key)).sample(SAMPLE, seed=1)
        most, total = keys.groupBy(*self.key).agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
        return bool(total) and most * 4 * int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")) > total + 4 * most

    def _normal(self, c: str) -> Column:
        col = F.col(c)
        return normalize.normalise(col, self.options.rules) if isinstance(self.types[c], T.StringType) else col

    def _number(self, c: str) -> Column:
        col = self._normal(c)
        if isinstance(self.types[c], T.StringType):
            return normalize.number(col)
        d = col.cast("double")
        return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)

    @cached_property
    def counted(self) -> DataFrame:
        """One row per distinct row: k* the (normalised) key, s* the signature, the columns, l and r how often each side has it."""
        one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
        both = self.left.withColumns({"l": one, "r": zero}).unionByName(self.right.withColumns({"l": zero, "r": one}))
        if not self.plan.rules_on and not self.skew_safe:
            # dealt by key at once, which serves all that follows
            both = both.repartition(*self.key)
        out = both.groupBy(*self.names).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
        if not self.plan.rules_on:
            return out
        extra = {f"k{i}": self._normal(c) for i, c in enumerate(self.key)}
        if not self.tolerance:
            extra |= {f"s{i}": self._normal(c) for i, c in enumerate(self.compared)}
        return out.withColumns(extra)

    @property
    def _k(self) -> list[str]:
        return [f"k{i}" for i in range(len(self.key))] if self.plan.rules_on else self.key

    @cached_property
    def placed(self) -> DataFrame:
        """``counted`` with on_left and on_right: whether each side has the key."""
        rows = self.counted
        here = (F.max((F.col("l") > 0)), F.max((F.col("r") > 0)))
        if self.plan.full_row_key:
            return rows.withColumns({"on_left": F.col("l") > 0, "on_right": F.col("r") > 0})
        if not self.skew_safe:
            w = Window.partitionBy(*self._k)
            return rows.withColumns({"on_left": here[0].over(w), "on_right": here[1].over(w)})
        keys = rows.groupBy(*[F.col(k).alias(f"j{i}") for i, k in enumerate(self._k)]).agg(here[0].alias("on_left"), here[1].alias("on_right"))
        on = [F.col(k).eqNullSafe(F.col(f"j{i}")) for i, k in enumerate(self._k)]
        return rows.join(keys, on, "left").drop(*[f"j{i}" for i in range(len(self._k))])

    @cached_property
    def settled(self) -> DataFrame:
        """``placed`` with eq_l and eq_r: how many of a distinct row's copies find an equal on the other side."""
        rows = self.placed
        if self.tolerance:
            return self._matched(rows)
        if not self.plan.rules_on:
            same = F.least("l", "r")
            return rows.withColumns({"eq_l": same, "eq_r": same})
        sig = [f"s{i}" for i in range(len(self.compared))]
        group = Window.partitionBy(*self._k, *sig)
        cols = [F.col(c) for c in self.names]
        up = group.orderBy(*encode.order(cols)).rowsBetween(Window.unboundedPreceding, -1)
        down = group.orderBy(*encode.order(cols, True)).rowsBetween(Window.unboundedPreceding, -1)
        before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
        rows = rows.withColumns({"both": F.least(F.sum("l").over(group), F.sum("r").over(group)), "l0": before("l", up), "r0": before("r", down)})
        take = lambda c, c0: F.greatest(F.lit(0), F.least(F.col(c), F.col("both") - F.col(c0)))
        return rows.withColumns({"eq_l": take("l", "l0"), "eq_r": take("r", "r0")}).drop("both", "l0", "r0", *sig)

    def _matched(self, rows: DataFrame) -> DataFrame:
        """Maximum matching of the key groups that both sides have; groups of one row a side are compared in SQL."""
        w = Window.partitionBy(*self._k)
        rows = rows.withColumns({"nl": F.sum("l").over(w), "nr": F.sum("r").over(w)})
        common = F.col("on_left") & F.col("on_right")
        pair = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        one = common & (F.col("nl") == 1) & (F.col("nr") == 1)
        test = F.lit(True)
        for c in self.compared:
            side = lambda v, s: F.max(F.when(F.col(s) > 0, v)).over(pair)
            same = side(F.struct(self._normal(c).alias("v")), "l").eqNullSafe(side(F.struct(self._normal(c).alias("v")), "r"))
            if c in self.tolerance:
                same = same | normalize.within(side(self._number(c), "l"), side(self._number(c), "r"), self.tolerance[c])
            test = test & same
        # windows first, so that keys without and with a single partner share a pass
        equal = F.when(one & test, 1).otherwise(0).cast("long")
        few = rows.withColumn("equal", equal).filter(~common | one)
        few = few.withColumns({"eq_l": F.least("equal", "l"), "eq_r": F.least("equal", "r")}).drop("equal")
        many = rows.filter(common & ~one)
        values = {f"v{i}": self._normal(c) for i, c in enumerate(self.compared)}
        numbers = {f"n{c}": self._number(c) for c in self.tolerance}
        # a row's place in the order of the encoded form, so that the kernel needs no encoding
        place = F.row_number().over(w.orderBy(*encode.order([F.col(c) for c in self.names])))
        many = many.withColumns(values | numbers | {"place": place})
        schema = T.StructType([*rows.schema.fields, T.StructField("eq_l", T.LongType()), T.StructField("eq_r", T.LongType())])
        compared, tolerance, keep = self.compared, self.tolerance, [f.name for f in schema.fields]

        def match(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
            codes = [pd.factorize(frame[f"v{i}"], use_na_sentinel=False)[0] for i in range(len(compared))]
            numbers = {c: frame[f"n{c}"].to_numpy(float) for c in tolerance}
            l, r = frame["l"].to_numpy(), frame["r"].to_numpy()
            eq = {"l": np.zeros(len(frame), np.int64), "r": np.zeros(len(frame), np.int64)}
            for a, b in zip(starts, starts[1:], strict=False):
                at = np.arange(a, b)
                on_l, on_r = at[l[a:b] > 0], at[r[a:b] > 0]
                if len(on_l) * len(on_r) > matching.PAIRS:
                    raise CompareError(f"a key has {len(on_l)} and {len(on_r)} distinct rows, too many to match under a tolerance")
                near = np.ones((len(on_l), len(on_r)), bool)
                for c, code in zip(compared, codes, strict=True):
                    same = code[on_l][:, None] == code[on_r][None]
                    if c in tolerance:
                        with np.errstate(invalid="ignore"):
                            same |= np.abs(numbers[c][on_l][:, None] - numbers[c][on_r][None]) <= tolerance[c]
                    near &= same
                if l[on_l].sum() * r[on_r].sum() > matching.COPIES:
                    eq["l"][on_l], eq["r"][on_r] = matching.matched_copies(near, l[on_l], r[on_r])
                    continue
                lrow, rrow = np.repeat(np.arange(len(on_l)), l[on_l]), np.repeat(np.arange(len(on_r)), r[on_r])
                partner = np.array(matching.maximum_matching(near[lrow][:, rrow]), int)
                met = partner >= 0
                np.add.at(eq["l"], on_l[lrow[met]], 1)
                np.add.at(eq["r"], on_r[rrow[partner[met]]], 1)
            frame["eq_l"], frame["eq_r"] = eq["l"], eq["r"]
            return frame[keep]

        done = matching.by_group(many, self._k, ["place"], match, schema)
        return few.unionByName(done).drop("nl", "nr")

    @cached_property
    def sides(self) -> DataFrame:
        """Leftover rows, one for each copy: kind, side, on their columns."""
        rows = self.settled
        left, right = F.col("l") - F.col("eq_l"), F.col("r") - F.col("eq_r")
        kind_l = F.when(F.col("on_right"), "CHANGED").otherwise("LEFT_ONLY")
        kind_r = F.when(F.col("on_left"), "CHANGED").otherwise("RIGHT_ONLY")
        copies = F.concat(
            F.array_repeat(F.struct(kind_l.alias("kind"), F.lit("left").alias("side")), left.cast("int")),
            F.array_repeat(F.struct(kind_r.alias("kind"), F.lit("right").alias("side")), right.cast("int")),
        )
        out = rows.filter((left > 0) | (right > 0)).withColumn("copy", F.explode(copies))
        return out.select(*dict.fromkeys([*self._k, *self.names]), "copy.kind", "copy.side")

    @cached_property
    def pairs(self) -> DataFrame:
        """Differences with old and new as structs (null on a missing side) and ``changed``, the indexes of changed columns.

        Without ``cell_diff`` every row stands alone and lists none.
        """
        row = F.struct(*self.names)
        cols = [*self._k]
        rows = self.sides.select(*[F.col(k).alias(f"key{i}") for i, k in enumerate(cols)], "kind", "side", row.alias("row"))
        keys = [f"key{i}" for i in range(len(cols))]
        none = F.lit(None).cast(self.sides.select(row.alias("x")).schema["x"].dataType)
        empty = F.array().cast("array<int>")
        lone = lambda d: d.select(
            *keys, "kind", F.when(F.col("side") == "left", F.col("row")).otherwise(none).alias("old"), F.when(F.col("side") == "right", F.col("row")).otherwise(none).alias("new"), empty.alias("changed")
        )
        if not self.options.cell_diff:
            return lone(rows)
        w = Window.partitionBy(*keys)
        of = lambda side, x: F.when(F.col("side") == side, x)
        rows = rows.withColumns({"nl": F.count(of("left", 1)).over(w), "nr": F.count(of("right", 1)).over(w), "other": F.max(of("right", F.col("row"))).over(w)})
        many = rows.filter("nl > 0 and nr > 0 and nl + nr > 2").drop("other")
        # keys of one row a side are paired where they stand, at the left row
        one = (F.col("nl") == 1) & (F.col("nr") == 1)
        few = rows.filter("(nl = 0 or nr = 0 or nl + nr = 2) and not (nl = 1 and nr = 1 and side = 'right')")
        few = few.select(*keys, "kind", F.coalesce(of("left", F.col("row")), none).alias("old"), F.when(one, F.col("other")).otherwise(of("right", F.col("row"))).alias("new"))
        both = few.unionByName(self._paired(many, keys))
        return both.withColumn("changed", F.when(F.col("old").isNull() | F.col("new").isNull(), empty).otherwise(self._changed("old", "new")))

    def _changed(self, old: str, new: str) -> Column:
        """Indexes of the compared columns that differ between two row structs."""
        flags = []
        for i, c in enumerate(self.names):
            if c in self.ignored:
                continue
            flags.append(F.when(self._differs(F.col(old)[c], F.col(new)[c], c), F.lit(i)))
        return F.array_compact(F.array(*flags)).cast("array<int>")

    def _differs(self, a: Column, b: Column, c: str) -> Column:
        text = isinstance(self.types[c], T.StringType)
        norm = (lambda x: normalize.normalise(x, self.options.rules)) if text else (lambda x: x)
        same = norm(a).eqNullSafe(norm(b))
        if c in self.tolerance:
            num = (lambda x: normalize.number(norm(x))) if text else (lambda x: x.cast("double"))
            same = same | normalize.within(num(a), num(b), self.tolerance[c])
        return ~same

    def _paired(self, many: DataFrame, keys: list[str]) -> DataFrame:
        """Pairs of least change within key groups, in Python; rows are named by number so that only numbers come back."""
        cells = {f"v{i}": self._cell(c) for i, c in enumerate(self.names) if c in self.compared}
        numbers = {f"n{i}": self._cell_number(c) for i, c in enumerate(self.names) if c in self.tolerance}
        w = Window.partitionBy(*keys, "side").orderBy(*encode.order([F.col("row")[c] for c in self.names]))
        rows = many.withColumn("at", F.row_number().over(w)).withColumns(cells | numbers)
        tol = {i: self.tolerance[c] for i, c in enumerate(self.names) if c in self.tolerance}
        index = [i for i, c in enumerate(self.names) if c in self.compared]
        limit = self.options.max_similarity_pairs
        schema = T.StructType([*[f for f in rows.select(*keys).schema.fields], T.StructField("side", T.StringType()), T.StructField("at", T.IntegerType()), T.StructField("pair", T.IntegerType())])

        def pair(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
            codes = {i: pd.factorize(frame[f"v{i}"], use_na_sentinel=False)[0] for i in index}
            numbers = {i: frame[f"n{i}"].to_numpy(float) for i in tol}
            left = (frame["side"] == "left").to_numpy()
            out = np.zeros(len(frame), np.int32)
            for a, b in zip(starts, starts[1:], strict=False):
                l, r = a + np.flatnonzero(left[a:b]), a + np.flatnonzero(~left[a:b])
                cost = np.zeros((len(l), len(r)), np.int64)
                if len(l) * len(r) <= limit:
                    for i in index:
                        differs = codes[i][l][:, None] != codes[i][r][None]
                        if i in tol:
                            with np.errstate(invalid="ignore"):
                                differs &= ~(np.abs(numbers[i][l][:, None] - numbers[i][r][None]) <= tol[i])
                        cost += differs
                mate = matching.least_change(cost, limit)
                taken = set(mate)
                out[l] = [j + 1 if j >= 0 else -(i + 1) for i, j in enumerate(mate)]
                out[r] = [j + 1 if j in taken else -(len(l) + j + 1) for j in range(len(r))]
            frame["pair"] = out
            return frame[[f.name for f in schema.fields]]

        found = matching.by_group(rows.drop("row", "kind", "nl", "nr"), keys, ["side", "at"], pair, schema)
        same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "side", "at"]]
        named = rows.alias("a").join(found.alias("b"), same).select(*[F.col(f"a.{k}").alias(k) for k in keys], "a.side", "a.row", "b.pair")
        return named.groupBy(*keys, "pair").agg(
            F.max(F.when(F.col("side") == "left", F.col("row"))).alias("old"), F.max(F.when(F.col("side") == "right", F.col("row"))).alias("new")
        ).select(*keys, F.lit("CHANGED").alias("kind"), "old", "new")

    def _cell(self, c: str) -> Column:
        x = F.col("row")[c]
        x = normalize.normalise(x, self.options.rules) if isinstance(self.types[c], T.StringType) else x
        return x.cast("string")

    def _cell_number(self, c: str) -> Column:
        x = F.col("row")[c]
        if isinstance(self.types[c], T.StringType):
            return normalize.number(normalize.normalise(x, self.options.rules))
        return x.cast("double")

    @cached_property
    def identified(self) -> DataFrame:
        """``pairs`` with their stable id."""
        keys = [F.col(c) for c in self.pairs.columns if c.startswith("key")]
        key = encode.row(keys)
        fields = lambda s: F.when(F.col(s).isNotNull(), F.unhex(F.lit("")) if self.plan.full_row_key else encode.row([F.col(s)[c] for c in self.names]))
        return self.pairs.withColumn("id", encode.difference_id(F.col("kind"), key, fields("old"), fields("new")))

    def rows(self) -> DataFrame:
        """One row per side of a difference: ``_diff``, ``_side``, with ``cell_diff`` ``_changed_cols``, then the columns."""
        names = F.array(*[F.lit(c) for c in self.plan.columns])
        changed = F.array_join(F.transform(F.col("changed"), lambda i: F.element_at(names, i + 1)), ",")
        side = lambda s, r: F.when(F.col(r).isNotNull(), F.struct(F.lit(s).alias("side"), F.col(r).alias("row")))
        out = self.pairs.withColumn("x", F.explode(F.array_compact(F.array(side("left", "old"), side("right", "new")))))
        cols = [F.col("x.row")[c].alias(n) for c, n in zip(self.names, self.plan.columns, strict=True)]
        extra = [changed.alias("_changed_cols")] if self.options.cell_diff else []
        return out.select(F.col("kind").alias("_diff"), F.col("x.side").alias("_side"), *extra, *cols)

    def records(self) -> DataFrame:
        """One object per difference: id, kind, old, new (arrays of text) and changed_columns."""
        cells = lambda s: F.when(F.col(s).isNotNull(), F.array(*[encode.text(F.col(s)[c]) for c in self.names])).alias(f"{s}_cells")
        rows = self.identified.select("id", "kind", "changed", cells("old"), cells("new"))
        names = F.array(*[F.lit(c) for c in self.plan.columns])
        get = lambda s, i: F.element_at(f"{s}_cells", i + 1)
        changed = F.transform(F.col("changed"), lambda i: F.struct(i.alias("index"), F.element_at(names, i + 1).alias("name"), get("old", i).alias("old"), get("new", i).alias("new")))
        return rows.select("id", "kind", F.col("old_cells").alias("old"), F.col("new_cells").alias("new"), changed.alias("changed_columns"))

    def summary(self) -> DataFrame:
        """One row of counters; left_rows = equal + left_only + changed_left, and so on the right."""
        left, right = F.col("l") - F.col("eq_l"), F.col("r") - F.col("eq_r")
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
        s = self.settled.agg(
            total("l").alias("left_rows"),
            total("r").alias("right_rows"),
            total("eq_l").alias("equal_rows"),
            total(F.when(~F.col("on_right"), left)).alias("left_only"),
            total(F.when(~F.col("on_left"), right)).alias("right_only"),
            total(F.when(F.col("on_right"), left)).alias("changed_left"),
            total(F.when(F.col("on_left"), right)).alias("changed_right"),
        )
        return s.withColumn("diff_rows", F.expr("left_only + right_only + changed_left + changed_right"))

    def column_changes(self) -> DataFrame:
        """(index, name, changes) of the columns that changed in paired rows, most changes first."""
        names = F.array(*[F.lit(c) for c in self.plan.columns])
        each = self.pairs.select(F.explode("changed").alias("index"))
        out = each.groupBy("index").agg(F.count("*").alias("changes"))
        return out.select("index", F.element_at(names, F.col("index") + 1).alias("name"), "changes").orderBy(F.desc("changes"), "index")

    def equal(self) -> DataFrame:
        """Equal rows in the left table's form, one for each copy."""
        rows = self.settled.filter("eq_l > 0").withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("eq_l").cast("int"))))
        return rows.select(*[F.col(c).alias(n) for c, n in zip(self.names, self.plan.columns, strict=True)])

    def distinct_differences(self) -> DataFrame:
        return self.identified.agg(F.count_distinct("id").alias("differences"))

    def preview(self, most: int = 500) -> DataFrame:
        """The first ``most`` (5000 at most) result rows, in the order of kind, side and columns, with ``truncated``."""
        most = max(1, min(most, 5000))
        r = self.rows()
        n = F.row_number().over(Window.orderBy(*r.columns))
        return r.orderBy(*r.columns).limit(most + 1).withColumn("n", n).withColumn("truncated", F.max(F.col("n") > most).over(Window.partitionBy())).filter(F.col("n") <= most).drop("n")


def compare_tables(left: DataFrame, right: DataFrame, options: TableOptions | None = None, **kwargs) -> TableDiff:
    """Compare two tables; ``kwargs`` are fields of ``TableOptions``."""
    return TableDiff(left, right, options or TableOptions(**kwargs))
