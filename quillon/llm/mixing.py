"""Mixing sources to target weights by entropy balancing.

Token mass w(d) * size(d) is kept as near as possible (in relative entropy) to the corpus' own under one token constraint for each
group. The convex dual  D(v) = sum_d size(d) * exp(sum of v over d's groups) - v . target  is solved by damped Newton steps; each
step's gradient and Hessian are Spark aggregates over the cells of equal group membership. A document's rate is then the exponential
tilt exp(v), which is rounded into whole copies: every document is taken floor(rate) times, and by a key's order some once more, up to
the target.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import WORD, Scratch, prepared, written

#: Sources whose plan (some hundred bytes each) is broadcast; more meet their rows in a shuffle.
FEW_GROUPS = 100_000
#: A row's key is its size class, larger ones first, times SPAN, and a number drawn from its id and text; keys lie below TOP.
SPAN, TOP = 1 << 56, 1 << 62
#: Ranges of keys that are summed at once; rows of a border's range that are then ordered.
CELLS, FINE = 4096, 1000
#: Fillings of what borders leave open, and the share of a target that may stay open.
ROUNDS, NEAR = 4, 0.001


def size_of(text: str | Column = "text") -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def capped_targets(sizes: list[int], weights: list[float], cap: float) -> list[float]:
    """Shares of sum(sizes) by weight; what is above cap * size goes to the others by weight until none is above."""
    total, targets, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if weights[i] * unit > cap * sizes[i]}
        if not full:
            for i in open_:
                targets[i] = weights[i] * unit
            break
        for i in full:
            targets[i] = cap * sizes[i]
        left -= sum(targets[i] for i in full)
        open_ -= full
    return targets


def balance(cells: DataFrame, groups: list[str], targets: dict[tuple, float], *, tolerance: float = 1e-9, most: int = 100) -> dict[tuple, float]:
    """Multipliers v of each (group column, value) with a positive target.

    cells: one row for each combination of groups with its summed `size`. Newton steps on the dual with halving; groups of target 0
    or size 0 take no part. Targets that contradict each other raise ValueError.
    """
    spark = cells.sparkSession
    names = [k for k, t in targets.items() if t > 0]
    place = {k: i for i, k in enumerate(names)}
    goal = np.array([targets[k] for k in names])
    schema = T.StructType([T.StructField("_col", T.StringType()), T.StructField("_value", T.StringType()), T.StructField("_v", T.DoubleType())])

    def moments(v: np.ndarray) -> tuple[float, np.ndarray, dict]:
        held = spark.createDataFrame([(c, x, float(v[i])) for (c, x), i in place.items()], schema)
        rows = cells
        for j, g in enumerate(groups):
            side = held.filter(F.col("_col") == g).select(F.col("_value").alias(f"_k{j}"), F.col("_v").alias(f"_v{j}"))
            rows = rows.join(F.broadcast(side), F.col(g).eqNullSafe(F.col(f"_k{j}")), "left")
        tilt = F.exp(sum((F.coalesce(F.col(f"_v{j}"), F.lit(0.0)) for j in range(len(groups))), F.lit(0.0)))
        mass = rows.select(*groups, (F.col("size") * tilt).alias("m"))
        ends = [F.struct(F.lit(g).alias("c"), F.col(g).alias("x")) for g in groups]
        pairs = F.array(*[F.struct(a.alias("a"), b.alias("b")) for i, a in enumerate(ends) for b in ends[i:]])
        sums = mass.select("m", F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.sum("m").alias("m")).collect()
        second = {((r.a.c, r.a.x), (r.b.c, r.b.x)): r.m for r in sums}
        first = np.array([second.get((k, k), 0.0) for k in names])
        return sum(m for (a, b), m in second.items() if a == b and a[0] == groups[0]) - float(v @ goal), first, second

    v = np.zeros(len(names))
    if not names:
        return {}
    value, first, second = moments(v)
    for _ in range(most):
        gap = first - goal
        if np.all(np.abs(gap) <= tolerance * np.maximum(goal, 1)):
            return dict(zip(names, v.tolist()))
        if len(groups) == 1:
            step = gap / np.maximum(first, 1e-300)
        else:
            hessian = np.zeros((len(names), len(names)))
            for (a, b), m in second.items():
                if a in place and b in place:
                    hessian[place[a], place[b]] = hessian[place[b], place[a]] = m
            step = np.linalg.lstsq(hessian, gap, rcond=1e-12)[0]
        step, scale = np.clip(step, -4, 4), 1.0
        while True:
            trial = moments(v - scale * step)
            if trial[0] <= value + 1e-12 * abs(value) or scale < 1e-6:
                break
            scale /= 2
        v, (value, first, second) = v - scale * step, trial
    raise ValueError("the targets contradict each other: Newton's steps don't reach them")


def targets_of(groups: DataFrame, weights: tuple[float, ...], cap: float, scratch: Scratch) -> DataFrame:
    """groups (_group, size, ...) with _k (place by code point, null last), _target and _rate, however many groups there are.

    Targets fill up as in capped_targets, with one aggregate for each step. With one constraint for each group the dual falls apart
    into one Newton iteration for each group, which are rows here.
    """
    spark = groups.sparkSession
    parts = max(1, min(200, groups.count() // 100_000))
    dealt = groups.repartitionByRange(parts, F.col("_group").asc_nulls_last()).sortWithinPartitions(F.col("_group").asc_nulls_last())
    dealt = scratch.written(dealt.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "mix-groups")
    starts, before = [], 0
    for r in sorted(dealt.groupBy("_p").count().collect()):
        starts.append((r[0], before))
        before += r[1]
    rows = dealt.join(F.broadcast(spark.createDataFrame(starts, "_p int, _start bigint")), "_p").withColumn("_k", F.col("_start") + F.col("_i"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_k") % len(weights) + 1).cast("int"))
    rows = rows.withColumn("_w", weight).drop("_p", "_i", "_start")
    unit, full, top = None, -1, F.lit(cap) * F.col("size")
    while True:
        is_full = F.lit(False) if unit is None else F.col("_w") * F.lit(unit) > top
        r = rows.agg(F.sum("size").alias("all"), F.count_if(is_full).alias("n"), F.sum(F.when(is_full, top).otherwise(0.0)).alias("given"), F.sum(F.when(~is_full, F.col("_w"))).alias("open")).collect()[0]
        if r.n == full or r.open is None:
            break
        unit, full = (r["all"] - r.given) / r.open, r.n
    target = F.least(top.cast("double"), F.col("_w") * F.lit(unit if unit is not None else 0.0))
    size = F.col("size").cast("double")
    step = lambda v: F.greatest(F.lit(-4.0), F.least(F.lit(4.0), 1 - F.col("_target") / (size * F.exp(v))))
    v = F.aggregate(F.sequence(F.lit(1), F.lit(80)), F.lit(0.0), lambda v, _: v - step(v))
    rows = rows.withColumn("_target", target)
    return rows.withColumn("_rate", F.when((F.col("size") > 0) & (F.col("_target") > 0), F.least(F.lit(float(cap)), F.exp(v))).otherwise(0.0)).drop("_w")


def _meet(rows: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    """rows with their group's columns; the groups are broadcast if they are few."""
    side = groups.withColumnRenamed("_group", "_g")
    return rows.join(F.broadcast(side) if few else side, F.col("_group").eqNullSafe(F.col("_g"))).drop("_g")


def _border(rows: DataFrame, state: DataFrame, few: bool, scratch: Scratch, again: bool = False) -> DataFrame:
    """state (_k, _group, _need, _lo, _end, _most, _rows) with the key at which rows of keys from _lo to _end and sizes up to _most exceed _need words.

    _before: words below that key; _u, _s, _n: the key, and the size and number of its rows; null if all rows fit. Sums over CELLS
    ranges of keys find the range of the border, again and again, until it holds few rows: no group is sorted. With `again`, only
    rows count that are taken so far, where the state's _less says so, or else those that are not.
    """
    more = ["_cuts", "_undo", "_parts", "_less"] if again else []
    state = state.withColumns({"_a": F.col("_lo"), "_b": F.col("_end"), "_before": F.lit(0.0), "_c": F.col("_rows")})

    def met(state: DataFrame, *columns) -> DataFrame:
        out = _meet(rows, state.select("_k", "_group", "_a", "_b", "_most", *more, *columns), few).filter("_size > 0 and _u >= _a and _u < _b and _size <= _most")
        return out.filter(_movable()) if again else out

    while not state.filter((F.col("_c") > FINE) & (F.col("_b") - F.col("_a") > 1)).isEmpty():
        width = F.expr(f"greatest(1L, (_b - _a + {CELLS - 1}) div {CELLS})")
        cells = met(state, width.alias("_w")).groupBy("_k", F.expr("(_u - _a) div _w").alias("_cell")).agg(F.sum("_size").alias("_s"), F.count("*").alias("_c"))
        upto = F.sum("_s").over(Window.partitionBy("_k").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0))
        cells = cells.withColumn("_upto", upto).join(state.select("_k", "_need", "_before"), "_k")
        found = cells.groupBy("_k").agg(
            F.sum("_s").alias("_all"),
            F.expr("min_by(struct(_cell, _upto - _s as words, _c), _cell) filter (where _before + _upto > _need)").alias("_x"),
        )
        step = state.drop("_c").join(found, "_k", "left").withColumn("_w", width)
        a = F.col("_a") + F.col("_x._cell") * F.col("_w")
        step = step.withColumns({
            "_before": F.col("_before") + F.coalesce(F.col("_x.words"), F.col("_all"), F.lit(0)), "_c": F.col("_x._c"),
            "_a": F.coalesce(a, F.col("_b")), "_b": F.when(F.col("_x").isNotNull(), F.least(F.col("_b"), a + F.col("_w"))).otherwise(F.col("_b")),
        })
        new = scratch.written(step.drop("_x", "_w", "_all"), "mix-borders")
        scratch.drop(state)
        state = new
    units = met(state, "_need", "_before").groupBy("_k", "_u", "_need", "_before").agg(F.sum("_size").alias("_words"), F.max("_size").alias("_s"), F.count("*").alias("_n"))
    units = units.withColumn("_upto", F.sum("_words").over(Window.partitionBy("_k").orderBy("_u").rowsBetween(Window.unboundedPreceding, 0)))
    first = units.groupBy("_k").agg(
        F.expr("min_by(struct(_u, _s, _n, _upto - _words as w), _u) filter (where _before + _upto > _need)").alias("_x"), F.sum("_words").alias("_all"),
    )
    out = state.drop("_a", "_b", "_c").join(first, "_k", "left")
    return out.withColumn("_before", F.col("_before") + F.coalesce("_x.w", "_all", F.lit(0))).select("*", "_x._u", "_x._s", "_x._n").drop("_x", "_all")


CUTS, PARTS = "array<struct<lo:bigint,hi:bigint,most:bigint>>", "array<struct<u:bigint,n:bigint>>"


def _in(cuts: str) -> Column:
    return F.exists(cuts, lambda c: (F.col("_u") >= c["lo"]) & (F.col("_u") < c["hi"]) & (F.col("_size") <= c["most"]))


def _chosen() -> Column:
    """Whether a row is taken once more than floor(_rate) times."""
    return _in("_cuts") & ~_in("_undo")


def _movable() -> Column:
    """Whether a row may be taken back, where too much is taken (_less), or else be taken."""
    return F.when(F.col("_less"), _chosen()).otherwise(~_in("_cuts")) & ~F.exists("_parts", lambda p: p["u"] == F.col("_u"))


def _is_open() -> Column:
    return F.col("_need") > F.greatest(F.lit(0.5), NEAR * F.col("_target"))


def _moved(cut: Column) -> dict[str, Column]:
    cut = F.array(cut)
    return {"_cuts": F.when(F.col("_less"), F.col("_cuts")).otherwise(F.concat("_cuts", cut)), "_undo": F.when(F.col("_less"), F.concat("_undo", cut)).otherwise(F.col("_undo"))}


def _settled(rows: DataFrame, state: DataFrame, few: bool, scratch: Scratch) -> DataFrame:
    """The state after some fillings of what is open by whole rows that fit, larger ones first."""
    ended, columns = [], state.columns
    for _ in range(ROUNDS):
        go_on = _is_open() & (F.col("_lo") < TOP)
        ended.append(state.filter(~go_on))
        still = state.filter(go_on)
        state = state.limit(0)
        if still.isEmpty():
            break
        at = _border(rows, still, few, scratch, again=True)
        left = F.col("_need") - F.col("_before")
        cut = F.struct(F.col("_lo").alias("lo"), F.coalesce("_u", "_end").alias("hi"), F.col("_most").alias("most"))
        at = at.withColumns(_moved(cut) | {"_need": left, "_most": F.floor(left).cast("long"), "_lo": F.coalesce(F.col("_u") + 1, F.lit(TOP))})
        state = scratch.written(at.select(*columns), "mix-state")
    for table in ended:
        state = state.unionByName(table)
    return scratch.written(state, "mix-state")


def _swapped(rows: DataFrame, state: DataFrame, few: bool) -> DataFrame:
    """States that are open, with the smallest row that doesn't fit moved all the same, so that what is open changes its sign."""
    met = _meet(rows, state.select("_k", "_group", "_cuts", "_undo", "_parts", "_less", "_need"), few).filter(_movable() & (F.col("_size") > F.col("_need")))
    one = met.groupBy("_k").agg(F.min(F.struct(F.col("_size").alias("s"), F.col("_u").alias("u"))).alias("_x"))
    over = F.col("_x.s") - F.col("_need")
    cut = F.struct(F.col("_x.u").alias("lo"), (F.col("_x.u") + 1).alias("hi"), F.lit(TOP).alias("most"))
    new = {"_need": over, "_most": F.floor(over).cast("long"), "_less": ~F.col("_less"), "_lo": F.lit(0).cast("long")}
    return state.join(one, "_k").withColumns(_moved(cut) | new).select(*state.columns)


def rounded(rows: DataFrame, groups: DataFrame, few: bool, scratch: Scratch) -> DataFrame:
    """groups with _cuts, _undo and _parts: which rows (_group, _size, _u) are taken once more than floor(_rate) times.

    Each size class gives its share, by the order of its rows' keys; the row at its border is taken if that is nearer, and the rest
    is carried on to the next smaller class. What all classes together leave open is filled by rows not yet taken, or taken back, as
    far as whole rows fit, larger ones first; where that is not near, after the smallest that doesn't fit. So a few very long texts don't decide how near the target is. Equal rows share a key;
    at a border as many of them as fit are taken.
    """
    need = F.greatest(F.lit(0.0), F.col("_target") - F.floor("_rate") * F.col("size"))
    classes = rows.filter("_size > 0").groupBy("_group", F.expr(f"_u div {SPAN}L").alias("_class")).agg(F.sum("_size").alias("_all"), F.count("*").alias("_rows"))
    each = _meet(classes, groups.select("_k", "_group", "size", need.alias("_owed")), few)
    each = each.select(
        (F.col("_k") * 64 + F.col("_class")).alias("_k"), "_group", (F.col("_owed") * F.col("_all") / F.col("size")).alias("_need"), "_rows",
        (F.col("_class") * SPAN).alias("_lo"), ((F.col("_class") + 1) * SPAN).alias("_end"), F.lit(TOP).alias("_most"),
    )
    left = F.col("_need") - F.col("_before")
    fit = F.when(F.col("_n") > 1, F.floor(left / F.col("_s"))).otherwise(0).cast("long")
    rest, part = left - fit * F.coalesce("_s", F.lit(0)), F.struct(F.col("_u").alias("u"), fit.alias("n"))
    each = _border(rows, scratch.written(each, "mix-classes"), few, scratch)
    one = F.struct("_k", rest.alias("rest"), F.when(F.col("_n") == 1, F.col("_s")).alias("s"), F.col("_lo").alias("lo"), F.coalesce("_u", "_end").alias("hi"), F.col("_most").alias("most"))
    each = each.groupBy(F.expr("_k div 64").alias("_k")).agg(F.sort_array(F.collect_list(one)).alias("_each"), F.collect_list(F.when(fit > 0, part)).cast(PARTS).alias("_parts"), F.sum("_rows").alias("_rows"))

    def carried(held: Column, x: Column) -> Column:
        owed = held["owed"] + x["rest"]
        more = F.coalesce(owed >= 0.5 * x["s"], F.lit(False))
        cut = F.struct(x["lo"].alias("lo"), F.when(more, x["hi"] + 1).otherwise(x["hi"]).alias("hi"), x["most"].alias("most"))
        return F.struct(F.when(more, owed - x["s"]).otherwise(owed).alias("owed"), F.concat(held["cuts"], F.array(cut)).cast(CUTS).alias("cuts"))

    each = each.withColumn("_x", F.aggregate("_each", F.struct(F.lit(0.0).alias("owed"), F.array().cast(CUTS).alias("cuts")), carried))
    state = groups.select("_k", "_group", "_target", need.alias("_owed")).join(each, "_k", "left")
    none = lambda kind: F.array().cast(kind)
    owed = F.coalesce("_x.owed", F.lit(0.0))
    state = state.select(
        "_k", "_group", "_target", F.abs(owed).alias("_need"), (owed < 0).alias("_less"), F.lit(0).cast("long").alias("_lo"), F.lit(TOP).alias("_end"), F.floor(F.abs(owed)).cast("long").alias("_most"),
        F.coalesce("_x.cuts", none(CUTS)).alias("_cuts"), none(CUTS).alias("_undo"), F.coalesce("_parts", none(PARTS)).alias("_parts"), F.coalesce("_rows", F.lit(0)).alias("_rows"),
    )
    state = _settled(rows, scratch.written(state, "mix-state"), few, scratch)
    is_open = state.filter(_is_open())
    if not is_open.isEmpty():
        other = _settled(rows, scratch.written(_swapped(rows, is_open, few), "mix-state"), few, scratch)
        best = state.unionByName(other).groupBy("_k").agg(F.min_by(F.struct("_cuts", "_undo", "_parts"), "_need").alias("_x"))
        return groups.join(best.select("_k", "_x.*"), "_k")
    return groups.join(state.select("_k", "_cuts", "_undo", "_parts"), "_k")


def _copied(rows: DataFrame, some_parts: bool) -> DataFrame:
    """rows (_size, _u, _rate, _cuts, _parts, ...) with _copies."""
    base = F.floor("_rate") + _chosen().cast("long")
    out = rows.withColumn("_copies", F.when(F.col("_size") > 0, base).otherwise(0).cast("long"))
    if not some_parts:
        return out
    out = out.withColumn("_share", F.when(F.col("_size") > 0, F.get(F.filter("_parts", lambda p: p["u"] == F.col("_u")), F.lit(0))["n"]))
    place = F.row_number().over(Window.partitionBy("_k", "_u").orderBy(F.xxhash64(*[F.col(c) for c, kind in rows.dtypes if "map<" not in kind])))
    shared = out.filter("_share is not null").withColumn("_copies", F.floor("_rate") + (place <= F.col("_share")).cast("long"))
    return out.filter("_share is null").unionByName(shared).drop("_share")


def _keyed(docs: DataFrame, source: str, doc_id: str, text: Column, size: Column) -> dict[str, Column]:
    """What a row needs for the mix: its group, size and key, which depends on id and text alone."""
    drawn = F.shiftrightunsigned(F.xxhash64(F.col(doc_id).cast("string"), text, F.lit(7)), 8)
    size_class = F.floor(F.log2(F.greatest(size, F.lit(1)))).cast("long")
    return {"_group": F.col(source).cast("string"), "_size": size, "_u": (63 - size_class) * SPAN + drawn}


def _plan(docs: DataFrame, columns: dict[str, Column], extra: list[Column], weights: tuple[float, ...], cap: float, scratch: Scratch, most_groups: int) -> tuple[DataFrame, DataFrame, bool, bool]:
    """(narrow rows, groups with their plan, whether the groups are few, whether there are parts)."""
    slim = scratch.written(docs.select(*extra, *[c.alias(n) for n, c in columns.items()]), "mix-sizes")
    groups = scratch.written(slim.groupBy("_group").agg(F.sum("_size").alias("size")), "mix-cells")
    few = groups.limit(most_groups + 1).count() <= most_groups
    groups = scratch.written(targets_of(groups, weights, cap, scratch), "mix-targets")
    groups = written(rounded(slim, groups, few, scratch), "mix-plan")
    return slim, groups, few, not groups.filter(F.size("_parts") > 0).isEmpty()


def mix(docs: DataFrame, *, source: str = "source", doc_id: str = "doc_id", text: str = "text", size: Column | None = None, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, most_groups: int = FEW_GROUPS) -> DataFrame:
    """_id, _size, _group, _source_size, _target, _copies of each row of docs.

    Sources by code point, null last, weigh `weights` in turn. Null texts and texts without words have size 0 and 0 copies; repeated
    rows are rows of their own; rows without an id are told apart by their text; an empty table gives an empty result; other columns
    are not read. One pass over the texts, of any length, writes ids, sources and sizes; the borders are found from sums over that
    narrow table, so a hot source is no single task. Beyond `most_groups` sources they meet their rows in a shuffle, not a broadcast.
    """
    with Scratch(docs.sparkSession) as scratch:
        columns = _keyed(docs, source, doc_id, F.col(text), size_of(text) if size is None else size)
        slim, groups, few, parts = _plan(docs, columns, [F.col(doc_id).alias("_id")], weights, cap, scratch, most_groups)
        rows = _meet(slim, groups, few)
        return written(_copied(rows, parts).select("_id", "_size", "_group", F.col("size").alias("_source_size"), "_target", "_copies"), "mix")


def taken(docs: DataFrame, *, source: str = "source", doc_id: str = "doc_id", text: str = "text", weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, most_groups: int = FEW_GROUPS) -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it. Texts are not shuffled: a row's copies follow from itself and its source's plan.

    Null, empty and repeated texts, missing ids and empty tables are treated as in `mix`: what has no words is not taken.
    """
    columns = _keyed(docs, source, doc_id, F.col(text), size_of(text))
    with Scratch(docs.sparkSession) as scratch:
        _, groups, few, parts = _plan(docs, columns, [], weights, cap, scratch, most_groups)
    names = {c: f"__q_{i}" for i, c in enumerate(docs.columns)}  # columns may clash with the plan's
    rows = docs.select(*[F.col(c).alias(n) for c, n in names.items()], *[c.alias(n) for n, c in columns.items()])
    rows = _copied(_meet(rows, groups, few), parts).filter("_copies > 0")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*[F.col(n).alias(c) for c, n in names.items()])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"))
