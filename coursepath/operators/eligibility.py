"""Terms in which a student was eligible for a course and had not enrolled."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import not_nan, packed_order
from ..sources.local import local_table
from .bits import BitIndex, quoted
from .rules import CURRENT_RULES, Rule, V1_RULES
from .status import base_flag, in_base, status_code


def term_summary(
    df: DataFrame, courses, *, points: str = "grd_pts_per_unit", flag: str = "bus_maj"
) -> DataFrame:
    """Per student and term: hours, flag, levels, and which of ``courses`` were taken and passed."""
    courses = list(dict.fromkeys(courses))
    listed = F.when(F.col("class").isin(*courses), F.col("class"))
    return df.groupBy("emplid", "strm").agg(
        F.max(not_nan(F.col("tot_cumulative"))).alias("max_hours"),
        F.max(flag).alias("flag"),
        F.array_sort(F.collect_set(F.upper("um_clevel_descr"))).alias("levels"),
        F.array_sort(F.collect_set(listed)).alias("classes_taken"),
        F.array_sort(F.collect_set(F.when(not_nan(F.col(points)) > 0, listed))).alias("classes_passed"),
    )


def with_term_index(df: DataFrame, out: str = "term_idx") -> DataFrame:
    """Distinct student terms, numbered from 0 in order."""
    order = Window.partitionBy("emplid").orderBy("strm")
    return df.select("emplid", "strm").distinct().withColumn(out, F.row_number().over(order) - 1)


class _Plan:
    """The bit layout of one rule set."""

    def __init__(self, rules):
        self.rules: dict[str, Rule] = {}
        for rule in rules:
            self.rules.setdefault(rule.target, rule)
        self.targets = BitIndex(self.rules)
        self.courses = BitIndex(c for r in self.rules.values() for clause in r.clauses for c in clause)
        self.levels = BitIndex(v for r in self.rules.values() for v in r.levels)
        self.from_start = self.targets.mask(t for t, r in self.rules.items() if r.unconditional)
        self.everything = self.targets.mask(self.rules)

    def vocabulary(self, spark) -> DataFrame:
        """Bits of every course the rules name, and the place of each target; one row per course, so always small."""
        names = list(dict.fromkeys([*self.targets.names, *self.courses.names]))
        places = {name: k for k, name in enumerate(self.targets.names)}
        table: dict[str, object] = {"class": names, "target_no": pa.array([places.get(n) for n in names], pa.int32())}
        for prefix, index in (("is_target", self.targets), ("is_course", self.courses)):
            masks = [index.mask([n] if n in index else []) for n in names]
            for w, column in enumerate(index.columns(prefix)):
                table[column] = pa.array([m[w] for m in masks], pa.int64())
        return local_table(spark, **table)

    def condition(self, rule: Rule) -> str:
        """SQL: whether the rule holds with the data of this term and the passes up to it."""
        parts = []
        if rule.min_hours is not None:
            parts.append(f"hours >= {float(rule.min_hours)!r}D")
        if rule.levels:
            parts.append(self.levels.meets("level", rule.levels))
        if rule.need_flag:
            parts.append("flag = 1")
        parts += [self.courses.meets("have", clause) for clause in rule.clauses]
        return " AND ".join(parts) or "FALSE"


def _or_over(columns: list[str], frame, out: list[str]) -> list[Column]:
    """Running OR of bit-set columns; an empty frame gives the empty set."""
    return [
        F.coalesce(F.bit_or(column).over(frame), F.lit(0).cast("long")).alias(name)
        for column, name in zip(columns, out)
    ]


def _any_of(columns: list[str], out: list[str]) -> list[Column]:
    return [F.coalesce(F.bit_or(c), F.lit(0).cast("long")).alias(name) for c, name in zip(columns, out)]


@dataclass(frozen=True)
class _Writes:
    """How the rows of a target course write its status: the greatest ``key`` of a term counts, and says ``status``."""

    key: Column
    status: Callable[[Column], Column]
    last_wins: bool

    @classmethod
    def of(cls, df: DataFrame, mode: str, points: str, tiebreak) -> _Writes:
        code = status_code(mode, points)
        if mode != "latest":
            return cls(code, lambda key: key, False)
        packed = packed_order(df, tiebreak, code, 2)
        if packed is not None:
            return cls(*packed, True)
        # Texts and wide numbers have no fixed width together, so this maximum sorts in place of hashing.
        return cls(F.struct(*[F.col(c) for c in tiebreak], code.alias("status")), lambda key: key["status"], True)


def _student_terms(
    df: DataFrame, plan: _Plan, passed: Column, taken: Column, flag: str, last_term, base, writes: _Writes | None = None
) -> DataFrame:
    """One row per student and term with the bit sets ``taken``, ``pass`` and ``level``.

    Everything has a fixed width, so each task combines its rows by hash before the shuffle, and a
    student with very many rows arrives as one row per term. With ``writes``, the last write of each target comes out of the same scan
    on rows of its own, and joins its term's row as the sets ``done_now`` and ``tried_now``.
    """
    # A local relation of one row per course named in the rules: Spark knows its size and joins by it.
    rows = df.join(plan.vocabulary(df.sparkSession), "class", "left")
    is_level = {v: f"upper(um_clevel_descr) = {quoted(v)}" for v in plan.levels.names}
    needs_flag = any(r.need_flag for r in plan.rules.values())
    rows = rows.select(
        "emplid",
        "strm",
        not_nan(F.col("tot_cumulative")).alias("hours"),
        (F.col(flag) if needs_flag else F.lit(0)).cast("int").alias("flag"),
        base_flag(last_term, base).alias("in_base"),
        *plan.levels.gather(is_level, "level"),
        *[F.when(taken, F.col(f"is_{c}")).alias(c) for c in plan.targets.columns("target")],
        *[F.when(passed, F.col(f"is_{c}")).alias(c) for c in plan.courses.columns("course")],
        *([F.col("target_no"), writes.key.alias("write")] if writes else []),
    )
    bits = [*plan.levels.columns("level"), *plan.targets.columns("target"), *plan.courses.columns("course")]
    names = [*plan.levels.columns("level"), *plan.targets.columns("taken"), *plan.courses.columns("pass")]
    most = [F.max(c).alias(c) for c in ("hours", "flag", "in_base")]
    if writes is None:
        return rows.groupBy("emplid", "strm").agg(*most, *_any_of(bits, names))
    both = F.when(F.col("target_no").isNotNull(), F.array(F.lit(-1), "target_no")).otherwise(F.array(F.lit(-1)))
    rows = rows.withColumn("event", F.explode(both))
    rows = rows.withColumns({c: F.when(F.col("event") < 0, F.col(c)) for c in ["hours", "flag", *bits]})
    last = F.max(F.when(F.col("event") >= 0, F.col("write"))).alias("write")
    # Dealt out by student here, so that terms, windows and students need no other shuffle.
    events = rows.groupBy("emplid", "strm", "event").agg(*most, *_any_of(bits, names), last).repartition("emplid")
    status, masks = writes.status(F.col("write")), plan.targets.mask_at("event")
    written = [
        F.bit_or(F.when(status == value, F.expr(mask)).otherwise(F.lit(0).cast("long"))).alias(name)
        for value, prefix in ((2, "done_now"), (1, "tried_now"))
        for mask, name in zip(masks, plan.targets.columns(prefix))
    ]
    return events.groupBy("emplid", "strm").agg(*most, *_any_of(names, names), *written)


def _eligible_rows(terms: DataFrame, plan: _Plan) -> DataFrame:
    """Adds the term number and ``open``: the targets whose rule was met in an earlier term."""
    order = Window.partitionBy("emplid").orderBy("strm")
    up_to_now = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    terms = terms.select(
        "*",
        F.row_number().over(order).alias("nth"),
        *_or_over(plan.courses.columns("pass"), up_to_now, plan.courses.columns("have")),
        *_or_over(plan.targets.columns("taken"), earlier, plan.targets.columns("gone")),
    )
    terms = terms.select("*", *_met(plan))
    opened = _or_over(plan.targets.columns("met"), earlier, plan.targets.columns("open"))
    return terms.select("*", *_from_start(plan, opened))


def _met(plan: _Plan) -> list[Column]:
    """The targets whose stated conditions hold with the columns at hand."""
    return plan.targets.gather({t: plan.condition(r) for t, r in plan.rules.items() if not r.unconditional}, "met")


def _from_start(plan: _Plan, opened: list[Column]) -> list[Column]:
    return [c.bitwiseOR(F.lit(m)).alias(n) for c, m, n in zip(opened, plan.from_start, plan.targets.columns("open"))]


def _counted(plan: _Plan, skip_suffix: str | None) -> list[Column]:
    """The targets that a term counts for: it is not the first, the target is open and was not taken before, and no summer is skipped."""
    skipped = F.lit(False) if skip_suffix is None else F.col("strm").endswith(skip_suffix)
    names = plan.targets.columns
    return [
        F.when(
            F.col("nth") > 1,
            F.col(opened)
            .bitwiseAND(F.bitwise_not(F.col(gone)))
            .bitwiseAND(F.when(skipped, F.col(taken)).otherwise(F.lit(everything))),
        )
        .otherwise(F.lit(0).cast("long"))
        .alias(name)
        for opened, gone, taken, everything, name in zip(names("open"), names("gone"), names("taken"), plan.everything, names("counted"))
    ]


def _students(terms: DataFrame, plan: _Plan, writes: _Writes | None) -> DataFrame:
    """One row per student: counters, and with ``writes`` the sets of targets ``done`` and ``tried``; and what another term would go on from.

    ``terms`` are partitioned by student, so nothing is shuffled here.
    """
    names = plan.targets.columns
    lanes = [F.sum(F.expr(sql)).alias(lane) for sql, lane in zip(plan.targets.spread("counted"), plan.targets.lanes("lane"))]
    state = [
        F.max("in_base").alias("in_base"),
        F.max("nth").alias("n_terms"),
        F.max("strm").alias("last_term"),
        *_any_of(plan.courses.columns("pass"), plan.courses.columns("have")),
        *_any_of(names("taken"), names("gone")),
        *_any_of(names("met"), names("opened")),
    ]
    if writes is None:
        return terms.groupBy("emplid").agg(*state, *lanes)
    words = list(zip(*(names(prefix) for prefix in ("done_now", "tried_now", "later", "done", "tried"))))
    if writes.last_wins:
        following = Window.partitionBy("emplid").orderBy("strm").rowsBetween(1, Window.unboundedFollowing)
        later = [F.bit_or(F.col(done).bitwiseOR(F.col(tried))).over(following) for done, tried, *_ in words]
    else:
        later = [F.lit(0).cast("long") for _ in words]
    zero = F.lit(0).cast("long")
    terms = terms.select("*", *[F.coalesce(c, zero).alias(word[2]) for c, word in zip(later, words)])
    sets = [
        F.bit_or(F.col(now).bitwiseAND(F.bitwise_not(F.col(after)))).alias(out)
        for done_now, tried_now, after, done, tried in words
        for now, out in ((done_now, done), (tried_now, tried))
    ]
    students = terms.groupBy("emplid").agg(*state, *lanes, *sets)
    return students.withColumns({tried: F.col(tried).bitwiseAND(F.bitwise_not(F.col(done))) for *_, done, tried in words})


def _results(students: DataFrame, plan: _Plan, base: DataFrame | None) -> DataFrame:
    """The base students; those without rows have zeros."""
    filled = in_base(students, base)
    return filled.na.fill(0, subset=[c for c in filled.columns if c not in ("emplid", "last_term")])


def _long(students: DataFrame, plan: _Plan, with_status: bool) -> DataFrame:
    """A row for each target, with the status if there is one and the counter. One expression, however many targets."""
    status = f"'status', IF({plan.targets.holds_at('done', 'i')}, 2, IF({plan.targets.holds_at('tried', 'i')}, 1, 0)), " if with_status else ""
    row = f"named_struct('place', i, {status}'sem_eli', {plan.targets.counter_at('lane', 'i')})"
    places = f"sequence(0, {len(plan.targets.names) - 1})" if plan.targets.names else "array_remove(array(0), 0)"
    rows = students.select("emplid", F.expr(f"inline(transform({places}, i -> {row}))"))
    names = f"element_at(array({', '.join(map(quoted, plan.targets.names or ['']))}), place + 1)"
    return rows.select("emplid", F.expr(names).alias("target"), *(["status"] if with_status else []), "sem_eli")


def _wide(students: DataFrame, plan: _Plan, names: dict[str, str], count_suffix: str) -> DataFrame:
    columns = []
    for t in plan.rules:
        status = F.when(plan.targets.has("done", t) == 1, 2).when(plan.targets.has("tried", t) == 1, 1).otherwise(0)
        columns += [status.alias(names.get(t, t)), plan.targets.counter("lane", t).alias(names.get(t, t) + count_suffix)]
    return students.select("emplid", *columns)


def _current(df, plan, skip_suffix, points, flag, last_term, base, writes=None) -> DataFrame:
    """One row per student under the current counter, from one pass over the history."""
    terms = _student_terms(df, plan, not_nan(F.col(points)) > 0, F.lit(True), flag, last_term, base, writes)
    terms = _eligible_rows(terms, plan)
    return _students(terms.select("*", *_counted(plan, skip_suffix)), plan, writes)


def _v1(df, plan, points, last_term, base, writes=None) -> DataFrame:
    """One row per student under the older counter: every term after the one that met the rule, up to the stop.

    The stop is the first counted term in which the target was taken, or the last term. Pass and
    take both mean points of at least 0. The first term and summers count too.
    """
    usable = not_nan(F.col(points)) >= 0
    flag_term = last_term if base is None else None
    terms = _student_terms(df, plan, usable, usable, "bus_maj", flag_term, base, writes)
    terms = _eligible_rows(terms, plan)
    is_last = F.col("strm") == last_term
    names = plan.targets.columns
    stops = [
        F.col(opened).bitwiseAND(F.when(is_last, F.lit(everything)).otherwise(F.col(taken))).alias(name)
        for opened, taken, everything, name in zip(names("open"), names("taken"), plan.everything, names("stop"))
    ]
    order = Window.partitionBy("emplid").orderBy("strm")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    terms = terms.select("*", *stops)
    terms = terms.select("*", *_or_over(names("stop"), earlier, names("over")))
    counted = [
        F.col(opened).bitwiseAND(F.bitwise_not(F.col(over))).alias(name)
        for opened, over, name in zip(names("open"), names("over"), names("counted"))
    ]
    return _students(terms.select("*", *counted), plan, writes)


def eligible_terms(
    df: DataFrame,
    rules=CURRENT_RULES,
    *,
    last_term: str | None = None,
    base: DataFrame | None = None,
    skip_suffix: str | None = fv.SUMMER_SUFFIX,
    points: str = "grd_pts_per_unit",
    flag: str = "bus_maj",
) -> DataFrame:
    """``(emplid, target, sem_eli)`` for every base student and rule.

    A term counts for a target if it is not the student's first, the rule was met in an earlier
    term, the target was in no earlier term, and it is the taking term or not a skipped one.
    Counting is one pass over the student's terms in order, for any number of rules: a target costs a bit of a
    set and a quarter of a sum.
    """
    plan = _Plan(rules)
    students = _current(df, plan, skip_suffix, points, flag, last_term, base)
    return _long(_results(students, plan, base), plan, False)


def eligible_terms_v1(
    df: DataFrame, rules=V1_RULES, *, last_term: str, base: DataFrame | None = None, points: str = "grade_points"
) -> DataFrame:
    """``(emplid, target, sem_eli)`` by the older rules."""
    plan = _Plan(rules)
    return _long(_results(_v1(df, plan, points, last_term, base), plan, base), plan, False)


def _matrix_students(df, plan, last_term, base, mode, tiebreak, skip_suffix, points) -> DataFrame:
    writes = _Writes.of(df, mode, points, tiebreak)
    return _results(_current(df, plan, skip_suffix, points, "bus_maj", last_term, base, writes), plan, base)


def student_matrix(
    df: DataFrame,
    rules=CURRENT_RULES,
    *,
    last_term: str | None = None,
    base: DataFrame | None = None,
    mode: str = "latest",
    tiebreak=(),
    skip_suffix: str | None = fv.SUMMER_SUFFIX,
    points: str = "grd_pts_per_unit",
) -> DataFrame:
    """``(emplid, target, status, sem_eli)`` for every base student and rule, in one pass over the history.

    ``tiebreak`` lists the columns that order the rows of a term. Whole numbers up to 32 bits and dates are packed into a fixed
    width; a mapping states how many bits other whole numbers need (see ``packed_order``).
    """
    plan = _Plan(rules)
    return _long(_matrix_students(df, plan, last_term, base, mode, tiebreak, skip_suffix, points), plan, True)


def student_matrix_wide(
    df: DataFrame,
    rules=CURRENT_RULES,
    *,
    last_term: str | None = None,
    base: DataFrame | None = None,
    mode: str = "latest",
    tiebreak=(),
    skip_suffix: str | None = fv.SUMMER_SUFFIX,
    points: str = "grd_pts_per_unit",
    names: dict[str, str] | None = None,
    count_suffix: str = "_SEM_ELI",
) -> DataFrame:
    """The matrix with one row per base student: a status and a counter column for each target, in the order of the rules."""
    plan = _Plan(rules)
    students = _matrix_students(df, plan, last_term, base, mode, tiebreak, skip_suffix, points)
    return _wide(students, plan, names or {}, count_suffix)


def student_matrix_v1(
    df: DataFrame,
    rules=V1_RULES,
    *,
    last_term: str,
    base: DataFrame | None = None,
    points: str = "grd_pts_per_unit",
    pass_points: str = "grade_points",
) -> DataFrame:
    """The older matrix: sticky status with the older counter, in one pass over the history."""
    plan = _Plan(rules)
    writes = _Writes.of(df, "sticky", points, ())
    return _long(_results(_v1(df, plan, pass_points, last_term, base, writes), plan, base), plan, True)


# A term at a time


def eligibility_state(
    df: DataFrame,
    rules=CURRENT_RULES,
    *,
    mode: str = "latest",
    tiebreak=(),
    skip_suffix: str | None = fv.SUMMER_SUFFIX,
    points: str = "grd_pts_per_unit",
) -> DataFrame:
    """What each student's next term goes on from: one row per student of fixed width, whatever the length of the history.

    Store it, and let ``advance_state`` add each further term from that term's rows alone. It goes with these rules and options.
    """
    plan = _Plan(rules)
    writes = _Writes.of(df, mode, points, tiebreak)
    everyone = df.select("emplid")
    students = _current(df, plan, skip_suffix, points, "bus_maj", None, everyone, writes)
    return students.drop("in_base")


def advance_state(
    state: DataFrame,
    rows: DataFrame,
    term: str,
    rules=CURRENT_RULES,
    *,
    mode: str = "latest",
    tiebreak=(),
    skip_suffix: str | None = fv.SUMMER_SUFFIX,
    points: str = "grd_pts_per_unit",
) -> DataFrame:
    """The state after ``term``, from the state before it and the rows of the term.

    Students new in the term begin here, and students without rows in it keep their state. Terms must come in order: rows of a term
    that the state has seen already, or of an earlier one, call for the state before that term.
    """
    plan = _Plan(rules)
    writes = _Writes.of(rows, mode, points, tiebreak)
    rows = rows.where(F.col("strm") == term)
    now = _student_terms(rows, plan, not_nan(F.col(points)) > 0, F.lit(True), "bus_maj", None, rows, writes).drop("strm", "in_base")
    names = plan.targets.columns
    sets = [*plan.courses.columns("have"), *names("gone"), *names("opened"), *names("done"), *names("tried"), *plan.targets.lanes("lane")]
    old = state.select("emplid", F.col("n_terms").alias("old_terms"), F.col("last_term").alias("old_last"), *[F.col(c).alias(f"old_{c}") for c in sets])
    both = old.join(now.withColumn("here", F.lit(True)), "emplid", "full_outer")
    zero = F.lit(0).cast("long")
    here = F.coalesce("here", F.lit(False))

    def was(c: str) -> Column:
        return F.coalesce(F.col(f"old_{c}"), zero)

    def after(c: str, value: Column) -> Column:
        return F.when(here, value).otherwise(was(c)).alias(c)

    both = both.select(
        "*",
        F.lit(term).alias("strm"),
        (F.coalesce("old_terms", F.lit(0)) + here.cast("int")).alias("nth"),
        *[after(have, was(have).bitwiseOR(F.coalesce(F.col(passed), zero))) for have, passed in zip(plan.courses.columns("have"), plan.courses.columns("pass"))],
        *_from_start(plan, [was(c) for c in names("opened")]),
        *[was(c).alias(c) for c in names("gone")],
    )
    both = both.select("*", *_met(plan), *_counted(plan, skip_suffix))
    lanes = [after(lane, was(lane) + F.expr(sql)) for sql, lane in zip(plan.targets.spread("counted"), plan.targets.lanes("lane"))]
    written = []
    for done, tried, now_done, now_tried in zip(*(names(p) for p in ("done", "tried", "done_now", "tried_now"))):
        again = F.bitwise_not(F.col(now_done).bitwiseOR(F.col(now_tried))) if writes.last_wins else F.lit(-1).cast("long")
        all_done = was(done).bitwiseAND(again).bitwiseOR(F.col(now_done))
        all_tried = was(tried).bitwiseAND(again).bitwiseOR(F.col(now_tried)).bitwiseAND(F.bitwise_not(all_done))
        written += [after(done, all_done), after(tried, all_tried)]
    return both.select(
        "emplid",
        F.col("nth").alias("n_terms"),
        F.when(here, F.lit(term)).otherwise(F.col("old_last")).alias("last_term"),
        *plan.courses.columns("have"),
        *[after(c, was(c).bitwiseOR(F.col(t))) for c, t in zip(names("gone"), names("taken"))],
        *[after(c, was(c).bitwiseOR(F.col(m))) for c, m in zip(names("opened"), names("met"))],
        *lanes,
        *written,
    )


def matrix_of_state(state: DataFrame, term: str, rules=CURRENT_RULES) -> DataFrame:
    """``(emplid, target, status, sem_eli)`` of the students who have rows in ``term``, the last that the state has seen."""
    return _long(state.where(F.col("last_term") == term), _Plan(rules), True)
