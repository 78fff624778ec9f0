"""Explicit schemas. Identifiers and codes are strings, so leading zeros stay."""

from __future__ import annotations

from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

from ..fixed_values import CENSUS_LISTING_COLUMNS, CENSUS_NUMBERS


def _struct(**types) -> StructType:
    return StructType([StructField(name, t, True) for name, t in types.items()])


_S, _D, _I, _T = StringType(), DoubleType(), IntegerType(), TimestampType()

# The long course history: one row per student, term and course.
HISTORY_SCHEMA = _struct(
    emplid=_S, strm=_S, term=_S, course_source=_S, admit_term=_S, admit_term_desc=_S,
    um_clevel_descr=_S, acad_prog=_S, acad_plan=_S, acad_subplan=_S, bus_maj=_I,
    subject=_S, catalog_nbr=_S, class_nbr=_S, crse_grade_input=_S, grd_pts_per_unit=_D,
    unt_taken=_D, unt_taken_prgrss=_D, grade_points=_D, cum_gpa=_D, tot_cumulative=_D,
    tot_hrs_life=_D,
)

# The rule table. ``levels`` is ``A|B``; ``clauses`` is ``A|B;C|D`` (all of ``;``, any of ``|``). ``ord`` orders the
# rows: of a target's rows the least counts.
RULE_SCHEMA = _struct(
    ord=_I, target=_S, condreq=_I, min_hours=_D, levels=_S, need_flag=_I, clauses=_S,
)

SOURCE_SCHEMAS = {
    # The columns of the census listing, and the program slots it leaves out.
    "census": _struct(
        **{name: _D if name in CENSUS_NUMBERS else _S for name in CENSUS_LISTING_COLUMNS},
        um_acad_prog3=_S, um_acad_prog4=_S,
    ),
    "enrolment": _struct(
        emplid=_S, strm=_S, class_nbr=_S, stdnt_enrl_status=_S, enrl_status_reason=_S,
        grading_basis_enrl=_S, repeat_code=_S, crse_grade_off=_S, crse_grade_input=_S,
        grd_pts_per_unit=_D, grade_points=_D, unt_taken=_D, acad_prog=_S, last_upd_dt_stmp=_T,
    ),
    "class_dim": _struct(
        class_nbr=_S, strm=_S, crse_id=_S, subject=_S, catalog_nbr=_S, acad_group=_S,
        acad_group_ldesc=_S, strm_sdesc=_S, session_code=_S, class_section=_S, class_ldesc=_S,
        subject_ldesc=_S,
    ),
    "progress": _struct(
        emplid=_S, strm=_S, term=_S, acad_plan=_S, acad_subplan=_S, unt_taken_prgrss=_D,
        cum_gpa=_D, tot_cumulative=_D,
    ),
    "admissions": _struct(
        emplid=_S, strm=_S, admit_term_rollup=_S, admit_term_rollup_descrshort=_S, admit_type=_S,
        um_deg_seeking=_S, acad_career=_S, acad_group=_S, ever_admit=_S, is_deposit_paid=_S,
        is_cancel=_S,
    ),
    "transfer": _struct(
        emplid=_S, crse_id=_S, articulation_term=_S, trnsfr_stat=_S, crse_grade_off=_S,
    ),
    "test_credit": _struct(
        emplid=_S, crse_id=_S, articulation_term=_S, trnsfr_stat=_S, crse_grade_off=_S,
    ),
}
