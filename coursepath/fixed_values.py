"""Codes and constants that must match the source system for right results."""

# Fixed values, kept as the source system spells them.

# Courses
BUSINESS_SUBJECTS = ("BUS_AD", "MANGMT", "MRKTNG", "FINANC", "ACCTCY")
EXPORT_TARGETS = ("FINANC_3000", "MRKTNG_3000", "MANGMT_3000")
CATALOG_DEFAULT = "0000"

# Plans and subplans
EXTRACT_PLANS = ("UNDEC_BUS", "BUSAD_BSBA", "ACCT_BSACC")
MAJOR_PLANS = ("ACCT_BSACC", "BUSAD_BSBA")
REPORT_PLANS = ("ACCT_BSACC", "BUSAD_BSBA", "UNDEC_BUS")
TAIL_SUBPLANS = ("FIN_BANK", "REAL_EST")

# Class levels, in order
UNDERGRAD_LEVELS = ("FRESHMAN", "SOPHOMORE", "JUNIOR", "SENIOR")
REPORT_LEVELS = ("FRESHMAN", "SOPHOMORE", "JUNIOR", "SENIOR", "MASTERS")
DROPPED_LEVEL = "2ND BACH"
NO_LEVEL_LABEL = "TRANS/TEST"

# Census, admissions and enrolment codes
CAREER = "UGRD"
COLLEGE = "College of Business"
PROGRAM = "BUSNU"
ACAD_GROUP = "CBUSN"
ADMIT_TYPES = ("FTC", "TRE")
ENROLLED = "E"
ENROLLED_REASON = "ENRL"
EXCLUDED_REPEAT = "NING"
EXCLUDED_BASIS = "NON"
CREDIT_STATUS = ("Y", "P")
CREDIT_GRADES = ("A+", "A", "A-", "B+", "B", "B-", "C+", "C", "C-", "S")
CREDIT_POINTS = 99.0
FAIL_GRADE = "F"

# Terms
FIRST_TERM = "3543"
SUMMER_SUFFIX = "35"

# Course sources
SOURCE_ENROLLED = "MU"
SOURCE_TRANSFER = "TRANSFER"
SOURCE_TEST = "TEST"

# Student columns carried into the wide table and the eligible lists
BASE_COLUMNS = (
    "emplid", "strm", "term", "admit_term", "um_clevel_descr",
    "acad_prog", "bus_maj", "cum_gpa", "tot_cumulative", "tot_hrs_life",
)
# The same for the older wide table
BASE_COLUMNS_V1 = (
    "emplid", "strm", "term", "admit_term", "admit_term_desc", "um_clevel_descr",
    "acad_prog", "acad_plan", "acad_subplan", "cum_gpa", "tot_cumulative", "tot_hrs_life",
)
# Column names of the older wide table: target and the hours by which it is usually taken
WIDE_COLUMNS_V1 = (
    "ECONOM_1014_28", "BUS_AD_1500_28", "ENGLISH_1000_28",
    "ECONOM_1015_40", "BUS_AD_2500_40", "ACCTCY_2036_40",
    "ACCTCY_2037_50", "ACCTCY_2258_50", "MANGMT_3000_50", "MANGMT_3540_50",
    "STAT_2500_60", "ECONOM_3229_60", "ECONOM_3251_60", "MRKTNG_3000_60",
    "FINANC_3000_64",
)
# Census listing
CENSUS_LISTING_COLUMNS = (
    "emplid", "um_acad_grp_descr", "um_acad_org_descr", "institution", "acad_career",
    "strm", "descr_term", "first_name", "last_name", "rec_hs_grad",
    "um_deg_seeking", "admit_type", "admit_term", "um_degreest_descr", "um_clevel",
    "um_clevel_descr", "unt_term_tot", "unt_audit", "academic_load", "fte",
    "tot_billing_hrs", "acad_prog_primary", "um_acad_prog1", "um_acad_plan1",
    "um_acad_sub_plan1", "um_acad_prog2", "um_acad_plan2", "location", "um_c_campus",
    "hs_grad_dt", "class_size", "class_rank", "um_hs_pcnt", "um_census_dt",
    "um_satr_math", "um_satr_read_wr", "um_veteran", "um_online_learner",
    "um_first_gen", "um_test_optional",
)
# Those of them that hold numbers
CENSUS_NUMBERS = (
    "unt_term_tot", "unt_audit", "fte", "tot_billing_hrs", "class_size", "class_rank", "um_hs_pcnt", "um_satr_math",
    "um_satr_read_wr",
)
