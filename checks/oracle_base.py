"""SQL text of the fixture, prepended to the oracle queries as common table expressions."""

HIST = """
WITH course_map AS (
  SELECT * FROM (VALUES
    (0,'ACCTCY','2036'),(1,'ACCTCY','_2037'),(2,'ACCTCY','2258W'),(3,'MANGMT','3000'),
    (4,'MANGMT','3540'),(5,'MRKTNG','3000H'),(6,'BUS_AD','3500'),(7,'MANGMT','3300'),
    (8,'MANGMT','4970W'),(9,'FINANC','3000'),(10,'STAT','2500'),(11,'STAT','2200'),
    (12,'STAT','1200'),(13,'STAT','1300'),(14,'STAT','1400'),(15,'ECONOM','_1014'),
    (16,'ABM','1041'),(17,'ECONOM','1015'),(18,'ECONOM','1051'),(19,'ABM','1042'),
    (20,'ACCTCY','2027'),(21,'ACCTCY','2137'),(22,'ACCTCY','2136'),(23,'ENGLISH','1000')
  ) AS t(k, subject, catalog_nbr)
),
base AS (
  SELECT lpad(CAST(o.o_custkey AS VARCHAR(20)), 8, '0') AS emplid,
         concat(CAST(year(o.o_orderdate) - 1972 AS VARCHAR(4)),
                CASE WHEN month(o.o_orderdate) <= 5 THEN '27'
                     WHEN month(o.o_orderdate) <= 7 THEN '35' ELSE '43' END) AS strm,
         m.subject, m.catalog_nbr,
         CAST(10000 + m.k AS VARCHAR(8)) AS class_nbr, lpad(CAST(m.k AS VARCHAR(8)), 6, '0') AS crse_id,
         CASE c.c_mktsegment WHEN 'BUILDING' THEN 'ACCT_BSACC' WHEN 'HOUSEHOLD' THEN 'BUSAD_BSBA'
              WHEN 'MACHINERY' THEN 'UNDEC_BUS' ELSE 'OTHER' END AS acad_plan,
         CASE o.o_orderpriority WHEN '1-URGENT' THEN 'FIN_BANK' WHEN '2-HIGH' THEN 'REAL_EST'
              WHEN '3-MEDIUM' THEN '' ELSE 'GENERAL' END AS acad_subplan,
         CASE WHEN l.l_returnflag = 'N' THEN CAST(1 + l.l_linenumber % 4 AS DOUBLE)
              WHEN l.l_returnflag = 'A' THEN CAST(0 AS DOUBLE)
              WHEN l.l_linestatus = 'F' THEN CAST(99 AS DOUBLE) END AS grd_pts_per_unit,
         CASE WHEN l.l_returnflag = 'A' AND l.l_linestatus = 'F' THEN 'F' ELSE '' END AS crse_grade_input,
         CASE WHEN l.l_returnflag = 'R' AND l.l_linestatus = 'F' AND l.l_linenumber % 2 = 1 THEN 'TRANSFER'
              WHEN l.l_returnflag = 'R' AND l.l_linestatus = 'F' THEN 'TEST' ELSE 'MU' END AS course_source,
         CAST(3 AS DOUBLE) AS unt_taken,
         l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN course_map m ON p.p_size % 24 = m.k
),
hours AS (
  SELECT base.*, CAST(3 * count(*) OVER (PARTITION BY emplid ORDER BY strm) AS DOUBLE) AS tot_cumulative
  FROM base
)
SELECT hours.*,
       CASE WHEN tot_cumulative < 30 THEN 'FRESHMAN' WHEN tot_cumulative < 60 THEN 'SOPHOMORE'
            WHEN tot_cumulative < 90 THEN 'JUNIOR' WHEN tot_cumulative < 150 THEN 'SENIOR'
            WHEN tot_cumulative < 180 THEN '2ND BACH' ELSE 'MASTERS' END AS um_clevel_descr,
       CASE WHEN acad_plan IN ('ACCT_BSACC','BUSAD_BSBA') THEN 1 ELSE 0 END AS bus_maj
FROM hours
"""

SOURCES = {
    "src_enrl": """
SELECT emplid, strm, class_nbr,
  CASE WHEN l_linenumber = 7 THEN 'D' ELSE 'E' END AS stdnt_enrl_status, CASE WHEN l_partkey % 17 = 0 THEN 'WDRW' ELSE 'ENRL' END AS enrl_status_reason,
  CASE WHEN l_suppkey % 10 = 0 THEN 'NON' ELSE 'GRD' END AS grading_basis_enrl,
  CASE WHEN l_suppkey % 7 = 0 THEN 'NING' WHEN l_suppkey % 7 = 1 THEN NULL ELSE 'ORIG' END AS repeat_code, crse_grade_input, crse_grade_input AS crse_grade_off, grd_pts_per_unit, unt_taken, unt_taken * grd_pts_per_unit AS grade_points,
  CASE WHEN acad_plan = 'OTHER' THEN 'ARTSU' ELSE 'BUSNU' END AS acad_prog
FROM hist WHERE course_source = 'MU'
""",
    "src_class": """
SELECT DISTINCT class_nbr, strm, crse_id, subject, catalog_nbr,
  CASE WHEN subject IN ('ACCTCY','MANGMT','MRKTNG','FINANC','BUS_AD') THEN 'CBUSN' ELSE 'CARTS' END AS acad_group,
  CASE WHEN subject IN ('ACCTCY','MANGMT','MRKTNG','FINANC','BUS_AD') THEN 'Business' ELSE 'Arts' END AS acad_group_ldesc,
  CASE WHEN strm LIKE '%35' THEN '6W' ELSE '1' END AS session_code,
  lpad(CAST(CAST(class_nbr AS INT) % 3 + 1 AS VARCHAR), 3, '0') AS class_section, concat(subject, ' class') AS class_ldesc,
  concat('T', strm) AS strm_sdesc, concat(subject, ' ', catalog_nbr) AS subject_ldesc
FROM hist
""",
    "src_progress": """
SELECT DISTINCT emplid, strm, concat('T', strm) AS term, acad_plan, acad_subplan, tot_cumulative, CAST(3 AS DOUBLE) AS cum_gpa, CAST(15 AS DOUBLE) AS unt_taken_prgrss
FROM hist
""",
    "src_census": """
SELECT DISTINCT emplid, strm, CASE WHEN CAST(emplid AS INT) % 19 = 0 THEN 'GRAD' ELSE 'UGRD' END AS acad_career,
  CASE WHEN CAST(emplid AS INT) % 11 = 0 THEN 'N' ELSE 'Y' END AS um_deg_seeking,
  CASE WHEN acad_plan = 'OTHER' THEN 'College of Arts' ELSE 'College of Business' END AS um_acad_grp_descr,
  CASE WHEN acad_plan = 'ACCT_BSACC' THEN 'BUSNU' ELSE 'ARTSU' END AS um_acad_prog1,
  CASE WHEN acad_plan = 'BUSAD_BSBA' THEN 'BUSNU' END AS um_acad_prog2,
  CASE WHEN acad_plan = 'UNDEC_BUS' THEN 'BUSNU' END AS um_acad_prog3, CASE WHEN acad_plan = 'OTHER' AND CAST(emplid AS INT) % 4 = 0 THEN 'BUSNU' END AS um_acad_prog4, um_clevel_descr,
  'UMCOL' AS institution, concat('T', strm) AS descr_term, acad_plan AS um_acad_plan1, acad_subplan AS um_acad_sub_plan1,
  CAST(CAST(emplid AS INT) % 500 AS DOUBLE) AS class_rank,
  CASE WHEN CAST(emplid AS INT) % 13 <> 0 THEN CAST(2300 + CAST(emplid AS INT) % 97 AS VARCHAR(4)) END AS admit_term
FROM hist
""",
    "src_admit": """
SELECT DISTINCT emplid,
  CASE WHEN CAST(emplid AS INT) % 13 = 0 AND strm > '2700' THEN NULL ELSE strm END AS admit_term_rollup,
  CASE WHEN CAST(emplid AS INT) % 13 = 0 AND strm > '2700' THEN NULL ELSE concat('T', strm) END AS admit_term_rollup_descrshort,
  CASE WHEN CAST(emplid AS INT) % 23 = 0 THEN 'GRAD' ELSE 'UGRD' END AS acad_career,
  CASE WHEN CAST(emplid AS INT) % 17 = 0 THEN 'N' ELSE 'Y' END AS um_deg_seeking,
  CASE WHEN CAST(emplid AS INT) % 5 = 0 THEN 'TRE' WHEN CAST(emplid AS INT) % 5 = 1 THEN 'RTR' ELSE 'FTC' END AS admit_type,
  CASE WHEN acad_plan = 'OTHER' THEN 'CARTS' ELSE 'CBUSN' END AS acad_group
FROM hist
""",
    "src_transfer": """
SELECT emplid, crse_id, strm AS articulation_term,
  CASE WHEN l_linenumber = 5 THEN 'N' WHEN l_linenumber = 3 THEN 'P' ELSE 'Y' END AS trnsfr_stat,
  CASE WHEN l_suppkey % 4 = 0 THEN 'D' WHEN l_suppkey % 4 = 1 THEN 'A-' ELSE 'B' END AS crse_grade_off
FROM hist WHERE course_source = 'TRANSFER'
""",
    "src_test": """
SELECT emplid, crse_id, strm AS articulation_term,
  CASE WHEN l_linenumber = 6 THEN 'N' ELSE 'Y' END AS trnsfr_stat, 'S' AS crse_grade_off
FROM hist WHERE course_source = 'TEST'
""",
}
