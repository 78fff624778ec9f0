"""The prerequisite rule table: data, not code."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.schemas import RULE_SCHEMA


@dataclass(frozen=True)
class Rule:
    """When a student may take ``target``.

    ``condreq`` 0 means from the start. Otherwise every stated condition must hold in one term:
    cumulative hours, class level, plan flag, and for each clause a pass in one of its courses by
    that term. A rule that states no condition is never met.
    """

    target: str
    condreq: int = 1
    min_hours: float | None = None
    levels: tuple[str, ...] = ()
    need_flag: bool = False
    clauses: tuple[tuple[str, ...], ...] = ()

    @property
    def unconditional(self) -> bool:
        return self.condreq == 0

    @property
    def states_condition(self) -> bool:
        return self.min_hours is not None or bool(self.levels) or self.need_flag or bool(self.clauses)


# The prerequisite rules.
_FINANCE_CLAUSES = (
    ("STAT_2500", "STAT_2200"),
    ("STAT_2500", "STAT_1200", "STAT_1300", "STAT_1400"),
    ("ECONOM_1014", "ABM_1041"),
    ("ECONOM_1015", "ECONOM_1051", "ABM_1042"),
    ("ACCTCY_2027", "ACCTCY_2037", "ACCTCY_2137"),
)
_STANDING = ("SOPHOMORE", "JUNIOR", "SENIOR")

ARCHIVED_RULES = (
    Rule("ACCTCY_2036", min_hours=28),
    Rule("MANGMT_3000", min_hours=28),
    Rule("ACCTCY_2037", clauses=(("ACCTCY_2036", "ACCTCY_2136"),)),
    Rule("ACCTCY_2258", levels=_STANDING),
    Rule("MANGMT_3540", min_hours=30),
    Rule("MRKTNG_3000", min_hours=45),
    Rule("FINANC_3000", min_hours=45, clauses=_FINANCE_CLAUSES),
)
CURRENT_RULES = ARCHIVED_RULES + (
    Rule("BUS_AD_3500", need_flag=True),
    Rule("MANGMT_3300", min_hours=24),
    Rule("MANGMT_4970", min_hours=102, clauses=(("MANGMT_3000",), ("MRKTNG_3000",), ("FINANC_3000",))),
)
UNCONDITIONAL_V1 = (
    "ECONOM_1014", "BUS_AD_1500", "ENGLISH_1000", "ECONOM_1015",
    "BUS_AD_2500", "STAT_2500", "ECONOM_3229", "ECONOM_3251",
)
V1_RULES = tuple(Rule(t, condreq=0) for t in UNCONDITIONAL_V1) + ARCHIVED_RULES


def rules_from_table(table: DataFrame, conditions: Iterable[Rule] = CURRENT_RULES) -> tuple[Rule, ...]:
    """Rules from a table as ``read_rules`` gives it, in the order of ``ord`` and then by target.

    Of several rows of a target, the one with the least ``ord`` counts; rows that differ and are first alike are an
    error, as files have no order in Spark. Rows that state no condition of their own take it from ``conditions``. A target
    that needs a condition but has none is kept as a rule that is never met. Rules shape the plan, so they
    come to the driver, one row a target.
    """
    stated = [c for c in RULE_SCHEMA.fieldNames() if c not in ("ord", "target")]
    rows = table.select(F.upper("target").alias("target"), "ord", F.struct(*stated).alias("rule")).where("target is not null")
    place = F.coalesce("ord", F.lit(2**31 - 1))
    firsts = rows.groupBy("target").agg(F.min(place).alias("place"))
    kept = (
        rows.withColumn("place", place)
        .join(firsts, ["target", "place"])
        .groupBy("target", "place")
        .agg(F.min("rule").alias("rule"), F.countDistinct(F.to_json("rule")).alias("kinds"))
    )
    found = sorted(kept.collect(), key=lambda r: (r.place, r.target))
    torn = [r.target for r in found if r.kinds > 1]
    if torn:
        raise ValueError(f"rows of one target disagree, and no order tells which counts: {', '.join(torn[:5])}")
    known = {rule.target: rule for rule in conditions}
    rules = []
    for r in found:
        row = r.rule
        own = Rule(
            r.target,
            min_hours=row.min_hours,
            levels=_listed(row.levels, "|"),
            need_flag=row.need_flag == 1,
            clauses=tuple(_listed(clause, "|") for clause in _listed(row.clauses, ";")),
        )
        rule = own if own.states_condition else known.get(r.target, own)
        rules.append(replace(rule, condreq=1 if row.condreq is None else row.condreq))
    return tuple(rules)


def _listed(text: str | None, by: str) -> tuple[str, ...]:
    return tuple(v.strip().upper() for v in (text or "").split(by) if v.strip())


def rules_table(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    """Rules as a table that ``read_rules`` and ``rules_from_table`` understand."""
    rows = [
        (
            number,
            r.target,
            r.condreq,
            None if r.min_hours is None else float(r.min_hours),
            "|".join(r.levels) or None,
            int(r.need_flag),
            ";".join("|".join(clause) for clause in r.clauses) or None,
        )
        for number, r in enumerate(rules)
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)
