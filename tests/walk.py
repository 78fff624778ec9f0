"""Plain term-by-term counting, the yardstick for the Spark operators. Tests only."""

from __future__ import annotations


def by_term(rows):
    """Rows of one student grouped by term, in term order."""
    terms: dict[str, list[dict]] = {}
    for row in rows:
        terms.setdefault(row["strm"], []).append(row)
    return [(term, terms[term]) for term in sorted(terms)]


def holds(rule, rows, passed) -> bool:
    if not rule.states_condition:
        return False
    hours = [r["tot_cumulative"] for r in rows if r["tot_cumulative"] is not None]
    if rule.min_hours is not None and not (hours and max(hours) >= rule.min_hours):
        return False
    if rule.levels and not any((r["um_clevel_descr"] or "").upper() in rule.levels for r in rows):
        return False
    if rule.need_flag and not any(r["bus_maj"] == 1 for r in rows):
        return False
    return all(any(c in passed for c in clause) for clause in rule.clauses)


def count_current(rule, rows, skip="35") -> int:
    count, passed, open_now = 0, set(), rule.unconditional
    for i, (term, now) in enumerate(by_term(rows)):
        taking = any(r["class"] == rule.target for r in now)
        summer = skip is not None and term.endswith(skip)
        if open_now and i > 0 and (taking or not summer):
            count += 1
        if taking:
            return count
        passed |= {r["class"] for r in now if (r["grd_pts_per_unit"] or 0) > 0}
        open_now = open_now or holds(rule, now, passed)
    return count


def count_v1(rule, rows, last_term) -> int:
    terms, passed, start = by_term(rows), set(), 0 if rule.unconditional else None
    if start is None:
        for i, (_, now) in enumerate(terms):
            passed |= {r["class"] for r in now if r["grade_points"] is not None and r["grade_points"] >= 0}
            if holds(rule, now, passed):
                start = i + 1
                break
    if start is None:
        return 0
    count = 0
    for term, now in terms[start:]:
        count += 1
        taken = any(
            r["class"] == rule.target and r["grade_points"] is not None and r["grade_points"] >= 0 for r in now
        )
        if taken or term == last_term:
            break
    return count


def status_latest(rows, target) -> int:
    mine = [r for r in rows if r["class"] == target]
    if not mine:
        return 0
    last = max(mine, key=lambda r: (r["strm"], r["seq"]))
    points = last["grd_pts_per_unit"]
    if points is not None and (points > 0 or (points == 0 and (last["crse_grade_input"] or "").upper() == "F")):
        return 2
    return 1


def status_sticky(rows, target) -> int:
    points = [r["grd_pts_per_unit"] for r in rows if r["class"] == target]
    usable = [p for p in points if p is not None and p >= 0]
    return 0 if not usable else 2 if max(usable) > 0 else 1
