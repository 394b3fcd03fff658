"""The star-schema travel run as common table expressions, and WITH-clause assembly."""

from __future__ import annotations

import re

from tripweave.sources import star


def columns(exprs: dict[str, str]) -> str:
    return ", ".join(f'{expr} AS "{name}"' for name, expr in exprs.items())


PURPOSE = """CASE WHEN tour_category = 'joint' THEN 'joint_' || CASE WHEN tour_purpose IN
 ('college','univ','university') THEN 'school' ELSE tour_purpose END
 WHEN tour_category = 'atwork' THEN 'atwork'
 WHEN tour_purpose IN ('college','univ','university') THEN 'school'
 ELSE tour_purpose END AS summary_tour_purpose"""

CTES: dict[str, str] = {
    "zones": f"SELECT {columns(star.ZONE)} FROM nation LEFT JOIN region "
    "ON n_regionkey = r_regionkey",
    "hh": f"SELECT {columns(star.HH)} FROM customer LEFT JOIN zones ON c_nationkey = zone",
    "members": "SELECT hh.*, t.n FROM hh, LATERAL (SELECT UNNEST(generate_series(1, HHSIZE)) "
    "AS n) t",
    "per_keys": "SELECT household_id, home_zone_id, home_county, home_geo__district, "
    f"finalweight, {columns(star.PER_KEYS)} FROM members",
    "per": "SELECT "
    + columns(star.PER)
    .replace("work_district", "w.district")
    .replace("school_district", "s.district")
    + " FROM per_keys LEFT JOIN zones w ON w.zone = workplace_zone_id "
    "LEFT JOIN zones s ON s.zone = school_zone_id",
    "day_keys": "SELECT household_id, household_id * 10 + n AS person_id, t.d FROM members, "
    "LATERAL (SELECT UNNEST(generate_series(1, CASE WHEN household_id % 2 = 0 THEN 2 ELSE 1 END)) "
    "AS d) t",
    "day": f"SELECT {columns(star.DAY)} FROM day_keys",
    "tour_keys": f"SELECT o.*, household_id, home_zone_id, HHSIZE, HHVEH, "
    f"{columns(star.TOUR_KEYS)} FROM orders o JOIN hh ON o_custkey = household_id",
    "tours_raw": f"SELECT {columns(star.TOURS).replace('destination_district', 'z.district')} "
    "FROM tour_keys LEFT JOIN zones z ON z.zone = tour_destination",
    "tours": f"SELECT *, {PURPOSE} FROM tours_raw",
    "lines": "SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY "
    f"{', '.join(star.LINE_COLUMNS)}) AS line_no FROM lineitem",
    "trips_raw": f"SELECT {columns(star.TRIPS)} FROM lines JOIN (SELECT tour_id, household_id, "
    "person_id, tour_mode, tour_purpose, tour_category, NUMBER_HH FROM tours) "
    "ON l_orderkey = tour_id",
    "trips": f"SELECT *, {PURPOSE} FROM trips_raw",
    "vehicles": f"SELECT {columns(star.VEHICLES)} FROM (SELECT hh.*, t.v FROM hh, LATERAL "
    "(SELECT UNNEST(generate_series(1, HHVEH)) AS v) t)",
    "participants": f"SELECT {columns(star.PARTICIPANTS)} FROM (SELECT o_orderkey AS tour_id, "
    "household_id, t.n FROM tour_keys, LATERAL (SELECT UNNEST(generate_series(1, "
    "LEAST(party, HHSIZE))) AS n) t WHERE category = 'joint')",
    "land": "SELECT zones.*, suppliers FROM zones LEFT JOIN (SELECT s_nationkey, COUNT(*) AS "
    "suppliers FROM supplier GROUP BY 1) ON s_nationkey = zone",
    "land_use": f"SELECT {columns(star.LAND_USE)} FROM land UNION ALL SELECT * FROM "
    f"(SELECT {columns(star.LAND_USE_ENROLLMENT)} FROM land, (VALUES ('School'), ('University')) "
    "AS k(kind)) WHERE enrollment_count IS NOT NULL",
    # Sum of participants' weights per joint tour.
    "party_weight": "SELECT tour_id, SUM(p.finalweight) AS pw FROM participants j "
    "JOIN per p USING (person_id) GROUP BY tour_id",
    "person_tours": "SELECT t.*, CASE WHEN tour_category <> 'joint' THEN finalweight "
    "ELSE COALESCE(pw, finalweight * CASE WHEN NUMBER_HH > 0 AND NUMBER_HH < 995 THEN NUMBER_HH "
    "ELSE 1 END) END AS ptw FROM tours t LEFT JOIN party_weight USING (tour_id)",
    "person_trips": "SELECT t.*, CASE WHEN tour_category <> 'joint' THEN finalweight "
    "ELSE COALESCE(pw, finalweight * CASE WHEN num_participants > 0 AND num_participants < 995 "
    "THEN num_participants ELSE 1 END) END AS ptw FROM trips t LEFT JOIN party_weight "
    "USING (tour_id)",
    # Household-tour weight: complete groups of joint participant rows share one tour.
    "joint_groups": "SELECT joint_tour_id, COUNT(*) AS rows_in FROM tours "
    "WHERE tour_category = 'joint' AND joint_tour_id > 0 AND joint_tour_id <> 995 "
    "GROUP BY 1 HAVING COUNT(*) > 1 AND "
    "MIN(CASE WHEN NUMBER_HH >= 2 AND NUMBER_HH < 995 THEN NUMBER_HH END) = COUNT(*) AND "
    "MAX(CASE WHEN NUMBER_HH >= 2 AND NUMBER_HH < 995 THEN NUMBER_HH END) = COUNT(*)",
    "hh_tours": "SELECT t.*, finalweight / COALESCE(rows_in, 1) AS htw FROM tours t "
    "LEFT JOIN joint_groups USING (joint_tour_id)",
    # Person exposure: person-days with the day weight, else the person weight.
    "exposure": "SELECT p.person_id, CAST(p.person_type AS STRING) AS person_type, "
    "COALESCE(d.finalweight, p.finalweight) AS w FROM day d JOIN per p USING (person_id)",
}
CTES |= {
    name: f"SELECT {columns(exprs)} FROM {source}"
    for name, (source, exprs) in star.VALIDATION.items()
}
CTES["counts"] = f"SELECT {columns(star.COUNTS)} FROM supplier"
CTES["volumes"] = f"SELECT {columns(star.VOLUMES)} FROM supplier"


def with_query(body: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` clause holding exactly the expressions the query needs, in order."""
    known = {**CTES, **(extra or {})}
    order: list[str] = []

    def add(text: str) -> None:
        words = set(re.findall(r"[A-Za-z_]\w*", text))
        for name in known:
            if name in words and name not in order and name != text:
                pending.append(name)

    pending: list[str] = []
    needed: set[str] = set()
    add(body)
    while pending:
        name = pending.pop()
        if name in needed:
            continue
        needed.add(name)
        add(known[name])
    order = [name for name in known if name in needed]
    if not order:
        return body
    clauses = ", ".join(f"{name} AS ({known[name]})" for name in order)
    return f"WITH {clauses} {body}"
