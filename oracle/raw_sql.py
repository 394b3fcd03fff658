"""Raw tables, matrices and periods as common table expressions."""

from __future__ import annotations

from oracle.star_sql import columns
from tripweave.sources import star_raw

RAW_CTES = {
    "raw_hh": f"SELECT {columns(star_raw.HH)} FROM hh",
    "raw_per": f"SELECT {columns(star_raw.PER)} FROM per",
    "raw_day": f"SELECT {columns(star_raw.DAY)} FROM day",
    "raw_tours": f"SELECT {columns(star_raw.TOURS)} FROM tours",
    "raw_trips": f"SELECT {columns(star_raw.TRIPS)} FROM trips",
    "raw_zones": f"SELECT {columns(star_raw.LAND_USE)} FROM land_use WHERE student_type IS NULL",
    # Matrix cells by zero-based coarse zone.
    "dist_cells": "SELECT o, d, CASE WHEN (o * 7 + d) % 23 <> 0 THEN CAST(ABS(o - d) AS DOUBLE) * "
    "1.5 + 1 END AS v FROM generate_series(0, 9) a(o), generate_series(0, 9) b(d)",
    "am_cells": "SELECT o, d, CASE WHEN (o * 3 + d) % 11 = 0 THEN 9999 ELSE CAST(ABS(o - d) AS "
    "DOUBLE) * 4 + 2 END AS v FROM generate_series(0, 9) a(o), generate_series(0, 9) b(d)",
    "md_cells": "SELECT o, d, CAST(ABS(o - d) AS DOUBLE) * 3 + 1 AS v "
    "FROM generate_series(0, 9) a(o), generate_series(0, 9) b(d)",
    "periods": "SELECT p AS period, CASE WHEN p <= 6 THEN 'EA' WHEN p <= 12 THEN 'AM' WHEN p <= 25 "
    "THEN 'MD' WHEN p <= 32 THEN 'PM' ELSE 'EV' END AS label FROM generate_series(1, 48) g(p)",
}
