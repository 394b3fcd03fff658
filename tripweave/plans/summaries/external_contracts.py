"""Declared schemas of validation tables that are supplied from outside."""

from __future__ import annotations

from tripweave.plans.registry import summary

VOLUMES = "am_vol double, md_vol double, pm_vol double, day_vol double"
PURPOSE_VMT = (
    "tod string, hbcoll double, hbo double, hbr double, hbs double, hbsch double, "
    "hbw double, nhbnw double, nhbw double, truck double, Total double"
)
TRUCK_VMT = "tod string, car double, mu double, su double, Total double"

# Column layouts of the supplied tables (a blank header reads as _c0).
EXTERNAL_SCHEMAS = {
    "link_validation_summary": (
        f"id bigint, From_Node bigint, To_Node bigint, FACTYPE bigint, {VOLUMES}"
    ),
    "count_location_counts_validation_summary": f"id bigint, FACTYPE bigint, {VOLUMES}",
    "count_location_volumes_validation_summary": f"id bigint, FACTYPE bigint, {VOLUMES}",
    "count_location_scatter_validation_summary": (
        "id bigint, facility_type string, period string, observed_volume double, "
        "modeled_volume double"
    ),
    "count_location_fit_validation_summary": (
        "facility_type string, period string, slope double, intercept double, "
        "r_squared double, n_locations bigint, observed_min double, observed_max double, "
        "equation_label string, r_squared_label string"
    ),
    "district_commuting_flows_validation_summary": (
        "_c0 string, Albany double, Corvallis double, Lebanon double, Philomath double, "
        "Total double"
    ),
    "county_commuting_flows_validation_summary": (
        "_c0 string, Benton double, Linn double, Marion double, Total double"
    ),
    "commercial_vehicle_validation_summary": TRUCK_VMT,
    "commercial_vehicle_vmt_validation_summary": TRUCK_VMT,
    "external_trip_validation_summary": PURPOSE_VMT,
    "external_vmt_validation_summary": PURPOSE_VMT,
    "auto_vmt_validation_summary": (
        "TOD string, SOV double, HOV2 double, HOV3 double, Truck double, Total double"
    ),
    "work_from_home_validation_summary": "District string, Workers double, WFH double",
}

for _summary_id, _schema in EXTERNAL_SCHEMAS.items():
    summary(_summary_id, _schema, build_by_default=False)(lambda run, config: None)
