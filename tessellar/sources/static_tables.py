"""Static dimension tables: policy targets, capacities, import dependencies and incentive schemes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessellar.sources.files import dimension

# Policy targets.
POLICY_TARGETS = (
    ("MNRE", "solar", "installed_capacity_gw", 280.0, "GW", 2030, 0.95),
    ("MNRE", "wind", "installed_capacity_gw", 140.0, "GW", 2030, 0.95),
    ("MNRE", "renewable_energy", "total_installed_capacity_gw", 500.0, "GW", 2030, 0.98),
    ("MNRE", "green_hydrogen", "production_mmtpa", 5.0, "MMTPA", 2030, 0.90),
    ("Power Ministry", "power_transmission", "transmission_addition_km", 50000.0, "circuit-km", 2027, 0.85),
    ("Power Ministry", "power_distribution", "smart_meter_rollout_mn", 250.0, "million meters", 2026, 0.82),
    ("DPIIT", "semiconductor", "fab_capacity_wafers_per_month", 50000.0, "wafers/month", 2027, 0.80),
    ("PLI Electronics", "electronics_manufacturing", "production_target_bn_usd", 300.0, "USD Billion", 2026, 0.88),
    ("PLI Mobile", "mobile_phones", "production_target_bn_usd", 160.0, "USD Billion", 2026, 0.88),
    ("Railways Ministry", "railway_infrastructure", "capex_inr_crore", 240000.0, "INR Crore", 2024, 0.92),
    ("Railways Ministry", "dedicated_freight_corridor", "track_km", 3000.0, "km", 2025, 0.90),
    ("Railways Ministry", "railway_electrification", "track_electrification_km", 100000.0, "km", 2024, 0.93),
    ("FAME-II", "electric_vehicle", "ev_target_mn_units", 30.0, "million units", 2030, 0.85),
    ("PLI ACC Battery", "battery_storage", "acc_capacity_gwh", 50.0, "GWh", 2026, 0.88),
    ("MoD", "defense_electronics", "domestic_procurement_inr_crore", 175000.0, "INR Crore", 2025, 0.87),
    ("DoT", "5g_telecom", "bts_tower_target", 500000.0, "towers", 2025, 0.83),
    ("DPIIT", "data_center", "capacity_mw", 1000.0, "MW", 2027, 0.75),
)

# Components a unit of a sector's target needs.
CAPACITY_RATIOS = (
    ("solar", "solar_modules_gw", 1.05), ("solar", "solar_cells_gw", 1.08), ("solar", "solar_wafers_gw", 1.12),
    ("solar", "polysilicon_mt", 2800.0), ("solar", "solar_glass_mn_sqm", 6.0), ("solar", "inverters_gw", 1.0),
    ("wind", "wind_turbines_units", 500.0), ("wind", "steel_for_towers_mt", 130000.0), ("wind", "copper_winding_mt", 600.0), ("wind", "gearboxes_units", 500.0),
    ("power_transmission", "power_transformers_units", 0.02), ("power_transmission", "crgo_steel_mt", 5.0),
    ("power_transmission", "copper_conductor_mt", 8.0), ("power_transmission", "hvdc_cables_km", 0.30),
    ("railway_infrastructure", "rail_steel_mt", 120.0), ("railway_infrastructure", "traction_motors_units", 0.5),
    ("railway_infrastructure", "signalling_systems", 0.01), ("railway_infrastructure", "copper_ohe_mt", 15.0),
    ("electronics_manufacturing", "ems_capacity_bn_usd", 0.40), ("electronics_manufacturing", "pcb_sqm_mn", 12.0), ("electronics_manufacturing", "components_bn_usd", 0.35),
    ("battery_storage", "battery_cells_gwh", 1.10), ("battery_storage", "lithium_mt", 900.0), ("battery_storage", "cathode_material_mt", 1500.0),
    ("battery_storage", "separator_mn_sqm", 15.0), ("battery_storage", "electrolyte_mt", 800.0),
    ("data_center", "ups_power_mw", 1.30), ("data_center", "cooling_units_mw", 0.40), ("data_center", "distribution_transformer_units", 2.0),
    ("5g_telecom", "optical_fiber_km_mn", 3.0), ("5g_telecom", "radio_units", 3.0), ("5g_telecom", "power_backup_kwh", 10.0),
)

# Domestic capacity of a component a year.
DOMESTIC_CAPACITY = (
    ("solar_modules_gw", 50.0), ("solar_cells_gw", 6.0), ("solar_wafers_gw", 0.5), ("polysilicon_mt", 0.0), ("power_transformers_units", 25000.0),
    ("crgo_steel_mt", 30000.0), ("ems_capacity_bn_usd", 15.0), ("pcb_sqm_mn", 40.0), ("battery_cells_gwh", 8.0), ("lithium_mt", 0.0),
    ("optical_fiber_km_mn", 30.0), ("copper_conductor_mt", 700000.0), ("rail_steel_mt", 1200000.0),
)

# Imported share of components, value in billion dollars, whether they can be replaced and in how many years.
IMPORT_DEPENDENCIES = (
    ("solar", "Solar Wafers", 0.98, 1.2, True, 5),
    ("solar", "Solar Cells", 0.75, 2.1, True, 3),
    ("solar", "Polysilicon", 1.00, 0.6, False, 8),
    ("electronics_manufacturing", "Semiconductor ICs", 0.95, 8.5, True, 7),
    ("electronics_manufacturing", "Printed Circuit Boards", 0.80, 3.2, True, 3),
    ("electronics_manufacturing", "Display Panels", 0.92, 6.5, True, 5),
    ("electronics_manufacturing", "Passive Components (MLCCs, resistors)", 0.90, 1.8, True, 4),
    ("power_transmission", "CRGO Steel", 0.75, 0.9, True, 4),
    ("power_transmission", "HVDC Equipment", 0.85, 0.5, False, 10),
    ("specialty_chemicals", "Specialty Agrochem AIs", 0.65, 1.1, True, 3),
    ("specialty_chemicals", "Pharma APIs", 0.68, 3.0, True, 3),
    ("specialty_chemicals", "Fluorochemicals", 0.70, 0.8, True, 4),
    ("battery_storage", "Lithium Carbonate / Hydroxide", 1.00, 0.9, False, 10),
    ("battery_storage", "Cathode Active Materials (LFP/NMC)", 0.95, 1.2, True, 4),
    ("defense_electronics", "Defense Electronics (radar, avionics)", 0.60, 4.0, True, 6),
    ("5g_telecom", "Optical Fiber Preforms", 0.55, 0.4, True, 3),
)

# Incentive schemes of a sector.
INCENTIVE_SCHEMES = (
    ("solar", ("PLI Solar PV (₹24,000 Cr)", "ALMM (domestic content)", "BCD on imports")),
    ("electronics_manufacturing", ("PLI Mobile/IT Hardware (₹17,000 Cr)", "SPECS scheme", "M-SIPS")),
    ("battery_storage", ("PLI ACC Battery (₹18,100 Cr)", "FAME-II", "Viability Gap Funding")),
    ("specialty_chemicals", ("PLI Pharma (₹15,000 Cr)", "PLI Chemicals (₹62,000 Cr)", "BCD on Chinese APIs")),
    ("defense_electronics", ("DAP 2020 indigenisation", "iDEX", "Technology Development Fund")),
    ("5g_telecom", ("PLI Telecom (₹12,195 Cr)", "USOF subsidy", "PMA rule")),
    ("semiconductor", ("India Semiconductor Mission ($10Bn)", "SPECS (25% fiscal support)")),
    ("power_transmission", ("Make in India for Power Sector", "BEE efficiency standards")),
    ("railway_infrastructure", ("Make in India Railways", "DFC project funding")),
    ("water_infrastructure", ("Jal Jeevan Mission (₹3.6L Cr)", "AMRUT 2.0")),
)


def policy_targets(spark: SparkSession) -> DataFrame:
    return dimension(spark, list(POLICY_TARGETS), "source string, sector string, metric string, value double, unit string, year int, confidence double")


def capacity_ratios(spark: SparkSession) -> DataFrame:
    return dimension(spark, list(CAPACITY_RATIOS), "sector string, component string, ratio double")


def domestic_capacity(spark: SparkSession) -> DataFrame:
    return dimension(spark, list(DOMESTIC_CAPACITY), "component string, capacity double")


def import_dependencies(spark: SparkSession) -> DataFrame:
    return dimension(spark, list(IMPORT_DEPENDENCIES), "sector string, component string, share double, value_bn double, substitutable boolean, horizon_years int")


def incentive_schemes(spark: SparkSession) -> DataFrame:
    return dimension(spark, [(sector, s) for sector, many in INCENTIVE_SCHEMES for s in many], "sector string, scheme string")
