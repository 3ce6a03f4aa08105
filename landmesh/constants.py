"""Fixed values of the domain that results depend on."""

# Raster tiers, their sizes in pixels and pixel widths in metres.
TIER_SIZE = {"S": 128, "M": 256, "L": 512, "XL": 1024, "XXL": 2048}
TIER_PIXEL_M = {"S": 100.0, "M": 100.0, "L": 200.0, "XL": 500.0, "XXL": 1000.0}
# Fixed value: namespace of sample ids.
SAMPLE_NAMESPACE = "6d2a5a4e-6c3b-4f2e-9a7e-1e0c3b3a5e11"
# Land-cover classes, by position in the fixtures.
LANDCOVER = [0, 10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100]
NODATA_CLASS, WATER_CLASS, SNOW_CLASS = 0, 80, 70
# Source configurations, their kinds, tasks and export groups.
CONFIGS = ["points", "wall_to_wall_NS", "wall_to_wall_EW", "advanced", "omniscape"]
KIND_OF = {"points": "points", "wall_to_wall_NS": "wall_to_wall", "wall_to_wall_EW": "wall_to_wall", "regions": "regions", "advanced": "advanced", "omniscape": "omniscape"}
TASK_OF_KIND = {"points": "T1,T2", "wall_to_wall": "T1W", "regions": "T1R", "advanced": "T3", "omniscape": "T4"}
GROUP_OF = {"points": "T1", "wall_to_wall_NS": "T1W", "wall_to_wall_EW": "T1W", "regions": "T1R", "advanced": "T3", "omniscape": "T4"}
# How test-like a split is.
SPLIT_RANK = {"train": 0, "val": 1, "test_id": 2, "ood_region": 3}
# Quality flags that only inform, and those that only bar training.
INFO_FLAGS = ["fallback_solver"]
TRAINING_FLAGS = ["rmax_saturated"]
# Road and river regions of realms.
ROAD_REGION = {"Nearctic": 1, "Neotropic": 2, "Afrotropic": 3, "Australasia": 7, "Oceania": 7, "Indomalayan": 6}
# Published per-solve seconds, memory and storage used by the cost tables.
COST_SECONDS = {
    "points": {"S": 0.171, "M": 0.87, "L": 4.11, "XL": 13.3, "XXL": 70.9},
    "wall_to_wall": {"S": 0.079},
    "regions": {"S": 0.214},
    "advanced": {"S": 0.074},
    "omniscape": {"S": 52.5, "M": 134.0, "L": 577.0, "XL": 1896.0, "XXL": 9613.0},
}
OVERHEAD = 0.15
LADDER = {"S": 100000, "M": 50000, "L": 20000, "XL": 4000, "XXL": 400}
GENERATOR_MIX = {"grf": 0.24, "fractal": 0.16, "random_cluster": 0.12, "planar_gradient": 0.04, "edge_gradient": 0.04, "distance_gradient": 0.08, "mosaic": 0.12, "hard": 0.20}
HARD_MIX = {"high_contrast_1e5": 0.20, "high_contrast_1e6": 0.10, "rmax_saturated": 0.15, "narrow_corridor": 0.30, "large_nodata": 0.25}
# Weights and ranges that synthetic landscapes are drawn from.
PRIOR = {
    "generator_weights": {"grf": 0.30, "fractal": 0.20, "random_cluster": 0.15, "planar_gradient": 0.05, "edge_gradient": 0.05, "distance_gradient": 0.10, "mosaic": 0.15},
    "grf": {"length_scale": (2, 8, 32, 128), "anisotropy": (1.0, 4.0), "angle_deg": (0.0, 180.0)},
    "fractal": {"roughness": (0.2, 0.5, 0.8)},
    "random_cluster": {"p": (0.3, 0.58)},
    "planar_gradient": {"direction_deg": (0.0, 360.0)},
    "edge_gradient": {"direction_deg": (0.0, 360.0)},
    "distance_gradient": {"n_sources": (1, 6)},
    "mosaic": {"n_elements": (5, 60)},
    "p_patch_mosaic": 0.3, "patch_classes": (3, 8), "p_barriers": 0.5,
    "barriers": {"n_lines_per_128px": (1, 8), "width_px": (1.0, 3.0), "p_oriented": 0.5, "gap_fraction": (0.0, 0.3), "gap_length_px": (2.0, 8.0), "barrier_cost": (0.7, 1.0)},
    "p_nodata": 0.3, "nodata": {"fraction": (0.02, 0.25), "length_scale": (4.0, 32.0)},
    "contrast": (10, 100, 1000, 10000, 100000, 1000000), "contrast_weights": (1, 1, 1, 1, 1, 0.5), "mapping": "log",
}
TABLE_NAMES = ["generic_hm", "large_mammal", "amphibian", "forest_bird", "random_lm"]
PER_LANDSCAPE = {"points": 1.0, "wall_to_wall_NS": 1.0, "wall_to_wall_EW": 1.0, "regions": 0.4, "advanced": 1.0, "omniscape": 1.0}
STORAGE_MB = {"synthetic": {"S": 0.93, "M": 3.0, "L": 11.0, "XL": 41.0, "XXL": 140.0}, "real": {"S": 1.4, "M": 4.5, "L": 16.0, "XL": 60.0, "XXL": 200.0}}
PEAK_RSS_MB = {"S": 1450, "M": 1360, "L": 1620, "XL": 3290, "XXL": 9520}
# Seeds, shares and held-out sets of the splits.
SPLIT_SEED = 20260906
SPLIT_SHARE = {"train": 0.8, "val": 0.1, "test_id": 0.1}
BAND_DEG = 20.0
XL_SHARE = 0.25
OOD_REALMS, OOD_BIOMES = ["Australasia"], [10, 14]
OOD_TABLE, OOD_CONTRAST = "forest_bird", 1000000
METRES_PER_DEGREE = 111320.0
# The latitude that boxes end at, the one whose width is the narrowest, and the least cosine.
TOP_LATITUDE, WIDTH_LATITUDE, LEAST_COSINE = 89.999, 89.0, 0.02
EPS = 1e-6

# Resistance tables (classes, roads, slopes, bands, water rules).
TABLES = {
    "generic_hm": {"r_max": 1000.0, "base": "ghm", "a": 999.0, "b": 2.0, "water": ("barrier", 1000.0)},
    "large_mammal": {
        "r_max": 1000.0, "base": "landcover",
        "landcover": {10: 1, 20: 3, 30: 5, 40: 20, 50: 500, 60: 30, 70: 200, 80: 800, 90: 15, 95: 10, 100: 20},
        "roads": {1: 600, 2: 300, 3: 150, 4: 60, 5: 20}, "buffer_m": 60.0, "slope": (0.03, 45.0), "ghm_additive": 100.0, "water": ("barrier", 800.0),
    },
    "amphibian": {
        "r_max": 1000.0, "base": "landcover",
        "landcover": {10: 2, 20: 20, 30: 15, 40: 50, 50: 800, 60: 200, 70: 800, 80: 2, 90: 1, 95: 2, 100: 20},
        "roads": {1: 900, 2: 800, 3: 500, 4: 300, 5: 150}, "buffer_m": 60.0, "slope": (0.06, 45.0), "water": ("table", None),
    },
    "forest_bird": {
        "r_max": 100.0, "base": "landcover",
        "landcover": {10: 1, 20: 5, 30: 15, 40: 20, 50: 60, 60: 30, 70: 60, 80: 20, 90: 6, 95: 2, 100: 20},
        "roads": {1: 20, 2: 10, 3: 5, 4: 2, 5: 1}, "buffer_m": 60.0, "bands": [(1500.0, 1.0), (3000.0, 2.0), (9000.0, 4.0)], "water": ("table", None),
    },
    "constant": {"r_max": 10.0, "base": "constant", "constant": 5.0, "water": ("nodata", None)},
}

# What a shard's root names, the versions of its layout, and the arrays of each kind of configuration.
ROOT_ATTRIBUTES = ["dataset_version", "schema_version", "pipeline_git_sha", "created_at"]
SCHEMA_VERSIONS = ["0.1", "0.2"]
_PAIRS = {"focal_mask": "int32", "cum_current": "float32", "reff": "float64", "labels": "int32", "pair_index": "int32"}
DATASETS = {
    "points": _PAIRS, "wall_to_wall": _PAIRS, "regions": _PAIRS,
    "advanced": {"source_strength": "float32", "ground": "int8", "current": "float32", "voltage": "float32"},
    "omniscape": {"source_strength": "float32", "cum_current": "float32", "flow_potential": "float32", "normalized": "float32"},
}
RASTERS = ["focal_mask", "cum_current", "source_strength", "ground", "current", "voltage", "flow_potential", "normalized"]
