"""Fixed values. Results depend on them, so they are listed plainly in one place."""

# --- Fixed values: land-cover classes -------------------------------------------------
WATER = "Water"
DENSE_VEGETATION = "Dense Vegetation"
SPARSE_VEGETATION = "Sparse Vegetation"
MODERATE_VEGETATION = "Moderate / Sparse Vegetation"
BUILT_UP = "Built-up"
BARE_SOIL = "Bare Soil / Open Land"
CONFUSION = "Built-up / Bare-land Confusion"
UNCLASSIFIED = "Unclassified / Other"

VEGETATION_NAMES = [DENSE_VEGETATION, SPARSE_VEGETATION, MODERATE_VEGETATION]
SPARSE_NAMES = [SPARSE_VEGETATION, MODERATE_VEGETATION]
UNCLASSIFIED_NAMES = [UNCLASSIFIED, "Unclassified / Transitional"]
SOIL_NAMES = [BARE_SOIL, "Bare Soil / Barren", "Bare Soil"]
BUILT_NAMES = [BUILT_UP, "Built-up / Urban"]

# position in this list is the class code used inside pixel jobs
CLASS_CODES = [WATER, DENSE_VEGETATION, SPARSE_VEGETATION, BUILT_UP, BARE_SOIL, CONFUSION]

# --- Fixed values: index boxes per class, in priority order --------------------------
# each bound is (index, comparison, value); a class holds where all its bounds hold
LAND_COVER_BOXES = [
    (WATER, [("ndwi", ">=", 0.20), ("ndbi", "<=", -0.10), ("ndvi", ">=", -0.50), ("ndvi", "<=", 0.20)]),
    (DENSE_VEGETATION, [("ndvi", ">=", 0.50), ("ndwi", ">=", -0.60), ("ndwi", "<=", 0.10), ("ndbi", "<=", -0.10)]),
    (SPARSE_VEGETATION, [("ndvi", ">=", 0.20), ("ndvi", "<", 0.50), ("ndwi", ">=", -0.50), ("ndwi", "<=", 0.10),
                         ("ndbi", ">=", -0.40), ("ndbi", "<=", 0.10)]),
    (BUILT_UP, [("ndvi", ">=", -0.10), ("ndvi", "<=", 0.30), ("ndwi", ">=", -0.50), ("ndwi", "<=", 0.10),
                ("ndbi", ">=", 0.15)]),
    (BARE_SOIL, [("ndvi", ">=", -0.20), ("ndvi", "<", 0.20), ("ndwi", ">=", -0.50), ("ndwi", "<=", 0.10),
                 ("ndbi", ">=", -0.20), ("ndbi", "<", 0.00)]),
    (CONFUSION, [("ndvi", ">=", -0.10), ("ndvi", "<=", 0.20), ("ndwi", ">=", -0.50), ("ndwi", "<=", 0.10),
                 ("ndbi", ">=", 0.00), ("ndbi", "<", 0.15)]),
]
# rules for values outside all boxes, in order; "lead" is ndvi - ndbi; nothing fits: confusion
LAND_COVER_FALLBACK = [
    (WATER, [("ndwi", ">=", 0.20)]),
    (WATER, [("ndwi", ">", 0.05), ("ndvi", "<", -0.10)]),
    (WATER, [("ndvi", "<", 0.00), ("ndwi", ">", -0.10), ("ndbi", "<", 0.10)]),
    (DENSE_VEGETATION, [("ndvi", ">=", 0.50)]),
    (SPARSE_VEGETATION, [("ndvi", ">=", 0.20), ("lead", ">", 0.00)]),
    (BUILT_UP, [("ndbi", ">=", 0.15)]),
    (BARE_SOIL, [("ndbi", "<", 0.00), ("ndvi", "<", 0.20)]),
]
# dark water: strong absorption in three bands
DARK_WATER = [("nir", "<", 0.045), ("red", "<", 0.040), ("swir", "<", 0.045), ("ndvi", "<", 0.15)]

# --- Fixed values: change types ------------------------------------------------------
CONSTRUCTION = "Construction"
ROAD = "Road Development"
CLEARANCE = "Clearance"
WATER_SHRINKAGE = "Water-Extent Variation (shrinkage)"
WATER_EXPANSION = "Water-Extent Variation (expansion)"
DEMOLITION = "Demolition / Reversion"
VEGETATION_SHIFT = "Vegetation Shift (Large Scale)"
UNCLASSIFIED_CHANGE = "Unclassified Structural Change"
NO_CHANGE = "No Change"
MAJOR_TYPES = [CONSTRUCTION, ROAD, CLEARANCE, WATER_SHRINKAGE, WATER_EXPANSION, DEMOLITION, VEGETATION_SHIFT]

# --- Fixed values: thresholds --------------------------------------------------------
INDEX_EPS = 1e-6
DN_SCALE = 10000.0
CVA_NDVI, CVA_NDBI, CVA_NDWI = 0.15, 0.12, 0.15
REFLECTANCE_DIFF = 0.15
EPOCH_DIFF = 35.0
MIN_USABLE = 0.30
QUALITY_GATE = 0.70
MIN_COMPONENT_PX = 15
ROAD_ELONGATION = 4.0
LARGE_VEGETATION_M2 = 50000.0
LARGE_CLEARANCE_M2 = 5000.0
SMALL_CONFUSION_M2 = 1000.0
MIN_BOX_M2 = 1000.0
WATER_PROOF_PX = 25
PIXEL_M2 = 100.0
NMS_IOU = 0.35
MAX_BOXES = 8
DEDUP_DEGREES = 0.002
M_PER_DEG = 111320.0
KM_PER_DEG_LAT = 111.132
KM_PER_DEG_LON = 111.320

# --- Fixed values: sensor families ---------------------------------------------------
SENTINEL_SENSORS = [
    "sentinel-2", "sentinel-2a", "sentinel-2b", "sentinel-2c", "sentinel-2d",
    "Sentinel-2", "Sentinel-2A", "Sentinel-2B", "Sentinel-2C", "Sentinel-2D",
    "Sentinel-2 L2A", "sentinel2", "sentinel", "Organiser Sensor",
]
MAXAR_SENSORS = ["Maxar", "maxar", "Maxar WorldView", "Maxar WorldView / Wayback"]
COLLECTION_MAIN = "tile_embeddings"
COLLECTION_MAXAR = "maxar_tile_embeddings"

# --- Fixed values: band names --------------------------------------------------------
BAND_ALIASES = {
    "blue": ["blue", "b02", "b2"], "b02": ["b02", "blue", "b2"], "b2": ["b2", "b02", "blue"],
    "green": ["green", "b03", "b3"], "b03": ["b03", "green", "b3"], "b3": ["b3", "b03", "green"],
    "red": ["red", "b04", "b4"], "b04": ["b04", "red", "b4"], "b4": ["b4", "b04", "red"],
    "nir": ["nir", "b08", "b8", "b5"], "b08": ["b08", "nir", "b8"], "b8": ["b8", "b08", "nir"],
    "swir": ["swir", "b11", "b6"], "b11": ["b11", "swir", "b6"], "b6": ["b6", "b11", "swir"],
    "b01": ["b01", "b1", "coastal"], "b1": ["b1", "b01", "coastal"],
    "b05": ["b05", "b5"], "b8a": ["b8a"], "b09": ["b09", "b9"], "b10": ["b10"], "b12": ["b12", "b7"],
}
CLOUD_MODEL_BANDS = ["B01", "B02", "B04", "B05", "B08", "B8A", "B09", "B10", "B11", "B12"]
BAND_ROLE_PRIORITY = {"blue": 1, "green": 2, "red": 3, "nir": 4, "swir": 5, "swir2": 6, "coastal": 7,
                      "qa_mask": 99, "mask": 99}
ASSET_ALIASES = {
    "red": ["red", "B04", "b04"], "green": ["green", "B03", "b03"], "blue": ["blue", "B02", "b02"],
    "visual": ["visual", "visual-tci", "TCI"], "nir": ["nir", "B08", "b08", "nir08"],
    "swir": ["swir16", "B11", "b11"], "scl": ["scl", "SCL"], "b01": ["coastal", "B01", "b01"],
    "b05": ["rededge1", "B05", "b05"], "b8a": ["nir09", "B8A", "b8a"], "b09": ["watervapour", "B09", "b09"],
    "b10": ["cirrus", "B10", "b10"], "b12": ["swir22", "B12", "b12"],
}

# --- Fixed values: default band orders by band count (and the second sensor convention) ---
DEFAULT_BAND_ORDER = {
    1: ["grayscale"],
    3: ["red", "green", "blue"],
    4: ["red", "green", "blue", "nir"],
    5: ["red", "green", "blue", "nir", "swir"],
    6: ["blue", "green", "red", "nir", "swir", "swir2"],
    7: ["blue", "green", "red", "nir", "swir", "swir2", "mask"],
    8: ["blue", "green", "red", "nir", "swir", "swir2", "band_7", "band_8"],
    10: ["B01", "B02", "B04", "B05", "B08", "B8A", "B09", "B10", "B11", "B12"],
    12: ["B01", "B02", "B03", "B04", "B05", "B06", "B07", "B08", "B8A", "B09", "B11", "B12"],
    13: ["B01", "B02", "B03", "B04", "B05", "B06", "B07", "B08", "B8A", "B09", "B10", "B11", "B12"],
}
LANDSAT_BAND_ORDER = {
    4: ["blue", "green", "red", "nir"],
    5: ["blue", "green", "red", "nir", "swir"],
    7: ["coastal", "blue", "green", "red", "nir", "swir", "swir2"],
    8: ["coastal", "blue", "green", "red", "nir", "swir", "swir2", "qa"],
}
LANDSAT_BAND_NUMBERS = {
    "B1": "coastal", "B01": "coastal", "B2": "blue", "B02": "blue", "B3": "green", "B03": "green",
    "B4": "red", "B04": "red", "B5": "nir", "B05": "nir", "B6": "swir", "B06": "swir",
    "B7": "swir2", "B07": "swir2", "B8": "panchromatic", "B08": "panchromatic", "B10": "thermal", "B11": "thermal",
}
SENTINEL_BAND_NUMBERS = {
    "B2": "blue", "B02": "blue", "B3": "green", "B03": "green", "B4": "red", "B04": "red",
    "B8": "nir", "B08": "nir", "B11": "swir", "B12": "swir", "B1": "B01", "B01": "B01",
    "B5": "B05", "B05": "B05", "B8A": "B8A", "8A": "B8A", "B9": "B09", "B09": "B09", "B10": "B10",
}

# --- Fixed values: cloud masking and removal -----------------------------------------
CLOUD_THRESHOLD = 0.40
CLEAR_PROB, THIN_PROB, THICK_PROB = 0.20, 0.45, 0.70
MIN_OPACITY, MAX_OPACITY, MATTING_EPS = 0.05, 0.95, 0.05
DEFAULT_RADIANCE = {"red": 235.0, "green": 235.0, "blue": 245.0}
SHADOW_DARKNESS, SHADOW_RADIUS, SHADOW_STEP = 450.0, 25, 4
CLEAR_TOLERANCE = 1e-4
REGION_CLEAR, REGION_THIN, REGION_UNCERTAIN, REGION_THICK, REGION_NODATA = 0, 1, 2, 3, 4
PROV_CLEAR, PROV_THIN, PROV_RECONSTRUCTED, PROV_UNRESOLVED, PROV_NODATA = 0, 1, 2, 3, 4

# --- Fixed values: known areas, first match wins (west and south bounds) --------------
KNOWN_AREAS = [
    ("pipeline_validation_delhi_cantonment", 77.08, 77.16, 28.56, 28.64),
    ("pangong_tso_north_bank", 78.3, 79.2, 33.5, 34.1),
    ("galwan_valley_confluence", 77.8, 78.6, 34.5, 35.1),
    ("depsang_plains_y_junction", 77.6, 78.4, 35.0, 35.7),
    ("mumbai_naval_anchorage", 72.80, 72.90, 18.88, 18.98),
    ("chushul_rezang_la", 78.4, 79.0, 33.3, 33.9),
]

# --- Fixed values: dataset registry --------------------------------------------------
REGISTRY_FIELDS = ["dataset_id", "display_name", "domain", "sensor", "modality", "task", "geographic_scope",
                   "time_range", "spatial_resolution", "source", "license", "local_path", "status", "notes"]
REGISTRY_DOMAINS = ["pipeline_validation", "eastern_ladakh", "benchmark_change_detection", "maritime"]
REGISTRY_MODALITIES = ["multispectral", "optical", "sar", "multimodal"]
REGISTRY_TASKS = ["preprocessing_validation", "temporal_change_detection", "semantic_change_detection",
                  "ship_detection", "semantic_retrieval"]
DOMAIN_TASKS = {
    "pipeline_validation": ["preprocessing_validation", "temporal_change_detection"],
    "eastern_ladakh": ["temporal_change_detection", "semantic_change_detection"],
    "benchmark_change_detection": ["temporal_change_detection", "semantic_change_detection"],
    "maritime": ["ship_detection", "semantic_retrieval"],
}
EXPECTED_LAYOUT = {
    "eastern_ladakh": ["raw", "intermediate", "normalized", "tiles", "manifests"],
    "benchmark_change_detection": ["t1", "t2", "label"],
}
SCENE_LAYERS = ["raw_canvas", "cloud_probability", "cloud_mask", "shadow_mask", "bad_mask", "normalized_canvas"]

# --- Fixed values: high-resolution release years -------------------------------------
RELEASE_YEARS = {2020: "6049", 2021: "10020", 2022: "14458", 2023: "18092", 2024: "20112", 2025: "24200", 2026: "26334"}
