"""SQL fragments shared by the DuckDB checks."""


def ndiff(a: str, b: str) -> str:
    return f"greatest(-1.0::DOUBLE, least(1.0::DOUBLE, ({a} - {b}) / ({a} + {b} + 1e-6)))"


def idx_columns(side: str) -> str:
    s = f"_{side}" if side else ""
    return (f"{ndiff(f'nir{s}', f'red{s}')} AS ndvi{s}, {ndiff(f'green{s}', f'nir{s}')} AS ndwi{s}, "
            f"{ndiff(f'swir{s}', f'nir{s}')} AS ndbi{s}")


def land_cover(s: str = "", dark: bool = True) -> str:
    v, w, b = f"ndvi{s}", f"ndwi{s}", f"ndbi{s}"
    dark_water = f"OR (nir{s} < 0.045 AND red{s} < 0.040 AND swir{s} < 0.045 AND {v} < 0.15)" if dark else ""
    return f"""CASE
      WHEN ({w} >= 0.20 AND {b} <= -0.10 AND {v} BETWEEN -0.50 AND 0.20) {dark_water} THEN 'Water'
      WHEN {v} >= 0.50 AND {w} BETWEEN -0.60 AND 0.10 AND {b} <= -0.10 THEN 'Dense Vegetation'
      WHEN {v} >= 0.20 AND {v} < 0.50 AND {w} BETWEEN -0.50 AND 0.10 AND {b} BETWEEN -0.40 AND 0.10 THEN 'Sparse Vegetation'
      WHEN {v} BETWEEN -0.10 AND 0.30 AND {w} BETWEEN -0.50 AND 0.10 AND {b} >= 0.15 THEN 'Built-up'
      WHEN {v} >= -0.20 AND {v} < 0.20 AND {w} BETWEEN -0.50 AND 0.10 AND {b} >= -0.20 AND {b} < 0 THEN 'Bare Soil / Open Land'
      WHEN {v} BETWEEN -0.10 AND 0.20 AND {w} BETWEEN -0.50 AND 0.10 AND {b} >= 0 AND {b} < 0.15 THEN 'Built-up / Bare-land Confusion'
      WHEN {w} >= 0.20 OR ({w} > 0.05 AND {v} < -0.10) OR ({v} < 0 AND {w} > -0.10 AND {b} < 0.10) THEN 'Water'
      WHEN {v} >= 0.50 THEN 'Dense Vegetation'
      WHEN {v} >= 0.20 AND {v} > {b} THEN 'Sparse Vegetation'
      WHEN {b} >= 0.15 THEN 'Built-up'
      WHEN {b} < 0 AND {v} < 0.20 THEN 'Bare Soil / Open Land'
      ELSE 'Built-up / Bare-land Confusion' END"""


VEG = "('Dense Vegetation', 'Sparse Vegetation', 'Moderate / Sparse Vegetation')"
SOIL = "('Bare Soil / Open Land', 'Bare Soil / Barren', 'Bare Soil')"
BUILT = "('Built-up', 'Built-up / Urban')"
CONF = "'Built-up / Bare-land Confusion'"
UNCL = "('Unclassified / Other', 'Unclassified / Transitional')"


def real(b: str, a: str) -> str:
    return f"""NOT ({b} = {a} OR ({b} IN {VEG} AND {a} IN {VEG}) OR ({b} IN {UNCL} AND {a} IN {UNCL})
      OR ({b} = {CONF} AND {a} = {CONF}) OR ({b} = {CONF} AND {a} IN {SOIL}) OR ({b} IN {SOIL} AND {a} = {CONF}))"""


def pixel_type(b: str, a: str) -> str:
    return f"""CASE
      WHEN {b} = {a} THEN 'No Change'
      WHEN {b} = {CONF} AND ({a} = {CONF} OR {a} IN {SOIL}) THEN 'No Change'
      WHEN {b} IN {SOIL} AND {a} = {CONF} THEN 'No Change'
      WHEN {b} IN ('Sparse Vegetation', 'Moderate / Sparse Vegetation') AND {a} IN {SOIL} THEN 'No Change'
      WHEN {b} IN {SOIL} AND {a} IN {VEG} THEN 'No Change'
      WHEN {b} IN {BUILT} AND {a} IN {VEG} THEN 'No Change'
      WHEN {b} IN {BUILT} AND {a} IN {SOIL} THEN 'Demolition / Reversion'
      WHEN {b} <> 'Water' AND {a} = 'Water' THEN 'Water-Extent Variation (expansion)'
      WHEN {b} = 'Water' AND {a} <> 'Water' THEN 'Water-Extent Variation (shrinkage)'
      WHEN {b} = 'Dense Vegetation' AND ({a} IN {SOIL} OR {a} = {CONF}) THEN 'Clearance'
      WHEN ({b} IN {VEG} OR {b} IN {SOIL} OR {b} = {CONF}) AND {a} IN {BUILT} THEN 'Construction'
      ELSE 'No Change' END"""


MAJOR = """('Construction', 'Road Development', 'Clearance', 'Water-Extent Variation (shrinkage)',
 'Water-Extent Variation (expansion)', 'Demolition / Reversion', 'Vegetation Shift (Large Scale)')"""

IDX = f"idx AS (SELECT *, {idx_columns('b')}, {idx_columns('a')} FROM pixels)"
CLS = f"cls AS (SELECT *, {land_cover('_b')} AS class_b, {land_cover('_a')} AS class_a FROM idx)"
CHG = f"""chg AS (SELECT *, usable AND (abs(ndvi_a - ndvi_b) > 0.15 OR abs(ndbi_a - ndbi_b) > 0.12 OR abs(ndwi_a - ndwi_b) > 0.15) AS candidate
 FROM (SELECT *, NOT (bad_b OR bad_a) AS usable, {real('class_b', 'class_a')} AS is_real,
              {pixel_type('class_b', 'class_a')} AS change_type FROM cls) t0)"""
VER = f"ver AS MATERIALIZED (SELECT *, candidate AND is_real AND change_type IN {MAJOR} AS verified FROM chg)"
CHANGE = f"{IDX}, {CLS}, {CHG}, {VER}"
