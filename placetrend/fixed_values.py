"""Labels, patterns, weights and thresholds that results depend on.

They are stated once, here, as plain text. Every operator takes them as keyword defaults.
"""

# Locality labels
DOTTED_CODE_PATTERN = r"^\.+\d+ "
NUMERIC_CODE_PATTERN = r"^\d+\s*"
AGGREGATE_PREFIXES = ("-", ">>")
NATIONAL_LABEL = "Suisse"

# Population sheet layout (sheet rows count from 1, cells from 0)
SHEET_HEADER_ROW = 3
SHEET_YEAR_CELL = 0
SHEET_LOCALITY_CELL = 3
SHEET_FIRST_MEASURE_CELL = 8

# New-building sheet layout
BUILDING_HEADER_ROW = 3
BUILDING_FIRST_YEAR_CELL = 3
BUILDING_ID_COLUMNS = ("code_commune", "nom_commune", "type_batiment")
BUILDING_TYPE = "Bâtiments avec logements - Total"

# Population segments, as (first age, last age)
TOTAL_POPULATION = "Âge - total"
AGE_SEGMENTS = {
    "enfants_0_19": (0, 19),
    "jeunes_actifs_20_34": (20, 34),
    "actifs_35_49": (35, 49),
    "seniors_50_plus": (50, 95),
}

# Demography score
DEMOGRAPHY_WEIGHTS = {
    "slope_jeunes_actifs": 0.40,
    "slope_actifs_35_49": 0.30,
    "slope_pop_totale": 0.15,
    "slope_enfants": 0.10,
    "slope_seniors": 0.05,
}
DEMOGRAPHY_MIN_ROWS = 5
DEMOGRAPHY_SNAPSHOT_YEAR = 2024

# Building score
BUILDING_WEIGHTS = {
    "acceleration_scaled": 0.40,
    "momentum_scaled": 0.30,
    "recent_slope_scaled": 0.20,
    "taux_croissance_scaled": 0.10,
}

# Restaurant counts and trend
AMENITY = "restaurant"
SNAPSHOT_YEAR_PATTERN = r"-(\d{2})"
RESTAURANT_YEAR_MIN = 2011
RESTAURANT_YEAR_MAX = 2025
RESTAURANT_MIN_YEARS = 3
SIGNIFICANCE_LEVEL = 0.10

# Establishments file
THIRD_SECTOR_COLUMNS = {
    "Année": "year",
    "Commune": "locality",
    "Secteur économique": "sector",
    "Etablissements": "establishments",
    "Emplois": "jobs",
}
SECTOR_CODES = {"Secteur primaire": 1, "Secteur secondaire": 2, "Secteur tertiaire": 3}
SECTOR_TOTAL_WORD = "total"
THIRD_SECTOR_CODE = 3
SUPPRESSION_SENTINELS = ("X", "0")
THIRD_SECTOR_LAST_YEAR = 2023
TIME_DECAY = 0.4
PRIOR_WEIGHT = 3.0

# Composite score, in output order
COMPOSITE_SCORES = (
    "third_sector_job_score",
    "building_score",
    "demographie_score",
    "restau_score",
    "third_sector_establishment_score",
)
SCORE_BOUND = 10.0
