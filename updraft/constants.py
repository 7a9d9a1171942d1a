"""Fixed values shared by the operators (thresholds, lookups, lattice sizes)."""

# --- Aircraft types (fixed values: 4-bit type code of the beacon id byte) ----
AIRCRAFT_TYPE_NAMES = {
    0: "unknown", 1: "glider", 2: "tow plane", 3: "helicopter",
    4: "skydiver", 5: "drop plane", 6: "hang glider", 7: "paraglider",
    8: "powered aircraft", 9: "jet aircraft", 10: "ufo", 11: "balloon",
    12: "airship", 13: "uav", 14: "reserved", 15: "static object",
}
SOARING_TYPES = (1, 6, 7)
TOW_TYPE = 2
ADMITTED_TYPES = (1, 2, 6, 7)

# --- Units -------------------------------------------------------------------
METRES_PER_FOOT = 0.3048
MPS_PER_FPM = 0.00508
KMH_PER_KNOT = 1.852
DEG_S_PER_HALF_TURN_MIN = 3.0
EARTH_RADIUS_M = 6371000.0
METRES_PER_DEGREE = 111320.0

# --- Labels and evidence -----------------------------------------------------
CIRCLING_DEG_S = 8.0
LABEL_VARIO = 1.5
CLUSTER_VARIO = 0.5
FUSION_VARIO = 1.0
DENSITY_VARIO = 0.3
BASE_MARGIN_M = 300.0
MIN_SOLAR_GHI = 50.0

# --- Aerotow -----------------------------------------------------------------
TOW_RADIUS_M = 400.0
TOW_ALT_DIFF_M = 100.0
TOW_MAX_AGE_S = 15.0
TOW_MIN_VARIO = 0.3

# --- Live feed ---------------------------------------------------------------
LIVE_TTL_S = 300
BUFFER_CAP = 600
BUFFER_CAP_IDLE = 20
PATH_CAP = 2000
RETENTION_DAYS = 2.0
TRACK_GAP_S = 300
TRACK_LOOKBACK_S = 16 * 3600
SEARCH_CAP = 25
COORD_DP = 5
PROB_DP = 3
WIRE_FIELDS = ("id", "lat", "lon", "alt", "vario", "heading", "speed_kmh",
               "circling", "is_tow", "under_tow", "agl", "ac_type", "ac_type_name")
EXTRAPOLATE_MAX_S = 15.0
EXTRAPOLATE_MIN_KMH = 5.0
AIRBORNE_AGL_M = 10.0
AIRBORNE_KMH = 30.0
CLUSTER_RADIUS = 0.012

# --- Lattices ----------------------------------------------------------------
GRID_RES = 0.0005
TERRAIN_RES = 0.01
GRID_RADIUS = 0.05
PRIOR_RES = 0.01
PRECISE_DP = 4
COARSE_DP = 2
PRECISE_BAND_M = 150.0
PRECISE_MAX_KMH = 40.0
WORKING_AGL_M = 1000.0
ELEVATION_CHUNK = 100
TILE_DEG = 3

# --- Land cover: class -> (heat, albedo), fixed values -----------------------
LAND_CLASSES = {
    10: (0.20, 0.12),    # tree cover
    20: (0.55, 0.20),    # shrubland
    30: (0.45, 0.22),    # grassland
    40: (0.50, 0.25),    # cropland
    50: (1.00, 0.15),    # built-up
    60: (0.90, 0.20),    # bare ground
    70: (0.00, 0.80),    # snow and ice
    80: (0.00, 0.06),    # water
    90: (0.10, 0.10),    # wetland
    95: (0.10, 0.10),    # mangroves
    100: (0.30, 0.18),   # moss and lichen
}
LAND_DEFAULT = (0.40, 0.20)

# --- Weather fallbacks (fixed values) ----------------------------------------
WEATHER_FALLBACK = {
    "temp_2m": 18.0, "humidity_pct": 60.0, "wind_speed": 12.0,
    "wind_dir": 270.0, "cape": 600.0, "cin": -30.0, "solar_ghi": 500.0,
    "temp_850": 5.0, "temp_500": -12.0, "pbl_height": 1500.0, "soil_temp": 20.0,
}
# Derived values used when a whole weather row is missing (fixed values).
WEATHER_FALLBACK_DERIVED = {"humidity": 0.60, "lapse_rate": 4.9, "thermal_base": 1200}

# Hourly JSON variable -> column of the weather table (fixed values).
WEATHER_VARIABLES = {
    "temperature_2m": "temp_2m",
    "relativehumidity_2m": "humidity_pct",
    "windspeed_10m": "wind_speed",
    "winddirection_10m": "wind_dir",
    "cape": "cape",
    "convective_inhibition": "cin",
    "shortwave_radiation": "solar_ghi",
    "temperature_850hPa": "temp_850",
    "temperature_500hPa": "temp_500",
    "boundary_layer_height": "pbl_height",
    "soil_temperature_0_to_7cm": "soil_temp",
}

# --- Features ----------------------------------------------------------------
FEATURES = (
    "lat", "lon", "elevation", "slope", "aspect",
    "temp_2m", "humidity", "wind_u", "wind_v", "cape", "cin", "solar_ghi",
    "lapse_rate", "land_use_heat", "land_use_albedo",
    "hour_sin", "hour_cos", "doy_sin", "doy_cos",
    "pbl_height", "soil_temp", "alt_agl",
)
NOTEBOOK_FEATURES = FEATURES[:19]

# Forecast uncertainty, one sigma per column (fixed values).
NOISE = (
    ("temp_2m", "abs", 1.0), ("humidity", "abs", 0.05),
    ("wind_u", "abs", 2.0), ("wind_v", "abs", 2.0),
    ("cape", "rel", 0.15), ("cin", "rel", 0.20), ("solar_ghi", "rel", 0.10),
    ("lapse_rate", "abs", 0.5), ("pbl_height", "rel", 0.15), ("soil_temp", "abs", 2.0),
)
MONTE_CARLO_DRAWS = 50

# --- Fusion ------------------------------------------------------------------
FUSION_SIGMA = 6.0
FUSION_WINDOW = 18

# --- Prior -------------------------------------------------------------------
PRIOR_LAG_HOURS = 24
PRIOR_SMOOTHING = 50.0

# --- Training ----------------------------------------------------------------
MIN_SAMPLES = 100
MIN_POSITIVES = 20
MIN_BENCH_GROUPS = 30
MAX_CONSECUTIVE_SKIPS = 12
MAX_BUFFER = 200_000
MAX_CANDIDATES = 20
HOLDOUT_MODULUS = 5
CELLS_PER_DEGREE = 2
GATE_DRAWS = 1000
REPORT_DRAWS = 2000
BENCH_SALT = "updraft/benchmark/1"
EARLY_STOP_SALT = "updraft/early-stop/1"
FOLD_SALT = "updraft/fold/1"
