"""Parameter defaults of the application this library re-expresses."""

# --- fixed values -----------------------------------------------------------------------------------------------
DEFAULT_GROUP_KEY = 797
MIN_RECORD_YEAR = 1900
MIN_RECORD_YEAR_PYRAMID = 1970
EXCLUDED_BASES = ("FOSSIL_SPECIMEN", "LIVING_SPECIMEN")

MAX_PLOT_LATITUDE = 85.0
MAX_PLOT_LONGITUDE = 180.0

TILE_SIZE = 4096
EARTH_CIRCUMFERENCE_M = 40075016.686

JOB_TILE_ZOOM = 4
JOB_CELL_LOOKAHEAD = 5
GRID_ZOOM = 10
PYRAMID_MAX_ZOOM = 8
PYRAMID_CELL_LOOKAHEAD = 3

HEX_RADIUS_DEFAULT = 80.0
HEX_RADIUS_PER_SIZE = 16
HEX_SIZE_CHOICES = (3, 4, 5, 6, 7, 8, 9, 10, 15, 25)
TILE_DRAW_BORDER = 8

YEAR_THRESHOLD_DEFAULT = 15

MIN_FIT_YEARS_PLACE = 3
MIN_FIT_YEARS_BOX = 2

AUTOCOMPLETE_LIMIT = 25
SLOPE_BREAKS = (0.0008, 0.0006, 0.0004, 0.0002, 0.0, -0.0002, -0.0004, -0.0006, -0.0008)
# --- end of fixed values ----------------------------------------------------------------------------------------

# Years are shifted by this origin before they are squared, so the sums stay exact in a bigint.
YEAR_ORIGIN = 2000

# Rows of a join key that one task takes; a key with more is spread, and the small side copied, as often as its measured
# rows ask for.  At most so many keys are spread, the largest.  See operators/joins.py.
ROWS_PER_COPY = 500
MOST_CROWDED_KEYS = 10_000

# Zoom at which the pyramid is cut in two: the cells of a tile of this zoom are summed together.
PYRAMID_MIDDLE_ZOOM = 4

# Tasks over which every key of a join is spread where its rows have not been measured.
JOIN_SPREAD = 8

# A line end this small beside the line's other end is zero: what is left of it is floating-point noise.
LEVEL_NOISE = 1e-10

# A yearly change this small beside the line's height is zero, for the same reason: the line has no direction of its own.
SLOPE_NOISE = 1e-13
