"""Fixed values of the domain."""

# Districts by id, in their order.
DISTRICTS = {
    "lefkosa": "Lefkoşa",
    "girne": "Girne",
    "gazimagusa": "Gazimağusa",
    "guzelyurt": "Güzelyurt",
    "iskele": "İskele",
    "lefke": "Lefke",
}
DISTRICT_IDS = tuple(DISTRICTS)
ZONE = "Europe/Nicosia"

# Minutes.
TIME_TOLERANCE = 15
OPEN_FAULT_TOLERANCE = 6 * 60
NO_END_ASSUMED_OVER = 72 * 60
CANDIDATE_WINDOW = 72 * 60
RESOLUTION_WINDOW = 144 * 60
RESTORATION_LOOKBACK = 12 * 60
SAME_START = 5
LIVE_HORIZON = 30 * 24 * 60
STALE_AFTER = 2 * 60

# Limits and thresholds.
MAX_PARSE_ATTEMPTS = 3
FUZZY_THRESHOLD = 0.9
MIN_FUZZY_LENGTH = 5
PLACE_PAGE_MIN_RECORDS = 3
ID_PREFIX = 8
ARCHIVE_LIMIT = 500
DISTRICT_LIMIT = 12
PLACE_LIMIT = 200
REFS_LIMIT = 2000
UI_LIMIT = 6
RAW_TEXT_CAP = 8000
URL_BATCH = 1000
