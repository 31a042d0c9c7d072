"""Fixed values.

Spellings, word lists, patterns and limits that results depend on. They are
data, not logic: every rule that reads them lives elsewhere.
"""

# --- cells -----------------------------------------------------------------
MISSING_TOKENS = ("", "na", "n/a", "nan", "null", "none", "nil", "?", "-", "--", "#n/a")
TRUE_TOKENS = ("true", "yes", "y", "t")
FALSE_TOKENS = ("false", "no", "n", "f")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
DELIMITERS = (",", "\t", ";", "|")
NOT_DELIMITED = r"(?i)^\s*<(!doctype\s+html|html|head|body|script|div)\b|^%PDF"
WHITESPACE = " \t\n\r\f\u000b\u00a0\ufeff"

# --- column names (matched without regard to case) ---------------------------
ID_NAME = r"(^|[_\s-])(id|uuid|guid|key|hash|sku|isbn|ssn)$|^(id|uuid|guid)([_\s-]|$)|^unique[_\s-]"
CODE_NAME = r"(^|[_\s-])(zip|zipcode|postal|postcode|phone|fax|fips)([_\s-]|$)"
SEQUENCE_NAME = (
    r"(^|[_\s-])(id|index|idx|order|seq|sequence|step|row|no|num|number|rank|play|tick|frame|iteration|epoch)$"
)
LAT_NAME = r"^(lat|latitude|y)$"
LNG_NAME = r"^(lng|lon|long|longitude|x)$"
YEAR_NAME = r"(^|[_\s-])(year|yr)$"
DATE_NAME = r"(date|time|timestamp|day|created|updated|_at$|_on$)"
CLOCK_NAME = r"(seconds|minutes|time|secs|mins)[_\s-]?(remaining|elapsed|left)"
SITUATION_NAME = r"to[_\s-]?go$|(needed|required|left|remaining)$"
PLACE_DIMENSION_NAME = (
    r"(hectare|neighbou?rhood|borough|district|city|town|state|province|region|zone|area|ward|county|country"
    r"|park|venue|station|site|location|place|market|territory|store|branch)"
)
PLACE_ROLE_NAME = r"^(location|specific_location|hectare|place|park|neighborhood|venue|city|area)$"
PLACE_COLUMN_NAME = r"^(location|specific_location|hectare|place|park|neighborhood)$"
EATING_NAME = r"^(eating|foraging)$"
LABEL_COLUMN_NAME = r"(?:^|_)(label|labels|class|classes|category|categories|target|hint|species)(?:_|$)"

ADDITIVE_WORDS = frozenset("""
sales revenue amount total count qty quantity units profit cost costs
spend spent budget yards yds points goals orders visits views clicks
hours minutes duration downloads sessions income expense expenses paid
volume distance miles gained wins losses deaths cases sold tip tips
fare bill fee fees donation donations calls attempts shots assists
passengers bookings signups purchases tolls
""".split())
LEVEL_WORDS = frozenset("""
avg average mean median rate ratio pct percent percentage share per
price score rating index remaining differential diff age temp temperature
togo yardline rank level grade height length width depth speed density
margin open close high low adjusted
""".split())
COUNTER_WORDS = frozenset("number num no index idx rank order seq".split())
UNIT_WORDS = frozenset("mm cm km kg lb lbs mph kph usd eur gbp ms sec secs hrs mi ft oz g m".split())
CURRENCY_WORDS = frozenset("usd eur gbp".split())
WORD_FIXES = {
    "id": "ID", "qty": "quantity", "avg": "average", "num": "number", "amt": "amount", "pct": "percent",
    "yds": "yards", "qtr": "quarter", "lat": "latitude", "lng": "longitude", "lon": "longitude",
    "url": "URL", "usd": "USD", "gdp": "GDP",
}

# --- questions ---------------------------------------------------------------
STOP_WORDS = frozenset("""
the and for are with where what which when who how does did this that
most more less least many much each per from into than they them their
common identify show find list compare between across over row rows data column
spotted seen have has was were not all any out top number count average total
""".split())
GIVEN_CLAUSE = r"(?i)\b(?:given|based on|using|considering)\b"
PLAY_QUALITY = (
    r"(?i)play\s+quality|quality\s+of\s+(?:the\s+|each\s+|every\s+|these\s+|this\s+)?plays?"
    r"|grad(?:e|ing)\s+(?:the\s+|each\s+|every\s+|these\s+|this\s+)?plays?|plays?\s+grad(?:e|ing)"
    r"|good\s*(?:or|/|vs\.?|versus|-)?\s*bad\s+plays?|bad\s*(?:or|/|vs\.?|versus|-)?\s*good\s+plays?"
    r"|rate\s+(?:the\s+|each\s+|every\s+|these\s+|this\s+)?(?:plays?|quality)"
    r"|how\s+good\s+(?:was|were|is)\s+(?:this|the|each|every)\s+play"
)
WIN_LIKELIHOOD = (
    r"(?i)win[-\s]?likelihood|\bp\s*\(\s*win\s*\)|will\s+(?:this\s+team|the\s+home\s+team)\s+win"
    r"|how\s+(?:the\s+)?game\s+went"
)
PLACE_EATING = (
    r"(?i)where\s+(?:are\s+they|they)\s+eat|which\s+places?\s+have\s+the\s+most\s+eating"
    r"|spotted\s+eating|eating\s+locations?|places?\s+they\s+eat"
)
CLASS_CLAUSE = r"(?i)\b(?:as|into)\s+(.+?)(?:\s+(?:using|with|from|given|based|via)\b|[.?!]|$)"
CLASS_COLON = r":\s*([^.?!]+)"
CLASS_VERSUS = r"(?i)\b([A-Za-z][\w./+-]{0,39})\s+(?:vs\.?|versus)\s+([A-Za-z][\w./+-]{0,39})\b"
CLASS_SPLIT = r"(?i)\s*(?:,|\bor\b|\band\b|\bvs\.?\b|\bversus\b|/)\s*"
CLASS_LABEL = r"^[A-Za-z][\w./+-]{0,39}(?:\s+[A-Za-z][\w./+-]{0,39}){0,2}$"
CLASS_STOP_WORDS = (
    "a", "an", "and", "as", "based", "class", "classes", "classify", "classification",
    "column", "columns", "csv", "data", "each", "every", "field", "fields", "from",
    "given", "into", "it", "its", "label", "labels", "or", "per", "row", "rows",
    "text", "the", "these", "this", "those", "using", "via", "visible", "vs",
    "versus", "with",
)
CLASS_MAX_LENGTH = 80
CLASS_MAX_COUNT = 32
JUNK_PLACE_CLASSES = ("location", "activity", "place", "places", "locations")
JUNK_TITLES = ("notable rows", "rate each row", "yes or no", "play success", "places")
SHIFT_TITLE = r"(?i)\bshift\b|am\s*/\s*pm|\bam-?pm\b"
CLASSIFY_BY_TITLE = r"(?i)^classify by\s+"
TABLE_LABELS_REASON = r"(?i)labels in this table"
JUNK_TITLE_REASON = r"(?i)class bars|labels in this table|classify by shift"

# --- places ------------------------------------------------------------------
PLACE_ALIASES = {
    "ground plane": "On the ground",
    "ground": "On the ground",
    "above ground": "In the trees",
    "above_ground": "In the trees",
}

# --- limits and thresholds -----------------------------------------------------
CSV_MAX_ROWS = 5_000
CSV_MAX_COLUMNS = 100
CSV_MAX_CELL_LENGTH = 8_192
CSV_PREVIEW_ROWS = 8
CSV_MAX_HEADER_LENGTH = 200
LIST_LIMIT = 48
MAX_BARS = 8
MAX_ORDERED_BARS = 12
MIN_GROUP = 5
MAX_BUCKETS = 160
STEADY_BUCKET_ROWS = 12
MIN_BUCKETS = 6
MAX_SCATTER_POINTS = 1500
MAX_STORY_VIEWS = 6
MIN_SCORE = 0.3
MIN_FILL = 0.24
KIND_LIMIT = {
    "map": 1, "trend": 2, "sequence": 1, "traits": 1, "ranking": 3, "rate": 2, "histogram": 1, "scatter": 1,
}
GRAIN_SIZES = {
    "hour": 3_600_000, "day": 86_400_000, "week": 7 * 86_400_000,
    "month": 30.44 * 86_400_000, "quarter": 91.3 * 86_400_000, "year": 365.25 * 86_400_000,
}
STALL_AFTER_SECONDS = 60
STALE_AFTER_SECONDS = 180
MAX_PROPOSALS = 4
UNIT_SUM_TOLERANCE = 1e-6
RESCALE_TOLERANCE = 1e-3
CRITICAL_Z = 2.326
FORECAST_LIMITS = {
    "cadence_ms": 90_000, "rate_window_ms": 90_000, "max_requests_per_window": 1,
    "max_requests": 100, "max_spend_cents": 100, "cost_cents": 1,
}
