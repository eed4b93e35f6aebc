"""Lookup tables, word lists, constants and text patterns.

Everything below is data that has to be exactly what it is for results to come
out right (labels, aliases, stop words, thresholds, patterns over page text).
No logic lives here.
"""

# --- size tiers: id -> display label ---------------------------------------
TIER_LABELS = {
    "quart": "Quart",
    "1gal": "1 Gallon",
    "2gal": "2 Gallon",
    "3gal": "3 Gallon",
    "5gal": "5 Gallon",
    "7gal": "7 Gallon",
    "10gal": "10 Gallon",
    "15gal": "15 Gallon",
    "bareroot": "Bare Root",
    "jumbo-bareroot": "Jumbo Bare Root",
    "premium-bareroot": "Premium Bare Root",
    "1-2ft": "1-2 ft",
    "2-3ft": "2-3 ft",
    "3-4ft": "3-4 ft",
    "4-5ft": "4-5 ft",
    "5-6ft": "5-6 ft",
    "6-7ft": "6-7 ft",
    "7-8ft": "7-8 ft",
    "8-9ft": "8-9 ft",
    "dwarf": "Dwarf",
    "semi-dwarf": "Semi-Dwarf",
    "supreme": "Supreme",
    "ultra-supreme": "Ultra Supreme",
    "standard": "Standard",
    "dwarf-bareroot": "Dwarf (Bare Root)",
    "semi-dwarf-bareroot": "Semi-Dwarf (Bare Root)",
    "supreme-bareroot": "Supreme (Bare Root)",
    "dwarf-potted": "Dwarf (Potted)",
    "semi-dwarf-potted": "Semi-Dwarf (Potted)",
    "potted": "Potted",
    "dwarf-ez-start": "Dwarf EZ Start",
    "semi-dwarf-ez-start": "Semi-Dwarf EZ Start",
    "supreme-ez-start": "Supreme EZ Start",
    "bulb": "Bulb",
    "default": "Best Available",
    "3inch": '3" Pot',
    "4inch": '4" Pot',
    "6inch": '6" Pot',
    "12-18in": '12-18"',
    "18-24in": '18-24"',
    "24-36in": '24-36"',
    "36-48in": '36-48"',
    "48-54in": '48-54"',
}

# --- size tiers: spelling seen in data -> tier id ----------------------------
TIER_ALIASES = {
    "1-gallon": "1gal",
    "1-gallon-pot": "1gal",
    "1gal-pot": "1gal",
    "1-gal": "1gal",
    "1gallon": "1gal",
    "#1": "1gal",
    "#1-container": "1gal",
    "1-container": "1gal",
    "2-gallon": "2gal",
    "2-gallon-pot": "2gal",
    "2-gal": "2gal",
    "2gallon": "2gal",
    "#2": "2gal",
    "#2-container": "2gal",
    "3-gallon": "3gal",
    "3-gallon-pot": "3gal",
    "3-gal": "3gal",
    "3gallon": "3gal",
    "#3": "3gal",
    "#3-container": "3gal",
    "5-gallon": "5gal",
    "5-gallon-pot": "5gal",
    "5-gal": "5gal",
    "5gallon": "5gal",
    "#5": "5gal",
    "#5-container": "5gal",
    "qt": "quart",
    "quart-container": "quart",
    "bare-root": "bareroot",
    "bare root": "bareroot",
    "dormant": "bareroot",
    "1-galllon": "1gal",
    "2-gallons": "2gal",
    "3-gallons": "3gal",
    "5-gallons": "5gal",
    "3-pot": "3inch",
    "6-inch-pot": "6inch",
    "trade-gallon": "1gal",
}

# --- size tiers: display order ------------------------------------------------
TIER_ORDER = [
    "quart", "1gal", "2gal", "3gal", "5gal", "7gal", "10gal", "15gal",
    "bareroot", "jumbo-bareroot", "premium-bareroot",
    "1-2ft", "2-3ft", "3-4ft", "4-5ft", "5-6ft", "6-7ft", "7-8ft", "8-9ft",
    "dwarf", "dwarf-bareroot", "dwarf-ez-start", "dwarf-potted",
    "semi-dwarf", "semi-dwarf-bareroot", "semi-dwarf-ez-start", "semi-dwarf-potted",
    "supreme", "supreme-bareroot", "supreme-ez-start",
    "ultra-supreme", "standard", "potted",
    "bulb", "3inch", "4inch", "6inch", "default",
    "12-18in", "18-24in", "24-36in", "36-48in", "48-54in",
]
HIDDEN_TIER = "default"

# --- size titles: text to drop before the size is looked for -----------------
SIZE_NOISE_PATTERNS = [
    r"/\s*\d+\s*plant\(s\)",
    r"\|\s*ships?\s+in\s+\S+",
    r"/\s*ship\s+week\s+\d+\s*\([^)]*\)",
    r"/?\s*ships?\s+now",
]

# --- size titles: pot patterns, first hit wins ---------------------------------
POT_PATTERNS = [
    (r"\b1[\s-]?gal(?:lon)?s?\b", "1gal"),
    (r"one\s+gallon", "1gal"),
    (r"#1\s*container", "1gal"),
    (r"trade\s+gallon", "1gal"),
    (r"\b2[\s-]?gal(?:lon)?s?\b", "2gal"),
    (r"#2\s*container", "2gal"),
    (r"\b3[\s-]?gal(?:lon)?s?\b", "3gal"),
    (r"3\s*gallon\s*pot", "3gal"),
    (r"#3\s*container", "3gal"),
    (r"\b5[\s-]?gal(?:lon)?s?\b", "5gal"),
    (r"#5\s*container", "5gal"),
    (r"\b7[\s-]?gal(?:lon)?s?\b", "7gal"),
    (r"#7\s*container", "7gal"),
    (r"\b10[\s-]?gal(?:lon)?s?\b", "10gal"),
    (r"\b15[\s-]?gal(?:lon)?s?\b", "15gal"),
    (r"\bquart\b", "quart"),
    (r"\bqt\b", "quart"),
    (r"one\s+quart", "quart"),
    (r'4\.5[\s-]?(?:in|")', "quart"),
    (r'\b3[\s-]?(?:inch|in|")\s*pot', "3inch"),
    (r"\b4[\s-]?inch", "4inch"),
    (r'\b4[\s-]?"', "4inch"),
    (r"\b6[\s-]?inch\s*pot", "6inch"),
]
# Texts that a title must hold for the pot pattern at the same place to match; looked for first, as that is cheap.
POT_NEEDLES = [
    ("gal", "1"), ("one", "gallon"), ("#1", "container"), ("trade", "gallon"), ("gal", "2"), ("#2", "container"),
    ("gal", "3"), ("gallon", "pot"), ("#3", "container"), ("gal", "5"), ("#5", "container"), ("gal", "7"),
    ("#7", "container"), ("gal", "10"), ("gal", "15"), ("quart",), ("qt",), ("one", "quart"), ("4.5",), ("pot", "3"),
    ("4", "inch"), ("4", '"'), ("inch", "pot"),
]
FIELD_INCH_PATTERN = r'(\d+)\s*[-–]\s*(\d+)\s*"'
HEIGHT_RANGE_PATTERN = r"(\d+)\s*[-–]\s*(\d+)\s*(?:ft|feet|foot|')"
HEIGHT_SINGLE_PATTERN = r"\b(\d+)\s*(?:ft|feet|foot|')\b"

# --- variants that are not a single item -----------------------------------------
PACK_TITLE_PATTERN = r"(?i)(?:[2-9]|1\d)[\s-]*(?:plant|pack)"
SHIPS_IN_PATTERN = r"(?i)ships?\s+in\s+(spring|fall|summer|winter)"

# --- calendar -----------------------------------------------------------------
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
SEASON_FIELDS = ["spring", "fall", "summer"]

# Planting windows per hardiness zone: one set per plant kind.
PERENNIAL_SEASONS = {
    3: ("May-Jun", "Sep"),
    4: ("Apr-May", "Sep-Oct"),
    5: ("Apr-May", "Sep-Oct"),
    6: ("Mar-May", "Sep-Nov"),
    7: ("Mar-Apr", "Oct-Nov"),
    8: ("Feb-Apr", "Oct-Dec"),
    9: ("Feb-Mar", "Nov-Dec"),
    10: ("Jan-Mar", "Nov-Dec"),
    11: ("Jan-Feb", "Nov-Dec"),
}
TREE_SEASONS = {
    3: ("May", None),
    4: ("Apr-May", "Oct"),
    5: ("Apr-May", "Oct"),
    6: ("Mar-Apr", "Oct-Nov"),
    7: ("Feb-Apr", "Nov"),
    8: ("Jan-Mar", "Nov-Dec"),
    9: ("Jan-Feb", "Dec"),
    10: ("Jan-Feb", "Dec"),
    11: ("Dec-Jan", "Dec"),
}

# --- name matching ---------------------------------------------------------------
# Removed from names as plain substrings, in this order.
MATCH_DROP_SUBSTRINGS = [
    "proven winners", "proven winners®", "endless summer®",
    "knock out®", "encore®", "for sale", "buy", "online",
    "tree", "shrub", "bush", "plant", "bare root", "bareroot",
]
MATCH_NOISE_WORDS = ["the", "a", "an", "of", "for", "and", "or", "in", "at", "to", "by"]
WIDE_NOISE_WORDS = [
    "the", "a", "an", "of", "for", "and", "or", "in", "at", "to", "by",
    "tree", "shrub", "bush", "plant", "buy", "sale", "online", "live",
]

# --- promotions: code and banner patterns -----------------------------------------
PROMO_CODE_PATTERNS = [
    r"(?i)(?:use\s+(?:code|coupon|promo)\s*[:\-]?\s*)([A-Z0-9]{4,20})",
    r"(?i)(?:get|save|extra)\s+\d+%\s+off\s+with\s+(?:code\s+)?([A-Z0-9]{4,20})",
    r"\bcode\s+([A-Z][A-Z0-9]{3,19})\b",
]
PROMO_BANNER_PATTERNS = [
    r"(?i)free\s+shipping\s+(?:on\s+orders?\s+over|when\s+you\s+spend)\s*\$?([\d,]+)",
    r"(?i)(\d{1,2})\s*%\s*off\s+(?:your\s+(?:first|next|entire)\s+order|all\s+orders?|site-?wide)",
    r"(?i)(?:save|extra)\s+\$(\d+)\s+(?:on\s+(?:your\s+(?:first|next)|orders?\s+over\s+\$[\d,]+))",
    r"(?i)(?:buy\s+\d+\s*[,/]\s*get\s+\d+\s+free)",
    r"(?i)flash\s+sale",
    r"(?i)limited[\s-]time\s+offer",
]
CONTEXT_CODE_PATTERNS = [
    r"(?i)(?:use|enter|apply)\s+(?:code\s+)?([A-Z][A-Z0-9]{2,19})\b",
    r"(?i)promo(?:\s+code)?[:\s]+([A-Z][A-Z0-9]{2,19})\b",
    r"(?i)coupon(?:\s+code)?[:\s]+([A-Z][A-Z0-9]{2,19})\b",
    r"(?i)discount(?:\s+code)?[:\s]+([A-Z][A-Z0-9]{2,19})\b",
    r"(?i)code[:\s]+([A-Z][A-Z0-9]{2,19})\b",
]
CONTEXT_CODE_STOPLIST = ["HTTP", "HTML", "FREE", "SHIP", "SALE", "BEST", "MORE", "SHOP", "VIEW"]
CONTEXT_SAVINGS_PATTERN = r"(?i)(?:save|get)\s+(?:up\s+to\s+)?(\d+%|\$\d+)\s+(?:off|on)"
PROMO_BAR_CLASSES = ["announcement", "header-banner", "promo-bar", "top-bar", "site-wide", "marquee"]

# --- store pages ---------------------------------------------------------------------
SIZE_NAME_KEYWORDS = [
    "quart", "gal", "gallon", "ft", "foot", "feet", "pack",
    "bare", "bulb", "root", "inch", "qt", "container",
]
SIZE_NAME_PREFIX_PATTERN = r"^\d+-\d+\s*(ft|feet|foot)"
VARIANT_PAIR_PATTERN = r'ProductVariant/(\d+)"?,"([^"]+?)"'
VARIANT_SELECTED_PATTERN = r'(?s)ProductVariant/(\d+)".*?"selectedOptions"\s*:\s*\[([^\]]+)\]'
VARIANT_OPTION_VALUES_PATTERN = r'(?s)^(\d+)".*?"optionValues"\s*:\s*\[([^\]]*)\]'
VARIANT_OPTION1_PATTERN = r'"id"\s*:\s*(\d{10,})\b[^}]*?"option1"\s*:\s*"([^"]+)"'
VARIANT_TITLE_PATTERN = r'"id"\s*:\s*(\d{10,})\s*,\s*"title"\s*:\s*"([^"]+)"'
VARIANT_BLOB_PATTERN = r'(?s)"variants"\s*:\s*\[(\{[^\]]{20,})\]'
VARIANT_BLOB_ITEM_PATTERN = r'"id"\s*:\s*(\d{10,})\b[^}]*?"option1"\s*:\s*"([^"]*)"'
VARIANT_BUTTON_PATTERN = r'data-variant-id=["\'](\d{10,})["\'][^>]*>([^<]{2,40})<'
OFFER_PATTERN = (
    r'(?d)\{"@type":"Offer","sku":"(\d+(?:-\w+)?)".*?"price":"([\d.]+)".*?"availability":"([^"]+)"'
)
PLAIN_OFFER_PATTERN = (
    r'(?d)\{"@type":"Offer","sku":"(\d+)".*?"price":"([\d.]+)".*?"availability":"([^"]+)"'
)
OFFER_START = '{"@type":"Offer","sku":"'  # both patterns begin with it
OFFER_PRICE_PATTERN = r'"price":"([\d.]+)"'
STRIKETHROUGH_PATTERN = r'(?d)"sku":"(\d+)".*?"StrikethroughPrice".*?"price":"([\d.]+)"'
ARIA_PRICE_PATTERN = (
    r'aria-label="([^"]*?)\s*-\s*Sale price:\s*([\d.]+)\s*-\s*List price:\s*\$?([\d.]+)'
)
ARIA_HEIGHT_BUTTON_PATTERN = r'(?i)aria-(?:label|pressed)="[^"]*"[^>]*>(\d+-\d+\s*(?:ft|feet|foot))'
PLAIN_HEIGHT_BUTTON_PATTERN = r"(?i)>(\d+-\d+\s*(?:ft|feet))\s*<"
ARIA_POT_BUTTON_PATTERN = r'(?i)aria-(?:label|pressed)="[^"]*"[^>]*>(\d+\s*(?:gallon|gal|quart|qt))'
PAGE_TITLE_PATTERN = r"<title>([^<]+)</title>"
DATALAYER_PATTERN = r'(?s)dataLayer\.push\((\{"productFamilyList".*?\})\);'
JSONLD_PATTERN = (
    r'(?s)<script type="application/ld\+json">\s*(\{.*?"@type"\s*:\s*"TYPE".*?\})\s*</script>'
)

# --- attribute text ------------------------------------------------------------------
ZONE_LIST_PATTERN = r"(?i)(?:hardiness\s+)?zones?\s*:?\s*((?:\d{1,2}\s*,\s*)+\d{1,2})"
ZONE_RANGE_PATTERN = r"(?i)(?:hardiness|growing|usda)?\s*zones?\s*:?\s*(\d{1,2})\s*[-–to]+\s*(\d{1,2})"
SUN_PATTERN = (
    r"(?i)(?:sun\s*(?:exposure|requirements?)?|light\s*(?:needs?|requirements?))\s*:?\s*"
    r"(full\s+sun(?:\s+to\s+part\s+shade)?|part\s+shade(?:\s+to\s+full\s+(?:sun|shade))?|"
    r"full\s+shade|full\s+sun\s+to\s+full\s+shade)"
)
HEIGHT_PATTERN = r"(?i)(?:mature\s+)?height\s*:?\s*(\d+(?:\s*[-–to]+\s*\d+)?\s*(?:ft\.?|feet|'))"
WIDTH_PATTERN = r"(?i)(?:mature\s+)?(?:width|spread)\s*:?\s*(\d+(?:\s*[-–to]+\s*\d+)?\s*(?:ft\.?|feet|'))"
BLOOM_PATTERN = (
    r"(?i)(?:bloom\s*(?:time|season|period)?|flowering\s*(?:time|season)?)\s*:?\s*"
    r"([A-Za-z][A-Za-z\s,\-–]+?)(?=<|$|\n)"
)
TYPE_PATTERN = r"(?i)(?:plant\s+)?type\s*:?\s*([A-Za-z][A-Za-z\s]+?)(?=<|$|\n)"
# Table keys per attribute, in order of preference.
ZONE_KEYS = ["zones", "zone", "hardiness zones", "hardiness zone", "growing zones", "usda zones"]
SUN_KEYS = ["sun", "light", "sun exposure", "light needs", "sun requirements", "light requirements"]
HEIGHT_KEYS = ["height", "mature height"]
WIDTH_KEYS = ["width", "mature width", "spread", "mature spread"]
BLOOM_KEYS = ["bloom time", "bloom season", "bloom period", "flowering time", "flowering season"]
TYPE_KEYS = ["type", "plant type"]

# --- catalog drafts --------------------------------------------------------------------
POT_SIZE_TERMS = {
    "quart": ["1 quart", "qt", "4.5 inch", "4.5 in"],
    "1gal": ["1 gallon", "1 gal", "#1 container", "1g", "trade gallon"],
    "2gal": ["2 gallon", "2 gal", "#2 container"],
    "3gal": ["3 gallon", "3 gal", "#3 container"],
    "5gal": ["5 gallon", "5 gal", "#5 container"],
}
BAREROOT_SIZE_TERMS = {"bareroot": ["bare root", "bare-root"]}
TREE_CATEGORIES = ["shade-trees", "flowering-trees", "privacy-trees", "fruit-trees"]
RECONCILED_FIELDS = ["zones", "sun", "mature_size", "bloom_time", "type"]

# --- guides -----------------------------------------------------------------------------
FALLBACK_GUIDE = "cheapest-places-to-buy-online"
STATIC_SITE_URLS = [
    "/", "/my-list.html", "/heat-map.html", "/improve.html", "/guides/index.html",
    "/disclosure.html", "/privacy.html", "/about.html",
]

# --- feedback labels -----------------------------------------------------------------------
FEEDBACK_CATEGORY_LABELS = {
    "missing-plants": "Missing Plants",
    "price-data": "Price Data",
    "site-feature": "Feature Request",
    "bug": "Bug",
    "other": "Other",
}
FEEDBACK_STATUS_LABELS = {
    "reviewing": "Under Review",
    "planned": "Planned",
    "in-progress": "In Progress",
    "responded": "Responded",
    "done": "Done ✓",
}

# --- thresholds -----------------------------------------------------------------------------
STALE_DAYS = 30
RUN_GAP_HOURS = 12
MISSED_RUNS_UNAVAILABLE = 3
SWING_PCT = 50.0
OUTLIER_RATIO = 3.0
PRICE_TOLERANCE = 0.02
HEALTH_FLOOR = 0.8
MATCH_THRESHOLD = 0.6
WIDE_MATCH_THRESHOLD = 0.55
COOLDOWN_HOURS = 20
MAX_ATTEMPTS = 7
