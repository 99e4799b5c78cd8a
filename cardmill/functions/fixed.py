"""Values that have to be exactly these for results to be right.

Vocabularies, prefixes, weights and thresholds of the business-card domain. Everything here is
plain data; the rules that use it live in the operator modules.
"""

# The closed field vocabulary and the provenance order.
FIELD_KEYS = ["person_name", "company", "designation", "phone", "email", "website", "address"]
SOURCES = ["printed", "user", "aiInferred", "outdated", "verified"]
ATTENTION_STATUSES = ["failed", "partial"]
PROVENANCE_ISSUES = ["digit_restored", "ocr_repaired"]

# Bengali digits zero to nine, and letters that are misread digits.
BENGALI_DIGITS = "০১২৩৪৫৬৭৮৯"
LATIN_DIGITS = "0123456789"
CONFUSABLE_LETTERS = "OoDQIl|iZzASsGbTBgq"
CONFUSABLE_DIGITS = "0000111122455667899"

# Country code and allocated mobile prefixes with their operators.
COUNTRY_CODE = "880"
MOBILE_OPERATORS = {
    "013": "Grameenphone",
    "014": "Banglalink",
    "015": "Teletalk",
    "016": "Airtel",
    "017": "Grameenphone",
    "018": "Robi",
    "019": "Banglalink",
}

# Suffixes that make a bare host a website.
KNOWN_SUFFIXES = [
    "com.bd", "net.bd", "org.bd", "edu.bd", "gov.bd", "ac.bd", "mil.bd",
    "co.uk", "co.in",
    "bd", "com", "net", "org", "info", "biz", "io", "co", "xyz", "app",
    "dev", "shop", "store", "online", "agency", "in",
]

# Whole words that mark a job title, an address line, a business line.
DESIGNATION_WORDS = [
    "ceo", "cto", "coo", "cfo", "md", "managing director", "director",
    "chairman", "president", "vice president", "founder", "co-founder",
    "partner", "proprietor", "owner", "manager", "senior manager",
    "assistant manager", "general manager", "executive", "sales executive",
    "marketing executive", "officer", "engineer", "consultant", "advisor",
    "head", "chief", "supervisor", "coordinator", "analyst", "accountant",
    "advocate", "architect", "designer", "developer", "in charge",
    "incharge", "representative", "agent", "assistant", "associate",
]
ADDRESS_WORDS = [
    "road", "rd.", "house", "flat", "level", "floor", "block", "sector",
    "avenue", "lane", "plot", "suite", "tower", "plaza", "market",
    "dhaka", "chittagong", "chattogram", "sylhet", "rajshahi", "khulna",
    "barisal", "rangpur", "mymensingh", "comilla", "narayanganj",
    "gulshan", "banani", "dhanmondi", "uttara", "mirpur", "motijheel",
    "bashundhara", "mohakhali", "badda", "tejgaon", "farmgate", "shantinagar",
    "bangladesh",
]
COMPANY_WORDS = [
    "ltd", "limited", "pvt", "private", "inc", "llc", "corp", "corporation",
    "company", "co.", "enterprise", "enterprises", "trading", "traders",
    "industries", "group", "agency", "agencies", "solutions", "services",
    "systems", "technologies", "tech", "associates", "international",
    "store", "shop", "house", "centre", "center", "mart", "bazar", "bazaar",
    "press", "printers", "printing", "studio", "clinic", "hospital",
    "pharmacy", "restaurant", "hotel", "books", "library",
]
UNIT_WORDS = [
    "shop", "house", "holding", "flat", "apartment", "suite", "room", "level", "floor", "plot",
    "block", "sector", "building", "unit",
]
GENERIC_MAILBOXES = [
    "info", "sales", "contact", "admin", "support", "office", "hello",
    "enquiry", "enquiries", "inquiry", "mail", "help", "service", "services",
    "marketing", "accounts", "booking", "bookings", "order", "orders",
]

# Tokens dropped before names are compared, and before initials are taken.
HONORIFICS = [
    "md", "mohammad", "mohammed", "mohd", "muhammad",
    "mr", "mrs", "ms", "miss",
    "dr", "prof", "professor",
    "engr", "engineer", "adv", "advocate",
    "alhaj", "alhajj", "hajji", "late",
]
LEGAL_SUFFIXES = [
    "ltd", "limited", "pvt", "private", "inc", "incorporated",
    "co", "company", "corp", "corporation", "llc", "plc",
    "enterprise", "enterprises", "trading", "traders",
]
INITIALS_SKIP = [
    "md", "md.", "mohammad", "mohammed", "mohd", "mohd.", "muhammad",
    "mr", "mr.", "mrs", "mrs.", "ms", "ms.", "miss",
    "dr", "dr.", "prof", "prof.", "engr", "engr.", "alhaj", "late",
]

# Category cues in label order; ties go to the earlier label.
CATEGORY_CUES = {
    "printing": ["print", "printing", "press", "banner", "flex", "signage", "t-shirt", "tshirt",
                 "screen print", "offset", "digital print"],
    "books": ["book", "books", "library", "stationery", "publisher"],
    "food": ["restaurant", "cafe", "catering", "bakery", "sweets", "biryani", "food"],
    "electronics": ["electronics", "computer", "laptop", "mobile", "repair", "hardware"],
    "clothing": ["apparel", "garment", "fashion", "tailor", "boutique", "hoodie", "shirt",
                 "wholesale clothing", "paikari"],
    "events": ["event", "decor", "decoration", "wedding", "sound", "lighting", "led", "stage",
               "photography"],
    "medical": ["doctor", "clinic", "hospital", "pharmacy", "medical", "dental", "diagnostic"],
    "construction": ["construction", "engineer", "contractor", "interior", "architect", "furniture",
                     "electrician", "plumber"],
    "transport": ["transport", "courier", "logistics", "delivery", "cargo", "rent a car"],
}

# Attribute cues; within a key the first value with a hit wins.
ATTRIBUTE_CUES = {
    "price_tier": {
        "cheap": ["cheap", "affordable", "low price", "reasonable", "budget", "komdame", "kom dame"],
        "expensive": ["expensive", "costly", "premium", "pricey"],
    },
    "min_order": {
        "low": ["low quantity", "small order", "kom quantity", "minimum order", "small quantity",
                "few pieces"],
        "wholesale": ["wholesale", "paikari", "bulk"],
    },
    "delivery_reliability": {
        "late": ["late", "delayed", "slow delivery", "deri"],
        "fast": ["fast", "quick", "on time", "same day"],
    },
    "quality": {
        "good": ["good quality", "quality good", "excellent", "great"],
        "poor": ["poor quality", "bad quality", "low quality"],
    },
}
ANSWER_KEYS = ["price_tier", "min_order", "delivery_reliability", "quality", "service", "location"]

# Utility weights (the positive ones sum to 1) and the two penalties.
WEIGHTS = {
    "semantic": 0.38,
    "note_relevance": 0.18,
    "category_match": 0.12,
    "trust": 0.10,
    "location": 0.08,
    "previous_use": 0.06,
    "verified": 0.05,
    "freshness": 0.03,
}
PENALTIES = {"penalty_expired": 0.50, "penalty_outdated": 0.20}
SIGNAL_DEFAULTS = {"trust": 0.5, "freshness": 0.5}

# Retrieval and scoring constants.
RRF_K = 60
ARM_LIMIT = 50
RESULT_LIMIT = 20
SIMILARITY_FLOOR = 0.25
BM25_K1 = 1.2
BM25_B = 0.75
BM25_IDF_FLOOR = 1e-6
HALF_LIFE_DAYS = 730
REASON_THRESHOLD = 0.02
GATE_THRESHOLD = 0.60
GATE_ENGINE = "routed"
UNDO_SECONDS = 5
UNKNOWN_CONFIDENCE_SCORE = 0.6
