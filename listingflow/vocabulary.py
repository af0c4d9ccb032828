"""Fixed values.

Word lists, patterns and defaults that results depend on. They are data, not
logic: every operator takes them as parameters and uses these as the default.
"""

# --- fixed values: text -----------------------------------------------------

CURRENCY_SYMBOLS = "$£€¥₹₽₩₪₦₨₫₱₲₴₵₸₺₻₼₾₿"

NON_AMOUNT_WORDS = ["amount", "varies", "not specified", "tbd", "to be determined"]

# Removed one after the other, in this order.
REDUNDANT_PHRASES = [
    "Applicant must be",
    "Applicants must be",
    "Student must be",
    "Students must be",
    "Candidate must be",
    "Candidates must be",
    "The applicant must be",
    "The student must be",
    "The candidate must be",
    "Must be",
    "Should be",
    "Required to be",
    "Needs to be",
    "Has to be",
]

MAX_TEXT_LENGTH = 1000
CLIP_LENGTHS = {"name": 200, "description": 500, "academic_level": 50, "eligibility": 500}

# --- fixed values: deadlines -------------------------------------------------

MONTHS = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]

OPEN_ENDED = ["rolling", "no deadline", "ongoing", "continuous", "open"]
OPEN_ENDED_VIEW = ["rolling", "ongoing", "continuous", "open"]
OPEN_ENDED_ROLLUP = ["rolling"]

# --- fixed values: classification ---------------------------------------------

MERIT_PHRASES = [
    "merit-based", "merit based", "academic merit", "gpa",
    "grade point average", "academic excellence", "achievement",
]
NEED_PHRASES = [
    "fafsa", "free application for federal student aid", "need-based", "need based",
    "financial need", "financial hardship", "low income", "economic need",
]

# tag -> (any of these, unless one of those)
ACADEMIC_LEVELS = {
    "undergraduate": (["undergraduate", "undergrad"], []),
    "graduate": (["graduate", "grad"], []),
    "masters": (["masters", "master", "ms", "ma"], []),
    "doctorate": (["doctorate", "doctoral", "phd", "ph.d"], []),
    "freshman": (["freshman", "first year"], []),
    "sophomore": (["sophomore", "second year"], []),
    "junior": (["junior", "third year"], []),
    "senior": (["senior", "fourth year"], []),
    "high school": (["high school", "secondary school"], []),
    "college": (["college"], ["graduate"]),
    "university": (["university"], ["graduate"]),
}

ETHNICITIES = {
    "African American": (["african american", "black", "african-american"], []),
    "Hispanic": (["hispanic", "latino", "latina", "latinx"], []),
    "Asian": (["asian", "asian american", "asian-american"], []),
    "Native American": (
        ["native american", "indigenous", "american indian", "alaska native"], []),
    "Pacific Islander": (["pacific islander", "hawaiian", "polynesian"], []),
    "White": (["white", "caucasian"], []),
    "Middle Eastern": (["middle eastern", "arab", "arabic"], []),
    "Minority": (["minority", "underrepresented"], []),
    "International": (["international", "foreign", "immigrant"], []),
}

# First entry whose phrase occurs wins ("women only" contains "men only").
EXPLICIT_GENDERS = [
    ("female", ["women only", "female only"]),
    ("male", ["men only", "male only"]),
]

ELIGIBILITY_TARGETS = [
    ("need", ["need-based", "financial need"]),
    ("merit", ["merit", "academic achievement"]),
]
ELIGIBILITY_ETHNICITIES = [
    "african american", "hispanic", "latino", "asian", "native american",
    "minority", "diverse", "multicultural",
]
ELIGIBILITY_GENDERS = [("female", ["women", "female"]), ("male", ["men", "male"])]
ELIGIBILITY_LEVELS = [
    "undergraduate", "graduate", "phd", "masters", "bachelors",
    "high school", "community college",
]
ESSAY_WORDS = ["essay", "personal statement"]
RECOMMENDATION_WORDS = ["recommendation", "reference"]

RENEWABLE_WORDS = {
    "table": ["years", "annual", "renewable"],
    "list": ["yes", "renewable"],
    "reply": ["true", "yes"],
}

ORGANIZATION_NOUNS = [
    "university", "college", "foundation", "institute", "association", "corporation",
]
UNKNOWN_ORGANIZATION = "Unknown Organization"
UNKNOWN_TITLE = "Unknown Scholarship"

# --- fixed values: pages --------------------------------------------------------

PAGE_KEYWORDS = ["scholarship", "financial-aid", "award", "tuition assistance"]
PAGE_ACTION_WORD = "apply"
PAGE_DETAIL_WORDS = ["deadline", "amount", "eligibility"]

CRAWL_SCOPE = {
    "allowed_suffixes": [".edu", ".org", ".gov"],
    "blocked_domains": ["facebook.com", "twitter.com", "linkedin.com"],
    "allowed_paths": ["/scholarship", "/financial-aid", "/grants", "/awards"],
    "blocked_paths": ["/login", "/signup", "/cart", "/checkout"],
    "keyword_patterns": [
        "scholarship", "financial aid", "grant", "award", "fellowship",
        "tuition assistance",
    ],
    "max_pages_per_domain": 50,
    "max_depth": 3,
}

AWARD_TYPE_WORD = "scholarship"
HEADER_TITLES = ["Award Name"]
PROMO_TITLES = ["Find Scholarships"]
NO_RESTRICTION = "No Geographic Restrictions"
MISSING_AMOUNT_TABLE = "Amount not specified"
MISSING_AMOUNT_BLOCK = "Amount varies"
MISSING_DEADLINE = "No deadline specified"
LOCATION_LABELS = ["location", "geographic restrictions", "state", "region", "area"]
BROAD_CLASS_TERMS = ["scholarship", "award", "grant", "result", "item"]
BROAD_SELECTORS = {
    "name": ["h1", "h2", "h3", "h4", "h5", "strong", "b", ".title", ".name",
             ".scholarship-title"],
    "organization": [".organization", ".sponsor", ".company", ".provider"],
    "amount": [".amount", ".award", ".funds", ".value", "strong", "b"],
    "deadline": [".deadline", ".due-date", ".application-deadline", ".date"],
    "description": [".description", ".summary", ".details", "p"],
}

# --- fixed values: field aliases, first non-empty wins --------------------------------

API_ALIASES = {
    "name": ["title", "name"],
    "description": ["description", "summary"],
    "url": ["url", "link"],
    "organization": ["organization", "sponsor", "provider"],
    "amount": ["amount", "award_amount"],
}
REPLY_ALIASES = {
    "name": ["title", "name", "scholarship_name"],
    "deadline": ["deadline", "application_deadline"],
    "description": ["description", "purpose"],
    "organization": ["organization", "sponsor", "institution"],
    "geographic_restrictions": [
        "geographic_restrictions", "geographicRestrictions", "location", "region"],
    "min_amount": ["min_amount", "minAmount", "amount", "award_amount"],
    "max_amount": ["max_amount", "maxAmount", "amount", "award_amount"],
    "renewable": ["renewable"],
    "country": ["country", "nationality"],
    "apply_url": ["apply_url", "applyUrl", "application_url", "url"],
    "eligibility": ["eligibility", "requirements", "qualifications"],
    "url": ["url", "website", "application_url"],
}
REPLY_LEVEL_FIELDS = ["academic_level", "academicLevel", "level_of_study", "education_level"]
REPLY_FALLBACKS = {
    "name": "Scholarship",
    "deadline": "Various deadlines",
    "description": "No description available",
    "min_amount": "Amount varies",
    "max_amount": "Amount varies",
    "eligibility": "Eligibility requirements vary",
    "country": "US",
}

# Source field name -> canonical column.
FIELD_NAMES = {
    "scholarshipId": "scholarship_id",
    "academicLevel": "academic_level",
    "geographicRestrictions": "geographic_restrictions",
    "targetType": "target_type",
    "minAward": "min_award",
    "maxAward": "max_award",
    "applyUrl": "apply_url",
    "isActive": "is_active",
    "essayRequired": "essay_required",
    "recommendationsRequired": "recommendations_required",
    "createdAt": "created_at",
    "updatedAt": "updated_at",
}

# --- fixed values: keyword lists by category --------------------------------------------

KEYWORDS = {
    "scholarship": [
        "scholarship", "college scholarship", "financial aid", "grant", "fellowship", "award",
    ],
    "academic": [
        "undergraduate", "graduate", "doctoral", "masters", "phd", "bachelors", "associates",
        "high school", "community college", "university", "college",
    ],
    "field": [
        "STEM", "engineering", "computer science", "medical", "nursing", "business", "law",
        "education", "arts", "humanities", "social sciences", "natural sciences", "technology",
        "mathematics", "physics", "chemistry", "biology",
    ],
    "demographic": [
        "women", "minority", "first generation", "veteran", "disability", "LGBTQ",
        "international student", "hispanic", "african american", "asian american",
        "native american", "pacific islander", "low income", "rural", "urban",
    ],
    "geographic": [
        "california", "new york", "texas", "florida", "illinois", "pennsylvania", "ohio",
        "georgia", "north carolina", "michigan", "new jersey", "virginia", "washington",
        "massachusetts", "indiana", "tennessee", "missouri", "maryland", "colorado",
        "wisconsin",
    ],
}

# --- fixed values: errors, bounds, statuses -----------------------------------------------

ERROR_CLASSES = [
    ("throttling", ["throttlingexception", "too many requests", "rate exceeded"]),
    ("timeout", ["timeout", "timed out"]),
]
AWARD_BOUNDS = (100, 100000)
ARCHIVE_TIERS = [(90, "cold"), (30, "infrequent"), (0, "standard")]
TARGET_TYPES = ["need", "merit", "both"]
JOB_STATUSES = ["pending", "running", "completed", "failed"]
APPLICATION_STATUSES = ["draft", "submitted", "approved", "rejected", "withdrawn"]
SITE_TYPES = ["api", "crawl", "search", "discovery"]
SITE_NAME_LENGTH = 100
SITE_URL_LENGTH = 500
MAX_LENGTHS = {
    "name": 500, "deadline": 100, "organization": 255, "academic_level": 100,
    "ethnicity": 100, "gender": 50, "country": 50, "source": 100, "job_id": 255,
}
