"""Word lists, patterns, thresholds and texts the results depend on."""

# --- landing files -----------------------------------------------------------
IMAGE_TYPES = {
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".webp": "image/webp",
    ".gif": "image/gif",
}
DEFAULT_MEDIA_TYPE = "image/png"

# --- capture lines -----------------------------------------------------------
CONFIDENCE_LABELS = {"high": 0.95, "medium": 0.7, "low": 0.4}
DEFAULT_CONFIDENCE = 0.5
DOSE_UNITS = ["mg", "mcg", "g", "ml", "iu", "%"]
DOSE_MIN = 0.0
DOSE_MAX = 100000.0
DOSE_PATTERN = r"(?i)([\d.]+)\s*(mg|mcg|g|ml|iu|%)"
QUANTITY_PATTERN = r"(?i)(?:x|×)\s*(\d+)"

# --- dosage forms ------------------------------------------------------------
FORM_PREFIXES = [
    "tab", "tablet", "cap", "capsule", "syp", "syrup", "inj", "injection",
    "oint", "cream", "drops?", "t", "c",
]
FORM_PREFIXES_SHORT = [
    "tab", "tablet", "cap", "capsule", "syp", "syrup", "inj", "t", "c",
]
FORM_SUFFIX_QUALIFIERS = [
    "oral", "dry", "eye", "ear", "nasal", "dispersible", "effervescent", "chewable",
]
FORM_SUFFIXES = [
    "tablets?", "capsules?", "syrups?", "injections?", "suspensions?", "creams?", "gels?",
    "ointments?", "drops?", "solutions?", "infusions?", "respules?", "rotacaps?", "inhalers?",
    "sachets?", "sprays?", "lotions?", "powders?", "kits?", "soaps?", "shampoos?",
    "expectorants?",
]

# --- compositions ------------------------------------------------------------
SPELLING = {
    "amoxycillin": "amoxicillin",
    "acetaminophen": "paracetamol",
    "cetrizine": "cetirizine",
    "levocetrizine": "levocetirizine",
    "albuterol": "salbutamol",
    "glimepride": "glimepiride",
    "adrenaline": "epinephrine",
    "frusemide": "furosemide",
    "sodium valproate": "valproate",
    "valproic acid": "valproate",
    "isosorbide-5-mononitrate": "isosorbide mononitrate",
    "glyceryl trinitrate": "nitroglycerin",
    "vitamin d3": "vitamin d3",
    "cholecalciferol": "vitamin d3",
    "ferrous ascorbate": "iron",
    "ferrous fumarate": "iron",
    "ferrous sulphate": "iron",
    "ferrous sulfate": "iron",
    "carbonyl iron": "iron",
    "thyroxine": "levothyroxine",
    "dicyclomine hcl": "dicyclomine",
    "metformin hcl": "metformin",
}
PAREN_STRENGTH_PATTERN = r"^(.*?)\s*\(([^)]*)\)\s*$"
GLUED_STRENGTH_PATTERN = r"(?i)^(.*?)\s+([\d.]+\s*(?:mg|mcg|g|iu|ml|%)[\w./%]*)$"
TRAILING_DOSE_PATTERN = r"[\s-]*\d+[\w./]*$"

# --- matching ----------------------------------------------------------------
BLOCK_LENGTH = 3
BATCH_THRESHOLD = 85
CURATED_THRESHOLD = 72
CURATED_STOP = 95
BULK_THRESHOLD = 85
ALTERNATIVES_SHORT = 5
ALTERNATIVES_LONG = 30
SUGGEST_DEFAULT = 8
SUGGEST_MAX = 20
BULK_CATEGORY = "Medicine"
BULK_PRICE_ASOF = "Nov 2022"
CURATED_PRICE_ASOF = "Jul 2026"

# --- interaction warnings ----------------------------------------------------
DUPLICATE_IGNORED = ["multivitamin", "b-complex"]
DUPLICATE_SEVERITY = "moderate"
DUPLICATE_EFFECT = (
    "Both contain {salt} — taking them together risks an accidental overdose "
    "of that ingredient."
)
DUPLICATE_ADVICE = (
    "Do not take both unless the doctor has confirmed the total dose is intended."
)

# --- stores ------------------------------------------------------------------
EARTH_RADIUS_KM = 6371.0
LAT_RANGE = (6.0, 38.0)
LNG_RANGE = (68.0, 98.0)
NEAREST_MAX = 25
MAP_URL = "https://www.google.com/maps/search/?api=1&query="

# --- dosing by weight --------------------------------------------------------
MIN_WEIGHT_KG = 2.5
MAX_WEIGHT_KG = 60.0
ML_STEP_SMALL = 0.25
ML_STEP_LARGE = 0.5
ML_STEP_LIMIT = 5.0
WEIGHT_ERROR = (
    "Weight must be between 2.5 and 60.0 kg. "
    "For newborns or larger children/adults, ask a doctor directly."
)
RULE_ERROR = "No paediatric dosing data for '{name}'."
AGE_CAUTION = "Not for children below {age} without a doctor's advice."
CAP_CAUTION = "Dose capped at the child maximum of {cap} mg per dose."

# --- reports -----------------------------------------------------------------
HISTORY_LIMIT = 100
MOST_CORRECTED_LIMIT = 10
QUOTA_LIMIT = 6
QUOTA_WINDOW_SECONDS = 3600
NO_RUNS_DETAIL = "No runs recorded."
