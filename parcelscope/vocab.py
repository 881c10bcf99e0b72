"""Word lists, patterns, weights, thresholds and texts.

Everything in this module is a fixed value that results depend on. Operators take
them as defaults, so another market can pass its own.
"""

# --- fixed values: page classification -------------------------------------------
BLOCK_MARKERS = (
    "are you human",
    "verify you are a human",
    "access denied",
    "reference&#32;&#35;",
    "pardon our interruption",
    "sec-if-cpt-container",
    "powered and protected by akamai",
    "powered and protected by privacy",
)
CHALLENGE_MARKERS = ("sec-if-cpt-container", "powered and protected by akamai")
DENIED_MARKER = "access denied"
STRUCTURED_MARKERS = ("__next_data__", "digitaldata")
EMPTY_PAGE_CHARS = 200
SHORT_PAGE_CHARS = 20000

# --- fixed values: localities ----------------------------------------------------
STATE_CODES = ("nsw", "vic", "qld", "sa", "wa", "tas", "act", "nt")
SEARCH_PATHS = ("sale", "rent", "sold", "sold-listings")
DEFAULT_LOCALITY = ("Sydney", "NSW")
NEARBY = {
    "zetland": ("waterloo", "rosebery", "alexandria", "kensington"),
    "waterloo": ("zetland", "rosebery", "alexandria", "surry hills"),
    "rosebery": ("zetland", "waterloo", "alexandria", "kensington"),
    "randwick": ("kensington", "coogee", "clovelly", "waverley"),
    "bondi junction": ("waverley", "queens park", "bondi", "woollahra"),
    "crows nest": ("st leonards", "wollstonecraft", "north sydney", "cammeray"),
    "north sydney": ("crows nest", "st leonards", "wollstonecraft", "milsons point"),
    "marrickville": ("dulwich hill", "st peters", "newtown", "tempe"),
}
HIGH_DENSITY_AREAS = (
    "zetland", "waterloo", "mascot", "wolli creek", "rhodes", "sydney olympic park",
    "homebush", "epping", "macquarie park", "parramatta", "north ryde", "meadowbank",
    "arncliffe", "rosebery", "green square",
)

# --- fixed values: off-market tags -----------------------------------------------
SOLD_CLASS = "is-sold"
LEASED_CLASS = "is-leased"
OFFER_CLASSES = ("is-under-offer", "is-undercontract")
OFFER_PREFIXES = ("under offer", "under contract")
SALE_METHODS = (
    ("private treaty", "private treaty"),
    ("prior to auction", "prior to auction"),
    ("at auction", "auction"),
)

# --- fixed values: comparables ---------------------------------------------------
SOLD_POOL, RENT_POOL, COMP_LIMIT, MAX_WEEKLY_RENT = 80, 100, 12, 5000

# --- fixed values: price reads ---------------------------------------------------
FAIRNESS = ("cheap or underquoted", "good value", "fair", "stretched", "overpriced", "unknown")
POSTURE = {
    "cheap or underquoted": "Treat the guide sceptically; verify with the agent and expect competition.",
    "good value": "Inspect quickly and be ready to move if due diligence clears.",
    "fair": "Proceed, but anchor any offer to the strongest comparable sales.",
    "stretched": "Only chase if the property is materially superior to the comps.",
    "overpriced": "Pass or wait for a price correction unless there is a unique reason.",
    "unknown": "Pull more comparable evidence before making a price call.",
}
RENT_POSTURE = {
    "cheap or underquoted": "Apply fast, but confirm the rent is not missing fees or a short lease catch.",
    "good value": "Inspect and have the application ready; this is attractive rent for the evidence.",
    "fair": "Proceed if the inspection clears liveability and application terms.",
    "stretched": "Only apply if the property is materially better than the rental comps.",
    "overpriced": "Pass unless there is a lifestyle reason that outweighs the rent premium.",
    "unknown": "Pull more rental evidence before treating the rent as fair.",
}
ASK_POSTURE = {
    "below": "Guide sits under our independent estimate — expect competition and a clearing "
             "price near or above the range. Treat the quote as a floor, not the budget.",
    "within": "Guide is consistent with the evidence. Anchor offers to the strongest comparables.",
    "above": "Guide exceeds the evidence. Only chase if the property is materially superior to comps.",
}
# (above, up to, base, rate)
TAX_BANDS = (
    (0, 16000, 0, 0.0125),
    (16000, 35000, 200, 0.015),
    (35000, 93000, 485, 0.0175),
    (93000, 351000, 1500, 0.035),
    (351000, 1168000, 10530, 0.045),
    (1168000, None, 47295, 0.055),
)
SCORE_BANDS = ((8.5, "Exceptional fit"), (7.0, "Strong fit"), (5.5, "Worth a look"), (4.0, "Marginal"))
LOWEST_BAND = "Off-brief"

# --- fixed values: value signals -------------------------------------------------
CONFIDENCE_WEIGHT = {"high": 1.0, "medium": 0.65, "low": 0.35, "none": 0.0}
METHOD_WEIGHT = {
    "comparable_median": 1.0,
    "per_sqm": 0.85,
    "avm": 1.1,
    "hedonic": 0.7,
    "per_bed": 0.55,
    "yield_implied": 0.4,
}
OTHER_METHOD_WEIGHT = 0.5
DEFAULT_YIELD_BAND = (0.035, 0.045)
AREA_KEYS = ("building_area", "building_area_sqm", "internal_area", "internalArea")
AREA_VALUE_KEYS = ("value", "size", "sqm", "area")
HEDONIC_CAP = 0.12
HEDONIC_FLOOR = 0.005
HEDONIC = (
    (r"north[- ]?east|north[- ]?facing|due north", 0.02, "north aspect"),
    (r"\bwater\b|harbour|ocean|district view|city view|skyline|panoramic", 0.03, "view"),
    (r"penthouse|top floor|high floor|upper level", 0.02, "elevated floor"),
    (r"renovated|brand new|architect|designer|fully rebuilt|as new", 0.03, "renovated/near-new"),
    (r"\blift\b|elevator", 0.01, "lift"),
    (r"courtyard|garden|terrace|large balcony|entertain", 0.01, "outdoor space"),
    (r"study|home office|extra room", 0.01, "study/extra room"),
    (r"double lock[- ]?up|2 car|two car|double garage|tandem", 0.02, "extra parking"),
    (r"ground floor|street level", -0.01, "ground floor"),
    (r"main road|busy road|busy street|highway|traffic", -0.02, "busy-road exposure"),
    (r"needs work|renovator|original condition|potential to|deceased estate|handyman", -0.03, "needs work"),
    (r"no parking|street parking only|unparked", -0.02, "no parking"),
    (r"walk[- ]?up|no lift", -0.01, "walk-up"),
)

# --- fixed values: preference and deal-breaker patterns, weights -------------------
# name, pattern, owner-occupier weight, investor weight
PREFERENCES = (
    ("secure_parking", r"\b(secure (car|park)|lock[- ]?up garage|basement park|car space|undercover park|garage)\b", 1.4, 1.3),
    ("natural_light", r"\b(north[- ]?facing|north aspect|sun[- ]?drench|light[- ]?filled|abundant (natural )?light|bright|sun[- ]?filled)\b", 1.3, 0.7),
    ("outdoor_space", r"\b(balcony|courtyard|terrace|garden|alfresco|entertain\w* (balcony|terrace|deck)|private outdoor)\b", 1.2, 0.7),
    ("building_amenity", r"\b(pool|gym|fitness|sauna|spa|concierge|rooftop|residents['’]? lounge)\b", 0.8, 1.0),
    ("transport", r"\b(station|metro|light rail|train|tram|bus|walk to transport|close to transport)\b", 1.1, 1.5),
    ("cafes_lifestyle", r"\b(caf[eé]|dining|restaurant|village|shopping|vibrant|lifestyle)\b", 0.9, 1.1),
    ("modern_finishes", r"\b(stone (kitchen|bench)|quality (appliances|finish)|renovat|brand new|near new|designer|contemporary|gas cook)\b", 1.0, 1.2),
    ("period_charm", r"\b(period|art deco|federation|character|original feature|heritage|victorian|edwardian)\b", 0.8, 0.4),
    ("low_maintenance", r"\b(low[- ]?maintenance|lock up and leave|easy[- ]?care|effortless)\b", 1.1, 1.2),
    ("storage", r"\b(storage cage|built[- ]?in (robe|wardrobe)|ample storage|internal laundry)\b", 0.7, 0.6),
)
BREAKERS = {
    "overlay": r"\b(flood (zone|overlay|prone)|bushfire (zone|overlay|prone)|fire overlay)\b",
    "main_road": r"\b(main road|busy road|arterial|highway frontage|traffic noise)\b",
    "ground_floor": r"\b(ground floor|street level)\b",
}

# --- fixed values: risk patterns and weights --------------------------------------
SEVERITY_WEIGHT = {"dealbreaker": 1.0, "major": 0.65, "minor": 0.3, "watch": 0.15}
RISK_PATTERNS = {
    "overlay": r"\b(flood|bushfire|fire|contamination|heritage)\s+(zone|overlay|prone|affected)\b",
    "road": r"\b(main road|busy road|arterial|highway frontage|traffic noise)\b",
    "ground": r"\b(ground floor|street level)\b",
    "light": r"\b(dark|internal outlook|limited natural light|no outlook|south[- ]?facing)\b",
    "no_lift": r"\b(no lift|without (a )?lift|walk[- ]?up|stair access only|no elevator)\b",
    "compact": r"\b(studio|compact|cosy|cozy|bedsit|low[- ]?maintenance footprint)\b",
    "sized": r"\b\d{2,3}\s?(sq ?m|sqm|m2|square met)",
    "condition": r"\b(needs work|renovat(or'?s|e)|original condition|tlc|blank canvas|structural|water damage|defect)\b",
    "title": r"\b(easement|right of way|right-of-way|shared driveway|battle[- ]?axe|landlocked|no street frontage|access handle)\b",
    "climate": r"\b(air ?conditioning|air-conditioning|aircon|a/c|heating|heater|reverse cycle)\b",
    "pets": r"\b(no pets|pets not permitted|not pet friendly)\b",
    "laundry": r"\b(shared laundry|communal laundry)\b",
    "lease": r"\b(short lease|6 month lease|temporary)\b",
    "no_parking": r"\b(no parking|street parking only|permit parking|unallocated parking|no storage|no cage)\b",
    "available": r"\b(available|vacant|move[- ]?in|lease start)\b",
}
NO_RISK_SUMMARY = "No obvious red flags from available data"

# --- fixed values: diligence order and words ---------------------------------------
DILIGENCE_ORDER = ("critical", "major", "watch", "minor")
CLIMATE_WORDS = ("air conditioning", "air-conditioning", "aircon", "a/c", "heating", "heater")

# --- fixed values: lifecycle texts -----------------------------------------------
WHY_NOW_DEFAULT = "New to this hunt or still active; no material change recorded yet."
STALE_TEXT = (
    "Listing disappeared from the latest provider result; check if withdrawn, "
    "sold/leased, or missed by the provider."
)
RELIST_TEXT = (
    "Listing reappeared after dropping off the market — a relist (often a repricing "
    "or campaign reset; treat the new guide sceptically)."
)

# --- fixed values: source facts ----------------------------------------------------
FRESHNESS_DAYS = 45
FACT_NOT_FOUND = "Fetch succeeded but the expected value was not found."
NO_SOURCES = "No dated market sources supplied; treat Section 02 as unverified commentary."
