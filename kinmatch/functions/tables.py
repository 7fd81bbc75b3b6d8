"""Fixed values of the linkage rules: word lists that results depend on."""

# --- fixed values: legal suffixes of company names ---
LEGAL_SUFFIXES = [
    "inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "pvt", "private", "llc", "llp", "pllc",
    "enterprises", "enterprise", "industries", "industry", "technologies", "technology", "services", "service", "solutions",
    "solution", "group", "holdings", "ventures", "consulting", "associates", "trading", "sarl", "sas", "sci", "sa", "snc", "eurl",
    "ste", "gmbh", "bv",
]

# --- fixed values: address abbreviations; they go before the states ---
ADDRESS_WORDS = {
    "rd": "road", "st": "street", "ave": "avenue", "blvd": "boulevard", "dr": "drive", "ct": "court", "ln": "lane", "pl": "place",
    "sq": "square", "terr": "terrace", "pkwy": "parkway", "hwy": "highway", "fl": "floor", "ste": "suite", "apt": "apartment",
    "bldg": "building", "no": "number", "nr": "near", "opp": "opposite",
}

# --- fixed values: states of the US ---
US_STATES = {
    "al": "alabama", "ak": "alaska", "az": "arizona", "ca": "california", "co": "colorado", "ct": "connecticut", "de": "delaware",
    "fl": "florida", "hi": "hawaii", "id": "idaho", "il": "illinois", "in": "indiana", "ia": "iowa", "ks": "kansas", "ky": "kentucky",
    "la": "louisiana", "me": "maine", "md": "maryland", "ma": "massachusetts", "mi": "michigan", "ms": "mississippi", "mo": "missouri",
    "mt": "montana", "ne": "nebraska", "nv": "nevada", "nh": "new hampshire", "nj": "new jersey", "nm": "new mexico", "ny": "new york",
    "nc": "north carolina", "nd": "north dakota", "oh": "ohio", "ok": "oklahoma", "or": "oregon", "pa": "pennsylvania",
    "ri": "rhode island", "sc": "south carolina", "sd": "south dakota", "tx": "texas", "ut": "utah", "vt": "vermont", "va": "virginia",
    "wa": "washington", "wv": "west virginia", "wi": "wisconsin", "wy": "wyoming", "dc": "district of columbia",
}

# --- fixed values: states of India; where a code is both, India's goes ---
INDIAN_STATES = {
    "ap": "andhra pradesh", "ar": "arunachal pradesh", "as": "assam", "br": "bihar", "cg": "chhattisgarh", "dl": "delhi", "ga": "goa",
    "gj": "gujarat", "hr": "haryana", "hp": "himachal pradesh", "jh": "jharkhand", "ka": "karnataka", "kl": "kerala",
    "mp": "madhya pradesh", "mh": "maharashtra", "mn": "manipur", "ml": "meghalaya", "mz": "mizoram", "nl": "nagaland", "od": "odisha",
    "pb": "punjab", "rj": "rajasthan", "sk": "sikkim", "tn": "tamil nadu", "tg": "telangana", "ts": "telangana", "tr": "tripura",
    "up": "uttar pradesh", "uk": "uttarakhand", "wb": "west bengal",
}

# --- fixed values: address words too common for a key ---
COMMON_ADDRESS_WORDS = [
    "street", "road", "avenue", "boulevard", "drive", "court", "lane", "place", "circle", "way", "trail", "parkway", "highway",
    "suite", "floor", "apartment", "building", "room", "number", "near", "opposite", "behind", "block", "sector", "phase", "plot",
    "flat", "door", "fl", "no", "unit", "north", "south", "east", "west", "india", "us", "usa", "france", "state", "district",
    "city", "nagar", "colony", "bazaar", "marg", "gali", "null", "rd", "st", "ave", "blvd", "dr", "ct", "ln", "hwy", "apt", "ste",
    "first", "second", "third", "ground",
]

# --- fixed values: postings a key may have, by the kind of key ---
COMMON_KEY_LIMIT, RARE_KEY_LIMIT = 300, 150
RARE_KEYS = ("sort_n", "addr_pair")


def expansions() -> dict[str, str]:
    """Address token to its expansion, each token once."""
    return US_STATES | INDIAN_STATES | ADDRESS_WORDS
