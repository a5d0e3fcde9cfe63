"""Word lists, maps and patterns that define the normalisers.

They are data, given plainly and in the order that the rules apply them in.
"""

# Contracting normaliser, phrases of a name, then words of a name, then words of an address.
NAME_PHRASES = {
    "private limited": "pvt ltd", "pvt limited": "pvt ltd", "pvt. limited": "pvt ltd", "pvt. ltd.": "pvt ltd", "pvt ltd": "pvt ltd",
    "corporation": "corp", "incorporated": "inc", "limited liability company": "llc", "limited": "ltd", "l.l.c.": "llc", "l.l.c": "llc",
    "co.": "co", "company": "co", "societe anonyme": "sa", "societe a responsabilite limitee": "sarl", "societe par actions simplifiee": "sas",
    "societe en nom collectif": "snc", "groupement d interet economique": "gie", "gesellschaft mit beschrankter haftung": "gmbh",
    "aktiengesellschaft": "ag", "private": "pvt",
}
ADDRESS_PHRASES = {
    "street": "st", "st.": "st", "road": "rd", "rd.": "rd", "avenue": "ave", "ave.": "ave", "boulevard": "blvd", "bvd": "blvd", "bd": "blvd",
    "drive": "dr", "dr.": "dr", "lane": "ln", "ln.": "ln", "court": "ct", "ct.": "ct", "place": "pl", "pl.": "pl", "square": "sq", "sq.": "sq",
    "highway": "hwy", "hwy.": "hwy", "apartment": "apt", "apt.": "apt", "suite": "ste", "ste.": "ste", "building": "bldg", "bldg.": "bldg",
    "floor": "fl", "fl.": "fl", "north": "n", "south": "s", "east": "e", "west": "w", "northeast": "ne", "northwest": "nw", "southeast": "se",
    "southwest": "sw", "rue": "rue", "r.": "rue", "allee": "all", "impasse": "imp", "chemin": "che", "route": "rte", "nagar": "ngr", "marg": "mg",
    "colony": "col", "sector": "sec",
}
NAME_ARTICLES = ["the", "a", "an", "of", "and", "in", "at", "for", "de", "la", "le", "les", "des", "du", "et", "en"]
CORPORATE_WORDS = ["pvt", "ltd", "llc", "corp", "inc", "co", "sa", "sas", "sarl", "gmbh", "ag", "llp", "plc", "bv", "nv"]

# Noise-stripping normaliser.
LEGAL_WORDS = r"(?i)(?U)\b(private limited|pvt\.?\s*ltd\.?|limited|ltd\.?|corporation|corp\.?|incorporated|inc\.?|llc|l\.l\.c\.?|sarl|sasu?|sa|eurl|gie|snc|sci|llp|plc|d\.?b\.?a\.?|dba)\b"
NOISE_PREFIX = r"(?i)^(>>|<<|\[[^\]]+\]|\([^\)]+\)|#|smt|dr\.?)\s*"
LEGAL_STOPWORDS = [
    "inc", "llc", "ltd", "corp", "corporation", "limited", "pvt", "co", "the", "and", "services", "solutions", "center", "group", "sarl", "sas",
    "sa", "sasu", "eurl", "gie", "private", "company", "enterprises", "associates", "de", "la", "le", "et", "en", "technologies", "holdings",
    "industries", "international", "global", "les", "des", "du", "au", "aux", "d", "l", "un", "une",
]

# Legal suffixes at the end of a name; the shorter list leaves out the last one.
LEGAL_SUFFIXES = [
    "private limited", "pvt limited", "p limited", "private ltd", "pvt ltd", "corporation", "incorporated", "limited", "enterprises", "enterprise",
    "services", "solutions", "technologies", "holdings", "industries", "international", "consultants", "consultancy", "consulting", "center",
    "centre", "corp", "inc", "llc", "llp", "sarl", "sasu", "eurl", "gmbh", "gie", "sas", "sa", "ag", "bv", "nv", "spa", "srl", "ltd",
]
SHORT_STOPWORDS = [
    "the", "and", "co", "of", "in", "for", "at", "by", "to", "a", "an", "de", "la", "le", "les", "des", "du", "et", "en", "au", "aux", "d", "l",
    "un", "une", "sur", "dans", "null", "mr", "mrs", "dr", "prof",
]

# Expansions of address words, one map for each family of presets.
EXPAND_WIDE = {
    "st": "street", "rd": "road", "dr": "drive", "ln": "lane", "ave": "avenue", "ct": "court", "blvd": "boulevard", "hwy": "highway",
    "pkwy": "parkway", "apt": "apartment", "ste": "suite", "unit": "unit", "bldg": "building", "fl": "floor", "flr": "floor", "pl": "place",
    "cir": "circle", "opp": "opposite", "nr": "near", "soc": "society", "col": "colony", "ext": "extension", "sec": "sector", "dist": "district",
    "vill": "village", "po": "postoffice", "ps": "policestation", "mkt": "market", "cmplx": "complex", "twr": "tower",
}
EXPAND_LATE = {
    "st": "street", "rd": "road", "ave": "avenue", "dr": "drive", "ln": "lane", "blvd": "boulevard", "bvd": "boulevard", "bd": "boulevard",
    "ct": "court", "pl": "place", "sq": "square", "pkwy": "parkway", "hwy": "highway", "fl": "floor", "ste": "suite", "apt": "apartment",
    "dept": "department", "bldg": "building", "opp": "opposite", "nr": "near", "adj": "adjacent", "ind": "industrial", "sec": "sector",
    "dist": "district", "vill": "village", "po": "post office", "rue": "rue", "allee": "all", "impasse": "imp", "chemin": "che", "route": "rte",
}
EXPAND_PRODUCTION = {
    "st": "street", "rd": "road", "ave": "avenue", "blvd": "boulevard", "dr": "drive", "ln": "lane", "ct": "court", "pl": "place",
    "ter": "terrace", "pkwy": "parkway", "hwy": "highway", "sq": "square", "bldg": "building", "fl": "floor", "apt": "apartment", "ste": "suite",
    "rm": "room", "ngr": "nagar", "col": "colony", "sec": "sector", "dist": "district", "tq": "taluk", "opp": "opposite", "nr": "near",
    "bvd": "boulevard", "bd": "boulevard", "av": "avenue", "all": "allee", "imp": "impasse", "che": "chemin", "rte": "route", "crs": "cours",
}

# States, in the order that the search tries them.
US_STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct",
    "delaware": "de", "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id", "illinois": "il", "indiana": "in", "iowa": "ia",
    "kansas": "ks", "kentucky": "ky", "louisiana": "la", "maine": "me", "maryland": "md", "massachusetts": "ma", "michigan": "mi",
    "minnesota": "mn", "mississippi": "ms", "missouri": "mo", "montana": "mt", "nebraska": "ne", "nevada": "nv", "new hampshire": "nh",
    "new jersey": "nj", "new mexico": "nm", "new york": "ny", "north carolina": "nc", "north dakota": "nd", "ohio": "oh", "oklahoma": "ok",
    "oregon": "or", "pennsylvania": "pa", "rhode island": "ri", "south carolina": "sc", "south dakota": "sd", "tennessee": "tn", "texas": "tx",
    "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa", "west virginia": "wv", "wisconsin": "wi", "wyoming": "wy",
}
INDIA_STATES = {
    "tamil nadu": "tn", "tamilnadu": "tn", "karnataka": "ka", "maharashtra": "mh", "uttar pradesh": "up", "rajasthan": "rj",
    "madhya pradesh": "mp", "delhi": "dl", "new delhi": "dl", "west bengal": "wb", "gujarat": "gj", "andhra pradesh": "ap", "telangana": "ts",
    "kerala": "kl", "haryana": "hr", "bihar": "br", "odisha": "od", "punjab": "pb", "assam": "as", "jharkhand": "jh", "chhattisgarh": "cg",
    "uttarakhand": "uk", "goa": "ga", "himachal pradesh": "hp", "jammu and kashmir": "jk", "chandigarh": "ch",
}
UNSURE_US = ["st", "rd", "dr", "ln", "ct", "pl", "fl", "in", "me", "oh", "ok", "or", "pa", "wa"]
UNSURE_INDIA = ["st", "rd", "dr", "ln", "ct", "pl", "fl", "in", "or"]
PREPOSITIONS_US = ["in", "to", "or", "at", "as", "by", "on", "no"]
PREPOSITIONS_INDIA = ["in", "to", "or", "at", "as"]
GENERIC_ADDRESS = [
    "street", "road", "avenue", "boulevard", "drive", "lane", "court", "place", "terrace", "parkway", "highway", "square", "building", "floor",
    "apt", "apartment", "suite", "room", "nagar", "colony", "sector", "district", "taluk", "opp", "opposite", "near", "rd", "st", "ave", "blvd",
    "dr", "ln", "ct", "pl", "ter", "pkwy", "hwy", "sq", "bldg", "fl", "ste", "rm", "ngr", "col", "sec", "dist", "tq", "plot", "hn", "house", "no",
    "number", "unit", "block", "null", "east", "west", "north", "south", "box", "po", "pob", "rue", "allee", "chemin", "impasse", "france",
    "india", "us", "usa", "city", "town", "state", "village", "route", "cours", "quai", "passage",
]

# Top-level domains of a stem.
DOMAINS = "com|in|org|net|fr|co|io|biz|info"
DOMAINS_LATE = "com|in|org|net|fr|co|io|biz|info|us"
