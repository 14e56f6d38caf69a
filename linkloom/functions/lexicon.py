"""Word tables of company names and postal addresses."""

from __future__ import annotations

# Spellings of legal forms and their short forms.
LEGAL_FORMS = {
    "incorporated": "inc", "inc": "inc", "incorporation": "inc", "corporation": "corp", "corp": "corp", "corporations": "corp", "company": "co",
    "co": "co", "companies": "co", "limited": "ltd", "ltd": "ltd", "ltda": "ltd", "private": "pvt", "pvt": "pvt", "pte": "pvt", "proprietary": "pty",
    "pty": "pty", "llc": "llc", "lllp": "lllp", "llp": "llp", "lp": "lp", "plc": "plc", "solutions": "solutions", "gmbh": "gmbh", "sarl": "sarl",
    "sa": "sa", "sas": "sas", "ag": "ag", "bv": "bv", "nv": "nv", "spa": "spa", "sl": "sl", "eurl": "eurl",
}

# Words of a name that say nothing.
NAME_NOISE = (
    "the", "a", "an", "of", "and", "or", "at", "in", "on", "for", "to", "m", "ms", "mr", "mrs", "miss", "dr", "sri", "shree", "shri", "smt", "messrs",
    "aka", "dba", "fka", "trading", "as", "t",
)

# Spellings of street types and their short forms.
STREET_TYPES = {
    "street": "st", "st": "st", "str": "st", "saint": "st", "road": "rd", "rd": "rd", "route": "rte", "rte": "rte", "drive": "dr", "dr": "dr",
    "doctor": "dr", "lane": "ln", "ln": "ln", "avenue": "ave", "ave": "ave", "av": "ave", "avenida": "ave", "boulevard": "blvd", "blvd": "blvd",
    "boul": "blvd", "blv": "blvd", "court": "ct", "ct": "ct", "circle": "cir", "cir": "cir", "place": "pl", "pl": "pl", "plaza": "plz", "plz": "plz",
    "highway": "hwy", "hwy": "hwy", "parkway": "pkwy", "pkwy": "pkwy", "square": "sq", "sq": "sq", "terrace": "ter", "ter": "ter", "trail": "trl",
    "trl": "trl", "tr": "trl", "way": "way", "walk": "walk", "row": "row", "cross": "cross", "main": "main", "marg": "marg", "nagar": "nagar",
    "colony": "colony", "sector": "sector", "block": "blk", "blk": "blk", "plot": "plot", "survey": "surv", "surv": "surv", "chemin": "chemin",
    "impasse": "impasse", "allee": "allee", "quai": "quai", "passage": "passage", "voie": "voie",
}

# Address words that say little.
ADDRESS_NOISE = (
    "po", "pob", "box", "pmb", "pobox", "cmb", "unit", "apt", "apartment", "suite", "ste", "floor", "flr", "fl", "building", "bldg", "shop", "flat",
    "room", "rm", "no", "num", "number", "hn", "house", "hno", "dno", "door", "near", "opp", "opposite", "behind", "beside", "adjacent", "off",
    "above", "below", "next", "landmark", "dist", "district", "post", "taluka", "tehsil", "village", "vill", "pin", "pincode", "zip", "zipcode",
    "gpo",
)

# States and regions and their codes, in the order that decides which name a shared word belongs to.
STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct", "delaware": "de",
    "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id", "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks",
    "kentucky": "ky", "louisiana": "la", "maine": "me", "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn",
    "mississippi": "ms", "missouri": "mo", "montana": "mt", "nebraska": "ne", "nevada": "nv", "new hampshire": "nh", "new jersey": "nj",
    "new mexico": "nm", "new york": "ny", "north carolina": "nc", "north dakota": "nd", "ohio": "oh", "oklahoma": "ok", "oregon": "or",
    "pennsylvania": "pa", "rhode island": "ri", "south carolina": "sc", "south dakota": "sd", "tennessee": "tn", "texas": "tx", "utah": "ut",
    "vermont": "vt", "virginia": "va", "washington": "wa", "west virginia": "wv", "wisconsin": "wi", "wyoming": "wy", "district of columbia": "dc",
    "puerto rico": "pr", "virgin islands": "vi", "guam": "gu", "andhra pradesh": "ap", "arunachal pradesh": "ar", "assam": "as", "bihar": "br",
    "chhattisgarh": "cg", "goa": "ga", "gujarat": "gj", "haryana": "hr", "himachal pradesh": "hp", "jharkhand": "jh", "karnataka": "ka",
    "kerala": "kl", "madhya pradesh": "mp", "maharashtra": "mh", "manipur": "mn", "meghalaya": "ml", "mizoram": "mz", "nagaland": "nl",
    "odisha": "od", "orissa": "od", "punjab": "pb", "rajasthan": "rj", "sikkim": "sk", "tamil nadu": "tn", "telangana": "tg", "tripura": "tr",
    "uttar pradesh": "up", "uttarakhand": "uk", "west bengal": "wb", "delhi": "dl", "new delhi": "dl", "jammu and kashmir": "jk", "ladakh": "la",
    "puducherry": "py", "pondicherry": "py", "chandigarh": "ch", "ile de france": "idf", "nouvelle aquitaine": "naq", "auvergne rhone alpes": "ara",
    "occitanie": "occ", "provence alpes cote d azur": "paca", "bretagne": "bre", "normandie": "nor", "pays de la loire": "pdl", "grand est": "ges",
    "hauts de france": "hdf", "bourgogne franche comte": "bfc", "centre val de loire": "cvl", "corse": "cor",
}

# Phrases of several words that become one token.
PHRASES = {
    "new york": "ny", "new jersey": "nj", "new mexico": "nm", "new hampshire": "nh", "new delhi": "dl", "north carolina": "nc",
    "south carolina": "sc", "north dakota": "nd", "south dakota": "sd", "west bengal": "wb", "west virginia": "wv", "rhode island": "ri",
    "po box": "pobox", "p o box": "pobox", "post office box": "pobox", "tamil nadu": "tn", "andhra pradesh": "ap", "madhya pradesh": "mp",
    "uttar pradesh": "up", "himachal pradesh": "hp", "arunachal pradesh": "ar", "jammu and kashmir": "jk", "andaman and nicobar islands": "an",
    "dadra and nagar haveli": "dn", "daman and diu": "dd", "ile de france": "idf", "nouvelle aquitaine": "naq", "auvergne rhone alpes": "ara",
    "provence alpes cote d azur": "paca", "pays de la loire": "pdl", "grand est": "ges", "hauts de france": "hdf", "bourgogne franche comte": "bfc",
    "centre val de loire": "cvl", "district of columbia": "dc",
}


def ordered_phrases() -> list[tuple[str, str]]:
    """The phrases, longest first, then by name, so that overlaps always resolve alike."""
    return sorted(PHRASES.items(), key=lambda x: (-len(x[0].split()), -len(x[0]), x[0]))


def state_tokens(split_words: bool = False) -> dict[str, str]:
    """Names and codes of states; ``split_words`` also maps each word of a longer name (the first name wins)."""
    found: dict[str, str] = {}
    for name, code in STATES.items():
        found[name] = code
        if split_words:
            for word in name.split():
                found.setdefault(word, code)
    return found | {code: code for code in STATES.values() if code not in found}


def generic_tokens() -> tuple[str, ...]:
    """All words that carry little signal in a name or an address."""
    return tuple(sorted({*LEGAL_FORMS, *STREET_TYPES, *ADDRESS_NOISE, *NAME_NOISE}))
