"""Word lists that the normalisation is defined by."""

# Legal and organisational suffixes.
LEGAL = (
    "inc", "incorporated", "llc", "lc", "llp", "lp", "ltd", "limited", "co",
    "company", "corp", "corporation", "plc", "pllc", "pc", "pa", "trust",
    "holdings", "holding", "group", "enterprises", "enterprise", "ventures",
    "intl", "international",
    "pvt", "private", "pvtltd", "opc", "ltdco",
    "sarl", "sa", "sas", "sasu", "eurl", "sci", "snc", "scp", "scop", "sarlu",
    "ei", "eirl", "gie", "scm", "selarl", "sca", "scs",
    "gmbh", "ag", "bv", "nv", "srl", "spa", "oy", "ab", "as",
)

# Abbreviations in names and the form each stands for.
NAME_FORMS = {
    "n": "and",
    "intl": "international", "int": "international", "natl": "national",
    "assoc": "associates", "assocs": "associates", "asso": "associates",
    "assn": "association", "bros": "brothers", "bro": "brothers",
    "mfg": "manufacturing", "mfrs": "manufacturers", "mfr": "manufacturers",
    "svc": "services", "svcs": "services", "serv": "services", "srvcs": "services",
    "sol": "solutions", "soln": "solutions", "solns": "solutions",
    "tech": "technologies", "techs": "technologies", "technology": "technologies",
    "ind": "industries", "inds": "industries", "industry": "industries",
    "engg": "engineering", "eng": "engineering", "engrs": "engineers",
    "constn": "construction", "cons": "construction",
    "dev": "development", "devs": "development",
    "mgmt": "management", "mgt": "management",
    "distr": "distributors", "dist": "distributors", "distrib": "distributors",
    "ent": "enterprises", "entp": "enterprises",
    "st": "saint", "ste": "sainte", "mt": "mount", "dr": "doctor",
    "univ": "university", "hosp": "hospital", "rest": "restaurant",
    "pharm": "pharmacy", "med": "medical", "lab": "laboratories",
    "labs": "laboratories", "laboratory": "laboratories",
    "auto": "automotive", "elec": "electric", "electricals": "electrical",
    "trdg": "trading", "exp": "exports", "imp": "imports",
    "agcy": "agency", "agencies": "agency",
    "prod": "products", "prods": "products", "product": "products",
    "sys": "systems", "system": "systems",
    "grp": "group", "ctr": "center", "centre": "center",
    "coop": "cooperative",
}

# Abbreviations in addresses and the form each stands for.
ADDRESS_FORMS = {
    "st": "street", "str": "street", "rd": "road", "ave": "avenue", "av": "avenue",
    "blvd": "boulevard", "blv": "boulevard", "dr": "drive", "ln": "lane",
    "ct": "court", "cir": "circle", "pl": "place", "plz": "plaza", "sq": "square",
    "hwy": "highway", "pkwy": "parkway", "pky": "parkway", "trl": "trail",
    "ter": "terrace", "tpke": "turnpike", "expy": "expressway", "frwy": "freeway",
    "ste": "suite", "apt": "apartment", "bldg": "building", "blk": "block",
    "fl": "floor", "flr": "floor", "rm": "room", "dept": "department",
    "n": "north", "s": "south", "e": "east", "w": "west",
    "ne": "northeast", "nw": "northwest", "se": "southeast", "sw": "southwest",
    "no": "number", "num": "number", "nos": "number", "opp": "opposite",
    "mkt": "market", "galli": "gali",
    "rly": "railway", "stn": "station", "jn": "junction", "ph": "phase",
    "sec": "sector", "ngr": "nagar", "col": "colony", "vill": "village",
    "po": "postoffice", "ps": "policestation", "dist": "district", "distt": "district",
    "teh": "tehsil", "tq": "taluk", "taluka": "taluk", "vpo": "village",
    "bh": "behind", "nr": "near", "flt": "flat", "gr": "ground", "grnd": "ground",
    "r": "rue", "bd": "boulevard",
    "imp": "impasse", "all": "allee", "che": "chemin", "rte": "route",
    "res": "residence", "bat": "batiment", "app": "appartement",
    "zi": "zoneindustrielle", "za": "zoneartisanale",
    "bp": "boitepostale",
}
