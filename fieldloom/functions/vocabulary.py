"""Word lists, tables, weights and patterns that results depend on.

Patterns are in Java syntax. Everything here is data that must hold as it is for
results to be right; the functions that use it are elsewhere.
"""

# Names of life stages and size classes that are no taxa.
LIFE_STAGES = (
    "medusa", "medusae", "ephyra", "ephyrae", "strobila", "strobilae", "scyphistoma", "scyphistomae", "polyp", "polyps",
    "veliger", "veligers", "trochophore", "trochophores", "larva", "larvae", "larval", "juvenile", "juveniles", "adult", "adults",
    "egg", "eggs", "egg mass", "egg masses", "embryo", "embryos", "spat", "post-larva", "post-larvae", "post-larval", "recruit", "recruits",
    "metamorphose", "metamorphosis", "nauplius", "nauplii", "zoea", "zoeas", "megalopa", "pluteus", "bipinnaria", "auricularia", "doliolaria",
    "immature", "mature", "subadult", "hatchling", "hatchlings", "nymph", "nymphs", "pup", "pups", "fry", "small", "large", "tiny", "minute",
)

# Order of occurrence types, best first; any other type comes last.
TYPE_ORDER = ("primary", "secondary", "uncertain")

# Localities that name a study region, not a place.
REGIONAL_PLACES = (
    "gulf of kutch", "gulf of mannar", "palk bay", "lakshadweep", "andaman islands", "andaman sea", "arabian sea", "bay of bengal",
    "indian ocean", "india", "gujarat", "tamil nadu", "kerala", "karnataka coast", "west coast of india", "east coast of india",
    "not reported", "unknown", "study area", "collection site",
)

# Name patterns.
AUTHORITY = r"[\(\[]?[A-Z][A-Za-zÀ-ÿ\-']+(?:\s+(?:and|&|et)\s+[A-Z][A-Za-zÀ-ÿ\-']+)?[,.]?\s*\d{4}[\)\]]?"
OPEN_NOMENCLATURE = r"(?i)\b(?:cf|aff|sp|spp|ssp|n\.?\s*sp|var|subsp|f)\.\s*"
PLACEHOLDER = r"^__candidate_\d+_\d+$"
ANY_PLACEHOLDER = r"(?i)^_+candidate_"
JSON_START = r"^[\[{\"\d]"
SHORT_GENUS = r"^[A-Z]\.\s*\w*$"
TRAILING_AUTHORITY = r"\s*\([^)]*\d{4}[^)]*\)\s*$"
BINOMIAL = r"\b([A-Z][a-z]{2,})\s+([a-z]{3,})\b"
GENUS_ONLY = r"\b([A-Z][a-z]{2,})\s+(?:sp\.|spp\.|cf\.|aff\.|n\.?\s*sp\.?)"
NOT_GENERA = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December", "Fig", "Table", "Plate", "Station", "Site", "Area")

# Spelling rules of place names, in the order in which they apply. w comes
# before v so that both end as b.
LONG_VOWELS = (("aa", "a"), ("ee", "i"), ("oo", "u"), ("ii", "i"), ("uu", "u"))
ASPIRATES = (("kh", "k"), ("gh", "g"), ("ch", "c"), ("jh", "j"), ("th", "t"), ("dh", "d"), ("ph", "p"), ("bh", "b"))
INTERCHANGEABLE = (("w", "v"), ("v", "b"), ("sh", "s"), ("ss", "s"), ("tt", "t"), ("nn", "n"), ("ll", "l"), ("rr", "r"), ("mm", "m"))
PLACE_SUFFIXES = ((" tal", ""), (" tahsil", ""), (" taluka", ""), (" dist", ""), (" district", ""), (" vill", ""), (" village", ""), (" post", ""), (" p.o", ""), (" po ", " "))
ACCENTED = "àáâãäåāăąçćčďèéêëēĕėęěìíîïīĭįłñńňòóôõöōŏőřŕśšşťţùúûüūŭůűýÿžźżḍḥḷṃṇṅṛṣṭ"
PLAIN = "aaaaaaaaacccdeeeeeeeeeiiiiiiilnnnoooooooorrsssttuuuuuuuuyyzzzdhlmnnrst"

# Locality patterns.
RELATIVE_PREFIX = r"(?i)^(?:near|off|adjacent to|along|close to|around|vicinity of|coast of|waters of|inshore of|offshore of|from|at|in)\s+"
ADMIN_NOISE = r"(?i),?\s*(?:district|taluka|tehsil|block|state|india|gujarat|maharashtra|kerala|karnataka|goa|tamilnadu|andhra pradesh|odisha)\b"
COUNTRY_SIGNALS = r"(?i)\b(india|gujarat|kerala|maharashtra|karnataka|goa|tamilnadu|tamil\s*nadu|andhra|telangana|odisha|rajasthan|andaman|lakshadweep|bengal)\b"
MEASUREMENT = r"(?i)\b\d+[\d\s\-–]*\s*(cm|mm|m\b|km|in\b|ft|µm|um|mg|g\b|kg|l\b|ml|%|ppt|ppm|°[CF])"
HABITAT_LEAD = (
    r"(?i)^(intertidal|subtidal|supratidal|littoral|infralittoral|eulittoral|open\s+sea|open\s+ocean|pelagic|benthic|demersal"
    r"|rocky\s|sandy\s|muddy\s|silty\s|soft\s+bottom|hard\s+bottom|coral\s+reef|dead\s+coral|seagrass|mangrove\s+edge|estuarine\s"
    r"|reef\s+flat|reef\s+slope|lagoon\s+floor|shallow\s+water|deep\s+water|offshore\s+water"
    r"|found\s+(in|on|at|near|among|between|beneath|under)|collected\s+(in|from|on|at|near)|associated\s+with)"
)
MORPHOLOGY_TERMS = (
    "umbrella", "subumbrella", "subumbrellar", "exumbrella", "bell", "oral arm", "oral arms", "manubrium", "tentacle", "tentacles",
    "nematocyst", "nematocysts", "rhopalia", "rhopalium", "gonad", "gonads", "radial canal", "ring canal", "strobila", "ephyra",
    "zooxanthellae", "filament", "filaments", "zooid", "zooids", "mesoglea", "ectoderm", "endoderm", "diameter", "radius",
    "branched", "unbranched", "dorsal", "ventral", "lateral", "proximal", "distal", "anterior", "posterior", "in number", "in length",
    "in width", "in height", "flattened", "convex", "concave", "circular", "ovate", "pigment", "pigmented", "coloured", "coloration",
    "symmetry", "radial symmetry", "bilateral",
)
HABITAT_WORDS = (
    "intertidal", "subtidal", "reef", "coral", "dead", "live", "rocky", "sandy", "muddy", "soft", "hard", "seagrass", "mangrove", "lagoon",
    "estuary", "estuarine", "shore", "shoreface", "shoreline", "area", "zone", "habitat", "environment", "substrate", "water", "waters",
    "sea", "ocean", "bay", "gulf", "coast", "bottom", "bed", "flat", "slope", "edge", "shallow", "deep", "surface", "column", "offshore",
    "nearshore", "inshore", "littoral", "pelagic", "benthic", "demersal", "of", "the", "a", "an", "and", "or", "with", "in", "on", "at",
    "near", "among", "between", "beneath", "under", "from", "not", "reported", "unknown",
)
NOT_PROPER = ("the", "a", "an", "in", "on", "at", "of", "and", "or", "near", "off", "from", "with", "between", "not", "reported", "area", "zone", "reef", "coast", "sea", "ocean", "bay", "gulf", "island", "islands", "waters", "shore")
NO_LOCALITY = ("not reported", "unknown", "", "n/a", "na")
HIERARCHY_WORDS = ("gulf", "bay", "sea", "ocean", "coast", "island", "district", "taluk", "tehsil", "state", "province", "india", "gujarat", "kerala", "karnataka", "maharashtra", "tamil", "andhra", "odisha", "goa", "lakshadweep", "andaman", "nicobar", "bengal", "assam")

# Coordinate boxes as (lat_min, lat_max, lon_min, lon_max).
COUNTRY_BOX = (6.0, 37.6, 68.0, 97.5)
OCEAN_BOX = (0.0, 25.0, 55.0, 90.0)
STATE_BOX_MARGIN = 0.5
STATE_BOXES = {
    "andhra pradesh": (12.6, 19.9, 76.7, 84.8), "arunachal pradesh": (26.6, 29.5, 91.5, 97.4), "assam": (24.1, 27.9, 89.7, 96.0),
    "bihar": (24.3, 27.5, 83.3, 88.3), "chhattisgarh": (17.8, 24.1, 80.2, 84.4), "goa": (14.9, 15.8, 73.7, 74.3),
    "gujarat": (20.1, 24.7, 68.2, 74.5), "haryana": (27.7, 30.9, 74.5, 77.6), "himachal pradesh": (30.4, 33.2, 75.6, 79.0),
    "jharkhand": (21.9, 25.3, 83.3, 87.9), "karnataka": (11.6, 18.5, 74.1, 78.6), "kerala": (8.3, 12.8, 74.8, 77.4),
    "madhya pradesh": (21.1, 26.9, 74.0, 82.8), "maharashtra": (15.6, 22.0, 72.6, 80.9), "manipur": (23.8, 25.7, 93.0, 94.8),
    "meghalaya": (25.0, 26.1, 89.8, 92.8), "mizoram": (21.9, 24.5, 92.3, 93.5), "nagaland": (25.2, 27.0, 93.3, 95.3),
    "odisha": (17.8, 22.6, 81.4, 87.5), "punjab": (29.5, 32.5, 73.9, 76.9), "rajasthan": (23.0, 30.2, 69.5, 78.3),
    "sikkim": (27.1, 28.1, 88.0, 88.9), "tamil nadu": (8.1, 13.6, 76.2, 80.4), "telangana": (15.8, 19.9, 77.2, 81.3),
    "tripura": (22.9, 24.5, 91.2, 92.3), "uttar pradesh": (23.9, 30.4, 77.1, 84.6), "uttarakhand": (28.7, 31.5, 77.6, 81.1),
    "west bengal": (21.5, 27.2, 85.8, 89.9), "andaman nicobar": (6.8, 13.7, 92.2, 93.9), "lakshadweep": (8.0, 12.5, 71.8, 74.0),
    "jammu kashmir": (32.3, 37.1, 73.9, 80.4), "ladakh": (32.3, 36.2, 75.8, 80.4),
}
NEIGHBOUR_BOXES = {
    "pakistan": (23.6, 37.1, 60.9, 77.8), "china": (18.2, 53.6, 73.7, 135.1), "nepal": (26.4, 30.4, 80.1, 88.2),
    "bangladesh": (20.7, 26.6, 88.0, 92.7), "myanmar": (9.8, 28.5, 92.2, 101.2), "sri lanka": (5.9, 9.9, 79.7, 81.9),
}
MARINE_WORDS = ("sea", "ocean", "marine", "offshore", "pelagic", "benthic", "reef", "coral", "deep", "trawl", "demersal", "littoral", "intertidal", "subtidal", "mangrove", "estuary", "coastal", "gulf", "bay", "island", "archipelago", "atoll", "seamount", "abyssal")

# Repairs of scanned coordinates, in order, and the forms they are read by.
COORDINATE_FIXES = (
    (r"([NS])\s*(\d{1,2})0(\d{2}['’ʼ])", "$1 $2°$3"),
    (r"([EW])\s*(\d{1,3})0(\d{2}['’ʼ])", "$1 $2°$3"),
    (r"(\d)O(\d)", "$1°$2"),
    (r"(\d+)\s*[dD°]\s*(\d+)\s*[mM']\s*([\d.]+)\s*[sS\"]", "$1°$2'$3\""),
    (r"[′ʼ’]", "'"),
    (r"[″”]", "\""),
    (r"[\u00a0\u200b\u200c\u200d\ufeff]", " "),
)
DMS = r"([NSEWnsew])\s*(\d{1,3})[°\s](\d{1,2})['′\s](?:([\d.]+)[\"″\s]?)?\s*([NSEWnsew])?"
DECIMAL_DEGREES = r"(?i)([NSEW])?\s*([-−–])?(\d{1,3}\.\d+)\s*°?\s*([NSEW])?"

# Citation and year patterns.
YEAR = r"\b(1[7-9]\d{2}|20[0-2]\d)\b"
AUTHORITY_YEAR = r"\((?:[A-Z][A-Za-zÀ-ÿ'\-]+(?:\s+(?:and|&|et|von|van|de)\s+)?)+,?\s*(1[7-9]\d{2}|20[0-2]\d)\)"
CITED_YEAR = r"\b(19[5-9]\d|20[0-2]\d)\b"
EVIDENCE_YEAR = r"\b(1[89]\d{2}|20[012]\d)\b"
HISTORICAL = r"(?i)\b(?:according to|reported by|recorded by|described by|as per|cited in|sensu)\s+([A-Z][a-z]+)"
STUDY_AREA = (r"\bin\s+(?:the\s+)?([A-Z][a-zA-Z\s,]+?)(?:\s*[:(]|\s*$)", r"\(([A-Z][a-zA-Z\s,]+India[a-zA-Z\s,]*)\)")
DOI = r"(?i)\b(10\.\d{4,9}/[-._;()/:A-Z0-9]+)"

# Words that give a section its role; the first role that matches wins.
SECTION_ROLES = {
    "ABSTRACT": ("abstract", "summary", "synopsis"),
    "INTRODUCTION": ("introduction", "background", "overview"),
    "METHODS": ("method", "methods", "methodology", "material", "materials", "study area", "study site", "sampling", "collection", "field", "survey", "protocol", "procedure", "experimental", "station"),
    "RESULTS": ("result", "results", "findings", "occurrence", "record"),
    "DISCUSSION": ("discussion", "conclusion", "conclusions", "remarks", "synthesis", "implication"),
    "TABLES": ("table", "appendix", "supplementary", "checklist"),
    "TAXONOMY": ("taxonomy", "systematics", "diagnosis", "description", "new species", "new record", "key to species"),
}

# Text patterns.
PLACE = r"\b[A-Z][a-z]{2,}(?:\s+(?:of\s+)?[A-Z][a-z]{2,}){0,3}\b"
NOT_PLACES = ("Table", "Figure", "Methods", "Results", "Discussion", "Abstract", "Introduction", "Section", "Appendix", "Supplementary", "Data", "Note", "Text", "Plate", "Volume", "Number", "Species", "Family", "Order", "Class", "Phylum", "Kingdom", "Genus")
MONTHS = r"Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
DATE = rf"(?i)\b(?:{MONTHS})\s+\d{{4}}\b|\b\d{{4}}[–\-/]\d{{2,4}}\b"
DEPTH = r"(?i)\b\d+(?:\.\d+)?\s*(?:–|-)\s*(?:\d+(?:\.\d+)?)?\s*m(?:eters?)?\b|\bat\s+(?:a\s+)?depth\s+of\s+\d+(?:\.\d+)?\s*m\b"
PRIMARY_SIGNALS = r"(?i)\b(collected|recorded|observed|found|identified|encountered|we collected|specimens were|new record|new occurrence|first report|present study|this study|our survey|examined|deposited in|new species)\b"
SECONDARY_SIGNALS = r"(?i)\b(reported by|according to|cited by|previously recorded|as noted by|sensu|see also|\d{4}\)|\(\w+ et al|\[[\d,]+\]|earlier workers|literature|in the literature)\b"
MEASURE_SPAN = r"(?i)\b\d+[\d\s.–\-]*\s*(?:cm|mm|m\b|km|in\b|µm|um|mg|g\b|kg|ml|l\b|%|ppt|ppm|°[CF]|individuals?|specimens?|colonies)"
SENTENCE_END = r"(?<=[.!?])\s+"

# Relations told by a sentence, their patterns and confidences.
RELATIONS = (
    ("FOUND_AT", r"(?i:found|collected|recorded|observed|reported)\s+(?i:at|from|in|near|off)\s+([A-Z][A-Za-z]+(?:\s+(?:of\s+)?[A-Z][A-Za-z]+){0,3})", 0.8),
    ("HAS_HABITAT", r"(?i)\b((?:coral|rocky|sandy|muddy)\s+(?:reef|shore|bottom|flat|substrate)|intertidal\s+\w+|subtidal\s+\w+|seagrass\s+\w+|mangrove\s+\w+)", 0.7),
    ("HAS_DEPTH", r"(\d+(?:\.\d+)?\s*[–\-]\s*\d+(?:\.\d+)?)\s*m\b", 0.75),
    ("CO_OCCURS_WITH", r"(?:alongside|together\s+with|associated\s+with)\s+([A-Z][a-z]{2,}\s+[a-z]{3,})", 0.65),
)

# Nomenclatural status patterns, first match wins, and specimen patterns.
STATUS = ((r"(?i)\bsp(?:ecies)?\.?\s+nov(?:a|us)?\b", "sp. nov."), (r"(?i)\bn(?:ew)?\.?\s+sp(?:ecies)?\b", "sp. nov."), (r"(?i)\bre[‑\-]?descri(?:ption|bed|bes)\b", "re-description"), (r"(?i)\bnew\s+(?:record|report|occurrence)\b", "new record"), (r"(?i)\bfirst\s+(?:record|report)\b", "new record"))
TYPE_STATUS = r"(?i)\b(holotype|paratype|allotype|syntype|lectotype|neotype|paralectotype|topotype|cotype)\b"
SIZE_MM = r"(?i)(\d+(?:\.\d+)?)(?:\s*[–\-]\s*(\d+(?:\.\d+)?))?\s*mm"
RADULA = r"(?i)\b(\d+)\s*[×x]\s*(\d+(?:\.\d+)?(?:\s*\.\s*\d+(?:\.\d+)?){1,3})\b"
COLLECTOR = r"(?:[Cc]oll(?:ected)?\.?\s+(?:by\s+)?|[Ll]eg\.\s*)([A-Z][A-Za-z\s\.\-]{3,40}?)(?=[,;.]|\s+on\s|\s+in\s|\s+\d)"
TYPE_LOCALITY = r"(?i)type\s+locality[:\s]+([^.;]{10,200})[.;]"
VOUCHER = r"\b(?:ZSI/[A-Z]{2,8}/[A-Z\d.\-/]+|[A-Z]{2,8}[.\-][A-Z\d.\-/]{3,}\d{4,})\b"
HABITAT_CLASSES = (("coral reef", "coral"), ("rocky intertidal", "rocky"), ("sandy intertidal", "sand"), ("mangrove", "mangrove"), ("seagrass bed", "seagrass"), ("kelp forest", "kelp"), ("estuarine", "estuar"), ("deep sea", "deep"), ("pelagic open ocean", "pelagic"), ("brackish water", "brackish"), ("freshwater", "freshwater"), ("terrestrial forest", "forest"), ("terrestrial grassland", "grassland"), ("wetland", "wetland"))

# What tells a table column's meaning, and weights of name sources.
COLUMN_KINDS = (("species", r"\b(species|taxon|genus|binomial|organism)\b"), ("location", r"\b(location|locality|site|station|region|country|state|district)\b"), ("date", r"\b(date|year|month|day|when)\b"), ("habitat", r"\b(habitat|environment|ecosystem|beach|coral|reef)\b"), ("notes", r"\b(notes?|remarks?|observations?|comment)\b"))
NAME_WEIGHTS = {"marine_register": 0.40, "verifier": 0.30, "backbone_exact": 0.15, "backbone_fuzzy": 0.08, "catalogue": 0.10, "serials": 0.05}
LATIN_SEEDS = ("Acanthurus", "Siganus", "Lutjanus", "Epinephelus", "Scomber", "Thunnus", "Chanos", "Mugil", "Liza", "Portunus", "Penaeus", "Perna", "Crassostrea", "Trochus", "Turbo", "Cypraea", "Conus", "Octopus", "Sepia", "Loligo", "Holothuria", "Diadema", "Turbinaria", "Padina", "Sargassum", "Ulva", "Gracilaria", "Rhizophora", "Avicennia", "Sonneratia", "Bruguiera", "Panthera", "Elephas", "Cervus", "Bos", "Equus", "Felis")
EXPECTED_COUNT = r"(?i)\b(\d{1,4})\s+(?:species|taxa)\b"
