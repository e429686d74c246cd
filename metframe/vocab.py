"""Vocabularies, lookup tables and text patterns of the bulletin domain.

Everything in this module is a FIXED VALUE: names, numbers and patterns that have to be
exactly these for results to be right. No logic lives here. All tables are far below 200
rows, so they travel inside the plan as literals and nothing is shipped or shuffled.
"""

from __future__ import annotations

# --- Fixed values: official subdivisions, in form order -------------------------------

OFFICIAL_SUBDIVISIONS = [
    "Andaman & Nicobar Islands",
    "Arunachal Pradesh",
    "Assam & Meghalaya",
    "Bihar",
    "Chhattisgarh",
    "Coastal Andhra Pradesh",
    "Coastal Karnataka",
    "East Madhya Pradesh",
    "East Rajasthan",
    "East Uttar Pradesh",
    "Gangetic West Bengal",
    "Gujarat Region",
    "Haryana, Chandigarh & Delhi",
    "Himachal Pradesh",
    "Jammu & Kashmir",
    "Jharkhand",
    "Kerala",
    "Konkan & Goa",
    "Lakshadweep",
    "Madhya Maharashtra",
    "Marathwada",
    "Nagaland, Manipur, Mizoram & Tripura",
    "North Interior Karnataka",
    "Odisha",
    "Punjab",
    "Rayalaseema",
    "Saurashtra & Kutch",
    "Sikkim",
    "South Interior Karnataka",
    "Sub-Himalayan West Bengal & Sikkim",
    "Tamil Nadu & Puducherry",
    "Telangana",
    "Uttarakhand",
    "Vidarbha",
    "West Madhya Pradesh",
    "West Rajasthan",
    "West Uttar Pradesh",
    "NW Arabian Sea",
    "NE Arabian Sea",
    "WC Arabian Sea",
    "EC Arabian Sea",
    "SW Arabian Sea",
    "SE Arabian Sea",
    "NW Bay",
    "NE Bay",
    "WC Bay",
    "EC Bay",
    "SW Bay",
    "SE Bay",
    "N Andaman Sea",
    "S Andaman Sea",
    "Central Pakistan",
    "Pakistan",
    "North pakistan",
    "Bangladesh",
    "Iran",
    "Gulf of Mannar",
    "Comorin Area",
]

PRESSURE_LEVELS = [
    "Surface",
    "925 hPa",
    "850 hPa",
    "700 hPa",
    "600 hPa",
    "500 hPa",
    "400 hpa",
    "300 hpa",
    "200 hPa",
    "100 hPa",
]

SUPPORTED_SYSTEMS = ["WD", "CYCIR", "Trough"]

# --- Fixed values: gazetteers, (name, latitude, longitude) ----------------------------

IMD_POINTS = [
    ("Jammu & Kashmir", 34.0, 74.5),
    ("Himachal Pradesh", 32.0, 77.5),
    ("Punjab", 31.0, 75.5),
    ("Haryana", 29.5, 76.0),
    ("Delhi", 28.6, 77.2),
    ("Uttarakhand", 30.0, 79.0),
    ("West Rajasthan", 27.0, 72.0),
    ("East Rajasthan", 26.5, 76.0),
    ("West Uttar Pradesh", 28.0, 79.0),
    ("East Uttar Pradesh", 26.5, 83.0),
    ("Bihar", 25.5, 85.5),
    ("Jharkhand", 23.5, 85.5),
    ("Gangetic West Bengal", 22.5, 88.0),
    ("Sub-Himalayan West Bengal & Sikkim", 27.0, 88.0),
    ("Odisha", 20.5, 85.0),
    ("West Madhya Pradesh", 23.5, 76.0),
    ("East Madhya Pradesh", 23.5, 80.0),
    ("Chhattisgarh", 21.5, 82.0),
    ("Gujarat", 22.5, 71.0),
    ("Saurashtra & Kutch", 23.0, 70.0),
    ("Konkan & Goa", 18.0, 73.5),
    ("Madhya Maharashtra", 19.0, 75.5),
    ("Marathwada", 19.5, 76.5),
    ("Vidarbha", 21.0, 79.0),
    ("Coastal Andhra Pradesh", 16.0, 80.5),
    ("Telangana", 18.0, 79.0),
    ("Rayalaseema", 15.0, 78.0),
    ("Tamil Nadu", 11.0, 79.0),
    ("Coastal Karnataka", 14.5, 74.5),
    ("North Interior Karnataka", 15.5, 76.0),
    ("South Interior Karnataka", 14.0, 76.5),
    ("Kerala", 10.5, 76.5),
    ("Assam & Meghalaya", 26.0, 92.0),
    ("Arunachal Pradesh", 28.0, 94.5),
    ("Nagaland-Manipur-Mizoram-Tripura", 24.5, 93.5),
    ("North Pakistan", 35.0, 72.0),
    ("Central Pakistan", 30.0, 70.0),
    ("West Pakistan", 30.0, 67.0),
    ("Southwest Pakistan", 28.0, 62.0),
    ("Far West Pakistan", 29.0, 55.0),
    ("South Pakistan", 28.0, 68.0),
    ("Bangladesh", 24.0, 90.0),
    ("Ladakh", 34.5, 77.5),
]

FORM_POINTS = [
    ("Andaman & Nicobar Islands", 11.0, 93.0),
    ("Arunachal Pradesh", 28.0, 94.5),
    ("Assam & Meghalaya", 26.0, 92.0),
    ("Bihar", 25.5, 85.5),
    ("Chhattisgarh", 21.5, 82.0),
    ("Coastal Andhra Pradesh", 16.0, 80.5),
    ("Coastal Karnataka", 14.5, 74.5),
    ("East Madhya Pradesh", 23.5, 80.0),
    ("East Rajasthan", 26.5, 76.0),
    ("East Uttar Pradesh", 26.5, 83.0),
    ("Gangetic West Bengal", 22.5, 88.0),
    ("Gujarat Region", 22.5, 71.0),
    ("Haryana, Chandigarh & Delhi", 29.5, 76.5),
    ("Himachal Pradesh", 32.0, 77.5),
    ("Jammu & Kashmir", 34.0, 74.5),
    ("Jharkhand", 23.5, 85.5),
    ("Kerala", 10.5, 76.5),
    ("Konkan & Goa", 18.0, 73.5),
    ("Lakshadweep", 11.0, 73.0),
    ("Madhya Maharashtra", 19.0, 75.5),
    ("Marathwada", 19.5, 76.5),
    ("Nagaland, Manipur, Mizoram & Tripura", 24.5, 93.5),
    ("North Interior Karnataka", 15.5, 76.0),
    ("Odisha", 20.5, 85.0),
    ("Punjab", 31.0, 75.5),
    ("Rayalaseema", 15.0, 78.0),
    ("Saurashtra & Kutch", 23.0, 70.0),
    ("Sikkim", 27.5, 88.5),
    ("South Interior Karnataka", 14.0, 76.5),
    ("Sub-Himalayan West Bengal & Sikkim", 27.0, 88.0),
    ("Tamil Nadu & Puducherry", 11.0, 79.0),
    ("Telangana", 18.0, 79.0),
    ("Uttarakhand", 30.0, 79.0),
    ("Vidarbha", 21.0, 79.0),
    ("West Madhya Pradesh", 23.5, 76.0),
    ("West Rajasthan", 27.0, 72.0),
    ("West Uttar Pradesh", 28.0, 79.0),
    ("NW Arabian Sea", 22.0, 65.0),
    ("NE Arabian Sea", 22.0, 72.0),
    ("WC Arabian Sea", 18.0, 68.0),
    ("EC Arabian Sea", 18.0, 72.0),
    ("SW Arabian Sea", 12.0, 68.0),
    ("SE Arabian Sea", 12.0, 74.0),
    ("NW Bay", 20.0, 88.0),
    ("NE Bay", 20.0, 92.0),
    ("WC Bay", 16.0, 86.0),
    ("EC Bay", 16.0, 90.0),
    ("SW Bay", 10.0, 86.0),
    ("SE Bay", 10.0, 92.0),
    ("N Andaman Sea", 14.0, 94.0),
    ("S Andaman Sea", 8.0, 94.0),
    ("Iran", 32.0, 54.0),
    ("Iran", 32.0, 58.0),
    ("Iran", 32.0, 60.0),
    ("Pakistan", 30.0, 69.0),
    ("North pakistan", 33.0, 72.0),
    ("Central Pakistan", 29.0, 67.0),
]

IMD_LON_TOLERANCE = 3.5
FORM_LON_TOLERANCE = 2.5
LAT_SLACK = 0.5
COORDINATE_TOP = 5

# --- Fixed values: bulletin phrase -> official subdivisions ----------------------------

REGION_ALIASES = {
    "haryana": ["Haryana, Chandigarh & Delhi"],
    "chandigarh": ["Haryana, Chandigarh & Delhi"],
    "delhi": ["Haryana, Chandigarh & Delhi"],
    "ladakh": ["Jammu & Kashmir"],
    "kashmir": ["Jammu & Kashmir"],
    "jammu": ["Jammu & Kashmir"],
    "punjab": ["Punjab"],
    "himachal pradesh": ["Himachal Pradesh"],
    "uttarakhand": ["Uttarakhand"],
    "uttar pradesh": ["West Uttar Pradesh", "East Uttar Pradesh"],
    "west uttar pradesh": ["West Uttar Pradesh"],
    "east uttar pradesh": ["East Uttar Pradesh"],
    "bihar": ["Bihar"],
    "jharkhand": ["Jharkhand"],
    "odisha": ["Odisha"],
    "west bengal": ["Gangetic West Bengal", "Sub-Himalayan West Bengal & Sikkim"],
    "gangetic west bengal": ["Gangetic West Bengal"],
    "sub himalayan west bengal": ["Sub-Himalayan West Bengal & Sikkim"],
    "sikkim": ["Sikkim", "Sub-Himalayan West Bengal & Sikkim"],
    "assam": ["Assam & Meghalaya"],
    "meghalaya": ["Assam & Meghalaya"],
    "arunachal pradesh": ["Arunachal Pradesh"],
    "nagaland": ["Nagaland, Manipur, Mizoram & Tripura"],
    "manipur": ["Nagaland, Manipur, Mizoram & Tripura"],
    "mizoram": ["Nagaland, Manipur, Mizoram & Tripura"],
    "tripura": ["Nagaland, Manipur, Mizoram & Tripura"],
    "rajasthan": ["West Rajasthan", "East Rajasthan"],
    "west rajasthan": ["West Rajasthan"],
    "east rajasthan": ["East Rajasthan"],
    "north rajasthan": ["West Rajasthan"],
    "south rajasthan": ["West Rajasthan"],
    "gujarat": ["Gujarat Region"],
    "saurashtra": ["Saurashtra & Kutch"],
    "kutch": ["Saurashtra & Kutch"],
    "konkan": ["Konkan & Goa"],
    "goa": ["Konkan & Goa"],
    "maharashtra": ["Madhya Maharashtra", "Marathwada", "Konkan & Goa"],
    "madhya maharashtra": ["Madhya Maharashtra"],
    "marathwada": ["Marathwada"],
    "vidarbha": ["Vidarbha"],
    "madhya pradesh": ["West Madhya Pradesh", "East Madhya Pradesh"],
    "west madhya pradesh": ["West Madhya Pradesh"],
    "east madhya pradesh": ["East Madhya Pradesh"],
    "chhattisgarh": ["Chhattisgarh"],
    "andhra pradesh": ["Coastal Andhra Pradesh", "Rayalaseema"],
    "coastal andhra pradesh": ["Coastal Andhra Pradesh"],
    "north coastal andhra pradesh": ["Coastal Andhra Pradesh"],
    "south coastal andhra pradesh": ["Coastal Andhra Pradesh"],
    "telangana": ["Telangana"],
    "rayalaseema": ["Rayalaseema"],
    "karnataka": ["Coastal Karnataka", "North Interior Karnataka", "South Interior Karnataka"],
    "coastal karnataka": ["Coastal Karnataka"],
    "north interior karnataka": ["North Interior Karnataka"],
    "south interior karnataka": ["South Interior Karnataka"],
    "interior karnataka": ["North Interior Karnataka", "South Interior Karnataka"],
    "tamil nadu": ["Tamil Nadu & Puducherry"],
    "puducherry": ["Tamil Nadu & Puducherry"],
    "kerala": ["Kerala"],
    "lakshadweep": ["Lakshadweep"],
    "andaman": ["Andaman & Nicobar Islands", "N Andaman Sea", "S Andaman Sea"],
    "nicobar": ["Andaman & Nicobar Islands"],
    "northwest bay of bengal": ["NW Bay"],
    "northeast bay of bengal": ["NE Bay"],
    "north bay of bengal": ["NW Bay", "NE Bay"],
    "westcentral bay of bengal": ["WC Bay"],
    "eastcentral bay of bengal": ["EC Bay"],
    "bay of bengal": ["NW Bay", "NE Bay", "WC Bay", "EC Bay", "SW Bay", "SE Bay"],
    "arabian sea": ["NW Arabian Sea", "NE Arabian Sea", "WC Arabian Sea", "EC Arabian Sea"],
    "gulf of mannar": ["Gulf of Mannar"],
    "comorin area": ["Comorin Area"],
    "pakistan": ["Pakistan"],
    "north pakistan": ["North pakistan"],
    "north pakistan and neighbourhood": ["North pakistan"],
    "north pakistan and adjoining jammu": ["North pakistan", "Jammu & Kashmir", "Punjab"],
    "north pakistan and adjoining jammu and north punjab": ["North pakistan", "Jammu & Kashmir", "Punjab"],
    "north punjab": ["Punjab"],
    "punjab and neighbourhood": ["Punjab"],
    "central pakistan": ["Central Pakistan"],
    "bangladesh": ["Bangladesh"],
    "iran": ["Iran"],
    "northeast assam": ["Assam & Meghalaya"],
    "northeast bay": ["NE Bay"],
    "northwest bay": ["NW Bay"],
    "westcentral bay": ["WC Bay"],
    "eastcentral bay": ["EC Bay"],
    "southwest bay": ["SW Bay"],
    "southeast bay": ["SE Bay"],
}

# --- Fixed values: height chart (hPa, km) and tolerance --------------------------------

HEIGHT_CHART = [
    (925, 0.9),
    (925, 1.0),
    (850, 1.5),
    (700, 3.1),
    (600, 4.5),
    (500, 5.8),
    (400, 7.6),
    (300, 9.6),
    (250, 10.6),
    (200, 12.3),
    (150, 13.5),
    (100, 16.6),
]
HEIGHT_TOLERANCE_KM = 0.05

# --- Fixed values: formats --------------------------------------------------------------

EXTRACTION_COLUMNS = [
    "date", "source_file", "weather_system", "region",
    "region_original", "height_km", "pressure_level", "status",
]
ENRICHED_COLUMNS = [
    "date", "source_file", "weather_system", "subdivisions", "region",
    "region_original", "height_km", "pressure_level", "status",
]
EXPORT_HEADER = ["Date", "System Number", "Weather System", "Pressure Levels", "Subdivisions", "Created At"]
EXTRACT_DELIMITER = " ; "
FORM_DELIMITER = ", "
WRITE_BATCH_ROWS = 200
MONTH_NAMES = [
    "january", "february", "march", "april", "may", "june", "july",
    "august", "september", "october", "november", "december",
]

# --- Fixed values: text patterns ---------------------------------------------------------

SUMMARY_PHRASE = "summary of observations recorded"
MONSOON_LIMIT_PHRASE = "northern limit of monsoon"
LESS_MARKED_PHRASE = "less marked"
HEADING_PARAGRAPHS = 10
COORDINATE_MIN_CHARS = 10

HEADING_DATE = (
    r"\b(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)\s*,?\s*"
    r"(\d{1,2})(?:st|nd|rd|th)?\s+([A-Za-z]+)\s+(\d{4})\b"
)
FILE_NAME_DATE = r"(20\d{2})(\d{2})(\d{2})"

ABBREVIATIONS = [
    (r"\bLong\.", "Long<prd>"),
    (r"\bLat\.", "Lat<prd>"),
    (r"\bm\.\s*s\.\s*l\.", "msl<prd>"),
    (r"\bm\.\s*s\.\s*l\b", "msl"),
]
ANY_ABBREVIATION = r"[Ll][Oo][Nn][Gg]\.|[Ll][Aa][Tt]\.|[Mm]\.\s*[Ss]\."
FRAGMENT_STARTS = r"(?:with a trough|roughly along|in middle|in upper)\b"
CLAUSE_STARTS = (
    r"The\s+(?:induced\s+)?(?:upper air\s+)?cyclonic circulation|The\s+(?:north[- ]south\s+)?trough|"
    r"A\s+(?:north[- ]south\s+)?trough|A\s+fresh\s+western disturbance|The\s+western disturbance|"
    r"Another\s+western disturbance|An?\s+(?:induced\s+)?(?:upper air\s+)?cyclonic circulation|It\s+(?:then\s+)?\b"
)
SUMMARY_PREFIX = r"^Summary of observations recorded[^:]*:\s*"

REGION_EDGE_CHARS = " ,.;"
REGION_NOISE = [
    r"\s+of today morning\.?$",
    r"\s+also\.?$",
    r"\s+then persisted.*$",
    r"\s+(?:has\s+)?become(?:n)?\s+less\s+marked.*$",
    r"\s+became\s+less\s+marked.*$",
]
ANY_REGION_NOISE = (
    r"\s(?:of today morning\.?$|also\.?$|then persisted|(?:has\s+)?become(?:n)?\s+less\s+marked|became\s+less\s+marked)"
)
FRAGMENT_STOP_PHRASES = ["the", "cyclonic circulation", "upper air cyclonic circulation"]
TOKEN_STOP_WORDS = ["and", "the", "sea", "bay", "north", "south", "east", "west"]

COORDINATE_PHRASE = (
    r"along\s+long\.?\s*[0-9]+(?:\.[0-9]+)?\s*°?\s*[ew]?"
    r"(?:\s+to\s+the\s+north\s+of\s+lat\.?\s*[0-9]+(?:\.[0-9]+)?\s*°?\s*[ns]?)?"
)
COORDINATE_REGION = r"\balong\s+long\.?"
LONGITUDE = r"long\.?\s*([0-9]+(?:\.[0-9]+)?)\s*°?"
LATITUDE = r"lat\.?\s*([0-9]+(?:\.[0-9]+)?)\s*°?"
LATITUDE_HEMISPHERE = r"lat(?:itude)?\.?\s*[:\s]*([0-9]+(?:\.[0-9]+)?)°?\s*([NS])"
LONGITUDE_HEMISPHERE = r"lon(?:gitude)?\.?\s*[:\s]*([0-9]+(?:\.[0-9]+)?)°?\s*([EW])"
COORDINATE_STOP = r"\s+(?:at\s+\d|persisted|became|continued|remained)\b"
OBSERVATION_HOUR = r"\s+at\s+\d{4}\s+hours.*$"

FORECAST = r"\b(?:is\s+)?likely\s+to\s+affect\b"
CONTINUATION = r"^\s*it\b"
LEADING_LESS_MARKED = r"^\s*(?:has\s+)?become(?:n)?\s+less\s+marked\b"
LEADING_ALOFT = r"^\s*with a trough\b"
ADDITIONAL_TROUGH = r"\bwith (?:a|the) trough\b|\bassociated trough\b"
ALOFT_HEIGHT = r"with (?:a|the) trough aloft[^.]*?at\s+(\d+(?:\.\d+)?)\s*km"
TROUGH_WORD = r"\b(?:north[- ]south\s+)?trough\b"
TROUGH_VERB = r"\b(?:north[- ]south\s+)?trough\b.*\b(?:ran|run|extends?|extended)\b"

SUBJECT_SYSTEMS = [
    (r"^the\s+(?:fresh\s+)?western disturbance\b", "WD"),
    (r"^a\s+fresh\s+western disturbance\b", "WD"),
    (r"^another\s+western disturbance\b", "WD"),
    (r"^the\s+western disturbance\b", "WD"),
    (r"^the\s+(?:north[- ]south\s+)?trough\b", "Trough"),
    (r"^a\s+(?:north[- ]south\s+)?trough\b", "Trough"),
    (r"^the\s+(?:induced\s+)?(?:upper air\s+)?cyclonic circulation\b", "CYCIR"),
    (r"^an?\s+(?:induced\s+)?(?:upper air\s+)?cyclonic circulation\b", "CYCIR"),
    (r"\bwestern disturbance(s)?\s+(?:as a|seen as a)\b", "WD"),
]

DETAILED_SYSTEMS = [
    ("super cyclonic storm", "Super Cyclonic Storm (SuCS)"),
    ("extremely severe cyclonic storm", "Extremely Severe Cyclonic Storm (ESCS)"),
    ("very severe cyclonic storm", "Very Severe Cyclonic Storm (VSCS)"),
    ("severe cyclonic storm", "Severe Cyclonic Storm (SCS)"),
    ("cyclonic storm", "Cyclonic Storm (CS)"),
    ("deep depression", "Deep Depression (DD)"),
    ("western depression", "Western Depression"),
    ("depression", "Depression (D)"),
    ("western disturbance", "Western Disturbances (WD)"),
    ("western disturbances", "Western Disturbances (WD)"),
    ("well marked low pressure area", "Well Marked Low Pressure Area (WML)"),
    ("low pressure area", "Low Pressure Area"),
    ("low pressure", "Low Pressure (L)"),
    ("induced cyclonic circulation", "Induced Cyclonic Circulation"),
    ("low-level cyclonic circulation", "Low-Level Cyclonic Circulation"),
    ("mid-level cyclonic circulation", "Mid-Level Cyclonic Circulation"),
    ("upper-level cyclonic circulation", "Upper-Level Cyclonic Circulation"),
    ("cyclonic circulation", "Cyclonic Circulation (CYCIR)"),
    ("monsoon trough with extension and tilt", "Monsoon Trough with Extension and Tilt"),
    ("mean sea level trough", "Mean Sea Level Trough"),
    ("at surface trough", "At Surface Trough"),
    ("offshore trough", "Offshore Trough"),
    ("westerly trough", "Westerly Trough"),
    ("easterly trough", "Easterly Trough"),
    ("trough", "Trough"),
]

ASSOCIATED_SYSTEMS = [
    (r"\bcyclonic circulation\b", "Cyclonic Circulation"),
    (r"\bwestern disturbance\b", "Western Disturbance"),
    (r"\blow pressure area\b", "Low Pressure Area"),
    (r"\blow pressure\b", "Low Pressure"),
    (r"\beasterly trough\b", "Easterly Trough"),
    (r"\bwesterly trough\b", "Westerly Trough"),
]

STATUSES = [
    (r"persisted", "persisted"),
    (r"continued", "continued"),
    (r"remained", "remained"),
    (r"(?:has\s+)?become(?:n)?\s+less\s+marked", "became less marked"),
    (r"became less marked", "became less marked"),
    (r"merged with", "merged"),
    (r"extended", "extended"),
    (r"weakened", "weakened"),
    (r"was marked", "was marked"),
    (r"is marked", "is marked"),
    (r"lay over", "lay over"),
]

WD_START = r"\bwestern disturbance[\s\S]*"
WD_OVER = (
    r"(?:lay\s+)?(?:as\s+a\s+(?:cyclonic\s+circulation|trough)\s+)?over\s+([^.;]+?)"
    r"(?=\s+lay\s+over|\s+lay\s+as|\s+between|\s+at|\s+with\s+a\s+trough|\s+persisted|"
    r"\s+roughly\s+along|\s+ran\s+roughly|\.)"
)
CYCIR_REGIONS = [
    r"(?:induced\s+)?(?:upper air\s+)?cyclonic circulation\s+over\s+([^.;]+?)"
    r"(?:\s+which|\s+persisted|\s+lay|\s+became|\s+between|\s+at|\s+of today|\s+and\b|\.)",
    r"(?:induced\s+)?(?:upper air\s+)?cyclonic circulation\s+lay\s+over\s+([^.;]+?)"
    r"(?:\s+of today|\s+between|\s+at|\s+persisted|\s+which|\.)",
]
PATH_REGIONS = [
    r"\btrough\b.*?\bfrom\s+(.+?)\s+to\s+(?:cyclonic circulation over\s+)?(.+?)(?:\s+across\s+(.+?))?"
    r"(?:\s+of today|\s+also|\s+became|\s+at|\s+persisted|\.)",
    r"\bfrom\s+(.+?)\s+to\s+(?:cyclonic circulation over\s+)?(.+?)(?:\s+across\s+(.+?))?"
    r"(?:\s+of today|\s+also|\s+became|\s+at|\s+persisted|\.)",
]
REGION_KEYWORDS = ["over", "across", "along", "near", "off"]
KEYWORD_REGION = (
    r"\s+([a-z0-9&.,°:/\-\s]+?)"
    r"(?:\s+(?:persisted|was|became|at|with|which|who|where|and|,|;|\)|\()|$)"
)
BARE_COORDINATE_WORDS = ["long.", "long", "lat.", "lat"]
SAME_REGION = r"same region|same area|same place"
SAME_REGION_CARRY = r"same region|same area|same place|over the same|across the same"
SYSTEM_CARRY = r"\bit\b|this system|the system|it persisted|it remained|it continued"
GENERIC_PATH = (
    r"\bfrom\s+([a-z0-9&.,°/\-\s]+?)\s+to\s+([a-z0-9&.,°/\-\s]+?)"
    r"(?:\s+across\s+([a-z0-9&.,°/\-\s]+?))?(?:\s+(?:at|persisted|became|$)|[.;])"
)

HEIGHT_BETWEEN = r"between\s+(\d+(?:\.\d+)?)\s*(?:km\s*)?(?:&|and)\s*(\d+(?:\.\d+)?)\s*(?:km\b)?"
HEIGHT_SINGLE = [
    r"(\d+(?:\.\d+)?)\s*km\s*(?:above\s+mean\s+sea\s+level|above\s+m\.s\.l\.|above\s+msl|am\.sl\.|am\.sl|msl|mean sea level)",
    r"at\s+(\d+(?:\.\d+)?)\s*km\s*(?:above|height)",
    r"height\s+of\s+(\d+(?:\.\d+)?)\s*km",
    r"upto\s+(\d+(?:\.\d+)?)\s*km",
    r"extended\s+upto\s+(\d+(?:\.\d+)?)\s*km",
]
PRESSURE_TEXT = r"(\d{3,4})\s*hpa"
FIRST_NUMBER = r"-?[0-9]+(?:\.[0-9]+)?"
