"""Fixed values the results must carry. They are data, not logic."""

# --- fixed values: choice-list sentinels -----------------------------------------------------
ALL = "All"
NONE_SELECTED = "None selected"

# --- fixed values: microorganism groups charted when no group is chosen -----------------------
DEFAULT_GROUPS = ("Bacteria", "Virus", "Parasite")

# --- fixed values: ISO 3166-1 alpha-3 codes of the countries drawn on the border layer ---------
BORDER_COUNTRIES = (
    "BEN", "BFA", "CIV", "CPV", "ESH", "GHA", "GIN", "GMB", "GNB",
    "LBR", "MLI", "MRT", "NER", "NGA", "SEN", "SLE", "TGO",
)

# --- fixed values: breaks of the site-density classes, sites per square kilometre --------------
DENSITY_BREAKS = (0, 0.001, 0.005, 0.01, 0.05, 1, 6)

# --- fixed values: assay wording and the status shown for it -----------------------------------
TESTED = "tested"
POSITIVE = "positive"
STATUS_ASSAYED = "Assayed"
STATUS_POSITIVE = "Number positive"
STATUS_OTHER = "Other"

# --- fixed values: recodes -----------------------------------------------------------------------
BOTH_METHODS_RAW = "morphological, molecular"
BOTH_METHODS_LABEL = "Morphological and molecular"
NOT_REPORTED = "Not reported"
MISSING_TEXT = "NA"

# --- fixed values: study-table columns left out of the short table -------------------------------
SHORT_TABLE_DROPS = ("title", "country", "journal_name", "detailed_aim_1", "detailed_aim_2")

# --- fixed values: page lengths of the two study tables ------------------------------------------
STUDY_PAGE = 10
SHORT_STUDY_PAGE = 15

# --- fixed values: palettes (orange and purple as R colour names resolve them) ---------------------
AIM_PALETTE = ("#FFA500", "#A020F0")

# --- fixed values: marker layers: group name, radius, colour ---------------------------------------
LAYER_ALL = "All studies"
LAYER_STUDIES = "Selected studies"
LAYER_SPECIES = "Selected species"
BASE_COLOUR = "black"
BASE_RADIUS = 1
STUDY_RADIUS = 6
SPECIES_RADIUS = 3
MICROBE_RADIUS = 6
LAYER_BORDERS = "Country borders"
LAYER_DENSITY = "Trap density map"

# --- fixed values: label wording -------------------------------------------------------------------
BREAK = "<br>"
LABEL_STUDY = "Study ID: "
LABEL_VILLAGE = "Village/Region: "
LABEL_NIGHTS = "Number of trap nights: "
LABEL_TRAPPED = "Number of trapped individuals: "
LABEL_HOST = "Rodent species: "
LABEL_MICROBE = "Microorganism tested: "
LABEL_SAMPLES = "Number of samples tested: "
LABEL_POSITIVE = "Number of positive samples: "
LABEL_SAMPLED = "Year/month of rodent sampling: "
YEAR_MONTH_GAP = "  -  "
SELECTED_STUDIES = "Selected studies:"
LABEL_DENSITY = "Site density: "
LABEL_REGION_STUDIES = "Studies trapping here: "
LABEL_COUNTRY = "Country: "
