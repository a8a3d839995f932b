"""Parameter tables. Everything here is data that callers may override."""

# Residue alphabet and the extra letters accepted in raw sequences.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
EXTRA_RESIDUES = "XU"

# Length bounds, class minimum, similarity and split defaults.
MIN_LENGTH = 30
MAX_LENGTH = 2048
MIN_SAMPLES = 50
IDENTITY = 0.3
COVERAGE = 0.8
TEST_FRACTION = 0.15
VAL_FRACTION = 0.15
SEED = 42
THRESHOLD = 0.5
TOP_K = 3

# Annotation grammar.
ANNOTATION_PREFIX = "SUBCELLULAR LOCATION: "
NOTE_MARK = "Note="
EVIDENCE_PATTERN = r"\s*\{[^}]*\}"
TOPOLOGY_TERMS = (
    "single-pass",
    "multi-pass",
    "peripheral",
    "lipid-anchor",
    "gpi-anchor",
    "type i membrane",
    "type ii membrane",
    "type iii membrane",
    "type iv membrane",
)

# Class groups in matching order, each with its keywords.
LOCATION_GROUPS = {
    "Nucleus": ("nucleus", "nucleolus", "nucleoplasm", "nuclear"),
    "Mitochondrion": ("mitochondrion", "mitochondria", "mitochondrial"),
    "Endoplasmic Reticulum": ("endoplasmic reticulum",),
    "Golgi Apparatus": ("golgi",),
    "Cytoplasm": ("cytoplasm", "cytosol", "cytoskeleton"),
    "Membrane": ("membrane", "cell membrane", "plasma membrane"),
    "Secreted/Extracellular": ("secreted", "extracellular", "cell wall"),
    "Vacuole": ("vacuole", "lysosome"),
    "Peroxisome": ("peroxisome",),
}

# Names used by external label sets -> our classes.
EXTERNAL_LABELS = {
    "nucleus": "Nucleus",
    "cytoplasm": "Cytoplasm",
    "extracellular": "Secreted/Extracellular",
    "cell membrane": "Membrane",
    "plasma membrane": "Membrane",
    "mitochondrion": "Mitochondrion",
    "endoplasmic reticulum": "Endoplasmic Reticulum",
    "golgi apparatus": "Golgi Apparatus",
    "lysosome/vacuole": "Vacuole",
    "lysosome": "Vacuole",
    "vacuole": "Vacuole",
    "peroxisome": "Peroxisome",
}

# Taxonomy id -> species name.
ORGANISM_NAMES = {
    9606: "Homo sapiens",
    10090: "Mus musculus",
    559292: "Saccharomyces cerevisiae",
    10116: "Rattus norvegicus",
    7227: "Drosophila melanogaster",
    6239: "Caenorhabditis elegans",
    3702: "Arabidopsis thaliana",
    83333: "Escherichia coli",
}

# Source column -> raw record column.
RAW_COLUMNS = {
    "Entry": "accession",
    "From": "accession",
    "Sequence": "sequence",
    "Subcellular location [CC]": "subcellular_location",
    "Organism (ID)": "organism_id",
    "Organism": "organism_name",
}
REQUIRED_RAW = ("accession", "sequence", "subcellular_location")

# Distance between two classes (symmetric).
CLASS_DISTANCES = {
    ("Nucleus", "Cytoplasm"): 1,
    ("Nucleus", "Membrane"): 2,
    ("Nucleus", "Mitochondrion"): 2,
    ("Nucleus", "Endoplasmic Reticulum"): 2,
    ("Nucleus", "Golgi Apparatus"): 2,
    ("Nucleus", "Secreted/Extracellular"): 3,
    ("Nucleus", "Vacuole"): 2,
    ("Nucleus", "Peroxisome"): 2,
    ("Cytoplasm", "Membrane"): 1,
    ("Cytoplasm", "Mitochondrion"): 1,
    ("Cytoplasm", "Endoplasmic Reticulum"): 1,
    ("Cytoplasm", "Golgi Apparatus"): 2,
    ("Cytoplasm", "Secreted/Extracellular"): 2,
    ("Cytoplasm", "Vacuole"): 2,
    ("Cytoplasm", "Peroxisome"): 1,
    ("Membrane", "Endoplasmic Reticulum"): 1,
    ("Membrane", "Golgi Apparatus"): 1,
    ("Membrane", "Secreted/Extracellular"): 1,
    ("Membrane", "Mitochondrion"): 2,
    ("Membrane", "Vacuole"): 1,
    ("Membrane", "Peroxisome"): 2,
    ("Mitochondrion", "Endoplasmic Reticulum"): 2,
    ("Mitochondrion", "Golgi Apparatus"): 2,
    ("Mitochondrion", "Secreted/Extracellular"): 3,
    ("Mitochondrion", "Vacuole"): 2,
    ("Mitochondrion", "Peroxisome"): 1,
    ("Endoplasmic Reticulum", "Golgi Apparatus"): 1,
    ("Endoplasmic Reticulum", "Secreted/Extracellular"): 1,
    ("Endoplasmic Reticulum", "Vacuole"): 2,
    ("Endoplasmic Reticulum", "Peroxisome"): 2,
    ("Golgi Apparatus", "Secreted/Extracellular"): 1,
    ("Golgi Apparatus", "Vacuole"): 1,
    ("Golgi Apparatus", "Peroxisome"): 2,
    ("Secreted/Extracellular", "Vacuole"): 2,
    ("Secreted/Extracellular", "Peroxisome"): 3,
    ("Vacuole", "Peroxisome"): 2,
}
DEFAULT_DISTANCE = 2.0

# Hydropathy per residue (Kyte & Doolittle 1982).
HYDROPATHY = {
    "A": 1.8,
    "C": 2.5,
    "D": -3.5,
    "E": -3.5,
    "F": 2.8,
    "G": -0.4,
    "H": -3.2,
    "I": 4.5,
    "K": -3.9,
    "L": 3.8,
    "M": 1.9,
    "N": -3.5,
    "P": -1.6,
    "Q": -3.5,
    "R": -4.5,
    "S": -0.8,
    "T": -0.7,
    "V": 4.2,
    "W": -0.9,
    "Y": -1.3,
}

# Average free amino acid masses and the water lost per bond.
RESIDUE_MASS = {
    "A": 89.0932,
    "C": 121.1582,
    "D": 133.1027,
    "E": 147.1293,
    "F": 165.1891,
    "G": 75.0666,
    "H": 155.1546,
    "I": 131.1729,
    "K": 146.1876,
    "L": 131.1729,
    "M": 149.2113,
    "N": 132.1179,
    "P": 115.1305,
    "Q": 146.1445,
    "R": 174.201,
    "S": 105.0926,
    "T": 119.1192,
    "V": 117.1463,
    "W": 204.2252,
    "Y": 181.1885,
}
WATER_MASS = 18.0153

# pK of charged groups (Bjellqvist scale).
PK_POSITIVE = {"K": 10.0, "R": 12.0, "H": 5.98}
PK_NEGATIVE = {"D": 4.05, "E": 4.45, "C": 9.0, "Y": 10.0}
PK_N_TERM = {"A": 7.59, "M": 7.0, "S": 6.93, "P": 8.36, "T": 6.82, "V": 7.44, "E": 7.7}
PK_N_TERM_DEFAULT = 7.5
PK_C_TERM = {"D": 4.55, "E": 4.75}
PK_C_TERM_DEFAULT = 3.55
PH_BRACKET = (4.05, 12.0)

# Residue sets of the composition fractions.
AROMATIC = "FWY"
HELIX = "EMALK"
TURN = "NPGSD"
SHEET = "VIYFWLT"

# Default property list of the biophysical feature block.
DEFAULT_PROPERTIES = (
    "molecular_weight",
    "isoelectric_point",
    "gravy",
    "aromaticity",
    "instability_index",
)

# Metrics shown in comparison tables.
HEADLINE_METRICS = (
    "f1_macro",
    "f1_micro",
    "precision_macro",
    "recall_macro",
    "exact_match_ratio",
    "hamming_loss",
)

# Coarse temperature grid of the calibration search.
TEMPERATURE_GRID = (0.5, 0.7, 0.85, 1.0, 1.15, 1.3, 1.5, 1.75, 2.0, 2.5, 3.0)
