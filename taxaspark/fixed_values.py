"""Word lists, lookup tables, patterns and defaults.

They decide results (which hit counts as 16S, which country a label means), so
they are data of the domain, kept here in plain text and natural order.
"""

# Description keywords that mark a hit as 16S rRNA.
SIXTEEN_S_POSITIVE = [
    "16s ribosomal rna", "16s rrna", "16s ribosomal",
    "16s small subunit", "small subunit ribosomal rna",
    "ssu rrna", "16s rdna", "small subunit rrna",
]

# Description keywords that rule 16S out (checked first).
SIXTEEN_S_NEGATIVE = [
    "18s", "23s", "28s", "5s", "5.8s",
    "large subunit", "lsu", "its1", "its2",
    "internal transcribed spacer", "chloroplast",
    "mitochondrial", "plastid",
]

# Spelling of a first taxonomy level (lower case) -> domain.
DOMAIN_SYNONYMS = {
    "bacteria": "Bacteria",
    "archaea": "Archaea",
    "archaebacteria": "Archaea",
    "eukaryota": "Eukaryota",
    "eukarya": "Eukaryota",
}

# What a verdict says about a sequence.
VERDICT_REASONS = {
    "no_hits": "No VSEARCH hit above {percent:.1f}% identity threshold",
    "mixed": "Mixed hits: Bacteria + ",
    "bacterial": "Bacterial hits only",
    "archaeal": "Rejected: Archaeal sequence",
    "eukaryotic": "Rejected: Eukaryotic sequence",
    "undetermined": "Rejected: Domain could not be determined",
    "unrecognised": "Rejected: No recognizable domain",
    "no_top_hits": "No BLAST hits found",
    "no_good_hits": "No hits above identity threshold {threshold}",
}

# Characters of a hit description shown in a reason.
DESCRIPTION_SHOWN = 100

# Geographic labels that carry no place.
NON_PLACES = [
    "missing", "unspecified", "not collected", "not applicable",
    "not available", "na", "nan", "labcontrol test",
]

# Country label (lower case) -> display name.
COUNTRY_NAMES = {
    "usa": "United States of America",
    "uk": "United Kingdom",
    "united kingdom": "United Kingdom",
    "south korea": "South Korea",
    "hong kong": "China",
    "taiwan": "Taiwan",
    "russia": "Russia",
    "iran": "Iran",
    "tanzania": "Tanzania",
    "bolivia": "Bolivia",
    "venezuela": "Venezuela",
    "moldova": "Moldova",
    "syria": "Syria",
    "turkey": "Turkey",
    "united states minor outlying islands": "U.S. Minor Outlying Is.",
}

# Prediction-model token of a method name -> MLP depth.
MLP_DEPTHS = {
    "epc_pool_kl": 1,
    "epc_pool_1_kl": 2,
    "epc_pool_2_kl": 3,
    "epc_pool_3_kl": 4,
}

# P-value thresholds and their marks.
SIGNIFICANCE_MARKS = [(0.001, "***"), (0.01, "**"), (0.05, "*")]

# Accession prefixes of a sample id.
SAMPLE_ID_PREFIXES = ("DRS", "SRS", "ERS")

# Columns of a tabular (12-field) hit file.
HIT_COLUMNS = [
    "query_id", "target", "identity", "align_length", "mismatches", "gaps",
    "query_start", "query_end", "target_start", "target_end", "evalue", "bitscore",
]

# Defaults of the sample and taxon filters.
READ_COUNT_LB = 10
SAMPLE_COUNT_LB = 1
MIN_TAXA = 50
MAX_TAXA = 250
DEPTH_QUANTILES = (0.05, 0.95)
SPECIES_MIN_TAXA = 50
FOLD_COUNT_LB = 150

# Numerical constants of the predictors and checks.
PREDICTION_SMOOTHING = 1e-8
GEOMETRIC_MEAN_EPS = 1e-6
PROFILE_SUM_TOLERANCE = 1e-4
SMALL_COMPONENT = 5
