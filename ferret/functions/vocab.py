"""Word lists used by the curation predicates.

The production lists below are fixed values: they must equal the published
curation configuration for results to match, so they are stated as data, in
their declared order (order matters: the first matching domain wins).
Registered demo queries pass lists of words that occur in the driver tables.
"""

# ---- Fixed values: scientific-domain keywords, in declared domain order ----
SCIENTIFIC_DOMAINS: dict[str, list[str]] = {
    "biology": ["protein", "gene", "cell", "dna", "rna", "genomic", "genome", "transcriptome", "proteome",
                "phylogenetic", "enzyme", "binding", "folding", "sequencing", "alignment"],
    "chemistry": ["molecule", "drug", "compound", "chemical", "molecular", "reaction", "synthesis",
                  "retrosynthesis", "property-prediction", "toxicity", "solubility"],
    "medical": ["medical", "clinical", "disease", "diagnosis", "pathology", "radiology", "histopathology", "ecg",
                "eeg", "survival", "patient", "healthcare", "cancer", "tumor", "lesion"],
    "physics": ["physics", "quantum", "particle", "cosmology", "astrophysics", "gravitational", "fluid", "dynamics",
                "simulation", "pde", "differential-equation"],
    "materials": ["material", "crystal", "alloy", "polymer", "semiconductor", "battery", "catalysis", "surface"],
    "neuroscience": ["brain", "neural", "neuroscience", "fmri", "neuroimaging", "connectome", "spike", "eeg"],
    "earth_science": ["climate", "weather", "earthquake", "seismic", "ocean", "atmosphere", "satellite",
                      "remote-sensing", "geospatial", "crop", "agriculture"],
    "astronomy": ["galaxy", "stellar", "exoplanet", "supernova", "telescope", "redshift", "cosmic"],
}

# ---- Fixed values: venues excluded (machine-learning venues) ----
EXCLUDE_VENUES = ["neurips", "nips", "icml", "iclr", "aaai", "ijcai", "uai", "aistats", "colt", "acl", "emnlp",
                  "naacl", "coling", "cvpr", "iccv", "eccv", "bmvc", "siggraph", "kdd", "www", "wsdm", "recsys",
                  "cikm", "icra", "iros", "corl", "mlsys", "osdi", "sosp"]

# ---- Fixed values: task keywords excluded ----
EXCLUDE_TASK_KEYWORDS = ["benchmark", "image-classification", "object-detection", "semantic-segmentation",
                         "image-generation", "text-generation", "language-model", "question-answering",
                         "machine-translation", "speech-recognition", "reinforcement-learning",
                         "representation-learning", "self-supervised", "contrastive-learning", "adversarial",
                         "neural-architecture", "pruning", "quantization", "distillation", "diffusion"]

# ---- Fixed values: library lists (order kept) ----
ML_IMPORTS = ["sklearn", "scikit-learn", "torch", "pytorch", "tensorflow", "keras", "xgboost", "lightgbm",
              "catboost", "jax", "optax", "flax"]
SCIENTIFIC_IMPORTS = ["numpy", "scipy", "pandas", "matplotlib", "seaborn", "statsmodels", "biopython", "rdkit",
                      "pymatgen", "ase", "mdtraj", "nibabel", "nilearn", "mne"]
# a listed package name → the module name it is imported as
IMPORT_ALIASES = {"scikit-learn": "sklearn"}

# ---- Fixed values: file exclusions ----
EXCLUDE_FILES = ["setup.py", "setup.cfg", "conftest.py", "__init__.py", "_version.py", "version.py", "conf.py",
                 "manage.py"]
EXCLUDE_PATTERNS = ["test_*.py", "*_test.py", "tests/*.py", "test/*.py", "docs/*.py", "examples/*.py",
                    "benchmarks/*.py"]

# ---- Fixed values: size gates ----
MIN_FILE_SIZE_BYTES = 500
MAX_FILE_SIZE_BYTES = 500_000
MIN_LINES = 20

# ---- Fixed values: keyword prefilter (loose: any occurrence, lower-cased) ----
ML_IMPORT_KEYWORDS = ["sklearn", "torch", "tensorflow", "keras", "xgboost", "lightgbm", "catboost", "pandas",
                      "numpy", "train_test_split", "cross_val", "fit", "predict", "model", "classifier",
                      "regressor", "neural", "dataset", "dataloader"]

# ---- Fixed values: hints that give an example's expected answer away (T4), with their descriptions ----
INTENT_HINTS: list[tuple[str, str, str]] = [
    ("hint00", r'''"""[^"]*\b(bug|buggy|issue|problem|incorrect|wrong|broken|bad|leaky|leak|flaw|defect)\b[^"]*"""''', "Docstring hints at bug"),
    ("hint01", r"""'''[^']*\b(bug|buggy|issue|problem|incorrect|wrong|broken|bad|leaky|leak|flaw|defect)\b[^']*'''""", "Docstring hints at bug"),
    ("hint02", r'''"""[^"]*(correct|fixed|proper)\s+\w*\s*(implementation|version|approach|code|way|method)[^"]*"""''', "Docstring hints at correctness"),
    ("hint03", r"""'''[^']*(correct|fixed|proper)\s+\w*\s*(implementation|version|approach|code|way|method)[^']*'''""", "Docstring hints at correctness"),
    ("hint04", r"\bdef\s+(buggy_|incorrect_|wrong_|broken_|bad_|leaky_)", "Function name hints at bug"),
    ("hint05", r"\bdef\s+(correct_|fixed_|proper_|safe_|good_)", "Function name hints at correctness"),
    ("hint06", r"\bclass\s+(Buggy|Incorrect|Wrong|Broken|Bad|Leaky)", "Class name hints at bug"),
    ("hint07", r"\bclass\s+(Correct|Fixed|Proper|Safe|Good)", "Class name hints at correctness"),
    ("hint08", r"\b(buggy|incorrect|wrong|broken|bad|leaky)_(function|method|class|data|model|scaler)\s*=", "Variable name hints at bug"),
    ("hint09", r"\b(correct|fixed|proper|safe|good)_(function|method|class|data|model|scaler)\s*=", "Variable name hints at correctness"),
]

# Demo lists for the registered queries: words that occur in the driver's invented prose.
DEMO_DOMAINS: dict[str, list[str]] = {
    "english": [" the ", " and "],
    "french": [" pour ", " les "],
    "german": [" und ", " der "],
    "spanish": [" los ", " que "],
}
DEMO_KEYWORDS = ["license", "token", "mail", "the", "und"]
DEMO_HINTS: list[tuple[str, str, str]] = [
    ("email", r"[A-Za-z0-9._]+@[A-Za-z0-9.]+\.[a-z]+", "personal e-mail address"),
    ("phone", r"[0-9]{3}-[0-9]{4}", "phone number"),
    ("secret", r"token = \"[0-9a-f]{16,}", "hard-coded secret"),
    ("license", r"(MIT|Apache) License", "license line"),
]
