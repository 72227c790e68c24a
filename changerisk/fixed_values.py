"""Results are only right if these stay exactly as they are."""

from __future__ import annotations

# Column order of the commit table.
COMMIT_COLUMNS = (
    "commit_id",
    "project",
    "buggy",
    "fix",
    "year",
    "author_date",
    "la",
    "ld",
    "nf",
    "nd",
    "ns",
    "ent",
    "ndev",
    "age",
    "nuc",
    "aexp",
    "arexp",
    "asexp",
    "message",
    "diff",
)

# The twelve change metrics used as model features.
CHANGE_METRICS = (
    "la",
    "ld",
    "nf",
    "ns",
    "nd",
    "ent",
    "ndev",
    "age",
    "nuc",
    "aexp",
    "arexp",
    "asexp",
)

# Columns a commit table must have to be loaded.
REQUIRED_COLUMNS = ("commit_id", "author_date", "buggy", "project")

# A message holding one of these, in any case and inside any word, marks a fix.
FIX_KEYWORDS = ("fix", "bug", "error", "issue", "patch", "resolve", "hotfix")

# Source-file suffixes by language; labelling accepts two more for C and C++.
PYTHON_SUFFIXES = (".py",)
CPP_SUFFIXES = (".cpp", ".cc", ".hpp", ".h")
CPP_LABEL_SUFFIXES = (".cpp", ".cc", ".hpp", ".h", ".cxx", ".c")

# Limits that are part of the semantics.
FILES_PER_FIX = 21
COMMIT_ID_LENGTH = 40
RECENT_SECONDS = 365 * 24 * 3600

# Sampling and splitting.
FIRST_YEAR, LAST_YEAR = 2018, 2026
SAMPLE_ROWS = 10_000
SEED = 42
TRAIN_FRACTION = 0.8

# Embedding diagnostics and reduction.
CUMULATIVE_SHARES = (0.50, 0.80, 0.90, 0.95, 0.99)
CONCENTRATION_RANKS = (1, 5, 10, 25)
STRONG_CORRELATIONS = (0.30, 0.50, 0.70)
NEAR_ZERO = 0.01
HISTOGRAM_BINS = 50
PCA_COMPONENTS = 384
PCA_SWEEP = (768, 512, 384, 256)
VARIANCE_TO_KEEP = 0.99
TEXT_SEPARATOR = " [SEP] "

# Vocabulary of the reasoning attributes, and the order of the risk levels.
REASONING_VOCABULARY = {
    "intent": (
        "bug_fix",
        "feature_addition",
        "feature_modification",
        "refactoring",
        "performance_improvement",
        "documentation",
        "configuration_change",
        "test_update",
        "dependency_update",
    ),
    "change_type": (
        "control_flow",
        "data_manipulation",
        "api_change",
        "exception_handling",
        "ui_change",
        "database_change",
        "configuration_change",
        "test_change",
        "security_change",
    ),
    "complexity": ("low", "medium", "high"),
    "scope": ("single_line", "single_file", "multiple_files", "cross_module"),
    "test_impact": ("yes", "no"),
    "security_risk": ("yes", "no"),
}
RISK_LEVELS = ("low", "medium", "high", "critical")

# Feature sources and models of the seven experiments.
EXPERIMENTS = {
    1: (("metrics",), ("random_forest", "boosted_trees")),
    2: (("vectors",), ("random_forest", "boosted_trees")),
    3: (("reasoning",), ("random_forest", "boosted_trees")),
    4: (("metrics", "vectors"), ("random_forest", "boosted_trees")),
    5: (("metrics", "reasoning"), ("random_forest", "boosted_trees")),
    6: (("vectors", "reasoning"), ("random_forest", "boosted_trees")),
    7: (("metrics", "vectors", "reasoning"), ("random_forest", "boosted_trees", "boosted_trees_fine")),
}
