"""Word lists, vocabularies and patterns that results depend on."""

# Danish stop / function words.
STOP_WORDS = (
    "af", "at", "de", "den", "der", "det", "du", "en", "er", "et", "for", "fra", "han", "har",
    "hun", "i", "ikke", "jeg", "kan", "med", "men", "og", "om", "på", "som", "til", "var", "vi",
)
ADPOSITIONS = ("af", "for", "fra", "i", "med", "om", "på", "til")
NEGATIONS = ("ikke", "aldrig", "ingen", "intet")
PRONOUNS = ("jeg", "du", "han", "hun", "vi", "de")
COORDINATORS = ("og", "eller", "men")
SUBORDINATORS = ("at", "som", "fordi", "hvis")
VERB_SUFFIXES = ("ede", "te", "er")
NOUN_SUFFIXES = ("hed", "ing", "else", "tion")

# Orthographic vowels and capitals.
VOWELS = "aeiouyæøåAEIOUYÆØÅ"
CAPITALS = "A-ZÆØÅ"

# Label vocabularies.
POSITIVE_LABELS = ("1", "true", "yes", "y", "dyslexia", "dyslexic", "dyslexia_labeled")
NEGATIVE_LABELS = ("0", "false", "no", "n", "control", "typical", "non-dyslexic")
READER_GROUPS = ("dyslexia_labeled", "typical_control", "uncertain")
PROVENANCES = (
    "formal_diagnosis", "self_report", "screening_result", "project_metadata", "unknown", "not_available",
)
CONFIDENCES = ("high", "medium", "low", "unknown")

# Boundary types with their opacity score and class.
BOUNDARY_SCORES = {"C#C": 0, "C#V": 1, "V#C": 2, "V#V": 3}
BOUNDARY_CLASSES = {
    "C#C": "low", "C#V": "medium_low", "V#C": "medium_high", "V#V": "high", "other": "other", "unknown": "unknown",
}
BOUNDARY_VOCOIDS = {"C#C": 0, "C#V": 1, "V#C": 1, "V#V": 2}

# Thresholds.
LONG_WORD_CHARS = 7
COMPOUND_CHARS = 12
LOGIT_CLIP = 1e-6
DEFAULT_EXCLUDED_PARTICIPANTS = ("P14",)
DEFAULT_EXCLUDED_TEXTS = ("1327",)
