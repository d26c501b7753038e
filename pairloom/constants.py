"""Names, seeds and layouts shared by the whole package."""

# Language codes, model names, dataset names, seeds, sizes,
# sample and batch defaults that results depend on.
LANGUAGES = ["en", "es", "ko", "zh", "ja", "jv", "te", "ar", "tr", "yo", "vi"]
TARGET_LANGUAGES = ["te", "zh", "es", "ar", "ja", "jv", "ko", "vi", "tr", "yo"]
GRID_LANGUAGE_SETS = ["es", "ko", "zh", "ja", "jv", "te", "ar", "tr", "yo", "vi", "all"]
DATASETS = ["mrpc", "tpc", "quora"]
MODELS = ["bert", "xlnet", "roberta", "albert"]
SCORING_BATCH = {"bert": 32, "xlnet": 16, "roberta": 32, "albert": 32}
SPLIT_SEED = 123
TEST_FRACTION = 0.2
SAMPLE_SIZE = 100
TRANSLATION_BATCH = 50
MAX_TOKENS = 128
LABELS = [0, 1]
METRICS = [
    "accuracy",
    "macro_f1_score",
    "weighted_f1_score",
    "f1_score",
    "precision_score",
    "recall_score",
    "ROC-AUC",
]

# Cell texts that mean "missing" in a CSV file.
NA_WORDS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "n/a",
    "nan",
    "null",
]

# Code, English name, family and branch of each language.
LANGUAGE_FAMILIES = [
    ("en", "English", "Indo-European", "Germanic"),
    ("es", "Spanish", "Indo-European", "Romance"),
    ("ko", "Korean", "Koreanic", "Korean"),
    ("zh", "Chinese", "Sino-Tibetan", "Sinitic"),
    ("ja", "Japanese", "Japonic", "Japanese"),
    ("jv", "Javanese", "Austronesian", "Malayo-Polynesian"),
    ("te", "Telugu", "Dravidian", "South-Central"),
    ("ar", "Arabic", "Afro-Asiatic", "Semitic"),
    ("tr", "Turkish", "Turkic", "Oghuz"),
    ("yo", "Yoruba", "Niger-Congo", "Volta-Niger"),
    ("vi", "Vietnamese", "Austroasiatic", "Vietic"),
]

# Token ids that come before the words of a vocabulary.
SPECIAL_TOKENS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]"]
PAD_ID, UNK_ID, CLS_ID, SEP_ID = range(4)
