"""Constants that define the semantics of the graph and of retrieval. Fixed values."""

CHUNK_WORDS, CHUNK_STRIDE, CHUNK_LEAST_CHARS = 120, 100, 10
ENTITY_TYPES = ["PERSON", "ORG", "GPE", "EVENT", "NORP", "FAC", "LOC"]
HINT_TYPES = ["PERSON", "ORG", "GPE", "EVENT", "NORP"]
MOST_ENTITIES, ENTITY_CHARS = 150, 200
MOST_KEYWORDS, KEYWORD_CHARS = 30, 200
DIM = 64
NEIGHBOURS = 10
COSINE_WEIGHT, ENTITY_WEIGHT, KEYWORD_WEIGHT = 0.60, 0.25, 0.15
PRUNE_PERCENTILE = 0.85
FALLBACK_THRESHOLD = 0.55
EDGE_PRIORITY = {"PERSON": 5, "EVENT": 4, "NORP": 3, "ORG": 2, "GPE": 1}
INTENT_WEIGHTS = {"PERSON": 1.4, "ORG": 1.4, "GPE": 1.3, "EVENT": 1.3, "NORP": 1.2}
SIGNALS_PER_TYPE = 50
SEEDS = 5
HOP2_FROM = 10
RERANK_TOP = 25
HOP2_FACTOR = 0.75
KEYWORD_BOOST = 0.3
ENTITIES_TRIED, PAGES_ADDED = 15, 5
ALL_ENTITIES = 30
GENERATED_KEYWORDS = 8
