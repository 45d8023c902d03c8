"""Fixed values that results depend on: word lists, mappings, patterns, weights and limits."""

# Raw relation -> canonical relation.
RELATION_GROUPS = {
    "is_a": "is is_a is_a_type_of type_of kind_of instance_of classified_as",
    "has": "has have having possesses",
    "part_of": "part_of is_part_of belongs_to component_of",
    "contains": "contains includes consists_of comprises",
    "uses": "uses use using utilizes utilises employs",
    "used_for": "used_for used_to serves_as serves_for",
    "provides": "provides provide offers supplies delivers",
    "supports": "supports support helps assists enables",
    "depends_on": "depends_on depends_upon relies_on reliant_on requires",
    "integrates_with": "integrates_with integrates",
    "developed_by": "developed_by built_by engineered_by",
    "created_by": "created_by designed_by authored_by written_by",
    "owned_by": "owned_by property_of",
    "works_for": "works_for works_at employed_by employee_of",
    "located_in": "located_in located_at situated_in based_in found_in",
    "founded_by": "founded_by established_by started_by",
    "founded_in": "founded_in established_in started_in",
    "acquired": "acquired acquire acquires bought buy purchased purchase",
    "causes": "causes cause leads_to results_in",
    "produces": "produces",
    "prevents": "prevents prevent avoids protects_against",
    "treats": "treats treat used_to_treat helps_treat",
    "manufactures": "manufactures manufacture makes",
    "stores": "stores",
    "retrieves_from": "retrieves_from",
    "renders": "renders",
    "displays": "displays",
    "extracts": "extracts",
    "preserves": "preserves",
    "extends": "extends",
    "combines": "combine combines combined_with",
    "associated_with": "associated_with associated linked_to connected_with",
    "related_to": "related_to relates_to related relevant_to",
}
RELATION_MAP = {raw: canonical for canonical, raws in RELATION_GROUPS.items() for raw in raws.split()}

# Words that make a relation a sentence.
FORBIDDEN_WORDS = "the this that which because when where while and or with from".split()

# Generic heads of entity names.
GENERIC_TERMS = (
    "model system framework library tool method technology platform database language service application"
    " algorithm process software hardware device program module component technique approach"
).split()

# Words left out of query and text tokens.
STOPWORDS = (
    "the a an is are was were be been being what how why when where which does do did can could would should"
    " of to in on for with from by and or than this that these those under over into through using"
).split()

# Edge types about publications, and edge types that say little.
METADATA_RELATIONS = "PUBLISHED_BY PUBLISHED_IN AUTHORED_BY AUTHORED WRITTEN_BY CREATED_BY".split()
GENERIC_RELATIONS = "RELATED_TO ASSOCIATED_WITH CONNECTED_TO".split()

# Words of questions about quantities.
MEASUREMENT_TERMS = (
    "minimum maximum concentration amount value rate limit threshold measurement detected detection sensitivity"
    " percentage percent ratio quantity level intensity temperature pressure time duration power frequency size"
).split()

# What names of publications contain.
METADATA_MARKS = ["doi:", "volume ", "vol.", "journal", "conference", "proceedings", "paper", "article", "published", "isbn"]

# A number and a unit.
VALUE_PATTERNS = [
    r"\b\d+(?:\.\d+)?\s*%",
    r"\b\d+(?:\.\d+)?\s*(?:nm|um|mm|cm|m)\b",
    r"\b\d+(?:\.\d+)?\s*(?:mw|kw|w)\b",
    r"\b\d+(?:\.\d+)?\s*(?:hz|khz|mhz|ghz)\b",
    r"\b\d+(?:\.\d+)?\s*(?:ms|us|s|min|sec)\b",
]

# A long name and its short form.
ALIAS_IN_PARENTHESES = r"([A-Za-z][A-Za-z0-9 .+\-/]{3,120}?)\s*\(([A-Z][A-Z0-9\-]{1,20})\)"
ALIAS_ABBREVIATED = r"(?i)([A-Za-z][A-Za-z0-9 .+\-/]{3,120}?)\s*,?\s*(?:commonly\s+)?abbreviated\s+as\s+([A-Za-z][A-Za-z0-9.+\-/]{1,20})"

# Errors that mean "slow down".
RATE_LIMIT_MARKS = ["429", "resource_exhausted", "rate limit", "rate_limit", "quota", "too many requests"]

# Phrases of answers that found nothing.
SUSPICIOUS_PHRASES = [
    "insufficient evidence",
    "insufficient information",
    "not enough information",
    "not enough evidence",
    "cannot determine",
    "can't determine",
    "cannot be determined",
    "can't be determined",
    "not mentioned",
    "not provided",
    "does not contain information",
    "do not contain information",
    "no information",
    "unable to answer",
    "unable to determine",
]

# Sizes, thresholds and counts.
CHUNK_SIZE, CHUNK_OVERLAP = 2500, 300
SEPARATORS = ["\n\n", "\n", ". ", "! ", "? ", " ", ""]
CACHE_VERSION = 3
RELATION_MATCH = 0.82
MAX_RELATION_LENGTH, MAX_RELATION_PARTS = 50, 5
CANDIDATES, CANDIDATE_SIMILARITY = 6, 0.72
TOP_CHUNKS, NEIGHBOUR_HITS, NEIGHBOUR_RADIUS = 5, 3, 1
VECTOR_ENTITIES, LEXICAL_ENTITIES, SEEDS_EACH = 10, 40, 6
MAX_HOPS, MAX_PATHS, RERANK_FACTOR, RERANK_LEAST = 3, 1000, 8, 40
CONTEXT_LIMIT, NEIGHBOUR_LIMIT, GRAPH_LIMIT, EVIDENCE_LIMIT = 2500, 1200, 1200, 1800
PLAIN_CONTEXT_LIMIT = 3500
MAX_UPLOAD = 50 << 20

# Fixed value: texts that an embedding model is given at a time.
EMBED_BATCH = 32
