"""Word lists, patterns and numbers that results depend on."""

#: Abbreviations whose dots end no sentence.
ABBREVIATIONS = (
    "Mr", "Mrs", "Ms", "Dr", "Prof", "Sr", "Jr", "vs", "etc", "i.e", "e.g",
    "Fig", "Tab", "Eq", "Sec", "Ref", "No", "Vol", "pp", "al", "approx", "dept", "est",
    "Jan", "Feb", "Mar", "Apr", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec",
)
#: Abbreviations at the end of a part that a claim goes on after.
CLAIM_ABBREVIATIONS = ("Mr", "Mrs", "Ms", "Mx", "Dr", "Prof", "St", "vs", "Fig", "etc", "approx", "Eq", "Vol", "No", "pp", "al", "et")
SENTENCE_MORE_THAN = 12
REFERENCE_HEADINGS = ("references?", "bibliography", r"works\s+cited", "citations?", "acknowledgements?", "appendix")

CAPTION_BAND, CAPTION_LINES = 80.0, 3
COLUMN_BUCKETS, COLUMN_MARGIN, COLUMN_MIN_WORDS, COLUMN_DENSITY, COLUMN_REACH = 30, 2, 20, 6, 4
LINE_GAP, LINE_QUANTUM = 4.0, 2.0
DEFAULT_SIZE = 10.0

SIGMA, MAX_CHUNK_SENTENCES = 1.5, 8
RRF_K, DENSE_WEIGHT, BM25_WEIGHT, NEGATION_WEIGHT = 60, 0.60, 0.40, 0.25
BM25_K1, BM25_B, BM25_EPSILON, BM25_FLOOR = 1.5, 0.75, 0.25, 0.05
CANDIDATES, RERANK_CANDIDATES = 10, 20
VOTE_CHUNK, VOTE_SECTION, VOTE_TABLE, SECTION_SIMILARITY = 1.0, 1.5, 0.5, 0.45
TOP_K, ANSWER_TOP_K = 5, 8
WINDOW_SIMILARITY = 0.40
MMR_LAMBDA, MMR_BUDGET = 0.47, 15
CITE_THRESHOLD, CITE_CANDIDATES, KEYWORD_WEIGHT, DIVERSITY_ALPHA, HUB_LIMIT = 0.50, 20, 0.15, 0.5, 3
CONTEXT_CHARS = 800

NEGATION_TRIGGERS = (
    r"\bnot\b", r"\bno\b", r"\bnever\b", r"\bwithout\b", r"\bexcept\b", r"\bexclud", r"\bshall not\b", r"\bcannot\b",
    r"\bcan't\b", r"\bdon't\b", r"\bdoesn't\b", r"\bisn't\b", r"\baren't\b", r"\bwon't\b", r"\bwouldn't\b", r"\bshouldn't\b",
    r"\bprohibit", r"\bforbid", r"\bdisallow", r"\bimpermissible\b", r"\brestrict", r"\bunauthori[sz]ed\b", r"\bineligible\b",
)
NEGATION_MARKERS = (
    "shall", "not", "restricted", "prohibited", "forbidden", "disallowed", "excluded", "unauthorized", "must not", "cannot",
    "impermissible", "ineligible", "restriction", "limitation", "not permitted", "not allowed", "not required", "not applicable",
)
KEYWORD_STOPWORDS = (
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "are", "was", "were",
    "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "that",
    "this", "these", "those", "it", "its", "as", "not", "no", "so", "if", "than", "then", "also", "which", "who", "what", "when",
    "where", "how", "there", "their", "they", "we", "i", "you", "he", "she", "his", "her", "our", "your",
)
HIGHLIGHT_STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "i", "in", "is", "it", "of", "on", "or", "that", "the",
    "this", "to", "what", "which", "with",
)
