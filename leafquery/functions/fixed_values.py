"""Word lists, patterns, constants and formats.

Results are only comparable if these equal the published behaviour, so they are
written out as plain text in their natural order. Patterns use the common
``\\b``/``\\s``/``\\w`` notation; ``text.java_regex`` turns them into Java form.
"""

# --- levels -----------------------------------------------------------------
UNDERGRADUATE = "undergraduate"
POSTGRADUATE = "postgraduate"
SOURCE_LABELS = {"undergraduate": "UG Prospectus", "other": "PG Prospectus"}

PG_PATTERNS = [
    r"\bpostgrad\b", r"\bpostgraduate\b", r"\bmasters?\b", r"\bphd\b", r"\bph\.d\b",
    r"\bms\b", r"\bm\.e\.\b", r"\bm\.s\.\b", r"\bm\.c\.s\.\b", r"\bdoctorate\b",
    r"\bm\.engg\b", r"\bmem\b", r"\bm\.arch\b", r"\bmurp\b",
]
UG_PATTERNS = [
    r"\bundergrad\b", r"\bundergraduate\b", r"\bbs\b", r"\bb\.e\.\b",
    r"\bdae\b", r"\bintermediate\b", r"\bhsc\b", r"\bmatric\b",
]
# Open-ended variants: no closing word boundary on the two stems.
PG_PATTERNS_OPEN = [r"\bpostgrad"] + PG_PATTERNS[1:]
UG_PATTERNS_OPEN = [r"\bundergrad"] + UG_PATTERNS[2:]

# --- tokens -----------------------------------------------------------------
SYNONYMS = {
    "chairman": "chairperson",
    "chairwoman": "chairperson",
    "chair": "chairperson",
    "programme": "program",
    "laboratory": "lab",
    "dept": "department",
    "postgrad": "postgraduate",
    "pg": "postgraduate",
    "undergrad": "undergraduate",
    "ug": "undergraduate",
}

# --- document markup --------------------------------------------------------
PAGE_PATTERN = r"(?m)^##\s*Page\s*(\d+)"
HEADING_PATTERN = r"(?m)^(#{1,6})\s+(.+)$"
SEMESTER_PATTERN = r"(?i)semester\s*[-:=]?\s*(\d+)"
COURSE_PATTERN = r"\b[A-Z]{2,5}\s*-?\s*\d{2,4}\b"
FACULTY_PATTERN = r"(?i)(?:Faculty\s+of\s+|School\s+of\s+|College\s+of\s+)([^\n#]+)"
DEPARTMENT_PATTERN = r"(?i)(?:Department\s+of\s+|Dept\s*\.\s*of\s+)([^\n#]+)"
DEPARTMENT_PATTERN_STRICT = r"(?i)(?:Department\s+of\s+|Dept\s*\\.\s*of\s+)([^\n#]+)"
PROGRAM_PATTERN = (
    r"(?i)\b(Bachelor\s+of\s+[^\n#]+|Master\s+of\s+[^\n#]+|"
    r"BS\s+[^\n#]+|BE\s+[^\n#]+|MS\s+[^\n#]+|ME\s+[^\n#]+|"
    r"M\.?Phil\s+[^\n#]+|Ph\.?D\s+[^\n#]+)"
)
DESIGNATION_PATTERN = (
    r"(?i)\b(Chairperson|Chairman|Chairwoman|Co-?Chairperson|Dean|Director|"
    r"Coordinator|Advisor|Professor|Associate\s+Professor|"
    r"Assistant\s+Professor|Lecturer|Instructor|Faculty\s+Member)\b"
)
PERSON_PATTERN = r"(?i)(?:Prof\.?|Professor|Dr\.?|Engr\.?|Mr\.?|Mrs\.?|Ms\.?)\s+[A-Z][A-Za-z\.\s]+"
MARKUP_CHARS = "*:_#"

FACULTY_ROW_PATTERN = (
    r"(?i)(Chairperson|Chairman|Dean|Professor|Associate\s+Professor|"
    r"Assistant\s+Professor|Lecturer|Instructor)"
    r"\s*((?:Prof\.?|Professor|Dr\.?|Engr\.?)?[A-Z][A-Za-z.\s]{1,40})"
)
COURSE_ROW_PATTERN = (
    r"(?i)([A-Z]{2,5}\s*-?\s*\d{2,4}).{1,100}?(.{1,100}?).{1,50}?"
    r"(\d-\d-\d|NC-NC-NC|\d\s*\(\s*\d\s*,\s*\d\s*\))"
)
FEE_ROW_PATTERN = r"(?i)(.{1,100}?)(?:Rs\.?|PKR|Rupees|RS)\s*([0-9,]{1,20})"
# The same matches found without trying all splits of the free text: each look-ahead holds wherever the rest can match.
_CREDITS = r"(?:\d-\d-\d|NC-NC-NC|\d\s*\(\s*\d\s*,\s*\d\s*\))"
COURSE_ROW_SEARCH = (
    rf"(?i)([A-Z]{{2,5}}\s*-?\s*\d{{2,4}})(?=.{{3,250}}?{_CREDITS}).{{1,100}}?(?=.{{2,150}}?{_CREDITS})"
    rf"(.{{1,100}}?)(?=.{{1,50}}?{_CREDITS}).{{1,50}}?({_CREDITS})"
)
# What ends a match of FEE_ROW_PATTERN, and how many characters of the same line it has in front of that.
FEE_ROW_END = r"(?i)(?:Rs\.?|PKR|Rupees|RS)\s*[0-9,]{1,20}"
FEE_ROW_BEFORE = 100
# What any match of the row patterns contains.
FACULTY_ROW_NEEDS = r"(?i)Chair|Dean|Professor|Lecturer|Instructor"
COURSE_ROW_NEEDS = r"(?i)\d-\d-\d|NC-NC-NC|\d\s*\(\s*\d\s*,\s*\d\s*\)"
FEE_ROW_NEEDS = r"(?i)(?:Rs\.?|PKR|Rupees)\s*[0-9,]"

DOCUMENT_SECTIONS = {
    "faculty": ["faculty", "chairperson", "chairman", "dean", "professor", "lecturer", "faculty members", "staff"],
    "curriculum": ["curriculum", "course", "subjects", "semester", "credit", "scheme of study", "syllabus"],
    "fees": ["fee", "fees", "tuition", "admission charges", "dues", "payment", "challan", "hostel charges"],
    "eligibility": ["eligibility", "criteria", "requirements", "admission criteria"],
    "scholarships": ["scholarship", "financial aid", "assistance", "bursary"],
    "laboratories": ["laboratory", "lab", "facilities", "workshop"],
    "admission": ["admission", "apply", "application", "prospectus", "intake", "deadline", "merit",
                  "aggregate", "seat", "seats", "allocation", "quota"],
}
SECTION_SINGULAR = {"scholarships": "scholarship", "laboratories": "laboratory"}
FEE_TABLE_WORDS = ["fee", "tuition", "charges", "rs."]
TABLE_CONTENT_TYPES = ["curriculum_table", "fee_table", "table"]

# --- chunks -----------------------------------------------------------------
CHUNK_SIZE = 2000
CHUNK_OVERLAP = 300
CHUNK_SEPARATORS = ["\n\n", "\n", ". ", " ", ""]
EMBED_BATCH = 32
EMBED_DIMENSION = 384

# --- question understanding -------------------------------------------------
QUESTION_SECTIONS = {
    "faculty": [
        "faculty", "chairperson", "chairman", "co-chairperson", "co chairman",
        "dean", "director", "advisor", "coordinator", "professor",
        "associate professor", "assistant professor", "lecturer", "instructor",
    ],
    "curriculum": ["curriculum", "scheme of study", "semester", "course", "subjects", "credit hours"],
    "fees": ["fee", "fees", "tuition", "security", "challan", "dues"],
    "eligibility": ["eligibility", "eligible"],
    "admission": ["admission", "apply", "application", "merit", "aggregate", "seat", "seats", "allocation", "quota"],
    "scholarship": ["scholarship", "financial assistance"],
    "laboratory": ["lab", "laboratory"],
}
QUESTION_ENTITIES = {
    "chairperson": ["chairperson", "chairman", "head"],
    "co-chairperson": ["co-chairperson", "co chairman"],
    "dean": ["dean"],
    "director": ["director"],
    "professor": ["professor", "professors"],
    "associate professor": ["associate professor"],
    "assistant professor": ["assistant professor"],
    "lecturer": ["lecturer", "lecturers"],
    "course": ["course", "subject", "subjects"],
}
FEE_TYPES = ["tuition", "security", "admission", "hostel"]
QUESTION_SEMESTER_PATTERN = r"(?i)(?:semester\s*(\d+)|(\d+)(?:st|nd|rd|th)?\s*semester)"
QUESTION_COURSE_PATTERN = r"(?i)\b[A-Z]{2,5}\s*-?\s*\d{2,4}\b"
YEAR_PATTERN = r"(?i)\b(first|1st|second|2nd|third|3rd|fourth|4th|final)\s+year\b"
NUMBER_WORDS = {
    "first": 1, "one": 1, "second": 2, "two": 2, "third": 3, "three": 3,
    "fourth": 4, "four": 4, "fifth": 5, "five": 5, "sixth": 6, "six": 6,
    "seventh": 7, "seven": 7, "eighth": 8, "eight": 8, "ninth": 9, "nine": 9,
    "tenth": 10, "ten": 10, "eleventh": 11, "eleven": 11, "twelfth": 12, "twelve": 12,
}
GENERIC_FACULTY_NAMES = ["the", "faculty", "departments", "faculty members", "members"]
NUMBERING_PATTERN = r"^[0-9.\(i\)]+\s*"
DEGREE_PREFIX_PATTERN = r"^(bs|ms|bachelor of|master of|phd|m\.?s\.?|b\.?s\.?|b\.?e\.?)\s+"
MAX_NAME_CHARS = 80
MAX_DESIGNATION_CHARS = 50

# (name, section, dense k, sparse k, rerank k, section?, page?, table?, filter?)
STRATEGIES = [
    ("faculty", 10, 10, 10, True, True, False, True),
    ("curriculum", 10, 12, 10, True, False, True, True),
    ("fees", 10, 12, 10, True, False, True, True),
    ("eligibility", 8, 8, 8, False, False, False, True),
    ("admission", 10, 10, 8, False, False, False, True),
    ("scholarship", 8, 8, 8, True, False, False, True),
    ("laboratory", 8, 8, 8, True, False, False, True),
    ("person", 5, 5, 5, False, True, False, True),
    ("course", 3, 3, 3, False, False, True, True),
    ("semester_or_year", 5, 5, 5, True, False, True, True),
    ("default", 8, 8, 8, False, False, False, False),
]
AMBIGUOUS_RERANK_K = 16

# --- intent -----------------------------------------------------------------
SEAT_STRONG_WORDS = ["seat", "seats", "eats", "sats", "seates", "quota", "vacancy", "vacancies",
                     "allocation", "distribution", "matrix"]
RAG_WORDS = ["department", "dept", "fees", "fee", "eligibility", "eligible", "admission", "admissions",
             "program", "course", "syllabus", "curriculum", "merit", "aggregate"]
SEAT_KEYWORDS = ["seat", "seats", "eats", "quota", "intake", "capacity", "strength", "vacancy",
                 "vacancies", "batch size", "allocation", "distribution", "matrix"]
SEAT_PATTERNS = [r"how many.*students", r"how many.*seat", r"seat.*available", r"available.*seat",
                 r"total.*seat", r"seat.*matrix", r"seat.*distribution", r"intake", r"capacity", r"quota"]
SEAT_WEIGHTS = (0.25, 0.25, 0.50)
SEAT_THRESHOLD = 0.72
GENERAL_THRESHOLD = 0.82
IDENTITY_PATTERNS = [
    r"\bwho\b.*\bare\s+you\b",
    r"\bwhat\s+are\s+you\b",
    r"\bwhat\s+is\s+your\s+name\b",
    r"\bintroduce\s+yourself\b",
    r"\btell\s+me\s+about\s+yourself\b",
]

# --- rewriting --------------------------------------------------------------
CONTEXTUAL_WORDS = [
    "it", "its", "they", "them", "that", "those", "this", "these",
    "he", "she", "his", "her", "same", "above", "previous",
    "earlier", "former", "latter", "him", "himself", "herself", "themselves",
]
CONTINUATION_WORDS = [
    "fee", "fees", "eligibility", "criteria", "requirements", "dean",
    "syllabus", "courses", "duration", "seats", "seat", "apply",
    "admission", "admissions", "cutoff", "merit",
    "electronic", "electronics", "computer", "software", "mechanical",
    "electrical", "civil", "petroleum", "telecommunication", "telecommunications",
    "biomedical", "industrial", "manufacturing", "textile", "architecture",
    "automotive", "marine", "materials", "metallurgical", "chemical", "polymer",
    "math", "mathematics", "physics", "chemistry", "english", "linguistics",
    "economics", "finance", "environmental", "earthquake", "coastal", "urban",
    "chairperson", "chairman", "chairwoman", "chair",
]
FOLLOWUP_PREFIXES = ["what about", "how about", "what of", "how of", "what for", "how for",
                     "and ", "also ", "then ", "but "]
REWRITE_PREFIX_PATTERN = r"(?i)^rewritten query:\s*"

# --- history ----------------------------------------------------------------
ASSISTANT_CHARS = 250
TRUNCATION_MARK = "... [truncated]"
PROMPT_TURNS = 10
REWRITE_TURNS = 6
LOOKBACK_TURNS = 4

# --- retrieval --------------------------------------------------------------
BM25_K1 = 1.5
BM25_B = 0.75
RRF_CONSTANT = 50.0
RRF_LIMIT = 30
SIGNATURE_CHARS = 100
RERANK_WEIGHTS = {"rrf": 0.55, "jaccard": 0.25}
RERANK_BOOSTS = {"term": 0.10, "department": 0.08, "program": 0.08, "section": 0.10,
                 "heading": 0.05, "year": 0.10, "entity": 0.10}
SPECIAL_TERM_PATTERN = r"\b[A-Z0-9\-]{2,15}\b"
CODE_TERM_PATTERN = r"\b[a-zA-Z]{2,5}\s*-?\s*\d{2,4}\b"
YEAR_SYNONYMS = {
    "first": ["first", "1st"], "1st": ["first", "1st"],
    "second": ["second", "2nd"], "2nd": ["second", "2nd"],
    "third": ["third", "3rd"], "3rd": ["third", "3rd"],
    "fourth": ["fourth", "4th", "final"], "4th": ["fourth", "4th", "final"],
    "final": ["fourth", "4th", "final"],
}
CONTEXT_CHARS = 12000
CONTEXT_PER_SECTION = 6
CONTEXT_SEPARATOR = "\n---\n"
FLAT_CONTEXT_SEPARATOR = "\n---\n\n"
SECTION_ORDER = ["faculty", "fees", "curriculum", "eligibility", "admission",
                 "laboratory", "scholarship", "research", "general"]
LAST_PAGE = 9999
CONFIDENCE_TOP = 5
CONFIDENCE_THRESHOLD = 0.45

# --- reuse ------------------------------------------------------------------
CACHE_LIMIT = 512
SEMANTIC_THRESHOLD = 0.88
SEMANTIC_THRESHOLD_LOOSE = 0.82

# --- sources ----------------------------------------------------------------
SCAN_SAMPLE_PAGES = 5
SCAN_THRESHOLD_CHARS = 15
IDLE_STATUS = "idle"
