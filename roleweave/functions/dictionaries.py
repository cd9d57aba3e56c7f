"""Fixed values.

Everything in this module is a value that must be equal to the behaviour being
reproduced (word lists, regex patterns, weights, limits).  They are kept here,
together and in their original order, and every operator takes them as
arguments defaulting to these values.
"""

# --------------------------------------------------------------------------
# FIXED VALUES — technical skills dictionary ("redis" appears twice in the
# original list; it is a set, so 172 distinct words)
# --------------------------------------------------------------------------
TECHNICAL_SKILLS = (
    # Programming Languages
    "python", "java", "javascript", "typescript", "c++", "c#", "go", "golang",
    "rust", "ruby", "php", "swift", "kotlin", "scala", "r", "matlab", "perl",
    "dart", "lua", "haskell", "elixir", "clojure", "groovy", "objective-c", "shell", "bash",
    # Web Frameworks & Libraries
    "django", "flask", "fastapi", "spring boot", "springboot", "spring", "react", "react.js", "angular",
    "vue", "vue.js", "next.js", "nextjs", "node.js", "nodejs", "express",
    "express.js", "rails", "ruby on rails", "laravel", "asp.net", ".net",
    "svelte", "nuxt", "gatsby", "remix", "redux", "graphql", "jquery", "tailwind", "bootstrap",
    # Data, ML, & AI
    "machine learning", "deep learning", "tensorflow", "pytorch", "keras",
    "scikit-learn", "pandas", "numpy", "nlp", "natural language processing",
    "computer vision", "opencv", "data science", "data analysis", "data engineering",
    "spark", "pyspark", "hadoop", "airflow", "mlops", "llm", "generative ai",
    "langchain", "hugging face", "transformers", "openai", "pinecone", "milvus", "qdrant",
    # Cloud & DevOps
    "aws", "amazon web services", "azure", "gcp", "google cloud", "docker", "kubernetes", "k8s",
    "terraform", "ansible", "jenkins", "ci/cd", "github actions", "gitlab ci",
    "cloudformation", "helm", "prometheus", "grafana", "datadog", "nginx", "apache",
    # Databases
    "sql", "mysql", "postgresql", "postgres", "mongodb", "redis", "elasticsearch",
    "cassandra", "dynamodb", "oracle", "sqlite", "neo4j", "firebase", "supabase",
    "mariadb", "cockroachdb", "snowflake", "bigquery", "redshift", "weaviate",
    # Tools & Platforms
    "git", "github", "gitlab", "bitbucket", "jira", "confluence", "linux",
    "unix", "rest", "rest api", "grpc", "microservices", "kafka",
    "rabbitmq", "celery", "redis", "websocket", "postman", "swagger", "oauth", "jwt",
    # Mobile
    "android", "ios", "react native", "flutter", "swiftui", "xamarin",
    # Practices
    "agile", "scrum", "devops", "sre", "system design", "api design", "test driven development", "tdd",
    "selenium", "cypress", "playwright", "jest", "pytest", "junit", "mocha",
    "power bi", "tableau", "looker", "figma",
)

# --------------------------------------------------------------------------
# FIXED VALUES — education patterns (Python regex syntax; each is wrapped in
# word boundaries and matched case-insensitively)
# --------------------------------------------------------------------------
EDUCATION_PATTERNS = (
    r"b\.?tech", r"m\.?tech", r"b\.?e\.?", r"m\.?e\.?", r"b\.?sc", r"m\.?sc",
    r"b\.?ca", r"m\.?ca", r"mba", r"ph\.?d", r"bachelor", r"master", r"diploma",
    r"b\.?com", r"m\.?com", r"bba", r"pgdm", r"associate degree", r"high school",
    r"computer science", r"information technology", r"electronics",
    r"electrical engineering", r"mechanical engineering", r"university", r"institute", r"college",
)

# institution line: a whole line holding one of these words (word-bounded, any case)
INSTITUTION_WORDS = ("university", "college", "institute", "academy", "school of")
INSTITUTION_LINE_MAX_CHARS = 60  # lines of this length or more are paragraphs, not names

# --------------------------------------------------------------------------
# FIXED VALUES — job-title patterns (same wrapping as education patterns)
# --------------------------------------------------------------------------
JOB_TITLE_PATTERNS = (
    r"java\s+(?:developer|engineer|architect)",
    r"(?:senior|junior|lead|staff|principal)\s+java\s+(?:developer|engineer|architect)",
    r"software\s+(?:engineer|developer)",
    r"(?:senior|junior|lead|staff|principal)\s+(?:software\s+)?(?:engineer|developer)",
    r"back[\s-]?end\s+(?:developer|engineer)",
    r"data\s+(?:scientist|engineer|analyst)",
    r"ml\s+engineer",
    r"machine\s+learning\s+engineer",
    r"devops\s+engineer",
    r"cloud\s+engineer",
    r"sre|site\s+reliability\s+engineer",
    r"product\s+manager",
    r"project\s+manager",
    r"technical\s+lead",
    r"team\s+lead",
    r"architect",
    r"(?:qa|test)\s+(?:engineer|analyst|lead)",
    r"business\s+analyst",
    r"system\s+administrator",
    r"database\s+administrator",
    r"network\s+engineer",
    r"cyber\s*security\s+(?:analyst|engineer)",
    r"data\s+science\s+manager",
    r"engineering\s+manager",
    r"vp\s+of\s+engineering",
    r"chief\s+technology\s+officer",
    r"cto",
)

# --------------------------------------------------------------------------
# FIXED VALUES — contact patterns
# --------------------------------------------------------------------------
EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,7}\b"
PHONE_CANDIDATE_PATTERN = r"\+?[\d\s\-\(\)]{10,20}"
PHONE_MIN_DIGITS = 10
LINK_PATTERN = (
    r"(?:(?:https?|ftp):\/\/)?(?:www\.)?[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b"
    r"(?:[-a-zA-Z0-9()@:%_\+.~#?&//=]*)"
)
LINK_KEEP_WORDS = ("linkedin.com", "github.com", "gitlab.com", "portfolio")
LINK_TRAILING_PUNCT = r"[.)\]}]+$"

# --------------------------------------------------------------------------
# FIXED VALUES — experience-years extraction from résumé text
# --------------------------------------------------------------------------
MONTHS_PATTERN = (
    r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?"
    r"|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)
DATE_RANGE_PATTERN = rf"{MONTHS_PATTERN}\s*(?:'?\d{{2,4}})\s*(?:-|to|–|—|)\s*(?:{MONTHS_PATTERN}\s*(?:'?\d{{2,4}})|present|current|now|date)"
DATE_RANGE_OPEN_PATTERN = r"present|current|now|date"
YEAR_PATTERN = r"\b(199\d|20\d{2})\b"
STATED_YEARS_PATTERNS = (
    r"(\d+)\+?\s*(?:years?|yrs?)\s+(?:of\s+)?experience",
    r"experience\s*[:\-]?\s*(\d+)\+?\s*(?:years?|yrs?)",
    r"(\d+)\+?\s*(?:years?|yrs?)\s+in\s+",
)

# --------------------------------------------------------------------------
# FIXED VALUES — profile summary
# --------------------------------------------------------------------------
SUMMARY_LABELS = ("Job Titles: ", "Skills: ", "Education: ")
EMPTY_RESUME_TEXT = "[Could not extract text]"

# --------------------------------------------------------------------------
# FIXED VALUES — location gate
# --------------------------------------------------------------------------
REGION_WORDS = (
    "india", "bangalore", "bengaluru", "hyderabad", "pune", "mumbai",
    "delhi", "noida", "gurgaon", "gurugram", "chennai", "kolkata",
    "ahmedabad", "jaipur", "chandigarh", "lucknow", "indore", "kochi",
    "thiruvananthapuram", "mysore", "coimbatore", "nagpur", "remote",
)
FOREIGN_WORDS = (
    "usa", "uk", "us", "united states", "united kingdom", "london", "texas", "tx", "austin",
    "california", "ca", "new york", "ny", "romania", "bucharest", "canada", "toronto",
    "singapore", "dubai", "uae", "australia", "sydney", "melbourne", "europe", "poland",
    "germany", "berlin", "munich", "france", "paris", "ireland", "dublin", "philippines",
    "manila", "malaysia", "kuala lumpur", "mexico", "brazil", "japan", "china", "vietnam",
    "thailand", "indonesia", "jakarta", "amsterdam", "netherlands", "dutch", "spain", "italy",
    "sweden", "switzerland", "south africa", "new zealand", "atlanta", "chicago", "seattle",
    "boston", "san francisco", "dallas", "houston", "miami", "florida", "fl", "washington", "dc",
)
FALLBACK_PLACES = ("remote", "pan india", "anywhere", "india")
EXCLUDED_CITIES = ("bangalore", "pune", "chennai", "hyderabad", "gurgaon")
HOME_REGION = "india"  # the target that switches on the region-word test

# per-site region words (company sites) and extra keep clauses
BIG4_REGION_WORDS = (
    "india", "bangalore", "bengaluru", "hyderabad", "pune", "mumbai",
    "delhi", "noida", "gurgaon", "gurugram", "chennai", "kolkata",
    "ahmedabad", "jaipur", "chandigarh", "kochi", "thiruvananthapuram",
)
IT_REGION_WORDS = (
    "india", "bangalore", "bengaluru", "hyderabad", "pune", "mumbai",
    "delhi", "noida", "gurgaon", "gurugram", "chennai", "kolkata",
    "ahmedabad", "jaipur", "chandigarh", "kochi", "thiruvananthapuram", "mysore", "trivandrum",
)

# --------------------------------------------------------------------------
# FIXED VALUES — recency gate, digest
# --------------------------------------------------------------------------
MAX_AGE_DAYS = {"naukri": 2}
DEFAULT_MAX_AGE_DAYS = 10
MISSING_DATE_AGE_SECONDS = 86400
FRESH_SECONDS = 86400
COMPANY_CAP = 2
DIGEST_SIZE = 30
# newest postings that are matched first, to bound how old a digest's rows can be
CUTOFF_POSTINGS = 20_000
UNKNOWN_COMPANY = "unknown"
LISTING_PAGE_SIZE = 20
JSON_LISTING_SIZE = 100
SNIPPET_CHARS = 200
TITLE_MAX_CHARS = 200
BADGE_HIGH, BADGE_MID = 70, 40

# --------------------------------------------------------------------------
# FIXED VALUES — scoring
# --------------------------------------------------------------------------
MATCH_THRESHOLD = 0.35          # configured default
SKILL_WEIGHT = 0.03             # per distinct matched skill
SKILL_CAP = 0.30
TITLE_WEIGHT = 0.15
ALIGN_WORDS = ("java", "backend")
ALIGN_WEIGHT = 0.10
ALIGN_REASON = "High Profile Alignment (Java/Backend)"
PREFERRED_PLACE = "mumbai"
PLACE_WEIGHT = 0.05
PLACE_REASON = "Location Preference (Mumbai)"
EXP_IN_RANGE = 0.20
EXP_MEETS_MIN = 0.10
EXP_SHORT_BIG = -0.50           # short by >= 2 years
EXP_SHORT_SMALL = -0.15         # short by 1 year
EXP_OPEN_MAX = 99               # "no upper bound" sentinel
EXP_KEEP_MAX_MIN = 4            # postings asking more than this minimum are dropped
EXP_KEEP_MIN_MAX = 1            # postings whose maximum is below this are dropped
REASON_SKILLS_SHOWN = 5
REASON_TITLES_SHOWN = 3
CONTENT_REASON = "Content similarity"

# TF-IDF
MAX_FEATURES = 5000
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"  # maximal runs of >= 2 word characters

# search keyword from the profile
KEYWORD_NEEDLE = "java"
KEYWORD_FALLBACK = "Java Developer"

# --------------------------------------------------------------------------
# FIXED VALUES — career-page link harvest
# --------------------------------------------------------------------------
JOB_URL_PATTERNS = (
    r"/jobs?/",
    r"/careers?/",
    r"/openings?/",
    r"/positions?/",
    r"/vacancies?/",
    r"/opportunities?/",
    r"/apply/",
    r"lever\.co/",
    r"greenhouse\.io/",
    r"workday\.com/",
    r"ashbyhq\.com/",
    r"boards\.greenhouse/",
    r"jobs\.smartrecruiters/",
)
JOB_LINK_WORDS = (
    "engineer", "developer", "manager", "analyst", "designer", "lead",
    "architect", "scientist", "specialist", "coordinator", "intern",
    "associate", "consultant", "director", "administrator", "devops",
    "sre", "qa", "tester", "frontend", "backend", "fullstack",
    "full-stack", "full stack", "data", "cloud", "security", "product",
    "technical", "software", "web", "mobile", "android", "ios",
)
LINK_TEXT_MIN_CHARS = 3
LINK_WORDS_MIN_TEXT = 5          # link-word test needs more than this many chars
KEYWORD_TOKEN_MIN_CHARS = 3      # keyword tokens of this length or less are ignored
CAREER_PAGE_LOCATION = "India"

# --------------------------------------------------------------------------
# FIXED VALUES — search-API sources
# --------------------------------------------------------------------------
SEARCH_EXCLUSIONS = ("news", "article", "blog", "usa", "uk", "romania", "london", "texas", "tx",
                     "canada", "australia", "europe")
SEARCH_SITE_OPERATORS = "(job OR jobs OR careers OR hiring)"
SECOND_LEVEL_LABELS = ("co", "com", "ac", "net", "org")
DOMAIN_OVERRIDES = {"tcsapps.com": "tcs.com"}
FULL_HOST_DOMAINS = ("oraclecloud.com",)
COMPANY_NAME_OVERRIDES = (("Wipro", "Wipro"), ("Infosys", "Infosys"), ("Tcs", "TCS"),
                          ("Accenture", "Accenture"), ("Capgemini", "Capgemini"))
