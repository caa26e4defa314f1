"""Results depend on them, so they are stated plainly and in one place."""

# Entity aliases, matched on their normalised form.
ENTITY_ALIASES = {
    "питон": "Python",
    "python разработчик": "Python",
    "python разработчики": "Python",
    "кубернетес": "Kubernetes",
    "кафка": "Kafka",
    "линукс": "Linux",
    "mts": "МТС",
    "мтс": "МТС",
    "amazon web service": "Amazon Web Services",
    "amazon web services": "Amazon Web Services",
    "aws": "Amazon Web Services",
    "gcp": "Google Cloud Platform",
    "gnn": "Graph Neural Networks",
    "google cloud": "Google Cloud Platform",
    "google cloud platform": "Google Cloud Platform",
    "k8s": "Kubernetes",
    "kubernetes": "Kubernetes",
    "postgres": "PostgreSQL",
    "postgre sql": "PostgreSQL",
    "postgresql": "PostgreSQL",
}

# Names whose punctuation carries meaning, replaced in this order.
SPECIAL_NAMES = ((".net", "dotnet"), ("c#", "csharp"), ("c++", "cpp"))

# Phrases that mark a document as carrying instructions.
UNSAFE_MARKERS = (
    "ignore previous instructions",
    "ignore all instructions",
    "system message",
    "developer message",
    "you are chatgpt",
    "reveal your prompt",
    "follow these instructions",
)

# City spellings -> normalised city, used for grounding.
GROUNDING_CITY_ALIASES = {
    "мск": "москва",
    "масква": "москва",
    "московия": "москва",
    "московском": "москва",
    "moscow": "москва",
    "спб": "санкт петербург",
    "питер": "санкт петербург",
    "петербург": "санкт петербург",
}

# Company spellings -> normalised company, used for grounding.
GROUNDING_COMPANY_ALIASES = {
    "вк": "vk",
    "вконтакте": "vk",
    "mts": "мтс",
}

# Trigger term -> words added to the semantic query.
SEMANTIC_EXPANSIONS = {
    "ai": ("machine learning", "ml", "llm", "mlops"),
    "ии": ("machine learning", "ml", "llm", "mlops"),
    "искусственный интеллект": ("machine learning", "ml", "llm", "mlops"),
    "разумов искусственных": ("machine learning", "ml", "llm", "mlops"),
    "разумы искусственные": ("machine learning", "ml", "llm", "mlops"),
    "machine learning": ("ml", "ml engineer", "mlops"),
    "ml": ("machine learning", "ml engineer", "mlops"),
    "кудесник": ("expert", "engineer"),
    "опытн": ("senior", "experienced"),
}

# Preferences added with any expansion.
EXPANSION_PREFERENCES = ("Machine Learning", "MLOps")

# Inflected city names -> canonical city.
CITY_FORMS = {
    "берлин": "Berlin",
    "берлина": "Berlin",
    "берлине": "Berlin",
    "варшава": "Warsaw",
    "варшаве": "Warsaw",
    "варшавы": "Warsaw",
    "лондон": "London",
    "лондоне": "London",
    "лондона": "London",
    "амстердам": "Amsterdam",
    "амстердаме": "Amsterdam",
    "амстердама": "Amsterdam",
    "лиссабон": "Lisbon",
    "лиссабоне": "Lisbon",
    "лиссабона": "Lisbon",
    "москва": "Москва",
    "москве": "Москва",
    "москвы": "Москва",
    "москву": "Москва",
    "московском": "Москва",
    "санкт петербург": "Санкт-Петербург",
    "санкт петербурге": "Санкт-Петербург",
    "петербург": "Санкт-Петербург",
    "петербурге": "Санкт-Петербург",
    "казань": "Казань",
    "казани": "Казань",
    "екатеринбург": "Екатеринбург",
    "екатеринбурге": "Екатеринбург",
    "новосибирск": "Новосибирск",
    "новосибирске": "Новосибирск",
    "moscow": "Moscow",
}

# Markers of an age condition, and the four age forms.
AGE_MARKERS = ("старше ", "младше ", "возраст", "лет от роду")
AGE_OLDER_THAN = r"старше\s+(\d{2})\s+лет"
AGE_FROM = r"от\s+(\d{2})\s+лет"
AGE_YOUNGER_THAN = r"младше\s+(\d{2})\s+лет"
AGE_UP_TO = r"до\s+(\d{2})\s+лет"

# Terms that turn into requirements.
MLOPS_TERMS = ("млопс", "mlops", "мл инженер", "ml engineer", "machine learning engineer")
PYTHON_TERMS = ("python", "питон")
MTS_TERMS = ("мтс", "mts")
MTS_COMPANY = "МТС"

# Cyrillic endings removed by stemming.
CYRILLIC_ENDINGS = "аеиоуыюяь"

# Similarity needed for a fuzzy vocabulary hit.
FUZZY_RATIO = 0.82
FUZZY_MIN_LENGTH = 4

# Whitespace as text trimming sees it (Unicode White_Space and the
# four separators U+001C..U+001F).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Default weights of the seven ranking features.
RANKING_WEIGHTS = {
    "semantic": 0.30,
    "skills": 0.25,
    "domains": 0.15,
    "experience": 0.10,
    "graph": 0.10,
    "location": 0.05,
    "preference": 0.05,
}

# The nine relations of the property graph.
GRAPH_RELATIONS = (
    ("Person", "WORKED_AT", "Company"),
    ("Person", "HAS_SKILL", "Skill"),
    ("Person", "USED_TECHNOLOGY", "Technology"),
    ("Person", "WORKED_ON", "Project"),
    ("Person", "STUDIED_AT", "University"),
    ("Person", "SPECIALIZES_IN", "Domain"),
    ("Company", "OPERATES_IN", "Domain"),
    ("Project", "USES", "Technology"),
    ("Project", "BELONGS_TO", "Domain"),
)
