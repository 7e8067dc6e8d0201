"""Word lists and rates. Every function takes them as arguments with these defaults."""

# Lists, orders, rates and labels that results depend on.
CURRENCY_PATTERNS = {
    "KES": ["KES", "Ksh", "Kshs"],
    "NGN": ["NGN", "₦", "Naira"],
    "GHS": ["GHS", "GHC", "Cedis"],
    "ZAR": ["ZAR", r"R\s?\d", "Rand"],
    "UGX": ["UGX", "Ush"],
    "TZS": ["TZS", "Tsh"],
    "EGP": ["EGP", "E£"],
    "USD": ["USD", r"US\$", r"\$"],
    "EUR": ["EUR", "€"],
    "GBP": ["GBP", "£"],
}
FX_RATES = {
    "USD": 1.0, "EUR": 1.10, "GBP": 1.27, "ZAR": 0.055, "NGN": 0.0021, "GHS": 0.11, "KES": 0.0078,
    "EGP": 0.021, "MAD": 0.10, "TND": 0.33, "UGX": 0.00027,
}
EXPERIENCE_BUCKETS = [(0, 1, "0-1 years"), (1, 3, "1-3 years"), (3, 5, "3-5 years"), (5, 10, "5-10 years"), (10, None, "10+ years")]
SENIORITY_ORDER = {"Intern": 0, "Entry Level": 1, "Mid-Level": 2, "Senior": 3, "Lead": 4, "Executive": 5}
SENIORITY_KEYWORDS = {
    "intern": "Intern", "internship": "Intern", "graduate": "Entry Level", "entry level": "Entry Level", "junior": "Entry Level",
    "mid-level": "Mid-Level", "mid level": "Mid-Level", "intermediate": "Mid-Level", "senior": "Senior", "principal": "Senior",
    "lead": "Lead", "manager": "Lead", "director": "Executive", "vp": "Executive", "vice president": "Executive",
    "executive": "Executive", "c-level": "Executive", "cto": "Executive", "cfo": "Executive", "ceo": "Executive",
}
EMPLOYMENT_KEYWORDS = {
    "full-time": "Full-Time", "full time": "Full-Time", "fulltime": "Full-Time", "part-time": "Part-Time", "part time": "Part-Time",
    "contract": "Contract", "temporary": "Temporary", "freelance": "Freelance", "internship": "Internship",
}
SKILL_ALIASES = {
    "golang": "go", "csharp": "c#", "nextjs": "next.js", "aspnet": "asp.net", "postgres": "postgresql", "amazon web services": "aws",
    "google cloud": "gcp", "microsoft azure": "azure", "sklearn": "scikit-learn", "k8s": "kubernetes", "cicd": "ci/cd",
    "hugging face": "huggingface", "powerbi": "power bi",
}
TECH_CATEGORY_MAP = {
    "Software Development": ["developer", "software engineer", "programmer", "full stack", "fullstack", "backend", "frontend", "web developer", "mobile app", "android", "ios"],
    "Data & AI": ["data scientist", "data analyst", "data engineer", "machine learning", "artificial intelligence", "ai ", "business intelligence", "bi analyst"],
    "DevOps & Cloud": ["devops", "site reliability", "cloud engineer", "cloud architect", "kubernetes", "sre"],
    "Cybersecurity": ["cybersecurity", "security analyst", "penetration", "infosec", "security engineer"],
    "IT Support & Networking": ["it support", "helpdesk", "network engineer", "systems admin", "sysadmin", "desktop support"],
    "Product & Design": ["product manager", "ux designer", "ui designer", "product owner", "ux/ui"],
    "QA & Testing": ["qa engineer", "quality assurance", "test engineer", "sdet"],
}
TECH_KEYWORDS = [
    "developer", "engineer", "software", "data", "devops", "cloud", "frontend", "backend", "full stack", "fullstack", "python", "java", "javascript",
    "react", "node", "android", "ios", "mobile app", "machine learning", "ai ", "artificial intelligence", "cybersecurity", "security analyst",
    "network engineer", "systems admin", "sysadmin", "database", "sql", "product manager", "ux", "ui designer", "qa engineer", "quality assurance",
    "it support", "helpdesk", "scrum", "technical", "programmer", "web developer", "site reliability", "ict", "information technology",
    "computer science", "system analyst", "network administrator", "it officer", "it manager", "it technician", "solutions architect",
    "business analyst", "data engineer", "cloud architect", "infrastructure engineer", "telecom", "telecoms", "erp", "sap consultant", "salesforce",
    "digital transformation", "automation", "robotics", "blockchain", "fintech engineer", "game developer", "embedded systems", "firmware",
    "technical support", "help desk", "it consultant", "application developer", ".net developer", "php developer", "ruby developer", "golang",
    "c++ developer",
]
REMOTE_KEYWORDS = ["remote", "work from home", "wfh", "distributed", "diaspora", "global", "international"]
PREFERRED_WORDS = ["preferred", "nice to have", "bonus", "advantageous", "plus"]
PLACEHOLDER_TEXTS = ["no description", "n/a", "none", "not available", "description not available", ""]
CERTIFICATIONS = {
    "aws": "AWS Certification", "kubernetes": "Kubernetes Certification", "gcp": "GCP Certification", "azure": "Azure Certification",
    "cissp": "CISSP", "oscp": "OSCP", "pmp": "PMP", "scrum master": "Scrum Master",
}
SERVICE_CERTIFICATIONS = ["aws certified", "azure certified", "google cloud certified", "pmp", "ccna", "comptia", "scrum master", "cissp", "ckad", "cka"]
# Patterns on lower-case text; words are bounded, so that "as" and "months" name no degree.
EDUCATION = {
    "Bachelor's Degree": r"(^|[^a-z])(bachelors?|b\.?s\.?|b\.?a\.?)\s+(degree|in)",
    "Master's Degree": r"(^|[^a-z])(masters?|m\.?s\.?|m\.?a\.?)\s+(degree|in)",
    "PhD": r"(^|[^a-z])(phd|ph\.?d\.?|doctorate)",
    "Associate Degree": r"(^|[^a-z])associates?('s)?\s+degree",
    "Diploma/High School": r"(^|[^a-z])(high school|diploma)",
}
SERVICE_EDUCATION = {
    "bachelor": "Bachelor's degree", "b.sc": "Bachelor's degree", "bsc": "Bachelor's degree", "master": "Master's degree", "msc": "Master's degree",
    "m.sc": "Master's degree", "phd": "PhD", "doctorate": "PhD", "diploma": "Diploma",
}
EXPERIENCE_PATTERNS = [r"(\d+)\+?\s*years?\s+of\s+experience", r"(\d+)\s*-\s*(\d+)\s*years?\s+experience", r"(?:at least|minimum)\s+(\d+)\s*years?", r"(\d+)\+\s*years"]
SERVICE_EXPERIENCE_PATTERNS = [r"(\d{1,2})\s*\+?\s*years?\s+(?:of\s+)?experience", r"experience\s*[:\-]?\s*(\d{1,2})\s*\+?\s*years?", r"(\d{1,2})\s*\+?\s*yrs?\b"]
REQUIREMENT_PATTERNS = [r"must have\s+([^.!?]+)", r"requires?\s+([^.!?]+)", r"needs?\s+([^.!?]+)", r"essential\s+([^.!?]+)", r"key\s+qualifications?\s*:?\s*([^.!?]+)"]
SALARY_PATTERNS = [r"\$?([\d,]+(?:\.\d{2})?)\s*-\s*\$?([\d,]+(?:\.\d{2})?)", r"\$?([\d.]+)k?\s*-\s*\$?([\d.]+)k?", r"(?:from|starting at)?\s*\$?([\d,]+(?:\.\d{2})?)"]
# What stands between the amounts of a pair.
SALARY_PAIR_HINT = r"[\d,.k]\s*-\s*\$?[\d,.]"
SALARY_CURRENCIES = {"USD": ["$", "usd", "dollar"], "EUR": ["€", "eur"], "GBP": ["£", "gbp"], "ZAR": ["zar", "rand"], "NGN": ["ngn", "naira"]}
PAN_AFRICAN_WORDS = ["africa", "diaspora", "pan-african", "panafrican"]
WORK_MODE_SPELLINGS = {"remote": "remote", "hybrid": "hybrid", "on-site": "onsite", "onsite": "onsite", "on site": "onsite"}
# Country name, ISO alpha-2, alpha-3.
COUNTRIES = [
    ("Algeria", "DZ", "DZA"), ("Angola", "AO", "AGO"), ("Benin", "BJ", "BEN"), ("Botswana", "BW", "BWA"), ("Burkina Faso", "BF", "BFA"), ("Burundi", "BI", "BDI"),
    ("Cameroon", "CM", "CMR"), ("Cape Verde", "CV", "CPV"), ("Central African Republic", "CF", "CAF"), ("Chad", "TD", "TCD"), ("Comoros", "KM", "COM"),
    ("Congo", "CG", "COG"), ("Democratic Republic of the Congo", "CD", "COD"), ("Côte d'Ivoire", "CI", "CIV"), ("Djibouti", "DJ", "DJI"), ("Egypt", "EG", "EGY"),
    ("Equatorial Guinea", "GQ", "GNQ"), ("Eritrea", "ER", "ERI"), ("Ethiopia", "ET", "ETH"), ("Gabon", "GA", "GAB"), ("Gambia", "GM", "GMB"), ("Ghana", "GH", "GHA"),
    ("Guinea", "GN", "GIN"), ("Guinea-Bissau", "GW", "GNB"), ("Kenya", "KE", "KEN"), ("Lesotho", "LS", "LSO"), ("Liberia", "LR", "LBR"), ("Libya", "LY", "LBY"),
    ("Madagascar", "MG", "MDG"), ("Malawi", "MW", "MWI"), ("Mali", "ML", "MLI"), ("Mauritania", "MR", "MRT"), ("Mauritius", "MU", "MUS"), ("Morocco", "MA", "MAR"),
    ("Mozambique", "MZ", "MOZ"), ("Namibia", "NA", "NAM"), ("Niger", "NE", "NER"), ("Nigeria", "NG", "NGA"), ("Rwanda", "RW", "RWA"),
    ("Sao Tome and Principe", "ST", "STP"), ("Senegal", "SN", "SEN"), ("Seychelles", "SC", "SYC"), ("Sierra Leone", "SL", "SLE"), ("Somalia", "SO", "SOM"),
    ("South Africa", "ZA", "ZAF"), ("South Sudan", "SS", "SSD"), ("Sudan", "SD", "SDN"), ("Eswatini", "SZ", "SWZ"), ("Tanzania", "TZ", "TZA"), ("Togo", "TG", "TGO"),
    ("Tunisia", "TN", "TUN"), ("Uganda", "UG", "UGA"), ("Zambia", "ZM", "ZMB"), ("Zimbabwe", "ZW", "ZWE"),
]
# Spellings beside the names of COUNTRIES; the codes of nine of them are spelt out, as only those count.
COUNTRY_SPELLINGS = {
    "ZA": "South Africa", "NG": "Nigeria", "EG": "Egypt", "GH": "Ghana", "KE": "Kenya", "MA": "Morocco", "TN": "Tunisia", "UG": "Uganda", "DZ": "Algeria",
    "ZAF": "South Africa", "NGA": "Nigeria", "EGY": "Egypt", "GHA": "Ghana", "KEN": "Kenya", "MAR": "Morocco", "TUN": "Tunisia", "UGA": "Uganda", "DZA": "Algeria",
    "RSA": "South Africa", "SA": "South Africa", "NAI": "Kenya", "NBO": "Kenya", "JNB": "South Africa", "CPT": "South Africa", "CAI": "Egypt", "ACC": "Ghana",
    "ABJ": "Nigeria", "LOS": "Nigeria", "LAG": "Nigeria", "Any": "Global Remote", "Global Remote": "Global Remote", "Remote": "Global Remote",
    "Worldwide": "Global Remote", "Unknown": "Global Remote",
}
TITLE_SENIORITY_WORDS = [
    "senior", "sr", "junior", "jr", "entry", "mid", "lead", "principal", "staff", "associate", "intern", "chief", "head", "the", "of", "and", "a", "i", "ii", "iii", "iv", "1", "2", "3", "4",
]
TITLE_SYNONYMS = {
    "engineer": "developer", "programmer": "developer", "coder": "developer", "dev": "developer", "devs": "developer", "analysts": "analyst",
    "analytics": "analysis", "ml": "machine learning", "ai": "artificial intelligence",
}
# A default dictionary of skills; larger ones are given as a parameter.
SKILLS = {
    "python": "programming_language", "javascript": "programming_language", "typescript": "programming_language", "java": "programming_language",
    "go": "programming_language", "rust": "programming_language", "c++": "programming_language", "c#": "programming_language", "php": "programming_language",
    "ruby": "programming_language", "kotlin": "programming_language", "scala": "programming_language", "r": "programming_language",
    "sql": "programming_language", "bash": "programming_language", "django": "web_framework", "fastapi": "web_framework", "flask": "web_framework",
    "react": "web_framework", "vue": "web_framework", "angular": "web_framework", "spring boot": "web_framework", "node.js": "web_framework",
    "next.js": "web_framework", ".net": "web_framework", "aws": "cloud_platform", "gcp": "cloud_platform", "google cloud": "cloud_platform",
    "azure": "cloud_platform", "postgresql": "database", "mysql": "database", "mongodb": "database", "redis": "database", "docker": "devops",
    "kubernetes": "devops", "terraform": "devops", "ci/cd": "devops", "git": "devops", "linux": "devops", "spark": "data", "airflow": "data",
    "kafka": "data", "etl": "data", "machine learning": "ai_ml", "deep learning": "ai_ml", "tensorflow": "ai_ml", "pytorch": "ai_ml", "nlp": "ai_ml",
    "rest": "api", "api": "api", "graphql": "api", "agile": "method", "scrum": "method", "excel": "tool", "power bi": "tool", "tableau": "tool",
}
# Phrases that tell that an ambiguous word names a skill, and phrases in which it does not.
CONTEXT_PATTERNS = {
    "r": [r"\br\b.*(?:program|language|studio|statistic|script|package|code|develop)", r"(?:program|language|studio|statistic|script|package|code|develop).*\br\b", r"\br\b.*(?:data scien|analy|visuali|comput|model|stat)", r"(?:using|with|in|know)\s+r\b"],
    "go": [r"\bgo\b.*(?:program|language|develop|backend|microservice|golang)", r"(?:program|language|develop|backend|microservice|golang).*\bgo\b", r"\bgo\b.*(?:goroutine|concurrent|channel)", r"(?:using|with|in|know)\s+go\b"],
    "api": [r"\bapi\b.*(?:design|develop|build|rest|graphql|endpoint|integrat)", r"(?:rest|graphql|build|design|develop|integrat).*\bapi\b", r"\bapi\b.*(?:gateway|management|version|documentation)"],
    "rest": [r"\brest\b.*(?:api|ful|service|endpoint|architect)", r"(?:api|ful|service|endpoint|architect).*\brest\b"],
    "git": [r"\bgit\b.*(?:version|control|repository|branch|merge|commit|push|pull|clone)", r"(?:version|control|repository|branch|merge|commit|push|pull|clone).*\bgit\b", r"(?:using|with|in|know)\s+git\b"],
    "sql": [r"\bsql\b.*(?:query|database|server|mysql|postgres|oracle|write)", r"(?:query|database|server|mysql|postgres|oracle|write).*\bsql\b"],
}
FALSE_POSITIVES = {"go": ["go-to-market", "go to market", "gtm", "go-live", "go live"]}
# What a question is about, in order (the first of equal counts), patterns of questions about the market and about roles, and countries named.
QUESTION_PATTERNS = {
    "market_intelligence": [
        r"\b(?:most|top|best|in\s+demand|trending|popular|common|needed)\s+(?:skill|technology|role|job|tool)",
        r"\b(?:skill|technology|role|job)\s+(?:demand|gap|shortage|trend)",
        r"\b(?:what|which)\s+(?:skill|technology|role|job|position)\s+(?:is|are)\s+(?:the\s+)?(?:most|top|best|popular|common|needed|demanded)",
        r"\b(?:how\s+many|number\s+of)\s+(?:job|role|posting)",
        r"\b(?:market\s+(?:data|trend|insight|intelligence))",
    ],
    "skill_inquiry": [
        r"\b(?:what|which)\s+(?:skill|technology|tool|language|framework)",
        r"\b(?:do|should)\s+(?:i|we)\s+(?:need|learn|know)",
        r"\b(?:is|are)\s+\w+\s+(?:in\s+demand|popular|needed|required|important)",
        r"\b(?:trending|growing|emerging)\s+(?:skill|technology|tool)",
    ],
    "job_search": [
        r"\b(?:find|search|show|look\s+for|available)\s+(?:job|role|position|opening)",
        r"\b(?:remote|onsite|hybrid)\s+(?:job|role|position|work)",
        r"\b(?:who|which)\s+(?:company|companies)\s+(?:is|are)\s+hiring",
        r"\b(?:hiring|vacancy|opening|recruitment)",
    ],
    "career_advice": [
        r"\b(?:how|what)\s+(?:do|can|should)\s+(?:i|we)\s+(?:become|get\s+into|start|transition)",
        r"\b(?:career|path|progression|growth|advance)",
        r"\b(?:switch|change|move|transition)\s+(?:to|into|from)",
    ],
    "salary_compensation": [
        r"\b(?:salary|compensation|pay|wage|earn|income|remuneration)",
        r"\b(?:how\s+much|what)\s+(?:do|does|can|should)\s+\w+\s+(?:earn|make|get\s+paid)",
    ],
}
MARKET_PATTERNS = [
    r"\b(?:most|top|best|highest|popular)\s+(?:in\s+demand|demanded|common|frequent|popular|wanted|sought|needed|requested)",
    r"\b(?:in\s+demand|trending|growing|fastest\s+growing|emerging)",
    r"\b(?:what|which)\s+(?:skill|technology|role|job|position)\s+(?:is|are)\s+(?:the\s+)?(?:most|top|best|popular|common|needed|demanded)",
    r"\b(?:skill|skills|role|roles|job|jobs)\s+(?:in|across|for)\s+(?:kenya|nigeria|ghana|south\s+africa|egypt|africa)",
    r"\b(?:african|africa|kenya|nigeria|ghana|south\s+africa|egypt)\s+(?:market|tech\s+market|job\s+market)",
    r"\b(?:most|top|best)\s+(?:popular|common|frequent|needed)\s+(?:skill|technology|tool|role|job|position)",
    r"\b(?:skill|technology|tool|role|job)\s+(?:demand|gap|shortage|surplus)",
    r"\b(?:how\s+many|number\s+of)\s+(?:job|role|posting)",
    r"\b(?:market\s+(?:share|data|intelligence|trend|insight))",
    r"\b(?:which\s+skill|what\s+skill|which\s+role|what\s+role|what\s+job|which\s+job).*(?:kenya|nigeria|ghana|south\s+africa|egypt|africa)",
    r"\b(?:needed|available)\s+(?:role|job|position)",
    r"\b(?:most|top)\s+(?:hiring|recruited)",
]
ROLE_PATTERN = r"\b(?:role|roles|job|jobs|position|positions|hiring)\b"
COUNTRY_PATTERNS = {
    "Kenya": r"\b(?:kenya|ke)\b", "Nigeria": r"\b(?:nigeria|ng)\b", "Ghana": r"\b(?:ghana|gh)\b", "South Africa": r"\b(?:south\s+africa|za)\b", "Egypt": r"\b(?:egypt|eg)\b",
    "Rwanda": r"\b(?:rwanda|rw)\b", "Uganda": r"\b(?:uganda|ug)\b", "Tanzania": r"\b(?:tanzania|tz)\b",
}
OPEN_TO_ALL_MARKERS = ["anywhere", "worldwide", "global"]
