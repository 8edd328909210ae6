"""Word lists and patterns of the posting rules.

Everything here is a fixed value: the results depend on these very words. Lists
are in the order in which they are read; all words are lower case unless the
script has no case.
"""

from __future__ import annotations

# Built-in word lists.
SALARY_MISSING_KEYWORDS = (
    "tbd",
    "to be discussed",
    "not disclosed",
    "not specified",
    "not provided",
    "no salary range given",
    "salary range not given",
    "salary not disclosed",
    "n/a",
    "na",
    "negotiable",
    "competitive",
)
ONSITE_ONLY_KEYWORDS = (
    "onsite-only",
    "on-site only",
    "on site only",
    "office only",
    "fully onsite",
    "5 days office",
    "five days office",
)
REMOTE_OR_HYBRID_KEYWORDS = (
    "remote",
    "hybrid",
    "work from home",
    "wfh",
)
CONSULTING_HARD_KEYWORDS = (
    "consulting",
    "dispatch",
    "staffing",
    "system engineer service",
    "ses",
    "client assignment",
)
STARTUP_RISK_KEYWORDS = (
    "seed",
    "pre-seed",
    "series a",
    "early stage startup",
    "early-stage startup",
    "stealth startup",
)
ABUSIVE_OVERTIME_KEYWORDS = (
    "unpaid overtime",
    "mandatory overtime",
    "weekend work required",
    "late nights required",
    "60 hours",
    "70 hours",
    "996",
)
WORKLOAD_NO_FIXED_HOURS_KEYWORDS = (
    "no set working hours",
    "no fixed working hours",
    "no fixed hours",
    "results over time clocks",
    "flexible working hours",
)
WORKLOAD_MIN_WEEKLY_COMMITMENT_KEYWORDS = (
    "minimum commitment of 40 hours per week",
    "minimum 40-hour workweek",
    "minimum 40 hour workweek",
    "minimum 40 hours per week",
    "40-hour workweek",
    "40 hour workweek",
)
WORKLOAD_PRESSURE_KEYWORDS = (
    "work hard and play hard",
    "work hard, play hard",
    "work hard play hard",
    "fixed overtime",
    "deemed overtime",
    "overtime included",
)
LOCATION_CHANGE_BY_COMPANY_KEYWORDS = (
    "location may be changed",
    "transfer may be required",
    "relocation may be required",
    "as determined by the company",
)
LOCATION_OVERSEAS_TRANSFER_KEYWORDS = (
    "including overseas",
    "overseas transfer",
    "overseas assignment",
)
DEBT_FIRST_CULTURE_RISK_KEYWORDS = (
    "strategically accumulate technical debt",
    "technical debt if it means faster growth",
    "only after reaching product market fit will we seek to optimize",
    "fail proof our codebase",
    "moving fast should be a startup's primary focus",
)
HYPERGROWTH_EXECUTION_RISK_KEYWORDS = (
    "increased revenue 10x over the past year",
    "plan to do the same again over the coming 12 months",
    "10x over the past year",
    "10x growth",
)
JAPANESE_INTERNAL_ONLY_KEYWORDS = (
    "all internal communications",
    "all internal communication",
    "internal communications",
    "internal communication",
    "all documents",
    "customer support will be in japanese",
    "社内コミュニケーション",
    "社内文書",
    "社内資料",
    "日本語での対応",
)
FOREIGN_WELCOME_KEYWORDS = (
    "welcome foreign workers",
    "foreign workers welcome",
    "welcome international applicants",
    "international applicants welcome",
    "foreign nationals welcome",
    "visa sponsorship",
    "外国人歓迎",
    "海外人材歓迎",
)
INHOUSE_PRODUCT_ENGINEERING_KEYWORDS = (
    "in-house development",
    "in house development",
    "end-to-end in-house development",
    "end to end in-house development",
    "client-server-3rd party system design",
)
GLOBAL_TEAM_COLLABORATION_KEYWORDS = (
    "multinational members",
    "diverse backgrounds",
    "full-remote team",
    "full remote team",
    "global team",
    "international team",
)
VISA_SPONSORSHIP_SUPPORT_KEYWORDS = (
    "visa sponsorship",
    "japan visa sponsorship available",
    "sponsorship available",
    "work visa support",
)
ROLE_MANAGER_SCOPE_KEYWORDS = (
    "engineering manager",
    "people management",
    "management of each team member",
    "mentoring and coaching",
    "1-on-1",
    "goal setting and evaluation",
    "engineering organization",
    "organization performance",
    "tech lead",
    "team management",
    "line management",
)
ROLE_MANAGER_TITLE_KEYWORDS = (
    "manager",
    "lead",
    "head",
    "director",
    "vp",
)
ROLE_IC_TITLE_KEYWORDS = (
    "engineer",
    "developer",
    "programmer",
)
ROLE_SOFTWARE_KEYWORDS = (
    "software",
    "backend",
    "front",
    "fullstack",
    "engineer",
    "developer",
    "programmer",
    "java",
    "kotlin",
    "python",
    "typescript",
    "go",
)
ROLE_NON_SOFTWARE_MISMATCH_KEYWORDS = (
    "physicist",
    "physics",
    "chemist",
    "biologist",
    "attorney",
    "lawyer",
    "nurse",
    "doctor",
    "talent network",
    "talent pool",
)
INTERMEDIARY_CONTRACT_KEYWORDS = (
    "one of our clients",
    "project basis",
    "independent contractor",
    "services rendered",
    "talent network",
    "talent pool",
    "contract and payment terms",
)
ANONYMOUS_EMPLOYER_RISK_KEYWORDS = (
    "the employer is",
    "our client is",
    "our client, a",
    "industry leading company",
    "industry-leading company",
    "large organization operating within",
)
APPLICATION_PROCESS_TEMPLATE_KEYWORDS = (
    "application process",
    "upload resume",
    "profile verification",
    "screening process",
    "skills questionnaire",
    "time-boxed exercise",
    "selected candidates will be contacted",
)
PRE_IPO_RISK_KEYWORDS = (
    "pre-ipo",
    "pre ipo",
    "preparing for ipo",
    "ipo preparation",
    "aiming for ipo",
    "phase of preparing for ipo",
    "listing on the stock exchange",
)
PRODUCT_COMPANY_KEYWORDS = (
    "product ownership",
    "own the product",
    "build product",
    "product roadmap",
)
ENGINEERING_CULTURE_KEYWORDS = (
    "engineering culture",
    "code review",
    "automated testing",
    "developer productivity",
    "quality-first",
)
ENGINEERING_ENVIRONMENT_POSITIVE_KEYWORDS = (
    "clear ownership boundaries",
    "service ownership",
    "end-to-end ownership",
    "end to end ownership",
    "blameless postmortem",
    "blameless incident review",
    "documented runbooks",
    "runbook culture",
    "sustainable on-call",
    "sustainable on call",
    "on-call compensation",
    "on call compensation",
    "error budget",
    "service level objective",
    "slo",
)
ENGINEERING_ENVIRONMENT_RISK_KEYWORDS = (
    "24/7 on-call",
    "24/7 on call",
    "frequent incidents",
    "constant firefighting",
    "legacy monolith",
    "legacy stack",
    "single point of failure",
    "no runbook",
    "no runbooks",
    "pager duty every night",
    "high pager load",
    "always-on support",
    "always on support",
    "unbounded on-call",
    "unbounded on call",
)
WORK_LIFE_BALANCE_KEYWORDS = (
    "work-life balance",
    "no overtime",
    "mental health",
    "well-being",
)
STABILITY_KEYWORDS = (
    "profitable",
    "public company",
    "listed company",
    "established company",
)
REPUTATION_POSITIVE_KEYWORDS = (
    "profitable growth",
    "consistent profitability",
    "high retention",
    "low attrition",
    "employee retention",
    "best place to work",
    "strong glassdoor",
    "transparent leadership",
    "long-term roadmap",
    "multi-year product roadmap",
)
REPUTATION_RISK_KEYWORDS = (
    "layoff",
    "laid off",
    "workforce reduction",
    "restructuring",
    "hiring freeze",
    "high attrition",
    "toxic culture",
    "compliance scandal",
    "fraud investigation",
    "going concern",
    "salary cuts",
)
CANDIDATE_REQUIREMENT_SECTION_KEYWORDS = (
    "requirements",
    "required skills",
    "must-have",
    "must have",
    "mandatory",
    "must-have skills",
    "must have skills",
)
CANDIDATE_NON_REQUIREMENT_SECTION_KEYWORDS = (
    "responsibilities",
    "job contents",
    "team culture",
    "working conditions",
    "selection process",
    "benefits",
    "nice to have",
    "nice to haves",
    "nice-to-have",
    "nice-to-haves",
    "preferred",
    "preferred qualifications",
    "bonus",
)
CANDIDATE_REQUIREMENT_LINE_HINTS = (
    "experience with",
    "hands-on experience with",
    "proficiency in",
    "strong background in",
    "knowledge of",
    "expertise in",
    "required",
    "must have",
    "must-have",
)
CANDIDATE_ALTERNATIVE_LINE_HINTS = (
    "at least one",
    "e.g.",
    "e.g,",
    "for example",
    "such as",
)
SENIOR_ROLE_KEYWORDS = (
    "senior",
    "staff",
    "lead",
    "principal",
    "architect",
)
ALGORITHMIC_INTERVIEW_KEYWORDS = (
    "coding test",
    "online assessment",
    "hackerrank",
    "leetcode",
    "algorithmic thinking",
    "computer science fundamentals",
    "data structures and algorithms",
    "data structures",
    "problem-solving ability",
    "problem-solving skills",
)
PM_COLLABORATION_KEYWORDS = (
    "product manager",
    "product managers",
    "with pm",
    "with pms",
    "collaborate closely with product managers",
)
PRODUCT_DELIVERY_KEYWORDS = (
    "customer-facing product",
    "customer facing product",
    "product reliability",
    "scalable backend systems",
    "scalable backend system",
    "build scalable backend systems",
    "product development",
    "customer-facing",
    "customer facing",
)
ENGINEERING_MATURITY_KEYWORDS = (
    "engineering blog",
    "tech blog",
    "developer productivity",
    "platform engineering",
    "internal developer tools",
    "developer experience",
    "devex",
)
CASUAL_INTERVIEW_KEYWORDS = (
    "casual interview",
    "casual talk",
    "casual chat",
    "informal chat",
)
ASYNC_COMMUNICATION_KEYWORDS = (
    "asynchronous communication",
    "async communication",
    "written-first communication",
    "written first communication",
)
REAL_FLEXTIME_KEYWORDS = (
    "flextime",
    "flex time",
    "full flextime",
    "core time",
    "no core hours",
    "core hours",
)
GENERIC_FLEXTIME_KEYWORDS = (
    "flexible working hours",
    "flexible hours",
    "flexible schedule",
)
PRESSURE_CULTURE_KEYWORDS = (
    "fast-paced environment",
    "fast paced environment",
    "fast-moving environment",
    "fast moving environment",
    "dynamic environment",
    "handle multiple tasks",
    "work under pressure",
    "self-motivated",
    "self motivated",
)
PRESSURE_CULTURE_STRONG_KEYWORDS = (
    "self-motivated person who can work under pressure",
    "self motivated person who can work under pressure",
)
TOEIC_KEYWORDS = (
    "toeic",
    "toeic score",
)
TRADITIONAL_CORPORATE_PROCESS_KEYWORDS = (
    "business level japanese required",
    "business-level japanese required",
    "business japanese required",
    "native japanese required",
    "native-level japanese required",
    "professional japanese required",
)
CUSTOMER_SITE_KEYWORDS = (
    "onsite at customer",
    "on-site at customer",
    "onsite at client",
    "on-site at client",
    "customer site",
    "client site",
    "client projects",
    "client project",
    "assigned to client site",
    "work at client offices",
    "onsite at customer offices",
)

# Patterns. Texts are lower case, so case is not folded again.
LANGUAGE_REQUIRED_PATTERNS = (
    r"\bjapanese\b.{0,24}\b(must|required for this role|mandatory)\b",
    r"\b(must|mandatory)\b.{0,24}\bjapanese\b",
    r"\bcommunicat(?:e|es|ing|ion)\b.{0,48}\bin\s+japanese\b",
    r"\bjlpt\s*n[12]\b",
    r"\bn[12]\s*(level\s*or\s*above|or\s*above|\+)\b",
    r"\bn[12]\b.{0,24}\bjapanese\b",
    r"日本語.*必須",
    r"必須.*日本語",
    r"日本語能力試験\s*n[12N１２]",
)
LANGUAGE_OPTIONAL_PATTERNS = (
    r"\bjapanese\b.{0,24}\b(optional|preferred|plus|nice to have|welcome)\b",
    r"\b(no japanese required|japanese not required|english only)\b",
    r"日本語.*(不問|歓迎|必須ではありません)",
)
LANGUAGE_ASSIGNMENT_DEPENDENCY_PATTERNS = (
    r"\bjapanese\b.{0,80}\b(considered|taken into consideration|used to determine)\b.{0,80}\b(assignment|team|placement|work content|role scope)\b",
    r"\b(assignment|team|placement|work content|role scope)\b.{0,80}\b(depend|depends|determined|based)\b.{0,40}\bjapanese\b",
    r"\bdepending on your japanese level\b",
    r"\bbased on your japanese level\b",
    r"日本語.*(考慮|判断).*(配属|担当|業務内容|チーム)",
    r"(配属|担当|業務内容|チーム).*(日本語).*(考慮|判断)",
)
JAPANESE_INTERNAL_ONLY_PATTERNS = (
    r"all\s+internal\s+communications?.{0,60}\bjapanese\b",
    r"all\s+internal\s+documents?.{0,60}\bjapanese\b",
    r"customer\s+support.{0,60}\bjapanese\b",
    r"all\s+internal\s+communications?,\s+documents?,\s+and\s+customer\s+support\s+will\s+be\s+in\s+japanese",
    r"日本語.*(社内|社外).*必須",
)
JUNIOR_MID_TITLE_PATTERNS = (
    r"\b(junior|jr\.?|entry[- ]level|graduate|new grad)\b",
    r"\bmid(?:[- ]level)?\b",
)
POSITION_LABEL_PATTERN = r"(?s)\bposition\s*:\s*([^\n\r|.;]{2,120})"
GENERIC_DESIRED_SKILLS_ENGINEER_PATTERN = r"(?s)desired\s+skills\s+and\s+experience\s*[:\-\n\r]*\s*engineer\b"
SALARY_MILLION_PATTERN = r"(\d+(?:\.\d+)?)\s*(m|million)\b"
SALARY_NUMBER_PATTERN = r"(\d{1,3}(?:[,.]\d{3})+|\d{6,9})"
SALARY_ORDERED_TOKEN_PATTERN = r"(\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?)\s*(m|million|k)?"
YEARS_EXPERIENCE_PATTERN = r"(\d+)\+?\s+years?(?: of)?\s+(?:hands-on )?(?:experience|exp)"
CORE_TIME_WINDOW_PATTERN = r"core\s*time\s*[:：]?\s*\d{1,2}:\d{2}\s*[-–—~〜～]\s*\d{1,2}:\d{2}"
AVERAGE_OVERTIME_HOURS_PATTERN = r"average\s+overtime\s*[:：]?\s*(\d{1,3})(?:\.\d+)?\s*(?:h|hr|hrs|hours?)\s*(?:/|per)?\s*month"

# Configurable word lists and thresholds, as shipped.
LANGUAGE_REQUIRED_KEYWORDS = (
    "japanese required",
    "japanese is required",
    "japanese language required",
    "must speak japanese",
    "japanese is mandatory",
    "mandatory japanese",
    "japanese proficiency required",
    "native japanese",
    "native-level japanese",
    "native level japanese",
    "fluent japanese",
    "advanced japanese",
    "professional japanese",
    "business-level japanese",
    "business level japanese",
    "jlpt n1",
    "jlpt n2",
    "n1 level japanese",
    "n2 level japanese",
    "日本語必須",
    "ビジネスレベルの日本語",
    "日本語ネイティブ",
    "日本語能力試験n1",
    "日本語能力試験n2",
)
LANGUAGE_FRICTION_SOFT_KEYWORDS = (
    "business japanese",
    "japanese fluency",
    "japanese proficiency",
    "japanese communication",
    "japanese skill",
)
LANGUAGE_MEDIUM_HIGH_FRICTION_KEYWORDS = (
    "business-level japanese",
    "business level japanese",
    "jlpt n2",
    "n2 level japanese",
    "n2 level or above",
    "n2 or above",
    "ビジネスレベルの日本語",
    "日本語能力試験n2",
    "日本語能力試験ｎ2",
    "日本語能力試験Ｎ２",
)
LANGUAGE_HIGH_FRICTION_KEYWORDS = (
    "native japanese",
    "native-level japanese",
    "native level japanese",
    "jlpt n1",
    "n1 level japanese",
    "日本語ネイティブ",
    "日本語能力試験n1",
    "日本語能力試験ｎ1",
    "日本語能力試験Ｎ１",
)
LANGUAGE_ASSIGNMENT_DEPENDENT_KEYWORDS = (
    "japanese communication ability will be considered",
    "japanese ability will be considered",
    "japanese proficiency will be considered",
    "depending on your japanese level",
    "based on your japanese level",
    "team assignment will depend on japanese",
    "assignment will depend on japanese",
    "日本語能力に応じて",
    "日本語レベルに応じて",
    "日本語力に応じて",
    "日本語能力を考慮して",
    "配属先は日本語",
    "業務内容は日本語",
)
LANGUAGE_OPTIONAL_OR_EXEMPT_KEYWORDS = (
    "no japanese required",
    "japanese not required",
    "japanese is a plus",
    "japanese preferred",
    "japanese optional",
    "japanese nice to have",
    "basic japanese welcome",
    "conversational japanese preferred",
    "english only",
    "日本語不問",
    "日本語歓迎",
    "日本語は必須ではありません",
)
LANGUAGE_ENGLISH_FRIENDLY_KEYWORDS = (
    "english-first",
    "english first",
    "international team",
    "no japanese required",
    "japanese not required",
    "english only",
    "english speaking environment",
    "english communication",
    "global team",
)
LANGUAGE_ENGLISH_SUPPORT_ENVIRONMENT_KEYWORDS = (
    "english is used on a daily basis",
    "english used on a daily basis",
    "daily english usage",
    "english usage on a daily basis",
    "fluency in english is not required",
    "current fluency in english is not required",
    "current fluency is not a requirement",
    "english fluency is not required",
    "english is not required",
    "comfortable with english",
    "support is provided",
)
LANGUAGE_ENGLISH_SUPPORT_MAX_INDEX = 20
LANGUAGE_ASSIGNMENT_DEPENDENT_BASE_INDEX = 35
LANGUAGE_ASSIGNMENT_DEPENDENT_MIN_INDEX = 20
WORK_LIFE_BALANCE_OVERTIME_RISK_KEYWORDS = (
    "fixed overtime",
    "deemed overtime",
    "overtime included",
    "overtime work may occur",
    "overtime required",
    "significant overtime",
    "fast-paced",
    "high-pressure",
    "tight deadlines",
    "deadlines are tight",
    "occasional weekend work",
)
WORK_LIFE_BALANCE_HOLIDAY_POLICY_RISK_KEYWORDS = (
    "national holidays correspond to working days",
    "national holidays are working days",
    "national holidays are workdays",
    "public holidays are working days",
    "public holidays are workdays",
    "holidays correspond to working days",
)
MOBILITY_LOCATION_MOBILITY_RISK_KEYWORDS = (
    "location may be changed",
    "including overseas",
    "transfer may be required",
    "relocation may be required",
    "as determined by the company",
)
JOB_POST_QUALITY_GENERIC_MARKETING_RISK_KEYWORDS = (
    "industry leading company",
    "industry-leading company",
    "cutting-edge solutions",
    "cutting edge solutions",
    "technical excellence",
    "high-impact systems",
    "high impact systems",
    "innovative technology solutions",
    "vibrant city of tokyo",
)
JOB_POST_QUALITY_GENERIC_MARKETING_RISK_HIT_MIN = 2
JOB_POST_QUALITY_CONDITIONS_SECTION_KEYWORDS = (
    "conditions",
    "benefits",
    "working conditions",
    "what we offer",
    "compensation",
    "待遇",
    "条件・待遇",
)
JOB_POST_QUALITY_VAGUE_CONDITIONS_RISK_KEYWORDS = (
    "opportunity to work",
    "a chance to contribute",
    "innovative technology solutions",
    "vibrant city of tokyo",
    "technical excellence",
    "exciting opportunity",
    "grow with us",
)
JOB_POST_QUALITY_VAGUE_CONDITIONS_RISK_HIT_MIN = 2
JOB_POST_QUALITY_CONCRETE_CONDITIONS_KEYWORDS = (
    "salary",
    "bonus",
    "annual leave",
    "paid leave",
    "holiday",
    "holidays",
    "insurance",
    "allowance",
    "flextime",
    "remote",
    "hybrid",
    "work from home",
    "overtime",
    "hours",
    "commuter",
    "pension",
    "social insurance",
    "stock option",
    "visa sponsorship",
)
