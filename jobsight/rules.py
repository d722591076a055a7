"""Ordered rule dictionaries used by the normalizers.

FIXED VALUES: the lists below must equal the source behaviour for parity of
results (word lists, abbreviations, patterns). Order is part of the contract:
rules are applied one after another, so they are kept as ordered lists.
"""

# --- fixed values: title abbreviation rules, applied in this order,
# case-insensitive, pattern -> replacement
TITLE_RULES = [
    (r"\bSr\.?\b", "Senior"),
    (r"\bJr\.?\b", "Junior"),
    (r"\bMgr\.?\b", "Manager"),
    (r"\bDir\.?\b", "Director"),
    (r"\bVP\b", "Vice President"),
    (r"\bSVP\b", "Senior Vice President"),
    (r"\bEVP\b", "Executive Vice President"),
    (r"\bCTO\b", "Chief Technology Officer"),
    (r"\bCEO\b", "Chief Executive Officer"),
    (r"\bCFO\b", "Chief Financial Officer"),
    (r"\bCOO\b", "Chief Operating Officer"),
    (r"\bEng\.?\b", "Engineer"),
    (r"\bDev\.?\b", "Developer"),
    (r"\bSWE\b", "Software Engineer"),
    (r"\bQA\b", "Quality Assurance"),
    (r"\bBA\b", "Business Analyst"),
    (r"\bPM\b", "Product Manager"),
    (r"\bTPM\b", "Technical Program Manager"),
    (r"\bEM\b", "Engineering Manager"),
    (r"\bSDE\b", "Software Development Engineer"),
    (r"\bIT\b", "Information Technology"),
    (r"\bCS\b", "Computer Science"),
    (r"\bUI\b", "User Interface"),
    (r"\bUX\b", "User Experience"),
    (r"\bML\b", "Machine Learning"),
    (r"\bAI\b", "Artificial Intelligence"),
    (r"\bAPI\b", "Application Programming Interface"),
    (r"\bDB\b", "Database"),
    (r"\bOps\b", "Operations"),
    (r"\bDevOps\b", "Development Operations"),
    (r"\bSRE\b", "Site Reliability Engineer"),
    (r"\bFE\b", "Frontend"),
    (r"\bBE\b", "Backend"),
    (r"\bFS\b", "Full Stack"),
]

# --- fixed values: seniority words and levels, in dictionary order
SENIORITY_LEVELS = [
    ("intern", 0),
    ("internship", 0),
    ("entry", 1),
    ("entry level", 1),
    ("junior", 2),
    ("associate", 3),
    ("mid", 4),
    ("mid level", 4),
    ("senior", 5),
    ("staff", 6),
    ("principal", 7),
    ("lead", 7),
    ("manager", 8),
    ("senior manager", 9),
    ("director", 10),
    ("senior director", 11),
    ("vice president", 12),
    ("senior vice president", 13),
    ("executive vice president", 14),
    ("c-level", 15),
    ("chief", 15),
]

# --- fixed values: US state abbreviations, in dictionary order
STATE_ABBREVIATIONS = [
    ("AL", "Alabama"), ("AK", "Alaska"), ("AZ", "Arizona"), ("AR", "Arkansas"),
    ("CA", "California"), ("CO", "Colorado"), ("CT", "Connecticut"), ("DE", "Delaware"),
    ("FL", "Florida"), ("GA", "Georgia"), ("HI", "Hawaii"), ("ID", "Idaho"),
    ("IL", "Illinois"), ("IN", "Indiana"), ("IA", "Iowa"), ("KS", "Kansas"),
    ("KY", "Kentucky"), ("LA", "Louisiana"), ("ME", "Maine"), ("MD", "Maryland"),
    ("MA", "Massachusetts"), ("MI", "Michigan"), ("MN", "Minnesota"), ("MS", "Mississippi"),
    ("MO", "Missouri"), ("MT", "Montana"), ("NE", "Nebraska"), ("NV", "Nevada"),
    ("NH", "New Hampshire"), ("NJ", "New Jersey"), ("NM", "New Mexico"), ("NY", "New York"),
    ("NC", "North Carolina"), ("ND", "North Dakota"), ("OH", "Ohio"), ("OK", "Oklahoma"),
    ("OR", "Oregon"), ("PA", "Pennsylvania"), ("RI", "Rhode Island"), ("SC", "South Carolina"),
    ("SD", "South Dakota"), ("TN", "Tennessee"), ("TX", "Texas"), ("UT", "Utah"),
    ("VT", "Vermont"), ("VA", "Virginia"), ("WA", "Washington"), ("WV", "West Virginia"),
    ("WI", "Wisconsin"), ("WY", "Wyoming"), ("DC", "District of Columbia"),
]

# --- fixed values: city synonyms, in dictionary order, case-insensitive
LOCATION_SYNONYMS = [
    ("nyc", "New York"),
    ("sf", "San Francisco"),
    ("la", "Los Angeles"),
    ("dc", "Washington"),
    ("philly", "Philadelphia"),
    ("chi", "Chicago"),
    ("chi-town", "Chicago"),
]

# --- fixed values: remote indicator pattern (case-insensitive)
REMOTE_PATTERN = r"\b(remote|work from home|wfh)\b"

# --- fixed values: filler words dropped from key terms
FILLER_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at",
    "to", "for", "of", "with", "by", "from", "as", "is", "was",
    "are", "were", "been", "be", "have", "has", "had", "do",
    "does", "did", "will", "would", "could", "should", "may",
    "might", "must", "can",
]

# --- fixed values: company suffixes removed at the end, in this order
COMPANY_SUFFIXES = [
    r"\bInc\.?$",
    r"\bLLC\.?$",
    r"\bLtd\.?$",
    r"\bCorp\.?$",
    r"\bCorporation$",
    r"\bLimited$",
    r"\bCompany$",
    r"\bCo\.?$",
]

# --- fixed values: title case of letters whose upper case is two or more letters
# (used by the SQL oracle; the Spark expression derives it from upper())
TITLECASE_EXPANSIONS = [
    ("\u00df", "Ss"), ("\ufb00", "Ff"), ("\ufb01", "Fi"), ("\ufb02", "Fl"),
    ("\ufb03", "Ffi"), ("\ufb04", "Ffl"), ("\ufb05", "St"), ("\ufb06", "St"),
]

# --- fixed values: listing URL patterns in priority order ('' = base URL)
LISTING_PATTERNS = ["/SearchJobs", "/JobSearch", "/FolderDetail", "/JobList", "/Opportunities", ""]

# --- fixed values: duplicate thresholds and score weights
TITLE_THRESHOLD = 0.85
LOCATION_THRESHOLD = 0.90
COMBINED_THRESHOLD = 0.80
TITLE_WEIGHT = 0.7
LOCATION_WEIGHT = 0.3

# --- fixed values: extraction patterns
JOB_LINK_PATTERN = r"JobDetail|FolderDetail"
LOCATION_CLASS_PATTERN = r"location"
DESCRIPTION_CLASS_PATTERN = r"description|content|detail"
JOB_ID_PATTERN = r"/(\d+)$"
NEXT_CLASS_PATTERN = r"next|pagination"
PAGE_HREF_PATTERN = r"page=\d+"
LISTING_TEXT_PATTERN = r"jobs?\s+found|positions?\s+available|openings?"
TOTAL_PATTERNS = [r"(\d+)\s+(jobs?|positions?|openings?)", r"showing\s+\d+\s+of\s+(\d+)"]
ENDPOINT_PATTERNS = [r"/api/[^\s\"']+", r"/careers/[^\s\"']+", r"SearchJobs", r"JobDetail", r"\.json[^\s\"']*"]
API_CALL_PATTERNS = [
    r"['\"]/(api|careers)/[^'\"]+['\"]",
    r"fetch\(['\"]([^'\"]+)['\"]",
    r"\.ajax\(\{[^}]*url:\s*['\"]([^'\"]+)['\"]",
    r"axios\.[a-z]+\(['\"]([^'\"]+)['\"]",
]
RELEVANT_SCRIPT_WORDS = ["job", "search", "career", "data"]
SMART_STOP_PAGES = 5
MAX_PAGES = 100


def seniority_by_length():
    """Seniority words, longest first; ties keep dictionary order (stable sort)."""
    return sorted(SENIORITY_LEVELS, key=lambda kv: -len(kv[0]))


def regex_escape(word: str) -> str:
    """Escape a literal word for Java and RE2 patterns alike."""
    return "".join(ch if ch.isalnum() or ch == " " else "\\" + ch for ch in word)


# ---- fixed values: patterns of page markup (element, class and attribute names must match) ----

CLS = r"""class\s*=\s*(?:["'][^"']*|[^\s"'>]*)"""
PAGE_PATTERNS = {
    "article": r"(?i)<article[\s>/]",
    "job_class": r"(?i)" + CLS + "job",
    "job_link": r"""(?i)<a\s[^>]*href\s*=\s*["'][^"']*(JobDetail|FolderDetail)""",
    "listing_text": r"(?i)" + LISTING_TEXT_PATTERN,
    "search_class": r"(?i)" + CLS + "(search|filter)",
    "next_link": r"(?i)<a\s[^>]*" + CLS + "(next|pagination)",
    "page_href": r"""(?i)<a\s[^>]*href\s*=\s*["'][^"']*page=\d+""",
    "job_div": r"(?i)<div\s[^>]*" + CLS + "job",
    "job_li": r"(?i)<li\s[^>]*" + CLS + "job",
    "pagination": r"(?i)" + CLS + "pag",
    "ext_script": r"(?i)<script\s[^>]*src\s*=",
    "rel_script": r"""(?i)<script\s[^>]*src\s*=\s*["'][^"']*(job|search|career|data)""",
    "data_job": r"(?i)\sdata-job(\s*=|[\s>/])",
    "job_title_class": r"(?i)" + CLS + "job[^\"']*title",
    "job_list_class": r"(?i)" + CLS + "(job[^\"']*list|search[^\"']*result)",
    "ajax": r"(?s)\$.ajax\s*\(\s*\{[^}]+\}",
    "link": r"(?i)<a[\s>]",
    "script_body": r"(?is)<script[^>]*>(.*?)</script>",
    "meta_content": r"""(?i)<meta\s[^>]*content\s*=\s*"([^"]*)\"""",
    "ld_json": r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>""",
}

#: parts of a page that are no markup: comments, and what stands inside a script element
COMMENT_PATTERN = r"(?s)<!--.*?-->"
SCRIPT_BODY_PATTERN = r"(?is)(<script[^>]*>).*?(</script>)"
