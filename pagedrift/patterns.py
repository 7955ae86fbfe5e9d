"""Fixed values of the change rules: regular expressions, word lists and limits.

The expressions use the usual ASCII meaning of ``\\w``, ``\\d`` and ``\\b`` and the
wide (Unicode) meaning of ``\\s``.  Java's ``\\b`` and ``\\s`` differ, so every
expression goes through :func:`java_regex` before it reaches Spark.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

# Blanks that trimming and ``\s`` cover (written so that it fits into a class).
BLANKS = (
    r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
    r"\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
# The same as a class of its own for Java: one range tells the rare ones from all other characters.
JAVA_BLANKS = (
    r"\t-\r \x{A0}[\x{1680}-\x{FEFF}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
    r"\x{202F}\x{205F}\x{3000}\x{FEFF}]]"
)
BLANK_CHARS = (
    "\t\n\x0b\f\r \u00a0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
WORD_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
LINE_REST = r"[^\n\r\x{2028}\x{2029}]"


def _rewrite(pattern: str, edge: str, blanks: str = BLANKS) -> str:
    out: list[str] = []
    in_class = False
    i = 0
    while i < len(pattern):
        pair = pattern[i : i + 2]
        if pair == r"\s":
            out.append(BLANKS if in_class else f"[{blanks}]")
            i += 2
        elif pattern.startswith(r"[^\S ]", i):
            out.append("[" + blanks.replace(" ", "") + "]")
            i += 6
        elif pair == r"\S":
            out.append(f"[^{BLANKS}]")
            i += 2
        elif pair == r"\b":
            out.append(edge)
            i += 2
        elif pattern[i] == "\\":
            out.append(pair)
            i += 2
        else:
            if pattern[i] == "[" and not in_class:
                in_class = True
            elif pattern[i] == "]" and in_class:
                in_class = False
            out.append(pattern[i])
            i += 1
    return "".join(out)


def _leading_edge(pattern: str) -> str:
    """A word edge at the very start, before a word character, as a cheap test.

    The character itself is looked at first: that settles nearly every position.
    """
    found = re.match(r"(\(\?i\))?\\b(?:(\\d|\[A-Z0-9\]|[a-z])|\(\?:((?:[a-z][^|()]*\|?)+)\))", pattern)
    if not found:
        return pattern
    flags, atom, words = found.groups()
    first = atom or "[" + "".join(sorted({w[0] for w in words.split("|")})) + "]"
    start = (flags or "") + f"(?={first})(?<!\\w)"
    return start + pattern[len(flags or "") + 2 :]


@lru_cache(maxsize=None)
def java_regex(pattern: str) -> str:
    """The pattern with ASCII word edges and wide blanks spelled out for Java."""
    return _rewrite(_leading_edge(pattern), WORD_EDGE, JAVA_BLANKS)


def collapsed_regex(pattern: str) -> str:
    """Like :func:`java_regex`, for texts in which every run of blanks is one space."""
    return java_regex(
        pattern.replace(r"\s+", " ").replace(r"\s*", " ?").replace(r"\s", " ")
    )


def re2_regex(pattern: str) -> str:
    """The same pattern for an RE2 engine, whose ``\\b`` is ASCII already."""
    return _rewrite(pattern, r"\b")


def starts(words: Sequence[str]) -> str:
    """A class pair that holds wherever one of the lower-case ``words`` starts, in either case."""
    first = sorted({w[0] for w in words})
    second = sorted({w[1] for w in words})
    return "(?i:[" + "".join(first) + "][" + "".join(second) + "])"


# --- fixed values: text normalisation, in order; every match is removed --------
NORMALIZE_REMOVALS = (
    r"\b\d{1,2}/\d{1,2}/\d{2,4}\b",
    r"\b\d{4}-\d{2}-\d{2}\b",
    r"(?i)\b\d{1,2}:\d{2}(?::\d{2})?\s*(?:AM|PM)?\b",
    r"\b[A-Z0-9]{8,}\b",
    r"(?i)\bref:\S*",
    r"(?i)\butm_\S*",
    r"(?i)\btrack\S*",
    r"(?i)\bid[:=]\S*",
    r"(?i)\b\d+,?\d*\s*(?:views?|clicks?|visits?)\b",
    r"(?i)\b(?:updated|modified|posted)[:]\s*" + LINE_REST + "*",
    r"(?i)\([^)]*(?:updated|modified|posted)[^)]*\)",
)
NORMALIZE_COLLAPSE = (
    (r"[ \t]{2,}|\t", " "),
    (r"\n\s*\n\s*", "\n"),
)

# --- fixed values: noise phrases, in order; every match is removed -------------
NOISE_REMOVALS = (
    r"(?i)\b(?:limited time|act now|hurry|expires soon|while supplies last)\b",
    r"(?i)\b(?:call now|book today|reserve now|don't wait)\b",
    r"\*+[^*]*\*+",
    r"(?i)\([^)]*terms[^)]*\)",
    r"(?i)\([^)]*conditions[^)]*\)",
    r"(?i)\([^)]*restrictions[^)]*\)",
    r"(?i)\b\d+,?\d*\s*(?:people|customers|travelers)\s+(?:booked|viewed|saved)\b",
    r"(?i)\b(?:trending|popular|bestseller|top rated)\b",
)
NOISE_EDGE_MARKS = r"\A\s*!\s*|\s*!\s*\z"

# --- fixed values: what makes a record immaterial ------------------------------
IMMATERIAL_TEXT = (
    r"\b(?:loading|please wait|error|404|not found)\b",
    r"\b(?:javascript|enable|browser|update)\b",
    r"\b(?:cookie|privacy|terms|legal)\b",
    r"\b(?:advertisement|sponsored|ad)\b",
    r"\A[\s\W]*\z",
    r"\A" + LINE_REST + r"{1,5}\z",
)
HAS_PRICE = r"\$[\d,]+"
MIN_TITLE, MIN_PERK, MIN_DATES = 3, 10, 5

# --- fixed values: similarity --------------------------------------------------
TEXT_SIMILARITY = 0.85
PRICE_TOLERANCE_RATIO = 0.01
PRICE_TOLERANCE_MIN = 1.0
DATE_TOLERANCE_DAYS = 7
PRICE_NUMBER = r"\$?([\d,]+(?:\.\d{2})?)"
DATE_MDY = r"\b(\d{1,2})/(\d{1,2})/(\d{2,4})\b"
DATE_ISO = r"\b(\d{4})-(\d{2})-(\d{2})\b"
DATE_MONTH_NAME = (
    r"(?i)\b(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w*\s+(\d{1,2}),?\s+(\d{4})\b"
)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

# --- fixed values: markup ------------------------------------------------------
SCRIPT_BLOCK = r"(?s)<script[^>]*>.*?</script>"
STYLE_BLOCK = r"(?s)<style[^>]*>.*?</style>"
TAG = r"<[^>]*>"
ENTITIES = (
    ("&quot;", '"'),
    ("&#x27;", "'"),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&nbsp;", " "),
    ("&diams;", "♦"),
    ("&clubs;", "♣"),
    ("&hearts;", "♥"),
    ("&spades;", "♠"),
    ("&bull;", "•"),
    ("&#8226;", "•"),
)
ARTIFACT_PREFIXES = (
    (r"(?i)\A\s*[a-z]{2,4}:\s*", ""),
    (r"(?i)\A\s*nbsp;\s*", ""),
    (r"(?i)\A\s*tant\s", "Instant "),
    (r"(?i)\A\s*gital\s", "Digital "),
    (r"(?i)\A\s*or\s+call\s+", ""),
    (r"(?i)\A\s*Home\s+Vacation\s+Packages\s*", ""),
)

# --- fixed values: message escaping --------------------------------------------
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
UNSAFE_ESCAPED = (
    r"(?is)&lt;script[^&]*&gt;.*?&lt;/script&gt;",
    r"(?is)&lt;iframe[^&]*&gt;.*?&lt;/iframe&gt;",
    r"(?is)&lt;object[^&]*&gt;.*?&lt;/object&gt;",
    r"(?i)&lt;embed[^&]*&gt;",
    r"(?i)&lt;link[^&]*&gt;",
    r"(?i)&lt;meta[^&]*&gt;",
    r"(?i)javascript:",
    r"(?i)data:text/html",
    r"(?i)on\w+\s*=",
)
MARKDOWN_MARKS = ("*", "_", "~", "`")
MESSAGE_TEXT_LIMIT = 3000

# --- fixed values: url and selector policy -------------------------------------
HTTPS_HOST = r"\A[\x00-\x20]*(?i:https)://(?:[^/?#\\]*@)?([^/?#\\:@\s]+)"
BLOCKED_HOST_PREFIX = (
    r"\A(?:127\.|10\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|192\.168\.)"
)
BLOCKED_HOSTS = ("localhost", "169.254.169.254", "metadata.google.internal")
BLOCKED_HOST_SUFFIXES = (".internal", ".local")
BLOCKED_HOST_PART = "169.254."
SELECTOR_SAFE = r"\A[.#]?[\w\-\s,.:>\[\]=\"'()]+\z"
SELECTOR_UNSAFE = r"(?i)javascript:|expression\(|url\(|@import|behavior:"
SELECTOR_LIMIT, NAME_LIMIT, NOTES_LIMIT = 200, 100, 500
NAME_UNSAFE = r"<[^>]+>|(?i:javascript:)"
NOTES_UNSAFE = r"(?i)<script[^>]*>|javascript:"

# --- fixed values: record fields inside a container ----------------------------
TITLE_HEADING = r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>"
FIELD_CLASSES = {
    "title": ("title", "headline", "promotion-title"),
    "perk": ("perk", "benefit", "offer", "deal-text"),
    "dates": ("dates", "validity", "valid-dates", "duration"),
    "price": ("price", "cost", "rate", "amount"),
}
PERK_PARAGRAPH = r"(?is)<p[^>]*>(.*?)</p>"
BLOCK_MIN = 10
BLOCK_PRICE = r"(?i)\$[\d,]+(?:\.\d{2})?|\$\d+\s*-\s*\$\d+|from\s+\$[\d,]+"
BLOCK_DATES = (
    r"(?i)(?:valid|expires?|through|until|from|dates?)[:\s]+[^.!?]*(?:\d{4}|\d{1,2}/\d{1,2})"
)
BLOCK_PERK = r"(?i)(?:free|complimentary|includes?|bonus|upgrade|perk)[:\s]+[^.!?]*"
# Looked at before these are tried; each holds wherever the pattern matches.
BLOCK_STARTS = {
    BLOCK_PRICE: r"(?=[$fF])",
    BLOCK_DATES: "(?=" + starts(("valid", "expire", "through", "until", "from", "date")) + ")",
    BLOCK_PERK: "(?=" + starts(("free", "complimentary", "include", "bonus", "upgrade", "perk")) + ")",
}


def class_element(names: tuple[str, ...]) -> str:
    """An element whose class attribute holds one of ``names``; group 1 is its content."""
    return (
        r'(?is)<[^>]*class="[^"]*\b(?:' + "|".join(names) + r')\b[^"]*"[^>]*>(.*?)</[^>]*>'
    )


def class_gate(pattern: str) -> str | None:
    """For a :func:`class_element`, an expression that is found faster and holds wherever that one matches."""
    names = re.search(r'class="\[\^"\]\*\\b\(\?:([a-z|-]+)\)', pattern)
    return names and r'(?i)class="[^"]*(?:' + names.group(1) + ")"


# --- fixed values: page summary ------------------------------------------------
SUMMARY_CLASSES = (
    "promo", "deal-info", "savings", "hot-buy", "offer-details", "deal-card", "package-card",
    "offer-card",
)
PAGE_TITLE = r"(?i)<title[^>]*>(" + LINE_REST + r"*?)</title>"
PAGE_META = r"""(?i)<meta[^>]*name=["']description["'][^>]*content=["']([^"']*)["']"""
NO_TITLE = "No title found"
DATE_MENTION = (
    r"(?i)(?:valid|expires?|through|until|book\s+by|travel\s+by)[^.!?]{0,80}?"
    r"(?:\d{1,2}/\d{1,2}/\d{2,4}|\d{4}-\d{2}-\d{2}"
    r"|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{1,2},?\s+\d{4})"
)
PRICE_MENTION = r"([^.!?]{0,40})(\$[\d,]+(?:\.\d{2})?)([^.!?]{0,40})"
PRICE_BEFORE_WORDS = ("from", "starting", "as low as")
PRICE_AFTER_WORDS = ("night", "person", "package")
PLACES = (
    "hawaii", "vegas", "caribbean", "mexico", "europe", "asia", "cancun", "cabo", "maui",
    "bahamas", "jamaica",
)
# What a page report shows at most: prices, dates, places, deals.
REPORT_PRICES, REPORT_DATES, REPORT_PLACES, REPORT_DEALS = 5, 2, 5, 8
SUMMARY_PRICES, SUMMARY_PLACES = 3, 2

# --- fixed values: deals in free page text -------------------------------------
HOTEL_WORDS = (
    r"hotel|resort|inn|lodge|suites?|grand|palace|plaza|hyatt|marriott|hilton|sheraton|westin"
    r"|renaissance|courtyard|doubletree|embassy|hampton|holiday|fairmont|four\s+seasons"
    r"|ritz[\-\s]?carlton|st\.?\s+regis"
)
HOTEL_PLACES = (
    "las vegas|hawaii|caribbean|europe|asia|mexico|cancun|cabo|puerto vallarta|maui|oahu|kauai"
    "|big island|bahamas|jamaica|costa rica|belize|paris|london|rome|tokyo|dubai"
)
HOTEL_DEAL = (
    r"(?i)([A-Z][^.!?]{10,80}(?:" + HOTEL_WORDS + r")[^.!?]{0,40})[^.!?]{0,100}?"
    r"(\$[\d,]+(?:\.\d{2})?)"
)
PLACE_DEAL = (
    r"(?i)((?:" + HOTEL_PLACES + r")[^.!?]{5,80})[^.!?]{0,80}?(\$[\d,]+(?:\.\d{2})?)"
)
DEAL_PRICE_END = r"\$[\d,]+(?:\.\d{2})?\z"
DEAL_PLACE = (
    r"(?i)(las vegas|hawaii|caribbean|europe|asia|mexico|cancun|cabo|los cabos|puerto vallarta"
    r"|maui|oahu|kauai|big island|hawaii island|bahamas|jamaica|costa rica|belize|paris|london"
    r"|rome|tokyo|dubai|florida|california|new york|orlando|miami)"
)
DEAL_PLACE_LABEL = r"([A-Z][a-z]+)\s*:"
DEAL_PLACE_AFTER = r":\s*([A-Z][^,\n]{10,40})"
TITLE_BREAKS = (
    r"(?i)\A([^:]{15,80}:?\s*[^:]{10,40})\s+Package",
    r"(?i)\A([^.]{20,90})\s+\$\d+",
    r"(?i)\A([^.]{15,80})\s+(?:Exclusive|Save|Book by)",
    r"\A([^:]{15,80}):",
    r"\A([^.]{15,80})\.",
    r"(?i)\A(" + LINE_REST + r"{20,80})(?:\s+Package|\s+\$)",
    r"\A(" + LINE_REST + r"{20,70})\z",
)
NEAR_SAVINGS = r"(?i)save\s+(?:up\s+to\s+)?(\$[\d,]+)|(\d+)%\s+off|(was\s+)?(\$[\d,]+)"
NEAR_DATES = (
    r"(?i)(?:valid|through|until|expires?)[^.!?]{0,40}?"
    r"(\d{1,2}/\d{1,2}/\d{2,4}|\d{4}-\d{2}-\d{2})"
)
PACKAGE_DEAL = (
    r"(?i)([^.!?]{20,100}(?:package|vacation|getaway|escape|deal)[^.!?]{0,40})"
    r"\s+from\s+(\$[\d,]+)"
)
SAVINGS_DEAL = r"(?i)([^.!?]{20,80})\s+save\s+(up\s+to\s+)?(\$[\d,]+|\d+%)"
CREDIT_DEAL = (
    r"(?i)([^.!?]{10,150}(?:\$\d+[^.!?]{20,200}resort\s+credit[^.!?]{0,100}"
    r"|waived[^.!?]{20,100}resort\s+fee[^.!?]{0,100}|included\s+extras[^.!?]{20,150}))"
)
CREDIT_TITLE = r"(?i)(\$\d+[^.!?]*resort\s+credit[^.!?]*)"
WAIVER_TITLE = r"(?i)(waived[^.!?]*resort\s+fee[^.!?]*)"
EXTRAS_TITLE = r"(?i)(included\s+extras[^.!?]*)"
CREDIT_PRICE = r"\$[\d,]+"
CREDIT_SAVINGS = r"(?i)\$[\d,]+\s*value|\$[\d,]+\s*per\s+day"

# --- fixed values: per-site deal rules, in order --------------------------------
SITE_RULE_CODE = "HAWLIH1HOTELHANALEIBAY20230309"
SITE_RULES = (
    {
        "url_contains": SITE_RULE_CODE,
        "pattern": r"(?i)\$300\s+resort\s+credit[^.!?]{0,100}(?:per\s+room[^.!?]*)?"
        r"(?:per\s+stay[^.!?]*)?",
        "title": "$300 Resort Credit", "price": "$300", "savings": None, "location": "Kauai",
    },
    {
        "url_contains": SITE_RULE_CODE,
        "pattern": r"(?i)waived\s+(?:mandatory\s+)?(?:daily\s+)?resort\s+fee[^.!?]{0,150}"
        r"(?:\$59[^.!?]{0,50})?(?:value[^.!?]{0,20})?(?:per\s+day[^.!?]*)?",
        "title": "Waived Daily Resort Fee", "price": None, "savings": "$59 per day",
        "location": "Kauai",
    },
    {
        "url_contains": SITE_RULE_CODE,
        "pattern": r"(?i)included\s+extras[^.!?]{0,100}\$536[^.!?]{0,100}four[^.!?]*night"
        r"[^.!?]*stay",
        "title": "Included Extras Value", "price": "$536", "savings": None, "location": "Kauai",
    },
    {
        "url_contains": SITE_RULE_CODE,
        "pattern": r"(?i)(?:kauai[^.!?]{0,20})?1\s+hotel\s+hanalei\s+bay[^.!?]{0,100}package"
        r"[^.!?]{0,150}",
        "title": "Kauai: 1 Hotel Hanalei Bay Package", "price": None, "savings": None,
        "location": "Kauai",
    },
)
