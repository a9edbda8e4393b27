"""Fixed values of the document operators: labels, patterns, anchors, word lists and limits, as Java patterns."""

# --- fixed values ---
SECTION_LABELS = ("1", "1A", "7", "7A")
#: A header or mention of a numbered item; the group is its number. Compared in upper case.
ITEM_AT_START = r"(?i)^Item[\s\xA0]*([0-9]{1,2}[A-C]?)\b"
ITEM_MARK = r"(?i)(\bItem[\s\xA0]*(?=[0-9]))"
#: The items that end a section.
ENDERS = {"1": ("1A", "1B", "2"), "1A": ("1B", "2"), "7": ("7A", "8"), "7A": ("8",)}
MIN_CHARS = {"1": 10000, "1A": 8000, "7": 10000, "7A": 3000}
CONTENTS = r"(?i)\bTable of Contents\b"
CROSS_REFERENCE = r"(?i)\b(see|refer to|as discussed in)\b|(?:of|in)\s+Part\s+[IVXLC]+\b"
RELATING = r"(?i)\b(relating to|related to|with respect to)\b"
ANCHORS = {
    "1": (r"(?i)\bBusiness\b", r"(?i)\bOverview\b"),
    "1A": (r"(?i)Risk Factors", r"(?i)material risks", r"(?i)could adversely affect"),
    "7": (r"(?i)Management.?s Discussion", r"(?i)Results of Operations", r"(?i)Liquidity and Capital Resources", r"(?i)Critical Accounting"),
    "7A": (r"(?i)Quantitative and Qualitative", r"(?i)Market Risk", r"(?i)Interest Rate Risk", r"(?i)Foreign Currency", r"(?i)Commodity Price"),
}
ALTERNATIVE_7A = (
    r"(?i)(\bQuantitative\s+and\s+Qualitative\s+Disclosure[s]?\s+About\s+Market\s+Risk\b)",
    r"(?i)(\bQuantitative\s+and\s+Qualitative\s+Disclosures?\s+About\s+Market\s+Risks?\b)",
    r"(?i)(\bMarket\s+Risk[s]?\s+Disclosures?\b)",
)
GOOD_TERMS = (r"(?i)\bFORM\s*10[-\s]*K\b", r"(?i)\bANNUAL\s+REPORT\b")
TARGET_HEADERS = (r"(?i)\bItem[\s\xA0]*1\b(?!A\b)", r"(?i)\bItem[\s\xA0]*1A\b", r"(?i)\bItem[\s\xA0]*7[\s\xA0]*\.?(?!A\b)", r"(?i)\bItem[\s\xA0]*7A\b")
BAD_NAME_HINTS = ("index", "cover", "toc", "table", "summary", "xbrl", "xml", "exhibit", "wrap", "presentation", "press")
#: What marks a page as XML.
XML_PROLOG = r"^(?U)\s*<\?xml"
XBRL_TAG = r"(?i)<(xbrli:|xbrl[ >])"
XML_DOCUMENT = r"""(?i)</?DOCUMENT[^>]*type=['"]XML['"]"""
CAPITALIZED = r"(?U)\b[A-Z][A-Za-z0-9&\-.’']{1,}\b"
NO_BRANDS = (
    "United States", "U.S.", "US", "USA", "SEC", "GAAP", "IFRS", "FASB", "OECD",
    "NYSE", "NASDAQ", "S&P", "Moody's", "Fitch", "COVID-19", "LIBOR", "SOFR",
)
PLACEHOLDER = "<BRAND>"
LABELS = ("positive", "neutral", "negative")

# --- values of this project ---
#: Candidate columns of section files, the first present one counts.
SECTION_COLUMNS = ("section", "item", "header")
TEXT_COLUMNS = ("text", "content", "body")
SOURCE_COLUMNS = ("source_doc", "source", "doc", "filename")
#: A small lexicon for the offline scorer; it stands in for a model and is none.
POSITIVE_WORDS = ("gain", "gains", "growth", "improved", "increase", "increased", "profit", "strong", "favorable", "expanded", "accelerated", "stable", "robust", "recovered")
NEGATIVE_WORDS = ("loss", "losses", "decline", "decreased", "impaired", "risk", "adverse", "weak", "delayed", "dispute", "abrupt", "volatile", "contested", "curtailed")
#: Abbreviations of the plain sentence splitting, as alternatives of a pattern, without their last full stop.
NEVER_ENDS = r"Mr|Mrs|Ms|Messrs|Dr|Prof|Rev|Hon|Gen|Sen|Rep|Gov|St|vs|cf|approx|e\.g|i\.e|et al|Reg|Ref|Ex|Vol|pp"
BEFORE_FIGURES = r"No|Nos|Note|Item|Art|Sec|Fig|Figs|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept|Sep|Oct|Nov|Dec"
MAY_END = r"Inc|Corp|Co|Ltd|LLC|Jr|Sr|U\.S|U\.K|U\.S\.A|etc"
OPENERS = r"The|A|An|We|Our|It|Its|This|These|That|They|Their|He|She|In|On|At|As|For|If|When|While|However|There|No|All|Each|Such|Any"
