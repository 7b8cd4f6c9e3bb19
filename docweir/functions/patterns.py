"""Every regular expression of the library, with explicit flags.

``(?U)`` gives Unicode word boundaries and classes, ``(?dm)`` makes only a line
feed end a line, ``(?iu)`` folds Cyrillic case.  ``\\d`` next to ``(?U)`` covers
all decimal digits.
"""

# Patterns of personal data, in the order they are redacted.
REDACTIONS = [
    (r"(?U)\b\d{14}\b", "<PINFL>"),
    (r"(?U)\b[A-Z]{2}\s?\d{6,8}\b", "<DOCNO>"),
    (r"P<[A-Z]{3}[A-Z0-9<]{20,}", "<MRZ>"),
    (r"(?dm)^[A-Z0-9<]{28,44}$", "<MRZ>"),
    (r"(?U)\b[\w.+-]+@[\w-]+\.[\w.]+\b", "<EMAIL>"),
    (r"(?U)(?<!\d)(?:\+998|998)?\d{9}(?!\d)", "<PHONE>"),
    (r"(?U)\b(?:sk|AIza)[A-Za-z0-9_\-]{12,}\b", "<APIKEY>"),
    (r"(?iuUd)\b\d{4}-\d{2}-\d{2}\b(?=.*(?:tug|birth|рожд))", "<DATE>"),
]

# Signals that a text carries real identity data.
PINFL_SIGNAL = r"(?U)\b\d{14}\b"
DOC_NUMBER_SIGNAL = r"(?U)\b[A-Z]{2}\s?\d{7}\b"
MRZ_LINE_SIGNAL = r"(?dm)^[A-Z0-9<]{28,44}$"
PASSPORT_SIGNAL = r"P<[A-Z]{3}[A-Z<]{10,}"

# Shapes used by the label rules.
RULE_DATE = r"(?U)\b(\d{1,2})[.\-/](\d{1,2})[.\-/](\d{4})\b"
RULE_ISO = r"(?U)\b(\d{4})-(\d{2})-(\d{2})\b"
RULE_PINFL = r"(?U)\b(\d{14})\b"
RULE_DOC_NUMBER = r"(?U)\b([A-Z]{2}\s?\d{6,8})\b"
RULE_SEX = r"(?U)\b([MFМЖ])\b"
RULE_YEAR = r"(?U)\b((?:19|20)\d{2})\b"

# Date shapes accepted as evidence for a date.
DATE_YMD = r"(\d{4})[-./](\d{1,2})[-./](\d{1,2})"
DATE_DMY = r"(\d{1,2})[-./](\d{1,2})[-./](\d{4})"
DATE_RUN = r"(?U)\b(\d{8})\b"

# Template tags and identifiers no template may contain.
VARIABLE = r"\{\{\s*([^}]+?)\s*\}\}"
LOOP = r"(?U)\{%\s*(?:tr\s+)?for\s+(\w+)\s+in\s+([\w.\[\]]+)"
CONDITIONAL = r"(?U)\{%\s*if\s+(.+?)\s*%\}"
TAG = r"(?s)\{\{(.*?)\}\}|\{%(.*?)%\}"
INJECTION = (r"(?U)(__class__|__mro__|__subclasses__|__globals__|__builtins__|__base__|"
             r"__bases__|__init__|__import__|__getattribute__|__reduce__|"
             r"\bself\b|\bconfig\b|\brequest\b|\bcycler\b|\bjoiner\b|"
             r"\bnamespace\b|\blipsum\b)")
