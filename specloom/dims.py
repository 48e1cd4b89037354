"""Fixed values that the results depend on: keyword levels, lexicons, negations, limits."""

from __future__ import annotations

# Requirement levels, in the order in which alternatives are tried.
LEVELS = ("MUST NOT", "MUST", "REQUIRED", "SHALL NOT", "SHALL", "SHOULD NOT", "SHOULD", "RECOMMENDED", "NOT RECOMMENDED", "MAY", "OPTIONAL")

# The class of each level in checklists.
CLASSES = {
    "must": ("MUST", "MUST NOT", "REQUIRED", "SHALL", "SHALL NOT"),
    "should": ("SHOULD", "SHOULD NOT", "RECOMMENDED", "NOT RECOMMENDED"),
    "may": ("MAY", "OPTIONAL"),
}

# Levels of requirements that a statement of a level conflicts with.
CONFLICTS = {
    "MAY": ("MUST", "MUST NOT", "SHALL", "SHALL NOT"),
    "OPTIONAL": ("MUST", "MUST NOT", "REQUIRED", "SHALL", "SHALL NOT"),
    "SHOULD": ("MUST NOT", "SHALL NOT"),
    "SHOULD NOT": ("MUST", "SHALL", "REQUIRED"),
    "RECOMMENDED": ("MUST NOT", "SHALL NOT"),
    "NOT RECOMMENDED": ("MUST", "SHALL", "REQUIRED"),
}

# Words that weigh more in statement matching.
TECHNICAL_TERMS = (
    "client server sender receiver endpoint connection request response message packet segment frame header payload handshake "
    "port socket stream timeout retransmit acknowledgment sequence congestion method status resource cache proxy origin "
    "authentication authorization certificate encryption signature token "
    "implementation specification protocol algorithm parameter field value error failure valid invalid"
).split()

# Words that statement matching ignores.
STOP_WORDS = (
    "the this that with from have been will when where what which there their they them than then each other some such only also "
    "more most case does into over used same after before about being could would should"
).split()

# Words that name the actor.
SUBJECT_TERMS = "client server sender receiver endpoint implementation peer host proxy application user agent".split()

# Actions and their negations.
NEGATIONS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("mask", ("unmask", "unmasked", "not mask", "without mask", "without masking")),
    ("encrypt", ("unencrypt", "unencrypted", "not encrypt", "without encrypt", "without encryption")),
    ("validate", ("not validate", "skip validation", "skips validation", "without validation", "no validation")),
    ("verify", ("not verify", "unverified", "without verification", "skip verification")),
    ("authenticate", ("unauthenticated", "not authenticate", "without authentication", "skip authentication")),
    ("send", ("not send", "never send", "block")),
    ("receive", ("not receive", "reject", "ignore")),
    ("accept", ("reject", "not accept", "refuse")),
    ("include", ("exclude", "omit", "not include")),
    ("support", ("not support", "unsupported")),
    ("allow", ("disallow", "not allow", "forbid", "prohibit")),
    ("enable", ("disable", "not enable")),
    ("close", ("not close", "keep open")),
    ("open", ("not open", "close")),
)

# Words that make a numbered line a section header.
HEADER_WORDS = (
    "introduction overview background requirements specification protocol format security considerations references "
    "acknowledgments appendix terminology definitions abstract scope normative informative implementation examples error status codes messages operations"
).split()

# Weights and limits of statement matching.
REGULAR_WEIGHT, TECHNICAL_WEIGHT, SUBJECT_WEIGHT, SUBJECT_BONUS, LEVEL_BONUS = 1, 2, 3, 5, 3
MIN_KEYWORD, MIN_OVERLAP, SHORT_STATEMENT, TOP_MATCHES, PRIMARY_WITHIN = 3, 2, 3, 10, 20

# Limits of headers, titles, definitions and document numbers.
MAX_DEPTH, MAX_FIRST_NUMBER, TITLE_LINES, TITLE_LONGER_THAN, TITLE_SHORTER_THAN = 5, 99, 30, 10, 100
MIN_TERM, MIN_DEFINITION = 2, 10
MIN_NUMBER, MAX_NUMBER, XML_FROM = 1, 99_999, 8650

# Notes on results from plain text.
TEXT_NOTES = {
    "structure": "Warning: Parsed from text format. Accuracy may be limited.",
    "requirements": "Warning: Parsed from text format. Requirement extraction accuracy may be limited.",
    "definitions": "Warning: Parsed from text format. Definition extraction accuracy may be limited.",
    "sections": "Warning: Parsed from text format. Related section accuracy may be limited.",
    "checklist": "Warning: Parsed from text format. Checklist accuracy may be limited.",
    "validation": "Warning: Parsed from text format. Validation accuracy may be limited.",
    "dependencies": "Warning: Parsed from text format. Reference information is not available.",
}
