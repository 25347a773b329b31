"""Fixed vocabularies, patterns and constants of the scorecard domain.

Everything in this module is a *fixed value*: the word lists, regular
expressions, bands and weights that decide what the operators return.  Nothing
here computes; the operators turn these tables into column expressions.
"""

from __future__ import annotations

import math

# --------------------------------------------------------------------------
# Model features, in model order, and their display labels.
# --------------------------------------------------------------------------
FEATURES = (
    "credit_debit_ratio",
    "cashflow_cv",
    "net_to_gross_ratio",
    "utility_stability",
    "min_balance",
)

FEATURE_LABELS = {
    "credit_debit_ratio": "Credit-to-Debit Ratio",
    "cashflow_cv": "Cashflow Stability",
    "net_to_gross_ratio": "Net-to-Gross Salary Ratio",
    "utility_stability": "Utility Payment Stability",
    "min_balance": "Minimum Account Balance",
}

# --------------------------------------------------------------------------
# Narration keywords of the bank features.
# --------------------------------------------------------------------------
EMI_KEYWORDS = (
    "emi", "loan", "finance", "home credit", "bajaj", "hdfc ergo", "axis finance",
    "emi payment", "ecs", "nach",
)
SALARY_KEYWORDS = ("salary", "sal", "payroll", "wages", "salary credit", "salary transfer")

# --------------------------------------------------------------------------
# Synonyms and signals of the three document extractors.
# --------------------------------------------------------------------------
BANK_SYNONYMS = {
    "credit": [
        "credit", "cr", "deposit", "deposited", "received", "inflow", "credited", "in",
        "receipt", "collection", "proceeds",
    ],
    "debit": [
        "debit", "dr", "withdrawal", "withdraw", "payment", "paid", "debited", "out",
        "expense", "charge", "transfer out", "sent",
    ],
    "account_number": [
        "account number", "account no", "account no.", "acct no", "a/c no", "a/c number",
        "acc no", "account",
    ],
}
BANK_SIGNALS = [
    "statement of account", "bank statement", "transaction history", "passbook",
    "mini statement", "account statement", "ifsc", "micr", "branch", "upi", "neft", "rtgs",
    "imps", "cheque", "chq", "ecs", "nach", "atm", "pos",
]
SALARY_SYNONYMS = {
    "gross_salary": [
        "gross salary", "gross pay", "gross earnings", "gross income", "gross wages",
        "monthly gross", "total earnings", "ctc", "cost to company", "gross amount",
        "total gross",
    ],
    "net_salary": [
        "net salary", "net pay", "net earnings", "take home", "take-home pay", "net wages",
        "net amount", "in hand", "net payable", "amount payable", "total net",
    ],
    "basic_pay": [
        "basic", "basic pay", "basic salary", "basic wage", "base pay", "base salary",
    ],
    "hra": ["hra", "house rent allowance", "housing allowance", "rent allowance"],
    "pf": [
        "pf", "epf", "provident fund", "employee pf", "employee provident fund",
        "pf deduction", "epf contribution",
    ],
    "tax": [
        "tds", "income tax", "tax deducted", "professional tax", "pt",
        "income tax deduction",
    ],
    "pay_period": ["period", "month", "for the month", "pay date", "salary for"],
}
UTILITY_SYNONYMS = {
    "bill_amount": [
        "bill amount", "total amount", "amount due", "payable amount", "net amount payable",
        "current charges", "total bill", "amount payable", "invoice amount",
        "total payable",
    ],
    "due_date": [
        "due date", "payment due", "last date", "pay by", "due by", "last date of payment",
        "payment deadline",
    ],
    "units_consumed": [
        "units", "units consumed", "consumption", "kwh", "kw", "unit consumed",
        "total units", "energy consumed",
    ],
    "consumer_number": [
        "consumer no", "consumer number", "customer no", "customer number",
        "account number", "ca no", "service no", "connection no",
    ],
    "payment_status": [
        "paid", "payment received", "receipt", "cleared", "settled", "payment confirmed",
    ],
}
UTILITY_SIGNALS = [
    "water bill", "electricity bill", "gas bill", "utility bill", "water supply",
    "water charges", "sewerage", "drainage", "municipal", "municipality", "nmc", "bmc",
    "mcgm", "pcmc", "electricity", "power bill", "energy bill", "msedcl", "bescom",
    "tpddl", "tneb", "wesco", "reliance energy", "gas connection", "piped gas", "mgl",
    "igl", "adani gas", "broadband bill", "telephone bill", "mobile bill", "postpaid",
    "consumer no", "consumer number", "ca no", "meter no", "meter number", "reading",
    "previous reading", "current reading", "units consumed", "kwh", "kilowatt",
    "bill period", "billing period", "bill date", "bill no", "bill number", "arrears",
    "current bill", "late payment",
]
HEADER_CREDIT = ["credit", "cr ", "deposit"]
HEADER_DEBIT = ["debit", "dr ", "withdrawal"]
HEADER_SEARCH_LINES = 40

# Entities each extractor is scored on: (required, optional).
EXTRACTOR_ENTITIES = {
    "BANK": (
        ["transactions", "closing_balance"],
        ["opening_balance", "account_number", "ifsc"],
    ),
    "SALARY": (
        ["net_salary"],
        ["gross_salary", "basic_pay", "hra", "pf", "tax", "deductions", "pay_period"],
    ),
    "UTILITY": (
        ["bill_amount", "payment_discipline_flag"],
        ["due_date", "units_consumed", "consumer_number", "billing_period"],
    ),
}
MIN_EXTRACTOR_CONFIDENCE = 0.25

# Keywords that settle the payment flag of a canonical utility document.
PAID_KEYWORDS = ["paid", "cleared", "received", "settled", "success", "credited"]

# --------------------------------------------------------------------------
# Date and amount patterns, tried in this order.
# --------------------------------------------------------------------------
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
_MONTH = "(?:" + "|".join(MONTHS) + ")"
DATE_PATTERNS = (
    r"\b\d{1,2}[/\-.]\d{1,2}[/\-.]\d{4}\b",
    r"\b\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2}\b",
    rf"(?i)\b\d{{1,2}}\s+{_MONTH}[a-z]*\.?\s+\d{{2,4}}\b",
    rf"(?i)\b\d{{1,2}}-{_MONTH}[a-z]*-\d{{2,4}}\b",
    r"\b\d{4}-\d{2}-\d{2}\b",
    rf"(?i)\b{_MONTH}[a-z]*\.?\s+\d{{1,2}},?\s+\d{{4}}\b",
)
AMOUNT_PATTERN = (
    r"\b(?:\d{1,2},)?(?:\d{2},)*\d{3}(?:\.\d{1,2})?\b"
    r"|\b\d{1,6}\.\d{2}\b"
)
NUMBER_TOKEN_PATTERN = r"\b[\d,]+(?:\.\d{1,2})?\b"
GROUPED_NUMBER_PATTERN = r"\d{1,3}(?:,\d{2,3})+(?:\.\d+)?"
PAN_PATTERN = r"[A-Z]{5}[0-9]{4}[A-Z]"

# --------------------------------------------------------------------------
# File suffixes a document may arrive with.
# --------------------------------------------------------------------------
TEXT_SUFFIXES = (".txt",)
PDF_SUFFIXES = (".pdf",)
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".bmp", ".tiff", ".tif", ".webp")
NATIVE_CHARS_PER_PAGE = 50
CASCADE_MIN_CHARS = 50
OCR_ACCEPT_CHARS = 100

# --------------------------------------------------------------------------
# Row quality rules (field, mandatory, kind, low, high).
# --------------------------------------------------------------------------
QUALITY_RULES = {
    "bank": (
        ("date", True, "date", None, None),
        ("amount", True, "float", 0.01, 10_000_000),
        ("type", True, "cr_dr", None, None),
        ("narration", True, "str", None, None),
        ("closing_balance", False, "float", -500_000, 50_000_000),
    ),
    "salary": (
        ("gross_salary", True, "float", 1000, 10_000_000),
        ("net_salary", True, "float", 500, 10_000_000),
        ("pf", False, "float", 0, 500_000),
    ),
    "utility": (("bill_amount", True, "float", 0.01, 500_000),),
}
REVIEW_BELOW = 0.60

# --------------------------------------------------------------------------
# Score scaling, PD limits, bands.
# --------------------------------------------------------------------------
PDO = 50
BASE_SCORE = 600
BASE_ODDS = 19
FACTOR = PDO / math.log(2)
OFFSET = BASE_SCORE - FACTOR * math.log(BASE_ODDS)
ALT_BASE_ODDS = 1 / 20
ALT_OFFSET = BASE_SCORE - FACTOR * math.log(ALT_BASE_ODDS)
SCORE_MIN, SCORE_MAX = 300, 900

PROB_EPS = 1e-6
PD_FLOOR, PD_CAP = 0.0003, 0.9999
PD_BANDS = (
    (0.001, "AAA-equivalent  (< 0.1%)"),
    (0.05, "Investment Grade (< 5%)"),
    (0.20, "Sub-investment  (< 20%)"),
    (0.40, "Speculative     (< 40%)"),
    (None, "Distressed      (≥ 40%)"),
)
RISK_TIERS = (
    (0.20, "Low Risk"),
    (0.40, "Medium Risk"),
    (0.70, "High Risk"),
    (None, "Very High Risk"),
)
SCORE_BANDS = (
    (300, 450, "Very Poor"),
    (450, 550, "Poor"),
    (550, 620, "Fair"),
    (620, 680, "Good"),
    (680, 750, "Very Good"),
    (750, 900, "Excellent"),
)
IV_STRENGTH = ((0.02, "Useless"), (0.1, "Weak"), (0.3, "Medium"), (None, "Strong"))
MAX_BINS = 6
MIN_BIN_SHARE = 0.05
MAX_PREBINS = 20

# --------------------------------------------------------------------------
# Consent window.
# --------------------------------------------------------------------------
CONSENT_MINUTES = 60
