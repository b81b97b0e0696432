"""Domain vocabularies.

Fixed values: these must equal the reference application's vocabularies for the
labels, codes and enumerations to line up. Listed in their natural order.
"""

# Complaint themes, in priority order (highest first).
THEMES = [
    "EXECUTION_SLIPPAGE",
    "LEDGER_DISPUTE",
    "SYSTEM_STABILITY",
    "LOGIN_AND_2FA_ISSUE",
    "KYC_ONBOARDING_EFFICIENCY",
    "CHARTING_UI_GLITCH",
    "GENERAL_INQUIRY",
]
DEFAULT_THEME = "GENERAL_INQUIRY"

# KYC failure reasons and their weights; then the two non-KYC bottleneck values.
KYC_REASONS = [
    "DOCUMENT_MISMATCH",
    "RE_KYC_REQUIRED",
    "SELFIE_VERIFICATION_FAILED",
    "BANK_VERIFICATION_ISSUE",
    "TECHNICAL_API_DELAY",
    "COMPLIANCE_REVIEW",
]
KYC_REASON_WEIGHTS = [0.40, 0.20, 0.15, 0.10, 0.10, 0.05]
AUTH_OTP = "2FA/OTP_NOT_RECEIVED"
AUTH_CLEARED = "CLEARED"

TIMEOUT_CODE = "FAILED TIMEOUT"
TIMEOUT_LATENCY_MS = 5000

# Sentinels and output contracts.
SQL_ERROR_SENTINEL = "ERROR_GENERATING_SQL"
INSIGHT_HEADING = "### 📊 AI Product Recommendation"
ACTIONS_HEADING = "**Immediate Actions Required:**"
ACTION_OWNERS = ["Engineering", "Infrastructure", "Product"]
INSIGHT_ERROR_PREFIX = "Error generating insight: "
