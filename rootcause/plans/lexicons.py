"""Ordered rule sets for the rule classifier (op D4). First match wins on the
lower-cased text; anything unmatched gets the default theme.

``w(...)`` wraps words in letter boundaries (see ``word_pattern``).
"""

from __future__ import annotations

from rootcause.functions.text import word_pattern as w

_CODE = "(otp|sms|t-?pin|pin|2fa code)"
_NOT_COMING = (r"((is|are|was|has|have|does|did|do)? ?(not|never|n.?t|no longer) ?(been )?(arriv|receiv|com|deliver|sent|send|get|generat)\p{L}*"
               r"|never (came|comes)|missing|delayed)")
_BETWEEN = r"(yet|still|even|receiv\p{L}*|get\p{L}*|got|been|sent|the|any|an|my|a|single)"
_DONE = r"(successful\p{L}*|succeeded|executed|completed|credited|went through|confirmed|debited)"
_STALE = (r"(not|n.?t|isn.?t|never) (refresh|updat|show|reflect|sync)\p{L}*|wrong (number|value|price|quantity|balance)|stale|frozen")

# The taxonomy's decision rules, in rule order. Overrides come
# first, each with its condition: a code that does not arrive, a demanded
# re-KYC, and a display that is wrong although the action succeeded. Then the
# priority order of the taxonomy. Symptom words (support, lag, fraud) are
# deliberately absent.
FINANCE_RULES = [
    ("LOGIN_AND_2FA_ISSUE",
     w(_CODE) + rf"[^.!?]{{0,40}}{_NOT_COMING}|(^|[^\p{{L}}])(no|not|never|without|waiting for|(is|did|do|does)n.?t) "
     rf"({_BETWEEN} ){{0,4}}{_CODE}([^\p{{L}}]|$)"),
    ("KYC_ONBOARDING_EFFICIENCY", w("re ?-?kyc")),
    ("CHARTING_UI_GLITCH", rf"{_DONE}[^.!?]{{0,80}}({_STALE})|({_STALE})[^.!?]{{0,80}}(although|even though|but)[^.!?]{{0,60}}{_DONE}"),
    ("EXECUTION_SLIPPAGE", w("buy", "sell", "bought", "sold", "orders?", "stop-?loss", "ipo", "sip", "ofs", "allotment", "slippage")),
    ("LEDGER_DISPUTE", w("deposit(s|ed)?", "withdraw(n|s|als?)?", "bank transfer", "credited", "margin penalty",
                         "auto_square_off", "auto square off", "amc_fee", "amc", "(account|ledger|cash|wallet|my) balance",
                         "balance (is|was|shows?|got|went)", "funds?")),
    ("SYSTEM_STABILITY", w(r"crash\p{L}*", "server down", "servers? (is|are) down", "outage", "not opening")),
    ("LOGIN_AND_2FA_ISSUE", w("login", "log in", "logged out", "password", "sign in")),
    ("KYC_ONBOARDING_EFFICIENCY", w("kyc", "account opening", "verification", "documents?", "segment activation")),
    ("CHARTING_UI_GLITCH", w("charts?", "indicators?")),
]
