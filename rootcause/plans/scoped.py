"""Complaint classifier that asks which noun a failure word belongs to (op D4).

A text is read once: every token becomes one character, its tag, taken from a
word table ('_' for a word of no meaning here, '|' between clauses, '.' between
sentences). All decisions are patterns over that short string, in which a clause
cannot be left and no other noun may stand between a noun and its failure. "Got
the sms, but the deposit never came" is ``VdC|dLNV``: nothing fails to come but
the deposit.

Fixed values: words and phrases of the taxonomy's decision rules, by meaning.
"""

from __future__ import annotations

from rootcause.themes import DEFAULT_THEME

#: A token: a word with inner hyphens and apostrophes, or a mark that ends a clause.
TOKEN_PATTERN = r"[\p{L}\p{N}]+(?:[-_'’][\p{L}\p{N}]+)*|[.!?;,:](?:\s|$)|\n"

_GROUPS = {
    # nouns
    "C": "otp otps sms pin pins tpin t-pin t-pins 2fa passcode",
    "T": "buy buying bought sell selling sold order orders trade trades stop-loss stoploss stoplosses ipo ipos sip sips ofs "
         "allotment slippage",
    "L": "deposit deposits deposited depositing withdraw withdraws withdrawn withdrawal withdrawals withdrawing fund funds "
         "amc amc_fee auto_square_off payout payouts",
    "c": "credited",
    "w": "balance",
    "K": "kyc verification document documents",
    "k": "rekyc re-kyc",
    "J": "login logins password passwords signin sign-in log-in",
    "D": "chart charts indicator indicators",
    "G": "dashboard portfolio screen display holdings graph watchlist",
    "h": "crash crashes crashed crashing outage outages",
    "v": "server servers",
    "O": "button buttons option options page pages link feature tab app application support team site website email mail call",
    # parts of phrases
    "a": "account", "o": "opening open opens opened", "s": "segment", "n": "activation", "B": "bank", "R": "transfer transfers",
    "M": "margin", "P": "penalty penalties", "A": "auto", "q": "square squared", "f": "off", "p": "stop", "l": "loss",
    "j": "log logged sign signed logging", "i": "in out", "e": "re", "x": "down", "m": "my ledger cash wallet",
    "b": "is are was were shows show got went goes", "t": "through",
    # what happens to them
    "N": "not no never without neither nor cannot can't cant isn't isnt aren't wasn't weren't don't dont doesn't doesnt didn't "
         "didnt haven't havent hasn't hasnt won't wont nothing unable",
    "V": "receive receives received receiving arrive arrives arrived arriving come comes coming came get gets getting deliver "
         "delivered delivering send sends sent sending generate generated generating reach reached",
    "W": "waiting awaiting wait waited",
    "F": "missing delayed delay delays late later slow slowly failed fails fail failing stuck pending blocked lost rejected "
         "declined expired vanished vanish vanishes disappeared froze",
    "S": "successful successfully succeeded executed completed confirmed debited works worked fine",
    "U": "refresh refreshes refreshed refreshing update updates updated updating showing reflect reflects reflected reflecting sync "
         "syncs synced syncing",
    "Q": "wrong incorrect", "Y": "number numbers value values price prices quantity quantities amount", "Z": "stale frozen",
    "d": "the a an any this that still even been be ever single",
    "y": "yet",  # parts clauses, but not in "not yet"
    "|": "and but although though however because so while when then or since if",
}
#: Word -> tag.
FINANCE_WORDS = {w: tag for tag, words in _GROUPS.items() for w in words.split()}

_NOUN = "CTLcwKkJDGhvO"
_GAP = rf"[^.|{_NOUN}]"            # a word of the clause that is no noun
_NO_MONEY = r"[^.|TLcw]"           # the clause so far, without a trade or cash noun
_CODE_MISSING = (rf"C{_GAP}*(N{_GAP}*V|F)"                              # the code was not received, is missing
                 rf"|Nd*C|N{_GAP}{{0,3}}V{_GAP}{{0,4}}C|W{_GAP}{{0,3}}C")  # no code, did not get the code, waiting for the code
_REKYC = "k|eK"
_SUCCESS = r"(^|[.|])[^.|N]*([TLw][^.|N]*([Sc]|bt)|[Sc][^.|N]*[TLw]|c)"
_STALE = rf"(^|[.|]){_NO_MONEY}*(N{_NO_MONEY}{{0,2}}U|Q_?[Yw]|Z)"
_SETTLED = r"(^|[.|])[^.|NFQZ]*([TL][^.|NFQZ]*S|S[^.|NFQZ]*[TL])[^.|NFQZ]*"
#: Nouns that can be a complaint, in priority order of the taxonomy.
NOUN_RULES = [
    ("EXECUTION_SLIPPAGE", "T|pl"),
    ("LEDGER_DISPUTE", "[Lc]|BR|MP|Aqf|[am]w|wb"),
    ("SYSTEM_STABILITY", "h|vb?x|N_?o"),
    ("LOGIN_AND_2FA_ISSUE", "J|ji"),
    ("KYC_ONBOARDING_EFFICIENCY", "K|ao|sn"),
    ("CHARTING_UI_GLITCH", "D"),
]
_ANY_NOUN = "|".join(p for _, p in NOUN_RULES)


def tags_sql(text: str, words: dict[str, str]) -> str:
    """Spark SQL text of the tag string: one look at the text, one set test for
    a word of no meaning."""
    def listed(ws):
        return ", ".join("'" + w.replace("'", "\\'") + "'" for w in ws)
    by_tag: dict[str, list[str]] = {}
    for w, tag in words.items():
        by_tag.setdefault(tag, []).append(w)
    whens = " ".join(f"WHEN w IN ({listed(ws)}) THEN '{tag}'" for tag, ws in by_tag.items())
    return (f"array_join(transform(regexp_extract_all(lower({text}), r\"{TOKEN_PATTERN}\", 0), w -> CASE "
            f"WHEN w IN ({listed(words)}) THEN (CASE {whens} END) WHEN ascii(w) IN ({_ascii('.!?' + chr(10))}) THEN '.' "
            f"WHEN ascii(w) IN ({_ascii(';,:')}) THEN '|' ELSE '_' END), '')")


def _ascii(marks: str) -> str:
    return ", ".join(str(ord(m)) for m in marks)


def parted(tags: str) -> str:
    """"yet" parts two clauses unless it belongs to a "not"."""
    return f"replace(replace({tags}, 'Ny', 'Nd'), 'y', '|')"


def label_sql(tags: str, matches, replace, default: str = DEFAULT_THEME) -> str:
    """The label of a tag string as SQL; ``matches(string, pattern)`` and
    ``replace(string, pattern, by)`` render the engine's functions."""
    # Clauses that tell of a success are no complaint while another clause has one.
    left = replace(tags, _SETTLED, "\\1")
    nouns = f"(CASE WHEN {matches(left, _ANY_NOUN)} THEN {left} ELSE {tags} END)"
    whens = " ".join(f"WHEN {matches(nouns, p)} THEN '{label}'" for label, p in NOUN_RULES)
    return (f"CASE WHEN {matches(tags, _CODE_MISSING)} THEN 'LOGIN_AND_2FA_ISSUE' "
            f"WHEN {matches(tags, _REKYC)} THEN 'KYC_ONBOARDING_EFFICIENCY' "
            f"WHEN {matches(tags, _SUCCESS)} AND {matches(tags, _STALE)} THEN 'CHARTING_UI_GLITCH' "
            f"{whens} ELSE '{default}' END")
