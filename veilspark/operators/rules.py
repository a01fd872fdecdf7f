"""Detection rules as data.

A pattern is ``before`` + ``value`` + ``after``; the value is what is found, the
rest is context. Patterns use only syntax that Java and Python read alike: ASCII
classes are spelled out, ``{B}`` is a blank, ``{END}`` the end of the text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

#: Blanks, as in the class \s of browsers.
BLANK = "\\t\\n\\x0b\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
_WORD_START, _WORD_END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


@dataclass(frozen=True)
class Rule:
    name: str
    pii_class: str
    score: float
    value: str
    before: str = ""
    after: str = ""
    ignore_case: bool = False
    validator: str | None = None
    context: str | None = None
    window: int = 48
    #: One of these must occur in the text (lower-cased if ignore_case); a cheap test before the pattern.
    needs: tuple[str, ...] = field(default=())
    needs_digits: int = 0
    #: One of these must occur in the lower-cased text, whatever the case of the rule.
    needs_low: tuple[str, ...] = field(default=())


# Classes, those never released, and the rules' words.
CLASSES = (
    "PERSON", "EMAIL", "PHONE", "AADHAAR", "AADHAAR_VID", "PAN", "GSTIN", "IFSC", "BANK_ACCOUNT", "CARD", "CARD_CVV", "CARD_EXPIRY",
    "UPI", "DOB", "ADDRESS", "PINCODE", "PASSPORT", "VOTER_ID", "DRIVING_LICENCE", "OTP", "PASSWORD", "USERNAME", "IP_ADDRESS", "SECRET",
)
NEVER_RELEASE = ("PASSWORD", "OTP", "CARD_CVV", "SECRET")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec")
PERSON_LABELS = (
    "full name", "applicant name", "name of applicant", "father name", "mother name", "bill to", "billed to", "ship to", "consignee", "beneficiary", "account holder",
    "card holder", "customer", "passenger", "patient", "payee", "payer", "nominee", "sender", "recipient", "guardian", "name",
)
SALUTATIONS = ("dear", "hello", "hi", "namaste", "respected")
SIGNOFFS = ("regards", "warm regards", "thanks", "thank you", "sincerely", "yours sincerely", "yours faithfully", "yours truly")
NOT_GREETED = ("Team", "Sir", "Madam", "All", "There", "Everyone", "Customer", "User", "Friend", "Friends", "Colleagues", "Applicant", "Member", "Valued")
HEADINGS = (
    "Address", "Shipping", "Billing", "Delivery", "Deliver", "Contact", "Details", "Permanent", "Correspondence", "Residential", "Office", "Emergency", "Account",
    "Statement", "Invoice", "Order", "Record", "Profile", "Summary", "Settings",
)
DEVANAGARI = "\\u0900-\\u097F"

_CAP = "[A-Z][a-zA-Z'’-]+"
_MORE = f"(?:[ \\t]+(?:{_CAP}|[A-Z]\\.?(?![a-zA-Z])))"
NAME = f"{_CAP}{_MORE}{{0,3}}"
NAME_OF_TWO = f"{_CAP}{_MORE}{{1,3}}"
NAME_DEVANAGARI = f"[{DEVANAGARI}]+(?:[ \\t]+[{DEVANAGARI}]+){{0,2}}"
ANY_NAME = f"(?:{NAME}|{NAME_DEVANAGARI})"


def either_case(words: tuple[str, ...]) -> str:
    """The words in any case, where the rest of a pattern minds case."""

    def one(word: str) -> str:
        return "".join("[ \\t]+" if c == " " else f"[{c.upper()}{c}]" for c in word)

    return "(?:" + "|".join(map(one, words)) + ")"


def whole(words: str) -> str:
    return f"{_WORD_START}(?:{words}){_WORD_END}"


# Shapes, scores and contexts of the rules, in order.
RULES: tuple[Rule, ...] = (
    Rule("secret.jwt", "SECRET", 0.99, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", needs=("eyJ",)),
    Rule("secret.key", "SECRET", 0.99, r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9_-]{20,}|gh[pousr]_[A-Za-z0-9]{36}|xox[baprs]-[A-Za-z0-9-]{10,}|(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{16,}|AIza[0-9A-Za-z_-]{35}|rzp_(?:live|test)_[A-Za-z0-9]{14,})(?![A-Za-z0-9])", needs=("AKIA", "sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "_live_", "_test_", "AIza")),
    Rule("secret.label", "SECRET", 0.90, r"[A-Za-z0-9_\-+/]{20,}={0,2}", before=r"""(?<![A-Za-z])(?:api[ _-]?key|secret(?:[ _-]?key)?|access[ _-]?token|auth[ _-]?token|client[ _-]?secret|private[ _-]?key)[^\n:=]{0,12}[:=][ \t]*["']?""", ignore_case=True, validator="digit_and_letter", needs=("key", "secret", "token")),
    Rule("secret.bearer", "SECRET", 0.95, r"[A-Za-z0-9._~+/-]{20,}=*", before="Bearer[{B}]+", needs=("Bearer",)),
    Rule("email", "EMAIL", 0.99, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![A-Za-z0-9-])", needs=("@",)),
    Rule("upi", "UPI", 0.90, r"(?<![A-Za-z0-9._@-])[A-Za-z0-9._-]{2,256}@[A-Za-z][A-Za-z0-9]{1,63}(?![A-Za-z0-9.@-])", needs=("@",)),
    Rule("gstin", "GSTIN", 0.99, r"(?<![A-Z0-9])[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z](?![A-Z0-9])", validator="gstin", needs_digits=4),
    Rule("pan", "PAN", 0.95, r"(?<![A-Za-z0-9])[A-Za-z]{3}[ABCFGHJLPTabcfghjlpt][A-Za-z][0-9]{4}[A-Za-z](?![A-Za-z0-9])", validator="pan", needs_digits=4),
    Rule("ifsc", "IFSC", 0.85, r"(?<![A-Z0-9])[A-Z]{4}0[A-Z0-9]{6}(?![A-Z0-9])", needs=("0",)),
    Rule("aadhaar", "AADHAAR", 0.97, r"(?<![0-9-])[2-9][0-9]{3}([ -]?)[0-9]{4}\1[0-9]{4}(?![0-9-])", validator="aadhaar", needs_digits=4),
    Rule("aadhaar.vid", "AADHAAR_VID", 0.97, r"(?<![0-9-])[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9-])", validator="verhoeff", context="(?i)" + whole("vid|virtual[{B}]*id"), needs_digits=4),
    Rule("card", "CARD", 0.96, r"(?<![0-9-])[2-6](?:[ -]?[0-9]){12,18}(?![0-9-])", validator="card", needs_digits=1),
    Rule("phone.in", "PHONE", 0.93, r"(?<![0-9+])(?:(?:\+|00)?91[ -]?|0)?[6-9][0-9]{4}[ -]?[0-9]{5}(?![0-9])", needs_digits=5),
    Rule("card.expiry", "CARD_EXPIRY", 0.90, r"(?<![0-9])(?:0[1-9]|1[0-2])[{B}]?/[{B}]?(?:[0-9]{2}|20[0-9]{2})(?![0-9/])", context="(?i)" + whole("exp|expiry|expires|valid[{B}]*thru|valid[{B}]*till"), window=24, needs=("/",)),
    Rule("card.cvv", "CARD_CVV", 0.90, r"(?<![0-9])[0-9]{3,4}(?![0-9])", context="(?i)" + whole("cvv|cvc|cvv2|security[{B}]*code"), window=16, needs=("cv", "CV", "Cv", "ecurity", "ECURITY")),
    Rule("otp", "OTP", 0.90, r"(?<![0-9])[0-9]{4,8}(?![0-9])", context="(?i)(?:" + whole("otp") + "|one[- ]time|verification[{B}]*code|passcode|ओटीपी)", window=40, needs_digits=4),
    Rule("bank.account", "BANK_ACCOUNT", 0.88, r"(?<![0-9-])[0-9]{9,18}(?![0-9-])", context="(?i)(?:" + whole("a/c|acct|account") + "|खाता)", window=40, needs_digits=9),
    Rule("dob", "DOB", 0.90, r"(?<![0-9])(?:[0-9]{1,2}(?:st|nd|rd|th)?[/\-. ](?:[0-9]{1,2}|(?:" + "|".join(MONTHS) + r")[a-z]*)[/\-., ][{B}]?[0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})(?![0-9])", ignore_case=True, context=f"(?i)(?:{whole('dob')}|d\\.o\\.b|{_WORD_START}birth|{whole('born')}|जन्म)", window=40, needs_digits=4),
    Rule("pincode", "PINCODE", 0.85, r"(?<![0-9])[1-9][0-9]{2} ?[0-9]{3}(?![0-9])", context="(?i)(?:" + whole("pin") + "|pin[{B}]*code|pincode|postal|" + whole("zip") + "|पिन)", window=32, needs_digits=3),
    Rule("passport", "PASSPORT", 0.90, r"(?<![A-Z0-9])[A-PR-WY][1-9][0-9]{5}[1-9](?![A-Z0-9])", context="(?i)(?:passport|पासपोर्ट)", needs_digits=7),
    Rule("voter.epic", "VOTER_ID", 0.88, r"(?<![A-Z0-9])[A-Z]{3}[0-9]{7}(?![A-Z0-9])", context="(?i)(?:" + whole("epic") + "|voter|elector|मतदाता)", needs_digits=7),
    Rule("driving.licence", "DRIVING_LICENCE", 0.90, r"(?<![A-Z0-9])[A-Z]{2}[- ]?[0-9]{2}[- ]?(?:19|20)[0-9]{2}[0-9]{7}(?![A-Z0-9])", needs_digits=11),
    Rule("ipv4", "IP_ADDRESS", 0.70, r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9.])", needs=(".",), needs_digits=1),
    Rule("person.honorific", "PERSON", 0.85, NAME, before=_WORD_START + r"(?:Mr|Mrs|Ms|Miss|Dr|Shri|Smt|Sri|Kumari|Km|Prof)\.?[ \t]+", needs=("Mr", "Ms", "Miss", "Dr", "Shri", "Smt", "Sri", "Kumari", "Km", "Prof")),
    Rule("person.honorific.dev", "PERSON", 0.85, NAME_DEVANAGARI, before=r"(?:श्रीमती|श्री|सुश्री|कुमारी|डॉ\.?)[ \t]+", needs=("श्री", "सुश्री", "कुमारी", "डॉ")),
    Rule("person.relation", "PERSON", 0.85, ANY_NAME, before=_WORD_START + r"[SDWC]/[Oo][ \t]*:?[ \t]*", needs=("/O", "/o")),
    Rule("person.label", "PERSON", 0.80, ANY_NAME, before=f"(?:(?<![A-Za-z]){either_case(PERSON_LABELS)}|नाम)[ \\t]*[:：\\-–][ \\t]*", needs=(":", "：", "-", "–")),
    Rule("person.display_name", "PERSON", 0.85, NAME, after=r"[ \t]*<[ \t]*[^<>{B}@]+@", needs=("<",)),
    Rule("person.salutation", "PERSON", 0.80, NAME, before=f"(?<![A-Za-z]){either_case(SALUTATIONS)}[ \\t]+(?:(?:Mr|Mrs|Ms|Dr|Shri|Smt)\\.?[ \\t]+)?", after="[ \\t]*[,!]", validator="greeted", needs=(",", "!"), needs_low=tuple(w + c for w in SALUTATIONS for c in " \t")),
    Rule("person.signoff", "PERSON", 0.80, NAME_OF_TWO, before=f"(?<![A-Za-z]){either_case(SIGNOFFS)}[,.!]?[ \\t]*\\n[ \\t]*", after="(?=[ \\t]*(?:\\n|{END}))", needs=("\n",), needs_low=("regards", "thank", "sincerely", "yours")),
    Rule("person.narration", "PERSON", 0.85, r"[A-Z][A-Za-z.]*(?: [A-Z][A-Za-z.]*){0,3}", before=_WORD_START + "(?:UPI|IMPS|NEFT|RTGS)/(?:(?:DR|CR|P2A|P2M)/)?[A-Z0-9]{6,22}/", after="/", needs=("UPI/", "IMPS/", "NEFT/", "RTGS/")),
    Rule("person.before_phone", "PERSON", 0.70, NAME_OF_TWO, before="(?<![A-Za-z])", after=r"[ \t]*[·|,–-][ \t]*(?=(?:\+91[ -]?)?[6-9][0-9]{4}[ -]?[0-9]{5}(?![0-9]))", validator="no_heading", needs_digits=5),
    Rule("address.label", "ADDRESS", 0.80, r"[^\n\r  ]{8,160}?", before=r"(?:(?<![A-Za-z])(?:address|addr\.?)|पता)[ \t]*[:：\-–]?[ \t]+", after=r"(?=[{B}]*,?[{B}]*(?:IFSC|PAN|GSTIN|Aadhaar|email|mobile|account|phone|applicant|date of birth)(?![A-Za-z0-9_])|[{B}]*[.\n]|{END})", ignore_case=True, needs=("addr", "पता")),
)
INDEX = {r.name: i for i, r in enumerate(RULES)}
#: Names and scores of the layout and gazetteer rules, numbered behind the others.
LAYOUT_RULES = ("address.block", "person.addressee", "person.contact_card", "person.gazetteer")


def fill(pattern: str, end: str) -> str:
    return pattern.replace("{B}", BLANK).replace("{END}", end)


def java_pattern(rule: Rule) -> tuple[str, bool]:
    """The pattern for Spark, and whether group 1 holds what comes before the value."""
    head = "(?i)" if rule.ignore_case else ""
    if rule.before or rule.after:
        return fill(f"{head}({rule.before})({rule.value}){rule.after}", r"\z"), True
    return fill(head + rule.value, r"\z"), False


def by_name(name: str) -> Rule:
    return RULES[INDEX[name]]
