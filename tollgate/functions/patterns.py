"""All text patterns, written once and rendered for Spark (Java) or RE2.

``{b}`` is an ASCII word boundary; ``{l}`` and ``{r}`` are one before and after a
word character, which is cheaper. ``{s}`` is ASCII white space without the
vertical tab. Java's own differ from RE2's. Case folding is Unicode-aware.
"""

from __future__ import annotations

_WORD = "[A-Za-z0-9_]"
_JAVA = {"{l}": f"(?<!{_WORD})", "{r}": f"(?!{_WORD})", "{b}": f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))", "{s}": r"[ \t\n\f\r]", "{i}": "(?iu)", "{is}": "(?ius)", "{notspace}": r"[^ \t\n\f\r"}
_RE2 = {"{l}": r"\b", "{r}": r"\b", "{b}": r"\b", "{s}": r"\s", "{i}": "(?i)", "{is}": "(?is)", "{notspace}": r"[^\s"}

# Shapes of personal data and credentials.
EMAIL = r"{b}[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+{b}"
AADHAAR = r"{l}[2-9][0-9]{3}[ -]?[0-9]{4}[ -]?[0-9]{4}{r}"
CARD = r"{l}[0-9](?:[0-9 -]{11,21})[0-9]{r}"
GSTIN = r"{l}[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z]{r}"
PAN = r"{l}[A-Z]{5}[0-9]{4}[A-Z]{r}"
PASSPORT = r"{l}[A-PR-WY][1-9][0-9][ ]?[0-9]{4}[1-9]{r}"
MOBILE = r"(?:\+91[ -]?|{l}0)?[6-9][0-9]{9}{r}"
VPA = r"{b}[A-Za-z0-9.\-_]{2,64}@[A-Za-z]{2,64}{r}"
IFSC = r"{l}[A-Z]{4}0[A-Z0-9]{6}{r}"
ACCOUNT = r"{l}[0-9]{9,18}{r}"
VPA_HANDLES = ("okhdfcbank", "okicici", "oksbi", "okaxis", "ybl", "ibl", "axl", "apl", "yapl", "paytm", "upi", "airtel", "freecharge", "jupiteraxis", "fam", "naviaxis", "superyes")
ACCOUNT_WINDOW = 120
AWS_KEY = r"{l}AKIA[0-9A-Z]{16}{r}"
GITHUB_TOKEN = r"{l}gh[pousr]_[A-Za-z0-9]{36,}{r}"
SLACK_TOKEN = r"{l}xox[abprs]-[A-Za-z0-9-]{10,}"
OPENAI_KEY = r"{l}sk-[A-Za-z0-9_-]{20,}"
SECRET_TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
BASE64_TOKEN = r"[A-Za-z0-9+/_-]{16,}={0,2}"

# Injection phrases, chat markers, hidden markup.
OVERRIDE = (
    r"{i}{l}(?:"
    r"(?:ignore|disregard|forget|override|bypass){s}+(?:all{s}+|any{s}+|the{s}+|your{s}+|these{s}+|those{s}+)*(?:previous|prior|earlier|above|preceding|initial|original|system)?{s}*(?:instruction|instructions|prompt|prompts|rule|rules|direction|directions|context|guardrail|guardrails)"
    r"|new{s}+instructions?{s}*:"
    r"|instead{s}+of{s}+(?:the{s}+)?(?:above|previous|your){s}+(?:instructions?|rules?)"
    r"|you{s}+are{s}+now{s}+(?:a|an|in|no{s}+longer|unrestricted|jailbroken|free|allowed){b}"
    r"|(?:act|behave){s}+as{s}+(?:if{s}+you{s}+are{s}+)?(?:a|an)?{s}*(?:developer|dan|jailbroken|unrestricted)"
    r"|(?:do{s}+not|don't|never){s}+(?:tell|mention|reveal|inform){s}+(?:the{s}+)?user"
    r"|reveal{s}+(?:your{s}+)?(?:system{s}+prompt|instructions|prompt)"
    r"|print{s}+(?:your{s}+)?(?:system{s}+prompt|instructions)"
    r")"
)
SPOOF = r"{i}(?:<\|(?:im_start|im_end|system|user|assistant|endoftext)\|>|\[/?INST\]|<<{s}*SYS{s}*>>|(?m:^){s}*(?:###{s}*)?(?:system|assistant|human){s}*:|</?(?:system|assistant)>)"
HIDDEN = r"""{is}<!--.*?-->|<[^>]*style{s}*={s}*["'][^"']*(?:display{s}*:{s}*none|font-size{s}*:{s}*0)"""

# Addresses.
URL = r"""https?://{notspace}<>"')\]]+"""
MARKDOWN_IMAGE = r"!\[[^\]]*\]\((?:https?://{notspace})]+)\)"
DATA_BYTES = 24

# Characters that show nothing or reorder text.
INVISIBLE = ((0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x2069), (0xFEFF, 0xFEFF), (0x00AD, 0x00AD), (0x180E, 0x180E))
INVISIBLE_CLASS = "[" + "".join(f"{chr(a)}-{chr(b)}" if a != b else chr(a) for a, b in INVISIBLE) + "]"


#: What a text must hold for a pattern to match at all, as (words of which one is
#: there in lower case, a simple pattern without look-around): cheap first checks.
NEEDS: dict[str, tuple[tuple[str, ...], str]] = {
    EMAIL: (("@",), ""),
    VPA: (("@",), ""),
    AADHAAR: ((), "[2-9][0-9]{3}[ -]?[0-9]{4}[ -]?[0-9]{4}"),
    CARD: ((), "[0-9][0-9 -]{11,21}[0-9]"),
    GSTIN: ((), "[0-9]{2}[A-Z]{5}[0-9]{4}"),
    PAN: ((), "[A-Z]{5}[0-9]{4}[A-Z]"),
    PASSPORT: ((), "[A-PR-WY][1-9][0-9] ?[0-9]{4}"),
    MOBILE: ((), "[6-9][0-9]{9}"),
    IFSC: ((), "[A-Z]{4}0[A-Z0-9]{6}"),
    ACCOUNT: ((), "[0-9]{9}"),
    AWS_KEY: (("akia",), ""),
    GITHUB_TOKEN: (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), ""),
    SLACK_TOKEN: (("xox",), ""),
    OPENAI_KEY: (("sk-",), ""),
    URL: (("http",), ""),
    MARKDOWN_IMAGE: (("![",), ""),
    OVERRIDE: (("ignore", "disregard", "forget", "override", "bypass", "instruction", "instead", "now", "developer", "dan", "jailbroken", "unrestricted", "user", "reveal", "print"), ""),
    SPOOF: (("<|", "inst]", "<<", "system", "assistant", "human"), ""),
    HIDDEN: (("<!--", "style"), ""),
}


def _render(pattern: str, table: dict[str, str]) -> str:
    for key, value in table.items():
        pattern = pattern.replace(key, value)
    return pattern


def java(pattern: str) -> str:
    """The pattern for Spark."""
    return _render(pattern, _JAVA)


def re2(pattern: str) -> str:
    """The pattern for RE2 engines (the SQL checks)."""
    return _render(pattern, _RE2)
