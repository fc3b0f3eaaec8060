"""Personal data by anchor expansion.

One pass of an Aho-Corasick automaton finds anchors: at-signs, schemes, plus signs, digits beside
separators, words that announce an identifier or a secret, what secrets begin with, and words that
end the name of a street. Around each anchor a parser reads the largest
stretch of characters that its kind can hold, and validates what it finds there. Outside such
stretches nothing of that kind can stand, so the result is that of reading the whole text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import map_arrow, text_or_empty

#: In the order of every list of spans. The base kinds come first, then those that anchors add.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "login", "iban", "account", "secret", "address")

# The grammar of the base kinds.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_EMAIL_LEFT_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_EMAIL_RIGHT = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9.]*")
_SPACED = re.compile(r"[0-9\x20-]*")
_IDENTIFIER = re.compile(r"\W{0,3}(?:(?:number|no|nr|num|id)\b\W{0,3})?([A-Z0-9](?:[ -]?[A-Z0-9]){5,33})(?![A-Za-z0-9])", re.IGNORECASE)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_LOGIN = re.compile(r"[A-Za-z0-9._~%!$&'*+,;=-]+:[^\s@/]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")

# What announces an identifier.
CUES = ("account", "acct", "iban", "passport", "ssn", "social security", "customer id", "member id")
# What announces a secret.
SECRET_CUES = ("token", "secret", "password", "passwd", "passphrase", "pwd", "api key", "api_key", "api-key", "apikey", "access key", "access_key", "private key", "private_key", "bearer", "credential")
# Public formats of keys, by what they begin with.
KEY_FORMATS = {
    "AKIA": r"AKIA[A-Z0-9]{16}",
    "ASIA": r"ASIA[A-Z0-9]{16}",
    "ghp_": r"ghp_[A-Za-z0-9]{36,}",
    "gho_": r"gho_[A-Za-z0-9]{36,}",
    "github_pat_": r"github_pat_[A-Za-z0-9_]{22,}",
    "xoxb-": r"xoxb-[A-Za-z0-9-]{10,}",
    "xoxp-": r"xoxp-[A-Za-z0-9-]{10,}",
    "eyJ": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "-----BEGIN": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}-----END [A-Z ]*PRIVATE KEY-----",
}
# What ends the name of a street.
STREETS = ("Street", "St", "Avenue", "Ave", "Road", "Rd", "Lane", "Ln", "Drive", "Dr", "Boulevard", "Blvd", "Court", "Ct", "Square", "Terrace", "Highway", "Hwy", "Parkway", "Pkwy")

_KEYS = {start: re.compile(form + r"(?![A-Za-z0-9])") for start, form in KEY_FORMATS.items()}
#: After a cue: perhaps a closing quote, a sign that gives a value, then a value in quotes or one without white space.
_SECRET = re.compile(r"[\"']?\s{0,3}(?::=|=>|=|:)\s{0,3}(?:([\"'`])([^\s\"'`]{6,512})\1|([^\s\"'`,;<>]{8,512}))")
_BEARER = re.compile(r"\s{1,3}()()([A-Za-z0-9._~+/=-]{16,2048})")
#: A house number and one to four capitalised words, read backwards from the word that ends the name.
_HOUSE = re.compile(r"(?<![\w.,-])[0-9]{1,5}[A-Za-z]?(?: (?:[A-Z][a-z'-]{1,20}|[0-9]{1,3}(?:st|nd|rd|th)|[NSEW]\.?)){1,4} \Z")
#: A flat, a town, a region and a postal code that may follow.
_PLACE = re.compile(r"\.?(?:,? (?:Apt|Apartment|Suite|Unit|Flat|#)\.? ?[0-9A-Za-z-]{1,6})?(?:, [A-Z][a-z'-]{1,20}(?: [A-Z][a-z'-]{1,20}){0,2}(?:, [A-Z]{2}| [A-Z]{2})?(?: [0-9]{5}(?:-[0-9]{4})?)?)?")
_HOUSE_REACH = 100


def _secret(value: str, quoted: bool) -> bool:
    """A value that no one would write as a word: digits among letters, or, in quotes, mixed case or signs."""
    letters, digits = any(map(str.isalpha, value)), any(map(str.isdigit, value))
    if digits and (letters or quoted):
        return True
    return quoted and len(value) >= 8 and (value[1:].lower() != value[1:] and value.upper() != value or any(not c.isalnum() and c not in ".,'-" for c in value))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    compact = text.replace(" ", "").upper()
    if not 15 <= len(compact) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def _automaton() -> ahocorasick.Automaton:
    anchors = ahocorasick.Automaton()
    for digit in "0123456789":
        anchors.add_word(f"{digit}.", ("ip", 2))
        for other in "0123456789":
            anchors.add_word(digit + other, ("card", 2))
        for gap in " -":
            anchors.add_word(digit + gap, ("card", 2))
        anchors.add_word(f"+{digit}", ("phone", 2))
    anchors.add_word("@", ("email", 1))
    anchors.add_word("://", ("login", 3))
    for cue in CUES:
        for form in {cue, cue.capitalize(), cue.upper(), cue.title()}:
            anchors.add_word(form, ("account", len(form)))
    for cue in SECRET_CUES:
        for form in {cue, cue.capitalize(), cue.upper(), cue.title()}:
            anchors.add_word(form, ("secret", len(form)))
    for start in KEY_FORMATS:
        anchors.add_word(start, ("key", len(start)))
    for street in STREETS:
        anchors.add_word(f" {street}", ("address", len(street) + 1))
    anchors.make_automaton()
    return anchors


_ANCHORS: list[ahocorasick.Automaton] = []


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed in KINDS, then by start.

    Email, ip, card and phone are exactly the leftmost, not overlapping matches of their grammar
    that pass their checks. login is user:password@host after a scheme; iban is a bank account
    number with right check digits; account is an identifier with a digit after a cue word; secret is
    a value given to a cue word that isn't a plain word, or a key of a public format; address is a
    house number and a street, with the place that follows. Null and empty texts have no spans.
    """
    if not _ANCHORS:
        _ANCHORS.append(_automaton())
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    #: Where the parser of a kind has read up to; nothing before that is read again.
    upto = dict.fromkeys(KINDS, 0)
    for last, (kind, length) in _ANCHORS[0].iter(text):
        at = last + 1 - length
        if kind == "card":
            if at >= upto["card"]:
                start, end = _stretch(text, at, _SPACED, "0123456789 -")
                upto["card"] = end
                for m in CARD.finditer(text, start, end):
                    digits = re.sub("[ -]", "", m[0])
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append(m.span())
        elif kind == "ip":
            if at >= upto["ip"]:
                start, end = _stretch(text, at, _DOTTED, "0123456789.")
                upto["ip"] = end
                found["ip"] += [m.span() for m in IP.finditer(text, start, end) if all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in m[0].split("."))]
        elif kind == "phone":
            if at >= upto["phone"] and (m := PHONE.match(text, at)):
                upto["phone"] = m.end()
                if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    found["phone"].append(m.span())
        elif kind == "email":
            start, floor = at, upto["email"]
            while start > floor and text[start - 1] in _EMAIL_LEFT_CHARS:
                start -= 1
            if start < at and (m := _EMAIL_RIGHT.match(text, at + 1)):
                upto["email"] = m.end()
                found["email"].append((start, m.end()))
        elif kind == "login":
            if m := _LOGIN.match(text, last + 1):
                found["login"].append(m.span())
        elif kind == "secret":
            form = _BEARER if text[at : last + 1].lower() == "bearer" else _SECRET
            if at >= upto["secret"] and not text[at - 1 : at].isalpha() and ((m := form.match(text, last + 1)) or form is _BEARER and (m := _SECRET.match(text, last + 1))):
                group = 2 if m[2] else 3
                if _secret(m[group], group == 2):
                    start, end = m.span(group)
                    end -= 0 if group == 2 else len(m[3]) - len(m[3].rstrip(".!?)]}"))
                    upto["secret"] = end
                    found["secret"].append((start, end))
        elif kind == "key":
            if at >= upto["secret"] and not text[at - 1 : at].isalnum() and (m := _KEYS[text[at : last + 1]].match(text, at)):
                upto["secret"] = m.end()
                found["secret"].append(m.span())
        elif kind == "address":
            floor = max(upto["address"], at - _HOUSE_REACH)
            if not text[last + 1 : last + 2].isalnum() and (m := _HOUSE.search(text[floor : at + 1])):
                end = _PLACE.match(text, last + 1).end()
                upto["address"] = end
                found["address"].append((floor + m.start(), end if text[end - 1] != "." else end - 1))
        elif last + 1 >= upto["account"] and not text[at - 1 : at].isalnum() and (m := _IDENTIFIER.match(text, last + 1)):
            value, start = m[1], m.start(1)
            if (n := _IBAN.match(text, start)) and iban_valid(n[0]):
                upto["account"] = n.end()
                found["iban"].append(n.span())
            elif (number := re.match(r"[0-9](?:[ -]?[0-9])*|[A-Za-z0-9-]+", value)) and sum(c.isdigit() for c in number[0]) >= 5:
                upto["account"] = start + number.end()
                found["account"].append((start, start + number.end()))
    return [(kind, *span) for kind in KINDS for span in found[kind]]


def _stretch(text: str, at: int, right: re.Pattern, chars: str) -> tuple[int, int]:
    start = at
    while start and text[start - 1] in chars:
        start -= 1
    return start, right.match(text, at).end()


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each stretch of personal data replaced by its kind; overlapping spans become one."""
    out, upto = [], 0
    for start, end, kind in sorted((s, -e, k) for k, s, e in spans):
        if start >= upto:
            out += [text[upto:start], f"<{kind}>"]
        upto = max(upto, -end)
    return "".join(out) + text[upto:]


def find_pii(docs: DataFrame) -> DataFrame:
    """Spans of personal data in every text.

    Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans. A null text counts as empty;
    an empty text has no spans, an empty string of spans and the digest of the empty string. Rows
    with equal or null doc_id stay apart, and other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for text in batch.column(1).to_pylist():
                spans = find_spans(text)
                for k, kind in enumerate(BASE_KINDS):
                    rows[k].append(sum(s[0] == kind for s in spans))
                rows[4].append(hashlib.sha256(joined([s for s in spans if s[0] in BASE_KINDS]).encode()).hexdigest())
                rows[5].append(joined(spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(r, pa.int64()) for r in rows[:4]), *(pa.array(r, pa.string()) for r in rows[4:])], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return map_arrow(docs.select("doc_id", text_or_empty().alias("text")), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced by <kind>, and n_chars, if there, set anew.

    Null texts stay null; all columns and rows stay.
    """
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else redact(t, find_spans(t)) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(len(names))], names)

    out = map_arrow(docs, run, docs.schema)
    return out.withColumn("n_chars", _code_points(out)) if "n_chars" in names else out


def _code_points(docs: DataFrame) -> Column:
    return F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
