"""Personal data in texts by anchor expansion.

An Aho-Corasick automaton walks a text once and stops at anchors: at-signs,
digits, plus signs, URL schemes and identifier cues. At each anchor a local
parser expands to the left and right and validates what it finds. All parsers
are linear in the text, also on adversarial input (possessive patterns, and no
position is expanded twice for a kind).

Kinds, in this order where spans start together:
  email, ip, card, phone   the base patterns, leftmost and non-overlapping for each kind
  login     user:password of a URL such as scheme://user:password@host
  masked    an e-mail address written with (at) or [at]
  account   an IBAN with valid check digits
  national  a social security number in ddd-dd-dddd form after a cue
  secret    the value that follows token, secret, password or api key cues

Offsets are code points, the end exclusive. Null and empty texts have no
spans. Rows are independent, so repeated rows and ids need no care, and other
columns pass through whatever their names.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "login", "masked", "account", "national", "secret")
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOGIN = re.compile(r"([^\s/@:?#]++:[^\s/@?#]++)@")
MASKED_DOMAIN = re.compile(r"[A-Za-z0-9-]{1,63}+(?:(?:\.| ?[(\[]dot[)\]] ?)[A-Za-z0-9-]{1,63}+)++", re.IGNORECASE)
IBAN = re.compile(r"[ :#]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    country: int(length)
    for length, countries in (x.split(":") for x in (
        "15:NO", "16:BE", "18:DK FI FO GL NL", "19:MK SI", "20:AT BA EE KZ LT LU XK", "21:CH HR LI LV", "22:BG BH CR DE GB GE IE ME RS VA",
        "23:AE GI IL IQ TL", "24:AD CZ ES MD PK RO SA SE SK TN VG", "25:LY PT ST", "26:IS TR", "27:FR GR IT MC MR SM", "28:AL AZ BY CY DO GT HU LB PL SV",
        "29:BR EG PS QA UA", "30:JO KW MU", "31:MT SC", "32:LC",
    ))
    for country in countries.split()
}
NATIONAL = re.compile(r"[ :#]{0,4}((?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4})(?![0-9])")
SECRET_CUE = re.compile(r"[\"']?[ \t]{0,4}[=:][ \t]{0,4}[\"']?")
SECRET = re.compile(r"[A-Za-z0-9_+/=.~-]{16,}+")
CUES = {
    "://": "login",
    **{f"{a}at{b}": "masked" for a, b in ("()", "[]", ("( ", " )"))},
    **{x: "account" for x in ("IBAN", "iban", "Iban")},
    **{x: "national" for x in ("SSN", "ssn", "Social Security", "social security number")},
    **{x: "secret" for word in ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key") for x in (word, word.capitalize(), word.upper())},
}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", ("email", 1))
    found.add_word("+", ("phone", 1))
    for digit in "0123456789":
        found.add_word(digit, ("digit", 1))
        found.add_word(f"{digit}.", ("ip", 2))
    for cue, kind in CUES.items():
        found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def valid_iban(text: str) -> bool:
    code = text.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def iban_end(text: str, start: int, end: int) -> int:
    """Where the IBAN from start on ends, at most at end: at its country's length or else as far as may be, on a boundary and with valid check digits; start without one."""
    ends = [e for e in range(end, start, -1) if text[e - 1] != " " and not (text[e : e + 1].isascii() and text[e : e + 1].isalnum())]
    ends.sort(key=lambda e: len(text[start:e].replace(" ", "")) != IBAN_LENGTHS.get(text[start : start + 2]))
    return next((e for e in ends if valid_iban(text[start:e])), start)


def local_start(text: str, end: int, least: int) -> int:
    while end > least and text[end - 1] in LOCAL_CHARS:
        end -= 1
    return end


def find(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of all spans of a text, sorted."""
    spans: list[tuple[int, int, int]] = []
    done = dict.fromkeys(KINDS, 0)  # where the last match of a kind ended

    def expand(kind: str, pattern: re.Pattern, at: int) -> None:
        m = pattern.match(text, at)
        if m and m.start(1) >= done[kind]:
            done[kind] = m.end(1)
            spans.append((m.start(1), KINDS.index(kind), m.end(1)))

    for last, (kind, size) in anchors.iter(text):
        at = last + 1 - size
        if kind == "digit":
            if at >= done["card"]:
                m = CARD.match(text, at)
                done["card"] = m.end() if m else last + 1
                if m and 12 <= len(digits := re.sub("[ -]", "", m[0])) <= 19 and luhn(digits):
                    spans.append((at, 2, m.end()))
        elif kind == "ip":
            while at > done["ip"] and "0" <= text[at - 1] <= "9":
                at -= 1
            if at >= done["ip"] and (m := IP.match(text, at)):
                done["ip"] = m.end()
                if all(len(part := x.lstrip("0")) <= 3 and int(part or 0) <= 255 for x in m.groups()):
                    spans.append((at, 1, m.end()))
        elif kind == "email":
            start = local_start(text, at, done["email"])
            if start < at and (m := DOMAIN.match(text, at + 1)):
                done["email"] = m.end()
                spans.append((start, 0, m.end()))
        elif kind == "phone":
            if at >= done["phone"] and (m := PHONE.match(text, at)):
                done["phone"] = m.end()
                if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                    spans.append((at, 3, m.end()))
        elif kind == "login":
            expand("login", LOGIN, last + 1)
        elif kind == "masked":
            end = at - 1 if at and text[at - 1] == " " else at
            start = local_start(text, end, done["masked"])
            m = MASKED_DOMAIN.match(text, last + 2 if text[last + 1 : last + 2] == " " else last + 1)
            if start < end and m:
                done["masked"] = m.end()
                spans.append((start, 5, m.end()))
        elif kind == "account":
            m = IBAN.match(text, last + 1)
            if m and m.start(1) >= done["account"] and (end := iban_end(text, m.start(1), m.end(1))) > m.start(1):
                done["account"] = end
                spans.append((m.start(1), KINDS.index("account"), end))
        elif kind == "national":
            expand("national", NATIONAL, last + 1)
        else:
            cue = SECRET_CUE.match(text, last + 1)
            if cue and cue.end() >= done["secret"] and (m := SECRET.match(text, cue.end())):
                done["secret"] = m.end()  # what is no secret as a whole has none at its end
                if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]):
                    spans.append((m.start(), KINDS.index("secret"), m.end()))
    spans.sort()
    return spans


@F.arrow_udf(returnType=SPANS)
def _spans(texts: pa.Array) -> pa.Array:
    anchors = automaton()
    found = ([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in find(x.as_py(), anchors)] if x.is_valid else [] for x in texts)
    return pa.array(found, SPANS_ARROW)


@F.arrow_udf(returnType=T.StringType())
def _redacted(texts: pa.Array) -> pa.Array:
    anchors = automaton()
    return pa.array((redact(x.as_py(), find(x.as_py(), anchors)) if x.is_valid else None for x in texts), pa.string())


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each maximal run of overlapping spans replaced by the name of its first kind in angle brackets."""
    out, done, covered = [], 0, 0
    for start, kind, end in spans:
        if start >= covered:
            out += [text[done:start], f"<{KINDS[kind]}>"]
        done = covered = max(covered, end)
    return "".join([*out, text[done:]])


def with_spans(docs: DataFrame, text: str = "text", to: str = "spans") -> DataFrame:
    """docs with an array of struct<kind, start, end>, sorted by start and kind."""
    return docs.withColumn(to, _spans(F.col(text)))


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with personal data in the text replaced; a column n_chars follows the new text."""
    out = docs.withColumn(text, _redacted(F.col(text)))
    return out.withColumn("n_chars", F.char_length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans as text; one row for each row of docs."""

    def listed(spans: Column) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))
    kinds = F.transform(spans, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS]
    return with_spans(docs.select("doc_id", "text")).select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(spans).alias("spans"))
