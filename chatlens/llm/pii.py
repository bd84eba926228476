"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, URL schemes, plus
signs, digits and identifier cues. At each anchor a local parser expands to
the left and right, finds the exact boundary and validates it. Nothing but
the surroundings of an anchor is looked at, so the work is linear in the text.

Kinds, in the order in which spans are listed:

* ``email``, ``ip``, ``card``, ``phone``: leftmost, non-overlapping within
  their kind; matches that fail their check (a part over 255, Luhn, number of
  digits) are dropped and not retried;
* ``login``: user part of a URL authority (``scheme://user[:word]@host``);
* ``iban``: account numbers after the cue IBAN, also several in a row, each as
  long as its country's are and checked modulo 97; of a country without an
  entry the longest end that passes the check;
* ``secret``: value of eight or more characters with a digit that an
  identifier cue (token, password, account, ...) assigns.

Null and empty texts have no spans. A row in gives a row out, also for
repeated ids; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE = ("email", "ip", "card", "phone")
KINDS = BASE + ("login", "iban", "secret")
CUES = ("token", "password", "passwd", "secret", "api_key", "apikey", "account", "acct")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOGIN = re.compile(r"[^\s/?#@]+@(?=[A-Za-z0-9\[])")
_IBAN = re.compile(r"[\x20:#]{0,4}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})")
_IBAN_NEXT = re.compile(r"(?:[\x20]?[,;/&+]|\x20and(?=\x20)|\x20und(?=\x20))?[\x20]{0,2}(?=[A-Z]{2}[0-9]{2})")
# Characters of an account number by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29,
    "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19,
    "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29,
    "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24,
    "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
    "YE": 30,
}
_SECRET = re.compile(r"(?:[\x20_-]?(?:number|no\.?|id|key))?[\x20]{0,3}[=:#][\x20]{0,3}[\"']?"
                     r"([A-Za-z0-9_./+=-]{8,})", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) << (k & 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _octet(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def _mod97(account: str) -> bool:
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _account_end(text: str, start: int, limit: int) -> int | None:
    """End of the valid account number at ``start``, which ends by ``limit``."""
    at = [k for k in range(start, limit) if text[k] != " "]
    length = IBAN_LENGTHS.get(text[start:start + 2])
    for n in (length,) if length else range(len(at), 14, -1):
        if n <= len(at):
            end = at[n - 1] + 1
            if not (end < len(text) and text[end].isascii() and text[end].isalnum()) \
                    and _mod97("".join(text[k] for k in at[:n])):
                return end
    return None


_automaton = None


def _anchors():
    """The automaton, built once per Python worker."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        for d in "0123456789":
            a.add_word(d, "digit")
        a.add_word("@", "at")
        a.add_word("+", "plus")
        a.add_word("://", "scheme")
        for c in CUES:
            for form in {c, c.upper(), c.capitalize()}:
                a.add_word(form, "cue")
        for form in ("IBAN", "iban", "Iban"):
            a.add_word(form, "iban")
        a.make_automaton()
        _automaton = a
    return _automaton


def find_spans(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans (start, end exclusive; code points) of each kind, ascending."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not text:
        return out
    done = dict.fromkeys(KINDS, 0)      # where the last match of the kind ended

    def put(kind: str, start: int, end: int, valid: bool) -> None:
        done[kind] = end
        if valid:
            out[kind].append((start, end))

    for last, what in _anchors().iter(text):
        if what == "digit":
            if last and text[last - 1] in _DIGITS:
                continue                # only the first digit of a run starts a match
            if last >= done["ip"] and (m := _IP.match(text, last)):
                put("ip", last, m.end(), all(map(_octet, m[0].split("."))))
            if last >= done["card"] and (m := _CARD.match(text, last)):
                n = m[0].replace(" ", "").replace("-", "")
                put("card", last, m.end(), 16 <= len(n) <= 19 and luhn(n))
        elif what == "at":
            start = last
            while start > done["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last + 1)):
                put("email", start, m.end(), True)
        elif what == "plus":
            if last >= done["phone"] and (m := _PHONE.match(text, last)):
                put("phone", last, m.end(), 8 <= sum(c in _DIGITS for c in m[0]) <= 15)
        elif what == "scheme":
            start = last - 2
            while start > done["login"] and text[start - 1] in _SCHEME:
                start -= 1
            if start < last - 2 and (m := _LOGIN.match(text, last + 1)):
                put("login", last + 1, m.end() - 1, True)
        elif what == "iban":
            m = _IBAN.match(text, last + 1) if last >= done["iban"] else None
            while m and (end := _account_end(text, m.start(1), m.end(1))):
                put("iban", m.start(1), end, True)
                more = _IBAN_NEXT.match(text, end)
                m = more and _IBAN.match(text, more.end())
        elif last >= done["secret"] and (m := _SECRET.match(text, last + 1)):
            put("secret", m.start(1), m.end(1), any(c in _DIGITS for c in m[1]))
    return out


def listed(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, number of spans of each base kind, ``base_sha256`` (of the list of
    base spans), ``spans`` (list of all spans) and ``n_extra`` (spans of the
    kinds that the method adds). One narrow pass, no shuffle."""
    schema = T.StructType([*[T.StructField(f"n_{k}", T.LongType()) for k in BASE],
                           T.StructField("base_sha256", T.StringType()),
                           T.StructField("spans", T.StringType()),
                           T.StructField("n_extra", T.LongType())])

    @F.pandas_udf(schema)
    def found(texts: pd.Series) -> pd.DataFrame:
        spans = [find_spans(t) for t in texts]
        out = {f"n_{k}": [len(s[k]) for s in spans] for k in BASE}
        out["base_sha256"] = [hashlib.sha256(listed(s, BASE).encode()).hexdigest() for s in spans]
        out["spans"] = [listed(s, KINDS) for s in spans]
        out["n_extra"] = [sum(len(s[k]) for k in KINDS[len(BASE):]) for s in spans]
        return pd.DataFrame(out)

    return (docs.select(docs[id_col].alias("doc_id"), found(docs[text_col].cast("string")).alias("found"))
            .select("doc_id", "found.*"))
