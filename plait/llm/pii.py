"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, digit pairs, digits before a dot, plus
signs before a digit, URL schemes and identifier cues. A deterministic parser per anchor expands to
the boundaries of the candidate and validates it. The four base kinds equal what their patterns find
from left to right without overlap, failing matches dropped and not retried:

* email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ip    ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``, each part at most 255
* card  ``[0-9]([\\x20-]?[0-9])+``, 13 to 19 digits that pass Luhn's test
* phone ``\\+[0-9][\\x20().0-9-]+[0-9]``, 9 to 15 digits

The method adds three kinds: ``url`` (a scheme with its host and path), ``account`` (a number after a
cue, or an IBAN of its country's length whose check digits hold, with or without a cue) and ``secret`` (a
value assigned to a credential's name). An account ends before the first group without a digit.
Every parser reads each character a bounded number of times, so long texts cost linear time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plait.runtime import lean, ship

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "secret", "url")
# fixed values: schemes and cues that open an address, an account number or a credential
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
ACCOUNT_CUES = ("account", "acct", "iban", "konto", "compte", "cuenta", "passport", "ssn")
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+|\.+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"[\x20().0-9-]+")
_URL = re.compile(r"[^\s<>\"'`{}|\\^]+")
_ACCOUNT = re.compile(r"(?:[ \t]*(?:number|no\.?|nr\.?|#))?[ \t]*[:=#]?[ \t]*([A-Z]{0,2}[0-9][A-Z0-9]*(?:[ -](?=[A-Z]*[0-9])[A-Z0-9]+)*)(?![A-Za-z0-9])")
_CUE_END = re.compile(r"(?:[ \t]*(?:number|no\.?|nr\.?|#))?[ \t]*[:=#]?[ \t]*")
# fixed values: the length of an IBAN by country
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24,
    "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22,
    "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
#: Digits and characters of an account number after a cue.
ACCOUNT_DIGITS, ACCOUNT_LENGTH = 5, (6, 36)
_SECRET = re.compile(r"[\"']?[ \t]*[:=][ \t]*[\"']?([A-Za-z0-9_\-+/=.]{8,})")


@lru_cache(maxsize=1)
def anchors():
    import ahocorasick

    found: dict[str, str] = {"@": "email"}
    for d in "0123456789":
        found[f"{d}."] = "ip"
        found[f"+{d}"] = "phone"
        for e in "0123456789":
            for sep in ("", " ", "-"):
                found[f"{d}{sep}{e}"] = "card"
    for country in IBAN_LENGTHS:
        for d in "0123456789":
            found[country + d] = "iban"
    for kind, cues in (("url", SCHEMES), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                found[form] = kind
    automaton = ahocorasick.Automaton()
    for cue, kind in found.items():
        automaton.add_word(cue, (kind, len(cue)))
    automaton.make_automaton()
    return automaton


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if i % 2:
            x = x * 2 - 9 if x > 4 else x * 2
        total += x
    return total % 10 == 0


def iban_holds(code: str) -> bool:
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def iban_end(text: str, at: int) -> int | None:
    """Where a valid IBAN that begins at ``at`` ends; single spaces may stand between its characters."""
    n, left, code = len(text), IBAN_LENGTHS.get(text[at : at + 2], 0), []
    i = at
    while left and i < n:
        c = text[i]
        if "0" <= c <= "9" or "A" <= c <= "Z":
            code.append(c)
            left -= 1
        elif c != " " or not code or text[i - 1] == " ":
            return None
        i += 1
    if left or not code or i < n and text[i].isalnum() or not "".join(code[2:4]).isdigit():
        return None
    return i if iban_holds("".join(code)) else None


def _account_end(text: str, start: int, end: int) -> int | None:
    """Where an account number that its pattern found ends: whole groups up to the greatest length."""
    while end - start > ACCOUNT_LENGTH[1]:
        cut = max(text.rfind(" ", start, end), text.rfind("-", start, end))
        if cut < 0:
            return None
        end = cut
    return end if end - start >= ACCOUNT_LENGTH[0] and sum("0" <= c <= "9" for c in text[start:end]) >= ACCOUNT_DIGITS else None


def _region(text: str, at: int, chars: str) -> tuple[int, int]:
    """The maximal run of ``chars`` around ``at``."""
    s = e = at
    while s and text[s - 1] in chars:
        s -= 1
    n = len(text)
    while e < n and text[e] in chars:
        e += 1
    return s, e


def _ips(text: str, s: int, e: int) -> Iterator[tuple[int, int]]:
    runs = [m.span() for m in _DOTTED.finditer(text, s, e)]
    i = 0
    while i < len(runs):
        if text[runs[i][0]] == ".":
            i += 1
            continue
        # digits, dot, digits, dot, digits, dot, digits
        if i + 6 < len(runs) and all(text[runs[k][0]] == "." and runs[k][1] - runs[k][0] == 1 for k in (i + 1, i + 3, i + 5)):
            parts = [runs[k] for k in (i, i + 2, i + 4, i + 6)]
            if all(len(p := text[a:b].lstrip("0")) <= 3 and int(p or "0") <= 255 for a, b in parts):
                yield parts[0][0], parts[3][1]
            i += 7
        else:
            i += 1


def find(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans (start, end) in code points by kind, each list in order."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not text:
        return found
    done = dict.fromkeys(KINDS, 0)
    for last, (kind, size) in anchors().iter(text):
        at = last - size + 1
        if kind == "card":
            if at >= done["card"]:
                s, e = _region(text, at, "0123456789 -")
                done["card"] = e
                for m in _CARD.finditer(text, s, e):
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append(m.span())
        elif kind == "ip":
            if at >= done["ip"]:
                s, e = _region(text, at, "0123456789.")
                done["ip"] = e
                found["ip"] += _ips(text, s, e)
        elif kind == "email":
            s = at
            while s > done["email"] and text[s - 1] in _LOCAL:
                s -= 1
            if s < at and (m := _DOMAIN.match(text, at + 1)):
                found["email"].append((s, m.end()))
                done["email"] = m.end()
        elif kind == "phone":
            if at >= done["phone"] and (m := _PHONE.match(text, at + 2)):
                e = m.end()
                while e > at + 3 and not "0" <= text[e - 1] <= "9":
                    e -= 1
                if e > at + 3:
                    done["phone"] = e
                    if 9 <= sum("0" <= c <= "9" for c in text[at:e]) <= 15:
                        found["phone"].append((at, e))
        elif kind == "url":
            if at >= done["url"] and (m := _URL.match(text, last + 1)):
                body = m[0].rstrip(".,;:!?)]")
                if body and (body[0].isalnum() or body[0] == "["):
                    found["url"].append((at, last + 1 + len(body)))
                    done["url"] = last + 1 + len(body)
        elif kind == "iban":
            if at >= done["account"] and not (at and text[at - 1].isalnum()) and (e := iban_end(text, at)):
                found["account"].append((at, e))
                done["account"] = e
        elif at >= done[kind] and not (at and text[at - 1].isalnum()):
            if kind == "secret":
                m = _SECRET.match(text, last + 1)
                span = m.span(1) if m and any("0" <= c <= "9" for c in m[1]) else None
            else:
                s = _CUE_END.match(text, last + 1).end()
                e = iban_end(text, s)
                if e is None and (m := _ACCOUNT.match(text, last + 1)):
                    s, e = m.start(1), _account_end(text, *m.span(1))
                span = (s, e) if e else None
            if span:
                found[kind].append(span)
                done[kind] = span[1]
    return found


def joined(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in found[k])


def detect(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Personal data of every whole text.

    Returns ``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)``, one row per input row:
    counts of the base kinds, the digest of their ``kind:start:end`` list and the list of all kinds,
    ordered by kind and start, in code points, end exclusive. A null or empty text has no spans; a
    null id stays null; repeated rows stay repeated; other columns are ignored.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: dict[str, list] = {k: [] for k in (*BASE, "sha", "spans")}
            for t in b.column(1).to_pylist():
                f = find(t)
                for k in BASE:
                    rows[k].append(len(f[k]))
                rows["sha"].append(hashlib.sha256(joined(f, BASE).encode()).hexdigest())
                rows["spans"].append(joined(f, KINDS))
            arrays = [b.column(0), *(pa.array(rows[k], pa.int64()) for k in BASE), pa.array(rows["sha"], pa.string()), pa.array(rows["spans"], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string"
    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string")).mapInArrow(lean(run), schema)


def redacted(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans merge under the
    kind that starts first, the longer one on a tie."""
    if not text:
        return text
    spans = sorted(((s, -e, k) for k, at in find(text).items() for s, e in at))
    if not spans:
        return text
    out, pos, i = [], 0, 0
    while i < len(spans):
        s, e, k = spans[i][0], -spans[i][1], spans[i][2]
        i += 1
        while i < len(spans) and spans[i][0] < e:
            e = max(e, -spans[i][1])
            i += 1
        out += [text[pos:s], f"[{k.upper()}]"]
        pos = e
    out.append(text[pos:])
    return "".join(out)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by ``[KIND]``; all columns and rows stay, null
    texts stay null."""
    ship(docs.sparkSession)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = names.index(text)
            clean = pa.array([redacted(t) for t in b.column(i).to_pylist()], pa.string())
            yield b.set_column(i, names[i], clean)

    return docs.mapInArrow(lean(run), docs.schema)
