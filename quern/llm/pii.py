"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors (at-signs, plus signs, digits, schemes, identifier cues)
in a single pass over the whole text; at each anchor a deterministic local parser expands to both
sides and validates. Work is linear in the text, and only anchors reach a parser. An IBAN is found by its head, two
capitals and two digits, with or without a cue, and holds if its check digits do.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import by_batch, id_text, small_batches

#: Kinds in the order in which spans are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "url", "iban", "account", "secret")
BASE_KINDS = KINDS[:4]

#: Anchors and the parser that each starts.
SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://", "mailto:", "www.")
ACCOUNT_CUES = ("account", "acct", "konto", "compte", "cuenta", "ssn", "passport", "iban")
SECRET_CUES = ("token", "password", "passwd", "secret", "api_key", "apikey")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = frozenset("0123456789")
_CAPITALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_URL = re.compile(r"[^\s\"'<>|\\^`{}]+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
_ACCOUNT = re.compile(r"(?:[\x20\t]*(?:no\.?|nr\.?|number|nummer|#)){0,1}[\x20\t]*[:=#]?[\x20\t]*([A-Z]{0,3}[0-9](?:[\x20-]?[0-9A-Z]){5,33})(?![A-Za-z0-9])", re.ASCII)
_SECRET = re.compile(r"[\x20\t]*[:=][\x20\t]*([\"']?)([A-Za-z0-9_+/=.-]{16,})\1", re.ASCII)


@lru_cache
def _anchors():
    import ahocorasick

    found = ahocorasick.Automaton()
    for c in "@+" + "0123456789":
        found.add_word(c, (c if c in "@+" else "0", 1))
    for kind, words in (("url", SCHEMES), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for w in words:
            for form in {w, w.upper(), w.capitalize()}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def _email(text: str, at: int, since: int) -> tuple[int, int] | None:
    start = at
    while start > since and text[start - 1] in _LOCAL:
        start -= 1
    m = _DOMAIN.match(text, at + 1)
    return (start, m.end()) if m and start < at else None


def _octets(found: str) -> bool:
    return all(len(d := part.lstrip("0")) <= 3 and int(d or "0") <= 255 for part in found.split("."))


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _card(found: str) -> bool:
    digits = found.replace(" ", "").replace("-", "")
    return 16 <= len(digits) <= 19 and _luhn(digits)


def _phone(found: str) -> bool:
    return 8 <= sum(c in _DIGITS for c in found) <= 15


def _iban(found: str) -> bool:
    flat = found.replace(" ", "")
    moved = flat[4:] + flat[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _iban_at(text: str, at: int) -> int | None:
    """End of the longest valid IBAN that begins at at; what follows it may look like more of it."""
    m = _IBAN.match(text, at)
    end = m.end() if m else 0
    while end - at >= 15:
        if _iban(text[at:end]):
            return end
        end = text.rfind(" ", at, end)
    return None


def _iban_within(text: str, at: int, end: int) -> int | None:
    """Where the first valid IBAN that begins between at and end does; both are near, as _ACCOUNT is bounded."""
    while m := _IBAN_HEAD.search(text, at, end):
        if _iban_at(text, m.start()):
            return m.start()
        at = m.start() + 1
    return None


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive; by kind as in KINDS, then start.

    Within a kind spans are leftmost and don't overlap; spans of different kinds may. Null or empty
    text has none.
    """
    if not text:
        return []
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    since = dict.fromkeys(KINDS, 0)
    for last, (anchor, length) in _anchors().iter(text):
        at = last - length + 1
        if anchor == "@":
            span = _email(text, at, since["email"])
            if span:
                found["email"].append(span)
                since["email"] = span[1]
        elif anchor == "0":
            if at and text[at - 1] in _DIGITS and at not in (since["ip"], since["card"]):
                continue
            # Digits after two capitals that start a word: the head of an IBAN, wherever it stands.
            if at > 1 and at - 2 >= since["iban"] and text[at - 2] in _CAPITALS and text[at - 1] in _CAPITALS and (at < 3 or not text[at - 3].isalnum()) and (end := _iban_at(text, at - 2)):
                found["iban"].append((at - 2, end))
                since["iban"] = end
            for kind, pattern, valid in (("ip", _IP, _octets), ("card", _CARD, _card)):
                if at >= since[kind] and (m := pattern.match(text, at)):
                    since[kind] = m.end()  # a match that fails its test is dropped, not tried again
                    if valid(m[0]):
                        found[kind].append(m.span())
        elif anchor == "+":
            if at >= since["phone"] and (m := _PHONE.match(text, at)):
                since["phone"] = m.end()
                if _phone(m[0]):
                    found["phone"].append(m.span())
        elif anchor == "url":
            if at >= since["url"] and (not at or not text[at - 1].isalnum()) and (m := _URL.match(text, last + 1)):
                end = m.end()
                while end > last + 1 and text[end - 1] in ".,;:!?)]":
                    end -= 1
                if end > last + 1:
                    found["url"].append((at, end))
                    since["url"] = end
        elif at and text[at - 1].isalnum() or at < since[anchor]:
            continue
        elif anchor == "secret":
            if m := _SECRET.match(text, last + 1):
                found["secret"].append(m.span(2))
                since["secret"] = m.end()
        else:
            m = _ACCOUNT.match(text, last + 1)
            # An IBAN there is found by its own head; the account is what stands before it, if anything.
            if m and (head := _iban_within(text, *m.span(1))) is not None:
                m = _ACCOUNT.match(text, last + 1, head)
            if m:
                found["account"].append(m.span(1))
                since["account"] = m.end()
    return [(k, s, e) for k in KINDS for s, e in found[k]]


def redact(text: str | None) -> str | None:
    """text with every span replaced by [KIND]; spans that overlap become one, named after the first."""
    if not text:
        return text
    parts, at = [], 0
    spans = sorted((s, -e, KINDS.index(k)) for k, s, e in find_spans(text))
    for s, e, k in spans:
        if s >= at:
            parts += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, -e)
    return "".join([*parts, text[at:]])


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def pii_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): one row a document; null and empty texts have an empty list.

    Whole texts, any length; repeated rows are answered alike; other columns aren't read.
    """

    def rows(c: dict) -> dict:
        return {"doc_id": c["doc_id"], "spans": [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t)] for t in c["text"]]}

    return by_batch(id_text(docs), rows, f"doc_id bigint, spans {SPANS}")


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with the text column redacted; null text stays null, all columns and rows stay."""

    @F.pandas_udf("string")
    def hide(texts: pd.Series) -> pd.Series:
        return texts.map(redact, na_action="ignore")

    small_batches(docs.sparkSession)
    return docs.withColumn("text", hide(F.col("text")))
