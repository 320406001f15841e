"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs before a digit, digits, schemes, and cues such
as "password". A parser at each anchor expands to both sides, checks the boundaries and validates: emails, IPv4
addresses, card numbers (Luhn), phone numbers, and beyond these logins in URLs, account numbers (IBAN, mod 97) and
secrets that a cue announces. Within a kind, spans are the leftmost that don't overlap; a candidate that fails its
check is dropped and its text not tried again.

Defined results: null and empty texts have no spans; repeated rows have equal results; texts of any length are read
whole; an empty table gives an empty result. Columns beyond doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "login", "iban", "secret")
Span = tuple[int, str, int]  # start, kind, end

_DIGITS = frozenset("0123456789")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOGIN = re.compile(r"[^\s/@:\"'<>]+:[^\s/@\"'<>]+@[A-Za-z0-9.-]+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_VALUE = re.compile(r"""["']?\s{0,3}[:=]\s{0,3}["']?([A-Za-z0-9_+/.=-]{8,})""")
_KEY = re.compile(r"[A-Z0-9]{16}(?![A-Za-z0-9])")
CUES = ("token", "password", "passwd", "secret", "api_key", "apikey", "access_key")


def _email(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    domain = _DOMAIN.match(text, at + 1) if start < at else None
    return (start, domain.end(), True) if domain else None


def _ip(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    found = _IP.match(text, at)
    if not found:
        return None
    parts = (p.lstrip("0") for p in found[0].split("."))
    return found.start(), found.end(), all(len(p) < 3 or (len(p) == 3 and p <= "255") for p in parts)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _card(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    found = _CARD.match(text, at)
    if not found:
        return None
    digits = found[0].replace(" ", "").replace("-", "")
    return found.start(), found.end(), 12 <= len(digits) <= 19 and luhn(digits)


def _phone(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    found = _PHONE.match(text, at)
    return (found.start(), found.end(), 9 <= sum(c in _DIGITS for c in found[0]) <= 15) if found else None


def _login(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    start = at
    while start > floor and text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "+.-"):
        start -= 1
    found = _LOGIN.match(text, at + 3) if start < at else None
    return (start, found.end(), True) if found else None


def _iban(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    """at: the first of two digits after two capitals."""
    start = at - 2
    if start < floor or (start and text[start - 1].isalnum()):
        return None
    found = _IBAN.match(text, start)
    if not found:
        return None
    plain = found[0].replace(" ", "")
    number = "".join(str(int(c, 36)) for c in plain[4:] + plain[:4])
    return start, found.end(), 15 <= len(plain) <= 34 and int(number) % 97 == 1


def _secret(text: str, end: int, floor: int) -> tuple[int, int, bool] | None:
    """end: after the cue. Letters alone are no secret, and a cue inside a word is none."""
    found = _VALUE.match(text, end)
    return (found.start(1), found.end(1), any(c in _DIGITS for c in found[1])) if found else None


def _key(text: str, end: int, floor: int) -> tuple[int, int, bool] | None:
    found = _KEY.match(text, end)
    start = end - 4
    return (start, found.end(), True) if found and not (start and text[start - 1].isalnum()) else None


Parser = tuple[str, Callable[[str, int, int], "tuple[int, int, bool] | None"], bool]  # kind, parser, given the anchor's end
_AT_DIGIT: tuple[Parser, ...] = (("ip", _ip, False), ("card", _card, False), ("iban", _iban, False))


@cache
def _automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    parsers: dict[str, tuple[Parser, ...]] = {"@": (("email", _email, False),), "://": (("login", _login, False),), "AKIA": (("secret", _key, True),), "ASIA": (("secret", _key, True),)}
    parsers |= {d: _AT_DIGIT for d in "0123456789"} | {f"+{d}": (("phone", _phone, False),) for d in "0123456789"}
    for cue in CUES:
        parsers |= {form: (("secret", _secret, True),) for form in (cue, cue.title(), cue.upper())}
    for word, found in parsers.items():
        out.add_word(word, (len(word), found))
    out.make_automaton()
    return out


def find_spans(text: str) -> list[Span]:
    """All spans by start, then kind in the order of KINDS, then end."""
    found: list[Span] = []
    floor = dict.fromkeys(KINDS, 0)
    for last, (length, parsers) in _automaton().iter(text):
        start = last + 1 - length
        if parsers is _AT_DIGIT and start and text[start - 1] in _DIGITS and start > floor["ip"] and start > floor["card"]:
            continue  # what begins inside a run of digits has been tried at the run's start
        for kind, parse, after in parsers:
            if start < floor[kind]:
                continue
            if (span := parse(text, last + 1 if after else start, floor[kind])) is not None:
                floor[kind] = span[1]
                if span[2]:
                    found.append((span[0], kind, span[1]))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(found, key=lambda s: (s[0], order[s[1]], s[2]))


def scan_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_other."""
    id_field = docs.schema["doc_id"]
    counts = [T.StructField(f"n_{k}", T.LongType()) for k in (*BASE_KINDS, "other")]
    schema = T.StructType([id_field, *counts, T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for value in batch.column(1):
                spans = find_spans(value.as_py() or "")
                told = [f"{kind}:{start}:{end}" for start, kind, end in spans]
                base = ",".join(t for t, s in zip(told, spans, strict=True) if s[1] in BASE_KINDS)
                numbers = [sum(s[1] == k for s in spans) for k in BASE_KINDS]
                for c, v in zip(columns, (*numbers, len(spans) - sum(numbers), hashlib.sha256(base.encode()).hexdigest(), ",".join(told)), strict=True):
                    c.append(v)
            arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(c, pa.string()) for c in columns[5:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(scan, schema)
