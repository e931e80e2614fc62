"""Personal data and secrets by candidate generation and gradient boosting.

Fixed patterns give the base spans, which always stay. High-recall generators propose further,
overlapping spans: spelt-out addresses, telephone numbers, bracketed or colon addresses of hosts,
card numbers as every run of neighbouring digit groups with a fitting count of digits, keys,
tokens and assigned passwords (secret), and identity and account numbers (account). Boosted trees
score each proposal by its format and the words around it. A threshold for each kind selects
spans, best first and of equals the longest, that overlap no other.

The trees are trained on the driver on TRAINING_ROWS generated rows (no row of the input), so the
model is the same at every size. Their probabilities and the thresholds are calibrated on
CALIBRATION_ROWS further rows from contexts, fillers and separators that the training rows don't
have; a kind's threshold is the least one at which its precision there is PRECISION, if
FALSE_A_TRUE false proposals come on a true one. Texts are searched whole.

Defined results: null and empty texts have no spans; spans count code points, end exclusive;
n_email to n_phone and base_sha256 cover the base spans, spans covers all, n_added the others,
n_secret and n_account those of these kinds, n_spans all; repeated rows give repeated rows; null
ids are passed on; further columns are ignored, whatever they are called.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Boosted
from .shared import text_parts, trim

KINDS = ("email", "ip", "card", "phone", "secret", "account")
#: Kinds that the fixed patterns know.
BASE_KINDS = 4
#: Generated rows that the trees are trained and calibrated on.
TRAINING_ROWS, CALIBRATION_ROWS = 6000, 3000
#: Precision that each kind's threshold reaches on the calibration rows, if so many false proposals come on a true one.
PRECISION, FALSE_A_TRUE = 0.97, 10

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DIGIT = re.compile(r"[0-9]")

_AT = re.compile(r" ?[\[({] ?at ?[\])}] ?| at ", re.I)
_BEFORE = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?: ?[\[({] ?dot ?[\])}] ?| dot |\.)[A-Za-z0-9-]{1,63}){1,6}", re.I)
_HOST = re.compile(r"(?<![0-9A-Za-z.:])(?:[0-9]{1,3}(?: ?[\[({](?:\.|dot)[\])}] ?[0-9]{1,3}){3}|(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,7})(?![0-9A-Za-z:])")
_NUMBER = re.compile(r"(?<![0-9A-Za-z.+/-])\(?[0-9]{2,6}\)?(?:(?:[ ./_-]{1,3}|(?<=\)))\(?[0-9]{2,6}\)?)+(?![0-9A-Za-z])")
_GROUP = re.compile(r"\(?([0-9]+)\)?")
_BARE = re.compile(r"(?<![0-9A-Za-z.+/-])[0-9]{10}(?![0-9A-Za-z])")
_PLUS = re.compile(r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2,4}){2,3}(?![0-9])")
_SOLID = re.compile(r"(?<![0-9])[0-9]{14,19}(?![0-9])")

_KEY = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_-]{16,4096}+={0,2}(?![A-Za-z0-9+/_-])")
_ASSIGNED = re.compile(r"(?:pass(?:word|wd|phrase)|pwd|secret|token|key)[\"']? ?(?:[:=]|is) ?[\"']?([^\s\"'<>]{6,128}+)", re.I)
_PASS = re.compile(r"pass|pwd|secret", re.I)
_NAMES = re.compile(r"passw|passp|pwd|secret|token|key", re.I)
_DIGITS = re.compile(r"(?<![0-9A-Za-z.,:/#-])[0-9]{9,20}+(?![0-9A-Za-z/:-]|[.,][0-9])")
_IDENTITY = re.compile(r"(?<![0-9A-Za-z.-])[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}(?![0-9A-Za-z-])|(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")

#: Digit groups beside a span.
_LEFT, _RIGHT = re.compile(r"[0-9]\)?[ ./_-]{0,3}\Z"), re.compile(r"[ ./_-]{0,3}\(?[0-9]")

#: Words around a span that speak for its kind, or against any.
_HINTS = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write|reach|address|correo|courriel|kontakt)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|address|login|logged|client|from|connection|addr|gateway|dns)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|amex|credit|debit|payment|paid|cvv|expires?|tarjeta|carte|karte)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|telephone|call|mobile|cell|fax|dial|text|whatsapp|telefon|teléfono|téléphone|ring)\b", re.I),
    "secret": re.compile(r"(?:pass(?:word|wd|phrase)|pwd|secret|token|api|auth|bearer|credential|private|access|(?<![a-z])key)", re.I),
    "account": re.compile(r"\b(?:account|acct|iban|ssn|social|security|passport|tax|identity|licen[cs]e no|customer|konto|cuenta|compte|bank|routing|member|policy)\b", re.I),
}
_AGAINST = re.compile(r"\b(?:version|release|order|invoice|isbn|issn|serial|id|ref|section|page|pages|date|build|model|sku|part|copyright|total|amount|score|year|since|time|lat|lon|rfc)\b", re.I)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns: leftmost, not overlapping within a kind."""
    out = []
    at = text.find("@")
    done = 0
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            out.append((m.start(), 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _digits(m[0])
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def proposals(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) from the generators; they may overlap each other and the base spans."""
    out = []
    if _NAMES.search(text):
        out += [(m.start(1), 4, m.end(1)) for m in _ASSIGNED.finditer(text)]
    if "at" in text or "AT" in text or "At" in text:
        for m in _AT.finditer(text):
            before = _BEFORE.search(text[max(0, m.start() - 64) : m.start()])
            after = _DOMAIN.match(text, m.end())
            if before and after and (m[0] != " at " or " dot " in after[0].lower() or "." in after[0]):
                out.append((m.start() - (before.end() - before.start()), 0, after.end()))
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _HOST.finditer(text)]
        for m in _NUMBER.finditer(text):
            groups = [(g.start(), g.end(), len(g[1])) for g in _GROUP.finditer(text, m.start(), m.end())]
            for i, (start, _, n) in enumerate(groups):
                for _, end, more in groups[i + 1 : i + 10]:
                    n += more
                    if 14 <= n <= 19:
                        out.append((start, 2, end))
                    if 7 <= n <= 15:
                        out.append((start, 3, end))
        out += [(m.start(), 3, m.end()) for m in _BARE.finditer(text)]
        out += [(m.start(), 2, m.end()) for m in _SOLID.finditer(text)]
        out += [(m.start(), 4, m.end()) for m in _KEY.finditer(text) if not m[0].isalpha() and not m[0].isdigit()]
        out += [(m.start(), 5, m.end()) for m in chain(_DIGITS.finditer(text), _IDENTITY.finditer(text))]
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PLUS.finditer(text)]
    return out


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    """Format of the span and words around it."""
    span = text[start:end]
    before, after = text[max(0, start - 40) : start], text[end : end + 30]
    digits = _digits(span)
    groups = [len(x) for x in re.findall(r"[0-9]+", span)]
    seps = [x for x in re.findall(r"[^0-9A-Za-z]+", span)]
    row = [float(kind == k) for k in range(len(KINDS))]
    row += [len(span), len(digits), len(groups), max(groups, default=0), min(groups, default=0), len(seps), len(set(seps)), max(map(len, seps), default=0)]
    row += [float(_luhn(digits)) if digits else 0.0, float(groups in ([3, 3, 4], [4, 4, 4, 4], [4, 6, 5], [3, 4], [2, 2, 2, 2, 2], [3, 3, 3])), float(groups[:1] == [4] and groups[1:] in ([2, 2], [2, 2, 2, 2], [2, 2, 2]))]
    row += [float("(" in span), float("dot" in span.lower()), float(bool(re.search(r"[\[({] ?(?:at|dot|\.)", span, re.I))), span.count("."), span.count(":"), sum(c.isalpha() for c in span)]
    row += [float(bool(_HINTS[KINDS[kind]].search(before + " " + after))), float(bool(_HINTS[KINDS[kind]].search(before[-20:]))), float(bool(_AGAINST.search(before[-25:])))]
    row += [float(before[-1:].isalnum()), float(before[-1:] in "#$€%=/"), float(after[:1] in "%/=:"), float(bool(re.search(r"(?:com|org|net|edu|io|de|fr|es|uk)\Z", span, re.I)))]
    row += [float(span[:1] == "0"), float(span[:1] in "3456"), float(span[:1] == "+")]
    row += [float(bool(_LEFT.search(before))), float(bool(_RIGHT.match(after))), float(groups in ([4, 4, 4, 4], [4, 6, 5], [16])), float(groups in ([3, 3, 4], [10])), float(span.count("(") != span.count(")"))]
    letters = sum(c.isalpha() for c in span)
    hexes = sum(c in "0123456789abcdefABCDEF" for c in span)
    turns = sum(x.isdigit() != y.isdigit() for x, y in pairwise(span))
    row += [len(set(span)), len(set(span)) / len(span), hexes / len(span), len(digits) / len(span), turns / len(span), letters - sum(c.islower() for c in span), float(before.rstrip(" \"'")[-1:] in "=:"), float(before[-1:] in "\"'" and after[:1] in "\"'"), float(sum(c in "-_/" for c in span)), float(digits == span), float(bool(_PASS.search(before[-16:]))), float(sum(not c.isalnum() for c in span))]
    return row


def _generated(rows: int, seed: int, unseen: bool = False) -> Iterator[tuple[str, int, int, int, bool]]:
    """Texts with one span (start, kind, end) and whether it is personal data; unseen: in contexts that the others don't have."""
    r = random.Random(seed)
    filler = ["the", "of", "and", "was", "here", "with", "lorem", "para", "les", "und", "some", "note", "this", "entry"]
    if unseen:
        filler = ["our", "Report", "then", "sich", "pour", "donde", "about", "|", "see", "*", "new", "must", "Item", "(as"]
    more = lambda a, b: r.choice(b if unseen else a)
    word = lambda n=3: " ".join(r.choice(filler) for _ in range(n))
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    name = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(3, 8)))

    def card() -> str:
        body = r.choice("3456") + num(14)
        return next(body + c for c in "0123456789" if _luhn(body + c))

    def spaced(digits: str, sep: str) -> str:
        return sep.join(digits[i : i + 4] for i in range(0, 16, 4))

    def email(yes: bool) -> tuple[str, str, str]:
        if yes:
            o, c = r.choice(["[]", "()", "{}"])
            at = r.choice([f" {o}at{c} ", f"{o}at{c}", " at "])
            dot = r.choice([f" {o}dot{c} ", f"{o}dot{c}", "."]) if at != " at " else " dot "
            return r.choice(["mail ", "contact me: ", "write to ", "", word(1) + " "]), name() + r.choice(["", "." + name()]) + at + name() + dot + r.choice(["com", "org", "net", "de", "fr", "es", "io"]), r.choice([" ", ".", ""])
        return r.choice(["", word(2) + " "]), r.choice(filler) + " at " + name() + "." + r.choice([name().title(), name(), r.choice(filler)]), " "

    def ip(yes: bool) -> tuple[str, str, str]:
        o, c = r.choice(["[]", "()"])
        parts = [str(r.randint(1, 254)) for _ in range(4)]
        if yes:
            if r.random() < 0.4:
                return r.choice(["ip ", "host ", "from ", "server ", ""]), ":".join("".join(r.choice("0123456789abcdef") for _ in range(4)) for _ in range(8)), " "
            return r.choice(["ip ", "host ", "from ", ""]), r.choice([f"{o}.{c}", f"{o}dot{c}"]).join(parts), " "
        return r.choice(["time ", "", "at ", "ratio ", "version "]), r.choice([":".join(num(2) for _ in range(r.randint(3, 4))), "::".join([num(1), num(2), num(1)]) + ":" + num(1), ":".join(name()[:2].translate(str.maketrans("ghijklmnoprstuvw", "abcdefabcdefabcd")) for _ in range(6))]), r.choice([" ", "."])

    def card_span(yes: bool) -> tuple[str, str, str]:
        seps = [".", "/", "_", "  ", " - ", "", ""]
        if yes:
            sep = r.choice([*seps, " "])
            tail = r.choice([" ", ".", " exp", f" {num(2)}/{num(2)} ", f" {num(3)} ", f" {spaced(card(), sep or '.')} "])
            return r.choice(["card ", "visa: ", "paid with ", "credit card ", "", f"{num(4)} ", f"card {num(4)} "]), spaced(card(), sep), tail
        if r.random() < 0.5:  # a card with a part of its neighbour, or a part of a card with it
            sep = r.choice([".", "/", "_", " ", "-"])
            whole, near = spaced(card(), sep), r.choice([num(2), num(3), f"{num(2)}/{num(2)}"])
            lead = r.choice(["card ", "visa: ", "paid with ", ""])
            return r.choice([(lead, f"{whole} {near}", " "), (lead, f"{near} {whole}", " "), (f"{lead}{whole[:5]}", f"{whole[5:]} {num(4)}", " "), (lead, f"{num(4)} {whole[:14]}", whole[14:] + " ")])
        return r.choice(["order ", "serial ", "ref ", "", "id ", "total "]), spaced(next(x for _ in range(99) if not _luhn(x := num(16))), r.choice([*seps, " ", "-"])), r.choice([" ", "."])

    def phone(yes: bool) -> tuple[str, str, str]:
        if yes:
            sep = r.choice([" ", "-", ".", "-"])
            lead, tail = r.choice(["call ", "phone: ", "tel ", "tel. ", "mobile ", "fax ", "dial ", ""]), r.choice([" ", ".", ","])
            usual = lambda: sep.join([r.choice("23456789") + num(2), num(3), num(4)])
            shape = r.random()
            if shape < 0.15:
                return lead or "call ", r.choice("23456789") + num(9), tail
            if shape < 0.3:
                return lead, f"({num(3)}){num(3)}-{num(4)}", tail
            if shape < 0.45:
                return r.choice([(f"{lead}{usual()} ", usual(), tail), (lead, usual(), f" {usual()} "), (lead, usual(), f" {num(3)} ")])
            form = r.choice(["({}) {}-{}", "({}) {} {}"]).format(num(3), num(3), num(4)) if r.random() < 0.4 else sep.join([r.choice("23456789") + num(2), num(3), num(4)])
            if r.random() < 0.2:
                form = sep.join(["0" + r.choice("123456789"), num(2), num(2), num(2), num(2)])
            elif r.random() < 0.3:
                form = f"+{r.randint(1, 99)} {form}"
            return lead, form, tail
        shape = r.random()
        if shape < 0.3:  # a number with a part of its neighbour, or a part of it
            sep, lead = r.choice([" ", "-", "."]), r.choice(["call ", "phone: ", "tel ", "mobile ", ""])
            a, b = ([r.choice("23456789") + num(2), num(3), num(4)] for _ in range(2))
            return r.choice([(lead, f"{sep.join(a)} {b[0]}", sep + sep.join(b[1:]) + " "), (lead + a[0] + sep, f"{sep.join(a[1:])} {b[0]}", sep + sep.join(b[1:]) + " "), (lead + sep.join(a[:2]) + sep, f"{a[2]} {sep.join(b)}", " "), (lead + a[0] + sep, sep.join(a[1:]), " "), (lead, f"({a[0]}){a[1]}", f"-{a[2]} "), (lead + f"({a[0]})", f"{a[1]}-{a[2]}", " ")])
        if shape < 0.5:  # parts of cards and dates, counts, bare ids
            body, sep = card(), r.choice([".", " ", "-", "/", "_"])
            cut = r.randint(0, 1)
            return r.choice([(f"card {body[:4]}{sep}" if cut else "card ", sep.join(body[i : i + 4] for i in range(4 * cut, 4 * cut + r.choice([8, 12]), 4)), f"{sep}{body[12:]} "), (r.choice(["Copyright ", "years ", ""]), f"{r.randint(1900, 2030)}-{r.randint(1900, 2030)}", " "), (r.choice(["on ", "date ", ""]), f"{r.randint(1900, 2030)}-{num(2)}-{num(2)} {num(2)}", f":{num(2)} "), (r.choice(["order ", "id ", "serial ", "ref ", "total ", "", word(2) + " "]), num(10), " "), (r.choice(["order ", "total ", ""]), f"{num(4)} {num(4)}", " of 2020")])
        bad = [f"{r.randint(1900, 2030)}-{num(2)}-{num(2)}", f"{num(2)}.{num(2)}.{r.randint(1900, 2030)}", f"{num(2)}/{num(2)}/{num(4)}", f"{num(2)} {num(3)} {num(3)}", f"978-{num(1)}{num(1)}-{num(4)}-{num(3)}", f"{num(4)}-{num(4)}-{num(3)}", f"{num(2)}.{num(3)}.{num(2)}", f"{num(3)} {num(3)} {num(3)}", f"{num(4)} {num(2)} {num(4)}", f"{num(5)}-{num(5)}-{num(3)}"]
        return r.choice(["date ", "order ", "", "isbn ", "page ", "since ", "total ", word(1) + " "]), r.choice(bad), r.choice([" ", ".", " eur"])

    def secret(yes: bool) -> tuple[str, str, str]:
        chars = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
        some = lambda c, lo, hi: "".join(r.choice(c) for _ in range(r.randint(lo, hi)))
        if yes:
            lead = more(["token = ", "api_key: ", "password=", "secret: ", "key = ", "password is ", "password: ", "", word(1) + " "], ["auth token ", "access_key=", "passwd: ", "bearer ", "private key ", "credentials ", word(2) + " "])
            body = r.choice([lambda: some("0123456789abcdef", 32, 64), lambda: "AK" + some(chars[26:], 16, 18), lambda: some(chars, 24, 60), lambda: some(chars, 3, 5) + "_" + some(chars, 20, 36), lambda: some(chars + "+/", 30, 86) + r.choice(["", "=", "=="])])()
            if ("pass" in lead or "secret" in lead) and r.random() < 0.6:
                body = r.choice([some(chars + "!#$%", 8, 14), name() + num(r.randint(1, 4)) + r.choice(["", "!", "#", "!x9", name()]), name() + r.choice("!_-#") + name() + num(2)])
            quote = r.choice(["", '"', "'"])
            body = body.upper() if r.random() < 0.1 else body
            return lead + quote, body, quote + r.choice([" ", "\n", ";", ","])
        lead = more(["file ", "", "see ", "version ", "the key: ", "password is "], ["path ", "url ", "token ring ", "key: ", word(1) + " "])
        body = r.choice([lambda: "-".join(name() for _ in range(4)) + "-" + num(r.randint(1, 4)), lambda: "/".join([name(), name(), name() + num(2), name()]), lambda: "_".join(name() for _ in range(4)) + num(1), lambda: name() + name() + name() + num(r.randint(1, 4)), lambda: f"{r.randint(1990, 2030)}-{num(2)}-{num(2)}-{name()}-{name()}", lambda: r.choice([name() + name(), "required", "missing", "invalid."]), lambda: "a" * r.randint(16, 40) + "1", lambda: "-" * r.randint(12, 30) + num(4)])()
        return lead, body, r.choice([" ", ".html ", "\n", ","])

    def account(yes: bool) -> tuple[str, str, str]:
        if yes:
            shape = r.random()
            if shape < 0.35:
                return more(["account ", "acct: ", "passport ", "tax id ", "member "], ["bank account no. ", "customer no. ", "konto ", "policy "]), num(r.randint(9, 18)), r.choice([" ", ".", ","])
            if shape < 0.6:  # as long as cards, without a word for it: mistyped cards and accounts
                return more(["", word(1) + " ", word(3) + ". "], ["", word(2) + " "]), r.choice("123456789") + num(r.choice([13, 14, 15, 15, 15, 15, 18])), r.choice([" ", ".", "\n"])
            if shape < 0.8:
                return more(["ssn ", "social security ", "", word(1) + " "], ["SSN: ", "security no. ", word(2) + " "]), f"{num(3)}-{num(2)}-{num(4)}", r.choice([" ", ".", ","])
            groups = " ".join(num(4) for _ in range(r.randint(3, 6)))
            return more(["iban ", "IBAN: ", "to ", ""], ["account ", "konto ", "pay to "]), r.choice(["DE", "FR", "ES", "GB", "NL"]) + num(2) + r.choice([" " + groups, groups.replace(" ", "")]), r.choice([" ", "."])
        lead = more(["order ", "isbn ", "serial ", "time ", "ref ", "total ", "build ", "id "], ["sku ", "invoice ", "rfc ", "model ", "score ", "time since "])
        return lead, r.choice([num(r.randint(9, 13)), f"1{num(12)}", f"{num(3)}-{num(2)}-{num(4)}", num(16), "AB" + num(2) + "".join(r.choice("ABCDEF0123456789") for _ in range(12))]), r.choice([" ", ".", " eur"])

    makers = (email, ip, card_span, phone, secret, account)
    for i in range(rows):
        kind, yes = i % len(makers), r.random() < 0.5
        lead, span, tail = makers[kind](yes)
        head = word(r.randint(0, 6))
        text = (head + " " if head else "") + lead
        yield text + span + tail + word(3), len(text), kind, len(text) + len(span), yes


@functools.cache
def model() -> tuple[Boosted, tuple[float, ...]]:
    """The trees and each kind's threshold; made on the driver."""
    train, held = ([(features(t, s, k, e), k, yes) for t, s, k, e, yes in rows] for rows in (_generated(TRAINING_ROWS, 7), _generated(CALIBRATION_ROWS, 8, unseen=True)))
    outcome = lambda rows: np.array([float(yes) for _, _, yes in rows])
    trees = Boosted(trees=80, depth=4).fit(np.array([f for f, _, _ in train]), outcome(train)).calibrate([f for f, _, _ in held], outcome(held))
    thresholds = []
    for kind in range(len(KINDS)):
        scored = sorted(((trees.probability(f), yes) for f, k, yes in held if k == kind), reverse=True)
        right = wrong = 0
        threshold = 1.0
        for p, yes in scored:
            right, wrong = right + yes, wrong + (not yes)
            if right >= PRECISION * (right + FALSE_A_TRUE * wrong):
                threshold = p
        thresholds.append(threshold)
    return trees, tuple(thresholds)


def find(text: str, trees: Boosted, thresholds: tuple[float, ...]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and added spans, (start, kind, end)."""
    base = base_spans(text)
    new = proposals(text)
    if not new:
        return base, []
    taken = [(s, e) for s, _, e in base]
    scored = []
    for s, k, e in new:
        if all(e <= a or s >= b for a, b in taken):
            p = trees.probability(features(text, s, k, e))
            if p >= thresholds[k]:
                scored.append((-p, s - e, s, k, e))
    added = []
    for _, _, s, k, e in sorted(scored):
        if all(e <= a or s >= b for a, b in taken):
            taken.append((s, e))
            added.append((s, k, e))
    return base, added


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def spans(docs: DataFrame) -> DataFrame:
    """Spans of every document; no shuffle."""
    trees, thresholds = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, texts in text_parts(b.column(1)):
                rows = []
                for t in texts:
                    base, added = find(t or "", trees, thresholds)
                    counts = [0] * len(KINDS)
                    for _, k, _ in base:
                        counts[k] += 1
                    for _, k, _ in added:
                        counts[k] += k >= BASE_KINDS
                    rows.append((*counts[:BASE_KINDS], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(sorted(base + added)), len(added), *counts[BASE_KINDS:], len(base) + len(added)))
                cols = zip(*rows, strict=True)
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 4
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(texts)), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_secret", "n_account", "n_spans"])
        trim()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_secret long, n_account long, n_spans long")


def redact_text(text: str, trees: Boosted, thresholds: tuple[float, ...]) -> str:
    """The text with each run of overlapping spans replaced by its first span's kind."""
    base, added = find(text, trees, thresholds)
    out, at, reach = [], 0, -1
    for s, k, e in sorted(base + added):
        if s >= reach:
            out += [text[max(at, 0) : s], f"<{KINDS[k].upper()}>"]
        reach = max(reach, e)
        at = reach
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame) -> DataFrame:
    """docs with redacted texts (null stays null) and n_chars brought in line; no shuffle."""
    trees, thresholds = model()
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, texts in text_parts(b.column(at)):
                clean = [None if t is None else redact_text(t, trees, thresholds) for t in texts]
                yield b.slice(lo, len(texts)).set_column(at, b.schema.field(at), pa.array(clean, b.schema.field(at).type))
        trim()

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents with personal data and secrets redacted, row by row: ids may be null or repeated."""
    return redact(docs)
