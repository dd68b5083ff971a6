"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Map-only; each whole text is scanned once for each kind, in time linear in its length.

Kinds, in order: email, ip, card, phone (proposed by pattern, never retried inside a failing match) and iban. Beyond
the base spans the method adds: cards of 13 to 19 digits (Luhn; with 13 to 15 digits also a prefix that cards of that
length have) that are one or more neighbouring groups of a run of digits which is no base card, but not where an IBAN is; and IBANs (country code, length 15 to 34, mod 97 = 1), which end
at the country's length, or else with the whole candidate; for an unlisted country, with any of its groups.

score: 0.5 for a pattern alone, 0.8 after a passed checksum; 0.15 more if a context word of the kind stands, as a word of
its own, in the 40 characters before the span or the 40 after it, 0.15 less if a word that denies it does; within 0 to 1.

Defined results: a null or empty text has no spans; rows are independent of each other, so repeated rows give repeated
results; an empty table gives an empty one; other columns may be kept by name.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import fresh_name, map_texts

KINDS = ("email", "ip", "card", "phone", "iban")
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("base", T.BooleanType())])

_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local_reversed = re.compile(r"[A-Za-z0-9._%+-]*+")
# A match can only begin where a run of digits begins: the last match took whole runs, and a run that fails at its
# first digit fails at all others.
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_digits = re.compile(r"[0-9](?:[ -]?[0-9])++")
_group = re.compile(r"[0-9]+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_iban = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])")
#: Length of an IBAN by country.
IBAN_LENGTHS = {
    c: n
    for n, cs in {
        15: "NO", 16: "BE", 18: "DK FK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VA VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in cs.split()
}

#: Words near a span that speak for its kind, and against it; an s may follow.
CONTEXT = {
    "email": (("mail", "email", "contact", "write", "address"), ("example", "noreply")),
    "ip": (("ip", "host", "server", "addr", "address", "network"), ("version", "section", "release", "chapter")),
    "card": (("card", "visa", "mastercard", "amex", "credit", "payment", "karte", "carte", "tarjeta"), ("isbn", "order", "serial", "tracking")),
    "phone": (("phone", "telephone", "tel", "call", "mobile", "fax"), ("score", "offset")),
    "iban": (("iban", "bank", "account", "konto", "compte", "cuenta"), ()),
}
CONTEXT_CHARS = 40
_context = {k: tuple(re.compile(rf"(?<![^\W\d_])(?:{'|'.join(ws)})s?(?![^\W\d_])") if ws else None for ws in pair) for k, pair in CONTEXT.items()}
#: Prefixes of cards with less than 16 digits.
SHORT_CARDS = {13: ("4",), 14: ("30", "36", "38", "39"), 15: ("34", "37", "1800", "2131", "2014", "2149")}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def is_card(digits: str) -> bool:
    """Luhn, and for a short number a prefix of cards of its length."""
    n = len(digits)
    return 13 <= n <= 19 and (n >= 16 or digits.startswith(SHORT_CARDS[n])) and luhn(digits)


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str):
    """Each @ takes the local characters before it, back to the last @ or match at most, and a dotted domain after it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at - _local_reversed.match(text[end:at][::-1]).end()
        found = _domain.match(text, at + 1) if start < at else None
        end = found.end() if found else at + 1
        if found:
            yield start, end
        at = text.find("@", end)


def _iban_end(found: str) -> int | None:
    """Where the IBAN ends that a candidate begins with: at the country's length, else as a whole, else (country not
    listed) at the last group that fits."""
    ends = [i for i in range(15, len(found) + 1) if i == len(found) or found[i] == " "]
    sizes = {i: i - found.count(" ", 0, i) for i in ends}
    own = IBAN_LENGTHS.get(found[:2])
    tried = sorted((i for i in ends if 15 <= sizes[i] <= 34 and (own is None or sizes[i] == own or i == len(found))), key=lambda i: (sizes[i] != own, -i))
    return next((i for i in tried if mod97(found[:i].replace(" ", ""))), None)


def _ibans(text: str):
    """After a match the search goes on at its end, after a failure at the next word; a candidate is 44 characters at most."""
    m = _iban.search(text)
    while m:
        end = _iban_end(m[0])
        if end:
            yield m.start(), m.start() + end
        m = _iban.search(text, m.start() + (end or 1))


def _cards(run: str):
    """Cards in a run of digits: single groups that pass, then windows of the groups between these, from the left; at a
    group windows of 16 digits come first, then longer ones before shorter ones."""
    groups = [(g.start(), g.end()) for g in _group.finditer(run)]
    alone = [is_card(run[a:b]) for a, b in groups]
    i = 0
    while i < len(groups):
        windows, n, j = [], 0, i
        while j < len(groups) and (j == i or not alone[j] and not alone[i]) and n + groups[j][1] - groups[j][0] <= 19:
            n += groups[j][1] - groups[j][0]
            j += 1
            if n >= 13:
                windows.append((n != 16, -n, j))
        for _, _, j in sorted(windows):
            a, b = groups[i][0], groups[j - 1][1]
            if is_card(run[a:b].replace(" ", "").replace("-", "")):
                yield a, b
                i = j - 1
                break
        i += 1


def _proposals(text: str):
    """(kind, start, end, checked, base) in the order of KINDS, then by start."""
    if "@" in text:
        for a, b in _emails(text):
            yield "email", a, b, False, True
    for m in _ip.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end(), False, True
    ibans, k = list(_ibans(text)), 0
    for m in _digits.finditer(text):
        plain = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(plain) <= 19 and luhn(plain):
            yield "card", m.start(), m.end(), True, True
        elif len(plain) >= 13:
            for a, b in _cards(m[0]):
                a, b = m.start() + a, m.start() + b
                while k < len(ibans) and ibans[k][1] <= a:
                    k += 1
                if k == len(ibans) or ibans[k][0] >= b:
                    yield "card", a, b, True, False
    if "+" in text:
        for m in _phone.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield "phone", m.start(), m.end(), False, True
    for a, b in ibans:
        yield "iban", a, b, True, False


def find_spans(text: str | None) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, base) of one text; offsets in code points, end exclusive."""
    out = []
    for kind, a, b, checked, base in _proposals(text or ""):
        near = f"{text[max(0, a - CONTEXT_CHARS) : a]}\n{text[b : b + CONTEXT_CHARS]}".lower()
        for_it, against = (bool(p and p.search(near)) for p in _context[kind])
        score = (0.8 if checked else 0.5) + 0.15 * for_it - 0.15 * against
        out.append((kind, a, b, round(score, 2), base))
    return out


def pii_spans(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, and spans: array of (kind, start, end, score, base), by kind as listed, then start."""
    fields = [T.StructField("spans", T.ArrayType(SPAN))]
    names = [f.name for f in SPAN]
    return map_texts(docs, lambda: lambda texts: [([dict(zip(names, s, strict=True)) for s in find_spans(t)],) for t in texts], fields, list(keep))


def redact(text: str | None, least: float = 0.3) -> str | None:
    """text with every span of that score at least replaced by its kind in angle brackets; overlapping spans are
    replaced together, by the kind of the first."""
    spans = sorted((a, b, kind) for kind, a, b, score, _ in find_spans(text) if score >= least)
    out, at, i = [], 0, 0
    while i < len(spans):
        a, b, kind = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < b:
            i += 1
            b = max(b, spans[i][1])
        out += [text[at:a], f"<{kind}>"]
        at, i = b, i + 1
    return "".join([*out, text[at:]]) if out else text


def redacted(docs: DataFrame) -> DataFrame:
    """docs with personal data replaced in text; n_chars, if there, is the new length. A null text stays null."""
    names = docs.columns
    new = fresh_name("new_text", names)
    out = map_texts(docs, lambda: lambda texts: [(redact(t),) for t in texts], [T.StructField(new, T.StringType())], names)
    length = F.when(F.col("text").eqNullSafe(F.col(new)), F.col("n_chars")).otherwise(F.char_length(new).cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else None
    return out.select(*(F.col(new).alias(c) if c == "text" else length.alias(c) if c == "n_chars" else F.col(c) for c in names))
