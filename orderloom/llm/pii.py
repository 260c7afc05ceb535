"""Personal data in texts: patterns propose spans, checksums confirm them, nearby words adjust the score.

The score decides: spans of an added kind count from ``SHOWN_AT`` on, and ``redact`` masks spans from ``MASKED_AT`` on.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm.common import map_arrow

KINDS = ("email", "ip", "card", "phone", "iban", "key", "secret")
BASE_KINDS = ("email", "ip", "card", "phone")
SHOWN_AT = 0.7  # least score of a span of an added kind
MASKED_AT = 0.4  # least score of a span that is masked

# Lengths of the account numbers of some countries.
IBAN_LENGTH = {
    "AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27,
    "HU": 28, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24,
}

# A kind's score without context, after its check; what has a checksum starts higher.
START_SCORE = {"email": 0.8, "ip": 0.5, "card": 0.8, "phone": 0.6, "iban": 0.9, "key": 0.9, "secret": 0.5}
CONTEXT_SHARE, CONTEXT_CHARS = 0.2, 48
FOR_WORDS = {
    "email": {"email", "mail", "contact", "kontakt", "correo", "courriel", "write"},
    "ip": {"ip", "host", "server", "address", "adresse", "login", "client"},
    "card": {"card", "credit", "visa", "karte", "carte", "tarjeta", "payment", "pay"},
    "phone": {"phone", "tel", "call", "mobile", "telefon", "fax", "telephone"},
    "iban": {"iban", "account", "bank", "konto", "compte", "cuenta"},
    "key": {"key", "token", "access", "auth"},
    "secret": {"secret", "token", "key", "apikey", "password", "passwd", "pwd", "passwort", "auth", "bearer", "credential", "credentials"},
}
AGAINST_WORDS = {"version", "release", "example", "sample", "build", "isbn", "serial"}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A start inside a run of digits can only succeed where the run's own start does, so only run starts are tried.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
# A run of key characters as a whole; longer runs are encoded data and no keys.
_RUN = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,256}(?![A-Za-z0-9_+/-])")
# Shapes of access keys that their issuers publish.
_KEY_SHAPE = re.compile(r"AKIA[A-Z0-9]{16}|ASIA[A-Z0-9]{16}|AIza[A-Za-z0-9_-]{35}|gh[opsu]_[A-Za-z0-9]{36}|xox[abp]-[A-Za-z0-9-]{12,}")
LEAST_BITS = 3.0  # entropy a character of a secret, from its own characters
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        d = int(c)
        if place % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def mod97(code: str) -> bool:
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost addresses: from each @ back over the characters of a name, then on over the domain."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        free = domain.end() if domain else at + 1
        if domain:
            found.append((start, free))
        at = text.find("@", free)
    return found


def _ibans(text: str) -> list[tuple[int, int]]:
    found = []
    for m in _IBAN.finditer(text):
        wanted = IBAN_LENGTH.get(m.group()[:2])
        end, have = m.start(), 0
        for c in m.group():
            end += 1
            have += c != " "
            if have == wanted:
                break
        if (wanted is None or have == wanted) and mod97(text[m.start() : end].replace(" ", "")):
            found.append((m.start(), end))
    return found


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """Confirmed spans (kind, start, end) of one text, by kind as in ``KINDS``, then start."""
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text) is None:
        return found
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in m.group().split("."))):
                found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        # 19 digits with 18 separators are the longest card
        if m.end() - m.start() <= 37 and 13 <= len(d := only_digits(m.group())) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(only_digits(m.group())) <= 15:
                found.append(("phone", *m.span()))
    found += [("iban", a, b) for a, b in _ibans(text)]
    return found


def entropy(s: str) -> float:
    """Bits a character of ``s``."""
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def find_secrets(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of kind ``key`` (a published shape) and ``secret`` (letters and digits of high entropy) outside ``taken``."""
    keys, secrets = [], []
    if _DIGIT.search(text) is None:
        return []
    for m in _RUN.finditer(text):
        run = m.group()
        if any(a < m.end() and m.start() < b for _, a, b in taken):
            continue
        if _KEY_SHAPE.fullmatch(run):
            keys.append(("key", *m.span()))
        elif _DIGIT.search(run) and not run.isdecimal() and _WORD.search(run) and entropy(run) >= LEAST_BITS:
            secrets.append(("secret", *m.span()))
    return keys + secrets


def _words_beside(text: str, start: int, end: int) -> set[str]:
    """Lower-case words within ``CONTEXT_CHARS`` of a span; one that the limit cuts is none."""
    low, high = max(0, start - CONTEXT_CHARS), end + CONTEXT_CHARS
    found = set()
    for a, b in ((low, start), (end, high)):
        for m in _WORD.finditer(text[a:b]):
            cut = a == low and low and not m.start() and text[low - 1].isalpha()
            cut = cut or b == high and a + m.end() == high and text[high : high + 1].isalpha()
            if not cut:
                found.add(m.group().lower())
    return found


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's start score, raised or lowered by the words next to the span."""
    near = _words_beside(text, start, end)
    value = START_SCORE[kind]
    value += CONTEXT_SHARE * bool(near & FOR_WORDS[kind]) - CONTEXT_SHARE * bool(near & AGAINST_WORDS)
    return round(min(1.0, max(0.0, value)), 3)


def judged(text: str) -> list[tuple[str, int, int, float]]:
    """Spans (kind, start, end, score) that count: every confirmed base span, and those of added kinds from ``SHOWN_AT`` on."""
    found = find_spans(text)
    scored = [(*s, score(text, *s)) for s in found + find_secrets(text, found)]
    return [s for s in scored if s[0] in BASE_KINDS or s[3] >= SHOWN_AT]


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span replaced by its kind in brackets; of overlapping spans the first names the place."""
    parts, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            parts += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*parts, text[done:]])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``spans`` (kind, start, end, score) in code points, end exclusive.

    A null text counts as empty and an empty one has no spans. Null ids, repeated ids and repeated rows
    each keep their own row. Only the two named columns are read, so other columns cannot clash. An
    empty table gives an empty result. The whole text is searched, in linear time.
    """

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        spans = []
        for text in b.column(1).to_pylist():
            spans.append([{"kind": k, "start": s, "end": e, "score": v} for k, s, e, v in judged(text or "")])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], ["_id", "spans"])

    narrow = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    out = map_arrow(narrow, "_id long, spans array<struct<kind:string,start:int,end:int,score:double>>", batch, text=1)
    return out.withColumnRenamed("_id", id_col)


def redact(docs: DataFrame, text_col: str = "text", least: float = MASKED_AT) -> DataFrame:
    """``docs`` with each span of ``text_col`` whose score is at least ``least`` replaced by its kind; null texts stay null.

    Ids are not read; repeated rows are masked alike; an empty table stays empty; columns of any name pass as they are.
    """

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        at = b.schema.get_field_index(text_col)
        texts = [t if t is None else masked(t, [s[:3] for s in judged(t) if s[3] >= least]) for t in b.column(at).to_pylist()]
        return b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return map_arrow(docs, docs.schema, batch, text=docs.columns.index(text_col))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of their spans and all spans as text."""
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *[count(k) for k in BASE_KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )
