r"""Operator 10, personal data: patterns propose spans, validators confirm them, context words adjust the score.

Base kinds, leftmost and without overlaps within a kind: email; ip, parts at most 255; card, 16 to 19 digits that pass
Luhn; phone, 8 to 15 digits. Base spans always stay. Further kinds: iban, confirmed by mod 97, and ssn, which needs a
context word nearby. An IBAN has its country's length; of other countries the longest that mod 97 confirms at a word's end
counts. A span's score starts from its kind's prior, is raised by a validator and by context words within CONTEXT
characters before or after it, and lowered by words before it such as "order" or "version"; these are whole words. Further
kinds need MIN_SCORE.

Null and empty texts have none; repeated rows give repeated rows. Whole texts are read; runs of digits and of address
characters are read once, however long, so no text takes time in the square of its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm.common import arrow_map, batch, table

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
CHAIN = re.compile(r"[0-9]+(?:[.\x20-][0-9]+)*")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
#: Characters of an IBAN by country.
IBAN_LENGTH = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BR=29, BY=28, CH=21, CR=22, CY=28, CZ=24, DE=22, DK=18, DO=28, EE=20, EG=29, ES=24, FI=18, FO=18, FR=27, GB=22, GE=22, GI=23, GL=18, GR=27, GT=28, HR=21, HU=28, IE=22, IL=23, IQ=23,
    IS=26, IT=27, JO=30, KW=30, KZ=20, LB=28, LC=32, LI=21, LT=20, LU=20, LV=21, LY=25, MC=27, MD=24, ME=22, MK=19, MR=27, MT=31, MU=30, NL=18, NO=15, PK=24, PL=28, PS=29, PT=25, QA=29, RO=24, RS=22, SA=24, SC=31, SE=24, SI=19, SK=24, SM=27, ST=25,
    SV=28, TL=23, TN=24, TR=26, UA=29, VA=22, VG=24, XK=20,
)
#: Words near a span that speak for its kind, or before it against any personal data.
FOR = {
    "email": "mail mails email emails contact write address", "ip": "ip host server login address", "card": "card cards visa mastercard credit payment cvv",
    "phone": "phone phones telephone tel call mobile cell fax", "iban": "iban account bank konto", "ssn": "ssn social security",
}
AGAINST = "order orders version invoice isbn serial sample"
FOR, AGAINST = {k: frozenset(v.split()) for k, v in FOR.items()}, frozenset(AGAINST.split())
NEAR_WORD = re.compile(r"[^\W\d_]+")
PRIOR = {"email": 0.7, "ip": 0.5, "card": 0.5, "phone": 0.6, "iban": 0.5, "ssn": 0.5}
CONTEXT, MIN_SCORE = 40, 0.7


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    code = code.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def ibans(text: str) -> list[tuple[int, int]]:
    """Leftmost first; what follows an account number after a space is no part of it, and is read again."""
    out, m = [], IBAN.search(text)
    while m:
        ends = [e for e in range(m.end(), m.start() + 14, -1) if e == m.end() or text[e] == " "]
        length = IBAN_LENGTH.get(m[0][:2])
        if length:
            ends = [e for e in ends if e - m.start() - text.count(" ", m.start(), e) == length]
        end = next((e for e in ends if mod97(text[m.start() : e])), None)
        if end:
            out.append((m.start(), end))
        m = IBAN.search(text, end or m.start() + 2)
    return out


def emails(text: str) -> list[tuple[int, int]]:
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)  # what stands before this sign can't begin a later match
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    ips, cards, phones = [], [], []
    for chain in CHAIN.finditer(text):
        if chain.end() - chain.start() < 7:
            continue
        for m in IP.finditer(text, *chain.span()):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 and not p[:-3].strip("0") for p in m[0].split(".")):
                ips.append(m.span())
        for m in CARD.finditer(text, *chain.span()):
            digits = re.sub(r"[\x20-]", "", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                cards.append(m.span())
    if "+" in text:
        phones = [m.span() for m in PHONE.finditer(text) if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return [(k, s, e) for k, spans in zip(KINDS, (emails(text), ips, cards, phones), strict=False) for s, e in spans]


def score(text: str, kind: str, start: int, end: int) -> float:
    before, after = (NEAR_WORD.findall(x.lower()) for x in (text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]))
    value = PRIOR[kind] + 0.1 * (kind in ("card", "iban", "ip"))  # a validator has confirmed these
    value += 0.2 * (not FOR[kind].isdisjoint(before + after)) - 0.2 * (not AGAINST.isdisjoint(before))
    return min(1.0, max(0.0, round(value, 3)))


def further_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("iban", *span) for span in ibans(text)]
    if text.count("-") > 1:
        out += [("ssn", *m.span()) for m in SSN.finditer(text)]
    return [x for x in out if score(text, *x) >= (MIN_SCORE if x[0] == "ssn" else PRIOR["iban"])]


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of kind:start:end by kind, then start), scores (of spans) of every document row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, every, scores = [], [], []
            for text in b.column(1).to_pylist():
                text = text or ""
                own = base_spans(text)
                more = own + further_spans(text)
                base.append([f"{k}:{s}:{e}" for k, s, e in own])
                every.append([f"{k}:{s}:{e}" for k, s, e in more])
                scores.append([score(text, *x) for x in more])
            strings = pa.list_(pa.string())
            yield batch({"doc_id": (b.column(0), pa.int64()), "base": (base, strings), "spans": (every, strings), "scores": (scores, pa.list_(pa.float64()))})

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, base array<string>, spans array<string>, scores array<double>")


def of_kind(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x.startswith(f"{kind}:"))).cast("long")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    n = {f"n_{k}": of_kind("base", k) for k in KINDS[:4]}
    return found.select("doc_id", *(c.alias(k) for k, c in n.items()), F.sha2(F.array_join("base", ","), 256).alias("base_sha256"), F.array_join("spans", ",").alias("spans"), F.array_join(F.transform("scores", lambda x: x.cast("string")), ",").alias("scores"))
