"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust the score.

Spans of the base kinds stay whatever their score; those of the added kinds count only with a score of at least ADDED_LEAST,
so a social security number, which has no checksum, needs a context word for it, and an IBAN may have words against it.

Spans are [start, end) in code points. The patterns are scanned so that the time grows with the text's length only: a search
starts where a run of the pattern's characters starts, never inside it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, small_batches, texts_of

#: Kinds in the order in which spans are listed; the first four are the base.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
#: Characters before and after a span in which context words count.
CONTEXT_CHARS = 48

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGITS = re.compile(r"[0-9]+")

#: Score of a confirmed span without any context word.
_PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4}
#: Score that a span of an added kind needs.
ADDED_LEAST = 0.5
#: Words that raise a span's score, and words that lower it. Fixed values.
_FOR = {
    "email": ("mail", "e-mail", "contact", "write", "address", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "login", "client"),
    "card": ("card", "credit", "visa", "mastercard", "amex", "payment", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"),
    "iban": ("iban", "bank", "account", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
}
_AGAINST = ("example", "version", "isbn", "order", "invoice", "serial", "build", "release", "test")
_CONTEXT = {k: re.compile(r"\b(?:" + "|".join(map(re.escape, words)) + r")\b", re.IGNORECASE) for k, words in (*_FOR.items(), ("", _AGAINST))}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 13616: country and check digits go to the end, letters count from 10; the remainder by 97 is 1."""
    code = iban.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, (end := m.end())


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = "".join(_DIGITS.findall(m[0]))
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """The longest confirmed prefix of a proposed run, at the boundaries of its groups: words in capitals may follow it."""
    for m in _IBAN.finditer(text):
        run = m[0]
        for stop in [len(run), *(x.start() for x in reversed(list(re.finditer(" ", run))))]:
            if mod97(run[:stop]):
                yield m.start(), m.start() + stop
                break


def _ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


_FINDERS: dict[str, tuple[Callable[[str], Iterator[tuple[int, int]]], str]] = {
    "email": (_emails, "@"),
    "ip": (_ips, "."),
    "card": (_cards, ""),
    "phone": (_phones, "+"),
    "iban": (_ibans, ""),
    "ssn": (_ssns, "-"),
}


def score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - CONTEXT_CHARS) : start] + " \n " + text[end : end + CONTEXT_CHARS]
    s = _PRIOR[kind]
    if _CONTEXT[kind].search(near):
        s += (1 - s) / 2
    if _CONTEXT[""].search(near):
        s *= 0.75
    return round(s, 6)


def find(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of all spans of a whole text that count, by kind as listed, then start."""
    if not _DIGITS.search(text) and "@" not in text:
        return []
    found = [(kind, a, b, score(text, kind, a, b)) for kind, (finder, sign) in _FINDERS.items() if sign in text for a, b in finder(text)]
    return [x for x in found if x[0] in BASE_KINDS or x[3] >= ADDED_LEAST]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, found) for every row: found is an array of structs (kind, start, end, score).

    A null text is the empty text, which has no spans. Rows are independent of each other: repeated rows give repeated
    results, an empty table an empty one; other columns are left out.
    """
    small_batches(docs.sparkSession)

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [[dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in find(t)] for t in texts_of(batch.column(1))]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(_SPAN))], names=["doc_id", "found"])

        return one

    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_batches(kept, make, f"doc_id {kept.schema[0].dataType.simpleString()}, found array<struct<kind: string, start: bigint, end: bigint, score: double>>")


def mask(docs: DataFrame, text: str = "text", least: float = 0.0) -> DataFrame:
    """docs with the spans of score >= least replaced by [KIND]; overlapping spans become one, named by the first.

    `least` is a further bar, for base kinds too. Null stays null. Each row is masked by itself, however long its text; repeated
    rows repeat, an empty table stays empty, and all other columns are kept as they are.
    """
    small_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [None if t is None else masked(t, least) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(out, pa.string())
            return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        return one

    return map_batches(docs, make, docs.schema)


def masked(text: str, least: float = 0.0) -> str:
    found = sorted((a, -b, kind) for kind, a, b, s in find(text) if s >= least)
    if not found:
        return text
    out, end = [], 0
    for a, b, kind in found:
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, -b)
    return "".join(out) + text[end:]


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_sha256 and spans of every document."""

    def listed(found):
        return F.concat_ws(",", F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))

    def count(kind):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("found", lambda x: x["kind"].isin(*BASE_KINDS))
    return spans(docs).select(
        "doc_id",
        *map(count, BASE_KINDS),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
        F.array_max(F.transform("found", lambda x: x["score"])).alias("max_score"),
    )
