"""Personal data by anchor expansion.

One Aho-Corasick pass over the whole text finds anchors: at-signs, plus-signs, scheme marks, digits and cue words.
From each anchor a deterministic local parser expands to the boundaries and validates what it found. Parsers never
back up behind an earlier match of their kind and use possessive loops, so a text costs time in proportion to its
length, whatever it holds.

Kinds, in output order: ``email ip card phone`` are the base, leftmost and without overlaps per kind;
``account`` (IBAN by its check digits, in one or in groups of four; what a word for an account announces), ``identity``
(three-two-four digit numbers; what a word for a document or an identity announces), ``login`` (credentials in a URL's
authority) and ``address`` (house number, capitalised words, street word) are added.

Defined cases: a null or empty text has no spans; spans of different kinds may overlap; a repeated row gets the
same answer each time; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "account", "identity", "login", "address")
BASE = KINDS[:4]

# The base expressions of the contract, each anchored where its anchor was found.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
IDENTITY = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
LOGIN = re.compile(r"[^\s/@:\"'<>]{1,64}:[^\s/@\"'<>]{1,128}@[A-Za-z0-9.-]{1,253}")
ADDRESS = re.compile(r"(?<![0-9A-Za-z.,-])[0-9]{1,5}[A-Za-z]?(?: [A-Z][a-z]{1,20}){1,3}$")
# Words that end a street line.
STREET_WORDS = ("Street", "Avenue", "Road", "Boulevard", "Lane", "Drive", "Court", "Way", "Place", "Square", "Terrace", "Close", "St.", "Ave.", "Rd.", "Blvd.")
# Words that announce an account or an identity, in lower case.
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "kontonummer", "compte", "cuenta", "routing")
IDENTITY_CUES = ("ssn", "social security", "passport", "tax id", "national id", "driver license", "driving licence", "reisepass", "ausweis", "passeport", "pasaporte", "dni", "nif")
#: From a cue on: a word for number, a mark, and what it announces.
CUED = re.compile(r"(?i:(?: (?:number|num|no|nr|id|code))?)[ .:#=-]{1,4}([A-Z]{0,3}[0-9](?:[ -]?[A-Z0-9]){4,29})(?![A-Za-z0-9])", re.ASCII)
#: An address begins at most this far before its street word: its own longest form.
ADDRESS_REACH = 5 + 1 + 3 * 22

AT, PLUS, SCHEME, DIGIT, STREET, ACCOUNT, IDENTIFIER = range(7)


def _cued(words: tuple[str, ...], kind: int) -> list[tuple[str, int]]:
    """Cue words as they are written: in lower case, with a capital, in capitals."""
    return [(form, kind) for w in words for form in dict.fromkeys((w, w.capitalize(), w.title(), w.upper()))]


@lru_cache(1)
def anchors():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for word, kind in [("@", AT), ("+", PLUS), ("://", SCHEME), *((d, DIGIT) for d in "0123456789"), *((" " + w, STREET) for w in STREET_WORDS), *_cued(ACCOUNT_CUES, ACCOUNT), *_cued(IDENTITY_CUES, IDENTIFIER)]:
        automaton.add_word(word, (kind, len(word)))
    automaton.make_automaton()
    return automaton


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def _iban_holds(text: str) -> bool:
    text = text.replace(" ", "")
    return len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _iban_end(text: str, start: int) -> int:
    """Where the longest valid account number ends that is the text or its first groups, 0 if none is."""
    while len(text) >= 15:
        if _iban_holds(text):
            return start + len(text)
        if " " not in text:
            return 0
        text = text[: text.rindex(" ")]
    return 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def find_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, in code points, end exclusive, each kind by start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)
    run_end = 0
    for last, (kind, width) in anchors().iter(text):
        at = last - width + 1
        if kind == DIGIT:
            if at >= done["card"]:
                m = CARD.match(text, at)
                done["card"] = m.end() if m else at + 1
                if m and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                    found["card"].append(m.span())
            if at < run_end:
                continue
            # the first digit of a run; the run itself is skipped from here on
            run_end = at + 1
            while run_end < len(text) and "0" <= text[run_end] <= "9":
                run_end += 1
            if at >= done["ip"] and (m := IP.match(text, at)):
                done["ip"] = m.end()
                if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                    found["ip"].append(m.span())
            if at >= done["identity"] and not (at and (text[at - 1].isalnum() or text[at - 1] == "-")) and (m := IDENTITY.match(text, at)):
                done["identity"] = m.end()
                found["identity"].append(m.span())
            if at - 2 >= done["account"] and not text[at - 3 : at - 2].isalnum() and (m := IBAN.match(text, at - 2)):
                end = _iban_end(m[0], at - 2)
                if end:
                    done["account"] = end
                    found["account"].append((at - 2, end))
        elif kind == AT:
            if at < done["email"]:
                continue
            start = at
            while start > done["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                done["email"] = m.end()
                found["email"].append((start, m.end()))
        elif kind == PLUS:
            if at >= done["phone"] and (m := PHONE.match(text, at)):
                done["phone"] = m.end()
                if 9 <= len(_digits(m[0])) <= 15:
                    found["phone"].append(m.span())
        elif kind == SCHEME:
            if at >= done["login"] and (m := LOGIN.match(text, last + 1)):
                done["login"] = m.end()
                found["login"].append(m.span())
        elif kind in (ACCOUNT, IDENTIFIER):
            name = "account" if kind == ACCOUNT else "identity"
            if at >= done[name] and not (at and text[at - 1].isalnum()) and (m := CUED.match(text, last + 1)):
                if sum(c.isdigit() for c in m[1]) >= 5:
                    done[name] = m.end()
                    found[name].append(m.span(1))
        elif not text[last + 1 : last + 2].isalnum():
            begin = max(done["address"], at - ADDRESS_REACH)
            if m := ADDRESS.search(text[max(0, begin - 1) : at]):
                start = max(0, begin - 1) + m.start()
                if start >= done["address"]:
                    done["address"] = last + 1
                    found["address"].append((start, last + 1))
    return found


def spans_text(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in found[k])


def mask(text: str, found: dict[str, list[tuple[int, int]]]) -> str:
    """The text with each covered stretch replaced by the tag of the first kind that covers its start."""
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k in KINDS for s, e in found[k]):
        if start >= at:
            out += text[at:start], f"<{kind.upper()}>"
        at = max(at, end)
    return "".join(out) + text[at:]


SCHEMA = pa.schema(
    [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string()), *((f"n_{k}", pa.int64()) for k in KINDS[4:])]
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [find_spans(t or "") for t in batch.column(1).to_pylist()]
        count = lambda k: pa.array([len(f[k]) for f in found], pa.int64())
        base = [hashlib.sha256(spans_text(f, BASE).encode()).hexdigest() for f in found]
        columns = [batch.column(0), *map(count, BASE), pa.array(base, pa.string()), pa.array([spans_text(f) for f in found], pa.string()), *map(count, KINDS[4:])]
        yield pa.RecordBatch.from_arrays(columns, schema=SCHEMA)


def find_pii(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: counts by kind, the digest of the base spans, all spans. Row by row, without an exchange."""
    kinds = ", ".join(f"n_{k} long" for k in BASE)
    more = ", ".join(f"n_{k} long" for k in KINDS[4:])
    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        _scan, f"doc_id long, {kinds}, base_sha256 string, spans string, {more}"
    )


def mask_pii(documents: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``documents``, with the spans in ``text`` replaced by tags; a null text stays null."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema, place = to_arrow_schema(documents.schema), documents.columns.index(text)

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else mask(t, find_spans(t)) for t in batch.column(place).to_pylist()]
            columns = [pa.array(texts, pa.string()) if i == place else c.cast(schema.field(i).type) for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    task: Callable = masked
    return documents.mapInArrow(task, documents.schema)
