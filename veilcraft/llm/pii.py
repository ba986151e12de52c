"""Personal data by anchor expansion.

An Aho-Corasick automaton runs once over each text and reports anchors: at-signs, plus signs, digits, URL schemes and
words that announce an identifier. At each anchor a deterministic parser expands to the bounds of one kind of value and
validates it. Every parser moves only forward over what it has read, so the work is linear in the text, however long a
run of digits or letters is.

Kinds, in the order in which spans are listed: ``email ip card phone`` (the base, equal to a leftmost scan per kind with
the patterns in the comments; a match that fails its check is dropped and not retried), then ``account`` (digits after a word
such as *account* or *SSN*, up to the last whole group of digits), ``iban`` (as long as its country's are, checked modulo 97),
``secret`` (a long value assigned to a word such as *token*) and
``url`` (from a scheme to the next blank or bracket). Words that announce a value are found in any case of ASCII letters, behind an underscore, and with word parts joined
by underscores behind them. Offsets are code points, the end is exclusive.

Defined results: null or empty text has no spans; null stays null when texts are redacted; rows are independent, so repeated
rows get equal results; other columns pass through and may have any name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilcraft.llm.common import slices

KINDS = ("email", "ip", "card", "phone", "account", "iban", "secret", "url")
BASE_KINDS = KINDS[:4]

Span = tuple[int, int]

# Words and schemes that announce a value: fixed values.
SCHEMES = ("http://", "https://", "ftp://", "www.")
ACCOUNT_CUES = ("account", "acct", "ssn", "social security", "passport", "konto", "kontonummer", "compte", "cuenta", "routing")
IBAN_CUES = ("iban",)
SECRET_CUES = ("token", "api_key", "apikey", "api-key", "secret", "password", "passwd", "access_key")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")
_PART = _WORD - {"_"}
#: How long the IBANs of a country are.
IBAN_LENGTHS = {
    country: int(length)
    for length, countries in (line.split(":") for line in (
        "15:NO", "16:BE", "18:DK FI FK FO GL NL SD", "19:MK SI", "20:AT BA EE KZ LT LU MN XK", "21:CH HR LI LV", "22:BG BH CR DE GB GE IE ME RS VA",
        "23:AE GI IL IQ OM SO TL", "24:AD CZ ES MD PK RO SA SE SK TN VG", "25:LY PT ST", "26:IS TR", "27:BI DJ FR GR IT MC MR SM",
        "28:AL AZ BY CY DO GT HN HU LB NI PL SV", "29:BR EG PS QA UA", "30:JO KW MU YE", "31:MT SC", "32:LC", "33:RU",
    ))
    for country in countries.split()
}
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])*+")
_PHONE_REST = re.compile(r"[ ().0-9-]++")
_PARTS = r"(?:_[A-Za-z0-9]{1,32}){0,4}+"
_ACCOUNT = re.compile(_PARTS + r"(?: ?(?:number|no|nr|id)\b\.?)?[ :#=]{1,3}([0-9]{1,34}+(?![0-9A-Za-z])(?:[ -][0-9]{1,34}+(?![0-9A-Za-z])){0,33}+)", re.IGNORECASE)
_IBAN = re.compile(_PARTS + r"[ :#=]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+)")
_SECRET = re.compile(_PARTS + r"[\"']? ?[:=] ?[\"']?([A-Za-z0-9+/_.=-]{16,}+)")
_URL = re.compile(r"[^\s<>\"'()\[\]{}]++")


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def is_octet(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part[-4:]) <= 255


def is_iban(value: str) -> bool:
    moved = value[4:] + value[:4]
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def lower(text: str) -> str:
    """The text with A to Z in lower case and nothing else changed, so that every character keeps its place."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def account_end(value: str) -> int:
    """Where the last whole group of digits ends with which an account number has at most 34 digits; 0 if it has under six."""
    end = digits = 0
    for group in re.finditer("[0-9]+", value):
        if digits + len(group.group()) > 34:
            break
        digits, end = digits + len(group.group()), group.end()
    return end if digits >= 6 else 0


def iban_end(value: str) -> int:
    """Where the IBAN that ``value`` starts with ends, 0 if none does: of its country's length, or of a country unknown the longest."""
    places = [place for place, sign in enumerate(value) if sign != " "]
    known = IBAN_LENGTHS.get(value[:2])
    for length in [known] if known else range(len(places), 14, -1):
        if length <= len(places):
            end = places[length - 1] + 1
            if is_iban(value[:end].replace(" ", "")):
                return end
    return 0


class Finder:
    """The spans of one text; ``at`` remembers up to where each kind has read."""

    def __init__(self) -> None:
        self.anchors = ahocorasick.Automaton()
        for sign in "0123456789":
            self.anchors.add_word(sign, (1, self.digit))
        self.anchors.add_word("@", (1, self.at_sign))
        self.anchors.add_word("+", (1, self.plus))
        for cues, parser in ((SCHEMES, self.scheme), (ACCOUNT_CUES, self.account), (IBAN_CUES, self.iban), (SECRET_CUES, self.secret)):
            for cue in cues:
                self.anchors.add_word(cue, (len(cue), parser))
        self.anchors.make_automaton()

    def find(self, text: str) -> dict[str, list[Span]]:
        self.text, self.spans, self.read = text, {kind: [] for kind in KINDS}, dict.fromkeys(KINDS, 0)
        for last, (length, parser) in self.anchors.iter(lower(text)):
            parser(last + 1 - length, last + 1)
        return self.spans

    def keep(self, kind: str, start: int, end: int, valid: bool = True) -> None:
        self.read[kind] = end
        if valid:
            self.spans[kind].append((start, end))

    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    def at_sign(self, at: int, after: int) -> None:
        start, text = at, self.text
        while start > self.read["email"] and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, after)):
            self.keep("email", start, domain.end())

    def digit(self, at: int, _: int) -> None:
        # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
        if at >= self.read["ip"]:
            dotted = _DOTTED.match(self.text, at)
            if dotted.end() - at >= 7:
                parts, start = dotted.group().split("."), at
                for n in range(0, len(parts) - 3, 4):
                    four = parts[n : n + 4]
                    end = start + sum(map(len, four)) + 3
                    self.keep("ip", start, end, all(map(is_octet, four)))
                    start = end + 1
            self.read["ip"] = dotted.end()
        # [0-9]([\x20-]?[0-9])+
        if at >= self.read["card"]:
            run = _CARD.match(self.text, at)
            self.read["card"] = run.end()
            if run.end() - at >= 13:
                digits = run.group().replace(" ", "").replace("-", "")
                self.keep("card", at, run.end(), 13 <= len(digits) <= 19 and luhn(digits))

    # \+[0-9][\x20().0-9-]+[0-9]
    def plus(self, at: int, after: int) -> None:
        text = self.text
        if at >= self.read["phone"] and text[after : after + 1] in tuple("0123456789") and (rest := _PHONE_REST.match(text, after + 1)):
            run = rest.group().rstrip(" ().-")
            if len(run) >= 2:
                self.keep("phone", at, after + 1 + len(run), 9 <= 1 + sum(map(str.isdigit, run)) <= 15)

    def scheme(self, at: int, after: int) -> None:
        if at >= self.read["url"] and (at == 0 or self.text[at - 1] not in _WORD) and (rest := _URL.match(self.text, after)):
            end = after + len(rest.group().rstrip(".,;:!?"))
            if end > after:
                self.keep("url", at, end)

    def announced(self, kind: str, pattern: re.Pattern, at: int, after: int, end_of) -> None:
        """A value of ``kind`` behind a cue that starts a word or a word part; ``end_of`` tells how much of it is one, or 0."""
        if at >= self.read[kind] and (at == 0 or self.text[at - 1] not in _PART) and (found := pattern.match(self.text, after)):
            if length := end_of(found.group(1)):
                self.keep(kind, found.start(1), found.start(1) + length)

    def account(self, at: int, after: int) -> None:
        self.announced("account", _ACCOUNT, at, after, account_end)

    def iban(self, at: int, after: int) -> None:
        self.announced("iban", _IBAN, at, after, iban_end)

    def secret(self, at: int, after: int) -> None:
        self.announced("secret", _SECRET, at, after, lambda value: len(value) * any(map(str.isdigit, value)))


@lru_cache(1)
def finder() -> Finder:
    """One automaton per Python worker."""
    return Finder()


def listed(spans: dict[str, list[Span]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind in kinds for start, end in spans[kind])


def find_pii(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, a count per base kind, base_sha256 of the base spans, and all spans, as ``kind:start:end`` joined by commas."""
    wanted = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    id_type = wanted.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [finder().find(text or "") for text in part.column("text").to_pylist()]
                counts = [pa.array([len(spans[kind]) for spans in found], pa.int64()) for kind in BASE_KINDS]
                digests = [hashlib.sha256(listed(spans, BASE_KINDS).encode()).hexdigest() for spans in found]
                every = [listed(spans, KINDS) for spans in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *counts, pa.array(digests, pa.string()), pa.array(every, pa.string())],
                    ["doc_id", *(f"n_{kind}" for kind in BASE_KINDS), "base_sha256", "spans"],
                )

    counts = ", ".join(f"n_{kind} long" for kind in BASE_KINDS)
    return wanted.mapInArrow(run, f"doc_id {id_type}, {counts}, base_sha256 string, spans string")


def redacted(text: str) -> str:
    """The text with every span replaced by its kind in brackets; of spans that overlap, the first one names them all."""
    spans = sorted((start, -end, kind) for kind, found in finder().find(text).items() for start, end in found)
    if not spans:
        return text
    parts, done = [], 0
    for start, negative_end, kind in spans:
        if start >= done:
            parts += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, -negative_end)
    return "".join([*parts, text[done:]])


def redact_documents(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The documents with personal data in their texts replaced; rows and all other columns stay as they are."""
    place = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field(place).type
            for part in slices(batch, text_column):
                texts = [None if text is None else redacted(text) for text in part.column(place).to_pylist()]
                columns = [pa.array(texts, kind) if i == place else column for i, column in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
