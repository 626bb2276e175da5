r"""Personal data with offsets: plain patterns, and disguised identifiers found in a normalised text.

Three transducers rewrite a text and remember where each character came from: the first maps look-alike characters
and drops invisible ones, the second reads letters in the place of digits, the third spelled digits and at/dot
disguises. The plain patterns run again over
the result, and what they find is mapped back to spans of the source.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession

from lakeloom.llm.common import over_texts, table

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match never starts inside a run of digits, as one at the run's start would have failed alike; saying so keeps long
#: runs linear.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ո": "n", "ս": "u", "օ": "o", "ʏ": "y", "ı": "i",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "χ": "x", "ε": "e",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "․": ".", "。": ".", "‧": ".", "‐": "-", "‑": "-", "‒": "-",
    "–": "-", "−": "-", "—": "-", " ": " ", " ": " ", " ": " ", " ": " ",
}
INVISIBLE = frozenset("­͏᠎​‌‍‎‏⁠⁡⁢⁣︎️﻿")
#: Digits by name in the four languages of the corpus.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
    "seven": "7", "eight": "8", "nine": "9",
    "zéro": "0", "un": "1", "une": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7",
    "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7",
    "ocho": "8", "nueve": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7",
    "acht": "8", "neun": "9",
}
#: Words of ordinary prose: one of them after a plain number is no part of it.
COMMON = {"un", "une", "oh", "null", "dos", "six", "uno"}
#: Words of numbers in Latin-1: digits and what may stand between them.
NUMBER = frozenset(w.encode("latin-1") for w in [*SPELLED, "double", "triple", "dash", "hyphen", "minus", "dot", "punto", "point", "punkt"])
FLAT = bytes(
    c + 32 if 65 <= c <= 90 or 192 <= c <= 222 and c != 215 else c if chr(c).isalnum() and (c < 128 or c >= 192) else 32 for c in range(256)
)  # of Latin-1: letters lower-cased, digits, all else a blank
#: Last labels that make "name at host dot label", with no brackets, an address.
TOP = "com|org|net|edu|gov|mil|int|info|biz|io|co|ai|dev|app|me|eu|uk|us|ca|de|fr|es|it|nl|ch|at|be|pt|mx|ar|br|cl|pe|ru|jp|cn|in|au|example|test|invalid|localhost"
_digit = "|".join(sorted(SPELLED, key=len, reverse=True))
_open, _close = r"[\[({<«]\s{0,3}", r"\s{0,3}[\])}>»]"
_dot_word = r"(?:dot|punto|point|punkt)"
_thousands = r"[0-9]{1,3}(?:[\x20.,][0-9]{3})+(?![0-9])(?![\x20.-]{1,2}[0-9])"  # a number in groups of three is an amount
_near = r"\s{0,3}"  # bounded, so that a long run of blanks isn't read from each of its places
_dot_mark = rf"{_near}{_open}(?:{_dot_word}|\.){_close}{_near}|{_near}&(?:period|\#0{{0,4}}46|\#x0{{0,4}}2e);{_near}"
RULES = re.compile(
    rf"(?P<at>{_near}{_open}(?:at|@|arroba|chez){_close}{_near}|{_near}&(?:commat|\#0{{0,4}}64|\#x0{{0,4}}40);{_near}|{_near}%40{_near}|(?<=\w)_at_(?=\w)|(?<=\w)\s+@\s*(?=\w)|(?<=\w)@\s+(?=\w)"
    rf"|(?<=\w)\s+(?:at|arroba)\s+(?=[\w-]+(?:(?:\s+{_dot_word}\s+|{_dot_mark}|\.)[\w-]+)*?(?:\s+{_dot_word}\s+|{_dot_mark})(?:{TOP})\b))"
    rf"|(?P<named>(?<=\w)\s+(?:at|arroba)\s+(?=[\w-]+(?:\.[\w-]+)*?\.(?:{TOP})\b))"
    rf"|(?P<dot>{_dot_mark}|(?<=\w)_dot_(?=\w)|(?<=\w)\s+{_dot_word}\s+(?=\w)|(?<=\w)\s+\.\s*(?=(?:{TOP})\b))"
    rf"|(?P<plus>\bplus\s+(?=(?:(?:{_digit})\b|(?!{_thousands})[0-9])))"
    rf"|(?P<digit>\b(?:(?P<times>double|triple)\s+)?(?P<name>{_digit})\b)",
    re.IGNORECASE,
)
#: Before a plain 'at' and a host with real dots: a name that prose wouldn't have, with a digit or a mark inside.
NAMED = re.compile(r"(?=[0-9._%+-]*[A-Za-z])[A-Za-z0-9][A-Za-z0-9._%+-]*[0-9._%+][A-Za-z0-9._%+-]*(?<=[A-Za-z0-9])\Z")
GAP = re.compile(r"[\s\-]+|,\s*|[\s,]+(?:dash|hyphen|minus)[\s,]+", re.IGNORECASE)
AT_DOT = re.compile(
    r"[\[({<«]\s{0,3}(?:at|@|arroba|chez|dot|punto|point|punkt|\.)\s{0,3}[\])}>»]|&(?:commat|period|\#0{0,4}(?:64|46)|\#x0{0,4}(?:40|2e));|%40|_at_|_dot_|\s@|@\s",
    re.IGNORECASE,
)
AT_HOST = re.compile(r"\s(?:at|arroba)\s+[\w-]+(?:\.[\w-]|\s+point\s)", re.IGNORECASE)
BLANK_DOT = re.compile(rf"\s\.\s*(?:{TOP})\b", re.IGNORECASE)
TRAILING = re.compile(rf"[\s-]+(?:{'|'.join(sorted(COMMON))})", re.IGNORECASE)
#: Digits with letters that look like digits between or after them, but no letters of a word.
DIGIT_LOOK = re.compile(r"(?<!\w)[0-9OoIl](?:[\x20().-]{0,2}[0-9OoIl])+(?!\w)")
#: What a match of AT_DOT holds: one of these words, or else one of these bytes.
DOTS = frozenset((b"dot", b"punto", b"punkt"))
ATS = frozenset((b"at", b"arroba"))
SIGNS = (b"[", b"(", b"{", b"<", b"\xab", b"&", b"%40", b"_", b"@")
HAS_DIGIT = re.compile(rb"[0-9]")
Span = tuple[str, int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain(text: str) -> list[Span]:
    """The base spans, by kind as in KINDS, then by start."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        begin = at  # the local part: as much of its class as stands before the sign
        while begin > end and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", begin, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            if len(m[0]) >= 16 and 16 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(DIGIT.findall(m[0])) <= 15]
    return out


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


class Rewritten:
    """A text made from a source: pieces copied from it, or put in the place of a stretch of it."""

    def __init__(self, source: str) -> None:
        self.source, self.parts, self.at = source, [], 0
        self.begins: list[int] = []  # where each piece begins in the text made
        self.spans: list[tuple[int, int, bool]] = []  # the stretch of the source, and whether it was copied
        self.size = 0

    def _add(self, text: str, start: int, end: int, copied: bool) -> None:
        if text:
            self.begins.append(self.size)
            self.spans.append((start, end, copied))
            self.parts.append(text)
            self.size += len(text)

    def put(self, start: int, end: int, text: str) -> None:
        self._add(self.source[self.at : start], self.at, start, True)
        self._add(text, start, end, False)
        self.at = end

    def done(self) -> str:
        self._add(self.source[self.at :], self.at, len(self.source), True)
        self.at = len(self.source)
        return "".join(self.parts)

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The source's span for a span, not empty, of the text made."""
        i, j = bisect_right(self.begins, start) - 1, bisect_right(self.begins, end - 1) - 1
        a, b = self.spans[i], self.spans[j]
        return (
            a[0] + (start - self.begins[i] if a[2] else 0),
            b[0] + (end - self.begins[j]) if b[2] else b[1],
        )


def lookalike_runs(text: str) -> list[re.Match]:
    """Runs mostly of digits, four or more, that hold letters in the place of some."""
    found = [m for m in DIGIT_LOOK.finditer(text)] if DIGIT.search(text) else []
    return [m for m in found if (n := len(DIGIT.findall(m[0]))) >= 4 and 0 < sum(map(m[0].count, "OoIl")) <= n]


def characters(text: str) -> Rewritten:
    """First transducer: look-alikes to ASCII, any decimal digit to 0-9, invisible characters dropped."""
    made = Rewritten(text)
    for i in ([] if text.isascii() else [m.start() for m in re.finditer(r"[^\x00-\x7f]", text)]):
        c = text[i]
        if c in INVISIBLE:
            made.put(i, i + 1, "")
        elif c in LOOKALIKES:
            made.put(i, i + 1, LOOKALIKES[c])
        elif ord(c) >= 0x2460 or c.isdecimal():  # accents of Latin letters stay; wide, circled and styled forms go
            flat = unicodedata.normalize("NFKC", c)
            if flat.isdecimal():
                flat = "".join(str(unicodedata.digit(x)) for x in flat)
            if flat != c and flat.isascii():
                made.put(i, i + 1, flat)
    made.text = made.done()
    return made


def letters(text: str) -> Rewritten:
    """Second transducer, over the first one's text: letters in the place of digits, in runs mostly of digits."""
    made = Rewritten(text)
    for m in lookalike_runs(text):
        for k, c in enumerate(m[0], m.start()):
            if c in "OoIl":
                made.put(k, k + 1, "0" if c in "Oo" else "1")
    made.text = made.done()
    return made


def words(text: str) -> Rewritten:
    """Third transducer: at and dot disguises to their signs, runs of spelled digits to digits without gaps."""
    made = Rewritten(text)
    last = -1  # where the digit or sign before ended
    for m in RULES.finditer(text):
        kind = m.lastgroup
        if kind == "digit":
            between = text[last : m.start()] if last >= 0 else ""
            digits = SPELLED[m["name"].lower()] * {"d": 2, "t": 3}.get((m["times"] or " ")[0].lower(), 1)
            joined = last >= 0 and (not between or GAP.fullmatch(between))
            made.put(last if joined else m.start(), m.end(), digits)
            last = m.end()
        elif kind != "named" or NAMED.search(text, max(0, m.start() - 64), m.start()):
            made.put(m.start(), m.end(), {"at": "@", "named": "@", "dot": ".", "plus": "+"}[kind])
            last = m.end()
    made.text = made.done()
    return made


def suspicious(text: str, raw: bytes) -> bool:
    """Whether a rule of the transducers that matters could apply; a cheap look at the whole text.

    It must not be narrower than the rules: a number in disguise has a word of NUMBER beside a digit or another such
    word, or 'plus' and digits; an address has a sign or word for its at, and one for a dot beside a plain sign.
    """
    if not text.isascii():
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return True
        if "\xad" in text or "\xa0" in text:
            return True
    plain_words = raw.translate(FLAT).split()
    digits = DIGIT.search(text)
    if (digits and b"plus" in plain_words) or not DOTS.isdisjoint(plain_words):
        return True
    flags = bytes(map(NUMBER.__contains__, plain_words))
    if b"\1\1" in flags:
        return True
    at = flags.find(1) if digits else -1
    while at >= 0:
        if HAS_DIGIT.search(b" ".join(plain_words[max(0, at - 1) : at + 2])):
            return True
        at = flags.find(1, at + 1)
    if b"@" in raw and (b"point" in plain_words or BLANK_DOT.search(text)):
        return True
    if any(x in raw for x in SIGNS) and AT_DOT.search(text):
        return True
    if not ATS.isdisjoint(plain_words) and AT_HOST.search(text):
        return True
    return bool(digits and lookalike_runs(text))


def disguised(text: str, base: list[Span]) -> list[Span]:
    """Spans of the source that only the normalised text shows."""
    first = characters(text)
    middle = letters(first.text)
    second = words(middle.text)
    out, known = [], set(base)
    for kind, start, end in plain(second.text):
        a, b = first.back(*middle.back(*second.back(start, end)))
        span = (kind, a, b)
        if text[a:b] == second.text[start:end] or span in known:
            continue
        if any(k == kind and x <= a and (b <= y or TRAILING.fullmatch(text, y, b)) for k, x, y in base):
            continue
        out.append(span)
    return out


def find(text: str | None, raw: bytes | None = None) -> tuple[list[Span], list[Span]]:
    """(base spans, added spans); null: none."""
    if not text:
        return [], []
    base = plain(text)
    raw = text.encode("utf-8", "surrogatepass") if raw is None else raw
    return base, disguised(text, base) if suspicious(text, raw) else []


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def _digest(ids: list, texts: list) -> list:
    out: list[list] = [ids, [], [], [], [], [], [], []]
    for raw in texts:
        base, added = find(raw.decode() if raw is not None else None, raw)
        for i, kind in enumerate(KINDS):
            out[1 + i].append(sum(k == kind for k, _, _ in base))
        out[5].append(hashlib.sha256(_joined(base).encode()).hexdigest())
        out[6].append(_joined(base + added))
        out[7].append(len(added))
    return out


def spans(docs: DataFrame) -> DataFrame:
    """Per row of docs its doc_id, base counts by kind, base digest, all spans as kind:start:end, and n_added.

    Offsets count code points of the whole text, ends are exclusive. A null or empty text has no spans; a text of any
    length is read whole, in time that grows with it; repeated rows repeat; an empty table gives an empty result; other
    columns are not read, whatever their names.
    """
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return over_texts(docs, ["doc_id", "text!"], schema, _digest)


def masked(text: str | None) -> str | None:
    """The text with each span replaced by its kind in angle brackets; spans that overlap become one."""
    if not text:
        return text
    base, added = find(text)
    out, at, open_span = [], 0, None
    for kind, a, b in sorted(base + added, key=lambda s: (s[1], -s[2])):
        if open_span and a < open_span[2]:
            open_span = (open_span[0], open_span[1], max(b, open_span[2]))
            continue
        if open_span:
            out += [text[at : open_span[1]], f"<{open_span[0]}>"]
            at = open_span[2]
        open_span = (kind, a, b)
    if open_span:
        out += [text[at : open_span[1]], f"<{open_span[0]}>"]
        at = open_span[2]
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data masked in text, and n_chars, if there, set to the new length.

    Null texts stay null. Other columns come out as they are, whatever their names; repeated rows repeat; an empty
    table stays empty. Texts are whole in a worker, one batch at a time.
    """
    import pyarrow as pa

    from lakeloom.llm.common import tune

    tune(docs.sparkSession)
    names = docs.columns
    plain_names = docs.toDF(*[f"c{i}" for i in range(len(names))])  # dots in names would be read as paths

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            i = names.index("text")
            old = batch.column(i)
            new = [masked(t) for t in old.to_pylist()]
            columns = list(batch.columns)
            columns[i] = pa.array(new, type=old.type)
            if "n_chars" in names:
                j = names.index("n_chars")
                changed = [n if a == b else len(b) for n, a, b in zip(columns[j].to_pylist(), old.to_pylist(), new, strict=True)]
                columns[j] = pa.array(changed, type=columns[j].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return plain_names.mapInArrow(run, plain_names.schema).toDF(*names)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(table(spark, sf_dir, "documents"))
