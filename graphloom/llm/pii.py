"""Surrogates for personal data and secrets.

Detected entities are replaced by keyed values of the same type, script, case and
punctuation. The replacement is a keyed permutation of all values of an entity's
format: a Feistel network over its free characters, of whatever number, each round
adding a keyed stream of one half to the other; conjugated with a step by one, so
that nothing maps to itself. So equal entities (letter case and spacing aside) get
equal surrogates in every document, and different ones of a type and format never
share one. ``collisions`` checks that over a corpus; ``checked`` refuses a corpus
that fails it.

Persons are found by title or listed given name; within a document their full
names, family names and listed given names are then found alone, too. A word of a
name has one surrogate wherever it stands. Listed given names are permuted within
lists by gender and script; other words by letters, vowels and consonants apart,
walking on until they leave the lists, so that the two never meet.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
import secrets
import warnings
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import map_batches, materialize, slices

ROUNDS = 8

# Alphabets, titles and given names.
DIGITS, HEX, LOWER = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"
LETTERS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåæèéêëìíîïòóôõöøùúûü", "çñðþß", "αεηιουω", "βγδζθκλμνξπρστφχψ", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ"]
BLOCKS = [(0x100, 0x17F), (0x3AC, 0x3CE), (0x430, 0x45F), (0x561, 0x586), (0x5D0, 0x5EA), (0x621, 0x64A), (0x905, 0x939), (0xE01, 0xE2E), (0x10D0, 0x10F0), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3)]
TITLES = {"Mr": "m", "Mister": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Sra": "f", "Κύριος": "m", "Κυρία": "f", "Господин": "m", "Госпожа": "f", "Dr": "", "Prof": ""}
GIVEN = {
    ("latin", "m"): "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Steven Andrew Peter Paul George Kevin Hans Karl Klaus Jürgen Wolfgang Jean Pierre Jacques François Carlos Miguel Juan José Luis Javier".split(),
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Margaret Emily Laura Julia Emma Anna Greta Heidi Ursula Sabine Claire Sophie Camille Isabelle Carmen Lucia Maria María Elena Pilar Ana Sofía".split(),
    ("greek", "m"): "Γιώργος Νίκος Κώστας Πέτρος Δημήτρης Γιάννης".split(),
    ("greek", "f"): "Μαρία Ελένη Σοφία Άννα Κατερίνα Βασιλική".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Борис Алексей Дмитрий".split(),
    ("cyrillic", "f"): "Анна Мария Ольга Елена Наталья Татьяна".split(),
}
_given = {name.lower(): (kind, k) for kind, names in GIVEN.items() for k, name in enumerate(names)}
_spaces = [*LETTERS, *("".join(c for c in map(chr, range(a, b + 1)) if c.isalpha() and c == c.lower() and not any(c in x for x in LETTERS)) for a, b in BLOCKS)]
_alphabet_of = {c: a for a in _spaces for c in a}
_place = {c: k for a in _spaces for k, c in enumerate(a)}


def _turned(key: bytes, tweak: bytes, x: np.ndarray, radices: np.ndarray, sign: int) -> np.ndarray:
    """The rounds of the network, or with a sign of -1 the way back."""
    half, out = len(x) // 2, x.copy()
    parts = (slice(0, half), slice(half, None))
    for r in range(ROUNDS) if sign > 0 else reversed(range(ROUNDS)):
        to, by = parts[r % 2], parts[1 - r % 2]
        said = hashlib.shake_256(b"%d|%b|%d|%b|%d|%b" % (len(key), key, len(tweak), tweak, r, out[by].astype("<u4").tobytes()))
        stream = np.frombuffer(said.digest(8 * len(out[to])), "<u8") % radices[to].astype(np.uint64)
        out[to] = (out[to] + sign * stream.astype(np.int64)) % radices[to]
    return out


def spin(key: bytes, tweak: str, digits: list[int], radices: list[int]) -> list[int]:
    """A keyed permutation of the numbers of mixed radices; none but the only one maps to itself."""
    if not digits:
        return []
    sizes, label = np.array(radices, np.int64), tweak.encode("utf-8", "surrogatepass")
    x = _turned(key, label, np.array(digits, np.int64), sizes, 1)
    for k in range(len(x)):  # a step by one, with its carry
        x[k] = (x[k] + 1) % sizes[k]
        if x[k]:
            break
    return _turned(key, label, x, sizes, -1).tolist()


@lru_cache(100_000)
def permute(key: bytes, tweak: str, value: int, size: int) -> int:
    """A keyed permutation of range(size) without fixed points, for size over 1."""
    if size < 2:
        return value
    side = int(np.ceil(np.sqrt(size)))

    def forth(x: int, sign: int) -> int:
        while True:  # walked until it falls into the range
            a, b = _turned(key, f"{tweak}|{size}".encode(), np.array(divmod(x, side), np.int64), np.array([side, side], np.int64), sign).tolist()
            x = a * side + b
            if x < size:
                return x

    return forth((forth(value, 1) + 1) % size, -1)


def respell(key: bytes, tweak: str, text: str, alphabet: Callable[[str], str | None]) -> str:
    """``text`` with its free characters permuted; letter case and other characters stay."""
    low = [c.lower() if len(c.lower()) == 1 else c for c in text]
    sets = [alphabet(c) for c in low]
    free = [k for k, a in enumerate(sets) if a and len(a) > 1]
    form = "".join(c if not a else f"\x00{a[0]}{len(a)}" for c, a in zip(low, sets, strict=True))
    new = spin(key, f"{tweak}|{form}", [sets[k].index(low[k]) for k in free], [len(sets[k]) for k in free])
    out = list(text)
    for k, at in zip(free, new, strict=True):
        c = sets[k][at]
        out[k] = c.upper() if text[k] != low[k] and len(c.upper()) == 1 and c.upper().lower() == c else c
    return "".join(out)


def _digit(c: str) -> str | None:
    return DIGITS if c in DIGITS else None


def _hex(c: str) -> str | None:
    return HEX if c in HEX else None


def _spelled(c: str) -> str | None:
    return DIGITS if c in DIGITS else LOWER if c in LOWER else _alphabet_of.get(c)


def _refill(found: str, pattern: str, new: str) -> str:
    """``found`` with the characters that match replaced by those of ``new`` in turn."""
    left = iter(new)
    return re.sub(pattern, lambda _: next(left), found)


def _luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = sum(sum(divmod(int(d) * (2 - k % 2), 10)) for k, d in enumerate(reversed(digits)))
    return -total % 10


def _walk(step: Callable[[str], str], value: str, fits: Callable[[str], object]) -> str:
    """Steps until the value fits: a permutation of all values becomes one of those that fit."""
    value = step(value)
    while not fits(value):
        value = step(value)
    return value


_reserved = re.compile(r"(?:^|\.)example\.(?:com|org|net)$|\.(?:example|test|invalid)$")


def email(key: bytes, found: str) -> str:
    """The local part anew; the domain's first label too, unless the domain is reserved for examples."""
    local, _, domain = found.rpartition("@")
    if not _reserved.search(domain.lower()):
        head, _, tail = domain.partition(".")
        domain = _walk(lambda x: f"{respell(key, 'domain', x.partition('.')[0], _spelled)}.{tail}", domain, lambda x: not _reserved.search(x.lower()))
    return f"{respell(key, f'email@{domain.lower()}', local, _spelled)}@{domain}"


# Calling codes of one and of two digits; all others have three.
CODES = {"1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}


def phone(key: bytes, found: str) -> str:
    """Country code and a fictional exchange stay; the other digits are permuted, whatever stands between them.

    Where the code ends is read off the digits, so all spellings of a number have one surrogate.
    """
    digits = re.sub(r"\D", "", found)
    head = next((digits[:k] for k in (1, 2) if digits[:k] in CODES), digits[:3]) if found.startswith("+") else ""
    body, label = digits[len(head) :], f"+{head}" if head else ""
    if len(body) == 10 and body[3:6] == "555":
        new = respell(key, f"phone{label}555", body[:3] + body[6:], _digit)
        new = new[:3] + "555" + new[3:]
    else:
        new = _walk(lambda x: respell(key, f"phone{label}", x, _digit), body, lambda x: len(x) != 10 or x[3:6] != "555")
    return _refill(found, r"\d", head + new)


def _card(found: str) -> bool:
    digits = re.sub(r"\D", "", found)
    issued = re.match(r"4|5[0-8]|6|3[4-9]|2[2-7]", digits)
    return bool(issued) and len(set(digits)) > 1 and _luhn(digits[:-1]) == int(digits[-1])


def card(key: bytes, found: str) -> str:
    """The issuer's digits and spacing stay, and the check digit is right again."""
    digits = re.sub(r"\D", "", found)
    head = digits[: 1 if digits[0] in "46" else 2]
    new = head + respell(key, f"card{head}", digits[len(head) : -1], _digit)
    return _refill(found, r"\d", new + str(_luhn(new)))


def number(key: bytes, found: str) -> str:
    """Identity numbers: all digits."""
    return _refill(found, r"\d", respell(key, "number", re.sub(r"\D", "", found), _digit))


def _remainder(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _iban(found: str) -> bool:
    return _remainder(re.sub(r"\s", "", found)) == 1


def iban(key: bytes, found: str) -> str:
    """Country and spacing stay, and the check digits are right again."""
    plain = re.sub(r"\s", "", found)
    body = respell(key, f"iban{plain[:2]}", plain[4:].lower(), lambda c: DIGITS if c in DIGITS else LOWER if c in LOWER else None).upper()
    return _refill(found, r"\S", f"{plain[:2]}{98 - _remainder(plain[:2] + '00' + body):02}{body}")


def address(key: bytes, found: str) -> str:
    """An address of the internet, in the usual spelling."""
    whole = ipaddress.ip_address(found)
    data = list(whole.packed)
    return str(type(whole)(bytes(spin(key, f"ip{len(data)}", data, [256] * len(data)))))


def _address(found: str) -> bool:
    try:
        return bool(ipaddress.ip_address(found).packed.strip(b"\0")) and found.count(":") != 1
    except ValueError:
        return False


def secret(key: bytes, found: str) -> str:
    """Hexadecimal strings stay hexadecimal; others keep letters and digits apart. A known prefix stays."""
    head = re.match(r"(?:AKIA|ASIA|gh[pousr]_|sk-|xox[abpr]-)|", found)[0]
    body = found[len(head) :]
    if not head and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", body):
        new = respell(key, "hex", body.lower(), _hex)
        return new.upper() if body != body.lower() else new
    return head + _walk(lambda x: respell(key, f"secret{head}", x, _spelled), body, lambda x: head or not re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", x))


def _secret(found: str) -> bool:
    return len(set(found)) > 1


FIRST_DAY, DAYS = datetime.date(1900, 1, 1), 43_830  # to the end of 2019


def _date(found: str) -> tuple[str, datetime.date] | None:
    """Layout and date of numbers with separators, if there is one."""
    a, mark, b, _, c = re.fullmatch(r"(\d+)([./-])(\d+)([./-])(\d+)", found).groups()
    layout, (y, m, d) = ("ymd", (a, b, c)) if len(a) == 4 else ("mdy", (c, a, b)) if mark == "/" and int(b) > 12 else ("dmy", (c, b, a))
    try:
        day = datetime.date(int(y), int(m), int(d))
    except ValueError:
        return None
    return (layout, day) if 0 <= (day - FIRST_DAY).days < DAYS else None


def date(key: bytes, found: str) -> str:
    """A day of birth: another day in the same layout."""
    layout, day = _date(found)
    new = FIRST_DAY + datetime.timedelta(permute(key, "date", (day - FIRST_DAY).days, DAYS))
    parts = {"y": f"{new.year:04}", "m": f"{new.month:02}", "d": f"{new.day:02}"}
    marks = iter([*re.findall(r"[./-]", found), ""])
    return "".join(parts[x] + next(marks) for x in layout)


def name_word(key: bytes, word: str) -> str:
    """Surrogate of a word of a name, the same wherever it stands."""
    listed = _given.get(word.lower())
    if listed:
        kind, at = listed
        names = GIVEN[kind]
        new = names[permute(key, "given" + "".join(kind), at, len(names))]
        return new.upper() if word.isupper() else new
    return _walk(lambda x: respell(key, "name", x, _alphabet_of.get), word, lambda x: x.lower() not in _given)


def person(key: bytes, found: str) -> str:
    """``Title Given Family`` or parts of it: a title stays."""
    head = re.match(rf"(?:(?:{'|'.join(TITLES)})\.?\s+)?", found)[0]
    return head + re.sub(r"[^\W\d_]+", lambda m: name_word(key, m[0]), found[len(head) :])


def _house(key: bytes, digits: str) -> str:
    """A number of as many digits and leading zeros."""
    own = digits.lstrip("0")
    if not own:
        return digits
    least = 10 ** (len(own) - 1)
    return digits[: len(digits) - len(own)] + str(least + permute(key, "house", int(own) - least, 9 * least))


def street(key: bytes, found: str) -> str:
    """House number and name of a street; the word for street stays."""

    def change(m: re.Match) -> str:
        tail = _street_kind.search(m[0])
        own = m[0][: tail.start()] if tail else m[0]
        return (_house(key, own) if own.isdigit() else respell(key, "street", own, _alphabet_of.get)) + m[0][len(own) :]

    return re.sub(r"[^\W\d_]+|[0-9]+", change, found)


_octet = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_street_kind = re.compile(r"(?:Street|Avenue|Road|Lane|Boulevard|Drive|straße|strasse|gasse|weg|platz)$")
_word = r"[^\W\d_]+"
#: type, what a text must hold for the pattern to be tried, pattern, test and replacement of group 1.
DETECTORS: list[tuple[str, str | None, re.Pattern, Callable[[str], object] | None, Callable[[bytes, str], str]]] = [
    ("email", "@", re.compile(r"(?<![\w.+-])(\w[\w.+-]*@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,})(?!\w)"), None, email),
    ("secret", None, re.compile(r"(?<![0-9A-Za-z])((?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{20,}|sk-[0-9A-Za-z]{20,}|xox[abpr]-[0-9A-Za-z-]{10,})(?![0-9A-Za-z])"), None, secret),
    ("secret", None, re.compile(r"(?i:\b(?:token|password|passwd|secret|api[_-]?key)\b[\w%&$*#!]*\s*[=:][%&$*#!]*\s*[\"']?)([0-9A-Za-z_+/-]{8,})"), _secret, secret),
    # sums and revisions that are named as such are no secrets
    ("secret", None, re.compile(r"(?<![0-9A-Za-z])(?<!commit )(?<!revision )(?<!md5 )(?<!md5:)(?<!sha1 )(?<!sha1:)(?<!sha256 )(?<!sha256:)(?<!checksum )(?<!digest )([0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])"), _secret, secret),
    ("iban", None, re.compile(r"(?<![0-9A-Za-z])([A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?)(?![0-9A-Za-z])"), _iban, iban),
    ("phone", None, re.compile(r"(?<![\w.])(\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]?\d{3,4}|\(\d{3}\) \d{3}-\d{4}|\d{3}-\d{3}-\d{4})(?!\w|[.-]\d)"), None, phone),
    ("card", None, re.compile(r"(?<![\w.+-])(\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?!\w|[.-]\d)"), _card, card),
    ("number", "-", re.compile(r"(?<![\w.+-])(\d{3}-\d{2}-\d{4})(?!\w|[.-]\d)"), None, number),
    ("ip", ".", re.compile(rf"(?<![\w.])({_octet}(?:\.{_octet}){{3}})(?!\w|\.\d)"), _address, address),
    ("ip", ":", re.compile(r"(?<![\w:.])((?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{6,39})(?![\w:]|\.\d)"), _address, address),
    ("date", None, re.compile(r"(?i:\b(?:born(?: on)?|birth(?:day| date)?|date of birth|dob|geboren(?: am)?|née? le|nacid[oa] el)\b[: ]\s*)(\d{1,4}[./-]\d{1,2}[./-]\d{2,4})(?!\w)"), _date, date),
    ("street", None, re.compile(rf"(?<!\w)([0-9]{{1,5}} [^\W\d_a-z]{_word}(?: [^\W\d_a-z]{_word})? (?:Street|Avenue|Road|Lane|Boulevard|Drive)|[^\W\d_a-zà-ÿ]{_word}(?:straße|strasse|gasse|weg|platz) [0-9]{{1,4}})(?!\w)"), None, street),
]
_titles = "|".join(sorted(TITLES, key=len, reverse=True))
_name = rf"(?!(?:{_titles})(?!\w))[^\W\d_a-zà-ÿα-ωа-я][^\W\d_]+"
_titled = re.compile(rf"(?<!\w)((?:{_titles})\.?[ \t]+{_name}(?:[ -]{_name}){{0,2}})")
_listed = re.compile(rf"(?<!\w)((?:{'|'.join(n for names in GIVEN.values() for n in names)})(?:[ -]{_name}){{1,2}})(?!\w)")
_telling = re.compile(r"[0-9@=:]|sk-|xox")
_capital = re.compile(r"[A-ZÀ-ÞΆ-ΫЀ-Я]\w+")
_telling_words = frozenset(TITLES) | {n for names in GIVEN.values() for n in names}


def _persons(text: str) -> list[tuple[int, int, str, Callable[[bytes, str], str]]]:
    """Titled and listed names, and their words alone wherever else they stand."""
    if _telling_words.isdisjoint(_capital.findall(text)):
        return []
    found = [m.span(1) for p in (_titled, _listed) for m in p.finditer(text)]
    if not found:
        return []
    alone: set[str] = set()
    for start, end in found:
        words = re.sub(rf"^(?:{_titles})\.?\s+", "", text[start:end]).split()
        alone |= {words[-1], *(w for w in words[:-1] if w.lower() in _given)}
    alone |= {w.upper() for w in alone}
    bare = re.compile(rf"(?<!\w)({'|'.join(sorted(map(re.escape, alone), key=len, reverse=True))})(?!\w)")
    found += [m.span(1) for m in bare.finditer(text)]
    return [(a, b, "person", person) for a, b in found]


def entities(text: str) -> list[tuple[int, int, str, Callable[[bytes, str], str]]]:
    """(start, end, type, replacement) of a text, in order, without overlaps."""
    found: list[tuple[int, int, str, Callable[[bytes, str], str]]] = []
    if _telling.search(text):
        for kind, needed, pattern, test, change in DETECTORS:
            if needed is None or needed in text:
                found += [(*m.span(1), kind, change) for m in pattern.finditer(text) if test is None or test(m[1])]
    found += _persons(text)
    if len(found) < 2:
        return found
    taken: list[tuple[int, int, str, Callable]] = []
    for x in sorted(found, key=lambda x: x[0]):  # a stable sort: detectors in their order
        if not taken or x[0] >= taken[-1][1]:
            taken.append(x)
    return taken


Drawn = dict[str, int]


def said(key: bytes, kind: str, value: str) -> str:
    """What stands for an entity or a surrogate in tables: a keyed hash of its one spelling."""
    return hashlib.blake2b(f"{kind}|{canonical(kind, value)}".encode("utf-8", "replace"), key=key[:64], digest_size=16).hexdigest()


def surrogate(key: bytes, kind: str, change: Callable[[bytes, str], str], found: str, drawn: Drawn | None = None) -> str:
    """The surrogate of an entity; ``drawn`` says how often some were drawn again."""
    times = drawn.get(said(key, kind, found), 0) if drawn else 0
    return change(key + b"|%d" % times if times else key, found)


def replace(text: str, key: bytes, drawn: Drawn | None = None) -> tuple[str, int]:
    """The text with surrogates, and how many there are."""
    parts, at, n = [], 0, 0
    for start, end, kind, change in entities(text):
        parts += [text[at:start], surrogate(key, kind, change, text[start:end], drawn)]
        at, n = end, n + 1
    return "".join([*parts, text[at:]]), n


def surrogates(docs: DataFrame, key: bytes, text_col: str = "text", count_col: str | None = None, drawn: Drawn | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with surrogates in the text column.

    Null and empty texts stay as they are, texts without entities too. Whole
    texts are read, entities may be of any length. Repeated rows get equal
    results; an empty table stays empty; other columns may have any names. With
    ``count_col`` a column of that name tells the number of replacements. The
    key must be secret: who knows it can undo the surrogates.
    """
    if not key:
        raise ValueError("surrogates need a key")
    inner = [f"c{k}" for k in range(len(docs.columns))]  # so that no name of the caller's meets another
    at = docs.columns.index(text_col)

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            done = [(None, 0) if t is None else replace(t, key, drawn) for t in batch.column(at).to_pylist()]
            columns = [*batch.columns[:at], pa.array([x[0] for x in done], pa.string()), *batch.columns[at + 1 :]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x[1] for x in done], pa.int64())], [*inner, "n"])

    plain = docs.toDF(*inner)
    schema = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(inner, docs.schema.fields, strict=True))
    done = map_batches(plain, change, f"{schema}, n long")
    return done.toDF(*docs.columns, count_col) if count_col else done.drop("n").toDF(*docs.columns)


def found_entities(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """(start, end, type, entity, surrogate), one row per entity, and the doc_id."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "end", "type", "entity", "surrogate"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for batch in slices(batches):
            rows = [(d, a, b, kind, t[a:b], change(key, t[a:b])) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for a, b, kind, change in entities(t)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], names)

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col(text_col).alias("text")), read, "doc_id long, start long, end long, type string, entity string, surrogate string")


def canonical(kind: str, value: str) -> str:
    """One spelling of an entity, whatever its letter case (but for secrets) and what stands between its digits."""
    if kind == "secret":  # of which letter case is a part
        return value
    value = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    if kind in ("phone", "card", "iban", "number"):
        return re.sub(r"[^0-9a-z+]", "", value)
    if kind == "ip":
        return str(ipaddress.ip_address(value))
    if kind == "date":
        return " ".join(map(str, _date(value) or [value]))
    return " ".join(value.split())


def _told(docs: DataFrame, key: bytes, text_col: str, drawn: Drawn | None = None) -> DataFrame:
    """(type, entity, surrogate) of a corpus, as hashes, each once."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = {(kind, said(key, kind, t[a:b]), said(key, kind, surrogate(key, kind, change, t[a:b], drawn))) for t in batch.column(0).to_pylist() if t for a, b, kind, change in entities(t)}
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows, strict=True) if rows else [[]] * 3)], ["type", "entity", "surrogate"])

    return map_batches(docs.select(F.col(text_col).alias("text")), read, "type string, entity string, surrogate string").distinct()


def collisions(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """Surrogates of several entities and entities of several surrogates: (type, value, n). Empty if all is well.

    Of an entity only its hash and that of its surrogate go on, each pair once a
    partition.
    """
    return several(_told(docs, key, text_col))


def several(told: DataFrame) -> DataFrame:
    """(type, value, n) of distinct (type, entity, surrogate): where one stands for several others."""
    shared = told.groupBy("type", F.col("surrogate").alias("value")).agg(F.count("*").alias("n"))
    split = told.groupBy("type", F.col("entity").alias("value")).agg(F.count("*").alias("n"))
    return shared.union(split).where("n > 1")


#: Entities that may be drawn again, which all tasks are told, and how often. Permutations do not collide; beyond this a detector's rule is broken.
MOST_DRAWN, DRAWS = 100_000, 8


def drawn_again(docs: DataFrame, key: bytes, text_col: str = "text") -> Drawn:
    """How often which entities (as hashes) are drawn again, until no two of a type share a surrogate.

    Of those that share one, the least hash keeps it. Spellings of an entity that still
    differ in their surrogates stay so, with a warning: they are distinct from all others.
    """
    drawn: Drawn = {}
    for _ in range(DRAWS):
        told = materialize(_told(docs, key, text_col, drawn), "entities")  # hashes only; else texts are read for each question
        bad = several(told)
        shared = told.join(bad.select("type", F.col("value").alias("surrogate")), ["type", "surrogate"], "left_semi")
        first = Window.partitionBy("type", "surrogate").orderBy("entity")
        again = shared.withColumn("place", F.row_number().over(first)).where("place > 1").select("entity").distinct()
        losers = [r["entity"] for r in again.limit(MOST_DRAWN + 1).collect()]
        if len(losers) + len(drawn) > MOST_DRAWN:
            break
        if not losers:
            split = told.groupBy("type", "entity").agg(F.count("*").alias("n")).where("n > 1").count()
            if split:
                warnings.warn(f"{split} entities have a surrogate for each of their spellings", stacklevel=2)
            return drawn
        drawn |= {e: drawn.get(e, 0) + 1 for e in losers}
    raise ValueError(f"surrogates of more than {MOST_DRAWN} entities, or after {DRAWS} draws, are not distinct")


def checked(docs: DataFrame, key: bytes, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``surrogates``, after a check that entities stay distinct in all of ``docs``; those that meet are drawn again."""
    return surrogates(docs, key, text_col, count_col, drawn_again(docs, key, text_col))


KEY_SETTING = "spark.graphloom.surrogates.key"
_own_keys: dict[str, bytes] = {}


def session_key(spark: SparkSession) -> bytes:
    """The secret key that the session names; else one drawn for this application, which nobody can use again."""
    named = spark.conf.get(KEY_SETTING, "")
    if named:
        return named.encode()
    warnings.warn(f"{KEY_SETTING} is not set: surrogates are the same within this application only", stacklevel=2)
    return _own_keys.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def op8(docs: DataFrame) -> DataFrame:
    """doc_id, text with surrogates, n_replaced."""
    return checked(docs.select("doc_id", "text"), session_key(docs.sparkSession), count_col="n_replaced")
