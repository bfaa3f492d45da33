"""Personal data and secrets replaced by keyed surrogates of the same type and format.

A surrogate is a permutation of all values of the entity's own shape, under a key: letters
become letters of the same script and case, digits digits, given names others of their gender
and script. So one entity has one surrogate in every document (coreference), two entities
never share one (distinctness), none is its own, and no table of entities is needed. The
permutation is a Feistel network walked until it lands among the values of the shape, joined
with a step to the next value so that nothing stays in place. ``collisions`` counts over a
whole corpus that distinctness holds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from ipaddress import IPv6Address

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm.common import map_batches, saved, slices, table, text_of

#: For tests and examples; pass a secret of your own.
DEFAULT_KEY = b"surrogates"

# Alphabets whose letters may stand for each other.
ALPHABETS = (
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "àâáäãèéêëìíîïòóôöõùúûü", "çñß",
    "αεηιουω", "βγδζθκλμνξπρσςτφχψ", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь",
)
HEX = "0123456789abcdef"

# Given names by script and gender.
GIVEN_NAMES = (
    ("James", "Michael", "Robert", "William", "Peter", "Thomas", "Charles", "Stefan", "Jürgen", "Pierre",
     "Jacques", "Carlos", "Miguel", "Pablo", "Javier", "George"),
    ("Mary", "Patricia", "Jennifer", "Elizabeth", "Susan", "Margaret", "Sabine", "Ursula", "Brigitte",
     "Françoise", "Sylvie", "Lucía", "Carmen", "Isabel", "Pilar", "Dorothy"),
    ("Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Николай"),
    ("Мария", "Ольга", "Татьяна", "Наталья", "Светлана", "Елена"),
    ("Γιώργος", "Νίκος", "Κώστας", "Γιάννης"),
    ("Μαρία", "Ελένη", "Κατερίνα", "Σοφία"),
)
TITLES = "Mr|Mrs|Ms|Miss|Dr|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra"

_EMAIL = re.compile(r"[\w.+%-]*\w@[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)+")
_NUMBER = re.compile(
    r"(?<![\w.+])(?:"
    r"(?P<ip>(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d))"
    r"|(?P<card>\d{4}([ -])\d{4}\3\d{4}\3\d{1,7}(?!\w)|\d{13,19}(?!\w))"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?)?\d{2,4}(?P<sep>[ .-])\d{2,4}(?:(?P=sep)\d{2,4}){0,3}"
    r"(?![\w-]|\.\d)|\+\d{8,15}(?!\w))"
    r")"
)
# What a text must hold to be searched further.
_ANY_DIGIT = re.compile("[0-9]")
_SECRET = re.compile(
    r"(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key))\W{0,4}[=:]\W{0,4}(?P<value>[A-Za-z0-9_/+.-]{8,}\w)"
    r"|\b(?i:bearer) (?P<bearer>[A-Za-z0-9_/+.~-]{16,}=*)"
    r"|\b(?P<hex>[0-9a-f]{32,128}|[0-9A-F]{32,128})\b"
    r"|\b(?P<key>(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})\b"
)
_SECRET_IN_QUOTES = re.compile(
    r"(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key))\W{0,4}[=:]\s{0,2}[\"'](?P<quoted>[^\s\"']{8,})[\"']")
_IPV6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f:]{9,39}(?![\w:])")
_ANY_SECRET = re.compile(r"(?i:token|secret|passw|key|bearer)")
_IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")
_WORD = r"[^\W\d_a-zà-ÿа-яα-ω][^\W\d_]+"
_NAME = re.compile(
    rf"\b(?P<title>(?:{TITLES})\.? )(?P<titled>{_WORD}(?: {_WORD})?)"
    rf"|\b(?P<known>(?:{'|'.join(n for names in GIVEN_NAMES for n in names)}) {_WORD})"
)
_ANY_NAME = re.compile("|".join([*(f"{t}[. ]" for t in TITLES.split("|")), *(n for names in GIVEN_NAMES for n in names)]))


class Surrogates:
    """The permutations of one key."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.letter = {c: (a, i) for a in ALPHABETS for i, c in enumerate(a)}
        self.names = {n: names for names in GIVEN_NAMES for n in names}
        self.folded = {n.lower() for n in self.names}

    def _round(self, tweak: bytes, number: int, value: int, bits: int) -> int:
        data = bytes([number]) + tweak + b"\0" + value.to_bytes((bits + 15) // 8, "little")
        out = b"".join(
            hashlib.blake2b(data + bytes([i]), key=self.key, digest_size=64).digest()
            for i in range((bits + 511) // 512)
        )
        return int.from_bytes(out, "little") & ((1 << bits) - 1)

    def _network(self, tweak: bytes, value: int, size: int, back: bool) -> int:
        half = max(1, (size - 1).bit_length() + 1 >> 1)
        mask = (1 << half) - 1
        while True:
            a, b = value >> half, value & mask
            for number in (range(7, -1, -1) if back else range(8)):
                if back:
                    a, b = b ^ self._round(tweak, number, a, half), a
                else:
                    a, b = b, a ^ self._round(tweak, number, b, half)
            value = a << half | b
            if value < size:
                return value

    def moved(self, tweak: bytes, value: int, size: int) -> int:
        """Another number below ``size``, a different one for each value."""
        if size < 2:
            return value
        return self._network(tweak, (self._network(tweak, value, size, False) + 1) % size, size, True)

    def spelled(self, kind: str, text: str, alphabet: Callable[[str], str | None]) -> str:
        """``text`` with its letters and digits replaced within their alphabets, all else in place."""
        used = [alphabet(c) for c in text]
        size, value = 1, 0
        for c, a in zip(text, used, strict=True):
            if a:
                value, size = value * len(a) + a.index(c), size * len(a)
        shape = kind + "|" + "".join(a[0] if a else c for c, a in zip(text, used, strict=True))
        value, out = self.moved(shape.encode(), value, size), []
        for c, a in zip(reversed(text), reversed(used), strict=True):
            if a:
                value, i = divmod(value, len(a))
                c = a[i]
            out.append(c)
        return "".join(reversed(out))

    def own_alphabet(self, c: str) -> str | None:
        return self.letter[c][0] if c in self.letter else None

    # One method per kind: the text of an entity to the text that stands for it.

    def email(self, text: str) -> str:
        head, dot, top = text.lower().rpartition(".")
        return _cased(self.spelled("email", head, self.own_alphabet) + dot + top, text)

    def ip(self, text: str) -> str:
        octets = [int(x) for x in text.split(".")]
        value = self.moved(b"ip", int.from_bytes(bytes(octets), "big"), 1 << 32)
        return ".".join(str(b) for b in value.to_bytes(4, "big"))

    def card(self, text: str) -> str:
        digits = [c for c in text if c.isdigit()]
        body = list(self.spelled("card", "".join(digits[:-1]), self.own_alphabet))
        return _filled(text, [*body, str(-_luhn([*body, "0"]) % 10)])  # with a check digit of its own

    def phone(self, text: str) -> str:
        country = re.match(r"\+\d{1,3}(?=[ .-])|\+\d|", text)[0]
        digits = "".join(c for c in text[len(country):] if c.isdigit())
        return country + _filled(text[len(country):], self.spelled(f"phone{country}", digits, self.own_alphabet))

    def ssn(self, text: str) -> str:
        return self.spelled("ssn", text, self.own_alphabet)

    def iban(self, text: str) -> str:
        """A number with right check digits of its own."""
        rest = self.spelled(f"iban{text[:2]}", "".join(text[4:].split()).lower(), self.own_alphabet).upper()
        return text[:2] + _filled(text[2:], f"{98 - _mod_97(rest + text[:2] + '00'):02d}{rest}")

    def account(self, text: str) -> str:
        """Like an IBAN, but its check digits are wrong, and so may be those that stand for them."""
        rest = "".join(text[2:].split()).lower()
        return text[:2] + _filled(text[2:], self.spelled(f"account{text[:2]}", rest, self.own_alphabet).upper())

    def ipv6(self, text: str) -> str:
        low = self.spelled("ipv6", text.lower(), lambda c: HEX if c in HEX else None)
        return low.upper() if text == text.upper() else low

    def secret(self, text: str) -> str:
        low = text.lower()
        if re.fullmatch(f"[{HEX}]{{32,}}", low) and text in (low, text.upper()):
            out = self.spelled("hex", low, lambda c: HEX)
            return out if text == low else out.upper()
        return self.spelled("secret", text, _case_alphabet)

    def name(self, text: str) -> str:
        return " ".join(self._name_word(w) for w in text.split(" "))

    def _name_word(self, word: str) -> str:
        listed = word if word in self.names else word.capitalize()
        if listed in self.names:
            names = self.names[listed]
            new = names[self.moved(f"names{names[0]}".encode(), names.index(listed), len(names))]
            return new if word == listed else new.upper() if word.isupper() else new.lower()
        out = word.lower()
        while True:  # a made name that is one of the lists is walked past
            out = self.spelled("name", out, self.own_alphabet)
            if out not in self.folded:
                return _cased(out, word)


def _case_alphabet(c: str) -> str | None:
    for a in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
        if c in a:
            return a
    return None


def _cased(text: str, like: str) -> str:
    """``text`` with upper case where ``like`` has it."""
    return "".join(c.upper() if o.isupper() and len(c.upper()) == 1 else c for c, o in zip(text, like, strict=True))


def _filled(form: str, signs) -> str:
    """``form`` with its letters and digits replaced by ``signs``, in order."""
    rest = iter(signs)
    return "".join(next(rest) if c.isalnum() else c for c in form)


def _luhn(digits: list[str]) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10


def _is_ipv6(text: str) -> bool:
    """Whether it is an address of four groups or more (shorter ones are mostly names in programs)."""
    try:
        IPv6Address(text)
    except ValueError:
        return False
    return sum(map(bool, text.split(":"))) >= 4


def _mod_97(number: str) -> int:
    """The remainder that IBAN check digits are made of; letters count from 10."""
    return int("".join(str(int(c, 36)) for c in number)) % 97


def find_entities(text: str) -> list[tuple[int, int, str]]:
    """[(start, end, kind)] of the entities of a text, in order and apart from each other.

    A text is searched again for the single words of the names found in it, in any case, so that
    no part of a name stays beside what stands for the whole. Found are: e-mail addresses; IPv4 and IPv6
    addresses; card numbers with a right check digit; IBANs; numbers written like US social security or, with
    separators or a leading +, telephone numbers; secrets behind a word like token or password (if without a
    digit, only in quotes), bearer tokens, long hexadecimal strings and some services' keys; names
    behind a title, or a listed given name with a word after it. Other names, and bare phone numbers, are not.
    """
    found: list[tuple[int, int, str]] = []

    def add(start: int, end: int, kind: str) -> None:
        if all(end <= a or b <= start for a, b, _ in found):
            found.append((start, end, kind))

    if "@" in text:
        for m in _EMAIL.finditer(text):
            add(*m.span(), "email")
    if _ANY_DIGIT.search(text):
        _find_numbers(text, add)
    elif _ANY_SECRET.search(text):
        _find_secrets(text, add)
    if _ANY_NAME.search(text):
        for m in _NAME.finditer(text):
            add(*m.span("titled" if m["titled"] else "known"), "name")
        # Short words are too common in lower case to be taken for a name.
        words = {w for a, b, kind in found if kind == "name" for w in text[a:b].split(" ")}
        if words:
            again = re.compile(rf"\b(?:{'|'.join(sorted(map(re.escape, words)))})\b", re.IGNORECASE)
            for m in again.finditer(text):
                if len(m[0]) > 3 or m[0][0].isupper():
                    add(*m.span(), "name")
    return sorted(found)


def _find_secrets(text: str, add: Callable[[int, int, str], None]) -> None:
    at = 0
    while m := _SECRET.search(text, at):
        group, at = m.lastgroup, m.end()
        if group == "value" and not any(c.isdigit() for c in m["value"]):
            quoted = _SECRET_IN_QUOTES.match(text, m.start())
            if not quoted:
                continue
            group, m, at = "quoted", quoted, quoted.end()
        add(*m.span(group), "secret")


def _find_numbers(text: str, add: Callable[[int, int, str], None]) -> None:
    _find_secrets(text, add)
    for m in _IBAN.finditer(text):
        number = "".join(m[0].split())
        add(*m.span(), "iban" if _mod_97(number[4:] + number[:4]) == 1 else "account")
    if text.count(":") > 1:
        for m in _IPV6.finditer(text):
            if _is_ipv6(m[0]):
                add(*m.span(), "ipv6")
    for m in _NUMBER.finditer(text):
        kind = next(k for k in ("ip", "card", "ssn", "phone") if m[k] is not None)
        n_digits = sum(c.isdigit() for c in m[0])
        if kind == "ip" and any(int(x) > 255 or (x[0] == "0" and len(x) > 1) for x in m[0].split(".")):
            continue
        if kind == "card" and _luhn([c for c in m[0] if c.isdigit()]):
            continue  # without the check digit it is some other number
        if kind == "phone" and not (7 if m[0][0] in "+(" else 9) <= n_digits <= 15:
            continue
        add(*m.span(), kind)


def canonical(kind: str, entity: str) -> str:
    """What two spellings of one entity have in common."""
    if kind in ("card", "phone", "iban", "account"):
        return "".join(c for c in entity.lower() if c.isalnum() or c == "+")
    return entity.lower() if kind in ("email", "name", "ipv6") else entity


def replace_entities(text: str, surrogates: Surrogates) -> tuple[str, list[tuple[str, str, str]]]:
    """(the text with surrogates, [(kind, entity, surrogate)])."""
    parts, pairs, at = [], [], 0
    for start, end, kind in find_entities(text):
        new = getattr(surrogates, kind)(text[start:end])
        parts += [text[at:start], new]
        pairs.append((kind, text[start:end], new))
        at = end
    return "".join(parts) + text[at:], pairs


def entity_pairs(docs: DataFrame, key: bytes = DEFAULT_KEY) -> DataFrame:
    """(kind, entity, surrogate) of all entities, as digests of what their spellings share."""
    def work(cols: dict[str, list]) -> dict[str, list]:
        surrogates, seen = Surrogates(key), set()
        for text in cols["text"]:
            for kind, old, new in replace_entities(text, surrogates)[1]:
                seen.add((kind, *(hashlib.blake2b(canonical(kind, x).encode(), digest_size=16).hexdigest() for x in (old, new))))
        return {n: [s[i] for s in seen] for i, n in enumerate(("kind", "entity", "surrogate"))}

    found = map_batches(docs.select(text_of().alias("text")), work, "kind string, entity string, surrogate string")
    return found.distinct()


def collisions(pairs: DataFrame) -> DataFrame:
    """The surrogates that stand for two entities of a kind, and the entities with two surrogates."""
    def several(by: str, other: str) -> DataFrame:
        return pairs.groupBy("kind", by).agg(F.countDistinct(other).alias("n")).where("n > 1").select(
            "kind", F.col(by).alias("value"), F.lit(by).alias("side"), "n")

    return several("surrogate", "entity").unionByName(several("entity", "surrogate"))


def _checked(docs: DataFrame, key: bytes) -> None:
    found = saved(entity_pairs(docs, key), "pii-pairs")
    if not (bad := collisions(found)).isEmpty():
        raise ValueError(f"surrogates collide; a sample: {bad.limit(5).collect()}")


def replace_pii(docs: DataFrame, key: bytes = DEFAULT_KEY, check: bool = True) -> DataFrame:
    """(doc_id, text, n_entities, kinds) per row of ``docs`` (doc_id, text).

    ``kinds``: the kinds found, sorted and joined by commas. A text without entities comes
    back unchanged, a null text as the empty one. Rows may repeat, ids may be null; other
    columns are ignored; an empty table gives no row. With ``check`` the corpus is first searched
    for two entities that share a surrogate, and a ValueError raised if there are any.
    """
    if check:
        _checked(docs, key)

    def work(cols: dict[str, list]) -> dict[str, list]:
        surrogates = Surrogates(key)
        rows = [replace_entities(t, surrogates) for t in cols["text"]]
        return {
            "doc_id": cols["doc_id"], "text": [r[0] for r in rows], "n_entities": [len(r[1]) for r in rows],
            "kinds": [",".join(sorted({k for k, *_ in r[1]})) for r in rows],
        }

    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    return map_batches(rows, work, "doc_id long, text string, n_entities long, kinds string")


def replace_in_place(docs: DataFrame, key: bytes = DEFAULT_KEY, check: bool = True) -> DataFrame:
    """``docs``, all columns, with surrogates in ``text``; a null text stays null."""
    if check:
        _checked(docs, key)
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key)
        for batch in batches:
            for part in slices(batch):
                texts = [t and replace_entities(t, surrogates)[0] for t in part.column(at).to_pylist()]
                columns = part.columns
                columns[at] = pa.array(texts, part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(work, docs.schema)


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents"))
