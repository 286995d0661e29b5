"""Surrogates for personal data (operator 4).

Every entity gets a replacement of its own type, format, script and, for names,
gender.  A replacement is a keyed permutation of all entities of one shape (a
Feistel network over the letters' and digits' own alphabets), so the same
entity has the same surrogate everywhere, and two entities never share one; no
table of them has to be kept or sent around.  A Spark job checks that nothing
collides before any text is replaced.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, read, small_batches, written

#: The key where none is given; a production run passes its own.
KEY = b"textloom public test key"

#: Given names by gender and script.
NAMES = {
    ("f", "latin"): "Alice Anna Carmen Charlotte Clara Elena Elise Emma Greta Hannah Helen Ines Julia Laura Lucia Marie Martha Nina Paula Rosa Sarah Sofia Susan".split(),
    ("m", "latin"): "Adam Albert Bruno Carlos Daniel David Emil Felix George Hans Henry Hugo James John Jorge Karl Louis Martin Oscar Paul Peter Robert Thomas".split(),
    ("f", "cyrillic"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга Софья Татьяна".split(),
    ("m", "cyrillic"): "Алексей Борис Виктор Иван Максим Никита Олег Павел Сергей Юрий".split(),
    ("f", "greek"): "Άννα Ελένη Ειρήνη Κατερίνα Μαρία Σοφία".split(),
    ("m", "greek"): "Γιώργος Δημήτρης Κώστας Νίκος Παύλος Πέτρος".split(),
}
#: Titles that a name follows, with the gender that they tell.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Sir": "m", "Lady": "f", "Dr": "", "Prof": "", "Mme": "f", "Mlle": "f", "Herr": "m", "Frau": "f", "Señor": "m", "Señora": "f", "Sra": "f", "Sr": "m"}
#: Alphabets whose letters stand for each other.
ALPHABETS = [
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ",
    "áéíóúàèìòùâêîôûäëïöü", "ÁÉÍÓÚÀÈÌÒÙÂÊÎÔÛÄËÏÖÜ", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ",
    "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
]
#: Country codes of one and two digits; all others have three.
COUNTRIES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
_OF = {c: a for a in ALPHABETS for c in a}
_HEX = {c: "0123456789abcdef" for c in "0123456789abcdef"}

_GIVEN = {n: k for k, names in NAMES.items() for n in names}
_WORD = r"[A-ZÀ-ÖØ-ÞА-ЯΑ-ΩΆΈΉΊΌ][a-zß-öø-ÿа-яα-ωάέήίόύώ]+"
#: A family name: with one letter and an apostrophe before it, or two names joined by a hyphen.
_FAMILY = rf"(?:[A-Z]['’])?{_WORD}(?:-{_WORD})?"
#: Keys of cloud accounts, and where IPv6 addresses may stand.
ACCESS = re.compile(r"(?<![A-Za-z0-9])A[KS]IA[0-9A-Z]{16}(?![A-Za-z0-9])")
HEXTET = re.compile(r"[0-9A-Fa-f]{1,4}::?[0-9A-Fa-f]{1,4}:|::[0-9A-Fa-f]")
IPV6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}:[0-9A-Fa-f:]{2,38}(?![\w:.])")
EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
#: A hexadecimal string of 32 digits or more in either case, found by a digit in it with eight more after it.
SECRET = re.compile(r"[0-9][0-9A-Fa-f]{8,}")
#: Where numbers may stand, and what they are.
DIGITS = re.compile(r"[0-9][0-9.() -]{6,}")
NUMBER = re.compile(
    r"(?<![A-Za-z0-9.])(?P<ip>(?:[0-9]{1,3}\.){3}[0-9]{1,3})(?!\.?[0-9A-Za-z])"
    r"|(?P<phone>\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9-])(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9-]))"
    r"|(?<![0-9-])(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])"
    r"|(?<![0-9A-Za-z])(?P<card>[0-9]{13,19}|[0-9]{4}(?P<sep>[ -])[0-9]{4}(?P=sep)[0-9]{4}(?P=sep)[0-9]{1,7})(?![0-9A-Za-z])"
)
#: Capitalised words, of which titles and given names are looked up; then what follows them.
CAPITAL = re.compile(rf"[{_WORD[1:].partition(']')[0]}]\w*")
AFTER_TITLE = re.compile(rf"\.? ({_FAMILY}(?: {_FAMILY})?)\b")
AFTER_GIVEN = re.compile(rf" {_FAMILY}\b")


def _stream(key: bytes, tweak: str, n: int) -> Iterator[int]:
    """Keyed numbers below 2**32."""
    for i in range(-(-n // 16)):
        block = hashlib.blake2b(f"{i}|{tweak}".encode(), key=key[:64]).digest()
        for j in range(0, 64, 4):
            yield int.from_bytes(block[j : j + 4], "big")


def _feistel(values: list[int], sizes: list[int], key: bytes, tweak: str, sign: int, rounds: int = 8) -> list[int]:
    """A keyed permutation of all lists with values[i] < sizes[i]; with sign -1 its inverse."""
    half = len(values) // 2
    parts = [values[:half], values[half:]]
    bases = [sizes[:half], sizes[half:]]
    for r in range(rounds)[::sign]:
        own, other = r % 2, 1 - r % 2
        seed = f"{r}|{tweak}|{sizes}|{parts[other]}"
        parts[own] = [(v + sign * s) % b for v, s, b in zip(parts[own], _stream(key, seed, len(parts[own])), bases[own], strict=False)]
    return parts[0] + parts[1]


def permute(values: list[int], sizes: list[int], key: bytes, tweak: str) -> list[int]:
    """One step on a keyed cycle through all lists with values[i] < sizes[i], so nothing stays itself where there is more than one."""
    at = _feistel(values, sizes, key, tweak, 1)
    for i in reversed(range(len(at))):
        at[i] = (at[i] + 1) % sizes[i]
        if at[i]:
            break
    return _feistel(at, sizes, key, tweak, -1)


@lru_cache(4096)
def alphabet(c: str) -> str:
    """The letters that may stand for `c`: those of a listed alphabet, or else all of its kind among its 128 neighbours in Unicode; '' for what stays."""
    if c in _OF or not c.isalpha():
        return _OF.get(c, "")
    kind = lambda x: (unicodedata.category(x), x.upper().lower() == x.lower() and len(x.upper()) == 1)
    block = ord(c) >> 7 << 7
    return "".join(x for x in map(chr, range(block, block + 128)) if x not in _OF and x.isalpha() and kind(x) == kind(c))


def letters(text: str, key: bytes, tweak: str, of: dict[str, str] | None = None) -> str:
    """Each letter or digit becomes one of its own alphabet; all else stays."""
    sets = [of.get(c, "") if of else alphabet(c) for c in text]
    at = [i for i, a in enumerate(sets) if a]
    alphabets = [sets[i] for i in at]
    shape = "".join("" if a else c for c, a in zip(text, sets, strict=True))
    new = permute([a.index(text[i]) for i, a in zip(at, alphabets, strict=True)], [len(a) for a in alphabets], key, f"{tweak}|{shape}|{[a[0] for a in alphabets]}")
    out = list(text)
    for i, v, a in zip(at, new, alphabets, strict=True):
        out[i] = a[v]
    return "".join(out)


def _luhn(digits: str) -> int:
    """The check digit of all digits but the last."""
    total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(digits[:-1])))
    return -total % 10


def _refill(shape: str, chars: str) -> str:
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def _iban_check(country: str, body: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def _script(word: str) -> str:
    c = word[0].lower()
    return "cyrillic" if "а" <= c <= "я" else "greek" if "ά" <= c <= "ώ" or "α" <= c <= "ω" else "latin"


def _given(name: str, key: bytes) -> str:
    """A listed name becomes a listed one of its gender and script, any other becomes an unlisted one of its letters' kind."""
    if name in _GIVEN:
        group = _GIVEN[name]
        names = NAMES[group]
        order = sorted(names, key=lambda n: hashlib.blake2b(f"{group}{n}".encode(), key=key[:64]).digest())
        return order[(order.index(name) + 1) % len(order)]  # a keyed cycle of the whole list
    new = letters(name, key, "given")
    while new in _GIVEN:  # stays a permutation of the unlisted
        new = letters(new, key, "given")
    return new


def surrogate(kind: str, text: str, key: bytes = KEY) -> tuple[str, str, str]:
    """(surrogate, what identifies the entity, what identifies the surrogate)."""
    if kind == "email":
        local, domain = text.lower().split("@")
        host, _, top = domain.rpartition(".")
        new_host = letters(host, key, "host" + top)
        new = f"{letters(local, key, 'local' + domain)}@{new_host}.{top}"
        shown = "".join(n.upper() if o.isupper() else n for o, n in zip(text, new, strict=True))
        return shown, text.lower(), new
    if kind == "ip":
        octets = [int(x) for x in text.split(".")]
        canon = ".".join(map(str, octets))
        new = ".".join(map(str, permute(octets, [256] * 4, key, "ip")))
        return new, canon, new
    if kind == "ipv6":
        parts = ipaddress.IPv6Address(text).packed
        new = permute(list(parts), [256] * 16, key, "ipv6")
        shown = str(ipaddress.IPv6Address(bytes(new)))
        return shown, str(ipaddress.IPv6Address(text)), shown
    if kind == "access":
        new = text[:4] + letters(text[4:], key, "access" + text[:4])
        return new, text, new
    if kind == "phone":
        digits = re.sub("[^0-9]", "", text)
        country = next(c for n in (1, 2, 3) if (c := digits[:n]) in COUNTRIES or n == 3) if text[0] == "+" else "1"
        national = digits[len(country) :] if text[0] == "+" else digits
        new = letters(national, key, "phone" + country)
        return _refill(text, (country if text[0] == "+" else "") + new), f"+{country}{national}", f"+{country}{new}"
    if kind == "card":
        digits = re.sub("[^0-9]", "", text)
        body = digits[0] + letters(digits[1:-1], key, f"card{digits[0]}")
        new = body + str((_luhn(body + "0") + int(digits[-1]) - _luhn(digits)) % 10)
        return _refill(text, new), digits, new
    if kind == "iban":
        plain = text.replace(" ", "")
        body = letters(plain[4:], key, "iban" + plain[:2])
        new = f"{plain[:2]}{_iban_check(plain[:2], body):02d}{body}"
        return _refill(text, new), plain, new
    if kind == "secret":
        new = letters(text.lower(), key, "secret", _HEX)
        shown = new.upper() if text.isupper() else "".join(n.upper() if o.isupper() else n for o, n in zip(text, new, strict=True))
        return shown, text.lower(), new
    if kind in ("name-f", "name-m", "name-"):
        first, _, rest = text.partition(" ")
        if not rest and first not in _GIVEN:  # a title with a family name
            new = letters(first, key, "family")
            return new, f"{_script(first)}|{first}", f"{_script(first)}|{new}"
        new = _given(first, key) + (" " + letters(rest, key, "family") if rest else "")
        return new, text, new
    new = letters(text, key, kind)
    return new, text, new


def _emails(text: str) -> Iterator[tuple[int, int, str]]:
    if "@" in text:
        yield from ((m.start(), m.end(), "email") for m in EMAIL.finditer(text))


def _ibans(text: str) -> Iterator[tuple[int, int, str]]:
    for m in IBAN.finditer(text):
        plain = m[0].replace(" ", "")
        alone = not m.start() or not text[m.start() - 1].isalnum()
        if alone and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 and f"{_iban_check(plain[:2], plain[4:]):02d}" == plain[2:4]:
            yield m.start(), m.end(), "iban"


def _secrets(text: str) -> Iterator[tuple[int, int, str]]:
    for m in SECRET.finditer(text):
        begin, end = m.span()
        while begin and text[begin - 1] in "0123456789abcdefABCDEF":
            begin -= 1
        around = text[max(0, begin - 1) : begin] + text[end : end + 1]
        if 32 <= end - begin and not any(c.isalnum() for c in around):
            yield begin, end, "secret"
    if "AKIA" in text or "ASIA" in text:
        yield from ((m.start(), m.end(), "access") for m in ACCESS.finditer(text))


def _addresses(text: str) -> Iterator[tuple[int, int, str]]:
    if HEXTET.search(text):
        for m in IPV6.finditer(text):
            try:
                ipaddress.IPv6Address(m[0])
            except ValueError:
                continue
            yield m.start(), m.end(), "ipv6"


def _numbers(text: str) -> Iterator[tuple[int, int, str]]:
    for region in DIGITS.finditer(text):
        for m in NUMBER.finditer(text, max(0, region.start() - 2), region.end() + 2):
            kind = m.lastgroup if m.lastgroup != "sep" else "card"
            if kind != "ip" or all(int(x) < 256 for x in m["ip"].split(".")):
                yield *m.span(kind), kind


def _names(text: str) -> Iterator[tuple[int, int, str]]:
    for m in CAPITAL.finditer(text):
        word = m[0]
        if word not in TITLES and word not in _GIVEN or m.start() and text[m.start() - 1].isalnum():
            continue
        if word in TITLES:
            if after := AFTER_TITLE.match(text, m.end()):
                first = after[1].split()[0]
                yield *after.span(1), "name-" + (TITLES[word] or (_GIVEN[first][0] if first in _GIVEN else ""))
        elif after := AFTER_GIVEN.match(text, m.end()):
            yield m.start(), after.end(), "name-" + _GIVEN[word][0]


def entities(text: str) -> list[tuple[int, int, str]]:
    """(begin, end, type), in order and without overlaps; of overlapping ones the first found stays: email, iban, secret, IPv6 address, number, name."""
    found = [*_emails(text), *_ibans(text), *_secrets(text), *_addresses(text), *_numbers(text), *_names(text)]
    if len(found) < 2:
        return found
    kept: list[tuple[int, int, str, int]] = []
    for begin, rank, end, kind in sorted((b, i, e, k) for i, (b, e, k) in enumerate(found)):
        if kept and begin < kept[-1][1]:
            if rank < kept[-1][3] and (len(kept) < 2 or begin >= kept[-2][1]):
                kept[-1] = (begin, end, kind, rank)
            continue
        kept.append((begin, end, kind, rank))
    return [k[:3] for k in kept]


class Replacer:
    """Remembers the surrogates of recent entities; one per worker and key."""

    def __init__(self, key: bytes, keep: int = 200_000) -> None:
        self.key, self.keep, self.held = key, keep, {}

    def get(self, kind: str, text: str) -> tuple[str, str, str]:
        if (kind, text) not in self.held:
            if len(self.held) >= self.keep:
                self.held.clear()
            self.held[kind, text] = surrogate(kind, text, self.key)
        return self.held[kind, text]

    def replace(self, text: str) -> tuple[str, list[tuple[str, str, str]]]:
        parts, at, told = [], 0, []
        for begin, end, kind in entities(text):
            new, was, now = self.get(kind, text[begin:end])
            parts += [text[at:begin], new]
            at = end
            told.append((kind[:4] if kind.startswith("name") else kind, was, now))
        return ("".join(parts) + text[at:], told) if told else (text, told)


_replacers: dict[bytes, Replacer] = {}


def _replacer(key: bytes) -> Replacer:
    if key not in _replacers:
        _replacers[key] = Replacer(key)
    return _replacers[key]


def pairs(docs: DataFrame, key: bytes = KEY, column: str = "text") -> DataFrame:
    """type, entity, surrogate: keyed hashes of every distinct pair in the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replacer = _replacer(key)
        mark = lambda x: int.from_bytes(hashlib.blake2b(x.encode(), key=key[:64], digest_size=8).digest(), "big", signed=True)
        for rows, _, _ in pieces(batches, column):
            told = {t for text in rows.column(column).to_pylist() if text for t in replacer.replace(text)[1]}
            told = sorted(told)
            yield pa.record_batch([pa.array([t for t, _, _ in told], pa.string()), pa.array([mark(t + a) for t, a, _ in told], pa.int64()), pa.array([mark(t + b) for t, _, b in told], pa.int64())], names=["type", "entity", "surrogate"])

    return docs.select(F.col(column).cast("string").alias(column)).mapInArrow(run, "type string, entity long, surrogate long").distinct()


def collisions(found: DataFrame) -> DataFrame:
    """Surrogates of more than one entity, and entities of more than one surrogate; none is right."""
    found = written(found, "pairs")  # both sides of one table
    both = [found.groupBy("type", F.col(a).alias("of")).agg(F.min(b).alias("least"), F.max(b).alias("most")).where("least <> most").withColumn("side", F.lit(a)) for a, b in (("surrogate", "entity"), ("entity", "surrogate"))]
    return both[0].union(both[1])


def pseudonymise(docs: DataFrame, key: bytes = KEY, column: str = "text", check: bool = True, told: str | None = None) -> DataFrame:
    """`docs` with surrogates in `column`; all other columns and rows stay as they are.

    told: the name of a further column for the entities, an array of (type,
    begin and end in the old text, surrogate).  Null texts stay null and empty ones empty.  With
    `check`, a job first makes sure that distinct entities keep distinct
    surrogates over all texts.
    """
    if check and (bad := collisions(pairs(docs, key, column)).limit(5).collect()):
        raise ValueError(f"surrogates collide: {bad}")
    small_batches(docs.sparkSession)
    kinds = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("begin", T.LongType()), T.StructField("end", T.LongType()), T.StructField("surrogate", T.StringType())]))
    schema = T.StructType([*(T.StructField(f.name, T.StringType(), f.nullable) if f.name == column else f for f in docs.schema if f.name != told), *([T.StructField(told, kinds)] if told else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replacer = _replacer(key)
        for rows, _, _ in pieces(batches, column):
            texts, lists = [], []
            for text in rows.column(column).to_pylist():
                if told:
                    lists.append([{"type": k[:4] if k.startswith("name") else k, "begin": b, "end": e, "surrogate": replacer.get(k, text[b:e])[0]} for b, e, k in entities(text)] if text else [])
                texts.append(replacer.replace(text)[0] if text else text)
            columns = [pa.array(texts, pa.string()) if n == column else c for n, c in zip(rows.schema.names, rows.columns, strict=True)]
            if told:
                columns.append(pa.array(lists, pa.list_(pa.struct([("type", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("surrogate", pa.string())]))))
            yield pa.record_batch(columns, names=schema.names)

    source = docs.drop(told) if told else docs
    return source.withColumn(column, F.col(column).cast("string")).mapInArrow(run, schema)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), told="entities")
    return out.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), F.array_join(F.array_sort(F.array_distinct("entities.type")), ",").alias("types"), "entities")
