"""Surrogates for personal data: emails, phone, card, social security and IP numbers, and names.

Each entity found gets a keyed replacement of its kind and format. Everything goes through keyed permutations (a Feistel
network, conjugated with "add one"): two values never meet in one surrogate, none is its own, and equal ones are
replaced alike in every document and format. So the collision check and coreference hold over all documents without a
table of entities. Card numbers keep their distance from a valid check digit. The letters and digits of an email are permuted
in their places; its domain goes under one that is reserved for examples. A word of a name is a number in the letters of
its script; its permuted number is written in syllables of that script, with an ending for a given name of either
gender or of none known and for a family name, so that one word has one surrogate of a kind and no other word has it. Chinese
names go to other ideographs, as many.

Names are found by what stands around them (a title, "my name is", "Dear ...,", a closing line, 先生 and the like after them) and by a list of
given names before a capitalised word. The words of a name that was found are then replaced wherever they stand alone in that
text, capitalised or in capitals; a word that was both a given and a family name counts as what it was first. So "Mr Brown" takes
"Brown" at the start of a sentence along. Inflected forms, initials, and names that nothing points to are left. Runs of
digits are phone numbers only after a word that says so; IBANs only with valid check digits.

A map over whole texts: no shuffle, no key, no state beyond a document.

Defined results: a null text stays null and has no entities; repeated rows are replaced alike; null ids and extra columns
are kept, but for a column entities, which is made anew; a text without entities comes back as it is; an empty table gives
no rows. The time grows with the length of a text, whatever it repeats.
"""

from __future__ import annotations

import hashlib
import ipaddress
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orbweave.llm import batches

#: An email is looked for from its @ to both sides: what may stand before it, from a letter or digit on, and its domain.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)", re.A)
CARD = re.compile(r"(?<![\w.-])(?:\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}|3[47]\d{2}([ -]?)\d{6}\2\d{5})(?![\w]|-\d)", re.A)
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w]|-\d)", re.A)
PHONE = re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)|(?<![\w.])\+\d{1,3}(?:[ .-]?\d{2,4}){3,4}(?!\w)", re.A)

IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", re.A)
IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:.]*:|\w)", re.A)
SAID_PHONE = re.compile(r"(?i:\b(?:phone|telephone|tel|mobile|cell|fax|whatsapp|call(?: me| us)?(?: at| on)?)\b)[ .:#-]{1,3}(\d{7,15})(?![\w-])", re.A)
_SEVEN, _COUNTRY = re.compile(r"\d{7}", re.A), re.compile(r"[A-Z]{2}\d{2}", re.A)

GIVEN = {
    ("latin", "f"): "Agnieszka Aisha Alice Barbara Caroline Diana Eleanor Emma Fatima Fiona Gabriela Hannah Ingrid Isabella Jane Julia Katarzyna Katherine Laura Margaret Maria Mary Natalie Olivia Patricia Rachel Sarah Sophia Theresa Victoria".split(),
    ("latin", "m"): "Ahmed Andrew Benjamin Carlos Charles Daniel David Edward Frederick George Hans Henry Isaac James John José Kenneth Lewis Łukasz Marcin Michael Mohammed Nathan Oliver Omar Patrick Paweł Peter Pierre Robert Samuel Thomas William".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Ксения Лариса Мария Наталья Ольга Полина Светлана Татьяна Юлия".split(),
    ("cyrillic", "m"): "Андрей Борис Виктор Григорий Дмитрий Евгений Иван Кирилл Леонид Михаил Николай Олег Павел Сергей Юрий".split(),
}
#: Chinese family names that a name may start with.
SURNAMES = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗"
FIRST_IDEOGRAPH, IDEOGRAPHS = 0x4E00, 20992

#: Latin letters with marks; the capital dotted I has no lower case of one letter and is left out.
_EXTENDED = [chr(c) for c in range(0x100, 0x180) if c != 0x130]
_UP = "A-ZÀ-ÖØ-Þ" + "".join(c for c in _EXTENDED if c.isupper())
_LOW = "a-zß-öø-ÿ" + "".join(c for c in _EXTENDED if c.islower())
#: Letters of the words, and consonants, vowels and endings (given f, given m, given of no known gender, family) of their surrogates.
LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "marked": "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ'-" + "".join(c for c in _EXTENDED if c.islower()), "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюяё"}
SYLLABLES = {"latin": ("bdfghjklmnprstvwxz", "aeiou", {"f": "lia", "m": "dor", "n": "ren", "": "son"}), "marked": ("bdfghjklmnprstvwxz", "aeiou", {"f": "line", "m": "bert", "n": "gard", "": "mann"}), "cyrillic": ("бвгджзклмнпрстфхцчш", "аеиоу", {"f": "лина", "m": "мир", "n": "тан", "": "нов"})}
_KNOWN = {w.lower(): g for (_, g), ws in GIVEN.items() for w in ws}
_CAP = rf"(?:[{_UP}]')?[{_UP}][{_LOW}]+(?:[{_UP}][{_LOW}]+)?(?:['-][{_UP}][{_LOW}]+){{0,2}}(?!\w)"
_ALL = rf"(?:[{_UP}]')?[{_UP}]{{2,}}(?:['-][{_UP}]{{2,}}){{0,2}}(?!\w)"
_CYR, _CYR_ALL = r"[А-ЯЁ][а-яё]+(?!\w)", r"[А-ЯЁ]{2,}(?!\w)"
_NAME = rf"(?:{_CAP}(?: {_CAP})?|{_ALL}(?: {_ALL})?)"
_FEMALE = {"mrs", "ms", "miss", "madam", "frau", "madame", "señora", "signora", "госпожа", "г-жа"}
_NEUTRAL = {"dr", "prof", "professor"}
_TITLES = "Mr Mrs Ms Miss Mister Sir Madam Dr Prof Professor Herr Frau Monsieur Madame Señor Señora Signor Signora".split()
TITLED = re.compile(rf"\b({'|'.join(_TITLES + [t.upper() for t in _TITLES])})(\.?[ ](?:[{_UP}]\. ){{0,2}})({_NAME})")
TITLED_CYRILLIC = re.compile(rf"\b([Гг]осподин|[Гг]оспожа|[Гг]-(?:н|жа)) ({_CYR}(?: {_CYR})?)")
_TITLE_WORDS = {t.lower() for t in _TITLES}
#: A capitalised word before another one: only there can a title or a given name begin a name.
_CUE = re.compile(rf"([{_UP}А-ЯЁ](?<!\w.)\w++)(?=\.? (?:[{_UP}]\. ){{0,2}}[{_UP}А-ЯЁ]['\w])")
_LISTED = {s: "|".join(w for (t, _), ws in GIVEN.items() if t == s for w in ws) for s in ("latin", "cyrillic")}
NAMED = re.compile(rf"\b(?:(?:{_LISTED['latin']}) (?:[{_UP}]\. )?{_CAP}|(?:{_LISTED['latin'].upper()}) (?:[{_UP}]\. )?{_ALL}|(?:{_LISTED['cyrillic']}) {_CYR}|(?:{_LISTED['cyrillic'].upper()}) {_CYR_ALL})")
INTRODUCED = re.compile(rf"\b(?i:my name is|full name:|name:|signed,?|sincerely,|regards,)\s{{1,3}}({_NAME})|\bDear ({_NAME})(?=[,:])|\b(?i:меня зовут) ({_CYR}(?: {_CYR})?)")
_CUES = ("name is", "name:", "signed", "sincerely,", "regards,", "dear ", "зовут")
_NO_NAMES = {"all", "colleague", "colleagues", "customer", "editor", "friend", "friends", "madam", "reader", "readers", "sir", "sirs", "team"} | {t.lower() for t in _TITLES}
CHINESE = re.compile(rf"([{SURNAMES}][一-鿿]{{1,2}}?)(?:先生|女士|小姐)|(?:我叫|姓名[：:])([{SURNAMES}][一-鿿]{{1,2}})(?![一-鿿])")
_CHINESE_CUES = ("先生", "女士", "小姐", "我叫", "姓名")
_FAMILIAR = re.compile(rf"(?=([{SURNAMES}][一-鿿]{{1,2}}))")
_WORD = re.compile(rf"(?<![\w'-])(?:{_CAP}|{_ALL}|{_CYR}|{_CYR_ALL})")


@lru_cache(100_000)
def _prf(key: bytes, what: str, size: int = 24) -> int:
    return int.from_bytes(hashlib.blake2b(what.encode(), key=key, digest_size=size).digest(), "big")


def _shuffle(key: bytes, tag: str, x: int, high: int, low: int, back: bool) -> int:
    """A Feistel network on high * low values, x = a * low + b."""
    a, b = divmod(x, low)
    for r in range(7, -1, -1) if back else range(8):
        sign = -1 if back else 1
        if r % 2:
            b = (b + sign * _prf(key, f"{tag}{r}:{a}")) % low
        else:
            a = (a + sign * _prf(key, f"{tag}{r}:{b}")) % high
    return a * low + b


def permuted(key: bytes, tag: str, x: int, high: int, low: int) -> int:
    """A permutation of range(high * low) without fixed points (of two values or more)."""
    return _shuffle(key, tag, (_shuffle(key, tag, x, high, low, False) + 1) % (high * low), high, low, True)


def permuted_digits(key: bytes, tag: str, digits: str) -> str:
    if len(digits) < 2:
        return str((int(digits) + 1 + _prf(key, tag) % 9) % 10) if digits else digits
    n = len(digits)
    return str(permuted(key, f"{tag}{n}", int(digits), 10 ** (n // 2), 10 ** (n - n // 2))).zfill(n)


def _in_format(shape: str, digits: str) -> str:
    """digits in the places of the shape's digits."""
    it = iter(digits)
    return re.sub(r"\d", lambda _: next(it), shape)


def check_digit(payload: str) -> int:
    total = sum(d if k % 2 else (2 * d - 9 * (d > 4)) for k, d in enumerate(map(int, reversed(payload))))
    return -total % 10


def _card(key: bytes, text: str) -> str:
    digits = re.sub(r"\D", "", text)
    off = (int(digits[-1]) - check_digit(digits[:-1])) % 10
    # the issuer's first digit stays
    body = digits[0] + permuted_digits(key, "card", digits[1:-1])
    return _in_format(text, body + str((check_digit(body) + off) % 10))


def _phone(key: bytes, text: str) -> str:
    digits = re.sub(r"\D", "", text)
    own = 10 if len(digits) >= 10 else len(digits)
    return _in_format(text, digits[: len(digits) - own] + permuted_digits(key, "phone", digits[-own:]))


def _ip(key: bytes, text: str) -> str:
    a, b, c, d = map(int, text.split("."))
    x = permuted(key, "ip", ((a * 256 + b) * 256 + c) * 256 + d, 1 << 16, 1 << 16)
    return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))


def _ipv6(key: bytes, text: str) -> str | None:
    """None for what is no address, or as short as a name in a program (a::b)."""
    if len(text.split(":")[0]) < 4 and len([g for g in text.split(":") if g]) < 3:
        return None
    try:
        x = int(ipaddress.IPv6Address(text))
    except ValueError:
        return None
    return str(ipaddress.IPv6Address(permuted(key, "ipv6", x, 1 << 64, 1 << 64))) if x > 1 else None


def _iban(key: bytes, text: str) -> str | None:
    """Country and shape stay, and the check digits are right again; None without right ones."""
    flat = text.replace(" ", "")
    rest = lambda body: int("".join(str(int(c, 36)) for c in body)) % 97
    if not 15 <= len(flat) <= 34 or rest(flat[4:] + flat[:4]) != 1:
        return None
    body = _in_places(key, f"iban{flat[:2]}", flat[4:])
    new = iter(flat[:2] + f"{98 - rest(body + flat[:2] + '00'):02d}" + body)
    return "".join(c if c == " " else next(new) for c in text)


def _in_places(key: bytes, tag: str, text: str) -> str:
    """Letters to letters and digits to digits, in their places, by a permutation of all texts of that shape."""
    low = text.lower()
    places = [(k, 10 if c.isdigit() else 26, ord(c) - (48 if c.isdigit() else 97)) for k, c in enumerate(low) if c.isalnum()]
    if not places:
        return text
    shape = re.sub("[a-z]", "a", re.sub(r"[0-9]", "0", low))
    half, x, sizes = len(places) // 2, 0, [1, 1]
    for n, (_, base, v) in enumerate(places):
        x = x * base + v
        sizes[n >= half] *= base
    y, out = permuted(key, tag + shape, x, *sizes), list(text)
    for k, base, _ in reversed(places):
        y, v = divmod(y, base)
        c = chr(v + (48 if base == 10 else 97))
        out[k] = c.upper() if text[k].isupper() else c
    return "".join(out)


def _email(key: bytes, text: str) -> str:
    name, domain = text.split("@")
    labels = domain.split(".")
    return f"{_in_places(key, 'local', name)}@{'.'.join(_in_places(key, 'domain', x) for x in labels[:-1])}.{labels[-1].lower()}.example"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost emails that don't overlap, in time that grows with the text."""
    end, at = 0, text.find("@")
    while at >= 0:
        low = at
        while low > end and text[low - 1] in LOCAL:
            low -= 1
        while low < at and not (text[low].isascii() and text[low].isalnum()):
            low += 1
        found = DOMAIN.match(text, at + 1) if low < at else None
        if found:
            end = found.end()
            yield low, end
        else:
            end = at + 1
        at = text.find("@", max(end, at + 1))


NUMBERS = (("card", CARD, _card), ("ssn", SSN, lambda key, t: _in_format(t, permuted_digits(key, "ssn", re.sub(r"\D", "", t)))), ("ip", IP, _ip), ("phone", PHONE, _phone))


@lru_cache(100_000)
def name_word(key: bytes, word: str, gender: str) -> str:
    """The surrogate of a word of a name; gender: f, m or n (not known) of a given name, empty for a family name.

    Words of up to two letters, up to four, and so on are one space each, and have more syllables than shorter ones.
    """
    low = word.lower()
    script = "cyrillic" if low[0] in LETTERS["cyrillic"] else "latin" if all(c in LETTERS["latin"] for c in low) else "marked"
    letters, (consonants, vowels, endings) = LETTERS[script], SYLLABLES[script]
    base, size = len(letters) + 1, len(low) + len(low) % 2
    x = 0
    for c in low.ljust(size):
        x = x * base + letters.find(c) + 1
    y = permuted(key, f"name{gender}{script}{size}", x, base ** (size // 2), base ** (size // 2))
    each = len(consonants) * len(vowels)
    out = ""
    for _ in range(math.ceil(size * math.log(base) / math.log(each) - 1e-9)):
        y, v = divmod(y, each)
        out = consonants[v // len(vowels)] + vowels[v % len(vowels)] + out
    new = (out + endings[gender]).capitalize()
    return new.upper() if word.isupper() and len(word) > 1 else new


def ideographs(key: bytes, name: str) -> str:
    """As many other ideographs."""
    x, out = 0, ""
    for c in name:
        x = x * IDEOGRAPHS + ord(c) - FIRST_IDEOGRAPH
    half = len(name) // 2
    y = permuted(key, f"ideographs{len(name)}", x, IDEOGRAPHS**half, IDEOGRAPHS ** (len(name) - half))
    for _ in name:
        y, v = divmod(y, IDEOGRAPHS)
        out = chr(FIRST_IDEOGRAPH + v) + out
    return out


def _people(text: str) -> Iterator[tuple[int, int, str]]:
    """start, end, gender of the given names in it: a capital says that a single word is a given name."""
    for c in _CUE.finditer(text):
        word = c[1].lower()
        if word in _TITLE_WORDS and (m := TITLED.match(text, c.start())):
            if word == "dr" and re.search(rf"[{_UP}][{_LOW}]+ $", text[max(0, m.start() - 30) : m.start()]):
                continue  # a street
            yield *m.span(3), "f" if word in _FEMALE else "n" if word in _NEUTRAL else "m"
        elif word in _KNOWN and (m := NAMED.match(text, c.start())):
            yield *m.span(), "n"
    if "оспо" in text or "г-" in text or "Г-" in text:
        for m in TITLED_CYRILLIC.finditer(text):
            yield *m.span(2), "f" if m[1].lower() in _FEMALE else "m"
    low = text.lower()
    for m in INTRODUCED.finditer(text) if any(cue in low for cue in _CUES) else ():
        k = m.lastindex
        if m[k].split(" ")[0].lower() not in _NO_NAMES:
            yield *m.span(k), "N"


def _name_words(text: str, a: int, b: int, gender: str) -> Iterator[tuple[int, int, str]]:
    """start, end, gender of the words of a name, initials left out."""
    words = [(a + m.start(), a + m.end()) for m in re.finditer(r"[^ ]+", text[a:b]) if not m[0].endswith(".")]
    for k, (x, y) in enumerate(words):
        last = k == len(words) - 1 and not (len(words) == 1 and gender.isupper())
        known = _KNOWN.get(text[x:y].lower(), _KNOWN.get(text[words[0][0] : words[0][1]].lower(), gender.lower()))
        yield x, y, "" if last and text[x:y].lower() not in _KNOWN else known


def surrogates(text: str, key: bytes, digits: bool = True) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with surrogates, and (kind, start, end) of the entities in the text as it was; digits: it may hold numbers."""
    found: list[tuple[int, int, str, str]] = []
    free = bytearray(len(text) + 1)

    def claim(kind, a, b, new):
        if not any(free[a:b]):
            free[a:b] = b"\1" * (b - a)
            found.append((a, b, kind, new))

    if "@" in text:
        for a, b in emails(text):
            claim("email", a, b, _email(key, text[a:b]))
    if digits:
        for m in IBAN.finditer(text) if _COUNTRY.search(text) else ():
            if new := _iban(key, m[0]):
                claim("iban", m.start(), m.end(), new)
        for kind, pattern, make in NUMBERS:
            for m in pattern.finditer(text):
                claim(kind, m.start(), m.end(), make(key, m[0]))
        for m in SAID_PHONE.finditer(text) if _SEVEN.search(text) else ():
            claim("phone", m.start(1), m.end(1), _phone(key, m[1]))
    if "::" in text or text.count(":") >= 7:
        for m in IPV6.finditer(text):
            if new := _ipv6(key, m[0]):
                claim("ip", m.start(), m.end(), new)
    roles: dict[str, str] = {}
    for a, b, gender in _people(text):
        words = list(_name_words(text, a, b, gender))
        for x, y, g in words:
            roles.setdefault(text[x:y].lower(), g)
        new, at = "", a
        for x, y, g in words:
            new, at = new + text[at:x] + name_word(key, text[x:y], g), y
        claim("name", a, b, new + text[at:b])
    for m in _WORD.finditer(text) if roles else ():
        if (g := roles.get(m[0].lower())) is not None:
            claim("name", m.start(), m.end(), name_word(key, m[0], g))
    chinese = {m[1] or m[2] for m in CHINESE.finditer(text)} if any(cue in text for cue in _CHINESE_CUES) else set()
    for m in _FAMILIAR.finditer(text) if chinese else ():
        for name in (m[1], m[1][:2]):
            if name in chinese:
                claim("name", m.start(), m.start() + len(name), ideographs(key, name))
    if not found:
        return text, []
    out, at = [], 0
    for a, b, _, new in sorted(found):
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), [(kind, a, b) for a, b, kind, _ in sorted(found)]


def replace_pii(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """docs with surrogates in the text, and entities: array<struct<kind, start, end>> of the text as it was.

    Who has the key can undo the permutations: keep it secret.
    """
    docs = docs.drop("entities")
    fields = docs.schema

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in stream:
            where = batch.schema.get_field_index(text)
            for a, b in batches.pieces(batch, text):
                part = batch.slice(a, b - a)
                body, at = batches.string_bytes(part.column(where))
                number = np.concatenate([[0], np.cumsum((body >= 0x30) & (body <= 0x39))])
                number = number[at[1:]] - number[at[:-1]]
                rows = [(None, []) if t is None else surrogates(t, key, n >= 4) for t, n in zip(part.column(where).to_pylist(), number.tolist(), strict=True)]
                columns = [pa.array([t for t, _ in rows], pa.string()) if k == where else part.column(k) for k in range(part.num_columns)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in e] for _, e in rows], spans)], names=[*part.schema.names, "entities"])

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", entities array<struct<kind:string,start:bigint,end:bigint>>")


def op6_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    """doc_id, text with surrogates, n_entities and the entities' places, of all documents."""
    from pyspark.sql import functions as F

    found = replace_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), b"a key for this query")
    return found.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), "entities")


QUERIES = {"op6_pii_surrogates": op6_pii_surrogates}
ORACLE_SQL: dict[str, str] = {}
