"""Personal data: detected entities get keyed surrogates of their type and format; collisions and the gender of names are settled over the whole corpus."""

from __future__ import annotations

import hashlib
import ipaddress
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, free_name, saved, trim

#: Session setting with the key of the surrogates, and the key of evaluations, which keeps nothing secret and is used (with a warning) only without it.
KEY_SETTING = "spark.priorwise.pii.key"
EVALUATION_KEY = b"evaluation only"

# Forms of address, and some given names by gender.
TITLES = {"Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "Don": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mademoiselle": "f", "Señora": "f", "Señorita": "f", "Doña": "f", "Dr": "n", "Prof": "n", "Господин": "m", "Госпожа": "f"}
FEMALE = ["Alice", "Anna", "Carmen", "Catherine", "Charlotte", "Claire", "Elena", "Elizabeth", "Emily", "Emma", "Hannah", "Heidi", "Ingrid", "Isabel", "Jane", "Jennifer", "Julia", "Laura", "Lucia", "Margaret", "Maria", "Marie", "Mary", "Monika", "Olivia", "Patricia", "Sabine", "Sarah", "Sophie", "Susan", "Анна", "Елена", "Мария", "Ольга"]
MALE = ["Andreas", "Antonio", "Carlos", "Charles", "Daniel", "David", "Francisco", "Georg", "Hans", "Henri", "Jacques", "James", "Jean", "John", "José", "Juan", "Jürgen", "Klaus", "Louis", "Luis", "Manuel", "Michael", "Miguel", "Peter", "Pierre", "Richard", "Robert", "Stefan", "Thomas", "William", "Алексей", "Дмитрий", "Иван", "Сергей"]
GENDER = {n: "f" for n in FEMALE} | {n: "m" for n in MALE}
# Titles that are also written in capitals, and words that make a place of a following given name.
TITLES |= {t.upper(): TITLES[t] for t in ("Mr", "Mrs", "Dr", "Prof", "Herr", "Herrn", "Frau", "Mme")} | {"MS.": "f"}
PLACES = {"San", "Santa", "Santo", "São", "Saint", "St", "Sankt", "Port", "Fort", "Lake", "Mount", "Cape"}
GIVEN_NAMES = GENDER | {n.upper(): g for n, g in GENDER.items()}

# Syllables and endings of invented names by script and gender.
SYLLABLES = {"latin": ["ba", "be", "bri", "ca", "co", "da", "del", "do", "fa", "fi", "ga", "hel", "ka", "ki", "la", "le", "lo", "ma", "mi", "na", "no", "pa", "ra", "ri", "ro", "sa", "si", "ta", "to", "va", "vi", "za"], "cyrillic": ["ба", "ве", "га", "да", "жи", "за", "ка", "ле", "ма", "ни", "па", "ра", "се", "та", "фи", "ша"], "greek": ["βα", "γε", "δα", "ζο", "θα", "κα", "λε", "μα", "νι", "πα", "ρο", "σα", "τα", "φι", "χα", "ψα"]}
ENDINGS = {("latin", "f"): ["na", "line", "ra", "ssa"], ("latin", "m"): ["n", "ric", "rt", "s"], ("latin", "n"): ["n", "l", "r", "th"], ("latin", "last"): ["man", "ner", "ton", "well"], ("cyrillic", "f"): ["на", "ия"], ("cyrillic", "m"): ["н", "слав"], ("cyrillic", "n"): ["н", "р"], ("cyrillic", "last"): ["ко", "ук"], ("greek", "f"): ["να", "ια"], ("greek", "m"): ["ς", "νος"], ("greek", "n"): ["ς", "ν"], ("greek", "last"): ["ιδης", "ακης"]}

EMAIL = re.compile(r"(?<![\w.+-])[\w+-]+(?:\.[\w+-]+)*@(?:[^\W_]|-)+(?:\.(?:[^\W_]|-)+)*\.[^\W\d_]{2,}(?![\w-])")
IPV6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])")
NUMBERS = re.compile(
    r"(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<secret>(?<!\w)(?:(?=[a-f]*\d)[0-9a-f]{32,128}|(?=[A-F]*\d)[0-9A-F]{32,128}|(?:sk|pk|ghp|gho|xoxb|AKIA|AIza)[-_]?[A-Za-z0-9_-]{16,})(?!\w))"
    r"|(?P<national>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d))"
    r"|(?P<phone>(?<!\w)(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ ]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)|(?<!\w)\+\d{1,3}(?:[ .-]\(?\d{2,8}\)?){2,5}(?!\w)|(?<![\w./-])0[1-9]\d{0,3}[ /-]\d{5,8}(?![\w./-]))"
    r"|(?P<account>(?<!\w)\d(?:[ -]?\d){12,18}(?!\w))"
)
WORD = re.compile(r"[^\W\d_]+")
_UPPER = r"[A-ZÀ-ÖØ-ÞА-ЯЁΑ-Ω]"
_MORE = r"(?:['’-](?!s(?!\w))[^\W\d_]+)*"  # further parts of a name: "-Lüdenscheid", "'Brien", not the 's of a genitive
_NAME = rf"(?:{_UPPER}[^\W\d_]+|{_UPPER}(?=['’-](?!s(?!\w))[^\W\d_])){_MORE}"
TOKEN = re.compile(rf"(?<![^\W\d_])[^\W\d_]+{_MORE}(?![^\W\d_])")
PART = re.compile(r"['’-]")
TITLED = re.compile(r"(?<!\w)(" + "|".join(re.escape(t) for t in sorted(TITLES, key=len, reverse=True)) + rf")\.? ((?:{_NAME})(?: {_NAME})?)(?!\w)")
GIVEN = re.compile(r"(?<![\w'’-])(" + "|".join(sorted(GIVEN_NAMES, key=len, reverse=True)) + rf")({_MORE}) ({_NAME})(?!\w)")
_PLACE = re.compile(r"(?<!\w)(?:" + "|".join(sorted(PLACES)) + r")\.? $")
_MARKS = {*(t.rstrip(".") for t in TITLES), *GIVEN_NAMES}
# Phrases before a name, a date of birth or a passport number; words of streets; country calling codes of one and two digits.
SAID = re.compile(r"(?i:(?<!\w)(?:my name is|name:|mein name ist|ich heiße|je m'appelle|me llamo|mi nombre es|меня зовут)) +(" + _NAME + ") (" + _NAME + r")(?!\w)")
BORN = re.compile(r"(?i:(?<!\w)(?:born(?: on)?|date of birth:?|dob:?|geboren am|geburtsdatum:?|né le|née le|nacido el|nacida el|fecha de nacimiento:?|родился|родилась)) +(\d{1,2}[./-]\d{1,2}[./-]\d{4}|\d{4}-\d{2}-\d{2})(?!\d)")
PASSPORT = re.compile(r"(?i:(?<!\w)(?:passport|reisepass|passeport|pasaporte|паспорт)(?: no\.?| number|nummer| n°)?:?) +(?=[A-Z]{0,9}\d)([A-Z0-9]{8,9})(?!\w)")
STREET = {"street", "st", "avenue", "ave", "road", "rd", "lane", "ln", "drive", "boulevard", "blvd", "court", "square", "rue", "place", "calle", "avenida", "plaza", "de", "du", "des", "la", "le"}
COMPOUND = re.compile(r"(straße|strasse|weg|platz|allee|gasse)$")
ADDRESS = re.compile(
    r"(?<!\w)\d{1,5} (?:[A-Z][a-z]+ ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square)(?!\w)"
    r"|(?<!\w)[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|weg|platz|allee|gasse) \d{1,4}[a-z]?(?!\w)"
    r"|(?<!\w)\d{1,4} (?:rue|avenue|boulevard|place) (?:(?:de|du|des|la|le) )*[A-ZÀ-Þ][a-zà-þ]+(?!\w)"
    r"|(?<!\w)(?:Calle|Avenida|Plaza) (?:(?:de|la) )*[A-ZÀ-Þ][a-zà-þ]+ \d{1,4}(?!\w)"
)
CALLING = {"1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98"}
_KEY = r"(?:sk|pk|ghp|gho|xoxb|AKIA|AIza)[-_]?[A-Za-z0-9_-]{16}"
_NUMBERED = re.compile(r"\d|" + _KEY)  # found in every text in which NUMBERS is


# Parts that every match of the pattern has in it (of the text in lower case; of ADDRESS: as written): texts without any skip the pattern.
_HAS = {
    SAID: ("my name is", "name:", "mein name ist", "ich heiße", "je m'appelle", "me llamo", "mi nombre es", "меня зовут"),
    BORN: ("born", "date of birth", "dob", "geboren", "geburtsdatum", "né", "nacid", "fecha de nacimiento", "родил"),
    PASSPORT: ("passport", "reisepass", "passeport", "pasaporte", "паспорт"),
    ADDRESS: ("St", "Ave", "Road", "Rd", "Lane", "Ln", "Drive", "Boulevard", "Blvd", "Court", "Square", "straße", "strasse", "weg", "platz", "allee", "gasse", "rue ", "avenue ", "boulevard ", "place ", "Calle", "Plaza"),
}


def _all(pattern: re.Pattern, text: str, seen: str) -> Iterator[re.Match]:
    return pattern.finditer(text) if any(x in seen for x in _HAS[pattern]) else iter(())


def national(phone: str) -> str:
    """The digits of a phone number without country code and leading zeros: forms with and without them are one entity."""
    digits = re.sub(r"\D", "", phone)
    if phone.startswith("+"):
        digits = digits[next((n for n in (1, 2) if digits[:n] in CALLING), 3) :]
    return digits.lstrip("0") or digits


def _private(ip: str) -> bool:
    a, b = map(int, ip.split(".")[:2])
    return a in (10, 127) or (a, b) == (192, 168) or a == 172 and 16 <= b < 32


def _names(text: str, lower: str) -> list[tuple[int, int, str, str]]:
    """Names after titles, given names and introductions, given names alone, and bare parts of these elsewhere in the text, in any case that
    starts with a capital. Names joined by hyphens or apostrophes are one name. A given name's gender is that of any of its mentions that tells one."""
    found, genders, lasts = [], {}, set()

    def person(first, last, gender):
        if first:
            found.append((*first, "first", gender))
            name = text[slice(*first)].lower()
            told = GENDER.get(PART.split(name)[0].capitalize(), "n") if gender == "n" else gender
            if genders.get(name, "n") == "n":
                genders[name] = told
        if last:
            found.append((*last, "last", ""))
            lasts.add(text[slice(*last)].lower())

    marked = not _MARKS.isdisjoint(WORD.findall(text))  # a title or given name that matches is a whole run of letters
    for m in TITLED.finditer(text) if marked else ():
        first, _, last = m[2].partition(" ")
        at = m.start(2)
        person((at, at + len(first)) if last else None, (at + len(first) + 1, m.end()) if last else (at, m.end()), TITLES[m[1]])
    for m in GIVEN.finditer(text) if marked else ():
        if not _PLACE.search(text, max(0, m.start() - 8), m.start()):
            person((m.start(1), m.end(2)), m.span(3), GIVEN_NAMES[m[1]])
    for m in _all(SAID, text, lower):
        person(m.span(1), m.span(2), "n")
    if not found and not marked:
        return []
    known = {(a, b) for a, b, _, _ in found}
    tokens = [(m.span(), m[0]) for m in TOKEN.finditer(text) if m[0][0].isupper()]
    for (a, b), word in tokens:
        head, *others = PART.split(word)
        if (a, b) not in known and head in GENDER and word.lower() not in lasts and not _PLACE.search(text, max(0, a - 8), a):
            end = b if all(p[0].isupper() for p in others) else a + len(head)
            person((a, end), None, GENDER[head])
            known.add((a, b))
    for (a, b), word in tokens:
        if (a, b) in known:
            continue
        name = word.lower()
        parts = PART.split(name)
        if name in lasts or name in genders:
            found.append((a, b, "last" if name in lasts else "first", ""))
        elif len(parts) > 1 and any(p in lasts or p in genders for p in parts):
            # "Schmidt-Weber" after "Schmidt" is a name; of "Schmidt-based" the part is
            if all(p[0].isupper() for p in PART.split(word)):
                person(None, (a, b), "")
            else:
                for m in WORD.finditer(text, a, b):
                    if m[0][0].isupper() and (m[0].lower() in lasts or m[0].lower() in genders):
                        found.append((*m.span(), "last" if m[0].lower() in lasts else "first", ""))
    return [(a, b, "last" if kind == "last" else f"first_{genders[text[a:b].lower()]}", text[a:b].lower()) for a, b, kind, _ in found]


def _ipv6(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Valid addresses of at least three groups and a digit, which tells them from names with colons."""
    for m in IPV6.finditer(text):
        if sum(map(bool, m[0].split(":"))) > 2 and any(c.isdigit() for c in m[0]):
            try:
                yield (*m.span(), "ipv6", ipaddress.IPv6Address(m[0]).exploded)
            except ValueError:
                continue


def mentions(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of the entities of a text, in order, without overlaps.

    kind: email, iban, secret, national, ip, ipv6, private (addresses of private networks), phone, account, born, passport, address, first_f,
    first_m, first_n, last. Forms that differ only in case or punctuation, or by a phone's country code, have one canonical form."""
    if not text:
        return []
    found: list[tuple[int, int, str, str]] = []
    lower = text.lower()
    if "@" in text:
        found += [(m.start(), m.end(), "email", m[0].lower()) for m in EMAIL.finditer(text)]
    if _NUMBERED.search(text):
        for m in NUMBERS.finditer(text):
            kind, digits = m.lastgroup, re.sub(r"\D", "", m[0])
            if kind == "ip":
                if any(int(x) > 255 for x in m[0].split(".")):
                    continue
                canon = ".".join(str(int(x)) for x in m[0].split("."))
                kind = "private" if _private(canon) else kind
            elif kind == "phone":
                canon = national(m[0])
            elif kind == "iban":
                canon = m[0].replace(" ", "")
            elif kind == "secret":
                canon = m[0].lower() if re.fullmatch(r"[0-9A-Fa-f]+", m[0]) else m[0]
            else:
                canon = digits
            found.append((m.start(), m.end(), kind, canon))
        if "::" in text or text.count(":") > 6:
            found += _ipv6(text)
        for kind, pattern in (("born", BORN), ("passport", PASSPORT)):
            found += [(m.start(1), m.end(1), kind, m[1]) for m in _all(pattern, text, lower)]
        found += [(m.start(), m.end(), "address", m[0].lower()) for m in _all(ADDRESS, text, text)]
    found += _names(text, lower)
    out, end = [], 0
    for x in sorted(found, key=lambda x: (x[0], -x[1])):
        if x[0] >= end:
            out.append(x)
            end = x[1]
    return out


def _stream(key: bytes, *parts) -> Iterator[int]:
    block = 0
    while True:
        yield from hashlib.blake2b("\x1f".join(map(str, [*parts, block])).encode("utf-8", "surrogatepass"), key=key[:64]).digest()
        block += 1


def _pick(bytes_: Iterator[int], n: int) -> int:
    return int.from_bytes(bytes([next(bytes_) for _ in range(8)]), "big") % n


def _script(word: str) -> str:
    c = word[:1].lower()
    return "cyrillic" if "а" <= c <= "я" else "greek" if "α" <= c <= "ω" else "latin"


def _shape(text: str, b: Iterator[int], hexadecimal: bool = False) -> str:
    def one(c: str) -> str:
        if c.isdigit():
            return "0123456789abcdef"[_pick(b, 16)] if hexadecimal else str(_pick(b, 10))
        if hexadecimal:
            return "0123456789abcdef"[_pick(b, 16)]
        if c.isalpha():
            script = _script(c)
            letter = chr({"latin": 97, "cyrillic": 0x430, "greek": 0x3B1}[script] + _pick(b, {"latin": 26, "cyrillic": 32, "greek": 17}[script]))
            return letter.upper() if c.isupper() else letter
        return c

    return "".join(map(one, text))


def luhn(digits: str) -> int:
    """0 for a valid number."""
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10


def _next_of(x: int, bits: int, key: bytes) -> int:
    """The next number on a keyed cycle through all numbers of so many bits (even): no two have one successor and none has itself."""
    half = bits // 2
    low = (1 << half) - 1
    mixed = lambda i, v: int.from_bytes(hashlib.blake2b(bytes([i]) + v.to_bytes(4, "big"), key=key[:64], digest_size=4).digest(), "big") & low
    a, b = x >> half, x & low
    for i in range(8):
        a, b = b, a ^ mixed(i, b)
    y = ((a << half | b) + 1) & ((1 << bits) - 1)
    a, b = y >> half, y & low
    for i in reversed(range(8)):
        a, b = b ^ mixed(i, a), a
    return a << half | b


def surrogate(kind: str, canon: str, attempt: int, key: bytes) -> str:
    """A canonical form of the same type and format that only the key, the entity and the attempt decide."""
    b = _stream(key, kind, canon, attempt)
    if kind == "email":
        local, _, domain = canon.rpartition("@")
        d = _stream(key, "domain", domain)
        top = domain.rpartition(".")[2]
        return f"{_shape(local, b)}@{''.join(chr(97 + _pick(d, 26)) for _ in range(8))}.example.{top if top in ('com', 'net', 'org') else 'com'}"
    if kind == "ip":
        head = [x for x in range(11, 224) if x not in (127, 172, 192)][_pick(b, 210)]
        return ".".join(map(str, [head, *[1 + _pick(b, 254) for _ in range(3)]]))
    if kind == "ipv6":
        # groups that are zero, link-local and private heads stay, others keep their number of digits
        def group(i: int, g: str) -> str:
            n = len(g.lstrip("0"))
            if not n or i == 0 and g[:2] in ("fe", "fc", "fd"):
                return g
            head = g[-n] if i == 0 else "123456789abcdef"[_pick(b, 15)]
            return (head + "".join("0123456789abcdef"[_pick(b, 16)] for _ in range(n - 1))).zfill(4)

        return ":".join(group(i, g) for i, g in enumerate(canon.split(":")))
    if kind == "private":
        o = [int(x) for x in canon.split(".")]
        bits = 24 if o[0] in (10, 127) else 20 if o[0] == 172 else 16
        number = int.from_bytes(bytes(o), "big")
        new = (number >> bits << bits | _next_of(number & ((1 << bits) - 1), bits, key)).to_bytes(4, "big")
        return ".".join(map(str, new))
    if kind == "born":
        return re.sub(r"\d+", lambda m: str(1940 + _pick(b, 65)) if len(m[0]) == 4 else str(1 + _pick(b, 12 if len(m[0]) == 2 else 9)).zfill(len(m[0])), canon)
    if kind == "passport":
        return _shape(canon, b)
    if kind == "address":
        s = SYLLABLES["latin"]
        invented = lambda: "".join(s[_pick(b, len(s))] for _ in range(2 + attempt // 3))

        def word(w: str) -> str:
            if w[0].isdigit():
                return str(1 + _pick(b, 9)) + _shape(w[1:], b)
            end = COMPOUND.search(w)
            return w if w in STREET else invented() + end[0] if end else invented() + "n"

        return " ".join(map(word, canon.split(" ")))
    if kind == "phone":
        out = _shape(canon, b)
        return str(1 + _pick(b, 9)) + out[1:] if len(canon) != 10 else str(2 + _pick(b, 8)) + out[1:3] + str(2 + _pick(b, 8)) + out[4:]
    if kind == "national":
        return "9" + _shape(canon[1:], b)
    if kind == "account":
        out = canon[0] + _shape(canon[1:-1], b)
        valid = luhn(canon) == 0
        last = next(x for x in map(str, range(10)) if luhn(out + x) == 0)
        return out + (last if valid else str((int(last) + 1 + _pick(b, 9)) % 10))
    if kind == "iban":
        out = canon[:2] + "00" + _shape(canon[4:], b)
        number = int("".join(str(int(c, 36)) for c in out[4:] + out[:4]))
        return out[:2] + f"{98 - number % 97:02d}" + out[4:]
    if kind == "secret":
        if re.fullmatch(r"[0-9a-f]+", canon):
            return _shape(canon, b, True)
        head = re.match(r"(?:sk|pk|ghp|gho|xoxb|AKIA|AIza)[-_]?", canon)[0]
        return head + _shape(canon[len(head) :], b)
    gender = kind.partition("_")[2] or "last"

    parts = re.split(r"(['’-])", canon)
    short = all(len(p) < 2 for p in parts)

    def name(part: str) -> str:
        if len(part) < 2 and not (short and part.isalpha()):
            return part  # a mark between parts, or the letter before an apostrophe
        script = _script(part)
        pool = [n.lower() for n, g in GENDER.items() if g == gender and _script(n) == script]
        if attempt < 2 and pool:
            return pool[_pick(b, len(pool))]
        s = SYLLABLES[script]
        return "".join(s[_pick(b, len(s))] for _ in range(2 + attempt // 3)) + ENDINGS[script, gender][_pick(b, len(ENDINGS[script, gender]))]

    return "".join(map(name, parts))


def written(kind: str, surface: str, new: str) -> str:
    """A surrogate in the format of the mention: punctuation, case and country code as there."""
    if kind in ("phone", "national", "account", "iban"):
        out, left = list(surface), list(new)
        for i in range(len(out) - 1, -1, -1):
            if left and (out[i].isalnum() if kind == "iban" else out[i].isdigit()):
                out[i] = left.pop()
        return "".join(out)
    if kind == "address":
        return " ".join(n[:1].upper() + n[1:] if o[:1].isupper() else n for o, n in zip(surface.split(" "), new.split(" ")))
    if kind in ("email", "secret") and surface.isupper() and any(c.isalpha() for c in surface):
        return new.upper()
    if kind.startswith("first") or kind == "last":
        return new.upper() if surface.isupper() and len(surface) > 1 else WORD.sub(lambda m: m[0].capitalize(), new)
    if kind == "ipv6":
        # groups before and after the gap, each as wide as there
        groups, (left, _, right) = new.split(":"), surface.partition("::")
        fit = lambda part, own: ":".join((g.lstrip("0") or "0").zfill(len(o)) for o, g in zip(part.split(":"), own)) if part else ""
        out = fit(left, groups) + ("::" + fit(right, groups[-right.count(":") - 1 :]) if "::" in surface else "")
        return out.upper() if surface.isupper() else out
    return new


def _marks(docs: DataFrame, text: str) -> tuple:
    return F.xxhash64(F.col(text)).alias("_k1"), F.xxhash64(F.lit(7), F.col(text)).alias("_k2")


def session_key(spark: SparkSession) -> bytes:
    """The key of the session setting spark.priorwise.pii.key; without it that of evaluations, with a warning."""
    if key := spark.conf.get(KEY_SETTING, None):
        return key.encode()
    warnings.warn(f"{KEY_SETTING} is not set: surrogates are made with the evaluation key and are no secret", stacklevel=3)
    return EVALUATION_KEY


def _family(kind) -> F.Column:
    """Kinds whose values may be taken for one another: all parts of names are one family."""
    return F.when(kind.startswith("first") | (kind == "last"), "name").otherwise(kind)


def _told(entities: DataFrame) -> DataFrame:
    """(kind, canon, as): a given name of unknown gender is the one of the gender that the corpus tells of it elsewhere, if it tells just one."""
    names = entities.where("kind like 'first%'").groupBy("canon").agg(F.max(F.col("kind") == "first_f").alias("f"), F.max(F.col("kind") == "first_m").alias("m"))
    one = names.where("f <> m").select("canon", F.lit("first_n").alias("kind"), F.when(F.col("f"), "first_f").otherwise("first_m").alias("_one"))
    return entities.join(one, ["kind", "canon"], "left").select("kind", "canon", F.coalesce("_one", "kind").alias("as"))


def assign_surrogates(entities: DataFrame, key: bytes | None = None, rounds: int = 200) -> DataFrame:
    """(kind, canon, surrogate) for distinct entities (kind, canon): no two of a family (a kind; of names all kinds) share a surrogate, and
    none is an entity of the corpus in that family. A given name of unknown gender is one with the same name of the one known gender that the
    corpus has of it. Entities whose candidate collides try again, round by round; of several with one candidate the least keeps it.
    Addresses of private networks, whose spaces are small, go round a keyed cycle through the space instead: distinct at once, though a
    surrogate may be another real address there. No entities give no rows. Raises where a kind still collides after all rounds."""
    key = key or session_key(entities.sparkSession)

    def make(attempt: int):
        return F.pandas_udf(lambda kind, canon: pd.Series([surrogate(k, c, attempt, key) for k, c in zip(kind, canon)]), "string")("kind", "canon")

    told = saved(_told(entities.select("kind", "canon").distinct()))
    every = told.where(F.col("kind") == F.col("as")).select("kind", "canon")
    same = told.where(F.col("kind") != F.col("as")).select(F.col("kind").alias("_n"), F.col("as").alias("kind"), "canon")
    real, closed = every.where("kind <> 'private'"), saved(every.where("kind = 'private'").select("kind", "canon", make(0).alias("surrogate")))
    pending, done = real, None
    for attempt in range(rounds):
        tried = saved(pending.select("kind", "canon", make(attempt).alias("surrogate"), _family(F.col("kind")).alias("family")))
        if not tried.limit(1).count():
            done = done if done is not None else tried.select("kind", "canon", "surrogate")
            return done.unionByName(closed).unionByName(same.join(done, ["kind", "canon"]).select(F.col("_n").alias("kind"), "canon", "surrogate"))
        taken = real.select(_family(F.col("kind")).alias("family"), F.col("canon").alias("surrogate"))
        if done is not None:
            taken = taken.unionByName(done.select(_family(F.col("kind")).alias("family"), "surrogate"))
        least = tried.groupBy("family", "surrogate").agg(F.min(F.struct("kind", "canon")).alias("e"))
        good = least.join(taken, ["family", "surrogate"], "left_anti").select("e.kind", "e.canon", "surrogate")
        new = saved(good if done is None else done.unionByName(good))
        rest = saved(tried.join(new, ["kind", "canon"], "left_anti").select("kind", "canon"))
        discard(tried, *[d for d in (done, pending if attempt else None) if d is not None])
        done, pending = new, rest
    raise RuntimeError(f"surrogates still collide after {rounds} rounds")


def replace_pii(docs: DataFrame, key: bytes | None = None, text: str = "text", count: str = "n_entities") -> DataFrame:
    """docs with every detected entity in text replaced, and n_entities (long; or the name in count), the number of mentions replaced.

    key: secret of the surrogates (None: that of the session setting spark.priorwise.pii.key). An empty table gives no rows.
    One entity has one surrogate in the whole corpus, different ones different surrogates; a name that the corpus has of both genders is two entities,
    and its mentions of unknown gender a third. A null or empty text stays as it is.
    Other columns, repeated rows included, are kept; a column named as count says is replaced, those of other names are safe. Entities travel by text, so ids may be null or repeated."""
    key = key or session_key(docs.sparkSession)
    docs = docs.drop(*[c for c in docs.columns if c.lower() == count.lower()])
    k1, k2, kinds_in, canons_in, news_in, name = (free_name(docs, c) for c in ("_k1", "_k2", "_kinds", "_canons", "_surrogates", "_new"))

    @F.pandas_udf("array<struct<kind:string,canon:string>>")
    def detect(texts: pd.Series) -> pd.Series:
        out = texts.map(lambda t: [{"kind": k, "canon": c} for k, c in dict.fromkeys(x[2:] for x in mentions(t))])
        trim()
        return out

    # every text passes through Python once: a filter by all names and forms in the JVM takes three times as long
    hits = saved(docs.select(*_marks(docs, text), F.explode(detect(F.col(text))).alias("e")).select("_k1", "_k2", "e.kind", "e.canon").distinct())
    mapped = assign_surrogates(hits, key)
    lists = hits.join(mapped, ["kind", "canon"]).groupBy("_k1", "_k2").agg(F.collect_list(F.struct("kind", "canon", "surrogate")).alias("_e"))
    lists = lists.select(F.col("_k1").alias(k1), F.col("_k2").alias(k2), *[F.col("_e").getField(c).alias(n) for c, n in (("kind", kinds_in), ("canon", canons_in), ("surrogate", news_in))])

    @F.pandas_udf("struct<text:string,n:long>")
    def rewrite(texts: pd.Series, kinds: pd.Series, canons: pd.Series, news: pd.Series) -> pd.DataFrame:
        out, n = [], []
        for t, ks, cs, ns in zip(texts, kinds, canons, news):
            if ks is None or t is None:
                out.append(t)
                n.append(0)
                continue
            new, parts, at, found = dict(zip(zip(ks, cs), ns)), [], 0, mentions(t)
            for a, b, kind, canon in found:
                parts += [t[at:a], written(kind, t[a:b], new[kind, canon])]
                at = b
            out.append("".join([*parts, t[at:]]))
            n.append(len(found))
        return pd.DataFrame({"text": out, "n": n})

    marked = docs.withColumns({k1: F.xxhash64(F.col(text)), k2: F.xxhash64(F.lit(7), F.col(text))})
    met = marked.join(lists, [k1, k2], "left").withColumn(name, F.when(F.col(kinds_in).isNotNull(), rewrite(F.col(text), kinds_in, canons_in, news_in)))
    changed = F.col(kinds_in).isNotNull()
    return met.select(*[F.when(changed, F.col(name)["text"]).otherwise(F.col(c)).alias(c) if c == text else F.col(c) for c in docs.columns], F.coalesce(F.when(changed, F.col(name)["n"]), F.lit(0)).cast("long").alias(count))
