"""Personal data and secrets, replaced by surrogates.

A surrogate has its entity's type and format: digits stay digits, small letters
small, check digits right or wrong as they were; names keep gender and script.
What is made of characters goes through a keyed permutation of all strings of
its format that leaves none in its place. Names are numbered, the numbers of one
size permuted and spelled in syllables, so that there is a name for every name.
Both depend on the secret and the entity alone: one entity has the same surrogate
in all documents, two entities never share one. In each document surrogates are
also checked against each other and against its own entities; only one that
meets such a string moves on, to the next in the permutation's cycle.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from papyra.llm.common import map_batches, out

#: Given names whose gender is known without a title (fixed values).
GIVEN = {
    ("latin", "f"): ("Anna", "Clara", "Elena", "Emma", "Ida", "Julia", "Laura", "Lena", "Lucia", "Maria", "Nora", "Paula", "Rosa", "Sara", "Sofia", "Vera"),
    ("latin", "m"): ("Adam", "Bruno", "Carl", "Daniel", "David", "Emil", "Felix", "Hugo", "Jonas", "Leo", "Lukas", "Marco", "Oscar", "Paul", "Simon", "Victor"),
    ("latin", "n"): ("Alex", "Andrea", "Charlie", "Chris", "Dominique", "Jordan", "Kim", "Luca", "Maxime", "Nicola", "Noa", "Robin", "Sam", "Sascha", "Toni", "Yael"),
    ("cyrillic", "f"): ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Ольга", "София"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Иван", "Максим", "Олег", "Павел", "Сергей"),
    ("cyrillic", "n"): ("Валя", "Женя", "Саша", "Слава", "Шура", "Юля", "Тоня", "Миша"),
    ("greek", "f"): ("Άννα", "Ελένη", "Ειρήνη", "Κατερίνα", "Μαρία", "Σοφία"),
    ("greek", "m"): ("Αλέξης", "Γιάννης", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος"),
    ("greek", "n"): ("Άλεξ", "Νίκη", "Τόνι", "Κίμων", "Μάριον", "Φώτης"),
}
#: Titles before a name and the gender they tell.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "n", "Prof": "n", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Don": "m", "Doña": "f", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f", "السيد": "m", "السيدة": "f", "מר": "m", "גברת": "f", "श्री": "m", "श्रीमती": "f"}
#: What else comes before a name (fixed values).
CUES = ("my name is", "My name is", "je m'appelle", "Je m'appelle", "mein Name ist", "Mein Name ist", "me llamo", "Me llamo")


def _letters(category: str) -> str:
    """Letters with case of Latin, Greek and Cyrillic."""
    return "".join(c for c in map(chr, range(0x41, 0x530)) if unicodedata.category(c) == category)


_UPPER, _LOWER = _letters("Lu"), _letters("Ll")
_CASED = rf"[{_UPPER}](?:[{_LOWER}]|[-'’](?=[{_UPPER}{_LOWER}])|[{_UPPER}](?=[{_LOWER}]))+"
#: Between the parts of a name: hyphens, apostrophes and inner capitals.
_INNER = re.compile(rf"([-'’]|(?<=[{_LOWER}])(?=[{_UPPER}]))")
#: Small words inside of names, which stay, and academic titles after a title (fixed values).
PARTICLES = ("von", "vom", "van", "der", "den", "dem", "de", "del", "della", "di", "da", "das", "do", "dos", "du", "des", "la", "las", "le", "los", "el", "al", "bin", "bint", "ibn", "ben", "zu", "zum", "zur", "ter", "ten", "y", "e", "af", "av")
DEGREES = ("Dr", "Prof", "Ing", "Dipl", "Mag", "med", "phil", "rer", "nat", "jur", "dent", "vet", "habil", "h.c")
#: Between the words of a name; after a title a line may end as well.
_BLANK = r"[ \t\u00a0\u2000-\u200a\u202f\u3000]"
_BREAK = rf"(?:{_BLANK}+(?:\r?\n{_BLANK}*)?|\r?\n{_BLANK}*)"
_NAME = rf"(?:{_CASED}|[{_UPPER}](?:[-'’]?[{_UPPER}])+(?![{_LOWER}])|[\u0620-\u064a]{{2,}}|[\u05d0-\u05ea]{{2,}}|[\u0900-\u0963\u0971-\u097f]{{2,}})"
_FULL = rf"(?:(?:{'|'.join(PARTICLES)}){_BLANK}+)*{_NAME}"
#: Kind and pattern; where several begin at one place the first wins. The group v, if there is one, is what is replaced.
PATTERNS = (
    ("pem", r"-----BEGIN (?P<begun>(?:[A-Z0-9]+ )*PRIVATE KEY)-----(?P<v8>(?:[^-]|-(?!----))+)-----END (?P=begun)-----"),
    ("jwt", r"(?<![\w-])eyJ[\w-]+\.[\w-]+\.[\w-]*"),
    ("email", r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+"),
    ("key", r"(?<![A-Z0-9])(?:AKIA|ASIA)(?P<v1>[A-Z0-9]{16})(?![A-Z0-9])"),
    ("key", r"(?<![A-Za-z0-9])(?:gh[pousr]_|sk-|xox[abp]-)(?P<v2>[A-Za-z0-9_-]{16,})"),
    ("secret", r"(?i:(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key))[\"']?[ \t]*+\s{0,3}+[ \t]*+[=:][ \t]*+\s{0,3}+[ \t]*+(?:\"(?P<v6>[^\"\n]+)\"|'(?P<v7>[^'\n]+)'|[\"']?(?P<v3>[\w+/\-.!@#$%^&*~?=|:]+))"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"),
    ("ip6", r"(?<![\w:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f:]*\d)(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?)(?![\w:])"),
    ("mac", r"(?<![\w:-])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![\w:-])"),
    ("iban", r"(?<!\w)(?P<v4>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("card", r"(?<![\d.-])(?:\d[ -]?){12,18}\d(?![\d-])"),
    ("phone", r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)|(?<![\w+])\+\d{1,3}[ .-]?(?:\(0\)[ .-]?)?\d{1,5}(?:[ ./-]?\d{2,8}){1,5}(?!\w)|(?<![\w+.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?!\w)|(?<![\w+.,-])0\d(?:[ .-]\d{2}){4}(?![\w-]|[.,]\d)|(?<![\w+.,-])0\d{1,4}[ /-]\d{5,8}(?![\w-]|[.,]\d)"),
    ("name", rf"(?<!\w)(?P<title>{'|'.join(sorted((*TITLES, *CUES), key=len, reverse=True))})(?:\.{_BREAK}?|{_BREAK})(?:(?:{'|'.join(map(re.escape, DEGREES))})(?:\.{_BREAK}?|{_BREAK}))*(?P<v5>{_FULL}(?:{_BLANK}+{_FULL})*)"),
)
_ALL = re.compile("|".join(f"(?P<k{i}>{p})" for i, (_, p) in enumerate(PATTERNS)))
_VALUES = ("v1", "v2", "v3", "v4", "v5", "v6", "v7", "v8")
#: A text without digit, at sign, sign of assignment, beginning of a key, title or six pairs of letters with hyphens has nothing to find.
_MAYBE = re.compile(r"[\d@=:]|eyJ|-----BEGIN|AKIA|ASIA|gh[pousr]_|sk-|xox[abp]-|\b(?:" + "|".join((*TITLES, *CUES)) + r")\b|श्री|(?:[A-Fa-f]{2}-){5}[A-Fa-f]{2}")


def digest(key: bytes, *parts: str | bytes, bits: int = 256) -> int:
    sponge = hashlib.shake_256(key)
    for part in parts:
        part = part if isinstance(part, bytes) else part.encode("utf-8", "surrogatepass")
        sponge.update(len(part).to_bytes(8, "big") + part)
    return int.from_bytes(sponge.digest((bits + 7) // 8), "big")


def _half(size: int) -> int:
    return max(1, ((size - 1).bit_length() + 1) // 2)


def _round(key: bytes, tweak: str, turn: int, half: int, right: int) -> int:
    return digest(key, tweak, str(turn), right.to_bytes(half // 8 + 1, "big"), bits=half) & ((1 << half) - 1)


def permuted(key: bytes, tweak: str, value: int, size: int, back: bool = False) -> int:
    """A keyed permutation of range(size), or its inverse: a Feistel network over the next even number of bits, walked until inside."""
    if size < 2:
        return value
    half = _half(size)
    while True:
        left, right = value >> half, value & ((1 << half) - 1)
        for turn in range(7, -1, -1) if back else range(8):
            if back:
                left, right = right ^ _round(key, tweak, turn, half, left), left
            else:
                left, right = right, left ^ _round(key, tweak, turn, half, right)
        value = left << half | right
        if value < size:
            return value


def moved(key: bytes, tweak: str, value: int, size: int, steps: int = 1) -> int:
    """steps further in a keyed cycle through all of range(size): another value for 0 < steps < size, another for each of them."""
    return permuted(key, tweak, (permuted(key, tweak, value, size) + steps) % max(size, 1), size, back=True)


_CLASSES = (
    ("0123456789", "d"), ("abcdefghijklmnopqrstuvwxyz", "l"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "u"),
    ("абвгдежзийклмнопрстуфхцчшщъыьэюяё", "cyrillic l"), ("АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁ", "cyrillic u"),
    ("αβγδεζηθικλμνξοπρστυφχψω", "greek l"), ("ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "greek u"),
)
_OF = {c: (letters, name) for letters, name in _CLASSES for c in letters}


@lru_cache(maxsize=1 << 16)
def _class(c: str) -> tuple[str, str]:
    """The characters that c is permuted among, and their name: digits of a script, or letters of a kind in a block of 128; none for other characters."""
    if c in _OF or c < "\x80":
        return _OF.get(c, ("", c))
    kind = unicodedata.category(c)
    if kind == "Nd":
        zero = ord(c) - unicodedata.decimal(c)
        return "".join(map(chr, range(zero, zero + 10))), f"d {zero}"
    if kind[0] != "L":
        return "", c
    block = ord(c) & ~127
    return "".join(x for x in map(chr, range(block, block + 128)) if x not in _OF and unicodedata.category(x) == kind), f"{kind} {block}"


#: Characters that are permuted together; a longer string goes piece by piece, each in the light of the one before.
PIECE = 64


def same_format(key: bytes, kind: str, text: str, steps: int = 1) -> str:
    """Another string with the same classes of characters in the same places; a permutation of all that have them. Other characters stay."""
    pieces = [text[i : i + PIECE] for i in range(0, len(text), PIECE)]
    return "".join(_same_format(key, f"{kind}/{before}", piece, steps) for before, piece in zip(["", *pieces], pieces, strict=False))


def _same_format(key: bytes, tweak: str, text: str, steps: int) -> str:
    value, size, form = 0, 1, []
    for c in text:
        letters, name = _class(c)
        form.append(name)
        if letters:
            value = value * len(letters) + letters.index(c)
            size *= len(letters)
    value = moved(key, f"{tweak}/{''.join(form)}", value, size, steps)
    made = []
    for c in reversed(text):
        letters = _class(c)[0]
        if letters:
            value, at = divmod(value, len(letters))
            c = letters[at]
        made.append(c)
    return "".join(reversed(made))


def formats(text: str) -> int:
    """How many strings have the format of the first permutable piece of the text, as far as a document could use them up."""
    size = 1
    for c in text:
        size *= max(1, len(_class(c)[0]))
        if size > 1 << 40:
            break
    return size


def luhn(digits: str) -> int:
    """The check sum modulo 10; 0 for a right number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def iban_check(country: str, account: str) -> str:
    """The right check digits of an account number."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


#: Consonants and vowels of the syllables that names are spelled in, an accented vowel for each, and the endings of women's and men's given names, by script (fixed values).
SYLLABLES = {
    "latin": ("bcdfghjklmnprstvwyzq", "aeiou", "áéíóú", "lla", "n"),
    "cyrillic": ("бвгджзклмнпрстфхцчш", "аеиоу", "аеиоу", "лла", "н"),
    "greek": ("βγδζθκλμνξπρστφχψ", "αεηιουω", "αεηιουω", "λλα", "ς"),
}
#: Small letters that the names of a script are numbered by; plain Latin names are numbered apart from others.
ALPHABETS = {
    "plain": "abcdefghijklmnopqrstuvwxyz",
    "latin": "".join(c for c in _LOWER if c < "\u0250"),
    "greek": "".join(c for c in _LOWER if "\u0370" <= c < "\u0400"),
    "cyrillic": "".join(c for c in _LOWER if c >= "\u0400"),
}
KNOWN_GENDER = {name: gender for (_, gender), names in GIVEN.items() for name in names}


def script(name: str) -> str:
    c = ord(next((c for c in name if c.isalpha()), "a"))
    return "cyrillic" if 0x400 <= c < 0x530 else "greek" if 0x370 <= c < 0x400 else "latin"


def name_part(key: bytes, part: str) -> str:
    """A name for a name without hyphens: its number among all strings of its alphabet, permuted among those of its size, in as many syllables; longer than the name itself. In other scripts a string of the same format."""
    low, kind = part.lower(), script(part)
    letters = ALPHABETS["plain" if low.isascii() else kind]
    if not all(c in letters for c in low):
        return same_format(key, "name", part)
    number = 0
    for c in low:
        number = number * len(letters) + letters.index(c) + 1
    consonants, vowels, accented, _, _ = SYLLABLES[kind]
    base, syllables, number = len(consonants) * len(vowels), 2, number - 1
    while number >= base**syllables:
        number -= base**syllables
        syllables += 1
    number = permuted(key, f"name/{len(letters)}/{syllables}", number, base**syllables)
    made = []
    for place in range(syllables):
        number, at = divmod(number, base)
        made.append(consonants[at // len(vowels)] + (accented if place == 0 and not low.isascii() else vowels)[at % len(vowels)])
    found = "".join(made)
    return found.capitalize() if part[0] != low[0] else found


def name_surrogate(key: bytes, name: str, gender: str = "n", steps: int = 0) -> str:
    """A name of the same script for each part between hyphens, apostrophes and inner capitals; its end tells the gender, if there is one. Steps that avoid a name are a further syllable after a hyphen."""
    if len(name) > 1 and name.isupper():
        return name_surrogate(key, name.capitalize(), gender, steps).upper()
    parts = _INNER.split(name)
    made = "".join(p if i % 2 else name_part(key, p) for i, p in enumerate(parts))
    consonants, vowels, _, woman, man = SYLLABLES[script(name)]
    if name[0].upper() != name[0].lower():
        made += {"f": woman, "m": man}.get(gender, "")
    while steps:
        steps, at = divmod(steps - 1, len(consonants) * len(vowels))
        made += f"-{consonants[at // len(vowels)].upper()}{vowels[at % len(vowels)]}"
    return made


def surrogate(key: bytes, kind: str, value: str, steps: int = 1) -> str:
    """The string steps after value in the cycle of its format."""
    if kind == "email":
        local, _, domain = value.partition("@")
        labels, _, top = domain.rpartition(".")
        own = formats(local) > 1
        return f"{same_format(key, 'local', local, steps)}@{same_format(key, 'domain', labels, 1 if own else steps)}.{top}"
    if kind == "ip":
        number = 0
        for part in value.split("."):
            number = number << 8 | int(part)
        number = moved(key, "ip", number, 1 << 32, steps)
        made = ".".join(str(number >> s & 255) for s in (24, 16, 8, 0))
        other = next((c for c in value if c.isdecimal() and c > "9"), "0")
        return made.translate(str.maketrans("0123456789", _class(other)[0]))
    if kind in ("ip6", "mac"):
        digits = re.sub(r"[^0-9A-Fa-f]", "", value)
        number = moved(key, f"{kind}/{len(digits)}", int(digits, 16), 16 ** len(digits), steps)
        made = iter(f"{number:0{len(digits)}x}")
        upper = value.upper() == value
        return "".join((d.upper() if upper else d) if c not in ":-" and (d := next(made)) else c for c in value)
    if kind == "card":
        places = [i for i, c in enumerate(value) if c.isdigit()]
        digits = "".join(value[i] for i in places)
        head = same_format(key, "card", digits[:-1], steps)
        wrong = luhn(digits)
        last = next(c for c in _class(digits[-1])[0] if luhn(head + c) == wrong)
        made = list(value)
        for i, c in zip(places, head + last, strict=True):
            made[i] = c
        return "".join(made)
    if kind == "iban":
        country, check, account = value[:2], "".join(str(int(c)) for c in value[2:4]), value[4:]
        new = same_format(key, "iban", account, steps)
        right, new_right = (iban_check(country, a.replace(" ", "")) for a in (account, new))
        return f"{country}{new_right if check == right else right if check == new_right else check}{new}"
    if kind == "phone":
        country = re.match(r"\+\d{1,3}(?=[ .(-])|\+\d", value)
        at = country.end() if country else 0
        return value[:at] + same_format(key, "phone", value[at:], steps)
    return same_format(key, kind, value, steps)


class Document:
    """Surrogates of one document, distinct from each other and from its entities."""

    def __init__(self, key: bytes):
        self.key, self.known, self.taken, self.masks = key, {}, set(), 0

    def reserve(self, values) -> None:
        self.taken.update(values)

    def of(self, kind: str, value: str, gender: str = "n") -> str:
        found = self.known.get((kind, value))
        if found is None:
            found = self._name(value, gender if kind == "given" else "n") if kind in ("given", "family") else self._string(kind, value)
            self.known[kind, value] = found
            self.taken.add(found)
        return found

    def _name(self, value: str, gender: str) -> str:
        known, steps = KNOWN_GENDER.get(value, "n"), 0
        while (found := name_surrogate(self.key, value, gender if known == "n" else known, steps)) in self.taken:
            steps += 1
        return found

    def _string(self, kind: str, value: str) -> str:
        """The first free string of the format after this one in its cycle; a numbered mask where the format has no other."""
        for steps in range(1, formats(value)):
            found = surrogate(self.key, kind, value, steps)
            if found not in self.taken:
                return found
            if steps > len(self.taken):
                break  # some piece of the string has run through its cycle
        self.masks += 1
        while f"[{kind}-{self.masks}]" in self.taken:
            self.masks += 1
        return f"[{kind}-{self.masks}]"


_SPOKEN = re.compile(r"\S+")


def _names(value: str) -> list[str]:
    """The words of a name but its particles."""
    return [n for n in _SPOKEN.findall(value) if n not in PARTICLES]


_WORD, _PIECE = re.compile(r"\w+(?:[-'’]\w+)*"), re.compile(r"[-'’]")


def _later_mentions(text: str, parts, found: list[tuple]) -> list[tuple]:
    """Places where one of the names stands alone, outside of what is found already."""
    starts, ends = [f[0] for f in found], [f[1] for f in found]
    more = []

    def free(a: int) -> bool:
        i = bisect_right(starts, a) - 1
        return i < 0 or ends[i] <= a

    for m in _WORD.finditer(text):
        cuts = [m.start(), *(m.start() + x.end() for x in _PIECE.finditer(m.group())), m.end() + 1]
        i = 0
        while i < len(cuts) - 1:
            for j in range(len(cuts) - 1, i, -1):
                if text[cuts[i] : cuts[j] - 1] in parts and free(cuts[i]):
                    more.append((cuts[i], cuts[j] - 1, "name", text[cuts[i] : cuts[j] - 1], "n"))
                    i = j - 1
                    break
            i += 1
    return more


def replaced(text: str, key: bytes) -> tuple[str, dict[str, int]]:
    """The text with surrogates, and how many mentions of each kind were replaced."""
    counts: dict[str, int] = {}
    if not _MAYBE.search(text):
        return text, counts
    found = []
    for m in _ALL.finditer(text):
        kind = PATTERNS[int(next(k for k, v in m.groupdict().items() if k[0] == "k" and v is not None)[1:])][0]
        if kind == "phone" and sum(map(str.isdigit, m.group())) < 7:
            continue
        group = next((v for v in _VALUES if m[v] is not None), 0)
        found.append((m.start(group), m.end(group), kind, m[group], TITLES.get(m["title"] or "", "n")))
    if not found:
        return text, counts
    made = Document(key)
    made.reserve(part for f in found for part in ([f[3]] if f[2] != "name" else _names(f[3])))
    parts: dict[str, tuple[str, str]] = {}  # of names: given if any mention says so, and the gender that one tells
    for _, _, kind, value, gender in found:
        if kind == "name":
            names = _names(value)
            for i, name in enumerate(names):
                known = "given" if i < len(names) - 1 or name in KNOWN_GENDER else "family", gender
                for form in {name, name.capitalize()} if name.isupper() and len(name) > 1 else (name,):
                    parts[form] = max(parts.get(form, known), known, key=lambda x: (x[0] == "given", x[1] != "n"))
    if parts:
        found = sorted([*found, *_later_mentions(text, parts, found)])
    pieces, end = [], 0
    for a, b, kind, value, _ in found:
        new = _SPOKEN.sub(lambda m: m[0] if m[0] in PARTICLES else made.of(parts[m[0]][0], m[0], parts[m[0]][1]), value) if kind == "name" else made.of(kind, value)
        pieces += [text[end:a], new]
        end = b
        counts[kind] = counts.get(kind, 0) + 1
    return "".join([*pieces, text[end:]]), counts


@lru_cache(maxsize=8)
def _key(secret: str) -> bytes:
    return hashlib.sha256(secret.encode()).digest()


def pseudonymise(df: DataFrame, secret: str, text: str = "text", counts: str | None = None) -> DataFrame:
    """df with the text column replaced, in all its columns and order; counts names a further column, if wanted, of mentions by kind like card:1,email:2.

    secret keys the surrogates; whoever has it can undo those of strings, so it
    must be given and be kept like the data. Nulls stay null and empty texts
    empty. Texts are read whole, whatever their length; repeated rows stay and
    come out alike; an empty table gives an empty one; other columns pass
    unchanged, but one named like counts gives way to it. Nothing is shuffled.
    """
    if not secret:
        raise ValueError("a secret is needed to key the surrogates")
    df = df.drop(counts) if counts else df
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    names, at = df.columns, df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = _key(secret)
        for batch in batches:
            new, found = [], []
            for value in batch.column(at):
                old = value.as_py()
                made, n = replaced(old, key) if old else (old, {})
                new.append(made)
                found.append(",".join(f"{k}:{v}" for k, v in sorted(n.items())))
            columns = [*batch.columns]
            columns[at] = pa.array(new, pa.string())
            yield out([*names, *[counts] * bool(counts)], [*columns, *[pa.array(found, pa.string())] * bool(counts)])

    return map_batches(df, run, schema + f", `{counts}` string" * bool(counts))
