"""Personal data in a text: where it stands, what it is, and surrogates of the same form."""

from __future__ import annotations

import bisect
import hashlib
import re
from dataclasses import dataclass

# Titles and common given names that give a person away, by gender.
TITLES = {
    "m": "Mr Mister Herr Herrn Monsieur M Señor Sr Don Signor господин κύριος κύριε",
    "f": "Mrs Ms Miss Frau Madame Mme Mlle Mademoiselle Señora Señorita Sra Doña Signora госпожа κυρία",
    "n": "Dr Prof Doctor Professor Mx",
}
GIVEN = {
    "m": "James John Robert Michael William David Richard Thomas Charles Daniel Peter Paul Mark George Hans Klaus "
    "Jürgen Wolfgang Stefan Pierre Jean Jacques François Carlos José Juan Luis Miguel Pedro Иван Дмитрий Сергей "
    "Алексей Николай Γιώργος Νίκος Δημήτρης",
    "f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Sarah Karen Anna Maria Julia Emma Laura Claudia "
    "Sabine Monika Ursula Marie Sophie Camille Isabelle Carmen Lucía Elena Ana Анна Мария Елена Ольга Наталья "
    "Μαρία Ελένη Κατερίνα",
}
_TITLE = {name: g for g, names in TITLES.items() for name in names.split()}
_GIVEN = {name: g for g, names in GIVEN.items() for name in names.split()}
_NAME = r"[^\W\d_a-zß-öø-ÿа-яё][^\W\d_]+(?:['’-][^\W\d_]+)*"
_PERSON = re.compile(
    rf"(?<!\w)(?:({'|'.join(sorted(_TITLE, key=len, reverse=True))})(?:\. ?| )({_NAME}(?: {_NAME}){{0,2}})"
    rf"|((?:{'|'.join(sorted(_GIVEN, key=len, reverse=True))})(?: {_NAME}){{1,2}}))(?!\w)"
)
_LOCAL = re.compile(r"[\w.%+\-]{1,64}\Z")
_DOMAIN = re.compile(r"[^\W_](?:[\w\-]*[^\W_])?(?:\.[^\W_](?:[\w\-]*[^\W_])?)*\.[^\W\d_]{2,}")
_NUMBERS = (
    ("ip", re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)")),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
    ("card", re.compile(r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])")),
    (
        "phone",
        re.compile(
            r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,5}(?:[ .-]?\d{2,5}){1,4}"
            r"|\(\d{2,5}\)[ .-]?\d{3,5}[ .-]?\d{3,5}|\d{3}[ .-]\d{3}[ .-]\d{4}|0\d{2,4}[ /-]\d{3,}(?:[ -]?\d{2,}){0,2})(?![\w])"
        ),
    ),
)
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_PREFIXED = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])|(?<!\w)(?:gh[pousr]_|sk-|pk_|xox[abpr]-)[\w-]{16,}")
_ASSIGNED = re.compile(r"\s*[=:]\s*[\"']?([^\s\"',;]{6,})")
_SECRET_NAME = re.compile(r"(?i)(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key|private[_-]?key)[\"']?\Z")
_KEPT_PREFIX = re.compile(r"AKIA|ASIA|gh[pousr]_|sk-|pk_|xox[abpr]-")


# What a text must hold before the patterns above are worth a try.
_NAME_WORDS = frozenset([*_TITLE, *_GIVEN])
_NAMES = frozenset(name.encode() for name in _NAME_WORDS)
_WORD = re.compile(r"\w+")
_SPLIT = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_DIGIT = re.compile(r"\d")


@dataclass(slots=True, order=True)
class Mention:
    start: int
    end: int
    kind: str  # email, phone, card, ssn, ip, iban, secret, given_m, given_f, given_n, surname
    canon: str  # the same for all mentions of one entity


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def find(text: str) -> list[Mention]:
    """Mentions in order, none overlapping; where two would, the earlier kind below wins."""
    found: list[Mention] = []
    at = text.find("@")
    while at >= 0:
        left, right = _LOCAL.search(text, max(0, at - 64), at), _DOMAIN.match(text, at + 1)
        if left and right:
            found.append(Mention(left.start(), right.end(), "email", text[left.start() : right.end()].lower()))
        at = text.find("@", at + 1)
    for sign in "=:":
        at = text.find(sign)
        while at >= 0:
            before = text[max(0, at - 24) : at].rstrip()
            value = _ASSIGNED.match(text, at) if _SECRET_NAME.search(before) else None
            if value:
                found.append(Mention(value.start(1), value.end(1), "secret", value[1]))
            at = text.find(sign, at + 1)
    found += [Mention(m.start(), m.end(), "secret", m[0]) for m in _PREFIXED.finditer(text)]
    if _DIGIT.search(text):
        found += _numbers(text)
    if _may_name(text):
        found += _people(text)
    return _settled(found)


def _may_name(text: str) -> bool:
    """Whether a title or given name stands as a word of its own, as every match of ``_PERSON`` needs."""
    if not _NAMES.isdisjoint(text.encode("utf-8", "replace").translate(_SPLIT).split()):
        return True
    # Quotes and dashes outside ASCII are not blanks to the bytes above.
    return not text.isascii() and not _NAME_WORDS.isdisjoint(_WORD.findall(text))


def _numbers(text: str) -> list[Mention]:
    found = []
    for m in _IBAN.finditer(text):
        plain = m[0].replace(" ", "")
        if _mod97(plain) == 1:
            found.append(Mention(m.start(), m.end(), "iban", plain))
    for kind, pattern in _NUMBERS:
        for m in pattern.finditer(text):
            digits = re.sub(r"\D", "", m[0])
            if kind == "ip" and any(int(o) > 255 for o in m[0].split(".")):
                continue
            if kind == "card" and not (luhn(digits) or len(digits) == 16 and digits[0] in "3456"):
                continue
            canon = m[0] if kind == "ip" else ("+" if m[0].startswith("+") else "") + digits
            found.append(Mention(m.start(), m.end(), kind, canon))
    return found


def _settled(found: list[Mention]) -> list[Mention]:
    starts: list[int] = []
    kept: list[Mention] = []
    for m in found:
        i = bisect.bisect_left(starts, m.start)
        if (i and kept[i - 1].end > m.start) or (i < len(kept) and kept[i].start < m.end):
            continue
        starts.insert(i, m.start)
        kept.insert(i, m)
    return kept


def _people(text: str) -> list[Mention]:
    """Names after a title or a known given name, and the same names wherever else they stand."""
    known: dict[str, str] = {}
    found = []
    for m in _PERSON.finditer(text):
        start = m.start(2) if m[1] else m.start(3)
        tokens = [(t.group(), start + t.start(), start + t.end()) for t in re.finditer(r"\S+", m[2] or m[3])]
        gender = _TITLE[m[1]] if m[1] else _GIVEN[tokens[0][0]]
        for i, (name, a, b) in enumerate(tokens):
            surname = i == len(tokens) - 1
            own = _GIVEN.get(name, gender)
            kind = "surname" if surname else f"given_{own}"
            known.setdefault(name, kind)
            found.append(Mention(a, b, known[name], name.casefold()))
    if known:
        again = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(known, key=len, reverse=True)))})(?!\w)")
        for m in again.finditer(text):
            found.append(Mention(m.start(), m.end(), known[m[0]], m[0].casefold()))
    return found


class _Draws:
    """Numbers below given bounds from a keyed hash of the entity and the attempt."""

    def __init__(self, key: bytes, *parts: object):
        self.key, self.seed, self.pool, self.round = key, "\x00".join(map(str, parts)).encode(), 0, 0

    def below(self, bound: int) -> int:
        if self.pool < 1 << 128:
            data = self.seed + self.round.to_bytes(4, "big")
            self.pool = int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=64).digest(), "big")
            self.round += 1
        self.pool, value = divmod(self.pool, bound)
        return value

    def like(self, text: str, hexadecimal: bool = False) -> str:
        """A string of the same shape: digits for digits, letters for letters of the same case."""
        out = []
        for c in text:
            if hexadecimal and c in "0123456789abcdef":
                out.append("0123456789abcdef"[self.below(16)])
            elif c.isdigit():
                out.append(str(self.below(10)))
            elif c.isalpha():
                first, count = (0x430, 32) if "а" <= c.lower() <= "я" else (0x3B1, 17) if "α" <= c.lower() <= "ω" else (97, 26)
                letter = chr(first + self.below(count))
                out.append(letter.upper() if c.isupper() else letter)
            else:
                out.append(c)
        return "".join(out)


# Syllables of invented names by script, and endings by gender.
_SYLLABLES = {
    "latin": "ba be bri ca ce da de do el fa fe ga ha jo ka ke la le li lo ma me mi na ne no ra re ri ro sa se ta te ti va ve vi".split(),
    "cyrillic": "ба ве га да де за ка ко ла ле ма ми на не ни по ра ре ро са се та те фи ва".split(),
    "greek": "βα γα δα δη θε κα κο λα λε μα με να νι πα πε ρα ρο σα στε τα φι χα".split(),
}
_ENDINGS = {
    "latin": {"m": ["n", "s", "rt", "d", "k"], "f": ["na", "lia", "ne", "tta", "ra"], "n": ["ri", "lin", "x"], "s": ["mer", "son", "tin", "berg", "ley", "dor"]},
    "cyrillic": {"m": ["ий", "н", "р"], "f": ["на", "ия", "ра"], "n": ["ша", "ня"], "s": ["ко", "вич", "мин", "дзе"]},
    "greek": {"m": ["ος", "ης", "ας"], "f": ["α", "η", "ινα"], "n": ["ι"], "s": ["ίδου", "άκη", "πουλο"]},
}


def script(text: str) -> str:
    for c in text.lower():
        if "Ѐ" <= c <= "ԯ":
            return "cyrillic"
        if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿":
            return "greek"
    return "latin"


def surrogate(kind: str, canon: str, attempt: int, key: bytes) -> str:
    """A made-up canonical value of the same type, script and form; another for each attempt.

    From the sixteenth attempt on it is one character longer, so values cannot run out.
    """
    draw = _Draws(key, kind, canon, attempt)
    more = "" if attempt < 16 else draw.like("0" * (1 + attempt // 32))
    if kind == "email":
        local, _, domain = canon.rpartition("@")
        labels = domain.split(".")
        keep = 2 if labels[-2] in ("example",) else 0
        own = _Draws(key, "domain", domain)
        body = [own.like(label) for label in (labels[:-keep] if keep else labels[:-1])]
        return f"{draw.like(local)}{more}@{'.'.join([*body, *(labels[-2:] if keep else ['example'])])}"
    if kind == "ip":
        parts = [10 if attempt < 8 else 240 + draw.below(16), *(draw.below(256) for _ in range(3))]
        return ".".join(map(str, parts))
    if kind == "phone":
        keep = 0 if canon[0] != "+" else 2 if canon[1] in "17" else 3
        rest = draw.like(canon[keep:] + more)
        return canon[:keep] + str(2 + draw.below(8)) + rest[1:]
    if kind == "card":
        body = canon[0] + draw.like(canon[1:-1] + more)
        check = next(d for d in "0123456789" if luhn(body + d))
        return body + (check if luhn(canon) else str(draw.below(10)))
    if kind == "ssn":
        return "9" + draw.like(canon[1:] + more)
    if kind == "iban":
        body = canon[:2] + "00" + draw.like(canon[4:] + more)
        return f"{canon[:2]}{98 - _mod97(body):02d}{body[4:]}"
    if kind == "secret":
        prefix = m[0] if (m := _KEPT_PREFIX.match(canon)) else ""
        rest = canon[len(prefix) :]
        return prefix + draw.like(rest, bool(re.fullmatch(r"[0-9a-f]+", rest))) + more
    style = script(canon)
    syllables, gender = _SYLLABLES[style], "s" if kind == "surname" else kind[-1]
    count = 2 + attempt // 4 + draw.below(2)
    stem = "".join(syllables[draw.below(len(syllables))] for _ in range(count))
    return stem + (endings := _ENDINGS[style][gender])[draw.below(len(endings))]


def shaped(surface: str, kind: str, value: str) -> str:
    """``value`` in the spelling of ``surface``: its separators and capitals."""
    if kind in ("phone", "card", "ssn", "iban"):
        rest = iter(value.lstrip("+"))
        out = "".join(next(rest, "") if c.isalnum() else c for c in surface)
        return out + "".join(rest)
    letters = [c for c in surface if c.isalpha()]
    if kind == "email":
        return value.upper() if letters and all(c.isupper() for c in letters) else value
    if kind == "surname" or kind.startswith("given"):
        return value.upper() if len(letters) > 1 and all(c.isupper() for c in letters) else value.capitalize()
    return value
