"""Personal data replaced by keyed surrogates of the same type, gender, script and format.

Detected are e-mail and network addresses, telephone, card, account and identity numbers, and names of
persons (a title or a known given name, also in capitals, with all capitalised words of any script after it, after a
title also words of scripts without case, and these words wherever else the text has them, so that no bare mention
stays). Every replacement is a
keyed permutation of the values of one form, so two different values never get the same surrogate and
one value always gets the same one, in every document and in any partition, without any shared table:

* digits and letters: a Feistel network over mixed radices, one radix for each place's character
  class, conjugated with a rotation, so that no value stays as it is. Separators, case, lengths, telephone
  country codes, a private network's block, an e-mail's last domain label, card check digits
  (valid stays valid) and account check digits keep their form;
* known given names: a keyed rotation within the names of the same gender and script;
* other names: the same network over the vowels and consonants of the script, so they can be spoken, other letters over
  those of their script and block; endings that tell the gender of a surname stay, so its two forms keep their stem.

Values are normalised before that (case of addresses, separators of numbers, national part of telephone
numbers), and name words are replaced one by one, so that forms of one identity go together.

``collisions`` checks this over the corpus: surrogates that several originals share within a type.
``replace`` runs it first and gives originals that would collide another tweak until none is left.

Defined results: a null text stays null, an empty one empty; text without personal data is unchanged.
Other columns are kept. Repeated rows give repeated results.
"""

from __future__ import annotations

import hmac
import re
import unicodedata
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._session import ship

# Given names by script and gender, and titles by the gender they tell.
GIVEN = {
    ("latin", "f"): "Anna Maria Elena Laura Julia Sarah Emma Sophie Claire Marie Isabel Carmen Lucia Ingrid Petra Heike Alice Grace Nora Olivia Rachel Susan Karen Linda".split(),
    ("latin", "m"): "Peter Paul John James David Michael Thomas Robert Daniel Carlos Miguel Javier Pierre Louis Henri Klaus Stefan Jens Oliver Simon Walter George Brian Kevin".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Татьяна Наталья Ирина Светлана Юлия Дарья".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Дмитрий Алексей Андрей Михаил Николай Павел Олег".split(),
    ("greek", "f"): "Μαρία Ελένη Αικατερίνη Σοφία Άννα Γεωργία Δήμητρα Ιωάννα".split(),
    ("greek", "m"): "Γιώργος Νίκος Δημήτρης Κώστας Παναγιώτης Βασίλης Χρήστος Αντώνης".split(),
}
TITLES = {"Mr": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Sra": "f", "Dr": "", "Prof": ""}
# Letters that may stand for one another in a made-up name, by script.
LETTERS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóúàèìòùâêîôûäëïöü", "ñçßøåæœ", "аеиоуыэюя", "бвгдзклмнпрстфхцчшщж", "ёй", "ьъ", "αειουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώη", "ς")

# Endings of surnames for men and for women.
ENDINGS = (("ский", "ская"), ("цкий", "цкая"), ("ов", "ова"), ("ев", "ева"), ("ёв", "ёва"), ("ин", "ина"), ("ski", "ska"), ("cki", "cka"), ("ský", "ská"))

_ENDINGS = sorted({e for pair in ENDINGS for e in pair}, key=len, reverse=True)
_GIVEN = {n: g for g, names in GIVEN.items() for n in names}
_HAN = "".join(map(chr, range(0x4E00, 0x9C20)))
_PLACE = {c: (k, i) for k, row in enumerate(LETTERS) for i, c in enumerate(row)}
_ROUNDS = 8

_AT = r"[\w.%+-]*+(?<=[\w%+-])@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
_EMAIL, _EMAIL_HERE = re.compile(r"(?<![\w.%+-])" + _AT), re.compile(_AT)
_FIRST = re.compile("[A-Za-z0-9]")
_IP6 = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])")
_IP4 = re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
_CARD = re.compile(r"(?<![\d])\d(?:[ -]?\d){12,18}(?!\d)")
_PHONE = re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?![\d])")
_LOCAL = re.compile(r"\d{3}[ .-]\d{4}")
_DATE = re.compile(r"(?:\d{4}[-. ]\d{1,2}[-. ]\d{1,2}|\d{1,2}[-. ]\d{1,2}[-. ]\d{4})(?!\d)")
_LONG = re.compile(r"(?<![A-Za-z0-9])\d{9,}(?![A-Za-z0-9])")
_CAPITALISED = regex.compile(r"[\p{Lu}\p{Lt}][\p{L}\p{M}]+")
_CASELESS = regex.compile(r"\p{Lo}[\p{Lo}\p{M}]*")
_INSIDE = re.compile(r"\w")
_AFTER = regex.compile(r"\.? (?=[\p{Lu}\p{Lt}])")
_AFTER_TITLE = regex.compile(r"\.? ?(?=\p{Lo})")


@lru_cache(maxsize=10_000)
def _alike(c: str) -> str:
    """The letters that may stand for a lower-case letter or one without case: of the tables, else of its script in its block of 256 (Han: of the first 20,000)."""
    if c in _PLACE:
        return LETTERS[_PLACE[c][0]]
    if "\u4e00" <= c < "\u9c20":
        return _HAN
    script, kind = unicodedata.name(c, "").split(" ")[0], unicodedata.category(c)
    if kind[0] != "L":
        return c
    block = ord(c) & ~0xFF
    near = [x for x in map(chr, range(block, block + 256)) if unicodedata.category(x) == kind and unicodedata.name(x, "").startswith(script) and (x in _PLACE) == (c in _PLACE)]
    return "".join(x for x in near if len(x.upper()) == 1 and x.upper().lower() == x) if c.upper() != c else "".join(near)


class Keyed:
    """Permutations under one secret key."""

    def __init__(self, key: bytes) -> None:
        self.key = key
        self.value = lru_cache(maxsize=50_000)(self._value)

    def _number(self, tweak: str, turn: int, x: int) -> int:
        said = f"{tweak}|{turn}|{x}".encode("utf-8", "surrogatepass")
        return int.from_bytes(blake2b(said, key=self.key[:64], digest_size=24).digest(), "big")

    def _network(self, tweak: str, v: int, left: int, right: int, back: bool) -> int:
        a, b = divmod(v, right)
        for turn in reversed(range(_ROUNDS)) if back else range(_ROUNDS):
            sign = -1 if back else 1
            if turn % 2:
                b = (b + sign * self._number(tweak, turn, a)) % right
            else:
                a = (a + sign * self._number(tweak, turn, b)) % left
        return a * right + b

    def permuted(self, tweak: str, places: list[int], radices: list[int]) -> list[int]:
        """Another value of the same radices: a permutation without fixed points (but where there is one value only)."""
        if not radices:
            return []
        half = len(radices) // 2
        left = right = 1
        for r in radices[:half]:
            left *= r
        for r in radices[half:]:
            right *= r
        total, v = left * right, 0
        if total == 1:
            return places
        for p, r in zip(places, radices):
            v = v * r + p
        said = f"{tweak}|{','.join(map(str, radices))}"
        v = self._network(said, v, left, right, False)
        v = (v + 1 + self._number(said, -1, 0) % (total - 1)) % total
        v = self._network(said, v, left, right, True)
        out = []
        for r in reversed(radices):
            v, p = divmod(v, r)
            out.append(p)
        return out[::-1]

    def characters(self, tweak: str, value: str) -> str:
        """Digits, lower- and upper-case ASCII letters replaced within their class; the rest stays."""
        kinds = [(10, 48) if "0" <= c <= "9" else (26, 97) if "a" <= c <= "z" else (26, 65) if "A" <= c <= "Z" else None for c in value]
        got = iter(self.permuted(tweak, [ord(c) - k[1] for c, k in zip(value, kinds) if k], [k[0] for k in kinds if k]))
        return "".join(chr(next(got) + k[1]) if k else c for c, k in zip(value, kinds))

    def digits(self, tweak: str, value: str) -> str:
        """Digits only; a leading digit other than 0 stays other than 0."""
        if not value:
            return value
        first = value[0] != "0"
        got = self.permuted(tweak + ("1" if first else "0"), [int(value[0]) - 1 if first else 0, *map(int, value[1:])], [9 if first else 1, *[10] * (len(value) - 1)])
        return str(got[0] + first) + "".join(map(str, got[1:]))

    def word(self, tweak: str, value: str) -> str:
        """A name's word: vowels, consonants and marked letters of its script replaced within their class, case kept."""
        low = value.lower()
        if len(low) != len(value):
            return value
        ending = next((e for e in _ENDINGS if low.endswith(e) and len(low) > len(e) + 1), "")
        stem = low[: len(low) - len(ending)]
        sets = [_alike(c) for c in stem]
        # letters that their set lacks, as ones without a simple capital, stay
        free = [i for i, (c, row) in enumerate(zip(stem, sets)) if len(row) > 1 and c in row]
        got = self.permuted(tweak, [sets[i].index(stem[i]) for i in free], [len(sets[i]) for i in free])
        out = list(low)
        for i, place in zip(free, got):
            out[i] = sets[i][place]
        return "".join(c.upper() if o.isupper() and len(c.upper()) == 1 else c for c, o in zip(out, value))

    def given(self, tweak: str, value: str) -> str:
        names = GIVEN[_GIVEN[value]]
        order = sorted(names, key=lambda n: self._number(tweak, 0, int.from_bytes(n.encode(), "big")))
        return order[(order.index(value) + 1) % len(order)]

    def _value(self, kind: str, norm: str, tweak: int) -> str:
        """The surrogate of a normalised value."""
        t = f"{kind}#{tweak}"
        if kind == "email":
            local, _, domain = norm.partition("@")
            labels, _, last = domain.rpartition(".")
            return f"{self.characters(t + 'l', local)}@{self.characters(f'{kind}#d', labels)}.{last}"
        if kind == "ip4":
            return self._ip4(t, norm)
        if kind == "ip6":
            return ":".join(f"{x:x}" for x in self.permuted(t, [int(x, 16) for x in norm.split(":")], [65536] * 8))
        if kind == "card":
            return self._card(t, norm)
        if kind == "iban":
            body = self.characters(t + norm[:2], norm[4:])
            return norm[:2] + _iban_check(norm[:2], body) + body
        if kind == "given":
            return self.given(t, norm)
        if kind == "surname":
            return self.word(t, norm)
        return self.digits(t, norm)  # telephone, identity and other numbers

    def _ip4(self, t: str, norm: str) -> str:
        parts = [int(x) for x in norm.split(".")]
        fixed = 1 if parts[0] in (10, 127) else 2 if parts[:2] == [192, 168] or parts[0] == 172 and 16 <= parts[1] < 32 else 0
        while True:  # a permutation of all addresses, walked to the next one that is public as well, is one of the public ones
            parts[fixed:] = self.permuted(t + ".".join(map(str, parts[:fixed])), parts[fixed:], [256] * (4 - fixed))
            special = parts[0] in (0, 10, 127) or parts[0] >= 224 or parts[:2] == [192, 168] or parts[0] == 172 and 16 <= parts[1] < 32
            if fixed or not special or norm.split(".")[0] == "0" or int(norm.split(".")[0]) >= 224:
                return ".".join(map(str, parts))

    def _card(self, t: str, norm: str) -> str:
        if luhn(norm):
            body = self.digits(t + "v", norm[:-1])
            return body + next(d for d in "0123456789" if luhn(body + d))
        while True:
            norm = self.digits(t + "i", norm)
            if not luhn(norm):
                return norm


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _iban_check(country: str, body: str) -> str:
    n = int("".join(str(int(c, 36)) for c in body + country + "00"))
    return f"{98 - n % 97:02d}"


def _refilled(shape: str, value: str) -> str:
    """The characters of ``value`` in place of the letters and digits of ``shape``, its case kept."""
    got = iter(value)
    return "".join((x.upper() if c.isupper() else x) if c.isalnum() and (x := next(got, c)) else c for c in shape)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Places of e-mail addresses, which begin with the first ASCII letter or digit of their run; every run is read once."""
    at = 0
    while m := at and _EMAIL_HERE.match(text, at) or _EMAIL.search(text, at):
        sign = text.index("@", m.start())
        if first := _FIRST.search(text, m.start(), sign):
            yield first.start(), m.end()
            at = m.end()
        else:
            at = sign + 1


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normalised value) of what is found, in order, without overlaps; earlier patterns win."""
    out: list[tuple[int, int, str, str]] = []
    taken: list[tuple[int, int]] = []  # in order, without overlaps

    def put(start: int, end: int, kind: str, norm: str) -> None:
        at = bisect_right(taken, (start, end))
        if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or taken[at][0] >= end):
            insort(taken, (start, end))
            out.append((start, end, kind, norm))

    if "@" in text:
        for start, end in _emails(text):
            put(start, end, "email", text[start:end].lower())
    if any(d in text for d in "0123456789"):
        if ":" in text:
            for m in _IP6.finditer(text):
                put(*m.span(), "ip6", m[0].lower())
        for m in _IP4.finditer(text):
            if all(int(x) < 256 for x in m[0].split(".")):
                put(*m.span(), "ip4", ".".join(str(int(x)) for x in m[0].split(".")))
        for m in _IBAN.finditer(text):
            norm = m[0].replace(" ", "")
            if _iban_check(norm[:2], norm[4:]) == norm[2:4]:
                put(*m.span(), "iban", norm)
        for m in _SSN.finditer(text):
            put(*m.span(), "identity", m[0].replace("-", ""))
        for m in _CARD.finditer(text):
            if "+" != text[m.start() - 1 : m.start()]:
                put(*m.span(), "card", re.sub(r"\D", "", m[0]))
        for m in _PHONE.finditer(text):
            digits = re.sub(r"\D", "", m[0])
            told = m[0][0] == "+" or "(" in m[0] or len(digits) >= 9 and not m[0].isdigit() or _LOCAL.fullmatch(m[0])
            if 7 <= len(digits) <= 15 and told and not _DATE.match(m[0]):
                put(*m.span(), "phone", digits)
        for m in _LONG.finditer(text):
            put(*m.span(), "phone" if len(m[0]) == 10 and m[0][0] > "1" else "number", m[0])
    _persons(text, put)
    return sorted(out)


def _known(word: str) -> str:
    """A name word as tables and mentions have it: one all in capitals with its first alone."""
    return word.capitalize() if len(word) > 2 and word.isupper() else word


def _persons(text: str, put) -> None:
    last, known = -1, set()
    for m in _CAPITALISED.finditer(text):
        word = _known(m[0])
        if m.start() < last or not (word in _GIVEN or word in TITLES):
            continue
        words, end = [], m.end()
        if word in _GIVEN:
            words.append((m.start(), m.end(), word))
        elif (gap := _AFTER_TITLE.match(text, end)) and (w := _CASELESS.match(text, gap.end())):
            words.append((*w.span(), w[0]))
            end = w.end()
        while (gap := _AFTER.match(text, end)) and (w := _CAPITALISED.match(text, gap.end())) and ("." not in gap[0] or not words):
            words.append((*w.span(), _known(w[0])))
            end = w.end()
        if word in TITLES or len(words) > 1:  # a given name alone may be another word
            for s, e, w in words:
                put(s, e, "given" if w in _GIVEN else "surname", w)
                known.add(w)
            last = end
    if not known:
        return
    # bare mentions, before or after
    for m in _CAPITALISED.finditer(text):
        word = _known(m[0])
        if word in known and not _INSIDE.match(text[m.start() - 1 : m.start()]) and not _INSIDE.match(text, m.end()):
            put(*m.span(), "given" if word in _GIVEN else "surname", word)
    for word in sorted(w for w in known if _CASELESS.fullmatch(w) and len(w) > 1):
        for m in re.finditer(re.escape(word), text):
            put(*m.span(), "surname", word)


def _surrogate(keyed: Keyed, text: str, entity: tuple[int, int, str, str], again: dict) -> str:
    start, end, kind, norm = entity
    shape, tweak = text[start:end], again.get((kind, norm), 0)
    if kind == "phone":
        # the country code stays; the last ten digits are the national number whatever is written before them
        national = norm[-10:]
        return _refilled(shape, norm[:-10] + keyed.value("phone", national, again.get(("phone", national), 0)))
    got = keyed.value(kind, norm, tweak)
    if kind in ("given", "surname"):
        return got.upper() if shape.isupper() and len(shape) > 2 and len(got.upper()) == len(got) else got
    if kind in ("ip4", "ip6"):
        return got
    if kind == "email":
        return "".join(x.upper() if c.isupper() else x for x, c in zip(got, shape))
    return _refilled(shape, got)


def rewrite(keyed: Keyed, text: str, again: dict) -> tuple[str, list[dict]]:
    """The text with surrogates, and the spans of them in the original."""
    found, parts, at, spans = entities(text), [], 0, []
    for entity in found:
        start, end, kind, _ = entity
        parts += [text[at:start], _surrogate(keyed, text, entity, again)]
        spans.append({"kind": kind, "start": start, "end": end})
        at = end
    return "".join([*parts, text[at:]]), spans


def _tag(key: bytes, kind: str, value: str) -> bytes:
    return hmac.digest(key, f"{kind}|{value}".encode("utf-8", "surrogatepass"), "sha256")[:16]


def collisions(df: DataFrame, text: Column, key: bytes, again: dict | None = None) -> DataFrame:
    """(kind, norm) of all originals but the smallest of those that share a surrogate within the corpus."""
    from pyspark.sql.functions import arrow_udf

    tweaks = dict(again or {})
    kind_ = pa.list_(pa.struct([("kind", pa.string()), ("norm", pa.string()), ("surrogate", pa.binary())]))

    def pairs(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        keyed = Keyed(key)
        for column in batches:
            out = []
            for t in column.to_pylist():
                row = {}
                for _, _, kind, norm in entities(t or ""):
                    norm = norm[-10:] if kind == "phone" else norm
                    group = "name" if kind in ("given", "surname") else kind  # a made-up name may not be another's known one
                    row[(kind, norm)] = _tag(key, group, keyed.value(kind, norm, tweaks.get((kind, norm), 0)))
                out.append([{"kind": k, "norm": n, "surrogate": s} for (k, n), s in row.items()])
            yield pa.array(out, kind_)

    pairs.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    each = df.select(F.explode(arrow_udf(pairs, "array<struct<kind:string,norm:string,surrogate:binary>>")(text)).alias("e")).select("e.*").distinct()
    shared = each.groupBy("surrogate").agg(F.count("*").alias("n"), F.min(F.struct("kind", "norm")).alias("first")).where("n > 1")
    return each.join(shared, "surrogate").where(F.struct("kind", "norm") != F.col("first")).select("kind", "norm")


def replace(df: DataFrame, key: bytes, text: str = "text", spans: str | None = "entities", *, max_again: int = 100_000) -> DataFrame:
    """The table with surrogates in ``text``, and the array ``spans`` of kind, start and end in the original.

    Permutations of one kind cannot collide; what is checked for are made-up names that equal a known one's surrogate, or one
    of another ending or spelling. Originals of one surrogate differ in kind or form, so they are few; should more than
    ``max_again`` collide, the check fails instead of going on.
    """
    from pyspark.sql.functions import arrow_udf

    ship(df.sparkSession)
    again: dict = {}
    for _ in range(8):
        found = collisions(df, F.col(text), key, again).limit(max_again + 1).collect()
        if len(found) > max_again:
            raise RuntimeError(f"over {max_again} surrogates collide")
        if not found:
            break
        for r in found:
            again[(r["kind"], r["norm"])] = again.get((r["kind"], r["norm"]), 0) + 1
    else:
        raise RuntimeError("surrogates still collide after 8 rounds")
    shared = df.sparkSession.sparkContext.broadcast(again)
    kind = pa.struct([("text", pa.string()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        keyed = Keyed(key)
        for column in batches:
            got = [(None, []) if t is None else rewrite(keyed, t, shared.value) for t in column.to_pylist()]
            yield pa.array([{"text": t, "spans": s} for t, s in got], kind)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    out = df.withColumn("_new", arrow_udf(run, "struct<text:string,spans:array<struct<kind:string,start:bigint,end:bigint>>>")(F.col(text)))
    columns = [F.col("_new.text").alias(c) if c == text else F.col(c) for c in df.columns]
    return out.select(*columns, *([F.col("_new.spans").alias(spans)] if spans else []))
