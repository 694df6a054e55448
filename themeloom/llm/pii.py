"""Personal data and secrets replaced by surrogates of the same type, form, script and gender.

An entity's surrogate is made from a keyed hash of its type and its normal form, so the same entity gets
the same surrogate everywhere. Surrogates of distinct entities must differ, and none may be an entity
that the collection holds: entities that break this get a further attempt, the rest keep theirs. The
entities are compared as a distributed table; only the few that need a further attempt come back to the
documents.

A person is a gender, a given and a family name; titles of one gender and the lack of a title make no
difference. A family name without a given name is the person of that name in the same text (of the title's
gender, if there is one; of several the last one named before), or, with a title, a person of its own.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, replace
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeloom.llm.shared import freed_worker, fresh, kept_in_worker, text_slices
from themeloom.staging import stage

DEFAULT_KEY = "surrogates"
#: So many attempts keep the length of an entity; each further one adds characters, so that values never run out.
SAME_LENGTH_ATTEMPTS = 6
#: So many retried entities go to every executor at most; beyond that documents are joined with them.
BROADCAST_RETRIES = 200_000

# Given names by script and gender, family names by script.
GIVEN = {
    ("latin", "f"): ("Anna", "Maria", "Laura", "Julia", "Clara", "Elena", "Nina", "Sofia", "Emma", "Alice", "Marie", "Lucia"),
    ("latin", "m"): ("Peter", "Paul", "Thomas", "David", "Daniel", "Martin", "Simon", "Lukas", "Oscar", "Hugo", "Pierre", "Carlos"),
    ("cyrillic", "f"): ("Анна", "Мария", "Елена", "Ольга", "Ирина", "Наталья", "Светлана", "Татьяна"),
    ("cyrillic", "m"): ("Иван", "Пётр", "Сергей", "Андрей", "Дмитрий", "Алексей", "Михаил", "Николай"),
    ("greek", "f"): ("Μαρία", "Ελένη", "Άννα", "Σοφία"),
    ("greek", "m"): ("Γιώργος", "Νίκος", "Δημήτρης", "Κώστας"),
}
FAMILY = {
    "latin": ("Keller", "Moreau", "Navarro", "Fischer", "Bennett", "Carter", "Dubois", "Ortega", "Lindner", "Hughes", "Marchand", "Salazar", "Becker", "Foster", "Rivera", "Lambert"),
    "cyrillic": ("Орлов", "Соколов", "Лебедев", "Морозов", "Волков", "Зайцев", "Павлов", "Беляев"),
    "greek": ("Νικολάου", "Γεωργίου", "Παππάς", "Αντωνίου"),
}
# Syllables of made-up family names by script.
SYLLABLES = {
    script: tuple(c + v for c in consonants for v in vowels)
    for script, consonants, vowels in (
        ("latin", "bdfgklmnprstvz", "aeiou"), ("cyrillic", "бвгдзклмнпрст", "аеиоу"), ("greek", "βγδζκλμνπρστ", "αειου"),
    )
}
# Titles that say that a name follows, and the gender they say.
TITLES = {
    "Mr": "m", "Mr.": "m", "Mrs": "f", "Mrs.": "f", "Ms": "f", "Ms.": "f", "Miss": "f", "Herr": "m", "Herrn": "m",
    "Frau": "f", "Señor": "m", "Señora": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "господин": "m",
    "госпожа": "f", "κύριος": "m", "κυρία": "f",
}

_NAME = r"[^\W\d_a-zà-öø-ÿа-яёα-ωά-ώ][^\W\d_]+(?:-[^\W\d_]+)*"
_PRIVATE_KEY = r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"
_EMAIL = r"(?<![\w.+-])[\w.+-]++@(?:[\w-]++\.)+[A-Za-z]{2,}"
_CLOUD_KEY = r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"
_TOKEN = r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,})"
PATTERN = re.compile(
    "|".join(
        (
            rf"(?P<private_key>{_PRIVATE_KEY})",
            rf"(?P<email>{_EMAIL})",
            rf"(?P<cloud_key>{_CLOUD_KEY})",
            rf"(?P<token>{_TOKEN})",
            rf"(?=[PpSsAaTt])(?i:password|passwd|pwd|secret|api_key|apikey|token)[ \t]*[=:][ \t]*(?!{_PRIVATE_KEY}|{_EMAIL}|{_CLOUD_KEY}|{_TOKEN})(?P<secret>[^\s\"'<>,;]{{4,}})",
            r"(?P<quoted_secret>(?<=\")[0-9a-fA-F]{32,}(?=\"))",
            r"(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)",
            r"(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))",
            r"(?P<ip6>(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:]))",
            r"(?P<mac>(?<![\w:])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![\w:]))",
            r"(?P<social>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))",
            r"(?P<card>(?<![\d-])\d{4}(?:(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)|\d{8,9})\d{3,4}(?![\d-]))",
            r"(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?![\w])|(?<![\w(+])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?![\w-]))",
            rf"(?P<person>\b(?:{'|'.join(re.escape(t) for t in sorted(TITLES, key=len, reverse=True))}) {_NAME}(?: {_NAME})?)",
        )
    )
)
KINDS = ("private_key", "email", "cloud_key", "token", "secret", "quoted_secret", "iban", "ip", "ip6", "mac", "social", "card", "phone", "person")


@dataclass(frozen=True)
class Found:
    """An entity in a text: its span, kind and normal form."""

    start: int
    stop: int
    kind: str
    value: str
    #: Normal form of the person that a shorter mention means.
    person: str = ""

    @property
    def entity(self) -> str:
        return self.person or normal(self.kind, self.value)


#: Only lines with one of these can hold an entity that no title announces.
LINE_SIGN = re.compile(r"[0-9@=:]|AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-")
_TITLE_SIGNS = tuple(f"{title} " for title in TITLES)
NAME_WORD = re.compile(rf"(?<![\w-]){_NAME}(?![\w-])")
#: The title of a gender in the normal form of a person.
NORMAL_TITLES = {"m": "Mr", "f": "Mrs"}


def detected(text: str) -> list[Found]:
    """Entities of a text in order, without overlaps. Card numbers must pass the check digit."""
    if "PRIVATE KEY" in text:
        return _with_mentions(text, _detected_in(text, 0))
    titled = any(sign in text for sign in _TITLE_SIGNS)
    if not titled and not LINE_SIGN.search(text):
        return []
    found, start = [], 0
    for line in text.split("\n"):
        if titled or LINE_SIGN.search(line):
            found += _detected_in(line, start)
        start += len(line) + 1
    return _with_mentions(text, found) if titled else found


def _with_mentions(text: str, found: list[Found]) -> list[Found]:
    """What was found, and where the text names its persons without title or without given name."""
    # where persons stand, by family name alone, with a title's gender, and with a given name
    named: dict[tuple[str, str], list[tuple[int, str]]] = {}
    for place in found:
        if place.kind == "person" and place.entity.count(" ") == 2:
            title, given, family = place.entity.split(" ")
            for sign in ("", f"{title} ", f" {given}"):
                named.setdefault((family, sign), []).append((place.start, place.entity))
    if not named:
        return found

    def meant(family: str, sign: str, at: int) -> str:
        persons = named.get((family, sign))
        return persons[max(bisect_left(persons, (at, "")) - 1, 0)][1] if persons else ""

    out, spans = [], [(place.start, place.stop) for place in found]

    def within(at: int) -> bool:
        i = bisect_right(spans, (at, len(text)))
        return i > 0 and spans[i - 1][1] > at

    for place in found:
        if place.kind == "person" and place.entity.count(" ") == 1:
            title, family = place.entity.split(" ")
            place = replace(place, person=meant(family, f"{title} ", place.start))
        out.append(place)
    before, end = None, 0
    for word in NAME_WORD.finditer(text):
        given, before = before, word
        start, family = word.start(), word.group()
        if (family, "") not in named or within(start):
            continue
        person = ""
        if given and text[given.end() : start] == " " and given.start() >= end and not within(given.start()):
            person = meant(family, f" {given.group()}", start)
        if person:
            start = given.start()
        else:
            person = meant(family, "", start)
        end = word.end()
        out.append(Found(start, end, "person", text[start:end], person))
    return sorted(out, key=lambda place: place.start)


def _detected_in(text: str, start: int) -> list[Found]:
    found = []
    for match in PATTERN.finditer(text):
        kind = "card" if match.lastgroup == "gap" else match.lastgroup
        value = match.group(kind)
        if kind == "card" and not _passes_luhn(value):
            continue
        if not any(c.isalnum() for part in _parts(kind, value)[1::2] for c in part):
            continue
        found.append(Found(start + match.start(kind), start + match.end(kind), kind, value))
    return found


def _parts(kind: str, value: str) -> tuple[str, ...]:
    """A value cut into what stays and what is replaced, in turn; only letters and digits are replaced."""
    if kind == "email":
        name, domain = value.split("@", 1)
        host, last = domain.rsplit(".", 1)
        return "", name, "@", host, f".{last}"
    if kind == "token":
        head = re.match(r"(?:gh[pousr]_|sk-|xox[abprs]-|eyJ|)", value).group()
        return head, value[len(head) :]
    if kind == "private_key":
        return re.match(r"(-----BEGIN [^-]*-----)([\s\S]*?)(-----END [^-]*-----)$", value).groups()
    return "", value


def normal(kind: str, value: str) -> str:
    """What counts as the same entity: case of addresses and hexadecimal values, separators of numbers and the title
    of a gender do not matter."""
    if kind == "email":
        return value.lower()
    if kind == "person":
        title, names = value.split(" ", 1)
        return f"{NORMAL_TITLES[TITLES[title]]} {names}"
    if kind in ("card", "phone", "iban", "social"):
        return "".join(c for c in value if c.isalnum() or c == "+").upper()
    if _is_hexadecimal(kind, value):
        return value.lower()
    return value


def _is_hexadecimal(kind: str, value: str) -> bool:
    return kind in ("ip6", "mac", "quoted_secret") or kind == "secret" and all(c in "0123456789abcdefABCDEF" for c in value)


def _passes_luhn(value: str) -> bool:
    digits = [int(c) for c in value if c.isdigit()]
    return _luhn(digits[:-1]) == digits[-1]


def _luhn(digits: list[int]) -> int:
    """Check digit of a card number."""
    total = 0
    for i, digit in enumerate(reversed(digits)):
        doubled = digit * 2 if i % 2 == 0 else digit
        total += doubled - 9 if doubled > 9 else doubled
    return -total % 10


class _Stream:
    """Numbers from a keyed hash, as many as are asked for."""

    def __init__(self, key: str, *parts: str):
        self.seed = hmac.new(key.encode(), "\x00".join(parts).encode(), hashlib.sha256).digest()
        self.n, self.pool = 0, 0
        self.left = 0

    def below(self, bound: int) -> int:
        if self.left < 64:
            block = hashlib.sha256(self.seed + self.n.to_bytes(4, "big")).digest()
            self.pool, self.left, self.n = int.from_bytes(block, "big"), 256, self.n + 1
        value = (self.pool & 0xFFFFFFFFFFFF) % bound
        self.pool >>= 48
        self.left -= 48
        return value

    def of(self, choices):
        return choices[self.below(len(choices))]


def _same_form(value: str, stream: _Stream, hexadecimal: bool = False) -> str:
    """Each letter and digit replaced by one of its class and script, everything else kept."""
    out = []
    for c in value:
        if hexadecimal and c in "0123456789abcdefABCDEF":
            out.append(stream.of("0123456789ABCDEF" if c.isupper() else "0123456789abcdef"))
        elif c in "0123456789":
            out.append(stream.of("0123456789"))
        elif "a" <= c <= "z":
            out.append(stream.of("abcdefghijklmnopqrstuvwxyz"))
        elif "A" <= c <= "Z":
            out.append(stream.of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        elif "а" <= c <= "я":
            out.append(stream.of("абвгдежзиклмнопрстуфхцчшщэюя"))
        elif "А" <= c <= "Я":
            out.append(stream.of("АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ"))
        elif c.isalnum():
            out.append(stream.of(_alike(c)))
        else:
            out.append(c)
    return "".join(out)


def _alike(c: str) -> str:
    """Letters or digits of a character's script and class, from its page of 256; a-z where it is the only one.

    Kept per worker: one entry at most for each letter and digit there is.
    """
    known = kept_in_worker("letters alike", dict)
    if c not in known:
        known[c] = _letters_like(c)
    return known[c]


def _letters_like(c: str) -> str:
    page, script, kind = ord(c) & ~0xFF, unicodedata.name(c, "").split(" ")[0], unicodedata.category(c)
    found = [
        x
        for x in map(chr, range(max(page, 0x80), page + 0x100))
        if unicodedata.category(x) == kind
        and unicodedata.name(x, "").split(" ")[0] == script
        and unicodedata.normalize("NFKC", x) == x
        and len(x.upper()) == len(x.lower()) == 1
        and x in (x.upper().lower(), x.lower().upper())
    ]
    return "".join(found) if len(found) > 1 else "abcdefghijklmnopqrstuvwxyz"


def script_of(name: str) -> str:
    """Script of a name's first letter."""
    label = unicodedata.name(name[0], "LATIN").split()[0].lower()
    return label if label in FAMILY else "latin"


def gender_of(given: str) -> str | None:
    """Gender of a given name of the lists."""
    return next((gender for (_, gender), names in GIVEN.items() if given in names), None)


def _person(value: str, stream: _Stream, attempt: int) -> str:
    title, *names = value.split(" ")
    script = script_of(names[0])
    family = stream.of(FAMILY[script])
    if len(names) > 1:
        gender = TITLES.get(title) or gender_of(names[0]) or "m"
        given = f"{stream.of(GIVEN[script, gender])} "
    else:
        given = ""
        family += _same_form(names[0][1:], stream)[:2].lower()
    # more names than the lists hold: made-up syllables, one more with each attempt, keep people apart
    return f"{title} {given}{family}{''.join(stream.of(SYLLABLES[script]) for _ in range(attempt))}"


def _card(digits: str, stream: _Stream) -> str:
    body = digits[0] + "".join(stream.of("0123456789") for _ in digits[1:-1])
    return body + str(_luhn([int(c) for c in body]))


def _iban(value: str, stream: _Stream) -> str:
    body = _same_form(value[4:], stream)
    number = int("".join(str(int(c, 36)) for c in body + value[:2] + "00"))
    return f"{value[:2]}{98 - number % 97:02d}{body}"


def surrogate(kind: str, value: str, key: str, attempt: int = 0) -> str:
    """Replacement of an entity in normal form: valid for its kind and of the same form."""
    stream = _Stream(key, kind, value, str(attempt))
    if kind == "person":
        return _person(value, stream, attempt)
    new = _of_same_length(kind, value, stream)
    more = 2 * max(0, attempt - SAME_LENGTH_ATTEMPTS)
    if not more:
        return new
    plain = kind in ("card", "phone", "iban", "social")
    added = "".join(stream.of("0123456789" if plain else "0123456789abcdef") for _ in range(more))
    if kind in ("email", "private_key"):
        *head, tail = _parts(kind, new)
        return "".join([*head, added, tail])
    return new + ("-" if kind in ("ip", "ip6", "mac") else "") + added


def _of_same_length(kind: str, value: str, stream: _Stream) -> str:
    if kind in ("email", "token", "private_key"):
        return "".join(_same_form(part, stream) if i % 2 else part for i, part in enumerate(_parts(kind, value)))
    if kind == "cloud_key":
        return value[:4] + "".join(stream.of("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in value[4:])
    if kind == "ip":
        return ".".join(str(1 + stream.below(254)) for _ in range(4))
    if _is_hexadecimal(kind, value):
        return _same_form(value, stream, hexadecimal=True)
    if kind == "card":
        return _card(value, stream)
    if kind == "iban":
        return _iban(value, stream)
    if kind == "phone":
        country = value[: max(1, len(value) - 10)] if value.startswith("+") else ""
        return country + str(2 + stream.below(8)) + _same_form(value[len(country) + 1 :], stream)
    return _same_form(value, stream)


def in_form_of(kind: str, replacement: str, original: str) -> str:
    """The replacement with the separators, the case or the parts of a name of the place where it goes."""
    if kind == "person":
        *title, names = original.split(" ", 1) if original.split(" ")[0] in TITLES else (original,)
        new = replacement.split(" ")[1:]
        return " ".join([*title, *(new if " " in names else new[-1:])])
    if kind in ("card", "phone", "iban", "social"):
        signs = iter(c for c in replacement)
        return "".join(next(signs) if c.isalnum() or c == "+" else c for c in original) + "".join(signs)
    if kind == "email" and original.isupper():
        return replacement.upper()
    if _is_hexadecimal(kind, original) and original != original.lower():
        # each place has the case of the last letter up to there, in front of all letters that of the first
        upper, cased = next(c.isupper() for c in original if c.isalpha()), []
        for i, c in enumerate(replacement):
            upper = original[i].isupper() if i < len(original) and original[i].isalpha() else upper
            cased.append(c.upper() if upper else c)
        return "".join(cased)
    return replacement


def replaced(text: str, key: str, attempts: Mapping[tuple[str, str], int]) -> tuple[str, list[Found]]:
    """The text with surrogates, and what was found."""
    found, out, at = detected(text), [], 0
    made = {
        (kind, value): surrogate(kind, value, key, attempts.get((kind, value), 0))
        for kind, value in {(place.kind, place.entity) for place in found}
    }
    shared = _shared_names(made)
    for place in found:
        new = made[place.kind, place.entity]
        original = place.value
        if place.person and new.rsplit(" ", 1)[1] in shared:
            # the family name alone would not tell this person from another one of the text
            original = " ".join([*(t for t in original.split(" ")[:1] if t in TITLES), *place.person.split(" ")[1:]])
        out += (text[at : place.start], in_form_of(place.kind, new, original))
        at = place.stop
    return "".join([*out, text[at:]]), found


def _shared_names(made: Mapping[tuple[str, str], str]) -> set[str]:
    """Family names of surrogates that stand for several family names."""
    whose: dict[str, set[str]] = {}
    for (kind, value), new in made.items():
        if kind == "person":
            whose.setdefault(new.rsplit(" ", 1)[1], set()).add(value.rsplit(" ", 1)[1])
    return {name for name, families in whose.items() if len(families) > 1}


ENTITY = "_kind string, _value string, _surrogate string"


def _entities(docs: DataFrame, key: str) -> DataFrame:
    """Entities of ``_text`` with their first surrogates, each once per batch."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freed_worker()
        for batch in batches:
            seen = set()
            for _, texts in text_slices(batch.column(0)):
                seen.update((e.kind, e.entity) for text in texts for e in detected(text))
            rows = [(kind, value, surrogate(kind, value, key)) for kind, value in sorted(seen)]
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("_kind", "_value", "_surrogate"), row, strict=True)) for row in rows],
                schema=pa.schema([("_kind", pa.string()), ("_value", pa.string()), ("_surrogate", pa.string())]),
            )

    return docs.mapInArrow(find, ENTITY)


def retried(
    docs: DataFrame, key: str, make: Callable[[str, str, str, int], str] = surrogate
) -> tuple[DataFrame, int]:
    """Entities whose first surrogate would not do, with the attempt that does, and their number.

    Of entities with one surrogate the least keeps it. A surrogate that is itself an entity is never used.
    The values of ``make`` must not run out: those of ``surrogate`` grow with the attempt, a hundredfold and
    more each time, so that few rounds place any number of entities.
    """
    entities = stage(_entities(docs, key).distinct(), "pii_entities")
    again = F.udf(lambda kind, value, attempt: make(kind, value, key, attempt), "string")
    now = entities.withColumn("_attempt", F.lit(0))
    taken = None
    settled = []
    for attempt in count():
        first = now.groupBy("_kind", "_surrogate").agg(F.min("_value").alias("_first"), F.count("*").alias("_n"))
        clash = first.where("_n > 1").select("_kind", "_surrogate", "_first")
        real = entities.select("_kind", F.col("_value").alias("_surrogate"), F.lit(True).alias("_real"))
        judged = now.join(clash, ["_kind", "_surrogate"], "left").join(real, ["_kind", "_surrogate"], "left")
        bad = F.coalesce(F.col("_real"), F.lit(False)) | F.coalesce(F.col("_first") != F.col("_value"), F.lit(False))
        if taken is not None:
            used = taken.select("_kind", "_surrogate", F.lit(True).alias("_used"))
            judged = judged.join(used, ["_kind", "_surrogate"], "left")
            bad = bad | F.coalesce(F.col("_used"), F.lit(False))
        judged = stage(judged.withColumn("_bad", bad).select(*now.columns, "_bad"), "pii_judged")
        good = judged.where("NOT _bad").drop("_bad")
        taken = good if taken is None else taken.unionByName(good)
        if attempt:
            settled.append(good)
        left = judged.where("_bad")
        if left.isEmpty():
            break
        now = left.select(
            "_kind", "_value", again("_kind", "_value", F.lit(attempt + 1)).alias("_surrogate"),
            F.lit(attempt + 1).alias("_attempt"),
        )
        now = stage(now, "pii_again")
    result = entities.select("_kind", "_value", F.lit(0).alias("_attempt")).limit(0)
    for good in settled:
        result = result.unionByName(good.select("_kind", "_value", "_attempt"))
    result = stage(result, "pii_retried")
    return result, result.count()


def with_surrogates(docs: DataFrame, key: str = DEFAULT_KEY, text: str = "text", counts: bool = False) -> DataFrame:
    """``docs`` with each entity of ``text`` replaced; with ``counts`` also a column per kind, ``n_<kind>``.

    ``key`` is the secret of the replacement: the same key gives the same surrogates in every run.

    Null texts stay null, and texts without entities stay as they are, byte for byte. Rows that repeat are
    replaced alike. All other columns pass through, whatever their names; an empty table gives no rows.
    """
    names, at = docs.columns, docs.columns.index(text)
    retries, n = retried(docs.select(F.col(text).alias("_text")), key)
    added = [T.StructField(fresh(f"n_{kind}", names), T.LongType()) for kind in KINDS] if counts else []
    schema = T.StructType([*docs.schema.fields, *added])
    spark = docs.sparkSession
    if n <= BROADCAST_RETRIES:
        attempts = {(r["_kind"], r["_value"]): r["_attempt"] for r in retries.collect()}
        shared, given, by = spark.sparkContext.broadcast(attempts), docs, None
    else:
        shared, by = None, len(names)
        given = _with_attempts(docs, retries, text)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freed_worker()
        known = shared.value if shared is not None else {}
        for batch in batches:
            for start, texts in text_slices(batch.column(at)):
                here = batch.slice(start, len(texts))
                present, tallies, new = here.column(at).is_valid().to_pylist(), [], []
                for i, value in enumerate(texts):
                    if by is not None:
                        known_here = {(r["kind"], r["value"]): r["attempt"] for r in here.column(by)[i].as_py() or ()}
                    else:
                        known_here = known
                    out, found = replaced(value, key, known_here) if value else (value, [])
                    new.append(out if present[i] else None)
                    tallies.append([sum(e.kind == kind for e in found) for kind in KINDS] if found else [0] * len(KINDS))
                columns = list(here.columns[: len(names)])
                columns[at] = pa.array(new, pa.string())
                if counts:
                    columns += [pa.array(tally, pa.int64()) for tally in zip(*tallies, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return given.mapInArrow(put, schema)


def _with_attempts(docs: DataFrame, retries: DataFrame, text: str) -> DataFrame:
    """``docs`` and the retried entities of each text: ``_attempts array<struct<kind, value, attempt>>``."""
    row = fresh("_pii_row", docs.columns)
    staged = stage(docs.withColumn(row, F.monotonically_increasing_id()), "pii_rows")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                {"_pii_row": row, "_kind": kind, "_value": value}
                for row, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for kind, value in {(e.kind, e.entity) for e in detected(words or "")}
            ]
            yield pa.RecordBatch.from_pylist(
                rows, schema=pa.schema([("_pii_row", pa.int64()), ("_kind", pa.string()), ("_value", pa.string())])
            )

    held = staged.select(F.col(row).alias("_pii_row"), text).mapInArrow(find, "_pii_row long, _kind string, _value string")
    entry = F.struct(F.col("_kind").alias("kind"), F.col("_value").alias("value"), F.col("_attempt").alias("attempt"))
    attempts = fresh("_attempts", docs.columns)
    per_row = held.hint("merge").join(retries, ["_kind", "_value"]).groupBy(F.col("_pii_row").alias(row))
    per_row = per_row.agg(F.collect_list(entry).alias(attempts))
    return staged.join(per_row, row, "left").select(*docs.columns, attempts)


def replaced_documents(docs: DataFrame, key: str = DEFAULT_KEY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_entities``, counts per kind, and the whole text with surrogates."""
    out = with_surrogates(docs.select(doc_id, text), key, text, counts=True)
    total = sum((F.col(f"n_{kind}") for kind in KINDS), F.lit(0).cast("long"))
    return out.select(doc_id, total.alias("n_entities"), *(f"n_{kind}" for kind in KINDS), text)
