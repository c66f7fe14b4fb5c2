"""Surrogates for personal data: keyed replacements of the same type, script and format.

Entities are found by patterns, row by row.  An entity's surrogate follows from a keyed hash of its type and
normalised value alone, so mentions of one entity agree wherever they stand, without a join: digits become
digits, letters letters of the same script and case, separators stay, names are replaced word by word with their title's gender in given names, and
checksums that held still hold.  All distinct entities are then checked against one another: where two of
a type share a surrogate, or a surrogate is itself an entity of the corpus, all but one take their next
surrogate, in rounds, until none is left.  Names, addresses and secrets grow longer with the rounds, so
that there is always room.  Numbers keep their format; where a format has too few values for that, a keyed
permutation of the format gives all its entities their surrogates.  Only documents that hold an entity of a
later round meet its number in a join; texts are not shuffled otherwise.
"""

from __future__ import annotations

import hashlib
import hmac
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom.session import giving_back, materialise

#: Rounds after which a format of numbers counts as exhausted.
MOST_ROUNDS = 64
#: Round number of entities whose format is permuted.
PERMUTED = -1
#: Rounds in which addresses and secrets keep their length.
SAME_LENGTH = 3
#: Rounds of the Feistel network that permutes a format.
FEISTEL = 8

#: Titles before a person's name, by gender (fixed values).
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Госпожа"),
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин"),
    "n": ("Dr", "Prof"),
}
#: Syllables that surrogate names are made of, by script, and endings by gender.
SYLLABLES = {
    "latin": ("ba be bi bo da de di do fa fe ga ge ha he ja jo ka ke la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve vi vo".split()),
    "cyrillic": ("ба бе би бо ва ве ви во га ге да де ди до за зе ка ке ки ко ла ле ли ло ма ме ми мо на не ни но па пе ра ре ри ро са се си со та те ти то".split()),
}
ENDINGS = {
    "latin": {"f": ("na", "la", "ra", "ia"), "m": ("n", "s", "rt", "ld"), "n": ("n", "l", "r", "s")},
    "cyrillic": {"f": ("на", "ла", "ра", "ия"), "m": ("н", "р", "м", "в"), "n": ("н", "л", "р", "с")},
}

_NAME = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][\w'’-]*"
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "secret": r"(?i:\b(?:password|passwd|secret|token|api[_-]?key|access[_-]?key)\b\s*[=:]\s*[\"']?)(?P<secret_value>[^\s\"']{6,})",
    "iban": r"\b[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w.+-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![\w-])",
    "phone": r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{2,4}\) ?\d{3,4}[ .-]\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\w)",
    "name": rf"\b(?P<title>{'|'.join(t for ts in TITLES.values() for t in ts)})\b\.? (?P<name_value>{_NAME}(?: {_NAME}){{0,2}})",
}
FIND = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in PATTERNS.items()))
#: What a text without any entity lacks: a digit, an at sign, an equals sign or colon, and a title.
MAYBE = re.compile(rf"[0-9@]|(?i:password|passwd|secret|token|key)\b|\b(?:{'|'.join(t for ts in TITLES.values() for t in ts)})\b")
_WORD = re.compile(rf"(?<![\w'’-]){_NAME}")
_TAIL = re.compile(r"['’]s$|['’-]+$", re.IGNORECASE)
GENDER = {title: gender for gender, titles in TITLES.items() for title in titles}


def mentions(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, type, normalised value) of every entity of a text, in order; names have their gender in the type.

    Values are compared without case (e-mail addresses, names) or separators (numbers).  Capitalised words of two
    letters and more that stand in a name of the text are mentions of it also where they have no title.
    """
    out = []
    if not text or not MAYBE.search(text):
        return out
    for m in FIND.finditer(text):
        kind = m.lastgroup
        if m["secret"]:
            kind, (a, b) = "secret", m.span("secret_value")
        elif m["name"]:
            kind, (a, b) = f"name_{GENDER[m['title']]}", m.span("name_value")
        else:
            kind = next(k for k in PATTERNS if m[k])
            a, b = m.span()
        value = text[a:b]
        if kind == "email":
            value = value.lower()
        elif kind.startswith("name"):
            value = " ".join(value.lower().split(" "))
        elif kind in ("card", "phone", "ssn"):
            value = "+" * value.startswith("+") + _ascii(re.sub(r"\D", "", value))
        elif kind == "ip":
            value = ".".join(str(int(n)) for n in value.split("."))
        elif kind == "iban":
            value = _ascii(value.replace(" ", ""))
            if not _iban_holds(value):
                continue
        elif kind == "secret" and not any(map(str.isalnum, value)):
            continue  # a masked value: nothing to replace
        out.append((a, b, kind, value))
    names: dict[str, str] = {}
    for a, b, kind, _ in out:
        if kind.startswith("name"):
            for word in text[a:b].split(" "):
                names.setdefault(_core(word).lower(), kind)
    if names:
        ends = iter([*out, (len(text), len(text) + 1, "", "")])
        a, b, *_ = next(ends)
        more = []
        for m in _WORD.finditer(text):
            while b <= m.start():
                a, b, *_ = next(ends)
            core = _core(m[0])
            if m.end() <= a and len(core) > 1 and core.lower() in names:
                more.append((m.start(), m.start() + len(core), names[core.lower()], core.lower()))
        out = sorted([*out, *more])
    return out


def _core(word: str) -> str:
    """A word of a name without a possessive ending or trailing signs."""
    return _TAIL.sub("", word) or word


def _roles(found: list[tuple[int, int, str, str]]) -> dict[str, str]:
    """Gender of each given name (all words of a mention but its last) among the mentions of a text; f and m beat n."""
    out: dict[str, str] = {}
    for _, _, kind, value in found:
        if kind.startswith("name"):
            for word in map(_core, value.split(" ")[:-1]):
                if out.get(word, "n") == "n":
                    out[word] = kind[-1]
    return out


def entity_of(kind: str, value: str) -> list[tuple[str, str]]:
    """(type, value) of what a mention's surrogate follows from: each word of a name, else the mention."""
    if kind.startswith("name"):
        return [("name", _core(word)) for word in value.split(" ")]
    return [(kind, value)]


def _ascii(value: str) -> str:
    return "".join(str(int(c)) if c.isdecimal() else c for c in value)


def _iban_holds(value: str) -> bool:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _luhn(digits: str) -> int:
    """What the last digit must add so that the Luhn checksum holds: 0 if it does."""
    total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
    return -total % 10


class _Stream:
    """Keyed numbers that depend on type, value and round only."""

    def __init__(self, key: bytes, *parts: object):
        self.seed, self.at = hmac.new(key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest(), 0
        self.pool: int = 0
        self.bits = 0

    def below(self, n: int) -> int:
        if self.bits < 32:
            block = hashlib.sha256(self.seed + self.at.to_bytes(4, "big")).digest()
            self.pool, self.bits, self.at = int.from_bytes(block, "big"), 256, self.at + 1
        out = self.pool & 0xFFFFFFFF
        self.pool >>= 32
        self.bits -= 32
        return out % n


_LOWER = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}


def _script(c: str) -> str:
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


def _like(c: str, stream: _Stream) -> str:
    """A character of the same kind: digit, or letter of the same script and case; others stay."""
    if c.isdigit():
        return str(stream.below(10))
    if c.isalpha():
        letters = _LOWER[_script(c)]
        new = letters[stream.below(len(letters))]
        return new.upper() if c.isupper() else new
    return c


def surrogate(kind: str, value: str, attempt: int, key: bytes) -> str:
    """The surrogate of a normalised value in round ``attempt``, itself normalised."""
    if attempt == PERMUTED:
        return permuted(kind, value, key)
    stream = _Stream(key, kind, value, attempt)
    if kind.startswith("name"):
        gender = kind[-1] if "_" in kind else "n"
        return " ".join(_name(word, gender, _Stream(key, "name", word, attempt), attempt) for word in value.split(" "))
    if kind == "email":
        local, _, host = value.rpartition("@")
        *labels, last = host.split(".")
        mixed = [_Stream(key, "host", label, attempt) for label in labels]
        new = "".join(_like(c, stream) for c in local) + _longer(attempt, stream)
        return new + "@" + ".".join(["".join(_like(c, s) for c in x) for x, s in zip(labels, mixed, strict=True)] + [last])
    if kind == "ip":
        return ".".join(str(1 + stream.below(254)) for _ in range(4))
    if kind == "key":
        return value[:4] + "".join(_like(c, stream) for c in value[4:])
    if kind == "secret" and re.fullmatch("[0-9a-f]+", value):
        return "".join("0123456789abcdef"[stream.below(16)] for _ in value) + _longer(attempt, stream, "0123456789abcdef")
    new = "".join(_like(c, stream) for c in value)
    if kind == "secret":
        return new + _longer(attempt, stream)
    if kind == "iban":
        return _iban(value[:2], new[4:])
    if kind == "card" and value:
        new = value[0] + new[1:]
        return new[:-1] + str((int(new[-1]) + _luhn(new)) % 10) if _luhn(value) == 0 else new
    if kind == "phone":  # no new leading zeros; the start of a country code stays
        new = "".join(str(1 + stream.below(9)) if old != "0" and d == "0" else d for old, d in zip(value, new, strict=True))
        kept = _kept(kind, value)
        return value[:kept] + new[kept:]
    return new


def _iban(country: str, rest: str) -> str:
    checked = rest + country + "00"
    return country + f"{98 - int(''.join(str(int(c, 36)) for c in checked)) % 97:02d}" + rest


def _longer(attempt: int, stream: _Stream, signs: str = _LOWER["latin"]) -> str:
    return "".join(signs[stream.below(len(signs))] for _ in range(attempt - SAME_LENGTH))


def _kept(kind: str, value: str) -> int:
    """Signs at the start of a number that its format fixes: country codes' first digit, a leading zero, a card's issuer."""
    return {"phone": 2 if value.startswith("+") else int(value.startswith("0")), "card": 1, "iban": 4, "key": 4}.get(kind, 0)


def _cells(kind: str, value: str) -> list[tuple[int, int]]:
    """(digit, radix) of the free signs of a number, in order; empty for types that have no fixed format."""
    if kind == "ip":
        return [(int(n), 256) for n in value.split(".")]
    if kind not in ("phone", "ssn", "card", "iban", "key"):
        return []
    free = value[_kept(kind, value) : len(value) - (kind == "card")]
    cells = [(int(c), 10) if c.isdigit() else (ord(c) - 65, 26) for c in free]
    if kind == "phone" and cells and len(free) == len(value):  # no new leading zero
        cells[0] = (cells[0][0] - 1, 9)
    return cells


def format_of(kind: str, value: str) -> tuple[str | None, float]:
    """(format, values that every round can choose from) of a number; other types grow and have no format."""
    cells = _cells(kind, value)
    if not cells and kind != "phone":
        return None, float("inf")
    kept = value[: _kept(kind, value)]
    if kind == "iban":
        kept = value[:2]
    shape = "".join("A" if radix == 26 else "9" for _, radix in cells)
    size = 1.0
    for _, radix in cells:
        size *= {"phone": 9, "ip": 254}.get(kind, radix)
    return f"{kind} {kept} {shape}", size


def permuted(kind: str, value: str, key: bytes) -> str:
    """Another value of the same format, by a keyed permutation of all of them that leaves none in its place."""
    cells = _cells(kind, value)
    size = 1
    for _, radix in cells:
        size *= radix
    at = 0
    for digit, radix in cells:
        at = at * radix + digit
    label = format_of(kind, value)[0]
    step = 1 + _Stream(key, "step", label).below(min(size - 1, 1 << 31))
    at = _feistel((_feistel(at, size, key, label, back=True) + step) % size, size, key, label)
    digits = []
    for _, radix in reversed(cells):
        at, digit = divmod(at, radix)
        digits.append((digit, radix))
    digits.reverse()
    if kind == "ip":
        return ".".join(str(d) for d, _ in digits)
    new = "".join(chr(65 + d) if radix == 26 else str(d + (radix == 9)) for d, radix in digits)
    if kind == "iban":
        return _iban(value[:2], new)
    new = value[: _kept(kind, value)] + new
    if kind == "card":  # a checksum that held holds, one that did not is as far off
        return new + str((_luhn(new + "0") - _luhn(value[:-1] + "0") + int(value[-1])) % 10)
    return new


def _feistel(at: int, size: int, key: bytes, label: str, back: bool = False) -> int:
    """A keyed permutation of the numbers below ``size``, or its inverse: a Feistel network, repeated until below ``size``."""
    side = math.isqrt(size - 1) + 1
    rounds = range(FEISTEL)

    def mixed(i: int, n: int) -> int:
        return int.from_bytes(hmac.new(key, f"{label}\x1f{i}\x1f{n}".encode(), hashlib.sha256).digest(), "big") % side

    while True:
        a, b = divmod(at, side)
        for i in reversed(rounds) if back else rounds:
            a, b = ((b - mixed(i, a)) % side, a) if back else (b, (a + mixed(i, b)) % side)
        at = a * side + b
        if at < size:
            return at


def _name(word: str, gender: str, stream: _Stream, attempt: int) -> str:
    script = "cyrillic" if _script(word[:1]) == "cyrillic" else "latin"
    parts = SYLLABLES[script]
    n = max(2, min(4, len(word) // 2)) + attempt
    ends = ENDINGS[script][gender]
    return "".join(parts[stream.below(len(parts))] for _ in range(n)) + ends[stream.below(len(ends))]


def _mark(kind: str, value: str) -> str:
    """What must differ between entities: of a name its stem, which is the same in all genders, else the value.

    A name equals a surrogate only if their stems are equal: endings are a consonant run, or two signs with a vowel last.
    """
    if not kind.startswith("name") or " " in value:
        return value
    return value[:-2] if value.endswith(tuple("aeioаеияо")) else re.sub("[^aeioаеияо]+$", "", value)


def dressed(new: str, mention: str, kind: str) -> str:
    """A normalised surrogate in the format of the mention it replaces."""
    if kind.startswith("name"):
        words = [w.upper() if old.isupper() and len(old) > 1 else w.capitalize() for w, old in zip(new.split(" "), mention.split(" "), strict=True)]
        return " ".join(words)
    if kind in ("card", "phone", "ssn", "iban"):
        signs = iter(new.lstrip("+"))
        return "".join(next(signs) if c.isalnum() else c for c in mention)
    if kind == "email":
        at = mention.rindex("@")
        mention = mention[:at] + "a" * (len(new) - len(mention)) + mention[at:]
        return "".join(n.upper() if c.isupper() else n for n, c in zip(new, mention, strict=True))
    return new


def find_entities(docs: DataFrame) -> DataFrame:
    """(doc_id, type, value): the distinct entities of each row of ``docs`` (doc_id, text); names by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (doc, kind, value)
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)
                for kind, value in sorted({e for m in mentions(text) for e in entity_of(*m[2:])})
            ]
            columns = list(zip(*rows, strict=True)) or [()] * 3
            types = (pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "type", "value"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(giving_back(run), "doc_id long, type string, value string")


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """(type, value, attempt, surrogate): a distinct surrogate for each distinct entity, none of them an entity.

    Of entities with the same surrogate the first by value keeps it, unless it is an entity's value.  Each
    round is written to the shared folder.  The stems of names are distinct, and thus names of all genders.
    Where over half of a format's values are entities, or ``MOST_ROUNDS`` leave clashes in it, the format is
    permuted: its surrogates are distinct and never an entity's own value, but may be other entities' values,
    which no choice could avoid.  Only a number without any free digit, which no pattern finds, is an error.
    """

    def formats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in ("type", "value")]
            found = [format_of(*row) for row in zip(*(c.to_pylist() for c in columns), strict=True)]
            names, sizes = zip(*found, strict=True) if found else ((), ())
            marks = [_mark(*row) for row in zip(*(c.to_pylist() for c in columns), strict=True)]
            arrays = [*columns, pa.array(names, pa.string()), pa.array(sizes, pa.float64()), pa.array(marks, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["type", "value", "format", "size", "mark"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in ("type", "value", "format", "attempt")]
            new = [surrogate(kind, value, attempt, key) for kind, value, _, attempt in zip(*(c.to_pylist() for c in columns), strict=True)]
            marks = [_mark(kind, value) for kind, value in zip(batch.column("type").to_pylist(), new, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(new, pa.string()), pa.array(marks, pa.string())], ["type", "value", "format", "attempt", "surrogate", "mark"])

    schema = "type string, value string, format string, attempt int, surrogate string, mark string"
    space = F.regexp_replace("type", "_.*", "")

    def permute(rows: DataFrame, full: DataFrame) -> DataFrame:
        """``rows`` with the formats in the narrow table ``full`` permuted."""
        full = full.select("format", F.lit(True).alias("full"))
        attempt = F.when(F.col("full"), F.lit(PERMUTED)).otherwise(F.col("attempt")).cast("int")
        return rows.join(full, "format", "left").select("type", "value", "format", attempt.alias("attempt"))

    rows = entities.select("type", "value").distinct().mapInArrow(formats, "type string, value string, format string, size double, mark string")
    rows = materialise(rows, "entities")
    full = rows.filter("format is not null").groupBy("format").agg(F.count("*").alias("n"), F.min("size").alias("size"))
    full = materialise(full.filter(2 * F.col("n") > F.col("size")), "full_formats")
    if not full.filter("size < 2").isEmpty():  # no pattern finds such numbers
        raise RuntimeError("a number without free digits has no surrogates")
    state = materialise(permute(rows.withColumn("attempt", F.lit(0)), full).mapInArrow(run, schema), "surrogates")
    real = materialise(rows.select(space.alias("space"), "mark").distinct(), "marks")
    taken = real.withColumn("taken", F.lit(True))
    done = ("type", "value", "attempt", "surrogate")
    for last in range(MOST_ROUNDS, -1, -1):
        rows = state.filter(F.col("attempt") != PERMUTED).withColumn("space", space)
        shared = rows.groupBy("space", "mark").agg(F.min(F.struct("value", "type")).alias("first"), F.count("*").alias("n"))
        shared = shared.join(taken, ["space", "mark"], "left").filter("n > 1 or taken")
        clash = materialise(shared.select("space", "mark", "first", F.coalesce("taken", F.lit(False)).alias("taken")), "clashes")
        if clash.isEmpty():
            break
        moves = F.coalesce(F.col("taken") | (F.col("first") != F.struct("value", "type")), F.lit(False))
        met = state.withColumn("space", space).join(clash, ["space", "mark"], "left")
        moves &= F.col("attempt") != PERMUTED
        if last:
            next_ = met.select("type", "value", "format", F.when(moves, F.col("attempt") + 1).otherwise(F.col("attempt")).alias("attempt"))
        else:
            next_ = permute(state, met.filter(moves).select("format").distinct())
        state = materialise(next_.mapInArrow(run, schema), "surrogates")
    return state.select(*done)


def replace_entities(docs: DataFrame, key: bytes, *keep: str) -> DataFrame:
    """Every row of ``docs`` with its entities replaced: doc_id, text, n_replaced, spans, and the columns ``keep``.

    spans are (start, end, type) of the replacements in the new text, counted in code points.  A null text stays
    null, a text without entities stays as it is, and empty tables give empty results.  Repeated rows and
    null ids are kept, with the same replacements.
    """
    found = materialise(find_entities(docs), "mentions")
    later = materialise(assign(found, key).filter("attempt <> 0").select("type", "value", "attempt"), "later_rounds")
    marked = found.join(later, ["type", "value"]).groupBy("doc_id").agg(F.collect_set(F.struct("type", "value", "attempt")).alias("later"))
    marked = materialise(marked.select(F.col("doc_id").alias("marked_id"), "later"), "marked")

    def named(word: str, roles: dict[str, str], attempts: dict[tuple[str, str], int]) -> str:
        core = _core(word)
        value = core.lower()
        kind = f"name_{roles[value]}" if value in roles else "name"
        return dressed(surrogate(kind, value, attempts.get(("name", value), 0), key), core, kind) + word[len(core) :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = [], []
            for text, later in zip(batch.column("text").to_pylist(), batch.column("later").to_pylist(), strict=True):
                attempts = {(e["type"], e["value"]): e["attempt"] for e in later or ()}
                parts, places, at, size = [], [], 0, 0
                found = mentions(text)
                roles = _roles(found)
                for a, b, kind, value in found:
                    if kind.startswith("name"):
                        new = " ".join(named(word, roles, attempts) for word in text[a:b].split(" "))
                    else:
                        new = dressed(surrogate(kind, value, attempts.get((kind, value), 0), key), text[a:b], kind)
                    parts += [text[at:a], new]
                    size += a - at
                    places.append({"start": size, "end": size + len(new), "type": kind})
                    at, size = b, size + len(new)
                texts.append(text if text is None or not parts else "".join([*parts, text[at:]]))
                spans.append(places)
            n = pa.array([len(s) for s in spans], pa.int32())
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string())]))
            kept = [batch.column(c) for c in ("doc_id", *keep)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), n, pa.array(spans, kind)], ["doc_id", *keep, "text", "n_replaced", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, "text")
    place = T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()).add("type", T.StringType())
    schema = T.StructType([rows.schema[c] for c in ("doc_id", *keep)]).add("text", T.StringType())
    schema = schema.add("n_replaced", T.IntegerType()).add("spans", T.ArrayType(place))
    joined = rows.join(marked, F.col("doc_id").eqNullSafe(F.col("marked_id")), "left").select(*rows.columns, "later")
    return joined.mapInArrow(giving_back(run), schema)
