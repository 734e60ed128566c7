"""PII: surrogate generation.

1. Rows that cannot hold an entity (a native pattern says so) pass through. In
   the others e-mail addresses, card, account, phone and social security numbers,
   IP addresses and names after a form of address are detected in Arrow batches.
   A name found once is also replaced where it stands alone in the same text.
2. The registry holds each different entity (kind, canonical form) once. Its
   surrogate is keyed and of the same kind and format: digits stay digits, letters
   stay in their script and case, the country code, check digit, network class
   and separators of the original are kept (a valid account number stays valid); given names come from names of the
   same gender and script. Numbers and addresses go through a keyed permutation
   (a Feistel network with cycle walking), so different ones of a format stay
   different.
3. Collision check over the whole registry: a surrogate that another entity of
   the kind also got, or that is itself an entity of the corpus, is drawn anew with
   the next attempt number, until there is none. Where the values of a format are
   nearly all entities themselves, drawing within it can't end: from attempt ``WIDEN``
   on the format grows by a letter, digit or network, so there is room for all.
   A name known by its title as one gender anywhere in the corpus has that gender
   also after a title without one.
4. Mentions join the registry by entity, are collected per text (by its digest),
   and the surrogate is written in the mention's own separators and case. The
   same entity has the same surrogate in every text (coreference).

Only rows with candidates are shuffled, and hot entities only as join rows, which
the skew join can split; the registry is aggregated before it is shuffled.

Defined cases: a null text stays null, an empty one empty; repeated rows get equal
results; empty tables give no rows; other columns pass through whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, partial
from hashlib import blake2b
from ipaddress import ip_address

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Attempts within an entity's own format, and rounds of drawing at most.
WIDEN, ROUNDS = 3, 64
MENTION = "digest string, begin int, stop int, kind string, canon string"

# -- fixed values: forms of address by gender, names by script and gender, alphabets
ADDRESS = {
    "m": ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "господин", "г-н"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "госпожа", "г-жа"),
    "u": ("Dr", "Prof"),
}
GIVEN = {
    "latin": {"m": ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Jonas", "Leon", "Martin", "Oscar", "Simon"),
              "f": ("Alice", "Berta", "Clara", "Diana", "Emma", "Flora", "Helena", "Julia", "Laura", "Maria", "Nora", "Sofia"),
              "u": ("Alex", "Andrea", "Charlie", "Kim", "Luca", "Robin", "Sasha", "Toni")},
    "cyrillic": {"m": ("Антон", "Борис", "Виктор", "Иван", "Олег", "Павел", "Роман", "Сергей"),
                 "f": ("Анна", "Вера", "Галина", "Елена", "Ирина", "Мария", "Ольга", "Татьяна"),
                 "u": ("Саша", "Женя", "Валя", "Слава")},
}
SYLLABLES = {"latin": ("bal", "den", "fer", "gor", "hal", "kes", "lin", "mor", "nal", "per", "rov", "sel", "tan", "var", "wen", "zel"),
             "cyrillic": ("бел", "вол", "гор", "дом", "зор", "кал", "лев", "мор", "нов", "рак", "сав", "тол")}
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
             "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ")
#: Scripts whose letters are one range of code points, as (first, last).
RANGES = ((0x430, 0x44F), (0x410, 0x42F), (0x3B1, 0x3C9), (0x391, 0x3A9), (0x5D0, 0x5EA), (0x621, 0x64A), (0x905, 0x939),
          (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))

_TITLES = {t: g for g, names in ADDRESS.items() for t in names}
_TITLE = f"(?:{'|'.join(map(re.escape, sorted(_TITLES, key=len, reverse=True)))})"
_UPPER = r"[^\W\d_a-zà-öø-ÿа-я]"
_INITIALS = rf"(?:{_UPPER}(?:\.-?[ \t]*|[ \t]+)){{0,4}}"
_NAME = rf"{_UPPER}[^\W\d_]+(?:[-'’][^\W\d_]+)*"
#: A word of a name, with the initials and the particle before it. No title is a name.
_WORD = (rf"{_INITIALS}(?:(?:von|van|de|del|di|da|dos|du)(?:[ \t]+(?:der|den|la))?[ \t]+)?"
         rf"(?!{_TITLE}(?!\w)){_NAME}")
_GROUPS = "[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}"
PATTERNS = (
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("ipv6", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?!\w|:[\w:]|\.[0-9])"
                        rf"|(?<![\w:])(?:{_GROUPS})?::(?:{_GROUPS})?(?!\w|:[\w:]|\.[0-9])")),
    ("ipv4", re.compile(r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\w|\.[0-9])")),
    ("card", re.compile(r"(?<![\w-])[0-9]{4}(?:(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}|[ -][0-9]{6}[ -][0-9]{4,5})(?![\w-])")),
    ("ssn", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    # Phones: with a country code; with a trunk 0 or of ten digits; of short groups.
    ("phone", re.compile(r"(?<![\w.+-])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,5}\)[ .-]?)?[0-9]{1,10}(?:[ ./-][0-9]{2,10}){0,6}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w.+-])(?:0[0-9]{2,5} ?/ ?[0-9]{2,10}(?:[ -][0-9]{2,10}){0,3}|0[0-9]{10,11}"
                         r"|(?:\([0-9]{2,6}\)[ .-]?)?[0-9]{2,10}(?:[ .-][0-9]{2,10}){0,5})(?![\w-]|\.[0-9])")),
    ("phone", re.compile(r"(?<![\w.+-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,5}(?![\w-])"
                         r"|(?<![\w.+-])\+[0-9]{7,15}(?!\w)")),
    ("name", re.compile(rf"(?<!\w)({_TITLE}(?:\.?[ \t]+{_TITLE}(?!\w))*)\.?[ \t]+({_WORD}(?:[ \t]+{_WORD}){{0,3}})")),
)
_DOMAIN = re.compile(r"[\w-]+(?:\.[\w-]+)+")
_SHORT_GROUPS = re.compile(r"(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,5}")
_DAY = re.compile(r"(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?= )")
_DECIMAL = re.compile(r"[0-9]+\.[0-9]+")
_DATE = re.compile(r"(19|20)[0-9]{2}[-. ][0-9]{2}([-. ][0-9]{2,4})?|[0-9]{2}[-. ][0-9]{2}[-. ](19|20)?[0-9]{2}|(19|20)[0-9]{2}[- ](19|20)[0-9]{2}")
#: A text without a match of this (Java) pattern holds no entity. The look-ahead
#: lets most characters fail one class instead of every alternative.
CANDIDATE = (r"(?=[@0-9:A-Zг])(?:@|[0-9][0-9 ()./-]{4,}[0-9]|:(?::|[0-9A-Fa-f]{1,4}:)|[A-Z]{2}[0-9]{2}|"
             + "|".join(sorted(_TITLES)) + ")")


def may_hold(text: Column) -> Column:
    return F.coalesce(text.rlike(CANDIDATE), F.lit(False))


# -- detection ----------------------------------------------------------------

def _canonical(kind: str, text: str) -> str | None:
    """The form that all mentions of one entity share; None: not of the kind."""
    digits = re.sub(r"[^0-9]", "", text)
    if kind == "iban":
        return text.replace(" ", "") if 15 <= len(text.replace(" ", "")) <= 34 else None
    if kind == "ipv4":
        return text if all(int(p) < 256 and (p == "0" or p[0] != "0") for p in text.split(".")) else None
    if kind == "ipv6":
        # Without a digit and of one or two groups (a::b) it is a name of some program.
        if not digits and len(re.findall("[A-Fa-f]+", text)) < 3:
            return None
        try:
            address = ip_address(text)
        except ValueError:
            return None
        return None if address.is_unspecified or address.is_loopback else address.compressed
    if kind == "card":
        return digits if 13 <= len(digits) <= 19 else None
    if kind == "ssn":
        return digits
    if not 7 <= len(digits) <= 15 or _DATE.fullmatch(text):
        return None
    if text.startswith("+"):
        return "+" + digits if len(digits) <= 11 or text[1] not in "17" else None
    national = digits.startswith("00") or digits[0] == "0" and len(digits) <= 12 or len(digits) == 10
    return digits if _SHORT_GROUPS.fullmatch(text) or national and not _DECIMAL.fullmatch(text) else None


def _phone(text: str) -> tuple[int, str | None]:
    """(end, canonical form) of the longest number that groups of digits begin with:
    other numbers may follow it. Without one, the end of the first group (or of a date)."""
    if day := _DAY.match(text):
        return day.end(), None
    ends = [m.end() + (text[m.end():m.end() + 1] == ")") for m in re.finditer("[0-9]+", text)]
    return next(((e, canon) for e in reversed(ends) if (canon := _canonical("phone", text[:e]))), (ends[0], None))


def _script(name: str) -> str:
    return "cyrillic" if "Ѐ" <= name[0] <= "ӿ" else "latin"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Ranges of addresses, from each @ to the left and right: linear on any text."""
    at = text.find("@")
    while at >= 0:
        a = at
        while a > 0 and (text[a - 1].isalnum() or text[a - 1] in "_.+%-"):
            a -= 1
        if a < at and (domain := _DOMAIN.match(text, at + 1)):
            yield a, domain.end()
        at = text.find("@", at + 1)


def mentions(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of the entities of a text, in order."""
    if not text:
        return []
    out: list[tuple[int, int, str, str]] = []
    taken = bytearray(len(text))

    def take(a: int, b: int, kind: str, canon: str | None) -> None:
        if canon and not any(taken[a:b]):
            taken[a:b] = b"\1" * (b - a)
            out.append((a, b, kind, canon))

    names: dict[str, str] = {}
    for a, b in _emails(text):
        b = a + len(text[a:b].rstrip("-"))
        take(a, b, "email", text[a:b].lower())
    for kind, pattern in PATTERNS:
        at = 0
        while m := pattern.search(text, at):
            at = m.end()
            if kind != "name":
                if kind != "phone":
                    take(m.start(), at, kind, _canonical(kind, m[0]))
                elif taken[m.start()]:
                    at = taken.find(0, m.start()) % (len(text) + 1)
                else:
                    other = taken.find(1, m.start(), at)
                    end, canon = _phone(m[0] if other < 0 else text[m.start():other])
                    at = m.start() + end
                    take(m.start(), at, kind, canon)
                continue
            parts = [(m.start(2) + p.start(), p[0]) for p in re.finditer(_NAME, m[2])]
            genders = [_TITLES[t] for t in re.findall(_TITLE, m[1])]
            gender = next((g for g in genders if g != "u"), "u")
            for k, (begin, part) in enumerate(parts):
                label = f"given-{gender}-{_script(part)}" if k < len(parts) - 1 else f"family-{_script(part)}"
                label = names.setdefault(part, label)
                take(begin, begin + len(part), label, part.casefold())
    if names:
        alone = re.compile(rf"(?<!\w)({'|'.join(map(re.escape, sorted(names, key=len, reverse=True)))})(?!\w)")
        for m in alone.finditer(text):
            take(m.start(), m.end(), names[m[0]], m[0].casefold())
    return sorted(out)


# -- surrogates ---------------------------------------------------------------

def permuted(x: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0 .. size - 1."""
    if size < 2:
        return x
    half = (size.bit_length() + 1) // 2
    mask = (1 << half) - 1
    while True:
        left, right = x >> half, x & mask
        for k in range(8):
            h = blake2b(f"{tweak}|{k}|{right}".encode(), key=key[:64]).digest()
            left, right = right, left ^ int.from_bytes(h, "big") & mask
        x = left << half | right
        if x < size:
            return x


@lru_cache(maxsize=65_536)
def _alphabet(char: str) -> tuple[int, int, int]:
    """(number of the alphabet or -1, size, index of the character)."""
    for k, letters in enumerate(ALPHABETS):
        if char in letters:
            return k, len(letters), letters.index(char)
    for k, (a, b) in enumerate(RANGES):
        if a <= ord(char) <= b:
            return len(ALPHABETS) + k, b - a + 1, ord(char) - a
    return -1, 1, 0


def _letter(k: int, index: int) -> str:
    return ALPHABETS[k][index] if k < len(ALPHABETS) else chr(RANGES[k - len(ALPHABETS)][0] + index)


def same_format(text: str, key: bytes, tweak: str) -> str:
    """The text with each character moved within its alphabet; a permutation of
    the texts of the same format."""
    spots = [_alphabet(c) for c in text]
    shape = ",".join(c if k < 0 else str(k) for c, (k, _, _) in zip(text, spots, strict=True))
    x, size = 0, 1
    for _, n, i in spots:
        x, size = x * n + i, size * n
    x = permuted(x, size, key, f"{tweak}|{shape}")
    out = []
    for c, (k, n, _) in zip(reversed(text), reversed(spots), strict=True):
        x, i = divmod(x, n)
        out.append(c if k < 0 else _letter(k, i))
    return "".join(reversed(out))


def _luhn(body: str) -> int:
    total = 0
    for k, c in enumerate(reversed(body)):
        v = int(c) * (2 if k % 2 == 0 else 1)
        total += v - 9 if v > 9 else v
    return -total % 10


def _network(text: str) -> int:
    """Numbers of an address that name a private, local or multicast network; 0: public."""
    a, b = (int(p) for p in text.split(".")[:2])
    special = {10: 1, 127: 1}.get(a) or (2 if (a, b) in ((192, 168), (169, 254)) else 0) or (2 if a == 172 and 16 <= b < 32 else 0)
    return special or int(not 1 <= a <= 223)


def _ipv4(text: str, key: bytes, tweak: str) -> str:
    if fixed := _network(text):       # the network part stays
        head, x = text.split(".")[:fixed], 0
        for p in text.split(".")[fixed:]:
            x = x << 8 | int(p)
        x = permuted(x, 1 << 8 * (4 - fixed), key, f"{tweak}|{'.'.join(head)}")
        return ".".join([*head, *(str(x >> 8 * k & 255) for k in range(3 - fixed, -1, -1))])
    x = int.from_bytes(bytes(map(int, text.split("."))), "big")
    while True:
        x = permuted(x, 1 << 32, key, tweak)
        p = x.to_bytes(4, "big")
        if 1 <= p[0] <= 223 and p[0] not in (10, 127) and (p[0], p[1]) not in ((192, 168), (169, 254)) and not (p[0] == 172 and 16 <= p[1] < 32):
            return ".".join(map(str, p))


def _mod97(account: str) -> int:
    """Remainder of an account number (upper-case letters count as 10 to 35), country moved behind."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def surrogate(kind: str, canon: str, key: bytes, attempt: int = 0) -> str:
    """The keyed replacement of an entity, in canonical form."""
    tweak = f"{kind}|{attempt}"
    wider = max(0, attempt - WIDEN + 1)
    if kind == "email":
        local, _, domain = canon.rpartition("@")
        local += "x" * wider
        labels = domain.split(".")
        keep = 2 if len(labels) > 2 and labels[-2] == "example" else 1
        moved = same_format(local + "@" + ".".join(labels[:-keep]), key, f"{tweak}|{'.'.join(labels[-keep:])}")
        return moved + "." + ".".join(labels[-keep:])
    if kind == "card":
        body = same_format(canon[1:-1], key, f"{tweak}|{canon[0]}")       # the issuer's first digit stays
        return canon[0] + body + str((_luhn(canon[0] + body) + int(canon[-1]) - _luhn(canon[:-1])) % 10)
    if kind == "iban":
        if _mod97(canon) != 1:
            return canon[:2] + same_format(canon[2:], key, f"{tweak}|{canon[:2]}")
        body = same_format(canon[4:], key, f"{tweak}|{canon[:2]}")
        return f"{canon[:2]}{98 - _mod97(f'{canon[:2]}00{body}'):02d}{body}"
    if kind == "ipv4":
        # A used-up network is left for 10.0.0.0/8, and that for the public addresses.
        if wider and _network(canon):
            canon = ".".join(["10" if wider == 1 else "8", *canon.split(".")[1:]])
        return _ipv4(canon, key, tweak)
    if kind == "ipv6":
        # Drawn anew, groups may grow: short ones have few values.
        size = [len(p) and (4 if attempt else len(p)) for p in canon.split(":")]
        x = permuted(int("".join(p.zfill(n) for p, n in zip(canon.split(":"), size, strict=True)), 16), 16 ** sum(size), key, f"{tweak}|{size}")
        digits, out = f"{x:0{sum(size)}x}", []
        for n in size:
            out.append(digits[:n])
            digits = digits[n:]
        return ip_address(":".join(out)).compressed
    if kind == "phone":
        plus = canon.startswith("+")
        keep = 1 + (1 if canon[1] in "17" else 2) if plus else int(canon[0] == "0")
        return canon[:keep] + same_format(canon[keep:] + "0" * wider, key, f"{tweak}|{canon[:keep]}")
    if kind == "ssn":
        return same_format(canon + "0" * wider, key, tweak)
    what, _, rest = kind.partition("-")
    h = int.from_bytes(blake2b(f"{tweak}|{canon}".encode(), key=key[:64]).digest(), "big")
    syllables = SYLLABLES[rest.rpartition("-")[2]]
    # Names already given to another are drawn anew from a larger space.
    count, name = (3, "") if what == "family" else (attempt, "")
    if what == "given":
        gender, _, script = rest.partition("-")
        pool = GIVEN[script][gender]
        h, k = divmod(h, len(pool))
        name = pool[k]
    for _ in range(count + attempt):
        h, k = divmod(h, len(syllables))
        name += syllables[k]
    return name.casefold()


def rendered(kind: str, mention: str, canon: str, replacement: str) -> str:
    """The surrogate with the separators and the case of the mention."""
    if kind in ("card", "phone", "ssn", "iban"):
        letters, out = iter(replacement.lstrip("+")), []
        for c in mention:
            out.append(next(letters) if c.isascii() and c.isalnum() else c)
        return "".join(out) + "".join(letters)      # more digits than the mention: a widened format
    if kind.startswith(("given", "family")):
        return replacement.upper() if len(mention) > 1 and mention.isupper() else replacement[0].upper() + replacement[1:]
    if kind == "ipv6":
        if "::" not in mention:
            groups = ip_address(replacement).exploded.split(":")
            replacement = ":".join(f"{int(r, 16):0{len(g)}x}" for r, g in zip(groups, mention.split(":"), strict=True))
        return replacement.upper() if mention.isupper() else replacement
    if len(mention) == len(replacement):
        return "".join(r.upper() if c.isupper() else r for c, r in zip(mention, replacement, strict=True))
    return replacement


# -- Spark --------------------------------------------------------------------

def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(d, *m) for d, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for m in mentions(t)]
        if rows:
            types = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                                             names=["digest", "begin", "stop", "kind", "canon"])


def _surrogate_column(key: bytes, kind: str, canon: str, attempt: str) -> Column:
    @F.arrow_udf("string")
    def of(kinds: pa.Array, canons: pa.Array, attempts: pa.Array) -> pa.Array:
        return pa.array([surrogate(k, c, key, a) for k, c, a in
                         zip(kinds.to_pylist(), canons.to_pylist(), attempts.to_pylist(), strict=True)], pa.string())
    return of(F.col(kind), F.col(canon), F.col(attempt))


def _with_known_gender(entities: DataFrame) -> DataFrame:
    """Adds ``drawn_as`` to (kind, canon): a given name of unknown gender is drawn as
    the one gender that it has elsewhere in the corpus."""
    part = F.split("kind", "-")
    given = entities.filter(F.col("kind").startswith("given-"))
    known = (given.filter(~F.col("kind").startswith("given-u-")).groupBy(part[2].alias("script"), "canon")
             .agg(F.min(part[1]).alias("gender"), F.max(part[1]).alias("other")).filter(F.col("gender") == F.col("other")).drop("other"))
    unknown = F.when(F.col("kind").startswith("given-u-"), part[2])
    return (entities.withColumn("script", unknown).join(known, ["script", "canon"], "left")
            .select("kind", "canon", F.coalesce(F.concat(F.lit("given-"), "gender", F.lit("-"), "script"), "kind").alias("drawn_as")))


def build_registry(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, canon, attempt, replacement) of each different entity, without collisions."""
    entities = _with_known_gender(found.select("kind", "canon").distinct()).checkpoint()
    drawn = entities.select(F.col("drawn_as").alias("kind"), "canon").distinct().withColumn("attempt", F.lit(0))
    registry = drawn.withColumn("replacement", _surrogate_column(key, "kind", "canon", "attempt")).checkpoint()
    for _ in range(ROUNDS):
        # The first of equal surrogates keeps it, unless it is an entity of the corpus.
        holder = registry.groupBy("kind", "replacement").agg(F.min("canon").alias("holder"))
        real = registry.select("kind", F.col("canon").alias("replacement"), F.lit(True).alias("real"))
        judged = registry.join(holder, ["kind", "replacement"]).join(real, ["kind", "replacement"], "left")
        judged = judged.withColumn("bad", F.col("real").isNotNull() | (F.col("canon") != F.col("holder")))
        again = judged.filter("bad").select("kind", "canon", (F.col("attempt") + 1).alias("attempt")).checkpoint()
        if again.isEmpty():
            return entities.join(registry.withColumnRenamed("kind", "drawn_as"), ["drawn_as", "canon"]).select("kind", "canon", "attempt", "replacement")
        kept = judged.filter(~F.col("bad")).select("kind", "canon", "attempt", "replacement")
        registry = kept.unionByName(again.withColumn(
            "replacement", _surrogate_column(key, "kind", "canon", "attempt"))).checkpoint()
    raise RuntimeError(f"surrogates still collide after {ROUNDS} rounds")


def _replaced_column(text: str, placed: str) -> Column:
    @F.arrow_udf("string")
    def of(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for t, places in zip(texts.to_pylist(), lists.to_pylist(), strict=True):
            for p in sorted(places or (), key=lambda p: -p["begin"]):
                t = t[:p["begin"]] + rendered(p["kind"], t[p["begin"]:p["stop"]], p["canon"], p["replacement"]) + t[p["stop"]:]
            out.append(t)
        return pa.array(out, pa.string())
    return of(F.col(text), F.col(placed))


def replace_entities(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """(row, text, entities): every row of docs as a struct, its text with
    surrogates, and the replaced mentions (begin, stop, kind, canon, replacement)
    in order, null if there are none."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_col).alias("text"))
    some = rows.filter(may_hold(F.col("text"))).withColumn("digest", F.sha2("text", 256))
    found = some.select("digest", "text").mapInArrow(_found, MENTION).distinct().checkpoint()
    placed = (found.join(build_registry(found, key), ["kind", "canon"])
              .groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("begin", "stop", "kind", "canon", "replacement"))).alias("entities")))
    # Another form of the key, so that a text of very many rows can be split (see skew.py).
    placed = placed.select(F.reverse("digest").alias("found"), "entities")
    done = some.join(placed, F.reverse(some["digest"]) == placed["found"], "left").select("row", _replaced_column("text", "entities").alias("text"), "entities")
    rest = rows.filter(~may_hold(F.col("text"))).select(
        "row", "text", F.lit(None).cast(done.schema["entities"].dataType).alias("entities"))
    return rest.unionByName(done)


def with_surrogates(docs: DataFrame, key: bytes, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs with the text column rewritten (and ``length_col``, its characters, with it)."""
    out = replace_entities(docs, key, text_col)
    return out.select(*(
        F.col("text").alias(c) if c == text_col else
        F.length("text").cast(docs.schema[c].dataType).alias(c) if c == length_col else F.col(f"row.`{c}`").alias(c)
        for c in docs.columns))
