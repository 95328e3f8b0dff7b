"""Personal data: detection, and surrogates of the same type, script, gender and format.

Detected: e-mail addresses, IPv4 addresses, phone and card numbers, social-security numbers, IBANs, access keys, assigned
passwords and tokens, and names after a form of address, with every other place where their document writes a word of such
a name with a capital. A surrogate is a keyed permutation of the entity's normalised
form within its own format (mixed-radix Feistel network, walking the cycle until the form is valid again): equal entities,
however they are written, get equal surrogates, and different ones different surrogates. Punctuation, capitals, lengths,
country codes, card issuers, check digits, private address ranges and reserved mail domains stay as they are.

The corpus-wide collision check works on the table of distinct entities: a surrogate that is itself an entity of the
corpus, or that two entities share, is drawn anew with the next attempt. What still collides after some draws is given the
free values of its format one by one, in keyed order; where a format has no free value, or is too large to be listed, and
where its characters belong to no alphabet, a keyed token of a wider format stands in. Only entities of later attempts are
sent to the workers that replace, up to `BLOCK` of them; more are joined to the texts that hold them.

Defined results: a null text stays null without entities; an empty or clean text stays as it is; overlapping finds count
once, the earlier and longer first; repeated rows are written alike; a very long text is read whole, by one task. The key
decides all surrogates; the same key gives the same ones in any run over the same corpus. It is the caller's, or the session's
(`spark.tidewarp.surrogate.key`); where neither gives one, each program draws its own, which nobody else has. Columns stay as
they came, whatever their names, but for the text and the column that the spans are asked under.
"""

from __future__ import annotations

import functools
import hashlib
import re
import secrets
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..tables import freed
from .common import prepare, table, written

#: Entities of later attempts that are broadcast, at most.
BLOCK = 100_000
#: Steps along a permutation's cycle until a form is valid; where none of them is, the next attempt draws again.
WALK = 400
#: Formats of up to so many values are listed; draws from here on are tokens.
LISTED, WIDE = 1 << 24, 1_000
KEY_SETTING = "spark.tidewarp.surrogate.key"
_OWN_KEY = secrets.token_bytes(32)

_EMAIL = re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}@[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)+")
_IP = re.compile(r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\d|\.\d)")
_CARD = re.compile(r"(?<![\d+])[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,4}(?:\d{3})?(?!\d)|(?<![\d+])3[47]\d{2}[ -]?\d{6}[ -]?\d{5}(?!\d)")
_PHONE = re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)")
_SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
_IBAN = re.compile(r"(?<![^\W_])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![^\W_])")
_KEY = re.compile(r"(?<![^\W_])(?:AKIA|ASIA)[A-Z0-9]{16}(?![^\W_])")
_SECRET = re.compile(r"(?i)(?<![^\W_])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\s*[=:]\s*[\"']?((?=[^\W]*\d)[A-Za-z0-9+/_-]{8,})")

# Forms of address, by gender (m, f, or u for either).
TITLES = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "Don": "m", "Signor": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Frau": "f", "Madame": "f", "Mademoiselle": "f", "Mme": "f", "Mlle": "f", "Señora": "f", "Señorita": "f", "Doña": "f", "Signora": "f",
    "Dr": "u", "Prof": "u", "Professor": "u", "Dra": "f", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f",
}
# Given names of each script and gender.
NAMES = {
    ("latin", "m"): "Adam Albert Alexander Andrew Anthony Arthur Ben Carl Carlos Charles Daniel David Edward Eric Felix Frank George Hans Henry Hugo Ivan Jack James Jean John Jose Juan Karl Lucas Luis Marc Mark Martin Max Michael Miguel Oliver Oscar Paul Pedro Peter Philip Pierre Ralph Richard Robert Samuel Simon Stefan Stephen Thomas Tom Victor Walter William".split(),
    ("latin", "f"): "Alice Amelie Anna Anne Barbara Beatrice Carla Carmen Caroline Catherine Charlotte Clara Claire Diana Elena Elizabeth Ella Emily Emma Eva Fiona Grace Hannah Helen Ines Isabel Jane Jessica Julia Karen Laura Lena Lucia Lucy Maria Marie Martha Mary Monica Nora Olivia Paula Rachel Rosa Ruth Sarah Sofia Sophie Susan Teresa Ursula Vera Victoria".split(),
    ("cyrillic", "m"): "Александр Алексей Андрей Борис Виктор Владимир Дмитрий Иван Игорь Михаил Николай Олег Павел Пётр Сергей Юрий".split(),
    ("cyrillic", "f"): "Александра Анна Валентина Вера Екатерина Елена Ирина Людмила Мария Надежда Наталья Ольга Светлана Софья Татьяна Юлия".split(),
}
_GENDER = {n: k for k, own in NAMES.items() for n in own}
_PERSON = re.compile(r"(?<!\w)(" + "|".join(sorted(TITLES, key=len, reverse=True)) + r")(?!\w)\.?[ \t]+([^\W\d_][^\W\d_'’-]+(?:[ \t]+[^\W\d_][^\W\d_'’-]+){0,2})")

# Letters by script, vowels apart from consonants, so that made-up names can be read.
LETTERS = {"latin": ("aeiouy", "bcdfghjklmnpqrstvwxz"), "cyrillic": ("аеиоуыэюя", "бвгджзклмнпрстфхцчшщ"), "greek": ("αεηιουω", "βγδζθκλμνξπρστφχψ")}
_HEX = "0123456789abcdef"
_CLASSES = ["0123456789", "abcdefghijklmnopqrstuvwxyz"]
RESERVED = (".example.com", ".example.org", ".example.net", ".example", ".test", ".invalid")


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form) of every entity, by place, without overlaps."""
    found: list[tuple[int, int, str, str]] = []
    if "@" in text:
        found += [(*m.span(), "email", m[0].lower()) for m in _EMAIL.finditer(text)]
    if _DIGIT.search(text):
        found += [(*m.span(), "ip", m[0]) for m in _IP.finditer(text)]
        for m in _CARD.finditer(text):
            digits = re.sub(r"\D", "", m[0])
            if 13 <= len(digits) <= 19 and (len(digits) in (15, 16) or _luhn(digits)):
                found.append((*m.span(), "card", digits))
        for m in _PHONE.finditer(text):
            digits = re.sub(r"\D", "", m[0])
            if 7 <= len(digits) <= 15:
                found.append((*m.span(), "phone", f"+{digits}" if m[0][0] == "+" else f"+1{digits}"))
        found += [(*m.span(), "ssn", m[0].replace("-", "")) for m in _SSN.finditer(text)]
        found += [(*m.span(), "iban", re.sub(" ", "", m[0])) for m in _IBAN.finditer(text) if _iban(re.sub(" ", "", m[0]))]
        found += [(*m.span(), "key", m[0]) for m in _KEY.finditer(text)]
        found += [(*m.span(1), "secret", m[1]) for m in _SECRET.finditer(text)]
    if any(t in text for t in TITLES):
        for m in _PERSON.finditer(text):
            at = m.start(2)
            names = [w for w in re.finditer(r"\S+", m[2])]
            names = names[: next((i for i, w in enumerate(names) if not w[0][0].isupper()), len(names))]
            for i, w in enumerate(names):
                given = i == 0 and (len(names) > 1 or w[0].capitalize() in _GENDER)
                gender = _GENDER.get(w[0].capitalize(), ("", TITLES[m[1]]))[1]
                found.append((at + w.start(), at + w.end(), f"given-{gender}" if given else "surname", w[0].lower()))
    own: dict[str, str] = {}
    for _, _, kind, norm in found:
        if kind == "surname" or kind.startswith("given"):
            own.setdefault(norm, kind)
    if own:  # the document's own names, wherever else it writes them
        found += [(*m.span(), own[m[0].lower()], m[0].lower()) for m in _WORD.finditer(text) if m[0][0].isupper() and m[0].lower() in own]
    found.sort(key=lambda x: (x[0], -x[1]))
    out: list[tuple[int, int, str, str]] = []
    for x in found:
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


_DIGIT = re.compile(r"\d")
_WORD = re.compile(r"(?<!\w)[^\W\d_]{2,}(?!\w)")


def _luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def _iban(code: str) -> bool:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def permute(x: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0 .. size-1."""
    if size < 2:
        return x
    a = 1
    while a * a < size:
        a <<= 1
    b = -(-size // a)
    secret = hashlib.sha256(key).digest()

    def draw(turn: int, half: int, mod: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{turn}|{half}|{tweak}".encode(), key=secret, digest_size=64).digest()) % mod

    while True:
        left, right = divmod(x, b)
        for turn in range(8):
            if turn % 2:
                right = (right + draw(turn, left, b)) % b
            else:
                left = (left + draw(turn, right, a)) % a
        x = left * b + right
        if x < size:
            return x


def _decoded(text: str, alphabets: list[str], x: int) -> str:
    """Text number x of the texts that have these alphabets and the same characters at the other places."""
    out = []
    for c, own in zip(reversed(text), reversed(alphabets), strict=True):
        if own:
            x, digit = divmod(x, len(own))
            c = own[digit]
        out.append(c)
    return "".join(reversed(out))


def _size(alphabets: list[str]) -> int:
    return functools.reduce(lambda n, a: n * (len(a) or 1), alphabets, 1)


def _spell(text: str, alphabets: list[str], key: bytes, tweak: str, valid=lambda s: True) -> str | None:
    """Permute the characters at the places that have an alphabet; the others stay. Walks on while the result is not valid;
    None if no step of the walk gives a valid one."""
    size, x = _size(alphabets), 0
    for c, own in zip(text, alphabets, strict=True):
        if own:
            x = x * len(own) + own.index(c)
    shape = "".join("-" if not a else str(len(a) % 10) for a in alphabets)
    for _ in range(WALK if size > 1 else 1):
        x = permute(x, size, key, f"{tweak}|{shape}|" + "".join(c for c, a in zip(text, alphabets, strict=True) if not a))
        made = _decoded(text, alphabets, x)
        if valid(made):
            return made
    return None


@functools.cache
def _kin(c: str, without: str) -> str:
    """The letters or digits of c's script, category and case in its block of 256 characters; characters alone in theirs are kin."""
    if not c.isalnum():
        return ""
    kind = lambda x: (unicodedata.name(x, "").split(" ")[0], unicodedata.category(x), x.lower() == x, len(x.upper()) == 1 and x.upper().lower() == x)
    groups: dict[tuple, str] = {}
    for x in map(chr, range(ord(c) & ~255, (ord(c) | 255) + 1)):
        if x.isalnum() and x not in without:
            groups[kind(x)] = groups.get(kind(x), "") + x
    own = groups.get(kind(c), c)
    own = own if len(own) > 1 else "".join(g for g in groups.values() if len(g) == 1)
    return own if len(own) > 1 else ""


def _alphabets(text: str, known: list[str]) -> list[str]:
    without = "".join(known)
    return [next((a for a in known if c in a), "") or _kin(c, without) for c in text]


def _form(kind: str, norm: str):
    """The format of an entity that is spelled: what stays before, the body, its alphabets, what stays after, valid bodies."""
    other = lambda s: s != norm
    if kind == "email":
        local, _, domain = norm.partition("@")
        tail = next((r for r in RESERVED if f".{domain}".endswith(r)), "." + domain.rpartition(".")[2])
        head = f".{domain}"[: -len(tail)][1:] if len(tail) <= len(domain) else ""
        body, tail = f"{local}@{head}", tail if head else tail[1:]
        return "", body, _alphabets(body, _CLASSES), tail, lambda s: s != body
    if kind == "card":
        kept = _luhn(norm)
        return "", norm, ["", *[_CLASSES[0]] * (len(norm) - 1)], "", lambda s: _luhn(s) == kept and s != norm
    if kind == "phone":
        fixed = 2 if norm.startswith("+1") or len(norm) < 10 else 3
        north = norm.startswith("+1") and len(norm) == 12
        return "", norm, [""] * fixed + [_CLASSES[0]] * (len(norm) - fixed), "", lambda s: s != norm and (not north or s[2] in "23456789" and s[5] in "23456789")
    if kind == "ssn":
        return "", norm, [_CLASSES[0]] * 9, "", lambda s: s != norm and s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"
    if kind == "iban":
        return norm[:2], norm[4:], [("0123456789" if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ") for c in norm[4:]], "", lambda s: s != norm[4:]
    if kind == "key":
        return "", norm, [""] * 4 + ["ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"] * 16, "", other
    if kind == "secret":
        if re.fullmatch("[0-9a-f]+|[0-9A-F]+", norm):
            return "", norm, [_HEX if norm.lower() == norm else _HEX.upper()] * len(norm), "", other
        return "", norm, ["0123456789" if "0" <= c <= "9" else _CLASSES[1] if "a" <= c <= "z" else _CLASSES[1].upper() if "A" <= c <= "Z" else "" for c in norm], "", other
    return "", norm, _alphabets(norm, [v for own in LETTERS.values() for v in own]), "", lambda s: s != norm and s.capitalize() not in _GENDER


def _whole(kind: str, before: str, body: str, after: str) -> str:
    if kind == "iban":
        check = 98 - int("".join(str(int(c, 36)) for c in body + before + "00")) % 97
        return f"{before}{check:02d}{body}"
    return before + body + after


def _token(kind: str, norm: str, key: bytes, tweak: str) -> str:
    """A keyed token for an entity whose own format has no value for it."""
    h = hashlib.blake2b(f"{tweak}|{norm}".encode(), key=hashlib.sha256(key).digest(), digest_size=32).hexdigest()
    if kind == "email":
        before, body, _, after, _ = _form(kind, norm)
        return f"u{h[:12]}@{'h' + h[12:20] if not body.endswith('@') else ''}{after}"
    if kind == "ip":
        return ":".join(["fd" + h[:2], *(h[i : i + 4] for i in range(2, 30, 4))])
    if kind in ("card", "phone", "ssn"):
        fixed = {"card": 1, "phone": 2 if norm.startswith("+1") or len(norm) < 10 else 3, "ssn": 0}[kind]
        return norm[:fixed] + f"{int(h, 16) % 10**24:024d}"
    if kind == "iban":
        return _whole(kind, norm[:2], f"{int(h, 16) % 10**30:030d}", "")
    if kind in ("key", "secret"):
        return (norm[:4] + h[:40].upper()) if kind == "key" else h[:48]
    return "".join("bdfgklmnprstvzjh"[int(x, 16)] + "aeio"[int(y, 16) % 4] for x, y in zip(h[:12:2], h[1:12:2], strict=True)) + ("n" if int(h[13], 16) % 2 else "")


@functools.lru_cache(maxsize=20_000)
def surrogate(kind: str, norm: str, key: bytes = _OWN_KEY, attempt: int = 0) -> str:
    """The normal form of the entity's surrogate."""
    tweak = f"{kind}|{attempt}"
    if attempt >= WIDE:
        return _token(kind, norm, key, tweak)
    if kind == "ip":
        value = int.from_bytes(bytes(map(int, norm.split("."))))
        free = _free(norm)
        low = value % 2**free
        for _ in range(WALK):
            low = permute(low, 2**free, key, f"{tweak}|{value >> free}")
            made = ".".join(map(str, ((value >> free << free) + low).to_bytes(4)))
            if _range(made) == _range(norm) and made != norm:
                return made
        return norm
    gender = kind.partition("-")[2]
    if kind.startswith("given"):
        for (_script, g), pool in NAMES.items():
            if g == (gender if gender != "u" else g) and norm.capitalize() in pool:
                return _pooled(pool, norm, key, f"{tweak}|{g}")
    before, body, alphabets, after, valid = _form(kind, norm)
    made = _spell(body, alphabets, key, tweak + (before if kind == "iban" else after), valid)
    if made is None:  # nothing valid on this walk: the entity itself, which the collision check draws again
        return _token(kind, norm, key, tweak) if _size(alphabets) == 1 or kind.startswith("given") else norm
    return _whole(kind, before, made, after)


def _format(kind: str, norm: str) -> tuple[str, int]:
    """A name of the entity's format, and how many values it has, valid or not."""
    if kind == "ip":
        free = _free(norm)
        return f"ip|{int.from_bytes(bytes(map(int, norm.split('.')))) >> free}|{free}", 2**free
    before, body, alphabets, after, _ = _form(kind, norm)
    parts = "\0".join([kind, before, after, *(a or "=" + c for c, a in zip(body, alphabets, strict=True))])
    return hashlib.blake2b(parts.encode(), digest_size=16).hexdigest(), _size(alphabets)


def _member(kind: str, norm: str, x: int) -> str | None:
    """Value number x of the format of an entity, if it is valid."""
    if kind == "ip":
        free = _free(norm)
        made = ".".join(map(str, ((int.from_bytes(bytes(map(int, norm.split(".")))) >> free << free) + x).to_bytes(4)))
        return made if _range(made) == _range(norm) else None
    before, body, alphabets, after, valid = _form(kind, norm)
    made = _decoded(body, alphabets, x)
    return _whole(kind, before, made, after) if valid(made) else None


def _free(ip: str) -> int:
    return {"private10": 24, "private172": 20, "private192": 16, "special": 24}.get(_range(ip), 32)


def _pooled(pool: list[str], norm: str, key: bytes, tweak: str) -> str:
    """Another name of the pool, a different one for each: the next of the pool in keyed order."""
    order = sorted(range(len(pool)), key=lambda i: permute(i, len(pool), key, tweak))
    place = order.index(pool.index(norm.capitalize()))
    return pool[order[(place + 1) % len(pool)]].lower()


def _range(ip: str) -> str:
    a, b = map(int, ip.split(".")[:2])
    if a == 10 or a == 172 and 16 <= b < 32 or a == 192 and b == 168:
        return f"private{a}"
    return "special" if a in (0, 127) or a >= 224 or a == 169 and b == 254 else "public"


def render(kind: str, original: str, norm: str, made: str) -> str:
    """The surrogate as the original is written: its punctuation and its capitals."""
    if kind in ("card", "phone", "ssn", "iban") and len(made) != len(norm):
        return made
    if kind in ("card", "phone", "ssn"):
        digits = made.lstrip("+")
        n = sum(c.isdigit() for c in original)
        own = iter(digits[len(digits) - n :])
        return "".join(next(own) if c.isdigit() else c for c in original)
    if kind == "iban":
        own = iter(made)
        return "".join(c if c == " " else next(own) for c in original)
    if kind == "email" or kind == "surname" or kind.startswith("given"):
        if original.isupper():
            return "".join(c.upper() if len(c.upper()) == 1 else c for c in made)
        if kind != "email" and len(made) != len(original):
            return made.capitalize() if original[:1].isupper() else made
        return "".join(m.upper() if o.isupper() and len(m.upper()) == 1 else m for o, m in zip(original, made, strict=False)) + made[len(original) :]
    return made


def replace(text: str | None, key: bytes = _OWN_KEY, later: dict[tuple[str, str], str] | None = None) -> tuple[str | None, list[dict]]:
    """The text with surrogates, and the entities (kind, places in the given text, surrogate as written)."""
    if not text:
        return text, []
    out, spans, done = [], [], 0
    for a, b, kind, norm in detect(text):
        made = render(kind, text[a:b], norm, (later or {}).get((kind, norm)) or surrogate(kind, norm, key))
        out += [text[done:a], made]
        spans.append({"kind": kind, "start": a, "end": b, "surrogate": made})
        done = b
    return "".join(out) + text[done:], spans


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """The distinct entities (kind, norm) of the texts."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = sorted({x[2:] for t in batch.column(0).to_pylist() if t for x in detect(t)})
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in own], pa.string()), pa.array([n for _, n in own], pa.string())], names=["kind", "norm"])

    return docs.select(text).mapInArrow(run, "kind string, norm string").distinct()


def _drawn(rows: DataFrame, key: bytes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [surrogate(k, n, key, a) for k, n, a in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.string())], names=["kind", "norm", "attempt", "made"])

    return rows.mapInArrow(run, "kind string, norm string, attempt int, made string")


def assign(found: DataFrame, key: bytes, attempts: int = 12) -> DataFrame:
    """kind, norm, attempt, made: a surrogate for every distinct entity that is no entity of the corpus and no other's
    surrogate. Given names come from pools and may name another person of the corpus, but never two the same."""
    found = written(found, "entities")
    made = written(_drawn(found.select("kind", "norm", F.lit(0).alias("attempt")), key), "surrogates")
    for k in range(attempts):
        clash = _clashes(made, found)
        if clash.isEmpty():
            return made
        made = _redrawn(made, clash, _drawn(clash.select("kind", "norm", F.lit(k + 1).alias("attempt")), key))
    clash = _clashes(made, found)
    if not clash.isEmpty():
        kept = made.join(clash, ["kind", "norm"], "left_anti")
        made = _redrawn(made, clash, _listed(clash, kept, found, key))
    k = 0
    while not (clash := _clashes(made, found)).isEmpty():  # what no format has room for; tokens of 48 bits and more
        k += 1
        made = _redrawn(made, clash, _drawn(clash.select("kind", "norm", F.lit(WIDE + k).alias("attempt")), key))
    return made


def _clashes(made: DataFrame, found: DataFrame) -> DataFrame:
    """kind, norm of the entities whose surrogate is an entity, missing, or that of another entity of an earlier attempt."""
    real = made.where("kind not like 'given-%'").join(found.select("kind", F.col("norm").alias("made")), ["kind", "made"], "left_semi").select("kind", "norm")
    first = F.min(F.struct("attempt", "norm")).over(Window.partitionBy("kind", "made"))
    twice = made.where("made is not null").withColumn("first", first).where("first.norm <> norm").select("kind", "norm")
    return written(real.unionByName(twice).unionByName(made.where("made is null").select("kind", "norm")).distinct(), "clashes")


def _redrawn(made: DataFrame, clash: DataFrame, again: DataFrame) -> DataFrame:
    out = written(made.join(clash, ["kind", "norm"], "left_anti").select("kind", "norm", "attempt", "made").unionByName(again), "surrogates")
    freed(made, clash)
    return out


def _listed(clash: DataFrame, kept: DataFrame, found: DataFrame, key: bytes) -> DataFrame:
    """The entities, each with a free value of its format of its own, in keyed order; null where the format has none left."""

    def formats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [_format(k, n) for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f for f, _ in own], pa.string()), pa.array([min(n, LISTED + 1) for _, n in own], pa.int64())], names=["kind", "norm", "format", "size"])

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [_member(k, n, x) for k, n, x in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.string())], names=["format", "kind", "made"])

    secret = hashlib.sha256(key).hexdigest()
    place = lambda c: F.row_number().over(Window.partitionBy("format").orderBy(F.sha2(F.concat(F.lit(secret), c), 256), c)).alias("place")
    rows = written(clash.select("kind", "norm").mapInArrow(formats, "kind string, norm string, format string, size bigint"), "formats")
    some = rows.where(F.col("size") <= LISTED).groupBy("format").agg(F.min(F.struct("kind", "norm")).alias("one"), F.max("size").alias("size"))
    runs = some.select("format", "one.kind", "one.norm", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(4096).cast("bigint"))).alias("x")).repartition("format", "x")
    each = runs.select("format", "kind", "norm", F.explode(F.sequence("x", F.least(F.col("x") + 4095, F.col("size") - 1))).alias("x"))
    free = each.mapInArrow(members, "format string, kind string, made string").where("made is not null").distinct()
    free = free.join(found.select("kind", F.col("norm").alias("made")), ["kind", "made"], "left_anti").join(kept.select("kind", "made"), ["kind", "made"], "left_anti")
    mine = rows.select("kind", "norm", "format", place(F.col("norm")))
    return mine.join(free.select("format", "made", place(F.col("made"))), ["format", "place"], "left").select("kind", "norm", F.lit(WIDE).alias("attempt"), "made")


def session_key(spark: SparkSession) -> bytes:
    """The key that the session sets, or this program's own."""
    found = spark.conf.get(KEY_SETTING, None)
    return found.encode() if found else _OWN_KEY


SPANS = "array<struct<kind:string,start:int,end:int,surrogate:string>>"


def anonymise(docs: DataFrame, key: bytes | None = None, text: str = "text", block: int = BLOCK, spans: str | None = "entities") -> DataFrame:
    """All columns, with surrogates in the text, and under the name `spans` (if any) the entities: kind, start and end in the
    given text, surrogate."""
    spark = docs.sparkSession
    prepare(spark)
    key = session_key(spark) if key is None else key
    later = written(assign(entities(docs, text), key).where("attempt > 0").select("kind", "norm", "made"), "later")
    few = later.limit(block + 1).collect()  # bounded by `block`
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text).alias("text"), F.lit(None).cast("map<string,string>").alias("later"))
    if len(few) <= block:
        known = {(r["kind"], r["norm"]): r["made"] for r in few}
    else:
        known, rows = {}, _with_later(rows, later)
    sent = spark.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())]))
        for batch in batches:
            done = []
            for t, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                done.append(replace(t, key, {tuple(k.split("\0", 1)): v for k, v in own} if own else sent.value))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([s for _, s in done], kind)], names=["row", "text", "spans"])

    out = rows.mapInArrow(run, rows.select("row", "text", F.lit(None).cast(SPANS).alias("spans")).schema)
    columns = [F.col("text").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns if c != spans]
    return out.select(*columns, *([F.col("spans").alias(spans)] if spans else []))


def _with_later(rows: DataFrame, later: DataFrame) -> DataFrame:
    """rows, each with the surrogates of later attempts that its text needs: joined by entity, gathered for each text."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [[{"kind": k, "norm": n} for k, n in sorted({x[2:] for x in detect(t or "")})] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.list_(pa.struct([("kind", pa.string()), ("norm", pa.string())])))], names=["row", "text", "has"])

    schema = rows.select("row", "text", F.lit(None).cast("array<struct<kind:string,norm:string>>").alias("has")).schema
    rows = written(rows.select("row", "text").mapInArrow(found, schema).withColumn("at", F.monotonically_increasing_id()), "found")
    each = rows.select("at", F.explode("has").alias("x")).select("at", "x.*").join(later, ["kind", "norm"])
    own = each.groupBy("at").agg(F.map_from_entries(F.collect_list(F.struct(F.concat("kind", F.lit("\0"), "norm"), "made"))).alias("later"))  # of one text
    return rows.join(own, "at", "left").select("row", "text", "later")


def op6(spark, sf_dir: str) -> DataFrame:
    out = anonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.size("entities").alias("n_entities"), F.array_join(F.transform("entities", lambda e: e["kind"]), ",").alias("kinds"))
