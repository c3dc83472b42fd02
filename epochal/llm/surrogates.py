"""Personal data replaced by keyed, type-consistent surrogates.

Found are e-mail addresses, telephone numbers, IPv4 and IPv6 addresses, card and
account numbers, IBANs, social-security numbers, secrets (passwords, tokens,
access keys) and names: after a title, or a known given name before a surname.
A name that a document gives away so is found wherever the document mentions it
again, whole or in part, with or without title. A mention is reduced to a
canonical form (addresses in lower case, numbers without separators, names by
given name and surname), so that mentions of one entity share a surrogate
wherever and however they are written, and the parts of a name agree with the
whole. The surrogate is drawn from a keyed hash of type, canonical form and
attempt, and written in the mention's own format: separators, letter case,
number of digits, country code, check digits (cards, IBANs), script of letters,
and for names title, gender and script. Without the key no surrogate can be
traced back by trying all entities; the key has no default.

Collision checks: the distinct entities of all documents form a table. Attempt 0
holds unless the surrogate equals an entity of the corpus or another entity's
surrogate, of whatever type; then the entity takes the next attempt, until all
surrogates differ from each other and from all entities. A shape with too few
surrogates for its entities can't block this: later attempts leave the country
code, then add characters. Only entities beyond attempt 0 need a table when
texts are rewritten. It is broadcast up to ``BROADCAST_ROWS`` rows, and beyond
that joined by document.

Null text stays null, empty text empty; texts of any length are searched whole.
Ids aren't used: they may be null or repeat, and rows that repeat become rows
that repeat. Equal mentions that start together are settled by the longer one.
Other columns pass through unchanged. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released, saved, slices, unused

BROADCAST_ROWS = 50_000
#: Fewest and most digits of a telephone number with a country code; fewer are signed numbers, such as price changes.
PHONE_DIGITS, MOST_DIGITS = 8, 15

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NUMERIC = re.compile(
    r"(?P<ip>(?<![\d.])" + _OCTET + r"(?:\." + _OCTET + r"){3}(?!\.?\d))"
    r"|(?P<phone>(?<![\w(])\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?!\d|[.-]\d)|(?<![\w.-])(?<!\d )[2-9]\d\d [1-9]\d\d[ -]\d{4}(?! ?\d|[.-]\d)|(?<![\w.-])(?<!\d )0\d{2,4} \d{3,4} \d{3,4}(?! ?\d|[.-]\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<card>(?<!\d)(?:\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}|\d{13,19})(?!\d))"
)
#: Numbers with a country code: the first digits, then each further group with its separator.
_PLUS = re.compile(r"(?<![\w+])\+([1-9]\d{0,14})(?!\d)")
_AREA = re.compile(r"[ .-]?\((\d{1,5})\)[ .-]?(\d{1,12})(?!\d)")
_DECIMAL = re.compile(r"[.,]\d")
_GROUP = re.compile(r"([ .-])(\d{1,12})(?!\d)")
_SECRET = re.compile(r"(?P<key>(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9]))|(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?)(?P<secret>(?=[A-Za-z_\-/+]*\d)[A-Za-z0-9_\-/+]{6,}={0,2})")
#: Titles with the gender they tell (fixed values).
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Señor": "m", "Señora": "f", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f"}
_NAME = re.compile(r"(?<!\w)(?P<title>" + "|".join(sorted(TITLES, key=len, reverse=True)) + r")(?P<gap>\.? )(?P<name>[^\W\d_a-z][^\W\d_]+(?: [^\W\d_a-z][^\W\d_]+)?)(?!\w)")
#: Candidates of IPv6 addresses, which the library then reads.
_IP6 = re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f:]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{6,39}(?![\w:]|\.\d)")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.!#$%&'*+/=?^_`{|}~-")
_DOMAIN = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,24}")
#: Given names by script and gender: known before a surname, and used as surrogates (fixed values).
GIVEN = {
    ("latin", "m"): ["Adam", "Anton", "Boris", "Carl", "Charles", "Daniel", "David", "Edward", "Erik", "Felix", "Frank", "George", "Henry", "Hugo", "Ivan", "James", "John", "Jonas", "Joseph", "Karl", "Kevin", "Lukas", "Mark", "Martin", "Michael", "Oliver", "Oscar", "Paul", "Peter", "Richard", "Robert", "Simon", "Stefan", "Thomas", "Victor", "William"],
    ("latin", "f"): ["Alice", "Anna", "Barbara", "Berta", "Clara", "Diana", "Dora", "Elena", "Elizabeth", "Emma", "Flora", "Greta", "Hanna", "Helen", "Irene", "Jane", "Julia", "Karen", "Laura", "Linda", "Lucy", "Maria", "Marta", "Mary", "Monica", "Nina", "Nora", "Olivia", "Patricia", "Paula", "Rosa", "Sarah", "Sofia", "Susan", "Teresa", "Vera"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Григорий", "Дмитрий", "Иван", "Михаил", "Николай", "Павел", "Роман", "Сергей", "Юрий"],
    ("cyrillic", "f"): ["Анна", "Вера", "Галина", "Елена", "Ирина", "Мария", "Надежда", "Нина", "Ольга", "Светлана", "Татьяна", "Юлия"],
    ("greek", "m"): ["Αλέξανδρος", "Γιάννης", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Παύλος", "Πέτρος"],
    ("greek", "f"): ["Άννα", "Βασιλική", "Ελένη", "Ειρήνη", "Κατερίνα", "Μαρία", "Σοφία", "Χριστίνα"],
}
_GENDER = {n: g for (_, g), names in GIVEN.items() for n in names}
_KNOWN = re.compile(r"(?<!\w)(?P<given>" + "|".join(sorted(_GENDER, key=len, reverse=True)) + r") (?P<surname>[^\W\d_a-z][^\W\d_]{2,})(?!\w)")
#: Ends of made-up given names, by script and gender.
ENDS = {("latin", "m"): "n", ("latin", "f"): "na", ("cyrillic", "m"): "н", ("cyrillic", "f"): "на", ("greek", "m"): "νος", ("greek", "f"): "να"}
#: Syllables of surrogate surnames by script.
SYLLABLES = {"latin": ["ba", "del", "ko", "lin", "mar", "ner", "os", "ra", "sten", "ti", "ver", "wald"], "cyrillic": ["ба", "вер", "дол", "кин", "лев", "мар", "нов", "рос", "сан", "тов"], "greek": ["βα", "δο", "κα", "λι", "μα", "νο", "πα", "ρα", "στα", "τη"]}
_ALPHABET = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}


def script(ch: str) -> str:
    return "cyrillic" if "\u0400" <= ch <= "\u04ff" else "greek" if "\u0370" <= ch <= "\u03ff" else "latin"


def _phone_end(text: str, m: re.Match) -> int:
    """End of the telephone number that starts at a match of ``_PLUS``; 0 if it is none.

    It takes all further groups of digits that one number can have. Decimals, a
    card or an address end it; once it has enough digits, so does a separator
    other than before, except ``-``.
    """
    n, at, before, groups = len(m[1]), m.end(), None, 1
    full = 11 if m[1][0] == "1" else MOST_DIGITS
    if n <= 3 and (a := _AREA.match(text, at)):
        n, at, groups = n + len(a[1]) + len(a[2]), a.end(), 2
    while n < full and (g := _GROUP.match(text, at)):
        sep, digits = g.groups()
        enough = n >= PHONE_DIGITS
        if n + len(digits) > MOST_DIGITS or before == "." != sep or before == " " and sep == "." and groups > 2:
            break
        if enough and sep != "-" and (len(digits) < 2 or groups == 1 or sep != (before or sep) or _DECIMAL.match(text, g.end()) and sep != "."):
            break
        other = _NUMERIC.match(text, g.start(2))
        kind = other and other.lastgroup
        if kind == "ip" or kind in ("ssn", "card") and enough:
            break
        if kind == "card" and n + len(digits) != full and (n <= 3 or luhn("".join(filter(str.isdigit, other[0]))) == 0):
            break
        n, at, before, groups = n + len(digits), g.end(), sep, groups + 1
    if not PHONE_DIGITS <= n <= MOST_DIGITS or n < full and text[at : at + 1] == "." and _DECIMAL.match(text, at):
        return 0
    if groups == 2 and before == "." and (len(m[1]) > 3 or n < 11):  # a decimal
        return 0
    return at


def find(text: str) -> list[tuple[int, int, str, str]]:
    """Mentions that don't overlap: start, end, type and canonical form."""
    found = []
    at = text.find("@")
    while at >= 0:
        a = at
        while a and text[a - 1] in _LOCAL or a and text[a - 1].isalpha():
            a -= 1
        while a < at and text[a] in ".!#$%&'*+/=?^`{|}~-":
            a += 1
        m = _DOMAIN.match(text, at + 1)
        if a < at and m:
            found.append((a, m.end(), "email", text[a : m.end()].lower()))
        at = text.find("@", at + 1)
    if "AKIA" in text or "=" in text or ":" in text:
        for m in _SECRET.finditer(text):
            k = m.lastgroup
            found.append((m.start(k), m.end(k), k, m.group(k)))
    if "::" in text or text.count(":") > 6:
        for m in _IP6.finditer(text):
            try:
                canon = str(ipaddress.IPv6Address(m[0].rstrip(":") if m[0][-2:] != "::" else m[0]))
            except ValueError:
                continue
            if any(c.isdigit() for c in m[0]):
                found.append((m.start(), m.end() - (m[0][-1] == ":" and m[0][-2:] != "::"), "ip6", canon))
    if _DIGIT.search(text):
        at = 0
        for m in [*_PLUS.finditer(text), None]:
            end = _phone_end(text, m) if m and m.start() >= at else 0
            if m and not end:
                continue
            for x in _NUMERIC.finditer(text, at, m.start() if m else len(text)):
                k = next(k for k in ("ip", "phone", "ssn", "iban", "card") if x.group(k) is not None)
                s = x.group(k)
                found.append((x.start(), x.end(), k, s if k == "ip" else "".join(c for c in s if c.isalnum())))
            if m:
                found.append((m.start(), end, "phone", "+" + "".join(c for c in text[m.start() : end] if c.isdigit())))
                at = end
    if _TITLE.search(text):
        found += names(text)
    if len(found) < 2:
        return found
    found.sort(key=lambda x: (x[0], -x[1]))
    out = found[:1]
    for x in found[1:]:
        if x[0] >= out[-1][1]:
            out.append(x)
    return out


_DIGIT = re.compile(r"\d{2}")
_TITLE = re.compile("|".join([*TITLES, *_GENDER]))


def names(text: str) -> list[tuple[int, int, str, str]]:
    """Parts of names: those that a title or a known given name tells, and all mentions of the same parts."""
    told: dict[int, tuple[int, str]] = {}  # start: end, type
    for m in _NAME.finditer(text):
        a, parts = m.start("name"), m["name"].split(" ")
        if len(parts) == 2:
            told[a] = a + len(parts[0]), "given_" + TITLES[m["title"]]
        told[m.end("name") - len(parts[-1])] = m.end("name"), "surname"
    for m in _KNOWN.finditer(text):
        told.setdefault(m.start("given"), (m.end("given"), "given_" + _GENDER[m["given"]]))
        told.setdefault(m.start("surname"), (m.end("surname"), "surname"))
    if not told:
        return []
    kinds: dict[str, str] = {}
    for a, (b, kind) in sorted(told.items()):
        kinds.setdefault(text[a:b], kind)
        kinds.setdefault(text[a:b].upper(), kind)
    again = re.compile(r"(?<!\w)(?:" + "|".join(sorted(map(re.escape, kinds), key=len, reverse=True)) + r")(?!\w)")
    for m in again.finditer(text):
        told.setdefault(m.start(), (m.end(), kinds[m[0]]))
    return [(a, b, kind, text[a:b].lower()) for a, (b, kind) in told.items()]


class _Draw:
    """A keyed stream of numbers."""

    def __init__(self, *what: str, key: bytes):
        self.seed, self.n, self.pool = "\0".join(what).encode(), 0, 0
        self.key = key
        self.left = 0

    def below(self, n: int) -> int:
        if self.left < 1 << 64:
            self.pool = int.from_bytes(hashlib.blake2b(self.seed + self.n.to_bytes(4, "big"), key=self.key, digest_size=64).digest(), "big")
            self.left = 1 << 512
            self.n += 1
        self.pool, x = divmod(self.pool, n)
        self.left //= n
        return x


def _letters(s: str, d: _Draw, hexadecimal: bool = False) -> str:
    """Each letter and digit of ``s`` replaced by one of its kind and script."""
    out = []
    for c in s:
        if c.isdigit():
            out.append("0123456789"[d.below(10)])
        elif c.isalpha():
            letters = "abcdef" if hexadecimal and c.lower() in "abcdef" else _ALPHABET[script(c)]
            x = letters[d.below(len(letters))]
            out.append(x.upper() if c.isupper() else x)
        else:
            out.append(c)
    return "".join(out)


def luhn(digits: str) -> int:
    """Luhn sum modulo 10: 0 for a valid number."""
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10


def mod97(iban: str) -> int:
    """Remainder of an IBAN: 1 for a valid one."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def surrogate(kind: str, canon: str, attempt: int, key: bytes) -> str:
    """The canonical surrogate of an entity at an attempt."""
    d = _Draw(kind, canon, str(attempt), key=key)
    longer = "0" * (attempt // 8)  # where a shape runs out
    if kind == "email":
        local, _, domain = canon.rpartition("@")
        new = _letters(local, d)
        if attempt >= 4:  # short names run out: lengthen
            new = "".join(_ALPHABET["latin"][d.below(26)] for _ in range(attempt)) + new
        parts = domain.split(".")
        return new + "@" + (domain if parts[-2] == "example" else "example." + (parts[-1] if parts[-1] in ("com", "net", "org") else "com"))
    if kind == "ip" and attempt < 64:
        return ".".join(str(1 + d.below(254)) for _ in range(4))
    if kind in ("ip", "ip6"):
        return str(ipaddress.IPv6Address((0x20010DB8 << 96) + d.below(1 << 96)))
    if kind == "phone":
        keep = 2 if canon.startswith("+1") else 3 if canon.startswith("+") else 0
        if attempt >= 4 and keep:  # short numbers run out: leave the country code
            return "+" + str(1 + d.below(9)) + _letters(canon[2:] + longer, d)
        return canon[:keep] + _letters(canon[keep:] + longer, d)
    if kind == "card":
        new = _letters(canon + longer, d)
        if luhn(canon) == 0:
            new = new[:-1] + str((10 - luhn(new[:-1] + "0")) % 10)
        return new
    if kind == "iban":
        account = _letters(canon[4:] + longer, d)
        check = 98 - mod97(canon[:2] + "00" + account) if mod97(canon) == 1 else d.below(100)
        return f"{canon[:2]}{check:02d}{account}"
    if kind == "key":
        return canon[:4] + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[d.below(32)] for _ in canon[4:])
    if kind == "secret":
        return _letters(canon + longer, d, hexadecimal=re.fullmatch(r"[0-9a-fA-F]+", canon) is not None)
    if kind == "surname" or kind.startswith("given"):
        x = script(canon[0])
        if kind != "surname" and attempt < 4:
            given = GIVEN[x, kind[-1]]
            return given[d.below(len(given))].lower()
        stem = "".join(SYLLABLES[x][d.below(len(SYLLABLES[x]))] for _ in range(3 + attempt // 4))
        return stem if kind == "surname" else stem + ENDS[x, kind[-1]]
    return _letters(canon + longer, d)


def written(mention: str, kind: str, new: str) -> str:
    """A canonical surrogate in the format of a mention."""
    if kind == "email":
        return new.upper() if mention.isupper() else new
    if kind in ("phone", "card", "iban", "ssn"):
        chars = iter(new)
        return "".join([*(next(chars) if c.isalnum() or c == "+" else c for c in mention), *chars])
    if kind == "ip6":
        return new.upper() if mention.isupper() else new
    if kind == "surname" or kind.startswith("given"):
        return new.upper() if mention.isupper() else new.capitalize()
    return new


def rewrite(text: str, attempts: dict[tuple[str, str], int], key: bytes) -> tuple[str, list[tuple[str, str]]]:
    """The text with surrogates, and the entities found in it."""
    found = find(text)
    if not found:
        return text, []
    out, at = [], 0
    for a, b, kind, canon in found:
        out += [text[at:a], written(text[a:b], kind, surrogate(kind, canon, attempts.get((kind, canon), 0), key))]
        at = b
    return "".join([*out, text[at:]]), [x[2:] for x in found]


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct ``(kind, canon)`` of all texts."""

    @released
    def run(batches):
        for b in batches:
            seen = set()
            for part in slices(b, text_col):
                for t in part.column(0).to_pylist():
                    if t:
                        seen.update(x[2:] for x in find(t))
            k = sorted(seen)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in k], pa.string()), pa.array([x[1] for x in k], pa.string())], names=["kind", "canon"])

    return docs.select(text_col).mapInArrow(run, "kind string, canon string").distinct()


def settle(found: DataFrame, key: bytes) -> DataFrame:
    """``(kind, canon, attempt)`` of the entities whose surrogate is not that of attempt 0."""

    @released
    def draw(batches):
        for b in batches:
            rows = [surrogate(k, c, a, key) for k, c, a in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(rows, pa.string())], names=["kind", "canon", "attempt", "new"])

    schema = "kind string, canon string, attempt int, new string"
    found = saved(found, "entities")
    taken = saved(found.withColumn("attempt", F.lit(0)).mapInArrow(draw, schema), "surrogates")
    for attempt in count(1):
        at = F.struct("attempt", "kind", "canon")
        first = taken.groupBy("new").agg(F.min(at).alias("own"), F.count("*").alias("n"))
        twice = taken.join(first.filter("n > 1"), "new").filter(at > F.col("own")).select("kind", "canon")
        original = taken.join(found.select(F.col("canon").alias("new")), "new", "left_semi").select("kind", "canon")
        again = saved(twice.unionByName(original).distinct(), "collisions")
        if again.isEmpty():
            return taken.filter("attempt > 0").select("kind", "canon", "attempt")
        kept = taken.join(again, ["kind", "canon"], "left_anti")
        taken = saved(kept.unionByName(again.withColumn("attempt", F.lit(attempt)).mapInArrow(draw, schema)), "surrogates")


def replace_entities(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """The documents with surrogates in ``text_col``, and ``n_entities`` and ``entity_kinds`` behind the other columns."""
    later = saved(settle(entities(docs, text_col), key), "later")
    n_col, k_col = unused(docs, "n_entities"), unused(docs, "entity_kinds")
    schema = T.StructType([*docs.schema.fields, T.StructField(n_col, T.LongType()), T.StructField(k_col, T.StringType())])
    names, at = [f.name for f in schema.fields], docs.columns.index(text_col)

    @released
    def changed(batches, attempts_of):
        for b in (x for whole in batches for x in slices(whole, text_col)):
            texts, n, kinds = [], [], []
            for t, attempts in zip(b.column(at).to_pylist(), attempts_of(b)):
                new, found = rewrite(t, attempts, key) if t else (t, [])
                texts.append(new)
                n.append(len(found))
                kinds.append(",".join(sorted({x[0] for x in found})))
            cols = [*b.columns[: len(names) - 2], pa.array(n, pa.int64()), pa.array(kinds, pa.string())]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    count = later.limit(BROADCAST_ROWS + 1).count()
    if count <= BROADCAST_ROWS:
        table = {(r["kind"], r["canon"]): r["attempt"] for r in later.collect()} if count else {}
        return docs.mapInArrow(lambda batches: changed(batches, lambda b: [table] * b.num_rows), schema)

    # Too many for a broadcast: each text meets the attempts of its own entities by a digest of the text.
    digest = unused(docs, "__digest")

    @released
    def mentions(batches):
        for b in (x for whole in batches for x in slices(whole, text_col)):
            rows = [(d, *x[2:]) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for x in set(find(t))]
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=[digest, "kind", "canon"])

    keyed = docs.withColumn(digest, F.sha2(F.col(text_col), 256))
    own = keyed.select(digest, text_col).mapInArrow(mentions, f"`{digest}` string, kind string, canon string").distinct().join(later, ["kind", "canon"])
    own = own.groupBy(digest).agg(F.collect_list(F.struct("kind", "canon", "attempt")).alias("__attempts"))  # a text's own entities
    both = keyed.join(own, digest, "left").select(*docs.columns, "__attempts")
    of = lambda b: [{(x["kind"], x["canon"]): x["attempt"] for x in rows or ()} for rows in b.column(len(names) - 2).to_pylist()]
    return both.mapInArrow(lambda batches: changed(batches, of), schema)
