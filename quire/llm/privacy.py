"""Surrogates for personal data.

Entities (addresses of mail, IPv4, IPv6 and phones, payment cards, secrets, names) are found by patterns and replaced by
surrogates of the same type and shape, drawn by a keyed hash of type and canonical form: an entity gets the same surrogate
wherever it stands, whatever its spelling. A card keeps a valid check digit, a phone its country, a private address stays
private, a given name keeps gender and script. Names are drawn part by part and mail addresses host by host, so that
"Mrs. Klein" goes with "Anna Klein" and two addresses of a host keep one. The distinct parts of all documents are checked
for collisions: where two would share a surrogate, or a surrogate is itself a part in the corpus, all but the least are
drawn again, from a space that grows with the draws.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
import ipaddress
import re
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import discard, written

#: Given names by script and gender (n: either), family names by script: surrogates are drawn from these first, and given
#: names of a known gender are also what marks a name that stands without a title.
GIVEN = {
    ("latin", "f"): "Alice Anna Bertha Carla Clara Diana Elena Emma Eva Frida Gloria Greta Hannah Helena Ida Irene Julia Karin Laura Lena Lucia Maria Marta Nina Nora Olga Paula Rosa Sara Sofia Teresa Vera".split(),
    ("latin", "m"): "Adam Albert Anton Boris Carlos David Diego Eduard Emil Felix Frank Georg Hugo Ivan Jakob Jan Johann Jorge Karl Leo Louis Lukas Marco Martin Max Oscar Otto Pablo Paul Peter Simon Thomas".split(),
    ("latin", "n"): "Alex Andi Ariel Casey Charlie Dominique Jamie Jules Kim Luca Morgan Noa Robin Sascha Toni Yael".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Лариса Мария Наталья Нина Ольга Светлана Софья Татьяна Юлия".split(),
    ("cyrillic", "m"): "Алексей Антон Борис Виктор Дмитрий Иван Игорь Кирилл Максим Николай Олег Павел Пётр Сергей Фёдор".split(),
    ("cyrillic", "n"): "Валя Женя Саша Слава Шура".split(),
    ("greek", "f"): "Άννα Βασιλική Ελένη Ειρήνη Κατερίνα Μαρία Σοφία".split(),
    ("greek", "m"): "Αλέξανδρος Γιώργος Δημήτρης Ιωάννης Κώστας Νίκος Πέτρος".split(),
    ("greek", "n"): [],
}
#: Further given names that mark a name; no surrogates are drawn from these.
MARKS = {
    ("latin", "f"): "Aisha Amina Ana Andrea Angela Carmen Catherine Charlotte Claire Elizabeth Emily Fatima Giulia Hana Ingrid Isabel Jane Jennifer Jessica Katarina Linda Mary Mei Michelle Monika Nadia Petra Priya Sakura Sarah Susan Yuki Zainab".split(),
    ("latin", "m"): "Abdul Ahmed Ali Andreas Antonio Bruno Charles Christian Daniel Erik Francisco George Hans Hassan Henry Hiroshi Jack James Javier Jean John José Juan Kenji Luis Mark Michael Miguel Mohammed Muhammad Omar Pedro Pierre Raj Ricardo Robert Stefan Wei William Wolfgang".split(),
}
FAMILY = {
    "latin": "Abel Baumann Becker Blanc Bonnet Castro Collins Dubois Duran Engel Fischer Fontaine Garcia Gomez Hartmann Hughes Iglesias Jansen Keller Klein Lambert Lopez Mercier Meyer Moreau Morris Navarro Novak Ortega Petit Quinn Ramos Richter Romero Sanchez Schmidt Simmons Torres Vidal Wagner Weber Young Zimmer".split(),
    "cyrillic": "Белов Волков Громов Зайцев Козлов Лебедев Морозов Новиков Орлов Павлов Соколов Титов".split(),
    "greek": "Αγγελόπουλος Γεωργίου Δημητρίου Ιωαννίδης Κωνσταντίνου Νικολάου Παπαδόπουλος".split(),
}
#: What names are put together from where the lists have no room: beginnings and vowels of syllables, and last letters by gender.
SYLLABLES = {"latin": ("b d f g h k l m n p r s t v w z br dr kr st".split(), "aeiou", {"f": "a", "m": "n", "n": "i", "": "r"}), "cyrillic": ("б в г д ж з к л м н п р с т ф".split(), "аеиоу", {"f": "а", "m": "н", "n": "и", "": "в"}), "greek": ("β γ δ ζ κ λ μ ν π ρ σ τ φ".split(), "αειου", {"f": "α", "m": "ς", "n": "ι", "": "ς"})}
TITLES = {"mr": "m", "mister": "m", "herr": "m", "monsieur": "m", "señor": "m", "sr": "m", "mrs": "f", "ms": "f", "miss": "f", "frau": "f", "madame": "f", "mme": "f", "señora": "f", "sra": "f", "dr": "", "prof": "", "г-н": "m", "г-жа": "f", "κύριος": "m", "κυρία": "f"}
#: Words after which a name of two parts or three stands.
BEFORE = ("my name is", "mein name ist", "ich heiße", "je m'appelle", "je m’appelle", "me llamo", "mi nombre es", "меня зовут", "με λένε", "full name:", "signed by", "yours sincerely,", "kind regards,")
GENDER = {name.lower(): g for table in (MARKS, GIVEN) for (_, g), names in table.items() if g != "n" for name in names}

EMAIL = re.compile(r"(?<![\w.+-])[A-Za-z0-9][\w.+%-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-])")
TOKEN = re.compile(r"(?<![A-Za-z0-9])(?:A[KS]IA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})(?![A-Za-z0-9])")
TOKEN_MARKS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-")
ASSIGNED = re.compile(r"(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key)\b[\"']?\s{0,3}[=:]\s{0,3}[\"']?)([^\s\"',;]{6,})")
NUMBER_START = re.compile(r"[+(\d]")
NUMBER = re.compile(r"(?<![\w.@/-])(?:(\d{1,3}(?:\.\d{1,3}){3})(?![\w.]*\d)|((?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{2,4}(?:[ .-]\d{2,5}){1,3}|\+\d{1,3}[ .-]\d{2,5}[ .-]\d{5,8}|\+\d{8,14})(?![\w-])|(\d(?:[ -]?\d){12,18})(?![\w-]))")
DATE = re.compile(r"(?:19|20)\d\d[ .-]\d{1,2}[ .-]\d{1,2}|\d{1,2}[ .-]\d{1,2}[ .-](?:19|20)\d\d")
IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")
#: Numbers that card issuers begin with.
ISSUER = re.compile(r"4|5[0-8]|3[04-9]|6[0245]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720")
#: Country codes of two digits (fixed by the numbering plan); 1 and 7 have one digit, all others three.
TWO_DIGITS = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
UPPER, LOWER = r"A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĘĚĞİŁŃŇŐŘŚŞŠŤŮŰŹŻŽА-ЯЁΆΈ-ΏΑ-Ω", r"a-zß-öø-ÿāăąćčďđęěğıłńňőřśşšťůűźżžа-яёά-ώ"
WORD = rf"(?:(?:[{UPPER}]['’])?[{UPPER}][{LOWER}]{{1,24}}|[{UPPER}]{{2,25}})"
FORMS = lambda words: "|".join(sorted((re.escape(f) for t in words for f in {t, t.capitalize(), t.upper()}), key=lambda f: (-len(f), f)))
KNOWN = [n for table in (GIVEN, MARKS) for (_, g), names in table.items() if g != "n" for n in names]
NAME = re.compile(rf"(?<!\w)(?:(?:{FORMS(TITLES)})\.?\s({WORD}(?:[ -]{WORD}){{0,2}})|(?:{FORMS(BEFORE)})\s({WORD}(?:[ -]{WORD}){{1,2}})|((?:{FORMS(KNOWN)})[ -]{WORD}(?: {WORD})?))(?!\w)")
CAPITAL = re.compile(rf"(?<!\w){WORD}(?!\w)")


@functools.cache
def named() -> ahocorasick.Automaton:
    """What any name that is found has: a given name, a title or an introduction, and what may follow it."""
    auto = ahocorasick.Automaton()
    ends = [".", *(c for c in map(chr, range(0x10000)) if c.isspace())]  # all white space that a pattern's \s is
    for t in (*TITLES, *BEFORE):
        for form in {t, t.capitalize(), t.upper()}:
            for end in ends:
                auto.add_word(form + end, 1)
    for n in {f for n in KNOWN for f in (n, n.capitalize(), n.upper())}:
        auto.add_word(n + " ", 1)
        auto.add_word(n + "-", 1)
    auto.make_automaton()
    return auto


def luhn(digits: str) -> bool:
    return sum((d if i % 2 == 0 else (2 * d - 9 * (d > 4))) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def script_of(text: str) -> str:
    c = next((c for c in text if c.isalpha()), "a")
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿" else "latin"


@dataclass(frozen=True)
class Entity:
    """parts: what surrogates are drawn for, each by type and canonical form."""

    start: int
    end: int
    kind: str
    canonical: str
    parts: tuple[tuple[str, str], ...]


def one(start: int, end: int, kind: str, canonical: str) -> Entity:
    return Entity(start, end, kind, canonical, ((kind, canonical),))


def mail(start: int, end: int, address: str) -> Entity:
    local, _, host = address.lower().partition("@")
    return Entity(start, end, "email", address.lower(), ((f"mail:{host}", local), ("host", host)))


def given(word: str) -> tuple[str, str]:
    return f"given:{script_of(word)}:{GENDER.get(word, 'n')}", word


def feminine(word: str) -> bool:
    """Whether a Cyrillic family name has a feminine ending, which its canonical form lacks."""
    return word.endswith(("ова", "ева", "ёва", "ина", "ына"))


def family(word: str) -> tuple[str, str]:
    return f"family:{script_of(word)}", word[:-1] if feminine(word) else word


def names(text: str) -> list[Entity]:
    """Names with a title, after an introduction or with a known given name, and their parts where these stand alone."""
    out, own = [], {}
    for m in NAME.finditer(text):
        a, b = m.span(m.lastindex)
        words = re.split("[ -]", text[a:b].lower())
        parts = [given(w) for w in words[:-1]] + [family(words[-1])]
        if len(words) == 1 and words[0] in GENDER:  # "Mrs. Anna"
            parts = [given(words[0])]
        out.append(Entity(a, b, "name", " ".join(words), tuple(parts)))
        own |= dict(zip(words, parts, strict=True))
    if out:
        spans = {x for e in out for x in range(e.start, e.end)}
        for m in CAPITAL.finditer(text):
            if (w := m.group().lower()) in own and m.start() not in spans:
                out.append(Entity(*m.span(), "name", w, (own[w],)))
    return out


def entities(text: str) -> list[Entity]:
    """What a text holds, by place; of overlapping finds the one that comes first here stays."""
    found: list[Entity] = []
    if "@" in text:
        found += [mail(*m.span(), m.group()) for m in EMAIL.finditer(text)]
    if any(k in text for k in TOKEN_MARKS):
        found += [one(*m.span(), "secret", m.group()) for m in TOKEN.finditer(text)]
    if "=" in text or ":" in text:
        found += [one(*m.span(1), "secret", m.group(1)) for m in ASSIGNED.finditer(text)]
        for m in IPV6.finditer(text) if "::" in text or text.count(":") > 6 else ():
            if sum(c != ":" for c in m.group()) >= 5:
                try:
                    found.append(one(*m.span(), "ip6", ipaddress.IPv6Address(m.group()).exploded))
                except ValueError:
                    pass
    at, start = 0, NUMBER_START.search(text)
    while start:  # a search for one character first: few places can begin a number
        at = start.start()
        m = NUMBER.match(text, at)
        at = m.end() if m else at + 1
        start = NUMBER_START.search(text, at)
        if not m:
            continue
        digits = re.sub(r"\D", "", m.group())
        if m.group(1):
            if all(int(x) < 256 for x in m.group(1).split(".")):
                found.append(one(*m.span(), "ip", m.group()))
        elif 13 <= len(digits) <= 19 and m.group()[0] != "+" and "(" not in m.group():
            if luhn(digits) and ISSUER.match(digits):
                found.append(one(*m.span(), "card", digits))
        elif m.group(2) and 8 <= len(digits) <= 15 and not DATE.fullmatch(m.group()):
            found.append(one(*m.span(), "phone", ("+" if m.group()[0] == "+" else "") + digits))
    if next(named().iter(text), None):
        found += names(text)
    out: list[Entity] = []
    for e in sorted(found, key=lambda e: (e.start, -e.end)):
        if not out or e.start >= out[-1].end:
            out.append(e)
    return out


#: Signs that stay between letters or digits of a secret, and those that any other sign becomes.
SEPARATORS, SIGNS = "-._/+=", "!#$%&*+?^~"


def longer(attempt: int) -> int:
    """Parts that a surrogate is lengthened by: slowly, then with each attempt, so that any number of them finds room."""
    return attempt // 8 + max(0, attempt - 16)


class Draw:
    """A stream of numbers that key, type, form and attempt determine."""

    def __init__(self, key: bytes, kind: str, canonical: str, attempt: int):
        self.seed, self.n, self.pool = hmac.new(key, f"{kind}\0{canonical}\0{attempt}".encode(), hashlib.sha256).digest(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hashlib.sha256(self.seed + self.n.to_bytes(4)).digest()
            self.n += 1
        x, self.pool = int.from_bytes(self.pool[:4]), self.pool[4:]
        return x * n >> 32

    def like(self, text: str, hexadecimal: bool = False, signs: bool = False) -> str:
        """Other characters of the same classes, letters of any script by Latin ones. Signs stay; with `signs` only those
        of SEPARATORS between two letters or digits do."""
        out = []
        for i, c in enumerate(text):
            if c.isalpha():
                alphabet = "abcdef" if hexadecimal else "abcdefghijklmnopqrstuvwxyz"
                x = alphabet[self.below(len(alphabet))]
                out.append(x.upper() if c.isupper() else x)
            elif c.isdigit():
                out.append(str(self.below(10)))
            elif signs and not (c in SEPARATORS and text[i - 1 : i].isalnum() and text[i + 1 : i + 2].isalnum()):
                out.append(SIGNS[self.below(len(SIGNS))])
            else:
                out.append(c)
        return "".join(out)

    def more(self, text: str, attempt: int) -> str:
        """Digits to lengthen a surrogate by, so that draws of a small space find room: at once where text has few letters
        and digits, else as late as names are lengthened."""
        return "".join(str(self.below(10)) for _ in range(attempt if sum(map(str.isalnum, text)) < 8 else longer(attempt)))


def country(number: str) -> int:
    """Length of + and the country code that a number begins with; 0 for national numbers."""
    return 0 if number[0] != "+" else 2 if number[1] in "17" else 3 if number[1:3] in TWO_DIGITS else 4


def drawn_name(d: Draw, form: str, listed: list[str], script: str, gender: str, attempt: int) -> str:
    """From the list at first, then of syllables; never the form itself."""
    own = [n.lower() for n in listed if n.lower() != form]
    if own and attempt < 3:
        return own[d.below(len(own))]
    begin, vowels, last = SYLLABLES[script]
    return "".join(begin[d.below(len(begin))] + vowels[d.below(len(vowels))] for _ in range(2 + longer(attempt))) + begin[d.below(len(begin))][0] + last[gender]


def surrogate(key: bytes, kind: str, canonical: str, attempt: int = 0) -> str:
    """The replacement of a part's canonical form, itself in canonical form; names in lower case."""
    d = Draw(key, kind, canonical, attempt)
    if kind.startswith("mail:"):
        return d.like(canonical) + d.more(canonical, attempt)
    if kind == "host":
        labels = canonical.split(".")
        if reserved(canonical):
            return canonical
        return ".".join([*(d.like(x) for x in labels[:-2]), d.like(labels[-2]) + d.more(labels[-2], attempt), labels[-1]])
    if kind == "ip":
        a, b, *_ = map(int, canonical.split("."))
        private = a == 10 or (a, b) == (192, 168) or (a == 172 and 16 <= b < 32)
        # Past a small private range's room the largest one, then the range of shared addresses, then any.
        if private and attempt >= 8:
            fixed = [10] if attempt < 24 else [100, 64 + d.below(64)] if attempt < 32 else []
        else:
            fixed = [10] if a == 10 else [192, 168] if private and a == 192 else [172, 16 + d.below(16)] if private else [127] if a == 127 else []
        if not fixed:
            first = 11 + d.below(212)
            fixed = [first + (first in (127, 172, 192))]
        return ".".join(map(str, [*fixed, *(1 + d.below(254) for _ in range(4 - len(fixed)))]))
    if kind == "ip6":
        groups = canonical.split(":")
        # Local, private and documentation prefixes stay, other addresses stay global; zero groups stay until room is short.
        keep = 2 if groups[:2] == ["2001", "0db8"] else 1 if groups[0][:2] in ("fc", "fd", "fe", "ff") else 0
        out = groups[:keep]
        for i, g in enumerate(groups[keep:], keep):
            width = 0 if g == "0000" and attempt < 8 else min(4, len(g.lstrip("0")) + attempt // 2)
            x = 0x2000 + d.below(0x2000) if i == 0 else 1 + d.below(16**width - 1) if width else 0
            out.append(f"{x:04x}")
        return ":".join(out)
    if kind == "card":
        keep = {"4": 1, "2": 4}.get(canonical[0], 2)
        body = canonical[:keep] + "".join(str(d.below(10)) for _ in canonical[keep + 1 :])
        return next(body + c for c in "0123456789" if luhn(body + c))
    if kind == "phone":
        keep = country(canonical)
        return canonical[:keep] + "".join(str(2 + d.below(8)) if i == 0 else str(d.below(10)) for i, _ in enumerate(canonical[keep:])) + d.more(canonical, attempt)[: max(0, 15 - len(canonical.lstrip("+")))]
    if kind == "secret":
        head = re.match(r"A[KS]IA(?=[A-Z0-9]{16}$)|gh[pousr]_|sk-", canonical)
        n = head.end() if head else 0
        return canonical[:n] + d.like(canonical[n:], bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", canonical)), True) + d.more(canonical[n:], attempt)
    what, script, *gender = kind.split(":")
    if what == "given":
        return drawn_name(d, canonical, GIVEN[script, gender[0]], script, gender[0], attempt)
    return drawn_name(d, canonical, FAMILY[script], script, "", attempt)


def reserved(host: str) -> bool:
    """Names kept for examples and tests, which are nobody's."""
    labels = host.split(".")
    return labels[-2] == "example" or labels[-1] in ("test", "invalid", "example")


def cased(original: str, new: str) -> str:
    return new.upper() if len(original) > 1 and original.isupper() else new[:1].upper() + new[1:]


def replacement(e: Entity, original: str, key: bytes, attempts: dict) -> str:
    """The surrogate of an entity in the original's dress: its separators and capitals."""
    new = [surrogate(key, *part, attempts.get(part, 0)) for part in e.parts]
    if e.kind in ("card", "phone"):
        digits = iter(new[0].lstrip("+"))
        return "".join(next(digits) if c.isdigit() else c for c in original) + "".join(digits)
    if e.kind == "name":
        words = re.split("([ -])", original)
        words[::2] = [cased(w, n + "а" * (kind[0] == "f" and "cyrillic" in kind and feminine(w.lower()))) for w, n, (kind, _) in zip(words[::2], new, e.parts, strict=True)]
        return "".join(words)
    if e.kind == "email":
        whole = "@".join(new)
        return "".join(n.upper() if i < len(original) and original[i].isupper() else n for i, n in enumerate(whole)) if original != original.lower() else whole
    if e.kind == "ip6":
        short = ipaddress.IPv6Address(new[0]).compressed if "::" in original or len(original) < 39 else new[0]
        return short.upper() if original != original.lower() else short
    return new[0]


def _found(batches):
    for batch in batches:
        kinds, forms = [], []
        for t in batch.column(0):
            for kind, form in {p for e in entities(t.as_py() or "") for p in e.parts}:
                kinds.append(kind)
                forms.append(form)
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(forms, pa.string())], ["kind", "canonical"])


def settle(found: DataFrame, key: bytes, most: int = 64) -> DataFrame:
    """(kind, canonical, attempt): the parts whose first surrogate isn't theirs alone, and which draw is.

    Given and family names of a script share one space of surrogates. The first round looks at all parts, each later one
    at those alone that were drawn again, against the parts and the surrogates settled so far.
    """

    @F.arrow_udf("string")
    def draw(kind: pa.Array, canonical: pa.Array, attempt: pa.Array) -> pa.Array:
        return pa.array([surrogate(key, *x) for x in zip(kind.to_pylist(), canonical.to_pylist(), attempt.to_pylist(), strict=True)], pa.string())

    same = ["space", "s"]
    space = F.regexp_replace("kind", "^(?:given|family):([a-z]+).*$", "name:$1")
    parts = written(found.distinct().select("kind", "canonical", space.alias("space")), "parts")
    # What example hosts keep is no collision.
    drawn = parts.where(~((F.col("kind") == "host") & F.col("canonical").rlike(r"(?:^|\.)example\.[^.]+$|\.(?:test|invalid|example)$"))).withColumn("attempt", F.lit(0))
    settled: list[DataFrame] = []
    for _ in range(most):
        drawn = written(drawn.withColumn("s", draw("kind", "canonical", "attempt")), "drawn")
        me = F.struct("canonical", "kind")
        first = drawn.groupBy(*same).agg(F.min(me).alias("first"))
        mine = drawn.join(first, same).withColumn("own", me == F.col("first")).drop("first")
        asked = drawn.select(*same).distinct()
        taken = parts.select("space", F.col("canonical").alias("s")).join(asked, same, "left_semi")
        for t in settled:
            taken = taken.unionByName(t.select(*same).join(asked, same, "left_semi"))
        marked = mine.join(taken.distinct().withColumn("taken", F.lit(True)), same, "left")
        marked = written(marked.withColumn("again", ~F.col("own") | F.col("taken").isNotNull()).drop("own", "taken"), "marked")
        discard(drawn)
        settled.append(marked.where("not again").drop("again"))
        if not marked.where("again").limit(1).count():
            out = settled[0]
            for t in settled[1:]:
                out = out.unionByName(t)
            return out.where("attempt > 0").select("kind", "canonical", "attempt")
        drawn = marked.where("again").select("kind", "canonical", "space", (F.col("attempt") + 1).alias("attempt"))
    raise RuntimeError(f"surrogates still collide after {most} draws")


#: Drawn-again parts that are broadcast at most; more are joined to the documents by a shuffle.
BROADCAST_ROWS = 50_000


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", n_entities: str = "n_entities") -> DataFrame:
    """docs with surrogates in `text`, and how many entities each text held (replaces a column of that name).

    Null and empty texts stay as they are, with no entities. Rows are taken one by one: repeated rows and null ids are no
    matter. All other columns are kept.
    """
    found = docs.select(F.col(text).cast("string")).where(F.col(text).isNotNull()).mapInArrow(_found, "kind string, canonical string").distinct()
    again = settle(found, key)
    count = again.limit(BROADCAST_ROWS + 1).count()

    def replaced(t: str, attempts: dict) -> tuple[str, int]:
        out, at, es = [], 0, entities(t)
        for e in es:
            out += [t[at : e.start], replacement(e, t[e.start : e.end], key, attempts)]
            at = e.end
        return ("".join(out) + t[at:] if es else t), len(es)

    def arrays(texts: list, maps) -> pa.Array:
        got = [(None, 0) if t is None else replaced(t, m) for t, m in zip(texts, maps, strict=True)]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in got], pa.string()), pa.array([n for _, n in got], pa.int64())], ["t", "n"])

    if count <= BROADCAST_ROWS:
        few = {(r.kind, r.canonical): r.attempt for r in again.collect()}

        @F.arrow_udf("t string, n long")
        def put(texts: pa.Array) -> pa.Array:
            return arrays(texts.to_pylist(), [few] * len(texts))

        out = docs.withColumn("_replaced", put(F.col(text).cast("string")))
    else:

        @F.arrow_udf("array<struct<kind: string, canonical: string>>")
        def held(texts: pa.Array) -> pa.Array:
            kind = pa.list_(pa.struct([("kind", pa.string()), ("canonical", pa.string())]))
            return pa.array([[{"kind": k, "canonical": c} for k, c in {p for e in entities(t or "") for p in e.parts}] for t in texts.to_pylist()], kind)

        @F.arrow_udf("t string, n long")
        def put_own(texts: pa.Array, own: pa.Array) -> pa.Array:
            return arrays(texts.to_pylist(), [{(x["kind"], x["canonical"]): x["attempt"] for x in o or ()} for o in own.to_pylist()])

        row = F.xxhash64(F.col(text)), F.md5(F.col(text))
        texts = docs.select(F.col(text).cast("string").alias("t"), row[0].alias("_h"), row[1].alias("_m"))
        own = texts.select("_h", "_m", F.explode(held("t")).alias("e")).select("_h", "_m", "e.*").distinct().join(again, ["kind", "canonical"]).groupBy("_h", "_m").agg(F.collect_list(F.struct("kind", "canonical", "attempt")).alias("_own"))
        out = docs.withColumn("_h", row[0]).withColumn("_m", row[1]).join(own, ["_h", "_m"], "left").withColumn("_replaced", put_own(F.col(text).cast("string"), F.col("_own"))).drop("_h", "_m", "_own")
    return out.withColumns({text: F.col("_replaced.t"), n_entities: F.col("_replaced.n")}).drop("_replaced")
