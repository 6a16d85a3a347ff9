"""Predicates and functions of text: built-in expressions where they can say it, Arrow functions where they can't."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that end a sentence, that close after it, that mark a list item.
TERMINALS = ".!?。！？…"
CLOSERS = "\"'”’»)]）】」』〉》"
BULLETS = "•◦‣▪■□●○*-–·"
CJK = r"\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{ac00}-\x{d7af}"


def mapped(kind: str):
    """An Arrow function of one text for each row; null gives null."""

    def wrap(f):
        def build(text: Column, *args) -> Column:
            @F.arrow_udf(kind)
            def run(texts: pa.Array) -> pa.Array:
                return pa.array([None if t is None else f(t, *args) for t in texts.to_pylist()], TYPES[kind])

            return run(text)

        build.plain = f
        return build

    return wrap


TYPES = {"string": pa.string(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}


def pair(kind: str):
    """The same for two texts; null if either is."""

    def wrap(f):
        def build(left: Column, right: Column) -> Column:
            @F.arrow_udf(kind)
            def run(a: pa.Array, b: pa.Array) -> pa.Array:
                return pa.array([None if x is None or y is None else f(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], TYPES[kind])

            return run(left, right)

        build.plain = f
        return build

    return wrap


# Predicates.


def is_cid(char: Column) -> Column:
    return char.rlike(r"^\(cid:\d+\)$")


def mostly_cid(chars: Column) -> Column:
    """More than four fifths of the characters (array<string>) are glyph numbers."""
    return F.size(F.filter(chars, is_cid)) > F.size(chars) * 0.8


def pure_numeric(text: Column) -> Column:
    return F.trim(text).rlike(r"^-?\d+(\.\d+)?$")


def digits_or_space(text: Column) -> Column:
    return text.rlike(r"^[0-9\s]*$")


def bullet(char: Column) -> Column:
    return char.isin(list(BULLETS))


def translatable_formula(text: Column) -> Column:
    return text.rlike("^[0-9, .]+$")


def splittable_formula(text: Column) -> Column:
    return text.contains(",") & (F.regexp_replace(text, r"[0-9\[\],\s]", "") != "")


def leader_dots(text: Column, least: int = 4) -> Column:
    return F.regexp_replace(text, "…", "...").rlike(r"(?:\.\s?){" + str(least) + ",}")


def identity_write_back(source: Column, target: Column) -> Column:
    return source.eqNullSafe(target)


def name_or_label(text: Column, fewest: int = 2, most: int = 5, label: int = 8) -> Column:
    """name_shaped: capitalised words; label_shaped: very short; null otherwise."""
    t = F.trim(text)
    words = F.size(F.split(t, r"\s+"))
    return F.when(t.rlike(r"^\p{Lu}[\p{L}'.-]*(?:\s+\p{Lu}[\p{L}'.-]*)*$") & words.between(fewest, most), "name_shaped").when((F.length(t) > 0) & (F.length(t) <= label), "label_shaped")


def cjk(char: Column) -> Column:
    return char.rlike(f"^[{CJK}]$")


def hangs(char: Column) -> Column:
    """Punctuation that may stand in the margin."""
    return char.isin(list(",.;:!?，。；：！？、'\"”’)」』》"))


def breakable(char: Column) -> Column:
    return char.rlike(rf"^(?:\s|-|[{CJK}])$")


def formula_font(name: Column, pattern: str) -> Column:
    """The part of a font's name behind its subset tag matches."""
    return F.regexp_replace(name, r"^[A-Z]{6}\+", "").rlike(pattern)


# Plain functions.


def normal_term(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def without_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"\p{C}", "")


def unfenced(reply: Column) -> Column:
    """What stands in one fence around the whole reply, or the reply."""
    inside = F.regexp_extract(F.trim(reply), r"(?s)^```[A-Za-z]*\s*\n?(.*?)\n?```$", 1)
    return F.when(F.trim(reply).rlike(r"(?s)^```.*```$"), inside).otherwise(F.trim(reply))


def without_markup(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"<[^<>]*>", ""), r"\{v\d+\}", "")


def stripped_end(text: Column) -> Column:
    """text without closers, marks, format characters and space at its end."""
    return F.regexp_replace(text, r"[\s\p{Mn}\p{Cf}" + re.escape(CLOSERS).replace("/", "") + "]+$", "")


def ends_sentence(text: Column) -> Column:
    return F.right(stripped_end(text), F.lit(1)).isin(list(TERMINALS))


def open_end(text: Column) -> Column:
    """1.0 if the text stops within a sentence, 0.0 if not, null if nothing is left to look at."""
    return F.when(F.length(stripped_end(text)) > 0, (~ends_sentence(text)).cast("double"))


def font_family(name: Column) -> Column:
    """Without the subset tag and the style suffix."""
    return F.regexp_replace(F.regexp_replace(name, r"^[A-Z]{6}\+", ""), r"(?i)[-,]?(bold|italic|oblique|regular|roman|medium|light|semibold|black|mt|ps)+$", "")


def letters(text: Column, script: str) -> Column:
    """Letters of a script (Han, Latin, Cyrillic, ...)."""
    return F.regexp_count(text, F.lit(r"\p{Is" + script + "}"))


def residue(text: Column, script: str) -> Column:
    """Share of letters that are of this script; null without letters."""
    return letters(text, script) / F.nullif(F.regexp_count(text, F.lit(r"\p{L}")), F.lit(0))


def legible(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\s", ""))


def page_ranges(text: Column) -> Column:
    """"1-,2,-3,5-7" as array<struct<lo, hi>>; an open end is -1, an open beginning 1; null text is null, "" is empty."""
    part = lambda p: F.struct(
        F.when(p.startswith("-"), F.lit(1)).otherwise(F.regexp_extract(p, r"^(\d+)", 1).try_cast("int")).alias("lo"),
        F.when(p.endswith("-"), F.lit(-1)).otherwise(F.regexp_extract(p, r"(\d+)$", 1).try_cast("int")).alias("hi"),
    )
    return F.transform(F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != ""), part)


def in_ranges(page: Column, ranges: Column) -> Column:
    """Null ranges hold every page, empty ones none."""
    inside = F.exists(ranges, lambda r: (r["lo"] <= page) & ((r["hi"] == -1) | (page <= r["hi"])))
    return F.when(ranges.isNull(), True).otherwise(F.coalesce(inside, F.lit(False)))


def rendered(template: str, variables: dict[str, Column]) -> Column:
    """{name} replaced by its column. A name that is missing, left over or unknown is an error at once."""
    wanted = re.findall(r"\{([a-z_]+)\}", template)
    if set(wanted) != set(variables):
        raise ValueError(f"variables {sorted(variables)} are not those of the template: {sorted(set(wanted))}")
    parts = re.split(r"\{([a-z_]+)\}", template)
    return F.concat(*[variables[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def abbreviated(text: Column, limit: int) -> Column:
    return F.substring(text, 1, limit)


def reply_gate(source: Column, target: Column, source_tokens: Column, target_tokens: Column) -> Column:
    """Why a reply can't be taken, or null: the same text (over 10 tokens), out of proportion (0.3 to 3), barely edited
    (distance under 5, over 20 tokens)."""
    ratio = target_tokens / F.nullif(source_tokens, F.lit(0))
    return (
        F.when((F.trim(source) == F.trim(target)) & (source_tokens > 10), "same")
        .when(ratio.isNull() | ~((ratio > 0.3) & (ratio < 3)), "ratio")
        .when((F.levenshtein(source, target) < 5) & (source_tokens > 20), "distance")
    )


def policy_rendering(source: Column, observed: Column, policy: Column) -> Column:
    """A name's default rendering: kept, as observed, or both."""
    return F.when(policy == "keep", source).when(policy == "translate", F.coalesce(observed, source)).when(policy == "both", F.when(observed.isNull(), source).otherwise(F.concat(observed, F.lit(" ("), source, F.lit(")"))))


# What built-in functions can't say.


@mapped("string")
def nfkc(text: str) -> str:
    return unicodedata.normalize("NFKC", text)


@mapped("string")
def compared_form(text: str) -> str:
    """NFKC without any white space."""
    return "".join(unicodedata.normalize("NFKC", text).split())


@mapped("string")
def escaped(text: str) -> str:
    """Characters that XML can't carry, and the mark itself, as \\uXXXX; unescaped() is the inverse."""
    ok = lambda c: c in "\t\n\r" or " " <= c <= "\ud7ff" or "\ue000" <= c <= "\ufffd" or c > "\uffff"
    return "".join(c if ok(c) and c != "\\" else f"\\u{ord(c):04x}" for c in text)


@mapped("string")
def unescaped(text: str) -> str:
    return re.sub(r"\\u([0-9a-f]{4})", lambda m: chr(int(m[1], 16)), text)


@mapped("string")
def folded_parens(text: str, most: int = 40) -> str:
    """"X (X)" as "X", where both are the same under NFKC; brackets aren't nested and may be of either width."""
    out, at = [], 0
    for m in re.finditer(r"\s*[(（]([^()（）]{1,%d})[)）]" % most, text):
        inner = unicodedata.normalize("NFKC", m[1]).strip()
        head = unicodedata.normalize("NFKC", text[at : m.start()]).rstrip()
        if inner and head.endswith(inner) and not (len(head) > len(inner) and head[-len(inner) - 1].isalnum() and inner[0].isascii()):
            out.append(text[at : m.start()])
            at = m.end()
    return "".join(out) + text[at:]


@mapped("array<string>")
def sentences(text: str, abbreviations: tuple[str, ...] = ("Mr", "Mrs", "Dr", "St", "vs", "e.g", "i.e", "No")) -> list[str]:
    """The text cut after sentences, without loss: the parts join to the text again."""
    out, at = [], 0
    for m in re.finditer(r"(?:[.!?]+[\"'”’»)\]]*(?=\s|$)\s*|[。！？…]+[”’」』）]*\s*)", text):
        word = text[at : m.start()].rsplit(None, 1)[-1:] or [""]
        if m[0][0] == "." and word[0].lstrip("(\"'“‘") in abbreviations:
            continue
        out.append(text[at : m.end()])
        at = m.end()
    return [*out, text[at:]] if text[at:] else out


@pair("double")
def similarity(a: str, b: str) -> float:
    """Matching blocks' share of both texts, in their compared form."""
    return difflib.SequenceMatcher(None, compared_form.plain(a), compared_form.plain(b), autojunk=False).ratio()


@pair("string")
def band_fault(a: str, b: str) -> str:
    """How a's text departs from b's: none, fracture (only white space), order, duplicate, dropped or undetermined."""
    if a == b:
        return "none"
    x, y = compared_form.plain(a), compared_form.plain(b)
    if x == y:
        return "fracture"
    if sorted(x) == sorted(y):
        return "order"
    kinds = {op for op, *_ in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes()} - {"equal"}
    return "duplicate" if kinds == {"delete"} else "dropped" if kinds == {"insert"} else "undetermined"


@mapped("array<string>")
def capitalised_terms(text: str, connector: int = 3, least: int = 4) -> list[str]:
    """Longest runs of capitalised words, joined over short lower-case words, that don't open a sentence on their own."""
    tokens = [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\W\d_][\w'’-]*", without_tags(text))]
    source, out, i = without_tags(text), [], 0
    opening = lambda k: k == 0 or bool(re.search(r"[.!?。！？…]", source[tokens[k - 1][2] : tokens[k][1]]))
    while i < len(tokens):
        if not tokens[i][0][0].isupper():
            i += 1
            continue
        last, j = i, i + 1
        while j < len(tokens) and not source[tokens[j - 1][2] : tokens[j][1]].strip():
            if tokens[j][0][0].isupper():
                last = j
            elif len(tokens[j][0]) > connector:
                break
            j += 1
        term = source[tokens[i][1] : tokens[last][2]]
        if len(term) >= least and not (last == i and opening(i)):
            out.append(term)
        i = last + 1
    return out


def without_tags(text: str) -> str:
    return re.sub(r"\{v\d+\}", "", re.sub(r"<[^<>]*>", "", text))


def candidates(text: Column, shortest: int = 3, longest: int = 8) -> Column:
    """All substrings of these lengths without white space that don't open with punctuation."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    every = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(shortest), F.lit(longest)), lambda n: F.substr(text, i, n))))
    return F.array_distinct(F.filter(every, lambda s: (F.length(s) >= shortest) & ~s.rlike(r"\s") & ~s.rlike(r"^\p{P}")))
