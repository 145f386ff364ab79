"""Text of blocks: normalising, sanitising, scripts, markers, numbers, as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from functools import cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Sentence ends, closers that may follow them, mathematical signs.
ENDS = ".!?;:。！？；："
CLOSERS = ")]}）】》”’\"'"
MATH = "=<>+/*^_{}[]|±×÷≈≠≤≥√∑∫∞∂∆∇→←↔-"
STRONG_MATH = "∑∫√∞≈≠≤≥±×÷"
#: Glyphs that stand for a missing one.
TOFU = "�□▢▯◌◻◼☐❑❒"
#: Symbols that are kept as list markers.
BULLETS = "•·●◆■"
#: Punctuation written plainly, character for character, and by more than one.
PLAIN_FROM = "‐‑‒–—―−‘’‚‛′“”„‟″\u00a0\u202f\u2007\u00ad"
PLAIN_TO = "-------'''''\"\"\"\"\"   "
LIGATURES = {"…": "...", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
WHITE = "(?U)\\s"
#: A leading list marker: a bullet or dash, or up to eight letters or digits before a bracket or stop.
MARKER = "^((?:[*•·\\-–—]\\s+)|(?:\\(?[A-Za-z0-9]{1,8}[).]\\s+))"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row; written plainly, Spark computes it for each use."""
    return F.transform(F.array(value), body)[0]


def in_class(chars: str) -> str:
    """The characters as a regular-expression class."""
    return "[" + "".join("\\" + c if c in "\\]^-[&" else c for c in chars) + "]"


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def chars_in(text: Column, chars: str) -> Column:
    """``count_of`` a class of single characters, told from what is left without them: a match is a run, not a character."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{chars}+", ""))


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no function for it."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def compact(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def normalized(text: Column) -> Column:
    """No zero-width space or byte-order mark, each run of white space one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "\u00a0\u200b\ufeff", " "), "(?U)\\s+", " "))


def is_blank(text: Column) -> Column:
    """True if ``normalized`` leaves nothing."""
    return ~F.coalesce(text, F.lit("")).rlike("(?U)[^\\s\u200b\ufeff]")


def tight(text: Column) -> Column:
    """``compact`` of ``normalized`` text, in one step."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "(?U)[\\s\u200b\ufeff]", "")


def ends_sentence(text: Column) -> Column:
    """True if what is left of ``normalized`` text without closing brackets and quotes ends a sentence."""
    return F.coalesce(text, F.lit("")).rlike(f"(?U){in_class(ENDS)}{in_class(CLOSERS)[:-1]}\u200b\ufeff]*[\\s\u200b\ufeff]*\\z")


def ends_with_stop(text: Column) -> Column:
    return text.rlike(f"(?U){in_class(ENDS)}\\s*\\z")


def has_cjk(text: Column) -> Column:
    return text.rlike("[一-鿿]")


def has_emoji(text: Column) -> Column:
    return text.rlike("[\\x{10000}-\\x{10FFFF}]")


def is_emoji_only(text: Column) -> Column:
    """Only symbols and pictures, bullets aside."""
    blank = "\\s\ufe0f\u200d\u200b\ufeff"
    picture = f"[[\\p{{So}}\\x{{10000}}-\\x{{10FFFF}}]&&[^{BULLETS}]]"
    return F.coalesce(text, F.lit("")).rlike(f"(?U)^[{blank}]*+(?:{picture}[{blank}]*+)++\\z")


BAD_GLYPH = f"[{TOFU}\\p{{Co}}\\x{{10000}}-\\x{{10FFFF}}]|[[\\p{{So}}☀-➿]&&[^{BULLETS}]]"


def suspicious_glyphs(text: Column) -> Column:
    """Stand-ins for missing glyphs, private-use characters, pictures, symbols, control characters."""
    return count_of(F.coalesce(text, F.lit("")), f"{BAD_GLYPH}|[\\p{{Cc}}&&[^\\r\\n\\t]]")


def suspicious_count(text: Column) -> Column:
    """And question marks, from six and three in a hundred characters."""
    marks = count_of(text, "\\?")
    return suspicious_glyphs(text) + F.when((marks >= 6) & (marks / F.greatest(F.length(text), F.lit(1)) >= 0.03), marks).otherwise(0)


def sanitized(text: Column, composed: bool = True) -> Column:
    """Plain punctuation, no bad glyphs, control or format characters, white space collapsed.

    ``composed``: False if the text is known to be in NFC, which saves the only Python step.
    """
    out = F.translate(nfc(text) if composed else F.coalesce(text, F.lit("")), PLAIN_FROM, PLAIN_TO)
    for k, v in LIGATURES.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    out = F.regexp_replace(out, "[\\r\\n\\t]", " ")
    out = F.regexp_replace(out, f"{BAD_GLYPH}|[\\p{{Cc}}\\p{{Cf}}]", "")
    return stripped(F.regexp_replace(out, "(?U)\\s+", " "))


#: Script by code points, for letters and marks.
SCRIPTS = {
    "cjk": "一-鿿぀-ヿ가-힯㐀-䶿",
    "cyrillic": "Ѐ-ԯ",
    "greek": "Ͱ-Ͽ",
    "latin": "\u0000-ÿ",
    "latin_extended": "Ā-ɏḀ-ỿ",
}


def scripts(text: Column) -> Column:
    """Scripts that a font must have, as a sorted array."""
    counted = "[^\\p{P}\\p{Z}\\p{S}\\p{Nd}\\s`^$<>=+|~]"
    pairs = [F.when(text.rlike(f"[{counted}&&[{chars}]]"), name) for name, chars in SCRIPTS.items()]
    known = "".join(SCRIPTS.values())
    other = F.when(text.rlike(f"[{counted}&&[^{known}]]|[\\p{{S}}&&[☀-➿\\x{{10000}}-\\x{{10FFFF}}]]"), "other")
    return F.array_sort(F.array_compact(F.array(*pairs, other)))


def font_route(found: Column) -> Column:
    """Which font family a set of scripts needs."""
    return F.when(F.array_contains(found, "cjk") | F.array_contains(found, "other"), "universal").otherwise("latin")


def leading_marker(text: Column) -> Column:
    return F.regexp_extract(F.coalesce(text, F.lit("")), "^(?U:\\s*+)" + MARKER[1:], 1)


def symbol_prefix(text: Column) -> tuple[Column, Column]:
    """(symbols at the start, the rest); no symbols: empty and the whole text."""
    clean = normalized(text)
    pattern = f"^((?:[[\\p{{So}}\\x{{10000}}-\\x{{10FFFF}}{BULLETS}]]\ufe0f?\\s*)+)(.*)$"
    head = F.regexp_extract(clean, pattern, 1)
    return stripped(head), F.when(head == "", clean).otherwise(F.regexp_extract(clean, pattern, 2))


def is_formula(text: Column) -> Column:
    """Signs, digits and operators outweigh letters, by four rules."""

    def counts(c: Column) -> Column:
        found = {"math": sign, "digits": "\\p{Nd}", "letters": "\\p{L}", "operators": "[+\\-*/=<>^_]"}
        return F.struct(F.length(c).alias("n"), *[chars_in(c, p).alias(k) for k, p in found.items()], c.rlike(in_class(STRONG_MATH)).alias("strong"), c.contains("=").alias("equals"))

    def rules(s: Column) -> Column:
        n, signs = s["n"], s["math"] + s["digits"] + s["operators"]
        ratio = signs / F.greatest(n, F.lit(1))
        return (n >= 2) & (
            (s["strong"] & (s["letters"] <= n * 0.65))
            | (s["equals"] & (s["operators"] >= 1) & (ratio >= 0.28))
            | ((s["math"] >= 2) & (ratio >= 0.25))
            | ((n <= 28) & (ratio >= 0.45) & (s["letters"] <= signs))
        )

    # no rule holds without one of these signs, and they are cheap to look for
    plain, sign = F.coalesce(text, F.lit("")), in_class(MATH)[:-1] + "Ͱ-Ͽἀ-῿]"
    # ``tight`` text of up to 28 characters, given up at the next
    short = plain.rlike("(?U)^[\\s\u200b\ufeff]*+(?:[^\\s\u200b\ufeff][\\s\u200b\ufeff]*+){0,28}\\z") & plain.rlike(f"\\p{{Nd}}|{sign}")
    strong = reduce(lambda a, b: a | b, [plain.contains(x) for x in STRONG_MATH + "="])
    maybe = strong | plain.rlike(f"(?s){sign}.*?{sign}") | short
    return F.when(maybe, let(let(tight(text), counts), rules)).otherwise(F.lit(False))


def is_numeric_like(text: Column) -> Column:
    """Numbers outweigh words, for the audit."""
    c = compact(text)
    n, digits, operators, letters = F.length(c), count_of(c, "\\p{Nd}"), count_of(c, "[+\\-*/=<>^_%]"), count_of(c, "\\p{L}")
    words, numbers, long_words = count_of(text, "[A-Za-z]+"), count_of(text, "(?U)\\b\\d+(?:[.,]\\d+)?[A-Za-z%]*\\b"), count_of(text, "(?U)\\b[a-z]{4,}\\b")
    heavy = ((digits + operators) / F.greatest(n, F.lit(1)) >= 0.45) & (letters <= digits + operators)
    return (n >= 2) & (heavy | ((numbers >= 8) & (long_words <= F.greatest(words * 0.35, F.lit(3.0)))))


def joined_lines(lines: Column) -> Column:
    """Texts of lines in order, by a space; a line that ends in a hyphen after a letter or digit goes straight on to a lower-case letter or digit, the hyphen kept."""
    clean = F.filter(F.transform(lines, normalized), lambda x: x != "")
    glue = lambda a, b: b.rlike("^[a-z0-9]") & F.substring(a, -2, 2).rlike("[A-Za-z0-9][-‐‑‒–]$")
    # a line looks at the one before it only, so a block costs as much as it is long
    spaced = lambda a, x: F.when(a.isNull() | glue(a, x), x).otherwise(F.concat(F.lit(" "), x))
    return F.array_join(let(clean, lambda xs: F.transform(xs, lambda x, i: spaced(F.get(xs, i - 1), x))), "")


# Numbers

#: What the number rules read; the dashes that count as a hyphen; a slash laid over a comparison.
READ = "0123456789%<>=.,+- ≤≥"
DASHES = "−‐‑‒–—―"
STRUCK = {"<\u0338": "≮", ">\u0338": "≯", "=\u0338": "≠"}
NUMBER = "\\d+(?:[\\s\u00a0\u202f]?\\d{3})*(?:[.,]\\d+)?"


@cache
def compatible() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose compatibility form, dashes as hyphens, holds one that the number rules read: those of one character, and of more."""
    one, more, hyphens = {}, {}, str.maketrans(DASHES, "-" * len(DASHES))
    for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x20000))):
        n = unicodedata.normalize("NFKC", c).translate(hyphens)
        if n != c and any(x in READ for x in n):
            (one if len(n) == 1 else more)[c] = n
    return one, more


def near(chars: Iterable[str], gap: int = 64) -> str:
    """A class of few ranges that hold ``chars`` and what lies between neighbours: quick to look for."""
    ranges: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if ranges and c - ranges[-1][1] <= gap:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


def numeric_text(text: Column) -> Column:
    """The text as the number rules read it: digits, signs and spaces in their compatibility form (NFKC), comparisons and dashes in ASCII."""
    one, more = compatible()
    plain = F.translate(text, "".join(one), "".join(one.values()))
    table = F.create_map(*[F.lit(x) for pair in more.items() for x in pair])
    wide = F.array_join(F.transform(F.split(plain, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    for k, v in STRUCK.items():
        wide = F.replace(wide, F.lit(k), F.lit(v))
    plain = F.when(plain.rlike(near([*more, "\u0338"])), wide).otherwise(plain)
    form = F.replace(F.replace(plain, F.lit("≤"), F.lit("<=")), F.lit("≥"), F.lit(">="))
    return F.when(text.rlike(near([*one, *more, "\u0338", "≤", "≥"])), form).otherwise(text)


def number_value(text: Column) -> Column:
    """One spelling of a number: 1,234 and 1.234.567 lose their separators, 12,5 gets a stop."""
    v = F.regexp_replace(text, "(?U)[^\\d.,]", "")
    parts = F.split(v, "[.,]", -1)
    seps, last = F.size(parts) - 1, F.element_at(parts, -1)
    whole = F.array_join(parts, "")
    head = F.array_join(F.slice(parts, 1, F.greatest(seps, F.lit(1))), "")
    thousands = F.forall(F.slice(parts, 2, F.greatest(seps, F.lit(1))), lambda p: F.length(p) == 3)
    one = F.when((F.length(last) == 3) & ~parts[0].isin("", "0"), whole).otherwise(F.concat(head, F.lit("."), last))
    return F.when(seps <= 0, v).when(seps > 1, F.when(thousands, whole).otherwise(F.concat(head, F.lit("."), last))).otherwise(one)


def numeric_tokens(text: Column) -> Column:
    """Comparisons, percentages and ranges of ``numeric_text``, in order of kind, each once, at most 24."""
    patterns = [f"(?:<=|>=|[<>])\\s*{NUMBER}\\s*%?", "\\d+(?:[.,]\\d+)?\\s*%", "%\\s*\\d+(?:[.,]\\d+)?", "\\d+(?:[.,]\\d+)?\\s*-\\s*\\d+(?:[.,]\\d+)?\\s*%?"]
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(f"(?U)({p})"), F.lit(1)) for p in patterns]))
    tokens = F.slice(F.array_distinct(F.filter(F.transform(found, compact), lambda x: x != "")), 1, 24)
    return F.when(text.rlike("[<>%]|(?U:\\d\\s*-\\s*\\d)"), tokens).otherwise(F.array().cast("array<string>"))


def numeric_keys(text: Column) -> Column:
    """Spellings under which the numbers of ``numeric_text`` may be found again."""
    number = f"(?:{NUMBER}|\\d+(?:[.,]\\d+)*)"
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(f"(?U)({p})"), F.lit(1)) for p in (f"(?:<=|>=|[<>])?\\s*{number}\\s*%?", f"(?:<=|>=|[<>])?\\s*%\\s*{number}")]))

    def keys(m: Column) -> Column:
        sign, percent = F.regexp_extract(m, "^(<=|>=|[<>])", 1), m.contains("%")

        def spelled(v: Column) -> Column:
            some = F.array(v, F.when(percent, F.concat(v, F.lit("%"))), F.when(percent, F.concat(F.lit("%"), v)), F.when(sign != "", F.concat(sign, v)), F.when((sign != "") & percent, F.concat(sign, v, F.lit("%"))), F.when((sign != "") & percent, F.concat(sign, F.lit("%"), v)))
            return F.when(v == "", F.array().cast("array<string>")).otherwise(F.array_compact(some))

        return let(number_value(m), spelled)

    whole = F.regexp_replace(compact(text), "(?U)(?<=\\d),(?=\\d)", ".")
    return F.array_distinct(F.filter(F.concat(F.array(whole), F.flatten(F.transform(found, keys))), lambda x: x != ""))


def lost_numbers(source: Column, translated: Column) -> Column:
    """Numeric tokens of the source that the translation has in no spelling; a range needs both ends. At most 8. Any text."""

    def missing(tokens: Column) -> Column:
        def against(there: Column) -> Column:
            def kept(token: Column) -> Column:
                ends = F.filter(F.split(token, "-", -1), lambda x: stripped(x) != "")
                ranged = token.contains("-") & (F.size(ends) == 2)
                return F.when(ranged, F.arrays_overlap(numeric_keys(ends[0]), there) & F.arrays_overlap(numeric_keys(ends[1]), there)).otherwise(F.arrays_overlap(numeric_keys(token), there))

            return F.slice(F.filter(tokens, lambda t: ~kept(t)), 1, 8)

        # the translation's keys once a text, and only where the source has a token
        return F.when(F.size(tokens) == 0, tokens).otherwise(let(let(numeric_text(translated), numeric_keys), against))

    return let(let(numeric_text(source), numeric_tokens), missing)
