"""Text cleaning, script ratios, tokens and quality as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

_WS = r"[ \t\n\r\f\x0B]+"


@dataclass(frozen=True)
class LanguageProfile:
    """What script- and language-bound rules depend on; patterns are Java's."""

    letters: str = r"\p{L}"
    foreign: str = r"\p{IsHan}"
    token: str = r"[A-Za-zÀ-ɏ]{2,}"
    stop_words: tuple[str, ...] = ("the", "and", "of", "is", "to", "in", "it", "die", "der", "und", "de", "la", "que", "los")
    terminators: str = r"[.!?]"
    boilerplate: tuple[str, ...] = (r"(?i)licensed under the [a-z ]+licen[cs]e[^\n]*", r"(?i)all rights reserved\.?")
    extra: dict = field(default_factory=dict)


LATIN = LanguageProfile()
HANGUL = LanguageProfile(letters=r"[가-힣]", token=r"[0-9]+(?:[.,][0-9]+)*[가-힣%]*|[가-힣]{2,}|[A-Za-z]{2,}", stop_words=())


def squeezed(text: Column) -> Column:
    """White space runs as one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, _WS, " "))


def shortened(text: Column, n: int) -> Column:
    return F.substring(squeezed(text), 1, n)


def without_markup(text: Column) -> Column:
    """Tags, entities and long hexadecimal codes as spaces."""
    for pattern in (r"<[^<>]*>", r"&[a-zA-Z#0-9]+;", r"\b[0-9a-fA-F]{16,}\b"):
        text = F.regexp_replace(text, pattern, " ")
    return text


def clean_lines(text: Column, least: int = 2, profile: LanguageProfile = LATIN) -> Column:
    """Markup and boilerplate removed, blanks squeezed in each line, short lines and bare numbers dropped."""
    text = without_markup(text)
    for pattern in profile.boilerplate:
        text = F.regexp_replace(text, pattern, "")
    lines = F.transform(F.split(text, "\n"), squeezed)
    return F.array_join(F.filter(lines, lambda x: (F.length(x) >= least) & ~x.rlike(r"^[-– ]*[0-9]{1,4}[-– ]*$")), "\n")


def lines_once(text: Column, prefix: int = 80) -> Column:
    """Lines whose first characters have not been seen before in the text; order stays."""
    lines = F.split(text, "\n")
    keys = F.transform(lines, lambda x: F.substring(x, 1, prefix))
    return F.array_join(F.filter(lines, lambda x, i: F.array_position(keys, F.substring(x, 1, prefix)) == i + 1), "\n")


def without_asterisks(text: Column) -> Column:
    """Markdown emphasis and list marks removed."""
    text = F.regexp_replace(text, r"\*\*([^*\n]+)\*\*", "$1")
    return F.regexp_replace(text, r"(?m)^[ \t]*\*[ \t]+", "")


def collapsed_repeats(text: Column) -> Column:
    """Five or more of the same symbol in a row as one."""
    for mark in (r"\*", r"#", r"\$", "&", "%", r"\.", "-", "=", "_"):
        text = F.regexp_replace(text, f"(?:{mark}){{5,}}", mark.replace("\\", "").replace("$", r"\$") if mark != r"\$" else r"\$")
    return text


def count_of(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def script_ratio(text: Column, profile: LanguageProfile = LATIN, spaces: bool = False) -> Column:
    """Share of the profile's letters in all characters, or in those that aren't white space; empty: 0."""
    total = F.length(text) if spaces else F.length(F.regexp_replace(text, _WS, ""))
    return F.coalesce(F.try_divide(count_of(text, profile.letters), total), F.lit(0.0))


def has_foreign(text: Column, threshold: float = 0.02, profile: LanguageProfile = LATIN) -> Column:
    total = F.length(F.regexp_replace(text, _WS, ""))
    return F.coalesce(F.try_divide(count_of(text, profile.foreign), total), F.lit(0.0)) > threshold


def readability(text: Column, profile: LanguageProfile = LATIN, special_counts: bool = True) -> Column:
    """0..1: 0.5 letters, 0.15 few symbols, 0.15 no replacement characters and lone jamo, 0.2 share of lines of 5 or more characters.

    Under ten characters: 0. Without ``special_counts`` the symbols' share is taken as 0.
    """
    visible = F.length(F.regexp_replace(text, _WS, ""))
    letters = script_ratio(text, profile)
    special = F.try_divide(count_of(text, r"[#$%&*@^~|<>\\]"), visible) if special_counts else F.lit(0.0)
    garbage = F.try_divide(count_of(text, r"[�ㄱ-ㆎ]"), visible)
    lines = F.filter(F.transform(F.split(text, "\n"), squeezed), lambda x: x != "")
    good = F.try_divide(F.size(F.filter(lines, lambda x: F.length(x) >= 5)), F.size(lines))
    score = 0.5 * letters + 0.15 * (1 - special) + 0.15 * (1 - garbage) + 0.2 * good
    return F.when(F.length(text) < 10, 0.0).otherwise(F.least(F.lit(1.0), F.coalesce(score, F.lit(0.0))))


def quality_tag(text: Column, confidence: Column, threshold: float = 0.6, profile: LanguageProfile = LATIN) -> Column:
    """empty, very_low (under 0.3), low or good by 0.6 * readability + 0.4 * confidence."""
    combined = 0.6 * readability(text, profile) + 0.4 * confidence
    return F.when(F.trim(text) == "", "empty").when(combined < 0.3, "very_low").when(combined < threshold, "low").otherwise("good")


def tokens(text: Column, profile: LanguageProfile = LATIN) -> Column:
    """Lower-cased tokens of the profile without stop words and single characters."""
    found = F.regexp_extract_all(F.lower(text), F.lit(profile.token), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*profile.stop_words) & (F.length(t) > 1)) if profile.stop_words else F.filter(found, lambda t: F.length(t) > 1)


def query_terms(query: Column, profile: LanguageProfile = LATIN) -> Column:
    """Distinct terms of two or more characters, longest first, order of appearance among equals."""
    terms = F.array_distinct(F.filter(F.split(F.lower(query), r"[^\p{L}\p{N}]+"), lambda t: (F.length(t) >= 2) & ~t.isin(*profile.stop_words)))
    placed = F.transform(terms, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t")))
    return F.transform(F.array_sort(placed), lambda s: s["t"])


def ordered_distinct(items: Column) -> Column:
    """Strings squeezed, empty ones dropped, first occurrences in order."""
    return F.array_distinct(F.filter(F.transform(items, squeezed), lambda x: x != ""))


def cut_at_sentence(text: Column, n: int, least: int = 20, profile: LanguageProfile = LATIN) -> Column:
    """At most n characters up to the last terminator; empty when that lies before ``least``."""
    cut = F.regexp_extract(F.substring(text, 1, n), f"(?s)^(.*{profile.terminators})", 1)
    return F.when(F.length(text) <= n, text).when(F.length(cut) >= least, cut).otherwise("")


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; two empty ones: 0."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def particle(word: Column, after_consonant: str, after_vowel: str) -> Column:
    """Hangul particle by whether the last syllable has a final consonant; vowel form for other scripts."""
    code = F.ascii(F.right(word, F.lit(1)))
    closed = code.between(0xAC00, 0xD7A3) & ((code - 0xAC00) % 28 != 0)
    return F.concat(word, F.when(closed, after_consonant).otherwise(after_vowel))


def company_key(name: Column) -> Column:
    """Comparable form of a company name: lower case, legal forms and everything but letters and digits removed."""
    plain = F.regexp_replace(F.lower(name), r"\b(inc|corp|co|ltd|llc|plc|gmbh|ag|sa|kg)\b\.?|\(주\)|주식회사", "")
    return F.regexp_replace(plain, r"[^\p{L}\p{N}]", "")


def plausible_company(name: Column) -> Column:
    """Trimmed name, or null for blanks, dates, amounts, mostly digits, sentences, file names and such over 60 characters."""
    n = squeezed(name)
    bad = (n == "") | (F.length(n) > 60) | (F.length(n) < 2) | n.rlike(r"^[0-9.,/\- ]+$") | n.rlike(r"(?i)\.(pdf|zip|xml|html?)$") | n.rlike(r"[:;!?]") | n.rlike(r"\.\s") | (count_of(n, "[0-9]") * 2 > F.length(n)) | ~n.rlike(r"\p{L}")
    return F.when(~bad, n)
