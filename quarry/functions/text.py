"""Text expressions on columns; everything here stays in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: titles that are none, after stripping, ignoring case.
TITLE_SKIP = (
    r"(?i)^[\d\s\-_./·•]+$|^(목차|목\s*차|차례|내용|목록|개요|서론|결론|참고|첨부|주의사항|주의|INDEX|CONTENTS|Table\s+of\s+Contents)$"
)
#: Fixed value: English words that the older index leaves out.
EN_STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would shall should may might must can could to of in for on with at by "
    "from up about into through and or but if as this that these those it its not no only so than too very just when where which who all each both "
    "more most other such then how what they them their we our you your he she him her i me my any also use used using after before returns "
    "following without one two three example examples see note notes"
).split()


def strip(x: Column) -> Column:
    """x without white space of any kind at its ends."""
    return F.regexp_replace(x, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")


def terms(x: Column, least: int = 1) -> Column:
    """Lower-cased runs of letters, digits and underscores, at least so long."""
    found = F.split(F.lower(x), r"[^\p{L}\p{N}_]+")
    return F.array_remove(found, "") if least == 1 else F.filter(found, lambda t: F.length(t) >= least)


def shift(ts: Column, days: Column | int = 0, minutes: Column | int = 0, seconds: int = 0) -> Column:
    """ts moved by days, minutes and seconds, which may be negative."""
    part = lambda x: x if isinstance(x, Column) else F.lit(x)
    return ts + F.make_dt_interval(part(days).cast("int"), F.lit(0), part(minutes).cast("int"), F.lit(seconds).cast("decimal(18,6)"))


def or_else(x: Column, other: Column) -> Column:
    """x unless it is null or empty."""
    return F.coalesce(F.nullif(x, F.lit("")), other)


def contains_ignoring_case(x: Column, part: str) -> Column:
    return F.contains(F.lower(x), F.lower(F.lit(part)))


def occurrences(x: Column, part: Column) -> Column:
    """How often part stands in x without overlap; part is not empty."""
    return ((F.length(x) - F.length(F.replace(x, part, F.lit("")))) / F.length(part)).cast("long")


def find(x: Column, part: str) -> Column:
    """Where part stands first in x, from 0; -1 where it does not."""
    return F.locate(part, x) - 1


def rfind(x: Column, part: str) -> Column:
    """Where part stands last in x, from 0; -1 where it does not."""
    back = F.locate(part[::-1], F.reverse(x))
    return F.when(back == 0, -1).otherwise(F.length(x) - back - len(part) + 1)


def extension(name: Column) -> Column:
    """The last dot and what follows, lower-cased; empty without a dot."""
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))


def email_domain(email: Column) -> Column:
    return F.substring_index(email, "@", -1)


def ascii_letter_language(text: Column) -> Column:
    """en when over 70 percent of the letters are ASCII, else ko; ko without letters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    ascii_letters = F.length(F.regexp_replace(text, r"[^A-Za-z]", ""))
    return F.when((letters > 0) & (ascii_letters / F.nullif(letters, F.lit(0)) > 0.7), "en").otherwise("ko")


def has_hangul(x: Column) -> Column:
    return x.rlike("[가-힣]")


def english_tokens(text: Column) -> Column:
    """Words, numbers with units and hex values in that order, once each, two characters or more,
    without stop words; where none is left, the text split at white space."""
    low = F.lower(text)
    found = F.concat(
        F.regexp_extract_all(low, F.lit("([a-zA-Z][a-zA-Z0-9_]*)")),
        F.regexp_extract_all(low, F.lit(r"([0-9]+\.?[0-9]*[a-z]+)")),
        F.regexp_extract_all(low, F.lit("(0x[0-9a-f]+)")),
    )
    kept = F.filter(F.array_distinct(found), lambda t: (F.length(t) >= 2) & ~t.isin(*EN_STOP_WORDS))
    plain = F.filter(F.split(text, r"\p{IsWhite_Space}+"), lambda t: t != "")
    # Named once, as an array of one: the tokens are used twice and would be worked out twice.
    return F.get(F.transform(F.array(kept), lambda k: F.when(F.size(k) > 0, k).otherwise(plain)), F.lit(0))


def hangul_tokens(text: Column) -> Column:
    """Runs of Hangul of two characters or more: what stands in for a morphological analyser."""
    return F.regexp_extract_all(text, F.lit("([가-힣]{2,})"))


def mixed_tokens(text: Column, korean=hangul_tokens) -> Column:
    """Korean tokens and then the English ones that are not among them, once each; the text split at
    white space where there are none."""
    both = F.array_distinct(F.concat(korean(text), english_tokens(text)))
    return F.when(F.size(both) > 0, both).otherwise(F.filter(F.split(text, r"\p{IsWhite_Space}+"), lambda t: t != ""))


def legacy_tokens(text: Column, korean=hangul_tokens) -> Column:
    """Tokens of the older index: English ones of an English text, else both."""
    return F.when(ascii_letter_language(text) == "en", english_tokens(text)).otherwise(mixed_tokens(text, korean))


def legacy_query_tokens(text: Column, korean=hangul_tokens) -> Column:
    """Tokens of a query to the older index: both as soon as there is Hangul in it."""
    return F.when(has_hangul(text), mixed_tokens(text, korean)).otherwise(legacy_tokens(text, korean))


def title_of(pages: Column) -> Column:
    """The first line of the first three pages that may be a title: 4 to 120 characters after
    stripping and no page number, table of contents or the like; empty where there is none.
    pages: array of strings."""
    lines = F.flatten(F.transform(F.slice(pages, 1, 3), lambda p: F.split(F.coalesce(p, F.lit("")), r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]")))
    fit = F.filter(F.transform(lines, strip), lambda x: (F.length(x) >= 4) & (F.length(x) <= 120) & ~x.rlike(TITLE_SKIP))
    return F.coalesce(F.get(fit, F.lit(0)), F.lit(""))


def highlight(text: Column, query: str) -> Column:
    """text with every word of query, ignoring case, between <mark> tags. Of words that fit at one
    place the first in the query is marked; a blank query marks nothing."""
    words = [w for w in re.split(r"\s+", query) if w]
    if not words:
        return text
    quoted = "|".join(r"\Q" + w.replace(r"\E", r"\E\\E\Q") + r"\E" for w in words)
    return F.regexp_replace(text, f"(?iu)({quoted})", "<mark>$1</mark>")


#: What a recent time is called.
JUST_NOW, MINUTES, HOURS, DAYS = "방금 전", "분 전", "시간 전", "일 전"


def relative_date(ts: Column, as_of: Column) -> Column:
    """How long ago ts was in whole minutes, hours or days, under a minute and in the future just now,
    from seven days on the date; empty without a time."""
    seconds = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(ts.cast("timestamp"))
    whole = lambda size, unit: F.concat(F.floor(seconds / size).cast("string"), F.lit(unit))
    return (
        F.when(ts.isNull(), "")
        .when(seconds < 60, JUST_NOW)
        .when(seconds < 3600, whole(60, MINUTES))
        .when(seconds < 86400, whole(3600, HOURS))
        .when(seconds < 604800, whole(86400, DAYS))
        .otherwise(F.date_format(ts, "yyyy.MM.dd"))
    )


def in_seoul(ts: Column) -> Column:
    """The wall clock in Seoul at a time given in UTC."""
    return F.convert_timezone(F.lit("UTC"), F.lit("Asia/Seoul"), ts.cast("timestamp_ntz"))


def percent(share: Column) -> Column:
    """A share from 0 to 1 as a whole percentage, halves away from zero; null stays null."""
    return F.round(share * 100, 0).cast("long")


def days_left(deleted_at: Column, as_of: Column, keep_days: int) -> Column:
    """Days until a trashed row is purged: rounded up, never below 0."""
    seconds = F.unix_seconds(deleted_at.cast("timestamp")) + keep_days * 86400 - F.unix_seconds(as_of.cast("timestamp"))
    return F.greatest(F.lit(0).cast("long"), F.ceil(seconds / 86400).cast("long"))


def grade(score: Column) -> Column:
    """UNSPECIFIED without a score, then POOR, FAIR, GOOD and EXCELLENT from 0.5, 0.8 and 0.9 up."""
    return (
        F.when(score.isNull() | F.isnan(score), "UNSPECIFIED")
        .when(score < 0.5, "POOR")
        .when(score < 0.8, "FAIR")
        .when(score < 0.9, "GOOD")
        .otherwise("EXCELLENT")
    )


def cell(text: Column) -> Column:
    """A table cell on one line with its bars escaped."""
    return F.replace(F.array_join(F.filter(F.split(text, r"\p{IsWhite_Space}+"), lambda t: t != ""), " "), F.lit("|"), F.lit("\\|"))
