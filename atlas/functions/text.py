"""Column functions over titles, tags, categories and free text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from atlas import fixed_values as fv

NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
WORD = r"[\p{L}\p{N}_]+"


def to_double(text: Column) -> Column:
    """A decimal number, NULL for anything else (suffixes such as ``5d`` included)."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def decode_title(raw: Column) -> Column:
    """Percent-decode and turn ``_`` into a space; ``+`` and stray ``%`` stay as they are."""
    guarded = F.regexp_replace(raw, "%(?![0-9A-Fa-f]{2})", "%25")
    guarded = F.replace(guarded, F.lit("+"), F.lit("%2B"))
    return F.replace(F.try_url_decode(guarded), F.lit("_"), F.lit(" "))


def title_from_url(url: Column, last_segment: bool = False) -> Column:
    """Article title behind an article address.

    The part after ``/wiki/`` by default, so that titles with a slash survive;
    ``last_segment`` takes what follows the last slash instead.
    """
    tail = uri_tail(url) if last_segment else F.when(
        F.contains(url, F.lit("/wiki/")), F.regexp_replace(url, "^.*?/wiki/", "")
    ).otherwise(uri_tail(url))
    return decode_title(tail)


def uri_tail(uri: Column) -> Column:
    """Text after the last slash; an empty identifier is NULL."""
    return F.substring_index(F.nullif(uri, F.lit("")), "/", -1)


def split_list(text: Column) -> Column:
    """Pipe-separated text as an array without empty parts; nothing left is NULL."""
    parts = F.filter(F.split(text, r"\|"), lambda part: part != "")
    return F.when(F.size(parts) > 0, parts)


def map_pipe_list(text: Column) -> Column:
    """Pipe-separated identifiers, each cut to its tail, pipe-joined again."""
    return F.array_join(F.transform(split_list(text), uri_tail), "|")


def iso_year(text: Column, cut: bool = False) -> Column:
    """Signed year: all digits before the first hyphen after the sign; NULL beyond 32 bits.

    ``cut`` reads the first four characters after the sign only.
    """
    digits = F.regexp_extract(text, r"^[-+]*(.{1,4})" if cut else r"^[-+]*([^-]+)", 1)
    year = F.when(digits.rlike("^[0-9]+$"), digits.try_cast("int"))
    return F.when(F.startswith(text, F.lit("-")), -year).otherwise(year)


def iso_month(text: Column) -> Column:
    return F.regexp_extract(text, r"^[-+]?[0-9]+-([0-9]{2})", 1).try_cast("int")


def digits_to_int(text: Column) -> Column:
    """All digits of the text as one number, -1 when there are none."""
    return F.coalesce(F.regexp_replace(text, "[^0-9]", "").try_cast("int"), F.lit(-1))


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def tidy_tags(tags: Column) -> Column:
    """Trimmed lower-case tags, in order of first appearance, over-long ones dropped."""
    kept = F.filter(tags, lambda t: t.isNotNull() & (t != "") & (F.length(t) < fv.MAX_TAG_CHARS))
    return F.array_distinct(F.transform(kept, lambda t: F.lower(strip(t))))


def normalise_tags(tags: Column) -> Column:
    """``tidy_tags`` as a set: sorted, so that equal sets are equal arrays."""
    return F.array_sort(tidy_tags(tags))


def generalise(category: Column) -> Column:
    """Text before the first `` in ``, `` of `` or `` by ``; NULL without one."""
    words = "|".join(fv.GENERAL_WORDS)
    return F.nullif(F.regexp_extract(category, rf"^(.+?) ({words}) .+", 1), F.lit(""))


def categories(links: Column) -> Column:
    """Names of the categories among link targets."""
    mine = F.filter(links, lambda link: F.startswith(link, F.lit(fv.CATEGORY_PREFIX)))
    return F.transform(mine, lambda link: F.substring(link, len(fv.CATEGORY_PREFIX) + 1, 1 << 30))


def year_of_category(links: Column, suffix: str) -> Column:
    """Year of the last category ending in ``suffix``; NULL without one, -1 if unreadable."""
    mine = F.filter(categories(links), lambda name: F.endswith(name, F.lit(suffix)))
    return F.when(F.size(mine) > 0, digits_to_int(F.try_element_at(mine, F.lit(-1))))


def birth_year(links: Column) -> Column:
    return year_of_category(links, fv.BIRTHS_SUFFIX)


def death_year(links: Column) -> Column:
    return year_of_category(links, fv.DEATHS_SUFFIX)


def birth_category_years(cats: Column, first: int, last: int) -> Column:
    """Years ``first <= y < last`` whose exact category ``'<y> births'`` is present."""
    years = F.transform(
        F.filter(cats, lambda c: c.rlike(rf"^(0|-?[1-9][0-9]*){fv.BIRTHS_SUFFIX}$")),
        lambda c: F.substring_index(c, " ", 1).try_cast("int"),
    )
    return F.array_distinct(F.filter(years, lambda y: (y >= first) & (y < last)))


def first_name(name: Column) -> Column:
    return F.substring_index(name, " ", 1)


def last_word(category: Column) -> Column:
    return F.substring_index(F.lower(category), " ", -1)


def infobox_type(tags: Column) -> Column:
    """Kind named by the first infobox among ordered, tidied template tags."""
    boxes = F.filter(tags, lambda tag: F.startswith(tag, F.lit(fv.INFOBOX_PREFIX)))
    return F.substring(F.try_element_at(boxes, F.lit(1)), len(fv.INFOBOX_PREFIX) + 1, 1 << 30)


def place_key(name: Column) -> Column:
    """Lower-case name up to its first comma."""
    return F.lower(F.substring_index(name, ",", 1))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def word_counts(all_words: Column, wanted) -> Column:
    """Struct with one count per wanted word."""
    return F.struct(*[
        (F.size(all_words) - F.size(F.array_remove(all_words, word))).cast("long").alias(word)
        for word in wanted
    ])


def word_score(counts: Column, weights: dict[str, int] | None = None) -> Column:
    """Weighted balance of word counts in [-1, 1]; 0 without any such word."""
    weights = weights or fv.GENDER_WEIGHTS
    balance = sum((counts[w] * v for w, v in weights.items()), F.lit(0))
    weight = sum((counts[w] * abs(v) for w, v in weights.items()), F.lit(0))
    return F.when(weight > 0, balance / weight).otherwise(F.lit(0.0))
