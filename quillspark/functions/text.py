"""Column functions for titles, DOIs, URLs, names, markup, citations and small JSON.

All are built from Spark's own functions, so they stay inside code generation.  A null input
counts as an empty string unless a function says otherwise.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import unicode

WS = r"(?U)\s+"


def _text(x: Column | str) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))


def squash(x: Column | str) -> Column:
    """White space collapsed to one space, trimmed."""
    return F.trim(F.regexp_replace(_text(x), WS, " "))


def _accent_table(low: int = 0xA0, high: int = 0x24F) -> tuple[str, str]:
    """Latin letters whose compatibility form is one letter and marks, and that letter."""
    source, target = [], []
    for code in range(low, high + 1):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(code):
            source.append(chr(code))
            target.append(plain)
    return "".join(source), "".join(target)


_ACCENTED, _PLAIN = _accent_table()
MARKS = r"[̀-ͯ]+"


# What the quick way below gets right: one letter and marks, or nothing to decompose.
_SIMPLE = r"\x00-\x9f" + unicode.char_class(p for p in range(0xA0, 0x250) if chr(p) in _ACCENTED or unicodedata.normalize("NFKD", chr(p)) == chr(p)) + r"\x{300}-\x{36f}"


def fold_accents(x: Column | str) -> Column:
    """Compatibility decomposition without marks; texts of plain and accented Latin go a quicker way."""
    quick = F.regexp_replace(F.translate(_text(x), _ACCENTED, _PLAIN), MARKS, "")
    return F.when(_text(x).rlike(f"[^{_SIMPLE}]"), unicode.unmarked(_text(x))).otherwise(quick)


def normalize_title(x: Column | str) -> Column:
    """Accents folded, lower case, other than letters, digits and spaces to spaces, squashed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(fold_accents(x)), "[^a-z0-9 ]+", " "), " +", " "))


def normalize_doi(x: Column | str) -> Column:
    """One resolver prefix off, lower case, no slashes at the end."""
    bare = F.regexp_replace(F.trim(_text(x)), r"(?i)^(https?://(dx\.)?doi\.org/|doi:)", "")
    return F.regexp_replace(F.trim(F.lower(bare)), "/+$", "")


def guard_title(x: Column | str) -> Column:
    """Lower case, runs of other than letters and digits to one space; accents stay apart."""
    return F.trim(F.regexp_replace(F.lower(_text(x)), "[^a-z0-9]+", " "))


def tokens(x: Column) -> Column:
    """Distinct words of a normalised string; none of an empty one."""
    return F.array_distinct(F.filter(F.split(x, " "), lambda t: t != ""))


def title_key(x: Column | str) -> Column:
    return F.concat(F.lit("title:"), guard_title(x))


def doi_key(x: Column | str) -> Column:
    return F.concat(F.lit("doi:"), F.lower(F.trim(_text(x))))


def record_name(x: Column | str) -> Column:
    """Data set names for similarity: generic words dropped.  Fixed values: the word list."""
    spaced = F.regexp_replace(F.lower(_text(x)), "[^a-z0-9 ]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, r"\b(dataset|traces|measurements|data|performance)\b", ""), " +", " "))


def modality(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_text(x)), "[^a-z0-9 ,]", " "), " +", " "))


def signature(name: Column, modalities: Column, layers: Column) -> Column:
    return F.concat(record_name(name), F.lit(" "), modality(modalities), F.lit(" "), F.lower(_text(layers)))


def merge_name(x: Column | str) -> Column:
    """Data set names for merging: one generic ending dropped.  Fixed values: the endings."""
    bare = F.regexp_replace(F.lower(F.trim(_text(x))), r"[- ]+(dataset|traces|measurements|data|evaluation)s?$", "")
    return F.regexp_replace(bare, WS, " ")


def score_title(x: Column | str, most: int = 60) -> Column:
    """Other than letters, digits and spaces deleted; the first 60 characters."""
    kept = F.regexp_replace(F.lower(F.trim(_text(x))), r"[^a-z0-9\s]", "")
    return F.substring(F.trim(F.regexp_replace(kept, r"\s+", " ")), 1, most)


def normalize_url(x: Column | str) -> Column:
    """Host with port and path, lower case; no scheme, query, fragment, slash at the end; GitHub's
    ``.git`` and default-branch tree paths dropped."""
    bare = F.regexp_replace(F.trim(_text(x)), "/+$", "")
    host = F.regexp_extract(bare, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)
    rest = F.regexp_replace(bare, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?", "")
    path = F.regexp_replace(F.regexp_replace(rest, r"[?#].*$", ""), "/+$", "")
    hub = F.regexp_replace(F.regexp_replace(path, r"\.git$", ""), r"/tree/(main|master)(/.*)?$", "")
    return F.lower(F.concat(host, F.when(host.contains("github.com"), hub).otherwise(path)))


def urls(*parts: Column) -> Column:
    return F.regexp_extract_all(F.concat_ws(" ", *parts), F.lit(r"https?://[^\s,;)\"']+"), F.lit(0))


def strip_tags(x: Column | str) -> Column:
    return squash(F.regexp_replace(_text(x), "<[^>]+>", " "))


def first_heading(x: Column | str) -> Column:
    return strip_tags(F.regexp_extract(_text(x), r"(?is)<h1[^>]*>(.*?)</h1>", 1))


def meta_description(x: Column | str) -> Column:
    return squash(F.regexp_extract(_text(x), r"""(?is)<meta[^>]+name=["']description["'][^>]+content=["']([^"']*)""", 1))


def doi_in(x: Column | str) -> Column:
    """The first DOI in a text, or an empty string."""
    return F.regexp_extract(_text(x), r"10\.\d{4,9}/\S+", 0)


def authors(x: Column | str) -> Column:
    """Author names: split at commas and `` and ``, number suffixes off, blanks dropped."""
    parts = F.split(_text(x), r",| and ")
    return F.filter(F.transform(parts, lambda a: F.regexp_replace(F.trim(a), r"\s+\d{4}$", "")), lambda a: a != "")


def first_of(*aliases: Column) -> Column:
    """The first value that is not blank, trimmed; null if all are."""
    return F.coalesce(*(F.nullif(F.trim(a), F.lit("")) for a in aliases))


def null_words(x: Column | str) -> Column:
    """nan, none and nat, in any case, count as empty."""
    value = F.trim(_text(x))
    return F.when(F.lower(value).isin("nan", "none", "nat"), "").otherwise(value)


def year_number(x: Column | str) -> Column:
    """A year written as a whole or decimal number."""
    value = F.trim(_text(x))
    return F.when(value.rlike(r"^[+-]?\d+(\.\d*)?$"), F.floor(value.try_cast("double")).cast("int"))


def content_key(*parts: Column) -> Column:
    return F.concat(F.lit("v1:"), F.sha2(F.concat_ws("\x00", *parts), 256))


def bibtex_key(names: Column, year: Column, title: Column) -> Column:
    """Last name of the first author, year, first word of the title; letters and digits only."""
    names, title = _text(names), _text(title)
    first = F.trim(F.when(names.contains(","), F.substring_index(names, ",", 1)).otherwise(F.substring_index(names, " and ", 1)))
    last = F.when(first == "", "unknown").otherwise(F.element_at(F.split(first, WS), -1))
    word = F.when(F.trim(title) == "", "paper").otherwise(F.element_at(F.split(F.trim(title), WS), 1))
    clean = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    return F.concat(clean(last), year.cast("string"), clean(word))


def minimal_bibtex(key: Column, title: Column, names: Column, year: Column, venue: Column, doi: Column) -> Column:
    field = lambda label, c: F.concat(F.lit(f"  {label} = {{"), _text(c.cast("string")), F.lit("},\n"))
    return F.concat(
        F.lit("@inproceedings{"), key, F.lit(",\n"), field("title    ", title), field("author   ", F.replace(_text(names), F.lit(";"), F.lit(" and "))),
        field("booktitle", venue), field("year     ", year), F.when(_text(doi) != "", field("doi      ", doi)).otherwise(""), F.lit("}"),
    )


def rekey_bibtex(entry: Column, key: Column) -> Column:
    return F.concat(F.regexp_extract(entry, r"^(?s)(\s*@\w+\{)", 1), key, F.regexp_replace(entry, r"^(?s)\s*@\w+\{[^,]*", ""))


def bibtex_field(entry: Column, name: str) -> Column:
    """A braced or quoted field's value; the last field needs no comma."""
    return F.regexp_extract(entry, rf'(?is)\b{name}\s*=\s*[{{"](.*?)["}}]\s*[,}}]', 1)


def inverted_to_text(index: Column) -> Column:
    """A map from word to positions, read back as text."""
    spots = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(spots), lambda s: s["w"]), " ")


def salvage_json(x: Column | str) -> Column:
    """What stands between the outermost braces or brackets, code fences dropped."""
    bare = F.trim(F.regexp_replace(_text(x), r"^\s*```(?:json)?\s*|\s*```\s*$", ""))
    return F.coalesce(F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\}|\[.*\])", 1), F.lit("")), bare)


def label(x: Column | str) -> Column:
    """yes, no or maybe; anything else is maybe."""
    value = F.lower(F.trim(_text(x)))
    return F.when(value.isin("yes", "no", "maybe"), value).otherwise("maybe")


def _flat_object(x: Column | str) -> Column:
    return F.regexp_extract(_text(x), r"(?s)\{[^{}]*\}", 0)


def verdict(x: Column | str) -> Column:
    """yes, no or unsure from a reply that holds a flat JSON object with ``verdict`` (or ``match``)."""
    found = F.coalesce(F.get_json_object(_flat_object(x), "$.verdict"), F.get_json_object(_flat_object(x), "$.match"))
    value = F.lower(F.trim(F.coalesce(found, F.lit("unsure"))))
    return F.when(value.isin("yes", "no"), value).otherwise("unsure")


def verdict_reason(x: Column) -> Column:
    """The reason that such a reply gives; a null reply is a call that failed."""
    told = F.coalesce(F.get_json_object(_flat_object(x), "$.reason"), F.lit(""))
    read = F.get_json_object(_flat_object(x), "$").isNotNull()
    return F.when(x.isNull(), "LLM call failed; flagging for human review").when(~read, "Could not parse LLM response").otherwise(told)


def arxiv_query(title: Column | str, most: int = 8) -> Column:
    words = F.slice(F.regexp_extract_all(_text(title), F.lit(r"[A-Za-z0-9]+"), F.lit(0)), 1, most)
    return F.array_join(F.transform(words, lambda w: F.concat(F.lit("all:"), w)), " AND ")


def arxiv_pdf(url: Column | str) -> Column:
    url = _text(url)
    return F.when(url.contains("/abs/"), F.replace(url, F.lit("/abs/"), F.lit("/pdf/"))).otherwise(url)


def source_hint(url: Column, page: Column) -> Column:
    """The publisher that a page's address or first 1,000 characters name.  Fixed values: order."""
    seen = F.lower(F.concat(_text(url), F.lit("\n"), F.substring(_text(page), 1, 1000)))
    rules = [("sigcomm", "sigcomm"), ("acm", "acm"), ("ieee", "ieee"), ("usenix.org", "usenix"), ("openreview.net", "openreview")]
    out = F.lit("generic")
    for needle, name in reversed(rules):
        out = F.when(seen.contains(needle), name).otherwise(out)
    return out
