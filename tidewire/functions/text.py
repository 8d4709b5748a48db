"""Text functions as native columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Latin letters and the plain letters that canonical decomposition leaves of them.
_PAIRS = [(chr(c), d[0]) for c in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFKD", chr(c))) > 1 and d[0].isascii() and all(map(unicodedata.combining, d[1:]))]
ACCENTED, PLAIN = ("".join(x) for x in zip(*_PAIRS))

#: Abbreviations in addresses, applied in this order.
ABBREVIATIONS = (("av", "avenida"), ("pje", "pasaje"), ("sta", "santa"), ("gral", "general"), ("mnes", "misiones"), ("mis", "misiones"))
#: Words that make a text look like an event, without accents.
EVENT_WORDS = ("entrada", "funcion", "presentacion", "obra", "festival", "fiesta", "recital", "show", "ciclo", "teatro", "muestra", "taller")


def let(value: Column, body) -> Column:
    """body(value), with the value computed once and nothing unrolled into generated code."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def content_hash(source_id: Column, url: Column, raw_text: Column) -> Column:
    """SHA-256 that names a post; a null part counts as empty, unlike in concat_ws."""
    return F.sha2(F.concat_ws(":", *(F.coalesce(c.cast("string"), F.lit("")) for c in (source_id, url, raw_text))), 256)


def casefold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def strip_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"\p{M}+", "")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip_html(c: Column) -> Column:
    """Tags become spaces; entities stay as they are."""
    return squeeze(F.regexp_replace(c, r"<[^>]+>", " "))


def normalize_location(c: Column) -> Column:
    """How places are compared: no accents, lower case, no punctuation, abbreviations spelt out. Null becomes ''."""
    t = casefold(strip_accents(F.coalesce(c, F.lit(""))))
    t = F.replace(t, F.lit("&"), F.lit(" y "))
    t = F.regexp_replace(F.regexp_replace(t, "[-_/]", " "), r"(?U)[^\p{L}\p{N}_\s]", " ")
    for short, whole in ABBREVIATIONS:
        t = F.regexp_replace(t, rf"(?<![\p{{L}}\p{{N}}_]){short}(?![\p{{L}}\p{{N}}_])", whole)
    return squeeze(t)


def match_text(c: Column) -> Column:
    """How titles are compared: lower case, letters, digits and single spaces; accents stay. Null becomes ''."""
    return squeeze(F.regexp_replace(casefold(F.coalesce(c, F.lit(""))), r"(?U)[^\p{L}\p{N}\s]", ""))


def slug(c: Column) -> Column:
    """Lower-case ASCII words joined by hyphens; 'evento' if nothing is left."""
    ascii_only = F.regexp_replace(strip_accents(F.coalesce(c, F.lit(""))), r"[^\x00-\x7F]", "")
    made = F.lower(F.regexp_replace(F.regexp_replace(ascii_only, "[^a-zA-Z0-9]+", "-"), "^-+|-+$", ""))
    return F.when(made == "", F.lit("evento")).otherwise(made)


def present(c: Column) -> Column:
    """Whether a text has something but white space."""
    return F.coalesce(F.length(squeeze(c)) > 0, F.lit(False))


def first_line(c: Column) -> Column:
    """The first line that is not blank, trimmed; else null."""
    return F.get(F.filter(F.transform(F.split(c, r"\r\n|\r|\n"), squeeze_ends), lambda x: x != ""), F.lit(0))


def squeeze_ends(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def venue_text(venue: Column, address: Column) -> Column:
    """Venue and address as one text; null if both are blank."""
    both = F.concat_ws(" ", F.when(present(venue), venue), F.when(present(address), address))
    return F.when(both == "", None).otherwise(both)


def _first_match(c: Column, patterns: tuple[str, ...], tidy) -> Column:
    found = [tidy(F.regexp_extract(c, p, 1)) for p in patterns]
    return F.coalesce(*[F.when(x != "", x) for x in found])


def infer_venue(raw: Column) -> Column:
    """What follows 'será en el', 'será en la', 'se presentará en el' or 'ubicado en', in that order."""
    start = r"(?iu)(?<![\p{L}\p{N}_])"
    rest = r"\s+([^,.;\n]+)"
    heads = (r"ser[aá]\s+en\s+el", r"ser[aá]\s+en\s+la", r"se presentara\s+en\s+el", r"se presentará\s+en\s+el", r"ubicado en")
    return _first_match(raw, tuple(start + h + rest for h in heads), squeeze_ends)


def infer_address(raw: Column) -> Column:
    """What follows 'ubicado en' or 'dirección:' up to a full stop or the line's end."""
    start = r"(?iu)(?<![\p{L}\p{N}_])"
    heads = (r"ubicado en\s+", r"direccion:\s*", r"dirección:\s*")
    return _first_match(raw, tuple(f"{start}{h}([^.\\n]+)" for h in heads), lambda x: F.regexp_replace(squeeze_ends(x), ",+$", ""))


def looks_like_event(raw: Column) -> Column:
    return strip_accents(casefold(F.coalesce(raw, F.lit("")))).rlike("|".join(EVENT_WORDS))


def keep_texts(evidence: Column) -> Column:
    """A map without its null values; an empty map for null."""
    kept = F.map_filter(evidence, lambda _, v: v.isNotNull())
    return F.coalesce(kept, F.create_map().cast("map<string,string>"))


def strip_fence(c: Column) -> Column:
    """A model's answer without the Markdown fence around it."""
    t = squeeze_ends(c)
    return F.regexp_replace(F.regexp_replace(t, r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")


def format_duration(ms: Column) -> Column:
    return F.when(ms.isNull(), "-").when(ms < 1000, F.format_string("%d ms", ms.cast("long"))).otherwise(F.format_string("%.1f s", ms / 1000.0))


def retry_after(c: Column) -> Column:
    """Seconds that a server asks to wait; never negative, null if unreadable."""
    seconds = c.try_cast("double")
    return F.when(seconds.isNotNull(), F.greatest(seconds, F.lit(0.0)))


def split_list(c: Column) -> Column:
    """Parts of a comma-separated text: trimmed, folded, without blanks; null for null."""
    return F.filter(F.transform(F.split(c, ","), lambda x: casefold(F.trim(x))), lambda x: x != "")
