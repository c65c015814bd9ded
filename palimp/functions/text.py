"""Column expressions over text, markers and replies. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The line that numbers a paragraph in a reply, and its pattern.
MARKER = r"(?m)^===PARAGRAPH\s+\d+===\s*$"
#: Fixed value: an ampersand that starts no entity.
BARE_AMPERSAND = r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9a-fA-F]+);)"
#: Languages by their base subtag.
LANGUAGE_NAMES = {
    "ru": "Russian", "de": "German", "fr": "French", "es": "Spanish", "it": "Italian", "pt": "Portuguese", "nl": "Dutch", "pl": "Polish", "uk": "Ukrainian", "zh": "Chinese",
    "ja": "Japanese", "ko": "Korean", "ar": "Arabic", "tr": "Turkish", "sv": "Swedish", "no": "Norwegian", "da": "Danish", "fi": "Finnish", "cs": "Czech", "hu": "Hungarian",
}


def words(text: Column) -> Column:
    """Runs without (Unicode) white space; null for null."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.size(words(text)), F.lit(0))


def squeeze(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def plain_text(fragment: Column) -> Column:
    """A fragment without its tags."""
    return squeeze(F.regexp_replace(fragment, "<[^>]+>", " "))


def strip(text: Column) -> Column:
    """Without ASCII white space at the ends; no regular expression over the whole text."""
    return F.btrim(text, F.lit(" \t\n\r\f\x0b"))


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated a single time, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip_fences(text: Column) -> Column:
    """The text without a leading ``` line and its closing fence; trimmed."""

    def opened(whole: Column) -> Column:
        inner = F.regexp_replace(F.regexp_replace(whole, r"^```[^\n]*(\n|$)", ""), r"(^|\n)```[^\n]*$", "")
        return F.when(whole.startswith("```"), strip(inner)).otherwise(whole)

    return once(strip(text), opened)


def split_markers(text: Column) -> Column:
    """The paragraphs behind marker lines, trimmed, numbers unchecked; null without a marker."""
    return once(F.split(strip_fences(text), MARKER), lambda parts: F.when(F.size(parts) > 1, F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), strip)))


def join_markers(paragraphs: Column) -> Column:
    """The inverse of ``split_markers``."""
    return F.concat_ws("\n", F.transform(paragraphs, lambda p, i: F.concat(F.lit("===PARAGRAPH "), (i + 1).cast("string"), F.lit("===\n"), p)))


def escape_ampersands(text: Column) -> Column:
    return F.regexp_replace(text, BARE_AMPERSAND, "&amp;")


def is_no_changes(text: Column) -> Column:
    """A reply that changes nothing: bare or back-quoted, or in a fence after commentary unless an array
    is in the reply too."""
    bare = F.trim(text).rlike(r"(?i)^`*\s*NO[_ ]?CHANGES\s*`*$")
    fenced = F.regexp_extract_all(text, F.lit(r"(?s)```[^\n]*\n(.*?)```"), 1)
    inside = F.exists(fenced, lambda b: strip(b).rlike(r"(?i)^`*\s*NO[_ ]?CHANGES\s*`*$"))
    return bare | (~text.contains("[") & inside)


def is_delta(text: Column) -> Column:
    """A reply to be read as patches: no changes, an array, or no marker at all."""
    body = strip_fences(text)
    return (F.regexp_replace(F.upper(body), "[_ ]", "") == "NOCHANGES") | body.startswith("[") | ~body.rlike(MARKER)


def breaks_dash(before: Column, after: Column) -> Column:
    """Whether an opening dialogue dash would become a guillemet."""
    return before.rlike(r"^\s*(?:<[^>]+>\s*)*[—–]\s") & after.rlike(r"^\s*(?:<[^>]+>\s*)*«")


def content_key(*parts: Column) -> Column:
    """SHA-256 over the parts, each followed by the unit separator; a null part is empty."""
    return F.sha2(F.concat(*[x for p in parts for x in (F.coalesce(p.cast("string"), F.lit("")), F.lit("\x1f"))]), 256)


def language_name(code: Column, given: Column | None = None) -> Column:
    """The name ``given`` for a language if there is one, else that of its tag's base language; null where the
    list has none."""
    names = F.create_map(*[x for k, v in LANGUAGE_NAMES.items() for x in (F.lit(k), F.lit(v))])
    listed = F.try_element_at(names, F.split(F.replace(F.lower(code), F.lit("_"), F.lit("-")), "-")[0])
    return listed if given is None else F.coalesce(F.nullif(given, F.lit("")), listed)


def normalize_path(path: Column) -> Column:
    """An archive path without fragment and query, ``.`` and ``..`` resolved; ``..`` at the root stays out."""
    steps = F.split(F.regexp_replace(path, r"[?#].*$", ""), "/")
    kept = F.aggregate(steps, F.expr("cast(array() as array<string>)"), lambda a, s: F.when((s == "") | (s == "."), a).when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))))
    return F.array_join(kept, "/")


def image_type(content: Column) -> Column:
    """The media type that the first bytes tell; null for none known."""
    first = F.hex(F.substring(content, 1, 12))
    return (
        F.when(first.startswith("FFD8FF"), "image/jpeg")
        .when(first.startswith("89504E470D0A1A0A"), "image/png")
        .when(first.startswith("52494646") & (F.substring(first, 17, 8) == "57454250"), "image/webp")
        .when(first.startswith("474946383761") | first.startswith("474946383961"), "image/gif")
        .when(first.startswith("424D"), "image/bmp")
        .when(first.startswith("49492A00") | first.startswith("4D4D002A"), "image/tiff")
    )


def retry_budget(n: Column) -> Column:
    return F.greatest(F.lit(3), F.floor(n / 10)).cast("int")


def wait_seconds(header: Column, attempt: Column, base: float = 1.0, most: float = 300.0) -> Column:
    """What a server asks for, between 0 and ``most``; else a doubling wait."""
    return F.coalesce(F.least(F.greatest(F.try_to_number(header, F.lit("999999.99")).cast("double"), F.lit(0.0)), F.lit(most)), F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most)))
