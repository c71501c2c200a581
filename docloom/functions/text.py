"""Scalar text functions as column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English stopwords of the lexical index, fixed values; negations are left in on purpose.
STOPWORDS = (
    "a an and are as at be but by for from has have he her hers him his how i if in into is it its itself just me more most my myself "
    "of on or our ours ourselves out she so than that the their theirs them themselves then there these they this those through to too "
    "under until up us very was we were what when where which who whom why will with you your yours yourself yourselves"
).split()
#: Phrases that mark a chunk as boilerplate, fixed values.
BOILERPLATE = [
    "this section of the federal register",
    "table of contents",
    "table of abbreviations",
    "list of subjects",
    "public participation",
    "for further information contact",
    "addresses:",
    "comments must be submitted",
    "http:// www.regulations.gov",
    "verdate sep",
    "jkt ",
    " frm ",
    " fmt ",
    " sfmt ",
    "e:\\fr\\fm",
]
#: Register page furniture, fixed patterns.
REGISTER_HEADER = r"(?i)\bFederal Register\s*/\s*Vol\.\s*\d+.*?Rules and Regulations\b"
REGISTER_FOOTER = r"(?i)\bVerDate\b.*?\bJkt\b|\bE:\\FR\\FM\\b"


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def replace_all(c: Column | str, *rules: tuple[str, str]) -> Column:
    """Regular expressions replaced one after another."""
    out = _column(c)
    for pattern, by in rules:
        out = F.regexp_replace(out, pattern, by)
    return out


def join_broken(c: Column) -> Column:
    """Words broken by a hyphen at a line's end joined; the costly pattern runs on texts with such an end only."""
    return F.when(F.contains(c, F.lit("-\n")), F.regexp_replace(c, r"(?U)(\w)-\n(\w)", "$1$2")).otherwise(c)


def normalize_text(c: Column | str) -> Column:
    """Words broken over a line joined, white space collapsed, ends trimmed; null gives the empty string."""
    return F.btrim(F.regexp_replace(join_broken(F.coalesce(_column(c), F.lit(""))), r"(?U)[\s\x1c-\x1f]+", " "))


def tokenize(c: Column | str) -> Column:
    """Runs of a-z and 0-9 of the normalised lower-case text; how white space is normalised makes no difference to them."""
    return F.regexp_extract_all(F.lower(join_broken(F.coalesce(_column(c), F.lit("")))), F.lit("[a-z0-9]+"), F.lit(0))


def filter_tokens(tokens: Column | str, min_length: int = 2, stopwords: list[str] | None = None) -> Column:
    """Tokens of some length that are no stopwords; order and repeats are kept."""
    listed = STOPWORDS if stopwords is None else stopwords

    def kept(t: Column) -> Column:
        return (F.length(t) >= min_length) & ~t.isin(*listed) if listed else F.length(t) >= min_length

    return F.filter(_column(tokens), kept)


def clean_text(c: Column | str, preserve_paragraphs: bool = False) -> Column:
    """Page text without line breaks, register headers and footers and control characters.

    Unless ``preserve_paragraphs``, the last step deletes the paragraph breaks too, without leaving a space.
    """
    out = F.translate(F.coalesce(_column(c), F.lit("")), "\r\t", "\n ")
    # hyphens are joined before tabs become spaces; a tab isn't a word character, so the order makes no difference
    out = replace_all(out, (r"(?U)(\w)-\n(\w)", "$1$2"), (" +", " "), ("\n{3,}", "\n\n"), ("\n\n", "\u0000"), ("\n", " "), ("\u0000", "\n\n"))
    out = replace_all(out, (REGISTER_HEADER, ""), (REGISTER_FOOTER, ""), ("[ \t]+", " "), ("\n{3,}", "\n\n"))
    out = replace_all(out, (r"[\x00-\x09\x0b-\x1f\x7f-\x9f]" if preserve_paragraphs else r"[\x00-\x1f\x7f-\x9f]", ""))
    return F.regexp_replace(out, r"(?U)^\s+|\s+$", "")


def is_boilerplate(c: Column | str) -> Column:
    low = F.lower(_column(c))
    out = F.lit(False)
    for phrase in BOILERPLATE:
        out = out | F.contains(low, F.lit(phrase))
    return out


def _parts(array: Column) -> Column:
    return F.filter(F.transform(array, lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")


def split_units(c: Column | str) -> Column:
    """Sentences of the paragraphs of cleaned text."""
    return F.flatten(F.transform(_parts(F.split(_column(c), "\n\n")), lambda p: _parts(F.split(p, r"(?<=[.?!])[ \t]+"))))


def windows_of(c: Column, size: int) -> Column:
    """Fixed windows, trimmed, without empty ones."""
    return _parts(F.transform(F.sequence(F.lit(0), F.greatest(F.length(c) - 1, F.lit(0)), F.lit(size)), lambda i: F.substring(c, i + 1, F.lit(size))))


def split_oversized(c: Column | str, max_chars: int = 2000, window: int = 800) -> Column:
    """A unit within the limit as it is, else its paragraphs, else their clauses, else fixed windows."""
    unit = _column(c)

    def finer(parts: Column, how) -> Column:
        return F.flatten(F.transform(parts, lambda p: F.when(F.length(p) <= max_chars, F.array(p)).otherwise(how(p))))

    def clauses(p: Column) -> Column:
        found = _parts(F.split(p, r"(?U)(?<=[;:,)])\s+"))
        return F.when(F.size(found) > 0, found).otherwise(F.array(p))

    paragraphs = F.when(F.contains(unit, F.lit("\n\n")), _parts(F.split(unit, "\n\n"))).otherwise(F.array(unit))
    return F.when(F.length(unit) <= max_chars, F.array(unit)).otherwise(finer(finer(paragraphs, clauses), lambda p: windows_of(p, window)))


def summary_paragraphs(c: Column | str) -> Column:
    """Paragraphs, split only if one of them exceeds 1,500 characters."""
    found = _parts(F.split(F.coalesce(_column(c), F.lit("")), "\n\n"))
    joined = F.array_join(found, "\n\n")
    return F.when(F.size(found) == 0, F.array().cast("array<string>")).when(F.exists(found, lambda p: F.length(p) > 1500), found).otherwise(F.array(joined))


#: What the tags of blocks, breaks and list items leave behind: at their beginning and at their end.
TAG_EFFECTS = {"br": ("\n", ""), "p": ("", "\n\n"), "div": ("", "\n\n"), "li": ("- ", "\n"), "ul": ("", "\n"), "ol": ("", "\n")}
_TAG = r"<\s*br\s*/?\s*>|</\s*(?:p|div|li|ul|ol)\s*>|<\s*(?:p|div|li|ul|ol)(?:\s[^>]*)?>"


def _effect(piece: Column) -> Column:
    """The text that a known tag leaves behind; any other piece as it is."""
    name, ends = F.lower(F.regexp_extract(piece, r"^<\s*/?\s*(\w+)", 1)), F.startswith(piece, F.lit("</"))
    out = piece
    for tag, (begin, end) in TAG_EFFECTS.items():
        out = F.when(name == tag, F.when(ends, F.lit(end)).otherwise(F.lit(begin))).otherwise(out)
    return F.when(F.rlike(piece, F.lit(f"^(?i:{_TAG})$")), out).otherwise(piece)


def html_to_text(c: Column | str, decode: bool = True) -> Column:
    """Plain text of simple markup: entities first, then breaks, paragraphs, list items; other tags go, their content stays.

    One scan finds the known tags and puts their effect in their place; texts without a tag are spared it. All entities
    are decoded, by Python on the rows that have one.
    """
    out = F.coalesce(_column(c), F.lit(""))
    if decode:
        from docloom.functions.values import unescape

        out = F.coalesce(unescape(F.when(F.contains(out, F.lit("&")), out)), out)
    pieces = F.regexp_extract_all(out, F.lit(f"(?i){_TAG}|[^<]+|<"), F.lit(0))
    out = F.when(F.contains(out, F.lit("<")), F.array_join(F.transform(pieces, _effect), "")).otherwise(out)
    # what is left of tags, then runs of white space: two line breaks at most, no blanks around one, one blank elsewhere
    end = r"(?>\r\n|\r|\n)"
    out = replace_all(out, (r"<[^>]+>", ""), (rf"[ \t]*{end}[ \t]*(?:{end}[ \t]*)+", "\n\n"), (rf"[ \t]*{end}[ \t]*", "\n"), (r"[ \t]{2,}", " "))
    return F.regexp_replace(out, r"(?U)^\s+|\s+$", "")


def shorten(c: Column | str, max_chars: int = 220) -> Column:
    """One line of at most ``max_chars`` characters, the last an ellipsis if something is cut (snippet 220, excerpt 75)."""
    flat = F.btrim(F.regexp_replace(F.coalesce(_column(c), F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(flat) <= max_chars, flat).otherwise(F.concat(F.substring(flat, 1, max_chars - 1), F.lit("…")))


def truncate_error(c: Column | str, max_chars: int = 800) -> Column:
    text = _column(c)
    return F.when(F.length(text) <= max_chars, text).otherwise(F.concat(F.substring(text, 1, max_chars - 3), F.lit("...")))


def source_label(c: Column | str) -> Column:
    kind = _column(c)
    return F.when(kind == "policy_title", "title").when(kind == "policy_summary", "summary").otherwise("pdf")


def slug(c: Column | str, max_chars: int = 80) -> Column:
    """File-name form: lower case, hyphens for white space, "untitled" if nothing is left."""
    out = replace_all(F.lower(F.btrim(F.coalesce(_column(c), F.lit("")))), (r"\s+", "-"), ("[^a-z0-9_-]+", ""), ("-+", "-"), ("^-+|-+$", ""))
    return F.substring(F.when(out == "", "untitled").otherwise(out), 1, max_chars)


def query_slug(c: Column | str, max_chars: int = 80) -> Column:
    out = replace_all(F.lower(F.coalesce(_column(c), F.lit(""))), ("[^a-z0-9]+", "_"), ("^_+|_+$", ""))
    return F.substring(F.when(out == "", "query").otherwise(out), 1, max_chars)


def word_set(c: Column | str) -> Column:
    """Distinct lower-case words of two or more characters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(_column(c), F.lit(""))), F.lit("[a-z0-9]{2,}"), F.lit(0)))


def containment(a: Column, b: Column) -> Column:
    """Share of set a that set b has; 0 for an empty a."""
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))
