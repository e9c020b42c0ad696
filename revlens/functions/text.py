"""Column expressions for text cleaning, tokenizing and URL/label parsing.

All are built-in Spark expressions, so they stay inside whole-stage code
generation.  Patterns use explicit ``\\p{L}\\p{N}`` classes so that Java
regex and RE2 (the DuckDB oracle) agree; ``\\w`` is ASCII-only in Java.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: token pattern (word with apostrophe / hyphen, or a punctuation run)
TOKEN_PATTERN = r"[\p{L}\p{N}_'-]+|[^\p{L}\p{N}_\s'-]+"
# Python's str.isspace() set, so strip / collapse match the reference's str methods
WS_CLASS = (r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
# the same characters as they stand
WS_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
SENT_SEP = "\u0001"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ustrip(c) -> Column:
    """``str.strip()``: remove Unicode whitespace at both ends (C14); only the ends are looked at."""
    return F.btrim(_c(c), F.lit(WS_CHARS))


def collapse_ws(c) -> Column:
    """``re.sub(r'\\s+', ' ', t)`` with Unicode whitespace (C16); null stays null."""
    # a single space stays as it is and is no match
    return F.regexp_replace(_c(c), f" {WS_CLASS}+|[{WS_CLASS}&&[^ ]]{WS_CLASS}*", " ")


def drop_newlines(c) -> Column:
    """Delete newlines (not replace by space), then strip."""
    return ustrip(F.replace(_c(c), F.lit("\n"), F.lit("")))


def space_punct_text(c) -> Column:
    """Pad every char that is not alphanumeric, apostrophe or space with spaces, then strip (C17)."""
    return ustrip(F.regexp_replace(_c(c), r"([^\p{L}\p{N}' ])", " $1 "))


def split_punct_token(tok: Column) -> Column:
    """Token variant (C18): a space counts as punctuation too; empties removed."""
    padded = F.regexp_replace(tok, r"([^\p{L}\p{N}'])", " $1 ")
    return F.filter(F.split(ustrip(padded), " "), lambda x: x != "")


def split_punct_tokens(tokens: Column) -> Column:
    """C18 over a token array: token -> sub-tokens, flattened in order."""
    return F.flatten(F.transform(tokens, split_punct_token))


def tokenize(c) -> Column:
    """Regex tokenizer (D2): words or punctuation runs, group 0."""
    return F.regexp_extract_all(_c(c), F.lit(TOKEN_PATTERN), 0)


def sentences(c) -> Column:
    """Rule sentence split (D1): after a ``. ! ?`` that is followed by a space
    and a non-terminal character.  Replaces a trained boundary model."""
    marked = F.regexp_replace(_c(c), r"([.!?]) ([^.!? ])", "$1" + SENT_SEP + "$2")
    return F.split(marked, SENT_SEP)


def sentence_tokens(sents: Column) -> Column:
    """D3: tokenizer mapped over each sentence, then C18 per sentence."""
    return F.transform(sents, lambda s: split_punct_tokens(tokenize(s)))


def path_segment(url, idx: int) -> Column:
    """``url.split('/')[idx]``, null when too few parts."""
    return F.try_element_at(F.split(_c(url), "/"), F.lit(idx))


def file_stem(path) -> Column:
    """``path.split('/')[-1].split('.')[0]`` (C3 second form)."""
    last = F.element_at(F.split(_c(path), "/"), -1)
    return F.element_at(F.split(last, r"\."), 1)


def strip_ordinal(title) -> Column:
    """``'12. Name. Two'`` -> ``'Name. Two'``: drop the part before the first dot."""
    parts = F.split(_c(title), r"\.")
    return F.trim(F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), "."))


def locale_number(phrase) -> Column:
    """``'4,5 of 5'`` / ``'3,0 из 5'`` -> 4.5 / 3.0: text before the word, comma -> dot."""
    first = ustrip(F.element_at(F.split(_c(phrase), "of|из"), 1))
    return F.replace(first, F.lit(","), F.lit(".")).try_cast("double")


def bubble_rating(cls) -> Column:
    """Rating from a class suffix: ``bubble_45`` -> 4.5, ``bubble_5`` -> 5.0."""
    digits = F.element_at(F.split(_c(cls), "_"), -1)
    chars = F.filter(F.split(digits, ""), lambda x: x != "")
    return F.array_join(chars, ".").try_cast("double")


def page_url(url, n: Column, per_page: int) -> Column:
    """Pagination rewrite ``...-Reviews-X`` -> ``...-Reviews-or{n*per_page}-X``."""
    parts = F.split(_c(url), "Reviews", 2)
    return F.concat(F.element_at(parts, 1), F.lit("Reviews-or"),
                    (n * per_page).cast("string"), F.element_at(parts, 2))


def site_root(url) -> Column:
    """``scheme://host`` of a URL."""
    return F.regexp_extract(_c(url), r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)


def resolve_url(root, href) -> Column:
    """URL resolution against a site root (C4): absolute kept, root-relative
    prefixed with the root, other relative paths joined with ``/``."""
    h, r = _c(href), (_c(root) if not isinstance(root, str) else F.lit(root.rstrip("/")))
    return (F.when(h.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), h)
            .when(h.startswith("/"), F.concat(r, h))
            .otherwise(F.concat(r, F.lit("/"), h)))
