"""Tokens, normalised text, line lists and hashes as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quillsift.functions import lexicon as lx


def _lit(pattern: str) -> Column:
    return F.lit(pattern)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, also where a lambda uses it repeatedly."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(text: Column) -> Column:
    """Case folding: lower case, and the sharp s becomes two letters."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def tokens(text: Column) -> Column:
    """Word tokens of the folded text in order, repeats kept."""
    return F.regexp_extract_all(fold(text), _lit(lx.WORD), F.lit(0))


def is_stop(token: Column) -> Column:
    """Is a token in the stop list? Tokens hold no blanks, so one substring test decides."""
    listed = F.lit(" " + " ".join(lx.STOP_WORDS) + " ")
    return F.contains(listed, F.concat(F.lit(" "), token, F.lit(" ")))


def content_terms(toks: Column) -> Column:
    """Distinct tokens of two characters or more outside the stop list, first occurrence first."""
    return F.filter(F.array_distinct(toks), lambda t: (F.length(t) > 1) & ~is_stop(t))


def ngrams(toks: Column, size: int) -> Column:
    """All runs of ``size`` neighbouring tokens of an array column, joined by one blank."""
    last = F.size(toks) - size
    return F.when(
        last >= 0,
        F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
                    lambda i: F.concat_ws(" ", *[F.get(toks, i + k if k else i) for k in range(size)])),
    ).otherwise(F.array().cast("array<string>"))


def loaded_ngrams(toks: Column, size: int) -> Column:
    """Runs of ``size`` tokens that hold at least two non-stop words."""
    last = F.size(toks) - (size - 1)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
                        lambda i: F.slice(toks, i, F.lit(size)))
    kept = F.filter(grams, lambda g: F.size(F.filter(g, lambda t: ~is_stop(t))) >= 2)
    return F.when(last > 0, F.transform(kept, lambda g: F.array_join(g, " "))).otherwise(
        F.array().cast("array<string>"))


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of every kind."""
    return F.btrim(text, F.lit(lx.WS_CHARS))


def squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(text, f"[{lx.WS}]+", " "))


def nfc(text: Column) -> Column:
    """Canonical composition, in the JVM by the Unicode library Spark itself ships.

    Only text holding a character that may change is sent through; the first test is a single range
    and settles nearly all Latin text. The reflective call counts as non-deterministic for the
    optimizer, so use the result as a column before grouping by it.
    """
    beyond_latin = text.rlike("[\\x{300}-\\x{10FFFF}]")
    suspicious = beyond_latin & text.rlike(f"[^{lx.NFC_SAFE}]")
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
    return F.when(suspicious, composed).otherwise(text)


def normalized(text: Column) -> Column:
    return squeeze(nfc(text))


def group_key(text: Column) -> Column:
    """Key under which two questions or two answers count as the same."""
    return F.regexp_replace(fold(normalized(text)), "[ ?.!。]+$", "")


def clean_document(text: Column, compose: bool = True) -> Column:
    """Line ends, blanks and empty-line runs of a source document made uniform."""
    out = F.coalesce(text, F.lit(""))
    out = F.replace(out, F.lit("\r"), F.lit("\n"))
    out = nfc(out) if compose else out
    out = F.regexp_replace(out, "[ \\t]+", " ")
    out = F.regexp_replace(out, "\\n[ \\t]*+\\n(?:[ \\t]*+\\n)++", "\n\n")
    return strip(out)


def word_count(text: Column) -> Column:
    return F.size(words(text))


def words(text: Column) -> Column:
    """Parts between white space, as str.split() gives them."""
    return F.regexp_extract_all(text, _lit(lx.JAVA_NON_WS), F.lit(0))


def lines(text: Column) -> Column:
    """Parts between line ends; a pattern with the pair as an alternative would be tried at every character."""
    return F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), f"[{lx.JAVA_EOL}]")


def long_lines(text: Column, minimum: int = 35) -> Column:
    return long_of(lines(text), minimum)


def long_of(found: Column, minimum: int = 35) -> Column:
    """The long ones of an array of lines, trimmed."""
    return F.filter(F.transform(found, strip), lambda x: F.length(x) >= minimum)


def years(text: Column) -> Column:
    return F.regexp_extract_all(text, _lit(lx.JAVA_YEAR), F.lit(0))


def document_year(text: Column) -> Column:
    """Latest four-digit year 19xx or 20xx, null when none occurs."""
    return F.array_max(F.transform(years(text), lambda y: y.cast("int")))


def document_numbers(text: Column) -> Column:
    """Distinct folded document numbers whose last part holds a letter."""
    found = F.transform(F.regexp_extract_all(text, _lit("(?U)" + lx.DOC_NUMBER), F.lit(0)), F.lower)
    return F.array_distinct(
        F.filter(found, lambda n: F.substring_index(n, "/", -1).rlike("\\p{L}")))


def contains_any(text: Column, words) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.contains(text, F.lit(word))
    return out


def json_text(value: Column) -> Column:
    """A string as a JSON string literal, non-ASCII characters kept."""
    wrapped = F.to_json(F.struct(value.alias("v")))
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)


def digest(*parts) -> Column:
    """sha256 of the compact JSON list ``[part, ...]``; ints and string columns are accepted."""
    pieces = [F.lit(str(p)) if isinstance(p, int) else p for p in parts]
    inner = F.concat_ws(",", *pieces)
    return F.sha2(F.concat(F.lit("["), inner, F.lit("]")), 256)


def digest_object(**fields) -> Column:
    """sha256 of the compact JSON object with its keys in order."""
    parts = []
    for key in sorted(fields):
        value = fields[key]
        rendered = F.lit(str(value)) if isinstance(value, int) else value
        parts.append(F.concat(F.lit(f'"{key}":'), rendered))
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256)
