"""String functions over Markdown and plain text: Column -> Column, inside Catalyst.

White space is ASCII (`\\s`), also where Python's strip() would take more. Nulls count as empty strings.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAGE_BREAK = "\n\n---\n\n"
WORD = r"[\p{L}\p{N}_]+"

# Steps of the rewrites, in order (pattern, replacement, and a string that every match holds, where there is
# one); (?md) makes ^ and $ match at \n alone.
NORMALIZE_STEPS = [("\r\n", "\n"), ("\r", "\n"), ("\f", "\n\n---\n\n"), (r"\n{3,}", "\n\n", "\n\n\n")]
STRIP_STEPS = [
    (r"(?md)^#{1,6}\s+", "", "#"), (r"(?md)^\s*[-*]\s+", ""), (r"(?md)^\s*\d+\.\s+", ""),
    (r"(?md)^\s*\|?(?:\s*:?-+:?\s*\|)++\s*$", "", "|"), ("|", " "), ("*", ""), ("_", ""),
    (r"\[(.*?)\]\((.*?)\)", "$1", "]("), (r"\n\s*---\s*\n", "\n\n", "---"), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n", "\n\n\n"),
]


def rewrite(text: Column, steps: list[tuple]) -> Column:
    """text after the steps. A pattern that is one character, or control characters alone, is taken as it is, by bytes; one
    with a string that all its matches hold is not tried on texts without that."""
    for pattern, replacement, *held in steps:
        if len(pattern) == 1 or not pattern.strip("\r\n\f"):
            text = F.replace(text, F.lit(pattern), F.lit(replacement))
        elif held:
            text = once(text, lambda t: F.when(t.contains(held[0]), F.regexp_replace(t, pattern, replacement)).otherwise(t))  # noqa: B023
        else:
            text = F.regexp_replace(text, pattern, replacement)
    return text


def once(value: Column, body) -> Column:
    """body(value), with value worked out once per row however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def count_chars(text: Column, kind: str) -> Column:
    """Characters of a class ([...]), without an array of them."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{kind}++", ""))


def count_words(text: Column) -> Column:
    """Matches of WORD, without an array of them: each, with what comes before it, to an x, and none is in what follows."""
    marked = F.regexp_replace(text, rf"[^\p{{L}}\p{{N}}_]*+{WORD}+", "x")
    return once(marked, lambda m: F.length(m) - F.length(F.replace(m, F.lit("x"), F.lit(""))))


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    """Without \\s at both ends, by bytes: a pattern would be tried at every place of the text."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def normalize_markdown(text: Column) -> Column:
    """Line ends to LF, form feeds to page breaks, at most one empty line in a row, stripped."""
    return strip(rewrite(whole(text), NORMALIZE_STEPS))


def normalize_whitespace(text: Column) -> Column:
    """No-break spaces and runs of blanks to one space, at most one empty line in a row, stripped."""
    return strip(rewrite(whole(text), [(" ", " "), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")]))


def strip_markdown_syntax(text: Column) -> Column:
    """Plain text of Markdown. Asterisks and underscores go everywhere, before links are read."""
    return strip(rewrite(normalize_markdown(text), STRIP_STEPS))


def compress_markdown(text: Column) -> Column:
    """Trailing blanks off, runs of blanks to one, at most one empty line in a row, one line end at the end."""
    lines = F.transform(F.split(whole(text), "\n", -1), lambda x: F.regexp_replace(F.regexp_replace(x, r"\s+$", ""), r"[ \t]+", " "))
    body = strip(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))
    return F.when(body == "", "").otherwise(F.concat(body, F.lit("\n")))


USEFUL = r"[a-zA-ZáéíóúÁÉÍÓÚñÑüÜ0-9\s,.;:!?()\"'\-/]"
OUTSIDE = r"[^\x20-\x7EáéíóúÁÉÍÓÚñÑüÜ«»°\n]"


def clean_text(text: Column, min_useful_ratio: float = 0.55, min_len_skip: int = 40) -> Column:
    """Short lines of mostly odd characters go, odd characters go from the others; empty lines never lead or repeat.

    A line that is empty only after cleaning is no empty line: it goes.
    """

    def line(raw: Column) -> Column:
        s = strip(raw)
        useful = F.regexp_count(s, F.lit(USEFUL)) / F.length(s)
        cleaned = strip(F.regexp_replace(s, OUTSIDE, ""))
        drop = (useful < min_useful_ratio) & (F.length(s) < min_len_skip) | (cleaned == "")
        return F.when(s == "", "").when(drop, F.lit(None)).otherwise(cleaned)

    kept = F.filter(F.transform(F.split(whole(text), "\n", -1), line), lambda x: x.isNotNull())
    return F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), r"^\n+", ""), r"\n{3,}", "\n\n")


def normalize_cell(cell: Column) -> Column:
    """A table cell on one line: white space runs to one space, pipes to slashes."""
    return F.replace(strip(F.regexp_replace(whole(cell), r"\s+", " ")), F.lit("|"), F.lit("/"))


def normalize_wide_cell(cell: Column) -> Column:
    """The other cell rule: blanks collapse, line ends become a space each."""
    return strip(F.regexp_replace(F.regexp_replace(normalize_whitespace(cell), "\n", " "), r"\|", "/"))


def section_title(content: Column, index: Column) -> Column:
    """The first heading (80 characters), page banner or part line; else a preview of 60 characters."""
    lines = F.transform(F.split(content, "\n", -1), strip)
    first = F.try_element_at(F.filter(lines, lambda x: x.startswith("#") | (x.startswith("---") & x.contains("Página"))), F.lit(1))
    numbered = F.concat(F.lit("Sección "), (index + 1).cast("string"))
    heading = F.substring(strip(F.regexp_replace(first, r"^#+\s*", "")), 1, 80)
    banner = F.substring(strip(F.regexp_replace(first, "---", "")), 1, 80)
    body = strip(content)
    preview = F.concat(F.substring(F.regexp_replace(body, r"\s+", " "), 1, 60), F.when(F.length(body) > 60, "…").otherwise(""))
    return F.when(first.startswith("#"), F.when(heading == "", numbered).otherwise(heading)).when(first.isNotNull(), banner).when(preview == "", numbered).otherwise(preview)


def safe_stem(filename: Column) -> Column:
    """A file's name without folder and last suffix, with characters that file systems refuse replaced."""
    name = F.regexp_extract(F.coalesce(F.nullif(filename, F.lit("")), F.lit("documento")), r"([^/]*)/*$", 1)
    stem = F.regexp_replace(name, r"(?s)^(.+)\.[^.]+$", "$1")
    stem = strip(F.regexp_replace(stem, r'[<>:"/\\|?*\x00-\x1F]', "_"))
    return F.when(stem == "", "documento").otherwise(F.substring(stem, 1, 200))


# What the tag stripper does, in order.
HTML_STEPS = [
    (r"(?is)<(script|style|head|nav|footer)[^>]*>.*?</(?:script|style|head|nav|footer)>", " "), (r"(?is)<!--.*?-->", " "),
    (r"(?i)<br[^>]*>", "\n"), (r"(?i)</(p|h1|h2|h3|li|tr|div|article)>", "\n\n"), (r"(?i)<h1[^>]*>", "# "), (r"(?i)<h2[^>]*>", "## "),
    (r"(?i)<li[^>]*>", "- "), (r"(?s)<[^>]*>", ""), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", "\""), ("&#39;", "'"), ("&amp;", "&"),
    (r"[ \t]+", " "), (r" ?\n ?", "\n"), (r"\n{3,}", "\n\n"),
]


def html_to_markdown(html: Column) -> Column:
    """The fallback converter for HTML: blocks on their own lines, headings and bullets marked, everything else text."""
    return strip(rewrite(whole(html), HTML_STEPS))
