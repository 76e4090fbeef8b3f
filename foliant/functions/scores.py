"""Scores of text and of Markdown tables: Column -> Column."""

from __future__ import annotations

from string import ascii_letters, digits

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import WORD, compress_markdown, count_chars, count_words, normalize_cell, once, strip, strip_markdown_syntax, whole

# Fixed values.
QUALITY_CHARS = r"[a-zA-ZáéíóúÁÉÍÓÚñÑüÜ0-9\s,.;:!?()\"'\-/%$#@&]"
VOWEL = "[aeiouáéíóúAEIOUÁÉÍÓÚ]"
VOWEL_WIDE = "[aeiouáéíóúüAEIOUÁÉÍÓÚÜ]"
ACCENT = "[áéíóúÁÉÍÓÚñÑ]"
SPANISH_LETTER = "[a-záéíóúñA-ZÁÉÍÓÚÑ]"
#: The letters one by one, which the engine looks up in a table, and those that are no vowels.
LETTERS = f"[{ascii_letters}áéíóúñÁÉÍÓÚÑ]"
CONSONANTS = f"[{''.join(c for c in ascii_letters + 'ñÑ' if c not in VOWEL)}]"
WORD_CHAR = r"[\p{L}\p{N}_]"
HEADER_KEYS = ("FECHA", "NOMBRE", "CONCEPTO", "PAGO", "IMPORTE", "PAGADO", "MONTO", "REAL", "ROBADO")
PAYROLL_KEYS = ("FECHA", "NOMBRE", "CONCEPTO", "IMPORTE", "PAGO")
HEADER_HINTS = "fecha|nombre|concepto|pago|importe|monto|cantidad|descripci[oó]n|precio|total"
EDGE = r"[^\p{L}\p{N}_]"
DATE_CELL = rf"(?:^|{EDGE})\d{{1,2}}/\d{{1,2}}/\d{{2,4}}(?:$|{EDGE})"
MONEY_CELL = r"\$\s*[\d,]+"


def bounded(words: str) -> str:
    """A pattern for whole words, with edges that mean the same in every regex dialect."""
    return rf"(?:^|{EDGE})(?:{words})(?:$|{EDGE})"


def ratio(part: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(part / total)


def text_quality_score(text: Column) -> Column:
    """Of stripped Markdown: share of useful characters, length, words and lines; 0 to 165."""
    return once(strip_markdown_syntax(text), plain_quality_score)


def plain_quality_score(plain: Column) -> Column:
    """text_quality_score of a text that is stripped already. Columns of their own, or `once`, keep it from being stripped
    for each part of the score, also inside branches, which generated code does not look into."""
    length = F.length(plain)
    useful = count_chars(plain, QUALITY_CHARS) / F.greatest(length, F.lit(1)) * 55
    words = F.least(count_words(plain), F.lit(400)) / 10
    lines = F.least((plain != "").cast("int") + F.regexp_count(plain, F.lit(r"\n\s*+")), F.lit(80)) / 4
    return useful + F.least(length, F.lit(3000)) / 60 + words + lines


def share(text: Column, good: str, all_: str) -> Column:
    """Matches of good for each match of all_, 0 without any."""
    total = F.regexp_count(whole(text), F.lit(all_))
    return F.regexp_count(whole(text), F.lit(good)) / F.greatest(total, F.lit(1))


def token_vowel_ratio(text: Column) -> Column:
    """Share of runs of three or more Spanish letters that hold a vowel. Those without one are counted, as they are few."""

    def share_of(t: Column) -> Column:
        runs = lambda bare: once(F.regexp_count(t, F.lit(f"{LETTERS}{{3,}}+")), lambda n: (n - bare) / n)
        any_ = F.when(t.rlike(f"{LETTERS}{{3}}"), 1.0).otherwise(0.0)
        return once(F.regexp_count(t, F.lit(rf"{CONSONANTS}(?<!{LETTERS}.){CONSONANTS}{{2,}}+(?!{LETTERS})")), lambda bare: F.when(bare == 0, any_).otherwise(runs(bare)))

    return once(whole(text), share_of)


def word_vowel_ratio(text: Column) -> Column:
    """Share of words that hold a vowel or have five characters."""
    return share(text, rf"{WORD_CHAR}{{5,}}|{WORD_CHAR}*{VOWEL_WIDE}{WORD_CHAR}*", WORD)


def accent_words(text: Column) -> Column:
    """Struct (words, good): the words, and those that hold an accent or have four characters; both from one pass, which
    leaves a blank for each word, with one of its characters if it is good, and a blank for what follows the last."""
    c, gap = WORD_CHAR, r"[^\p{L}\p{N}_]"
    marked = F.regexp_replace(whole(text), rf"{gap}*+(?:{c}{{3}}({c}){c}*+|{c}*?({ACCENT}){c}*+|{c}++)|{gap}++\z", " $1$2")
    tail = F.substring(whole(text), -1, 1).rlike(gap).cast("int")

    def counted(m: Column, good: Column) -> Column:
        return F.struct((F.length(m) - good - tail).alias("words"), good.alias("good"))

    return once(marked, lambda m: once(F.length(F.replace(m, F.lit(" "), F.lit(""))), lambda good: counted(m, good)))


def accent_share(words: Column) -> Column:
    return words["good"] / F.greatest(words["words"], F.lit(1))


def word_accent_ratio(text: Column) -> Column:
    """Share of words that hold an accent or have four characters."""
    return once(accent_words(text), accent_share)


#: Characters of a length that count, and how many of a text mostly hold as many.
MOST_CHARS, FIRST_CHARS = 3000, 4000


def default_quality_score(text: Column, words: Column | None = None) -> Column:
    """Of the text without marks of Markdown: length, words and share of good words; at most 110.

    words: accent_words of the text, where it is a column already.
    """
    size = lambda t: F.length(strip(F.regexp_replace(t, r"[#*|_>`\[\]()\s]++", " ")))
    full = whole(text)
    # a text is no shorter than its beginning
    most = F.lit(MOST_CHARS)
    length = once(F.least(size(F.substring(full, 1, FIRST_CHARS)), most), lambda n: F.when((n >= most) | (F.length(full) <= FIRST_CHARS), n).otherwise(F.least(size(full), most)))
    # of the marks, only an underscore is part of a word
    bare = accent_words(F.replace(full, F.lit("_"), F.lit(" ")))
    own = bare if words is None else F.when(full.contains("_"), bare).otherwise(words)
    return once(own, lambda w: length / 60 + F.least(w["words"], F.lit(400)) / 10 + accent_share(w) * 20)


def base64_char_ratio(text: Column) -> Column:
    return ratio(count_chars(whole(text), f"[{ascii_letters}{digits}+/=]"), F.length(whole(text)))


def header_hits(text: Column) -> Column:
    upper = F.upper(whole(text))
    return sum((upper.contains(k).cast("int") for k in HEADER_KEYS), F.lit(0))


def minimum_pdf_text_chars(pages: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(36), F.greatest(F.coalesce(pages, F.lit(1)), F.lit(1)) * 18))


def saved_pct(text: Column) -> Column:
    """Per cent that compressing saves, to one place; negative where the final line end costs more."""
    return F.when(F.length(whole(text)) == 0, F.lit(0.0)).otherwise(F.bround((1 - F.length(compress_markdown(text)) / F.length(text)) * 100, 1))


def table_lines(markdown: Column) -> Column:
    return F.filter(F.split(whole(markdown), "\n", -1), lambda x: x.rlike(r"^\s*\|"))


def cell_is_garbage(cell: Column) -> Column:
    def garbage(text: Column) -> Column:
        fine = F.regexp_count(text, F.lit(r"[\p{L}\p{N}$.,/-]"))
        return F.when(text == "", False).otherwise(
            ((F.length(text) <= 2) & ~text.rlike("^[0-9]+$")) | (fine / F.length(text) < 0.45) | text.rlike(r"^(?:[^\p{L}\p{N}_]|_){1,4}$")
        )

    return once(normalize_cell(cell), garbage)


def with_lines(markdown: Column, body) -> Column:
    """body(markdown, its table lines), each worked out once per row."""
    return once(whole(markdown), lambda m: once(table_lines(m), lambda lines: body(m, lines)))


def width(lines: Column) -> Column:
    """Columns of the first of some table lines, 0 without any."""
    first = F.try_element_at(lines, F.lit(1))
    return F.coalesce(F.length(first) - F.length(F.replace(first, F.lit("|"), F.lit(""))) - 1, F.lit(0))


def body_lines(lines: Column) -> Column:
    return F.filter(lines, lambda x: ~x.contains("---"))


def table_columns(markdown: Column) -> Column:
    return width(table_lines(markdown))


def looks_like_payroll(markdown: Column) -> Column:
    """Date, name and concept headers with amounts, in three to ten columns."""
    return with_lines(markdown, _is_payroll)


def _is_payroll(m: Column, lines: Column) -> Column:
    def headed(upper: Column) -> Column:
        amount = upper.contains("IMPORTE") | upper.contains("PAGO") | m.rlike(DATE_CELL) | m.rlike(MONEY_CELL)
        return upper.contains("FECHA") & upper.contains("NOMBRE") & upper.contains("CONCEPTO") & amount & width(body_lines(lines)).between(3, 10)

    return once(F.when(m.rlike("[oO][mM][bB][rR]"), F.upper(m)).otherwise(""), headed)  # few texts hold a part of NOMBRE


def _marks(text: Column) -> Column:
    return F.struct(text.rlike("(?iu)" + bounded(HEADER_HINTS)).alias("hint"), text.rlike(DATE_CELL).alias("date"), text.rlike(MONEY_CELL).alias("money"))


def table_content_quality(markdown: Column) -> Column:
    """Share of good cells, raised by dates, money and headers; at most 1."""
    return with_lines(markdown, lambda m, lines: once(_marks(m), lambda marks: _quality(lines, marks)))


def _quality(lines: Column, marks: Column) -> Column:
    split = F.transform(body_lines(lines), lambda x: F.transform(F.split(F.regexp_replace(strip(x), r"^\|+|\|+$", ""), r"\|", -1), strip))
    bonus = F.when(marks["date"], 0.15).otherwise(0.0) + F.when(marks["money"], 0.15).otherwise(0.0) + F.when(marks["hint"], 0.1).otherwise(0.0)

    def share_(cells: Column, full: Column) -> Column:
        good = F.size(F.filter(full, lambda c: (F.length(c) >= 2) & ~cell_is_garbage(c)))
        empty = 1.0 - F.size(full) / F.greatest(F.size(cells), F.lit(1))
        none = (F.size(full) == 0) | ((width(lines) > 8) & (empty > 0.35))
        return F.when(none, 0.0).otherwise(F.least(F.lit(1.0), good / F.size(full) + bonus))

    cells = once(F.flatten(split), lambda cells: once(F.filter(cells, lambda c: c != ""), lambda full: share_(cells, full)))
    return F.when(F.size(lines) < 3, 0.0).otherwise(cells)


def score_table_markdown(markdown: Column, quality: Column | None = None) -> Column:
    """How much a Markdown table looks like a real one; 0 below three table lines or a quality of 0.28.

    quality: table_content_quality, where it is a column already.
    """

    def of_body(m: Column, lines: Column, marks: Column) -> Column:
        # the marks of the table's lines, which most often are all of the text
        table = once(F.array_join(lines, "\n"), lambda body: F.when(body == m, marks).otherwise(_marks(body)))
        own = _quality(lines, marks) if quality is None else quality
        return once(own, lambda q: F.when(q < 0.28, 0.0).otherwise(once(table, lambda t: once(width(lines), lambda n: _table_score(m, lines, q, t, n)))))

    return with_lines(markdown, lambda m, lines: F.when(F.size(lines) < 3, 0.0).otherwise(once(_marks(m), lambda marks: of_body(m, lines, marks))))


def _table_score(m: Column, lines: Column, quality: Column, marks: Column, columns: Column) -> Column:
    score = (
        F.least(F.size(lines), F.lit(80)) * 0.8 * quality + F.when(marks["hint"], 24 * quality).otherwise(0.0)
        + F.when(marks["date"], 18.0).otherwise(0.0) + F.when(marks["money"], 22.0).otherwise(0.0)
        + F.when(columns.between(4, 9), 12.0).when(columns > 10, -18.0).otherwise(0.0)
    )
    strange = (columns > 8) & ~_is_payroll(m, lines)
    return once(strange, lambda odd: F.when(odd & (columns > 10), 0.0).when(odd, F.least(score, F.lit(12.0))).otherwise(score))
