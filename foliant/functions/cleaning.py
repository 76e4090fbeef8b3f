"""Cleaning of recognised text: seals, stamps, encoded blobs, annotations: Column -> Column.

Tests on lines take a line as it is; the words they look for are fixed values of the documents they come from.
"""

from __future__ import annotations

from string import ascii_letters, digits

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.predicates import CLAUSE, ORDINAL, SENTENCE, capitals_only, has, has_long_base64, is_heading_line, is_stamp_line, is_table_line, tokens
from foliant.functions.scores import EDGE, VOWEL, base64_char_ratio, token_vowel_ratio, word_vowel_ratio
from foliant.functions.text import count_chars, normalize_markdown, normalize_whitespace, once, rewrite, strip, whole

# Phrases of digital tax seals that end a line's useful text, and what else goes from inside a line.
SEAL_TAILS = (
    "Sello digital del CFDI:?", "Sello digital del SAT:?", "Sello del SAT:?", "Cadena original del Complemento de Certificaci[oó]n Digital del SAT",
    "N[uú]mero de serie del Certificado(?: de Sello Digital)?(?: del SAT)?:?", "Certificado de Sello Digital:?", "Complemento de Certificaci[oó]n Digital del SAT",
    "Este documento es una representaci[oó]n impresa de un CFDI", "Persona Moral Grandes Contribuyentes", r"HOJA\s+\d+\s*/\s*\d+",
)
SEAL_LINE = (
    "sello digital del cfdi|sello digital del sat|sello del sat|cadena original del complemento|n[uú]mero de serie del certificado"
    "|certificado de sello digital|cadena original del timbre|complemento de certificaci[oó]n digital"
)
BOILERPLATE = r"representaci[oó]n impresa de un cfdi|persona moral grandes contribuyentes|^hoja\s*\d+\s*/\s*\d+\s*$"
#: Possessive groups: the engine takes a greedy group of varying length by recursion, a level for each round.
TAX_REPEAT = r"(?:objeto de (?:i|í|l|1)mpuesto:?\s*0?2\s*(?:s[iííl1]\s*objeto de impuesto\s*)++)++"
UUID = rf"(^|{EDGE})[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}($|{EDGE})"
SERIAL = rf"(^|{EDGE})\d{{17,20}}($|{EDGE})"
# Lines that are known to be noise or text.
KNOWN_LINE = (
    r"^(nombre|domicilio|curp|vigencia|secci[oó]n|sexo|m[eé]xico)$|clave\s+de\s+elector|fecha\s+de\s+nacimiento|a[nñ]o\s+de\s+registro"
    r"|identificador\s+electr[oó]nico|total\s+a\s+pagar|saldo\s+al\s+corte|^[A-Z0-9<]{24,}$|☑|☐"
)
NOISE_KEEP = "RFC|CURP|CLAVE|SECCI[oó]N|TRIBUNAL|DEMANDA|CONTRATO|ART[ií]CULO|CL[aá]USULA"
FUNCTION_WORDS = (
    "a", "al", "de", "del", "el", "en", "la", "las", "lo", "los", "un", "una", "y", "o",
    "que", "por", "con", "su", "se", "es", "como", "para", "mi", "me", "le", "si", "no",
)
ANNOTATIONS = "## Firmas, sellos y anotaciones"
SMALL_TOKENS = r"(?:^|[^\p{L}\p{N}_])(?:[A-Za-z]{1,2}[\s|]{1,3}){5}"  # a test: more than five say no more
#: 48 characters of the alphabet, or groups of five or more that white space parts, four at least. A group counts only
#: where another begins after it, so the possessive loop ends where a greedy one would have turned back to.
BASE64_RUNS = r"[A-Za-z0-9+/=]{48,}|(?:[A-Za-z0-9+/]{5,}+\s++(?=[A-Za-z0-9+/=]{5})){3,}+[A-Za-z0-9+/=]{5,}"
#: Characters of encoded text, without and with padding, and letters. Classes of single characters are looked up in a table, ranges one by one.
CODED, PADDED = f"[{ascii_letters}{digits}+/]", f"[{ascii_letters}{digits}+/=]"
SPANISH = f"{ascii_letters}áéíóúñÁÉÍÓÚÑ"
#: Of a text without equals signs, the BASE64_RUNS with 36 characters: what is counted goes on over white space only where a
#: run does. A run that is too short holds no other that is long enough, so none needs to be taken first.
CHAIN = (
    rf"(?={CODED}{{5,}}+\s++{CODED}{{5,}}+\s++{CODED}{{5,}}+\s++{CODED}{{5}})(?=(?:{CODED}(?:\s++(?={CODED}{{5}}))?+){{36}})(?:{CODED}{{5,}}+\s++(?={CODED}{{5}})){{3,}}+{CODED}++"
)
LONG_RUNS, NOISE_RUNS = (rf"(?<!{CODED})(?={CODED}{{5}})(?:{CODED}{{48,}}+|{CHAIN}{rest})" for rest in ("", rf"|{CODED}{{32,}}+"))
#: A meaningful word: four letters or digits with a vowel, but for signs at its ends. Without a small letter it is all capitals.
MEANINGFUL = rf"""(?<!\S)[.,;:'"]*+(?=[{SPANISH}{digits}]{{4}})[{''.join(c for c in SPANISH + digits if c not in VOWEL)}]*+{VOWEL}[{SPANISH}{digits}]*+[.,;:'"]*+(?!\S)"""
# A part of each match of SEAL_TAILS, and of SEAL_LINE and BOILERPLATE, in any case; it begins with one of few
# letters, so that hardly more than one look-up is spent on a character. Other letters stand for s and i where case does not count.
SEAL_PART = r"[lLfFpPbBjJ](?:[lL][oO]|[iIİı][cC][aA]|[rR][eE][sSſ][eE][nN]|[uU][yY][eE][nN]|[aA]\s*\d)"
SEAL_LINE_PART = r"[lLdDmMpPbBjJ](?:[lL][oO]|[eE][nN][aA]|[eE][rR][oO] [dD]|[lL][eE][mM]|[rR][eE][sSſ][eE][nN]|[uU][yY][eE][nN]|[aA]\s*\d)"
EVIDENCE_FIELDS = (
    ("Archivo firmado", r"Archivo\s+Firmado:\s*\n?\s*(\S+)"), ("Firmante", r"FIRMANTE\s+Nombre:\s*\n\s*([^\n]+)"),
    ("No. serie", r"FIRMA\s+No\.\s*serie:\s*\n\s*([^\n]+)"), ("Algoritmo", r"Algoritmo:\s*\n?\s*([^\n]+)"),
    ("Fecha de firma", r"Fecha:\s*\n?\s*\(UTC/?\s*CDMX\)\s*\n?\s*([^\n]+)"), ("Estatus", r"Status:\s*\n?\s*([^\n]+)"),
    ("Validez", r"Validez:\s*\n?\s*([^\n]+)"), ("OCSP", r"Nombre del respondedor:\s*\n?\s*([^\n]+)"),
    ("TSP", r"Identificador de la respuesta TSP:\s*\n?\s*(\S+)"),
)
# Lines that stamps leave.
STAMP_LINES = (
    r"^[-*]\s*\*\*(?:sello|timbre|firma|manuscrito)|^(?:pagado|cotejado|copia\s+certificada)$|^\*\*(?:sello|timbre|firma)\s*/"
    r"|^(?:scanned\s+with\s+camscanner|camscanner)$"
)
# Headings that are to be trusted.
HONEST_HEADINGS = (
    r"instituto\s+nacional\s+elector|credencial\s+para\s+votar|estados\s+unidos\s+mexicanos|acta\s+de\s+nacimiento|checklist|requisitos\s+de\s+contrataci|telmex"
    rf"|telefonos?\s+de\s+mexico|(?:^|{EDGE})cfe(?:$|{EDGE})|recibo|comprobante|experiencia\s+laboral|mi\s+perfil|formaci[oó]n|datos\s+de\s+(?:la\s+persona|filiaci[oó]n)"
)
EVIDENCE_FOOT = "\n\n> Cadena de firma, sellos de tiempo y tablas hex omitidos; solo metadatos legibles."


def replace_each(text: Column, pattern: str, change) -> Column:
    """text with change(match) in the place of each match; other places that hold the same string stay."""
    between = F.split(text, pattern, -1)
    found = F.concat(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), change), F.array(F.lit("")))
    return F.array_join(F.zip_with(between, found, lambda a, b: F.concat(a, b)), "")


def remove_base64(text: Column, strict_reference: bool = True) -> Column:
    """Encoded runs to a space: 48 characters, or four groups of five that have 36 together.

    By the reference's rule that also takes plain words of five letters or more, four in a row. With strict_reference
    off, a run needs a digit, plus, slash or equals sign.
    """
    def blank(found: Column) -> Column:
        coded = (F.length(F.regexp_replace(found, r"\s+", "")) >= 36) & (F.lit(strict_reference) | found.rlike("[0-9+/=]"))
        return F.when(coded, " ").otherwise(found)

    def each(t: Column) -> Column:
        return F.when(t.rlike(BASE64_RUNS), replace_each(t, BASE64_RUNS, blank)).otherwise(t)

    if not strict_reference:
        return once(whole(text), each)
    return once(whole(text), lambda t: F.when(t.contains("="), each(t)).otherwise(F.regexp_replace(t, LONG_RUNS, " ")))


def strip_inline_noise(line: Column) -> Column:
    """A line without tax seals, serials, identifiers, encoded runs and pipe runs."""

    def denoised(s: Column) -> Column:
        t = F.when(s.rlike(SEAL_PART), rewrite(s, [(f"(?iu){p}.*", "") for p in SEAL_TAILS])).otherwise(s)  # few lines need the ten patterns
        t = rewrite(t, [(f"(?iu){TAX_REPEAT}", " "), (UUID, "$1 $2", "-"), (SERIAL, "$1 $2")])
        coded = lambda x: F.when(x.contains("="), F.regexp_replace(remove_base64(x), f"{PADDED}{{32,}}+", " ")).otherwise(F.regexp_replace(x, NOISE_RUNS, " "))
        t = rewrite(once(t, coded), [(r"(?i)\[\s*m\d?\s*\]", "", "["), (r"\|{2,}", " ", "||"), (r"\s{2,}", " ")])
        return strip(F.regexp_replace(t, r"""^[ |.,;:\-'"]+|[ |.,;:\-'"]+$""", ""))

    return once(whole(line), denoised)


def letters(line: Column) -> Column:
    return count_chars(line, r"[\p{L}]")


def vowels(line: Column) -> Column:
    return count_chars(line, VOWEL)


def meaningful_words(line: Column) -> Column:
    """Tokens of four characters or more, letters and digits only, with a vowel, in one case or with a small letter."""
    plain = F.transform(tokens(whole(line)), lambda t: F.regexp_replace(t, "^[.,;:'\"]+|[.,;:'\"]+$", ""))
    return F.filter(plain, lambda t: (F.length(t) >= 4) & t.rlike("^[a-záéíóúñA-ZÁÉÍÓÚÑ0-9]+$") & t.rlike(VOWEL) & (t.rlike("[a-záéíóúñ]") | (F.upper(t) == t)))


def looks_like_stamp_noise(line: Column) -> Column:
    """The light test for unreadable stamps and signatures."""
    s = strip(whole(line))
    ts, r = tokens(s), word_vowel_ratio(s)
    n, tiny = F.size(ts), F.size(F.filter(ts, lambda t: F.length(t) <= 3))
    noisy = (
        ((n >= 5) & (tiny / n > 0.55) & (r < 0.35)) | ((n >= 6) & (r < 0.2)) | (s.rlike(SMALL_TOKENS) & (r < 0.32))
        | ((F.length(s) >= 14) & (r < 0.12) & (letters(s) >= 8))
    )
    return (F.length(s) < 4) | (~s.startswith("#") & ~has(s, NOISE_KEEP) & noisy)


def is_stamp_gibberish(line: Column) -> Column:
    """The full test for circular stamps read badly."""
    bare = F.regexp_replace(whole(line), r"^\s+|\s+$", "")  # as a pattern: a test counts it in the plan
    return once(bare, lambda s: once(token_vowel_ratio(s), lambda r: _is_gibberish(s, r)))


def _is_gibberish(s: Column, r: Column) -> Column:
    """r: token_vowel_ratio of s. Lines with few vowels, and short ones without a meaningful word; the others take no test."""
    n, tiny = F.regexp_count(s, F.lit(r"\S++")), F.regexp_count(s, F.lit(r"(?<!\S)\S{1,3}+(?!\S)"))
    long_words = F.filter(F.regexp_extract_all(s, F.lit("[a-záéíóúñA-ZÁÉÍÓÚÑ]{5,}"), F.lit(0)), lambda w: w.rlike(VOWEL))
    mixed = s.rlike(r"[A-Za-z]+[0-9]+|[0-9]+[A-Za-z]+") & (F.size(long_words) == 0)
    fields = s.rlike(r"(?iu)RFC|IVA|CP|CURP|BBVA|\$|TOTAL|PAGADO")
    thin = (r < 0.38) & (
        once(n, lambda k: ((k >= 4) & (tiny / k > 0.5)) | ((k >= 6) & (r < 0.22))) | ((r < 0.35) & (s.rlike(SMALL_TOKENS) | mixed))
        | ((r < 0.15) & (F.length(s) >= 12) & (letters(s) >= 6) & s.rlike("[0-9]"))
    )
    short = (F.length(s) < 60) & ~s.rlike(MEANINGFUL) & (
        ((F.length(s) <= 45) & (n <= 5) & ~fields) | (s.rlike("[A-Za-z0-9+/=]{5,}") & ~fields & ~s.rlike("[0-9]{3,}"))
        | ((F.length(s) <= 30) & (F.upper(s) == s) & (r < 0.25) & ~s.rlike("[0-9]{3,}"))
    )
    return (F.length(s) < 4) | (~s.startswith("#") & (thin | short) & ~s.rlike("(?iu)" + KNOWN_LINE))


def looks_like_seal_tokens(line: Column) -> Column:
    """Tokens of hardly any vowels, in a line of hardly any words; or a lone arrow in a short one."""
    return once(whole(line), lambda s: once(token_vowel_ratio(s), lambda r: _has_seal_tokens(s, r)))


def _has_seal_tokens(s: Column, r: Column) -> Column:
    plain = F.transform(tokens(s), lambda t: F.regexp_replace(t, "^['\".,;]+|['\".,;]+$", ""))

    def sealish(t: Column) -> Column:
        coded = (letters(t) >= 4) & t.rlike("[0-9]") & (vowels(t) / F.greatest(letters(t), F.lit(1)) < 0.22)
        capital = (F.upper(t) == t) & (vowels(t) / F.length(t) < 0.12)
        signs = t.rlike(r"""^[A-Z0-9+/=|<>)($'".:\-\[\]]{8,}$""") & (vowels(t) < 2)
        return (F.length(t) >= 6) & (coded | capital | signs)

    arrow = s.contains(">") & (F.length(s) < 55) & (r < 0.55) & ~s.rlike(r"(?iu)RFC|TOTAL|IMPORTE|\$|[0-9]{3,}|@")
    return ((r < 0.42) & F.exists(plain, sealish)) | arrow


def is_seal_line(line: Column, rest: Column | None = None) -> Column:
    """rest: strip_inline_noise of the stripped line, where it is at hand."""
    return once(strip(whole(line)), lambda s: _is_seal(s, strip_inline_noise(s) if rest is None else rest, F.lit(True)))


def _is_seal(s: Column, rest: Column, told: Column) -> Column:
    """told: whether the line holds a SEAL_LINE_PART. rest is worked out only where there is a phrase, or a long dense line."""

    def sealed(phrase: Column, dense: Column, e: Column) -> Column:
        thin = (F.length(e) < F.greatest(F.lit(40.0), F.length(s) * 0.07)) | (token_vowel_ratio(e) < 0.2)
        first = (F.length(e) < 28) | (base64_char_ratio(e) > 0.45)
        return (phrase & first) | F.when(dense, thin).otherwise((phrase & (F.length(s) < 120) & s.rlike(SERIAL)) | has_long_base64(s))

    def open_(phrase: Column, dense: Column) -> Column:
        return F.when(phrase | dense, once(rest, lambda e: sealed(phrase, dense, e))).otherwise(has_long_base64(s))

    phrase, dense = told & s.rlike("(?iu)" + SEAL_LINE), (F.length(s) > 350) & (base64_char_ratio(s) > 0.38)
    return (s != "") & once(phrase, lambda p: once(dense, lambda d: open_(p, d)))


def is_garbage_line(line: Column) -> Column:
    """Any of the tests above, or hardly any words, letters or vowels for its length."""
    return once(strip(whole(line)), lambda s: once(token_vowel_ratio(s), lambda r: _is_garbage(s, r)))


def _is_garbage(s: Column, r: Column) -> Column:
    """Of a stripped line; r: its token_vowel_ratio. What takes more is tried only where a plain count allows it."""
    known = F.regexp_count(s, F.lit(rf"(?<!\S)(?=\S{{1,2}}(?!\S))[.,;:]*+(?i:{'|'.join(w for w in FUNCTION_WORDS if len(w) < 3)})[.,;:]*+(?!\S)"))
    most = F.regexp_count(s, F.lit(r"(?<!\S)\S{1,2}+(?!\S)"))
    bare = F.regexp_count(s, F.lit(rf"(?<!\S)(?=\S{{3}})[^\s{SPANISH}]++(?!\S)"))  # three characters, none of them a letter
    sparse = lambda n, k: ((k / n > 0.48) & ((k - known) / n > 0.48)) | ((n - k - bare) / n < 0.28)
    few = once(F.regexp_count(s, F.lit(r"\S++")), lambda n: (n >= 8) & once(most, lambda k: sparse(n, k)))
    # letters are no more than characters, and no fewer than vowels
    thin = lambda v: ((v < 6) | (v / F.length(s) < 0.12)) & once(letters(s), lambda k: (k < 6) | ((k >= 10) & (v / k < 0.12)))
    flat = (F.length(s) >= 20) & once(vowels(s), thin)
    odd = (F.length(s) >= 80) & ((count_chars(s, r"[\p{L}\p{N}$.,]") / F.length(s) < 0.52) | ((r < 0.25) & (base64_char_ratio(s) > 0.42)))
    boiler = (F.length(s) < 160) & s.rlike("(?iu)" + BOILERPLATE)
    sealed = once(s.rlike(SEAL_LINE_PART), lambda told: _is_seal(s, strip_inline_noise(s), told) | (told & boiler))
    return (s == "") | sealed | _has_seal_tokens(s, r) | _is_gibberish(s, r) | few | flat | odd


def strip_watermarks(text: Column) -> Column:
    """Lines without stamps: whole stamp lines go; dates, serials and stamped runs of capitals go from the others."""

    runs = r"(?<![\p{L}\p{N}_])[A-ZÁÉÍÓÚÑ]{2,}(?:\s+[A-ZÁÉÍÓÚÑ]{2,}){1,4}(?![\p{L}\p{N}_])"

    def row(s: Column) -> Column:
        # few lines have a date, a serial or two words of capitals: a plain test tells, and the others stay as they are
        dated = [(rf"(^|{EDGE})\d{{2}}/\d{{2}}/\d{{2}}\s+\d{{2}}:\d{{2}}:\d{{2}}($|{EDGE})", "$1 $2"), (rf"(^|{EDGE})(?:\d{{2}}\.){{6,}}\d{{2,}}(?:\.\d{{2,}}+(?=$|{EDGE}))*+($|{EDGE})", "$1 $2")]
        numbered = F.when(s.rlike(r"\d{2}[/.]\d{2}"), rewrite(s, dated)).otherwise(s)
        told = once(numbered, lambda r: F.when(r.rlike(r"[A-ZÁÉÍÓÚÑ]{2}\s+[A-ZÁÉÍÓÚÑ]{2}"), replace_each(r, runs, lambda x: F.when(is_stamp_line(x), "").otherwise(x))).otherwise(r))
        return strip(F.regexp_replace(told, r"\s{2,}", " "))

    def line(raw: Column) -> Column:
        kept = lambda s: once(row(s), lambda r: F.when(r != "", r))
        return once(strip(raw), lambda s: F.when(s == "", "").when(is_stamp_line(s), None).otherwise(kept(s)))

    lines = F.filter(F.transform(F.split(F.regexp_replace(whole(text), "\r\n", "\n"), "\n", -1), line), lambda x: x.isNotNull())
    return strip(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def normalize_digital_text(text: Column) -> Column:
    lines = F.transform(F.split(strip_watermarks(text), "\n", -1), lambda x: F.regexp_replace(x, r"\s+$", ""))
    return normalize_markdown(F.array_join(lines, "\n"))


def structure_markdown(text: Column) -> Column:
    """Plain text to Markdown, paragraph by paragraph: headings, numbers and bullets. Markdown stays as it is."""
    body = strip(rewrite(whole(text), [("\r\n", "\n"), ("\r", "\n")]))
    number = lambda x: F.regexp_replace(x, r"^(\d+)[.)]\s+", "$1. ")
    bullet = lambda x: F.concat(F.lit("- "), F.regexp_replace(x, r"^[-•*]\s+", ""))
    is_number, is_bullet = (lambda x: x.rlike(r"^\d+[.)]\s+")), (lambda x: x.rlike(r"^[-•*]\s+"))

    def one(single: Column) -> Column:
        return (
            F.when(is_heading_line(single), F.concat(F.lit("## "), strip(F.regexp_replace(single, ":+$", "")))).when(is_number(single), number(single))
            .when(is_bullet(single), bullet(single)).otherwise(single)
        )

    def block(raw: Column) -> Column:
        def shaped(lines: Column) -> Column:
            many = F.when(F.forall(lines, is_number), F.array_join(F.transform(lines, number), "\n\n")).when(F.forall(lines, is_bullet), F.array_join(F.transform(lines, bullet), "\n\n")).otherwise(F.array_join(lines, "\n"))
            return F.when(F.size(lines) == 1, once(lines[0], one)).when(F.size(lines) > 1, many)

        return once(F.filter(F.transform(F.split(raw, "\n", -1), strip), lambda x: x != ""), shaped)

    def marked_up(b: Column) -> Column:
        blocks = F.filter(F.transform(F.split(b, r"\n\s*\n", -1), block), lambda x: x.isNotNull())
        marked = b.rlike(r"(?md)^#{1,6}\s|^\|.+\||^\s*[-*]\s+\S|^\d+\.\s+\S")
        return F.when(marked, b).otherwise(F.array_join(blocks, "\n\n"))

    return normalize_markdown(once(body, marked_up))


def polish_paragraphs(text: Column) -> Column:
    """Paragraphs without stamps, each on one line; a lone line that is a clause, an ordinal or short capitals is a heading."""

    def block(raw: Column) -> Column:
        lines = F.filter(F.transform(F.split(raw, "\n", -1), strip), lambda x: x != "")
        single = F.try_element_at(lines, F.lit(1))
        bare = F.regexp_replace(single, ":+$", "")
        spaces = F.length(bare) - F.length(F.replace(bare, F.lit(" "), F.lit("")))
        short = single.rlike(r"\p{Lu}") & ~single.rlike(r"\p{Ll}") & (F.length(single) <= 42) & (spaces <= 4) & ~has(single, SENTENCE)
        heading = single.rlike("(?iu)" + ORDINAL) | single.rlike("(?iu)" + CLAUSE) | short
        return F.when(F.size(lines) == 1, F.when(heading, F.concat(F.lit("## "), strip(bare))).otherwise(single)).when(F.size(lines) > 1, F.array_join(lines, " "))

    blocks = F.filter(F.transform(F.split(strip_watermarks(text), r"\n\s*\n", -1), block), lambda x: x.isNotNull())
    return normalize_markdown(F.array_join(blocks, "\n\n"))


def format_annotations(lines: Column) -> Column:
    """Bullets that tell seals and codes from signatures and handwriting. lines: an array."""

    def one(s: Column) -> Column:
        code = (s.rlike(r"^[A-Z0-9][A-Z0-9\s\-./]{2,}$") & (F.length(s) <= 48)) | (~((F.length(s) <= 42) & s.rlike("[a-záéíóúñ]")) & s.rlike(r"\d{2,}") & (F.length(s) <= 32))
        hand = (F.length(s) <= 42) & s.rlike("[a-záéíóúñ]")
        return F.when(s == "", None).when(code, F.concat(F.lit("- **Sello / código:** "), s)).when(hand, F.concat(F.lit("- **Firma / manuscrito:** "), s)).otherwise(F.concat(F.lit("- "), s))

    return F.array_join(F.filter(F.transform(lines, lambda raw: once(strip(F.regexp_replace(raw, r"\s+", " ")), one)), lambda x: x.isNotNull()), "\n")


def append_annotations(markdown: Column, body: Column) -> Column:
    """The annotations' section at the end, once; without a body nothing changes."""
    def appended(notes: Column) -> Column:
        present = lambda base: F.lower(base).contains(ANNOTATIONS.lower())
        full = once(normalize_markdown(markdown), lambda base: F.when(present(base), base).otherwise(strip(F.concat(base, F.lit(f"\n\n{ANNOTATIONS}\n\n"), notes))))
        return F.when(notes == "", markdown).otherwise(full)

    return once(strip(whole(body)), appended)


def summarize_evidence(text: Column) -> Column:
    """The readable fields of a page of cryptographic evidence as bullets."""
    fields = [normalize_whitespace(F.regexp_extract(whole(text), "(?iu)" + p, 1)) for _, p in EVIDENCE_FIELDS]
    bullets = F.array(*[F.when(v != "", F.concat(F.lit(f"- **{label}:** "), v)) for (label, _), v in zip(EVIDENCE_FIELDS, fields)])
    found = F.filter(bullets, lambda x: x.isNotNull())
    body = F.concat(F.lit("### Evidencia criptográfica (resumen)\n"), F.array_join(found, "\n"))
    none = "### Evidencia criptográfica\n\n> Página de firma electrónica detectada."
    return F.concat(F.when(F.size(found) < 2, none).otherwise(body), F.lit(EVIDENCE_FOOT))


def _pair(s: Column, r: Column) -> Column:
    return F.struct(s.alias("s"), r.alias("r"))


def clean_line(s: Column, cleaned: Column, aggressive: bool | Column = True) -> Column:
    """A recognised line: cleaned, empty, or null where it goes. Table lines and honest headings stay.

    s: the stripped line; cleaned: strip_inline_noise of it. Both are taken as they are, so they should be columns or
    variables, and each test is tried only where those before it leave the line open.
    """
    hard = F.lit(aggressive) if isinstance(aggressive, bool) else aggressive
    title = strip(F.regexp_replace(s, r"^#+\s*", ""))

    def stamped(t: Column) -> Column:
        seal = once(token_vowel_ratio(t), lambda r: _has_seal_tokens(t, r) | _is_gibberish(t, r))
        return (t != "") & (F.length(t) <= 72) & ~t.rlike("(?iu)" + HONEST_HEADINGS) & ((capitals_only(t) & F.size(tokens(t)).between(2, 5)) | seal)

    def told(r: Column) -> Column:
        rescued = (F.length(s) > 180) & (F.length(cleaned) >= 35) & (r >= 0.32) & ~_has_seal_tokens(cleaned, r)
        harsh = (
            ((F.length(s) > 90) & (F.length(cleaned) < F.greatest(F.lit(22.0), F.length(s) * 0.14))) | ((F.length(cleaned) >= 120) & (r < 0.18))
            | ((F.length(cleaned) <= 14) & (r < 0.45) & ~cleaned.rlike(rf"(?iu)[$€]|^\d+[.,]\d{{2}}$|RFC|IVA|CP(?:$|{EDGE})"))
        )
        # the line is tested cleaned and as it is; without the signs at its ends it has the same words
        own = F.when(F.btrim(s, F.lit(" |.,;:-'\"")) == cleaned, r).otherwise(token_vowel_ratio(s))
        both = F.when(s == cleaned, F.array(_pair(cleaned, r))).otherwise(F.array(_pair(cleaned, r), _pair(s, own)))
        garbage = F.exists(both, lambda x: once(x["s"], lambda y: _is_garbage(y, x["r"])))
        return F.when(rescued, cleaned).when((hard & harsh) | garbage, None).otherwise(cleaned)

    return (
        F.when(s == "", "").when(is_table_line(s), s).when(s.startswith("#"), F.when(~once(title, stamped), s))
        .when(s.rlike("(?iu)" + STAMP_LINES) | ((F.length(s) <= 3) & ~s.rlike("^[0-9]+$")), None).when(cleaned == "", None)
        .otherwise(once(token_vowel_ratio(cleaned), told))
    )


def cleaned_line(line: Column, aggressive: bool | Column = True) -> Column:
    """A line as it was recognised through the whole cleaner."""
    return once(strip(whole(line)), lambda s: once(strip_inline_noise(s), lambda c: clean_line(s, c, aggressive)))


def clean_lines(lines: DataFrame, line: str, aggressive: bool = True) -> DataFrame:
    """lines with `cleaned` added."""
    return lines.withColumn("cleaned", cleaned_line(F.col(line), aggressive))


def sanitize(text: Column, aggressive: bool | Column = True, run: int = 10) -> Column:
    """A text without seals and noise. Ten lines or more dropped in a row leave a note behind.

    Line by line inside the row, without a shuffle; of the lines that stay, the places tell the runs of dropped ones.
    """
    hard = F.lit(aggressive) if isinstance(aggressive, bool) else aggressive
    whole_ = strip(F.regexp_replace(whole(text), r"(?is)\n##\s+Firmas,\s+sellos\s+y\s+anotaciones.*", ""))
    body = once(whole_, lambda t: F.when(hard, remove_base64(t)).otherwise(strip_watermarks(t)))
    lines = F.transform(F.split(body, "\n", -1), lambda raw, i: F.struct(i.alias("line"), (hard | raw.startswith("#")).alias("noted"), cleaned_line(raw, aggressive).alias("t")))

    def piece(kept: Column, x: Column, j: Column) -> Column:
        skipped = x["line"] - F.coalesce(F.when(j > 0, F.get(kept, j - 1)["line"]), F.lit(-1)) - 1
        return F.when((skipped >= run) & x["noted"], F.concat(F.lit("\n> Sello o timbre omitido.\n\n"), x["t"])).otherwise(x["t"])

    joined = once(F.filter(lines, lambda x: x["t"].isNotNull()), lambda kept: F.array_join(F.transform(kept, lambda x, j: piece(kept, x, j)), "\n"))
    return normalize_markdown(joined)


def sanitize_documents(docs: DataFrame, key: str, text: str, aggressive: bool = True, run: int = 10) -> DataFrame:
    """key, markdown: documents without seals and noise."""
    return docs.select(key, sanitize(F.col(text), aggressive, run).alias("markdown"))
