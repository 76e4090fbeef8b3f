"""Tests on lines, texts and labels, and the classifiers built from them: Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.scores import EDGE, HEADER_HINTS, PAYROLL_KEYS, bounded, token_vowel_ratio
from foliant.functions.text import WORD, normalize_whitespace, once, strip, strip_markdown_syntax, whole

# Patterns of stamp and heading lines.
STAMP_DATETIME = rf"(?:^|{EDGE})\d{{2}}/\d{{2}}/\d{{2}}\s+\d{{2}}:\d{{2}}:\d{{2}}(?:$|{EDGE})"
DOTTED_SERIAL = rf"(?:^|{EDGE})(?:\d{{2}}\.){{6,}}\d{{2,}}(?:$|{EDGE})"
HEX_CHAIN = rf"(?:^|{EDGE})(?:[0-9a-fA-F]{{2}}\s+){{12}}[0-9a-fA-F]{{2}}(?:$|{EDGE})"  # a test: a longer chain ends in one of these
LEGAL_LINE = r"^(?:PRIMER|SEGUNDO|TERCER|CUARTO|QUINTO|SEXTO|AGRAVIO|RECURSO|AMPARO|R\s*E\s*S\s*U\s*E\s*L\s*V\s*E|FUENTE|REGISTRO\s+DIGITAL)"
ORDINAL = rf"^(?:PRIMERO|SEGUNDO|TERCERO|CUARTO|QUINTO|SEXTO|S[EÉ]PTIMO|OCTAVO|NOVENO|D[EÉ]CIMO)(?:$|{EDGE})"
CLAUSE = (
    r"^(?:CL[AÁ]USULA|CAP[IÍ]TULO|ART[IÍ]CULO|T[IÍ]TULO|ANEXO)\s+"
    rf"(?:PRIMERA?|SEGUNDA?|TERCERA?|CUARTA?|QUINTA?|SEXTA?|S[EÉ]PTIMA?|OCTAVA?|NOVENA?|D[EÉ]CIMA?|\d+)(?:$|{EDGE})"
)
SENTENCE = "atentamente|comparezco|solicito|continuaci[oó]n|fundamento|representada|jurisdiccional"
NOT_LETTER = "[^A-Za-zÁÉÍÓÚáéíóúÑñ]"
LOWER = "[a-záéíóúñ]"

# Markers of page kinds.
CHECKLIST = r"check\s*list|checoklist|requisitos\s+de\s+contrataci[oó]n|documentos?\s+requeridos?"
CHECKLIST_PARTS = ("contrataci", "requisit", "requisflos", "checklist", "checoklist", "curriculum", "comprobante de domicilio", "acta de nacimiento", "solicitud de empleo")
CREDENTIAL = r"instituto\s+nacional\s+elector(?:al)?|credencial\s+para\s+votar|clave\s+de\s+elector|ine|ife|elector(?:a)?\s+de\s+la\s+secci[oó]n"
FORM = r"acta\s+de\s+nacimiento|registro\s+civil|identificador\s+electr[oó]nico|datos\s+de\s+la\s+persona\s+registrada|datos\s+de\s+filiaci[oó]n|copia\s+certificada|estados\s+unidos\s+mexicanos"
RECEIPT = (
    r"tel(?:mex|cel|nor)|telefonos?\s+de\s+mexico|cfe|total\s+a\s+pagar|exigido\s+pagar|estado\s+de\s+cuenta|recibo\s+de|comprobante\s+de\s+pago"
    r"|fecha\s+l[ií]mite\s+de\s+pago|numero?\s+de\s+servicio|n[uú]mero\s+de\s+cuenta|resumen\s+del\s+estado"
)
CV = r"curriculum|curr[ií]culum|experiencia\s+laboral|formaci[oó]n|informaci[oó]n\s+de\s+contacto|mi\s+perfil|datos\s+personales"
CONTRACT = (
    r"contrato(?:\s+de)?|arrendamiento|compraventa|prestaci[oó]n\s+de\s+servicios|confidencialidad|cl[aá]usula|comparecen|las\s+partes|por\s+una\s+parte"
    r"|por\s+otra\s+parte|objeto\s+del\s+contrato|convenio|acuerdo\s+de|contratante|contratista|arrendador|arrendatario|vendedor|comprador"
    r"|jurisdicci[oó]n|terminaci[oó]n|vigencia|instrumento|otorgamiento|testigo|anexo\s+[a-z0-9]|whereas|hereby|party|agreement"
)
CONTRACT_STRONG = ("cláusula", "clausula", "comparecen", "las partes", "contrato de", "arrendamiento", "compraventa", "prestación de servicios", "objeto del contrato")
SPREADSHEET_VETO = (
    r"acta\s+de\s+nacimiento|registro\s+civil|identificador\s+electr[oó]nico|credencial|instituto\s+nacional\s+elector|tel(?:mex|cel)|cfe"
    r"|estado\s+de\s+cuenta|checklist|requisitos\s+de\s+contrataci[oó]n|curriculum|experiencia\s+laboral|solicitud\s+de\s+empleo"
)
MRZ = "[A-Z0-9<]{24,}"
ID_LAYOUT = r"secci[oó]n\s+\d{4}|vigencia|elector|curp"
ID_TOKENS = ("DOMICILIO", "ELECTOR", "CURP", "VIGENCIA", "NOMBRE", "SECCIÓN", "SECCION")
QUOTA_HINTS = ("quota", "rate limit", "rate_limit", "insufficient", "billing", "exceeded", "resource_exhausted", "too many requests", "overloaded")
MODES = {"fast": ("fast", "rapid", "speed", "rapido"), "quality": ("quality", "high", "best", "max", "calidad")}


def has(text: Column, words: str) -> Column:
    return whole(text).rlike("(?iu)" + bounded(words))


def capitals_only(line: Column) -> Column:
    letters = F.regexp_replace(line, NOT_LETTER, "")
    return (letters != "") & ~letters.rlike(LOWER)


def tokens(line: Column) -> Column:
    return F.filter(F.split(line, r"\s+", -1), lambda t: t != "")


def is_stamp_line(line: Column) -> Column:
    """Stamps of dates, serials and hexadecimal chains, and two to five words of capitals without connectors."""
    return once(F.regexp_replace(whole(line), r"^\s+|\s+$", ""), _is_stamp)


def _is_stamp(s: Column) -> Column:
    connected = F.exists(F.array(*map(F.lit, (" DE ", " DEL ", " LA ", " EL ", " Y "))), lambda t: s.contains(t))
    # short lines of capitals alone: the length and small letters tell of most lines before anything is rewritten
    capitals = (F.length(s) < 56) & ~s.rlike(LOWER) & capitals_only(s) & F.size(tokens(s)).between(2, 5) & ~connected
    dated = (F.length(s) < 40) & s.rlike(STAMP_DATETIME)
    serial = (F.length(s) < 100) & s.rlike(DOTTED_SERIAL)
    return (s != "") & (capitals | dated | serial | s.rlike(HEX_CHAIN)) & ~s.rlike("(?iu)" + LEGAL_LINE)


def is_heading_line(line: Column) -> Column:
    """Clauses, ordinals, and short lines of capitals that don't look like a name."""
    s = strip(whole(line))
    n = F.size(tokens(s))
    label = s.endswith(":") & (F.length(s) <= 72) & capitals_only(s)
    name = n.between(2, 5) & s.rlike(r"^[A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ\s.]{3,}$")
    short = capitals_only(s) & (F.length(F.regexp_replace(s, NOT_LETTER, "")) >= 4) & (F.length(s) <= 48) & ~name & (n <= 6)
    open_ = (s != "") & (F.length(s) <= 100) & ~s.rlike(LOWER) & ~has(s, SENTENCE)
    return open_ & (label | s.rlike("(?iu)" + ORDINAL) | s.rlike("(?iu)" + CLAUSE) | short)


def is_table_line(line: Column) -> Column:
    """Starts and ends with a pipe, three pipes at least."""
    s = strip(whole(line))
    return s.startswith("|") & s.endswith("|") & (F.length(s) - F.length(F.replace(s, F.lit("|"), F.lit(""))) >= 3)


def has_pipe_grid(text: Column) -> Column:
    return F.exists(F.split(whole(text), "\n", -1), lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) > 12)


def has_long_base64(text: Column) -> Column:
    """A run of 44 characters of the alphabet, white space left out, with a plus, slash or equals sign."""
    runs = F.regexp_extract_all(F.regexp_replace(whole(text), r"\s+", ""), F.lit("[A-Za-z0-9+/]{44,}={0,2}"), F.lit(0))
    return whole(text).rlike("[+/=]") & F.exists(runs, lambda x: x.rlike("[+/=]"))


def is_crypto_evidence(text: Column) -> Column:
    sample = F.substring(whole(text), 1, 1200)
    return sample.rlike(r"(?iu)EVIDENCIA\s+CRIPTOGR") & sample.rlike(r"(?iu)(?:FIRMANTE|CADENA\s+DE\s+FIRMA|AUTORIDAD\s+CERTIFICADORA)")


def looks_like_contract(text: Column) -> Column:
    doubled = F.regexp_replace(whole(text), f"({EDGE})", "$1$1")  # so that neighbouring words each have edges
    hits = F.regexp_count(doubled, F.lit("(?iu)" + bounded(CONTRACT)))
    lower = F.lower(strip(whole(text)))
    strong = F.exists(F.array(*map(F.lit, CONTRACT_STRONG)), lambda m: lower.contains(m))
    return (F.length(strip(whole(text))) >= 40) & ((hits >= 2) | (strong & (hits >= 1)))


def count_contained(text: Column, parts: tuple[str, ...]) -> Column:
    return sum((text.contains(p).cast("int") for p in parts), F.lit(0))


def looks_like_spreadsheet(text: Column, has_grid: Column) -> Column:
    upper = F.upper(whole(text))
    payroll = upper.contains("FECHA") & upper.contains("NOMBRE") & upper.contains("CONCEPTO") & (upper.contains("IMPORTE") | upper.contains("PAGO"))
    doubled = F.regexp_replace(whole(text), f"({EDGE})", "$1$1")
    hits = F.regexp_count(doubled, F.lit("(?iu)" + bounded(HEADER_HINTS)))
    return ~has(text, SPREADSHEET_VETO) & (payroll | ((count_contained(upper, PAYROLL_KEYS) >= 3) & (hits >= 4) & has_grid))


def visual_kind(text: Column) -> Column:
    upper = F.upper(whole(text))
    words = F.size(F.filter(F.regexp_extract_all(whole(text), F.lit(WORD), F.lit(0)), lambda w: F.length(w) >= 3))
    ids = count_contained(upper, ID_TOKENS)
    few = words < 40
    return (
        F.when(whole(text).rlike(MRZ), "credential")
        .when(few & ((ids >= 2) | (has(text, ID_LAYOUT) & (ids >= 1))), "credential")
        .when(few & has(text, RECEIPT), "receipt").when(few & has(text, FORM), "form")
    )


def page_kind(text: Column, has_grid: Column | None = None) -> Column:
    """The first kind whose markers a page's text holds."""
    grid = F.lit(False) if has_grid is None else has_grid
    lower = F.lower(whole(text))
    return (
        F.when(whole(text).rlike("(?iu)" + CHECKLIST) | (count_contained(lower, CHECKLIST_PARTS) >= 2), "checklist")
        .when(has(text, CREDENTIAL), "credential").when(whole(text).rlike(MRZ) & has(text, ID_LAYOUT), "credential")
        .when(has(text, FORM), "form").when(has(text, RECEIPT), "receipt").when(has(text, CV), "cv")
        .when(looks_like_contract(text), "contract").when(looks_like_spreadsheet(text, grid), "spreadsheet")
        .otherwise(F.coalesce(visual_kind(text), F.lit("generic")))
    )


def needs_legal_vision(kind: Column) -> Column:
    return kind.isin("receipt", "credential", "form", "checklist", "cv", "contract", "generic")


def needs_docs_vision(kind: Column, text: Column) -> Column:
    """Kinds with fields, and generic pages with hardly any text."""
    plain = strip(F.regexp_replace(whole(text), r"\s+", " "))
    words = F.size(F.filter(F.regexp_extract_all(whole(text), F.lit(WORD), F.lit(0)), lambda w: F.length(w) >= 4))
    poor = (F.length(plain) < 100) | ((words < 10) & (F.length(plain) > 50))
    return kind.isin("receipt", "credential", "form", "checklist", "cv", "contract") | ((kind == "generic") & poor)


def is_scan_dominant(coverage: Column, text_blocks: Column, raw: Column) -> Column:
    n = F.length(normalize_whitespace(raw))
    return (coverage >= 0.52) | ((coverage >= 0.38) & (text_blocks <= 3) & (n < 250)) | ((coverage >= 0.22) & (n < 36))


def has_reliable_text(coverage: Column, text_blocks: Column, raw: Column, markdown: Column) -> Column:
    plain, ratio = F.length(strip_markdown_syntax(markdown)), token_vowel_ratio(normalize_whitespace(raw))
    enough = (plain >= 72) & (F.length(normalize_whitespace(raw)) >= 48)
    return ~is_scan_dominant(coverage, text_blocks, raw) & enough & (((text_blocks >= 3) & (ratio >= 0.28)) | ((plain >= 280) & (ratio >= 0.22)))


def page_route(coverage: Column, text_blocks: Column, raw: Column, markdown: Column) -> Column:
    """ocr, digital, or both where a digital page has a large image."""
    reliable = has_reliable_text(coverage, text_blocks, raw, markdown)
    return F.when(reliable & (coverage >= 0.28), "both").when(reliable, "digital").otherwise("ocr")


def normalize_mode(mode: Column) -> Column:
    m = F.lower(strip(F.coalesce(mode, F.lit("balanced"))))
    return F.when(m.isin(*MODES["fast"]), "fast").when(m.isin(*MODES["quality"]), "quality").otherwise("balanced")


def source_base(source: Column) -> Column:
    return F.split_part(whole(source), F.lit("-"), F.lit(1))


def is_vision_source(source: Column) -> Column:
    base = source_base(source)
    return (base == "parallel") | base.startswith("parallel:") | base.isin("gemini", "openai", "anthropic", "vision")


def source_providers(source: Column) -> Column:
    base = source_base(source)
    joined = F.filter(F.split(F.regexp_replace(base, "^parallel:", ""), r"\+", -1), lambda p: p != "")
    return F.when(base.startswith("parallel:"), joined).when(base.isin("gemini", "openai", "anthropic"), F.array(base)).otherwise(F.array().cast("array<string>"))


def is_quota_error(status: Column, body: Column) -> Column:
    hinted = F.exists(F.array(*map(F.lit, QUOTA_HINTS)), lambda h: F.lower(whole(body)).contains(h))
    return F.coalesce(status.isin(402, 429), F.lit(False)) | hinted


def runs_async(size_bytes: Column, pages: Column, is_pdf: Column, heavy_mb: float = 15, heavy_pages: int = 35) -> Column:
    return (size_bytes >= heavy_mb * 1024 * 1024) | (is_pdf & (pages >= heavy_pages))
