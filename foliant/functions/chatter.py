"""What a hosted model says around a text it read: tests for it, and texts without it: Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.scores import score_table_markdown, text_quality_score
from foliant.functions.text import once, strip, strip_markdown_syntax, whole

# Lines that speak about a document, texts that refuse it, and how a closing remark begins.
META = (
    "(?iu)"
    "este (?:documento|archivo|pdf|contrato|imagen) (?:es|parece|contiene|muestra|que compartes)|el documento que compartes|"
    "informaci[oó]n personal sensible|riesgo de privacidad|no tengo forma de verificar|digitalizaci[oó]n autorizada|independientemente del contexto|"
    "personas f[ií]sicas identificables|(?:aquí|a continuación) (?:está|te presento|la transcripción|el texto)|"
    "he (?:transcrito|identificado|detectado|analizado)|puedo (?:ayudarte|realizar|hacer|ofrecer|explicar|orientarte)|¿en qu[eé] m[aá]s puedo ayudarte|"
    "(?:si deseas|si quieres|¿quieres?).*(?:análisis|analisis|revisión|resumen)|(?:análisis|analisis) (?:de )?(?:las )?cl[aá]usulas|"
    "revis(?:ar|ión) (?:de )?(?:las )?cl[aá]usulas|redactar o revisar cl[aá]usulas|estructura general de un contrato|requisitos legales de este tipo|"
    "i(?:'m| am) (?:happy to|able to) (?:help|analyze|review)|this (?:document|image|appears to be|is a)|"
    "here(?:'s| is) (?:the )?(?:transcription|ocr|contract)|como (?:modelo|asistente|ia)|nota:? (?:como|que) (?:modelo|ia)|transcripci[oó]n del documento|"
    "transcribir o reproducir esos datos"
)
REFUSALS = (
    "(?iu)"
    "not able to transcribe|cannot transcribe|can't transcribe|privacy and security|identity theft|facilitate fraud|no puedo transcribir|"
    "no estoy en capacidad|por razones de privacidad|informaci[oó]n personal sensible|riesgo de privacidad|no tengo forma de verificar|"
    "personas f[ií]sicas identificables|transcribir o reproducir esos datos|recomiendo usar.*canales oficiales|"
    "puedo (?:ayudarte|ofrecerte|explicar|orientarte)|¿en qu[eé] m[aá]s puedo ayudarte|(?:análisis|analisis) (?:legal|de cl[aá]usulas)|"
    "redactar o revisar cl[aá]usulas|estructura general de un contrato"
)
#: One of these is part of each match of META, and of REFUSALS.
META_WORDS = (
    "este ", "compartes", "sensible", "privacidad", "verificar", "autorizada", "contexto", "identifica", "aquí ", "continuación ", "transcri", "detectado", "analizado",
    "puedo ", "desea", "quiere", "lisis", "revis", "contrato", "requisitos", "happy to", "able to", "this document", "this image", "this appears", "this is a", "here's", "here is",
    "como ", "nota",
)
REFUSAL_WORDS = (
    "transcri", "privacy", "identity", "facilitate", "capacidad", "privacidad", "sensible", "verificar", "identifica", "recomiendo", "puedo ", "lisis", "revis", "contrato",
)
MARKERS = (
    "información personal sensible", "informacion personal sensible", "riesgo de privacidad", "no tengo forma de verificar", "¿en qué más puedo ayudarte",
    "en que más puedo ayudarte", "puedo explicar la estructura", "puedo ayudarte a redactar", "puedo orientarte sobre",
)
CLOSINGS = ("¿en qu[eé] m[aá]s puedo ayudarte", "puedo explicar la estructura", "puedo ayudarte a redactar", "puedo orientarte sobre")
FENCE = r"^(?:---+|\*\*\*|```)"


def _matches(text: Column, words: tuple[str, ...], pattern: str) -> Column:
    """Whether the pattern is found; it is looked for only in texts with one of the words, as few have one."""

    def folded(t: Column) -> Column:
        for odd, plain in ("İi", "ıi", "ſs", "\u212ak"):  # which the pattern takes for these, and lower() does not
            t = F.replace(t, F.lit(odd), F.lit(plain))
        return F.lower(t)

    some = lambda t: once(folded(t), lambda f: F.exists(F.array(*map(F.lit, words)), lambda w: f.contains(w)))
    return once(whole(text), lambda t: some(t) & t.rlike(pattern))


def is_meta_line(line: Column) -> Column:
    return _matches(line, META_WORDS, META)


def refuses(text: Column) -> Column:
    return _matches(text, REFUSAL_WORDS, REFUSALS)


def split_lines(text: Column) -> Column:
    """Lines, without an empty one after the last line end; an empty text has none."""
    t = whole(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(t, r"\n\z", ""), "\n", -1))


def meta_lines(text: Column) -> Column:
    return F.size(F.filter(split_lines(text), is_meta_line))


def is_refusal(text: Column) -> Column:
    """A refusing phrase anywhere, or under 120 characters of which half the lines speak about the document."""
    return _is_refusal(text, once(strip_markdown_syntax(text), F.length))


def _is_refusal(text: Column, chars: Column) -> Column:
    """chars: how many characters strip_markdown_syntax leaves."""
    marked = once(F.lower(whole(text)), lambda low: F.exists(F.array(*map(F.lit, MARKERS)), lambda m: low.contains(m)))
    few = once(meta_lines(text), lambda n: (n > 0) & (n >= F.greatest(F.lit(1), F.floor(F.size(split_lines(text)) / 2))))
    return ((chars < 120) & few) | refuses(text) | marked


def strip_chatter(text: Column) -> Column:
    """The text between a model's opening and closing remarks; nothing is left of a short refusal."""
    body = F.replace(whole(text), F.lit("\r\n"), F.lit("\n"))
    # the first remark is looked for before the text is stripped, the others after it
    for closings in (CLOSINGS[:1], CLOSINGS[1:]):
        body = strip(F.regexp_replace(body, rf"(?isu)\n\s*(?:{'|'.join(closings)}).*", ""))
    return once(body, _inner)


def _inner(body: Column) -> Column:
    def between(lines: Column) -> Column:
        # only a line's place and what it is are kept of it: 0 of nothing, 1 of what may end the text, 2 of what may begin it too
        kinds = F.transform(lines, lambda x: once(strip(x), lambda s: F.when((s == "") | is_meta_line(s), 0).when(refuses(s) | s.rlike(FENCE), 1).otherwise(2)))

        def cut(kinds_: Column) -> Column:
            places = lambda least: F.filter(F.transform(kinds_, lambda k, i: F.when(k >= least, i)), lambda i: i.isNotNull())
            return once(F.struct(F.array_min(places(2)).alias("a"), F.array_max(places(1)).alias("z")), lambda p: F.slice(lines, p["a"] + 1, p["z"] - p["a"] + 1))

        return strip(F.array_join(once(kinds, cut), "\n"))

    inner = F.coalesce(once(F.split(body, "\n", -1), between), F.lit(""))
    # a long text is no short refusal, whatever it says
    short = once(F.length(strip_markdown_syntax(body)), lambda n: F.when(n < 80, _is_refusal(body, n)).otherwise(False))
    return F.when(short, "").otherwise(inner)


def reading_score(text: Column, tables: bool = False) -> Column:
    """text_quality_score, raised by tables where asked, lowered by 30 for each line of talk and by 200 for a refusal."""
    score = text_quality_score(text) + (score_table_markdown(whole(text)) * 0.45 if tables else F.lit(0.0))
    return score - meta_lines(text) * 30 - F.when(refuses(text), 200).otherwise(0)


def response_text(payload: Column) -> Column:
    """The text of a JSON response: a message's content, or the text blocks in its content, on a line each."""
    content = F.get_json_object(payload, "$.choices[0].message.content")
    listed = content.startswith("[")
    blocks = F.from_json(F.coalesce(F.when(listed, content), F.get_json_object(payload, "$.content")), "array<struct<type: string, text: string>>")
    texts = F.filter(blocks, lambda b: (b["type"] == "text") & (whole(b["text"]) != ""))
    joined = strip(F.array_join(F.transform(texts, lambda b: b["text"]), "\n"))
    return F.coalesce(F.when(~listed, strip(content)), joined, F.lit(""))
