"""Text functions as column expressions: folding, excerpts, slugs, labels, TeX escapes and balances."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _bases() -> tuple[str, str]:
    """Characters of the Basic Multilingual Plane below Arabic that decompose to one base and marks, and their bases."""
    pairs = []
    for i in range(0x80, 0x3000):
        d = "".join(c for c in unicodedata.normalize("NFD", chr(i)) if not "\u0300" <= c <= "\u036f")
        if len(d) == 1 and d != chr(i):
            pairs.append((chr(i), d))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _bases()


def fold(c: Column) -> Column:
    """Lower case without accents, as NFD without combining marks gives."""
    return F.regexp_replace(F.translate(F.lower(c), _FROM, _TO), "[\u0300-\u036f]", "")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def tag_key(c: Column) -> Column:
    return fold(collapse(c))


def excerpt(c: Column, n: int) -> Column:
    flat = collapse(c)
    return F.when(F.length(flat) > n, F.concat(F.left(flat, F.lit(n)), F.lit("…"))).otherwise(flat)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def option_label(i: Column) -> Column:
    """a to z, then aa to zz, from a place counted from 0."""
    letter = lambda x: F.chr(F.lit(97) + x)
    return F.when(i < 26, letter(i)).when(i < 702, F.concat(letter(F.floor(i / 26) - 1), letter(i % 26)))


#: Characters that TeX reads as commands, and what stands for them (fixed values of TeX).
TEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def tex_escape(c: Column) -> Column:
    """Every special character once, in a single pass."""
    table = F.create_map(*[F.lit(x) for kv in TEX.items() for x in kv])
    return F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")


def strip_comments(c: Column) -> Column:
    """TeX without comments; an escaped percent sign stays, and so does the end of the line."""
    return F.regexp_replace(c, r"(\\[\s\S])|%[^\n]*", "$1")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"\\[\s\S]", "")


def count_of(c: Column, x: str) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(x)))).cast("long")


def brace_balance(c: Column) -> Column:
    return count_of(unescaped(c), "{") - count_of(unescaped(c), "}")


def dollars(c: Column) -> Column:
    return count_of(unescaped(c), "$")


def relative_age(then: Column, now: Column) -> Column:
    """Age in words; ``now`` is a parameter, so results can be repeated."""
    s = (F.unix_timestamp(now) - F.unix_timestamp(then)).cast("long")
    minutes, hours, days = F.floor(s / 60), F.floor(s / 3600), F.floor(s / 86400)
    say = lambda n, one, many: F.concat(F.lit("há "), n.cast("string"), F.when(n == 1, F.lit(f" {one}")).otherwise(F.lit(f" {many}")))
    return (
        F.when(minutes < 1, "agora").when(hours < 1, say(minutes, "minuto", "minutos")).when(days < 1, say(hours, "hora", "horas")).when(days == 1, "ontem")
        .when(days < 30, say(days, "dia", "dias")).when(days < 365, say(F.floor(days / 30), "mês", "meses")).otherwise(say(F.floor(days / 365), "ano", "anos"))
    )


def isbn_valid(c: Column) -> Column:
    """Check digit of an ISBN of 10 or 13 characters; hyphens and blanks don't count."""
    x = F.upper(F.regexp_replace(c, "[- ]", ""))
    weigh = lambda w: F.aggregate(F.transform(F.split(x, ""), w), F.lit(0), lambda a, b: a + b)
    ten = weigh(lambda d, i: F.when(d == "X", 10).otherwise(F.coalesce(d.try_cast("int"), F.lit(0))) * (10 - i)) % 11 == 0
    thirteen = weigh(lambda d, i: F.coalesce(d.try_cast("int"), F.lit(0)) * F.when(i % 2 == 0, 1).otherwise(3)) % 10 == 0
    return F.when(x.rlike("^[0-9]{9}[0-9X]$"), ten).when(x.rlike("^[0-9]{13}$"), thirteen).otherwise(False)


def bytes_text(n: Column) -> Column:
    """A number of bytes as B, kB or MB, with one decimal above 1023 bytes."""
    shown = lambda x, unit: F.concat((F.floor(x * 10 + 0.5) / 10).cast("decimal(20,1)").cast("string"), F.lit(unit))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, shown(n / 1024, " kB")).otherwise(shown(n / (1024 * 1024), " MB"))


def url_allowed(c: Column) -> Column:
    """Whether a text is an address of the web; other protocols, such as script addresses, are not."""
    host = F.try_parse_url(F.trim(c), F.lit("HOST"))
    return F.coalesce(F.lower(F.try_parse_url(F.trim(c), F.lit("PROTOCOL"))).isin("http", "https") & (host != ""), F.lit(False))


def year_of(c: Column) -> Column:
    """The year that a date text begins with; null before 1450."""
    year = F.left(c, F.lit(4)).try_cast("int")
    return F.when(year >= 1450, year)


def data_url(mime: Column, data: Column) -> Column:
    """Bytes as a data address in base64."""
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(data))


def label_text(c: Column) -> Column:
    """A printed label without the bracket or stop that stands at its ends, 40 characters at most; null where nothing is left."""
    return F.left(F.nullif(F.regexp_replace(F.trim(c), r"^[(\[]?\s*|\s*[.)\]]?$", ""), F.lit("")), F.lit(40))


def width_fraction(c: Column) -> Column:
    """The part of the text's width that a graphic takes; null for absolute widths."""
    return F.regexp_extract(c, r"width\s*=\s*([\d.]+)\s*\\(?:text|line|column)width", 1).try_cast("double")


def snippet(c: Column) -> Column:
    """A template whose stops stand between paragraph signs, as a snippet with numbered stops; an odd number of signs is literal."""
    literal = lambda x: F.regexp_replace(F.regexp_replace(x, r"\\", r"\\\\"), r"([$}])", r"\\$1")
    source = F.regexp_replace(c, "\r\n", "\n")
    parts = F.split(source, "§")
    body = F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.concat(F.lit("${"), ((i + 1) / 2).cast("int").cast("string"), F.lit(":"), literal(x), F.lit("}"))).otherwise(literal(x))), "")
    return F.when(F.size(parts) % 2 == 0, literal(source)).when(F.size(parts) == 1, body).otherwise(F.concat(body, F.lit("$0")))


def first_stop(c: Column, selection: Column) -> Column:
    """A snippet with a selection in the place of its first stop's text; a snippet without that stop stays as it is."""
    filled = F.concat(F.regexp_extract(c, r"(?s)^(.*?)\$\{1:[^${}]*\}", 1), F.lit("${1:"), selection, F.regexp_extract(c, r"(?s)^.*?\$\{1:[^${}]*(\}.*)$", 1))
    return F.when(c.rlike(r"\$\{1:[^${}]*\}"), filled).otherwise(c)


def completion_start(line: Column, word: Column) -> Column:
    """Column, counted from 1, at which a completion replaces what is typed: that of an open command, else of the word."""
    typed = F.regexp_extract(line, r"(\\[a-zA-Z@]*)$", 1)
    return F.when(typed != "", F.length(line) + 1 - F.length(typed)).otherwise(word)


def let(c: Column, f) -> Column:
    """f of c, with c evaluated once however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def clean_latex(c: Column) -> Column:
    """A model's answer without a code fence and without delimiters around all of it; lone dollars go only if no other is within."""
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    fence = r"(?s)^```(?:latex|tex)?\s*\n(.*?)\n?```$"
    text = let(strip(c), lambda x: F.when(x.rlike(fence), strip(F.regexp_extract(x, fence, 1))).otherwise(x))
    for a, z in (("\\[", "\\]"), ("$$", "$$"), ("\\(", "\\)")):
        text = let(text, _inside(a, z, strip))
    return let(text, lambda x: F.when(x.rlike(r"(?s)^\$[^$]*\$$"), strip(F.substring(x, F.lit(2), F.length(x) - 2))).otherwise(x))


def _inside(a: str, z: str, strip):
    return lambda x: F.when(x.startswith(a) & x.endswith(z) & (F.length(x) >= 4), strip(F.substring(x, F.lit(3), F.length(x) - 4))).otherwise(x)


def header_text(c: Column) -> Column:
    """Text of a page header: special characters but the backslash escaped, then accents of TeX written out."""
    return F.regexp_replace(F.regexp_replace(c, r"([&%$#_{}])", r"\\$1"), r"([~^])", r"\\$1{}")
