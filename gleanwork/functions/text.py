"""Text functions: hashes, quality gates, structure rules, chunking profiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that readable Thai or English text consists of.
READABLE = r"[A-Za-z0-9฀-๿\s\x1c-\x1f\.,;:'\"!?()\[\]{}\-_/\\@#%&*+|=<>~`°–—…·•]"
#: The separators of the splitter, in order.
SEPARATORS = ("\n\n", "\n", ". ", " ")
MAX_UNREADABLE = 0.05
#: What marks Markdown headers, Markdown tables (a row, the row of dashes), HTML tables.
MD_HEADER = r"(?md)^\s*#{1,6}\s+.+"
MD_ROW = r"(?md)^\s*\|.*\|\s*$"
MD_RULE = r"(?md)^\s*\|\s*:?-{3,}.*\|\s*$"
HTML_TABLE = r"(?is)<\s*table[\s>].*?>"
THAI = r"[฀-๿]"


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def sha1(text: Column) -> Column:
    return F.sha1(text)


def unreadable_share(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"(?U){READABLE}", "")) / F.greatest(F.length(text), F.lit(1)).cast("double")


def qc_ok(text: Column, min_chars: int) -> Column:
    """Long enough, no replacement character, and hardly any character outside READABLE."""
    ok = (text != "") & (F.length(text) >= min_chars) & ~F.contains(text, F.lit("�")) & (unreadable_share(text) < MAX_UNREADABLE)
    return F.coalesce(ok, F.lit(False))


def th_en(text: Column) -> Column:
    """struct(lang, prob): th or en by the scripts of the letters, without a model."""
    letters = F.greatest(F.length(F.regexp_replace(text, r"[^\p{L}\p{M}]", "")), F.lit(1)).cast("double")
    thai = F.length(F.regexp_replace(text, r"[^฀-๿]", "")) / letters
    latin = F.length(F.regexp_replace(text, r"[^A-Za-z]", "")) / letters
    return F.struct(F.when(thai >= latin, "th").otherwise("en").alias("lang"), F.least(F.greatest(thai, latin), F.lit(1.0)).alias("prob"))


def usable_th_en(text: Column, min_len: int = 150, min_prob: float = 0.70, detect=th_en) -> Column:
    """Long enough, and Thai or English with that probability; detect: Column -> struct(lang, prob)."""
    found = detect(text)
    ok = (F.length(text) >= min_len) & found["lang"].isin("th", "en") & (found["prob"] >= min_prob)
    return F.coalesce(ok, F.lit(False))


def md_has_table(text: Column) -> Column:
    """An HTML table tag, or a Markdown table row followed by a row of dashes.

    Lines are looked at only where the text has a bar and a dash at all, and cells only of lines that can be a row of dashes.
    """
    lines = F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]"), strip)
    cells = lambda line: F.filter(F.transform(F.split(line, r"\|"), strip), lambda c: c != "")
    rule = lambda c: c.rlike(r"^[-: ]+$") & (F.length(F.translate(c, ": ", "")) >= 3)
    dashes = lambda line: F.exists(F.array(cells(line)), lambda cs: (F.size(cs) > 0) & F.forall(cs, rule))
    is_rule = lambda line: F.contains(line, F.lit("-")) & ~line.rlike(r"(?U)[^-:|\s\x1c-\x1f]") & dashes(line)
    next_to = F.zip_with(lines, F.slice(lines, 2, F.size(lines)), lambda a, b: a.startswith("|") & a.endswith("|") & F.coalesce(is_rule(b), F.lit(False)))
    some = F.contains(text, F.lit("|")) & F.contains(text, F.lit("-"))
    return F.coalesce(F.contains(F.lower(text), F.lit("<table")), F.lit(False)) | F.coalesce(F.when(some, F.exists(next_to, lambda x: x)), F.lit(False))


def looks_structured(text: Column) -> Column:
    """A Markdown header, an HTML table, a Markdown table, or many line feeds."""
    has = lambda p: F.regexp_like(text, F.lit(p))
    table = has(MD_ROW) & has(MD_RULE)
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    dense = (feeds >= 3) & (feeds / F.greatest(F.length(text), F.lit(1)).cast("double") > 0.002)
    return F.coalesce(has(MD_HEADER) | has(HTML_TABLE) | table | dense, F.lit(False))


def profile(source_type: Column, text: Column) -> Column:
    """structured or ocr_raw."""
    kind = F.lower(F.coalesce(source_type, F.lit("")))
    return F.when(kind.isin("pdf_md", "html", "text") & looks_structured(text), "structured").otherwise("ocr_raw")


def profile_size(profile: Column, structured: int = 512, ocr: int = 256) -> Column:
    return F.when(profile == "structured", structured).otherwise(ocr)


def profile_overlap(profile: Column, structured: int = 512, structured_share: float = 0.12, ocr: int = 256, ocr_share: float = 0.20) -> Column:
    return F.when(profile == "structured", round(structured * structured_share)).otherwise(round(ocr * ocr_share))


def preview(text: Column, length: int = 280) -> Column:
    return F.when(F.length(text) > length, F.concat(F.left(text, F.lit(length)), F.lit("…"))).otherwise(text)


def first_text(*columns: Column) -> Column:
    """The first that is neither null nor empty, else empty; stripped."""
    return strip(F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit("")))
