"""Column functions on text: cleaning, capitals, spacing, headings, scripts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The narrow form of each full-width mark.
NARROW = {
    "，": ",", "。": ".", "！": "!", "？": "?", "；": ";", "：": ":", "、": ",", "（": "(",
    "）": ")", "【": "[", "】": "]", "“": '"', "”": '"', "‘": "'", "’": "'", "…": "...",
}
# Marks that take no space before, and after them; marks that end a sentence.
NO_SPACE_BEFORE = r"""^[，。！？；：、）】》’”"'.,;:!?)\]]+$"""
NO_SPACE_AFTER = r"""^[（【《‘“"'(\[]+$"""
SENTENCE_END = r"^[.!?。！？]+$"
# Headings, bot-challenge markers, junk and artefact entries.
HEADINGS = (r"^第[0-9一二三四五六七八九十百千万零〇]+\s*[章回卷节節集]", r"(?i)^(chương|chapter)\s+\d+")
CHALLENGE = r"(?i)just a moment|attention required|cf-browser-verification|__cf_chl_|checking your browser|access denied|enable javascript and cookies"
JUNK = (
    r"(?i)www\.",
    r"(?i)\.(com|net|cn|vn)\b",
    r"(?i)txt8|zuilu|qidian|bqg\d*|zhulang|xbiquge|shumilou|feiku|zwdu|tianyabook",
    r"未完待续|首发|本站域名|文字首发|同步阅读",
)
KEY_ARTEFACTS = (
    r"^正文\s*\d+\s*$",
    r"^第?[0-9一二三四五六七八九十百千万零]+\s*[章节節回卷集幕折]$",
    r"^[0-9]+\s*(亿|億|万|萬|元|美元|块|個|个)",
    r"^第?[0-9+,、\-～~\s]+[章节節回卷集幕折]\s*$",
    r"^\d{1,4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*[日号號]\s*$",
)
VALUE_ARTEFACTS = (r"(?i)^(Chương|Hồi|Chapter)\s*\d+", r"(?i)^(ngày|Ngày)\s+\d+\s+tháng", r"(?i)^\d+\s+tháng.*năm\s+\d+")
HAN = r"\p{IsHan}"
_EDGE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def trim_all(c: Column) -> Column:
    """Trim every Unicode blank, the ideographic space and the byte-order mark."""
    return F.regexp_replace(c, f"^{_EDGE}|{_EDGE}$", "")


def any_of(c: Column, patterns) -> Column:
    """Whether any of the patterns is found; flags at the start of a pattern hold for it alone."""
    return c.rlike("|".join(f"(?:{p})" for p in patterns))


def sanitize(c: Column) -> Column:
    """Drop script-like tags, any tag, javascript: and control characters, in that order."""
    c = F.regexp_replace(c, r"(?i)</?(?:script|style|iframe|object|embed)\b[^>]*>", "")
    c = F.regexp_replace(c, r"<[^>]+>", "")
    c = F.regexp_replace(c, r"(?i)javascript\s*:", "")
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def normalize_lines(c: Column) -> Column:
    """Trim lines, drop blank ones."""
    return F.array_join(F.filter(F.transform(F.split(c, r"[\r\n]+"), trim_all), lambda x: x != ""), "\n")


def is_junk(key: Column, value: Column, trimmed: bool = False) -> Column:
    bare = value if trimmed else trim_all(value)
    return bare.isin("", "()") | any_of(F.concat(key, F.lit(" "), value), JUNK)


def is_number_unit(key: Column, trimmed: bool = False) -> Column:
    k = key if trimmed else trim_all(key)
    rest = F.regexp_replace(k, r"(?U)[\d\s]", "")
    return k.rlike(r"(?U)^\d") & ((rest == "") | rest.rlike(r"^[\x{4E00}-\x{9FFF}]{1,6}$"))


def is_artifact(key: Column, value: Column, trimmed: bool = False) -> Column:
    k, v = (key, value) if trimmed else (trim_all(key), trim_all(value))
    return any_of(k, KEY_ARTEFACTS) | any_of(v, VALUE_ARTEFACTS) | is_number_unit(k, True)


def is_heading(c: Column, patterns=HEADINGS, longest: int = 60) -> Column:
    t = trim_all(c)
    return (t != "") & (F.length(t) <= longest) & any_of(t, patterns)


def is_challenge(status: Column, html: Column) -> Column:
    return F.coalesce(status.isin(403, 503), F.lit(False)) | F.substring(html, 1, 4000).rlike(CHALLENGE)


def script_count(c: Column, cls: str = HAN) -> Column:
    return F.regexp_count(c, F.lit(cls))


def detect_language(c: Column, cls: str = HAN, ratio: float = 0.1, yes: str = "ZH", no: str = "VI") -> Column:
    """yes where the share of characters of the class among non-blank ones is over the ratio."""
    n = F.length(F.regexp_replace(c, r"\s", ""))
    return F.when((n > 0) & (script_count(c, cls) / n > ratio), yes).otherwise(no)


def pick_alternative(c: Column, sep: str = "/") -> Column:
    return F.substring_index(c, sep, 1)


def normalize_alternatives(c: Column) -> Column:
    return trim_all(F.regexp_replace(F.replace(c, F.lit("|"), F.lit("/")), r"\s*/\s*", "/"))


def capital_of(ch: str) -> str:
    """The capital of one character, as one character (`ß` is `ẞ`); where there is none it stays."""
    if ch == "ß":
        return "ẞ"
    return next((u for u in (ch.upper(), ch.title()) if len(u) == 1), ch)


#: Characters whose full capital is longer, and have one of one character too.
_LONGER = [c for c in map(chr, range(0x80, 0x2000)) if len(c.upper()) > 1 and capital_of(c) != c]


def capital(c: Column) -> Column:
    """capital_of."""
    return F.when(F.length(F.upper(c)) == F.length(c), F.upper(c)).otherwise(F.translate(c, "".join(_LONGER), "".join(map(capital_of, _LONGER))))


def capitalize_first(c: Column) -> Column:
    """Upper-case the first letter, whatever comes before it; the rest stays."""
    lead = F.regexp_extract(c, r"^([^\p{L}]*)\p{L}", 1)
    n = F.length(lead)
    return F.when(c.rlike(r"\p{L}"), F.concat(lead, capital(F.substring(c, n + 1, F.lit(1))), F.substring(c, n + 2, F.length(c)))).otherwise(c)


def apply_cap_style(c: Column, style: Column) -> Column:
    words = F.array_join(F.transform(F.split(c, r"(?<=\s)"), lambda w: F.when(w.rlike(r"^\p{L}"), F.concat(capital(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))).otherwise(w)), "")
    return F.when(style == "ALL_WORDS", words).when(style == "FIRST_LETTER", capitalize_first(c)).otherwise(c)


def capitalize_syllables(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.concat(capital(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def narrow_punct(src: Column, dst: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in NARROW.items() for x in kv]), src), dst)


def needs_space(a: Column, b: Column) -> Column:
    return ~(trim_all(b).rlike(NO_SPACE_BEFORE) | trim_all(a).rlike(NO_SPACE_AFTER))


def remap_codepoints(c: Column, source: str, target: str) -> Column:
    """Private-use characters to their glyphs; unmapped ones become a box."""
    return F.regexp_replace(F.translate(c, source, target), r"[\x{E000}-\x{F8FF}]", "□")


def _unicode(form: str):
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return run


def nfc(c: Column) -> Column:
    """Composed form, trimmed; Python sees only texts that aren't ASCII."""
    ascii_only = ~c.rlike(r"[^\x00-\x7F]")
    return trim_all(F.when(ascii_only, c).otherwise(_unicode("NFC")(F.when(~ascii_only, c))))


def slugify(c: Column) -> Column:
    """Decomposed, lower-case, runs of other characters than a-z and 0-9 (marks too, so `tiên` is `tie-n`) become dashes; of an empty one a name by hash of the title."""
    plain = F.regexp_replace(F.lower(_unicode("NFKD")(c)), "[^a-z0-9]+", "-")
    slug = F.regexp_replace(plain, "^-+|-+$", "")
    return F.when(slug != "", slug).otherwise(F.concat(F.lit("truyen-"), F.substring(F.sha2(F.coalesce(c, F.lit("")), 256), 1, 8)))


def content_hash(c: Column) -> Column:
    """Tells whether a text has changed."""
    return F.sha2(F.coalesce(c, F.lit("")), 256)


def split_alternatives(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "/"), trim_all), lambda x: x != "")
