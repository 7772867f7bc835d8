"""Text expressions: tokens, cleaning, statistics, parsers of model replies. All are native columns but Unicode NFC and the decoding of all character references."""

from __future__ import annotations

import unicodedata
from html import unescape

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that Python's strip and split know, without the line feed.
BLANK = r" \t\r\x{0B}\x{0C}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Characters that count as special for density, and file types by extension.
SPECIAL = r":=()\[\]{}<>/\\|@#$%^&*"
EXTENSIONS = {"txt": "txt", "md": "markdown", "markdown": "markdown", "html": "html", "htm": "html", "pdf": "pdf", "docx": "docx", "doc": "docx", "csv": "csv", "eml": "email"}


def bound(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def strip(t: Column) -> Column:
    return F.regexp_replace(t, rf"\A[\n{BLANK}]+|[\n{BLANK}]+\z", "")


def is_blank(t: Column) -> Column:
    return F.regexp_like(t, F.lit(rf"\A[\n{BLANK}]*\z"))


def words(t: Column) -> Column:
    return F.filter(F.split(t, rf"[\n{BLANK}]+"), lambda w: w != "")


def tokenize(t: Column) -> Column:
    """Lower-case runs of a-z and 0-9 with two characters or more."""
    return F.filter(F.split(F.regexp_replace(F.lower(t), r"[^a-z0-9\s]", " "), r"\s+"), lambda w: F.length(w) > 1)


def nfc(t: Column) -> Column:
    """Canonical composition; texts below U+0300 are composed already and don't leave the JVM's fast path."""
    compose = F.udf(lambda x: None if x is None else unicodedata.normalize("NFC", x), "string", useArrow=True)
    return F.when(F.regexp_like(t, F.lit(r"[^\x{00}-\x{2FF}]")), compose(t)).otherwise(t)


def clean(t: Column) -> Column:
    """NFC; drops invisible and control characters; three line feeds or more become two; lines lose trailing white space and runs of spaces and tabs; strips."""
    t = F.regexp_replace(nfc(t), r"[\x{200B}-\x{200F}\x{2028}-\x{202F}\x{FEFF}]", "")
    t = F.regexp_replace(t, r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}]", "")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, rf"[{BLANK}]+(\n|\z)", "$1")
    return strip(F.regexp_replace(t, r"[ \t]{2,}", " "))


def stats(t: Column) -> dict[str, Column]:
    return {"char_count": F.length(t).cast("long"), "word_count": F.size(words(t)).cast("long"), "line_count": (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).cast("long")}


def density(t: Column) -> Column:
    """0 (sparse) to 1 (dense): short words, many sentences and special characters make a text dense; 0.5 without words."""

    def score(w: Column) -> Column:
        n = F.size(w)
        clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
        chars = F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x))
        ends = F.greatest(F.lit(1), F.length(t) - F.length(F.translate(t, ".!?", "")))
        special = F.length(t) - F.length(F.regexp_replace(t, f"[{SPECIAL}]", ""))
        value = 0.5 * clip((10.0 - chars / n) / 8.0) + 0.3 * clip(ends / n * 100.0 / 10.0) + 0.2 * clip(special / F.greatest(F.length(t), F.lit(1)) / 0.15)
        return F.when(n == 0, F.lit(0.5)).otherwise(value)

    return bound(words(t), score)


def contains_terms_share(query: Column, context: Column, stop: list[str]) -> Column:
    """Share of the query's distinct words, stop words left out, that the context has as substrings."""
    terms = F.array_except(F.array_distinct(F.filter(F.split(F.lower(query), r"\s+"), lambda x: x != "")), F.array(*map(F.lit, stop)))
    return F.when(F.size(terms) == 0, F.lit(1.0)).otherwise(F.size(F.filter(terms, lambda x: F.contains(F.lower(context), x))) / F.size(terms))


# --- replies of models


def parse_score(r: Column) -> Column:
    """The first whole number from 1 to 10 that stands alone, else 5."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(r, r"\b([1-9]|10)\b", 1), F.lit("")), F.lit("99")).cast("double"), F.lit(5.0))


def parse_ranking(r: Column, n: Column) -> Column:
    """All whole numbers, from 0, in range, first occurrences."""
    ids = F.transform(F.regexp_extract_all(r, F.lit(r"(\d{1,9})")), lambda x: x.cast("int") - 1)
    return F.array_distinct(F.filter(ids, lambda x: (x >= 0) & (x < n)))


def parse_variants(r: Column, n: int = 3) -> Column:
    """Lines without their numbers and bullets, longer than ten characters; the first n."""
    plain = lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r"^\d+[.)]\s*", ""), r"^[-*]\s*", "")
    return F.slice(F.filter(F.transform(F.split(r, "\n"), plain), lambda x: F.length(x) > 10), 1, n)


def parse_react(r: Column, query: Column) -> dict[str, Column]:
    """Thought, tool and arguments of a planner's reply; an action without parentheses takes the query."""
    thought = F.trim(F.regexp_replace(F.regexp_extract(r, r"(?is)Thought:\s*(.+?)(?:Action:|\z)", 1), r"\s+\z", ""))
    action = F.trim(F.regexp_extract(r, r"(?i)Action:\s*([^\n]+)", 1))
    finish = F.startswith(F.upper(action), F.lit("FINISH"))
    name = F.regexp_extract(action, r"(\w+)\(([^)]*)\)", 1)
    args = F.regexp_extract(action, r"(\w+)\(([^)]*)\)", 2)
    return {"thought": thought, "tool": F.when(finish, F.lit("FINISH")).when(name != "", name).otherwise(action), "args": F.when(finish, F.lit("")).when(name != "", args).otherwise(query)}


# --- sources


def video_id(u: Column) -> Column:
    """The eleven-character id of a video: itself, or out of a short, watch, shorts or embed link; null if there is none."""
    found = [F.regexp_extract(u, p, 1) for p in (r"^([A-Za-z0-9_-]{11})$", r"youtu\.be/([A-Za-z0-9_-]{11})", r"[?&]v=([A-Za-z0-9_-]{11})", r"/(?:shorts|embed)/([A-Za-z0-9_-]{11})")]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in found])


def route(u: Column) -> Column:
    """The loader for a source: videos and other URLs by their address, files by extension; null if unknown."""
    ext = F.lower(F.regexp_extract(u, r"\.([A-Za-z]+)$", 1))
    out = F.when(F.regexp_like(u, F.lit(r"^https?://[^/]*(youtube\.com|youtu\.be)")), F.lit("youtube")).when(F.regexp_like(u, F.lit(r"^https?://")), F.lit("html"))
    for k, v in EXTENSIONS.items():
        out = out.when(ext == k, F.lit(v))
    return out


def entities_decoded(t: Column) -> Column:
    """All character references of HTML as their characters, in batches."""
    return F.udf(lambda x: None if x is None else unescape(x), "string", useArrow=True)(t)


#: The references that the SQL of pages decodes. &amp; comes last, so that nothing is decoded twice.
ENTITIES = {"copy": "©", "middot": "·", "quot": '"', "lt": "<", "gt": ">", "amp": "&"}


def named_entities(t: Column) -> Column:
    """Only ENTITIES, each with its semicolon, as their characters."""
    for name, char in ENTITIES.items():
        t = F.replace(t, F.lit(f"&{name};"), F.lit(char))
    return t


def html_title(h: Column, decode=entities_decoded) -> Column:
    """The first title, character references decoded, without space separators around it; null if there is none or it is empty."""
    title = decode(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return bound(F.regexp_replace(title, r"\A\p{Zs}++|(?<!\p{Zs})\p{Zs}++\z", ""), lambda x: F.nullif(x, F.lit("")))


#: What is no text of a page, and where its text is looked for first.
NO_TEXT = ("script", "style", "nav", "footer", "header", "aside", "form", "noscript", "svg", "iframe")
MAIN = ("main", "article", "body")


#: Where a tag's name ends: only ASCII letters, digits and _ go on with a word, as for RE2.
END = "(?![0-9A-Za-z_])"


def _tag(name: str) -> str:
    """A tag's name as RE2 reads it without case: the long s is an s."""
    return name.replace("s", "[sſ]")


def html_text(h: Column, decode=entities_decoded) -> Column:
    """The text of main, article or body without comments, scripts, styles, navigation and forms, character references decoded; a line for each run of text, without space separators around it."""
    h = F.regexp_replace(h, r"(?s)<!--.*?-->", "")
    for tag in NO_TEXT:
        h = F.regexp_replace(h, rf"(?is)<{_tag(tag)}{END}.*?</{_tag(tag)}>", "")
    found = lambda x, tag: bound(F.regexp_extract(x, rf"(?is)<{tag}{END}[^>]*>(.*?)</{tag}>", 1), lambda p: F.nullif(p, F.lit("")))
    part = bound(h, lambda x: F.coalesce(*[found(x, tag) for tag in MAIN], x))
    text = decode(F.regexp_replace(part, r"(?s)<[^>]*>", "\n"))
    return F.regexp_replace(F.regexp_replace(text, r"(?<!\p{Zs})\p{Zs}*+\n[\n\p{Zs}]*+", "\n"), r"\A[\n\p{Zs}]++|(?<![\n\p{Zs}])[\n\p{Zs}]++\z", "")


def timestamp_label(seconds: Column) -> Column:
    """M:SS, or H:MM:SS from an hour on."""
    s = seconds.cast("long")
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two(r))).otherwise(F.concat_ws(":", m.cast("string"), two(r)))
