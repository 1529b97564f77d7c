"""Column expressions over strings. Offsets and lengths are Unicode code points throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_ws(c: Column) -> Column:
    """White space (Unicode) folded to single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def xml_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def truncate_status(c: Column, most: int = 512) -> Column:
    """Longer texts keep ``most`` characters and say how many more there were."""
    rest = F.concat(F.lit("...[truncated "), (F.length(c) - most).cast("string"), F.lit(" more chars]"))
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), rest)).otherwise(c)


def mask_credentials(url: Column) -> Column:
    return F.regexp_replace(url, r"//[^@/]+@", "//***@")


def url_extension(url: Column, default: str = ".bin") -> Column:
    """The last path segment's extension, without query, fragment or ;parameters; ``default`` where there is none."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-z]+://[^/]*", "")
    last = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r";.*$", "")
    ext = F.regexp_extract(last, r"^.+(\.[A-Za-z0-9]+)$", 1)
    return F.when(ext == "", F.lit(default)).otherwise(F.lower(ext))


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    for name, v in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), v.cast("string"))
    return template


def mask_comments(html: Column) -> Column:
    """Comments become blanks of the same length, so that offsets stay; one that is never closed is text."""
    parts = F.split(html, r"(?s)<!--.*?-->", -1)
    found = F.regexp_extract_all(html, F.lit(r"(?s)<!--.*?-->"), F.lit(0))
    blanks = F.transform(found, lambda x: F.repeat(F.lit(" "), F.length(x)))
    return F.array_join(F.transform(F.arrays_zip(parts.alias("p"), blanks.alias("b")), lambda z: F.concat(z["p"], F.coalesce(z["b"], F.lit("")))), "")


def occurrences(text: Column, needle: Column) -> Column:
    """Start offsets of the non-overlapping occurrences of a literal; none for an empty one."""
    pieces = F.split(text, F.concat(F.lit("\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1)
    ends = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.length(p))
    fold = F.aggregate(
        ends, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda s, n: F.struct((s["at"] + n + F.length(needle)).alias("at"), F.concat(s["out"], F.array(s["at"] + n)).alias("out")), lambda s: s["out"],
    )
    return F.when((F.length(needle) == 0) | needle.isNull(), F.array().cast("array<int>")).otherwise(fold)


def quote_words(quote: Column) -> Column:
    """The words of a quote: what white space (Unicode) parts."""
    return F.array_remove(F.split(F.coalesce(quote, F.lit("")), r"(?U)\s+"), "")


def flexible_occurrences(text: Column, quote: Column) -> Column:
    """array<struct<start, stop>> of a quote's non-overlapping occurrences, any white space of it standing for any in the text. None for
    a blank or null quote."""
    words = F.transform(quote_words(quote), lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    pattern = F.concat(F.lit("(?U)"), F.array_join(words, "\\s+"))
    found, pieces = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    spans = "array<struct<start:int,stop:int>>"

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["p"])
        stop = start + F.length(x["m"])
        return F.struct(stop.alias("at"), F.concat(s["out"], F.array(F.struct(start.alias("start"), stop.alias("stop")))).alias("out"))

    zipped = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(found)).alias("p"), found.alias("m"))
    fold = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("out")), step, lambda s: s["out"])
    return F.when((F.size(words) == 0) | text.isNull(), F.array().cast(spans)).otherwise(fold)


#: The four ways that the question part of a call is announced, tried in this order whatever their position.
QA_PATTERNS = (
    r"(?i)\bQuestion[-\s]and[-\s]Answer\s+Session\b",
    r"(?i)\bWe(?:'ll| will)\s+now\s+(?:begin|move)\s+(?:the\s+)?Q\s*&\s*A\b",
    r"(?i)\bI(?:'ll| will)\s+(?:now\s+)?turn\s+(?:it|the call)\s+over\s+to\s+questions\b",
    r"(?im)^\s*(?:Operator:\s*)?(?:we'll|we will|let's)\s+(?:now\s+)?(?:take|open).*?\bquestions\b",
)


def split_qa(text: Column) -> Column:
    """struct(prepared, qa): cut where the first pattern that matches at all does; without one, all is prepared."""
    cut = F.coalesce(*[F.when(F.rlike(text, F.lit(p)), F.length(F.element_at(F.split(text, p, 2), 1))) for p in QA_PATTERNS])
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+\z", "")
    return F.when(cut.isNull(), F.struct(strip(text).alias("prepared"), F.lit("").alias("qa"))).otherwise(
        F.struct(strip(F.substring(text, F.lit(1), cut)).alias("prepared"), strip(F.substring(text, cut + 1, F.length(text))).alias("qa"))
    )


def year_tokens(year: Column) -> Column:
    two = lambda y: F.lpad((y % 100).cast("string"), 2, "0")
    out = []
    for y in (year, year - 1):
        out += [y.cast("string"), F.concat(F.lit("fy"), two(y)), F.concat(F.lit("fy"), y.cast("string"))]
    return F.array(*out)


def title_matches(title: Column, company: Column, ticker: Column, year: Column, quarter: Column) -> Column:
    """A call's title names the company or ticker, its quarter (q1..q4) and a year, this one's or the one before's."""
    t = F.lower(title)
    named = F.contains(t, F.lower(company)) | F.contains(t, F.lower(ticker))
    return named & F.contains(t, F.concat(F.lit("q"), quarter.cast("string"))) & F.exists(year_tokens(year), lambda y: F.contains(t, y))


#: Speaker marks and headings of a call's questions; how audio files begin.
OPERATOR_MARK, QA_MARK = r"(?i)\bOperator\s*:", r"(?i)(question.{0,5}and.{0,5}answer|q\s*[&-]\s*a)"
AUDIO_HEADS = ("494433", "4F676753", "664C6143", "52494646", "1A45DFA3")


def classify_exhibit(content: Column, least_bytes: int = 30_000, least_operators: int = 3) -> Column:
    """struct(kind, operators, has_qa): transcript, mixed or press_release, by speaker marks and size in bytes."""
    text = F.regexp_replace(content, r"<[^>]+>", " ")
    ops = F.regexp_count(text, F.lit(OPERATOR_MARK))
    qa = F.rlike(text, F.lit(QA_MARK))
    kind = F.when((ops >= least_operators) & (F.octet_length(content) >= least_bytes), "transcript").when((ops > 0) | qa, "mixed").otherwise("press_release")
    return F.struct(kind.alias("kind"), ops.alias("operators"), qa.alias("has_qa"))


def looks_like_audio(head: Column) -> Column:
    """Container signatures in the first bytes: ID3, OggS, fLaC, RIFF, EBML; ``ftyp`` at 4; an MPEG sync word."""
    h = F.hex(head)
    known = [h.startswith(x) for x in AUDIO_HEADS]
    hit = known[0]
    for k in known[1:]:
        hit = hit | k
    return (F.length(head) >= 4) & (hit | (F.substring(h, 9, 8) == "66747970") | F.rlike(h, F.lit("^FFF")))


def estimated_tokens(c: Column, per: int = 4) -> Column:
    """The default token counter: one token for each ``per`` code points, rounded up."""
    return F.ceil(F.length(c) / per).cast("int")
