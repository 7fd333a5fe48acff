"""Column functions over message texts. Lengths and cuts are in code points unless a name says utf16."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from convoloom.functions.times import bound

#: What counts as white space everywhere: the class of the source data's language, not Java's or SQL's.
SPACE = r"\t\n\x0b\x0c\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff".encode().decode("unicode_escape")
_RUN = f"[{SPACE}]+"
#: The same as single characters, for trims that look at the ends only.
SPACES = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
FENCE = "```"
EMPTY_MARK, CORRUPT_MARK = "[empty message]", "[corrupted message]"


def trim_space(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def normalize_text(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, _RUN, " "))


def non_blank(c: Column) -> Column:
    """c, or null where it is blank."""
    return F.when(trim_space(c) != "", c)


def unwrap_query(c: Column) -> Column:
    """The inside of a <user_query> element if it is the whole text, else the text."""
    pattern = f"(?is)^[{SPACE}]*<user_query>[{SPACE}]*(.*?)[{SPACE}]*</user_query>[{SPACE}]*$"
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1)).otherwise(c)


def shorten(c: Column, most: int) -> Column:
    """c cut to most characters, the last three as dots."""
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - 3), F.lit("...")))


def shorten_start(c: Column, most: int) -> Column:
    """c cut at its start to most characters, the first three as dots."""
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.lit("..."), F.substring(c, -(most - 3), most - 3)))


def title_of(first_user_text: Column) -> Column:
    """First line, 50 characters at most; null for none or an empty one."""
    line = F.get(F.split(first_user_text, "\n", 2), F.lit(0))
    return F.when(F.length(line) > 0, shorten(line, 50))


def preview_of(first_user_text: Column) -> Column:
    """Fenced code as [code], line breaks as blanks, 100 characters at most; '' for no text."""
    plain = F.regexp_replace(F.regexp_replace(first_user_text, r"(?s)```.*?```", "[code]"), r"\n+", " ")
    return F.coalesce(shorten(trim_space(plain), 100), F.lit(""))


def listing_preview(first_text: Column) -> Column:
    return F.coalesce(F.substring(first_text, 1, 100), F.lit("(Empty session)"))


def match_positions(content: Column, query: str) -> Column:
    """array<int>: 0-based code-point starts of all matches of query, case aside, overlapping ones too. For queries and texts whose lower case keeps the number of code points; utf16_positions holds for the rest."""
    q = query.lower()
    if not q:
        return F.array().cast("array<int>")
    none = F.array().cast("array<int>")
    if not any(q.endswith(q[:k]) for k in range(1, len(q))):
        # matches can't overlap, so they are where the text falls apart

        def seams(parts):
            return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x)) + (i - 1) * len(q))

        found = bound(F.split(F.lower(content), F.lit(re.sub(r"([^\w\s])", r"\\\1", q)), -1), lambda parts: F.when(F.size(parts) > 1, seams(parts)).otherwise(none))
        return F.coalesce(found, none)

    def starts(low):
        last = F.length(low) - len(q)
        every = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.when(F.substring(low, i + 1, F.lit(len(q))) == q, i)), lambda x: x.isNotNull())
        return F.when((last >= 0) & F.contains(low, F.lit(q)), every).otherwise(none)

    return F.coalesce(bound(F.lower(content), starts), none)


def utf16_length(c: Column) -> Column:
    return F.call_function("div", F.octet_length(F.encode(c, "UTF-16BE")), F.lit(2))


def snippet_of(content: Column, positions: Column, size: int, around: int) -> Column:
    """struct<text, positions>: the first match with so many characters on both sides; positions of the matches that lie inside the cut."""

    def body(ps):
        first, n = F.get(ps, F.lit(0)), F.length(content)
        a, b = F.greatest(F.lit(0), first - around), F.least(n, first + size + around)
        text = F.concat(F.when(a > 0, "...").otherwise(""), F.substring(content, a + 1, b - a), F.when(b < n, "...").otherwise(""))
        inside = F.transform(F.filter(ps, lambda p: (p >= a) & (p + size <= b)), lambda p: p - a + F.when(a > 0, 3).otherwise(0))
        return F.struct(text.alias("text"), inside.alias("positions"))

    return bound(positions, body)


def source_lines(content: Column) -> Column:
    """Lines without the carriage return at their ends."""
    return F.transform(F.split(content, "\n"), lambda x: F.regexp_replace(x, "\r$", ""))


def line_context(content: Column, position: Column, k: int) -> Column:
    """struct<line_no, line, before, after> of the line that holds a 0-based position; before and after hold up to k lines and are null when empty."""
    empty = lambda x: F.when(F.size(x) > 0, x)

    def body(lines):
        def at(no):
            before = F.slice(lines, F.greatest(F.lit(1), no + 1 - k), F.least(F.lit(k), no)) if k else F.array().cast("array<string>")
            after = F.slice(lines, no + 2, F.lit(k)) if k else F.array().cast("array<string>")
            return F.struct(no.alias("line_no"), F.get(lines, no).alias("line"), empty(before).alias("before"), empty(after).alias("after"))

        return bound(F.size(F.split(F.substring(content, 1, position), "\n")) - 1, at)

    return bound(source_lines(content), body)


_BLOCK = r"(?m)^```(\w*)\n([\s\S]*?)^```"


def code_blocks(c: Column) -> Column:
    """array<struct<language, content, start_line>> of the fenced blocks; language null if none is named, content without blanks at its end, start_line from 0."""
    langs, bodies = F.regexp_extract_all(c, F.lit(_BLOCK), F.lit(1)), F.regexp_extract_all(c, F.lit(_BLOCK), F.lit(2))
    outside = F.split(c, r"(?m)^```\w*\n[\s\S]*?^```")
    lines = lambda x: F.size(F.split(x, "\n")) - 1
    # lines before block i: those of the texts ahead of it and of the blocks before it
    starts = F.transform(F.sequence(F.lit(1), F.size(bodies)), lambda i: F.aggregate(F.slice(outside, F.lit(1), i), F.lit(0), lambda a, x: a + lines(x)) + F.aggregate(F.slice(bodies, F.lit(1), i - 1), F.lit(0), lambda a, x: a + lines(x) + 1))
    rows = F.zip_with(F.arrays_zip(langs.alias("l"), bodies.alias("b")), starts, lambda x, s: F.struct(F.when(x["l"] != "", x["l"]).alias("language"), F.rtrim(x["b"], F.lit(SPACES)).alias("content"), s.alias("start_line")))
    return F.when(F.size(bodies) > 0, rows).otherwise(F.array().cast("array<struct<language:string,content:string,start_line:int>>"))


def content_class(c: Column) -> Column:
    return F.when(c == CORRUPT_MARK, "corrupt").when((c == "") | (c == EMPTY_MARK) | c.isNull(), "empty").otherwise("real")


def compact_count(n: Column) -> Column:
    """1234 as 1.2k, 1234567 as 1.2M; below 1000 as it is."""
    return F.when(n >= 1_000_000, F.concat(F.format_string("%.1f", n / 1_000_000.0), F.lit("M"))).when(n >= 1000, F.concat(F.format_string("%.1f", n / 1000.0), F.lit("k"))).otherwise(n.cast("string"))


def compact_size(n: Column) -> Column:
    """Bytes as B, KB, MB or GB with one decimal from KB on."""
    step = lambda k, unit: F.concat(F.format_string("%.1f", n / float(1024**k)), F.lit(f" {unit}"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, step(1, "KB")).when(n < 1024**3, step(2, "MB")).otherwise(step(3, "GB"))
