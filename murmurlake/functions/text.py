"""Column expressions over text: matches with offsets, boundaries, clocks, sizes, normal forms. Offsets are code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALNUM = r"[\p{IsAlphabetic}\p{N}]"
FOUND = "array<struct<start:int,end:int,text:string>>"


_BLOCK = 64


def let(value: Column, body) -> Column:
    """body(value) with value worked out once: inside a lambda a bare expression would be worked out at every use."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def running_lengths(parts: Column) -> Column:
    """For an array of strings, the summed lengths of the elements before each: sums by blocks of 64, then inside the block.

    A fold that appends to an array copies it at every step; this takes n * 64 / 2 additions and (n / 64) ** 2 / 2.
    """
    add = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    block = lambda i: F.floor(i / _BLOCK).cast("int")
    blocks = lambda a: F.sequence(F.lit(0), block(F.size(a) - 1))

    def of(lengths: Column) -> Column:
        sums = F.transform(blocks(lengths), lambda b: add(F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK))))
        heads = lambda s: F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda b: add(F.slice(s, F.lit(1), b)))
        each = lambda h: F.transform(lengths, lambda _, i: F.get(h, block(i)) + add(F.slice(lengths, block(i) * _BLOCK + 1, F.pmod(i, F.lit(_BLOCK)))))
        return let(sums, lambda s: let(heads(s), each))

    return let(F.transform(parts, lambda p: F.length(p)), of)


def find_all(text: Column, pattern: str) -> Column:
    """Every leftmost, non-overlapping match as array<struct<start, end, text>>.

    Matches are fenced with two control characters (blanked in the text first, at equal length), the text is split at the
    opening one and offsets are running lengths. `pattern` may hold only non-capturing groups. Null gives null.
    """
    clean = F.translate(text, "\u0001\u0002", "  ")
    parts = F.split(F.regexp_replace(clean, f"({pattern})", "\u0001$1\u0002"), "\u0001", -1)
    return F.when(text.isNotNull(), let(parts, located))


def located(parts: Column) -> Column:
    """Spans from the parts of a text split at the opening mark; each part but the first is `match, closing mark, rest`."""

    def row(part: Column, at: Column, i: Column) -> Column:
        hit = F.substring_index(part, "\u0002", 1)
        start = at - F.greatest(i - 1, F.lit(0))  # closing marks before
        return F.struct(start.cast("int").alias("start"), (start + F.length(hit)).cast("int").alias("end"), hit.alias("text"))

    both = F.arrays_zip(parts.alias("p"), running_lengths(parts).alias("at"))
    return let(both, lambda b: F.slice(F.transform(b, lambda x, i: row(x["p"], x["at"], i)), F.lit(2), F.size(b)))


def char_at(text: Column, at: Column) -> Column:
    """The code point at a 0-based place; empty outside the text."""
    return F.when((at >= 0) & (at < F.length(text)), F.substr(text, at + 1, F.lit(1))).otherwise("")


def free_before(text: Column, start: Column, chars: str = ALNUM) -> Column:
    return ~char_at(text, start - 1).rlike(chars)


def free_after(text: Column, end: Column, chars: str = ALNUM) -> Column:
    return ~char_at(text, end).rlike(chars)


def byte_offset(text: Column, at: Column) -> Column:
    """UTF-8 bytes before the code point at a 0-based place."""
    return F.octet_length(F.substr(text, F.lit(1), at))


def normal_form(text: Column) -> Column:
    """White space (of any script) to single blanks, trimmed, lower case: what makes two surface forms one entity."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{IsAlphabetic}\p{N}]+"), lambda x: x != "")


def stamp(seconds: Column, mark: str) -> Column:
    """HH:MM:SS, `mark`, milliseconds; negative times count as 0, halves go up."""
    ms = F.round(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long")
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(ms / 3600000), F.pmod(F.floor(ms / 60000), F.lit(60)), F.pmod(F.floor(ms / 1000), F.lit(60)), F.pmod(ms, F.lit(1000)))


def clock(seconds: Column) -> Column:
    """Rounded seconds as mm:ss, from an hour on h:mm:ss."""
    s = F.round(F.greatest(seconds, F.lit(0.0))).cast("long")
    h, m, r = F.floor(s / 3600), F.pmod(F.floor(s / 60), F.lit(60)), F.pmod(s, F.lit(60))
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def short_time(seconds: Column) -> Column:
    """Floored seconds as m:ss, without hours; null for null."""
    s = F.floor(seconds)
    return F.when(s.isNotNull(), F.format_string("%d:%02d", F.floor(s / 60), F.pmod(s, F.lit(60))))


def size_label(n: Column) -> Column:
    """Bytes as kB, or MB with one decimal (halves to the even one) under 10 MB and none from there; empty for nothing."""
    mb = n / 1048576.0
    return F.when(F.coalesce(n, F.lit(0)) <= 0, "").when(n < 1048576, F.concat(F.greatest(F.lit(1), F.round(n / 1024.0).cast("long")).cast("string"), F.lit(" kB"))).when(mb < 10, F.format_string("%.1f MB", F.bround(mb, 1))).otherwise(F.concat(F.round(mb).cast("long").cast("string"), F.lit(" MB")))


def luhn_ok(ten: Column) -> Column:
    """Mod-10 check of a string of ten digits."""
    digit = lambda i: F.substr(ten, i + 1, F.lit(1)).cast("int")
    twice = lambda v: F.when(v > 9, v - 9).otherwise(v)
    total = F.aggregate(F.sequence(F.lit(0), F.lit(8)), F.lit(0), lambda s, i: s + twice(digit(i) * F.when(i % 2 == 0, 2).otherwise(1)))
    return F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10)) == digit(F.lit(9))


def titlecase(text: Column) -> Column:
    """Each part between blanks or hyphens begins with a capital; separators stay."""
    part = r"[^ \-]+|[ \-]+"
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"({part})")), lambda p: F.concat(F.upper(F.substr(p, F.lit(1), F.lit(1))), F.lower(F.substr(p, F.lit(2))))), "")


def initials_only(text: Column) -> Column:
    """Every part between blanks, dots or hyphens has one letter at most."""
    return F.forall(F.split(text, r"[ .\-]+"), lambda p: F.length(p) <= 1)


def whole_number(text: Column) -> Column:
    """A number written with blanks or no-break spaces between groups; null if it is none."""
    return F.try_to_number(F.nullif(F.translate(text, " \u00a0\u202f", ""), F.lit("")), F.lit("9999999999999")).cast("long")
