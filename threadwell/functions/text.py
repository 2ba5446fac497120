"""Scalar functions on columns: matching, formatting and path or address parts. All run inside the JVM."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters with marks and what they are searched as.
ACCENTS = ("áàâäãåāçćéèêëēíìîïīñóòôöõōøúùûüūýÿ", "aaaaaaacceeeeeiiiiinooooooouuuuuyy")


def ascii_lower(c: Column) -> Column:
    """Lower case of A-Z alone."""
    return F.translate(c, _UPPER, _LOWER)


def like(c: Column, pattern: str) -> Column:
    """LIKE that ignores the case of A-Z only; % and _ are wildcards and no character escapes them."""
    return F.like(ascii_lower(c), ascii_lower(F.lit(pattern)), F.lit("\u0001"))


def contains_like(c: Column, part: str) -> Column:
    """`like` anywhere in the text.

    Of several stretches between wildcards each is looked for once, at its first place after the one before: LIKE's own
    pattern goes back for all places of the first before it gives up.
    """
    runs = [r for r in part.translate(str.maketrans(_UPPER, _LOWER)).split("%") if r]
    if len(runs) < 2 or "\u0001" in part:
        return like(c, f"%{part}%")
    char = lambda x: "." if x == "_" else "\\" + x if x.isascii() and not x.isalnum() else x
    return F.rlike(ascii_lower(c), F.lit(r"(?s)\A" + "".join("(?>.*?" + "".join(map(char, r)) + ")" for r in runs)))


def fold(c: Column) -> Column:
    """Lower case without marks, as words are indexed. ASCII has no marks, and is not looked through for them."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(F.lower(c), *ACCENTS))


def terms(c: Column) -> Column:
    """Runs of letters and digits, folded."""
    return F.regexp_extract_all(fold(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_terms(query: str, noise: tuple[str, ...] = ()) -> list[str]:
    """Distinct terms of a query in order; punctuation and operators carry no meaning."""
    folded = query.lower().translate(str.maketrans(*ACCENTS))
    return [t for t in dict.fromkeys(re.findall(r"[^\W_]+", folded)) if t not in noise]


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


#: The escapes of JSON that have a name.
JSON_NAMES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def _ascii_string(c: Column) -> Column:
    """A string as JSON in ASCII; characters beyond the 16-bit plane become two escapes, as UTF-16 has them."""

    def escaped(x: Column) -> Column:
        units = F.lower(F.hex(F.encode(x, "UTF-16BE")))
        out = F.when(x.rlike("^[ -~]$") & ~x.isin('"', "\\"), x)
        for char, name in JSON_NAMES.items():
            out = out.when(x == char, F.lit(name))
        return out.otherwise(F.regexp_replace(units, "(.{4})", r"\\u$1"))

    whole = F.array_join(F.transform(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)), escaped), "")
    return F.concat(F.lit('"'), F.when(c.rlike(r"\A[ !#-\[\]-~]*\z"), c).otherwise(whole), F.lit('"'))


def ascii_json(c: Column) -> Column:
    """An array of strings as JSON text in ASCII, entries parted by a comma and a space; a null entry is null, a null
    array is null."""
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.coalesce(_ascii_string(x), F.lit("null"))), ", "), F.lit("]"))


def basename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def first_word(c: Column) -> Column:
    return F.split(strip(c), r"\s+")[0]


def decode_project(c: Column) -> Column:
    """A project folder's name as a path; hyphens within names are lost."""
    return F.translate(c, "-", "/")


def git_remote(url: Column) -> Column:
    """host-independent path of an scp-like or http(s) remote, lower-cased, without .git; else null."""
    scp = F.regexp_extract(url, r"^git@[^:]+:(.+?)(?:\.git)?$", 1)
    web = F.regexp_extract(url, r"^https?://[^/]+/(.+?)(?:\.git)?$", 1)
    return F.lower(F.coalesce(F.nullif(scp, F.lit("")), F.nullif(web, F.lit(""))))


def truncate(c: Column, n: int) -> Column:
    """At most n characters on one line: whole sentences past 0.6 n, else whole words past 0.8 n and dots."""
    flat = strip(F.replace(c, F.lit("\n"), F.lit(" ")))
    cut = F.substring(flat, 1, n)
    last = lambda what: F.length(cut) - F.instr(F.reverse(cut), what[::-1]) - len(what) + 1  # noqa: E731  index from 0
    dot = F.when(F.contains(cut, F.lit(". ")), last(". ")).otherwise(-1)
    space = F.when(F.contains(cut, F.lit(" ")), last(" ")).otherwise(-1)
    return (
        F.when(F.length(flat) <= n, flat)
        .when(dot > n * 0.6, cut.substr(F.lit(1), (dot + 1).cast("int")))
        .when(space > n * 0.8, F.concat(cut.substr(F.lit(1), space.cast("int")), F.lit("...")))
        .otherwise(F.concat(cut, F.lit("...")))
    )


def format_time(iso: Column) -> Column:
    """YYYY-MM-DD HH:MM in the value's own offset; a bad value as it is; empty for none."""
    text = F.coalesce(iso, F.lit(""))
    whole = F.when(F.length(text) == 10, F.concat(text, F.lit("T00:00"))).otherwise(text)
    shown = F.concat(F.substring(whole, 1, 10), F.lit(" "), F.substring(whole, 12, 5))
    good = text.rlike(r"^\d{4}-\d{2}-\d{2}") & F.try_to_timestamp(text).isNotNull()
    return F.when(good, shown).otherwise(text)


def format_duration(start: Column, end: Column) -> Column:
    """<1min, Nmin, Nh or NhMm between two ISO times; empty if either is bad."""
    minutes = F.floor((F.unix_timestamp(F.try_to_timestamp(end)) - F.unix_timestamp(F.try_to_timestamp(start))) / 60)
    hours, rest = F.floor(minutes / 60), minutes % 60
    return F.coalesce(
        F.when(minutes < 1, F.lit("<1min"))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("min")))
        .when(rest == 0, F.concat(hours.cast("string"), F.lit("h")))
        .otherwise(F.concat(hours.cast("string"), F.lit("h"), rest.cast("string"), F.lit("m"))),
        F.lit(""),
    )


def format_size(n: Column) -> Column:
    """Whole B, KB or MB."""
    div = lambda d: F.floor(n / d).cast("string")
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit("B"))).when(n < 1 << 20, F.concat(div(1024), F.lit("KB"))).otherwise(F.concat(div(1 << 20), F.lit("MB")))


def parse_date(text: str | None, now: datetime | None = None) -> str | None:
    """Nd, Nw or Nm (30 days) before now, a date as its midnight UTC, anything else as it is."""
    if not text:
        return text
    text = text.strip()
    now = now or datetime.now(UTC)
    if m := re.fullmatch(r"(\d+)([dwm])", text):
        return (now - timedelta(days=int(m[1]) * {"d": 1, "w": 7, "m": 30}[m[2]])).isoformat()
    return f"{text}T00:00:00+00:00" if len(text) == 10 else text


def token_count(c: Column) -> Column:
    """Default token counter: a token for each four characters, rounded up."""
    return F.ceil(F.length(c) / 4).cast("long")
