"""Text functions as Column builders."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache
from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What outer white space is, after folding.
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u1680\u2028\u2029"
HANGUL = range(0xAC00, 0xD7A4)
#: Common signs that fold to themselves.
OFTEN = "‘’“”„«»–—•¿¡°€"


def fold_text(text: str | None) -> str:
    """Compatibility decomposition, no combining marks, case folded, outer white space gone."""
    if not text:
        return ""
    plain = text if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return plain.casefold().strip()


@F.pandas_udf(StringType())
def fold_exact(texts: pd.Series) -> pd.Series:
    """Folding as a vectorised function."""
    return texts.map(fold_text, na_action=None)


@lru_cache(maxsize=1)
def fold_table() -> tuple[str, str, dict[str, str]]:
    """How characters fold, from the Unicode data of Python: those that become one other, followed by those that vanish;
    what the first become; and what those become that turn into several."""
    one, gone, several = {}, [], {}
    for k in chain(range(0xD800), range(0xE000, sys.maxunicode + 1)):
        c = chr(k)
        if k in HANGUL or c.isspace() and c.isascii():
            continue
        new = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).casefold()
        if len(new) > 1:
            several[c] = new
        elif not new:
            gone.append(c)
        elif new != c:
            one[c] = new
    return "".join(one) + "".join(gone), "".join(one.values()), several


def _jamo(c: Column) -> Column:
    """The letters that a Hangul syllable is made of."""
    s = F.ascii(c) - HANGUL.start
    first, vowel, last = (F.split(F.lit("".join(map(chr, range(start, start + n)))), "") for start, n in ((0x1100, 19), (0x1161, 21), (0x11A7, 28)))
    return F.concat(first[F.floor(s / 588).cast("int")], vowel[F.floor(s % 588 / 28).cast("int")], F.when(s % 28 > 0, last[s % 28]).otherwise(F.lit("")))


def bound_once(value: Column, use) -> Column:
    """``use(value)``, with the value computed once however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _taken_apart(text: Column) -> Column:
    """Characters that fold to several, replaced: each distinct one by one replacement, syllables sign by sign."""
    several = fold_table()[2]
    signs, becomes = "".join(several), F.split(F.lit("\n".join(several.values())), "\n")
    is_hangul = lambda c: (c >= chr(HANGUL.start)) & (c <= chr(HANGUL.stop - 1))
    each = lambda t: F.array_join(F.transform(F.split(t, ""), lambda c: F.when(is_hangul(c), _jamo(c)).otherwise(c)), "")
    known = F.translate(F.regexp_replace(text, r"[\x00-\x7F]+", ""), OFTEN, "")

    def replaced(found: Column) -> Column:
        whole = F.aggregate(F.filter(found, lambda c: F.translate(c, signs, "") == ""), text, lambda t, c: F.replace(t, c, F.get(becomes, F.instr(F.lit(signs), c) - 1)))
        return F.when(F.exists(found, is_hangul), each(whole)).otherwise(whole)

    return bound_once(known, lambda k: F.when(k == "", text).otherwise(bound_once(F.array_distinct(F.split(k, "")), replaced)))


def fold_signs(text: Column) -> Column:
    """``fold`` without its last step: outer white space stays."""
    signs, plain, _ = fold_table()
    ascii_only = lambda t: F.octet_length(t) == F.length(t)
    other = lambda t: bound_once(F.translate(t, signs, plain), lambda x: F.when(ascii_only(x), x).otherwise(_taken_apart(x)))
    return bound_once(F.coalesce(text, F.lit("")), lambda t: F.when(ascii_only(t), F.lower(t)).otherwise(other(t)))


def stripped(text: Column) -> Column:
    """Without outer white space."""
    return F.btrim(text, F.lit(SPACE))


def fold(text: Column) -> Column:
    """``fold_text`` in the JVM. ASCII is lower-cased; of other texts all characters that become one or none are
    translated at once, and only what then still isn't ASCII is looked at for characters that become several."""
    return stripped(fold_signs(text))


def collapse(text: Column) -> Column:
    """White space of each line to one blank, lines without content gone."""
    blanks = F.regexp_replace(text, r"[ \t\r\f\x0B]+", " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(blanks, r"(?m)^ | $", ""), r"\n{2,}", "\n"), r"^\n|\n$", "")


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def truncate(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut at the last blank if that lies past 60 % of them, with an ellipsis."""
    head = F.substring(text, 1, limit)
    blank = F.length(head) - F.locate(" ", F.reverse(head))  # index from 0 of the last blank; length if none
    has = F.locate(" ", head) > 0
    cut = F.when(has & (blank > limit * 0.6), F.substring(head, F.lit(1), blank)).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(cut, r"[ ,;:.\-]+$", ""), F.lit("…")))


def count_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def slug(text: Column, limit: int = 60, default: str = "item") -> Column:
    """Lower-case ASCII letters and digits with single dashes."""
    dashed = F.regexp_replace(F.regexp_replace(fold(text), r"[^\x00-\x7F]", ""), r"[^a-z0-9]+", "-")
    short = F.regexp_replace(F.substring(F.regexp_replace(dashed, r"^-+|-+$", ""), 1, limit), r"-+$", "")
    return F.when(short == "", F.lit(default)).otherwise(short)


def tag_name(text: Column) -> Column:
    """A tag for notes: no leading hash signs, blanks and other signs as dashes."""
    bare = F.regexp_replace(F.trim(text), r"^#+", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\s+", "-"), r"(?U)[^\w\-/]", "-")


#: What a text ends with when more of it stands behind a link.
MORE = (
    "…", "...", "[…]", "[...]", "(…)", "(...)", "read more", "read the rest", "continue reading", "keep reading", "seguir leyendo", "leer más", "leer mas", "ver más", "ver mas",
    "continuar leyendo", "artículo completo", "articulo completo", "lire la suite", "weiterlesen", "leia mais",
)


def is_truncated(text: Column, tail: int = 80) -> Column:
    """Does the folded end of a text announce more?"""
    end = F.regexp_replace(F.lower(F.right(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+$", ""), F.lit(tail))), r"[\s»>]+$", "")
    out = F.lit(False)
    for mark in MORE:
        out = out | F.endswith(end, F.lit(mark))
    return out


def needs_full_text(url: Column, text: Column, forced: Column, least: int = 800) -> Column:
    """A link, and a reason to follow it: asked for, no text, little text, or a cut text."""
    has = F.coalesce(url, F.lit("")) != ""
    body = F.coalesce(text, F.lit(""))
    return has & (forced | (F.trim(body) == "") | (F.length(body) < least) | is_truncated(body))


def encoded_header(text: Column) -> Column:
    """A mail header value: as it is if ASCII, else base64 of its UTF-8 bytes."""
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), text).otherwise(F.concat(F.lit("=?UTF-8?B?"), F.regexp_replace(F.base64(F.encode(text, "UTF-8")), r"\s", ""), F.lit("?=")))


def file_stem(text: Column, limit: int = 200, default: str = "untitled") -> Column:
    """A file name without path signs, quotes, control characters or outer dots; cut by bytes at ``limit``."""
    x = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\"'`\x00-\x1F\x7F<>]", "")
    x = F.regexp_replace(F.regexp_replace(x, r"[/\\:*?|#^\[\]]", "-"), r"\s+", " ")
    x = F.regexp_replace(x, r"^[ .\-]+|[ .\-]+$", "")
    for _ in range(2):  # a character has four bytes at most: first by characters, then by the share of its bytes
        x = F.when(F.octet_length(x) > limit, F.substring(x, F.lit(1), F.greatest(F.lit(1), F.floor(F.length(x) * limit / F.octet_length(x)) - 1).cast("int"))).otherwise(x)
    x = F.regexp_replace(x, r"[ .\-]+$", "")
    return F.when(x == "", F.lit(default)).otherwise(x)


def display_title(custom: Column, title: Column, url: Column) -> Column:
    return F.coalesce(F.nullif(custom, F.lit("")), F.nullif(title, F.lit("")), url)


def meta_line(*parts: Column) -> Column:
    """Parts joined by a middle dot; empty ones leave no separator."""
    return F.concat_ws(" · ", *(F.nullif(p, F.lit("")) for p in parts))


def iso_time(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_date(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def long_date(ms: Column, months: list[str]) -> Column:
    """Day, name of the month, year; the twelve names are a language's."""
    at = F.timestamp_millis(ms)
    return F.concat_ws(" ", F.dayofmonth(at).cast("string"), F.element_at(F.array(*map(F.lit, months)), F.month(at)), F.year(at).cast("string"))


def reading_minutes(words: Column, per_minute: int = 220) -> Column:
    """Whole minutes, rounded up; none for no words."""
    return F.when(words <= 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil(words / per_minute))).cast("long")


def number_or_length(text: Column) -> Column:
    """The left side of a greater/less comparison: the number that the whole text is, else its length."""
    bare = F.trim(text)
    return F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), bare.try_cast("double")).otherwise(F.length(text).cast("double"))


def error_text(kind: Column, message: Column, own: tuple[str, ...] = ("ValueError",)) -> Column:
    """What is kept and shown of a failure: the message alone if its kind is one that words messages for users, else the kind before
    it; the kind alone without a message."""
    said = F.trim(F.coalesce(message, F.lit("")))
    return F.when(said == "", kind).when(kind.isin(*own), said).otherwise(F.concat(kind, F.lit(": "), said))
