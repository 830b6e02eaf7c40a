"""Text functions as Column expressions; all run inside the JVM but for NFC, FNV, blake2b and partial JSON, which are Arrow UDFs."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillon.functions import constants as K

NOT_WORD = "[^\\p{L}\\p{N}\\p{M}‌‍\\s]"

#: All white space: control characters that part text, blanks, and Unicode's separators (class Z).
SPACE = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column | str) -> Column:
    """Without white space at either end, Unicode's included (Spark's trim takes blanks only)."""
    return F.btrim(col(c), F.lit(SPACE))


def raw_tokens(c: Column | str) -> Column:
    """Lower-cased tokens of two characters or more, in order."""
    return F.filter(F.split(F.regexp_replace(F.lower(col(c)), NOT_WORD, " "), r"\s+"), lambda t: F.length(t) > 1)


def is_stopword(t: Column) -> Column:
    """English function words, and Hindi and Marathi ones; each list has words of its own script only, so no script test is due."""
    return t.isin(K.STOP_EN + K.STOP_HI)


def content_tokens(c: Column | str) -> Column:
    """Tokens that aren't stop words, repeats kept; all tokens if nothing would be left."""
    return fallback(raw_tokens(c))


def fallback(raw: Column) -> Column:
    return let(raw, lambda r: let(F.filter(r, lambda t: ~is_stopword(t)), lambda kept: F.when(F.size(kept) > 0, kept).otherwise(r)))


def content_set(c: Column | str) -> Column:
    return F.array_distinct(content_tokens(c))


def overlap(query: Column, passage: Column) -> Column:
    """Share of the query's tokens that the passage has; 0 for no tokens."""
    return F.when(F.size(query) > 0, F.size(F.array_intersect(query, passage)) / F.size(query)).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def sentences(c: Column | str) -> Column:
    """Trimmed sentences; a cut follows a danda or . ! ? and white space."""
    return F.filter(F.transform(F.split(col(c), "(?<=[।.!?])\\s+"), strip), lambda s: s != "")


def sentence_pieces(c: Column | str) -> Column:
    """The text cut where white space follows a danda or . ! ?; a piece begins with that white space, so joined they are the text."""
    return F.split(col(c), "(?<=[।.!?])(?=\\s)")


def numeric_spans(c: Column | str) -> Column:
    return F.slice(F.regexp_extract_all(col(c), F.lit(K.NUMERIC), F.lit(0)), 1, 8)


def latin_runs(c: Column | str) -> Column:
    return F.array_distinct(F.slice(F.regexp_extract_all(col(c), F.lit(K.LATIN_RUN), F.lit(0)), 1, 8))


def normalise_space(c: Column | str) -> Column:
    """All Unicode white space to one blank, trimmed (after NFC, see ``nfc``)."""
    return F.trim(F.regexp_replace(col(c), "[\\s\\p{Z}\\x1c-\\x1f\\x85]+", " "))


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(c: Column | str) -> Column:
    """Composed characters. Python gets only texts with a character from U+0300 on: below it all are composed already."""
    return F.coalesce(_nfc(F.when(col(c).rlike(r"[^\x00-\u02FF]"), col(c))), col(c))


@F.arrow_udf(StringType())
def blake2b_hex(s: pa.Array, size: pa.Array) -> pa.Array:
    """Hashes of the texts' bytes as they lie in the batch, none of them made a Python string."""
    out = pa.array([None if not x.is_valid else hashlib.blake2b(x.as_buffer(), digest_size=n.as_py()).hexdigest() for x, n in zip(s, size, strict=True)], pa.string())
    pa.default_memory_pool().release_unused()
    return out


@F.pandas_udf(StringType())
def fnv1a64(s: pd.Series) -> pd.Series:
    """FNV-1a over UTF-8, 64 bits, as 16 hex digits."""

    def one(x):
        if x is None:
            return None
        h = 0xCBF29CE484222325
        for b in x.encode():
            h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
        return f"{h:016x}"

    return s.map(one)


def partial_json_value(text: str | None, key: str) -> str:
    """The value of string ``key`` in JSON that may break off anywhere; as much as is there, escapes read."""
    at = (text or "").find(f'"{key}"')
    if at < 0:
        return ""
    i = at + len(key) + 2
    while i < len(text) and text[i] in " \t\r\n:":
        i += 1
    if i >= len(text) or text[i] != '"':
        return ""
    i += 1
    end = i
    while end < len(text) and text[end] != '"':
        end += 2 if text[end] == "\\" else 1
    body = text[i : min(end, len(text))]
    while body:
        try:
            return json.loads(f'"{body}"', strict=False)
        except ValueError:  # an escape that breaks off
            body = body[: body.rfind("\\")] if "\\" in body[-6:] else body[:-1]
    return ""


def partial_json(c: Column | str, key: str) -> Column:
    @F.pandas_udf(StringType())
    def read(s: pd.Series) -> pd.Series:
        return s.map(lambda x: partial_json_value(x, key))

    return read(col(c))


def strip_thinking(c: Column | str) -> Column:
    return strip(F.regexp_replace(col(c), r"(?is)<(think|thinking|reasoning)>.*?</\1>", ""))


def char_entropy(c: Column | str) -> Column:
    """Shannon bits of a text's characters: one replacement for each distinct one."""

    def of(text: Column) -> Column:
        n = F.length(text)
        share = lambda x: (n - F.length(F.call_function("replace", text, x, F.lit("")))) / n
        bits = F.transform(F.array_distinct(F.split(text, "", -1)), lambda x: let(share(x), lambda p: F.when(p > 0, p * F.log2(p)).otherwise(0.0)))
        return F.when(n > 0, -F.aggregate(bits, F.lit(0.0), lambda a, b: a + b)).otherwise(0.0)

    return let(col(c), of)


def _by_script(c: Column, ranges: tuple[tuple[str, str], ...], then: Callable[[Column, Column], Column]) -> Column:
    """``then`` of the characters that aren't ASCII and of (n, i, name), the range with most of them, the earlier on a tie.

    A range's characters are taken out by runs and the next is counted in what is left, so that few characters are met often.
    Ranges must not overlap.
    """
    order = sorted(range(len(ranges)), key=lambda i: ranges[i][1])

    def count(other: Column, rest: Column, at: int, found: list[Column]) -> Column:
        if at == len(order):
            return let(F.array_max(F.array(*found)), lambda best: then(other, best))
        i = order[at]
        one = lambda left: F.struct((F.length(rest) - F.length(left)).alias("n"), F.lit(-i).alias("i"), F.lit(ranges[i][0]).alias("name"))
        return let(F.regexp_replace(rest, f"[{ranges[i][1]}]+", ""), lambda left: count(other, left, at + 1, [*found, one(left)]))

    return let(F.regexp_replace(c, r"[\x00-\x7F]+", ""), lambda other: count(other, other, 0, []))


def dominant_script(c: Column | str) -> Column:
    """The script with most characters, the earlier on a tie, ``unknown`` if there is none."""

    def of(text: Column) -> Column:
        plain = F.when(text.rlike("[A-Za-z]"), "latin").otherwise("unknown")
        latin = F.length(text) - F.length(F.regexp_replace(text, r"\p{Alpha}+", ""))  # counted only where it can matter

        def then(other: Column, best: Column) -> Column:
            fewer = F.length(text) - F.length(other) < best["n"]  # all of ASCII
            return F.when(F.coalesce(best["n"], F.lit(0)) == 0, plain).when(fewer, best["name"]).when(latin >= best["n"], "latin").otherwise(best["name"])

        return F.when(F.octet_length(text) == F.length(text), plain).otherwise(_by_script(text, K.SCRIPTS[1:], then))

    return let(col(c), of)


_DIGITS_FROM = "".join(chr(z + i) for z in K.DIGIT_ZEROS for i in range(10))
_DIGITS_TO = "0123456789" * len(K.DIGIT_ZEROS)


def normalise_digits(c: Column | str) -> Column:
    return F.translate(col(c), _DIGITS_FROM, _DIGITS_TO)


def specifics(c: Column | str) -> Column:
    """Numbers, and capitalised words that don't begin a sentence; lower-cased, distinct, in order."""

    def of_sentence(s: Column) -> Column:
        words = F.filter(F.split(F.trim(s), r"\s+"), lambda w: w != "")
        tagged = F.transform(words, lambda w, i: F.struct(i.alias("i"), F.regexp_replace(w, r"[^\p{L}\p{N}\p{M}]", "").alias("w")))
        first = lambda x: F.substring(x["w"], 1, 1)
        kept = F.filter(tagged, lambda x: (F.length(x["w"]) >= 2) & (x["w"].rlike(r"\p{N}") | ((x["i"] > 0) & (first(x) != F.lower(first(x))))))
        return F.transform(kept, lambda x: F.lower(x["w"]))

    return F.array_distinct(F.flatten(F.transform(F.split(col(c), "(?<=[।.!?])\\s+"), of_sentence)))


def estimate_tokens(c: Column | str) -> Column:
    """ceil(ASCII characters / 4 + others / 2)."""
    other = F.length(F.regexp_replace(col(c), r"[\x00-\x7F]", ""))
    return F.ceil((F.length(col(c)) - other) / 4 + other / 2).cast("long")


def clamp_query(c: Column | str, most: int = 320) -> Column:
    """At most ``most`` characters, cut at the last blank if that is past 60 % of them."""
    cut = F.substring(col(c), 1, most)
    last = F.length(cut) - F.instr(F.reverse(cut), " ")
    at = F.when((F.instr(cut, " ") > 0) & (last > most * 0.6), strip(F.substring(cut, F.lit(1), last))).otherwise(strip(cut))
    return F.when(F.length(col(c)) <= most, col(c)).otherwise(at)


def _query_words(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\p{M}\s]", " "), r"\s+"), lambda w: w != "")


_MARKERS = sorted({*K.SCAFFOLD, *(w for w in K.ROMANISED if w not in K.AMBIGUOUS)})


def is_romanised_hindi(c: Column | str) -> Column:
    """Latin letters, and at least 30 % unambiguous markers."""
    words = _query_words(col(c))
    share = F.size(F.filter(words, lambda w: w.isin(_MARKERS))) / F.size(words)
    return col(c).rlike("(?i)[a-z]") & F.coalesce(F.when(F.size(words) > 0, share) >= 0.3, F.lit(False))


def fold_romanised(c: Column | str) -> Column:
    """Markers to Devanagari, request words dropped; unchanged if it isn't romanised Hindi or nothing is left."""
    table = F.create_map(*[F.lit(x) for pair in K.ROMANISED.items() for x in pair])
    kept = F.filter(_query_words(col(c)), lambda w: ~w.isin(K.SCAFFOLD))
    folded = F.array_join(F.transform(kept, lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")
    return F.when(is_romanised_hindi(c) & (folded != ""), folded).otherwise(col(c))


def first_line_title(c: Column | str) -> Column:
    """The first line with text, # signs stripped, 64 characters at most."""
    line = F.get(F.filter(F.transform(F.split(col(c), "\n"), strip), lambda x: x != ""), F.lit(0))
    bare = F.regexp_replace(F.coalesce(line, F.lit("Pasted text")), r"^#+\s*", "")
    return F.when(F.length(bare) > 64, F.concat(F.substring(bare, 1, 61), F.lit("..."))).otherwise(bare)


def script_language(c: Column | str) -> Column:
    """The language a text is read out in: that of the script with most characters, ``en`` where none has three."""
    said = lambda _, best: F.when(best["n"] >= 3, best["name"]).otherwise("en")
    return let(col(c), lambda text: F.when(F.octet_length(text) == F.length(text), "en").otherwise(_by_script(text, K.SPOKEN, said)))


def heading_of(c: Column | str) -> Column:
    """The heading that a line is, or null: after # signs, or short without a full stop and in capitals or numbered."""

    def of(t: Column) -> Column:
        of_letters = lambda x: (F.length(x) >= 3) & (x == F.upper(x)) & x.rlike("[A-Z]")
        capitals = let(F.regexp_replace(t, r"[^\p{L}]+", ""), of_letters)
        short = (t != "") & (F.length(t) <= 80) & ~t.rlike(r"[.!?।]$") & (t.rlike(r"^\d+(\.\d+)*\s+\S") | capitals)
        unmarked = F.when(short, t)
        return F.when(F.startswith(t, F.lit("#")), let(F.regexp_extract(t, r"^#{1,6}\s+(.{1,90})$", 1), lambda m: F.when(m != "", strip(m)).otherwise(unmarked))).otherwise(unmarked)

    return let(strip(c), of)


def ingest_normalise(c: Column | str, most: int = 600_000) -> Column:
    """Line ends to \\n, hard blanks to blanks, lines wrapped inside a sentence joined, blanks and empty lines collapsed, clamped."""
    out = F.regexp_replace(col(c), r"\r\n?", "\n")
    out = F.regexp_replace(out, "\u00a0", " ")
    out = F.regexp_replace(out, r"([^\n।.!?:;])\n(?!\n)", "$1 ")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    return F.substring(strip(F.regexp_replace(out, r"\n{3,}", "\n\n")), 1, most)


def binary_share(c: Column | str, sample: int = 4000) -> Column:
    """Share of replacement and control characters (tab to carriage return excepted) in the first ``sample``."""
    head = F.substring(col(c), 1, sample)
    return F.regexp_count(head, F.lit("[\\x00-\\x08\\x0e-\\x1f\ufffd]")) / F.greatest(F.length(head), F.lit(1))


def prompt(query: Column, sources: Column, most: int = 5) -> Column:
    """The prompt of a generated answer: ``sources`` array<struct<title, text>>, at most five of 4,000 characters, and the query of 1,000."""
    listed = F.transform(F.slice(sources, 1, most), lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.substring(F.regexp_replace(F.coalesce(s["title"], F.lit("")), '[<>"]', ""), 1, 120), F.lit("\n"), F.substring(F.coalesce(s["text"], F.lit("")), 1, 4000)))
    return F.concat(F.array_join(listed, "\n\n"), F.lit("\n\n"), F.substring(query, 1, 1000))


def mean_pool(vectors: Column, mask: Column) -> Column:
    """The mean of the token vectors whose mask is 1; zeros where there is none."""
    kept = F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] == 1)
    n = F.greatest(F.size(kept), F.lit(1))
    width = F.coalesce(F.size(F.try_element_at(vectors, F.lit(1))), F.lit(0))
    return F.transform(F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>")), lambda j: F.aggregate(kept, F.lit(0.0), lambda a, x: a + F.get(x["v"], j).cast("double")) / n)
