"""Text out of web pages, JSON and addresses, as Column expressions where the rules are regular, else Arrow UDFs."""

from __future__ import annotations

import io
import json
import re
import zipfile
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillon.functions.text import col, let, strip

#: Elements dropped with their bodies, elements that end a line, and named entities, in the order they are read.
DROPPED = ("script", "style", "noscript", "svg", "template")
BLOCKS = "p|div|li|tr|h[1-6]|section|article|blockquote|pre"
ENTITIES = (("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&quot;", '"'), ("(?i)&#0?39;|&apos;", "'"))
#: What a page's reading view leaves out, where it looks first, and what ends a line.
NOT_READ = frozenset("script style noscript svg nav footer header aside form iframe".split())
MAIN = ("article", "main")
LINE_ENDS = frozenset("p div br li tr h1 h2 h3 h4 h5 h6 section article blockquote pre".split())
#: Fixed value: levels of a JSON tree that are read.
DEPTH = 12


def _decoded(c: Column) -> Column:
    """Named entities, then numbered ones."""
    for pattern, value in ENTITIES:
        c = F.regexp_replace(c, pattern, value.replace("$", r"\$"))
    return let(c, _numbered)


def _numbered(c: Column) -> Column:
    """``&#n;`` and ``&#xh;`` to their characters, nothing for a number without one, in one reading: no result is read again."""
    numbered = r"&#(\d+);|&#[xX]([0-9a-fA-F]+);"

    def one(m: Column) -> Column:
        digits = F.regexp_replace(m, "^&#[xX]?0*|;$", "")
        code = F.when(F.lower(F.substring(m, 3, 1)) == "x", F.when(F.length(digits) <= 6, F.conv(digits, 16, 10))).otherwise(F.when(F.length(digits) <= 7, digits))
        wide = lambda n: F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(n), 8, "0"))), "UTF-32")  # noqa: E731  the mark keeps a mark's own number
        known = lambda n: F.when(n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF), wide(n)).otherwise("")
        return let(F.coalesce(F.when(digits != "", code), F.lit("0")).cast("long"), known)

    parts, met = F.split(c, numbered, -1), F.regexp_extract_all(c, F.lit(numbered), F.lit(0))
    joined = F.array_join(F.zip_with(parts, met, lambda p, m: F.concat(p, F.when(m.isNull(), "").otherwise(one(m)))), "")
    return F.when(F.contains(c, F.lit("&#")), joined).otherwise(c)


def html_text(c: Column | str) -> Column:
    """Markup to text by rule: comments and dropped elements go, block ends and line breaks end lines, tags are blanks."""
    out = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?s)<!--.*?-->", " ")
    for name in DROPPED:  # the earliest opening of any wins in the rule; one after the other differs only where they nest
        out = F.regexp_replace(out, rf"(?is)<{name}\b.*?</{name}\s*>", " ")
    out = F.regexp_replace(out, rf"(?i)</({BLOCKS})\s*>", "\n")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)<br\s*/?>", "\n"), r"<[^>]+>", " ")
    out = F.regexp_replace(_decoded(out), "[ \\t\u00a0]+", " ")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def html_title(c: Column | str) -> Column:
    """The shared title of a page, else its title element; 120 characters at most, empty where it has none."""
    page = F.coalesce(col(c), F.lit(""))
    shared = F.regexp_extract(page, r"""(?i)<meta[^>]+property=["']og:title["'][^>]+content=["']([^"']+)["']""", 1)
    own = F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.substring(strip(_decoded(F.when(shared != "", shared).otherwise(own))), 1, 120)


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.main: list[str] = []
        self.dropped = self.inside = 0

    def _put(self, text: str) -> None:
        if not self.dropped:
            self.parts.append(text)
            if self.inside:
                self.main.append(text)

    def handle_starttag(self, tag, attrs):
        if tag in NOT_READ:
            self.dropped += 1
        elif tag in MAIN or ("role", "main") in attrs:
            self.inside += 1
        if tag == "br":
            self._put("\n")

    def handle_startendtag(self, tag, attrs):
        if tag == "br":
            self._put("\n")

    def handle_endtag(self, tag):
        if tag in LINE_ENDS:
            self._put("\n")
        if tag in NOT_READ:
            self.dropped = max(0, self.dropped - 1)
        elif tag in MAIN:
            self.inside = max(0, self.inside - 1)

    def handle_data(self, data):
        self._put(data)


def read_html(page: str | None) -> str:
    """The reading view of a page: its main part where it has one."""
    reader = _Reader()
    reader.feed(page or "")
    reader.close()
    main = "".join(reader.main)
    return main if main.strip() else "".join(reader.parts)


@F.pandas_udf(StringType())
def html_reading_view(s: pd.Series) -> pd.Series:
    return s.map(read_html)


def flatten_json(text: str | None) -> str:
    """``path: value`` lines of a JSON document, or of each line that is one."""
    out: list[str] = []

    def walk(v, path: str, depth: int) -> None:
        if depth > DEPTH or v is None:
            return
        if isinstance(v, dict):
            for k, x in v.items():
                walk(x, f"{path}.{k}" if path else k, depth + 1)
        elif isinstance(v, list):
            for x in v:
                walk(x, path, depth + 1)
        else:
            said = ("true" if v else "false") if isinstance(v, bool) else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)
            if path or len(said) > 2:
                out.append(f"{path}: {said}" if path else said)

    try:
        walk(json.loads(text or ""), "", 0)
    except ValueError:
        for line in (text or "").split("\n"):
            try:
                walk(json.loads(line), "", 0)
            except ValueError:
                continue
    return "\n".join(out)


@F.pandas_udf(StringType())
def json_lines(s: pd.Series) -> pd.Series:
    return s.map(flatten_json)


def read_docx(data: bytes | None) -> str:
    """The paragraphs of a DOCX file; empty where it is none."""
    try:
        with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
            body = z.read("word/document.xml").decode("utf-8", "replace")
    except (zipfile.BadZipFile, KeyError):
        return ""
    bare = re.sub(r"<[^>]+>", "", body.replace("</w:p>", "\n"))
    for name, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        bare = bare.replace(name, value)
    return bare


@F.pandas_udf(StringType())
def docx_text(s: pd.Series) -> pd.Series:
    return s.map(read_docx)


def canonical_url(c: Column | str) -> Column:
    """The address with a scheme, or null where it is none that can be fetched."""
    t = strip(c)
    full = F.when(t.rlike("(?i)^https?://"), t).otherwise(F.concat(F.lit("https://"), t))
    good = full.rlike(r"(?i)^https?://[^\s/?#]+") & ~t.rlike(r"(?i)^[a-z][a-z0-9+.-]*:(?!//|\d)") & ~(t.rlike(r"(?i)^[a-z][a-z0-9+.-]*://") & ~t.rlike("(?i)^https?://"))
    return F.when(good, full)


def url_host(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(c), r"(?i)^https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))


def blocked_host(host: Column) -> Column:
    """Whether a host is never a public page: local names, private, loopback, link-local, shared and reserved addresses."""
    h = F.regexp_replace(F.lower(host), r"^\[|\]$", "")
    named = (h == "localhost") | h.rlike(r"\.(localhost|internal|local)$")
    four = h.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    a, b = (F.regexp_extract(h, r"^(\d+)\.(\d+)", i).try_cast("int") for i in (1, 2))
    private = a.isin(0, 10, 127) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127)) | (a >= 224)
    six = h.isin("::1", "::") | h.rlike("^f[cd][0-9a-f]{2}:|^fe[89ab][0-9a-f]:|^::ffff:")
    return F.when(named, True).when(four, private).otherwise(six)


def file_kind(name: Column) -> Column:
    """How a file is read, by its extension; unknown ones as text, unless they look binary."""
    kinds = (
        (r"(?i)\.pdf$", "pdf"),
        (r"(?i)\.docx$", "docx"),
        (r"(?i)\.(html?|xhtml)$", "html"),
        (r"(?i)\.jsonl?$", "json"),
        (r"(?i)\.(txt|md|markdown|csv|tsv|log|rst|org|tex|srt|vtt)$", "text"),
        (r"(?i)\.(ya?ml|toml|ini|xml|py|ts|tsx|js|jsx|go|rs|java|c|h|cpp|sh|sql)$", "code"),
    )
    out = F.lit("sniff")
    for pattern, kind in reversed(kinds):
        out = F.when(name.rlike(pattern), kind).otherwise(out)
    return out
