"""Text functions as Spark column expressions."""

from __future__ import annotations

import html
import unicodedata as ud
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MARKS = "[̀-ͯ]"
#: Index tokens are runs of letters and digits; query tokens also hold underscores.
INDEX_TOKEN = r"[\p{L}\p{N}\p{Co}]+"
QUERY_TOKEN = r"[\p{L}\p{N}\p{M}_]+"
SENTENCE_END = r"(?<=[.!?…])\s+"
#: Words that the toy tokenizer leaves out.
STOPWORDS = "a an and are as at be but by do does for from how i in is it of on or that the this to was were what when where which who will with you your".split()


@cache
def _fold_table() -> tuple[str, str]:
    """Letters whose accents can be dropped one for one, from the Unicode database."""
    pairs = {"đ": "d"}
    for code in range(0xA0, 0x2000):
        ch = chr(code)
        if ch == ch.lower():
            bare = "".join(x for x in ud.normalize("NFD", ch) if not "̀" <= x <= "ͯ")
            if len(bare) == 1 and bare != ch and not 0x300 <= code <= 0x36F:
                pairs[ch] = bare
    return "".join(pairs), "".join(pairs.values())


def fold(text: Column) -> Column:
    """Lower case without accents. Texts of ASCII characters only have none to drop."""
    source, target = _fold_table()
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.regexp_replace(F.translate(F.lower(text), source, target), MARKS, ""))


def index_tokens(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(INDEX_TOKEN), F.lit(0))


def token_text(text: Column) -> Column:
    """The tokens of index_tokens with spaces between them; a text of ASCII characters only as it is, since its tokens are runs of letters and digits, whatever their case."""
    ascii_only = F.is_valid_utf8(text) & (F.octet_length(text) == F.length(text))
    return F.when(ascii_only, text).otherwise(F.regexp_replace(fold(text), INDEX_TOKEN.replace("[", "[^", 1), " "))


def query_tokens(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(QUERY_TOKEN), F.lit(0))


def plain_tokens(text: Column) -> Column:
    """Lower-case words split at spaces, without punctuation at their ends and without stopwords."""
    edge = r"^[.,;:!?()\[\]{}`'\"#*_-]+|[.,;:!?()\[\]{}`'\"#*_-]+$"
    words = F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, edge, ""))
    return F.filter(words, lambda w: (w != "") & ~w.isin(STOPWORDS))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE_END), lambda x: F.trim(x)), lambda s: s != "")


def front_matter(text: Column) -> Column:
    """Keys and values of the front matter that opens a text, as a map; values unquoted and cut at 100 characters. A repeated key keeps its last value."""
    block = F.regexp_extract(text, r"\A---\n((?:[^\n]*\n)*?)---(?:\n|\z)", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^\s*[A-Za-z0-9_-]+\s*:\s*\S"))
    pair = lambda x: F.struct(
        F.lower(F.regexp_extract(x, r"^\s*([A-Za-z0-9_-]+)\s*:", 1)).alias("key"),
        F.substring(F.regexp_replace(F.trim(F.regexp_extract(x, r":(.*)$", 1)), "^[\"']+|[\"']+$", ""), 1, 100).alias("value"),
    )
    pairs = F.transform(lines, pair)
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def without_front_matter(text: Column) -> Column:
    return F.regexp_replace(text, r"\A---\n(?:[^\n]*\n)*?---(?:\n|\z)", "")


#: Fixed value: tags whose end ends a line.
BLOCK_TAGS = "p|div|li|tr|h[1-6]|table|ul|ol|blockquote|pre|code"


def html_to_text(page: Column, strip_scripts: bool = False) -> Column:
    """Text of HTML: breaks and closing block tags end lines, other tags go, entities are decoded, blank runs collapse."""
    x = F.regexp_replace(page, r"(?is)<(script|style)\b.*?</\1\s*>", "") if strip_scripts else page
    x = F.regexp_replace(x, rf"(?i)<br\s*/?>|</(?:{BLOCK_TAGS})\s*>", "\n")
    x = F.regexp_replace(x, r"<[^>]+>", "")
    x = unescape(x)
    x = F.array_join(F.transform(F.split(x, "\n"), lambda x: F.trim(x)), "\n")
    return F.trim(F.regexp_replace(F.btrim(x, F.lit("\n ")), r"\n{3,}", "\n\n"))


#: Named entities that are decoded without leaving the JVM.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": "\u00a0", "&amp;": "&"}


def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def unescape(text: Column) -> Column:
    """Text with its character references decoded, named and numeric ones. Texts with the usual few only stay in the JVM."""
    usual = "|".join(ENTITIES)
    rare = text.rlike(rf"&(?!(?:{usual.replace('&', '')}))#?[0-9A-Za-z]+")
    plain = text
    for k, v in ENTITIES.items():  # &amp; comes last
        plain = F.replace(plain, F.lit(k), F.lit(v))
    return F.when(rare, F.pandas_udf(_unescape, "string")(F.when(rare, text))).otherwise(plain)


def page_title(page: Column) -> Column:
    return F.trim(unescape(F.regexp_extract(page, r"(?is)<title[^>]*>\s*(.*?)\s*</title>", 1)))


def page_links(page: Column) -> Column:
    return F.regexp_extract_all(page, F.lit(r"""(?i)<a\b[^>]*\bhref\s*=\s*["']([^"']+)["']"""), F.lit(1))


def web_path(url: Column) -> Column:
    """Document path of a web page: host and path; the query string is left out."""
    return F.concat(F.lit("web://"), F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://([^/?#]*)([^?#]*)", 1), F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://([^/?#]*)([^?#]*)", 2))


def extension(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(F.instr(F.substring(name, 2, 4096), ".") > 0, F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("")


def snippet(text: Column, most: int = 160) -> Column:
    one = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(one) > most, F.concat(F.substring(one, 1, most - 1), F.lit("…"))).otherwise(one)


def slug(text: Column, most: int = 48) -> Column:
    return F.regexp_replace(F.substring(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), 1, most), "^-+|-+$", "")


def citation_refs(answer: Column) -> Column:
    return F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,6})\]"), F.lit(1)), lambda x: x.cast("int"))


def citations_valid(answer: Column, count: Column) -> Column:
    """True where an answer cites at least one passage and only passages 1..count."""
    refs = citation_refs(answer)
    return (F.size(refs) > 0) & F.forall(refs, lambda r: (r >= 1) & (r <= count))


def llm_json(text: Column, schema: str) -> Column:
    """The JSON object in the prose of a model's answer, null where there is none."""
    return F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), schema)


def literal_regex(text: str) -> str:
    """A Java pattern that matches just this text."""
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def json_map(text: Column) -> Column:
    """A JSON object of strings as a map; empty for null and for what is no such object."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def _last_index(text: Column, part: str) -> Column:
    """Place of the last occurrence, from 0; -1 without."""
    at = F.instr(F.reverse(text), part[::-1])
    return F.when(at > 0, F.length(text) - at - len(part) + 1).otherwise(-1)


def clip(text: Column, limit: int) -> Column:
    """A text cut at the last sentence or line end within the limit, if that keeps half of it, else at the last space, else at the limit."""
    window = F.substring(text, 1, limit)
    end = F.greatest(*[_last_index(window, p) for p in (". ", "! ", "? ", "\n")])
    cut = F.when(end < limit // 2, _last_index(window, " ")).otherwise(end)
    return F.when(F.length(text) <= limit, text).when(cut <= 0, window).otherwise(F.regexp_replace(F.substring(window, F.lit(1), cut + 1), r"(?U)\s+$", ""))


#: Words that ask for a picture.
DIAGRAM_WORDS = ("diagram", "flowchart", "flow chart", "sequence diagram", "architecture diagram", "draw", "chart", "graph", "sơ đồ", "biểu đồ", "vẽ")


def wants_diagram(question: Column) -> Column:
    """A question asks for a picture: one of the words stands in it, alone or in the plural."""
    return F.lower(question).rlike(r"(?U)\b(?:" + "|".join(DIAGRAM_WORDS) + r")s?\b")


def glob_regex(pattern: str) -> str:
    """The regular expression of a shell pattern."""
    import fnmatch

    return fnmatch.translate(pattern).replace(r"\Z", r"\z")


def matches_any(path: Column, patterns: list[str]) -> Column:
    """A path, or its last part, matches one of the shell patterns."""
    name = F.element_at(F.split(path, "/"), -1)
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike("^" + glob_regex(p)) | name.rlike("^" + glob_regex(p))
    return out


def embed_key(embedder: str, dim: int, text: Column) -> Column:
    return F.sha1(F.concat_ws("|", F.lit(embedder), F.lit(str(dim)), text).cast("binary"))


def answer_key(fingerprint: Column, question: Column) -> Column:
    return F.sha2(F.concat_ws("|", fingerprint, F.lower(F.trim(question))).cast("binary"), 256)
