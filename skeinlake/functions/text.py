"""Text functions as Column expressions; pandas UDFs only where markup has to be parsed."""

from __future__ import annotations

from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

#: Words that are no terms.
STOP_WORDS = """
the a an and or but in on at to for of with by from is are was were be been being have has had do does did will would
could should may might must can this that these those it its they them their i you he she we me him her us my your his our
what when where who why how if then else than so as not no yes
""".split()

#: Tags and attributes that displayed markup may keep.
KEPT_TAGS = "a b blockquote br code del em i li ol p pre s span strong u ul".split()
KEPT_ATTRIBUTES = "class href title id data-board".split()
#: Elements that are dropped with their content.
DROPPED = "script style iframe object embed form svg".split()


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c computed once: an expression that a lambda refers to is otherwise computed for each element."""
    return F.transform(F.array(c), f)[0]


def strip_html(c: Column) -> Column:
    """Tags are deleted, without a blank in their place; so is an unterminated tag at the end."""
    return F.regexp_replace(F.regexp_replace(c, "<[^>]*(>|$)", ""), ">", "")


def words(c: Column) -> Column:
    """Lower-case runs of letters and digits, for full-text search; tags are blanks."""
    return F.filter(F.split(F.lower(F.regexp_replace(c, "<[^>]+>", " ")), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def extract_terms(c: Column, stop: list[str] | None = None) -> Column:
    """Terms for trends: ASCII words of three characters or more that aren't stop words, in order, repeated."""
    stop_words = F.array(*map(F.lit, STOP_WORDS if stop is None else stop))
    return F.filter(F.split(F.lower(strip_html(c)), "[^a-z0-9]+"), lambda w: (F.length(w) >= 3) & ~F.array_contains(stop_words, w))


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def canonicalize(c: Column) -> Column:
    """Lower case, no closing punctuation, single blanks: texts that differ in no more are one canonical text."""
    return collapse(F.regexp_replace(F.trim(F.lower(c)), r"[.!?,;:]+\z", ""))


def without_quotes(c: Column) -> Column:
    """Readable text without references to posts."""
    return collapse(F.regexp_replace(c, r">>(/[A-Za-z0-9_]+/)?\d+", " "))


#: How comments refer to posts, three arrows with a board's code, or two or three before a number.
_ARROW = "(?:>|&gt;)"
CROSS_BOARD = _ARROW + r"{3}\s*/?\s*([\w+-]+)/\s*([0-9]+)"
SAME_BOARD = _ARROW + r"{2,3}\s*([0-9]+)"


def extract_quotes(c: Column) -> Column:
    """array<struct<board, post_id>>: references to other boards, then to the own one (''), each in order, repeats kept."""
    boards, numbers = F.regexp_extract_all(c, F.lit(CROSS_BOARD), 1), F.regexp_extract_all(c, F.lit(CROSS_BOARD), 2)
    cross = F.zip_with(boards, numbers, lambda b, n: F.struct(b.alias("board"), n.alias("post_id")))
    rest = F.regexp_extract_all(F.regexp_replace(c, CROSS_BOARD, ""), F.lit(SAME_BOARD), 1)
    return F.concat(cross, F.transform(rest, lambda n: F.struct(F.lit("").alias("board"), n.alias("post_id"))))


def is_sage(c: Column) -> Column:
    return F.lower(F.trim(c)) == "sage"


def has_greentext(c: Column) -> Column:
    """Whether a line starts with a single arrow."""
    return F.exists(F.split(F.replace(c, F.lit("&gt;"), F.lit(">")), "\n"), lambda l: F.trim(l).rlike("^>(?!>)"))


def excerpt(c: Column, length: int = 200) -> Column:
    """The first ``length`` characters, with a mark if there are more."""
    return F.when(F.length(c) > length, F.concat(F.substring(c, 1, length), F.lit("…"))).otherwise(c)


def safe_url(c: Column) -> Column:
    """False for blank addresses and schemes that could run something; images as data are allowed."""
    u = F.lower(F.trim(c))
    bad = u.rlike("^(javascript:|vbscript:)") | (u.startswith("data:") & ~u.startswith("data:image/"))
    return (u != "") & ~bad


def tagless(c: Column) -> Column:
    """Lower-cased text with blanks for tags, single blanks: what n-grams are taken from."""
    return collapse(F.lower(F.regexp_replace(c, "<[^>]+>", " ")))


def char_ngrams(c: Column, low: int = 3, high: int = 5) -> Column:
    """All character n-grams of lower-cased tag-free text that hold a letter or digit of ASCII, repeats kept."""

    def grams(t: Column, n: int) -> Column:
        at = F.when(F.length(t) >= n, F.sequence(F.lit(1), F.length(t) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.substring(t, i, F.lit(n)))

    clean = collapse(F.lower(F.regexp_replace(c, "<[^>]+>", " ")))
    return let(clean, lambda t: F.filter(F.concat(*(grams(t, n) for n in range(low, high + 1))), lambda g: g.rlike("[a-z0-9]")))


def word_ngrams(c: Column, high: int = 3) -> Column:
    """All runs of one to ``high`` words, joined by a blank, of three characters or more."""

    def grams(w: Column, n: int) -> Column:
        at = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))

    split = F.filter(F.split(collapse(F.lower(F.regexp_replace(c, "<[^>]+>", " "))), " "), lambda x: x != "")
    return let(split, lambda w: F.filter(F.concat(*(grams(w, n) for n in range(1, high + 1))), lambda g: F.length(g) >= 3))


def levenshtein_bytes(a: Column, b: Column) -> Column:
    """Edit distance of the UTF-8 bytes."""
    byte = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    return F.levenshtein(byte(a), byte(b))


def title_similarity(a: Column, b: Column) -> Column:
    """0 for a blank title, 1 for equal ones, the ratio of lengths for a prefix, else one less the relative edit distance.

    Lengths and distances are of UTF-8 bytes.
    """
    x, y = (F.regexp_replace(F.lower(c), r"(?U)^\s+|\s+$", "") for c in (a, b))
    short, long_ = F.least(F.octet_length(x), F.octet_length(y)), F.greatest(F.octet_length(x), F.octet_length(y))
    return (
        F.when(a.isNull() | b.isNull() | (x == "") | (y == ""), 0.0)
        .when(x == y, 1.0)
        .when(x.startswith(y) | y.startswith(x), short / long_)
        .otherwise(1 - levenshtein_bytes(x, y) / long_)
    )


def text_similarity(a: Column, b: Column) -> Column:
    """How many words of b, repeats counted, occur in a, over the longer text's number of words."""
    split = lambda c: F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda w: w != "")

    def ratio(p: Column) -> Column:
        x, y = p["x"], p["y"]
        both = F.size(F.filter(y, lambda w: F.array_contains(x, w)))
        return F.when((F.size(x) > 0) & (F.size(y) > 0), both / F.greatest(F.size(x), F.size(y)))

    return F.coalesce(let(F.struct(split(a).alias("x"), split(b).alias("y")), ratio), F.lit(0.0))


def pretokenize(c: Column) -> Column:
    """Words for a word-piece model: punctuation and each ideograph or syllable block are tokens of their own."""
    return F.regexp_extract_all(c, F.lit(r"([\p{IsHan}\p{IsHangul}\p{IsHiragana}\p{IsKatakana}]|[\p{P}\p{S}]|[^\s\p{Cntrl}\p{P}\p{S}\p{IsHan}\p{IsHangul}\p{IsHiragana}\p{IsKatakana}]+)"), 1)


def file_size(number: Column, unit: Column) -> Column:
    """Bytes of a size such as 1,024.5 with KB, MB or GB; 0 if it is no number."""
    u = F.upper(F.trim(unit))
    factor = F.when(u == "KB", 1024.0).when(u == "MB", 1024.0**2).when(u == "GB", 1024.0**3).otherwise(1.0)
    digits = F.regexp_extract(F.regexp_replace(number, ",", ""), r"^\s*(\d+\.?\d*)\s*$", 1)
    return F.when(digits != "", digits.cast("double") * factor).otherwise(0.0)


class _Text(HTMLParser):
    """Text with line ends for block tags. Content of scripts and styles is text as well."""

    CDATA_CONTENT_ELEMENTS = ()

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "p", "div", "blockquote", "li"):
            self.out.append("\n")

    def handle_data(self, data):
        self.out.append(data)


def text_of(html: str | None) -> str | None:
    if html is None:
        return None
    p = _Text()
    p.feed(html)
    p.close()
    return "".join(p.out).strip()


class _Sanitizer(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip: list[str] = []

    def handle_starttag(self, tag, attrs):
        if self.skip or tag in DROPPED:
            if tag not in ("embed",):
                self.skip.append(tag)
            return
        if tag not in KEPT_TAGS:
            return
        kept = []
        for name, value in attrs:
            if name in KEPT_ATTRIBUTES and (name != "href" or url_is_safe(value or "")):
                kept.append(f' {name}="{_escaped(value or "")}"')
        self.out.append(f"<{tag}{''.join(kept)}>")

    def handle_endtag(self, tag):
        if self.skip:
            if tag in self.skip:
                del self.skip[len(self.skip) - 1 - self.skip[::-1].index(tag) :]
        elif tag in KEPT_TAGS and tag != "br":
            self.out.append(f"</{tag}>")

    def handle_startendtag(self, tag, attrs):
        if tag not in DROPPED:
            self.handle_starttag(tag, attrs)

    def handle_data(self, data):
        if not self.skip:
            self.out.append(_escaped(data))


def _escaped(t: str) -> str:
    return t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def url_is_safe(u: str) -> bool:
    u = u.strip().lower()
    return bool(u) and not u.startswith(("javascript:", "vbscript:")) and (not u.startswith("data:") or u.startswith("data:image/"))


def sanitized(html: str | None) -> str | None:
    if html is None:
        return None
    p = _Sanitizer()
    p.feed(html)
    p.close()
    return "".join(p.out)


@F.pandas_udf(StringType())
def text_content(s: pd.Series) -> pd.Series:
    """Readable text of markup: entities decoded, line ends for block tags, trimmed."""
    return s.map(text_of, na_action="ignore")


@F.pandas_udf(StringType())
def sanitize(s: pd.Series) -> pd.Series:
    """Markup reduced to harmless tags and attributes; unknown tags are unwrapped, scripts and the like dropped."""
    return s.map(sanitized, na_action="ignore")


def clean_text(c: Column) -> Column:
    """What is embedded: readable text without references, single blanks."""
    return without_quotes(text_content(c))


def word_pieces(words_: list[str], vocabulary: dict[str, int], length: int) -> list[int]:
    """Ids with [CLS] and [SEP], cut and padded to ``length``; the longest known prefix first, ## inside a word."""
    ids = [vocabulary["[CLS]"]]
    for w in words_:
        at, parts = 0, []
        while at < len(w):
            end = next((e for e in range(len(w), at, -1) if ("##" if at else "") + w[at:e] in vocabulary), None)
            if end is None:
                parts = [vocabulary["[UNK]"]]
                break
            parts.append(vocabulary[("##" if at else "") + w[at:end]])
            at = end
        ids += parts
    ids = ids[: length - 1] + [vocabulary["[SEP]"]]
    return ids + [vocabulary.get("[PAD]", 0)] * (length - len(ids))


def word_piece_ids(words_: Column, vocabulary: dict[str, int], length: int = 128) -> Column:
    """Ids of an array of words. The vocabulary, of fixed size, goes with the function."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda w: word_pieces([x.lower() for x in w], vocabulary, length), na_action="ignore")

    return run(words_)
