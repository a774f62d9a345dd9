"""The search language: ``board:g not sage:true has:image after:2024-01-01 sort:timestamp asc limit:50 old camera``.

A query is parsed on the driver into a frozen tree and compiled to Column predicates, so Catalyst pushes what can be pushed.
Fields of other tables become semi-joins, anti-joins where negated. Mistakes are raised with their position; an unknown
field is a mistake, not a filter that matches everything.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

OPERATORS = (">=", "<=", "!=", ":", "=", ">", "<", "~", "!")
#: Field of the language -> column of the searched table.
COLUMNS = {
    "board": "board", "site": "site", "thread": "thread_native_id", "thread_id": "thread_native_id", "post": "post_native_id", "post_id": "post_native_id",
    "author": "author_name", "name": "author_name", "tripcode": "tripcode", "trip": "tripcode", "poster": "poster_id", "poster_id": "poster_id",
    "country": "country", "flag": "flag", "subject": "subject",
}
BOOLEANS = ("sticky", "locked", "archived", "sage")
TIMES = ("before", "after", "date", "timestamp", "time")
TEXTS = ("text", "content", "body", "comment")
VECTORS = ("vector", "embedding", "semantic")
FILES = ("has_image", "has_file", "has_video", "filename", "quote")
#: Layouts of times.
LAYOUTS = ("%Y-%m-%d", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y/%m/%d", "%m/%d/%Y", "%Y-%m")
SORTS = {"timestamp": "ts", "time": "ts", "date": "ts", "id": "post_id", "post": "post_id", "author": "author_name", "board": "board", "site": "site", "thread": "thread_id"}


class DslError(ValueError):
    def __init__(self, message: str, position: int):
        super().__init__(f"{message} at {position}")
        self.position = position


@dataclass(frozen=True)
class Filter:
    field: str
    op: str
    value: str | float | datetime
    negated: bool = False


@dataclass(frozen=True)
class Query:
    filters: tuple[Filter, ...] = ()
    sort: tuple[str, str] | None = None
    limit: int = 20
    offset: int = 0


_SPACE = re.compile(r"\s*")
_NAME = re.compile(r"[A-Za-z0-9_./-]+")
_OP = re.compile(">=|<=|!=|[:=><~!]")
_TIME_OR_NUMBER = re.compile(r"[0-9][0-9:TZ./+-]*")


def parse_time(s: str) -> datetime | None:
    """UTC time of one of the layouts, or of an RFC 3339 time with a zone."""
    for layout in LAYOUTS:
        try:
            return datetime.strptime(s, layout)
        except ValueError:
            pass
    try:
        t = datetime.fromisoformat(s.replace("Z", "+00:00"))
    except ValueError:
        return None
    return t.astimezone(timezone.utc).replace(tzinfo=None) if t.tzinfo else None


class _Reader:
    def __init__(self, source: str):
        self.s = source.strip()
        self.at = 0

    def blank(self) -> None:
        self.at = _SPACE.match(self.s, self.at).end()

    def take(self, pattern: re.Pattern) -> str | None:
        m = pattern.match(self.s, self.at)
        if m is None:
            return None
        self.at = m.end()
        return m.group()

    def keyword(self, word: str, then: str = "") -> bool:
        m = re.compile(rf"{word}(?![A-Za-z0-9_])\s*{then}", re.I).match(self.s, self.at)
        if m:
            self.at = m.end()
        return m is not None

    def value(self) -> str | float | datetime:
        self.blank()
        if self.at >= len(self.s):
            raise DslError("a value is missing", self.at)
        if (q := self.s[self.at]) in "\"'":
            end = self.s.find(q, self.at + 1)
            start, self.at = self.at + 1, len(self.s) if end < 0 else end + 1
            return self.s[start : len(self.s) if end < 0 else end]
        start = self.at
        if (token := self.take(_TIME_OR_NUMBER)) is not None and not (self.at < len(self.s) and _NAME.match(self.s, self.at)):
            if re.search("[-:/]", token) and (t := parse_time(token)):
                return t
            try:
                return float(token)
            except ValueError:
                raise DslError(f"{token} is neither a time nor a number", start) from None
        self.at = start
        if (token := self.take(_NAME)) is None:
            raise DslError("a value is missing", self.at)
        return token

    def whole(self) -> int:
        self.blank()
        if (digits := self.take(re.compile(r"\d+"))) is None:
            raise DslError("a number is missing", self.at)
        return int(digits)


def parse(source: str) -> Query:
    """The query of a search text. An empty text is the query without filters."""
    r, filters, sort, limit, offset = _Reader(source), [], None, 20, 0
    while True:
        r.blank()
        if r.at >= len(r.s):
            return Query(tuple(filters), sort, limit, offset)
        if r.keyword("(?:sort|order)", ":"):
            r.blank()
            field = r.take(_NAME)
            if field is None:
                raise DslError("a field is missing", r.at)
            r.blank()
            sort = (field, "asc" if r.keyword("asc") else "desc")
            if sort[1] == "desc":
                r.keyword("desc")
        elif r.keyword("limit", ":"):
            limit = r.whole()
        elif r.keyword("offset", ":"):
            offset = r.whole()
        else:
            filters.append(_filter(r))


def _filter(r: _Reader) -> Filter:
    negated = r.keyword("not")
    if not negated and re.match(r"!(?!=)\s*[A-Za-z]", r.s[r.at :]):
        r.at, negated = r.at + 1, True
    r.blank()
    start = r.at
    if (op := r.take(_OP)) is not None:  # a value alone is looked for in the text
        return Filter("text", ":" if op == "=" else op, r.value(), negated)
    if r.at < len(r.s) and r.s[r.at] in "\"'":
        return Filter("text", "~", str(r.value()), negated)
    if (name := r.take(_NAME)) is None:
        raise DslError(f"{r.s[r.at]!r} starts nothing" if r.at < len(r.s) else "a filter is missing", r.at)
    r.blank()
    if (op := r.take(_OP)) is None:  # bare words: all the rest is free text
        r.at = len(r.s)
        return Filter("text", "~", " ".join(r.s[start:].split()), negated)
    field = name.lower()
    if field == "has":
        r.blank()
        kind = r.take(_NAME)
        if kind is None:
            raise DslError("what it has is missing", r.at)
        return Filter("has_" + kind.lower(), ":", "", negated)
    return Filter(field, ":" if op == "=" else op, r.value(), negated)


def known(field: str) -> bool:
    return field in COLUMNS or field in (*BOOLEANS, *TIMES, *TEXTS, *VECTORS, *FILES)


def text_match(tokens: Column, wanted: str) -> Column:
    """Whether all words of the wanted text are among the tokens."""
    parts = [w for w in re.split(r"[\W_]+", wanted.lower()) if w]
    return F.size(F.array_except(F.array(*map(F.lit, parts)), tokens)) == 0 if parts else F.lit(True)


def _plain(v: str | float | datetime) -> str:
    return str(int(v)) if isinstance(v, float) and v.is_integer() else v.isoformat(sep=" ") if isinstance(v, datetime) else str(v)


def predicate(f: Filter) -> Column:
    """The predicate of a filter on the searched table's own columns."""
    flip = f.negated
    if f.field in COLUMNS:
        c, v, op = F.col(COLUMNS[f.field]), _plain(f.value), f.op
        if op == "~":
            escaped = re.sub(r"([\\%_])", r"\\\1", v)
            p = F.coalesce(c.ilike(f"%{escaped}%"), F.lit(False))
        elif op in (":", "!", "!="):
            p = F.coalesce(c == v, F.lit(False))
            flip ^= op != ":"
        else:
            p = F.coalesce({">": c > v, "<": c < v, ">=": c >= v, "<=": c <= v}[op], F.lit(False))
    elif f.field in BOOLEANS:
        want = str(f.value).lower() in ("true", "yes", "1", "1.0", "t")
        p = F.coalesce(F.col(f.field) == want, F.lit(False))
        flip ^= f.op in ("!", "!=")
    elif f.field in TIMES:
        if not isinstance(f.value, datetime):
            raise DslError(f"{f.field} needs a time", 0)
        op = {"before": "<", "after": ">"}.get(f.field, f.op) if f.op in (":", "=") else f.op
        c, v = F.col("ts"), F.lit(f.value).cast("timestamp_ntz")
        p = F.coalesce({">": c > v, "<": c < v, ">=": c >= v, "<=": c <= v}.get(op, c == v), F.lit(False))
        flip ^= op in ("!", "!=")
    elif f.field in TEXTS:
        p = F.coalesce(text_match(text.words(F.col("comment_raw")), _plain(f.value)), F.lit(False))
        flip ^= f.op in ("!", "!=")
    else:
        raise DslError(f"unknown field {f.field}", 0)
    return ~p if flip else p


def apply(q: Query, wide: DataFrame, files: DataFrame, quotes: DataFrame, vecs: DataFrame | None = None, embed: Callable[[str], list[float]] | None = None) -> DataFrame:
    """The posts of ``wide`` that the query names, in its order; without one, newest first.

    A term of vectors ranks: the posts that pass the filters and have a vector in ``vecs`` (post_id, embedding) come by the
    cosine to the vector that ``embed`` gives for its text, in column score, nearest first unless the query says how to
    sort. Without both, such a query is an error. ``files`` has post_id, mime and filename, ``quotes`` post_id and
    quoted_post_native_id. Both are joined by post_id, so they are shuffled only where they are asked for.
    """
    out = wide
    for f in q.filters:
        if not known(f.field):
            raise DslError(f"unknown field {f.field}", 0)
        if f.field in VECTORS:
            continue
        if f.field in FILES:
            if f.op in (">", "<", ">=", "<="):
                raise DslError(f"{f.field} has no order", 0)
            value = _plain(f.value)
            keys = {
                "has_image": lambda: files, "has_file": lambda: files, "has_video": lambda: files.where(F.col("mime").like("video/%")),
                "filename": lambda: files.where(F.col("filename").ilike(f"%{value}%") if f.op == "~" else F.col("filename") == value),
                "quote": lambda: quotes.where(F.col("quoted_post_native_id") == value),
            }[f.field]()
            anti = f.negated ^ (f.op in ("!", "!="))
            out = out.join(keys.select("post_id"), "post_id", "left_anti" if anti else "left_semi")
        else:
            out = out.where(predicate(f))
    if (wanted := vector_text(q)) is not None:
        if vecs is None or embed is None:
            raise DslError("no vectors to rank by", 0)
        from . import search

        out = out.join(search.scored(vecs.join(out.select("post_id"), "post_id", "left_semi"), embed(wanted)), "post_id")
        if q.sort is None:
            out = out.orderBy(F.desc("score"), "post_id")
            return (out.offset(q.offset) if q.offset else out).limit(q.limit)
    field, order = q.sort or ("timestamp", "desc")
    if field not in SORTS:
        raise DslError(f"cannot sort by {field}", 0)
    c = F.col(SORTS[field])
    out = out.orderBy(c.asc_nulls_last() if order == "asc" else c.desc_nulls_last(), F.col("post_id").asc() if order == "asc" else F.col("post_id").desc())
    return (out.offset(q.offset) if q.offset else out).limit(q.limit)


def vector_text(q: Query) -> str | None:
    """The text whose vector ranks the hits, if the query has one."""
    return next((str(f.value) for f in q.filters if f.field in VECTORS), None)
