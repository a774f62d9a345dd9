"""Personal data in free text, by a linear-chain conditional random field.

Lines are words between blanks. A word's features are its lower-case form where it links or announces values, its shape, its
ends, and classes such as a public form of number; a label's score adds those of the word and of two words on either side.
Words recur, so their scores are computed once for a worker and a text is scored by gathering rows. Labels mark begin and
inside of each type. Decoding is by Viterbi in numpy, over many lines at a time. Lines in which no word's score for any type
could outweigh its score for none, whatever the transitions, have no other best path than none, and are passed over.
"""

from __future__ import annotations

import base64
import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pii_examples
from .tokens import default_vocabulary

TYPES = ("email", "phone", "id_number", "address", "person_name")
LABELS = ("O", *(f"{p}-{t}" for t in TYPES for p in "BI"))
REACH = (-2, -1, 0, 1, 2)
STEPS, RATE, RIDGE = 80, 0.15, 2e-4
#: Labelled lines of a part of the fit, all of like length.
PART = 1500
#: Distinct words that a worker remembers, and rows that it works on at a time.
MEMO, CHUNK = 200_000, 2000
#: Words of the public vocabulary that filler is drawn from, of either case.
FILLER = 8000

_TAG = re.compile(r"<(?:br|/p|/div|/li|/blockquote)[^>]*>", re.I)
_ANY = re.compile(r"<[^>]*>")
_OUTER = "()[]{}<>«»“”\"'’.,;:!?…"
def _bare(word: str) -> str:
    """Without accents."""
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFD", word.replace("ø", "o").replace("ł", "l")) if not unicodedata.combining(c))


_GIVEN = frozenset(map(_bare, pii_examples.GIVEN))
_STREETS = frozenset(w.strip(".").lower() for w in (*pii_examples.STREET_EN, *pii_examples.STREET_DE, *pii_examples.STREET_ROMANCE))
_STREET_END = re.compile(r".{3,}(stra(ß|ss)e|str|weg|gasse|platz|allee|ring|ufer|straat|laan|gatan|vej)$")
_UNITS = frozenset("apt apartment flat unit suite floor".split())
_MAIL = re.compile(r"[^@\s]+(@|＠|\(at\)|\[at\]|\{at\})[^@\s]+(\.|\(dot\)|\[dot\])[a-z]{2,}$", re.I)
_FILE = re.compile(r"\.(png|jpe?g|gif|webm|svg|webp|mp4|pdf|txt|zip)$", re.I)
_KINDS = (
    ("intl", re.compile(r"(tel:)?\+\d[\d().-]{8,}$|00\d{2}[\d().-]{8,}$")), ("nanp", re.compile(r"\(?\d{3}[).-]\d{3}[-.]\d{4}$")), ("plus", re.compile(r"\+\d{1,3}$")), ("area", re.compile(r"\(\d+\)\d*$")), ("trunk", re.compile(r"0\d{2,4}$")), ("local", re.compile(r"0\d{2,4}[-/.]?\d{5,8}$")),
    ("ssn", re.compile(r"\d{3}-\d{2}-\d{4}$")), ("dni", re.compile(r"[A-Za-z]-?\d{7}-?[A-Za-z]$|\d{8}-?[A-Za-z]$|[A-Za-z]{1,2}\d{6,8}[A-Za-z]?$")), ("house", re.compile(r"\d{1,3}[a-d]?$")), ("floor", re.compile(r"\dº")), ("zip", re.compile(r"\d{5}$|[A-Z]{1,2}\d{1,2}$|\d[A-Z]{2}$", re.I)),
    ("dots", re.compile(r"v?\d+\.\d+")), ("date", re.compile(r"\d{4}-\d\d-\d\d$|\d\d:\d\d$|\d{1,2}[./]\d{1,2}[./]\d{2,4}$")), ("isbn", re.compile(r"97[89]-")), ("initial", re.compile(r"[^\W\d_]\.$")), ("ref", re.compile(r">>")),
)


def plain(text: str | None) -> str:
    """Readable text: line-ending tags are line ends, other tags are dropped, entities decoded."""
    if not text:
        return ""
    if "<" in text:
        text = _ANY.sub("", _TAG.sub("\n", text))
    return html.unescape(text) if "&" in text else text


def _shape(w: str) -> str:
    out = []
    for c in w:
        s = "9" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c
        if not (s in "Xx" and out and out[-1] == s):
            out.append(s)
    return "".join(out)[:14]


class Lexicon:
    """Words that features name: those of the labelled table, and the common words of a public vocabulary."""

    def __init__(self, known: frozenset[str], common: frozenset[str], proper: frozenset[str]):
        self.known, self.common, self.proper = known, common, proper


def vocabulary_path() -> Path:
    """The installed public tokenizer for many languages."""
    return Path(default_vocabulary()).with_name("byte_bpe_multi_50k.tiktoken")


def vocabulary(path: str) -> tuple[list[str], list[str]]:
    """Lower-case and capitalised words, the commonest first, that are tokens of the tokenizer at ``path``."""
    lower, names = [], []
    with open(path, "rb") as f:
        for line in f:
            token = base64.b64decode(line.split()[0])
            try:
                w = token.decode()
            except UnicodeDecodeError:
                continue
            if w[:1] == " " and len(w) > 2 and w[1:].isalpha():
                if w[1:].islower():
                    lower.append(w[1:])
                elif w[1:].istitle():
                    names.append(w[1:])
    have = set(lower)
    return lower, [n for n in names if n.lower() not in have]


def features(word: str, lexicon: Lexicon) -> list[str]:
    """The names of a word's features."""
    if word in ("<s>", "<a>", "</s>"):
        return [word]
    bare = word.strip(_OUTER)
    low = bare.lower()
    lead, tail = word[: len(word) - len(word.lstrip(_OUTER))], word[len(word.rstrip(_OUTER)) :]
    f = ["1", "s=" + _shape(bare), "t=" + tail[:2], "l=" + lead[:1]]
    if low in lexicon.known:
        f.append("w=" + low)
    for kind in _CUE_OF.get(low, ()):
        f.append("cue=" + kind)
        if ":" in tail:
            f.append("cue:=" + kind)
    title = bare[:1].isupper() and bare[1:].islower()
    if _bare(low) in _GIVEN:  # in lower case, some are words
        f += ["given word-"] if low in lexicon.common and bare == low else ["given", "Given" if title else "given^" if bare.isupper() else "given-"]
    elif bare.isalpha():
        kind = "proper" if low in lexicon.proper else "common" if low in lexicon.common else "new"
        f += [kind, kind + ("+" if title else "^" if bare.isupper() else "-")]
    elif "-" in bare or "'" in bare:
        f.append("joined" + ("+" if title or bare[:1].isupper() else "-"))
    if low in _STREETS or _STREET_END.match(low):
        f.append("street")
    if low in _UNITS:
        f.append("unit")
    if low in pii_examples.DIGIT_WORDS:
        f.append("spoken")
    if _MAIL.search(bare):
        f.append("file" if _FILE.search(bare) else "mail")
    elif "@" in bare or "＠" in bare:
        f.append("at")
    n = sum(c.isdigit() for c in bare)
    if n:
        f.append(f"n={min(n, 12)}")
        f.append("alldigits" if bare.isdigit() else "mixed")
    for name, p in _KINDS:
        if p.match(word if name in ("initial", "ref") else bare):
            f.append("k=" + name)
    if low[-3:].isalpha():
        f.append("e=" + low[-3:] if low[-3:] in _ENDS else "e")
    return f


_ENDS = frozenset(e[-3:] for e in pii_examples._ENDS if len(e) > 2)
_CUE_OF: dict[str, list[str]] = {}
for _kind, _list in pii_examples.CUES.items():
    for _w in _list:
        _CUE_OF.setdefault(_w.strip(".").lower(), []).append(_kind)


class Field:
    """Weights of features at each reach for each label, and of transitions."""

    def __init__(self, index: dict[str, int], lexicon: Lexicon, weights: np.ndarray, moves: np.ndarray):
        self.index, self.lexicon, self.weights, self.moves = index, lexicon, weights, moves
        self.memo: dict[str, int] = {}
        self.table = np.zeros((1024, len(REACH), len(LABELS)), dtype=np.float32)
        for w in ("<s>", "<a>", "</s>"):
            self.row(w)

    def __getstate__(self):
        return self.index, self.lexicon, self.weights, self.moves

    def __setstate__(self, state):
        self.__init__(*state)

    def row(self, word: str) -> int:
        """The number of the word's row of scores."""
        k = self.memo.get(word)
        if k is None:
            k = len(self.memo)
            if k == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            at = [self.index[f] for f in set(features(word, self.lexicon)) if f in self.index]
            self.table[k] = self.weights[at].sum(0)
            self.memo[word] = k
        return k

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """Scores of each word but two at either end of all; lines are parted by two marks on each side."""
        n = len(ids) - 4
        e = np.zeros((n, len(LABELS)), dtype=np.float32)
        for k, off in enumerate(REACH):
            e += self.table[ids[2 + off : 2 + off + n], k]
        return e

    def decode(self, lines: list[list[str]], author: bool) -> Iterator[tuple[int, np.ndarray]]:
        """The number of each line that holds something, and its labels."""
        if len(self.memo) > MEMO:
            self.__init__(self.index, self.lexicon, self.weights, self.moves)
        first, last = self.row("<a>" if author else "<s>"), self.row("</s>")
        size = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
        ids = np.full(int(size.sum()) + 4 * len(lines), last, dtype=np.int64)
        start = np.cumsum(size + 4) - size - 2
        ids[start - 1], ids[start - 2] = first, first
        get, row = self.memo.get, self.row
        flat = [k if (k := get(w)) is not None else row(w) for line in lines for w in line]
        inside = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(len(flat))
        ids[inside] = flat
        if not len(flat):
            return
        e = self.emissions(ids)
        at = inside - 2
        spare = 2 * max(0.0, float((self.moves - self.moves[0, 0]).max()))
        gain = e[at, 1:].max(1) - e[at, 0] + spare
        owner = np.repeat(np.arange(len(lines)), size)
        todo = np.unique(owner[gain > 0])
        todo = todo[np.argsort(size[todo], kind="stable")]
        for s in range(0, len(todo), 512):
            part = todo[s : s + 512]
            n = size[part]
            top = int(n.max())
            grid = (start[part] - 2)[:, None] + np.minimum(np.arange(top), n[:, None] - 1)
            x = e[grid]
            score, back = x[:, 0], np.zeros((len(part), top, len(LABELS)), dtype=np.int8)
            for t in range(1, top):
                m = score[:, :, None] + self.moves
                back[:, t] = m.argmax(1)
                new = m.max(1) + x[:, t]
                score = np.where((t < n)[:, None], new, score)
            label = score.argmax(1)
            path = np.zeros((len(part), top), dtype=np.int8)
            for t in range(top - 1, -1, -1):
                path[:, t] = np.where(t < n, label, 0)
                label = np.where((t < n) & (t > 0), back[np.arange(len(part)), t, label], label)
            for i in np.flatnonzero(path.any(1)).tolist():
                yield int(part[i]), path[i, : n[i]]


def _labels(text: str, spans: list[tuple[int, int, str]]) -> tuple[list[str], list[int]]:
    words, out = [], []
    for m in re.finditer(r"\S+", text):
        words.append(m.group())
        y = 0
        for a, b, t in spans:
            if m.start() < b and m.end() > a:
                y = LABELS.index(("B-" if m.start() <= a else "I-") + t)
        out.append(y)
    return words, out


def _starts(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.concatenate([[0], np.flatnonzero(np.diff(x)) + 1])


class _Part:
    """Labelled lines of like length."""

    def __init__(self, seqs: list[list[int]], labels: list[list[int]], pad: int):
        n, top, k = len(seqs), max(map(len, labels)), len(LABELS)
        self.ids = np.full((n, top + 4), pad)
        y, self.mask = np.zeros((n, top), dtype=int), np.zeros((n, top), dtype=bool)
        for i, (s, lab) in enumerate(zip(seqs, labels)):
            self.ids[i, : len(s)] = s
            y[i, : len(lab)], self.mask[i, : len(lab)] = lab, True
        self.gold = np.zeros((n, top, k), dtype=np.float32)
        self.gold[np.arange(n)[:, None], np.arange(top), y] = self.mask
        self.gold_moves = np.zeros((k, k))
        both = self.mask[:, 1:]
        np.add.at(self.gold_moves, (y[:, :-1][both], y[:, 1:][both]), 1)
        self.places = []
        for off in REACH:
            flat = self.ids[:, 2 + off : 2 + off + top][self.mask]
            order = np.argsort(flat, kind="stable")
            self.places.append((order, _starts(flat[order]), np.unique(flat)))

    def gradient(self, table: np.ndarray, moves: np.ndarray, grad_table: np.ndarray) -> np.ndarray:
        """That of the negative log-likelihood by transitions; that by word scores is added to ``grad_table``."""
        ids, mask = self.ids, self.mask
        n, top, k = self.gold.shape
        e = sum(table[ids[:, 2 + off : 2 + off + top], j] for j, off in enumerate(REACH))
        big = np.exp(moves).astype(np.float32)
        x = np.exp(e - e.max(2, keepdims=True))
        fwd, scale = np.zeros((n, top, k), dtype=np.float32), np.ones((n, top), dtype=np.float32)
        for t in range(top):
            f = x[:, t] if t == 0 else (fwd[:, t - 1] @ big) * x[:, t]
            scale[:, t] = np.where(mask[:, t], f.sum(1), 1)
            fwd[:, t] = np.where(mask[:, t, None], f / scale[:, t, None], 0)
        bwd = np.zeros((n, top, k), dtype=np.float32)
        grad_moves = np.zeros((k, k))
        for t in range(top - 1, -1, -1):
            nxt = mask[:, t + 1] if t + 1 < top else np.zeros(n, dtype=bool)
            if nxt.any():
                r = x[:, t + 1] * bwd[:, t + 1] / scale[:, t + 1, None]
                grad_moves += (fwd[:, t][nxt].T @ r[nxt]) * big
                bwd[:, t] = np.where(nxt[:, None], r @ big.T, 1)
            else:
                bwd[:, t] = 1
        post = fwd * bwd
        post /= np.maximum(post.sum(2, keepdims=True), 1e-30)
        inner = np.where(mask[:, :, None], post - self.gold, 0)[mask]
        for j, (order, at, used) in enumerate(self.places):
            grad_table[used, j] += np.add.reduceat(inner[order], at)
        return grad_moves - self.gold_moves


@lru_cache(maxsize=2)
def fit(path: str | None = None) -> Field:
    """Maximum conditional likelihood with a ridge on the labelled table, by Adam; gradients by forward-backward.

    ``path`` is the tokenizer whose vocabulary tells common words; without one it is the installed one.
    """
    lower, names = vocabulary(path or str(vocabulary_path()))
    data = [(a, *_labels(t, s)) for a, t, s in pii_examples.rows(lower[:FILLER], names[:FILLER])]
    literal = re.sub(r"\{\w+\}", " ", " ".join((pii_examples.FRAMES, pii_examples.NEITHER, *(w for v in pii_examples.LINKS.values() for w in v)))).replace("|", " ")
    known = frozenset(w.strip(_OUTER).lower() for w in literal.split()) | {"at", "dot", "del", "de", "van", "von", "calle", "rue"} - {""}
    lexicon = Lexicon(known, frozenset(lower), frozenset(n.lower() for n in names))
    seqs = [["<a>" if a else "<s>"] * 2 + w + ["</s>"] * 2 for a, w, _ in data]
    feats = {w: tuple(sorted(set(features(w, lexicon)))) for s in seqs for w in s}
    index = {f: k for k, f in enumerate(sorted({f for fs in feats.values() for f in fs}))}
    classes = {fs: k for k, fs in enumerate(sorted(set(feats.values())))}  # words of the same features are one
    number = {w: classes[fs] for w, fs in feats.items()}
    pairs = np.array([(k, index[f]) for fs, k in classes.items() for f in fs])
    k = len(LABELS)
    w, moves = np.zeros((len(index), len(REACH), k), dtype=np.float32), np.zeros((k, k))
    params = [w, moves]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    by_word, by_feature = pairs[np.argsort(pairs[:, 0], kind="stable")], pairs[np.argsort(pairs[:, 1], kind="stable")]
    word_at, feature_at = _starts(by_word[:, 0]), _starts(by_feature[:, 1])
    order = sorted(range(len(seqs)), key=lambda i: len(seqs[i]))
    parts = [_Part([[number[x] for x in seqs[i]] for i in order[s : s + PART]], [data[i][2] for i in order[s : s + PART]], number["</s>"]) for s in range(0, len(seqs), PART)]
    for step in range(1, STEPS + 1):
        table = np.add.reduceat(w[by_word[:, 1]], word_at)  # every word has a feature
        grad_table, grad_moves = np.zeros_like(table), np.zeros((k, k))
        for part in parts:
            grad_moves += part.gradient(table, moves, grad_table)
        grad_w = np.add.reduceat(grad_table[by_feature[:, 0]], feature_at)  # every feature has a word
        grads = [grad_w / len(seqs) + RIDGE * w, grad_moves / len(seqs) + RIDGE * moves]
        for p, g, (m, v) in zip(params, grads, state):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= RATE * (1 - 0.9 * step / STEPS) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(index, lexicon, w.astype(np.float32), moves.astype(np.float32))


def spans_of(field: Field, texts: list[str], author: bool) -> list[list[tuple[int, int, str]]]:
    """(start, end, type) of each find in each text, without the signs around it."""
    lines, where = [], []
    for i, t in enumerate(texts):
        at = 0
        for line in t.split("\n"):
            w = line.split()
            if w:
                lines.append(w)
                where.append((i, at, line))
            at += len(line) + 1
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for k, labels in field.decode(lines, author):
        i, at, line = where[k]
        here: list[tuple[int, int, str]] = []
        for m, y in zip(re.finditer(r"\S+", line), labels.tolist()):
            if y and LABELS[y][0] == "I" and here and here[-1][2] == LABELS[y][2:] and not line[here[-1][1] : m.start()].strip():
                here[-1] = (here[-1][0], m.end(), here[-1][2])
            elif y:
                here.append((m.start(), m.end(), LABELS[y][2:]))
        for s, e, t in here:
            text = line[s:e]
            s += len(text) - len(text.lstrip(_OUTER.replace("(", "") if t == "phone" else _OUTER))
            e -= len(text) - len(text.rstrip(_OUTER))
            if e > s:
                out[i].append((at + s, at + e, t))
    return [sorted(f) for f in out]


def find(spark: SparkSession, rows: DataFrame, key: str, fields: dict[str, bool]) -> DataFrame:
    """``key``, field_name, redacted, finds: every row and field; finds are (pii_type, start, end) in the readable text.

    ``fields`` says of each text column whether it holds names of authors. Redacted is the readable text with a typed
    placeholder for each find. A null text has a null redacted and no finds. Repeated rows repeat.
    """
    shared = spark.sparkContext.broadcast(fit())  # weights of a fixed table
    names = list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        kind = pa.list_(pa.struct([("pii_type", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for s in range(0, batch.num_rows, CHUNK):
                b = batch.slice(s, CHUNK)
                for j, name in enumerate(names):
                    raw = b.column(j + 1).to_pylist()
                    texts = [plain(t) for t in raw]
                    finds = spans_of(field, texts, fields[name])
                    clean: list[str | None] = []
                    for r, t, f in zip(raw, texts, finds):
                        for a, e, p in reversed(f):
                            t = t[:a] + f"[{p.upper()}]" + t[e:]
                        clean.append(None if r is None else t)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0), pa.array([name] * b.num_rows), pa.array(clean, pa.string()), pa.array([[{"pii_type": p, "start": a, "end": e} for a, e, p in f] for f in finds], kind)],
                        names=[key, "field_name", "redacted", "finds"],
                    )

    k = rows.schema[key].dataType.simpleString()
    return rows.select(key, *names).mapInArrow(run, f"`{key}` {k}, field_name string, redacted string, finds array<struct<pii_type:string,start:int,end:int>>")
