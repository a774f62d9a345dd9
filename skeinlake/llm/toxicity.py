"""Abusive, hateful or sexual passages, by maximum-scoring segments.

Words are brought to one spelling (zero-width characters, look-alike letters, digits for letters, letters apart, letters
repeated). From a bounded labelled table each word, and each run of two and three words, gets its log-odds of being in a
passage of that kind, under Dirichlet priors: a run's prior is the posterior of the shorter run it ends with, so rare runs
score as their words do. One linear scan finds all maximal segments of a text, whose sums no extension improves. As most
words of a labelled text are harmless, the fit is repeated on the passages it finds. The best segment of a harmless text
grows with the text's length as an extreme value does; scores are calibrated by that law, so long texts are no worse off.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables
from ..staging import Stage

#: Labelled posts that are used at most, chosen by hash.
LABELLED = 20_000
#: Counts that the prior of a word stands for, and the loss of a word that says nothing.
PRIOR, DRIFT = 3.0, 0.6
ROUNDS = 3
#: A score that about parts the two kinds, by which the share of toxic texts in the table is estimated.
PARTING = 4.0
#: However few the labels, a text counts only if one in 10 ** LEAST harmless texts of its length would score as high.
LEAST = 3.0

_TAG = re.compile(r"<[^>]*>")
_QUOTE = re.compile(r">>>/\w+/\d*|>>\d+")
_TOKEN = re.compile(r"[\w$@*]+|\n")
_APART = re.compile(r"(?<![\w*])(?:[^\W\d_] ){2,}[^\W\d_](?![\w*])")
_RUN = re.compile(r"(.)\1+")
_HIDDEN = re.compile("[­᠎​-‏⁠-⁤﻿]")
#: Digits and signs that stand for letters.
_LEET = str.maketrans("013457@$", "oieastas")
#: Cyrillic and Greek letters that look like Latin ones.
_ALIKE = str.maketrans("аеосрхуіјѕһԁԛԝкмтвнαεορυικντ", "aeocpxyijshdqwkmtbhaeopuikvt")
_LATIN = re.compile(r"[a-z]")
BREAK = "\n"


class _Spelling(dict):
    """One spelling of each token."""

    def __missing__(self, token: str) -> str:
        t = token
        if not t.isascii():
            t = unicodedata.normalize("NFKC", t)
            if _LATIN.search(t):
                t = t.translate(_ALIKE)
            t = "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))
        if t.isdigit():
            t = "0"
        elif "*" not in t:
            if not t.isalpha() and (_LATIN.search(t) or "$" in t) and (d := t.translate(_LEET)).isalpha():
                t = d
            t = _RUN.sub(r"\1", t)
        if len(self) > 500_000:
            self.clear()
        self[token] = t
        return t


_spelling = _Spelling()


def tokens(subject: str | None, comment: str | None) -> list[str]:
    """The words of subject and comment in one spelling, with a break for each line end."""
    t = comment or ""
    if "<" in t:
        t = _TAG.sub(BREAK, t)
    if "&" in t:
        t = html.unescape(t)
    if ">>" in t:
        t = _QUOTE.sub(BREAK, t)
    t = f"{subject}\n{t}".lower() if subject else t.lower()
    if not t.isascii():
        t = _HIDDEN.sub("", t)
    t = _APART.sub(lambda m: m.group().replace(" ", ""), t)
    return list(map(_spelling.__getitem__, _TOKEN.findall(t)))


def _mask(word: str) -> str:
    return f"{word[0]}*{len(word)}*{word[-1]}"


class Model:
    """Scores of words and runs of words; ``limit`` is the calibrated score from which a text counts."""

    def __init__(self) -> None:
        self.runs: tuple[dict[str, float], ...] = ({}, {}, {})
        self.masks: dict[str, str] = {}
        self.scale, self.shift, self.limit = 1.0, 0.0, LEAST
        self.left_out = self.bad = np.zeros(0)

    def fit_runs(self, bad: list[list[str]], good: list[list[str]]) -> None:
        """Log-odds of all runs of up to three words; ``bad`` are passages, ``good`` harmless texts."""
        count = [[Counter(), Counter()] for _ in range(3)]
        for side, texts in enumerate((bad, good)):
            for t in texts:
                count[0][side].update(t)
                two = [f"{a} {b}" for a, b in zip(t, t[1:])]
                count[1][side].update(two)
                count[2][side].update(f"{x} {c}" for x, c in zip(two, t[2:]))
        total = [max(1, sum(c.values())) for c in count[0]]
        base = total[0] / sum(total)
        share: dict[str, float] = {}
        out: list[dict[str, float]] = []
        for n, (b, g) in enumerate(count):
            scores: dict[str, float] = {}
            for run in b.keys() | g.keys():
                x, y = b[run], g[run]
                if n and x + y < 2:
                    continue
                before = share.get(run.split(" ", 1)[1], base) if n else base
                p = (x + PRIOR * before) / (x + y + PRIOR)
                share[run] = p
                scores[run] = math.log(p / (1 - p)) - math.log(base / (1 - base))
            out.append(scores)
        for s in out:
            for run in [r for r in s if BREAK in r.split(" ")]:
                del s[run]
        self.runs = tuple(out)
        self.masks = {}
        for w, s in sorted(self.runs[0].items(), key=lambda x: x[1]):
            if s > 1.5 and len(w) > 2 and w.isalpha():
                self.masks[_mask(w)] = w

    def scores(self, t: list[str]) -> list[float]:
        """The score of each word in its place."""
        one, two, three = self.runs
        out, a, b, ab = [], BREAK, BREAK, ""
        for c in t:
            if c == BREAK:
                out.append(-2 * DRIFT)
                a = b = BREAK
                continue
            if "*" in c and c not in one and len(c) > 2:
                c = self.masks.get(_mask(c), c)
            bc = f"{b} {c}"
            s = three.get(f"{a} {bc}")
            if s is None:
                s = two.get(bc)
                if s is None:
                    s = one.get(c, 0.0)
            out.append(s - DRIFT)
            a, b = b, c
        return out

    def segments(self, t: list[str]) -> list[tuple[float, int, int]]:
        """(score, start, end) of all maximal segments of positive score, in order; one scan."""
        stack: list[list] = []  # start, end, sum before the segment, sum with it
        total = 0.0
        for i, s in enumerate(self.scores(t)):
            if s <= 0:
                total += s
                continue
            left, total = total, total + s
            seg = [i, i + 1, left, total]
            while True:
                j = len(stack) - 1
                while j >= 0 and stack[j][2] >= seg[2]:
                    j -= 1
                if j < 0 or stack[j][3] >= seg[3]:
                    break
                seg = [stack[j][0], seg[1], stack[j][2], seg[3]]
                del stack[j:]
            stack.append(seg)
        return [(x[3] - x[2], x[0], x[1]) for x in stack]

    def set_limit(self, share: float | None) -> None:
        """The limit with the best F-measure on left-out texts, a text counting by how many raters object.

        ``share`` of the table's texts score PARTING or more. Of harmless ones, by the calibration, one in 10 ** PARTING does;
        of toxic ones as many as of the labelled. This gives how many toxic texts the table holds, and so for how many of
        the table a harmless labelled text stands, as the labelled ones are no representative sample. Labels of harmless
        texts are not used for it, as a few mistaken ones would hide a small share. Without ``share`` each stands for itself.
        """
        left_out, bad = self.left_out, self.bad
        if not len(left_out):
            return
        weight, good = 1.0, 1 - bad
        if share is not None:
            caught = max(0.05, float((bad * (left_out >= PARTING)).sum() / bad.sum()))
            toxic = min(0.9, max(1e-4, (share - 10**-PARTING) / caught))
            weight = (1 - toxic) / toxic * float(bad.sum() / good.sum())
        order = np.argsort(-left_out, kind="stable")
        hits, wrong = np.cumsum(bad[order]), np.cumsum(good[order])
        f = 2 * hits / (hits + weight * wrong + bad.sum())
        # the middle of where it is as good as the best, so that no single text decides
        best = np.flatnonzero(f >= f.max() - 0.002)
        self.limit = max(LEAST, float((left_out[order[best[0]]] + left_out[order[best[-1]]]) / 2))

    def best(self, t: list[str]) -> float:
        return max((s[0] for s in self.segments(t)), default=0.0)

    def calibrated(self, score: float, n: int) -> float:
        """-log10 of how many harmless texts of n words reach the score."""
        return (self.scale * score - self.shift - math.log(max(n, 1))) / math.log(10)

    def calibrate(self, scores: np.ndarray, sizes: np.ndarray) -> None:
        """Fit the extreme-value law P(best >= x) = 1 - exp(-K n exp(-scale x)) to harmless texts with a positive segment.

        The upper tenth is left out, as labels err; the fit is by moments of what is left, made up for the cut.
        """
        x = np.sort(scores[scores > 0])
        x = x[: max(1, int(len(x) * 0.9))]
        if len(x) < 20:
            self.scale, self.shift = 1.0, 0.0
            return
        spread = max(0.2, float(x.std()) * 1.3)
        self.scale = math.pi / math.sqrt(6) / spread
        mean = float(x.mean())
        self.shift = self.scale * mean - 0.5772 - math.log(max(1.0, float(sizes.mean())))


def train(texts: list[list[str]], bad: np.ndarray, rounds: int = ROUNDS) -> Model:
    """A model of labelled texts; ``bad`` is the share of raters who object to each. Limits are set on left-out folds."""
    model = _train(texts, bad, rounds)
    fold = np.arange(len(texts)) % 3
    left_out = np.zeros(len(texts))
    for k in range(3):
        part = [i for i in range(len(texts)) if fold[i] != k]
        if len(part) < 30 or not (bad[part] > 0.5).any():
            return model
        other = _train([texts[i] for i in part], bad[part], rounds)
        for i in np.flatnonzero(fold == k).tolist():
            left_out[i] = other.calibrated(other.best(texts[i]), len(texts[i]))
    model.left_out, model.bad = left_out, bad
    model.set_limit(None)
    return model


def _train(texts: list[list[str]], bad: np.ndarray, rounds: int) -> Model:
    model = Model()
    is_bad = bad > 0.5
    passages = [t for t, b in zip(texts, is_bad) if b]
    harmless = [t for t, b in zip(texts, is_bad) if not b]
    model.fit_runs(passages, harmless)
    sizes = np.array([len(t) for t in texts])
    for _ in range(rounds):
        best = [max(model.segments(t), default=(0.0, 0, 0)) for t in texts]
        top = np.array([b[0] for b in best])
        model.calibrate(top[~is_bad], sizes[~is_bad])
        high = np.array([model.calibrated(s, n) for s, n in zip(top, sizes)])
        passages, harmless = [], []
        for t, b, (s, i, j), e in zip(texts, is_bad, best, high):
            if b and s > 0:
                passages.append(t[i:j])
                harmless += [t[:i], t[j:]]
            elif not b and e < 6:  # a text that no harmless one is like is taken for an error of the rater
                harmless.append(t)
        model.fit_runs(passages, harmless)
    top = np.array([model.best(t) for t in texts])
    model.calibrate(top[~is_bad], sizes[~is_bad])
    return model


def labelled(spark: SparkSession, posts: DataFrame, labels: DataFrame, bound: int = LABELLED) -> tuple[list[list[str]], np.ndarray]:
    """Token lists of up to ``bound`` labelled posts and the share of raters who object to each."""
    votes = labels.where("post_id is not null and label is not null").groupBy("post_id").agg(F.avg((F.col("label") != "clean").cast("double")).alias("bad"))
    votes = votes.orderBy(F.xxhash64("post_id"), "post_id").limit(bound)
    if bound > LABELLED:
        raise ValueError(f"at most {LABELLED} labelled posts")
    # the bound is that of the broadcast: 16 bytes a row
    rows = posts.select(F.col("id").alias("post_id"), "subject", "comment_raw").join(F.broadcast(votes), "post_id").dropDuplicates(["post_id"]).toArrow().to_pylist()
    rows.sort(key=lambda r: r["post_id"])
    return [tokens(r["subject"], r["comment_raw"]) for r in rows], np.array([r["bad"] for r in rows])


_PASSAGES = "array<struct<score:double,first_word:int,last_word:int,words:string>>"


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """post_id, score, toxic, passages of every post: the calibrated score of its worst passage, and those over the limit.

    A passage has its score, its place in words and its words in their one spelling. Null and empty comments and subjects
    have score 0. Without usable labels, or where they name only one side, nothing is toxic. A repeated post counts once.
    All posts are scored once and written; the share of high scores among them all then sets the limit.
    """
    stage = Stage(spark, "toxicity")
    posts = tables.load(spark, sf_dir, "posts").select("id", "subject", "comment_raw")
    texts, bad = labelled(spark, posts, tables.load(spark, sf_dir, "post_labels"))
    model = train(texts, bad) if len(texts) and (bad > 0.5).any() and (bad <= 0.5).any() else None
    shared = spark.sparkContext.broadcast(model)  # bounded by the labelled posts
    kind = pa.list_(pa.struct([("score", pa.float64()), ("first_word", pa.int32()), ("last_word", pa.int32()), ("words", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            score, found = np.zeros(b.num_rows), [[] for _ in range(b.num_rows)]
            if m is not None:
                for i, (s, c) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                    t = tokens(s, c)
                    for x, first, last in m.segments(t):
                        e = m.calibrated(x, len(t))
                        score[i] = max(score[i], e)
                        if e >= LEAST:
                            found[i].append({"score": e, "first_word": first, "last_word": last, "words": " ".join(w for w in t[first:last] if w != BREAK)})
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array(found, kind)], names=["post_id", "score", "passages"])

    scored = posts.mapInArrow(run, f"post_id long, score double, passages {_PASSAGES}")
    scored = stage.cut(scored.groupBy("post_id").agg(F.max(F.struct("score", "passages")).alias("r")).select("post_id", "r.*"))
    limit = float("inf")
    if model is not None:
        n, high = scored.agg(F.count("*"), F.count_if(F.col("score") >= PARTING)).first()
        model.set_limit(high / n if n else None)
        limit = model.limit
    return scored.select("post_id", "score", (F.col("score") >= limit).alias("toxic"), F.filter("passages", lambda p: p["score"] >= limit).alias("passages"))


def score_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """post_id, score, n_passages, toxic of every post; see ``passages``."""
    return passages(spark, sf_dir).select("post_id", "score", F.size("passages").alias("n_passages"), "toxic")


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site_id, code, n_posts, n_toxic, rate by board and site."""
    placed = tables.placed_posts(spark, sf_dir).select("post_id", "site_id", "code")
    per = score_posts(spark, sf_dir).join(placed, "post_id").groupBy("site_id", "code")
    return per.agg(F.count("*").alias("n_posts"), F.count_if("toxic").alias("n_toxic")).withColumn("rate", F.round(F.col("n_toxic") / F.col("n_posts"), 6))
