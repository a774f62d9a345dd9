"""Encoding, packing, pieces, personal data and toxic passages."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import DATA

from skeinlake.llm import packing, pieces, pii, pii_examples, plans, tokens, toxicity

data = pytest.mark.skipif(not (DATA / "sf0.001").exists(), reason="no test data")
ENC = tokens.encoder(tokens.default_vocabulary())
ALPHABET = list("ab 'sltd \n\t\r  .,!?1234éñ中文　   \x85\x1c😀<|>#-_")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(ALPHABET) | st.characters(codec="utf-8"), max_size=60), max_size=6))
def test_fragments_encode_as_whole_texts(texts):
    assert ENC.encode(pa.array(texts, pa.string())).to_pylist() == [ENC.bpe.encode_ordinary(t) for t in texts]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")


def test_ids_and_sizes_of_odd_texts(spark):
    texts = [None, "", " ", "Hello world", "x" * 5000, "<|endoftext|>", "中" * 300, "a\n\n b  c"]
    got = {r["doc_id"]: list(r["ids"]) for r in tokens.token_ids(docs(spark, texts)).collect()}
    assert got == {i: ENC.bpe.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.token_sizes(docs(spark, texts)).collect()} == {i: len(v) for i, v in got.items()}
    assert ENC.bpe.decode(got[3]) == "Hello world"
    assert tokens.token_ids(docs(spark, texts).limit(0)).count() == 0


@data
def test_whole_corpus_round_trip(spark):
    d = spark.read.parquet(str(DATA / "sf0.001" / "documents.parquet")).select("doc_id", "text")
    ids = {r["doc_id"]: list(r["ids"]) for r in plans.p8_ids(spark, str(DATA / "sf0.001")).collect()}
    rows = d.collect()
    assert len(ids) == len(rows)
    assert all(ids[r["doc_id"]] == ENC.bpe.encode_ordinary(r["text"] or "") for r in rows)


def packed(spark, sizes, capacity):
    df = spark.createDataFrame([(i, s, "z") for i, s in enumerate(sizes)], "doc_id long, n_tokens long, container string")
    return packing.pack(spark, df, capacity).collect()


def check_packed(rows, sizes, capacity):
    used, parts = {}, {}
    for r in rows:
        parts.setdefault(r["doc_id"], []).append((r["part"], r["first_token"], r["n_tokens"]))
        if r["n_tokens"]:
            used[r["container"]] = used.get(r["container"], 0) + r["n_tokens"]
        else:
            assert r["container"] is None
    for i, s in enumerate(sizes):
        p = sorted(parts[i])
        assert sum(n for _, _, n in p) == (s or 0) and [a for _, a, _ in p] == [k * capacity for k in range(len(p))]
        assert len(p) == 1 or s > capacity
    assert max(used.values(), default=0) <= capacity and sorted(used) == list(range(len(used)))
    return sum(used.values()) / max(1, len(used)) / capacity


def test_packing(spark):
    r = random.Random(1)
    sizes = [int(min(6000, max(0, r.lognormvariate(5.3, 1.1)))) for _ in range(4000)] + [None, 0, 2048, 2049, 4096, 1]
    assert check_packed(packed(spark, sizes, 2048), sizes, 2048) > 0.99
    hot = [700] * 900 + [r.randint(1, 2048) for _ in range(300)]  # most items have one size
    check_packed(packed(spark, hot, 2048), hot, 2048)
    assert packed(spark, [], 2048) == [] and check_packed(packed(spark, [0, None], 5), [0, None], 5) == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200))
def test_plans_use_every_item_once(sizes):
    h = np.bincount(sizes, minlength=51) if sizes else np.zeros(51, dtype=np.int64)
    ranges, n = packing.plan(h)
    boxes, taken = {}, {}
    for s, first, per, box in ranges:
        end = min([f for t, f, *_ in ranges if t == s and f > first], default=int(h[s]))
        taken[s] = taken.get(s, 0) + end - first
        for k in range(first, end):
            boxes[box + (k - first) // per] = boxes.get(box + (k - first) // per, 0) + s
    assert taken == {s: int(c) for s, c in enumerate(h) if c} and max(boxes.values(), default=0) <= 50 and sorted(boxes) == list(range(n))


TEXTS = [
    "# One\n\n" + "\n\n".join(f"Paragraph {i}. " + "It holds some words, and more. " * 12 for i in range(40)),
    "word " * 3000, "x" * 20000, "中文" * 3000, "a.b" * 4000, "line of a log 12:30\n" * 600, "\n" * 3000, "😀" * 2000,
]


def test_pieces(spark):
    rows: dict = {}
    for r in pieces.pieces(docs(spark, [*TEXTS, None, "", "short"])).orderBy("doc_id", "piece").collect():
        rows.setdefault(r["doc_id"], []).append(r)
    assert set(rows) == {i for i, t in enumerate(TEXTS) if len(ENC.bpe.encode_ordinary(t)) > 512}
    for i, p in rows.items():
        t = TEXTS[i]
        assert p[0]["start_char"] == 0 and p[-1]["end_char"] == len(t) and [r["piece"] for r in p] == list(range(len(p)))
        for r in p:
            assert r["text"] == t[r["start_char"] : r["end_char"]]
            assert r["n_tokens"] == len(ENC.bpe.encode_ordinary(r["text"])) <= 512
        for a, b in zip(p, p[1:]):
            assert a["start_char"] < b["start_char"] < a["end_char"] < b["end_char"]
            assert 16 <= len(ENC.bpe.encode_ordinary(t[b["start_char"] : a["end_char"]])) <= 112
    natural = rows[0][:-1]
    assert sum(TEXTS[0][r["end_char"] :].lstrip(" ").startswith("\n\n") for r in natural) >= 0.9 * len(natural)
    assert pieces.pieces(docs(spark, []).limit(0)).count() == 0


def _cut(text, limit=512, overlap=64):
    data = text.encode()
    ids, at, _, _ = ENC.fragments(pa.array([text]))
    return [(data[p:q].decode(), n) for p, q, n in pieces.cut_text(ENC, ids, at, data, 0, len(data), limit, overlap)]


@pytest.mark.parametrize("text, ends", [
    ("".join(f"吾輩は猫である{i}、名前はまだ無い。" for i in range(200)), "。"),
    ("".join(f"「どこで生れたか{i}とんと見当がつかぬ。」" for i in range(200)), "」"),
    ("".join(f"他走了{i}公里！你呢？" for i in range(300)), "！？"),
    ("\n".join(f"薄暗いじめじめした所でニャーニャー泣いて{i}いた。" * 3 for i in range(80)), "。"),
    (" ".join(f"caf{i} passé" for i in range(500)), "0123456789é"),
])
def test_pieces_end_at_boundaries_of_the_text(text, ends):
    out = _cut(text)
    assert len(out) > 2
    for piece, n in out:
        assert n == len(ENC.bpe.encode_ordinary(piece)) <= 512
    assert all(piece[-1] in ends for piece, _ in out[:-1])


def test_paragraphs_after_wide_stops():
    text = "\n\n".join("".join(f"吾輩は猫である{i}{j}。" for j in range(12)) for i in range(40))
    out = _cut(text)
    assert all(text[(at := text.index(piece) + len(piece)) : at + 2] == "\n\n" for piece, _ in out[:-1])


# Sentences of everyday use, written for this test; the labelled table has neither their forms nor most of their words.
UNSEEN = [
    ("Drop Hannah a line via hannah.brecht@posteo.example before Friday.", {"email"}),
    ("Questions go straight to the treasurer, r.okafor@club-ledger.test, never to me.", {"email"}),
    ("Invoices? kasse42 (at) turnverein (dot) example works best", {"email"}),
    ("El tesorero contesta en pablo_ruiz@coro.example casi siempre", {"email"}),
    ("If the gate is locked, try my landline, 0161 496 0123, twice.", {"phone"}),
    ("Nach Feierabend erreicht ihr mich unter +49 171 5550199", {"phone"}),
    ("Marta picks up on (206) 442-0187 most mornings", {"phone"}),
    ("pour le chien perdu: 06 12 34 56 78 merci", {"phone"}),
    ("the clerk wrote down 078-05-1120, which is the social security number on my card", {"id_number"}),
    ("mi dni, 12345678Z, salió en la foto", {"id_number"}),
    ("they asked for the national insurance number QQ 12 34 56 C again", {"id_number"}),
    ("passport 925076473 expired in March", {"id_number"}),
    ("We finally moved into 48 Larchmont Avenue, Leeds LS8 2BQ last week", {"address"}),
    ("Das Paket liegt in der Goethestraße 17, 60313 Frankfurt", {"address"}),
    ("mándalo a la Calle Mayor 12, 3ºB por favor", {"address"}),
    ("the garage sale is at 9 Primrose Close all weekend", {"address"}),
    ("I bought the lathe off Andrew Pemberton years ago", {"person_name"}),
    ("Sincerely, Katarzyna Wolska", {"person_name"}),
    ("Our landlord, J. Whitcombe, never fixes the boiler", {"person_name"}),
    ("Ich heiße Matthias Brandt und repariere Radios", {"person_name"}),
    ("the teacher is called Priya Raman, she is lovely", {"person_name"}),
    ("Robert Lindgren still owes me for the tickets", {"person_name"}),
    ("Ring David Ashworth on 07700 900461 about the piano", {"person_name", "phone"}),
    ("Laura Benedetti, 27 Harbour Road, wants the sofa", {"person_name", "address"}),
    ("The invoice number is 20391184 and the total was 49.90", set()),
    ("I flashed build 4.19.3021 and it bricked at 03:14", set()),
    ("ISBN 978-3-16-148410-0 is the second printing", set()),
    ("Track 7 of the Grey Harbour soundtrack is the best one", set()),
    ("Thanks Oliver, that fixed the pump", set()),
    ("The Old Mill Road stop is closed until May", set()),
    ("Am Samstag verkauft der Verein wieder Kuchen und Kaffee", set()),
    ("ping @stormbird, the sprites@2x.png sheet is broken", set()),
    ("see >>48210933 and >>48210940 for the sources", set()),
    ("order 77310-B ships from Rotterdam on 2024-03-18", set()),
    ("La Guerra de los Mundos es mejor que la película", set()),
    ("error 0x80070057 after 512 retries, 16 GB of memory left", set()),
]


def test_forms_of_sentences_that_the_table_lacks():
    found = pii.spans_of(pii.fit(), [t for t, _ in UNSEEN], False)
    got = [(t, want, {x[2] for x in f}) for (t, want), f in zip(UNSEEN, found)]
    both, true, all_ = (sum(map(len, v)) for v in ([w & g for _, w, g in got], [w for _, w, g in got], [g for _, w, g in got]))
    assert both >= 0.85 * true and both >= 0.85 * all_, [x for x in got if x[1] != x[2]]


def test_frames_have_no_run_of_words():
    import re

    frames = "|".join((pii_examples.FRAMES, pii_examples.NEITHER, pii_examples.AUTHORS, pii_examples.HANDLES)).replace("\n", "|").split("|")
    assert all(len(part.split()) < 3 for f in frames for part in re.split(r"\{\w+\}", f))


def test_fresh_rows_of_the_table():
    field, right, n = pii.fit(), 0, 0
    words, names = pii.vocabulary(str(pii.vocabulary_path()))
    for author in (False, True):
        rows = [(t, s) for a, t, s in pii_examples.rows(words[: pii.FILLER], names[: pii.FILLER], each=3, seed=77) if a == author]
        for (_, s), f in zip(rows, pii.spans_of(field, [t for t, _ in rows], author)):
            right, n = right + ({x[2] for x in s} == {x[2] for x in f}), n + 1
    assert right >= 0.95 * n


def test_redaction(spark):
    rows = [(1, "<p>write me at jane.doe@mail.example</p><p>or call 07700 900123 after six</p>", "Anonymous", 0), (2, None, None, 0), (3, "", "", 0), (4, "just a kettle " * 4000 + "\nmy name is Greta Halvorsson", "Greta Halvorsson", 0), (1, "again", "x", 0)]
    df = spark.createDataFrame(rows, "post_id long, comment_raw string, author_name string, finds int")
    got = pii.find(spark, df, "post_id", {"comment_raw": False, "author_name": True}).collect()
    assert len(got) == 10
    one = {(r["post_id"], r["field_name"]): r for r in got if r["redacted"] not in ("again", "x")}
    assert one[1, "comment_raw"]["redacted"].split("\n") == ["write me at [EMAIL]", "or call [PHONE] after six", ""]
    assert one[2, "comment_raw"]["redacted"] is None and one[2, "comment_raw"]["finds"] == [] and one[3, "comment_raw"]["redacted"] == ""
    assert one[4, "comment_raw"]["redacted"].endswith("\nmy name is [PERSON_NAME]") and one[4, "author_name"]["redacted"] == "[PERSON_NAME]"


def test_viterbi_is_the_best_path():
    field = pii.fit()
    import itertools

    words = ["mail:", "a.b@c.example", "call", "07700"]
    ids = np.array([field.row(w) for w in ["<s>", "<s>", *words, "</s>", "</s>"]])
    e = field.emissions(ids)
    best = max(itertools.product(range(len(pii.LABELS)), repeat=4), key=lambda y: sum(e[t, y[t]] for t in range(4)) + sum(field.moves[a, b] for a, b in zip(y, y[1:])))
    (k, got), = field.decode([words, ["no", "kettle"]], False)
    assert k == 0 and tuple(got.tolist()) == best


def test_spellings():
    t = toxicity.tokens("S", "You <b>m0r0n</b> id​iot, mоrоn d u m b a s s imbeciiiile &gt;&gt;12")
    assert t[:2] == ["s", "\n"] and [w for w in t if w != "\n"][1:] == ["you", "moron", "idiot", "moron", "dumbas", "imbecile"]
    assert toxicity.tokens(None, None) == [] and toxicity.tokens("", "") == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-4, 4), max_size=30))
def test_best_segment_is_the_maximum_sum(scores):
    m = toxicity.Model()
    m.scores = lambda t: [float(x) for x in t]
    best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=0)
    segs = m.segments(scores)
    assert max((s[0] for s in segs), default=0.0) == max(0, best)
    assert all(a[2] <= b[1] for a, b in zip(segs, segs[1:])) and all(abs(s - sum(scores[i:j])) < 1e-9 for s, i, j in segs)


@data
def test_held_out_toxicity():
    import duckdb

    c = duckdb.connect()
    d = DATA / "sf0.1"
    rows = c.execute(f"SELECT post_id, avg((label <> 'clean')::INT) AS bad, any_value(subject), any_value(comment_raw) FROM '{d}/post_labels.parquet' JOIN '{d}/posts.parquet' p ON p.id = post_id GROUP BY 1 ORDER BY 1").fetchall()
    m = toxicity.train([toxicity.tokens(r[2], r[3]) for r in rows], np.array([r[1] for r in rows]))
    bad, found = np.array([r[1] for r in rows]) > 0.5, m.left_out >= m.limit  # scores of folds that were not trained on
    assert (bad & found).sum() >= 0.85 * bad.sum() and (bad & found).sum() >= 0.88 * found.sum()


def _posts(spark, path, posts, labels):
    spark.createDataFrame(posts, "id long, subject string, comment_raw string").write.parquet(f"{path}/posts.parquet")
    spark.createDataFrame(labels, "post_id long, label string, rater int").write.parquet(f"{path}/post_labels.parquet")
    return str(path)


def test_toxicity_without_labels_and_with_nulls(spark, tmp_path):
    posts = [(1, None, None), (2, "", ""), (3, "s", "you absolute moron go away"), (3, "s", "you absolute moron go away")]
    d = _posts(spark, tmp_path / "none", posts, [])
    assert {r["post_id"]: r["toxic"] for r in toxicity.score_posts(spark, d).collect()} == {1: False, 2: False, 3: False}
    many = [(i, None, "a quiet kettle on the shelf") for i in range(10, 60)] + [(i, None, "you absolute moron go away") for i in range(60, 100)]
    labels = [(i, "clean" if i < 60 else "abusive", 1) for i in range(10, 100)] + [(10, None, 2), (None, "clean", 1)]
    d = _posts(spark, tmp_path / "some", posts + many, labels)
    toxic = {r["post_id"] for r in toxicity.score_posts(spark, d).where("toxic").collect()}
    assert toxic == {3, *range(60, 100)}
