"""Feeds and pages become the common form."""

import json

from skeinlake.sources import feeds, files, pages

BASE = "https://b.example"


def raw(spark, body, board="tech", thread="100", platform="fourchan"):
    text = body if isinstance(body, str) else json.dumps(body)
    return spark.createDataFrame([(platform, board, thread, BASE, text)], "platform string, board string, thread_id string, base_url string, body string")


def test_lynx_thread(spark):
    body = {"op": {"no": 100, "sub": "title", "com": "&gt;&gt;7 hi", "time": "1700000000", "tim": "1700000000001", "ext": ".png", "fsize": 10, "w": 5, "h": "6"},
            "posts": [{"no": "101", "resto": "100", "com": ">>>/b/9 x", "name": "sage", "time": 0, "files": [{"original_name": "a.jpg", "file": "/f/1.jpg", "thumb": "/f/1t.jpg", "size": 7, "width": 0}]}, {"sub": "no number"}]}
    got = {r["post"]["native_id"]: r["post"] for r in feeds.lynx_thread(raw(spark, body)).collect()}
    assert set(got) == {"100", "101"}
    op, reply = got["100"], got["101"]
    assert op["subject"] == "title" and op["timestamp"] == 1700000000 and op["parent_id"] == "" and op["quotes"][0]["post_id"] == "7"
    assert op["files"][0]["full_url"] == f"{BASE}/tech/src/1700000000001.png" and op["files"][0]["width"] == 5 and op["files"][0]["height"] == 6
    assert reply["parent_id"] == "100" and reply["sage"] and reply["quotes"][0]["board"] == "b"
    assert reply["files"][0]["full_url"] == f"{BASE}/f/1.jpg" and reply["files"][0]["width"] is None


def test_lynx_catalog_shapes(spark):
    a = {"threads": [{"posts": [{"no": 1, "sub": "A"}], "last_bump": 5, "post_count": 3, "sticky": True}]}
    b = {"threads": {"2": {"op": {"no": "2", "sub": "B"}, "post_count": "1"}}}
    c = {"posts": [{"no": 3, "resto": 0, "com_num": 4, "last_mod": "9"}, {"no": 4, "resto": 3}, {"no": 3, "resto": "0", "com_num": 4, "last_mod": "9"}]}
    for body, want in ((a, ("1", "A", 2, True, 5)), (b, ("2", "B", 0, False, 0)), (c, ("3", "", 3, False, 9))):
        rows = feeds.lynx_catalog(raw(spark, body)).collect()
        s = rows[0]["summary"]
        assert len(rows) == 1 and (s["thread_id"], s["subject"], s["reply_count"], s["sticky"], s["last_bump"]) == want
    assert feeds.lynx_catalog(raw(spark, "<html>")).count() == 0


def test_fuuka(spark):
    op = {"num": "100", "thread_num": "100", "title": "t", "timestamp": 5, "sticky": "1", "comment": ">>1", "media": {"media_link": "https://m/x.png", "media_hash": "7x33r4Dr/BBulWWaaL71Yg==", "media_status": "normal", "media_size": "12"}}
    ghost = {"num": "100", "subnum": "1", "thread_num": "100"}
    gone = {"num": "102", "subnum": "0", "thread_num": "100", "email": "sage", "media": {"media_link": "https://m/y.png", "media_status": "banned"}}
    body = {"100": {"op": op, "posts": {"101": ghost, "102": gone, "100": op}}}
    got = {r["post"]["native_id"]: r["post"] for r in feeds.fuuka_thread(raw(spark, body)).collect()}
    assert set(got) == {"100", "102"}
    assert got["100"]["files"][0]["md5"] == "ef1df7af80ebfc106e95659a68bef562" and got["100"]["parent_id"] == ""
    assert got["102"]["files"] == [] and got["102"]["sage"] and got["102"]["parent_id"] == "100"
    assert feeds.fuuka_thread(raw(spark, {"error": "Thread not found."})).count() == 0
    s = feeds.fuuka_index(raw(spark, {"100": {"op": {**op, "nreplies": 3}}})).first()["summary"]
    assert s["archived"] and s["sticky"] and s["reply_count"] == 3
    boards = feeds.fuuka_boards(raw(spark, {"archives": {"1": {"shortname": "g", "name": "Tech", "is_nsfw": False}}, "boards": {}})).collect()
    assert [tuple(b) for b in boards] == [("g", "Tech", False)]


FOURCHAN = """<div class="post op" id="p7321"><span class="subject">moss &amp; oak</span><span class="name">Anon</span><span class="postertrip">!!x</span><span class="dateTime" data-utc="1710000123">x</span>
<div class="fileText">File: <a href="//i.4cdn.org/g/9050.png">blue kettle.png</a> (81 KB, 640x211)</div><a class="fileThumb" href="//i.4cdn.org/g/9050.png"><img src="//i.4cdn.org/g/9050s.jpg" data-md5="7x33r4Dr/BBulWWaaL71Yg=="></a>
<blockquote class="postMessage">Slow<br>water</blockquote></div>
<div class="post reply" id="p7344"><span class="name">sage</span><blockquote class="postMessage"><a href="#p7321" class="quotelink">&gt;&gt;7321</a> yes</blockquote></div><div class="post">none</div>"""
VICHAN = """<div class="post op" id="op_612"><div class="file"><p class="fileinfo">40.5 KB, 300x77</p><a href="/a/src/88.jpg"><img class="post-image" src="/a/thumb/88.webp"></a></div>
<p class="intro"><span class="subject">Caf&eacute;</span> <span class="name">W</span> <time datetime="2024-02-01T10:20:30Z">x</time></p><div class="body">s&iacute;</div></div>"""


def test_pages(spark):
    got = [r["post"] for r in pages.parse_threads(raw(spark, FOURCHAN, "g", "7321")).collect()]
    assert [p["native_id"] for p in got] == ["7321", "7344"]
    op, f = got[0], got[0]["files"][0]
    assert op["subject"] == "moss & oak" and op["tripcode"] == "!!x" and op["timestamp"] == 1710000123 and op["comment_raw"] == "Slow<br>water"
    assert (f["full_url"], f["thumb_url"], f["size_bytes"], f["width"], f["height"], f["original_filename"]) == ("https://i.4cdn.org/g/9050.png", "https://i.4cdn.org/g/9050s.jpg", 81 * 1024, 640, 211, "blue kettle.png")
    assert f["md5"] == "ef1df7af80ebfc106e95659a68bef562"
    assert got[1]["parent_id"] == "7321" and got[1]["sage"] and got[1]["quotes"][0]["post_id"] == "7321"
    v = pages.parse_threads(raw(spark, VICHAN, "a", "612", "vichan")).first()["post"]
    assert v["native_id"] == "612" and v["subject"] == "Café" and v["timestamp"] == 1706782830
    assert v["files"][0]["full_url"] == f"{BASE}/a/src/88.jpg" and v["files"][0]["size_bytes"] == int(40.5 * 1024)
    assert pages.parse_threads(raw(spark, "garbage < <<")).count() == 0
    assert pages.single_post('<div class="post" data-no="1" data-time="1"><span class="name">x</span><div class="com">hi</div></div>', "vichan")["name"] == "x"


def test_page_catalogs(spark):
    html = """<div class="thread"><div class="post op" data-no="501" data-time="5"><span class="subject">S</span><div class="com">40 replies? no.</div></div><div class="threadstats">17 Replies / 9 Images</div></div>
    <div class="thread"><div class="post op" data-no="777"><div class="com">x</div></div><span class="replies">6 posts and 2 images omitted.</span></div><div class="thread">empty</div>"""
    got = {r["thread_id"]: r["summary"] for r in pages.parse_catalogs(raw(spark, html, platform="vichan")).collect()}
    assert {k: (s["reply_count"], s["file_count"]) for k, s in got.items()} == {"501": (17, 9), "777": (6, 2)}
    assert got["501"]["last_bump"] == 5


def test_pages_without_a_machine_readable_time(spark):
    html = '<div class="post reply" id="reply_9"><p class="intro"><span class="name">W</span> 06/12/24 (Vie) 09:15:20 No. 9</p><div class="body">x 01/02/03 (Sun) 04:05</div></div>'
    assert pages.parse_threads(raw(spark, html, "a", "5", "vichan")).first()["post"]["timestamp"] == 1733476520
    assert pages._shown_time("30-01-25 18:22") == 1738261320 and pages._shown_time("2024/11/05 (Mar) 21:03:40") == 1730840620
    assert pages._shown_time("") == 0 and pages._shown_time("99/99/24 (Sun) 10:00") == 0


def test_lynx_boards_that_serve_pages(spark):
    html = '<div class="thread"><div class="post op" data-no="31" data-time="7"><div class="body">hi</div></div><span class="summary">4 posts, 1 file</span></div>'
    both = raw(spark, html).unionByName(raw(spark, {"threads": [{"posts": [{"no": 8}], "post_count": 2}]}))
    got = {r["summary"]["thread_id"]: (r["summary"]["reply_count"], r["summary"]["file_count"]) for r in pages.lynx_catalog(both).collect()}
    assert got == {"31": (4, 1), "8": (1, 0)}
    both = raw(spark, html, thread="31").unionByName(raw(spark, {"posts": [{"no": 8}]}))
    assert {r["post"]["native_id"] for r in pages.lynx_thread(both).collect()} == {"31", "8"}


def test_files(spark, tmp_path):
    (tmp_path / "hashes").write_text("# list\nABC \n\nabc\ndef\n")
    assert sorted(r[0] for r in files.hash_list(spark, str(tmp_path / "hashes")).collect()) == ["abc", "def"]
    (tmp_path / "cases.csv").write_text('query_text,relevant_ids\nq,"1, 2,x"\n')
    assert sorted(r[1] for r in files.evaluation_cases(spark, str(tmp_path / "cases.csv")).collect()) == [1, 2]
    pairs = spark.createDataFrame([("a", "b"), ("c", None)], "anchor string, positive string")
    files.write_pairs(pairs, str(tmp_path / "pairs"))
    assert [tuple(r) for r in files.pairs(spark, str(tmp_path / "pairs")).collect()] == [("a", "b")]
    from datetime import datetime

    raw_rows = spark.createDataFrame([(1, "u", 200, bytearray(b"abc"), datetime(2024, 1, 2))], "site_id long, url string, status_code int, body binary, fetched_at timestamp_ntz")
    files.append_captures(files.captures(raw_rows, "1"), str(tmp_path / "log"))
    row = spark.read.parquet(str(tmp_path / "log")).first()
    assert row["content_length"] == 3 and row["body_sha256"].startswith("ba7816bf") and str(row["fetched_on"]) == "2024-01-02"
    judged = files.cases_with_judgements(spark.createDataFrame([(1, "q"), (2, "r")], "id long, query_text string"), spark.createDataFrame([(1, 5, 2)], "query_id long, post_id long, grade int"))
    assert {r["id"]: r["judged"] for r in judged.collect()} == {1: {5: 2}, 2: {}}
