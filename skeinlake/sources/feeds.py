"""Board feeds in JSON: raw bodies, one a row, become posts and summaries of threads.

Bodies are parsed with explicit schemas in which every scalar is text, as feeds write numbers either way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import misc, text

_LYNX_FILE = "struct<original_name:string,filename:string,ext:string,md5:string,sha1:string,size:string,width:string,height:string,thumb:string,file:string>"
_LYNX_POST = (
    "struct<no:string,resto:string,sub:string,com:string,name:string,trip:string,capcode:string,poster_id:string,poster_hash:string,time:string,last_mod:string,country:string,flag:string,"
    f"filename:string,ext:string,w:string,h:string,fsize:string,size:string,tim:string,md5:string,sha1:string,filehash:string,spoiler:string,com_num:string,board:string,sticky:string,locked:string,bumplocked:string,archived:string,files:array<{_LYNX_FILE}>>"
)
_LYNX_THREAD = f"struct<op:{_LYNX_POST},posts:array<{_LYNX_POST}>,last_bump:string,post_count:string,file_count:string,sticky:string,locked:string,archived:string>"
_FUUKA_MEDIA = "struct<media_filename:string,media_link:string,thumb_link:string,media_hash:string,media_size:string,media_w:string,media_h:string,media_status:string,media_orig:string,spoiler:string>"
_FUUKA_POST = (
    "struct<num:string,thread_num:string,subnum:string,timestamp:string,name:string,name_processed:string,trip:string,trip_processed:string,capcode:string,poster_hash:string,poster_hash_processed:string,"
    f"poster_country:string,email:string,title:string,title_processed:string,comment:string,comment_processed:string,sticky:string,locked:string,deleted:string,nreplies:string,nimages:string,media:{_FUUKA_MEDIA}>"
)

#: Columns of a post, whatever the feed.
FILE = "struct<original_filename:string,server_filename:string,ext:string,size_bytes:bigint,width:int,height:int,full_url:string,thumb_url:string,md5:string,sha1:string,spoiler:boolean>"
POST = (
    "struct<native_id:string,thread_id:string,parent_id:string,name:string,tripcode:string,capcode:string,poster_id:string,country:string,flag:string,timestamp:bigint,sage:boolean,subject:string,"
    f"comment_raw:string,quotes:array<struct<board:string,post_id:string>>,files:array<{FILE}>>"
)
SUMMARY = "struct<thread_id:string,subject:string,reply_count:int,file_count:int,sticky:boolean,locked:boolean,archived:boolean,last_bump:bigint>"


def _flag(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("true", "1"), F.lit(False))


def _count(c: Column) -> Column:
    """A count that may be text; unreadable and negative ones are 0."""
    return F.greatest(F.coalesce(misc.tolerant_long(c), F.lit(0).cast("long")), F.lit(0).cast("long"))


def _positive(c: Column) -> Column:
    n = misc.tolerant_long(c)
    return F.when(n > 0, n).cast("int")


def _empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def is_opening(p: Column) -> Column:
    return F.coalesce(F.trim(p["resto"]), F.lit("")).isin("", "0")


def _lynx_files(p: Column, base: Column, board: Column) -> Column:
    full = lambda x: misc.resolve_url(base, _empty(x))
    listed = F.transform(
        p["files"],
        lambda f: F.struct(
            misc.first_text(f["original_name"], f["filename"]).alias("original_filename"), F.regexp_extract(_empty(f["file"]), "([^/]*)$", 1).alias("server_filename"), misc.first_text(f["ext"], misc.extension(_empty(f["file"]))).alias("ext"),
            _count(f["size"]).alias("size_bytes"), _positive(f["width"]).alias("width"), _positive(f["height"]).alias("height"), full(f["file"]).alias("full_url"), full(f["thumb"]).alias("thumb_url"), _empty(f["md5"]).alias("md5"), _empty(f["sha1"]).alias("sha1"), F.lit(False).alias("spoiler"),
        ),
    )
    name = F.concat(_empty(p["tim"]), _empty(p["ext"]))
    at = F.concat_ws("/", F.regexp_replace(base, "/+$", ""), board)
    single = F.array(
        F.struct(
            F.concat(misc.first_text(p["filename"], p["tim"]), _empty(p["ext"])).alias("original_filename"), name.alias("server_filename"), _empty(p["ext"]).alias("ext"), F.greatest(_count(p["fsize"]), _count(p["size"])).alias("size_bytes"), _positive(p["w"]).alias("width"), _positive(p["h"]).alias("height"),
            F.concat_ws("/", at, F.lit("src"), name).alias("full_url"), F.concat_ws("/", at, F.lit("thumb"), F.concat(_empty(p["tim"]), F.lit("s.jpg"))).alias("thumb_url"), misc.first_text(p["md5"], p["filehash"]).alias("md5"), _empty(p["sha1"]).alias("sha1"), _flag(p["spoiler"]).alias("spoiler"),
        )
    )
    none = F.array().cast(f"array<{FILE}>")
    has_one = (_empty(p["tim"]) != "") & (_empty(p["ext"]) != "")
    return F.when(F.size(p["files"]) > 0, listed.cast(f"array<{FILE}>")).when(has_one, single.cast(f"array<{FILE}>")).otherwise(none)


def lynx_post(p: Column, thread: Column, board: Column, base: Column) -> Column:
    """One post of a LynxChan feed in the common form."""
    opening = is_opening(p)
    return F.struct(
        F.trim(p["no"]).alias("native_id"), thread.alias("thread_id"), F.when(opening, "").otherwise(F.trim(p["resto"])).alias("parent_id"), _empty(p["name"]).alias("name"), _empty(p["trip"]).alias("tripcode"), _empty(p["capcode"]).alias("capcode"),
        misc.first_text(p["poster_id"], p["poster_hash"]).alias("poster_id"), _empty(p["country"]).alias("country"), _empty(p["flag"]).alias("flag"), _count(p["time"]).alias("timestamp"), F.coalesce(text.is_sage(p["name"]), F.lit(False)).alias("sage"), _empty(p["sub"]).alias("subject"),
        _empty(p["com"]).alias("comment_raw"), text.extract_quotes(_empty(p["com"])).alias("quotes"), _lynx_files(p, base, board).alias("files"),
    ).cast(POST)


def lynx_thread(raw: DataFrame) -> DataFrame:
    """board, thread_id, post of every post of thread bodies (board, thread_id, base_url, body). Unreadable bodies have none."""
    r = F.from_json("body", f"struct<op:{_LYNX_POST},posts:array<{_LYNX_POST}>>")
    none = F.array().cast(f"array<{_LYNX_POST}>")
    rows = raw.withColumn("r", r).select("board", "thread_id", "base_url", F.explode(F.concat(F.when(F.col("r.op.no").isNotNull(), F.array("r.op")).otherwise(none), F.coalesce("r.posts", none))).alias("p"))
    return rows.where("p.no is not null").select("board", "thread_id", lynx_post(F.col("p"), F.col("thread_id"), F.col("board"), F.col("base_url")).alias("post"))


def lynx_catalog(raw: DataFrame) -> DataFrame:
    """board, summary of every thread of catalog bodies (board, body), each thread once.

    Threads come as an array of threads with posts, a map of threads with an op, or a flat array of posts.
    """
    shaped = raw.select(
        "board", F.from_json("body", f"struct<threads:array<{_LYNX_THREAD}>>").alias("a"), F.from_json("body", f"struct<threads:map<string,{_LYNX_THREAD}>>").alias("b"), F.from_json("body", f"struct<posts:array<{_LYNX_POST}>>").alias("c")
    )
    summary = lambda p, t: F.struct(
        F.trim(p["no"]).alias("thread_id"), _empty(p["sub"]).alias("subject"), F.greatest(_count(t["post_count"]) - 1, F.lit(0).cast("long")).cast("int").alias("reply_count"), _count(t["file_count"]).cast("int").alias("file_count"),
        (_flag(p["sticky"]) | _flag(t["sticky"])).alias("sticky"), (_flag(p["locked"]) | _flag(p["bumplocked"]) | _flag(t["locked"])).alias("locked"), (_flag(p["archived"]) | _flag(t["archived"])).alias("archived"), F.greatest(_count(t["last_bump"]), _count(p["last_mod"])).alias("last_bump"),
    ).cast(SUMMARY)
    a = shaped.select("board", F.explode("a.threads").alias("t")).where("size(t.posts) > 0").select("board", summary(F.col("t.posts")[0], F.col("t")).alias("s"))
    b = shaped.select("board", F.explode(F.map_values("b.threads")).alias("t")).where("t.op.no is not null").select("board", summary(F.col("t.op"), F.col("t")).alias("s"))
    flat = shaped.select("board", F.explode("c.posts").alias("p")).where(is_opening(F.col("p")))
    t = F.struct(F.col("p.last_mod").alias("last_bump"), F.col("p.com_num").alias("post_count"), F.lit(None).cast("string").alias("file_count"), F.lit(None).cast("string").alias("sticky"), F.lit(None).cast("string").alias("locked"), F.lit(None).cast("string").alias("archived"))
    c = flat.select("board", "p", t.alias("t")).select("board", summary(F.col("p"), F.col("t")).alias("s"))
    return a.unionByName(b).unionByName(c).where("s.thread_id <> ''").groupBy("board", "s.thread_id").agg(F.max("s").alias("summary")).select("board", "summary")


def fuuka_boards(raw: DataFrame) -> DataFrame:
    """code, title, nsfw of every board of a FoolFuuka archive's list (body)."""
    board = "struct<shortname:string,name:string,is_nsfw:string>"
    r = F.from_json("body", f"struct<archives:map<string,{board}>,boards:map<string,{board}>>")
    both = F.explode(F.concat(F.coalesce(F.map_values("r.archives"), F.array().cast(f"array<{board}>")), F.coalesce(F.map_values("r.boards"), F.array().cast(f"array<{board}>")))).alias("b")
    return raw.withColumn("r", r).select(both).where("b.shortname <> ''").select(F.col("b.shortname").alias("code"), _empty(F.col("b.name")).alias("title"), _flag(F.col("b.is_nsfw")).alias("nsfw")).distinct()


def fuuka_index(raw: DataFrame) -> DataFrame:
    """board, summary of every thread of index pages (board, body); all listed threads are archived."""
    rows = raw.select("board", F.explode(F.from_json("body", f"map<string,struct<op:{_FUUKA_POST}>>")).alias("n", "t")).select("board", F.col("t.op").alias("p"))
    return rows.where("p.num is not null").select(
        "board",
        F.struct(F.col("p.num").alias("thread_id"), misc.first_text(F.col("p.title_processed"), F.col("p.title")).alias("subject"), _count(F.col("p.nreplies")).cast("int").alias("reply_count"), _count(F.col("p.nimages")).cast("int").alias("file_count"), _flag(F.col("p.sticky")).alias("sticky"), _flag(F.col("p.locked")).alias("locked"), F.lit(True).alias("archived"), _count(F.col("p.timestamp")).alias("last_bump")).cast(SUMMARY).alias("summary"),
    )


def fuuka_post(p: Column) -> Column:
    """One post of a FoolFuuka feed in the common form. Media count if they have a link and are available."""
    m = p["media"]
    there = (_empty(m["media_link"]) != "") & F.lower(_empty(m["media_status"])).isin("normal", "available")
    file = F.array(
        F.struct(
            _empty(m["media_filename"]).alias("original_filename"), misc.first_text(m["media_orig"], F.regexp_extract(_empty(m["media_link"]), "([^/]*)$", 1)).alias("server_filename"), misc.extension(_empty(m["media_link"])).alias("ext"), _count(m["media_size"]).alias("size_bytes"), _positive(m["media_w"]).alias("width"), _positive(m["media_h"]).alias("height"),
            m["media_link"].alias("full_url"), _empty(m["thumb_link"]).alias("thumb_url"), F.coalesce(misc.hex_of_base64(m["media_hash"]), F.lit("")).alias("md5"), F.lit("").alias("sha1"), _flag(m["spoiler"]).alias("spoiler"),
        )
    ).cast(f"array<{FILE}>")
    thread = _empty(p["thread_num"])
    return F.struct(
        p["num"].alias("native_id"), thread.alias("thread_id"), F.when((p["num"] != thread) & (thread != ""), thread).otherwise("").alias("parent_id"), misc.first_text(p["name_processed"], p["name"]).alias("name"), misc.first_text(p["trip_processed"], p["trip"]).alias("tripcode"), _empty(p["capcode"]).alias("capcode"),
        misc.first_text(p["poster_hash_processed"], p["poster_hash"]).alias("poster_id"), _empty(p["poster_country"]).alias("country"), F.lit("").alias("flag"), _count(p["timestamp"]).alias("timestamp"), F.coalesce(text.is_sage(p["email"]) | text.is_sage(p["name"]), text.is_sage(p["email"]), text.is_sage(p["name"]), F.lit(False)).alias("sage"),
        misc.first_text(p["title_processed"], p["title"]).alias("subject"), _empty(p["comment"]).alias("comment_raw"), text.extract_quotes(_empty(p["comment"])).alias("quotes"), F.when(there, file).otherwise(F.array().cast(f"array<{FILE}>")).alias("files"),
    ).cast(POST)


def fuuka_thread(raw: DataFrame) -> DataFrame:
    """board, thread_id, post of thread bodies (board, thread_id, body). An error in place of a thread means none was found;
    ghost posts and the opening post's repetition are left out."""
    kind = f"map<string,struct<op:{_FUUKA_POST},posts:map<string,{_FUUKA_POST}>>>"
    rows = raw.withColumn("t", F.try_element_at(F.from_json("body", kind), F.col("thread_id"))).where("t is not null")
    op = rows.where("t.op.num is not null").select("board", "thread_id", F.col("t.op").alias("p"))
    rest = rows.select("board", "thread_id", F.explode(F.map_values("t.posts")).alias("p")).where("coalesce(p.subnum, '') in ('', '0') and p.num <> thread_id")
    return op.unionByName(rest).select("board", "thread_id", fuuka_post(F.col("p")).alias("post"))
