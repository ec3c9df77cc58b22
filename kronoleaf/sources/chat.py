"""Chat exports and calls as DataFrame transformations over text lines.

An export is lines: a date header sets the day of the messages below it, a message
line has a time, a sender and a text between tabs, and any other line continues a
text message above it. State is a window over each file's lines, so files are
independent; a message's own continuation lines are folded, since each may change
the message's type, and with it what the next line means.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.timeutil import duration_seconds

#: Fixed values of the export format: three forms of a date line, what may follow the date in each, and a message line.
DATE_FORMS = [("/", r"(\(.+\))?"), ("-", r"(\s+.+)?"), (".", r"(\s+.+)?")]
MESSAGE_LINE = r"^(\d{1,2}):(\d{2})\t([^\t]+)\t(.*)$"
#: Bracketed tokens and their kinds, the file prefix, senders and phrases of the system, and folders that name no chat.
TOKENS = {"[写真]": "image", "[画像]": "image", "[photo]": "image", "[image]": "image", "[動画]": "video", "[video]": "video", "[スタンプ]": "sticker", "[sticker]": "sticker", "[file]": "file"}
FILE_PREFIX, SYSTEM_SENDERS = "[ファイル]", ["line", "system"]
SYSTEM_PHRASES = ["メッセージの送信を取り消しました", "通話をキャンセルしました", "不在着信", "招待しました", "退出しました", "参加しました"]
GENERIC_FOLDERS = ["line", "raw", "data", "fixtures", "exports", "talk", "talks"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, line_number, line) of text files; a byte-order mark is dropped."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), F.regexp_replace("value", "^﻿", "").alias("value"))
    return whole.select("source_file", F.posexplode(F.split("value", r"\r?\n")).alias("line_number", "line")).withColumn("line_number", F.col("line_number") + 1)


def header_date(line: Column) -> Column:
    """The date of a date line, or null where it is none or no day of the calendar."""
    text, found = F.trim(line), F.lit(None).cast("date")
    for mark, rest in reversed(DATE_FORMS):
        form = rf"^(\d{{4}})[{mark}](\d{{1,2}})[{mark}](\d{{1,2}}){rest}$"
        part = lambda i, form=form: F.regexp_extract(text, form, i)
        day = F.try_to_date(F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")), "yyyy-MM-dd")
        found = F.when(F.rlike(text, F.lit(form)), day).otherwise(found)
    return found


def message_type(sender: Column, text: Column, kinds: dict[str, str] | None = None) -> Column:
    """system, unknown, image, video, sticker, file or text; `kinds` are tokens beside the known ones."""
    body = F.trim(text)
    out = F.when(F.startswith(body, F.lit("[")) & F.endswith(body, F.lit("]")), "unknown").otherwise("text")
    out = F.when(reduce(lambda a, b: a | b, [F.contains(body, F.lit(p)) for p in SYSTEM_PHRASES]), "system").otherwise(out)
    out = F.when(F.startswith(body, F.lit(FILE_PREFIX)), "file").otherwise(out)
    for token, kind in reversed(list((TOKENS | (kinds or {})).items())):
        out = F.when(body == token, kind).otherwise(out)
    out = F.when(body == "", "unknown").otherwise(out)
    return F.when(F.lower(F.trim(F.coalesce(sender, F.lit("")))).isin(SYSTEM_SENDERS), "system").otherwise(out)


def chat_id(path: Column) -> Column:
    """A digest of the folder's name, or of the file's where the folder's says nothing."""
    parts = F.split(path, "/")
    parent = F.trim(F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("")))
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    seed = F.when((parent != "") & ~F.lower(parent).isin(GENERIC_FOLDERS), parent).otherwise(stem)
    return F.concat(F.lit("line_"), F.substring(F.sha2(seed, 256), 1, 16))


def message_id(source: Column, sent_at: Column, sender: Column, text: Column) -> Column:
    return F.concat(F.lit("line_msg_"), F.sha2(F.concat_ws("\x1f", source, sent_at, sender, text), 256))


def _grouped(lines: DataFrame, kinds: dict[str, str] | None) -> DataFrame:
    """One row a head (a date line, a message line, or what comes before the first) with its following lines folded.

    (source_file, head, line_number, day, time parts, sender, text, extra, warned): `head` is date, message, bad_time or
    none; `warned` are the numbers of lines that belong to nothing, with their reasons.
    """
    w = Window.partitionBy("source_file").orderBy("line_number")
    rows = lines.where(F.trim("line") != "").withColumn("date", header_date(F.col("line")))
    rows = rows.withColumn("day", F.last("date", ignorenulls=True).over(w))
    part = lambda i: F.regexp_extract("line", MESSAGE_LINE, i)
    is_message = F.rlike("line", F.lit(MESSAGE_LINE)) & F.col("day").isNotNull() & F.col("date").isNull()
    ok = (part(1).cast("int") < 24) & (part(2).cast("int") < 60)
    head = F.when(F.col("date").isNotNull(), "date").when(is_message, F.when(ok, "message").otherwise("bad_time"))
    rows = rows.withColumn("head", head).withColumn("group", F.count("head").over(w))
    first = F.min_by(F.struct("line_number", "day", "line", "head"), "line_number").alias("first")
    later = F.array_sort(F.collect_list(F.struct("line_number", "line", "head"))).alias("all")
    got = rows.groupBy("source_file", "group").agg(first, later)
    line, at = F.col("first.line"), lambda i: F.regexp_extract("first.line", MESSAGE_LINE, i)
    got = got.select("source_file", F.coalesce("first.head", F.lit("none")).alias("head"), "first.line_number", "first.day", at(1).alias("hour"), at(2).alias("minute"), F.trim(at(3)).alias("sender"), F.trim(at(4)).alias("first_text"), F.filter("all", lambda x: x.head.isNull()).alias("more"), line.alias("line"))
    start = F.struct(F.col("first_text").alias("text"), F.array().cast("array<struct<line_number:int,reason:string>>").alias("warned"))

    def step(acc, x):
        warn = lambda reason: F.concat(acc.warned, F.array(F.struct(x.line_number.cast("int").alias("line_number"), F.lit(reason).alias("reason"))))
        stray = F.struct(acc.text.alias("text"), warn("unparsed line").alias("warned"))
        special = F.struct(acc.text.alias("text"), warn("unparsed line after special message").alias("warned"))
        joined = F.struct(F.concat_ws("\n", acc.text, F.rtrim(x.line)).alias("text"), acc.warned.alias("warned"))
        return F.when(F.col("head") != "message", stray).when(message_type(F.col("sender"), acc.text, kinds) == "text", joined).otherwise(special)

    return got.withColumn("state", F.aggregate("more", start, step))


def parse(lines: DataFrame, kinds: dict[str, str] | None = None, zone: str = "+09:00") -> DataFrame:
    """(source_file, line_number, id, chat_id, sent_at, sender, text, message_type) of all messages."""
    rows = _grouped(lines, kinds).where("head = 'message'").withColumn("text", F.col("state.text"))
    clock = F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit("T"), F.lpad("hour", 2, "0"), F.lit(":"), F.col("minute"), F.lit(":00"))
    name = F.element_at(F.split("source_file", "/"), -1)
    at = F.to_timestamp_ntz(clock, F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    return rows.select("source_file", "line_number", message_id(name, F.concat(clock, F.lit(zone)), F.col("sender"), F.col("text")).alias("id"), chat_id(F.col("source_file")).alias("chat_id"), at.alias("sent_at"), "sender", "text", message_type(F.col("sender"), F.col("text"), kinds).alias("message_type"))


def warnings(lines: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """(source_file, line_number, reason) of lines that are no part of a message: unparsed line,
    unparsed line after special message, and invalid datetime."""
    rows = _grouped(lines, kinds)
    bad = rows.where("head = 'bad_time'").select("source_file", F.col("line_number").cast("int").alias("line_number"), F.lit("invalid datetime").alias("reason"))
    return rows.select("source_file", F.inline("state.warned")).union(bad)


def calls(messages: DataFrame, marker: str, statuses: dict[str, str]) -> DataFrame:
    """Messages that begin with the call marker, with status and duration in seconds."""
    text = F.col("text")
    seconds = duration_seconds(F.regexp_extract(text, r"(\d{1,3}:\d{2}(?::\d{2})?)", 1))
    status = F.when(F.rlike(text, F.lit(r"\d{1,3}:\d{2}")), "completed")
    for word, name in statuses.items():
        status = status.when(F.contains(text, F.lit(word)), name)
    return messages.where(F.startswith(text, F.lit(marker))).withColumn("duration_sec", seconds).withColumn("call_status", status.otherwise("unknown"))


def call_index(messages: DataFrame, marker: str, statuses: dict[str, str], existing: DataFrame | None = None) -> DataFrame:
    """(message_id, chat_id, sent_at, sender, call_status, duration_sec, raw_text_short), the newest reading of each message."""
    short = F.regexp_replace(F.trim("text"), r"\s+", " ")
    made = calls(messages, marker, statuses).select(F.col("id").alias("message_id"), "chat_id", "sent_at", "sender", "call_status", "duration_sec", F.when(F.length(short) > 60, F.concat(F.substring(short, 1, 57), F.lit("..."))).otherwise(short).alias("raw_text_short"))
    return made if existing is None else made.unionByName(existing.join(made.select("message_id"), "message_id", "left_anti"))


def search_calls(index: DataFrame, *, status: str | None = None, least_sec: int | None = None, date_from: str | None = None, date_to: str | None = None, most: int = 50) -> DataFrame:
    """Calls by status, length and dates; the longest first where length or completion is asked for, else the earliest."""
    day = F.substring("sent_at", 1, 10)
    tests = [F.lit(True)]
    tests += [F.col("call_status") == status] if status else []
    tests += [F.col("duration_sec") >= least_sec] if least_sec is not None else []
    tests += [day >= date_from] if date_from else []
    tests += [day <= date_to] if date_to else []
    order = [F.desc_nulls_last("duration_sec")] if least_sec is not None or status == "completed" else []
    return index.where(reduce(lambda a, b: a & b, tests)).orderBy(*order, "sent_at", "message_id").limit(most)


def append_new(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Existing rows and those incoming ones whose key is new; repeated keys count once."""
    return existing.unionByName(incoming.dropDuplicates([key]).join(existing.select(key), key, "left_anti").select(*existing.columns))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], updated: str) -> DataFrame:
    """The newest row of each key; incoming rows win equal times."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    best = both.groupBy(*keys).agg(F.max(F.struct(updated, "__new", *[c for c in existing.columns if c not in (*keys, updated)])).alias("r"))
    return best.select(*[c if c in keys else F.col(f"r.{c}").alias(c) for c in existing.columns])
