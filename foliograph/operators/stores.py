"""Chat sessions, saved searches, logs and folders as table rewrites (snapshots in, snapshots out)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import class_and_value


def sessions(messages: DataFrame) -> DataFrame:
    """(session_id, messages, created_at, updated_at), the latest first."""
    out = messages.groupBy("session_id").agg(F.count("*").alias("messages"), F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"))
    return out.orderBy(F.desc("updated_at"), "session_id")


def create_session(table: DataFrame, session_id: str, title: str, at: Column) -> DataFrame:
    """The sessions with a new one (session_id, title, created_at, updated_at); a known id is left as it is."""
    spark = table.sparkSession
    fresh = spark.createDataFrame([(session_id, title.strip())], "session_id string, title string").withColumns({"created_at": at, "updated_at": at})
    return table.unionByName(fresh.join(table.select("session_id"), "session_id", "left_anti").select(*table.columns))


def append_messages(table: DataFrame, messages: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions and messages after new messages: those of unknown sessions are left out, sessions are as late as their last one."""
    known = append_answer(messages, fresh, table)
    latest = fresh.groupBy("session_id").agg(F.max("created_at").alias("_at"))
    later = table.join(latest, "session_id", "left").withColumn("updated_at", F.greatest("updated_at", "_at")).select(*table.columns)
    return later, known


def rename_session(table: DataFrame, session_id: str, title: str) -> DataFrame:
    if not title.strip():
        raise ValueError("a title has characters")
    return table.withColumn("title", F.when(F.col("session_id") == session_id, F.lit(title.strip())).otherwise(F.col("title")))


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with `rows` in place of those with their keys."""
    return table.join(rows.select(key), key, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def remove(table: DataFrame, key: str, value) -> DataFrame:
    return table.where(F.col(key) != value)


def valid_message(text: Column) -> Column:
    return F.octet_length(F.trim(text)).between(1, 4000)


def append_answer(messages: DataFrame, answer: DataFrame, session_table: DataFrame) -> DataFrame:
    """Messages with answers of existing sessions appended."""
    return messages.unionByName(answer.join(session_table.select("session_id"), "session_id", "left_semi").select(*messages.columns))


def valid_saved_search(saved: DataFrame) -> DataFrame:
    """Saved searches with a name; their `Class:value` entities must all be well-formed."""
    good = F.forall(F.coalesce(F.col("entities"), F.expr("cast(array() as array<string>)")), lambda e: e.rlike("^[^:]+:.+$"))
    return saved.where((F.trim("name") != "") & good)


def saved_filters(saved: DataFrame) -> DataFrame:
    """(id, filter_no, class, value): the entity filters of saved searches (`entities`: array of `Class:value`)."""
    each = saved.select("id", F.posexplode("entities").alias("filter_no", "key")).withColumn("f", class_and_value(F.col("key")))
    return each.where("f is not null").select("id", "filter_no", "f.*")


def log_activity(log: DataFrame, action: str, subject: str, at: Column) -> DataFrame:
    """The log with one more row, numbered on."""
    following = log.agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("seq"))
    return log.unionByName(following.select("seq", F.lit(action).alias("action"), F.lit(subject).alias("subject"), at.alias("ts")))


def folder_status(folders: DataFrame) -> DataFrame:
    return folders.withColumn("status", F.when(F.col("is_paused"), "paused").otherwise("watching"))


def accumulate_tokens(frames: DataFrame) -> DataFrame:
    """(message_id, content, state): tokens joined in order up to the first terminal frame."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "kind", "token")))
    grouped = frames.groupBy("message_id").agg(ordered.alias("f"))
    ended = F.filter("f", lambda x: x["kind"] != "token")
    stop = F.when(F.size(ended) > 0, F.get(ended, F.lit(0))["seq"])
    tokens = F.filter("f", lambda x: (x["kind"] == "token") & (stop.isNull() | (x["seq"] < stop)))
    return grouped.select("message_id", F.array_join(F.transform(tokens, lambda x: x["token"]), "").alias("content"), F.coalesce(F.get(ended, F.lit(0))["kind"], F.lit("open")).alias("state"))
