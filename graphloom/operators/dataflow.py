"""Data flow read off literal call arguments: SQL tables, topics, cache keys, external hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Method names and parts of receiver names.
SQL_METHODS = ["query", "querycontext", "queryrow", "queryrowcontext", "select", "get", "exec", "execcontext", "namedexec"]
WRITES = ["INSERT", "UPDATE", "DELETE", "REPLACE"]
MESSAGE_RECEIVERS = "kafka|broker|producer|publisher|consumer|subscriber|event|queue"
CACHE_METHODS = ["get", "mget", "set", "mset", "del", "delete"]
HTTP_METHODS = ["get", "post", "head", "do", "request", "newrequest", "newrequestwithcontext"]
TABLES = r"(?i)\b(?:FROM|JOIN|INTO|UPDATE)\s+([a-zA-Z_][a-zA-Z0-9_.]*)"


def table_names(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TABLES), F.lit(1))


def operation(text: Column) -> Column:
    return F.upper(F.regexp_extract(text, r"^\s*(\S+)", 1))


def sql_tables(rows: DataFrame) -> DataFrame:
    """(id, name, kind) of each table that a statement (id, text) names; its first word decides the kind for all."""
    kind = F.when(operation(F.col("text")).isin(WRITES), "writes").otherwise("reads")
    names = rows.select("id", kind.alias("kind"), F.explode(table_names(F.col("text"))).alias("name"))
    return names.where(F.lower("name") != "set").select("id", "name", "kind").distinct()


def classify_calls(calls: DataFrame) -> DataFrame:
    """(id, kind, target_kind, target, label, boundary) of calls (id, receiver, method, values, http).

    ``values`` are the literal strings among the arguments, in order; ``http``
    tells whether the receiver is an HTTP package. The classes are tried in the
    order SQL, message, cache, HTTP; the first that hits is the only one.
    """
    receiver, method = F.lower("receiver"), F.lower("method")
    low = lambda f: F.get(F.filter("values", f), F.lit(0))
    statement = F.when(method.isin(SQL_METHODS), low(lambda v: F.size(table_names(v)) > 0))
    messaging = receiver.rlike(MESSAGE_RECEIVERS)
    sends = (method.isin("publish", "produce")) | messaging & method.isin("send", "sendmessage")
    receives = (method.isin("subscribe", "consume")) | messaging & (method == "receive")
    topic = F.when(sends | receives, low(lambda v: (v != "") & ~v.rlike(r"[ /\\]")))
    key = F.when(receiver.rlike("cache|redis") & method.isin(CACHE_METHODS), low(lambda v: (v != "") & (F.octet_length(v) <= 120)))
    url = F.when(method.isin(HTTP_METHODS) & (F.coalesce("http", F.lit(False)) | receiver.rlike("http|client")), low(lambda v: v.rlike(r"^https?://[^/?#]")))
    host = F.regexp_extract("url", r"^https?://(?:[^/?#@]*@)?([^/?#]*)", 1)
    rows = calls.select("id", method.alias("m"), F.col("method").alias("name"), statement.alias("statement"), topic.alias("topic"), sends.alias("sends"), key.alias("key"), url.alias("url"))
    hit = lambda kind, what, target, label, boundary: F.struct(kind.alias("kind"), F.lit(what).alias("target_kind"), target.alias("target"), label.alias("label"), F.lit(boundary).alias("boundary"))
    op = operation(F.col("statement"))
    sql = F.transform(F.filter(table_names(F.col("statement")), lambda n: F.lower(n) != "set"), lambda n: hit(F.when(op.isin(WRITES), "writes").otherwise("reads"), "table", n, op, "persistence"))
    found = (
        F.when(F.col("statement").isNotNull(), sql)
        .when(F.col("topic").isNotNull(), F.array(hit(F.when(F.col("sends"), "publishes").otherwise("consumes"), "topic", F.col("topic"), F.col("name"), "async")))
        .when(F.col("key").isNotNull(), F.array(hit(F.when(F.col("m").isin("get", "mget"), "reads").otherwise("writes"), "cache", F.col("key"), F.col("name"), "persistence")))
        .when(F.col("url").isNotNull(), F.array(hit(F.lit("calls"), "external", host, F.upper("m"), "network")))
    )
    return rows.select("id", F.explode(found).alias("f")).select("id", "f.*").distinct()
