"""Owners of files by the rules of many repositories.

Each rule has one key that every path it matches has, too: its folders up to the first
that holds a wildcard, the name it asks for at any depth, or the ending of such a name. A
path has the keys of all its folders, names and its ending. So rules and paths meet by
equal keys; patterns decide only among those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def glob_pattern(glob: Column) -> Column:
    """The regular expression of a rule's glob; null for empty and negated ones."""
    plain = F.regexp_replace(F.trim(glob), r"\\", "/")
    body = F.regexp_replace(plain, "^/", "")
    folder = body.endswith("/")
    bare = F.regexp_replace(body, "/$", "")
    fixed = plain.startswith("/") | bare.contains("/")
    last = F.element_at(F.split(bare, "/"), -1)
    text = F.regexp_replace(F.when(folder, F.concat(body, F.lit("**"))).otherwise(body), r"([.+^$(){}|\[\]\\#&~-])", r"\\$1")
    for glob_part, pattern in (("**/", "\x01"), ("**", "\x02"), ("*", "[^/]*"), ("?", "[^/]"), ("\x01", "(?:.*/)?"), ("\x02", ".*")):
        text = F.replace(text, F.lit(glob_part), F.lit(pattern))
    below = F.when(folder | last.rlike("[*?]"), "").otherwise("(?:/.*)?")
    return F.when((plain != "") & ~plain.startswith("!"), F.concat(F.when(fixed, "^").otherwise("^(?:.*/)?"), text, below, F.lit("$")))


def _rule_key(glob: Column) -> Column:
    plain = F.regexp_replace(F.trim(glob), r"\\", "/")
    bare = F.regexp_replace(F.regexp_replace(plain, "^/", ""), "/$", "")
    fixed = plain.startswith("/") | bare.contains("/")
    literal = F.regexp_replace(F.regexp_extract(bare, r"^((?:[^/*?]+(?:/|$))*)", 1), "/$", "")
    ending = F.regexp_extract(bare, r"(\.[^.*?/]+)$", 1)
    return F.when(fixed, F.concat(F.lit("under:"), literal)).when(~bare.rlike("[*?]"), F.concat(F.lit("name:"), bare)).when((ending != "") & ~plain.endswith("/"), F.concat(F.lit("ending:"), ending)).otherwise("any")


def _path_keys(path: Column) -> Column:
    parts = F.split(path, "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.lit("under:"), F.array_join(F.slice(parts, F.lit(1), n), "/")))
    names = F.transform(parts, lambda p: F.concat(F.lit("name:"), p))
    ending = F.concat(F.lit("ending:"), F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.array_distinct(F.concat(folders, names, F.array(ending, F.lit("under:"), F.lit("any"))))


def owners_of(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(repository, path, owners) by the last rule of the repository that matches; files that none matches are left out.

    files: repository, path; rules: repository, rule_no, glob, owners. A leading ``./`` of a path has no part in
    the match. Rules without a name, folder or ending of their own (``*``, ``/**``) meet all paths of the repository.
    """
    told = rules.select("repository", "rule_no", "owners", glob_pattern(F.col("glob")).alias("pattern"), _rule_key(F.col("glob")).alias("key")).where("pattern is not null")
    paths = files.select("repository", "path").distinct().withColumn("plain", F.regexp_replace("path", r"^\./", ""))
    keyed = paths.select("repository", "path", "plain", F.explode(_path_keys(F.col("plain"))).alias("key"))
    met = keyed.join(told, ["repository", "key"]).where("plain rlike pattern")
    return met.groupBy("repository", "path").agg(F.max_by("owners", "rule_no").alias("owners"))
