"""Crawler tables: sitemaps, robots rules, links, frontier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.functions import html as H
from glosswork.session import cut, exists


def sitemap_urls(files: DataFrame) -> DataFrame:
    """(source, url) of (source, body): lines that hold one ``loc`` element and nothing else."""
    line = files.select("source", F.explode(F.split("body", "\n")).alias("line"))
    return line.select("source", F.regexp_extract(F.trim("line"), r"^<loc>(.*)</loc>$", 1).alias("url")).where("url <> ''")


def sitemap_tree(files: DataFrame, roots: DataFrame, start: str = "", disallowed: list[str] | None = None) -> DataFrame:
    """(url): the pages that the sitemaps ``roots`` (url) name, through all the sitemaps that they name in turn.

    ``files`` (source, body) holds the sitemaps that were fetched, by url. A url that is allowed (see ``allowed_links``) and has ``sitemap`` in it is followed, level by
    level and each once, so rings end; what was not fetched names nothing. Each level is written to the shared folder.
    """
    level = cut(roots.select("url").where("url is not null").distinct())
    seen, pages = level, None
    while not level.isEmpty():
        bodies = files.join(level.select(F.col("url").alias("source")), "source", "left_semi")
        named = cut(allowed_links(sitemap_urls(bodies).select("url"), start, disallowed or []).distinct())
        nested = F.lower("url").contains("sitemap")
        found = named.where(~nested)
        pages = found if pages is None else pages.union(found)
        level = cut(named.where(nested).join(seen, "url", "left_anti"))
        seen = seen.union(level)
    return roots.select("url").where("false") if pages is None else pages.distinct()


def robots_rules(files: DataFrame) -> DataFrame:
    """(source, rule, value) of (source, body): Disallow, Allow, Crawl-delay and Sitemap lines; user agents are not told apart."""
    line = files.select("source", F.explode(F.split("body", "\n")).alias("line"))
    rule = F.regexp_extract("line", r"^(Disallow|Allow|Crawl-delay|Sitemap):", 1)
    return line.select("source", rule.alias("rule"), F.trim(F.regexp_extract("line", r"^[A-Za-z-]+:(.*)$", 1)).alias("value")).where("rule <> ''")


def path_of(url: Column) -> Column:
    """The path of an absolute url, / if it has none."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, url): the links of (page_id, html), each once per page."""
    return pages.select("page_id", F.explode(H.links(F.col("html"))).alias("url"))


def allowed_links(links: DataFrame, start: str, disallowed: list[str]) -> DataFrame:
    """The links that begin with ``start`` and whose path begins with none of the rules; an empty rule forbids nothing."""
    path = path_of(F.col("url"))
    ok = F.col("url").startswith(start)
    for rule in disallowed:
        if rule:
            ok = ok & ~path.startswith(rule)
    return links.where(ok)


def new_urls(found: DataFrame, frontier: DataFrame) -> DataFrame:
    """(url): found urls that the frontier does not hold, each once; null and empty ones are no urls."""
    known = frontier.select("url").where("url is not null").distinct()
    return found.select("url").where("url <> ''").distinct().join(known, "url", "left_anti")


def crawl_round(frontier: DataFrame, pages: DataFrame, start: str, disallowed: list[str]) -> tuple[DataFrame, DataFrame]:
    """(records, frontier) after one round over the pending urls of ``frontier`` (url, status) that are allowed.

    ``pages`` (page_id, url, html) holds what can be fetched. Pages read become visited, those that cannot be fetched or are not allowed
    leave the queue, and the allowed links found on them that are new become pending. A url that is both is visited. Both tables
    are written to the shared folder, so the state that the frontier was read from may be replaced.
    """
    known = frontier.where("url <> ''").groupBy("url").agg(F.max(F.coalesce(F.lower("status") == "visited", F.lit(False))).alias("visited"))
    due = allowed_links(known.where("not visited").select("url"), start, disallowed)
    fetched = pages.dropDuplicates(["url"]).join(due, "url", "left_semi")
    done = known.where("visited").select("url").union(fetched.select("url"))
    fresh = new_urls(allowed_links(page_links(fetched), start, disallowed), known)
    queue = done.select("url", F.lit("visited").alias("status")).union(fresh.select("url", F.lit("pending").alias("status")))
    return cut(records(fetched)), cut(queue)


def append_records(found: DataFrame, path: str) -> None:
    """Appends records as JSON lines, with the time of writing as scraped_at."""
    found.withColumn("scraped_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")).write.mode("append").json(path)


def save_state(frontier: DataFrame, path: str, allowed: list[str] = [], disallowed: list[str] = [], request_delay: int = 2) -> None:
    """Writes the queue (url, status) as Parquet and the settings as one row beside it; a state that is there is replaced.

    The queue may have been read from ``path``: it is written aside first.
    """
    spark = frontier.sparkSession
    cut(frontier.select("url", "status")).write.mode("overwrite").parquet(f"{path}/frontier")
    row = [(list(allowed), list(disallowed), int(request_delay))]
    spark.createDataFrame(row, "allowed_paths array<string>, disallowed_paths array<string>, request_delay int").coalesce(1).write.mode("overwrite").json(f"{path}/settings")


def load_state(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(frontier, settings) of a saved state, or of one JSON document with the lists pending_urls and visited_urls; empty where there is none."""
    kinds = "allowed_paths array<string>, disallowed_paths array<string>, request_delay int"
    settings = {"allowed_paths": [], "disallowed_paths": [], "request_delay": 2}
    if not exists(spark, path):
        return spark.createDataFrame([], "url string, status string"), settings
    if path.endswith(".json"):
        one = spark.read.schema(f"pending_urls array<string>, visited_urls array<string>, {kinds}").option("multiLine", True).json(path)
        queue = one.select(F.explode("pending_urls").alias("url"), F.lit("pending").alias("status")).union(one.select(F.explode("visited_urls"), F.lit("visited")))
    else:
        one = spark.read.schema(kinds).json(f"{path}/settings")
        queue = spark.read.parquet(f"{path}/frontier")
    row = one.select("allowed_paths", "disallowed_paths", "request_delay").first()
    return queue, settings | ({k: v for k, v in row.asDict().items() if v is not None} if row else {})


def records(pages: DataFrame) -> DataFrame:
    """(url, title, author, topic, publication_date, hashed_content, article_text) from (url, html)."""
    page = F.col("html")
    return pages.select(
        "url",
        H.title(page).alias("title"),
        H.author(page).alias("author"),
        H.topic(page).alias("topic"),
        H.publication_date(page).alias("publication_date"),
        F.md5(page).alias("hashed_content"),
        H.article_text(page).alias("article_text"),
    )
