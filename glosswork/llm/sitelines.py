"""Problem 7: blocks of lines repeated across the pages of one site, by suffixes of line identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.functions.text import has_text, site_of
from glosswork.session import cut, written


def suffixes(pages: DataFrame) -> DataFrame:
    """(doc, page_id, site, i, line, name): where each suffix of each page's lettered lines begins, with the identifier of its first line.

    A line's identifier is a hash of its letters in lower case; i counts the lettered lines of the page, ``line`` all of
    them; site is a hash of the host; doc tells rows with one page_id apart. Written once, as the texts are dear to read.
    """
    kept = pages.select("page_id", F.col("article_text").alias("body"), site_of(F.col("url")).alias("host")).where(F.col("page_id").isNotNull() & F.col("host").isNotNull() & has_text(F.col("body")))
    letters = F.transform(F.split("body", "\n"), lambda line, i: F.struct((i + 1).alias("line"), F.lower(F.regexp_replace(line, r"[^\p{L}]+", "")).alias("own")))
    named = F.transform(F.filter(letters, lambda x: x["own"] != ""), lambda x: F.struct(x["line"].alias("line"), F.xxhash64(x["own"]).alias("name")))
    rows = kept.select(F.monotonically_increasing_id().alias("doc"), "page_id", F.xxhash64("host").alias("site"), named.alias("all"))
    return written(rows.select("doc", "page_id", "site", F.posexplode("all").alias("i", "x")).select("doc", "page_id", "site", "i", "x.line", "x.name"))


def _on_many_pages(rows: DataFrame, keys: list[str], least_pages: int) -> DataFrame:
    """The keys that occur on ``least_pages`` different pages; both steps aggregate before they shuffle, so a hot key costs no more than others."""
    return rows.select(*keys, "page_id").distinct().groupBy(*keys).agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages).drop("pages")


def _longest(docs: DataFrame, least_pages: int) -> DataFrame:
    """``docs`` with ``length``: for each suffix, how many of its first lines occur as one block on ``least_pages`` pages of the site.

    The common prefixes are found by doubling: a block that is repeated has all its prefixes repeated, so the length is built
    from the largest power of two down, each round asking of every suffix whether its prefix, longer by that power, is still on
    pages enough. It is if so many pages ask for it in this round, or if it begins a block that an earlier round found repeated; of
    these, each content is taken once however many pages have it. The rounds are as many as the logarithm of the longest run of repeated lines;
    the work on a run of n lines grows as n squared, for each page as hashing, for each content in rows.
    """
    size = F.size("name")
    runs = F.aggregate("i", F.struct(F.lit(-2).alias("at"), F.lit(0).alias("run"), F.lit(0).alias("most")), _run_step)["most"]
    most = docs.agg(F.max(runs)).first()[0] or 0
    docs = docs.withColumn("length", F.transform("name", lambda _: F.lit(1)))
    step = 1
    while 2 * step < most:
        step *= 2
    while step and most > 1:
        tried = F.transform(
            F.sequence(F.lit(0), size - 1),
            lambda p: F.struct(p.alias("p"), (F.get("length", p) + F.lit(step)).alias("longer")),  # noqa: B023
        )
        fits = F.filter(tried, lambda x: F.get("i", x["p"] + x["longer"] - 1) - F.get("i", x["p"]) == x["longer"] - 1)
        asked = docs.select("doc", "page_id", "site", F.explode(F.transform(fits, lambda x: F.struct(x["p"].alias("p"), x["longer"].alias("longer"), F.xxhash64(F.slice("name", x["p"] + 1, x["longer"])).alias("block")))).alias("x"))
        asked = asked.select("doc", "page_id", "site", "x.*")
        good = _on_many_pages(asked, ["site", "longer", "block"], least_pages).union(_beginnings(docs, step))
        hits = asked.join(good, ["site", "longer", "block"], "left_semi").select("doc", F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, p & 63)").alias("bit"))
        every = docs.select("doc", F.explode(F.sequence(F.lit(0), F.shiftright(size - 1, 6))).alias("word"), F.lit(0).cast("bigint").alias("bit"))
        words = every.unionByName(hits).groupBy("doc", "word").agg(F.bit_or("bit").alias("bits")).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))
        hit = lambda p: F.call_function("shiftrightunsigned", F.get("words", F.shiftright(p, 6))["bits"], p.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1).cast("bigint"))
        grown = F.transform("length", lambda n, p: n + hit(p).cast("int") * step)  # noqa: B023
        docs = cut(docs.join(words, "doc").withColumn("length", grown).drop("words"))
        step //= 2
    return docs


def _beginnings(docs: DataFrame, step: int) -> DataFrame:
    """(site, longer, block): the beginnings, of the lengths that are asked for in the round of ``step``, of the blocks found so far.

    Of each content one place stands for all.
    """
    block = lambda p, n: F.xxhash64(F.slice("name", p + 1, n))
    places = F.transform("length", lambda n, p: F.struct(n.alias("length"), p.alias("p"), F.when(n > step, block(p, n)).alias("block")))
    found = docs.select("doc", "site", F.explode(F.filter(places, lambda x: x["length"] > step)).alias("x"))
    contents = found.groupBy("site", "x.length", "x.block").agg(F.min(F.struct("doc", F.col("x.p").alias("p"))).alias("at"))
    shown = contents.select("site", "length", "at.doc", "at.p").join(docs.select("doc", "name"), "doc")
    begun = shown.select("site", F.explode(F.transform(F.sequence(F.lit(1 + step), F.col("length"), F.lit(2 * step)), lambda n: F.struct(n.alias("longer"), block(F.col("p"), n).alias("block")))).alias("x"))
    return begun.select("site", "x.longer", "x.block").distinct()


def _run_step(state: Column, at: Column) -> Column:
    run = F.when(at == state["at"] + 1, state["run"] + 1).otherwise(1)
    return F.struct(at.alias("at"), run.alias("run"), F.greatest(state["most"], run).alias("most"))


def _measured(pages: DataFrame, least_pages: int) -> DataFrame:
    """(doc, page_id, site, i, line, name, length): arrays over the suffixes of a page that begin with a repeated line."""
    rows = suffixes(pages)
    often = _on_many_pages(rows, ["site", "name"], least_pages)
    begins = rows.join(often, ["site", "name"], "left_semi")
    sorted_ = F.sort_array(F.collect_list(F.struct("i", "line", "name")))
    docs = begins.groupBy("doc", "page_id", "site").agg(sorted_.alias("all")).select("doc", "page_id", "site", F.col("all.i").alias("i"), F.col("all.line").alias("line"), F.col("all.name").alias("name"))
    return _longest(cut(docs), least_pages)


def _maximal() -> Column:
    """(first, length, lines) of the blocks of a page that are not part of a longer one that begins a line before."""
    part = lambda p: F.get("length", p)
    every = F.transform(F.sequence(F.lit(0), F.size("name") - 1), lambda p: F.struct(F.get("line", p).alias("first"), part(p).alias("length"), F.slice("line", p + 1, part(p)).alias("lines"), p.alias("p")))
    return F.filter(every, lambda x: (x["p"] == 0) | (F.get("i", x["p"] - 1) != F.get("i", x["p"]) - 1) | (part(x["p"] - 1) <= x["length"]))


def repeated_blocks(pages: DataFrame, least_pages: int = 8, least_lines: int = 1) -> DataFrame:
    """(page_id, first, length): the maximal blocks of ``least_lines`` or more lines that occur on ``least_pages`` or more pages of their site.

    Every suffix of the line sequences of a site gets the length of its longest prefix that is repeated often enough; of
    these blocks, those that begin one line later within a longer one are left out. Lines without a repeated
    line around them are dropped before anything is compared at length, as no block can hold them. Blocks are equal
    if the 64-bit hashes of their lines are.

    Lines are equal by their letters in lower case, in order; lines without letters are
    skipped and do not part a block. ``first`` counts from 1 over all pieces between line feeds. Pages without url, page_id or
    text give no rows; a page counts once however often it repeats a line; repeated rows come out each. An empty table gives no rows.
    """
    found = _measured(pages, least_pages).select("page_id", F.explode(_maximal()).alias("b"))
    return found.select("page_id", "b.first", "b.length").where(F.col("length") >= least_lines)


def repeated_lines(pages: DataFrame, least_pages: int = 8, least_lines: int = 1) -> DataFrame:
    """(page_id, line_no): the lines of ``repeated_blocks``, each once per row of ``pages``."""
    blocks = F.filter(_maximal(), lambda b: b["length"] >= least_lines)
    lines = F.array_distinct(F.flatten(F.transform(blocks, lambda b: b["lines"])))
    return _measured(pages, least_pages).select("page_id", F.explode(lines).alias("line_no"))


def without_repeated(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(page_id, article_text, removed): the text of each page without the lines in ``found``.

    Pages without such lines come out unchanged with removed 0, null text as null.
    """
    gone = found.groupBy("page_id").agg(F.collect_set("line_no").alias("gone"))
    kept = pages.select("page_id", "article_text").join(gone, "page_id", "left")
    left = F.filter(F.transform(F.split("article_text", "\n"), lambda line, i: F.struct((i + 1).alias("i"), line.alias("line"))), lambda x: ~F.array_contains("gone", x["i"]))
    text = F.when(F.col("gone").isNull(), F.col("article_text")).otherwise(F.array_join(F.transform(left, lambda x: x["line"]), "\n"))
    return kept.select("page_id", text.alias("article_text"), F.coalesce(F.size("gone"), F.lit(0)).alias("removed"))
