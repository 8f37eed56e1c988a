"""Problem 3: template residue, filler and error pages."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.functions.text import has_text
from glosswork.llm.hashing import WordHashes, hash64, signed
from glosswork.operators.graph import components
from glosswork.session import cut, written

#: Words on lines of prose from which a page is a full article; a line of prose has so many words.
ARTICLE_WORDS, PROSE_LINE = 60, 12
#: Words of a line beyond which it is no message.
MESSAGE_WORDS = 25
#: Bits of each block of a fingerprint; two blocks make a table, so fingerprints of at most ``MOST_BITS`` different bits meet in one.
BLOCKS, MOST_BITS = (7, 7, 7, 7, 6, 6, 6, 6, 6, 6), 8
#: Least share of words for an edge.
LEAST_SHARE = 0.8
#: Rows of a block that a bucket of a table is cut into; each pair of blocks is compared by itself.
BLOCK = 512
#: How many times more often a line must stand on pages with a trusted title than on full articles.
LIFT = 3

# Status codes of HTTP and their phrases, which error pages have as titles.
STATUS = {400: "bad request", 401: "unauthorized", 403: "forbidden", 404: "not found", 410: "gone", 429: "too many requests", 500: "internal server error", 502: "bad gateway", 503: "service unavailable", 504: "gateway timeout"}
# Other whole titles of pages that are none, and titles that were never filled in.
OTHER_TITLES = ("error", "chyba", "page not found", "stránka nenájdená", "stránka nenalezena", "just a moment", "please wait", "loading", "test", "xxx", "untitled", "lorem ipsum", "javascript", "javascript required", "javascript disabled")
DUMMY_TITLES = ("title", "article title", "title here", "headline", "headline here", "nadpis", "nadpis sem", "nadpis článku", "titulok", "titulok článku", "titulek", "titulek článku", "názov článku", "název článku")
# A demand for scripts in each language, the trusted examples among lines.
EXAMPLES = ("Zapnite si JavaScript a obnovte stránku.", "Zapněte si JavaScript a obnovte stránku.", "Please turn on JavaScript and reload.")
# The words of the usual filler text.
LOREM = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split())

ERROR_TITLES = frozenset(OTHER_TITLES) | {x for code, phrase in STATUS.items() for x in (str(code), phrase, f"{code} {phrase}", f"error {code}", f"chyba {code}", f"http {code}", f"http error {code}")}

_NAME = r"[A-Za-z_][\w.\-]*"
#: Marks that only templates have, and marks that plain text may have, too; the names are the groups.
_SURE = re.compile(rf"\{{\{{\s*({_NAME})(?:\s*\|[^{{}}]*)?\s*\}}\}}|\{{%\s*\w+\s+({_NAME})[^%]*%\}}|\{{%\s*(\w[^%]*)%\}}|<%=?\s*({_NAME})[^%]*%>|\$\{{\s*({_NAME})\s*\}}|\[\[\s*({_NAME})\s*\]\]|__([A-Za-z][A-Za-z.]*(?:_[A-Za-z.]+)*)__")
_LIKELY = re.compile(rf"(?<![\w{{$])\{{({_NAME})\}}(?!\}})|(?<![\w%])%({_NAME})%(?![\w%])|(?<![\w\[])\[({_NAME})\](?!\])|(?<![\w#])#({_NAME})#")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\d_A-Z]+|\d+")
_QUOTES = "„“”\"'‘’‚«»‹›`"
_SUFFIX = re.compile(r"\s+[|–—-]\s+[^|–—]{2,40}$")
_WORD = re.compile(r"[^\W_]+")
_ENDS = ".!?…"


def marks(text: str) -> list[tuple[tuple[str, ...], bool]]:
    """(words of the name, sure) of the template fields in ``text`` that stand outside of quotation marks.

    Sure are those whose signs only templates use, and names made like identifiers (with a dot or an underscore).
    """
    if not any(x in text for x in ("{", "<%", "%", "[", "#", "__")):
        return []
    out = []
    for pattern in (_SURE, _LIKELY):
        for m in pattern.finditer(text):
            before, after = text[: m.start()].rstrip(), text[m.end() :].lstrip()
            if before[-1:] in _QUOTES and before and after[:1] in _QUOTES and after:
                continue
            name = next(x for x in m.groups() if x)
            sure = pattern is _SURE or "_" in name.strip("_") or "." in name.strip(".")
            out.append((tuple(x.lower() for x in _PARTS.findall(name)) or (name.lower(),), sure))
    return out


def _filler(words: list[str]) -> bool:
    """True for a line of filler: mostly words of the usual filler text, or one word over and over."""
    n = len(words)
    if n < 4:
        return False
    if 2 * sum(map(LOREM.__contains__, words)) > n:
        return True
    top = max(words.count(w) for w in set(words[:3]))
    return 10 * top >= 7 * n


def mask(line: str) -> list[str]:
    """The words of a message in lower case; what varies is replaced: names and paths by @, numbers by #.

    A name is a capitalised word within a sentence, or one in capitals. Neighbouring names are one.
    """
    pieces = line.split()
    shouted = sum(x.isupper() for x in pieces) * 2 > len(pieces)
    kept: list[str] = []
    begins = True
    for piece in pieces:
        if piece.isalpha():  # the same, faster
            name = not begins and not shouted and piece[0].isupper() and (piece.istitle() or (len(piece) > 1 and piece.isupper()))
            if not name:
                kept.append(piece.lower())
            elif kept[-1:] != ["@"]:
                kept.append("@")
            begins = False
            continue
        if "/" in piece:
            found = ["@"]
        elif any(map(str.isdigit, piece)):
            found = ["#"]
        else:
            found = ["@" if not (begins and k == 0) and not shouted and (x.istitle() or (len(x) > 1 and x.isupper())) else x.lower() for k, x in enumerate(_WORD.findall(piece))]
        kept.extend(x for k, x in enumerate(found) if x not in "@#" or [*kept[-1:], *found[:k]][-1:] != [x])
        begins = piece[-1] in _ENDS
    return kept


@lru_cache(maxsize=1)
def _numbers() -> WordHashes:
    return WordHashes()


def simhash(words: list[str]) -> int:
    """64-bit fingerprint over the words and pairs of neighbouring words."""
    features = words + [a + " " + b for a, b in zip(words, words[1:], strict=False)]
    if not features:
        return 0
    bits = np.unpackbits(_numbers().of(features).view(np.uint8).reshape(len(features), 8), axis=1)
    return int(np.packbits(2 * bits.sum(axis=0) > len(features)).view(np.int64)[0])


@lru_cache(maxsize=50_000)
def _node(words: tuple[str, ...]) -> int:
    return node_of(words)


def node_of(words: Sequence[str]) -> int:
    """64 bits that tell a masked line."""
    return signed(hash64(" ".join(words).encode("utf-8", "surrogatepass")))


@lru_cache(maxsize=50_000)
def _message(line: str) -> tuple[str, ...] | None:
    """The masked words of a line that may be a message: at least three, two of them words indeed."""
    if not 2 < len(line.split()) <= MESSAGE_WORDS:
        return None
    words = tuple(mask(line))
    return words if len(words) > 2 and sum(x not in "@#" for x in words) > 1 else None


#: What a row of evidence says: a page that is a case by itself; a mark; a line of a page that is no article; how many full articles of
#: a batch have a line; how many full articles (trusted false) and pages with a trusted title (true) a batch has.
OWN, MARK, LINE, USUAL, TOTAL = range(5)
_EVIDENCE = "page_id bigint, kind tinyint, trusted boolean, node bigint, n bigint, print bigint, words array<string>"


def _title(title: str) -> str:
    return " ".join(_WORD.findall(title.lower()))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of evidence of each page."""
    for batch in batches:
        rows: list[tuple] = []
        usual: Counter = Counter()
        full = trusted_pages = 0
        for page, title, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            name = (title or "").strip()
            whole, bare = _title(name), _title(_SUFFIX.sub("", name))
            found = marks(name) + marks(text)
            own = whole in DUMMY_TITLES or bare in DUMMY_TITLES or any(sure for _, sure in found)
            for parts, sure in dict.fromkeys(found):
                words = ["<field>", *parts]
                rows.append((page, MARK, sure, node_of(words), 1, simhash(words), words))
            prose, lines = 0, text.split("\n")
            for line in lines:
                words = line.lower().split()
                own = own or _filler(words)
                if len(words) >= PROSE_LINE:
                    prose += len(words)
            if prose >= ARTICLE_WORDS:
                full += 1
                usual.update({_node(x) for x in map(_message, lines) if x})
            else:
                trusted = whole in ERROR_TITLES or bare in ERROR_TITLES
                trusted_pages += trusted
                own = own or trusted
                for words in {x for x in map(_message, lines) if x}:
                    rows.append((page, LINE, trusted, node_of(words), 1, simhash(list(words)), words))
            if own:
                rows.append((page, OWN, True, None, 1, None, None))
        rows.extend((None, USUAL, False, node, n, None, None) for node, n in usual.items())
        rows.extend(((None, TOTAL, False, None, full, None, None), (None, TOTAL, True, None, trusted_pages, None, None)))
        kinds = [pa.int64(), pa.int8(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "kind", "trusted", "node", "n", "print", "words"])


def _tables(prints: DataFrame) -> DataFrame:
    """Each fingerprint once per pair of its blocks: (table, key, node, print, words)."""
    start = np.cumsum([0, *BLOCKS])
    block = lambda k: F.shiftrightunsigned("print", int(start[k])).bitwiseAND(F.lit(2 ** BLOCKS[k] - 1))
    keys = F.array(*(F.struct(F.lit(n).alias("table"), (block(a) * F.lit(128) + block(b)).alias("key")) for n, (a, b) in enumerate(combinations(range(len(BLOCKS)), 2))))
    return prints.select("node", "print", "words", F.explode(keys).alias("at")).select("at.table", "at.key", "node", "print", "words")


def _rare_words(prints: DataFrame) -> DataFrame:
    """Each node once per rare word, as a table of its own: (table, key, node, print, words).

    Of n distinct words, ordered from rare to common over all nodes, the first n - ceil(n * LEAST_SHARE) + 1 are
    taken; two sets that have ``LEAST_SHARE`` of their words in common share one of these.
    """
    single = prints.select("node", F.explode(F.array_distinct("words")).alias("word"))
    counted = single.join(single.groupBy("word").agg(F.count("*").alias("n")), "word")
    ordered = counted.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "word"))).alias("all"))
    kept = F.size("all") - F.ceil(F.size("all") * LEAST_SHARE - 1e-9).cast("int") + 1
    first = ordered.select("node", F.explode(F.slice("all", F.lit(1), kept)).alias("at"))
    return first.join(prints, "node").select(F.lit(-1).alias("table"), F.xxhash64("at.word").alias("key"), "node", "print", "words")


def similar_lines(prints: DataFrame) -> DataFrame:
    """(a, b): all nodes of which ``LEAST_SHARE`` or more of the distinct words are the same.

    The SimHash tables hold every pair of fingerprints of at most ``MOST_BITS`` different bits; such a pair is verified by its bits, then by its
    words. Of a short line one changed word may flip more bits; such pairs meet in the table of rare words, which
    holds every pair with enough words in common, and are verified by these. In a table all of one key are compared; those of a hot key are
    dealt out to salted blocks, and each pair of blocks is joined by itself.
    """
    tables = _tables(prints).unionByName(_rare_words(prints))
    sizes = tables.groupBy("table", "key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n")
    dealt = tables.join(sizes, ["table", "key"]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    at = ["table", "key", "low", "high"]
    placed = met.select("table", "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "print", "words")
    left = placed.where("block = low").select(*at, F.col("node").alias("a"), F.col("words").alias("x"), F.col("print").alias("p"))
    right = placed.where("block = high").select(*at, F.col("node").alias("b"), F.col("words").alias("y"), F.col("print").alias("q"))
    pairs = left.join(right, at).where("a < b or (low < high and a <> b)")
    near = (F.col("table") < 0) | (F.bit_count(F.col("p").bitwiseXOR(F.col("q"))) <= MOST_BITS)
    share = F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))
    return pairs.where(near & (share >= LEAST_SHARE)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def evidence(pages: DataFrame) -> DataFrame:
    """(page_id, own): the pages that hold residue; own is false for those that only links to others tell."""
    spark = pages.sparkSession
    kept = pages.select("page_id", "title", "article_text").where(F.col("page_id").isNotNull() & has_text(F.col("article_text")))
    rows = written(kept.mapInArrow(_read, _EVIDENCE))
    examples = [(x, node_of(x), simhash(x)) for x in map(mask, EXAMPLES)]
    known = spark.createDataFrame([(None, LINE, True, node, 0, at, x) for x, node, at in examples], _EVIDENCE)
    carried = rows.where(F.col("kind").isin(MARK, LINE)).unionByName(known)
    nodes = cut(carried.groupBy("node").agg(F.sum(F.when(F.col("trusted"), 1).otherwise(0)).alias("trusted"), F.max((F.col("n") == 0) | (F.col("kind") == MARK)).alias("sure"), F.first("print").alias("print"), F.first("words").alias("words")))
    usual = rows.where(F.col("kind") == USUAL).groupBy("node").agg(F.sum("n").alias("usual"))
    linked = components(similar_lines(nodes.select("node", "print", "words")))
    rooted = nodes.join(usual, "node", "left").join(linked, "node", "left").select("node", "trusted", "sure", F.coalesce("usual", F.lit(0)).alias("usual"), F.coalesce("component", "node").alias("root"))
    whole = rows.where(F.col("kind") == TOTAL).agg(F.coalesce(F.sum(F.when(F.col("trusted"), F.col("n"))), F.lit(0)).alias("bad"), F.coalesce(F.sum(F.when(~F.col("trusted"), F.col("n"))), F.lit(0)).alias("full"))
    sums = rooted.groupBy("root").agg(F.sum("trusted").alias("trusted"), F.sum("usual").alias("usual"), F.max("sure").alias("sure"))
    often = F.col("trusted") * F.col("full") >= LIFT * F.col("usual") * F.col("bad")
    trusted = sums.crossJoin(F.broadcast(whole)).where((F.col("trusted") > 0) & (F.col("sure") | often)).select("root")
    residue = rooted.join(trusted, "root", "left_semi").select("node")
    spread = rows.where(F.col("kind").isin(MARK, LINE)).select("page_id", "node").join(residue, "node", "left_semi").select("page_id", F.lit(False).alias("own"))
    return rows.where(F.col("kind") == OWN).select("page_id", F.lit(True).alias("own")).unionByName(spread).groupBy("page_id").agg(F.max("own").alias("own"))


def residue_pages(pages: DataFrame) -> DataFrame:
    """(page_id): pages that hold residue in place of, or within, their content.

    Trusted by themselves are template fields whose signs only templates use, lines of filler, whole titles that were never filled in
    and, on pages that are no full article, titles that are an HTTP status or the like. Everything else is told by links:
    the fields and, of pages that are no full article, the lines are masked (names, paths, numbers) and equal ones become one node.
    SimHash tables and a table of rare words link near-equal nodes after a check of the words, and labels spread over the connected
    components: a message is residue that stands on pages with a trusted title, unless full articles have it about as often
    (``LIFT``), as they have menus and notices; a field in signs of plain text, like [name], is one whose name templates use elsewhere. A page
    with such a node is a case.

    Pages without text (null, blank, the crawler's default) or page_id are none; a null title is an empty one. A full article
    that quotes a field, writes of errors, or stands beside a script notice is none. Repeated page_ids come
    out once. An empty table gives no rows.
    """
    return evidence(pages).select("page_id")
