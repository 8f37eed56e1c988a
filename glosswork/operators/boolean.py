"""Boolean retrieval: queries are parsed on the driver; one becomes a column expression, a batch one pass over the postings."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.functions.analyze import terms as analyse
from glosswork.operators.rank import small

_LEX = re.compile(r"\s*(?:([()])|(and|or|not)\b|([^\s()]+))", re.IGNORECASE)
#: Terms of a single query up to which each has a column of its own.
FLAGS = 60
_BINDS = {"NOT": 3, "AND": 2, "OR": 1}


@dataclass
class Parsed:
    """A query in the written and in the postfix order, or the reason why it has no meaning."""

    infix: list[tuple[str, str]] = field(default_factory=list)
    postfix: list[tuple[str, str]] = field(default_factory=list)
    error: str = ""
    hits: int | None = None

    @property
    def terms(self) -> list[str]:
        return sorted({x for kind, x in self.postfix if kind == "term"})


def parse(query: str, normalise: Callable[[list[str]], list[list[str]]]) -> Parsed:
    """Parses AND, OR, NOT and parentheses; neighbours without operator are joined by OR.

    ``normalise`` gives the terms of each operand: an operand of several terms is a group joined by
    OR, one without terms vanishes. Mistakes are kept in ``error``; they mean an empty result.
    """
    lexed = [(m.group(1), m.group(2), m.group(3)) for m in _LEX.finditer(query) if m.group(0).strip()]
    operands = iter(normalise([x for _, _, x in lexed if x]))
    flat: list[tuple[str, str]] = []
    for mark, operator, operand in lexed:
        if mark:
            flat.append(("(" if mark == "(" else ")", mark))
        elif operator:
            flat.append(("op", operator.upper()))
        elif operand:
            found = next(operands)
            if len(found) == 1:
                flat.append(("term", found[0]))
            elif found:
                flat.append(("(", "("))
                for k, term in enumerate(found):
                    if k:
                        flat.append(("op", "OR"))
                    flat.append(("term", term))
                flat.append((")", ")"))
    out = Parsed()
    for item in flat:
        starts = item[0] in ("term", "(") or item == ("op", "NOT")
        if starts and out.infix and out.infix[-1][0] in ("term", ")"):
            out.infix.append(("op", "OR"))
        out.infix.append(item)
    waiting: list[tuple[str, str]] = []
    for item in out.infix:
        kind, value = item
        if kind == "term":
            out.postfix.append(item)
        elif kind == "(":
            waiting.append(item)
        elif kind == ")":
            while waiting and waiting[-1][0] != "(":
                out.postfix.append(waiting.pop())
            if not waiting:
                out.error = "a parenthesis closes that was never opened"
                return out
            waiting.pop()
        else:
            while waiting and waiting[-1][0] == "op" and (_BINDS[waiting[-1][1]] > _BINDS[value] or (_BINDS[waiting[-1][1]] == _BINDS[value] and value != "NOT")):
                out.postfix.append(waiting.pop())
            waiting.append(item)
    while waiting:
        item = waiting.pop()
        if item[0] == "(":
            out.error = "a parenthesis is never closed"
            return out
        out.postfix.append(item)
    depth = 0
    for kind, value in out.postfix:
        depth += 1 if kind == "term" else 0 if value == "NOT" else -1
        if depth < 1 or (value == "NOT" and kind == "op" and depth < 1):
            out.error = "an operator lacks an operand"
            return out
    if depth != 1:
        out.error = "nothing to evaluate" if not out.postfix else "an operand is left over"
    return out


def parse_all(queries: list[str], normalise: Callable[[list[str]], list[list[str]]]) -> list[Parsed]:
    """``parse`` for a batch; the operands of all queries are normalised at once."""
    operands = [[m.group(3) for m in _LEX.finditer(q) if m.group(3)] for q in queries]
    known = iter(normalise([x for own in operands for x in own]))
    return [parse(q, lambda own: [next(known) for _ in own]) for q in queries]


def analyser(spark: SparkSession, language: str = "cs", stem: bool = False) -> Callable[[list[str]], list[list[str]]]:
    """Terms of operands by the pipeline of the index, in one job for all operands of a batch."""

    def run(operands: list[str]) -> list[list[str]]:
        each = list(dict.fromkeys(operands))
        if not each:
            return []
        rows = spark.createDataFrame([(x,) for x in each], "text string").select("text", analyse(F.col("text"), language, stem).alias("terms")).collect()
        found = {r["text"]: list(r["terms"]) for r in rows}
        return [found[x] for x in operands]

    return run


def condition(parsed: Parsed, flag: Callable[[str], Column]) -> Column:
    """The query as a column over one flag per term."""
    stack: list[Column] = []
    for kind, value in parsed.postfix:
        if kind == "term":
            stack.append(flag(value))
        elif value == "NOT":
            stack.append(~stack.pop())
        else:
            right, left = stack.pop(), stack.pop()
            stack.append(left & right if value == "AND" else left | right)
    return stack[0]


def _holds_for_none(parsed: Parsed) -> bool:
    stack: list[bool] = []
    for kind, value in parsed.postfix:
        if kind == "term":
            stack.append(False)
        elif value == "NOT":
            stack.append(not stack.pop())
        else:
            right, left = stack.pop(), stack.pop()
            stack.append(left and right if value == "AND" else left or right)
    return stack[0]


def search(postings: DataFrame, universe: DataFrame, parsed: Parsed) -> DataFrame:
    """(doc_id, score): the documents that meet the query, score 1.0.

    One pass over the postings of the query's terms sets one flag per term and document, or, beyond ``FLAGS`` terms, one bit; the universe is read
    only if a document without any of the terms can meet the query. A query with a mistake finds nothing.
    """
    if parsed.error:
        return universe.select("doc_id", F.lit(1.0).alias("score")).where(F.lit(False))
    if len(parsed.terms) > FLAGS:
        met = _met(postings, [parsed])
        if _holds_for_none(parsed):
            found = universe.select("doc_id").join(met.where("not met").select("doc_id"), "doc_id", "left_anti")
        else:
            found = met.where("met").select("doc_id")
        return found.select("doc_id", F.lit(1.0).alias("score"))
    names = {t: f"f{k}" for k, t in enumerate(parsed.terms)}
    flags = postings.where(F.col("term").isin(parsed.terms)).groupBy("doc_id").agg(*(F.max(F.col("term") == t).alias(c) for t, c in names.items()))
    if _holds_for_none(parsed):
        flags = universe.select("doc_id").join(flags, "doc_id", "left").fillna(False, list(names.values()))
    return flags.where(condition(parsed, lambda t: F.col(names[t]))).select("doc_id", F.lit(1.0).alias("score"))


#: Terms of a query that one number of the masks holds.
_BITS = 63


def _evaluator(programs: dict[int, list[tuple[str, object]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds whether a row's document meets its query: (n, doc_id, masks) to (n, doc_id, met)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(0).to_numpy()
            masks = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(2, batch.num_columns)]
            met = np.zeros(batch.num_rows, bool)
            for n in np.unique(number):
                at = np.flatnonzero(number == n)
                stack: list[np.ndarray] = []
                for kind, value in programs[int(n)]:
                    if kind == "term":
                        stack.append((masks[value // _BITS][at] >> (value % _BITS)) & 1 == 1)
                    elif value == "NOT":
                        stack.append(~stack.pop())
                    else:
                        right, left = stack.pop(), stack.pop()
                        stack.append(left & right if value == "AND" else left | right)
                met[at] = stack[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(met)], names=["n", "doc_id", "met"])

    return run


def _listed(queries: DataFrame | list[tuple[str, str]]) -> list[tuple[str, str]]:
    """A batch of queries as (qid, text); it is parsed on the driver, so it must fit there."""
    rows = queries if isinstance(queries, list) else [(r["qid"], r["text"]) for r in queries.select("qid", "text").collect()]
    return [(qid, text or "") for qid, text in rows]


def _met(postings: DataFrame, parsed: list[Parsed]) -> DataFrame:
    """(n, doc_id, met): for each query n without mistake, every document with one of its terms.

    The terms of all queries are numbered within their query and sent to the postings; a document's terms become the bits of a
    mask, aggregated before they are shuffled, and each query is evaluated on masks, many documents at a time.
    """
    programs, wanted, most = {}, [], 0
    for n, p in enumerate(parsed):
        if not p.error:
            bit = {t: k for k, t in enumerate(p.terms)}
            programs[n] = [(kind, bit[x] if kind == "term" else x) for kind, x in p.postfix]
            wanted += [(n, t, k) for t, k in bit.items()]
            most = max(most, len(bit))
    spark = postings.sparkSession
    asked = small(spark.createDataFrame(wanted, "n int, term string, bit int"))
    part = lambda k: F.bit_or(F.when(F.floor(F.col("bit") / _BITS) == k, F.expr(f"shiftleft(1L, bit % {_BITS})")).otherwise(F.lit(0).cast("bigint"))).alias(f"m{k}")
    masks = postings.select("term", "doc_id").join(asked, "term").groupBy("n", "doc_id").agg(*(part(k) for k in range(max(1, -(-most // _BITS)))))
    return masks.mapInArrow(_evaluator(programs), "n int, doc_id string, met boolean")


def search_many(postings: DataFrame, universe: DataFrame, queries: DataFrame | list[tuple[str, str]], normalise: Callable[[list[str]], list[list[str]]]) -> DataFrame:
    """(qid, doc_id, score) of a batch of Boolean queries (qid, text): the documents that meet each, score 1.0; nothing for one with a mistake.

    Where a document without any of a query's terms meets it, the universe less those that do not is its result.
    """
    asked = _listed(queries)
    parsed = parse_all([text for _, text in asked], normalise)
    spark = postings.sparkSession
    names = spark.createDataFrame([(n, qid, bool(not p.error and _holds_for_none(p))) for n, ((qid, _), p) in enumerate(zip(asked, parsed, strict=True))], "n int, qid string, free boolean")
    met = _met(postings, parsed).join(F.broadcast(names), "n")
    bound = met.where("met and not free").select("n", "doc_id")
    free = universe.select("doc_id").join(F.broadcast(names.where("free").select("n"))).select("n", "doc_id").join(met.where("free and not met").select("n", "doc_id"), ["n", "doc_id"], "left_anti")
    return bound.unionByName(free).join(F.broadcast(names.select("n", "qid")), "n").select("qid", "doc_id", F.lit(1.0).alias("score"))


def hit_counts(postings: DataFrame, universe: DataFrame, queries: DataFrame | list[tuple[str, str]], normalise: Callable[[list[str]], list[list[str]]]) -> DataFrame:
    """(qid, hits) of a batch of Boolean queries (qid, text), 0 for those with a mistake; a row for each query, also where a qid repeats.

    Documents without any of a query's terms are counted from the size of the universe.
    """
    asked = _listed(queries)
    parsed = parse_all([text for _, text in asked], normalise)
    spark = postings.sparkSession
    names = spark.createDataFrame([(n, qid, bool(not p.error and _holds_for_none(p))) for n, ((qid, _), p) in enumerate(zip(asked, parsed, strict=True))], "n int, qid string, free boolean")
    counts = _met(postings, parsed).groupBy("n").agg(F.count_if("met").alias("met"), F.count_if(~F.col("met")).alias("missed"))
    total = universe.agg(F.count("*").alias("total"))
    rest = F.when(F.col("free"), F.col("total") - F.coalesce("missed", F.lit(0))).otherwise(F.coalesce("met", F.lit(0)))
    return names.join(counts, "n", "left").crossJoin(F.broadcast(total)).select("qid", rest.cast("bigint").alias("hits"))
