"""Problem 6: the main body of pages, by a linear-chain conditional random field over lines."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.functions.text import has_text, site_of
from glosswork.llm.sample import least_hashes
from glosswork.session import cut

#: Bound on the pages that the field is trained on; their lines are all used.
MOST_PAGES = 1500
#: A short line is the site's own if it recurs on so many of all its pages, and on more than one in so many of them.
LEAST_REPEATS, ONE_IN = 8, 200
ROUNDS, RATE, DECAY = 150, 0.5, 2e-5

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")
#: What ends a sentence, what may stand behind that, and quotation marks that end a line by themselves.
_STOPS, _BEHIND, _MARKS = ".!?…", "\"“”'’»)]", "“”\""
_SPLIT = re.compile(r"\s*[|·›/•]\s*|\s{2,}")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")

# Wordings of what stands around an article, in Slovak, Czech and English. They label the training pages.
_WORDINGS = re.compile(
    r"cookie|súkromi|soukromí|your privacy|(?:váš|your) (?:súhlas|souhlas|consent)|(?:prijať|přijmout|accept) (?:všetko|vše|all)|(?:spravovať|spravovat|manage) \w+"
    r"|zdieľa[jtň]|sdílej|sdílen|\bshare[d]?\b.{0,30}(?:social|times|save|print|this)|páči sa vám|líbí se vám|enjoyed it|send it to a friend|pošlite ho|pošlete ho"
    r"|autorsk\w+ (?:práv|zákon)|práva vyhra|rights reserved|copyright|©|nezodpoved|neodpovíd|not responsible|protected by|under the terms|obchodn[éí] podm|terms (?:of use|and conditions)|ochrana (?:osobn|súkrom)|osobn(?:ých|ích) údaj|licen[cs]"
    r"|^\W*(?:autor|author|text|foto|photo|by)\s?:|(?:pripravila|připravila) redak|prepared by|edited by|written by|(?:foto|photos)\s?:"
    r"|^\W*(?:čítajte|čtěte|read|prečítajte|přečtěte)\b.{0,12}(?:aj|i|také|tiež|also|next|more)?\s?:|^\W*(?:odporúčame|doporučujeme|recommended)\b|súvisiace|související|related (?:articles|stories)|mohlo by vás|may also like|^\W*(?:čítajte|čtěte) (?:aj|i|také|tiež|dál|ďalej)\W*$|^\W*read (?:next|also|more)\W*$|(?:najčítanejšie|nejčtenější|most read)"
    r"|koment[áa]r\w*\s?\(|comments?\s?\(|\(\d+ (?:koment|comment)\w*\s?\)\W*$|^\W*(?:tagy|štítky|tags|kľúčové slová|klíčová slova)\s?:"
    r"|^\W*(?:reklama|inzerc\w+|inzerát|ad|advertisement)\W|^\W*(?:reklama|inzerc\w+|advertisement)\W*$|so zľavou|se slevou|% off|(?:súťažte|soutěžte|vyhrajte|win) .{0,12}(?:pouk|voucher)"
    r"|(?:prihláste|přihlaste) s[ae]|sign up|newsletter|odber noviniek|odběr novinek|sledujte nás|follow us|(?:stiahnite|stáhněte) si|(?:download|get) our app|(?:čas čítania|doba čtení|reading time)\s?:"
    r"|(?:zapnite|povoľte|povoliť|zapněte|povolte|povolit|zapnout|enable|turn on)\b.{0,30}java\s?script|(?:prehliadač|prohlížeč|browser)\b.{0,40}(?:nepodporuje|does not (?:run|support)).{0,20}(?:skript|script)|^\W*(?:o nás|about us|kontakty?|contact|archív?|archive|impressum|redakcia|redakce)\W*$|^\W*»",
    re.IGNORECASE,
)
# Words that introduce a teaser, however long it is.
_TEASER = re.compile(r"^\W*(?:čítajte (?:aj|tiež|ďalej)|čtěte (?:i|také|dále)|prečítajte si|přečtěte si|read (?:also|next|more)|odporúčame|doporučujeme|recommended|mohlo by vás \w+|you may also like|(?:najčítanejšie|nejčtenější|most read)|súvisiace(?: články)?|související(?: články)?|related(?: articles| stories)?)\s?:", re.IGNORECASE)
_ITEM = re.compile(r"^\d+\.\s")


#: What a line may differ in where it recurs, besides case.
_VARIES = "0123456789 \t\r\xa0.,;:!?…|·•›»«()[]{}<>/\\-–—_*+=%&@#~^$€©®\"'`´“”„‚‘’"


def _key(line: Column) -> Column:
    """What is the same where a line recurs: its letters, without case."""
    return F.translate(F.lower(line), _VARIES, "")


def recurring(pages: DataFrame, sample: DataFrame) -> DataFrame:
    """(host, key): the lines of ``sample`` that recur on enough of all ``pages`` of their site (``LEAST_REPEATS``, ``ONE_IN``).

    Lines are counted as they stand but for digits, by a hash of site and line; one that stands otherwise on a page of the sample has the key of one that was counted.
    The lines and sites of the bounded sample are broadcast, so of the others' only their counts move.
    """
    line = lambda x: F.regexp_replace(x, "[0-9\r]+", "")
    own = sample.select(site_of(F.col("url")).alias("host"), F.explode(F.split("article_text", "\n")).alias("line")).where("host is not null")
    known = own.select("host", _key(F.col("line")).alias("key"), F.xxhash64("host", line(F.col("line"))).alias("at")).where("key <> ''").distinct()
    placed = pages.select(site_of(F.col("url")).alias("host"), "article_text").where("host is not null")
    each = placed.select(F.explode(F.array_distinct(F.transform(F.split("article_text", "\n"), lambda x: F.xxhash64("host", line(x))))).alias("at"))
    counts = each.join(F.broadcast(known.select("at").distinct()), "at").groupBy("at").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_REPEATS)
    size = placed.select("host").join(F.broadcast(known.select("host").distinct()), "host").groupBy("host").agg(F.count("*").alias("size"))
    return known.join(counts, "at").join(size, "host").where(F.col("n") * ONE_IN > F.col("size")).select("host", "key").distinct()


def _worded(line: str, n: int) -> bool:
    """True for the wording of what stands around an article; in a line of over 40 words, at least half of its sentences must have it."""
    if n <= 40:
        return bool(_WORDINGS.search(line))
    parts = _SENTENCE.split(line)
    return 2 * sum(bool(_WORDINGS.search(x)) for x in parts) >= len(parts)


def silver(pages: list[list[tuple[str, bool]]]) -> list[list[int]]:
    """Labels of the lines of each page, given as (line, recurs on its site): 1 around the article, 0 part of it.

    A short line that recurs on its site, a row of menu entries, and a
    line with the wording of notices, teasers, credits and advertisements are around; the rest is article. A long
    line needs that wording in most of its sentences, as paragraphs of articles mention such things, too.
    """
    out = []
    for page in pages:
        labels = []
        for line, recurs in page:
            n = len(line.split())
            parts = [x for x in _SPLIT.split(line) if x]
            menu = len(parts) > 2 and all(len(x.split()) <= 3 for x in parts) and not _ended(line)
            numbered = bool(_ITEM.match(line)) and n <= 14 and not _ended(line)
            labels.append(int(bool(_TEASER.match(line)) or menu or numbered or (recurs and n <= 45) or _worded(line, n)))
        out.append(labels)
    return out


def _ended(line: str) -> bool:
    """True for a line that ends like a sentence."""
    left = line.rstrip(_BEHIND)
    return bool(line) and (line[-1] in _MARKS or (bool(left) and left[-1] in _STOPS))


def _bucket(n: int) -> int:
    return n if n < 4 else 3 + int(n).bit_length()


def _own(line: str, count: int, ends: bool) -> list[str]:
    """Features of a line by itself: its distinct words, marks of its beginning and end, length, capitals, separators."""
    tokens = _TOKEN.findall(line)
    words, capitals = [], 0
    for i, x in enumerate(tokens):
        if x[0].isalpha():
            capitals += x[0].isupper()
            words.append("w " + x.lower() if x[0].islower() or i < 2 else "W " + x.lower())
        elif x[0].isdigit():
            words.append("w 0")
        else:
            words.append("p " + x)
    shape = [
        "bias",
        f"len {_bucket(count)}",
        f"end {ends} {count >= 8}",
        f"caps {4 * capitals // max(1, len(tokens))} {count >= 8}",
        f"start {tokens[0].lower() if tokens and not tokens[0].isdigit() else '0'}",
        f"last {tokens[-1].lower() if tokens and not tokens[-1].isdigit() else '0'}",
        f"sentences {min(3, line.count('. ') + line.count('! ') + line.count('? '))}",
    ]
    lead, colon, _ = line[:40].partition(":")
    if colon and len(lead.split()) <= 4:
        shape.append(f"lead {lead.strip().lower()}")
    if len(tokens) > 1:
        shape.append(f"two {tokens[0].lower()} {tokens[1].lower() if not tokens[1].isdigit() else '0'}")
    return shape + list(dict.fromkeys(words))


def _around(lines: list[str]) -> tuple[list[int], list[bool], list[tuple[str, ...]]]:
    """Of the lines of a page: their lengths in words, whether they end like a sentence, and the features of their place and neighbours."""
    n = len(lines)
    counts = [len(x.split()) for x in lines]
    ends = [_ended(x) for x in lines]
    long = [k for k in range(n) if counts[k] >= 14 and ends[k]]
    first, last = (long[0], long[-1]) if long else (n, -1)
    names = [
        (
            f"place {'before' if k < first else 'after' if k > last else 'within'} {_bucket(counts[k])} {ends[k]}",
            f"from {min(k, 3)}",
            f"to {min(n - 1 - k, 3)}",
            f"next {k + 1 < n and counts[k + 1] >= 14}",
            f"previous {k > 0 and counts[k - 1] >= 14}",
        )
        for k in range(n)
    ]
    return counts, ends, names


def features(lines: list[str]) -> list[list[str]]:
    """Names of the features of each non-blank line of a page.

    Those of the line by itself, its place on the page, and the length of its neighbours. The records hold no
    markup, so there are no tags of ancestors.
    """
    counts, ends, names = _around(lines)
    return [_own(line, counts[k], ends[k]) + list(names[k]) for k, line in enumerate(lines)]


@dataclass
class Field:
    """Weights towards label 1 of each feature, and the four scores of neighbouring labels."""

    weights: dict[str, float] = field(default_factory=dict)
    steps: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)
    known: dict[str, float] = field(default_factory=dict, compare=False)

    def _scores(self, lines: list[str]) -> list[float]:
        """The score of label 1 of each line; what a line scores by itself is remembered, as many recur."""
        get, known = self.weights.get, self.known
        if len(known) > 50_000:
            known.clear()
        counts, ends, names = _around(lines)
        out = []
        for k, line in enumerate(lines):
            own = known.get(line)
            if own is None:
                own = known[line] = sum([get(x, 0.0) for x in _own(line, counts[k], ends[k])])
            out.append(own + sum([get(x, 0.0) for x in names[k]]))
        return out

    def decode(self, lines: list[str]) -> list[int]:
        """The most likely labels of the non-blank lines of a page (Viterbi)."""
        if not lines or not self.weights:
            return [0] * len(lines)
        s00, s01, s10, s11 = self.steps
        emitted = self._scores(lines)
        a, b, back = 0.0, emitted[0], []
        for e in emitted[1:]:
            from0, from1 = a + s00 < b + s10, a + s01 < b + s11
            back.append((from0, from1))
            a, b = (b + s10 if from0 else a + s00), (b + s11 if from1 else a + s01) + e
        label = int(b > a)
        out = [label]
        for from0, from1 in reversed(back):
            label = int(from1 if label else from0)
            out.append(label)
        return out[::-1]


def train(pages: list[list[str]], labels: list[list[int]], rounds: int = ROUNDS) -> Field:
    """Maximum likelihood of the labels by gradient steps of adaptive size, all pages at once.

    Features of fewer than three lines are left out. Forward and backward sums run over the pages
    in parallel. Without lines, the field labels every line as article.
    """
    pages, labels = zip(*[(p, y) for p, y in zip(pages, labels, strict=True) if p], strict=True) if any(pages) else ((), ())
    if not pages:
        return Field()
    named = [features(p) for p in pages]
    seen = Counter(x for p in named for line in p for x in line)
    index = {x: k for k, x in enumerate(sorted(x for x, n in seen.items() if n >= 3))}
    size, most = np.array([len(p) for p in pages]), max(len(p) for p in pages)
    rows, columns = [], []
    for i, p in enumerate(named):
        for t, line in enumerate(p):
            known = [index[x] for x in line if x in index]
            rows.extend([i * most + t] * len(known))
            columns.extend(known)
    rows, columns = np.array(rows), np.array(columns)
    n, m = len(pages), len(index)
    gold = np.full((n, most), -1)
    for i, y in enumerate(labels):
        gold[i, : len(y)] = y
    there = gold >= 0
    w, s = np.zeros(m), np.zeros((2, 2))
    past_w, past_s = np.full(m, 1e-6), np.full((2, 2), 1e-6)
    total = there.sum()
    pairs = there[:, 1:]
    told = np.array([[((gold[:, :-1] == a) & (gold[:, 1:] == b) & pairs).sum() for b in (0, 1)] for a in (0, 1)], float)
    for _ in range(rounds):
        emitted = np.zeros((n, most, 2))
        emitted[:, :, 1] = np.bincount(rows, w[columns], n * most).reshape(n, most)
        forward, backward = np.zeros((n, most, 2)), np.zeros((n, most, 2))
        forward[:, 0] = emitted[:, 0]
        for t in range(1, most):
            step = np.logaddexp(forward[:, t - 1, :1] + s[0], forward[:, t - 1, 1:] + s[1]) + emitted[:, t]
            forward[:, t] = np.where(there[:, t, None], step, forward[:, t - 1])
        for t in range(most - 2, -1, -1):
            on = emitted[:, t + 1] + backward[:, t + 1]
            step = np.stack([np.logaddexp(s[a, 0] + on[:, 0], s[a, 1] + on[:, 1]) for a in (0, 1)], axis=1)
            backward[:, t] = np.where(there[:, t + 1, None], step, 0.0)
        norm = np.logaddexp(forward[np.arange(n), size - 1, 0], forward[np.arange(n), size - 1, 1])
        chance = np.where(there, np.exp(np.minimum(forward[:, :, 1] + backward[:, :, 1] - norm[:, None], 0)), 0)
        expected = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                joint = forward[:, :-1, a] + s[a, b] + emitted[:, 1:, b] + backward[:, 1:, b] - norm[:, None]
                expected[a, b] = np.exp(np.minimum(joint, 0))[pairs].sum()
        miss = np.where(there, (gold == 1) - chance, 0).reshape(-1)
        slope_w = np.bincount(columns, miss[rows], m) / total - DECAY * w / 10
        slope_s = (told - expected) / total - DECAY * s
        past_w += slope_w**2
        past_s += slope_s**2
        w += RATE * slope_w / np.sqrt(past_w)
        s += RATE * slope_s / np.sqrt(past_s)
    return Field({x: float(w[k]) for x, k in index.items() if abs(w[k]) > 1e-4}, tuple(float(x) for x in s.reshape(-1)))


def _lines(text: str) -> tuple[list[int], list[str]]:
    numbers, lines = [], []
    for k, line in enumerate(text.split("\n"), 1):
        line = line.strip()
        if line:
            numbers.append(k)
            lines.append(line)
    return numbers, lines


def fit(pages: DataFrame, most: int = MOST_PAGES) -> Field:
    """The field, trained on at most ``most`` pages with text (those with the least hash of page_id), labelled by ``silver``.

    Whether a line recurs on its site is counted over all pages.
    """
    kept = pages.select("page_id", "url", "article_text").where(has_text(F.col("article_text")))
    sample = cut(least_hashes(kept, "page_id", most, pages.count()))
    often = {(r["host"], r["key"]) for r in recurring(kept, sample).collect()}
    each = sample.select(site_of(F.col("url")).alias("host"), F.transform(F.split("article_text", "\n"), lambda x: F.struct(x.alias("line"), _key(x).alias("key"))).alias("lines")).collect()
    texts = [[(x["line"].strip(), (r["host"], x["key"]) in often) for x in r["lines"] if x["line"].strip()] for r in each]
    return train([[line for line, _ in page] for page in texts], silver(texts))


def _decode(shared: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            ids, at = [], []
            for page, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                numbers, lines = _lines(text)
                around = [k for k, y in zip(numbers, model.decode(lines), strict=True) if y]
                ids.extend([page] * len(around))
                at.extend(around)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int32())], names=["page_id", "line_no"])

    return run


def lines_around(pages: DataFrame, model: Field) -> DataFrame:
    """(page_id, line_no): the non-blank lines of each page that are no part of its article.

    A map over the scan. Numbers count from 1 over all pieces between line feeds. Pages without text
    (null, blank, the crawler's default) give no rows; repeated rows come out each.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)
    kept = pages.select("page_id", "article_text").where(has_text(F.col("article_text")))
    return kept.mapInArrow(_decode(shared), "page_id bigint, line_no int")


def _bodies(shared: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            bodies = []
            for text in batch.column(1).to_pylist():
                lines = _lines(text)[1]
                bodies.append("\n".join(x for x, y in zip(lines, model.decode(lines), strict=True) if not y))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.string())], names=["page_id", "body"])

    return run


def bodies(pages: DataFrame, model: Field) -> DataFrame:
    """(page_id, body): the lines of the article of each page with text; empty text if none is left."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    kept = pages.select("page_id", "article_text").where(has_text(F.col("article_text")))
    return kept.mapInArrow(_bodies(shared), "page_id bigint, body string")
