"""Operators on crawled pages against plain Python."""

import random
import re
from collections import defaultdict

import pytest

from glosswork.llm import formatting, mainbody, neardup, residue, sitelines

_PAGES = "page_id bigint, url string, title string, article_text string, class bigint, line_no int, seed boolean, copies int"
WORDS = [f"{a}{b}" for a in "ba ce di fo gu ha ji ke lo mu na pe".split() for b in "rak tel nos vim dup kas lem".split()]


def _pages(spark, rows):
    return spark.createDataFrame([(*r, 7, 7, True, 7) for r in rows], _PAGES)


def _text(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def family():
    """Texts with edited, reordered, repeated and unrelated ones."""
    rng, rows, page = random.Random(3), [], 1
    for _ in range(25):
        base = _text(rng, 120).split()
        for kind in range(4):
            words = list(base)
            if kind == 1:
                words[10:14] = ["x", "y"]
            elif kind == 2:
                words = words[60:] + words[:60]
            elif kind == 3:
                words = words[:90] + _text(rng, 25).split()
            rows.append((page, "u", None, " ".join(words)))
            page += 1
    rows += [(page, None, None, rows[0][3].upper() + "!"), (page + 1, None, None, rows[0][3]), (page + 2, "u", None, "short text"), (page + 3, "u", None, None), (page + 4, "u", None, "No Article Text Found"), (page + 5, "u", None, "  \n")]
    return rows


def _pairs(rows, width=3, threshold=0.5):
    sets = {}
    for page, _, _, text in rows:
        words = re.findall(r"[^\W_]+", (text or "").lower())
        if len(words) >= 60:
            sets[page] = set(zip(*(words[k:] for k in range(width)), strict=False))
    ids = sorted(sets)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def test_near_pairs_against_brute_force(spark, family):
    got = [tuple(r) for r in neardup.near_pairs(_pages(spark, family)).collect()]
    want = _pairs(family)
    assert len(want) > 80 and set(got) == want and len(got) == len(want)


def test_near_groups(spark, family):
    got = {r["page_id"]: r["group_id"] for r in neardup.groups(_pages(spark, family)).collect()}
    root = {p: p for p in got}
    for a, b in sorted(_pairs(family)):
        ra, rb = root[a], root[b]
        root = {p: min(ra, rb) if x in (ra, rb) else x for p, x in root.items()}
    assert got == root


def test_near_pairs_of_many_copies_and_of_nothing(spark):
    rng = random.Random(1)
    text, other = _text(rng, 80), _text(rng, 80)
    rows = [(k, "u", None, text) for k in range(1, 60)] + [(60, "u", None, other)]
    assert neardup.near_pairs(_pages(spark, rows)).count() == 59 * 58 // 2
    assert neardup.near_pairs(_pages(spark, [])).count() == 0
    assert neardup.groups(_pages(spark, [])).count() == 0


def test_depth_follows_the_region(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(neardup, "REGION", 8)
    monkeypatch.setattr(neardup, "SPARSE", 8)
    sizes = {(0, 1): 5, (1, 1): 4, (1, 2): 4, (2, 1): 6, (2, 2): 7, (2, 3): 20, (3, 1): 8}  # rows of each (h1, h2)
    h1, h2 = (np.concatenate([np.full(n, k[i], np.int32) for k, n in sizes.items()]) for i in (0, 1))
    n = len(h1)
    name = np.arange(n, dtype=np.int64)
    columns = [np.zeros(n, np.int8), h1, h2, name, *[np.zeros(n, np.int64)] * 3, np.zeros(n, bool)]
    want = {(a, b) for a in range(n) for b in range(a + 1, n) if h1[a] == h1[b] and (h1[a] != 2 or (h2[a] == h2[b] and h2[a] != 3))}
    for step in (1, 3, 7, n):
        batches = [pa.RecordBatch.from_arrays([pa.array(c[k : k + step]) for c in columns], names=["tree", "h1", "h2", "class", "s1", "s2", "s3", "deep"]) for k in range(0, n, step)]
        out = [r for x in neardup._neighbours(iter(batches)) for r in x.to_pylist()]
        pairs = [(r["a"], r["b"]) for r in out if r["b"] is not None]
        rows = sorted(r["a"] for r in out if r["b"] is None)
        assert len(pairs) == len(set(pairs)) and set(pairs) == want, step
        assert rows == [k for k in range(n) if (h1[k], h2[k]) == (2, 3)], step


@pytest.mark.parametrize("batch", ["700", "10000"])
@pytest.mark.parametrize("hot", [False, True])
def test_pairs_of_dense_regions(spark, monkeypatch, batch, hot):
    if hot:  # every region goes by the way of hot keys
        monkeypatch.setattr(neardup, "SAMPLE", 1)
        monkeypatch.setattr(neardup, "REGION", 8)
        monkeypatch.setattr(neardup, "BLOCK", 128)
    rng = random.Random(5)
    base = _text(rng, 200).split()
    edited = [(k, "u", None, " ".join(base[: k % 200] + [f"z{k}"] + base[k % 200 + 1 :])) for k in range(800)]
    apart = [(k, "u", None, " ".join(base[: 145 - k % 8] + _text(rng, 55).split())) for k in range(900, 920)]
    rows = edited + apart
    want = {p for p in _pairs(rows[:100] + apart, 5, 0.5) if p[0] < 900 <= p[1]}
    name = {p: neardup._class(neardup._hasher().words(t)) for p, _, _, t in rows}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        far = [name[p] for p, *_ in apart]
        found = neardup.candidates(neardup.signed_pages(_pages(spark, rows)))
        got = [tuple(r) for r in found.where(found.a.isin(far) | found.b.isin(far)).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    both = len({(min(name[a], name[b]), max(name[a], name[b])) for a, b in want} & set(got))
    assert len(got) == len(set(got)) and len(want) > 500 and both >= 0.99 * len(want)


def test_hashes_have_64_bits_of_their_own():
    from glosswork.llm.hashing import WordHashes

    rng = random.Random(6)
    words = list({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(100_000)})
    h = WordHashes().of(words)
    assert len(set(h.tolist())) == len(words)
    low, high = {}, {}
    for x in h.tolist():  # neither half tells the other
        low.setdefault(x & 0xFFF, set()).add(x >> 52)
        high.setdefault(x >> 52, set()).add(x & 0xFFF)
    assert min(map(len, low.values())) > 5 and min(map(len, high.values())) > 5


def test_scattered_edits_at_the_threshold(spark):
    rng, rows = random.Random(11), []
    for k in range(0, 800, 2):
        words = _text(rng, 90).split()
        edited = [f"z{k}n{i}" if i % 10 == 5 else w for i, w in enumerate(words)]
        rows += [(k, "u", None, " ".join(words)), (k + 1, "u", None, " ".join(edited))]
    got = [tuple(r) for r in neardup.near_pairs(_pages(spark, rows)).collect()]
    want = {p for k in range(0, 800, 2) for p in _pairs(rows[k : k + 2])}
    assert len(want) == 400 and len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.99 * len(want)


def test_very_long_text():
    hasher = neardup._Hasher()
    words = hasher.words("a b c d e f g " * 50_000 + "end")
    assert len(words) == 350_001 and hasher.minima(hasher.shingles(words, 5)).shape == (neardup.TREES * 2 + neardup.SKETCH,)
    assert len(hasher.shingles(hasher.words(""), 5)) == 0 and len(hasher.shingles(hasher.words("one two"), 5)) == 1


def _canonical(url, text):
    keep = lambda x: "".join(re.findall(r"[^\W_]", x.lower()))
    base, _, query = url.partition("?")
    return keep(base) + "".join(sorted(keep(x) for x in query.split("&"))), keep(text)


FORMATS = [
    (3, "http://A.example/p?b=2&a=1", None, "One, two."),
    (2, "http://a.example/p?a=1&b=2#", None, "one   TWO"),
    (9, "http://a.example/p?a=1&b=2#", None, "one   TWO"),
    (1, "http://a.example/p?a=1", None, "one two"),
    (4, None, None, "one two"),
    (5, " ", None, "one two"),
    (6, "http://a.example/p?b=2&a=1", None, None),
    (7, "http://a.example/x", None, "!!!"),
    (8, "http://a.example/x/", None, "..."),
    (10, "http://a.example/p?b=2&a=1", None, "No Article Text Found"),
]


def test_formatting(spark):
    groups = defaultdict(list)
    for page, url, _, text in FORMATS:
        if url and url.strip() and text and text != "No Article Text Found":
            groups[_canonical(url, text)].append(page)
    want = {(min(g), p) for g in groups.values() for p in g if p != min(g)}
    assert {tuple(r) for r in formatting.copies(_pages(spark, FORMATS)).collect()} == want == {(2, 3), (2, 9), (7, 8)}
    assert {tuple(r) for r in formatting.records(_pages(spark, FORMATS)).collect()} == {(2, 3, 2), (1, 1, 1), (7, 2, 2)}
    assert formatting.copies(_pages(spark, [])).count() == 0


def _often(rows, least):
    seen, at = defaultdict(set), []
    for page, url, _, text in rows:
        if url and text and text.strip() and text != "No Article Text Found":
            site = re.sub(r"^www\.", "", re.match(r"(?:\w+:)?(?://)?([^/:?#]*)", url).group(1).lower())
            for k, line in enumerate(text.split("\n"), 1):
                own = "".join(c for c in line.lower() if c.isalpha())
                if own:
                    seen[site, own].add(page)
                    at.append((page, k, site, own))
    return sorted((p, k) for p, k, s, o in at if len(seen[s, o]) >= least)


@pytest.mark.parametrize("batch", ["13", "10000"])
def test_site_lines_against_brute_force(spark, batch):
    rng = random.Random(8)
    rows = []
    for page in range(1, 400):
        lines = [rng.choice(["Menu | Home", "MENU home!", "Footer 12", f"own {chr(97 + page % 26)}{chr(97 + page // 26)}", "", "123", "rare " + "abcdefghi"[page % 9]]) for _ in range(rng.randrange(9))]
        site = "hot.example" if page % 3 else rng.choice(["WWW.b.example:80", "b.example", "c.example"])
        rows.append((page, f"https://{site}/x", None, "\n".join(lines)))
    rows += [(500, None, None, "Menu home\n" * 20), (501, "https://d.example", None, "x y\n" * 20), (502, "https://d.example", None, None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(tuple(r) for r in sitelines.repeated_lines(_pages(spark, rows).repartition(5)).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == _often(rows, 8) and len(got) > 300


def _blocks(rows, least):
    """Maximal blocks by trying all of them."""
    pages, seen = {}, defaultdict(set)
    for page, url, _, text in rows:
        lines = [(k, "".join(c for c in x.lower() if c.isalpha())) for k, x in enumerate(text.split("\n"), 1)]
        pages[page] = (url, [x for x in lines if x[1]])
    for page, (url, lines) in pages.items():
        for i in range(len(lines)):
            for n in range(1, len(lines) - i + 1):
                seen[url, tuple(x for _, x in lines[i : i + n])].add(page)
    out = []
    for page, (url, lines) in pages.items():
        length = [max([n for n in range(1, len(lines) - i + 1) if len(seen[url, tuple(x for _, x in lines[i : i + n])]) >= least], default=0) for i in range(len(lines))]
        out += [(page, lines[i][0], n) for i, n in enumerate(length) if n and (i == 0 or length[i - 1] <= n)]
    return sorted(out)


def test_site_blocks_against_brute_force(spark):
    rng = random.Random(12)
    parts = ["a\nb\nc\nd\ne", "b\nc", "c\nd\ne\nf\ng\nh\ni\nj\nk", "x\n\n1\ny", "e", "a\na\na\na"]
    rows = []
    for page in range(120):
        lines = [rng.choice([*parts, f"own {chr(97 + page % 26)}{chr(97 + page // 26)}"]) for _ in range(rng.randrange(1, 6))]
        rows.append((page, f"https://s{page % 3}.example", None, "\n".join(lines)))
    got = sorted(tuple(r) for r in sitelines.repeated_blocks(_pages(spark, rows)).collect())
    assert got == _blocks(rows, 8) and max(n for *_, n in got) >= 9 and len(got) > 200


def test_site_blocks_of_very_many_lines(spark):
    name = lambda k: "".join(chr(97 + int(d)) for d in str(k))
    long = "\n".join(f"line {name(k)}" for k in range(400))
    rows = [(k, "https://s.example", None, long if k % 2 else long + f"\nown {name(k)}") for k in range(8)] + [(9, "https://s.example", None, long[: len(long) // 2] + " " + "x" * 300_000)]
    got = {tuple(r) for r in sitelines.repeated_blocks(_pages(spark, rows)).collect()}
    half = len((long[: len(long) // 2]).split("\n")) - 1
    assert got == {(k, 1, 400) for k in range(8)} | {(9, 1, half)}
    assert sitelines.repeated_lines(_pages(spark, rows)).count() == 8 * 400 + half


def test_site_blocks_and_removal(spark):
    rows = [(k, "https://s.example", None, f"Top {chr(97 + k)}\nFirst line\n\nSecond line\nown {chr(97 + k)}\nFirst line") for k in range(9)] + [(50, "https://s.example", None, None), (51, None, None, "First line"), (None, "https://s.example", None, "First line")]
    pages = _pages(spark, rows)
    assert {tuple(r) for r in sitelines.repeated_blocks(pages).collect()} == {(k, *b) for k in range(9) for b in ((2, 2), (6, 1))}
    pairs = sitelines.repeated_lines(pages, least_lines=2)
    assert sorted(tuple(r) for r in pairs.collect()) == [(k, n) for k in range(9) for n in (2, 4)]
    cleaned = {r["page_id"]: (r["article_text"], r["removed"]) for r in sitelines.without_repeated(pages, pairs).collect()}
    assert cleaned[0] == ("Top a\n\nown a\nFirst line", 2) and cleaned[50] == (None, 0)
    assert sitelines.repeated_blocks(_pages(spark, [])).count() == 0


ARTICLE = "\n".join(f"Mestská knižnica otvorila novú výstavu číslo {k} a pozvala všetkých čitateľov z celého okolia na večerné čítanie." for k in range(6))
RESIDUE = [
    (1, None, "Dobrý článok", ARTICLE + "\nAutor {{ meno_autora }} píše.", True),
    (2, None, "%title%", ARTICLE, True),
    (3, None, "O šablónach", ARTICLE + "\nZápis „{{ meno }}“ nahradí systém menom.", False),
    (4, None, "Chyba 404", "Stránka Abcdef sa nenašla.", True),
    (5, None, "404: ako na chyby", ARTICLE + "\nChyba 404 je najčastejšia správa na webe.", False),
    (6, None, None, "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do", True),
    (7, None, "Lorem ipsum – čo to je", ARTICLE, False),
    (8, None, "xxx", "xxx xxx xxx xxx", True),
    (9, None, "x", "Zapnite si JavaScript a obnovte stránku /a/b.", True),
    (10, None, "x", ARTICLE + "\nZapnite si JavaScript a obnovte stránku /a/b.", False),
    (11, None, "x", "Krátka správa o počasí v meste.", False),
    (12, None, "404 Not Found", None, False),
    (13, None, "No Title Found", "No Article Text Found", False),
    (14, None, None, ARTICLE + " [1] […] 50 % a #tag", False),
    (15, None, "Not Found – Denník", "Nič tu nie je.", True),
    (16, None, "Service unavailable", "Na tejto adrese Abc momentálne prebieha údržba portálu, ďakujeme vám za trpezlivosť a pochopenie.", True),
    (17, None, "x", "Na tejto adrese Def momentálne prebieha udržba portálu, ďakujeme vám za trpezlivosť a pochopenie.", True),
    (18, None, "x", "Na tejto adrese Ghi momentálne prebieha údržba portálu, ďakujeme vám za trpezlivosť a pochopenie.", True),
    (19, None, "Nadpis sem | Denník", ARTICLE, True),
    (20, None, "x", ARTICLE + "\nPozri [poznámka] a %podiel% hlasov.", False),
    (21, None, "x", ARTICLE + "\nPísal [MENO_AUTORA], #meno.autora# a [title] v meste.", True),
    (22, None, "x", ARTICLE + "\nPoznámka [title_text] chýba.", True),
    (23, None, "x", ARTICLE + "\nVoláme ho ${title} odvtedy.", True),
    (24, None, "x", ARTICLE + "\nVoláme ho [title] odvtedy.", True),
]


def test_residue(spark):
    rows = [r[:4] for r in RESIDUE]
    got = {r["page_id"]: r["own"] for r in residue.evidence(_pages(spark, rows)).collect()}
    assert set(got) == {r[0] for r in RESIDUE if r[4]}
    assert {p for p, own in got.items() if not own} == {9, 17, 18, 24}
    assert residue.residue_pages(_pages(spark, [])).count() == 0
    assert residue.residue_pages(_pages(spark, [(1, "u", None, None), (None, "u", "404", "x y z")])).count() == 0


def test_residue_needs_its_edges(spark, monkeypatch):
    none = spark.createDataFrame([], "a bigint, b bigint")
    monkeypatch.setattr(residue, "similar_lines", lambda prints: none)
    got = {r["page_id"] for r in residue.residue_pages(_pages(spark, [r[:4] for r in RESIDUE])).collect()}
    assert got == {r[0] for r in RESIDUE if r[4]} - {9, 17}


def test_lines_that_articles_have_do_not_spread(spark):
    notice = "Táto stránka používa súbory cookies na zlepšenie služieb."
    rows = [(k, "u", "404", f"Adresa /a{k} už nie je medzi našimi stránkami.\n{notice}") for k in range(3)]
    rows += [(k, "u", "x", ARTICLE + "\n" + notice) for k in range(10, 30)]
    rows += [(40, "u", "x", notice + "\nKrátka správa o počasí."), (41, "u", "x", notice + "\nAdresa /b už nie je medzi našimi stránkami.")]
    assert {r["page_id"]: r["own"] for r in residue.evidence(_pages(spark, rows)).collect()} == {0: True, 1: True, 2: True, 41: False}


def test_simhash_is_close_for_close_lines():
    a, b, c = (residue.simhash(residue.mask(x)) for x in ("stránka sa nenašla skontrolujte prosím adresu v prehliadači alebo sa vráťte na úvod", "stránka sa nenašla skontrolujte prosím adresu v prehliadači alebo sa vráťte na začiatok", "mestská knižnica otvorila novú výstavu fotografií z histórie"))
    bits = lambda x, y: bin((x ^ y) & (2**64 - 1)).count("1")
    assert bits(a, b) < bits(a, c)
    assert residue.simhash([]) == 0 and residue.mask("/a/b 404") == ["@", "#"]
    assert residue.mask("Chyba 404: adresa Abc Def /x neexistuje. Skúste JavaScript.") == "chyba # adresa @ neexistuje skúste javascript".split()


@pytest.mark.parametrize("block", [4, 512])
def test_all_lines_of_a_bucket_are_compared(spark, monkeypatch, block):
    monkeypatch.setattr(residue, "BLOCK", block, raising=False)
    rows = [(1000, 5, ["same"] * 3), (1, 5 - 2**63, ["same"])] + [(k, 5 + (k << 40), [f"other{k}"]) for k in range(2, 32)]
    rows += [(2000, 9, ["x", "y"])] + [(k, 9 - 2**63 * (k % 2), ["x", "y"]) for k in range(2001, 2012)]
    got = [tuple(r) for r in residue.similar_lines(spark.createDataFrame(rows, "node bigint, print bigint, words array<string>")).collect()]
    want = {(1, 1000)} | {(a, b) for a in range(2000, 2012) for b in range(a + 1, 2012)}
    assert len(got) == len(want) and set(got) == want


def test_short_lines_with_a_changed_word_are_linked(spark):
    rng = random.Random(9)
    lines = [" ".join(rng.sample(WORDS, rng.randrange(5, 12))) for _ in range(40)]
    for line in list(lines):
        for _ in range(3):
            words = line.split()
            words[rng.randrange(len(words))] = rng.choice(WORDS)
            lines.append(" ".join(words))
            lines.append(f"{line} {rng.choice(WORDS)}")
    lines = sorted(set(lines))
    rows = [(k, residue.simhash(x.split()), x.split()) for k, x in enumerate(lines)]
    sets = [set(x.split()) for x in lines]
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    got = [tuple(r) for r in residue.similar_lines(spark.createDataFrame(rows, "node bigint, print bigint, words array<string>")).collect()]
    assert len(want) > 200 and len(got) == len(want) and set(got) == want


def _site_page(rng, k):
    """A page with known labels: 1 around the article."""
    lines = [("Domov | Šport | Kultúra | Video", 1), ("Táto stránka používa súbory cookies. Súhlasím", 1)]
    for _ in range(rng.randrange(2, 6)):
        lines.append((f"Mestská knižnica v obci číslo {rng.randrange(900)} otvára výstavu pre {rng.choice(WORDS)} a {rng.choice(WORDS)}, pretože {rng.choice(WORDS)} sleduje nové možnosti. Potom {rng.choice(WORDS)} pripraví program.", 0))
        if rng.random() < 0.4:
            lines.append((f"Čo prinesie {rng.choice(WORDS).title()} v lete", 0))
            lines.append((f"Starý most pri rieke {rng.choice(WORDS)} spája obe časti mesta a slúži všetkým obyvateľom už {rng.randrange(90)} rokov.", 0))
        if rng.random() < 0.4:
            lines.append((f"Čítajte aj: {rng.choice(WORDS).title()} testuje recepty", 1))
    lines += [("Zdieľajte tento článok na sociálnych sieťach", 1), (f"Komentáre ({k})", 1), (f"© {2010 + k % 9} Denník", 1)]
    return lines


def test_random_field_on_held_out_pages(spark):
    rng = random.Random(4)
    made = [_site_page(rng, k) for k in range(260)]
    rows = [(k, f"https://s{k % 3}.example/{k}", None, "\n".join(x for x, _ in p)) for k, p in enumerate(made)]
    model = mainbody.fit(_pages(spark, rows[:160]))
    assert len(model.weights) > 50
    got = {tuple(r) for r in mainbody.lines_around(_pages(spark, rows[160:]), model).collect()}
    want = {(k, n) for k in range(160, 260) for n, (_, y) in enumerate(made[k], 1) if y}
    assert len(got & want) >= 0.97 * len(want) and len(got & want) >= 0.97 * len(got)
    body = mainbody.bodies(_pages(spark, rows[160:161]), model).first()["body"]
    assert "Komentáre" not in body and "knižnica" in body


def test_long_notice_told_by_its_middle(spark):
    rng = random.Random(7)
    some = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))

    def page(k):
        notice = " ".join(f"{some(9).capitalize()} všetky autorské práva vyhradené {some(9)}." for _ in range(4))
        decoy = " ".join(f"{some(12).capitalize()}." for _ in range(2)) + f" {some(9).capitalize()} o cookies {some(9)}. " + " ".join(f"{some(12).capitalize()}." for _ in range(2))
        return [*_site_page(rng, k), (notice, 1), (decoy, 0)]

    made = [page(k) for k in range(260)]
    assert all(len(x.split()) > 60 for p in made for x, _ in p[-2:])
    rows = [(k, f"https://s{k % 3}.example/{k}", None, "\n".join(x for x, _ in p)) for k, p in enumerate(made)]
    got = {tuple(r) for r in mainbody.lines_around(_pages(spark, rows[160:]), mainbody.fit(_pages(spark, rows[:160]))).collect()}
    told = [((k, len(made[k]) - 1) in got, (k, len(made[k])) in got) for k in range(160, 260)]
    assert sum(a for a, _ in told) >= 97 and sum(b for _, b in told) <= 3


def test_viterbi_against_all_paths():
    from itertools import product

    rng = random.Random(2)
    lines = ["a b", "c", "d e f", "g"]
    names = mainbody.features(lines)
    for _ in range(30):
        model = mainbody.Field({x: rng.uniform(-1, 1) for f in names for x in f}, tuple(rng.uniform(-2, 2) for _ in range(4)))
        score = lambda y: sum(sum(model.weights[x] for x in f) for f, v in zip(names, y, strict=True) if v) + sum(model.steps[2 * a + b] for a, b in zip(y, y[1:], strict=False))  # noqa: B023, E731
        assert model.decode(lines) == list(max(product((0, 1), repeat=4), key=score))


def test_random_field_without_pages(spark):
    empty = _pages(spark, [])
    model = mainbody.fit(empty)
    assert model.decode(["x"]) == [0] and model.decode([]) == []
    assert mainbody.lines_around(_pages(spark, [(1, "u", None, "x\n\ny"), (2, "u", None, None)]), model).count() == 0


def test_numbers_count_blank_lines():
    assert mainbody._lines("a\n\n b \n\n") == ([1, 3], ["a", "b"])


def test_odd_rows_in_all_operators(spark):
    long = " ".join(f"slovo{k % 997}" for k in range(120_000))
    rows = [(1, "https://s.example/a", "x", long), (1, "https://s.example/a", "x", long), (2, None, None, long + " koniec"), (None, "https://s.example/b", "404", "x y z"), (3, "::", "", ""), (4, "https://s.example", "\n", " \xa0\n"), (5, "https://s.example", None, None), (6, "https://s.example", "t", "a\n" * 200 + "{" * 50_000)]
    pages = _pages(spark, rows)
    assert {tuple(r) for r in neardup.near_pairs(pages).collect()} == {(1, 2)}
    assert {(r["page_id"], r["group_id"], r["links"]) for r in neardup.groups(pages).collect()} == {(1, 1, 1), (2, 1, 1), (6, 6, 0)}
    assert residue.residue_pages(pages).count() == 0
    assert sitelines.repeated_lines(pages, least_pages=1).where("page_id = 6").count() == 200
    model = mainbody.fit(pages)
    assert mainbody.lines_around(pages, model).select("page_id").distinct().count() <= 4
    assert formatting.records(pages).where("page_id = 1").first()["copies"] == 2
