"""Language resources: stopwords, suffixes, accent folding, key priorities."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# Stopwords without accents, by language.
STOPWORDS: dict[str, list[str]] = {
    "cs": (
        "a aby ale ani aniz ano asi az bud coz ci i jak jako jakoz jestli jestlize kdyz nebot nebo necht pokud proto protoze tak takze tedy vsak ze "
        "bez beze do k ke ku mezi na nad nade o od ode po pod podle pro pred prede pres prese pri s se u v ve z za "
        "co ho jaky jeho jej jeji jejich jemu jenz jez ji jich jimi ja kam kde kdo kdy ktery ktera ktere kteri me mi mne mnou muj my nam nas nase "
        "nasi nichz ni nim nimi on ona oni ono ony si sve svuj svym ta tam tato ten tento ti tim to toho tom tomu tu tuto tvuj ty tyto teto te tem "
        "vy vam vami vas by byl byla byli bylo byly bys byt je jsi jsme jsou jste ne nebyl nebyla nebyli nebylo nebyly nejsou"
    ).split(),
    "sk": (
        "a aby aj ak ako ale ani ano asi aspon bez bol bola boli bolo by byt cez co dakedy dnes do dobre dost ho hodne i ja jak je "
        "jeho jej jemu len ma maju mame malo mezi mi mna mnou moj moze my na nad nam nas ne nebol nebola neboli nebolo nic nielen od o on "
        "ona oni ono po pod podla pokial potom pre pred pri sa si sme som ste ta tak takze tam teda ten tento to tom tomu tu tvoj ty u v vo vy z za ze"
    ).split(),
    "en": (
        "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing down "
        "during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most "
        "my myself no nor not of off on once only or other our ours ourselves out over own same she should so some such than that the their theirs them themselves "
        "then there these they this those through to too under until up very was we were what when where which while who whom why with you your yours yourself yourselves"
    ).split(),
}
# Names by which the languages may be asked for.
LANGUAGES = {"cs": "cs", "czech": "cs", "czech language": "cs", "sk": "sk", "slovak": "sk", "slovak language": "sk", "en": "en", "english": "en", "english language": "en"}
# The Czech suffixes that a word without accents can end in, longest first.
CZECH_SUFFIXES = "kami osti kou emi ami ovi ost ho ta mu ou ty om em ti mi te ch tu e y i a".split()
# Keys of records, in the order in which they are tried.
TEXT_KEYS = "text article_text normalized_text content body fact description title".split()
DOCUMENT_ID_KEYS = "id doc_id document_id docno url".split()
QUERY_ID_KEYS = "id qid query_id queryid".split()
QUERY_TEXT_KEYS = "description query text title question".split()
TITLE_KEYS = "title headline name".split()


def language_code(language: str | None) -> str:
    """cs, sk or en for a name of the language; cs for none. Raises on any other."""
    if not language:
        return "cs"
    try:
        return LANGUAGES[language.strip().lower()]
    except KeyError:
        raise ValueError(f"language {language!r} is none of cs, sk, en") from None


#: Code point from which characters are decomposed by the Unicode library instead of by the map.
FAR = 0x600


def _bare(char: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))


@lru_cache(maxsize=1)
def accent_map() -> tuple[str, str]:
    """Letters and digits before ``FAR`` beside their form without marks, by compatibility decomposition, where that is one character."""
    pairs = [(chr(k), _bare(chr(k))) for k in range(0xAA, FAR) if chr(k).isalnum()]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


@lru_cache(maxsize=1)
def accent_classes() -> tuple[str, str]:
    """Classes for the regex engine: what the map does not cover (characters that become several, and those from ``FAR``), and marks that are dropped."""
    several = "".join(chr(k) for k in range(0xAA, FAR) if len(_bare(chr(k))) > 1)
    marks, start = [], None
    for k in range(0x300, 0x1F000):
        on = unicodedata.combining(chr(k)) > 0
        if on and start is None:
            start = k
        if not on and start is not None:
            marks.append(rf"\x{{{start:x}}}-\x{{{k - 1:x}}}")
            start = None
    low = "".join(rf"\x{{{k:x}}}" for k in range(0x300, FAR) if unicodedata.combining(chr(k)))
    return f"[{several}{low}\\x{{{FAR:x}}}-\\x{{10ffff}}]", "[" + "".join(marks) + "]"
