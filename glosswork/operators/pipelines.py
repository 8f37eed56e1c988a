"""Pipelines by name: what is done to a text before it is counted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from glosswork.resources import language_code

# The names of the pipelines, in their order.
NAMES = ("baseline", "stemming", "lemmatization")


@dataclass(frozen=True)
class Pipeline:
    """A pipeline for a language; Czech stems are cut by rule, everything else takes a dictionary."""

    name: str = "baseline"
    language: str = "cs"

    @property
    def cuts_suffixes(self) -> bool:
        return self.name == "stemming" and self.language == "cs"

    def options(self, lemmas: DataFrame | None = None) -> dict:
        """Arguments of ``index.build`` and ``rank.query_terms``; the dictionary counts where the pipeline asks for one."""
        wants = self.name == "lemmatization" or (self.name == "stemming" and not self.cuts_suffixes)
        return {"language": self.language, "stem": self.cuts_suffixes, "lemmas": lemmas if wants else None}


def chosen(names: str | None) -> list[str]:
    """The pipelines of a list with commas, each once, in its order; all for an empty list or ``all``. Raises on others."""
    asked = [x.strip().lower() for x in (names or "").split(",") if x.strip()]
    if not asked or "all" in asked:
        return list(NAMES)
    unknown = [x for x in asked if x not in NAMES]
    if unknown:
        raise ValueError(f"no such pipelines: {', '.join(unknown)}")
    return list(dict.fromkeys(asked))


def named(name: str) -> Pipeline:
    """The pipeline of a name such as ``stemming_en``; Czech without a language. Raises on other names."""
    base, _, language = name.strip().lower().partition("_")
    if base not in NAMES:
        raise ValueError(f"no such pipeline: {name}")
    return Pipeline(base, language_code(language))
