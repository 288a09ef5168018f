"""Language names and codes, scripts and fonts; addresses of services; how a service is used."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes that services take, scripts that need a font of their own, and services whose answers are always the same.
NAMES = {"english": "en", "french": "fr", "spanish": "es", "german": "de", "italian": "it", "portuguese": "pt", "russian": "ru", "zh": "zh-CN", "chinese": "zh-CN", "japanese": "ja", "korean": "ko", "arabic": "ar"}
SCRIPTS = {"ar": "arabic", "zh": "chinese", "zh-cn": "chinese", "zh-tw": "chinese", "ja": "japanese", "ko": "korean", "ru": "cyrillic", "uk": "cyrillic", "bg": "cyrillic", "el": "greek", "he": "hebrew", "th": "thai", "hi": "devanagari", "mr": "devanagari", "ne": "devanagari"}
SAME_ANSWER = {"cascade", "free", "huggingface", "libre", "argos", "mymemory"}
BATCHED = {"cascade", "free", "libre", "argos"}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(v) for pair in table.items() for v in pair))[key]


def code(lang: Column) -> Column:
    """A service's code for a language's name or code; others stay, in lower case."""
    low = F.lower(F.trim(lang))
    return F.coalesce(_lookup(NAMES, low), low)


def script(lang: Column) -> Column:
    """The script that needs a font of its own; null for Latin and unknown ones."""
    return _lookup(SCRIPTS, F.lower(lang))


def font_file(lang: Column) -> Column:
    """Name of the font file of a language's script; null where any font will do."""
    return F.concat(F.lit("noto-"), script(lang), F.lit(".ttf"))


def address(url: Column) -> Column:
    """A service's base address: no slashes or version at the end, and with a protocol."""
    bare = F.regexp_replace(F.regexp_replace(url, "/+$", ""), "/v1$", "")
    return F.when(F.startswith(bare, F.lit("http")), bare).otherwise(F.concat(F.lit("https://"), bare))


@dataclass(frozen=True)
class Route:
    """How one run uses its service; `without` switches stages off."""

    service: str
    candidates: int = 1
    rerank: bool = True
    fast: bool = False
    batched: bool = False
    without: frozenset[str] = frozenset()

    #: Stages that can be switched off.
    STAGES = ("masking", "glossary", "context", "reranking", "validation", "refinement")

    def settled(self) -> Route:
        """One candidate and no re-ranking where answers are always the same; batches in fast mode and for simple services."""
        unknown = self.without - set(self.STAGES)
        if unknown:
            raise ValueError(f"no such stages: {sorted(unknown)}")
        name = self.service.lower()
        same = name in SAME_ANSWER
        return replace(self, candidates=1 if same else self.candidates, rerank=self.rerank and not same and "reranking" not in self.without, batched=self.fast or name in BATCHED)

    def stage(self, name: str, run, df):
        """df through a stage, or as it is where the stage is switched off."""
        if name not in self.STAGES:
            raise ValueError(f"no such stage: {name}")
        return df if name in self.without or (name == "reranking" and not self.settled().rerank) else run(df)


def best_match(matches: Column, direct: Column, least: float = 0.7) -> Column:
    """Translation of the match of highest quality (equal ones: the first) if that is above `least`, else the direct answer.

    matches: array of structs with translation and quality (text or number; null counts 0). A quality that is no number voids all matches.
    """
    quality = lambda m: F.when(m["quality"].isNull(), F.lit(0.0)).otherwise(m["quality"].try_cast("double"))
    scored = F.transform(matches, lambda m, k: F.struct(quality(m).alias("q"), (-k).alias("k"), m["translation"].alias("t")))
    top = F.array_max(scored)
    usable = ~F.exists(scored, lambda s: s["q"].isNull()) & (top["q"] > least)
    return F.when(F.coalesce(usable, F.lit(False)), top["t"]).otherwise(F.when(F.length(direct) > 0, direct))
