"""Language identification by words first, character n-grams where a word is unknown.

A word that the model knows scores its per-language log frequency.  An unknown
word falls back to its longest known character n-grams, then to shorter ones.
Scores are centred over the languages, so known and unknown words add up.

Nulls, empty texts and texts without a letter (digits, other numerals, marks and symbols alone) are ``und`` with score 0.  Rows
with a null id or null language are predicted like others; a null language is
never learned from.  Every row in gives one row out, repeated rows too.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plangauge.llm.common import map_rows

UNKNOWN = "und"
# Below U+0300 there are no combining marks, and these numerals are the only ones that \\w holds and \\d does not.
NOT_LETTERS = re.compile(r"[\W\d_\u00b2\u00b3\u00b9\u00bc\u00bd\u00be]+")
BEYOND = re.compile("[\u0300-\U0010ffff]")


@dataclass(frozen=True)
class LanguageModel:
    """Centred log frequencies: ``words[w]`` and ``grams[n][g]`` are tuples, one number per language."""

    languages: tuple[str, ...]
    words: dict[str, tuple[float, ...]]
    grams: dict[int, dict[str, tuple[float, ...]]]


def letters_only(text: str | None) -> list[str]:
    """Lower-case runs of letters and of the marks that belong to them, with a letter in each."""
    if not text:
        return []
    text = text.lower()
    if BEYOND.search(text) is None:
        return NOT_LETTERS.sub(" ", text).split()
    import regex

    return regex.findall(r"\p{M}*\p{L}[\p{L}\p{M}]*", text)


def _grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def train(
    labelled: DataFrame, text: str = "text", lang: str = "lang", docs_per_language: int = 1500,
    max_languages: int | None = None, max_words: int = 40_000, max_grams: int = 30_000, min_count: int = 3, longest: int = 5,
) -> LanguageModel:
    """Fit on a bounded sample: about ``docs_per_language`` rows of each language, picked by a hash of the text.

    Every language is learned, unless ``max_languages`` asks for those with most rows only.  ``max_words`` and ``max_grams`` (per
    language, most frequent first) bound the model; ``longest`` is the longest n-gram.
    """
    known = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    by_language = known.groupBy("lang").count().orderBy(F.desc("count"), "lang")
    rows = (by_language if max_languages is None else by_language.limit(max_languages)).collect()
    if not rows:
        return LanguageModel((), {}, {})
    languages = tuple(sorted(r["lang"] for r in rows))
    share = F.create_map(*[F.lit(x) for r in rows for x in (r["lang"], min(1.0, docs_per_language / r["count"]))])
    chance = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.filter(chance < F.coalesce(share[F.col("lang")], F.lit(0.0)))

    def make():
        def count(texts, langs):
            seen: dict[str, Counter] = {}
            for t, l in zip(texts, langs):
                seen.setdefault(l, Counter()).update(letters_only(t))
            return [(l, w, n) for l, c in seen.items() for w, n in c.items()]

        return count

    counts = map_rows(sample, "lang string, word string, n long", make).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    by_word: dict[str, dict[str, int]] = {}
    by_gram: dict[int, dict[str, Counter]] = {n: {l: Counter() for l in languages} for n in range(1, longest + 1)}
    total = Counter()
    for r in counts.toLocalIterator():
        total[r["lang"]] += r["n"]
        if r["n"] >= min_count:
            by_word.setdefault(r["word"], {})[r["lang"]] = r["n"]
        for n in by_gram:
            of = by_gram[n][r["lang"]]
            for g in _grams(r["word"], n):
                of[g] += r["n"]

    def centred(found: list[int], sums: list[int], size: int) -> tuple[float, ...]:
        logs = [math.log((c + 0.5) / (s + 0.5 * size + 1)) for c, s in zip(found, sums)]
        middle = sum(logs) / len(logs)
        return tuple(x - middle for x in logs)

    sums = [total[l] for l in languages]
    top = {w for l in languages for w, _ in sorted(((w, c[l]) for w, c in by_word.items() if l in c), key=lambda x: (-x[1], x[0]))[:max_words]}
    words = {w: centred([by_word[w].get(l, 0) for l in languages], sums, len(by_word)) for w in sorted(top)}
    grams = {}
    for n, of in by_gram.items():
        names = {g for l in languages for g, _ in sorted(of[l].items(), key=lambda x: (-x[1], x[0]))[:max_grams]}
        gram_sums = [sum(of[l].values()) for l in languages]
        grams[n] = {g: centred([of[l][g] for l in languages], gram_sums, len(names)) for g in sorted(names) if sum(of[l][g] for l in languages) >= min_count}
    return LanguageModel(languages, words, grams)


class Scorer:
    """Scores one text; remembers the scores of up to ``limit`` unknown words."""

    limit = 200_000

    def __init__(self, model: LanguageModel):
        self.model = model
        self.unseen: dict[str, tuple[float, ...]] = {}

    def _back_off(self, word: str) -> tuple[float, ...]:
        """Mean over the known n-grams of the greatest length at which half of them are known."""
        for n in sorted(self.model.grams, reverse=True):
            known = self.model.grams[n]
            parts = _grams(word, n)
            hits = [known[g] for g in parts if g in known]
            if hits and 2 * len(hits) >= len(parts):
                return tuple(sum(x) / len(hits) for x in zip(*hits))
        return (0.0,) * len(self.model.languages)

    def __call__(self, text: str | None) -> tuple[str, float]:
        found = Counter(letters_only(text))
        languages = self.model.languages
        if not found or not languages:
            return UNKNOWN, 0.0
        sums = [0.0] * len(languages)
        words, unseen = self.model.words, self.unseen
        for word, n in found.items():
            score = words.get(word) or unseen.get(word)
            if score is None:
                if len(unseen) >= self.limit:
                    unseen.clear()
                score = unseen[word] = self._back_off(word)
            for i, x in enumerate(score):
                sums[i] += n * x
        best = max(sums)
        at = sums.index(best)
        return languages[at], 1.0 / sum(math.exp(max(-700.0, x - best)) for x in sums)


def identify(df: DataFrame, model: LanguageModel, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` (all by default) of every row with ``lang_pred`` and ``score``; no shuffle."""
    carry = df.columns if carry is None else carry
    shared = df.sparkSession.sparkContext.broadcast((model.languages, model.words, model.grams))
    names = [f"c{i}" for i in range(len(carry))]
    plain = df.select(F.col(f"`{text}`").alias("text"), *[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names)])
    kinds = ", ".join(f"{n} {t}" for n, t in plain.select(*names).dtypes)

    def make():
        score = Scorer(LanguageModel(*shared.value))

        def work(texts, *rest):
            for t, *others in zip(texts, *rest):
                yield (*others, *score(t))

        return work

    made = map_rows(plain, ", ".join(filter(None, [kinds, "lang_pred string, score double"])), make)
    taken = {"lang_pred", "score"}
    return made.select(*[F.col(n).alias(c) for c, n in zip(carry, names) if c not in taken], "lang_pred", "score")
