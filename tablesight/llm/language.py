"""Language identification by compression.

Each language has a dictionary of raw text. A document is reduced to its words in lower case and cut
into blocks, and every block is compressed by zstandard once per language with that language's
dictionary; the language whose blocks come out smallest in sum is chosen, the commoner one in a tie.
Blocks keep a long text from becoming its own dictionary, so all of it bears on the choice. A choice
is confident unless the runner-up is about as small.

Dictionaries hold at most ``DICTIONARY_BYTES`` per language, from the ``SAMPLE`` documents with the
smallest hashes. Short texts are taken whole; longer ones give equal shares of what is left, in parts
spread over the whole text. An id that repeats is one document, so neither rows nor characters that
reach the driver grow with it. Only fitting is bounded; texts are judged whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DICTIONARY_BYTES = 100_000
#: Documents per language that the dictionaries are cut from.
SAMPLE = 200
#: Length of the parts taken from long texts.
PART_CHARS = 500
BLOCK_BYTES = 4_000
LEVEL = 5
#: Bytes saved that make a language e times likelier, and the least probability of a confident choice.
SCALE, CONFIDENT = 2.0, 0.8
#: Languages told apart; a bound on the driver's tallies, far above what language columns hold.
MOST_LANGUAGES = 1_000


_WORD = r"[^\W\d_]+"


def _share(lengths: np.ndarray, size: int) -> int:
    """The most characters a document may give so that all together give ``size``, at least 1."""
    left, lengths = size, np.sort(lengths)
    for i, length in enumerate(lengths):
        share = left // (len(lengths) - i)
        if length > share:
            return max(share, 1)
        left -= int(length)
    return max(int(lengths[-1]), 1)


def _spread(text: Column, share: Column) -> Column:
    """A text of at most ``share`` characters, or parts of as many in all from evenly spread places of it."""
    many = F.ceil(share / F.lit(PART_CHARS)).cast("int")
    part = F.greatest(F.lit(1), F.floor(share / many).cast("int"))
    places = F.transform(
        F.sequence(F.lit(0), many - 1),
        lambda i: F.substring(text, F.greatest(F.lit(1), F.floor((2 * i + 1) * F.length(text) / (2 * many)).cast("int") - F.floor(part / 2).cast("int") + 1), part),
    )
    return F.when(F.length(text) <= share, text).otherwise(F.array_join(places, " "))


def dictionaries(docs: DataFrame, sample: int = SAMPLE, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Raw text per language of ``docs`` (doc_id, text, lang), at most ``size`` bytes each, the commonest language first.

    Null or empty texts, null languages and documents held out (crc32 of the id divisible by 5) are not used.
    Of the rows of one id the one with the least language and hash of its text counts.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    usable = docs.where("lang is not null and length(text) > 0").where(~held_out)
    common = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    learned = [r["lang"] for r in common]
    marked = usable.select("doc_id", "lang", "text", F.xxhash64("text").alias("mark"))
    ones = marked.groupBy("doc_id").agg(F.min(F.struct("lang", "mark", F.length("text").alias("length"))).alias("one"))
    ranked = ones.select("doc_id", "one.*", F.xxhash64("doc_id").alias("draw")).where(F.col("lang").isin(learned))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id"))
    picks = ranked.withColumn("rank", rank).where(F.col("rank") <= sample).drop("rank").toPandas()  # at most ``sample`` per language
    if picks.empty:
        return {}
    picks["share"] = picks.groupby("lang")["length"].transform(lambda x: _share(x.to_numpy(), size))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, mark bigint, draw bigint, share bigint"
    chosen = docs.sparkSession.createDataFrame(picks[["doc_id", "lang", "mark", "draw", "share"]], schema)
    parts = marked.join(F.broadcast(chosen), ["doc_id", "lang", "mark"]).select("doc_id", "lang", "draw", _spread(F.col("text"), F.col("share")).alias("text"))
    rows = parts.groupBy("doc_id", "lang", "draw").agg(F.min("text").alias("text")).toPandas().sort_values(["lang", "draw", "text"])
    words, out = re.compile(_WORD), {}
    for lang in learned:
        texts = rows.loc[rows["lang"] == lang, "text"].drop_duplicates()
        out[lang] = "\n".join(" ".join(words.findall(t.lower())) for t in texts).encode()[:size]
    return {lang: raw for lang, raw in out.items() if len(raw) >= 8}


def classify(raw: dict[str, bytes], text: Column) -> Column:
    """Struct (lang, score, confident) of a text column; ``und`` with score 0 for a null or letterless text.

    ``score`` is the share of the chosen language among all, each weighted by e to the bytes it saves.
    With no language learned every text is ``und``. Ties go to the first language of ``raw``.
    """

    @F.pandas_udf("lang string, score double, confident boolean")
    def chosen(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import zstandard

        names, words, tools = list(raw), re.compile(_WORD), []
        for name in names:
            known = zstandard.ZstdCompressionDict(raw[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            tools.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False))
        for texts in batches:
            rows = []
            for text in texts:
                data = " ".join(words.findall(text.lower())).encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
                if not data or not names or not any(map(str.isalpha, text)):
                    rows.append(("und", 0.0, False))
                    continue
                blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
                sizes = np.array([sum(len(tool.compress(b)) for b in blocks) for tool in tools], float)
                share = np.exp(np.maximum((sizes.min() - sizes) / SCALE, -700))
                share /= share.sum()
                best = int(sizes.argmin())
                rows.append((names[best], float(share[best]), bool(share[best] >= CONFIDENT)))
            yield pd.DataFrame(rows, columns=["lang", "score", "confident"])

    return chosen(text.cast("string"))


def languages(docs: DataFrame, sample: int = SAMPLE, size: int = DICTIONARY_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred, score, confident (false: the margin is too narrow).

    A null id is not held out and never learned from.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    found = docs.select("doc_id", held_out.alias("held_out"), classify(dictionaries(docs, sample, size), F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"), F.col("found.confident").alias("confident"))
