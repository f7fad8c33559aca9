"""Spelling variant grouping: words one edit apart, found in the neighbourhoods of words over a reduced alphabet.

Letters are hashed to SYMBOLS symbols.  Words one edit apart have reduced words that are equal or one edit apart, so that joining the full
one-edit neighbourhood of each reduced word with the reduced words finds every pair; the pairs are verified on the words themselves.
A neighbourhood over few symbols is small, and it is made once for all words that reduce alike.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
#: Symbols of the reduced alphabet: fewer make neighbourhoods smaller and let more words meet that are not alike.
SYMBOLS = 8
MIN_CHARS, MIN_COUNT = 6, 5
#: A form is at least so many times as frequent as its variant.
RATIO = 5
#: One run in so many loses a letter.
DAMAGE = 199

_UPPER, _LOWER = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
_LETTERS = _LOWER + "".join(map(chr, range(0xC0, 0x100)))


def _lowered(run: Column) -> Column:
    """Only A-Z; ``lower`` alone would change other letters too."""
    return F.when(F.octet_length(run) == F.char_length(run), F.lower(run)).otherwise(F.translate(run, _UPPER, _LOWER))


def runs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id string, run) for each maximal run of letters, lower-cased in A-Z; a null id is an empty string, a null text has none."""
    src = documents.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(RUN), 0)).alias("run"))
    return src.select("id", _lowered(F.col("run")).alias("run"))


def damaged(found: DataFrame, one_in: int = DAMAGE) -> DataFrame:
    """(word): the runs, of which those whose crc32 with the id ``one_in`` divides lose the code point that it points at."""
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = F.expr("cast(h % char_length(run) as int)")
    cut = F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)"))
    return found.withColumn("h", h).withColumn("at", at).select(F.when(F.col("h") % one_in == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    return words.where(F.char_length("word") >= min_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def reduced(word: Column, symbols: int = SYMBOLS) -> Column:
    """The word with a symbol for each letter."""
    return F.translate(word, _LETTERS, "".join(chr(48 + zlib.crc32(c.encode()) % symbols) for c in _LETTERS))


def _neighbourhood(word: str, symbols: int = SYMBOLS) -> Column:
    """A reduced word and all that one inserted, deleted or replaced symbol makes of it."""
    each = "array(" + ", ".join(f"'{s}'" for s in range(symbols)) + ")"
    return F.expr(
        f"array_distinct(concat(array({word}), "
        f"transform(sequence(1, char_length({word})), i -> concat(left({word}, i - 1), substring({word}, i + 1))), "
        f"flatten(transform({each}, s -> transform(sequence(1, char_length({word})), i -> concat(left({word}, i - 1), s, substring({word}, i + 1))))), "
        f"flatten(transform({each}, s -> transform(sequence(0, char_length({word})), i -> concat(left({word}, i), s, substring({word}, i + 1)))))))"
    )


def near_words(vocab: DataFrame, scratch: Scratch, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n, other, other_n) of all pairs of ``vocab`` (word, n) one inserted, deleted or replaced code point apart, each in both directions."""
    words = scratch.save(vocab.withColumn("r", reduced(F.col("word"), symbols)).withColumn("key", F.xxhash64("r")))
    keys = scratch.save(words.groupBy("key").agg(F.min("r").alias("r")))
    # Two reduced words whose hashes meet are one key; both lists of words are then compared.
    around = words.select("key", "r").distinct().select("key", F.explode(_neighbourhood("r", symbols)).alias("s")).select("key", F.xxhash64("s").alias("other_key"))
    # Most of a neighbourhood is no word at all; only what is one is told apart, should hashes have met.
    pairs = around.join(keys.select(F.col("key").alias("other_key")).hint("shuffle_hash"), "other_key").distinct()
    left = scratch.save(pairs).join(words.select("key", "word", "n"), "key")
    both = left.join(words.select(F.col("key").alias("other_key"), F.col("word").alias("other"), F.col("n").alias("other_n")), "other_key")
    return both.where("word != other and levenshtein(word, other, 1) = 1").select("word", "n", "other", "other_n")


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root): each word of ``forms`` (word, form) with the last word of its chain of forms, by doubling the steps."""
    at = scratch.save(forms.select("word", F.col("form").alias("root")))
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = scratch.save(at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        scratch.drop(at)
        moved = now.where("moved").limit(1).count()
        at = now.select("word", "root")
        at._scratch_path = now._scratch_path
        if not moved:
            return at


def variant_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO, one_in: int = DAMAGE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of all texts.

    A word's form is its most frequent near word, the smallest on ties, if that is ``ratio`` times as frequent; its root is the end of
    the chain of forms.  Null texts have no words, a null id counts as an empty one, repeated rows count again, other columns are not
    read, and an empty table gives an empty one.
    """
    scratch = Scratch(documents.sparkSession, "spelling")
    vocab = scratch.save(vocabulary(damaged(runs(documents, id_col, text_col), one_in)))
    best = near_words(vocab, scratch).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    found = vocab.join(best, "word", "left").withColumn("ok", F.expr(f"-best.less >= {ratio} * n"))
    known = scratch.save(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.expr("if(ok, best.other, null)").alias("form"), F.expr("if(ok, -best.less, null)").alias("form_n")))
    out = known.join(roots(known.where("form is not null"), scratch), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


__all__ = ["damaged", "near_words", "reduced", "roots", "runs", "variant_groups", "vocabulary"]
