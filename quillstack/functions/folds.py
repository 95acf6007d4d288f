"""Greedy packing of ordered parts as folds inside one row.

The running token count is carried along, as white-space tokens add up when parts are joined by white space, so
a fold is linear in the parts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip, token_count, words

CHUNK = "struct<text:string,tokens:bigint,split_method:string>"


def chunk(text: Column, tokens: Column, method: Column | str) -> Column:
    method = F.lit(method) if isinstance(method, str) else method
    return F.struct(text.alias("text"), tokens.cast("long").alias("tokens"), method.alias("split_method"))


def none_yet() -> Column:
    return F.array().cast(f"array<{CHUNK}>")


def sentences(text: Column) -> Column:
    """Split at '. ', with the full stop put back."""
    return F.transform(F.split(text, r"\. "), lambda s: F.when(s.endswith("."), strip(s)).otherwise(F.concat(strip(s), F.lit("."))))


def pack(parts: Column, most: int, joint: str, method: str) -> Column:
    """Joins parts while they hold at most ``most`` tokens; a longer part stands alone. -> array of chunks.

    Parts are counted once; a buffer without tokens is blank and gives no chunk.
    """
    start = F.struct(none_yet().alias("done"), F.lit("").alias("cur"), F.lit(0).cast("long").alias("n"))
    sized = F.transform(parts, lambda p: F.struct(p.alias("p"), token_count(p).alias("n")))

    def flushed(acc: Column) -> Column:
        return F.when(acc["n"] == 0, acc["done"]).otherwise(F.concat(acc["done"], F.array(chunk(strip(acc["cur"]), acc["n"], method))))

    def step(acc: Column, s: Column) -> Column:
        fits = acc["n"] + s["n"] <= most
        grown = F.when(acc["cur"] == "", s["p"]).otherwise(F.concat(acc["cur"], F.lit(joint), s["p"]))
        return F.when(fits, F.struct(acc["done"].alias("done"), grown.alias("cur"), (acc["n"] + s["n"]).alias("n"))).otherwise(F.struct(flushed(acc).alias("done"), s["p"].alias("cur"), s["n"].alias("n")))

    return F.aggregate(sized, start, step, flushed)


def pack_sentences(text: Column, most: int, method: str = "sentence") -> Column:
    return pack(sentences(text), most, " ", method)


def recursive_split(text: Column, most: int) -> Column:
    """Paragraphs joined up to ``most`` tokens; a longer one is split by sentences and starts the buffer afresh."""
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: p != "")
    sized = F.transform(paragraphs, lambda p: F.struct(p.alias("p"), token_count(p).alias("n")))
    start = F.struct(none_yet().alias("done"), F.lit("").alias("cur"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, s: Column) -> Column:
        p, n = s["p"], s["n"]
        fits, long = acc["n"] + n <= most, n > most
        flushed = F.when(acc["cur"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(chunk(acc["cur"], acc["n"], "paragraph"))))
        grown = F.when(acc["cur"] == "", p).otherwise(F.concat(acc["cur"], F.lit("\n\n"), p))
        return F.struct(
            F.when(fits, acc["done"]).when(long, F.concat(flushed, pack_sentences(p, most))).otherwise(flushed).alias("done"),
            F.when(fits, grown).when(long, "").otherwise(p).alias("cur"),
            F.when(fits, acc["n"] + n).when(long, 0).otherwise(n).cast("long").alias("n"),
        )

    return F.aggregate(sized, start, step, lambda acc: F.when(acc["cur"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(chunk(acc["cur"], acc["n"], "paragraph")))))


def with_overlap(chunks: Column, ratio: float) -> Column:
    """From the second on, each chunk starts with the last int(tokens * ratio) words of the one before as it was."""

    def joined(c: Column, before: Column, n: Column) -> Column:
        text = F.concat(F.array_join(F.slice(before, F.size(before) - F.greatest(n, F.lit(1)) + 1, F.greatest(n, F.lit(1))), " "), F.lit(" "), c["text"])
        return F.when((n > 0) & (F.size(before) >= n), chunk(text, n + token_count(c["text"]), c["split_method"])).otherwise(c)

    def one(cs: Column, c: Column, i: Column) -> Column:
        n = F.floor(c["tokens"] * ratio).cast("int")
        return F.when(i > 0, let(words(F.get(cs, i - 1)["text"]), lambda before: joined(c, before, n))).otherwise(c)

    return let(chunks, lambda cs: F.transform(cs, lambda c, i: one(cs, c, i)))


def split_large(c: Column, most: int) -> Column:
    """A chunk of more than 50 words split by sentences into parts of at most ``most`` tokens."""
    parts = F.when(F.size(words(c["text"])) > 50, sentences(c["text"])).otherwise(F.array(c["text"]))
    return pack(parts, most, " ", "split_large")


def merge_small(chunks: Column, least: int, target: int, most: int) -> Column:
    """Chunks under ``least`` tokens are buffered and joined at ``target`` tokens, at three chunks or before a larger one."""
    start = F.struct(none_yet().alias("done"), none_yet().alias("buf"), F.lit(0).cast("long").alias("n"))

    def joined(buf: Column, n: Column) -> Column:
        whole = chunk(F.array_join(F.transform(buf, lambda c: c["text"]), "\n\n"), n, "merged")
        return F.when(F.size(buf) == 0, none_yet()).when(F.size(buf) == 1, buf).otherwise(F.array(whole))

    def step(acc: Column, c: Column) -> Column:
        small = c["tokens"] < least
        buf, n = F.concat(acc["buf"], F.array(c)), acc["n"] + c["tokens"]
        full = (n >= target) | (F.size(buf) >= 3)
        rest = F.when(c["tokens"] > most, split_large(c, most)).otherwise(F.array(c))
        return F.struct(
            F.when(small & full, F.concat(acc["done"], joined(buf, n))).when(small, acc["done"]).otherwise(F.concat(acc["done"], joined(acc["buf"], acc["n"]), rest)).alias("done"),
            F.when(small & ~full, buf).otherwise(none_yet()).alias("buf"),
            F.when(small & ~full, n).otherwise(0).cast("long").alias("n"),
        )

    return F.aggregate(chunks, start, step, lambda acc: F.concat(acc["done"], joined(acc["buf"], acc["n"])))
