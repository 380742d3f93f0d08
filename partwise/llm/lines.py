"""Quality rules by cross-document line frequency.

Every text gets base figures (words, symbols, repeated lines and windows). Its lines are normalised (lower case, numbers as 0,
white space collapsed) and hashed; for each host the distinct texts that hold a line are counted. A line above its host's
limit - max(least, share of the host's distinct texts) - is removed, and a document with less than `left` of its words in the
remaining lines is depleted: rejected. Exact copies count once, since removing them is deduplication's work.

Hot lines: counts are pre-aggregated; a document gives a line once. Lines above the limit of which one alone has
over a thousandth of all line rows (at most a thousand, so bounded) are broadcast; the others are joined by shuffle,
where no key is hot.

Defined results: a null or empty text has no words and fails the base; a null host is a host of its own; repeated rows
each get the same result; texts are read whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from partwise.llm.common import column, slices, staged, with_columns

SYMBOLS = "#*$%&|<>"
MIN_WORDS, REPEATS_PERCENT = 50, 50
LEAST, SHARE, LEFT = 50, 0.02, 0.5
_DIGIT = re.compile(r"\b\d+\b")


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three words that are found twice or more in the text, the first included."""
    n = len(words) - 2
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    kinds = len(ids)
    pair = at[:-1] * kinds + at[1:]
    if kinds >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * kinds + at[2:]
    order = np.argsort(window, kind="stable")
    ordered = window[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(n, bool)
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    mark = np.zeros(len(words), bool)
    mark[:-2] |= twice
    mark[1:-1] |= twice
    mark[2:] |= twice
    return int(mark.sum())


def normal_line(line: str) -> str:
    return " ".join(_DIGIT.sub("0", line.lower()).split())


def figures(text: str | None) -> tuple[int, int, int, int, int, dict[int, int], bytes]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; words by hash of normalised line; a digest of the text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    spaces = sum(map(text.count, " \t\n\x0b\x0c\r"))
    earlier: set[str] = set()
    dup, by_line = 0, {}
    for line in text.split("\n"):
        if n := len(line.encode("utf-8", "surrogatepass").split()):
            dup += line in earlier
            earlier.add(line)
            h = xxh3_64_intdigest(normal_line(line)) - (1 << 63)
            by_line[h] = by_line.get(h, 0) + n
    digest = blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return len(words), len(text) - spaces, sum(map(text.count, SYMBOLS)), dup, repeated_words(words), by_line, digest


def _figure_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 512):
        each = [figures(t) for t in column(batch, "text")]
        a, b, c, d, e, lines, digest = zip(*each, strict=True) if each else ((),) * 7
        number = lambda x: pa.array(x, pa.int64())
        yield with_columns(batch, ["uid", "doc_id", "host"], {
            "n_words": number(a), "word_chars": number(b), "n_symbols": number(c), "n_dup_lines": number(d), "n_repeat_words": number(e),
            "lines": pa.array([[*x] for x in lines], pa.list_(pa.int64())),
            "line_words": pa.array([[*x.values()] for x in lines], pa.list_(pa.int64())),
            "digest": pa.array(digest, pa.binary()),
        })


def filtered(docs: DataFrame, host: str = "source", least: int = LEAST, share: float = SHARE, left: float = LEFT) -> DataFrame:
    """doc_id, the five figures, base_failed, kept, removed_words (in lines above the limit)."""
    kind, host_kind = docs.schema["doc_id"].dataType.simpleString(), docs.schema[host].dataType.simpleString()
    rows = docs.select("doc_id", F.col(host).alias("host"), "text").withColumn("uid", F.monotonically_increasing_id())
    base = staged(rows.select("uid", "doc_id", "host", "text").mapInArrow(
        _figure_rows,
        f"uid long, doc_id {kind}, host {host_kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<long>, digest binary",
    ))
    texts = base.groupBy("host", "digest").agg(F.min("uid").alias("uid"))
    firsts = staged(base.select("uid", "lines").join(texts.select("uid", "host"), "uid"))
    limits = firsts.groupBy("host").agg(F.count("*").alias("texts"))
    counts = firsts.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > least)
    above = counts.join(limits, counts["host"].eqNullSafe(limits["host"])).where(F.col("n") > F.col("texts") * share).select(counts["host"], "line", "n")
    above = staged(above)
    rows = base.select("uid", "host", F.inline(F.arrays_zip("lines", "line_words"))).withColumnsRenamed({"lines": "line", "line_words": "words"})
    total = base.agg(F.sum(F.size("lines"))).first()[0] or 0
    hot = above.where(F.col("n") > max(least, total // 1000)).select(F.col("host").alias("h"), F.col("line").alias("l"), F.lit(True).alias("hot"))
    rest = above.where(F.col("n") <= max(least, total // 1000)).select("host", "line", F.lit(True).alias("removed"))
    marked = rows.join(F.broadcast(hot), rows["host"].eqNullSafe(F.col("h")) & (rows["line"] == F.col("l")), "left")
    by_hot = marked.where("hot").select("uid", "words")
    cold = marked.where("hot is null").select("uid", F.col("host").alias("h2"), F.col("line").alias("l2"), "words")
    by_rest = cold.join(rest, cold["h2"].eqNullSafe(rest["host"]) & (cold["l2"] == rest["line"])).select("uid", "words")
    removed = by_hot.unionByName(by_rest).groupBy("uid").agg(F.sum("words").alias("removed_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATS_PERCENT * F.col("n_words"))
    gone = F.coalesce("removed_words", F.lit(0))
    return base.join(removed, "uid", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("n_words") - gone >= left * F.col("n_words"))).alias("kept"), gone.alias("removed_words"),
    )
