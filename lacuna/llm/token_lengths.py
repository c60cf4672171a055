"""Token counts: an exact histogram of encoded lengths.

Documents are encoded in the tasks with a public byte-level tokenizer (a file whose path is a parameter; it is read
by the driver and its ranks are sent to the tasks, about 1 MB), and only (group, length) counts are shuffled, summed within
each task first. Suffix sums over the histogram then answer for every context limit: documents and tokens at or above a length,
so totals, quantiles and the tokens left after truncation are lookups.

Defined cases: a null text has length 0, as the empty one; rows that repeat count each; a null group value is a group; special
tokens' strings are ordinary text; texts are cut only where the tokenizer's pattern splits them too, so every length is that of the
text encoded whole; an empty table gives no rows; other columns are neither read nor returned.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import meet, running_sums, small_batches

TOKENIZER = "byte_bpe_50k.tiktoken"
#: White space of the tokenizer's pattern (Unicode's White_Space; Python's own class has four characters more).
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The pattern's engine fails on about a million characters of white space in a row, so long runs do not go through it.
_LONG = re.compile(f"[{_WHITE}]{{4097,}}")


def tokenizer_file(name: str = TOKENIZER, folder: str = "/opt/tokenizers") -> bytes:
    with open(f"{folder}/{name}", "rb") as f:
        return f.read()


def encoding(content: bytes):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str) -> list[str]:
    """The text cut around long runs of white space; a run's last character goes with what follows it, as in the tokenizer's pattern."""
    out, at = [], 0
    for m in _LONG.finditer(text):
        end = m.end() - (m.end() < len(text))
        out += [text[at : m.start()], text[m.start() : end]]
        at = end
    return [x for x in (*out, text[at:]) if x]


def token_length(encode, text: str | None, encode_piece=None) -> int:
    """The number of tokens; ``encode_piece`` encodes what the pattern leaves whole, without searching it."""
    if not text:
        return 0
    text = text.encode("utf-8", "replace").decode()
    return sum(len((encode_piece if encode_piece and _LONG.fullmatch(p) else encode)(p)) for p in pieces(text))


def lengths(docs: DataFrame, content: bytes | None = None) -> DataFrame:
    """``docs`` with n_tokens in place of the text."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(content or tokenizer_file())

    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoding(sent.value)
        for batch in texts:
            yield pd.Series([token_length(own.encode_ordinary, t, own._encode_single_piece) for t in batch], dtype="int64")

    return docs.withColumn("n_tokens", F.pandas_udf(count, "long")("text")).drop("text")


def histogram(docs: DataFrame, groups: tuple = (), content: bytes | None = None) -> DataFrame:
    """Per group and length: n_tokens, documents, and what lies below and from there on.

    documents_from and tokens_from sum over this length and all longer ones; documents_below and tokens_below over the shorter ones;
    truncated_total is the tokens left if every document is cut to n_tokens, tokens_below + n_tokens * documents_from.
    """
    counts = lengths(docs.select(*groups, "text"), content).groupBy(*groups, "n_tokens").agg(F.count("*").alias("documents"))
    counts = counts.withColumn("tokens", F.col("n_tokens") * F.col("documents"))
    up = running_sums(counts, list(groups), "n_tokens", ["documents", "tokens"])
    total = counts.groupBy(*groups).agg(F.sum("documents").alias("all_documents"), F.sum("tokens").alias("all_tokens"))
    rows = meet(up, total, list(groups)) if groups else up.join(F.broadcast(total), F.lit(True))  # one row
    return rows.select(
        *groups, "n_tokens", "documents", F.col("before_documents").alias("documents_below"), F.col("before_tokens").alias("tokens_below"),
        (F.col("all_documents") - F.col("before_documents")).alias("documents_from"), (F.col("all_tokens") - F.col("before_tokens")).alias("tokens_from"),
        (F.col("before_tokens") + F.col("n_tokens") * (F.col("all_documents") - F.col("before_documents"))).alias("truncated_total"),
    )


def at_limits(found: DataFrame, limits: list[int], groups: tuple = ()) -> DataFrame:
    """Per group and context limit: documents over the limit, all tokens, and the tokens left after truncation."""
    rows = found.withColumn("limit", F.explode(F.array(*[F.lit(int(x)) for x in limits])))
    tokens = F.col("n_tokens") * F.col("documents")
    over = F.col("n_tokens") > F.col("limit")
    return rows.groupBy(*groups, "limit").agg(F.sum(F.when(over, F.col("documents")).otherwise(0)).alias("documents_over"), F.sum(tokens).alias("tokens"), F.sum(F.least("n_tokens", "limit") * F.col("documents")).alias("truncated_tokens"))


def quantiles(found: DataFrame, shares: list[float], groups: tuple = ()) -> DataFrame:
    """Per group and share: the smallest length that so large a share of documents does not exceed."""
    rows = found.withColumn("share", F.explode(F.array(*[F.lit(float(x)) for x in shares])))
    upto, total = F.col("documents_below") + F.col("documents"), F.col("documents_below") + F.col("documents_from")
    return rows.where(upto >= F.col("share") * total).groupBy(*groups, "share").agg(F.min("n_tokens").alias("n_tokens"))
