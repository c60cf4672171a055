"""Secret scan with linking of multipart credentials.

Every text is searched once for *parts*. Strong parts are reported as they are; a weak part
(a plain login id, a random-looking token, an endpoint) counts only where parts of
complementary roles lie within the same scope, which reaches ``radius`` code points beyond its start and its end;
a part lies there if any of it does. The link is an interval join within the document: of the parts that begin before the
scope ends, the one that ends last decides whether any reaches into it, so one running maximum over the positions
is enough and no pairs are listed.

A weak part is linked when a strong part of another role, one of the two being a secret, lies in
its scope, or when all three roles (access id, secret, endpoint) meet there.

Reported parts whose gaps are at most ``radius`` are one credential (transitively); those with a secret and a part of another role
are listed with their members, so that it can be told which id and endpoint a secret goes with.

Defined cases: a null text is searched as the empty one; rows that repeat doc_id and text get
the same result each; a null doc_id is kept; equal starts are ordered by kind as listed in
KINDS; an empty table gives no rows; other columns are neither read nor returned.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import meet, settled, small_batches

#: In the order in which equal starts are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "login", "token", "endpoint")
ROLE = {"assign": "secret", "hex": "secret", "token": "secret", "access": "id", "login": "id", "endpoint": "place"}

#: The patterns of the kinds.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LOGIN = re.compile(r"""(?:access_?key_?id|client_?id|user_?name|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]{4,})""", re.ASCII | re.IGNORECASE)
LOGIN_WORDS = ("keyid", "key_id", "clientid", "client_id", "username", "user_name", "login")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
ENDPOINT = re.compile(r"(?:https?|ftps?|s3|gs|jdbc:[a-z]+|mongodb|postgres(?:ql)?|mysql|redis|amqps?)://[^\s\"'<>]+")
ASSIGN_LEAST = 6
#: Code points on each side of a part in which parts complement it.
RADIUS = 200

PART = "struct<kind:int,start:int,stop:int>"


def parts(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(kind, start, end) of strong parts, and of weak parts."""
    low = text.lower()
    strong, weak = [], []
    if any(k in low for k in KEYWORDS):
        strong += [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    strong += [(1, *m.span()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    strong += [(2, *m.span()) for m in HEX.finditer(text)]
    if any(k in low for k in LOGIN_WORDS):
        weak += [(3, *m.span()) for m in LOGIN.finditer(text)]
    if strong or weak:  # a token or an endpoint alone is never linked
        ends = sorted(b for _, _, b in strong)
        starts = sorted(a for _, a, _ in strong)
        apart = lambda a, b: bisect_right(ends, a) == bisect_left(starts, b)  # noqa: E731  as many have ended before a as have begun before b
        weak += [(4, *m.span()) for m in TOKEN.finditer(text) if mixed(m[0]) and apart(*m.span())]
        if "://" in low:
            weak += [(5, *m.span()) for m in ENDPOINT.finditer(text)]
    return sorted(strong, key=lambda p: (p[1], p[0])), weak


def mixed(token: str) -> bool:
    """Digits, capitals and small letters together, as in random keys."""
    return bool(re.search("[0-9]", token) and re.search("[A-Z]", token) and re.search("[a-z]", token))


def parts_of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        rows = []
        for text in batch:
            found = parts(text or "")
            rows.append([[{"kind": k, "start": a, "stop": b} for k, a, b in x] for x in found])
        yield pd.DataFrame(rows, columns=["strong", "weak"])


def find(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Per row of ``docs``: doc_id, strong and linked spans (arrays of kind, start, stop), and text_key, a hash of the text."""
    small_batches(docs.sparkSession)
    # written once: both sides of the join need the parts, and searching for them is the work
    found = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), F.pandas_udf(parts_of, f"strong array<{PART}>, weak array<{PART}>")("text").alias("p")).select("doc_id", "text_key", "p.strong", "p.weak")
    found = settled(found)
    none = F.expr(f"cast(array() as array<{PART}>)")
    return meet(found.drop("weak"), linked(found, radius), ["doc_id", "text_key"], "left").withColumn("linked", F.coalesce("linked", none))


def linked(found: DataFrame, radius: int) -> DataFrame:
    """doc_id, text_key, linked: the weak parts that complementary parts support."""
    listed = (
        found.where("size(weak) > 0").dropDuplicates(["doc_id", "text_key"])
        .select("doc_id", "text_key", F.explode(F.concat("strong", "weak")).alias("p"))
        .select("doc_id", "text_key", "p", role_of(F.col("p.kind")).alias("role"), (F.col("p.kind") < 3).alias("is_strong"))
    )
    # a part counts from its start on; a weak one looks back from the end of its scope
    marks = F.array(F.struct(F.col("p.start").alias("at"), F.lit(False).alias("looks")), F.struct((F.col("p.stop") + radius).alias("at"), F.lit(True).alias("looks")))
    rows = listed.select("*", F.explode(marks).alias("m")).where("not (m.looks and is_strong)").select("doc_id", "text_key", "p", "role", "is_strong", "m.at", "m.looks")
    before = Window.partitionBy("doc_id", "text_key").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    reach = lambda r, s: F.max(F.when(~F.col("looks") & (F.col("role") == r) & (F.col("is_strong") if s == "strong" else F.lit(True)), F.col("p.stop"))).over(before)
    seen = {f"{r}_{s}": reach(r, s) for r in ("id", "secret", "place") for s in ("strong", "any")}
    rows = rows.select("*", *[F.coalesce(c >= F.col("p.start") - radius, F.lit(False)).alias(k) for k, c in seen.items()]).where("looks")
    complete = F.col("id_any") & F.col("secret_any") & F.col("place_any")
    held = F.when(F.col("role") == "secret", F.col("id_strong")).otherwise(F.col("secret_strong"))
    return rows.where(~F.col("is_strong") & (complete | held)).groupBy("doc_id", "text_key").agg(F.collect_list("p").alias("linked"))


def role_of(kind):
    return F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(i), F.lit(ROLE[k]))])[kind]


def credentials(found: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, text_key, first, members: a row for each credential; ``found`` has doc_id, text_key and spans (see ``in_order``)."""
    rows = found.where("size(spans) > 1").dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text_key", F.explode("spans").alias("p"))
    w = Window.partitionBy("doc_id", "text_key").orderBy("p.start", "p.kind", "p.stop")
    reach = F.max("p.stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.select("*", F.when(F.col("p.start") <= reach + radius, 0).otherwise(1).alias("new"))
    rows = rows.select("*", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("credential"))
    roles = F.collect_set(role_of(F.col("p.kind")))
    rows = rows.groupBy("doc_id", "text_key", "credential").agg(F.min("p.start").alias("first"), F.array_sort(F.collect_list("p")).alias("members"), roles.alias("roles"))
    return rows.where((F.size("roles") > 1) & F.array_contains("roles", "secret")).select("doc_id", "text_key", "first", "members")


def in_order(spans):
    return F.array_sort(F.transform(spans, lambda p: F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["stop"].alias("stop"))))


def as_text(spans, between: str = ","):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda p: F.concat_ws(":", F.get(names, p["kind"]), p["start"], p["stop"])), between)


def scan(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Per row of documents: doc_id, counts of the base kinds, base_sha256, spans as text, how many were linked, and the credentials (members joined by +)."""
    found = find(docs.select("doc_id", "text"), radius).withColumn("spans", in_order(F.concat("strong", "linked")))
    listed = credentials(found, radius).groupBy("doc_id", "text_key").agg(F.array_join(F.array_sort(F.collect_list(F.struct("first", as_text(F.col("members"), "+").alias("text"))))["text"], ",").alias("credentials"))
    count = lambda k: F.size(F.filter("strong", lambda p: p["kind"] == k)).cast("long")
    return meet(found, listed, ["doc_id", "text_key"], "left").select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(as_text(in_order(F.col("strong"))).cast("binary"), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"), F.size("linked").cast("long").alias("n_linked"),
        F.coalesce("credentials", F.lit("")).alias("credentials"),
    )


def cut_out(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """The text with each span replaced by [kind]; spans that overlap become one, named by the first."""
    out = []
    for text, listed in zip(texts, spans, strict=True):
        if text is None or not isinstance(listed, str) or not listed:
            out.append(text)
            continue
        runs: list[list] = []
        for kind, a, b in (x.split(":") for x in listed.split(",")):
            if runs and int(a) < runs[-1][2]:
                runs[-1][2] = max(runs[-1][2], int(b))
            else:
                runs.append([kind, int(a), int(b)])
        for kind, a, b in reversed(runs):
            text = f"{text[:a]}[{kind}]{text[b:]}"
        out.append(text)
    return pd.Series(out, dtype=object)
