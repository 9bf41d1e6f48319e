"""Secret scans with multipart credential linking, by DataFrame operations only.

Strong patterns (assignments, access keys, hex runs) are reported wherever they
stand. A weak candidate, a long mixed token, is reported only where a
complementary part, an access identifier or an endpoint, stands at most
``reach`` characters from it, edge to edge, and with the parts it is linked to.
Parts are rows; the interval join is a running maximum of the complements' ends
in order of position, so many parts of one document give no pairs. Texts are
scanned for any part once; those that hold some are written to a table of their
own, which the patterns then read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import aside, written

#: Pattern, group whose length counts, least length. In order of kinds.
BASE = {
    "assign": (r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
#: Complementary parts; what is linked by them. A weak candidate needs a digit and letters of both cases.
PARTS = {
    "identifier": (r"AKIA[A-Z0-9]{14,}|(?i:\b(?:user(?:name)?|login|client_?id|access_?key_?id))[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@-]+", 0, 1),
    "endpoint": (r"\b[a-z][a-z0-9+.-]{1,15}://[^\x20\x09-\x0D\"'<>]+|(?i:\b(?:host|server|endpoint|bucket))[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.-]+|\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?\b", 0, 1),
    "linked": (r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[A-Z0-9+/_=-]*[a-z])(?=[a-z0-9+/_=-]*[A-Z])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])", 0, 20),
}
REACH = 200
KINDS = [*BASE, "linked"]


def _found(docs: DataFrame, kind: str, pattern: str, group: int, least: int, key: list[str]) -> DataFrame:
    """``(*key, kind, start, end)`` of the leftmost non-overlapping matches, in code points.

    A match's start is the length of all the gaps and matches before it, which
    ``split`` and ``regexp_extract_all`` give in the same order.
    """
    whole, part = (F.regexp_extract_all("text", F.lit(pattern), F.lit(g)) for g in (0, group))
    gaps = F.split("text", pattern, -1)
    rows = docs.where(F.col("text").rlike(pattern)).select(*key, F.posexplode(F.arrays_zip(F.slice(gaps, F.lit(1), F.size(gaps) - 1).alias("gap"), whole.alias("whole"), part.alias("part"))).alias("nth", "m"))
    rows = rows.select(*key, "nth", F.length("m.gap").alias("gap"), F.length("m.whole").alias("size"), F.length("m.part").alias("part"))
    so_far = Window.partitionBy(*key).orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(so_far)
    return rows.select(*key, F.lit(kind).alias("kind"), (end - F.col("size")).alias("start"), end.alias("end"), "part").where(F.col("part") >= least).drop("part")


def _linked(parts: DataFrame, key: list[str], reach: int) -> DataFrame:
    """Weak candidates with at most ``reach`` characters to a complement that overlap no base span; ``by`` names the identifier and the endpoint they are linked to.

    Of the complements of a sort that start by ``reach`` after a candidate's end,
    the one that ends last tells whether one is near. Null keys are keys as any other.
    """
    weak = F.col("kind") == "linked"
    sorts = {"identifier": ["identifier", "access"], "endpoint": ["endpoint"]}
    ends = parts.where(weak | F.col("kind").isin(*sum(sorts.values(), [])))
    ends = ends.withColumns({"part": ~weak, "at": F.when(weak, F.col("end") + reach).otherwise(F.col("start"))})
    so_far = Window.partitionBy(*key).orderBy("at", F.desc("part")).rowsBetween(Window.unboundedPreceding, 0)
    last = {s: F.max(F.when(F.col("kind").isin(*kinds), F.struct("end", "start"))).over(so_far) for s, kinds in sorts.items()}
    near = {s: F.col(s)["end"] >= F.col("start") - reach for s in sorts}
    by = F.concat_ws("+", *(F.when(near[s], F.concat_ws(":", F.lit(s), F.col(s)["start"], F.col(s)["end"])) for s in sorts))
    near = ends.withColumns(last).where(weak & (F.coalesce(near["identifier"], F.lit(False)) | F.coalesce(near["endpoint"], F.lit(False)))).select(*key, "kind", "start", "end", by.alias("by"))
    base = parts.where(F.col("kind").isin(*BASE)).withColumn("by", F.lit(None).cast("string"))
    order = Window.partitionBy(*key).orderBy("start", "end")
    both = near.unionByName(base)
    before = F.max(F.when(F.col("kind") != "linked", F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(F.col("kind") != "linked", F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    alone = both.withColumns({"before": before, "after": after})
    clear = (F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.col("after").isNull() | (F.col("after") >= F.col("end")))
    return alone.where((F.col("kind") != "linked") | clear).select(*key, "kind", "start", "end", "by")


def _texts(kinds: list[str]) -> Column:
    chosen = F.filter("found", lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def suspicious(text: Column) -> Column:
    """Whether a text can have any span: a strong pattern, or a weak candidate and a complement."""
    strong = text.rlike(BASE["assign"][0]) | text.rlike(BASE["access"][0]) | text.rlike(BASE["hex"][0])
    return F.coalesce(strong | (text.rlike(PARTS["linked"][0]) & (text.rlike(PARTS["identifier"][0]) | text.rlike(PARTS["endpoint"][0]))), F.lit(False))


#: What ``find_spans`` holds for each document.
FOUND = "array<struct<start:bigint,nth:bigint,kind:string,end:bigint,by:string>>"


def find_spans(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """``(doc_id, mark, found)`` for documents with any span; found is an array of (start, nth, kind, end, by) in order, mark a hash of the text, by the parts that a weak candidate is linked to."""
    key = ["doc_id", "mark"]
    texts = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").where(suspicious(F.col("text"))).dropDuplicates(key)
    texts = written(texts, "suspects")
    parts = None
    for kind, (pattern, group, least) in {**BASE, **PARTS}.items():
        rows = _found(texts, kind, pattern, group, least, key)
        parts = rows if parts is None else parts.unionByName(rows)
    spans = _linked(written(parts, "parts"), key, reach)
    nth = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return spans.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("start", nth.alias("nth"), "kind", "end", "by"))).alias("found"))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs``, which has doc_id and mark, with ``found`` of ``find_spans``; empty where there is nothing."""
    spans = spans.toDF("doc_id_", "mark_", "found")
    on = docs["doc_id"].eqNullSafe(spans["doc_id_"]) & (docs["mark"] == spans["mark_"])
    return docs.join(spans, on, "left").select(*docs.columns, F.coalesce("found", F.expr(f"cast(array() as {FOUND})")).alias("found"))


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, n_linked, base_sha256, spans, links.

    ``spans`` has all spans, ``links`` each weak candidate with the parts it is
    linked to. Null text is empty. Repeated rows each get the spans of their
    text; an empty table gives no row; other columns are ignored. What meets the
    spans in a join is each row's id and hash, not its text.
    """

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    links = F.array_join(F.transform(F.filter("found", lambda s: s["kind"] == "linked"), lambda s: F.concat_ws(":", s["kind"], s["start"], F.concat_ws("@", s["end"], s["by"]))), ",")
    found = with_spans(docs.select("doc_id", F.xxhash64("text").alias("mark")), find_spans(docs, reach))
    return found.select("doc_id", *counts, F.sha2(_texts([*BASE]), 256).alias("base_sha256"), _texts(KINDS).alias("spans"), links.alias("links"))


def redact(docs: DataFrame, reach: int = REACH, mark: str = "[secret]") -> DataFrame:
    """``docs``, all its columns, with every span of ``text`` replaced by ``mark``; overlapping spans are one.

    Only texts that can have a span meet the spans in a join; the others stay
    where they are, read and judged once more.
    """
    kept, back = aside(docs, "doc_id", "text")
    some = suspicious(F.col("text"))
    suspects = written(kept.where(some), "suspects")
    found = with_spans(suspects.withColumn("mark", F.xxhash64("text")), find_spans(suspects, reach))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(state: Column, span: Column) -> Column:
        gap = F.substr(F.col("text"), state["at"] + 1, span["start"] - state["at"])
        fresh = span["start"] >= state["at"]
        return F.struct(F.when(fresh, F.concat(state["out"], gap, F.lit(mark))).otherwise(state["out"]).alias("out"), F.greatest(state["at"], span["end"]).alias("at"))

    changed = F.aggregate("found", start, step, lambda s: F.concat(s["out"], F.substr(F.col("text"), s["at"] + 1)))
    redacted = found.withColumn("text", F.when(F.size("found") > 0, changed).otherwise(F.col("text"))).select(*kept.columns)
    return back(kept.where(~some).unionByName(redacted))
