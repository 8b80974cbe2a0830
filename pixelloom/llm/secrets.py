"""Secret scans with corpus-wide ownership. DataFrame functions only.

Three kinds of patterns give the base spans. Further long, mixed tokens are candidates. Over the whole corpus, the hash of
each base span's value and of each candidate, wherever it stands, is counted by distinct owner and repository. One that few
owners have looks live; one that many have is a copied example. Base spans stay either way and carry the verdict; a live
candidate outside of them becomes a span of kind ``owned``, a copied one doesn't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import aside, matched, with_text, written

#: The patterns of the base kinds.
ASSIGN = r"""(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"()AKIA[A-Z0-9]{14,}"
HEX = r"()[0-9a-f]{16,}"
OWNED = r"()(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: A value of more owners than this is a copied example.
MOST_OWNERS = 2

#: Hits whose places are summed at a time.
RUN = 128

_span = "struct<start:int,end:int,from:int,to:int,value:int,text:string>"


def held(expression: Column, name: str) -> Column:
    """A computed array as a row's own value, so that functions over its elements don't compute it anew for each."""
    return F.explode(F.array(expression)).alias(name)


def running(items: str, kind: str, first: Column, step) -> Column:
    """What ``step`` makes of each element of the column ``items`` and of the last one made, from ``first`` on; of type ``kind``.

    Made within runs of RUN elements, so that no array grows element by element over a whole text.
    """
    count = F.floor((F.size(items) + RUN - 1) / RUN).cast("int")
    start = F.array(F.array(first.cast(kind)))
    last = lambda a: F.element_at(a, -1)
    one_run = lambda run, a: F.aggregate(run, F.slice(a, -1, 1), lambda made, x: F.concat(made, F.array(step(last(made), x).cast(kind))))
    made = F.aggregate(F.sequence(F.lit(1), count), start, lambda runs, k: F.concat(runs, F.array(one_run(F.slice(items, (k - 1) * RUN + 1, RUN), last(runs)))))
    # Each run begins with the end of the one before.
    return F.when(F.size(items) > 0, F.flatten(F.transform(F.slice(made, 2, count), lambda run: F.slice(run, 2, F.size(run) - 1)))).otherwise(F.array().cast(f"array<{kind}>"))


def hits_of(text: Column, pattern: str) -> Column:
    """All leftmost matches that don't overlap, each with what stands before it, from where the last one ended."""
    return F.regexp_extract_all(text, F.lit(rf"\G(?s:.*?){pattern}"), F.lit(0))


def places(hits: str, pattern: str) -> Column:
    """Places of the matches in the column ``hits``, in code points and (from, to) in bytes, with the length of the first group.

    Running sums of the lengths of hits, with what stands before them, give the places.
    """
    one = rf"^((?s:.*?))({pattern})"

    def step(last: Column, hit: Column) -> Column:
        before, said = F.regexp_extract(hit, one, 1), F.regexp_extract(hit, one, 2)
        parts = (last["end"] + F.length(before), last["end"] + F.length(hit), last["to"] + F.octet_length(before), last["to"] + F.octet_length(hit), F.length(F.regexp_extract(hit, one, 3)), said)
        return F.struct(*(c.alias(n) for c, n in zip(parts, ("start", "end", "from", "to", "value", "text"), strict=True)))

    zero = F.lit(0)
    return running(hits, _span, F.struct(zero, zero, zero, zero, zero, F.lit("")), step)


def spans(docs: DataFrame) -> DataFrame:
    """``docs`` with marks (hash, start, kind, end, from, to) of every whole text; a null text has none.

    Kinds are places in KINDS; those of candidates that touch a base span, which count for owners only, are one higher.
    """
    text = F.coalesce("text", F.lit(""))
    low = F.lower(text)
    named = low.contains(WORDS[0])
    for word in WORDS[1:]:
        named = named | low.contains(word)
    found = docs
    for name, pattern, may in (("a", ASSIGN, named), ("k", ACCESS, text.contains("AKIA")), ("x", HEX, text.rlike("[0-9a-f]{16}")), ("o", OWNED, text.rlike("[A-Za-z0-9+/_-]{20}"))):
        found = found.select("*", held(F.when(may, hits_of(text, pattern)).otherwise(F.array().cast("array<string>")), "hits"))
        found = found.select("*", held(places("hits", pattern), name)).drop("hits")
    # A full stop after an assigned value belongs to the sentence.
    said = lambda s: F.when(s["value"] > 0, F.rtrim(F.right(s["text"], s["value"]), F.lit("."))).otherwise(s["text"])
    made = lambda s, kind: F.struct(F.xxhash64(said(s)).alias("hash"), s["start"].alias("start"), kind.cast("int").alias("kind"), s["end"].alias("end"), s["from"].alias("from"), s["to"].alias("to"))
    kind = lambda name, i, ok=lambda s: F.lit(True): F.transform(F.filter(name, ok), lambda s: made(s, F.lit(i)))
    base = F.concat(kind("a", 0, lambda s: s["value"] >= 12), kind("k", 1), kind("x", 2))
    live = lambda s: s["text"].rlike("[0-9]") & s["text"].rlike("[A-Z]") & s["text"].rlike("[a-z]") & (F.size(F.array_distinct(F.split(s["text"], ""))) >= 10)
    found = found.select(*docs.columns, F.explode(F.array(base)).alias("base"), F.filter("o", live).alias("o"))
    touches = lambda s: F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return found.select(*docs.columns, F.concat("base", F.transform("o", lambda s: made(s, F.when(touches(s), 4).otherwise(3)))).alias("marks"))


def owned(found: DataFrame, most_owners: int = MOST_OWNERS) -> DataFrame:
    """(hash, live) of every value: live if at most ``most_owners`` owners have it. Owners are sources, repositories a source's languages."""
    each = found.select(F.explode("marks.hash").alias("hash"), "source", "lang").distinct()
    counted = each.groupBy("hash").agg(F.countDistinct(F.coalesce("source", F.lit(""))).alias("owners"), F.count("*").alias("repositories"))
    return counted.select("hash", ((F.col("owners") <= most_owners) & (F.col("repositories") <= 2 * most_owners)).alias("live"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: its columns put aside, base and all, arrays of (start, kind, end, from, to, live) by start, then kind.

    Places count code points, from and to bytes; ends are exclusive. Null and empty texts have no spans. Repeated rows and null columns stay;
    a null source is an owner like others. An empty table gives an empty result. Further columns, whatever their names, meet
    none of the operator's own. A value that many rows share meets its verdict in many tasks.
    """
    row = F.xxhash64("doc_id", "text").alias("row")
    found = written(spans(docs.select("doc_id", "text", "lang", "source")).where(F.size("marks") > 0).select(row, "lang", "source", "marks"), "marks")
    each = found.select("row", F.explode("marks").alias("m")).select("row", "m.*").where("kind < 4").distinct()
    verdicts = written(owned(found).join(each.groupBy("hash").agg(F.count("*").alias("places")), "hash"), "verdicts")
    told = matched(each, verdicts, ["hash"], "places").where("kind < 3 or live").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "from", "to", "live"))).alias("all"))
    kept = [f"__{i}" for i in range(len(docs.columns))]
    out = docs.select(*aside(docs), row).join(told, "row", "left").select(*kept, F.coalesce("all", F.array().cast("array<struct<start:int,kind:int,end:int,from:int,to:int,live:boolean>>")).alias("all"))
    return out.select(*kept, F.filter("all", lambda s: s["kind"] < 3).alias("base"), "all")


def digests(docs: DataFrame) -> DataFrame:
    """Counts, digest and places of the spans of each row; live and copied are the base spans by their verdict."""
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    told = (joined(F.filter("base", lambda s: s["live"])).alias("live"), joined(F.filter("base", lambda s: ~s["live"])).alias("copied"))
    return scan(docs.select("doc_id", "text", "lang", "source")).select(F.col("__0").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"), *told)


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``, and n_chars to match, whatever its type; overlapping spans become one mark.

    Rows without a span, null texts among them, stay as they are. Further columns stay, whatever their names.
    """
    # Each span with the furthest end before it, in bytes: what lies between is kept.
    between = running("all", "struct<upto:int,gone:int,past:int>", F.struct(F.lit(0), F.lit(0), F.lit(0)), lambda last, s: F.struct(last["past"].alias("upto"), s["from"].alias("gone"), F.greatest(last["past"], s["to"]).alias("past")))
    kept = [f"__{i}" for i in range(len(docs.columns))]
    text = F.col(kept[docs.columns.index("text")])
    found = scan(docs).select(*kept, held(between, "cut")).select("*", held(F.encode(text, "utf-8"), "raw"))
    parts = F.transform(F.filter("cut", lambda s: s["gone"] >= s["upto"]), lambda s: F.substr("raw", s["upto"] + 1, s["gone"] - s["upto"]).cast("string"))
    tail = F.expr("substring(raw, element_at(cut, -1).past + 1)").cast("string")
    clean = F.array_join(F.concat(parts, F.array(tail)), mark)
    return with_text(found.select(*kept, held(F.when(F.size("cut") > 0, clean).otherwise(text), "said")), docs)
