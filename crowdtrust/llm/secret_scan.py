"""Secret scans with multipart credential linking, in DataFrame functions alone.

Strong parts (reported always): ``assign`` (a secret's name and its value),
``access`` (access identifiers), ``hex`` (long hexadecimal runs).  Weak parts
(ordinary text has them, too): ``id`` (an account's name and its value),
``short`` (as assign, with a value of 4 to 7 characters), ``blob`` (a long
run of base-64 characters) and ``endpoint`` (a URL or host).

A weak part is reported only where complementary parts lie within its scope,
``SCOPE`` characters to either side: an identifier needs a secret, a secret an
identifier, an endpoint both.  That is an interval join within the document:
each part covers the scope-wide cells its interval meets, a weak part those of
its scope, and a left semi join on the cell with the exact comparison tells
whether there is one, without making pairs.

One pass over the texts finds the matches; from it only their lengths are
kept.  Where a match begins follows from the lengths of what lies between the
matches, added up by a window over each document's matches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, written

SCOPE = 256
MASK = "<SECRET>"

_VALUE = r"""["']?\x20*[:=]\x20*["']?"""
_ASSIGN = r"(?i:password|passwd|secret|token|api_?key)" + _VALUE + r"([A-Za-z0-9+/_.=-]+)"
#: (pattern, group whose length decides, 0: all). Runs with a least length are
#: the same as all runs without the shorter ones.
PATTERNS = {
    "assign": (_ASSIGN, 1),
    "access": (r"AKIA[A-Z0-9]{12,}", 0),
    "hex": (r"[0-9a-f]{32,}", 0),
    "id": (r"(?i:user_?name|user_?id|user|login|account|client_?id|key_?id)" + _VALUE + r"([A-Za-z0-9@+_.-]{3,})", 1),
    "blob": (r"[A-Za-z0-9+/]{40,}", 0),
    "endpoint": (r"""https?://[^\x00-\x20"'<>]+|(?i:host|hostname|endpoint|server)""" + _VALUE + r"[A-Za-z0-9.:/-]{4,}", 0),
}
#: In the order in which spans at the same place are listed.
KINDS = ("assign", "access", "hex", "id", "short", "blob", "endpoint")
BASE = KINDS[:3]
#: kind -> (what it is, is it weak)
ROLE = {"assign": ("secret", False), "access": ("identifier", False), "hex": ("secret", False), "id": ("identifier", True),
        "short": ("secret", True), "blob": ("secret", True), "endpoint": ("endpoint", True)}
#: What a weak part of a role needs nearby.
NEEDS = {"identifier": ("secret",), "secret": ("identifier",), "endpoint": ("identifier", "secret")}

_NO_ID = -(1 << 63)


def _lengths(text, pattern: str, group: int):
    """For each match: characters since the match before, its own, its group's."""
    p = F.lit(pattern)
    size = lambda x: F.char_length(x)
    gaps = F.transform(F.split(text, pattern, -1), size)
    own = F.transform(F.regexp_extract_all(text, p, F.lit(0)), size)
    part = F.transform(F.regexp_extract_all(text, p, F.lit(group)), size) if group else own
    return F.when(text.rlike(pattern), F.arrays_zip(gaps.alias("gap"), own.alias("own"), part.alias("part")))


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Written table: d, th (hash of the text) and the match lengths by kind."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))
    narrow = docs.select(d.alias("d"), text.alias("t"))
    return written(narrow.select("d", F.xxhash64("t").alias("th"), *(_lengths(F.col("t"), p, g).alias(k) for k, (p, g) in PATTERNS.items())), "secrets-found")


def _parts(found: DataFrame) -> DataFrame:
    """A row per part: d, th, kind, start, end (code points, end exclusive)."""
    every = None
    for kind in PATTERNS:
        rows = found.filter(F.col(kind).isNotNull()).select("d", "th", F.lit(kind).alias("pattern"), F.posexplode(kind).alias("i", "m"))
        every = rows if every is None else every.union(rows)
    every = every.select("d", "th", "pattern", "i", "m.gap", "m.own", "m.part").distinct()  # rows repeated in full are one document
    upto = Window.partitionBy("d", "th", "pattern").orderBy("i")
    every = every.withColumn("end", F.sum(F.col("gap") + F.coalesce("own", F.lit(0))).over(upto)).filter("own is not null")
    kind = F.when(F.col("pattern") != "assign", F.col("pattern")).when(F.col("part") >= 8, "assign").when(F.col("part") >= 4, "short")
    return every.select("d", "th", kind.alias("kind"), (F.col("end") - F.col("own")).alias("start"), "end").filter("kind is not null")


def _by(of: dict):
    return F.create_map(*(F.lit(x) for kv in of.items() for x in kv))[F.col("kind")]


def credential_spans(found: DataFrame) -> DataFrame:
    """d, th, kind, start, end: strong parts, and linked weak ones."""
    parts = written(_parts(found).withColumn("role", _by({k: r for k, (r, _) in ROLE.items()})).withColumn("weak", _by({k: w for k, (_, w) in ROLE.items()})), "secrets-parts")
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / SCOPE), F.floor(b / SCOPE)))
    lo, hi = F.col("start") - SCOPE, F.col("end") + SCOPE
    linked = parts.filter("weak")
    for need in ("identifier", "secret"):
        asks = F.col("role").isin([r for r, n in NEEDS.items() if need in n])
        other = parts.filter(F.col("role") == need).select(F.col("d").alias("d2"), F.col("th").alias("th2"), F.col("start").alias("s2"), F.col("end").alias("e2"),
                                                           cells(F.col("start"), F.col("end")).alias("cell2"))
        near = linked.filter(asks).withColumn("cell", cells(lo, hi))
        meets = ((F.col("d") == F.col("d2")) & (F.col("th") == F.col("th2")) & (F.col("cell") == F.col("cell2"))
                 & (F.col("s2") < hi) & (F.col("e2") > lo))
        near = near.join(other, meets, "left_semi").drop("cell").distinct()
        linked = near.union(linked.filter(~asks))
    return parts.filter("not weak").union(linked).select("d", "th", "kind", "start", "end")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, spans (array of start, end, kind, in order
    of start, then of kind as in ``KINDS``).

    Null text counts as empty; a document without secrets has an empty array;
    null ids and repeated rows stay as they are; an empty table gives an empty
    one; other columns are not read.
    """
    found = _found(docs, id_col, text_col)
    order = _by({k: i for i, k in enumerate(KINDS)})
    spans = credential_spans(found).groupBy("d", "th").agg(F.array_sort(F.collect_list(F.struct("start", order.alias("n"), "end", "kind"))).alias("spans"))
    spans = spans.select(F.col("d").alias("d2"), F.col("th").alias("th2"), "spans")
    out = found.select("d", "th").join(spans, (F.col("d") == F.col("d2")) & (F.col("th") == F.col("th2")), "left")
    spans = F.transform(F.coalesce("spans", F.array()), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return out.select(F.nullif("d", F.lit(_NO_ID)).alias("doc_id"), spans.alias("spans"))


def listed(spans):
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def mask_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The documents with every span of :func:`scan` (overlapping ones as one)
    replaced by ``MASK``.  ``length_col``, where there is one, is set anew for
    masked texts; all else stays as it is."""
    spans = credential_spans(_found(docs, id_col, text_col))
    ranges = F.array_sort(F.collect_list(F.struct("start", "end")))
    # (ends of what is kept, begins of what is kept), merged
    merged = F.expr("""aggregate(ranges, cast(array() as array<struct<start:bigint,end:bigint>>),
        (a, r) -> if(size(a) > 0 and r.start <= element_at(a, -1).end,
            concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, r.end)))),
            concat(a, array(named_struct('start', r.start, 'end', r.end)))))""")
    spans = spans.groupBy("d", "th").agg(ranges.alias("ranges")).select("d", "th", merged.alias("cuts"))
    taken = [*docs.columns]
    name = {}
    for x in ("d", "th", "cuts", "d2", "th2"):
        name[x] = fresh(taken, x)
        taken.append(name[x])
    spans = spans.select(F.col("d").alias(name["d2"]), F.col("th").alias(name["th2"]), F.col("cuts").alias(name["cuts"]))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))
    all_ = docs.withColumn(name["d"], d).withColumn(name["th"], F.xxhash64(text))
    all_ = all_.join(spans, (F.col(name["d"]) == F.col(name["d2"])) & (F.col(name["th"]) == F.col(name["th2"])), "left")
    cuts = F.col(name["cuts"])
    was = cuts.isNotNull()
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(cuts, lambda c: c["end"]))
    ends = F.concat(F.transform(cuts, lambda c: c["start"]), F.array(F.char_length(text_col).cast("long")))
    kept = F.zip_with(begins, ends, lambda b, e: F.substring(F.col(text_col), (b + 1).cast("int"), (e - b).cast("int")))
    out = all_.withColumn(text_col, F.when(was, F.concat_ws(MASK, kept)).otherwise(F.col(text_col)))
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.when(was, F.char_length(text_col).cast(docs.schema[length_col].dataType)).otherwise(F.col(length_col)))
    return out.select(*docs.columns)
