"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits link if they differ in at most ``distance`` bits.  The
bits fall into m partitions, correlated bits together.  Each fingerprint q
gives partition i a threshold t_i >= -1, summing to ``distance`` - m + 1: then
any fingerprint within ``distance`` of q is within t_i of q in some partition
i (t_i = -1: partition i is not probed).  The thresholds are chosen for each q
by a dynamic program over estimated candidate counts, so partitions in which
q's value is common are probed narrowly or not at all, rare ones wider.

The estimates come from a count of all distinct fingerprints in ``SLOTS``
hashed slots per partition, a table of bounded size.  A slot over
``HOT_SLOT`` fingerprints is split by the plain pigeonhole principle: of
``distance`` + 1 blocks of the other bits one must agree, so rows of such slots
are dealt by a block's value as well.

Only distinct fingerprints are probed and linked; copies share one.  Linked
pairs are verified inside the join and contracted to components on Spark.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete_path, fresh, id_and_text, mix64, written, written_at
from .components import connected_components

BITS = 64
#: Partitions of the bits. Any number gives the same links: fewer make rarer values and more probes.
PARTITIONS = 3
#: Slots of the histogram per partition (fixes the size of what is broadcast).
SLOTS = 1 << 16
#: Slots with more distinct fingerprints are split by further bits.
HOT_SLOT = 256
#: Keys of rows that are broadcast as they are (24 bytes each); 64-bit words of the Bloom filter that takes over beyond.
BROADCAST_ROWS, BLOOM_WORDS = 1 << 20, 1 << 21
#: What a probe costs, in candidates.
PROBE_COST = 2.0


def fingerprint(text: str, width: int = 3) -> int:
    """SimHash of a text's word shingles (see :func:`fingerprints`)."""
    import numpy as np
    import xxhash

    words = text.encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = max(len(words) - width + 1, 1)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[:k].tolist(), ends[len(words) - k:].tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for lo in range(0, k, 1 << 16):
        ones += np.unpackbits(h[lo: lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > k, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), th, th2 (two hashes of the
    text).  A-Z are lower-cased, words are runs without ASCII white space,
    shingles of ``width`` words are joined by blanks and hashed by XXH64 (seed
    42); a bit is 1 if set in over half of them.  Fewer words: the whole
    sequence is the shingle; none: zero."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in batch.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "th", "th2")), pa.array(fps.view(np.int64))], names=["doc_id", "th", "th2", "fp"])

    rows = id_and_text(docs, id_col, text_col).withColumns(_text_hashes(F.col("text"), "th", "th2"))
    return rows.mapInArrow(run, "doc_id long, th long, th2 long, fp long")


def _text_hashes(text, a: str, b: str) -> dict:
    return {a: F.xxhash64(text), b: F.xxhash64(F.lit("second"), text)}


def unpacked(fps):
    import numpy as np

    return np.unpackbits(np.ascontiguousarray(fps, dtype="<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_groups(distinct: DataFrame, n_groups: int) -> list[list[int]]:
    """The 64 bits in groups of about equal size, correlated bits together.
    Counts over all fingerprints; 64 x 64 numbers reach the driver."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        total = np.zeros((BITS, BITS))
        for batch in batches:
            b = unpacked(batch.column("fp").to_numpy(zero_copy_only=False)).astype(np.float32)
            for lo in range(0, len(b), 4096):
                total += b[lo: lo + 4096].T @ b[lo: lo + 4096]
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i * BITS + j), pa.array(total[i, j])], names=["ij", "n"])

    both = np.zeros(BITS * BITS)
    for r in distinct.select("fp").mapInArrow(run, "ij long, n double").groupBy("ij").agg(F.sum("n").alias("n")).collect():
        both[r["ij"]] = r["n"]
    both = both.reshape(BITS, BITS) / max(distinct.count(), 1)
    one = np.diag(both)
    spread = np.sqrt(np.maximum(one * (1 - one), 1e-9))
    alike = np.abs(both - np.outer(one, one)) / np.outer(spread, spread)
    left, groups = list(range(BITS)), []
    for g in range(n_groups):
        size = len(left) // (n_groups - g)
        group = [max(left, key=lambda b: (alike[b, [x for x in left if x != b]].max(initial=0), -b))]
        left.remove(group[0])
        while len(group) < size:
            b = max(left, key=lambda x: (alike[x, group].mean(), -x))
            group.append(b)
            left.remove(b)
        groups.append(sorted(group))
    return groups


def flips(group: list[int], radius: int):
    """By number of bits, 0 to ``radius``: all ways to flip so many bits of the group."""
    import numpy as np

    return [[np.uint64(sum(1 << b for b in c)) for c in combinations(group, r)] for r in range(radius + 1)]


def slot(values, part: int):
    """Histogram slot of partition values (fingerprints masked to the group)."""
    import numpy as np

    return (mix64(values ^ np.uint64(part + 1)) >> np.uint64(48)).astype(np.int64)


def allocate(fps, groups, ways, histogram, distance: int):
    """(n, m) thresholds, by dynamic programming over the partitions."""
    import numpy as np

    n, m = len(fps), len(groups)
    budget = distance - m + 1
    highest = budget + m - 1  # the others at -1
    cost = np.zeros((m, highest + 2, n))
    for i, group in enumerate(groups):
        own = fps & np.uint64(sum(1 << b for b in group))
        mean = histogram[i].sum() / 2.0 ** len(group)
        seen, probes = np.zeros(n), 0
        for t in range(highest + 1):
            if t < 2:
                for f in ways[i][t]:
                    seen = seen + histogram[i][slot(own ^ f, i)]
            else:
                seen = seen + mean * len(ways[i][t])
            probes += len(ways[i][t])
            cost[i, t + 1] = seen + PROBE_COST * probes
    # best[s]: least cost of the partitions so far with thresholds summing to s - (partitions so far)
    width = budget + m + 1
    best = np.full((width, n), np.inf)
    best[0] = 0
    choices = []
    for i in range(m):
        new, pick = np.full((width, n), np.inf), np.zeros((width, n), dtype=np.int64)
        for t in range(highest + 2):
            for s in range(width - t):
                c = best[s] + cost[i, t]
                better = c < new[s + t]
                new[s + t][better], pick[s + t][better] = c[better], t
        best = new
        choices.append(pick)
    s, out = np.full(n, budget + m), np.zeros((n, m), dtype=np.int64)
    for i in reversed(range(m)):
        t = choices[i][s, np.arange(n)]
        out[:, i], s = t - 1, s - t
    return out


def link_fingerprints(distinct: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b): all pairs a < b (as signed longs) of the distinct fingerprints
    in column ``fp`` that differ in 1 to ``distance`` bits."""
    import numpy as np

    spark: SparkSession = distinct.sparkSession
    m = min(PARTITIONS, distance + 1)
    groups = bit_groups(distinct, m)
    group_masks = [np.uint64(sum(1 << b for b in g)) for g in groups]
    ways = [flips(g, distance) for g in groups]
    blocks = []  # of the bits outside each group, the pigeonholes of a hot slot
    for g in groups:
        rest = [b for b in range(BITS) if b not in g]
        blocks.append([np.uint64(sum(1 << b for b in rest[k::distance + 1])) for k in range(distance + 1)])

    def count_slots(batches):
        import pyarrow as pa

        total = np.zeros((m, SLOTS), dtype=np.int64)
        for batch in batches:
            f = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(m):
                total[i] += np.bincount(slot(f & group_masks[i], i), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["slot", "n"])

    counted = distinct.select("fp").mapInArrow(count_slots, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # m x SLOTS rows at most
    histogram = np.zeros(m * SLOTS, dtype=np.int64)
    histogram[counted["slot"].to_numpy()] = counted["n"].to_numpy()
    shared = spark.sparkContext.broadcast(histogram.reshape(m, SLOTS))

    def dealt(f, i, values):
        """(rows, keys): a fingerprint's keys for partition values; a row for
        each block where the slot is hot."""
        at = slot(values, i)
        key = mix64(values + np.uint64(i * 0x9E3779B97F4A7C15 % (1 << 64)))
        hot = shared.value[i][at] > HOT_SLOT
        rows, keys = [np.flatnonzero(~hot)], [key[~hot]]
        for k, b in enumerate(blocks[i] if hot.any() else []):
            rows.append(np.flatnonzero(hot))
            keys.append(mix64(key[hot] ^ mix64((f[hot] & b) + np.uint64(k + 1))))
        return np.concatenate(rows), np.concatenate(keys)

    def keys(probing):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                whole = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
                for lo in range(0, len(whole), 2048):
                    f = whole[lo: lo + 2048]
                    thresholds = allocate(f, groups, ways, shared.value, distance) if probing else np.zeros((len(f), m), dtype=np.int64)
                    found = []
                    for i in range(m):
                        for t in range(thresholds[:, i].max(initial=-1) + 1):
                            some = f[thresholds[:, i] >= t]
                            for flip in ways[i][t]:
                                r, k = dealt(some, i, (some & group_masks[i]) ^ flip)
                                found.append((k, some[r]))
                    if found:
                        k, r = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(r)], names=["key", "fp"])
        return run

    data = distinct.select("fp").mapInArrow(keys(False), "key long, fp long").withColumnRenamed("fp", "b")
    probes = distinct.select("fp").mapInArrow(keys(True), "key long, fp long").withColumnRenamed("fp", "a")
    near = probes.join(data, (probes["key"] == data["key"]) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
    return near.select("a", "b").distinct()


def classes(fps: DataFrame, distance: int) -> DataFrame:
    """Written table of, first_doc, first_null, first_th, first_th2, n,
    component_id, root: for each distinct fingerprint (``of``) its first row
    (smallest id, null ids last, then by the text's hashes), the rows in its
    component, the component's smallest doc_id, and its smallest fingerprint."""
    spark = fps.sparkSession
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", "th2"))
    distinct, distinct_path = written_at(fps.groupBy("fp").agg(first.alias("first"), F.count("*").alias("n")), "simhash-distinct")
    linked = connected_components(link_fingerprints(distinct, distance), "a", "b")
    rooted = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first", "n")
    components = rooted.groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    out = rooted.select("fp", "root").join(components, "root").select(
        F.col("fp").alias("of"), "root", F.col("first.doc_id").alias("component_id"), F.col("first.th").alias("first_th"), F.col("first.th2").alias("first_th2"), "n")
    out = written(out, "simhash-classes")  # so that a join with it may split a common fingerprint
    delete_path(spark, distinct_path)
    return out


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id
    reachable over links, itself included), one row per input row.

    Null text counts as empty (fingerprint zero, linked like any other); rows
    with a null id take part, and a component of such rows alone has a null
    component_id; repeated rows give repeated rows; an empty table gives an
    empty one; other columns are not read.
    """
    fps = written(fingerprints(docs, width, id_col, text_col), "simhash-fps")
    of = classes(fps, distance)
    return fps.join(of, F.col("fp") == F.col("of")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, one row of each component: that with the smallest id (a
    null id comes last), of several texts under that id the one with the
    smallest hash, and of rows equal in id and text one.  A row is told by its
    id and its text, so different texts under one id, or without one, are
    documents of their own.

    The rows that go are listed by id and text hashes, and the documents are
    joined to that list without an exchange of texts: it is broadcast if it
    has at most ``BROADCAST_ROWS`` rows (counted); beyond, a broadcast Bloom
    filter of bounded size lets nearly all documents pass that stay, and only
    the others meet the list."""
    spark = docs.sparkSession
    fps, fps_path = written_at(fingerprints(docs, width, id_col, text_col), "simhash-fps")
    of = classes(fps, distance).filter("n > 1")
    rows = fps.join(of, F.col("fp") == F.col("of"))
    chosen = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("th") == F.col("first_th")) & (F.col("th2") == F.col("first_th2"))
    key = [F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), "th", "th2"]
    listed = rows.groupBy(*key, chosen.alias("stays")).agg(F.count("*").alias("n")).filter("not stays or n > 1")
    listed = written(listed.select("d", "th", "th2", "stays"), "simhash-listed")
    delete_path(spark, fps_path)

    taken = [*docs.columns]
    name = {}
    for x in ("d", "th", "th2", "stays"):
        name[x] = fresh(taken, x)
        taken.append(name[x])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.withColumns({name["d"]: F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), **_text_hashes(text, name["th"], name["th2"])})
    keys = [name[x] for x in ("d", "th", "th2")]
    gone = listed.filter("not stays").select(*[F.col(x).alias(name[x]) for x in ("d", "th", "th2")])
    kept = without_listed(own, gone, keys)
    again = listed.filter("stays").select(*[F.col(x).alias(name[x]) for x in ("d", "th", "th2")])
    if not again.isEmpty():  # repeated rows
        once = with_listed(kept, again, keys).dropDuplicates(keys)
        kept = without_listed(kept, again, keys).unionByName(once)
    return kept.select(*docs.columns)


def without_listed(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is not in the table ``keys``; at most the few that a Bloom filter cannot tell are exchanged."""
    n = keys.count()
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keys), on, "left_anti")
    maybe, sure = _told(rows, keys, on, n)
    return sure.unionByName(maybe.join(keys, on, "left_anti"))


def with_listed(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    n = keys.count()
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keys), on, "left_semi")
    return _told(rows, keys, on, n)[0].join(keys, on, "left_semi")


def _told(rows: DataFrame, keys: DataFrame, on: list[str], n: int) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be in the table, rows whose key is not in it), by a
    Bloom filter of 64-bit words: a key sets four bits of one word.  Its at
    most ``BLOOM_WORDS`` words are made on Spark and broadcast."""
    words = min(BLOOM_WORDS, 1 << n.bit_length())
    word, mask = fresh(rows.columns, "word"), fresh(rows.columns, "mask")
    h = F.xxhash64(F.lit("bloom"), *on)
    one = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(63).cast("int"))
    at = F.pmod(F.shiftrightunsigned(h, 24), F.lit(words))
    bits = one(0).bitwiseOR(one(1)).bitwiseOR(one(2)).bitwiseOR(one(3))
    table = keys.select(at.alias(word), bits.alias(mask)).groupBy(word).agg(F.bit_or(mask).alias(mask))
    told = rows.withColumn(word, at).join(F.broadcast(table), word, "left")
    hit = F.coalesce(F.col(mask).bitwiseAND(bits) == bits, F.lit(False))
    return told.filter(hit).select(*rows.columns), told.filter(~hit).select(*rows.columns)
