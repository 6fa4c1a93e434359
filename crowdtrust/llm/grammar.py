"""Token-id files compressed by Re-Pair grammars.

A shard is a run of whole documents in ascending doc_id order, of about
``SHARD_IDS`` ids.  Re-Pair replaces repeated pairs of neighbouring symbols by
a new symbol (a rule) until no pair occurs twice.  A round here takes every
pair that occurs at least 1 / ``ROUND_SHARE`` times as often as the most
frequent one, where pairs overlap the more frequent one, since one pair at a
time would pass over the shard thousands of times.  Pairs never cross a
document's end.

File format: Parquet rows, one per shard:

    part, shard       place in ascending doc_id order
    ids_before        ids of the part before this shard
    n_ids             ids in the shard
    terminals         symbols below are ids, symbol terminals + r is rule r
    doc_ids, doc_sizes, doc_symbols    per document: id, ids, symbols
    rules             uint32 pairs: what each rule stands for
    rule_sizes        uint32: the number of ids a rule expands to
    symbols           uint32: what is left of the shard
    anchors           uint64: how many ids lie before every ``ANCHOR``-th symbol

A range of ids is read from the anchor before it: the sizes of less than
``ANCHOR`` symbols are added up, and of the rules only those are taken apart
that meet the range, level by level (:func:`read_range`).  That takes time by
the length of the range and the depth of the rules, not by the shard's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crowdtrust.session import scratch_path

from .common import id_and_text
from .tokens import unit_encoder

#: A shard is closed once it has so many ids (a longer document is a shard of its own).
SHARD_IDS = 1 << 19
#: Pieces of text whose ids a worker remembers (see ``tokens.Units``).
WORKER_UNITS = 1_200_000
#: A pair is replaced if it occurs so often in its shard, without overlaps.
MIN_COUNT = 2
ROUND_SHARE = 4
_HASH_BITS = 18
#: Symbols between two anchors.
ANCHOR = 512
#: Most bytes of per-part offsets that are broadcast; a shuffled join beyond.
BROADCAST_BYTES = 32 << 20

FORMAT = ("part int, shard int, ids_before long, n_ids long, terminals long, doc_ids array<long>, doc_sizes array<long>, "
          "doc_symbols array<long>, rules binary, rule_sizes binary, symbols binary, anchors binary")


def compress(ids, doc_ends, terminals: int, min_count: int = MIN_COUNT):
    """(rules r x 2, symbols, mask of symbols that end a document).

    A pair that was found only once is not looked at again, unless one of its
    symbols is replaced: no other replacement makes it more frequent."""
    import numpy as np

    s, last = np.array(ids, dtype=np.uint32), np.array(doc_ends, dtype=bool)
    live = ~last  # places whose pair may occur twice
    live[-1:] = False
    rules = [np.zeros((0, 2), np.uint32)]
    n_rules, turn, ceiling = 0, 0, len(s)
    slots = 1 << _HASH_BITS
    while len(s) > 1:
        # of a run of one symbol every other pair, from the left
        same = np.flatnonzero((s[:-1] == s[1:]) & ~last[:-1])
        run = np.flatnonzero(np.diff(same, prepend=-2) != 1)
        skip = same[(same - same[np.repeat(run, np.diff(run, append=len(same)))]) % 2 == 1]
        held = skip[live[skip]]
        live[skip] = False
        at = np.flatnonzero(live)
        live[held] = True
        # a slot counts at least as much as each of its pairs
        h = s[:-1] * np.uint32(0x9E3779B1)
        h += s[1:] * np.uint32(0x85EBCA77)
        h >>= np.uint32(32 - _HASH_BITS)
        h = h.take(at).astype(np.intp)
        counts = np.bincount(h, minlength=slots)
        least = max(min_count, 2, min(int(counts.max()), ceiling) // ROUND_SHARE)
        slot = counts.astype(np.int32).take(h)
        live[at] = slot > 1
        at = at.take(np.flatnonzero(slot >= least))
        pair = s.take(at).astype(np.uint64) << np.uint64(32) | s.take(at + 1)
        order, pair = _sorted(pair, terminals + n_rules)
        first = np.flatnonzero(np.diff(pair, prepend=~pair[:1]) != 0)
        n = np.diff(first, append=len(at))
        live[at[order[first[n < 2]]]] = False
        often = n >= least
        if not often.any():
            if least <= max(min_count, 2):
                break
            ceiling = least - 1
            continue
        ceiling = int(n.max())
        # a pair's number; and its rank: more frequent ones first, else by a hash that changes
        names = pair[first[often]]
        which = np.empty(len(at), dtype=np.int64)
        which[order] = np.repeat(np.where(often, np.cumsum(often) - 1, -1), n)
        at, which = at[which >= 0], which[which >= 0]
        rank = n[often].astype(np.uint64) << np.uint64(32) | names * np.uint64(0x9E3779B97F4A7C15 + 2 * turn) >> np.uint64(32)
        turn += 1
        # overlapping pairs: only one that is ahead of both neighbours, so the first in rank loses no occurrence
        mine = rank[which]
        touch = np.diff(at) == 1
        keep = np.ones(len(at), dtype=bool)
        keep[1:] &= ~(touch & (mine[:-1] >= mine[1:]))
        keep[:-1] &= ~(touch & (mine[1:] > mine[:-1]))
        left = np.bincount(which[keep], minlength=len(names))
        keep &= (left >= 2)[which]
        at, which = at[keep], which[keep]
        taken = left >= 2
        s[at] = (terminals + n_rules - 1 + np.cumsum(taken)[which]).astype(np.uint32)
        last[at] = last[at + 1]
        # the new symbol makes new pairs on both sides
        live[at] = True
        live[at[at > 0] - 1] = True
        stay = np.ones(len(s), bool)
        stay[at + 1] = False
        stay = np.flatnonzero(stay)
        s, last, live = s.take(stay), last.take(stay), live.take(stay)
        live &= ~last
        live[-1:] = False
        new = names[taken]
        rules.append(np.stack([new >> np.uint64(32), new & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32))
        n_rules += len(new)
    return np.concatenate(rules), s, last


def _sorted(pair, symbols: int):
    """(order, sorted pairs); pair and place are sorted as one number where 64 bits hold both."""
    import numpy as np

    bits, place = int(symbols).bit_length(), len(pair).bit_length()
    if 2 * bits + place > 64:
        order = np.argsort(pair)
        return order, pair[order]
    low, one, at = np.uint64(32), np.uint64((1 << bits) - 1), np.uint64(place)
    both = np.sort(((pair >> low) << np.uint64(bits) | pair & np.uint64(0xFFFFFFFF)) << at | np.arange(len(pair), dtype=np.uint64))
    order = (both & np.uint64((1 << place) - 1)).astype(np.int64)
    both >>= at
    return order, (both >> np.uint64(bits)) << low | both & one


def rule_sizes(rules, terminals: int):
    """Number of ids each rule stands for (a rule only names earlier ones)."""
    import numpy as np

    pairs = np.asarray(rules, dtype=np.int64).reshape(-1, 2)
    sizes = np.zeros(len(pairs), dtype=np.int64)
    todo = np.arange(len(pairs))
    while len(todo):  # those whose two symbols are known, level by level
        part = pairs[todo]
        own = np.where(part < terminals, 1, sizes[np.maximum(part - terminals, 0)])
        known = (own > 0).all(axis=1)
        sizes[todo[known]] = own[known].sum(axis=1)
        todo = todo[~known]
    return sizes.tolist()


def expand(symbols, rules, terminals: int):
    """The ids that the symbols stand for."""
    import numpy as np

    s = np.asarray(symbols, dtype=np.uint32)
    # what every rule stands for, one after another
    flat = np.asarray(rules, dtype=np.uint32).ravel()
    sizes = np.full(len(rules), 2, dtype=np.int64)
    while len(at := np.flatnonzero(flat >= terminals)):
        owner = np.repeat(np.arange(len(rules)), sizes)
        pair = rules[flat[at] - np.uint32(terminals)]
        sizes += np.bincount(owner[at], minlength=len(rules))
        flat = np.repeat(flat, 1 + (flat >= terminals))
        at = at + np.arange(len(at))
        flat[at], flat[at + 1] = pair[:, 0], pair[:, 1]
    rule = np.flatnonzero(s >= terminals)
    if len(rule) == 0:
        return s
    number = s[rule] - np.uint32(terminals)
    size = np.ones(len(s), dtype=np.int64)
    size[rule] = sizes[number]
    to = (np.cumsum(size) - size)[rule]
    of = (np.cumsum(sizes) - sizes)[number]
    long = size[rule]
    within = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)
    out = np.repeat(s, size)
    out[np.repeat(to, long) + within] = flat[np.repeat(of, long) + within]
    return out


def _sizes(symbols, sizes, terminals: int):
    """The number of ids that each symbol stands for; ``sizes`` are those of the rules."""
    import numpy as np

    out = np.ones(len(symbols), dtype=np.int64)
    big = symbols >= terminals
    out[big] = sizes[symbols[big] - np.uint32(terminals)]
    return out


def anchors(symbols, sizes, terminals: int):
    """How many ids lie before every ``ANCHOR``-th symbol."""
    import numpy as np

    own = _sizes(symbols, sizes, terminals)
    return (np.cumsum(own) - own)[::ANCHOR]


def read_range(shard: dict, lo: int, hi: int):
    """ids lo to hi (exclusive) of a shard row, without those outside it."""
    import numpy as np

    t = shard["terminals"]
    rules = np.frombuffer(shard["rules"], dtype="<u4").reshape(-1, 2)
    sizes = np.frombuffer(shard["rule_sizes"], dtype="<u4")
    symbols = np.frombuffer(shard["symbols"], dtype="<u4")
    start = np.frombuffer(shard["anchors"], dtype="<u8")
    lo, hi = max(lo, 0), min(hi, shard["n_ids"])
    if hi <= lo:
        return symbols[:0]
    a = int(np.searchsorted(start, lo, side="right")) - 1
    b = int(np.searchsorted(start, hi, side="left"))
    s, before = symbols[a * ANCHOR: b * ANCHOR], int(start[a])
    while True:
        own = _sizes(s, sizes, t)
        at = before + np.cumsum(own) - own
        meets = (at < hi) & (at + own > lo)
        s, at = s[meets], at[meets]
        big = s >= t
        if not big.any():
            return s
        # each rule gives way to what it stands for, one level
        before, n = int(at[0]), np.where(big, 2, 1)
        place = (np.cumsum(n) - n)[big]
        pair = rules[s[big] - np.uint32(t)]
        s = np.repeat(s, n)
        s[place], s[place + 1] = pair[:, 0], pair[:, 1]


def read_span(spark, path: str, lo: int, hi: int) -> DataFrame:
    """(start, ids): ids lo to hi (exclusive) of all shards in order, a row per
    shard that meets the range, ``start`` counted over all; only those shards
    are read whole, and of them only the range is expanded."""
    shards = spark.read.schema(FORMAT).parquet(path)
    at = F.col("part_start") + F.col("ids_before")
    met = shards.join(_part_starts(shards), "part").withColumn("at", at).filter((F.col("at") < hi) & (F.col("at") + F.col("n_ids") > lo))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = read_range(row, lo - row["at"], hi - row["at"])
                yield pa.RecordBatch.from_arrays([pa.array([max(lo, row["at"])]), pa.array([ids.astype("<u4").tobytes()], pa.binary())], names=["start", "ids"])

    return met.select("at", "n_ids", "terminals", "rules", "rule_sizes", "symbols", "anchors").mapInArrow(run, "start long, ids binary")


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append ``end_id`` and write the shards to ``path``.

    Documents lie in ascending doc_id order (null ids first; equal ids by
    their texts' hash).  Null text counts as empty, so that document is
    ``end_id`` alone.  One shuffle, by range of doc_id; a task holds one
    Arrow batch and one shard.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        units = unit_encoder(vocabulary, WORKER_UNITS)
        terminals = max(units.library.get_vocab_size(with_added_tokens=True), end_id + 1)
        end = np.array([end_id], dtype="<u4").tobytes()
        schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("ids_before", pa.int64()), ("n_ids", pa.int64()), ("terminals", pa.int64()),
                            *((c, pa.list_(pa.int64())) for c in ("doc_ids", "doc_sizes", "doc_symbols")),
                            *((c, pa.binary()) for c in ("rules", "rule_sizes", "symbols", "anchors"))])
        before, shard = 0, 0
        names: list = []
        held: list[bytes] = []

        def close():
            nonlocal before, shard
            sizes = np.array([len(x) // 4 for x in held], dtype=np.int64)
            ids = np.frombuffer(b"".join(held), dtype="<u4")
            ends = np.zeros(len(ids), bool)
            ends[np.cumsum(sizes) - 1] = True
            rules, symbols, last = compress(ids, ends, terminals)
            own = np.array(rule_sizes(rules, terminals), dtype="<u4")
            row = {"part": part, "shard": shard, "ids_before": before, "n_ids": len(ids), "terminals": terminals,
                   "doc_ids": list(names), "doc_sizes": sizes.tolist(), "doc_symbols": np.diff(np.flatnonzero(last), prepend=-1).tolist(),
                   "rules": rules.astype("<u4").tobytes(), "rule_sizes": own.tobytes(), "symbols": symbols.astype("<u4").tobytes(),
                   "anchors": anchors(symbols, own, terminals).astype("<u8").tobytes()}
            before, shard = before + len(ids), shard + 1
            names.clear()
            held.clear()
            return pa.RecordBatch.from_pylist([row], schema=schema)

        room = SHARD_IDS
        for batch in batches:
            some = (batch.slice(lo, 2048) for lo in range(0, batch.num_rows, 2048))
            for doc_id, ids in (x for b in some for x in zip(b.column("doc_id").to_pylist(), units.encode_all(b.column("text")), strict=True)):
                held.append(ids + end)
                names.append(doc_id)
                room -= len(held[-1]) // 4
                if room <= 0:
                    yield close()
                    room = SHARD_IDS
        if held:
            yield close()

    d = id_and_text(docs, id_col, text_col).withColumn("h", F.xxhash64("text")).withColumn("r", F.monotonically_increasing_id())
    d = d.repartitionByRange(F.col("doc_id").asc_nulls_first(), "h", "r").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "r")
    d.select("doc_id", "text").mapInArrow(run, FORMAT).write.option("compression", "zstd").parquet(path)


def _part_starts(shards: DataFrame) -> DataFrame:
    """(part, part_start): the ids before each part; a row per part."""
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    return F.broadcast(parts) if parts.count() * 16 <= BROADCAST_BYTES else parts


def read_ids(spark, path: str) -> DataFrame:
    """Every document of the shards below ``path``: doc_id, start (ids of all
    documents before it), n_tokens, ids (little-endian uint32 bytes)."""
    shards = spark.read.schema(FORMAT).parquet(path)
    parts = _part_starts(shards)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                rules = np.frombuffer(row["rules"], dtype="<u4").reshape(-1, 2)
                ids = expand(np.frombuffer(row["symbols"], dtype="<u4"), rules, row["terminals"]).astype("<u4").tobytes()
                ends = np.cumsum(row["doc_sizes"])
                starts = ends - row["doc_sizes"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["part_start"] + row["ids_before"], pa.int64()),
                     pa.array(row["doc_sizes"], pa.int64()), pa.array([ids[4 * a: 4 * b] for a, b in zip(starts, ends, strict=True)], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"])

    columns = ["doc_ids", "doc_sizes", "rules", "symbols", "terminals", "ids_before", "part_start"]
    return shards.join(parts, "part").select(*columns).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def write_and_read(docs: DataFrame, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`write_ids` to a folder below the shared checkpoint folder, then
    :func:`read_ids`.  Repeated rows are documents of their own; an empty
    table gives no rows; other columns are not read."""
    path = scratch_path(docs.sparkSession, "token-ids")
    write_ids(docs, path, vocabulary, end_id, id_col, text_col)
    return read_ids(docs.sparkSession, path)
