"""Text preparation and the bigram preference models (SURVEY §2.7: K1–K3,
J1, T2, D1).

The reference tokenises with a BPE codec and scores with a transformer on
one device.  The Spark re-aim keeps the *table contracts* – token id arrays
truncated/padded to a fixed length, a log-prob per (prompt, side), a
trust-weighted model vs. an unweighted reference – and computes them with
explode / join / groupBy jobs:

* a word tokeniser made of built-in regex functions (no Python per row);
* a vocabulary capped at ``vocab_size`` (a top-k report: the cap is the
  feature) with fixed pad and unk ids, broadcast because its size is
  bounded by the cap;
* bigram language models: counts of (prev, tok) weighted by γ (side A) and
  1−γ (side B) for the policy, unweighted for the reference, add-k smoothed;
* sequence log-prob = Σ log p(tok_t | tok_{t−1}) over positions 1..n−1,
  optionally including padding positions as the reference does.

Whole texts are processed; truncation to ``max_len`` only happens where the
caller asks for fixed-length id arrays.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdtrust.operators.prepare import dense_index
from crowdtrust.operators.votes import BROADCAST_ROW_LIMIT
from crowdtrust.session import written

# Special token ids and the reference's sequence length.
PAD_ID = 0
UNK_ID = 1
FIRST_WORD_ID = 2
MAX_LEN = 128
TOKEN_PATTERN = r"[^\p{L}\p{N}]+"


def tokens(text) -> Column:
    """Lower-cased word tokens of a text (letters and digits), empty ones removed."""
    c = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.lower(c), TOKEN_PATTERN), "")


def side_tokens(prompts: DataFrame) -> DataFrame:
    """(prompt_id, side, pos, token) for both sides of every prompt, whole texts."""
    a = prompts.select("prompt_id", F.lit("a").alias("side"), F.posexplode(tokens("text_a")).alias("pos", "token"))
    b = prompts.select("prompt_id", F.lit("b").alias("side"), F.posexplode(tokens("text_b")).alias("pos", "token"))
    return a.unionByName(b)


def build_vocab(texts: DataFrame, text_cols: list[str], vocab_size: int | None) -> DataFrame:
    """K2: (token, token_id, count) for the ``vocab_size − 2`` most frequent
    tokens (ties by token), all of them with ``None``; ids start after the pad
    and unk ids.  The whole vocabulary is numbered across partitions."""
    parts = [texts.select(F.explode(tokens(c)).alias("token")) for c in text_cols]
    allt = parts[0]
    for p in parts[1:]:
        allt = allt.unionByName(p)
    counts = allt.groupBy("token").agg(F.count(F.lit(1)).cast("bigint").alias("count"))
    if vocab_size is None:
        every = dense_index(counts.withColumn("_n", -F.col("count")), ["_n", "token"], "_i")
        return every.select("token", (F.col("_i") + FIRST_WORD_ID).cast("int").alias("token_id"), "count")
    k = max(vocab_size - FIRST_WORD_ID, 0)
    top = counts.orderBy(F.desc("count"), "token").limit(k)
    # the top-k table has at most k rows, so one ordered window over it is bounded
    w = Window.orderBy(F.desc("count"), "token")
    return top.select("token", (F.row_number().over(w) - 1 + FIRST_WORD_ID).cast("int").alias("token_id"), "count")


def _vocab_join(df: DataFrame, vocab: DataFrame, vocab_size: int) -> DataFrame:
    v = vocab.select("token", "token_id")
    v = F.broadcast(v) if vocab_size <= BROADCAST_ROW_LIMIT else v
    return df.join(v, "token", "left").withColumn("token_id", F.coalesce("token_id", F.lit(UNK_ID)))


def token_ids(prompts: DataFrame, vocab: DataFrame, vocab_size: int, max_len: int | None = MAX_LEN,
              pad: bool = True) -> DataFrame:
    """K1: (prompt_id, ids_a, ids_b, n_tok_a, n_tok_b): token ids per side,
    truncated to ``max_len`` and right-padded with ``PAD_ID`` (the reference
    pads with its end-of-sequence id).  ``max_len=None`` keeps whole texts.

    Tokens are counted inside the row; one row per token that gets an id meets
    the vocabulary, and one aggregation puts both sides together again."""
    words = {0: tokens("text_a"), 1: tokens("text_b")}

    def listed(side, w):
        """(side, pos, token) of the tokens that get ids."""
        w = w if max_len is None else F.slice(w, 1, max_len)
        return F.transform(w, lambda t, i: F.struct(F.lit(side).alias("side"), i.alias("pos"), t.alias("token")))

    # counted below the explode: beside it, Spark would take the texts apart again for every row that comes out
    rows = prompts.select("prompt_id", F.size(words[0]).alias("n_tok_a"), F.size(words[1]).alias("n_tok_b"),
                          F.concat(*[F.coalesce(listed(s, w), F.array()) for s, w in words.items()]).alias("_t"))
    rows = rows.select("prompt_id", "n_tok_a", "n_tok_b", F.explode_outer("_t").alias("t"))
    rows = _vocab_join(rows.select("prompt_id", "n_tok_a", "n_tok_b", "t.side", "t.pos", "t.token"), vocab, vocab_size)

    def ids(side):
        got = F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("pos", "token_id"))))
        got = F.transform(got, lambda x: x["token_id"])
        if max_len is not None and pad:
            got = F.concat(got, F.array_repeat(F.lit(PAD_ID), F.lit(max_len) - F.size(got)))
        return got

    n_tok = lambda c: F.greatest(F.coalesce(F.first(c), F.lit(0)), F.lit(0)).alias(c)
    return rows.groupBy("prompt_id").agg(ids(0).alias("ids_a"), ids(1).alias("ids_b"), n_tok("n_tok_a"), n_tok("n_tok_b"))


def votes_with_text(votes: DataFrame, prompts: DataFrame) -> DataFrame:
    """Votes joined to their prompt's texts.  A vote on a prompt without
    text is an error: the job that reads the result fails and names the
    prompt.  No pass of its own is needed for that; :func:`orphan_votes` lists
    such votes.  Text-derived features should be computed once per prompt
    before this fan-out join."""
    p = prompts.select("prompt_id", "text_a", "text_b", F.lit(True).alias("_there"))
    out = votes.join(p, "prompt_id", "left")
    missing = F.raise_error(F.concat(F.lit("no text for prompt "), F.coalesce(F.col("prompt_id").cast("string"), F.lit("null"))))
    checked = F.when(F.col("_there"), F.col("prompt_id")).otherwise(missing.cast(votes.schema["prompt_id"].dataType))
    return out.withColumn("prompt_id", checked).drop("_there")


def orphan_votes(votes: DataFrame, prompts: DataFrame) -> DataFrame:
    """The votes on prompts that have no text."""
    return votes.join(prompts.select("prompt_id"), "prompt_id", "left_anti")


PAD_TOKEN = " pad"  # sentinel: contains a space, so the tokeniser never produces it
SPREAD = 1 << 16  # keys over which rows that meet nothing are dealt in a shuffled join


def spread_key(key: str, by: list[str], number: bool = False) -> Column:
    """``key``, or where it is null one of ``SPREAD`` keys that no word (with
    ``number``: no id) has: null keys would all go to one task."""
    salt = F.pmod(F.xxhash64(*by), F.lit(SPREAD))
    return F.coalesce(F.col(key), -1 - salt if number else F.concat(F.lit(" "), salt.cast("string")))


def side_bigrams(prompts: DataFrame, vocab: DataFrame, vocab_size: int, max_len: int | None = None,
                 include_pad: bool = False) -> DataFrame:
    """(prompt_id, side, prev_id, token_id, cnt): bigram occurrences per side.

    Bigrams are formed inside each row from the token array (slice +
    arrays_zip, no shuffle), mapped to ids with two joins against the
    vocabulary by broadcast and counted: one exchange, of ids alone, and none
    of words.  Of a vocabulary too large to broadcast that holds for the
    lowest ids, which the most frequent words have; bigrams with any other word
    are counted by that word and meet the rest of the vocabulary after.  With ``max_len`` and
    ``include_pad`` the sequence is padded to ``max_len`` and the pad
    positions count, as the reference's unmasked sum does."""
    parts = []
    for side, col in (("a", "text_a"), ("b", "text_b")):
        t = tokens(col)
        if max_len is not None:
            t = F.slice(t, 1, max_len)
            if include_pad:
                t = F.concat(t, F.array_repeat(F.lit(PAD_TOKEN), F.lit(max_len) - F.size(t)))
        parts.append(prompts.select("prompt_id", F.lit(side).alias("side"), t.alias("_t")))
    st = parts[0].unionByName(parts[1])
    m = F.greatest(F.size("_t") - 1, F.lit(0))
    pairs = st.select("prompt_id", "side", F.explode(F.arrays_zip(F.slice("_t", 1, m).alias("p"),
                                                                    F.slice("_t", 2, m).alias("q"))).alias("_z"))
    pairs = pairs.select("prompt_id", "side", F.col("_z.p").alias("prev_tok"), F.col("_z.q").alias("tok"))
    v = vocab.select("token", "token_id")
    few = vocab_size <= BROADCAST_ROW_LIMIT
    common = F.broadcast(v if few else v.filter(F.col("token_id") < BROADCAST_ROW_LIMIT))

    keys = ["prompt_id", "side", "prev_id", "token_id"]

    def to_id(df, col, out, words, known=None):
        key = col
        if known:
            key, df = "_key", df.withColumn("_key", spread_key(col, keys))
        j = df.join(words.select(F.col("token").alias(key), F.col("token_id").alias("_id")), key, "left")
        found = F.coalesce(*([] if known is None else [F.col(known)]), "_id", *([F.lit(UNK_ID)] if few or known else []))
        return j.withColumn(out, F.when(F.col(col) == PAD_TOKEN, F.lit(PAD_ID)).otherwise(found)).drop("_id", "_key")

    ids = to_id(to_id(pairs, "prev_tok", "prev_id", common), "tok", "token_id", common)
    if few:
        return ids.groupBy(*keys).agg(F.count(F.lit(1)).cast("bigint").alias("cnt"))
    ids = ids.select(*keys, *[F.when(F.col(i).isNull(), F.col(c)).alias(c) for i, c in (("prev_id", "prev_tok"), ("token_id", "tok"))])
    # the mark is an aggregate, so that both branches below read one exchange
    mark = F.max(F.col("prev_tok").isNotNull() | F.col("tok").isNotNull()).alias("_rare")
    counted = ids.groupBy(*keys, "prev_tok", "tok").agg(F.count(F.lit(1)).cast("bigint").alias("cnt"), mark)
    rest = v.filter(F.col("token_id") >= BROADCAST_ROW_LIMIT)
    rare = to_id(to_id(counted.filter("_rare"), "prev_tok", "prev_id", rest, "prev_id"), "tok", "token_id", rest, "token_id")
    # words that the vocabulary has not are one id now
    return counted.filter(~F.col("_rare")).select(*keys, "cnt").unionByName(rare.groupBy(*keys).agg(F.sum("cnt").alias("cnt")))


def bigram_model(bigrams: DataFrame, weights: DataFrame | None, vocab_size: int, add_k: float = 1.0) -> DataFrame:
    """Add-k smoothed bigram log-probs.

    ``weights``: (prompt_id, trust_weight) → side A rows weigh γ and side B
    rows 1−γ (the policy); ``None`` → every occurrence weighs 1 (reference).
    Returns (prev_id, token_id, logp) for seen bigrams and
    (prev_id, unseen_logp) per context through ``context_table``.
    """
    b = bigrams
    if weights is not None:
        w = weights.select("prompt_id", F.col("trust_weight").alias("_g"))
        b = b.join(w, "prompt_id").withColumn(
            "_w", F.col("cnt") * F.when(F.col("side") == "a", F.col("_g")).otherwise(1.0 - F.col("_g")))
    else:
        b = b.withColumn("_w", F.col("cnt").cast("double"))
    pair = b.groupBy("prev_id", "token_id").agg(F.sum("_w").alias("c"))
    ctx = pair.groupBy("prev_id").agg(F.sum("c").alias("c_prev"))
    j = pair.join(ctx.hint("shuffle_hash"), "prev_id")
    logp = F.log((F.col("c") + F.lit(add_k)) / (F.col("c_prev") + F.lit(add_k * vocab_size)))
    j = j.select("prev_id", "token_id", logp.alias("logp"),
                 F.log(F.lit(add_k) / (F.col("c_prev") + F.lit(add_k * vocab_size))).alias("unseen_logp"))
    return written(j, "bigram_model")  # counted, joined and reduced to its contexts below: made once


def sequence_logps(bigrams: DataFrame, model: DataFrame, vocab_size: int, add_k: float = 1.0,
                   n_model_rows: int | None = None, per_tokens: int | None = None) -> DataFrame:
    """(prompt_id, side, logp) = Σ cnt · log p(tok | prev) per side.

    Unseen bigrams of a seen context use the context's unseen log-prob;
    unseen contexts fall back to log(1 / vocab_size).  The model table is
    broadcast only when its counted size is under the broadcast limit;
    otherwise it is a shuffle join (AQE splits skewed bigram keys).  The
    contexts (at most a row per vocabulary entry) have a limit of their own,
    and meet what a side has of a context in unseen bigrams, added up, alone.
    ``per_tokens``: the mean over the whole text times so many tokens, so
    that texts of unlike length compare."""
    seen = model.select("prev_id", "token_id", "logp")
    ctx = model.groupBy("prev_id").agg(F.first("unseen_logp").alias("unseen_logp"))
    if n_model_rows is None:
        n_model_rows = seen.count()
    # beyond, each task hashes its share of the model, in which a bigram comes once; nothing is sorted
    seen = F.broadcast(seen) if n_model_rows <= BROADCAST_ROW_LIMIT else seen.hint("shuffle_hash")
    if min(n_model_rows, vocab_size) <= BROADCAST_ROW_LIMIT:
        ctx = F.broadcast(ctx)
    j = bigrams.join(seen, ["prev_id", "token_id"], "left")
    parts = j.groupBy("prompt_id", "side", F.when(F.col("logp").isNull(), F.col("prev_id")).alias("prev_id")).agg(
        F.sum(F.col("cnt") * F.col("logp")).alias("_seen"), F.sum("cnt").alias("cnt"))
    if min(n_model_rows, vocab_size) > BROADCAST_ROW_LIMIT:
        parts = parts.withColumn("prev_id", spread_key("prev_id", ["prompt_id", "side"], number=True))
    parts = parts.join(ctx, "prev_id", "left")
    total = F.sum(F.coalesce("_seen", F.col("cnt") * F.coalesce("unseen_logp", F.lit(-math.log(vocab_size)))))
    if per_tokens:
        total = total / F.sum("cnt") * F.lit(float(per_tokens))
    return parts.groupBy("prompt_id", "side").agg(total.alias("logp"))


def side_logps(logps: DataFrame, prompts: DataFrame, a: str, b: str) -> DataFrame:
    """Pivot per-side log-probs into two columns of these names; prompts
    without tokens on a side score 0."""
    of = lambda s: F.max(F.when(F.col("side") == s, F.col("logp")))
    both = logps.groupBy("prompt_id").agg(of("a").alias(a), of("b").alias(b))
    return prompts.select("prompt_id").join(both, "prompt_id", "left").fillna(0.0, [a, b])


def logps_table(pol: DataFrame, ref: DataFrame, prompts: DataFrame) -> DataFrame:
    """Both models' log-probs per side: (prompt_id, pi_a, pi_b, ref_a, ref_b);
    prompts without tokens on a side score 0."""
    named = lambda df, name: df.select("prompt_id", F.col("side"), F.struct(F.lit(name).alias("m"), "logp").alias("x"))
    both = named(pol, "pi").unionByName(named(ref, "ref"))
    cells = {f"{m}_{s}": F.max(F.when((F.col("side") == s) & (F.col("x.m") == m), F.col("x.logp"))) for m in ("pi", "ref") for s in ("a", "b")}
    per = both.groupBy("prompt_id").agg(*[c.alias(k) for k, c in cells.items()])
    return prompts.select("prompt_id").join(per, "prompt_id", "left").fillna(0.0, list(cells))


def pair_features(prompts: DataFrame, num_features: int = 64) -> DataFrame:
    """K3: hashed term-count difference φ(A) − φ(B) as a dense array plus the
    token-count difference (alone with ``num_features=0``), see
    :func:`row_pair_features`.  Rows under one prompt_id share the sum of
    their terms; without an id there are none."""
    out = row_pair_features(prompts, num_features)
    if not num_features:
        return out
    twice = prompts.groupBy("prompt_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1 and prompt_id is not null").select("prompt_id")
    if twice.isEmpty():
        return out
    cells = out.join(twice, "prompt_id", "left_semi").select("prompt_id", F.posexplode("phi").alias("i", "x"))
    total = cells.groupBy("prompt_id", "i").agg(F.sum("x").alias("x")).groupBy("prompt_id").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("_t"))
    out = out.join(total, "prompt_id", "left")
    return out.select("prompt_id", "len_diff", F.coalesce(F.transform("_t", lambda c: c["x"]), "phi").alias("phi"))


def _word_buckets(num_features: int):
    """A function from an Arrow array of words to their buckets, :func:`hash32`
    modulo ``num_features``.  A word is hashed once, however often it occurs."""

    def buckets(words):
        import hashlib

        import numpy as np
        import pyarrow as pa

        coded = words.dictionary_encode()
        different = coded.dictionary.cast(pa.large_binary()).to_pylist()
        own = np.fromiter((int.from_bytes(hashlib.md5(w).digest()[:4], "big") % num_features for w in different), np.int64, len(different))
        return own[coded.indices.to_numpy()]

    return buckets


def row_pair_features(prompts: DataFrame, num_features: int) -> DataFrame:
    """K3 for each row by itself: (prompt_id, len_diff, phi).  Tokens are
    counted inside the row: no row per token and no exchange."""
    rows = prompts.select("prompt_id", tokens("text_a").alias("_a"), tokens("text_b").alias("_b"))
    length = (F.size("_a") - F.size("_b")).cast("double").alias("len_diff")
    if not num_features:
        return rows.select("prompt_id", length, F.array().cast("array<double>").alias("phi"))
    own = lambda c: F.when(F.col("prompt_id").isNotNull(), F.col(c))
    rows = rows.select("prompt_id", length, *[F.coalesce(own(c), F.array().cast("array<string>")).alias(c) for c in ("_a", "_b")])
    buckets = _word_buckets(num_features)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            phi = np.zeros(n * num_features)
            for c, sign in (("_a", 1.0), ("_b", -1.0)):
                column = batch.column(c)
                row = np.repeat(np.arange(n), np.diff(column.offsets.to_numpy()))
                phi += sign * np.bincount(row * num_features + buckets(column.flatten()), minlength=n * num_features)
            at = pa.array(np.arange(n + 1, dtype=np.int32) * num_features)
            yield pa.RecordBatch.from_arrays([batch.column("prompt_id"), batch.column("len_diff"), pa.ListArray.from_arrays(at, pa.array(phi))],
                                             names=["prompt_id", "len_diff", "phi"])

    kind = prompts.schema["prompt_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"prompt_id {kind}, len_diff double, phi array<double>")


def sparse_pair_features(prompts: DataFrame, num_features: int) -> DataFrame:
    """K3, wide: (prompt_id, indices, values, len_diff): the hashed term-count
    difference φ(A) − φ(B) of :func:`pair_features` without its zeros, indices
    rising.

    Made inside the row, of many rows at a time: the buckets of both sides are
    sorted by row, and those that are alike added up.  No row per token and no
    exchange; the width costs nothing."""
    rows = prompts.select("prompt_id", tokens("text_a").alias("_a"), tokens("text_b").alias("_b"))
    rows = rows.select("prompt_id", (F.size("_a") - F.size("_b")).cast("double").alias("len_diff"),
                       *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("_a", "_b")])
    buckets = _word_buckets(num_features)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            n, keys, signs = batch.num_rows, [], []
            for c, sign in (("_a", 1.0), ("_b", -1.0)):
                column = batch.column(c)
                row = np.repeat(np.arange(n), np.diff(column.offsets.to_numpy()))
                keys.append(row * num_features + buckets(column.flatten()))
                signs.append(np.full(len(row), sign))
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            value = np.bincount(at, weights=np.concatenate(signs), minlength=len(key))
            key, value = key[value != 0], value[value != 0]
            ends = pa.array(np.searchsorted(key, np.arange(n + 1) * num_features).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in ((key % num_features).astype(np.int32), value)]
            yield pa.RecordBatch.from_arrays([batch.column("prompt_id"), *lists, batch.column("len_diff")], names=["prompt_id", "indices", "values", "len_diff"])

    kind = prompts.schema["prompt_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"prompt_id {kind}, indices array<int>, values array<double>, len_diff double")
