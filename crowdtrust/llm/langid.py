"""Language identification by compression.

Each language has a zstandard raw-content dictionary: lower-cased letters of
its learning texts.  A text is brought to the same form, cut into blocks, and
every block compressed with every language's dictionary; the language with
the fewest bytes over the whole text wins.  Blocks are short, so the
dictionary and not the text's own beginning tells the sizes apart.  The
relative margin to the runner-up is the score, and a text whose margin is
narrow is rejected.

A text of a few words is too short for that: zstandard stores it as it is
under every dictionary, and all sizes are equal.  Where the sizes are equal
the same method takes a finer measure: the text is put behind pieces of each
language's own dictionary, which cost a few bytes, and the bytes that it adds
to them are counted over ``CONTEXTS`` pieces.

Learning reads a bounded sample: ``SAMPLE_DOCS`` documents per language, those
with the least hash of their id, and ``DICTIONARY_BYTES`` of their text, of
each an even share that begins at a place chosen by hash, so that what all
texts of a source begin with does not fill the dictionary.
Prediction is narrow: whole texts, no shuffle, dictionaries by broadcast
(languages x ``DICTIONARY_BYTES``).
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, small_batches

#: Learning documents per language and bytes of each dictionary.
SAMPLE_DOCS, DICTIONARY_BYTES = 500, 64 << 10
#: Characters that reach the driver per language, as a multiple of DICTIONARY_BYTES.
SLACK = 4
#: Bytes that are compressed at once.
BLOCK = 2048
LEVEL = 12
#: Pieces of a dictionary that a short text is put behind, and their bytes.
CONTEXTS, CONTEXT_BYTES = 16, 192
#: A smaller relative margin is too narrow to tell languages apart.
MIN_MARGIN = 0.003
UNKNOWN = "und"

_NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Lower-cased words of letters, one blank between them."""
    return _NO_LETTERS.sub(" ", text.lower()).strip()


def held_out(id_col: str):
    """crc32 of the id as text, modulo 4, is 2 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def dictionary(texts: list[str]) -> bytes:
    """Even shares of the texts, so that no long one fills the dictionary, each from a place chosen by hash."""
    parts, room = [], DICTIONARY_BYTES
    encoded = sorted((letters(t).encode() for t in texts), key=lambda b: (len(b), b))
    for k, b in enumerate(encoded):
        take = min(len(b), room // (len(encoded) - k))
        at = zlib.crc32(b) % (len(b) - take + 1)
        parts.append(b[at: at + take])
        room -= take
    return b" ".join(p for p in parts if p)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """{language: dictionary}, from rows with id, text and language that are
    not held out.  The driver receives the bounded sample alone."""
    rows = docs.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"))
    rows = rows.filter(F.col("i").isNotNull() & F.col("t").isNotNull() & F.col("l").isNotNull() & ~held_out("i"))
    counts = rows.groupBy("l").agg(F.count("*").alias("n"))  # a row per language
    unit = (F.xxhash64("i").bitwiseAND(F.lit((1 << 32) - 1)) / F.lit(float(1 << 32))).alias("u")
    some = rows.select("l", "t", "i", unit).join(F.broadcast(counts), "l").filter(F.col("u") * F.col("n") < 3 * SAMPLE_DOCS)
    first = Window.partitionBy("l").orderBy("u", "i", "t")  # about 3 x SAMPLE_DOCS rows of each language
    picked = some.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= SAMPLE_DOCS)
    # what a dictionary can take of a text: a few times its even share, from a place chosen by hash
    much = F.ceil(F.lit(SLACK * DICTIONARY_BYTES) / F.least("n", F.lit(SAMPLE_DOCS))).cast("int")
    at = F.pmod(F.xxhash64("t"), F.greatest(F.length("t") - much, F.lit(0)) + 1).cast("int") + 1
    texts: dict[str, list[str]] = {}
    for r in picked.select("l", F.substring("t", at, much).alias("t")).orderBy("l", "t").collect():
        texts.setdefault(r["l"], []).append(r["t"])
    return {lang: d for lang, t in sorted(texts.items()) if (d := dictionary(t))}


def classifier(dictionaries: dict[str, bytes]):
    """text -> (language, score, accepted)."""
    import zstandard as zstd

    compressors, contexts = [], {}
    for lang, content in dictionaries.items():
        d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        compressors.append((lang, zstd.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False)))
        step = max((len(content) - CONTEXT_BYTES) // CONTEXTS, 1)
        pieces = [content[i * step: i * step + CONTEXT_BYTES] for i in range(CONTEXTS)]
        contexts[lang] = [(p, len(compressors[-1][1].compress(p))) for p in pieces]

    def ranked(sizes):
        (best, lang), (second, _) = sorted(sizes)[:2]
        return lang, 1 - best / second if second > 0 else 0.0

    def classify(text: str | None):
        plain = letters(text or "")
        if not compressors or not any(map(str.isalpha, plain)):
            return UNKNOWN, 0.0, False
        raw = plain.encode()
        blocks = [raw[i: i + BLOCK] for i in range(0, len(raw), BLOCK)]
        if len(compressors) == 1:
            return compressors[0][0], 0.0, True
        sizes = [(sum(len(c.compress(b)) for b in blocks), lang) for lang, c in compressors]
        lang, score = ranked(sizes)
        if score == 0:  # between those that are equal: what the beginning of the text adds to pieces of their dictionaries
            least = min(sizes)[0]
            lang, score = ranked([(sum(len(c.compress(p + b" " + blocks[0])) - n for p, n in contexts[x]), x)
                                  for (size, x), (_, c) in zip(sizes, compressors, strict=True) if size == least])
        return lang, min(max(score, 0.0), 1.0), score >= MIN_MARGIN

    return classify


def with_language(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str, names: tuple[str, str, str]) -> DataFrame:
    """The rows with three more columns: language, score, accepted."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches):
        import pyarrow as pa

        classify = classifier(shared.value)
        for batch in batches:
            found = [classify(t.as_py()) for t in batch.column(batch.schema.get_field_index(text_col))]
            lang, score, sure = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(sure, pa.bool_())],
                                             names=[*batch.schema.names, *names])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True))])
    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1: the relative margin),
    accepted; a row per input row.

    ``lang_col`` is read by learning alone.  Texts that are null or have no
    letter are ``und`` (score 0, not accepted), and so is every text if there
    is nothing to learn from; with one language learned, all texts with
    letters are that language.  Sizes that are equal by the finer measure, too,
    go to the first language in alphabetical order, with score 0.  Rows with null id or language are
    predicted, too; an empty table gives an empty one.
    """
    model = learn(docs, id_col, text_col, lang_col)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = with_language(narrow, model, "text", ("lang_pred", "score", "accepted"))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "accepted")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents, unchanged, whose language is told with a clear margin."""
    model = learn(docs, id_col, text_col, lang_col)
    names = []
    for base in ("lang_pred", "score", "accepted"):
        names.append(fresh([*docs.columns, *names], base))
    return with_language(docs, model, text_col, tuple(names)).filter(F.col(names[2])).select(*docs.columns)
