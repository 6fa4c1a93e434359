import zlib

from brute import CLASHING, documents
from conftest import SF001
from crowdtrust.llm import langid, queries

SF01 = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    out = queries.op8_compression_langid(spark, SF001).collect()
    assert {r.doc_id for r in out} == set(docs) and len(out) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.97 * len(held)
    assert sum(r.accepted for r in held) >= 0.98 * len(held)


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    other = docs.selectExpr("doc_id", "text", "if(crc32(cast(string(doc_id) as binary)) % 4 = 2, 'zz', lang) as lang")
    assert langid.learn(docs) == langid.learn(other)


def test_odd_rows(spark):
    learned = [(i, ("the cat sat on the mat and the dog " * 5 if i % 2 else "der hund und die katze auf dem dach ") * 3, "en" if i % 2 else "de") for i in range(40)]
    rows = learned + [(100, None, None), (101, "", "en"), (102, "123 !? ²", "en"), (None, "the cat sat on the mat", None), (103, "die katze und der hund", None), (104, "x", "en")]
    out = {r.doc_id: r for r in langid.identify(documents(spark, rows)).collect()}
    assert all(out[i].lang_pred == "und" and out[i].score == 0 and not out[i].accepted for i in (100, 101, 102))
    assert out[None].lang_pred == "en" and out[None].held_out is False and out[103].lang_pred == "de" and out[104].lang_pred in ("de", "en")
    df = documents(spark, rows)
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and set(CLASHING) < set(kept.columns)
    ids = {r.doc_id for r in kept.collect()}
    assert {None, 103, *range(40)} <= ids and not ids & {100, 101, 102}


def test_nothing_to_learn_from(spark):
    rows = [(1, "some text", None), (2, None, "en")]
    assert [(r.lang_pred, r.accepted) for r in langid.identify(documents(spark, rows)).collect()] == [("und", False)] * 2
    assert langid.identify(documents(spark, [])).collect() == [] and langid.keep_identified(documents(spark, [])).collect() == []
    one = [(i, "only one language here", "en") for i in range(8)] + [(50, "autre chose", None)]
    assert {(r.lang_pred, r.score, r.accepted) for r in langid.identify(documents(spark, one)).collect()} == {("en", 0.0, True)}


def test_whole_texts_count(spark):
    """The end of a long text weighs as much as its beginning."""
    en, de = "the cat sat on the mat and then the dog came home ", "der hund und die katze schlafen auf dem alten dach "
    classify = langid.classifier({"de": langid.dictionary([de * 50]), "en": langid.dictionary([en * 50])})
    assert classify(en * 20 + de * 400)[0] == "de" and classify(de * 20 + en * 400)[0] == "en"


def plain_classify(dictionaries, text):
    """The method once more, in plain steps."""
    import re

    import zstandard

    raw = re.sub(r"[\W\d_]+", " ", (text or "").lower()).strip().encode()
    if not re.search(r"[^\W\d_]", text or ""):
        return "und", 0.0

    def size(lang, data):
        d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=12)
        return len(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False).compress(data))

    blocks = [raw[i: i + 2048] for i in range(0, len(raw), 2048)]
    first = sorted((sum(size(x, b) for b in blocks), x) for x in dictionaries)
    if first[0][0] < first[1][0]:
        return first[0][1], 1 - first[0][0] / first[1][0]
    added = []
    for n, x in first:
        if n == first[0][0]:
            step = max((len(dictionaries[x]) - 192) // 16, 1)
            pieces = [dictionaries[x][i * step: i * step + 192] for i in range(16)]
            added.append((sum(size(x, p + b" " + blocks[0]) - size(x, p) for p in pieces), x))
    added.sort()
    return added[0][1], 1 - added[0][0] / added[1][0]


def test_predictions_are_those_of_the_plain_method(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    model = langid.learn(docs)
    classify = langid.classifier(model)
    texts = [r.text for r in docs.collect()]
    for text in [t for t in texts if t and len(t) < 60][:25] + texts[:25] + [None, "", "12", "a"]:
        lang, score, _ = classify(text)
        want = plain_classify(model, text)
        assert (lang, round(score, 12)) == (want[0], round(want[1], 12))


def test_short_documents_are_told_apart(spark):
    """One to five words: no ties for the alphabet to settle, few of them lost."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF01}/documents.parquet").collect() if r.text}
    classify = langid.classifier(langid.learn(spark.read.parquet(f"{SF01}/documents.parquet")))
    short = [(classify(r.text), r.lang) for r in docs.values() if len(r.text.split()) <= 5 and any(map(str.isalpha, r.text))]
    assert len(short) > 50
    assert sum(c[0] == lang for c, lang in short) >= 0.75 * len(short) and sum(c[2] for c, _ in short) >= 0.95 * len(short)


def test_learning_text_is_not_the_beginning_alone():
    """A banner that opens every text fills only a share of the dictionary; very long texts give their share, too."""
    banner, r = "read our terms and conditions before you go on ", __import__("random").Random(1)
    texts = [banner * 4 + " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(400)) for _ in range(400)] + ["zz " * 200_000]
    d = langid.dictionary(texts)
    assert len(d) <= langid.DICTIONARY_BYTES + len(texts) and d.count(b"terms and conditions") < 150 and b"zz zz" in d
