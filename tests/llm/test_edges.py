"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import brute
import pytest
from aerolake.llm import bpe, chat, decontaminate, licenses, lines, minhash, ngram, pii, quality, queries, warc
from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
ROWS = [(1, "a b c", "s"), (2, None, "s"), (3, "", None), (None, "null id text " * 30, "s"), (5, LONG, "t"), (5, LONG, "t"), (6, LONG, None), (7, " \n\t\n", "t"),
        (8, "É è ü ß <|endoftext|> it's 42!", "t")]
CLASHES = "q_n_words d_n_hit p_spans l_matches x_removed m_doc n_tokens s_key".split()


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns bear names that the operators use inside."""
    given = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return given.withColumns({c: F.lit(i) for i, c in enumerate(CLASHES)})


@pytest.fixture(scope="module")
def plain(docs):
    return docs.select("doc_id", "text", "source")


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_quality(plain):
    got = rows_of(quality.judge(plain), "doc_id", "q_n_words", "q_kept")
    want = sorted(((d, len(brute.WORD.findall(t or "")), False) for d, t, _ in ROWS), key=repr)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert quality.judge(plain.limit(0)).count() == 0 and quality.keep_good(plain.limit(0)).count() == 0


def test_quality_stage_keeps_columns(docs):
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} <= {5, 6, None}


def test_line_dedup(docs):
    got = lines.drop_repeats(docs)
    assert got.columns == [*[c for c in docs.columns if c != "x_removed"], "x_removed"]
    texts = {r.doc_id: r.text for r in got.collect()}
    assert texts[5] == LONG and texts[6] == "" and texts[2] is None and texts[3] == "" and texts[7] == " \n\t\n"
    assert got.count() == len(ROWS) and lines.drop_repeats(docs.limit(0)).count() == 0


def test_near_duplicates(docs):
    got = minhash.near_duplicates(docs)
    classes = {(r.doc_id, r.class_id) for r in got.collect()}
    assert got.count() == len(ROWS) and {(5, 5), (6, 5), (2, 2), (3, 2)} <= classes and (1, 1) in classes
    kept = minhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns and rows_of(kept, "doc_id") == rows_of(minhash.near_duplicates(docs).filter("kept").select("doc_id").distinct(), "doc_id")
    assert minhash.near_duplicates(docs.limit(0)).count() == 0 and minhash.keep_one_of_each(docs.limit(0)).count() == 0


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, "W3x3 w4X4! w5x5"), (1, "a B c"), (2, None), (3, "..."), (None, "42")], "item_id long, text string")
    given = docs
    got = decontaminate.scan_documents(given, items)
    hit = {r.doc_id: (r.d_n_hit, r["d_items"]) for r in got.collect()}
    assert hit[1] == (3, ["1"]) and hit[8] == (1, [""]) and hit[2] == (0, []) and hit[5][1] == ["1"]
    several = decontaminate.scan_documents(given, items, max_windows=1)
    assert rows_of(several, *got.columns) == rows_of(got, *got.columns)
    assert decontaminate.scan_documents(given.limit(0), items).count() == 0
    assert decontaminate.scan_documents(given, items.limit(0)).agg(F.sum("d_n_hit")).first()[0] == 0


def test_offsets_point_into_the_text(spark):
    docs = spark.createDataFrame([(1, "É, the QUICK  brown-fox ß!")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "quick brown fox")], "item_id long, text string")
    row = decontaminate.scan_documents(docs, items).first()
    assert [row.text[s.start : s.end] for s in row.d_chars] == ["QUICK  brown-fox"]


def test_encoding(docs):
    got = bpe.encode(docs, queries.vocabulary())
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.vocabulary())
    want = {(d, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids)) for d, t, _ in ROWS}
    assert {(r.doc_id, tuple(r.input_ids)) for r in got.collect()} == want and got.count() == len(ROWS)
    assert bpe.encode(docs.limit(0), queries.vocabulary()).count() == 0
    back = bpe.decode(got, queries.vocabulary())
    assert {(r.doc_id, r.text) for r in back.collect()} == {(d, tokenizer.decode(list(i), skip_special_tokens=False)) for d, i in want}


def test_personal_data(docs):
    got = pii.find_pii(docs)
    assert got.count() == len(ROWS) and {r.doc_id: len(r.p_spans) for r in got.collect()}[2] == 0
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_licenses(docs):
    got = licenses.scan(docs)
    assert got.count() == len(ROWS) and all(not r.l_matches for r in got.collect())
    assert licenses.scan(docs.limit(0)).count() == 0


def test_scores(plain):
    got = {(r.doc_id, r.n_tokens) for r in ngram.score_documents(plain).collect()}
    assert got == {(d, len(brute.WORD.findall(t or "")) + 1) for d, t, _ in ROWS}
    assert ngram.score_documents(plain.limit(0)).count() == 0
    only = ngram.score_documents(plain.filter("doc_id is null")).first()  # held out: nothing to learn from
    assert only.train_tokens == 0 and only.base_score == 0.0 and only.n_known == 0


def test_archives(spark):
    pages = spark.createDataFrame([(1, "http://a/\r\nX: y", "p"), (2, None, "p"), (2, None, "p"), (None, "u", "p"), (4, "u", None), (5, "u", ""), (6, "u", "ü" * 300_000)],
                                  "page_id long, url string, html string").withColumn("digest", F.lit(1))
    folder = warc.archive_folder(spark)
    got = rows_of(warc.read_records(warc.write_archives(pages, folder, archive_bytes=300), folder), "page_id", "record_type", "refers_to", "payload_bytes")
    assert got == sorted([(1, "revisit", 2, 1), (2, "response", None, 1), (2, "response", None, 1), (None, "revisit", 2, 1), (4, "revisit", 5, 0), (5, "response", None, 0),
                          (6, "response", None, 600_000)], key=repr)
    folder = warc.archive_folder(spark)
    assert rows_of(warc.read_records(warc.write_archives(pages, folder, min_payload=2), folder), "record_type") == [("response",)] * 7
    assert warc.read_records(warc.write_archives(pages.limit(0), folder), folder).count() == 0


def test_chats(spark):
    tricky = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "[\\INST]", "<", "", None, "[:]x[/ROLE]", "a\nb", "\\[INST]\\", " [/INST]"]
    rows = [(1, i, role, t) for i, (role, t) in enumerate((r, t) for t in tricky for r in ("user", "assistant", "to[:]ol", "system", None))]
    rows += [(2, 0, "user", "x"), (2, 0, "assistant", "y"), (2, 0, "user", "x"), (None, None, "user", "hi"), (3, 0, "user", "q"), (3, 1, "assistant", "a")]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    made = {r.conv_id: r for r in chat.format_chats(given).withColumn("parsed", chat.parse_chat(F.col("c_text"))).withColumn("learnt", chat.learnt_text(F.col("c_segments"))).collect()}
    assert [(p.role, p.text) for p in made[1].parsed] == [(r or "", t or "") for _, _, r, t in sorted(rows[: len(tricky) * 5], key=lambda x: x[1])]
    assert made[1].learnt == "".join(t or "" for c, _, r, t in rows if c == 1 and r == "assistant")
    assert [p.role for p in made[2].parsed] == ["assistant", "user", "user"] and made[2].c_first_break == 0
    assert made[3].c_valid and made[3].c_first_break is None and not made[None].c_valid
    assert chat.format_chats(given.limit(0)).count() == 0


def test_stages_of_the_pipeline(spark, docs):
    """Every stage takes all cases, returns the given columns, and leaves an empty table empty."""
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, docs.limit(0)):
            out = stage(spark, given, folder)
            assert out.count() <= given.count()
            assert name == "encoding" or (out.columns == given.columns and [f.dataType for f in out.schema] == [f.dataType for f in given.schema])
