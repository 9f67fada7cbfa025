"""What packing holds in a worker: few words, small batches."""

import pyarrow as pa

from loamline.llm import common, packing


def test_packing_holds_few_words_and_small_batches(spark, monkeypatch):
    rows = spark.range(4000).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 300) AS text").coalesce(1)  # 10 MB in one task

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    with common.small_batches(spark):
        most = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
    assert len(most) > 1 and max(most) < 1.2 * common.BATCH_BYTES
    key, seen, plain = "spark.sql.execution.arrow.maxBytesPerBatch", [], packing.written
    monkeypatch.setattr(packing, "written", lambda df, name: seen.append(df.sparkSession.conf.get(key, None)) or plain(df, name))
    assert packing.pack(rows.limit(3)).count() == 3 and seen == [str(common.BATCH_BYTES)] and spark.conf.get(key, None) is None


def test_words_of_several_slices_are_held_and_all_ids_stay_right(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "WORDS_HELD", 200)
    tokenizer, encoder = Tokenizer.from_file(packing.default_tokenizer()), packing.WordEncoder(packing.default_tokenizer())
    for k in range(6):
        texts = [f"often, seen {' '.join(f'w{k}x{i}' for i in range(150))} Often.", None, "", f"q{k} seen"]
        ids, offsets = encoder.encode(pa.array(texts))
        want = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID] for t in texts]
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == want
        assert len(encoder.known) <= 200 + 400 and (not k or {"often,", "seen"} <= set(encoder.known))
    encoder.forget()
    assert {"often,", "seen"} <= set(encoder.known) and len(encoder.known) < 20
