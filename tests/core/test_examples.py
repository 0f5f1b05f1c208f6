from toneforge.operators import examples


def test_prepared_examples(spark):
    docs = spark.createDataFrame([("a", "Tôi đang hòa bình"), ("b", "x")], "sample_id string, text string")

    def halves(chunk):
        cut = max(1, len(chunk) // 2)
        parts = [chunk[:cut] + "@@", chunk[cut:]] if chunk[cut:] else [chunk]
        return parts, list(range(len(parts)))

    rows = {r.sample_id: r for r in examples.with_specials(examples.prepared(docs, 35422, 0, halves, frozenset({"toi", "dang", "hoa", "binh"})), 0, 2).collect()}
    a = rows["a"]
    assert a.tokens == ["T@@", "oi", "da@@", "ng", "h@@", "oa", "bi@@", "nh"]
    assert a.clean_tones == ["UNMARKED"] * 4 + ["HUYEN"] * 4 and len(a.corrupt_tones) == 8
    assert a.clean_letters[:4] == ["NONE", "NONE", "NONE", "NONE"] and a.input_ids[0] == 0 and a.special_tokens_mask == [1, *[0] * 8, 1]
    assert rows["b"].clean_tones == ["NA"]
    again = {r.sample_id: r.corrupted for r in examples.sampled(docs, 35422, 0).collect()}
    assert again == {r.sample_id: r.corrupted for r in examples.sampled(docs.orderBy("text"), 35422, 0).collect()}
