from starprism.llm import secrets


def test_parts_far_apart_in_a_paragraph(spark):
    weak = "k9Xq2Lm8Zr4Tb7Wn1Vc5Yp3Hd"
    near = "user: bob " + "a " * 150 + weak + " " + "b " * 400 + "https://db.example/x"
    docs = spark.createDataFrame([(1, near), (2, "user: bob " + "a " * 150 + "\n\n" + weak)], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in secrets.scan(docs).collect()}
    assert [s.split(":")[0] for s in spans[1].split(",")] == ["weak_id", "weak_secret", "endpoint"] and spans[2] == ""
    text = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert weak not in text[1] and "bob" not in text[1] and "db.example" not in text[1] and weak in text[2]
