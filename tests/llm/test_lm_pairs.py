from tests.llm.conftest import prose

from starprism.llm import lm


def test_a_pair_seen_once_is_known(spark):
    train = spark.createDataFrame([(1, "red fox runs"), (2, "blue owl sings"), (3, prose(40, 1))], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "red fox runs"), (2, "red owl runs")], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score(asked, lm.F.lit(False), train).collect()}
    assert len(got) == 2 and got[1].base_score == got[2].base_score and got[1].score > got[2].score + 1
